"""Results as Arrow tables, Arrow IPC streams and columnar JSON."""

from __future__ import annotations

import io
import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.functions.schema import TableSchema


def to_arrow(df: DataFrame, schema: TableSchema, columns: list[str]) -> pa.Table:
    """``df``, whose columns are ``columns`` in order, with the declared types; unsigned ones are restored."""
    got = df.toArrow()
    made = [got.column(i).cast(schema.columns[n].type.arrow) for i, n in enumerate(columns)]
    return pa.Table.from_arrays(made, schema=pa.schema([pa.field(n, schema.columns[n].type.arrow) for n in columns]))


def to_ipc(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue()


def to_json(table: pa.Table) -> str:
    """{"columns": {name: [...]}}; whole numbers exact, NaN and infinities null, repeated columns once."""
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps({"columns": {n: [plain(v) for v in table.column(i).to_pylist()] for i, n in enumerate(table.column_names)}}, ensure_ascii=False)
