"""Batches from Arrow, Parquet and JSON, checked and brought to the table's columns."""

from __future__ import annotations

import io
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import ArrowError, SegmentError, TableError
from quern.functions.schema import TableSchema

#: Place of a row in its batch: source file, then number.  The later of two rows with one key wins.
SOURCE, POSITION = "__source", "__position"
ARROW_MIME, PARQUET_MIME, JSON_MIME = "application/vnd.apache.arrow.stream", "application/vnd.apache.parquet", "application/json"


def _refuse(text: str):
    raise TableError(f"{text} is no JSON value")


def json_table(body: bytes | str | dict, schema: TableSchema) -> pa.Table:
    """{"columns": {name: [...]}} as Arrow: all declared columns, others ignored, values checked one by one."""
    if not isinstance(body, dict):
        try:
            body = json.loads(body, parse_constant=_refuse)
        except ValueError as e:
            raise TableError(f"not JSON: {e}") from e
    columns = body.get("columns") if isinstance(body, dict) else None
    if not isinstance(columns, dict):
        raise TableError('a payload is {"columns": {name: [...]}}')
    made = []
    for name, c in schema.columns.items():
        values = columns.get(name)
        if not isinstance(values, list):
            raise TableError(f"column {name!r} is missing or no list")
        made.append(pa.array([c.type.from_json(v) for v in values], c.type.arrow))
    if len({len(a) for a in made}) > 1:
        raise TableError("columns differ in length")
    return pa.Table.from_arrays(made, schema=pa.schema([pa.field(n, c.type.arrow) for n, c in schema.columns.items()]))


def ipc_table(body: bytes) -> pa.Table:
    """All batches of an Arrow IPC stream."""
    try:
        return pa.ipc.open_stream(body).read_all()
    except (pa.ArrowInvalid, OSError) as e:
        raise ArrowError(f"not an Arrow stream: {e}") from e


def parquet_table(body: bytes) -> pa.Table:
    try:
        return pq.read_table(io.BytesIO(body))
    except (pa.ArrowInvalid, OSError) as e:
        raise TableError(f"not Parquet: {e}") from e


def checked(table: pa.Table, schema: TableSchema, large_strings: bool = False) -> pa.Table:
    """The declared columns of ``table`` in their order; exact types only, no nulls where none may be."""
    made = []
    for name, c in schema.columns.items():
        if table.schema.get_all_field_indices(name) == []:
            raise SegmentError(f"column {name!r} is missing")
        column = table.column(name)
        if large_strings and c.dtype == "utf8" and column.type == pa.large_string():
            column = column.cast(pa.string())
        if column.type != c.type.arrow:
            raise SegmentError(f"column {name!r} is {column.type}, not {c.type.arrow}")
        if column.null_count and (name == schema.key or not c.nullable):
            raise SegmentError(f"column {name!r} has nulls")
        made.append(column.cast(c.type.carrier))
    return pa.table(made, names=list(schema.columns))


def from_arrow(spark: SparkSession, table: pa.Table, schema: TableSchema, large_strings: bool = False) -> DataFrame:
    rows = checked(table, schema, large_strings)
    rows = rows.append_column(SOURCE, pa.array([""] * len(rows), pa.string())).append_column(POSITION, pa.array(range(len(rows)), pa.int64()))
    return spark.createDataFrame(rows)


def from_frame(df: DataFrame, schema: TableSchema, position=None, source=None) -> DataFrame:
    """The declared columns of a DataFrame, whose types must be those of the store.

    ``position`` (a long) orders rows of one key; without it, the order in which partitions and rows come.
    """
    types = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True))
    for name, c in schema.columns.items():
        if name not in types:
            raise SegmentError(f"column {name!r} is missing")
        if types[name] != c.type.spark:
            raise SegmentError(f"column {name!r} is {types[name].simpleString()}, not {c.type.spark.simpleString()}")
    place = F.monotonically_increasing_id() if position is None else position
    source = F.lit("") if source is None else source
    return df.select(*(F.col(f"`{n}`") for n in schema.columns), source.alias(SOURCE), place.cast("long").alias(POSITION))


def from_parquet(spark: SparkSession, paths: list[str], schema: TableSchema) -> DataFrame:
    """Parquet files, read in parallel; rows are placed by file name, then by number within the file."""
    df = spark.read.parquet(*paths)
    return from_frame(df, schema, F.col("_metadata.row_index"), F.col("_metadata.file_path"))
