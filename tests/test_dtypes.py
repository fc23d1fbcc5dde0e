import json

import pyarrow as pa
import pytest

from quern.errors import ArrowError, SegmentError, TableError
from quern.functions.dtypes import DTYPES, dtype_of
from quern.functions.schema import ColumnSchema, TableSchema
from quern.sources import egress, ingest

BOUNDS = {n: (d.low, d.high) for n, d in DTYPES.items() if d.low is not None}
VALUES = {
    "utf8": ["hello", None, "", "δ-unicode"],
    "bool": [True, None, False],
    "float32": [1.5, None, -2.5, 0.0],
    "float64": [3.15, None, -1e10, 0.0],
} | {n: [7, None, low, high, 0] for n, (low, high) in BOUNDS.items()}


def schema(**columns: str) -> TableSchema:
    return TableSchema("id", {"id": ColumnSchema("utf8", False)} | {n: ColumnSchema(t) for n, t in columns.items()})


@pytest.mark.parametrize("dtype", DTYPES)
def test_json_round_trip(dtype):
    values = VALUES[dtype]
    body = {"columns": {"id": [str(i) for i in range(len(values))], "v": values}}
    table = ingest.json_table(json.dumps(body), schema(v=dtype))
    assert table.column("v").type == DTYPES[dtype].arrow
    assert json.loads(egress.to_json(table)) == body


@pytest.mark.parametrize(
    ("dtype", "value"),
    [("int8", 200), ("int8", -129), ("int32", 1.5), ("int32", 1.0), ("int32", "7"), ("int32", True), ("utf8", 42), ("bool", 1), ("float32", True), ("float32", "NaN"), ("uint64", -1), ("uint64", 2**64), ("float64", "text"), ("float64", [1])],
)
def test_json_rejects(dtype, value):
    with pytest.raises(SegmentError):
        ingest.json_table({"columns": {"id": ["a"], "v": [value]}}, schema(v=dtype))


def test_json_numbers_beyond_doubles():
    t = ingest.json_table('{"columns": {"id": ["a"], "u": [18446744073709551615], "d": [9007199254740993]}}', schema(u="uint64", d="float64"))
    assert t.column("u").to_pylist() == [2**64 - 1] and t.column("d").to_pylist() == [float(2**53 + 1)]
    assert '"u": [18446744073709551615]' in egress.to_json(t)


@pytest.mark.parametrize("body", ["", "[]", '{"columns": []}', '{"columns": {"id": ["a"]}}', '{"columns": {"id": ["a"], "v": "x"}}', '{"columns": {"id": ["a"], "v": [NaN]}}', '{"columns": {"id": ["a", "b"], "v": [1]}}'])
def test_json_payloads_that_are_none(body):
    with pytest.raises(TableError):
        ingest.json_table(body, schema(v="float64"))


def test_json_extra_columns_are_ignored():
    assert ingest.json_table({"columns": {"id": ["a"], "v": [1], "w": [2, 3]}}, schema(v="int8")).column_names == ["id", "v"]


def test_egress_has_no_nan():
    t = pa.table({"v": pa.array([float("nan"), float("inf"), 1.0])})
    assert json.loads(egress.to_json(t)) == {"columns": {"v": [None, None, 1.0]}}


def test_only_exact_arrow_types():
    assert dtype_of(pa.uint16()).name == "uint16"
    for t in (pa.large_string(), pa.string_view(), pa.binary(), pa.timestamp("us"), pa.decimal128(5, 2), pa.dictionary(pa.int8(), pa.string())):
        with pytest.raises(SegmentError):
            dtype_of(t)


def test_checked():
    s = schema(v="float32")
    good = pa.table({"x": [1], "v": pa.array([1.0], pa.float32()), "id": ["a"]})
    assert ingest.checked(good, s).column_names == ["id", "v"]
    with pytest.raises(SegmentError):
        ingest.checked(good.set_column(1, "v", pa.array([1.0], pa.float64())), s)
    with pytest.raises(SegmentError):
        ingest.checked(good.drop_columns(["v"]), s)
    with pytest.raises(SegmentError):
        ingest.checked(good.set_column(2, "id", pa.array([None], pa.string())), s)
    large = good.set_column(2, "id", pa.array(["a"], pa.large_string()))
    with pytest.raises(SegmentError):
        ingest.checked(large, s)
    assert ingest.checked(large, s, large_strings=True).column("id").type == pa.string()


def test_streams_and_files():
    t = pa.table({"id": ["a", "b", "c"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        for b in t.to_batches(max_chunksize=1):
            w.write_batch(b)
    assert ingest.ipc_table(sink.getvalue().to_pybytes()).num_rows == 3
    with pytest.raises(ArrowError):
        ingest.ipc_table(b"nothing")
    with pytest.raises(TableError):
        ingest.parquet_table(b"nothing")


def test_schemas():
    s = schema(v="int8")
    assert TableSchema.from_json(s.to_json()) == s
    assert s.arrow().metadata == {b"key": b"id"} and not s.arrow().field("id").nullable
    assert s.spark()["v"].metadata == {"dtype": "int8"}
    for bad in (TableSchema("x", s.columns), TableSchema("v", s.columns), TableSchema("id", s.columns | {"__n": ColumnSchema("int8")}), TableSchema("id", s.columns | {"V": ColumnSchema("int8")})):
        with pytest.raises(TableError):
            bad.validate()
    for raw in ({}, {"key": "a"}, {"key": "a", "columns": {"a": {"dtype": "utf8", "more": 1}}}, {"key": "a", "columns": {"a": {"dtype": "date"}}}, []):
        with pytest.raises(TableError):
            TableSchema.from_json(raw)
