"""Queries over the engine's edges: what it rejects, odd requests, the HTTP paths, backends, compaction by itself."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import ColumnSchema, Config, Engine, TableSchema
from quern.errors import EngineError
from quern.functions.dtypes import DTYPES
from quern.plans import queries as plain
from quern.sources import transport
from quern.sources.scratch import scratch

SCORES = TableSchema("id", {"id": ColumnSchema("utf8", False), "score": ColumnSchema("float32"), "small": ColumnSchema("int8"), "flag": ColumnSchema("bool"), "label": ColumnSchema("utf8", False)})


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of request that is refused, with the error's kind and HTTP status."""
    e = plain.engine(spark, "rejections")
    e.create_table("t", SCORES)
    good = {"id": pa.array(["a"]), "score": pa.array([1.0], pa.float32()), "small": pa.array([1], pa.int8()), "flag": pa.array([True]), "label": pa.array(["x"])}
    batch = lambda **other: pa.table(good | other)
    body = lambda **other: json.dumps({"columns": {"id": ["a"], "score": [1.0], "small": [1], "flag": [True], "label": ["x"]} | other})
    cases = {
        "unknown table, schema": lambda: e.get_schema("u"),
        "unknown table, read": lambda: e.read("u", ["a"], ["nope"]),
        "unknown table, write": lambda: e.write("u", batch()),
        "known table, create": lambda: e.create_table("t", SCORES),
        "bad name, create": lambda: e.create_table("a/b", SCORES),
        "key that is no text, create": lambda: e.create_table("v", TableSchema("id", {"id": ColumnSchema("float32")})),
        "key that is no column, create": lambda: e.create_table("v", TableSchema("id", {"x": ColumnSchema("utf8")})),
        "unknown column, read": lambda: e.read("t", ["a"], ["nope"]),
        "key column, read": lambda: e.read("t", ["a"], ["id"]),
        "no column, read": lambda: e.read("t", ["a"], []),
        "key that is null, read": lambda: e.read("t", [None], ["score"]),
        "key that is null, write": lambda: e.write("t", batch(id=pa.array([None], pa.string()))),
        "null in a column without nulls, write": lambda: e.write("t", batch(label=pa.array([None], pa.string()))),
        "other type, write": lambda: e.write("t", batch(score=pa.array(["1"]))),
        "number beyond its type, JSON": lambda: e.write_json("t", body(small=[200])),
        "fraction for a whole number, JSON": lambda: e.write_json("t", body(small=[1.5])),
        "text for a number, JSON": lambda: e.write_json("t", body(score=["1"])),
        "number for a text, JSON": lambda: e.write_json("t", body(label=[42])),
        "number for a boolean, JSON": lambda: e.write_json("t", body(flag=[1])),
        "not JSON": lambda: e.write_json("t", "{"),
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "none", 200))
        except EngineError as error:
            rows.append((name, error.code, error.status))
    return spark.createDataFrame(rows, "request string, code string, status int")


REJECTIONS = """
SELECT * FROM (VALUES
 ('unknown table, schema', 'NOT_FOUND', 404::INTEGER), ('unknown table, read', 'NOT_FOUND', 404), ('unknown table, write', 'NOT_FOUND', 404),
 ('known table, create', 'ALREADY_EXISTS', 409), ('bad name, create', 'INVALID_ARGUMENT', 400),
 ('key that is no text, create', 'INVALID_ARGUMENT', 400), ('key that is no column, create', 'INVALID_ARGUMENT', 400),
 ('unknown column, read', 'INVALID_ARGUMENT', 400), ('key column, read', 'INVALID_ARGUMENT', 400), ('no column, read', 'INTERNAL', 500),
 ('key that is null, read', 'INVALID_ARGUMENT', 400), ('key that is null, write', 'INVALID_ARGUMENT', 400),
 ('null in a column without nulls, write', 'INVALID_ARGUMENT', 400), ('other type, write', 'INVALID_ARGUMENT', 400),
 ('number beyond its type, JSON', 'INVALID_ARGUMENT', 400), ('fraction for a whole number, JSON', 'INVALID_ARGUMENT', 400),
 ('text for a number, JSON', 'INVALID_ARGUMENT', 400), ('number for a text, JSON', 'INVALID_ARGUMENT', 400),
 ('number for a boolean, JSON', 'INVALID_ARGUMENT', 400), ('not JSON', 'INVALID_ARGUMENT', 400)) t(request, code, status)
"""


def http_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that clients call: create, list, schema, write as JSON, fetch with repeated keys and columns, and with no key."""
    e = plain.engine(spark, "paths")
    call = lambda method, path, value=None: transport.handle(e, method, path, {}, b"" if value is None else json.dumps(value).encode())
    base = "/api/v1/table"
    rows = [("create", *call("PUT", f"{base}/t", SCORES.to_json())[::2])]
    body = {"columns": {"id": ["a", "b"], "score": [1.5, None], "small": [-7, None], "flag": [True, None], "label": ["", "é"]}}
    rows.append(("write", *call("PUT", f"{base}/t/write", body)[::2]))
    for name, keys, columns in (("fetch", ["b", "zz", "a", "b"], ["flag", "label", "small"]), ("repeated", ["a"], ["score", "score"]), ("none", [], ["label"])):
        rows.append((name, *call("POST", f"{base}/t/fetch", {"keys": keys, "columns": columns})[::2]))
    rows.append(("list", *call("GET", base)[::2]))
    rows.append(("missing", call("GET", f"{base}/u/schema")[0], b""))
    as_text = lambda b: json.dumps(json.loads(b), sort_keys=True, ensure_ascii=False) if b else ""
    return spark.createDataFrame([(n, s, as_text(b)) for n, s, b in rows], "call string, status int, body string").withColumn("body", F.when(F.col("call").isin("create", "write", "missing"), "").when(F.col("call") == "list", F.get_json_object("body", "$.t.key")).otherwise(F.col("body")))


HTTP_PATHS = """
SELECT * FROM (VALUES ('create', 201::INTEGER, ''), ('write', 200, ''),
 ('fetch', 200, '{"columns": {"flag": [null, null, true, null], "label": ["é", null, "", "é"], "small": [null, null, -7, null]}}'),
 ('repeated', 200, '{"columns": {"score": [1.5]}}'), ('none', 200, '{"columns": {"label": []}}'), ('list', 200, 'id'), ('missing', 404, '')) t(call, status, body)
"""


def automatic_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in seven writes, of which some compact what is there."""
    e = Engine(spark, Config(scratch(spark, "compacting"), compact_at=3))
    e.create_table("orders", plain.ORDERS)
    for part in range(7):
        e.write("orders", plain.orders(spark, sf_dir).where(F.col("key").cast("long") % 7 == part))
    segments = len(e.catalog.entry("orders").segments)
    return e.scan("orders").withColumn("few", F.lit(segments < 7))


COMPACTED = "SELECT o_orderkey::VARCHAR AS key, o_totalprice, o_orderpriority, o_custkey, true AS few FROM orders"


def memory_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event looks up its user in a table that is held in memory."""
    e = Engine(spark, Config(scratch(spark, "memory"), backend="memory"))
    e.create_table("customers", plain.CUSTOMERS)
    x = plain.table(spark, sf_dir, "customer").select(plain.text("c_custkey").alias("key"), F.col("c_acctbal").cast("float").alias("balance"), "c_mktsegment")
    e.write("customers", x.withColumn("balance", -F.col("balance")))
    e.write("customers", x)
    keys = plain.table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), plain.text("user_id").alias("key"))
    return e.fetch("customers", keys, ["balance", "c_mktsegment"], ordered=False)


def arrow_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow type of each of the twelve types, as a table's schema has it."""
    arrow = TableSchema("utf8", {n: ColumnSchema(n, n != "utf8") for n in DTYPES}).arrow()
    return spark.createDataFrame([(f.name, str(f.type), f.nullable) for f in arrow], "dtype string, arrow string, nullable boolean")


ARROW_TYPES = """
SELECT * FROM (VALUES ('int8', 'int8', true), ('int16', 'int16', true), ('int32', 'int32', true), ('int64', 'int64', true),
 ('uint8', 'uint8', true), ('uint16', 'uint16', true), ('uint32', 'uint32', true), ('uint64', 'uint64', true), ('float32', 'float', true),
 ('float64', 'double', true), ('bool', 'bool', true), ('utf8', 'string', false)) t(dtype, arrow, nullable)
"""

_ALL = {
    "rejections": (rejections, REJECTIONS),
    "http_paths": (http_paths, HTTP_PATHS),
    "automatic_compaction": (automatic_compaction, COMPACTED),
    "memory_backend": (memory_backend, plain.FROM_EVENTS),
    "arrow_types": (arrow_types, ARROW_TYPES),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}
