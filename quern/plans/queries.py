"""The registered queries of the engine, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import ColumnSchema, Config, Engine, TableSchema
from quern.functions.dtypes import DTYPES
from quern.operators.fetch import KEY, ORD, fetch_rows
from quern.operators.segments import latest
from quern.sources import egress, ingest
from quern.sources.scratch import scratch
from quern.streaming.upsert import upsert_stream

ORDERS = TableSchema("key", {"key": ColumnSchema("utf8", False), "o_totalprice": ColumnSchema("float64"), "o_orderpriority": ColumnSchema("utf8"), "o_custkey": ColumnSchema("int64")})
CUSTOMERS = TableSchema("key", {"key": ColumnSchema("utf8", False), "balance": ColumnSchema("float32"), "c_mktsegment": ColumnSchema("utf8")})
EVENTS = TableSchema("key", {"key": ColumnSchema("utf8", False), "event_type": ColumnSchema("utf8"), "value": ColumnSchema("float64")})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(name: str) -> Column:
    return F.col(name).cast("string")


def engine(spark: SparkSession, name: str) -> Engine:
    return Engine(spark, Config(scratch(spark, name), compact_at=0))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(text("o_orderkey").alias("key"), "o_totalprice", "o_orderpriority", "o_custkey")


def with_orders(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, "orders")
    e.create_table("orders", ORDERS)
    e.write("orders", orders(spark, sf_dir))
    return e


def numbered(keys: list[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(keys)), "ord long, key string")


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat or are not there."""
    keys = ["1", "7", "nope", "7", "12"]
    return with_orders(spark, sf_dir).fetch("orders", numbered(keys, spark), ["o_totalprice", "o_orderpriority"], with_key=True)


MULTI_GET = """
WITH k(ord, key) AS (VALUES (0::BIGINT, '1'), (1, '7'), (2, 'nope'), (3, '7'), (4, '12'))
SELECT ord, key, o_totalprice, o_orderpriority FROM k LEFT JOIN orders ON key = o_orderkey::VARCHAR
"""


def missing_keys_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.range(200).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, text("id")).otherwise(F.concat(F.lit("x"), "id")).alias("key"))
    return with_orders(spark, sf_dir).fetch("orders", keys, ["o_custkey"], with_key=True, with_found=True)


MISSING = """
SELECT r.range AS ord, CASE WHEN r.range % 2 = 0 THEN r.range::VARCHAR ELSE 'x' || r.range END AS key,
       o_orderkey IS NOT NULL AS _found, o_custkey
FROM range(200) r LEFT JOIN orders ON r.range % 2 = 0 AND o_orderkey = r.range
"""


def multi_get_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame of keys: every event looks up its user."""
    e = engine(spark, "customers")
    e.create_table("customers", CUSTOMERS)
    e.write("customers", table(spark, sf_dir, "customer").select(text("c_custkey").alias("key"), F.col("c_acctbal").cast("float").alias("balance"), "c_mktsegment"))
    keys = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), text("user_id").alias("key"))
    return e.fetch("customers", keys, ["balance", "c_mktsegment"])


FROM_EVENTS = """
SELECT event_id AS ord, c_acctbal::FLOAT AS balance, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey
"""


def projection_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_orders(spark, sf_dir).fetch("orders", numbered([str(i) for i in range(0, 400, 3)], spark), ["o_custkey", "o_orderpriority", "o_totalprice"])


PROJECTION = """
SELECT (row_number() OVER (ORDER BY r.range) - 1)::BIGINT AS ord, o_custkey, o_orderpriority, o_totalprice
FROM range(0, 400, 3) r LEFT JOIN orders ON o_orderkey = r.range
"""


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write wins, the order being time, then id."""
    x = table(spark, sf_dir, "events").select(text("user_id").alias("key"), "event_id", "ts", "event_type", "value")
    return latest(x, "key", [F.desc("ts"), F.desc("event_id")]).select("key", "event_id", "event_type", "value")


LATEST = """
SELECT user_id::VARCHAR AS key, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
"""


def _versions(spark: SparkSession, sf_dir: str) -> Engine:
    """Events as three writes, with nulls that replace values."""
    e = engine(spark, "events")
    e.create_table("events", EVENTS)
    x = table(spark, sf_dir, "events").select(text("user_id").alias("key"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_id")
    for part in range(3):
        e.write("events", x.where(F.col("event_id") % 3 == part), position=F.col("event_id"))
    return e


VERSIONS = """
SELECT user_id::VARCHAR AS key, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
       CASE WHEN event_id % 7 <> 0 THEN value END AS value
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1
"""


def upsert_null_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).scan("events")


def compact_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _versions(spark, sf_dir)
    e.compact("events")
    return e.scan("events")


def accumulate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "orders")
    e.create_table("orders", ORDERS)
    for part in range(2):
        e.write("orders", orders(spark, sf_dir).where(F.col("key").cast("long") % 2 == part))
    return e.fetch("orders", numbered([str(i) for i in range(100)], spark), ["o_totalprice", "o_custkey"])


ACCUMULATE = """
SELECT r.range AS ord, o_totalprice, o_custkey FROM range(100) r LEFT JOIN orders ON o_orderkey = r.range
"""


def dup_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "events")
    e.create_table("events", EVENTS)
    e.write("events", table(spark, sf_dir, "events").select(text("user_id").alias("key"), "event_type", "value", "event_id"), position=F.col("event_id"))
    return e.scan("events")


DUP = """
SELECT user_id::VARCHAR AS key, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
"""


def empty_table_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "empty")
    e.create_table("orders", ORDERS)
    return e.fetch("orders", numbered(["a", "b"], spark), ["o_totalprice", "o_orderpriority"])


EMPTY = "SELECT r.range AS ord, NULL::DOUBLE AS o_totalprice, NULL::VARCHAR AS o_orderpriority FROM range(2) r"


def reopen_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = with_orders(spark, sf_dir)
    return Engine(spark, first.config).scan("orders")


ALL_ORDERS = "SELECT o_orderkey::VARCHAR AS key, o_totalprice, o_orderpriority, o_custkey FROM orders"


def parquet_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that executors read; the table's columns are those of the file, the key among them."""
    schema = TableSchema("p_name", {"p_name": ColumnSchema("utf8"), "p_size": ColumnSchema("int32"), "p_retailprice": ColumnSchema("float64"), "p_partkey": ColumnSchema("int64")})
    e = engine(spark, "part")
    e.create_table("part", schema)
    e.write_parquet("part", f"{sf_dir}/part.parquet")
    return e.scan("part").groupBy("p_name").agg(F.count("*").alias("n"))


PARQUET = "SELECT DISTINCT p_name, 1::BIGINT AS n FROM part"


def dtype_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve types, through a write and a scan.  A part's key may need more than 16 bits: u16 has the low ones, above the others."""
    types = {"u8": "uint8", "u16": "uint16", "above": "int64", "u32": "uint32", "u64": "uint64", "i8": "int8", "i16": "int16", "i32": "int32", "i64": "int64", "f32": "float32", "f64": "float64", "b": "bool", "s": "utf8"}
    values = {"u8": F.col("l_linenumber"), "u16": F.col("l_partkey").bitwiseAND(0xFFFF), "above": F.shiftright("l_partkey", 16), "u32": F.col("l_orderkey"), "u64": F.col("l_orderkey"), "i8": -F.col("l_linenumber"), "i16": -F.col("l_linenumber"), "i32": -F.col("l_orderkey"), "i64": -F.col("l_orderkey"), "f32": F.col("l_discount"), "f64": F.col("l_extendedprice"), "b": F.col("l_returnflag") == "R", "s": F.col("l_linestatus")}
    e = engine(spark, "lines")
    e.create_table("lines", TableSchema("key", {"key": ColumnSchema("utf8")} | {n: ColumnSchema(t) for n, t in types.items()}))
    x = table(spark, sf_dir, "lineitem")
    e.write("lines", x.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus").alias("key"), *(v.cast(DTYPES[types[n]].spark).alias(n) for n, v in values.items())))
    return e.scan("lines").drop("key").groupBy("s", "b", "u8").agg(F.count("*").alias("n"), F.sum(F.col("above") * 65536 + F.col("u16")).alias("u16"), F.sum("u32").alias("u32"), F.max("u64").cast("long").alias("u64"), F.min("i8").alias("i8"), F.min("i16").alias("i16"), F.min("i32").alias("i32"), F.sum("i64").alias("i64"), F.max("f32").alias("f32"), F.max("f64").alias("f64"))


MATRIX = """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_discount, l_extendedprice, l_returnflag, l_linestatus FROM lineitem)
SELECT l_linestatus AS s, l_returnflag = 'R' AS b, l_linenumber::SMALLINT AS u8, count(*) AS n, sum(l_partkey)::BIGINT AS u16,
       sum(l_orderkey)::BIGINT AS u32, max(l_orderkey) AS u64, min(-l_linenumber)::TINYINT AS i8, min(-l_linenumber)::SMALLINT AS i16,
       min(-l_orderkey)::INTEGER AS i32, sum(-l_orderkey)::BIGINT AS i64, max(l_discount::FLOAT) AS f32, max(l_extendedprice) AS f64
FROM d GROUP BY ALL
"""


def sparse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document looks up its label; most have none."""
    e = engine(spark, "labels")
    e.create_table("labels", TableSchema("key", {"key": ColumnSchema("utf8"), "quality": ColumnSchema("int32"), "toxic": ColumnSchema("int32")}))
    e.write("labels", table(spark, sf_dir, "labels").select(text("doc_id").alias("key"), "quality", "toxic"))
    return e.fetch("labels", table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), text("doc_id").alias("key")), ["quality", "toxic"])


SPARSE = "SELECT d.doc_id AS ord, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def array_rows(spark: SparkSession, sf_dir: str, ids: DataFrame) -> DataFrame:
    """The embeddings of ``ids`` (id), in that order, nulls for what is missing."""
    rows = table(spark, sf_dir, "embeddings").select(text("vec_id").alias("key"), "embedding", "vec_id")
    wanted = ids.select(F.col("id").alias(ORD), text("id").alias(KEY))
    out = fetch_rows(rows, lambda cut: latest(cut, "key", [F.desc("vec_id")]), "key", wanted)
    return out.select(F.col(ORD).alias("ord"), F.size("embedding").alias("n"), F.element_at("embedding", 1).alias("first"))


def array_fetch_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: values of a list type, through the same plan over any DataFrame."""
    return array_rows(spark, sf_dir, spark.range(0, 600, 7))


ARRAYS = """
SELECT r.range AS ord, coalesce(len(embedding), NULL)::INTEGER AS n, embedding[1] AS first FROM range(0, 600, 7) r LEFT JOIN embeddings ON vec_id = r.range
"""


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Nations written from one format, read as another, and that written again."""
    schema = TableSchema("n_name", {"n_name": ColumnSchema("utf8", False), "n_nationkey": ColumnSchema("int32"), "n_regionkey": ColumnSchema("int32")})
    e = engine(spark, "nation")
    for name in ("first", "second"):
        e.create_table(name, schema)
    source = table(spark, sf_dir, "nation").select(*schema.columns).toArrow()  # 25 rows
    names = source.column("n_name").to_pylist()
    e.write("first", source.cast(schema.arrow()))
    mime, body = e.read_body("first", ingest.ARROW_MIME if kind == "ipc" else None, names, ["n_nationkey", "n_regionkey"])
    if kind == "ipc":
        got = ingest.ipc_table(body).append_column("n_name", [names])
        e.write_body("second", mime, egress.to_ipc(got))
    else:
        import json

        columns = json.loads(body)["columns"]
        e.write_body("second", mime, json.dumps({"columns": columns | {"n_name": names}}).encode())
    return e.scan("second")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "json")


def ipc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "ipc")


NATIONS = "SELECT n_name, n_nationkey, n_regionkey FROM nation"


def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "catalog")
    e.create_table("customers", CUSTOMERS)
    e.create_table("events", EVENTS)
    return e.tables()


TABLES = """
SELECT * FROM (VALUES
 ('customers', 'key', 0::INTEGER, 'utf8', false, true), ('customers', 'balance', 1, 'float32', true, false),
 ('customers', 'c_mktsegment', 2, 'utf8', true, false), ('events', 'key', 0, 'utf8', false, true),
 ('events', 'event_type', 1, 'utf8', true, false), ('events', 'value', 2, 'float64', true, false))
 t(table_name, column_name, ordinal, dtype, nullable, is_key)
"""


def get_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_orders(spark, sf_dir)
    s = e.get_schema("orders")
    return spark.createDataFrame([(n, c.dtype, n == s.key) for n, c in s.columns.items()], "column_name string, dtype string, is_key boolean")


SCHEMA = """
SELECT * FROM (VALUES ('key', 'utf8', true), ('o_totalprice', 'float64', false), ('o_orderpriority', 'utf8', false),
 ('o_custkey', 'int64', false)) t(column_name, dtype, is_key)
"""


def stream_upsert_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the same upserts from a stream."""
    e = engine(spark, "stream")
    e.create_table("events", EVENTS)
    folder = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(folder).schema
    parent, name = folder.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{parent}/{name}*")
    stream = stream.select(text("user_id").alias("key"), "event_type", "value", "event_id")
    upsert_stream(e, "events", stream, scratch(spark, "stream-checkpoint"), position="event_id", available_now=True).awaitTermination()
    return e.scan("events")


_ALL = {
    "multi_get": (multi_get, MULTI_GET),
    "missing_keys_null": (missing_keys_null, MISSING),
    "multi_get_from_events": (multi_get_from_events, FROM_EVENTS),
    "projection_order": (projection_order, PROJECTION),
    "latest_per_key": (latest_per_key, LATEST),
    "upsert_null_overwrites": (upsert_null_overwrites, VERSIONS),
    "compact_equivalence": (compact_equivalence, VERSIONS),
    "accumulate_segments": (accumulate_segments, ACCUMULATE),
    "dup_in_batch": (dup_in_batch, DUP),
    "empty_table_fetch": (empty_table_fetch, EMPTY),
    "reopen_persisted": (reopen_persisted, ALL_ORDERS),
    "parquet_ingest": (parquet_ingest, PARQUET),
    "dtype_matrix": (dtype_matrix, MATRIX),
    "sparse_labels": (sparse_labels, SPARSE),
    "array_fetch_ext": (array_fetch_ext, ARRAYS),
    "json_roundtrip": (json_roundtrip, NATIONS),
    "ipc_roundtrip": (ipc_roundtrip, NATIONS),
    "list_tables": (list_tables, TABLES),
    "get_schema": (get_schema, SCHEMA),
    "stream_upsert_ext": (stream_upsert_ext, DUP),
}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items()}
