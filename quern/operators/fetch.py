"""Ordered multi-get with projection: one output row for each requested key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ArrowError, SegmentError
from quern.functions.schema import TableSchema

#: So many keys are sent as literals, which reach the Parquet scan; more go through a join.
LITERALS = 10_000
ORD, KEY = "__ord", "__key"


def check_columns(schema: TableSchema, columns: Sequence[str]) -> None:
    if not columns:
        raise ArrowError("no columns are asked for")
    for c in columns:
        if c == schema.key or c not in schema.columns:
            raise SegmentError(f"no column {c!r} can be fetched")


def keys_frame(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(ORD, T.LongType(), False), T.StructField(KEY, T.StringType())])
    return spark.createDataFrame(list(enumerate(keys)), schema)


def fetch_rows(rows: DataFrame, resolve: Callable[[DataFrame], DataFrame], key: str, wanted: DataFrame, literals: Sequence[str] | None = None) -> DataFrame:
    """``wanted`` (with KEY) LEFT JOIN the latest row of each key.

    The rows are cut down to the wanted keys before versions are resolved, because no optimizer rule moves a join below a
    window.  A short list becomes an IN predicate, which the Parquet reader takes; otherwise a semi join against
    the distinct keys.  Which side is broadcast, if any, and how skewed keys are split, is left to the runtime's
    measured sizes.
    """
    if literals is not None:
        cut = rows.where(F.col(f"`{key}`").isin(list(set(literals))))
    else:
        only = wanted.select(F.col(KEY).alias("__wanted")).where("__wanted is not null").distinct()
        cut = rows.join(only, F.col(f"`{key}`") == F.col("__wanted"), "left_semi")
    live = resolve(cut)
    return wanted.join(live, F.col(KEY) == F.col(f"`{key}`"), "left")


def fetch(spark: SparkSession, rows: DataFrame, resolve, schema: TableSchema, keys: Sequence[str] | DataFrame, columns: Sequence[str], *, with_key: bool = False, with_found: bool = False, ordered: bool = True) -> DataFrame:
    """The requested columns, in the requested order (repeats allowed), a row for each key in order; nulls for a miss.

    ``keys``: a list, or a DataFrame with columns ord (any order) and key.  ``with_key``, ``with_found``: further columns.
    ``ordered``: without it, rows come as they are found, which spares a sort of the whole result (ord tells their order).
    """
    check_columns(schema, columns)
    if isinstance(keys, DataFrame):
        wanted, literals = keys.select(F.col("ord").alias(ORD), F.col("key").cast("string").alias(KEY)), None
    else:
        for k in keys:
            if not isinstance(k, str):
                raise SegmentError(f"{k!r} is no key")
        wanted, literals = keys_frame(spark, keys), list(keys) if len(keys) <= LITERALS else None
    used = list(dict.fromkeys(columns))
    out = fetch_rows(rows, resolve, schema.key, wanted, literals)
    out = out.orderBy(ORD) if ordered else out
    picked = [F.col(ORD).alias("ord")] if isinstance(keys, DataFrame) else []
    picked += [F.col(KEY).alias(schema.key)] if with_key else []
    picked += [F.col(f"`{schema.key}`").isNotNull().alias("_found")] if with_found else []
    assert set(used) <= set(schema.columns)
    return out.select(*picked, *(F.col(f"`{c}`") for c in columns))
