"""Helpers the training-data operators share: the shared folder, staged tables, skew-safe lookups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract of this package has it: code points other than these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A key is heavy when it holds at least one row in HEAVY_SHARE; so there are never more than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000

_OWN: dict[str, str] = {}
#: Folders of staged tables, in the order in which they were made.
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, where all run in one process, one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


#: Rows of a file of a staged table whose rows are few and short.
FILE_ROWS = 100_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it survives lost executors and cuts the lineage.

    ``rows``: how many (short) rows there are at most, if known; then few rows are not spread over many small files.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    if rows is not None and (files := rows // FILE_ROWS + 1) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(files)
    df.write.parquet(path)
    _STAGED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


@contextlib.contextmanager
def released(spark: SparkSession):
    """Staged tables that are made inside are removed on the way out, but for those that the list it gives has then.

    What is kept must be staged itself: it does not depend on the others any more.
    """
    start, keep = len(_STAGED), []
    try:
        yield keep
    finally:
        kept = {df.staged_at for df in keep}
        for path in _STAGED[start:]:
            if path not in kept:
                _remove(spark, path)
        _STAGED[start:] = [p for p in _STAGED[start:] if p in kept]


def give_back() -> None:
    """Memory that this process holds free goes back to the system.

    A Python worker outlives its task: what it keeps stands beside the executor's heap while later stages run.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that no further column of the input can clash with one an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def skew_lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, salt: Column, hint: str | None = None) -> DataFrame:
    """Left join of ``left`` with ``right`` (one row a key; ``count``: rows of ``left`` with that key).

    Keys that hold a thousandth of ``total`` rows or more (a thousand keys at most, whatever the size of the data) are
    broadcast; the other keys meet in a shuffle in which no key is large.  Rows served by the broadcast are spread by
    ``salt`` there.  Columns of ``right`` must not be columns of ``left``, but for ``key``.  ``hint``: how the other keys
    meet, where it should not depend on the size.
    """
    values = [c for c in right.columns if c != key]
    is_heavy = F.col(count) * HEAVY_SHARE >= F.lit(int(total))
    heavy = right.where(is_heavy).select(F.col(key).alias("_hk"), *(F.col(c).alias(f"_h_{c}") for c in values))
    light = right.where(~is_heavy).select(F.col(key).alias("_lk"), F.pmod(F.col(count), F.lit(1)).cast("long").alias("_ls"), *(F.col(c).alias(f"_l_{c}") for c in values))
    light = light.hint(hint) if hint else light
    x = left.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    x = x.withColumn("_s", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(salt).bitwiseOR(F.lit(1).cast("long"))))
    x = x.join(light, (F.col(key) == F.col("_lk")) & (F.col("_s") == F.col("_ls")), "left")
    return x.select(*(F.col(f"`{c}`") for c in left.columns), *(F.coalesce(F.col(f"_h_{c}"), F.col(f"_l_{c}")).alias(c) for c in values))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with these columns computed once a row: an inline() stands between them and whatever uses them, so the
    optimizer can't copy their expressions into each use, nor into lambdas, which would compute them per element."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """These columns of ``df`` and all of them as the struct ``_row``: an operator's own columns can't clash with others."""
    return df.select(*(F.col(f"`{n}`") for n in names), F.struct(*(F.col(f"`{n}`") for n in df.columns)).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``_row``, some of them replaced."""
    return df.select(*(changed.get(n, F.col("_row").getField(n)).alias(n) for n in columns))
