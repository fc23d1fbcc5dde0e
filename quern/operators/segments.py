"""Segments: one write each, resolved to the latest row of a key when read."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import SegmentError, StorageError, TableNotFound
from quern.functions.schema import TableSchema
from quern.sources.catalog import Catalog, Entry
from quern.sources.ingest import POSITION, SOURCE

SEQUENCE = "__seq"
NEWEST = (F.desc, SEQUENCE), (F.desc, SOURCE), (F.desc, POSITION)


def stored(schema: TableSchema) -> T.StructType:
    return T.StructType([*schema.spark().fields, T.StructField(SOURCE, T.StringType()), T.StructField(POSITION, T.LongType()), T.StructField(SEQUENCE, T.LongType())])


def latest(rows: DataFrame, key: str, order: Sequence = ()) -> DataFrame:
    """The newest row of each key, whole.  ``order``: columns from newest to oldest; by default the store's own.

    row_number() = 1 keeps column pruning and reduces each partition to one row a key before the shuffle.
    """
    order = list(order) or [make(name) for make, name in NEWEST]
    n = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def scan(spark: SparkSession, catalog: Catalog, name: str, entry: Entry) -> DataFrame:
    """All rows of the live segments, with their sequence from the folder's name; an empty frame if there are none."""
    schema = stored(entry.schema)
    if not entry.segments:
        return spark.createDataFrame([], schema)
    paths = [catalog.files.path(f"{name}/{SEQUENCE}={n}") for n in entry.segments]
    return spark.read.schema(schema).option("basePath", catalog.files.path(name)).parquet(*paths)


def _write(df: DataFrame, schema: TableSchema, path: str, tasks: int | None) -> None:
    """Files of disjoint key ranges, sorted by key, with Bloom filters as large as their keys need, so that lookups skip
    files, row groups and pages.  Without ``tasks`` the runtime joins ranges to files of its advisory size."""
    key = F.col(f"`{schema.key}`")
    df = df.repartitionByRange(tasks, key) if tasks else df.repartitionByRange(key)
    writer = df.sortWithinPartitions(key, SOURCE, POSITION).write
    writer.option("parquet.bloom.filter.enabled#" + schema.key, "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def _violations(schema: TableSchema) -> dict:
    """Counts of what may not be in a batch, taken while it is written."""
    out = {}
    for i, (name, c) in enumerate(schema.columns.items()):
        col = F.col(f"`{name}`")
        if name == schema.key or not c.nullable:
            out[f"null:{i}"] = F.count(F.when(col.isNull(), 1))
        if c.type.is_wider:
            low, high = (F.lit(str(v)).cast("decimal(20,0)") for v in (c.type.low, c.type.high))
            out[f"range:{i}"] = F.count(F.when((col < low) | (col > high), 1))
    return out


def append(spark: SparkSession, catalog: Catalog, name: str, batch: DataFrame, *, tasks: int | None = None, fence: tuple[str, int] | None = None) -> int | None:
    """Writes ``batch`` (see ingest) as the newest segment and returns its number.  Checks ride on the write.

    ``fence``: a stream and the number of its batch; one that is in the table already is not written again (None).
    """
    entry = catalog.entry(name)
    known = lambda e: fence is not None and e.streams.get(fence[0], -1) >= fence[1]
    if known(entry):
        return None
    names = list(entry.schema.columns)
    staging = f"{name}/.staging-{uuid.uuid4().hex}"
    seen = Observation()
    checks = [c.alias(n) for n, c in _violations(entry.schema).items()]
    _write(batch.observe(seen, *checks), entry.schema, catalog.files.path(staging), tasks)
    for what, n in seen.get.items():
        if n:
            catalog.files.delete(staging)
            kind, i = what.split(":")
            raise SegmentError(f"column {names[int(i)]!r} has {n} {'nulls' if kind == 'null' else 'values out of range'}")
    with catalog.change() as tables:
        if name not in tables or known(tables[name]):
            catalog.files.delete(staging)
            if name not in tables:
                raise TableNotFound(f"no table {name!r}")
            return None
        entry = tables[name]
        n, entry.next = entry.next, entry.next + 2
        _settle(catalog, name, staging, n)
        entry.segments.append(n)
        if fence:
            entry.streams[fence[0]] = fence[1]
    return n


def _settle(catalog: Catalog, name: str, staging: str, n: int) -> None:
    """Makes ``staging`` the folder of segment ``n``.  One that is there already is of a change that was never saved."""
    catalog.files.delete(f"{name}/{SEQUENCE}={n}")
    if not catalog.files.rename(staging, f"{name}/{SEQUENCE}={n}"):
        raise StorageError(f"{staging} can't become segment {n}")


def newest_tier(sizes: Sequence[int]) -> int:
    """Where the newest segments begin that are worth merging: an older one joins if it is at most twice what joined.

    So a row is rewritten about as often as the table's size can be doubled, not with each small write, and as many
    segments stay.
    """
    start, total = len(sizes) - 1, sizes[-1] if sizes else 0
    while start > 0 and sizes[start - 1] <= 2 * total:
        start -= 1
        total += sizes[start]
    return max(start, 0)


def compact(spark: SparkSession, catalog: Catalog, name: str, *, tasks: int | None = None, tiered: bool = False) -> int | None:
    """Rewrites the live segments (``tiered``: the newest of like sizes) as one with the latest rows only; None if that
    is one segment at most.

    Segments that were written meanwhile stay, above the new one.  Old folders stay for readers that still use them,
    until vacuum().
    """
    entry = catalog.entry(name)
    start = newest_tier([catalog.files.size(f"{name}/{SEQUENCE}={n}") for n in entry.segments]) if tiered else 0
    old = entry.segments[start:]
    if len(old) < 2:
        return None
    rows = latest(scan(spark, catalog, name, Entry(entry.schema, old)), entry.schema.key).drop(SEQUENCE)
    staging = f"{name}/.staging-{uuid.uuid4().hex}"
    _write(rows, entry.schema, catalog.files.path(staging), tasks)
    with catalog.change() as tables:
        now = tables.get(name)
        start = now.segments.index(old[0]) if now is not None and old[0] in now.segments else 0
        later = now.segments[start + len(old) :] if now is not None else []
        if now is None or now.segments[start : start + len(old)] != old or (later and old[-1] % 2):
            catalog.files.delete(staging)
            raise StorageError(f"segments of {name!r} changed under its compaction")
        if old[-1] % 2:  # a compacted segment is the newest: a number like that of a write
            n, now.next = now.next, now.next + 2
        else:  # writes have even numbers, so this one is free, above what it replaces and below what is later
            n = old[-1] + 1
        _settle(catalog, name, staging, n)
        now.segments = [*now.segments[:start], n, *later]
    return n


def vacuum(catalog: Catalog, name: str) -> list[str]:
    """Deletes folders of the table that no manifest names.  For quiet times: readers and writers may be using some."""
    live = {f"{SEQUENCE}={n}" for n in catalog.entry(name).segments}
    gone = [x for x in catalog.files.names(name) if x not in live]
    for x in gone:
        catalog.files.delete(f"{name}/{x}")
    return gone
