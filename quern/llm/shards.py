"""Range shards of near-equal bytes by sampled splitters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import only, skew_lookup, staged, table

LONG = "long"


def _long(n: int):
    return F.lit(int(n)).cast(LONG)


def splitters(keys: DataFrame, total: int, ranges: int, per_range: int) -> list[int]:
    """About ``ranges`` key values that cut the bytes into equal parts, from a size-weighted key sample.

    A row enters the sample with probability min(1, k * size / total), decided by a hash of its identity, where
    k = ranges * per_range is the documented sample size (expected; the driver gets ``ranges`` values).  Every row
    that enters stands for total / k bytes, or for its own size where that is more.
    """
    if total <= 0:
        return []
    step = max(1.0, total / (ranges * per_range))
    uniform = F.pmod(F.xxhash64(F.lit("sample"), "h", "d"), _long(1 << 40)) / F.lit(float(1 << 40))
    drawn = keys.where(uniform * F.lit(step) < F.col("size")).select("h", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    drawn = drawn.groupBy("h").agg(F.sum("weight").alias("weight"))
    order = W.orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    cut = F.floor(F.sum("weight").over(order) / F.lit(total / ranges))
    cuts = drawn.select("h", cut.alias("c")).groupBy("c").agg(F.min("h").alias("h")).where(F.col("c") > 0)
    return sorted(r.h for r in cuts.collect())


def range_of(key, cuts: list[int]):
    """The number of cuts at or below ``key``, found through a table of the key's top byte."""
    if not cuts:
        return F.lit(0)
    top = [(c >> 56) + 128 for c in cuts]
    starts = [sum(t < b for t in top) for b in range(257)]
    listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to a literal
    b = (F.shiftright(key, 56) + F.lit(128)).cast("int")
    start = F.get(listed(starts, "int"), b)
    part = F.slice(listed(cuts, "bigint"), start + 1, F.get(listed(starts, "int"), b + 1) - start)
    return start + F.size(F.filter(part, lambda c: c <= key))


def apart(keys: DataFrame) -> DataFrame:
    """``keys`` with another ``d`` for each of the rows that text and doc_id can't tell apart, from their place in the table.

    These rows give the same results in any order, so a rerun gives the same as long as rows differ in text or doc_id.
    """
    x = keys.withColumn("row", F.xxhash64("h", "d"))
    again = x.groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("again", F.lit(True))
    x = skew_lookup(x, staged(again, "shard-repeats"), "row", "rows", keys.count(), F.col("place"))
    x = x.withColumn("d", F.when(F.col("again"), F.xxhash64("d", "place")).otherwise(F.col("d")))
    return staged(x.drop("row", "rows", "again", "place"), "shard-rows")


def sharded(docs: DataFrame, shards: int = 40, *, per_shard: int = 64, per_range: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    Rows are ordered by (hash of the text, hash of the row's identity: its doc_id, and its place where rows have both alike) and cut into ``shards`` runs of near-equal
    bytes, in three steps.  Sampled splitters make ``shards * per_shard`` ranges of the text's hash.  The exact bytes
    of each range are counted, and a range of over twice its share (a large group of equal texts, or an unlucky
    sample) is subdivided by the identity's hash.  Prefix sums over the ranges, then over the rows within each, give
    every row its offset, and the offset its shard.  Equal texts share a shard unless their range was subdivided.
    Slots count rows within the shard in that order.  Only the tables of ranges, whose length the parameters bound,
    are broadcast or sorted as one.
    """
    x = only(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    x = x.select(
        "doc_id",
        (F.octet_length(text) + 16).cast(LONG).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.lit("row"), "doc_id").alias("d"),
        F.monotonically_increasing_id().alias("place"),
    )
    x = apart(staged(x, "shard-keys"))
    total = x.agg(F.sum("size")).first()[0] or 0
    ranges = shards * per_shard
    share = max(1, total // ranges)
    x = x.withColumn("r", range_of(F.col("h"), splitters(x, total, ranges, per_range)))
    sizes = x.groupBy("r").agg(F.sum("size").alias("range_bytes"))
    over = sizes.where(F.col("range_bytes") > 2 * share).select("r", F.ceil(F.col("range_bytes") / F.lit(share)).cast(LONG).alias("parts"))
    x = x.join(F.broadcast(over), "r", "left").withColumn("part", F.coalesce(F.pmod(F.col("d"), F.col("parts")), _long(0)))
    run = W.orderBy("r", "part").rowsBetween(W.unboundedPreceding, -1)
    before = x.groupBy("r", "part").agg(F.sum("size").alias("bytes")).select("r", "part", F.coalesce(F.sum("bytes").over(run), _long(0)).alias("before"))
    x = x.join(F.broadcast(before), ["r", "part"])
    row = W.partitionBy("r", "part").orderBy("h", "d", "doc_id", "size")
    x = x.withColumn("at", F.col("before") + F.sum("size").over(row.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).withColumn("n", F.row_number().over(row))
    group = W.partitionBy("r", "part", "h")
    middle = F.min("at").over(group) + F.sum("size").over(group) / F.lit(2)
    x = x.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(1, total))).cast("int")))
    x = staged(x.select("doc_id", "size", "text_crc32", "r", "part", "shard", "n"), "sharded")
    piece = x.groupBy("shard", "r", "part").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
    first = W.partitionBy("shard").orderBy("r", "part").rowsBetween(W.unboundedPreceding, -1)
    piece = piece.select("shard", "r", "part", "first", F.coalesce(F.sum("rows").over(first), _long(0)).alias("offset"))
    x = x.join(F.broadcast(piece), ["shard", "r", "part"])
    return x.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("n") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, out: str, shards: int = 40) -> DataFrame:
    """Writes the rows of ``docs`` (doc_id unique) under ``out`` in folders shard=0, 1, ...; returns the placement."""
    placed = staged(sharded(docs, shards), "placed")
    (docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out))
    return placed


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts every document into one of 40 shards of near-equal bytes.

    Null text: size 16 and the CRC of no bytes.  Null or repeated doc_ids: each row has a slot of its own (which of two
    rows equal in every column has which slot makes no difference).  Empty table: no rows.  Long texts: a text is
    never cut, so a shard can exceed its share by half of its largest group of equal texts (a range's share at most), or text.
    Further columns are not read.
    """
    x = sharded(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
