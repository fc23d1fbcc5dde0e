"""Mixing sources to target weights: hash-seeded copies of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import HEAVY_SHARE, WORD, only, packed, skew_lookup, staged, table, unpacked

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of a source that are drawn together, about.
GROUP = 10_000


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, docs) with each one's target.

    Sources in order of code points, null last, weigh ``weights``, repeating.  Their targets are the water level times
    the weight, but ``most`` times the source's size at most; the level makes them sum to the total size.  Sources whose
    ratio most * size / weight is least stop first; after the first k of them the level would be (total - what they
    take) / (weight of the others), which rises with k until the next one does not stop and falls from there, so the
    largest is right.  All sums are of whole numbers, so the result does not depend on the order in which they are made.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    x = sources.withColumn("weight", weight.cast("long"))
    x = x.withColumn("cap", F.col("source_size") * most)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("weight"), F.col("cap"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = x.withColumn("left_over", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("level", F.col("left_over") / F.sum("weight").over(onward))
    x = x.withColumn("level", F.max("level").over(everything))
    capped = F.col("level") * F.col("weight") >= F.col("cap")
    return x.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))


def uniform(*parts) -> Column:
    """A whole number below 16 ** 13: the first digits of the MD5 of these texts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` but for text, with size, source_size, target and ``copies``: how often the mix has the row.

    The rate of a source is target / size; a row is copied floor(rate) times and once more with a probability of the
    fraction.  The draws are seeded by hashes, and evenly spread: a source's rows are dealt by the hash of doc_id and
    text into groups of about GROUP, and in each, the rows being ordered by falling size, the row at place k is drawn if
    a whole number lies between u + (k - 1) * fraction and u + k * fraction, where u is the hash of source and group.
    So the drawn rows before any place are as many as expected but for one, and what a group takes differs from its
    expectation by less than its largest row.  A rerun, or any other order, gives the same.
    """
    x = docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    sized = staged(x.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs")), "sources")
    key = F.concat(F.lit("s"), F.coalesce(F.concat(F.lit(":"), "source"), F.lit("")))
    wanted = staged(targets(sized, weights, most).select(key.alias("source_key"), "source_size", "source_docs", "target"), "targets")
    drawn = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    x = x.withColumn("source_key", key).withColumn("drawn", drawn).drop("text")  # no text meets in a shuffle
    n = wanted.limit(HEAVY_SHARE + 1).count()
    if n <= HEAVY_SHARE:  # a table of so few rows at most is broadcast
        x = x.join(F.broadcast(wanted), "source_key", "left")
    else:
        x = skew_lookup(x, wanted, "source_key", "source_docs", sized.agg(F.sum("source_docs")).first()[0], F.col("drawn"))
    x = x.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    x = x.withColumn("dealt", F.pmod("drawn", F.ceil(F.col("source_docs") / F.lit(GROUP)).cast("long")))
    place = F.row_number().over(W.partitionBy("source_key", "dealt").orderBy(F.desc("size"), "drawn"))
    u = uniform(F.lit(seed), "source_key", F.col("dealt").cast("string")) / F.lit(float(16**13))
    passed = lambda k: F.floor(u + k * (F.col("rate") - F.floor("rate")))
    x = x.withColumn("place", place.cast("long"))
    return x.withColumn("copies", (F.floor("rate") + passed(F.col("place")) - passed(F.col("place") - 1)).cast("long"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``docs`` (wordless ones too) as often as it is copied, with the columns of ``docs``."""
    x = copies(packed(docs, "doc_id", "text", "source"), weights, most, seed).where("copies > 0")
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(x, docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document.

    Null or wordless text: size 0, nothing taken.  A null source is a source of its own, the last.  A source of size 0
    has target 0.  A null doc_id counts as an empty one in the hash; of rows alike in doc_id and text, which one is
    drawn makes no difference.  Empty table: no rows.  Texts of any length count whole.  Further columns are not read.
    What a source takes differs from its target by less than its largest document for each GROUP of its documents.
    """
    x = copies(only(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS drawn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3 AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS lv
  FROM w WINDOW r AS (ORDER BY cap / weight, weight, cap, source NULLS LAST)),
v AS (SELECT *, max(lv) OVER () AS level FROM l),
t AS (
  SELECT source, source_size,
         CASE WHEN level * weight >= cap THEN cap::DOUBLE ELSE level * weight END AS target FROM v),
x AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         'mix:s' || coalesce(':' || d.source, '') AS k,
         drawn % ceil((count(*) OVER (PARTITION BY d.source)) / 10000.0)::BIGINT AS dealt
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (
  SELECT *, rate - floor(rate) AS part, row_number() OVER (PARTITION BY source, dealt ORDER BY size DESC, drawn) AS place,
         ('0x' || substr(md5(k || ':' || dealt), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM x)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + floor(u + place * part) - floor(u + (place - 1) * part))::BIGINT AS taken
FROM y
"""
