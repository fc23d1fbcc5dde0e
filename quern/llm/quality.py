"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio of trusted text against the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import only, packed, pinned, table, unpacked, words

#: Buckets of the hashed n-grams: the model has so many numbers whatever the size of the corpus.
BUCKETS = 1 << 14
#: The trusted-target multinomial is fitted on so many labelled documents at most, those of the smallest hashes.
TRUSTED = 4000
#: Documents stay whose ratio is at least this many thousandths of a nat an n-gram.
THRESHOLD = -400
TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"


def grams(text: Column, buckets: int) -> tuple[Column, Column]:
    """Hashed tokens of a text (40 bits), and from them (pinned as ``tokens``) the buckets of its 1-grams and 2-grams."""
    long = lambda n: F.lit(n).cast("long")
    hashed = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), long(1 << 40)))
    bucket = lambda h: F.pmod(h, long(buckets)).cast("int")
    firsts = F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0)))
    two = F.zip_with(firsts, F.slice("tokens", 2, F.size("tokens")), lambda a, b: bucket(a * long(31) + b))
    return hashed, F.concat(F.transform("tokens", bucket), two)


def with_grams(docs: DataFrame, buckets: int) -> DataFrame:
    hashed, both = grams(F.col("text"), buckets)
    return pinned(pinned(docs, tokens=hashed), grams=both)


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """Ids of at most ``most`` documents all of whose labels are quality 1."""
    x = only(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    return x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("trusted_id"))


def fitted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> list[int]:
    """Thousandths of a nat for each bucket: log(p_target / p_raw), one added to every count.

    p_raw counts the n-grams of all documents; p_target those of the trusted ones.  Counts are whole numbers and meet
    in ``buckets`` rows.  Without trusted text all ratios are 0.
    """
    ids = F.broadcast(trusted_ids(labels, trusted))
    x = docs.join(ids, F.col("doc_id") == F.col("trusted_id"), "left").withColumn("is_trusted", F.col("trusted_id").isNotNull().cast("int"))
    x = with_grams(x.select("text", "is_trusted"), buckets).select(F.explode("grams").alias("bucket"), "is_trusted")
    rows = x.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is_trusted").alias("target")).collect()  # at most ``buckets``
    raw_all, target_all = sum(r.raw for r in rows), sum(r.target for r in rows)
    from math import log

    out = [0] * buckets
    if target_all:
        base = log((raw_all + buckets) / (target_all + buckets))
        for r in rows:
            out[r.bucket] = round(1000 * (log((r.target + 1) / (r.raw + 1)) + base))
    return out


def n_repeat_words(hashes: str) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes (a pinned column).

    Equal neighbours among the sorted (hash, place) pairs give the places of repeated windows; each covers the words
    from its place up to the next such place, three at most.  A text without repeats is settled by counting.
    """
    h = F.col(hashes)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, e, k: F.coalesce(F.get(s, k).h == e.h, F.lit(False))
    twice = lambda s: F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1))
    places = F.transform(F.array(pairs), lambda s: F.sort_array(F.transform(twice(s), lambda e: e.i)))
    gaps = F.transform(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - a, F.lit(3)))), F.lit(0), lambda a, g: a + g))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.get(gaps, F.lit(0)))


def judged(docs: DataFrame, labels: DataFrame, *, threshold: int = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with the statistics, ratio (thousandths of a nat), n_grams and kept."""
    ratios = ",".join(map(str, fitted(only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))), labels, buckets, trusted)))
    model = F.split(F.lit(ratios), ",").cast("array<int>")  # of literals: folded once
    x = docs.withColumn("text", F.coalesce("text", F.lit("")))
    x = pinned(x, w=words(F.col("text")), lines=F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    three = F.transform("w", lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2)))
    x = pinned(
        x,
        n_words=F.size("w").cast("long"),
        word_chars=F.length(F.array_join("w", "")).cast("long"),
        n_symbols=F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        windows=F.slice(three, 1, F.greatest(F.size("w") - 2, F.lit(0))),
    ).drop("w", "lines")
    x = pinned(x, n_repeat_words=n_repeat_words("windows").cast("long")).drop("windows")
    x = with_grams(x, buckets)
    x = pinned(x, n_grams=F.size("grams").cast("long"), ratio=F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(model, g))).drop("tokens", "grams")
    x = x.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= F.col("n_grams") * threshold))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are."""
    return unpacked(judged(packed(docs, "doc_id", "text"), labels).where("kept"), docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document.

    Null or empty text: no words, so base_failed.  Null or repeated doc_ids: a row for each row; the trusted text has
    each row of a trusted doc_id.  A doc_id with different labels is not trusted.  No labels: the ratio is 0 and only
    the base rules count.  Windows are compared by 64-bit hashes.  Empty table: no rows.  Texts of any length count
    whole; further columns are not read.
    """
    x = judged(only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_grams")
