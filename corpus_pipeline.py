"""From raw documents to token ids: quality rules, near-duplicate removal, secret masking, source mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, jaccard, mixing, quality, secrets
from quern.llm.common import staged, table


# Every stage takes rows as they come: extra columns pass through all stages but the last, whatever their names; null and
# empty texts, ties, repeated rows and empty tables have the results below; texts are never cut.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and wordless texts go, for they have fewer than 50 words.  Repeated rows and rows of null doc_id are
    judged each for itself.  An empty table stays one; without labels only the base rules count.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.

    Rows without words all stay.  Null doc_ids come last.  Of repeated rows one stays, and of rows that tie in doc_id and
    set of shingles the one with the first text.  An empty table stays one.
    """
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes.

    A null text stays null and an empty one empty; repeated rows are masked alike.  An empty table stays one.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, as their sources' target weights ask.

    Null sources are one source, the last.  Null and wordless texts are drawn like others, at their source's rate (never,
    if the source has no words).  Of rows alike in doc_id and text any may be the one drawn.  An empty table stays one.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with their number and digest and the digest of the decoded text.

    A null or empty text has no ids.  Repeated rows, which the mix makes, are encoded each.  An empty table gives no rows.
    """
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_copy),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Hashed n-grams, the randomness battery and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
