from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
#: Names that operators use for columns of their own.
CLASHING = ("size", "n", "key", "class", "shard", "slot", "text_crc32", "hex", "runs", "kept", "host", "digest", "rank", "score", "copies", "source_key", "w", "tokens", "h", "d", "x", "i", "seg", "a", "b", "formatted", "root", "target")


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables as a folder of Parquet files; ``clash`` adds columns with the operators' own names."""

    def write(clash: bool = False, **rows) -> str:
        from pyspark.sql import functions as F

        for name, schema in SCHEMAS.items():
            df = spark.createDataFrame(rows.get(name, []), schema)
            for extra in CLASHING if clash else ():
                if extra not in df.columns:
                    df = df.withColumn(extra, F.lit("other"))
            df.coalesce(2).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    """The documents of the smallest data."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
