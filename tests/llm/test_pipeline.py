import hashlib

import brute
import public_tokenizers
import tiktoken

import corpus_pipeline
from quern.llm import bpe


def expected(docs, labels):
    """The pipeline, plainly.  docs: (doc_id, text, source)."""
    quality = {}
    for i, q in labels:
        quality.setdefault(i, []).append(q or 0)
    trusted = {i for i, q in quality.items() if min(q) == 1}
    docs = [d for d, k in zip(docs, brute.kept([d[:2] for d in docs], trusted)) if k]
    docs = [d for d, c in zip(docs, brute.components([d[:2] for d in docs])) if d[0] == c]
    docs = [(i, brute.masked(t), s) for i, t, s in docs]
    docs = [d for d, (*_, c) in zip(docs, brute.mix(docs)) for _ in range(c)]
    ranks = bpe.coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t, _ in docs:
        ids = encoding.encode_ordinary(t)
        yield i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()


def test_pipeline(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(expected(docs, labels)) and len(got) > 50


def test_empty_and_extra_columns(spark, tables):
    for clash in (False, True):
        d = tables(clash)
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns and out.count() == 0
        assert corpus_pipeline.run(spark, d).count() == 0


def test_rows_pass_whole(spark, tables):
    """Null texts, repeated rows and extra columns through each stage alone."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 7), (1, text, "en", "s", 7), (2, text + " more", None, None, None), (None, None, "en", "s", 0), (3, "", "en", "t", 0)]
    d = tables(True, documents=rows, labels=[(1, 1, 0)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = lambda stage: sorted((r.doc_id for r in dict(corpus_pipeline.STAGES)[stage](spark, docs, d).collect()), key=repr)
    assert ids("quality") == [1, 1, 2]
    assert ids("near_duplicates") == [1, 3, None]
    assert ids("secrets") == [1, 1, 2, 3, None]
    copies = brute.mix([(r[0], r[1], r[3]) for r in rows])
    assert ids("mixing") == sorted((r[0] for r, (*_, c) in zip(rows, copies) for _ in range(c)), key=repr)
    assert len(ids("bpe")) == 5


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "bpe"]
