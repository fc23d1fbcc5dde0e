"""Exact top-k inner products: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz residual bounds."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import only, staged, table

HIT = "query_id long, query_hash long, vec_id long, score long"
#: Rows with the smallest hashes that the rotation is fitted on.  Any rotation gives the same results.
FITTED = 2048
BLOCK, QUERY_BLOCK, FIRST, STEP, LEAST = 4096, 1024, 64, 512, 128
#: Ranges of length, and of the queries' needs, at most; quarters of the rotated dimensions after which products are pruned.
RANGES, STAGES = 1024, (1, 2, 3)
LIMIT = 2**63 - 1


def usable(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, x (floor(scale * component) as double) of the rows whose vector takes part."""
    x = only(vectors, "vec_id", "embedding").where("embedding is not null")
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    raised = F.transform("embedding", lambda e: e.cast("double") * scale)
    # floor() of a double is a long; beyond 2^52 a double has no fraction
    return x.where(finite).select("vec_id", F.transform(raised, lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)).alias("x"))


def rotation(vectors: DataFrame) -> np.ndarray | None:
    """Right singular vectors of a bounded sample's commonest length, most energy first."""
    rows = [r.x for r in vectors.orderBy(F.xxhash64("vec_id", "x")).limit(FITTED).collect()]
    lengths = [len(r) for r in rows if r]
    if not lengths:
        return None
    d = max(set(lengths), key=lengths.count)
    a = np.array([r for r in rows if len(r) == d])
    a = a / max(1.0, np.abs(a).max())
    return np.linalg.svd(a, full_matrices=True)[2].T


def best(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, turn: np.ndarray | None, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of each query's k best in one block, by (score descending, id ascending).

    Ids are whole numbers with null as the largest; ``own`` is a query's id, or -1 less than any, where it has none.
    Scores below ``floors``, the k-th best that other blocks gave, are of no interest.  ``seen`` counts all products and
    those computed in full.

    Vectors come by descending length.  After each of the STAGES of the rotated dimensions a product is at most the sum so
    far plus the product of the two vectors' residual lengths; what cannot reach a query's k-th best goes no further.
    """
    none = np.array([], dtype=np.int64)
    if not len(x) or not len(queries):
        return none, none, none
    d = x.shape[1]
    exact = d * float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2.0**53
    norm = np.sqrt((x * x).sum(1))
    order = np.lexsort((ids, -norm))
    x, ids, norm = x[order], ids[order], norm[order]
    q_norm = np.sqrt((queries * queries).sum(1))
    slack = lambda a: 1e-9 * a + 1e-6  # noqa: E731  over any rounding of the float sums
    stages = sorted({max(1, d * i // 4) for i in STAGES}) if d and exact else []
    turn = turn if turn is not None and len(turn) == d else np.eye(d)
    rest = lambda v, n, h: np.sqrt(np.maximum(0, n**2 - (v[:, :h] * v[:, :h]).sum(1))) + slack(n)
    xr, qr = (x @ turn, queries @ turn) if stages else (x, queries)
    x_rest, q_rest = ([rest(v, n, h) for h in stages] for v, n in ((xr, norm), (qr, q_norm)))
    floor_ = floors.astype(float).copy()
    qi, vi, sc = none, none, none
    a, step = 0, FIRST
    while a < len(x):
        b = slice(a, a + step)
        live = np.flatnonzero(q_norm * norm[a] * (1 + 1e-9) + 1e-6 >= floor_)
        if not len(live):
            break  # the vectors to come are shorter still
        cols = np.arange(a, min(a + step, len(x)))
        if seen is not None:
            seen["all"] = seen.get("all", 0) + len(queries) * len(cols)
        hit = own[live, None] != ids[cols][None]
        sums, start = np.zeros(hit.shape), 0
        for h, of_x, of_q in zip(stages, x_rest, q_rest, strict=True):
            sums += qr[live, start:h] @ xr[cols, start:h].T
            hit &= sums + of_q[live, None] * of_x[cols][None] + slack(q_norm[live])[:, None] * norm[a] >= floor_[live, None]
            i, j = hit.any(1), hit.any(0)
            live, cols, start = live[i], cols[j], h
            hit, sums = hit[i][:, j], sums[i][:, j]
        a, step = b.stop, STEP
        if not hit.size:
            continue
        i, j = np.nonzero(hit)
        if seen is not None:
            seen["full"] = seen.get("full", 0) + len(i)
        if exact:
            s = np.rint(queries[live] @ x[cols].T)
            near = s[i, j] >= floor_[live[i]]
            i, j = i[near], j[near]
            s = s[i, j].astype(np.int64)
        else:  # beyond doubles: whole numbers of any length, held within 64 bits at the end
            whole = lambda v: [int(c) for c in v]
            qs, xs = [whole(v) for v in queries[live]], [whole(v) for v in x[cols]]
            s = np.array([max(-LIMIT, min(LIMIT, sum(p * r for p, r in zip(qs[m], xs[n], strict=True)))) for m, n in zip(i, j, strict=True)], dtype=np.int64)
        qi, vi, sc = np.concatenate([qi, live[i]]), np.concatenate([vi, ids[cols[j]]]), np.concatenate([sc, s])
        o = np.lexsort((vi, ~sc, qi))  # ~s falls as s rises, without overflow
        qi, vi, sc = qi[o], vi[o], sc[o]
        begin = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else none
        place = np.arange(len(qi)) - np.repeat(begin, np.diff(np.r_[begin, len(qi)]))
        qi, vi, sc, place = qi[place < k], vi[place < k], sc[place < k], place[place < k]
        full = place == k - 1
        floor_[qi[full]] = np.maximum(floor_[qi[full]], sc[full])
    return qi, vi, sc


def met(candidates: DataFrame, queries: DataFrame, k: int, turn: np.ndarray | None) -> DataFrame:
    """The hits of each group of ``candidates`` (vec_id, x, at, q_block) with that of ``queries`` (query_id, query_hash, floor, x, at, q_block)."""
    null = np.int64(LIMIT)

    def run(_key, cands: pa.Table, asks: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        xs, qs = cands.column("x").combine_chunks(), asks.column("x").combine_chunks()
        ids = cands.column("vec_id").fill_null(LIMIT).to_numpy()
        q_ids, q_hash, floors = (asks.column(c).to_numpy() for c in ("query_id", "query_hash", "floor"))
        x_len, q_len = (np.asarray(v.value_lengths().to_numpy(zero_copy_only=False)) for v in (xs, qs))
        for d in np.unique(q_len) if len(q_len) and len(x_len) else []:
            a, b = np.flatnonzero(x_len == d), np.flatnonzero(q_len == d)
            if not len(a):
                continue
            grid = lambda v, at: v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(d))
            i, v, s = best(grid(qs, b), q_ids[b], floors[b], grid(xs, a), ids[a], k, turn)
            for into, part in zip(found, (q_ids[b][i], q_hash[b][i], v, s), strict=True):
                into.append(part)
        qi, qh, vi, sc = (np.concatenate(c).astype(np.int64) if c else np.array([], np.int64) for c in found)
        return pa.table({"query_id": qi, "query_hash": qh, "vec_id": pa.array(vi, mask=vi == null), "score": sc})

    return candidates.groupBy("q_block", "at").cogroup(queries.groupBy("q_block", "at")).applyInArrow(run, HIT)


def cuts(x: DataFrame, column: str, parts: int) -> list[float]:
    """Descending values that part ``column`` into about ``parts`` ranges of like numbers of rows; ``parts`` of them at most."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    return sorted(set(x.agg(F.percentile_approx(column, at, 100 * parts)).first()[0] or ()), reverse=True)


def above(column: str, cuts: list[float]) -> Column:
    """How many of ``cuts`` are above a value."""
    listed = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")  # of literals: folded once
    return F.size(F.filter(listed, lambda c: c > F.col(column))) if cuts else F.lit(0)


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows whose id is divisible by ``every``, the k best of all other rows.

    Candidates are parted into ranges of descending length (RANGES at most; a range of more than BLOCK vectors, many of
    one length say, is dealt into blocks).  First all queries meet the block of the longest vectors; the k-th best score
    there is a query's floor from then on.  By the ratio of floor and own length, which says how long a vector must be,
    queries are parted into blocks of like needs, and a range meets only those blocks of which it can still matter to
    one query: the other pairs of blocks are dropped before anything is shuffled.  In a pair of blocks vectors come by
    descending length, and partial sums of the rotated dimensions with residual bounds prune products; what is left is
    computed in full.  The k best of every block meet per query.  Only bounds of ranges and blocks reach the driver.
    """
    spark = vectors.sparkSession
    x = usable(vectors, scale)
    x = staged(x.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))), "vectors")
    turn = rotation(x)
    q = x.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("query_hash"), "x", "norm").dropDuplicates(["query_id", "query_hash"])
    q = staged(q, "queries")
    n, m = x.count(), q.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, ceil(n / BLOCK), min(parallel, ceil(n / LEAST)))
    x = x.withColumn("range", above("norm", cuts(x, "norm", min(RANGES, blocks))))
    ranges = {r["range"]: (r.n, r.longest) for r in x.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()}
    held = max(1, ceil(n / blocks))
    parts = [max(1, ceil(ranges.get(r, (0, 0))[0] / held)) for r in range(max(ranges, default=0) + 1)]
    deal = lambda c, *h: F.pmod(F.xxhash64(F.lit("block"), *h), c).cast("int")
    listed = lambda values: F.array(*map(F.lit, values))
    x = x.withColumn("at", F.struct("range", deal(F.get(listed(parts), F.col("range")), "vec_id").alias("part")))
    first = (F.col("at.range") == 0) & (F.col("at.part") == 0)
    every_one = lambda c: F.explode(F.sequence(F.lit(0), c - 1))

    q_blocks = max(1, ceil(m / QUERY_BLOCK), min(parallel, ceil(m / LEAST)))
    asks = q.withColumn("q_block", deal(F.lit(q_blocks), "query_id")).withColumn("floor", F.lit(float("-inf")))
    asks = asks.withColumn("at", F.struct(F.lit(0).alias("range"), F.lit(0).alias("part")))
    known = staged(met(x.where(first).select("vec_id", "x", "at", every_one(F.lit(q_blocks)).alias("q_block")), asks.select("query_id", "query_hash", "floor", "x", "at", "q_block"), k, turn), "first-hits")
    floors = known.groupBy("query_id", "query_hash").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= k)
    q = q.join(floors.drop("n"), ["query_id", "query_hash"], "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf")))).drop("least")
    # the length below which no vector matters to the query
    needs = F.when(F.col("floor") <= 0, F.lit(0.0)).when(F.col("norm") <= 0, F.lit(float("inf"))).otherwise((F.col("floor") - 1e-6) / (F.col("norm") * (1 + 1e-9)))
    q = staged(q.withColumn("needs", needs), "floors")

    blocked = q.withColumn("q_block", above("needs", cuts(q, "needs", min(RANGES, q_blocks))))
    of = {r.q_block: (r.n, r.least) for r in blocked.groupBy("q_block").agg(F.count("*").alias("n"), F.min("needs").alias("least")).collect()}
    most = max(1, ceil(m / q_blocks))
    q_parts = [max(1, ceil(of.get(b, (0, 0))[0] / most)) for b in range(max(of, default=0) + 1)]
    # blocks of little need come last, and they are those that a range of short vectors meets
    from_ = [min((b for b in of if ranges[r][1] * (1 + 1e-9) >= of[b][1]), default=len(q_parts)) if r in ranges else len(q_parts) for r in range(len(parts))]
    x = x.withColumn("from", F.get(listed(from_), F.col("range"))).where(F.col("from") < len(q_parts)).where(~first)
    left = x.select("vec_id", "x", "at", F.explode(F.sequence(F.col("from"), F.lit(len(q_parts) - 1))).alias("b"))
    left = left.select("vec_id", "x", "at", "b", F.explode(F.sequence(F.lit(0), F.get(listed(q_parts), F.col("b")) - 1)).alias("p")).withColumn("q_block", F.struct("b", "p"))
    right = blocked.withColumn("p", deal(F.get(listed(q_parts), F.col("q_block")), "query_id"))
    right = right.withColumn("range", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(parts) - 1)), lambda r: F.get(listed(from_), r) <= F.col("q_block"))))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.get(listed(parts), F.col("range")) - 1)))
    right = right.where(~((F.col("range") == 0) & (F.col("part") == 0))).withColumn("at", F.struct("range", "part"))
    right = right.select("query_id", "query_hash", "floor", "x", "at", F.struct(F.col("q_block").alias("b"), "p").alias("q_block"))
    hits = known.unionByName(met(left.select("vec_id", "x", "at", "q_block"), right, k, turn))
    rank = F.row_number().over(W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50, among all other rows.

    A query's own rows are those with its vec_id.  Vectors of different lengths are never compared; two empty ones have
    score 0.  A null vec_id is a candidate, last among ties, and never a query.  Repeated query rows count once, repeated
    candidates each.  Scores beyond 64 bits are held at its ends, and so may tie.  Empty table: no rows.
    Vectors may have any length; further columns are not read.
    """
    return top_k(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
