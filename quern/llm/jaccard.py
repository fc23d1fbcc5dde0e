"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quern.llm.common import only, packed, released, skew_lookup, staged, table, unpacked
from quern.llm.components import components

N, PERCENT = 4, 85
#: Bytes of texts that are hashed together; n-grams of the sets whose segments leave a task together.
CHUNK, BATCH_GRAMS = 1 << 18, 1 << 20
#: Segments in a group, about and at least.
ENTRIES, LEAST_ENTRIES = 1 << 20, 1 << 16
#: Fragments of the order in which the overlaps of a pair are counted, each for itself.
FRAGMENTS = 8
#: One fragment more for so many n-grams that a linked pair may differ in.
SLACK = 16
#: Sets and n-grams of a block of a cluster, about.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: N-grams of listed pairs that are looked up together.
PROBES = 1 << 20

#: Where sets meet: whether the cluster is of one block, its number, and two of its blocks.
CELL = pa.struct([("small", pa.bool_()), ("pack", pa.int64()), ("i", pa.int32()), ("j", pa.int32())])
CELLS = "array<struct<small:boolean,pack:bigint,i:int,j:int>>"

GOLDEN, PRIME, MIX, LAST = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
LONG = "long"


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * LAST
    return h ^ (h >> np.uint64(29))


class Hasher:
    """64-bit hashes of the words of many texts at once: sums of byte numbers times powers, from prefix sums.

    A-Z count as a-z; the six white-space characters of the contract part words.
    """

    def __init__(self):
        with np.errstate(over="ignore"):
            self.byte = finish(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
        self.byte[65:91] = self.byte[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self._grow(CHUNK)

    def _grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            p = np.full(n + 1, np.uint64(x))
            p[0] = 1
            return np.multiply.accumulate(p)

        self.up, self.down = powers(int(PRIME)), powers(pow(int(PRIME), -1, 1 << 64))

    def words(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of ``data`` (bytes of texts that end at ``ends``), and how many words there are up to each end."""
        if not len(data):
            return np.array([], np.uint64), np.zeros(len(ends), np.int64)
        if len(data) >= len(self.up):
            self._grow(len(data))
        word = ~self.space[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = ends[(ends > 0) & (ends < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.byte[data] * self.up[: len(data)], out=sums[1:])
            return finish((sums[b] - sums[a]) * self.down[a]), np.searchsorted(a, ends)

    def long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of the words of one long text, taken a piece of whole words at a time."""
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and not (gaps := np.flatnonzero(self.space[data[end : end + CHUNK]])).size:
                end = min(len(data), end + CHUNK)
            end = min(len(data), end + int(gaps[0])) if end < len(data) else end
            out.append(self.words(data[at:end], np.array([end - at]))[0])
            at = end
        return np.concatenate(out) if out else np.array([], np.uint64)

    def sets(self, texts: pa.Array, n: int) -> Iterator[np.ndarray]:
        """For each text its distinct shingles of ``n`` words, sorted; the whole sequence is one if it is shorter."""
        if texts.null_count:
            texts = texts.fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] else np.array([], np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
            piece = data[ends[i] : ends[j]]
            if j == i + 1:
                w = self.long(piece)
                upto = np.array([0, len(w)])
            else:
                w, counts = self.words(piece, ends[i + 1 : j + 1] - ends[i])
                upto = np.r_[0, counts]
            whole = combined(w, n)
            for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                s = np.sort(whole[a : b - n + 1] if b - a >= n else combined(w[a:b], b - a))
                yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s
            i = j


def combined(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours."""
    if not n or len(w) < n:
        return np.array([], np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            h = h * MIX + w[i : len(w) - n + 1 + i]
        return finish(h)


def class_of(grams: np.ndarray) -> int:
    h = xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``k``, a hash of both: rows of equal k are alike in either."""
    x = only(docs, "doc_id", "text")
    return x.withColumn("k", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def sets_of(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, k, class (a hash of the set, null if it is empty), n, spare, spare_below (see spare()) of every row of ``docs``."""
    names = ["doc_id", "k", "class", "n", "spare", "spare_below"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = Hasher(), Levels(percent)
        for b in batches:
            at, made, some, size = 0, [], [], 0
            for i, s in enumerate(hasher.sets(b.column(2), n), 1):
                made.append((class_of(s) if len(s) else None, len(s)))
                some.append(s)
                size += len(s)
                if size >= BATCH_GRAMS // 4 or i == b.num_rows:
                    cols = [pa.array(c, pa.int64()) for c in (*zip(*made, strict=True), *spare(some, levels, percent))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(made)), b.column(1).slice(at, len(made)), *cols], names=names)
                    at, made, some, size = i, [], [], 0

    return with_key(docs).select(F.col("doc_id").cast(LONG), "k", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Levels:
    """Size classes, and into how many fragments the sets of a class and the next are cut.

    A class holds the sizes that may link with its least, so linked sets are of one class or of neighbours.  With the
    smaller set in a class, a linked pair differs in ``most`` n-grams at most; in more fragments than that the two have
    the same segment in at least one.  The further fragments are what a set may leave out of its segments: see kept().
    """

    def __init__(self, percent: int):
        least = [1]
        while least[-1] < 1 << 40 and percent > 0:
            least.append(least[-1] * 100 // percent + 1)
        top = np.array(least[1:], dtype=np.int64) - 1
        self.least = np.array(least[:-1], dtype=np.int64)
        self.most = (top + top * 100 // percent) * (100 - percent) // (100 + percent)
        self.fragments = self.most + 2 + self.most // SLACK


def fragments_of(h: np.ndarray, at: np.ndarray, fragments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fragment of each n-gram, in ``fragments`` equal ranges for its set ``at``; and where a segment begins."""
    fragment = (h >> np.uint64(32)) * fragments[at].astype(np.uint64) >> np.uint64(32)
    return fragment, np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (fragment[1:] != fragment[:-1])][: len(h)])


def spare(sets: list[np.ndarray], levels: Levels, percent: int) -> list[np.ndarray]:
    """How many segments each of ``sets`` may leave out, in its own class and in the class below.

    A linked pair has the same segment in all of either set's segments but for the n-grams in which the two may differ:
    for a set in its own class as many as with the largest set it may link with, in the class below as with the largest
    there.  One in 256 is held back: signatures have 31 bits in a group, where two segments of a set may collide.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    h, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(levels.least, sizes, side="right") - 1
    out = []
    for level, largest in ((own, sizes * 100 // percent), (own - 1, levels.least[own] - 1)):
        _, edge = fragments_of(h, at, levels.fragments[level])
        used = np.bincount(at[edge], minlength=len(sets))
        most = (sizes + largest) * (100 - percent) // (100 + percent)
        out.append(np.where(level >= 0, np.maximum(used - most - 1 - used // 256, 0), 0))
    return out


def segments(sets: list[np.ndarray], levels: Levels, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, whether the set is of the next class) of all segments of ``sets``.

    The order of the n-grams is that of their hashes, which is cut into equal ranges.  A set has the segments of its own
    class's fragments and of the class below.  A signature stands for class, fragment and all n-grams there.  A set
    with segments in no more fragments than a link may differ in (others are empty) could miss a partner of the same
    kind: such sets also enter the n-grams of their prefixes, one of which any partner shares.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    h, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(levels.least, sizes, side="right") - 1
    out = []
    with np.errstate(over="ignore"):
        mixed = finish(h * GOLDEN)
        for step in (0, 1):
            level = own - step
            used = (level >= 0) & (levels.most[level] > 0)  # else only equal sets link
            fragment, edge = fragments_of(h, at, levels.fragments[level])
            of = at[edge]
            place = level[of].astype(np.uint64) << np.uint64(48) | fragment[edge]
            signature = finish(np.add.reduceat(mixed, edge) + finish(place * PRIME))
            weak = used & (np.bincount(of, minlength=len(sets)) <= levels.most[level])
            out.append((signature[used[of]], of[used[of]], np.full(int(used[of].sum()), step, np.uint32)))
            for i in np.flatnonzero(weak):
                prefix = sets[i][: sizes[i] - -(-percent * sizes[i] // 100) + 1]
                signature = finish(prefix * GOLDEN + finish(np.uint64(level[i]) * MIX))
                out.append((signature, np.full(len(prefix), i), np.full(len(prefix), step, np.uint32)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def entries(docs: DataFrame, groups: int, n: int, percent: int) -> DataFrame:
    """grp, data: the segments of all sets, by signature in ``groups`` groups, packed: signatures (31 bits, and one for
    the class), then sets.  Equal sets of a task's batch enter once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = Hasher(), Levels(percent)
        sets: dict[int, np.ndarray] = {}
        size = 0

        def packs() -> Iterator[pa.RecordBatch]:
            signature, at, step = segments(list(sets.values()), levels, percent)
            order = np.argsort(signature)
            signature, step = signature[order], step[order]
            who = np.array(list(sets), dtype=np.int64)[at[order]]
            grp = ((signature >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            low = signature.astype(np.uint32) & np.uint32(0xFFFFFFFE) | step
            ends = np.flatnonzero(np.r_[grp[1:] != grp[:-1], True]) + 1 if len(grp) else []
            rows, start = [], 0
            for end in ends:
                rows.append((int(grp[start]), low[start:end].tobytes() + who[start:end].tobytes()))
                start = end
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096], strict=True), (pa.int64(), pa.binary()), strict=True)], names=["grp", "data"])

        for b in batches:
            for s in hasher.sets(b.column(0), n):
                if len(s) and (c := class_of(s)) not in sets:
                    sets[c] = s
                    size += len(s)
                    if size >= BATCH_GRAMS:
                        yield from packs()
                        sets.clear()
                        size = 0
        if sets:
            yield from packs()

    return only(docs, "text").mapInArrow(run, "grp long, data binary")


def postings(packs: DataFrame) -> DataFrame:
    """sig, class, upper, hub, members of every segment that two sets or more have, one at least of the lower class.

    ``hub``: the least set of the lower class.  Pairs of sets of the upper class meet in their own level.
    """

    def run(key, rows):
        blobs = rows.column("data").to_pylist()
        sizes = [len(x) // 12 for x in blobs]
        low = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(blobs, sizes, strict=True)])
        who = np.concatenate([np.frombuffer(x, np.int64, k, 4 * k) for x, k in zip(blobs, sizes, strict=True)])
        del blobs
        order = np.lexsort((who, low))  # the last bit sorts a posting's lower class first
        low, who = low[order], who[order]
        keep = np.r_[True, (low[1:] != low[:-1]) | (who[1:] != who[:-1])]
        low, who = low[keep], who[keep]
        sig, upper = low >> np.uint32(1), (low & np.uint32(1)).astype(bool)
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        count = np.diff(np.r_[start, len(sig)])
        good = (count > 1) & ~upper[start]
        keep, start, count = np.repeat(good, count), start[good], count[good]
        full = (np.int64(key[0].as_py()) << np.int64(31)) + sig[keep].astype(np.int64)
        return pa.table({"sig": full, "class": who[keep], "upper": upper[keep], "hub": np.repeat(who[start], count), "members": np.repeat(count, count)})

    return packs.groupBy("grp").applyInArrow(run, "sig long, class long, upper boolean, hub long, members long")


def kept(found: DataFrame, classes: DataFrame) -> DataFrame:
    """The postings without the segments that sets may leave out: of each set the most frequent, as many as it can spare.

    Linked sets have more equal segments than either may leave out.  All order segments alike, so the rarest of the equal
    ones has at least so many before it in both sets, and both keep it.  What only a common passage makes equal goes.
    """
    may = classes.select("class", F.lit(False).alias("upper"), F.col("spare").alias("may")).unionByName(classes.select("class", F.lit(True).alias("upper"), F.col("spare_below").alias("may")))
    x = found.withColumn("place", F.row_number().over(W.partitionBy("class", "upper").orderBy(F.desc("members"), "sig")))
    x = x.join(may, ["class", "upper"]).where("place > may").select("sig", "class", "upper")
    x = staged(x, "kept")
    of = x.groupBy("sig").agg(F.min(F.when(~F.col("upper"), F.col("class"))).alias("hub"), F.count("*").alias("members"))
    return x.join(of.where("members > 1 and hub is not null"), "sig")


def parts_of(docs: DataFrame, reps: DataFrame, rows: int, n: int = N) -> DataFrame:
    """class, cells, fragment, n, grams: the sets of the classes in ``reps`` (class, k, alike: rows of that k; cells), cut by
    the global order.

    Every size of data runs the same join.  Only texts of rows that are alike can come twice, and only they are told apart.
    """
    kinds = (pa.int64(), pa.bool_(), pa.list_(CELL), pa.int32(), pa.int64(), pa.list_(pa.int64()))
    names = ["class", "again", "cells", "fragment", "n", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            made, size = [], 0
            for c, again, to, s in zip(*(x.to_pylist() for x in b.columns[1:]), hasher.sets(b.column(0), n), strict=True):
                cut = np.searchsorted((s >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32), np.arange(FRAGMENTS + 1))
                made += [(c, again, to, f, len(s), s[x:y].view(np.int64)) for f, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if y > x]
                size += len(s)
                if size >= BATCH_GRAMS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

    x = skew_lookup(with_key(docs).select("k", "text"), reps.withColumnRenamed("class", "c"), "k", "alike", rows, F.length("text"), hint="merge")
    x = x.where("c is not null").select("text", F.col("c").alias("class"), F.col("again"), "cells")
    x = staged(x.mapInArrow(run, f"class long, again boolean, cells {CELLS}, fragment int, n long, grams array<long>"), "parts")
    several = x.where("again").dropDuplicates(["class", "fragment"])
    return x.where("not again").unionByName(several).drop("again")


def placed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, pack, blocks of the sets in ``pairs``: the cluster that candidate pairs connect, and into how many blocks it is cut.

    A block has about BLOCK sets or BLOCK_GRAMS n-grams.  Clusters of one block share packs of that size.  Clusters tell
    where sets meet, not which do.
    """
    nodes = components(pairs).withColumnRenamed("node", "class").join(classes.select("class", "n"), "class")
    nodes = staged(nodes, "clusters")
    count = nodes.count()
    sizes = nodes.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    x = skew_lookup(nodes.select("class", "root"), staged(sizes, "cluster-sizes", count), "root", "members", count, F.col("class"))
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("grams") / F.lit(BLOCK_GRAMS))).cast("int")
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(count // BLOCK + 1).cast(LONG))).otherwise(F.col("root"))
    return staged(x.withColumn("blocks", blocks).select("class", pack.alias("pack"), "blocks"), "places")


def block_of(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.col("blocks")).cast("int")


def meetings(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """``pairs`` with the cell in which the two sets meet: one for each two blocks of a cluster that have pairs."""
    x = pairs.join(places.withColumnRenamed("class", "a"), "a")
    x = x.withColumn("i", F.least(block_of("a"), block_of("b"))).withColumn("j", F.greatest(block_of("a"), block_of("b")))
    return staged(x.select("a", "b", F.struct((F.col("blocks") == 1).alias("small"), "pack", "i", "j").alias("cell")), "placed-pairs")


def cells_of(met: DataFrame) -> DataFrame:
    """class, cells of the sets in meetings()."""
    x = met.select("cell", F.col("a").alias("class")).unionByName(met.select("cell", F.col("b").alias("class")))
    return x.groupBy("class").agg(F.collect_set("cell").alias("cells"))


def links(met: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted in each fragment of the order by itself and summed per pair.

    The sets of a cell meet in one group for each fragment, which counts for the listed pairs only.
    """
    sets = parts.select("class", "fragment", "n", "grams", F.explode("cells").alias("cell"))
    listed = met.select("cell", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))

    def run(_key, sets: pa.Table, pairs: pa.Table) -> pa.Table:
        who, at = np.unique(sets.column("class").to_numpy(), return_inverse=True)
        n = np.zeros(len(who), np.int64)
        n[at] = sets.column("n").to_numpy()
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        known = np.isin(a, who) & np.isin(b, who)  # else one has no n-gram here
        a, b = a[known], b[known]
        x, y = np.searchsorted(who, a), np.searchsorted(who, b)
        both = partials(*cells(sets, at), x, y, len(who))
        some = both > 0
        return pa.table({"a": a[some], "b": b[some], "n_a": n[x][some], "n_b": n[y][some], "partial": both[some]})

    counted = sets.groupBy("cell", "fragment").cogroup(listed.groupBy("cell", "fragment")).applyInArrow(run, "a long, b long, n_a long, n_b long, partial long")
    x = counted.groupBy("a", "b").agg(F.sum("partial").alias("both"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return x.where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def unsettled(found: DataFrame, roots: DataFrame) -> DataFrame:
    """sig, class, root of the postings of three or more in which sets beside the hub are neither connected yet nor compared."""
    many = found.where((F.col("members") > 2) & (F.col("class") != F.col("hub"))).select("sig", "class", "upper")
    known = roots.withColumnRenamed("node", "class")
    x = many.join(known, "class", "left").withColumn("root", F.coalesce("root", "class"))
    # pairs of the upper class meet in its own level: without a set of the lower class there is nothing to compare
    of = x.groupBy("sig").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.min("upper").alias("upper"))
    return x.drop("upper").join(of.where("one <> other and not upper").select("sig"), "sig")


def cells(sets: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, n-gram) of all rows, whose sets are ``at``."""
    grams = sets.column("grams").combine_chunks()
    return np.repeat(at, grams.value_lengths().to_numpy()), grams.flatten().to_numpy()


def partials(row: np.ndarray, grams: np.ndarray, x: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of the sets ``x`` with the sets ``y``, pair by pair, of ``m`` sets given as (set, n-gram).

    The n-grams of a pair's smaller set are looked up in the larger, so time and memory grow with the pairs, not with the
    square of the sets.
    """
    _, at, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count[at] > 1  # the others are in no intersection
    row, at = row[shared], at[shared]
    key = np.sort(row * len(count) + at)
    size = np.bincount(row, minlength=m)
    start = np.cumsum(size) - size
    x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    out, upto, a = np.zeros(len(x), np.int64), np.cumsum(size[x]), 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PROBES, side="right")))
        k = size[x[a:b]]
        place = np.arange(k.sum()) + np.repeat(start[x[a:b]] - (np.cumsum(k) - k), k)
        wanted = key[place] + np.repeat((y[a:b] - x[a:b]) * len(count), k)
        found = key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), k)[found], minlength=b - a)
        a = b
    return out


def overlaps(fragments: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Sizes of all intersections of ``m`` sets, from the (set, n-gram) of each fragment: partial overlaps are counted
    fragment by fragment, and summed per pair."""
    out = np.zeros((m, m), dtype=np.float32)
    width = max(256, (1 << 22) // max(1, m))
    for row, grams in fragments:
        grams, at, count = np.unique(grams, return_inverse=True, return_counts=True)
        shared = count > 1  # the others are in no intersection
        out[np.arange(m), np.arange(m)] += np.bincount(row[~shared[at]], minlength=m)
        keep = shared[at]
        row, at = row[keep], (np.cumsum(shared) - 1)[at[keep]]
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for a in range(0, int(shared.sum()), width):
            i, j = np.searchsorted(at, (a, a + width))
            part = np.zeros((m, width), dtype=np.float32)
            part[row[i:j], at[i:j] - a] = 1
            out += part @ part.T
    return out.astype(np.int64)


def forests(rest: DataFrame, places: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what links across roots connect in the postings of ``rest``.

    Two blocks of a cluster meet in a group with those of their sets that have a posting in common with the other block,
    and the group compares all sets of different roots without emitting pairs.
    """
    x = rest.join(places, "class").withColumn("block", block_of("class"))
    of = x.groupBy("sig").agg(F.collect_set("block").alias("others"))
    x = x.join(of, "sig").groupBy("class", "root", "pack", "blocks", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    x = x.withColumn("other", F.explode("others"))
    cell = ["small", "pack", "i", "j"]
    x = x.withColumn("small", F.col("blocks") == 1).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    x = x.select(*cell, "class", "root").hint("merge").join(parts.drop("cells"), "class")

    def run(rows: pa.Table) -> pa.Table:
        who, at = np.unique(rows.column("class").to_numpy(), return_inverse=True)
        m = len(who)
        root, n = np.zeros(m, np.int64), np.zeros(m, np.int64)
        root[at], n[at] = rows.column("root").to_numpy(), rows.column("n").to_numpy()
        fragment = rows.column("fragment").to_numpy()
        split = [np.flatnonzero(fragment == f) for f in range(FRAGMENTS)]
        both = overlaps([cells(rows.take(pa.array(i)), at[i]) for i in split if len(i)], m)
        link = (root[:, None] != root[None]) & (100 * both >= percent * (n[:, None] + n[None] - both))
        label = np.arange(m)
        while True:  # every set takes the least label among its links until none changes
            least = np.minimum(np.where(link, label[None], m).min(1), label)
            least = least[least]
            if (least == label).all():
                break
            label = least
        other = np.flatnonzero(label != np.arange(m))
        return pa.table({"a": who[other], "b": who[label[other]]})

    return x.select(*cell, "class", "root", "fragment", "n", "grams").groupBy(*cell).applyInArrow(run, "a long, b long")


def row_order(doc_id: str = "doc_id") -> list[Column]:
    return [F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id")]


def grouped(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k, class, n) of every row of ``docs``, and (class, copies, component_id, winner) of every class.

    ``component_id`` is the least doc_id of the class's component and ``winner`` one class of it that has that doc_id.

    Sets come from whole texts; equal sets are one class from there on.  The global order of all n-grams is cut into
    fragments, as many for a size that a linked pair agrees wholly on one at least: sets with the same segment there
    make a posting.  The members of a posting are paired with one of them; each pair's overlaps are counted in every
    fragment of the order separately and summed per pair.  After the components of these links are known, members of
    different components are compared in blocks, which give a forest of their links and not the pairs; so a group of near
    copies is not listed pair by pair, and no link between components is lost.  N-grams and sets are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    with released(spark) as keep:
        sets = staged(sets_of(docs, n, percent), "sets")
        rows, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
        segments_ = ceil(total * 2 * (100 - percent) / percent * 1.1) + 1
        groups = max(1, ceil(segments_ / ENTRIES), min(parallel, ceil(segments_ / LEAST_ENTRIES)))
        classes = sets.where("n > 0").groupBy("class").agg(F.min(F.struct(*row_order(), "k")).alias("least"), F.count("*").alias("copies"), *(F.max(c).alias(c) for c in ("n", "spare", "spare_below")))
        classes = staged(classes, "classes")
        found = staged(postings(entries(docs, groups, n, percent)), "postings")
        found = staged(kept(found, classes), "kept-postings")
        pairs = staged(found.where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
        places = placed(pairs, classes)
        met = meetings(pairs, places)
        alike = sets.where("n > 0").groupBy("k").agg(F.count("*").alias("alike"))
        reps = cells_of(met).join(classes.select("class", F.col("least.k").alias("k")), "class").join(alike, "k")
        reps = reps.select("class", "k", "alike", (F.col("alike") > 1).alias("again"), "cells")
        parts = parts_of(docs, staged(reps, "reps"), rows, n)
        edges = staged(links(met, parts, percent), "links")
        roots = components(edges)
        more = staged(forests(staged(unsettled(found, roots), "unsettled"), places, parts, percent), "more-links")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            roots = components(edges)
        linked = roots.count()
        ids = classes.join(roots.select(F.col("node").alias("class"), "root"), "class")
        named = F.struct("least.none", "least.doc_id", "class")
        least = staged(ids.groupBy("root").agg(F.min(named).alias("first"), F.count("*").alias("classes")), "least", linked)
        ids = skew_lookup(ids.select("class", "root"), least, "root", "classes", linked, F.col("class")).select("class", "first")
        ids = classes.join(ids, "class", "left").select("class", "copies", F.coalesce("first", named).alias("l"))
        ids = staged(ids.select("class", "copies", F.col("l.doc_id").alias("component_id"), F.col("l.class").alias("winner")), "component-ids")
        keep += [sets, ids]
    return sets, ids


def near_duplicates(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    sets, ids = grouped(docs, n=n, percent=percent)
    x = skew_lookup(sets, ids, "class", "copies", sets.count(), F.col("k"))
    return x.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, one of its least doc_id; rows without words all stay.

    Where a doc_id has several rows, a row stays if its own text has the winning class, and of equal classes under one
    doc_id the first text.
    """
    sets, ids = grouped(docs, n=n, percent=percent)
    win = ids.where(F.col("class") == F.col("winner")).select("class", "component_id", F.struct(F.col("component_id").isNull(), F.col("component_id")).alias("id"))
    mine = sets.where("n > 0").withColumn("id", F.struct(F.col("doc_id").isNull(), F.col("doc_id")))
    keys = mine.groupBy("class", "id", "k").agg(F.count("*").alias("alike")).join(win, ["class", "id"])
    # how many rows the class has under that doc_id: more than one must be told apart by their texts
    several = F.sum("alike").over(W.partitionBy("class"))
    keys = staged(keys.select("k", "alike", F.col("class").alias("_class"), several.alias("_rows")), "winners")
    x = packed(docs, "doc_id", "text")
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    none = unpacked(x.where(~words), docs.columns)
    x = x.where(words).select("_row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("k"))
    x = skew_lookup(x, keys, "k", "alike", sets.count(), F.length("_row.text")).where("_rows is not null")
    once = unpacked(x.where("_rows = 1"), docs.columns)
    first = F.row_number().over(W.partitionBy("_class").orderBy("_row.text"))
    some = unpacked(x.where("_rows > 1").withColumn("_first", first).where("_first = 1"), docs.columns)
    return none.unionByName(once).unionByName(some)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by the Jaccard similarity of their 4-word shingles.

    Null, empty or wordless text: no shingles, a component of its own.  Null doc_ids never are the smallest; a component
    of them alone has a null id.  Rows with the same doc_id are rows of their own.  Empty table: no rows.  Texts of any
    length are hashed a piece at a time, and their sets cut into fragments.  Further columns are not read.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (
  SELECT doc_id, doc_id AS reached FROM n
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""
