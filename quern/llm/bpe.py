"""Byte-level BPE in length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import give_back, only, table

FREE, NONE = np.int64(-1), np.int32(2**31 - 1)
#: Widths of the matrices; a piece of more bytes than the last is merged with a heap, whose time is n log n.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, 512)
CELLS = 1 << 18
#: Words that a task remembers, and their bytes, at most.
CACHED, CACHED_BYTES = 400_000, 4 << 20
CHUNK = 4 << 20


class PairTable:
    """Open addressing in numpy: (left id, right id) -> id of the merged token, or NONE."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, FREE)
        self.values = np.full(1 << self.bits, NONE)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == FREE
            self.keys[slots[free]] = keys[free]  # of keys that want one slot the last gets it
            won = self.keys[slots] == keys
            self.values[slots[won]] = merged[won]
            keys, merged, slots = keys[~won], merged[~won], (slots[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        got = self.keys[slots]
        out = np.where(got == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((got != keys) & (got != FREE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            got = self.keys[slots[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (got != FREE)]
        return out


class Coder:
    """Encodes and decodes by the ranks in a file with a base64 token and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.names = [str(i) for i in range(len(self.tokens))]
        self.ids = list(range(len(self.tokens)))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (np.array(c, dtype=np.int32) for c in zip(*pairs, strict=True))
        self.pairs = PairTable(left, right, merged)
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Merges rows of at most ``width`` bytes together: in each round every row merges its leftmost minimum-rank
        pair and closes the gap; rows without a pair leave the matrix."""
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        for i, p in enumerate(pieces):
            ids[i, : len(p)] = self.first[np.frombuffer(p, np.uint8)]
        out: list[list[int]] = [[]] * len(pieces)
        row = np.arange(len(pieces))
        pad = ids[:, 1:] < 0
        best = np.where(pad, NONE, self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(pad.shape))
        while len(row):
            at = best.argmin(1) if best.shape[1] else np.zeros(len(row), np.int64)
            new = best[np.arange(len(row)), at] if best.shape[1] else np.full(len(row), NONE)
            done = new == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row[i]] = ids[i][ids[i] >= 0].tolist()
                ids, best, row, at, new = ids[~done], best[~done], row[~done], at[~done], new[~done]
                if not len(row):
                    break
            k = np.arange(len(row))
            ids[k, at] = new
            col = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
            if best.shape[1] == 1:
                best = best[:, :0]
                continue
            col = np.arange(best.shape[1] - 1)
            best = np.take_along_axis(best, col + (col > at[:, None]), 1)
            last = ids.shape[1] - 1
            for side in (at - 1, at):  # only the pairs beside the merged token are new
                ok = (side >= 0) & (side < last)
                j, r = side[ok], k[ok]
                right = ids[r, j + 1]
                best[r, j] = np.where(right < 0, NONE, self.pairs.find(ids[r, j], right))
        return out

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b])
        found = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := merge(rank, ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := merge(ids[before[i]], rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]

    def pieces(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(words)
        sized = sorted(range(len(words)), key=lambda i: len(words[i]))
        todo: list[int] = []
        for i in sized:
            w = words[i]
            if w in self.ranks:
                out[i] = [self.ranks[w]]
            elif len(w) > WIDTHS[-1]:
                out[i] = self._heap(w)
            else:
                todo.append(i)
        start = 0
        for width in WIDTHS:
            end = start
            while end < len(todo) and len(words[todo[end]]) <= width:
                end += 1
            for a in range(start, end, max(1, CELLS // width)):
                part = todo[a : min(end, a + max(1, CELLS // width))]
                for i, ids in zip(part, self._matrix([words[i] for i in part], width), strict=True):
                    out[i] = ids
            start = end
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        split = [self.find(t) for t in texts]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        coded = [w.encode() for w in new]
        size = sum(map(len, coded))
        if len(known) + len(new) > CACHED or self.held + size > CACHED_BYTES:
            self.forget()
            new = list({w for words in split for w in words})
            coded = [w.encode() for w in new]
            size = sum(map(len, coded))
        self.held += size
        for w, ids in zip(new, self.pieces(coded), strict=True):
            known[w] = tuple(map(self.ids.__getitem__, ids))  # one object for each id, however many words have it
        for words in split:
            yield list(chain.from_iterable(map(known.__getitem__, words)))

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def text_of(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One coder for each vocabulary and Python worker."""
    return Coder(path, pattern)


def parts(texts: pa.Array) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK characters, so that a batch's words are never all in memory."""
    part, n = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        n += len(part[-1])
        if n >= CHUNK:
            yield part
            part, n = [], 0
    if part:
        yield part


def encoded(docs: DataFrame, path: str, pattern: str, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row of ``docs``.

    ``path``: the ranks, a file that every executor has at that place.  ``decoded_sha256`` is of the bytes that the
    ids, not the text, give.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        try:
            for b in batches:
                ids, at = b.column(0).to_pylist(), 0
                for part in parts(b.column(1)):
                    rows = []
                    for tokens in code.encode(part):
                        rows.append((ids[at], len(tokens), hashlib.sha256(code.text_of(tokens).encode()).hexdigest(), hashlib.sha256(code.decode(tokens)).hexdigest()) + ((tokens,) if keep_ids else ()))
                        at += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
        finally:
            code.forget()
            give_back()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes the ids again.

    Null or empty text: no ids, and the digests of nothing.  Null or repeated doc_ids: a row for each row.  Empty table:
    no rows, and further columns are not read.  Texts are never cut; a run without a break of over 512 bytes is merged by a heap, to the same ids.
    """
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
