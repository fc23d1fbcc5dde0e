"""Plain versions of the operators, a document or a pair at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import exp, log

from xxhash import xxh64

from quern.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def statistics(text: str | None) -> tuple:
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def grams(text: str | None) -> list[int]:
    import regex

    h = [signed(xxh64(t.encode(), seed=42).intdigest()) % (1 << 40) for t in regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]+", text or "")]
    return [x % quality.BUCKETS for x in h] + [(a * 31 + b) % quality.BUCKETS for a, b in zip(h, h[1:])]


def kept(docs: list[tuple[int, str | None]], trusted: set[int]) -> list[bool]:
    raw, target = Counter(), Counter()
    all_grams = [grams(t) for _, t in docs]
    for (i, _), g in zip(docs, all_grams):
        raw.update(g)
        if i in trusted:
            target.update(g)
    base = log((raw.total() + quality.BUCKETS) / (target.total() + quality.BUCKETS))
    ratio = {b: round(1000 * (log((target[b] + 1) / (raw[b] + 1)) + base)) if target else 0 for b in raw}
    return [not statistics(t)[5] and sum(ratio[b] for b in g) >= quality.THRESHOLD * len(g) for (_, t), g in zip(docs, all_grams)]


def secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of the base kinds."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


def randomness(run: str, alphabet: str) -> float:
    """The battery on one run: five tests against uniform draws from the alphabet, by Fisher's combination."""
    v, k, n = [alphabet.index(c) for c in run], len(alphabet), len(run)
    chi = k / n * sum(c * c for c in Counter(v).values()) - n
    zs = [max(0.0, (chi - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5)]
    share = [(sum(map(f, alphabet)) / k, sum(map(f, run))) for f in (str.isdigit, str.isupper, str.islower)]
    share = [x for x in share if x[0]]
    df = max(1, len(share) - 1)
    zs.append(max(0.0, (sum((c - n * s) ** 2 / (n * s) for s, c in share) - df) / (2 * df) ** 0.5))
    middle = (k - 1) / 2
    high = [x > middle for x in v]
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    zs.append((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / spread**0.5 if spread > 0 else 9.0)
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 for c in run]
    same = sum(s * s for s, _ in share)
    zs.append((sum(a != b for a, b in zip(kinds, kinds[1:])) - (n - 1) * (1 - same)) / ((n - 1) * same * (1 - same)) ** 0.5)
    zs.append(sum((a - middle) * (b - middle) for a, b in zip(v, v[1:])) / ((k * k - 1) / 12) / (n - 1) ** 0.5)
    y = sum(0.717 * abs(z) + 0.416 * z * z for z in zs)
    return exp(-y) * (1 + y + y * y / 2 + y**3 / 6 + y**4 / 24)


def masked(text: str, more: tuple = ()) -> str:
    out, at = "", 0
    for start, _, end in sorted(secrets(text) + list(more)):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(docs: list[tuple[int, str | None]]) -> list[int]:
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least: dict[int, int] = {}
    for (i, _), x in zip(docs, label):
        least[x] = min(least.get(x, i), i)
    return [least[x] for x in label]


def mix(docs: list[tuple[int, str | None, str | None]]) -> list[tuple[int, int, float, int]]:
    """(size, source size, target, copies) of each (doc_id, text, source), the excess reshared step by step and the draws spread evenly."""
    size = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sources: dict = {}
    for n, (_, _, s) in zip(size, docs):
        sources[s] = sources.get(s, 0) + n
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(size) - sum(3 * sources[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > 3 * sources[s]}
        if not more:
            break
        full |= more
    target = {s: float(3 * sources[s]) if s in full else level * weight[s] for s in names}
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16)
    drawn = [h(f"mix:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}") for i, t, _ in docs]
    groups: dict = {}
    rows = Counter(s for *_, s in docs)
    for j, (_, _, s) in enumerate(docs):
        groups.setdefault((s, drawn[j] % -(-rows[s] // 10_000)), []).append(j)
    extra = [0] * len(docs)
    for (s, g), members in groups.items():
        part = target[s] / sources[s] % 1 if sources[s] else 0.0
        u = h(f"mix:s{'' if s is None else ':' + s}:{g}") / 16**13
        for k, j in enumerate(sorted(members, key=lambda j: (-size[j], drawn[j])), 1):
            extra[j] = int(u + k * part) - int(u + (k - 1) * part)
    return [(n, sources[s], target[s], (int(target[s] / sources[s]) if sources[s] else 0) + e) for n, (_, _, s), e in zip(size, docs, extra)]
