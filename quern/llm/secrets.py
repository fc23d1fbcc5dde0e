"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import only, pinned, staged, table, unpacked

# Fixed values of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the battery: the longest runs, with a letter in them, of base64's alphabet, of its form for URLs and of
#: what both have, so that no name before a '=', prefix or folder hides the value behind it.  '=' only pads a run.
RUNS = tuple(rf"[{c}]{{20,}}(?:=+(?![A-Za-z0-9+/_=-]))?" for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (what the whole run matches, its alphabet in order, least length); the first that matches is the inferred encoding, and
#: where none does, the first that matches the run without its padding.
ENCODINGS = (
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6], 20),
    (r"^[A-Z2-7]+=*$", UPPER + "234567", 24),
    (r"^[a-z0-9]+$", DIGITS + LOWER, 24),
    (r"^[A-Z0-9]+$", DIGITS + UPPER, 24),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 20),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+={0,2}$", UPPER + LOWER + DIGITS + "+/", 24),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+={0,2}$", UPPER + LOWER + DIGITS + "-_", 24),
)
#: Upper ends of the length bands within which false discoveries are controlled, each for itself.
BANDS = (23, 31, 47, 95)
#: The share of false discoveries, both of runs wrongly cleared as not random among the cleared and of false reports among
#: the reported.
RATE = 0.05
#: p-values are counted by quarters of a decade.  Runs in the bins below SURE (p over 0.1) tell how many random ones there are.
BINS, SURE = 48, 4
SPAN = "array<struct<start:int,end:int>>"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans (code points) of the leftmost non-overlapping matches whose ``group`` is ``least`` long or more.

    Spark's functions give matches and what lies between them, so places are sums of their lengths.
    """
    between = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    tested = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else found
    steps = F.filter(F.zip_with(between, F.zip_with(found, tested, lambda n, t: F.struct(n.alias("n"), t.alias("t"))), lambda g, m: F.struct(g.alias("gap"), m.n.alias("n"), m.t.alias("t"))), lambda s: s.n.isNotNull())
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc.at + s.gap
        more = F.array_append(acc.out, F.struct(start.alias("start"), (start + s.n).alias("end")))
        return F.struct((start + s.n).alias("at"), F.when(s.t >= least, more).otherwise(acc.out).alias("out"))

    return F.aggregate(steps, empty, step, lambda acc: acc.out)


def guarded(text: Column, guard: str, pattern: str, group: int, least: int) -> Column:
    """matches(), but only for texts in which the cheaper ``guard`` is found."""
    return F.when(text.rlike(guard), matches(text, pattern, group, least)).otherwise(F.array().cast(SPAN))


def tail(z: Column) -> Column:
    """The logarithm of the chance of a normal number of that size or more on either side."""
    return -0.717 * F.abs(z) - 0.416 * z * z


def p_random(v: Column, k: Column, classes: Column, kinds: Column) -> Column:
    """Fisher's combination of five tests of the codes ``v`` against independent uniform draws from 0 to k - 1.

    Chi-squared uniformity over the alphabet (by its exact mean and variance, so that few draws are no harm) and over
    the classes of characters (``classes``: shares and counts), runs above and below the middle, runs of one class
    (``kinds``: the class of each character), and serial correlation.
    """
    n = F.size(v).cast("double")
    middle = (k - 1) / 2
    a, b = F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1)

    # What is used more than once is bound: a plan that repeats it grows with the product of all uses, in the driver's memory.
    def sums(of: Column) -> Column:
        chi = k / n * total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0)))) - n
        chi_class = total(F.transform(of.classes, lambda c: F.pow(c.count - n * c.share, F.lit(2.0)) / (n * c.share)))
        df = F.greatest(F.size(of.classes) - 1, F.lit(1)).cast("double")
        high = total(F.transform(v, lambda x: F.when(x > middle, 1.0).otherwise(0.0)))
        runs = total(F.zip_with(a, b, lambda x, y: F.when((x > middle) != (y > middle), 1.0).otherwise(0.0))) + 1
        same = total(F.transform(of.classes, lambda c: c.share * c.share))
        turns = total(F.zip_with(F.slice(of.kinds, 1, F.size(v) - 1), F.slice(of.kinds, 2, F.size(v) - 1), lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
        serial = total(F.zip_with(a, b, lambda x, y: (x - middle) * (y - middle)))
        named = {"chi": chi, "chi_class": chi_class, "df": df, "high": high, "runs": runs, "same": same, "turns": turns, "serial": serial}
        return F.struct(*(c.alias(name) for name, c in named.items()))

    def scores(of: Column) -> Column:
        z_chi = F.greatest(F.lit(0.0), (of.chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
        z_class = F.greatest(F.lit(0.0), (of.chi_class - of.df) / F.sqrt(2 * of.df))
        mean = 2 * of.high * (n - of.high) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (of.runs - mean) / F.sqrt(spread)).otherwise(F.lit(9.0))
        z_turns = (of.turns - (n - 1) * (1 - of.same)) / F.sqrt((n - 1) * of.same * (1 - of.same))
        z_serial = of.serial / ((k * k - 1) / 12) / F.sqrt(n - 1)
        named = {"chi": z_chi, "classes": z_class, "runs": z_runs, "turns": z_turns, "serial": z_serial}
        return F.struct(*(c.alias(name) for name, c in named.items()))

    tails = lambda z: -(tail(z.chi) + tail(z.classes) + tail(z.runs) + tail(z.turns) + tail(z.serial))
    p = lambda y: F.exp(-y) * (1 + y + y * y / 2 + F.pow(y, F.lit(3.0)) / 6 + F.pow(y, F.lit(4.0)) / 24)
    given = F.struct(classes.alias("classes"), kinds.alias("kinds"))
    return bind(given, lambda of: bind(sums(of), lambda of: bind(scores(of), lambda z: bind(tails(z), p))))


def tested(run: Column) -> Column:
    """band and bin of a run (a struct), null where no encoding is inferred or its least length is missed."""
    def inferred(said: Column, body: Column) -> Column:
        return F.coalesce(*(F.when(said.rlike(pattern) & (F.length(body) >= least), F.lit(alphabet)) for pattern, alphabet, least in ENCODINGS))

    def test(alphabet: Column, body: Column) -> Column:
        k = F.length(alphabet).cast("double")
        codes = F.transform(F.split(body, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
        count = lambda s, one: F.regexp_count(s, F.lit(one)).cast("double")
        classes = F.filter(F.array(*(F.struct((count(alphabet, one) / k).alias("share"), count(body, one).alias("count")) for one in ("[0-9]", "[A-Z]", "[a-z]"))), lambda c: c.share > 0)
        kinds = F.transform(F.split(body, ""), lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).otherwise(2))
        return bind(codes, lambda v: p_random(v, k, classes, kinds))

    def p_of(body: Column) -> Column:
        case = F.coalesce(inferred(run, body), F.when(body != run, inferred(body, body)))
        return bind(case, lambda alphabet: F.when(alphabet.isNotNull(), test(alphabet, body)))

    n = F.length(run)
    band = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        band = F.when(n <= end, F.lit(i)).otherwise(band)
    # greatest() and least() skip nulls: without the condition an untested run would count as p = 0
    bin_ = lambda p: F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-300)))).cast("int")
    known = lambda p: F.when(p.isNotNull(), F.least(F.lit(BINS - 1), F.greatest(F.lit(0), bin_(p))))
    return F.struct(band.alias("band"), bind(bind(F.regexp_replace(run, "=+$", ""), p_of), known).alias("bin"))


def with_runs(x: DataFrame) -> DataFrame:
    """``runs``: start, end, band, bin of the candidates that the battery could test, by start, longer ones first."""
    top = (1 << 31) - 1
    code = lambda s: s.start.cast("long") * (top + 1) + (top - s.end)
    found = [F.transform(guarded(F.col("text"), pattern.split("(")[0], pattern, 0, 20), code) for pattern in RUNS]
    x = pinned(x, _c=F.sort_array(F.array_distinct(F.concat(*found))))
    x = pinned(x, _p=F.transform("_c", lambda c: F.struct(F.shiftright(c, 31).cast("int").alias("start"), (top - c.bitwiseAND(top)).cast("int").alias("end")))).drop("_c")
    some = F.transform("_p", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.substring(F.col("text"), s.start + 1, s.end - s.start).alias("run")))
    x = pinned(x, _r=F.filter(some, lambda s: s.run.rlike("[A-Za-z]"))).drop("_p")
    x = pinned(x, _t=F.transform("_r", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), tested(s.run).alias("t"))))
    flat = F.transform("_t", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.t.band.alias("band"), s.t.bin.alias("bin")))
    return pinned(x, runs=F.filter(flat, lambda s: s.bin.isNotNull())).drop("_r", "_t")


def outermost(spans: Column) -> Column:
    """Of spans by start, longer ones first, those that lie in no other."""
    empty = F.struct(F.lit(0).alias("end"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.array_append(acc.out, F.struct(s.start.alias("start"), s.end.alias("end")))
        return F.struct(F.greatest(acc.end, s.end).alias("end"), F.when(s.end > acc.end, more).otherwise(acc.out).alias("out"))

    return F.aggregate(spans, empty, step, lambda acc: acc.out)


def counted(x: DataFrame) -> list[list[int]]:
    """Candidates of the corpus by band and bin; so many numbers reach the driver."""
    out = [[0] * BINS for _ in range(len(BANDS) + 1)]
    for r in x.select(F.explode("runs").alias("r")).groupBy("r.band", "r.bin").count().collect():
        out[r["band"]][r["bin"]] = r["count"]
    return out


def least_cleared(counts: list[int]) -> int:
    """Of one band the least bin that is cleared as not random (BINS: none).

    A step-up rule over the band's candidates: runs are cleared up to the largest p with p <= RATE * (runs of p or
    less) / (runs of the band).  p of a bin is its upper end.
    """
    m, least, below = sum(counts), BINS, 0
    for b in range(BINS - 1, -1, -1):
        below += counts[b]
        if m and below and 10 ** (-b / 4) <= RATE * below / m:
            least = b
    return least


def limit(counts: list[int]) -> int:
    """The bin of one band below which runs are reported.

    It is the least bin that is cleared, or a lower one if too many of the reports would be false.  As p is uniform for
    random runs, those with p over 0.1 tell how many random ones to expect above any p; what is reported beyond these
    counts as false, and may be RATE of the reports at most.
    """
    random = sum(counts[:SURE]) / (1 - 10 ** (-SURE / 4))
    for b in range(least_cleared(counts), SURE, -1):
        reports = sum(counts[:b])
        if reports - random * (1 - 10 ** (-b / 4)) <= RATE * reports:
            return b
    return SURE


def cleared(x: DataFrame) -> list[int]:
    """For each band the least bin that is cleared as not random."""
    return [least_cleared(c) for c in counted(x)]


def scanned(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``assign``, ``access``, ``hex`` and ``random``: arrays of spans in ``text``.

    Texts are read once: what is found in them is written to the shared folder, for the counts of the whole corpus
    decide which runs are reported.
    """
    text = F.col("text")
    x = docs.withColumn("text", F.coalesce("text", F.lit("")))
    x = pinned(
        x,
        assign=guarded(text, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", ASSIGN, 2, LEAST["assign"]),
        access=guarded(text, "AKIA[A-Z0-9]{14}", ACCESS, 0, LEAST["access"]),
        hex=guarded(text, "[0-9a-f]{16}", "[0-9a-f]{16,}", 0, LEAST["hex"]),
    )
    x = staged(with_runs(x).select(*keep, "assign", "access", "hex", "runs"), "secret-runs")
    last = [limit(c) for c in counted(x)]
    base = F.concat("assign", "access", "hex")
    of = lambda r: F.get(F.array(*map(F.lit, last)), r.band)
    free = F.filter("runs", lambda r: (r.bin < of(r)) & ~F.exists(base, lambda s: (s.start < r.end) & (r.start < s.end)))
    return pinned(x, random=outermost(free)).drop("runs")


def in_order(kinds: tuple[str, ...]) -> Column:
    """Spans of these kinds with their kind's number and name, by start, then kind."""
    def named(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s.start.alias("start"), F.lit(i).alias("order"), s.end.alias("end"), F.lit(kind).alias("kind")))

    each = [named(i, kind) for i, kind in enumerate(kinds)]
    return F.sort_array(F.concat(*each))


def listed(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(in_order(kinds), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts, or run of overlapping ones, replaced by ``mark``; no row is dropped.

    A null text stays null, and a text without secrets stays as it is.  ``n_chars``, where there is one, follows the text.
    """
    # the text is carried once: in its place the row tells whether it is null
    row = F.struct(*(F.col("text").isNull().alias(n) if n == "text" else F.col(f"`{n}`") for n in docs.columns))
    x = scanned(docs.select("text", row.alias("_row")), "text", "_row")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, s.start - acc.at), F.lit(mark))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.when(s.start >= acc.at, new).otherwise(acc.out).alias("out"))

    x = pinned(x, _spans=in_order(KINDS))
    done = F.aggregate("_spans", start, step, lambda acc: F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, F.length("text"))))
    x = pinned(x, _text=F.when(~F.col("_row").getField("text"), F.when(F.size("_spans") > 0, done).otherwise(F.col("text"))))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("_spans") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row").getField("n_chars"))
    return unpacked(x, docs.columns, **changed)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document.

    Null or empty text: no spans.  Null or repeated doc_ids: a row for each row.  Spans of the battery (kind random) that
    would overlap one of the base kinds, or lie in another one of the battery, are left out.  Empty table: no rows.  Places count code points
    of the whole text, of whatever length.  Further columns are not read.
    """
    x = scanned(only(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")
    n = lambda c: F.size(c).cast("long")
    return x.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
