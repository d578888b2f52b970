"""Secret scans, with DataFrame functions only.

Base patterns give spans of three kinds. Beside them, every run of LEAST or more characters that
credentials are written in is a candidate: its encoding is inferred (hex, base32, base62 or
base64), and a battery of tests asks whether it is uniformly random in that encoding: a
chi-squared tests of the alphabet's counts and of its classes (upper case, lower case, others), a runs test about the alphabet's middle, and the
serial correlation of neighbours. The smallest of the four p-values, times four, is the
candidate's; over its weight, it goes into a Benjamini-Hochberg procedure over the candidates of all
documents. The weight is 1 up to the mean length and the mean length over its own beyond it: the tests'
power grows with the length, so a longer run must show more evidence to be rejected, and a random
run isn't rejected more often the longer it is. Those rejected are ordinary text, with at most RATE of them truly random;
the others are spans of kind `random` unless they overlap a base span. The procedure's
counts are a histogram of fixed size.

A null or empty text has no spans. Spans count code points, their ends exclusive. Every row
keeps one row, repeated ones too. An empty table has no candidates. Texts of any length are searched whole.
Null ids are ids like others; extra columns are left out, whatever their names. Scores that tie at the bar are rejected together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

#: The base patterns; access and hex runs with their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "random")

LEAST, RATE, BINS, TENTHS, CHUNK = 20, 0.05, 1000, 20, 256
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPAN = "array<struct<start:bigint,end:bigint,found:string>>"


def _spans(text: Column, pattern: str, kept=None) -> Column:
    """Start, end and text of each match, leftmost and non-overlapping, by the lengths of the gaps between
    them. kept names a group and the least length it must have; matches that fail are passed over."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(kept[0])) if kept else found
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("found"), inner.alias("inner"))
    none = F.array().cast(_SPAN)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["found"].alias("found"))
        fails = x["found"].isNull() | (F.length(x["inner"]) < (kept[1] if kept else 0))
        return F.struct(end.cast("bigint").alias("at"), F.when(fails, s["out"]).otherwise(F.concat(s["out"], F.array(span))).alias("out"))

    # spans are appended within chunks and chunks to one another, as an append copies what it appends to
    def chunk(s: Column, c: Column) -> Column:
        return F.aggregate(c, F.struct(s["at"].alias("at"), none.alias("out")), step, lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    def chunks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda k: F.slice(p, k * CHUNK + 1, F.lit(CHUNK)))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.flatten(F.aggregate(_bind(pieces, chunks), start, chunk)["out"])


def _where(test: Column, spans: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), spans).otherwise(F.array().cast(_SPAN))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _two_sided(z: Column) -> Column:
    """A close logistic form of the normal distribution's two tails; never 0."""
    z = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def randomness(run: Column) -> Column:
    """The p-value of a run under uniform randomness in its inferred encoding."""
    body = F.rtrim(run, F.lit("="))
    is_of = lambda p: body.rlike(f"^[{p}]+$")
    alphabet = (
        F.when(is_of("0-9a-f"), _DIGITS + "abcdef").when(is_of("0-9A-F"), _DIGITS + "ABCDEF").when(is_of("A-Z2-7"), _UPPER + "234567")
        .when(is_of("A-Za-z0-9"), _UPPER + _LOWER + _DIGITS).when(body.rlike("[_-]"), _UPPER + _LOWER + _DIGITS + "-_").otherwise(_UPPER + _LOWER + _DIGITS + "+/")
    )

    def tests(a: Column) -> Column:
        k, n = F.length(a["alphabet"]).cast("double"), F.greatest(F.length(a["body"]), F.lit(2)).cast("double")
        squares = F.aggregate(F.split(a["alphabet"], ""), F.lit(0.0), lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow(F.length(a["body"]) - F.length(F.replace(a["body"], c)), F.lit(2.0))))
        # shares of upper case, lower case and the rest: for two degrees of freedom the tail is exp(-chi / 2)
        count = lambda c, of: F.length(F.regexp_replace(c, f"[^{of}]", "")).cast("double")
        shares = [(count(a["body"], p), n * count(a["alphabet"], p) / k) for p in ("A-Z", "a-z", "0-9+/_=-")]
        classes = F.when(k >= 62, F.exp(-sum(((o - e) * (o - e) / e for o, e in shares), F.lit(0.0)) / 2)).otherwise(1.0)
        codes = F.transform(F.filter(F.split(a["body"], ""), lambda c: c != ""), lambda c: F.position(c, a["alphabet"]).cast("double"))
        zero = F.lit(0.0)
        names = ("first", "last", "sum", "squares", "products", "high", "runs", "count")
        state = F.struct(*(zero.alias(x) for x in names))

        def step(s: Column, x: Column) -> Column:
            high = lambda v: (2 * v > k + 1).cast("double")
            new = (s["count"] == 0) | (high(x) != high(s["last"]))
            values = (F.when(s["count"] == 0, x).otherwise(s["first"]), x, s["sum"] + x, s["squares"] + x * x, s["products"] + s["last"] * x, s["high"] + high(x), s["runs"] + new.cast("double"), s["count"] + 1)
            return F.struct(*(v.alias(x_) for v, x_ in zip(values, names)))

        def judged(s: Column) -> Column:
            chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
            both = 2 * s["high"] * (n - s["high"])
            spread = both * (both - n) / (n * n * (n - 1))
            runs = F.when(spread > 0, (s["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(12.0)
            mean = s["sum"] / n
            around = s["squares"] - n * mean * mean
            serial = F.when(around > 0, (s["products"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean) / around * F.sqrt(n)).otherwise(12.0)
            return F.greatest(F.least(4 * F.least(_two_sided(chi), classes, _two_sided(runs), _two_sided(serial)), F.lit(1.0)), F.lit(1e-100))

        return _bind(F.aggregate(codes, state, step), judged)

    return _bind(F.struct(alphabet.alias("alphabet"), body.alias("body")), tests)


def _bar(scored: DataFrame) -> float:
    """The weighted Benjamini-Hochberg bar, as a tenth-power step: scores (-log10 of p over weight) at or above it are rejected."""
    rows = scored.groupBy(F.least(F.greatest(F.floor(F.col("score") * TENTHS), F.lit(0)), F.lit(BINS)).cast("int").alias("bin")).count().collect()  # at most BINS + 1 rows
    total, above, bar = sum(r["count"] for r in rows), 0, BINS + 1
    for r in sorted(rows, key=lambda r: -r["bin"]):
        above += r["count"]
        if 10 ** (-r["bin"] / TENTHS) <= RATE * above / total:
            bar = r["bin"]
    return bar / TENTHS


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, random) of each row: base spans (kind, start, end) in order, and the method's own."""
    store = Store(docs.sparkSession, "secrets")
    whole, lower = F.col("text"), F.lower(F.col("text"))
    some = F.lit(False)
    for w in WORDS:
        some = some | F.contains(lower, F.lit(w))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = [_where(some, _spans(whole, ASSIGN, (2, 8))), _where(F.contains(whole, F.lit("AKIA")), _spans(whole, ACCESS)), _where(whole.rlike(HEX), _spans(whole, HEX))]
    of_kind = lambda i: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))
    kinded = [F.transform(p, of_kind(i)) for i, p in enumerate(parts)]
    runs = F.transform(_where(whole.rlike(RUN), _spans(whole, RUN)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), randomness(s["found"]).alias("p")))
    found = store.save(rows.select("doc_id", F.array_sort(F.concat(*kinded)).alias("base"), runs.alias("runs")), "found")

    alone = found.select(F.explode("runs").alias("run")).select((F.col("run.end") - F.col("run.start")).alias("n"), F.col("run.p").alias("p"))
    mean = alone.agg(F.avg("n")).first()[0] or 1.0
    score = lambda n, p: -F.log10(p * F.greatest(n / mean, F.lit(1.0)))
    bar = _bar(alone.select(score(F.col("n"), F.col("p")).alias("score")))
    free = lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    mine = F.filter("runs", lambda r: (F.floor(score(r["end"] - r["start"], r["p"]) * TENTHS) < bar * TENTHS) & free(r))
    return found.select("doc_id", "base", F.transform(mine, of_kind(3)).alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
