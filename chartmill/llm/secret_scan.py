"""Secret scan by patterns and a battery of randomness tests, on SQL functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import text_of, write_table

# fixed values: the base kinds in their order; letters of an assignment's name in either case
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGNED = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

# tokens that the battery judges
LEAST_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}"


@dataclass(frozen=True)
class Encoding:
    """An alphabet in the order of its values, and the chance that two symbols of written text in it are equal."""

    name: str
    whole: str
    alphabet: str
    collision: float


LOW, HIGH, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
# two letters of written text are equal with a chance of about .0655, twice to four times that of random ones;
# hexadecimal text that is not random is taken to repeat itself twice as often as a random one
ENCODINGS = (
    Encoding("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.125),
    Encoding("lower", r"^[a-z]+$", LOW, 0.0655),
    Encoding("base32", r"^[A-Z2-7]+$", HIGH + "234567", 0.0655),
    Encoding("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", DIGITS + LOW, 0.0655),
    Encoding("base62", r"^[A-Za-z0-9]+$", DIGITS + HIGH + LOW, 0.0655),
    Encoding("base64", r"^[A-Za-z0-9+/]+$", HIGH + LOW + DIGITS + "+/", 0.0655),
    Encoding("base64url", r"^[A-Za-z0-9_-]+$", HIGH + LOW + DIGITS + "-_", 0.0655),
)
# alphabets of one case only: such tokens are compared in lower case
FOLDED = {"hex", "base36"}
# three symbols of written text are equal with a chance of this times the square of the collision rate
THIRD = 1.26
# runs and serial correlation of a random token leave this many standard deviations once in 1000 tokens
STRAY = 3.29
# lower ends of the bands of length in which the share of false discoveries is held
BANDS = (LEAST_TOKEN, 32, 48, 80)
FALSE_SHARE = 0.1
# steps of the histogram of p-values in decibels, the last one open
MOST_STEPS = 400


def _spans(text: Column, pattern: str, found: Column) -> Column:
    """First and last (exclusive) code point of each match."""
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    steps = F.arrays_zip(F.transform(found, lambda m: F.length(m)).alias("inner"), F.transform(F.slice(between, F.lit(1), F.size(found)), lambda b: F.length(b)).alias("gap"))

    def add(state: Column, step: Column) -> Column:
        first = state["at"] + step["gap"]
        last = first + step["inner"]
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("start"), last.alias("end")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, add, lambda state: state["out"])).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _of_encoding(number: Column, pick) -> Column:
    """A value by the number of the encoding."""
    return reduce(lambda rest, k: F.when(number == k, pick(ENCODINGS[k])).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(None))


def _encoding(token: Column) -> Column:
    """Number of the smallest encoding that the token can be in; null for digits alone, or marks of several encodings."""
    first = reduce(lambda rest, k: F.when(token.rlike(ENCODINGS[k].whole), k).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(None).cast("int"))
    return F.when(~token.rlike("^[0-9]+$"), first)


def tail(z: Column) -> Column:
    """Bound on the chance that a standard normal exceeds ``z``, 1 up to 0."""
    return F.when(z > 0, F.exp(-z * z / 2) / 12 + F.exp(-z * z * 2 / 3) / 4).otherwise(1.0)


def uniformity(token: Column, number: Column) -> Column:
    """How many standard deviations the chi-squared statistic over the alphabet lies below that of written text.

    Chi-squared is ``A/n * sum(count^2) - n``; the sum has a known mean and
    variance for symbols with a given collision rate, so the distance depends
    on the length: a short token is never far from written text.
    """
    n = F.length(token).cast("double")
    symbols = F.array(*[F.lit(c) for c in LOW + HIGH + DIGITS + "+/-_"])
    squares = F.aggregate(symbols, F.lit(0).cast("bigint"), lambda s, c: s + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2)).cast("bigint"))
    s2 = _of_encoding(number, lambda e: F.lit(e.collision))
    s3 = s2 * s2 * THIRD
    mean = n + n * (n - 1) * s2
    variance = n * 2 * (n - 1) * (s2 - s2 * s2 + (n - 2) * 2 * (s3 - s2 * s2))
    return (mean - squares) / F.sqrt(variance)


def halves(token: Column, number: Column) -> Column:
    """The token with 0 for symbols of the lower half of its alphabet and 1 for those of the upper half."""
    return _of_encoding(number, lambda e: F.translate(token, e.alphabet, "".join("0" if k < len(e.alphabet) / 2 else "1" for k in range(len(e.alphabet)))))


def runs(length: Column, high: Column, count: Column) -> Column:
    """Deviation of the number of runs of low and of high symbols from that of random ones, null for one run only."""
    n = length.cast("double")
    more = high * 2 * (n - high) / n
    variance = more * (more - 1) / (n - 1)
    return F.when(variance > 0, (count - more - 1) / F.sqrt(variance))


def serial_correlation(values: Column) -> Column:
    """Deviation of the circular correlation of neighbours from that of random symbols, null for one symbol only."""
    n = F.size(values).cast("bigint")
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), zero.alias("sum"), zero.alias("square"), zero.alias("pair"))
    sums = F.aggregate(values, start, lambda s, v: F.struct(
        (s["at"] + 1).alias("at"), (s["sum"] + v).alias("sum"), (s["square"] + v * v).alias("square"),
        (s["pair"] + v * F.get(values, ((s["at"] + 1) % n).cast("int"))).alias("pair")),
        lambda s: F.struct((n * s["pair"] - s["sum"] * s["sum"]).cast("double").alias("over"), (n * s["square"] - s["sum"] * s["sum"]).cast("double").alias("under")))
    m = n.cast("double")
    deviation = F.sqrt(m * (m - 3) / (m + 1)) / (m - 1)
    return F.transform(F.array(sums), lambda s: F.when(s["under"] > 0, (s["over"] / s["under"] + F.lit(1.0) / (m - 1)) / deviation))[0]


def judged(tokens: Column) -> Column:
    """``start, end, band, step`` of each token that has an encoding.

    The battery: runs and serial correlation must be those of random symbols
    (``STRAY``); the distance of chi-squared from written text gives the
    p-value, as decibels below 1 in ``step``. Tokens that fail a test have
    p = 1, step 0.
    """
    known = F.filter(F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), _encoding(t["token"]).alias("encoding"))), lambda t: t["encoding"].isNotNull())
    one_case = [k for k, e in enumerate(ENCODINGS) if e.name in FOLDED]
    folded = F.transform(known, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["encoding"].alias("encoding"), F.when(t["encoding"].isin(one_case), F.lower(t["token"])).otherwise(t["token"]).alias("token")))
    # a stage each for what the next one uses more than once: lambdas have no common subexpressions
    valued = F.transform(folded, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), uniformity(t["token"], t["encoding"]).alias("far"), halves(t["token"], t["encoding"]).alias("halves"),
        _of_encoding(t["encoding"], lambda e: F.lit(e.alphabet)).alias("alphabet"), F.filter(F.split(t["token"], ""), lambda c: c != "").alias("symbols")))
    counted = F.transform(valued, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["far"].alias("far"), F.length(t["halves"]).alias("n"),
        F.length(F.replace(t["halves"], F.lit("0"), F.lit(""))).cast("double").alias("high"), F.length(F.regexp_replace(t["halves"], "0+|1+", "x")).alias("count"),
        F.transform(t["symbols"], lambda c: F.instr(t["alphabet"], c).cast("bigint")).alias("values")))
    tested = F.transform(counted, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["far"].alias("far"), runs(t["n"], t["high"], t["count"]).alias("runs"), serial_correlation(t["values"]).alias("serial")))
    passed = F.transform(tested, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.when((F.abs(t["runs"]) <= STRAY) & (F.abs(t["serial"]) <= STRAY), tail(t["far"])).otherwise(1.0).alias("p")))
    return F.transform(passed, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"),
        reduce(lambda rest, k: F.when(t["end"] - t["start"] >= BANDS[k], k).otherwise(rest), range(len(BANDS)), F.lit(0)).alias("band"),
        F.when(t["p"] > 0, F.least(F.lit(MOST_STEPS), F.floor(F.log10(t["p"]) * -10).cast("int"))).otherwise(MOST_STEPS).alias("step")))


def least_steps(candidates: DataFrame, false_share: float) -> dict[int, int]:
    """Least ``step`` per band that Benjamini and Hochberg's procedure accepts.

    ``candidates`` is ``(band, step)`` of all tokens. A step stands for the
    largest p-value in it, so the share of false discoveries is held. The
    histogram has at most ``MOST_STEPS + 1`` rows a band.
    """
    counts: dict[int, dict[int, int]] = {}
    for row in candidates.groupBy("band", "step").count().collect():
        counts.setdefault(row.band, {})[row.step] = row["count"]
    least = {}
    for band, steps in counts.items():
        total, so_far = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            so_far += steps[step]
            if 10 ** (-step / 10) <= false_share * so_far / total:
                least[band] = step
    return least


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, by start and then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Secrets in each whole text: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.

    Base spans are those of the three patterns. Beside them, tokens of 20
    letters and more are judged by how random they are in the smallest
    encoding they fit (``judged``). Which p-values count is settled over all
    tokens of all texts, apart for each band of length (``least_steps``), so
    many short tokens raise the bar for short ones only. A random token that
    lies in a base span adds nothing; others are spans of kind ``random``.

    All work is row by row but for the histogram of p-values: no text and no
    key is shuffled. Spans count code points, ends are exclusive. Null and
    empty texts have no spans: counts of 0, the digest of nothing and an empty
    list. Null ids and repeated rows pass as they are, each row's tokens
    counting once; extra columns are not read. No rows give no rows.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    every = F.regexp_extract_all
    rows = rows.select("doc_id", "text", *[every("text", F.lit(p), F.lit(g)).alias(name) for name, p, g in (("m0", ASSIGN, 0), ("g0", ASSIGN, 2), ("m1", ACCESS, 0), ("m2", HEX, 0), ("m3", TOKEN, 0))])
    rows = rows.select("doc_id", "m3", "g0", *[_spans(F.col("text"), p, F.col(f"m{k}")).alias(f"s{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    long_enough = F.filter(F.arrays_zip(F.col("s0").alias("span"), F.col("g0").alias("value")), lambda x: F.length(x["value"]) >= ASSIGNED)
    tokens = F.transform(F.arrays_zip(F.col("s3").alias("span"), F.col("m3").alias("token")), lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["token"].alias("token")))
    rows = rows.select("doc_id", F.transform(long_enough, lambda x: x["span"]).alias("s0"), "s1", "s2", judged(tokens).alias("tokens"))
    found = write_table(rows, "secret-tokens")
    least = least_steps(found.select(F.inline("tokens")).select("band", "step"), false_share)

    def kind(spans: Column, number: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[kind(F.col(f"s{k}"), k) for k in range(3)])
    random = F.filter("tokens", lambda t: reduce(Column.__or__, [(t["band"] == b) & (t["step"] >= s) for b, s in least.items()], F.lit(False)))
    out = found.select("doc_id", *[F.size(f"s{k}").cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)], base.alias("base"), random.alias("random"))
    fresh = F.filter("random", lambda t: ~F.exists("base", lambda s: (s["start"] <= t["start"]) & (s["end"] >= t["end"])))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", kind(fresh, 3))).alias("spans")
    )
