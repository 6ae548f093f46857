"""Information extraction from text."""

from __future__ import annotations

import calendar
import datetime
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.functions.fixed import (
    DATE_FAMILIES, MONTHS, PATIENT_FIELDS, FALLBACK_FIELDS, FALLBACK_MEDICATION, FALLBACK_DIAGNOSIS,
    MEDICATION_LINES, ALLERGY_LINES, PROCEDURE_PATTERNS, REPORT_DATES, CONCLUSIONS, SERVICE_PATTERNS,
    SERVICE_DATES, SERVICE_REASONS, PLAN_VERBS,
)
from chartmill.operators.text import spread, strip


# ---------------------------------------------------------------- dates
def _date_of(shape: str, parts: tuple[str, ...]) -> datetime.date | None:
    """Date of the three parts of a match, None if no calendar has it; two-digit years are of 1950 to 2049."""
    named = dict(zip(shape, parts))
    year = int(named["y"])
    if year < 100 and shape != "ymd":
        year += 2000 if year < 50 else 1900
    month = MONTHS.index(named["b"][:3].lower()) + 1 if "b" in named else int(named["m"])
    try:
        return datetime.date(year, month, int(named["d"]))
    except ValueError:
        return None


# shapes of a single word that is a date; years must be given, for a missing one would be that of the run
_DIGIT = re.compile(r"\d")
_LOOSE = [(re.compile(p, re.IGNORECASE), shape) for p, shape in (
    (r"\D*(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})\D*", "ymd"),
    (r"\W*(\d{1,2})[/.\-]?([a-z]{3,9})[/.\-]?(\d{4}|\d{2})\W*", "dby"),
    (r"\W*([a-z]{3,9})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\W*", "bdy"),
    (r"\W*(\d{4})[/.\-]?([a-z]{3,9})[/.\-]?(\d{1,2})\W*", "ybd"),
    (r"\W*(\d{4})(\d{2})(\d{2})\W*", "ymd"),
)]


def _loose_date(token: str) -> datetime.date | None:
    """Date of a word: digits around two separators in whatever order of day and month fits, a named month, or eight digits."""
    parts = re.fullmatch(r"\D*(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{1,4})\D*", token)
    if parts:
        a, b, c = parts.groups()
        # beyond 31 it is a year
        return _date_of("ymd" if int(a) > 31 else "mdy" if int(a) <= 12 else "dmy", (a, b, c))
    for pattern, shape in _LOOSE:
        parts = pattern.fullmatch(token)
        if not parts:
            continue
        word = parts.group(shape.index("b") + 1).lower() if "b" in shape else None
        if word is None or any(m.lower().startswith(word) for m in calendar.month_name[1:]):
            return _date_of(shape, parts.groups())
    return None


def _loose_confidence(token: str) -> float:
    """.60 for a word, more for a long one and for one with separators."""
    return min(0.60 + (0.10 if len(token) >= 8 else 0.0) + (0.15 if any(c in token for c in "/-.") else 0.0), 0.85)


def dates_in_text(text: str, latest: datetime.date) -> list[tuple]:
    """Hits (position, raw, day, confidence, method) of one text.

    Words that no family matches are tried loosely; whether a word begins in a
    match is looked up in the running maximum of the matches' ends. Of hits of
    one day less than 20 characters apart the most confident one counts, of
    equals the one found first.
    """
    found = [(m, shape, confidence) for pattern, shape, confidence in DATE_FAMILIES for m in re.finditer(pattern, text, re.IGNORECASE)]
    hits = [(m.start(), m.group(0), _date_of(shape, m.groups()), confidence, "regex") for m, shape, confidence in found]
    spans = sorted(m.span() for m, _, _ in found)
    begins, reach = [b for b, _ in spans], list(accumulate((e for _, e in spans), max))
    for m in re.finditer(r"\S+", text):
        # no shape of a date is without a digit
        if not _DIGIT.search(m.group(0)):
            continue
        before = bisect_right(begins, m.start())
        if not before or reach[before - 1] < m.start():
            hits.append((m.start(), m.group(0), _loose_date(m.group(0)), round(_loose_confidence(m.group(0)), 2), "fuzzy"))
    kept: dict[tuple, list] = {}
    for number, hit in enumerate(hits):
        position, _, day, confidence, _ = hit
        if day is None or not datetime.date(1900, 1, 1) <= day <= latest:
            continue
        # cells of 20 characters: whatever is near lies in this cell or beside it
        around = [kept.get((day, position // 20 + cell), []) for cell in (-1, 0, 1)]
        near = min(((n, cell, other) for cell in around for n, other in cell if abs(other[0] - position) < 20), default=None, key=lambda x: x[0])
        if near and confidence <= near[2][3]:
            continue
        if near:
            near[1].remove((near[0], near[2]))
        kept.setdefault((day, position // 20), []).append((number, hit))
    return [hit for cell in kept.values() for _, hit in cell]


def extract_dates(docs: DataFrame, today: str) -> DataFrame:
    """Dated mentions of each document with confidence; dates up to a year after ``today`` count."""
    latest = (pd.Timestamp(today) + pd.DateOffset(years=1)).date()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(doc, *hit) for doc, text in zip(batch.doc_id, batch.text) for hit in dates_in_text(text or "", latest)]
            yield pd.DataFrame(hits, columns=["doc_id", "position", "raw", "day", "confidence", "method"])

    return spread(docs.select("doc_id", "text")).mapInPandas(scan, "doc_id bigint, position int, raw string, day date, confidence double, method string")


def context_window(text: Column, position: Column, before: int = 50, after: int = 100) -> Column:
    """Text around a 0-based position."""
    start = F.greatest(F.lit(0), position - before)
    return text.substr(start + 1, position + after - start)


def date_mentions(docs: DataFrame) -> DataFrame:
    """Number of ISO, month-first and month-name dates per document, on the JVM only."""
    families = {"ymd": DATE_FAMILIES[1][0], "slash": DATE_FAMILIES[0][0], "month_name": DATE_FAMILIES[3][0]}
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(p)).cast("bigint").alias(n) for n, p in families.items()])


# ---------------------------------------------------------------- labelled fields
def patient_fields(docs: DataFrame) -> DataFrame:
    """Labelled patient fields ``(doc_id, label, value, confidence)``; the first pattern that matches wins."""
    rows = []
    for label, (confidence, patterns) in PATIENT_FIELDS.items():
        value = strip(S.first_match(F.col("text"), patterns, 1))
        if label == "sex":
            upper = F.upper(value)
            value = F.when(upper.isin("M", "MALE"), "Male").when(upper.isin("F", "FEMALE"), "Female").otherwise(upper)
        rows.append(F.struct(F.lit(label).alias("label"), value.alias("value"), F.lit(confidence).alias("confidence")))
    return docs.select("doc_id", F.inline(F.array(*rows))).filter("value IS NOT NULL")


def fallback_fields(docs: DataFrame) -> DataFrame:
    """Last-resort fields from raw text."""
    rows = [F.struct(F.lit(k).alias("label"), strip(S.first_match(F.col("text"), p, 1)).alias("value")) for k, p in FALLBACK_FIELDS.items()]
    return docs.select("doc_id", F.inline(F.array(*rows))).filter("value IS NOT NULL")


def fallback_lists(docs: DataFrame) -> DataFrame:
    """Distinct medications and diagnoses of raw text in long form."""

    def hits(patterns, group):
        found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), F.lit(group)) for p in patterns]))
        return F.array_distinct(F.transform(found, strip))

    rows = F.concat(
        F.transform(hits(FALLBACK_MEDICATION, 0), lambda v: F.struct(F.lit("medication").alias("kind"), v.alias("value"))),
        F.transform(hits(FALLBACK_DIAGNOSIS, 1), lambda v: F.struct(F.lit("diagnosis").alias("kind"), v.alias("value"))),
    )
    return docs.select("doc_id", F.inline(rows))


def diagnoses(docs: DataFrame) -> DataFrame:
    """Problem-list entries and pre- and post-operative diagnoses."""
    text = F.col("text")
    section = F.regexp_extract(text, r"(?sm)PROBLEM LIST(.*?)(?:^[A-Z\s]+:|\z)", 1)
    entry = r"(?s)Problem Name:\s*([^\n]+).*?Life Cycle Status:\s*([^\n]+)"
    names, states = F.regexp_extract_all(section, F.lit(entry), F.lit(1)), F.regexp_extract_all(section, F.lit(entry), F.lit(2))
    problems = F.zip_with(names, states, lambda n, s: F.concat(strip(n), F.lit(" ("), strip(s), F.lit(")")))
    before = strip(F.regexp_extract(text, r"(?s)PREOPERATIVE DIAGNOSIS:(.*?)(?:POSTOPERATIVE|PROCEDURE|\z)", 1))
    after = strip(F.regexp_extract(text, r"(?s)POSTOPERATIVE DIAGNOSIS:(.*?)(?:PROCEDURE|SURGEON|\z)", 1))
    all_ = F.concat(problems, F.array_compact(F.array(
        F.when(before != "", F.concat(F.lit("Preoperative: "), before)), F.when(after != "", F.concat(F.lit("Postoperative: "), after)))))
    return docs.select("doc_id", F.posexplode(all_).alias("ord", "diagnosis"))


def medication_lines(docs: DataFrame) -> DataFrame:
    """Medication entries in pattern order; a line two patterns find appears twice."""
    text = F.col("text")
    entry = r"(?s)Medication Name:\s*([^\n]+).*?Ingredients:\s*([^\n]+)"
    named = F.zip_with(
        F.regexp_extract_all(text, F.lit(entry), F.lit(1)), F.regexp_extract_all(text, F.lit(entry), F.lit(2)),
        lambda n, i: F.concat(strip(n), F.lit(" ("), strip(i), F.lit(")")),
    )
    lines = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), strip) for p in MEDICATION_LINES]
    return docs.select("doc_id", F.posexplode(F.concat(named, *lines)).alias("ord", "medication"))


def allergies(docs: DataFrame) -> DataFrame:
    """Items of the first allergy line."""
    line = strip(S.first_match(F.col("text"), ALLERGY_LINES, 1))
    items = F.filter(F.transform(F.split(line, r"[,;]\s*"), strip), lambda x: x != "")
    return docs.withColumn("__line", line).filter("__line IS NOT NULL").select("doc_id", F.posexplode(F.when(F.size(items) > 1, items).otherwise(F.array(line))).alias("ord", "allergy"))


def key_value_fields(docs: DataFrame) -> DataFrame:
    """``key: value`` lines as fields with confidence 0.7."""
    # every run of words matches and is left behind whole, also one without a value, so a text is passed over once
    pattern = r"([A-Za-z][A-Za-z0-9\s]*+)(?::\s*([^:\n]+))?"
    pairs = F.zip_with(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)),
        lambda k, v: F.struct(strip(k).alias("label"), strip(v).alias("value")),
    )
    return docs.select("doc_id", F.inline(pairs)).filter("length(label) >= 2 AND length(value) >= 1").withColumn("confidence", F.lit(0.7))


# ---------------------------------------------------------------- stored answers
def parse_answers(docs: DataFrame) -> DataFrame:
    """Stored model answers to JSON: as it is, cleaned of fences, or the fenced block inside.

    Adds ``strategy`` and ``parsed`` (variant). Text without JSON gets strategy
    'key_value' or 'patterns', to be read by those extractors.
    """
    raw = strip(F.col("text"))
    clean = F.regexp_replace(F.regexp_replace(raw, r"^```json\s*", ""), r"\s*```$", "")
    fence = strip(F.regexp_extract(raw, r"(?s)```(?:json)?(.*?)```", 1))

    def as_object(column):
        return F.when(column.rlike(r"(?s)^\{.*\}$"), F.try_parse_json(column))

    steps = docs.withColumns({"__a": as_object(raw), "__b": as_object(clean), "__c": as_object(fence)})
    pairs = raw.rlike(r"[A-Za-z][A-Za-z0-9\s]*?:\s*[^:\n]+")
    strategy = (
        F.when(F.col("__a").isNotNull(), "direct").when(F.col("__b").isNotNull(), "sanitized").when(F.col("__c").isNotNull(), "code_block")
        .when(pairs, "key_value").otherwise("patterns")
    )
    return steps.withColumns({"strategy": strategy, "parsed": F.coalesce("__a", "__b", "__c")}).drop("__a", "__b", "__c")


def answer_fields(parsed: DataFrame) -> DataFrame:
    """Fields ``(doc_id, label, value, confidence, source_text)`` of parsed answers.

    A member is either a plain value (confidence 0.9) or an object with value,
    confidence and source_text.
    """
    members = F.from_json(F.to_json("parsed"), "map<string,string>")
    rows = parsed.filter("parsed IS NOT NULL").select("doc_id", F.explode(members).alias("label", "member"))
    nested = F.col("member").rlike(r"^\{.*\"value\".*\}$")
    return rows.select(
        "doc_id", "label", F.when(nested, F.get_json_object("member", "$.value")).otherwise(F.coalesce("member", F.lit(""))).alias("value"),
        F.coalesce(F.when(nested, F.get_json_object("member", "$.confidence").cast("double")), F.lit(0.9)).alias("confidence"),
        F.coalesce(F.when(nested, F.get_json_object("member", "$.source_text")), F.lit("")).alias("source_text"),
    )


# ---------------------------------------------------------------- reports and service requests
def parse_diagnostic(column: Column, context: Column) -> Column:
    """struct(procedure_type, date, conclusion) of one report text."""
    text, low, ctx = strip(column), F.lower(strip(column)), F.lower(context)
    named = S.first_match(low, ["(?i)" + p for p in PROCEDURE_PATTERNS], 1)
    test = F.regexp_extract(text, r"(?i)([A-Za-z\s]+)\s*(?:test|level|count)", 1)
    guess = (
        F.when(ctx.contains("lab") | low.contains("test"), F.when(test != "", F.concat(strip(test), F.lit(" test"))).otherwise("Laboratory test"))
        .when(ctx.contains("ekg") | low.contains("ecg"), "EKG").when(ctx.contains("imaging"), "Imaging study")
        .otherwise(F.substring_index(S.squeeze(text), " ", 3))
    )
    kind = F.coalesce(named, guess)
    rest = F.regexp_replace(strip(F.replace(low, F.lower(kind), F.lit(""))), r"^[:\-\s]+", "")
    said = strip(S.first_match(low, CONCLUSIONS, 1))
    return F.struct(
        kind.alias("procedure_type"), S.first_match(text, REPORT_DATES, 1).alias("date"),
        F.coalesce(F.when(said != "", said), F.when(rest != "", rest)).alias("conclusion"),
    )


def split_reports(column: Column) -> Column:
    return F.filter(F.transform(F.split(column, r"[;\n|]"), strip), lambda x: x != "")


def parse_service_request(column: Column) -> Column:
    """struct(service, date, priority, reason) of one request text."""
    text, low = strip(column), F.lower(strip(column))
    urgent = S.first_match(low, [r"\b(urgent|stat|asap|emergency)\b", r"\b(routine|standard)\b"], 1)
    return F.struct(
        F.coalesce(strip(S.first_match(low, SERVICE_PATTERNS, 1)), text).alias("service"), S.first_match(low, SERVICE_DATES, 1).alias("date"),
        F.when(urgent.isin("urgent", "stat", "asap", "emergency"), "urgent").otherwise("routine").alias("priority"),
        strip(S.first_match(low, SERVICE_REASONS, 1)).alias("reason"),
    )


def plan_requests(docs: DataFrame) -> DataFrame:
    """Requests named in plan or recommendation text."""
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)) for p in PLAN_VERBS]))
    return docs.select("doc_id", F.posexplode(F.filter(F.transform(found, strip), lambda s: s != "")).alias("ord", "service"))


# ---------------------------------------------------------------- snippets
def locate_value(text: Column, value: Column) -> Column:
    """0-based position of a value: exact, any case, two-word phrase, first word; -1 if absent."""
    low = F.lower(text)
    words = F.filter(F.split(F.regexp_replace(F.lower(value), r"[^\w\s]", ""), r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
    phrases = F.filter(F.transform(pairs, lambda p: F.position(p, low)), lambda x: x > 0)
    first = F.element_at(F.split(strip(value), r"\s+"), 1)
    word = F.regexp_instr(low, F.concat(F.lit(r"\b\Q"), F.lower(first), F.lit(r"\E\b")))
    hit = F.coalesce(
        F.nullif(F.position(value, text), F.lit(0)), F.nullif(F.position(F.lower(value), low), F.lit(0)),
        F.when(F.size(words) > 1, F.get(phrases, 0)), F.nullif(word, F.lit(0)),
    )
    return F.coalesce(hit, F.lit(0)) - 1


def snippets(rows: DataFrame, length: int = 300) -> DataFrame:
    """Position and cleaned surrounding text of ``value`` in ``text``."""
    half = length // 2
    rows = rows.withColumn("position", locate_value(F.col("text"), F.col("value")))
    start = F.greatest(F.lit(0), F.col("position") - half)
    end = F.least(F.length("text"), F.col("position") + F.length("value") + half)
    cut = S.squeeze(F.col("text").substr(start + 1, end - start))
    return rows.withColumns({"found": F.col("position") >= 0, "snippet": F.when(F.col("position") >= 0, cut).otherwise("")})


def line_and_column(text: Column, position: Column) -> Column:
    """struct(line, column), both from 1, of a 0-based position."""
    head = text.substr(F.lit(1), position)
    outside = (position < 0) | (position >= F.length(text))
    last = F.substring_index(head, "\n", -1)
    return F.struct(
        F.when(outside, 1).otherwise(F.regexp_count(head, F.lit("\n")) + 1).alias("line"),
        F.when(outside, 1).otherwise(F.length(last) + 1).alias("column"),
    )


def relative_position(text: Column, start: Column, value: Column, length: int = 300) -> Column:
    """0-based position of a value inside the snippet that begins at ``start``; -1 if absent."""
    snippet = text.substr(start + 1, F.lit(length))
    return F.coalesce(F.nullif(F.position(value, snippet), F.lit(0)), F.position(F.lower(value), F.lower(snippet))) - 1


def snippet_issues(source: Column, position: Column) -> Column:
    return S.issues(
        (source.isNull(), "missing"), (strip(source) == "", "empty"), ((F.length(source) < 50) & (strip(source) != ""), "short"),
        (F.length(source) > 500, "long"), (position < 0, "negative position"),
    )


def truncate_snippet(column: Column, limit: int = 200) -> Column:
    """Shorten at the last blank when that keeps over 80 percent, else hard."""
    head = F.substring(column, 1, limit)
    words = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    keep = head.contains(" ") & (F.length(words) > limit * 0.8)
    return F.when(F.length(column) <= limit, column).otherwise(F.concat(F.when(keep, words).otherwise(head), F.lit("...")))


def snippet_stats(rows: DataFrame) -> DataFrame:
    n, filled = F.count("*"), F.count_if(strip(F.col("snippet")) != "")
    return rows.groupBy("doc_id").agg(
        n.alias("snippets"), S.half_up(F.avg(F.length("snippet")), 1).alias("avg_length"), F.count("position").alias("with_position"),
        (n - filled).alias("empty"), S.percent(F.count("position"), n).alias("position_coverage"), S.percent(filled, n).alias("content_coverage"),
    )
