"""Licence scan by ordered signature rules, on SQL functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import text_of
from chartmill.llm.license_rules import Rule, rules

# fixed values: characters of a word (letters of either case), and the base phrases with their labels
WORD = r"[0-9A-Za-z[^\x00-\x7F]]+"
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
BASE_WEIGHT = 0.5


def _may_match(text: Column) -> Column:
    """False only if no rule of ``rules()`` and no phrase can match: cheap searches for words that each of them needs."""
    low = F.lower(text)

    def holds(*words: str) -> Column:
        return reduce(Column.__and__, [low.contains(w) for w in words])

    always = ["licen", "rights", "copyright", "gpl", "spdx", "cc0", "proprietary", "permission", "permitted", "warranty", "wtfpl"]
    paired = [("general", "public"), ("mozilla", "public"), ("eclipse", "public"), ("domain", "public"), ("creative", "commons"), ("want", "public")]
    grants = ["released", "distributed", "available", "published", "provided", "offered", "shared", "covered"]
    granted = reduce(Column.__or__, [holds(w) for w in grants]) & text.rlike(rf"(?i)(?:{'|'.join(grants)})[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+(?:under|by|subject)")
    hits = [holds(w) for w in always] + [holds(*w) for w in paired] + [granted, text.rlike(r"(?i)(?<![0-9a-z])cc(?![0-9a-z])")]
    return reduce(Column.__or__, hits)


def _places(phrase: str, words: Column) -> Column:
    """Starts of a phrase in an array of words, counted from 0."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return hit

    first = F.transform(words, lambda w, i: F.when(here(i), i))
    return F.filter(first, lambda i: i.isNotNull())


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _matches(line: Column, rule: Column) -> Column:
    """Detections of one rule in the spaced words: first and last word of each match."""
    whole = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    between = F.split(line, whole)
    found = F.regexp_extract_all(line, whole, F.lit(0))
    # words before a match: the spaces of all pieces and matches before it
    step = F.transform(found, lambda m, i: F.struct(_spaces(F.get(between, i)).alias("gap"), _spaces(m).alias("inner")))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def add(state: Column, s: Column) -> Column:
        first = state["at"] + s["gap"]
        last = first + s["inner"]
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("first"), last.alias("last")))).alias("out"))

    spans = F.aggregate(step, start, add, lambda state: state["out"])
    return F.transform(spans, lambda s: F.struct(
        s["first"].alias("first"), (-s["last"]).alias("minus_last"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label"), rule["weight"].alias("weight")))


def _resolved(detections: Column) -> Column:
    """Labels and largest weight of the detections that no other one suppresses.

    A detection goes if its interval lies in that of one with higher priority,
    or in a longer or equal one of the same priority that comes before it.
    Detections are sorted by start, then longest, then priority: whatever can
    contain one stands before it, so the farthest end per priority decides.
    """
    levels = (1, 2, 3)
    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in levels], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def add(state: Column, d: Column) -> Column:
        last, priority = -d["minus_last"], -d["minus_priority"]
        farthest = F.greatest(*[F.when(F.lit(p) >= priority, state[f"end{p}"]).otherwise(-1) for p in levels])
        stays = farthest < last
        return F.struct(
            *[F.when(stays & (priority == p), F.greatest(state[f"end{p}"], last)).otherwise(state[f"end{p}"]).alias(f"end{p}") for p in levels],
            F.when(stays, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(stays, F.greatest(state["weight"], d["weight"])).otherwise(state["weight"]).alias("weight"),
        )

    return F.aggregate(F.array_sort(detections), start, add)


def scan_licenses(docs: DataFrame, signature_rules: list[Rule] | None = None) -> DataFrame:
    """Licence statements of each whole text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score`` for every row. A cheap search for anchor words picks the
    texts in which anything can match; there, a rule's expression runs only if
    its gate word occurs; rules that are passed are tried on every text.
    ``_resolved`` settles overlapping detections. Labels
    of base phrases always stay. ``score`` is the largest weight of what was
    found: 1 for a grant, less for a tag, a name or a base phrase, 0 for none.

    All work is row by row: no shuffle, no key that could be hot. Null and
    empty texts have no words and empty label lists. Null ids and repeated
    rows pass as they are; extra columns are not read.
    """
    table = F.array(*[
        F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"))
        for r in (rules() if signature_rules is None else signature_rules)
    ])
    rows = docs.select("doc_id", text_of().alias("text"))
    # the anchors are those of the package's own rules
    rows = rows.withColumn("may", _may_match(F.col("text")) if signature_rules is None else F.lit(True))
    spoken = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase))
    rows = rows.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("n_words"), F.when(F.col("may"), spoken).alias("words"))
    rows = rows.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    for k, (phrase, _) in enumerate(BASE):
        rows = rows.withColumn(f"at{k}", _places(phrase, F.col("words")))
    gated = F.filter(table, lambda r: F.col("line").contains(r["keyword"]))
    detections = F.flatten(F.transform(gated, lambda r: _matches(F.col("line"), r)))
    rows = rows.withColumn("found", F.when(F.col("line").isNotNull(), _resolved(detections)))
    places = F.concat(*[F.col(f"at{k}") for k in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "n_words", "found", places.alias("places"), base.alias("base"))
    weight = F.greatest(F.coalesce("found.weight", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(BASE_WEIGHT)).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"), F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        weight.alias("score"),
    )
