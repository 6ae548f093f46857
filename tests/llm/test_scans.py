"""Licence scan and quality classifier against brute force and held-out labels."""

import random
import re
import zlib

from pyspark.sql import functions as F

from chartmill.llm.license_rules import Rule, rules
from chartmill.llm.license_scan import BASE, scan_licenses
from chartmill.llm.quality import FEATURES, SAMPLE_ROWS, accepted, fit, labelled_rows, score_quality, statistics

TEXTS = [
    None, "", "...", "nothing of the kind", "Licensed under CC BY-NC 4.0.", "cc by cc by CC\nBY", "This work is licensed under the GNU General Public License, version 3.",
    "All rights reserved. all RIGHTS, reserved", "Licensed under the Apache License, Version 2.0.", "Released under the MIT license.", "CC-BY-SA 4.0 international", "É all rights reservedé",
    "permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser General Public License v3", "accby occ by", "dedicated to the public domain",
    "SPDX-License-Identifier: BSD-3-Clause", "word " * 40_000 + "all rights reserved " * 500, "a_cc_by_b", "ÀCC BY", "cc by",
]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in BASE:
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_labels(text, table):
    line, found = " " + " ".join(words_of(text)) + " ", []
    for r in table:
        if r.keyword in line:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
                found.append((line[:m.start()].count(" ") - 1, line[:m.end()].count(" ") - 1, r.priority, r.label, r.weight))
    found.sort(key=lambda d: (d[0], -d[1], -d[2], d[3], d[4]))
    kept = []
    for k, d in enumerate(found):
        if not any(e[1] >= d[1] and e[2] >= d[2] for e in kept):
            kept.append(d)
    return {d[3] for d in kept}, max((d[4] for d in kept), default=0.0)


def test_scan_against_brute_force(documents):
    rng = random.Random(8)
    names = ["cc", "by", "nc", "sa", "4", "0", "gnu", "general", "public", "license", "licensed", "under", "the", "mit", "apache", "version", "2", "all", "rights", "reserved", "lesser", "x"]
    rows = list(enumerate(TEXTS + [" ".join(rng.choices(names, k=rng.randint(1, 60))) for _ in range(150)] + ["cc by", "cc by"]))
    got = {r.doc_id: r for r in scan_licenses(documents(rows)).collect()}
    for i, t in rows:
        r = got[i]
        base = brute_base(t)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base, t[:80]
        labels, weight = brute_labels(t, rules())
        assert r.labels == ",".join(sorted(labels | set(filter(None, base[4].split(","))))), t[:80]
        assert r.score == max(weight, 0.5 if base[4] else 0.0)


def test_containment_and_priority(documents):
    table = [Rule("long", "a", "a b c", 1, 0.2), Rule("inner", "a", "b", 1, 0.1), Rule("strong", "a", "b c", 3, 0.9), Rule("behind", "a", "c d", 2, 0.3)]
    row = scan_licenses(documents([(1, "licensed a b c d")]), table).first()
    # the strong one lies in the long one but outranks it; the short one lies in both
    assert (row.labels, row.score) == ("behind,long,strong", 0.9)


def test_rules_are_many_and_gated():
    table = rules()
    assert len(table) > 200
    for r in table:
        re.compile(r.pattern)


def shortest(pattern):
    """The shortest text of each alternative of an expression."""

    def texts(items):
        out = [""]
        for op, value in items:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "IN":
                first, what = str(value[0][0]), value[0][1]
                more = [chr(what) if first == "LITERAL" else chr(what[0]) if first == "RANGE" else "9" if "DIGIT" in str(what) else "x"]
            elif kind == "BRANCH":
                more = [t for branch in value[1] for t in texts(branch)]
            elif kind == "SUBPATTERN":
                more = texts(value[-1])
            elif kind == "MAX_REPEAT":
                more = texts(list(value[2]) * value[0])
            else:
                assert kind in ("ASSERT", "ASSERT_NOT"), kind
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    return texts(re._parser.parse(pattern))


def test_no_gate_or_anchor_drops_what_a_rule_matches(documents):
    table, examples = rules(), {"WTFPL", "licensed under the CDDL 1.0", "licensed under ODbL 1.0", "released under the Expat license", "zero clause license", "do what the fuck you want to public license"}
    rng = random.Random(4)
    for r in table:
        texts = shortest(r.pattern)
        assert all(r.keyword in t for t in texts), r
        examples |= {" ".join(t.split()) for t in rng.sample(texts, min(3, len(texts)))}
    rows = list(enumerate(sorted(examples)))
    got = {r.doc_id: r for r in scan_licenses(documents(rows)).collect()}
    for i, t in rows:
        labels, weight = brute_labels(t, [r._replace(keyword="") for r in table])
        base = set(filter(None, brute_base(t)[4].split(",")))
        assert weight and (got[i].labels, got[i].score) == (",".join(sorted(labels | base)), max(weight, 0.5 if base else 0.0)), t


def test_passed_rules_need_no_anchor(documents):
    assert scan_licenses(documents([(1, "some a b")]), [Rule("own", "a", "a b", 1, 0.2)]).first().labels == "own"


def test_scan_stays_on_the_jvm(spark, sf):
    from chartmill.llm.queries import QUERIES

    for name in ("op1_line_dedup", "op9_license_scan"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


# ---------------------------------------------------------------- quality
def test_statistics_of_odd_texts(documents):
    got = {r.doc_id: r for r in statistics(documents([(1, None), (2, ""), (3, " \n "), (4, "ÀB cd!! 12\nÀB"), (None, "x"), (5, "a " * 100_000)])).collect()}
    assert got[1][1:] == got[2][1:] and got[1].log_words == 0
    assert got[4].distinct_word_share == 0.75 and got[4].shouts_per_word == 0.5 and abs(got[4].upper_share - 4 / 6) < 1e-9
    assert all(v is not None for r in got.values() for v in r[1:])


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = fit(labelled_rows(docs, labels))
    scored = score_quality(docs, model).join(labels, "doc_id").filter("held_out").select("doc_id", "quality", "predicted", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored)
    low = [r for r in scored if r.quality == 0]
    assert sum(r.quality == r.predicted for r in scored) / len(scored) > 0.98
    assert sum(r.predicted == 0 for r in low) / len(low) > 0.9
    assert len(model.weighted) < 200 and {c.feature for path, _ in model.weighted for c in path} <= set(FEATURES)
    # the held-out rows' labels make no difference
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(labelled_rows(docs, other)) == model
    kept = accepted(docs.withColumn("lines", F.lit("clash")), model)
    assert kept.columns == [*docs.columns, "lines"]
    assert kept.count() == score_quality(docs, model).filter("predicted = 1").count()


def test_few_labels_are_learnt_and_one_label_rejects_nothing(spark, documents):
    docs = documents([(k, "good words in a row " * 9 if k % 2 else "!!! ### $$$") for k in range(16)])
    both = spark.createDataFrame([(k, k % 2, 0) for k in range(16)], "doc_id bigint, quality int, toxic int")
    rows = labelled_rows(docs, both)
    assert rows.count() < 20
    model = fit(rows)
    assert model.weighted and {r.doc_id for r in accepted(docs, model).collect()} == set(range(1, 16, 2))
    bad = fit(labelled_rows(docs, both.withColumn("quality", F.lit(0))))
    assert bad.weighted == () and accepted(docs, bad).count() == 16


def test_few_or_no_labels(spark, documents):
    docs = documents([(k, f"text {k}") for k in range(30)] + [(None, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = fit(labelled_rows(docs, none))
    assert {r.predicted for r in score_quality(docs, model).collect()} == {1}
    odd = spark.createDataFrame([(k, q, 0) for k in range(30) for q in (None, 1, 5)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert labelled_rows(docs, odd, SAMPLE_ROWS).count() == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(30))
    assert fit(labelled_rows(docs, odd)).weighted == ()
    assert score_quality(documents([]), model).collect() == []


def test_scores_are_those_of_the_rules(spark, sf):
    import math

    from chartmill.llm.quality import THRESHOLD, statistics

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "!!"), (None, "a b")], "doc_id bigint, text string"))
    model = fit(labelled_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    assert model.weighted
    want = []
    for row in statistics(docs).collect():
        total = model.intercept
        for path, weight in model.weighted:
            if all(row[c.feature] > c.threshold if c.above else row[c.feature] <= c.threshold for c in path):
                total += weight
        want.append((row.doc_id, round(1 / (1 + math.exp(-total)), 9)))
    scored = score_quality(docs, model).collect()
    assert sorted(((r.doc_id, round(r.score, 9)) for r in scored), key=str) == sorted(want, key=str)
    assert all(r.predicted == int(r.score >= THRESHOLD) for r in scored)
