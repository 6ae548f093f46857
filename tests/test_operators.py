"""Operators without a check query, against brute force on small fixtures."""

import datetime
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chartmill.functions.udfs import register
from chartmill.operators import convert as C
from chartmill.operators import dedup as D
from chartmill.operators import extract as E
from chartmill.operators import link as L
from chartmill.operators import merge as G
from chartmill.operators import report as R
from chartmill.operators import similar as X
from chartmill.operators import text as T
from chartmill.operators import weighted as W


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    first, last = ["anna", "anne", "hanna", "bo", "john", "jon", "johan"], ["meyer", "meier", "mayer", "smith", "smyth", "li"]
    return [(i, rng.choice(first), rng.choice(last), datetime.date(2000, 1, 1 if rng.random() < 0.4 else rng.randrange(2, 6))) for i in range(120)]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_similar_texts_finds_every_pair(spark, threshold):
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["text_a"], r["text_b"]) for r in X.similar_texts(df, [], "w", threshold).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and ratio(a, b) > threshold}


def test_duplicate_patients_like_greedy_scan(spark, names):
    df = spark.createDataFrame(names, "patient_id bigint, first_name string, last_name string, birth_date date")
    got = {r["patient_id"]: (r["birth_date"], r["leader_name"]) for r in X.duplicate_patients(df).collect()}
    order = sorted(names, key=lambda p: (p[2], p[1]))
    done, want = set(), {}
    for i, (pid, f, l, d) in enumerate(order):
        if pid in done:
            continue
        group = [pid] + [p2 for p2, f2, l2, d2 in order[i + 1:] if p2 not in done and d2 == d and ratio(f"{f} {l}", f"{f2} {l2}") > 0.8]
        if len(group) > 1:
            done.update(group)
            want.update({p: (d, f"{f} {l}") for p in group})
    assert got == want


def test_fuzzy_items_like_greedy_scan(spark):
    rng = random.Random(5)
    stems = ["hypertension", "hypertensions", "hypotension", "asthma", "asthma mild", "diabetes type 2", "diabetes type 1"]
    items = [(d, "conditions", i, rng.choice(stems), round(rng.random(), 3)) for d in range(6) for i in range(30)]
    df = spark.createDataFrame(items, "doc_id bigint, kind string, position bigint, name string, confidence double")
    want = set()
    for d in range(6):
        kept = []
        for item in [x for x in items if x[0] == d]:
            for i, other in enumerate(kept):
                if ratio(item[3], other[3]) > 0.85:
                    if item[4] > other[4]:
                        kept[i] = item
                    break
            else:
                kept.append(item)
        want |= set(kept)
    assert {tuple(r) for r in D.fuzzy_items(df).collect()} == want


def test_similar_and_equivalent_codes(spark):
    codes = spark.createDataFrame([("2093-3",), ("2093-4",), ("E11.9",), ("E11.8",), ("zzz",)], "c string")
    got = {(r["code"], r["similar"]) for r in X.similar_codes(codes, "c").collect()}
    assert got == {("2093-3", "2093-4"), ("2093-4", "2093-3"), ("E11.9", "E11.8"), ("E11.8", "E11.9")}
    eq = X.equivalent_codes(spark.createDataFrame([("2093-3", "LOINC"), ("E11.8", "OTHER")], "code string, system string")).collect()
    assert ("2093-3", "CHOL", "exact") in {(r["code"], r["target_code"], r["kind"]) for r in eq}
    assert any(r["code"] == "E11.8" and r["target_code"] == "E11.9" and r["kind"] == "related" for r in eq)


@pytest.mark.parametrize("threshold", [(0.8 - 0.3) / 0.7, 0.6, 0.85])
def test_bigram_index_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    stems = ["".join(rng.choice("0123456789e") for _ in range(rng.randrange(3, 13))) for _ in range(120)]
    codes = {"a", "ab", "aab", "aaaaaaaaaa", "aaaaaaaaab", "abababab", "babababa"}
    for stem in stems:
        for _ in range(4):
            k = rng.randrange(len(stem) + 1)
            codes.add(rng.choice([stem, stem[:k] + rng.choice("0e") + stem[k:], stem[:k] + stem[k + 1:], stem[::-1], stem[:k] + "9" + stem[k + 1:]]))
    codes = sorted(c for c in codes if c)
    want = {(a, b) for i, a in enumerate(codes) for b in codes[i + 1:] if SequenceMatcher(None, a, b).ratio() >= threshold - 1e-9}
    met = {(r.text_a, r.text_b) for r in X.candidates(spark.createDataFrame([(c,) for c in codes], "c string"), [], "c", threshold - 1e-9).collect()}
    assert want <= met and len(want) > 100
    if threshold > 0.8:
        assert len(met) < len(codes) ** 2 / 2 / 20


def test_mapping_table_wins(spark):
    codes = spark.createDataFrame([("2093-3", "loinc"), ("X1", "LOCAL"), ("E11.8", "OTHER")], "code string, system string")
    table = spark.createDataFrame([("X1", "local", "Y1", "ICD-10", 0.5, "exact"), ("X1", "LOCAL", "Z1", "CPT", 0.4, "equivalent")], X.MAPPING)
    got = {(r.code, r.target_code, r.kind) for r in X.equivalent_codes(codes, table).collect()}
    assert {g for g in got if g[0] == "X1"} == {("X1", "Y1", "exact"), ("X1", "Z1", "equivalent")}
    assert ("2093-3", "CHOL", "exact") not in got and ("E11.8", "E11.9", "related") in got


def test_chunks_cover_and_respect_size(spark):
    text = " ".join(f"Sentence number {i} by Dr. Who about mg. doses." for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "short. text")], "doc_id bigint, text string")
    rows = T.chunk_documents(df, 1000, 100).orderBy("doc_id", "chunk_id").collect()
    long = [r for r in rows if r["doc_id"] == 1]
    assert len(long) > 5 and all(r["overlap_text"] for r in long[:-1]) and long[-1]["overlap_text"] is None
    assert all(r["text"].startswith(p["overlap_text"]) for p, r in zip(long, long[1:]))
    assert [r["text"] for r in rows if r["doc_id"] == 2] == ["short. text"]
    register(spark)
    pieces = df.select("doc_id", "text", T.sentences(F.col("text")).alias("pieces"))
    udtf = spark.sql("SELECT doc_id, c.* FROM {p}, LATERAL sentence_chunks(text, pieces, 1000, 100) AS c", p=pieces).collect()
    assert {(r["doc_id"], r["chunk_id"], r["chunk_text"]) for r in udtf} == {(r["doc_id"], r["chunk_id"], r["text"]) for r in rows}


def test_section_chunks_break_at_sections(spark):
    text = ("word " * 150 + "\n\n\n\n") * 12
    rows = T.section_chunks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 2000, 100).orderBy("chunk_id").collect()
    assert rows[0]["start_index"] == 0 and rows[-1]["end_index"] == len(text)
    assert all(text[r["end_index"]] == "\n" for r in rows[:-1])
    assert all(b["start_index"] <= a["end_index"] for a, b in zip(rows, rows[1:]))


def test_page_lines_use_the_anchor(spark):
    fragments = [(1, 1, "a", 0.100, 0.1), (1, 1, "b", 0.108, 0.2), (1, 1, "c", 0.112, 0.3), (1, 1, "d", 0.300, 0.0)]
    df = spark.createDataFrame(fragments, "doc_id bigint, page int, text string, top double, left double")
    assert T.page_lines(df).first()["text"] == "a b\nc\nd"


def test_extracted_dates(spark):
    text = "Seen 2023-04-05, 04/05/2023 and March 3, 2024; born 1/2/49, on 30.02.2020, 25/12/2020 and 1899-01-01"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [(r["day"].isoformat(), r["confidence"]) for r in E.extract_dates(df, "2024-06-15").orderBy("position").collect()]
    assert got == [("2023-04-05", 0.95), ("2024-03-03", 0.9)]


@pytest.mark.parametrize("word, day, confidence", [
    ("12-May-2024", "2024-05-12", 0.85), ("(12May2024),", "2024-05-12", 0.7), ("3mar21", "2021-03-03", 0.6), ("Sept-03-1999", "1999-09-03", 0.85), ("2024.jan.5", "2024-01-05", 0.85), ("20230405", "2023-04-05", 0.7),
    ("25/12/20", "2020-12-25", 0.85), ("1/2/49", None, 0.75), ("12-May", None, 0.75), ("31-Feb-2020", None, 0.85), ("12-Mayor-2024", None, 0.85), ("May2024", None, 0.6), ("99999999", None, 0.7),
])
def test_words_that_are_dates(word, day, confidence):
    found = E._loose_date(word)
    assert (found and found.isoformat()) == (day if word != "1/2/49" else "2049-01-02")
    assert round(E._loose_confidence(word), 2) == confidence


def test_second_pass_grades(spark):
    df = spark.createDataFrame([(1, "on 12-May-2024 or 13May2024 or 4mar21 or 12-May or 20230405"), (2, None)], "doc_id bigint, text string")
    got = [(r["raw"], r["day"].isoformat(), r["confidence"], r["method"]) for r in E.extract_dates(df, "2024-06-15").orderBy("position").collect()]
    assert got == [("12-May-2024", "2024-05-12", 0.85, "fuzzy"), ("13May2024", "2024-05-13", 0.7, "fuzzy"), ("4mar21", "2021-03-04", 0.6, "fuzzy"), ("20230405", "2023-04-05", 0.7, "fuzzy")]


def test_find_existing_wildcards(spark):
    new = spark.createDataFrame([("n1", 1, "a", None), ("n2", 1, None, None), ("n3", 2, "a", "d")], "new_id string, b int, c string, d string")
    old = spark.createDataFrame([("o1", 1, "b", "x"), ("o2", 1, None, "y"), ("o3", 1, "a", "z")], "old_id string, b int, c string, d string")
    got = {r["new_id"]: r["old_id"] for r in L.find_existing(new, old, "new_id", "old_id", ["b"], ["c", "d"]).collect()}
    assert got == {"n1": "o2", "n2": "o1"}


def test_provenance_chain_stops_at_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 99)], "i bigint, p bigint")
    got = {r["i"]: (r["root"], r["depth"]) for r in L.provenance_chains(df, "i", "p").collect() if r["i"] != 4}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 5: (5, 0)}


def test_values_near_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.05), (3, 0.2), (4, -9.0), (5, -10.0), (6, 9.0), (7, 10.0), (8, 8.99)], "id int, v double").withColumn("k", F.lit(1))
    got = {r["id"]: r["near"] for r in D.values_near(df, ["k"], "v", F.col("id"), "near").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}


def test_merge_is_idempotent_and_reversible(spark):
    schema = "patient_id int, source_id int, resource_type string, resource_id string"
    old = spark.createDataFrame([(1, 10, "Condition", "a"), (1, 11, "Condition", "b"), (2, 10, "Condition", "c")], schema)
    new = spark.createDataFrame([(1, 10, "Condition", "a2"), (1, 12, "Condition", "d")], schema)
    once = G.merge_documents(old, new)
    twice = G.merge_documents(once, new)
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r["resource_id"] for r in once.collect()} == {"a2", "b", "c", "d"}
    fresh = spark.createDataFrame([(3, 13, "Condition", "x")], schema)
    assert sorted(G.roll_back(G.merge_documents(old, fresh), [13]).collect()) == sorted(old.collect())
    assert G.merge_documents(old, old.limit(0)).count() == 3


def test_confidence_strategy_falls_back_to_newest(spark):
    df = spark.sql("SELECT timestamp'2024-01-02' AS n, timestamp'2024-01-01' AS o, CAST(NULL AS DOUBLE) AS nc, 0.5D AS oc")
    rule = G.resolution(F.lit("confidence_based"), F.col("n"), F.col("o"), F.col("nc"), F.col("oc"))
    assert df.select(rule.alias("a")).first()["a"] == "keep_new"


def test_every_resource_is_linked_or_left(spark):
    from chartmill.plans.extraction import extraction_documents
    from chartmill.plans.roles import Tables

    rows = C.resource_rows(extraction_documents(Tables(spark, "/root/testdata/sf0.001"))).cache()
    assert rows.count() == rows.select("resource_id").distinct().count()
    bad = rows.filter("encounter_id IS NOT NULL AND resource_type IN ('Encounter', 'Practitioner', 'Organization', 'AllergyIntolerance')")
    assert bad.count() == 0 and rows.filter("encounter_id IS NOT NULL").count() > 0
    assert rows.filter("resource_type = 'Immunization' AND status = 'not-done' AND encounter_id IS NOT NULL").count() == 0


def test_captures_round_trip(spark, tmp_path):
    from chartmill.sources import readers, writers

    one = {"document_id": 7, "success": True, "response_data": {"conditions": [{"name": "Asthma", "confidence": 0.9, "source": {"text": "asthma", "start_index": 3, "end_index": 9}}], "clinical_date": "2024-01-02"}}
    (tmp_path / "llm_output_7.json").write_text(json.dumps(one, indent=1))
    rows = readers.read_extractions(spark, str(tmp_path / "llm_output_7.json")).first()
    assert rows["response_data"]["conditions"][0]["source"]["end_index"] == 9 and rows["response_data"]["immunizations"] is None
    fhir = {"document_id": 7, "patient_id": "p", "fhir_resources": [{"resourceType": "Condition", "id": "c1"}, {"resourceType": "Observation", "id": "o1", "valueQuantity": {"value": 2}}]}
    (tmp_path / "fhir_data_7.json").write_text(json.dumps(fhir))
    res = readers.read_resources(spark, str(tmp_path / "fhir_data_7.json"))
    assert [(r["ord"], r["resource_type"], r["resource_id"]) for r in res.orderBy("ord").collect()] == [(0, "Condition", "c1"), (1, "Observation", "o1")]
    (tmp_path / "errors.json").write_text('{"document_id": 1, "error_message": "x", "error_data": {"k": "v"}}\nnot json\n')
    errors = readers.read_errors(spark, str(tmp_path / "errors.json")).cache()
    assert errors.filter("_corrupt_record IS NOT NULL").count() == 1 and errors.filter("error_message = 'x'").count() == 1
    (tmp_path / "pdf_text_7.json").write_text(json.dumps({"document_id": 7, "text_content": "a\nb", "text_length": 3, "metadata": {"page_count": 2}}))
    assert readers.read_page_texts(spark, str(tmp_path / "pdf_text_7.json")).first()["metadata"]["page_count"] == 2
    assert readers.list_captures(spark, str(tmp_path), 7).count() == 3
    out = str(tmp_path / "csv")
    writers.write_csv(spark.createDataFrame([("a", 1), ("b", 2)], "section string, n int"), out, ["section"])
    assert spark.read.option("header", True).csv(out).count() == 2


def test_bundle_pages_hold_everything(spark):
    from chartmill.sources import writers

    rows = spark.range(2500).selectExpr("1 AS patient_id", "'Observation' AS resource_type", "CAST(id AS STRING) AS resource_id", "'c' AS code", "'b' AS body")
    pages = writers.bundles(rows, "2024-01-01T00:00:00Z", 1000).collect()
    assert {p["pages"] for p in pages} == {3} and sum(p["entries"] for p in pages) == 2500
    ids = [e["resource"]["id"] for p in pages for e in json.loads(p["bundle"])["entry"]]
    assert sorted(map(int, ids)) == list(range(2500))


def test_stream_merge_replaces_documents_over_runs(spark, tmp_path):
    from chartmill.streaming import jobs as J

    schema = "patient_id int, source_id int, v string"
    store = str(tmp_path / "store")
    feeds = [[(1, 1, "old"), (1, 1, "gone"), (2, 1, "x")], [(1, 1, "new")], [(2, 1, "x")]]
    for run, batch in enumerate(feeds):
        # every run has a checkpoint of its own, as after the loss of the old one
        feed = str(tmp_path / f"feed{run}")
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(feed)
        J.merge_stream(spark.readStream.schema(schema).parquet(feed), store, str(tmp_path / f"state{run}"))
    final = J.store_rows(spark, store, ["patient_id", "source_id"]).collect()
    assert sorted((r["patient_id"], r["v"]) for r in final) == [(1, "new"), (2, "x")]
    assert J.newest_version(spark, store) == 2


def test_kth_match_of_numeric_ids_and_a_key_with_most_rows(spark):
    left = spark.range(1, 1201).selectExpr("id AS a", "IF(id % 3 = 0, 'rare' || id, 'hot') AS name")
    right = spark.range(5001, 6201).selectExpr("id AS b", "IF((id - 5000) % 3 = 0, 'rare' || (id - 5000), 'hot') AS name")
    got = L.match_kth(left, right, ["name"], "a", "b").collect()
    assert len(got) == 1200 and all(r["b"] - r["a"] == 5000 for r in got)


def test_slices_split_a_hot_key_evenly(spark):
    from chartmill.operators.ordered import sliced

    rows = spark.range(8000).selectExpr("IF(id % 3 = 0, 1, id) AS k", "id AS t")
    sizes = [r["count"] for r in sliced(rows, ["k"], ["t"]).groupBy("__bucket").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * 8000 / len(sizes)


def test_sections_and_sentences_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")
    assert T.section_chunks(docs).collect() == []
    assert [tuple(r)[:5] for r in T.chunk_documents(docs).collect()] == [(1, 0, 0, 0, "")]


def test_merge_actions_keep_types_apart(spark):
    from chartmill.plans.queries_merge import PAIR_FIELDS

    def pair(kind, **given):
        return (kind, "same-id", *[given.get(f"{side}_{k}") for side in ("new", "old") for k in PAIR_FIELDS], True, False)

    columns = ", ".join(["resource_type string", "row_id string", *[f"{side}_{k} {t}" for side in ("new", "old") for k, t in PAIR_FIELDS.items()], "matched boolean", "duplicate boolean"])
    rows = spark.createDataFrame([pair("Observation", new_value=1.0, old_value=9.0), pair("MedicationStatement", new_status="a", old_status="a")], columns)
    got = {r["resource_type"]: (r["merge_action"], r["conflicts"]) for r in G.merge_actions(rows, "row_id").collect()}
    assert got == {"Observation": ("added_as_sequence", 1), "MedicationStatement": ("added", 0)}


def test_best_partner_against_all_pairs(spark):
    rng = random.Random(4)
    # a hot group of copies, near copies, missing values, several tokens
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["x y", "y z", "z", ""]), rng.choice([1, 2, None]), rng.choice(["1:", "11", ":"])) for k in range(150)] + [(200 + k, "a", "x y", 1, "11") for k in range(60)]
    frame = spark.createDataFrame(rows, "id int, family string, given string, born int, card string")
    tokens = F.filter(F.transform(F.split("given", " "), lambda g: F.concat("family", F.lit("|"), g)), lambda x: x.isNotNull())
    factors = [W.Factor("name", 2, tokens), W.equal("born", 2, "born"), W.equal("card", 1, "card", null_equals_null=True)]
    fields = ["family", "given", "born", "card"]

    def score(a, b):
        name = a[1] is not None and a[1] == b[1] and set(a[2].split(" ")) & set(b[2].split(" "))
        return (2 * bool(name) + 2 * (a[3] is not None and a[3] == b[3]) + (a[4] == b[4])) / 5

    want = []
    for a in rows:
        earlier = sorted((a[1:] != b[1:], -score(a, b), b[0], b) for b in rows if b[0] < a[0] and (a[1:] == b[1:] or score(a, b) >= 0.7))
        if earlier:
            other, s, i, b = earlier[0]
            same = ",".join(sorted(f for f, x, y in zip(fields, a[1:], b[1:]) if x == y))
            want.append((a[0], i, "exact" if not other else "near" if -s >= 0.9 else "fuzzy", -s if other else 1.0, same if other else "*"))
    assert sorted(tuple(r) for r in W.best_partner(frame, "id", factors, fields).collect()) == sorted(want)
    assert len({w[2] for w in want}) == 3


def test_too_many_signatures_are_refused():
    assert [w for _, w in W.signatures([W.Factor("a", 3, None), W.Factor("b", 2, None), W.Factor("c", 1, None)], 0.7)] == [6, 5]
    with pytest.raises(ValueError):
        W.signatures([W.Factor(str(k), 1, None) for k in range(12)], 0.5)


OBSERVATIONS = "patient_id bigint, obs_id string, code string, value double, unit string, at timestamp"


def _observations():
    rng = random.Random(11)
    start = datetime.datetime(2020, 1, 1)
    rows = [
        (rng.randrange(3), f"o{i:03d}", rng.choice("ab"), rng.choice([0.0, 0.05, 1.0, 1.1, 2.0, -1.0, None]), rng.choice(["mg", "ml", None]), start + datetime.timedelta(hours=rng.randrange(200)) if rng.random() < 0.9 else None)
        for i in range(120)
    ]
    return rows + [(None, "x1", "a", 1.0, "mg", start), (None, "x2", "a", 1.0, "mg", start), (1, "x3", None, 1.0, "mg", start)]


@pytest.mark.parametrize("most", [0, 15, 1000])
def test_observation_groups_and_distances_judge_alike(spark, monkeypatch, most):
    monkeypatch.setattr(D, "SMALL_GROUP", most)
    rows = _observations()
    df = spark.createDataFrame(rows, OBSERVATIONS)
    fields = ["at", "code", "patient_id", "unit", "value"]
    got = {r["obs_id"]: tuple(r)[2:] for r in D.judged_observations(df, F.col("obs_id"), fields=fields).collect()}

    def near(a, b):
        if a is None or b is None:
            return False
        return abs(a - b) <= 0.1 if 0 in (a, b) else abs(a - b) * 10 <= max(abs(a), abs(b)) * (1 + 1e-12)

    want = {}
    for p, i, c, v, u, at in rows:
        met = {"copy": [], "both": [], "value": [], "time": []}
        for q, j, d, w, x, when in rows:
            if None in (p, c) or (p, c) != (q, d) or j >= i:
                continue
            time = None not in (at, when) and abs(at - when) <= datetime.timedelta(hours=24)
            value = u is not None and u == x and near(v, w)
            copy = value and v == w and at is not None and at == when
            for name, hit in [("copy", copy), ("both", time and value), ("value", value), ("time", time)]:
                met[name] += [j] if hit else []
        first = next((n for n in met if met[n]), None)
        if first is None:
            want[i] = (None, None, None, None)
            continue
        q, j, d, w, x, when = next(r for r in rows if r[1] == min(met[first]))
        same = ",".join(n for n, y, z in [("at", at, when), ("code", c, d), ("patient_id", p, q), ("unit", u, x), ("value", v, w)] if y == z)
        kind = {"copy": "exact", "both": "near"}.get(first, "fuzzy")
        want[i] = (kind, j, {"value": 0.875, "time": 0.75}.get(first, 1.0), "*" if kind == "exact" else same)
    assert got == want


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("latest", [True, False])
def test_equivalent_observations_like_brute_force(spark, monkeypatch, most, latest):
    monkeypatch.setattr(D, "SMALL_GROUP", most)
    rows = [r for r in _observations() if r[3] is not None and r[4] is not None]
    got = {r["obs_id"] for r in D.equivalent_observations(spark.createDataFrame(rows, OBSERVATIONS), F.col("obs_id"), keep_latest=latest).collect()}

    def star(a):
        met = {b[1] for b in rows if None not in (a[0], a[2], a[5], b[5]) and (a[0], *a[2:5]) == (b[0], *b[2:5]) and abs(a[5] - b[5]) <= datetime.timedelta(hours=24)}
        return met | {a[1]}

    if latest:
        lost = {i for a in rows for i in star(a) if i != max(star(a))}
        assert got == {r[1] for r in rows} - lost
    else:
        assert got == {r[1] for r in rows if min(star(r)) == r[1]}


@pytest.mark.parametrize("name", ["weighted_duplicates", "bundle_dedup_by_confidence", "equivalent_observations_latest", "equivalent_observations_first"])
def test_observations_travel_once_as_groups(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4 and "Window" not in plan


def test_conversion_writes_no_rows_aside(spark):
    from chartmill.plans.extraction import extraction_documents
    from chartmill.plans.roles import Tables

    rows = C.resource_rows(extraction_documents(Tables(spark, "/root/testdata/sf0.001")))
    assert "conversion-rows" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_report_pages_of_small_and_large_sections(spark, monkeypatch, small):
    from chartmill.operators import report as R

    monkeypatch.setattr(R, "SMALL_SECTION", small)
    rng = random.Random(2)
    rows = [(1 + (i > 30), rng.choice(["conditions", "allergies"]), f"i{i:02d}", "t", rng.choice(["active", None]), None, rng.choice([None, "2001", "2001-02", "2001-02-03"])) for i in range(40)]
    df = spark.createDataFrame(rows, "patient_id bigint, section string, item_id string, title string, status string, detail string, day string")
    people = spark.createDataFrame([(p, "m", "a", "b", datetime.date(2000, 1, 1), "x", "y", "z") for p in (1, 2, 3)], "patient_id bigint, mrn string, first_name string, last_name string, birth_date date, gender string, living_setting string, phone string")
    got = {}
    for r in R.full_report(people, df, 3).collect():
        for s in r["sections"]:
            for x in s["items"]:
                got[(r["patient_id"], s["section"], x["place"])] = (r["page"], x["item_id"], s["total"], s["active"], r["total_resources"])
    want = {}
    for p, k in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == (p, k)), key=lambda r: r[2])
        own = sorted((r for r in own if r[6]), key=lambda r: r[6], reverse=True) + [r for r in own if not r[6]]
        for n, r in enumerate(own, 1):
            want[(p, k, n)] = ((n - 1) // 3, r[2], len(own), sum(x[4] == "active" for x in own), sum(x[0] == p for x in rows))
    assert got == want


def test_merge_run_counts_move_no_whole_rows(spark):
    schema = "patient_id int, resource_type string, resource_id string, source_id int, code string, body string, updated_at timestamp, confidence double"
    old = spark.createDataFrame([(1, "A", "o1", 1, "c", "b", None, 0.5), (1, "A", "o2", 2, "c", "b", None, 0.9), (1, "B", "o3", 2, "c", "b", None, 0.9), (2, "A", "o4", 1, None, "b", None, None)], schema)
    new = spark.createDataFrame([(1, "A", "n1", 1, "c", "b", None, 0.5), (1, "A", "n2", 1, "d", "b", None, 0.5), (1, " ", "n3", 2, "d", "b", None, 0.5), (3, "C", "n4", 1, "d", None, None, 0.5), (3, "C", "n4", 1, "d", None, None, 0.5)], schema)
    run = G.merge_run(old, new, "2024-06-15 00:00:00")
    assert sorted(tuple(r) for r in run["counts"].select("resource_type", "merged", "kept", "incoming").collect()) == [("A", 4, 3, 2), ("B", 1, 1, 0), ("C", 2, 1, 2)]
    kept = {r["resource_type"]: r["count"] for r in run["store"].groupBy("resource_type").count().collect()}
    assert kept == {"A": 3, "B": 1, "C": 1}
    plan = run["counts"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("min_by") == 0 and plan.count("LeftAnti") == 1


@pytest.mark.parametrize("most", [0, 3, 256])
def test_find_existing_of_small_and_large_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(L, "SMALL_BLOCK", most)
    rng = random.Random(21)
    pick = lambda k, p: (f"{p}{k:03d}", rng.choice([1, 2, 2, 2, None]), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]))
    old, new = [pick(k, "o") for k in range(14)], [pick(k // 2, "n") for k in range(60)]
    want = {}
    for n, b, c, d in new:
        met = [o for o, ob, oc, od in old if b is not None and ob == b and (c is None or oc is None or c == oc) and (d is None or od is None or d == od)]
        if met:
            want[n] = min([*met, *([want[n]] if n in want else [])])
    frames = [spark.createDataFrame(rows, f"{i} string, b int, c string, d string") for rows, i in ((new, "new_id"), (old, "old_id"))]
    found = L.find_existing(*frames, "new_id", "old_id", ["b"], ["c", "d"])
    rows = found.collect()
    assert {r["new_id"]: r["old_id"] for r in rows} == want and len(rows) == len(want)
    # the rows of small blocks are not multiplied by the sets of criteria
    assert ("Generate" in found._jdf.queryExecution().executedPlan().toString()) == (most < 256)


def test_comprehensive_report_of_small_and_large_sections(spark, monkeypatch):
    rng = random.Random(25)
    rows = [(rng.randint(1, 4), rng.choice(["conditions", "observations"]), f"i{k:02d}", "t", rng.choice(["active", "x", None]), "d", rng.choice(["2000-01-01", "2001-02-03", None])) for k in range(60)]
    frame = spark.createDataFrame(rows, "patient_id bigint, section string, item_id string, title string, status string, detail string, day string")
    obs = spark.createDataFrame([(1, "Glucose")], "patient_id bigint, test_name string")
    visits = spark.createDataFrame([(1, datetime.date(2000, 1, 1))], "patient_id bigint, visit_date date")
    want = {}
    for p, s in {(r[0], r[1]) for r in rows}:
        own = sorted([r for r in rows if r[:2] == (p, s)], key=lambda r: r[2])
        newest = sorted(own, key=lambda r: r[6] or "", reverse=True)  # stable, undated last
        want[p, s] = (len(own), sum(r[4] == "active" for r in own), [(k + 1, r[2], r[6]) for k, r in enumerate(newest[:3])])
    for most in (1000, 8, 0):
        monkeypatch.setattr(R, "SMALL_SECTION", most)
        report = R.comprehensive_report(frame, obs, visits, 3)
        got = {(r.patient_id, s.section): (s.total, s.active, [(i.place, i.item_id, i.day) for i in s["items"]]) for r in report.collect() for s in r.sections}
        assert got == want
        if most == 1000:  # the rows are read once and meet their totals where they are
            plan = R._newest_of_small(frame, 3).groupBy("patient_id").agg(F.collect_list("items"))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1


def test_settled_provenance_items_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") % 4 != 0, F.col("id") - 1).alias("p"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = L.provenance_chains(rows, "i", "p").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.i, r.root, r.depth) for r in out) == [(k, k - k % 4, k % 4) for k in range(4000)]
    tasks = [r.task for r in out]
    assert max(tasks.count(t) for t in set(tasks)) < 1000


def test_best_partner_moves_no_fields_by_key(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", None), (4, None, "c")], "id int, x string, y string")
    factors = [W.equal("x", 3, "x"), W.equal("y", 1, "y", null_equals_null=True)]
    out = W.best_partner(rows, "id", factors, ["x", "y"])
    assert sorted(tuple(r) for r in out.collect()) == [(2, 1, "exact", 1.0, "*"), (3, 1, "fuzzy", 0.75, "x")]
    by_key = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(set" in line]
    aggregates = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "functions=" in line and "min(" in line]
    assert by_key and aggregates and not any("__fields" in line for line in aggregates)
