"""Registered queries against their SQL, and the pipeline's stages against brute force."""

import pytest
from pyspark.sql import functions as F
from check import compare, connect
from test_dedup import brute_components

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from chartmill.llm.quality import fit, labelled_rows, score_quality
from chartmill.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES} and set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(ORACLE_SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name]) is None


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "best-fit packing"]

    good = by_name["quality classifier"](spark, docs, sf)
    model = fit(labelled_rows(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    wanted = {r.doc_id for r in score_quality(docs, model).filter("predicted = 1").collect()}
    rows = {r.doc_id: r for r in good.collect()}
    assert set(rows) == wanted and good.columns == columns

    unique = by_name["exact dedup"](spark, good, sf)
    best = {}
    for r in rows.values():
        key = "".join(c for c in r.text or "" if c not in " \t\n\v\f\r")
        best[key] = min(best.get(key, (0, r.doc_id)), (-len(r.text or ""), r.doc_id)) if key in best else (-len(r.text or ""), r.doc_id)
    kept = {r.doc_id: r for r in unique.collect()}
    assert set(kept) == {i for _, i in best.values()} and unique.columns == columns

    distinct = by_name["n-gram Jaccard join"](spark, unique, sf)
    component = {i: c for i, _, c in brute_components([(r.doc_id, r.text) for r in kept.values()], 5, 80, 100)}
    assert {r.doc_id for r in distinct.collect()} == {i for i, c in component.items() if i == c} and distinct.columns == columns

    packed = by_name["best-fit packing"](spark, distinct, sf).collect()
    assert {r.doc_id for r in packed} == {i for i, c in component.items() if i == c}
    sums = {}
    for r in packed:
        sums[r.sequence_id] = sums.get(r.sequence_id, 0) + r.length
    assert max(sums.values()) <= 2048
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


ODD = [(1, None), (2, ""), (None, "x"), (3, "a b c"), (3, "a b c"), (4, "a  b c"), (5, "word " * 30_000), (6, "!!! $$$ ###")]
CLASHING = ["row", "_row", "id", "sha", "_sha", "kept", "_kept", "times", "_times", "score", "body", "h", "n", "size", "words", "lines", "component", "set_id"]


def labels_folder(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_survives_odd_rows_and_names(spark, documents, tmp_path, name, stage):
    # short junk is bad, prose is good: enough for a model with rules
    texts = [(100 + k, f"plain sentence number {k} about a day in town, with words of all kinds.") if k % 2 else (100 + k, "$$ !! " * (k % 7 + 1)) for k in range(60)]
    folder = labels_folder(spark, tmp_path, [(i, i % 2, 0) for i, _ in texts])
    docs = documents(ODD + texts).drop("kept", "size")
    wide = docs.withColumns({c: F.lit(7) for c in CLASHING})
    plain, clashing = (stage(spark, d, folder) for d in (docs, wide))
    key = [c for c in ("doc_id", "text", "piece", "start", "length") if c in plain.columns]
    assert sorted(map(str, plain.select(*key).collect())) == sorted(map(str, clashing.select(*key).collect()))
    if name == corpus_pipeline.STAGES[-1][0]:
        assert {r.doc_id for r in plain.collect()} == {i for i, _ in ODD + texts}
        return
    assert plain.columns == docs.columns and clashing.columns == wide.columns and all(r.kept == 7 for r in clashing.collect())
    left = [r.doc_id for r in plain.collect()]
    if name == "quality classifier":
        assert 159 in left and 100 not in left
    if name == "exact dedup":
        assert sorted(left, key=str) == sorted([1, None, 4, 5, 6, *{t: i for i, t in reversed(texts)}.values()], key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_no_rows(spark, documents, tmp_path, name, stage):
    assert stage(spark, documents([]), labels_folder(spark, tmp_path, [])).collect() == []
