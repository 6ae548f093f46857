"""Captured files as a data source."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from chartmill.sources import captures as C


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(content)
    return path


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_files_are_described_by_their_names(spark, folder):
    for k, name in enumerate(["error_ai_step_5.json", "pdf_text_5.json", "llm_output_6.json", "fhir_data_7.json", "raw_llm_response_5.json", "notes.txt", "error_x.json", ".hidden"]):
        os.utime(put(folder, name, "{}" + " " * k), (1000 + k, 1000 + k))
    os.mkdir(os.path.join(folder, "llm_output_9.json"))
    rows = C.listed(C.read_captures(spark, folder, content=False)).collect()
    assert [(r.kind, r.document_id, r.length) for r in rows] == [("answer", 5, 6), ("resources", 7, 5), ("extraction", 6, 4), ("page_text", 5, 3), ("error", 5, 2)]
    assert [r.file for r in C.listed(C.read_captures(spark, folder, document_id=5, content=False)).collect()] == ["raw_llm_response_5.json", "pdf_text_5.json", "error_ai_step_5.json"]
    assert C.read_captures(spark, folder, kind="error").first().stage == "ai_step"


def test_filters_are_settled_by_the_listing(spark, folder):
    put(folder, "llm_output_1.json", json.dumps({"document_id": 1}))
    for name in ("llm_output_2.json", "error_s_1.json"):
        os.chmod(put(folder, name, "{}"), 0)
    df = C.read_captures(spark, folder).filter("document_id = 1 AND kind = 'extraction' AND length > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [r.file for r in df.collect()] == ["llm_output_1.json"] and "length" in plan
    reader = C.CaptureReader({"path": folder})
    left = list(reader.pushFilters([C.EqualTo(("document_id",), 1), C.EqualTo(("kind",), "extraction"), C.EqualTo(("length",), 5)]))
    assert [f.attribute for f in left] == [("length",)] and [c.path.rsplit("/", 1)[1] for g in reader.partitions() for c in g.captures] == ["llm_output_1.json"]


def test_groups_hold_bounded_files_and_bytes():
    small = [C.Capture("error", "s", k, f"f{k}", k, 1) for k in range(2 * C.GROUP_FILES + 1)]
    assert [len(g.captures) for g in C.grouped(small)] == [C.GROUP_FILES, C.GROUP_FILES, 1]
    large = [C.Capture("error", "s", k, f"f{k}", k, C.GROUP_BYTES) for k in range(3)]
    assert [len(g.captures) for g in C.grouped(large)] == [1, 1, 1]
    assert [g.captures for g in C.grouped([])] == [[]]


def test_contents_that_do_not_parse_are_kept(spark, folder):
    put(folder, "error_ai_1.json", json.dumps({"document_id": 1, "stage": "error_ai", "error_message": "late", "error_data": {"type": "T"}}))
    put(folder, "error_ai_2.json", '{"document_id": 2, "stage"')
    put(folder, "fhir_data_3.json", "no json")
    put(folder, "fhir_data_4.json", json.dumps({"document_id": 4, "fhir_resources": []}))
    put(folder, "fhir_data_5.json", json.dumps({"document_id": 5, "patient_id": "p", "fhir_resources": [{"resourceType": "A", "id": "x"}, {"id": 2}]}))
    errors = {r.document_id: (r.error_message, r._corrupt_record) for r in C.parsed_errors(C.read_captures(spark, folder, "error")).collect()}
    assert errors == {1: ("late", None), 2: (None, '{"document_id": 2, "stage"')}
    found = sorted((r.document_id, r._corrupt_record, r.ord, r.resource_type, r.resource_id) for r in C.parsed_resources(C.read_captures(spark, folder, "resources")).collect() if r.ord is not None)
    assert found == [(5, None, 0, "A", "x"), (5, None, 1, None, "2")]
    assert [r._corrupt_record for r in C.parsed_resources(C.read_captures(spark, folder, document_id=3)).collect()] == ["no json"]


def test_missing_and_empty_folders_have_no_captures(spark, folder):
    assert C.read_captures(spark, folder + "/none").count() == 0 and C.read_captures(spark, folder).count() == 0


def test_writing_again_replaces_files(spark, folder):
    rows = spark.range(20).select(F.lit("error").alias("kind"), F.lit("s").alias("stage"), F.col("id").alias("document_id"), F.lit('{"error_message": "ä"}').alias("content"))
    for _ in range(2):
        C.write_captures(rows, f"file:{folder}/out")
    assert sorted(os.listdir(f"{folder}/out")) == sorted(f"error_s_{k}.json" for k in range(20))
    assert {r.error_message for r in C.parsed_errors(C.read_captures(spark, f"{folder}/out")).collect()} == {"ä"}


def test_stream_goes_on_behind_its_offset(spark, folder):
    C.register_captures(spark)
    os.mkdir(f"{folder}/in")

    def run():
        stream = spark.readStream.format("captures").option("path", f"{folder}/in").load()
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.document_id for r in spark.read.schema(C.ROW).parquet(f"{folder}/out").collect())

    put(f"{folder}/in", "llm_output_1.json", "{}")
    put(f"{folder}/in", "llm_output_2.json", "{}")
    assert run() == [1, 2] and run() == [1, 2]
    time.sleep(0.01)
    put(f"{folder}/in", "error_s_3.json", "{}")
    assert run() == [1, 2, 3]


def test_spread_captures_are_listed_by_tasks(spark, folder):
    kinds = F.explode(F.array(F.lit("error"), F.lit("extraction"))).alias("kind")
    rows = spark.range(600).select(kinds, F.lit("s").alias("stage"), F.col("id").alias("document_id"), F.concat(F.lit('{"document_id": '), "id", F.lit("}")).alias("content"))
    for _ in range(2):
        C.write_captures(rows, f"file:{folder}/out", spread=True)
    assert len(os.listdir(f"{folder}/out")) == C.FOLDERS and max(len(os.listdir(f"{folder}/out/{f}")) for f in os.listdir(f"{folder}/out")) == 6
    got = sorted((r.kind, r.document_id, r.file, r.content) for r in C.read_captures(spark, f"{folder}/out").collect())
    assert got == sorted((k, d, f"{n}_{d}.json", f'{{"document_id": {d}}}') for k, n in (("error", "error_s"), ("extraction", "llm_output")) for d in range(600))
    groups = C.CaptureReader({"path": f"{folder}/out"}).partitions()
    assert sum(len(g.captures) for g in groups) == 0 and max(len(g.folders) for g in groups) == C.GROUP_FOLDERS
    one = C.CaptureReader({"path": f"file:{folder}/out", "documentid": "300"}).partitions()
    assert [f.rsplit("/", 1)[1] for g in one for f in g.folders] == [f"044-of-{C.FOLDERS}"]
    assert {(r.kind, r.document_id) for r in C.read_captures(spark, f"{folder}/out", document_id=300).collect()} == {("error", 300), ("extraction", 300)}
    put(f"{folder}/out", "llm_output_9999.json", "{}")
    assert C.read_captures(spark, f"{folder}/out").count() == 1201 and len(C.CaptureStream({"path": f"{folder}/out"})._found()) == 1201
