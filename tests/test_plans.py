"""What queries move and evaluate, and rows on which that went wrong."""

import datetime
import time
from functools import reduce

import duckdb
from check import TABLES, compare
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.operators import convert as C
from chartmill.operators import extract as E
from chartmill.operators import link as L
from chartmill.operators import quality as V
from chartmill.operators import report as R
from chartmill.operators import similar as X
from chartmill.operators import text as T
from chartmill.plans import roles
from chartmill.plans.catalog import load_all
from chartmill.plans.extraction import extraction_documents
from chartmill.schemas import RESPONSE

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_all()


def plan_of(df, part="executedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_sections_of_documents_do_not_join_lists_they_do_not_read(spark):
    assert "Join" not in plan_of(QUERIES["converted_report_rows"](spark, FOLDER))


def test_tasks_that_list_observations_grow_in_number_with_the_rows(spark, monkeypatch):
    whole = QUERIES["convert_observations"](spark, FOLDER)
    monkeypatch.setattr(roles, "ROWS_PER_TASK", 200, raising=False)
    rows = C.observations(extraction_documents(roles.Tables(spark, FOLDER)))
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(counts) < 400 and sum(counts) == whole.count()
    split = QUERIES["convert_observations"](spark, FOLDER)
    assert split.exceptAll(whole).isEmpty() and whole.exceptAll(split).isEmpty()


def test_documents_read_without_lists_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(roles, "ROWS_PER_TASK", 200, raising=False)
    assert "Exchange" not in plan_of(QUERIES["convert_allergies"](spark, FOLDER))


def test_tables_that_the_cores_hold_at_once_stay_as_they_are(spark):
    tables = roles.Tables(spark, FOLDER)
    assert tables.spread(lineitem="l_orderkey") is tables


def test_full_report_moves_its_rows_once_and_writes_no_documents(spark):
    plan = plan_of(QUERIES["full_report"](spark, FOLDER))
    assert "hashpartitioning(patient_id" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(patient_id" in line and ", page" in line]


def test_conversion_moves_source_rows_alone(spark):
    plan = plan_of(QUERIES["convert_all_resources"](spark, FOLDER))
    assert plan.count("FileScan") == 3 and "conversion-documents" not in plan and "hashpartitioning(doc_id" not in plan


def odd_documents(spark):
    visit = [{"encounter_type": "office", "encounter_date": "2020-03-04"}, {"encounter_type": " ", "encounter_date": "2020-03-05"}, {"encounter_type": "er", "encounter_date": "2020"}, {"encounter_type": "home"}]
    found = {
        "conditions": [{"name": "A", "onset_date": d, "confidence": 0.5} for d in ("2020", "2020/3", "2020-03-04", "2031-01-01", "", None)] + [{"name": " "}, {"name": None}, None],
        "procedures": [{"name": n, "procedure_date": "2020-03-04"} for n in ("MMR", "mmr vaccine", "Chest x-ray", "Flu shot", "flu", None, "Repair")],
        "immunizations": [{"vaccine_name": "Flu", "is_forecast": True}, {"vaccine_name": "", "status": "not-done"}, {"vaccine_name": "Tdap", "status": "Not-Done", "date_administered": "2020-03-04"}],
        "diagnostic_reports": [{"report_type": "ECG", "report_date": "March 4, 2020"}, {"recommendations": "Refer to cardiology. Order lipid panel"}, {"report_type": "CT", "recommendations": " "}, {"recommendations": "Order x. Order y"}],
        "lab_results": [{"test_name": "TSH", "value": "1,5", "test_date": "03/04/2020"}, {"test_name": None}, {"test_name": "T", "test_date": "x"}], "vital_signs": [{"measurement": "Pulse", "timestamp": "2020-03-04T10:00"}],
        "medications": [{"name": "M", "start_date": "2020-03-04", "status": "STOPPED"}], "service_requests": [{"request_type": "MRI", "request_date": None}], "allergies": [{"allergen": "Nuts", "onset_date": "2020-3-4"}],
        "care_plans": [{"plan_description": "P", "status": "Revoked"}], "organizations": [{"name": "O"}], "providers": [{"name": "Dr. A B"}], "physical_exam_findings": [{"finding": "f", "body_site": "Lung"}],
        "social_history": [{"description": "d", "category": "tobacco_use"}], "family_history": [{"relationship": "r", "condition": "c"}, {"relationship": "r"}],
    }
    run = datetime.date(2024, 6, 15)
    rows = [
        (1, 1, "2020-03-04", run, found), (2, 1, None, run, found | {"encounters": visit}), (3, 2, "2020", run, found | {"encounters": visit[:1]}), (4, 2, None, run, found | {"encounters": visit[3:]}),
        (5, 3, "2020-03", run, {}), (6, 3, None, run, {"clinical_date": "2020-03-04", "medications": [{"name": ""}], "encounters": []}), (7, None, None, run, None), (8, 3, "2020-03-04", run, {"providers": [{"name": "X"}]}),
        (9, 4, "2020-03-04", run, found | {"encounters": visit[1:2]}),
    ]
    return spark.createDataFrame([(*r[:4], r[4] and {f.name: r[4].get(f.name) for f in RESPONSE.fields}) for r in rows], f"doc_id bigint, patient_id bigint, clinical_date string, run_date date, data {RESPONSE.simpleString()}")


def test_conversion_in_one_pass_gives_the_rows_of_every_projection(spark):
    docs = odd_documents(spark)
    none, active = F.lit(None).cast("string"), F.lit("active")
    visits = [C.encounters(docs), C.synthesized_encounters(docs)]
    tables = [
        *visits, C.medications(docs), C.observations(docs), C.exam_and_social(docs).withColumn("status", F.lit("final")), C.conditions(docs), C.immunizations(docs), C.procedures(docs), C.diagnostic_reports(docs),
        C.service_requests(docs).withColumn("status", active), C.allergies(docs), C.care_plans(docs), C.family_history(docs).withColumn("effective", none),
        C.practitioners(docs).withColumns({"status": active, "effective": none}), C.organizations(docs).withColumns({"status": active, "effective": none}),
    ]
    columns = ["doc_id", "patient_id", "resource_type", "resource_id", "name", "status", "effective", "confidence"]
    united = reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    want = C.link_within_documents(united, reduce(DataFrame.unionByName, [v.select("doc_id", "resource_id", "effective") for v in visits])).select(*columns, "encounter_id")
    got = C.resource_rows(docs)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("encounter_id IS NOT NULL").count() > 20 and got.filter("doc_id = 5 OR doc_id = 7").isEmpty()


def test_lists_gathered_in_one_pass_are_those_gathered_apart(spark):
    tables = roles.Tables(spark, FOLDER)
    apart, together = extraction_documents(tables), extraction_documents(tables, together=True)
    assert sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))


def test_full_report_moves_rows_of_tables_and_writes_no_report_rows(spark):
    plan = plan_of(QUERIES["full_report_items"](spark, FOLDER))
    assert "report-rows" not in plan and plan.count("report-lines") == 1 and "hashpartitioning(patient_id, section" not in plan


def test_full_report_counts_totals_in_the_pass_that_makes_pages(spark):
    plan = plan_of(QUERIES["full_report"](spark, FOLDER))
    assert plan.count("Join") == 1 and "report-rows" not in plan


def test_converted_rows_in_one_pass_are_those_of_every_section(spark):
    docs = odd_documents(spark)
    keys = ["doc_id", "patient_id"]
    got, want = R.converted_in_one_pass(docs, keys), R.converted_report_rows(docs, keys)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    kept = docs.select("doc_id", C.entries_of(R.converted_kinds()).alias("n")).filter("n > 0")
    made = got.groupBy("doc_id").count()
    assert made.join(kept, "doc_id").filter("count <= n").count() == made.count()


def test_full_report_of_patients_with_large_sections(spark, monkeypatch):
    want = sorted(map(str, QUERIES["full_report_items"](spark, FOLDER).collect()))
    monkeypatch.setattr(R, "SMALL_SECTION", 150)
    mixed = QUERIES["full_report_items"](spark, FOLDER)
    plan = plan_of(mixed)
    assert "report-rows" in plan and "report-lines" in plan and sorted(map(str, mixed.collect())) == want


def test_full_report_of_rows_without_partners(spark, tmp_path):
    tables = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in TABLES}
    tables["lineitem"] = tables["lineitem"].withColumn("l_partkey", F.when(F.col("l_partkey") % 7 == 1, F.col("l_partkey") + 10_000_000).otherwise(F.col("l_partkey")))
    tables["orders"] = tables["orders"].filter("o_orderkey % 10 <> 3")
    tables["part"] = tables["part"].unionByName(tables["part"].filter("p_partkey % 5 = 0").withColumn("p_size", F.col("p_size") + 1))
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("full_report", "full_report_items"):
        assert compare(spark, con, str(tmp_path), QUERIES[name], CHECKS[name]) is None


def test_leaked_row_with_name_and_number_is_listed_once(spark):
    people = spark.createDataFrame([(1, "Meyer", "MRN1"), (2, "Li", "MRN2"), (2, None, "MRN9")], "patient_id bigint, last_name string, mrn string")
    rows = [(1, "a", "mrn1 of Meyer"), (1, "b", "Li"), (2, "c", "LI, x"), (2, "d", "mrn9"), (3, "e", "Meyer"), (1, "f", None)]
    got = V.leaked_names(people, spark.createDataFrame(rows, "patient_id bigint, code string, display string"))
    assert sorted(r["code"] for r in got.collect()) == ["a", "c", "d"]
    assert "explode" not in plan_of(got)


def test_similar_codes_reads_its_rows_once(spark):
    codes = spark.range(1000).select(F.concat(F.lit("ABCDEFGH-"), (F.col("id") % 5).cast("string")).alias("c"))
    out = X.similar_codes(codes, "c")
    assert "Range (0" not in plan_of(out) and out.count() == 20


def test_rows_meet_the_encounters_of_their_year_without_being_multiplied(spark):
    visits = [(7, "2020"), (5, "2020-03"), (6, "2020-03-04"), (4, "2021-01-01"), (3, None)]
    visits = spark.createDataFrame([(1, *v) for v in visits] + [(2, 9, None)], "patient_id bigint, encounter_id bigint, date_text string")
    asked = {"a": "2020", "b": "2020-03", "c": "2020-03-04", "d": "2020-03-05", "e": "2020-04", "f": "2021", "g": "2022", "h": None, "i": ""}
    rows = spark.createDataFrame([(1, k, v) for k, v in asked.items()] + [(2, "z", None)], "patient_id bigint, row string, date_text string")
    out = L.link_encounters(rows, "row", visits)
    got = {r["row"]: (r["visit"], r["tier"]) for r in out.collect()}
    assert got == {
        "a": (5, "date"), "b": (5, "date"), "c": (5, "date"), "d": (5, "date"), "e": (7, "date"), "f": (4, "date"), "g": (None, "unlinked"),
        "h": (None, "unlinked"), "i": (None, "unlinked"), "z": (9, "lone"),
    }
    assert plan_of(out, "optimizedPlan").count("Generate ") == 1


def test_visit_groups_move_rows_without_multiplying_them(spark):
    plan = plan_of(QUERIES["visit_grouping_three_tier"](spark, FOLDER), "optimizedPlan")
    assert plan.count("Generate ") == 1


def test_medication_name_ends_at_one_match_of_all_patterns(spark):
    plan = plan_of(QUERIES["medication_sentence_parse"](spark, FOLDER), "optimizedPlan")
    assert 1 <= plan.count("regexp_instr") <= 10


def test_label_rules_are_evaluated_once_for_resource_and_path(spark):
    plan = plan_of(QUERIES["field_label_category"](spark, FOLDER), "optimizedPlan")
    assert plan.count("RLIKE") < 60


def test_key_values_behind_a_long_run_of_words(spark):
    rows = [(1, "word " * 60_000 + "; Name: Jo\n 12 Age: 7\nNote:\n: x\nEnd"), (2, "a b: c: d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    start = time.time()
    got = sorted((r["doc_id"], r["label"], r["value"]) for r in E.key_value_fields(docs).collect())
    assert got == [(1, "Age", "7"), (1, "Name", "Jo"), (2, "a b", "c")]
    assert time.time() - start < 8


def test_dates_use_all_tasks_of_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "seen 2023-04-01") for i in range(100)], "doc_id bigint, text string").coalesce(1)
    assert E.extract_dates(docs, "2024-06-15").select(F.spark_partition_id()).distinct().count() > 1


def test_section_chunks_use_all_tasks_of_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id bigint, text string").coalesce(1)
    assert T.section_chunks(docs).select(F.spark_partition_id()).distinct().count() > 1


def test_words_without_a_digit_are_not_read_as_dates(monkeypatch):
    import datetime

    read, seen = E._loose_date, []
    monkeypatch.setattr(E, "_loose_date", lambda token: seen.append(token) or read(token))
    hits = E.dates_in_text("seen again on 2023/4/11 by the ward", datetime.date(2025, 6, 15))
    assert [h[2] for h in hits] == [datetime.date(2023, 4, 11)] and seen == ["2023/4/11"]


def test_text_of_one_chunk_is_not_searched_for_breaks(monkeypatch):
    monkeypatch.setattr(T, "BreakPoints", None)
    assert list(T.section_spans("a short text", 4000, 200)) == [(0, 12)] and list(T.section_spans("", 4000, 200)) == []
