"""Queries for linking."""

from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators import link as L
from chartmill.plans.catalog import query
from chartmill.plans.queries_scalar import OBS_CAT_SQL

_AGREE = "(starts_with(o.date_text, e.date_text) OR starts_with(e.date_text, o.date_text))"
_BY_DATE = f"""by_date AS (SELECT o.obs_id, min(e.encounter_id) AS v FROM observations o JOIN encounters e
   ON e.patient_id = o.patient_id AND {_AGREE} GROUP BY 1)"""


@query(
    "link_encounters",
    f"""WITH {_BY_DATE}, lone AS (SELECT patient_id, min(encounter_id) AS e FROM encounters GROUP BY 1 HAVING count(*) = 1),
        x AS (SELECT o.obs_id, o.encounter_ref, d.v, CASE WHEN o.date_text IS NULL THEN l.e END AS e FROM observations o LEFT JOIN by_date d USING (obs_id) LEFT JOIN lone l ON l.patient_id = o.patient_id)
        SELECT obs_id, coalesce(encounter_ref, v, e) AS visit, CASE WHEN encounter_ref IS NOT NULL THEN 'reference' WHEN v IS NOT NULL THEN 'date' WHEN e IS NOT NULL THEN 'lone' ELSE 'unlinked' END AS tier FROM x""",
)
def _(t):
    return L.link_encounters(t.observations, "obs_id", t.encounters).select("obs_id", "visit", "tier")


@query(
    "visit_grouping_three_tier",
    f"""WITH {_BY_DATE} SELECT patient_id, coalesce(CAST(coalesce(encounter_ref, v) AS STRING), 'unlinked') AS visit,
          CASE WHEN encounter_ref IS NOT NULL THEN 'reference' WHEN v IS NOT NULL THEN 'date' ELSE 'unlinked' END AS tier, count(*) AS n
        FROM observations o LEFT JOIN by_date d USING (obs_id) GROUP BY ALL""",
)
def _(t):
    return L.group_by_visit(t.observations, "obs_id", t.encounters)


# panel reports: one per encounter and test name over its first lines
_REPORTS_SQL = "rep AS (SELECT CAST(encounter_id AS STRING) || ':' || test_name AS report_id, obs_id FROM observations WHERE line_no <= 3)"
_OBS_SQL = "ob AS (SELECT obs_id, CASE WHEN code_id % 4 <> 0 THEN encounter_id END AS visit, flag = 'R' AS flagged FROM observations)"


def _reports(t):
    rows = t.observations.filter("line_no <= 3").select(F.concat_ws(":", F.col("encounter_id").cast("string"), "test_name").alias("report_id"), "obs_id")
    return rows.groupBy("report_id").agg(F.sort_array(F.collect_list("obs_id")).alias("result_refs"))  # a report lists its own results


def _obs(t):
    return t.observations.selectExpr("obs_id", "CASE WHEN code_id % 4 <> 0 THEN encounter_id END AS visit", "flag = 'R' AS flagged")


@query("panel_results", f"WITH {_REPORTS_SQL}, {_OBS_SQL} SELECT report_id, count(*) AS results, count(*) FILTER (flagged) AS flagged FROM rep JOIN ob USING (obs_id) GROUP BY 1")
def _(t):
    return L.panels(_reports(t), _obs(t))


@query("unclaimed_results", f"WITH {_REPORTS_SQL}, {_OBS_SQL} SELECT obs_id, flagged FROM ob WHERE obs_id NOT IN (SELECT obs_id FROM rep)")
def _(t):
    return L.unclaimed(_reports(t), _obs(t)).select("obs_id", "flagged")


@query(
    "labs_by_visit_totals",
    f"""WITH {_REPORTS_SQL}, {_OBS_SQL}, m AS (SELECT report_id, obs_id, flagged, visit FROM rep JOIN ob USING (obs_id)),
        size AS (SELECT report_id, count(*) AS n, count(*) FILTER (flagged) AS f FROM m GROUP BY 1), seen_at AS (SELECT DISTINCT visit, report_id FROM m WHERE visit IS NOT NULL),
        rest AS (SELECT * FROM ob WHERE obs_id NOT IN (SELECT obs_id FROM rep)),
        parts AS (SELECT CAST(visit AS STRING) AS visit, 1 AS p, 0 AS o, n, f FROM seen_at JOIN size USING (report_id)
          UNION ALL SELECT CAST(visit AS STRING), 0, 1, 1, flagged::INT FROM rest WHERE visit IS NOT NULL
          UNION ALL SELECT 'unlinked', 1, 0, n, f FROM size WHERE report_id NOT IN (SELECT report_id FROM seen_at)
          UNION ALL SELECT 'unlinked', 0, 1, 1, flagged::INT FROM rest WHERE visit IS NULL)
        SELECT visit, CAST(sum(p) AS BIGINT) AS panels, CAST(sum(o) AS BIGINT) AS others, CAST(sum(n) AS BIGINT) AS total, CAST(sum(f) AS BIGINT) AS flagged FROM parts GROUP BY 1""",
)
def _(t):
    return L.labs_by_visit(_reports(t), _obs(t))


@query("vitals_by_visit", f"WITH x AS (SELECT encounter_id, {OBS_CAT_SQL} AS c FROM observations) SELECT encounter_id, count(*) AS vitals FROM x WHERE c = 'vital_signs' GROUP BY 1")
def _(t):
    vital = t.observations.filter(S.observation_category(F.lit(None).cast("string"), F.col("test_name")) == "vital_signs")
    return vital.groupBy("encounter_id").agg(F.count("*").alias("vitals"))


@query("dangling_references", "SELECT obs_id, code_id FROM observations WHERE code_id NOT IN (SELECT code_id FROM codes WHERE code_id % 10 <> 3)")
def _(t):
    rows = t.observations.withColumn("ref", F.concat(F.lit("Code/"), F.col("code_id").cast("string")))
    return L.dangling(rows, "ref", t.codes.filter("code_id % 10 <> 3"), "code_id").select("obs_id", "code_id")


@query("uncovered_labs", "SELECT obs_id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations r WHERE r.line_no = 1 AND r.encounter_id = o.encounter_id AND r.test_name = o.test_name)")
def _(t):
    covered = t.observations.filter("line_no = 1").select("encounter_id", "test_name")
    return t.observations.join(covered, ["encounter_id", "test_name"], "left_anti").select("obs_id")


@query(
    "kth_lab_to_observation",
    """WITH l AS (SELECT patient_id, test_name, obs_id AS lab_id, row_number() OVER (PARTITION BY patient_id, test_name ORDER BY obs_id) AS k FROM observations WHERE line_no % 2 = 0),
       o AS (SELECT patient_id, test_name, obs_id, row_number() OVER (PARTITION BY patient_id, test_name ORDER BY obs_id) AS k FROM observations WHERE line_no % 2 = 1)
       SELECT patient_id, test_name, k, lab_id, obs_id FROM l JOIN o USING (patient_id, test_name, k)""",
)
def _(t):
    lab = t.observations.filter("line_no % 2 = 0").withColumnRenamed("obs_id", "lab_id")
    return L.match_kth(lab, t.observations.filter("line_no % 2 = 1"), ["patient_id", "test_name"], "lab_id", "obs_id")


_NEW = "SELECT obs_id AS new_id, patient_id, test_name, CASE WHEN source_id % 5 <> 0 THEN loinc END AS code, CASE WHEN source_id % 3 <> 0 THEN effective_date END AS day FROM observations WHERE line_no % 4 = 0"
_OLD = "SELECT obs_id AS old_id, patient_id, test_name, CASE WHEN source_id % 4 <> 0 THEN loinc END AS code, CASE WHEN source_id % 7 <> 0 THEN effective_date END AS day FROM observations WHERE line_no % 4 <> 0"


@query(
    "find_existing_resource",
    f"""WITH n AS ({_NEW}), o AS ({_OLD}) SELECT new_id, min(old_id) AS old_id FROM n JOIN o ON n.patient_id = o.patient_id
        AND (n.code = o.code OR n.code IS NULL OR o.code IS NULL) AND (n.day = o.day OR n.day IS NULL OR o.day IS NULL) GROUP BY 1""",
)
def _(t):
    return L.find_existing(t.sql(_NEW), t.sql(_OLD), "new_id", "old_id", ["patient_id"], ["code", "day"])


_EXT = """SELECT patient_id, 'patient_name' AS field, CASE WHEN patient_id % 9 = 0 THEN '' WHEN patient_id % 4 = 0 THEN 'Dr. ' || first_name || ' ' || last_name ELSE last_name || ' ' || first_name END AS value, CAST(patient_id % 10 AS DOUBLE) / 10 AS confidence FROM patients
   UNION ALL SELECT patient_id, 'phone', CASE WHEN patient_id % 3 = 0 THEN '555' || CAST(patient_id AS STRING) ELSE phone END, CAST(0.9 AS DOUBLE) FROM patients
   UNION ALL SELECT patient_id, 'mrn', mrn, CAST(0.9 AS DOUBLE) FROM patients WHERE patient_id % 2 = 0"""
_REC = """SELECT patient_id, 'patient_name' AS field, first_name || ' ' || last_name AS value FROM patients UNION ALL SELECT patient_id, 'phone', CASE WHEN patient_id % 11 <> 0 THEN phone END FROM patients
   UNION ALL SELECT patient_id, 'mrn', mrn FROM patients UNION ALL SELECT patient_id, 'address', living_setting FROM patients"""


def _form(v):
    return rf"""CASE WHEN {v} IS NULL THEN '' WHEN field = 'phone' THEN CASE WHEN length(regexp_replace({v}, '[^0-9]', '', 'g')) = 11 AND starts_with(regexp_replace({v}, '[^0-9]', '', 'g'), '1')
        THEN substr(regexp_replace({v}, '[^0-9]', '', 'g'), 2) ELSE regexp_replace({v}, '[^0-9]', '', 'g') END
        WHEN field = 'patient_name' THEN trim(regexp_replace(regexp_replace(lower({v}), '\b(mr|mrs|ms|dr|md|jr|sr|ii|iii)\b\.?', '', 'g'), '\s+', ' ', 'g')) ELSE lower({v}) END"""


_COMPARED = f"""e AS (SELECT patient_id, field, nullif(trim(value), '') AS extracted, confidence FROM ({_EXT})), r AS (SELECT patient_id, field, nullif(trim(value), '') AS recorded FROM ({_REC})),
   j AS (SELECT patient_id, field, extracted, recorded, coalesce(confidence, 0.5) AS confidence, {_form('extracted')} AS a, {_form('recorded')} AS b FROM e FULL JOIN r USING (patient_id, field)),
   s AS (SELECT *, CASE WHEN extracted IS NULL AND recorded IS NULL THEN 1.0 WHEN extracted IS NULL OR recorded IS NULL THEN 0.0 WHEN a = b THEN 1.0
      ELSE 1.0::DOUBLE - editdist3_utf(a, b)::DOUBLE / greatest(length(a), length(b)) END::DOUBLE AS similarity FROM j)""".replace("editdist3_utf", "levenshtein")
_CLASS = """CASE WHEN extracted IS NULL AND recorded IS NULL THEN 'no_data' WHEN extracted IS NULL THEN 'missing_extracted' WHEN recorded IS NULL THEN 'missing_patient'
   WHEN similarity >= 0.9 THEN 'minor_difference' WHEN similarity >= 0.7 THEN 'moderate_difference' ELSE 'major_difference' END"""
_RES = """CASE WHEN similarity >= 0.85 THEN 'no_change' WHEN extracted IS NULL THEN 'keep_existing' WHEN recorded IS NULL THEN CASE WHEN confidence >= 0.5 THEN 'use_extracted' ELSE 'manual_edit' END
   WHEN confidence >= 0.8 THEN 'use_extracted' WHEN confidence < 0.5 THEN 'manual_edit' WHEN length(extracted) > length(recorded) THEN 'use_extracted' ELSE 'keep_existing' END"""


def compared(t):
    extracted = t.sql(_EXT)
    return L.compare_records(extracted, t.sql(_REC))



@query("compare_patient_fields", f"WITH {_COMPARED} SELECT patient_id, field, extracted, recorded, similarity < 0.85 AS different, CASE WHEN field = 'patient_name' AND contains(recorded, 'É') AND similarity BETWEEN 0.01 AND 0.99 THEN NULL ELSE similarity END AS similarity FROM s")
def _(t):
    accent = (F.col("field") == "patient_name") & F.col("recorded").contains("É") & F.col("similarity").between(0.01, 0.99)
    return compared(t).select("patient_id", "field", "extracted", "recorded", "different", F.when(~F.coalesce(accent, F.lit(False)), F.col("similarity")).alias("similarity"))


@query(
    "discrepancy_resolution",
    f"""WITH {_COMPARED}, x AS (SELECT *, {_CLASS} AS kind, {_RES} AS resolution FROM s) SELECT patient_id, field, kind, resolution, CASE WHEN similarity < 0.85 THEN CASE WHEN confidence >= 0.8 AND resolution = 'use_extracted' THEN 'auto_resolution'
          WHEN confidence >= 0.8 THEN 'high_confidence_update' WHEN confidence < 0.5 THEN 'low_confidence_warning' ELSE 'manual_review' END END AS bucket FROM x""",
)
def _(t):
    return compared(t).select("patient_id", "field", "kind", "resolution", L.suggestion_bucket(F.col("different"), F.col("resolution"), F.col("confidence")).alias("bucket"))


@query("provider_links", "SELECT source_id AS provider_id, count(DISTINCT patient_id) AS patients, count(DISTINCT encounter_id) AS documents FROM observations GROUP BY 1")
def _(t):
    return L.provider_links(t.observations.selectExpr("source_id AS provider_id", "patient_id", "encounter_id AS doc_id"))


@query(
    "related_changes_60min",
    """SELECT a.change_id, a.reviewer, count(*) - 1 AS related FROM field_audit a JOIN field_audit b ON a.reviewer = b.reviewer AND b.created_at BETWEEN a.created_at - INTERVAL '60' MINUTE AND a.created_at + INTERVAL '60' MINUTE GROUP BY ALL""",
)
def _(t):
    return L.related_changes(t.field_audit).select("change_id", "reviewer", "related")


@query(
    "related_to_change",
    """SELECT b.change_id, b.field_name FROM field_audit a JOIN field_audit b ON a.reviewer = b.reviewer AND a.change_id <> b.change_id AND b.created_at BETWEEN a.created_at - INTERVAL '6' HOUR AND a.created_at + INTERVAL '6' HOUR WHERE a.change_id = 77""",
)
def _(t):
    return L.related_to(t.field_audit, 77, 360).select("change_id", "field_name")


_PROV = """SELECT encounter_id AS provenance_id, lag(encounter_id) OVER (PARTITION BY patient_id ORDER BY started_at, encounter_id) AS previous_id FROM encounters"""


@query(
    "provenance_chain",
    f"""WITH RECURSIVE p AS ({_PROV}), w AS (SELECT provenance_id, provenance_id AS root, 0 AS depth FROM p WHERE previous_id IS NULL
          UNION ALL SELECT p.provenance_id, w.root, w.depth + 1 FROM w JOIN p ON p.previous_id = w.provenance_id) SELECT provenance_id, root, CAST(depth AS BIGINT) AS depth FROM w""",
)
def _(t):
    return L.provenance_chains(t.sql(_PROV), "provenance_id", "previous_id")


_PROV_ROWS = "SELECT doc_id AS provenance_id, 'Condition/' || CAST(patient_id AS STRING) AS target, uploaded_at AS recorded, status AS activity, uploaded_by AS source FROM pipeline"


@query(
    "latest_provenance",
    f"""WITH p AS ({_PROV_ROWS}) SELECT target, arg_max(provenance_id, {{'r': recorded, 'i': provenance_id}}) AS latest, max(recorded) AS recorded, count(*) AS entries,
          count(DISTINCT activity) AS activities, count(DISTINCT source) AS sources FROM p GROUP BY 1""",
)
def _(t):
    return L.latest_provenance(t.sql(_PROV_ROWS))
