"""Queries for validation rules and review decisions."""

from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators import quality as V
from chartmill.plans.catalog import query
from chartmill.plans.sqltext import case_map, half, q

_CHK = """SELECT patient_id, CASE WHEN source_id % 50 <> 1 THEN resource_type END AS resource_type, CASE WHEN source_id % 41 <> 2 THEN resource_id END AS resource_id,
   CASE WHEN source_id % 9 <> 3 THEN code END AS code, CASE WHEN source_id % 6 <> 4 THEN body END AS body, CASE WHEN source_id % 5 <> 0 THEN 'active' END AS status,
   CASE WHEN code = '2345-7' THEN 'Glucose' ELSE 'Other' END AS display, CASE WHEN resource_type = 'Observation' THEN CAST(body AS DOUBLE) * 10 END AS value,
   CASE WHEN source_id % 2 = 0 THEN 'mg/dL' ELSE 'mmol/L' END AS unit, resource_id AS seed FROM resources"""
_RULES = [
    ("resource_type IS NULL", "error", "structure", "missing type"), ("resource_id IS NULL", "warning", "structure", "missing id"),
    ("resource_type IN ('Observation', 'Condition') AND code IS NULL", "error", "completeness", "missing code"),
    ("resource_type = 'Observation' AND body IS NULL", "warning", "completeness", "missing value"),
    ("resource_type = 'Condition' AND status IS NULL", "warning", "completeness", "missing clinical status"),
    ("resource_type = 'MedicationStatement' AND code IS NULL", "error", "completeness", "missing medication"),
    ("display = 'Glucose' AND value > 400 AND unit = 'mg/dL'", "critical", "safety", "critical glucose"),
]
_ISSUES = f"chk AS ({_CHK}), iss AS (" + " UNION ALL ".join(
    f"SELECT patient_id, resource_type, resource_id, '{s}' AS severity, '{c}' AS category, '{m}' AS message FROM chk WHERE {w}" for w, s, c, m in _RULES
) + ")"


@query("resource_issues", f"WITH {_ISSUES} SELECT * FROM iss")
def _(t):
    return V.resource_issues(t.sql(_CHK))


@query("critical_glucose", f"WITH chk AS ({_CHK}) SELECT resource_id, value FROM chk WHERE display = 'Glucose' AND value > 400 AND unit = 'mg/dL'")
def _(t):
    return t.sql(_CHK).filter(V.critical_glucose(F.col("display"), F.col("value"), F.col("unit"))).select("resource_id", "value")


@query("issue_breakdown", f"WITH {_ISSUES} SELECT severity, category, count(*) AS n FROM iss GROUP BY ALL")
def _(t):
    return V.resource_issues(t.sql(_CHK)).groupBy("severity", "category").agg(F.count("*").alias("n"))


@query(
    "quality_score",
    f"""WITH {_ISSUES}, n AS (SELECT patient_id, count(*) AS resources FROM chk GROUP BY 1), b AS (SELECT patient_id, sum({case_map('severity', V.SEVERITY_PENALTY, '1')}) AS p, count(*) AS issues FROM iss GROUP BY 1)
        SELECT patient_id, resources, CAST(coalesce(p, 0) AS BIGINT) AS penalty, coalesce(issues, 0) AS issues,
          {half('greatest(0.0::DOUBLE, 100 - coalesce(p, 0)::DOUBLE / (resources * 5) * 100)', 2)} AS score FROM n LEFT JOIN b USING (patient_id)""",
)
def _(t):
    rows = t.sql(_CHK)
    return V.quality_score(rows, V.resource_issues(rows), "patient_id")


@query(
    "automatic_corrections",
    f"""WITH chk AS ({_CHK}) SELECT seed, coalesce(resource_id, sha256(patient_id || '|' || seed)) AS resource_id,
          CASE WHEN resource_type = 'Condition' AND status IS NULL THEN 'active' ELSE status END AS status FROM chk""",
)
def _(t):
    return V.corrected(t.sql(_CHK), ["patient_id", "seed"]).select("seed", "resource_id", "status")


_DOCS = """SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'clinical_note' WHEN 2 THEN 'medication_list' WHEN 3 THEN 'discharge_summary' ELSE 'generic' END AS document_type,
   CASE WHEN event_id % 7 = 0 THEN 'X' WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 17 = 0 THEN repeat('long name ', 12) ELSE 'Jane Doe' END AS patient_name,
   CASE WHEN event_id % 4 <> 0 THEN '2024-01-05' END AS a_date, CASE WHEN event_id % 3 = 0 THEN '[1, 2]' WHEN event_id % 3 = 1 THEN 'one' END AS listed,
   CASE WHEN event_id % 6 <> 0 THEN 'Dr. Who' ELSE '' END AS provider FROM events"""


def _schema_sql():
    value = {
        "patient_name": "patient_name", "provider": "provider", "tests": "listed", "medications": "listed",
    }
    out = []
    for kind, fields in V.REQUIRED_FIELDS.items():
        for f in fields:
            out.append(f"SELECT doc_id, document_type, 'required {f}' AS issue FROM d WHERE document_type = '{kind}' AND trim(coalesce({value.get(f, 'a_date')}, '')) = ''")
    for f, (lo, hi) in V.NAME_FIELDS.items():
        out.append(f"SELECT doc_id, document_type, 'short {f}' FROM d WHERE length({f}) < {lo}")
        out.append(f"SELECT doc_id, document_type, 'long {f}' FROM d WHERE length({f}) > {hi}")
    for f in ("tests", "medications"):
        out.append(f"SELECT doc_id, document_type, 'array {f}' FROM d WHERE NOT starts_with(listed, '[')")
    return f"WITH d AS ({_DOCS}) " + " UNION ALL ".join(out)


@query("schema_issues", _schema_sql())
def _(t):
    pairs = ["patient_name", "provider"]
    dates = ["test_date", "note_date", "list_date", "admission_date", "discharge_date", "document_date"]
    data = F.create_map(
        *[x for c in pairs for x in (F.lit(c), F.col(c))], *[x for c in dates for x in (F.lit(c), F.col("a_date"))],
        *[x for c in ("tests", "medications") for x in (F.lit(c), F.col("listed"))],
    )
    return V.schema_issues(t.sql(_DOCS).select("doc_id", "document_type", data.alias("data")))


_BIZ = """SELECT e.encounter_id AS doc_id, CASE WHEN encounter_id % 5 = 0 THEN 'Someone Else' ELSE upper(first_name) || ' ' || last_name END AS patient_name, first_name || ' ' || last_name AS record_name,
   CASE WHEN encounter_id % 97 = 0 THEN DATE '1899-05-05' ELSE visit_date END AS admission, visit_date + CAST(encounter_id % 12 AS INT) - 1 AS discharge, visit_date + CAST(encounter_id % 13 AS INT) - 2 AS test_date, visit_date AS collection,
   CASE WHEN encounter_id % 8 = 0 THEN '' WHEN encounter_id % 3 = 0 THEN 'Glucose fasting' ELSE 'TSH' END AS test_name, CASE WHEN encounter_id % 10 <> 0 THEN amount / 400 END AS test_value,
   CAST(encounter_id % 400 AS STRING) || '/' || CAST(encounter_id % 250 AS STRING) AS pressure, CASE WHEN encounter_id % 4 = 0 THEN ' ' ELSE 'Dr. A' END AS provider,
   CASE WHEN encounter_id % 6 <> 0 THEN '5 mg' END AS dosage, DATE '2001-01-01' AS today FROM encounters e JOIN patients p ON e.patient_id = p.patient_id"""
_BIZ_RULES = [
    ("doc_id % 5 = 0", "name differs"), ("discharge < admission", "discharge before admission"), ("test_name = ''", "test without name"),
    ("test_value IS NULL", "test without value"), ("year(admission) < 1900", "date before 1900"), ("admission > today", "date in the future"),
    ("contains(lower(test_name), 'glucose') AND (test_value < 0 OR test_value > 1000)", "glucose out of range"),
    ("doc_id % 400 < 50 OR doc_id % 400 > 300", "systolic out of range"), ("doc_id % 250 < 30 OR doc_id % 250 > 200", "diastolic out of range"),
    ("test_date - collection > 7", "test late after collection"), ("test_date < collection", "test before collection"), ("trim(provider) = ''", "no provider"), ("dosage IS NULL", "medication without dosage"),
]


@query("business_issues", f"WITH d AS ({_BIZ}) " + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS issue FROM d WHERE {w}" for w, m in _BIZ_RULES))
def _(t):
    return V.business_issues(t.sql(_BIZ))


_STAGES = """SELECT event_id AS doc_id, event_id % 5 AS conditions, event_id % 4 AS medications, event_id % 2 AS vitals, event_id % 3 AS labs, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence,
   event_id % 7 AS made_conditions, event_id % 6 AS made_medications, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processed' ELSE 'failed' END AS status, event_id % 11 AS errors, event_id % 8 = 0 AS short_text FROM events"""


def _join(*rules):
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {w} THEN '{m}' END" for w, m in rules) + ")"


_TOTAL = "conditions + medications + vitals + labs"
_CHECKPOINTS = [
    ("pre_ai_extraction", _join(("short_text", "too short")), "true", "Consider manual review - text quality issues detected"),
    ("post_ai_extraction", _join((f"{_TOTAL} = 0", "no medical data"), ("confidence < 0.3", "low confidence")), "true", "Consider manual review - AI extraction quality issues detected"),
    ("pre_fhir_conversion", _join((f"{_TOTAL} = 0", "no data to convert")), f"NOT ({_TOTAL} = 0)", "Consider manual review before FHIR conversion"),
    ("post_fhir_conversion", _join(("made_conditions + made_medications = 0", "no resources"), ("made_conditions = 0", "missing Condition"), ("made_medications = 0", "missing MedicationStatement")), "true", "FHIR resources have validation issues - consider manual review"),
    ("final_processing", _join(("status = 'failed'", "invalid status"), ("errors > 0", "errors logged"), ("abs(conditions - made_conditions) > 2", "conditions count mismatch"), ("abs(medications - made_medications) > 2", "medications count mismatch")), "true", "Review processing"),
]


@query(
    "document_checkpoints",
    f"WITH d AS ({_STAGES}), x AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS stage, {i} AS issues, {c} AS can_proceed, '{a}' AS a FROM d" for s, i, c, a in _CHECKPOINTS)
    + ") SELECT doc_id, stage, issues = '' AS is_valid, can_proceed, issues, CASE WHEN issues <> '' THEN a END AS advice FROM x",
)
def _(t):
    docs = t.sql(_STAGES).withColumn("text_issues", S.issues((F.col("short_text"), "too short")))
    return V.pipeline_checks(docs)


_PARSED = """SELECT e.event_id AS doc_id, CASE WHEN e.event_id % 31 <> 0 THEN 0.7 + CAST(e.event_id % 30 AS DOUBLE) / 100 END AS confidence, CASE WHEN e.event_id % 9 = 0 THEN 'GPT-4' ELSE 'primary' END AS model,
   CASE WHEN e.event_id % 13 = 0 THEN 'regex' ELSE '' END AS fallback, e.event_id % 6 AS resources,
   CASE e.event_id % 4 WHEN 0 THEN p.first_name || ' ' || p.last_name WHEN 1 THEN p.last_name ELSE 'Zed Unrelated' END AS name, CASE WHEN e.event_id % 5 = 0 THEN DATE '1900-01-01' ELSE p.birth_date END AS birth,
   p.first_name || ' ' || p.last_name AS record_name, p.birth_date AS record_birth FROM events e JOIN patients p ON e.user_id = p.patient_id""".replace("0.7 +", "CAST(0.7 AS DOUBLE) +")
_CONF = "concat_ws(';', CASE WHEN birth <> record_birth THEN 'birth date' END, CASE WHEN doc_id % 4 >= 2 THEN 'name' END)"
_REVIEW = f"""CASE WHEN confidence IS NULL OR confidence < 0.80 THEN 'low confidence' WHEN contains(lower(model), 'gpt') THEN 'fallback model' WHEN fallback <> '' THEN 'fallback method'
   WHEN resources = 0 THEN 'no resources' WHEN resources < 3 AND confidence < 0.95 THEN 'few resources' WHEN {_CONF} <> '' THEN 'patient conflict' END"""


def _parsed(t):
    rows = t.sql(_PARSED)
    clash = V.quick_conflict(F.col("name"), F.col("birth"), F.col("record_name"), F.col("record_birth"))
    rows = rows.withColumn("conflict", F.array_join(clash, ";"))
    reason = V.review_decision(F.col("confidence"), F.col("model"), F.col("fallback"), F.col("resources"), F.col("conflict") != "")
    return rows.withColumn("reason", reason).withColumn("review", F.when(F.col("reason").isNull(), "auto_approved").otherwise("flagged"))


@query("review_status", f"WITH d AS ({_PARSED}), r AS (SELECT *, {_REVIEW} AS reason FROM d) SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'auto_approved' ELSE 'flagged' END AS review FROM r")
def _(t):
    return _parsed(t).select("doc_id", "reason", "review")


@query("quick_conflicts", f"WITH d AS ({_PARSED}) SELECT doc_id, {_CONF} AS conflict FROM d")
def _(t):
    return _parsed(t).select("doc_id", "conflict")


@query(
    "review_statistics",
    f"""WITH d AS ({_PARSED}), r AS (SELECT *, {_REVIEW} IS NULL AS auto FROM d), s AS (SELECT count(*) AS total, count(*) FILTER (auto) AS auto_approved, {half('count(*) FILTER (auto) * 100 / count(*)', 1)} AS auto_share,
          {half('count(*) FILTER (NOT auto) * 100 / count(*)', 1)} AS flagged_share, {half('min(confidence)', 4)} AS min_confidence, {half('avg(confidence)', 4)} AS avg_confidence, {half('max(confidence)', 4)} AS max_confidence FROM r)
        SELECT *, CASE WHEN flagged_share < 5 THEN 'below' WHEN flagged_share > 20 THEN 'above' ELSE 'within' END AS target FROM s""",
)
def _(t):
    from chartmill.operators.metrics import review_statistics

    return review_statistics(_parsed(t))


@query("flag_reasons", f"WITH d AS ({_PARSED}) SELECT {_REVIEW} AS reason, count(*) AS n FROM d WHERE reason IS NOT NULL GROUP BY 1")
def _(t):
    return _parsed(t).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


_FQ = r"""CASE WHEN trim(value) = '' THEN 0.0 WHEN regexp_matches(lower(label), 'date|dob|birth') THEN CASE WHEN regexp_matches(trim(value), '^(\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}-\d{1,2}-\d{1,2})') THEN 1.0 ELSE 0.3 END
   WHEN contains(lower(label), 'phone') THEN CASE WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) IN (10, 11) THEN 1.0 ELSE 0.4 END
   WHEN contains(lower(label), 'name') THEN CASE WHEN length(trim(value)) < 2 THEN 0.1 WHEN NOT regexp_matches(trim(value), '^[a-zA-Z\s.\-'']+$') THEN 0.6 ELSE 1.0 END ELSE 1.0 END"""


@query(
    "data_quality",
    f"""WITH f AS (SELECT doc_id, CAST({_FQ} AS DOUBLE) AS score FROM fields) SELECT doc_id, count(*) AS fields, count(*) FILTER (score IN (1.0, 0.6)) AS valid,
          {half('count(*) FILTER (score IN (1.0, 0.6)) / count(*)', 6)} AS completeness, {half('avg(score)', 4)} AS quality FROM f GROUP BY 1""",
)
def _(t):
    return V.data_quality(t.fields)


_ENT = """SELECT patient_id, resource_type, CASE WHEN source_id % 41 <> 2 THEN resource_id END AS resource_id,
   CASE WHEN source_id % 23 = 0 THEN 'urn:' || resource_id ELSE resource_type || '/' || resource_id END AS full_url FROM resources
   UNION ALL SELECT patient_id, 'Observation', obs_id, 'Observation/' || obs_id FROM observations WHERE source_id % 20 = 1"""


@query(
    "bundle_integrity",
    f"""WITH e AS ({_ENT}) SELECT patient_id, resource_type, resource_id, 'missing id' AS issue FROM e WHERE resource_id IS NULL
        UNION ALL SELECT patient_id, resource_type, resource_id, 'url mismatch' FROM e WHERE full_url <> concat_ws('/', resource_type, resource_id)
        UNION ALL SELECT patient_id, resource_type, resource_id, 'duplicate' FROM e WHERE resource_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def _(t):
    return V.bundle_integrity(t.sql(_ENT))


_PI = """SELECT encounter_id AS provenance_id, 'Patient/' || CAST(patient_id + CASE WHEN encounter_id % 50 = 0 THEN 1000000 ELSE 0 END AS STRING) AS target, CASE WHEN encounter_id % 30 <> 0 THEN status END AS source,
   CASE WHEN encounter_id % 3 = 0 THEN encounter_id * 3 END AS previous_id FROM encounters"""


@query(
    "provenance_integrity",
    f"""WITH p AS ({_PI}), r AS (SELECT 'Patient/' || CAST(patient_id AS STRING) AS target FROM patients)
        SELECT (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE source IS NULL) AS without_source, (SELECT count(DISTINCT target) FROM p WHERE target NOT IN (SELECT target FROM r)) AS orphaned,
          (SELECT count(*) FROM r WHERE target NOT IN (SELECT target FROM p)) AS uncovered, (SELECT count(*) FROM p WHERE previous_id IS NOT NULL AND previous_id NOT IN (SELECT provenance_id FROM p)) AS broken""",
)
def _(t):
    return V.provenance_integrity(t.sql(_PI), t.patients.select(F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")).alias("target")))


_NPI = "SELECT provider_id, CASE provider_id % 7 WHEN 0 THEN '' WHEN 1 THEN '123-456-7890' WHEN 2 THEN '0' || substr(npi, 2) WHEN 3 THEN npi || '9' WHEN 4 THEN '9999999999' ELSE npi END AS npi FROM providers"


@query(
    "npi_rules",
    f"""WITH p AS (SELECT provider_id, regexp_replace(npi, '[^0-9]', '', 'g') AS d FROM ({_NPI})), c AS (SELECT d, count(*) AS n FROM p GROUP BY 1)
        SELECT provider_id, concat_ws(';', CASE WHEN d = '' THEN 'required' END, CASE WHEN length(d) <> 10 THEN 'length' END, CASE WHEN starts_with(d, '0') THEN 'leading zero' END,
          CASE WHEN d = '1234567890' THEN 'placeholder' END, CASE WHEN n > 1 THEN 'duplicate' END) AS issues FROM p JOIN c USING (d)""",
)
def _(t):
    return V.npi_issues(t.sql(_NPI))


@query("high_impact_changes", "SELECT change_id, field_name IN ('mrn', 'ssn', 'date_of_birth', 'first_name', 'last_name') AS high_impact FROM field_audit")
def _(t):
    return t.field_audit.select("change_id", F.col("field_name").isin(V.HIGH_IMPACT_FIELDS).alias("high_impact"))


_UPD = """SELECT event_id AS update_id, event_id % 1500 AS patient_id, CASE event_id % 5 WHEN 0 THEN 'date_of_birth' WHEN 1 THEN 'phone_number' WHEN 2 THEN 'email' WHEN 3 THEN 'mrn' ELSE 'address' END AS field_name,
   CASE event_id % 5 WHEN 0 THEN CASE event_id % 3 WHEN 0 THEN '01/02/1990' WHEN 1 THEN '1990-2-30' ELSE '25/12/1990' END WHEN 1 THEN CASE event_id % 2 WHEN 0 THEN '555-123-4567' ELSE '12345' END
     WHEN 2 THEN CASE event_id % 2 WHEN 0 THEN 'a.b@c.org' ELSE 'a.b@c' END WHEN 3 THEN 'MRN' || CAST(100000 + event_id % 3000 AS STRING) ELSE CASE event_id % 2 WHEN 0 THEN ' ' ELSE 'Street 1' END END AS new_value FROM events"""


@query(
    "update_checks",
    f"""WITH u AS ({_UPD}) SELECT update_id, field_name, CASE WHEN trim(new_value) = '' THEN false WHEN field_name = 'date_of_birth' THEN new_value <> '1990-2-30' WHEN field_name = 'phone_number' THEN new_value = '555-123-4567'
          WHEN field_name = 'email' THEN new_value = 'a.b@c.org' WHEN field_name = 'mrn' THEN NOT EXISTS (SELECT 1 FROM patients p WHERE p.mrn = u.new_value AND p.patient_id <> u.patient_id) ELSE true END AS valid FROM u""",
)
def _(t):
    return V.update_issues(t.sql(_UPD), t.patients)


_CFG = """SELECT event_id AS config_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'profile' END AS name, CAST(event_id % 13 AS DOUBLE) / 10 AS near_threshold, CAST(event_id % 11 AS DOUBLE) / 10 - 0.1 AS fuzzy_threshold,
   event_id % 7 - 1 AS tolerance_hours, event_id % 4 AS max_seconds, CASE event_id % 3 WHEN 0 THEN 'newest_wins' WHEN 1 THEN 'manual_review' ELSE 'coin_toss' END AS strategy FROM events"""


@query(
    "config_checks",
    f"""WITH c AS ({_CFG}) SELECT config_id, concat_ws(';', CASE WHEN name = '' THEN 'name' END, CASE WHEN near_threshold > 1 THEN 'near threshold' END, CASE WHEN fuzzy_threshold < 0 OR fuzzy_threshold > 1 THEN 'fuzzy threshold' END,
          CASE WHEN tolerance_hours < 0 THEN 'tolerance' END, CASE WHEN max_seconds <= 0 THEN 'time' END, CASE WHEN strategy = 'coin_toss' THEN 'strategy' END) AS issues FROM c""",
)
def _(t):
    return V.config_issues(t.sql(_CFG))


_LEAK = """SELECT r.patient_id, code, CASE WHEN source_id % 60 = 0 THEN code || ' of ' || last_name ELSE code || ' ' || body END AS display FROM resources r JOIN patients p ON r.patient_id = p.patient_id"""


@query(
    "leaked_names",
    f"""WITH s AS ({_LEAK}) SELECT s.patient_id, code, display FROM s JOIN patients p USING (patient_id) WHERE list_has_any(regexp_split_to_array(lower(display), '[^\\p{{L}}0-9]+'), [lower(last_name), lower(mrn)])""",
)
def _(t):
    return V.leaked_names(t.patients, t.sql(_LEAK))


@query(
    "unmatched_metric_types",
    f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {q(v)})" for k, v in fixed.CATEGORY_RESOURCE.items())}) AS v(category, resource_type)), h AS (SELECT DISTINCT resource_type FROM resources)
        SELECT 'category' AS side, category AS name FROM c WHERE resource_type NOT IN (SELECT resource_type FROM h) UNION ALL SELECT 'type', resource_type FROM h WHERE resource_type NOT IN (SELECT resource_type FROM c)""",
)
def _(t):
    categories = t.spark.createDataFrame(list(fixed.CATEGORY_RESOURCE.items()), "category string, resource_type string")
    return V.unmatched_types(categories, t.resources)
