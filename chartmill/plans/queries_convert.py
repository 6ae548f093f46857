"""Queries for conversion of extraction results."""

from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators import convert as C
from chartmill.plans.catalog import check_body, query
from chartmill.plans.extraction import FLAT, extraction_documents as docs
from chartmill.plans.sqltext import case_contains, case_map, words

_F = f"f AS ({FLAT})"
_DAY = "CASE WHEN length(date_text) = 10 THEN date_text END"
_EFF = f"coalesce({_DAY}, clinical_date)"


def _rid(kind, ord_="0", doc="encounter_id"):
    return f"sha256({doc} || '|{kind}|' || {ord_})"


@query(
    "convert_conditions",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY condition_id) - 1 AS ord FROM conditions)
        SELECT encounter_id AS doc_id, {_rid('Condition', 'ord')} AS resource_id, trim(name) AS name, CASE WHEN status IN ('active', 'inactive', 'resolved') THEN status ELSE 'active' END AS status,
          CASE evidence WHEN 'inferred' THEN 'unconfirmed' ELSE 'confirmed' END AS verification, code, onset_text AS effective, CASE length(onset_text) WHEN 7 THEN 'month' WHEN 10 THEN 'day' END AS precision FROM c""",
)
def _(t):
    return C.conditions(docs(t)).select("doc_id", "resource_id", "name", "status", "verification", "code", "effective", "precision")


_OBS = f"""WITH {_F}, o AS (SELECT o.*, f.clinical_date, loinc IN ('85354-9', '8867-4') AS vital, row_number() OVER (PARTITION BY o.encounter_id, loinc IN ('85354-9', '8867-4') ORDER BY obs_id) - 1 AS ord FROM observations o JOIN f USING (encounter_id)),
   v AS (SELECT *, CASE WHEN NOT vital AND source_id % 6 = 1 THEN NULL WHEN NOT vital AND source_id % 6 = 0 THEN CAST(1000 + line_no AS DOUBLE) ELSE value END AS num FROM o)"""


@query(
    "convert_observations",
    f"""{_OBS} SELECT encounter_id AS doc_id, CASE WHEN vital THEN {_rid('VitalObservation', 'ord')} ELSE {_rid('LabObservation', 'ord')} END AS resource_id, test_name AS name,
          {case_contains('lower(test_name)', [(c, [k]) for k, c in C.VITAL_LOINC], 'NULL')} AS code, CASE WHEN vital THEN 'vital-signs' ELSE 'laboratory' END AS category, num AS value,
          CASE WHEN num IS NULL THEN 'positive' END AS value_text, CASE WHEN vital OR line_no <> 2 THEN 'final' ELSE 'preliminary' END AS status, coalesce(CASE WHEN length(date_text) = 10 THEN date_text END, clinical_date) AS effective,
          CASE WHEN NOT vital AND flag <> 'N' THEN flag END AS interpretation, CASE WHEN NOT vital THEN '1-5' END AS reference_range, CASE WHEN loinc = '85354-9' THEN 2 ELSE 0 END AS components FROM v""",
)
def _(t):
    return C.observations(docs(t)).select(
        "doc_id", "resource_id", "name", "code", "category", "value", "value_text", "status", "effective", "interpretation", "reference_range", F.col("components").cast("int").alias("components")
    )


@query(
    "convert_components",
    f"""{_OBS} SELECT encounter_id AS doc_id, CAST(ord AS INT) AS ord, 0 AS part, 'Systolic' AS name, '8480-6' AS code, value, NULL AS value_text FROM v WHERE loinc = '85354-9'
        UNION ALL SELECT encounter_id, CAST(ord AS INT), 1, 'Diastolic', '8462-4', NULL, 'n/a' FROM v WHERE loinc = '85354-9'""",
)
def _(t):
    return C.components(docs(t)).select("doc_id", "ord", "part", "name", "code", "value", "value_text")


@query(
    "convert_exam_and_social",
    f"""WITH {_F} SELECT encounter_id AS doc_id, {_rid('ExamObservation')} AS resource_id, CASE WHEN encounter_id % 2 = 0 THEN 'Lung: clear' ELSE 'clear' END AS name, 'exam' AS category, 'clear' AS value_text, clinical_date AS effective FROM f
        UNION ALL SELECT encounter_id, {_rid('SocialObservation')}, CASE WHEN encounter_id % 2 = 0 THEN 'Tobacco Use' ELSE 'Social-History' END, 'social-history', 'never', clinical_date FROM f""",
)
def _(t):
    return C.exam_and_social(docs(t)).select("doc_id", "resource_id", "name", "category", "value_text", "effective")


@query(
    "convert_medications",
    f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY med_id) - 1 AS ord FROM medications) SELECT encounter_id AS doc_id, {_rid('MedicationStatement', 'ord')} AS resource_id, name, status, dose AS dosage, schedule AS frequency, start_date AS effective FROM m""",
)
def _(t):
    return C.medications(docs(t)).select("doc_id", "resource_id", "name", "status", "dosage", "frequency", "effective")


@query(
    "convert_medication_text",
    """WITH s AS (SELECT encounter_id AS doc_id, patient_id, CASE WHEN encounter_id % 2 = 0 THEN 'Aspirin 81 mg daily; Metformin 500 mg BID, ' ELSE 'Warfarin' END AS x FROM encounters)
       SELECT doc_id, 0 AS ord, CASE WHEN doc_id % 2 = 0 THEN 'Aspirin' ELSE 'Warfarin' END AS name, CASE WHEN doc_id % 2 = 0 THEN '81 mg' END AS dosage, CASE WHEN doc_id % 2 = 0 THEN 'daily' END AS schedule FROM s
       UNION ALL SELECT doc_id, 1, 'Metformin', '500 mg', 'bid' FROM s WHERE doc_id % 2 = 0""",
)
def _(t):
    rows = t.encounters.selectExpr("encounter_id AS doc_id", "patient_id", "CASE WHEN encounter_id % 2 = 0 THEN 'Aspirin 81 mg daily; Metformin 500 mg BID, ' ELSE 'Warfarin' END AS medication_text")
    return C.medications_from_text(rows).select("doc_id", "ord", "name", "dosage", "schedule")


_VAC = {n: words(n, fixed.VACCINE_WORDS) for n in ("proc_a", "proc_b")}
_CVX = {
    n: f"CASE WHEN {words(n, ['measles'])} AND {words(n, ['mumps', 'rubella'])} THEN '03' " + " ".join(f"WHEN {words(n, [w])} THEN '{c}'" for w, c, _ in fixed.CVX_BY_WORD) + " END"
    for n in ("proc_a", "proc_b", "vaccine")
}
_MEET = "coalesce(regexp_matches(lower({0}), '\\b' || lower({1}) || 's?\\b') OR regexp_matches(lower({1}), '\\b' || lower({0}) || 's?\\b'), false)"


@query(
    "convert_immunizations",
    f"""WITH {_F}, a AS (SELECT *, {_VAC['proc_a']} AND NOT {_MEET.format('proc_a', 'vaccine')} AS ta FROM f), b AS (SELECT *, {_VAC['proc_b']} AND NOT {_MEET.format('proc_b', 'vaccine')} AND NOT (ta AND {_MEET.format('proc_b', 'proc_a')}) AS tb FROM a)
        SELECT encounter_id AS doc_id, {_rid('Immunization')} AS resource_id, vaccine AS name, {_CVX['vaccine']} AS code, CASE WHEN forecast THEN 'not-done' ELSE 'completed' END AS status, CASE WHEN NOT forecast THEN {_EFF} END AS effective FROM b WHERE vaccine IS NOT NULL
        UNION ALL SELECT encounter_id, {_rid('ProcedureImmunization')}, proc_a, {_CVX['proc_a']}, 'completed', {_EFF} FROM b WHERE ta UNION ALL SELECT encounter_id, {_rid('ProcedureImmunization', '1')}, proc_b, {_CVX['proc_b']}, 'completed', clinical_date FROM b WHERE tb""",
)
def _(t):
    return C.immunizations(docs(t)).select("doc_id", "resource_id", "name", "code", "status", "effective")


@query(
    "convert_procedures",
    f"""WITH {_F} SELECT encounter_id AS doc_id, {_rid('Procedure')} AS resource_id, proc_a AS name, {_EFF} AS effective, reason AS outcome, NULL AS performer FROM f WHERE NOT {_VAC['proc_a']} AND NOT coalesce(regexp_matches(lower(proc_a), '\\b' || lower(vaccine) || 's?\\b'), false)
        UNION ALL SELECT encounter_id, {_rid('Procedure', '1')}, proc_b, clinical_date, NULL, trim(provider) FROM f WHERE NOT {_VAC['proc_b']} AND NOT coalesce(regexp_matches(lower(proc_b), '\\b' || lower(vaccine) || 's?\\b'), false)""",
)
def _(t):
    return C.procedures(docs(t)).select("doc_id", "resource_id", "name", "effective", "outcome", "performer")


_CLS = "CASE " + " ".join(f"WHEN {words('type_text', [k])} THEN '{c}'" for k, c in C.ENCOUNTER_CLASSES) + " ELSE 'AMB' END"


@query(
    "convert_encounters",
    f"""WITH {_F} SELECT encounter_id AS doc_id, {_rid('Encounter')} AS resource_id, type_text AS name, {_CLS} AS code, 'finished' AS status, {_DAY} AS effective, trim(location) AS location,
          CASE WHEN trim(provider) <> '' THEN trim(provider) || ', ' ELSE '' END || 'Nurse Joy' AS participants FROM f WHERE encounter_id % 4 <> 0""",
)
def _(t):
    return C.encounters(docs(t)).select("doc_id", "resource_id", "name", "code", "status", "effective", "location", "participants")


@query(
    "convert_encounters_strict",
    f"""WITH {_F} SELECT encounter_id AS doc_id, {case_contains('lower(type_text)', [(c, [k]) for k, c in C.ENCOUNTER_CLASSES], "'AMB'")} AS code FROM f WHERE encounter_id % 4 <> 0""",
)
def _(t):
    return C.encounters(docs(t), strict_reference=True).select("doc_id", "code")


@query("synthesize_encounters", f"WITH {_F} SELECT encounter_id AS doc_id, 'AMB' AS code, clinical_date AS effective, 0.6::DOUBLE AS confidence FROM f WHERE encounter_id % 4 = 0 AND clinical_date IS NOT NULL")
def _(t):
    return C.synthesized_encounters(docs(t)).select("doc_id", "code", "effective", "confidence")


@query(
    "convert_practitioners",
    f"""WITH {_F} SELECT encounter_id AS doc_id, trim(provider) AS name, CASE encounter_id % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Wilson' ELSE 'Cuddy' END AS family, CASE encounter_id % 4 WHEN 0 THEN 'Gregory' WHEN 1 THEN 'James' ELSE 'Lisa' END AS given FROM f WHERE trim(provider) <> ''""",
)
def _(t):
    return C.practitioners(docs(t)).select("doc_id", "name", "family", "given")


@query("convert_organizations", f"WITH {_F} SELECT encounter_id AS doc_id, 'County' AS name, CASE encounter_id % 4 WHEN 1 THEN 'dept' WHEN 2 THEN 'pay' ELSE 'prov' END AS code, 'Ulm' AS address FROM f")
def _(t):
    return C.organizations(docs(t)).select("doc_id", "name", "code", "address")


@query("convert_allergies", f"WITH {_F} SELECT encounter_id AS doc_id, 'Latex' AS name, CASE encounter_id % 5 WHEN 1 THEN 'moderate' WHEN 2 THEN 'mild' ELSE 'severe' END AS severity, 'active' AS status, 'unconfirmed' AS verification, 'rash' AS reaction FROM f")
def _(t):
    return C.allergies(docs(t)).select("doc_id", "name", "severity", "status", "verification", "reaction")


@query("convert_care_plans", f"WITH {_F} SELECT encounter_id AS doc_id, 'Plan ' || reason AS name, 'revoked' AS status, 'plan' AS intent, 'walk' AS goals, 'gym; diet' AS activities FROM f")
def _(t):
    return C.care_plans(docs(t)).select("doc_id", "name", "status", "intent", "goals", "activities")


_SC = case_contains("lower(name)", [(v[1], w) for v, w in fixed.SERVICE_CATEGORIES], "'Clinical specialty'")


@query(
    "convert_service_requests",
    f"""WITH {_F}, r AS (SELECT encounter_id AS doc_id, request AS name, reason, {_DAY} AS effective FROM f UNION ALL SELECT encounter_id, 'cardiology', 'As per treatment plan', NULL FROM f WHERE advice IS NOT NULL UNION ALL SELECT encounter_id, 'lipid panel', 'As per treatment plan', NULL FROM f WHERE advice IS NOT NULL)
        SELECT doc_id, name, 'routine' AS priority, reason, {_SC} AS category, effective FROM r""",
)
def _(t):
    return C.service_requests(docs(t)).select("doc_id", "name", "priority", "reason", "category", "effective")


_RC = case_contains("lower(name)", [(v[0], w) for v, w in fixed.REPORT_CATEGORIES], "'OTH'")
_DIAG = " OR ".join(f"contains(lower(name), '{w}')" for w in fixed.DIAGNOSTIC_WORDS)


@query(
    "convert_diagnostic_reports",
    f"""WITH {_F}, p AS (SELECT encounter_id AS doc_id, proc_a AS name, reason AS conclusion, {_DAY} AS effective FROM f UNION ALL SELECT encounter_id, proc_b, '', NULL FROM f),
        r AS (SELECT encounter_id AS doc_id, report AS name, 'clear; ' || reason AS conclusion, {_DAY} AS effective FROM f UNION ALL SELECT * FROM p WHERE {_DIAG}) SELECT doc_id, name, {_RC} AS category, 'final' AS status, conclusion, effective FROM r""",
)
def _(t):
    return C.diagnostic_reports(docs(t)).select("doc_id", "name", "category", "status", "conclusion", "effective")


@query("convert_family_history", f"WITH {_F} SELECT encounter_id AS doc_id, relative AS relationship, 'stroke' AS name, encounter_id % 2 = 0 AS deceased FROM f WHERE relative <> ''")
def _(t):
    return C.family_history(docs(t)).select("doc_id", "relationship", "name", "deceased")


@query("convert_all_resources")
def _(t):
    return C.resource_rows(docs(t, together=True))


@query(
    "derive_clinical_date",
    f"""WITH {_F}, p AS (SELECT *, CASE length(date_text) WHEN 4 THEN date_text || '-01-01' WHEN 7 THEN date_text || '-01' ELSE date_text END AS padded FROM f),
        o AS (SELECT encounter_id, min(CASE length(date_text) WHEN 4 THEN date_text || '-01-01' WHEN 7 THEN date_text || '-01' ELSE date_text END) AS first_item FROM observations GROUP BY 1),
        x AS (SELECT p.encounter_id, clinical_date AS a, CASE WHEN encounter_id % 4 <> 0 THEN padded END AS b, least(padded, first_item) AS c FROM p LEFT JOIN o USING (encounter_id))
        SELECT encounter_id AS doc_id, coalesce(a, b, c) AS clinical_date, CASE WHEN a IS NOT NULL THEN 'ai_clinical_date' WHEN b IS NOT NULL THEN 'encounter' WHEN c IS NOT NULL THEN 'clinical_item' END AS date_source FROM x""",
)
def _(t):
    return C.derived_clinical_date(docs(t))


_KEYS = "SELECT event_id AS doc_id, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 7 = 0 AS d FROM events"


@query(
    "document_type_from_keys",
    f"""WITH k AS ({_KEYS}) SELECT doc_id, CASE WHEN a AND b THEN 'lab_report' WHEN b THEN 'clinical_note' WHEN c THEN 'medication_list' WHEN a AND d THEN 'discharge_summary' ELSE 'generic' END AS document_type FROM k""",
)
def _(t):
    c = F.col
    kind = C.document_type({"test_date": c("a") & c("b"), "note_date": c("b"), "medications": c("c"), "admission_date": c("a"), "discharge_date": c("d")})
    return t.sql(_KEYS).select("doc_id", kind.alias("document_type"))


_FLATDOC = """SELECT encounter_id AS doc_id, CASE encounter_id % 5 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'clinical_note' WHEN 2 THEN 'medication_list' WHEN 3 THEN 'discharge_summary' ELSE 'generic' END AS document_type,
   type_text AS test_a, reason AS diag_a, status AS med_a, CASE WHEN encounter_id % 3 = 0 THEN ' Dr A ' ELSE '' END AS provider FROM encounters"""


@query(
    "flat_document_conversion",
    f"""WITH d AS ({_FLATDOC}) SELECT doc_id, 'Observation' AS resource_type, test_a AS name FROM d WHERE document_type = 'lab_report' UNION ALL SELECT doc_id, 'Condition', diag_a FROM d WHERE document_type IN ('clinical_note', 'discharge_summary')
        UNION ALL SELECT doc_id, 'MedicationStatement', med_a FROM d WHERE document_type IN ('medication_list', 'discharge_summary') UNION ALL SELECT doc_id, 'Practitioner', 'Dr A' FROM d WHERE provider <> ''""",
)
def _(t):
    rows = t.sql(_FLATDOC).withColumns({"tests": F.array("test_a", F.lit("")), "diagnoses": F.array("diag_a"), "medications": F.array("med_a")})
    return C.flat_document_rows(rows)


@query(
    "patient_resources",
    """SELECT 'Patient/' || patient_id AS reference, mrn, last_name AS family, first_name AS given, CAST(birth_date AS STRING) AS birth_date, CASE lower(gender) WHEN 'f' THEN 'female' ELSE lower(gender) END AS gender, phone FROM patients""",
)
def _(t):
    return C.patient_rows(t.patients)


@query("document_references", "SELECT doc_id, 'Patient/' || patient_id AS subject, 'current' AS status, filename AS title, uploaded_at AS date, 'Document/' || doc_id AS url FROM pipeline")
def _(t):
    return C.document_rows(t.pipeline)


_IDX = """SELECT patient_id, resource_type, resource_id, CASE WHEN source_id % 3 <> 0 THEN code END AS code, body AS display, CAST(CAST(updated_at AS DATE) AS STRING) AS effective,
   CASE WHEN resource_type = 'Encounter' THEN 'Practitioner/' || CAST(source_id AS STRING) END AS provider FROM resources"""


@query(
    "search_index",
    f"""WITH i AS ({_IDX}) SELECT DISTINCT patient_id, lower(resource_type) AS kind, code, display FROM i WHERE code IS NOT NULL AND trim(code) <> '' UNION ALL SELECT DISTINCT patient_id, 'date', effective, NULL FROM i
        UNION ALL SELECT DISTINCT patient_id, 'provider', provider, NULL FROM i WHERE provider IS NOT NULL""",
)
def _(t):
    return C.search_index(t.sql(_IDX))


@query("best_resource_date", "SELECT resource_id, resource_type, CASE resource_type WHEN 'Condition' THEN coalesce(onset, recorded) WHEN 'Observation' THEN effective ELSE coalesce(period_start, recorded) END AS best FROM (SELECT resource_id, resource_type, CASE WHEN source_id % 3 = 0 THEN '2001-01-01' END AS onset, '2002-02-02' AS recorded, CASE WHEN source_id % 4 = 0 THEN '2003-03-03' END AS effective, CASE WHEN source_id % 5 = 0 THEN '2004-04-04' END AS period_start FROM resources)")
def _(t):
    from chartmill.operators.report import best_date

    rows = t.resources.selectExpr(
        "resource_id", "resource_type", "CASE WHEN source_id % 3 = 0 THEN '2001-01-01' END AS onset", "'2002-02-02' AS recorded", "CASE WHEN source_id % 4 = 0 THEN '2003-03-03' END AS effective", "CASE WHEN source_id % 5 = 0 THEN '2004-04-04' END AS period_start"
    )
    return rows.select("resource_id", "resource_type", best_date(F.col("resource_type"), {c: F.col(c) for c in ("onset", "recorded", "effective", "period_start")}).alias("best"))


_DOCKEYS = """SELECT event_id AS doc_id, props AS meta, '{"encounter": {"id": "E' || CAST(event_id % 40 AS STRING) || '"}, "provider": "P' || CAST(event_id % 7 AS STRING) || '", "service_date": "2024-01-0' || CAST(event_id % 9 + 1 AS STRING) || '"}' AS payload FROM events"""


@query(
    "document_keys",
    """SELECT event_id AS doc_id, 'E' || event_id % 40 AS encounter_id, regexp_extract(props, '[0-9]+') AS visit_id, '2024-01-0' || (event_id % 9 + 1) AS document_date, 'P' || event_id % 7 AS provider_id FROM events""",
)
def _(t):
    from chartmill.operators.report import document_keys

    return document_keys(t.sql(_DOCKEYS).withColumn("meta", F.replace("meta", F.lit('"k"'), F.lit('"visit_id"'))))


@query(
    "resource_accessors",
    """SELECT encounter_id, status, upper(substr(enc_class, 1, 1)) || substr(enc_class, 2) AS title, coalesce(nullif(location, ''), 'Unknown') AS category, CASE WHEN encounter_id % 2 = 0 THEN 'NPI' || encounter_id END AS npi FROM encounters""",
)
def _(t):
    from chartmill.operators.report import resource_fields

    body = F.to_json(F.struct(
        F.col("status"), F.struct(F.concat(F.upper(F.substring("enc_class", 1, 1)), F.expr("substr(enc_class, 2)")).alias("text")).alias("code"),
        F.array(F.struct(F.when(F.col("location") != "", F.col("location")).alias("text"))).alias("category"),
        F.array(F.struct(F.lit("npi").alias("system"), F.when(F.col("encounter_id") % 2 == 0, F.concat(F.lit("NPI"), F.col("encounter_id").cast("string"))).alias("value"))).alias("identifier"),
    ))
    return resource_fields(t.encounters.select("encounter_id", F.parse_json(body).alias("body"))).select("encounter_id", "status", "title", F.coalesce("category", F.lit("Unknown")).alias("category"), "npi")


@query("dotted_paths", "SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, 'v' || event_id AS deep FROM events")
def _(t):
    from chartmill.operators.report import select_paths

    body = F.concat(F.lit('{"props": '), F.col("props"), F.lit(', "a": {"b": [{"c": "v'), F.col("event_id").cast("string"), F.lit('"}]}}'))
    rows = t.events.select("event_id", F.parse_json(body).alias("body"))
    return select_paths(rows, "body", {"k": ("$.props.k", "bigint"), "deep": ("$.a.b[0].c", "string")}).select("event_id", "k", "deep")


# type, name and date in the columns of each projection's own check; dates that a check does not give are not compared
_ALL = {
    "convert_conditions": ("Condition", "name", "effective"), "convert_observations": ("Observation", "name", "effective"), "convert_exam_and_social": ("Observation", "name", "effective"),
    "convert_medications": ("MedicationStatement", "name", "effective"), "convert_immunizations": ("Immunization", "name", "effective"), "convert_procedures": ("Procedure", "name", "effective"),
    "convert_encounters": ("Encounter", "NULL", "effective"), "synthesize_encounters": ("Encounter", "NULL", "effective"), "convert_practitioners": ("Practitioner", "name", "NULL"),
    "convert_organizations": ("Organization", "name", "NULL"), "convert_allergies": ("AllergyIntolerance", "name", "NULL"), "convert_care_plans": ("CarePlan", "name", "NULL"),
    "convert_service_requests": ("ServiceRequest", "name", "effective"), "convert_diagnostic_reports": ("DiagnosticReport", "name", "effective"), "convert_family_history": ("FamilyMemberHistory", "name", "NULL"),
}
_UNITED = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS resource_type, CAST({name} AS VARCHAR) AS name, CAST({day} AS VARCHAR) AS effective, {'status' if kind == 'Immunization' else 'NULL'} AS status FROM ({check_body(check)})" for check, (kind, name, day) in _ALL.items()
)


@query(
    "convert_all_linked",
    f"""WITH u AS ({_UNITED}), e AS (SELECT doc_id, effective AS visit FROM u WHERE resource_type = 'Encounter')
        SELECT u.doc_id, resource_type, name, effective, resource_type IN ({', '.join(f"'{x}'" for x in C.LINKED_TYPES)}) AND status IS DISTINCT FROM 'not-done' AND e.doc_id IS NOT NULL
               AND (effective IS NULL OR coalesce(starts_with(effective, visit) OR starts_with(visit, effective), false)) AS linked FROM u LEFT JOIN e ON e.doc_id = u.doc_id""",
)
def _(t):
    rows = C.resource_rows(docs(t, together=True))
    dated = F.col("resource_type").isin(*[kind for kind, _, day in _ALL.values() if day != "NULL"])
    return rows.select(
        "doc_id", "resource_type", F.when(F.col("resource_type") != "Encounter", F.col("name")).alias("name"), F.when(dated, F.col("effective").cast("string")).alias("effective"), F.col("encounter_id").isNotNull().alias("linked")
    )
