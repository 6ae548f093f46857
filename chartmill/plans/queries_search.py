"""Queries for cohort search, listings and filters."""

from pyspark.sql import functions as F

from chartmill.operators import search as Q
from chartmill.plans.catalog import query

_CODES = """SELECT patient_id, resource_type AS kind, CASE WHEN source_id % 2 = 0 THEN split_part(code, '.', 1) ELSE code END AS code,
   CASE WHEN source_id % 7 = 0 THEN '' ELSE code || ' ' || body END AS display FROM resources"""
_DATES = "SELECT patient_id, visit_date AS day FROM encounters"
_PROV = "SELECT patient_id, 'Practitioner/' || CAST(source_id AS STRING) AS reference FROM resources"
_CTE = f"WITH c AS ({_CODES}), d AS ({_DATES}), p AS ({_PROV})"


def codes(t):
    return t.sql(_CODES)


@query("patients_with_code", f"{_CTE} SELECT patient_id FROM patients WHERE patient_id IN (SELECT patient_id FROM c WHERE code = 'E11' AND kind IN ('Condition'))")
def _(t):
    return Q.patients_with_code(t.patients, codes(t), "E11", ["Condition"]).select("patient_id")


for _name, _kind, _code in [
    ("patients_by_condition", "Condition", "J45"), ("patients_by_medication", "MedicationStatement", "Metformin"),
    ("patients_by_observation", "Observation", "2345-7"),
]:
    query(_name, f"{_CTE} SELECT patient_id, mrn FROM patients WHERE patient_id IN (SELECT patient_id FROM c WHERE kind = '{_kind}' AND code = '{_code}')")(
        lambda t, kind=_kind, code=_code: Q.patients_with_code(t.patients, codes(t), code, [kind]).select("patient_id", "mrn")
    )


@query("patients_in_date_range", f"{_CTE} SELECT patient_id FROM patients WHERE patient_id IN (SELECT patient_id FROM d WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-03-31')")
def _(t):
    return Q.patients_in_range(t.patients, t.sql(_DATES), "1998-01-01", "1998-03-31").select("patient_id")


@query("patients_by_provider", f"{_CTE} SELECT patient_id FROM patients WHERE patient_id IN (SELECT patient_id FROM p WHERE reference = 'Practitioner/7')")
def _(t):
    return t.patients.join(t.sql(_PROV).filter("reference = 'Practitioner/7'"), "patient_id", "left_semi").select("patient_id")


for _name, _every in [("cohort_combined_all", True), ("cohort_combined_any", False)]:
    _op = "INTERSECT" if _every else "UNION"
    query(
        _name,
        f"""{_CTE} SELECT patient_id FROM c WHERE code = 'I10' {_op} SELECT patient_id FROM c WHERE code = 'E66' {_op}
            SELECT patient_id FROM d WHERE day BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' {_op}
            SELECT patient_id FROM p WHERE reference IN ('Practitioner/3', 'Practitioner/4', 'Practitioner/5', 'Practitioner/x')""",
    )(
        lambda t, every=_every: Q.combined_search(
            codes(t), t.sql(_DATES), t.sql(_PROV), ["I10", "E66", "nobody has this"], ("1997-01-01", "1998-12-31"),
            ["Practitioner/3", "Practitioner/4", "Practitioner/5", "Practitioner/x"], every,
        )
    )


@query(
    "cohort_all_of_codes",
    f"{_CTE} SELECT patient_id FROM c WHERE kind = 'Condition' AND code IN ('E11', 'I10', 'J45') GROUP BY 1 HAVING count(DISTINCT code) = 3",
)
def _(t):
    return Q.patients_with_all(codes(t), ["E11", "I10", "J45", "none"], "Condition")


@query("cohort_any_of_codes", f"{_CTE} SELECT DISTINCT patient_id FROM c WHERE kind = 'Condition' AND code IN ('E11', 'I10')")
def _(t):
    return Q.patients_with_any(t.patients, codes(t), ["E11", "I10"], "Condition").select("patient_id")


_SETS = {"diabetic": Q.DIABETES, "hypertensive": Q.HYPERTENSION, "insulin": Q.INSULIN}


@query(
    "named_cohorts",
    f"{_CTE} " + " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS cohort, patient_id FROM c WHERE kind = 'Condition' AND code IN ({', '.join(repr(x) for x in v)})" for n, v in _SETS.items()
    ),
)
def _(t):
    hit = codes(t).filter("kind = 'Condition'")
    cohort = F
    for name, values in _SETS.items():
        cohort = cohort.when(F.col("code").isin(values), name)
    return hit.select(cohort.otherwise(None).alias("cohort"), "patient_id").filter("cohort IS NOT NULL").distinct()


@query("text_search", f"{_CTE} SELECT DISTINCT patient_id FROM c WHERE contains(lower(display), 'warfarin 20 mg') ORDER BY 1 LIMIT 50")
def _(t):
    return Q.text_search(codes(t), "Warfarin 20 mg", 50)


@query(
    "text_search_strict",
    f"{_CTE} SELECT patient_id FROM c GROUP BY 1 HAVING bool_or(contains(lower(display), 'insulin')) AND bool_or(display = '')",
)
def _(t):
    return Q.text_search(codes(t), "insulin", strict_reference=True)


@query("recently_active_patients", f"{_CTE} SELECT patient_id, max(day) AS last_day FROM d WHERE day >= DATE '2001-07-01' - 30 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(t):
    return Q.recently_active(t.sql(_DATES), "2001-07-01", 30, 100)


@query(
    "patient_code_summary",
    f"""{_CTE}, k AS (SELECT patient_id, count(DISTINCT code) FILTER (kind = 'Condition') AS condition, count(DISTINCT code) FILTER (kind = 'MedicationStatement') AS medicationstatement,
          count(DISTINCT code) FILTER (kind = 'Observation') AS observation FROM c GROUP BY 1),
        e AS (SELECT patient_id, count(DISTINCT day) AS encounters, max(day) AS last_encounter FROM d GROUP BY 1), r AS (SELECT patient_id, count(DISTINCT reference) AS providers FROM p GROUP BY 1)
        SELECT * FROM k FULL JOIN e USING (patient_id) FULL JOIN r USING (patient_id)""",
)
def _(t):
    return Q.medical_summary(codes(t), t.sql(_DATES), t.sql(_PROV))


_REQ = """SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'http://loinc.org' WHEN 1 THEN 'loinc' ELSE '' END AS code_system,
   CASE WHEN event_id % 5 = 0 THEN repeat('x', 60) ELSE 'E11' END AS code,
   CASE event_id % 4 WHEN 0 THEN '2023-13-01' WHEN 1 THEN '2030-01-01' WHEN 2 THEN '2020-02-02' ELSE '' END AS start_date,
   CASE WHEN event_id % 7 = 0 THEN 'Doctor/1' ELSE 'Practitioner/1' END AS provider_reference FROM events"""


@query(
    "check_search_requests",
    f"""WITH r AS ({_REQ}) SELECT request_id, concat_ws(';', CASE WHEN code_system = 'loinc' THEN 'code_system' END, CASE WHEN length(code) > 50 THEN 'code' END,
          CASE WHEN start_date = '2023-13-01' THEN 'start_date format' END, CASE WHEN start_date = '2030-01-01' THEN 'start_date future' END,
          CASE WHEN provider_reference = 'Doctor/1' THEN 'provider_reference' END) AS issues FROM r""",
)
def _(t):
    return Q.check_search(t.sql(_REQ), "2024-06-15").select("request_id", "issues")


@query(
    "patient_list_search",
    """SELECT p.patient_id, p.last_name, count(e.encounter_id) AS documents FROM patients p LEFT JOIN encounters e USING (patient_id)
       WHERE contains(lower(p.last_name), 'me') OR contains(lower(p.first_name), 'me') OR contains(lower(p.mrn), 'me') GROUP BY ALL""",
)
def _(t):
    found = t.patients.filter(Q.contains_text(["first_name", "last_name", "mrn"], "ME"))
    docs = t.encounters.groupBy("patient_id").agg(F.count("*").alias("documents"))
    return found.join(docs, "patient_id", "left").select(
        "patient_id", "last_name", F.coalesce("documents", F.lit(0)).alias("documents")
    ).orderBy("last_name", "patient_id")


@query(
    "provider_search",
    """SELECT provider_id, name, specialty FROM providers WHERE (contains(lower(name), '7') OR contains(npi, '7')) AND organization = '1' ORDER BY specialty, name""",
)
def _(t):
    found = t.providers.filter(Q.contains_text(["name", "npi"], "7") & (F.col("organization") == "1"))
    return found.select("provider_id", "name", "specialty").orderBy("specialty", "name")


@query(
    "document_list",
    """SELECT doc_id, status, filename FROM pipeline WHERE status = 'completed' AND patient_id = 17 AND contains(lower(filename), 'scan_') ORDER BY uploaded_at DESC""",
)
def _(t):
    rows = Q.matches_all(t.pipeline, [F.col("status") == "completed", F.col("patient_id") == 17, Q.contains_text(["filename"], "SCAN_")])
    return rows.orderBy(F.desc("uploaded_at")).select("doc_id", "status", "filename")


@query(
    "audit_trail_filter",
    """SELECT audit_id, logged_at, username FROM audit_log WHERE contains(lower(username), 'user1') AND category = 'view' AND logged_at >= TIMESTAMP '2024-01-03 00:00:00'
       AND logged_at < TIMESTAMP '2024-01-21 00:00:00' AND starts_with(ip_address, '10.0.') AND success AND contains(lower(description), 'item 1') AND severity IN ('warning')""",
)
def _(t):
    return Q.audit_trail(
        t.audit_log, username="User1", category="view", severity="warning", start="2024-01-03", end="2024-01-20", ip="10.0.", success=True, text="Item 1"
    ).select("audit_id", "logged_at", "username")


@query("listing_page", "SELECT doc_id, uploaded_at FROM pipeline WHERE status = 'failed' ORDER BY uploaded_at DESC, doc_id LIMIT 20 OFFSET 40")
def _(t):
    return Q.page(t.pipeline.filter("status = 'failed'"), [F.desc("uploaded_at"), F.col("doc_id")], 3, 20).select("doc_id", "uploaded_at")


_SOFT = "SELECT patient_id, owner AS created_by, CASE WHEN patient_id % 6 = 0 THEN birth_date END AS deleted_at FROM patients"


@query("soft_deleted_hidden", f"SELECT patient_id FROM ({_SOFT}) WHERE deleted_at IS NULL")
def _(t):
    return Q.not_deleted(t.sql(_SOFT)).select("patient_id")


@query("owned_rows", "SELECT doc_id FROM pipeline WHERE uploaded_by = '4'")
def _(t):
    return Q.visible_to(t.pipeline.withColumnRenamed("uploaded_by", "created_by"), "4", False).select("doc_id")


@query("report_date_filter", "SELECT condition_id, onset_text FROM conditions WHERE onset_text IS NULL OR (onset_text >= '1997-06' AND onset_text <= '1999-01-31')")
def _(t):
    return Q.in_report_range(t.conditions, "onset_text", "1997-06", "1999-01-31").select("condition_id", "onset_text")


@query("adhoc_sql", "SELECT status, count(*) AS n, round(sum(CAST(amount AS DECIMAL(18,2))), 2)::DOUBLE AS amount FROM encounters WHERE enc_class = 'AMB' GROUP BY 1")
def _(t):
    return t.spark.sql(
        "SELECT status, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM {enc} WHERE enc_class = :cls GROUP BY status",
        args={"cls": "AMB"}, enc=t.encounters,
    )
