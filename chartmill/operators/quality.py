"""Validation rules and review decisions; each rule set yields issue rows or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S

# fixed values
SEVERITY_PENALTY = {"critical": 20, "error": 10, "warning": 3, "info": 1}
REQUIRED_FIELDS = {
    "lab_report": ["patient_name", "test_date", "tests"],
    "clinical_note": ["patient_name", "note_date", "provider"],
    "medication_list": ["patient_name", "list_date", "medications"],
    "discharge_summary": ["patient_name", "admission_date", "discharge_date"],
    "generic": ["patient_name", "document_date"],
}
ARRAY_FIELDS = ["tests", "diagnosis_codes", "medications", "diagnosis", "procedures"]
NAME_FIELDS = {"patient_name": (2, 100), "provider": (2, 100)}
HIGH_IMPACT_FIELDS = ["mrn", "ssn", "date_of_birth", "first_name", "last_name"]
CONFLICT_STRATEGIES = ["newest_wins", "preserve_both", "manual_review", "confidence_based"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def resource_issues(resources: DataFrame) -> DataFrame:
    """Structure, completeness and safety issues: one row per broken rule.

    ``resources(patient_id, resource_type, resource_id, code, body, status, display, value, unit)``.
    """
    kind = F.col("resource_type")

    def rule(when: Column, severity: str, category: str, message: str) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(message).alias("message")))

    no_code, no_body = F.col("code").isNull(), F.col("body").isNull()
    rules = F.array(
        rule(kind.isNull(), "error", "structure", "missing type"),
        rule(F.col("resource_id").isNull(), "warning", "structure", "missing id"),
        rule(kind.isin("Observation", "Condition") & no_code, "error", "completeness", "missing code"),
        rule((kind == "Observation") & no_body, "warning", "completeness", "missing value"),
        rule((kind == "Condition") & F.col("status").isNull(), "warning", "completeness", "missing clinical status"),
        rule((kind == "MedicationStatement") & no_code, "error", "completeness", "missing medication"),
        rule(critical_glucose(F.col("display"), F.col("value"), F.col("unit")), "critical", "safety", "critical glucose"),
    )
    return resources.select("patient_id", "resource_type", "resource_id", F.inline(F.array_compact(rules)))


def critical_glucose(display: Column, value: Column, unit: Column) -> Column:
    return F.lower(display).contains("glucose") & (value > 400) & (F.lower(unit) == "mg/dl")


def quality_score(resources: DataFrame, issues: DataFrame, *keys: str) -> DataFrame:
    """100 minus the penalty share of five points per resource, not below 0."""
    n = resources.groupBy(*keys).agg(F.count("*").alias("resources"))
    bad = issues.groupBy(*keys).agg(F.sum(S.lookup(F.col("severity"), SEVERITY_PENALTY, 1)).alias("penalty"), F.count("*").alias("issues"))
    out = n.join(bad, list(keys), "left").fillna(0, ["penalty", "issues"])
    score = F.greatest(F.lit(0.0), 100 - F.col("penalty") / (F.col("resources") * 5) * 100)
    return out.withColumn("score", S.half_up(score, 2))


def corrected(resources: DataFrame, seed: list[str]) -> DataFrame:
    """Fill a missing id with a hash of ``seed`` and a missing condition status with 'active'."""
    made = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in seed]), 256)
    status = F.when((F.col("resource_type") == "Condition") & F.col("status").isNull(), "active").otherwise(F.col("status"))
    return resources.withColumns({"resource_id": F.coalesce("resource_id", made), "status": status})


def schema_issues(docs: DataFrame) -> DataFrame:
    """Required fields and lengths per document type; ``docs(doc_id, document_type, data map)``."""
    data = F.col("data")

    def blank(field):
        return F.trim(F.coalesce(F.element_at(data, field), F.lit(""))) == ""

    required = F
    for kind, fields in REQUIRED_FIELDS.items():
        if kind != "generic":
            required = required.when(F.col("document_type") == kind, F.array(*[F.when(blank(f), F.lit(f"required {f}")) for f in fields]))
    required = required.otherwise(F.array(*[F.when(blank(f), F.lit(f"required {f}")) for f in REQUIRED_FIELDS["generic"]]))
    lengths = []
    for field, (low, high) in NAME_FIELDS.items():
        n = F.length(F.element_at(data, field))
        lengths += [F.when(n < low, F.lit(f"short {field}")), F.when(n > high, F.lit(f"long {field}"))]
    arrays = [F.when(~F.element_at(data, f).startswith("["), F.lit(f"array {f}")) for f in ARRAY_FIELDS]
    found = F.array_compact(F.concat(required, F.array(*lengths), F.array(*arrays)))
    return docs.select("doc_id", "document_type", F.explode(found).alias("issue"))


def business_issues(docs: DataFrame) -> DataFrame:
    """Name, stay, range and cross-field rules in one pass.

    ``docs(doc_id, patient_name, record_name, admission, discharge, test_date, collection, test_name, test_value, pressure, provider, dosage, today)``.
    """
    up, low = F.split("pressure", "/")[0].try_cast("int"), F.split("pressure", "/")[1].try_cast("int")
    gap = F.datediff("test_date", "collection")
    glucose = F.lower("test_name").contains("glucose")
    found = S.issues(
        (F.lower(S.normalize_name(F.col("patient_name"))) != F.lower(S.normalize_name(F.col("record_name"))), "name differs"),
        (F.col("discharge") < F.col("admission"), "discharge before admission"),
        (F.trim(F.coalesce("test_name", F.lit(""))) == "", "test without name"),
        (F.col("test_value").isNull(), "test without value"),
        (F.year("admission") < 1900, "date before 1900"), (F.col("admission") > F.col("today"), "date in the future"),
        (glucose & ((F.col("test_value") < 0) | (F.col("test_value") > 1000)), "glucose out of range"),
        ((up < 50) | (up > 300), "systolic out of range"), ((low < 30) | (low > 200), "diastolic out of range"),
        (gap > 7, "test late after collection"), (gap < 0, "test before collection"),
        (F.trim(F.coalesce("provider", F.lit(""))) == "", "no provider"), (F.col("dosage").isNull(), "medication without dosage"),
    )
    return docs.select("doc_id", F.explode(found).alias("issue"))


def pipeline_checks(docs: DataFrame) -> DataFrame:
    """Five checkpoints per document: valid, can proceed, issues and recommendation.

    ``docs(doc_id, text_issues array, conditions, medications, vitals, labs, confidence, made_conditions, made_medications, status, errors)``.
    """
    total = F.col("conditions") + F.col("medications") + F.col("vitals") + F.col("labs")
    mismatch = [(F.abs(F.col(a) - F.col(f"made_{a}")) > 2, f"{a} count mismatch") for a in ("conditions", "medications")]
    made = F.col("made_conditions") + F.col("made_medications")

    def stage(name, issues, blocked, advice):
        return F.struct(F.lit(name).alias("stage"), issues.alias("issues"), (~blocked).alias("can_proceed"), F.when(F.size(issues) > 0, F.lit(advice)).alias("advice"))

    never = F.lit(False)
    stages = F.array(
        stage("pre_ai_extraction", F.col("text_issues"), never, "Consider manual review - text quality issues detected"),
        stage("post_ai_extraction", S.issues((total == 0, "no medical data"), (F.col("confidence") < 0.3, "low confidence")), never,
              "Consider manual review - AI extraction quality issues detected"),
        stage("pre_fhir_conversion", S.issues((total == 0, "no data to convert")), total == 0, "Consider manual review before FHIR conversion"),
        stage("post_fhir_conversion", S.issues((made == 0, "no resources"), (F.col("made_conditions") == 0, "missing Condition"), (F.col("made_medications") == 0, "missing MedicationStatement")),
              never, "FHIR resources have validation issues - consider manual review"),
        stage("final_processing", S.issues((~F.col("status").isin("processed", "completed"), "invalid status"), (F.col("errors") > 0, "errors logged"), *mismatch), never, "Review processing"),
    )
    return docs.select("doc_id", F.inline(stages)).select(
        "doc_id", "stage", (F.size("issues") == 0).alias("is_valid"), "can_proceed", F.array_join("issues", ";").alias("issues"), "advice"
    )


def review_decision(confidence: Column, model: Column, fallback: Column, resources: Column, conflict: Column) -> Column:
    """Flag reason of the first rule that holds, null when auto-approved."""
    return (
        F.when(confidence.isNull() | (confidence < 0.80), "low confidence")
        .when(F.lower(model).contains("gpt"), "fallback model").when(fallback.isNotNull() & (fallback != ""), "fallback method")
        .when(resources == 0, "no resources").when((resources < 3) & (confidence < 0.95), "few resources")
        .when(conflict, "patient conflict")
    )


def quick_conflict(name: Column, birth: Column, record_name: Column, record_birth: Column) -> Column:
    """Reasons: birth date differs; names share no word and neither contains the other."""
    a, b = F.lower(F.trim(name)), F.lower(F.trim(record_name))
    apart = (
        (a != "") & (b != "") & ~b.contains(a) & ~a.contains(b)
        & ~F.arrays_overlap(F.split(S.squeeze(a), " "), F.split(S.squeeze(b), " "))
    )
    return S.issues((birth != record_birth, "birth date"), (apart, "name"))


def field_quality(label: Column, value: Column) -> Column:
    """struct(valid, score, issue) of one field value."""
    text, low = F.trim(F.coalesce(value, F.lit(""))), F.lower(label)
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))

    def verdict(valid, score, issue=None):
        return F.struct(F.lit(valid).alias("valid"), F.lit(score).alias("score"), F.lit(issue).cast("string").alias("issue"))

    good = verdict(True, 1.0)
    return (
        F.when(text == "", verdict(False, 0.0, "empty"))
        .when(S.any_of(low, ["date", "dob", "birth"]), F.when(text.rlike(r"^(\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{4}-\d{1,2}-\d{1,2})"), good).otherwise(verdict(False, 0.3, "date format")))
        .when(low.contains("phone"), F.when(digits.isin(10, 11), good).otherwise(verdict(False, 0.4, "phone length")))
        .when(low.contains("email"), F.when(text.rlike(EMAIL), good).otherwise(verdict(False, 0.2, "email format")))
        .when(low.contains("name"), F.when(F.length(text) < 2, verdict(False, 0.1, "name short")).when(~text.rlike(r"^[a-zA-Z\s.\-']+$"), verdict(True, 0.6, "name characters")).otherwise(good))
        .otherwise(good)
    )


def data_quality(fields: DataFrame) -> DataFrame:
    """Share of valid fields and mean score per document."""
    q = fields.withColumn("q", field_quality(F.col("label"), F.col("value")))
    return q.groupBy("doc_id").agg(
        F.count("*").alias("fields"), F.count_if("q.valid").alias("valid"), S.half_up(F.count_if("q.valid") / F.count("*"), 6).alias("completeness"),
        S.half_up(F.avg(F.col("q.score").cast("decimal(4,2)").cast("double")), 4).alias("quality"),
    )


def bundle_integrity(entries: DataFrame) -> DataFrame:
    """Issues of bundle entries ``(patient_id, resource_type, resource_id, full_url)``: missing id, wrong url, duplicate key."""
    url = F.concat_ws("/", "resource_type", "resource_id")
    rows = entries.select("patient_id", "resource_type", "resource_id", F.explode(S.issues(
        (F.col("resource_id").isNull(), "missing id"), (F.col("full_url") != url, "url mismatch"))).alias("issue"))
    twice = entries.filter("resource_id IS NOT NULL").groupBy("patient_id", "resource_type", "resource_id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.unionByName(twice.select("patient_id", "resource_type", "resource_id", F.lit("duplicate").alias("issue")))


def provenance_integrity(provenance: DataFrame, resources: DataFrame) -> DataFrame:
    """Counts of orphaned targets, broken chains and uncovered resources.

    ``provenance(provenance_id, target, source, previous_id)``; ``resources(target)``.
    """
    known = resources.select("target").distinct()
    orphans = provenance.select("target").distinct().join(known, "target", "left_anti").agg(F.count("*").alias("orphaned"))
    bare = known.join(provenance, "target", "left_anti").agg(F.count("*").alias("uncovered"))
    ids = provenance.select(F.col("provenance_id").alias("previous_id"))
    broken = provenance.filter("previous_id IS NOT NULL").join(ids, "previous_id", "left_anti").agg(F.count("*").alias("broken"))
    total = provenance.agg(F.count("*").alias("total"), F.count_if(F.col("source").isNull()).alias("without_source"))
    return total.crossJoin(orphans).crossJoin(bare).crossJoin(broken)  # four single rows


def npi_issues(providers: DataFrame) -> DataFrame:
    digits = F.regexp_replace("npi", r"[^0-9]", "")
    rows = providers.withColumn("npi_digits", digits)
    twice = rows.groupBy("npi_digits").agg(F.count("*").alias("n")).filter("n > 1").select("npi_digits", F.lit(True).alias("__twice"))
    out = rows.join(twice, "npi_digits", "left")
    found = S.issues(
        (F.col("npi_digits") == "", "required"), (F.length("npi_digits") != 10, "length"), (F.col("npi_digits").startswith("0"), "leading zero"),
        (F.col("npi_digits").isin("1234567890", "0123456789"), "placeholder"), (F.col("__twice"), "duplicate"),
    )
    return out.select("provider_id", F.array_join(found, ";").alias("issues"))


def update_issues(updates: DataFrame, patients: DataFrame) -> DataFrame:
    """Whether each proposed field update ``(update_id, patient_id, field_name, new_value)`` is valid."""
    taken = patients.select(F.col("mrn").alias("new_value"), F.col("patient_id").alias("__owner"))
    mrn = updates.filter("field_name = 'mrn'").join(taken, "new_value").filter("__owner <> patient_id").select("update_id", F.lit(True).alias("__taken")).distinct()
    text = F.trim(F.coalesce("new_value", F.lit("")))
    date_ok = F.coalesce(*[F.try_to_date(text, f) for f in ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "d/M/yyyy")]).isNotNull()
    ok = (
        F.when(text == "", False).when(F.col("field_name") == "date_of_birth", date_ok)
        .when(F.col("field_name") == "phone_number", F.length(F.regexp_replace(text, r"[^0-9]", "")).isin(10, 11))
        .when(F.col("field_name") == "email", text.rlike(EMAIL))
        .when(F.col("field_name") == "mrn", text.rlike("^[a-zA-Z0-9]{3,}$") & F.col("__taken").isNull()).otherwise(True)
    )
    return updates.join(mrn, "update_id", "left").select("update_id", "field_name", ok.alias("valid"))


def config_issues(configs: DataFrame) -> DataFrame:
    def outside(c):
        return ~F.col(c).between(0, 1)

    found = S.issues(
        (F.coalesce("name", F.lit("")) == "", "name"), (outside("near_threshold"), "near threshold"), (outside("fuzzy_threshold"), "fuzzy threshold"),
        (F.col("tolerance_hours") < 0, "tolerance"), (F.col("max_seconds") <= 0, "time"), (~F.col("strategy").isin(CONFLICT_STRATEGIES), "strategy"),
    )
    return configs.select("config_id", F.array_join(found, ";").alias("issues"))


def leaked_names(patients: DataFrame, search_rows: DataFrame) -> DataFrame:
    """Search rows whose text holds a word equal to the patient's own last name or record number."""
    words = F.split(F.lower("display"), r"[^\p{L}\d]+")
    own = F.array_distinct(F.flatten(F.collect_list(F.array(F.lower("last_name"), F.lower("mrn")))))
    private = patients.groupBy("patient_id").agg(own.alias("__private"))
    return search_rows.join(private, "patient_id").filter(F.arrays_overlap(words, "__private")).select("patient_id", "code", "display")


def unmatched_types(categories: DataFrame, produced: DataFrame) -> DataFrame:
    """Metric categories without a producible type, and types without a category."""
    have = produced.select("resource_type").distinct()
    lost = categories.join(have, "resource_type", "left_anti").select(F.lit("category").alias("side"), F.col("category").alias("name"))
    bare = have.join(categories, "resource_type", "left_anti").select(F.lit("type").alias("side"), F.col("resource_type").alias("name"))
    return lost.unionByName(bare)
