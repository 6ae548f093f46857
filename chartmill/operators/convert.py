"""Projection of nested extraction results into typed clinical tables.

Every function takes documents ``(doc_id, patient_id, clinical_date, data)``
with ``data`` of schema ``RESPONSE`` and returns one row per resource. Only the
nested columns a projection names are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.schemas import LISTS

# fixed values
VITAL_LOINC = [
    ("blood pressure", "85354-9"), ("systolic", "8480-6"), ("diastolic", "8462-4"), ("heart rate", "8867-4"), ("pulse", "8867-4"),
    ("temperature", "8310-5"), ("respiratory rate", "9279-1"), ("oxygen saturation", "59408-5"), ("height", "8302-2"),
    ("weight", "29463-7"), ("bmi", "39156-5"),
]
ENCOUNTER_CLASSES = [
    ("office visit", "AMB"), ("ambulatory", "AMB"), ("outpatient", "AMB"), ("emergency", "EMER"), ("er", "EMER"),
    ("inpatient", "IMP"), ("hospital", "IMP"), ("telehealth", "VR"), ("virtual", "VR"), ("home", "HH"),
]
CONDITION_STATUS = ["active", "inactive", "resolved", "recurrence", "remission"]
MEDICATION_STATUS = ["active", "stopped", "completed", "on-hold", "intended"]
LAB_STATUS = ["final", "preliminary", "amended", "corrected", "cancelled"]
ENCOUNTER_STATUS = ["planned", "arrived", "in-progress", "onleave", "finished", "cancelled"]
ALLERGY_SEVERITY = {"mild": "mild", "moderate": "moderate", "severe": "severe", "life-threatening": "severe"}
PLAN_STATUS = ["draft", "active", "completed", "cancelled", "on-hold", "revoked"]
PLAN_INTENT = ["proposal", "plan", "order"]
ORGANIZATION_TYPES = [("hospital", "prov"), ("clinic", "prov"), ("lab", "dept"), ("pharmacy", "prov"), ("payer", "pay")]
CLINICAL_LISTS = ["conditions", "medications", "vital_signs", "lab_results", "procedures"]
LINKED_TYPES = ["Observation", "Condition", "Procedure", "MedicationStatement", "DiagnosticReport", "ServiceRequest", "Immunization"]


def taken_out(docs: DataFrame, *names: str) -> DataFrame:
    """Keys of the documents and the named lists as columns."""
    return docs.select("doc_id", "patient_id", "clinical_date", "run_date", *[F.col(f"data.{n}").alias(n) for n in names])


def items(docs: DataFrame, name: str) -> DataFrame:
    """One row per list entry as struct ``x`` with its position.

    The list is taken out of the document before it is spread: what other lists
    are made of, with the joins for it, then falls out of the plan.
    """
    return taken_out(docs, name).select("doc_id", "patient_id", "clinical_date", "run_date", F.posexplode(name).alias("ord", "x"))


def filled(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.trim(c) != "", F.lit(False))


def resource_id(kind: str) -> Column:
    """Stable id: hash of document, type and position."""
    return _hashed(F.lit(kind))


def _hashed(kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), kind, F.col("ord").cast("string")), 256)


def known(column: str, allowed: list[str], default: str) -> Column:
    low = F.lower(F.trim(column))
    return F.when(low.isin(allowed), low).otherwise(default)


def contained(column: Column, table: list[tuple[str, str]], default: str | None, whole_words: bool = False) -> Column:
    """Value of the first contained key."""
    low, out = F.lower(column), F
    for key, value in table:
        out = out.when(S.has_word(column, [key]) if whole_words else low.contains(key), value)
    return out.otherwise(default)


def day(column: str) -> Column:
    """ISO text of a date; null when none is found or it lies behind the documents' ``run_date``."""
    return S.clinical_date(F.col(column), F.col("run_date")).cast("string")


def clinical_or(column: str) -> Column:
    return F.coalesce(day(column), F.col("clinical_date"))


def _base(kind: str) -> list[Column]:
    return ["doc_id", "patient_id", "ord", resource_id(kind).alias("resource_id"), F.lit(kind).alias("resource_type"), F.lit(kind).alias("origin")]


def _evidence(x: str) -> dict[str, Column]:
    """Confidence and source text of an entry."""
    return {"confidence": F.col(f"{x}.confidence"), "source_text": F.trim(f"{x}.source.text")}


class Kind(NamedTuple):
    """Resources of one origin: which entries ``x`` of a list they are made of, and of what their columns.

    The column ``__day`` is the day that is read from the text ``date``.
    """

    origin: str
    source: str
    keep: Column
    columns: dict[str, Column]
    date: Column | None = None
    resource_type: str | None = None
    entries: Callable | None = None  # the entries of a document for ``one_pass``, where they are not those of the list


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _clinical_or_day() -> Column:
    return F.coalesce("__day", "clinical_date")


def _projected(rows: DataFrame, kind: Kind) -> DataFrame:
    """Resources of one kind from the entries of its list."""
    dated = rows.filter(kind.keep)
    if kind.date is not None:
        dated = dated.withColumn("__day", S.clinical_date(kind.date, F.col("run_date")).cast("string"))
    return dated.select(*_base(kind.origin), *[c.alias(n) for n, c in kind.columns.items()]).withColumn("resource_type", F.lit(kind.resource_type or kind.origin))


def _condition(x: str = "x") -> Kind:
    raw = F.trim(f"{x}.onset_date")
    month = F.concat_ws("-", F.substring(raw, 1, 4), F.lpad(F.regexp_extract(raw, r"^\d{4}[-/](\d{1,2})$", 1), 2, "0"))
    year_month = raw.rlike(r"^\d{4}[-/](0?[1-9]|1[0-2])$")
    onset = F.when(raw.rlike(r"^\d{4}$"), raw).when(year_month, month).otherwise(F.col("__day"))
    kind = F.when(raw.rlike(r"^\d{4}$"), "year").when(year_month, "month").when(onset.isNotNull(), "day")
    return Kind("Condition", "conditions", filled(f"{x}.name"), {
        "name": F.trim(f"{x}.name"), "status": known(f"{x}.status", CONDITION_STATUS, "active"),
        "verification": F.when(F.lower(F.trim(f"{x}.evidence_type")) == "inferred", "unconfirmed").otherwise("confirmed"),
        "code": F.trim(f"{x}.icd_code"), "effective": onset, "precision": kind, **_evidence(x),
    }, F.col(f"{x}.onset_date"))


def conditions(docs: DataFrame) -> DataFrame:
    """Status map, partial onset kept as given, inferred evidence unconfirmed."""
    return _projected(items(docs, "conditions"), _condition())


def _value(column: str) -> dict[str, Column]:
    number = F.trim(F.replace(F.col(column), F.lit(","), F.lit(""))).try_cast("double")
    return {"value": number, "value_text": F.when(number.isNull() & filled(column), F.trim(column))}


def _vital(x: str = "x") -> Kind:
    return Kind("VitalObservation", "vital_signs", filled(f"{x}.measurement"), {
        "name": F.trim(f"{x}.measurement"), "code": contained(F.col(f"{x}.measurement"), VITAL_LOINC, None),
        "category": F.coalesce(f"{x}.category", F.lit("vital-signs")), "effective": _clinical_or_day(), **_value(f"{x}.value"), "unit": F.trim(f"{x}.unit"),
        "status": F.lit("final"), "reference_range": _no_text(), "interpretation": _no_text(), "panel_name": _no_text(), **_evidence(x),
        "components": F.size(F.filter(F.coalesce(f"{x}.components", F.array()), lambda c: (F.trim(c["measurement"]) != "") & c["value"].isNotNull())),
    }, F.col(f"{x}.timestamp"), "Observation")


def _lab(x: str = "x") -> Kind:
    return Kind("LabObservation", "lab_results", filled(f"{x}.test_name"), {
        "name": F.trim(f"{x}.test_name"), "code": contained(F.col(f"{x}.test_name"), VITAL_LOINC, None),
        "category": F.coalesce(f"{x}.category", F.lit("laboratory")), "effective": _clinical_or_day(), **_value(f"{x}.value"), "unit": F.trim(f"{x}.unit"),
        "status": known(f"{x}.status", LAB_STATUS, "final"), "reference_range": F.trim(f"{x}.reference_range"),
        "interpretation": F.when(filled(f"{x}.abnormal_flag"), F.trim(f"{x}.abnormal_flag")), "panel_name": F.trim(f"{x}.panel_name"), **_evidence(x), "components": F.lit(0),
    }, F.col(f"{x}.test_date"), "Observation")


def observations(docs: DataFrame) -> DataFrame:
    """Vital signs and laboratory results."""
    return _projected(items(docs, "vital_signs"), _vital()).unionByName(_projected(items(docs, "lab_results"), _lab()))


def components(docs: DataFrame) -> DataFrame:
    """Parts of composite vital signs such as blood pressure."""
    parts = items(docs, "vital_signs").select("doc_id", "ord", F.posexplode("x.components").alias("part", "c"))
    number = F.trim(F.replace(F.col("c.value"), F.lit(","), F.lit(""))).try_cast("double")
    return parts.filter(filled("c.measurement") & F.col("c.value").isNotNull()).select(
        "doc_id", "ord", "part", F.trim("c.measurement").alias("name"), contained(F.col("c.measurement"), VITAL_LOINC, None).alias("code"),
        number.alias("value"), F.when(number.isNull(), F.trim("c.value")).alias("value_text"), F.trim("c.unit").alias("unit"),
    )


def _exam(x: str = "x") -> Kind:
    return Kind("ExamObservation", "physical_exam_findings", filled(f"{x}.finding"), {
        "name": F.concat_ws(": ", F.when(filled(f"{x}.body_site"), F.trim(f"{x}.body_site")), F.trim(f"{x}.finding")), "category": F.lit("exam"),
        "value_text": F.trim(f"{x}.finding"), "interpretation": F.trim(f"{x}.status"), "effective": F.col("clinical_date"), **_evidence(x),
    }, resource_type="Observation")


def _social(x: str = "x") -> Kind:
    tag = F.when(filled(f"{x}.category"), F.trim(f"{x}.category")).otherwise("social-history")
    return Kind("SocialObservation", "social_history", filled(f"{x}.description"), {
        "name": S.title_case(F.replace(tag, F.lit("_"), F.lit(" "))), "category": F.lit("social-history"),
        "value_text": F.trim(f"{x}.description"), "interpretation": _no_text(), "effective": F.col("clinical_date"), **_evidence(x),
    }, resource_type="Observation")


def exam_and_social(docs: DataFrame) -> DataFrame:
    """Observations from exam findings and social history."""
    return _projected(items(docs, "physical_exam_findings"), _exam()).unionByName(_projected(items(docs, "social_history"), _social()))


def _medication(x: str = "x") -> Kind:
    return Kind("MedicationStatement", "medications", filled(f"{x}.name"), {
        "name": F.trim(f"{x}.name"), "status": known(f"{x}.status", MEDICATION_STATUS, "active"),
        "dosage": F.trim(f"{x}.dosage"), "frequency": F.trim(f"{x}.frequency"), "route": F.trim(f"{x}.route"),
        "effective": F.col("__day"), "ended": day(f"{x}.stop_date"), **_evidence(x),
    }, F.col(f"{x}.start_date"))


def medications(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "medications"), _medication())


def medications_from_text(docs: DataFrame, column: str = "medication_text") -> DataFrame:
    """Medication statements from a free-text list."""
    rows = docs.select("doc_id", "patient_id", F.posexplode(S.split_medications(F.col(column))).alias("ord", "item"))
    return rows.select(*_base("MedicationStatement"), S.parse_medication(F.col("item")).alias("p")).select(
        "doc_id", "patient_id", "ord", "resource_id", "resource_type", "p.*"
    ).withColumn("status", F.lit("active"))


def _claims() -> Column:
    names = F.transform(F.coalesce("immunizations", F.array()), lambda i: F.lower(F.trim(i["vaccine_name"])))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def _names_meet(a: Column, b: Column) -> Column:
    def inside(text, word):
        return F.regexp_like(text, F.concat(F.lit(r"\b\Q"), word, F.lit(r"\Es?\b")))

    return inside(a, b) | inside(b, a)


def _taken() -> Column:
    """Places of the procedures that are vaccine-like and claimed by no earlier entry."""
    # fold over the procedures of one document: a name taken once claims its later matches
    candidates = F.filter(
        F.transform(F.coalesce("procedures", F.array()), lambda p, i: F.struct(i.alias("i"), F.lower(F.trim(p["name"])).alias("n"))),
        lambda p: S.is_vaccine(p["n"]),
    )
    start = F.struct(_claims().alias("seen"), F.array().cast("array<int>").alias("taken"))

    def claim(state, p):
        met = F.exists(state["seen"], lambda s: _names_meet(p["n"], s))
        return F.when(met, state).otherwise(F.struct(F.array_append(state["seen"], p["n"]).alias("seen"), F.array_append(state["taken"], p["i"]).alias("taken")))

    return F.aggregate(candidates, start, claim)["taken"]


def _stated_immunization(x: str = "x") -> Kind:
    forecast = F.coalesce(f"{x}.is_forecast", F.lit(False))
    status = F.lower(F.trim(f"{x}.status"))
    return Kind("Immunization", "immunizations", filled(f"{x}.vaccine_name"), {
        "name": F.trim(f"{x}.vaccine_name"), "code": S.cvx_code(F.col(f"{x}.vaccine_name"), F.col(f"{x}.cvx_code")),
        "status": F.when(forecast, "not-done").when(status.isin("completed", "entered-in-error", "not-done"), status).otherwise("completed"),
        "effective": F.when(~forecast, _clinical_or_day()), "lot_number": F.trim(f"{x}.lot_number"), **_evidence(x),
    }, F.col(f"{x}.date_administered"))


def _procedure_immunization(x: str = "x") -> Kind:
    return Kind("ProcedureImmunization", "procedures", F.array_contains("__taken", F.col("ord").cast("int")), {
        "name": F.trim(f"{x}.name"), "code": S.cvx_code(F.col(f"{x}.name"), _no_text()), "status": F.lit("completed"),
        "effective": _clinical_or_day(), "lot_number": _no_text(), **_evidence(x),
    }, F.col(f"{x}.procedure_date"), "Immunization")


def immunizations(docs: DataFrame) -> DataFrame:
    """Explicit vaccinations plus vaccine-like procedures no earlier entry has claimed."""
    chosen = taken_out(docs, "immunizations", "procedures").withColumn("__taken", _taken())
    rows = chosen.select("doc_id", "patient_id", "clinical_date", "run_date", "__taken", F.posexplode("procedures").alias("ord", "x"))
    return _projected(items(docs, "immunizations"), _stated_immunization()).unionByName(_projected(rows, _procedure_immunization()))


def _procedure(x: str = "x") -> Kind:
    return Kind("Procedure", "procedures", filled(f"{x}.name") & ~S.is_vaccine(F.col(f"{x}.name"), F.col("claims")), {
        "name": F.trim(f"{x}.name"), "code": F.trim(f"{x}.cpt_code"), "status": F.lit("completed"),
        "effective": _clinical_or_day(), "performer": F.trim(f"{x}.provider"), "outcome": F.trim(f"{x}.outcome"), **_evidence(x),
    }, F.col(f"{x}.procedure_date"))


def procedures(docs: DataFrame) -> DataFrame:
    """Procedures without the vaccine-like ones."""
    lists = taken_out(docs, "immunizations", "procedures")
    return _projected(lists.select("doc_id", "patient_id", "clinical_date", "run_date", _claims().alias("claims"), F.posexplode("procedures").alias("ord", "x")), _procedure())


def _encounter(x: str = "x", strict_reference: bool = False) -> Kind:
    cls = contained(F.col(f"{x}.encounter_type"), ENCOUNTER_CLASSES, "AMB", whole_words=not strict_reference)
    people = F.filter(F.transform(F.coalesce(f"{x}.participants", F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != "")
    return Kind("Encounter", "encounters", filled(f"{x}.encounter_type"), {
        "name": F.trim(f"{x}.encounter_type"), "code": cls, "status": known(f"{x}.status", ENCOUNTER_STATUS, "finished"),
        "effective": F.col("__day"), "ended": day(f"{x}.encounter_end_date"), "location": F.trim(f"{x}.location"), "reason": F.trim(f"{x}.reason"),
        "participants": F.array_join(people, ", "), **_evidence(x),
    }, F.col(f"{x}.encounter_date"))


def encounters(docs: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Stated visits; ``strict_reference`` finds class keys also inside words."""
    return _projected(items(docs, "encounters"), _encounter(strict_reference=strict_reference))


def _synthesized_day() -> Column:
    """Day of the visit that a document without a stated one gets; null if it gets none."""
    some = sum((F.size(F.coalesce(f"data.{name}", F.array())) for name in CLINICAL_LISTS), F.lit(0)) > 0
    stated = F.exists(F.coalesce("data.encounters", F.array()), lambda e: F.trim(e["encounter_type"]) != "")
    return F.when(some & ~stated, S.clinical_date(F.coalesce("clinical_date", F.col("data.clinical_date")), F.col("run_date")).cast("string"))


def _synthesized(x: str = "x") -> Kind:
    """The visit of documents with a day in ``__made``."""
    return Kind("SynthesizedEncounter", "encounters", F.lit(True), {
        "name": F.lit("Ambulatory"), "status": F.lit("finished"), "effective": F.col("__made"), "confidence": F.lit(0.6),
    }, resource_type="Encounter", entries=lambda made: F.when(F.col("__made").isNotNull(), F.array(made(F.lit(0)))))


def synthesized_encounters(docs: DataFrame) -> DataFrame:
    """One ambulatory visit for a dated document with clinical rows and no stated visit."""
    return docs.withColumns({"effective": _synthesized_day(), "ord": F.lit(0)}).filter("effective IS NOT NULL").select(
        *_base("SynthesizedEncounter"), F.lit("Ambulatory").alias("name"), F.lit("AMB").alias("code"), F.lit("finished").alias("status"), "effective",
        F.lit(0.6).alias("confidence"),
    ).withColumn("resource_type", F.lit("Encounter"))


def _practitioner(x: str = "x") -> Kind:
    name = S.parse_provider_name(F.col(f"{x}.name"))
    return Kind("Practitioner", "providers", filled(f"{x}.name"), {
        "name": F.trim(f"{x}.name"), "family": name["family"], "given": name["given"], "specialty": F.trim(f"{x}.specialty"), **_evidence(x),
    })


def practitioners(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "providers"), _practitioner())


def _organization(x: str = "x") -> Kind:
    return Kind("Organization", "organizations", filled(f"{x}.name"), {
        "name": F.trim(f"{x}.name"), "code": contained(F.coalesce(f"{x}.organization_type", F.lit("")), ORGANIZATION_TYPES, "prov"),
        "address": F.concat_ws(", ", f"{x}.address", f"{x}.city", f"{x}.state", f"{x}.postal_code"), **_evidence(x),
    })


def organizations(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "organizations"), _organization())


def _allergy(x: str = "x") -> Kind:
    return Kind("AllergyIntolerance", "allergies", filled(f"{x}.allergen"), {
        "name": F.trim(f"{x}.allergen"), "severity": S.lookup(F.lower(f"{x}.severity"), ALLERGY_SEVERITY, "mild"),
        "status": known(f"{x}.status", ["active", "inactive", "resolved"], "active"),
        "verification": known(f"{x}.verification_status", ["confirmed", "unconfirmed", "refuted"], "unconfirmed"),
        "reaction": F.trim(f"{x}.reaction"), "effective": F.col("__day"), **_evidence(x),
    }, F.col(f"{x}.onset_date"))


def allergies(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "allergies"), _allergy())


def _care_plan(x: str = "x") -> Kind:
    def joined(column):
        return F.array_join(F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != ""), "; ")

    return Kind("CarePlan", "care_plans", filled(f"{x}.plan_description"), {
        "name": F.trim(f"{x}.plan_description"), "status": known(f"{x}.status", PLAN_STATUS, "active"), "intent": known(f"{x}.intent", PLAN_INTENT, "plan"),
        "goals": joined(f"{x}.goals"), "activities": joined(f"{x}.activities"), "effective": F.col("__day"), "ended": day(f"{x}.period_end"), **_evidence(x),
    }, F.col(f"{x}.period_start"))


def care_plans(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "care_plans"), _care_plan())


def _stated_request(x: str = "x") -> Kind:
    return Kind("ServiceRequest", "service_requests", filled(f"{x}.request_type"), {
        "name": F.trim(f"{x}.request_type"), "priority": F.coalesce(F.lower(f"{x}.priority"), F.lit("routine")), "reason": F.trim(f"{x}.reason"),
        "category": S.service_category(F.col(f"{x}.request_type")), "effective": F.col("__day"), **_evidence(x),
    }, F.col(f"{x}.request_date"))


def _planned(recommendations: Column) -> Column:
    """Requests named in the recommendations of a report; null for an empty text."""
    from chartmill.operators.extract import PLAN_VERBS

    found = F.flatten(F.array(*[F.regexp_extract_all(recommendations, F.lit("(?i)" + p), F.lit(1)) for p in PLAN_VERBS]))
    return F.when(filled(recommendations), F.transform(found, lambda s: F.trim(s)))


def _place_of_planned(parent: Column, sub: Column) -> Column:
    return F.shiftleft(parent.cast("bigint"), 32) + sub


def _planned_request(x: str = "x") -> Kind:
    return Kind("PlannedRequest", "diagnostic_reports", F.lit(True), {
        "name": F.col(f"{x}.name"), "priority": F.lit("routine"), "reason": F.lit("As per treatment plan"), "category": S.service_category(F.col(f"{x}.name")),
        "effective": _no_text(), "confidence": F.lit(None).cast("double"), "source_text": _no_text(),
    }, resource_type="ServiceRequest", entries=_entries_of_plans)


def _entries_of_plans(made: Callable) -> Column:
    def of_report(report: Column, parent: Column) -> Column:
        names = _planned(report["recommendations"])
        return F.coalesce(F.transform(names, lambda name, sub: made(_place_of_planned(parent, sub), "x_planned", F.struct(name.alias("name")))), F.array())

    return F.flatten(F.transform(F.coalesce("diagnostic_reports", F.array()), of_report))


def service_requests(docs: DataFrame) -> DataFrame:
    """Stated requests plus the ones named in report recommendations."""
    plans = items(docs, "diagnostic_reports").select("doc_id", "patient_id", F.col("ord").alias("parent"), F.posexplode(_planned(F.col("x.recommendations"))).alias("sub", "name"))
    planned = plans.select("doc_id", "patient_id", _place_of_planned(F.col("parent"), F.col("sub")).alias("ord"), F.struct("name").alias("x"))
    return _projected(items(docs, "service_requests"), _stated_request()).unionByName(_projected(planned, _planned_request()))


def _stated_report(x: str = "x") -> Kind:
    return Kind("DiagnosticReport", "diagnostic_reports", filled(f"{x}.report_type"), {
        "name": F.trim(f"{x}.report_type"), "category": S.report_category(F.col(f"{x}.report_type")), "status": F.coalesce(F.lower(f"{x}.status"), F.lit("final")),
        "conclusion": F.concat_ws("; ", F.when(filled(f"{x}.findings"), F.trim(f"{x}.findings")), F.when(filled(f"{x}.conclusion"), F.trim(f"{x}.conclusion"))), "effective": F.col("__day"), **_evidence(x),
    }, F.col(f"{x}.report_date"))


def _procedure_report(x: str = "x") -> Kind:
    return Kind("ProcedureReport", "procedures", filled(f"{x}.name") & S.is_diagnostic(F.col(f"{x}.name")), {
        "name": F.trim(f"{x}.name"), "category": S.report_category(F.col(f"{x}.name")), "status": F.lit("final"),
        "conclusion": F.coalesce(F.trim(f"{x}.outcome"), F.lit("")), "effective": F.col("__day"), **_evidence(x),
    }, F.col(f"{x}.procedure_date"), "DiagnosticReport")


def diagnostic_reports(docs: DataFrame) -> DataFrame:
    """Stated reports plus diagnostic procedures."""
    return _projected(items(docs, "diagnostic_reports"), _stated_report()).unionByName(_projected(items(docs, "procedures"), _procedure_report()))


def _relative(x: str = "x") -> Kind:
    return Kind("FamilyMemberHistory", "family_history", filled(f"{x}.relationship") & filled(f"{x}.condition"), {
        "relationship": F.trim(f"{x}.relationship"), "name": F.trim(f"{x}.condition"), "onset": F.when(filled(f"{x}.onset_age"), F.trim(f"{x}.onset_age")),
        "deceased": F.col(f"{x}.deceased"), "status": F.lit("completed"), **_evidence(x),
    })


def family_history(docs: DataFrame) -> DataFrame:
    return _projected(items(docs, "family_history"), _relative())


def one_pass(docs: DataFrame, kinds: Sequence[Kind], **beside: Column) -> DataFrame:
    """Entries that the kinds are made of, all from one pass over the documents, with the number of their kind.

    A document's entries stay beside each other, and nothing moves or is
    written. ``beside`` are columns of the document that stay with its entries.
    An entry stands in the column of its list, ``x_`` before its name, as
    ``all_kinds`` reads it; the columns of the other lists are null.
    """
    sources = sorted({kind.source for kind in kinds} | {"immunizations", "procedures"})
    types = {f"x_{name}": LISTS[name] for name in sources} | {"x_planned": "struct<name:string>"}

    def entries(n: int, kind: Kind) -> Column:
        def made(place: Column, name: str | None = None, x: Column | None = None) -> Column:
            return F.struct(F.lit(n).alias("kind"), place.cast("bigint").alias("ord"), *[(x if c == name else F.lit(None)).cast(type_).alias(c) for c, type_ in types.items()])

        if kind.entries is not None:
            return F.coalesce(kind.entries(made), F.array())
        return F.transform(F.coalesce(kind.source, F.array()), lambda x, i: made(i, f"x_{kind.source}", x))

    lists = docs.select("doc_id", "patient_id", "clinical_date", "run_date", *[F.col(f"data.{name}").alias(name) for name in sources], *[c.alias(n) for n, c in beside.items()])
    rows = lists.select(
        "doc_id", "patient_id", "clinical_date", "run_date", *beside, _claims().alias("claims"), _taken().alias("__taken"),
        F.inline(F.concat(*[entries(n, kind) for n, kind in enumerate(kinds)])),
    )
    dated = rows.withColumn("__day", S.clinical_date(of_kind(kinds, lambda k: _no_text() if k.date is None else k.date), F.col("run_date")).cast("string"))
    return dated.filter(of_kind(kinds, lambda k: k.keep))


def entries_of(kinds: Sequence[Kind]) -> Column:
    """How many entries a document gives to ``one_pass``, without making them."""
    def count(kind: Kind) -> Column:
        if kind.origin == "PlannedRequest":
            texts = F.transform(F.coalesce("data.diagnostic_reports", F.array()), lambda x: F.coalesce(F.size(_planned(x["recommendations"])), F.lit(0)))
            return F.aggregate(texts, F.lit(0), lambda total, n: total + F.greatest(n, F.lit(0)))
        return F.size(F.coalesce(f"data.{kind.source}", F.array()))

    return sum((count(kind) for kind in kinds), F.lit(0)).cast("bigint")


def of_kind(kinds: Sequence[Kind], value: Callable[[Kind], Column]) -> Column:
    """Value of an entry of ``one_pass`` by its kind."""
    out = F
    for n, kind in enumerate(kinds):
        out = out.when(F.col("kind") == n, value(kind))
    return out


# fixed values: status of resources whose entries have none
PLAIN_STATUS = {
    "ExamObservation": "final", "SocialObservation": "final", "ServiceRequest": "active", "PlannedRequest": "active", "Practitioner": "active", "Organization": "active",
}


def status_of(kind: Kind) -> Column:
    return F.lit(PLAIN_STATUS[kind.origin]) if kind.origin in PLAIN_STATUS else kind.columns["status"]


def effective_of(kind: Kind) -> Column:
    return kind.columns.get("effective", _no_text())


def all_kinds() -> list[Kind]:
    """Every kind, reading the entries of ``one_pass``."""
    made = {
        "encounters": [_encounter, _synthesized], "medications": [_medication], "vital_signs": [_vital], "lab_results": [_lab], "physical_exam_findings": [_exam], "social_history": [_social],
        "conditions": [_condition], "immunizations": [_stated_immunization], "procedures": [_procedure_immunization, _procedure, _procedure_report], "diagnostic_reports": [_stated_report],
        "service_requests": [_stated_request], "planned": [_planned_request], "allergies": [_allergy], "care_plans": [_care_plan], "family_history": [_relative], "providers": [_practitioner],
        "organizations": [_organization],
    }
    return [kind(f"x_{source}") for source, kinds in made.items() for kind in kinds]


def resource_rows(docs: DataFrame) -> DataFrame:
    """All resources of the documents in one table, vaccines claimed, visits linked.

    All come from one pass over the documents, which holds a document's visits
    as an array: every row decides by itself, and none moves or is written.
    """
    kinds = all_kinds()
    docs = docs.withColumn("__made", _synthesized_day())
    rows = one_pass(docs, kinds, __made=F.col("__made"), __visits=_visits()).select(
        "doc_id", "patient_id", of_kind(kinds, lambda k: F.lit(k.resource_type or k.origin)).alias("resource_type"), _hashed(of_kind(kinds, lambda k: F.lit(k.origin))).alias("resource_id"),
        of_kind(kinds, lambda k: k.columns["name"]).alias("name"), of_kind(kinds, status_of).alias("status"), of_kind(kinds, effective_of).alias("effective"),
        of_kind(kinds, lambda k: k.columns["confidence"]).alias("confidence"), "__visits",
    )
    return _linked(rows).select("doc_id", "patient_id", "resource_type", "resource_id", "name", "status", "effective", "confidence", "encounter_id")


def _visits() -> Column:
    """Visits of a document with a synthesized one's day in ``__made``, as ``link_within_documents`` orders them."""
    def visit(kind: str, place: Column, effective: Column) -> Column:
        id_ = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(kind), place.cast("string")), 256)
        return F.struct(id_.alias("id"), _agreeing(effective).alias("day"))

    def stated(x: Column, i: Column) -> Column:
        return F.when(filled(x["encounter_type"]), visit("Encounter", i, S.clinical_date(x["encounter_date"], F.col("run_date")).cast("string")))

    made = F.when(F.col("__made").isNotNull(), F.array(visit("SynthesizedEncounter", F.lit(0), F.col("__made"))))
    return F.array_sort(F.array_compact(F.concat(F.transform(F.coalesce("data.encounters", F.array()), stated), F.coalesce(made, F.array()))))


def link_within_documents(rows: DataFrame, encounters: DataFrame) -> DataFrame:
    """Add ``encounter_id``: the document's first encounter whose date agrees at the shared precision, for an undated row its only one.

    ``encounters(doc_id, resource_id, effective)``. A document's encounters
    come from one of its lists, so they travel as an array and every row
    decides by itself; the rows move once, by document.
    """
    visit = F.struct(F.col("resource_id").alias("id"), _agreeing(F.col("effective")).alias("day"))
    visits = encounters.groupBy("doc_id").agg(F.array_sort(F.collect_list(visit)).alias("__visits"))
    return _linked(rows.join(visits, "doc_id", "left"))


def _agreeing(effective: Column) -> Column:
    """Text of a date's parts, null without any: dates agree at the shared precision if one text starts with the other."""
    parts = S.date_parts(effective)
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "-"), F.lit("-")))


def _linked(rows: DataFrame) -> DataFrame:
    """Rows that hold the visits of their document in ``__visits``, with the one they belong to in its place."""
    out = rows.withColumn("__own", _agreeing(F.col("effective")))

    def agrees(v: Column) -> Column:
        return F.startswith(v["day"], F.col("__own")) | F.startswith(F.col("__own"), v["day"])

    linkable = F.col("resource_type").isin(LINKED_TYPES) & ~((F.col("resource_type") == "Immunization") & (F.col("status") == "not-done"))
    dated = F.get(F.filter("__visits", agrees), F.lit(0))["id"]
    alone = F.when(F.size("__visits") == 1, F.get("__visits", F.lit(0))["id"])
    link = F.when(linkable, F.when(F.col("effective").isNull(), alone).otherwise(dated))
    return out.withColumn("encounter_id", link).drop("__visits", "__own")


def document_type(has: dict[str, Column]) -> Column:
    """Type of a flat document from the keys it carries (missing keys are absent)."""
    def any_key(*names):
        out = F.lit(False)
        for n in names:
            out = out | has.get(n, F.lit(False))
        return out

    def key(name):
        return has.get(name, F.lit(False))

    return (
        F.when(any_key("tests", "lab_results", "test_date", "collection_date"), "lab_report")
        .when(any_key("chief_complaint", "assessment", "plan", "note_date"), "clinical_note")
        .when(any_key("medications", "medication_list", "prescriptions"), "medication_list")
        .when((key("admission_date") & key("discharge_date")) | any_key("discharge_summary", "discharge_diagnosis"), "discharge_summary")
        .otherwise("generic")
    )


def flat_document_rows(docs: DataFrame) -> DataFrame:
    """Resources of flat documents by type.

    ``docs(doc_id, document_type, tests, diagnoses, medications, provider)`` with array columns.
    A laboratory report gives observations, a note conditions, a list medications,
    a discharge summary conditions and medications; each names its practitioner.
    """
    kind = F.col("document_type")

    def part(when, column, resource_type):
        return docs.filter(when).select("doc_id", F.lit(resource_type).alias("resource_type"), F.explode(column).alias("name"))

    rows = part(kind == "lab_report", "tests", "Observation")
    rows = rows.unionByName(part(kind.isin("clinical_note", "discharge_summary"), "diagnoses", "Condition"))
    rows = rows.unionByName(part(kind.isin("medication_list", "discharge_summary"), "medications", "MedicationStatement"))
    people = docs.filter(filled("provider")).select("doc_id", F.lit("Practitioner").alias("resource_type"), F.trim("provider").alias("name"))
    return rows.filter(filled("name")).unionByName(people)


def patient_rows(patients: DataFrame) -> DataFrame:
    """Patient resources from demographics."""
    gender = F.lower(F.trim("gender"))
    return patients.select(
        F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")).alias("reference"), F.trim("mrn").alias("mrn"), F.trim("last_name").alias("family"),
        F.trim("first_name").alias("given"), F.col("birth_date").cast("string").alias("birth_date"),
        F.when(gender.isin("male", "m"), "male").when(gender.isin("female", "f"), "female").when(gender == "other", "other").otherwise("unknown").alias("gender"), "phone",
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """Document references from document metadata."""
    return docs.select(
        "doc_id", F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")).alias("subject"), F.lit("current").alias("status"),
        F.col("filename").alias("title"), F.col("uploaded_at").alias("date"), F.concat(F.lit("Document/"), F.col("doc_id").cast("string")).alias("url"),
    )


def derived_clinical_date(docs: DataFrame) -> DataFrame:
    """One clinical date per document with its source: stated, earliest visit, earliest dated item."""
    data = F.col("data")

    def earliest(name, field):
        return F.array_min(F.transform(F.coalesce(data[name], F.array()), lambda x: S.pad_partial_date(x[field])))

    stated = S.pad_partial_date(data["clinical_date"])
    visit = earliest("encounters", "encounter_date")
    item = F.array_min(F.array(earliest("lab_results", "test_date"), earliest("procedures", "procedure_date"), earliest("vital_signs", "timestamp")))
    return docs.select(
        "doc_id", F.coalesce(stated, visit, item).alias("clinical_date"),
        F.when(stated.isNotNull(), "ai_clinical_date").when(visit.isNotNull(), "encounter").when(item.isNotNull(), "clinical_item").alias("date_source"),
    )


def search_index(rows: DataFrame) -> DataFrame:
    """Codes, dates and provider references per patient, free of names.

    ``rows(patient_id, resource_type, resource_id, code, display, effective, provider)``.
    Long form ``(patient_id, kind, code, display)``, distinct.
    """
    entries = F.array_compact(F.array(
        F.when(filled("code"), F.struct(F.lower(F.col("resource_type")).alias("kind"), F.col("code").alias("code"), F.col("display").alias("display"))),
        F.when(F.col("effective").isNotNull(), F.struct(F.lit("date").alias("kind"), F.substring("effective", 1, 10).alias("code"), F.lit(None).cast("string").alias("display"))),
        F.when(F.col("provider").isNotNull(), F.struct(F.lit("provider").alias("kind"), F.col("provider").alias("code"), F.lit(None).cast("string").alias("display"))),
    ))
    return rows.select("patient_id", F.inline(entries)).distinct()
