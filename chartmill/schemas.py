"""Schemas of nested inputs. They are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(strings: str, extra: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings.split()]
    fields += [T.StructField(n, t) for n, t in (extra or {}).items()]
    fields += [T.StructField("confidence", T.DoubleType()), T.StructField("source", SOURCE)]
    return T.StructType(fields)


SOURCE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("start_index", T.IntegerType()), T.StructField("end_index", T.IntegerType()),
])
COMPONENT = T.StructType([T.StructField(n, T.StringType()) for n in ("measurement", "value", "unit")])
STRINGS = T.ArrayType(T.StringType())

LISTS: dict[str, T.StructType] = {
    "conditions": _struct("name status evidence_type onset_date date_precision icd_code snomed_code"),
    "medications": _struct("name generic_name brand_name dosage dosage_form quantity route frequency sig refills prescriber status start_date stop_date date_precision"),
    "vital_signs": _struct("measurement value unit category timestamp date_precision", {"components": T.ArrayType(COMPONENT)}),
    "lab_results": _struct("test_name value unit reference_range abnormal_flag category panel_name status test_date date_precision"),
    "procedures": _struct("name cpt_code procedure_date provider outcome date_precision"),
    "immunizations": _struct("vaccine_name cvx_code date_administered date_precision lot_number manufacturer dose_number route site status", {"is_forecast": T.BooleanType()}),
    "providers": _struct("name specialty role contact_info"),
    "encounters": _struct("encounter_id encounter_type encounter_date encounter_end_date location reason status", {"participants": STRINGS}),
    "service_requests": _struct("request_id request_type requester reason priority clinical_context request_date forecast_due_date"),
    "diagnostic_reports": _struct("report_id report_type findings conclusion recommendations status report_date ordering_provider"),
    "allergies": _struct("allergy_id allergen reaction severity onset_date status verification_status"),
    "care_plans": _struct("plan_id plan_description period_start period_end status intent", {"goals": STRINGS, "activities": STRINGS}),
    "organizations": _struct("organization_id name role_in_document identifier organization_type address city state postal_code phone"),
    "family_history": _struct("relationship condition onset_age", {"deceased": T.BooleanType()}),
    "physical_exam_findings": _struct("body_site finding status"),
    "social_history": _struct("category description"),
}

RESPONSE = T.StructType(
    [T.StructField(name, T.ArrayType(struct)) for name, struct in LISTS.items()]
    + [T.StructField(n, T.StringType()) for n in ("clinical_date", "clinical_date_source", "extraction_timestamp", "document_type")]
    + [T.StructField("confidence_average", T.DoubleType())]
)

EXTRACTION = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("llm_type", T.StringType()), T.StructField("success", T.BooleanType()), T.StructField("response_data", RESPONSE),
])

PAGE_TEXT = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("text_length", T.LongType()), T.StructField("text_content", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("page_count", T.IntegerType()), T.StructField("file_size_mb", T.DoubleType()),
        T.StructField("pdf_metadata", T.MapType(T.StringType(), T.StringType())),
    ])),
])

PIPELINE_ERROR = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("timestamp", T.StringType()), T.StructField("stage", T.StringType()),
    T.StructField("error_message", T.StringType()), T.StructField("error_data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])
