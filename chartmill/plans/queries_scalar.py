"""Queries for scalar normalisation and small parsers."""

from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.plans.catalog import query
from chartmill.plans.sqltext import (
    PRICED, case_contains, case_map, date_tries, half, words,
)

KEY = "doc_id, chunk, ord, code_id"
KEYS = ["doc_id", "chunk", "ord", "code_id"]


def _date_source(t):
    return t.fields.filter("label IN ('Date of Birth', 'Admission date', 'Lab_glucose')")


@query(
    "normalize_date",
    f"""SELECT {KEY}, value, {date_tries('value')} AS iso FROM fields
        WHERE label IN ('Date of Birth', 'Admission date', 'Lab_glucose')""",
)
def _(t):
    return _date_source(t).select(*KEYS, "value", S.normalize_date(F.col("value")).alias("iso"))


@query(
    "normalize_date_formats",
    """WITH texts AS (SELECT encounter_id, CASE encounter_id % 6 WHEN 0 THEN strftime(visit_date, '%m/%d/%Y') WHEN 1 THEN strftime(visit_date, '%d-%m-%Y')
           WHEN 2 THEN strftime(visit_date, '%B %d, %Y') WHEN 3 THEN strftime(visit_date, '%b %d, %Y')
           WHEN 4 THEN strftime(visit_date, '%m/%d/%y') ELSE strftime(visit_date, '%Y/%m/%d') END AS raw FROM encounters)
        SELECT encounter_id, raw, """ + date_tries("raw") + " AS iso FROM texts",
)
def _(t):
    d = F.col("visit_date")
    shapes = ["MM/dd/yyyy", "dd-MM-yyyy", "MMMM dd, yyyy", "MMM dd, yyyy", "MM/dd/yy", "yyyy/MM/dd"]
    raw = F
    for i, shape in enumerate(shapes):
        raw = raw.when(F.col("encounter_id") % 6 == i, F.date_format(d, shape))
    df = t.encounters.select("encounter_id", raw.alias("raw"))
    return df.withColumn("iso", S.normalize_date(F.col("raw")))


@query(
    "pad_partial_date",
    """SELECT encounter_id, date_text, CASE length(date_text) WHEN 4 THEN date_text || '-01-01'
              WHEN 7 THEN date_text || '-01' ELSE date_text END AS padded FROM encounters""",
)
def _(t):
    return t.encounters.select("encounter_id", "date_text", S.pad_partial_date(F.col("date_text")).alias("padded"))


@query(
    "dates_agree_at_shared_precision",
    """SELECT encounter_id, coalesce(starts_with(CAST(visit_date AS STRING), date_text), false) AS agree FROM encounters""",
)
def _(t):
    return t.encounters.select(
        "encounter_id", S.dates_agree(F.col("date_text"), F.col("visit_date").cast("string")).alias("agree")
    )


@query(
    "parse_clinical_timestamp",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts)
              ELSE date_trunc('month', ts) END AS parsed FROM events""",
)
def _(t):
    k, ts = F.col("event_id") % 3, F.col("ts")
    raw = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM"))
    )
    return t.events.select("event_id", S.parse_timestamp(raw).alias("parsed"))


_TITLE = r"array_to_string(list_transform(regexp_extract_all({}, '\p{{L}}+|\P{{L}}+'), lambda t: upper(t[1]) || t[2:]), '')"


@query(
    "normalize_person_name",
    f"""WITH titled AS (SELECT {KEY}, {_TITLE.format("regexp_replace(trim(lower(value)), '\\s+', ' ', 'g')")} AS v
                        FROM fields WHERE contains(lower(label), 'name') OR contains(lower(label), 'diagnosis')),
        parts AS (SELECT {KEY}, list_transform(string_split(v, ' '), lambda p: CASE
              WHEN lower(p) IN ('dr', 'mr', 'mrs', 'ms') THEN p || '.'
              WHEN lower(p) IN ('jr', 'sr') THEN upper(p) || '.'
              WHEN lower(p) IN ('jr.', 'sr.', 'ii', 'iii', 'iv') THEN upper(p) ELSE p END) AS ps FROM titled)
        SELECT {KEY}, array_to_string(ps, ' ') AS name FROM parts""",
)
def _(t):
    low = F.lower("label")
    return t.fields.filter(low.contains("name") | low.contains("diagnosis")).select(
        *KEYS, S.normalize_name(F.col("value")).alias("name")
    )


@query(
    "comparison_forms",
    r"""SELECT patient_id,
          trim(regexp_replace(regexp_replace(lower(first_name || ' ' || last_name || ' Jr.'), '\b(mr|mrs|ms|dr|md|jr|sr|ii|iii)\b\.?', '', 'g'), '\s+', ' ', 'g')) AS name_form,
          right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_form,
          strftime(birth_date, '%m%d%Y') AS date_form, lower(living_setting) AS other_form FROM patients""",
)
def _(t):
    full = F.concat_ws(" ", "first_name", "last_name", F.lit("Jr."))
    return t.patients.select(
        "patient_id",
        S.comparison_form(full, F.lit("Patient Name")).alias("name_form"),
        S.comparison_form(F.col("phone"), F.lit("phone")).alias("phone_form"),
        S.comparison_form(F.date_format("birth_date", "MM/dd/yyyy"), F.lit("birth_date")).alias("date_form"),
        S.comparison_form(F.col("living_setting"), F.lit("setting")).alias("other_form"),
    )


@query(
    "medical_code_by_shape",
    r"""WITH c AS (SELECT code_id, regexp_replace(upper(trim(raw_code)), '[^\w.\-]', '', 'g') AS code FROM codes)
        SELECT code_id, code, CASE WHEN regexp_matches(code, '^\d{1,5}-\d$') THEN 'LOINC'
            WHEN regexp_matches(code, '^[A-Z]\d{2}(\.\d{1,2})?$') THEN 'ICD-10'
            WHEN regexp_matches(code, '^\d{6,}$') THEN 'SNOMED' ELSE 'UNKNOWN' END AS system FROM c""",
)
def _(t):
    df = t.codes.select("code_id", S.medical_code(F.col("raw_code")).alias("code"))
    return df.withColumn("system", S.code_system_by_shape(F.col("code")))


def _detect_sql(code: str, ctx: str) -> str:
    out = []
    for rank, (name, (_, pattern)) in enumerate(fixed.CODE_SYSTEMS.items()):
        boost = " OR ".join(f"contains(lower({ctx}), '{w}')" for w in fixed.CODE_CONTEXT_WORDS[name])
        special = {"LOINC": f"contains({code}, '-')", "ICD-10-CM": f"contains({code}, '.')", "SNOMED": f"length({code}) >= 8"}.get(name, "false")
        out.append(
            f"SELECT code_id, '{name}' AS system, {rank} AS rank, least(100, 80 + CASE WHEN {boost} THEN 15 ELSE 0 END "
            f"+ CASE WHEN {special} THEN 10 ELSE 0 END) AS score FROM c WHERE regexp_matches({code}, '{pattern}')"
        )
    return " UNION ALL ".join(out)


@query(
    "detect_code_system",
    rf"""WITH c AS (SELECT code_id, regexp_replace(raw_code, '[^\w.\-]', '', 'g') AS code, context FROM codes),
         m AS ({_detect_sql('code', 'context')}),
         best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY code_id ORDER BY score DESC, rank) = 1)
         SELECT c.code_id, coalesce(system, 'UNKNOWN') AS system, coalesce(score, 0) / 100.0::DOUBLE AS confidence
         FROM c LEFT JOIN best USING (code_id)""",
)
def _(t):
    d = S.detect_code_system(F.col("raw_code"), F.col("context"))
    return t.codes.select("code_id", d.alias("d")).select("code_id", "d.system", "d.confidence")


_URI = case_map("stated_system", {n: u for n, (u, _) in fixed.CODE_SYSTEMS.items()}, "'http://unknown.org'")
_VALID = "CASE " + " ".join(
    f"WHEN stated_system = '{n}' THEN regexp_matches(trim(raw_code), '{p}')" for n, (_, p) in fixed.CODE_SYSTEMS.items()
) + " ELSE false END"


@query("validate_code_format", f"SELECT code_id, {_VALID} AS valid, {_URI} AS uri FROM codes")
def _(t):
    return t.codes.select(
        "code_id", S.code_format_valid(F.trim("raw_code"), F.col("stated_system")).alias("valid"),
        S.code_system_uri(F.col("stated_system")).alias("uri"),
    )


@query(
    "normalize_stated_code",
    rf"""WITH c AS (SELECT code_id, stated_system, CASE WHEN regexp_matches(trim(raw_code), '^[A-Za-z]\d\d') THEN upper(trim(raw_code)) ELSE trim(raw_code) END AS raw_code FROM codes)
         SELECT code_id, raw_code AS code, CASE WHEN stated_system = 'OTHER' THEN 'UNKNOWN' ELSE stated_system END AS system,
           {_URI} AS uri, CASE WHEN stated_system = 'OTHER' THEN 0.0 WHEN {_VALID} THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM c""",
)
def _(t):
    return S.normalize_codes(t.codes, "raw_code", "stated_system", "context").select(
        "code_id", "code", "system", "uri", "confidence"
    )


@query(
    "parse_number",
    rf"""SELECT {KEY}, CASE WHEN regexp_matches(value, '[a-zA-Z]') THEN NULL
            ELSE TRY_CAST(regexp_replace(value, '[^\d.\-]', '', 'g') AS DOUBLE) END AS number FROM fields""",
)
def _(t):
    return t.fields.select(*KEYS, S.parse_number(F.col("value")).alias("number"))


@query(
    "normalize_drug_name",
    r"""SELECT med_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(sentence),
          '\b(tablet|capsule|inhaler|injection|solution|cream|ointment|gel)\b', '', 'g'),
          '\b(oral|topical|intravenous|subcutaneous|intramuscular)\b', '', 'g'),
          '\d+\s*(mg|mcg|g|ml|units?|puffs?|iu)\b', '', 'g'), '\s+', ' ', 'g')) AS name,
          array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(sentence),
          '\d+\s*(mg|ml|mcg|units?|iu|tablets?|capsules?|pills?)', '', 'g'),
          '\b(daily|twice|bid|tid|qid|prn|as needed)\b', '', 'g'), '\s+', ' ', 'g')), ' ')[1:2], ' ') AS short_name
        FROM medications""",
)
def _(t):
    s = F.col("sentence")
    return t.medications.select("med_id", S.normalize_drug(s).alias("name"), S.short_drug_name(s).alias("short_name"))


@query(
    "normalize_diagnosis",
    r"""SELECT condition_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '^\d+[.)]\s*', ''),
          '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS diagnosis FROM conditions""",
)
def _(t):
    return t.conditions.select("condition_id", S.normalize_diagnosis(F.col("name")).alias("diagnosis"))


@query(
    "normalize_field_value",
    rf"""SELECT {KEY}, CASE
           WHEN regexp_matches(lower(label), 'date|dob|birth') THEN regexp_replace(value, '^(born|dob|date of birth):\s*', '', 'i')
           WHEN regexp_matches(lower(label), 'medication|drug') THEN regexp_replace(regexp_replace(value, '\bmg\b', 'mg', 'gi'), '\bml\b', 'mL', 'gi')
           WHEN regexp_matches(lower(label), 'diagnosis|condition') THEN trim(regexp_replace(regexp_replace(regexp_replace(value, '^\d+[.)]\s*', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g'))
           ELSE trim(value) END AS normalized FROM fields""",
)
def _(t):
    return t.fields.select(*KEYS, S.normalize_field_value(F.col("value"), F.col("label")).alias("normalized"))


@query(
    "unit_conversion",
    """SELECT obs_id, CASE line_no % 4 WHEN 0 THEN value WHEN 1 THEN value * 0.453592 WHEN 2 THEN value / 1000 END AS kg,
              CASE line_no % 4 WHEN 0 THEN value / 100 WHEN 1 THEN value * 0.0254 WHEN 2 THEN value * 0.3048 END AS m
       FROM observations""",
)
def _(t):
    k, v = F.col("line_no") % 4, F.col("value")
    wu = F.when(k == 0, "KG").when(k == 1, "lbs").when(k == 2, "grams").otherwise("stone")
    hu = F.when(k == 0, "cm").when(k == 1, "Inches").when(k == 2, "ft").otherwise("ell")
    return t.observations.select(
        "obs_id", S.to_metric(v, wu, F.lit("weight")).alias("kg"), S.to_metric(v, hu, F.lit("height")).alias("m")
    )


@query(
    "bmi_and_category",
    f"""WITH b AS (SELECT obs_id, {half('(value + 40) / (1.7::DOUBLE * 1.7::DOUBLE)', 1)} AS bmi FROM observations)
        SELECT obs_id, bmi, CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 25 THEN 'normal' WHEN bmi < 30 THEN 'overweight'
           WHEN bmi < 35 THEN 'obese_class_1' WHEN bmi < 40 THEN 'obese_class_2' ELSE 'obese_class_3' END AS category,
           CASE WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi < 25 THEN 'Normal Weight' WHEN bmi < 30 THEN 'Overweight'
           WHEN bmi < 35 THEN 'Obese (Class I)' WHEN bmi < 40 THEN 'Obese (Class II)' ELSE 'Obese (Class III)' END AS display FROM b""",
)
def _(t):
    df = t.observations.select("obs_id", S.bmi(F.col("value") + 40, F.lit(1.7)).alias("bmi"))
    df = df.withColumn("category", S.bmi_category(F.col("bmi")))
    return df.withColumn("display", S.bmi_display(F.col("category")))


@query(
    "percent_change",
    f"""SELECT code_id, CASE WHEN low = 0 THEN 0.0 ELSE {half('(high - low - 1) / low * 100', 1)} END AS change FROM codes""",
)
def _(t):
    return t.codes.select("code_id", S.percent_change(F.col("low"), F.col("high") - 1).alias("change"))


_INTERP = "CASE line_no WHEN 1 THEN 'High' WHEN 2 THEN 'L' WHEN 3 THEN 'Abnormal' WHEN 4 THEN 'A' WHEN 5 THEN 'below low limit' WHEN 6 THEN 'N' ELSE flag END"


@query(
    "interpretation_flag",
    f"""WITH i AS (SELECT obs_id, lower({_INTERP}) AS x FROM observations)
        SELECT obs_id, CASE WHEN contains(x, 'high') OR x IN ('h') THEN 'H' WHEN contains(x, 'low') OR x IN ('l') THEN 'L'
            WHEN contains(x, 'normal') OR x = 'n' THEN '' WHEN x = 'a' THEN 'A' ELSE '' END AS result_flag FROM i""",
)
def _(t):
    return t.observations.select("obs_id", S.interpretation_flag(F.expr(_INTERP)).alias("result_flag"))


@query(
    "reference_range_text",
    """SELECT code_id, CASE code_id % 4 WHEN 0 THEN low || '-' || high || ' mg/dL' WHEN 1 THEN '>' || low || ' mg/dL'
          WHEN 2 THEN '<' || high || ' mg/dL' END AS range_text FROM codes""",
)
def _(t):
    k = F.col("code_id") % 4
    low = F.when(k.isin(0, 1), F.col("low"))
    high = F.when(k.isin(0, 2), F.col("high"))
    return t.codes.select("code_id", S.range_text(low, high, F.lit("mg/dL")).alias("range_text"))


ABNORMAL_SQL = """CASE WHEN flag = 'N' THEN 'normal' WHEN value < low * 0.8 THEN 'critical' WHEN value < low THEN 'low'
    WHEN value > high * 1.2 THEN 'critical' WHEN value > high THEN 'high' ELSE 'normal' END"""


@query("abnormal_result", f"SELECT obs_id, {ABNORMAL_SQL} AS result FROM results")
def _(t):
    return t.results.select(
        "obs_id", S.abnormal_result(F.col("flag"), F.col("value"), F.col("low"), F.col("high")).alias("result")
    )


@query(
    "lab_category",
    "SELECT code_id, CASE " + " ".join(
        f"WHEN loinc = '{c}' THEN '{n}'" for c, n in fixed.LOINC_CATEGORY.items()
    ) + " ELSE 'Other' END AS category FROM codes",
)
def _(t):
    return t.codes.select("code_id", S.lab_category(F.col("loinc")).alias("category"))


@query(
    "therapeutic_class",
    "SELECT med_id, " + case_contains("lower(name)", [(c, [d]) for d, c in fixed.CLASS_OF_DRUG], "'Other'")
    + " AS drug_class FROM medications",
)
def _(t):
    return t.medications.select("med_id", S.therapeutic_class(F.col("sentence")).alias("drug_class"))


@query(
    "encounter_class_kind",
    f"""SELECT encounter_id, {case_map('enc_class', fixed.TIMELINE_KIND_OF_CLASS, "'encounter'")} AS kind,
               {case_map('enc_class', fixed.CLASS_DISPLAY, "'Encounter'")} AS display FROM encounters""",
)
def _(t):
    c = F.col("enc_class")
    return t.encounters.select("encounter_id", S.timeline_kind(c).alias("kind"), S.class_display(c).alias("display"))


ENC_KIND_SQL = (
    f"coalesce({case_map('upper(enc_class)', fixed.ENCOUNTER_CODE_KIND)}, CASE "
    + " ".join(f"WHEN {words('type_text', w)} THEN '{k}'" for k, w in fixed.ENCOUNTER_KIND_WORDS)
    + " ELSE 'ambulatory' END)"
)


@query(
    "encounter_kind",
    f"""WITH k AS (SELECT encounter_id, {ENC_KIND_SQL} AS kind FROM encounters)
        SELECT encounter_id, kind, {case_map('kind', fixed.ENCOUNTER_KIND_LABELS)} AS label FROM k""",
)
def _(t):
    df = t.encounters.select("encounter_id", S.encounter_kind(F.col("enc_class"), F.col("type_text")).alias("kind"))
    return df.withColumn("label", S.lookup(F.col("kind"), fixed.ENCOUNTER_KIND_LABELS))


OBS_CAT_SQL = (
    f"CASE WHEN {words('test_name', fixed.SOCIAL_WORDS)} THEN 'social_history' WHEN {words('test_name', fixed.VITAL_WORDS)} "
    f"THEN 'vital_signs' WHEN {words('test_name', fixed.EXAM_WORDS)} THEN 'exam' ELSE 'laboratory' END"
)


@query(
    "observation_category",
    f"SELECT obs_id, CASE WHEN line_no = 1 THEN 'laboratory' WHEN line_no = 2 THEN 'exam' ELSE {OBS_CAT_SQL} END AS category FROM observations",
)
def _(t):
    code = F.expr("CASE WHEN line_no = 1 THEN 'Lab' WHEN line_no = 2 THEN 'exam' WHEN line_no = 3 THEN 'misc' END")
    return t.observations.select("obs_id", S.observation_category(code, F.col("test_name")).alias("category"))


@query(
    "field_classes",
    f"""SELECT {KEY}, {case_contains('lower(label)', fixed.FIELD_CLASSES, "'other'")} AS field_class,
          {case_contains('lower(label)', fixed.DEMOGRAPHIC_LABELS, 'lower(label)')} AS demographic,
          {case_contains('lower(label)', fixed.DATE_KINDS, "'general_date'")} AS date_kind,
          {case_contains('lower(label)', fixed.FIELD_IMPORTANCE, 10)} AS importance,
          coalesce(nullif(regexp_extract(lower(label), 'glucose|hemoglobin|cholesterol|sodium|potassium|creatinine'), ''), lower(label)) AS test_name
        FROM fields""",
)
def _(t):
    c = F.col("label")
    return t.fields.select(
        *KEYS, S.field_class(c).alias("field_class"), S.demographic_label(c).alias("demographic"),
        S.date_kind(c).alias("date_kind"), S.field_importance(c).alias("importance"),
        S.lab_test_name(c, F.lit("none")).alias("test_name"),
    )


LABEL_CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN starts_with(lower(label), '{p}') THEN '{c}'" for p, c in fixed.LABEL_PREFIX_CATEGORY
) + " ELSE 'other_fields' END"


@query(
    "field_label_category",
    f"""WITH x AS (SELECT *, {case_contains('lower(label)', fixed.DEMOGRAPHIC_LABELS, 'lower(label)')} AS d FROM fields)
        SELECT {KEY}, {LABEL_CATEGORY_SQL} AS category,
          {case_contains('lower(label)', fixed.COMPARISON_CATEGORIES, "'other'")} AS comparison_category,
          {case_map('d', {k: v[0] for k, v in fixed.FIELD_RESOURCE.items()}, "'Unknown'")} AS resource,
          {case_map('d', {k: v[1] for k, v in fixed.FIELD_RESOURCE.items()}, 'd')} AS path FROM x""",
)
def _(t):
    c, d = F.col("label"), F.col("demographic")
    return t.fields.withColumn("demographic", S.demographic_label(c)).select(
        *KEYS, S.label_category(c).alias("category"), S.comparison_category(c).alias("comparison_category"),
        S.resource_of_field(d).alias("resource"), S.resource_path_of_field(d).alias("path"),
    )


@query(
    "service_and_report_category",
    f"""SELECT code_id, {case_contains('lower(x)', [(v[1], w) for v, w in fixed.SERVICE_CATEGORIES], "'Clinical specialty'")} AS service,
          {case_contains('lower(x)', [(v[0], w) for v, w in fixed.REPORT_CATEGORIES], "'OTH'")} AS report,
          {' OR '.join(f"contains(lower(x), '{w}')" for w in fixed.DIAGNOSTIC_WORDS)} AS diagnostic
        FROM (SELECT code_id, context || ' ' || test_name AS x FROM codes)""",
)
def _(t):
    x = F.concat_ws(" ", "context", "test_name")
    return t.codes.select(
        "code_id", S.service_category(x).alias("service"), S.report_category(x).alias("report"),
        S.is_diagnostic(x).alias("diagnostic"),
    )


_VACCINES = ["Influenza vaccine 2023", "MMR", "Measles, mumps", "Reflux repair", "Tdap booster", "hepatitis b series", "Appendectomy", "Shingrix"]
_VAC = "CASE encounter_id % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VACCINES)) + " END"


@query(
    "vaccine_code",
    f"""WITH v AS (SELECT encounter_id, {_VAC} AS name FROM encounters)
        SELECT encounter_id, name, {words('name', fixed.VACCINE_WORDS)} AS vaccine,
          CASE WHEN encounter_id % 40 = 0 THEN '999' WHEN {words('name', ['measles'])} AND {words('name', ['mumps', 'rubella'])} THEN '03' """
    + " ".join(f"WHEN {words('name', [w])} THEN '{c}'" for w, c, _ in fixed.CVX_BY_WORD) + " END AS cvx FROM v",
)
def _(t):
    df = t.encounters.select("encounter_id", F.expr(_VAC).alias("name"))
    given = F.when(F.col("encounter_id") % 40 == 0, " 999 ")
    return df.select(
        "encounter_id", "name", S.is_vaccine(F.col("name")).alias("vaccine"), S.cvx_code(F.col("name"), given).alias("cvx")
    )


_UP = "least(confidence * 1.1::DOUBLE, 1.0::DOUBLE)"
CALIBRATED_SQL = rf"""CASE WHEN contains(lower(label), 'name') AND length(trim(value)) < 2 THEN least(confidence, 0.3::DOUBLE)
    WHEN contains(lower(label), 'name') AND contains(trim(value), ' ') THEN {_UP}
    WHEN regexp_matches(lower(label), 'date|dob|birth') THEN CASE WHEN regexp_matches(value, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}') THEN {_UP}
         WHEN regexp_matches(value, '\d') THEN confidence ELSE least(confidence, 0.4::DOUBLE) END
    WHEN regexp_matches(lower(label), 'mrn|record') THEN CASE WHEN regexp_matches(value, '\d{{3,}}') THEN {_UP} ELSE least(confidence, 0.5::DOUBLE) END
    WHEN regexp_matches(lower(label), 'medication|drug') AND regexp_matches(lower(value), '\d+\s*(mg|ml|units)') THEN least(confidence * 1.05::DOUBLE, 1.0::DOUBLE)
    ELSE confidence END"""


@query(
    "calibrate_confidence",
    f"""WITH c AS (SELECT {KEY}, {CALIBRATED_SQL} AS calibrated FROM fields)
        SELECT {KEY}, calibrated, CASE WHEN calibrated >= 0.8 THEN 'high' WHEN calibrated >= 0.5 THEN 'medium'
            WHEN calibrated >= 0.3 THEN 'low' ELSE 'very_low' END AS level, calibrated < 0.3 AS review FROM c""",
)
def _(t):
    df = t.fields.select(*KEYS, S.calibrated_confidence(F.col("label"), F.col("value"), F.col("confidence")).alias("calibrated"))
    c = F.col("calibrated")
    return df.withColumn("level", S.confidence_level(c)).withColumn("review", c < 0.3)


@query("call_cost", f"WITH {PRICED} SELECT call_id, CAST(cost AS DOUBLE) AS cost FROM priced")
def _(t):
    c = S.call_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return t.usage_log.select("call_id", c.cast("double").alias("cost"))


ERR_CATEGORY_SQL = case_contains("lower(message)", fixed.ERROR_MESSAGE_CATEGORY, "'permanent'")
ERR_SEVERITY_SQL = case_map("error_type", fixed.ERROR_SEVERITY, "'error'")
ERR_STRATEGY_SQL = case_map(
    case_map("error_type", fixed.ERROR_CODE_OF_TYPE, "'UNKNOWN_ERROR'"), fixed.RECOVERY_OF_CODE, "'manual_intervention'"
)


@query(
    "error_category",
    f"""SELECT error_id, {ERR_CATEGORY_SQL} AS category, {ERR_SEVERITY_SQL} AS severity, {ERR_STRATEGY_SQL} AS strategy FROM error_log""",
)
def _(t):
    e = F.col("error_type")
    return t.error_log.select(
        "error_id", S.error_category(F.col("message"), e).alias("category"), S.error_severity(e).alias("severity"),
        S.recovery_strategy(S.error_code(e)).alias("strategy"),
    )


STAGE_SQL = """CASE status WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'failed' WHEN 'pending' THEN 'queued'
    WHEN 'ocr_pending' THEN 'pdf_ocr' ELSE CASE WHEN regexp_matches(lower(message), 'fhir|converting') THEN 'fhir_converting'
    WHEN regexp_matches(lower(message), 'analyzing| ai|^ai') THEN 'ai_processing'
    WHEN regexp_matches(lower(message), 'extract|pdf|ocr') THEN 'pdf_ocr'
    WHEN status = 'processing' THEN 'ai_processing' ELSE 'processing' END END"""
LIVE_SQL = """CASE WHEN status = 'pending' THEN 'Queued' WHEN status = 'ocr_pending' THEN 'OCR Pending'
    WHEN regexp_matches(lower(message), 'fhir|converting') THEN 'FHIR Converting'
    WHEN regexp_matches(lower(message), 'analyzing|ai') THEN 'AI Processing'
    WHEN regexp_matches(lower(message), 'extract|pdf') THEN 'PDF Extracting'
    WHEN status = 'processing' THEN 'Processing' ELSE upper(status[1]) || status[2:] END"""


@query("stage_key", f"SELECT doc_id, {STAGE_SQL} AS stage, {LIVE_SQL} AS live FROM pipeline")
def _(t):
    s, m = F.col("status"), F.col("message")
    return t.pipeline.select("doc_id", S.stage_key(s, m).alias("stage"), S.live_stage(s, m).alias("live"))


@query(
    "access_event_type",
    """SELECT audit_id, CASE WHEN contains(lower(path), 'login') THEN 'login' WHEN contains(lower(path), 'logout') THEN 'logout'
         WHEN regexp_matches(lower(path), '/(patients|documents|fhir)/') THEN CASE method WHEN 'POST' THEN 'phi_create' WHEN 'PUT' THEN 'phi_update'
              WHEN 'PATCH' THEN 'phi_update' WHEN 'DELETE' THEN 'phi_delete' ELSE 'phi_access' END
         WHEN contains(lower(path), '/admin/') THEN 'admin_access' ELSE 'system_access' END AS event_type,
         regexp_matches(path, '/(patients|documents|fhir|reports)/') AS phi,
         regexp_matches(path, '/(patients|documents|providers|fhir|reports|admin|api|accounts)/') AS sensitive FROM audit_log""",
)
def _(t):
    p = F.col("path")
    return t.audit_log.select(
        "audit_id", S.access_event(p, F.col("method")).alias("event_type"), S.is_phi_path(p).alias("phi"),
        S.is_sensitive_path(p).alias("sensitive"),
    )


@query(
    "document_durations",
    """SELECT doc_id, date_diff('second', uploaded_at, processed_at) AS seconds,
              greatest(0, date_diff('second', uploaded_at, processed_at)) * 1000 AS wait_ms FROM pipeline""",
)
def _(t):
    from chartmill.operators.metrics import seconds_between

    sec = seconds_between(F.col("uploaded_at"), F.col("processed_at"))
    return t.pipeline.select("doc_id", sec.alias("seconds"), (F.greatest(F.lit(0), sec) * 1000).alias("wait_ms"))


@query(
    "usage_rates",
    f"""WITH {PRICED} SELECT call_id, input_tokens + output_tokens AS total_tokens,
          CASE WHEN duration_ms > 0 THEN (input_tokens + output_tokens) * 1000.0::DOUBLE / duration_ms END AS tokens_per_second,
          CASE WHEN input_tokens + output_tokens > 0 THEN CAST(cost AS DOUBLE) / (input_tokens + output_tokens) END AS cost_per_token
        FROM priced""",
)
def _(t):
    from chartmill.operators.metrics import usage_rows

    return usage_rows(t.usage_log).select("call_id", "total_tokens", "tokens_per_second", "cost_per_token")


@query(
    "usage_rows",
    f"""WITH {PRICED} SELECT call_id, provider, model, input_tokens + output_tokens AS total_tokens, CAST(cost AS DOUBLE) AS cost,
          started_at, started_at + INTERVAL '1' MILLISECOND * duration_ms AS completed_at, success FROM priced""",
)
def _(t):
    from chartmill.operators.metrics import usage_rows

    return usage_rows(t.usage_log).select(
        "call_id", "provider", "model", "total_tokens", F.col("cost").cast("double").alias("cost"),
        "started_at", "completed_at", "success",
    )


@query(
    "patient_age",
    """SELECT patient_id, CAST(date_diff('year', birth_date, DATE '2024-06-15') -
          CASE WHEN strftime(birth_date, '%m%d') > '0615' THEN 1 ELSE 0 END AS INT) AS age,
          lower(first_name) AS first_search, lower(last_name) AS last_search FROM patients""",
)
def _(t):
    return t.patients.select(
        "patient_id", S.age_at(F.col("birth_date"), F.lit("2024-06-15").cast("date")).alias("age"),
        F.lower("first_name").alias("first_search"), F.lower("last_name").alias("last_search"),
    )


@query(
    "medication_sentence_parse",
    r"""WITH h AS (SELECT med_id, sentence, lower(sentence) AS s FROM medications)
        SELECT med_id, trim(regexp_extract(sentence, '^(.*?)\s*(\d|$)', 1)) AS name,
          nullif(regexp_extract(s, '(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|units?|iu)\b'), '') AS dosage,
          coalesce(nullif(regexp_extract(s, '\b(oral|orally|po|by mouth)\b'), ''), nullif(regexp_extract(s, '\b(iv|intravenous)\b'), '')) AS route,
          coalesce(nullif(regexp_extract(s, '\b(as needed|prn)\b'), ''), nullif(regexp_extract(s, '\b(every \d+ hours?)\b'), ''),
             nullif(regexp_extract(s, '\b(twice daily|bid)\b'), ''), nullif(regexp_extract(s, '\b(once daily|daily)\b'), '')) AS schedule
        FROM h""",
)
def _(t):
    return t.medications.select("med_id", S.parse_medication(F.col("sentence")).alias("p")).select("med_id", "p.*")


@query(
    "dosage_text_parse",
    r"""WITH h AS (SELECT med_id, lower(dose || ' oral ' || schedule) AS s FROM medications)
        SELECT med_id, nullif(regexp_extract(s, '\d+\.?\d*\s*(mg|mcg|g|ml|units?)\b'), '') AS amount,
          CASE WHEN regexp_matches(s, '\b(once|twice) daily\b') THEN regexp_extract(s, '\b(once|twice) daily\b')
               WHEN regexp_matches(s, '\bevery\s+\d+\s+hours\b') THEN regexp_extract(s, 'every \d+ hours')
               WHEN contains(s, 'as needed') THEN 'as needed' END AS frequency, 'oral' AS route FROM h""",
)
def _(t):
    text = F.concat_ws(" ", "dose", F.lit("Oral"), "schedule")
    return t.medications.select("med_id", S.parse_dosage(text).alias("p")).select("med_id", "p.*")


@query(
    "provider_name_parse",
    r"""WITH c AS (SELECT provider_id, full_name, trim(regexp_replace(regexp_replace(full_name, '^Dr\. ', ''), ',? (MD|RN)$', '')) AS n FROM providers)
        SELECT provider_id, CASE WHEN contains(n, ',') THEN split_part(n, ', ', 1) ELSE string_split(n, ' ')[-1] END AS family,
          CASE WHEN contains(n, ',') THEN split_part(n, ', ', 2) ELSE array_to_string(string_split(n, ' ')[:-2], ' ') END AS given FROM c""",
)
def _(t):
    return t.providers.select("provider_id", S.parse_provider_name(F.col("full_name")).alias("p")).select("provider_id", "p.*")


@query(
    "edit_similarity",
    """SELECT code_id, CASE WHEN display = lower(test_name) THEN 1.0::DOUBLE
          ELSE 1.0::DOUBLE - levenshtein(display, lower(test_name))::DOUBLE / greatest(length(display), length(test_name)) END AS similarity FROM codes""",
)
def _(t):
    return t.codes.select("code_id", S.edit_similarity(F.col("display"), F.lower("test_name")).alias("similarity"))


@query(
    "standardize_clinical_date",
    rf"""SELECT {KEY}, CASE WHEN value = '1980-02-30' THEN NULL WHEN regexp_matches(value, '^\d{{4}}-\d\d-\d\d$') THEN CAST(value AS DATE)
           WHEN regexp_matches(value, '\d\d/\d\d/\d{{4}}') THEN strptime(regexp_extract(value, '\d\d/\d\d/\d{{4}}'), '%m/%d/%Y')::DATE
           WHEN regexp_matches(value, '\d\d-\d\d-\d{{4}}') THEN strptime(regexp_extract(value, '\d\d-\d\d-\d{{4}}'), '%m-%d-%Y')::DATE END AS day
         FROM fields WHERE label IN ('Date of Birth', 'Admission date', 'Lab_glucose')""",
)
def _(t):
    return _date_source(t).select(*KEYS, S.clinical_date(F.col("value"), F.lit("2024-06-15").cast("date")).alias("day"))


@query(
    "temporal_compliance",
    rf"""SELECT {KEY}, regexp_matches(value, '^\d{{4}}-\d\d-\d\d$') AS valid FROM fields
         WHERE label IN ('Date of Birth', 'Admission date', 'Lab_glucose')""",
)
def _(t):
    return _date_source(t).select(*KEYS, S.is_iso_8601(F.col("value")).alias("valid"))
