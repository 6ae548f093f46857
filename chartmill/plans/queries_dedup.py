"""Queries for deduplication."""

from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators import dedup as D
from chartmill.operators import similar as X
from chartmill.operators import weighted as W
from chartmill.plans.catalog import query
from chartmill.plans.sqltext import case_contains

_OBS = "SELECT patient_id, obs_id, loinc AS code, value, unit, effective_at AS at, source_id, CAST(1.0 - confidence_gap AS DOUBLE) AS confidence, line_no FROM observations"


def _matching(fields, a="a", b="b", exact="false"):
    """The equal fields of two rows by name, ``*`` for an exact pair."""
    same = ", ".join(f"CASE WHEN {a}.{f} IS NOT DISTINCT FROM {b}.{f} THEN '{f}' END" for f in sorted(fields))
    return f"CASE WHEN {exact} THEN '*' ELSE concat_ws(',', {same}) END"


_OBS_FIELDS = ["at", "code", "patient_id", "unit", "value"]
_NEAR = "10 * abs(a.value - b.value) <= greatest(a.value, b.value) AND a.unit = b.unit"
_TIME = "abs(epoch_us(a.at) - epoch_us(b.at)) <= 86400000000"


@query(
    "content_hash_duplicates",
    """WITH h AS (SELECT doc_id, sha256('lang=' || lang || '|source=' || source || '|text=' || text) AS content_hash FROM documents)
       SELECT content_hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY 1""",
)
def _(t):
    rows = D.content_hash(t.documents, ["text", "lang", "source"])
    return rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("chunk_content_hash", "SELECT conv_id, turn, sha256(text || '|v1|' || role) AS content_hash FROM conversations")
def _(t):
    from chartmill.operators.text import chunk_hash

    return t.conversations.select("conv_id", "turn", chunk_hash(F.col("text"), "v1", F.col("role")).alias("content_hash"))


def _dup_sql(obs, lt):
    return f"""o AS ({obs}), p AS (SELECT a.patient_id, a.obs_id, b.obs_id AS partner, {_NEAR} AS v, {_TIME} AS t, a.value = b.value AND a.unit = b.unit AND a.at = b.at AS c
       FROM o a JOIN o b ON a.patient_id = b.patient_id AND a.code = b.code AND {lt}),
     d AS (SELECT patient_id, obs_id, min(partner) FILTER (c) AS pc, min(partner) FILTER (v AND t) AS pn, min(partner) FILTER (v) AS pv, min(partner) FILTER (t) AS pt FROM p WHERE v OR t GROUP BY ALL)"""


@query(
    "weighted_duplicates",
    f"""WITH {_dup_sql(_OBS, 'b.obs_id < a.obs_id')} SELECT d.patient_id, d.obs_id, CASE WHEN pc IS NOT NULL THEN 'exact' WHEN pn IS NOT NULL THEN 'near' ELSE 'fuzzy' END AS kind,
          coalesce(pc, pn, pv, pt) AS partner, CASE WHEN pc IS NOT NULL OR pn IS NOT NULL THEN 1.0 WHEN pv IS NOT NULL THEN 0.875 ELSE 0.75 END::DOUBLE AS score,
          {_matching(_OBS_FIELDS, exact='pc IS NOT NULL')} AS matching
        FROM d JOIN o a ON a.obs_id = d.obs_id JOIN o b ON b.obs_id = coalesce(pc, pn, pv, pt)""",
)
def _(t):
    obs = t.sql(_OBS)
    return D.observation_duplicates(obs, F.col("obs_id"), fields=_OBS_FIELDS)


@query(
    "pair_removal_with_provenance",
    f"""WITH {_dup_sql(_OBS, 'b.obs_id < a.obs_id')}, x AS (SELECT obs_id, coalesce(pc, pn, pv, pt) AS partner FROM d), m AS (SELECT partner, count(*) AS merged FROM x GROUP BY 1)
        SELECT o.obs_id, coalesce(merged, 0) AS merged FROM o LEFT JOIN m ON m.partner = o.obs_id WHERE o.obs_id NOT IN (SELECT obs_id FROM x)""",
)
def _(t):
    obs = t.sql(_OBS)
    return D.remove_judged(D.judged_observations(obs, F.col("obs_id")), "obs_id").select("obs_id", "merged")


@query(
    "bundle_dedup_by_confidence",
    f"""WITH o AS ({_OBS}) SELECT a.obs_id FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.patient_id = b.patient_id AND a.code = b.code
          AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.obs_id < a.obs_id)) AND (({_NEAR}) OR {_TIME}))""",
)
def _(t):
    obs = t.sql(_OBS)
    order = D.rank_order(F.col("confidence"), F.lit("Observation"), F.col("obs_id"))
    return D.judged_observations(obs, order).filter("kind IS NULL").select("obs_id")


for _name, _role, _id, _code, _third, _fields in [
    ("condition_duplicates", "conditions", "condition_id", "code", "status", ["patient_id", "name", "code", "status", "severity", "onset_text", "evidence"]),
    ("medication_duplicates", "medications", "med_id", "name", "schedule", ["patient_id", "name", "dose", "schedule", "status", "start_date"]),
]:
    query(
        _name,
        f"""WITH x AS (SELECT a.{_id}, a.patient_id, a.{_code}, min(b.{_id}) FILTER (lower(a.{_third}) = lower(b.{_third})) AS pn, min(b.{_id}) AS pf FROM {_role} a JOIN {_role} b
              ON a.patient_id = b.patient_id AND a.{_code} = b.{_code} AND b.{_id} < a.{_id} GROUP BY ALL)
            SELECT x.patient_id, x.{_code}, x.{_id}, CASE WHEN pn IS NOT NULL THEN 'near' ELSE 'fuzzy' END AS kind, coalesce(pn, pf) AS partner, {_matching(_fields)} AS matching
            FROM x JOIN {_role} a ON a.{_id} = x.{_id} JOIN {_role} b ON b.{_id} = coalesce(pn, pf)""",
    )(lambda t, r=_role, i=_id, c=_code, h=_third, f=_fields: W.with_matching(D.coded_duplicates(getattr(t, r), i, ["patient_id", c], F.lower(h), F.col(i)), getattr(t, r), i, f))


# family and given names, birth date, and identifiers as "system|value"
_PERSONS = """SELECT patient_id, CASE WHEN patient_id % 4 = 0 THEN 'Meyer' WHEN patient_id % 4 = 2 THEN 'MEYER' ELSE last_name END AS family, CASE patient_id % 5 WHEN 0 THEN first_name || ' J.' WHEN 1 THEN 'Maria ' || lower(first_name) ELSE first_name END AS given,
    CASE WHEN patient_id % 11 <> 0 THEN birth_date END AS birth_date, CASE WHEN patient_id % 3 <> 0 THEN gender END AS gender,
    CASE WHEN patient_id % 7 <> 0 THEN 'mrn|' || mrn || ',card|' || CAST(patient_id % 880 AS STRING) END AS identifiers FROM patients"""
_PERSON_FIELDS = ["family", "given", "birth_date", "gender", "identifiers"]


def _best_sql(rows, row_id, score, fields, exact):
    return f"""WITH p AS ({rows}), s AS (
            SELECT a.{row_id}, b.{row_id} AS partner, {exact} AS exact, {score} AS score, {_matching(fields)} AS matching FROM p a JOIN p b ON b.{row_id} < a.{row_id}
        ), r AS (SELECT *, row_number() OVER (PARTITION BY {row_id} ORDER BY exact DESC, score DESC, partner) AS place FROM s WHERE exact OR score >= 0.7)
        SELECT {row_id}, partner, CASE WHEN exact THEN 'exact' WHEN score >= 0.9 THEN 'near' ELSE 'fuzzy' END AS kind, CASE WHEN exact THEN 1.0 ELSE score END::DOUBLE AS score,
               CASE WHEN exact THEN '*' ELSE matching END AS matching FROM r WHERE place = 1"""


def _all_equal(fields):
    return " AND ".join(f"a.{f} IS NOT DISTINCT FROM b.{f}" for f in fields)


@query(
    "patient_similarity",
    _best_sql(
        _PERSONS, "patient_id",
        """(CASE WHEN lower(a.family) = lower(b.family) AND list_has_any(string_split(lower(a.given), ' '), string_split(lower(b.given), ' ')) THEN 2 ELSE 0 END
            + CASE WHEN a.birth_date = b.birth_date THEN 2 ELSE 0 END
            + CASE WHEN list_has_any(string_split(a.identifiers, ','), string_split(b.identifiers, ',')) THEN 1 ELSE 0 END) / 5.0::DOUBLE""",
        _PERSON_FIELDS, _all_equal(_PERSON_FIELDS),
    ),
)
def _(t):
    names = F.transform(F.split(F.lower("given"), " "), lambda g: F.concat(F.lower("family"), F.lit("|"), g))
    none = F.array().cast("array<string>")
    factors = [W.Factor("name", 2, F.coalesce(names, none)), W.equal("birth_date", 2, "birth_date"), W.Factor("identifier", 1, F.coalesce(F.split("identifiers", ","), none))]
    return W.best_partner(t.sql(_PERSONS), "patient_id", factors, _PERSON_FIELDS)


_VISITS = "SELECT encounter_id, patient_id, status, enc_class, type_text, date_text, reason FROM encounters"
_VISIT_FIELDS = ["patient_id", "status", "enc_class", "type_text", "date_text", "reason"]


@query(
    "generic_similarity",
    _best_sql(_VISITS, "encounter_id", "(" + " + ".join(f"CASE WHEN a.{f} IS NOT DISTINCT FROM b.{f} THEN 1 ELSE 0 END" for f in _VISIT_FIELDS) + ") / 6.0::DOUBLE", _VISIT_FIELDS, _all_equal(_VISIT_FIELDS)),
)
def _(t):
    factors = [W.equal(f, 1, f, null_equals_null=True) for f in _VISIT_FIELDS]
    return W.best_partner(t.sql(_VISITS), "encounter_id", factors, _VISIT_FIELDS)


@query(
    "condition_duplicates_strict",
    """WITH x AS (SELECT a.condition_id, a.patient_id, a.code, min(b.condition_id) FILTER (a.status = b.status) AS pn, min(b.condition_id) FILTER (a.code = b.code) AS pf FROM conditions a JOIN conditions b
         ON a.patient_id = b.patient_id AND (a.code = b.code OR a.status = b.status) AND b.condition_id < a.condition_id GROUP BY ALL)
       SELECT patient_id, code, condition_id, CASE WHEN pn IS NOT NULL THEN 'near' ELSE 'fuzzy' END AS kind, coalesce(pn, pf) AS partner FROM x""",
)
def _(t):
    return D.coded_duplicates(t.conditions, "condition_id", ["patient_id", "code"], F.lower("status"), F.col("condition_id"), strict_reference=True)


_EQ = "a.patient_id = b.patient_id AND a.code = b.code AND a.value = b.value AND a.unit = b.unit AND " + _TIME


@query("equivalent_observations_first", f"WITH o AS ({_OBS}) SELECT a.obs_id FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE {_EQ} AND b.obs_id < a.obs_id)")
def _(t):
    return D.equivalent_observations(t.sql(_OBS), F.col("obs_id"), keep_latest=False).select("obs_id")


@query(
    "equivalent_observations_latest",
    f"""WITH o AS ({_OBS}), star AS (SELECT a.obs_id AS centre, b.obs_id AS member FROM o a JOIN o b ON {_EQ} AND b.obs_id >= a.obs_id),
        best AS (SELECT centre, max(member) AS m FROM star GROUP BY 1)
        SELECT obs_id FROM o WHERE obs_id NOT IN (SELECT member FROM star JOIN best USING (centre) WHERE member <> m)""",
)
def _(t):
    return D.equivalent_observations(t.sql(_OBS), F.col("obs_id")).select("obs_id")


@query("equivalent_conditions", "SELECT min(condition_id) AS condition_id FROM conditions GROUP BY patient_id, code, status")
def _(t):
    return D.first_per_key(t.conditions, [F.col("patient_id"), F.col("code"), F.col("status")], F.col("condition_id")).select("condition_id")


@query(
    "equivalent_practitioners",
    """WITH p AS (SELECT provider_id, CASE WHEN provider_id % 3 <> 0 THEN CAST(provider_id % 40 AS STRING) END AS npi_key, full_name FROM providers)
       SELECT a.provider_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.provider_id < a.provider_id AND (a.npi_key = b.npi_key OR a.full_name || a.provider_id % 50 = b.full_name || b.provider_id % 50))""",
)
def _(t):
    rows = t.providers.selectExpr("provider_id", "CASE WHEN provider_id % 3 <> 0 THEN CAST(provider_id % 40 AS STRING) END AS npi_key", "full_name || CAST(provider_id % 50 AS STRING) AS name_key")
    return D.first_by_any_key(rows, "provider_id", [["npi_key"], ["name_key"]]).select("provider_id")


_PAT = "SELECT patient_id, CASE WHEN patient_id % 4 <> 0 THEN CAST(patient_id % 900 AS STRING) END AS mrn, first_name || last_name AS name, birth_date FROM patients"


@query(
    "equivalent_patients",
    f"""WITH p AS ({_PAT}) SELECT a.patient_id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.patient_id < a.patient_id AND
          CASE WHEN a.mrn IS NOT NULL AND b.mrn IS NOT NULL THEN a.mrn = b.mrn ELSE a.name = b.name AND a.birth_date = b.birth_date END)""",
)
def _(t):
    return D.equivalent_patients(t.sql(_PAT)).select("patient_id")


_N = "SELECT obs_id, patient_id, loinc AS code, CASE WHEN source_id % 5 <> 0 THEN value END AS value, effective_date, unit FROM observations"


@query(
    "duplicate_of_existing",
    f"""WITH n AS (SELECT * FROM ({_N}) WHERE obs_id LIKE '%-1-%'), e AS (SELECT * FROM ({_N}) WHERE obs_id LIKE '%-2-%')
        SELECT obs_id, EXISTS (SELECT 1 FROM e WHERE e.patient_id = n.patient_id AND e.code = n.code AND e.unit = n.unit AND e.value IS NOT DISTINCT FROM n.value) AS duplicate FROM n""",
)
def _(t):
    rows = t.sql(_N)
    known = rows.filter("obs_id LIKE '%-2-%'")
    return D.is_known(rows.filter("obs_id LIKE '%-1-%'"), known, ["patient_id", "code", "unit", "value"]).select("obs_id", "duplicate")


@query("exact_dedup_first", "SELECT encounter_id, test_name, value, min(obs_id) AS obs_id FROM observations GROUP BY ALL")
def _(t):
    rows = t.observations.withColumnRenamed("encounter_id", "doc_id")
    return D.exact_first(rows, ["test_name", "value"], ["obs_id"]).selectExpr("doc_id AS encounter_id", "test_name", "value", "obs_id")


_LABEL = "lower(label)"
_KIND_SQL = case_contains(_LABEL, fixed.FIELD_CLASSES, "'other'")
_MF = rf"""f AS (SELECT *, {_KIND_SQL} AS k FROM fields), g AS (SELECT *, CASE k WHEN 'patient_demographics' THEN {case_contains(_LABEL, fixed.DEMOGRAPHIC_LABELS, _LABEL)}
    WHEN 'diagnoses' THEN trim(regexp_replace(regexp_replace(regexp_replace(lower(value), '^\d+[.)]\s*', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g'))
    WHEN 'medications' THEN array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(value), '\d+\s*(mg|ml|mcg|units?|iu|tablets?|capsules?|pills?)', '', 'g'), '\b(daily|twice|bid|tid|qid|prn|as needed)\b', '', 'g'), '\s+', ' ', 'g')), ' ')[1:2], ' ')
    WHEN 'lab_results' THEN coalesce(nullif(regexp_extract({_LABEL}, 'glucose|hemoglobin|cholesterol|sodium|potassium|creatinine'), ''), nullif(regexp_extract(lower(value), 'glucose|hemoglobin|cholesterol|sodium|potassium|creatinine'), ''), {_LABEL})
    WHEN 'dates' THEN {case_contains(_LABEL, fixed.DATE_KINDS, "'general_date'")} ELSE {_LABEL} END AS key,
    CASE WHEN k = 'diagnoses' THEN length(trim(value))::DOUBLE WHEN k = 'medications' THEN (regexp_matches(lower(value), '\d+\s*(mg|ml|mcg|units?|iu)')::INT + regexp_matches(lower(value), 'daily|twice|bid|tid|qid|prn')::INT)::DOUBLE ELSE confidence END AS x,
    CASE WHEN k IN ('diagnoses', 'medications') THEN confidence ELSE length(trim(value))::DOUBLE END AS y FROM f)"""


@query(
    "merge_fields",
    f"""WITH {_MF} SELECT doc_id, k AS field_class, key, count(*) AS n, arg_max(label, {{'x': x, 'y': y, 'a': -chunk, 'b': -ord, 'c': -code_id}}) AS label,
          arg_max(value, {{'x': x, 'y': y, 'a': -chunk, 'b': -ord, 'c': -code_id}}) AS value, arg_max(confidence, {{'x': x, 'y': y, 'a': -chunk, 'b': -ord, 'c': -code_id}}) AS confidence,
          array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM g WHERE key <> '' GROUP BY ALL""",
)
def _(t):
    return D.merge_fields(t.fields)


@query(
    "medication_dedup",
    """WITH m AS (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS drug, lower(dose) AS dose_key FROM medications),
       s AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY patient_id, drug, dose_key ORDER BY start_date DESC, med_id) = 1),
       l AS (SELECT s.patient_id, s.drug, s.dose_key, arg_min(m.status, m.med_id) AS lifted FROM s JOIN m ON m.patient_id = s.patient_id AND m.drug = s.drug AND m.dose_key = s.dose_key
             AND m.status IN ('active', 'intended', 'on-hold') AND m.med_id > s.med_id GROUP BY ALL),
       x AS (SELECT patient_id, drug, dose_key, lower(schedule) AS lo, min(med_id) AS i, arg_min(schedule, med_id) AS sch FROM m GROUP BY ALL),
       y AS (SELECT patient_id, drug, dose_key, string_agg(sch, '; ' ORDER BY i) AS dosage FROM x GROUP BY ALL), n AS (SELECT patient_id, drug, dose_key, count(*) AS n FROM m GROUP BY ALL)
       SELECT s.patient_id, s.drug, s.dose_key, med_id, start_date, CASE WHEN status IN ('active', 'intended', 'on-hold') THEN status ELSE coalesce(lifted, status) END AS status, n, dosage
       FROM s LEFT JOIN l USING (patient_id, drug, dose_key) JOIN y USING (patient_id, drug, dose_key) JOIN n USING (patient_id, drug, dose_key)""",
)
def _(t):
    return D.merge_medications(t.medications)


@query(
    "encounter_dedup",
    """WITH e AS (SELECT *, coalesce(date_text, '') AS d, trim(split_part(lower(location), ',', 1)) AS p, (location <> '')::INT + 2 AS rich FROM encounters)
       SELECT encounter_id FROM e QUALIFY row_number() OVER (PARTITION BY patient_id, CASE WHEN d = '' AND p = '' THEN encounter_id END, d, CASE WHEN d = '' AND p = '' THEN '' ELSE enc_class END, p ORDER BY rich DESC, encounter_id) = 1""",
)
def _(t):
    return D.merge_encounters(t.encounters).select("encounter_id")


@query(
    "duplicate_medications",
    r"""WITH a AS (SELECT patient_id, med_id, trim(regexp_replace(lower(name), '\b(capsule|inhaler)\b', '', 'g')) AS drug FROM medications WHERE status = 'active')
        SELECT a.patient_id, a.drug, count(*) AS pairs, (SELECT count(*) FROM a z WHERE z.patient_id = a.patient_id AND z.drug = a.drug) AS n, min(a.med_id) AS first_id
        FROM a JOIN a b ON a.patient_id = b.patient_id AND a.drug = b.drug AND a.med_id < b.med_id GROUP BY ALL""",
)
def _(t):
    return D.duplicate_medications(t.medications)


_FULL = "SELECT obs_id, patient_id, test_name, CASE WHEN source_id % 3 <> 0 THEN loinc END AS code, CASE WHEN source_id % 4 <> 0 THEN line_status END AS status, CASE WHEN source_id % 5 <> 0 THEN value END AS value, CASE WHEN source_id % 6 <> 0 THEN effective_at END AS seen_at, source_id % 2 = 0 AS has_actor FROM observations"


@query(
    "most_complete_resource",
    f"""WITH r AS ({_FULL}), s AS (SELECT *, (code IS NOT NULL)::INT * 1.5::DOUBLE + (status IS NOT NULL)::INT * 1.5::DOUBLE + (value IS NOT NULL)::INT * 1.5::DOUBLE + (seen_at IS NOT NULL)::INT * 1.5::DOUBLE AS score,
          sha256(concat_ws('|', 'code=' || code, 'status=' || status, 'value=' || value)) AS h FROM r)
        SELECT patient_id, test_name, obs_id, score, count(*) OVER (PARTITION BY patient_id, test_name) AS n FROM s
        QUALIFY row_number() OVER (PARTITION BY patient_id, test_name ORDER BY score DESC, seen_at DESC NULLS LAST, has_actor DESC, h, obs_id) = 1""",
)
def _(t):
    rows = D.content_hash(t.sql(_FULL), ["code", "status", "value"], "h")
    score = D.completeness_score({"code": 0.5, "status": 0.5, "value": 0.5, "seen_at": 0.5})
    return D.most_complete(rows, ["patient_id", "test_name"], score, F.col("seen_at"), F.col("has_actor"), "h", "obs_id")


@query("fuzzy_item_dedup")
def _(t):
    items = t.conditions.selectExpr("encounter_id AS doc_id", "'conditions' AS kind", "condition_id AS position", "name", "confidence")
    return D.fuzzy_items(items)


@query("duplicate_patients")
def _(t):
    return X.duplicate_patients(t.patients)


@query("similar_codes")
def _(t):
    return X.similar_codes(t.codes.select(F.concat_ws("-", "loinc", F.substring("display", 1, 3)).alias("c")), "c", 5)


@query("equivalent_codes")
def _(t):
    return X.equivalent_codes(t.codes.select(F.trim("raw_code").alias("code"), F.col("stated_system").alias("system")))


_MAPPED = "SELECT DISTINCT trim(raw_code) AS code, lower(stated_system) AS system, loinc AS target_code, 'LOINC' AS target_system, CAST(0.9 AS DOUBLE) AS confidence, 'equivalent' AS kind FROM codes WHERE code_id % 3 = 0"


@query("mapped_codes", f"WITH m AS ({_MAPPED}), c AS (SELECT DISTINCT trim(raw_code) AS code, stated_system AS system FROM codes) SELECT c.code, c.system, target_code, target_system, confidence FROM c JOIN m ON m.code = c.code AND m.system = lower(c.system)")
def _(t):
    codes = t.codes.select(F.trim("raw_code").alias("code"), F.col("stated_system").alias("system"))
    return X.equivalent_codes(codes, t.sql(_MAPPED)).filter("kind = 'equivalent'").drop("kind")


@query("sequence_ratio")
def _(t):
    from chartmill.functions.udfs import seq_ratio

    return t.codes.select("code_id", seq_ratio(F.col("display"), F.lower("test_name")).alias("ratio"))
