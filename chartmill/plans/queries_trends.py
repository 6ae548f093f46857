"""Queries for trends, timelines and orderings."""

from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators import trends as T
from chartmill.plans.catalog import query
from chartmill.plans.queries_metrics import TIMELINE_ROWS
from chartmill.plans.queries_scalar import ABNORMAL_SQL
from chartmill.plans.sqltext import half

_W = "SELECT patient_id, CAST(encounter_id AS STRING) AS obs_id, visit_date AS day, 40 + amount / 5000 AS weight_kg FROM encounters"
_H = "SELECT patient_id, CAST(encounter_id AS STRING) AS obs_id, visit_date AS day, 1.5 + CAST(encounter_id % 50 AS DOUBLE) / 100 AS height_m FROM encounters WHERE encounter_id % 3 = 0"
_TREND = f"""w AS ({_W.replace('1.5', '1.5::DOUBLE')}), h AS (SELECT patient_id, arg_max(height_m, {{'day': day, 'obs_id': obs_id}}) AS height_m FROM ({_H.replace('1.5 +', '1.5::DOUBLE +')}) GROUP BY 1),
   l AS (SELECT w.*, height_m, lag(weight_kg) OVER p AS pw, lag(day) OVER p AS pd FROM w JOIN h USING (patient_id) WINDOW p AS (PARTITION BY patient_id ORDER BY day, obs_id)),
   c AS (SELECT *, {half('weight_kg / (height_m * height_m)', 1)} AS bmi, CASE WHEN pw = 0 THEN 0 ELSE {half('(weight_kg - pw) / pw * 100', 1)} END AS change, CAST(day - pd AS INT) AS days FROM l),
   trend AS (SELECT patient_id, obs_id, day, weight_kg, bmi, CASE WHEN bmi < 18.5 THEN 'underweight' WHEN bmi < 25 THEN 'normal' WHEN bmi < 30 THEN 'overweight'
       WHEN bmi < 35 THEN 'obese_class_1' WHEN bmi < 40 THEN 'obese_class_2' ELSE 'obese_class_3' END AS category, change, days,
     coalesce((days <= 30 AND abs(change) >= 5) OR (days <= 90 AND abs(change) >= 7.5) OR (days <= 180 AND abs(change) >= 10), false) AS significant FROM c)"""


def _weights(t):
    return t.sql(_W)


@query("weight_trend", f"WITH {_TREND} SELECT * FROM trend")
def _(t):
    return T.weight_trend(_weights(t), t.sql(_H))


@query(
    "weight_summary",
    f"""WITH {_TREND}, s AS (SELECT patient_id, count(*) AS n, arg_min(weight_kg, {{'day': day, 'obs_id': obs_id}}) AS first_weight, arg_max(weight_kg, {{'day': day, 'obs_id': obs_id}}) AS last_weight,
          min(day) AS first_day, max(day) AS last_day, count(*) FILTER (significant) AS significant_changes FROM trend GROUP BY 1)
        SELECT *, {half('(last_weight - first_weight) / first_weight * 100', 1)} AS total_change FROM s""",
)
def _(t):
    return T.weight_summary(T.weight_trend(_weights(t), t.sql(_H)))


@query(
    "recent_weights",
    f"WITH w AS ({_W}) SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY day DESC, obs_id) AS place FROM w QUALIFY place <= 12",
)
def _(t):
    return T.recent_weights(_weights(t))


@query(
    "timeline_columns",
    f"""WITH e AS ({TIMELINE_ROWS}), x AS (SELECT *, least(min(start_date) OVER p, min(end_date) OVER p) AS lo, greatest(max(start_date) OVER p, max(end_date) OVER p) AS hi FROM e WINDOW p AS (PARTITION BY patient_id)),
        y AS (SELECT *, (hi - lo) / 365 AS per, start_date IS NULL OR hi IS NULL OR hi = lo AS flat FROM x),
        z AS (SELECT *, CASE WHEN flat THEN 1 ELSE CAST(floor((start_date - lo) / per) AS BIGINT) + 1 END AS a FROM y)
        SELECT encounter_id, patient_id, kind, status, start_date, end_date, a AS start_column,
          CASE WHEN flat THEN 2 WHEN end_date IS NULL THEN a + 1 ELSE greatest(CAST(floor((end_date - lo) / per) AS BIGINT) + 1, a + 1) END AS end_column FROM z""",
)
def _(t):
    return T.timeline_columns(t.sql(TIMELINE_ROWS))


_EVENTS = f"""SELECT patient_id, 'encounter' AS source, CAST(encounter_id AS STRING) AS item_id, CAST(visit_date AS STRING) AS day FROM encounters
   UNION ALL SELECT patient_id, 'medication', med_id, start_date FROM medications
   UNION ALL SELECT patient_id, 'condition', condition_id, onset_text FROM conditions"""


@query("timeline_events", f"WITH e AS ({_EVENTS}) SELECT *, coalesce(day, '1900-01-01') AS sort_date FROM e")
def _(t):
    return T.newest_first(t.sql(_EVENTS), "day")


@query(
    "latest_result_per_test",
    f"""WITH r AS (SELECT *, {ABNORMAL_SQL} AS result FROM results),
        first_visit AS (SELECT patient_id, visit_date, min(encounter_id) AS by_date FROM encounters GROUP BY ALL),
        n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY patient_id, test_name ORDER BY effective_at DESC, obs_id) = 1)
        SELECT n.patient_id, test_name, obs_id, value, effective_at, result, coalesce(encounter_ref, by_date) AS visit
        FROM n LEFT JOIN first_visit f ON f.patient_id = n.patient_id AND f.visit_date = TRY_CAST(n.date_text AS DATE)""",
)
def latest_result_per_test(t):
    """Newest result per patient and test with its flag and visit."""
    r = S.abnormal_result(F.col("flag"), F.col("value"), F.col("low"), F.col("high"))
    newest = T.latest_per_test(t.results.withColumn("result", r))
    visits = t.encounters.groupBy("patient_id", "visit_date").agg(F.min("encounter_id").alias("by_date"))
    day = F.try_to_date("date_text", "yyyy-MM-dd").alias("visit_date")
    return newest.select(
        "patient_id", "test_name", "obs_id", "value", "effective_at", "result", "encounter_ref", day
    ).join(visits, ["patient_id", "visit_date"], "left").select(
        "patient_id", "test_name", "obs_id", "value", "effective_at", "result", F.coalesce("encounter_ref", "by_date").alias("visit")
    )


@query(
    "key_results",
    """WITH n AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY patient_id, test_name ORDER BY effective_at DESC, obs_id) = 1),
       p AS (SELECT *, CASE WHEN regexp_matches(lower(test_name), 'glucose|hemoglobin|creatinine|cholesterol') THEN 90
          WHEN regexp_matches(lower(test_name), 'blood pressure|heart rate|temperature|weight') THEN 85 WHEN regexp_matches(lower(test_name), 'lab|test|level') THEN 80 ELSE 50 END AS priority FROM n)
       SELECT patient_id, obs_id, test_name, priority, row_number() OVER (PARTITION BY patient_id ORDER BY priority DESC, effective_at DESC, test_name) AS place FROM p QUALIFY place <= 10""",
)
def _(t):
    return T.key_results(t.observations).select("patient_id", "obs_id", "test_name", "priority", "place")


@query(
    "top_conditions_per_patient",
    """SELECT patient_id, condition_id, status, row_number() OVER (PARTITION BY patient_id ORDER BY status = 'active' DESC, updated_at DESC, condition_id) AS place
       FROM conditions QUALIFY place <= 10""",
)
def _(t):
    return T.top_conditions(t.conditions).select("patient_id", "condition_id", "status", "place")


@query(
    "top_medications_per_patient",
    """SELECT patient_id, med_id, status, row_number() OVER (PARTITION BY patient_id ORDER BY status = 'active' DESC, start_date DESC, med_id) AS place
       FROM medications QUALIFY place <= 10""",
)
def _(t):
    return T.top_medications(t.medications).select("patient_id", "med_id", "status", "place")


@query(
    "close_observations",
    """WITH l AS (SELECT event_id, user_id, ts, lag(event_id) OVER p AS prev_event_id, lag(ts) OVER p AS prev_ts FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, prev_event_id, user_id FROM l WHERE ts - prev_ts < INTERVAL '2' HOUR""",
)
def _(t):
    return T.close_observations(t.events, ["user_id"], 7200).select("event_id", "prev_event_id", "user_id")


_ANCHORS = """s AS (SELECT doc_id, patient_id, uploaded_at, row_number() OVER (PARTITION BY patient_id ORDER BY uploaded_at, doc_id) AS rn FROM pipeline),
       g AS (SELECT doc_id, patient_id, uploaded_at, rn, uploaded_at AS anchor_at FROM s WHERE rn = 1
             UNION ALL SELECT s.doc_id, s.patient_id, s.uploaded_at, s.rn, CASE WHEN s.uploaded_at - g.anchor_at <= INTERVAL '24' HOUR THEN g.anchor_at ELSE s.uploaded_at END
             FROM g JOIN s ON s.patient_id = g.patient_id AND s.rn = g.rn + 1)"""


@query(
    "anchor_24h_groups",
    f"WITH RECURSIVE {_ANCHORS} SELECT doc_id, patient_id, anchor_at FROM g",
)
def _(t):
    return T.proximity_groups(t.pipeline).select("doc_id", "patient_id", "anchor_at")


_RDOCS = """SELECT doc_id, patient_id, uploaded_at, CASE WHEN doc_id % 3 = 0 THEN doc_id % 700 END AS encounter_key,
   CASE WHEN doc_id % 5 = 0 THEN doc_id % 60 END AS visit_key, CASE WHEN doc_id % 2 = 0 THEN doc_id % 17 END AS provider_key,
   CASE WHEN doc_id % 4 = 1 THEN status END AS type_key FROM pipeline"""
_KINDS = {"encounter": "encounter_key", "visit": "visit_key", "provider": "provider_key", "date_proximity": "date_key", "document_type": "type_key"}
_REL_CTE = f"""RECURSIVE {_ANCHORS}, d AS (SELECT r.*, CAST(floor(epoch(g.anchor_at)) AS BIGINT) AS date_key FROM ({_RDOCS}) r JOIN g USING (doc_id)), o AS ({' UNION ALL '.join(f"SELECT patient_id, doc_id, uploaded_at, {i} AS rank, '{k}' AS kind, CAST({c} AS STRING) AS member FROM d WHERE {c} IS NOT NULL" for i, (k, c) in enumerate(_KINDS.items()))}),
   rel AS (SELECT patient_id, kind, member, count(*) AS n, min(uploaded_at) AS first_at, max(uploaded_at) AS last_at FROM o GROUP BY ALL HAVING count(*) > 1)"""


@query(
    "document_relationships",
    f"""WITH {_REL_CTE} SELECT *, CASE kind WHEN 'encounter' THEN 0.9 WHEN 'visit' THEN 0.8 WHEN 'provider' THEN 0.7 WHEN 'date_proximity' THEN 0.6 ELSE 0.5 END::DOUBLE AS score FROM rel""",
)
def _(t):
    return T.relationships(T.with_date_groups(t.sql(_RDOCS)), _KINDS)


@query(
    "processing_order",
    f"""WITH {_REL_CTE}, b AS (SELECT doc_id, o.patient_id, kind || ':' || member AS group_key FROM o JOIN rel USING (patient_id, kind, member)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank) = 1),
        x AS (SELECT d.patient_id, d.doc_id, coalesce(group_key, '') AS group_key FROM d LEFT JOIN b USING (doc_id))
        SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY group_key = '', group_key, doc_id) AS place FROM x""",
)
def _(t):
    return T.processing_order(T.with_date_groups(t.sql(_RDOCS)), _KINDS)


@query(
    "stuck_documents",
    """SELECT doc_id, CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS new_status, attempts + CASE WHEN attempts < 3 THEN 1 ELSE 0 END AS attempts,
         CASE WHEN attempts < 3 THEN 'Re-queued after processing timeout' ELSE 'Processing timed out after multiple attempts' END AS message
       FROM pipeline WHERE status IN ('processing', 'ocr_pending') AND uploaded_at < TIMESTAMP '2024-01-20 11:45:00'""",
)
def _(t):
    return T.stuck_documents(t.pipeline, "2024-01-20 12:00:00")


@query(
    "primary_diagnosis",
    """SELECT patient_id, condition_id, name, count(*) OVER (PARTITION BY patient_id) - 1 AS comorbidities FROM conditions WHERE status = 'active'
       QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY updated_at, condition_id) = 1""",
)
def _(t):
    return T.primary_diagnosis(t.conditions)
