"""Queries for aggregations and metrics."""

from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators import metrics as M
from chartmill.operators.ordered import numbered
from chartmill.plans.catalog import query
from chartmill.plans.queries_scalar import (
    ABNORMAL_SQL, ERR_SEVERITY_SQL, ERR_STRATEGY_SQL, LABEL_CATEGORY_SQL, LIVE_SQL, STAGE_SQL,
)
from chartmill.plans.sqltext import PRICED, case_contains, case_map, half, pct, words


def _usage(t):
    return M.usage_rows(t.usage_log)


@query(
    "bundle_summary",
    """SELECT patient_id, resource_type, count(*) AS n, max(updated_at) AS last_updated FROM resources GROUP BY ALL""",
)
def _(t):
    return M.bundle_summary(t.resources)


_ITEMS = "SELECT doc_id, {} AS category FROM fields".format(LABEL_CATEGORY_SQL.replace("'other_fields'", "'observations'"))
_CAPTURE = """items AS ({items}), n AS (SELECT category, count(*) AS extracted FROM items {where} GROUP BY 1),
   r AS (SELECT resource_type, count(*) AS captured FROM resources {rwhere} GROUP BY 1),
   m AS (SELECT category, extracted, {map} AS resource_type FROM n),
   c AS (SELECT m.category, m.resource_type, extracted, coalesce(captured, 0) AS captured, {rate} AS rate
         FROM m LEFT JOIN r USING (resource_type) WHERE m.resource_type IS NOT NULL)"""


def _capture_sql(where="", rwhere="", name="c"):
    return _CAPTURE.format(
        items=_ITEMS, where=where, rwhere=rwhere, map=case_map("category", fixed.CATEGORY_RESOURCE),
        rate=pct("coalesce(captured, 0)", "extracted", 4),
    )


def _items(t):
    category = S.label_category(F.col("label"))
    return t.fields.select("doc_id", F.when(category == "other_fields", "observations").otherwise(category).alias("category"))


@query("capture_metrics", f"WITH {_capture_sql()} SELECT * FROM c")
def _(t):
    return M.capture_metrics(_items(t), t.resources)


@query(
    "capture_overall",
    f"""WITH {_capture_sql()} SELECT CAST(sum(extracted) AS BIGINT) AS total, CAST(sum(captured) AS BIGINT) AS captured,
         {pct('sum(captured)', 'sum(extracted)', 4)} AS rate,
         coalesce({half("avg(rate) FILTER (category IN ('medications', 'conditions', 'diagnostic_reports'))", 4)}, 0) AS completeness,
         count(*) FILTER (rate >= 90) AS high, count(*) FILTER (rate < 50) AS low,
         (SELECT count(DISTINCT resource_type) FROM resources) AS diversity FROM c""",
)
def _(t):
    return M.capture_overall(M.capture_metrics(_items(t), t.resources), t.resources)


@query(
    "capture_improvement",
    f"""WITH {_capture_sql('WHERE doc_id % 2 = 0', 'WHERE patient_id % 2 = 0')},
        c1 AS (SELECT * FROM c), {_capture_sql('WHERE doc_id % 2 = 1', '').replace('items AS', 'items2 AS').replace('FROM items ', 'FROM items2 ').replace(' n AS', ' n2 AS').replace('FROM n)', 'FROM n2)').replace(' r AS', ' r2 AS').replace('JOIN r ', 'JOIN r2 ').replace(' m AS', ' m2 AS').replace('FROM m ', 'FROM m2 m ').replace(' c AS', ' c2 AS')},
        j AS (SELECT category, c1.rate AS b, c2.rate AS a FROM c1 FULL JOIN c2 USING (category))
        SELECT category, coalesce(b, 0) AS before_rate, coalesce(a, 0) AS after_rate, {half('coalesce(a, 0) - coalesce(b, 0)', 4)} AS improvement,
          CASE WHEN b IS NULL THEN 'new' WHEN coalesce(a, 0) - b > 5 THEN 'improved' WHEN coalesce(a, 0) - b < -5 THEN 'declined' ELSE 'stable' END AS verdict FROM j""",
)
def _(t):
    items = _items(t)
    before = M.capture_metrics(items.filter("doc_id % 2 = 0"), t.resources.filter("patient_id % 2 = 0"))
    after = M.capture_metrics(items.filter("doc_id % 2 = 1"), t.resources)
    return M.capture_improvement(before, after)


def _avg1(col):
    return f"coalesce({half(f'avg({col})', 1)}, 0) AS {col}"


@query(
    "stage_timings",
    f"""SELECT {', '.join(_avg1(c) for c in ['queue_wait_ms', 'pdf_ms', 'ai_ms', 'fhir_ms', 'total_ms'])} FROM pipeline
        WHERE status = 'completed' AND processed_at >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def _(t):
    return M.stage_timings(M.since(t.pipeline, "processed_at", "2024-01-30 00:00:00", 480))


@query(
    "hourly_throughput",
    """SELECT date_trunc('hour', processed_at) AS hour, count(*) FILTER (status = 'completed') AS completed,
              count(*) FILTER (status = 'failed') AS failed FROM pipeline WHERE status IN ('completed', 'failed') GROUP BY 1""",
)
def _(t):
    return M.hourly_throughput(t.pipeline)


@query(
    "success_rates",
    f"""SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (status IN ('pending', 'ocr_pending', 'processing')) AS in_progress, count(*) FILTER (status = 'pending') AS queue_active,
          count(*) FILTER (status IN ('ocr_pending', 'processing')) AS pdf_active, count(*) FILTER (status = 'processing') AS ai_active,
          {pct("count(*) FILTER (status = 'completed')", "count(*) FILTER (status IN ('completed', 'failed'))")} AS success_rate FROM pipeline""",
)
def _(t):
    return M.success_rates(t.pipeline)


@query(
    "live_documents",
    f"""SELECT doc_id, uploaded_at, {LIVE_SQL} AS stage FROM pipeline WHERE status IN ('pending', 'ocr_pending', 'processing')
        ORDER BY uploaded_at DESC, doc_id DESC LIMIT 50""",
)
def _(t):
    return M.live_documents(t.pipeline, 50)


@query("stage_counts", f"SELECT {STAGE_SQL} AS stage, count(*) AS n FROM pipeline GROUP BY 1")
def _(t):
    return M.stage_counts(t.pipeline)


@query(
    "cost_by_provider",
    f"""WITH {PRICED}, p AS (SELECT provider, sum(cost) AS total, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens FROM priced GROUP BY 1)
        SELECT provider, CAST(total AS DOUBLE) AS total_cost, calls, tokens,
          {half("(SELECT sum(total) FROM p)::DOUBLE / (SELECT count(*) FROM pipeline WHERE status = 'completed')", 4)} AS avg_cost_per_document FROM p""",
)
def _(t):
    return M.cost_by_provider(_usage(t), t.pipeline)


@query(
    "dashboard_summary",
    f"""WITH {PRICED}, c AS (SELECT CAST(sum(cost) AS DOUBLE) AS cost FROM priced),
        d AS (SELECT count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed,
          {pct("count(*) FILTER (status = 'completed')", "count(*) FILTER (status IN ('completed', 'failed'))")} AS success_rate,
          {half("avg(total_ms) FILTER (status = 'completed') / 1000", 1)} AS pipeline_seconds,
          {half("avg(ai_ms) FILTER (status = 'completed') / 1000", 1)} AS ai_seconds FROM pipeline)
        SELECT d.*, c.cost, {half('cost / processed', 4)} AS cost_per_document FROM d, c""",
)
def _(t):
    return M.dashboard_summary(t.pipeline, _usage(t))


_TOTALS = f"""count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
   CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cost) AS DOUBLE) AS cost, {half('avg(duration_ms)', 4)} AS avg_duration_ms,
   {pct('count(*) FILTER (success)', 'count(*)', 4)} AS success_rate"""

for _name, _keys in {
    "usage_overall": [], "usage_by_model": ["provider", "model"], "usage_by_patient": ["patient_id"],
    "usage_by_session": ["session_id"], "usage_by_document": ["doc_id"],
}.items():
    query(_name, f"WITH {PRICED} SELECT {''.join(k + ', ' for k in _keys)}{_TOTALS} FROM priced {'GROUP BY ' + ', '.join(_keys) if _keys else ''}")(
        lambda t, keys=_keys: M.usage_totals(_usage(t), *keys)
    )


@query("usage_by_day", f"WITH {PRICED} SELECT CAST(started_at AS DATE) AS day, {_TOTALS} FROM priced GROUP BY 1")
def _(t):
    return M.usage_totals(_usage(t).withColumn("day", F.to_date("started_at")), "day")


@query("usage_scope", "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT patient_id) AS patients FROM usage_log")
def _(t):
    return M.usage_scope(t.usage_log)


@query(
    "cost_suggestions",
    f"""WITH {PRICED}, r AS (SELECT provider, model, avg(CAST(cost AS DOUBLE) / (input_tokens + output_tokens)) AS rate FROM priced WHERE input_tokens + output_tokens > 0 GROUP BY ALL),
        c AS (SELECT provider, model, count(*) AS calls, {pct('count(*) FILTER (NOT success)', 'count(*)', 4)} AS failure_rate FROM priced GROUP BY ALL)
        SELECT provider, model, calls, failure_rate, round(rate, 8) AS rate,
          (SELECT min({{'rate': rate, 'provider': provider, 'model': model}}) FROM r).model = model AS cheapest,
          (SELECT max({{'rate': rate, 'provider': provider, 'model': model}}) FROM r).model = model AS dearest,
          CASE WHEN failure_rate > 25 THEN 'high' WHEN failure_rate > 10 THEN 'medium' END AS concern FROM c LEFT JOIN r USING (provider, model)""",
)
def _(t):
    return M.cost_suggestions(_usage(t))


@query(
    "spend_breach_document",
    f"""WITH {PRICED}, run AS (SELECT doc_id, call_id, started_at, sum(cost) OVER (PARTITION BY doc_id ORDER BY started_at, call_id ROWS UNBOUNDED PRECEDING) AS spent FROM priced)
        SELECT doc_id, call_id, CAST(spent AS DOUBLE) AS spent FROM run WHERE spent >= 0.05
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY started_at, call_id) = 1""",
)
def _(t):
    out = M.spend_breach(_usage(t), ["doc_id"], "0.05")
    return out.select("doc_id", "call_id", F.col("spent").cast("double").alias("spent"))


@query(
    "spend_breach_day",
    f"""WITH {PRICED}, run AS (SELECT CAST(started_at AS DATE) AS day, call_id, started_at, sum(cost) OVER (PARTITION BY CAST(started_at AS DATE) ORDER BY started_at, call_id ROWS UNBOUNDED PRECEDING) AS spent FROM priced)
        SELECT day, call_id, CAST(spent AS DOUBLE) AS spent FROM run WHERE spent >= 0.5
        QUALIFY row_number() OVER (PARTITION BY day ORDER BY started_at, call_id) = 1""",
)
def _(t):
    usage = _usage(t).withColumn("day", F.to_date("started_at"))
    out = M.spend_breach(usage, ["day"], "0.5")
    return out.select("day", "call_id", F.col("spent").cast("double").alias("spent"))


@query(
    "partial_completion",
    """SELECT doc_id, count(*) AS total, count(*) FILTER (success) AS succeeded,
          CASE WHEN count(*) FILTER (success) / count(*) < 0.85 THEN 'failed' WHEN count(*) FILTER (success) < count(*) THEN 'flagged' ELSE 'complete' END AS outcome
       FROM usage_log GROUP BY 1""",
)
def _(t):
    return M.partial_completion(t.usage_log, fixed.PARTIAL_THRESHOLD)


@query(
    "latest_document_costs",
    f"""WITH {PRICED}, n AS (SELECT doc_id, processed_at FROM pipeline WHERE status = 'completed' ORDER BY processed_at DESC, doc_id DESC LIMIT 20)
        SELECT n.doc_id, n.processed_at, coalesce((SELECT CAST(sum(cost) AS DOUBLE) FROM priced p WHERE p.doc_id = n.doc_id), 0) AS cost FROM n""",
)
def _(t):
    return M.latest_costs(t.pipeline, _usage(t), 20)


@query(
    "error_summary",
    f"""WITH e AS (SELECT error_type, component, {ERR_SEVERITY_SQL} AS severity, {ERR_STRATEGY_SQL} AS strategy FROM error_log)
        SELECT 'type' AS dimension, error_type AS member, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'component', component, count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'strategy', strategy, count(*) FROM e GROUP BY 2""",
)
def _(t):
    return M.error_summary(t.error_log)


@query(
    "component_health",
    f"""SELECT component, CASE WHEN bool_or({ERR_SEVERITY_SQL} = 'critical') THEN 'critical' WHEN bool_or({ERR_SEVERITY_SQL} = 'error') THEN 'degraded' ELSE 'healthy' END AS health,
          max(ts) AS last_check FROM error_log GROUP BY 1""",
)
def _(t):
    return M.component_health(t.error_log)


_RESETS = "SELECT component, ts AS reset_at FROM error_log WHERE error_id % 7 = 0 AND component <> 'pdf' UNION ALL SELECT 'queue', max(ts) FROM error_log"
_WINDOW = "ts >= (SELECT max(ts) FROM error_log) - INTERVAL '240' HOUR"


@query(
    "error_window_summary",
    f"""WITH e AS (SELECT error_type, component, {ERR_SEVERITY_SQL} AS severity, {ERR_STRATEGY_SQL} AS strategy FROM error_log WHERE {_WINDOW}), n AS (
        SELECT 'type' AS dimension, error_type AS member, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'component', component, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM e GROUP BY 2
        UNION ALL SELECT 'strategy', strategy, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM e UNION ALL SELECT 'critical', 'all', count(*) FILTER (severity = 'critical') FROM e)
        SELECT *, {half('n / 240.0::DOUBLE', 4)} AS per_hour FROM n""",
)
def _(t):
    errors = t.error_log
    return M.error_window(errors, F.lit(errors.agg(F.max("ts")).first()[0]), 240)


@query("recent_critical_errors", f"SELECT error_id, ts, error_type, message, component FROM error_log WHERE {_WINDOW} AND {ERR_SEVERITY_SQL} = 'critical'")
def _(t):
    errors = t.error_log
    return M.critical_errors(errors, F.lit(errors.agg(F.max("ts")).first()[0]), 240)


@query(
    "component_health_since_reset",
    f"""WITH l AS (SELECT component, max(reset_at) AS reset_at FROM ({_RESETS}) GROUP BY 1), w AS (
          SELECT e.component, max(CASE {ERR_SEVERITY_SQL} WHEN 'critical' THEN 2 WHEN 'error' THEN 1 ELSE 0 END) AS worst, max(ts) AS seen FROM error_log e LEFT JOIN l USING (component) WHERE reset_at IS NULL OR ts > reset_at GROUP BY 1)
        SELECT component, CASE worst WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS health, coalesce(seen, reset_at) AS last_check, reset_at FROM w FULL JOIN l USING (component)""",
)
def _(t):
    return M.component_health_since(t.error_log, t.sql(_RESETS))


_OPS = """SELECT event_id AS op_id, ts AS started_at, value AS seconds, value * 2 AS memory_mb, CAST(event_id % 10 AS DOUBLE) / 10 AS hit_ratio,
   event_id % 7 AS resources, event_id % 50 AS db_queries, event_id % 3 AS errors FROM events"""


@query(
    "operation_alerts",
    f"""WITH ops AS ({_OPS}), a AS (SELECT op_id, concat_ws(',', CASE WHEN seconds > 30 THEN 'slow' END, CASE WHEN memory_mb > 100 THEN 'memory' END,
          CASE WHEN hit_ratio < 0.7 THEN 'cache' END, CASE WHEN resources > 0 AND db_queries / resources > 5 THEN 'queries' END,
          CASE WHEN resources > 0 AND errors / resources > 0.05 THEN 'errors' END) AS alerts FROM ops) SELECT * FROM a WHERE alerts <> ''""",
)
def _(t):
    return M.operation_alerts(t.sql(_OPS))


@query(
    "operation_summary",
    f"""WITH ops AS ({_OPS}) SELECT count(*) AS operations, {half('sum(CAST(seconds AS DECIMAL(18,2)))::DOUBLE / count(*)', 4)} AS avg_seconds, max(seconds) AS max_seconds,
          CAST(sum(resources) AS BIGINT) AS resources, {half('sum(CAST(hit_ratio AS DECIMAL(18,1)))::DOUBLE / count(*)', 4)} AS avg_hit_ratio,
          CAST(sum(db_queries) AS BIGINT) AS db_queries, CAST(sum(errors) AS BIGINT) AS errors, {half('sum(errors) / sum(resources)', 6)} AS error_rate FROM ops""",
)
def _(t):
    return M.operation_summary(t.sql(_OPS))


@query(
    "operations_per_hour",
    f"""WITH {PRICED} SELECT date_trunc('hour', started_at) AS hour, count(*) AS operations, {half('avg(duration_ms)', 4)} AS avg_duration_ms,
          {pct('count(*) FILTER (success)', 'count(*)', 4)} AS success_rate, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
          {half('CAST(sum(cost) AS DOUBLE) / count(*)', 6)} AS avg_cost FROM priced GROUP BY 1""",
)
def _(t):
    return M.operations_per_hour(_usage(t))


_CONF = f"""count(*) AS n, {half('avg(confidence)', 3)} AS avg_confidence, count(*) FILTER (confidence >= 0.8) AS high,
   count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (confidence >= 0.3 AND confidence < 0.5) AS low,
   count(*) FILTER (confidence < 0.3) AS very_low, {pct('count(*) FILTER (confidence >= 0.8)', 'count(*)')} AS quality_score,
   min(confidence) AS min_confidence, max(confidence) AS max_confidence"""


@query("mean_confidence_by_document", f"SELECT doc_id, {_CONF} FROM fields GROUP BY 1")
def _(t):
    return M.confidence_stats(t.fields, "doc_id")


@query("extraction_quality", f"SELECT {_CONF} FROM fields")
def _(t):
    return M.confidence_stats(t.fields)


@query(
    "comparison_progress",
    f"""WITH c AS (SELECT doc_id, confidence < 0.7 AS different, ord % 3 = 0 AS resolved, {case_contains('lower(label)', fixed.COMPARISON_CATEGORIES, "'other'")} AS category FROM fields)
        SELECT doc_id, {pct('count(*) FILTER (resolved)', 'count(*)')} AS completion, count(*) FILTER (different AND NOT resolved) AS unresolved,
          count(*) FILTER (different AND category = 'demographics') AS demographics, count(*) FILTER (different AND category = 'contact_info') AS contact_info,
          count(*) FILTER (different AND category = 'medical_info') AS medical_info, count(*) FILTER (different AND category = 'other') AS other FROM c GROUP BY 1""",
)
def _(t):
    rows = t.fields.selectExpr("doc_id", "label AS field", "confidence < 0.7 AS different", "ord % 3 = 0 AS resolved")
    return M.comparison_progress(rows)


@query(
    "field_change_analytics",
    f"""SELECT field_name, count(*) AS changes, {half('avg(confidence)', 6)} AS avg_confidence, {half('avg(quality)', 6)} AS avg_quality,
          count(DISTINCT patient_id) AS patients, count(DISTINCT reviewer) AS reviewers FROM field_audit
        WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY 1""",
)
def _(t):
    return M.field_change_analytics(M.since(t.field_audit, "created_at", "2024-02-04 00:00:00", 30 * 24))


@query(
    "reviewer_activity",
    """SELECT reviewer, change_id, created_at, field_name, row_number() OVER (PARTITION BY reviewer ORDER BY created_at DESC, change_id) AS place
       FROM field_audit""",
)
def _(t):
    out = numbered(t.field_audit, ["reviewer"], [F.desc("created_at"), F.col("change_id")])
    return out.select("reviewer", "change_id", "created_at", "field_name", "place")


@query(
    "code_statistics",
    """SELECT resource_type AS kind, count(*) AS codes, count(DISTINCT patient_id) AS patients, count(DISTINCT code) AS distinct_codes FROM resources GROUP BY 1""",
)
def _(t):
    return M.code_statistics(t.resources.withColumnRenamed("resource_type", "kind"))


@query(
    "labs_by_category",
    """SELECT patient_id, category, obs_id, effective_at, place FROM (
         SELECT patient_id, obs_id, effective_at, CASE loinc """
    + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in fixed.LOINC_CATEGORY.items())
    + """ ELSE 'Other' END AS category, row_number() OVER (PARTITION BY patient_id, category ORDER BY effective_at DESC, obs_id) AS place FROM observations)""",
)
def _(t):
    rows = t.observations.select("patient_id", S.lab_category(F.col("loinc")).alias("category"), "obs_id", "effective_at")
    return numbered(rows, ["patient_id", "category"], [F.desc("effective_at"), F.col("obs_id")])


@query(
    "abnormal_summary",
    f"""WITH r AS (SELECT patient_id, {ABNORMAL_SQL} AS result FROM results)
        SELECT patient_id, count(*) FILTER (result = 'critical') AS critical, count(*) FILTER (result IN ('low', 'high')) AS abnormal,
          count(*) FILTER (result = 'normal') AS normal FROM r GROUP BY 1""",
)
def _(t):
    r = S.abnormal_result(F.col("flag"), F.col("value"), F.col("low"), F.col("high"))
    return M.abnormal_summary(t.results.select("patient_id", r.alias("result")), "patient_id")


_MED_CLASS = case_contains("lower(name)", [(c, [d]) for d, c in fixed.CLASS_OF_DRUG], "'Other'")


@query(
    "medication_summary",
    rf"""WITH m AS (SELECT patient_id, status, {_MED_CLASS} AS cls, trim(regexp_replace(lower(name), '\b(capsule|inhaler)\b', '', 'g')) AS drug FROM medications),
         d AS (SELECT patient_id, drug, count(*) AS a FROM m WHERE status = 'active' GROUP BY ALL),
         p AS (SELECT patient_id, sum(a * (a - 1) // 2) AS pairs FROM d GROUP BY 1)
         SELECT m.patient_id, count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status <> 'active') AS inactive,
           count(DISTINCT cls) AS classes, CAST(coalesce(any_value(pairs), 0) AS BIGINT) AS duplicate_pairs FROM m LEFT JOIN p ON p.patient_id = m.patient_id GROUP BY 1""",
)
def _(t):
    return M.medication_summary(t.medications, "patient_id")


@query(
    "medications_by_class",
    f"""WITH m AS (SELECT patient_id, {_MED_CLASS} AS drug_class, status, name FROM medications)
        SELECT patient_id, drug_class, count(*) AS n, min({case_map('status', fixed.MEDICATION_STATUS_ORDER, '9')}) AS best_status FROM m GROUP BY ALL""",
)
def _(t):
    order = S.lookup(F.col("status"), fixed.MEDICATION_STATUS_ORDER, 9)
    return t.medications.groupBy("patient_id", S.therapeutic_class(F.col("name")).alias("drug_class")).agg(
        F.count("*").alias("n"), F.min(order).alias("best_status")
    )


TIMELINE_ROWS = f"""SELECT encounter_id, patient_id, {case_map('enc_class', fixed.TIMELINE_KIND_OF_CLASS, "'encounter'")} AS kind, status,
   CASE WHEN encounter_id % 13 <> 0 THEN visit_date END AS start_date,
   CASE WHEN encounter_id % 4 = 0 THEN visit_date + CAST(encounter_id % 9 AS INT) END AS end_date FROM encounters"""


@query(
    "timeline_summary",
    f"""WITH e AS ({TIMELINE_ROWS}), x AS (SELECT *, CASE WHEN start_date IS NULL THEN NULL WHEN end_date IS NULL THEN 1 ELSE greatest(1, end_date - start_date) END AS days FROM e)
        SELECT patient_id, count(*) AS events, count(*) FILTER (kind = 'admission') AS admissions, count(*) FILTER (kind = 'emergency') AS emergencies,
          least(min(start_date), min(end_date)) AS first_date, greatest(max(start_date), max(end_date)) AS last_date,
          CAST(coalesce(greatest(max(start_date), max(end_date)) - least(min(start_date), min(end_date)), 0) AS INT) AS range_days,
          CAST(coalesce(sum(days) FILTER (kind = 'admission'), 0) AS BIGINT) AS inpatient_days FROM x GROUP BY 1""",
)
def _(t):
    return M.timeline_summary(t.sql(TIMELINE_ROWS), "patient_id")


@query("specialty_counts", "SELECT specialty, count(*) AS n FROM providers GROUP BY 1 ORDER BY n DESC, specialty LIMIT 5")
def _(t):
    return M.specialty_counts(t.providers)


@query(
    "directory_statistics",
    """WITH s AS (SELECT specialty, count(*) AS n FROM providers GROUP BY 1)
       SELECT (SELECT count(*) FROM providers) AS providers, (SELECT count(DISTINCT organization) FROM providers) AS organizations,
         count(*) AS specialties, (SELECT specialty FROM s ORDER BY n DESC, specialty DESC LIMIT 1) AS largest, max(n) AS largest_count FROM s""",
)
def _(t):
    return M.directory_statistics(t.providers)


@query(
    "history_statistics",
    """SELECT patient_id, change_type, count(*) AS n, max(created_at) AS last_change FROM field_audit GROUP BY ALL""",
)
def _(t):
    return t.field_audit.groupBy("patient_id", "change_type").agg(F.count("*").alias("n"), F.max("created_at").alias("last_change"))


@query(
    "upload_statistics",
    """SELECT uploaded_by, count(*) AS documents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
          count(*) FILTER (status IN ('pending', 'ocr_pending', 'processing')) AS running, count(DISTINCT patient_id) AS patients FROM pipeline GROUP BY 1""",
)
def _(t):
    s = F.col("status")
    return t.pipeline.groupBy("uploaded_by").agg(
        F.count("*").alias("documents"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s.isin(fixed.LIVE_STATUSES)).alias("running"), F.countDistinct("patient_id").alias("patients"),
    )


@query(
    "compliance_report",
    f"""WITH a AS (SELECT date_trunc('month', logged_at) AS period, phi_involved OR regexp_matches(path, '/(patients|documents|fhir|reports)/') AS phi,
          contains(lower(path), 'login') AND NOT success AS failed_login, severity = 'critical' AND NOT success AS violation FROM audit_log)
        SELECT period, count(*) AS events, count(*) FILTER (phi) AS phi_access, count(*) FILTER (failed_login) AS failed_logins,
          count(*) FILTER (violation) AS violations, {pct('count(*) FILTER (NOT violation)', 'count(*)', 2)} AS score FROM a GROUP BY 1""",
)
def _(t):
    return M.compliance_report(t.audit_log)


def _panel_sql():
    steps, prev = [], "p0"
    for i, (name, _, minimum, kw) in enumerate(fixed.LAB_PANELS):
        hit = f"panel IS NULL AND {words('test_name', kw)}"
        steps.append(f"q{i} AS (SELECT *, count(*) FILTER ({hit}) OVER (PARTITION BY patient_id) AS c{i} FROM {prev})")
        steps.append(f"p{i + 1} AS (SELECT * REPLACE (CASE WHEN {hit} AND c{i} >= {minimum} THEN '{name}' ELSE panel END AS panel) FROM q{i})")
        prev = f"p{i + 1}"
    codes = {name: code for name, code, _, _ in fixed.LAB_PANELS}
    return f"""WITH p0 AS (SELECT patient_id, obs_id, test_name, effective_date, flag = 'R' AS flagged, CASE WHEN code_id % 9 = 0 THEN 'Lipid Panel' END AS panel FROM observations),
      {', '.join(steps)}, g AS (SELECT patient_id, coalesce(panel, '{fixed.OTHER_PANEL}') AS panel, count(*) AS results, count(*) FILTER (flagged) AS flagged, min(effective_date) AS effective_date FROM {prev} GROUP BY ALL)
      SELECT *, {case_map('panel', codes)} AS loinc, panel || ': ' || results || ' result(s)' || CASE WHEN flagged > 0 THEN ', ' || flagged || ' flagged' ELSE '' END AS conclusion FROM g"""


@query("lab_panels", _panel_sql())
def _(t):
    rows = t.observations.selectExpr(
        "patient_id", "test_name", "effective_date", "flag = 'R' AS flagged", "CASE WHEN code_id % 9 = 0 THEN 'Lipid Panel' END AS stated_panel"
    )
    return M.lab_panels(rows, "patient_id")


@query("fields_by_category", f"SELECT doc_id, {LABEL_CATEGORY_SQL} AS category, count(*) AS n, max(length(value)) AS longest FROM fields GROUP BY ALL")
def _(t):
    return t.fields.groupBy("doc_id", S.label_category(F.col("label")).alias("category")).agg(
        F.count("*").alias("n"), F.max(F.length("value")).cast("bigint").alias("longest")
    )


@query(
    "fill_counts",
    """SELECT 'date_text' AS column_name, count(date_text) AS filled, count(*) AS total FROM encounters
       UNION ALL SELECT 'location', count(nullif(location, '')), count(*) FROM encounters UNION ALL SELECT 'status', count(status), count(*) FROM encounters""",
)
def _(t):
    rows = t.encounters.withColumn("location", F.expr("nullif(location, '')"))
    return M.fill_counts(rows, "date_text", "location", "status")


@query("rows_per_day", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM field_audit GROUP BY 1")
def _(t):
    return t.field_audit.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
