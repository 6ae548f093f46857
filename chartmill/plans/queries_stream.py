"""Streaming queries: the events file is read as a stream, run to its end and
compared with the batch result of the same rule."""

from pyspark.sql import functions as F

from chartmill.plans.catalog import query
from chartmill.plans.queries_scalar import ERR_SEVERITY_SQL, STAGE_SQL
from chartmill.plans.roles import ROLES
from chartmill.plans.sqltext import PRICED
from chartmill.functions import scalar as S
from chartmill.session import shared_folder
from chartmill.streaming import buckets as BK
from chartmill.streaming import jobs as J
from chartmill.streaming import state as ST

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def stream(t, role):
    """A role over the events stream."""
    events = t.spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return t.spark.sql(ROLES[role].replace("FROM events", "FROM {events}"), events=events)


def final(t, frame, mode, name, keys):
    out = J.run_to_folder(frame, f"{shared_folder(t.spark)}/{name}-{t.run_id()}", mode, name)
    return J.newest_rows(t.spark, out, keys)


@query(
    "stream_latest_stage",
    f"""WITH s AS (SELECT patient_id AS doc_id, uploaded_at AS ts, doc_id AS event_id, {STAGE_SQL} AS stage FROM pipeline)
        SELECT doc_id, arg_max(stage, {{'t': ts, 'e': event_id}}) AS stage FROM s GROUP BY 1""",
)
def _(t):
    rows = stream(t, "pipeline").select(
        F.col("patient_id").alias("doc_id"), F.col("doc_id").alias("event_id"), F.col("uploaded_at").alias("ts"), S.stage_key(F.col("status"), F.col("message")).alias("stage")
    )
    return final(t, J.latest_stage(rows), "update", "latest_stage", ["doc_id"]).select("doc_id", "stage")


@query(
    "stream_throughput",
    "SELECT date_trunc('hour', uploaded_at) AS hour, status, count(*) AS n FROM pipeline WHERE status IN ('completed', 'failed') GROUP BY ALL",
)
def _(t):
    rows = stream(t, "pipeline").withColumnRenamed("uploaded_at", "ts")
    return final(t, J.throughput(rows), "update", "throughput", ["hour", "status"])


@query(
    "stream_error_rate",
    """SELECT date_trunc('minute', ts) - INTERVAL '1' MINUTE * i AS window_start, count(*) / 5 AS per_minute FROM error_log, range(5) AS r(i) GROUP BY 1""",
)
def _(t):
    return final(t, J.error_rate(stream(t, "error_log")), "update", "error_rate", ["window_start"])


@query(
    "stream_alerts",
    f"""WITH RECURSIVE e AS (SELECT component AS scope, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n, count(*) FILTER ({ERR_SEVERITY_SQL} = 'critical') AS c FROM error_log GROUP BY 1, 2),
       r AS (SELECT scope, s, sum(n) OVER (PARTITION BY scope ORDER BY s RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) / 5.0 AS rate, sum(c) OVER (PARTITION BY scope ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS critical FROM e),
       o AS (SELECT scope, 'high_error_rate' AS alert, s, CAST(rate AS DOUBLE) AS amount FROM r WHERE rate > 0.1 UNION ALL SELECT scope, 'critical_errors', s, CAST(critical AS DOUBLE) FROM r WHERE critical > 1),
       a AS (SELECT scope, alert, min(s) AS s FROM o GROUP BY 1, 2
             UNION ALL SELECT a.scope, a.alert, (SELECT min(o.s) FROM o WHERE o.scope = a.scope AND o.alert = a.alert AND o.s >= a.s + 300) FROM a WHERE a.s IS NOT NULL)
       SELECT scope, make_timestamp(s * 1000000) AS at, alert, amount FROM a JOIN o USING (scope, alert, s)""",
)
def _(t):
    ST.use_state_store(t.spark)
    errors = stream(t, "error_log").select(F.col("component").alias("scope"), "ts", "error_type")
    out = ST.run_until_settled(ST.alerts(errors, 0.1, 1), f"{shared_folder(t.spark)}/alerts-{t.run_id()}", "alerts")
    return t.spark.read.parquet(out).select("scope", "at", "alert", "amount")


_DOCUMENT_EVENTS = "SELECT patient_id AS doc_id, doc_id AS event_id, uploaded_at AS ts, status, attempts FROM pipeline"
_STUCK = """WITH n AS (SELECT patient_id AS doc_id, uploaded_at AS last_event, status, attempts, row_number() OVER (PARTITION BY patient_id ORDER BY uploaded_at DESC, doc_id DESC) AS place FROM pipeline)
    SELECT doc_id, status, last_event, attempts, CASE WHEN attempts < 3 THEN 'requeue' ELSE 'fail' END AS action FROM n WHERE place = 1 AND status IN ('processing', 'ocr_pending')"""


@query("stream_stuck_documents", _STUCK)
def _(t):
    """The timers fire on the clock, behind the last event."""
    ST.use_state_store(t.spark)
    rows = stream(t, "pipeline").select(F.col("patient_id").alias("doc_id"), F.col("doc_id").alias("event_id"), F.col("uploaded_at").alias("ts"), "status", "attempts")
    out = ST.run_until_settled(ST.watchdog(rows), f"{shared_folder(t.spark)}/watch-{t.run_id()}", "watch")
    return t.spark.read.parquet(out).select("doc_id", "status", "last_event", "attempts", "action")


@query("stuck_documents_snapshot", f"{_STUCK} AND last_event + INTERVAL '15' MINUTE <= (SELECT max(uploaded_at) FROM pipeline)")
def _(t):
    events = t.sql(_DOCUMENT_EVENTS)
    now = events.agg(F.max("ts")).first()[0]
    return ST.stuck_at(events, str(now))


@query("stream_first_deliveries")
def _(t):
    rows = stream(t, "usage_log").select(F.col("doc_id"), F.col("started_at").alias("ts"))
    out = J.run_to_folder(J.first_deliveries(rows), f"{shared_folder(t.spark)}/once-{t.run_id()}", "append", "once")
    return t.spark.read.parquet(out).select("doc_id", "ts")


@query(
    "stream_session_usage",
    f"WITH {PRICED} SELECT session_id, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1",
)
def _(t):
    out = final(t, J.session_usage(stream(t, "usage_log")), "update", "sessions", ["session_id"])
    return out.withColumn("cost", F.col("cost").cast("double"))


@query(
    "stream_daily_spend",
    f"WITH {PRICED} SELECT date_trunc('day', started_at) AS day, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1 HAVING sum(cost) >= 0.5",
)
def _(t):
    out = final(t, J.spend_over_limit(stream(t, "usage_log"), "0.5"), "update", "spend", ["day"])
    return out.withColumn("cost", F.col("cost").cast("double"))


@query(
    "stream_document_merge",
    """SELECT user_id AS patient_id, count(*) AS n FROM events GROUP BY 1""",
)
def _(t):
    rows = stream(t, "usage_log").select(F.col("session_id").alias("patient_id"), F.col("call_id").alias("source_id"), "model")
    folder = f"{shared_folder(t.spark)}/merge-{t.run_id()}"
    # the second run has a new checkpoint and delivers every document again
    for run in ("first", "second"):
        J.merge_stream(rows, f"{folder}/store", f"{folder}/{run}")
    return J.store_rows(t.spark, f"{folder}/store", ["patient_id", "source_id"]).groupBy("patient_id").agg(F.count("*").alias("n"))


_CALLS = """SELECT session_id AS patient_id, doc_id AS source_id, provider AS resource_type, call_id AS resource_id, model AS code, CAST(chunk_no AS STRING) AS body, started_at AS updated_at, doc_id AS part FROM usage_log"""


@query(
    "stream_bucket_merge",
    f"""WITH r AS ({_CALLS}), n AS (SELECT *, row_number() OVER (PARTITION BY patient_id, resource_type, code, body ORDER BY updated_at DESC, source_id DESC, resource_id DESC) AS place FROM r)
        SELECT patient_id, resource_type, resource_id, source_id, code, body FROM n WHERE place = 1""",
)
def _(t):
    """The documents come in three deliveries, the second of them twice under a new checkpoint."""
    folder = f"{shared_folder(t.spark)}/buckets-{t.run_id()}"
    rows = t.sql(_CALLS)
    store = BK.bundle_store(t.spark, folder)
    for turn, part in enumerate((0, 1, 1, 2)):
        rows.filter(F.col("part") % 3 == part).drop("part").write.parquet(f"{folder}/feed{turn}")
        store.follow(t.spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/feed{turn}"), f"{folder}/state{turn}")
    return store.rows().select("patient_id", "resource_type", "resource_id", "source_id", "code", "body")
