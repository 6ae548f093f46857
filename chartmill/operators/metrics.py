"""Aggregations over pipeline, usage, error and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def usage_rows(calls: DataFrame) -> DataFrame:
    """Usage row of each call: totals, completion time, cost and rates."""
    total = F.col("input_tokens") + F.col("output_tokens")
    cost = S.call_cost(F.col("provider"), F.col("model"), F.col("input_tokens"), F.col("output_tokens"))
    return (
        calls.withColumns({"total_tokens": total, "cost": cost})
        .withColumn("completed_at", F.expr("started_at + INTERVAL '0.001' SECOND * duration_ms"))
        .withColumn("tokens_per_second", F.when(F.col("duration_ms") > 0, F.col("total_tokens") * 1000.0 / F.col("duration_ms")))
        .withColumn("cost_per_token", F.when(F.col("total_tokens") > 0, F.col("cost").cast("double") / F.col("total_tokens")))
    )


def mean(column: str | Column, digits: int = 1) -> Column:
    """Average rounded half up, 0 for no rows."""
    return F.coalesce(S.half_up(F.avg(column), digits), F.lit(0.0))


def since(df: DataFrame, column: str, as_of: str, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    return df.filter(F.col(column) >= (end - F.expr(f"INTERVAL {hours} HOURS")).cast("timestamp_ntz"))


# ---------------------------------------------------------------- resources and capture
def bundle_summary(resources: DataFrame) -> DataFrame:
    """Count and newest update per patient and resource type."""
    return resources.groupBy("patient_id", "resource_type").agg(
        F.count("*").alias("n"), F.max("updated_at").alias("last_updated")
    )


def capture_metrics(extracted: DataFrame, resources: DataFrame) -> DataFrame:
    """Capture rate per category: extracted items against resources of the mapped type.

    ``extracted`` has one row per item with ``category``. Several categories
    share one resource type, so a rate may exceed 100.
    """
    from chartmill.functions import fixed

    items = extracted.groupBy("category").agg(F.count("*").alias("extracted"))
    items = items.withColumn("resource_type", S.lookup(F.col("category"), fixed.CATEGORY_RESOURCE)).filter("resource_type IS NOT NULL")
    made = resources.groupBy("resource_type").agg(F.count("*").alias("captured"))
    out = items.join(made, "resource_type", "left").withColumn("captured", F.coalesce("captured", F.lit(0)))
    return out.withColumn("rate", S.percent(F.col("captured"), F.col("extracted"), 4))


def capture_overall(metrics: DataFrame, resources: DataFrame) -> DataFrame:
    """Overall rate, completeness score, resource diversity and high/low category counts."""
    from chartmill.functions import fixed

    important = F.col("category").isin(fixed.COMPLETENESS_CATEGORIES)
    kinds = resources.agg(F.countDistinct("resource_type").alias("diversity"))
    return metrics.agg(
        F.sum("extracted").alias("total"), F.sum("captured").alias("captured"),
        S.percent(F.sum("captured"), F.sum("extracted"), 4).alias("rate"),
        F.coalesce(S.half_up(F.avg(F.when(important, F.col("rate"))), 4), F.lit(0.0)).alias("completeness"),
        F.count_if(F.col("rate") >= 90).alias("high"), F.count_if(F.col("rate") < 50).alias("low"),
    ).crossJoin(kinds)  # two single rows


def capture_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rate difference per category; verdict beyond 5 points."""
    b = before.select("category", F.col("rate").alias("before_rate"))
    a = after.select("category", F.col("rate").alias("after_rate"))
    out = b.join(a, "category", "full")
    gain = F.coalesce("after_rate", F.lit(0.0)) - F.coalesce("before_rate", F.lit(0.0))
    return out.select(
        "category", F.coalesce("before_rate", F.lit(0.0)).alias("before_rate"), F.coalesce("after_rate", F.lit(0.0)).alias("after_rate"),
        S.half_up(gain, 4).alias("improvement"),
        F.when(F.col("before_rate").isNull(), "new").when(gain > 5, "improved").when(gain < -5, "declined").otherwise("stable").alias("verdict"),
    )


# ---------------------------------------------------------------- pipeline
def stage_timings(docs: DataFrame) -> DataFrame:
    return docs.filter("status = 'completed'").agg(
        mean("queue_wait_ms").alias("queue_wait_ms"), mean("pdf_ms").alias("pdf_ms"), mean("ai_ms").alias("ai_ms"),
        mean("fhir_ms").alias("fhir_ms"), mean("total_ms").alias("total_ms"),
    )


def hourly_throughput(docs: DataFrame) -> DataFrame:
    return (
        docs.filter(F.col("status").isin("completed", "failed"))
        .groupBy(F.date_trunc("hour", "processed_at").alias("hour"))
        .agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    )


def success_rates(docs: DataFrame) -> DataFrame:
    from chartmill.functions import fixed

    def n(*names):
        return F.count_if(F.col("status").isin(*names))

    return docs.agg(
        n("completed").alias("completed"), n("failed").alias("failed"), n(*fixed.LIVE_STATUSES).alias("in_progress"),
        n("pending").alias("queue_active"), n("ocr_pending", "processing").alias("pdf_active"), n("processing").alias("ai_active"),
        S.percent(n("completed"), n("completed", "failed")).alias("success_rate"),
    )


def live_documents(docs: DataFrame, limit: int) -> DataFrame:
    """Newest documents still on their way, with the stage shown to the user."""
    from chartmill.functions import fixed

    return (
        docs.filter(F.col("status").isin(fixed.LIVE_STATUSES))
        .select("doc_id", "uploaded_at", S.live_stage(F.col("status"), F.col("message")).alias("stage"))
        .orderBy(F.desc("uploaded_at"), F.desc("doc_id")).limit(limit)
    )


def stage_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(S.stage_key(F.col("status"), F.col("message")).alias("stage")).agg(F.count("*").alias("n"))


def dashboard_summary(docs: DataFrame, usage: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"

    def seconds(column):
        return F.coalesce(S.half_up(F.avg(F.when(done, F.col(column))) / 1000, 1), F.lit(0.0))

    card = docs.agg(
        F.count_if(done).alias("processed"), F.count_if(F.col("status") == "failed").alias("failed"),
        S.percent(F.count_if(done), F.count_if(F.col("status").isin("completed", "failed"))).alias("success_rate"),
        seconds("total_ms").alias("pipeline_seconds"), seconds("ai_ms").alias("ai_seconds"),
    )
    cost = usage.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"))
    joined = card.crossJoin(cost)  # two single rows
    return joined.withColumn("cost_per_document", F.when(F.col("processed") == 0, 0.0).otherwise(S.half_up(F.col("cost") / F.col("processed"), 4)))


# ---------------------------------------------------------------- usage and cost
def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens, cost, mean duration and success rate per key."""
    return usage.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cost").cast("double").alias("cost"),
        mean("duration_ms", 4).alias("avg_duration_ms"), S.percent(F.count_if("success"), F.count("*"), 4).alias("success_rate"),
    )


def usage_scope(usage: DataFrame) -> DataFrame:
    return usage.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("patient_id").alias("patients"))


def cost_by_provider(usage: DataFrame, docs: DataFrame) -> DataFrame:
    per = usage.groupBy("provider").agg(
        F.sum("cost").alias("total"), F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens")
    )
    done = docs.filter("status = 'completed'").agg(F.count("*").alias("completed"))
    both = per.agg(F.sum("total").alias("all")).crossJoin(done)  # two single rows
    return per.crossJoin(F.broadcast(both)).select(  # one row beside a handful of providers
        "provider", F.col("total").cast("double").alias("total_cost"), "calls", "tokens",
        F.when(F.col("completed") == 0, 0.0).otherwise(S.half_up(F.col("all") / F.col("completed"), 4)).alias("avg_cost_per_document"),
    )


def cost_suggestions(usage: DataFrame) -> DataFrame:
    """Per model: cost per token, whether cheapest or dearest, and reliability concern."""
    rated = usage.filter("total_tokens > 0").groupBy("provider", "model").agg(
        F.avg("cost_per_token").alias("rate")
    )
    calls = usage.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), S.percent(F.count_if(~F.col("success")), F.count("*"), 4).alias("failure_rate"),
    )
    ends = rated.agg(F.min(F.struct("rate", "provider", "model")).alias("lo"), F.max(F.struct("rate", "provider", "model")).alias("hi"))
    out = calls.join(rated, ["provider", "model"], "left").crossJoin(F.broadcast(ends))  # one row
    here = F.struct("rate", "provider", "model")
    return out.select(
        "provider", "model", "calls", "failure_rate", F.round("rate", 8).alias("rate"),
        (here == F.col("lo")).alias("cheapest"), (here == F.col("hi")).alias("dearest"),
        F.when(F.col("failure_rate") > 25, "high").when(F.col("failure_rate") > 10, "medium").alias("concern"),
    )


def spend_breach(usage: DataFrame, keys: list[str], limit: str) -> DataFrame:
    """First call at which the running cost of a key reaches ``limit``."""
    from chartmill.operators.ordered import running_total, top_rows

    run = running_total(usage, keys, ["started_at", "call_id"], "cost", "spent")
    over = run.filter(F.col("spent") >= F.lit(limit).cast("decimal(20,9)"))
    return top_rows(over, keys, [F.col("started_at"), F.col("call_id")])


def partial_completion(chunks: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Per document: succeeded share decides failed, flagged or complete."""
    ok, n = F.count_if("success"), F.count("*")
    return chunks.groupBy("doc_id").agg(
        n.alias("total"), ok.alias("succeeded"),
        F.when(ok / n < threshold, "failed").when(ok < n, "flagged").otherwise("complete").alias("outcome"),
    )


def latest_costs(docs: DataFrame, usage: DataFrame, limit: int) -> DataFrame:
    """Newest completed documents with the cost of their calls."""
    newest = docs.filter("status = 'completed'").orderBy(F.desc("processed_at"), F.desc("doc_id")).limit(limit)
    cost = usage.join(F.broadcast(newest.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum("cost").alias("cost"))  # at most `limit` ids
    return newest.join(cost, "doc_id", "left").select(
        "doc_id", "processed_at", F.coalesce("cost", F.lit(0)).cast("double").alias("cost")
    )


# ---------------------------------------------------------------- errors and operations
def error_summary(errors: DataFrame) -> DataFrame:
    """Counts by type, component, severity and recovery strategy in long form."""
    kind = F.col("error_type")
    rows = errors.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("dimension"), value.alias("member"))
                    for name, value in {
                        "type": kind, "component": F.col("component"), "severity": S.error_severity(kind),
                        "strategy": S.recovery_strategy(S.error_code(kind)),
                    }.items()
                ]
            )
        )
    )
    return rows.groupBy("dimension", "member").agg(F.count("*").alias("n"))


def component_health(errors: DataFrame) -> DataFrame:
    """Worst state since the log starts: health never recovers by itself."""
    severity = S.error_severity(F.col("error_type"))
    worst = F.max(F.when(severity == "critical", 2).when(severity == "error", 1).otherwise(0))
    return errors.groupBy("component").agg(
        F.when(worst == 2, "critical").when(worst == 1, "degraded").otherwise("healthy").alias("health"),
        F.max("ts").alias("last_check"),
    )


def error_window(errors: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Counts of the errors of the last ``hours`` before ``now`` in long form, with their number and rate an hour.

    Besides the dimensions of ``error_summary``: ``total``, and ``critical``
    for the errors a report lists one by one (``critical_errors``).
    """
    recent = errors.filter(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))
    counts = error_summary(recent)
    critical = S.error_severity(F.col("error_type")) == "critical"
    totals = recent.agg(F.count("*").alias("total"), F.count_if(critical).alias("critical"))
    lines = totals.select(F.inline(F.array(*[F.struct(F.lit(n).alias("dimension"), F.lit("all").alias("member"), F.col(n).alias("n")) for n in ("total", "critical")])))
    return counts.unionByName(lines).withColumn("per_hour", S.half_up(F.col("n") / F.lit(float(max(hours, 1))), 4))


def critical_errors(errors: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Critical errors of the last ``hours`` before ``now``."""
    critical = S.error_severity(F.col("error_type")) == "critical"
    return errors.filter(critical & (F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))).select("error_id", "ts", "error_type", "message", "component")


def component_health_since(errors: DataFrame, resets: DataFrame) -> DataFrame:
    """Worst state of each component since it was reset last: ``component, health, last_check, reset_at``.

    ``resets`` is ``(component, reset_at)``, any number per component. An error
    at the time of the reset is forgotten. A component without errors since
    then is healthy and was checked at its reset; one never reset is judged by
    the whole log.
    """
    last = resets.groupBy("component").agg(F.max("reset_at").alias("reset_at"))
    severity = S.error_severity(F.col("error_type"))
    level = F.when(severity == "critical", 2).when(severity == "error", 1).otherwise(0)
    seen = errors.join(last, "component", "left").filter("reset_at IS NULL OR ts > reset_at")
    worst = seen.groupBy("component").agg(F.max(level).alias("worst"), F.max("ts").alias("seen"))
    out = worst.join(last, "component", "full")
    return out.select("component", F.when(F.col("worst") == 2, "critical").when(F.col("worst") == 1, "degraded").otherwise("healthy").alias("health"), F.coalesce("seen", "reset_at").alias("last_check"), "reset_at")


def operation_alerts(ops: DataFrame) -> DataFrame:
    """Alert texts per operation beyond the configured limits."""
    per = F.when(F.col("resources") > 0, F.col("db_queries") / F.col("resources"))
    bad = F.when(F.col("resources") > 0, F.col("errors") / F.col("resources"))
    found = S.issues(
        (F.col("seconds") > 30, "slow"), (F.col("memory_mb") > 100, "memory"), (F.col("hit_ratio") < 0.7, "cache"),
        (per > 5, "queries"), (bad > 0.05, "errors"),
    )
    return ops.select("op_id", F.array_join(found, ",").alias("alerts")).filter("alerts <> ''")


def operation_summary(ops: DataFrame) -> DataFrame:
    return ops.agg(
        F.count("*").alias("operations"), S.half_up(F.avg("seconds"), 4).alias("avg_seconds"), F.max("seconds").alias("max_seconds"),
        F.sum("resources").alias("resources"), S.half_up(F.avg("hit_ratio"), 4).alias("avg_hit_ratio"),
        F.sum("db_queries").alias("db_queries"), F.sum("errors").alias("errors"),
        S.half_up(F.sum("errors") / F.sum("resources"), 6).alias("error_rate"),
    )


def operations_per_hour(ops: DataFrame) -> DataFrame:
    return ops.groupBy(F.date_trunc("hour", "started_at").alias("hour")).agg(
        F.count("*").alias("operations"), mean("duration_ms", 4).alias("avg_duration_ms"),
        S.percent(F.count_if("success"), F.count("*"), 4).alias("success_rate"),
        F.sum("total_tokens").alias("tokens"), S.half_up(F.avg(F.col("cost").cast("double")), 6).alias("avg_cost"),
    )


# ---------------------------------------------------------------- extraction quality
def confidence_stats(fields: DataFrame, *keys: str) -> DataFrame:
    c = F.col("confidence")
    return fields.groupBy(*keys).agg(
        F.count("*").alias("n"), S.half_up(F.avg(c), 3).alias("avg_confidence"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if((c >= 0.3) & (c < 0.5)).alias("low"), F.count_if(c < 0.3).alias("very_low"),
        S.percent(F.count_if(c >= 0.8), F.count("*")).alias("quality_score"),
        F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"),
    )


def comparison_progress(compared: DataFrame) -> DataFrame:
    """Per document: resolved share and open discrepancies by category of the field."""
    category = S.comparison_category(F.col("field"))
    different = F.col("different")

    def n(name):
        return F.count_if(different & (category == name)).alias(name)

    return compared.groupBy("doc_id").agg(
        S.percent(F.count_if("resolved"), F.count("*")).alias("completion"), F.count_if(different & ~F.col("resolved")).alias("unresolved"),
        n("demographics"), n("contact_info"), n("medical_info"), n("other"),
    )


def field_change_analytics(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field_name").agg(
        F.count("*").alias("changes"), S.half_up(F.avg("confidence"), 6).alias("avg_confidence"),
        S.half_up(F.avg("quality"), 6).alias("avg_quality"), F.countDistinct("patient_id").alias("patients"),
        F.countDistinct("reviewer").alias("reviewers"),
    )


def review_statistics(parsed: DataFrame) -> DataFrame:
    auto = F.count_if(F.col("review") == "auto_approved")
    flagged = S.percent(F.count("*") - auto, F.count("*"))
    return parsed.agg(
        F.count("*").alias("total"), auto.alias("auto_approved"), S.percent(auto, F.count("*")).alias("auto_share"),
        flagged.alias("flagged_share"), F.when(flagged < 5, "below").when(flagged > 20, "above").otherwise("within").alias("target"),
        S.half_up(F.min("confidence"), 4).alias("min_confidence"), S.half_up(F.avg("confidence"), 4).alias("avg_confidence"),
        S.half_up(F.max("confidence"), 4).alias("max_confidence"),
    )


def fill_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Filled rows per column in long form, from a single scan."""
    counts = df.agg(F.count("*").alias("__rows"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"), F.col("__rows").alias("total")) for c in columns])
    return counts.select(F.inline(rows))


# ---------------------------------------------------------------- clinical
def code_statistics(codes: DataFrame) -> DataFrame:
    """Patients with codes, codes in all, and codes by kind."""
    return codes.groupBy("kind").agg(
        F.count("*").alias("codes"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("code").alias("distinct_codes")
    )


def abnormal_summary(results: DataFrame, *keys: str) -> DataFrame:
    r = F.col("result")
    return results.groupBy(*keys).agg(
        F.count_if(r == "critical").alias("critical"), F.count_if(r.isin("low", "high")).alias("abnormal"),
        F.count_if(~r.isin("critical", "low", "high")).alias("normal"),
    )


def medication_summary(meds: DataFrame, *keys: str) -> DataFrame:
    """Counts per key; duplicates are pairs of active rows with the same normalised name."""
    rows = meds.select(*keys, "status", S.therapeutic_class(F.col("name")).alias("cls"), S.normalize_drug(F.col("name")).alias("drug"))
    per_drug = rows.groupBy(*keys, "cls", "drug").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("a"))
    return per_drug.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("a").alias("active"), (F.sum("n") - F.sum("a")).alias("inactive"),
        F.countDistinct("cls").alias("classes"), F.sum(F.expr("a * (a - 1) div 2")).alias("duplicate_pairs"),
    )


def timeline_summary(events: DataFrame, *keys: str) -> DataFrame:
    start, end = F.col("start_date"), F.col("end_date")
    days = F.when(start.isNull(), None).when(end.isNull(), 1).otherwise(F.greatest(F.lit(1), F.datediff(end, start)))
    first, last = F.least(F.min(start), F.min(end)), F.greatest(F.max(start), F.max(end))
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"), F.count_if(F.col("kind") == "admission").alias("admissions"),
        F.count_if(F.col("kind") == "emergency").alias("emergencies"), first.alias("first_date"), last.alias("last_date"),
        F.coalesce(F.datediff(last, first), F.lit(0)).alias("range_days"),
        F.coalesce(F.sum(F.when(F.col("kind") == "admission", days)), F.lit(0)).alias("inpatient_days"),
    )


def lab_panels(results: DataFrame, *keys: str) -> DataFrame:
    """Assign tests to panels and summarise each panel.

    A stated panel wins. The rest is tried against the word signatures in order;
    a panel below its minimum leaves its tests to later rounds. The rounds run on
    one row per (group, stated panel, signature mask), at most 256 masks a group.
    """
    from pyspark.sql import Window as W

    from chartmill.functions import fixed

    mask = sum((F.when(S.has_word(F.col("test_name"), words), 1 << i).otherwise(0) for i, (_, _, _, words) in enumerate(fixed.LAB_PANELS)), F.lit(0))
    small = (
        results.withColumn("__mask", mask)
        .groupBy(*keys, "stated_panel", "__mask")
        .agg(F.count("*").alias("n"), F.count_if("flagged").alias("f"), F.min("effective_date").alias("d"))
        .withColumn("panel", F.col("stated_panel"))
    )
    group = W.partitionBy(*keys)
    for i, (name, _, minimum, _) in enumerate(fixed.LAB_PANELS):
        open_hit = F.col("panel").isNull() & (F.col("__mask").bitwiseAND(1 << i) != 0)
        small = small.withColumn("__c", F.sum(F.when(open_hit, F.col("n")).otherwise(0)).over(group)).withColumn(
            "panel", F.when(open_hit & (F.col("__c") >= minimum), F.lit(name)).otherwise(F.col("panel"))
        )
    codes = {name: code for name, code, _, _ in fixed.LAB_PANELS}
    return (
        small.groupBy(*keys, F.coalesce("panel", F.lit(fixed.OTHER_PANEL)).alias("panel"))
        .agg(F.sum("n").alias("results"), F.sum("f").alias("flagged"), F.min("d").alias("effective_date"))
        .withColumn("loinc", S.lookup(F.col("panel"), codes))
        .withColumn(
            "conclusion",
            F.concat(
                "panel", F.lit(": "), F.col("results").cast("string"), F.lit(" result(s)"),
                F.when(F.col("flagged") > 0, F.concat(F.lit(", "), F.col("flagged").cast("string"), F.lit(" flagged"))).otherwise(""),
            ),
        )
    )


def specialty_counts(providers: DataFrame, limit: int = 5) -> DataFrame:
    n = providers.groupBy("specialty").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "specialty").limit(limit)


def directory_statistics(providers: DataFrame) -> DataFrame:
    per = providers.groupBy(F.coalesce("specialty", F.lit("Other")).alias("specialty")).agg(F.count("*").alias("n"))
    top = per.agg(F.count("*").alias("specialties"), F.max_by("specialty", F.struct("n", F.col("specialty"))).alias("largest"), F.max("n").alias("largest_count"))
    all_ = providers.agg(F.count("*").alias("providers"), F.countDistinct(F.when(F.col("organization") != "", F.col("organization"))).alias("organizations"))
    return all_.crossJoin(top)  # two single rows


def compliance_report(log: DataFrame, period: str = "month") -> DataFrame:
    """Per period: events, access to personal data, failed logins, violations."""
    kind = S.access_event(F.col("path"), F.col("method"))
    failed_login = (kind == "login") & ~F.col("success")
    violation = (F.col("severity") == "critical") & ~F.col("success")
    n = F.count("*")
    return log.groupBy(F.date_trunc(period, "logged_at").alias("period")).agg(
        n.alias("events"), F.count_if(F.col("phi_involved") | S.is_phi_path(F.col("path"))).alias("phi_access"),
        F.count_if(failed_login).alias("failed_logins"), F.count_if(violation).alias("violations"),
        S.percent(n - F.count_if(violation), n, 2).alias("score"),
    )
