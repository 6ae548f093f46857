"""Trends, timelines and orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators.ordered import anchor_groups, numbered, previous_row, top_rows


def weight_trend(weights: DataFrame, heights: DataFrame) -> DataFrame:
    """BMI, change against the previous weight and clinical significance.

    ``weights(patient_id, obs_id, day, weight_kg)``; ``heights(patient_id, day, obs_id, height_m)``.
    The latest height of a patient counts.
    """
    height = heights.groupBy("patient_id").agg(F.max_by("height_m", F.struct("day", "obs_id")).alias("height_m"))
    rows = previous_row(weights, ["patient_id"], ["day", "obs_id"], ["weight_kg", "day"])
    rows = rows.join(height, "patient_id")
    change = S.percent_change(F.col("prev_weight_kg"), F.col("weight_kg"))
    days = F.datediff("day", "prev_day")
    rows = rows.withColumns({"change": change, "days": days, "bmi": S.bmi(F.col("weight_kg"), F.col("height_m"))}).filter("bmi IS NOT NULL")
    size = F.abs("change")
    significant = (
        ((F.col("days") <= 30) & (size >= 5)) | ((F.col("days") <= 90) & (size >= 7.5)) | ((F.col("days") <= 180) & (size >= 10))
    )
    return rows.select(
        "patient_id", "obs_id", "day", "weight_kg", "bmi", S.bmi_category(F.col("bmi")).alias("category"), "change", "days",
        F.coalesce(significant, F.lit(False)).alias("significant"),
    )


def weight_summary(trend: DataFrame) -> DataFrame:
    first = F.min_by("weight_kg", F.struct("day", "obs_id"))
    last = F.max_by("weight_kg", F.struct("day", "obs_id"))
    return trend.groupBy("patient_id").agg(
        F.count("*").alias("n"), first.alias("first_weight"), last.alias("last_weight"), F.min("day").alias("first_day"),
        F.max("day").alias("last_day"), S.percent_change(first, last).alias("total_change"), F.count_if("significant").alias("significant_changes"),
    )


def recent_weights(weights: DataFrame, limit: int = 12) -> DataFrame:
    """Newest ``limit`` weights of a patient; ``place`` 1 is the newest."""
    return top_rows(weights, ["patient_id"], [F.desc("day"), F.col("obs_id")], limit, "place")


def timeline_columns(events: DataFrame, columns: int = 365) -> DataFrame:
    """Grid columns of events between the patient's first and last date."""
    start, end = F.col("start_date"), F.col("end_date")
    span = events.groupBy("patient_id").agg(
        F.least(F.min(start), F.min(end)).alias("__lo"), F.greatest(F.max(start), F.max(end)).alias("__hi")
    )
    days = F.datediff("__hi", "__lo")
    per = days / F.lit(columns)

    def column(day):
        return F.floor(F.datediff(day, "__lo") / per).cast("bigint") + 1

    flat = start.isNull() | days.isNull() | (days == 0)
    out = events.join(span, "patient_id", "left")
    first = F.when(flat, F.lit(1)).otherwise(column(start))
    last = F.when(flat, F.lit(2)).otherwise(F.when(end.isNull(), first + 1).otherwise(F.greatest(column(end), first + 1)))
    return out.withColumns({"start_column": first.cast("bigint"), "end_column": last.cast("bigint")}).drop("__lo", "__hi")


def latest_per_test(results: DataFrame) -> DataFrame:
    """Newest result per patient and test."""
    return top_rows(results, ["patient_id", "test_name"], [F.desc_nulls_last("effective_at"), F.col("obs_id")])


def test_priority(name):
    return S.cascade(
        F.lower(name),
        [(90, ["glucose", "hemoglobin", "creatinine", "cholesterol"]), (85, ["blood pressure", "heart rate", "temperature", "weight"]), (80, ["lab", "test", "level"])],
        50,
    )


def key_results(results: DataFrame, limit: int = 10) -> DataFrame:
    """Newest result per test, the most important tests first."""
    latest = latest_per_test(results).withColumn("priority", test_priority(F.col("test_name")))
    return top_rows(latest, ["patient_id"], [F.desc("priority"), F.desc_nulls_last("effective_at"), F.col("test_name")], limit, "place")


def top_conditions(conditions: DataFrame, limit: int = 10) -> DataFrame:
    priority = F.when(F.col("status").isin("active", "recurring"), 100).otherwise(50)
    return top_rows(
        conditions.withColumn("priority", priority), ["patient_id"],
        [F.desc("priority"), F.desc_nulls_last("updated_at"), F.col("condition_id")], limit, "place",
    )


def top_medications(meds: DataFrame, limit: int = 10) -> DataFrame:
    priority = F.when(F.col("status").isin("active", "intended"), 100).otherwise(50)
    return top_rows(
        meds.withColumn("priority", priority), ["patient_id"],
        [F.desc("priority"), F.desc_nulls_last("start_date"), F.col("med_id")], limit, "place",
    )


def close_observations(obs: DataFrame, keys: list[str], seconds: int = 60) -> DataFrame:
    """Observations of one subject and code less than a minute after the previous one."""
    from chartmill.operators.metrics import seconds_between

    rows = previous_row(obs, keys, ["ts", "event_id"], ["ts", "event_id"])
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    return rows.withColumn("gap_seconds", seconds_between(F.col("prev_ts"), F.col("ts"))).filter(micros < seconds * 1_000_000)


def proximity_groups(docs: DataFrame, hours: int = 24) -> DataFrame:
    """Documents within a day of the first document of their group."""
    micros = docs.withColumn("__at", F.unix_micros(F.col("uploaded_at").cast("timestamp")))
    return anchor_groups(micros, "patient_id", "__at", hours * 3_600_000_000).withColumn(
        "anchor_at", F.timestamp_micros("anchor").cast("timestamp_ntz")
    ).drop("__at", "anchor")


def with_date_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with ``date_key``, the first time of the day-long group of its patient that a document falls into."""
    groups = proximity_groups(docs.select("doc_id", "patient_id", "uploaded_at"))
    return docs.join(groups.select("doc_id", F.unix_seconds(F.col("anchor_at").cast("timestamp")).alias("date_key")), "doc_id")


RELATION_SCORE = {"encounter": 0.9, "visit": 0.8, "provider": 0.7, "date_proximity": 0.6, "document_type": 0.5}


def relationships(docs: DataFrame, kinds: dict[str, str], batch: str = "patient_id") -> DataFrame:
    """Groups of at least two documents of a batch sharing a key, with a fixed score per kind."""
    options = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("member")) for k, c in kinds.items()])
    rows = docs.select(batch, "uploaded_at", F.inline(options)).filter("member IS NOT NULL")
    out = rows.groupBy(batch, "kind", "member").agg(
        F.count("*").alias("n"), F.min("uploaded_at").alias("first_at"), F.max("uploaded_at").alias("last_at")
    ).filter("n > 1")
    return out.withColumn("score", S.lookup(F.col("kind"), RELATION_SCORE))


def processing_order(docs: DataFrame, kinds: dict[str, str], batch: str = "patient_id") -> DataFrame:
    """Position of each document in its batch: related groups first, then the rest.

    A document joins its first relationship in the order of ``kinds``.
    """
    found = relationships(docs, kinds, batch).select(batch, "kind", "member")
    options = F.array(
        *[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("member")) for i, (k, c) in enumerate(kinds.items())]
    )
    offers = docs.select(batch, "doc_id", F.inline(options)).join(found, [batch, "kind", "member"], "left_semi")
    best = offers.groupBy(batch, "doc_id").agg(F.min(F.struct("rank", "kind", "member")).alias("b"))
    placed = docs.select(batch, "doc_id").join(best, [batch, "doc_id"], "left").select(
        batch, "doc_id", F.coalesce(F.concat_ws(":", "b.kind", "b.member"), F.lit("")).alias("group_key"),
        F.col("b").isNull().cast("int").alias("late"),
    )
    return numbered(placed, [batch], ["late", "group_key", "doc_id"]).drop("late")


def stuck_documents(docs: DataFrame, as_of: str, minutes: int = 15, attempts: int = 3) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    cutoff = (end - F.expr(f"INTERVAL {minutes} MINUTES")).cast("timestamp_ntz")
    again = F.col("attempts") < attempts
    return docs.filter(F.col("status").isin("processing", "ocr_pending") & (F.col("uploaded_at") < cutoff)).select(
        "doc_id", F.when(again, "pending").otherwise("failed").alias("new_status"),
        (F.col("attempts") + F.when(again, 1).otherwise(0)).alias("attempts"),
        F.when(again, "Re-queued after processing timeout").otherwise("Processing timed out after multiple attempts").alias("message"),
    )


def primary_diagnosis(conditions: DataFrame) -> DataFrame:
    """First active condition of a patient in record order, and how many others are active."""
    active = conditions.filter("status = 'active'")
    return active.groupBy("patient_id").agg(
        F.min(F.struct("updated_at", "condition_id", "name")).alias("p"), (F.count("*") - 1).alias("comorbidities")
    ).select("patient_id", F.col("p.condition_id").alias("condition_id"), F.col("p.name").alias("name"), "comorbidities")


def newest_first(rows: DataFrame, date: str, sentinel: str = "1900-01-01") -> DataFrame:
    """Rows of a report sorted by date, undated rows last."""
    return rows.withColumn("sort_date", F.coalesce(F.col(date).cast("string"), F.lit(sentinel))).orderBy(F.desc("sort_date"))
