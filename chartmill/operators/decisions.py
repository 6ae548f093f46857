"""Reviewed field decisions as an undo log: preview, batch check, application and rollback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.operators.ordered import numbered, previous_row

# fixed values: resolutions that change a record, the confidence that counts as high, date formats of a value
CHANGING = ("use_extracted", "manual_edit")
HIGH_CONFIDENCE = 0.8
VALUE_DATES = ("M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "d/M/yyyy")
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
RECORD_NUMBER = r"^[a-zA-Z0-9]{3,}$"
KEYS = ["patient_id", "field_name"]


def as_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records as one row per patient and field: ``patient_id, field_name, value``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    return records.select("patient_id", F.inline(pairs))


def preview(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """What decisions would change: ``patient_id, decision_id, field_name, current_value, new_value, resolution``.

    ``decisions`` is ``(decision_id, decided_at, patient_id, field_name,
    resolution, new_value, confidence)``. Kept and pending fields do not show;
    a field that the record does not have is empty before.
    """
    rows = decisions.filter(F.col("resolution").isin(*CHANGING))
    now = fields.select(*KEYS, F.col("value").alias("current_value"))
    return rows.join(now, KEYS, "left").select("patient_id", "decision_id", "field_name", F.coalesce("current_value", F.lit("")).alias("current_value"), F.coalesce("new_value", F.lit("")).alias("new_value"), "resolution")


def preview_summary(decisions: DataFrame) -> DataFrame:
    """Changes, those of high confidence and manual edits per patient with decisions."""
    taken, manual = F.col("resolution") == "use_extracted", F.col("resolution") == "manual_edit"
    return decisions.groupBy("patient_id").agg(
        F.coalesce(F.bool_or(taken | manual), F.lit(False)).alias("has_changes"), F.count_if(taken | manual).alias("total_changes"),
        F.count_if(taken & (F.col("confidence") >= HIGH_CONFIDENCE)).alias("high_confidence_changes"), F.count_if(manual).alias("manual_edits"),
    )


def _fits(field: Column, value: Column) -> Column:
    """Whether a value has the form of its field."""
    text = F.trim(value)
    date = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in VALUE_DATES])
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(field == "date_of_birth", date.isNotNull() & text.rlike(r"^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,4}$"))
        .when(field == "phone", digits.isin(10, 11)).when(field == "email", text.rlike(EMAIL)).when(field == "mrn", value.rlike(RECORD_NUMBER)).otherwise(True)
    )


def check_batch(fields: DataFrame, decisions: DataFrame, known_fields: Sequence[str]) -> DataFrame:
    """``decisions`` that would change a record, with ``error``: null for valid ones, else why they fail.

    A record number must not be that of another patient; two decisions of one
    batch may name the same one, then the record of the first has it when the
    next batch is checked.
    """
    rows = decisions.filter(F.col("resolution").isin(*CHANGING))
    owners = fields.filter("field_name = 'mrn' AND value IS NOT NULL").groupBy(F.col("value").alias("new_value")).agg(F.min("patient_id").alias("__first"), F.max("patient_id").alias("__last"))
    owners = owners.withColumn("field_name", F.lit("mrn"))
    out = rows.join(owners, ["field_name", "new_value"], "left")
    others = F.coalesce((F.col("__first") != F.col("patient_id")) | (F.col("__last") != F.col("patient_id")), F.lit(False))
    empty = F.coalesce(F.trim("new_value") == "", F.lit(True))
    error = (
        F.when(F.col("patient_id").isNull() | F.col("field_name").isNull() | empty, "missing").when(~F.col("field_name").isin(*known_fields), "unknown field")
        .when(~_fits(F.col("field_name"), F.col("new_value")), "invalid").when(others, "taken")
    )
    return out.select(*[rows[c] for c in rows.columns], error.alias("error"))


def undo_log(fields: DataFrame, accepted: DataFrame) -> DataFrame:
    """Log of accepted decisions: ``decision_id, patient_id, field_name, version, before, after, undone``.

    The decisions of a field are applied by time and id; each has the value
    before it and a version of the field. A field that very many decisions
    name is numbered in slices.
    """
    rows = accepted.select("decision_id", "decided_at", *KEYS, F.col("new_value").alias("after"))
    order = ["decided_at", "decision_id"]
    chained = previous_row(numbered(rows, KEYS, order, "version"), KEYS, order, ["after", "version"])
    first = fields.select(*KEYS, F.col("value").alias("__value"))
    before = F.when(F.col("prev_version").isNull(), F.col("__value")).otherwise(F.col("prev_after"))
    return chained.join(first, KEYS, "left").select("decision_id", *KEYS, "version", before.alias("before"), "after", F.lit(False).alias("undone"))


def current_values(fields: DataFrame, log: DataFrame) -> DataFrame:
    """Fields with the newest standing decision of each."""
    newest = log.filter("NOT undone").groupBy(*KEYS).agg(F.max_by("after", "version").alias("__after"), F.count("*").alias("__n"))
    out = fields.join(newest, KEYS, "full")
    return out.select(*KEYS, F.when(F.col("__n").isNotNull(), F.col("__after")).otherwise(F.col("value")).alias("value"))


def roll_back(log: DataFrame, decision_ids: DataFrame) -> DataFrame:
    """``log`` after taking back ``decision_ids(decision_id)``, with ``outcome``: undone, blocked, or null for rows not asked for.

    A decision goes only if none that stays stands on it: the newest standing
    decision of a field that is not asked for blocks all before it. A second
    time changes nothing.
    """
    asked = decision_ids.select("decision_id").distinct().withColumn("__asked", F.lit(True))
    rows = log.join(asked, "decision_id", "left").withColumn("__asked", F.coalesce("__asked", F.lit(False)))
    floor = rows.filter("NOT undone AND NOT __asked").groupBy(*KEYS).agg(F.max("version").alias("__floor"))
    rows = rows.join(floor, KEYS, "left")
    free = F.col("undone") | (F.col("version") > F.coalesce("__floor", F.lit(0)))
    outcome = F.when(F.col("__asked"), F.when(free, "undone").otherwise("blocked"))
    return rows.select("decision_id", *KEYS, "version", "before", "after", (F.col("undone") | (F.col("__asked") & free)).alias("undone"), outcome.alias("outcome"))
