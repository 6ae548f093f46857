"""Merging new rows into the patient record: conflicts, versions, decisions, audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators.ordered import numbered, previous_row

# fixed values
TRACKED_STATUS = ["Condition", "MedicationStatement", "AllergyIntolerance", "Procedure", "CarePlan", "Goal"]
SEVERITY_STRATEGY = {"critical": "manual_review", "high": "preserve_both", "medium": "newest_wins", "low": "newest_wins"}
ACTION_PRIORITY = {"flag_for_review": 4, "keep_existing": 3, "preserve_both": 2, "keep_new": 1}
REPORT_LEVEL = {"registered": 1, "partial": 2, "preliminary": 3, "final": 4, "amended": 5, "corrected": 6}


# ---------------------------------------------------------------- store
def merge_documents(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("patient_id", "source_id")) -> DataFrame:
    """Replace all rows of the incoming documents. Running it twice changes nothing."""
    incoming = new.select(*keys).distinct()
    return existing.join(incoming, list(keys), "left_anti").unionByName(new)


def roll_back(existing: DataFrame, source_ids: Sequence[int]) -> DataFrame:
    return existing.filter(~F.col("source_id").isin(list(source_ids)))


def rolled_back_counts(existing: DataFrame, source_ids: Sequence[int]) -> DataFrame:
    return existing.filter(F.col("source_id").isin(list(source_ids))).groupBy("patient_id", "resource_type").agg(F.count("*").alias("removed"))


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add or replace by key; a replaced row gets the next version."""
    a = existing.select(*keys, "version", F.struct(*columns).alias("__old"))
    b = new.select(*keys, F.struct(*columns).alias("__new"))
    out = a.join(b, list(keys), "full")
    version = F.when(F.col("__old").isNull(), 1).when(F.col("__new").isNotNull(), F.col("version") + 1).otherwise(F.col("version"))
    best = F.coalesce("__new", "__old")
    return out.select(*keys, *[best[c].alias(c) for c in columns], version.alias("version"))


def merge_patients(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Put the rows of merged patients under their target; ``moves(patient_id, target_id)``."""
    out = rows.join(moves.select("patient_id", "target_id"), "patient_id", "left")
    return out.withColumn("patient_id", F.coalesce("target_id", "patient_id")).drop("target_id")


# ---------------------------------------------------------------- conflicts
def _conflict(when: Column, kind: str, field: str, severity: Column | str) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(when, F.struct(F.lit(kind).alias("conflict"), F.lit(field).alias("field"), level.alias("severity")))


def simple_conflicts(pairs: DataFrame, row_id: str) -> DataFrame:
    """Conflicts of a new and an existing row by type.

    ``pairs(resource_type, new_value, old_value, new_status, old_status, new_at, old_at)``.
    Equal times of two observations count as a low conflict.
    """
    obs = F.col("resource_type") == "Observation"
    level = F.when(F.col("resource_type") == "Condition", "medium").otherwise("low")
    found = F.array_compact(F.array(
        _conflict(obs & (F.col("new_value") != F.col("old_value")), "value_mismatch", "value", "medium"),
        _conflict(obs & (F.col("new_at") == F.col("old_at")), "temporal_conflict", "at", "low"),
        _conflict(~obs & (F.col("new_status") != F.col("old_status")), "status_conflict", "status", level),
    ))
    return pairs.select(row_id, "resource_type", F.inline(found))


def graded_conflict_list() -> Column:
    """Conflicts of one pair as an array of (conflict, field, severity).

    Richer rules with graded severity; they also read unit, onset, severity, dosage and demographics.
    """
    kind = F.col("resource_type")
    a, b = F.col("new_value"), F.col("old_value")
    top = F.greatest(F.abs(a), F.abs(b))
    share = F.abs(a - b) / top * 100
    value_level = F.when((a == 0) | (b == 0), "high").when(share > 50, "high").when(share >= 20, "medium").otherwise("low")
    hours = F.abs(F.unix_seconds(F.col("new_at").cast("timestamp")) - F.unix_seconds(F.col("old_at").cast("timestamp"))) / 3600
    s1, s2 = F.lower("new_status"), F.lower("old_status")
    swap = ((s1 == "active") & s2.isin("resolved", "inactive")) | ((s2 == "active") & s1.isin("resolved", "inactive"))
    differs = F.col("new_status") != F.col("old_status")
    obs, cond, med, pat = (kind == k for k in ("Observation", "Condition", "MedicationStatement", "Patient"))
    return F.array_compact(F.array(
        _conflict(obs & (a != b), "value_mismatch", "value", value_level),
        _conflict(obs & (hours > 1), "temporal_conflict", "at", "medium"),
        _conflict(obs & (F.col("new_unit") != F.col("old_unit")) & (F.col("new_unit") != "") & (F.col("old_unit") != ""), "unit_mismatch", "unit", "high"),
        _conflict(cond & differs, "status_conflict", "status", F.when(swap, "high").otherwise("medium")),
        _conflict(cond & (F.col("new_onset") != F.col("old_onset")), "temporal_conflict", "onset", "medium"),
        _conflict(cond & (F.col("new_severity") != F.col("old_severity")), "severity_conflict", "severity", "medium"),
        _conflict(med & (F.col("new_dosage") != F.col("old_dosage")), "dosage_conflict", "dosage", "high"),
        _conflict(med & differs, "status_conflict", "status", "medium"),
        _conflict(med & (F.col("new_onset") != F.col("old_onset")), "temporal_conflict", "period", "medium"),
        _conflict(pat & (F.col("new_name") != F.col("old_name")), "demographic_conflict", "name", "critical"),
        _conflict(pat & (F.col("new_birth") != F.col("old_birth")), "demographic_conflict", "birth_date", "critical"),
    ))


def graded_conflicts(pairs: DataFrame, row_id: str) -> DataFrame:
    """One row per conflict of ``graded_conflict_list``."""
    return pairs.select(row_id, "resource_type", F.inline(graded_conflict_list()))


def newest_wins(new_at: Column, old_at: Column) -> Column:
    return F.when((old_at > new_at) | (old_at.isNotNull() & new_at.isNull()), "keep_existing").otherwise("keep_new")


# strategy name -> action expression over (new_at, old_at, new_confidence, old_confidence); extend to add one
STRATEGIES: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "newest_wins": lambda na, oa, nc, oc: newest_wins(na, oa),
    "preserve_both": lambda na, oa, nc, oc: F.lit("preserve_both"),
    "confidence_based": lambda na, oa, nc, oc: F.when(oc > nc, "keep_existing").when(nc > oc, "keep_new").otherwise(newest_wins(na, oa)),
    "manual_review": lambda na, oa, nc, oc: F.lit("flag_for_review"),
}


def chosen_strategy(conflict: Column, resource_type: Column, severity: Column, config: dict | None = None) -> Column:
    """Strategy by conflict type, then resource type, then severity, then default."""
    config = config or {}

    def pick(column, table):
        return S.lookup(column, table) if table else F.lit(None).cast("string")

    return F.coalesce(
        pick(conflict, config.get("conflict_type", {})), pick(resource_type, config.get("resource_type", {})),
        pick(severity, config.get("severity", SEVERITY_STRATEGY)), F.lit(config.get("default", "newest_wins")),
    )


def with_strategy(name: str, rule: Callable[[Column, Column, Column, Column], Column]) -> dict:
    """Strategy table with one more entry, for ``resolution(..., strategies=...)``."""
    return {**STRATEGIES, name: rule}


def resolution(strategy: Column, new_at: Column, old_at: Column, new_confidence: Column, old_confidence: Column, strategies: dict | None = None) -> Column:
    out = F
    for name, rule in (strategies or STRATEGIES).items():
        out = out.when(strategy == name, rule(new_at, old_at, new_confidence, old_confidence))
    return out.otherwise(STRATEGIES["newest_wins"](new_at, old_at, new_confidence, old_confidence))


def judged(pairs: DataFrame, config: dict | None = None) -> DataFrame:
    """``pairs`` with their conflicts, each with its strategy and action, in the array ``judged``."""

    def judge(c: Column) -> Column:
        strategy = chosen_strategy(c["conflict"], F.col("resource_type"), c["severity"], config)
        action = resolution(strategy, F.col("new_at"), F.col("old_at"), F.col("new_confidence"), F.col("old_confidence"))
        return F.struct(c["conflict"].alias("conflict"), c["field"].alias("field"), c["severity"].alias("severity"), strategy.alias("strategy"), action.alias("action"))

    return pairs.withColumn("judged", F.transform(graded_conflict_list(), judge))


def resolved(pairs: DataFrame, row_id: str, config: dict | None = None) -> DataFrame:
    """Strategy and action of each conflict."""
    return judged(pairs, config).select(row_id, "resource_type", F.inline("judged"))


def _outcome(rows: DataFrame) -> DataFrame:
    """Strongest action of a judged pair, counts of its resolved and open conflicts."""
    strongest = F.array_max(F.transform("judged", lambda c: F.struct(S.lookup(c["action"], ACTION_PRIORITY, 1).alias("rank"), c["action"].alias("action"))))["action"]
    is_open = F.filter("judged", lambda c: c["action"] == "flag_for_review")
    return rows.withColumns({
        "action": strongest, "conflicts": F.size("judged").cast("bigint"), "open": F.size(is_open).cast("bigint"),
        "resolved": (F.size("judged") - F.size(is_open)).cast("bigint"), "critical": F.exists("judged", lambda c: c["severity"] == "critical"),
    })


def predominant_actions(pairs: DataFrame, row_id: str, config: dict | None = None) -> DataFrame:
    """Strongest action per pair with conflicts, with counts of resolved and open ones."""
    return _outcome(judged(pairs, config)).filter("conflicts > 0").select("resource_type", row_id, "action", "conflicts", "resolved", "open", "critical")


def merge_actions(pairs: DataFrame, row_id: str, config: dict | None = None) -> DataFrame:
    """What happens to each new row.

    ``pairs`` also has ``matched`` and ``duplicate``. Observations follow the
    strongest resolution, conditions update when recorded later, others are
    added. All of it is decided within the row.
    """
    rows = _outcome(judged(pairs, config))
    later = F.coalesce(F.col("new_at") > F.col("old_at"), F.col("new_at").isNotNull())
    skipped = F.col("matched") & F.col("duplicate")
    observation = (
        F.when(skipped, "skipped").when(F.col("action") == "keep_existing", "kept_existing")
        .when(F.col("conflicts") > 0, "added_as_sequence").otherwise("added")
    )
    condition = (
        F.when(skipped, "skipped").when(F.col("critical"), "flagged_for_review")
        .when(F.col("matched") & later, "updated").when(F.col("matched"), "skipped").otherwise("added")
    )
    kind = F.col("resource_type")
    merged = F.when(kind == "Observation", observation).when(kind == "Condition", condition).otherwise("added")
    return rows.select(row_id, "resource_type", merged.alias("merge_action"), "conflicts", "resolved")


class HandlerRegistry:
    """Merge handlers by resource type: DataFrame of new rows -> DataFrame of merged rows."""

    def __init__(self, default: Callable[[DataFrame], DataFrame]):
        self.default = default
        self.handlers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, resource_type: str, handler: Callable[[DataFrame], DataFrame]) -> None:
        self.handlers[resource_type] = handler

    def apply(self, new: DataFrame) -> DataFrame:
        """Registered handler for its type, the default for the others."""
        own = list(self.handlers)
        out = self.default(new.filter(~F.col("resource_type").isin(own)) if own else new)
        for resource_type, handler in self.handlers.items():
            out = out.unionByName(handler(new.filter(F.col("resource_type") == resource_type)))
        return out


def merge_procedures(pairs: DataFrame) -> DataFrame:
    """Update within a day or when an outcome is new; notes and performers are united."""
    hours = F.abs(F.unix_seconds(F.col("new_at").cast("timestamp")) - F.unix_seconds(F.col("old_at").cast("timestamp"))) / 3600
    update = F.coalesce(hours <= 24, F.lit(False)) | (F.col("new_outcome").isNotNull() & F.col("old_outcome").isNull())
    return pairs.select(
        "row_id", F.when(update, "updated").otherwise("added").alias("merge_action"),
        F.when(update, F.coalesce("new_outcome", "old_outcome")).otherwise(F.col("new_outcome")).alias("outcome"),
        F.when(update, F.array_union("old_notes", "new_notes")).otherwise(F.col("new_notes")).alias("notes"),
    )


def merge_reports(pairs: DataFrame) -> DataFrame:
    """Update when the status level rises or an identifier is shared; results are united."""
    new, old = (S.lookup(F.col(c), REPORT_LEVEL, 0) for c in ("new_status", "old_status"))
    update = (new > old) | F.coalesce(F.arrays_overlap("new_ids", "old_ids"), F.lit(False))
    return pairs.select(
        "row_id", F.when(update, "updated").otherwise("added").alias("merge_action"),
        F.when(update & (new < old), F.col("old_status")).otherwise(F.col("new_status")).alias("status"),
        F.when(update, F.array_union("old_notes", "new_notes")).otherwise(F.col("new_notes")).alias("notes"),
    )


def merge_care_plans(pairs: DataFrame) -> DataFrame:
    """Update on a closing status, more activities or the same start; activities are united."""
    closing = F.col("new_status").isin("completed", "revoked", "on-hold") & (F.col("new_status") != F.col("old_status"))
    update = closing | (F.size("new_notes") > F.size("old_notes")) | F.coalesce(F.col("new_at") == F.col("old_at"), F.lit(False))
    return pairs.select(
        "row_id", F.when(update, "updated").otherwise("added").alias("merge_action"), F.col("new_status").alias("status"),
        F.when(update, F.array_union("old_notes", "new_notes")).otherwise(F.col("new_notes")).alias("notes"),
    )


def merge_result(actions: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates of a merge run."""
    a = F.col("merge_action")
    return actions.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(a.isin("added", "added_as_sequence")).alias("added"), F.count_if(a == "updated").alias("updated"),
        F.count_if(a.isin("skipped", "kept_existing")).alias("skipped"), F.count_if(a == "flagged_for_review").alias("flagged"),
        F.sum("conflicts").alias("conflicts"), F.sum("resolved").alias("resolved"),
        S.percent(F.count_if(a != "flagged_for_review"), F.count("*"), 2).alias("success_rate"),
        S.percent(F.sum("resolved"), F.sum("conflicts"), 2).alias("resolution_rate"),
    )


def row_issues(rows: DataFrame) -> DataFrame:
    """What is wrong with incoming typed rows: ``resource_type, resource_id, patient_id, severity, issue``, one row per broken rule.

    Rows without type, id or patient cannot be merged (error); others miss
    their code, content or date, or have a confidence outside 0 to 1.
    """
    c = F.col

    def blank(column: str) -> Column:
        return F.coalesce(F.trim(c(column).cast("string")) == "", F.lit(True))

    rules = [
        (blank("resource_type"), "error", "missing type"), (blank("resource_id"), "error", "missing id"), (blank("patient_id"), "error", "missing patient"),
        (blank("code"), "warning", "missing code"), (blank("body"), "warning", "missing content"), (c("updated_at").isNull(), "warning", "missing date"),
        (F.coalesce((c("confidence") < 0) | (c("confidence") > 1), F.lit(False)), "warning", "confidence out of range"),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"))) for broken, severity, issue in rules]))
    return rows.select("resource_type", "resource_id", "patient_id", F.inline(found))


def merge_run(existing: DataFrame, new: DataFrame, run_ts: str) -> dict[str, DataFrame]:
    """Whole merge of typed rows: validate, replace, deduplicate, keep provenance and counts.

    Rows are ``(patient_id, resource_type, resource_id, source_id, code, body, updated_at, confidence)``.
    Rows with an error of ``row_issues`` are not merged.
    """
    from chartmill.operators.dedup import first_per_key, rank_order

    usable = new.filter("trim(resource_type) <> '' AND trim(CAST(resource_id AS STRING)) <> '' AND patient_id IS NOT NULL")
    merged = merge_documents(existing, usable)
    order = rank_order(F.col("confidence"), F.col("resource_type"), F.col("resource_id"))
    kept = first_per_key(merged, [F.col("patient_id"), F.col("resource_type"), F.col("code"), F.col("body"), F.col("updated_at")], order)
    return {
        "store": kept, "issues": row_issues(new), "provenance": provenance_rows(usable, "merge", run_ts),
        "counts": _run_counts(existing, usable),
    }


def _run_counts(existing: DataFrame, usable: DataFrame) -> DataFrame:
    """Rows per type after replacing, after deduplication and of the incoming documents, in one pass.

    Which row of a key stays doesn't matter for them, so keys move without the rows behind them.
    """
    key = ["patient_id", "resource_type", "code", "body", "updated_at"]
    marked = [df.select(*key, "source_id", F.lit(n).cast("bigint").alias("__in")) for df, n in ((existing, 0), (usable, 1))]
    per_key = merge_documents(*marked).groupBy(*key).agg(F.count("*").alias("merged"), F.sum("__in").alias("incoming"))
    return per_key.groupBy("resource_type").agg(F.sum("merged").alias("merged"), F.count("*").alias("kept"), F.sum("incoming").alias("incoming"))


# ---------------------------------------------------------------- versions
def field_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Added, removed and changed fields per row, as (path, change, before, after)."""

    def long(df):
        pairs = F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("v")) for c in columns])
        return df.select(key, F.inline(pairs)).filter("v IS NOT NULL")

    both = long(old).withColumnRenamed("v", "before").join(long(new).withColumnRenamed("v", "after"), [key, "path"], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL")


def version_table(events: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Slowly changing history: version number, validity, current flag, status transition.

    The next row's start closes a version; it is found by looking ahead.
    """
    rows = numbered(previous_row(events, keys, [at, tie], ["status"]), keys, [at, tie], "version")
    nxt = rows.select(*keys, (F.col("version") - 1).alias("version"), F.col(at).alias("valid_to"))
    rows = rows.join(nxt, [*keys, "version"], "left")
    moved = F.when(F.col("prev_status").isNotNull() & (F.col("prev_status") != F.col("status")), F.concat_ws(">", "prev_status", "status"))
    return rows.select(*keys, tie, "status", "version", F.col(at).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"), moved.alias("transition"))


def version_gaps(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring version numbers more than one apart; ``version_id`` may read '3.historical'."""
    number = F.substring_index("version_id", ".", 1).try_cast("bigint")
    rows = versions.select(*keys, number.alias("number")).filter("number IS NOT NULL").distinct()
    rows = previous_row(rows, keys, ["number"], ["number"])
    return rows.filter("number - prev_number > 1").select(*keys, F.col("prev_number").alias("from_version"), F.col("number").alias("to_version"))


def provenance_rows(rows: DataFrame, activity: str, run_ts: str, agent: str = "system") -> DataFrame:
    """Append-only lineage of the rows an operator wrote; ids are hashes, so a retry writes the same rows."""
    target = F.concat_ws("/", "resource_type", "resource_id")
    return rows.select(
        F.sha2(F.concat_ws("|", target, F.col("source_id").cast("string"), F.lit(activity), F.lit(run_ts)), 256).alias("provenance_id"),
        target.alias("target"), F.lit(activity).alias("activity"), F.lit(run_ts).cast("timestamp_ntz").alias("recorded"),
        F.lit(agent).alias("agent"), F.col("source_id").cast("string").alias("source"),
    )


# ---------------------------------------------------------------- decisions
def apply_decisions(records: DataFrame, decisions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Records with accepted field decisions applied; ``decisions(patient_id, field_name, decision, new_value)``."""
    take = decisions.filter(F.col("decision").isin("use_extracted", "manual_edit"))
    wide = take.groupBy("patient_id").pivot("field_name", list(fields)).agg(F.max("new_value"))
    out = records.join(wide.select("patient_id", *[F.col(f).alias(f"__{f}") for f in fields]), "patient_id", "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def decision_audit(records: DataFrame, decisions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Audit rows of fields that really change."""
    return field_diff(records, apply_decisions(records, decisions, fields), "patient_id", fields).filter("change <> 'removed'")


def pending_documents(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents not completed and merged before."""
    return docs.join(done, "doc_id", "left_anti")


def chunk_work(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks still to extract: no succeeded ledger entry with the same content."""
    ok = ledger.filter("status = 'succeeded'").select("doc_id", "chunk_index", "content_hash")
    return chunks.join(ok, ["doc_id", "chunk_index", "content_hash"], "left_anti")


def chunk_reuse(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    ok = ledger.filter("status = 'succeeded'").select("doc_id", "chunk_index", "content_hash")
    return chunks.join(ok, ["doc_id", "chunk_index", "content_hash"], "left_semi")


def combine_chunks(items: DataFrame) -> DataFrame:
    """Items of a document and kind in chunk order (at most 25 chunks a document)."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "item")))
    return items.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda s: s["item"]), " ").alias("items"))


def with_profile(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Named active merge profile of each run, else the default one."""
    active = profiles.filter("is_active")
    named = active.select(F.col("name").alias("profile"), F.col("strategy").alias("__named"))
    default = active.filter("is_default").agg(F.min_by("strategy", "name").alias("__default"))
    out = runs.join(named, "profile", "left").crossJoin(F.broadcast(default))  # one row
    return out.withColumn("strategy", F.coalesce("__named", "__default")).drop("__named", "__default")


def audit_rows(decisions: DataFrame, event: str, run_ts: str) -> DataFrame:
    """Audit entries of decisions without personal values."""
    return decisions.select(
        F.lit(event).alias("event_type"), F.lit(run_ts).cast("timestamp_ntz").alias("logged_at"), "doc_id",
        F.when(F.col("review") == "flagged", "warning").otherwise("info").alias("severity"), F.lit(True).alias("phi_involved"),
        F.concat_ws(" ", F.lit(event), F.lit("document"), F.col("doc_id").cast("string"), F.col("review")).alias("description"),
        F.coalesce("reason", F.lit("")).alias("details"),
    )


def set_clinical_dates(parsed: DataFrame, updates: DataFrame, run_ts: str) -> DataFrame:
    """Set or verify the clinical date of parsed rows; the rest stays as it is."""
    u = updates.select("doc_id", F.col("clinical_date").alias("__date"), F.col("verify").alias("__verify"), F.col("reviewer").alias("__by"))
    out = parsed.join(u, "doc_id", "left")
    touched = F.col("__by").isNotNull()
    return out.withColumns({
        "date_source": F.when(F.col("__date").isNotNull(), "manual").otherwise(F.col("date_source")),
        "date_status": F.when(F.col("__verify"), "verified").when(touched, "pending").otherwise(F.col("date_status")),
        "date_by": F.coalesce("__by", "date_by"), "clinical_date": F.coalesce("__date", "clinical_date"),
        "date_at": F.when(touched, F.lit(run_ts).cast("timestamp_ntz")).otherwise(F.col("date_at")),
    }).drop("__date", "__verify", "__by")


def apply_reviews(parsed: DataFrame, reviews: DataFrame) -> DataFrame:
    """Approve or reject rows; an approved row counts as merged."""
    r = reviews.select("doc_id", F.col("verdict").alias("__v"), F.col("reviewer").alias("__by"))
    out = parsed.join(r, "doc_id", "left")
    return out.withColumns({
        "review": F.coalesce("__v", "review"), "reviewer": F.coalesce("__by", "reviewer"),
        "is_merged": F.when(F.col("__v") == "approved", True).when(F.col("__v") == "rejected", False).otherwise(F.col("is_merged")),
    }).drop("__v", "__by")
