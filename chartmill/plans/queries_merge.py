"""Queries for merging, conflicts, versions and decisions."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators import decisions as DC
from chartmill.operators import merge as G
from chartmill.plans.catalog import query
from chartmill.plans.sqltext import case_map, half, pct

_OLD = "SELECT * FROM resources WHERE source_id % 5 <> 0 OR patient_id % 2 = 0"
_NEW = "SELECT resource_type, resource_id || 'n' AS resource_id, patient_id, source_id, updated_at, confidence, code, body FROM resources WHERE source_id % 5 = 0 AND patient_id % 3 = 0"
_STORE = f"""old AS ({_OLD}), inc AS ({_NEW}), store AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.patient_id = o.patient_id AND i.source_id = o.source_id) UNION ALL SELECT * FROM inc)"""


def _store(t):
    return G.merge_documents(t.sql(_OLD), t.sql(_NEW))


@query("idempotent_merge", f"WITH {_STORE} SELECT resource_id, patient_id, source_id FROM store")
def _(t):
    return _store(t).select("resource_id", "patient_id", "source_id")


@query("idempotent_merge_repeated", f"WITH {_STORE} SELECT patient_id, resource_type, count(*) AS n FROM store GROUP BY ALL")
def _(t):
    twice = G.merge_documents(_store(t), t.sql(_NEW))
    return twice.groupBy("patient_id", "resource_type").agg(F.count("*").alias("n"))


@query("rollback_document", f"WITH {_STORE} SELECT resource_id FROM store WHERE source_id NOT IN (5, 10)")
def _(t):
    return G.roll_back(_store(t), [5, 10]).select("resource_id")


@query("rollback_counts", f"WITH {_STORE} SELECT patient_id, resource_type, count(*) AS removed FROM store WHERE source_id IN (5, 10) GROUP BY ALL")
def _(t):
    return G.rolled_back_counts(_store(t), [5, 10])


_UP = "SELECT obs_id, value + 1 AS value, unit FROM observations WHERE source_id % 4 = 0 UNION ALL SELECT 'new-' || obs_id, value, unit FROM observations WHERE source_id % 9 = 0"


@query(
    "upsert_with_version",
    f"""WITH e AS (SELECT obs_id, value, unit, 3 AS version FROM observations), n AS ({_UP})
        SELECT obs_id, coalesce(n.value, e.value) AS value, coalesce(n.unit, e.unit) AS unit, CASE WHEN e.version IS NULL THEN 1 WHEN n.obs_id IS NOT NULL THEN 4 ELSE 3 END AS version FROM e FULL JOIN n USING (obs_id)""",
)
def _(t):
    return G.upsert(t.observations.select("obs_id", "value", "unit", F.lit(3).alias("version")), t.sql(_UP), ["obs_id"], ["value", "unit"])


@query("merge_patient_records", "SELECT CASE WHEN patient_id % 10 = 1 THEN patient_id - 1 ELSE patient_id END AS patient_id, count(*) AS n FROM resources GROUP BY 1")
def _(t):
    moves = t.patients.filter("patient_id % 10 = 1").selectExpr("patient_id", "patient_id - 1 AS target_id")
    return G.merge_patients(t.resources, moves).groupBy("patient_id").agg(F.count("*").alias("n"))


# fields of a pair and their types; kinds: (resource type, table, row id, key, fields)
PAIR_FIELDS = {"value": "DOUBLE", "status": "STRING", "unit": "STRING", "at": "TIMESTAMP", "onset": "STRING", "severity": "STRING", "dosage": "STRING", "name": "STRING", "birth": "STRING", "confidence": "DOUBLE"}
PAIR_KINDS = [
    ("Observation", "observations", "obs_id", "loinc", {"value": "value", "unit": "unit", "at": "effective_at", "confidence": "1.0 - confidence_gap"}),
    ("Condition", "conditions", "condition_id", "code", {"status": "status", "onset": "onset_text", "severity": "severity", "at": "updated_at", "confidence": "confidence"}),
    ("MedicationStatement", "medications", "med_id", "name", {"status": "status", "onset": "start_date", "dosage": "dose"}),
]


def _pair_sql(kind, table, row, key, fields):
    """New rows (by source) next to the first old row of the same patient and key."""
    columns = {k: f"CAST({fields.get(k, 'NULL')} AS {t})" for k, t in PAIR_FIELDS.items()}
    listed = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    n, o = (", ".join(f"{a}.{k} AS {b}_{k}" for k in columns) for a, b in (("n", "new"), ("o", "old")))
    return f"""SELECT '{kind}' AS resource_type, n.row_id AS row_id, n.patient_id AS patient_id, {n}, {o}
      FROM (SELECT {row} AS row_id, patient_id, {key} AS fk, {listed} FROM {table} WHERE source_id % 3 = 0) n
      JOIN (SELECT patient_id AS fp, {key} AS fk, min({row}) AS first_id FROM {table} WHERE source_id % 3 <> 0 GROUP BY patient_id, {key}) f ON f.fp = n.patient_id AND f.fk = n.fk
      JOIN (SELECT {row} AS row_id, {listed} FROM {table}) o ON o.row_id = f.first_id"""


PAIRS = " UNION ALL ".join(_pair_sql(*k) for k in PAIR_KINDS)


def _pair(t, kind, table, row, key, fields):
    """The same from one pass for the new rows and one for the first old ones."""
    columns = [F.expr(f"CAST({fields.get(k, 'NULL')} AS {kind_})").alias(k) for k, kind_ in PAIR_FIELDS.items()]
    rows = getattr(t, table).select("source_id", "patient_id", F.col(key).alias("fk"), F.col(row).alias("row_id"), F.struct(*columns).alias("f"))
    first = rows.filter("source_id % 3 <> 0").groupBy("patient_id", "fk").agg(F.min_by("f", "row_id").alias("o"))
    new = rows.filter("source_id % 3 = 0").join(first, ["patient_id", "fk"])
    return new.select(F.lit(kind).alias("resource_type"), "row_id", "patient_id", *[F.col(f"f.{k}").alias(f"new_{k}") for k in PAIR_FIELDS], *[F.col(f"o.{k}").alias(f"old_{k}") for k in PAIR_FIELDS])


def pairs(t):
    return reduce(DataFrame.unionByName, [_pair(t, *k) for k in PAIR_KINDS])


_SIMPLE = [
    ("resource_type = 'Observation' AND new_value <> old_value", "value_mismatch", "value", "'medium'"),
    ("resource_type = 'Observation' AND new_at = old_at", "temporal_conflict", "at", "'low'"),
    ("resource_type <> 'Observation' AND new_status <> old_status", "status_conflict", "status", "CASE WHEN resource_type = 'Condition' THEN 'medium' ELSE 'low' END"),
]
_SHARE = "abs(new_value - old_value) / greatest(abs(new_value), abs(old_value)) * 100"
_SWAP = "((new_status = 'active' AND old_status IN ('resolved', 'inactive')) OR (old_status = 'active' AND new_status IN ('resolved', 'inactive')))"
_GRADED = [
    ("resource_type = 'Observation' AND new_value <> old_value", "value_mismatch", "value", f"CASE WHEN {_SHARE} > 50 THEN 'high' WHEN {_SHARE} >= 20 THEN 'medium' ELSE 'low' END"),
    ("resource_type = 'Observation' AND abs(epoch(new_at) - epoch(old_at)) > 3600", "temporal_conflict", "at", "'medium'"),
    ("resource_type = 'Observation' AND new_unit <> old_unit AND new_unit <> '' AND old_unit <> ''", "unit_mismatch", "unit", "'high'"),
    ("resource_type = 'Condition' AND new_status <> old_status", "status_conflict", "status", f"CASE WHEN {_SWAP} THEN 'high' ELSE 'medium' END"),
    ("resource_type = 'Condition' AND new_onset <> old_onset", "temporal_conflict", "onset", "'medium'"),
    ("resource_type = 'Condition' AND new_severity <> old_severity", "severity_conflict", "severity", "'medium'"),
    ("resource_type = 'MedicationStatement' AND new_dosage <> old_dosage", "dosage_conflict", "dosage", "'high'"),
    ("resource_type = 'MedicationStatement' AND new_status <> old_status", "status_conflict", "status", "'medium'"),
    ("resource_type = 'MedicationStatement' AND new_onset <> old_onset", "temporal_conflict", "period", "'medium'"),
]


def _conf_sql(rules, more=""):
    return " UNION ALL ".join(f"SELECT {more}row_id, resource_type, '{k}' AS conflict, '{f}' AS field, {s} AS severity FROM pr WHERE {w}" for w, k, f, s in rules)


@query("detect_conflicts", f"WITH pr AS ({PAIRS}) {_conf_sql(_SIMPLE)}")
def _(t):
    return G.simple_conflicts(pairs(t), "row_id")


@query("graded_conflicts", f"WITH pr AS ({PAIRS}) {_conf_sql(_GRADED)}")
def _(t):
    return G.graded_conflicts(pairs(t), "row_id")


_CONFIG = {"conflict_type": {"unit_mismatch": "manual_review"}, "resource_type": {"MedicationStatement": "confidence_based"}}
_NEWEST = "CASE WHEN old_at > new_at OR (old_at IS NOT NULL AND new_at IS NULL) THEN 'keep_existing' ELSE 'keep_new' END"
_RESOLVED = f"""pr AS MATERIALIZED (SELECT row_number() OVER () AS pair, * FROM ({PAIRS})), cf AS MATERIALIZED ({_conf_sql(_GRADED, "pair, ")}), st AS (SELECT cf.*, pr.new_at, pr.old_at, pr.new_confidence AS nc, pr.old_confidence AS oc,
     CASE WHEN conflict = 'unit_mismatch' THEN 'manual_review' WHEN cf.resource_type = 'MedicationStatement' THEN 'confidence_based' ELSE {case_map('severity', G.SEVERITY_STRATEGY)} END AS strategy FROM cf JOIN pr USING (pair)),
   rs AS (SELECT pair, row_id, resource_type, conflict, field, severity, strategy, CASE strategy WHEN 'newest_wins' THEN {_NEWEST} WHEN 'preserve_both' THEN 'preserve_both' WHEN 'manual_review' THEN 'flag_for_review'
     ELSE CASE WHEN oc > nc THEN 'keep_existing' WHEN nc > oc THEN 'keep_new' ELSE {_NEWEST} END END AS action FROM st),
   pa AS (SELECT pair, resource_type, row_id, arg_max(action, {case_map('action', G.ACTION_PRIORITY)}) AS action, count(*) AS conflicts, count(*) FILTER (action <> 'flag_for_review') AS resolved,
     count(*) FILTER (action = 'flag_for_review') AS open, bool_or(severity = 'critical') AS critical FROM rs GROUP BY 1, 2, 3)"""


@query("resolve_conflicts", f"WITH {_RESOLVED} SELECT * EXCLUDE (pair) FROM rs")
def _(t):
    return G.resolved(pairs(t), "row_id", _CONFIG)


@query("predominant_actions", f"WITH {_RESOLVED} SELECT * EXCLUDE (pair) FROM pa")
def _(t):
    return G.predominant_actions(pairs(t), "row_id", _CONFIG)


_ACTIONS = f"""{_RESOLVED}, ma AS (SELECT pr.row_id, pr.resource_type, coalesce(conflicts, 0) AS conflicts, coalesce(resolved, 0) AS resolved, CASE pr.resource_type
     WHEN 'Observation' THEN CASE WHEN new_value = old_value AND new_at = old_at THEN 'skipped' WHEN action = 'keep_existing' THEN 'kept_existing' WHEN coalesce(conflicts, 0) > 0 THEN 'added_as_sequence' ELSE 'added' END
     WHEN 'Condition' THEN CASE WHEN new_status = old_status AND new_severity = old_severity THEN 'skipped' WHEN critical THEN 'flagged_for_review' WHEN new_at > old_at THEN 'updated' ELSE 'skipped' END ELSE 'added' END AS merge_action
   FROM pr LEFT JOIN pa USING (pair))"""


def _actions(t):
    same = F.when(F.col("resource_type") == "Observation", (F.col("new_value") == F.col("old_value")) & (F.col("new_at") == F.col("old_at"))).otherwise(
        (F.col("new_status") == F.col("old_status")) & (F.col("new_severity") == F.col("old_severity"))
    )
    return G.merge_actions(pairs(t).withColumns({"matched": F.lit(True), "duplicate": F.coalesce(same, F.lit(False))}), "row_id", _CONFIG)


@query("merge_actions", f"WITH {_ACTIONS} SELECT row_id, resource_type, merge_action, conflicts, resolved FROM ma")
def _(t):
    return _actions(t)


@query(
    "merge_result_rates",
    f"""WITH {_ACTIONS} SELECT resource_type, count(*) AS rows, count(*) FILTER (merge_action IN ('added', 'added_as_sequence')) AS added, count(*) FILTER (merge_action = 'updated') AS updated,
          count(*) FILTER (merge_action IN ('skipped', 'kept_existing')) AS skipped, count(*) FILTER (merge_action = 'flagged_for_review') AS flagged, CAST(sum(conflicts) AS BIGINT) AS conflicts, CAST(sum(resolved) AS BIGINT) AS resolved,
          {pct("count(*) FILTER (merge_action <> 'flagged_for_review')", 'count(*)', 2)} AS success_rate, {pct('sum(resolved)', 'sum(conflicts)', 2)} AS resolution_rate FROM ma GROUP BY 1""",
)
def _(t):
    return G.merge_result(_actions(t), "resource_type")


_SPECIAL = """SELECT encounter_id AS row_id, started_at AS new_at, started_at + INTERVAL '1' HOUR * CAST(encounter_id % 40 AS INT) AS old_at, CASE WHEN encounter_id % 3 = 0 THEN 'healed' END AS new_outcome,
   CASE WHEN encounter_id % 5 = 0 THEN 'stable' END AS old_outcome, CASE encounter_id % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'preliminary' WHEN 2 THEN 'amended' ELSE 'registered' END AS new_status,
   CASE encounter_id % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'partial' ELSE 'corrected' END AS old_status, CASE encounter_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' WHEN 2 THEN 'revoked' ELSE 'draft' END AS plan_status,
   'n' || CAST(encounter_id % 6 AS STRING) AS note_a, 'n' || CAST(encounter_id % 4 AS STRING) AS note_b, enc_class AS note_c, encounter_id % 7 AS id_a, encounter_id % 9 AS id_b FROM encounters"""


def _special(t):
    return t.sql(_SPECIAL).withColumns({
        "new_notes": F.array("note_a", "note_c"), "old_notes": F.array("note_b"), "new_ids": F.array("id_a"), "old_ids": F.array("id_b"),
    })


_UNION = "list_distinct([note_b, note_a, note_c])"


def _notes(update):
    return f"CASE WHEN {update} THEN array_to_string(list_filter([note_b, note_a, note_c], lambda x, i: list_position([note_b, note_a, note_c], x) = i), ',') ELSE note_a || ',' || note_c END AS notes"


def _flat(df):
    return df.withColumn("notes", F.array_join("notes", ","))


_PU = "(abs(epoch(new_at) - epoch(old_at)) / 3600 <= 24 OR (new_outcome IS NOT NULL AND old_outcome IS NULL))"


@query("merge_procedures", f"WITH s AS ({_SPECIAL}) SELECT row_id, CASE WHEN {_PU} THEN 'updated' ELSE 'added' END AS merge_action, CASE WHEN {_PU} THEN coalesce(new_outcome, old_outcome) ELSE new_outcome END AS outcome, {_notes(_PU)} FROM s")
def _(t):
    return _flat(G.merge_procedures(_special(t)))


_LV = case_map("new_status", G.REPORT_LEVEL), case_map("old_status", G.REPORT_LEVEL)
_RU = f"({_LV[0]} > {_LV[1]} OR id_a = id_b)"


@query("merge_reports", f"WITH s AS ({_SPECIAL}) SELECT row_id, CASE WHEN {_RU} THEN 'updated' ELSE 'added' END AS merge_action, CASE WHEN {_RU} AND {_LV[0]} < {_LV[1]} THEN old_status ELSE new_status END AS status, {_notes(_RU)} FROM s")
def _(t):
    return _flat(G.merge_reports(_special(t)))


_CU = "((plan_status IN ('completed', 'revoked', 'on-hold')) OR 2 > 1)"


@query("merge_care_plans", f"WITH s AS ({_SPECIAL}) SELECT row_id, CASE WHEN {_CU} THEN 'updated' ELSE 'added' END AS merge_action, plan_status AS status, {_notes(_CU)} FROM s")
def _(t):
    rows = _special(t).drop("new_status", "old_status").withColumns({"new_status": F.col("plan_status"), "old_status": F.lit("active")})
    return _flat(G.merge_care_plans(rows))


# some incoming rows are broken
_BROKEN = f"""SELECT CASE WHEN patient_id % 18 = 0 THEN ' ' ELSE resource_type END AS resource_type, CASE WHEN patient_id % 15 = 0 THEN NULL ELSE resource_id END AS resource_id, patient_id, source_id,
    CASE WHEN patient_id % 9 <> 0 THEN updated_at END AS updated_at, CASE WHEN patient_id % 12 = 0 THEN confidence + 1 ELSE confidence END AS confidence, CASE WHEN patient_id % 6 = 0 THEN '' ELSE code END AS code, body FROM ({_NEW}) AS n"""
_RUN = f"""old AS ({_OLD}), new AS ({_BROKEN}), inc AS (SELECT * FROM new WHERE trim(resource_type) <> '' AND resource_id IS NOT NULL),
    store AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.patient_id = o.patient_id AND i.source_id = o.source_id) UNION ALL BY NAME SELECT * FROM inc)"""


@query(
    "merge_run_counts",
    f"""WITH {_RUN}, b AS (SELECT resource_type, count(*) AS merged FROM store GROUP BY 1), a AS (SELECT resource_type, count(*) AS kept FROM (SELECT DISTINCT patient_id, resource_type, code, body, updated_at FROM store) GROUP BY 1),
        c AS (SELECT resource_type, count(*) AS incoming FROM inc GROUP BY 1) SELECT resource_type, merged, coalesce(kept, 0) AS kept, coalesce(incoming, 0) AS incoming FROM b LEFT JOIN a USING (resource_type) LEFT JOIN c USING (resource_type)""",
)
def _(t):
    return G.merge_run(t.sql(_OLD), t.sql(_BROKEN), "2024-06-15 00:00:00")["counts"]


@query(
    "merge_run_issues",
    f"""WITH new AS ({_BROKEN}) SELECT resource_type, resource_id, patient_id, severity, issue FROM new, LATERAL (
          SELECT 'error' AS severity, 'missing type' AS issue WHERE trim(resource_type) = '' UNION ALL SELECT 'error', 'missing id' WHERE resource_id IS NULL UNION ALL SELECT 'warning', 'missing code' WHERE trim(code) = ''
          UNION ALL SELECT 'warning', 'missing content' WHERE coalesce(trim(body), '') = '' UNION ALL SELECT 'warning', 'missing date' WHERE updated_at IS NULL UNION ALL SELECT 'warning', 'confidence out of range' WHERE confidence > 1)""",
)
def _(t):
    return G.merge_run(t.sql(_OLD), t.sql(_BROKEN), "2024-06-15 00:00:00")["issues"]


_A = "SELECT patient_id, first_name, last_name, phone, living_setting, CASE WHEN patient_id % 4 <> 0 THEN gender END AS gender FROM patients"
_B = "SELECT patient_id, first_name, CASE WHEN patient_id % 5 = 0 THEN last_name || '-X' ELSE last_name END AS last_name, CASE WHEN patient_id % 7 <> 0 THEN phone END AS phone, living_setting, gender FROM patients WHERE patient_id % 11 <> 0"
_DIFF_FIELDS = ["first_name", "last_name", "phone", "living_setting", "gender"]


def _long(table):
    return " UNION ALL ".join(f"SELECT patient_id, '{c}' AS path, {c} AS v FROM {table} WHERE {c} IS NOT NULL" for c in _DIFF_FIELDS)


@query(
    "field_diff",
    f"""WITH a AS ({_A}), b AS ({_B}), x AS ({_long('a')}), y AS ({_long('b')}) SELECT patient_id, path, x.v AS before, y.v AS after,
          CASE WHEN x.v IS NULL THEN 'added' WHEN y.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL JOIN y USING (patient_id, path) WHERE x.v IS DISTINCT FROM y.v""",
)
def _(t):
    return G.field_diff(t.sql(_A), t.sql(_B), "patient_id", _DIFF_FIELDS)


@query(
    "version_timeline",
    """WITH v AS (SELECT patient_id, encounter_id, status, started_at, row_number() OVER p AS version, lead(started_at) OVER p AS valid_to, lag(status) OVER p AS prev FROM encounters WINDOW p AS (PARTITION BY patient_id ORDER BY started_at, encounter_id))
       SELECT patient_id, encounter_id, status, version, started_at AS valid_from, valid_to, valid_to IS NULL AS is_current, CASE WHEN prev <> status THEN prev || '>' || status END AS transition FROM v""",
)
def _(t):
    return G.version_table(t.encounters, ["patient_id"], "started_at", "encounter_id")


@query(
    "status_transitions",
    """WITH v AS (SELECT patient_id, status, lag(status) OVER (PARTITION BY patient_id ORDER BY started_at, encounter_id) AS prev FROM encounters) SELECT prev AS from_status, status AS to_status, count(*) AS n FROM v WHERE prev <> status GROUP BY ALL""",
)
def _(t):
    rows = G.version_table(t.encounters, ["patient_id"], "started_at", "encounter_id").filter("transition IS NOT NULL")
    return rows.groupBy(F.substring_index("transition", ">", 1).alias("from_status"), F.substring_index("transition", ">", -1).alias("to_status")).agg(F.count("*").alias("n"))


_VER = "SELECT user_id AS item_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 300 AS STRING) || '.historical' WHEN event_id % 50 = 1 THEN 'draft' ELSE CAST(event_id % 300 AS STRING) END AS version_id FROM events"


@query(
    "version_gaps",
    f"""WITH n AS (SELECT DISTINCT item_id, TRY_CAST(split_part(version_id, '.', 1) AS BIGINT) AS v FROM ({_VER})), l AS (SELECT item_id, v, lag(v) OVER (PARTITION BY item_id ORDER BY v) AS p FROM n WHERE v IS NOT NULL)
        SELECT item_id, p AS from_version, v AS to_version FROM l WHERE v - p > 1""",
)
def _(t):
    return G.version_gaps(t.sql(_VER), ["item_id"])


@query(
    "merge_provenance",
    "SELECT sha256(resource_type || '/' || resource_id || '|' || source_id || '|merge|2024-06-15 00:00:00') AS provenance_id, resource_type || '/' || resource_id AS target, 'merge' AS activity, TIMESTAMP '2024-06-15 00:00:00' AS recorded, 'system' AS agent, CAST(source_id AS STRING) AS source FROM resources",
)
def _(t):
    return G.provenance_rows(t.resources, "merge", "2024-06-15 00:00:00")


_DEC = """SELECT patient_id, 'last_name' AS field_name, CASE patient_id % 3 WHEN 0 THEN 'use_extracted' WHEN 1 THEN 'keep_existing' ELSE 'manual_edit' END AS decision, upper(last_name) AS new_value FROM patients WHERE patient_id % 2 = 0
   UNION ALL SELECT patient_id, 'phone', 'use_extracted', CASE WHEN patient_id % 8 = 0 THEN phone ELSE '555' END FROM patients WHERE patient_id % 4 = 0"""
_APPLIED = f"d AS (SELECT * FROM ({_DEC}) WHERE decision <> 'keep_existing')"


@query(
    "apply_field_decisions",
    f"""WITH {_APPLIED} SELECT p.patient_id, coalesce(a.new_value, p.last_name) AS last_name, coalesce(b.new_value, p.phone) AS phone FROM patients p
        LEFT JOIN d a ON a.patient_id = p.patient_id AND a.field_name = 'last_name' LEFT JOIN d b ON b.patient_id = p.patient_id AND b.field_name = 'phone'""",
)
def _(t):
    return G.apply_decisions(t.patients.select("patient_id", "last_name", "phone"), t.sql(_DEC), ["last_name", "phone"])


@query(
    "field_decision_audit",
    f"""WITH {_APPLIED} SELECT p.patient_id, d.field_name AS path, 'changed' AS change, CASE d.field_name WHEN 'phone' THEN p.phone ELSE p.last_name END AS before, d.new_value AS after FROM patients p JOIN d USING (patient_id)
        WHERE d.new_value <> CASE d.field_name WHEN 'phone' THEN p.phone ELSE p.last_name END""",
)
def _(t):
    return G.decision_audit(t.patients.select("patient_id", "last_name", "phone"), t.sql(_DEC), ["last_name", "phone"])


# several decisions of one field, by different reviewers
_REVIEWS = """SELECT change_id AS decision_id, created_at AS decided_at, patient_id % 60 AS patient_id,
        CASE change_id % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'date_of_birth' WHEN 2 THEN 'mrn' WHEN 3 THEN 'last_name' ELSE 'shoe_size' END AS field_name,
        CASE change_id % 4 WHEN 0 THEN 'use_extracted' WHEN 1 THEN 'manual_edit' WHEN 2 THEN 'use_extracted' ELSE CASE WHEN change_id % 3 = 0 THEN 'pending' ELSE 'keep_existing' END END AS resolution,
        CASE WHEN change_id % 17 = 0 THEN ' ' WHEN change_id % 5 = 0 THEN CASE WHEN change_id % 7 = 0 THEN '555' ELSE '(555) 010-' || CAST(1000 + change_id % 9000 AS STRING) END
             WHEN change_id % 5 = 1 THEN CASE WHEN change_id % 7 = 0 THEN 'soon' ELSE CAST(1 + change_id % 12 AS STRING) || '/' || CAST(1 + change_id % 28 AS STRING) || '/1970' END
             WHEN change_id % 5 = 2 THEN CASE WHEN change_id % 7 = 0 THEN 'MRN' || CAST(100000 + change_id % 60 AS STRING) ELSE 'NEW' || CAST(change_id AS STRING) END
             ELSE 'Name' || CAST(change_id AS STRING) END AS new_value, confidence
    FROM field_audit"""
_FIELDS = ["last_name", "phone", "mrn", "date_of_birth"]
_VALUES = "SELECT patient_id, last_name, phone, mrn, CAST(birth_date AS STRING) AS date_of_birth FROM patients"
_FIELD_CTE = f"v AS ({_VALUES}), f AS (" + " UNION ALL ".join(f"SELECT patient_id, '{x}' AS field_name, {x} AS value FROM v" for x in _FIELDS) + f"), r AS ({_REVIEWS})"
_CHECKED = f"""{_FIELD_CTE}, k AS (
    SELECT r.*, CASE WHEN coalesce(trim(new_value) = '', true) THEN 'missing' WHEN r.field_name = 'shoe_size' THEN 'unknown field'
        WHEN r.field_name = 'date_of_birth' AND try_strptime(new_value, '%m/%d/%Y') IS NULL THEN 'invalid' WHEN r.field_name = 'phone' AND length(regexp_replace(new_value, '[^0-9]', '', 'g')) NOT IN (10, 11) THEN 'invalid'
        WHEN r.field_name = 'mrn' AND EXISTS (SELECT 1 FROM f WHERE f.field_name = 'mrn' AND f.value = r.new_value AND f.patient_id <> r.patient_id) THEN 'taken' END AS error
    FROM r WHERE resolution IN ('use_extracted', 'manual_edit'))"""
_LOG = f"""{_CHECKED}, l AS (
    SELECT k.decision_id, k.patient_id, k.field_name, row_number() OVER w AS version, CASE WHEN row_number() OVER w = 1 THEN f.value ELSE lag(k.new_value) OVER w END AS before, k.new_value AS after
    FROM k LEFT JOIN f USING (patient_id, field_name) WHERE error IS NULL WINDOW w AS (PARTITION BY k.patient_id, k.field_name ORDER BY decided_at, decision_id)
), u AS (
    SELECT l.*, CASE WHEN decision_id % 2 = 0 THEN CASE WHEN version > coalesce(max(version) FILTER (decision_id % 2 <> 0) OVER (PARTITION BY patient_id, field_name), 0) THEN 'undone' ELSE 'blocked' END END AS outcome FROM l)"""


def _decisions(t):
    fields = DC.as_fields(t.sql(_VALUES), _FIELDS)
    return fields, t.sql(_REVIEWS)


def _log(t):
    fields, reviews = _decisions(t)
    checked = DC.check_batch(fields, reviews, _FIELDS)
    return fields, DC.undo_log(fields, checked.filter("error IS NULL"))


@query(
    "decision_preview",
    f"WITH {_FIELD_CTE} SELECT r.patient_id, decision_id, field_name, coalesce(f.value, '') AS current_value, new_value, resolution FROM r LEFT JOIN f USING (patient_id, field_name) WHERE resolution IN ('use_extracted', 'manual_edit')",
)
def _(t):
    return DC.preview(*_decisions(t))


@query(
    "decision_preview_summary",
    f"""WITH r AS ({_REVIEWS}) SELECT patient_id, bool_or(resolution IN ('use_extracted', 'manual_edit')) AS has_changes, count(*) FILTER (resolution IN ('use_extracted', 'manual_edit')) AS total_changes,
        count(*) FILTER (resolution = 'use_extracted' AND confidence >= 0.8) AS high_confidence_changes, count(*) FILTER (resolution = 'manual_edit') AS manual_edits FROM r GROUP BY 1""",
)
def _(t):
    return DC.preview_summary(t.sql(_REVIEWS))


@query("decision_batch", f"WITH {_CHECKED} SELECT decision_id, patient_id, field_name, error FROM k")
def _(t):
    return DC.check_batch(*_decisions(t), _FIELDS).select("decision_id", "patient_id", "field_name", "error")


@query("decision_log", f"WITH {_LOG} SELECT decision_id, patient_id, field_name, version, before, after FROM l")
def _(t):
    return _log(t)[1].select("decision_id", "patient_id", "field_name", F.col("version").cast("bigint").alias("version"), "before", "after")


@query(
    "decision_rollback",
    f"""WITH {_LOG}, s AS (SELECT patient_id, field_name, arg_max(after, version) AS after FROM u WHERE outcome IS DISTINCT FROM 'undone' GROUP BY ALL)
        SELECT patient_id, field_name, coalesce(s.after, f.value) AS value FROM f FULL JOIN s USING (patient_id, field_name)""",
)
def _(t):
    fields, log = _log(t)
    return DC.current_values(fields, DC.roll_back(log, log.filter("decision_id % 2 = 0")))


@query("decision_rollback_outcome", f"WITH {_LOG} SELECT decision_id, outcome FROM u WHERE outcome IS NOT NULL")
def _(t):
    _, log = _log(t)
    return DC.roll_back(log, log.filter("decision_id % 2 = 0")).filter("outcome IS NOT NULL").select("decision_id", "outcome")


@query("pending_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return G.pending_documents(t.documents, t.labels.filter("quality = 1").select("doc_id")).select("doc_id")


_LEDGER = "SELECT conv_id AS doc_id, turn AS chunk_index, CASE WHEN conv_id % 7 = 0 THEN 'changed' ELSE text END AS body, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM conversations"


def _ledger(t):
    return t.sql(_LEDGER).withColumn("content_hash", F.sha2("body", 256))


def _chunks(t):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.sha2("text", 256).alias("content_hash"))


@query("chunk_work_left", "SELECT conv_id AS doc_id, turn AS chunk_index FROM conversations WHERE conv_id % 7 = 0 OR (conv_id + turn) % 3 = 0")
def _(t):
    return G.chunk_work(_chunks(t), _ledger(t)).select("doc_id", "chunk_index")


@query("chunk_results_reused", "SELECT conv_id AS doc_id, turn AS chunk_index FROM conversations WHERE NOT (conv_id % 7 = 0 OR (conv_id + turn) % 3 = 0)")
def _(t):
    return G.chunk_reuse(_chunks(t), _ledger(t)).select("doc_id", "chunk_index")


@query("combine_chunk_results", "SELECT conv_id AS doc_id, role AS kind, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS items FROM conversations GROUP BY ALL")
def _(t):
    return G.combine_chunks(t.conversations.selectExpr("conv_id AS doc_id", "role AS kind", "turn AS chunk", "text AS item"))


@query(
    "merge_profiles",
    "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'preserve_both' ELSE 'newest_wins' END AS strategy FROM pipeline",
)
def _(t):
    profiles = t.spark.createDataFrame(
        [("default", True, True, "newest_wins"), ("careful", False, True, "preserve_both"), ("old", False, False, "manual_review")], "name string, is_default boolean, is_active boolean, strategy string"
    )
    runs = t.pipeline.select("doc_id", F.expr("CASE doc_id % 4 WHEN 1 THEN 'careful' WHEN 2 THEN 'old' WHEN 3 THEN 'missing' END AS profile"))
    return G.with_profile(runs, profiles).select("doc_id", "strategy")


@query(
    "decision_audit_rows",
    """SELECT 'extraction_decision' AS event_type, TIMESTAMP '2024-06-15 00:00:00' AS logged_at, doc_id, CASE WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity, true AS phi_involved,
         'extraction_decision document ' || doc_id || CASE WHEN quality = 0 THEN ' flagged' ELSE ' auto_approved' END AS description, CASE WHEN quality = 0 THEN 'low quality' ELSE '' END AS details FROM labels""",
)
def _(t):
    rows = t.labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN 'flagged' ELSE 'auto_approved' END AS review", "CASE WHEN quality = 0 THEN 'low quality' END AS reason")
    return G.audit_rows(rows, "extraction_decision", "2024-06-15 00:00:00")


_PD = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN DATE '2020-01-01' END AS clinical_date, 'extracted' AS date_source, 'pending' AS date_status, CAST(NULL AS STRING) AS date_by, CAST(NULL AS TIMESTAMP) AS date_at, 'pending' AS review, CAST(NULL AS STRING) AS reviewer, false AS is_merged FROM documents"
_UPDATES = "SELECT doc_id, CASE WHEN quality = 1 THEN DATE '2021-02-03' END AS clinical_date, toxic = 0 AS verify, 'r' || CAST(doc_id % 5 AS STRING) AS reviewer FROM labels"


@query(
    "set_clinical_dates",
    f"""WITH p AS ({_PD}), u AS ({_UPDATES}) SELECT p.doc_id, coalesce(u.clinical_date, p.clinical_date) AS clinical_date, CASE WHEN u.clinical_date IS NOT NULL THEN 'manual' ELSE date_source END AS date_source,
          CASE WHEN verify THEN 'verified' ELSE 'pending' END AS date_status, u.reviewer AS date_by FROM p LEFT JOIN u USING (doc_id)""",
)
def _(t):
    return G.set_clinical_dates(t.sql(_PD), t.sql(_UPDATES), "2024-06-15 00:00:00").select("doc_id", "clinical_date", "date_source", "date_status", "date_by")


@query(
    "apply_reviews",
    """SELECT d.doc_id, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS review, coalesce(quality = 1, false) AS is_merged FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(t):
    reviews = t.labels.selectExpr("doc_id", "CASE quality WHEN 1 THEN 'approved' ELSE 'rejected' END AS verdict", "'r' AS reviewer")
    return G.apply_reviews(t.sql(_PD), reviews).select("doc_id", "review", "is_merged")


@query(
    "custom_merge_handler",
    "SELECT resource_id, CASE resource_type WHEN 'Encounter' THEN 'kept_' || lower(body) ELSE 'added' END AS merge_action FROM resources",
)
def _(t):
    registry = G.HandlerRegistry(lambda df: df.select("resource_id", F.lit("added").alias("merge_action")))
    registry.register("Encounter", lambda df: df.select("resource_id", F.concat(F.lit("kept_"), F.lower("body")).alias("merge_action")))
    return registry.apply(t.resources)


@query(
    "custom_strategy",
    f"""WITH pr AS ({PAIRS}) SELECT row_id, CASE WHEN row_id LIKE '%1' THEN CASE WHEN new_value > old_value THEN 'keep_new' ELSE 'keep_existing' END ELSE {_NEWEST} END AS action FROM pr WHERE resource_type = 'Observation'""",
)
def _(t):
    table = G.with_strategy("highest_wins", lambda na, oa, nv, ov: F.when(nv > ov, "keep_new").otherwise("keep_existing"))
    rows = pairs(t).filter("resource_type = 'Observation'")
    chosen = F.when(F.col("row_id").endswith("1"), "highest_wins").otherwise("newest_wins")
    action = G.resolution(chosen, F.col("new_at"), F.col("old_at"), F.col("new_value"), F.col("old_value"), table)
    return rows.select("row_id", action.alias("action"))
