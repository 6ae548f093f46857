"""Undo log of decisions against a replay in plain Python."""

import random

from chartmill.operators import decisions as DC

DECISIONS = "decision_id bigint, decided_at bigint, patient_id bigint, field_name string, resolution string, new_value string, confidence double"


def frames(spark, decisions):
    fields = spark.createDataFrame([(p, f, f"{f}{p}") for p in range(3) for f in ("last_name", "mrn")], "patient_id bigint, field_name string, value string")
    return fields, spark.createDataFrame(decisions, DECISIONS)


def values(df):
    return {(r.patient_id, r.field_name): r.value for r in df.collect()}


def test_rollback_against_a_replay(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(20), rng.randrange(4), rng.choice(["last_name", "mrn"]), "manual_edit", f"v{k}", 0.9) for k in range(60)]
    fields, decisions = frames(spark, rows)
    log = DC.undo_log(fields, decisions)
    base = values(fields)
    stacks = {}
    for k, at, p, f, _, v, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        stacks.setdefault((p, f), []).append((k, v))
    assert values(DC.current_values(fields, log)) == base | {key: s[-1][1] for key, s in stacks.items()}
    before = {r.decision_id: (r.version, r.before) for r in log.collect()}
    assert all(before[k] == (n + 1, s[n - 1][1] if n else base.get(key)) for key, s in stacks.items() for n, (k, _) in enumerate(s))

    asked = {k for k in range(60) if rng.random() < 0.6}
    once = DC.roll_back(log, log.filter(log.decision_id.isin(list(asked))))
    for s in stacks.values():
        while s and s[-1][0] in asked:
            s.pop()
    left = {k for s in stacks.values() for k, _ in s}
    assert values(DC.current_values(fields, once)) == base | {key: s[-1][1] for key, s in stacks.items() if s}
    assert {r.decision_id: r.outcome for r in once.collect() if r.outcome} == {k: "blocked" if k in left else "undone" for k in asked}
    # a second time changes nothing; taking back what blocked lets the rest go
    twice = DC.roll_back(once.drop("outcome"), log.filter(log.decision_id.isin(list(asked))))
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    every = DC.roll_back(once.drop("outcome"), log)
    assert {r.outcome for r in every.collect()} == {"undone"}
    # fields without a value of their own leave with their decisions
    assert values(DC.current_values(fields, every)) == base


def test_batch_errors(spark):
    cases = [("last_name", " ", "missing"), ("last_name", None, "missing"), ("last_name", "New", None), ("hat", "x", "unknown field"), ("mrn", "ab", "invalid"), ("mrn", "mrn2", "taken"), ("mrn", "mrn1", None),
             ("phone", "555-1234", "invalid"), ("phone", "(555) 010-1234", None), ("date_of_birth", "2/30/1970x", "invalid"), ("date_of_birth", "1970-05-01", None), ("email", "a@b", "invalid"), ("email", "a@b.org", None)]
    fields, decisions = frames(spark, [(k, 0, 1, f, "use_extracted", v, 0.5) for k, (f, v, _) in enumerate(cases)] + [(99, 0, 1, "mrn", "pending", "x", 0.5)])
    got = {r.decision_id: r.error for r in DC.check_batch(fields, decisions, ["last_name", "mrn", "phone", "email", "date_of_birth"]).collect()}
    assert got == {k: e for k, (_, _, e) in enumerate(cases)}
