"""Ordered helpers against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from chartmill.operators.ordered import anchor_groups, last_seen, previous_row, running_total, top_rows, within_distance


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.randrange(0, 3000), i, rng.randrange(1, 100)) for i in range(900)]
    return data, spark.createDataFrame(data, "k int, t bigint, id int, v int").cache()


def per_key(data):
    out = {}
    for k, t, i, v in data:
        out.setdefault(k, []).append((t, i, v))
    return {k: sorted(r) for k, r in out.items()}


def test_previous_row(rows):
    data, df = rows
    want = {}
    for group in per_key(data).values():
        for prev, (_, i, _) in zip([None, *group], group):
            want[i] = prev and (prev[0], prev[2])
    got = previous_row(df, ["k"], ["t", "id"], ["t", "v"]).collect()
    assert {r["id"]: (r["prev_t"], r["prev_v"]) if r["prev_t"] is not None else None for r in got} == want


def test_running_total(rows):
    data, df = rows
    want = {}
    for group in per_key(data).values():
        total = 0
        for _, i, v in group:
            total += v
            want[i] = total
    got = running_total(df, ["k"], ["t", "id"], "v").collect()
    assert {r["id"]: r["running"] for r in got} == want


@pytest.mark.parametrize("radius", [1, 17, 400])
@pytest.mark.parametrize("kind,fold", [("min", min), ("max", max), ("sum", sum)])
def test_within_distance(rows, radius, kind, fold):
    data, df = rows
    groups = per_key(data)
    want = {i: fold(v2 for t2, _, v2 in groups[k] if abs(t2 - t) <= radius) for k, t, i, _ in data}
    got = within_distance(df, ["k"], "t", radius, F.col("v"), kind, "near").collect()
    assert {r["id"]: r["near"] for r in got} == want


def test_last_seen(rows):
    data, df = rows
    want = {}
    for group in per_key(data).values():
        seen = None
        for _, i, v in group:
            seen = v if v % 5 == 0 else seen
            want[i] = seen
    value = F.when(F.col("v") % 5 == 0, F.col("v"))
    got = last_seen(df, ["k"], [F.col("t"), F.col("id")], value, F.floor(F.col("t") / 64), "seen").collect()
    assert {r["id"]: r["seen"] for r in got} == want


@pytest.mark.parametrize("width", [5, 60, 5000])
def test_anchor_groups(rows, width):
    data, df = rows
    want = {}
    for group in per_key(data).values():
        anchor = None
        for t, i, _ in group:
            anchor = t if anchor is None or t - anchor > width else anchor
            want[i] = anchor
    got = anchor_groups(df, "k", "t", width).collect()
    assert {r["id"]: r["anchor"] for r in got} == want


def test_top_rows_limit_before_shuffle(rows):
    data, df = rows
    top = top_rows(df, ["k"], [F.desc("v"), F.col("id")], 3, "place")
    want = {(k, i) for k, g in per_key(data).items() for _, i in sorted((-v, i) for _, i, v in g)[:3]}
    assert {(r["k"], r["id"]) for r in top.collect()} == want
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 1
