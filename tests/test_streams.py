"""Stateful streams and the bucketed merge: restarts, silence, repeated and broken-off batches."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from chartmill.operators.dedup import newest_equivalent
from chartmill.operators.merge import merge_documents
from chartmill.streaming import state as ST
from chartmill.streaming.buckets import BucketStore, bundle_store

DAY = datetime.datetime(2024, 5, 1)
ERRORS = "scope string, ts timestamp, error_type string"
EVENTS = "doc_id bigint, event_id bigint, ts timestamp, status string, attempts int"
ROWS = "patient_id bigint, source_id bigint, resource_type string, resource_id string, code string, body string, updated_at bigint"


def brute_alerts(rows, rate_limit, critical_limit, critical_type):
    out = []
    for scope in {r[0] for r in rows}:
        at = sorted((int((ts - DAY).total_seconds()), kind == critical_type) for s, ts, kind in rows if s == scope)
        for name, span, limit in (("high_error_rate", 300, rate_limit), ("critical_errors", 3600, critical_limit)):
            last = None
            for now in sorted({s for s, _ in at}):
                amount = sum(now - span < s <= now and (c or name == "high_error_rate") for s, c in at) / (5 if name == "high_error_rate" else 1)
                if amount > limit and (last is None or now - last >= 300):
                    last = now
                    out.append((scope, DAY + datetime.timedelta(seconds=now), name, float(amount)))
    return sorted(out)


def test_alerts_over_a_restart(spark, tmp_path):
    from chartmill.functions import fixed

    ST.use_state_store(spark)
    critical = next(k for k, v in fixed.ERROR_SEVERITY.items() if v == "critical")
    rng = random.Random(8)
    rows = sorted((rng.choice("ab"), DAY + datetime.timedelta(seconds=rng.choice([rng.randrange(600), rng.randrange(9000)])), rng.choice([critical, "KeyError"])) for _ in range(300))
    rows.sort(key=lambda r: r[1])
    # the second part arrives after the stream was stopped; the last errors are followed by nothing
    for part in (rows[:170], rows[170:]):
        spark.createDataFrame(part, ERRORS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ERRORS).parquet(f"{tmp_path}/in")
        out = ST.run_until_settled(ST.alerts(stream, 2.0, 20), str(tmp_path), "alerts")
    got = sorted((r.scope, r.at, r.alert, r.amount) for r in spark.read.parquet(out).collect())
    want = brute_alerts(rows, 2.0, 20, critical)
    cut = rows[170][1]
    # seconds on both sides of the cut are judged twice; everything else is the same
    assert [g for g in got if g[1] != cut] == [w for w in want if w[1] != cut] and {g[2] for g in got} == {"high_error_rate", "critical_errors"}


def test_watchdog_reports_when_nothing_comes_any_more(spark, tmp_path):
    ST.use_state_store(spark)
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    rows = [(1, 1, now, "processing", 1), (2, 2, now, "processing", 1), (2, 3, now, "completed", 1), (3, 4, now - datetime.timedelta(hours=1), "ocr_pending", 3),
            (4, 5, now - datetime.timedelta(hours=1), "pending", 0), (5, 7, now, "completed", 0), (5, 6, now - datetime.timedelta(hours=2), "processing", 0)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    query = ST.watchdog(stream, minutes=0.2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()

    def reported():
        return sorted((r.doc_id, r.status, r.attempts, r.action) for r in spark.read.schema(ST.STUCK).parquet(out).collect())

    try:
        end = time.monotonic() + 90
        while time.monotonic() < end and len(reported()) < 2:
            time.sleep(1)
        assert reported() == [(1, "processing", 1, "requeue"), (3, "ocr_pending", 3, "fail")]
        time.sleep(4)
        assert len(reported()) == 2
    finally:
        query.stop()


def test_snapshot_of_the_watchdog(spark):
    rows = [(1, 1, DAY, "processing", 2), (2, 2, DAY, "ocr_pending", 5), (2, 3, DAY, "completed", 5), (3, 4, DAY + datetime.timedelta(minutes=1), "processing", 0)]
    found = ST.stuck_at(spark.createDataFrame(rows, EVENTS), str(DAY + datetime.timedelta(minutes=15))).collect()
    assert [(r.doc_id, r.action) for r in found] == [(1, "requeue")]


def resources(rng, count, patients, sources):
    return [(rng.randrange(patients), rng.randrange(sources), rng.choice("AB"), f"r{k}-{rng.randrange(10**6)}", rng.choice("xyz"), rng.choice("12"), rng.randrange(10**6)) for k in range(count)]


def stored(store):
    return sorted(tuple(r[c] for c in ("patient_id", "source_id", "resource_type", "resource_id", "code", "body", "updated_at")) for r in store.rows().collect())


def test_bucket_store_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(6)
    store = bundle_store(spark, str(tmp_path), buckets=5)
    state = None
    for turn in range(4):
        frame = spark.createDataFrame(resources(rng, 60, 9, 4), ROWS)
        store.merge(frame, f"t{turn}")
        merged = frame if state is None else merge_documents(state, frame)
        state = spark.createDataFrame([tuple(r) for r in newest_equivalent(merged.select(*frame.columns)).collect()], ROWS)
        assert stored(store) == sorted(tuple(r) for r in state.collect())
        # the same batch again, as it is repeated after a failure or delivered under a new name
        store.merge(frame, f"t{turn}")
        store.merge(frame, f"again{turn}")
        assert stored(store) == sorted(tuple(r) for r in state.collect())


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = bundle_store(spark, str(tmp_path), buckets=4)
    store.merge(spark.createDataFrame([(p, 1, "A", f"r{p}", "x", "1", 1) for p in range(40)], ROWS), "a")
    before = {f: f.stat().st_mtime_ns for f in tmp_path.glob("store/bucket=*/*.parquet")}
    store.merge(spark.createDataFrame([(3, 2, "A", "new", "x", "2", 2)], ROWS), "b")
    after = {f: f.stat().st_mtime_ns for f in tmp_path.glob("store/bucket=*/*.parquet")}
    changed = {f.parent.name for f in after if after[f] != before.get(f)}
    assert len(changed) == 1 and len({f.parent.name for f in before}) == 4 and len(stored(store)) == 41


def test_a_broken_off_batch_is_put_in_place_again(spark, tmp_path):
    import shutil

    store = bundle_store(spark, str(tmp_path), buckets=3)
    store.merge(spark.createDataFrame([(p, 1, "A", f"r{p}", "x", "1", 1) for p in range(30)], ROWS), "a")
    batch = spark.createDataFrame([(p, 2, "A", f"n{p}", "x", "2", 2) for p in range(30)], ROWS)
    store.merge(batch, "b")
    want = stored(store)
    # stopped while buckets were replaced: one is gone
    shutil.rmtree(next(tmp_path.glob("store/bucket=*")))
    store.merge(batch, "b")
    assert stored(store) == want and len(want) == 60

    class Stopped(Exception):
        pass

    def stop(rows):
        raise Stopped

    with pytest.raises(Stopped):
        BucketStore(spark, str(tmp_path), stop, buckets=3).merge(batch.withColumn("body", F.lit("9")), "c")
    assert stored(store) == want
