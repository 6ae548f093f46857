"""Stateful streams: alerts with expiring state, and a watchdog on processing time."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chartmill.functions import scalar as S

# fixed values: errors a minute over five minutes, critical errors an hour, silence of a repeated alert
ERRORS_PER_MINUTE, CRITICAL_PER_HOUR, SILENCE_SECONDS = 5.0, 3, 300
RATE_SECONDS, CRITICAL_SECONDS = 300, 3600
# fixed values: what can be stuck, after how long, and how often it is tried again
STUCK_STATUS, STUCK_MINUTES, MOST_ATTEMPTS = ("processing", "ocr_pending"), 15, 3
# how far behind the newest error one may arrive and still be counted, how long a sent alert and a silent document are remembered
LATE_SECONDS, SENT_TTL_MS, DOCUMENT_TTL_MS = 600, 3_600_000, 7 * 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """These processors need the RocksDB state store; the setting holds for streams started afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


# ---------------------------------------------------------------- alerts
ALERTS = "scope string, at timestamp, alert string, amount double"


class AlertProcessor(StatefulProcessor):
    """Judges every second with errors by those before it.

    List state holds the errors per second of the last hour; a value per kind
    of alert holds when it was sent last, with a time to live.
    """

    def __init__(self, rate_limit: float, critical_limit: int):
        self.limits = {"high_error_rate": rate_limit, "critical_errors": critical_limit}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at bigint, errors bigint, critical bigint")
        self.sent = {name: handle.getValueState(name, "at bigint", SENT_TTL_MS) for name in self.limits}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["at", "errors", "critical"]]
        old = pd.DataFrame([tuple(r) for r in self.recent.get()], columns=["at", "errors", "critical"], dtype="int64")
        known = pd.concat([old, new]).groupby("at", as_index=False).sum().sort_values("at")
        at = known["at"].to_numpy()
        asked = np.searchsorted(at, np.unique(new["at"]))
        amounts = {}
        for name, column, seconds in (("high_error_rate", "errors", RATE_SECONDS), ("critical_errors", "critical", CRITICAL_SECONDS)):
            sums = np.append(0, np.cumsum(known[column].to_numpy()))
            amounts[name] = sums[asked + 1] - sums[np.searchsorted(at, at[asked] - seconds, side="right")]
        amounts["high_error_rate"] = amounts["high_error_rate"] / (RATE_SECONDS / 60)
        out = []
        for name, limit in self.limits.items():
            state = self.sent[name]
            last = state.get()[0] if state.exists() else None
            for k in np.flatnonzero(amounts[name] > limit).tolist():
                now = int(at[asked[k]])
                if last is None or now - last >= SILENCE_SECONDS:
                    last = now
                    out.append((key[0], pd.Timestamp(now, unit="s"), name, float(amounts[name][k])))
            if out and out[-1][2] == name:
                state.update((last,))
        kept = known[known["at"] > at[-1] - CRITICAL_SECONDS - LATE_SECONDS]
        self.recent.put([tuple(map(int, r)) for r in kept.itertuples(index=False)])
        yield pd.DataFrame(out, columns=["scope", "at", "alert", "amount"])

    def close(self) -> None:
        pass


def seconds_with_errors(errors: DataFrame) -> DataFrame:
    """Errors and critical errors per scope and second of each input batch of a task: what reaches the state is at most a row a second and task."""
    critical = S.error_severity(F.col("error_type")) == "critical"
    rows = errors.select("scope", F.unix_seconds("ts").alias("at"), critical.cast("bigint").alias("critical"))

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(errors=1).groupby(["scope", "at"], as_index=False)[["errors", "critical"]].sum()

    return rows.mapInPandas(collapse, "scope string, at bigint, errors bigint, critical bigint")


def alerts(errors: DataFrame, rate_limit: float = ERRORS_PER_MINUTE, critical_limit: int = CRITICAL_PER_HOUR) -> DataFrame:
    """Rate and critical-count alerts per scope: ``scope, at, alert, amount``; a repeated one is silent for 300 seconds.

    ``errors`` is ``(scope, ts, error_type)``. An error is judged when it
    arrives, with those of the five minutes or the hour up to its second, so
    no window waits for a later event to close it. Silence goes by event time;
    the time to live drops what nobody will ask for. Errors that arrive in
    their order give the same alerts in whatever batches; one that comes later
    than others is judged with what is known then.
    """
    return seconds_with_errors(errors).groupBy("scope").transformWithStateInPandas(AlertProcessor(rate_limit, critical_limit), ALERTS, "Append", "ProcessingTime")


# ---------------------------------------------------------------- watchdog
STUCK = "doc_id bigint, status string, last_event timestamp, attempts int, action string"


def _action(attempts: int) -> str:
    return "requeue" if attempts < MOST_ATTEMPTS else "fail"


class WatchdogProcessor(StatefulProcessor):
    """Holds the newest event of a document and a timer on processing time."""

    def __init__(self, minutes: float):
        self.wait = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at bigint, event bigint, status string, attempts int", DOCUMENT_TTL_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.newest.get()) if self.newest.exists() else (-1, -1, "", 0)
        for batch in rows:
            newest = max(newest, *zip(batch["at"].tolist(), batch["event"].tolist(), batch["status"].tolist(), batch["attempts"].tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # the newest event is kept whatever it is: an older one that comes late must not wake the document
        self.newest.update(newest)
        if newest[2] in STUCK_STATUS:
            self.handle.registerTimer(max(newest[0] // 1000 + self.wait, timerValues.getCurrentProcessingTimeInMs() + 1))
        yield pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "status": pd.Series(dtype="object"), "last_event": pd.Series(dtype="datetime64[us]"), "attempts": pd.Series(dtype="int32"), "action": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, _, status, attempts = self.newest.get()
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "last_event": [pd.Timestamp(at, unit="us")], "attempts": [attempts], "action": [_action(attempts)]})

    def close(self) -> None:
        pass


def watchdog(events: DataFrame, minutes: float = STUCK_MINUTES) -> DataFrame:
    """Documents in work whose last event is ``minutes`` old by the clock: ``doc_id, status, last_event, attempts, action``.

    ``events`` is ``(doc_id, event_id, ts, status, attempts)``. The timer runs
    on processing time, so a document is reported although no event of any
    document comes any more. It is reported once per last event.
    """
    rows = events.select("doc_id", F.unix_micros("ts").alias("at"), F.col("event_id").alias("event"), "status", F.col("attempts").cast("int").alias("attempts"))
    return rows.groupBy("doc_id").transformWithStateInPandas(WatchdogProcessor(minutes), STUCK, "Append", "ProcessingTime")


def stuck_at(events: DataFrame, now: str, minutes: int = STUCK_MINUTES) -> DataFrame:
    """What ``watchdog`` would have reported of the documents that are still stuck at ``now``, from all events at once."""
    newest = events.groupBy("doc_id").agg(F.max(F.struct("ts", "event_id", "status", "attempts")).alias("e"))
    late = F.col("e.ts") + F.expr(f"INTERVAL '{minutes}' MINUTE") <= F.lit(now).cast("timestamp")
    rows = newest.filter(F.col("e.status").isin(*STUCK_STATUS) & late)
    action = F.when(F.col("e.attempts") < MOST_ATTEMPTS, "requeue").otherwise("fail")
    return rows.select("doc_id", "e.status", F.col("e.ts").alias("last_event"), F.col("e.attempts").cast("int").alias("attempts"), action.alias("action"))


# ---------------------------------------------------------------- running
def run_until_settled(stream: DataFrame, folder: str, name: str, quiet_batches: int = 2, seconds: float = 600) -> str:
    """Run a stream on processing time until all input is read and ``quiet_batches`` further batches had none; rows go to a folder per batch.

    Such a stream always has a next batch, for its timers and times to live,
    so a run that ends by itself when nothing is available does not end.
    """
    out = f"{folder}/{name}/rows"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{folder}/{name}/state").trigger(processingTime="0 seconds").start()
    try:
        end = time.monotonic() + seconds
        while query.isActive and time.monotonic() < end:
            last = [p.numInputRows for p in query.recentProgress][-quiet_batches:]
            if len(last) == quiet_batches and not any(last):
                break
            time.sleep(0.2)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return out
