"""Streaming forms of the pipeline metrics and of the document merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.operators.metrics import usage_rows

LATENESS = "10 minutes"


# ---------------------------------------------------------------- continuous aggregates
def latest_stage(events: DataFrame) -> DataFrame:
    """Live board: newest stage of each document (update mode)."""
    return events.groupBy("doc_id").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("ts"))


def throughput(events: DataFrame) -> DataFrame:
    """Completed and failed documents per hour; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", LATENESS).filter(F.col("status").isin("completed", "failed"))
        .groupBy(F.window("ts", "1 hour").alias("w"), "status").count()
        .select(F.col("w.start").alias("hour"), "status", F.col("count").alias("n"))
    )


def error_rate(errors: DataFrame) -> DataFrame:
    """Errors per minute over sliding five minutes."""
    windows = errors.withWatermark("ts", LATENESS).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).count()
    return windows.select(F.col("w.start").alias("window_start"), (F.col("count") / 5).alias("per_minute"))


def first_deliveries(docs: DataFrame) -> DataFrame:
    """Documents delivered twice within the watermark pass once."""
    return docs.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["doc_id"])


def session_usage(calls: DataFrame) -> DataFrame:
    """Running sums per processing session."""
    rows = usage_rows(calls)
    return rows.groupBy("session_id").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("cost"))


def spend_over_limit(calls: DataFrame, limit: str) -> DataFrame:
    """Days whose spending reached the limit."""
    rows = usage_rows(calls).withWatermark("started_at", LATENESS)
    days = rows.groupBy(F.window("started_at", "1 day").alias("w")).agg(F.sum("cost").alias("cost"))
    return days.filter(F.col("cost") >= F.lit(limit).cast("decimal(20,9)")).select(F.col("w.start").alias("day"), "cost")


# ---------------------------------------------------------------- sinks
def run_to_folder(stream: DataFrame, folder: str, mode: str, name: str) -> str:
    """Run everything available and write each micro-batch under its number.

    A batch that is retried after a failure overwrites its own folder.
    """
    out = f"{folder}/{name}/rows"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def newest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Final value of each key of an update-mode result."""
    rows = spark.read.parquet(out).drop("part")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def store_rows(spark: SparkSession, store: str, keys: Sequence[str]) -> DataFrame:
    """Rows of the store: of each key those that its newest version has."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(newest, [*keys, "version"]).drop("version")


def newest_version(spark: SparkSession, store: str) -> int:
    """Number of the newest version that was written to its end, -1 where none was."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "version=*/_SUCCESS")) or []
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in done), default=-1)


def merge_stream(incoming: DataFrame, store: str, checkpoint: str) -> None:
    """Append arriving documents to the versioned store, one new version per micro-batch.

    A version has the rows of its documents alone; ``store_rows`` lets a newer
    version replace a document as a whole. So nothing older is rewritten, a
    batch that is repeated and a document that is delivered again change
    nothing, and a run with a new checkpoint goes on behind the versions that exist.
    """
    def append(batch: DataFrame, _: int) -> None:
        number = newest_version(batch.sparkSession, store) + 1
        batch.write.mode("overwrite").parquet(f"{store}/version={number}")

    query = incoming.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
