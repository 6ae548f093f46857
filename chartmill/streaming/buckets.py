"""Document merge as a stream: a store of patient buckets of which a micro-batch rewrites those it touches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.operators.dedup import newest_equivalent
from chartmill.operators.merge import merge_documents

BUCKETS = 64


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def bucket_of(patient: str, buckets: int):
    return F.pmod(F.xxhash64(patient), F.lit(buckets)).cast("int")


class BucketStore:
    """Rows of patients in ``bucket=<n>`` folders.

    A batch is merged into the buckets of its patients and written aside
    first. Only when that is whole do its buckets replace those of the store.
    A run that is stopped before it is whole has changed nothing; one that is
    stopped while buckets are replaced finds the whole result under the name
    of the batch and puts it in place again. What was written aside goes with
    the batch after it.
    """

    def __init__(self, spark: SparkSession, folder: str, deduplicate: Callable[[DataFrame], DataFrame], keys: Sequence[str] = ("patient_id", "source_id"), buckets: int = BUCKETS):
        self.spark, self.folder, self.deduplicate, self.keys, self.buckets = spark, folder, deduplicate, list(keys), buckets

    def rows(self) -> DataFrame | None:
        """All rows, or None where nothing was merged yet."""
        return self.spark.read.parquet(f"{self.folder}/store") if _exists(self.spark, f"{self.folder}/store") else None

    def merge(self, batch: DataFrame, label: str) -> None:
        """Merge the documents of ``batch``: their old rows go, their new ones come, equivalent rows collapse."""
        aside = f"{self.folder}/aside/{label}"
        if not _exists(self.spark, f"{aside}/_SUCCESS"):
            new = batch.withColumn("bucket", bucket_of(self.keys[0], self.buckets))
            stored = self.rows()
            if stored is not None:
                # at most one row per bucket; they prune the folders that are read
                touched = [r.bucket for r in new.select("bucket").distinct().collect()]
                new = merge_documents(stored.filter(F.col("bucket").isin(touched)).select(*new.columns), new, self.keys)
            self.deduplicate(new).write.mode("overwrite").parquet(aside)
        whole = self.spark.read.parquet(aside)
        # by range, so that a bucket with very many rows is written by many tasks
        whole.repartitionByRange("bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.folder}/store")

    def forget(self, label: str) -> None:
        files, path = _file_system(self.spark, f"{self.folder}/aside/{label}")
        files.delete(path, True)

    def follow(self, incoming: DataFrame, checkpoint: str) -> None:
        """Merge everything that is available of a stream of documents; ``checkpoint`` names the run."""
        run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

        def merge(batch: DataFrame, number: int) -> None:
            self.merge(batch, f"{run}-{number}")
            self.forget(f"{run}-{number - 1}")

        incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bundle_store(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> BucketStore:
    """A store of ``(resource_type, resource_id, patient_id, source_id, updated_at, code, body)`` that keeps the newest of equivalent resources."""
    return BucketStore(spark, folder, newest_equivalent, buckets=buckets)
