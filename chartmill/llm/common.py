"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.session import shared_folder, ship_package

# fixed value: the folder of public vocabulary files when none is passed
TOKENIZER_FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: of ``folder`` if given, else of the installed package of vocabularies, else of the default folder."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_FOLDER, name)
    return public_tokenizers.path(name)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It cuts the lineage with files that outlive any executor.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """Whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def with_python(df: DataFrame) -> DataFrame:
    """``df``, after its session has sent this package to the Python workers."""
    ship_package(df.sparkSession)
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most about ``most_bytes`` of ``column``, one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of ``links(a, b)``: rows ``(node, component)``, the component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., so the
    rounds grow with the logarithm of the longest path. A node with very many
    neighbours meets a partial minimum before the shuffle and one row in the
    join. Nodes without a link to another node have no row. Rows with a null
    end are no links.
    """
    spark = links.sparkSession
    edges = write_table(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges")
    before = None
    while True:
        # large star: every larger neighbour of a node moves to the smallest node around
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = write_table(small.filter("a <> b").distinct(), f"{label}-star")
        now = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return spark.createDataFrame([], "node bigint, component bigint") if not now[0] else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
