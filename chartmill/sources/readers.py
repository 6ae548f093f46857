"""Readers of captured pipeline files and of exported bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartmill.schemas import EXTRACTION, PAGE_TEXT, PIPELINE_ERROR


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results, one JSON file per document, read with the fixed nested schema."""
    return spark.read.schema(EXTRACTION).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Resource documents: one row per resource with its open body as variant."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    parsed = whole.withColumn("doc", F.try_parse_json("value")).filter("doc IS NOT NULL")
    bodies = F.try_variant_get("doc", "$.fhir_resources", "array<variant>")
    rows = parsed.select(
        "file", F.try_variant_get("doc", "$.document_id", "bigint").alias("document_id"), F.try_variant_get("doc", "$.patient_id", "string").alias("patient_id"),
        F.posexplode(bodies).alias("ord", "body"),
    )
    return rows.withColumns({
        "resource_type": F.try_variant_get("body", "$.resourceType", "string"), "resource_id": F.try_variant_get("body", "$.id", "string"),
    })


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_TEXT).option("multiLine", True).json(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error records; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(PIPELINE_ERROR).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def list_captures(spark: SparkSession, folder: str, document_id: int | None = None) -> DataFrame:
    """Captured files, newest first, without reading their content."""
    pattern = f"*_{document_id}.json" if document_id is not None else "*.json"
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"))


def bundle_resources(bundles: DataFrame, resource_type: str | None = None) -> DataFrame:
    """One row per entry of bundles ``(patient_id, entry array<struct<resource_type, ...>>)``."""
    rows = bundles.select("patient_id", F.inline("entry"))
    return rows.filter(F.col("resource_type") == resource_type) if resource_type else rows
