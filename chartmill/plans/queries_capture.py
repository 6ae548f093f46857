"""Captured files: written from the tables to the shared folder and read back."""

from pyspark.sql import functions as F

from chartmill.plans.catalog import query
from chartmill.session import shared_folder
from chartmill.sources import captures as C
from chartmill.streaming import jobs as J


def _written(t, rows):
    """Folder of captures that this run wrote from ``rows(kind, stage, document_id, content)``."""
    folder = f"{shared_folder(t.spark)}/captures-{t.run_id()}"
    C.write_captures(rows, folder, spread=True)
    return folder


def _rows(source, kind, document_id, content, stage=None):
    return source.select(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if stage is None else stage).alias("stage"), document_id.alias("document_id"), content.alias("content"))


def _extractions(t):
    condition = F.struct(F.concat(F.lit("from "), "source").alias("name"), F.lit("active").alias("status"), (F.col("n_chars") % 100 / 100).alias("confidence"))
    response = F.struct(F.array(condition).alias("conditions"), F.col("lang").alias("document_type"))
    body = F.struct(F.col("doc_id").alias("document_id"), F.lit("llm_extraction").alias("stage"), F.lit("claude").alias("llm_type"), (F.col("doc_id") % 7 != 0).alias("success"), response.alias("response_data"))
    return _rows(t.documents, "extraction", F.col("doc_id"), F.to_json(body))


def _resources(t):
    bodies = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.struct(F.lit("Condition").alias("resourceType"), F.concat_ws("-", "doc_id", i).alias("id"), F.col("lang").alias("code")))
    body = F.struct(F.col("doc_id").alias("document_id"), F.concat(F.lit("p"), F.col("doc_id") % 10).alias("patient_id"), bodies.alias("fhir_resources"))
    return _rows(t.documents, "resources", F.col("doc_id"), F.to_json(body))


def _errors(t):
    """Every 13th file was cut while it was written."""
    body = F.to_json(F.struct(F.col("error_id").alias("document_id"), F.concat(F.lit("error_"), "component").alias("stage"), F.col("message").alias("error_message"), F.create_map(F.lit("type"), "error_type").alias("error_data")))
    cut = F.when(F.col("error_id") % 13 == 0, F.substring(body, 1, 20)).otherwise(body)
    return _rows(t.error_log, "error", F.col("error_id"), cut, F.col("component"))


@query(
    "captured_extractions",
    """SELECT doc_id AS document_id, 'llm_output_' || doc_id || '.json' AS file, doc_id % 7 <> 0 AS success, 'from ' || source AS condition, CAST(n_chars % 100 AS DOUBLE) / 100 AS confidence, lang AS document_type FROM documents""",
)
def _(t):
    rows = C.parsed_extractions(C.read_captures(t.spark, _written(t, _extractions(t)), "extraction"))
    first = F.col("response_data.conditions")[0]
    return rows.select("document_id", "file", "success", first["name"].alias("condition"), first["confidence"].alias("confidence"), F.col("response_data.document_type").alias("document_type"))


@query(
    "captured_resources",
    """SELECT doc_id AS document_id, 'p' || doc_id % 10 AS patient_id, CAST(i AS INTEGER) AS ord, 'Condition' AS resource_type, doc_id || '-' || i AS resource_id, lang AS code
       FROM documents, range(3) AS r(i) WHERE i <= doc_id % 3""",
)
def _(t):
    rows = C.parsed_resources(C.read_captures(t.spark, _written(t, _resources(t)), "resources"))
    return rows.select("document_id", "patient_id", "ord", "resource_type", "resource_id", F.try_variant_get("body", "$.code", "string").alias("code"))


@query(
    "captured_errors",
    """SELECT error_id AS document_id, CASE WHEN error_id % 13 <> 0 THEN 'error_' || component END AS stage, CASE WHEN error_id % 13 <> 0 THEN message END AS error_message,
              CASE WHEN error_id % 13 <> 0 THEN error_type END AS error_type, error_id % 13 = 0 AS corrupt FROM error_log""",
)
def _(t):
    rows = C.parsed_errors(C.read_captures(t.spark, _written(t, _errors(t)), "error"))
    return rows.select("document_id", "stage", "error_message", F.col("error_data.type").alias("error_type"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query(
    "captured_files",
    """SELECT 'error' AS kind, error_id AS document_id, 'error_' || component || '_' || error_id || '.json' AS file FROM error_log
       UNION ALL SELECT 'resources', doc_id, 'fhir_data_' || doc_id || '.json' FROM documents""",
)
def _(t):
    files = C.listed(C.read_captures(t.spark, _written(t, _errors(t).unionByName(_resources(t))), content=False))
    return files.filter("length > 0").select("kind", "document_id", "file")


@query("stream_captures", "SELECT doc_id AS document_id, 'llm_output_' || doc_id || '.json' AS file, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS run FROM documents")
def _(t):
    """The stream ends, more files come, and it goes on behind its last offset."""
    rows = _extractions(t)
    folder = f"{shared_folder(t.spark)}/captures-{t.run_id()}"
    C.register_captures(t.spark)
    for run in range(2):
        C.write_captures(rows.filter(F.col("document_id") % 2 == run), f"{folder}/files")
        stream = t.spark.readStream.format("captures").option("path", f"{folder}/files").option("kind", "extraction").load()
        out = J.run_to_folder(stream.select("document_id", "file"), folder, "append", "read")
    return t.spark.read.parquet(out).select("document_id", "file", F.col("part").cast("int").alias("run"))
