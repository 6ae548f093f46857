"""Bundle assembly and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES_PER_PAGE = 1000


def bundles(resources: DataFrame, run_ts: str, per_page: int = ENTRIES_PER_PAGE) -> DataFrame:
    """Bundle pages per patient with entries in (type, id) order, as JSON text.

    A bundle is written in pages of about ``per_page`` entries, so a patient with
    a very long record is never gathered into one row. Entries are spread over
    the pages by a hash of their id; ``total`` counts the whole bundle.
    """
    totals = resources.groupBy("patient_id").agg(F.count("*").alias("total"))
    rows = resources.join(totals, "patient_id").withColumns({
        "pages": F.ceil(F.col("total") / per_page).cast("int"),
    }).withColumn("page", F.pmod(F.xxhash64("resource_id"), F.col("pages")).cast("int"))
    body = F.struct(F.col("resource_type").alias("resourceType"), F.col("resource_id").alias("id"), F.col("code"), F.col("body"))
    entry = F.struct("resource_type", "resource_id", F.concat(F.lit("urn:uuid:"), "resource_id").alias("fullUrl"), body.alias("resource"))
    pages = rows.groupBy("patient_id", "page", "pages", "total").agg(F.array_sort(F.collect_list(entry)).alias("es"))
    entries = F.transform("es", lambda e: F.struct(e["fullUrl"].alias("fullUrl"), e["resource"].alias("resource")))
    bundle = F.struct(
        F.lit("Bundle").alias("resourceType"), F.concat(F.lit("patient-bundle-"), F.col("patient_id").cast("string")).alias("id"),
        F.lit("collection").alias("type"), F.lit(run_ts).alias("timestamp"), F.col("total"), entries.alias("entry"),
    )
    return pages.select("patient_id", "page", "pages", F.size("es").alias("entries"), F.to_json(bundle).alias("bundle"))


def initial_bundles(patients: DataFrame, run_ts: str) -> DataFrame:
    """Bundle with just the patient resource."""
    resource = F.struct(F.lit("Patient").alias("resourceType"), F.col("patient_id").cast("string").alias("id"), F.col("mrn"))
    entry = F.struct(F.concat(F.lit("Patient/"), F.col("patient_id").cast("string")).alias("fullUrl"), resource.alias("resource"))
    bundle = F.struct(F.lit("Bundle").alias("resourceType"), F.lit("collection").alias("type"), F.lit(run_ts).alias("timestamp"), F.array(entry).alias("entry"))
    return patients.select("patient_id", F.to_json(bundle).alias("bundle"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One JSON document per line."""
    df.select(column).write.mode("overwrite").text(path)


def yes_no(column: str) -> Column:
    return F.when(F.col(column), "Yes").otherwise("No")


def audit_export(log: DataFrame, limit: int | None) -> DataFrame:
    """Audit rows in export form: all, or the ``limit`` newest."""
    from chartmill.functions import scalar as S

    rows = log if limit is None else log.orderBy(F.desc("logged_at"), F.desc("audit_id")).limit(limit)
    return rows.select(
        F.col("logged_at").alias("timestamp"), S.access_event(F.col("path"), F.col("method")).alias("event_type"), "category", "severity", "username",
        F.coalesce("ip_address", F.lit("")).alias("ip_address"), F.col("method").alias("request_method"), F.col("path").alias("request_url"),
        F.coalesce("patient_mrn", F.lit("")).alias("patient_mrn"), yes_no("phi_involved").alias("phi_involved"), yes_no("success").alias("success"), "description",
    )


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def summary_sections(rows: DataFrame) -> DataFrame:
    """Patient summary sections in CSV form, one row per entry."""
    wanted = rows.filter("section IN ('conditions', 'medications', 'observations')")
    return wanted.select("section", "patient_id", F.coalesce("title", F.lit("")).alias("display_name"), F.coalesce("status", F.lit("")).alias("status"),
                         F.coalesce("day", F.lit("")).alias("date"), F.coalesce("detail", F.lit("")).alias("detail"))


def to_json_text(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON text; dates and timestamps in ISO form."""
    options = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return df.withColumn("json", F.to_json(F.struct(*columns), options))
