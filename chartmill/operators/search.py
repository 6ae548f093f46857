"""Cohort search, listings and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: code sets of the named cohorts, all looked up among condition codes
DIABETES = ["73211009", "E11", "E10"]
HYPERTENSION = ["38341003", "I10"]
INSULIN = ["5856", "412210009"]


def patients_with_code(patients: DataFrame, codes: DataFrame, code: str, kinds: list[str] | None = None) -> DataFrame:
    hit = codes.filter(F.col("code") == code)
    if kinds:
        hit = hit.filter(F.col("kind").isin(kinds))
    return patients.join(hit, "patient_id", "left_semi")


def patients_with_any(patients: DataFrame, codes: DataFrame, wanted: list[str], kind: str | None = None) -> DataFrame:
    hit = codes.filter(F.col("code").isin(wanted))
    return patients.join(hit.filter(F.col("kind") == kind) if kind else hit, "patient_id", "left_semi")


def patients_with_all(codes: DataFrame, wanted: list[str], kind: str) -> DataFrame:
    """Patients holding every wanted code that anyone holds (codes without a hit are dropped)."""
    hits = codes.filter((F.col("kind") == kind) & F.col("code").isin(wanted))
    return _combine(hits.select("patient_id", F.col("code").alias("criterion")), True)


def _combine(hits: DataFrame, every: bool) -> DataFrame:
    per = hits.groupBy("patient_id").agg(F.countDistinct("criterion").alias("n"))
    if not every:
        return per.select("patient_id")
    needed = hits.agg(F.countDistinct("criterion").alias("needed"))
    return per.join(F.broadcast(needed), F.col("n") == F.col("needed")).select("patient_id")  # one row


def patients_in_range(patients: DataFrame, dates: DataFrame, start: str, end: str) -> DataFrame:
    return patients.join(dates.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), "patient_id", "left_semi")


def combined_search(
    codes: DataFrame, dates: DataFrame, providers: DataFrame, wanted: list[str] | None = None,
    between: tuple[str, str] | None = None, references: list[str] | None = None, every: bool = True,
) -> DataFrame:
    """Patients meeting all or any criteria. A criterion nobody meets is dropped,
    also for ``every``. Provider references count as one criterion."""
    parts = []
    if wanted:
        parts.append(codes.filter(F.col("code").isin(wanted)).select("patient_id", F.concat(F.lit("code "), "code").alias("criterion")))
    if between:
        lo, hi = (F.lit(x).cast("date") for x in between)
        parts.append(dates.filter(F.col("day").between(lo, hi)).select("patient_id", F.lit("date").alias("criterion")))
    if references:
        parts.append(providers.filter(F.col("reference").isin(references)).select("patient_id", F.lit("provider").alias("criterion")))
    return _combine(reduce(DataFrame.unionByName, parts), every)


def text_search(codes: DataFrame, query: str, limit: int | None = None, strict_reference: bool = False) -> DataFrame:
    """Patients with the text in any code display.

    ``strict_reference`` also demands an entry with an empty display.
    """
    display = F.lower(F.col("display"))
    if strict_reference:
        out = codes.groupBy("patient_id").agg(
            F.bool_or(display.contains(query.lower())).alias("hit"), F.bool_or(display == "").alias("blank")
        ).filter("hit AND blank").select("patient_id")
    else:
        out = codes.filter(display.contains(query.lower())).select("patient_id").distinct()
    return out.orderBy("patient_id").limit(limit) if limit else out


def recently_active(dates: DataFrame, as_of: str, days: int, limit: int | None = None) -> DataFrame:
    lo = F.date_sub(F.lit(as_of).cast("date"), days)
    out = dates.filter(F.col("day") >= lo).groupBy("patient_id").agg(F.max("day").alias("last_day"))
    return out.orderBy(F.desc("last_day"), "patient_id").limit(limit) if limit else out


def medical_summary(codes: DataFrame, dates: DataFrame, providers: DataFrame) -> DataFrame:
    """Code counts by kind, encounters, providers and last encounter per patient."""
    kinds = ["Condition", "MedicationStatement", "Observation"]
    c = codes.select("patient_id", "kind", "code").distinct().groupBy("patient_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k.lower()) for k in kinds]
    )
    d = dates.groupBy("patient_id").agg(F.countDistinct("day").alias("encounters"), F.max("day").alias("last_encounter"))
    p = providers.groupBy("patient_id").agg(F.countDistinct("reference").alias("providers"))
    out = c.join(d, "patient_id", "full").join(p, "patient_id", "full")
    return out.fillna(0, [*(k.lower() for k in kinds), "encounters", "providers"])


def check_search(requests: DataFrame, today: str) -> DataFrame:
    """Issue list of each search request."""
    from chartmill.functions import scalar as S

    day = F.try_to_date(F.col("start_date"), "yyyy-MM-dd")
    filled = F.col("start_date") != ""
    found = S.issues(
        ((F.col("code_system") != "") & ~F.col("code_system").rlike("^(https?://|urn:)"), "code_system"),
        (F.length("code") > 50, "code"),
        (filled & day.isNull(), "start_date format"), (filled & (day > F.lit(today).cast("date")), "start_date future"),
        ((F.col("provider_reference") != "") & ~F.col("provider_reference").rlike("^(Practitioner|Organization)/"), "provider_reference"),
    )
    return requests.withColumn("issues", F.array_join(found, ";"))


def matches_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Filter by the criteria that were given."""
    return df.filter(reduce(Column.__and__, predicates)) if predicates else df


def contains_text(columns: list[str], text: str) -> Column:
    """Case-insensitive containment in any of the columns."""
    return reduce(Column.__or__, [F.lower(F.col(c)).contains(text.lower()) for c in columns])


def audit_trail(
    log: DataFrame, *, username: str | None = None, category: str | None = None, severity: str | None = None,
    start: str | None = None, end: str | None = None, ip: str | None = None, success: bool | None = None,
    phi: bool | None = None, mrn: str | None = None, text: str | None = None, event_type: str | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Audit rows by up to twelve optional criteria, newest first; the end day is included."""
    from chartmill.functions import scalar as S

    p: list[Column] = []
    if username:
        p.append(contains_text(["username"], username))
    if category:
        p.append(F.col("category") == category)
    if severity:
        p.append(F.col("severity") == severity)
    if start:
        p.append(F.col("logged_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        p.append(F.col("logged_at") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if ip:
        p.append(F.col("ip_address").startswith(ip))
    if success is not None:
        p.append(F.col("success") == success)
    if phi is not None:
        p.append(F.col("phi_involved") == phi)
    if mrn:
        p.append(F.col("patient_mrn") == mrn)
    if text:
        p.append(contains_text(["description"], text))
    if event_type:
        p.append(S.access_event(F.col("path"), F.col("method")) == event_type)
    if user_id is not None:
        p.append(F.col("user_id") == user_id)
    return matches_all(log, p).orderBy(F.desc("logged_at"), F.desc("audit_id"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a listing."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def not_deleted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def visible_to(df: DataFrame, user: str, staff: bool) -> DataFrame:
    return df if staff else df.filter(F.col("created_by") == user)


def in_report_range(df: DataFrame, date: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows in range compared as text; undated rows stay."""
    keep = []
    if start:
        keep.append(F.col(date) >= start)
    if end:
        keep.append(F.col(date) <= end)
    return df.filter(F.col(date).isNull() | reduce(Column.__and__, keep)) if keep else df
