"""Report rows, composite reports and access to open resource bodies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators.dedup import split_by_size
from chartmill.operators.ordered import numbered, top_rows


def best_date(resource_type: Column, dates: dict[str, Column]) -> Column:
    """Clinical date of a resource by type, ordered fallbacks."""
    none = F.lit(None).cast("string")

    def pick(*names):
        return F.coalesce(*[dates.get(n, none) for n in names])

    return (
        F.when(resource_type == "Observation", pick("effective")).when(resource_type == "Condition", pick("onset", "recorded"))
        .when(resource_type == "Procedure", pick("performed", "period_start")).when(resource_type == "DiagnosticReport", pick("effective"))
        .otherwise(pick("period_start", "recorded"))
    )


def select_paths(rows: DataFrame, body: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns from dotted paths of a variant body; a missing path is null."""
    return rows.withColumns({name: F.try_variant_get(body, path, kind) for name, (path, kind) in paths.items()})


def resource_fields(rows: DataFrame, body: str = "body") -> DataFrame:
    """Common accessors of an open resource body."""

    def first(*paths):
        return F.coalesce(*[F.try_variant_get(body, p, "string") for p in paths])

    return rows.withColumns({
        "status": first("$.status", "$.clinicalStatus.coding[0].code"), "title": first("$.code.text", "$.code.coding[0].display", "$.title"),
        "code": first("$.code.coding[0].code"), "category": first("$.category[0].coding[0].display", "$.category[0].text"),
        "severity": first("$.severity.text", "$.severity.coding[0].display"), "npi": first("$.identifier[0].value"),
    })


def document_keys(docs: DataFrame) -> DataFrame:
    """Encounter, visit, date and provider of a document from metadata, then payload."""
    def text(column, path):
        return F.get_json_object(column, path)

    return docs.select(
        "doc_id", F.coalesce(text("meta", "$.encounter_id"), text("payload", "$.encounter.id"), text("payload", "$.encounter.reference"), text("payload", "$.encounter")).alias("encounter_id"),
        F.coalesce(text("meta", "$.visit_id"), text("payload", "$.visit.id"), text("payload", "$.visit")).alias("visit_id"),
        F.coalesce(text("payload", "$.document_date"), text("payload", "$.service_date"), text("payload", "$.date")).alias("document_date"),
        F.coalesce(text("meta", "$.provider_id"), text("payload", "$.provider.id"), text("payload", "$.provider"), text("payload", "$.performers[0].id")).alias("provider_id"),
    )


_ROW = ["item_id", "title", "status", "detail", "day"]


def _typed(section: str, c: Callable[[str], Column]) -> list[Column]:
    """Item, title, status, detail and day of a row of a typed table whose columns ``c`` finds."""
    if section == "conditions":
        return [c("condition_id"), S.strip_diagnosis(c("name")), c("status"), c("severity"), c("onset_text")]
    if section == "medications":
        return [c("med_id"), c("name"), c("status"), F.concat_ws(" ", c("dose"), c("schedule")), c("start_date")]
    if section == "observations":
        amount = F.concat_ws(" ", c("value").cast("string"), F.when(c("unit") != "", c("unit")))
        return [c("obs_id"), c("test_name"), S.abnormal_result(c("flag"), c("value"), c("low"), c("high")), amount, c("effective_date").cast("string")]
    return [c("encounter_id").cast("string"), S.class_display(c("enc_class")), c("status"), c("reason"), c("visit_date").cast("string")]


def section_rows(df: DataFrame, section: str) -> DataFrame:
    """Uniform report rows of one typed table."""
    return df.select("patient_id", F.lit(section).alias("section"), *[v.alias(n) for n, v in zip(_ROW, _typed(section, F.col))])


def report_rows(conditions: DataFrame, medications: DataFrame, results: DataFrame, encounters: DataFrame) -> DataFrame:
    """Uniform report rows ``(patient_id, section, item_id, title, status, detail, day)`` of the typed tables."""
    tables = {"conditions": conditions, "medications": medications, "observations": results, "encounters": encounters}
    return reduce(DataFrame.unionByName, [section_rows(df, section) for section, df in tables.items()])


LINE_PARTS = ["conditions", "medications", "observations"]


def parts_of_lines(lines: DataFrame, is_condition: Column, is_medication: Column) -> DataFrame:
    """Rows of ``lines`` once for every report row they become, with its number in ``part`` and, for results, ``low`` and ``high``.

    ``ranges(low, high)`` of a line are those of its code.
    """
    def part(n: int, low: Column, high: Column) -> Column:
        return F.struct(F.lit(n).alias("part"), low.cast("double").alias("low"), high.cast("double").alias("high"))

    none = F.lit(None)
    made = F.concat(
        F.when(is_condition, F.array(part(0, none, none))).otherwise(F.array()), F.when(is_medication, F.array(part(1, none, none))).otherwise(F.array()),
        F.transform(F.coalesce("ranges", F.array()), lambda r: part(2, r["low"], r["high"])),
    )
    return lines.select("*", F.inline(made)).drop("ranges")


def line_rows(parts: DataFrame) -> DataFrame:
    """The rows that ``report_rows`` makes of conditions, medications and results, from rows of ``parts_of_lines``.

    They have the columns of an observation, ``of_conditions`` and ``of_medications``.
    """
    columns = [_typed(LINE_PARTS[0], lambda n: F.col(f"of_conditions.{n}")), _typed(LINE_PARTS[1], lambda n: F.col(f"of_medications.{n}")), _typed(LINE_PARTS[2], F.col)]

    def by_part(values: Sequence[Column]) -> Column:
        return F.when(F.col("part") == 0, values[0]).when(F.col("part") == 1, values[1]).otherwise(values[2])

    return parts.select("patient_id", by_part([F.lit(p) for p in LINE_PARTS]).alias("section"), *[by_part(v).alias(n) for n, v in zip(_ROW, zip(*columns))])


# fixed values: sections of converted documents by the origin of their rows, with the columns of their detail
CONVERTED = {
    "Procedure": ("procedures", ("performer", "outcome")), "Immunization": ("immunizations", ("code",)), "ProcedureImmunization": ("immunizations", ("code",)),
    "AllergyIntolerance": ("allergies", ("severity", "reaction")), "CarePlan": ("care_plans", ("goals", "activities")), "FamilyMemberHistory": ("family_history", ("relationship",)),
    "Practitioner": ("practitioners", ("family", "given")), "Organization": ("organizations", ("address",)), "ServiceRequest": ("service_requests", ("priority", "reason")),
    "PlannedRequest": ("service_requests", ("priority", "reason")), "DiagnosticReport": ("diagnostic_reports", ("conclusion",)), "ProcedureReport": ("diagnostic_reports", ("conclusion",)),
}


def converted_kinds() -> list:
    from chartmill.operators import convert as C

    return [kind for kind in C.all_kinds() if kind.origin in CONVERTED]


def converted_report_rows(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Uniform report rows ``(doc_id, section, title, status, detail, day)`` of converted documents.

    The nine sections that the typed tables of ``report_rows`` do not have.
    ``keys`` names what is kept of the document, its patient for example.
    Every section reads the documents for itself, in tasks of its own;
    ``converted_in_one_pass`` is for documents that moved.
    """
    from chartmill.operators import convert as C

    none = F.lit(None).cast("string")

    def shape(df, section, status, day, *detail):
        return df.select(*keys, F.lit(section).alias("section"), F.col("name").alias("title"), status.alias("status"), F.concat_ws("; ", *detail).alias("detail"), day.alias("day"))

    c = F.col
    tables = [
        shape(C.procedures(docs), "procedures", c("status"), c("effective"), "performer", "outcome"),
        shape(C.immunizations(docs), "immunizations", c("status"), c("effective"), "code"),
        shape(C.allergies(docs), "allergies", c("status"), c("effective"), "severity", "reaction"),
        shape(C.care_plans(docs), "care_plans", c("status"), c("effective"), "goals", "activities"),
        shape(C.family_history(docs), "family_history", c("status"), none, "relationship"),
        shape(C.practitioners(docs), "practitioners", F.lit("active"), none, "family", "given"),
        shape(C.organizations(docs), "organizations", F.lit("active"), none, "address"),
        shape(C.service_requests(docs), "service_requests", F.lit("active"), c("effective"), "priority", "reason"),
        shape(C.diagnostic_reports(docs), "diagnostic_reports", c("status"), c("effective"), "conclusion"),
    ]
    return reduce(DataFrame.unionByName, tables)


def converted_in_one_pass(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The rows of ``converted_report_rows`` from one pass over the documents."""
    from chartmill.operators import convert as C

    kinds = converted_kinds()

    def detail(kind) -> Column:
        parts = [kind.columns[n] for n in CONVERTED[kind.origin][1]]
        if kind.origin == "Practitioner":  # both parts come from one reading of the name
            parts = [F.flatten(F.transform(F.array(S.parse_provider_name(F.col(f"x_{kind.source}.name"))), lambda n: F.array(n["family"], n["given"])))]
        return F.concat_ws("; ", *parts)

    return C.one_pass(docs, kinds).select(
        *keys, C.of_kind(kinds, lambda k: F.lit(CONVERTED[k.origin][0])).alias("section"), C.of_kind(kinds, lambda k: k.columns["name"]).alias("title"),
        C.of_kind(kinds, C.status_of).alias("status"), C.of_kind(kinds, detail).alias("detail"), C.of_kind(kinds, C.effective_of).alias("day"),
    )


def patient_summary(rows: DataFrame, limit: int = 10, start: str | None = None, end: str | None = None) -> DataFrame:
    """Newest ``limit`` rows per patient and section within the range; undated rows stay."""
    from chartmill.operators.search import in_report_range

    kept = in_report_range(rows, "day", start, end)
    return top_rows(kept, ["patient_id", "section"], [F.desc_nulls_last("day"), F.col("item_id")], limit, "place")


# fixed values: report kinds with days and items per section
SUMMARY_KINDS = {
    "recent": (30, 5, ["conditions", "medications", "observations"]), "problems_focused": (None, 15, ["conditions", "medications"]),
    "comprehensive": (None, 20, ["conditions", "medications", "observations", "encounters"]),
}


def clinical_summary(rows: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Section counts of a summary kind: rows in scope, rows shown, newest day."""
    days, limit, sections = SUMMARY_KINDS[kind]
    scoped = rows.filter(F.col("section").isin(sections))
    if days is not None:
        scoped = scoped.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("string"))
    return scoped.groupBy("patient_id", "section").agg(
        F.count("*").alias("total"), F.least(F.count("*"), F.lit(limit)).alias("shown"), F.count_if(F.col("status") == "active").alias("active"), F.max("day").alias("newest"),
    )


def clinical_summary_items(rows: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Rows that a summary kind shows: the newest of each section of a patient, up to the kind's number."""
    days, limit, sections = SUMMARY_KINDS[kind]
    scoped = rows.filter(F.col("section").isin(sections))
    if days is not None:
        scoped = scoped.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("string"))
    return top_rows(scoped, ["patient_id", "section"], [F.desc_nulls_last("day"), F.col("item_id")], limit, "place")


def observation_sections(obs: DataFrame) -> DataFrame:
    """Counts per patient and category; all four categories appear."""
    kinds = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("category"), F.lit(v).alias("label")) for i, (k, v) in enumerate(fixed.OBSERVATION_LABELS)])
    category = S.observation_category(F.lit(None).cast("string"), F.col("test_name"))
    per = obs.select("patient_id", category.alias("category")).groupBy("patient_id", "category").agg(F.count("*").alias("n"))
    n = per.groupBy("patient_id").agg(*[F.coalesce(F.max(F.when(F.col("category") == k, F.col("n"))), F.lit(0)).alias(k) for k, _ in fixed.OBSERVATION_LABELS])
    long = n.select("*", F.inline(kinds))
    count = F
    for k, _ in fixed.OBSERVATION_LABELS:
        count = count.when(F.col("category") == k, F.col(k))
    return long.select("patient_id", "place", "category", "label", count.otherwise(0).alias("n"))


_ENTRY = ["place", "item_id", "title", "status", "detail", "day"]


def _newest_of_small(rows: DataFrame, limit: int) -> DataFrame:
    """Newest rows and totals of sections of up to ``SMALL_SECTION`` rows, which move once, by patient, and stay there."""
    section = W.partitionBy("patient_id", "section")
    placed = rows.repartition("patient_id").withColumns({
        "place": F.row_number().over(section.orderBy(F.desc_nulls_last("day"), "item_id")),
        "total": F.count("*").over(section), "active": F.count_if(F.col("status") == "active").over(section),
    })
    return placed.filter(F.col("place") <= limit).groupBy("patient_id", "section").agg(
        F.first("total").alias("total"), F.first("active").alias("active"), F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("items"),
    )


def _newest_of_any(rows: DataFrame, limit: int) -> DataFrame:
    """The same of sections of any size, which are cut before they move."""
    top = patient_summary(rows, limit)
    sections = top.groupBy("patient_id", "section").agg(F.array_sort(F.collect_list(F.struct(*_ENTRY))).alias("items"))
    totals = rows.groupBy("patient_id", "section").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))
    return totals.join(sections, ["patient_id", "section"])


def comprehensive_report(rows: DataFrame, obs: DataFrame, encounters: DataFrame, limit: int = 20) -> DataFrame:
    """One nested row per patient with its newest rows per section and totals.

    Sections are cut to ``limit`` rows before they are collected, which is the
    feature of this report and keeps a patient's row small.
    """
    small, large = split_by_size(rows, ["patient_id", "section"], SMALL_SECTION)
    both = _newest_of_small(small, limit)
    if large is not None:
        both = both.unionByName(_newest_of_any(large, limit))
    body = both.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("section", "total", "active", "items"))).alias("sections"))
    kinds = observation_sections(obs).groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("place", "category", "n"))).alias("observation_categories"))
    visits = encounters.groupBy("patient_id").agg(F.count("*").alias("visits"), F.max("visit_date").alias("last_visit"))
    return body.join(kinds, "patient_id", "left").join(visits, "patient_id", "left")


# fixed values: the sections of the full report
SECTIONS = [
    "conditions", "procedures", "medications", "observations", "encounters", "allergies", "care_plans", "service_requests", "diagnostic_reports", "immunizations", "family_history",
    "practitioners", "organizations",
]
PAGE_ITEMS = 500
SMALL_SECTION = 1000  # rows of a section that are sorted as one array, or counted beside their places


def all_report_rows(rows: DataFrame, converted: DataFrame) -> DataFrame:
    """Rows of every section: those of the typed tables, and those of converted documents under their ``patient_id``."""
    return rows.unionByName(converted.select("patient_id", "section", F.col("doc_id").cast("string").alias("item_id"), "title", "status", "detail", "day"))


def _sorted_sections(rows: DataFrame) -> DataFrame:
    """Sections of up to ``SMALL_SECTION`` rows, newest first, as one array ``all`` each, with their totals.

    The rows of a patient lie in one task, and stay there.
    """
    listed = rows.groupBy("patient_id", "section").agg(
        F.collect_list(F.struct("day", F.struct("item_id", "title", "status", "detail").alias("rest"))).alias("all"),
        F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"),
    )

    def compare(a: Column, b: Column) -> Column:
        x, y = a["day"], b["day"]
        by_day = F.when(x.isNull() & y.isNotNull(), 1).when(x.isNotNull() & y.isNull(), -1).when(x > y, -1).when(x < y, 1)
        return F.coalesce(by_day, F.when(a["rest"] < b["rest"], -1).when(a["rest"] > b["rest"], 1).otherwise(0))

    def item(x: Column, i: Column) -> Column:
        r = x["rest"]
        return F.struct((i + 1).cast("bigint").alias("place"), r["item_id"].alias("item_id"), r["title"].alias("title"), r["status"].alias("status"), r["detail"].alias("detail"), x["day"].alias("day"))

    return listed.withColumn("all", F.array_sort("all", compare)).withColumn("all", F.transform("all", item))


def _page_numbers(most: Column, page_items: int) -> Column:
    return F.sequence(F.lit(0), F.floor((most - 1) / page_items).cast("int"))


def _page_of(items: Column, page: Column, page_items: int) -> Column:
    return F.slice(items, page * page_items + 1, F.lit(page_items))


def _pages_of_arrays(rows: DataFrame, page_items: int) -> DataFrame:
    """Pages of sections of up to ``SMALL_SECTION`` rows, which move once, by patient."""
    placed = _sorted_sections(rows.repartition("patient_id"))
    paged = placed.select("*", F.explode(_page_numbers(F.col("total"), page_items)).alias("page"))
    return paged.withColumn("items", _page_of(F.col("all"), F.col("page"), page_items))


def _pages_of_small_patients(rows: DataFrame, page_items: int) -> DataFrame:
    """Pages of patients whose sections all have up to ``SMALL_SECTION`` rows.

    The rows of a patient lie in one task. Its sections are one row until they
    are cut into pages, so totals and pages come from the same pass.
    """
    record = _sorted_sections(rows).groupBy("patient_id").agg(
        F.collect_list(F.struct("section", "total", "active", "all")).alias("sections"), F.sum("total").alias("total_resources"), F.max("total").alias("most"),
    )
    paged = record.select("*", F.explode(_page_numbers(F.col("most"), page_items)).alias("page"))

    def held(s: Column) -> Column:
        return F.struct(s["section"].alias("section"), s["total"].alias("total"), s["active"].alias("active"), _page_of(s["all"], F.col("page"), page_items).alias("items"))

    sections = F.filter(F.transform("sections", held), lambda s: F.size(s["items"]) > 0)
    return paged.select("patient_id", "page", sections.alias("held"), "total_resources", F.ceil(F.col("most") / page_items).cast("int").alias("pages"))


def _pages_of_numbered(rows: DataFrame, page_items: int) -> DataFrame:
    """Pages of sections of any size, cut along their order."""
    order = [F.desc_nulls_last("day"), F.col("item_id"), F.col("title"), F.col("status"), F.col("detail")]
    placed = numbered(rows, ["patient_id", "section"], order, "place").withColumn("page", F.floor((F.col("place") - 1) / page_items).cast("int"))
    item = F.struct("place", "item_id", "title", "status", "detail", "day")
    parts = placed.groupBy("patient_id", "page", "section").agg(F.array_sort(F.collect_list(item)).alias("items"))  # a page at most
    totals = rows.groupBy("patient_id", "section").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"))
    return parts.join(totals, ["patient_id", "section"])


def _pages_of_any(rows: DataFrame, page_items: int) -> DataFrame:
    """Pages of patients whose sections have any size; the larger ones are cut."""
    small, large = split_by_size(rows, ["patient_id", "section"], SMALL_SECTION)
    columns = ["patient_id", "page", "section", "total", "active", "items"]
    parts = _pages_of_arrays(small, page_items).select(*columns)
    if large is not None:
        parts = parts.unionByName(_pages_of_numbered(large, page_items).select(*columns))
    pages = parts.groupBy("patient_id", "page").agg(F.collect_list(F.struct("section", "total", "active", "items")).alias("held"))
    counts = parts.filter("page = 0").groupBy("patient_id").agg(F.sum("total").alias("total_resources"), F.ceil(F.max("total") / page_items).cast("int").alias("pages"))
    return pages.join(counts, "patient_id")


def full_report(patients: DataFrame, rows: DataFrame | None, page_items: int = PAGE_ITEMS, small: DataFrame | None = None) -> DataFrame:
    """The whole report of each patient as nested rows: ``patient_id, page, pages, status, patient, total_resources, sections``.

    Every section has all its items, newest first, and its totals. A row holds
    up to ``page_items`` of each section; a patient with more has further
    pages, so no row grows with a record. Sections without items are there,
    empty, on the first page; a patient without any has status ``no_data``.

    ``small`` are the rows of patients whose sections all have up to
    ``SMALL_SECTION`` rows, each patient's in one task; ``rows`` are those of
    the others, None if there are none.
    """
    of_small = None if small is None else _pages_of_small_patients(small, page_items)
    of_any = None if rows is None else _pages_of_any(rows, page_items)
    pages = reduce(DataFrame.unionByName, [p for p in (of_small, of_any) if p is not None])
    out = patients.join(pages, "patient_id", "left")
    kind = "struct<section:string,total:bigint,active:bigint,items:array<struct<place:bigint,item_id:string,title:string,status:string,detail:string,day:string>>>"

    def empty(name: Column) -> Column:
        return F.struct(name.alias("section"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("active"), F.array().alias("items")).cast(kind)

    held = F.coalesce("held", F.array().cast(f"array<{kind}>"))
    page = F.coalesce("page", F.lit(0))
    every = F.transform(F.array(*map(F.lit, SECTIONS)), lambda n: F.coalesce(F.get(F.filter(held, lambda s: s["section"] == n), F.lit(0)).cast(kind), empty(n)))
    sections = F.filter(every, lambda s: (page == 0) | (F.size(s["items"]) > 0))
    person = F.struct("mrn", F.concat_ws(" ", "first_name", "last_name").alias("name"), F.col("birth_date").alias("date_of_birth"), "gender", "living_setting", "phone")
    total = F.coalesce("total_resources", F.lit(0))
    return out.select("patient_id", page.alias("page"), F.coalesce("pages", F.lit(1)).alias("pages"), F.when(total > 0, "success").otherwise("no_data").alias("status"), person.alias("patient"), total.alias("total_resources"), sections.alias("sections"))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """Capture metrics as report lines."""
    title = S.title_case(F.replace(F.col("category"), F.lit("_"), F.lit(" ")))
    line = F.format_string("%s: %d/%d (%.1f%%)", title, F.col("captured"), F.col("extracted"), F.col("rate"))
    mark = F.when(F.col("rate") >= 90, "good").when(F.col("rate") >= 70, "fair").otherwise("low")
    return metrics.select("category", line.alias("line"), mark.alias("mark"))


def record_summary(resources: DataFrame) -> DataFrame:
    """Per patient: resources, types, sources, first and last update, mean confidence."""
    return resources.groupBy("patient_id").agg(
        F.count("*").alias("resources"), F.countDistinct("resource_type").alias("types"), F.countDistinct("source_id").alias("sources"),
        F.min("updated_at").alias("first_update"), F.max("updated_at").alias("last_update"), S.half_up(F.avg("confidence"), 4).alias("confidence"),
    )


def resource_timeline(resources: DataFrame) -> DataFrame:
    """Resources per patient, month and type."""
    return resources.groupBy("patient_id", F.date_trunc("month", "updated_at").cast("date").alias("month"), "resource_type").agg(F.count("*").alias("n"))


def provider_activity(obs: DataFrame, providers: DataFrame) -> DataFrame:
    """Per provider: patients, visits, results, flagged share."""
    per = obs.groupBy(F.col("source_id").alias("provider_id")).agg(
        F.count("*").alias("results"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("encounter_id").alias("visits"),
        S.percent(F.count_if(F.col("flag") == "R"), F.count("*")).alias("flagged_share"),
    )
    return per.join(providers.select("provider_id", "name", "specialty"), "provider_id")


def document_audit(docs: DataFrame, usage: DataFrame) -> DataFrame:
    """Per document: status, attempts, calls and cost."""
    cost = usage.groupBy("doc_id").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    return docs.join(cost, "doc_id", "left").select(
        "doc_id", "status", "attempts", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost", F.lit(0)).cast("double").alias("cost")
    )
