"""Linking: encounters, panels, references, provenance and record comparison."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import scalar as S
from chartmill.operators.ordered import numbered, within_distance
from chartmill.session import cut_lineage


def _prefix(parts: Column, n: int) -> Column:
    return F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), "-"))


def by_date_offers(encounters: DataFrame) -> DataFrame:
    """First encounter per patient and date key, as one map for each year of a patient.

    Two dates agree when the coarser one is a prefix of the finer one, so they
    share their year. Keys of all prefixes (``prefix:``) answer rows of equal
    or coarser date, keys of whole texts (``whole:``) finer rows. A year has
    few different keys however many encounters it has.
    """
    parts = S.date_parts(F.col("date_text"))
    keys = F.array(
        *[F.concat(F.lit("prefix:"), _prefix(parts, n)) for n in (1, 2, 3)],
        *[F.when(F.size(parts) == n, F.concat(F.lit("whole:"), _prefix(parts, n))) for n in (1, 2)],
    )
    first = (
        encounters.filter("date_text IS NOT NULL").select("patient_id", "encounter_id", _prefix(parts, 1).alias("__year"), F.explode(F.array_compact(keys)).alias("key"))
        .groupBy("patient_id", "__year", "key").agg(F.min("encounter_id").alias("first"))
    )
    return first.groupBy("patient_id", "__year").agg(F.map_from_entries(F.collect_list(F.struct("key", "first"))).alias("__by_key"))


def with_date_match(rows: DataFrame, encounters: DataFrame, lone: bool = False) -> DataFrame:
    """Add ``by_date``: first encounter of the patient whose date agrees at the shared precision.

    ``rows(patient_id, date_text)``; ``encounters(patient_id, encounter_id, date_text)`` in order of
    ``encounter_id``. Rows move once, by patient and year, to the map of that
    year. With ``lone`` an undated row gets the patient's only encounter in
    ``__lone``, which stands beside the years.
    """
    offers = by_date_offers(encounters).withColumn("__lone", F.lit(None).cast(encounters.schema["encounter_id"].dataType))
    if lone:
        only = encounters.groupBy("patient_id").agg(F.count("*").alias("__n"), F.min("encounter_id").alias("__lone")).filter("__n = 1")
        offers = offers.unionByName(only.select("patient_id", F.lit("").alias("__year"), "__lone"), allowMissingColumns=True)
    parts = S.date_parts(F.col("date_text"))
    year = F.when(F.col("date_text").isNull(), "").otherwise(_prefix(parts, 1))
    out = rows.withColumn("__year", year).join(offers, ["patient_id", "__year"], "left")

    def offered(key: Column) -> Column:
        return F.try_element_at("__by_key", key)

    finer = [F.when(F.size(parts) > n, offered(F.concat(F.lit("whole:"), _prefix(parts, n)))) for n in (1, 2)]
    asked = offered(F.concat(F.lit("prefix:"), F.array_join(F.slice(parts, 1, 3), "-")))
    return out.withColumn("by_date", F.least(asked, *finer)).drop("__year", "__by_key")


def match_by_date(rows: DataFrame, row_id: str, encounters: DataFrame) -> DataFrame:
    """Rows ``(row_id, by_date)`` that ``with_date_match`` finds an encounter for."""
    return with_date_match(rows, encounters).filter("by_date IS NOT NULL").groupBy(row_id).agg(F.min("by_date").alias("by_date"))


def _with_reference(rows: DataFrame, encounters: DataFrame) -> DataFrame:
    """Add ``by_ref``: the hinted encounter, if it is known."""
    known = encounters.select(F.col("encounter_id").alias("encounter_ref"), F.col("encounter_id").alias("by_ref"))
    return rows.join(known, "encounter_ref", "left")


def link_encounters(rows: DataFrame, row_id: str, encounters: DataFrame) -> DataFrame:
    """Add ``visit``: hinted encounter, else date match, else the lone encounter for undated rows.

    A column ``encounter_ref`` of ``rows`` is the hint; one to an unknown encounter is ignored.
    """
    if "encounter_ref" in rows.columns:
        hinted = _with_reference(rows, encounters)
    else:
        hinted = rows.withColumn("by_ref", F.lit(None).cast(encounters.schema["encounter_id"].dataType))
    out = with_date_match(hinted, encounters, lone=True)
    tier = (
        F.when(F.col("by_ref").isNotNull(), "reference").when(F.col("by_date").isNotNull(), "date")
        .when(F.col("__lone").isNotNull(), "lone").otherwise("unlinked")
    )
    return out.withColumns({"visit": F.coalesce("by_ref", "by_date", "__lone"), "tier": tier}).drop("by_ref", "by_date", "__lone")


def group_by_visit(rows: DataFrame, row_id: str, encounters: DataFrame) -> DataFrame:
    """Counts per visit and tier; rows without a visit stay under 'unlinked'."""
    out = with_date_match(_with_reference(rows, encounters), encounters)
    visit = F.coalesce(F.coalesce("by_ref", "by_date").cast("string"), F.lit("unlinked"))
    tier = F.when(F.col("by_ref").isNotNull(), "reference").when(F.col("by_date").isNotNull(), "date").otherwise("unlinked")
    return out.groupBy("patient_id", visit.alias("visit"), tier.alias("tier")).agg(F.count("*").alias("n"))


def panel_members(reports: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations named by each report: ``(report_id, obs_id, flagged)``."""
    refs = reports.select("report_id", F.explode("result_refs").alias("obs_id"))
    return refs.join(obs.select("obs_id", "flagged"), "obs_id")


def panels(reports: DataFrame, obs: DataFrame) -> DataFrame:
    return panel_members(reports, obs).groupBy("report_id").agg(F.count("*").alias("results"), F.count_if("flagged").alias("flagged"))


def unclaimed(reports: DataFrame, obs: DataFrame) -> DataFrame:
    claimed = reports.select(F.explode("result_refs").alias("obs_id"))
    return obs.join(claimed, "obs_id", "left_anti")


def labs_by_visit(reports: DataFrame, obs: DataFrame) -> DataFrame:
    """Per visit: panels touched, other results, totals and flags; the rest as 'unlinked'.

    ``obs(obs_id, visit, flagged)``. A panel counts whole at each visit holding one of its results.
    """
    members = panel_members(reports, obs)
    size = panels(reports, obs)
    at = members.join(obs.filter("visit IS NOT NULL").select("obs_id", "visit"), "obs_id").select("visit", "report_id").distinct()
    with_panels = at.join(size, "report_id").groupBy("visit").agg(
        F.count("*").alias("panels"), F.sum("results").alias("in_panels"), F.sum("flagged").alias("panel_flags")
    )
    rest = unclaimed(reports, obs)
    others = rest.filter("visit IS NOT NULL").groupBy("visit").agg(F.count("*").alias("others"), F.count_if("flagged").alias("other_flags"))
    zero = F.lit(0)
    visits = with_panels.join(others, "visit", "full").select(
        F.col("visit").cast("string").alias("visit"), F.coalesce("panels", zero).alias("panels"), F.coalesce("others", zero).alias("others"),
        (F.coalesce("in_panels", zero) + F.coalesce("others", zero)).alias("total"),
        (F.coalesce("panel_flags", zero) + F.coalesce("other_flags", zero)).alias("flagged"),
    )
    orphan_panels = size.join(at, "report_id", "left_anti").agg(
        F.count("*").alias("panels"), F.coalesce(F.sum("results"), zero).alias("a"), F.coalesce(F.sum("flagged"), zero).alias("b")
    )
    orphan_rest = rest.filter("visit IS NULL").agg(F.count("*").alias("others"), F.count_if("flagged").alias("c"))
    orphans = orphan_panels.crossJoin(orphan_rest).select(  # two single rows
        F.lit("unlinked").alias("visit"), "panels", "others", (F.col("a") + F.col("others")).alias("total"), (F.col("b") + F.col("c")).alias("flagged")
    ).filter("total > 0")
    return visits.unionByName(orphans)


def dangling(rows: DataFrame, reference: str, targets: DataFrame, target_id: str) -> DataFrame:
    """Rows whose reference 'Type/id' points to an absent id."""
    asked = rows.withColumn("__id", F.substring_index(F.col(reference), "/", -1)).filter("__id IS NOT NULL")
    return asked.join(targets.select(F.col(target_id).cast("string").alias("__id")), "__id", "left_anti").drop("__id")


def match_kth(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """k-th row of ``left`` to the k-th row of ``right`` with the same keys."""

    def placed(df, row_id):
        return numbered(df.select(*keys, row_id), keys, [row_id], "k")

    return placed(left, left_id).join(placed(right, right_id), [*keys, "k"])


# existing rows of a block that are searched within one array
SMALL_BLOCK = 256


def find_existing(new: DataFrame, existing: DataFrame, new_id: str, existing_id: str, block: list[str], criteria: list[str]) -> DataFrame:
    """First existing row of the block that agrees on all criteria; a missing value matches anything.

    Existing rows of a block travel once, as one array, in which each new row
    looks for its first; larger blocks go by keys, which need no block in one task.
    """
    from chartmill.operators.dedup import split_by_size

    small, large = split_by_size(existing.select(*block, existing_id, *criteria), block, SMALL_BLOCK)
    arrays = small.groupBy(*block).agg(F.collect_list(F.struct(existing_id, *criteria)).alias("__rows"))  # SMALL_BLOCK rows at most

    def agrees(row: Column) -> Column:
        return reduce(Column.__and__, [F.col(c).isNull() | row[c].isNull() | (row[c] == F.col(c)) for c in criteria], F.lit(True))

    first = F.array_min(F.transform(F.filter("__rows", agrees), lambda r: r[existing_id]))
    found = new.select(*block, new_id, *criteria).join(arrays, block).select(new_id, first.alias(existing_id)).filter(F.col(existing_id).isNotNull())
    if large is not None:
        found = found.unionByName(_find_by_keys(new, large, new_id, existing_id, block, criteria))
    return found.groupBy(new_id).agg(F.min(existing_id).alias(existing_id))


def _find_by_keys(new: DataFrame, existing: DataFrame, new_id: str, existing_id: str, block: list[str], criteria: list[str]) -> DataFrame:
    """``find_existing`` for blocks of any size, perhaps several rows of a new one.

    Existing rows offer, for every subset of criteria a new row may fill, the
    values they share; new rows probe those keys. Offers are reduced to their
    first row, so the join is an equi join to unique keys.
    """

    gap = F.lit("\u0002")

    def key(given: list[str], shared) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), gap) if c in shared else gap for c in given]
        return F.concat_ws("\u0001", F.lit(",".join(given)), *parts)

    subsets = [list(s) for n in range(len(criteria) + 1) for s in combinations(criteria, n)]
    offers = (
        existing.select(*block, existing_id, F.explode(F.array(*[key(s, s) for s in subsets])).alias("key"))
        .groupBy(*block, "key").agg(F.min(existing_id).alias(existing_id))
    )
    given = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in criteria])
    probes = F
    for s in subsets:
        masks = [list(m) for n in range(len(s) + 1) for m in combinations(s, n)]
        probes = probes.when(given == ",".join(s), F.array(*[key(s, m) for m in masks]))
    asked = new.select(*block, new_id, F.explode(probes.otherwise(None)).alias("key"))
    return asked.join(offers, [*block, "key"]).select(new_id, existing_id)


def compare_records(extracted: DataFrame, record: DataFrame) -> DataFrame:
    """Field by field comparison ``(patient_id, field, value)`` of document and record.

    Adds similarity, discrepancy, its class and the suggested resolution.
    """
    e = extracted.select("patient_id", "field", F.nullif(F.trim("value"), F.lit("")).alias("extracted"), "confidence")
    r = record.select("patient_id", "field", F.nullif(F.trim("value"), F.lit("")).alias("recorded"))
    out = e.join(r, ["patient_id", "field"], "full")
    a = S.comparison_form(F.col("extracted"), F.col("field"))
    b = S.comparison_form(F.col("recorded"), F.col("field"))
    out = out.withColumns({"__a": a, "__b": b})
    both, one = F.col("extracted").isNull() & F.col("recorded").isNull(), F.col("extracted").isNull() | F.col("recorded").isNull()
    similarity = F.when(both, 1.0).when(one, 0.0).otherwise(S.edit_similarity(F.col("__a"), F.col("__b")))
    out = out.withColumn("similarity", similarity).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))
    return out.withColumns(
        {
            "different": F.col("similarity") < SIMILAR, "kind": discrepancy_class(F.col("extracted"), F.col("recorded"), F.col("similarity")),
            "resolution": suggested_resolution(F.col("extracted"), F.col("recorded"), F.col("confidence"), F.col("similarity")),
            "category": S.comparison_category(F.col("field")),
        }
    ).drop("__a", "__b")


# fixed values: comparison thresholds
SIMILAR, CONFIDENT, UNSURE = 0.85, 0.8, 0.5


def discrepancy_class(extracted: Column, recorded: Column, similarity: Column) -> Column:
    return (
        F.when(extracted.isNull() & recorded.isNull(), "no_data").when(extracted.isNull(), "missing_extracted")
        .when(recorded.isNull(), "missing_patient").when(similarity >= 0.9, "minor_difference")
        .when(similarity >= 0.7, "moderate_difference").otherwise("major_difference")
    )


def suggested_resolution(extracted: Column, recorded: Column, confidence: Column, similarity: Column) -> Column:
    return (
        F.when(similarity >= SIMILAR, "no_change").when(extracted.isNull(), "keep_existing")
        .when(recorded.isNull(), F.when(confidence >= UNSURE, "use_extracted").otherwise("manual_edit"))
        .when(confidence >= CONFIDENT, "use_extracted").when(confidence < UNSURE, "manual_edit")
        .when(F.length(extracted) > F.length(recorded), "use_extracted").otherwise("keep_existing")
    )


def suggestion_bucket(different: Column, resolution: Column, confidence: Column) -> Column:
    return F.when(
        different,
        F.when((confidence >= CONFIDENT) & (resolution == "use_extracted"), "auto_resolution")
        .when(confidence >= CONFIDENT, "high_confidence_update").when(confidence < UNSURE, "low_confidence_warning")
        .otherwise("manual_review"),
    )


def provider_links(rows: DataFrame) -> DataFrame:
    """Patients and documents per provider."""
    return rows.groupBy("provider_id").agg(F.countDistinct("patient_id").alias("patients"), F.countDistinct("doc_id").alias("documents"))


def related_changes(changes: DataFrame, minutes: int = 60) -> DataFrame:
    """Number of other changes by the same reviewer within the time window of each change."""
    rows = changes.withColumn("__at", F.unix_micros(F.col("created_at").cast("timestamp")))
    out = within_distance(rows, ["reviewer"], "__at", minutes * 60_000_000, F.lit(1), "sum", "__n")
    return out.withColumn("related", F.col("__n") - 1).drop("__at", "__n")


def related_to(changes: DataFrame, change_id: int, minutes: int = 60) -> DataFrame:
    """The other changes by the same reviewer around one given change."""
    one = changes.filter(F.col("change_id") == change_id).select("reviewer", F.col("created_at").alias("__c"), F.col("change_id").alias("__id"))
    near = F.abs(F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("__c").cast("timestamp"))) <= minutes * 60_000_000
    return changes.join(F.broadcast(one), "reviewer").filter(near & (F.col("change_id") != F.col("__id"))).drop("__c", "__id")  # one row


def provenance_chains(links: DataFrame, item: str, previous: str) -> DataFrame:
    """Root and depth of each item by following its previous item.

    Pointer doubling: after round k each item knows its ancestor 2^k steps up,
    so the number of joins is logarithmic in the longest chain. A pointer to an
    absent item ends the chain. Each round settles some item of every open chain,
    so when a round settles none only cycles are left; their items have no root.
    Settled items have no pointer any more. They stay where they are, for a join
    would bring all of them into the task of the missing key.
    """
    zero = F.lit(0).cast("bigint")
    known = links.select(F.col(item).alias("id"), F.col(previous).alias("__up"))
    ids = links.select(F.col(item).alias("__up"), F.lit(True).alias("__ok"))
    present = known.filter("__up IS NOT NULL").join(ids, "__up", "left").select("id", F.when(F.col("__ok"), F.col("__up")).alias("up"))
    first = present.unionByName(known.filter("__up IS NULL").select("id", F.col("__up").alias("up")))
    ended = F.col("up").isNull()
    state = cut_lineage(first.select("id", "up", F.when(ended, zero).otherwise(1).alias("steps"), F.when(ended, F.col("id")).alias("root")))
    settled, pending = state.filter(ended), state.filter(~ended)
    left = None
    while (now := pending.count()) and now != left:
        left = now
        above = settled.unionByName(pending).select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__s"), F.col("root").alias("__r"))
        moved = cut_lineage(
            pending.join(above, "up", "left").select(
                "id", F.col("__up").alias("up"), (F.col("steps") + F.coalesce("__s", zero)).alias("steps"), F.coalesce("root", "__r").alias("root"),
            )
        )
        settled, pending = settled.unionByName(moved.filter(ended)), moved.filter(~ended)
    state = settled.unionByName(pending)
    return state.select(F.col("id").alias(item), "root", F.col("steps").alias("depth"))


def latest_provenance(rows: DataFrame) -> DataFrame:
    """Newest provenance row per target with counts over its history."""
    return rows.groupBy("target").agg(
        F.max_by("provenance_id", F.struct("recorded", "provenance_id")).alias("latest"), F.max("recorded").alias("recorded"),
        F.count("*").alias("entries"), F.countDistinct("activity").alias("activities"), F.countDistinct("source").alias("sources"),
    )
