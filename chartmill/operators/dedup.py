"""Deduplication of clinical rows.

Every rule is written as "is there an earlier (or better) row near enough", so
no operator lists the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import fixed, scalar as S
from chartmill.operators.ordered import within_distance
from chartmill.operators.weighted import with_matching
from chartmill.session import cut_lineage

LOG_SCALE = 1_000_000_000
TEN_PERCENT = 105_360_516  # -ln(0.9) on the log scale, rounded up
SMALL_GROUP = 64  # rows that are compared within one array


def content_hash(df: DataFrame, columns: Sequence[str], name: str = "content_hash") -> DataFrame:
    """Hash of the clinical columns in name order; empty ones do not count."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in sorted(columns)]
    return df.withColumn(name, F.sha2(F.concat_ws("|", *parts), 256))


def first_per_key(df: DataFrame, keys: Sequence[Column], order: Column) -> DataFrame:
    """First row of each key by ``order`` as a combining aggregate."""
    row = F.struct(*[F.col(c) for c in df.columns])
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(row, order).alias("__r")).select("__r.*")


def exact_first(items: DataFrame, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First item per lower-cased identity fields of a document."""
    keys = [F.col("doc_id"), *[F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in fields]]
    return first_per_key(items, keys, F.struct(*order))


def values_near(df: DataFrame, keys: Sequence[str], value: str, order: Column, name: str) -> DataFrame:
    """Smallest ``order`` among rows of the key whose value lies within ten percent.

    Ten percent of the larger value is a distance on the log axis. Zero equals
    zero and reaches up to 0.1 in either direction. Exact for values of up to
    eight significant digits.
    """
    keys = list(keys)
    v = F.col(value)
    df = df.withColumns({
        "__order": order, "__sign": F.signum(v).cast("int"),
        "__log": F.when(v == 0, F.lit(0)).otherwise(F.round(F.ln(F.abs(v)) * LOG_SCALE)).cast("bigint"),
    })
    out = within_distance(df, [*keys, "__sign"], "__log", TEN_PERCENT, F.col("__order"), "min", "__near")
    tiny = (v != 0) & (F.abs(v) <= 0.1)
    edge = df.filter((v == 0) | tiny).groupBy(*keys).agg(
        F.min(F.when(v == 0, F.col("__order"))).alias("__zero"), F.min(F.when(tiny, F.col("__order"))).alias("__tiny")
    )
    out = out.join(edge, keys, "left")
    extra = F.when(v == 0, F.col("__tiny")).when(tiny, F.col("__zero"))
    return out.withColumn(name, F.least("__near", extra)).drop("__order", "__sign", "__log", "__near", "__zero", "__tiny")


def split_by_size(rows: DataFrame, keys: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with up to ``most`` rows (``SMALL_GROUP``), and those of larger keys, None if there are none."""
    most = SMALL_GROUP if most is None else most
    large = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(*keys))
    if large.isEmpty():
        return rows, None
    return rows.join(large, list(keys), "left_anti"), rows.join(large, list(keys), "left_semi")


def _values_agree(v: Column, w: Column) -> Column:
    """Within ten percent of the larger value, or of zero and at most 0.1."""
    gap, top = F.abs(v - w), F.greatest(F.abs(v), F.abs(w))
    return F.when((v == 0) | (w == 0), gap <= 0.1).otherwise(gap * 10 <= top * (1 + 1e-12))


def observation_duplicates(obs: DataFrame, order: Column, hours: int = 24, fields: Sequence[str] = ()) -> DataFrame:
    """Earlier partner of each duplicate observation and how close it is.

    ``obs(patient_id, obs_id, code, value, unit, at)``. Weights are code 3,
    patient 2, value 2 and time 1 of 8, compared within a patient. At 0.7 two
    rows are duplicates when the code agrees and the value (0.875) or the time
    (0.75) does; both make 1.0, which is near, or exact when all content is
    equal. A row is a duplicate when an earlier one matches, whether or not
    that one is itself removed. With ``fields`` the equal ones of both rows
    stand in ``matching``, as ``weighted.with_matching`` lists them; the order
    is then the row's id.
    """
    judged = judged_observations(obs.filter("patient_id IS NOT NULL AND code IS NOT NULL"), order, hours, fields)
    return judged.filter("kind IS NOT NULL")


def judged_observations(obs: DataFrame, order: Column, hours: int = 24, fields: Sequence[str] = ()) -> DataFrame:
    """Every observation with what ``observation_duplicates`` finds for it, null for rows that are no duplicate.

    A patient has few rows of one test. They travel once, as one array, in
    which each row looks for its partners; larger groups go by way of
    distances, which need no group in one task.
    """
    group = ["patient_id", "code"]
    obs = obs.withColumn("__ord", order)
    known = obs.filter("patient_id IS NOT NULL AND code IS NOT NULL")
    small, large = split_by_size(known, group)
    out = _judged_in_groups(small, hours, fields)
    columns = out.columns
    if large is not None:
        found = _judged_by_distance(large.drop("__ord"), order, hours)
        if fields:
            lone, twins = found.filter("kind IS NULL").withColumn("matching", F.lit(None).cast("string")), found.filter("kind IS NOT NULL")
            found = lone.unionByName(with_matching(twins, large, "obs_id", fields))
        out = out.unionByName(found.select(*columns))
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in columns[2:]}
    keyless = obs.filter("patient_id IS NULL OR code IS NULL").select("patient_id", "obs_id", *[c.alias(n) for n, c in none.items()])
    return out.unionByName(keyless)


def _judged_in_groups(rows: DataFrame, hours: int, fields: Sequence[str]) -> DataFrame:
    width = hours * 3_600_000_000
    carried = list(dict.fromkeys(["obs_id", "value", "unit", *[f for f in fields if f not in ("patient_id", "code")]]))
    row = F.struct("__ord", F.unix_micros(F.col("at").cast("timestamp")).alias("__at"), *carried)
    groups = rows.groupBy("patient_id", "code").agg(F.collect_list(row).alias("__rows"))  # SMALL_GROUP rows at most
    kind_of = groups.schema["__rows"].dataType.elementType
    none = F.lit(None).cast(kind_of)

    def judge(a: Column) -> Column:
        def meet(found: Column, b: Column) -> Column:
            time = F.abs(a["__at"] - b["__at"]) <= width
            value = (a["unit"] == b["unit"]) & _values_agree(a["value"], b["value"])
            copy = (a["unit"] == b["unit"]) & (a["value"] == b["value"]) & (a["__at"] == b["__at"])
            tests = {"copy": copy, "both": time & value, "value": value, "time": time}
            nearer = F.struct(*[F.least(found[n], F.when(t, b)).alias(n) for n, t in tests.items()])
            return F.when(b["__ord"] < a["__ord"], nearer).otherwise(found)

        start = F.struct(*[none.alias(n) for n in ("copy", "both", "value", "time")])
        return F.struct(a.alias("own"), F.aggregate("__rows", start, meet).alias("met"))

    each = groups.select("patient_id", "code", F.inline(F.transform("__rows", judge)))
    kind = F.when(F.col("met.copy").isNotNull(), "exact").when(F.col("met.both").isNotNull(), "near").when(F.coalesce("met.value", "met.time").isNotNull(), "fuzzy")
    score = F.when(F.coalesce("met.copy", "met.both").isNotNull(), 1.0).when(F.col("met.value").isNotNull(), 0.875).when(F.col("met.time").isNotNull(), 0.75)
    partner = F.coalesce("met.copy", "met.both", "met.value", "met.time")
    out = each.select("patient_id", "code", "own", kind.alias("kind"), partner.alias("partner"), score.alias("score"))
    columns = ["patient_id", F.col("own.obs_id").alias("obs_id"), "kind", F.col("partner.__ord").alias("partner"), "score"]
    if fields:
        same = [F.lit(c) if c in ("patient_id", "code") else F.when(F.col(f"own.{c}").eqNullSafe(F.col(f"partner.{c}")), F.lit(c)) for c in sorted(fields)]
        columns.append(F.when(F.col("kind") == "exact", "*").when(F.col("kind").isNotNull(), F.concat_ws(",", *same)).alias("matching"))
    return out.select(*columns)


def _judged_by_distance(obs: DataFrame, order: Column, hours: int) -> DataFrame:
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    rows = obs.withColumns({"__ord": order, "__at": micros})
    group = ["patient_id", "code"]
    rows = within_distance(rows, group, "__at", hours * 3_600_000_000, F.col("__ord"), "min", "__by_time")
    rows = values_near(rows, [*group, "unit"], "value", F.col("__ord"), "__by_value")
    same = obs.withColumn("__ord", order).groupBy(*group, "unit", "value", "at").agg(F.min("__ord").alias("__copy"))
    both = _near_in_both(obs.withColumns({"__ord": order, "__at": micros}), hours)
    rows = rows.join(same, [*group, "unit", "value", "at"], "left").join(both, [*group, "unit", "value", "__at"], "left")
    own = F.col("__ord")
    exact, near = F.col("__copy") < own, F.col("__both") < own
    value, time = F.col("__by_value") < own, F.col("__by_time") < own
    kind = F.when(exact, "exact").when(near, "near").when(value | time, "fuzzy")
    partner = F.when(exact, F.col("__copy")).when(near, F.col("__both")).when(value, F.col("__by_value")).when(time, F.col("__by_time"))
    score = F.when(exact | near, 1.0).when(value, 0.875).when(time, 0.75)
    return rows.select("patient_id", "obs_id", kind.alias("kind"), partner.alias("partner"), score.alias("score"))


def _near_in_both(rows: DataFrame, hours: int) -> DataFrame:
    """Smallest order among rows near in value and in time.

    Copies collapse first; the distinct measurements of a patient and test then
    meet only those of the same or a neighbouring day.
    """
    keys = ["patient_id", "code", "unit"]
    width = hours * 3_600_000_000
    points = rows.groupBy(*keys, "value", "__at").agg(F.min("__ord").alias("__o"))
    block = F.floor(F.col("__at") / width).cast("bigint")
    left = points.withColumn("__b", block)
    right = points.select(
        *keys, F.col("value").alias("__v2"), F.col("__at").alias("__a2"), F.col("__o").alias("__o2"),
        F.explode(F.array(block - 1, block, block + 1)).alias("__b"),
    )
    near = _values_agree(F.col("value"), F.col("__v2"))
    met = left.join(right, [*keys, "__b"]).filter((F.abs(F.col("__at") - F.col("__a2")) <= width) & near)
    return met.groupBy(*keys, "value", "__at").agg(F.min("__o2").alias("__both"))


def coded_duplicates(rows: DataFrame, row_id: str, keys: Sequence[str], third: Column, order: Column, strict_reference: bool = False) -> DataFrame:
    """Duplicates of conditions or medications: code 3, patient 2, third factor 1 of 6.

    With equal codes 5 of 6 are reached already (fuzzy), an equal third factor
    makes 1.0 (near). ``keys`` is patient and code; ``strict_reference`` calls
    codes of one system similar (2 points), which makes the third factor decide.
    """
    rows = rows.withColumns({"__ord": order, "__third": third})
    block = list(keys[:1]) if strict_reference else list(keys)
    by_third = rows.filter("__third IS NOT NULL").groupBy(*block, "__third").agg(F.min("__ord").alias("__near"))
    out = rows.join(by_third, [*block, "__third"], "left")
    by_code = rows.groupBy(*keys).agg(F.min("__ord").alias("__fuzzy"))
    out = out.join(by_code, list(keys), "left")
    near, fuzzy = F.col("__near") < F.col("__ord"), F.col("__fuzzy") < F.col("__ord")
    return out.filter(near | fuzzy).select(
        *keys, row_id, F.when(near, "near").otherwise("fuzzy").alias("kind"), F.when(near, F.col("__near")).otherwise(F.col("__fuzzy")).alias("partner")
    )


def remove_duplicates(rows: DataFrame, row_id: str, duplicates: DataFrame) -> DataFrame:
    """Rows that are nobody's later partner, with the number of rows merged into each."""
    return _with_merged(rows.join(duplicates.select(row_id), row_id, "left_anti"), row_id, duplicates)


def _with_merged(kept: DataFrame, row_id: str, duplicates: DataFrame) -> DataFrame:
    merged = duplicates.groupBy(F.col("partner").alias(row_id)).agg(F.count("*").alias("merged"))
    return kept.join(merged, row_id, "left").fillna(0, ["merged"])


def remove_judged(judged: DataFrame, row_id: str) -> DataFrame:
    """``remove_duplicates`` of rows that carry their own verdict in ``kind`` and ``partner``."""
    return _with_merged(judged.filter("kind IS NULL"), row_id, judged.filter("kind IS NOT NULL"))


def rank_order(confidence: Column, resource_type: Column, position: Column) -> Column:
    """Sort key of bundle deduplication: confidence descending, type, original position."""
    return F.struct((-F.coalesce(confidence, F.lit(0.0))).alias("c"), resource_type.alias("t"), position.alias("p"))


def equivalent_observations(obs: DataFrame, order: Column, keep_latest: bool = True, hours: int = 24) -> DataFrame:
    """Observations that survive bundle deduplication.

    Rows with equal patient, code and printed value within ``hours`` form a star
    around each row. Of each star only the newest (by ``order``) stays, or with
    ``keep_latest=False`` only the first; a row stays when it loses no star.
    It loses none exactly when, among all its neighbours, the best neighbour
    is always the row itself.
    """
    keys = ["patient_id", "code", "__text"]
    text = F.trim(F.concat_ws(" ", F.col("value").cast("string"), F.col("unit")))
    rows = obs.withColumns({"__text": text, "__at": F.unix_micros(F.col("at").cast("timestamp")), "__ord": order})
    width = hours * 3_600_000_000
    keyless = obs.filter("patient_id IS NULL OR code IS NULL")
    small, large = split_by_size(rows.filter("patient_id IS NOT NULL AND code IS NOT NULL"), keys)
    row = F.struct("__ord", "__at", F.struct(*obs.columns).alias("__row"))
    groups = small.groupBy(*keys).agg(F.collect_list(row).alias("__rows"))  # SMALL_GROUP rows at most

    def best(a: Column, name: str, pick) -> Column:
        return F.coalesce(pick(F.transform(F.filter("__rows", lambda b: F.abs(a["__at"] - b["__at"]) <= width), lambda b: b[name])), a[name])

    if keep_latest:
        groups = groups.withColumn("__rows", F.transform("__rows", lambda a: F.struct(a["__ord"].alias("__ord"), a["__at"].alias("__at"), a["__row"].alias("__row"), best(a, "__ord", F.array_max).alias("__best"))))
        kept = F.filter("__rows", lambda a: best(a, "__best", F.array_max) == a["__ord"])
    else:
        kept = F.filter("__rows", lambda a: best(a, "__ord", F.array_min) == a["__ord"])
    out = groups.select(F.inline(F.transform(kept, lambda a: a["__row"]))).unionByName(keyless)
    if large is None:
        return out
    if keep_latest:
        large = within_distance(large, keys, "__at", width, F.col("__ord"), "max", "__best").withColumn("__best", F.coalesce("__best", "__ord"))
        large = within_distance(large, keys, "__at", width, F.col("__best"), "max", "__best2").withColumn("__best2", F.coalesce("__best2", "__ord"))
        large = large.filter(F.col("__best2") == F.col("__ord"))
    else:
        large = within_distance(large, keys, "__at", width, F.col("__ord"), "min", "__best")
        large = large.filter(F.coalesce("__best", "__ord") == F.col("__ord"))
    return out.unionByName(large.select(*obs.columns))


def first_by_any_key(rows: DataFrame, row_id: str, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows without an earlier row that shares any of the filled key sets."""
    out = rows
    beaten = F.lit(False)
    for i, keys in enumerate(key_sets):
        filled = rows
        for k in keys:
            filled = filled.filter(F.col(k).isNotNull())
        firsts = filled.groupBy(*keys).agg(F.min(row_id).alias(f"__f{i}"))
        out = out.join(firsts, list(keys), "left")
        beaten = beaten | F.coalesce(F.col(f"__f{i}") < F.col(row_id), F.lit(False))
    return out.filter(~beaten).select(*rows.columns)


def newest_equivalent(rows: DataFrame) -> DataFrame:
    """Of a patient's resources with equal type, code and content the newest, then the one of the latest source and id.

    The rows collapse before the shuffle, so a hot patient is no task of its own.
    """
    keys = ["patient_id", "resource_type", "code", "body"]
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(row, F.struct("updated_at", "source_id", "resource_id")).alias("__r")).select("__r.*")


def equivalent_patients(rows: DataFrame) -> DataFrame:
    """First patient of each identity: equal record numbers when both have one, else name and birth date."""
    by_mrn = rows.filter("mrn IS NOT NULL").groupBy("mrn").agg(F.min("patient_id").alias("__m"))
    person = rows.groupBy("name", "birth_date").agg(
        F.min("patient_id").alias("__any"), F.min(F.when(F.col("mrn").isNull(), F.col("patient_id"))).alias("__bare")
    )
    out = rows.join(by_mrn, "mrn", "left").join(person, ["name", "birth_date"], "left")
    rival = F.when(F.col("mrn").isNull(), F.col("__any")).otherwise(F.least("__m", "__bare"))
    return out.filter(~F.coalesce(rival < F.col("patient_id"), F.lit(False))).select(*rows.columns)


def is_known(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark new rows that equal an existing row in all keys, empty equals empty."""
    known = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
    on = [new[k].eqNullSafe(known[f"__{k}"]) for k in keys]
    return new.join(known, on, "left").withColumn("duplicate", F.col("__hit").isNotNull()).select(*new.columns, "duplicate")


# ---------------------------------------------------------------- fields, medications, encounters
def _medication_details(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(low.rlike(r"\d+\s*(mg|ml|mcg|units?|iu)"), 1).otherwise(0)
        + F.when(S.any_of(low, ["daily", "twice", "bid", "tid", "qid", "prn"]), 1).otherwise(0)
        + F.when(S.any_of(low, ["morning", "evening", "bedtime", "meals"]), 1).otherwise(0)
    )


def merge_fields(fields: DataFrame) -> DataFrame:
    """Best field per document, class and key, with the chunks it was seen in.

    ``fields(doc_id, chunk, ord, code_id, label, value, confidence)`` in order of (chunk, ord, code_id).
    """
    # one projection per step, so that each class test is evaluated once
    steps = fields.withColumn("low", F.lower("label"))
    steps = steps.withColumn("field_class", S.field_class(F.col("low")))
    label, value, c, kind = F.col("low"), F.col("value"), F.col("confidence"), F.col("field_class")
    size = F.length(F.trim("value"))
    key = (
        F.when(kind == "patient_demographics", S.demographic_label(label)).when(kind == "diagnoses", S.normalize_diagnosis(value))
        .when(kind == "medications", S.short_drug_name(value)).when(kind == "lab_results", S.lab_test_name(label, value))
        .when(kind == "dates", S.date_kind(label)).otherwise(F.trim(label))
    )
    first = F.when(kind == "diagnoses", size.cast("double")).when(kind == "medications", _medication_details(value).cast("double")).otherwise(c)
    second = F.when(kind.isin("diagnoses", "medications"), c).otherwise(size.cast("double"))
    place = F.struct((-F.col("chunk")).alias("a"), (-F.col("ord")).alias("b"), (-F.col("code_id")).alias("c"))
    steps = steps.withColumn("key", key)
    rows = steps.select("doc_id", "chunk", "label", "value", "confidence", "field_class", "key", F.struct(first.alias("x"), second.alias("y"), place.alias("z")).alias("rank"))
    best = F.max_by(F.struct("label", "value", "confidence"), F.col("rank"))
    # the blank-key test reads an aggregate: a filter on the key itself would be pushed
    # below every projection and repeat their expressions
    out = rows.groupBy("doc_id", "field_class", "key").agg(
        best.alias("b"), F.count("*").alias("n"), F.max(F.length("key")).alias("key_length"), F.array_join(F.array_sort(F.collect_set("chunk")), ",").alias("chunks")  # at most 25 chunks a document
    )
    return out.filter("key_length > 0").select("doc_id", "field_class", "key", "b.label", "b.value", "b.confidence", "n", "chunks")


ACTIVE_MEDICATION = ["active", "intended", "on-hold"]


def merge_medications(meds: DataFrame) -> DataFrame:
    """One row per patient, drug and dose: the newest start survives, the first on ties.

    Distinct dosage texts are joined in order. A survivor that is not active takes
    the status of the first active row after it in record order (``med_id``).
    """
    rows = meds.withColumns({"drug": S.drug_key(F.col("name")), "dose_key": S.squeeze(F.lower(F.coalesce("dose", F.lit(""))))})
    keys = ["patient_id", "drug", "dose_key"]
    start = F.coalesce("start_date", F.lit("0000-00-00"))
    newest = rows.groupBy(*keys).agg(F.max(start).alias("__start"))
    survivor = rows.withColumn("__start", start).join(newest, [*keys, "__start"], "left_semi").groupBy(*keys).agg(
        F.min(F.struct("med_id", "status", "start_date")).alias("s"), 
    )
    later = rows.filter(F.col("status").isin(ACTIVE_MEDICATION)).join(survivor.select(*keys, F.col("s.med_id").alias("__sid")), keys)
    lift = later.filter("med_id > __sid").groupBy(*keys).agg(F.min(F.struct("med_id", "status")).alias("l"))
    texts = rows.filter(F.trim("schedule") != "").groupBy(*keys, F.lower(F.trim("schedule")).alias("t")).agg(F.min(F.struct("med_id", "schedule")).alias("m"))
    sigs = texts.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # distinct dosage texts of one drug and dose
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    out = survivor.join(n, keys).join(lift, keys, "left").join(sigs, keys, "left")
    status = F.when(F.col("s.status").isin(ACTIVE_MEDICATION), F.col("s.status")).otherwise(F.coalesce("l.status", "s.status"))
    return out.select(*keys, F.col("s.med_id").alias("med_id"), F.col("s.start_date").alias("start_date"), status.alias("status"), "n",
                      F.array_join(F.transform("ms", lambda m: m["schedule"]), "; ").alias("dosage"))


def merge_encounters(encounters: DataFrame) -> DataFrame:
    """Richest encounter per patient, date, type and place; rows without date and place stay."""
    date = F.coalesce(F.substring("date_text", 1, 10), F.lit(""))
    place = F.trim(F.substring_index(F.lower(F.trim(F.coalesce("location", F.lit("")))), ",", 1))
    bare = (date == "") & (place == "")
    own = F.when(bare, F.col("encounter_id").cast("string")).otherwise("")
    kind = F.when(bare, "").otherwise(F.coalesce("enc_class", F.lit("")))
    rich = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("location", "reason", "type_text")), F.lit(0))
    return first_per_key(encounters, [F.col("patient_id"), own, date, kind, place], F.struct((-rich).alias("r"), F.col("encounter_id")))


def duplicate_medications(meds: DataFrame) -> DataFrame:
    """Active medications sharing the normalised name: first row, number of rows and of pairs."""
    active = meds.filter("status = 'active'").select("patient_id", "med_id", S.normalize_drug(F.col("name")).alias("drug"))
    n = active.groupBy("patient_id", "drug").agg(F.count("*").alias("n"), F.min("med_id").alias("first_id")).filter("n > 1")
    return n.withColumn("pairs", F.expr("n * (n - 1) div 2"))


def fuzzy_items(items: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy name dedup per document and kind; a more confident similar item replaces the kept one.

    The rule is order-bound inside a document. ``items(doc_id, kind, position, name, confidence)``;
    a document is cut into at most 25 chunks before extraction, which bounds the group.
    """

    columns = items.select("doc_id", "kind", "position", "name", "confidence")

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from chartmill.functions.udfs import ratio

        group, kept = None, []
        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                if (row.doc_id, row.kind) != group:
                    done += kept
                    group, kept = (row.doc_id, row.kind), []
                name = row.name.lower()
                for i, other in enumerate(kept):
                    if ratio(name, other.name.lower()) > threshold:
                        if row.confidence > other.confidence:
                            kept[i] = row
                        break
                else:
                    kept.append(row)
            yield pd.DataFrame(done, columns=pdf.columns)
        yield pd.DataFrame(kept, columns=["doc_id", "kind", "position", "name", "confidence"])

    # sorted partitions stream through: only the kept items of one document are held
    sorted_items = columns.repartition("doc_id", "kind").sortWithinPartitions("doc_id", "kind", "position")
    return sorted_items.mapInPandas(greedy, columns.schema)


def completeness_score(columns: dict[str, float]) -> Column:
    """One point per filled column plus its extra weight."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1.0).otherwise(0.0) + F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in columns.items()), F.lit(0.0))


def most_complete(rows: DataFrame, keys: Sequence[str], score: Column, at: Column, actor: Column, content: str, row_id: str) -> DataFrame:
    """Most complete row per key, then the newest, then one with an actor, then the smaller content hash."""
    rows = rows.withColumns({"__score": score, "__rank": F.struct((-score).alias("s"), at.isNull().alias("n"), (-F.unix_micros(at.cast("timestamp"))).alias("t"), (~actor).alias("a"), F.col(content), F.col(row_id))})
    best = F.min_by(F.struct(row_id, "__score"), F.col("__rank"))
    return rows.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("n")).select(*keys, F.col(f"b.{row_id}").alias(row_id), F.col("b.__score").alias("score"), "n")
