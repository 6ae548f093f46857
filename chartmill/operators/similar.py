"""Pairs of similar texts without comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions.udfs import seq_ratio
from chartmill.session import cut_lineage


def shared_bigrams(len_a: Column, len_b: Column, threshold: float) -> Column:
    """Pairs of neighbouring letters that two texts of these lengths must share, in place but for few letters, to reach a ratio.

    A ratio of ``threshold`` leaves at most ``(1 - threshold)`` of all letters
    unmatched. An unmatched letter breaks two pairs of its own text and one of
    the other. 0 or less promises nothing.
    """
    total = len_a + len_b
    free = F.floor(total * (1 - threshold) + 1e-9)
    # both texts have the same number of matched letters
    free = free - (total - free) % 2
    matched = F.least((total - free) / 2, len_a, len_b)
    left, right = len_a - matched, len_b - matched
    return F.greatest(len_a - 1 - left * 2 - right, len_b - 1 - right * 2 - left)


def _bigram_pairs(texts: DataFrame, block: list[str], text: str, threshold: float) -> DataFrame:
    """Candidates among texts whose lengths promise a shared bigram.

    Of each text the rarest bigrams are indexed, as many as it takes for two
    texts with the promised number in common to meet in one of them. They meet
    only where the bigram stands at about the same place: matched letters
    shift by as many letters as are unmatched.
    """
    n = F.length(text)
    # partners can be as short or long as the ratio allows
    partners = F.sequence(F.greatest(F.lit(1), F.ceil(n * (threshold / (2 - threshold)) - 1e-9)), F.floor(n * ((2 - threshold) / threshold) + 1e-9))
    promised = F.filter(F.transform(partners, lambda m: shared_bigrams(n.cast("double"), m.cast("double"), threshold)), lambda x: x >= 1)
    bigrams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.substring(F.col(text), i, 2).alias("gram"), i.alias("at")))
    usable = texts.filter(n >= 2).select(*block, text, n.alias("len"), F.array_min(promised).alias("least"), F.inline(bigrams)).filter("least IS NOT NULL")
    rarity = usable.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = usable.join(rarity, "gram").groupBy(*block, text, "len", "least").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "at"))).alias("grams"))  # one text's own bigrams
    kept = F.slice("grams", 1, F.greatest(F.col("len") - F.col("least"), F.lit(1)).cast("int"))
    index = ranked.select(*block, text, "len", F.inline(F.transform(kept, lambda g: F.struct(g["gram"].alias("gram"), g["at"].alias("at")))))
    a = index.select(*block, "gram", F.col(text).alias("text_a"), F.col("len").alias("len_a"), F.col("at").alias("at_a"))
    b = index.select(*block, "gram", F.col(text).alias("text_b"), F.col("len").alias("len_b"), F.col("at").alias("at_b"))
    # unmatched letters of the longer text: no matched letter shifts further
    total = F.col("len_a") + F.col("len_b")
    shift = F.greatest("len_a", "len_b") - total * (threshold / 2)
    near = F.abs(F.col("at_a") - F.col("at_b")) <= shift + 1e-9
    return a.join(b, [*block, "gram"]).filter((F.col("text_a") < F.col("text_b")) & near).select(*block, "text_a", "text_b", "len_a", "len_b").distinct()


def _letter_pairs(texts: DataFrame, block: list[str], text: str, threshold: float) -> DataFrame:
    """Candidates among texts of lengths that promise no shared bigram, which are short, by their rarest letters.

    A ratio above t needs common letters for t/2 of both lengths together,
    hence for t/(2-t) of either one.
    """
    n = F.length(text)
    partners = F.sequence(F.greatest(F.lit(1), F.ceil(n * (threshold / (2 - threshold)) - 1e-9)), F.floor(n * ((2 - threshold) / threshold) + 1e-9))
    short = texts.filter(F.exists(partners, lambda m: shared_bigrams(n.cast("double"), m.cast("double"), threshold) < 1))
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    runs = F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.size(F.filter(chars, lambda x: x == c)).alias("n")))
    tokens = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), r["n"]), lambda i: F.concat(r["c"], i.cast("string")))))
    exploded = short.select(*block, text, n.alias("len"), F.explode(tokens).alias("token"))
    rarity = exploded.groupBy("token").agg(F.count("*").alias("df"))
    ordered = exploded.join(rarity, "token").groupBy(*block, text, "len").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))  # one text's own letters
    keep = (F.col("len") - F.ceil(F.col("len") * (threshold / (2 - threshold)) - 1e-9) + 1).cast("int")
    p = ordered.select(*block, text, "len", F.explode(F.slice("ts", 1, F.greatest(keep, F.lit(1)))).alias("t"))
    a = p.select(*block, F.col("t.token").alias("token"), F.col(text).alias("text_a"), F.col("len").alias("len_a"))
    b = p.select(*block, F.col("t.token").alias("token"), F.col(text).alias("text_b"), F.col("len").alias("len_b"))
    unpromised = shared_bigrams(F.col("len_a").cast("double"), F.col("len_b").cast("double"), threshold) < 1
    return a.join(b, [*block, "token"]).filter((F.col("text_a") < F.col("text_b")) & unpromised).select(*block, "text_a", "text_b", "len_a", "len_b").distinct()


def candidates(texts: DataFrame, block: list[str], text: str, threshold: float) -> DataFrame:
    """Pairs of distinct texts of a block that may reach the ratio: ``text_a < text_b``."""
    distinct = texts.select(*block, text).filter(F.length(text) > 0).distinct()
    pairs = _bigram_pairs(distinct, block, text, threshold).unionByName(_letter_pairs(distinct, block, text, threshold))
    feasible = F.least("len_a", "len_b") * 2 >= (F.col("len_a") + F.col("len_b")) * threshold - 1e-9
    return pairs.filter(feasible).select(*block, "text_a", "text_b").distinct()


def similar_texts(texts: DataFrame, block: list[str], text: str, threshold: float, strict: bool = True) -> DataFrame:
    """Ordered pairs ``(text_a < text_b)`` of distinct texts of a block with ratio above ``threshold``."""
    pairs = candidates(texts, block, text, threshold).withColumn("ratio", seq_ratio("text_a", "text_b"))
    return pairs.filter(F.col("ratio") > threshold if strict else F.col("ratio") >= threshold)


def duplicate_patients(patients: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Greedy groups of patients with equal birth date and similar names.

    Patients are taken by name; one not yet in a group leads a group of all later
    ungrouped patients similar to it. Equal names of one birth date act as one
    node. Leaders are found in rounds: a node leads as soon as no earlier
    neighbour can lead. Returns ``(patient_id, leader_name, birth_date)``.
    """
    name = F.lower(F.concat_ws(" ", "first_name", "last_name"))
    order = F.lower(F.concat_ws("\u0001", "last_name", "first_name"))
    rows = patients.select("patient_id", "birth_date", name.alias("name"), order.alias("__order"))
    nodes = cut_lineage(rows.groupBy("birth_date", "name").agg(F.min("__order").alias("o"), F.count("*").alias("n")))
    pairs = similar_texts(nodes, ["birth_date"], "name", threshold)
    on = nodes.select("birth_date", "name", "o")
    edges = pairs.join(on.select("birth_date", F.col("name").alias("text_a"), F.col("o").alias("oa")), ["birth_date", "text_a"]).join(
        on.select("birth_date", F.col("name").alias("text_b"), F.col("o").alias("ob")), ["birth_date", "text_b"]
    )
    first = F.struct("oa", "text_a") < F.struct("ob", "text_b")
    edges = cut_lineage(edges.select(
        "birth_date", F.when(first, F.col("text_a")).otherwise(F.col("text_b")).alias("early"),
        F.when(first, F.col("text_b")).otherwise(F.col("text_a")).alias("late"), F.when(first, F.col("oa")).otherwise(F.col("ob")).alias("early_order"),
    ))
    state = nodes.select("birth_date", "name", F.lit("open").alias("state"))
    while True:
        seen = edges.join(state.select("birth_date", F.col("name").alias("early"), F.col("state").alias("s")), ["birth_date", "early"])
        around = seen.groupBy("birth_date", F.col("late").alias("name")).agg(
            F.bool_or(F.col("s") == "lead").alias("led"), F.bool_or(F.col("s") == "open").alias("waiting")
        )
        state = state.join(around, ["birth_date", "name"], "left").select(
            "birth_date", "name",
            F.when(F.col("state") != "open", F.col("state")).when(F.col("led"), "member")
            .when(F.coalesce(F.col("waiting"), F.lit(False)), "open").otherwise("lead").alias("state"),
        )
        state = cut_lineage(state)
        if state.filter("state = 'open'").isEmpty():
            break
    leaders = state.filter("state = 'lead'").select("birth_date", F.col("name").alias("early"))
    claimed = edges.join(leaders, ["birth_date", "early"], "left_semi").groupBy("birth_date", F.col("late").alias("name")).agg(
        F.min(F.struct("early_order", "early")).alias("l")
    )
    members = state.join(claimed, ["birth_date", "name"], "left").select(
        "birth_date", "name", F.when(F.col("state") == "lead", F.col("name")).otherwise(F.col("l.early")).alias("leader_name")
    )
    size = members.join(nodes, ["birth_date", "name"]).groupBy("birth_date", "leader_name").agg(F.sum("n").alias("size")).filter("size > 1")
    grouped = members.join(size, ["birth_date", "leader_name"])
    return rows.join(grouped, ["birth_date", "name"]).select("patient_id", "birth_date", "leader_name", "size")


def similar_codes(codes: DataFrame, code: str, k: int = 10, threshold: float = 0.8) -> DataFrame:
    """Most similar other codes of each code: 0.7 text ratio plus 0.3 shape ratio."""
    plain = F.lower(F.regexp_replace(F.col(code), r"[^\w]", ""))
    # few codes stand in many rows: the rows are read once
    table = cut_lineage(codes.select(F.col(code).alias("raw"), plain.alias("plain")).distinct())
    least = (threshold - 0.3) / 0.7
    pairs = similar_texts(table, [], "plain", least - 1e-9).drop("ratio")
    same = table.select(F.col("plain").alias("text_a"), F.col("plain").alias("text_b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b"))).unionByName(same)
    left = table.select(F.col("raw").alias("code"), F.col("plain").alias("text_a"))
    right = table.select(F.col("raw").alias("similar"), F.col("plain").alias("text_b"))
    out = both.join(left, "text_a").join(right, "text_b").filter("code <> similar")

    def shape(column):
        return F.regexp_replace(column, r"\w", "X")

    score = seq_ratio("text_a", "text_b") * 0.7 + F.when(shape(F.col("code")) == shape(F.col("similar")), 1.0).otherwise(
        seq_ratio(shape(F.col("code")), shape(F.col("similar")))
    ) * 0.3
    out = out.withColumn("score", score).filter(F.col("score") >= threshold - 1e-12).drop("text_a", "text_b")
    from chartmill.operators.ordered import top_rows

    return top_rows(out, ["code"], [F.desc("score"), F.col("similar")], k, "place")


# fixed values: example codes per system, and the mappings that are known
EXAMPLE_CODES = {
    "LOINC": ["8480-6", "8462-4", "2093-3", "33747-0"], "SNOMED": ["386661006", "44054006", "271649006", "162864005"],
    "ICD-10-CM": ["E11.9", "I10", "Z51.11", "F41.1"], "ICD-10": ["E11", "I10", "Z51", "F41"],
    "CPT": ["99213", "99214", "80053", "36415"], "RxNorm": ["161", "8640", "197361", "313782"],
    "UCUM": ["mg/dL", "mmol/L", "g/L", "IU/L"],
}
KNOWN_MAPPINGS = [
    ("2093-3", "LOINC", "CHOL", "LOCAL", 1.0, "exact"), ("E11.9", "ICD-10-CM", "44054006", "SNOMED", 0.95, "equivalent"),
]
MAPPING = "code string, system string, target_code string, target_system string, confidence double, kind string"


def equivalent_codes(codes: DataFrame, mappings: DataFrame | None = None, per_system: int = 3, threshold: float = 0.8) -> DataFrame:
    """Equivalents of ``(code, system)`` in other systems.

    ``mappings`` is a table as ``MAPPING``, the known ones by default. What it
    maps wins, systems in either case; other codes get the most similar example
    codes of each other system above ``threshold``, with confidence 0.7 of the
    similarity. The examples are a fixed list.
    """
    from chartmill.operators.ordered import top_rows

    def shape(column):
        return F.regexp_replace(column, r"\w", "X")

    def plain(column):
        return F.lower(F.regexp_replace(column, r"[^\w]", ""))

    if mappings is None:
        mappings = codes.sparkSession.createDataFrame(KNOWN_MAPPINGS, MAPPING)
    known = mappings.select("code", F.upper("system").alias("__system"), "target_code", "target_system", "confidence", "kind")
    distinct = codes.select("code", "system").distinct().withColumn("__system", F.upper("system"))
    exact = distinct.join(known, ["code", "__system"]).select("code", "system", "target_code", "target_system", "confidence", "kind")
    rest = distinct.join(known.select("code", "__system").distinct(), ["code", "__system"], "left_anti")
    examples = F.array(*[F.struct(F.lit(c).alias("target_code"), F.lit(s).alias("target_system")) for s, cs in EXAMPLE_CODES.items() for c in cs])
    offers = rest.select("code", "system", F.inline(examples)).filter(F.upper("target_system") != F.upper("system"))
    ratio = seq_ratio(plain(F.col("code")), plain(F.col("target_code"))) * 0.7
    same = F.when(shape(F.col("code")) == shape(F.col("target_code")), 1.0).otherwise(seq_ratio(shape(F.col("code")), shape(F.col("target_code"))))
    scored = offers.withColumn("score", ratio + same * 0.3).filter(F.col("score") > threshold)
    best = top_rows(scored, ["code", "system", "target_system"], [F.desc("score"), F.col("target_code")], per_system, "place")
    fuzzy = best.select("code", "system", "target_code", "target_system", (F.col("score") * 0.7).alias("confidence"), F.lit("related").alias("kind"))
    return exact.unionByName(fuzzy)
