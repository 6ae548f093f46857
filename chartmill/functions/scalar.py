"""Column functions: normalisation, classification and small text parsers.

All of them are built from JVM-side expressions, so they stay inside
whole-stage code generation and never move rows to Python.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.functions import fixed

EARLIEST = "1900-01-01"


# ---------------------------------------------------------------- building blocks
def any_of(column: Column, words) -> Column:
    """True where the column contains any of the words."""
    return reduce(lambda a, b: a | b, [column.contains(w) for w in words])


def words_regex(words) -> str:
    """Pattern of plain containment: one test per rule keeps generated code small."""
    return "|".join(re.sub(r"([.+?()*\[\]])", r"\\\1", w) for w in words)


def cascade(column: Column, rules, default=None, result=lambda v: F.lit(v)) -> Column:
    """First rule with a contained word wins; meant for short texts such as labels."""
    out = F
    for value, words in rules:
        out = out.when(column.rlike(words_regex(words)), result(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(column: Column, table: dict, default=None) -> Column:
    """Constant dictionary as a CASE expression: no join for a handful of entries."""
    out = F
    for key, value in table.items():
        out = out.when(column == F.lit(key), F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def word_pattern(words) -> str:
    """One pattern that finds any of the words on word boundaries, plural s allowed."""
    return r"\b(" + "|".join(re.escape(w.lower()).replace(r"\ ", " ").replace(r"\-", "-") for w in words) + r")s?\b"


def has_word(column: Column, words) -> Column:
    return F.coalesce(F.lower(column).rlike(word_pattern(words)), F.lit(False))


def blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def found(column: Column, pattern: str, group: int = 0) -> Column:
    """Matched text of a pattern, null without a match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def squeeze(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def half_up(column: Column, digits: int) -> Column:
    """Decimal half-up rounding of a double, returned as double."""
    return F.round(column.cast("decimal(28,8)"), digits).cast("double")


def issues(*rules: tuple[Column, str]) -> Column:
    """Array with the message of each rule that holds."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))


# ---------------------------------------------------------------- dates
def _two_digit_year(parsed: Column) -> Column:
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def normalize_date(column: Column) -> Column:
    """ISO date text of the first format that fits, month first before day first."""
    text = F.trim(column)
    tries = []
    for fmt in fixed.DATE_FORMATS:
        parsed = F.try_to_date(text, fmt)
        tries.append(_two_digit_year(parsed) if fmt.endswith("/yy") else parsed)
    return F.coalesce(*tries).cast("string")


def pad_partial_date(column: Column) -> Column:
    """First day of a year or year-month; a full ISO date stays; other text is null."""
    text = F.substring_index(F.trim(column), "T", 1)
    full = (
        F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    )
    return F.when(F.try_to_date(full, "yyyy-MM-dd").isNotNull(), full)


def date_parts(column: Column) -> Column:
    """Array of year, month, day as far as they are given."""
    return F.filter(F.split(F.trim(F.substring_index(F.trim(column), "T", 1)), "-"), lambda p: p != "")


def dates_agree(a: Column, b: Column) -> Column:
    """Equality at the coarser precision of two partial dates."""
    pa, pb = date_parts(a), date_parts(b)
    shared = F.least(F.size(pa), F.size(pb))
    return F.coalesce((shared > 0) & (F.slice(pa, 1, F.greatest(shared, F.lit(1))) == F.slice(pb, 1, F.greatest(shared, F.lit(1)))), F.lit(False))


def parse_timestamp(column: Column) -> Column:
    """Clinical timestamp text with or without zone, fraction, time, day or month."""
    text = F.replace(F.substring_index(column, "+", 1), F.lit("Z"), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"), text)),
        F.try_to_timestamp(pad_partial_date(F.when(~text.contains("T"), text)), F.lit("yyyy-MM-dd")),
    )


ISO_8601 = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2})?)?$"


def is_iso_8601(column: Column) -> Column:
    return column.rlike(ISO_8601)


def clinical_date(column: Column, today: Column) -> Column:
    """One date string to a date between 1900 and a year from ``today``."""
    text = F.trim(column)
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T\s].*)?$", 1)
    slash = F.regexp_extract(text, r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b", 1)
    short = F.regexp_extract(text, r"\b(\d{1,2}/\d{1,2}/\d{2})\b", 1)
    inner = F.regexp_extract(text, r"\b(\d{4}-\d{1,2}-\d{1,2})\b", 1)
    month = F.regexp_extract(text, r"(?i)\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b", 1)
    month = F.regexp_replace(F.initcap(F.regexp_replace(month, r"[.,]", "")), r"^([A-Z][a-z]{2})[a-z]*", "$1")

    def read(possible: Column, found: Column, pattern: str) -> Column:
        # a match or parse that fails costs far more than a look at the length
        return F.try_to_date(F.when(possible, found), pattern)

    n = F.length(text)
    two = read((n >= 6) & text.contains("/"), short, "M/d/yy")
    best = F.coalesce(
        read((n >= 10) & (F.substring(text, 5, 1) == "-"), iso, "yyyy-MM-dd"), read((n >= 8) & text.contains("-"), inner, "yyyy-M-d"),
        read(n >= 8, F.translate(slash, "-", "/"), "M/d/yyyy"), read(n >= 10, squeeze(month), "MMM d yyyy"),
        F.when(F.year(two) >= 2050, F.add_months(two, -1200)).otherwise(two),
    )
    return F.when(best.between(F.lit(EARLIEST).cast("date"), F.add_months(today, 12)), best)


def age_at(birth: Column, today: Column) -> Column:
    return (
        F.year(today) - F.year(birth)
        - F.when(F.struct(F.month(today), F.day(today)) < F.struct(F.month(birth), F.day(birth)), 1).otherwise(0)
    )


# ---------------------------------------------------------------- names and plain text
def title_case(column: Column) -> Column:
    """Every run of letters starts with a capital, also after apostrophe or hyphen."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))), ""
    )


def normalize_name(column: Column) -> Column:
    def part(p):
        low = F.lower(p)
        dotted = F.when(p.endswith("."), p).otherwise(F.concat(p, F.lit(".")))
        prefix = F.concat(F.upper(F.substring(low, 1, 1)), low.substr(F.lit(2), F.length(low)))
        return (
            F.when(low.isin(fixed.NAME_PREFIXES), F.when(p.endswith("."), prefix).otherwise(F.concat(prefix, F.lit("."))))
            .when(low.isin("jr", "sr"), F.concat(F.upper(p), F.lit(".")))
            .when(low.isin(fixed.NAME_SUFFIXES), F.upper(p))
            .otherwise(p)
        )

    return blank_to_null(F.array_join(F.transform(F.split(title_case(squeeze(column)), " "), part), " "))


def comparison_name(column: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(F.trim(column)), r"\b(mr|mrs|ms|dr|md|jr|sr|ii|iii)\b\.?", ""))


def comparison_phone(column: Column) -> Column:
    digits = F.regexp_replace(column, r"[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), digits.substr(2, 10)).otherwise(digits)


def comparison_date(column: Column) -> Column:
    parsed = F.coalesce(
        F.try_to_date(column, "M/d/yyyy"), F.try_to_date(column, "M-d-yyyy"), F.try_to_date(column, "yyyy-M-d")
    )
    return F.coalesce(F.date_format(parsed, "MMddyyyy"), F.regexp_replace(column, r"[/\-.]", ""))


def comparison_form(column: Column, label: Column) -> Column:
    """Form in which two values of a field are compared."""
    text, low = F.lower(F.trim(column)), F.lower(label)
    return F.coalesce(
        F.when(any_of(low, ["date", "dob", "birth"]), comparison_date(text))
        .when(low.contains("phone"), comparison_phone(text))
        .when(low.contains("name"), comparison_name(text))
        .otherwise(F.regexp_replace(text, r"\s+", " ")),
        F.lit(""),
    )


def strip_diagnosis(column: Column) -> Column:
    text = F.regexp_replace(F.trim(column), r"^\d+[.)]\s*", "")
    return squeeze(F.regexp_replace(text, r"\s*\([^)]*\)\s*", " "))


def normalize_diagnosis(column: Column) -> Column:
    return strip_diagnosis(F.lower(column))


def normalize_drug(column: Column) -> Column:
    text = F.lower(F.trim(column))
    text = F.regexp_replace(text, r"\b(tablet|capsule|inhaler|injection|solution|cream|ointment|gel)\b", "")
    text = F.regexp_replace(text, r"\b(oral|topical|intravenous|subcutaneous|intramuscular)\b", "")
    text = F.regexp_replace(text, r"\d+\s*(mg|mcg|g|ml|units?|puffs?|iu)\b", "")
    return F.coalesce(squeeze(text), F.lit(""))


def drug_key(column: Column) -> Column:
    """Lower-cased, space-collapsed drug name."""
    return squeeze(F.lower(column))


def short_drug_name(column: Column) -> Column:
    """First two words once amounts, frequencies and times of day are gone."""
    text = F.lower(F.trim(column))
    text = F.regexp_replace(text, r"\d+\s*(mg|ml|mcg|units?|iu|tablets?|capsules?|pills?)", "")
    text = F.regexp_replace(text, r"\b(daily|twice|bid|tid|qid|prn|as needed)\b", "")
    text = F.regexp_replace(text, r"\b(morning|evening|bedtime|with meals?)\b", "")
    return F.substring_index(squeeze(text), " ", 2)


def normalize_field_value(value: Column, label: Column) -> Column:
    low, text = F.lower(label), F.trim(value)
    return (
        F.when(any_of(low, ["date", "dob", "birth"]), F.regexp_replace(text, r"(?i)^(born|dob|date of birth):\s*", ""))
        .when(
            any_of(low, ["medication", "drug"]),
            F.regexp_replace(F.regexp_replace(text, r"(?i)\bmg\b", "mg"), r"(?i)\bml\b", "mL"),
        )
        .when(any_of(low, ["diagnosis", "condition"]), strip_diagnosis(text))
        .otherwise(text)
    )


# ---------------------------------------------------------------- codes
def _code_chars(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"[^\w.\-]", ""))


def medical_code(column: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(column)), r"[^\w.\-]", "")


def code_system_by_shape(code: Column) -> Column:
    return (
        F.when(code.rlike(r"^\d{1,5}-\d$"), "LOINC")
        .when(code.rlike(r"^[A-Z]\d{2}(\.\d{1,2})?$"), "ICD-10")
        .when(code.rlike(r"^\d{6,}$"), "SNOMED")
        .otherwise("UNKNOWN")
    )


def detect_code_system(column: Column, context: Column) -> Column:
    """struct(system, confidence): best pattern match, registry order on ties."""
    code, ctx = _code_chars(column), F.lower(context)
    specific = {
        "LOINC": code.contains("-"), "ICD-10-CM": code.contains("."), "SNOMED": F.length(code) >= 8,
    }
    options = []
    for rank, (name, (_, pattern)) in enumerate(fixed.CODE_SYSTEMS.items()):
        score = F.lit(80)
        score = score + F.when(any_of(ctx, fixed.CODE_CONTEXT_WORDS[name]), 15).otherwise(0)
        if name in specific:
            score = score + F.when(specific[name], 10).otherwise(0)
        options.append(
            F.when(code.rlike(pattern), F.struct(F.least(score, F.lit(100)).alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("system")))
        )
    best = F.array_max(F.array_compact(F.array(*options)))
    return F.struct(
        F.coalesce(best["system"], F.lit("UNKNOWN")).alias("system"),
        F.coalesce(best["score"] / 100, F.lit(0.0)).alias("confidence"),
    )


def _known_system(system: Column, strict_reference: bool = False) -> Column:
    names = {n.upper(): n for n in fixed.CODE_SYSTEMS if not (strict_reference and n != n.upper())}
    return lookup(F.upper(system), names)


def code_system_uri(system: Column, strict_reference: bool = False) -> Column:
    uris = {n: u for n, (u, _) in fixed.CODE_SYSTEMS.items()}
    return lookup(_known_system(system, strict_reference), uris, fixed.UNKNOWN_SYSTEM_URI)


def code_format_valid(code: Column, system: Column, strict_reference: bool = False) -> Column:
    known = _known_system(system, strict_reference)
    out = F
    for name, (_, pattern) in fixed.CODE_SYSTEMS.items():
        out = out.when(known == name, code.rlike(pattern))
    return out.otherwise(False)


def clean_code(column: Column) -> Column:
    text = F.trim(column)
    return F.when(text.rlike(r"^[A-Za-z]\d{2}"), F.upper(text)).otherwise(text)


def normalize_codes(df: DataFrame, code: str, stated: str, context: str, strict_reference: bool = False) -> DataFrame:
    """Add ``code``, ``system``, ``uri``, ``confidence`` of a code with or without stated system.

    The steps are separate projections so that the detection is evaluated once.
    ``strict_reference`` resolves only system names written in capitals.
    """
    df = df.withColumns({"code": clean_code(F.col(code)), "__stated": F.col(stated)})
    df = df.withColumn(
        "__found",
        F.when(F.col("__stated").isNull(), detect_code_system(F.col("code"), F.col(context))).otherwise(
            F.struct(F.col("__stated").alias("system"), F.lit(1.0).alias("confidence"))
        ),
    )
    system, confidence = F.col("__found.system"), F.col("__found.confidence")
    df = df.withColumn("__known", _known_system(system, strict_reference))
    valid = F
    for name, (_, pattern) in fixed.CODE_SYSTEMS.items():
        valid = valid.when(F.col("__known") == name, F.col("code").rlike(pattern))
    uris = {n: u for n, (u, _) in fixed.CODE_SYSTEMS.items()}
    return df.withColumns(
        {
            "system": F.when(F.col("__known").isNull(), F.lit("UNKNOWN")).otherwise(system),
            "uri": lookup(F.col("__known"), uris, fixed.UNKNOWN_SYSTEM_URI),
            "confidence": F.when(F.col("__known").isNull(), 0.0).when(valid, confidence).otherwise(confidence * 0.5),
        }
    ).drop("__stated", "__found", "__known")


# ---------------------------------------------------------------- numbers and measures
def parse_number(column: Column) -> Column:
    """Number in a text without letters; null when letters are present."""
    text = F.trim(column)
    digits = F.regexp_replace(text, r"[^\d.\-]", "")
    return F.when(~text.rlike("[a-zA-Z]"), digits).try_cast("double")


def to_metric(value: Column, unit: Column, kind: Column) -> Column:
    low, weight, height = F.lower(unit), F, F
    for name, factor in fixed.KG_PER.items():
        weight = weight.when(low == name, value * factor)
    for name, factor in fixed.M_PER.items():
        height = height.when(low == name, value * factor)
    weight = weight.when(low.isin("g", "grams"), value / 1000)
    height = height.when(low.isin("cm", "centimeters"), value / 100)
    return F.when(kind == "weight", weight).when(kind == "height", height)


def bmi(weight_kg: Column, height_m: Column) -> Column:
    return F.when((weight_kg > 0) & (height_m > 0), half_up(weight_kg / (height_m * height_m), 1))


def bmi_category(value: Column) -> Column:
    out = F.when(value < 0, "invalid")
    for name, upper, _ in fixed.BMI_BANDS:
        out = out.when(value < upper, name)
    return out.when(value.isNotNull(), fixed.BMI_TOP[0]).otherwise("invalid")


def bmi_display(category: Column) -> Column:
    names = {n: d for n, _, d in fixed.BMI_BANDS}
    names[fixed.BMI_TOP[0]] = fixed.BMI_TOP[1]
    names["invalid"] = "Invalid BMI"
    return lookup(category, names, "Unknown")


def percent_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise(half_up((new - old) / old * 100, 1))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, 0 for an empty whole."""
    return F.when(whole == 0, 0.0).otherwise(half_up(part * 100 / whole, digits))


# ---------------------------------------------------------------- observations
def interpretation_flag(column: Column) -> Column:
    """H, L, A or empty. The text 'abnormal' contains 'normal' and yields empty."""
    text = F.lower(F.trim(column))
    first = F.substring_index(text, " ", 1)
    return F.coalesce(
        F.when(text.contains("high") | first.isin("h", "hh", "hu"), "H")
        .when(text.contains("low") | first.isin("l", "ll", "lu"), "L")
        .when(text.contains("normal") | first.isin("n", "norm"), "")
        .when(text.contains("abnormal") | first.isin("a", "aa", "ab"), "A")
        .otherwise(""),
        F.lit(""),
    )


def range_text(low: Column, high: Column, unit: Column) -> Column:
    u = F.coalesce(unit, F.lit(""))
    return F.trim(
        F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" "), u))
        .when(low.isNotNull(), F.concat(F.lit(">"), low.cast("string"), F.lit(" "), u))
        .when(high.isNotNull(), F.concat(F.lit("<"), high.cast("string"), F.lit(" "), u))
    )


def abnormal_result(code: Column, value: Column, low: Column, high: Column) -> Column:
    """Stated interpretation, else position to the range; 20 % beyond it is critical."""
    return F.coalesce(
        F.when(code.isin("N", "normal"), "normal")
        .when(code.isin("L", "low"), "low")
        .when(code.isin("H", "high"), "high")
        .when(code.isin("LL", "HH", "AA", "critical"), "critical"),
        F.when(value < low, F.when(value < low * 0.8, "critical").otherwise("low")).when(
            value > high, F.when(value > high * 1.2, "critical").otherwise("high")
        ),
        F.lit("normal"),
    )


def lab_category(loinc: Column) -> Column:
    return F.coalesce(lookup(loinc, fixed.LOINC_CATEGORY), F.lit("Other"))


def therapeutic_class(column: Column) -> Column:
    name = normalize_drug(column)
    out = F
    for drug, label in fixed.CLASS_OF_DRUG:
        out = out.when(name.contains(drug), label)
    return out.otherwise("Other")


def observation_category(code: Column, text: Column) -> Column:
    return F.coalesce(
        lookup(F.lower(F.trim(code)), fixed.OBSERVATION_CODES),
        F.when(has_word(text, fixed.SOCIAL_WORDS), "social_history")
        .when(has_word(text, fixed.VITAL_WORDS), "vital_signs")
        .when(has_word(text, fixed.EXAM_WORDS), "exam")
        .otherwise("laboratory"),
    )


# ---------------------------------------------------------------- encounters
def timeline_kind(enc_class: Column) -> Column:
    return lookup(enc_class, fixed.TIMELINE_KIND_OF_CLASS, "encounter")


def class_display(enc_class: Column) -> Column:
    return lookup(enc_class, fixed.CLASS_DISPLAY, "Encounter")


def encounter_kind(enc_class: Column, text: Column) -> Column:
    by_word = F
    for kind, words in fixed.ENCOUNTER_KIND_WORDS:
        by_word = by_word.when(has_word(text, words), kind)
    return F.coalesce(lookup(F.upper(F.trim(enc_class)), fixed.ENCOUNTER_CODE_KIND), by_word.otherwise("ambulatory"))


# ---------------------------------------------------------------- extracted fields
def field_class(label: Column) -> Column:
    return cascade(F.lower(label), fixed.FIELD_CLASSES, "other")


def demographic_label(label: Column) -> Column:
    return cascade(F.lower(label), fixed.DEMOGRAPHIC_LABELS, F.lower(label))


def date_kind(label: Column) -> Column:
    return cascade(F.lower(label), fixed.DATE_KINDS, "general_date")


def lab_test_name(label: Column, value: Column) -> Column:
    same = [(w, [w]) for w in fixed.LAB_INDICATORS]
    return F.coalesce(cascade(F.lower(label), same), cascade(F.lower(value), same), F.lower(label))


def field_importance(label: Column) -> Column:
    return cascade(F.lower(label), fixed.FIELD_IMPORTANCE, 10)


def label_category(label: Column) -> Column:
    low, out = F.lower(label), F
    for prefix, category in fixed.LABEL_PREFIX_CATEGORY:
        out = out.when(low.startswith(prefix), category)
    return out.otherwise("other_fields")


def comparison_category(label: Column) -> Column:
    return cascade(F.lower(label), fixed.COMPARISON_CATEGORIES, "other")


def resource_of_field(name: Column) -> Column:
    return lookup(name, {k: v[0] for k, v in fixed.FIELD_RESOURCE.items()}, "Unknown")


def resource_path_of_field(name: Column) -> Column:
    return lookup(name, {k: v[1] for k, v in fixed.FIELD_RESOURCE.items()}, name)


def service_category(text: Column) -> Column:
    return cascade(F.lower(text), [(v[1], w) for v, w in fixed.SERVICE_CATEGORIES], fixed.SERVICE_CATEGORY_DEFAULT[1])


def report_category(text: Column) -> Column:
    return cascade(F.lower(text), [(v[0], w) for v, w in fixed.REPORT_CATEGORIES], fixed.REPORT_CATEGORY_DEFAULT[0])


def is_diagnostic(text: Column) -> Column:
    return any_of(F.lower(text), fixed.DIAGNOSTIC_WORDS)


def calibrated_confidence(label: Column, value: Column, confidence: Column) -> Column:
    low, text = F.lower(label), F.trim(F.coalesce(value, F.lit("")))
    up = F.least(confidence * 1.1, F.lit(1.0))
    name, record = low.contains("name"), low.contains("mrn") | low.contains("record")
    date = any_of(low, ["date", "dob", "birth"])
    return (
        F.when(text == "", 0.0)
        .when(name & (F.length(text) < 2), F.least(confidence, F.lit(0.3)))
        .when(name & (F.size(F.split(squeeze(text), " ")) >= 2), up)
        .when(date & text.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), up)
        .when(date & text.rlike(r"\d"), confidence)
        .when(date, F.least(confidence, F.lit(0.4)))
        .when(record & text.rlike(r"\d{3,}"), up)
        .when(record, F.least(confidence, F.lit(0.5)))
        .when(any_of(low, ["medication", "drug"]) & text.rlike(r"(?i)\d+\s*(mg|mL|units)"), F.least(confidence * 1.05, F.lit(1.0)))
        .otherwise(confidence)
    )


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium")
        .when(confidence >= 0.3, "low").otherwise("very_low")
    )


# ---------------------------------------------------------------- operations
def call_cost(provider: Column, model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Exact price of one call; per page for text recognition; 0 for an unknown model."""
    p, m = F.lower(provider), F.lower(model)
    rate_in, rate_out = F.when((p == "aws_textract") & (input_tokens <= 0), None), F

    def rate(price, per=1):
        return F.lit(str(Decimal(price) / per)).cast("decimal(12,9)")

    for mode, price in fixed.PAGE_PRICES.items():
        rate_in = rate_in.when((p == "aws_textract") & (m == mode), rate(price))
    for (prov, name), (price_in, price_out) in fixed.TOKEN_PRICES.items():
        known = (p == prov) & (m == name)
        rate_in, rate_out = rate_in.when(known, rate(price_in, 1000)), rate_out.when(known, rate(price_out, 1000))
    zero = F.lit(0).cast("decimal(12,9)")
    return (
        F.coalesce(rate_in, zero) * input_tokens.cast("decimal(12,0)")
        + F.coalesce(rate_out, zero) * output_tokens.cast("decimal(12,0)")
    ).cast("decimal(20,9)")


def error_category(message: Column, error_type: Column) -> Column:
    return F.coalesce(
        lookup(error_type, fixed.ERROR_TYPE_CATEGORY),
        cascade(F.lower(message), fixed.ERROR_MESSAGE_CATEGORY, "permanent"),
    )


def error_code(error_type: Column) -> Column:
    return lookup(error_type, fixed.ERROR_CODE_OF_TYPE, "UNKNOWN_ERROR")


def recovery_strategy(code: Column) -> Column:
    return lookup(code, fixed.RECOVERY_OF_CODE, "manual_intervention")


def error_severity(error_type: Column) -> Column:
    return lookup(error_type, fixed.ERROR_SEVERITY, "error")


def stage_key(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == "completed", "done").when(status == "failed", "failed")
        .when(status == "pending", "queued").when(status == "ocr_pending", "pdf_ocr")
        .when(any_of(low, ["fhir", "converting"]), "fhir_converting")
        .when(any_of(low, ["analyzing", " ai"]) | low.startswith("ai"), "ai_processing")
        .when(any_of(low, ["extract", "pdf", "ocr"]), "pdf_ocr")
        .when(status == "processing", "ai_processing")
        .otherwise("processing")
    )


def live_stage(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status == "pending", "Queued").when(status == "ocr_pending", "OCR Pending")
        .when(any_of(low, ["fhir", "converting"]), "FHIR Converting")
        .when(any_of(low, ["analyzing", "ai"]), "AI Processing")
        .when(any_of(low, ["extract", "pdf"]), "PDF Extracting")
        .when(status == "processing", "Processing")
        .otherwise(F.initcap(F.replace(status, F.lit("_"), F.lit(" "))))
    )


def access_event(path: Column, method: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.contains("login"), "login").when(low.contains("logout"), "logout")
        .when(
            any_of(low, fixed.PHI_EVENT_PATHS),
            F.when(method == "POST", "phi_create").when(method.isin("PUT", "PATCH"), "phi_update")
            .when(method == "DELETE", "phi_delete").otherwise("phi_access"),
        )
        .when(low.contains("/admin/"), "admin_access")
        .otherwise("system_access")
    )


def is_phi_path(path: Column) -> Column:
    return any_of(path, fixed.PHI_PATHS)


def is_sensitive_path(path: Column) -> Column:
    return any_of(path, fixed.SENSITIVE_PATHS)


# ---------------------------------------------------------------- small parsers
def first_match(column: Column, patterns, group: int = 0) -> Column:
    return F.coalesce(*[found(column, p, group) for p in patterns])


def parse_medication(column: Column) -> Column:
    """struct(name, dosage, route, schedule) of one medication sentence."""
    text = F.trim(column)
    low = F.lower(text)
    every = fixed.MED_DOSAGE + fixed.MED_ROUTE + fixed.MED_SCHEDULE
    # the first match of any pattern starts where the earliest of them does
    start = F.nullif(F.regexp_instr(low, F.lit("|".join(f"(?:{p})" for p in every))), F.lit(0))
    head = squeeze(F.when(start.isNotNull(), text.substr(F.lit(1), start - 1)).otherwise(text))
    name = F.regexp_replace(head, r"^[,\-\s]+|[,\-\s]+$", "")
    return F.struct(
        F.when(name == "", text).otherwise(name).alias("name"),
        first_match(low, fixed.MED_DOSAGE).alias("dosage"),
        first_match(low, fixed.MED_ROUTE, 1).alias("route"),
        first_match(low, fixed.MED_SCHEDULE).alias("schedule"),
    )


def split_medications(column: Column) -> Column:
    """Items of a medication list separated by semicolon or comma."""
    return F.filter(F.transform(F.split(column, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def parse_dosage(column: Column) -> Column:
    """struct(amount, frequency, route) of a dosage text."""
    text = F.lower(F.trim(column))
    frequency = []
    for pattern, shape in fixed.DOSE_FREQUENCY:
        parts = [
            F.regexp_extract(text, pattern, int(piece)) if piece.isdigit() else F.lit(piece)
            for piece in re.split(r"\{(\d)\}", shape) if piece
        ]
        frequency.append(F.when(text.rlike(pattern), F.concat(*parts)))
    return F.struct(
        found(text, fixed.DOSE_AMOUNT, 1).alias("amount"),
        F.coalesce(*frequency).alias("frequency"),
        cascade(text, [(r, [r]) for r in fixed.DOSE_ROUTES]).alias("route"),
    )


def parse_provider_name(column: Column, strict_reference: bool = False) -> Column:
    """struct(family, given): 'Last, First' or last word; whole-word titles removed.

    ``strict_reference`` also strips titles and credentials inside longer words.
    """
    name, edge = column, "" if strict_reference else r"(?![\p{L}])"
    lead = "" if strict_reference else r"(?<![\p{L}.])"
    for title in fixed.PROVIDER_TITLES:
        name = F.regexp_replace(name, rf"(?i)\b{re.escape(title)}{edge}\s*", "")
    for credential in fixed.PROVIDER_CREDENTIALS:
        name = F.regexp_replace(name, rf"(?i),?\s*{lead}{re.escape(credential)}\s*$", "")
    name = F.trim(F.regexp_replace(F.trim(name), r"^,+|,+$", ""))
    comma = name.contains(",")
    words = F.split(squeeze(name), " ")
    return F.struct(
        F.when(comma, F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(words, -1)).alias("family"),
        F.when(comma, squeeze(F.regexp_replace(name, r"^[^,]*,", "")))
        .otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        .alias("given"),
    )


def is_vaccine(name: Column, claimed: Column | None = None) -> Column:
    """Vaccine word, or one of the claimed names (3 characters or more) in the text."""
    hit = has_word(name, fixed.VACCINE_WORDS)
    if claimed is not None:
        low = F.lower(F.trim(name))
        hit = hit | F.coalesce(
            F.exists(
                F.filter(F.transform(claimed, lambda c: F.lower(F.trim(c))), lambda c: F.length(c) >= 3),
                lambda c: F.regexp_like(low, F.concat(F.lit(r"\b\Q"), c, F.lit(r"\Es?\b"))),
            ),
            F.lit(False),
        )
    return hit & (F.trim(F.coalesce(name, F.lit(""))) != "")


def cvx_code(name: Column, provided: Column) -> Column:
    """Given code, else MMR for a measles combination, else the first known word."""
    out = F.when(F.trim(provided) != "", F.trim(provided))
    out = out.when(has_word(name, ["measles"]) & has_word(name, ["mumps", "rubella"]), "03")
    for word, code, _ in fixed.CVX_BY_WORD:
        out = out.when(has_word(name, [word]), code)
    return out


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for equal, 0 when one side is empty."""
    return (
        F.when(a.eqNullSafe(b), 1.0)
        .when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0)
        .otherwise(1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))
    )
