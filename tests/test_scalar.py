"""Edge rows of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from chartmill.functions import scalar as S

TODAY = "2024-06-15"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,iso", [
    ("2024-02-30", None), ("2023-12-25", "2023-12-25"), ("1/5/2024", "2024-01-05"), ("25/12/2023", "2023-12-25"),
    ("December 25, 2023", "2023-12-25"), ("12/25/23", "2023-12-25"), ("03/04/70", "1970-03-04"), ("", None), ("soon", None), (None, None),
])
def test_normalize_date(spark, text, iso):
    assert value(spark, S.normalize_date(F.lit(text).cast("string"))) == iso


@pytest.mark.parametrize("text,padded", [("2024", "2024-01-01"), ("2024-10", "2024-10-01"), ("2024-10-05T10:00:00", "2024-10-05"), ("2024-13", None), ("x", None)])
def test_pad_partial_date(spark, text, padded):
    assert value(spark, S.pad_partial_date(F.lit(text))) == padded


@pytest.mark.parametrize("a,b,same", [("2024", "2024-10-05", True), ("2024-10", "2024-11-01", False), ("2024-10-05T08:00", "2024-10-05", True), ("", "2024", False), (None, "2024", False)])
def test_dates_agree(spark, a, b, same):
    assert value(spark, S.dates_agree(F.lit(a).cast("string"), F.lit(b))) is same


@pytest.mark.parametrize("text,day", [("seen 01/02/49", "2049-01-02"), ("born 01/02/50", "1950-01-02"), ("1899-12-31", None), ("2025-06-15", "2025-06-15"), ("2025-06-16", None), ("March 3, 2024", "2024-03-03")])
def test_clinical_date_pivot_and_range(spark, text, day):
    today = F.lit("2049-12-31" if "49" in text else TODAY).cast("date")
    got = value(spark, S.clinical_date(F.lit(text), today))
    assert got == (datetime.date.fromisoformat(day) if day else None)


@pytest.mark.parametrize("name,expected", [("  o'neil-smith   jr ", "O'Neil-Smith JR."), ("dr jane doe iii", "Dr. Jane Doe III"), ("MÜLLER, é", "Müller, É"), (" ", None)])
def test_normalize_name(spark, name, expected):
    assert value(spark, S.normalize_name(F.lit(name))) == expected


@pytest.mark.parametrize("text,flag", [("Abnormal", ""), ("A", "A"), ("high risk", "H"), ("LL", "L"), ("N", ""), (None, "")])
def test_interpretation_flag(spark, text, flag):
    assert value(spark, S.interpretation_flag(F.lit(text).cast("string"))) == flag


@pytest.mark.parametrize("v,expected", [(8.0, "low"), (7.9, "critical"), (12.0, "high"), (12.1, "critical"), (10.0, "normal")])
def test_abnormal_bounds(spark, v, expected):
    low, high = (10.0, None) if v < 10 else (None, 10.0) if v > 10 else (10.0, 10.0)
    got = value(spark, S.abnormal_result(F.lit(None).cast("string"), F.lit(v), F.lit(low).cast("double"), F.lit(high).cast("double")))
    assert got == expected


@pytest.mark.parametrize("text,word,hit", [("fasting", "ast", False), ("cobalt", "alt", False), ("Triglycerides", "triglyceride", True), ("AST, ALT", "ast", True)])
def test_whole_words(spark, text, word, hit):
    assert value(spark, S.has_word(F.lit(text), [word])) is hit


@pytest.mark.parametrize("code,context,system,confidence", [
    ("8480-6", "lab", "LOINC", 1.0), ("E11.9", "diagnosis", "ICD-10-CM", 1.0), ("E11", "", "ICD-10-CM", 0.8), ("99213", "", "CPT", 0.8), ("99213", "drug", "RxNorm", 0.95), ("44054006", "", "SNOMED", 0.9), ("", "", "UNKNOWN", 0.0),
])
def test_detect_code_system(spark, code, context, system, confidence):
    got = value(spark, S.detect_code_system(F.lit(code), F.lit(context)))
    assert (got["system"], round(got["confidence"], 2)) == (system, confidence)


def test_strict_reference_does_not_know_mixed_case_systems(spark):
    df = spark.createDataFrame([("161", "RxNorm", "")], "raw string, stated string, ctx string")
    loose = S.normalize_codes(df, "raw", "stated", "ctx").first()
    strict = S.normalize_codes(df, "raw", "stated", "ctx", strict_reference=True).first()
    assert (loose["system"], loose["confidence"]) == ("RxNorm", 1.0)
    assert (strict["system"], strict["confidence"], strict["uri"]) == ("UNKNOWN", 0.0, "http://unknown.org")


def test_provider_names(spark):
    def parts(name, strict=False):
        got = value(spark, S.parse_provider_name(F.lit(name), strict))
        return got["family"], got["given"]

    assert parts("Dr. Drew Salgado, MD") == ("Salgado", "Drew")
    assert parts("Smith, John Q") == ("Smith", "John Q")
    assert parts("Alan Salgado", strict=True) == ("Salga", "Alan")  # "do" is cut as a credential
    assert parts("Dumas") == ("Dumas", "")


def test_bmi_bands_are_half_open(spark):
    for bmi, name in [(18.4, "underweight"), (18.5, "normal"), (25.0, "overweight"), (30.0, "obese_class_1"), (40.0, "obese_class_3")]:
        assert value(spark, S.bmi_category(F.lit(bmi))) == name
    assert value(spark, S.bmi(F.lit(70.0), F.lit(0.0))) is None


def test_call_cost(spark):
    def cost(provider, model, i, o):
        return float(value(spark, S.call_cost(F.lit(provider), F.lit(model), F.lit(i), F.lit(o))))

    assert cost("OpenAI", "GPT-4", 1000, 1000) == pytest.approx(0.09)
    assert cost("aws_textract", "analyze", 3, 0) == pytest.approx(0.045)
    assert cost("aws_textract", "analyze", 0, 0) == 0 and cost("openai", "unknown", 5, 5) == 0


def test_vaccines(spark):
    assert value(spark, S.is_vaccine(F.lit("gastric reflux"))) is False
    assert value(spark, S.cvx_code(F.lit("Measles, Mumps"), F.lit(None).cast("string"))) == "03"
    assert value(spark, S.cvx_code(F.lit("tdap"), F.lit(None).cast("string"))) == "115"


def test_percent_of_nothing(spark):
    assert value(spark, S.percent(F.lit(0), F.lit(0))) == 0.0
    assert value(spark, S.percent_change(F.lit(0.0), F.lit(5.0))) == 0.0
