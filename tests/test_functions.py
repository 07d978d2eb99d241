"""Golden edge rows for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starlens.functions import text as tx
from starlens.functions.dates import parse_ts, tenure_years, weekday, engagement_ratio, reviews_per_year
from starlens.functions.hours import parse_hours, total_hours


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_tokenize_whitespace(spark):
    assert one(spark, tx.tokenize("v"), "  a  b ") == ["a", "b"]
    assert one(spark, tx.tokenize("v"), "a b\nc\td") == ["a", "b", "c", "d"]
    assert one(spark, tx.word_count("v"), "") == 0
    assert one(spark, tx.word_count("v"), None) is None


def test_text_counts(spark):
    t = "Hi!! Ok?! end."
    assert one(spark, tx.word_count("v"), t) == 3
    assert one(spark, tx.char_count("v"), t) == 14
    assert one(spark, tx.sentence_count("v"), t) == 3
    assert one(spark, tx.exclamation_count("v"), t) == 3
    assert one(spark, tx.question_count("v"), t) == 1
    assert one(spark, tx.avg_word_length("v"), t) == pytest.approx(14 / 4)


def test_uppercase_ratio(spark):
    assert one(spark, tx.uppercase_ratio("v"), "aÉB") == pytest.approx(2 / 3)
    assert one(spark, tx.uppercase_ratio("v"), "") is None
    assert one(spark, tx.uppercase_ratio("v"), None) is None


def test_char_count_code_points(spark):
    assert one(spark, tx.char_count("v"), "😀a") == 2


def test_strip_accents_and_regex_tokens(spark):
    assert one(spark, tx.strip_accents("v"), "Café naïve Ñ") == "Cafe naive N"
    assert one(spark, tx.regex_tokens("v", 1), "Café, x_1 é!") == ["cafe", "x_1", "e"]
    assert one(spark, tx.regex_tokens("v", 2), "a bb ccc") == ["bb", "ccc"]


def test_ngrams(spark):
    r = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>").select(
        tx.all_ngrams(F.col("t"), 1, 3).alias("g")).first()["g"]
    assert r == ["a", "b", "c", "a b", "b c", "a b c"]


def test_elite_count(spark):
    assert one(spark, tx.elite_count("v"), "2010,2011") == 2
    assert one(spark, tx.elite_count("v"), None) == 0
    assert one(spark, tx.elite_count("v"), "") == 1


def test_contains_flags(spark):
    df = spark.createDataFrame([("Restaurants, Bars",), ("RESTAURANT supply",), (None,)], "v string")
    cs = [r[0] for r in df.select(tx.contains_flag("v", "Restaurants")).collect()]
    ci = [r[0] for r in df.select(tx.contains_flag("v", "Restaurant", True, True)).collect()]
    assert cs == [True, False, False]
    assert ci == [1, 1, 0]


def test_hours(spark):
    h = "{'Mon': '9:0-17:30', 'Tue': '17:0-2:0', 'Wed': '0:0-0:0'}"
    assert one(spark, total_hours(parse_hours("v")), h) == -7
    assert one(spark, total_hours(parse_hours("v"), wrap_midnight=True), h) == 8 + 9 + 0
    for bad in ("bad", "{'Monday': None}", None):
        assert one(spark, total_hours(parse_hours("v")), bad) == 0
    assert one(spark, total_hours(parse_hours("v")), "{'Mon': '9-17', 'Tue': '10:0-12:0'}") == 2


def test_tenure_floor_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 2, 23)),
                                (dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 23))],
                               "review timestamp, since timestamp")
    r = [x[0] for x in df.select(tenure_years("review", "since")).collect()]
    assert r == [pytest.approx(-1 / 365), 0.0]


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2016, 4, 25, 10),), (dt.datetime(2016, 5, 1, 10),)], "t timestamp")
    assert [r[0] for r in df.select(weekday("t")).collect()] == [0, 6]


def test_parse_ts_fixed_and_inferred(spark):
    fixed = parse_ts(F.col("v"), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, fixed, "2016-04-25 10:11:12") == dt.datetime(2016, 4, 25, 10, 11, 12)
    assert one(spark, fixed, "25/04/2016") is None            # lenient: bad text -> NULL
    inferred = parse_ts(F.col("v"))
    assert one(spark, inferred, "2016-04-25T10:11:12") == dt.datetime(2016, 4, 25, 10, 11, 12)
    assert one(spark, inferred, "2016-04-25") == dt.datetime(2016, 4, 25)
    assert one(spark, inferred, "not a date") is None
    with pytest.raises(Exception):
        one(spark, parse_ts(F.col("v"), "yyyy-MM-dd HH:mm:ss", lenient=False), "25/04/2016")


def test_ratios_null_instead_of_error(spark):
    df = spark.createDataFrame([(10.0, 4.0, -1.0)], "u double, n double, y double")
    r = df.select(engagement_ratio("u", "n").alias("e"), reviews_per_year("n", "y").alias("p")).first()
    assert r["e"] == pytest.approx(2.0)
    assert r["p"] is None
