"""Values that the driver's tables do not hold: NaN, limits of types, odd names, odd letters."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from starlens.functions import text as tx
from starlens.operators import enrich, features, profile, scale, sentiment, split, stats

NAN = float("nan")


@pytest.fixture(scope="module")
def with_nan(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, NAN), (NAN, 1.0), (4.0, 7.0), (9.0, 20.0)],
                                 "x double, y double")


def test_histogram_nan_is_missing(with_nan):
    rows = stats.histogram(with_nan, "x", 4).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 2, 0, 1]
    assert (rows[0]["bin_lo"], rows[-1]["bin_hi"]) == (1.0, 9.0)


def test_histogram_infinite_edge_raises(spark):
    with pytest.raises(ValueError):
        stats.histogram(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), "x")


def test_scatter_drops_nan_pairs(with_nan):
    assert stats.scatter_bins(with_nan, "x", "y", 2, 2).agg(F.sum("count")).first()[0] == 4


def test_kde_and_box_nan_is_missing(with_nan):
    clean = with_nan.filter(~F.isnan("x"))
    assert stats.kde_grid(with_nan, "x", points=8).orderBy("i").collect() == \
        stats.kde_grid(clean, "x", points=8).orderBy("i").collect()
    box = stats.box_stats(with_nan, "x").first()
    assert (box["n"], box["n_outliers"], box["median"]) == (5, 1, 3.0)


def test_correlation_nan_is_missing(with_nan):
    pd = pytest.importorskip("pandas")
    want = pd.DataFrame([tuple(r) for r in with_nan.collect()], columns=["x", "y"]).corr()
    got = {(r["col_a"], r["col_b"]): r["r"] for r in stats.corr_matrix(with_nan).collect()}
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])
    assert stats.corr_with_target(with_nan, ["x"], "y").first()["r"] == pytest.approx(want.loc["x", "y"])


def test_scaler_nan_is_missing(with_nan):
    out = scale.PopulationScaler(["x"]).fit(with_nan).transform(with_nan)
    z = [r["x"] for r in out.collect()]
    assert z.count(None) == 1 and sum(v for v in z if v is not None) == pytest.approx(0.0)


def test_downcast_keeps_exact_values(spark):
    df = spark.createDataFrame([(9223372036854775807, 9007199254740993, 5, NAN)],
                               "a bigint, b bigint, c bigint, f double")
    df = df.withColumn("d", F.expr("cast('123456789012.34' as decimal(18,2))"))
    out, report = profile.downcast(df)
    kinds = {r["column_name"]: r["to_type"] for r in report.collect()}
    assert kinds == {"a": "bigint", "b": "bigint", "c": "byte", "f": "double", "d": "decimal(18,2)"}
    row = out.first()
    assert (row["a"], row["b"], str(row["d"])) == (9223372036854775807, 9007199254740993, "123456789012.34")


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, "k")], "`a.b` double, `c.d` string")
    assert {r["column_name"]: r["null_count"] for r in profile.null_report(df).collect()} == {"c.d": 1}
    assert profile.min_max(df).first()["max"] == 3.0
    assert profile.duplicate_report(df).filter("not is_duplicate").first()["n_rows"] == 2
    assert profile.downcast(df)[0].columns == ["a.b", "c.d"]
    assert stats.histogram(df, "a.b", 2).count() == 2
    assert stats.describe_numeric(df).first()["mean"] == 2.0


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@pytest.mark.parametrize("text", ["été", "й", "άέ", "ﬁn oﬃce", "ǆ Ĳ",
                                  "Café", "Ａｂ", "plain", ""])
def test_strip_accents_equals_decomposition(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.strip_accents("t")).first()[0] == fold(text)


def test_separators_split_words_as_python_does(spark):
    text = "a\x1cb\x1dc\x1ed\x1fe\x85f g h"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.tokenize("t")).first()[0] == text.split()


def test_lexicon_words_listed_twice_count_once(spark):
    docs = spark.createDataFrame([(1, "good day")], "id long, t string")
    lex = spark.createDataFrame([("good", 0.5, 0.2), ("Good", 0.9, 0.4), ("day", 0.1, 0.0)],
                                "word string, polarity double, subjectivity double")
    r = sentiment.sentiment(docs, "id", "t", lex).first()
    assert r["sentiment_polarity"] == pytest.approx((0.7 + 0.1) / 2)


def test_null_keys_split_like_the_empty_key(spark):
    df = spark.createDataFrame([(None,), ("",)], "k string")
    assert split.hash_split(df, "k").select("split").distinct().count() == 1


def test_size_check_gathers_no_rows(spark):
    df = spark.range(0, 4000, numPartitions=8).select("id")
    assert enrich.bounded_size(df, 4000) and not enrich.bounded_size(df, 3999)
    assert enrich.bounded_size(df.limit(0), 10)


def test_one_hot_of_many_categories(spark):
    df = spark.range(1500).select(F.format_string("c%05d", "id").alias("c"))
    assert len(features.DropFirstOneHot("c").fit(df).categories) == 1500
    with pytest.raises(ValueError):
        features.DropFirstOneHot("c", max_categories=1000).fit(df)
