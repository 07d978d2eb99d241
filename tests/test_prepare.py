"""Review preparation, empty inputs, early stopping."""

import datetime as dt

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from starlens.operators import enrich as en
from starlens.operators import features as fe
from starlens.operators import stats as st
from starlens.operators import words as wd
from starlens.operators import profile as pf
from starlens.plans import models as ml


def combined(spark):
    rows = [
        ("r1", "u1", "b1", "Great place!", "Restaurants, Bars", "{'Monday': '9:0-17:30'}", "CA",
         dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 2, 10), 4.0),
        ("r2", "u2", "b2", "Bad.", "restaurant supply", "{'Tuesday': '17:0-2:0'}", "AZ",
         dt.datetime(2020, 6, 1), dt.datetime(2020, 6, 2), 2.0),
        ("r3", "u3", "b3", "x", "Shopping", "{'Monday': '9:0-10:0'}", "NV",
         dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1), 3.0),
        ("r4", "u4", "b4", "y", None, "{'Monday': '9:0-10:0'}", "NV",
         dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1), 3.0),
        ("r5", "u5", "b5", "z", "Restaurants", None, "NV",
         dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1), 3.0),
        ("r6", "u6", "b6", "Fine", "Restaurants", "bad", "NV",
         dt.datetime(2019, 1, 1), dt.datetime(2020, 1, 6), 5.0),
    ]
    return spark.createDataFrame(rows, "review_id string, user_id string, business_id string, text string, "
                                       "categories string, hours string, state string, member_since timestamp, "
                                       "review_date timestamp, review_star double")


def test_prepare_reviews_golden(spark):
    prepared, model = fe.prepare_reviews(combined(spark))
    rows = {r["review_id"]: r for r in prepared.collect()}
    assert set(rows) == {"r1", "r2", "r6"}
    assert model.categories == ["AZ", "CA", "NV"] and model.output_cols == ["state_CA", "state_NV"]
    assert rows["r1"]["total_hours"] == 8 and rows["r2"]["total_hours"] == -15 and rows["r6"]["total_hours"] == 0
    assert rows["r1"]["state_CA"] == 1 and rows["r2"]["state_CA"] == 0 and rows["r2"]["state_NV"] == 0
    assert rows["r1"]["years_on_platform"] == pytest.approx(367 / 365)
    assert (rows["r6"]["review_year"], rows["r6"]["review_month"], rows["r6"]["review_weekday"]) == (2020, 1, 0)
    assert "user_id" not in prepared.columns and "categories" not in prepared.columns


def test_feature_frame_imputes_and_ratios(spark):
    prepared, _ = fe.prepare_reviews(combined(spark))
    prepared = prepared.withColumn("user_useful", F.lit(4.0)).withColumn(
        "total_user_review_count", F.when(F.col("review_id") == "r1", F.lit(None)).otherwise(F.lit(3.0)))
    frame, feats = fe.feature_frame(prepared)
    assert "user_engagement_ratio" in feats and "reviews_per_year" in feats and "state_CA" in feats
    rows = {r["review_id"]: r for r in frame.collect()}
    assert rows["r2"]["user_engagement_ratio"] == pytest.approx(1.0)
    # r1's ratio was NULL and is imputed with the mean of the others
    assert rows["r1"]["user_engagement_ratio"] == pytest.approx(1.0)
    assert rows["r1"]["total_user_review_count"] == pytest.approx(3.0)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k string, x double, text string")
    assert st.histogram(empty, "x", 10).count() == 0
    assert wd.top_words(empty, "text").count() == 0
    assert pf.null_report(empty).count() == 0
    assert st.kde_grid(empty, "x").count() == 0
    assert en.top_keys(empty, "k", 5).count() == 0
    r = st.describe_numeric(empty, ["x"]).first()
    assert r["count"] == 0 and r["p50"] is None


def test_sum_by_max(spark):
    df = spark.createDataFrame([("u", 5), ("u", 5), ("v", 2)], "k string, total int")
    assert {r["k"]: r["t"] for r in en.sum_by(df, "k", "total", "t", how="max").collect()} == {"u": 5, "v": 2}


def test_gbt_early_stopping_validation_column(spark):
    rows = [(float(i % 17), float(i % 5), float((i % 17) * 2 + i % 5), i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label double, is_val boolean")
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    m = ml.fit_gbt(data, params={"n_estimators": 50, "max_depth": 3}, validation_col="is_val")
    assert 1 <= m.getNumTrees <= 50
