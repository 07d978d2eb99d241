"""Trees on binned rows: equal to Spark's learner, in one task, spread over the cluster, and on long sparse vectors."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from starlens.plans import boosting as bo
from starlens.plans import models as ml
from starlens.plans import trees as tr


def rows_of(spark, n=1500, parts=1, sparse=False, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 3] = np.round(x[:, 3])
    x[:, 4] = np.where(rng.random(n) < 0.7, 0.0, x[:, 4])
    y = 3 * np.sin(x[:, 0]) + x[:, 1] * x[:, 2] + x[:, 3] + rng.normal(size=n)
    vector = (lambda r: Vectors.sparse(5, np.flatnonzero(r), r[r != 0])) if sparse else Vectors.dense
    return spark.createDataFrame([(i, vector(r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 ["k", "features", "label"]).repartition(parts).persist()


def predictions(model, df):
    return np.array([r[0] for r in model.transform(df).orderBy("k").select("prediction").collect()])


def test_random_numbers_are_sparks(spark):
    for seed in (1, 42, -7):
        theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert [theirs.nextDouble() for _ in range(9)] == tr.xorshift_doubles(seed, 9).tolist()
        theirs, ours = spark._jvm.java.util.Random(seed), tr._JavaRandom(seed)
        assert [theirs.nextLong() for _ in range(5)] == [ours.long() for _ in range(5)]


@pytest.mark.parametrize("params", [{"n_estimators": 6}, {"n_estimators": 5, "max_depth": 7, "subsample": 0.7, "min_child_samples": 4},
                                    {"n_estimators": 5, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.5, "min_split_gain": 0.01}])
def test_trees_equal_sparks_learner(spark, params, monkeypatch):
    df = rows_of(spark)
    options, _ = ml.to_spark_params(params, ml.GBT_PARAMS)
    want = predictions(GBTRegressor(seed=42, maxBins=256, **options).fit(df), df)
    model = ml.fit_gbt(df, params=params)
    assert predictions(model, df) == pytest.approx(want, abs=1e-9) and model.numFeatures == 5
    assert [t.depth for t in model.trees] and sum(model.featureImportances.toArray()) == pytest.approx(1.0)
    monkeypatch.setattr(tr, "LOCAL_BYTES", 0)
    assert predictions(ml.fit_gbt(df, params=params), df) == pytest.approx(want, abs=1e-9)


def test_long_sparse_vectors_and_many_partitions(spark, monkeypatch):
    df = rows_of(spark, parts=3, sparse=True)
    params = {"n_estimators": 18, "max_depth": 2, "subsample": 0.8}
    want = predictions(GBTRegressor(seed=42, maxBins=256, maxIter=18, maxDepth=2, subsamplingRate=0.8).fit(df), df)
    assert predictions(ml.fit_gbt(df, params=params), df) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(tr, "NARROW", 2)
    assert predictions(ml.fit_gbt(df, params=params), df) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(tr, "LOCAL_BYTES", 0)
    monkeypatch.setattr(tr, "CELLS", 600)
    assert predictions(ml.fit_gbt(df, params=params), df) == pytest.approx(want, abs=1e-9)


def test_missing_values_are_errors(spark):
    bad = [(0, Vectors.dense([1.0, float("nan")]), 1.0), (1, Vectors.dense([1.0, 2.0]), 2.0)]
    with pytest.raises(Exception):
        ml.fit_gbt(spark.createDataFrame(bad, ["k", "features", "label"]))
    with pytest.raises(Exception):
        ml.fit_gbt(spark.createDataFrame([(0, Vectors.dense([1.0]), None), (1, Vectors.dense([2.0]), 2.0)], ["k", "features", "label"]))


def test_constant_features_and_few_rows(spark):
    df = spark.createDataFrame([(i, Vectors.dense([1.0, float(i % 2)]), float(i % 2)) for i in range(4)], ["k", "features", "label"])
    assert predictions(ml.fit_gbt(df, params={"n_estimators": 3}), df) == pytest.approx([0.0, 1.0, 0.0, 1.0])
    flat = df.withColumn("label", F.lit(2.0))
    assert predictions(ml.fit_gbt(flat, params={"n_estimators": 3}), flat) == pytest.approx([2.0] * 4)


def test_a_fit_takes_few_jobs(spark):
    df = rows_of(spark)
    df.count()
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "")
    ml.fit_gbt(df, params={"n_estimators": 24, "max_depth": 4})
    sc.setJobGroup("other", "")
    # Spark's learner runs one for every level of every tree
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) < 20


def test_all_fits_of_a_search_at_once(spark):
    df = rows_of(spark)
    train, val = df.filter("k % 3 <> 0").persist(), df.filter("k % 3 = 0").persist()
    draws = [{"n_estimators": 40, "max_depth": 3, "learning_rate": 0.5, "subsample": 0.8}, {"n_estimators": 7, "max_depth": 2}]
    found = bo.boosted_errors(train, val, draws, metric="mae")
    for (error, asked, kept), p in zip(found, draws):
        fit = bo.fit_boosted(train, val, params=p, metric="mae")
        assert (asked, kept) == (fit.asked, fit.kept) and error == pytest.approx(fit.error, abs=1e-9)
    assert found[0][2] < 40 and found[1][1] == 7
