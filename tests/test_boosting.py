"""Staged errors, the patience stop, searches on one kept frame, split counts."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from starlens.plans import boosting as bo
from starlens.plans import models as ml
from starlens.plans.tune import best_of_study, random_search_cv


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    y = 3 * np.sin(x[:, 0]) + x[:, 1] * x[:, 2] + rng.normal(scale=1.0, size=500)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "k long, a double, b double, c double, d double, label double")
    data = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).select("k", "features", "label").persist()
    return data.filter("k % 3 <> 0").persist(), data.filter("k % 3 = 0").persist()


PARAMS = {"n_estimators": 24, "max_depth": 3, "learning_rate": 0.4, "subsample": 0.8, "colsample_bytree": 0.7}


def rmse(model, df):
    return df.sparkSession and math.sqrt(ml.score(model, df).agg(F.avg(F.pow(F.col("label") - F.col("prediction"), F.lit(2)))).first()[0])


def test_staged_errors_equal_separate_fits(spark, frames):
    train, val = frames
    whole = ml.fit_gbt(train, params=PARAMS)
    errors = bo.staged_errors(whole, val)
    assert len(errors) == 24
    for n in (1, 2, 7, 24):
        alone = ml.fit_gbt(train, params={**PARAMS, "n_estimators": n})
        assert abs(errors[n - 1] - rmse(alone, val)) < 1e-9
        assert abs(errors[n - 1] - rmse(bo.prefix(spark, whole, n), val)) < 1e-9
    rows = bo.staged_frame(whole, val).collect()
    assert [r["n_trees"] for r in rows] == list(range(1, 25)) and abs(rows[6]["rmse"] - errors[6]) < 1e-12
    assert all(r["mae"] <= r["rmse"] for r in rows)


def test_watched():
    assert bo.watched([5, 4, 3, 3.5, 3.2], 2) == (3, True)
    assert bo.watched([5, 4, 3, 3.5, 2], 2) == (5, False)
    assert bo.watched([5, 6, 6, 1], 2) == (1, True) and bo.watched([5, 6, 6, 1], None) == (4, False)


def test_patience_keeps_the_best_prefix_of_one_long_fit(frames):
    train, val = frames
    params = {**PARAMS, "n_estimators": 60}
    errors = bo.staged_errors(ml.fit_gbt(train, params=params), val)
    want, stopped = bo.watched(errors, 5)
    fit = bo.fit_boosted(train, val, params=params, patience=5)
    assert stopped and fit.kept == want < fit.grown <= 60 == fit.asked
    assert abs(fit.error - errors[want - 1]) < 1e-9 and abs(rmse(fit.model, val) - fit.error) < 1e-9
    assert fit.model.getNumTrees == want
    alone = bo.fit_boosted(train, params={**PARAMS, "n_estimators": 5})
    assert alone.kept == 5 and math.isnan(alone.error)


SPACE = {"n_estimators": ("int", 10, 30), "max_depth": ("int", 2, 4), "learning_rate": ("uniform", 0.1, 0.5)}


def test_searches_use_the_staged_learner(frames):
    train, val = frames
    best, trials = random_search_cv(train, bo.fit_boosted, SPACE, "k", n_iter=3, folds=2, metric="mae")
    rows = trials.collect()
    assert len(rows) == 3 and all(r["trees_kept"] <= r["trees_asked"] for r in rows)
    assert str(best) == min(rows, key=lambda r: r["value"])["params"]
    trial, rows = best_of_study(train, val, bo.fit_boosted, SPACE, n_trials=3)
    assert abs(rmse(trial.model, val) - trial.value) < 1e-9 and trial.value == min(r["value"] for r in rows.collect())
    plain, _ = best_of_study(train, val, ml.fit_linear, {"regParam": ("uniform", 0.0, 0.1)}, n_trials=2)
    assert plain.kept is None and plain.value > 0


def test_split_counts_are_the_inner_nodes(frames):
    train, _ = frames
    names = list("abcd")
    for model in (ml.fit_gbt(train, params=PARAMS), ml.fit_forest(train, params={"n_estimators": 4, "max_depth": 4})):
        rows = ml.split_counts(model, names).collect()
        assert sum(r["splits"] for r in rows) == sum(t.numNodes // 2 for t in model.trees)
        assert [r["splits"] for r in rows] == sorted((r["splits"] for r in rows), reverse=True)
        nodes = ml.tree_nodes(model)
        assert nodes.filter("feature is null").count() == sum(t.numNodes - t.numNodes // 2 for t in model.trees)


def test_centred_learner_starts_at_the_mean(spark, frames):
    train, val = frames
    far = train.withColumn("label", F.col("label") + 1000)
    model = ml.fit_fm(far, params={"maxIter": 2})
    got = ml.score(model, val).agg(F.avg("prediction")).first()[0]
    assert abs(got - 1000) < 5


def test_kept_frames_are_not_dealt_again(frames):
    train, _ = frames
    assert ml.spread(train) is train
    with ml.training_input(train) as data:
        assert data is train
    assert ml.spread(train.select("label")).rdd.getNumPartitions() == 1


def test_machine_on_moments_equals_sparks_learner(spark):
    from pyspark.ml.regression import FMRegressor
    from starlens.plans.machines import fit_by_moments
    from starlens.plans.models import fit_fm
    rnd = random.Random(3)
    rows = [(Vectors.dense([rnd.gauss(0, 1) for _ in range(4)]), rnd.uniform(0, 9)) for _ in range(400)]
    df = spark.createDataFrame([(v, float(y + 2 * v[0] * v[1])) for v, y in rows], ["features", "label"]).repartition(3)
    kw = dict(featuresCol="features", seed=7, solver="adamW", stepSize=0.01, regParam=0.001, maxIter=30, factorSize=3)
    mean = df.agg(F.avg("label")).first()[0]
    theirs = FMRegressor(labelCol="c", **kw).fit(df.withColumn("c", F.col("label") - F.lit(mean)))
    ours, own_mean = fit_by_moments(df, "label", {**kw, "labelCol": "c"})
    assert own_mean == pytest.approx(mean) and ours.intercept == pytest.approx(theirs.intercept, abs=1e-9)
    assert ours.linear.toArray() == pytest.approx(theirs.linear.toArray(), abs=1e-9)
    assert ours.factors.toArray() == pytest.approx(theirs.factors.toArray(), abs=1e-9)
    fitted = fit_fm(df)
    assert fitted.transform(df).select("prediction").count() == 400
    with pytest.raises(Exception):
        fit_fm(df.unionByName(spark.createDataFrame([(Vectors.dense([1.0, float("nan"), 0.0, 0.0]), 1.0)], ["features", "label"])))


def test_machine_is_fitted_to_the_end(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = 40 + 9 * x[:, 0] - 4 * x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=3000)
    df = spark.createDataFrame([(Vectors.dense(r), float(t)) for r, t in zip(x, y)], ["features", "label"])
    model = ml.fit_fm(df)
    # 100 steps of 0.001 explain next to nothing of the labels
    assert rmse(model, df) < 0.6 and rmse(ml.fit_fm(df, params={"maxIter": 100}), df) > 8
    assert model.model.linear.toArray() == pytest.approx([9, 0, 0, 0], abs=0.1)


def test_a_task_of_a_large_frame_is_bounded():
    from starlens.plans.models import tasks_for
    assert tasks_for(0, 0, 12) == 1 and tasks_for(60_000, 0, 12) == 2 and tasks_for(2_000_000, 0, 12) == 12
    assert tasks_for(150_000_000, 0, 12) == 150 and tasks_for(1_000_000, 4 * 2 ** 30, 12) == 16


def test_wide_vectors_are_worth_more_tasks(spark):
    assert ml.tasks_for(36_000, 0, 12, 3000) == 12 and ml.tasks_for(5_000, 0, 12, 3000) == 2
    assert ml.tasks_for(60_000, 0, 12, 7) == 2 and ml.tasks_for(1_000, 0, 12, 3000) == 1
    wide = Vectors.sparse(3000, [5], [1.0])
    df = spark.createDataFrame([(float(i), wide) for i in range(5000)], ["label", "features"])
    assert ml.spread(df).rdd.getNumPartitions() == 2
    # the bins of a row of 3,000 entries take 12 KB, however few it holds
    assert df.select(F.min(ml._training_bytes(df))).first()[0] > 12_000


def test_an_early_best_prefix_costs_few_more_trees(frames, monkeypatch):
    train, val = frames
    scripted = [5.0, 4.0, 3.0, 2.0] + [2.5] * 56
    monkeypatch.setattr(bo, "staged_errors", lambda model, *rest: scripted[:model.getNumTrees])
    fit = bo.fit_boosted(train, val, params={"n_estimators": 60, "max_depth": 1}, patience=10)
    assert (fit.kept, fit.grown) == (4, 14) and fit.model.getNumTrees == 4
    scripted[12] = 1.0  # better again behind the first fit
    fit = bo.fit_boosted(train, val, params={"n_estimators": 60, "max_depth": 1}, patience=10)
    assert (fit.kept, fit.grown) == (13, 28) and bo.watched(scripted, 10) == (13, True)
