"""Boosted regression trees with staged errors and a patience stop.

A boosted model is a prefix of any longer one: Spark seeds every tree by its
number, so the first n trees of a fit are the fit of n trees.  Two things
follow.  The errors of all numbers of trees come from one pass over the
validation rows of one fit.  And growth can stop early by fitting ``first``
trees, then more until the best prefix lies ``patience`` trees back: just so
many that this could be seen if the best prefix is an early one, else twice as
many.  Some twice the trees of the last fit are grown, and the result is the
one that watching every tree would have given.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.plans.models import GBT_PARAMS, boosting_input, extent, to_spark_params
from starlens.plans.trees import binned, blocks_of, plan_of, watched
from starlens.plans.trees import _parts

LOSSES = {"rmse": "squared", "mae": "absolute"}


def prefix(spark: SparkSession, model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` trees, with the columns of ``model``."""
    gateway = spark.sparkContext._gateway
    regression = gateway.jvm.org.apache.spark.ml.regression
    trees = gateway.new_array(regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(gateway.jvm.double, n)
    for i, (t, w) in enumerate(zip(model.trees[:n], model.treeWeights[:n])):
        trees[i], weights[i] = t._java_obj, float(w)
    cut = GBTRegressionModel(regression.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", trees, weights))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def staged_errors(model: GBTRegressionModel, df: DataFrame, metric: str = "rmse", label_col: str = "label") -> list[float]:
    """The error of every prefix of the model's trees, in one pass over ``df``.

    Each row adds up its trees' predictions one after the other; the losses of
    all prefixes are one aggregate.  Equal to fitting and scoring each number
    of trees by itself.
    """
    rows = df.select(F.col(model.getFeaturesCol()), F.col(label_col).cast("double").alias("label"))
    losses = model.evaluateEachIteration(rows, LOSSES[metric])
    return [math.sqrt(x) for x in losses] if metric == "rmse" else list(losses)


def staged_frame(model: GBTRegressionModel, df: DataFrame, label_col: str = "label") -> DataFrame:
    """(n_trees, rmse, mae) of every prefix."""
    pairs = zip(*[staged_errors(model, df, m, label_col) for m in ("rmse", "mae")])
    return df.sparkSession.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pairs, 1)], "n_trees int, rmse double, mae double")


@dataclass
class Boosted:
    """model: the kept trees; asked, grown (in the last fit), kept; errors: validation error of every prefix grown."""

    model: GBTRegressionModel
    asked: int
    grown: int
    kept: int
    errors: list[float] = field(default_factory=list)

    @property
    def error(self) -> float:
        return self.errors[self.kept - 1] if self.errors else math.nan


def fit_boosted(train: DataFrame, validation: DataFrame | None = None, features_col: str = "features",
                label_col: str = "label", params: dict | None = None, metric: str = "rmse", patience: int | None = 10,
                first: int | None = None, seed: int = 42, max_bins: int = 256) -> Boosted:
    """Boost up to ``n_estimators`` trees (``params``, names as in ``models.GBT_PARAMS``).

    With ``validation`` the best prefix by ``metric`` is kept, and no tree
    after ``patience`` trees without a better prefix counts (``None``: all are
    grown and the best prefix of all is kept).  The first fit has ``first``
    trees, by default the fewest that can tell.  The training rows are kept in
    the cluster for all fits.
    """
    options, _ = to_spark_params(params, GBT_PARAMS)
    asked = options.pop("maxIter", 20)
    n = asked if validation is None or patience is None else min(asked, first or patience + 2)
    with boosting_input(train, features_col, label_col, options, seed, max_bins) as grower:
        while True:
            model = grower.grow(n)
            if validation is None:
                return Boosted(model, asked, n, n)
            errors = staged_errors(model, validation, metric, label_col)
            kept, stopped = watched(errors, patience)
            if stopped or n == asked:
                return Boosted(prefix(train.sparkSession, model, kept), asked, n, kept, errors)
            # the best prefix to come is longer than n, so the next step after a short one is a doubling
            n = min(asked, kept + patience if patience is not None and n < kept + patience and 2 * kept <= n else 2 * n)


def boosted_errors(train: DataFrame, validation: DataFrame, draws: list[dict], features_col: str = "features",
                   label_col: str = "label", metric: str = "rmse", patience: int | None = 10, seed: int = 42,
                   max_bins: int = 256) -> list[tuple[float, int, int]] | None:
    """(error, trees asked, trees kept) of :func:`fit_boosted` for every parameter set, all at once.

    The rows are binned once; every fit is a task, which watches its trees one by one.  None where the rows are too many
    for a task: then each fit is to spread over the cluster.
    """
    n, _, width = extent(train.select(features_col, label_col))
    with binned(train, n, width, features_col, label_col, seed, max_bins) as rows:
        held = rows and rows.local and rows.small(blocks_of(_parts(validation, features_col, label_col), rows.bins))
        if not held:
            return None
        plans = [plan_of(to_spark_params(p, GBT_PARAMS)[0], width, seed) for p in draws]
        out = []
        for plan, (_, errors) in zip(plans, rows.fits(plans, held, metric, patience)):
            kept = watched(errors, patience)[0]
            out.append((errors[kept - 1], plan.trees, kept))
        return out


fit_boosted.all_errors = boosted_errors  # the fits of a search at once
fit_boosted.staged = True  # tells a search that the learner watches its validation rows itself
