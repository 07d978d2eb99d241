"""Factorization machines fitted on moments: one pass over the rows, however many steps.

The prediction of a machine is linear in 1, the features and their products by
pairs, so the gradient of the squared error over all rows follows from the sums
of these terms times each other and times the label.  Spark gathers the sums
once; the full-batch steps of Spark's learner (its start values, AdamW update
and stop) then need no row again.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.regression import FMRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features beyond which the sums (all products of two pairs) are larger than a pass is worth.
MOST_FEATURES = 24
#: Steps after which it is asked whether they still lower the error, and the share of all that was gained which they must.
PLATEAU, WORTH = 500, 1e-4
#: More steps than any such fit should need; a bound against one that never ends.
MOST_STEPS = 1_000_000
#: Parameters that :func:`fit_by_moments` follows, and the one solver.
FOLLOWED = {"featuresCol", "labelCol", "seed", "solver", "stepSize", "regParam", "maxIter", "factorSize", "tol", "initStd"}


#: Passes over the training rows and rows of a step of a whole fit.
EPOCHS, BATCH = 100, 64


def epoch_steps(rows: int) -> int:
    """The steps of ``EPOCHS`` passes over so many rows in batches of ``BATCH``."""
    return EPOCHS * max(1, math.ceil(rows / BATCH))


def moments(rows: DataFrame, features_col: str, label_col: str, width: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(sum of terms x terms, sum of terms x label, sums of labels and of their squares); terms: 1, the features, their
    products i < j."""
    left, right = np.triu_indices(width, 1)
    size = 1 + width + len(left)

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):  # the terms of a few thousand rows stay in the cache
                part = x[at:at + 4096]
                terms = np.concatenate([np.ones((len(part), 1)), part, part[:, left] * part[:, right], y[at:at + 4096, None]], axis=1)
                total += terms.T @ terms
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["slot", "value"])

    got = (rows.select(vector_to_array(F.col(features_col)), F.col(label_col).cast("double"))
           .mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow())
    out = np.zeros((size + 1) ** 2)
    out[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    out = out.reshape(size + 1, size + 1)
    return out[:size, :size], out[:size, size], float(out[0, size]), float(out[size, size])


def adamw_steps(gram: np.ndarray, moment: np.ndarray, start: np.ndarray, steps: int, rate: float, decay: float, tol: float,
                least_rate: float | None = None):
    """(intercept, linear, factors) after ``steps`` full-batch AdamW steps from factors ``start``, as Spark takes them.

    With ``least_rate`` the rate, and the decay with it, is halved where ``PLATEAU`` steps no longer lower the error, and
    the steps end once it is below ``least_rate``.
    """
    width, rank = start.shape
    left, right = np.triu_indices(width, 1)
    n = gram[0, 0]
    w = np.concatenate([start.ravel(), np.zeros(width + 1)])
    first = second = np.zeros(len(w))
    gained = 0.0
    for i in range(1, steps + 1):
        v, linear, intercept = w[:width * rank].reshape(width, rank), w[width * rank:-1], w[-1:]
        weights = np.concatenate([intercept, linear, (v[left] * v[right]).sum(axis=1)])
        fitted = gram @ weights
        if least_rate is not None and i % PLATEAU == 0:
            gain = float(weights @ (2 * moment - fitted))  # by how much the sum of squared errors is below that of no weights
            if gain - gained <= WORTH * abs(gain):
                rate, decay = rate / 2, decay / 2
                if rate < least_rate:
                    break
            gained = gain
        slope = 2 * (fitted - moment) / n
        cross = np.zeros((width, width))
        cross[left, right] = cross[right, left] = slope[1 + width:]
        g = np.concatenate([(cross @ v).ravel(), slope[1:1 + width], slope[:1]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9 ** i)) / (np.sqrt(second / (1 - 0.999 ** i)) + 1e-8) + decay * w
        last, w = w, w - step
        if i > 1 and np.linalg.norm(last - w) < tol * max(np.linalg.norm(w), 1.0):
            break
    return float(w[-1]), w[width * rank:-1], w[:width * rank].reshape(width, rank)


def fit_by_moments(train: DataFrame, label_col: str, params: dict, least_rate: float | None = None, scaled: bool = False):
    """(Spark's model, mean label) of a machine fitted on the labels less their mean; None where moments do not serve.

    Without ``maxIter`` the steps go on until they no longer tell (``least_rate``, see :func:`adamw_steps`).  With
    ``scaled`` they are taken on labels of deviation 1, so that their number does not depend on the labels' unit.
    """
    if set(params) - FOLLOWED or params.get("solver") != "adamW":
        return None
    features_col = params["featuresCol"]
    head = train.select(features_col).first()
    if head is None or head[0] is None or head[0].size > MOST_FEATURES:
        return None
    width, rank = head[0].size, params["factorSize"]
    gram, moment, total, squares = moments(train, features_col, label_col, width)
    if not (np.isfinite(gram).all() and np.isfinite(moment).all()):
        raise ValueError("labels and features must not be NULL, NaN or infinite")
    mean = total / gram[0, 0]
    unit = math.sqrt(max(squares / gram[0, 0] - mean * mean, 0.0)) if scaled else 1.0
    unit = unit if unit > 1e-9 * abs(mean) else 1.0
    sc = train.sparkSession.sparkContext
    draw = sc._jvm.java.util.Random(params["seed"])
    start = np.array([draw.nextGaussian() for _ in range(width * rank)]).reshape(width, rank) * params.get("initStd", 0.01)
    intercept, linear, factors = adamw_steps(gram, (moment - mean * gram[0]) / unit, start, params.get("maxIter", MOST_STEPS),
                                             params["stepSize"], params["regParam"], params.get("tol", 1e-6), least_rate)
    made = sc._jvm.org.apache.spark.ml.regression.FMRegressionModel(
        f"fmr_{uuid.uuid4().hex[:12]}", unit * intercept, _py2java(sc, Vectors.dense(unit * linear)),
        _py2java(sc, DenseMatrix(width, rank, math.sqrt(unit) * factors.ravel(), True)))
    return FMRegressionModel(made).setFeaturesCol(features_col), mean
