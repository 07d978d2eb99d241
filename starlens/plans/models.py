"""Regressors on assembled feature vectors, prediction and importances."""

from __future__ import annotations

import uuid
import warnings
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import (FMRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions._util import named
from starlens.plans.machines import epoch_steps, fit_by_moments
from starlens.plans.trees import Grower, binned, plan_of
from starlens.session import scratch_path

# Boosting parameter names of the reference learners -> GBTRegressor params.
# num_leaves, reg_alpha and reg_lambda have no GBTRegressor counterpart.
GBT_PARAMS = {"n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
              "min_child_samples": "minInstancesPerNode", "min_split_gain": "minInfoGain",
              "subsample": "subsamplingRate", "colsample_bytree": "featureSubsetStrategy"}
FOREST_PARAMS = {"n_estimators": "numTrees", "max_depth": "maxDepth",
                 "min_child_samples": "minInstancesPerNode", "subsample": "subsamplingRate",
                 "colsample_bytree": "featureSubsetStrategy", "min_split_gain": "minInfoGain"}


def to_spark_params(params: dict | None, mapping: dict) -> tuple[dict, list]:
    out, ignored = {}, []
    for k, v in (params or {}).items():
        if k in mapping:
            name = mapping[k]
            if name in ("maxIter", "numTrees", "maxDepth", "minInstancesPerNode"):
                v = int(v)
            if name == "maxDepth" and v > 30:
                warnings.warn(f"{k} = {v} is above the deepest tree of Spark; 30 is used")
                v = 30
            if name == "featureSubsetStrategy":
                v = str(min(max(float(v), 1e-6), 1.0))
            if name == "subsamplingRate":
                v = min(max(float(v), 1e-6), 1.0)
            out[name] = v
        else:
            ignored.append(k)
    if ignored:
        warnings.warn(f"parameters without a Spark counterpart ignored: {ignored}")
    return out, ignored


#: Iterative learners run one task per partition on every pass; fewer rows than this are not worth one.
ROWS_PER_TASK = 50_000
#: That holds for vectors of up to so many entries; a row of a longer one is worth as many times more.  A task of fewer
#: rows than these spends most of its time on the sums of its bins, not on its rows.
NARROW, LEAST_ROWS = 8, 2_000
#: What a task of a large frame holds at most, in rows and in bytes of their vectors and numbers.
MOST_ROWS, MOST_BYTES = 1_000_000, 256 * 1024 * 1024


def _length(name: str):
    """Entries of a vector, zeros included."""
    v = F.unwrap_udt(named(name))
    return F.coalesce(v["size"], F.size(v["values"]), F.lit(0))


def _training_bytes(df: DataFrame):
    """Approximate bytes of each row: the entries a vector holds and a bin number for each entry of its full length
    (tree learners), 8 for any other column."""
    total = F.lit(16).cast("long")
    for f in df.schema.fields:
        held = F.lit(8)
        if isinstance(f.dataType, VectorUDT):
            values = F.coalesce(F.size(F.unwrap_udt(named(f.name))["values"]), F.lit(0))
            held = F.lit(48) + F.lit(12) * values + F.lit(4) * _length(f.name)
        total = total + held
    return total


def tasks_for(rows: int, size: int, cores: int, width: int = 0) -> int:
    """As many tasks as the rows of vectors of ``width`` entries are worth; beyond the cores only so many that none holds
    more than the bounds."""
    worth = min(-(-rows * max(width, NARROW) // (NARROW * ROWS_PER_TASK)),
                max(-(-rows // ROWS_PER_TASK), rows // LEAST_ROWS))
    return max(1, min(cores, worth), -(-rows // MOST_ROWS), -(-size // MOST_BYTES))


def extent(df: DataFrame) -> tuple[int, int, int]:
    """(rows, approximate bytes, entries of the longest row's vectors)."""
    lengths = [_length(f.name) for f in df.schema.fields if isinstance(f.dataType, VectorUDT)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_training_bytes(df)).alias("b"),
               F.max(sum(lengths, F.lit(0))).alias("w")).first()
    return r["n"], r["b"] or 0, r["w"] or 0


def spread(df: DataFrame, size: tuple[int, int, int] | None = None) -> DataFrame:
    """The rows evenly over as many tasks as they are worth (see ``tasks_for``); a kept frame as it is."""
    if df.is_cached:
        return df
    n, held, width = size or extent(df)
    return df.repartition(tasks_for(n, held, df.sparkSession.sparkContext.defaultParallelism, width))


@contextmanager
def training_input(df: DataFrame):
    """The training rows spread over the cluster and kept (memory, spilling to
    disk) for a learner's passes, released after the fit.  A frame that the
    caller already keeps is used as it is, so that many fits share it."""
    if df.is_cached:
        yield df
        return
    data = spread(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield data
    finally:
        data.unpersist()


def fit_gbt(train: DataFrame, features_col: str = "features", label_col: str = "label",
            params: dict | None = None, seed: int = 42, max_bins: int = 256,
            validation_col: str | None = None):
    """Gradient-boosted trees (histogram splits, ``maxBins``), grown on binned rows (``plans.trees``).

    With a validation column Spark's own learner fits and stops.
    """
    sp, _ = to_spark_params(params, GBT_PARAMS)
    if validation_col:
        kw = dict(featuresCol=features_col, labelCol=label_col, seed=seed, maxBins=max_bins, validationIndicatorCol=validation_col)
        with training_input(train) as data:
            return GBTRegressor(**{**kw, **sp}).fit(data)
    with boosting_input(train, features_col, label_col, sp, seed, max_bins) as grower:
        return grower.grow(sp.get("maxIter", 20))


class _SparkGrower:
    """Fits Spark's learner anew for every number of trees."""

    def __init__(self, data: DataFrame, options: dict):
        self.data, self.options = data, options

    def grow(self, n: int):
        return GBTRegressor(**{**self.options, "maxIter": n}).fit(self.data)


@contextmanager
def boosting_input(train: DataFrame, features_col: str, label_col: str, options: dict, seed: int, max_bins: int):
    """What grows boosted trees on these rows: ``grow(n)`` gives the model of the first n.

    The rows are binned once, from the frame as it is; only frames with categorical features or more than 256 bins go
    through Spark's learner, on a kept copy.
    """
    size = extent(train.select(features_col, label_col))
    with binned(spread(train.select(features_col, label_col) if not train.is_cached else train, size), size[0], size[2],
                features_col, label_col, seed, max_bins) as rows:
        if rows is not None:
            grower = Grower(rows, plan_of(options, size[2], seed), features_col)
            try:
                yield grower
            finally:
                grower.close()
            return
    with training_input(train) as data:
        yield _SparkGrower(data, dict(featuresCol=features_col, labelCol=label_col, seed=seed, maxBins=max_bins, **options))


def fit_forest(train: DataFrame, features_col: str = "features", label_col: str = "label",
               params: dict | None = None, seed: int = 42):
    sp, _ = to_spark_params(params, FOREST_PARAMS)
    with training_input(train) as data:
        return RandomForestRegressor(featuresCol=features_col, labelCol=label_col, seed=seed, **sp).fit(data)


class Centred:
    """A regression model fitted on labels less their mean, in units of ``unit``; its predictions get both back."""

    def __init__(self, model, mean: float, unit: float = 1.0):
        self.model, self.mean, self.unit = model, mean, unit

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", F.col("prediction") * F.lit(self.unit) + F.lit(self.mean))


def fit_fm(train: DataFrame, features_col: str = "features", label_col: str = "label",
           params: dict | None = None, seed: int = 42) -> Centred:
    """Non-tree learner: factorization machine regressor with AdamW.

    Its steps are small and start from 0, so it is fitted on centred labels of
    deviation 1, and unless ``maxIter`` is given to the end: 100 steps move a
    weight by 0.1 at most.  With few features the steps are taken on moments
    gathered in one pass (``machines.fit_by_moments``, the same steps as
    Spark's) until halved rates gain no more; wide vectors and other solvers go
    through Spark's learner, one pass a step, for the steps of 100 passes in
    batches of 64 rows (``machines.epoch_steps``).
    """
    kw = dict(featuresCol=features_col, labelCol="__centred", seed=seed, solver="adamW", stepSize=0.001, factorSize=8)
    kw.update(params or {})
    # Spark takes regParam off a weight at every step, whatever the rate: 0.001 at a rate of 0.001 would hold it below 1
    kw.setdefault("regParam", 0.001 * kw["stepSize"])
    found = fit_by_moments(train, label_col, kw, None if "maxIter" in kw else 0.01 * kw["stepSize"], True)
    if found is not None:
        return Centred(*found)
    with training_input(train) as data:
        r = data.agg(F.avg(label_col), F.stddev_pop(label_col), F.count(F.lit(1))).first()
        mean, unit = r[0] or 0.0, r[1] or 1.0
        kw.setdefault("maxIter", epoch_steps(r[2]))
        return Centred(FMRegressor(**kw).fit(data.withColumn("__centred", (F.col(label_col) - F.lit(mean)) / F.lit(unit))), mean, unit)


def fit_linear(train: DataFrame, features_col: str = "features", label_col: str = "label",
               params: dict | None = None, seed: int = 42):
    kw = dict(featuresCol=features_col, labelCol=label_col, regParam=0.001)
    kw.update(params or {})
    with training_input(train) as data:
        return LinearRegression(**kw).fit(data)


LEARNERS = {"gbt": fit_gbt, "forest": fit_forest, "fm": fit_fm, "linear": fit_linear}


def score(model, df: DataFrame, pred_col: str = "prediction") -> DataFrame:
    out = model.transform(df)
    return out if pred_col == "prediction" else out.withColumnRenamed("prediction", pred_col)


def _top(spark: SparkSession, values, names: list[str], k: int, schema: str) -> DataFrame:
    """The ``k`` largest of one value per feature, ties by position."""
    rows = [(names[i] if i < len(names) else f"f{i}", v, i) for i, v in enumerate(values)]
    rows.sort(key=lambda r: (-r[1], r[2]))
    return spark.createDataFrame([(n, v) for n, v, _ in rows[:k]], schema)


def feature_importances(spark: SparkSession, model, names: list[str], k: int = 20) -> DataFrame:
    """(feature, importance) of a tree model, largest first, ties by position.

    Spark reports normalised importance (sums to 1); the vector is one entry
    per feature, so it is small driver-side data.
    """
    return _top(spark, [float(v) for v in model.featureImportances.toArray()], names, k, "feature string, importance double")


def tree_nodes(model, path: str | None = None) -> DataFrame:
    """(tree, node, feature, left, right, gain, prediction): a saved model's nodes as a table; ``feature`` is NULL at leaves.

    The model is written to the shared scratch folder (or ``path``) and its
    nodes are read back where Spark keeps them, one row per node.
    """
    spark = SparkSession.getActiveSession()
    folder = path or f"{scratch_path(spark, 'models')}/{uuid.uuid4().hex}"
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data")
    tree = F.col("treeID") if "treeID" in nodes.columns else F.lit(0)
    n = F.col("nodeData") if "nodeData" in nodes.columns else F.struct(*nodes.columns)
    inner = n["leftChild"] >= 0
    return nodes.select(tree.alias("tree"), n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
                        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["gain"].alias("gain"),
                        n["prediction"].alias("prediction"))


def split_counts(model, names: list[str], k: int = 20, path: str | None = None) -> DataFrame:
    """(feature, splits): how many inner nodes of all trees split on each feature, largest first, ties by position.

    Counted over the saved nodes by Spark; one row per feature comes back.
    """
    spark = SparkSession.getActiveSession()
    counts = tree_nodes(model, path).filter(F.col("feature").isNotNull()).groupBy("feature").count().collect()
    values = [0] * max(len(names), 1 + max((r["feature"] for r in counts), default=-1))
    for r in counts:
        values[r["feature"]] = r["count"]
    return _top(spark, values, names, k, "feature string, splits long")
