"""Distributions and correlations: describe, histograms, KDE, box and violin
statistics, 2-D scatter bins and pairwise Pearson correlation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions._util import present
from starlens.operators.enrich import BROADCAST_MAX_ROWS, maybe_broadcast
from starlens.operators.profile import numeric_columns, _unpivot
from starlens.operators.quantiles import SKETCH_K, approx_quantiles, exact_quantiles, exact_quantiles_frame
from starlens.session import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)


# ---------------------------------------------------------------- describe

def describe_numeric(df: DataFrame, cols=None, exact: bool = True) -> DataFrame:
    """``describe()``: (column, count, mean, std, min, p25, p50, p75, max).

    NaN counts as missing, as NULL does.  Moments and a quantile sketch per
    column come from one aggregate pass.  Quartiles are exact by default: the
    columns are unpivoted, the column name is the group key, and one further
    pass reads the quartiles between the brackets that the sketches gave
    (see ``quantiles``); ``exact=False`` takes one approximate-sketch pass.
    """
    cols = list(cols or numeric_columns(df))
    narrow = df.select(*[present(c).alias(f"c{i}") for i, c in enumerate(cols)])
    aggs = []
    for i in range(len(cols)):
        x = F.col(f"c{i}")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if exact:
            aggs.append(F.kll_sketch_agg_double(x, F.lit(SKETCH_K)).alias(f"k{i}"))
    one = narrow.agg(*aggs)
    long = narrow.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("x")) for i, c in enumerate(cols)])))
    names = ["count", "mean", "std", "min", "max"] + ["sketch"] * exact
    moments = _unpivot(one, [(F.lit(c).alias("column_name"),
                              *[F.col(f"{k}{i}").alias(n) for k, n in zip("n m s lo hi k".split(), names)])
                             for i, c in enumerate(cols)])
    if exact:
        moments = cut_lineage(moments)  # one row per column, read by both passes
        stats = moments.select("column_name", F.col("count").alias("n"), F.col("min").alias("mn"), F.col("max").alias("mx"), "sketch")
        q = exact_quantiles_frame(long, "x", QUARTILES, "column_name", stats=stats)
    else:
        q = approx_quantiles(long, "x", QUARTILES, by=["column_name"])
    q = q.groupBy("column_name").pivot("p", list(QUARTILES)).agg(F.first("value"))
    q = q.toDF("column_name", "p25", "p50", "p75")
    return (moments.join(q, "column_name", "left")
            .select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


# ---------------------------------------------------------------- histograms

def _range(df: DataFrame, col: str):
    x = present(col)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    _require_finite(col, r["lo"], r["hi"])
    return r["lo"], r["hi"], r["n"]


def _require_finite(col: str, lo, hi) -> None:
    """Equal-width bins need finite edges."""
    if lo is not None and not (math.isfinite(lo) and math.isfinite(hi)):
        raise ValueError(f"{col}: values range over [{lo}, {hi}], which has no equal-width bins")


def bin_index(col, lo: float, hi: float, bins: int):
    """Equal-width bin of ``col`` over [lo, hi]; the last bin is closed, NaN and NULL have none."""
    x = present(col)
    if hi is None or lo is None or hi <= lo:
        return F.when(x.isNotNull(), F.lit(0))
    # LEAST skips NULLs, so a missing value must not reach it
    return F.when(x.isNotNull(), F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)),
                                         F.lit(bins - 1)).cast("int"))


def histogram(df: DataFrame, col: str, bins: int = 20, drop_if_max_zero: bool = False) -> DataFrame:
    """Equal-width histogram: (bin, bin_lo, bin_hi, count), empty bins kept.

    Bin edges are ``min + i * (max - min) / bins``; min == max gives one bin.
    NaN counts as missing; an infinite edge raises ``ValueError``.
    """
    lo, hi, n = _range(df, col)
    spark = df.sparkSession
    schema = "bin int, bin_lo double, bin_hi double, count long"
    if n == 0 or (drop_if_max_zero and (hi is None or hi == 0)):
        return spark.createDataFrame([], schema)
    nb = bins if hi > lo else 1
    width = (hi - lo) / bins if hi > lo else 0.0
    counts = (df.select(bin_index(col, lo, hi, bins).alias("bin")).filter(F.col("bin").isNotNull())
                .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    domain = spark.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (F.broadcast(domain).join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        F.when(F.col("bin") == nb - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def scatter_bins(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """2-D binned scatter (bounded output instead of every point).

    Pairs with a NULL or NaN side are dropped.  Returns (bin_x, bin_y, x_lo, y_lo, count).
    """
    pairs = df.select(present(x).alias("x"), present(y).alias("y")).dropna()
    r = pairs.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    xlo, xhi, ylo, yhi = r
    _require_finite(x, xlo, xhi)
    _require_finite(y, ylo, yhi)
    if xlo is None:
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, x_lo double, y_lo double, count long")
    wx = (xhi - xlo) / nx if xhi > xlo else 0.0
    wy = (yhi - ylo) / ny if yhi > ylo else 0.0
    return (pairs.select(bin_index("x", xlo, xhi, nx).alias("bin_x"), bin_index("y", ylo, yhi, ny).alias("bin_y"))
            .groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).cast("long").alias("count"))
            .select("bin_x", "bin_y", (F.lit(xlo) + F.col("bin_x") * F.lit(wx)).alias("x_lo"),
                    (F.lit(ylo) + F.col("bin_y") * F.lit(wy)).alias("y_lo"), "count"))


def scatter_pairs(df: DataFrame, xs, y: str, nx: int = 10, ny: int = 10) -> DataFrame:
    """2-D bins of each column of ``xs`` against ``y`` in two scans, however many columns there are.

    (column_name, bin_x, bin_y, x_lo, y_lo, count); a row with a NULL or NaN side is left out of that pair alone, and
    a pair's ranges are those of its own rows.  Infinite values raise, columns without a pair have no rows.
    """
    xs = [c for c in xs if c != y]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), present(c).alias("x"), present(y).alias("y"))
                                        for c in xs]))).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranges = long.groupBy("column_name").agg(F.min("x").alias("xlo"), F.max("x").alias("xhi"), F.min("y").alias("ylo"),
                                             F.max("y").alias("yhi")).collect()  # one row per column
    for r in ranges:
        _require_finite(r["column_name"], r["xlo"], r["xhi"])
        _require_finite(y, r["ylo"], r["yhi"])
    edges = {r["column_name"]: r for r in ranges}

    def place(side: str, n: int):
        out = F.lit(None).cast("struct<bin:int,lo:double>")
        for c, r in edges.items():
            lo, hi = r[f"{side}lo"], r[f"{side}hi"]
            b = bin_index(F.col(side), lo, hi, n)
            width = (hi - lo) / n if hi > lo else 0.0
            out = F.when(F.col("column_name") == c, F.struct(b.alias("bin"), (F.lit(lo) + b * F.lit(width)).alias("lo"))).otherwise(out)
        return out

    return (long.select("column_name", place("x", nx).alias("px"), place("y", ny).alias("py"))
            .groupBy("column_name", "px", "py").agg(F.count(F.lit(1)).alias("count"))
            .select("column_name", F.col("px.bin").alias("bin_x"), F.col("py.bin").alias("bin_y"),
                    F.col("px.lo").alias("x_lo"), F.col("py.lo").alias("y_lo"), "count"))


# ---------------------------------------------------------------- KDE

_SQRT_2PI = math.sqrt(2.0 * math.pi)


def _group_params(df: DataFrame, col: str, by: list[str], points: int, cut: float):
    """(base rows, per-group KDE parameters as a frame: n, Scott bandwidth h,
    min, max, grid start and step).  Groups with one row or no spread have
    no bandwidth and are left out.  The parameters stay in Spark: one row per
    group, never gathered on the driver."""
    base = df.select(*by, present(col).alias("__x")).filter(F.col("__x").isNotNull())
    for b in by:
        base = base.filter(F.col(b).isNotNull())
    stats = base.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("__x").alias("sd"),
                                  F.min("__x").alias("mn"), F.max("__x").alias("mx"))
    h = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    infinite = F.greatest(F.abs("mn"), F.abs("mx")) == F.lit(float("inf"))
    p = stats.withColumn("h", F.when(infinite, F.raise_error(F.lit(f"{col}: infinite values have no density"))).otherwise(h))
    p = p.filter(F.col("h").isNotNull() & (F.col("h") > 0))
    lo, hi = F.col("mn") - F.lit(cut) * F.col("h"), F.col("mx") + F.lit(cut) * F.col("h")
    return base, p.select(*by, "n", "h", "mn", "mx", lo.alias("glo"), ((hi - lo) / F.lit(points - 1)).alias("gstep"))


def kde_grid(df: DataFrame, col: str, points: int = 200, bins: int = 1024, cut: float = 3.0,
             by=None) -> DataFrame:
    """Gaussian KDE on a fixed grid, Scott bandwidth ``sd * n^(-1/5)``.

    The data are first reduced to ``bins`` equal-width bins (count and mean
    per bin, a partial/final aggregate).  A group's bins, ``bins`` at most,
    then stand in one array, and the kernel is summed over it for each grid
    point inside the row: no row per bin and grid point, work after the first
    aggregate independent of the row count.  Grid spans
    [min - cut*h, max + cut*h].  Returns (by..., i, x, density).

    NaN counts as missing; a column or group with an infinite value raises.
    With groups, the parameter rows (one per group) are joined back on the
    keys -- broadcast behind the size check, else a shuffle join.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    spark = df.sparkSession
    base, ptab = _group_params(df, col, by, points, cut)
    if by:
        tagged = base.join(maybe_broadcast(ptab, BROADCAST_MAX_ROWS), by, "inner")
    else:
        one = ptab.first()  # the single parameter row of the whole column
        if one is None:
            return spark.createDataFrame([], "i int, x double, density double")
        tagged = base.select("__x", *[F.lit(float(one[k])).alias(k) for k in ("n", "h", "mn", "mx", "glo", "gstep")])
    fine = F.least(F.floor((F.col("__x") - F.col("mn")) / (F.col("mx") - F.col("mn")) * F.lit(bins)),
                   F.lit(bins - 1)).cast("int")
    params = ("n", "h", "glo", "gstep")
    binned = (tagged.withColumn("__b", F.when(F.col("mx") > F.col("mn"), fine).otherwise(F.lit(0)))
              .groupBy(*by, "__b", *params).agg(F.count(F.lit(1)).alias("cnt"), F.avg("__x").alias("c")))
    # at most ``bins`` entries a group, in bin order so that sums do not depend on the shuffle
    rows = binned.groupBy(*by, *params).agg(F.sort_array(F.collect_list(F.struct("__b", "cnt", "c"))).alias("held"))
    h = F.col("h")

    def density(i):
        x = F.col("glo") + i * F.col("gstep")

        def add(acc, b):
            z = (x - b["c"]) / h
            return acc + b["cnt"] * F.exp(F.lit(-0.5) * z * z)
        return F.aggregate("held", F.lit(0.0), add) / (F.col("n") * h * F.lit(_SQRT_2PI))

    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(
        i.cast("int").alias("i"), (F.col("glo") + i * F.col("gstep")).alias("x"), density(i).alias("density")))
    return rows.select(*by, F.inline(curve))


# ---------------------------------------------------------------- box / violin

def _quartile_frame(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """(by..., q1, median, q3) per group, exact; any number of groups."""
    q = exact_quantiles(df, col, QUARTILES, by=by)
    wide = q.groupBy(*by).pivot("p", list(QUARTILES)).agg(F.first("value"))
    return wide.select(*by, *[F.col(f"`{p}`").alias(n) for p, n in zip(QUARTILES, ("q1", "median", "q3"))])


def box_stats(df: DataFrame, col: str, by=None, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers: q1, median, q3, fences, whiskers and outlier count.

    Whiskers are the furthest data inside the fences q1 - 1.5 IQR and
    q3 + 1.5 IQR.  Quartiles are exact (see ``quantiles``); the second pass
    joins the per-group fences (one row per group, size-checked broadcast)
    back to the data.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    iqr = F.col("q3") - F.col("q1")
    fences = (_quartile_frame(df, col, by).filter(F.col("q1").isNotNull())
              .select(*by, "q1", "median", "q3", iqr.alias("iqr"),
                      (F.col("q1") - F.lit(whisker) * iqr).alias("lower_fence"),
                      (F.col("q3") + F.lit(whisker) * iqr).alias("upper_fence")))
    names = ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")
    data = df.select(*by, present(col).alias("__x")).filter(F.col("__x").isNotNull())
    for b in by:
        data = data.filter(F.col(b).isNotNull())
    if by:
        tagged = data.join(maybe_broadcast(fences, BROADCAST_MAX_ROWS), by, "inner")
    else:
        r = fences.first()  # the single row of the whole column
        tagged = data.select("__x", *[F.lit(None if r is None else r[k]).cast("double").alias(k) for k in names])
    inside = (F.col("__x") >= F.col("lower_fence")) & (F.col("__x") <= F.col("upper_fence"))
    keys = by + list(names)
    return tagged.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("__x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_hi"),
        F.count_if(~inside).cast("long").alias("n_outliers"),
        F.count(F.lit(1)).cast("long").alias("n"))


def violin(df: DataFrame, col: str, by, points: int = 50, bins: int = 256) -> DataFrame:
    """Per-group violin data: KDE curve rows with the group's quartiles."""
    by = [by] if isinstance(by, str) else list(by)
    curve = kde_grid(df, col, points=points, bins=bins, by=by)
    q = _quartile_frame(df, col, by)
    return curve.join(maybe_broadcast(q, BROADCAST_MAX_ROWS), by, "inner")


# ---------------------------------------------------------------- correlation

def _pair_sums(narrow: DataFrame, shifts: list[float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) over the rows where columns i and j are both present, i <= j.

    Each task keeps one Gram matrix of the shifted values, their squares and
    the presence flags, so a pass costs the same plan for any number of
    columns, and a task sends one row per pair.
    """
    c = len(shifts)
    up = np.triu_indices(c)

    def run(batches):
        gram = np.zeros((3 * c, 3 * c))
        for b in batches:
            x = np.stack([col.to_numpy(zero_copy_only=False).astype(np.float64) for col in b.columns], axis=1) - shifts
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            z = np.concatenate([x, x * x, there], axis=1)
            gram += z.T @ z
        xs, sq, n = (slice(k * c, (k + 1) * c) for k in range(3))
        held = [gram[n, n], gram[xs, n], gram[n, xs], gram[sq, n], gram[n, sq], gram[xs, xs]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), *[pa.array(m[up], pa.float64()) for m in held]],
            ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = narrow.mapInArrow(run, "i int, j int, " + ", ".join(f"{k} double" for k in names))
    return parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])


def corr_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Long correlation matrix (col_a, col_b, r) with pairwise deletion.

    One scan for any number of columns: pairwise-complete sums as Gram
    matrices per task, added up per pair.  Values are shifted by one present
    value of their column, so that the sums keep their digits.  The diagonal
    is exactly 1 for columns with spread; r is NULL where a side is constant
    or infinite, and within [-1, 1] otherwise.
    """
    cols = list(cols or numeric_columns(df))
    narrow = df.select(*[present(c).alias(f"c{i}") for i, c in enumerate(cols)])
    head = narrow.limit(1000).agg(*[F.first(c, ignorenulls=True).alias(c) for c in narrow.columns]).first()
    shifts = [v if v is not None and math.isfinite(v) else 0.0 for v in head]
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * mx, F.col("syy") - F.col("sy") * my
    # beyond the rounding of the sums
    spread = (vx > F.col("sxx") * F.lit(1e-13)) & (vy > F.col("syy") * F.lit(1e-13)) & (vx + vy < F.lit(float("inf")))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("sxy") - F.col("sx") * my) / F.sqrt(vx * vy))))
    name = lambda i: F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(i) + 1)
    pairs = (_pair_sums(narrow, shifts).withColumn("n", F.nullif("n", F.lit(0.0)))
             .select("i", "j", name("i").alias("a"), name("j").alias("b"), F.when(spread, r).alias("r")))
    mirrored = F.array(F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "r"),
                       F.struct(F.col("b").alias("col_a"), F.col("a").alias("col_b"), "r"))
    return pairs.select(F.inline(F.slice(mirrored, 1, F.when(F.col("i") == F.col("j"), 1).otherwise(2))))


def corr_with_target(df: DataFrame, cols, target: str) -> DataFrame:
    """Correlation of each column with ``target``, largest first, target excluded.

    Rows where either side is missing do not count; r is NULL for a constant side.
    """
    cols = [c for c in cols if c != target]
    narrow = df.select(present(target).alias("t"), *[present(c).alias(f"c{i}") for i, c in enumerate(cols)])
    one = narrow.agg(*[F.corr(f"c{i}", "t").alias(f"r{i}") for i in range(len(cols))])
    # LEAST and GREATEST skip NULLs, so a missing r must not reach them
    clean = lambda r: F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return (_unpivot(one, [(F.lit(c).alias("column_name"), clean(F.col(f"r{i}")).alias("r")) for i, c in enumerate(cols)])
            .orderBy(F.col("r").desc_nulls_last(), "column_name"))
