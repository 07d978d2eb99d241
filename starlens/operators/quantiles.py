"""Exact quantiles without gathering a column or a group into one task.

Spark's exact ``percentile`` keeps a value -> count map per group and merges
it in one task, which does not survive a hot group or a continuous column
at scale.  Here a mergeable sketch, taken in the pass that also counts the
groups, brackets each wanted order statistic, and one further pass counts the
rows below the bracket and the values inside it.  Brackets with more than
``leaf_rows`` rows, and the rare rank outside its bracket, are narrowed by
repeated equal-width histograms.  Every pass is an ordinary partial / final
aggregate, and every window runs over one bracket's summary rows.

Interpolation is linear between the two neighbouring order statistics
(pandas / numpy default; DuckDB ``quantile_cont``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions._util import present

#: Size of the sketch per group: a rank error of about 2.296 / k^0.9021, both sides.
SKETCH_K = 1000
#: Groups of up to so many rows are counted whole: their sketch is no smaller.
SMALL_GROUP = 10_000


def _clean(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    base = df.select(*by, present(col).alias("__x")).filter(F.col("__x").isNotNull())
    for b in by:
        base = base.filter(F.col(b).isNotNull())
    return base


def sketched_stats(base: DataFrame, by: list[str], sketch_k: int = SKETCH_K) -> DataFrame:
    """(by..., n, mn, mx, sketch) of ``__x``: one partial / final aggregate; the sketches merge."""
    return base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("mn"), F.max("__x").alias("mx"),
                                 F.kll_sketch_agg_double("__x", F.lit(sketch_k)).alias("sketch"))


def _bracketed(stats: DataFrame, by: list[str], probs: list[float], sketch_k: int, leaf_rows: int) -> DataFrame:
    """Per group and probability: its two order statistics k0, k1, the weight of the second and their bracket."""
    eps = 3 * 2.296 / sketch_k ** 0.9021
    marks = F.array(*[F.struct(F.lit(p).alias("p"),
                               F.kll_sketch_get_quantile_double("sketch", F.lit(max(0.0, p - eps))).alias("a"),
                               F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, p + eps))).alias("b"))
                      for p in probs])
    rows = stats.filter(F.col("n") > 0).select(*by, "n", "mn", "mx", F.inline(marks))
    h = F.col("p") * (F.col("n") - F.lit(1))
    small = F.col("n") <= SMALL_GROUP
    return (rows.withColumn("k0", F.floor(h).cast("long"))
            .withColumn("k1", F.least(F.col("k0") + F.lit(1), F.col("n") - F.lit(1)))
            .withColumn("frac", h - F.col("k0"))
            .withColumn("lo", F.when(small | (F.col("p") <= eps), F.col("mn")).otherwise(F.col("a")))
            .withColumn("hi", F.when(small | (F.col("p") >= 1 - eps), F.col("mx")).otherwise(F.col("b")))
            .withColumn("big", F.col("n") * F.lit(2 * eps) > F.lit(leaf_rows)).drop("a", "b"))


def exact_quantiles_frame(df: DataFrame, col: str, probs, by, bins: int = 2048, leaf_rows: int = 2_000_000,
                          sketch_k: int = SKETCH_K, stats: DataFrame | None = None) -> DataFrame:
    """Exact grouped quantiles for any number of groups: (by..., p, value).

    Pass 1 (saved when the caller has ``stats``, see :func:`sketched_stats`)
    takes each group's count, minimum, maximum and sketch.  Pass 2 counts, per
    bracket, the rows below it in one counter and the distinct values inside;
    a running count over these reads the order statistics off.  The sketch
    only chooses brackets: results are exact whatever it says, since a rank
    outside its bracket shows in the counts and is searched over the whole
    range.  Open ranks are a checkpointed frame; nothing is gathered on the
    driver but an "any open?" probe.
    """
    from starlens.operators.enrich import BROADCAST_MAX_ROWS, maybe_broadcast
    from starlens.session import cut_lineage
    by = [by] if isinstance(by, str) else list(by)
    probs = [float(p) for p in probs]
    base = _clean(df, col, by)
    per_p = cut_lineage(_bracketed(stats if stats is not None else sketched_stats(base, by, sketch_k),
                                   by, probs, sketch_k, leaf_rows))
    known = (F.when(F.col("k") == 0, F.col("mn")).when(F.col("k") == F.col("n") - 1, F.col("mx"))
              .when(F.col("mn") == F.col("mx"), F.col("mn")))
    ranks = (per_p.withColumn("k", F.explode(F.array_distinct(F.array("k0", "k1"))))
             .select(*by, "p", "k", "n", "mn", "mx", "lo", "hi", "big", known.alias("known")))
    ikeys = by + ["lo", "hi"]
    open_ = ranks.filter(F.col("known").isNull())
    tagged = (base.join(maybe_broadcast(open_.select(*ikeys, "big").distinct(), BROADCAST_MAX_ROWS), by, "inner")
              .filter(F.col("__x") <= F.col("hi")))
    # NULL counts all rows below the bracket; of a large bracket only the number of rows is wanted
    v = F.when(F.col("__x") >= F.col("lo"), F.when(F.col("big"), F.col("lo")).otherwise(F.col("__x")))
    inside = tagged.withColumn("v", v).groupBy(*ikeys, "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*ikeys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = (inside.withColumn("cum", F.sum("c").over(w)).withColumn("below", F.col("cum") - F.col("c"))
           .filter(F.col("v").isNotNull()))
    hit = (open_.join(run, ikeys).filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("cum")))
           .select(*by, "p", "k", F.when(~F.col("big"), F.col("v")).alias("value"), "below", "c"))
    found = cut_lineage(ranks.join(hit, by + ["p", "k"], "left")
                        .withColumn("value", F.coalesce("known", "value")))
    values = found.filter(F.col("value").isNotNull()).select(*by, "p", "k", "value")
    missed = found.filter(F.col("value").isNull())
    if missed.limit(1).count():
        inside = F.col("below").isNotNull()
        low = F.when(inside, F.col("lo")).otherwise(F.col("mn"))
        high = F.when(inside, F.col("hi")).otherwise(F.col("mx"))
        state = missed.select(*by, "p", "k", low.alias("lo"), high.alias("hi"), F.coalesce("below", F.lit(0)).cast("long").alias("below"),
                              F.coalesce("c", "n").alias("cnt"), F.when(low == high, low).alias("value"))
        values = values.unionByName(_narrowed(base, state, by, bins, min(leaf_rows, 20000)))
    v0 = values.select(*by, "p", F.col("k").alias("k0"), F.col("value").alias("v0"))
    v1 = values.select(*by, "p", F.col("k").alias("k1"), F.col("value").alias("v1"))
    out = per_p.join(v0, by + ["p", "k0"], "inner").join(v1, by + ["p", "k1"], "inner")
    return out.select(*by, "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("value"))


def _narrowed(base: DataFrame, state: DataFrame, by: list[str], bins: int, leaf_rows: int,
              max_passes: int = 200) -> DataFrame:
    """(by..., p, k, value) of open ranks, each with an interval [lo, hi], the rows below it and those inside.

    A pass joins the rows to their group's open intervals, summarises each
    interval -- ``bins`` equal-width bins, or its distinct values once it
    holds at most ``leaf_rows`` rows -- and a running count per interval
    (a window over at most ``bins`` / ``leaf_rows`` summary rows) finds the
    summary row holding each rank, until that row is a single value.
    """
    from starlens.operators.enrich import BROADCAST_MAX_ROWS, maybe_broadcast
    from starlens.session import cut_lineage
    ikeys = by + ["lo", "hi"]
    state = cut_lineage(state)
    for _ in range(max_passes):
        open_ = state.filter(F.col("value").isNull())
        if open_.limit(1).count() == 0:
            return state.select(*by, "p", "k", "value")
        intervals = open_.select(*ikeys, (F.col("cnt") <= F.lit(leaf_rows)).alias("leaf")).distinct()
        tagged = (base.join(maybe_broadcast(intervals, BROADCAST_MAX_ROWS), by, "inner")
                      .filter((F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi"))))
        bin_ = F.least(F.floor((F.col("__x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins)),
                       F.lit(bins - 1)).cast("double")
        summary = (tagged.withColumn("ord", F.when(F.col("leaf"), F.col("__x")).otherwise(bin_))
                         .groupBy(*ikeys, "ord")
                         .agg(F.count(F.lit(1)).alias("c"), F.min("__x").alias("a"), F.max("__x").alias("b")))
        w = Window.partitionBy(*ikeys).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = summary.withColumn("cum", F.sum("c").over(w)).withColumn("before", F.col("cum") - F.col("c"))
        rel = F.col("k") - F.col("below")
        hit = (open_.join(run, ikeys, "inner")
                    .filter((F.col("before") <= rel) & (rel < F.col("cum")))
                    .select(*by, "p", "k", F.col("a").alias("lo"), F.col("b").alias("hi"),
                            (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("cnt"),
                            F.when(F.col("a") == F.col("b"), F.col("a")).alias("value")))
        state = cut_lineage(state.filter(F.col("value").isNotNull()).unionByName(hit))
    raise RuntimeError("quantile search did not converge")


def exact_quantiles(df: DataFrame, col: str, probs, by=None, **kw) -> DataFrame:
    """(by..., p, value) with exact linear-interpolated quantiles; a whole column without values has NULLs."""
    by_l = [by] if isinstance(by, str) else list(by or [])
    if by_l:
        return exact_quantiles_frame(df, col, probs, by_l, **kw)
    found = exact_quantiles_frame(df.select(F.lit(0).alias("__all"), present(col).alias("__v")), "__v", probs, "__all", **kw)
    asked = df.sparkSession.createDataFrame([(float(p),) for p in probs], "p double")
    return asked.join(F.broadcast(found.drop("__all")), "p", "left")


def quantile_values(df: DataFrame, col: str, probs, by=None, **kw) -> dict:
    """{group_key_tuple: {"n":, "min":, "max":, "q": [value per prob]}}, for groups that are few by nature."""
    by = [by] if isinstance(by, str) else list(by or [])
    probs = [float(p) for p in probs]
    stats = _clean(df, col, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("mn"), F.max("__x").alias("mx"))
    out = {tuple(r[b] for b in by): {"n": r["n"], "min": r["mn"], "max": r["mx"], "q": [None] * len(probs)}
           for r in stats.collect()}
    for r in exact_quantiles(df, col, probs, by, **kw).collect():
        q = out[tuple(r[b] for b in by)]["q"]
        for i, p in enumerate(probs):
            if p == r["p"]:
                q[i] = r["value"]
    return out


def approx_quantiles(df: DataFrame, col: str, probs, by=None, accuracy: int = 10000) -> DataFrame:
    """One-pass approximate quantiles (bounded GK sketch per group)."""
    by_l = [by] if isinstance(by, str) else list(by or [])
    base = _clean(df, col, by_l)
    agg = base.groupBy(*by_l).agg(
        F.percentile_approx("__x", [float(p) for p in probs], accuracy).alias("__q"))
    pa = F.array(*[F.lit(float(p)) for p in probs])
    return agg.select(*by_l, F.inline(F.arrays_zip(pa.alias("p"), F.col("__q").alias("value"))))
