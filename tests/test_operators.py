"""Operators on small inline frames (edge cases) and property checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.operators import checkins as ck
from starlens.operators import enrich as en
from starlens.operators import features as fe
from starlens.operators import profile as pf
from starlens.operators import stats as st
from starlens.operators import words as wd
from starlens.operators.quantiles import quantile_values
from starlens.operators.scale import PopulationScaler
from starlens.operators.split import hash_split


def test_packed_checkins(spark):
    df = spark.createDataFrame([("b1", "2016-04-26 19:49:16, 2016-08-30 18:36:57")], "business_id string, date string")
    rows = ck.explode_timestamps(df, "date")
    wd_ = ck.count_by_time_part(rows, "ts", "weekday").filter("n > 0").collect()
    assert [(r["weekday"], r["n"], r["day_name"]) for r in wd_] == [(1, 2, "Tuesday")]
    hrs = {r["hour"]: r["n"] for r in ck.count_by_time_part(rows, "ts", "hour").collect()}
    assert len(hrs) == 24 and hrs[19] == 1 and hrs[18] == 1 and hrs[0] == 0


def test_top_k_ties_key_ascending(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "k string, n long")
    assert [r["k"] for r in ck.top_k(df, "n", 3, ["k"]).collect()] == ["c", "a", "b"]


def test_duplicates_null_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "x string, y int")
    r = {row["is_duplicate"]: row["n_rows"] for row in pf.duplicate_report(df).collect()}
    assert r == {True: 2, False: 1}


def test_null_report_nan_counts(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y")], "a double, b string")
    r = {row["column_name"]: row["null_count"] for row in pf.null_report(df).collect()}
    assert r == {"a": 2, "b": 1}


def test_downcast_strict_limits(spark):
    df = spark.createDataFrame([(-128, 1, 1.5), (5, 200, 2.5)], "a int, b int, c double")
    rep = {r["column_name"]: r["to_type"] for r in pf.downcast_plan(df).collect()}
    assert rep == {"a": "short", "b": "short", "c": "float"}
    out, _ = pf.downcast(df)
    assert dict(out.dtypes) == {"a": "smallint", "b": "smallint", "c": "float"}


def test_quartiles_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    q = quantile_values(df, "x", [0.25, 0.5, 0.75])[()]["q"]
    assert q == [1.75, 3.0, 5.5]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.exponential(size=500) * 1e6])
    groups = rng.integers(0, 3, size=len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = quantile_values(df, "x", probs, by="g", bins=16, leaf_rows=50)
    for g in range(3):
        exp = np.quantile(vals[groups == g], probs)
        assert got[(g,)]["q"] == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_exact_grouped_quantiles_match_numpy(spark):
    from starlens.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=2000), np.full(800, 0.25), rng.exponential(size=300) * 1e6, [7.0]])
    groups = np.concatenate([rng.integers(0, 5, size=len(vals) - 1), [9]])   # group 9 has one row
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in
           exact_quantiles(df, "x", probs, "g", bins=16, leaf_rows=50).collect()}
    for g in sorted(set(groups)):
        exp = np.quantile(vals[groups == g], probs)
        assert [got[(int(g), p)] for p in probs] == pytest.approx(list(exp), rel=1e-12, abs=1e-12)


def test_box_stats_of_groups_equal_those_of_whole_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, size=1500), rng.standard_t(3, size=1500))]
    df = spark.createDataFrame(rows, "g int, x double")
    grouped = {r["g"]: r.asDict() for r in st.box_stats(df, "x", by="g").collect()}
    assert sorted(grouped) == [0, 1, 2, 3]
    for g, row in grouped.items():
        alone = st.box_stats(df.filter(F.col("g") == g), "x").first().asDict()
        assert row == alone | {"g": g}


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    r = {(x["col_a"], x["col_b"]): x["r"] for x in st.corr_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] is None and r[("b", "b")] == pytest.approx(1.0)


def test_correlation_pairwise_deletion(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.3)], "a double, b double")
    r = st.corr_with_target(df, ["a"], "b").first()["r"]
    exp = np.corrcoef([1, 2, 4], [2, 4.1, 8.3])[0, 1]
    assert r == pytest.approx(exp)


def test_histogram_sums_to_n(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=500)], "x double")
    h = st.histogram(df, "x", 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 500
    exp, _ = np.histogram([r[0] for r in df.collect()], bins=30)
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == list(exp)


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(x),) for x in rng.normal(size=400)], "x double")
    k = sorted(st.kde_grid(df, "x", points=200).collect(), key=lambda r: r["i"])
    step = k[1]["x"] - k[0]["x"]
    assert sum(r["density"] for r in k) * step == pytest.approx(1.0, abs=0.02)


def test_box_stats_whiskers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 100]], "x double")
    r = st.box_stats(df, "x").first()
    assert r["n_outliers"] == 1 and r["whisker_hi"] == 5.0 and r["whisker_lo"] == 1.0


def test_enrich_left_keeps_facts_and_null_safe(spark):
    fact = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    dim = spark.createDataFrame([(1, "x"), (None, "y")], "k int, w string")
    assert fact.transform(lambda f: en.enrich(f, dim, "k")).count() == 3
    ns = {r["v"]: r["w"] for r in en.enrich(fact, dim, "k", null_safe=True).collect()}
    assert ns == {"a": "x", "b": "y", "c": None}
    with pytest.raises(ValueError):
        en.enrich(fact, dim.unionByName(dim), "k", check_unique=True)


def test_broadcast_needs_row_and_byte_bound(spark):
    df = spark.createDataFrame([("ab" * 50, [1.0, 2.0], 1), (None, None, 2)], "s string, a array<double>, i int")
    sizes = [r[0] for r in df.select(en.row_bytes(df)).collect()]
    assert sizes[0] > 100 + 16 and sizes[1] < sizes[0]
    assert en.bounded_size(df, 10)
    assert not en.bounded_size(df, 1)              # too many rows
    assert not en.bounded_size(df, 10, max_bytes=100)  # too many bytes
    plan = en.maybe_broadcast(df, 10, max_bytes=100)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in plan


def test_sorted_positions_match_row_number(spark):
    from pyspark.sql import Window
    from starlens.operators.rank import sorted_positions
    rng = np.random.default_rng(7)
    n = 3000
    cnt = np.where(np.arange(n) % 3 == 0, 1, rng.integers(1, 50, size=n))  # a third share one value
    df = spark.createDataFrame([(f"w{i:05d}", int(c)) for i, c in enumerate(cnt)], "word string, cnt long").repartition(7)
    order = [F.desc("cnt"), F.asc("word")]
    got = {r["word"]: r["pos"] for r in sorted_positions(df, order, "pos").collect()}
    exp = {r["word"]: r["pos"] for r in df.select("word", (F.row_number().over(Window.orderBy(*order)) - 1)
                                                  .alias("pos")).collect()}
    assert got == exp and sorted(got.values()) == list(range(n))


def test_drop_strict_raises_on_missing(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert en.drop_strict(df, ["a"]).columns == ["b"]
    with pytest.raises(KeyError):
        en.drop_strict(df, ["a", "zz"])


def test_describe_approx_close_to_exact(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(size=4000)
    df = spark.createDataFrame([(float(v), float(v) * 2) for v in vals], "x double, y double")
    ex = {r["column_name"]: r for r in st.describe_numeric(df, ["x", "y"]).collect()}
    ap = {r["column_name"]: r for r in st.describe_numeric(df, ["x", "y"], exact=False).collect()}
    assert ex["x"]["p50"] == pytest.approx(float(np.quantile(vals, 0.5)), abs=1e-12)
    for c in ("x", "y"):
        for p in ("p25", "p50", "p75"):
            assert ap[c][p] == pytest.approx(ex[c][p], abs=0.01 * (ex[c]["max"] - ex[c]["min"]))


def test_non_null_count_per_key_and_top(spark):
    df = spark.createDataFrame([("u1", 5.0), ("u1", None), ("u2", 3.0), ("u2", 4.0), (None, 1.0), ("u3", None)],
                               "u string, s double")
    got = {r["u"]: r["count_s"] for r in en.count_non_null_by(df, "u", "s").collect()}
    assert got == {"u1": 1, "u2": 2, "u3": 0}            # NULL key dropped, NULL values not counted
    top = [(r["u"], r["n"]) for r in en.top_keys(df, "u", 2, count_col="s").collect()]
    assert top == [("u2", 2), ("u1", 1)]


def test_describe_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,), (4.0,), (10.0,)], "x double")
    r = st.describe_numeric(df, ["x"]).first()
    assert r["count"] == 4 and r["mean"] == pytest.approx(4.25)
    assert (r["min"], r["max"]) == (1.0, 10.0)
    assert [r["p25"], r["p50"], r["p75"]] == [1.75, 3.0, 5.5]
    empty = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    e = st.describe_numeric(empty, ["x"]).first()
    assert e["count"] == 0 and e["mean"] is None and e["p50"] is None


def test_sum_by_all_null_is_zero(spark):
    df = spark.createDataFrame([("u", None), ("v", 2)], "k string, x int")
    assert {r["k"]: r["s"] for r in en.sum_by(df, "k", "x", "s").collect()} == {"u": 0, "v": 2}


def test_good_bad_null_rating(spark):
    df = spark.createDataFrame([("great food", 4.0), ("bad food", 3.0), ("odd", None)], "text string, stars double")
    r = wd.cloud_weights(df, "text", "stars", cut=3, k=10).collect()
    sides = {(x["side"], x["word"]) for x in r}
    assert ("good", "great") in sides and ("bad", "bad") in sides and all(x["word"] != "odd" for x in r)


def test_word_counts_stopwords(spark):
    df = spark.createDataFrame([("The cat and THE dog",)], "text string")
    r = {x["word"]: x["cnt"] for x in wd.word_counts(df, "text", stop_words=["the", "and"]).collect()}
    assert r == {"cat": 1, "dog": 1}


def test_onehot_drop_first(spark):
    df = spark.createDataFrame([("CA",), ("AZ",), ("NV",), (None,)], "state string")
    m = fe.DropFirstOneHot("state", "state_").fit(df)
    rows = m.transform(df).collect()
    assert m.output_cols == ["state_CA", "state_NV"]
    assert [(r["state_CA"], r["state_NV"]) for r in rows] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_mean_imputer(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    out = fe.MeanImputer(["x"]).fit(df).transform(df)
    assert [r[0] for r in out.collect()] == [1.0, 2.0, 2.0, 3.0]


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    out = PopulationScaler(["x", "c"]).fit(df).transform(df).collect()
    assert [(r["x"], r["c"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_hash_split_disjoint_cover_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in hash_split(df, "k").collect()}
    b = {r["k"]: r["split"] for r in hash_split(df.repartition(16), "k").collect()}
    assert a == b and len(a) == 5000
    frac = sum(1 for v in a.values() if v == "train") / 5000
    assert 0.66 < frac < 0.74


def test_results_invariant_under_repartition(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = sorted(st.corr_matrix(li, ["l_quantity", "l_tax"]).collect())
    b = sorted(st.corr_matrix(li.repartition(16), ["l_quantity", "l_tax"]).collect())
    for x, y in zip(a, b):
        assert x["r"] == pytest.approx(y["r"], rel=1e-9)
    assert math.isclose(sum(r["count"] for r in st.histogram(li.repartition(7), "l_quantity", 50).collect()),
                        li.count())
