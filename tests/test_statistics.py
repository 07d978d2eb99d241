"""Quantiles from brackets, Gram correlations, densities, scatter bins of many columns, leave-one-out means, CSV types."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starlens.operators import enrich as en
from starlens.operators import features as fe
from starlens.operators import quantiles as qs
from starlens.operators import stats as st
from starlens.sources import io


@pytest.mark.parametrize("leaf_rows", [2_000_000, 40])
def test_bracketed_quantiles_are_exact(spark, leaf_rows, monkeypatch):
    """Large groups with coarse sketches, so that brackets are real; with ``leaf_rows`` of 40 they are narrowed."""
    monkeypatch.setattr(qs, "SMALL_GROUP", 100)
    rng = np.random.default_rng(8)
    data = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 3000).astype(float), "one": np.array([4.0]),
            "two": np.array([1.0, 2.0]), "heavy": np.concatenate([np.full(2000, 7.0), rng.exponential(1e6, 1000)])}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + [("one", None), ("one", float("nan")), (None, 1.0)],
                               "g string, x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in qs.exact_quantiles(df, "x", probs, "g", sketch_k=60, leaf_rows=leaf_rows, bins=8).collect()}
    assert len(got) == len(data) * len(probs)
    for k, v in data.items():
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_a_wrong_sketch_changes_nothing(spark, monkeypatch):
    """Brackets that miss their ranks show in the counts."""
    monkeypatch.setattr(qs, "SMALL_GROUP", 10)
    x = np.random.default_rng(1).normal(size=2000)
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    base = qs._clean(df, "x", ["g"])
    wrong = qs.sketched_stats(base, ["g"]).withColumn("sketch", F.lit(
        qs.sketched_stats(base.withColumn("__x", F.col("__x") / 1000 - 1), ["g"]).first()["sketch"]))
    got = {r["p"]: r["value"] for r in qs.exact_quantiles_frame(df, "x", [0.2, 0.9], "g", stats=wrong).collect()}
    assert got == {p: pytest.approx(np.quantile(x, p)) for p in (0.2, 0.9)}


def test_quantiles_without_values(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert [tuple(r) for r in qs.exact_quantiles(none, "x", [0.5]).collect()] == [(0.5, None)]


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6))
    x = base @ rng.normal(size=(6, 200)) + rng.normal(size=(300, 200)) + 1e6
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 3.25
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(200)])
    df = spark.createDataFrame(pdf)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in st.corr_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == 200 * 200 and got["c.7", "c.7"] is None and got["c.7", "c.1"] is None
    for i in range(0, 200, 9):
        for j in range(200):
            if 7 not in (i, j):
                assert got[f"c.{i}", f"c.{j}"] == pytest.approx(want.iloc[i, j], abs=1e-7)
    assert all(got[c, c] == 1.0 for c in pdf.columns if c != "c.7") and all(r is None or -1 <= r <= 1 for r in got.values())


def test_correlation_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, float("inf"), None), (2.0, 1.0, None), (3.0, 2.0, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in st.corr_matrix(df).collect()}
    assert got["a", "a"] == 1.0 and got["a", "b"] is None and got["a", "c"] is None and got["c", "c"] is None
    target = {r["column_name"]: r["r"] for r in st.corr_with_target(df, ["a", "b", "c"], "a").collect()}
    assert target["c"] is None and set(target) == {"b", "c"}


def test_density_of_groups_and_infinite_values(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(v)) for v in rng.normal(size=400)] + [("b", float(v)) for v in rng.normal(5, 2, 300)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    grid = st.kde_grid(df, "x", points=50, bins=4096, by="g").toPandas()
    assert set(grid["g"]) == {"a", "b"} and len(grid) == 100
    x = np.array([v for g, v in rows if g == "b"])
    h = x.std(ddof=1) * len(x) ** -0.2
    b = grid[grid["g"] == "b"].sort_values("i")
    exact = np.exp(-0.5 * ((b["x"].to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.abs(b["density"].to_numpy() - exact).max() < 1e-5
    with pytest.raises(Exception, match="infinite values"):
        st.kde_grid(spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "x double"), "x").collect()


def test_scatter_of_many_columns_equals_one_by_one(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), None if i % 7 == 0 else float(b), 2.0, float("nan") if i % 5 == 0 else float(y))
                                for i, (a, b, y) in enumerate(rng.normal(size=(200, 3)))], "a double, b double, k double, y double")
    got = {tuple(r) for r in st.scatter_pairs(df, ["a", "b", "k", "y"], "y", 4, 3).collect()}
    want = {(c, *r) for c in "abk" for r in st.scatter_bins(df, c, "y", 4, 3).collect()}
    assert got == want
    assert st.scatter_pairs(df.limit(0), ["a"], "y").count() == 0


def test_leave_one_out_means(spark):
    rows = [("u", 1.0, 0), ("u", 3.0, 1), ("u", None, 1), ("v", 5.0, 0), (None, 2.0, 0), (None, 4.0, 1), ("w", float("nan"), 0)]
    df = spark.createDataFrame(rows, "user string, y double, fold int")
    got = [r["m"] for r in fe.leave_one_out_mean(df.coalesce(1), "user", "y", "m").orderBy("user", "y", "fold").collect()]
    # order: NULL user (2, 4), u (NULL, 1, 3), v, w
    assert got == [4.0, 2.0, 2.0, 3.0, 1.0, None, None]
    fold = {(r["user"], r["y"]): r["m"] for r in fe.leave_one_out_mean(df.filter("y is not null"), "user", "y", "m", fold_col="fold").collect()}
    assert fold["u", 1.0] == 3.0 and fold["u", 3.0] == 1.0 and fold["v", 5.0] is None and fold[None, 2.0] == 4.0
    smooth = {(r["user"], r["y"]): r["m"] for r in fe.leave_one_out_mean(df.filter("y is not null"), "user", "y", "m", smoothing=2.0).collect()}
    assert smooth["v", 5.0] == 3.0 and smooth["u", 1.0] == pytest.approx((3 + 2 * 3) / 3)


def test_leave_one_out_mean_with_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("a.user"),
                                    (F.col("id") % 11).cast("double").alias("y"), "id")
    out = fe.leave_one_out_mean(df, "a.user", "y", "m")
    assert out.columns == ["a.user", "y", "id", "m"] and out.count() == 20_000
    pdf = df.toPandas()
    g = pdf.groupby("a.user")["y"]
    want = dict(zip(pdf["id"], (g.transform("sum") - pdf["y"]) / (g.transform("count") - 1)))
    assert all(r["m"] == pytest.approx(want[r["id"]]) for r in out.select("id", "m").collect())


def test_lookup_splits_hot_keys(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 100 == 1, F.lit(None))
                                    .otherwise(F.concat(F.lit("k"), F.col("id") % 800)).alias("word"), "id")
    table = spark.range(700).select(F.concat(F.lit("k"), "id").alias("word"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "word string, v long"))
    for how in ("inner", "left"):
        want = sorted(tuple(r) for r in rows.join(table, "word", how).select("id", F.coalesce("v", F.lit(-9))).collect())
        split = en.lookup(rows, table, "word", how, max_rows=None, hot_share=0.01)
        assert sorted(tuple(r) for r in split.select("id", F.coalesce("v", F.lit(-9))).collect()) == want
    plan = en.lookup(rows, table, "word", max_rows=None, hot_share=0.01)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_names_with_dots_in_joins_and_sums(spark):
    fact = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 4.0)], "`a.k` int, `v.x` double")
    dim = spark.createDataFrame([(1, "one"), (None, "none")], "`a.k` int, `n.m` string")
    assert [r["n.m"] for r in en.enrich(fact.withColumnRenamed("a.k", "k"), dim.withColumnRenamed("a.k", "k"), "k").orderBy("`v.x`").collect()] == ["one", "one", None]
    assert [r["n.m"] for r in en.enrich(fact, dim, "a.k", null_safe=True).orderBy("`v.x`").collect()] == ["one", "one", "none"]
    assert [tuple(r) for r in en.sum_by(fact, "a.k", "v.x").collect()] == [(1, 5.0)]
    assert fe.MeanImputer(["v.x"]).fit(fact).means == {"v.x": 3.0}


def test_csv_types_null_tokens_and_line_breaks(spark, tmp_path):
    flat = tmp_path / "flat.csv"
    flat.write_text('id,score,flag,name,empty\n1,2,True,x,\n2,NA,false, y ,\n3,1e3,TRUE,N/A,\n')
    df = io.read_csv_table(spark, str(flat))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "flag": "boolean", "name": "string", "empty": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.0, True, "x", None), (2, None, False, " y ", None), (3, 1000.0, True, None, None)]
    assert not io.has_multiline_cells(spark, str(flat))
    broken = tmp_path / "broken.csv"
    broken.write_text('id,text\n1,"one\ntwo ""quoted"""\n2,"a, b"\n')
    assert io.has_multiline_cells(spark, str(broken))
    assert [tuple(r) for r in io.read_csv_table(spark, str(broken)).collect()] == [(1, 'one\ntwo "quoted"'), (2, "a, b")]
    assert dict(io.read_csv_table(spark, str(flat), infer=False).dtypes)["id"] == "string"
    ragged = tmp_path / "ragged.csv"
    ragged.write_text("id,v\n1,2\n3,4,5\n")
    bad = [r["bad"] for r in io.read_csv_table(spark, str(ragged), "id int, v int", corrupt_col="bad").collect()]
    assert bad == [None, "3,4,5"]


def test_malformed_json_is_an_error_unless_kept(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"a": 1}) + "\n{broken\n")
    with pytest.raises(Exception):
        io.read_json_lines(spark, str(p), "a int").collect()
    rows = io.read_json_lines(spark, str(p), "a int, bad string", corrupt_col="bad").collect()
    assert [(r["a"], r["bad"]) for r in rows] == [(1, None), (None, "{broken")]
    assert os.path.exists(p)


def test_parse_prefix_and_counts(spark):
    df = spark.createDataFrame([("x", 1, 0, None), ("x", None, 1, 2), ("y", 3, 0, None)], "k string, state_a int, state_b int, other int")
    assert fe.select_by_prefix(df, "state_") == ["state_a", "state_b"]
    assert [tuple(r) for r in en.count_non_null_by(df, "k", "state_a", "n").orderBy("k").collect()] == [("x", 1), ("y", 1)]
