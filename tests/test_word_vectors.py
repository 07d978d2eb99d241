"""Co-occurrence counts, word vectors, text projection, principal components, TF-IDF blocks of one scan."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starlens.functions import text as tx
from starlens.operators import components as pcs
from starlens.operators import cooccurrence as co
from starlens.operators import embed as eb
from starlens.operators import tfidf as tf

TEXTS = ["a b c a", "b  b", "", None, "x", "c c c c c c c a Ünï \t b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


def brute_pairs(texts, window):
    out = collections.Counter()
    for t in texts:
        w = (t or "").split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + window + 1)):
                out[min(w[i], w[j]), max(w[i], w[j])] += 1
    return out


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,), (["z"],)], "w array<string>")
    assert [[tuple(x) for x in r[0]] for r in df.select(tx.counted("w")).collect()] == [[("a", 1), ("b", 2)], [], [], [("z", 1)]]


@pytest.mark.parametrize("window", [1, 2, 5])
def test_cooccurrence_and_ppmi(docs, window):
    pairs = co.cooccurrence(docs, "text", window)
    brute = brute_pairs(TEXTS, window)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(brute)
    cell = collections.Counter()
    for (a, b), n in brute.items():
        cell[a, b] += n
        cell[b, a] += n
    row = collections.Counter()
    for (a, _), n in cell.items():
        row[a] += n
    total = sum(row.values())
    want = {(a, b): math.log(cell[a, b] * total / row[a] / row[b]) for a, b in brute}
    got = {(r["a"], r["b"]): r["ppmi"] for r in co.ppmi(pairs).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 1e-12}


def test_cooccurrence_min_count_and_empty(docs):
    got = {(r["a"], r["b"]): r["n"] for r in co.cooccurrence(docs, "text", 2, min_count=3).collect()}
    assert got == {k: n for k, n in brute_pairs(TEXTS, 2).items() if set(k) <= {"a", "b", "c"}}
    none = co.cooccurrence(docs.filter("id in (2, 3, 4)"), "text")
    assert none.count() == 0 and co.ppmi(none).count() == 0


def test_word_vectors_find_planted_neighbours(spark):
    rng = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(4)]
    rows = []
    for i in range(300):
        topic = rng.choice(topics)
        rows.append((i, " ".join(rng.choice(topic) if rng.random() < 0.8 else rng.choice(["the", "of", "and"]) for _ in range(30))))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vecs = {r["word"]: np.array(r["vector"]) for r in co.train_ppmi_vectors(df, "text", dim=6, window=4).collect()}
    assert {len(v) for v in vecs.values()} == {6}
    names = [w for w in vecs if w.startswith("t") and w != "the"]
    hits = 0
    for w in names:
        near = max((x for x in names if x != w), key=lambda x: vecs[w] @ vecs[x])
        hits += near[:2] == w[:2]
    assert len(names) == 32 and hits >= 31


def test_mean_vectors_split_hot_words(spark):
    df = spark.range(600).select("id", F.concat_ws(" ", F.lit("hot hot hot"), F.concat(F.lit("w"), F.col("id") % 90),
                                                   F.concat(F.lit("u"), F.col("id") % 7)).alias("text"))
    vecs = spark.createDataFrame([("hot", [1.0, 0.0])] + [(f"w{i}", [0.0, float(i)]) for i in range(90)], "word string, vector array<double>")
    whole = {r["id"]: (r["n_in_vocab"], r["vector"]) for r in eb.mean_vectors(df, "id", "text", vecs, 2).collect()}
    split = {r["id"]: (r["n_in_vocab"], r["vector"]) for r in eb.mean_vectors(df, "id", "text", vecs, 2, broadcast_max_rows=0).collect()}
    assert whole[5] == (4, [0.75, pytest.approx(5 / 4)]) and len(split) == 600
    for k, (n, v) in whole.items():
        assert split[k][0] == n and split[k][1] == pytest.approx(v)


def brute_projection(text, dim, buckets, nonzero, seed, max_tokens=None):
    out = [0] * dim
    for w in (text or "").lower().split()[:max_tokens]:
        h = hashlib.md5(w.encode()).hexdigest()
        b, sign = int(h[:8], 16) % buckets, 1 if int(h[8], 16) < 8 else -1
        for k in range(nonzero):
            r = hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest()
            out[int(r[:8], 16) % dim] += sign * (1 if int(r[8], 16) < 8 else -1)
    return out


@pytest.mark.parametrize("max_tokens", [None, 2])
def test_text_projection(docs, max_tokens):
    rows = eb.project_texts(docs, "id", "text", dim=8, buckets=16, nonzero=3, seed=5, max_tokens=max_tokens).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute_projection(TEXTS[r["id"]], 8, 16, 3, 5, max_tokens)
        assert r["sums"] == want and r["n_tokens"] == len((TEXTS[r["id"]] or "").split()[:max_tokens])
        length = math.sqrt(sum(x * x for x in want))
        assert r["embedding"] == pytest.approx([x / length if length else 0.0 for x in want])


def test_projection_keeps_similar_texts_close(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    near = [w if rng.random() < 0.9 else rng.choice(words) for w in base]
    other = [f"z{i}" for i in range(200)]
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(other))], "id long, text string")
    v = {r["id"]: np.array(r["embedding"]) for r in eb.project_texts(df, "id", "text", dim=64).collect()}
    assert v[0] @ v[1] > 0.8 > abs(v[0] @ v[2])


def covariance(x):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    return values[::-1], vectors[:, ::-1]


def test_components_of_dense_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 20)) * np.linspace(1, 1.2, 20) + 50
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    found = pcs.principal_components(df, "v", 20, k=3)
    values, vectors = covariance(x)
    assert found.variances == pytest.approx(values[:3], rel=1e-9) and found.total == pytest.approx(values.sum()) and found.rows == 300
    for j in range(3):
        assert abs(found.directions[:, j] @ vectors[:, j]) == pytest.approx(1, abs=1e-7)
        assert found.directions[np.abs(found.directions[:, j]).argmax(), j] > 0
    got = {r["id"]: r for r in pcs.project(df, "id", "v", found).collect()}
    assert got[999]["pc1"] is None and got[7]["pc2"] == pytest.approx((x[7] - x.mean(0)) @ found.directions[:, 1], abs=1e-9)


def test_components_of_sparse_rows(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((400, 300)) < 0.03, rng.exponential(1, (400, 300)), 0)
    x[:200, :5] += 3
    x[:, 299] = 0
    rows = [(i, [(int(j), float(r[j])) for j in np.flatnonzero(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<struct<place:int,value:double>>").repartition(3)
    found = pcs.principal_components(df, "v", 300, k=2)
    values, _ = covariance(x)
    assert found.variances == pytest.approx(values[:2], rel=1e-8)
    got = {r["id"]: r["pc1"] for r in pcs.project(df, "id", "v", found).collect()}
    assert got[3] == pytest.approx((x[3] - x.mean(0)) @ found.directions[:, 0], abs=1e-9)


def test_components_of_few_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert pcs.principal_components(one, "v", 2).variances.tolist() == [0, 0]
    assert pcs.principal_components(one.limit(0), "v", 2).rows == 0
    flat = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(10)], "id long, v array<double>")
    assert pcs.principal_components(flat, "v", 2).variances == pytest.approx([10 * 0.25 / 9, 0])
    with pytest.raises(ValueError, match="NaN"):
        pcs.principal_components(spark.createDataFrame([(1, [float("nan")]), (2, [1.0])], "id long, v array<double>"), "v", 1)


BLOCKS = [{"ngram_range": (1, 2), "min_df": 2, "max_df": 0.9, "max_terms": 15, "token_min_len": 1},
          {"ngram_range": (1, 3), "min_df": 1, "max_df": 1.0, "max_terms": 30, "token_min_len": 2}]


def test_blocks_of_one_scan_equal_blocks_fitted_alone(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ccc", "Été", "d", "ee"]) for _ in range(rng.randrange(9)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    together = tf.fit_blocks(df, "id", "text", BLOCKS)
    both = {r["id"]: r for r in tf.transform_blocks(df, "text", together).select("id", vector_to_array("tfidf0").alias("x0"), vector_to_array("tfidf1").alias("x1")).collect()}
    for i, b in enumerate(BLOCKS):
        alone = tf.TfidfBlock(output_col=f"tfidf{i}", **b).fit(df, "id", "text")
        assert alone.terms == together[i].terms and alone.idf == pytest.approx(together[i].idf)
        assert all(len(t) >= 2 for n in alone.terms for t in n.split()) or i == 0
        for r in alone.transform(df, "id", "text").select("id", vector_to_array(f"tfidf{i}").alias("x")).collect():
            assert both[r["id"]][f"x{i}"] == pytest.approx(r["x"])


def test_mean_vectors_shuffle_sums_only(spark):
    """Neither a joined vector is sorted nor is a word shuffled, in one block or several."""
    df = spark.createDataFrame([(1, "a a b"), (2, "b zz"), (3, ""), (4, None)], "id long, text string")
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])] + [(f"w{i}", [9.0, 9.0]) for i in range(40)],
                                 "word string, vector array<float>")
    for rows in (500_000, 16):
        out = eb.mean_vectors(df, "id", "text", vecs, 2, broadcast_max_rows=rows)
        assert {r["id"]: (r["n_in_vocab"], [round(x, 6) for x in r["vector"]]) for r in out.collect()} == {
            1: (3, [0.666667, 1.0]), 2: (1, [0.0, 3.0]), 3: (0, [0.0, 0.0]), 4: (0, [0.0, 0.0])}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "hashpartitioning(word" not in plan
    with pytest.raises(Exception, match="holds NULL"):
        eb.mean_vectors(df, "id", "text", spark.createDataFrame([("a", [1.0, None])], "word string, vector array<double>"), 2).collect()


def test_pairs_of_many_chunks_and_split_words(spark, monkeypatch):
    """counts of chunks meet in buckets, a frequent word's pairs in several; no table of pairs is stored."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "Of", "ä", *(f"w{i}" for i in range(40))]) for _ in range(rng.randrange(60))) for _ in range(50)]
    texts += [None, "", "one", " ", "the " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    monkeypatch.setattr(co, "cut_lineage", lambda frame: pytest.fail("pairs were stored"))
    monkeypatch.setattr(co, "CHUNK_TOKENS", 100)
    monkeypatch.setattr(co, "SPLIT", 50)
    monkeypatch.setattr(co, "BUCKET_PAIRS", 500)
    got = {(r["a"], r["b"]): (r["n"], r["ppmi"]) for r in co.text_ppmi(df, "text", 3).collect()}
    pairs = co.cooccurrence(df, "text", 3)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(brute_pairs(texts, 3))
    assert got == {(r["a"], r["b"]): (r["n"], pytest.approx(r["ppmi"])) for r in co.ppmi(pairs).collect()}


def test_projection_hashes_in_runs_of_rows(spark, monkeypatch):
    """no row per token is made or joined; rows of one id add up, NULL ids too, in whatever runs."""
    monkeypatch.setattr(eb, "PROJECTED_CELLS", 32)
    rows = [(1, "a b a"), (1, "c"), (None, "a"), (None, None), (2, ""), (3, "Ünï x")] + [(i, f"w{i} w") for i in range(10, 30)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    out = eb.project_texts(df, "id", "text", dim=8, buckets=16, nonzero=3, seed=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan
    want = sorted(((i if i is not None else -1), len((t or "").split()),
                   [sum(x) for x in zip(*(brute_projection(u, 8, 16, 3, 5) for j, u in rows if j == i))]) for i, t in rows)
    assert sorted((r["id"] if r["id"] is not None else -1, r["n_tokens"], r["sums"]) for r in out.collect()) == want
