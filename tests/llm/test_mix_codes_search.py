"""Mixing, vector codes and ranked search against brute-force versions."""

import collections
import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from starlens.llm import mixing, search, vector_codes  # noqa: E402

DOCS = "doc_id long, source string, text string, size int, entry string, idx long, h string, n int, terms string"


def bag(df):
    return collections.Counter(tuple(r) for r in df.collect())


def doc_rows():
    """Nulls, blanks, repeated rows, a very long text, a source with a third of the rows, clashing columns."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)] + ["naïve", "Über", "x-y", "A1"]
    out = []
    for i in range(120):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", "z", None])
        out.append((i, source, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))))
    out += [(200, "a", None), (201, "a", ""), (202, None, " \t\n\r\x0b\x0c "), (203, "tiny", "one"), (204, "empty", ""),
            (205, "z", " ".join(f"v{i % 31}" for i in range(20_000))), (None, "a", "no id here"), (None, None, None)]
    out += [(300, "B", "the same row again")] * 40 + [out[0]] * 3
    return [(*r, 7, "x", 3, "y", 9, "t") for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(doc_rows(), DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ mixing

SMALL = {"block_words": 16, "shard_blocks": 32}


@pytest.fixture(scope="module")
def mix(docs):
    return mixing.mix_sources(docs, **SMALL)


def brute_taken(docs, block, seed=42, weights=(5, 2, 1), cap=3):
    """(doc_id, size, source_size, target, taken) with the streams written out word by word."""
    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "source", "text").alias("h")).collect()
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.h) for r in rows]
    size = collections.Counter()
    for _, s, n, _ in rows:
        size[s] += n
    sources = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, target = sum(size.values()), {}
    held = set()
    while True:
        rest, share = total - sum(cap * size[s] for s in held), sum(weight[s] for s in sources if s not in held)
        target = {s: cap * size[s] if s in held else weight[s] * rest / share for s in sources}
        above = {s for s in sources if target[s] > cap * size[s]}
        if not above:
            break
        held |= above
    spark = docs.sparkSession
    order = {}
    entries = len({(d, s, n, h) for d, s, n, h in rows})
    buckets = max(1, -(-entries // mixing.BUCKET_ROWS))
    for r in spark.createDataFrame([(h,) for _, _, _, h in rows], "h long").select(
            "h", F.pmod(F.xxhash64("h", F.lit(0).cast("long"), F.lit(seed)), F.lit(buckets)).alias("b")).collect():
        order[r.h] = r.b
    out = collections.Counter()
    for i, s in enumerate(sources):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (order[r[3]], r[3]))
        stream = [k for k, r in enumerate(mine) for _ in range(r[2])]
        n, take = -(-len(stream) // block), math.floor(target[s] + 0.5)
        drawn, turn = [], 0
        while len(drawn) < take:
            key = mixing.block_keys(seed, np.array([i]), np.array([turn]))
            at = mixing.permuted(np.arange(n), np.full(n, n), np.repeat(key, n))
            assert sorted(at) == list(range(n))
            for b in np.argsort(at):
                drawn += stream[b * block:(b + 1) * block]
            turn += 1
        got = collections.Counter(drawn[:take])
        for k, r in enumerate(mine):
            out[r[0], r[2], size[s], round(target[s], 6), got[k]] += 1
    return out


def test_mix_equals_streams_written_out(docs, mix):
    got = mixing.taken_words(mix)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    # which of equal rows gets which part is open, so only sums count there
    fold = lambda c: collections.Counter({k: sum(r[4] * n for r, n in c.items() if r[:4] == k) for k in {r[:4] for r in c}})
    rows = bag(got.select("doc_id", "size", "source_size", F.round("target", 6), "taken"))
    brute = brute_taken(docs, SMALL["block_words"])
    assert fold(rows) == fold(brute)
    assert sum(rows.values()) == len(doc_rows())
    assert {r: n for r, n in rows.items() if r[0] not in (300, 0)} == {r: n for r, n in brute.items() if r[0] not in (300, 0)}
    assert all(taken <= 3 * size for _, size, _, _, taken in rows)


def test_mix_targets_are_met_to_the_word(mix):
    taken = {r.source: r.t for r in mix.slices.groupBy("source").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("t")).collect()}
    for s in mix.sources.collect():
        assert taken.get(s.source, 0) == s["take"] == math.floor(s.target + 0.5) and s.target <= 3 * s.words
    words = {s.source: s.words for s in mix.sources.collect()}
    assert words["empty"] == 0 and words["tiny"] == 1 and None in words


def test_mix_shards_hold_disjoint_blocks_in_their_own_order(mix):
    rows = mix.slices.collect()
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert len(shards) > 8
    for part in shards.values():
        assert sorted(r.place for r in part) == list(range(1, len(part) + 1))
    blocks = collections.defaultdict(set)
    for r in rows:
        blocks[r.source, r.epoch, r.block].add(r.shard)
    assert all(len(s) == 1 for s in blocks.values())
    quota = sum(s.quota for s in mix.sources.collect())
    held = collections.Counter(next(iter(s)) for s in blocks.values())
    deep = math.ceil(math.log2(quota / SMALL["shard_blocks"]))
    assert held == {j: (quota * (j + 1) >> deep) - (quota * j >> deep) for j in range(1 << deep)}
    mixed = [r.source for r in sorted(max(shards.values(), key=len), key=lambda r: r.place)]
    assert sum(a != b for a, b in zip(mixed, mixed[1:], strict=False)) > len(set(mixed))


def test_mixed_texts_are_the_words_of_the_slices(docs, mix):
    texts = collections.defaultdict(set)
    for r in doc_rows():
        texts[r[0], r[1]].add(tuple(re.findall(r"[^\x20\x09-\x0D]+", r[2] or "")))
    want = collections.Counter()
    for r in mix.slices.collect():
        (words,) = [w for w in texts[r.doc_id, r.source] if len(w) >= r.word_to]
        want[r.shard, r.place, " ".join(words[r.word_from:r.word_to])] += 1
    assert bag(mixing.mixed_texts(docs, mix).select("shard", "place", "text")) == want


def test_mix_does_not_depend_on_partitions(docs, mix):
    again = mixing.mix_sources(docs.repartition(7, "text"), **SMALL)
    assert bag(mixing.taken_words(again)) == bag(mixing.taken_words(mix))
    cols = ["shard", "doc_id", "source", "epoch", "block", "word_from", "word_to"]
    assert bag(again.slices.select(cols)) == bag(mix.slices.select(cols))


def test_mix_empty_table(spark, docs):
    none = mixing.mix_sources(docs.limit(0))
    assert none.slices.count() == 0 and mixing.taken_words(none).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "a", " ")], "doc_id long, source string, text string")
    assert bag(mixing.taken_words(mixing.mix_sources(blank))) == {(1, 0, 0, 0.0, 0): 1, (2, 0, 0, 0.0, 0): 1}


def test_splitting_tree_chunks_and_subtrees_agree():
    rng = np.random.default_rng(3)
    quotas = [rng.integers(0, 400, 30), rng.integers(0, 50, 7), np.array([9_000])]
    totals = np.array([q.sum() for q in quotas])
    depth = 5
    whole = [dict((s, (a, n)) for s, a, n in mixing.leaf_ranges(q, totals, c, depth, 0, 0, 42)) for c, q in enumerate(quotas)]
    parts = [{} for _ in quotas]
    for group in range(4):  # the same leaves from four subtrees
        for c, q in enumerate(quotas):
            parts[c].update({s: (a, n) for s, a, n in mixing.leaf_ranges(q, totals, c, depth, 2, group, 42)})
    for a, b in zip(whole, parts, strict=True):
        assert a.keys() == b.keys() and all(np.array_equal(a[s][k], b[s][k]) for s in a for k in (0, 1))
    n = int(totals.sum())
    for s in range(1 << depth):
        assert sum(int(w[s][1].sum()) for w in whole) == (n * (s + 1) >> depth) - (n * s >> depth)
    for w, q in zip(whole, quotas, strict=True):
        at = np.zeros_like(q)
        for s in range(1 << depth):  # ranges follow each other without gap
            assert np.array_equal(w[s][0], at)
            at = at + w[s][1]
        assert np.array_equal(at, q)


def test_splitting_tree_draws_are_hypergeometric():
    own, totals = np.array([600, 300, 100]), np.array([1000])
    first = np.array([mixing.leaf_ranges(own, totals, 0, 3, 0, 0, seed)[-1][2] for seed in range(600)])
    n, share = 125, own / 1000
    mean, var = n * share, n * share * (1 - share) * (1000 - n) / 999
    assert np.all(np.abs(first.mean(0) - mean) < 5 * np.sqrt(var / 600))
    assert np.all(np.abs(first.var(0) / var - 1) < 0.3)


# ------------------------------------------------------------------ vector codes

VECS = "vec_id long, embedding array<float>, label int, x int, id string, code string, v long"


def vec_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (9, 8))
    out = []
    for i in range(700):
        v = centres[i % 9] + rng.normal(0, 0.02 if i % 2 else 0.4, 8)
        out.append((1000 - i, [float(np.float32(x)) for x in v], None if i % 11 == 0 else i % 4))
    same = [0.25] * 8
    out += [(2000 + i, same, 1) for i in range(350)]  # a third are copies of one vector
    out += [(3000, None, 1), (3001, [0.1] * 7 + [None], 1), (3002, [0.1] * 7 + [float("nan")], 2), (3003, [float("inf")] + [0.0] * 7, 2),
            (3004, [], 2), (3005, [1.0, -1.0], 3), (3006, [3e38] + [-3e38] * 7, 3), (None, same, None), (5, same, 1), (5, same, 1),
            (5, [0.5] * 8, 1)]
    return [(*r, 1, "i", "c", 2) for r in out]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = []
    for i, v, label, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-2**26, min(2**26, math.floor(1024 * float(np.float32(c))))) for c in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in kept], object)
    w = width // parts
    codes, error, books = [], 0, []
    for p in range(parts):
        a = x[:, p * w:(p + 1) * w]
        book = a[:entries].copy()
        for turn in range(rounds + 1):
            d = ((a[:, None, :] - book[None]) ** 2).sum(2)
            code = np.array([min(range(len(book)), key=row.__getitem__) for row in d])
            if turn < rounds:
                for e in set(code):
                    rows_of = a[code == e]
                    book[e] = [int(s) // len(rows_of) for s in rows_of.sum(0)]
        codes.append(code)
        error = error + d[np.arange(len(a)), code]
        books += [c for e in book for c in e]
    per_label = collections.Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        per_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{c[k]:02x}" for c in codes), int(error[k]), per_label[label], digest)
                               for k, (i, _, label) in enumerate(kept))


def test_codes_equal_brute_force(spark):
    rows = vec_rows()
    df = spark.createDataFrame(rows, VECS).repartition(3)
    got = vector_codes.code_report(vector_codes.compress_vectors(df))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert bag(got) == brute_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    few = [(i, [float(i), 0.0, 1.0, 2.0], i) for i in range(3)]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")
    assert bag(vector_codes.code_report(vector_codes.compress_vectors(df))) == brute_codes(few)
    assert vector_codes.code_report(vector_codes.compress_vectors(df.limit(0))).count() == 0


def test_decompress_returns_the_entries(spark):
    df = spark.createDataFrame(vec_rows(), VECS)
    found = vector_codes.compress_vectors(df, entries=64)
    back = {r.id: r.vector for r in vector_codes.decompress(found.codes, found.codebooks).collect()}
    for r in found.codes.filter("id >= 2000 and id < 2010").collect():
        assert abs(sum((math.floor(1024 * 0.25) / 1024 - c) ** 2 for c in back[r.id]) * 1024 ** 2 - r.error) < 1e-6


def test_cover_tree_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (20, 6))
    points = centres[rng.integers(0, 20, 900)] + rng.integers(-30, 30, (900, 6))
    order, nodes = vector_codes.cover_tree(points)
    assert sorted(order) == list(range(900))
    for centre, low, high, radius, first, n in nodes:
        inside = points[order[int(low):int(high)]]
        assert np.sqrt(((inside - points[int(centre)]) ** 2).sum(1)).max() <= radius * (1 + 1e-12)
        if n:
            kids = nodes[int(first):int(first + n)]
            assert kids[0][1] == low and kids[-1][2] == high and np.all(kids[1:, 1] == kids[:-1, 2])
            assert np.all(kids[:, 3] <= radius / 2)
    code, compared = vector_codes.nearest(points, order, nodes, centres)
    brute = ((points[:, None].astype(object) - centres[None]) ** 2).sum(2).astype(np.int64)
    assert np.array_equal(code, brute.argmin(1)) and compared < 90
    low, high, *_ = vector_codes.descend(points, order, nodes, centres)
    assert len(low) < 200  # whole subtrees, not points one by one
    counts, sums = vector_codes.entry_sums(points, order, nodes, centres)
    assert np.array_equal(counts, np.bincount(code, minlength=20))
    assert np.array_equal(sums, np.stack([points[code == e].sum(0) for e in range(20)]))


def test_ties_go_to_the_lower_entry():
    points = np.array([[0, 0], [0, 0], [2, 0], [1, 0], [4, 0]])
    book = np.array([[2, 0], [0, 0], [0, 0], [2, 0]])
    code, _ = vector_codes.nearest(points, *vector_codes.cover_tree(points), book)
    assert code.tolist() == [1, 1, 0, 0, 0]


# ------------------------------------------------------------------ ranked search

ITEMS = [(1, "w1 w2 w3 naïve W1"), (2, "w1 w2 w3 x y"), (3, "w1 w2 w3 w4 w5"), (4, None), (5, ""), (6, "nowhere"), (7, "the same row again"),
         (8, "über w7, w7; w7"), (9, "w4 w5 w9"), (10, "- - -"), (None, "w40 w41"), (11, "w1 W2 w3 naïve w1")]


def brute_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: term.findall((t or "").translate(low))
    held = [(d, collections.Counter(w), len(w)) for d, w in ((r[0], terms(r[2])) for r in docs) if w]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = collections.Counter()
    for i, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out[i, rank, d, -s] += 1
    return out


def test_search_equals_brute_force(spark, docs):
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, id string")
    got = search.search(docs, items)
    assert got.columns == ["item", "rank", "id", "score"]
    assert bag(got) == brute_search(doc_rows(), ITEMS)


def test_search_in_blocks_and_other_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(search, "VOCAB_CHARS", 40)
    monkeypatch.setattr(search, "ITEMS", 2)
    monkeypatch.setattr(search, "CELLS", 64)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert bag(search.search(docs.repartition(5), items, k=3)) == brute_search(doc_rows(), ITEMS, 3)


def test_search_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.filter("text is null"), items).count() == 0


def test_query_dag_shares_sets_and_is_exact():
    rng = random.Random(2)
    sets = [[rng.randrange(200) for _ in range(6)] for _ in range(12)]
    queries = []
    for _ in range(60):
        c = collections.Counter(rng.randrange(200) for _ in range(4))
        for s in rng.sample(sets, 3):
            c.update(s)
        queries.append(dict(c))
    dag = search.query_dag(queries, 200)
    x = np.array([[rng.randrange(10**9) for _ in range(5)] for _ in range(200)])
    want = np.array([[sum(m * int(x[t, d]) for t, m in q.items()) for d in range(5)] for q in queries])
    assert np.array_equal(search.evaluate(dag, x), want)
    plain = sum(sum(q.values()) for q in queries)
    shared = sum(map(len, dag.sums)) + sum(map(len, dag.tops))
    assert shared < 0.8 * plain
    assert search.query_dag([], 3).tops == [] and search.query_dag([{}], 3).tops == [[]]


def test_term_pattern_is_the_stated_class():
    text = "".join(map(chr, range(0x250))) + " Ünï 漢字 x"
    want = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    assert [t.decode() for t in search.terms_of(text)] == want
