"""Toxicity by weak supervision.

Many voters look at a text: lexicon entries (words and word stems mined from
training labels), surface patterns, and the absence of any entry.  A generative
label model estimates by expectation maximisation how often each voter fires on
toxic and on other texts, and how voters are correlated given the label; a
voter's evidence is divided among those it moves with.  A linear classifier is
then trained on the model's posterior labels and scores every text.

The models are fitted on a bounded sample of labelled training rows
(``max_labelled``); every text of the table is scored, whole.  Label, language,
source and id are inputs of no score.

Defined results: a NULL or empty text has no features and the score of the
classifier's constant; repeated rows and NULL ids are scored row by row; of
repeated labels of one id the largest counts; without toxic or without other
labels in training every score is the share of toxic labels (0 without any); an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged

WORD = regex.compile(r"\p{L}+")
#: Lengths of the word stems that can be lexicon entries; whole words are marked by a full stop.
STEMS = range(4, 9)
#: Surface patterns, counted against the words of a text.
SHOUTING = regex.compile(r"\b\p{Lu}{3,}\b")
EXCLAIM = regex.compile(r"[!?]{2,}")
PATTERNS = ("shouting", "exclaiming")


def entries(words: set[str]) -> set[str]:
    """Lexicon entries that the words of a text can match."""
    out = {w + "." for w in words}
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def patterns_of(text: str | None, n_words: int) -> list[float]:
    t = text or ""
    few = max(n_words, 1)
    return [float(len(SHOUTING.findall(t)) * 5 > few), float(len(EXCLAIM.findall(t)) * 10 > few)]


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, max_labelled: int, id_col: str,
                    text_col: str, label_col: str) -> DataFrame:
    """(text, y): about ``max_labelled`` labelled training rows at most, chosen by a hash of the id."""
    known = (labels.filter(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    n = known.count()
    share = min(1.0, max_labelled / max(n, 1))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the bound on the sample is the bound on what is broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return staged(rows.join(F.broadcast(known), "id").select("text", "y")
                  .repartition(docs.sparkSession.sparkContext.defaultParallelism), "labelled")


def mine_lexicon(sample: DataFrame, n_toxic: int, n_other: int, size: int, min_docs: int, min_lift: float) -> list[str]:
    """The ``size`` entries that tell toxic texts apart best, by their likelihood ratio."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts[bool(y)].update(entries(words_of(t.as_py())))
        keys = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(keys), 100_000):
            k = keys[at:at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.string()), pa.array([counts[1][x] for x in k], pa.int64()),
                 pa.array([counts[0][x] for x in k], pa.int64())], ["entry", "toxic", "other"])
    sums = map_arrow(sample, run, "entry string, toxic long, other long").groupBy("entry").agg(
        F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    t, o = F.col("t"), F.col("o")
    lift = ((t + 0.5) / (n_toxic + 1)) / ((o + 0.5) / (n_other + 1))
    share = n_toxic / (n_toxic + n_other)
    gain = t * F.log(t / (t + o) / share) + F.when(o > 0, o * F.log(F.greatest(o, F.lit(1)) / (t + o) / (1 - share))).otherwise(0.0)
    best = (sums.filter((t >= min_docs) & (lift >= min_lift)).withColumn("gain", gain)
            .orderBy(F.desc("gain"), F.length("entry"), "entry").limit(size))
    return [r["entry"] for r in best.select("entry").collect()]


def features(text: str | None, number: dict[str, int]) -> tuple[list[int], int]:
    """(numbers of the lexicon entries that the text holds, then of its patterns; number of distinct words)."""
    words = words_of(text)
    found = {number[e] for e in entries(words) if e in number}
    fired = [len(number) + i for i, x in enumerate(patterns_of(text, len(words))) if x]
    return sorted(found) + fired, len(words)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25, strong: float = 0.05) -> np.ndarray:
    """Posterior probability of label 1 for each row.

    ``votes`` (rows x voters) is true where a voter fires.  The gold label is
    one more voter, whose accuracy is estimated like the others'.
    """
    n, m = votes.shape
    v = votes.astype(np.float32)
    q = gold.astype(np.float64) * 0.9 + 0.05
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        fire1 = np.clip((v.T @ q + 0.1) / (q.sum() + 1), 1e-4, 1 - 1e-4)
        fire0 = np.clip((v.T @ (1 - q) + 0.1) / ((1 - q).sum() + 1), 1e-4, 1 - 1e-4)
        # correlation given the label: what is left of the votes beyond both rates
        rest = v - (np.outer(q, fire1) + np.outer(1 - q, fire0)).astype(np.float32)
        cov = rest.T @ rest / max(n, 1)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 0)
        shared = 1 + np.where(corr > strong, corr, 0).sum(axis=1)
        yes = np.log(fire1 / fire0) / shared
        no = np.log((1 - fire1) / (1 - fire0)) / shared
        g1 = np.clip((q @ gold + 1) / (q.sum() + 2), 1e-3, 1 - 1e-3)
        g0 = np.clip(((1 - q) @ gold + 1) / ((1 - q).sum() + 2), 1e-3, 1 - 1e-3)
        logit = (math.log(prior / (1 - prior)) + v @ (yes - no) + no.sum()
                 + np.where(gold > 0, math.log(g1 / g0), math.log((1 - g1) / (1 - g0))))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            return new
        q = new
    return q


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam steps (deterministic).

    Both labels weigh the same in all, so that a rare label is not outvoted.
    """
    x = x.astype(np.float32)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = y / (2 * share) + (1 - y) / (2 * (1 - share))
    w, b = np.zeros(x.shape[1]), 0.0
    mom, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        d = (p - y) * weight / len(y)
        g = np.append(x.T @ d.astype(np.float32) + l2 * w, d.sum())
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        step = 0.1 * (mom / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000,
                    lexicon: int = 1000, min_docs: int = 3, min_lift: float = 8.0) -> DataFrame:
    """(id, score) of every text.  ``train`` is a condition over the labels' id column."""
    sample = labelled_sample(docs, labels, train, max_labelled, id_col, text_col, label_col)
    sums = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, n_toxic = int(sums[0]), int(sums[1])
    if not n_toxic or n_toxic == n:
        return docs.select(F.col(id_col), F.lit(n_toxic / max(n, 1)).alias("score"))
    number = {e: i for i, e in enumerate(mine_lexicon(sample, n_toxic, n - n_toxic, lexicon, min_docs, min_lift))}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t.as_py(), number)[0] for t in b.column(0)], pa.list_(pa.int32())), b.column(1)],
                ["fired", "y"])
    # the bounded sample only: the numbers of the voters that fire, not the texts
    rows = map_arrow(sample, vote, "fired array<int>, y int").collect()
    width = len(number) + len(PATTERNS) + 1
    x = np.zeros((len(rows), width), bool)
    for i, r in enumerate(rows):
        x[i, r["fired"]] = True
        x[i, -1] = not any(k < len(number) for k in r["fired"])
    posterior = label_model(x, np.array([r["y"] for r in rows]))
    weights, bias = fit_linear(x, posterior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                fired, _ = features(t.as_py(), number)
                z = bias + float(weights[fired].sum())
                if not fired or fired[0] >= len(number):
                    z += weights[-1]
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["id", "score"])
    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), score,
                     "id long, score double").withColumnRenamed("id", id_col)
