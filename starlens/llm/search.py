"""Ranked lexical search for many queries at once, with shared term sets evaluated once.

Scores are sums over a query's terms, so a set of terms that several queries
share has one partial score per document.  The queries of a block are mined for
such sets: terms that stand in exactly the same queries become one atom; then,
in order of rarity, pairs of neighbouring atoms or sets that stand in two or
more queries become a set of their own, until no pair repeats.  This gives a
DAG whose nodes are sums of two earlier nodes and whose last nodes are the
queries.  For each batch of documents every node's accumulator (one number per
document) is computed once, in the order of the DAG.

Two passes: the first reads the whole texts and writes, for each document, its
length and the counts of the query terms it holds, beside the counts over all
documents; the second reads these postings, evaluates the DAG and keeps the
best ``k`` documents of each query in each task, which one window merges.

Queries are taken in blocks of bounded size (``VOCAB_CHARS`` characters of text
for a pass over the texts, ``ITEMS`` queries for a pass over the postings); a
block, its terms and its DAG are what the driver and the tasks hold.

Defined results for odd input
- NULL and empty texts have no terms; documents without terms do not count and
  are never found, queries without terms have no rows, and so has anything on
  an empty table.
- Equal scores are ranked by ascending id, NULL ids last; rows of equal id and
  score are rows of their own.
- Rows of the query table with equal ids (NULL too) are one query with the
  terms of all of them.
- Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, staged

VOCAB_CHARS, ITEMS = 1 << 24, 512
#: Numbers in the accumulators of a batch.
CELLS = 1 << 22

#: Separators are ASCII characters other than letters and digits; only A-Z is lower-cased.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


# ------------------------------------------------------------------ query-sharing DAG

@dataclass
class Dag:
    """Sums: node ``n_terms + i`` is the sum of ``sums[i]``; ``tops``: the nodes whose sum is a query's score."""

    n_terms: int
    sums: list[list[int]] = field(default_factory=list)
    tops: list[list[int]] = field(default_factory=list)

    def new(self, parts: list[int]) -> int:
        self.sums.append(parts)
        return self.n_terms + len(self.sums) - 1


def query_dag(queries: list[dict[int, int]], n_terms: int) -> Dag:
    """The DAG of queries given as {term number: occurrences}.

    A term that a query holds m times counts as m elements; shared sets are
    sets of (term, occurrence) elements, so repeats are shared as well.
    """
    dag = Dag(n_terms)
    where: dict[tuple[int, int], list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t, m in terms.items():
            for k in range(m):
                where[t, k].append(q)
    classes: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for (t, _), qs in sorted(where.items()):
        classes[tuple(qs)].append(t)
    lists: list[list[int]] = [[] for _ in queries]
    # commonest first, so that sets shared by many queries stand next to each other in all of them
    for qs, terms in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):
        atom = terms[0] if len(terms) == 1 else dag.new(terms)
        for q in qs:
            lists[q].append(atom)
    while True:
        pairs = Counter(p for x in lists for p in set(zip(x, x[1:], strict=False)))
        shared = {p for p, n in pairs.items() if n > 1}
        if not shared:
            break
        made: dict[tuple[int, int], int] = {}
        for q, x in enumerate(lists):
            # of overlapping pairs the commoner goes first
            taken, out = set(), {}
            for i in sorted((i for i in range(len(x) - 1) if (x[i], x[i + 1]) in shared),
                            key=lambda i: (-pairs[x[i], x[i + 1]], x[i], x[i + 1], i)):
                if i not in taken and i + 1 not in taken:
                    taken |= {i, i + 1}
                    out[i] = (x[i], x[i + 1])
            y, i = [], 0
            while i < len(x):
                if i in out:
                    if out[i] not in made:
                        made[out[i]] = dag.new(list(out[i]))
                    y.append(made[out[i]])
                    i += 2
                else:
                    y.append(x[i])
                    i += 1
            lists[q] = y
    dag.tops = lists
    return dag


def evaluate(dag: Dag, terms: np.ndarray) -> np.ndarray:
    """Scores (queries x documents) from the term contributions (terms x documents); every node once."""
    acc = np.empty((dag.n_terms + len(dag.sums), terms.shape[1]), np.int64)
    acc[: dag.n_terms] = terms
    for i, parts in enumerate(dag.sums):
        np.add.reduce(acc[parts], axis=0, out=acc[dag.n_terms + i])
    out = np.zeros((len(dag.tops), terms.shape[1]), np.int64)
    for q, parts in enumerate(dag.tops):
        np.add.reduce(acc[parts], axis=0, out=out[q])
    return out


# ------------------------------------------------------------------ postings

def _postings(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[DataFrame, dict[int, int], int, int]:
    """(postings of the query terms, df by term, documents with a term, terms of all documents)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for i, text in enumerate(b.column(1)):
                tokens = terms_of(text.as_py())
                if not tokens:
                    continue
                held = Counter(map(vocab.get, tokens))
                held.pop(None, None)
                ids.append(i)
                lengths.append(len(tokens))
                terms += held.keys()
                counts += held.values()
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["id", "n", "terms", "counts"])

    found = staged(map_arrow(docs, run, f"id {kind}, n long, terms array<int>, counts array<long>"), "postings")
    total = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    # one row for each term of the block
    df = {r[0]: r[1] for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    return found, df, total[0], total[1] or 0


def _best(postings: DataFrame, dag: Dag, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, id, score): the best ``k`` documents of each query in each task."""
    kind = postings.schema["id"].dataType.simpleString()
    local = np.full(int(max(terms.max(initial=0), 0)) + 1, -1)
    local[terms] = np.arange(len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = None
        queries, score, row = (np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(len(dag.tops), np.int64)
        step = max(1, CELLS // (dag.n_terms + len(dag.sums) + len(dag.tops)))
        for b in batches:
            for low in range(0, b.num_rows, step):
                part = b.slice(low, step)
                n = part.column(1).to_numpy()
                m = 25 + (75 * n * n_docs) // n_terms
                size = np.diff(part.column(2).offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), size)
                term = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy()
                here = term < len(local)
                here[here] = local[term[here]] >= 0
                doc, term, tf = doc[here], local[term[here]], tf[here]
                held = np.zeros((dag.n_terms, len(n)), np.int64)
                held[term, doc] = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                got = evaluate(dag, held)
                q, d = np.nonzero(got >= least[:, None])
                if not len(q):
                    continue
                fresh = part.column(0).take(pa.array(d))
                ids = fresh if ids is None else pa.concat_arrays([ids, fresh])
                queries, score = np.concatenate([queries, q]), np.concatenate([score, got[q, d]])
                # ids in ascending order, NULL last
                place = np.empty(len(ids), np.int64)
                place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                by = np.lexsort((place, -score, queries))
                rank = np.arange(len(by)) - np.searchsorted(queries[by], queries[by])
                keep = by[rank < k]
                queries, score, ids = queries[keep], score[keep], ids.take(pa.array(keep))
                least = _bars(least, queries, score, k)
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(queries), ids, pa.array(score)], ["query", "id", "score"])

    return map_arrow(postings, run, f"query long, id {kind}, score long")


def _bars(least: np.ndarray, queries: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The score that a document needs, once ``k`` are held (equal scores still count: ids decide)."""
    n = np.bincount(queries, minlength=len(least))
    lowest = np.full(len(least), np.iinfo(np.int64).max)
    np.minimum.at(lowest, queries, score)
    return np.where(n >= k, lowest, least)


# ------------------------------------------------------------------ search

def _blocks(items: DataFrame, limit: int) -> DataFrame:
    """Queries with the number of a block of about ``limit`` characters."""
    size = F.length("text").cast("long") + 1
    total = items.agg(F.sum(size)).first()[0] or 0
    return items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // limit)))))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score) of the ``k`` best documents with a score above 0 for each query."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = _blocks(items.select(F.col(item_col).alias("id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")),
                    VOCAB_CHARS)
    out = None
    for block in [r[0] for r in asked.select("block").distinct().orderBy("block").collect()]:
        # a block of queries of bounded size; the documents stay where they are
        by_id: dict[object, Counter] = defaultdict(Counter)
        for r in asked.filter(F.col("block") == block).select("id", "text").collect():
            by_id[r["id"]].update(terms_of(r["text"]))
        queries = [(i, c) for i, c in sorted(by_id.items(), key=lambda x: (x[0] is None, x[0])) if c]
        vocab = {t: n for n, t in enumerate(sorted({t for _, c in queries for t in c}))}
        if not vocab:
            continue
        postings, df, n_docs, n_terms = _postings(rows, vocab)
        if not n_terms:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocab))], np.int64)
        for low in range(0, len(queries), ITEMS):
            some = queries[low: low + ITEMS]
            terms = np.array(sorted({vocab[t] for _, c in some for t in c}))
            local = {int(t): n for n, t in enumerate(terms)}
            dag = query_dag([{local[vocab[t]]: m for t, m in c.items()} for _, c in some], len(terms))
            best = _best(postings, dag, terms, weight[terms], n_docs, n_terms, k)
            names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(some)],
                                                      f"query long, item {asked.schema['id'].dataType.simpleString()}")
            best = best.join(F.broadcast(names), "query").drop("query")  # at most ITEMS rows
            out = best if out is None else out.unionByName(best)
    if out is None:
        out = rows.select(F.lit(None).cast(asked.schema["id"].dataType).alias("item"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item", F.col("rank").cast("int").alias("rank"), "id", "score"))
