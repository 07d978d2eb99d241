"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in the order of a seeded hash,
cut into blocks of ``block_words`` words.  A source's target, in whole words, is
met exactly: full passes over the stream, then the first blocks of a permutation
of the last pass, the last of these cut short.

The sources' block quotas are dealt to output shards by a binary tree.  A node
holds a vector of quotas; its left half draws as many blocks as its shards hold
by a multivariate hypergeometric draw, its right half gets the rest.  At the
leaves each shard owns, for every source, a range of positions of the permuted
blocks, disjoint from all other shards' ranges.  Inside a shard the blocks are
put in a seeded order of their own.

Nothing is dealt by a driver: draws depend only on (seed, node), so that each
task walks from the root to its own shards, and sources beyond ``CHUNK`` are
drawn in chunks (first the chunks' totals, then inside the chunk).

Defined results for odd input
- NULL or blank texts have size 0 and take nothing; NULL ids are kept as NULL.
- NULL sources form one source, the last.
- Equal rows (same id, source and text) are documents of their own, each with
  its own part of the stream; which of the equal rows gets which part is open.
- Sources without words, and empty tables, have target 0.
- Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.enrich import maybe_broadcast
from ..operators.rank import sorted_positions
from .common import WORD, map_arrow, ship, staged

BLOCK_WORDS = 256
#: Blocks in an output shard, about (shards are a power of two).
SHARD_BLOCKS = 4096
#: The exact sampler takes fewer than 10^9 blocks in all: blocks grow with the corpus beyond this many.
MOST_BLOCKS = 1 << 29
#: Sources drawn in one task.
CHUNK = 4096
#: Levels of the tree that one task walks to the end (2^6 shards).
SUBTREE = 6
#: Entries in a bucket of the stream order, about; equal rows in one entry, at most.
BUCKET_ROWS, COPIES = 4096, 1000
#: Block positions in a cell of the join of blocks with the shards' ranges.
CELL = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Mix:
    """documents: a row per document with ``taken``'s inputs; slices: what the shards hold; sources: targets and quotas."""

    documents: DataFrame
    slices: DataFrame
    sources: DataFrame


# ------------------------------------------------------------------ sizes

def word_counts(texts: pa.Array, rows: int = 256) -> np.ndarray:
    """Runs of characters that are not ASCII white space, for each text (NULL: 0)."""
    out = np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), rows):
        part = texts.slice(at, rows).cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = part.buffers()
        ends = np.frombuffer(offsets, np.int64)[part.offset: part.offset + len(part) + 1]
        body = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        word = ~_SPACE[body]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = ends[:-1][ends[:-1] < len(body)]
        first[heads] = word[heads]  # a text begins anew
        out[at: at + len(part)] = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    return out


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(doc_id, source, h, size): whole texts are only counted, they do not travel."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"),
                       F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(word_counts(b.column(3)))],
                                             ["doc_id", "source", "h", "size"])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, h long, size long")


# ------------------------------------------------------------------ targets

def fill_targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources`` (idx, words) plus weight and target.

    Shares of all words by weight; a target above ``cap`` times its source's
    words stops there and the excess goes to the others by weight, until none
    is above.  Each round is one aggregate; the driver holds three numbers.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    total = rows.agg(F.sum("words")).first()[0] or 0
    rest, share, full = total, None, -1
    while True:
        above = F.lit(False) if share is None else F.col("words") * cap <= F.col("weight") * F.lit(rest) / F.lit(share)
        r = rows.agg(F.sum(F.when(above, F.col("words") * cap)).alias("held"), F.count(F.when(above, 1)).alias("n"),
                     F.sum(F.when(~above, F.col("weight"))).alias("w")).first()
        if r["n"] == full or not r["w"]:
            break
        full, rest, share = r["n"], float(total - (r["held"] or 0)), float(r["w"])
    if share is None or not total:
        return rows.withColumn("target", F.lit(0.0))
    return rows.withColumn("target", F.least((F.col("words") * cap).cast("double"),
                                             F.col("weight") * F.lit(rest) / F.lit(share)))


# ------------------------------------------------------------------ permutations

def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(seed: int, idx: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return _mix64(_mix64(np.asarray(idx, np.uint64) + np.uint64(seed + 1)) ^ (np.asarray(turn, np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts ``x`` (a Feistel network, walked until it is below n)."""
    x, n = np.array(x, np.uint64), np.asarray(n, np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2 + 1e-9)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(1, 5):
            left, right = right, left ^ (_mix64(right + k * np.uint64(2 * turn + 1)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Whole-word target, blocks, full passes, drawn blocks and the words of the last drawn block of each source."""
    rows = sources.select("idx", "source", "words", "target", F.round("target").cast("long").alias("take"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s, t = p["words"].to_numpy(np.int64), p["take"].to_numpy(np.int64)
            n = -(-s // block)
            one = np.maximum(s, 1)
            passes, rest = t // one, t % one
            short = block * n - s  # missing from the stream's last block
            last = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), block_keys(seed, p["idx"].to_numpy(), passes))
            m = -(-rest // block)
            m = m + ((last < m) & (m * block - short < rest))
            before = np.maximum(m - 1, 0)
            cut = rest - (before * block - short * (last < before))
            # after full passes alone the last drawn block is a whole one
            p["blocks"], p["quota"], p["cut"] = n, passes * n + m, np.where(m > 0, cut, block)
            yield p

    ship(sources.sparkSession)
    return rows.mapInPandas(run, "idx long, source string, words long, target double, take long, blocks long, quota long, cut long")


# ------------------------------------------------------------------ splitting tree

def _draw(quotas: np.ndarray, n: int, *node: int) -> np.ndarray:
    """How many of ``n`` blocks come from each source: a multivariate hypergeometric draw owned by ``node``."""
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence(node)))
    return rng.multivariate_hypergeometric(quotas, n, method="marginals") if len(quotas) > 1 else np.array([n])


def leaf_ranges(own: np.ndarray, totals: np.ndarray, chunk: int, depth: int, group_depth: int, group: int, seed: int
                ) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first position, count) vectors of one chunk of sources for the shards under one node.

    ``totals`` are the chunks' block quotas, ``own`` this chunk's sources'.
    """
    whole = int(totals.sum())

    def held(d: int, j: int) -> int:  # blocks before node j of depth d
        return whole * j >> d

    def halves(own, totals, d, j):
        n = held(d + 1, 2 * j + 1) - held(d, j)
        left = _draw(totals, n, seed, 0, d, j)
        return _draw(own, int(left[chunk]), seed, 1 + chunk, d, j), left

    before = np.zeros_like(own)
    for d in range(group_depth):
        j = group >> (group_depth - d)
        left, left_totals = halves(own, totals, d, j)
        if group >> (group_depth - d - 1) & 1:
            own, totals, before = own - left, totals - left_totals, before + left
        else:
            own, totals = left, left_totals
    out, open_nodes = [], [(group_depth, group, own, totals, before)]
    while open_nodes:
        d, j, own, totals, before = open_nodes.pop()
        if d == depth:
            out.append((j, before, own))
            continue
        left, left_totals = halves(own, totals, d, j)
        open_nodes += [(d + 1, 2 * j, left, left_totals, before),
                       (d + 1, 2 * j + 1, own - left, totals - left_totals, before + left)]
    return out


def _shard_ranges(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """(idx, shard, first, n): the positions of a source's permuted blocks that a shard owns."""
    spark = sources.sparkSession
    rows = sources.filter("quota > 0").select("idx", "quota", F.floor(F.col("idx") / CHUNK).cast("long").alias("chunk"))
    # one number for each CHUNK sources
    sums = rows.groupBy("chunk").agg(F.sum("quota").alias("n")).orderBy("chunk").collect()
    chunks, totals = [r["chunk"] for r in sums], np.array([r["n"] for r in sums], np.int64)
    depth = max(0, math.ceil(math.log2(max(1, int(totals.sum()) / shard_blocks))))
    group_depth = max(0, depth - SUBTREE)
    grouped = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((1 << group_depth) - 1))))

    def run(key, p):
        p = p.sort_values("idx")
        leaves = leaf_ranges(p["quota"].to_numpy(np.int64), totals, chunks.index(key[0]), depth, group_depth, int(key[1]), seed)
        out = pd.DataFrame({"idx": np.tile(p["idx"].to_numpy(), len(leaves)),
                            "shard": np.repeat([x[0] for x in leaves], len(p)).astype(np.int64),
                            "first": np.concatenate([x[1] for x in leaves]), "n": np.concatenate([x[2] for x in leaves])})
        return out[out["n"] > 0]

    ship(spark)
    return grouped.groupBy("chunk", "part").applyInPandas(run, "idx long, shard long, first long, n long")


# ------------------------------------------------------------------ the mix

def _drawn(entries: DataFrame, block: int, seed: int) -> DataFrame:
    """(entry, copy, idx, at, epoch, block, word_from, word_to): the drawn parts of each document.

    ``at`` is the block's position in the source's permuted passes.
    """
    rows = entries.select("entry", "copy", "idx", "first", "size", "blocks", "quota", "cut")
    names = ["entry", "copy", "idx", "at", "epoch", "block", "word_from", "word_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entry, copy, idx, first, size, blocks, quota, cut = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            low = first // block
            n = np.where(size > 0, (first + size - 1) // block - low + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            nth = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            for epoch in range(int(np.max(-(-quota // np.maximum(blocks, 1)), initial=0))):
                key = block_keys(seed, idx[row], np.full(len(row), epoch))
                at = epoch * blocks[row] + permuted(nth, blocks[row], key)
                end = nth * block + np.where(at == quota[row] - 1, cut[row], block)
                start = np.maximum(nth * block, first[row]) - first[row]
                stop = np.minimum(end, first[row] + size[row]) - first[row]
                k = np.flatnonzero((at < quota[row]) & (start < stop))
                r = row[k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (entry[r], copy[r], idx[r], at[k], np.full(len(k), epoch), nth[k], start[k], stop[k])],
                    names)

    return map_arrow(rows, run, ", ".join(f"{n} long" for n in names))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 42,
                block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text") -> Mix:
    """Mix all documents to target weights; ``weights`` repeat over the sources in code-point order (NULL last).

    ``Mix.slices``: (shard, place, entry, copy, doc_id, source, h, epoch, block, word_from, word_to), the words
    [word_from, word_to) of a document at a place of a shard.  ``Mix.documents``: (entry, copy, doc_id, source, h,
    size, source_size, target), a row per input row.  ``Mix.sources``: (idx, source, words, target, take, blocks,
    quota, cut); a source's slices hold exactly ``take`` words.
    """
    sized = _sized(docs, id_col, source_col, text_col).groupBy("doc_id", "source", "h", "size").agg(
        F.count(F.lit(1)).alias("n"))
    # equal rows travel as one row and a count, in entries of up to COPIES of them
    entries = staged(
        sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
        .select("doc_id", "source", "h", "size", "part", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).alias("n"))
        .withColumn("entry", F.monotonically_increasing_id()), "mix-entries")
    words = F.col("size") * F.col("n")
    per_source = entries.groupBy("source").agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("rows"))
    ordered = sorted_positions(per_source, [F.asc_nulls_last("source")], "idx")
    totals = ordered.agg(F.sum("words"), F.sum("rows")).first()
    block = max(block_words, -(-(totals[0] or 0) // MOST_BLOCKS))
    sources = staged(_quotas(fill_targets(ordered.drop("rows"), weights, cap), block, seed), "mix-sources")

    # where each entry begins in its source's stream: sums of buckets, then inside the bucket
    buckets = max(1, -(-(totals[1] or 0) // BUCKET_ROWS))
    plan = maybe_broadcast(sources.withColumnRenamed("source", "__source"), 1_000_000)
    rows = (entries.join(plan, F.col("source").eqNullSafe(F.col("__source")))
            .withColumn("bucket", F.pmod(F.xxhash64("h", "part", F.lit(seed)), F.lit(buckets))))
    sums = rows.groupBy("idx", "bucket").agg(F.sum(words).alias("held"))
    before = W.partitionBy("idx").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("idx", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = (W.partitionBy("idx", "bucket").orderBy("h", "part", "doc_id", "size")
              .rowsBetween(W.unboundedPreceding, -1))
    placed = (rows.join(sums, ["idx", "bucket"])
              .withColumn("start", F.col("base") + F.coalesce(F.sum(words).over(inside), F.lit(0))))
    # one row per document again
    one = (placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
           .withColumn("first", F.col("start") + F.col("copy") * F.col("size")))
    documents = staged(one.select("entry", "copy", "doc_id", "source", "h", "size", F.col("words").alias("source_size"),
                                  "target", "idx", "first", "blocks", "quota", "cut"), "mix-documents")

    drawn = _drawn(documents, block, seed).withColumn("cell", F.expr(f"at div {CELL}"))
    ranges = _shard_ranges(sources, shard_blocks, seed).withColumn(
        "cell", F.explode(F.expr(f"sequence(first div {CELL}, (first + n - 1) div {CELL})")))
    found = (drawn.join(ranges, ["idx", "cell"])
             .filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n"))))
    local = W.partitionBy("shard").orderBy(F.xxhash64("idx", "at", F.lit(seed)), "idx", "at", "first_word", "entry", "copy")
    slices = (found.drop("first", "n", "cell")
              .join(documents.select("entry", "copy", "doc_id", "source", "h", F.col("first").alias("first_word")), ["entry", "copy"])
              .withColumn("place", F.row_number().over(local))
              .select("shard", "place", "entry", "copy", "doc_id", "source", "h", "epoch", "block", "word_from", "word_to"))
    return Mix(documents.drop("idx", "first", "blocks", "quota", "cut"), slices, sources)


def taken_words(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, summed over the mix's slices."""
    taken = mix.slices.groupBy("entry", "copy").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return (mix.documents.join(taken, ["entry", "copy"], "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """(shard, place, doc_id, source, epoch, text): the mix's slices with their words, joined by single spaces."""
    texts = docs.select(F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"),
                        F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    # equal rows have one text
    texts = texts.groupBy("h", "__id").agg(F.first("text").alias("text"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), 0)
    cut = F.slice(words, (F.col("word_from") + 1).cast("int"), (F.col("word_to") - F.col("word_from")).cast("int"))
    rows = mix.slices.withColumnRenamed("h", "__h")
    return (rows.join(texts, (F.col("__h") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("__id")))
            .select("shard", "place", "doc_id", "source", "epoch", F.array_join(cut, " ").alias("text")))
