"""Boosted regression trees on binned rows: the trees of Spark's learner, grown on blocks of small numbers.

Rows are binned once.  A block holds the bins of some rows, a byte an entry
for short vectors and the entries that are not 0 for long ones, so a level of
a tree costs a count of bins and no walk over row objects.  Rows that fit into
``LOCAL_BYTES`` are sent to one task that grows all trees of a fit; searches
run their fits at once, each in a task of its own.  Larger frames stay spread
over the cluster, and a level is one job that adds up the blocks' histograms.

Splits, bags, feature subsets and stops follow Spark's learner: its candidate
thresholds, its random numbers, its order of nodes.
"""

from __future__ import annotations

import math
import pickle
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions._util import named

#: Vectors of up to so many entries are held whole, longer ones by their entries that are not 0.
NARROW = 64
#: Bytes of blocks that one task, and the driver on the way there, may hold.
LOCAL_BYTES = 64 * 1024 * 1024
#: Rows and entries of a block, and cells of a histogram that are judged at once.
BLOCK_ROWS, BLOCK_ENTRIES, CELLS = 1 << 15, 4_000_000, 1 << 16
#: Rows that are led through a tree at once: their numbers stay in the processor's cache.
CACHED = 1 << 15
#: A state is derived from the one before it for so many trees, then from the first rows again.
CHAIN = 16
#: Impurity below which Spark's learner does not split.
EPSILON = 2.220446049250313e-16
BLOCK = "part long, start long, n long, label binary, ptr binary, rows binary, bins binary"


# ------------------------------------------------------------------ Spark's random numbers

def _mix(h: int, k: int) -> int:
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = ((k << 15 | k >> 17) * 0x1B873593) & 0xFFFFFFFF
    h ^= k
    return ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF


def _murmur(data: bytes, h: int) -> int:
    for i in range(0, len(data), 4):
        h = _mix(h & 0xFFFFFFFF, int.from_bytes(data[i:i + 4], "little"))
        h &= 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def _start(seed: int) -> int:
    """The first state of Spark's XORShiftRandom."""
    data = (seed & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(x):
    x = x ^ (x << np.uint64(21))
    x = x ^ (x >> np.uint64(35))
    return x ^ (x << np.uint64(4))


def _tables(images: np.ndarray) -> np.ndarray:
    """A linear map of 64 bits, given by the images of the single bits, as eight tables by byte."""
    out = np.zeros((8, 256), np.uint64)
    for k in range(8):
        for b in range(8):
            out[k, 1 << b:2 << b] = out[k, :1 << b] ^ images[8 * k + b]
    return out


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    by = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)
    out = tables[0][by[:, 0]]
    for k in range(1, 8):
        out ^= tables[k][by[:, k]]
    return out


@lru_cache(maxsize=64)
def _jump(power: int) -> np.ndarray:
    """The tables of 2^power steps."""
    images = _step(np.uint64(1) << np.arange(64, dtype=np.uint64)) if power == 0 else None
    if images is None:
        half = _jump(power - 1)
        images = _mapped(half, _mapped(half, np.uint64(1) << np.arange(64, dtype=np.uint64)))
    return _tables(images)


def xorshift_doubles(seed: int, count: int) -> np.ndarray:
    """The first ``count`` doubles of XORShiftRandom(seed)."""
    states = np.empty(max(2 * count, 1), np.uint64)
    states[0] = _step(np.array([_start(seed)], np.uint64))[0]
    have, power = 1, 0
    while have < len(states):
        more = min(have, len(states) - have)
        states[have:have + more] = _mapped(_jump(power), states[:more])
        have, power = 2 * have, power + 1
    states = states[:2 * count]
    high, low = states[0::2] & np.uint64((1 << 26) - 1), states[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


class _JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _bits(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        v = self.state >> 16
        return v - (1 << 32) if v >> 31 else v

    def long(self) -> int:
        return (self._bits() << 32) + self._bits()


def _reservoir(width: int, kept: int, seed: int) -> list[int]:
    """Which ``kept`` of the features 0 to ``width`` - 1 Spark's reservoir holds in the end."""
    out = list(range(kept))
    for at, u in zip(range(kept, width), xorshift_doubles(seed, width - kept)):
        to = int(u * (at + 1))
        if to < kept:
            out[to] = at
    return out


# ------------------------------------------------------------------ blocks

@dataclass(frozen=True)
class Plan:
    """What a fit asks for; ``per_node`` features are drawn for a node out of all."""

    trees: int
    depth: int
    rate: float
    min_rows: int
    min_gain: float
    subsample: float
    per_node: int
    seed: int


@dataclass
class Bins:
    """The thresholds of each feature; cell offsets[f] + b is bin b of feature f."""

    thresholds: list

    def __post_init__(self):
        self.offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.thresholds])]).astype(np.int64)
        self.zero = self.offsets[:-1] + np.array([np.searchsorted(t, 0.0) for t in self.thresholds], np.int64)
        self.width = len(self.thresholds)


class Block:
    """Bins of ``n`` rows, those from ``start`` on of partition ``part``; ``rows`` is None where every entry is held."""

    def __init__(self, row: dict, bins: Bins):
        self.part, self.start, self.n = row["part"], row["start"], row["n"]
        self.label = np.frombuffer(row["label"], np.float64)
        self.bins = np.frombuffer(row["bins"], np.uint8)
        if row["ptr"]:
            self.ptr, self.rows = np.frombuffer(row["ptr"], np.int64), np.frombuffer(row["rows"], np.int32)
            self.cells = np.repeat(bins.offsets[:-1].astype(np.int32), np.diff(self.ptr))
            self.cells += self.bins
        else:
            self.ptr = self.rows = None
            self.bins = self.bins.reshape(bins.width, self.n)

    def bag(self, plan: Plan, seed: int) -> np.ndarray | None:
        """Which rows a tree is grown on; None: all."""
        if plan.subsample >= 1.0:
            return None
        return xorshift_doubles(seed + self.part + 1, self.start + self.n)[self.start:] < plan.subsample

    def step(self, tree: Tree, node: np.ndarray, bins: Bins) -> np.ndarray:
        """The nodes one level below ``node``; a leaf stays."""
        feature, split, left = tree.arrays()
        if self.rows is None:
            flat, out = self.bins.ravel(), np.empty(self.n, np.int64)
            for a in range(0, self.n, CACHED):
                here = node[a:a + CACHED]
                at = feature[here] * self.n
                at += np.arange(a, a + len(here))
                np.add(left[here], flat[at] > split[here], out=out[a:a + CACHED])
            return out
        out = node.copy()
        for j in np.flatnonzero(np.bincount(node, minlength=len(left))):
            if left[j] != j:
                f = feature[j]
                over = np.full(self.n, bins.zero[f] - bins.offsets[f] > split[j])
                at = slice(self.ptr[f], self.ptr[f + 1])
                over[self.rows[at]] = self.bins[at] > split[j]
                here = np.flatnonzero(node == j)
                out[here] = left[j] + over[here]
        return out

    def leaves(self, tree: Tree, bins: Bins, levels: int) -> np.ndarray:
        node = np.zeros(self.n, np.int64)
        for _ in range(levels):
            node = self.step(tree, node, bins)
        return node

    def weighted(self, r: np.ndarray) -> tuple[list, list]:
        """(sums that histograms take of the rows, the same by entry); the entries of a whole block are its rows."""
        rows = [None, r, r * r]
        return rows, rows if self.rows is None else [None, *(w[self.rows] for w in rows[1:])]

    def histogram(self, slot: np.ndarray, weights: tuple, count: int, first: int, last: int, bins: Bins) -> list[np.ndarray]:
        """For the features first to last - 1: count x cells, the rows of each slot by cell and the sums of ``weights``."""
        lo, size = bins.offsets[first], int(bins.offsets[last] - bins.offsets[first])
        out = []
        if self.rows is None:  # one feature
            key = slot * size
            key += self.bins[first]
            for w in weights[1]:
                out.append(np.bincount(key, w, (count + 1) * size).reshape(count + 1, size)[:count])
            return out
        at = slice(self.ptr[first], self.ptr[last])
        key = slot[self.rows[at]]
        key *= size
        key += self.cells[at]
        key -= lo
        edges = (bins.offsets[first:last] - lo).astype(np.int64)
        for w, own in zip(*weights):
            h = np.bincount(key, None if own is None else own[at], (count + 1) * size).reshape(count + 1, size)[:count].astype(np.float64)
            every = np.bincount(slot, w, count + 1)[:count, None]
            h[:, bins.zero[first:last] - lo] += every - np.add.reduceat(h, edges, axis=1)
            out.append(h)
        return out


def chunks(bins: Bins, count: int, narrow: bool) -> list[tuple[int, int]]:
    """Runs of features whose cells for ``count`` nodes are judged at once."""
    if narrow:
        return [(f, f + 1) for f in range(bins.width)]
    out, first = [], 0
    for f in range(1, bins.width + 1):
        if f == bins.width or (bins.offsets[f + 1] - bins.offsets[first]) * (count + 1) > CELLS:
            out.append((first, f))
            first = f
    return out


def best_splits(hist: list[np.ndarray], parents: np.ndarray, edges: np.ndarray, plan: Plan) -> np.ndarray:
    """(8, nodes, features): gain and bin of each feature's best split; rows, sum and sum of squares left and right of it.

    ``parents`` has these three sums of each node.  All is added up in the order of Spark's learner, so that splits of
    equal gain are told apart by the same roundings.
    """
    sizes = np.diff(edges)
    left, right = [], []
    for h in hist:
        c = np.cumsum(h, axis=1, dtype=np.float64)
        if len(sizes) > 1:
            before = np.concatenate([np.zeros((len(c), 1)), c[:, edges[1:-1] - 1]], axis=1)
            c -= np.repeat(before, sizes, axis=1)
        left.append(c)
        right.append(np.repeat(c[:, edges[1:] - 1], sizes, axis=1) - c)
    nl, nr = left[0], right[0]
    whole = (parents[:, 2] - parents[:, 1] * parents[:, 1] / parents[:, 0]) / parents[:, 0]
    n = nl + nr
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.repeat(whole[:, None], n.shape[1], axis=1)
        for rows, total, squares in (left, right):
            impurity = total * total
            impurity /= rows
            np.subtract(squares, impurity, out=impurity)
            impurity /= rows
            impurity *= rows / n
            gain -= impurity
    gain[(nl < plan.min_rows) | (nr < plan.min_rows) | ~(gain >= plan.min_gain)] = -np.inf
    gain[:, edges[1:] - 1] = -np.inf
    top = np.maximum.reduceat(gain, edges[:-1], axis=1)
    place = np.where(gain == np.repeat(top, sizes, axis=1), np.arange(gain.shape[1]), gain.shape[1])
    at = np.minimum.reduceat(place, edges[:-1], axis=1)
    return np.stack([top, at - edges[:-1], *(np.take_along_axis(x, at, axis=1) for x in (*left, *right))])


# ------------------------------------------------------------------ one tree

class Tree:
    """Nodes by number, the root 0; a leaf's children are -1."""

    def __init__(self):
        self.feature, self.split, self.left, self.right, self.gain, self.stats = [0], [0], [-1], [-1], [0.0], [None]
        self._arrays = None

    def grow(self, j: int, feature: int, split: int, gain: float) -> tuple[int, int]:
        self.feature[j], self.split[j], self.gain[j] = feature, split, gain
        self.left[j], self.right[j] = len(self.left), len(self.left) + 1
        for _ in range(2):
            for held, v in ((self.feature, 0), (self.split, 0), (self.left, -1), (self.right, -1), (self.gain, 0.0), (self.stats, None)):
                held.append(v)
        self._arrays = None
        return self.left[j], self.right[j]

    def arrays(self):
        """feature, split, left; a right child is the one behind the left, a leaf leads to itself."""
        if self._arrays is None:
            left = np.array(self.left)
            self._arrays = (np.array(self.feature, np.int64), np.where(left < 0, 256, self.split), np.where(left < 0, np.arange(len(left)), left))
        return self._arrays

    def values(self) -> np.ndarray:
        return np.array([s[1] / s[0] if s[0] else 0.0 for s in self.stats])


def _impurity(stats) -> float:
    n, s, q = stats
    return (q - s * s / n) / n if n else 0.0


def grow_tree(plan: Plan, seed: int, bins: Bins, evaluate) -> Tree:
    """``evaluate(tree, nodes, depth)`` gives (sums of the nodes, their :func:`best_splits` over all features).

    Nodes are taken in the order of Spark's stack, as they draw their features one after the other.
    """
    tree, level, rng = Tree(), [0], _JavaRandom(seed)
    usable = np.diff(bins.offsets) > 1
    for depth in range(plan.depth):
        if not level:
            break
        sums, best = evaluate(tree, level, depth)
        if depth == 0:
            tree.stats[0] = tuple(map(float, sums[0]))
        pushed = []
        for i, j in enumerate(level):
            order = _reservoir(bins.width, plan.per_node, rng.long()) if plan.per_node < bins.width else np.arange(bins.width)
            gains = np.where(usable[order], best[0, i][order], -np.inf)
            f = int(order[int(np.argmax(gains))])
            if gains.max() > 0:
                children = tree.grow(j, f, int(best[1, i, f]), float(best[0, i, f]))
                for c, stats in zip(children, (best[2:5, i, f], best[5:, i, f])):
                    tree.stats[c] = tuple(map(float, stats))
                    if abs(_impurity(tree.stats[c])) >= EPSILON:
                        pushed.append(c)
        level = pushed[::-1]
    if tree.stats[0] is None:
        tree.stats[0] = tuple(map(float, evaluate(tree, [0], 0)[0][0]))
    return tree


def _slots(tree: Tree, level: list[int]) -> np.ndarray:
    """The place of each node in ``level``; of any other, the number of nodes there."""
    slot = np.full(len(tree.left), len(level), np.int64)
    slot[level] = np.arange(len(level))
    return slot


def _totals(slot: np.ndarray, r: np.ndarray, count: int) -> np.ndarray:
    return np.stack([np.bincount(slot, w, count + 1)[:count] for w in (None, r, r * r)], axis=1)


def _residual(block: Block, pred: np.ndarray, number: int) -> np.ndarray:
    return block.label if number == 0 else 2.0 * (block.label - pred)


def watched(errors: list[float], patience: int | None) -> tuple[int, bool]:
    """(number of trees of the best prefix, whether growth stops there) when the trees are watched one by one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif patience is not None and i - best >= patience:
            return best + 1, True
    return best + 1, False


def boost(plan: Plan, blocks: list[Block], bins: Bins, held: list[Block] = (), metric: str = "rmse",
          patience: int | None = None, had: list[Tree] = ()) -> tuple[list[Tree], list[float]]:
    """(trees, error on ``held`` after each) of a whole fit inside one task; ``had`` are its first trees."""
    preds, checks = [np.zeros(b.n) for b in blocks], [np.zeros(b.n) for b in held]
    trees, errors = list(had), []
    for m, tree in enumerate(trees):
        for b, p in zip(blocks, preds):
            p += (tree.values() * (1.0 if m == 0 else plan.rate))[b.leaves(tree, bins, plan.depth)]
    for m in range(len(trees), plan.trees):
        residuals = [_residual(b, p, m) for b, p in zip(blocks, preds)]
        weights = [b.weighted(r) for b, r in zip(blocks, residuals)]
        bags = [b.bag(plan, plan.seed + m) for b in blocks]
        nodes, reached = [np.zeros(b.n, np.int64) for b in blocks], [0]

        def evaluate(tree, level, depth):
            while reached[0] < depth:
                nodes[:] = [b.step(tree, x, bins) for b, x in zip(blocks, nodes)]
                reached[0] += 1
            lookup, k = _slots(tree, level), len(level)
            slots = [lookup[x] if bag is None else np.where(bag, lookup[x], k) for x, bag in zip(nodes, bags)]
            sums = np.array([tree.stats[j] for j in level]) if depth else sum(_totals(s, r, k) for s, r in zip(slots, residuals))
            found = []
            for first, last in chunks(bins, k, blocks[0].rows is None):
                parts = [b.histogram(s, w, k, first, last, bins) for b, s, w in zip(blocks, slots, weights)]
                found.append(best_splits([sum(x) for x in zip(*parts)], sums, bins.offsets[first:last + 1] - bins.offsets[first], plan))
            return sums, np.concatenate(found, axis=2)

        tree = grow_tree(plan, plan.seed + m, bins, evaluate)
        trees.append(tree)
        values = tree.values() * (1.0 if m == 0 else plan.rate)
        for b, p, x in zip(blocks, preds, nodes):
            for _ in range(plan.depth - reached[0]):
                x = b.step(tree, x, bins)
            p += values[x]
        if held:
            for b, p in zip(held, checks):
                p += values[b.leaves(tree, bins, plan.depth)]
            off = [b.label - p for b, p in zip(held, checks)]
            n = sum(b.n for b in held)
            errors.append(math.sqrt(sum(float(x @ x) for x in off) / n) if metric == "rmse" else sum(float(np.abs(x).sum()) for x in off) / n)
            if watched(errors, patience)[1]:
                break
    return trees, errors


# ------------------------------------------------------------------ from frames to blocks

def _parts(df: DataFrame, features_col: str, label_col: str) -> DataFrame:
    v = F.unwrap_udt(named(features_col))
    return df.select(named(label_col).cast("double").alias("label"), v["indices"].alias("indices"), v["values"].alias("values"))


def _entries(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the entries that vectors hold, dense or sparse."""
    if values.null_count:
        raise ValueError("vectors must not be NULL")
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = indices.is_valid().to_numpy(zero_copy_only=False)[row]
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    value = values.flatten().to_numpy(zero_copy_only=False)
    if not np.isfinite(value).all():
        raise ValueError("features must not be NULL, NaN or infinite")
    return row, feature, value


def thresholds_of(values: np.ndarray, counts: np.ndarray, sampled: float, splits: int) -> np.ndarray:
    """Spark's candidate thresholds of a feature from its distinct values but 0 in a sample of ``sampled`` rows."""
    seen = float(counts.sum())
    if not len(values) or splits < 1:
        return np.zeros(0)
    if sampled - seen > EPSILON * seen * 100:
        values, counts = np.append(values, 0.0), np.append(counts.astype(np.float64), sampled - seen)
    order = np.argsort(values)
    values, counts = values[order], counts[order].astype(np.float64)
    if len(values) - 1 <= splits:
        return (values[:-1] + values[1:]) / 2.0
    stride, out = sampled / (splits + 1), []
    target, now = stride, float(counts[0])
    for i, c in enumerate(counts[1:].tolist(), 1):
        before, now = now, now + c
        if abs(before - target) < abs(now - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def find_bins(rows: DataFrame, n: int, width: int, max_bins: int, seed: int) -> Bins:
    """Thresholds of all features from a sample as large as Spark's learner takes, all rows where there are fewer."""
    splits = min(max_bins, n)
    need = max(splits * splits, 10_000)
    fraction = min(1.0, need / n)
    sample = rows if fraction == 1.0 else rows.sample(False, fraction, seed)

    def run(batches):
        for b in batches:
            _, feature, value = _entries(b.column(1), b.column(2))
            kept = np.flatnonzero(value != 0.0)
            order = kept[np.lexsort((value[kept], feature[kept]))]
            f, v = feature[order], value[order]
            first = np.flatnonzero(np.append(True, (np.diff(f) > 0) | (np.diff(v) > 0))[:len(f)])
            yield pa.RecordBatch.from_arrays([pa.array(f[first].astype(np.int32)), pa.array(v[first]),
                                              pa.array(np.diff(np.append(first, len(f))))], ["feature", "value", "count"])

    def one(t: pa.Table) -> pa.Table:
        value, place = np.unique(t.column("value").to_numpy(), return_inverse=True)
        counts = np.bincount(place, t.column("count").to_numpy())
        return pa.table({"feature": t.column("feature")[:1].cast(pa.int32()),
                         "thresholds": pa.array([thresholds_of(value, counts, fraction * n, splits - 1)], pa.list_(pa.float64()))})

    got = (sample.mapInArrow(run, "feature int, value double, count long").groupBy("feature")
           .applyInArrow(one, "feature int, thresholds array<double>").toArrow())
    out = [np.zeros(0)] * width
    for f, t in zip(got.column("feature").to_pylist(), got.column("thresholds").to_pylist()):
        out[f] = np.array(t)
    return Bins(out)


def blocks_of(rows: DataFrame, bins: Bins) -> DataFrame:
    """A row of ``BLOCK`` for every run of rows, in the order and partitions they come in."""
    width, narrow = bins.width, bins.width <= NARROW

    def run(batches):
        part, start, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            label = np.concatenate([x[0] for x in held])
            if not np.isfinite(label).all():
                raise ValueError("labels must not be NULL, NaN or infinite")
            if narrow:
                ptr, rows_, cells = b"", b"", np.concatenate([x[1] for x in held], axis=1).tobytes()
            else:
                firsts = np.cumsum([0] + [len(x[0]) for x in held])
                row = np.concatenate([x[1] + a for x, a in zip(held, firsts)]).astype(np.int32)
                feature, cell = (np.concatenate([x[i] for x in held]) for i in (2, 3))
                order = np.argsort(feature, kind="stable")
                ptr = np.concatenate([[0], np.cumsum(np.bincount(feature, minlength=width))]).astype(np.int64).tobytes()
                rows_, cells = row[order].tobytes(), cell[order].tobytes()
            return pa.RecordBatch.from_pydict({"part": [part], "start": [start], "n": [len(label)], "label": [label.tobytes()],
                                               "ptr": [ptr], "rows": [rows_], "bins": [cells]})

        for b in batches:
            label = pc.fill_null(b.column(0), math.nan).to_numpy(zero_copy_only=False)
            row, feature, value = _entries(b.column(1), b.column(2))
            if narrow:
                x = np.zeros((width, b.num_rows))
                x[feature, row] = value
                held.append((label, np.stack([np.searchsorted(t, x[f]) for f, t in enumerate(bins.thresholds)]).astype(np.uint8)))
                size += width * b.num_rows
            else:
                order = np.argsort(feature, kind="stable")
                row, feature, value = row[order], feature[order], value[order]
                cell = np.empty(len(feature), np.uint8)
                ends = np.flatnonzero(np.append(np.diff(feature) > 0, True)[:len(feature)]) + 1
                at = 0
                for to in ends.tolist():
                    f = feature[at]
                    cell[at:to] = np.searchsorted(bins.thresholds[f], value[at:to])
                    at = to
                held.append((label, row, feature, cell))
                size += len(feature)
            if size >= BLOCK_ENTRIES or narrow and sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                yield block()
                start, held, size = start + sum(len(x[0]) for x in held), [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCK)


def _unpacked(rows: list[dict], bins: Bins) -> list[Block]:
    """Blocks in order; short vectors of one partition are one block again, so that sums are taken row by row."""
    out = []
    for r in sorted(rows, key=lambda r: (r["part"], r["start"])):
        new = Block(r, bins)
        if out and new.rows is None and out[-1].part == new.part:
            old = out[-1]
            old.n, old.label, old.bins = old.n + new.n, np.append(old.label, new.label), np.concatenate([old.bins, new.bins], axis=1)
        else:
            out.append(new)
    return out


def _categorical(df: DataFrame, features_col: str) -> bool:
    attrs = (df.schema[features_col].metadata or {}).get("ml_attr", {}).get("attrs", {})
    return bool({"nominal", "binary"} & set(attrs))


def plan_of(options: dict, width: int, seed: int) -> Plan:
    """A plan from the names of Spark's learner, which gives the defaults."""
    strategy = str(options.get("featureSubsetStrategy", "all"))
    per_node = width if strategy in ("all", "auto") else math.ceil(float(strategy) * width)
    return Plan(int(options.get("maxIter", 20)), int(options.get("maxDepth", 5)), float(options.get("stepSize", 0.1)),
                int(options.get("minInstancesPerNode", 1)), float(options.get("minInfoGain", 0.0)),
                float(options.get("subsamplingRate", 1.0)), per_node, seed)


def _kept(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``df``, kept, and its rows under a plan of their own: plans of kept frames over kept frames would grow without end)."""
    spark = df.sparkSession
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    return df, DataFrame(rows, spark)


class Binned:
    """The blocks of a training frame, in the driver's hands where they are small, else kept in the cluster."""

    def __init__(self, data: DataFrame, n: int, width: int, features_col: str, label_col: str, seed: int, max_bins: int):
        self.spark, self.cols = data.sparkSession, (features_col, label_col)
        self.bins = find_bins(_parts(data, *self.cols), n, width, max_bins, seed)
        self.kept, self.blocks = _kept(blocks_of(_parts(data, *self.cols), self.bins))
        self.local = self.small(self.blocks)

    def small(self, blocks: DataFrame) -> list[dict] | None:
        """The blocks if they are within ``LOCAL_BYTES``."""
        size = blocks.agg(F.sum(F.length("label") + F.length("ptr") + F.length("rows") + F.length("bins"))).first()[0] or 0
        if size > LOCAL_BYTES:
            return None
        return blocks.toArrow().to_pylist()

    def close(self):
        self.kept.unpersist()

    def fits(self, plans: list[Plan], held: list[dict] | None = None, metric: str = "rmse", patience: int | None = None,
             had: list[Tree] = ()) -> list:
        """(trees, errors) of each plan, each grown in a task of its own, behind the trees it has already."""
        sent = self.spark.sparkContext.broadcast((self.local, held, self.bins, plans))

        def run(batches):
            local, check, bins, asked = sent.value
            blocks, checks = _unpacked(local, bins), _unpacked(check or [], bins)
            for b in batches:
                for i in b.column(0).to_pylist():
                    found = boost(asked[i], blocks, bins, checks, metric, patience, had)
                    yield pa.RecordBatch.from_pydict({"i": [i], "found": [pickle.dumps(found)]})

        try:
            rows = self.spark.range(0, len(plans), 1, len(plans)).mapInArrow(run, "i long, found binary").collect()
            return [pickle.loads(r["found"]) for r in sorted(rows, key=lambda r: r["i"])]
        finally:
            sent.unpersist()


class Grower:
    """Grows a fit to more and more trees; ``grow(n)`` gives the model of the first n."""

    def __init__(self, binned: Binned, plan: Plan, features_col: str):
        self.binned, self.plan, self.features_col = binned, plan, features_col
        self.trees: list[Tree] = []
        self.kept, self.state = None, None

    def grow(self, n: int) -> GBTRegressionModel:
        if len(self.trees) < n:
            if self.binned.local is not None:
                self.trees = self.binned.fits([replace(self.plan, trees=n)], had=self.trees)[0][0]
            else:
                for m in range(len(self.trees), n):
                    self._add(m)
        return to_model(self.binned.spark, self.trees[:n], self.plan, self.binned.bins, self.features_col)

    def close(self):
        if self.kept is not None:
            self.kept.unpersist()

    def _advance(self):
        """A state that holds the predictions of all trees so far."""
        m, bins, plan = len(self.trees), self.binned.bins, self.plan
        since = 0 if self.state is None or m % CHAIN == 0 else m - 1
        steps = [(t, t.values() * (1.0 if i == 0 else plan.rate)) for i, t in enumerate(self.trees)][since:]

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, bins)
                    pred = np.frombuffer(row["pred"], np.float64).copy() if row.get("pred") else np.zeros(block.n)
                    for tree, values in steps:
                        pred += values[block.leaves(tree, bins, plan.depth)]
                    yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in row.items()}, "pred": [pred.tobytes()]})

        source = self.binned.blocks if since == 0 else self.state
        return _kept(source.mapInArrow(run, BLOCK + ", pred binary"))

    def _add(self, m: int) -> None:
        bins, plan, seed = self.binned.bins, self.plan, self.plan.seed + m
        kept, source = self._advance() if m else (None, self.binned.blocks)

        def evaluate(tree, level, depth):
            known = np.array([tree.stats[j] for j in level]) if depth else None
            k, narrow = len(level), bins.width <= NARROW
            runs = chunks(bins, k, narrow)

            def sent(c, sums, cells):
                return pa.RecordBatch.from_pydict({"chunk": [c], "sums": [sums.astype(np.float64).tobytes()],
                                                   "cells": [cells.astype(np.float64).tobytes()]})

            def count(batches):
                held = {}  # the sums of a task's blocks of short vectors go together
                for b in batches:
                    for row in b.to_pylist():
                        block = Block(row, bins)
                        r = _residual(block, np.frombuffer(row["pred"], np.float64) if m else None, m)
                        slot = _slots(tree, level)[block.leaves(tree, bins, depth)]
                        bag = block.bag(plan, seed)
                        slot = slot if bag is None else np.where(bag, slot, k)
                        sums, weights = _totals(slot, r, k), block.weighted(r)
                        for c, (first, last) in enumerate(runs):
                            found = sums, np.stack(block.histogram(slot, weights, k, first, last, bins))
                            if narrow:
                                held[c] = tuple(map(np.add, held[c], found)) if c in held else found
                            else:
                                yield sent(c, *found)
                for c, found in held.items():
                    yield sent(c, *found)

            def judge(t: pa.Table) -> pa.Table:
                c = t.column("chunk")[0].as_py()
                first, last = runs[c]
                sums = known if depth else sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("sums")).reshape(k, 3)
                hist = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("cells")).reshape(3, k, -1)
                best = best_splits(list(hist), sums, bins.offsets[first:last + 1] - bins.offsets[first], plan)
                return pa.table({"chunk": [c], "sums": [sums.tobytes()], "best": [best.tobytes()]})

            got = (source.mapInArrow(count, "chunk long, sums binary, cells binary").groupBy("chunk")
                   .applyInArrow(judge, "chunk long, sums binary, best binary").collect())
            got.sort(key=lambda r: r["chunk"])
            return (np.frombuffer(got[0]["sums"], np.float64).reshape(k, 3),
                    np.concatenate([np.frombuffer(r["best"], np.float64).reshape(8, k, -1) for r in got], axis=2))

        self.trees.append(grow_tree(plan, seed, bins, evaluate))
        if m:
            self.close()
            self.kept, self.state = kept, source


def to_model(spark: SparkSession, trees: list[Tree], plan: Plan, bins: Bins, features_col: str) -> GBTRegressionModel:
    """Spark's model of these trees; inner nodes over two equal leaves are leaves, as Spark prunes them."""
    gateway = spark.sparkContext._gateway
    ml, util = gateway.jvm.org.apache.spark.ml, gateway.jvm.java.util.Arrays
    variance = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    made = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        numbers = _py2java(spark.sparkContext, Vectors.dense([x for s in tree.stats for x in s])).toArray()
        values, nodes, leaf = tree.values(), [None] * len(tree.left), [False] * len(tree.left)
        for j in reversed(range(len(tree.left))):
            stats = variance(util.copyOfRange(numbers, 3 * j, 3 * j + 3), int(tree.stats[j][0]))
            value, impurity = float(values[j]), float(_impurity(tree.stats[j]))
            a, b = tree.left[j], tree.right[j]
            if a < 0 or (leaf[a] and leaf[b] and values[a] == values[b]):
                nodes[j], leaf[j] = ml.tree.LeafNode(value, impurity, stats), True
            else:
                f = tree.feature[j]
                split = ml.tree.ContinuousSplit(f, float(bins.thresholds[f][tree.split[j]]))
                nodes[j] = ml.tree.InternalNode(value, impurity, tree.gain[j], nodes[a], nodes[b], split, stats)
        made[i] = ml.regression.DecisionTreeRegressionModel(f"dtr_{uuid.uuid4().hex[:12]}", nodes[0], bins.width)
        weights[i] = 1.0 if i == 0 else float(plan.rate)
    model = GBTRegressionModel(ml.regression.GBTRegressionModel(f"gbtr_{uuid.uuid4().hex[:12]}", made, weights, bins.width))
    return model.setFeaturesCol(features_col)


@contextmanager
def binned(data: DataFrame, n: int, width: int, features_col: str, label_col: str, seed: int, max_bins: int):
    """The :class:`Binned` rows of a frame, released afterwards; None where these trees do not serve."""
    if not n or not width or not 2 <= max_bins <= 256 or _categorical(data, features_col):
        yield None
        return
    found = Binned(data, n, width, features_col, label_col, seed, max_bins)
    try:
        yield found
    finally:
        found.close()
