"""Vector code compression: product quantisation trained by cover-tree Lloyd rounds.

Every block of up to ``BLOCK`` vectors holds, for each part position, a cover
tree over its part vectors, built once and written to the shared folder.  A
node covers a run of the block's points within a radius of one of them, and
running sums over the points in tree order give the sum of any node in one
subtraction.  A Lloyd round walks the trees from their roots: by the triangle
inequality a node goes to a codebook entry as a whole when the second nearest
entry is farther from its centre than the nearest by over twice the radius;
only ambiguous nodes descend, and only ambiguous leaves compare their points,
in exact integers.  A round moves one row per codebook component and block
group; the driver holds the codebooks alone (entries x width integers).

Defined results for odd input
- Rows whose vector is NULL or holds a NULL or non-finite component are dropped.
- Codebooks begin with the kept rows of the smallest ids (NULL ids after all
  others; equal ids by vector); with fewer rows than entries the codebook is
  that much smaller, and an empty table has no rows in the result.
- Vectors of different lengths are filled with zeros up to the longest length,
  rounded up to a multiple of the number of parts.
- Integer components are held within +-2^26, so that all sums fit 64 bits.
- Repeated rows are rows of their own.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.enrich import maybe_broadcast
from .common import map_arrow, staged

#: Vectors in a block, points in a leaf of a cover tree (at most).
BLOCK, LEAF = 1024, 4
LARGEST = 1 << 26
#: Below this magnitude all squared distances of a part are exact in doubles (width * 2^(2*22+2) < 2^53).
_EXACT_WIDTH, _EXACT = 64, 1 << 22


@dataclass
class Codebooks:
    """entries[part, entry, position], in integers of 1/scale."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# ------------------------------------------------------------------ distances

def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer rows of ``a`` and of ``b``."""
    small = a.shape[1] <= _EXACT_WIDTH and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < _EXACT
    kind = np.float64 if small else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]


# ------------------------------------------------------------------ cover trees

def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of the points of a block.

    ``order`` puts every node's points next to each other; nodes are rows
    (centre, low, high, radius, first child, children) in breadth-first order,
    the centre a point's number, the radius rounded up.  Children of a node are
    a net of its points at half its radius, each point with the first centre
    that covers it.
    """
    far = np.sqrt(np.maximum(squared(points, points).astype(np.float64), 0))
    order = np.arange(len(points))
    nodes = [[0, 0, len(points), float(far[0].max(initial=0)), 0, 0]]
    k = 0
    while k < len(nodes):
        centre, low, high, radius = nodes[k][:4]
        k += 1
        if high - low <= LEAF or radius == 0:
            continue
        rest, runs, p = order[low:high], [], centre
        while len(rest):
            d = far[p, rest]
            near = d <= radius / 2
            runs.append((p, rest[near], float(d[near].max(initial=0))))
            rest = rest[~near]
            p = rest[0] if len(rest) else -1
        nodes[k - 1][4:] = [len(nodes), len(runs)]
        for p, run, r in runs:
            order[low: low + len(run)] = run
            nodes.append([int(p), low, low + len(run), r, 0, 0])
            low += len(run)
    return order, np.array(nodes, np.float64)


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0]+1, ... (n[0] numbers), low[1], ..."""
    return np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def descend(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, codebook: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, entry) of the subtrees that go to an entry as a whole, and the points left to compare."""
    runs, loose, at = [], [], np.array([0])
    while len(at):
        d = np.sqrt(np.maximum(squared(points[nodes[at, 0].astype(np.int64)], codebook).astype(np.float64), 0))
        best, row = d.argmin(1), np.arange(len(at))
        near = d[row, best]
        d[row, best] = np.inf
        # the margin is far above the rounding of the roots
        whole = d.min(1) - near > 2 * nodes[at, 3] * (1 + 1e-9) + 1e-6 * (1 + near)
        runs.append((nodes[at[whole], 1], nodes[at[whole], 2], best[whole]))
        at = at[~whole]
        inner = nodes[at, 5] > 0
        leaf = nodes[at[~inner], 1:3].astype(np.int64)
        loose.append(order[_spread(leaf[:, 0], leaf[:, 1] - leaf[:, 0])])
        at = _spread(*nodes[at[inner], 4:6].astype(np.int64).T)
    low, high, entry = (np.concatenate(x).astype(np.int64) for x in zip(*runs, strict=True))
    return low, high, entry, np.concatenate(loose)


def nearest(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest entry (ties: the lowest) of every point, and how many points were compared one by one."""
    low, high, entry, loose = descend(points, order, nodes, codebook)
    code = np.empty(len(points), np.int64)
    code[order[_spread(low, high - low)]] = np.repeat(entry, high - low)
    code[loose] = squared(points[loose], codebook).argmin(1)
    return code, len(loose)


def entry_sums(points: np.ndarray, order: np.ndarray, nodes: np.ndarray, codebook: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """(count, sum) of the points nearest to each entry; whole subtrees by differences of running sums."""
    low, high, entry, loose = descend(points, order, nodes, codebook)
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    entry = np.concatenate([entry, squared(points[loose], codebook).argmin(1)])
    n = np.concatenate([high - low, np.ones(len(loose), np.int64)])
    total = np.concatenate([running[high] - running[low], points[loose]])
    by = np.argsort(entry, kind="stable")
    there, first = np.unique(entry[by], return_index=True)
    counts, sums = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64)
    counts[there], sums[there] = np.add.reduceat(n[by], first), np.add.reduceat(total[by], first, axis=0)
    return counts, sums


# ------------------------------------------------------------------ blocks of vectors

def _blocks(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """One row per block: ids, labels, the integer components, and for each part its order and nodes."""
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    tree = "array<struct<sorted:binary,nodes:binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, BLOCK):
                rows = b.slice(low, BLOCK)
                lists, n = rows.column(2), rows.num_rows
                lengths = np.diff(lists.offsets.to_numpy())
                x = np.zeros((n, width), np.int64)
                at = np.arange(width)[None, :] < lengths[:, None]
                x[at] = lists.flatten().to_numpy(zero_copy_only=False)
                trees = []
                for p in np.split(x, parts, axis=1):
                    order, nodes = cover_tree(p)
                    trees.append({"sorted": order.astype("<i4").tobytes(), "nodes": nodes.astype("<f8").tobytes()})
                one = pa.array([0, n], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, rows.column(0)), pa.ListArray.from_arrays(one, rows.column(1)),
                     pa.array([_packed(x)], pa.binary()),
                     pa.array([trees], pa.list_(pa.struct([("sorted", pa.binary()), ("nodes", pa.binary())])))],
                    ["ids", "labels", "x", "trees"])

    return staged(map_arrow(kept, run, f"ids array<{fields['id']}>, labels array<{fields['label']}>, x binary, trees {tree}"),
                  "vector-blocks")


def _packed(x: np.ndarray) -> bytes:
    """Integers in 16 bits where they all fit, else in 32, behind one byte that says so."""
    small = np.abs(x).max(initial=0) < 1 << 15
    return (b"\x02" if small else b"\x04") + x.astype("<i2" if small else "<i4").tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).reshape(-1, width).astype(np.int64)


def _trees(row: dict, width: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for p, t in zip(np.split(_unpacked(row["x"], width), parts, axis=1), row["trees"], strict=True):
        yield p, np.frombuffer(t["sorted"], "<i4").astype(np.int64), np.frombuffer(t["nodes"], "<f8").reshape(-1, 6)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one Lloyd round."""
    parts, size, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, size), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            for row in b.to_pylist():
                for k, (p, order, nodes) in enumerate(_trees(row, parts * wide, parts)):
                    c, s = entry_sums(p, order, nodes, books[k])
                    counts[k] += c
                    sums[k] += s
        part, entry = np.nonzero(counts)
        slot = ((part * size + entry)[:, None] * (wide + 1) + np.arange(wide + 1)).ravel()
        value = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(value, pa.int64())], ["slot", "value"])

    added = map_arrow(blocks.select("x", "trees"), run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value"))
    # entries x (width + 1) numbers, however many vectors there are
    got = added.toArrow()
    table = np.zeros((parts * size) * (wide + 1), np.int64)
    table[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    table = table.reshape(parts, size, wide + 1)
    n = table[..., :1]
    return np.where(n > 0, table[..., 1:] // np.maximum(n, 1), books)


def _first_books(kept: DataFrame, size: int, width: int, parts: int) -> np.ndarray:
    rows = kept.orderBy(F.asc_nulls_last("id"), "x").limit(size).select("x").collect()
    x = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r["x"])] = r["x"]
    return np.stack(np.split(x, parts, axis=1))


@dataclass
class Compressed:
    """codes: (id, label, code binary, error); codebooks: the trained entries."""

    codes: DataFrame
    codebooks: Codebooks


def compress_vectors(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
                     id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> Compressed:
    """Codes of all vectors under codebooks trained on all of them by ``rounds`` Lloyd rounds."""
    v = F.col("v")
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    whole = F.transform(v, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
        F.greatest(F.lit(-1e15), F.least(F.lit(1e15), c * scale))))).cast("int"))
    kept = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                           F.col(vec_col).cast("array<double>").alias("v"))
            .filter(good).select("id", "label", whole.alias("x")))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-max(longest, 1) // parts) * parts
    books = _first_books(kept, entries, width, parts)
    blocks = _blocks(kept, width, parts)
    if books.shape[1]:
        for _ in range(rounds):
            books = _round(blocks, books)
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, row in enumerate(b.select(["x", "trees"]).to_pylist()):
                codes, error = [], 0
                for book, (p, order, nodes) in zip(books, _trees(row, width, parts), strict=True):
                    code, _ = nearest(p, order, nodes, book)
                    codes.append(code.astype(np.uint8 if entries <= 256 else ">u2"))
                    error = error + ((p - book[code]) ** 2).sum(1)
                packed = [x.tobytes() for x in np.stack(codes, axis=1)]
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column(0).flatten(), one.column(1).flatten(), pa.array(packed, pa.binary()), pa.array(error, pa.int64())],
                    ["id", "label", "code", "error"])

    codes = map_arrow(blocks.select("ids", "labels", "x", "trees"), run,
                      f"id {fields['id']}, label {fields['label']}, code binary, error long")
    return Compressed(staged(codes, "vector-codes"), Codebooks(books))


def decompress(codes: DataFrame, books: Codebooks, scale: int = 1024) -> DataFrame:
    """(id, vector): the codebook entries of each code, as doubles (for up to 256 entries)."""
    table = books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, parts = b.num_rows, table.shape[0]
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, parts)
            x = np.concatenate([table[k][code[:, k]] for k in range(parts)], axis=1) / scale
            ends = pa.array(np.arange(n + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "vector"])

    kind = codes.schema["id"].dataType.simpleString()
    return map_arrow(codes.select("id", "code"), run, f"id {kind}, vector array<double>")


def code_report(found: Compressed) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector; code and digest in lowercase hex."""
    per_label = found.codes.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error"))
    return (found.codes.join(maybe_broadcast(per_label, 1_000_000), F.col("label").eqNullSafe(F.col("__l")))
            .select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
                    F.lit(found.codebooks.digest()).alias("codebooks_sha256")))
