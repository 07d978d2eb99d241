"""Principal components of dense or sparse rows by passes of partial sums.

Rows are never made dense and the covariance matrix is never built: a pass
multiplies the centred data by a thin block of directions and back, as one
``width x block`` partial sum per task.  The passes' results span a block
Krylov space, in which the leading components converge in a handful of
passes; the driver holds that basis (width x passes x block numbers), so the
width -- a vector length or a capped vocabulary -- bounds it, not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """mean (width), directions (width x k, unit, sign-fixed), variances (k), total variance, rows, passes over the data."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    rows: int
    passes: int


def _batches(batches: Iterator[pa.RecordBatch], width: int):
    """(row of each entry, place, value, rows) of each batch, for dense arrays and for lists of (place, value)."""
    for b in batches:
        lists = b.column(0)
        n = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        flat = lists.flatten()
        if pa.types.is_struct(flat.type):
            place, value = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
        else:
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            value = flat.to_numpy(zero_copy_only=False)
        yield row, place.astype(np.int64), value.astype(np.float64), b.num_rows


def _times(row: np.ndarray, place: np.ndarray, value: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """The batch's rows times ``v`` (width x block)."""
    return np.stack([np.bincount(row, value * v[place, j], minlength=n) for j in range(v.shape[1])], axis=1)


def _summed(vectors: DataFrame, run, size: int) -> np.ndarray:
    """Sum over all tasks of the array of ``size`` numbers that ``run`` returns for a task's batches."""
    def emit(batches):
        total = run(batches)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(total[slot])], ["slot", "value"])

    got = (vectors.mapInArrow(emit, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow())
    out = np.zeros(size)
    out[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    return out


def principal_components(vectors: DataFrame, vec_col: str, width: int, k: int = 2, block: int | None = None,
                         tol: float = 1e-10, max_passes: int = 60, seed: int = 42) -> Components:
    """The ``k`` leading principal components of ``vec_col``, centred.

    ``vec_col`` is an array of numbers, or an array of (place, value) structs
    for sparse rows; places and lengths stay below ``width``.  NULL vectors
    are left out; NULL or NaN entries raise.  Passes go on until the leading
    variances change by less than ``tol`` of the total variance, or the basis
    spans the whole space.  Variances have the divisor rows - 1; each
    direction's entry of largest magnitude is positive.
    """
    rows = vectors.select(F.col(vec_col).alias("v")).filter(F.col("v").isNotNull())
    block = min(width, block or max(8, 2 * k))

    def moments(batches):
        out = np.zeros(width + 2)
        for _, place, value, n in _batches(batches, width):
            out[:width] += np.bincount(place, value, minlength=width)[:width]
            out[width] += float(value @ value)
            out[width + 1] += n
        return out

    sums = _summed(rows, moments, width + 2)
    if not np.isfinite(sums).all():
        raise ValueError(f"{vec_col}: NULL, NaN or infinite entries have no principal components")
    n = int(sums[width + 1])
    if n < 2:
        return Components(np.zeros(width), np.zeros((width, k)), np.zeros(k), 0.0, n, 1)
    mean = sums[:width] / n
    total = max(0.0, (sums[width] - n * float(mean @ mean)) / (n - 1))

    def covariance_times(v: np.ndarray) -> np.ndarray:
        def products(batches):
            out = np.zeros((width, v.shape[1]))
            for row, place, value, count in _batches(batches, width):
                y = _times(row, place, value, count, v)
                for j in range(v.shape[1]):
                    out[:, j] += np.bincount(place, value * y[row, j], minlength=width)[:width]
            return out.ravel()
        z = _summed(rows, products, width * v.shape[1]).reshape(width, -1)
        return (z - n * np.outer(mean, mean @ v)) / (n - 1)

    rng = np.random.default_rng(seed)
    basis = images = np.zeros((width, 0))
    fresh, last, passes = rng.normal(size=(width, block)), np.full(k, np.inf), 1
    while True:
        for _ in range(2):  # twice is enough
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r, _ = np.linalg.svd(fresh, full_matrices=False)
        q = q[:, r > 1e-10 * max(1.0, r.max(initial=0.0))][:, : width - basis.shape[1]]
        if q.shape[1]:
            z = covariance_times(q)
            passes += 1
            basis, images = np.concatenate([basis, q], axis=1), np.concatenate([images, z], axis=1)
        small = basis.T @ images
        values, vectors_ = np.linalg.eigh((small + small.T) / 2)
        leading = values[::-1][:k]
        leading = np.pad(leading, (0, k - len(leading)))
        if (not q.shape[1] or basis.shape[1] >= width or passes > max_passes
                or np.abs(leading - last).max() <= tol * max(total, 1e-300)):
            break
        last, fresh = leading, z
    directions = basis @ vectors_[:, ::-1][:, :k]
    directions = np.pad(directions, ((0, 0), (0, k - directions.shape[1])))
    top = np.abs(directions).argmax(0)
    directions = directions * np.where(directions[top, np.arange(k)] < 0, -1.0, 1.0)
    return Components(mean, directions, np.maximum(leading, 0.0), total, n, passes)


def component_variances(found: Components, spark) -> DataFrame:
    """(component, variance, ratio), largest first."""
    return spark.createDataFrame([(i + 1, float(v), float(v / found.total) if found.total else 0.0)
                                  for i, v in enumerate(found.variances)], "component int, variance double, ratio double")


def project(vectors: DataFrame, id_col: str, vec_col: str, found: Components) -> DataFrame:
    """(id, pc1 ... pck): centred coordinates; NULL vectors have NULL coordinates."""
    k, width = found.directions.shape[1], len(found.mean)
    shift = found.mean @ found.directions
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            one = [pa.RecordBatch.from_arrays([b.column(1)], ["v"])]
            ((row, place, value, n),) = _batches(iter(one), width)
            y = _times(row, place, value, n, found.directions) - shift
            there = pa.array(b.column(1).is_valid())
            cols = [pc.if_else(there, pa.array(y[:, j]), pa.scalar(None, pa.float64())) for j in range(k)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *[f"pc{j + 1}" for j in range(k)]])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    out = rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"pc{j + 1} double" for j in range(k)))
    return out.withColumnRenamed("id", id_col)
