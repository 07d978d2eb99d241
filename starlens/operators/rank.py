"""Global positions in a total order, computed without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partitioning moves every row into
one task.  Here the rows are range-partitioned by the sort (Spark samples the
keys, so even a value shared by a third of the rows is spread by the
remaining sort columns), each row gets its index inside its sorted partition
from ``monotonically_increasing_id`` (partition id in the upper bits), and a
per-partition offset -- one row per partition -- turns that into the global
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import cut_lineage

_LOCAL_BITS = 33


def sorted_positions(df: DataFrame, order: list[Column], out_col: str = "position") -> DataFrame:
    """``df`` plus ``out_col`` = 0-based position in ``order``.

    ``order`` must be a total order (unique keys) for positions to be
    deterministic.  The sorted, id-tagged rows are checkpointed into the
    shared checkpoint folder, so the offset pass and the final projection
    read the same sort, and a lost executor recomputes from the files.
    """
    tagged = cut_lineage(df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id()))
    tagged = tagged.select("*", F.shiftright(F.col("__mid"), _LOCAL_BITS).alias("__pid"),
                           F.col("__mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("__loc"))
    per_part = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the running offset is a window over a partition-count sized table
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (tagged.join(F.broadcast(offsets), "__pid")
                  .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + F.col("__loc")).alias(out_col)))
