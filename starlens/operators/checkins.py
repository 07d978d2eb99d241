"""Check-in analysis: packed timestamps, counts per key and per time part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions.dates import date_part, parse_ts
from starlens.functions.text import elements
from starlens.functions.hours import DAY_NAMES

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Size of the filled domain of each time part (values outside are kept as-is).
_DOMAINS = {"weekday": (0, 6), "hour": (0, 23), "month": (1, 12)}


def explode_timestamps(df: DataFrame, col: str, sep: str = ", ", fmt: str = TS_FORMAT,
                       out_col: str = "ts", outer: bool = False) -> DataFrame:
    """One row per entry of a packed ``'ts, ts, ...'`` string column.

    NULL strings produce no row (``outer=True`` keeps one NULL row).
    Unparseable entries become NULL timestamps.
    """
    parts = F.split(F.col(col), sep)
    others = [c for c in df.columns if c != col]
    return (df.select(*others, elements(parts, "_entry", outer))
              .select(*others, parse_ts(F.col("_entry"), fmt).alias(out_col)))


def count_by(df: DataFrame, keys, name: str = "n") -> DataFrame:
    """Row count per key; rows with a NULL key are dropped (pandas semantics)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, order_col: str, k: int, tie_cols=(), ascending: bool = False) -> DataFrame:
    """Top ``k`` rows by ``order_col``; ties broken by ``tie_cols`` ascending.

    Plans as TakeOrderedAndProject: each partition keeps k rows, the final
    merge sees k x partitions rows, so no task holds more than that.
    """
    o = F.col(order_col).asc_nulls_last() if ascending else F.col(order_col).desc_nulls_last()
    ties = [F.col(c).asc_nulls_last() for c in ([tie_cols] if isinstance(tie_cols, str) else tie_cols)]
    return df.orderBy(o, *ties).limit(k)


def count_by_time_part(df: DataFrame, ts_col: str, part: str, fill: bool = True,
                       name: str = "n") -> DataFrame:
    """Rows per weekday (Mon=0) / hour / month / year of ``ts_col``.

    With ``fill`` every value of the part's domain is present (count 0 when
    absent).  Weekday rows carry a ``day_name`` label.
    """
    counts = (df.select(date_part(F.col(ts_col), part).alias(part))
                .filter(F.col(part).isNotNull())
                .groupBy(part).agg(F.count(F.lit(1)).alias(name)))
    if fill and part in _DOMAINS:
        lo, hi = _DOMAINS[part]
        domain = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(part))
        # the domain is at most 24 rows and the counts at most as many
        counts = (F.broadcast(domain).join(counts, part, "left")
                  .select(part, F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)))
    if part == "weekday":
        labels = F.array(*[F.lit(d) for d in DAY_NAMES])
        counts = counts.withColumn("day_name", F.element_at(labels, F.col(part) + 1))
    return counts.withColumn(part, F.col(part).cast("long"))


def checkins_per_key(df: DataFrame, key: str, ts_col: str, name: str = "checkin_count") -> DataFrame:
    """Check-ins per key (partial + final hash aggregate)."""
    return count_by(df.filter(F.col(ts_col).isNotNull()), key, name)
