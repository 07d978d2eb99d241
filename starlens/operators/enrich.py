"""Fact-to-dimension enrichment joins and per-key aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions._util import named
from starlens.functions.text import elite_count
from starlens.operators.checkins import top_k

# Default largest dimension that is broadcast, in rows and in bytes of row
# data; above either bound the join is a shuffle join and AQE re-plans with
# the run-time sizes.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024


def _fixed_width(dt: T.DataType) -> int:
    """Bytes of a fixed-width value (Spark stores each in an 8-byte slot at most)."""
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, T.DecimalType) and dt.precision > 18:
        return 16
    return 8


def _value_bytes(c, dt: T.DataType):
    """Bytes of one value in Spark's row format (strings/binary by content)."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(dt, T.ArrayType):
        if isinstance(dt.elementType, (T.StringType, T.BinaryType)):
            inner = F.aggregate(c, F.lit(0).cast("long"),
                                lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)) + F.lit(8))
        else:
            inner = F.size(c).cast("long") * F.lit(_fixed_width(dt.elementType))
        return F.coalesce(inner, F.lit(0)) + F.lit(16)
    if isinstance(dt, T.StructType):
        out = F.lit(8)
        for f in dt.fields:
            out = out + F.lit(8) + _value_bytes(c.getField(f.name), f.dataType)
        return out
    if isinstance(dt, T.MapType):
        return F.coalesce(F.size(c).cast("long"), F.lit(0)) * F.lit(64) + F.lit(16)
    if isinstance(dt, VectorUDT):
        return F.coalesce(F.size(vector_to_array(c)).cast("long"), F.lit(0)) * F.lit(12) + F.lit(32)
    if isinstance(dt, T.UserDefinedType):
        return _value_bytes(c, dt.sqlType()) if not isinstance(dt.sqlType(), T.StructType) else F.lit(1 << 20)
    return F.lit(_fixed_width(dt))


def row_bytes(df: DataFrame):
    """Approximate size of each row in Spark's row format: 8 bytes per field
    slot plus variable-length contents, plus the null bitmap."""
    total = F.lit(8 * ((len(df.columns) + 63) // 64))
    for f in df.schema.fields:
        total = total + F.lit(8) + _value_bytes(F.col(f"`{f.name}`"), f.dataType)
    return total


def bounded_size(df: DataFrame, max_rows: int, max_bytes: int | None = BROADCAST_MAX_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Every partition counts its own rows and bytes and sends one row, so no
    rows of a large ``df`` are gathered to learn that it is large.
    """
    size = F.sum(row_bytes(df)) if max_bytes else F.lit(0)
    r = df.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return r["n"] <= max_rows and (r["b"] or 0) <= (max_bytes or 0)


def bounded_rows(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows."""
    return bounded_size(df, max_rows, None)


def maybe_broadcast(df: DataFrame, max_rows: int | None,
                    max_bytes: int | None = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a proven row and byte bound; else leave it to AQE."""
    if max_rows and bounded_size(df, max_rows, max_bytes):
        return F.broadcast(df)
    return df


def broadcast_blocks(table: DataFrame, key: str, max_rows: int, max_bytes: int = BROADCAST_MAX_BYTES) -> list[DataFrame]:
    """The rows of ``table`` with a key, dealt by its hash into as many blocks as stay near both bounds; one if all fit."""
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table)).alias("b")).first()
    n = max(1, -(-r["n"] // max(16, max_rows)), -(-(r["b"] or 0) // max_bytes))
    if n == 1:
        return [table]
    return [table.filter(F.pmod(F.xxhash64(named(key)), F.lit(n)) == b) for b in range(n)]


#: A key with at least this share of the rows is looked up by broadcast, at most its reciprocal of them.
HOT_SHARE = 0.001


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", max_rows: int | None = BROADCAST_MAX_ROWS,
           max_bytes: int | None = BROADCAST_MAX_BYTES, hot_share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``table``, which holds each key once: inner or left.

    A table within the bounds is broadcast.  A larger one is split: a
    frequent-items sketch over the rows names every key with at least
    ``hot_share`` of them (and at most 1 / ``hot_share`` keys in all), the
    table's rows of these keys are broadcast, and only the other keys are
    shuffled, none of which is hot.  NULL keys match nothing.
    """
    if max_rows and bounded_size(table, max_rows, max_bytes):
        return rows.join(F.broadcast(table), key, how)
    hot = [k for k in rows.select(key).stat.freqItems([key], hot_share).first()[0] if k is not None]
    if not hot:
        return rows.join(table, key, how)
    is_hot = named(key).isin(hot)
    few = rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key, how)
    rest = rows.filter(~is_hot | named(key).isNull()).join(table.filter(~is_hot), key, how)
    return few.unionByName(rest)


def drop_strict(df: DataFrame, cols) -> DataFrame:
    """Drop columns, raising on a missing name (pandas semantics)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def enrich(fact: DataFrame, dim: DataFrame, on, rename: dict | None = None, how: str = "left",
           null_safe: bool = False, check_unique: bool = False,
           broadcast_max_rows: int | None = BROADCAST_MAX_ROWS) -> DataFrame:
    """Left-join dimension attributes onto a fact table.

    ``rename`` maps dimension column -> output name and is applied before
    the join, so colliding names never need suffixes.  ``null_safe`` matches
    NULL keys to each other (pandas merge); ``check_unique`` raises when a
    dimension key repeats (which would multiply fact rows).
    """
    on = [on] if isinstance(on, str) else list(on)
    rename = rename or {}
    dim = dim.select(*[named(c).alias(rename.get(c, c)) for c in dim.columns])
    if check_unique:
        dup = dim.groupBy(*map(named, on)).count().filter("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"dimension key {on} is not unique")
    dim = maybe_broadcast(dim, broadcast_max_rows)
    if not null_safe:
        return fact.join(dim, on, how)
    keys = {k: f"__key{i}" for i, k in enumerate(on)}
    dim = dim.select(*[named(c).alias(keys.get(c, c)) for c in dim.columns])
    cond = reduce(lambda a, b: a & b, [named(k).eqNullSafe(F.col(v)) for k, v in keys.items()])
    return fact.join(dim, cond, how).drop(*keys.values())


def build_combined(review: DataFrame, business: DataFrame, user: DataFrame,
                   review_key: str = "review_id", business_key: str = "business_id",
                   user_key: str = "user_id", cols: dict | None = None,
                   broadcast_max_rows: int | None = BROADCAST_MAX_ROWS) -> DataFrame:
    """review LEFT JOIN business LEFT JOIN user with the combined column names.

    ``cols`` maps role -> source column name for the roles below (defaults
    are the source names of the review platform export):

    ====================== ======== =========================
    output                  table    default source column
    ====================== ======== =========================
    total_reviews           business review_count
    average_star_rating     business stars
    total_user_review_count user     review_count
    user_average_star_rating user    average_stars
    review_star             review   stars
    review_useful           review   useful
    user_useful             user     useful
    review_date             review   date
    elite_count             user     elite (number of parts)
    ====================== ======== =========================

    The business address and the raw colliding columns are not carried.
    The business side is broadcast only behind a row and byte bound; the user
    side is normally as large as the fact and is shuffle-joined (AQE splits
    skewed keys).
    """
    c = {"b_review_count": "review_count", "b_stars": "stars", "u_review_count": "review_count",
         "u_average_stars": "average_stars", "r_stars": "stars", "r_useful": "useful",
         "u_useful": "useful", "r_date": "date", "u_elite": "elite", "b_address": "address"}
    c.update(cols or {})
    r_map = {c["r_stars"]: "review_star", c["r_useful"]: "review_useful", c["r_date"]: "review_date"}
    b_map = {c["b_review_count"]: "total_reviews", c["b_stars"]: "average_star_rating"}
    u_map = {c["u_review_count"]: "total_user_review_count", c["u_average_stars"]: "user_average_star_rating",
             c["u_useful"]: "user_useful"}
    r = review.select(*[F.col(x).alias(r_map.get(x, x)) for x in review.columns])
    b = business.select(*[F.col(x).alias(b_map.get(x, x)) for x in business.columns
                          if x != c["b_address"] and (x == business_key or x not in r.columns or x in b_map)])
    u_cols = [F.col(x).alias(u_map.get(x, x)) for x in user.columns
              if x != c["u_elite"] and (x == user_key or x in u_map or x not in r.columns + b.columns)]
    if c["u_elite"] in user.columns:
        u_cols.append(elite_count(F.col(c["u_elite"])).alias("elite_count"))
    u = user.select(*u_cols)
    rb = r.join(maybe_broadcast(b, broadcast_max_rows), business_key, "left")
    out = rb.join(u, user_key, "left")
    if "elite_count" in out.columns:
        # a review whose user is missing has no elite string -> 0
        out = out.withColumn("elite_count", F.coalesce(F.col("elite_count"), F.lit(0)))
    return out


def sum_by(df: DataFrame, key: str, col: str, name: str | None = None, how: str = "sum") -> DataFrame:
    """Group sum; a group of only NULLs sums to 0 (pandas).

    ``how='max'`` takes the largest value instead, which is the right total
    when ``col`` is a per-key attribute repeated on every row of the key.
    """
    agg = F.sum(named(col)) if how == "sum" else F.max(named(col))
    return (df.filter(named(key).isNotNull()).groupBy(named(key))
            .agg(F.coalesce(agg, F.lit(0)).alias(name or f"{how}_{col}")))


def count_non_null_by(df: DataFrame, key: str, col: str, name: str | None = None) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(col).alias(name or f"count_{col}"))


def distinct_count_by(df: DataFrame, key: str, col: str, min_distinct: int | None = None,
                      name: str = "n_distinct", approx: bool = False) -> DataFrame:
    """Distinct non-NULL values per key, optionally keeping keys with more than ``min_distinct``."""
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(agg.alias(name))
    return out.filter(F.col(name) > min_distinct) if min_distinct is not None else out


def top_keys(df: DataFrame, key: str, k: int, count_col: str | None = None, name: str = "n") -> DataFrame:
    """``groupby(key)[count_col].count().nlargest(k)`` with key-ascending ties."""
    cnt = F.count(count_col) if count_col else F.count(F.lit(1))
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(cnt.alias(name))
    return top_k(counts, name, k, [key])


def rows_of_keys(df: DataFrame, keys: DataFrame, key: str, max_keys: int | None = None) -> DataFrame:
    """Left-semi join: rows of ``df`` whose key is in ``keys`` (``isin`` without collecting).

    ``max_keys`` is a promise of the caller's that spares the size check; a broken promise is a shuffle join,
    since at most so many keys and one more are looked at.
    """
    ks = keys.select(key)
    if max_keys:
        few = ks.limit(max_keys + 1)
        return df.join(F.broadcast(few) if few.count() <= max_keys else ks, key, "left_semi")
    return df.join(maybe_broadcast(ks, BROADCAST_MAX_ROWS), key, "left_semi")


def rows_of_top_k(df: DataFrame, key: str, k: int, count_col: str | None = None) -> DataFrame:
    """Rows of the ``k`` most frequent keys; the key set is a limit of k rows, so it is broadcast."""
    return df.join(F.broadcast(top_keys(df, key, k, count_col).select(key)), key, "left_semi")


def state_counts(df: DataFrame, state_col: str, category_col: str, needle: str = "Restaurants",
                 grain: str = "review", entity_col: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Rows (``grain='review'``) or distinct entities (``'business'``) per state
    among rows whose category contains ``needle`` (NULL category -> excluded)."""
    c = F.col(category_col)
    # a bare predicate (NULL drops the row, as False would) reaches the Parquet scan as StringContains
    pred = F.lower(c).contains(needle.lower()) if ignore_case else c.contains(needle)
    f = df.filter(pred).filter(F.col(state_col).isNotNull())
    if grain == "review":
        return f.groupBy(state_col).agg(F.count(F.lit(1)).alias("n"))
    if grain == "business":
        if not entity_col:
            raise ValueError("entity_col is required for grain='business'")
        return f.groupBy(state_col).agg(F.count_distinct(entity_col).alias("n"))
    raise ValueError(grain)
