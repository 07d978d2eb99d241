"""Data-quality profiling: schema summary, nulls, duplicates, downcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions._util import named, present

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """Columns of number type (``select_dtypes(include='number')``)."""
    kinds = NUMERIC + ((T.BooleanType,) if include_bool else ())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _is_missing(df: DataFrame, name: str):
    c = named(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _unpivot(row_df: DataFrame, fields: list[tuple]) -> DataFrame:
    """One-row frame of aggregates -> one row per (literal..., value) struct."""
    return row_df.select(F.inline(F.array(*[F.struct(*f) for f in fields])))


def table_info(df: DataFrame) -> DataFrame:
    """``df.info()``: (column, dtype, non_null, n) from a single scan."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(named(c)).alias(f"__c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    fields = [(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
               F.col(f"__c{i}").alias("non_null"), F.col("__n").alias("n"))
              for i, (c, t) in enumerate(df.dtypes)]
    return _unpivot(one, fields)


def null_report(df: DataFrame, cols=None) -> DataFrame:
    """Missing values per column (NULL and NaN), only columns with any, largest first."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.count_if(_is_missing(df, c)).alias(f"__m{i}") for i, c in enumerate(cols)])
    fields = [(F.lit(c).alias("column_name"), F.col(f"__m{i}").alias("null_count"))
              for i, c in enumerate(cols)]
    return (_unpivot(one, fields).filter(F.col("null_count") > 0)
            .orderBy(F.desc("null_count"), "column_name"))


def nulls_per_row(df: DataFrame, cols=None):
    """Column expression: number of missing values in the row."""
    cols = list(cols or df.columns)
    return sum((_is_missing(df, c).cast("int") for c in cols), F.lit(0))


def nulls_per_row_hist(df: DataFrame, bins: int = 30, cols=None) -> DataFrame:
    """Histogram of missing values per row (empty when nothing is missing)."""
    from starlens.operators.stats import histogram
    counted = df.select(nulls_per_row(df, cols).alias("n_missing"))
    return histogram(counted, "n_missing", bins, drop_if_max_zero=True)


def duplicate_report(df: DataFrame, cols=None) -> DataFrame:
    """``duplicated(keep=False).value_counts()``: rows in a duplicate group vs unique.

    NULLs compare equal (grouping is null-safe).  Grouping runs on a 64-bit
    hash plus the columns, so partial aggregation collapses hot duplicate
    groups map-side before the shuffle.
    """
    cols = list(cols or df.columns)
    keyed = df.select(F.xxhash64(*[named(c) for c in cols]).alias("__h"), *[named(c) for c in cols])
    groups = keyed.groupBy("__h", *[named(c) for c in cols]).agg(F.count(F.lit(1)).alias("__k"))
    one = groups.agg(
        F.coalesce(F.sum(F.when(F.col("__k") > 1, F.col("__k"))), F.lit(0)).alias("dup"),
        F.coalesce(F.sum(F.when(F.col("__k") == 1, F.col("__k"))), F.lit(0)).alias("uniq"))
    return _unpivot(one, [(F.lit(True).alias("is_duplicate"), F.col("dup").cast("long").alias("n_rows")),
                          (F.lit(False).alias("is_duplicate"), F.col("uniq").cast("long").alias("n_rows"))])


def min_max(df: DataFrame, cols=None) -> DataFrame:
    """(column, min, max) of numeric columns as doubles, one scan; NaN counts as missing."""
    cols = list(cols or numeric_columns(df))
    one = df.agg(*_limits(df, cols))
    return _unpivot(one, [(F.lit(c).alias("column_name"), F.col(f"__lo{i}").cast("double").alias("min"),
                           F.col(f"__hi{i}").cast("double").alias("max")) for i, c in enumerate(cols)])


def _limits(df: DataFrame, cols: list[str]) -> list:
    """Smallest and largest value of each column, in the column's own type."""
    aggs = []
    for i, c in enumerate(cols):
        x = present(c) if isinstance(df.schema[c].dataType, FLOATING) else named(c)
        aggs += [F.min(x).alias(f"__lo{i}"), F.max(x).alias(f"__hi{i}")]
    return aggs


# Integer and floating type limits used by the downcast rule.
_INT_LIMITS = [("byte", -128, 127), ("short", -32768, 32767),
               ("int", -2147483648, 2147483647)]
_FLOAT32_MAX = 3.4028234663852886e38


def downcast_plan(df: DataFrame, cols=None) -> DataFrame:
    """(column, from_type, to_type, min, max) by the strict-limit rule.

    Integers are compared in their own type and take the smallest type whose
    limits are strictly outside [min, max], else ``bigint``; floats become
    ``float`` when strictly inside float32 range, else ``double``.  Spark has
    no float16, so ``float`` is the floor.  Decimals keep their type.
    All-NULL integer and float columns become ``double``.
    """
    cols = list(cols or numeric_columns(df))
    one = df.agg(*_limits(df, cols))
    types = dict(df.dtypes)

    def target(c, lo, hi):
        if isinstance(df.schema[c].dataType, T.DecimalType):
            return F.lit(types[c])
        if isinstance(df.schema[c].dataType, INTEGRAL):
            choice = F.when(lo.isNull(), F.lit("double"))
            for name, a, b in _INT_LIMITS:
                choice = choice.when((lo > F.lit(a)) & (hi < F.lit(b)), F.lit(name))
            return choice.otherwise(F.lit("bigint"))
        return (F.when(lo.isNull(), F.lit("double"))
                .when((lo > F.lit(-_FLOAT32_MAX)) & (hi < F.lit(_FLOAT32_MAX)), F.lit("float"))
                .otherwise(F.lit("double")))

    fields = []
    for i, c in enumerate(cols):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        fields.append((F.lit(c).alias("column_name"), F.lit(types[c]).alias("from_type"),
                       target(c, lo, hi).alias("to_type"), lo.cast("double").alias("min"),
                       hi.cast("double").alias("max")))
    return _unpivot(one, fields)


def downcast(df: DataFrame, cols=None) -> tuple[DataFrame, DataFrame]:
    """Apply :func:`downcast_plan`; returns (recast frame, report).

    The report is one row per numeric column (bounded by the schema), so
    collecting it to build the projection is safe.
    """
    report = downcast_plan(df, cols)
    target = {r["column_name"]: r["to_type"] for r in report.collect()}
    out = df.select(*[named(c).cast(target[c]).alias(c) if c in target else named(c) for c in df.columns])
    return out, report
