"""Sources and sinks: JSON lines, CSV, Parquet, word-vector text files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlens.functions._util import named

# Cell texts read as missing by the usual CSV reader defaults.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    corrupt_col: str | None = None) -> DataFrame:
    """Splittable JSON-lines scan.  A malformed line is an error; with
    ``corrupt_col`` it is kept as a row that holds its raw text there."""
    r = spark.read.option("mode", "PERMISSIVE" if corrupt_col else "FAILFAST")
    if corrupt_col:
        r = r.option("columnNameOfCorruptRecord", corrupt_col)
    if schema is not None:
        if corrupt_col and isinstance(schema, T.StructType) and corrupt_col not in schema.fieldNames():
            schema = schema.add(corrupt_col, T.StringType())
        r = r.schema(schema)
    return r.json(path)


def has_multiline_cells(spark: SparkSession, path: str) -> bool:
    """True when some line of the files has an odd number of quotes, so a quoted cell goes on in the next line.

    A splittable text scan that stops at the first such line.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0


def infer_types(df: DataFrame) -> DataFrame:
    """String columns as bigint, double or boolean where every present value reads as one, in that order.

    One aggregate over all columns; a column without values stays a string.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    aggs = []
    for i, name in enumerate(names):
        c = named(name)
        aggs += [F.count(c).alias(f"n{i}"), F.count(c.try_cast("bigint")).alias(f"l{i}"), F.count(c.try_cast("double")).alias(f"d{i}"),
                 F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    kinds = {}
    for i, name in enumerate(names):
        for key, kind in (("l", "bigint"), ("d", "double"), ("b", "boolean")):
            if r[f"n{i}"] and r[f"{key}{i}"] == r[f"n{i}"]:
                kinds[name] = kind
                break
    return df.select(*[named(c).cast(kinds[c]).alias(c) if c in kinds else named(c) for c in df.columns])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   max_rows: int | None = None, null_tokens=NULL_TOKENS, multiline: bool | None = None,
                   infer: bool = True, corrupt_col: str | None = None) -> DataFrame:
    """CSV with header, quoted cells and ``"`` escapes.

    Cells in ``null_tokens`` are NULL in every column.  Without a ``schema``
    column types are inferred over the whole file (:func:`infer_types`;
    ``infer=False`` keeps strings).  ``multiline`` reads each file in one task,
    which quoted line breaks need; by default only files that have such cells
    are read that way, all others in splits.  Lines with too many or too few
    cells are kept; with ``corrupt_col`` their text is recorded there.
    ``max_rows`` keeps the first N rows of the file order (a cap, not a sample).
    """
    if multiline is None:
        multiline = has_multiline_cells(spark, path)
    options = {"header": True, "multiLine": multiline, "escape": '"', "mode": "PERMISSIVE"}
    header = spark.read.options(**options).csv(path).columns
    wanted = None
    if schema is not None:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        header = wanted.fieldNames()
    # cells are read as text first, so that every null token counts in columns of any type
    text = T.StructType([T.StructField(c, T.StringType()) for c in header if c != corrupt_col])
    if corrupt_col:
        text = text.add(corrupt_col, T.StringType())
        options["columnNameOfCorruptRecord"] = corrupt_col
    df = spark.read.options(**options).schema(text).csv(path)
    tokens = [t for t in null_tokens]
    cells = [c for c in df.columns if c != corrupt_col]
    if tokens:
        df = df.select(*[F.when(~named(c).isin(tokens), named(c)).alias(c) if c in cells else named(c) for c in df.columns])
    if wanted is not None:
        df = df.select(*[named(f.name).try_cast(f.dataType).alias(f.name) for f in wanted if f.name != corrupt_col],
                       *([named(corrupt_col)] if corrupt_col else []))
    elif infer:
        df = infer_types(df.select(*map(named, cells))) if not corrupt_col else df
    return df.limit(max_rows) if max_rows else df


def sample_by_key(df: DataFrame, key_col: str, fraction: float, seed: int = 42) -> DataFrame:
    """Deterministic sample of about ``fraction`` of the keys (all rows of a
    chosen key are kept).  The scalable counterpart of a first-N-rows cap:
    no ordering, no single task, identical on re-execution."""
    from starlens.operators.split import hash_unit
    return df.filter(hash_unit(key_col, seed) < F.lit(float(fraction)))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                partition_by=None) -> None:
    """Write a table; CSV gets a header line.  Arrays/vectors need Parquet."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def union_chunks(dfs) -> DataFrame:
    """UNION ALL by column name; columns missing in a chunk are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(dfs))


def read_word_vectors(spark: SparkSession, path: str, dim: int | None = None, skip_bad: bool = False) -> DataFrame:
    """``word v1 ... vd`` text lines -> (word, vector array<float>).

    A word listed twice keeps its last line (dictionary semantics); the line
    order is taken from the file name and offset, so no global sort is needed.
    With ``dim``, a line of another width is an error, or left out on request
    (``skip_bad``, for files that open with a header line).
    """
    lines = (spark.read.text(path).select(F.input_file_name().alias("__f"), F.col("value"))
             .withColumn("__id", F.monotonically_increasing_id()))
    parts = F.split(F.trim(F.col("value")), r"\s+")
    vals = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: x.try_cast("float"))
    rows = lines.select("__f", "__id", F.get(parts, 0).alias("word"), vals.alias("vector")) \
                .filter(F.col("word").isNotNull() & (F.col("word") != ""))
    if dim:
        fits = F.size("vector") == dim
        rows = rows.filter(fits) if skip_bad else rows.withColumn("vector", F.when(fits, F.col("vector")).otherwise(
            F.raise_error(F.concat(F.lit(f"word vector not of width {dim}: "), F.col("word")))))
    # one aggregate: for each word keep the vector of its last line
    return rows.groupBy("word").agg(F.max_by("vector", F.struct("__f", "__id")).alias("vector"))


def table_schema(df: DataFrame) -> list[tuple[str, str]]:
    return list(df.dtypes)
