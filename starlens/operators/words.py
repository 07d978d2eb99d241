"""Word statistics: frequencies, stop-word filtering, top words, word-cloud weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions.text import elements, tokenize
from starlens.operators.checkins import top_k
from starlens.operators.enrich import BROADCAST_MAX_ROWS, maybe_broadcast


def words(df: DataFrame, text_col: str, lower: bool = True, stop_words=None, keep_cols=()) -> DataFrame:
    """One row per whitespace token (``word``), optionally lower-cased and
    stop-word filtered.  A stop-word table is broadcast into a left-anti join
    behind a size check; a Python list becomes a hash-set membership test."""
    out = df.select(*keep_cols, elements(tokenize(F.col(text_col)), "word"))
    if lower:
        out = out.withColumn("word", F.lower("word"))
    if stop_words is not None:
        if isinstance(stop_words, DataFrame):
            stops = stop_words.select(F.col(stop_words.columns[0]).alias("word"))
            out = out.join(maybe_broadcast(stops, BROADCAST_MAX_ROWS), "word", "left_anti")
        else:
            # a literal IN list becomes a hash-set lookup (InSet) per token
            out = out.filter(~F.col("word").isin(sorted(set(stop_words))))
    return out


def word_counts(df: DataFrame, text_col: str, lower: bool = True, stop_words=None) -> DataFrame:
    """(word, cnt) over all texts: explode + partial/final hash aggregate."""
    return (words(df, text_col, lower, stop_words).groupBy("word")
            .agg(F.count(F.lit(1)).alias("cnt")))


def top_words(df: DataFrame, text_col: str, k: int = 10, lower: bool = True, stop_words=None) -> DataFrame:
    """``Counter.most_common(k)``; ties by word ascending."""
    return top_k(word_counts(df, text_col, lower, stop_words), "cnt", k, ["word"])


def cloud_weights(df: DataFrame, text_col: str, rating_col: str, cut: float = 3, k: int = 200,
                  lower: bool = True, stop_words=None) -> DataFrame:
    """Word-cloud input for each side: good (rating > cut) and bad (rating <= cut).

    Top ``k`` words per side with weight = count / largest count of the side.
    Rows whose rating is NULL belong to neither side.  Each side is its own
    distributed top-k (no window over a whole side).
    """
    sides = []
    for side, cond in (("good", F.col(rating_col) > F.lit(cut)), ("bad", F.col(rating_col) <= F.lit(cut))):
        counts = word_counts(df.filter(cond), text_col, lower, stop_words)
        top = top_k(counts, "cnt", k, ["word"])
        sides.append(top.withColumn("side", F.lit(side)))
    both = sides[0].unionByName(sides[1])
    # both inputs are at most k rows each
    mx = both.groupBy("side").agg(F.max("cnt").alias("__mx"))
    return (both.join(F.broadcast(mx), "side")
            .select("side", "word", "cnt", (F.col("cnt") / F.col("__mx")).alias("weight")))
