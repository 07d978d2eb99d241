"""Lexicon sentiment: polarity in [-1, 1] and subjectivity in [0, 1] per text.

The lexicon is a table ``(word, polarity, subjectivity[, intensity])``.
A word's polarity is multiplied by the previous word's ``intensity`` when
that word is an intensifier in the lexicon, and by -0.5 when the previous
word is a negation.  A text's scores are the means over its lexicon words;
texts without any lexicon word score 0 and 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.fixed_values import NEGATIONS
from starlens.functions.text import WORD_CLASS, elements
from starlens.operators.enrich import lookup

TOKEN = WORD_CLASS + "+"


def sentiment_tokens(col):
    """Lower-cased word tokens used by the scorer."""
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def word_with_previous(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, prev) for every token; ``prev`` comes from the same array, so
    no shuffle or window is needed to look one token back."""
    staged = df.select(id_col, sentiment_tokens(F.col(text_col)).alias("word"))
    toks = F.col("word")
    prevs = F.concat(F.array(F.lit(None).cast("string")), F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))))
    return staged.select(id_col, F.inline_outer(F.arrays_zip(toks, prevs.alias("prev"))))


def sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, negations=NEGATIONS,
              broadcast_max_rows: int = 2_000_000) -> DataFrame:
    """(id, sentiment_polarity, sentiment_subjectivity) for every row of ``df``.

    Words listed more than once (also in different case) count once, with the
    means of their figures.
    """
    inten = F.col("intensity") if "intensity" in lexicon.columns else F.lit(None)
    lex = lexicon.groupBy(F.lower(F.col("word")).alias("word")).agg(
        F.avg(F.col("polarity").cast("double")).alias("pol"),
        F.avg(F.col("subjectivity").cast("double")).alias("subj"), F.avg(inten.cast("double")).alias("inten"))
    pairs = word_with_previous(df, id_col, text_col)
    scored = lookup(pairs, lex, "word", "left", broadcast_max_rows)
    neg = F.array(*[F.lit(w) for w in negations])
    mod = F.when(F.array_contains(neg, F.col("prev")), F.lit(-0.5)).otherwise(F.lit(1.0))
    if "intensity" in lexicon.columns:
        # previous-word intensifiers need a second lookup of the lexicon
        prev_lex = lex.filter(F.col("inten").isNotNull()).select(F.col("word").alias("prev"),
                                                                 F.col("inten").alias("prev_inten"))
        scored = lookup(scored, prev_lex, "prev", "left", broadcast_max_rows)
        mod = F.coalesce(F.col("prev_inten"), F.lit(1.0)) * mod
    hit = F.col("pol").isNotNull()
    return scored.groupBy(id_col).agg(
        F.coalesce(F.avg(F.when(hit, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("pol") * mod)))),
                   F.lit(0.0)).alias("sentiment_polarity"),
        F.coalesce(F.avg(F.when(hit, F.col("subj"))), F.lit(0.0)).alias("sentiment_subjectivity"))


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                        polarity_col: str, subjectivity_col: str, min_docs: int = 1) -> DataFrame:
    """Supervised lexicon learnt from labelled texts.

    polarity = 2 * mean(label) - 1 and subjectivity = mean(second label)
    over the labelled texts containing the word; words seen in fewer than
    ``min_docs`` labelled texts are left out (by default none).
    """
    lab = docs.join(labels, id_col, "inner")
    words = lab.select(id_col, polarity_col, subjectivity_col,
                       elements(F.array_distinct(sentiment_tokens(F.col(text_col))), "word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"),
                                      F.avg(F.col(polarity_col).cast("double")).alias("__p"),
                                      F.avg(F.col(subjectivity_col).cast("double")).alias("subjectivity"))
            .filter(F.col("n_docs") >= min_docs)
            .select("word", (F.lit(2.0) * F.col("__p") - F.lit(1.0)).alias("polarity"), "subjectivity"))
