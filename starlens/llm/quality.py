"""Quality rules: word statistics and cross-document line frequency (DataFrame functions only).

Lines are normalised and hashed; per host the number of distinct documents with
each line is counted; lines of too many documents are taken out, and documents
with too little left are rejected.

Defined results for odd input: a NULL or empty text has no words, no lines and
fails the base rules; a NULL host is a host of its own; repeated rows are judged
row by row but count as one document (documents are distinct by their whole
text, so a group of exact copies does not turn its own lines into boilerplate);
the result has the id, the row key if one is given, the columns of ``RESULT``
and ``gone_lines``, so further columns never clash; ``without_lines`` takes the
lines out of the texts: lines without a word stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, let, staged, with_row_key

SYMBOLS = r"[#*$%&|<>]"
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "n_words_left", "kept"]


def _repeat_words(words: Column, width: int) -> Column:
    """Words covered by a ``width``-word window that stands at least twice in the text."""
    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))

    def covered(h: Column) -> Column:
        # (hash, start) sorted: equal windows stand side by side
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def count(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda a, b: s[a]["h"] == s[b]["h"]
            starts = F.array_sort(F.transform(
                F.filter(s, lambda x, i: F.when(i > 0, same(i - 1, i)).otherwise(F.lit(False))
                         | F.when(i < last, same(i, i + 1)).otherwise(F.lit(False))),
                lambda x: x["p"]))
            # each start covers words up to the next start, the last one its whole window
            return let(starts, lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.when(
                    i < F.size(p) - 1, F.least(F.lit(width), p[i + 1] - x)).otherwise(F.lit(width))),
                F.lit(0), lambda a, x: a + x))
        return let(keyed, count)

    return F.when(F.size(words) <= width, F.lit(0)).otherwise(
        let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
            .otherwise(covered(h))))


def _normal_line(line: Column) -> Column:
    """Letters lower-cased, white space collapsed, numbers as 0: page numbers and dates do not tell lines apart."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def text_measures(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """Word counts and repetition measures of every text, plus its lines as (hash, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    measures = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w, window).cast("long").alias("n_repeat_words")))
    lines = let(worded, lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.transform(ls, lambda x: F.struct(
            F.xxhash64(_normal_line(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n"))).alias("lines")))
    return (docs.withColumn("__m", measures).withColumn("__l", lines)
            .withColumns({
                "n_words": F.col("__m.n_words"), "n_repeat_words": F.col("__m.n_repeat_words"),
                "n_dup_lines": F.col("__l.n_dup_lines"), "__lines": F.col("__l.lines"),
                "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long")})
            .drop("__m", "__l"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  min_words: int = 10, max_repeat_pct: int = 20, min_docs: int = 20,
                  max_doc_share: float = 0.1, min_left: int = 10, row_key: str | None = None) -> DataFrame:
    """Judge every document: its id, ``row_key`` if given, the columns of ``RESULT`` and ``gone_lines``.

    A line is above the limit when more than ``min_docs`` distinct documents of
    its host and more than ``max_doc_share`` of them hold it.  A document is
    depleted when fewer than ``min_left`` of its words stand on other lines.
    The share follows the host's size, so the rule acts alike at every scale
    and a large group of near copies alone does not reject itself.
    ``gone_lines`` are the hashes of a document's lines above the limit.
    """
    text = F.coalesce(F.col("__t"), F.lit(""))
    keyed = docs if row_key else with_row_key(docs, "__row")
    measured = text_measures(keyed.select(
        F.col(row_key or "__row").alias("__row"), F.col(id_col).alias("__id"),
        F.col(host_col).alias("__host"), F.col(text_col).alias("__t")), "__t")
    base_failed = (F.col("n_words") < min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    # measures are narrow: written once, read by the counts and by the verdict
    m = staged(measured.withColumn("__text", F.struct(F.xxhash64(text), F.length(text))).drop("__t"), "quality")
    rows = m.select("__row", "__host", "__text", F.explode("__lines").alias("l")).select(
        "__row", "__host", "__text", F.col("l.line").alias("__line"), F.col("l.n").alias("__n"))
    # one row per (host, line, document) before the count, combined on the map side
    per_line = (rows.select("__host", "__line", "__text").distinct()
                .groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__docs")))
    per_host = (m.select("__host", "__text").distinct()
                .groupBy("__host").agg(F.count(F.lit(1)).alias("__host_docs")))
    # a line of few documents can never be above the limit: it does not join
    frequent = (per_line.filter(F.col("__docs") > min_docs).alias("a")
                .join(per_host.filter(F.col("__host_docs") > min_docs).alias("b"),
                      F.col("a.__host").eqNullSafe(F.col("b.__host")))
                .filter(F.col("__docs") > F.col("__host_docs") * max_doc_share)
                .select(F.col("a.__host").alias("__fh"), F.col("a.__line").alias("__fl")))
    removed = (rows.join(frequent, (F.col("__line") == F.col("__fl")) & F.col("__host").eqNullSafe(F.col("__fh")))
               .groupBy("__row").agg(F.sum("__n").alias("__removed"), F.collect_set("__line").alias("__gone")))
    left = F.col("n_words") - F.coalesce(F.col("__removed"), F.lit(0))
    return (m.join(removed, "__row", "left")
            .withColumn("base_failed", base_failed)
            .withColumn("n_words_left", left.cast("long"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= min_left))
            .withColumn("gone_lines", F.coalesce("__gone", F.array().cast("array<bigint>")))
            .select(F.col("__id").alias(id_col), *([F.col("__row").alias(row_key)] if row_key else []), *RESULT,
                    "gone_lines"))


def without_lines(docs: DataFrame, judged: DataFrame, row_key: str, text_col: str = "text",
                  length_col: str | None = None) -> DataFrame:
    """The kept of ``docs``, their texts without the lines above the limit, and ``length_col`` set to the new length.

    Only rejected documents and those with such lines are looked up: their few
    verdicts travel, not the texts.
    """
    kept_col, gone_col = free_name(docs, "__kept"), free_name(docs, "__gone")
    verdicts = (judged.filter(~F.col("kept") | (F.size("gone_lines") > 0))
                .select(row_key, F.col("kept").alias(kept_col), F.col("gone_lines").alias(gone_col)))
    text, gone = F.col(text_col), F.size(gone_col) > 0
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~(
        x.rlike(WORD) & F.array_contains(gone_col, F.xxhash64(_normal_line(x))))), "\n")
    out = (docs.join(verdicts, row_key, "left").filter(F.coalesce(kept_col, F.lit(True)))
           .withColumn(text_col, F.when(gone, left).otherwise(text)))
    if length_col:
        out = out.withColumn(length_col, F.when(gone, F.length(text_col).cast(docs.schema[length_col].dataType))
                             .otherwise(F.col(length_col)))
    return out.select(*docs.columns)
