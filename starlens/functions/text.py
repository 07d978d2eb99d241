"""Text expressions: whitespace tokens, counts, accents, regex tokens, n-grams."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions._util import as_col

# Python's str.split() splits on runs of Unicode white space and never
# yields empty strings; (?U) makes Java's \s Unicode-aware.
# U+001C-001F separate words in Python but are no white space in Unicode.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Python's \w in a str pattern is letters, numbers and underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"


def elements(arr, name: str, outer: bool = False) -> Column:
    """Generator: one row per array element, in a column called ``name``.

    Written as ``inline`` over single-field structs: when the array is a
    computed expression, Spark evaluates it once per row this way, whereas a
    plain ``explode`` of the same expression measured several times slower.
    ``outer`` keeps one NULL row for a NULL or empty array.
    """
    structs = F.transform(as_col(arr), lambda t: F.struct(t.alias(name)))
    return F.inline_outer(structs) if outer else F.inline(structs)


def tokenize(c) -> Column:
    """``text.split()``: array of whitespace-separated tokens; NULL stays NULL."""
    return F.filter(F.split(as_col(c), WHITESPACE), lambda t: t != F.lit(""))


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so ``body`` evaluates it once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(tokens, name: str = "word") -> Column:
    """Array of (``name``, n): the distinct elements of an array in order, with their counts.

    Counted inside the row (sort, then the ends of equal runs), so that a text
    emits one row per distinct word instead of one per occurrence.  NULL has none.
    """
    def runs(s):
        def sizes(ends):
            before = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
            return F.zip_with(ends, before, lambda e, p: F.struct(F.get(s, e - 1).alias(name), (e - p).cast("long").alias("n")))
        places = F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)))
        last = F.filter(places, lambda i: (i <= F.size(s)) & ((i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1))))
        return _let(last, sizes)
    return _let(F.sort_array(as_col(tokens)), runs)


def word_count(c) -> Column:
    """Number of whitespace tokens (``review_length`` / ``word_count``)."""
    return F.size(tokenize(c))


def char_count(c) -> Column:
    """Length in code points."""
    return F.length(as_col(c))


def regex_count(c, pattern: str) -> Column:
    """Number of non-overlapping matches of ``pattern``."""
    return F.regexp_count(as_col(c), F.lit(pattern))


def sentence_count(c) -> Column:
    return regex_count(c, r"[.!?]+")


def exclamation_count(c) -> Column:
    return regex_count(c, r"!")


def question_count(c) -> Column:
    return regex_count(c, r"\?")


def avg_word_length(c) -> Column:
    """``char_count / (word_count + 1)``; the +1 is part of the definition."""
    return char_count(c) / (word_count(c) + F.lit(1))


def uppercase_ratio(c) -> Column:
    """Share of upper-case characters; NULL for empty or NULL text."""
    col = as_col(c)
    upper = F.length(F.regexp_replace(col, r"[^\p{IsUppercase}]", ""))
    return F.try_divide(upper.cast("double"), F.length(col).cast("double"))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """Accent folding of the whole BMP, built by rule from Unicode NFKD.

    (characters, their base characters, foldings to several letters).
    Combining marks stand at the end of the characters without a counterpart,
    so ``translate`` deletes them.  Only ligatures and digraphs of Latin
    letters fold to several letters; Hangul syllables are left whole.
    """
    src, dst, marks, several = [], [], [], {}
    for cp in (*range(0x00A0, 0xD800), *range(0xE000, 0x10000)):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if not base:
            marks.append(ch)
        elif len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
        elif len(base) > 1 and base.isascii() and base.isalpha() and unicodedata.category(ch) in ("Ll", "Lu", "Lt"):
            several[ch] = base
    return "".join(src + marks), "".join(dst), several


def strip_accents(c) -> Column:
    """Remove accents (NFKD, then drop combining marks), JVM-side."""
    src, dst, several = _accent_table()
    col = as_col(c)
    spelled = col
    for ch, letters in several.items():
        spelled = F.replace(spelled, F.lit(ch), F.lit(letters))
    return F.translate(F.when(col.rlike("[" + "".join(several) + "]"), spelled).otherwise(col), src, dst)


def regex_tokens(c, min_len: int = 1, lower: bool = True, accents: bool = True) -> Column:
    """Tokens matching ``\\w{min_len,}`` after lower-casing and accent stripping."""
    col = as_col(c)
    if lower:
        col = F.lower(col)
    if accents:
        col = strip_accents(col)
    return F.regexp_extract_all(col, F.lit(WORD_CLASS + "{%d,}" % min_len), F.lit(0))


def ngrams(tokens, n: int) -> Column:
    """Space-joined word n-grams of a token array (empty when too short).

    Built from ``n`` shifted slices merged with ``zip_with``: linear in the
    number of tokens, and no lambda refers back to the token array (a lambda
    that does would re-evaluate the whole array for every element).
    """
    toks = as_col(tokens)
    if n == 1:
        return toks
    k = F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))
    acc = F.slice(toks, 1, k)
    for i in range(1, n):
        acc = F.zip_with(acc, F.slice(toks, i + 1, k), lambda a, b: F.concat(a, F.lit(" "), b))
    return acc


def all_ngrams(tokens, lo: int, hi: int) -> Column:
    """Concatenated n-grams for n in [lo, hi] (scikit-learn ``ngram_range``)."""
    parts = [ngrams(tokens, n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def elite_count(c) -> Column:
    """Number of comma-separated parts; NULL counts 0, '' counts 1."""
    return F.coalesce(F.size(F.split(as_col(c), ",")), F.lit(0))


def contains_flag(c, needle: str, ignore_case: bool = False, as_int: bool = False) -> Column:
    """Literal substring test, NULL -> False (optionally 0/1)."""
    col = as_col(c)
    if ignore_case:
        test = F.lower(col).contains(needle.lower())
    else:
        test = col.contains(needle)
    out = F.coalesce(test, F.lit(False))
    return out.cast("int") if as_int else out
