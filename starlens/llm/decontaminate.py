"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Every benchmark item is cut into windows of ``window`` words (a shorter item is
one window).  A window is the set of its word shingles.  To be contained in a
document, a window must share the shingles of its *prefix*, the rarest ones, so
only those are joined.  Length and position bounds then fix where the window
would stand, and the words there are compared exactly.

Defined results: NULL or empty texts have no words and no hits; a document of
any length is read whole; repeated documents are judged row by row; repeated
items each count; an item with a NULL id is left out of the lists but its
passages are still hits; empty tables give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, with_row_key

#: Runs of ASCII digits, lower-case letters and all characters beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Cells of 64 bits in the shingle filter: a fixed 64 KB however large the benchmark is.
FILTER_CELLS = 1 << 13
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ITEM_WORD), F.lit(0))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _places(words: Column, k: int) -> Column:
    """(hash, place) of each ``k``-word shingle."""
    return F.when(F.size(words) < k, F.array().cast("array<struct<h:bigint,at:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - k),
                    lambda i: F.struct(_hash(words, i, k).alias("h"), i.alias("at"))))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: its words and the items that hold it."""
    def cut(w: Column) -> Column:
        return F.when(F.size(w) <= window, F.array(w)).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), lambda i: F.slice(w, i + 1, window)))
    return (items.select(F.col(id_col).cast("string").alias("item"),
                         F.explode(let(words_of(F.col(text_col)), cut)).alias("words"))
            .filter(F.size("words") > 0)
            .groupBy("words").agg(F.collect_set("item").alias("items")))


def window_prefixes(windows: DataFrame, shingle: int, containment: float) -> DataFrame:
    """(h, at, words, items): the shingles of each window that a document must share."""
    placed = windows.withColumn("s", let(F.col("words"), lambda w: F.when(
        F.size(w) >= shingle, _places(w, shingle)).otherwise(_places(w, 1))))
    each = placed.select("words", F.explode("s").alias("s"))
    rarity = each.groupBy(F.col("s.h").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # rarest first; among equals the longer shingle, which is rarer in running text
    chars = F.length(F.concat_ws(" ", F.slice("words", F.col("s.at") + 1, F.lit(shingle))))
    order = F.array_sort(F.collect_list(F.struct("n", (-chars).alias("c"), "h", F.col("s.at").alias("at"))))
    ordered = each.join(rarity, F.col("s.h") == F.col("h")).groupBy("words").agg(order.alias("o"))
    need = F.size("o") - F.ceil(F.size("o") * F.lit(containment)).cast("int") + 1
    return (ordered.select("words", F.explode(F.slice("o", F.lit(1), need)).alias("p"))
            .join(windows, "words").select("p.h", "p.at", "words", "items"))


def _filter_places(h: Column) -> list[Column]:
    """Two bit places of a hash in the filter."""
    bits = FILTER_CELLS * 64
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]


def shingle_filter(prefixes: DataFrame) -> Column:
    """The filter as a scalar: FILTER_CELLS longs, a bit set for each prefix shingle (two places each)."""
    places = prefixes.select(F.explode(F.array(*_filter_places(F.col("h")))).alias("b")).distinct()
    cells = places.groupBy(F.shiftright("b", 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("v"))
    every = prefixes.sparkSession.range(FILTER_CELLS, numPartitions=1).select(F.col("id").alias("cell"))
    rows = every.join(cells, "cell", "left").select(
        F.struct("cell", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("c"))
    return rows.agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["v"]).alias("bits")).scalar()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                  containment: float = 1.0, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text",
                  row_key: str | None = None) -> DataFrame:
    """Per document: its id, ``row_key`` if given, and the columns of ``RESULT``.

    ``containment`` is the share of a window's shingles that prefixes are made
    for; the words of the window are compared in full either way, so 1.0 (the
    shortest prefix, one shingle) loses nothing.  ``hits`` are the found
    windows as (start, words); ``items`` their item ids, sorted as text.
    """
    key = row_key or "__row"
    keyed = docs if row_key else with_row_key(docs, key)
    windows = item_windows(items, window, item_id_col, item_text_col)
    prefixes = window_prefixes(windows, shingle, containment)

    def bit(m: Column, b: Column) -> Column:
        return F.getbit(F.get(m, F.shiftright(b, 6).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1

    def survivors(w: Column, m: Column) -> Column:
        found = [F.filter(_places(w, k), lambda x: bit(m, _filter_places(x["h"])[0])
                          & bit(m, _filter_places(x["h"])[1])) for k in dict.fromkeys([shingle, 1])]
        # a window that holds this place lies within window - 1 words on either side
        return F.transform(F.concat(*found), lambda x: F.struct(
            x["h"].alias("h"), x["at"].alias("at"),
            F.greatest(x["at"] - (window - 1), F.lit(0)).alias("from"),
            F.slice(w, F.greatest(x["at"] - (window - 1), F.lit(0)) + 1,
                    x["at"] - F.greatest(x["at"] - (window - 1), F.lit(0)) + window).alias("near")))

    read = keyed.select(
        F.col(key).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__t"),
        shingle_filter(prefixes).alias("__bits"))
    read = read.select("__row", "__id", let(words_of(F.col("__t")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), survivors(w, F.col("__bits")).alias("found"))).alias("r"))
    # documents without a survivor keep one row, under a key of their own rather than one common NULL
    rows = read.select("__row", "__id", "r.n_words", F.explode_outer("r.found").alias("f")).select(
        "__row", "__id", "n_words", F.coalesce("f.h", F.xxhash64("__row")).alias("h"),
        F.col("f.at").alias("d_at"), F.col("f.from").alias("d_from"), F.col("f.near").alias("near"))
    start = F.col("d_at") - F.col("at")
    length = F.size("words")
    stands = ((start >= 0) & (start + length <= F.col("n_words"))
              & (F.slice("near", F.greatest(start - F.col("d_from"), F.lit(0)) + 1, F.greatest(length, F.lit(0)))
                 == F.col("words")))
    hit = F.when(stands, F.struct(start.alias("start"), length.alias("words")))
    per_doc = (rows.join(prefixes, "h", "left")
               .select("__row", "__id", "n_words", hit.alias("hit"), F.when(stands, F.col("items")).alias("items"))
               .groupBy("__row").agg(
                   F.first("__id").alias("__id"), F.first("n_words").alias("n_words"),
                   F.array_sort(F.collect_set("hit")).alias("hits"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    # each word counts once: a hit adds what lies beyond the furthest end before it
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["words"]).alias("end"),
            (a["n"] + F.greatest(x["start"] + x["words"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"])
    return (per_doc.withColumn("n_hit", covered)
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256))
            .withColumn("contaminated", F.col("n_hit") > 0)
            .select(F.col("__id").alias(id_col), *([F.col("__row").alias(row_key)] if row_key else []), *RESULT))
