"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame functions only).

Pattern matches and candidate tokens become rows with their places.  Each
candidate's alphabet (its encoding) is inferred and three tests ask whether its
symbols could be uniform draws: chi-squared of the symbol counts, runs above
and below the alphabet's middle, and serial correlation.  Fisher's method
combines the three p-values.  Most long tokens are words, which the battery
rejects; Benjamini-Hochberg within each length class bounds the share of random
tokens among those rejected, so what it does not reject is reported as a secret.

Defined results: a NULL or empty text has no spans; places are code points,
the end exclusive; repeated rows are scanned row by row; texts of any length
are scanned whole; the result has the id, the row key if one is given and the
columns of ``RESULT``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, let, staged, with_row_key

#: Kinds in the order in which they are listed: name, pattern, group to measure, its least length.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a greedy run of 24 or more is the run of one or more that has 24 characters
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Candidate tokens of the battery: whole runs of the widest alphabet.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
KINDS = [k[0] for k in BASE_KINDS] + ["random"]
#: Encodings from the narrowest: name, pattern of the whole token, alphabet in its order.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"), ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"), ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER), ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base64", r"^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
]
#: p-values are rounded up to steps of 1/STEPS in -log10, so a length class has a fixed number of ranks.
STEPS, LAST = 16, 480
RESULT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]


def _pieces(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Matches of one kind in order: length of the text before each since the last one, match, measured group."""
    p = F.lit(pattern)
    return F.when(text.rlike(pattern), F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
                     F.regexp_extract_all(text, p, F.lit(group)).alias("g")),
        lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"),
                                F.length(m["m"]).alias("len"), F.length(m["g"]).alias("measure"),
                                F.when(F.lit(kind == len(BASE_KINDS)), m["m"]).alias("token"))))


def matches(keyed: DataFrame, row_key: str, text_col: str) -> DataFrame:
    """(row, kind, start, end, token): every match that is long enough."""
    patterns = [*((p, g) for _, p, g, _ in BASE_KINDS), (TOKEN, 0)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,measure:int,token:string>>")
    every = F.concat(*[F.coalesce(_pieces(text, i, p, g), none) for i, (p, g) in enumerate(patterns)])
    rows = keyed.select(F.col(row_key).alias("row"), F.posexplode(every).alias("at", "x")).select("row", "at", "x.*")
    # the place of a match follows from the lengths before it
    place = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in BASE_KINDS], F.lit(1)), F.col("kind") + 1)
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(place)
    return (rows.withColumn("end", end).filter(F.col("len").isNotNull() & (F.col("measure") >= least))
            .select("row", "kind", (F.col("end") - F.col("len")).cast("int").alias("start"),
                    F.col("end").cast("int").alias("end"), "token"))


def _upper_tail(z: Column) -> Column:
    """P(N > z): rational approximation of erfc, good to 1.5e-7 (constants are fixed values)."""
    x = F.abs(z) / F.lit(2 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    poly = t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592)
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def _battery(token: Column, alphabet: Column, size: Column) -> Column:
    """Fisher's combination of the three tests for one token."""
    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        a = size.cast("double")
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        # counts of equal symbols: a sorted copy, the run lengths squared
        squares = F.aggregate(
            F.array_sort(v), F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda s, x: F.struct(
                x.alias("last"), F.when(x == s["last"], s["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
                (s["sum"] + F.when(x == s["last"], s["run"] * 2 + 1).otherwise(F.lit(1.0))).alias("sum")),
            lambda s: s["sum"])
        # chi-squared with the exact mean and variance of a multinomial, through the cube-root normal form
        df = (a - 1) * n / (n - 1)
        chi = (a * squares / n - n) * n / (n - 1)
        z = (F.pow(F.greatest(chi / df, F.lit(1e-9)), F.lit(1 / 3)) - (1 - 2 / (df * 9))) / F.sqrt(2 / (df * 9))
        uniform = _upper_tail(z)

        high = F.transform(v, lambda x: F.when(x >= a / 2, 1.0).otherwise(0.0))
        one_sided = F.pow(F.lit(2.0), 1 - n)

        def runs(h: Column) -> Column:
            n1 = total(h)
            n0 = n - n1
            changes = total(F.transform(h, lambda x, i: F.when((i > 0) & (x != F.get(h, i - 1)), 1.0).otherwise(0.0)))
            mean = n1 * n0 * 2 / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when((n1 * n0 == 0) | (var <= 0), one_sided).otherwise(
                2 * _upper_tail(F.abs(changes + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))

        def serial(mean: Column) -> Column:
            var = total(F.transform(v, lambda x: (x - mean) * (x - mean)))
            cov = total(F.transform(v, lambda x, i: F.when(
                i > 0, (x - mean) * (F.get(v, i - 1) - mean)).otherwise(0.0)))
            return F.when(var <= 0, one_sided).otherwise(
                2 * _upper_tail(F.abs(cov / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))

        ps = F.array(uniform, let(high, runs), let(total(v) / n, serial))
        x = F.aggregate(ps, F.lit(0.0), lambda s, p: s - F.log(F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0))))
        # chi-squared with six degrees of freedom at 2x has this tail
        return let(x, lambda h: F.exp(-h) * (1 + h + h * h / 2))
    symbols = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                          lambda c: F.instr(alphabet, c).cast("double") - 1)
    return let(symbols, tests)


def random_tokens(candidates: DataFrame, q: float) -> DataFrame:
    """Of (row, kind, start, end, token) those whose randomness the battery does not reject."""
    name = F.lit(None).cast("string")
    letters, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for enc, pattern, alphabet in reversed(ENCODINGS):
        fits = F.col("token").rlike(pattern)
        name = F.when(fits, F.lit(enc)).otherwise(name)
        letters = F.when(fits, F.lit(alphabet)).otherwise(letters)
        size = F.when(fits, F.lit(len(alphabet))).otherwise(size)
    # a token of one kind of letter, or of digits alone, is a word or a number
    mixed = (F.col("token").rlike("[0-9]").cast("int") + F.col("token").rlike("[a-z]").cast("int")
             + F.col("token").rlike("[A-Z]").cast("int")) >= 2
    length = F.length("token")
    scored = staged(
        candidates.filter(mixed).select(
            "row", "kind", "start", "end", name.alias("encoding"),
            F.when(length < 32, 0).when(length < 64, 1).when(length < 128, 2).otherwise(3).alias("class"),
            _battery(F.col("token"), letters, size).alias("p"))
        .withColumn("bin", F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * STEPS), F.lit(LAST)).cast("int")),
        "tokens")
    # Benjamini-Hochberg on the rounded p-values: ranks come from the counts of a fixed number of steps
    steps = scored.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("class").orderBy(F.desc("bin"))
    ranked = steps.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(W.partitionBy("class")))
    rejected = (ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / STEPS) <= F.col("rank") / F.col("m") * q)
                .groupBy("class").agg(F.min("bin").alias("limit")))
    # one row for each of the four length classes at most
    return (scored.join(F.broadcast(rejected), "class", "left")
            .filter(F.col("limit").isNull() | (F.col("bin") < F.col("limit")))
            .select("row", "kind", "start", "end"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = 0.05,
                 row_key: str | None = None) -> DataFrame:
    """Per document: id, ``row_key`` if given, counts, digests and ``found``, the (start, kind, end) list.

    ``q`` bounds the expected share of random tokens among those that the
    battery discards as ordinary.
    """
    key = row_key or "__row"
    keyed = docs if row_key else with_row_key(docs, key)
    hits = staged(matches(keyed, key, text_col), "matches")
    base = hits.filter(F.col("kind") < len(BASE_KINDS)).select("row", "kind", "start", "end")
    extra = random_tokens(hits.filter(F.col("kind") == len(BASE_KINDS)), q)
    per_row = base.union(extra).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    found = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    names = F.array(*map(F.lit, KINDS))

    def text(xs: Column) -> Column:
        return F.concat_ws(",", F.transform(xs, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    return (keyed.select(F.col(key).alias("row"), F.col(id_col).alias("__id"))
            .join(per_row, "row", "left").withColumn("found", found)
            .select(F.col("__id").alias(id_col), *([F.col("row").alias(row_key)] if row_key else []),
                    *[count(i).alias(f"n_{k[0]}") for i, k in enumerate(BASE_KINDS)],
                    F.sha2(text(F.filter("found", lambda x: x["kind"] < len(BASE_KINDS))), 256).alias("base_sha256"),
                    text(F.col("found")).alias("spans"), "found"))


def redact(docs: DataFrame, found: DataFrame, row_key: str, text_col: str = "text",
           mark: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``, and ``length_col`` set to the new length.

    Documents without spans are left as they are.
    """
    at = free_name(docs, "found")
    spans = found.filter(F.size("found") > 0)
    # overlapping spans become one: a span counts from where those before it ended
    merged = F.aggregate(
        "found", F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
                            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
                                F.element_at(a, -1)["start"].alias("start"),
                                F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
    joined = docs.join(spans.select(row_key, merged.alias(at)), row_key, "left")
    text = F.col(text_col)
    pieces = F.transform(at, lambda x, i: F.substring(
        text, F.when(i > 0, F.get(F.col(at), i - 1)["end"]).otherwise(0) + 1,
        x["start"] - F.when(i > 0, F.get(F.col(at), i - 1)["end"]).otherwise(0)))
    rest = F.substring(text, F.element_at(at, -1)["end"] + 1, F.length(text))
    marked = joined.withColumn(text_col, F.when(F.col(at).isNull(), text).otherwise(
        F.concat(F.concat_ws(mark, pieces), F.lit(mark), rest)))
    if length_col:
        marked = marked.withColumn(length_col, F.when(F.col(at).isNull(), F.col(length_col)).otherwise(
            F.length(text_col).cast(docs.schema[length_col].dataType)))
    return marked.drop(at)
