"""Driver queries of this subpackage, with SQL where SQL can express the result.

Each query reads whole tables and derives its contract columns from the
operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .common import crc32_mod, table
from .decontaminate import decontaminate
from .lm import score_texts
from .mixing import mix_sources, taken_words
from .quality import quality_rules
from .search import search
from .secrets import find_secrets
from .simhash import simhash_groups
from .token_files import token_output
from .toxicity import toxicity_scores
from .urls import PATTERN_RULES, compile_rule, filter_urls
from .vector_codes import code_report, compress_vectors
from .warc import warc_round_trip

HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
              ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocab_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output(table(spark, d, "documents"), vocab_path(), end_id=2)


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc_round_trip(table(spark, d, "pages"), min_revisit_bytes=0)


def op3_bpe(spark: SparkSession, d: str) -> DataFrame:
    return encode_digests(table(spark, d, "documents"), vocab_path())


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    mod = crc32_mod(F.col("doc_id"), 5)
    scores = toxicity_scores(table(spark, d, "documents"), table(spark, d, "labels"), mod != 0)
    return scores.select("doc_id", (mod == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules(table(spark, d, "documents")).drop("gone_lines")


def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_groups(table(spark, d, "documents"), shingle=4, seed=42, max_bits=4)


def op7_lm(spark: SparkSession, d: str) -> DataFrame:
    mod = crc32_mod(F.col("doc_id"), 7)
    scored = score_texts(table(spark, d, "documents"), mod != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op8_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_urls(spark: SparkSession, d: str) -> DataFrame:
    return filter_urls(table(spark, d, "pages"), HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, d: str) -> DataFrame:
    return find_secrets(table(spark, d, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_mixing(spark: SparkSession, d: str) -> DataFrame:
    return taken_words(mix_sources(table(spark, d, "documents")))


def op12_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return code_report(compress_vectors(table(spark, d, "embeddings")))


def op13_search(spark: SparkSession, d: str) -> DataFrame:
    found = search(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (op1_token_output, op2_warc, op3_bpe, op4_toxicity, op5_quality, op6_simhash,
                                   op7_lm, op8_decontaminate, op9_urls, op10_secrets, op11_mixing, op12_vector_codes,
                                   op13_search)}

# ------------------------------------------------------------------ SQL

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_OP2 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
                  sha1(coalesce(html, '')) AS h, coalesce(html, '') AS t FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr({_BASE32},
           1 + (((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '')
         AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last = page_id THEN NULL ELSE last END AS refers_to
FROM m"""

_W = r"[^\x20\x09-\x0D]+"
_OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s
        FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
wl AS (SELECT r, source, t, line, len(regexp_extract_all(line, '{_W}')) AS n,
              trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
       FROM l WHERE regexp_matches(line, '{_W}')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM wl GROUP BY r),
per_line AS (SELECT source, norm, count(DISTINCT t) AS docs FROM wl GROUP BY source, norm),
per_host AS (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source),
freq AS (SELECT a.source, a.norm FROM per_line a JOIN per_host b ON a.source IS NOT DISTINCT FROM b.source
         WHERE a.docs > 20 AND a.docs > b.docs * 0.1),
gone AS (SELECT r, sum(n) AS n FROM wl JOIN freq f ON wl.norm = f.norm AND wl.source IS NOT DISTINCT FROM f.source GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS n_words_left
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 10 AS kept FROM m"""

_IW = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_IW}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_IW}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n
       FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.n = iw.n),
words AS (SELECT r, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, n)) AS u(k) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def _op9() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    compiled = [compile_rule(r) for r in PATTERN_RULES]
    any_of = lambda allows: " OR ".join(
        f"regexp_matches(low, {quote(e)})" for e, _, a in compiled if a == allows)
    rules = ", ".join(f"({i}, {quote(v)}, {quote(h)}, {quote(p)})" for i, (v, h, p) in enumerate(HOST_RULES))
    return rf"""
WITH rules(no, verdict, h, p) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, lower(coalesce(url, '')) AS low,
             CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
s AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
x AS (SELECT r, page_id, low, {_AZ.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
best AS (SELECT r, h || p AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, no) AS k
         FROM x JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(best.verdict,
       CASE WHEN ({any_of(False)}) AND NOT ({any_of(True)}) THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN best ON x.r = best.r AND best.k = 1"""


def _op12(rounds: int = 4, entries: int = 256) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT p.r, p.pt, any_value(p.v) AS v, arg_min(b.e, b.e + {entries} * (p.vv - 2 * list_dot_product(p.f, b.f) + b.vv)) AS e,
              min(p.vv - 2 * list_dot_product(p.f, b.f) + b.vv)::BIGINT AS d FROM p JOIN b{k} b USING (pt) GROUP BY p.r, p.pt)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT pt, e, list(c ORDER BY i) AS c FROM (SELECT pt, e, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c
              FROM (SELECT pt, e, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{k}) GROUP BY pt, e, i) GROUP BY pt, e),
b{k + 1} AS MATERIALIZED (SELECT *, list_dot_product(f, f) AS vv FROM (SELECT b.pt, b.e, coalesce(m.c, b.c) AS c, coalesce(m.c, b.c)::DOUBLE[] AS f
              FROM b{k} b LEFT JOIN m{k} m USING (pt, e)))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, len(x) // 4 AS w FROM k),
p AS MATERIALIZED (SELECT *, list_dot_product(f, f) AS vv FROM (SELECT r, pt, x[pt * w + 1:(pt + 1) * w] AS v, x[pt * w + 1:(pt + 1) * w]::DOUBLE[] AS f
      FROM n, unnest(range(4)) AS t(pt))),
b0 AS MATERIALIZED (SELECT pt, r AS e, v AS c, f, vv FROM p WHERE r < {entries}),
{", ".join(steps)},
s AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY pt) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pt, e)) FROM b{rounds}) AS codebooks_sha256
FROM n JOIN s USING (r)"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_TERM}') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS m
      FROM (SELECT item_id, unnest(regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, c.n),
m AS (SELECT r, doc_id, 25 + (75 * len(w)::BIGINT * c.n) // c.l AS m FROM d, c),
s AS (SELECT item_id, r, doc_id, sum(q.m * f.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score
      FROM p JOIN q USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL HAVING score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""


ORACLE = {"op12_vector_codes": _op12(), "op13_search": _OP13, "op2_warc": _OP2, "op5_quality": _OP5, "op8_decontaminate": _OP8, "op9_urls": _op9()}
