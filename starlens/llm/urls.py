"""URL filters: pattern rules indexed by their rarest literal token (DataFrame functions only).

A pattern rule is written as in common filter lists: literal characters, ``*``
for anything, ``^`` for a separator or the end, a leading ``||`` for the start
of the host or of one of its labels, a trailing ``|`` for the end, and ``@@``
before rules that allow.  From the literal parts follow the tokens that every
matching URL must hold.  Each rule is filed under the one of them that the
fewest URLs hold; a URL's tokens fetch its candidate rules, and only those run
their regular expressions.  Host rules (a host with its subdomains, and a path
prefix) are filed under their host and fetched by the URL's host suffixes.

Defined results: a NULL URL and one without ``://`` have an empty host and path
and are judged by the patterns alone; an empty path does not start with ``/``;
of the host rules that fit, the one with the longest text wins (of the same
text the one listed first); repeated rows and NULL ids are judged row by row;
URLs of any length are read whole; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, with_row_key

#: Rule tables of at most this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000

#: Pattern rules against pages that are no articles, over lower-cased URLs.
PATTERN_RULES = [
    # session ids, edit forms, reply links
    *[f"{mark}{name}=" for name in ("phpsessid", "jsessionid", "sessionid", "sid", "replytocom") for mark in "?&;"],
    "?action=edit^", "&action=edit^", "?action=history^", "&action=history^",
    # accounts, shops, administration
    *[f"/{name}^" for name in ("login", "logout", "signin", "signup", "register", "cart", "checkout", "basket",
                               "wp-admin", "wp-login", "cgi-bin")],
    # advertising, gambling, adult and spam hosts
    *[f"||{name}." for name in ("ads", "adserver", "banner", "tracker", "casino", "poker", "betting", "lottery",
                                "porn", "xxx", "escort", "spam-farm", "link-farm")],
    # files that are no pages
    *[f".{name}^" for name in ("exe", "msi", "apk", "dmg", "iso", "jpg", "jpeg", "png", "gif", "svg", "ico", "css",
                               "js", "zip", "gz", "mp3", "mp4")],
    # help pages about accounts are articles
    "@@/help/login^", "@@/docs/",
]


def compile_rule(rule: str) -> tuple[str, list[str], bool]:
    """(regular expression, literal tokens that every match holds, allows)."""
    allows = rule.startswith("@@")
    body = rule.removeprefix("@@")
    host = body.startswith("||")
    body = body.removeprefix("||")
    end = body.endswith("|")
    body = body.removesuffix("|").lower()
    if not body.strip("*^"):
        raise ValueError(f"a pattern rule needs literal characters: {rule!r}")
    expression = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    expression = (r"://(?:[^/?#]*\.)?" if host else "") + expression + ("$" if end else "")
    # a token is whole where the rule itself sets its two ends
    edged = ("/" if host else "*") + body + ("/" if end else "*")
    tokens = [m[1] for m in re.finditer(r"(?<![a-z0-9*])(?=([a-z0-9]+)(?![a-z0-9*]))", edged)]
    return expression, tokens, allows


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path


def filter_urls(pages: DataFrame, host_rules: list[tuple[str, str, str]] = (),
                pattern_rules: list[str] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, and ``patterns``, the pattern rules that match.

    ``host_rules`` are (verdict, host, path prefix).  Without a host rule that
    fits, a URL is blocked if a pattern rule matches and none allows it.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = (with_row_key(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")), "row")
            .withColumn("host", host).withColumn("path", path)
            .withColumn("low", F.lower(F.coalesce("url", F.lit(""))))
            .withColumn("tokens", F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))))
    compiled = [compile_rule(r) for r in pattern_rules]

    def small(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= BROADCAST_RULES else df

    # each pattern rule under the token that the fewest URLs hold
    filed = [(i, t) for i, (_, tokens, _) in enumerate(compiled) for t in dict.fromkeys(tokens)]
    of_rule = spark.createDataFrame(filed, "no int, token string")
    counts = (urls.select(F.explode("tokens").alias("token"))
              .join(small(of_rule.select("token").distinct(), len(filed)), "token", "left_semi")
              .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (of_rule.join(counts, "token", "left").groupBy("no")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "token")).alias("m"))
              .select(F.concat(F.lit("t:"), "m.token").alias("key"), "no"))
    # host rules under their host; rules without a whole token are candidates for every URL
    others = ([("h:" + h.lower(), len(compiled) + i) for i, (_, h, _) in enumerate(host_rules)]
              + [("*", i) for i, (_, tokens, _) in enumerate(compiled) if not tokens])
    index = rarest.union(spark.createDataFrame(others, "key string, no int"))
    rules = spark.createDataFrame(
        [(i, e, None, None, "allow" if allows else "block", 0, r)
         for i, ((e, _, allows), r) in enumerate(zip(compiled, pattern_rules, strict=True))]
        + [(len(compiled) + i, None, h.lower(), p, v, len(h + p), h + p) for i, (v, h, p) in enumerate(host_rules)],
        "no int, expression string, rule_host string, prefix string, kind string, size int, text string")

    # a host rule of k labels can only be the last k labels of a host
    depth = max([h.count(".") + 1 for _, h, _ in host_rules], default=1)
    labels = F.split("host", r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - depth, F.lit(0)) + 1, F.lit(depth))
    suffixes = F.transform(last, lambda x, i: F.concat(
        F.lit("h:"), F.array_join(F.slice(last, i + 1, F.lit(depth)), ".")))
    keys = F.concat(F.transform("tokens", lambda t: F.concat(F.lit("t:"), t)), suffixes, F.array(F.lit("*")))
    n = len(filed) + len(others)
    found = (urls.select("row", "low", "path", F.explode(keys).alias("key"))
             .join(small(index, n), "key").join(small(rules, n), "no")
             .filter(F.when(F.col("expression").isNotNull(), F.expr("low RLIKE expression"))
                     .otherwise(F.startswith("path", "prefix")))
             .groupBy("row").agg(
                 F.max(F.when(F.col("expression").isNull(), F.struct(
                     "size", (-F.col("no")).alias("order"), "text", "kind"))).alias("best"),
                 F.max((F.col("expression").isNotNull() & (F.col("kind") == "allow")).cast("int")).alias("allows"),
                 F.max((F.col("expression").isNotNull() & (F.col("kind") == "block")).cast("int")).alias("blocks"),
                 F.array_sort(F.collect_set(F.when(F.col("expression").isNotNull(), F.col("text")))).alias("patterns")))
    judged = F.when((F.col("blocks") == 1) & (F.col("allows") == 0), F.lit("block")).otherwise(F.lit("allow"))
    return (urls.select("row", "id", "host", "path").join(found, "row", "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.text").alias("rule"),
                    F.coalesce("best.kind", judged).alias("verdict"),
                    F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns")))
