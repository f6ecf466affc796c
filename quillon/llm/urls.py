"""URL filters by rules indexed on their rarest literal token. Native: no Python in the plan.

Pattern rules are (name, verdict, regular expression, alternatives): any match contains all literal tokens of at least one of the alternatives. How many of the
table's distinct urls have each token is counted; a rule is filed once for each alternative, under its rarest token; each url's tokens fetch
candidate rules, and only those rules' expressions run. A rule without alternatives, or with an empty one, is a candidate for every url. Rules may be
given as tables. Host rules are (verdict, host, path prefix) and are
fetched by the url's host suffixes in the same way. The longest host rule decides; without one, a
matching allow pattern does, then a matching block pattern; all else is allowed.

Cases: a very long url is matched whole; a null url, or one without ://, has an empty host and path and is fitted by no host rule, but patterns
still see a text that isn't null; repeated rows get the same verdict; an empty table gives an empty
result; other columns are kept, unless an added column has their name.
Plan: equal urls are judged once (partial aggregation takes hot urls), then joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS

#: (verdict, host, path)
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: (name, verdict, pattern, alternatives). Tokens are whole runs of lower-case letters and digits that a match has as whole runs.
PATTERN_RULES = (
    ("spam-host", "block", r"(?i)^[a-z]+://([^/?#]*\.)?spam-farm\.", (("spam", "farm"),)),
    ("tracked-feed", "block", r"(?i)[?&]utm_source=feed(&|#|$)", (("utm", "source", "feed"),)),
    ("click-redirect", "block", r"(?i)/(out|redirect|click)[/?].*https?(:|%3a)", (("out",), ("redirect",), ("click",))),
    ("archive", "block", r"(?i)\.(zip|exe|tar\.gz)([?#]|$)", (("zip",), ("exe",), ("tar", "gz"))),
    ("mobile-article", "allow", r"(?i)^https?://m\.[^/]+/[a-z]{2}/\d+\.html$", (("m", "html"),)),
)
TOKEN = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: F.Column) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


PATTERNS = "k long, pattern string, verdict string, regex string, alternatives array<array<string>>"
HOSTS = "verdict string, suffix string, prefix string"


def _table(spark: SparkSession, rules, schema: str, rows) -> DataFrame:
    """Rules as a table: given as one, or as tuples."""
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame(rows(rules), schema)


def _few(df: DataFrame) -> DataFrame:
    """Sent to all executors if it has few rows, which are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def judge(df: DataFrame, url: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Add host, path, rule (the host rule, like net/), pattern (the name of the pattern rule that decided or would) and verdict. Of two matching patterns with one
    verdict the first decides. As tables rules have the columns of HOSTS and PATTERNS, k being a pattern's place."""
    spark = df.sparkSession
    urls = df.select(F.col(f"`{url}`").alias("url")).where("url IS NOT NULL").distinct()
    urls = urls.select("url", host_of("url").alias("host"), path_of("url").alias("path"))

    # host rules: each suffix of the host, at the dots
    parts = F.split("host", r"\.")
    suffixes = F.when(F.col("host") != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    rules = _table(spark, host_rules, HOSTS, lambda rules: [tuple(r) for r in rules])
    rules = _few(rules.select("verdict", "suffix", "prefix", F.concat("suffix", "prefix").alias("rule"), (F.length("suffix") + F.length("prefix")).alias("length")))
    fits = urls.select("url", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix").where(F.startswith("path", "prefix"))
    by_host = fits.groupBy("url").agg(F.max(F.struct("length", "rule", "verdict")).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))

    # pattern rules: each alternative is filed under the rarest of its tokens, the empty token being one of every url
    patterns = _table(spark, pattern_rules, PATTERNS, lambda rules: [(k, name, verdict, regex, [list(a) for a in alternatives]) for k, (name, verdict, regex, alternatives) in enumerate(rules)])
    ways = patterns.select("k", F.posexplode(F.when(F.size("alternatives") > 0, F.col("alternatives")).otherwise(F.array(F.array(F.lit(""))))).alias("way", "needs"))
    ways = ways.select("k", "way", F.explode(F.when(F.size("needs") > 0, F.col("needs")).otherwise(F.array(F.lit("")))).alias("token"))
    tokens = urls.select("url", F.explode(F.array_union(tokens_of(F.col("url")), F.array(F.lit("")))).alias("token"))
    seen = tokens.join(_few(ways.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    # a row for each alternative: bounded by the rules
    rarest = ways.join(seen, "token", "left").groupBy("k", "way").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token"))["token"].alias("token"))
    filed = _few(rarest.select("k", "token").distinct().join(patterns.select("k", "pattern", "verdict", "regex"), "k"))
    hits = tokens.join(filed, "token").where(F.expr("url RLIKE regex"))
    order = F.struct((F.col("verdict") == "allow").alias("a"), (-F.col("k")).alias("k"), F.col("pattern").alias("pattern"), F.col("verdict").alias("verdict"))
    by_pattern = hits.groupBy("url").agg(F.max(order).alias("best")).select("url", F.col("best.pattern").alias("pattern"), F.col("best.verdict").alias("pattern_verdict"))

    found = by_host.join(by_pattern, "url", "full").withColumn("verdict", F.coalesce("rule_verdict", "pattern_verdict")).select(F.col("url").alias("__url"), "rule", "pattern", "verdict")
    added = ("host", "path", "rule", "pattern", "verdict")
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], host_of(f"`{url}`").alias("host"), path_of(f"`{url}`").alias("path"))
    return rows.join(found, rows[url] == found["__url"], "left").drop("__url").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
