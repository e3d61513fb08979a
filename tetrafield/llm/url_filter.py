"""URL rules by hash prefixes, in the manner of browsers' blocklists.

Every URL is expanded into expressions host-suffix + path-prefix. Expressions and rules meet by equi-join on the first
bytes of their SHA-256 digest; full digests confirm the match, and the longest rule that fits decides. Path prefixes are
taken at just those lengths that occur among the rules' paths, host suffixes at their numbers of labels, so "starts with" is exact for any rule, not only for
those that end at a slash. Distinct URLs are judged once and joined back, so a hot URL costs one expansion.

Cases: a null URL or one without "://" has empty host and path, fits no rule and gets the default verdict; an empty rule
table leaves the default for all; of two rules with the same text "block" wins; repeated rows each get their verdict;
a very long URL is expanded at the rules' lengths only. Input columns that clash with the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty

# (host, path, verdict): the rules of the query's contract, fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
ADDED = ("host", "path", "rule", "verdict")
PREFIX = 8  # hex digits that meet in the join
BROADCAST_RULES = 100_000  # rules beyond this count are shuffled instead
URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: str) -> Column:
    return ascii_lower(F.regexp_extract(text_or_empty(url), URL, 1))


def path_of(url: str) -> Column:
    return F.regexp_extract(text_or_empty(url), URL, 2)


def _host_suffixes(host: Column, labels: list[int]) -> Column:
    """The host's ends of so many labels."""
    parts = F.split(host, r"\.", -1)
    ends = F.transform(F.array(*map(F.lit, labels)) if labels else F.array().cast("array<int>"), lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))
    return F.filter(ends, lambda x: x.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (its text, or null) and verdict added."""
    rows = pages.drop(*(c for c in ADDED if c in pages.columns))
    known = (
        rules.select(F.concat("host", "path").alias("rule"), F.length("path").alias("n"), F.size(F.split("host", r"\.", -1)).alias("labels"), "verdict")
        .filter("rule IS NOT NULL")
        .groupBy("rule", "n", "labels")
        .agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
        .withColumn("digest", F.sha2(F.col("rule").cast("binary"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX))
    )
    # Lengths of rule paths and numbers of labels: at most as many as a rule has characters.
    lengths, labels = (sorted(r[0] for r in known.select(c).distinct().collect()) for c in ("n", "labels"))
    if known.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    urls = rows.select(F.col(url_col).alias("_url")).filter("_url IS NOT NULL").distinct()
    split = urls.select("_url", host_of("_url").alias("h"), path_of("_url").alias("p")).filter("h <> '' OR p <> ''")
    starts = F.array_distinct(F.filter(F.transform(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.when(F.length("p") >= n, F.substring(F.col("p"), F.lit(1), n))), lambda x: x.isNotNull()))
    expressions = split.select("_url", F.explode(_host_suffixes(F.col("h"), labels)).alias("s"), starts.alias("starts")).select("_url", F.explode(F.transform("starts", lambda x: F.concat("s", x))).alias("expression"))
    hashed = expressions.withColumn("full", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("prefix", F.substring("full", 1, PREFIX))
    found = hashed.join(known, "prefix").filter("full = digest AND expression = rule")
    best = found.groupBy("_url").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    judged = rows.withColumns({"host": host_of(url_col), "path": path_of(url_col), "_url": F.col(url_col)}).join(best, "_url", "left")
    return judged.select(*rows.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
