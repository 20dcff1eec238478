"""URL filters: host-suffix and path-prefix expressions, looked up by digest.

A url is expanded into every combination of a suffix of its host, cut at dots, and a prefix
of its path of a length that some rule has. Expressions meet the rules on the first 32 bits
of their SHA-256, an equi-join; the full digest then confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.llm.shared import column, spread_join, stored

#: Hex digits of the digest that the join uses.
SHORT = 8
#: Path lengths of rules up to which urls are cut at those alone; beyond, at every length.
LENGTHS = 4096


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to the next ?, # or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # no host holds a slash, so the two can't run together in two ways
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a DataFrame; of one host and path with two verdicts, block holds."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict.

    rules: columns verdict (allow or block), host, path. A rule fits its host and all of its
    subdomains if the url's path starts with the rule's. Of those that fit, the one with most
    characters wins, then the one with the longer host, then block. rule is host and path of
    the winner, null if none fits; then the verdict is default: a list that names what to
    block lets everything else pass. A url that is null or has no :// has an empty host and
    path; long ones count whole. Repeated rows, and repeated page_ids, get their row each. Rules
    with nulls are ignored. Other columns are not read. An empty table gives an empty one.
    """
    urls = pages.select(column(page_id).alias("page_id"), host_of(column(url)).alias("host"), path_of(column(url)).alias("path"))
    known = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in known.select(F.length("path")).distinct().orderBy(F.length("path")).limit(LENGTHS + 1).collect()]
    known = known.select(_digest(F.col("host"), F.col("path")).alias("rule_digest"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"))
    known = known.withColumn("short", F.substring("rule_digest", 1, SHORT))

    # equal urls are looked up once, and so is each expression of theirs
    sites, _ = stored(urls.groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("site", _digest(F.col("host"), F.col("path"))), "sites")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    # rules of more lengths than are worth a list: every prefix
    wished = F.array(*(F.lit(n) for n in lengths)).cast("array<int>") if len(lengths) <= LENGTHS else F.sequence(F.lit(0), F.length("path"))
    prefixes = F.transform(F.filter(wished, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    wide = sites.select("site", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    wide = wide.select("site", "suffix", F.explode("prefixes").alias("prefix"))
    asked = wide.select("site", _digest(F.col("suffix"), F.col("prefix")).alias("digest"))
    each = asked.groupBy("digest").agg(F.count("*").alias("times")).withColumn("short", F.substring("digest", 1, SHORT))
    hits, _ = stored(each.join(known, "short").where("digest = rule_digest").select("digest", "times", "rule", "verdict", "host_len"), "hits")
    fits = spread_join(asked, hits, ["digest"], "times")
    best = fits.groupBy("site").agg(F.max(F.struct(F.length("rule").alias("len"), "host_len", "verdict", "rule")).alias("best"))
    facts, _ = stored(sites.select("site", "n").join(best, "site", "left").select("site", "n", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict")), "facts")
    out = spread_join(urls.withColumn("site", _digest(F.col("host"), F.col("path"))), facts, ["site"], "n")
    return out.select("page_id", "host", "path", "rule", "verdict")
