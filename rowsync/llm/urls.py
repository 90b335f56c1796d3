"""URL filtering by host-suffix and path-prefix expressions (SQL functions only).

Each distinct URL is expanded into expressions ``suffix + folder`` (``a.b.net``
and ``/en/x`` give ``net/``, ``b.net/en/`` ...). Expressions meet the rules in
an equi-join on a short prefix of their SHA-256; the full digest is confirmed
afterwards, then the longest rule that fits wins. Expansion goes no deeper than
the deepest rule, so a URL with very many labels or folders stays small.

Defined results: a null URL or one without ``://`` has an empty host and path
and is judged by the default. Repeated rows each get their row. An empty rule
table judges all by the default. Rules that tie in length: block wins, then the
smaller rule text. Rule hosts are compared lower-cased; rules with a null host,
path or verdict are ignored. Other columns of ``pages`` do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_table

# The contract's rules (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

PREFIX_HEX = 8  # of the SHA-256 in hex: the equi-join's key is four bytes


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return small_table(spark, RULES if rules is None else rules, "host string, path string, verdict string")


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(bare, r"(?s)^[^/]*", 0)
    return _lower_ascii(host), bare.substr(F.length(host) + 1, F.length(bare))


def _folder(path: Column) -> Column:
    """A path up to and with its last slash."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    own = rules.dropna(subset=["host", "path", "verdict"]).select(
        _lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    own = own.withColumn("r_folder", _folder(F.col("r_path")))
    own = own.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_folder")))
    own = own.withColumn("short", F.substring("r_digest", 1, PREFIX_HEX)).distinct()
    deep = own.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_folder", "/")) - 1)).first()
    most_labels, most_folders = deep[0] or 0, deep[1] or 0

    host, path = split_url(F.col("link"))
    links = pages.select(F.col(url).alias("link")).distinct()
    links = links.select("link", host.alias("h"), path.alias("p"))
    labels, parts = F.split("h", r"\."), F.split("p", "/")
    n_host = F.least(F.size(labels), F.lit(most_labels))
    # a folder is a prefix that ends in a slash; 0 stands for the empty one
    n_path = F.least(F.size(parts) - 1, F.lit(most_folders))
    suffixes = F.transform(F.sequence(F.lit(1), n_host), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    folders = F.transform(F.sequence(F.lit(0), n_path), lambda k: F.when(k == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    terms = links.filter(n_host >= 1).select("link", "p", F.explode(suffixes).alias("e_host"), folders.alias("all_folders"))
    terms = terms.select("link", "p", "e_host", F.explode("all_folders").alias("e_folder"))
    terms = terms.withColumn("digest", _digest(F.col("e_host"), F.col("e_folder")))
    terms = terms.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    hits = terms.join(own, "short").filter("digest = r_digest AND startswith(p, r_path)")
    text = F.concat("r_host", "r_path")
    best = hits.groupBy("link").agg(F.min(F.struct(
        (-F.length(text)).alias("longest"), (F.col("r_verdict") != "block").alias("allows"), text.alias("rule"),
        F.col("r_verdict").alias("verdict"))).alias("best"))

    clash = [c for c in ("host", "path", "rule", "verdict", "link", "best") if c in pages.columns and c != url]
    kept = pages.drop(*clash)
    host, path = split_url(F.col(url))
    out = kept.join(best.withColumnRenamed("link", "_link"), F.col(url) == F.col("_link"), "left")
    return out.select(*kept.columns, host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
                      F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
