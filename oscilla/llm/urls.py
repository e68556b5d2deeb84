"""URL filtering by host-suffix and path-prefix expressions.

A URL is expanded into (host suffix, directory prefix) expressions. A rule lies under exactly one such expression of
every URL it fits: its own host and its path up to the last ``/``. The two sides meet on a short prefix of the
expression's SHA-256 digest; the full digest, the rest of the rule's path and the precedence are confirmed after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: More rules than this aren't broadcast but joined by a shuffle.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column, most: int) -> Column:
    """The host's last labels, up to ``most`` of them."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _directories(path: Column, most: int) -> Column:
    """The empty prefix and every prefix that ends with a slash, up to the one with ``most`` slashes."""
    parts = F.split(path, "/", most + 2)
    return F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(most))),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))),
    )


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``pages`` (a ``url`` column; all columns kept) plus host, path, rule, verdict.

    rules: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains if the path starts with
    its path; the longest rule wins, then the longer host, then 'block', then the smaller text. No rule: null and
    ``default``. A null url, or one without ``://``, has an empty host and path. Repeated rows stay repeated; columns
    of ``pages`` named host, path, rule or verdict are replaced.
    """
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    directory = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    known = (
        rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .where(F.col("rule_host").isNotNull() & F.col("verdict").isin("allow", "block"))
        .distinct()
        .withColumn("full", _digest(F.col("rule_host"), directory))
        .withColumn("short", F.substring("full", 1, prefix_hex))
    )
    # No expression with more labels or slashes than any rule's fits one.
    slashes = F.length(directory) - F.length(F.translate(directory, "/", ""))
    n, labels, depth = known.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\.", -1))), F.max(slashes)).first()
    if n <= BROADCAST_RULES:
        known = F.broadcast(known)
    expressions = (
        parsed.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(_suffixes(F.col("host"), labels or 1)).alias("suffix"))
        .select("host", "path", "suffix", F.explode(_directories(F.col("path"), depth or 0)).alias("directory"))
        .select("host", "path", _digest(F.col("suffix"), F.col("directory")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
    )
    text = F.concat("rule_host", "rule_path")
    name = fresh(parsed, "best")
    best = (
        expressions.join(known, "short")
        .where((F.col("digest") == F.col("full")) & F.startswith("path", F.col("rule_path")))
        .groupBy("host", "path")
        .agg(
            F.min(
                F.struct(
                    (-F.length(text)).alias("a"),
                    (-F.length("rule_host")).alias("b"),
                    (F.col("verdict") != "block").alias("c"),
                    text.alias("rule"),
                    F.col("verdict").alias("verdict"),
                )
            ).alias(name)
        )
    )
    return (
        parsed.join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col(name)["rule"], "verdict": F.coalesce(F.col(name)["verdict"], F.lit(default))})
        .drop(name)
    )
