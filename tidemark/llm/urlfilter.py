"""URL rules by expression digests.

A rule has a host and a path. It fits a url if the host is the rule's or a subdomain of it
and the path starts with the rule's. Each url is expanded into every host suffix at a dot
followed by every path prefix at a slash; a rule is filed under its host and its path up to
the last slash. Both sides join on the first hex digits of the SHA-256 of that expression;
the whole digest and the rest of the rule's path confirm. The longest rule wins, of equally
long ones the longer host, then block before allow.

Expansion goes no deeper than the deepest rule, which loses nothing. Different sites (host
and path) are expanded once, however often they occur. Null urls and urls without ``://``
have empty host and path and fit no rule. Rules without a host fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lower_ascii

#: Hex digits of the digest that the join uses.
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def _expression_digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def filed(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with the digest of the expression they are filed under."""
    host, path = lower_ascii(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    anchor = F.regexp_extract(path, "(?s)^(.*/)?", 0)
    digest = _expression_digest(host, anchor)
    return rules.filter(F.length("host") > 0).select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"),
        digest.alias("digest"),
        host.alias("rule_host"),
        path.alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    )


def depths(rules: DataFrame) -> tuple[int, int]:
    """Most host labels and most slashes of a rule."""
    row = rules.agg(
        F.max(F.size(F.split("host", r"\.", -1))), F.max(F.size(F.split(F.coalesce("path", F.lit("")), "/", -1)) - 1)
    ).first()
    return row[0] or 0, row[1] or 0


def expanded(sites: DataFrame, labels: int, slashes: int) -> DataFrame:
    """Sites (host, path) with one row per expression: its digest and its short prefix."""
    # a literal empty entry keeps the arrays typed when there are no rules
    hosts = F.array_distinct(F.array(F.lit(""), *(F.substring_index("host", ".", -n) for n in range(1, labels + 1))))
    paths = F.array(
        F.lit(""), *(F.concat(F.substring_index("path", "/", n), F.lit("/")) for n in range(1, slashes + 1))
    )
    return (
        sites.withColumn("_suffix", F.explode(F.filter(hosts, lambda h: h != "")))
        .withColumn("_start", F.explode(F.array_distinct(F.filter(paths, lambda p: F.col("path").startswith(p)))))
        .withColumn("digest", _expression_digest(F.col("_suffix"), F.col("_start")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
        .drop("_suffix", "_start")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    Columns of these names are replaced; every row stays, repeated ones too.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(*kept, host.alias("host"), path.alias("path"))
    sites = pages.select(host.alias("host"), path.alias("path")).distinct()
    book = filed(rules)
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict"), rule.alias("rule")))
    won = (
        expanded(sites, *depths(rules))
        .join(book.withColumnRenamed("digest", "rule_digest"), "prefix")
        .filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(best.alias("best"))
        .select(F.col("host").alias("won_host"), F.col("path").alias("won_path"), "best")
    )
    return rows.join(won, (rows["host"] == won["won_host"]) & (rows["path"] == won["won_path"]), "left").select(
        *(rows[f"`{c}`"] for c in rows.columns),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )
