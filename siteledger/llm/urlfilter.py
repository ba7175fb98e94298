"""URL rules by host suffix and path prefix, as DataFrame operations only.

A URL is expanded to one expression for each suffix of its host (whole labels) and each prefix of its path that a
rule could have. Expressions are joined to the rules on the first 32 bits of a SHA-256 digest; the full digest then
confirms the match, and the longest rule wins. The rules are broadcast if they are few (a counted bound);
otherwise both sides are dealt by the hash prefix, after the URLs have been made distinct.

Defined cases: a null URL, and one without ``://``, has an empty host and path; user info and port are part of the
host; A-Z in the host is lower-cased, the path is left as it is; a rule's path fits any path that starts with it (an
empty path starts with no ``/``); of rules of equal length the one with the longer host wins, then block before
allow; very long URLs are expanded whole; repeated rows are judged each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to this many rules are broadcast: a row has two strings and a digest, so some tens of MB.
BROADCAST_RULES = 100_000
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """host, path, verdict (allow or block)."""
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """host suffix + path prefix, for every suffix at a label and every prefix length that a rule has."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))
    return F.filter(both, lambda e: e["host"] != "")


def digest(host: Column, path: Column) -> Column:
    # The hosts' own characters exclude a space, so the pair can be told from any other.
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def judge(pages: DataFrame, filters: DataFrame, default: str = "allow", broadcast_limit: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    named = filters.select(F.translate("host", *LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null and verdict is not null")
    sums = named.groupBy(F.length("path").alias("n")).count().collect()  # as many rows as rule paths have lengths
    lengths, size = sorted(r.n for r in sums), sum(r["count"] for r in sums)
    keyed = named.select(F.col("verdict").alias("rule_verdict"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), digest(F.col("host"), F.col("path")).alias("rule_digest"))
    keyed = keyed.withColumn("short", F.substring("rule_digest", 1, 8))

    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return parsed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    expanded = parsed.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
    probes = expanded.select("host", "path", digest(F.col("e.host"), F.col("e.path")).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    near = probes.join(F.broadcast(keyed) if size <= broadcast_limit else keyed, "short")
    hits = near.filter(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), "host_length", (F.col("rule_verdict") == "block").alias("block"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), rank).alias("best"))
    # The hash is part of the key, so that both sides are dealt anew and a URL of very many rows can be split.
    key = lambda df: df.withColumn("url_hash", F.xxhash64("host", "path"))
    judged = key(parsed).join(key(best), ["url_hash", "host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
