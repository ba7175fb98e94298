"""Robots rules: texts to rule rows, and whether a target is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteledger.functions.text import trim_wide

TOKEN = "siteledgerbot"  # our agent token; a group names us if its agent text is part of it


def _lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "raw"))
    line = trim_wide(F.regexp_replace("raw", "#.*$", ""))
    colon = F.instr(line, ":")
    named = rows.filter(colon > 0).select("host", "ord", F.lower(trim_wide(F.substring_index(line, ":", 1))).alias("name"), trim_wide(F.regexp_replace(line, "^[^:]*:", "")).alias("value"))
    return named


def sitemaps(texts: DataFrame) -> DataFrame:
    """host, ord, url of the sitemap lines, whichever group they stand in."""
    return _lines(texts).filter((F.col("name") == "sitemap") & (F.col("value") != "")).select("host", "ord", F.col("value").alias("url"))


def rules(texts: DataFrame, token: str = TOKEN) -> DataFrame:
    """host, ord, allow, pattern for our agent. Groups that name it win over '*'. texts: host (one row each), text.

    A group starts at a user-agent line that follows a rule or opens the text.
    """
    lines = _lines(texts).filter(F.col("name").isin("user-agent", "allow", "disallow"))
    by_host = Window.partitionBy("host").orderBy("ord")  # the lines of one robots text
    agent = F.col("name") == "user-agent"
    opens = agent & F.coalesce(F.lag("name").over(by_host) != "user-agent", F.lit(True))
    grouped = lines.withColumn("grp", F.sum(opens.cast("int")).over(by_host)).filter("grp > 0")
    named = agent & (F.col("value") != "*") & F.lit(token).contains(F.lower("value"))
    kinds = grouped.groupBy("host", "grp").agg(F.max(F.coalesce(named, F.lit(False))).alias("ours"), F.max(agent & (F.col("value") == "*")).alias("any"))
    any_ours = kinds.groupBy("host").agg(F.max("ours").alias("named"))
    chosen = kinds.join(any_ours, "host").filter(F.when(F.col("named"), F.col("ours")).otherwise(F.col("any"))).select("host", "grp")
    return grouped.filter(~agent & (F.col("value") != "")).join(chosen, ["host", "grp"]).select("host", "ord", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))


def fits(target: Column, pattern: Column) -> Column:
    """Whether a pattern fits a target: '*' is any run, a last '$' is the end, everything else stands for itself.

    The parts between stars are sought one after another, each from where the one before ended.
    """
    whole = pattern.endswith("$")
    parts = F.split(F.regexp_replace(pattern, r"\$$", ""), r"\*", -1)
    first, last, n = F.get(parts, 0), F.get(parts, F.size(parts) - 1), F.size(parts)
    middle = F.slice(parts, 2, F.greatest(n - F.when(whole, 2).otherwise(1), F.lit(0)))
    found = lambda at, part: F.when(at > 0, F.when(part == "", at).otherwise(F.call_function("locate", part, target, at)))
    after = F.aggregate(middle, F.length(first) + 1, lambda at, part: F.coalesce(F.when(found(at, part) > 0, found(at, part) + F.length(part)), F.lit(0)))
    ends = F.when(n == 1, target == first).otherwise((after > 0) & target.endswith(last) & (F.length(target) - F.length(last) + 1 >= after))
    return target.startswith(first) & F.when(whole, ends).otherwise(after > 0)


def allowed(targets: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """targets (host, request_target) with allowed: the longest literal wins, allow wins ties, default allow.

    A rule's literal up to its first wildcard is its key. A target is expanded to its prefixes of the lengths that the
    literals of its host have, and joined to the rules by equality; only patterns with a wildcard are then checked further.
    So a host of many rules costs each target about the rules that fit it.
    """
    distinct = targets.select("host", "request_target").distinct()
    literal = F.regexp_extract("pattern", r"^([^*]*?)(?:\*|\$$|$)", 1)
    ruled = rule_rows.select("host", "allow", "pattern", literal.alias("literal"), F.length(F.regexp_replace("pattern", r"[*$]", "")).alias("weight"))
    # A literal has at most as many lengths as a URL has characters.
    lengths = ruled.groupBy("host").agg(F.collect_set(F.length("literal")).alias("lengths"))
    prefixes = distinct.join(lengths, "host").select("host", "request_target", F.explode(F.filter("lengths", lambda n: n <= F.length("request_target"))).alias("length"))
    keyed = prefixes.select("host", "request_target", F.expr("left(request_target, length)").alias("literal"))
    hits = keyed.join(ruled, ["host", "literal"]).filter(~F.col("pattern").rlike(r"\*|\$$") | fits(F.col("request_target"), F.col("pattern")))
    verdicts = hits.groupBy("host", "request_target").agg(F.max_by("allow", F.struct("weight", "allow")).alias("verdict"))
    return targets.join(verdicts, ["host", "request_target"], "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")
