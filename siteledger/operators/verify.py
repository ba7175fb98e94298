"""Acceptance of an import: route responses, content, media, facts and link closure."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteledger.functions.text import collapse, collapsed
from siteledger.operators.routes import limited

#: So many times at most may seeking each fact by itself read a text and its facts; an automaton's one reading takes about as long.
READINGS = 256


def verify_routes(scope: DataFrame, routes: DataFrame, responses: DataFrame, entities: DataFrame) -> DataFrame:
    """crawl_key, status (PASS, FAIL, NOT_RUN), reason for every row in scope.

    scope: crawl_key. routes: source_url, target_route, expected_status, redirect_to, entity_source_id.
    responses: target, status, location, title, main_text. entities: source_id, title, text.
    """
    r = routes.select(F.col("source_url").alias("crawl_key"), "target_route", "expected_status", "redirect_to", "entity_source_id")
    t = responses.select(F.col("target").alias("target_route"), F.col("status").alias("got_status"), "location", F.col("title").alias("got_title"), "main_text")
    e = entities.select(F.col("source_id").alias("entity_source_id"), F.col("title").alias("want_title"), F.col("text").alias("want_text"))
    rows = scope.select("crawl_key").join(r, "crawl_key", "left").join(t, "target_route", "left").join(e, "entity_source_id", "left")
    reason = (
        F.when(F.col("target_route").isNull(), "ROUTE_MISSING")
        .when(F.col("got_status").isNull(), "NOT_RUN")
        .when(F.col("got_status") != F.col("expected_status"), "STATUS_MISMATCH")
        .when(F.col("redirect_to").isNotNull() & ~F.col("location").eqNullSafe(F.col("redirect_to")), "REDIRECT_MISMATCH")
        .when((F.col("expected_status") == 200) & F.col("want_title").isNull(), "ENTITY_MISSING")
        .when((F.col("expected_status") == 200) & (collapse(F.col("got_title")) != collapse(F.col("want_title"))), "TITLE_MISMATCH")
        .when((F.col("expected_status") == 200) & ~F.contains(collapse(F.col("main_text")), collapse(F.col("want_text"))), "CONTENT_MISMATCH")
    )
    status = F.when(reason.isNull(), "PASS").when(reason == "NOT_RUN", "NOT_RUN").otherwise("FAIL")
    return rows.select("crawl_key", status.alias("status"), reason.alias("reason"))


def missing_facts(facts: list[str], text: str) -> int:
    """How many of the facts the text does not contain, in time that grows with the length of both, whatever their number.

    Each fact is sought by itself, which is fastest, while that reads all characters a bounded number of times at most;
    beyond that, an automaton of all facts reads the text once.
    """
    if len(facts) * len(text) <= READINGS * (len(text) + sum(map(len, facts))):
        return sum(f not in text for f in facts)
    automaton = ahocorasick.Automaton()
    for k, fact in enumerate(facts):
        automaton.add_word(fact, k)
    automaton.make_automaton()
    return len(facts) - len({k for _, k in automaton.iter(text)})


def content_acceptance(facts: DataFrame, pages: DataFrame, key: str = "source_id") -> DataFrame:
    """key, facts, missing, accepted: every factual text of an entity is contained in its page's text.

    facts: key, fact (a text, or an array of texts). pages: key, text. Without a page every fact is missing.

    Texts and facts are sent once, as they are, to their entity's task, and sorted there by entity; white space is collapsed
    and equal facts are dropped where they are sought. A task holds the facts of one entity at a time.
    """
    facts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # texts can be long
    many = isinstance(facts.schema["fact"].dataType, T.ArrayType)
    sought = facts.select(key, F.lit(None).cast("string").alias("text"), (F.col("fact") if many else F.array("fact")).alias("facts"))
    # A row has a text if it is a page's. Pages of no entity (a null key) belong to no facts.
    read = pages.filter(F.col(key).isNotNull()).select(key, F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(None).cast("array<string>").alias("facts"))
    rows = sought.unionByName(read).repartition(key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, entity, texts, own, found = None, None, [], set(), []

        def settle() -> None:
            if own:
                wanted = list(own)
                found.extend((entity, len(wanted), missing_facts(wanted, text)) for text in texts or [""])
            texts.clear()
            own.clear()

        def out() -> pa.RecordBatch:
            entities, n, missing = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(entities, kind), pa.array(n, pa.int32()), pa.array(missing, pa.int32())], [key, "facts", "missing"])

        for batch in batches:
            kind = batch.column(0).type
            for k, text, some in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if k != entity:
                    settle()
                    entity = k
                if text.is_valid:
                    texts.append(collapsed(text.as_py()))
                elif some.is_valid:
                    own.update(collapsed(f) for f in some.as_py() if f is not None)
                    own.discard("")
            if found:
                yield out()
        settle()
        if found:
            yield out()

    checked = rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("facts", T.IntegerType()), T.StructField("missing", T.IntegerType())]))
    return checked.withColumn("accepted", F.col("missing") == 0)


def media_acceptance(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """path, reason for media that does not match; a path with two hashes fails the job. responses: path, status, sha256."""
    want = expected.groupBy("path").agg(F.count_distinct("sha256").alias("n"), F.min("sha256").alias("want"))
    want = want.select("path", F.when(F.col("n") > 1, F.raise_error(F.lit("a public path has two hashes")).cast("string")).otherwise(F.col("want")).alias("want"))
    got = responses.groupBy("path").agg(F.min("status").alias("status"), F.min("sha256").alias("got"))
    reason = F.when(F.col("got").isNull(), "NOT_SERVED").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("status") != 200, "STATUS").when(F.col("got") != F.col("want"), "HASH")
    return want.join(got, "path", "full").select("path", reason.alias("reason")).filter("reason is not null")


def fact_audit(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """source_id, reason. expected: source_id, bytes, sha256. stored: source_id, raw."""
    got = stored.groupBy("source_id").agg(F.count("*").alias("n"), F.min(F.octet_length("raw")).cast("long").alias("got_bytes"), F.min(F.sha2(F.col("raw").cast("binary"), 256)).alias("got"))
    reason = F.when(F.col("got").isNull(), "MISSING").when(F.col("bytes").isNull(), "UNEXPECTED").when(F.col("n") > 1, "DUPLICATE").when(F.col("bytes") != F.col("got_bytes"), "SIZE").when(F.col("sha256") != F.col("got"), "HASH")
    return expected.join(got, "source_id", "full").select("source_id", reason.alias("reason")).filter("reason is not null")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with their side; multiplicity counts."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def link_closure(links: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: total, uncovered, unique_uncovered links, by whether their target is a route."""
    known = routes.select("request_target").distinct().withColumn("covered", F.lit(1))
    # Counts by target come first, so that a menu's target is one row in the join.
    counted = links.groupBy("request_target").agg(F.count("*").alias("n"))
    j = counted.join(known, "request_target", "left")
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("covered").isNull(), F.col("n"))), F.lit(0)).alias("uncovered"), F.count_if(F.col("covered").isNull()).alias("unique_uncovered"))


def uncovered_sample(links: DataFrame, routes: DataFrame, rows: int = 100, bytes_: int = 24_576) -> DataFrame:
    """The first uncovered targets in order, within both bounds; link_closure counts all of them."""
    uncovered = links.select("request_target").distinct().join(routes.select("request_target"), "request_target", "left_anti")
    return limited(uncovered, [F.col("request_target")], rows, bytes_, "request_target")


def coverage(checks: DataFrame) -> DataFrame:
    """One row: discovered, included, excluded, planned, verified, failed, not_run, ratio (0 if nothing is in scope)."""
    ok, n = F.count_if(F.col("status") == "PASS"), F.count_if("in_scope")
    return checks.agg(
        F.count("*").alias("discovered"),
        n.alias("included"),
        F.count_if(~F.col("in_scope")).alias("excluded"),
        F.count_if("planned").alias("planned"),
        ok.alias("verified"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "NOT_RUN").alias("not_run"),
        F.when(n > 0, ok / n).otherwise(0.0).alias("ratio"),
    )


def readiness(checks: DataFrame, *by: str) -> DataFrame:
    """checks, ready (at least one check, and all PASS): one row, or one for each group of ``by``."""
    failed = F.count_if(F.coalesce(F.col("status") != "PASS", F.lit(True)))
    return checks.groupBy(*by).agg(F.count("*").alias("checks"), ((failed == 0) & (F.count("*") > 0)).alias("ready"))
