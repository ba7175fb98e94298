"""A corpus pipeline of five stages over the documents table.

Each stage gets all rows that its predecessor kept, written as Parquet and read again. All stages but the last
return the columns of documents; the last returns one row for each piece of a packed sequence.

Defined cases, in every stage: a null text is kept as it is (toxicity scores it as empty, near copies group it with
empty texts, the last stage packs its end token); empty tables stay empty; very long texts are worked on whole; of
repeated rows and of equal texts (ties) the near-copy stage keeps one, that of the smallest id; rows with a null id are
judged like others, but train nothing, go first from a group, and are never cut; null and clashing other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siteledger.llm import decontaminate, packing, simhash, substrings, toxicity
from siteledger.llm.common import bounded_batches, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return substrings.remove(docs, by=substrings.BOTH)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # Workers also serve other stages, so they remember less than in op8, and nothing after a task.
    return packing.pack(docs, memo=100_000, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: A classifier, tokeniser and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
