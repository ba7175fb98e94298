"""Shared pieces of the jobs: tables written to shared storage between rounds, checks, and ordered dedup."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteledger.functions.steps import bound as bound


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names.

    Where that is unset, local sessions use a temporary folder; on a cluster, whose executors could not read it, that
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("siteledger.local.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siteledger-")
        spark.conf.set("siteledger.local.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in a new folder of the shared storage."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that are small to read and dear to work on (a parse, many expressions) in one task.
ROWS_A_TASK = 5_000


def tasks(df: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """As many tasks as there are cores, and more as a table's rows become more. The count comes from the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """The table's rows by their keys over all cores, and over more tasks as they become more.

    A file of small rows is one split or a few, whatever it costs to work on them.
    """
    return df.repartition(tasks(df, rows), *keys)


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The same rows; a row for which ``bad`` holds fails the job.

    The check is a filter, so that dropping columns later cannot drop it; rand() keeps the optimiser from moving it
    into a join, or trying it on a row of nulls.
    """
    fails = F.coalesce(bad, F.lit(False)) & (F.rand(0) >= 0)
    return df.filter(F.when(fails, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """For each key the row that comes first; partial on the map side, so a key's rows are never gathered."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def ranked(df: DataFrame, order: list[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Adds a dense 0-based number in the given order without one task for all rows.

    Rows are dealt into ranges of the order; within a range they are numbered by a window, and each range starts
    after the counts of those before it (one row a range). buckets: as many as shuffle partitions if not given.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = written(df.repartitionByRange(buckets, *order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    numbered = dealt.withColumn("_own", own).join(F.broadcast(starts.select("_range", "_start")), "_range")
    return numbered.withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_start", "_own")


def locale_order(column: str, locale: str = "UNICODE") -> list[Column]:
    """Sort keys of a text in a locale's order (an ICU collation of Spark); texts that it takes as equal go by their bytes.

    Equality and joins stay those of bytes: only the sort key is collated.
    """
    return [F.collate(F.col(column), locale).asc(), F.col(column).asc()]
