"""Order-free digests of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_row(df: DataFrame) -> Column:
    """JSON of the columns in name order, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def table_digest(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: rows, digest. Equal for equal multisets of rows, whatever their order or partitioning.

    Row hashes are counted by value (map-side), sorted within buckets of the hash space, and the buckets' hashes
    are hashed in turn; no task gets more than its bucket, the last one at most ``buckets`` rows.
    """
    hashed = df.select(F.sha2(canonical_row(df), 256).alias("h")).groupBy("h").count()
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
    parts = hashed.groupBy(bucket.alias("bucket")).agg(F.sum("count").alias("n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(":", "h", "count")))), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("bucket", "h"))), lambda s: s["h"])), 256).alias("digest"))
