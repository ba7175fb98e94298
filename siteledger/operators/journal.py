"""Journal replay and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteledger.operators.common import written


def replay(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last write of each key by sequence; deleted keys are gone. changes: keys, sequence, present, value."""
    keys = keys or ["grp", "idx"]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("present", "value"), "sequence").alias("last"), F.max("sequence").alias("sequence"))
    return last.filter("last.present").select(*keys, F.col("last.value").alias("value"), "sequence")


def audit(journal: DataFrame, generation: str = "generation", body_only: bool = False, ranges: int | None = None) -> DataFrame:
    """generation, sequence, reason of each bad row. journal: generation, sequence, previous, checksum, body.

    A checksum is the digest of the previous one and the body, or of the body only. A generation of any length is dealt into
    ranges of its sequence. Each range is audited by itself; its first row is held against the last one of the range before,
    which the seams tell (a row for each range of a generation). ranges: as many as shuffle partitions if not given.
    """
    ranges = ranges or int(journal.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    narrow = journal.select(generation, "sequence", "previous", "checksum", (F.col("checksum") != F.sha2(F.col("body") if body_only else F.concat_ws("|", "previous", "body"), 256)).alias("wrong"))
    dealt = written(narrow.repartitionByRange(ranges, generation, "sequence").withColumn("range", F.spark_partition_id()), "journal")
    ends = dealt.groupBy(generation, "range").agg(F.max(F.struct("sequence", "checksum")).alias("last"))
    seams = ends.withColumn("seam", F.lag("last").over(Window.partitionBy(generation).orderBy("range"))).drop("last")
    order = Window.partitionBy(generation, "range").orderBy("sequence", "checksum")
    rows = dealt.join(seams, [generation, "range"]).withColumn("before", F.coalesce(F.lag(F.struct("sequence", "checksum")).over(order), F.col("seam")))
    reason = (
        F.when(F.col("before").isNotNull() & (F.col("sequence") != F.col("before.sequence") + 1), "SEQUENCE_GAP")
        .when(~F.col("previous").eqNullSafe(F.coalesce("before.checksum", F.lit(""))), "PREVIOUS_MISMATCH")
        .when(F.col("wrong"), "CHECKSUM_MISMATCH")
    )
    return rows.withColumn("reason", reason).filter("reason is not null").select(generation, "sequence", "reason")


def first_defects(journal: DataFrame, generation: str = "generation") -> DataFrame:
    return audit(journal, generation).groupBy(generation).agg(F.min("sequence").alias("sequence"), F.min_by("reason", "sequence").alias("reason"))
