"""What the corpus operators share: a work folder on the cluster's shared storage, and small helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor can reach.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the master is local (tests) a
    temporary folder is used, and remembered in the session so that later calls share it; elsewhere it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("siteledger.local.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="siteledger-")
            spark.conf.set("siteledger.local.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written since a temporary() began, for each one that is open.
_OPEN: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def temporary(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function that returns a DataFrame, and removes the tables that it has written but for those that its result reads."""

    @wraps(make)
    def cleaned(*args, **options) -> DataFrame:
        _OPEN.append([])
        try:
            out = make(*args, **options)
        finally:
            made = _OPEN.pop()
        needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in out.inputFiles()}
        spark = out.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path
        for path in made:
            if path.rsplit("/", 1)[-1] not in needed:
                at(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(at(path), True)
            elif _OPEN:
                _OPEN[-1].append(path)
        return out

    return cleaned


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let batches between Spark and Python end at so many bytes, in this session; texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have (Spark tells names apart without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def crc_mod(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo n; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Hand memory back to the system: Python workers live on after a task and serve the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives up its memory when its task ends."""

    @wraps(run)
    def until_its_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return until_its_end
