"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_shared: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and everything runs in one process (tests) a
    temporary folder of this process stands in for it; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local_shared:
        _local_shared.append(tempfile.mkdtemp(prefix="tracewright-"))
    return _local_shared[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor. Returns the frame and its
    path, to be handed to :func:`release` when nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by :func:`materialize` through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lookup(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = 1000, hot_keys: int = 10_000) -> DataFrame:
    """``left`` with the row of ``right`` that has its key; ``right`` has a key once at most.

    Keys of very many rows of ``left`` would each fill a task. Of n rows at most
    ``hot_keys`` keys can have more than n / hot_keys, so those keys' rows of ``right`` are
    few whatever the data and are sent to all tasks. Both sides are read twice, so they
    should be written tables or cheap.
    """
    most = max(hot_rows, left.count() // hot_keys)
    hot = left.groupBy(*on).count().where(F.col("count") > most).select(*on)
    if not hot.take(1):
        return left.join(right, on, how)
    hot, _ = materialize(hot, "hot-keys")
    many = left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    few = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return few.unionByName(many)


_memo: list = [None, None]


def process_memo(key, make):
    """One memo for each worker process, kept between tasks until another operator's is asked for."""
    if _memo[0] != key:
        _memo[:] = [None, None]
        pa.default_memory_pool().release_unused()
        _memo[:] = [key, make()]
    return _memo[1]


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches by bytes: a batch of long texts must not take a worker's memory.

    The default of 64 MB, doubled by the buffers of both sides, is too much for small
    executors. A smaller setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m").lower().rstrip("b") in ("64m", "67108864"):
        spark.conf.set(key, size)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
