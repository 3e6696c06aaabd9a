"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the input folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests on one machine) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext.getCheckpointDir()
        if not chosen:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
            chosen = spark.sparkContext.getCheckpointDir()
        folder = chosen
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    Like a checkpoint, but columnar and compressed, and later reads may prune.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/framelake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def forget(*tables: DataFrame) -> None:
    """Removes tables of ``written`` from which nothing will be read again."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_written", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores if its input has fewer splits, so that a step that is heavy for each row has work for all.

    The number of splits is known from the files; nothing is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tidy(spark: SparkSession) -> None:
    """Executors collect their garbage and return the free heap, and buffers beside it that only a collection frees, to the system.

    A heap that some step has filled otherwise stays mapped beside the Python
    workers of all later steps. A small job with a task for each core, on a local
    master one; an executor that gets none of them keeps its heap as it is.
    """
    n = 1 if spark.sparkContext.master.startswith("local[") else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def fold_of(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out of training."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5, F.lit(-1))


def partitions_for(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


@functools.cache
def _libc():
    """The C library of a worker, told to map large blocks on their own so that they return to the system when freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, fixed instead of growing
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    return libc


def give_back() -> None:
    """Returns freed memory to the system; Python workers live on between tasks and stages."""
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def frugal(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function whose worker keeps no freed memory afterwards."""

    def run(batches: Iterator) -> Iterator:
        _libc()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
