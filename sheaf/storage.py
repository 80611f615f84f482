"""Tables in the folder that all executors share, to cut lineage: spark.checkpoint.dir.

What is written there stays until ``clean`` is called, since results are computed from it when they are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []
#: Bytes of rows that Spark hands to Python at once.
BATCH = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, so that a task's memory follows neither it nor the rows.

    It is left alone where the session has another than Spark's own, 64 MB.  A row is never split, so one with a longer
    text is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64m", f"{64 << 20}b", str(64 << 20)):
        spark.conf.set(key, str(BATCH))


def root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or what setCheckpointDir was given; set here only for one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.dirname(kept) if kept else f"file://{tempfile.mkdtemp(prefix='sheaf-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's address for one run of an operator; its tasks get batches of bounded size."""
    bound_batches(spark)
    where = f"{root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.append(where)
    return where


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a table and read again, so that what follows doesn't compute it anew."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the folders that this process has made so far; results that weren't written elsewhere are lost.  Returns how many."""
    gone = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if that at least doubles them: a small table often is one task's."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and 2 * df.rdd.getNumPartitions() <= cores else df
