"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder.

    Where neither is set a local session, as in tests, gets a temporary folder of its own; on a cluster, whose machines share no such
    folder, that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="boxloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the shared folder.

    Spark removes the files when the result is no longer referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def create(spark: SparkSession, path: str) -> None:
    """Make an empty folder in whatever store it is, so that reading it gives no rows where nothing was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Characters of text in a round, at most, and rounds at most: beyond MOST_ROUNDS times that a round is that part of the table.
ROUND_CHARS, MOST_ROUNDS = 1 << 24, 24


def in_rounds(docs: DataFrame, key: str, text: str, body: Callable[[DataFrame], DataFrame], most: int = MOST_ROUNDS, chars: int = ROUND_CHARS) -> DataFrame:
    """body's rows for all of docs, where rows of equal keys depend on each other only: one part of the keys after the other.

    Boxes take some thirty times the room of their text, and shuffles of a query stay until Spark's cleaner finds them unused. Here disk
    holds one part's shuffles and files and all parts' results, which are checkpointed; each row is read and goes through body once.
    """
    total = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    n = max(1, min(most, -(-total // chars)))
    out = None
    for k in range(n):
        part = durable(body(docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("round")), F.lit(n)) == k)))
        out = part if out is None else out.unionByName(part)
        if n > 1:
            gc.collect()
            docs.sparkSession._jvm.System.gc()  # the cleaner removes the shuffle files of what is no longer referenced
    return out
