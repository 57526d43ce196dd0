"""Stage tables: a step's result, written once as Parquet where driver and executors share a folder, and read by what follows.

A layout joins its own intermediate results many times over; without stages the plan doubles with every self-join, and a lost
executor costs the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: what a table may have at most to be broadcast: rows, and characters of its text columns
LOOKUP_ROWS, LOOKUP_CHARS = 10_000, 2_000_000
#: share of the driver's heap from which on a finished stage has garbage collected
HEAP_SHARE = 0.2


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local. A cluster has no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelgrid-"))
    return context.getCheckpointDir().get()


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/labelgrid/{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with ``clear``, or when the session's JVM ends."""
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    return path


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage if much of its heap is used. Plans, broadcasts and shuffle files of a finished stage go only
    then, and each broadcast takes blocks of several MB, for which the heap is enlarged sooner than cleaned."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > HEAP_SHARE * runtime.maxMemory():
        spark.sparkContext._jvm.java.lang.System.gc()


def stage(df: DataFrame) -> DataFrame:
    """``df`` written and read again."""
    path = fresh(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join of tables that both grow with the pages: sorted and merged, never gathered by the driver.

    The optimizer takes a table to be as small as its compressed file, and an exploded one as small as what it was made of; by such a
    guess it broadcasts millions of rows.
    """
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """``df`` staged, as a side of a join by a key that very many rows may share: broadcast where its rows, as counted, are few and
    short, else merged, where Spark can split what is common."""
    told = stage(df)
    texts = [c for c, kind in told.dtypes if kind == "string"]
    rows, chars = told.agg(F.count(F.lit(1)), F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0)))).first()
    return F.broadcast(told) if rows <= LOOKUP_ROWS and (chars or 0) <= LOOKUP_CHARS else wide(told)


def clear(spark: SparkSession) -> None:
    """Remove all stage tables of this application: for the caller, when no result of it will be read any more."""
    target, system = _path(spark, _folder(spark))
    system.delete(target, True)


def signature(spark: SparkSession, path: str) -> tuple:
    """Size and time of every file of an input, by which its stage tables are known to be of it."""
    target, system = _path(spark, path)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.globStatus(target) or ())
