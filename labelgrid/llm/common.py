"""Session helpers of this subpackage: tables, durable intermediate results, bounded id filters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: words as the contracts define them
WORD = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # imported from an archive, which the session was given
        return
    path = os.path.join(tempfile.mkdtemp(prefix="labelgrid-"), "labelgrid.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


#: rows of one Arrow batch between JVM and Python: whole documents are long, so fewer than Spark's default
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; batches of whole texts are kept small unless the session says otherwise."""
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a
    local master; a cluster has no folder of that kind, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelgrid-"))
    return context.getCheckpointDir().get()


#: bytes of input for which an intermediate table gets one file, and tasks per core that it gets at least
FILE_BYTES = 32 << 20
TASKS_PER_CORE = 2


def files_for(df: DataFrame) -> int | None:
    """Into how many files the tables made from ``df`` are written: in proportion to its size, not to shuffle partitions.

    None where the size is not known.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:
        return None
    return max(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: share of the driver's heap from which on a finished step has garbage collected
HEAP_SHARE = 0.2


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect garbage if much of its heap is used. Plans, broadcasts and shuffle files of a finished step go only
    then, and each broadcast takes blocks of several MB, for which the heap is enlarged sooner than cleaned."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > HEAP_SHARE * runtime.maxMemory():
        spark.sparkContext._jvm.java.lang.System.gc()


def keep(df: DataFrame, files: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut, lost executors cost no recomputation.

    The files go with ``forget``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/labelgrid/{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.option("compression", codec).parquet(path)
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_in = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove the files of kept tables that nothing will read any more."""
    for df in tables:
        path = None if df is None else vars(df).get("kept_in")
        if path:
            target, system = _path(df.sparkSession, path)
            system.delete(target, True)


def packed(docs: DataFrame, text: str) -> DataFrame:
    """``rest``, all columns but the text in one, and ``text``: whatever the columns are named, none clashes with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"), F.col(f"`{text}`").alias("text"))


def unpacked(docs: DataFrame, text: str) -> list[Column]:
    """The columns of ``docs``, in their order, from a table with ``rest`` and ``text``."""
    return [(F.col("text") if c == text else F.col("rest").getField(c)).alias(c) for c in docs.columns]


def with_own(source: DataFrame, *own: tuple[str, str]) -> T.StructType:
    """The schema of ``source`` (as Arrow functions give it back) with columns (name, type) of an operator behind it."""
    return T.StructType([*source.schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in own)])


#: bits of an id filter: 4 MB on each executor, whatever the size of the input
FILTER_BITS = 1 << 25


def id_filter(df: DataFrame, column: str) -> DataFrame:
    """A bitmap of fixed size (``FILTER_BITS``) with a bit set for each value of a column, as rows of 4 KB.

    It only saves work: a value whose bit is not set is certainly absent; the others still go through an exact join.
    """
    bit = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))
    rows = df.where(F.col(column).isNotNull()).select(bit.alias("bit"))
    return rows.groupBy(F.expr("bit div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))


def split_by(df: DataFrame, bits: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``column`` may be in the filter, and those where it is not; decided before any shuffle."""
    named = df.columns
    marked = df.withColumn("__bit", F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))))
    byte = F.conv(F.hex(F.expr("substring(bits, cast((__bit % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = (F.expr("__bit div 32768") == F.col("part")) & (byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0)
    small = F.broadcast(bits)  # FILTER_BITS / 8 bytes at most
    return marked.join(small, hit, "left_semi").select(*named), marked.join(small, hit, "left_anti").select(*named)
