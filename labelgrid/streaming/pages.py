"""A stream of OCR boxes to result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ITEMS = "image_id bigint, seq int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of boxes, as they arrive. A page must lie in one file: ``write_lines`` checks that no later batch has it again."""
    return spark.readStream.schema(ITEMS).parquet(path)


def _earlier(spark: SparkSession, path: str, epoch: int) -> list[str]:
    """Folders that earlier batches wrote."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    return [p for p in (f.getPath().toString() for f in found) if int(p.rsplit("=", 1)[1]) < epoch]


def write_lines(items: DataFrame, path: str, checkpoint: str, *, whole_pages: bool = True):  # noqa: ANN201
    """Lines of every page, appended to a Parquet folder by micro-batch; a repeated batch overwrites its own folder only.

    A page that an earlier batch had already is an error, as its boxes would give two half pages; ``whole_pages=False`` trusts the
    source and saves reading the ids of what was written.
    """
    from labelgrid.operators import lines as L

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _earlier(spark, path, epoch) if whole_pages else []
        if before:
            again = batch.select("image_id").join(spark.read.parquet(*before).select("image_id"), "image_id", "left_semi").first()
            if again:
                raise ValueError(f"page {again['image_id']} is spread over several batches")
        done = L.reconstruct(L.enrich(batch)).select("image_id", "line_index", "text", "x1", "y1", "x2", "y2", "mean_confidence")
        done.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
