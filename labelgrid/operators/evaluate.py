"""Regions against labelled boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import geometry as G


def _rect(name: str) -> tuple:
    return tuple(F.get(F.col(name), F.lit(i)) for i in range(4))


def score(labelled: DataFrame, found: DataFrame, key: str = "image") -> DataFrame:
    """IoU of both sections for every image that is in both tables, worst first."""
    a = labelled.select(key, F.col("ingredients").alias("ti"), F.col("nutrition").alias("tn"))
    both = a.join(found.select(key, F.col("ingredients").alias("fi"), F.col("nutrition").alias("fn")), key)
    scored = both.select(key, G.evaluation_iou(_rect("fi"), _rect("ti")).alias("ingredients_iou"), G.evaluation_iou(_rect("fn"), _rect("tn")).alias("nutrition_iou"))
    return scored.withColumn("mean_iou", (F.col("ingredients_iou") + F.col("nutrition_iou")) / 2.0).orderBy("mean_iou", key)


def summary(scored: DataFrame) -> DataFrame:
    """Means over all images; the overall mean is that of the two."""
    means = scored.agg(F.avg("ingredients_iou").alias("ingredients_iou"), F.avg("nutrition_iou").alias("nutrition_iou"), F.count(F.lit(1)).alias("images"))
    return means.withColumn("overall_iou", (F.col("ingredients_iou") + F.col("nutrition_iou")) / 2.0)
