"""Choice among several readings of one region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.storage import wide

KEYS = ["image_id", "section", "variant"]


def score(items: DataFrame) -> DataFrame:
    """One row per reading: ``score`` by the rule of its section, ``text`` and mean ``confidence``.

    ``items``: image_id, section (ingredient, nutrition or other), variant, seq, text, confidence.
    """
    read = items.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", "text", "confidence"))).alias("i"))
    read = read.select(*KEYS, F.expr("array_join(transform(i, x -> x.text), ' ')").alias("text"), F.expr("aggregate(i, 0D, (s, x) -> s + x.confidence) / size(i)").alias("confidence"), F.expr("size(filter(i, x -> x.text RLIKE '(?U)[0-9]'))").alias("numbered"))
    read = read.withColumns({
        "low": F.lower("text"),
        "words": F.expr("regexp_count(text, '[A-Za-z]{2,}')"),
        "garbage": F.expr(T.garbage_share("text")),
        "numbers": F.expr("regexp_count(text, '(?U)\\\\d+(\\\\.\\\\d+)?')"),
        "commas": F.expr("length(text) - length(replace(text, ',', ''))"),
    })
    anchors, nutrients, units = (T.count_contained("low", x) for x in (V.INGREDIENT_ANCHORS, V.NUTRIENT_KEYWORDS, V.NUTRIENT_UNITS))
    rule = f"""confidence * 2D - garbage * 1.5D + CASE section
      WHEN 'ingredient' THEN words * 0.05D + {anchors} * 0.3D + least(commas, 10) * 0.05D
      WHEN 'nutrition' THEN {nutrients} * 0.35D + {units} * 0.15D + least(numbers, 20) * 0.05D + numbered * 0.1D
      ELSE words * 0.05D END"""
    return read.select(*KEYS, "text", "confidence", F.expr(rule).alias("score"))


def choose(scored: DataFrame, quality: DataFrame) -> DataFrame:
    """The reading of each region: the original if it is sure enough, else the best of it and those its quality calls for.

    ``quality``: image_id, section, is_blurry, is_too_dark, contrast_std. An earlier reading wins a tie.
    """
    wanted = F.expr("""CASE WHEN is_blurry IS NULL THEN null
      WHEN is_blurry THEN array('original', 'sharpened', 'sharpened_threshold')
      WHEN is_too_dark OR contrast_std < 45 THEN array('original', 'clahe', 'adaptive_threshold', 'denoised_clahe')
      ELSE array('original', 'clahe', 'sharpened', 'adaptive_threshold') END""")
    every = F.array(*[F.lit(v) for v in ("original", "gray", "clahe", "sharpened", "otsu", "adaptive_threshold", "denoised_clahe", "sharpened_threshold")])
    sure = scored.where(F.col("variant") == "original").select("image_id", "section", (F.col("confidence") >= V.SHORT_CIRCUIT).alias("sure"))
    plan = scored.join(wide(quality), ["image_id", "section"], "left").join(wide(sure), ["image_id", "section"], "left")
    plan = plan.withColumn("tried", F.when(F.coalesce("sure", F.lit(False)), F.array(F.lit("original"))).otherwise(F.coalesce(wanted, every)))
    ran = plan.withColumn("turn", F.array_position("tried", F.col("variant"))).where("turn > 0")
    best = ran.groupBy("image_id", "section").agg(F.max_by(F.struct("variant", "score", "text", "confidence"), F.struct("score", -F.col("turn"))).alias("b"), F.count(F.lit(1)).alias("readings"))
    return best.select("image_id", "section", "b.variant", "b.score", "b.text", "b.confidence", "readings")


def full_page(items: DataFrame, quality: DataFrame, least: float = 0.82) -> DataFrame:
    """The reading of each whole page: another one only where the original is unsure and the page is poor, and only if surer.

    Of the other readings only ``clahe`` can be chosen. Confidences are added by size, so readings with the same ones are equally
    sure in whatever order their boxes come. ``items``: image_id, variant, seq, text, confidence.
    """
    sure = items.groupBy("image_id", "variant").agg(F.array_sort(F.collect_list("confidence")).alias("c"))
    mean = sure.select("image_id", "variant", F.expr("aggregate(c, 0D, (s, x) -> s + x) / nullif(size(c), 0)").alias("mean"))
    plain = mean.where("variant = 'original'").select("image_id", F.col("mean").alias("own"))
    other = mean.where("variant = 'clahe'").select("image_id", F.col("mean").alias("theirs"))
    poor = F.col("is_too_dark") | (F.col("contrast_std") < 35)
    chosen = plain.join(quality, "image_id", "left").join(other, "image_id", "left")
    better = F.coalesce((F.col("own") < least) & poor & (F.col("theirs") > F.col("own")), F.lit(False))
    chosen = chosen.select("image_id", F.when(better, "clahe").otherwise("original").alias("variant"))
    return items.join(chosen, ["image_id", "variant"])
