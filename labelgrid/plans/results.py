"""From the boxes of a page to its result document: domain, regions, readings of each region, ingredients, nutrients."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import geometry as G
from labelgrid.operators import classify as C
from labelgrid.operators import ensemble as E
from labelgrid.operators import layout as Y
from labelgrid.operators import lines as L
from labelgrid.operators import parsing as A
from labelgrid.operators import regions as R
from labelgrid.sources import writers
from labelgrid.storage import stage, wide

PAGE = ["image_id"]
FOOD, CARE = "food", "personal_care"


def domains_of(layout: Y.Layout, forced: str = "auto") -> DataFrame:
    """``image_id``, ``domain``: as classified, or the one that is forced."""
    if forced != "auto":
        return layout.items.select("image_id").distinct().withColumn("domain", F.lit(forced))
    return stage(C.domain(layout.items).select("image_id", "domain"))


def tight_ingredients(layout: Y.Layout) -> DataFrame:
    """The ingredients region of every page with its tight box."""
    return stage(R.refine(R.detect_ingredients(layout), "ingredients"))


def tight_nutrition(layout: Y.Layout, domains: DataFrame) -> DataFrame:
    """The nutrition region of every page with its tight box; personal care is left out."""
    food = domains.where(F.col("domain") == FOOD).select("image_id")
    return stage(R.refine(R.detect_nutrition(layout).join(wide(food), PAGE, "left_semi"), "nutrition"))


def tight_regions(layout: Y.Layout, domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tight_ingredients(layout), tight_nutrition(layout, domains)


def final_regions(ingredients: DataFrame, nutrition: DataFrame) -> DataFrame:
    """``image_id``, ``section`` (ingredient or nutrition), box, confidence, anchor, method: after both were made exclusive."""
    merged = R.reconcile(ingredients, nutrition)

    def side(found: DataFrame, column: str, section: str) -> DataFrame:
        told = found.select("image_id", "anchor", "method", *(F.col(c).alias(f"own_{c}") for c in ("x1", "y1", "x2", "y2", "confidence")))
        both = told.join(wide(merged.select("image_id", F.col(column).alias("m"))), PAGE, "left")
        apart = F.col("m").isNull()  # a page without the other section
        box = [F.when(apart, F.col(f"own_{c}")).otherwise(F.col(f"m.box.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")]
        return both.select("image_id", F.lit(section).alias("section"), *box, F.when(apart, F.col("own_confidence")).otherwise(F.col("m.confidence")).alias("confidence"), "anchor", "method")

    return side(ingredients, "ing", "ingredient").unionByName(side(nutrition, "nut", "nutrition"))


def boxes_inside(items: DataFrame, regions: DataFrame) -> DataFrame:
    """The boxes of a page whose centre lies in the box of a region, with its ``section``."""
    box = regions.where("x1 IS NOT NULL").select("image_id", "section", *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    inside = items.join(wide(box), PAGE).where(G.center_inside(G.rect(), G.rect("r_")))
    return inside.select("image_id", "section", "seq", "text", "confidence", "x1", "y1", "x2", "y2")


def plain_reading(inside: DataFrame) -> DataFrame:
    """The reading of a region that the page's own boxes give, where no image is read again."""
    return inside.withColumn("variant", F.lit("original"))


def documents(layout: Y.Layout, domains: DataFrame, terms: DataFrame, names: DataFrame, *, regions: tuple[DataFrame, DataFrame] | None = None, read: Callable[[DataFrame], DataFrame] = plain_reading, reading_quality: DataFrame | None = None, packets: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """One nested result row per page.

    ``names``: image_id, image. ``terms``: domain, ord, canonical, searchable. ``read`` gives the readings of the boxes of each region
    (image_id, section, variant, seq, text, confidence, box); the best one is parsed, and nothing outside the region. ``packets`` as
    from ``pixels.packet_regions``, ``quality`` from ``pixels.quality``; their parts are null without them.
    """
    found = stage(final_regions(*(regions or tight_regions(layout, domains))))
    readings = stage(read(boxes_inside(layout.items, found)))
    if reading_quality is None:
        reading_quality = readings.select("image_id", "section").distinct().selectExpr("image_id", "section", "cast(null AS boolean) AS is_blurry", "cast(null AS boolean) AS is_too_dark", "cast(null AS double) AS contrast_std")
    best = stage(E.choose(E.score(readings), reading_quality))
    of = lambda section: best.where(F.col("section") == section)
    told = [A.correct(of("ingredient").join(wide(domains.where(F.col("domain") == d)), PAGE, "left_semi"), terms.where(F.col("domain") == d), "image_id", "text") for d in (FOOD, CARE)]
    facts = readings.join(wide(of("nutrition").select("image_id", "section", "variant")), ["image_id", "section", "variant"], "left_semi")
    nutrients = A.parse_nutrition(L.reconstruct(L.enrich(facts.drop("section", "variant"))), of("nutrition").select("image_id", "text"))
    return writers.documents(names, domains, found, best, told[0].unionByName(told[1]), nutrients, packets, quality)
