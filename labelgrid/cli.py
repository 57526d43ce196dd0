"""``spark-submit labelgrid/cli.py``: result documents, and their evaluation, from tables of boxes.

    --items PARQUET --images PARQUET --output DIR [--domain auto|food|personal_care] [--food-kb CSV] [--care-kb XLSX]
    [--truth JSON] [--test-mode]

Writes ``result.json`` and ``result.txt`` below the output folder, one entry per page; with ``--test-mode`` also what the regions were
found by, and with ``--truth`` the agreement with labelled boxes (by image name) as ``evaluation.json``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelgrid import storage
from labelgrid.operators import evaluate as Q
from labelgrid.operators import layout as Y
from labelgrid.plans import results as S
from labelgrid.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Ingredients and nutrition sections of packaged-product labels")
    p.add_argument("--items", required=True, help="Parquet: image_id, seq, text, confidence, x1, y1, x2, y2")
    p.add_argument("--images", required=True, help="Parquet: image_id, img_w, img_h, and image (its name) if there is one")
    p.add_argument("--output", required=True)
    p.add_argument("--domain", default="auto", choices=["auto", S.FOOD, S.CARE])
    p.add_argument("--food-kb")
    p.add_argument("--care-kb")
    p.add_argument("--truth", help="JSON: labelled boxes by image name")
    p.add_argument("--test-mode", action="store_true")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    """Write the results; what of the knowledge base could not be read is returned."""
    images = spark.read.parquet(args.images)
    names = images.select("image_id", (F.col("image") if "image" in images.columns else F.col("image_id").cast("string")).alias("image"))
    kb = readers.KnowledgeBase(spark, food_csv=args.food_kb, personal_care_xlsx=args.care_kb)
    layout = Y.Layout(spark.read.parquet(args.items), images, kb.ingredient_names(S.CARE if args.domain == S.CARE else S.FOOD))
    domains = S.domains_of(layout, args.domain)
    found = S.tight_regions(layout, domains)
    docs = storage.stage(S.documents(layout, domains, kb.terms(S.FOOD).unionByName(kb.terms(S.CARE)), names, regions=found))
    writers.write_json(docs, f"{args.output}/result.json")
    writers.write_text(docs, f"{args.output}/result.txt")
    if args.test_mode:
        told = [r.withColumn("section", F.lit(s)) for r, s in zip(found, ("ingredients", "nutrition"), strict=True)]
        writers.write_debug(told[0].unionByName(told[1]), f"{args.output}/debug_regions.json")
    if args.truth:
        boxes = docs.select("image", F.col("ingredients_region.bbox").alias("ingredients"), F.col("nutrition_region.bbox").alias("nutrition"))
        scored = storage.stage(Q.score(readers.ground_truth(spark, args.truth), boxes))
        scored.orderBy("mean_iou", "image").write.json(f"{args.output}/evaluation.json")
        print(Q.summary(scored).first())
    return kb.load_errors


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    for domain, why in run(spark, args).items():
        print(f"knowledge base of {domain}: {why}")
    storage.clear(spark)


if __name__ == "__main__":
    main()
