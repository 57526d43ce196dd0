"""One query per operator (or family of one-line operators), on pages made from ``part``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid import storage
from labelgrid.functions import geometry as G
from labelgrid.functions import pixels as X
from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.operators import classify as C
from labelgrid.operators import ensemble as E
from labelgrid.operators import evaluate as Q
from labelgrid.operators import layout as Y
from labelgrid.operators import lines as L
from labelgrid.operators import parsing as A
from labelgrid.operators import regions as R
from labelgrid.sources import readers, writers

from . import pages as P
from . import results as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_layouts: dict[tuple, Y.Layout] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``part``, dealt out by page before many rows are made of each: its small file is read by few tasks, and boxes that
    lie with their page need no exchange of their own."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts(spark, sf_dir).createOrReplaceTempView("part")
    return spark.sql(P.ITEMS)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(P.IMAGES)


def layout(spark: SparkSession, sf_dir: str) -> Y.Layout:
    """The layout of all pages of a folder; its stage tables serve every query of a session, as long as the input is the same."""
    key = (spark.sparkContext.applicationId, storage.signature(spark, f"{sf_dir}/part.parquet"))
    if key not in _layouts:
        _layouts[key] = Y.Layout(items(spark, sf_dir), images(spark, sf_dir), P.VOCABULARY)
    return _layouts[key]


def forget(spark: SparkSession) -> None:
    """Let go of all layouts and regions, and of their stage tables."""
    _layouts.clear()
    _regions.clear()
    storage.clear(spark)


def milli(c: F.Column | str, name: str, unit: int = 1000) -> F.Column:
    """A number as whole thousandths, so that engines agree on it."""
    return F.round((F.col(c) if isinstance(c, str) else c) * unit).cast("long").alias(name)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    a, b = (i.select("image_id", "seq", *(F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2"))) for n in ("a", "b"))
    return a.join(b.withColumn("seq", F.col("seq") - 1), ["image_id", "seq"])


@query
def o15_o16_rect_measures(spark, sf_dir):  # noqa: ANN001, ANN201
    i = items(spark, sf_dir).withColumn("polygon", F.expr("array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2))"))
    r = i.select("image_id", "seq", *G.poly_to_rect("polygon"))
    b = G.rect()
    return r.select("image_id", "seq", "x1", "y1", "x2", "y2", G.center_x(b).alias("cx"), G.center_y(b).alias("cy"), G.width(b).alias("width"), G.height(b).alias("height"))


@query
def o17_o19_pair_distances(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = G.rect("a_"), G.rect("b_")
    return _pairs(spark, sf_dir).select(
        "image_id", "seq", G.vertical_distance(a, b).alias("v_dist"), G.horizontal_distance(a, b).alias("h_dist"), milli(G.vertical_overlap_ratio(a, b), "v_overlap"),
        milli(G.horizontal_overlap_ratio(a, b), "h_overlap"), milli(G.center_distance(a, b), "centers"),
    )


@query
def o20_o21_iou(spark, sf_dir):  # noqa: ANN001, ANN201
    p = _pairs(spark, sf_dir)
    p = p.select("image_id", "seq", *(F.when(F.col("image_id") % 5 != 0, F.col(f"a_{c}")).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")), *(F.when(F.col("image_id") % 10 != 0, F.col(f"b_{c}") - (30 if c[0] == "y" else 0)).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))  # noqa: E501
    a, b = G.rect("a_"), G.rect("b_")
    return p.select("image_id", "seq", G.area(a).alias("area_a"), G.intersection_area(a, b).alias("shared"), milli(G.iou(a, b), "iou", 10**6), milli(G.evaluation_iou(a, b), "evaluation_iou", 10**6))


@query
def o22_o25_clip_pad_crop(spark, sf_dir):  # noqa: ANN001, ANN201
    i = items(spark, sf_dir).join(images(spark, sf_dir), "image_id").withColumns({"x1": F.col("x1") - 60.25, "x2": F.col("x2") + 700.25, "y1": F.col("y1") - 30.75, "y2": F.col("y2") + 250.75})
    w, h = F.col("img_w"), F.col("img_h")
    named = lambda p, cs: [c.cast("double").alias(f"{p}_{n}") for c, n in zip(cs, ("x1", "y1", "x2", "y2"), strict=True)]
    r = G.rect()
    return i.select("image_id", "seq", *named("clip", G.clip(r, w, h)), *named("round", G.clip_rounded(r, w, h)), *named("valid", G.valid(r, w, h, 700)), *named("margin", G.add_margin(r, w, h)), *named("pad", G.pad(r, w, h)), *named("crop", G.crop(r, w, h)))


@query
def o26_outside_text(spark, sf_dir):  # noqa: ANN001, ANN201
    box = tuple(F.lit(v) for v in (30.0, 60.0, 480.0, 180.0))
    i = items(spark, sf_dir)
    inside = i.where(G.center_inside(G.rect(), box)).select("image_id", "seq")
    return i.join(inside, ["image_id", "seq"], "left_anti").select("image_id", "seq", "text")


@query
def o27_o29_enrich_normalize(spark, sf_dir):  # noqa: ANN001, ANN201
    noisy = items(spark, sf_dir).withColumn("text", F.expr("CASE seq % 4 WHEN 0 THEN concat('  ', text, ' | x') WHEN 1 THEN upper(text) WHEN 2 THEN replace(text, ' ', '   ') ELSE text END"))
    return L.enrich(T.compose(noisy, "text")).select("image_id", "seq", "norm_text", "cx", "cy", "width", "height")


@query
def o30_domain(spark, sf_dir):  # noqa: ANN001, ANN201
    return C.domain(L.enrich(items(spark, sf_dir)))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = items(spark, sf_dir).select(F.expr(T.normalize("text")).alias("n")).distinct()
    more = [("protein 8 g",), ("100% wheat",), ("5%x",), ("- sodium",), ("energy value of this snack is far from the 450 kcal",), ("contains added flavour",), ("allergen awice",), ("nutrltion facts",), ("stor age",)]
    return seen.unionByName(spark.createDataFrame(more, "n string")).distinct().repartition("n")


@query
def o31_nutrition_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    t = _texts(spark, sf_dir).withColumn("r", F.expr(T.nutrition_row("n")))
    return t.select("n", F.size("r.hits").cast("long").alias("hits"), F.col("r.number_unit").alias("number_unit"), F.col("r.strong").alias("strong"))


@query
def o32_ingredient_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    t = _texts(spark, sf_dir).withColumn("r", F.expr(T.ingredient_line("n", "n", P.VOCABULARY)))
    return t.select("n", F.col("r.commas").cast("long").alias("commas"), F.col("r.vocabulary_hits").cast("long").alias("vocabulary_hits"), F.col("r.strong").alias("strong"))


@query
def o33_section_boundaries(spark, sf_dir):  # noqa: ANN001, ANN201
    t = _texts(spark, sf_dir).withColumn("b", F.expr(T.section_boundary("n")))
    return t.select("n", F.col("b.is_stop").alias("is_stop"), F.col("b.stop").alias("stop"), milli("b.score", "score"), F.col("b.reason").alias("reason"))


@query
def o36_o38_anchor_matches(spark, sf_dir):  # noqa: ANN001, ANN201
    t = _texts(spark, sf_dir)
    best = t.withColumns({"i": F.expr(T.best_anchor("n", [a for a in V.ALL_INGREDIENT_ANCHORS if a.isascii()])), "u": F.expr(T.best_anchor("n", V.NUTRITION_ANCHORS))})
    return best.select("n", F.col("i.anchor").alias("ing_anchor"), milli("i.score", "ing_score"), F.col("u.anchor").alias("nut_anchor"), milli("u.score", "nut_score"), milli(F.expr(T.ratio("n", "'ingredients'")), "plain_ratio"), milli(F.expr(T.partial_ratio("n", "'ingredients'")), "partial"))


@query
def o34_line_classes(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    return y.classified.select("image_id", "line_id", "text", *(milli(s, s) for s in C.SCORES), milli("other_score", "other_score"), "predicted_class")


@query
def o41_o58_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    lines = L.reconstruct(L.enrich(items(spark, sf_dir)), outlines=True)
    return lines.select("image_id", "line_index", "text", "x1", "y1", "x2", "y2", F.size("items").cast("long").alias("boxes"), milli("mean_confidence", "mean_confidence", 10**6), F.size("polygon").cast("long").alias("corners"))


@query
def o70_split_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return layout(spark, sf_dir).lines.select("image_id", "line_id", "line_index", "text", "x1", "y1", "x2", "y2", milli("confidence", "confidence", 10**6))


@query
def o69_o73_columns(spark, sf_dir):  # noqa: ANN001, ANN201
    return layout(spark, sf_dir).classified.select("image_id", "line_id", F.col("column_id").cast("long").alias("column_id"), F.col("place").cast("long").alias("place"))


@query
def o42_o59_o35_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    return layout(spark, sf_dir).blocks.select("image_id", F.col("block_id").cast("long").alias("block_id"), "type", "text", "x1", "y1", "x2", "y2", F.size("lines").cast("long").alias("lines"))


@query
def o43_o60_clusters(spark, sf_dir):  # noqa: ANN001, ANN201
    return layout(spark, sf_dir).clusters.select("image_id", "cluster_id", "class", "x1", "y1", "x2", "y2", F.size("lines").cast("long").alias("lines"), milli("semantic", "semantic", 10**6), milli("coherence", "coherence", 10**6), milli("heading", "heading", 10**6))


@query
def o61_o77_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    return layout(spark, sf_dir).candidates.select("image_id", "type", "method", milli("raw_score", "score", 10**6), "x1", "y1", "x2", "y2", F.size("lines").cast("long").alias("lines"), milli("contamination_penalty", "penalty"))


@query
def o44_grouped_boxes(spark, sf_dir):  # noqa: ANN001, ANN201
    g = L.group_boxes(L.enrich(items(spark, sf_dir)), images(spark, sf_dir))
    return g.select("image_id", F.col("line_index").cast("long").alias("line_index"), "text", "x1", "y1", "x2", "y2")


@query
def o45_near_clusters(spark, sf_dir):  # noqa: ANN001, ANN201
    c = L.cluster_near(L.enrich(items(spark, sf_dir)), "seq")
    return c.groupBy("image_id", "cluster").agg(F.count(F.lit(1)).alias("boxes"), F.min("seq").alias("first_seq")).select("image_id", "boxes", "first_seq")


@query
def o46_o78_anchors(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    a = R.anchors(y.classified, "nut_anchor")
    return a.select("image_id", F.col("anchor_no").cast("long").alias("anchor_no"), F.col("seed_id").cast("long").alias("line_id"), "anchor", milli("anchor_score", "score"))


@query
def o48_o65_terms_per_page(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    hits = y.classified.where("size(hits) > 0")
    return hits.groupBy("image_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits")))), ",").alias("terms"), F.count(F.lit(1)).alias("lines"))


@query
def o53_o54_kb_matches(spark, sf_dir):  # noqa: ANN001, ANN201
    tokens = items(spark, sf_dir).select(F.explode(F.split(F.lower("text"), "[,;:]")).alias("phrase")).select(F.trim("phrase").alias("phrase")).where("phrase <> ''").distinct()
    food = spark.sql(P.TERMS_SQL).where("domain = 'food'")
    return A.match_terms(tokens, food).select("phrase", "matched_name", milli("similarity", "similarity"))


@query
def o55_o56_union_median(spark, sf_dir):  # noqa: ANN001, ANN201
    i = L.enrich(items(spark, sf_dir))
    return i.groupBy("image_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.coalesce(F.median(F.when(F.col("height") > 0, F.col("height"))), F.lit(20.0)).alias("median_height"))


@query
def o74_o76_orders(spark, sf_dir):  # noqa: ANN001, ANN201
    placed = Y.reading_order(L.enrich(items(spark, sf_dir)), ["image_id"], "seq")
    plain = F.row_number().over(W.partitionBy("image_id").orderBy("y1", "x1", "seq")) - 1
    return placed.select("image_id", "seq", F.col("place").cast("long").alias("reading_place"), plain.cast("long").alias("plain_place"))


@query
def o82_o85_sets(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    both = y.blocks.select("image_id", "text", F.lit(1).alias("src")).unionByName(y.lines.select("image_id", "text", F.lit(0).alias("src")))
    first = both.groupBy("image_id", "text").agg(F.min("src").alias("src"))
    anchored = y.classified.where("nut_anchor.score >= 78").select("image_id", "text")
    return first.join(storage.wide(anchored), ["image_id", "text"], "left_anti").select("image_id", "text", F.col("src").cast("long").alias("src"))


@query
def o86_o88_phrases(spark, sf_dir):  # noqa: ANN001, ANN201
    page = layout(spark, sf_dir).lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return A.phrases(page, "image_id", "text").select("image_id", F.col("pos").cast("long").alias("pos"), "phrase")


@query
def o88_corrected(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    text = y.classified.where("predicted_class = 'ingredients'").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return A.correct(text, spark.sql(P.TERMS_SQL).where("domain = 'food'"), "image_id", "text")


@query
def o90_ingredient_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    text = y.classified.where("predicted_class = 'ingredients'").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return A.ingredient_tokens(text, "image_id", "text")


@query
def o91_nutrient_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir).select("n", F.expr(A.nutrient_key("n")).alias("nutrient"))


def _page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))


@query
def o93_nutrition_strings(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.parse_strings(_page_text(spark, sf_dir), "image_id", "text").select("image_id", "nutrient", "value", "unit")


@query
def o71_o72_o92_nutrition_tables(spark, sf_dir):  # noqa: ANN001, ANN201
    found = A.parse_nutrition(layout(spark, sf_dir).unsplit, _page_text(spark, sf_dir))
    return found.select("image_id", "nutrient", F.col("per_100g.value").alias("value_100g"), F.col("per_100g.unit").alias("unit_100g"), F.col("per_serving.value").alias("value_serving"), "value", "unit")


READ_AS = ["original", "clahe", "sharpened", "adaptive_threshold", "denoised_clahe", "sharpened_threshold"]
READ_TEXT = "CASE WHEN variant = 'clahe' AND seq % 3 = 0 THEN replace(text, 'a', '#') WHEN variant = 'sharpened' AND seq % 5 = 0 THEN concat(text, ', salt 2 g') ELSE text END"
READ_CONFIDENCE = "confidence + 0.00037D + CASE variant WHEN 'original' THEN (image_id % 3) / 8.0D WHEN 'clahe' THEN (image_id % 5) / 16.0D ELSE 0D END"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).selectExpr("image_id", "seq", "text", "confidence", f"explode(array({', '.join(map(T.quoted, READ_AS))})) AS variant")
    return i.selectExpr("image_id", "CASE image_id % 3 WHEN 0 THEN 'ingredient' WHEN 1 THEN 'nutrition' ELSE 'other' END AS section", "variant", "seq", f"{READ_TEXT} AS text", f"{READ_CONFIDENCE} AS confidence")


@query
def o39_o40_reading_scores(spark, sf_dir):  # noqa: ANN001, ANN201
    return E.score(_readings(spark, sf_dir)).select("image_id", "section", "variant", milli("score", "score", 10**6), milli("confidence", "confidence", 10**6))


@query
def o79_best_readings(spark, sf_dir):  # noqa: ANN001, ANN201
    r = _readings(spark, sf_dir)
    quality = r.select("image_id", "section").distinct().selectExpr("image_id", "section", "image_id % 7 = 0 AS is_blurry", "image_id % 4 = 0 AS is_too_dark", "cast(30 + image_id % 40 AS double) AS contrast_std")
    return E.choose(E.score(r), quality).select("image_id", "section", "variant", milli("score", "score", 10**6))


@query
def o104_full_page_readings(spark, sf_dir):  # noqa: ANN001, ANN201
    r = _readings(spark, sf_dir)
    quality = r.select("image_id").distinct().selectExpr("image_id", "image_id % 7 = 0 AS is_blurry", "image_id % 4 = 0 AS is_too_dark", "cast(30 + image_id % 40 AS double) AS contrast_std")
    chosen = E.full_page(r.select("image_id", "variant", "seq", "text", "confidence"), quality)
    return chosen.groupBy("image_id", "variant").agg(F.count(F.lit(1)).alias("boxes"))


def _truth(spark: SparkSession, boxes: dict) -> DataFrame:
    """Labelled boxes, written as one JSON object and read again."""
    path = storage.fresh(spark)
    spark.createDataFrame([(json.dumps(boxes),)], "value string").coalesce(1).write.text(path)
    return readers.ground_truth(spark, path)


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _truth(spark, P.ground_truth())
    moved = lambda c, d: F.transform(F.col(c), lambda x: x + d)
    runs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("run"))
    return runs.crossJoin(F.broadcast(truth)).select(F.concat_ws("#", "image", F.col("run").cast("string")).alias("image"), "ingredients", "nutrition", moved("ingredients", F.col("run") % 50).alias("fi"), F.when(F.col("run") % 4 != 0, moved("nutrition", F.lit(-1) * (F.col("run") % 30))).alias("fn"))


@query
def o52_evaluation(spark, sf_dir):  # noqa: ANN001, ANN201
    f = _found(spark, sf_dir)
    scored = Q.score(f.select("image", "ingredients", "nutrition"), f.select("image", F.col("fi").alias("ingredients"), F.col("fn").alias("nutrition")))
    return scored.select("image", milli("ingredients_iou", "ingredients_iou", 10**6), milli("nutrition_iou", "nutrition_iou", 10**6))


@query
def o66_evaluation_means(spark, sf_dir):  # noqa: ANN001, ANN201
    f = _found(spark, sf_dir)
    scored = Q.score(f.select("image", "ingredients", "nutrition"), f.select("image", F.col("fi").alias("ingredients"), F.col("fn").alias("nutrition")))
    return Q.summary(scored).select("images", milli("ingredients_iou", "ingredients_iou", 10**6), milli("nutrition_iou", "nutrition_iou", 10**6), milli("overall_iou", "overall_iou", 10**6))


_regions: dict[tuple, DataFrame] = {}  # and the domains of pages


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of every page, made once."""
    key = (spark.sparkContext.applicationId, storage.signature(spark, f"{sf_dir}/part.parquet"), "domain")
    if key not in _regions:
        _regions[key] = S.domains_of(layout(spark, sf_dir))
    return _regions[key]


def region(spark: SparkSession, sf_dir: str, section: str) -> DataFrame:
    """The region of a section of every page, tight; nutrition is left out for personal care."""
    key = (spark.sparkContext.applicationId, storage.signature(spark, f"{sf_dir}/part.parquet"), section)
    if key not in _regions:
        y = layout(spark, sf_dir)
        _regions[key] = S.tight_ingredients(y) if section == "ingredients" else S.tight_nutrition(y, domains(spark, sf_dir))
    return _regions[key]


def regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return region(spark, sf_dir, "ingredients"), region(spark, sf_dir, "nutrition")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("image_id", "x1", "y1", "x2", "y2", milli("confidence", "confidence"), "anchor", "method", F.size("region").cast("long").alias("lines"), F.array_join("terms", ",").alias("terms"), "refinement", "changed")


@query
def o28_o99_ingredient_regions(spark, sf_dir):  # noqa: ANN001, ANN201
    return _shown(region(spark, sf_dir, "ingredients"))


@query
def o100_nutrition_regions(spark, sf_dir):  # noqa: ANN001, ANN201
    return _shown(region(spark, sf_dir, "nutrition"))


@query
def o62_o94_ingredient_expansions(spark, sf_dir):  # noqa: ANN001, ANN201
    y = layout(spark, sf_dir)
    return R.expand_ingredients(y.classified, y.images).select("image_id", F.col("anchor_no").cast("long").alias("anchor_no"), "anchor", "stop", "x1", "y1", "x2", "y2", milli("confidence", "confidence"), F.size("region").cast("long").alias("lines"))


@query
def o63_o95_nutrition_expansions(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.expand_nutrition(layout(spark, sf_dir).classified).select("image_id", F.col("anchor_no").cast("long").alias("anchor_no"), "anchor", "stop", "x1", "y1", "x2", "y2", milli("confidence", "confidence"), F.size("region").cast("long").alias("lines"))


@query
def o64_o96_nutrition_row_tables(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.nutrition_rows(layout(spark, sf_dir).classified).select("image_id", "x1", "y1", "x2", "y2", milli("confidence", "confidence"), "stop", F.array_join("terms", ",").alias("terms"))


@query
def o97_block_fallbacks(spark, sf_dir):  # noqa: ANN001, ANN201
    b = layout(spark, sf_dir).blocks
    both = R.block_fallback(b).unionByName(R.block_fallback(b, "INGREDIENT_BLOCK", "s_ingredients"))
    return both.select("image_id", "method", milli("confidence", "confidence"), "x1", "y1", "x2", "y2", F.size("region").cast("long").alias("lines"))


def _overlapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions that meet: of every page the first boxes are ingredients and the later ones nutrition, with some in both."""
    i = items(spark, sf_dir).where("seq >= 1").join(images(spark, sf_dir), "image_id")
    line = "struct(y1, x1, seq AS line_id, text, x2, y2, y2 - y1 AS height, confidence, cast((image_id * 3 + seq * 7) % 11 AS double) / 10 AS ing, cast((image_id * 5 + seq * 3) % 11 AS double) / 10 AS nut, cast((image_id + seq) % 9 AS double) / 10 AS oth, cast(array() AS array<string>) AS hits, false AS has_term) AS line"
    told = i.selectExpr("image_id", "img_w", "img_h", "seq", line)

    def side(rows: DataFrame, confidence: str) -> DataFrame:
        out = rows.groupBy("image_id", "img_w", "img_h").agg(F.array_sort(F.collect_list("line")).alias("region"))
        box = [F.expr(f"{f}(transform(region, l -> l.{c}))").alias(c) for c, f in (("x1", "array_min"), ("y1", "array_min"), ("x2", "array_max"), ("y2", "array_max"))]
        return out.select("image_id", "img_w", "img_h", *box, F.expr(confidence).alias("confidence"), "region")

    shift = "image_id % 7"
    return side(told.where(f"seq <= 3 + {shift}"), "cast(50 + image_id % 40 AS double) / 100"), side(told.where(f"seq >= 5 - image_id % 3 AND seq <= 9 + {shift}"), "cast(1 + image_id % 80 AS double) / 100")


@query
def o49_o101_reconciled(spark, sf_dir):  # noqa: ANN001, ANN201
    r = R.reconcile(*_overlapping(spark, sf_dir))
    left = lambda n: F.array_join(F.transform(F.array_sort(F.transform(f"{n}.lines", lambda l: l["line_id"])), lambda x: x.cast("string")), ",").alias(f"{n}_lines")
    box = [F.col(f"{n}.box.{c}").alias(f"{n}_{c}") for n in ("ing", "nut") for c in ("x1", "y1", "x2", "y2")]
    return r.select("image_id", "touched", milli("iou", "iou", 10**6), milli("ing.confidence", "ing_confidence"), milli("nut.confidence", "nut_confidence"), left("ing"), left("nut"), *box)


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = images(spark, sf_dir).selectExpr("image_id", "explode(sequence(0, cast(image_id % 4 AS int))) AS ord").where("ord < 3")
    sized = c.selectExpr("image_id", "ord", "5 + image_id % 7 * 3 AS x", "4 + ord * 9 AS y", "300 + (image_id * 37 + ord * 91) % 700 AS w", "250 + (image_id * 53 + ord * 77) % 420 AS h")
    return X.packet_regions(sized.selectExpr("*", "cast(w * h AS double) * (60 + (image_id + ord) % 5 * 10) / 100 AS area"), images(spark, sf_dir))


@query
def p2_packet_regions(spark, sf_dir):  # noqa: ANN001, ANN201
    return _packets(spark, sf_dir).select("image_id", "x1", "y1", "x2", "y2", milli("confidence", "confidence", 10**6), "crop")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = parts(spark, sf_dir).selectExpr("p_partkey AS image_id", "explode(sequence(0, 63)) AS i")
    return X.quality(grid.selectExpr("image_id", "i div 8 AS y", "i % 8 AS x", "cast((image_id * 7 + (i div 8) * 31 * (image_id % 3) + (i % 8) * 17) % 256 AS int) AS v"))


def _read_again(inside: DataFrame) -> DataFrame:
    """Readings of the boxes of each region: what a recogniser would make of its enhanced images, no two of them equally sure."""
    sure = f"{READ_CONFIDENCE} + array_position(array({', '.join(map(T.quoted, READ_AS))}), variant) * 0.000113D"
    more = inside.selectExpr("image_id", "section", "seq", "text", "confidence", "x1", "y1", "x2", "y2", f"explode(array({', '.join(map(T.quoted, READ_AS))})) AS variant")
    return more.selectExpr("image_id", "section", "variant", "seq", f"{READ_TEXT} AS text", f"{sure} AS confidence", "x1", "y1", "x2", "y2")


def results(spark: SparkSession, sf_dir: str, measures: bool = True) -> DataFrame:
    """The whole pipeline: result documents of every page; without ``measures`` their packets and image quality are left null."""
    y = layout(spark, sf_dir)
    marks = images(spark, sf_dir).selectExpr("image_id", "explode(array('ingredient', 'nutrition')) AS section").selectExpr("image_id", "section", "image_id % 7 = 0 AS is_blurry", "image_id % 4 = 0 AS is_too_dark", "cast(30 + image_id % 40 AS double) AS contrast_std")
    names = images(spark, sf_dir).selectExpr("image_id", "concat('page_', image_id, '.png') AS image")
    measured = {}
    if measures:
        shown = _quality(spark, sf_dir).select("image_id", *((F.round(F.col(c) * 1000) / 1000).alias(c) for c in ("laplacian_variance", "brightness_mean", "contrast_std", "glare_ratio", "shadow_std")), "is_blurry", "is_too_dark", "is_too_bright")
        measured = {"packets": _packets(spark, sf_dir), "quality": shown}
    return S.documents(y, domains(spark, sf_dir), spark.sql(P.TERMS_SQL), names, regions=regions(spark, sf_dir), read=_read_again, reading_quality=marks, **measured)


@query
def o09_o103_result_json(spark, sf_dir):  # noqa: ANN001, ANN201
    return writers.as_json(results(spark, sf_dir))


@query
def o10_result_text(spark, sf_dir):  # noqa: ANN001, ANN201
    return writers.as_text(results(spark, sf_dir, measures=False))  # which it does not show


@query
def o06_o07_readings(spark, sf_dir):  # noqa: ANN001, ANN201
    i = items(spark, sf_dir)
    point = "concat('[[', x1, ',', y1, '],[', x2, ',', y1, '],[', x2, ',', y2, '],[', x1, ',', y2, ']]')"
    flat = "concat('[', x1, ',', y1, ',', x2, ',', y2, ']')"
    old = i.where("image_id % 2 = 0").selectExpr("image_id", "seq", f"concat('[', CASE WHEN seq = 3 THEN 'null' ELSE {point} END, ',', to_json(array(text, CASE WHEN seq = 2 THEN 'unsure' ELSE cast(confidence AS string) END)), ']') AS e")
    old = old.groupBy("image_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]), ","), F.lit("]")).alias("result"))
    new = i.where("image_id % 2 = 1").selectExpr("image_id", "seq", "text", f"{flat} AS box")
    new = new.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "box"))).alias("r"))
    new = new.select("image_id", F.expr("concat('{\"rec_texts\":', to_json(transform(r, x -> x.text)), ',\"rec_boxes\":[', array_join(transform(r, x -> x.box), ','), ']}')").alias("result"))
    both = readers.legacy_readings(old).unionByName(readers.dict_readings(new))
    return both.select("image_id", F.col("seq").cast("long").alias("seq"), "text", "confidence", "x1", "y1", "x2", "y2")


@query
def o13_detector_boxes(spark, sf_dir):  # noqa: ANN001, ANN201
    d = items(spark, sf_dir).selectExpr("image_id", "cast(seq % 2 AS string) AS class", "seq AS ord", "confidence - 0.3D AS conf")
    return X.top_boxes(d).select("image_id", "class", "ord", milli("conf", "conf"))


@query
def o80_packets(spark, sf_dir):  # noqa: ANN001, ANN201
    c = items(spark, sf_dir).selectExpr("image_id", "seq AS ord", "cast(20 + (image_id * 3 + seq * 11) % 60 AS double) AS area", "10D AS w", "cast(8 + seq % 4 AS double) AS h", "100D AS image_area")
    return X.packet(c).select("image_id", "ord", milli("score", "score", 10**6))


@query
def p1_working_sizes(spark, sf_dir):  # noqa: ANN001, ANN201
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "cast(400 + p_partkey * 37 % 4000 AS int) AS w", "cast(300 + p_partkey * 53 % 4100 AS int) AS h")
    return p.select("p_partkey", *X.working_size(F.col("w"), F.col("h")))


@query
def o67_quality(spark, sf_dir):  # noqa: ANN001, ANN201
    q = _quality(spark, sf_dir)
    return q.select("image_id", *(milli(c, c) for c in ("laplacian_variance", "brightness_mean", "contrast_std", "glare_ratio", "shadow_std")), "is_blurry", "is_too_dark", "is_too_bright")


@query
def o68_p4_skew(spark, sf_dir):  # noqa: ANN001, ANN201
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "CASE WHEN p_partkey % 5 <> 0 THEN cast(p_partkey % 21 AS double) - 10 END AS ha", "(p_partkey % 9) / 8D AS hc", "CASE WHEN p_partkey % 3 <> 0 THEN cast(p_partkey % 17 AS double) - 8 END AS ra", "(p_partkey % 5) / 4D AS rc")
    angle, confidence, rotate = X.skew(F.col("ha"), F.col("hc"), F.col("ra"), F.col("rc"))
    return p.select("p_partkey", milli(angle, "angle", 10**6), milli(confidence, "confidence", 10**6), rotate.alias("rotate"))


@query
def p5_corners(spark, sf_dir):  # noqa: ANN001, ANN201
    pts = "array(array(10D + p_partkey % 13, 12D + p_partkey % 7), array(200D + p_partkey % 5, 11D + p_partkey % 17), array(205D - p_partkey % 3, 150D + p_partkey % 11), array(8D + p_partkey % 4, 155D))"
    p = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"CASE WHEN p_partkey % 2 = 0 THEN {pts} ELSE reverse({pts}) END AS pts")
    o = p.select("p_partkey", F.expr(X.corners("pts")).alias("o")).withColumn("warp", F.expr(X.distorted("o")))
    return o.select("p_partkey", F.expr("o.tl[0]").alias("tl_x"), F.expr("o.tr[1]").alias("tr_y"), F.expr("o.br[0]").alias("br_x"), F.expr("o.bl[1]").alias("bl_y"), "warp")


@query
def p5_quadrilaterals(spark, sf_dir):  # noqa: ANN001, ANN201
    i = items(spark, sf_dir).selectExpr("image_id", "seq AS ord", "cast((image_id * 7 + seq * 13) % 100 AS double) AS area", "100D AS image_area", "x1", "y1", "x2", "y2", "seq % 4 = 1 AS five")
    four = "array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)"
    c = i.selectExpr("image_id", "ord", "area", "image_area", f"CASE WHEN five THEN array({four}, array(x1, y1)) ELSE array({four}) END AS points")
    return X.quadrilaterals(c).select("image_id", "ord", F.expr("points[2][0]").alias("right"))


@query
def o02_o53_kb_csv(spark, sf_dir):  # noqa: ANN001, ANN201
    path = storage.fresh(spark)
    alt = "concat(p_brand, '; ', p_type, ' / x', p_partkey % 7, CASE WHEN p_partkey % 5 = 0 THEN ' | |' ELSE '' END)"
    kb = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").selectExpr("p_partkey AS code", "CASE p_partkey % 11 WHEN 3 THEN 'NaN' ELSE concat(' ', p_name) END AS `Primary Name (EN)`", f"{alt} AS alt_names")
    kb.coalesce(1).write.csv(path, header=True)
    return readers.KnowledgeBase(spark, food_csv=path).terms("food")


@query
def o03_o04_kb_xlsx(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = [("ingredient", "alternate names"), *((r["n_name"], f"nation {r['n_nationkey']}") for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect())]
    book = storage.fresh(spark)
    spark.createDataFrame([(writers.workbook(rows),)], "content binary").coalesce(1).write.parquet(book)
    path = writers.write_bytes(spark.read.parquet(book), storage.fresh(spark), "kb.xlsx")
    return readers.KnowledgeBase(spark, personal_care_xlsx=path).terms("personal_care")


@query
def o05_ground_truth(spark, sf_dir):  # noqa: ANN001, ANN201
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    boxes = {f"{r['n_name']}.png": {"ingredients": [r["n_nationkey"], 1, 2, r["n_nationkey"] + 7], "nutrition": None if r["n_regionkey"] == 2 else [0, 0, 1, 1]} for r in nations}
    return _truth(spark, boxes).select("image", F.expr("ingredients[0]").alias("left_"), F.expr("ingredients[3]").alias("bottom"), F.col("nutrition").isNotNull().alias("has_nutrition"))
