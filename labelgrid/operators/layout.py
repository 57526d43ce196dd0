"""Page layout: columns, blocks, semantic clusters, section candidates."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import geometry as G
from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.storage import stage, wide

from . import classify as C
from . import lines as L

PAGE = ["image_id"]
COLUMN = ["image_id", "column_id"]
SECTIONS = ["ingredients", "nutrition"]


def reading_order(lines: DataFrame, keys: list[str], tie: str, name: str = "place") -> DataFrame:
    """``lines`` with ``name``: their place from top to bottom in bands, then from left to right."""
    banded = L.with_median(lines, keys, name="band").withColumn("band", F.greatest(F.col("band") * 0.6, F.lit(5.0)))
    order = W.partitionBy(*keys).orderBy(F.bround(F.col("y1") / F.col("band")), "x1", tie)
    return banded.withColumn(name, F.row_number().over(order) - 1).drop("band")


def split_columns(lines: DataFrame, keys: list[str] = PAGE, tie: str = "line_id") -> DataFrame:
    """``lines`` (with ``min_gap``) with ``column_id``: gaps and islands over the running right edge."""
    left = W.partitionBy(*keys).orderBy("x1", tie)
    edge = F.max("x2").over(left.rowsBetween(W.unboundedPreceding, -1))
    begun = lines.withColumn("begins", F.coalesce((F.col("x1") - edge > F.col("min_gap")).cast("int"), F.lit(0)))
    return begun.withColumn("column_id", F.sum("begins").over(left.rowsBetween(W.unboundedPreceding, 0))).drop("begins")


def with_gap(lines: DataFrame, images: DataFrame) -> DataFrame:
    """``lines`` with ``page_med`` and ``min_gap``, the width of white that separates columns."""
    measured = L.with_median(lines, name="page_med").join(wide(images.select("image_id", "img_w")), PAGE)
    return measured.withColumn("min_gap", F.col("img_w") * F.least(F.lit(V.COLUMN_GAP), F.col("page_med") * 0.8 / F.col("img_w"))).drop("img_w")


def columns(lines: DataFrame, images: DataFrame) -> DataFrame:
    """``lines`` with ``column_id`` and ``place``, the reading order inside the column."""
    return reading_order(split_columns(with_gap(lines, images)), COLUMN, "line_id").drop("min_gap")


def _close(gap: Column, band: Column, overlap: float) -> Column:
    a, b = G.rect("a."), G.rect("b.")
    return (G.vertical_distance(a, b) <= gap) & ((F.abs(a[0] - b[0]) <= band) | (G.horizontal_overlap_ratio(a, b) >= overlap))


CARRIED = ["place", "line_id", "text", "x1", "y1", "x2", "y2", "height", "confidence", *C.SCORES, "other_score", "predicted_class", "hits", "unit", "has_term", "ing_head", "nut_head"]
LINE = "struct(y1, x1, " + ", ".join(c for c in CARRIED if c not in ("x1", "y1")) + ")"


def blocks(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Blocks of each column: type, rectangle, text, mean scores, their lines from top to bottom; ``block_id`` per page."""
    nodes = L.numbered(L.with_median(lines, COLUMN), COLUMN, "place")
    near = _close(F.col("a.med") * V.BLOCK_GAP, F.col("a.med") * V.BAND, V.BLOCK_OVERLAP)
    grouped = L.components(nodes, near, COLUMN, ["x1", "y1", "x2", "y2", "med"])
    rect = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    out = grouped.groupBy(*COLUMN, "root").agg(F.array_sort(F.collect_list(F.expr(LINE))).alias("lines"), *rect)
    mean = [F.expr(f"bround(aggregate(lines, 0D, (s, l) -> s + l.{c}) / size(lines), 3)").alias(c) for c in C.SCORES]
    out = out.select(*COLUMN, "root", "lines", "x1", "y1", "x2", "y2", F.expr("array_join(transform(lines, l -> l.text), ' ')").alias("text"), *mean)
    kind = f"element_at(transform(array(struct(text AS t0, {T.normalize('text')} AS n0)), z -> {C.block_type('z.n0', 'z.t0', vocabulary)}), 1)"
    out = out.withColumn("type", F.expr(kind)).withColumn("predicted_class", F.expr(C._best(C.SCORES)))
    order = W.partitionBy("image_id").orderBy("column_id", "y1", "x1", "root")
    return stage(out.withColumn("block_id", F.row_number().over(order) - 1).drop("root"))


def clusters(lines: DataFrame, classes: list[str] = V.CLUSTERED) -> DataFrame:
    """Semantic clusters of each column and class, filled up to all lines of their vertical stretch, with their statistics.

    ``lines`` as from ``classify.describe``, with columns. Clusters are numbered among those of ``classes``.
    """
    names = ", ".join(f"'{c}', s_{c}" for c in classes)
    long = lines.selectExpr("image_id", "column_id", "line_id", "place", "x1", "y1", "x2", "y2", "page_med", f"stack({len(classes)}, {names}) AS (class, score)").where("score >= 0.20")
    keys = [*COLUMN, "class"]
    near = _close(F.col("a.page_med") * V.EXPAND_GAP, F.col("a.page_med") * V.BAND, V.BAND_OVERLAP)
    grouped = L.components(L.numbered(long, keys, "place"), near, keys, ["x1", "y1", "x2", "y2", "page_med"])
    spans = grouped.groupBy(*keys, "root").agg(F.min("y1").alias("top"), F.max_by("y2", F.struct("y1", "x1", "place")).alias("bottom"))
    ranks = F.expr("CASE class " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(classes)) + " END")
    spans = spans.withColumn("cluster_no", F.row_number().over(W.partitionBy("image_id").orderBy("column_id", ranks, "root")) - 1)
    pairs = spans.join(wide(lines.select(*COLUMN, *CARRIED, "page_med", "ing_anchor", "nut_anchor")), COLUMN)
    inside = (G.center_y(G.rect()) >= F.col("top") - 2.0) & (G.center_y(G.rect()) <= F.col("bottom") + 2.0)
    best = F.when(F.col("class") == "ingredients", F.col("ing_anchor.score")).otherwise(F.col("nut_anchor.score"))
    heads = F.when(best >= V.ANCHOR_SCORE, F.struct("x1", "y1", "x2", "y2", best.alias("score")))
    within = lambda c: F.when(inside, F.col(c))
    out = pairs.groupBy(*keys, "root", "cluster_no").agg(
        F.array_sort(F.collect_list(F.when(inside, F.expr(LINE)))).alias("lines"), F.collect_list(heads).alias("heads"),
        F.min(within("x1")).alias("x1"), F.min(within("y1")).alias("y1"), F.max(within("x2")).alias("x2"), F.max(within("y2")).alias("y2"), F.first("page_med").alias("page_med"),
    )
    # headings: lines of the column that belong to the cluster, or stand closely above it
    above = f"(h.y1 < y1 AND y1 - h.y2 <= page_med * {V.EXPAND_GAP}D)"
    held = "exists(lines, x -> x.x1 = h.x1 AND x.y1 = h.y1 AND x.x2 = h.x2 AND x.y2 = h.y2)"
    heading = f"coalesce(array_max(transform(filter(heads, h -> {above} OR {held}), h -> h.score)) / 100D, 0D)"
    semantic = "CASE class " + " ".join(f"WHEN '{c}' THEN aggregate(lines, 0D, (s, l) -> s + l.s_{c}) / size(lines)" for c in classes) + " END"
    mean = "(aggregate(lines, 0D, (s, l) -> s + l.height) / size(lines))"
    spread = f"sqrt(aggregate(lines, 0D, (s, l) -> s + (l.height - {mean}) * (l.height - {mean})) / size(lines))"
    out = out.withColumns({"heading": F.expr(heading), "semantic": F.expr(semantic), "coherence": F.expr(f"greatest(0D, 1D - {spread} / greatest({mean}, 1e-6D))")})
    return stage(out.withColumn("cluster_id", F.concat(F.lit("cluster_"), "class", F.lit("_"), F.col("cluster_no").cast("string"))).drop("page_med", "root", "heads"))


def _shares(df: DataFrame) -> DataFrame:
    """Shares of lines with a vocabulary term, a nutrient word, a number with unit; distinct nutrient words; mean confidence."""
    share = "size(filter(lines, l -> {0})) / cast(size(lines) AS double)"
    return df.withColumns({
        "term_share": F.expr(share.format("l.has_term")),
        "word_share": F.expr(share.format("size(l.hits) > 0")),
        "unit_share": F.expr(share.format("l.unit")),
        "terms": F.expr("sort_array(array_distinct(flatten(transform(lines, l -> l.hits))))"),
        "ocr": F.expr("aggregate(lines, 0D, (s, l) -> s + coalesce(l.confidence, 0D)) / size(lines)"),
    })


def _mean(column: str) -> str:
    return f"(aggregate(lines, 0D, (s, l) -> s + l.{column}) / size(lines))"


def _penalty(column: str, above: float, each: float) -> str:
    return f"aggregate(lines, 0D, (s, l) -> s + CASE WHEN l.{column} > {above} THEN {each}D ELSE 0D END)"


CANDIDATE = ["image_id", "type", "method", "x1", "y1", "x2", "y2", "lines", "terms", "semantic_score", "vocabulary_score", "heading_score", "spatial_score", "ocr_score", "contamination_penalty", "raw_score", "ord"]


def candidates(clusters_of: DataFrame, blocks_of: DataFrame) -> DataFrame:
    """Scored candidates for the ingredients and the nutrition section: clusters first, then blocks; ``place`` ranks them."""
    compact = "least(1D, aggregate(lines, 0D, (s, l) -> s + (l.x2 - l.x1) * (l.y2 - l.y1)) / greatest(1D, (x2 - x1) * (y2 - y1)) * 3D)"
    c = _shares(clusters_of.where("class IN ('ingredients', 'nutrition')"))
    method = F.expr("CASE WHEN heading = 0 THEN 'semantic_cluster' ELSE 'heading_supported_cluster' END")
    ing = c.where("class = 'ingredients' AND size(lines) >= 2").withColumn("dirt", F.expr(f"{_penalty('s_nutrition', 0.50, 0.2)} + {_penalty('s_other', 0.60, 0.1)}"))
    ing = ing.select(
        "image_id", F.lit("ingredients").alias("type"), method.alias("method"), "x1", "y1", "x2", "y2", "lines", "terms", F.col("semantic").alias("semantic_score"),
        F.col("term_share").alias("vocabulary_score"), F.col("heading").alias("heading_score"), F.col("coherence").alias("spatial_score"), F.col("ocr").alias("ocr_score"),
        F.col("dirt").alias("contamination_penalty"), F.expr("0.35D * semantic + 0.25D * term_share + 0.15D * heading + 0.15D * coherence + 0.10D * ocr - dirt").alias("raw_score"),
        F.col("cluster_no").alias("ord"),
    )
    nut = c.where("class = 'nutrition' AND size(lines) >= 3 AND size(terms) >= 2").withColumn("dirt", F.expr(_penalty("s_ingredients", 0.50, 0.2)))
    nut = nut.select(
        "image_id", F.lit("nutrition").alias("type"), method.alias("method"), "x1", "y1", "x2", "y2", "lines", "terms", F.col("semantic").alias("semantic_score"),
        F.col("word_share").alias("vocabulary_score"), F.col("heading").alias("heading_score"), F.col("coherence").alias("spatial_score"), F.col("ocr").alias("ocr_score"),
        F.col("dirt").alias("contamination_penalty"),
        F.expr(f"0.35D * word_share + 0.20D * unit_share + 0.20D * (0.5D * coherence + 0.5D * {compact}) + 0.15D * heading + 0.10D * coherence - dirt").alias("raw_score"),
        F.col("cluster_no").alias("ord"),
    )
    b = _shares(blocks_of.where("type IN ('INGREDIENT_BLOCK', 'NUTRITION_TABLE_BLOCK')").withColumnRenamed("type", "kind"))
    food = "kind = 'INGREDIENT_BLOCK'"
    b = b.where(f"CASE WHEN {food} THEN size(lines) >= 2 ELSE size(lines) >= 3 AND size(terms) >= 2 END")
    blk = b.select(
        "image_id", F.expr(f"CASE WHEN {food} THEN 'ingredients' ELSE 'nutrition' END").alias("type"), F.lit("logical_block").alias("method"), "x1", "y1", "x2", "y2", "lines", "terms",
        F.expr(f"CASE WHEN {food} THEN {_mean('s_ingredients')} ELSE {_mean('s_nutrition')} END").alias("semantic_score"),
        F.expr(f"CASE WHEN {food} THEN term_share ELSE word_share END").alias("vocabulary_score"), F.lit(0.20).alias("heading_score"), F.lit(0.80).alias("spatial_score"),
        F.col("ocr").alias("ocr_score"), F.lit(0.0).alias("contamination_penalty"),
        F.expr(f"CASE WHEN {food} THEN 0.35D * {_mean('s_ingredients')} + 0.25D * term_share + 0.15D * 0.20D + 0.15D * 0.80D + 0.10D * ocr "
               "ELSE 0.35D * word_share + 0.20D * unit_share + 0.20D * 0.80D + 0.15D * 0.20D + 0.10D * 0.80D END").alias("raw_score"),
        (F.col("block_id") + 1_000_000).alias("ord"),
    )
    out = ing.select(*CANDIDATE).unionByName(nut.select(*CANDIDATE)).unionByName(blk.select(*CANDIDATE))
    out = out.withColumn("final_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score"))), 3))
    return out.withColumn("place", F.row_number().over(W.partitionBy("image_id", "type").orderBy(F.desc("final_score"), "ord")) - 1)


class Layout:
    """The layout of a set of pages; each part is a stage table, made when it is first asked for."""

    def __init__(self, items: DataFrame, images: DataFrame, vocabulary: list[str]) -> None:
        self.images, self.vocabulary = images, vocabulary
        self.items = L.enrich(items)

    @cached_property
    def unsplit(self) -> DataFrame:
        return stage(L.reconstruct(self.items))

    @cached_property
    def lines(self) -> DataFrame:
        """With ``column_id`` and ``place``: windows copy their rows, so they come before what is told of the texts is joined."""
        return stage(columns(L.split_wide(self.unsplit, self.images).drop("items", "first_seq", "mean_confidence"), self.images))

    @cached_property
    def classified(self) -> DataFrame:
        described = C.describe(self.lines, self.vocabulary).withColumns({"hits": F.col("row.hits"), "unit": F.col("row.number_unit"), "ing_head": F.col("ing_anchor.score") >= V.ANCHOR_SCORE, "nut_head": F.col("nut_anchor.score") >= V.ANCHOR_SCORE})
        return stage(described)

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks(self.classified, self.vocabulary)

    @cached_property
    def clusters(self) -> DataFrame:
        return clusters(self.classified)

    @cached_property
    def candidates(self) -> DataFrame:
        """Only clusters of the two sections can be candidates; the others are made where ``clusters`` is asked for."""
        made = self.__dict__.get("clusters")
        return stage(candidates(clusters(self.classified, SECTIONS) if made is None else made, self.blocks))
