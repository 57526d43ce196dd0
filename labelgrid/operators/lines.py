"""Boxes to lines: enrichment, spatial self-joins with connected components, reading order, splitting at gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import geometry as G
from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.storage import stage, wide

PAGE = ["image_id"]


def enrich(items: DataFrame) -> DataFrame:
    """Boxes with normalised text, rectangle measures and a four-point polygon; malformed boxes are dropped."""
    good = items.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    if "polygon" not in items.columns:
        corner = "array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2))"
        good = good.withColumn("polygon", F.expr(corner))
    r = G.rect()
    return good.select(
        "image_id", "seq", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "polygon", "x1", "y1", "x2", "y2",
        G.center_x(r).alias("cx"), G.center_y(r).alias("cy"), G.width(r).alias("width"), G.height(r).alias("height"), F.expr(T.normalize("text")).alias("norm_text"),
    )


def with_median(lines: DataFrame, keys: list[str] = PAGE, default: float = 20.0, name: str = "med") -> DataFrame:
    """``lines`` with the median of the positive heights of their page."""
    median = F.median(F.when(F.col("height") > 0, F.col("height"))).over(W.partitionBy(*keys))
    return lines.withColumn(name, F.coalesce(median, F.lit(default)))


def numbered(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """``df`` with ``i``: its place among the rows of its keys, from 0."""
    return df.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def components(nodes: DataFrame, near: Column, keys: list[str], columns: list[str]) -> DataFrame:
    """``nodes`` (with ``i``) and ``root``, the smallest ``i`` of the connected component under the symmetric predicate ``near``.

    ``near`` speaks of two rows as ``a`` and ``b``. Pairs are an equi-join on the keys with ``near`` as its condition; the
    links of a page are folded over an array of labels, which stays in the JVM; labels are rewritten once for each box at most.
    The array is joined by the keys alone, so nodes that lie with their page stay there.
    Only the columns that ``near`` needs are staged; ``i`` must be the same whenever ``nodes`` is worked out.
    """
    slim = stage(nodes.select(*keys, "i", *columns))
    a, b = slim.alias("a"), slim.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    links = a.join(wide(b), [*same, F.col("a.i") < F.col("b.i"), near]).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.struct(F.col("a.i").alias("a"), F.col("b.i").alias("b")).alias("link"))
    sizes = slim.groupBy(*keys).agg(F.max("i").alias("last"))
    folded = sizes.join(wide(links.groupBy(*keys).agg(F.array_sort(F.collect_list("link")).alias("links"))), keys, "left")
    label = """aggregate(coalesce(links, cast(array() AS array<struct<a:int,b:int>>)), sequence(0, last), (l, e) ->
        CASE WHEN l[e.a] = l[e.b] THEN l ELSE transform(l, x -> CASE WHEN x = greatest(l[e.a], l[e.b]) THEN least(l[e.a], l[e.b]) ELSE x END) END)"""
    return nodes.join(wide(folded.select(*keys, F.expr(label).alias("labels"))), keys).withColumn("root", F.expr("labels[i]")).drop("labels")


def _pair(prefix: str) -> tuple:
    return G.rect(f"{prefix}.")


def same_line(med: Column) -> Column:
    """Whether two boxes stand on one visual line."""
    a, b = _pair("a"), _pair("b")
    ha, hb = F.col("a.height"), F.col("b.height")
    level = (F.abs(F.col("a.cy") - F.col("b.cy")) <= med * V.LINE_V) | (G.vertical_overlap_ratio(a, b) >= V.LINE_OVERLAP)
    alike = F.abs(ha - hb) / F.greatest(ha, hb, F.lit(1e-6)) <= V.LINE_HEIGHT
    return level & alike & (G.horizontal_distance(a, b) <= med * V.LINE_H)


MEMBERS = "x1, seq, text, confidence, y1, x2, y2, height"
OUTLINE = """CASE WHEN exists(items, m -> size(m.polygon) >= 4) THEN concat(
        flatten(transform(filter(items, m -> size(m.polygon) >= 4), m -> array(m.polygon[0], m.polygon[1]))),
        flatten(transform(reverse(filter(items, m -> size(m.polygon) >= 4)), m -> array(m.polygon[2], m.polygon[3]))))
      ELSE array(array(x1, y1), array(x2, y1), array(x2, y2), array(x1, y2)) END"""


def assemble(members: DataFrame, keys: list[str], outlines: bool = False) -> DataFrame:
    """One row per group of boxes, from left to right: text, rectangle, mean confidence; with ``outlines`` the ``polygon`` around
    them too (only who asks for it pays for carrying every corner)."""
    one = F.expr(f"struct({MEMBERS}{', polygon' if outlines else ''})")
    rect = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("seq").alias("first_seq")]
    out = members.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("items"), *rect)
    r = G.rect()
    out = out.withColumns({
        "text": F.expr("array_join(transform(items, m -> m.text), ' ')"),
        "mean_confidence": F.expr("aggregate(items, 0D, (s, m) -> s + m.confidence) / size(items)"),
        "cx": G.center_x(r), "cy": G.center_y(r), "width": G.width(r), "height": G.height(r),
    })
    return out.withColumn("polygon", F.expr(OUTLINE)) if outlines else out


def reconstruct(items: DataFrame, outlines: bool = False) -> DataFrame:
    """Lines of each page in reading order, with ``line_index``. ``items`` as from ``enrich``."""
    nodes = with_median(numbered(items, PAGE, "seq"), default=15.0)
    grouped = components(nodes, same_line(F.col("a.med")), PAGE, ["x1", "y1", "x2", "y2", "cy", "height", "med"])
    lines = assemble(grouped, ["image_id", "root"], outlines).drop("root")
    banded = lines.withColumn("band", F.greatest(F.median("height").over(W.partitionBy("image_id")) * 0.5, F.lit(5.0)))
    order = W.partitionBy("image_id").orderBy(F.bround(F.col("y1") / F.col("band")), "x1", "first_seq")
    return banded.withColumn("line_index", F.row_number().over(order) - 1).drop("band")


def group_boxes(items: DataFrame, images: DataFrame) -> DataFrame:
    """Simpler lines: boxes that overlap vertically and stand close, in (y, x) order."""
    nodes = with_median(numbered(items, PAGE, "seq")).join(wide(images.select("image_id", "img_w")), PAGE)
    nodes = nodes.withColumn("gap", F.least(F.col("med") * V.GROUP_H, F.col("img_w") * V.GROUP_WIDTH))
    near = (G.vertical_overlap_ratio(_pair("a"), _pair("b")) >= V.LINE_OVERLAP) & (G.horizontal_distance(_pair("a"), _pair("b")) <= F.col("a.gap"))
    lines = assemble(components(nodes, near, PAGE, ["x1", "y1", "x2", "y2", "gap"]), ["image_id", "root"]).drop("root")
    return lines.withColumn("line_index", F.row_number().over(W.partitionBy("image_id").orderBy("y1", "x1", "first_seq")) - 1)


def cluster_near(lines: DataFrame, order: str = "line_index") -> DataFrame:
    """``lines`` with ``cluster``: centres within three median heights (15 px at least) hang together."""
    nodes = with_median(numbered(lines, PAGE, order))
    near = G.center_distance(_pair("a"), _pair("b")) <= F.greatest(F.col("a.med") * V.TABLE_DISTANCE, F.lit(15.0))
    return components(nodes, near, PAGE, ["x1", "y1", "x2", "y2", "med"]).withColumnRenamed("root", "cluster").drop("i", "med")


def gap_parts(members: DataFrame, keys: list[str], limit: Column) -> DataFrame:
    """Boxes with ``part``: how many gaps wider than ``limit`` stand to their left (each gap from the box before)."""
    order = W.partitionBy(*keys).orderBy("x1", "seq")
    wide = F.coalesce((F.col("x1") - F.lag("x2").over(order) > limit).cast("int"), F.lit(0))
    return members.withColumn("wide", wide).withColumn("part", F.sum("wide").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("wide")


def split_wide(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Lines cut at wide gaps. Only the parts of a cut line have ``confidence``; ``line_id`` is the new order."""
    measured = with_median(lines).join(wide(images.select("image_id", "img_w")), PAGE)
    limit = F.greatest(F.lit(25.0), F.least(F.col("img_w") * 0.05, F.col("med") * 1.2))
    boxes = measured.select("image_id", "line_index", "med", "img_w", F.inline("items"))
    parts = gap_parts(boxes, ["image_id", "line_index"], limit)
    out = assemble(parts, ["image_id", "line_index", "part"])
    cut = F.max("part").over(W.partitionBy("image_id", "line_index")) > 0
    out = out.withColumn("confidence", F.when(cut, F.col("mean_confidence")))
    return out.withColumn("line_id", F.row_number().over(W.partitionBy("image_id").orderBy("line_index", "part")) - 1)
