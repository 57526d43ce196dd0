"""The decisions around pixel kernels, as columns: sizes, quality flags, rotation, corners, packet outline, detector boxes.

The kernels themselves (resizing, edges, thresholds, warps) need an image library and run behind ``sources.readers.pixels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.storage import wide

MIN_HEIGHT, MAX_SIDE = 1000, 2800
VARIANTS = ["original", "gray", "clahe", "sharpened", "otsu", "adaptive_threshold", "denoised_clahe", "sharpened_threshold"]


def working_size(w: Column, h: Column) -> list[Column]:
    """Width and height after low images are scaled up and large ones down, rounded half to even at each step."""
    up = F.when(h < MIN_HEIGHT, MIN_HEIGHT / h.cast("double")).otherwise(F.lit(1.0))
    w1, h1 = F.when(h < MIN_HEIGHT, F.bround(w * up)).otherwise(w.cast("double")), F.when(h < MIN_HEIGHT, F.bround(h * up)).otherwise(h.cast("double"))
    side = F.greatest(w1, h1)
    down = F.when(side > MAX_SIDE, MAX_SIDE / side)
    return [F.when(down.isNotNull(), F.bround(w1 * down)).otherwise(w1).cast("int").alias("work_w"), F.when(down.isNotNull(), F.bround(h1 * down)).otherwise(h1).cast("int").alias("work_h")]


def quality(pixels: DataFrame) -> DataFrame:
    """Quality of each image from its gray values (``image_id``, ``y``, ``x``, ``v``): blur from the Laplacian's variance with
    mirrored edges, brightness, contrast, glare, shadow from 4 x 4 block means, and the flags."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = pixels.join(wide(size), "image_id")
    row, col = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    near = lambda o: (F.coalesce(F.lag("v").over(o), F.lead("v").over(o), F.col("v")) + F.coalesce(F.lead("v").over(o), F.lag("v").over(o), F.col("v")))
    p = p.withColumn("lap", (near(row) + near(col) - 4 * F.col("v")).cast("double"))
    bh, bw = F.greatest(F.lit(2), F.floor(F.col("h") / 4)), F.greatest(F.lit(2), F.floor(F.col("w") / 4))
    p = p.withColumns({"br": F.floor(F.col("y") / bh), "bc": F.floor(F.col("x") / bw)})
    blocks = p.where("br < 4 AND bc < 4").groupBy("image_id", "br", "bc").agg(F.avg("v").alias("m")).groupBy("image_id").agg(F.stddev_pop("m").alias("shadow_std"))
    told = p.groupBy("image_id").agg(F.var_pop("lap").alias("laplacian_variance"), F.avg("v").alias("brightness_mean"), F.stddev_pop("v").alias("contrast_std"), F.avg((F.col("v") > 250).cast("int")).alias("glare_ratio"))
    flags = {"is_blurry": F.col("laplacian_variance") < 60, "is_too_dark": F.col("brightness_mean") < 40, "is_too_bright": F.col("brightness_mean") > 235}
    return told.join(wide(blocks), "image_id", "left").withColumns(flags)


def skew(hough_angle: Column, hough_conf: Column, rect_angle: Column, rect_conf: Column) -> tuple[Column, Column, Column]:
    """Weighted angle, its confidence, and whether to rotate."""
    a, b = F.when(hough_angle.isNotNull(), hough_conf).otherwise(0.0), F.when(rect_angle.isNotNull(), rect_conf * 0.6).otherwise(0.0)
    weight = a + b
    angle = (F.coalesce(hough_angle, F.lit(0.0)) * a + F.coalesce(rect_angle, F.lit(0.0)) * b) / F.when(weight == 0, 1e-6).otherwise(weight)
    confidence = F.least(F.lit(1.0), weight)
    return angle, confidence, (confidence >= 0.35) & (F.abs(angle) >= 0.5) & (F.abs(angle) <= 15)


def corners(points: str) -> str:
    """Four points as top left, top right, bottom right, bottom left: by sums and differences of their coordinates."""
    key = lambda f, e: f"element_at({points}, cast(array_position(transform({points}, p -> {e}), {f}(transform({points}, p -> {e}))) AS int))"
    return f"struct({key('array_min', 'p[0] + p[1]')} AS tl, {key('array_min', 'p[1] - p[0]')} AS tr, {key('array_max', 'p[0] + p[1]')} AS br, {key('array_max', 'p[1] - p[0]')} AS bl)"


def distorted(ordered: str, least: float = 8.0) -> str:
    """Whether ordered corners leave an upright rectangle by enough pixels."""
    gaps = [f"abs({ordered}.tl[1] - {ordered}.tr[1])", f"abs({ordered}.bl[1] - {ordered}.br[1])", f"abs({ordered}.tl[0] - {ordered}.bl[0])", f"abs({ordered}.tr[0] - {ordered}.br[0])"]
    return f"greatest({', '.join(gaps)}) >= {least}"


#: least share of the image, weights of share and fill, confidence from which an image is cropped, margin around the packet
PACKET_SHARE, PACKET_WEIGHTS, PACKET_SURE, PACKET_MARGIN = 0.15, (0.7, 0.3), 0.55, 0.03
#: least share of the image of a quadrilateral by which it is straightened
QUADRILATERAL_SHARE = 0.35


def packet(contours: DataFrame) -> DataFrame:
    """The best outline of each image (``image_id``, ``ord``, ``area``, ``w``, ``h``, ``image_area``): large and filled, the first among equals."""
    some = contours.where(f"area >= image_area * {PACKET_SHARE} AND w * h > 0").withColumn("score", F.expr(f"area / image_area * {PACKET_WEIGHTS[0]}D + area / (w * h) * {PACKET_WEIGHTS[1]}D"))
    best = some.where("score > 0").groupBy("image_id").agg(F.max_by(F.struct("ord", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("image_id", "b.ord", "b.score")


def packet_regions(contours: DataFrame, images: DataFrame) -> DataFrame:
    """Where the packet is in every image: its outline with a margin if that is sure enough to ``crop``, else the whole image.

    ``contours``: image_id, ord, x, y, w, h, area. ``images``: image_id, img_w, img_h. Without an outline the confidence is 0.
    """
    sized = contours.join(wide(images.select("image_id", "img_w", "img_h")), "image_id").withColumn("image_area", (F.col("img_w") * F.col("img_h")).cast("double"))
    best = packet(sized).join(wide(contours.select("image_id", "ord", "x", "y", "w", "h")), ["image_id", "ord"])
    page = images.select("image_id", "img_w", "img_h").join(wide(best), "image_id", "left").withColumn("confidence", F.coalesce(F.least(F.lit(1.0), "score"), F.lit(0.0)))
    page = page.withColumn("crop", F.col("confidence") >= PACKET_SURE).withColumns({f"m{c}": F.floor(F.col(c) * PACKET_MARGIN) for c in ("w", "h")})
    low = lambda c, m: F.when(F.col("crop"), F.greatest(F.lit(0), F.col(c) - F.col(m))).otherwise(0).cast("int")
    high = lambda c, s, m, most: F.when(F.col("crop"), F.least(F.col(most), F.col(c) + F.col(s) + F.col(m))).otherwise(F.col(most)).cast("int")
    return page.select("image_id", low("x", "mw").alias("x1"), low("y", "mh").alias("y1"), high("x", "w", "mw", "img_w").alias("x2"), high("y", "h", "mh", "img_h").alias("y2"), "confidence", "crop")


def quadrilaterals(contours: DataFrame) -> DataFrame:
    """The largest outline with four points of each image, if it is large enough: ``image_id``, ``ord``, ``points``; the first among
    equals. ``contours``: image_id, ord, area, image_area, points."""
    some = contours.where(f"size(points) = 4 AND area >= image_area * {QUADRILATERAL_SHARE} AND area > 0")
    best = some.groupBy("image_id").agg(F.max_by(F.struct("ord", "points"), F.struct("area", -F.col("ord"))).alias("b"))
    return best.select("image_id", "b.ord", "b.points")


def top_boxes(detections: DataFrame, least: float = 0.35) -> DataFrame:
    """The surest box of each class of a detector (``image_id``, ``class``, ``ord``, ``conf``), the first among equals."""
    sure = detections.where(F.col("conf") >= least)
    return sure.groupBy("image_id", "class").agg(F.max_by(F.struct("ord", "conf"), F.struct("conf", -F.col("ord"))).alias("b")).select("image_id", "class", "b.ord", "b.conf")
