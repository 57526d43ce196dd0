"""Section regions: ordered expansion from a heading, candidate ranking, refinement, reconciliation.

An expansion walks the lines of a page in reading order and may stop at any of them; it is a fold over a sorted array with the
stop reason in its state, so it runs in the JVM, page by page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import geometry as G
from labelgrid.functions import vocab as V
from labelgrid.storage import stage, wide

from . import layout as Y
from . import lines as L

PAGE = ["image_id"]
ANCHOR = ["image_id", "anchor_no"]
#: what a region knows of its lines; lines found without the classifier have no scores
REGION_LINE = "struct<y1:double,x1:double,line_id:int,text:string,x2:double,y2:double,height:double,confidence:double,ing:double,nut:double,oth:double,hits:array<string>,has_term:boolean>"
_PLAIN = "struct(place, y1, x1, line_id, text, x2, y2, height, confidence, hits, has_term, strong, bound)"
_SCORED = "transform(lines, l -> struct(l.y1 AS y1, l.x1 AS x1, l.line_id AS line_id, l.text AS text, l.x2 AS x2, l.y2 AS y2, l.height AS height, l.confidence AS confidence, l.s_ingredients AS ing, l.s_nutrition AS nut, l.other_score AS oth, l.hits AS hits, l.has_term AS has_term))"


def _overlap(a1: str, a2: str, b1: str, b2: str) -> str:
    short = f"least({a2} - {a1}, {b2} - {b1})"
    return f"(CASE WHEN {short} <= 0 THEN 0D ELSE greatest(0D, least({a2}, {b2}) - greatest({a1}, {b1})) / {short} END)"


def expansion(lines: str, gap: str, *, skip_above: bool, stop_at_rows: bool) -> str:
    """A fold over the sorted array ``lines`` from the seed ``sx1..sy2``; ``med`` is the page's line height.

    Struct: rectangle and band so far, ``stop`` (the reason) and ``taken`` (the accepted lines).
    """
    state = f"struct(sx1 AS x1, sy1 AS y1, sx2 AS x2, sy2 AS y2, sx1 AS bl, sx2 AS br, cast(null AS string) AS stop, cast(array() AS array<{REGION_LINE}>) AS taken)"

    def stopped(reason: str) -> str:
        return f"struct(s.x1 AS x1, s.y1 AS y1, s.x2 AS x2, s.y2 AS y2, s.bl AS bl, s.br AS br, {reason} AS stop, s.taken AS taken)"

    taken = "struct(l.y1 AS y1, l.x1 AS x1, l.line_id AS line_id, l.text AS text, l.x2 AS x2, l.y2 AS y2, l.height AS height, l.confidence AS confidence, 0D AS ing, 0D AS nut, 0D AS oth, l.hits AS hits, l.has_term AS has_term)"
    grown = f"struct(least(s.x1, l.x1) AS x1, least(s.y1, l.y1) AS y1, greatest(s.x2, l.x2) AS x2, greatest(s.y2, l.y2) AS y2, least(s.bl, l.x1) AS bl, greatest(s.br, l.x2) AS br, cast(null AS string) AS stop, concat(s.taken, array({taken})) AS taken)"
    first = 1 if skip_above else 0  # the heading counts as a line where lines above it are skipped
    rules = [
        ("s.stop IS NOT NULL", "s"),
        (f"size(s.taken) + {first} >= {V.EXPAND_LINES}", stopped("'max_lines_reached'")),
        *([("l.y1 < sy1 - med * 0.3D", "s")] if skip_above else []),
        (f"greatest(l.y1 - s.y2, s.y1 - l.y2, 0D) > {gap}", stopped("'vertical_gap_exceeded'")),
        (f"greatest(l.y2, s.y2) - least(sy1, l.y1) > med * {V.EXPAND_HEIGHT}", stopped("'max_block_height_exceeded'")),
        (f"NOT (abs(l.x1 - s.bl) <= med * {V.BAND}D OR {_overlap('s.bl', 's.br', 'l.x1', 'l.x2')} >= {V.BAND_OVERLAP}D)", "s"),
        *([("l.strong", stopped("'nutrition_row_detected'"))] if stop_at_rows else []),
        ("l.bound.is_stop", stopped("concat('stop_word:', l.bound.stop, '(', l.bound.reason, ')')")),
    ]
    cases = " ".join(f"WHEN {test} THEN {then}" for test, then in rules)
    return f"aggregate({lines}, {state}, (s, l) -> CASE {cases} ELSE {grown} END)"


def anchors(lines: DataFrame, column: str, weak: str | None = None) -> DataFrame:
    """The best headings of each page: highest score first, the weak word behind all others; ``anchor_no`` from 0."""
    found = lines.where(F.col(f"{column}.score") >= V.ANCHOR_SCORE).where("length(norm_text) >= 2")
    weakness = (F.col(f"{column}.anchor") == F.lit(weak)).cast("int") if weak else F.lit(0)
    order = W.partitionBy("image_id").orderBy(weakness, F.desc(f"{column}.score"), "line_id")
    ranked = found.withColumn("anchor_no", F.row_number().over(order) - 1).where(F.col("anchor_no") < V.ANCHORS_TRIED)
    return ranked.select("image_id", "anchor_no", F.col("line_id").alias("seed_id"), F.col("text").alias("seed_text"), F.col("x1").alias("sx1"), F.col("y1").alias("sy1"), F.col("x2").alias("sx2"), F.col("y2").alias("sy2"), F.col("confidence").alias("seed_conf"), F.col("height").alias("seed_height"), F.col("hits").alias("seed_hits"), F.col("has_term").alias("seed_term"), F.col(f"{column}.anchor").alias("anchor"), F.col(f"{column}.score").alias("anchor_score"), F.col("page_med").alias("med"))


def _walk(seeds: DataFrame, lines: DataFrame, keep: Column, gap: str, *, reverse: bool = False, keys: list[str] = ANCHOR, skip_above: bool = False, stop_at_rows: bool = False, name: str = "walk") -> DataFrame:
    """``seeds`` with ``name``, the expansion over the page's lines that ``keep`` holds for, without the seed itself."""
    others = seeds.join(wide(lines.select("image_id", "line_id", "text", "x1", "y1", "x2", "y2", "height", "confidence", "hits", "has_term", F.col("row.strong").alias("strong"), "bound")), PAGE)
    others = Y.reading_order(others.where((F.col("line_id") != F.col("seed_id")) & keep), keys, "line_id")
    listed = others.groupBy(*keys).agg(F.array_sort(F.collect_list(F.expr(_PLAIN))).alias("others"))
    walked = seeds.join(wide(listed), keys, "left").withColumn("others", F.coalesce("others", F.expr(f"filter(array({_EMPTY}), x -> false)")))
    order = "reverse(others)" if reverse else "others"
    return walked.withColumn(name, F.expr(expansion(order, gap, skip_above=skip_above, stop_at_rows=stop_at_rows))).drop("others")


_EMPTY = "named_struct('place', 0, 'y1', 0D, 'x1', 0D, 'line_id', 0, 'text', '', 'x2', 0D, 'y2', 0D, 'height', 0D, 'confidence', 0D, 'hits', cast(array() AS array<string>), 'has_term', false, 'strong', false, 'bound', named_struct('is_stop', false, 'stop', '', 'score', 0D, 'reason', ''))"
_SEED = "struct(sy1 AS y1, sx1 AS x1, seed_id AS line_id, seed_text AS text, sx2 AS x2, sy2 AS y2, seed_height AS height, seed_conf AS confidence, 0D AS ing, 0D AS nut, 0D AS oth, seed_hits AS hits, seed_term AS has_term)"
_MEAN_CONFIDENCE = "aggregate(region, 0D, (s, l) -> s + coalesce(l.confidence, 0D)) / size(region)"
_TERMS = "sort_array(array_distinct(flatten(transform(region, l -> l.hits))))"


def expand_ingredients(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Expansions from the ingredient headings of each page, inside the heading's column, with their confidence."""
    seeds = anchors(lines, "ing_anchor", weak="contains")
    window = seeds.join(wide(lines.select("image_id", "line_id", "x1", "x2", "y1")), PAGE).where("y1 >= sy1 - med * 0.5 AND y1 <= sy1 + med * 6.0")
    gap = F.col("img_w") * F.least(F.lit(V.COLUMN_GAP), F.col("med") * 0.8 / F.col("img_w"))
    window = window.join(wide(images.select("image_id", "img_w")), PAGE).withColumn("min_gap", gap)
    cut = Y.split_columns(window, ANCHOR)
    own = F.max(F.when(F.col("line_id") == F.col("seed_id"), F.col("column_id"))).over(W.partitionBy(*ANCHOR))
    column = cut.withColumn("own", own).where("column_id = own").groupBy(*ANCHOR).agg(F.min("x1").alias("left"), F.max("x2").alias("right"))
    seeds = stage(seeds.join(wide(column), ANCHOR))
    inside = F.expr("(x1 + x2) / 2.0 BETWEEN left - 10 AND right + 10")
    walked = _walk(seeds, lines, inside, f"med * {V.EXPAND_GAP}D", skip_above=True, stop_at_rows=True)
    out = walked.withColumn("region", F.expr(f"concat(array({_SEED}), walk.taken)")).withColumn("stop", F.coalesce("walk.stop", F.lit("exhausted_candidate_lines")))
    share = "size(filter(region, l -> l.has_term)) / cast(size(region) AS double)"
    ended = "CASE WHEN stop LIKE 'stop_word%' OR stop = 'nutrition_row_detected' THEN 0.12D ELSE 0.04D END"
    raw = f"anchor_score / 100D * 0.4D + least(0.30D, 0.04D * (size(region) - 1)) + least(0.15D, {share} * 0.15D) + {ended} + {_MEAN_CONFIDENCE} * 0.10D"
    return _finished(out, raw)


def expand_nutrition(lines: DataFrame) -> DataFrame:
    """Expansions downward from the nutrition headings of each page, with their confidence."""
    seeds = stage(anchors(lines, "nut_anchor"))
    walked = _walk(seeds, lines, F.expr("y1 >= sy1 - 1e-6D"), f"med * {V.EXPAND_GAP}D")
    out = walked.withColumn("region", F.expr(f"concat(array({_SEED}), walk.taken)")).withColumn("stop", F.coalesce("walk.stop", F.lit("exhausted_candidate_lines")))
    ended = "CASE WHEN stop LIKE 'stop_word%' THEN 0.1D ELSE 0.03D END"
    raw = f"anchor_score / 100D * 0.4D + least(0.3D, 0.04D * (size(region) - 1)) + least(0.2D, 0.03D * size({_TERMS})) + {ended} + {_MEAN_CONFIDENCE} * 0.10D"
    return _finished(out, raw)


def _finished(out: DataFrame, raw: str) -> DataFrame:
    box = [F.expr(f"{f}(transform(region, l -> l.{c}))").alias(c) for c, f in (("x1", "array_min"), ("y1", "array_min"), ("x2", "array_max"), ("y2", "array_max"))]
    return out.select("image_id", "anchor_no", "anchor", "anchor_score", "stop", "region", F.expr(_TERMS).alias("terms"), *box, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(0.98), F.expr(raw))), 3).alias("confidence"))


def nutrition_rows(lines: DataFrame) -> DataFrame:
    """Pages whose lines with nutrient words make a table: the best cluster by terms and geometry, expanded both ways."""
    hits = lines.where("size(hits) > 0")
    enough = hits.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("image_id"))).where(F.col("n") >= V.TABLE_TERMS)
    near = L.cluster_near(enough.select("image_id", "line_id", "text", "x1", "y1", "x2", "y2", "height", "confidence", "hits", "has_term", "page_med"), "line_id")
    members = near.groupBy("image_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("line_id", "x1", "y1", "x2", "y2", "height", "hits"))).alias("m"), F.first("page_med").alias("med"))
    members = members.withColumn("terms", F.expr("sort_array(array_distinct(flatten(transform(m, x -> x.hits))))")).where(F.size("terms") >= V.TABLE_TERMS)
    scored = members.withColumn("score", F.expr(f"0.55D * least(1D, size(terms) / 8D) + 0.45D * {table_geometry('m')}"))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "cluster"))).where("r = 1 AND score > 0")
    seeds = Y.reading_order(near.join(wide(best.select("image_id", "cluster", F.col("terms").alias("best_terms"), "score", "med")), ["image_id", "cluster"]), PAGE, "line_id").where("place = 0")
    seeds = stage(seeds.select("image_id", F.lit(0).alias("anchor_no"), F.col("line_id").alias("seed_id"), F.col("text").alias("seed_text"), F.col("x1").alias("sx1"), F.col("y1").alias("sy1"), F.col("x2").alias("sx2"), F.col("y2").alias("sy2"), F.col("confidence").alias("seed_conf"), F.col("height").alias("seed_height"), F.col("hits").alias("seed_hits"), F.col("has_term").alias("seed_term"), "best_terms", "score", "med"))
    down = _walk(seeds, lines, F.expr("y1 >= sy1 - 1e-6D"), f"med * {V.EXPAND_GAP}D", name="down")
    up = _walk(seeds, lines, F.expr("y1 < sy1 - 1e-6D"), f"med * {V.HEADER_GAP}D", reverse=True, name="up")
    both = down.join(wide(up.select("image_id", "up")), PAGE).withColumn("region", F.expr(f"concat(reverse(up.taken), array({_SEED}), down.taken)"))
    box = [F.expr(f"{f}(transform(region, l -> l.{c}))").alias(c) for c, f in (("x1", "array_min"), ("y1", "array_min"), ("x2", "array_max"), ("y2", "array_max"))]
    return both.select("image_id", "region", F.col("best_terms").alias("terms"), *box, F.bround(F.least(F.lit(0.9), F.col("score")), 3).alias("confidence"), F.coalesce("down.stop", F.lit("exhausted_candidate_lines")).alias("stop"))


def table_geometry(m: str) -> str:
    """How much an array of lines looks like a table: even heights, short lines, compact box; 0 below two lines."""
    n = f"size({m})"
    mean_h = f"(aggregate({m}, 0D, (s, x) -> s + (x.y2 - x.y1)) / {n})"
    spread = f"sqrt(aggregate({m}, 0D, (s, x) -> s + (x.y2 - x.y1 - {mean_h}) * (x.y2 - x.y1 - {mean_h})) / {n})"
    mean_w = f"(aggregate({m}, 0D, (s, x) -> s + (x.x2 - x.x1)) / {n})"
    box = f"greatest(1D, (array_max(transform({m}, x -> x.x2)) - array_min(transform({m}, x -> x.x1))) * (array_max(transform({m}, x -> x.y2)) - array_min(transform({m}, x -> x.y1))))"
    filled = f"least(1D, aggregate({m}, 0D, (s, x) -> s + (x.x2 - x.x1) * (x.y2 - x.y1)) / {box} * 3D)"
    short = f"CASE WHEN {mean_w} < 600 THEN 1D ELSE greatest(0D, 1D - ({mean_w} - 600) / 1000D) END"
    return f"(CASE WHEN {n} < 2 THEN 0D ELSE 0.4D * greatest(0D, 1D - least({spread} / greatest({mean_h}, 1e-6D), 1D)) + 0.3D * {short} + 0.3D * {filled} END)"


REGION = ["image_id", "x1", "y1", "x2", "y2", "confidence", "anchor", "method", "region", "terms"]


def _of_candidates(candidates: DataFrame, section: str) -> DataFrame:
    head = "ing_head" if section == "ingredients" else "nut_head"
    first = f"CASE WHEN heading_score > 0 AND exists(lines, l -> l.{head}) THEN filter(lines, l -> l.{head})[0].text END"
    return candidates.where(F.col("type") == section).select("image_id", "x1", "y1", "x2", "y2", F.col("final_score").alias("confidence"), F.expr(first).alias("anchor"), "method", F.expr(_SCORED).alias("region"), "terms", "place")


def _ranked(parts: list[tuple[DataFrame, Column]], images: DataFrame) -> DataFrame:
    """The best of several candidate tables by confidence, the earlier one among equals; its box clipped and checked."""
    out = None
    for i, (df, tie) in enumerate(parts):
        one = df.withColumn("part", F.lit(i)).withColumn("tie", tie).select(*REGION, "part", "tie")
        out = one if out is None else out.unionByName(one)
    order = W.partitionBy("image_id").orderBy(F.desc("confidence"), "part", "tie")
    best = out.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "part", "tie")
    pages = images.select("image_id", "img_w", "img_h").join(wide(best), PAGE, "left")
    box = G.valid(G.rect(), F.col("img_w"), F.col("img_h"))
    return pages.select("image_id", "img_w", "img_h", *box, F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "anchor", F.coalesce("method", F.lit("none")).alias("method"), F.coalesce("region", F.expr(f"cast(array() AS array<{REGION_LINE}>)")).alias("region"), F.coalesce("terms", F.expr("cast(array() AS array<string>)")).alias("terms"))


def detect_ingredients(layout: Y.Layout) -> DataFrame:
    """One row per page: the first candidate of at least ``PRIMARY``, else the best of expansions and weaker candidates."""
    found = stage(_of_candidates(layout.candidates, "ingredients"))
    primary = found.where((F.col("place") == 0) & (F.col("confidence") >= V.PRIMARY))
    open_ = layout.classified.join(wide(primary.select("image_id")), PAGE, "left_anti")
    legacy = expand_ingredients(open_, layout.images).withColumn("method", F.lit("anchor_expansion"))
    weak = found.join(wide(primary.select("image_id")), PAGE, "left_anti").withColumn("anchor", F.lit(None).cast("string"))
    return stage(_ranked([(primary, F.col("place")), (legacy, F.col("anchor_no")), (weak, F.col("place"))], layout.images))


def detect_nutrition(layout: Y.Layout) -> DataFrame:
    """As ``detect_ingredients``, with headings, blocks and rows as fallbacks."""
    found = stage(_of_candidates(layout.candidates, "nutrition"))
    primary = found.where((F.col("place") == 0) & (F.col("confidence") >= V.PRIMARY))
    open_ = layout.classified.join(wide(primary.select("image_id")), PAGE, "left_anti")
    legacy = expand_nutrition(open_).withColumn("method", F.lit("anchor_expansion"))
    rows = nutrition_rows(open_).withColumns({"method": F.lit("table_geometry_fallback"), "anchor": F.lit(None).cast("string")})
    return stage(_ranked([(primary, F.col("place")), (legacy, F.col("anchor_no")), (block_fallback(layout.blocks).join(wide(primary.select("image_id")), PAGE, "left_anti"), F.lit(0)), (rows, F.lit(0))], layout.images))


def block_fallback(blocks: DataFrame, kind: str = "NUTRITION_TABLE_BLOCK", score: str = "s_nutrition") -> DataFrame:
    """The block of a kind with the highest mean score of each page, as a region."""
    mean = f"aggregate(lines, 0D, (s, l) -> s + l.{score}) / size(lines)"
    scored = blocks.where(F.col("type") == kind).withColumn("confidence", F.bround(F.least(F.lit(0.7), F.lit(0.3) + F.lit(0.4) * F.expr(mean)), 3))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("confidence"), "block_id"))).where("r = 1")
    method = "table_geometry_fallback" if kind == "NUTRITION_TABLE_BLOCK" else "vocabulary_fallback"
    return best.select("image_id", "x1", "y1", "x2", "y2", "confidence", F.lit(None).cast("string").alias("anchor"), F.lit(method).alias("method"), F.expr(_SCORED).alias("region"), F.expr("sort_array(array_distinct(flatten(transform(lines, l -> l.hits))))").alias("terms"))


def refined(lines: str, score: str, w: str, h: str, box: tuple[str, str, str, str] | None = None) -> str:
    """Struct of the tight box around the lines that belong to the section (all if none does), padded and cut to the image.

    ``box`` bounds it from left and right; without one the lines do.
    """
    used = f"(CASE WHEN exists({lines}, l -> l.{score} >= 0.08D) THEN filter({lines}, l -> l.{score} >= 0.08D) ELSE {lines} END)"
    low, high = (lambda c: f"array_min(transform({used}, l -> l.{c}))"), (lambda c: f"array_max(transform({used}, l -> l.{c}))")
    left, right = (low("x1"), high("x2")) if box is None else (f"greatest({low('x1')}, {box[0]})", f"least({high('x2')}, {box[2]})")
    heights = f"array_sort(transform(filter({lines}, l -> l.y2 - l.y1 > 0), l -> l.y2 - l.y1))"
    middle = f"(CASE WHEN size({heights}) = 0 THEN 20D ELSE ({heights}[(size({heights}) - 1) div 2] + {heights}[size({heights}) div 2]) / 2D END)"
    px, py = f"bround(0.3D * {middle})", f"bround(0.2D * {middle})"
    return f"struct(greatest(0D, {left} - {px}) AS x1, greatest(0D, {low('y1')} - {py}) AS y1, least(cast({w} AS double), {right} + {px}) AS x2, least(cast({h} AS double), {high('y2')} + {py}) AS y2)"


def refine(regions: DataFrame, section: str) -> DataFrame:
    """Regions with their tight box; a region without box or lines keeps what it has."""
    tight = refined("region", "ing" if section == "ingredients" else "nut", "img_w", "img_h", ("x1", "y1", "x2", "y2"))
    some = regions.withColumn("tight", F.expr(f"CASE WHEN x1 IS NOT NULL AND size(region) > 0 THEN {tight} END"))
    method = "CASE WHEN x1 IS NULL THEN 'none' WHEN size(region) = 0 THEN 'keep_original' ELSE 'conservative_column_aligned' END"
    out = some.withColumn("refinement", F.expr(method)).withColumn("changed", F.expr("tight IS NOT NULL AND NOT (tight.x1 = x1 AND tight.y1 = y1 AND tight.x2 = x2 AND tight.y2 = y2)"))
    return out.select(*(c for c in regions.columns if c not in ("x1", "y1", "x2", "y2")), *(F.coalesce(f"tight.{c}", c).alias(c) for c in ("x1", "y1", "x2", "y2")), "refinement", "changed")


def reconcile(ingredients: DataFrame, nutrition: DataFrame) -> DataFrame:
    """One row per page with both regions made exclusive: contested lines go to the section that scores them higher.

    Structs ``ing`` and ``nut`` (box, confidence, lines), ``iou`` before, and ``touched``.
    """
    side = lambda df, n: df.select("image_id", *([F.col("img_w"), F.col("img_h")] if n == "i" else []), *(F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2", "confidence", "region")))
    both = side(ingredients, "i").join(wide(side(nutrition, "n")), PAGE)
    both = both.withColumn("iou", G.iou(G.rect("i_"), G.rect("n_")))
    same = "(a.text = b.text OR (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2))"
    both = both.withColumn("shared", F.expr(f"exists(i_region, a -> exists(n_region, b -> {same}))"))
    touched = (F.col("i_x1").isNotNull()) & F.col("n_x1").isNotNull() & ((F.col("iou") > V.RECONCILE_IOU) | F.col("shared"))
    both = both.withColumn("touched", touched)
    to_nut = "(b.nut > a.ing OR (a.ing = b.nut AND length(a.text) <= 20))"
    foreign = lambda own, other, x: f"(({x}.{other} > {x}.{own} + 0.3D AND {x}.{other} > 0.6D) OR ({x}.oth > {x}.{own} + 0.3D AND {x}.oth > 0.7D))"
    left_i = f"filter(i_region, a -> NOT exists(n_region, b -> {same} AND {to_nut}) AND NOT {foreign('ing', 'nut', 'a')})"
    left_n = f"filter(n_region, b -> NOT exists(i_region, a -> {same} AND NOT {to_nut}) AND NOT {foreign('nut', 'ing', 'b')})"
    both = both.withColumns({"i_left": F.expr(left_i), "n_left": F.expr(left_n)})
    out = ["image_id", "iou", "touched"]
    for n, score in (("i", "ing"), ("n", "nut")):
        box = f"CASE WHEN NOT touched THEN struct({n}_x1 AS x1, {n}_y1 AS y1, {n}_x2 AS x2, {n}_y2 AS y2) WHEN size({n}_left) = 0 THEN null ELSE {refined(f'{n}_left', score, 'img_w', 'img_h')} END"
        confidence = f"CASE WHEN NOT touched THEN {n}_confidence WHEN size({n}_left) = 0 THEN 0D ELSE bround(greatest(0.05D, {n}_confidence - 0.02D), 3) END"
        out.append(F.struct(F.expr(box).alias("box"), F.expr(confidence).alias("confidence"), F.expr(f"CASE WHEN touched THEN {n}_left ELSE {n}_region END").alias("lines")).alias(score))
    return both.select(*out)
