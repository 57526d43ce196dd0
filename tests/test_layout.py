"""Lines, columns, regions and reconciliation on hand-built pages, and invariants on synthetic ones."""

from pyspark.sql import functions as F

from labelgrid.operators import layout as Y
from labelgrid.operators import lines as L
from labelgrid.operators import regions as R
from labelgrid.plans import pages as P
from labelgrid.plans.queries import layout, regions

SF = "/root/testdata/sf0.001"
ITEM = "image_id bigint, seq int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def page(spark, boxes, image_id=1):
    return spark.createDataFrame([(image_id, i, t, 0.9, float(x), float(y), float(x + w), float(y + h)) for i, (t, x, y, w, h) in enumerate(boxes)], ITEM)


def test_lines_and_splits(spark):
    items = page(spark, [("b", 60, 10, 40, 20), ("a", 10, 11, 40, 20), ("far", 300, 10, 40, 20), ("tall", 110, 5, 40, 60), ("low", 10, 100, 40, 20)])
    lines = L.reconstruct(L.enrich(items)).orderBy("line_index").collect()
    assert [r["text"] for r in lines] == ["tall", "a b", "far", "low"]
    images = spark.createDataFrame([(1, 1000, 500)], "image_id bigint, img_w int, img_h int")
    wide = L.reconstruct(L.enrich(page(spark, [("a", 10, 10, 40, 20), ("b", 90, 10, 40, 20)])))
    parts = L.split_wide(wide, images).orderBy("line_id").collect()
    assert [(r["text"], r["confidence"]) for r in parts] == [("a", 0.9), ("b", 0.9)]
    whole = L.split_wide(L.reconstruct(L.enrich(page(spark, [("a", 10, 10, 40, 20), ("b", 60, 10, 40, 20)]))), images).collect()
    assert [(r["text"], r["confidence"]) for r in whole] == [("a b", None)]


def test_malformed_and_empty(spark):
    items = page(spark, [("a", 10, 10, 40, 20)]).unionByName(spark.createDataFrame([(1, 9, "no box", 0.5, None, 1.0, 2.0, 3.0), (1, 8, None, None, 200.0, 1.0, 220.0, 20.0)], ITEM))
    assert L.enrich(items).count() == 2
    none = spark.createDataFrame([], ITEM)
    assert L.reconstruct(L.enrich(none)).count() == 0
    empty = Y.Layout(none, spark.createDataFrame([], "image_id bigint, img_w int, img_h int"), [])
    assert empty.candidates.count() == 0


def test_invariants(spark):
    y = layout(spark, SF)
    boxes = y.unsplit.select("image_id", F.explode("items.seq").alias("seq"))
    assert boxes.count() == boxes.distinct().count() == y.items.count()
    spans = y.classified.groupBy("image_id", "column_id").agg(F.min("x1").alias("a"), F.max("x2").alias("b"))
    left, right = spans.alias("l"), spans.alias("r")
    crossing = left.join(right, (F.col("l.image_id") == F.col("r.image_id")) & (F.col("l.column_id") < F.col("r.column_id"))).where("l.b > r.a")
    assert crossing.count() == 0
    for r in regions(spark, SF):
        assert r.where("x1 IS NOT NULL AND NOT (x1 < x2 AND y1 < y2 AND x1 >= 0 AND y1 >= 0 AND x2 <= img_w AND y2 <= img_h)").count() == 0


def test_regions_of_a_page(spark):
    y = layout(spark, SF)
    i = R.detect_ingredients(y).where("image_id = 4").collect()[0]
    assert i["method"] == "heading_supported_cluster" and i["anchor"].startswith("Ingredients") and len(i["region"]) == 4
    n = regions(spark, SF)[1]
    assert n.where("image_id % 4 = 3").count() == 0  # personal care
    assert {"energy", "protein", "sodium"} <= set(n.where("image_id = 4").collect()[0]["terms"])


STATE = "image_id bigint, img_w int, img_h int, x1 double, y1 double, x2 double, y2 double, confidence double, region " + R.REGION_LINE.join(("array<", ">"))


def region(spark, lines, box=(0.0, 0.0, 100.0, 100.0), confidence=0.8):
    rows = [(float(20 * i), 0.0, i, t, 100.0, float(20 * i + 20), 20.0, None, a, b, c, [], False) for i, (t, a, b, c) in enumerate(lines)]
    return spark.createDataFrame([(1, 500, 500, *box, confidence, rows)], STATE)


def test_reconcile(spark):
    long, short = "x" * 21, "y" * 20
    ing = region(spark, [("ingredients: a, b", 0.9, 0.0, 0.0), (long, 0.5, 0.5, 0.0), (short, 0.5, 0.5, 0.0), ("address", 0.1, 0.0, 0.8)])
    nut = region(spark, [("energy 4 kcal", 0.0, 0.9, 0.0), (long, 0.5, 0.5, 0.0), (short, 0.5, 0.5, 0.0)])
    r = R.reconcile(ing, nut).collect()[0]
    assert r["touched"] and r["iou"] == 1.0
    # the lines at equal places are the same boxes as well: the first pair is decided by score
    assert long in [x["text"] for x in r["ing"]["lines"]] and long not in [x["text"] for x in r["nut"]["lines"]]
    assert short in [x["text"] for x in r["nut"]["lines"]] and short not in [x["text"] for x in r["ing"]["lines"]]
    assert "address" not in [x["text"] for x in r["ing"]["lines"]]
    assert r["ing"]["confidence"] == 0.78
    apart = R.reconcile(ing, region(spark, [("z", 0.0, 0.9, 0.0)], box=(200.0, 200.0, 300.0, 300.0)).withColumn("region", F.transform("region", lambda l: l.withField("x1", F.lit(200.0))))).collect()[0]
    assert not apart["touched"] and apart["ing"]["confidence"] == 0.8


def test_expansion_stops(spark):
    def walk(*more):
        boxes = [("Ingredients: salt, sugar,", 10, 10, 300, 20), *more]
        images = spark.createDataFrame([(1, 600, 2000)], "image_id bigint, img_w int, img_h int")
        y = Y.Layout(page(spark, boxes), images, P.VOCABULARY)
        found = R.expand_ingredients(y.classified, images).where("anchor_no = 0").collect()[0]
        return found["stop"], len(found["region"])

    assert walk(("flour, oil", 10, 35, 200, 20)) == ("exhausted_candidate_lines", 2)
    assert walk(("flour", 10, 35, 200, 20), ("palm", 10, 300, 200, 20)) == ("vertical_gap_exceeded", 2)
    assert walk(("Protein 8 g", 10, 35, 200, 20)) == ("nutrition_row_detected", 1)
    assert walk(("Storage", 10, 35, 200, 20)) == ("stop_word:storage(high_confidence_stop)", 1)
    stop, n = walk(*[(f"word{i}", 10, 35 + 24 * i, 200, 20) for i in range(45)])
    assert stop == "max_block_height_exceeded" and n < 40
    stop, n = walk(*[(f"word{i}", 10, 30 + 11 * i, 200, 20) for i in range(60)])
    assert n <= 40
