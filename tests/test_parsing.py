"""Parsers, matching, readers, writers, the stream: hand-built cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from labelgrid import cli
from labelgrid.functions import geometry as G
from labelgrid.operators import ensemble as E
from labelgrid.operators import evaluate as Q
from labelgrid.operators import parsing as A
from labelgrid.operators import lines as L
from labelgrid.plans import pages as P
from labelgrid.plans.queries import images, items
from labelgrid.sources import readers
from labelgrid.streaming import pages as S


def one(spark, text):
    return spark.createDataFrame([(1, text)], "k int, t string")


def test_phrases(spark):
    text = "Ingredients: Wheat Flour (65%), Citric Acid (INS 330), Vegetable Oil (Palm, Soya); Salt"
    got = [r["phrase"] for r in A.phrases(one(spark, text), "k", "t").orderBy("pos").collect()]
    assert got == ["wheat flour (65%)", "citric acid (ins 330)", "vegetable oil (palm, soya)", "salt"]
    odd = [r["phrase"] for r in A.phrases(one(spark, "a)b), cc; -dd.- , e, (x, (y), z), ff"), "k", "t").orderBy("pos").collect()]
    assert odd == ["a)b)", "cc", "dd", "(x, (y), z)", "ff"]
    assert A.phrases(one(spark, None), "k", "t").count() == 0
    plain = [r["token"] for r in A.ingredient_tokens(one(spark, text + ", salt, Nutrition Facts, 12"), "k", "t").orderBy("pos").collect()]
    assert plain == ["wheat flour", "citric acid", "vegetable oil palm", "soya", "salt"]


def spec_match(query, terms):
    canonical, score = None, 0.0
    for name, term in terms:
        s = term.lower()
        if s == query:
            return name, 100.0
        if (s in query or query in s) and len(s) > 3 and 100.0 * len(s) / max(len(query), 1) > score:
            canonical, score = name, 85.0
    return (canonical, score) if score >= 85 else (None, score)


def test_terms(spark):
    terms = [("A", "salt"), ("B", "sea salt"), ("C", "rock salt crystals"), ("D", "oil"), ("E", "palm oil"), ("F", "Salt")]
    queries = ["salt", "sea salt", "fine sea salt", "alt", "oil", "palm", "salt crystal", "zzz", "sea saltt", " Salt "]
    kb = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(terms)], "ord int, canonical string, searchable string")
    got = {r["phrase"]: (r["matched_name"], r["similarity"]) for r in A.match_terms(spark.createDataFrame([(q,) for q in queries], "phrase string"), kb).collect()}
    assert got == {q: spec_match(q.strip().lower(), terms) for q in queries}
    assert A.correct(one(spark, "salt, oil"), None, "k", "t").where("matched_name IS NULL").count() == 2


def test_nutrition(spark):
    got = {r["nutrient"]: (r["value"], r["unit"]) for r in A.parse_strings(one(spark, "Energy 450 kcal Protein 8 g Saturated Fat 3 g Energy 9 kj"), "k", "t").collect()}
    assert got == {"energy": (450.0, "kcal"), "protein": (8.0, "g"), "total_fat": (3.0, "g")}
    rows = [("Nutrition", 10, 10), ("Per 100g", 200, 10), ("Per serving", 350, 10), ("Energy", 10, 40), ("450 kcal", 200, 40), ("90 kcal", 350, 40), ("Protein", 10, 70), ("high", 200, 70), ("8 g", 350, 70), ("Energy", 10, 100), ("500 kcal", 200, 100), ("Salt", 10, 130)]
    boxes = spark.createDataFrame([(1, i, t, 0.9, float(x), float(y), float(x + 60), float(y + 20)) for i, (t, x, y) in enumerate(rows)], S.ITEMS)
    # gaps of 90 to 130 px: boxes of a row are joined only where they stand within four heights
    wide = boxes.withColumn("x1", F.col("x1") * 0.6).withColumn("x2", F.col("x1") + 40)
    found = {r["nutrient"]: r for r in A.parse_tables(L.reconstruct(L.enrich(wide))).collect()}
    assert set(found) == {"energy", "protein"}
    assert found["energy"]["per_100g"]["value"] == 500.0 and found["energy"]["per_serving"] is None
    assert found["protein"]["per_serving"]["value"] == 8.0 and found["protein"]["value"] == 8.0
    single = spark.createDataFrame([(2, 0, "Protein 8 g", 0.9, 0.0, 0.0, 90.0, 20.0)], S.ITEMS)
    both = A.parse_nutrition(L.reconstruct(L.enrich(single)), spark.createDataFrame([(2, "Protein 8 g")], "image_id bigint, text string")).collect()
    assert [(r["nutrient"], r["value"]) for r in both] == [("protein", 8.0)]


def test_ensemble_ties(spark):
    rows = [(1, "other", v, 0, "same", 0.5) for v in ("clahe", "original", "sharpened")] + [(2, "other", "original", 0, "x", 0.9), (2, "other", "clahe", 0, "much better words", 0.99)]
    r = spark.createDataFrame(rows, "image_id int, section string, variant string, seq int, text string, confidence double")
    q = spark.createDataFrame([(1, "other", False, False, 60.0), (2, "other", False, False, 60.0)], "image_id int, section string, is_blurry boolean, is_too_dark boolean, contrast_std double")
    got = {x["image_id"]: (x["variant"], x["readings"]) for x in E.choose(E.score(r), q).collect()}
    assert got == {1: ("original", 3), 2: ("original", 1)}


def test_iou_of_missing_boxes(spark):
    boxes = [(k, [float(x) for x in v["ingredients"]], v["nutrition"] and [float(x) for x in v["nutrition"]]) for k, v in P.ground_truth().items()]
    t = spark.createDataFrame(boxes, "image string, ingredients array<double>, nutrition array<double>")
    scored = {r["image"]: r for r in Q.score(t, t.withColumn("nutrition", F.lit(None).cast("array<double>"))).collect()}
    assert scored["product2.png"]["nutrition_iou"] == 1.0 and scored["product.png"]["nutrition_iou"] == 0.0
    row = spark.createDataFrame([(None, 1.0, 2.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")
    assert row.select(G.iou(G.rect(), G.rect())).collect()[0][0] == 0.0


def test_readers(spark, tmp_path):
    assert readers.discover_columns(["id", "Primary Name (EN)", "alt_names"]) == ("Primary Name (EN)", "alt_names")
    assert readers.discover_columns(["x", "y"]) == ("x", None)
    assert readers.discover_columns([]) == (None, None)
    (tmp_path / "kb.csv").write_text("ingredient_name,alt_names\nSalt,sea salt; rock/table|x\nnan,y\n ,z\nOil,\n")
    got = [(r["canonical"], r["searchable"]) for r in readers.kb_csv(spark, str(tmp_path / "kb.csv"), "food")[0].orderBy("ord").collect()]
    assert got == [("Salt", t) for t in ("Salt", "sea salt", "rock", "table", "x")] + [("Oil", "Oil")]
    table, why = readers.kb_csv(spark, str(tmp_path / "none.csv"), "food")
    assert table is None and why
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "kb.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Aqua</t></si></sst>')
    assert [r["searchable"] for r in readers.kb_xlsx(spark, str(tmp_path / "kb.xlsx"), "personal_care")[0].collect()] == ["Aqua"]
    assert readers.kb_xlsx(spark, str(tmp_path / "none.xlsx"), "x")[0] is None
    (tmp_path / "truth.json").write_text('{"a.png": {"ingredients": [1, 2, 3, 4], "nutrition": null}}')
    assert readers.ground_truth(spark, str(tmp_path / "truth.json")).collect()[0]["nutrition"] is None
    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "a.gif").write_bytes(b"x")
    assert readers.images(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="gif"):
        readers.images(spark, str(tmp_path / "a.gif"))
    kb = readers.KnowledgeBase(spark, food_csv=str(tmp_path / "kb.csv"), personal_care_xlsx=str(tmp_path / "none.xlsx"))
    assert kb.ingredient_names()[:2] == ["Salt", "sea salt"] and not kb.load_errors
    assert kb.ingredient_names("personal_care") == [] and set(kb.load_errors) == {"personal_care"}


def test_recognisers_are_asked_in_turn(spark):
    def fails(content):
        raise RuntimeError(content)

    def reads(content):
        return [(content.decode(), 0.5, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])] if content != b"bad" else fails(content)

    rows = spark.createDataFrame([("a", b"x"), ("b", b"bad"), ("c", b"y")], "path string, content binary")
    assert [(r["path"], r["seq"], r["text"]) for r in readers.read_boxes(rows, [fails, reads]).orderBy("path").collect()] == [("a", 0, "x"), ("c", 0, "y")]


def test_cli(spark, tmp_path):
    source = items(spark, "/root/testdata/sf0.001").where("image_id < 4")
    source.write.parquet(str(tmp_path / "items"))
    images(spark, "/root/testdata/sf0.001").where("image_id < 4").selectExpr("*", "concat(image_id, '.png') AS image").write.parquet(str(tmp_path / "images"))
    (tmp_path / "kb.csv").write_text("name,alternate names\nSugar,cane sugar\nSalt,\n")
    (tmp_path / "truth.json").write_text('{"0.png": {"ingredients": [34, 67, 476, 173], "nutrition": null}}')
    args = cli.parser().parse_args(["--items", str(tmp_path / "items"), "--images", str(tmp_path / "images"), "--output", str(tmp_path / "out"), "--food-kb", str(tmp_path / "kb.csv"), "--truth", str(tmp_path / "truth.json"), "--test-mode"])
    assert set(cli.run(spark, args)) == {"personal_care"}
    docs = {d["image"]: d for d in (json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/result.json")).collect())}
    assert len(docs) == 4 and docs["3.png"]["nutrition_region"] is None and docs["3.png"]["nutrition"] is None
    food = docs["0.png"]
    assert list(food) == ["image", "domain", "packet_detection", "ingredients_region", "nutrition_region", "ingredients", "nutrition", "processing", "image_quality"]
    assert {"ocr_text": "sugar", "normalized_text": "sugar", "matched_name": "Sugar", "confidence": 1.0} in food["ingredients"]
    assert food["processing"] == {"best_ingredient_variant": "original", "best_nutrition_variant": "original"}
    assert spark.read.json(str(tmp_path / "out/evaluation.json")).count() == 1
    assert spark.read.text(str(tmp_path / "out/debug_regions.json")).count() >= 6


def test_a_page_in_two_batches_is_an_error(spark, tmp_path):
    one = spark.createDataFrame([(1, 0, "a", 0.9, 0.0, 0.0, 9.0, 9.0)], S.ITEMS)
    one.write.parquet(str(tmp_path / "in"))
    start = lambda: S.write_lines(S.read_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    start()
    one.write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="several batches"):
        start()


def test_stream(spark, tmp_path):
    source = items(spark, "/root/testdata/sf0.001").selectExpr("image_id", "cast(seq AS int) AS seq", "text", "confidence", "x1", "y1", "x2", "y2").where("image_id < 8")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    S.write_lines(S.read_items(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("image_id").distinct().count() == 8
