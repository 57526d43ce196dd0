"""Result documents: one JSON object, and one readable text, per page; what regions were found by, for debugging."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrid.storage import wide

PAGE = ["image_id"]


def documents(names: DataFrame, domains: DataFrame, regions: DataFrame, best: DataFrame, ingredients: DataFrame, nutrients: DataFrame, packets: DataFrame | None = None, quality: DataFrame | None = None) -> DataFrame:
    """Nested result rows. ``nutrition_region`` and ``nutrition`` are null for personal care, where nutrition is skipped; ``nutrition``
    also where the page has no reading of a nutrition region."""
    one = F.struct(F.col("phrase").alias("ocr_text"), "normalized_text", "matched_name", "confidence")
    listed = ingredients.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("one")))), lambda x: x["one"]).alias("ingredients"))
    fact = F.struct("per_100g", "per_serving", "value", "unit")
    named = nutrients.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("nutrient", fact)))).alias("facts"))
    box = F.when(F.col("x1").isNotNull(), F.array("x1", "y1", "x2", "y2"))
    region = F.struct(box.alias("bbox"), "confidence", "anchor", "method")
    parts = regions.groupBy("image_id").agg(*(F.max(F.when(F.col("section") == s, region)).alias(f"{s}_region") for s in ("ingredient", "nutrition")))
    read = best.groupBy("image_id").agg(*(F.max(F.when(F.col("section") == s, F.col("variant"))).alias(f"best_{s}_variant") for s in ("ingredient", "nutrition")))
    page = names.join(wide(domains.select("image_id", "domain")), PAGE)
    joined = [parts, read, listed, named]
    if packets is None:
        page = page.withColumn("packet_detection", F.lit(None).cast("struct<bbox:array<int>,confidence:double>"))
    else:
        packed = packets.select("image_id", F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox"), (F.round(F.col("confidence") * 1000) / 1000).alias("confidence")).alias("packet_detection"))
        joined.append(packed)
    if quality is None:
        page = page.withColumn("image_quality", F.lit(None).cast("struct<laplacian_variance:double>"))
    else:
        measured = quality.select("image_id", F.struct(*(c for c in quality.columns if c != "image_id")).alias("image_quality"))
        joined.append(measured)
    for part in joined:
        page = page.join(wide(part), PAGE, "left")
    food = F.col("domain") == "food"
    empty = F.col("ingredient_region").isNotNull() & F.col("ingredients").isNull()
    facts = F.when(food & F.col("best_nutrition_variant").isNotNull(), F.coalesce("facts", F.expr("cast(map() AS map<string,struct<per_100g:struct<value:double,unit:string>,per_serving:struct<value:double,unit:string>,value:double,unit:string>>)")))
    return page.select(
        "image_id", "image", "domain", "packet_detection", F.col("ingredient_region").alias("ingredients_region"), F.when(food, F.col("nutrition_region")).alias("nutrition_region"),
        F.when(empty, F.expr("cast(array() AS array<struct<ocr_text:string,normalized_text:string,matched_name:string,confidence:double>>)")).otherwise(F.col("ingredients")).alias("ingredients"),
        facts.alias("nutrition"), F.struct("best_ingredient_variant", "best_nutrition_variant").alias("processing"), "image_quality",
    )


def as_json(docs: DataFrame) -> DataFrame:
    """``image_id`` and ``value``: one JSON object per page. Of a nutrient only the columns that its row has are written."""
    full = {"ignoreNullFields": "false"}
    head = F.to_json(F.struct("image", "domain", "packet_detection", "ingredients_region", "nutrition_region", "ingredients"), full)
    tail = F.to_json(F.struct("processing", "image_quality"), full)
    facts = F.coalesce(F.to_json("nutrition"), F.lit("null"))
    parts = docs.select("image_id", head.alias("head"), facts.alias("facts"), tail.alias("tail"))
    return parts.select("image_id", F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"nutrition":'), "facts", F.lit(","), F.expr("substring(tail, 2)")).alias("value"))


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _region(title: str, name: str) -> list[Column]:
    r = F.col(name)
    box = F.when(r["bbox"].isNull(), F.lit("None")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(r["bbox"], lambda v: v.cast("string")), ", "), F.lit("]")))
    return [F.lit(f"--- {title} Region ---"), F.concat(F.lit("bbox: "), box), *(F.concat(F.lit(f"{c}: "), _shown(r[c])) for c in ("confidence", "anchor", "method"))]


def as_text(docs: DataFrame) -> DataFrame:
    """``image_id`` and ``value``: a readable report per page."""
    none = F.expr("cast(array() AS array<struct<ocr_text:string,normalized_text:string,matched_name:string,confidence:double>>)")
    listed = F.array_join(F.transform(F.coalesce("ingredients", none), lambda x: F.concat(F.lit("  - "), x["ocr_text"], F.lit("  ->  "), F.coalesce(x["matched_name"], F.lit("(no confident KB match)")), F.lit("\n"))), "")
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("nutrition")), lambda x: F.concat(F.lit("  - "), x["key"], F.lit(": "), _shown(x["value"]["value"]), F.lit(" "), _shown(x["value"]["unit"]), F.lit("\n"))), "")
    facts = F.when(F.coalesce(F.size("nutrition"), F.lit(0)) > 0, facts).otherwise("  (none extracted)\n")
    lines = lambda cs: F.concat_ws("\n", *cs)
    nutrition = F.when(F.col("domain") == "food", F.concat(lines(_region("Nutrition", "nutrition_region")), F.lit("\n\nNutrition facts:\n"), facts)).otherwise("--- Nutrition Region ---\n  skipped (personal_care domain)\n")
    head = lines([F.concat(F.lit("Result for: "), "image"), F.concat(F.lit("Domain: "), "domain"), F.lit(""), *_region("Ingredients", "ingredients_region")])
    return docs.select("image_id", F.concat(head, F.lit("\n\nIngredients:\n"), listed, F.lit("\n"), nutrition).alias("value"))


def write_json(docs: DataFrame, path: str) -> None:
    as_json(docs).select("value").write.text(path)


def write_text(docs: DataFrame, path: str) -> None:
    as_text(docs).select("value").write.option("lineSep", "\n\n").text(path)


def write_debug(regions: DataFrame, path: str) -> None:
    """What each region was found by (anchor, method, its lines and terms), one JSON object per page and section."""
    wanted = [c for c in ("image_id", "section", "anchor", "method", "confidence", "region", "terms", "x1", "y1", "x2", "y2") if c in regions.columns]
    regions.select(F.to_json(F.struct(*wanted), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_bytes(rows: DataFrame, folder: str, name: str) -> str:
    """The one ``content`` of a table as a file, whose path is returned (crops and workbooks: small, and few)."""
    spark = rows.sparkSession
    path = f"{folder}/{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(rows.select("content").first()[0]))
    finally:
        out.close()
    return path


def workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet with texts."""
    sheet = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for i, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets><sheet name="kb" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="{links}/worksheet" Target="worksheets/first.xml"/></Relationships>')
        book.writestr("xl/worksheets/first.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
    return out.getvalue()
