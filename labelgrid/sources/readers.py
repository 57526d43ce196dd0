"""Readers. Malformed entries are dropped or become null; a missing knowledge base is reported, not raised."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import vocab as V

XLSX = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files (jpg, jpeg, png) of a folder, or one, as ``path``, ``length``, ``content``; decoding is left to ``read_boxes``.

    A file of another kind is an error.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if re.search(r"\.[A-Za-z]{3,5}$", name) and name.rsplit(".", 1)[1].lower() not in V.IMAGE_EXTENSIONS:
        raise ValueError(f"{path}: not one of {', '.join(V.IMAGE_EXTENSIONS)}")
    glob = "*.{" + ",".join(e for x in V.IMAGE_EXTENSIONS for e in (x, x.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def legacy_readings(pages: DataFrame, column: str = "result") -> DataFrame:
    """Boxes from the older shape: an array per page of (box, (text, confidence)), all JSON text.

    ``pages``: image_id and the JSON. A box has four points, or N points (their bounding rectangle), or four numbers.
    """
    entries = pages.select("image_id", F.posexplode(F.from_json(column, "array<string>")).alias("seq", "entry"))
    pair = entries.select("image_id", "seq", F.from_json("entry", "array<string>").alias("e")).where("size(e) >= 2")
    told = pair.select("image_id", "seq", F.expr("e[0]").alias("box"), F.from_json(F.expr("e[1]"), "array<string>").alias("t"))
    return _boxes(told.select("image_id", "seq", "box", F.expr("get(t, 0)").alias("text"), F.expr("CASE WHEN size(t) < 2 THEN '1.0' ELSE get(t, 1) END").alias("score")))


def dict_readings(pages: DataFrame, column: str = "result") -> DataFrame:
    """Boxes from the newer shape: ``rec_texts``, ``rec_scores`` (1.0 if missing) and ``rec_polys``, ``dt_polys`` or ``rec_boxes``."""
    schema = "struct<rec_texts:array<string>,rec_scores:array<string>,rec_polys:array<string>,dt_polys:array<string>,rec_boxes:array<string>>"
    page = pages.select("image_id", F.from_json(column, schema).alias("r")).select("image_id", "r.rec_texts", "r.rec_scores", F.coalesce("r.rec_polys", "r.dt_polys", "r.rec_boxes").alias("boxes"))
    shortest = "least(size(rec_texts), size(boxes), CASE WHEN rec_scores IS NULL THEN size(rec_texts) ELSE size(rec_scores) END)"
    some = page.where("rec_texts IS NOT NULL AND boxes IS NOT NULL").withColumn("n", F.expr(shortest)).where("n > 0")
    rows = some.select("image_id", "rec_texts", "rec_scores", "boxes", F.explode(F.expr("sequence(0, n - 1)")).alias("seq"))
    return _boxes(rows.select("image_id", "seq", F.expr("get(boxes, seq)").alias("box"), F.expr("get(rec_texts, seq)").alias("text"), F.expr("CASE WHEN rec_scores IS NULL THEN '1.0' ELSE get(rec_scores, seq) END").alias("score")))


def _boxes(rows: DataFrame) -> DataFrame:
    """Text boxes to rectangles; an unreadable confidence is 0, a malformed box drops its row."""
    points = F.from_json("box", "array<array<double>>")
    flat = F.from_json("box", "array<double>")
    read = rows.withColumns({"points": points, "flat": flat})
    good = "size(points) >= 2 AND forall(points, p -> size(p) = 2 AND p[0] IS NOT NULL AND p[1] IS NOT NULL)"
    corners = "array(array(flat[0], flat[1]), array(flat[2], flat[1]), array(flat[2], flat[3]), array(flat[0], flat[3]))"
    bounds = "transform(array(0), z -> array(array_min(transform(points, p -> p[0])), array_min(transform(points, p -> p[1])), array_max(transform(points, p -> p[0])), array_max(transform(points, p -> p[1]))))[0]"
    polygon = f"CASE WHEN {good} AND size(points) = 4 THEN points WHEN {good} THEN transform(array({bounds}), b -> array(array(b[0], b[1]), array(b[2], b[1]), array(b[2], b[3]), array(b[0], b[3])))[0] WHEN size(flat) = 4 AND forall(flat, x -> x IS NOT NULL) THEN {corners} END"
    out = read.withColumn("polygon", F.expr(polygon)).where("polygon IS NOT NULL")
    rect = [F.expr(f"{f}(transform(polygon, p -> p[{i}]))").alias(n) for n, f, i in (("x1", "array_min", 0), ("y1", "array_min", 1), ("x2", "array_max", 0), ("y2", "array_max", 1))]
    return out.select("image_id", "seq", "text", F.coalesce(F.expr("try_cast(score AS double)"), F.lit(0.0)).alias("confidence"), "polygon", *rect)


def discover_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """Which header names the item and which its alternates: an equal hint first, then one contained, else the first column."""

    def best(hints: list[str]) -> str | None:
        plain = [(c, str(c).strip().lower()) for c in columns]
        equal = [c for h in hints for c, low in plain if low == h]
        part = [c for h in hints for c, low in plain if h in low]
        return next(iter(equal + part), None)

    return best(V.KB_NAME_HINTS) or next(iter(columns), None), best(V.KB_ALTERNATE_HINTS)


def vocabulary(table: DataFrame, domain: str, place: list[Column] | None = None) -> DataFrame:
    """``domain``, ``ord``, ``canonical``, ``searchable``: a term for each name and each of its alternates, in order.

    ``place`` says where a row stands in its files; rows of one place keep their order. A knowledge base is small: one task numbers
    its terms.
    """
    name, alternate = discover_columns([c for c in table.columns if c != "_metadata"])
    if name is None:
        return table.sparkSession.createDataFrame([], "domain string, ord long, canonical string, searchable string")
    given = F.col(f"`{alternate}`").cast("string") if alternate else F.lit(None).cast("string")
    order = [c.alias(f"place{i}") for i, c in enumerate([*(place or []), F.monotonically_increasing_id()])]
    rows = table.select(F.trim(F.col(f"`{name}`").cast("string")).alias("canonical"), given.alias("given"), *order)
    kept = rows.where("canonical <> '' AND lower(canonical) <> 'nan'")
    others = F.when(F.lower("given") != "nan", F.split("given", "[;,/|]"))
    terms = F.concat(F.array("canonical"), F.filter(F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    flat = kept.select(*(f"place{i}" for i in range(len(order))), "canonical", F.posexplode(terms).alias("p", "searchable"))
    number = F.row_number().over(W.orderBy(*(f"place{i}" for i in range(len(order))), "p")) - 1
    return flat.select(F.lit(domain).alias("domain"), number.cast("long").alias("ord"), "canonical", "searchable")


def kb_csv(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame | None, str | None]:
    """The vocabulary of CSV files with a header, or None and the reason. Terms stand as in the files, however those are split."""
    try:
        return vocabulary(spark.read.csv(path, header=True), domain, [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]), None
    except AnalysisException as e:
        return None, str(e).splitlines()[0]


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The name of the first sheet's part."""
    parts = book.namelist()
    if "xl/workbook.xml" in parts and "xl/_rels/workbook.xml.rels" in parts:
        first = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{XLSX}sheet"), None)
        wanted = next((v for k, v in first.attrib.items() if k.endswith("}id")), None) if first is not None else None
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if link.get("Id") == wanted:
                target = link.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def kb_xlsx(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame | None, str | None]:
    """The vocabulary of the first sheet of a workbook (unpacked on the driver: a knowledge base is small), or None and the reason."""
    try:
        content = spark.read.format("binaryFile").load(path).select("content").first()
        with zipfile.ZipFile(io.BytesIO(content[0])) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                shared = ["".join(t.text or "" for t in si.iter(f"{XLSX}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{XLSX}si")]
            rows = []
            for row in ElementTree.fromstring(book.read(_first_sheet(book))).iter(f"{XLSX}row"):
                cells = {}
                for cell in row.iter(f"{XLSX}c"):
                    place = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed([x for x in cell.get("r", "A1") if x.isalpha()])))
                    value = cell.find(f"{XLSX}v")
                    inline = "".join(t.text or "" for t in cell.iter(f"{XLSX}t"))
                    cells[place] = shared[int(value.text)] if cell.get("t") == "s" else inline or (value.text if value is not None else None)
                rows.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
        header, width = rows[0], len(rows[0])
        schema = ", ".join(f"`{h or f'column{i}'}` string" for i, h in enumerate(header))
        return vocabulary(spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows[1:]], schema), domain), None
    except (AnalysisException, OSError, KeyError, IndexError, TypeError, ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


class KnowledgeBase:
    """The vocabularies of up to three files, each read when it is first asked for; what could not be read is in ``load_errors``,
    and counts as empty."""

    def __init__(self, spark: SparkSession, food_csv: str | None = None, nutrition_csv: str | None = None, personal_care_xlsx: str | None = None) -> None:
        self.spark = spark
        self.files = {"food": (kb_csv, food_csv), "nutrition": (kb_csv, nutrition_csv), "personal_care": (kb_xlsx, personal_care_xlsx)}
        self.load_errors: dict[str, str] = {}
        self._terms: dict[str, DataFrame] = {}

    def terms(self, domain: str = "food") -> DataFrame:
        """``domain``, ``ord``, ``canonical``, ``searchable``."""
        if domain not in self._terms:
            read, path = self.files[domain]
            found, why = read(self.spark, path, domain) if path else (None, "no file given")
            if found is None:
                self.load_errors[domain] = why or ""
                found = self.spark.createDataFrame([], "domain string, ord long, canonical string, searchable string")
            self._terms[domain] = found
        return self._terms[domain]

    def ingredient_names(self, domain: str = "food") -> list[str]:
        """Names and alternates in order, for expressions that look for them in texts."""
        return [r["searchable"] for r in self.terms(domain).orderBy("ord").collect()]


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``image``, ``ingredients``, ``nutrition`` from a JSON object keyed by image."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<ingredients:array<double>,nutrition:array<double>>>")
    return text.select(F.explode(entries).alias("image", "v")).select("image", "v.ingredients", "v.nutrition")


#: what a recogniser gives for an image's bytes: (text, confidence, polygon) of each box
Recogniser = Callable[[bytes], "list[tuple[str, float, list[list[float]]]]"]
BOXES = "path string, seq int, text string, confidence double, polygon array<array<double>>"


def read_boxes(rows: DataFrame, recognisers: list[Recogniser]) -> DataFrame:
    """The boxes of images (``path``, ``content``): of the first recogniser that does not fail on an image; none if all fail.

    The recognisers need an OCR library; they run on Arrow batches and are made anew in each Python worker that unpickles them.
    """
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.list_(pa.float64()))]
        for batch in batches:
            out: list[tuple[Any, ...]] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for recognise in recognisers:
                    try:
                        boxes = recognise(content)
                    except Exception:  # noqa: BLE001, S112 - whatever a recogniser raises, the next one is asked
                        continue
                    out += [(path, i, text, float(sure), polygon) for i, (text, sure, polygon) in enumerate(boxes)]
                    break
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "seq", "text", "confidence", "polygon"])

    return rows.select("path", "content").mapInArrow(read, BOXES)


def pixels(rows: DataFrame, decode, schema: str) -> DataFrame:  # noqa: ANN001
    """Images through a function over Arrow batches (decoding, enhancing): where a codec is needed."""
    return rows.mapInArrow(decode, schema)
