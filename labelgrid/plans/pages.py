"""Synthetic label pages, one per row of ``part``: plain SQL that Spark and DuckDB read alike.

Four layouts by ``p_partkey % 4``: stacked, side by side, no headings, personal care. Boxes are jittered, and some texts are
misread, by integer arithmetic on the key. Only the input is shared between the two engines; what is computed from it is not.
"""

from __future__ import annotations

import json
from pathlib import Path

_INGREDIENTS = [
    "Ingredients: Wheat Flour (65%), Sugar,",
    "Palm Oil, Citric Acid (INS 330),",
    "Salt, Raising Agent (INS 500), Milk Solids",
    "Soya Lecithin; Natural Vanilla Flavour.",
]
_ROWS = [
    ("Nutrition Information", "Per 100g", "Per serving"),
    ("Energy", "450 kcal", "135 kcal"),
    ("Protein", "8 g", "2.4 g"),
    ("Total Fat", "18 g", "5.4 g"),
    ("Carbohydrate", "64 g", "19.2 g"),
    ("Sodium", "320 mg", "96 mg"),
]
_CARE = ["Shampoo, conditioner and serum for soft hair", "Key Ingredients: Aqua, Glycerin,", "Sodium Laureth Sulfate, Parfum"]
_TAIL = ["Storage: keep in a cool and dry place", "Manufactured by Good Foods Limited", "Contains: Wheat, Milk"]

#: knowledge base: domain, name, alternates
KB = [
    ("food", "Wheat Flour", "refined wheat flour; maida"), ("food", "Sugar", "cane sugar"), ("food", "Palm Oil", "palmolein / edible palm oil"),
    ("food", "Citric Acid", "ins 330; e330"), ("food", "Salt", "iodised salt"), ("food", "Milk Solids", "milk powder"),
    ("food", "Soya Lecithin", "lecithin | ins 322"), ("food", "Vanilla", "vanillin, natural vanilla"), ("food", "Raising Agent", "ins 500"),
    ("food", "Cocoa Solids", "cocoa"), ("personal_care", "Aqua", "water"), ("personal_care", "Glycerin", "glycerol"),
    ("personal_care", "Sodium Laureth Sulfate", "sles"), ("personal_care", "Parfum", "fragrance"),
]


def _template() -> list[tuple]:
    """(layout, seq, x, y, w, h, text) of every box."""
    out: list[tuple] = []

    def put(layout: int, x: int, y: int, w: int, h: int, text: str) -> None:
        out.append((layout, sum(1 for r in out if r[0] == layout), x, y, w, h, text))

    def table(layout: int, x: int, y: int, heading: bool = True) -> None:
        for i, cells in enumerate(_ROWS if heading else _ROWS[1:]):
            for cell, (dx, w) in zip(cells, ((0, 190), (250, 90), (400, 110)), strict=True):
                put(layout, x + dx, y + 28 * i, w, 20, cell)

    for layout in range(4):
        put(layout, 40, 12, 300, 24, "@name")
    for i, text in enumerate(_INGREDIENTS):
        put(0, 40, 70 + 26 * i, 420, 20, text)
    table(0, 40, 230)
    for i, text in enumerate(_TAIL):
        put(0, 40, 460 + 60 * i, 360, 20, text)
    for i, text in enumerate(_INGREDIENTS):
        put(1, 40, 70 + 26 * i, 400, 20, text)
    table(1, 520, 70)
    put(1, 40, 300, 360, 20, _TAIL[0])
    put(1, 520, 320, 360, 20, _TAIL[1])
    for i, text in enumerate(_INGREDIENTS):
        put(2, 40, 70 + 26 * i, 420, 20, text.replace("Ingredients: ", ""))
    table(2, 40, 260, heading=False)
    put(2, 40, 520, 360, 20, _TAIL[2])
    for i, text in enumerate(_CARE):
        put(3, 40, 70 + 30 * i, 380, 20, text)
    put(3, 40, 260, 300, 20, "Directions: massage and rinse")
    put(3, 40, 330, 200, 20, "MRP Rs. 120 @brand")
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_quoted(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in row) + ")" for row in rows)


_TEXT = """
  CASE WHEN tt = '@name' THEN concat(p_name, ' ', p_type)
       WHEN tt LIKE '%@brand' THEN replace(tt, '@brand', p_brand)
       WHEN p_partkey % 10 = 3 AND tt LIKE 'Ingredients%' THEN replace(tt, 'Ingredients', 'Ingred1ents')
       WHEN p_partkey % 10 = 7 AND tt LIKE '%Citric Acid%' THEN replace(tt, 'Citric Acid', 'Citric Acld')
       WHEN p_partkey % 10 = 9 AND tt = 'Nutrition Information' THEN 'Nutritlon lnformation'
       ELSE tt END"""

#: one row per box of a page
ITEMS = f"""
SELECT p_partkey AS image_id, seq, {_TEXT} AS text,
  CAST(50 + (p_partkey * 3 + seq * 7) % 50 AS DOUBLE) / 100 AS confidence,
  CAST(tx + (p_partkey * 7 + seq * 13) % 5 AS DOUBLE) AS x1, CAST(ty + (p_partkey * 11 + seq * 5) % 3 AS DOUBLE) AS y1,
  CAST(tx + (p_partkey * 7 + seq * 13) % 5 + tw + (p_partkey + seq) % 7 AS DOUBLE) AS x2,
  CAST(ty + (p_partkey * 11 + seq * 5) % 3 + th + (p_partkey * 5 + seq) % 3 AS DOUBLE) AS y2
FROM part JOIN (SELECT * FROM (VALUES {_values(_template())}) AS v(layout, seq, tx, ty, tw, th, tt)) AS template ON p_partkey % 4 = layout
"""

IMAGES = "SELECT p_partkey AS image_id, CAST(1080 + p_partkey % 40 AS INT) AS img_w, CAST(700 + p_partkey % 30 AS INT) AS img_h FROM part"

#: terms of the food vocabulary in order: names and alternates
TERMS = [
    (domain, i, name, term)
    for domain in ("food", "personal_care")
    for i, (name, term) in enumerate((n, t.strip()) for d, n, alt in KB if d == domain for t in [n, *[a for a in __import__("re").split(r"[;,/|]", alt) if a.strip()]])
]
VOCABULARY = [t for d, _, _, t in TERMS if d == "food"]
TERMS_SQL = f"SELECT * FROM (VALUES {_values(TERMS)}) AS k(domain, ord, canonical, searchable)"


def ground_truth() -> dict:
    """Boxes of ten labelled images, by image: ``ingredients`` and ``nutrition`` (None: the image has none)."""
    return json.loads(Path(__file__).with_name("ground_truth.json").read_text(encoding="utf-8"))
