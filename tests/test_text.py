"""Text scalars against small Python specifications, and the worked examples."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelgrid.functions import text as T
from labelgrid.functions import vocab as V


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def ratio(a, b):
    return 100.0 if a == b else 0.0 if not a or not b else 100.0 * (1.0 - distance(a, b) / max(len(a), len(b)))


def partial(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if len(short) == len(long):
        return ratio(a, b)
    return max(ratio(short, long[i : i + len(short)]) for i in range(0, len(long) - len(short) + 1, max(1, len(short) // 4)))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text("abcé ,", max_size=9), st.text("abcé ,", max_size=14)), min_size=60, max_size=60))
def test_ratios(spark, pairs):
    df = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>").select("i", "p.a", "p.b")
    got = df.select("i", F.expr(T.ratio("a", "b")).alias("r"), F.expr(T.partial_ratio("a", "b")).alias("p")).orderBy("i").collect()
    assert [r["r"] for r in got] == [ratio(a, b) for a, b in pairs]
    assert [r["p"] for r in got] == [partial(a, b) for a, b in pairs]


def test_normalize(spark):
    texts = ["  A|B — c\t\n d：e • f", None, "", "ﬁne ½ Ⅳ µg", "X Y"]
    df = T.compose(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    got = [r["n"] for r in df.select("i", F.expr(T.normalize("t")).alias("n")).orderBy("i").collect()]
    assert got == [T.normalize_word(t or "") for t in texts]
    assert unicodedata.normalize("NFKC", "µg") not in V.NUMBER_UNIT


def test_worked_examples(spark):
    cases = {
        "Protein 8 g": (True, False, "no_match"), "100% WHEAT": (False, False, "no_match"), "- Sodium": (True, False, "no_match"),
        "Contains: Wheat, Milk": (False, True, "contains_with_allergen_context"), "Contains added flavour": (False, False, "contains_without_allergen_context"),
        "the nutrition of this rather long line of plain text": (False, True, "high_confidence_stop"),
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string").withColumn("n", F.expr(T.normalize("t")))
    for r in df.select("t", F.expr(T.nutrition_row("n")).alias("r"), F.expr(T.section_boundary("n")).alias("b")).collect():
        assert (r["r"]["strong"], r["b"]["is_stop"], r["b"]["reason"]) == cases[r["t"]], r
    best = spark.createDataFrame([("ingred1ents",), ("in",), ("",)], "n string").select(F.expr(T.best_anchor("n", V.ALL_INGREDIENT_ANCHORS)).alias("b")).collect()
    assert best[0]["b"]["anchor"] == "ingredients" and best[0]["b"]["score"] > 78
    assert (best[1]["b"]["score"], best[1]["b"]["anchor"]) == (100.0, "ingredients")
    assert (best[2]["b"]["score"], best[2]["b"]["anchor"]) == (0.0, None)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text("energy 0123.g%k salt", max_size=30), min_size=150, max_size=150))
def test_strong_rows(spark, texts):
    texts = sorted({" ".join(t.split()) for t in texts})
    unit = re.compile(V.NUMBER_UNIT, re.IGNORECASE)

    def strong(n):
        hits = [k for k in V.NUTRIENT_KEYWORDS if k in n]
        if hits and unit.search(n):
            return any(0 <= u.start() - k.end() <= 15 for h in hits for k in re.finditer(h, n) for u in unit.finditer(n))
        return bool(hits) and len(n) <= 24 and any(re.match(rf"^[-\s:]*{h}\b", n) for h in hits)

    df = spark.createDataFrame([(t,) for t in texts], "n string")
    for r in df.select("n", F.expr(T.nutrition_row("n")).alias("r")).collect():
        assert r["r"]["strong"] == strong(r["n"]), r["n"]
