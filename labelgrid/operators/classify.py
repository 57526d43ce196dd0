"""Line classes and block types from word lists, patterns and fuzzy headings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.storage import looked_up

SCORES = [f"s_{c}" for c in V.CLASSES]


def _clip3(expression: str) -> str:
    """Clipped to 0..1 and rounded half to even to three digits."""
    return f"bround(least(1D, greatest(0D, {expression})), 3)"


def head_expressions() -> dict[str, str]:
    """The best heading of each word list for a normal form ``n0``; scores that do not count are 0."""
    lists = {"ingredients": (V.ALL_INGREDIENT_ANCHORS, V.ANCHOR_SCORE), "nutrition": (V.NUTRITION_ANCHORS, V.ANCHOR_SCORE), "stop": (V.SECTION_STOP_WORDS, V.STOP_CONTEXT_SCORE), "other": (V.OTHER_HEADINGS, V.STOP_CONTEXT_SCORE)}
    lists |= {c: (words, V.STOP_CONTEXT_SCORE) for c, words in V.CLASS_WORDS.items()}
    return {f"h_{k}": T.best_anchor("n0", words, least) for k, (words, least) in lists.items()}


def score_expressions(vocabulary: list[str]) -> dict[str, str]:
    """The nine scores and the score of other headings, over ``t0`` (text), ``n0`` (normal form) and the best headings."""
    commas = "(length(t0) - length(replace(t0, ',', '')))"
    terms = [v.lower() for v in vocabulary if len(v) >= 4][:400]
    hits = T.count_contained("n0", terms) if terms else "0"
    nutrients = T.count_contained("n0", V.NUTRIENT_KEYWORDS)
    numbers = f"regexp_count(n0, {T.regex(V.NUMERIC)})"
    marketing = f"CASE WHEN {T.contains_any('n0', V.MARKETING_WORDS)} THEN 0.3D ELSE 0D END"
    out = {
        "s_ingredients": f"""0.85D * h_ingredients.score / 100D
          + CASE WHEN {commas} >= 2 THEN least(0.4D, 0.15D * {commas}) ELSE 0D END
          + CASE WHEN t0 RLIKE {T.regex(V.PARENTHESIS)} THEN 0.15D ELSE 0D END + CASE WHEN n0 RLIKE {T.regex(V.PERCENTAGE)} THEN 0.2D ELSE 0D END
          + CASE WHEN n0 RLIKE {T.regex(V.INS_NUMBER)} THEN 0.3D ELSE 0D END + least(0.35D, 0.1D * {hits})""",
        "s_nutrition": f"""0.9D * h_nutrition.score / 100D + least(0.45D, 0.15D * {nutrients})
          + CASE WHEN n0 RLIKE {T.regex(V.NUMBER_UNIT)} THEN 0.35D ELSE 0D END + CASE WHEN {T.contains_any('n0', V.SERVING_WORDS)} THEN 0.25D ELSE 0D END
          + CASE WHEN {numbers} >= 2 THEN least(0.2D, 0.08D * {numbers}) ELSE 0D END""",
    }
    for name, words in V.CLASS_WORDS.items():
        out[f"s_{name}"] = f"0.8D * h_{name}.score / 100D + CASE WHEN {T.contains_any('n0', words)} THEN 0.3D ELSE 0D END"
    out["s_other"] = marketing
    out["other_score"] = f"0.8D * h_other.score / 100D + {marketing}"
    return {k: _clip3(e) for k, e in out.items()}


def _best(columns: list[str]) -> str:
    """The first class with the highest score; other if all are 0."""
    top = f"greatest({', '.join(columns)})"
    cases = " ".join(f"WHEN {c} = {top} THEN '{c[2:]}'" for c in columns)
    return f"CASE WHEN {top} = 0 THEN 'other' {cases} END"


def on_texts(df: DataFrame, column: str, expressions: dict[str, str], first: dict[str, str] | None = None) -> DataFrame:
    """``df`` with expressions over a text column (``t0``) and its normal form (``n0``), each distinct text worked on once.

    ``first`` are columns that the expressions use. The exchanges by text keep the optimizer from working the normal form or those
    columns into every place that reads them, and the results are a stage table.
    """
    texts = df.select(F.coalesce(column, F.lit("")).alias("t0")).distinct().withColumn("n0", F.expr(T.normalize("t0"))).repartition("t0")
    if first:
        texts = texts.select("t0", "n0", *(F.expr(e).alias(k) for k, e in first.items())).repartition("t0")
    told = looked_up(texts.select("t0", "n0", *(F.expr(e).alias(k) for k, e in expressions.items())))
    return df.join(told, F.coalesce(df[column], F.lit("")) == told["t0"]).drop("t0").withColumnRenamed("n0", "norm_text")


def describe(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Lines with nine scores, ``other_score`` and ``predicted_class``, and their signals: nutrition words, section boundary, whether
    a vocabulary term is contained, the best ingredient and nutrition headings. One pass over the distinct texts."""
    terms = [v.lower() for v in vocabulary if len(v) >= 4]
    told = score_expressions(vocabulary) | {
        "row": T.nutrition_row("n0"),
        "bound": T.section_boundary("n0", "h_stop"),
        "has_term": T.contains_any("n0", terms) if terms else "false",
        "ing_anchor": "h_ingredients",
        "nut_anchor": "h_nutrition",
    }
    return on_texts(lines, "text", told, head_expressions()).withColumn("predicted_class", F.expr(_best(SCORES)))


def block_type(norm: str, text: str, vocabulary: list[str]) -> str:
    """The type of a block: the first rule that holds."""
    terms = [v.lower() for v in vocabulary if len(v) >= 4][:300]
    words = T.count_contained(norm, V.NUTRIENT_KEYWORDS)
    hits = T.count_contained(norm, terms) if terms else "0"
    commas = f"(length({text}) - length(replace({text}, ',', '')))"
    rules = [
        (f"({T.contains_any(norm, V.NUTRITION_ANCHORS)} AND {words} >= 1) OR ({words} >= 3 AND {norm} RLIKE {T.regex(V.NUMBER_UNIT)})", "NUTRITION_TABLE_BLOCK"),
        (f"{T.contains_any(norm, [a for a in V.ALL_INGREDIENT_ANCHORS if a != 'contains'])} OR {commas} >= 5 OR {hits} >= 5", "INGREDIENT_BLOCK"),
        (f"{T.contains_any(norm, V.BLOCK_ALLERGEN)} OR (contains({norm}, 'contains') AND {T.contains_any(norm, V.ALLERGEN_CONTEXT_WORDS)})", "ALLERGEN_BLOCK"),
        (T.contains_any(norm, V.BLOCK_STORAGE), "STORAGE_BLOCK"),
        (T.contains_any(norm, V.BLOCK_MANUFACTURER), "MANUFACTURER_BLOCK"),
        (T.contains_any(norm, V.BLOCK_INSTRUCTION), "INSTRUCTION_BLOCK"),
        (T.contains_any(norm, V.BLOCK_CONTACT), "CONTACT_BLOCK"),
        (T.contains_any(norm, V.BLOCK_MRP), "MRP_BLOCK"),
    ]
    return "CASE " + " ".join(f"WHEN {r} THEN '{t}'" for r, t in rules) + " ELSE 'OTHER_BLOCK' END"


def domain(items: DataFrame) -> DataFrame:
    """``image_id``, ``domain``: personal_care only where more of its words than of food words occur on the page."""
    page = items.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("seq", "norm_text"))).alias("w"))
    page = page.select("image_id", F.expr("lower(array_join(transform(w, x -> x.norm_text), ' '))").alias("all_text"))
    food, care = (T.count_contained("all_text", x) for x in (V.FOOD_SIGNALS, V.PERSONAL_CARE_SIGNALS))
    return page.select("image_id", F.expr(food).alias("food_hits"), F.expr(care).alias("care_hits")).withColumn("domain", F.when(F.col("care_hits") > F.col("food_hits"), "personal_care").otherwise("food"))
