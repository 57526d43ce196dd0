"""Text scalars as SQL expressions over a column name: normalising, fuzzy matching, section signals.

Expressions stay in the JVM. Matching a text against word lists is the dear part, so callers apply it to distinct texts.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab as V


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def words(items: list[str]) -> str:
    """A SQL array of strings."""
    return f"array({', '.join(quoted(i) for i in items)})"


def normalize_word(text: str) -> str:
    """The normal form of a literal; the same steps as ``normalize``."""
    out = unicodedata.normalize("NFKC", text).lower().replace("|", "l")
    out = out.translate({ord(c): " " for c in "·•●○"} | {ord(c): "-" for c in "–—"} | {ord("："): ":"})
    return " ".join(out.split())


def normalize(text: str) -> str:
    """Normal form of a text that is in NFKC already: lower case, OCR look-alikes, white space collapsed; null becomes empty."""
    return f"trim(regexp_replace(translate(lower(coalesce({text}, '')), '|·•●○–—：', 'l    --:'), '(?U)\\\\s+', ' '))"


def compose(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column in NFKC. Only rows beyond ASCII pass through Python; ASCII is in NFKC already."""

    @F.pandas_udf("string")
    def nfkc(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    beyond = F.coalesce(F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(False))
    return df.where(~beyond).unionByName(df.where(beyond).withColumn(column, nfkc(F.col(column))))


def contains_any(text: str, items: list[str]) -> str:
    return f"exists({words(items)}, w -> contains({text}, w))"


def count_contained(text: str, items: list[str]) -> str:
    return f"size(filter({words(items)}, w -> contains({text}, w)))"


def ratio(a: str, b: str) -> str:
    """100 less the edit distance in percent of the longer text."""
    return f"(CASE WHEN {a} = {b} THEN 100D WHEN {a} = '' OR {b} = '' THEN 0D ELSE 100D * (1D - levenshtein({a}, {b}) / cast(greatest(length({a}), length({b})) AS double)) END)"


def partial_ratio(a: str, b: str) -> str:
    """The best ratio of the shorter text and a stretch of the longer one, at steps of a quarter of its length."""
    ordered = f"CASE WHEN length({a}) <= length({b}) THEN struct({a} AS s, {b} AS l) ELSE struct({b} AS s, {a} AS l) END"
    window = ratio("p.s", "substring(p.l, i + 1, length(p.s))")
    slide = f"array_max(transform(sequence(0, length(p.l) - length(p.s), greatest(1, length(p.s) div 4)), i -> {window}))"
    value = f"CASE WHEN p.s = '' OR p.l = '' THEN 0D WHEN length(p.s) = length(p.l) THEN {ratio('p.s', 'p.l')} ELSE {slide} END"
    return f"element_at(transform(array({ordered}), p -> {value}), 1)"


def fuzzy(a: str, b: str) -> str:
    return f"greatest({ratio(a, b)}, {partial_ratio(a, b)})"


def pieces(word: str, least: float) -> list[str]:
    """Stretches of a word, one of which any text holds that has it with a partial ratio of ``least`` or more: so few edits spare one."""
    count = int((100 - least) / 100 * len(word) + 1e-9) + 1
    edges = [len(word) * i // count for i in range(count + 1)]
    return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def best_anchor(norm: str, anchors: list[str], least: float | None = None) -> str:
    """Struct ``score, anchor`` of the best match of a normalised text; the first of equals; anchor null if nothing scores.

    With ``least``, scores below it count as 0. Then only anchors that can reach it are measured: those of about the text's length
    or more, and those a piece of which it holds.
    """
    names = [n for n in (normalize_word(x) for x in anchors) if n]
    measured = f"CASE WHEN contains({norm}, x.a) OR contains(x.a, {norm}) THEN 100D ELSE {fuzzy(norm, 'x.a')} END"
    scored = f"x -> struct({measured} AS score, -x.i AS i, x.a AS anchor)"
    if least is None:
        items = "array(" + ", ".join(f"struct({quoted(n)} AS a, {i} AS i)" for i, n in enumerate(names)) + ")"
        floor = "y.score > 0"
    else:
        items = "array(" + ", ".join(f"struct({quoted(n)} AS a, {i} AS i, {words(pieces(n, least))} AS p)" for i, n in enumerate(names)) + ")"
        items = f"filter({items}, x -> length({norm}) * {least} <= length(x.a) * 100 OR exists(x.p, q -> contains({norm}, q)))"
        floor = f"y.score >= {least}"
    best = f"array_max(transform({items}, {scored}))"
    score = "y.score" if least is None else f"CASE WHEN {floor} THEN y.score ELSE 0D END"
    told = f"element_at(transform(array({best}), y -> struct({score} AS score, CASE WHEN {floor} THEN y.anchor END AS anchor)), 1)"
    return f"CASE WHEN {norm} = '' THEN struct(0D AS score, cast(null AS string) AS anchor) ELSE {told} END"


def regex(pattern: str) -> str:
    """A case-insensitive pattern with Unicode classes, as a SQL string."""
    return quoted("(?iU)" + pattern)


def nutrition_row(norm: str) -> str:
    """Struct ``hits, number_unit, strong`` of a normalised line.

    Strong: a nutrient word with a number and unit that begins within 15 characters after it (unit matches are marked first, so
    none can begin inside a number), or a short line without one that a nutrient word leads.
    """
    hits = f"filter({words(V.NUTRIENT_KEYWORDS)}, w -> contains({norm}, w))"
    unit = f"{norm} RLIKE {regex(V.NUMBER_UNIT)}"
    mark = "\x01"
    marked = f"regexp_replace({norm}, {regex(V.NUMBER_UNIT)}, {quoted(mark + '$0')})"
    near = " OR ".join(f"{marked} RLIKE {quoted(k + f'[^{mark}]' + '{0,15}' + mark)}" for k in V.NUTRIENT_KEYWORDS)
    lead = f"{norm} RLIKE {quoted(r'(?U)^[-\s:]*(' + '|'.join(V.NUTRIENT_KEYWORDS) + r')\b')}"
    return f"struct({hits} AS hits, {unit} AS number_unit, CASE WHEN size({hits}) = 0 THEN false WHEN {unit} THEN ({near}) ELSE length({norm}) <= 24 AND {lead} END AS strong)"


def section_boundary(norm: str, best: str | None = None) -> str:
    """Struct ``is_stop, stop, score, reason``: whether a line begins another section. ``best``: its best stop word, if known."""
    best = best or best_anchor(norm, V.SECTION_STOP_WORDS)
    allergen = contains_any(norm, V.ALLERGEN_CONTEXT_WORDS)
    reason = f"""CASE WHEN b.score < {V.STOP_CONTEXT_SCORE} OR b.anchor IS NULL THEN 'no_match'
      WHEN b.anchor = 'contains' THEN CASE WHEN {allergen} THEN 'contains_with_allergen_context' ELSE 'contains_without_allergen_context' END
      WHEN b.score >= {V.STOP_AUTO_SCORE} THEN 'high_confidence_stop'
      WHEN length({norm}) <= {V.STOP_HEADING_LENGTH} THEN 'contextual_stop_short_heading' ELSE 'contextual_stop_rejected_long_line' END"""
    told = f"element_at(transform(array({best}), b -> struct(b.score AS score, b.anchor AS anchor, {reason} AS reason)), 1)"
    stops = "'contains_with_allergen_context', 'high_confidence_stop', 'contextual_stop_short_heading'"
    return f"element_at(transform(array({told}), t -> struct(t.reason IN ({stops}) AS is_stop, CASE WHEN t.reason <> 'no_match' THEN t.anchor END AS stop, t.score AS score, t.reason AS reason)), 1)"


def ingredient_line(text: str, norm: str, vocabulary: list[str]) -> str:
    """Struct ``commas, vocabulary_hits, strong``."""
    commas = f"(length({text}) - length(replace({text}, ',', '')))"
    terms = [t.lower() for t in vocabulary if len(t) >= 4]
    hits = count_contained(norm, terms) if terms else "0"
    return f"struct({commas} AS commas, {hits} AS vocabulary_hits, ({commas} >= 2 OR {hits} >= 2) AS strong)"


def garbage_share(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 1D ELSE regexp_count({text}, {quoted('(?U)' + V.GARBAGE)}) / cast(length({text}) AS double) END"


def column(expression: str) -> Column:
    return F.expr(expression)
