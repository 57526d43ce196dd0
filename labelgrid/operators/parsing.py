"""Texts to ingredients and nutrients: phrase splitting, knowledge-base matching, nutrition tables and strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from labelgrid.functions import text as T
from labelgrid.functions import vocab as V
from labelgrid.storage import looked_up, stage, wide

from . import lines as L

# ingredients


def cleaned(text: str) -> str:
    """Normal form without the leading headings; each pattern is tried once, in order."""
    out = T.normalize(text)
    for heading in V.LEADING_HEADINGS:
        out = f"trim(regexp_replace({out}, {T.quoted('(?i)^' + heading + r'(?U:\s*)[:\-.]?')}, ''))"
    return out


def split_phrases(text: str) -> str:
    """Array of phrases of a text, cut at commas and semicolons outside parentheses: a fold over its characters."""
    start = "struct(0 AS depth, '' AS now, cast(array() AS array<string>) AS done)"
    depth = "CASE WHEN c = '(' THEN s.depth + 1 WHEN c = ')' THEN greatest(0, s.depth - 1) ELSE s.depth END"
    cut = f"c IN (',', ';') AND ({depth}) = 0"
    step = f"CASE WHEN {cut} THEN struct(({depth}) AS depth, '' AS now, concat(s.done, array(s.now)) AS done) ELSE struct(({depth}) AS depth, concat(s.now, c) AS now, s.done AS done) END"
    folded = f"aggregate(split({text}, ''), {start}, (s, c) -> {step}, s -> CASE WHEN s.now = '' THEN s.done ELSE concat(s.done, array(s.now)) END)"
    edge = r"[.*:\\-\\s]+"
    bare = f"trim(regexp_replace(trim(regexp_replace(trim(p), '(?U){edge}$', '')), '(?U)^{edge}', ''))"
    return f"filter(transform({folded}, p -> {bare}), p -> length(p) >= 2)"


def phrases(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per phrase: ``key``, ``pos``, ``phrase``."""
    clean = texts.select(key, F.expr(cleaned(text)).alias("clean"))
    return clean.select(key, F.posexplode(F.expr(f"CASE WHEN clean = '' THEN cast(array() AS array<string>) ELSE {split_phrases('clean')} END")).alias("pos", "phrase"))


def match_terms(tokens: DataFrame, terms: DataFrame, token: str = "phrase", least: float = V.KB_SCORE) -> DataFrame:
    """``tokens`` with ``matched_name`` and ``similarity`` against ``terms`` (``ord``, ``canonical``, ``searchable``).

    An equal term scores 100, the first one. Else containment either way scores 85 for terms of more than three characters: the
    last term longer than 85 % of the token if there is one, else the first term. Distinct tokens are matched once. Candidates are
    equi-joins: on the whole text, and on the first four characters of what is contained with the sequences of what contains it.
    Terms are staged as they come: the optimizer would work out a table of the driver's own there, anew for every place that reads it.
    """
    listed = stage(terms.select("ord", "canonical", "searchable")).select("ord", "canonical", F.lower("searchable").alias("s"))
    queries = tokens.select(F.col(token).alias("t0")).where(F.col("t0").isNotNull()).distinct().withColumn("q", F.lower(F.trim("t0")))
    queries = queries.where("q <> ''").select("t0", "q")
    grams = lambda c, n: F.expr(f"array_distinct(transform(sequence(1, length({c}) - {n} + 1), i -> substring({c}, i, {n})))")
    long = listed.where(F.length("s") > 3)
    # a term in a token: by the term's first four characters
    inside = queries.where(F.length("q") > 3).select("t0", "q", F.explode(grams("q", 4)).alias("g")).join(long.withColumn("g", F.substring("s", 1, 4)), "g").where(F.col("q").contains(F.col("s")))
    # a token in a term: by the token's first four characters, or all of a shorter one
    starts = queries.withColumn("g", F.substring("q", 1, 4))
    held = long.select("ord", "canonical", "s", F.explode(F.array_distinct(F.flatten(F.array(*[grams("s", n) for n in range(1, 5)])))).alias("g"))
    around = starts.join(held, "g").where(F.col("s").contains(F.col("q")))
    equal = queries.join(listed, F.col("q") == F.col("s"))
    columns = ["t0", "q", "s", "ord", "canonical"]
    pairs = equal.select(*columns).unionByName(inside.select(*columns)).unionByName(around.select(*columns))
    share = 100.0 * F.length("s") / F.greatest(F.length("q"), F.lit(1))
    best = pairs.groupBy("t0").agg(
        F.min(F.when(F.col("q") == F.col("s"), F.struct("ord", "canonical"))).alias("equal"),
        F.max(F.when(share > 85, F.struct("ord", "canonical"))).alias("long"),
        F.min(F.when(F.col("q") != F.col("s"), F.struct("ord", "canonical"))).alias("any_"),
    )
    score = F.when(F.col("equal").isNotNull(), 100.0).when(F.col("any_").isNotNull(), 85.0).otherwise(0.0)
    name = F.coalesce("equal.canonical", "long.canonical", "any_.canonical")
    told = looked_up(best.select("t0", F.when(score >= max(least, V.KB_FLOOR), name).alias("matched_name"), score.alias("similarity")))
    return tokens.join(told, tokens[token] == told["t0"], "left").drop("t0").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def correct(texts: DataFrame, terms: DataFrame | None, key: str, text: str) -> DataFrame:
    """Phrases with their normal form, the knowledge-base name and the confidence (null without a match)."""
    split = stage(phrases(texts, key, text)).withColumn("normalized_text", F.expr(T.normalize("phrase")))
    if terms is None:
        return split.withColumns({"matched_name": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return match_terms(split, terms).withColumn("confidence", F.when(F.col("matched_name").isNotNull(), F.col("similarity") / 100.0)).drop("similarity")


def ingredient_tokens(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Plain tokens: cut at every comma, semicolon and line break; codes, percentages and brackets removed; no repeats."""
    bare = f"regexp_replace(trim({text}), {T.quoted('(?iU)' + V.TOKEN_HEADING)}, '')"
    pieces = texts.select(key, F.posexplode(F.split(F.expr(bare), "[;,]|\n+")).alias("pos", "raw")).where(F.length(F.trim("raw")) > 0)
    coded = "\\([^)]*" + V.INS_CODE + "[^)]*\\)"
    token = "raw"
    for pattern in (coded, V.PERCENT_TOKEN, V.INS_CODE, r"[()\[\]]"):
        token = f"regexp_replace({token}, {T.quoted('(?iU)' + pattern)}, ' ')"
    token = f"lower(regexp_replace(trim(regexp_replace({token}, '(?U)\\\\s+', ' ')), '^[ .\\\\-]+|[ .\\\\-]+$', ''))"
    clean = pieces.select(key, "pos", F.expr(token).alias("token")).where("length(token) >= 2 AND NOT token RLIKE '^[0-9.\\\\s]+$'")
    stop = T.best_anchor("n0", V.SECTION_STOP_WORDS, V.TOKEN_STOP_SCORE)
    from .classify import on_texts

    kept = on_texts(clean, "token", {"stop": stop}).where(F.col("stop.score") < V.TOKEN_STOP_SCORE)
    first = kept.groupBy(key, "token").agg(F.min("pos").alias("at"))
    return first.select(key, (F.row_number().over(W.partitionBy(key).orderBy("at")) - 1).alias("pos"), "token")


# nutrients


def nutrient_key(lower_text: str) -> str:
    """The first nutrient that a lower-case text names, or null."""
    cases = " ".join(f"WHEN {lower_text} RLIKE {T.quoted('(?U)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')} THEN '{k}'" for k, ps in V.NUTRIENT_KEYS for p in ps)
    return f"CASE {cases} END"


def _value(text: str) -> str:
    return f"cast(nullif(regexp_extract({text}, {T.regex(V.VALUE_UNIT)}, 1), '') AS double)"


def _unit(text: str) -> str:
    return f"lower(nullif(regexp_extract({text}, {T.regex(V.VALUE_UNIT)}, 2), ''))"


def parse_strings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Nutrients of running text: ``nutrient``, ``value``, ``unit``; cut before every nutrient word, the first mention counts."""
    words = "(?i)(?=" + "|".join(V.NUTRIENT_KEYWORDS) + ")"
    parts = texts.where(F.length(F.trim(text)) > 0).select(key, F.posexplode(F.flatten(F.transform(F.split(text, "\n+"), lambda line: F.split(line, words)))).alias("pos", "part"))
    read = parts.where(F.length(F.trim("part")) > 0).select(key, "pos", F.expr(nutrient_key("lower(part)")).alias("nutrient"), F.expr(_value("part")).alias("value"), F.expr(_unit("part")).alias("unit"))
    named = read.where("nutrient IS NOT NULL AND value IS NOT NULL")
    first = named.groupBy(key, "nutrient").agg(F.min_by(F.struct("value", "unit"), "pos").alias("v"))
    return first.select(key, "nutrient", F.col("v.value").alias("value"), F.col("v.unit").alias("unit"))


def cells(lines: DataFrame) -> DataFrame:
    """Table cells of each page, one row per line: boxes not further apart than the limit. ``lines`` as from ``lines.reconstruct``."""
    rows = L.with_median(lines).withColumn("limit", F.greatest(F.lit(25.0), F.col("med") * 1.5))
    boxes = rows.select("image_id", "line_index", "limit", F.inline("items"))
    parts = L.assemble(L.gap_parts(boxes, ["image_id", "line_index"], F.col("limit")), ["image_id", "line_index", "part"])
    cell = F.struct("part", F.lower("text").alias("low"), ((F.col("x1") + F.col("x2")) / 2.0).alias("cx"), "text")
    by_line = parts.groupBy("image_id", "line_index").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    header = "exists(array({0}), h -> contains(line_text, h))".format(", ".join(T.quoted(h) for h in V.TABLE_HEADERS))
    told = by_line.withColumn("line_text", F.expr("array_join(transform(c, x -> x.low), ' ')"))
    return stage(told.select("image_id", "line_index", "c", F.expr(header).alias("is_header"), F.expr(nutrient_key("c[0].low")).alias("nutrient")))


def table_columns(rows: DataFrame) -> DataFrame:
    """``image_id``, ``x100``, ``xserving``: where the value columns stand, from headers or else the widest gap between values."""
    per100 = "filter(c, x -> contains(x.low, '100'))"
    serving = "filter(c, x -> NOT contains(x.low, '100') AND exists(array('serving', 'serve', 'pkg', 'pack'), w -> contains(x.low, w)))"
    heads = rows.where("is_header").select("image_id", F.expr(f"transform({per100}, x -> x.cx)").alias("a"), F.expr(f"transform({serving}, x -> x.cx)").alias("b"))
    mean = "aggregate({0}, 0D, (s, x) -> s + x) / nullif(size({0}), 0)"
    heads = heads.groupBy("image_id").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b")).select("image_id", F.expr(mean.format("a")).alias("h100"), F.expr(mean.format("b")).alias("hserving"))
    values = rows.where("NOT is_header AND nutrient IS NOT NULL AND size(c) > 1").select("image_id", F.explode(F.expr("transform(slice(c, 2, size(c)), x -> x.cx)")).alias("cx"))
    order = W.partitionBy("image_id").orderBy("cx")
    ranked = values.withColumn("r", F.row_number().over(order)).withColumn("gap", F.lead("cx").over(order) - F.col("cx"))
    widest = F.max_by("r", F.struct("gap", -F.col("r"))).over(W.partitionBy("image_id"))
    widths = F.max("gap").over(W.partitionBy("image_id"))
    split = ranked.withColumn("at", widest).withColumn("wide", widths).where("wide > 30").groupBy("image_id").agg(F.avg(F.when(F.col("r") <= F.col("at"), F.col("cx"))).alias("v100"), F.avg(F.when(F.col("r") > F.col("at"), F.col("cx"))).alias("vserving"))
    both = heads.join(wide(split), "image_id", "full")
    return both.select("image_id", F.coalesce("h100", F.when(F.col("h100").isNull() | F.col("hserving").isNull(), F.col("v100"))).alias("x100"), F.coalesce("hserving", F.when(F.col("h100").isNull() | F.col("hserving").isNull(), F.col("vserving"))).alias("xserving"))


def parse_tables(lines: DataFrame) -> DataFrame:
    """Nutrients of each page's table: ``nutrient``, ``per_100g`` and ``per_serving`` (value, unit), and the leading value.

    A value goes to the nearer column (per 100 g if equally near); without both columns the first value is per 100 g, the second
    per serving. The last row of a nutrient counts, rows without a value cell do not.
    """
    found = cells(lines)
    rows = found.where("NOT is_header AND nutrient IS NOT NULL AND size(c) >= 2").join(wide(table_columns(found)), "image_id", "left")
    values = rows.select("image_id", "line_index", "nutrient", "x100", "xserving", F.expr("size(c) > 2").alias("many"), F.expr("inline(slice(c, 2, size(c)))"))
    values = values.withColumns({"value": F.expr(_value("text")), "unit": F.expr(_unit("text"))}).where("value IS NOT NULL")
    near = "CASE WHEN x100 IS NOT NULL AND xserving IS NOT NULL THEN CASE WHEN abs(cx - xserving) < abs(cx - x100) THEN 'per_serving' ELSE 'per_100g' END WHEN many AND part = 2 THEN 'per_serving' ELSE 'per_100g' END"
    placed = values.withColumn("col", F.expr(near))
    cell = F.struct("value", "unit")
    by_row = placed.groupBy("image_id", "line_index", "nutrient").agg(
        F.max_by(F.when(F.col("col") == "per_100g", cell), F.when(F.col("col") == "per_100g", F.col("part"))).alias("per_100g"),
        F.max_by(F.when(F.col("col") == "per_serving", cell), F.when(F.col("col") == "per_serving", F.col("part"))).alias("per_serving"),
    )
    last = by_row.groupBy("image_id", "nutrient").agg(F.max_by(F.struct("per_100g", "per_serving"), "line_index").alias("r"))
    lead = F.coalesce("r.per_100g", "r.per_serving")
    return last.select("image_id", "nutrient", F.col("r.per_100g").alias("per_100g"), F.col("r.per_serving").alias("per_serving"), lead.getField("value").alias("value"), lead.getField("unit").alias("unit"))


def parse_nutrition(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Table mode, and string mode (``image_id``, ``text``) for pages where it finds nothing."""
    table = stage(parse_tables(lines))
    rest = texts.join(wide(table.select("image_id").distinct()), "image_id", "left_anti")
    cell = F.struct("value", "unit")
    told = parse_strings(rest, "image_id", "text").select("image_id", "nutrient", cell.alias("per_100g"), F.lit(None).cast("struct<value:double,unit:string>").alias("per_serving"), "value", "unit")
    return table.unionByName(told)
