"""The layout queries in DuckDB SQL, written on their own: joins, recursive closures and windows instead of the folds used here.

Only the synthetic input (``pages``) and the word lists are shared.
"""

from __future__ import annotations

from labelgrid.functions import vocab as V

from . import pages as P

SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _any(t: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(w)})" for w in words) + ")"


def _count(t: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({t}, {_q(w)})::INT" for w in words) + ")"


def _norm(t: str) -> str:
    return f"trim(regexp_replace(replace(lower({t}), '|', 'l'), '\\s+', ' ', 'g'))"


def _milli(x: str, unit: int = 1000) -> str:
    return f"round(({x}) * {unit})::BIGINT"


ITEMS = f"items AS ({P.ITEMS}), images AS ({P.IMAGES})"
H_DIST = "greatest(b.x1 - a.x2, a.x1 - b.x2, 0)"
V_DIST = "greatest(b.y1 - a.y2, a.y1 - b.y2, 0)"
V_OVER = "(CASE WHEN least(a.y2 - a.y1, b.y2 - b.y1) <= 0 THEN 0 ELSE greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least(a.y2 - a.y1, b.y2 - b.y1) END)"
H_OVER = "(CASE WHEN least(a.x2 - a.x1, b.x2 - b.x1) <= 0 THEN 0 ELSE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1) END)"
CENTERS = "sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2)"


def _closure(name: str, nodes: str, keys: list[str], node: str, near: str) -> str:
    """``name``: ``nodes`` with ``root``, the least ``node`` that is reachable over pairs for which ``near`` holds."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cols = ", ".join(f"a.{k}" for k in keys)
    plain = ", ".join(keys)
    joined = " AND ".join(f"r.{k} = e.{k}" for k in keys)
    back = " AND ".join(f"n.{k} = c.{k}" for k in keys)
    return f"""{name}_links AS (SELECT {cols}, a.{node} AS u, b.{node} AS v FROM {nodes} a JOIN {nodes} b ON {same} AND a.{node} <> b.{node} WHERE {near}),
{name}_reach AS (SELECT {plain}, {node} AS u, {node} AS v FROM {nodes} UNION SELECT {', '.join('r.' + k for k in keys)}, r.u, e.v FROM {name}_reach r JOIN {name}_links e ON {joined} AND r.v = e.u),
{name} AS (SELECT n.*, c.root FROM {nodes} n JOIN (SELECT {plain}, u, min(v) AS root FROM {name}_reach GROUP BY ALL) c ON {back} AND n.{node} = c.u)"""


SQL["o15_o16_rect_measures"] = f"WITH {ITEMS} SELECT image_id, seq, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS width, y2 - y1 AS height FROM items"
SQL["o17_o19_pair_distances"] = f"WITH {ITEMS} SELECT a.image_id, a.seq, {V_DIST} AS v_dist, {H_DIST} AS h_dist, {_milli(V_OVER)} AS v_overlap, {_milli(H_OVER)} AS h_overlap, {_milli(CENTERS)} AS centers FROM items a JOIN items b ON a.image_id = b.image_id AND b.seq = a.seq + 1"
_IOU = "CASE WHEN shared > 0 AND area_a + area_b - shared > 0 THEN shared / (area_a + area_b - shared) ELSE 0 END"
SQL["o20_o21_iou"] = f"""WITH {ITEMS},
p AS (SELECT a.image_id, a.seq, a.image_id % 5 <> 0 AS ha, a.image_id % 10 <> 0 AS hb, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 - 30 AS v1, b.x2 AS u2, b.y2 - 30 AS v2 FROM items a JOIN items b ON a.image_id = b.image_id AND b.seq = a.seq + 1),
s AS (SELECT *, CASE WHEN ha THEN (x2 - x1) * (y2 - y1) ELSE 0 END AS area_a, CASE WHEN hb THEN (u2 - u1) * (v2 - v1) ELSE 0 END AS area_b,
  CASE WHEN ha AND hb AND least(x2, u2) > greatest(x1, u1) AND least(y2, v2) > greatest(y1, v1) THEN (least(x2, u2) - greatest(x1, u1)) * (least(y2, v2) - greatest(y1, v1)) ELSE 0 END AS shared FROM p)
SELECT image_id, seq, area_a, shared, {_milli(_IOU, 10**6)} AS iou, {_milli('CASE WHEN NOT ha AND NOT hb THEN 1 ELSE ' + _IOU + ' END', 10**6)} AS evaluation_iou FROM s"""


def _clipped(prefix: str, x1: str, y1: str, x2: str, y2: str, test: str = "") -> str:
    a, b = f"greatest(0, least({x1}, img_w - 1))", f"greatest(0, least({y1}, img_h - 1))"
    c, d = f"greatest(0, least({x2}, img_w))", f"greatest(0, least({y2}, img_h))"
    c, d = f"CASE WHEN {c} <= {a} THEN least(img_w, {a} + 1) ELSE {c} END", f"CASE WHEN {d} <= {b} THEN least(img_h, {b} + 1) ELSE {d} END"
    good = f"(({c}) - {a} >= {test} AND ({d}) - {b} >= {test})" if test else "true"
    return ", ".join(f"CASE WHEN {good} THEN ({v})::DOUBLE END AS {prefix}_{n}" for v, n in ((a, "x1"), (b, "y1"), (c, "x2"), (d, "y2")))


_ROUNDED = [f"round_even({c}, 0)" for c in ("x1", "y1", "x2", "y2")]
_PX, _PY = "round_even(img_w * 0.015::DOUBLE, 0)", "round_even(img_h * 0.015::DOUBLE, 0)"
_WIDE = [f"x1 - {_PX}", f"y1 - {_PY}", f"x2 + {_PX}", f"y2 + {_PY}"]
SQL["o22_o25_clip_pad_crop"] = f"""WITH {ITEMS}, m AS (SELECT i.image_id, seq, x1 - 60.25::DOUBLE AS x1, y1 - 30.75::DOUBLE AS y1, x2 + 700.25::DOUBLE AS x2, y2 + 250.75::DOUBLE AS y2, img_w, img_h FROM items i JOIN images g ON i.image_id = g.image_id)
SELECT image_id, seq, {_clipped('clip', 'x1', 'y1', 'x2', 'y2')}, {_clipped('round', *_ROUNDED)}, {_clipped('valid', 'x1', 'y1', 'x2', 'y2', '700')}, {_clipped('margin', *_WIDE)}, {_clipped('pad', *[f'round_even({w}, 0)' for w in _WIDE])}, {_clipped('crop', *_ROUNDED, '2')} FROM m"""
SQL["o26_outside_text"] = f"WITH {ITEMS} SELECT image_id, seq, text FROM items WHERE NOT ((x1 + x2) / 2 BETWEEN 30 AND 480 AND (y1 + y2) / 2 BETWEEN 60 AND 180)"
SQL["o27_o29_enrich_normalize"] = f"WITH {ITEMS} SELECT image_id, seq, {_norm('CASE seq % 4 WHEN 0 THEN concat(chr(32), chr(32), text, ' + _q(' | x') + ') WHEN 1 THEN upper(text) WHEN 2 THEN replace(text, ' + _q(' ') + ', ' + _q('   ') + ') ELSE text END')} AS norm_text, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS width, y2 - y1 AS height FROM items"
SQL["o30_domain"] = f"WITH {ITEMS}, p AS (SELECT image_id, string_agg({_norm('text')}, ' ' ORDER BY seq) AS t FROM items GROUP BY image_id), h AS (SELECT image_id, {_count('t', V.FOOD_SIGNALS)} AS food_hits, {_count('t', V.PERSONAL_CARE_SIGNALS)} AS care_hits FROM p) SELECT image_id, food_hits, care_hits, CASE WHEN care_hits > food_hits THEN 'personal_care' ELSE 'food' END AS domain FROM h"

_MORE = ["protein 8 g", "100% wheat", "5%x", "- sodium", "energy value of this snack is far from the 450 kcal", "contains added flavour", "allergen awice", "nutrltion facts", "stor age"]
TEXTS = f"{ITEMS}, texts AS (SELECT DISTINCT {_norm('text')} AS n FROM items UNION SELECT unnest({_list(_MORE)}))"
_UNIT = r"\d+(\.\d+)?\s*(kcal|kj|mcg|µg|mg|ml|g|%)\b"
_HAS_UNIT = f"regexp_matches(n, {_q(_UNIT)})"
_MARKED = f"regexp_replace(n, {_q('(' + _UNIT + ')')}, chr(1) || '\\1', 'g')"
_NEAR = " OR ".join(f"regexp_matches({_MARKED}, '{k}[^' || chr(1) || ']{{0,15}}' || chr(1))" for k in V.NUTRIENT_KEYWORDS)
_LEAD = f"regexp_matches(n, {_q('^[-' + chr(92) + 's:]*(' + '|'.join(V.NUTRIENT_KEYWORDS) + ')' + chr(92) + 'b')})"
SQL["o31_nutrition_rows"] = f"WITH {TEXTS}, h AS (SELECT n, {_count('n', V.NUTRIENT_KEYWORDS)} AS hits, {_HAS_UNIT} AS number_unit FROM texts) SELECT n, hits::BIGINT AS hits, number_unit, CASE WHEN hits = 0 THEN false WHEN number_unit THEN ({_NEAR}) ELSE length(n) <= 24 AND {_LEAD} END AS strong FROM h"
_TERMS = [t.lower() for t in P.VOCABULARY if len(t) >= 4]
_COMMAS = "(length({0}) - length(replace({0}, ',', '')))"
SQL["o32_ingredient_lines"] = f"WITH {TEXTS}, h AS (SELECT n, {_COMMAS.format('n')} AS commas, {_count('n', _TERMS)} AS hits FROM texts) SELECT n, commas::BIGINT AS commas, hits::BIGINT AS vocabulary_hits, commas >= 2 OR hits >= 2 AS strong FROM h"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 100.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0 ELSE 100.0::DOUBLE * (1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))) END)"


def _matches(name: str, texts: str, anchors: list[str]) -> str:
    """``name``: for each text its best anchor and score, windows of the longer text as rows."""
    words = ", ".join(f"({i}, {_q(a)})" for i, a in enumerate(a for a in anchors if a.isascii()))
    return f"""{name}_pairs AS (SELECT n, i, a, CASE WHEN length(n) <= length(a) THEN n ELSE a END AS s, CASE WHEN length(n) <= length(a) THEN a ELSE n END AS l FROM {texts}, (VALUES {words}) AS w(i, a)),
{name}_wins AS (SELECT n, i, max({_ratio('s', 'substr(l, (k + 1)::BIGINT, length(s))')}) AS part FROM (SELECT *, unnest(range(0, length(l) - length(s) + 1, greatest(1, length(s) // 4))) AS k FROM {name}_pairs WHERE length(s) < length(l) AND s <> '') GROUP BY n, i),
{name}_scores AS (SELECT p.n, p.i, p.a, CASE WHEN contains(p.n, p.a) OR contains(p.a, p.n) THEN 100 ELSE greatest({_ratio('p.n', 'p.a')}, coalesce(w.part, 0)) END AS score FROM {name}_pairs p LEFT JOIN {name}_wins w ON p.n = w.n AND p.i = w.i),
{name} AS (SELECT n, max(score)::DOUBLE AS score, CASE WHEN max(score) > 0 THEN arg_min(a, (-score) * 1000 + i) END AS anchor FROM {name}_scores GROUP BY n)"""


def _best(name: str, texts: str, anchors: list[str]) -> str:
    """As ``_matches``, the first anchor among equals by rank."""
    body = _matches(name, texts, anchors).rsplit(f"{name} AS (", 1)[0]
    return body + f"{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, i) AS r FROM {name}_scores), {name} AS (SELECT n, score::DOUBLE AS score, CASE WHEN score > 0 THEN a END AS anchor FROM {name}_ranked WHERE r = 1)"


SQL["o36_o38_anchor_matches"] = f"""WITH {TEXTS}, {_best('ing', 'texts', V.ALL_INGREDIENT_ANCHORS)}, {_best('nut', 'texts', V.NUTRITION_ANCHORS)}, {_matches('one', 'texts', ['ingredients'])}
SELECT ing.n, ing.anchor AS ing_anchor, {_milli('ing.score')} AS ing_score, nut.anchor AS nut_anchor, {_milli('nut.score')} AS nut_score, {_milli(_ratio('ing.n', "'ingredients'"))} AS plain_ratio,
  {_milli('coalesce((SELECT part FROM one_wins w WHERE w.n = ing.n), ' + _ratio('ing.n', "'ingredients'") + ')')} AS partial FROM ing JOIN nut ON ing.n = nut.n"""
SQL["o33_section_boundaries"] = f"""WITH {TEXTS}, {_best('stop', 'texts', V.SECTION_STOP_WORDS)},
r AS (SELECT n, score, anchor, CASE WHEN score < 78 OR anchor IS NULL THEN 'no_match' WHEN anchor = 'contains' THEN CASE WHEN {_any('n', V.ALLERGEN_CONTEXT_WORDS)} THEN 'contains_with_allergen_context' ELSE 'contains_without_allergen_context' END
  WHEN score >= 92 THEN 'high_confidence_stop' WHEN length(n) <= 40 THEN 'contextual_stop_short_heading' ELSE 'contextual_stop_rejected_long_line' END AS reason FROM stop)
SELECT n, reason IN ('contains_with_allergen_context', 'high_confidence_stop', 'contextual_stop_short_heading') AS is_stop, CASE WHEN reason <> 'no_match' THEN anchor END AS stop, {_milli('score')} AS score, reason FROM r"""

_SAME_LINE = f"(abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= a.med * 0.45 OR {V_OVER} >= 0.35) AND abs((a.y2 - a.y1) - (b.y2 - b.y1)) / greatest(a.y2 - a.y1, b.y2 - b.y1, 1e-6) <= 0.3 AND {H_DIST} <= a.med * 4"
LINES = f"""{ITEMS}, sized AS (SELECT i.*, m.med FROM items i JOIN (SELECT image_id, median(y2 - y1) AS med FROM items WHERE y2 > y1 GROUP BY image_id) m ON i.image_id = m.image_id),
{_closure('joined', 'sized', ['image_id'], 'seq', _SAME_LINE)},
merged AS (SELECT image_id, root, string_agg(text, ' ' ORDER BY x1, seq) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS boxes, avg(confidence) AS mean_confidence FROM joined GROUP BY image_id, root),
banded AS (SELECT m.*, greatest(b.h * 0.5, 5) AS band FROM merged m JOIN (SELECT image_id, median(y2 - y1) AS h FROM merged GROUP BY image_id) b ON m.image_id = b.image_id),
lines AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round_even(y1 / band, 0), x1, root) - 1 AS line_index FROM banded)"""
SQL["o41_o58_lines"] = f"WITH RECURSIVE {LINES} SELECT image_id, line_index, text, x1, y1, x2, y2, boxes, {_milli('mean_confidence', 10**6)} AS mean_confidence, 4 * boxes AS corners FROM lines"
SPLIT = f"""{LINES}, limits AS (SELECT l.image_id, greatest(25, least(any_value(g.img_w) * 0.05, median(l.y2 - l.y1) FILTER (WHERE l.y2 > l.y1) * 1.2)) AS cut FROM lines l JOIN images g ON l.image_id = g.image_id GROUP BY l.image_id),
gaps AS (SELECT j.image_id, l.line_index, j.seq, j.text, j.confidence, j.x1, j.y1, j.x2, j.y2, coalesce(j.x1 - lag(j.x2) OVER w > c.cut, false)::INT AS wide FROM joined j JOIN lines l ON j.image_id = l.image_id AND j.root = l.root JOIN limits c ON j.image_id = c.image_id WINDOW w AS (PARTITION BY j.image_id, l.line_index ORDER BY j.x1, j.seq)),
parts AS (SELECT *, sum(wide) OVER (PARTITION BY image_id, line_index ORDER BY x1, seq) AS part, sum(wide) OVER (PARTITION BY image_id, line_index) AS cuts FROM gaps),
pieces AS (SELECT image_id, line_index, part, string_agg(text, ' ' ORDER BY x1, seq) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CASE WHEN any_value(cuts) > 0 THEN avg(confidence) END AS confidence FROM parts GROUP BY image_id, line_index, part),
cutlines AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY line_index, part) - 1 AS line_id FROM pieces)"""
SQL["o70_split_lines"] = f"WITH RECURSIVE {SPLIT} SELECT image_id, line_id, line_index, text, x1, y1, x2, y2, {_milli('confidence', 10**6)} AS confidence FROM cutlines"
COLUMNS = f"""{SPLIT}, white AS (SELECT l.image_id, any_value(g.img_w) * least(0.12, median(l.y2 - l.y1) * 0.8 / any_value(g.img_w)) AS gap FROM cutlines l JOIN images g ON l.image_id = g.image_id GROUP BY l.image_id),
begun AS (SELECT l.*, coalesce(l.x1 - max(l.x2) OVER (PARTITION BY l.image_id ORDER BY l.x1, l.line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > w.gap, false)::INT AS begins FROM cutlines l JOIN white w ON l.image_id = w.image_id),
islands AS (SELECT *, sum(begins) OVER (PARTITION BY image_id ORDER BY x1, line_id)::BIGINT AS column_id FROM begun),
bands AS (SELECT image_id, column_id, greatest(median(y2 - y1) * 0.6, 5) AS band, median(y2 - y1) AS med FROM islands GROUP BY ALL),
placed AS (SELECT i.*, b.med, row_number() OVER (PARTITION BY i.image_id, i.column_id ORDER BY round_even(i.y1 / b.band, 0), i.x1, i.line_id) - 1 AS place FROM islands i JOIN bands b ON i.image_id = b.image_id AND i.column_id = b.column_id)"""
SQL["o69_o73_columns"] = f"WITH RECURSIVE {COLUMNS} SELECT image_id, line_id, column_id, place FROM placed"
_UNIT_N = "regexp_matches(n, " + _q(_UNIT) + ")"
_TYPE = f"""CASE WHEN ({_any('n', V.NUTRITION_ANCHORS)} AND {_count('n', V.NUTRIENT_KEYWORDS)} >= 1) OR ({_count('n', V.NUTRIENT_KEYWORDS)} >= 3 AND {_UNIT_N}) THEN 'NUTRITION_TABLE_BLOCK'
 WHEN {_any('n', [a for a in V.ALL_INGREDIENT_ANCHORS if a != 'contains'])} OR {_COMMAS.format('text')} >= 5 OR {_count('n', _TERMS)} >= 5 THEN 'INGREDIENT_BLOCK'
 WHEN {_any('n', V.BLOCK_ALLERGEN)} OR (contains(n, 'contains') AND {_any('n', V.ALLERGEN_CONTEXT_WORDS)}) THEN 'ALLERGEN_BLOCK' WHEN {_any('n', V.BLOCK_STORAGE)} THEN 'STORAGE_BLOCK'
 WHEN {_any('n', V.BLOCK_MANUFACTURER)} THEN 'MANUFACTURER_BLOCK' WHEN {_any('n', V.BLOCK_INSTRUCTION)} THEN 'INSTRUCTION_BLOCK' WHEN {_any('n', V.BLOCK_CONTACT)} THEN 'CONTACT_BLOCK'
 WHEN {_any('n', V.BLOCK_MRP)} THEN 'MRP_BLOCK' ELSE 'OTHER_BLOCK' END"""
_BLOCK_NEAR = f"{V_DIST} <= a.med * 2.5 AND (abs(a.x1 - b.x1) <= a.med * 3 OR {H_OVER} >= 0.2)"
SQL["o42_o59_o35_blocks"] = f"""WITH RECURSIVE {COLUMNS}, {_closure('blocked', 'placed', ['image_id', 'column_id'], 'place', _BLOCK_NEAR)},
b AS (SELECT image_id, column_id, root, string_agg(text, ' ' ORDER BY y1, x1, place) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS lines FROM blocked GROUP BY ALL),
t AS (SELECT *, {_norm('text')} AS n FROM b)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY column_id, y1, x1, root) - 1 AS block_id, {_TYPE} AS type, text, x1, y1, x2, y2, lines FROM t"""
SQL["o44_grouped_boxes"] = f"""WITH RECURSIVE {ITEMS}, sized AS (SELECT i.*, least(m.med * 6, g.img_w * 0.05) AS gap FROM items i JOIN (SELECT image_id, median(y2 - y1) AS med FROM items WHERE y2 > y1 GROUP BY image_id) m ON i.image_id = m.image_id JOIN images g ON i.image_id = g.image_id),
{_closure('joined', 'sized', ['image_id'], 'seq', f'{V_OVER} >= 0.35 AND {H_DIST} <= a.gap')},
m AS (SELECT image_id, root, string_agg(text, ' ' ORDER BY x1, seq) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM joined GROUP BY ALL)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, root) - 1 AS line_index, text, x1, y1, x2, y2 FROM m"""
SQL["o45_near_clusters"] = f"""WITH RECURSIVE {ITEMS}, sized AS (SELECT i.*, greatest(m.med * 3, 15) AS far FROM items i JOIN (SELECT image_id, median(y2 - y1) AS med FROM items WHERE y2 > y1 GROUP BY image_id) m ON i.image_id = m.image_id),
{_closure('near', 'sized', ['image_id'], 'seq', f'{CENTERS} <= a.far')} SELECT image_id, count(*) AS boxes, min(seq) AS first_seq FROM near GROUP BY image_id, root"""


def _scored() -> str:
    """The ten scores of every distinct line text, as ``scored``."""
    lists = {"ingredients": V.ALL_INGREDIENT_ANCHORS, "nutrition": V.NUTRITION_ANCHORS, **V.CLASS_WORDS, "heading": V.OTHER_HEADINGS}
    parts = [_best(f"m_{k}", "texts", v) for k, v in lists.items()]
    got = lambda k, w: f"{w} * (CASE WHEN m_{k}.score >= 78 THEN m_{k}.score ELSE 0 END) / 100"
    numbers = r"len(regexp_extract_all(t.n, '\b\d+(?:\.\d+)?\b'))"
    commas = _COMMAS.format("t.n")
    clip = lambda e: f"least(1, greatest(0, {e}))"
    market = f"CASE WHEN {_any('t.n', V.MARKETING_WORDS)} THEN 0.3 ELSE 0 END"
    cols = {
        "ingredients": f"{got('ingredients', 0.85)} + CASE WHEN {commas} >= 2 THEN least(0.4, 0.15 * {commas}) ELSE 0 END + CASE WHEN regexp_matches(t.n, '\\(.*?\\)') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(t.n, '\\b\\d+(?:\\.\\d+)?\\s*(?:%|percent)\\b') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t.n, {_q(V.INS_NUMBER)}) THEN 0.3 ELSE 0 END + least(0.35, 0.1 * {_count('t.n', _TERMS)})",
        "nutrition": f"{got('nutrition', 0.9)} + least(0.45, 0.15 * {_count('t.n', V.NUTRIENT_KEYWORDS)}) + CASE WHEN regexp_matches(t.n, {_q(_UNIT)}) THEN 0.35 ELSE 0 END + CASE WHEN {_any('t.n', V.SERVING_WORDS)} THEN 0.25 ELSE 0 END + CASE WHEN {numbers} >= 2 THEN least(0.2, 0.08 * {numbers}) ELSE 0 END",
        **{k: f"{got(k, 0.8)} + CASE WHEN {_any('t.n', w)} THEN 0.3 ELSE 0 END" for k, w in V.CLASS_WORDS.items()},
        "other": market,
    }
    exprs = ", ".join(f"round(({clip(e)}) * 1000)::BIGINT AS s_{k}" for k, e in cols.items())
    joins = " ".join(f"JOIN m_{k} ON t.n = m_{k}.n" for k in lists)
    heading = f"round(({clip(got('heading', 0.8) + ' + ' + market)}) * 1000)::BIGINT AS other_score"
    return f"texts AS (SELECT DISTINCT {_norm('text')} AS n FROM cutlines), {', '.join(parts)}, scored AS (SELECT t.n, {exprs}, {heading} FROM texts t {joins})"


_S = [f"s_{c}" for c in V.CLASSES]
_TOP = f"greatest({', '.join(_S)})"
SQL["o34_line_classes"] = f"""WITH RECURSIVE {SPLIT}, {_scored()} SELECT image_id, line_id, text, {', '.join(_S)}, other_score, CASE WHEN {_TOP} = 0 THEN 'other' {' '.join(f"WHEN {s} = {_TOP} THEN '{s[2:]}'" for s in _S)} END AS predicted_class
FROM cutlines c JOIN scored s ON {_norm('c.text')} = s.n"""
SQL["o46_o78_anchors"] = f"""WITH RECURSIVE {SPLIT}, texts AS (SELECT DISTINCT {_norm('text')} AS n FROM cutlines), {_best('nut', 'texts', V.NUTRITION_ANCHORS)},
r AS (SELECT c.image_id, row_number() OVER (PARTITION BY c.image_id ORDER BY nut.score DESC, c.line_id) - 1 AS anchor_no, c.line_id, nut.anchor, {_milli('nut.score')} AS score FROM cutlines c JOIN nut ON {_norm('c.text')} = nut.n WHERE nut.score >= 78 AND length(nut.n) >= 2)
SELECT * FROM r WHERE anchor_no < 3"""
SQL["o48_o65_terms_per_page"] = f"""WITH RECURSIVE {SPLIT}, k AS (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w), h AS (SELECT c.image_id, c.line_id, k.w FROM cutlines c JOIN k ON contains({_norm('c.text')}, k.w))
SELECT image_id, string_agg(DISTINCT w, ',' ORDER BY w) AS terms, count(DISTINCT line_id) AS lines FROM h GROUP BY image_id"""
SQL["o53_o54_kb_matches"] = f"""WITH {ITEMS}, kb AS ({P.TERMS_SQL}), food AS (SELECT ord, canonical, lower(searchable) AS s FROM kb WHERE domain = 'food'),
tok AS (SELECT DISTINCT trim(p) AS q FROM (SELECT unnest(regexp_split_to_array(lower(text), '[,;:]')) AS p FROM items) WHERE trim(p) <> ''),
hit AS (SELECT q, ord, canonical, q = s AS same, 100.0 * length(s) / length(q) > 85 AS long FROM tok JOIN food ON q = s OR (length(s) > 3 AND (contains(q, s) OR contains(s, q)))),
best AS (SELECT q, arg_min(canonical, ord) FILTER (WHERE same) AS e, arg_max(canonical, ord) FILTER (WHERE long AND NOT same) AS l, arg_min(canonical, ord) FILTER (WHERE NOT same) AS f FROM hit GROUP BY q)
SELECT tok.q AS phrase, coalesce(e, l, f) AS matched_name, CASE WHEN e IS NOT NULL THEN 100000 WHEN f IS NOT NULL THEN 85000 ELSE 0 END::BIGINT AS similarity FROM tok LEFT JOIN best ON tok.q = best.q"""
SQL["o55_o56_union_median"] = f"WITH {ITEMS} SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, median(y2 - y1) AS median_height FROM items GROUP BY image_id"
SQL["o74_o76_orders"] = f"""WITH {ITEMS}, b AS (SELECT image_id, greatest(median(y2 - y1) * 0.6, 5) AS band FROM items GROUP BY image_id)
SELECT i.image_id, seq, row_number() OVER (PARTITION BY i.image_id ORDER BY round_even(y1 / band, 0), x1, seq) - 1 AS reading_place, row_number() OVER (PARTITION BY i.image_id ORDER BY y1, x1, seq) - 1 AS plain_place FROM items i JOIN b ON i.image_id = b.image_id"""
SQL["o91_nutrient_keys"] = f"WITH {TEXTS} SELECT n, CASE {' '.join(f'WHEN regexp_matches(n, {_q(chr(92) + chr(98) + chr(40) + chr(63) + chr(58) + p + chr(41) + chr(92) + chr(98))}) THEN {_q(k)}' for k, ps in V.NUTRIENT_KEYS for p in ps)} END AS nutrient FROM texts"

_READ = f"""{ITEMS}, variants AS (SELECT unnest(['original', 'clahe', 'sharpened', 'adaptive_threshold', 'denoised_clahe', 'sharpened_threshold']) AS variant),
readings AS (SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'ingredient' WHEN 1 THEN 'nutrition' ELSE 'other' END AS section, variant, seq,
  CASE WHEN variant = 'clahe' AND seq % 3 = 0 THEN replace(text, 'a', '#') WHEN variant = 'sharpened' AND seq % 5 = 0 THEN concat(text, ', salt 2 g') ELSE text END AS text,
  confidence + 0.00037::DOUBLE + CASE variant WHEN 'original' THEN (image_id % 3) / 8 WHEN 'clahe' THEN (image_id % 5) / 16 ELSE 0 END AS confidence FROM items, variants),
joined AS (SELECT image_id, section, variant, string_agg(text, ' ' ORDER BY seq) AS t, avg(confidence) AS confidence, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS numbered FROM readings GROUP BY ALL),
scores AS (SELECT image_id, section, variant, confidence, confidence * 2 - 1.5 * len(regexp_extract_all(t, '[^a-zA-Z0-9%.,:;()\\-\\s]'))::DOUBLE / length(t) + CASE section
  WHEN 'ingredient' THEN len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) * 0.05 + {_count('lower(t)', V.INGREDIENT_ANCHORS)} * 0.3 + least({_COMMAS.format('t')}, 10) * 0.05
  WHEN 'nutrition' THEN {_count('lower(t)', V.NUTRIENT_KEYWORDS)} * 0.35 + {_count('lower(t)', V.NUTRIENT_UNITS)} * 0.15 + least(len(regexp_extract_all(t, '\\d+(\\.\\d+)?')), 20) * 0.05 + numbered * 0.1
  ELSE len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) * 0.05 END AS score FROM joined)"""
SQL["o39_o40_reading_scores"] = f"WITH {_READ} SELECT image_id, section, variant, {_milli('score', 10**6)} AS score, {_milli('confidence', 10**6)} AS confidence FROM scores"
_TRIED = "CASE WHEN s.own >= 0.88 THEN ['original'] WHEN s.image_id % 7 = 0 THEN ['original', 'sharpened', 'sharpened_threshold'] WHEN s.image_id % 4 = 0 OR 30 + s.image_id % 40 < 45 THEN ['original', 'clahe', 'adaptive_threshold', 'denoised_clahe'] ELSE ['original', 'clahe', 'sharpened', 'adaptive_threshold'] END"
SQL["o79_best_readings"] = f"""WITH {_READ}, s AS (SELECT x.*, max(confidence) FILTER (WHERE variant = 'original') OVER (PARTITION BY image_id) AS own FROM scores x),
turns AS (SELECT s.*, list_position({_TRIED}, variant) AS turn FROM s), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, section ORDER BY score DESC, turn) AS r FROM turns WHERE turn > 0)
SELECT image_id, section, variant, {_milli('score', 10**6)} AS score FROM ranked WHERE r = 1"""
SQL["o104_full_page_readings"] = f"""WITH {_READ}, m AS (SELECT image_id, avg(confidence) FILTER (WHERE variant = 'original') AS own, avg(confidence) FILTER (WHERE variant = 'clahe') AS other, count(*) FILTER (WHERE variant = 'original') AS boxes FROM readings GROUP BY image_id)
SELECT image_id, CASE WHEN own < 0.82 AND (image_id % 4 = 0 OR 30 + image_id % 40 < 35) AND other > own THEN 'clahe' ELSE 'original' END AS variant, boxes FROM m"""

_TRUTH = ", ".join(f"({_q(k)}, {[float(x) for x in v['ingredients']]}, {'NULL' if v['nutrition'] is None else [float(x) for x in v['nutrition']]})" for k, v in P.ground_truth().items())


def _iou(f: str, t: str) -> str:
    w, h = f"greatest(0, least({f}[3], {t}[3]) - greatest({f}[1], {t}[1]))", f"greatest(0, least({f}[4], {t}[4]) - greatest({f}[2], {t}[2]))"
    areas = f"(({f}[3] - {f}[1]) * ({f}[4] - {f}[2]) + ({t}[3] - {t}[1]) * ({t}[4] - {t}[2]) - {w} * {h})"
    return f"CASE WHEN {f} IS NULL AND {t} IS NULL THEN 1 WHEN {f} IS NULL OR {t} IS NULL THEN 0 ELSE {w} * {h} / {areas} END"


_EVAL = f"""t AS (SELECT * FROM (VALUES {_TRUTH}) AS v(image, ti, tn)),
f AS (SELECT concat(image, '#', p_partkey) AS image, ti, tn, list_transform(ti, lambda x: x + p_partkey % 50) AS fi, CASE WHEN p_partkey % 4 <> 0 THEN list_transform(tn, lambda x: x - p_partkey % 30) END AS fn FROM part, t),
e AS (SELECT image, {_iou('fi', 'ti')} AS a, {_iou('fn', 'tn')} AS b FROM f)"""
SQL["o52_evaluation"] = f"WITH {_EVAL} SELECT image, {_milli('a', 10**6)} AS ingredients_iou, {_milli('b', 10**6)} AS nutrition_iou FROM e"
SQL["o66_evaluation_means"] = f"WITH {_EVAL} SELECT count(*) AS images, {_milli('avg(a)', 10**6)} AS ingredients_iou, {_milli('avg(b)', 10**6)} AS nutrition_iou, {_milli('(avg(a) + avg(b)) / 2', 10**6)} AS overall_iou FROM e"
SQL["o06_o07_readings"] = f"WITH {ITEMS} SELECT image_id, seq::BIGINT AS seq, text, CASE WHEN image_id % 2 = 1 THEN 1.0::DOUBLE WHEN seq = 2 THEN 0 ELSE confidence END AS confidence, x1, y1, x2, y2 FROM items WHERE image_id % 2 = 1 OR seq <> 3"
SQL["o13_detector_boxes"] = f"WITH {ITEMS}, d AS (SELECT image_id, (seq % 2)::VARCHAR AS class, seq AS ord, confidence - 0.3 AS conf FROM items WHERE confidence - 0.3::DOUBLE >= 0.35::DOUBLE), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class ORDER BY conf DESC, ord) AS r FROM d) SELECT image_id, class, ord, {_milli('conf')} AS conf FROM r WHERE r = 1"
SQL["o80_packets"] = f"WITH {ITEMS}, c AS (SELECT image_id, seq AS ord, (20 + (image_id * 3 + seq * 11) % 60) AS area, 10 * (8 + seq % 4) AS box FROM items), s AS (SELECT image_id, ord, area / 100 * 0.7::DOUBLE + area / box * 0.3::DOUBLE AS score FROM c WHERE area >= 15), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS r FROM s) SELECT image_id, ord, {_milli('score', 10**6)} AS score FROM r WHERE r = 1"
SQL["p1_working_sizes"] = """WITH p AS (SELECT p_partkey, (400 + p_partkey * 37 % 4000)::DOUBLE AS w, (300 + p_partkey * 53 % 4100)::DOUBLE AS h FROM part),
u AS (SELECT p_partkey, CASE WHEN h < 1000 THEN round_even(w * (1000 / h), 0) ELSE w END AS w, CASE WHEN h < 1000 THEN round_even(h * (1000 / h), 0) ELSE h END AS h FROM p)
SELECT p_partkey, CASE WHEN greatest(w, h) > 2800 THEN round_even(w * (2800 / greatest(w, h)), 0) ELSE w END::INT AS work_w, CASE WHEN greatest(w, h) > 2800 THEN round_even(h * (2800 / greatest(w, h)), 0) ELSE h END::INT AS work_h FROM u"""
SQL["o67_quality"] = f"""WITH px AS (SELECT p_partkey AS image_id, i // 8 AS y, i % 8 AS x, ((p_partkey * 7 + (i // 8) * 31 * (p_partkey % 3) + (i % 8) * 17) % 256)::INT AS v FROM part, (SELECT unnest(range(64)) AS i)),
l AS (SELECT a.image_id, a.v, a.y, a.x, u.v + d.v + le.v + r.v - 4 * a.v AS lap FROM px a JOIN px u ON u.image_id = a.image_id AND u.x = a.x AND u.y = abs(a.y - 1) JOIN px d ON d.image_id = a.image_id AND d.x = a.x AND d.y = 7 - abs(6 - a.y)
  JOIN px le ON le.image_id = a.image_id AND le.y = a.y AND le.x = abs(a.x - 1) JOIN px r ON r.image_id = a.image_id AND r.y = a.y AND r.x = 7 - abs(6 - a.x)),
b AS (SELECT image_id, stddev_pop(m) AS shadow FROM (SELECT image_id, avg(v) AS m FROM px GROUP BY image_id, y // 2, x // 2) GROUP BY image_id),
q AS (SELECT image_id, var_pop(lap) AS lv, avg(v) AS bm, stddev_pop(v) AS cs, avg((v > 250)::INT) AS gr FROM l GROUP BY image_id)
SELECT q.image_id, {_milli('lv')} AS laplacian_variance, {_milli('bm')} AS brightness_mean, {_milli('cs')} AS contrast_std, {_milli('gr')} AS glare_ratio, {_milli('shadow')} AS shadow_std, lv < 60 AS is_blurry, bm < 40 AS is_too_dark, bm > 235 AS is_too_bright FROM q JOIN b ON q.image_id = b.image_id"""
SQL["o68_p4_skew"] = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 21 - 10 END AS ha, (p_partkey % 9) / 8 AS hc, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 17 - 8 END AS ra, (p_partkey % 5) / 4 AS rc FROM part),
w AS (SELECT p_partkey, ha, ra, CASE WHEN ha IS NULL THEN 0 ELSE hc END AS a, CASE WHEN ra IS NULL THEN 0 ELSE rc * 0.6 END AS b FROM p),
o AS (SELECT p_partkey, (coalesce(ha, 0) * a + coalesce(ra, 0) * b) / CASE WHEN a + b = 0 THEN 1e-6 ELSE a + b END AS angle, least(1, a + b) AS c FROM w)
SELECT p_partkey, {_milli('angle', 10**6)} AS angle, {_milli('c', 10**6)} AS confidence, c >= 0.35 AND abs(angle) >= 0.5 AND abs(angle) <= 15 AS rotate FROM o"""
SQL["p5_corners"] = """WITH p AS (SELECT p_partkey, 10 + p_partkey % 13 AS ax, 12 + p_partkey % 7 AS ay, 200 + p_partkey % 5 AS bx, 11 + p_partkey % 17 AS by_, 205 - p_partkey % 3 AS cx, 150 + p_partkey % 11 AS cy, 8 + p_partkey % 4 AS dx, 155 AS dy FROM part)
SELECT p_partkey, ax::DOUBLE AS tl_x, by_::DOUBLE AS tr_y, cx::DOUBLE AS br_x, dy::DOUBLE AS bl_y, greatest(abs(ay - by_), abs(dy - cy), abs(ax - dx), abs(bx - cx)) >= 8 AS warp FROM p"""
SQL["o82_o85_sets"] = f"""WITH RECURSIVE {COLUMNS}, texts AS (SELECT DISTINCT {_norm('text')} AS n FROM cutlines), {_best('nut', 'texts', V.NUTRITION_ANCHORS)}, {_closure('blocked', 'placed', ['image_id', 'column_id'], 'place', _BLOCK_NEAR)},
b AS (SELECT image_id, string_agg(text, ' ' ORDER BY y1, x1, place) AS text FROM blocked GROUP BY image_id, column_id, root),
u AS (SELECT image_id, text, min(src) AS src FROM (SELECT image_id, text, 1 AS src FROM b UNION ALL SELECT image_id, text, 0 FROM cutlines) GROUP BY image_id, text)
SELECT image_id, text, src::BIGINT AS src FROM u WHERE NOT EXISTS (SELECT 1 FROM cutlines c JOIN nut ON {_norm('c.text')} = nut.n WHERE nut.score >= 78 AND c.image_id = u.image_id AND c.text = u.text)"""


def _layout() -> str:
    """Everything up to ``described``: placed lines with scores in thousandths, heading scores, words, units, terms."""
    return f"""{COLUMNS}, {_scored()},
heads AS (SELECT i.n, CASE WHEN i.score >= 78 THEN i.score ELSE 0 END AS ing_head, CASE WHEN u.score >= 78 THEN u.score ELSE 0 END AS nut_head FROM m_ingredients i JOIN m_nutrition u ON i.n = u.n),
meds AS (SELECT image_id, median(y2 - y1) AS page_med FROM cutlines WHERE y2 > y1 GROUP BY image_id),
described AS (SELECT p.*, s.* EXCLUDE (n), h.ing_head, h.nut_head, m.page_med, {_count('h.n', V.NUTRIENT_KEYWORDS)} > 0 AS has_word, regexp_matches(h.n, {_q(_UNIT)}) AS has_unit, {_any('h.n', _TERMS)} AS has_term, h.n
  FROM placed p JOIN heads h ON {_norm('p.text')} = h.n JOIN scored s ON s.n = h.n JOIN meds m ON m.image_id = p.image_id),
{_closure('blocked', 'described', ['image_id', 'column_id'], 'place', _BLOCK_NEAR)}"""


_CLUSTER_NEAR = f"{V_DIST} <= a.page_med * 2.6 AND (abs(a.x1 - b.x1) <= a.page_med * 3 OR {H_OVER} >= 0.25)"
_LONG = " UNION ALL ".join(f"SELECT image_id, column_id, place, x1, y1, x2, y2, page_med, '{c}' AS class, {i} AS rank FROM described WHERE s_{c} >= 200" for i, c in enumerate(V.CLUSTERED))
_OWN = "CASE f.class " + " ".join(f"WHEN '{c}' THEN f.s_{c}" for c in V.CLUSTERED) + " END"
CLUSTERS = f"""{_layout()}, long AS ({_LONG}), {_closure('linked', 'long', ['image_id', 'column_id', 'class'], 'place', _CLUSTER_NEAR)},
lowest AS (SELECT *, row_number() OVER (PARTITION BY image_id, column_id, class, root ORDER BY y1 DESC, x1 DESC, place DESC) AS r FROM linked),
spans AS (SELECT image_id, column_id, class, any_value(rank) AS rank, root, min(y1) AS top, max(y2) FILTER (WHERE r = 1) AS bottom FROM lowest GROUP BY image_id, column_id, class, root),
filled AS (SELECT s.class, s.rank, s.root, d.* FROM spans s JOIN described d ON d.image_id = s.image_id AND d.column_id = s.column_id AND (d.y1 + d.y2) / 2 BETWEEN s.top - 2 AND s.bottom + 2),
boxes AS (SELECT f.image_id, f.column_id, f.class, any_value(f.rank) AS rank, f.root, min(f.x1) AS x1, min(f.y1) AS y1, max(f.x2) AS x2, max(f.y2) AS y2, count(*) AS lines, avg({_OWN}) / 1000 AS semantic,
  greatest(0, 1 - stddev_pop(f.y2 - f.y1) / greatest(avg(f.y2 - f.y1), 1e-6)) AS coherence, any_value(f.page_med) AS page_med, avg(CASE WHEN f.has_term THEN 1.0::DOUBLE ELSE 0 END) AS term_share, avg(CASE WHEN f.has_word THEN 1.0::DOUBLE ELSE 0 END) AS word_share,
  avg(CASE WHEN f.has_unit THEN 1.0::DOUBLE ELSE 0 END) AS unit_share, avg(coalesce(f.confidence, 0)) AS ocr, sum((f.x2 - f.x1) * (f.y2 - f.y1)) AS filled_area,
  sum(CASE WHEN f.class = 'ingredients' THEN (CASE WHEN f.s_nutrition > 500 THEN 0.2 ELSE 0 END) + (CASE WHEN f.s_other > 600 THEN 0.1 ELSE 0 END) ELSE CASE WHEN f.s_ingredients > 500 THEN 0.2 ELSE 0 END END)::DOUBLE AS dirt
  FROM filled f GROUP BY f.image_id, f.column_id, f.class, f.root),
headed AS (SELECT b.image_id, b.column_id, b.class, b.root, max(CASE WHEN b.class = 'ingredients' THEN d.ing_head ELSE d.nut_head END) / 100 AS heading FROM boxes b JOIN described d ON d.image_id = b.image_id AND d.column_id = b.column_id
  WHERE (d.y1 < b.y1 AND b.y1 - d.y2 <= b.page_med * 2.6) OR EXISTS (SELECT 1 FROM filled f WHERE f.image_id = b.image_id AND f.column_id = b.column_id AND f.class = b.class AND f.root = b.root AND f.x1 = d.x1 AND f.y1 = d.y1 AND f.x2 = d.x2 AND f.y2 = d.y2) GROUP BY ALL),
clusters AS (SELECT b.*, coalesce(h.heading, 0) AS heading, row_number() OVER (PARTITION BY b.image_id ORDER BY b.column_id, b.rank, b.root) - 1 AS no FROM boxes b LEFT JOIN headed h USING (image_id, column_id, class, root))"""
SQL["o43_o60_clusters"] = f"WITH RECURSIVE {CLUSTERS} SELECT image_id, concat('cluster_', class, '_', no) AS cluster_id, class, x1, y1, x2, y2, lines, {_milli('semantic', 10**6)} AS semantic, {_milli('coherence', 10**6)} AS coherence, {_milli('heading', 10**6)} AS heading FROM clusters"
_SHARE = ", ".join(f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) AS {n}" for c, n in (("has_term", "term_share"), ("has_word", "word_share"), ("has_unit", "unit_share")))
BLOCKS = f"""tb AS (SELECT image_id, column_id, root, string_agg(text, ' ' ORDER BY y1, x1, place) AS text, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS lines, avg(s_ingredients) / 1000 AS ing, avg(s_nutrition) / 1000 AS nut, avg(coalesce(confidence, 0)) AS ocr, {_SHARE} FROM blocked GROUP BY image_id, column_id, root),
typed AS (SELECT *, {_TYPE} AS type FROM (SELECT *, {_norm('text')} AS n FROM tb))"""
SQL["o61_o77_candidates"] = f"""WITH RECURSIVE {CLUSTERS}, {BLOCKS},
words_of AS (SELECT z.image_id, z.column_id, z.class, z.root, count(DISTINCT k.w) AS terms FROM filled z JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(z.n, k.w) GROUP BY ALL),
block_words AS (SELECT z.image_id, z.column_id, z.root, count(DISTINCT k.w) AS terms FROM blocked z JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(z.n, k.w) GROUP BY ALL),
c AS (SELECT c.*, coalesce(w.terms, 0) AS terms, CASE WHEN heading = 0 THEN 'semantic_cluster' ELSE 'heading_supported_cluster' END AS method, least(1, filled_area / greatest(1, (x2 - x1) * (y2 - y1)) * 3) AS compact FROM clusters c LEFT JOIN words_of w USING (image_id, column_id, class, root)),
b AS (SELECT t.*, coalesce(w.terms, 0) AS terms FROM typed t LEFT JOIN block_words w USING (image_id, column_id, root)),
u AS (SELECT image_id, 'ingredients' AS type, method, 0.35 * semantic + 0.25 * term_share + 0.15 * heading + 0.15 * coherence + 0.10 * ocr - dirt AS s, x1, y1, x2, y2, lines, dirt FROM c WHERE class = 'ingredients' AND lines >= 2
UNION ALL SELECT image_id, 'nutrition', method, 0.35 * word_share + 0.20 * unit_share + 0.20 * (0.5 * coherence + 0.5 * compact) + 0.15 * heading + 0.10 * coherence - dirt, x1, y1, x2, y2, lines, dirt FROM c WHERE class = 'nutrition' AND lines >= 3 AND terms >= 2
UNION ALL SELECT image_id, 'ingredients', 'logical_block', 0.35 * ing + 0.25 * term_share + 0.03 + 0.12 + 0.10 * ocr, x1, y1, x2, y2, lines, 0 FROM b WHERE type = 'INGREDIENT_BLOCK' AND lines >= 2
UNION ALL SELECT image_id, 'nutrition', 'logical_block', 0.35 * word_share + 0.20 * unit_share + 0.16 + 0.03 + 0.08, x1, y1, x2, y2, lines, 0 FROM b WHERE type = 'NUTRITION_TABLE_BLOCK' AND lines >= 3 AND terms >= 2)
SELECT image_id, type, method, {_milli('s', 10**6)} AS score, x1, y1, x2, y2, lines, {_milli('dirt')} AS penalty FROM u"""
SQL["o97_block_fallbacks"] = f"""WITH RECURSIVE {_layout()}, {BLOCKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY column_id, y1, x1, root) AS id FROM typed),
s AS (SELECT *, 'table_geometry_fallback' AS method, round(least(0.7, 0.3 + 0.4 * nut) * 1000)::BIGINT AS confidence FROM numbered WHERE type = 'NUTRITION_TABLE_BLOCK' UNION ALL SELECT *, 'vocabulary_fallback', round(least(0.7, 0.3 + 0.4 * ing) * 1000)::BIGINT FROM numbered WHERE type = 'INGREDIENT_BLOCK'),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, method ORDER BY confidence DESC, id) AS r FROM s)
SELECT image_id, method, confidence, x1, y1, x2, y2, lines FROM r WHERE r = 1"""
SQL["o86_o88_phrases"] = f"""WITH RECURSIVE {SPLIT}, page AS (SELECT image_id, string_agg(text, ' ' ORDER BY line_id) AS t FROM cutlines GROUP BY image_id),
clean AS (SELECT image_id, {_norm('t')} AS t FROM page),
chars AS (SELECT image_id, i, substr(t, i, 1) AS c FROM (SELECT image_id, t, unnest(range(1, length(t) + 1)) AS i FROM clean)),
depth AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS d FROM chars),
piece AS (SELECT *, sum(CASE WHEN c IN (',', ';') AND d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS p FROM depth),
phrases AS (SELECT image_id, p, trim(regexp_replace(regexp_replace(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT (c IN (',', ';') AND d = 0)), '[.*:\\-\\s]+$', ''), '^[.*:\\-\\s]+', '')) AS phrase FROM piece GROUP BY image_id, p)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS pos, phrase FROM phrases WHERE length(phrase) >= 2"""

_KEY = " ".join(f"WHEN regexp_matches(lower(part), {_q(chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')}) THEN {_q(k)}" for k, ps in V.NUTRIENT_KEYS for p in ps)
_PAGE_PARTS = f"""{ITEMS}, page AS (SELECT image_id, string_agg(text, ' ' ORDER BY seq) AS t FROM items GROUP BY image_id),
spots AS (SELECT * FROM (SELECT image_id, t, unnest(range(1, length(t) + 1)) AS i FROM page) WHERE i = 1 OR {' OR '.join(f"lower(substr(t, i, {len(k)})) = {_q(k)}" for k in V.NUTRIENT_KEYWORDS)}),
parts AS (SELECT image_id, i, substr(t, i, (lead(i, 1, length(t) + 1) OVER (PARTITION BY image_id ORDER BY i) - i)::BIGINT) AS part FROM spots)"""
SQL["o93_nutrition_strings"] = f"""WITH {_PAGE_PARTS},
told AS (SELECT image_id, i, CASE {_KEY} END AS nutrient, regexp_extract(part, {_q(V.VALUE_UNIT)}, 1, 'i') AS v, lower(regexp_extract(part, {_q(V.VALUE_UNIT)}, 2, 'i')) AS unit FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, nutrient ORDER BY i) AS r FROM told WHERE nutrient IS NOT NULL AND v <> '')
SELECT image_id, nutrient, v::DOUBLE AS value, unit FROM ranked WHERE r = 1"""

# nutrition tables: cells, columns, rows; the pages here always give a table or a string result
_MARK = "regexp_matches(line_text, " + _q("|".join(V.TABLE_HEADERS)) + ")"
SQL["o71_o72_o92_nutrition_tables"] = f"""WITH RECURSIVE {LINES}, cut AS (SELECT image_id, greatest(25, median(y2 - y1) * 1.5) AS lim FROM lines GROUP BY image_id),
g AS (SELECT j.image_id, l.line_index, j.seq, j.text, j.x1, j.x2, coalesce(j.x1 - lag(j.x2) OVER (PARTITION BY j.image_id, l.line_index ORDER BY j.x1, j.seq) > c.lim, false)::INT AS wide FROM joined j JOIN lines l ON j.image_id = l.image_id AND j.root = l.root JOIN cut c ON c.image_id = j.image_id),
p AS (SELECT *, sum(wide) OVER (PARTITION BY image_id, line_index ORDER BY x1, seq) AS part_no FROM g),
cells AS (SELECT image_id, line_index, part_no, string_agg(text, ' ' ORDER BY x1, seq) AS part, (min(x1) + max(x2)) / 2 AS cx FROM p GROUP BY ALL),
rows_of AS (SELECT image_id, line_index, lower(string_agg(part, ' ' ORDER BY part_no)) AS line_text, count(*) AS n, max(CASE WHEN part_no = 0 THEN CASE {_KEY} END END) AS nutrient FROM cells GROUP BY ALL),
kind AS (SELECT *, {_MARK} AS is_header FROM rows_of),
head AS (SELECT c.image_id, avg(cx) FILTER (WHERE contains(lower(part), '100')) AS h100, avg(cx) FILTER (WHERE NOT contains(lower(part), '100') AND regexp_matches(lower(part), 'serving|serve|pkg|pack')) AS hs FROM cells c JOIN kind k USING (image_id, line_index) WHERE is_header GROUP BY c.image_id),
vals AS (SELECT c.*, k.nutrient, k.n FROM cells c JOIN kind k USING (image_id, line_index) WHERE NOT is_header AND nutrient IS NOT NULL AND part_no > 0),
steps AS (SELECT image_id, cx, row_number() OVER w AS r, lead(cx) OVER w - cx AS gap FROM vals WINDOW w AS (PARTITION BY image_id ORDER BY cx)),
widest AS (SELECT * FROM (SELECT image_id, r AS cut_at, gap, row_number() OVER (PARTITION BY image_id ORDER BY gap DESC NULLS LAST, r) AS k FROM steps) WHERE k = 1 AND gap > 30),
guess AS (SELECT s.image_id, avg(cx) FILTER (WHERE r <= cut_at) AS v100, avg(cx) FILTER (WHERE r > cut_at) AS vs FROM steps s JOIN widest USING (image_id) GROUP BY s.image_id),
cols AS (SELECT p.image_id, CASE WHEN h100 IS NULL THEN v100 ELSE h100 END AS x100, CASE WHEN hs IS NULL THEN vs ELSE hs END AS xs FROM (SELECT DISTINCT image_id FROM items) p LEFT JOIN head h USING (image_id) LEFT JOIN guess u USING (image_id)),
read AS (SELECT v.image_id, line_index, nutrient, part_no, try_cast(regexp_extract(part, {_q(V.VALUE_UNIT)}, 1, 'i') AS DOUBLE) AS v, lower(regexp_extract(part, {_q(V.VALUE_UNIT)}, 2, 'i')) AS u,
  CASE WHEN x100 IS NOT NULL AND xs IS NOT NULL THEN abs(cx - xs) < abs(cx - x100) ELSE n > 2 AND part_no = 2 END AS serving FROM vals v JOIN cols USING (image_id)),
good AS (SELECT * FROM read WHERE v IS NOT NULL), last_row AS (SELECT image_id, nutrient, max(line_index) AS line_index FROM good GROUP BY ALL),
own AS (SELECT g.*, row_number() OVER (PARTITION BY image_id, nutrient, serving ORDER BY part_no DESC) AS k FROM good g JOIN last_row USING (image_id, nutrient, line_index)),
tables AS (SELECT image_id, nutrient, max(v) FILTER (WHERE NOT serving) AS value_100g, max(u) FILTER (WHERE NOT serving) AS unit_100g, max(v) FILTER (WHERE serving) AS value_serving, max(u) FILTER (WHERE serving) AS unit_serving FROM own WHERE k = 1 GROUP BY ALL),
page AS (SELECT image_id, string_agg(text, ' ' ORDER BY seq) AS t FROM items GROUP BY image_id)
SELECT image_id, nutrient, value_100g, unit_100g, value_serving, coalesce(value_100g, value_serving) AS value, CASE WHEN value_100g IS NULL THEN unit_serving ELSE unit_100g END AS unit FROM tables"""


# expansions: a recursion that takes one line of a page at a time

_STRONG = f"CASE WHEN {_count('n', V.NUTRIENT_KEYWORDS)} = 0 THEN false WHEN {_HAS_UNIT} THEN ({_NEAR}) ELSE length(n) <= 24 AND {_LEAD} END"
_REASON = f"""CASE WHEN score < 78 OR anchor IS NULL THEN 'no_match' WHEN anchor = 'contains' THEN CASE WHEN {_any('n', V.ALLERGEN_CONTEXT_WORDS)} THEN 'contains_with_allergen_context' ELSE 'contains_without_allergen_context' END
  WHEN score >= 92 THEN 'high_confidence_stop' WHEN length(n) <= 40 THEN 'contextual_stop_short_heading' ELSE 'contextual_stop_rejected_long_line' END"""
FACTS = f"""{_layout()}, {_best('m_stop', 'texts', V.SECTION_STOP_WORDS)}, reasons AS (SELECT n, anchor, {_REASON} AS reason FROM m_stop),
strongs AS (SELECT n, {_STRONG} AS strong FROM texts),
facts AS (SELECT d.*, i.anchor AS ing_word, i.score AS ing_score, u.anchor AS nut_word, u.score AS nut_score, s.strong, r.reason IN ('contains_with_allergen_context', 'high_confidence_stop', 'contextual_stop_short_heading') AS is_stop,
  concat('stop_word:', r.anchor, '(', r.reason, ')') AS stop_text FROM described d JOIN m_ingredients i ON d.n = i.n JOIN m_nutrition u ON d.n = u.n JOIN strongs s ON d.n = s.n JOIN reasons r ON d.n = r.n)"""


def _seeds(word: str, score: str, weak: str) -> str:
    return f"""seeds AS (SELECT image_id, no, line_id AS seed_id, {word} AS anchor, {score} AS score, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2, page_med AS med FROM
  (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {weak}, {score} DESC, line_id) - 1 AS no FROM facts WHERE {score} >= 78 AND length(n) >= 2) WHERE no < 3)"""


def _walk(name: str, keep: str, gap: str, *, joins: str = "", direction: str = "", above: bool = False, rows: bool = False) -> str:
    """``name``: the state after each line; ``act`` says what became of it."""
    first = 1 if above else 0
    over = "(CASE WHEN least(z.br - z.bl, z.lx2 - z.lx1) <= 0 THEN 0 ELSE greatest(0, least(z.br, z.lx2) - greatest(z.bl, z.lx1)) / least(z.br - z.bl, z.lx2 - z.lx1) END)"
    act = f"""CASE WHEN taken + {first} >= 40 THEN 'max_lines_reached' {"WHEN ly1 < sy1 - med * 0.3 THEN 'skip'" if above else ''} WHEN greatest(ly1 - y2, y1 - ly2, 0) > {gap} THEN 'vertical_gap_exceeded'
    WHEN greatest(ly2, y2) - least(sy1, ly1) > med * 26 THEN 'max_block_height_exceeded' WHEN NOT (abs(lx1 - bl) <= med * 3 OR {over} >= 0.25) THEN 'skip' {"WHEN strong THEN 'nutrition_row_detected'" if rows else ''} WHEN is_stop THEN stop_text ELSE 'take' END"""
    grow = lambda f, a, b: f"CASE WHEN act = 'take' THEN {f}({a}, {b}) ELSE {a} END"
    return f"""{name}_others AS (SELECT s.image_id, s.no, f.line_id, f.x1 AS lx1, f.y1 AS ly1, f.x2 AS lx2, f.y2 AS ly2, f.strong, f.is_stop, f.stop_text FROM seeds s {joins} JOIN facts f ON f.image_id = s.image_id AND f.line_id <> s.seed_id WHERE {keep}),
{name}_bands AS (SELECT image_id, no, greatest(coalesce(median(ly2 - ly1) FILTER (WHERE ly2 > ly1), 20) * 0.6, 5) AS band FROM {name}_others GROUP BY ALL),
{name}_order AS (SELECT o.*, row_number() OVER (PARTITION BY o.image_id, o.no ORDER BY round_even(ly1 / band, 0) {direction}, lx1 {direction}, line_id {direction}) AS turn FROM {name}_others o JOIN {name}_bands b ON o.image_id = b.image_id AND o.no = b.no),
{name} AS (SELECT image_id, no, 0::BIGINT AS k, sx1 AS x1, sy1 AS y1, sx2 AS x2, sy2 AS y2, sx1 AS bl, sx2 AS br, 0::BIGINT AS taken, 'seed' AS act, seed_id AS line_id, sy1, med FROM seeds
  UNION ALL SELECT image_id, no, k + 1, {grow('least', 'x1', 'lx1')}, {grow('least', 'y1', 'ly1')}, {grow('greatest', 'x2', 'lx2')}, {grow('greatest', 'y2', 'ly2')}, {grow('least', 'bl', 'lx1')}, {grow('greatest', 'br', 'lx2')}, taken + CASE WHEN act = 'take' THEN 1 ELSE 0 END, act, l_id, sy1, med
  FROM (SELECT z.*, {act} AS act FROM (SELECT w.image_id, w.no, w.k, w.x1, w.y1, w.x2, w.y2, w.bl, w.br, w.taken, w.sy1, w.med, l.line_id AS l_id, l.lx1, l.ly1, l.lx2, l.ly2, l.strong, l.is_stop, l.stop_text
    FROM {name} w JOIN {name}_order l ON l.image_id = w.image_id AND l.no = w.no AND l.turn = w.k + 1 WHERE w.act IN ('seed', 'take', 'skip')) z) y),
{name}_lines AS (SELECT w.image_id, w.no, f.* EXCLUDE (image_id) FROM {name} w JOIN facts f ON f.image_id = w.image_id AND f.line_id = w.line_id WHERE w.act IN ('seed', 'take')),
{name}_end AS (SELECT image_id, no, arg_max(CASE WHEN act IN ('seed', 'take', 'skip') THEN 'exhausted_candidate_lines' ELSE act END, k) AS stop FROM {name} GROUP BY ALL),
{name}_sum AS (SELECT image_id, no, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS lines, avg(coalesce(confidence, 0)) AS ocr, avg(CASE WHEN has_term THEN 1.0::DOUBLE ELSE 0 END) AS term_share FROM {name}_lines GROUP BY ALL),
{name}_words AS (SELECT z.image_id, z.no, count(DISTINCT k.w) AS terms FROM {name}_lines z JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(z.n, k.w) GROUP BY ALL)"""


_COLUMN = """near_lines AS (SELECT s.image_id, s.no, s.seed_id, f.line_id, f.x1, f.x2, g.img_w * least(0.12, s.med * 0.8 / g.img_w) AS white FROM seeds s JOIN images g ON g.image_id = s.image_id JOIN facts f ON f.image_id = s.image_id AND f.y1 >= s.sy1 - s.med * 0.5 AND f.y1 <= s.sy1 + s.med * 6),
starts AS (SELECT *, coalesce(x1 - max(x2) OVER (PARTITION BY image_id, no ORDER BY x1, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > white, false)::INT AS s FROM near_lines),
numbered_columns AS (SELECT *, sum(s) OVER (PARTITION BY image_id, no ORDER BY x1, line_id) AS c FROM starts),
own_column AS (SELECT n.image_id, n.no, min(n.x1) AS lo, max(n.x2) AS hi FROM numbered_columns n JOIN numbered_columns o ON o.image_id = n.image_id AND o.no = n.no AND o.line_id = o.seed_id AND o.c = n.c GROUP BY ALL)"""
_ING_SCORE = "score / 100 * 0.4 + least(0.30, 0.04 * (lines - 1)) + least(0.15, term_share * 0.15) + CASE WHEN stop LIKE 'stop_word%' OR stop = 'nutrition_row_detected' THEN 0.12 ELSE 0.04 END + ocr * 0.10"
_NUT_SCORE = "score / 100 * 0.4 + least(0.3, 0.04 * (lines - 1)) + least(0.2, 0.03 * coalesce(terms, 0)) + CASE WHEN stop LIKE 'stop_word%' THEN 0.1 ELSE 0.03 END + ocr * 0.10"
_DONE = "SELECT s.image_id, s.no AS anchor_no, s.anchor, e.stop, m.x1, m.y1, m.x2, m.y2, round(greatest(0, least(0.98, {0})) * 1000)::BIGINT AS confidence, m.lines FROM seeds s JOIN {1}_end e USING (image_id, no) JOIN {1}_sum m USING (image_id, no) LEFT JOIN {1}_words w USING (image_id, no)"
SQL["o62_o94_ingredient_expansions"] = f"WITH RECURSIVE {FACTS}, {_seeds('ing_word', 'ing_score', chr(40) + 'ing_word = ' + _q('contains') + chr(41))}, {_COLUMN}, {_walk('walk', '(f.x1 + f.x2) / 2 BETWEEN oc.lo - 10 AND oc.hi + 10', 'med * 2.6', joins='JOIN own_column oc ON oc.image_id = s.image_id AND oc.no = s.no', above=True, rows=True)} {_DONE.format(_ING_SCORE, 'walk')}"
SQL["o63_o95_nutrition_expansions"] = f"WITH RECURSIVE {FACTS}, {_seeds('nut_word', 'nut_score', 'nut_score < 0')}, {_walk('walk', 'f.y1 >= s.sy1 - 1e-6', 'med * 2.6')} {_DONE.format(_NUT_SCORE, 'walk')}"

_MEAN_H, _STD_H, _MEAN_W = "avg(y2 - y1)", "stddev_pop(y2 - y1)", "avg(x2 - x1)"
_GEOMETRY = f"CASE WHEN count(*) < 2 THEN 0 ELSE 0.4 * greatest(0, 1 - least({_STD_H} / greatest({_MEAN_H}, 1e-6), 1)) + 0.3 * CASE WHEN {_MEAN_W} < 600 THEN 1 ELSE greatest(0, 1 - ({_MEAN_W} - 600) / 1000) END + 0.3 * least(1, sum((x2 - x1) * (y2 - y1)) / greatest(1, (max(x2) - min(x1)) * (max(y2) - min(y1))) * 3) END"
_HIT_SEEDS = f"""hit_lines AS (SELECT * EXCLUDE (n_hits) FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n_hits FROM facts WHERE has_word) WHERE n_hits >= 3),
hit_sized AS (SELECT h.image_id, h.line_id, h.x1, h.y1, h.x2, h.y2, h.n, h.page_med, greatest(m.m * 3, 15) AS far FROM hit_lines h JOIN (SELECT image_id, median(y2 - y1) AS m FROM hit_lines GROUP BY image_id) m ON m.image_id = h.image_id),
{_closure('hit_groups', 'hit_sized', ['image_id'], 'line_id', f'{CENTERS} <= a.far')},
hit_words AS (SELECT image_id, root, count(*) AS terms, string_agg(w, ',' ORDER BY w) AS words FROM (SELECT DISTINCT g.image_id, g.root, k.w FROM hit_groups g JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(g.n, k.w)) GROUP BY ALL),
hit_scores AS (SELECT g.image_id, g.root, any_value(w.terms) AS terms, any_value(w.words) AS words, greatest(median(y2 - y1) * 0.6, 5) AS band, 0.55 * least(1, any_value(w.terms) / 8) + 0.45 * ({_GEOMETRY}) AS score FROM hit_groups g JOIN hit_words w ON w.image_id = g.image_id AND w.root = g.root WHERE w.terms >= 3 GROUP BY g.image_id, g.root),
hit_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, root) AS r FROM hit_scores) WHERE r = 1 AND score > 0),
seeds AS (SELECT image_id, 0::BIGINT AS no, line_id AS seed_id, NULL::VARCHAR AS anchor, score, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2, page_med AS med, words FROM
  (SELECT g.*, b.score, b.words, row_number() OVER (PARTITION BY g.image_id ORDER BY round_even(g.y1 / b.band, 0), g.x1, g.line_id) AS r FROM hit_groups g JOIN hit_best b ON b.image_id = g.image_id AND b.root = g.root) WHERE r = 1)"""
SQL["o64_o96_nutrition_row_tables"] = f"""WITH RECURSIVE {FACTS}, {_HIT_SEEDS}, {_walk('down', 'f.y1 >= s.sy1 - 1e-6', 'med * 2.6')}, {_walk('up', 'f.y1 < s.sy1 - 1e-6', 'med * 2.0', direction='DESC')}
SELECT s.image_id, least(d.x1, u.x1) AS x1, least(d.y1, u.y1) AS y1, greatest(d.x2, u.x2) AS x2, greatest(d.y2, u.y2) AS y2, round_even(least(0.9, s.score) * 1000, 0)::BIGINT AS confidence, e.stop, s.words AS terms
FROM seeds s JOIN down_sum d ON d.image_id = s.image_id JOIN up_sum u ON u.image_id = s.image_id JOIN down_end e ON e.image_id = s.image_id"""

# regions: candidates, expansions and fallbacks ranked, then the tight box of the best


def _ranked_candidates(section: str) -> str:
    """``pool``: this section's candidates with final score and rank, and ``pool_lines``: their lines."""
    ing = section == "ingredients"
    share = "term_share" if ing else "word_share"
    own, kind, least = ("ing", "INGREDIENT_BLOCK", "lines >= 2") if ing else ("nut", "NUTRITION_TABLE_BLOCK", "lines >= 3 AND terms >= 2")
    raw = "0.35 * semantic + 0.25 * term_share + 0.15 * heading + 0.15 * coherence + 0.10 * ocr - dirt" if ing else "0.35 * word_share + 0.20 * unit_share + 0.20 * (0.5 * coherence + 0.5 * least(1, filled_area / greatest(1, (x2 - x1) * (y2 - y1)) * 3)) + 0.15 * heading + 0.10 * coherence - dirt"
    block = "0.35 * ing + 0.25 * term_share + 0.15 + 0.10 * ocr" if ing else "0.35 * word_share + 0.20 * unit_share + 0.27"
    del share, own
    return f"""{BLOCKS}, words_of AS (SELECT z.image_id, z.column_id, z.class, z.root, count(DISTINCT k.w) AS terms FROM filled z JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(z.n, k.w) GROUP BY ALL),
block_words AS (SELECT z.image_id, z.column_id, z.root, count(DISTINCT k.w) AS terms FROM blocked z JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(z.n, k.w) GROUP BY ALL),
block_ids AS (SELECT t.*, coalesce(w.terms, 0) AS terms, row_number() OVER (PARTITION BY image_id ORDER BY column_id, y1, x1, root) - 1 AS id FROM typed t LEFT JOIN block_words w USING (image_id, column_id, root)),
both_kinds AS (SELECT image_id, column_id, root, true AS clustered, heading, CASE WHEN heading = 0 THEN 'semantic_cluster' ELSE 'heading_supported_cluster' END AS method, no AS ord, x1, y1, x2, y2, {raw} AS s FROM (SELECT c.*, coalesce(w.terms, 0) AS terms FROM clusters c LEFT JOIN words_of w USING (image_id, column_id, class, root)) WHERE class = '{section}' AND {least}
  UNION ALL SELECT image_id, column_id, root, false, 0.2, 'logical_block', id + 1000000, x1, y1, x2, y2, {block} FROM block_ids WHERE type = '{kind}' AND {least}),
pool AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY final DESC, ord) - 1 AS place FROM (SELECT *, round_even(greatest(0, least(1, s)) * 1000, 0)::BIGINT AS final FROM both_kinds)),
pool_lines AS (SELECT p.ord, f.image_id, f.line_id, f.x1, f.y1, f.x2, f.y2, f.text, f.place, f.n, f.s_ingredients, f.s_nutrition, f.ing_head, f.nut_head FROM pool p JOIN filled f ON p.clustered AND f.class = '{section}' AND f.image_id = p.image_id AND f.column_id = p.column_id AND f.root = p.root
  UNION ALL SELECT p.ord, f.image_id, f.line_id, f.x1, f.y1, f.x2, f.y2, f.text, f.place, f.n, f.s_ingredients, f.s_nutrition, f.ing_head, f.nut_head FROM pool p JOIN blocked f ON NOT p.clustered AND f.image_id = p.image_id AND f.column_id = p.column_id AND f.root = p.root)"""


def _regions(section: str, parts: str, lines: str, pages: str) -> str:
    """The best of ``parts`` (image_id, part, tie, confidence, method, anchor, box) per page, refined over ``lines`` (image_id, part, tie, rect, score, n)."""
    return f"""best_part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, part, tie) AS r FROM ({parts})) WHERE r = 1),
clipped AS (SELECT b.*, g.img_w, g.img_h, greatest(0, least(b.x1, g.img_w - 1)) AS a, greatest(0, least(b.y1, g.img_h - 1)) AS b_, greatest(0, least(b.x2, g.img_w)) AS c, greatest(0, least(b.y2, g.img_h)) AS d FROM best_part b JOIN images g ON g.image_id = b.image_id),
own_lines AS (SELECT l.* FROM ({lines}) l JOIN best_part b ON b.image_id = l.image_id AND b.part = l.part AND b.tie = l.tie),
any_good AS (SELECT image_id, max(score) >= 80 AS good, median(y2 - y1) FILTER (WHERE y2 > y1) AS h, count(*) AS lines FROM own_lines GROUP BY image_id),
tight AS (SELECT o.image_id, min(o.x1) AS x1, min(o.y1) AS y1, max(o.x2) AS x2, max(o.y2) AS y2 FROM own_lines o JOIN any_good g ON g.image_id = o.image_id WHERE NOT g.good OR o.score >= 80 GROUP BY o.image_id),
found_words AS (SELECT image_id, string_agg(w, ',' ORDER BY w) AS terms FROM (SELECT DISTINCT o.image_id, k.w FROM own_lines o JOIN (SELECT unnest({_list(V.NUTRIENT_KEYWORDS)}) AS w) k ON contains(o.n, k.w)) GROUP BY image_id),
boxed AS (SELECT c.image_id, c.confidence, c.anchor, c.method, g.lines, c.a, c.b_, c.c, c.d, greatest(0, greatest(t.x1, c.a) - round_even(0.3::DOUBLE * g.h, 0)) AS x1, greatest(0, t.y1 - round_even(0.2::DOUBLE * g.h, 0)) AS y1, least(c.img_w, least(t.x2, c.c) + round_even(0.3::DOUBLE * g.h, 0)) AS x2, least(c.img_h, t.y2 + round_even(0.2::DOUBLE * g.h, 0)) AS y2
  FROM clipped c JOIN any_good g ON g.image_id = c.image_id JOIN tight t ON t.image_id = c.image_id)
SELECT p.image_id, b.x1::DOUBLE AS x1, b.y1::DOUBLE AS y1, b.x2::DOUBLE AS x2, b.y2::DOUBLE AS y2, coalesce(b.confidence, 0)::BIGINT AS confidence, b.anchor, coalesce(b.method, 'none') AS method, coalesce(b.lines, 0)::BIGINT AS lines, coalesce(w.terms, '') AS terms,
  CASE WHEN b.image_id IS NULL THEN 'none' ELSE 'conservative_column_aligned' END AS refinement, b.image_id IS NOT NULL AND NOT (b.x1 = b.a AND b.y1 = b.b_ AND b.x2 = b.c AND b.y2 = b.d) AS changed
FROM ({pages}) p LEFT JOIN boxed b ON b.image_id = p.image_id LEFT JOIN found_words w ON w.image_id = p.image_id"""


_CL = CLUSTERS.split(_layout())[1]
_FIRST_HEAD = "(SELECT arg_min(l.text, [l.y1, l.x1, l.place]) FROM pool_lines l WHERE l.image_id = q.image_id AND l.ord = q.ord AND l.{0} >= 78)"
_PRIMARY = "SELECT image_id, 0 AS part, place AS tie, final AS confidence, method, CASE WHEN heading > 0 THEN {0} END AS anchor, x1, y1, x2, y2 FROM pool q WHERE place = 0 AND final >= 700"
_NO_PRIMARY = "image_id NOT IN (SELECT image_id FROM pool WHERE place = 0 AND final >= 700)"
_POOL_LINES = "SELECT l.image_id, {0} AS part, q.place AS tie, l.x1, l.y1, l.x2, l.y2, l.{1} AS score, l.n FROM pool_lines l JOIN pool q ON q.image_id = l.image_id AND q.ord = l.ord WHERE {2}"
_IS_PRIMARY = "q.place = 0 AND q.final >= 700"
_ING_PARTS = f"""{_PRIMARY.format(_FIRST_HEAD.format('ing_head'))}
UNION ALL SELECT s.image_id, 1, s.no, round(greatest(0, least(0.98, {_ING_SCORE})) * 1000)::BIGINT, 'anchor_expansion', s.anchor, m.x1, m.y1, m.x2, m.y2 FROM seeds s JOIN walk_end e USING (image_id, no) JOIN walk_sum m USING (image_id, no) WHERE {_NO_PRIMARY}
UNION ALL SELECT image_id, 2, place, final, method, NULL, x1, y1, x2, y2 FROM pool WHERE {_NO_PRIMARY}"""
_ING_LINES = f"""{_POOL_LINES.format(0, 's_ingredients', _IS_PRIMARY)} UNION ALL SELECT image_id, 1, no, x1, y1, x2, y2, 0, n FROM walk_lines UNION ALL {_POOL_LINES.format(2, 's_ingredients', 'true')}"""
SQL["o28_o99_ingredient_regions"] = f"WITH RECURSIVE {FACTS}{_CL}, {_ranked_candidates('ingredients')}, {_seeds('ing_word', 'ing_score', chr(40) + 'ing_word = ' + _q('contains') + chr(41))}, {_COLUMN}, {_walk('walk', '(f.x1 + f.x2) / 2 BETWEEN oc.lo - 10 AND oc.hi + 10', 'med * 2.6', joins='JOIN own_column oc ON oc.image_id = s.image_id AND oc.no = s.no', above=True, rows=True)}, {_regions('ingredients', _ING_PARTS, _ING_LINES, 'SELECT image_id FROM images')}"
_NUT_PARTS = f"""{_PRIMARY.format(_FIRST_HEAD.format('nut_head'))}
UNION ALL SELECT s.image_id, 1, s.no, s.conf, 'anchor_expansion', s.anchor, m.x1, m.y1, m.x2, m.y2 FROM heading_seeds s JOIN walk_sum m USING (image_id, no) WHERE {_NO_PRIMARY}
UNION ALL SELECT image_id, 2, 0, confidence, 'table_geometry_fallback', NULL, x1, y1, x2, y2 FROM best_block WHERE {_NO_PRIMARY}
UNION ALL SELECT s.image_id, 3, 0, round_even(least(0.9, s.score) * 1000, 0)::BIGINT, 'table_geometry_fallback', NULL, least(d.x1, u.x1), least(d.y1, u.y1), greatest(d.x2, u.x2), greatest(d.y2, u.y2) FROM seeds s JOIN down_sum d USING (image_id) JOIN up_sum u USING (image_id) WHERE {_NO_PRIMARY}"""
_NUT_LINES = f"""{_POOL_LINES.format(0, 's_nutrition', _IS_PRIMARY)} UNION ALL SELECT image_id, 1, no, x1, y1, x2, y2, 0, n FROM walk_lines
UNION ALL SELECT b.image_id, 2, 0, f.x1, f.y1, f.x2, f.y2, f.s_nutrition, f.n FROM best_block b JOIN blocked f ON f.image_id = b.image_id AND f.column_id = b.column_id AND f.root = b.root
UNION ALL SELECT image_id, 3, 0, x1, y1, x2, y2, 0, n FROM down_lines UNION ALL SELECT image_id, 3, 0, x1, y1, x2, y2, 0, n FROM up_lines WHERE (image_id, line_id) NOT IN (SELECT image_id, seed_id FROM seeds)"""
_FOOD = f"SELECT image_id FROM (SELECT image_id, string_agg({_norm('text')}, ' ' ORDER BY seq) AS t FROM items GROUP BY image_id) WHERE NOT {_count('t', V.PERSONAL_CARE_SIGNALS)} > {_count('t', V.FOOD_SIGNALS)}"
_HEADING_SEEDS = _seeds("nut_word", "nut_score", "nut_score < 0").replace("seeds AS", "first_seeds AS", 1)
_HEADING_WALK = _walk("walk", "f.y1 >= s.sy1 - 1e-6", "med * 2.6").replace("FROM seeds", "FROM first_seeds")
_HEADING_DONE = f"heading_seeds AS (SELECT s.image_id, s.no, s.anchor, round(greatest(0, least(0.98, {_NUT_SCORE})) * 1000)::BIGINT AS conf FROM first_seeds s JOIN walk_end e USING (image_id, no) JOIN walk_sum m USING (image_id, no) LEFT JOIN walk_words w USING (image_id, no))"
_BEST_BLOCK = "best_block AS (SELECT * FROM (SELECT *, round(least(0.7, 0.3 + 0.4 * nut) * 1000)::BIGINT AS confidence, row_number() OVER (PARTITION BY image_id ORDER BY round(least(0.7, 0.3 + 0.4 * nut) * 1000) DESC, id) AS r FROM block_ids WHERE type = 'NUTRITION_TABLE_BLOCK') WHERE r = 1)"
SQL["o100_nutrition_regions"] = f"""WITH RECURSIVE {FACTS}{_CL}, {_ranked_candidates('nutrition')}, {_HEADING_SEEDS}, {_HEADING_WALK}, {_HEADING_DONE}, {_BEST_BLOCK}, {_HIT_SEEDS}, {_walk('down', 'f.y1 >= s.sy1 - 1e-6', 'med * 2.6')}, {_walk('up', 'f.y1 < s.sy1 - 1e-6', 'med * 2.0', direction='DESC')},
{_regions('nutrition', _NUT_PARTS, _NUT_LINES, _FOOD)}"""

_STRIPPED = _norm("t")
for _heading in V.LEADING_HEADINGS:
    _STRIPPED = f"trim(regexp_replace({_STRIPPED}, '^{_heading}\\s*[:\\-.]?', ''))"
SQL["o88_corrected"] = f"""WITH RECURSIVE {SPLIT}, {_scored()},
page AS (SELECT c.image_id, string_agg(c.text, ' ' ORDER BY c.line_id) AS t FROM cutlines c JOIN scored s ON {_norm('c.text')} = s.n WHERE {_TOP} > 0 AND s_ingredients = {_TOP} GROUP BY c.image_id),
clean AS (SELECT image_id, {_STRIPPED} AS t FROM page),
chars AS (SELECT image_id, i, substr(t, i, 1) AS c FROM (SELECT image_id, t, unnest(range(1, length(t) + 1)) AS i FROM clean)),
depth AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS d FROM chars),
piece AS (SELECT *, sum(CASE WHEN c IN (',', ';') AND d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS p FROM depth),
bare AS (SELECT image_id, p, trim(regexp_replace(regexp_replace(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT (c IN (',', ';') AND d = 0)), '[.*:\\-\\s]+$', ''), '^[.*:\\-\\s]+', '')) AS phrase FROM piece GROUP BY image_id, p),
phrases AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS pos, phrase FROM bare WHERE length(phrase) >= 2),
kb AS ({P.TERMS_SQL}), food AS (SELECT ord, canonical, lower(searchable) AS s FROM kb WHERE domain = 'food'),
hit AS (SELECT q, ord, canonical, q = s AS same, 100.0 * length(s) / length(q) > 85 AS long FROM (SELECT DISTINCT phrase AS q FROM phrases) JOIN food ON q = s OR (length(s) > 3 AND (contains(q, s) OR contains(s, q)))),
best AS (SELECT q, arg_min(canonical, ord) FILTER (WHERE same) AS e, arg_max(canonical, ord) FILTER (WHERE long AND NOT same) AS l, arg_min(canonical, ord) FILTER (WHERE NOT same) AS f FROM hit GROUP BY q)
SELECT image_id, pos, phrase, {_norm('phrase')} AS normalized_text, coalesce(e, l, f) AS matched_name, CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE WHEN f IS NOT NULL THEN 0.85::DOUBLE END AS confidence FROM phrases LEFT JOIN best ON phrase = q"""

# regions made exclusive, plain tokens, packets

_OVER_LINES = "SELECT i.image_id, img_w, img_h, seq, text, x1, y1, x2, y2, ((i.image_id * 3 + seq * 7) % 11)::DOUBLE / 10 AS ing, ((i.image_id * 5 + seq * 3) % 11)::DOUBLE / 10 AS nut, ((i.image_id + seq) % 9)::DOUBLE / 10 AS oth FROM items i JOIN images g ON g.image_id = i.image_id"
_SAME = "a.image_id = b.image_id AND (a.text = b.text OR (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2))"
_TO_NUT = "(b.nut > a.ing OR (a.ing = b.nut AND length(a.text) <= 20))"


def _foreign(x: str, own: str, other: str) -> str:
    return f"(({x}.{other} > {x}.{own} + 0.3 AND {x}.{other} > 0.6) OR ({x}.oth > {x}.{own} + 0.3 AND {x}.oth > 0.7))"


def _side(name: str, score: str, confidence: str) -> str:
    """Box, confidence and lines of one side before and after."""
    return f"""{name}_box AS (SELECT image_id, any_value(img_w) AS img_w, any_value(img_h) AS img_h, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, ({confidence})::DOUBLE / 100 AS confidence, string_agg(seq, ',' ORDER BY seq) AS lines FROM {name} GROUP BY image_id),
{name}_mid AS (SELECT image_id, max({score}) >= 0.08 AS good, coalesce(median(y2 - y1) FILTER (WHERE y2 > y1), 20) AS h, string_agg(seq, ',' ORDER BY seq) AS lines FROM {name}_left GROUP BY image_id),
{name}_tight AS (SELECT l.image_id, greatest(0, min(x1) - round_even(0.3::DOUBLE * any_value(h), 0)) AS x1, greatest(0, min(y1) - round_even(0.2::DOUBLE * any_value(h), 0)) AS y1, least(any_value(img_w), max(x2) + round_even(0.3::DOUBLE * any_value(h), 0)) AS x2, least(any_value(img_h), max(y2) + round_even(0.2::DOUBLE * any_value(h), 0)) AS y2, any_value(m.lines) AS lines
  FROM {name}_left l JOIN {name}_mid m ON m.image_id = l.image_id WHERE NOT good OR {score} >= 0.08 GROUP BY l.image_id),
{name}_end AS (SELECT b.image_id, CASE WHEN touched THEN coalesce(t.lines, '') ELSE b.lines END AS lines, CASE WHEN NOT touched THEN {_milli('b.confidence')} WHEN t.image_id IS NULL THEN 0 ELSE {_milli('greatest(0.05, b.confidence - 0.02)')} END AS confidence,
  {', '.join(f'CASE WHEN touched THEN t.{c} ELSE b.{c} END::DOUBLE AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM {name}_box b JOIN met USING (image_id) LEFT JOIN {name}_tight t ON t.image_id = b.image_id)"""


SQL["o49_o101_reconciled"] = f"""WITH {ITEMS}, ing AS ({_OVER_LINES} WHERE seq >= 1 AND seq <= 3 + i.image_id % 7), nut AS ({_OVER_LINES} WHERE seq >= 1 AND seq >= 5 - i.image_id % 3 AND seq <= 9 + i.image_id % 7),
ing_left AS (SELECT * FROM ing a WHERE NOT EXISTS (SELECT 1 FROM nut b WHERE {_SAME} AND {_TO_NUT}) AND NOT {_foreign('a', 'ing', 'nut')}),
nut_left AS (SELECT * FROM nut b WHERE NOT EXISTS (SELECT 1 FROM ing a WHERE {_SAME} AND NOT {_TO_NUT}) AND NOT {_foreign('b', 'nut', 'ing')}),
shared AS (SELECT DISTINCT a.image_id FROM ing a JOIN nut b ON {_SAME}),
a AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ing GROUP BY image_id), b AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM nut GROUP BY image_id),
cut AS (SELECT a.image_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM a JOIN b ON a.image_id = b.image_id),
met AS (SELECT c.image_id, s / (u - s) AS iou, s / (u - s) > {V.RECONCILE_IOU} OR h.image_id IS NOT NULL AS touched FROM cut c LEFT JOIN shared h ON h.image_id = c.image_id),
{_side('ing', 'ing', '50 + image_id % 40')}, {_side('nut', 'nut', '1 + image_id % 80')}
SELECT m.image_id, touched, {_milli('iou', 10**6)} AS iou, i.confidence AS ing_confidence, n.confidence AS nut_confidence, i.lines AS ing_lines, n.lines AS nut_lines, {', '.join(f'{s[0]}.{c} AS {s}_{c}' for s in ('ing', 'nut') for c in ('x1', 'y1', 'x2', 'y2'))}
FROM met m JOIN ing_end i ON i.image_id = m.image_id JOIN nut_end n ON n.image_id = m.image_id"""

_BARE = "lower(regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '^[ .\\-]+|[ .\\-]+$', '', 'g'))"
_RAW = "raw"
for _pattern in ("\\([^)]*" + V.INS_CODE + "[^)]*\\)", V.PERCENT_TOKEN, V.INS_CODE, r"[()\[\]]"):
    _RAW = f"regexp_replace({_RAW}, {_q(_pattern)}, ' ', 'gi')"
SQL["o90_ingredient_tokens"] = f"""WITH RECURSIVE {SPLIT}, {_scored()},
page AS (SELECT c.image_id, string_agg(c.text, ' ' ORDER BY c.line_id) AS t FROM cutlines c JOIN scored s ON {_norm('c.text')} = s.n WHERE {_TOP} > 0 AND s_ingredients = {_TOP} GROUP BY c.image_id),
cut AS (SELECT image_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM (SELECT image_id, regexp_split_to_array(regexp_replace(trim(t), {_q(V.TOKEN_HEADING)}, '', 'gi'), '[;,]|\n+') AS p FROM page)),
tokens AS (SELECT image_id, i, {_BARE.format(_RAW)} AS token FROM cut WHERE length(trim(raw)) > 0),
good AS (SELECT * FROM tokens WHERE length(token) >= 2 AND NOT regexp_full_match(token, '[0-9.\\s]+')),
words AS (SELECT DISTINCT {_norm('token')} AS n FROM good), {_best('halt', 'words', V.SECTION_STOP_WORDS)},
firsts AS (SELECT image_id, token, min(i) AS spot FROM good JOIN halt ON {_norm('token')} = halt.n WHERE halt.score < {V.TOKEN_STOP_SCORE} GROUP BY image_id, token)
SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY spot) - 1 AS pos, token FROM firsts"""

_PACKETS = f"""raw_outlines AS (SELECT image_id, img_w, img_h, unnest(range(0, least(3, image_id % 4 + 1))) AS ord FROM images),
outlines AS (SELECT *, 5 + image_id % 7 * 3 AS x, 4 + ord * 9 AS y, 300 + (image_id * 37 + ord * 91) % 700 AS w, 250 + (image_id * 53 + ord * 77) % 420 AS h FROM raw_outlines),
rated AS (SELECT *, (w * h)::DOUBLE * (60 + (image_id + ord) % 5 * 10) / 100 AS area, (img_w * img_h)::DOUBLE AS image_area FROM outlines),
ranked_outlines AS (SELECT *, area / image_area * 0.7::DOUBLE + area / (w * h) * 0.3::DOUBLE AS score, row_number() OVER (PARTITION BY image_id ORDER BY area / image_area * 0.7::DOUBLE + area / (w * h) * 0.3::DOUBLE DESC, ord) AS r FROM rated WHERE area >= image_area * 0.15::DOUBLE),
packets AS (SELECT g.image_id, CASE WHEN sure THEN greatest(0, x - floor(w * 0.03::DOUBLE)) ELSE 0 END::INT AS x1, CASE WHEN sure THEN greatest(0, y - floor(h * 0.03::DOUBLE)) ELSE 0 END::INT AS y1, CASE WHEN sure THEN least(g.img_w, x + w + floor(w * 0.03::DOUBLE)) ELSE g.img_w END::INT AS x2,
  CASE WHEN sure THEN least(g.img_h, y + h + floor(h * 0.03::DOUBLE)) ELSE g.img_h END::INT AS y2, conf, sure FROM images g LEFT JOIN ranked_outlines o ON o.image_id = g.image_id AND o.r = 1, LATERAL (SELECT coalesce(least(1, o.score), 0)::DOUBLE AS conf, coalesce(least(1, o.score), 0) >= 0.55 AS sure) z)"""
SQL["p2_packet_regions"] = f"WITH {ITEMS}, {_PACKETS} SELECT image_id, x1, y1, x2, y2, {_milli('conf', 10**6)} AS confidence, sure AS crop FROM packets"
SQL["p5_quadrilaterals"] = f"WITH {ITEMS}, r AS (SELECT image_id, seq AS ord, x2, row_number() OVER (PARTITION BY image_id ORDER BY (image_id * 7 + seq * 13) % 100 DESC, seq) AS k FROM items WHERE seq % 4 <> 1 AND (image_id * 7 + seq * 13) % 100 >= 35) SELECT image_id, ord, x2 AS right FROM r WHERE k = 1"

# result documents: the regions above, the readings inside them, what is parsed from the best one

_DOMAINS = f"domains AS (SELECT image_id, CASE WHEN {_count('t', V.PERSONAL_CARE_SIGNALS)} > {_count('t', V.FOOD_SIGNALS)} THEN 'personal_care' ELSE 'food' END AS domain FROM (SELECT image_id, string_agg({_norm('text')}, ' ' ORDER BY seq) AS t FROM items GROUP BY image_id))"
_SCORING = _READ[_READ.index("joined AS") :]
_READING_TEXT = "CASE WHEN variant = 'clahe' AND seq % 3 = 0 THEN replace(text, 'a', '#') WHEN variant = 'sharpened' AND seq % 5 = 0 THEN concat(text, ', salt 2 g') ELSE text END"
_READING_CONFIDENCE = "confidence + 0.00037::DOUBLE + CASE variant WHEN 'original' THEN (i.image_id % 3) / 8 WHEN 'clahe' THEN (i.image_id % 5) / 16 ELSE 0 END + list_position(['original', 'clahe', 'sharpened', 'adaptive_threshold', 'denoised_clahe', 'sharpened_threshold'], variant) * 0.000113::DOUBLE"
_NUTRIENT_TABLES = SQL["o71_o72_o92_nutrition_tables"].replace(ITEMS, "items AS (SELECT * FROM facts), images AS (SELECT * FROM pictures)").rsplit("SELECT image_id, nutrient, value_100g", 1)[0] + "SELECT * FROM tables"
_NUTRIENT_STRINGS = SQL["o93_nutrition_strings"].replace(ITEMS, "items AS (SELECT * FROM facts)")
assert _NUTRIENT_TABLES.count("FROM facts") == _NUTRIENT_STRINGS.count("FROM facts") == 1
_RESULTS = f"""{ITEMS}, pictures AS (SELECT * FROM images), {_DOMAINS}, ing AS ({SQL['o28_o99_ingredient_regions']}), nut AS ({SQL['o100_nutrition_regions']}),
regs AS (SELECT image_id, 'ingredient' AS section, x1, y1, x2, y2 FROM ing WHERE x1 IS NOT NULL UNION ALL SELECT image_id, 'nutrition', x1, y1, x2, y2 FROM nut WHERE x1 IS NOT NULL),
variants AS (SELECT unnest(['original', 'clahe', 'sharpened', 'adaptive_threshold', 'denoised_clahe', 'sharpened_threshold']) AS variant),
readings AS (SELECT i.image_id, section, variant, seq, {_READING_TEXT} AS text, {_READING_CONFIDENCE} AS confidence, i.x1, i.y1, i.x2, i.y2 FROM items i JOIN regs r ON r.image_id = i.image_id AND (i.x1 + i.x2) / 2 BETWEEN r.x1 AND r.x2 AND (i.y1 + i.y2) / 2 BETWEEN r.y1 AND r.y2, variants),
{_SCORING},
s AS (SELECT x.*, max(confidence) FILTER (WHERE variant = 'original') OVER (PARTITION BY image_id, section) AS own FROM scores x),
turns AS (SELECT s.*, list_position({_TRIED}, variant) AS turn FROM s),
chosen AS (SELECT r.image_id, r.section, r.variant, j.t FROM (SELECT *, row_number() OVER (PARTITION BY image_id, section ORDER BY score DESC, turn) AS r FROM turns WHERE turn > 0) r JOIN joined j USING (image_id, section, variant) WHERE r = 1),
clean AS (SELECT image_id, {_STRIPPED} AS t FROM chosen WHERE section = 'ingredient'),
chars AS (SELECT image_id, i, substr(t, i, 1) AS c FROM (SELECT image_id, t, unnest(range(1, length(t) + 1)) AS i FROM clean)),
depth AS (SELECT *, sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS d FROM chars),
piece AS (SELECT *, sum(CASE WHEN c IN (',', ';') AND d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY i) AS p FROM depth),
bare AS (SELECT image_id, p, trim(regexp_replace(regexp_replace(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT (c IN (',', ';') AND d = 0)), '[.*:\\-\\s]+$', ''), '^[.*:\\-\\s]+', '')) AS phrase FROM piece GROUP BY image_id, p),
phrases AS (SELECT b.image_id, p, phrase, domain FROM bare b JOIN domains d ON d.image_id = b.image_id WHERE length(phrase) >= 2),
kb AS ({P.TERMS_SQL}), hit AS (SELECT q, t.domain, ord, canonical, q = s AS same, 100.0 * length(s) / length(q) > 85 AS long FROM (SELECT DISTINCT phrase AS q, domain FROM phrases) t JOIN (SELECT domain, ord, canonical, lower(searchable) AS s FROM kb) k ON k.domain = t.domain AND (q = s OR (length(s) > 3 AND (contains(q, s) OR contains(s, q))))),
best AS (SELECT q, domain, arg_min(canonical, ord) FILTER (WHERE same) AS e, arg_max(canonical, ord) FILTER (WHERE long AND NOT same) AS l, arg_min(canonical, ord) FILTER (WHERE NOT same) AS f FROM hit GROUP BY q, domain),
told AS (SELECT image_id, p, phrase, {_norm('phrase')} AS n, coalesce(e, l, f) AS name, CASE WHEN e IS NOT NULL THEN 1.0::DOUBLE WHEN f IS NOT NULL THEN 0.85::DOUBLE END AS confidence FROM phrases x LEFT JOIN best b ON phrase = q AND x.domain = b.domain),
facts AS (SELECT r.image_id, seq, r.text, r.confidence, x1, y1, x2, y2 FROM readings r JOIN chosen c ON c.image_id = r.image_id AND c.section = r.section AND c.variant = r.variant WHERE r.section = 'nutrition'),
in_tables AS ({_NUTRIENT_TABLES}), in_strings AS ({_NUTRIENT_STRINGS}),
nutrients AS (SELECT image_id, nutrient, value_100g, unit_100g, value_serving, unit_serving FROM in_tables UNION ALL SELECT image_id, nutrient, value, unit, NULL, NULL FROM in_strings WHERE image_id NOT IN (SELECT image_id FROM in_tables)),
quality AS ({SQL['o67_quality']}), {_PACKETS}"""


def _cell(name: str, value: str, unit: str) -> str:
    return f"""CASE WHEN {value} IS NULL THEN '' ELSE '"{name}":{{"value":' || {value}::VARCHAR || ',"unit":"' || {unit} || '"}},' END"""


_LEAD_VALUE, _LEAD_UNIT = "coalesce(value_100g, value_serving)", "CASE WHEN value_100g IS NULL THEN unit_serving ELSE unit_100g END"
_FACTS_JSON = f"""'{{' || string_agg('"' || nutrient || '":{{' || {_cell('per_100g', 'value_100g', 'unit_100g')} || {_cell('per_serving', 'value_serving', 'unit_serving')} || '"value":' || {_LEAD_VALUE}::VARCHAR || ',"unit":"' || {_LEAD_UNIT} || '"}}', ',' ORDER BY nutrient) || '}}'"""


def _region_json(x: str) -> str:
    return f"{{'bbox': CASE WHEN {x}.x1 IS NOT NULL THEN [{x}.x1, {x}.y1, {x}.x2, {x}.y2] END, 'confidence': {x}.confidence / 1000, 'anchor': {x}.anchor, 'method': {x}.method}}"


_QUALITY_JSON = "{" + ", ".join(f"'{c}': q.{c} / 1000" for c in ("laplacian_variance", "brightness_mean", "contrast_std", "glare_ratio", "shadow_std")) + ", " + ", ".join(f"'{c}': q.{c}" for c in ("is_blurry", "is_too_dark", "is_too_bright")) + "}"
SQL["o09_o103_result_json"] = f"""WITH RECURSIVE {_RESULTS},
listed AS (SELECT image_id, list({{'ocr_text': phrase, 'normalized_text': n, 'matched_name': name, 'confidence': confidence}} ORDER BY p) AS l FROM told GROUP BY image_id),
named AS (SELECT image_id, {_FACTS_JSON} AS j FROM nutrients GROUP BY image_id)
SELECT d.image_id, left(head, -1) || ',"nutrition":' || CASE WHEN domain = 'food' AND cn.variant IS NOT NULL THEN coalesce(n.j, '{{}}') ELSE 'null' END || ',' || substr(tail, 2) AS value
FROM domains d JOIN ing i ON i.image_id = d.image_id LEFT JOIN nut u ON u.image_id = d.image_id JOIN packets p ON p.image_id = d.image_id JOIN quality q ON q.image_id = d.image_id LEFT JOIN listed l ON l.image_id = d.image_id LEFT JOIN named n ON n.image_id = d.image_id
LEFT JOIN chosen ci ON ci.image_id = d.image_id AND ci.section = 'ingredient' LEFT JOIN chosen cn ON cn.image_id = d.image_id AND cn.section = 'nutrition',
LATERAL (SELECT to_json({{'image': concat('page_', d.image_id, '.png'), 'domain': domain, 'packet_detection': {{'bbox': [p.x1, p.y1, p.x2, p.y2], 'confidence': round(p.conf * 1000) / 1000}}, 'ingredients_region': {_region_json('i')},
  'nutrition_region': CASE WHEN domain = 'food' THEN {_region_json('u')} END, 'ingredients': coalesce(l.l, [])}})::VARCHAR AS head, to_json({{'processing': {{'best_ingredient_variant': ci.variant, 'best_nutrition_variant': cn.variant}}, 'image_quality': {_QUALITY_JSON}}})::VARCHAR AS tail) z"""


def _region_text(title: str, x: str) -> str:
    box = f"CASE WHEN {x}.x1 IS NULL THEN 'None' ELSE concat('[', {x}.x1, ', ', {x}.y1, ', ', {x}.x2, ', ', {x}.y2, ']') END"
    return f"concat('--- {title} Region ---', chr(10), 'bbox: ', {box}, chr(10), 'confidence: ', {x}.confidence / 1000, chr(10), 'anchor: ', coalesce({x}.anchor, 'None'), chr(10), 'method: ', {x}.method)"


SQL["o10_result_text"] = f"""WITH RECURSIVE {_RESULTS},
listed AS (SELECT image_id, string_agg(concat('  - ', phrase, '  ->  ', coalesce(name, '(no confident KB match)'), chr(10)), '' ORDER BY p) AS l FROM told GROUP BY image_id),
named AS (SELECT image_id, string_agg(concat('  - ', nutrient, ': ', {_LEAD_VALUE}, ' ', {_LEAD_UNIT}, chr(10)), '' ORDER BY nutrient) AS l FROM nutrients GROUP BY image_id)
SELECT d.image_id, concat('Result for: page_', d.image_id, '.png', chr(10), 'Domain: ', domain, chr(10), chr(10), {_region_text('Ingredients', 'i')}, chr(10), chr(10), 'Ingredients:', chr(10), coalesce(l.l, ''), chr(10),
  CASE WHEN domain = 'food' THEN concat({_region_text('Nutrition', 'u')}, chr(10), chr(10), 'Nutrition facts:', chr(10), coalesce(n.l, concat('  (none extracted)', chr(10)))) ELSE concat('--- Nutrition Region ---', chr(10), '  skipped (personal_care domain)', chr(10)) END) AS value
FROM domains d JOIN ing i ON i.image_id = d.image_id LEFT JOIN nut u ON u.image_id = d.image_id LEFT JOIN listed l ON l.image_id = d.image_id LEFT JOIN named n ON n.image_id = d.image_id"""

# files written from tables and read again

_KB_ROWS = "SELECT p_partkey AS k, trim(p_name) AS canonical, concat(p_brand, '; ', p_type, ' / x', p_partkey % 7, CASE WHEN p_partkey % 5 = 0 THEN ' | |' ELSE '' END) AS alt FROM part WHERE p_partkey % 11 <> 3"
SQL["o02_o53_kb_csv"] = f"""WITH kb AS ({_KB_ROWS}), alts AS (SELECT k, canonical, trim(a) AS a, i FROM (SELECT k, canonical, unnest(regexp_split_to_array(alt, '[;,/|]')) AS a, generate_subscripts(regexp_split_to_array(alt, '[;,/|]'), 1) AS i FROM kb) WHERE trim(a) <> ''),
terms AS (SELECT k, 0 AS i, canonical, canonical AS searchable FROM kb UNION ALL SELECT k, i, canonical, a FROM alts)
SELECT 'food' AS domain, row_number() OVER (ORDER BY k, i) - 1 AS ord, canonical, searchable FROM terms"""
SQL["o03_o04_kb_xlsx"] = """WITH t AS (SELECT n_nationkey AS k, 0 AS i, n_name AS canonical, n_name AS searchable FROM nation UNION ALL SELECT n_nationkey, 1, n_name, concat('nation ', n_nationkey) FROM nation)
SELECT 'personal_care' AS domain, row_number() OVER (ORDER BY k, i) - 1 AS ord, canonical, searchable FROM t"""
SQL["o05_ground_truth"] = "SELECT concat(n_name, '.png') AS image, n_nationkey::DOUBLE AS left_, (n_nationkey + 7)::DOUBLE AS bottom, n_regionkey <> 2 AS has_nutrition FROM nation"
