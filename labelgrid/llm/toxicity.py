"""Toxic passages by maximum-scoring segments over token log-odds.

Learning, on a bounded sample of the labelled rows that are not held out (``SAMPLE`` documents, a documented bound): for each
whole token and each token stem (its first 3 to 6 bytes), the log-odds of occurring in toxic against other documents, with a
Dirichlet prior in proportion to its frequency; every one whose z-score is high is kept. Scoring: a token scores its best
log-odds, any other token a small negative constant; the linear-time scan for all maximal scoring segments finds the passages. A
passage with score S in a document of n tokens has the extreme-value p-value ``1 - exp(-K n exp(-lambda S))``; lambda and K are
fitted on the clean documents of a calibration fold. The evidence of a document is the sum over all its significant passages;
a logistic curve, fitted on the evidence of the calibration fold, turns it into a score.

Null or empty text has no passage and gets the score of a document without evidence. Labels whose toxic is null are not used;
a doc_id labelled twice counts as toxic if any label says so. Of rows that repeat a labelled doc_id one text is learned from
(that of the least hash); all of them are scored. Without toxic and clean labels every score is 0. A null doc_id is held out.
Empty tables give an empty result; columns of any name pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import forget, keep, packed, with_own

#: labelled documents from which is learned; one in four of them calibrates
SAMPLE = 8000
STEMS = (3, 4, 5, 6)
#: weight of the prior, in documents, as a share of the sample
PRIOR = 0.05
BACKGROUND = -0.05
SIGNIFICANT = 0.05
Z_GRID = (2.5, 3.0, 4.0, 6.0)
LEAST_ODDS = 1.0
_WHOLE = K.U64(0xA5A5A5A55A5A5A5A)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """Weights by feature hash (sorted), and the calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = -math.inf

    def __post_init__(self) -> None:
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.keys & K.U64(0xFFFF)).astype(np.int64)] = True

    def evidence(self, n: int, scores: list[float]) -> tuple[float, int]:
        """Summed normalised scores of the significant passages (else that of the best), and how many there are."""
        floor = math.log(self.k * max(n, 1))
        normal = sorted((self.lam * s - floor for s in scores), reverse=True)
        strong = [x for x in normal if 1 - math.exp(-math.exp(-x)) <= SIGNIFICANT]
        return (sum(strong) if strong else max(normal, default=-floor)), len(strong)

    def score(self, evidence: float) -> float:
        x = self.shift + self.slope * max(-20.0, min(evidence, 40.0))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Token starts and ends, each row's first token, and per kind of feature the tokens that have it and its hashes."""
    raw, offsets = K.buffer(column)
    data = K.LOWER[raw]
    starts, ends, first = K.runs(data, offsets, _LETTER[data])
    sums = K.byte_sums(data)
    places, hashes = [np.arange(len(starts))], [K.hash_at(sums, starts, ends) ^ _WHOLE]
    for stem in STEMS:
        place = np.flatnonzero(ends - starts > stem)
        places.append(place)
        hashes.append(K.hash_at(sums, starts[place], starts[place] + stem))
    return starts - offsets[np.searchsorted(first, np.arange(len(starts)), "right") - 1], ends - starts, first, places, hashes


def weigh(model: Model, count: int, places: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    """The best weight of each token; 0 where no feature of it is in the model."""
    out = np.zeros(count)
    for place, hashed in zip(places, hashes, strict=True):
        maybe = np.flatnonzero(model.low[(hashed & K.U64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(model.keys):
            at = np.minimum(np.searchsorted(model.keys, hashed[maybe]), len(model.keys) - 1)
            hit = model.keys[at] == hashed[maybe]
            np.maximum.at(out, place[maybe[hit]], model.weights[at[hit]])
    return out


def maximal_segments(at: list[int], weights: list[float], background: float = BACKGROUND) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first and last index into ``at``) of a row in which the tokens ``at`` score their
    weights and all others ``background``; linear in the number of such tokens."""
    stack: list[tuple[float, float, int, int, int]] = []
    total, before = 0.0, None
    for k, (place, weight) in enumerate(zip(at, weights, strict=True)):
        if before is not None:
            total += background * (place - before - 1)
        before = place
        low, first = total, k
        total += weight
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= total:
                stack.append((low, total, first, k, j))
                break
            low, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(high - low, first, last) for low, high, first, last, _ in stack]


def passages(model: Model, column: pa.Array) -> Iterator[tuple[int, list[tuple[float, int, int]], np.ndarray]]:
    """For each row: its number of tokens, its segments with first and last byte, and the weights of its tokens that have any."""
    starts, sizes, first, places, hashes = tokens(column)
    weights = weigh(model, len(starts), places, hashes)
    hits = np.flatnonzero(weights)
    bounds = np.searchsorted(hits, first)
    for i in range(len(first) - 1):
        own = hits[bounds[i] : bounds[i + 1]]
        found = maximal_segments(own.tolist(), weights[own].tolist()) if len(own) else []
        spans = [(s, int(starts[own[a]]), int(starts[own[b]] + sizes[own[b]])) for s, a, b in found]
        yield int(first[i + 1] - first[i]), spans, weights[own]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve, by Newton steps that are halved until they help; small ridge."""
    design, ridge = np.column_stack([x, np.ones(len(x))]), np.array([0.05, 0.005])

    def loss(a: np.ndarray) -> float:
        u = design @ a
        return float((np.logaddexp(0, u) - y * u).sum() + (ridge * a * a).sum() / 2)

    a = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), design.T @ (p - y) + ridge * a)
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(0.0, float(a[0])), float(a[1])


def _with_tail(keys: np.ndarray, weights: np.ndarray, rows: list) -> Model:
    """The model with lambda and K fitted on the clean rows of the calibration fold."""
    clean = [r for r in rows if not r["toxic"]]
    tokens_clean = max(1, sum(r["n"] for r in clean))
    hits = sum(r["hits"] for r in clean)
    rate = (hits + 0.5) / (tokens_clean + 1)
    mean = (sum(r["weight"] for r in clean) + weights.mean()) / (hits + 1)
    low, high = 0.05, 5.0
    for _ in range(60):
        lam = (low + high) / 2
        if rate * math.exp(lam * mean) + (1 - rate) * math.exp(lam * BACKGROUND) > 1:
            high = lam
        else:
            low = lam
    return Model(keys, weights, lam, len(clean) / max(1e-9, sum(max(r["n"], 1) * math.exp(-lam * r["best"]) for r in clean)))


def _with_curve(model: Model, rows: list) -> tuple[float, Model]:
    """Log loss on the calibration rows, and the model with the curve fitted on their evidence."""
    rows = sorted(rows, key=lambda r: (r["evidence"], r["toxic"]))  # sums do not depend on how rows are dealt
    y = np.array([r["toxic"] for r in rows])
    x = np.clip([r["evidence"] for r in rows], -20.0, 40.0)
    model.slope, model.shift = _fit_curve(x, y)
    p = np.clip([model.score(v) for v in x], 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()), model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature of a slice of rows: in how many toxic (``y``) and other (``x``) ones it is."""
    for batch in batches:
        for part in K.slices(batch, "text"):
            labels_of = np.array(part.column("toxic").to_pylist(), np.int64)
            _, _, first, places, hashes = tokens(part.column("text"))
            row = np.concatenate([np.searchsorted(first, p, "right") - 1 for p in places])
            each = np.concatenate(hashes)
            order = np.lexsort((row, each))
            each, row = each[order], row[order]
            new = np.concatenate([[True], (each[1:] != each[:-1]) | (row[1:] != row[:-1])]) if len(each) else np.zeros(0, bool)
            each, row = each[new], row[new]
            found, back = np.unique(each, return_inverse=True)
            bad = np.bincount(back, labels_of[row], len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)
            both = np.bincount(back, minlength=len(found)) if len(found) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad), pa.array(both - bad)], ["h", "y", "x"])


def _measured(models: list[Model]):  # noqa: ANN202
    """A function over batches: for each row and model, what lambda and K are fitted on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                for level, model in enumerate(models):
                    out = [(n, max((s for s, _, _ in spans), default=0.0), len(w), float(w.sum())) for n, spans, w in passages(model, part.column("text"))]
                    n, best, hit, weight = zip(*out, strict=True)
                    columns = [pa.array([level] * len(n), pa.int32()), part.column("toxic"), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(hit, pa.int64()), pa.array(weight, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, ["level", "toxic", "n", "best", "hits", "weight"])

    return scan


def _evidence(models: list[Model]):  # noqa: ANN202
    """A function over batches: for each row and model the evidence, as it will be scored."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                for level, model in enumerate(models):
                    found = [model.evidence(n, [s for s, _, _ in spans])[0] for n, spans, _ in passages(model, part.column("text"))]
                    yield pa.RecordBatch.from_arrays([pa.array([level] * len(found), pa.int32()), part.column("toxic"), pa.array(found, pa.float64())], ["level", "toxic", "evidence"])

    return scan


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model; the ids of the sample (at most ``sample``), the features that its texts have and two numbers for each of its
    calibration rows are all that reach the driver."""
    spark = docs.sparkSession
    digest = F.crc32(F.col("id").cast("string"))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    chosen = known.where(digest % 5 != 0).orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample).collect()
    toxic = {r["id"]: r["toxic"] for r in chosen}
    if len(set(toxic.values())) < 2:
        return Model()
    kind = docs.schema[key].dataType
    ids = spark.createDataFrame([(i, int(t)) for i, t in toxic.items()], f"id {kind.simpleString()}, toxic int")
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id")
    # one text of each id: the sample is bounded, however often an id is repeated
    one = found.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).getField("text").alias("text"))
    rows = keep(one.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(4))), spark.sparkContext.defaultParallelism)
    try:
        return _learned(rows)
    finally:
        forget(rows)


def _learned(rows: DataFrame) -> Model:
    """The model from the sample: ``text``, ``toxic`` and ``fold``."""
    fold = rows.where("fold <> 0")
    n1, n0 = (float(v or 0) for v in fold.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()[0])
    if not n1 or not n0:
        return Model()
    prior = PRIOR * (n1 + n0)
    summed = fold.mapInArrow(_counts, "h long, y long, x long").groupBy("h").agg(F.sum("y").alias("y"), F.sum("x").alias("x")).where("y > 1")
    y, x = F.col("y"), F.col("x")
    alpha = PRIOR * (y + x)
    odds = F.log((y + alpha) / (n1 + prior - y - alpha + 0.5)) - F.log((x + alpha) / (n0 + prior - x - alpha + 0.5))
    z = odds / F.sqrt(1 / (y + alpha) + 1 / (x + alpha))
    best = summed.select("h", odds.alias("odds"), z.alias("z")).where((F.col("z") >= min(Z_GRID)) & (F.col("odds") >= LEAST_ODDS)).collect()
    if not best:
        return Model()
    h = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    odds_of, z_of = np.array([r["odds"] for r in best]), np.array([r["z"] for r in best])
    order = np.argsort(h)
    h, odds_of, z_of = h[order], odds_of[order], z_of[order]
    tried = [z for z in Z_GRID if (z_of >= z).sum() >= 2] or [min(Z_GRID)]
    models = [Model(h[z_of >= z], odds_of[z_of >= z]) for z in tried]
    held = rows.where("fold = 0")
    seen = held.mapInArrow(_measured(models), "level int, toxic int, n long, best double, hits long, weight double").collect()
    if len({r["toxic"] for r in seen}) < 2:
        return Model(h, odds_of, 1.0, 1.0, 1.0, 0.0)
    seen.sort(key=tuple)
    models = [_with_tail(m.keys, m.weights, [r for r in seen if r["level"] == i]) for i, m in enumerate(models)]
    told = held.mapInArrow(_evidence(models), "level int, toxic int, evidence double").collect()
    return min((_with_curve(m, [r for r in told if r["level"] == i]) for i, m in enumerate(models)), key=lambda t: t[0])[1]


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``rest`` (all other columns of ``docs``), ``text``, ``score`` (0 to 1) and its significant ``passages`` (byte offsets and p-value)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs, text)
    spans_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in K.slices(batch, "text"):
                scores, lists = [], []
                for n, spans, _ in passages(own, part.column("text")):
                    floor = math.log(own.k * max(n, 1))
                    scores.append(own.score(own.evidence(n, [s for s, _, _ in spans])[0]))
                    ranked = ((1 - math.exp(-math.exp(min(50.0, floor - own.lam * s))), a, b) for s, a, b in spans)
                    lists.append([{"start": a, "end": b, "p": p} for p, a, b in ranked if p <= SIGNIFICANT])
                yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), pa.array(scores, pa.float64()), pa.array(lists, spans_of)], ["rest", "text", "score", "passages"])

    return rows.mapInArrow(apply, with_own(rows, ("score", "double"), ("passages", "array<struct<start:bigint,end:bigint,p:double>>")))
