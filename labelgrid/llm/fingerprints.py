"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words and the two halves of each word, with their counts. For every sample k and term t, gamma
variates ``r, c`` and a uniform ``b`` are drawn; with weight w the sample takes the term that minimises ``ln c - r * (floor(ln w / r + b) - b) - r``, together with that floor. Two documents take the same
(term, floor) with a probability equal to the generalised Jaccard similarity of their weighted sets, so the share of equal
samples estimates it, and equal texts have equal fingerprints.

The variates are drawn from the term's full hash and k (counter-based), so every term has its own, the same in every document and
worker; terms are taken a block at a time, in bounded memory. A gamma variate of shape 2 cut by a uniform one is two independent
exponential ones, so three of them, ``g, h, e``, make up ``c = g + h``, ``r (1 - b) = ln(c / g)`` and ``r b = e``, and the formula
becomes ``ln g - r * floor(ln w / r + b)``: of terms of weight 1 the one with the least ``g`` is taken, that is, with the least bits.

A fingerprint is ``SAMPLES`` bytes in hex, one byte of each sample; the chance agreement of two bytes is taken out of the likeness.

Neighbours: documents go to ranges of (id, hash of the text), compressed, once; each range is streamed in order, and ends with a
copy of the first document of the following range, so no task sees more than its range and no text is sent a second time. At most
``MAX_RANGES`` ranges are made, from a sample of bounded size that only decides how even they are. Rows without an id, or that
repeat one, are spread by their texts; those with the same text too are one row with a number until they are given back.

Null text counts as empty; an empty weighted set has the fingerprint of all zeros, and is like another empty one only. A null id
stands after all others. Rows that repeat an id stand in the order of their texts' hashes. Ids are of any type that has an order.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import files_for, forget, keep

SAMPLES = 64
#: terms taken at a time
BLOCK = 256
_HEAD, _TAIL = K.U64(0x1B56C4E9F3A7D201), K.U64(0x8CB92BA72F3D8DD7)
_STEP = K.U64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = K.mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * _STEP).reshape(2, SAMPLES)


def bits(part: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """64 bits per term and sample: the mix of their sum, in place; different terms have different ones."""
    x = part[:, None] + counters
    y = x >> K.U64(30)
    x ^= y
    x *= K.U64(0xBF58476D1CE4E5B9)
    np.right_shift(x, K.U64(27), out=y)
    x ^= y
    x *= K.U64(0x94D049BB133111EB)
    np.right_shift(x, K.U64(31), out=y)
    x ^= y
    return x


def _least(x: np.ndarray) -> np.ndarray:
    """``g`` of its bits, rising with them and exact to 24 bits near 0."""
    return -np.log1p(-np.minimum(x.astype(np.float32) * np.float32(2.0**-64), np.float32(1 - 2.0**-24)))


def _exponential(x: np.ndarray) -> np.ndarray:
    """An exponential variate of 23 bits."""
    return -np.log((x.astype(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-23))


def variates(part: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln g, r, b per term and sample; ``x`` are the bits of ``g``."""
    y = bits(part, _SECOND)
    g, h, e = _least(x), _exponential(y >> K.U64(41)), _exponential((y >> K.U64(18)) & K.U64((1 << 23) - 1))
    r = e + np.log1p(h / g)
    return np.log(g), r, e / r


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term occurrence, in row order, and each row's first one."""
    data, offsets = K.buffer(column)
    starts, ends, first = K.words(data, offsets)
    sums = K.byte_sums(data)
    middle = (starts + ends + 1) // 2
    each = np.empty((len(starts), 3), np.uint64)
    each[:, 0] = K.hash_at(sums, starts, ends)
    each[:, 1] = K.mix(K.hash_at(sums, starts, middle) ^ _HEAD)
    each[:, 2] = K.mix(K.hash_at(sums, middle, ends) ^ _TAIL)
    return each.reshape(-1), first * 3


def sample(hashes: np.ndarray) -> np.ndarray:
    """The ``SAMPLES`` bytes of one weighted set."""
    out = np.zeros(SAMPLES, np.uint8)
    if not len(hashes):
        return out
    found, counts = np.unique(hashes, return_counts=True)
    one = counts == 1
    single, many, weight = found[one], found[~one], np.log(counts[~one]).astype(np.float32)
    best = np.full(SAMPLES, np.inf, np.float32)
    taken = np.full(SAMPLES, 2**64 - 1, np.uint64)
    level = np.zeros(SAMPLES, np.int64)
    for a in range(0, len(single), BLOCK):
        np.minimum(taken, bits(single[a : a + BLOCK], _FIRST).min(0), out=taken)
    if len(single):
        best = np.log(_least(taken))
    each = np.arange(SAMPLES)
    for a in range(0, len(many), BLOCK):
        part = many[a : a + BLOCK]
        x = bits(part, _FIRST)
        g, r, b = variates(part, x)
        step = np.floor(weight[a : a + BLOCK, None] / r + b)
        value = g - r * step
        at = value.argmin(0)
        low = value[at, each]
        better = low < best
        best[better], taken[better], level[better] = low[better], x[at, each][better], step[at, each][better].astype(np.int64)
    return (K.mix(taken + level.astype(np.uint64) * _STEP) >> K.U64(56)).astype(np.uint8)


def fingerprints(column: pa.Array) -> list[bytes]:
    hashes, first = terms(column)
    return [sample(hashes[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def likeness(x: bytes, y: bytes) -> float:
    """Estimated generalised Jaccard similarity: the share of equal samples, less what bytes agree by chance."""
    if not any(x) or not any(y):
        return float(x == y)
    share = float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean())
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


#: ranges for each file of an intermediate table, and at most; rows of the sample for each range
RANGES_PER_FILE = 4
MAX_RANGES = 20_000
SAMPLED = 32
#: rows of a batch that repeats one row
REPEATED = 10_000


def _order(k, th: int) -> tuple:  # noqa: ANN001
    """The place of a row among all: nulls are least."""
    return (False, 0, th) if k is None else (True, k, th)


def _ranges(narrow: DataFrame, ranges: int) -> tuple[list[tuple], dict[int, tuple]]:
    """Where ranges of (``k``, ``th``) begin, and the greatest row of each range that has any; both bounded by ``ranges``."""
    rows = narrow.count()
    share = min(1.0, ranges * SAMPLED / max(1, rows))
    seen = sorted(_order(r["k"], r["th"]) for r in narrow.sample(share, seed=7).collect())
    bounds = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    kind = narrow.schema["k"].dataType.simpleString()

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[int, tuple] = {}
            for k, th in zip(batch.column("k").to_pylist(), batch.column("th").to_pylist(), strict=True):
                place = _order(k, th)
                at = bisect_right(bounds, place)
                if at not in best or best[at] < place:
                    best[at] = place
            ks = pa.array([p[1] if p[0] else None for p in best.values()], batch.column("k").type)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), ks, pa.array([p[2] for p in best.values()], pa.int64())], ["at", "k", "th"])

    most = narrow.mapInArrow(greatest, f"at int, k {kind}, th long").groupBy("at").agg(F.max(F.struct("k", "th")).alias("m")).collect()
    return bounds, {r["at"]: _order(r["m"]["k"], r["m"]["th"]) for r in most}


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the following document."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.coalesce(text, F.lit("")).alias("text"))
    files = files_for(docs) or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = keep(rows.select("k", "th"), files)
    bounds, greatest = _ranges(narrow, min(MAX_RANGES, RANGES_PER_FILE * files))
    forget(narrow)
    if not greatest:
        return docs.sparkSession.createDataFrame([], schema)
    filled = sorted(greatest)
    following = dict(zip(filled, filled[1:] + filled[:1], strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in K.slices(batch, "text"):
                alike: dict[tuple, int] = {}
                for row in zip(*(part.column(c).to_pylist() for c in ("k", "th", "text")), strict=True):
                    alike[row] = alike.get(row, 0) + 1
                out = []
                for (k, th, t), n in alike.items():
                    z, place = pack(t.encode()), _order(k, th)
                    at = bisect_right(bounds, place)
                    out.append((at, 0, k, th, n, z))
                    if place == greatest[at]:
                        out.append((following[at], 1, k, th, 1, z))
                kinds = [pa.int32(), pa.int32(), part.column("k").type, pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["at", "copy", "k", "th", "n", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        key_type = None

        def told(keys: list, texts: list[str], nexts: list[str], own: list[bytes], theirs: list[bytes]) -> pa.RecordBatch:
            changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
            new = fingerprints(pa.array(changed, pa.large_string()))
            columns = [
                pa.array(keys, key_type),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([x.hex() for x in own]),
                pa.array([x.hex() for x in new]),
                pa.array([likeness(x, y) for x, y in zip(own, new, strict=True)]),
                pa.array([likeness(x, y) for x, y in zip(own, theirs, strict=True)]),
            ]
            return pa.RecordBatch.from_arrays(columns, [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        def run(keys: list, counts: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
            """Rows for ``keys``, ``counts`` of each; ``texts`` has one text more."""
            own = fingerprints(pa.array(texts, pa.large_string()))
            yield told(keys, texts[:-1], texts[1:], own[:-1], own[1:])
            for i in [i for i, n in enumerate(counts) if n > 1]:  # all but the last of equal rows are followed by one like them
                one = told(keys[i : i + 1], texts[i : i + 1], texts[i : i + 1], own[i : i + 1], own[i : i + 1])
                for a in range(0, counts[i] - 1, REPEATED):
                    yield one.take(pa.array(np.zeros(min(REPEATED, counts[i] - 1 - a), np.int32)))

        keys: list = []
        counts: list[int] = []
        texts: list[str] = []
        size, range_of, ended = 0, None, True
        for batch in batches:
            key_type = batch.column("k").type
            for at, copy, k, n, z in zip(*(batch.column(c).to_pylist() for c in ("at", "copy", "k", "n", "z")), strict=True):
                if at != range_of:
                    keys, counts, texts, size, range_of, ended = [], [], [], 0, at, False
                if ended:
                    continue
                texts.append(unpack(z).decode("utf-8", "replace"))
                size += len(texts[-1])
                if copy:
                    ended = True
                else:
                    keys.append(k)
                    counts.append(n)
                if keys and (ended or (size > 500_000 and len(keys) > 1)):
                    done = len(texts) - 1
                    yield from run(keys[:done], counts[:done], texts)
                    keys, counts, texts = keys[done:], counts[done:], texts[done:]
                    size = len(texts[0])

    dealt = rows.mapInArrow(deal, f"at int, copy int, k {kind}, th long, n long, z binary")
    ordered = dealt.repartition("at").sortWithinPartitions("at", "copy", F.desc_nulls_last("k"), F.desc("th"), "z")
    return ordered.mapInArrow(compare, schema)
