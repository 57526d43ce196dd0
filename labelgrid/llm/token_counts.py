"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast open-addressing table of the lengths of frequent pre-tokens (fixed number of slots, so its size is
bounded); it answers most pre-tokens of a batch at once, with NumPy. Tier two is a bounded cache in each Python worker, fed by
the tokenizer itself. No pre-token is shuffled.

A piece of the model never holds a space mark after another character, nor a line feed (checked when the model is loaded), so
BPE never merges across such a boundary and the count of a text is the sum over its pre-tokens ``space* other*`` and line
feeds. Texts with the characters for which this does not hold (the space mark itself, NUL) go to the tokenizer whole.

Null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result; repeated rows are counted each; further
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: rows from which the frequent pre-tokens are learned, about, drawn from all partitions; it decides which tier answers, never
#: what is answered, so a summary of the whole corpus would save next to nothing
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 15
FREQUENT = 1 << 16
SLOTS = 1 << 18
PROBES = 8
CACHE_ENTRIES = 400_000
SPACE_MARK = "▁"

_models: dict = {}


def model(name: str):  # noqa: ANN201
    """The sentencepiece model, loaded once in each process."""
    if name not in _models:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if "\n" in piece or SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"{name}: piece {piece!r} crosses a pre-token boundary")
        _models[name] = sp
    return _models[name]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows with a leading space each (empty rows stay empty), and starts, ends and first pre-token of each row."""
    sizes = np.diff(offsets)
    lead = (sizes > 0).astype(np.int64)
    new = np.concatenate([[0], np.cumsum(sizes + lead)])
    out = np.full(new[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(lead), sizes)] = data
    space, feed = out == 32, out == 10
    start = feed.copy()
    start |= space
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= feed[:-1]
    start[new[:-1][sizes > 0]] = True
    starts = np.flatnonzero(start)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, new)


def lengths(sp, items: list[bytes]) -> list[int]:  # noqa: ANN001
    """Tokens of each pre-token."""
    texts, minus = [], []
    for item in items:
        text = item.decode("utf-8")
        if text[0] == " " and len(text) > 1:
            texts.append(text[1:])  # the model puts a space mark before a text
            minus.append(0)
        elif text in (" ", "\n"):
            texts.append("")
            minus.append(-1)
        else:
            texts.append("\n" + text)
            minus.append(2)
    return [len(ids) - m for ids, m in zip(sp.encode(texts, num_threads=1), minus, strict=True)]


def build_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with at most ``PROBES`` probes; what finds no slot is left to the second tier."""
    slots, held = np.zeros(SLOTS + PROBES, np.uint64), np.zeros(SLOTS + PROBES, np.uint16)
    for key, value in zip(keys.tolist(), values.tolist(), strict=True):
        at = key & (SLOTS - 1)
        for i in range(at, at + PROBES):
            if not slots[i]:
                slots[i], held[i] = key, value
                break
    return slots, held


def look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each hash (0 where it is not in the table), and the places of those that are not."""
    slots, held = table
    out = np.zeros(len(hashes), np.int64)
    rest = np.arange(len(hashes))
    at = (hashes & K.U64(SLOTS - 1)).astype(np.int64)
    for probe in range(PROBES):
        place = at[rest] + probe
        found = slots[place] == hashes[rest]
        out[rest[found]] = held[place[found]]
        rest = rest[~found & (slots[place] != 0)] if probe else rest[~found]
        if not len(rest):
            break
    return out, np.flatnonzero(out == 0)


class TwoTiers:
    """Both tiers in one worker."""

    def __init__(self, name: str, table: tuple[np.ndarray, np.ndarray]) -> None:
        self.sp, self.table, self.cache = model(name), table, {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        raw, offsets = K.buffer(column)
        data, starts, ends, first = pretokens(raw, offsets)
        hashes = K.span_hash(data, starts, ends)
        counts, missed = look_up(self.table, hashes)
        if len(missed):
            new, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            cache, blob = self.cache, data.tobytes()
            keys = new.tolist()
            values = [cache.get(k, 0) for k in keys]
            todo = [i for i, v in enumerate(values) if not v]
            if todo:
                spans = missed[where[todo]]
                for i, n in zip(todo, lengths(self.sp, [blob[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)]), strict=True):
                    values[i] = n
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                cache.update((keys[i], values[i]) for i in todo)
            counts[missed] = np.array(values, np.int64)[back]
        sums = np.concatenate([[0], np.cumsum(counts)])
        out = sums[first[1:]] - sums[first[:-1]]
        odd = (raw == 0) | (raw == 0xE2)
        if odd.any():  # the space mark is E2 96 81; other characters also begin with E2
            rows = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)
            for i in rows.tolist():
                text = column[i].as_py()
                if SPACE_MARK in text or "\0" in text:
                    out[i] = len(self.sp.encode(text))
        return out


def frequent(docs: DataFrame, text: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The first tier, from about ``SAMPLE_ROWS`` rows of at most ``SAMPLE_BYTES`` each; no row is shuffled for it."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).sample(share, seed=11).collect()
    seen: Counter = Counter()
    spelled: dict[int, bytes] = {}
    for part in K.slices(pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows], pa.string())], ["text"]), "text"):
        data, starts, ends, _ = pretokens(*K.buffer(part.column("text")))
        blob = data.tobytes()
        for h, at, n in zip(*(x.tolist() for x in np.unique(K.span_hash(data, starts, ends), return_index=True, return_counts=True)), strict=True):
            seen[h] += n
            if h not in spelled:
                spelled[h] = blob[starts[at] : ends[at]]
    keys = [h for h, _ in seen.most_common(FREQUENT)]
    return build_table(np.array(keys, np.uint64), np.array(lengths(model(name), [spelled[h] for h in keys]), np.int64))


def token_counts(docs: DataFrame, name: str = "piece_bpe_32k.model", *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs, text, name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TwoTiers(name, held.value)
        for batch in batches:
            for part in K.slices(batch, "text"):
                _, offsets = K.buffer(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(offsets)), pa.array(counter(part.column("text")))], [key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"{key} {kind}, n_bytes long, n_tokens long")
