"""Bounded-space online packing of documents into token sequences.

Each partition keeps a fixed number of open windows. A document is cut into full sequences and a remainder; the remainder goes
to the open window it fits best; when none fits, the fullest open window is emitted: filled up with the head of the remainder
if its gap is worth a cut, padded otherwise. At the end of a partition its open windows are merged into full sequences and at
most one leftover; leftovers of all partitions are merged best-fit in groups of bounded size.

Memory of a task: ``OPEN`` windows, one slice of text, and a bounded cache of word encodings. Null text counts as empty; a
document always has its closing id, so it lies in at least one piece; an empty table gives an empty result; repeated rows are
packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import files_for, keep

LENGTH = 2048
OPEN = 16
#: a gap below this is padded, not filled by cutting a document
LEAST_CUT = 32
#: leftovers that one task merges
GROUP = 4096
#: words whose ids a worker keeps, about 30 bytes each
CACHE_WORDS = 1_000_000
#: new words that are encoded as one text
JOINED = 500
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"

_tokenizers: dict = {}


def tokenizer(name: str):  # noqa: ANN201
    if name not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        _tokenizers[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _tokenizers[name]


class Encoder:
    """Ids of whole texts from a cache of words: the tokenizer drops white space and never looks across it.

    The cache is sorted arrays (word hashes, places of their ids), shared by the tasks of a worker. At a fixed size, the words that
    the fewest slices of text had go.
    """

    def __init__(self, name: str) -> None:
        self.tok = tokenizer(name)
        self.mark = self.tok.token_to_id(SPECIAL[1])
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint16 if self.tok.get_vocab_size() < 1 << 16 else np.uint32)

    def evict(self) -> None:
        """Halve the cache, or more."""
        least = 2
        while (keep := self.uses >= least).sum() > CACHE_WORDS // 2:
            least += 1
        sizes = np.diff(self.at)
        self.flat = self.flat[np.repeat(keep, sizes)]
        self.at = np.concatenate([[0], np.cumsum(sizes[keep])])
        held, moved = keep[self.slot], (np.cumsum(keep) - 1).astype(np.int32)
        self.keys, self.slot = self.keys[held], moved[self.slot[held]]
        self.uses = self.uses[keep]

    def learn(self, hashes: np.ndarray, items: list[str]) -> None:
        """Encode new words, many in one text with a special token between them."""
        texts = [SPECIAL[1].join(items[i : i + JOINED]) + SPECIAL[1] * (i + JOINED < len(items)) for i in range(0, len(items), JOINED)]
        encoded = [np.array(e.ids, np.int64) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(encoded)
        cut = np.flatnonzero(ids == self.mark)
        if len(cut) != len(items) - 1:  # a word holds the special token: such texts are encoded whole, their words do not matter
            each = [[] if any(x in w for x in SPECIAL) else self.tok.encode(w, add_special_tokens=False).ids for w in items]
            sizes, ids = np.array([len(e) for e in each]), np.array([i for e in each for i in e], np.int64)
        else:
            sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
            ids = np.delete(ids, cut)
        first = len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        self.uses = np.concatenate([self.uses, np.zeros(len(items), np.int32)])
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], np.concatenate([self.slot, np.arange(first, first + len(items), dtype=np.int32)])[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return place, self.keys[place] == hashes

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each row."""
        if len(self.keys) > CACHE_WORDS:
            self.evict()
        data, offsets = K.buffer(column)
        starts, ends, first = K.words(data, offsets)
        new, where, back = np.unique(K.span_hash(data, starts, ends), return_index=True, return_inverse=True)
        place, known = self.find(new)
        if not known.all():
            blob, spans = data.tobytes(), where[~known]
            self.learn(new[~known], [blob[a:b].decode("utf-8", "replace") for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            place, _ = self.find(new)
        entry = self.slot[place][back] if len(new) else np.zeros(0, np.int64)
        if len(new):
            self.uses[self.slot[place]] += 1
        sizes = (self.at[1:] - self.at[:-1])[entry]
        ends_of = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.at[entry] - ends_of[:-1], sizes) + np.arange(ends_of[-1])].astype(np.uint32)
        bounds = ends_of[first]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if (data == 124).any():  # the special strings hold a bar
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(data == 124), "right") - 1).tolist():
                text = column[i].as_py()
                if any(s in text for s in SPECIAL):
                    out[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this worker process."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Packer:
    """The open windows of a partition. A window is ``[fill, sequence, pieces]``; a piece is ``(row, start, ids, doc_tokens)``."""

    def __init__(self, partition: int) -> None:
        self.next = partition << 36
        self.open: list[list] = []
        self.rows: list[tuple] = []

    def fresh(self) -> list:
        self.next += 1
        return [0, self.next, []]

    def emit(self, window: list, left: bool = False) -> None:
        at = 0
        for key, start, ids, total in window[2]:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, window[1], at, left))
            at += len(ids)

    @staticmethod
    def put(window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[2].append(piece)

    def add(self, key, ids: np.ndarray) -> None:  # noqa: ANN001
        total, start = len(ids), 0
        while total - start >= LENGTH:
            window = self.fresh()
            self.put(window, (key, start, ids[start : start + LENGTH], total))
            self.emit(window)
            start += LENGTH
        while start < total:
            size = total - start
            fitting = [w for w in self.open if w[0] + size <= LENGTH]
            if fitting:
                window = max(fitting, key=lambda w: w[0])
            elif len(self.open) < OPEN:
                window = self.fresh()
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                gap = LENGTH - window[0]
                if gap >= LEAST_CUT:
                    self.put(window, (key, start, ids[start : start + gap].copy(), total))
                    start += gap
                self.open.remove(window)
                self.emit(window)
                continue
            self.put(window, (key, start, ids[start:].copy(), total))
            start = total
            if window[0] == LENGTH:
                self.open.remove(window)
                self.emit(window)

    def close(self) -> None:
        """Merge what is open: the emptiest window's pieces fill up the fullest."""
        todo = sorted((w for w in self.open if w[0]), key=lambda w: -w[0])
        self.open = []
        while len(todo) > 1:
            into, source = todo[0], todo[-1]
            while source[2] and into[0] < LENGTH:
                key, start, ids, total = source[2].pop()
                gap = LENGTH - into[0]
                if len(ids) > gap:
                    source[2].append((key, start + gap, ids[gap:], total))
                    source[0] -= gap
                    ids = ids[:gap]
                else:
                    source[0] -= len(ids)
                self.put(into, (key, start, ids, total))
            if not source[2]:
                todo.pop()
            if into[0] == LENGTH:
                self.emit(todo.pop(0))
        for window in todo:
            self.emit(window, left=window[0] < LENGTH)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best-fit decreasing over one group of leftovers (``sequence_id``, ``filled``): where each one goes."""
    items = [(n, s) for b in batches for s, n in zip(b.column("sequence_id").to_pylist(), b.column("filled").to_pylist(), strict=True)]
    windows: list[list[int]] = []
    out = []
    for filled, sequence in sorted(items, key=lambda x: (-x[0], x[1])):
        fitting = [w for w in windows if w[0] + filled <= LENGTH]
        window = max(fitting, key=lambda w: w[0]) if fitting else [0, sequence]
        if not fitting:
            windows.append(window)
        out.append((sequence, window[1], window[0]))
        window[0] += filled
        if window[0] == LENGTH:
            windows.remove(window)
    if out:
        a, b, c = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], ["sequence_id", "into", "base"])


def pack(docs: DataFrame, name: str = "word_bpe_49k.json", closing_id: int = 1, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, where it starts in its document, its length and CRC, its sequence and offset there."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {PIECE}"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(name), Packer(TaskContext.get().partitionId())
        last = np.array([closing_id], np.uint32)
        key_type = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.take(), strict=True))
            kinds = [key_type, *[pa.int64()] * 6, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"])

        for batch in batches:
            key_type = batch.column("key").type
            for part in K.slices(batch, "text"):
                for k, ids in zip(part.column("key").to_pylist(), encode(part.column("text")), strict=True):
                    packer.add(k, np.concatenate([ids, last]))
                if packer.rows:
                    yield rows()
        packer.close()
        if packer.rows:
            yield rows()

    pieces = keep(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(place, schema), files_for(docs))
    left = pieces.where("open")
    filled = left.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    groups = max(1, -(-filled.count() // GROUP))
    moves = filled.repartition(groups, F.xxhash64("sequence_id")).mapInArrow(merge_groups, "sequence_id long, into long, base long")
    moved = left.join(moves, "sequence_id").select(key, "start", "length", "ids_crc32", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("base") + F.col("offset")).alias("offset"))
    return pieces.where("NOT open").select(*moved.columns).unionByName(moved)
