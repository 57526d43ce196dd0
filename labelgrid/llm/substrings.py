"""Substring dedup: words covered by a window of ``WINDOW`` words that an earlier document (smaller id) also has are removed.

The documents themselves are the reference, so it grows with the input and cannot be broadcast. It is narrowed exactly, and
cut into shards that tasks hold one at a time:

1. Every window has an anchor, the least hash of the word sequences of a given length in it, so equal windows have equal anchors.
   Anchors that only one document has are dropped; pre-aggregated, no task sees a list of documents.
2. In the documents left, consecutive windows with one anchor form a segment (a long one is cut, each window stays in one part).
   Segments with the same words are one: all but those of the smallest id are removed whole.
3. Where an anchor is left with different segments, their common windows are found by suffix automata: the segments of a shard
   (``SHARD_WORDS`` words, whole anchors dealt by hash) are put into one automaton whose states know the smallest id of their
   occurrences; streaming each segment through it gives its matching statistics, and each position matched for ``WINDOW`` words
   or more asks its state.
4. The segments of an anchor that a shard cannot hold are cut again, by anchors of longer sequences (``GRAMS``), and go through
   steps 2 and 3 as their own documents. Anchors of the last length are windows themselves: their segments have the same words.
   So an automaton never holds more than two shards' words, whatever is repeated how often, and no pair is ever formed.
5. The maximal spans of each document are joined to it and cut out. Documents without any never leave their partition.

Null or empty text has no words. Rows without an id are neither cut nor referred to; rows that repeat an id are cut each by its
own text, and never by one another. Ids are of any type that has an order. Columns of any name pass through. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import files_for, forget, id_filter, keep, packed, split_by, with_own

WINDOW = 50
#: words of the sequences whose least hash is an anchor, for each cut of a segment
GRAMS = (16, 28, 40, WINDOW)
#: words of the segments of one anchor, and of all anchors of a shard but its last, at most
SHARD_WORDS = 30_000
#: windows of a segment at most
SEGMENT_WINDOWS = 1024


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def least_grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """The least hash of ``gram`` words in the window that starts at each word."""
    return sliding_min(K.gram_hash(hashes, gram), WINDOW - gram + 1)


def window_anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first word of each row, and the anchor of the window that starts at each word (windows may cross rows)."""
    data, offsets = K.buffer(column)
    starts, ends, first = K.words(data, offsets)
    hashes = K.span_hash(data, starts, ends)
    return hashes, first, least_grams(hashes, GRAMS[0])


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text"):
            _, first, least = window_anchors(part.column("text"))
            found = [np.unique(least[a : max(a, b - WINDOW + 1)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["id", "th", "anchors"])


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values, none longer than ``SEGMENT_WINDOWS``."""
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(edge, len(own)))
    parts = -(-size // SEGMENT_WINDOWS)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(edge, parts) + at * SEGMENT_WINDOWS
    return starts, np.minimum(np.repeat(size, parts) - at * SEGMENT_WINDOWS, SEGMENT_WINDOWS)


FOUND = ["p", "q", "id", "anchor", "segment", "start", "n", "words"]


def _found(p: pa.Array, q: pa.Array, ids: pa.Array, anchor: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Segments that begin at the words ``at``: their parents, owners, first window there, and the hashes of all their words."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * K._power("up", len(hashes))[: len(hashes)], dtype=np.uint64)])
    end = at + n + WINDOW - 1
    whole = K.mix((sums[end] - sums[at]) * K._power("down", len(hashes))[at] + n.astype(np.uint64))
    raw = [hashes[a:b].tobytes() for a, b in zip(at.tolist(), end.tolist(), strict=True)]
    own = [pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays([p, q, ids, *own], FOUND)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the windows whose anchor is in the row's list; their parent is the row."""
    for batch in batches:
        for part in K.slices(batch, "text"):
            hashes, first, least = window_anchors(part.column("text"))
            rows: list[int] = []
            starts, counts, ids = [], [], []
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = least[a : max(a, b - WINDOW + 1)]
                if not len(own):
                    continue
                run, size = _runs(own)
                wanted = np.isin(own[run], np.array(part.column("anchors")[i].as_py(), np.int64).view(np.uint64))
                starts.append(run[wanted] + a)
                counts.append(size[wanted])
                rows += [i] * int(wanted.sum())
                ids.append(run[wanted])
            if rows:
                at, pick = np.concatenate(starts), pa.array(rows)
                yield _found(part.column("th").take(pick), pa.array(np.zeros(len(rows), np.int64)), part.column("id").take(pick), least[at], hashes, at, np.concatenate(counts), np.concatenate(ids))


def refined(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over segments (``anchor``, ``segment``, ``id``, ``words``): what they are cut into by the next anchors.

    Equal windows of an anchor have equal next anchors too. At the last length a segment's words are those of any other of its
    anchor (but for how often they come round), so the anchor stands for them.
    """

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                coarse = np.int64(batch.column("anchor")[i].as_py()).view(np.uint64)
                least = K.mix(least_grams(hashes, GRAMS[level]) + K.mix(np.array([coarse])))
                at, n = _runs(least)
                same = pa.array(np.zeros(len(at), np.int32))
                out = _found(*(batch.column(c).slice(i, 1).take(same) for c in ("anchor", "segment", "id")), least[at], hashes, at, n, at)
                if level == len(GRAMS) - 1:
                    out = out.set_column(4, "segment", out.column("anchor")).set_column(7, "words", pa.nulls(len(at), pa.binary()))
                yield out

    return cut_again


class Automaton:
    """Generalised suffix automaton over word symbols; each state knows the smallest id among the ends of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.low = [-1], [0], [None]

    def add(self, symbols: list, owner: int) -> None:
        nexts, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for c in symbols:
            p = last
            if c in nexts[p]:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    last = q
                else:
                    last = self._clone(p, q, c)
            else:
                cur = len(nexts)
                nexts.append({})
                length.append(length[p] + 1)
                low.append(None)
                link.append(0)
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nexts[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            if low[last] is None or owner < low[last]:
                low[last] = owner

    def _clone(self, p: int, q: int, c) -> int:  # noqa: ANN001
        made = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.low.append(None)
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def close(self) -> None:
        """Give each state the smallest id of the states whose suffix it is."""
        low, link = self.low, self.link
        for v in sorted(range(1, len(low)), key=self.length.__getitem__, reverse=True):
            u = link[v]
            if u > 0 and low[v] is not None and (low[u] is None or low[v] < low[u]):
                low[u] = low[v]

    def earlier(self, symbols: list, owner: int, window: int) -> list[int]:
        """Where the windows start that an owner below ``owner`` also has, from the matching statistics of ``symbols``."""
        nexts, link, length, low = self.next, self.link, self.length, self.low
        out, state, matched = [], 0, 0
        for i, c in enumerate(symbols):
            while state and c not in nexts[state]:
                state = link[state]
                matched = length[state]
            if c in nexts[state]:
                state = nexts[state][c]
                matched += 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                    matched = length[state]
                if low[state] < owner:
                    out.append(i - window + 1)
        return out


def _spans(windows: list[int]) -> list[dict]:
    """The maximal spans that ascending windows cover."""
    out: list[dict] = []
    for w in windows:
        if out and w <= out[-1]["b"]:
            out[-1]["b"] = w + WINDOW
        else:
            out.append({"a": w, "b": w + WINDOW})
    return out


def resolve_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (``anchor``, ``segment``, ``id``, ``words``) sorted by anchor: for each segment the spans that an earlier id has."""

    def solve(shard: list[tuple]) -> pa.RecordBatch:
        auto = Automaton()
        texts = [np.frombuffer(words, np.uint64).tolist() for _, _, _, words in shard]
        for (_, _, owner, _), symbols in zip(shard, texts, strict=True):
            auto.add(symbols, owner)
        auto.close()
        found = [(a, s, _spans(w)) for (a, s, owner, _), symbols in zip(shard, texts, strict=True) for w in [auto.earlier(symbols, owner, WINDOW)] if w]
        a, s, spans = zip(*found, strict=True) if found else ((), (), ())
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(spans, kind)], ["anchor", "segment", "found"])

    shard: list[tuple] = []
    size = 0
    for batch in batches:
        columns = (batch.column(c) for c in ("anchor", "segment", "id", "words"))
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            if size > SHARD_WORDS * 8 and row[0] != shard[-1][0]:
                yield solve(shard)
                shard, size = [], 0
            shard.append(row)
            size += len(row[3])
    if shard:
        yield solve(shard)


class _Search:
    """Spans that earlier ids have, and the tables kept on the way."""

    def __init__(self, files: int | None) -> None:
        self.files = files
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables.append(keep(df, self.files))
        return self.tables[-1]

    def spans(self, found: DataFrame, level: int = 0) -> DataFrame:
        """``p``, ``q``, ``id``, ``start``, ``end`` of what goes from the parents of the segments ``found``."""
        first = self.keep(found.groupBy("anchor", "segment").agg(F.min("id").alias("low"), F.max("n").alias("size")))
        # kept by itself, so that the join's sides are plain exchanges and the segments of a hot anchor can be split among tasks
        rivals = self.keep(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("rivals"), F.sum(F.col("size") + WINDOW - 1).alias("total")).where("rivals > 1"))
        first = first.drop("size").join(rivals, "anchor", "left")
        # segments that an earlier document has whole
        same = found.drop("words").join(first, ["anchor", "segment"])
        spans = same.where("low < id").select("p", "q", "id", "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end"))
        if level == len(GRAMS) - 1:
            return spans
        # first occurrences of segments that share their anchor with others
        chosen = found.join(first.where("rivals > 1"), ["anchor", "segment"]).where("id = low")
        open_ = self.keep(chosen.dropDuplicates(["anchor", "segment"]).select("anchor", "segment", "id", "words", (F.col("total") <= SHARD_WORDS).alias("fits")))
        by_shard = open_.where("fits").drop("fits").repartition("anchor").sortWithinPartitions("anchor", "segment")
        some = by_shard.mapInArrow(resolve_shards, "anchor long, segment long, found array<struct<a:int,b:int>>")
        large = open_.where("NOT fits").drop("fits")
        if not large.isEmpty():
            kind = found.schema["id"].dataType.simpleString()
            finer = self.keep(large.mapInArrow(refined(level + 1), _schema(kind)))
            deeper = self.spans(finer, level + 1).groupBy(F.col("p").alias("anchor"), F.col("q").alias("segment"))
            some = some.unionByName(deeper.agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("b"))).alias("found")))
        partial = same.where("low = id AND rivals > 1").join(some, ["anchor", "segment"]).select("p", "q", "id", "start", F.explode("found").alias("x"))
        return spans.unionByName(partial.select("p", "q", "id", (F.col("start") + F.col("x.a")).alias("start"), (F.col("start") + F.col("x.b")).alias("end")))


def _schema(kind: str) -> str:
    return f"p long, q long, id {kind}, anchor long, segment long, start int, n int, words binary"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``spans`` (arrays of first word and end) of the documents from which words go."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    search = _Search(files_for(docs))
    listed = search.keep(plain.mapInArrow(anchors, f"id {kind}, th long, anchors array<long>"))
    each = listed.select("id", "th", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    wanted = search.keep(each.join(shared, "anchor").groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors")))
    near, _ = split_by(plain, id_filter(wanted, "id"), "id")
    found = search.keep(near.dropDuplicates(["id", "th"]).join(wanted, ["id", "th"]).select("id", "th", "text", "anchors").mapInArrow(segments, _schema(kind)))
    out = search.spans(found).groupBy("id", F.col("p").alias("th")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    out = keep(out, search.files)
    forget(*search.tables)
    return out


def cut(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rest`` (all other columns of ``docs``), ``text``, ``n_words`` and ``n_removed``; where words went, ``text`` is what is
    left, joined by single spaces."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                data, offsets = K.buffer(part.column("text"))
                starts, ends, first = K.words(data, offsets)
                blob = data.tobytes()
                texts, removed = part.column("text").to_pylist(), [0] * part.num_rows
                lists = part.column("spans").to_pylist() if "spans" in part.schema.names else [None] * part.num_rows
                for i, spans_of in enumerate(lists):
                    if spans_of:
                        a, b = first[i], first[i + 1]
                        change = np.zeros(b - a + 1, np.int32)
                        np.add.at(change, [s["start"] for s in spans_of], 1)
                        np.add.at(change, [s["end"] for s in spans_of], -1)
                        left = np.flatnonzero(np.cumsum(change[:-1]) == 0) + a
                        removed[i] = int(b - a - len(left))
                        texts[i] = b" ".join([blob[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]).decode("utf-8", "replace")
                columns = [part.column("rest"), pa.array(texts, pa.string()), pa.array(np.diff(first)), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_words", "n_removed"])

    rows = packed(docs, text)
    schema = with_own(rows, ("n_words", "bigint"), ("n_removed", "bigint"))
    marked = rows.withColumns({"id": F.col("rest").getField(key), "th": F.xxhash64("text")})
    maybe, never = split_by(marked, id_filter(spans, "id"), "id")
    joined = maybe.join(spans, ["id", "th"], "left").select("rest", "text", "spans")
    return joined.mapInArrow(apply, schema).unionByName(never.select("rest", "text").mapInArrow(apply, schema))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return cut(docs, repeated_spans(docs, key, text), key, text)
