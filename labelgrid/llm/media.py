"""Interleaved document sequences: text and media references in page order, payloads resolved by digest.

Parsing an HTML page gives its items in order: runs of text, and media references (``sha256:`` sources of img, audio, video,
source, embed and object) with their captions, a figure's caption before an alt text. Media are stored once per digest (tasks do
not see each other's, so it may lie there once for each task; readers take one). A digest join resolves every reference; position
and caption travel with the reference, so they stay aligned however many documents share a payload. What is computed from a
payload is computed before the join, so copies move only narrow rows; a digest that many references share is split by Spark's
skew join.

Payloads are stored as 8-bit RGB images 64 pixels wide (PNG, no row filter), clips of ``ROW`` samples as 8-bit sound (WAV, one
channel); both keep every byte. The digest of an image is that of its payload, that of a clip also covers its kind.

Null html or text counts as empty. A reference whose digest is not stored keeps its position and caption, with nulls for the
rest. Rows that repeat an id or a payload are resolved each. Empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import files_for, keep

WIDTH = 64
ROW = 3 * WIDTH
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "media", "embed": "media", "object": "media"}
_HIDDEN = {"script", "style", "template", "noscript"}
_PREFIX = "sha256:"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[list[dict]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            given = dict(attrs)
            source = given.get("src") or given.get("data") or ""
            if source.startswith(_PREFIX):
                self.flush()
                item = {"kind": _MEDIA[tag], "text": None, "digest": source[len(_PREFIX) :].lower(), "caption": given.get("alt")}
                self.items.append(item)
                if self.figures:
                    self.figures[-1].append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figures[-1] if self.figures else []:
                item["caption"] = said
        elif tag == "figure" and self.figures:
            self.figures.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return [{"position": i, **item} for i, item in enumerate(reader.items)]


def sequences(pages: DataFrame, *, key: str, html: str = "html", carry: tuple = ()) -> DataFrame:
    """``key``, the columns to ``carry`` and ``items`` of every page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(c) for c in carry), pa.array([parse(h) for h in part.column("html").to_pylist()], kind)], [key, *carry, "items"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html"), *carry).mapInArrow(read, f"{kinds}, items {ITEMS}")


def resolve(sequences_of: DataFrame, media: DataFrame, *, key: str) -> DataFrame:
    """One row per item: ``key``, its fields, and the columns of ``media`` (one row per ``digest``) for media references."""
    items = sequences_of.select(*(c for c in sequences_of.columns if c != "items"), F.inline("items"))
    # runs of text have no digest: a name of their own keeps them from meeting in one task
    named = items.withColumn("named", F.coalesce("digest", F.concat_ws(" ", F.col(key).cast("string"), F.col("position").cast("string"))))
    return named.join(media.withColumnRenamed("digest", "named"), "named", "left").drop("named")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload (a positive multiple of ``ROW`` bytes)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")


def encode_sound(payload: bytes) -> bytes:
    """A WAV file whose samples are the payload."""
    form = struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def decode(media: bytes) -> bytes:
    """The samples of a stored image or sound; every chunk's CRC is checked where the format has one."""
    if media[:4] == b"RIFF":
        (size,) = struct.unpack_from("<I", media, 40)
        if len(media) != 44 + size:
            raise ValueError("stored media: a sound's size does not match")
        return media[44:]
    at, body, height = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("stored media: a chunk's CRC does not match")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", data, 4)[0]
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, ROW + 1)
    if rows[:, 0].any():
        raise ValueError("stored media: a row is filtered")
    return rows[:, 1:].tobytes()


def digest_of(payload: bytes, kind: str = "image") -> str:
    return hashlib.sha256(payload if kind == "image" else kind.encode() + b":" + payload).hexdigest()


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, then spaces up to a positive multiple of ``ROW``."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % ROW if data else ROW)


def feature(payload: bytes) -> str:
    """Height, mean and entropy of the samples, and a 64-bit hash of which of 64 equal stretches are brighter than the mean."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum())
    edges = np.linspace(0, len(samples), 65).astype(np.int64)
    means = np.add.reduceat(samples.astype(np.float64), edges[:-1]) / np.maximum(1, np.diff(edges))
    bits = "".join("1" if m > samples.mean() else "0" for m in means)
    return f"{len(samples) // ROW}|{samples.mean():.3f}|{entropy:.3f}|{int(bits, 2):016x}"


#: digests that a task remembers, so that it stores a payload once
SEEN = 200_000


def store_texts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The media store of all texts, written to the shared folder: ``digest`` and ``media``, for each text the image of its payload
    and a clip of its last ``ROW`` bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for part in K.slices(batch, "text"):
                digests, media = [], []
                for t in part.column("text").to_pylist():
                    payload = payload_of(t)
                    for kind, samples, make in (("image", payload, encode), ("audio", payload[-ROW:], encode_sound)):
                        digest = digest_of(samples, kind)
                        if digest not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(digest)
                            digests.append(digest)
                            media.append(make(samples))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])

    return keep(docs.select(F.col(text).alias("text")).mapInArrow(write, "digest string, media binary"), files_for(docs))


READ_BACK = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """What the stored bytes say, one row per digest."""
    names = [f.split()[0] for f in READ_BACK.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist(), strict=True):
                payload = decode(media)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    told = store.mapInArrow(read, READ_BACK)
    return told.groupBy("digest").agg(F.first(F.struct(*names[1:])).alias("told")).select("digest", "told.*")


def page_of(text: str, n_bytes: int) -> str:
    """A page that shows a text in two runs, with the image of its payload between them and a clip of its end behind them."""
    payload = payload_of(text)
    half = len(text) // 2
    while half < len(text) and not text[half].isspace():
        half += 1
    figure = '<figure><{0} src="{1}{2}" alt="{3}"><figcaption>{4}</figcaption></figure>'.format
    image = figure("img", _PREFIX, digest_of(payload), "document", f"{n_bytes} bytes of text")
    clip = figure("audio", _PREFIX, digest_of(payload[-ROW:], "audio"), "clip", f"the last {ROW} samples")
    return f"<article><p>{escape(text[:half], quote=False)}</p>{image}<p>{escape(text[half:], quote=False)}</p>{clip}</article>"


def text_pages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A page for every row: ``page`` (its number), ``key``, ``n_bytes``, ``html``."""
    schema = f"page long, {key} {docs.schema[key].dataType.simpleString()}, n_bytes long, html string"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text"):
                _, offsets = K.buffer(part.column("text"))
                sizes = np.diff(offsets)
                pages = [page_of(t or "", n) for t, n in zip(part.column("text").to_pylist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page"), part.column("key"), pa.array(sizes), pa.array(pages, pa.string())], ["page", key, "n_bytes", "html"])

    return docs.select(F.monotonically_increasing_id().alias("page"), F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(build, schema)
