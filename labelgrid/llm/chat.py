"""Chat formatting by token-level assembly.

Every segment (role, text) is encoded on its own, where its row lies; the assembly splices reserved ids between segments, so no
text can make a control token, and derives the loss mask from prefix sums of +1 and -1 at the ends of assistant texts. Control
strings that occur in a text, and the escape character itself, are escaped, so the formatted string reads back without doubt.

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...

Conversations are streamed in turn order; a long one comes in chunks of whole turns, so a task holds a bounded number of tokens
beside one turn, even if one conversation has most of the rows.

Null text or role counts as empty. Rows of equal turn stand by role, then text; a null turn stands first. Rows without conv_id
are one conversation with a null id. Repeated rows are turns each. An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
LEARNER = "assistant"
#: tokens after which a chunk ends
CHUNK = 1 << 16
_ESCAPED = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPES = re.compile(r"\\(\\|" + "|".join(map(re.escape, CONTROLS)) + ")")
_encoders: dict = {}


def encoder(name: str):  # noqa: ANN201
    """The encoding of this process; reserved ids follow the vocabulary's."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1
    return _encoders[name]


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPES.sub(lambda m: m[1], text)


CHUNKS = "chunk int, ids array<int>, loss_mask array<boolean>, formatted string"


def format_chats(conversations: DataFrame, name: str = VOCABULARY, *, key: str = "conv_id") -> DataFrame:
    """``key``, ``chunk``, ``ids``, ``loss_mask`` and ``formatted``; the chunks of a conversation follow one another in a partition."""
    kind = conversations.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoder(name)
        for batch in batches:
            coded = [
                pa.array([np.array(coder.encode_ordinary(escape(t or "")), np.int32).tobytes() for t in batch.column(c).to_pylist()], pa.binary())
                for c in ("role", "text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("turn"), batch.column("role"), batch.column("text"), *coded], [key, "turn", "role", "text", "role_ids", "text_ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(name)
        begin, end, left, right = (np.array([base + i], np.int32) for i in range(len(CONTROLS)))
        conversation, started = None, False
        ids: list[np.ndarray] = []
        marks: list[tuple[int, int]] = []
        shown: list[str] = []
        size = chunk = 0

        def emit(key_type: pa.DataType) -> pa.RecordBatch:
            change = np.zeros(size + 1, np.int32)
            for a, b in marks:
                change[a] += 1
                change[b] -= 1
            mask = np.cumsum(change[:-1]) > 0
            columns = [pa.array([conversation], key_type), pa.array([chunk], pa.int32()), pa.array([np.concatenate(ids)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_())), pa.array(["".join(shown)])]
            return pa.RecordBatch.from_arrays(columns, [key, "chunk", "ids", "loss_mask", "formatted"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(key).type
            for conv, role, text, role_ids, text_ids in zip(*(batch.column(c).to_pylist() for c in (key, "role", "text", "role_ids", "text_ids")), strict=True):
                new = not started or conv != conversation
                if started and (new or size >= CHUNK):
                    yield emit(key_type)
                    ids, marks, shown, size, chunk = [], [], [], 0, 0 if new else chunk + 1
                if new:
                    conversation, started = conv, True
                    ids.append(begin)
                    shown.append(CONTROLS[0])
                    size = 1
                said, words = np.frombuffer(role_ids, np.int32), np.frombuffer(text_ids, np.int32)
                at = size + len(said) + 2
                if role == LEARNER:
                    marks.append((at, at + len(words)))
                ids += [left, said, right, words, end]
                size = at + len(words) + 1
                shown.append(f"{CONTROLS[2]}{escape(role or '')}{CONTROLS[3]}{escape(text or '')}{CONTROLS[1]}")
        if started:
            yield emit(key_type)

    rows = conversations.select(key, F.col("turn").cast("long").alias("turn"), "role", "text")
    coded = rows.mapInArrow(encode, f"{key} {kind}, turn long, role string, text string, role_ids binary, text_ids binary")
    ordered = coded.repartition(key).sortWithinPartitions(key, "turn", "role", "text")
    return ordered.mapInArrow(assemble, f"{key} {kind}, {CHUNKS}")


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, name: str = VOCABULARY, *, key: str = "conv_id") -> DataFrame:
    """What the ids and masks of ``format_chats`` say, one row per conversation; nothing else of it is read but the length of the string."""
    kind = formatted.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, base = encoder(name)
        end, right = base + 1, base + 3
        state: list | None = None

        def finish(key_type: pa.DataType) -> pa.RecordBatch:
            conv, turns, digest, loss_chars, loss, chars = state
            columns = [pa.array([conv], key_type), *(pa.array([v]) for v in (turns, digest.hexdigest(), loss_chars, loss.hexdigest(), chars))]
            return pa.RecordBatch.from_arrays(columns, [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(key).type
            for i in range(batch.num_rows):
                conv, chunk = batch.column(key)[i].as_py(), batch.column("chunk")[i].as_py()
                if not chunk:
                    if state:
                        yield finish(key_type)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = batch.column("ids")[i].values.to_numpy()
                mask = batch.column("loss_mask")[i].values.to_numpy(zero_copy_only=False)
                state[5] += len(batch.column("formatted")[i].as_py())
                control = np.flatnonzero(ids >= base)
                for a, b in zip(control[:-1].tolist(), control[1:].tolist(), strict=True):
                    if ids[b] == right or ids[b] == end:
                        said = unescape(coder.decode_bytes(ids[a + 1 : b].tolist()).decode("utf-8"))
                        state[2].update(said.encode() + b"\n")
                        state[1] += int(ids[b] == end)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    learned = unescape(coder.decode_bytes(ids[a:b].tolist()).decode("utf-8"))
                    state[3] += len(learned)
                    state[4].update(learned.encode())
        if state:
            yield finish(key_type)

    return formatted.mapInArrow(read, f"{key} {kind}, {DIGEST}")
