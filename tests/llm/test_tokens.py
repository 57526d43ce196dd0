"""Token counts and packing against the libraries."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from labelgrid.llm import packing as P
from labelgrid.llm import token_counts as C

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a \n\n b\t▁c\x00 d", "\n\n  \nfoo  bar   ", "€€ “q” ▁▁ x", "日本語 テスト\n\n\t x", " </s> <s> [INST] a", "x" * 5000, "a \x85b é é İ ſ <|endoftext|> it's 12"]


def test_counts(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD
    sp = C.model("piece_bpe_32k.model")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("n", "n_tokens")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in C.token_counts(df).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab.,é▁日\x00'1|<>s")), max_size=25), max_size=6))
def test_any_text(texts):
    counter = C.TwoTiers("piece_bpe_32k.model", C.build_table(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert counter(pa.array(texts, pa.string())).tolist() == [len(counter.sp.encode(t)) for t in texts]
    encode = P.Encoder("word_bpe_49k.json")
    assert [x.tolist() for x in encode(pa.array(texts, pa.string()))] == [encode.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_two_tiers_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    full = C.TwoTiers("piece_bpe_32k.model", C.frequent(docs, "text", "piece_bpe_32k.model"))
    none = C.TwoTiers("piece_bpe_32k.model", C.build_table(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    column = pa.array([r["text"] for r in docs.select("text").collect()], pa.string())
    assert full(column).tolist() == none(column).tolist() and len(full.cache) < len(none.cache)


def test_eviction_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 40)
    encode = P.Encoder("word_bpe_49k.json")
    for i in range(30):
        texts = [f"the same word {j} new{i}x{j} {ODD[9]}" for j in range(i % 9)] + ODD
        want = [encode.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encode(pa.array(texts, pa.string()))] == want
        assert len(encode.keys) < 200


def pieces(spark, texts):
    rows = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    tok = P.tokenizer("word_bpe_49k.json")
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= P.LENGTH
    return sum(len(i) for i in ids.values()), len(by_sequence)


def test_packing(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    total, sequences = pieces(spark, texts + ODD)
    assert sequences * P.LENGTH < 1.06 * total
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_short_documents(spark):
    total, sequences = pieces(spark, [f"word{i} " * (i % 50) for i in range(900)])
    assert sequences <= -(-total // P.LENGTH) + 3
