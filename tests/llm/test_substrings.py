"""Substring dedup against a dictionary of windows."""

import random
import re

import pytest

from labelgrid.llm import substrings as S
from labelgrid.llm.common import unpacked

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    first, out = {}, {}
    docs = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)
    for i, w in docs:
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, w in docs:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def check(spark, rows):
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("rest.doc_id", "text", "n_words", "n_removed").collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, gone, left = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (n, gone)
        assert r["text"] == left if gone else True
    return sum(g for _, g, _ in want.values())


def test_table(spark):
    assert check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]) > 0


@pytest.mark.parametrize("windows", [S.SEGMENT_WINDOWS, 7])
@pytest.mark.parametrize("words", [S.SHARD_WORDS, 1000, 60])
def test_overlapping_passages(spark, monkeypatch, windows, words):
    monkeypatch.setattr(S, "SEGMENT_WINDOWS", windows)
    monkeypatch.setattr(S, "SHARD_WORDS", words)
    r = random.Random(1)
    base = [str(i) for i in range(300)]
    rows = []
    for i in range(150):
        a, b = r.randrange(220), r.randrange(250)
        rows.append((i * 7, " ".join(base[a : a + r.randrange(140)] + [f"q{i}"] * r.randrange(3) + base[b : b + r.randrange(90)])))
    assert check(spark, rows) > 1000


def test_repeats_inside_a_document_stay(spark):
    line = " ".join(f"w{i}" for i in range(10)) + "\n"
    assert check(spark, [(1, line * 30), (2, "x")]) == 0
    assert check(spark, [(1, line * 30), (2, line * 9)]) == 90


def test_one_word_repeated_many_times(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_WORDS", 2000)
    rows = [(1, "b " * 60 + "a " * 2500), (2, "a " * 50_000), (3, "x " + "a " * 49 + "y"), (4, "a " * 700 + "b " * 70), (5, "b a " * 400), (6, "a b " * 90)]
    assert check(spark, rows) > 50_000


def test_a_hot_anchor_is_cut_into_bounded_shards(spark, monkeypatch):
    """Passages that share 42 words and differ before or after them: one anchor, more words than a shard holds."""
    monkeypatch.setattr(S, "SHARD_WORDS", 3000)
    most = []
    add = S.Automaton.add

    def counted(self, symbols, owner):
        add(self, symbols, owner)
        most.append(len(self.next))

    monkeypatch.setattr(S.Automaton, "add", counted)
    r = random.Random(5)
    base = [f"m{i}" for i in range(42)]
    ends = [[f"e{k}_{i}" for i in range(30)] for k in range(150)]
    rows = [(i, " ".join([f"s{i}"] * r.randrange(3) + r.choice(ends)[::-1] + base + r.choice(ends))) for i in range(600)]
    check(spark, rows)
    # the same in this process: what a shard's automaton holds is bounded by its words
    words = [t.split() for _, t in rows]
    batch = S.pa.RecordBatch.from_pydict({"anchor": S.pa.array([k // 30 for k in range(600)], S.pa.int64()), "segment": list(range(600)), "id": list(range(600)), "words": [S.np.array([hash(w) & (2**63 - 1) for w in ws], S.np.uint64).tobytes() for ws in words]})
    shards = list(S.resolve_shards(iter([batch])))
    assert len(shards) > 5 and max(most) <= 4 * 2 * 3000


def test_odd_rows(spark):
    text = " ".join(f"é{i}" for i in range(60))
    rows = [(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 4), (4, text, 5), (None, text, 6)]
    schema = "doc_id long, text string, th int"
    for extra in ("n_words", "n_removed", "id", "spans", "rest", "__id", "__th", "__spans", "__bit", "part", "bits"):
        schema += f", `{extra}` int"
    docs = spark.createDataFrame([(*r, *[7] * 11) for r in rows], schema)
    out = S.remove_repeats(docs)
    assert out.select(*unpacked(docs, "text")).schema == docs.schema
    got = out.select("text", "n_removed", "rest.th", "rest.n_removed", "rest.__spans").collect()
    assert sorted((r["th"], r[1], r["text"]) for r in got) == [(1, 0, None), (2, 0, ""), (3, 0, text), (4, 0, text), (5, 60, ""), (6, 0, text)]
    assert all(r[3] == r[4] == 7 for r in got)
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = S.remove_repeats(spark.createDataFrame([("b", text), ("a", text + " end"), (None, text)], "doc_id string, text string")).select("rest.doc_id", "n_removed").collect()
    assert sorted((r["doc_id"] or "", r["n_removed"]) for r in got) == [("", 0), ("a", 0), ("b", 60)]


def test_automaton():
    a = S.Automaton()
    a.add([1, 2, 3, 4, 2, 3], 9)
    a.add([2, 3, 4], 4)
    a.close()
    assert a.earlier([2, 3, 4, 2], 9, 3) == [0]
    assert a.earlier([3, 4, 2, 3], 10, 3) == [0, 1]
    assert a.earlier([1, 2, 3], 9, 3) == []
