"""Near-duplicates against brute force over word tuples."""

import collections
import random
import re

import pytest

from labelgrid.llm import near_dups
from labelgrid.llm.components import components
from labelgrid.llm.near_dups import near_duplicates

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, (t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}
    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    shared = collections.Counter((a, b) for ids in lists.values() for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


def check(spark, rows):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    return want


def test_table(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_edits_around_the_threshold(spark):
    r = random.Random(3)
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(r.choice([6, 30, 120]))]
        for copy in range(25):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = f"x{r.random()}"
            if r.random() < 0.2:
                words = [f"pre{copy}"] + words
            rows.append((group * 1000 + copy * 7, " ".join(words).upper() if copy % 5 == 0 else "\n".join(words)))
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < len(rows)


def test_hot_passage_links_nobody(spark):
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, common + " " + " ".join(f"d{i}_{j}" for j in range(60))) for i in range(300)]
    assert len({c for _, c in check(spark, rows).values()}) == 300


@pytest.mark.parametrize("seed", range(3))
def test_random_sets_around_the_threshold(spark, seed):
    """Mixtures of common and own passages, chains of copies, sizes from one shingle to hundreds."""
    r = random.Random(seed)
    pool = [[f"p{k}w{i}" for i in range(r.choice([4, 9, 20, 33, 60]))] for k in range(14)]
    rows = []
    for i in range(500):
        words = [w for k in r.sample(range(14), r.randrange(1, 4)) for w in pool[k]]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            words.insert(r.randrange(len(words) + 1), f"o{i}x{r.randrange(3)}")
        if r.random() < 0.3:
            words = words[r.randrange(4) :]
        rows.append((r.randrange(10**9), " ".join(words)))
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < len(rows)


def test_copies_that_differ_too_much_make_no_pairs(spark):
    """One list with every document, and no link: the cells of the list cannot hold one, so no pair is ever formed."""
    common = " ".join(f"c{i}" for i in range(21))
    made = []

    class Search(near_dups._Search):
        def across(self, found):
            made.append(super().across(found).count())
            return super().across(found)

    rows = [(i, f"{common} x{i} y{i} z{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near_dups._Search, whole = Search, near_dups._Search
    try:
        got = near_duplicates(docs).collect()
    finally:
        near_dups._Search = whole
    assert all(r["component_id"] == r["doc_id"] for r in got) and sum(made) == 0


def test_ids_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text), ("a", text + " end"), ("c", "x"), (None, text), ("d", None)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), "d": ("d", True), None: (None, True)}


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t", 0), (4, "A b", 0), (5, "a  B\n", 0), (6, "a c", 0), (6, "a c", 0), (None, "a b", 0), (7, "a b c d e " * 3000, 0), (8, "a b c d e " * 3000, 0)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[5]["component_id"] == 4 and by[8]["component_id"] == 7 and by[7]["n_shingles"] == 5
    assert by[None]["component_id"] is None and by[None]["kept"] and by[1]["n_shingles"] == 0 and by[3]["component_id"] == 3
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (5, 5), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 6), 1), **dict.fromkeys((7, 8, 9), 7), **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
