"""Toxicity, fingerprints, chat, HTML, media, mixing, and the pipeline."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from labelgrid.llm import chat, fingerprints, html_text, media, packing, toxicity
from labelgrid.llm.common import unpacked
from labelgrid.llm.mixing import mix
from labelgrid.llm.queries import QUERIES, SQL

from held_out_pages import PAGES as HELD_OUT
from test_near_dups import brute as near_brute
from test_substrings import brute as substring_brute

SF = "/root/testdata/sf0.001"


# toxicity


def all_segments(scores):
    """Maximal scoring segments by their recursive definition: the best stretch, then what is left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best, at = -1.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j)
    i, j = at
    return all_segments(scores[:i]) + [(best, i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in all_segments(scores[j + 1 :])]


def test_maximal_segments():
    r = random.Random(2)
    for _ in range(150):
        scores = [round(r.choice([r.random() * 4, 0]), 3) for _ in range(r.randrange(14))]
        at = [i for i, s in enumerate(scores) if s]
        dense = [s or -0.7 for s in scores]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], -0.7)
        want = all_segments(dense)
        assert [(round(s, 6), at[a], at[b]) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in want]


def toxic_table(spark, n=600):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(400)}" for _ in range(r.randrange(20, 120))]
        toxic = i % 6 == 0
        for _ in range(r.randrange(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["zounds", "Fiendish%%%", "fiendlike"]))
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_table(spark)
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    assert scored.select(*unpacked(docs, "text")).schema == docs.schema
    got = {r["doc_id"]: r for r in scored.select("rest.doc_id", "text", "score", "passages").collect()}
    assert sum((r["score"] >= 0.5) == (i % 6 == 0) for i, r in got.items()) / len(got) > 0.97
    found = next(r for i, r in got.items() if i % 6 == 0 and r["passages"])
    span = found["passages"][0]
    assert re.search("zounds|fiend", found["text"].encode()[span["start"] : span["end"]].decode().lower())


def test_toxicity_odd_rows(spark):
    docs, labels = toxic_table(spark, 120)
    model = toxicity.learn(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "zounds " * 20000), (None, "x")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.score(rows, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] < scores[2]
    empty = toxicity.learn(docs, labels.where("toxic > 1"))
    assert [r["score"] for r in toxicity.score(rows, empty).collect()] == [0.0] * 4
    assert toxicity.score(rows.where("false"), model).count() == 0


def brute_toxicity(docs, labels):
    """Scores by the definition: features as strings, segments by recursion, every passage of every calibration row."""
    known = {}
    for i, t in labels:
        known[i] = max(known.get(i, 0), t)
    known = {i: t for i, t in known.items() if zlib.crc32(str(i).encode()) % 5}
    chosen = sorted(known, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[: toxicity.SAMPLE]
    fold = {i: xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() % 4 for i in chosen}
    texts = dict(docs)
    words = lambda t: re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    looks = lambda w: {("whole", w)} | {("stem", w[:n]) for n in toxicity.STEMS if len(w) > n}
    y, x = collections.Counter(), collections.Counter()
    n = [0, 0]
    for i in chosen:
        if fold[i]:
            n[known[i]] += 1
            (y if known[i] else x).update(set().union(*map(looks, words(texts[i]))) if words(texts[i]) else ())
    prior = toxicity.PRIOR * sum(n)
    odds = {}
    for f, a in y.items():
        b, alpha = x[f], toxicity.PRIOR * (a + x[f])
        o = math.log((a + alpha) / (n[1] + prior - a - alpha + 0.5)) - math.log((b + alpha) / (n[0] + prior - b - alpha + 0.5))
        z = o / math.sqrt(1 / (a + alpha) + 1 / (b + alpha))
        if a > 1 and z >= min(toxicity.Z_GRID) and o >= toxicity.LEAST_ODDS:
            odds[f] = (o, z)

    def segments(t, weights):
        tokens = [max([weights[f] for f in looks(w) if f in weights], default=0.0) for w in words(t)]
        return tokens, [s for s, _, _ in all_segments([v or toxicity.BACKGROUND for v in tokens])]

    best = None
    for level in toxicity.Z_GRID:
        weights = {f: o for f, (o, z) in odds.items() if z >= level}
        if len(weights) < 2:
            continue
        rows = [(known[i], *segments(texts[i], weights)) for i in chosen if not fold[i]]
        clean = [r for r in rows if not r[0]]
        hits = [v for _, t, _ in clean for v in t if v]
        rate = (len(hits) + 0.5) / (max(1, sum(len(t) for _, t, _ in clean)) + 1)
        mean = (sum(hits) + sum(weights.values()) / len(weights)) / (len(hits) + 1)
        low, high = 0.05, 5.0
        for _ in range(60):
            lam = (low + high) / 2
            low, high = (low, lam) if rate * math.exp(lam * mean) + (1 - rate) * math.exp(lam * toxicity.BACKGROUND) > 1 else (lam, high)
        k = len(clean) / sum(max(1, len(t)) * math.exp(-lam * max(s, default=0.0)) for _, t, s in clean)

        def evidence(tokens, found, lam=lam, k=k):
            normal = [lam * s - math.log(k * max(1, len(tokens))) for s in found]
            strong = [v for v in normal if 1 - math.exp(-math.exp(-v)) <= toxicity.SIGNIFICANT]
            value = sum(strong) if strong else max(normal, default=-math.log(k * max(1, len(tokens))))
            return max(-20.0, min(40.0, value))

        told = sorted((evidence(t, s), c) for c, t, s in rows)
        slope, shift = toxicity._fit_curve(np.array([e for e, _ in told]), np.array([c for _, c in told]))
        chance = lambda e, slope=slope, shift=shift: 1 / (1 + math.exp(-(shift + slope * e)))
        clipped = [(min(1 - 1e-6, max(1e-6, chance(e))), c) for e, c in told]
        loss = -sum(math.log(p if c else 1 - p) for p, c in clipped) / len(clipped)
        if best is None or loss < best[0]:
            best = loss, weights, evidence, chance
    _, weights, evidence, chance = best
    return {i: chance(evidence(*segments(t, weights))) for i, t in docs}


def test_toxicity_against_brute_force(spark):
    docs, labels = toxic_table(spark)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).select("rest.doc_id", "score").collect()}
    want = brute_toxicity([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert got == pytest.approx(want, abs=1e-6)
    # rows that repeat a labelled id teach once
    twice = docs.unionByName(docs)
    again = toxicity.score(twice, toxicity.learn(twice, labels)).select("rest.doc_id", "score").collect()
    assert len(again) == 2 * len(got) and all(r["score"] == got[r["doc_id"]] for r in again)


def test_held_out_rows_teach_nothing(spark):
    docs, labels = toxic_table(spark, 200)
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    a = toxicity.learn(docs, labels)
    b = toxicity.learn(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert a.keys.tolist() == b.keys.tolist() and a.slope == b.slope and a.shift == b.shift


# fingerprints


def jaccard(a, b):
    def bag(t):
        out = collections.Counter()
        for w in t.encode().split():
            m = (len(w) + 1) // 2
            out.update([(0, w), (1, w[:m]), (2, w[m:])])
        return out

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_likeness_estimates_jaccard():
    r = random.Random(6)
    errors = []
    for trial in range(150):
        words = [f"{trial}w{int(r.paretovariate(0.6))}" for _ in range(120)]
        other = [w if r.random() < 0.7 else f"{trial}v{r.randrange(99)}" for w in words]
        a, b = " ".join(words), " ".join(other)
        errors.append(fingerprints.likeness(*fingerprints.fingerprints(pa.array([a, b]))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_likeness_of_texts_with_many_terms():
    r = random.Random(7)
    errors = []
    for trial in range(4):
        words = [w for i in range(100_000) for w in [f"{r.getrandbits(60):x}"] * min(100, int(r.paretovariate(1)))]
        gone = set(r.sample(sorted(set(words)), 40_000))
        other = [f"{r.getrandbits(60):x}" if w in gone else w for w in words]
        a, b = " ".join(words), " ".join(other)
        errors.append(fingerprints.likeness(*fingerprints.fingerprints(pa.array([a, b]))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.07


def test_variates():
    h = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    x = fingerprints.bits(h, fingerprints._FIRST)
    g, r, b = (v.astype(float) for v in fingerprints.variates(h, x))
    c = np.exp(g + r * (1 - b))
    for gamma in (r, c):
        assert gamma.mean() == pytest.approx(2, abs=0.02) and gamma.var() == pytest.approx(2, abs=0.05)
    assert b.mean() == pytest.approx(0.5, abs=0.005) and b.var() == pytest.approx(1 / 12, abs=0.002)
    assert np.abs(np.corrcoef([r.ravel(), b.ravel(), c.ravel()]) - np.eye(3)).max() < 0.01
    # terms that share 14 bits, once a row of variates, have their own
    near = fingerprints.bits((h << np.uint64(14)) | np.uint64(5), fingerprints._FIRST)
    assert len(np.unique(near[:, 0])) == len(np.unique(h << np.uint64(14)))


def plain_sample(hashes):
    """The same samples one term and one sample at a time, in double precision."""
    full = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for h, w in collections.Counter(hashes).items():
            one, two = mix(h + int(fingerprints._FIRST[k]) & full), mix(h + int(fingerprints._SECOND[k]) & full)
            g = -math.log1p(-min(one / 2**64, 1 - 2**-24))
            u, e = (-math.log(((two >> s & (1 << 23) - 1) + 0.5) / 2**23) for s in (41, 18))
            r = e + math.log1p(u / g)
            level = math.floor(math.log(w) / r + e / r)
            best = min(best or (math.inf,), (math.log(g) - r * level, one, level))
        out.append(mix(best[1] + best[2] * int(fingerprints._STEP) & full) >> 56)
    return out


def test_samples_against_the_plain_formula():
    r = random.Random(9)
    for n in (1, 3, 40, 600):
        hashes = [h for h in (r.getrandbits(64) for _ in range(n)) for _ in range(int(r.paretovariate(0.7)) % 5000 + 1)]
        got = fingerprints.sample(np.array(hashes, np.uint64))
        assert sum(int(a == b) for a, b in zip(got.tolist(), plain_sample(hashes), strict=True)) >= 62


def test_likeness_of_texts_follows_their_own_terms():
    """Likeness as defined: equal bytes less chance, of fingerprints of the whole texts."""
    texts = ["a b c d", "a b c e", "", "a b c d"]
    got = fingerprints.fingerprints(pa.array(texts))
    assert got[0] == got[3] and fingerprints.likeness(got[0], got[3]) == 1.0 and fingerprints.likeness(got[0], got[2]) == 0.0
    share = sum(x == y for x, y in zip(got[0], got[1], strict=True)) / 64
    assert fingerprints.likeness(got[0], got[1]) == pytest.approx(max(0.0, (share * 256 - 1) / 255))


def fingerprints_of(rows):
    """The query by its definition: rows (id, text) with distinct ids."""
    order = sorted(((i is not None, i, t or "") for i, t in rows), reverse=True)
    out = {}
    for (_, i, t), (_, _, u) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        a, b, c = fingerprints.fingerprints(pa.array([t, new, u]))
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c))
    return out


def check_fingerprints(df):
    got = {r["doc_id"]: tuple(r)[1:] for r in fingerprints.fingerprint_edits(df).collect()}
    want = fingerprints_of([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert got[i] == pytest.approx(row) if row[0] is None else got[i][:4] == row[:4] and got[i][4:] == pytest.approx(row[4:])


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_fingerprints_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(fingerprints, "RANGES_PER_FILE", ranges)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_fingerprints(docs)
    check_fingerprints(docs.selectExpr("concat('é', doc_id) AS doc_id", "text"))


def test_fingerprints_odd_rows(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprint_edits(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(5, "abcd")], schema)).collect()[0]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rows = fingerprints.fingerprint_edits(spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (4, None), (2, "é" * 50000)], schema)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in rows) == [(-1, 3), (2, 50000), (3, 1), (3, 1), (4, 0)]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1


def test_fingerprints_of_rows_that_repeat_an_id(spark, monkeypatch):
    """Most rows have no id, or the same one: equal rows follow one another, others are spread by their texts."""
    monkeypatch.setattr(fingerprints, "REPEATED", 64)
    rows = [(None, "same words here")] * 700 + [(None, f"own {i} words") for i in range(300)] + [(7, "x y z")] * 300 + [(i, f"t{i} u") for i in range(8, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprints.fingerprint_edits(df).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in got) == collections.Counter((i, len(t)) for i, t in rows)
    digest = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    seen = collections.Counter(r["edited_sha256"] for r in got)
    assert seen[digest("same words here", "same words here")] == 699 and seen[digest("x y z", "x y z")] == 299
    texts = collections.Counter(t for _, t in rows)
    # each text follows some row as often as it is there
    follow = [t for r in got for t in texts if r["edited_sha256"] == digest("x y z", t)]
    assert len(got) == len(rows) and follow


# chat


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2], r[3]))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (len(v), digest("".join(f"{a or ''}\n{b or ''}\n" for a, b in v)), len(x := "".join(b or "" for a, b in v if a == "assistant")), digest(x)) for k, v in out.items()}


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_chat_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = [(1, 0, "user", "a\\</s>\\\\[INST]"), (1, 1, "assistant", "\\"), (1, 2, "assistant", "[/INST]é\n日"), (1, 2, "assistant", None), (1, 3, None, "x"), (2, 0, "assistant", ""), (3, 0, "</s>", "<s>"), (3, 5, "assistant", "ab  \n c"), (None, None, None, None), (4, 1, "assistant", "y " * 3000)]
    got = chat.read_back(chat.format_chats(spark.createDataFrame(rows, CHAT))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == told(rows)
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], CHAT))).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ok = "</s>[INST] ok [/INST]"
    want = told([*rows, (-7, 0, "user", ok), (-7, 1, "assistant", ok)])
    got = QUERIES["op7_chat"](spark, SF).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == want


def test_escape():
    r = random.Random(1)
    for _ in range(500):
        t = "".join(r.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "a", "<", "[", "]"]) for _ in range(8))
        assert chat.unescape(chat.escape(t)) == t


# pages and media


def test_html_pages(spark):
    pages = [
        ("<html><body><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><main><h1>Title</h1><p>Hello <b>world</b> &amp;\n more.<p>Second paragraph here.</p><div class='ad-banner'>Buy now!</div><p>Third.</p></main><aside>Related stuff</aside><section id=comments><h3>Comments</h3><div class=comment><p>Nice article.</p></div></section><form><label>Email</label></form><footer>&copy; 2020</footer>", "Title\n\nHello world & more.\n\nSecond paragraph here.\n\nThird."),
        ("<script>var t='</p>';</script><style>p{}</style><article><p>Only&nbsp;this<br>text.</article>", "Only this text."),
        ("", ""),
        (None, ""),
        ("<div class=cookie-notice>We use cookies.</div>", ""),
    ]
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.main_text(df).orderBy("page_id").collect()] == [t for _, t in pages]
    assert html_text.main_text(df.where("false")).count() == 0


def test_html_marginals_are_exact():
    model = html_text.model()
    page = html_text.tree("<div class=content><h1>a b</h1><p>some text here.</p></div><div class=ad>x</div>")
    nodes, todo = [], [(page, None)]
    while todo:
        n, parent = todo.pop()
        nodes.append((n, parent))
        todo += [(c, n) for c in n.children]
    index = {id(n): i for i, (n, _) in enumerate(nodes)}
    weight = collections.defaultdict(float)
    total = 0.0
    import itertools

    for states in itertools.product(range(3), repeat=len(nodes)):
        if states[0] != html_text.FRAME:
            continue
        p = 0.0
        for (n, parent), s in zip(nodes, states, strict=True):
            p += model.own(n)[s]
            if parent is not None:
                p += model.pairs[n.tag is None][states[index[id(parent)]]][s]
        p = math.exp(p) if p > -math.inf else 0.0
        total += p
        for (n, _), s in zip(nodes, states, strict=True):
            if n.tag is None and s == html_text.CONTENT:
                weight[id(n)] += p
    for n, p in model.marginals(page):
        assert p == pytest.approx(weight[id(n)] / total)


def test_html_held_out():
    """Characters of pages labelled by hand that nothing is trained on."""
    model = html_text.model()
    assert not set(HELD_OUT) & set(html_text.PAGES)
    both = wrong = missed = 0
    for page in HELD_OUT:
        for node, chance in model.marginals(html_text.labelled(page)):
            size, want, got = len(" ".join("".join(node.text).split())), node.label == html_text.CONTENT, chance > 0.5
            both += size * (want and got)
            wrong += size * (got and not want)
            missed += size * (want and not got)
    assert both / (both + wrong) >= 0.95 and both / (both + missed) >= 0.95


LONG = "It was the first time in many years that all of them had come together again in the old house by the water. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>one<p>two</article>", "one\n\ntwo"),
        ("<html><body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Contact</a></div><div><p>The mill stands at the end of the lane.</p><p>It no longer turns, sadly.</p></div></body></html>", "The mill stands at the end of the lane.\n\nIt no longer turns, sadly."),
        (f"<article><p>{LONG}</p><ul><li><a href=1>The first part</a></li><li><a href=2>The second part</a></li></ul><p>{LONG}</p></article>", f"{LONG.strip()}\n\nThe first part\n\nThe second part\n\n{LONG.strip()}"),
        (f"<main><h1>Rooms</h1><a href=1><div>linked block</div></a><p>{LONG}</p></main>", f"Rooms\n\nlinked block\n\n{LONG.strip()}"),
        (f"<article><h1>News</h1><p>{LONG}</p></article><section id=responses><p>I was there as well and it was wonderful.</p></section>", f"News\n\n{LONG.strip()}"),
        ("<article><h1>Ausflug</h1><p>Wir waren am See.</p><section class=leserkommentare><p>Da will ich auch einmal hin, danke!</p></section></article>", "Ausflug\n\nWir waren am See."),
        ("<head><title>t</title><article><p>text", "text"),
        ("<article><p>a<noscript> b</noscript> <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><svg><text>no</text></svg></article>", "a\n\nb\n\nx=1"),
    ],
)
def test_html_of_other_shapes(html, want):
    assert html_text.extract(html) == want


def test_html_links_end_with_what_holds_them():
    run = lambda html: [(n.size, n.linked) for n in html_text._ordered(html_text.tree(html)) if n.tag is None]
    assert run("<a href=1><div>ab</div>cd</a>ef") == [(2, 2), (4, 2)]
    assert run("<div><a href=1>ab</div><p>cd</p>") == [(2, 2), (2, 0)]


def test_html_table(spark):
    import html as std

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(std.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert html_text.extract(r["html"]) == "\n\n".join(b for b in blocks if b)


def test_media(spark):
    parsed = media.parse('<p>a &amp; b<figure><img src="sha256:AB" alt=x><figcaption>cap <b>1</b></figcaption></figure>c<audio src="sha256:cd" alt=y></audio><script>z</script>d')
    assert [(i["kind"], i["text"], i["digest"], i["caption"]) for i in parsed] == [("text", "a & b", None, None), ("image", None, "ab", "cap 1"), ("text", "c", None, None), ("audio", None, "cd", "y"), ("text", "d", None, None)]
    for text in (None, "", "x", "é" * 96, "y" * 70000):
        payload = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload and media.decode(media.encode(payload)) == payload == media.decode(media.encode_sound(payload))
    pages = spark.createDataFrame([(1, '<img src="sha256:aa" alt="one">t<img src="sha256:zz">'), (2, None), (3, '<img src="sha256:aa">')], "id long, html string")
    store = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = sorted((r["id"], r["position"], r["kind"], r["caption"], r["size"]) for r in media.resolve(media.sequences(pages, key="id"), store, key="id").collect())
    assert got == [(1, 0, "image", "one", 7), (1, 1, "text", None, None), (1, 2, "image", None, None), (3, 0, "image", None, 7)]


def png_of(payload):
    """The stored form by its description, with every chunk written out."""
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = (64).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    lines = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def feature_of(payload):
    mean = sum(payload) / len(payload)
    entropy = -sum(n / len(payload) * math.log2(n / len(payload)) for n in collections.Counter(payload).values())
    edges = [int(i * len(payload) / 64) for i in range(65)]
    bright = "".join("1" if sum(payload[a:b]) / (b - a) > mean else "0" for a, b in zip(edges, edges[1:], strict=False))
    return f"{len(payload) // 192}|{mean:.3f}|{entropy:.3f}|{int(bright, 2):016x}"


def media_of(text):
    raw = (text or "").encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    png = png_of(payload)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(payload)


def test_media_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op9_media"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert tuple(r)[:8] == (r["doc_id"], *media_of(text))
        runs = [" ".join(p.split()) for p in media_runs(text)]
        shown = [p for p in runs if p]
        assert r["n_items"] == len(shown) + 2 and r["text_chars"] == sum(map(len, shown))
        first = bool(runs[0])
        want = [(int(first), "image", f"{r['n_bytes']} bytes of text", r["payload_bytes"]), (r["n_items"] - 1, "audio", "the last 192 samples", 192)]
        assert [tuple(m) for m in r["media"]] == want


def media_runs(text):
    half = len(text) // 2
    while half < len(text) and not text[half].isspace():
        half += 1
    return text[:half], text[half:]


def test_media_of_rows_that_repeat_a_payload(spark, tmp_path):
    rows = [(None, "t"), (1, "t"), (1, "t"), (2, None), (2, ""), (3, "x <b>&amp;" * 400), (4, "z" * 192)]
    spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, digest string, items int").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op9_media"](spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r)[:8] for r in got) == collections.Counter((i, *media_of(t)) for i, t in rows)


# mixing


def water_fill(sizes, weights, share=1.5, cap=2.0):
    left, out, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level >= cap * sizes[i]}
        if not over:
            return {**out, **{i: weights[i] * level for i in open_}}
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def test_mixing(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randrange(1, 80)), r.choice(["a", "b", "b", "b", "c", None, "Z"])) for i in range(2500)] + [(9001, None, "a"), (9002, "", None), (9003, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", __import__("pyspark").sql.functions.lit(1))
    got = mix(df).collect()
    again = mix(df.repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(str, again)) == sorted(map(str, got))
    names = sorted({r["source"] for r in got if r["source"] is not None}) + [None]
    sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
    want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for i, s in enumerate(names):
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[i]) and 0 <= r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - want[i]) <= 2 * max(r["size"] for r in own) + 1
    assert mix(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    plain = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[key].itertuples(index=False))
    assert plain(got) == plain(want)


def plain_mix(rows):
    """How often each of the rows (doc_id, source, text) is taken, by systematic sampling in plain Python."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    total = [sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in names]
    target = water_fill(total, [(3, 1, 2)[i % 3] for i in range(len(names))])
    buckets = max(1, math.ceil(math.sqrt(len(rows)) / 8))
    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    copies = [0] * len(rows)
    for k, s in enumerate(names):
        rate = target[k] / total[k] if total[k] else 0.0
        u = md5(f"17:{s or ''}") / 2**32
        place = {}
        for j, (i, source, t) in enumerate(rows):
            if source == s:
                spread = md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}")
                place[j] = (math.floor(8 * math.log2(size[j])) if size[j] else -1, spread % buckets, spread, i is None, i or 0, size[j], j)
        for last, j in enumerate(sorted(place, key=place.get), 1):
            copies[j] = math.floor(rate * last + u) - math.floor(rate * (last - 1) + u)
    return copies


def test_pipeline_against_brute_force(spark):
    """Given the learned scores, every row of the run: stages two to four in plain Python, then each document's pieces."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).select("rest.doc_id", "text", "rest.source", "score").collect()
    left = {r["doc_id"]: (r["text"], r["source"]) for r in scored if r["score"] < 0.5}
    assert len(left) < len(scored)
    groups = near_brute([(i, t) for i, (t, _) in left.items()])
    left = {i: v for i, v in left.items() if groups[i][1] == i}
    cut = substring_brute([(i, t) for i, (t, _) in left.items()])
    rows = [(i, s, cut[i][2] if cut[i][1] else t) for i, (t, s) in left.items()]
    copies = {r[0]: n for r, n in zip(rows, plain_mix(rows), strict=True)}
    tok = packing.tokenizer("word_bpe_49k.json")
    got = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(got) == {i for i, n in copies.items() if n}
    for i, _, text in rows:
        if not copies[i]:
            continue
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        seen = np.zeros(len(ids), int)
        for r in got[i]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            seen[r["start"] : r["start"] + r["length"]] += 1
        assert (seen == copies[i]).all()
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


OWN = "score double, passages int, n_words long, n_removed long, copies long, row long, doc string, kept string, rest int, id long, th long, spans int, size int, spread int, class int, bucket int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_odd_tables(spark, name):
    """Null and repeated ids, null and empty texts, columns named like the operators' own, and a table without rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {OWN}"
    extra = [1.0, 2, 3, 4, 5, 6, "d", "k", 7, 8, 9, 10, 11, 12, 13, 14]
    base = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (None, "no id"), (None, None), (2, None), (3, ""), (4, " \n"), (5, "long " * 30000), (6, " ".join(f"w{i}" for i in range(70))), (7, " ".join(f"w{i}" for i in range(70)) + " end of it")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *extra) for i, t in base for s in ("x", None)], schema)
    out = stage(spark, docs, SF)
    if name != "packing":
        assert out.schema == docs.schema
        rows = out.collect()
        assert rows and all(tuple(r)[5:] == tuple(extra) for r in rows)
        have = collections.Counter((r["doc_id"], r["source"]) for r in docs.collect())
        assert {(r["doc_id"], r["source"]) for r in rows} <= set(have)
        if name in ("toxicity", "repeats"):
            assert collections.Counter((r["doc_id"], r["source"]) for r in rows) == have
    else:
        assert {r["doc_id"] for r in out.collect()} == {i for i, _ in base}
    assert stage(spark, docs.where("false"), SF).count() == 0


STAGE = "doc_id long, source string, text string, n_chars long, copies long, row long, kept string"


def stage_rows(spark, stage, rows):
    """Rows of a stage as (doc_id, source, text), with columns beside them that are named like those of the operators."""
    docs = spark.createDataFrame([(*r, len(r[2] or ""), 7, 7, "x") for r in rows], STAGE)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r["copies"] == r["row"] == 7 and r["kept"] == "x" for r in got)
    return [(r["doc_id"], r["source"], r["text"]) for r in got]


def test_mixing_stage_takes_every_row_by_itself(spark):
    r = random.Random(11)
    rows = [(None if i % 9 == 0 else 5 if i % 4 == 0 else i, r.choice(["a", "b", None]), f"t{i} " + "w " * r.randrange(60)) for i in range(600)]
    rows += [(None, "a", None), (5, "a", ""), (5, "b", "same"), (5, "b", "same")]
    got = collections.Counter(stage_rows(spark, corpus_pipeline.mixing, rows))
    have = collections.Counter(rows)
    assert set(got) <= set(have) and all(n <= 2 * have[k] for k, n in got.items())
    size = lambda k: len(k[2].split()) if k[2] else 0
    want = water_fill([sum(size(k) for k in rows if k[1] == s) for s in ("a", "b", None)], (3, 1, 2))
    for i, s in enumerate(("a", "b", None)):
        assert abs(sum(n * size(k) for k, n in got.items() if k[1] == s) - want[i]) <= 2 * 61 + 1
    assert any(k[0] is None for k in got)
    assert stage_rows(spark, corpus_pipeline.mixing, []) == []


def test_near_dups_stage_keeps_one_row_of_a_group(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, "a", words("x")), (3, "a", words("x")), (7, "b", words("x")), (3, "b", words("y")), (9, "a", words("y")), (9, "a", words("z"))]
    rows += [(2, "a", words("x") + " end"), (7, "a", words("v")), (4, "a", ""), (4, "a", ""), (4, "a", None), (None, "a", words("x")), (None, "a", words("x"))]
    got = collections.Counter((i, t) for i, _, t in stage_rows(spark, corpus_pipeline.near_dups, rows))
    want = [(2, words("x") + " end"), (3, words("y")), (9, words("z")), (7, words("v")), (4, ""), (4, None), (None, words("x")), (None, words("x"))]
    assert got == collections.Counter(want)
    assert stage_rows(spark, corpus_pipeline.near_dups, []) == []
