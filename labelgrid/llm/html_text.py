"""Main text of web pages by a tree-structured graphical model.

A page is a tree: its block elements, and under each of them the runs of text that it shows directly (inline markup belongs to
the run). Every element is main content, boilerplate, or a frame that holds both; every run is content or boilerplate. Nodes have
potentials from what they look like (tag, words of class, id and role, link share, length, share of the page's plain text, whether
they stand beside the page's one article), edges have parent-child potentials. Sum-product message passing, upward and then
downward, gives each run's marginal; the runs that are more likely content than not are the text, in page order.

Both kinds of potentials are trained on pages labelled by hand (``labelled_pages``) and on variants of them, drawn with a fixed
seed: names taken away, boilerplate left out or brought in from another page, texts cut short, articles made plain elements. So
looks that say nothing (no names, short texts) are seen as often as those that say it all. Parent-child potentials are counted,
with add-one smoothing; a node's are the chances of its states by a regularised logistic regression on its looks, over how often
the states occur.

Heads, scripts, styles and comments are never text, nor is what a browser does not show or draws as a picture: templates, svg,
and what stands in for iframes, canvases and objects. Character references are decoded; white space inside a block, line breaks
included, becomes one space; blocks are joined by an empty line. Null or empty html gives an empty text. Unclosed and stray tags
are tolerated; an open head ends where something begins that may not stand in one. Repeated rows are extracted each; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled_pages import PAGES

#: variants drawn of each labelled page
VARIANTS = 24
SEED = 5
#: penalty and steps of the regression, and the weight of elements' and of runs' own looks: what repeats along a path counts less
#: (all chosen by leaving out pages of those labelled)
PENALTY, STEPS = 0.5, 150
OWN_WEIGHT = (1.4, 0.2)
FRAME, CONTENT, BOILER = range(3)
STATES = 3

#: fixed values of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo mrow ms msup msub mfrac msqrt mtext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title svg iframe object canvas select datalist textarea".split())
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
LABEL = "data-l"


class Node:
    """An element (``tag`` set) or a run of text (``tag`` None)."""

    __slots__ = ("beside", "children", "label", "linked", "plain", "size", "tag", "text", "words")

    def __init__(self, tag: str | None, words: tuple = ()) -> None:
        self.tag, self.words = tag, words
        self.children: list[Node] = []
        self.text: list[str] = []
        self.size = self.linked = 0
        self.plain, self.beside = 0.0, "none"
        self.label: int | None = None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.links = 0
        #: links that were open where each open element began
        self.linked = [0]
        self.unseen: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen == ["head"] and tag not in HEAD and tag != "head":
            self.unseen = []
        if self.unseen:
            if tag not in VOID and tag in UNSEEN:
                self.unseen.append(tag)
            return
        if tag in UNSEEN:
            if tag not in VOID:
                self.unseen.append(tag)
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in ("html", "body"):
            return
        given = {k: v or "" for k, v in attrs}
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES.get(tag, set()))
        elif self.open[-1].tag == "p":
            self._cut(len(self.open) - 1)
        hidden = ("hidden",) if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "") else ()
        said = " ".join(given.get(k, "") for k in ("class", "id", "role"))
        node = Node(tag, (*_words(said), *hidden))
        node.label = {"c": CONTENT, "b": BOILER}.get(given.get(LABEL))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.linked.append(self.links)

    def _cut(self, i: int) -> None:
        """Close the open elements from the ``i``-th on; links that began in them end with them."""
        self.links = min(self.links, self.linked[i])
        del self.open[i:], self.linked[i:]

    def _close(self, tags: set, scope: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in scope:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        if self.unseen == ["head"] and not data.isspace():
            self.unseen = []
        if self.unseen:
            return
        at = self.open[-1]
        if not (at.children and at.children[-1].tag is None):
            if data.isspace():
                return
            at.children.append(Node(None))
        run = at.children[-1]
        run.text.append(data)
        run.size += len(data)
        run.linked += len(data) if self.links else 0


def _words(said: str) -> tuple:
    return tuple(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()) if w)


def tree(html: str | None) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return measure(parser.root)


def _ordered(root: Node) -> list[Node]:
    """All nodes in page order, parents before their children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.children)
    return order


def measure(root: Node) -> Node:
    """Sum up the characters, and the linked ones, below each element; find the page's one article."""
    order = _ordered(root)
    for node in reversed(order):
        if node.tag is not None:
            node.size, node.linked = sum(c.size for c in node.children), sum(c.linked for c in node.children)
    plain = max(1, root.size - root.linked)
    for node in order:
        node.plain = (node.size - node.linked) / plain
    articles = [n for n in order if n.tag in ("article", "main")]
    one = max(articles, key=lambda n: n.size, default=None)
    inside = {id(n) for n in _ordered(one)} if one is not None else set()
    # one of several articles must hold much of the page: others may be teasers or comments
    if one is not None and (one.plain >= 0.3 or all(id(n) in inside or any(c is one for c in _ordered(n)) for n in articles)):
        for node in order:
            node.beside = "in" if id(node) in inside else "out"
        for node in order:  # whether a name stands between the article and a part of it
            if node.beside in ("in", "named") and node.tag is not None:
                for c in node.children:
                    c.beside = "named" if node is not one and (node.beside == "named" or node.words) or c.words else "in"
        above = [root]
        while above[-1] is not one:  # what holds the article is neither in it nor beside it
            above[-1].beside = "above"
            above.append(next(c for c in above[-1].children if c is one or any(n is one for n in _ordered(c))))
    return root


class Names:
    """What names of class, id and role have stood for: how many labelled elements of each state had a name, on other pages."""

    def __init__(self, pages: list[Node]) -> None:
        self.counts: dict[str, Counter] = {}
        for i, page in enumerate(pages):
            for node in _ordered(page):
                for word in set(node.words):
                    self.counts.setdefault(word, Counter())[(node.label, i)] += 1
        self.known = sorted((w for w in self.counts if len(w) > 3), key=lambda w: (-len(w), w))
        self.totals: dict[tuple, list[float]] = {}

    def chances(self, word: str, page: int | None) -> list[float]:
        """Pages on which a name stood for each state, without one page; a name that is not known counts as the longest known one in
        it, so compounds are understood."""
        at = (word, page)
        if at not in self.totals:
            if len(self.totals) > 100_000:
                self.totals.clear()
            inside = [w for w in self.known if w in word] if word not in self.counts or page is not None else []
            out = [0.0] * STATES
            for w in [word, *inside] if word in self.counts else inside:
                out = [float(sum(1 for (s, i) in self.counts[w] if s == state and i != page)) for state in range(STATES)]
                if any(out):
                    break
            self.totals[at] = out
        return self.totals[at]

    def look(self, words: tuple, page: int | None) -> list[str]:
        """Whether the names speak for content or for boilerplate, and how clearly."""
        sums = [0.0] * STATES
        for word in dict.fromkeys(words):
            seen = self.chances(word, page)
            if any(seen):
                for s in range(STATES):
                    sums[s] += math.log((seen[s] + 0.1) / (sum(seen) + 0.3))
        if not any(sums):
            return ["named not"] if words else []
        best = max(range(STATES), key=sums.__getitem__)
        lead = sums[best] - max(v for s, v in enumerate(sums) if s != best)
        return [f"named {best}", f"named {best} {min(3, int(lead / 1.5))}"]


def _looks(node: Node, names: Names, page: int | None = None) -> list[str]:
    """The features of a node (of a labelled page: what names stand for there is not counted)."""
    share = node.linked / max(1, node.size)
    place = node.beside if node.beside in ("out", "in") else "other"
    links = f"links {'all' if share > 0.6 else 'some' if share > 0.2 else 'few'}"
    looks = [links, f"{links} {place}", f"beside {place}"]
    if node.tag is None:
        text = "".join(node.text).strip()
        looks += [f"mark {m}" for m in ("©", "»", "|") if m in text]
        return [*looks, f"length {min(6, int(math.log2(1 + len(text) / 8)))}", "sentence" if text[-1:] in ".!?…。”\"" else "phrase"]
    if node.beside in ("in", "named"):  # what is in the article is small or large for other reasons
        return [*looks, f"tag {node.tag}", "plain inside", *names.look(node.words, page)]
    plain = "most" if node.plain > 0.5 else "much" if node.plain > 0.2 else "some" if node.plain > 0.05 else "little"
    return [*looks, f"tag {node.tag}", f"plain {plain}", f"size {min(5, int(math.log2(1 + node.size / 8) / 2))}", *names.look(node.words, page)]


# labelled pages and their variants


def labelled(html: str) -> Node:
    """A page whose nodes know their label: what ``data-l`` says of the nearest element; frames are above, boilerplate beside."""
    page = tree(html)
    page.label = FRAME
    todo = [page]
    while todo:
        node = todo.pop()
        for child in node.children:
            if child.label is None:
                child.label = node.label if node.label != FRAME else BOILER if child.tag is None else FRAME
            todo.append(child)
    return page


def _copy(node: Node) -> Node:
    out = Node(node.tag, node.words)
    out.text, out.size, out.linked, out.label = list(node.text), node.size, node.linked, node.label
    out.children = [_copy(c) for c in node.children]
    return out


def variants(pages: list[Node], count: int, seed: int) -> Iterator[tuple[int, Node]]:
    """Each page, and ``count`` pages made of it, with its number: what is content stays content, and stays in its order."""
    r = random.Random(seed)
    spare = [n for p in pages for n in _ordered(p) if n.tag is not None and n.label == BOILER and n.size < 600]
    spare = [n for n in spare if n.words or n.tag in ("nav", "footer", "form", "aside")]
    for i, page in enumerate(pages):
        yield i, page
        for _ in range(count):
            out = _copy(page)
            nodes = _ordered(out)
            bare, plain = r.random() < 0.4, r.random() < 0.3
            if bare:  # names say nothing
                for n in nodes:
                    n.words = ()
            if plain:  # an article is a plain element
                for n in nodes:
                    n.tag = "div" if n.tag in ("article", "main", "section", "nav", "header", "footer", "aside") else n.tag
            if bare or plain:  # what nothing sets apart from the text around it is not told apart
                for n in nodes:
                    if n.label == CONTENT:
                        n.children = [c for c in n.children if c.label == CONTENT or c.words or c.tag in ("nav", "header", "footer", "aside", "form")]
                nodes = _ordered(out)
            short = r.random() < 0.35
            for n in nodes:
                if n.tag is None and (short and n.label == CONTENT or r.random() < 0.1):
                    words = "".join(n.text).split()
                    kept = words[: r.randint(1, 8)]
                    n.text = [" ".join(kept) + r.choice(["", "."])]
                    share = n.linked / max(1, n.size)
                    n.size = len(n.text[0])
                    n.linked = int(share * n.size)
                if n.tag is not None and n.label == CONTENT and r.random() < 0.1:  # a part named after nothing known
                    n.words = ()
            for n in nodes:
                if n.label != BOILER:
                    n.children = [c for c in n.children if c.tag is None or c.label != BOILER or r.random() < 0.8]
                    if r.random() < 0.06 and n.tag is not None and any(c.tag is not None for c in n.children):
                        n.children.insert(r.randint(0, len(n.children)), _copy(r.choice(spare)))
            yield i, measure(out)


def regression(rows: list[list[str]], states: list[int], count: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights of each look and the intercept of a multinomial logistic regression, by accelerated gradient steps."""
    names = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [names[f] for f in r]] = 1
    y = np.eye(count, dtype=np.float32)[states]
    w = np.zeros((x.shape[1], count), np.float32)
    ahead, before = w.copy(), w
    penalty = np.full((x.shape[1], 1), PENALTY, np.float32)
    penalty[-1] = 0
    size = 1.0 / (0.5 * float((x.sum(1)).mean()) * len(rows) / 4 + PENALTY)
    for k in range(STEPS):
        z = x @ ahead
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        w = ahead - size * (x.T @ (p - y) + penalty * ahead)
        ahead, before = w + (k / (k + 3)) * (w - before), w
    return {f: w[i].astype(float) for f, i in names.items()}, w[-1].astype(float)


class Model:
    """Log potentials of looks and of parent-child pairs."""

    def __init__(self, names: Names, pages: Iterator[tuple[int, Node]]) -> None:
        self.names = names
        rows: tuple[list, list] = ([], [])
        labels: tuple[list, list] = ([], [])
        pairs = [[[1.0] * STATES for _ in range(STATES)] for _ in range(2)]
        for i, page in pages:
            for node in _ordered(page):
                kind = node.tag is None
                if node is not page:
                    rows[kind].append(_looks(node, names, i))
                    labels[kind].append(node.label)
                for child in node.children:
                    pairs[child.tag is None][node.label][child.label] += 1
        self.looks: dict[str, list] = {}
        self.base = []
        for kind in range(2):
            weights, base = regression(rows[kind], labels[kind], STATES)
            shares = np.log((np.bincount(labels[kind], minlength=STATES) + 1) / (len(labels[kind]) + STATES))
            self.base.append((OWN_WEIGHT[kind] * (base - shares)).tolist())
            for f, w in weights.items():
                self.looks.setdefault(f, [[0.0] * STATES, [0.0] * STATES])[kind] = (OWN_WEIGHT[kind] * w).tolist()
        self.pairs = [[[math.log(pairs[k][p][c] / sum(pairs[k][p])) for c in range(STATES)] for p in range(STATES)] for k in range(2)]
        for p in range(STATES):  # a run is never a frame
            self.pairs[1][p][FRAME] = -math.inf

    def own(self, node: Node) -> list[float]:
        leaf = node.tag is None
        out = list(self.base[leaf])
        for f in _looks(node, self.names):
            value = self.looks.get(f)
            if value:
                for s in range(STATES):
                    out[s] += value[leaf][s]
        return out

    def marginals(self, root: Node) -> list[tuple[Node, float]]:
        """Each run in page order with its probability of being content."""
        order, todo, parent = [], [root], {id(root): None}
        while todo:
            node = todo.pop()
            order.append(node)
            for child in reversed(node.children):
                parent[id(child)] = node
                todo.append(child)
        belief = {id(n): self.own(n) for n in order}
        up: dict[int, list[float]] = {}
        for node in reversed(order):  # upward: children come before their parent
            above = parent[id(node)]
            if above is None:
                continue
            pair, own = self.pairs[node.tag is None], belief[id(node)]
            message = [_log_sum([pair[p][c] + own[c] for c in range(STATES)]) for p in range(STATES)]
            up[id(node)] = message
            total = belief[id(above)]
            for p in range(STATES):
                total[p] += message[p]
        belief[id(root)][CONTENT] = belief[id(root)][BOILER] = -math.inf  # a page is a frame
        out = []
        for node in order:  # downward: a parent's belief without the child's own message
            above = parent[id(node)]
            if above is not None:
                pair, message, total = self.pairs[node.tag is None], up[id(node)], belief[id(above)]
                own = belief[id(node)]
                belief[id(node)] = [own[c] + _log_sum([total[p] - message[p] + pair[p][c] for p in range(STATES)]) for c in range(STATES)]
            if node.tag is None:
                b = belief[id(node)]
                out.append((node, math.exp(b[CONTENT] - _log_sum(b))))
        return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else -math.inf


_models: dict = {}


def train(pages: list[str], count: int = VARIANTS, seed: int = SEED) -> Model:
    known = [labelled(p) for p in pages]
    return Model(Names(known), variants(known, count, seed))


def model() -> Model:
    """The model of this process; training is deterministic and takes a fraction of a second."""
    if not _models:
        _models["own"] = train(PAGES)
    return _models["own"]


def extract(html: str | None, by: Model | None = None) -> str:
    """The main text of a page."""
    kept = []
    for node, content in (by or model()).marginals(tree(html)):
        text = " ".join("".join(node.text).split())
        if content > 0.5 and text:
            kept.append(text)
    return "\n\n".join(kept)


def main_text(pages: DataFrame, *, key: str = "page_id", html: str = "html", carry: tuple = ("url",)) -> DataFrame:
    """``key``, the columns to ``carry``, ``text`` and ``n_chars`` of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "html"):
                texts = [extract(h, held.value) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(c) for c in carry), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, *carry, "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return pages.select(F.col(key).alias("key"), F.col(html).alias("html"), *carry).mapInArrow(read, f"{kinds}, text string, n_chars long")
