"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a binary variable: content or not. A log-linear potential of its tag, its class, id and role
words, where it stands, its text and its links scores each node; a pair potential ties each node to its parent. One more factor looks at the
whole tree: a page with text and no content at all has a weight of its own, so that an article which is short, has no heading or no names is
found where the page offers nothing else. Sum-product messages run up and down the tree once each and give exact marginals, since only one
assignment of all is without content. The weights maximise the likelihood of labelled pages (html_pages.py), with the gradient taken from those same
marginals. Blocks of text whose node has a marginal of one half or more are the main text.

Edge cases: null, empty and text-less html give an empty text (null html is empty); html without elements is its text;
unclosed and misnested tags close as browsers close them; scripts, styles and comments are dropped while parsing; repeated rows are
extracted one by one; an empty table gives an empty result; columns other than page_id, url and html are
not read. Parsing is one linear scan whatever the length; html is never cut.
"""

from __future__ import annotations

import functools
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from verisift.llm.common import table
from verisift.llm.html_pages import labelled_pages

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page. The raw ones hold no tags and run to the end of the page if nothing closes them; another one
#: that nothing closes ends at the next tag of a block.
_RAW = frozenset("script style textarea title".split())
_DROP = _RAW | frozenset("noscript template svg math iframe object select canvas audio video".split())
_BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup label legend li main menu nav ol p pre section summary table caption tbody thead tfoot tr td th ul".split()
)
_LANDMARK = frozenset("html body article aside footer form header main nav section".split())
_KINDS = 4
#: Probability of a page without content from which it is taken for one.
NONE = 0.75
#: Start tags that end an open element, looking no further than the stop tags.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|data-y)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
#: A-Z alone: the text keeps its length, which lower() does not promise.
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: What can still begin a comment or declaration where no tag can end any more.
_TAIL = re.compile(r"<!--.*|<[!?][^>]*+", re.S)


def _ends(name: str, low: str) -> dict[int, int]:
    """Where each start tag of an element that is closed has its end tag's end; start and end tags pair like brackets."""
    out, open_ = {}, []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*+(?:>|\Z)", low):
        if not m[1]:
            if not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)")


class Page:
    """Nodes in page order (a parent stands before its children) and the blocks of text. labelled: the attribute data-y of a node is its label."""

    def __init__(self, html: str, labelled: bool = False):
        self.labelled = labelled
        self.parent, self.tag, self.names, self.label = [-1], ["#root"], [()], [0]
        self.blocks: list[tuple[int, str]] = []
        self.length, self.links, self.marks, self.pieces = [0], [0], [0], [0]
        self._parse(html)

    def _node(self, parent: int, tag: str, attrs: str) -> int:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs else {}
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(tuple(dict.fromkeys(_NAME.findall(" ".join(v for k, v in found.items() if k != "data-y").lower()))))
        self.label.append(int(self.labelled and found.get("data-y") == "1"))
        for x in (self.length, self.links, self.marks, self.pieces):
            x.append(0)
        return len(self.parent) - 1

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones carry their block's node
        text: list[str] = []
        in_link, held = 0, Counter()  # open elements by name

        def cut(k: int) -> None:
            nonlocal in_link
            for t, _ in stack[k:]:
                held[t] -= 1
                in_link -= t == "a"
            del stack[k:]

        def flush() -> None:
            if text:
                whole = _SPACE.sub(" ", unescape("".join(text))).strip()
                text.clear()
                if whole:
                    node = stack[-1][1]
                    self.blocks.append((node, whole))
                    self.length[node] += len(whole)
                    self.marks[node] += sum(map(whole.count, ".,;!?"))
                    self.pieces[node] += 1

        at, n, low = 0, len(html), None
        # Behind the last ">" no tag is tried: each would look for its end again. Before it no two quotes can hide the end of more than two tags.
        final = html.rfind(">")
        ends_of: dict[str, dict[int, int]] = {}
        skip = False  # within a dropped element that nothing closes
        while at < n:
            m = _TAG.search(html, at) if at <= final else _TAIL.search(html, at)
            if not m:
                if not skip:
                    text.append(html[at:])
                break
            if m.start() > at and not skip:
                raw = html[at : m.start()]
                text.append(raw)
                if in_link:
                    self.links[stack[-1][1]] += len(raw)
            at = m.end()
            name = (m[2] or m[5] or "").lower() if m.re is _TAG else ""
            if not name:
                continue
            closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if name == "head":
                continue  # its elements are dropped by themselves; text or any other element ends it, as in browsers
            skip = skip and name not in _BLOCK
            if name == "br" or name == "hr":
                text.append(" ")
            if name in _DROP:
                if not closing and not attrs.endswith("/"):
                    low = html.translate(_LOWER) if low is None else low
                    if name in _RAW:
                        found = _raw_end(name).search(low, at)
                        at = found.end() if found else n
                    else:
                        if name not in ends_of:
                            ends_of[name] = _ends(name, low)
                        end = ends_of[name].get(m.start())
                        at, skip = (at, True) if end is None else (end, skip)
                continue
            if skip and not closing:
                continue
            if closing:
                if held[name] > 0:
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    if any(t in _BLOCK for t, _ in stack[k:]):
                        flush()
                    cut(k)
                continue
            if name in _VOID:
                continue
            if name in _BLOCK:
                flush()
                ends, stops = _CLOSES.get(name, ((), ()))
                if not any(held[t] > 0 for t in ends):
                    ends = stops = ()
                for k in range(len(stack) - 1, 0, -1):
                    t = stack[k][0]
                    if t == "p" or t in ends:
                        cut(k)
                        if t != "p":
                            break
                    elif t in stops or (t in _BLOCK and not ends):
                        break
                stack.append((name, self._node(stack[-1][1], name, attrs)))
                held[name] += 1
            elif not attrs.endswith("/"):
                stack.append((name, stack[-1][1]))
                held[name] += 1
                in_link += name == "a"
        flush()

    def kinds(self) -> list[int]:
        """Kind of each node for the pair potentials: plain elements follow their parent more than named ones, landmarks, and plain ones right
        in the body."""
        top = [p >= 0 and self.tag[p] in ("#root", "html", "body") for p in self.parent]
        return [2 if t in _LANDMARK else 1 if names else 3 if up else 0 for t, names, up in zip(self.tag, self.names, top, strict=True)]

    def features(self) -> list[list[str]]:
        """Names of the features that hold for each node."""
        n = len(self.parent)
        length, links, marks = self.length[:], self.links[:], self.marks[:]
        kids = [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            length[p] += length[i]
            links[p] += links[i]
            marks[p] += marks[i]
            kids[p] += 1
        out = []
        where, under = ["#root"] * n, [()] * n  # nearest landmark above, and the names of the nearest element above that has any
        for i in range(1, n):
            p = self.parent[i]
            where[i] = self.tag[p] if self.tag[p] in _LANDMARK else where[p]
            under[i] = self.names[p] or under[p]
        articles = min(2, sum(t in ("article", "main") for t in self.tag))
        for i in range(n):
            tag = self.tag[i]
            size, dense = length[i], links[i] / max(1, length[i])
            f = ["bias", f"tag {tag}", f"size {min(10, size.bit_length())}", f"links {min(4, int(dense * 5))}", f"leaf {kids[i] == 0}"]
            f.append(f"marks {min(4, int(100 * marks[i] / max(1, size)))}")
            f.append(f"in {where[i]} {tag}")
            f.append(f"{articles} of {tag if tag in _LANDMARK else where[i]}")
            f += [f"name {x}" for x in self.names[i]] or [f"bare {tag}"]
            f += [f"under {x}" for x in under[i]]
            if self.pieces[i]:
                f.append(f"own {tag} {min(10, self.length[i].bit_length()) // 2}")
            out.append(f)
        return out


def marginals(unary: list[float], parent: list[int], kind: list[int], pairs: list) -> tuple[list[float], list, float]:
    """Exact sum-product on a tree: P(content) of each node, expected counts of (parent, child) states by
    the child's kind, and log Z."""
    n = len(unary)
    up0, up1 = [0.0] * n, [0.0] * n  # messages to the parent
    b0, b1 = [0.0] * n, list(unary)  # own potential and messages of the children
    add = lambda x, y: (x + math.log1p(math.exp(y - x))) if x > y else (y + math.log1p(math.exp(x - y)))
    for i in range(n - 1, 0, -1):
        (p00, p01), (p10, p11) = pairs[kind[i]]
        up0[i], up1[i] = add(p00 + b0[i], p01 + b1[i]), add(p10 + b0[i], p11 + b1[i])
        p = parent[i]
        b0[p] += up0[i]
        b1[p] += up1[i]
    z = add(b0[0], b1[0])
    d0, d1 = b0[:], b1[:]  # beliefs, once the message from above has come
    edges = [[[0.0, 0.0], [0.0, 0.0]] for _ in pairs]
    for i in range(1, n):
        p = parent[i]
        a0, a1 = d0[p] - up0[i], d1[p] - up1[i]
        (p00, p01), (p10, p11) = pairs[kind[i]]
        e = edges[kind[i]]
        e[0][0] += math.exp(a0 + p00 + b0[i] - z)
        e[0][1] += math.exp(a0 + p01 + b1[i] - z)
        e[1][0] += math.exp(a1 + p10 + b0[i] - z)
        e[1][1] += math.exp(a1 + p11 + b1[i] - z)
        d0[i] = b0[i] + add(a0 + p00, a1 + p10)
        d1[i] = b1[i] + add(a0 + p01, a1 + p11)
    return [math.exp(x - z) for x in d1], edges, z


class Forest:
    """Trees of many pages side by side, for training: the same messages as in marginals(), level by level over all trees at once."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parent) for p in pages]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        self.roots, self.tree = first, np.repeat(np.arange(len(pages)), sizes)
        self.parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first, strict=True)])
        self.parent[first] = -1
        self.kind = np.concatenate([p.kinds() for p in pages])
        depth = np.zeros(len(self.parent), int)
        for i, p in enumerate(self.parent.tolist()):  # parents stand before their children
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.child = np.flatnonzero(self.parent >= 0)
        #: Edges of each kind of each tree.
        self.edges = np.zeros((len(pages), _KINDS))
        np.add.at(self.edges, (self.tree[self.child], self.kind[self.child]), 1)

    def marginals(self, unary: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(content) of each node, P of each pair of states of each edge (by self.child), log Z of each tree."""
        n = len(unary)
        b, up = np.zeros((2, n)), np.zeros((2, n))
        b[1] = unary
        for level in reversed(self.levels):
            q = pairs[self.kind[level]]
            for s in (0, 1):
                up[s, level] = np.logaddexp(q[:, s, 0] + b[0, level], q[:, s, 1] + b[1, level])
                np.add.at(b[s], self.parent[level], up[s, level])
        z = np.logaddexp(b[0, self.roots], b[1, self.roots])
        d, edges = b.copy(), np.zeros((n, 2, 2))
        for level in self.levels:
            p, q = self.parent[level], pairs[self.kind[level]]
            above = d[:, p] - up[:, level]
            for s in (0, 1):
                for t in (0, 1):
                    edges[level, s, t] = np.exp(above[s] + q[:, s, t] + b[t, level] - z[self.tree[level]])
            for t in (0, 1):
                d[t, level] = b[t, level] + np.logaddexp(above[0] + q[:, 0, t], above[1] + q[:, 1, t])
        return np.exp(d[1] - z[self.tree]), edges[self.child], z


def no_content(edges: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Score of the assignment in which no node is content, by the edges of each kind."""
    return edges @ pairs[:, 0, 0]


def with_none(z, z0, weight: float) -> tuple:
    """Once the assignment without content (score z0 of log Z) has a weight: by what the probabilities of all others grow, and its own probability."""
    rest = -np.expm1(np.minimum(z0 - z, -1e-12))  # all others' share before
    own = np.exp(z0 - z + weight)
    return 1 / (rest + own), own / (rest + own)


class Model:
    def __init__(self, weights: dict[str, float], pairs: list, none: float):
        self.weights, self.pairs, self.none = weights, pairs, none

    def content(self, page: Page) -> tuple[list[float], float]:
        """P(content) of each node, and of a page without content."""
        w = self.weights
        unary = [sum(w.get(f, 0.0) for f in fs) for fs in page.features()]
        kinds = page.kinds()
        p, _, z = marginals(unary, page.parent, kinds, self.pairs)
        grow, none = with_none(z, no_content(np.bincount(kinds[1:], minlength=_KINDS), np.array(self.pairs)), self.none)
        return [x * float(grow) for x in p], float(none)

    def blocks(self, page: Page) -> list[bool]:
        """Whether each block is content. A lost article counts as three made up, so a page is left without content only if that is as likely as
        NONE: where no block reaches one half before, those count that are at least half as likely as the likeliest one."""
        p, none = self.content(page)
        bar, best = 0.5, max((p[i] for i, _ in page.blocks), default=0.0)
        if best < 0.5 and none < NONE:
            bar = best / 2
        return [p[i] >= bar for i, _ in page.blocks]

    def text(self, html: str | None) -> str:
        page = Page(html or "")
        if not page.blocks:
            return ""
        if len(page.parent) == 1:  # no element: nothing to tell apart
            return "\n".join(t for _, t in page.blocks)
        return "\n".join(t for (_, t), yes in zip(page.blocks, self.blocks(page), strict=True) if yes)


def train(pages: list[str], steps: int = 200, rate: float = 0.25, ridge: float = 0.002) -> Model:
    """Maximum likelihood of the pages' labels, by gradient steps scaled with Adam that get smaller towards the end."""
    parsed = [Page(h, labelled=True) for h in pages]
    forest = Forest(parsed)
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in fs] for p in parsed for fs in p.features()]
    flat, owner = np.array([k for r in rows for k in r]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, nodes, child = len(index), len(rows), forest.child
    size = n + 4 * _KINDS + 1
    y = np.concatenate([p.label for p in parsed])
    by_kind = lambda edges: np.stack([edges[forest.kind[child] == k].sum(0) for k in range(_KINDS)])
    states = np.zeros((len(child), 2, 2))
    states[np.arange(len(child)), y[forest.parent[child]], y[child]] = 1
    none = np.bincount(forest.tree, y, minlength=len(parsed)) == 0
    seen = np.concatenate([np.bincount(flat, y[owner], minlength=n), by_kind(states).ravel(), [none.sum()]])
    theta, m, v = (np.zeros(size) for _ in range(3))
    for step in range(1, steps + 1):
        pairs = theta[n:-1].reshape(_KINDS, 2, 2)
        p, edges, z = forest.marginals(np.bincount(owner, theta[flat], minlength=nodes), pairs)
        z0 = no_content(forest.edges, pairs)
        grow, own = with_none(z, z0, theta[-1])
        e = by_kind(edges * grow[forest.tree[child], None, None])
        # All edges of the assignment without content count by its new probability.
        e[:, 0, 0] += ((own - np.exp(z0 - z) * grow)[:, None] * forest.edges).sum(0)
        expect = np.concatenate([np.bincount(flat, (p * grow[forest.tree])[owner], minlength=n), e.ravel(), [own.sum()]])
        g = (seen - expect) / len(parsed) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        theta += rate * min(1.0, 2 * (1 - (step - 1) / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
    return Model({f: float(theta[k]) for f, k in index.items()}, theta[n:-1].reshape(_KINDS, 2, 2).tolist(), float(theta[-1]))


@functools.cache
def default_model() -> Model:
    return train(labelled_pages(1200))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    model = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [model.text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
