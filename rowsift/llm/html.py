"""HTML extraction by a tree-structured graphical model.

Every element of the DOM is a node with two states, content or boilerplate.  Unary potentials are linear in features of the
node, parent-child potentials connect each node to its parent.  Sum-product messages pass from the leaves
to the root and back, level by level for a whole slice of pages at once, and give exact
marginals.  Both kinds of potentials are trained by the exact gradient of the likelihood of labelled pages (empirical minus
expected counts).  The text of the nodes whose content marginal exceeds one half, in document order, is the extract.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import slices

LABELLED, SEED = 300, 11
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*[\"']?([^\"'>]*)", re.I)
_LABEL = re.compile(r"data-content=\"([01])\"")
_POOR = re.compile(r"nav|menu|foot|head|side|promo|banner|cookie|share|social|comment|related|widget|\bad[s-]?\b|sponsor|breadcrumb|legal", re.I)
_RICH = re.compile(r"article|content|post|body|story|entry|text|main", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_CLOSE = {name: re.compile(f"</{name}", re.I | re.A) for name in _RAW}
_BLOCK = frozenset("html body div p article section main header footer nav aside ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote form dl dt dd figure figcaption head title".split())
#: An opening tag ends these if they are open and nothing of the second set lies between.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_FENCE = frozenset("html body div article section main header footer nav aside ul ol table form blockquote".split())
_CLOSES_P = _BLOCK - {"html", "body", "head", "title", "li", "tr", "td", "th", "dt", "dd"}

GROUPS = {name: i for i, names in enumerate(("p pre blockquote", "a", "li dt dd", "div span b i em strong font", "h1 h2 h3 h4 h5 h6", "td th tr table tbody", "article main section", "nav header footer aside form button", "html body ul ol dl", "head title script style noscript template textarea svg iframe")) for name in names.split()}
N_GROUPS = 11
N_FEATURES = N_GROUPS + 14
_PARTS = {"p": 0, "h1": 0, "h2": 0, "h3": 0, "li": 1, "a": 1, "nav": 1, "ul": 1}


class Page:
    """Elements in document order: parent, group, depth, own text, links, hints; pieces are (node, text)."""

    def __init__(self, html: str):
        self.parent, self.tag, self.depth, self.hint, self.label = [-1], ["#page"], [0], [""], [-1]
        self.pieces: list[tuple[int, str]] = []
        stack, at = [0], 0
        open_ = Counter()  # open elements by name, so a name that isn't open is never sought
        end = len(html)

        def close(k: int) -> None:
            open_.subtract(self.tag[node] for node in stack[k:])
            del stack[k:]

        while True:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at:
                chunk = html[at:stop]
                if not chunk.isspace():
                    self.pieces.append((stack[-1], unescape(chunk) if "&" in chunk else chunk))
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1) if open_[name] else ():
                    if self.tag[stack[k]] == name:
                        close(k)
                        break
                    if self.tag[stack[k]] in _FENCE and name not in _FENCE:
                        break
                continue
            if name == "br":
                self.pieces.append((stack[-1], "\n"))
                continue
            if name in _VOID:
                continue
            closing = _ENDS.get(name, ())
            if any(open_[t] for t in closing) or (name in _CLOSES_P and open_["p"]):
                for k in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[k]]
                    if t in closing or (t == "p" and name in _CLOSES_P):
                        close(k)
                        break
                    if t in _FENCE:
                        break
            attrs = m.group(3)
            node = len(self.parent)
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.depth.append(self.depth[stack[-1]] + 1)
            hints = _HINT.findall(attrs) if attrs else ()
            self.hint.append(" ".join(hints))
            lab = _LABEL.search(attrs) if attrs else None
            self.label.append(int(lab.group(1)) if lab else -1)
            if name in _RAW and not (name == "svg" and attrs.endswith("/")):
                found = _CLOSE[name].search(html, at)
                at = end if not found else (html.find(">", found.end()) + 1 or end)
            elif not attrs.endswith("/"):
                stack.append(node)
                open_[name] += 1


class Forest:
    """The nodes of several pages as arrays; node 0 of each page is its root."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        base = np.repeat(self.first, sizes)
        parent = np.array([x for p in pages for x in p.parent], dtype=np.int64)
        self.parent = np.where(parent < 0, -1, parent + base)
        self.depth = np.array([x for p in pages for x in p.depth], dtype=np.int64)
        tags = [t for p in pages for t in p.tag]
        group = np.array([GROUPS.get(t, N_GROUPS - 1) for t in tags], dtype=np.int64)
        self.hidden = group == 9
        self.block = np.array([t in _BLOCK for t in tags])
        self.label = np.array([x for p in pages for x in p.label], dtype=np.int64)
        own, words, ends = np.zeros(n), np.zeros(n), np.zeros(n)
        for p, b in zip(pages, self.first.tolist(), strict=True):
            for node, text in p.pieces:
                own[b + node] += len(text)
                words[b + node] += text.count(" ") + 1
                ends[b + node] += text.count(". ") + text.count(".") + text.count(",")
        hints = [h for p in pages for h in p.hint]
        poor = np.array([1.0 if h and _POOR.search(h) else 0.0 for h in hints])
        rich = np.array([1.0 if h and _RICH.search(h) else 0.0 for h in hints])
        linked = np.where(group == 1, own, 0.0)
        below, links, items = own.copy(), linked.copy(), np.zeros(n)
        kids = np.zeros(n)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])[1:] if n else []
        shade = np.maximum(poor, np.where(group == 7, 1.0, 0.0))
        for level in reversed(self.levels):
            up = self.parent[level]
            np.add.at(below, up, below[level])
            np.add.at(links, up, links[level])
            np.add.at(items, up, (group[level] == 2).astype(float))
            np.add.at(kids, up, 1)
        for level in self.levels:
            shade[level] = np.maximum(shade[level], shade[self.parent[level]])
        density = links / np.maximum(below, 1)
        x = np.zeros((n, N_FEATURES), dtype=np.float64)
        x[np.arange(n), group] = 1
        f = N_GROUPS
        above = np.where(self.parent >= 0, self.parent, np.arange(n))
        for k, col in enumerate((np.ones(n), np.log1p(own) / 5, np.log1p(words) / 4, np.log1p(ends) / 3, np.log1p(below) / 8, density, density[above], poor, rich, shade, np.minimum(self.depth, 12) / 12, (own == 0), np.log1p(kids) / 4, np.log1p(items) / 3)):
            x[:, f + k] = col
        self.x = x


class TreeModel:
    """Weights of the unary potential of content, and the 2 x 2 log-potentials of parent and child, for block and inline children."""

    def __init__(self):
        self.w = np.zeros(N_FEATURES)
        self.pair = np.zeros((2, 2, 2))

    def infer(self, forest: Forest) -> tuple[np.ndarray, np.ndarray, float]:
        """(content marginals, marginals of each node with its parent [parent, child], sum of log partition functions)."""
        n = len(forest.parent)
        up = np.zeros((n, 2))
        up[:, 1] = forest.x @ self.w
        kind = forest.block.astype(np.int64)
        message = np.zeros((n, 2))
        for level in reversed(forest.levels):
            s = up[level][:, None, :] + self.pair[kind[level]]
            message[level] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            p = forest.parent[level]
            np.add.at(up, p, message[level])
        full = up.copy()
        both = np.zeros((n, 2, 2))
        for level in forest.levels:
            rest = full[forest.parent[level]] - message[level]
            joint = rest[:, :, None] + self.pair[kind[level]] + up[level][:, None, :]
            full[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            both[level] = joint - np.logaddexp(full[level, :1], full[level, 1:])[:, :, None]
        z = np.logaddexp(full[:, 0], full[:, 1])
        for level in forest.levels:
            both[level] = np.exp(both[level])
        return np.exp(full[:, 1] - z), both, float(z[forest.first].sum())

    def likelihood(self, forest: Forest, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of labels for all nodes, and its gradient by the weights and the pair potentials."""
        marginal, both, z = self.infer(forest)
        kids = np.flatnonzero(forest.parent >= 0)
        tp, tc, kind = truth[forest.parent[kids]], truth[kids], forest.block[kids].astype(np.int64)
        value = float((forest.x @ self.w)[truth == 1].sum() + self.pair[kind, tp, tc].sum() - z)
        g = np.zeros((2, 2, 2))
        np.add.at(g, (kind, tp, tc), 1)
        for k in (0, 1):
            g[k] -= both[kids[kind == k]].sum(axis=0)
        return value, forest.x.T @ (truth - marginal), g

    def fit(self, forest: Forest, truth: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 0.3) -> TreeModel:
        """Adam on the penalised log-likelihood per page."""
        pages = max(1, len(forest.first))
        theta = np.zeros(N_FEATURES + 8)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, rounds + 1):
            self.w, self.pair = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
            _, gw, gp = self.likelihood(forest, truth)
            g = (np.concatenate([gw, gp.ravel()]) - decay * theta) / pages
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        self.w, self.pair = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
        return self


def labels_of(forest: Forest) -> np.ndarray:
    """A label for every node: its own, else that of the nearest labelled ancestor, else boilerplate."""
    out = np.where(forest.label < 0, 0, forest.label)
    for level in forest.levels:
        own = forest.label[level]
        out[level] = np.where(own < 0, out[forest.parent[level]], own)
    return out


def labelled_pages(n: int = LABELLED, seed: int = SEED) -> list[str]:
    """Pages of several layouts with data-content marks on the elements where content begins or ends."""
    r = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéèäöüñ"

    def word() -> str:
        return "".join(letters[i] for i in r.integers(0, len(letters), r.integers(2, 11)))

    def sentence(lo: int, hi: int) -> str:
        marks = ["", "", "", ",", "###", "&amp;&amp;"] if noisy else ["", "", "", ","]
        return " ".join(word() + marks[r.integers(len(marks))] for _ in range(r.integers(lo, hi))).capitalize() + "."

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k))

    out = []
    for _ in range(n):
        noisy = r.random() < 0.2
        style = r.integers(7)
        tag, attr = [("article", ""), ("main", ""), ("div", ' class="post-content"'), ("div", ""), ("section", ' id="story"'), ("td", ""), ("td", "")][style]
        parts = [f"<h1>{sentence(3, 9)}</h1>"]
        for _ in range(r.integers(1, r.choice([4, 14]))):
            kind = r.random()
            body = " ".join(sentence(3, 20) for _ in range(r.integers(1, 6)))
            if kind < 0.55:
                parts.append(f"<p>{body}</p>")
            elif kind < 0.7:
                parts.append(f"<p><b>{body}<br>")
            elif kind < 0.78:
                parts.append(f"<p>{body} <a href='/{word()}'>{word()}</a> {sentence(2, 8)}")
            elif kind < 0.84:
                parts.append(f"<h2>{sentence(2, 6)}</h2><div>{body}</div>")
            elif kind < 0.9:
                parts.append("<ul>" + "".join(f"<li>{sentence(4, 14)}</li>" for _ in range(r.integers(2, 6))) + "</ul>")
            elif kind < 0.95:
                parts.append(f'<div data-content="0" class="{["ad", "share", "related", "promo"][r.integers(4)]}">{sentence(2, 8)}</div>')
            else:
                parts.append(f"<blockquote>{body}</blockquote>")
        content = f'<{tag}{attr} data-content="1">{"".join(parts)}</{tag}>'
        if tag == "td":
            cell = ["", f"<td><ul>{links(r.integers(2, 7))}</ul></td>", f"<td>{'<br>'.join(f'<a href={word()}>{word()}</a>' for _ in range(r.integers(2, 7)))}</td>"][r.integers(3)]
            content = f"<table><tr>{cell}{content}</tr></table>"
        nav = [f"<nav><ul>{links(r.integers(3, 9))}</ul></nav>", f'<div class="menu">{links(r.integers(3, 9))}</div>', f"<ul>{links(r.integers(4, 10))}</ul>", ""][r.integers(4)]
        ad = ["", f'<div class="ad">{sentence(2, 12)}</div>', f"<div class='banner'><p>{sentence(3, 10)}</p></div>", f"<aside><h3>{word()}</h3><p>{sentence(3, 18)}</p>{links(3)}</aside>"][r.integers(4)]
        foot = [f"<footer>&copy; {word()}.example.com &middot; {sentence(2, 10)}</footer>", f'<div id="footer"><p>{sentence(3, 14)}</p><a href="/{word()}">{word()}</a></div>', ""][r.integers(3)]
        cookie = f'<div class="cookie">{sentence(5, 14)} <button>{word()}</button></div>' if r.random() < 0.3 else ""
        head = f"<head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        out.append(f'<!DOCTYPE html><html lang="en">{head}<body>{cookie}{nav}<!-- x -->{ad}{content}{foot}</body></html>')
    return out


@lru_cache(maxsize=2)
def trained(n: int = LABELLED, seed: int = SEED) -> TreeModel:
    forest = Forest([Page(p) for p in labelled_pages(n, seed)])
    return TreeModel().fit(forest, labels_of(forest))


_SPACE = re.compile(r"[ \t\r\f\v]*\n\s*|[ \t\r\f\v]{2,}|\t")


def extract(htmls: list[str | None], model: TreeModel) -> list[tuple[str, int, int, float]]:
    """(text, nodes, content nodes, mean certainty) of each page."""
    pages = [Page(h or "") for h in htmls]
    forest = Forest(pages)
    marginal, _, _ = model.infer(forest)
    chosen = (marginal > 0.5) & ~forest.hidden
    for level in forest.levels:  # what lies in a hidden element is hidden
        forest.hidden[level] |= forest.hidden[forest.parent[level]]
    chosen &= ~forest.hidden
    certain = np.maximum(marginal, 1 - marginal)
    owner = np.arange(len(forest.parent))  # nearest block element
    for level in forest.levels:
        owner[level] = np.where(forest.block[level], level, owner[forest.parent[level]])
    out = []
    for page, first in zip(pages, forest.first.tolist(), strict=True):
        parts, last = [], -1
        for node, text in page.pieces:
            if chosen[first + node]:
                here = owner[first + node]
                parts.append(text if here == last else "\n" + text)
                last = here
        text = _SPACE.sub(lambda m: "\n" if "\n" in m.group() else " ", "".join(parts)).strip()
        span = slice(first, first + len(page.parent))
        out.append((text, len(page.parent) - 1, int(chosen[span].sum()), round(float(certain[span].mean()), 4)))
    return out


EXTRACTS = "page_id long, url string, text string, n_nodes int, n_content int, certainty double"


def extracted(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_nodes, n_content, certainty), one row a page.

    ``certainty`` is the mean over nodes of the likelier state's marginal.  Defined cases: a null or empty page, and one
    without tags, has no element; text outside of any element belongs to the page's root and is judged like an element's; very long and very
    deep pages are read whole, in time that grows with their length; a node whose marginal is exactly one half is left out; null ids and urls are
    passed on; repeated rows are extracted each time; an empty table gives no rows; other columns
    play no part.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2_000_000):
                rows = list(zip(*extract(part.column(2).to_pylist(), shared.value), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))], names=names)

    names = [c.split()[0] for c in EXTRACTS.split(", ")]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, EXTRACTS)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
