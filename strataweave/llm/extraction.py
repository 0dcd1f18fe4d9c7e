"""Main text of web pages, by a tree-structured graphical model over the DOM.

Each block element and each run of text is a node that is content or not. A node's own potential is a sum of weights of its
tag and its parent's, the words of its class, id and role, its length, links, punctuation and share of the page; each edge has a
potential of the labels of parent and child, by the child's tag. Sum-product message passing, from the leaves up and from the
root down, gives the exact marginal of every node; runs of text with a marginal of one half or more are the main text. Weights are
those of greatest likelihood on labelled pages, whose gradient the same messages give.

Pages are labelled by ``data-main`` attributes: ``1`` begins content, ``0`` ends it, for an element and all below it. ``labelled_pages``
writes such pages from a seed (many layouts, semantic tags or classes or neither); ``train`` takes any others. The number of pages to train on
is a parameter, 700 by default, and bounds the work of the driver; pages of the corpus are neither sampled nor cut.

Defined results: a null or empty page has an empty text, as has one without content; pages are read whole, tags may be unclosed,
misnested or deeply nested (nothing recurses); ``br`` is white space, inline elements are none; character references are decoded once; white
space, also no-break, becomes one space; contents of scripts, styles, templates, frames, drawings, buttons and lists to choose from are
dropped; each row is judged by itself, so repeated rows have equal texts; an empty table gives an empty result; only id, url and html are looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import sliced

# ---------------------------------------------------------------- the DOM

TAGS = ("", "other", "html", "head", "body", "div", "p", "article", "main", "section", "aside", "nav", "header", "footer", "form", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "fieldset", "legend", "label", "center", "menu", "dialog")
NUMBER = {t: i for i, t in enumerate(TAGS)}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input link meta base area col param source track embed audio video canvas picture map object".split())
#: Their contents are no text; the first ones hold no markup either, so that they end with the page where no end tag follows.
RAW, DROPPED = frozenset("script style title textarea".split()), frozenset("noscript template iframe svg math select button noframes".split())
#: An element that begins ends open ones of these tags, up to one of those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set())}
TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|/([a-zA-Z][^\s/>]*+)[^>]*+>|[!?/][^>]*+>)""", re.DOTALL)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
MAIN = re.compile(r"""data-main\s*=\s*["']?([01])""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE = re.compile(r"[.!?,;:。，、؟](?:\s|$)")


@dataclass
class Page:
    """The nodes of pages in document order: a subtree is a run of nodes, from its root to ``end``."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    texts: dict[int, str] = field(default_factory=dict)
    roots: list[int] = field(default_factory=list)

    def node(self, tag: int, parent: int, depth: int, names: list[str], label: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(depth)
        self.end.append(0)
        self.names.append(names)
        self.label.append(label)
        for counts in (self.words, self.chars, self.linked, self.stops):
            counts.append(0)
        return len(self.tag) - 1

    def read(self, page: str, labelled: bool = False) -> None:
        """Adds the nodes of a page, below a root of its own."""
        root = self.node(NUMBER["other"], -1, 0, [], 0)
        self.roots.append(root)
        stack, open_tags = [(root, "")], Counter()
        run, in_link, linked, pos = [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            text = "".join(run)
            run.clear()
            share, linked = linked, 0
            if "&" in text:
                text = entities.unescape(text)
            if text := " ".join(text.split()):
                at = stack[-1][0]
                leaf = self.node(0, at, len(stack), [], self.label[at])
                self.texts[leaf], self.end[leaf] = text, leaf + 1
                self.words[leaf], self.chars[leaf], self.linked[leaf], self.stops[leaf] = text.count(" ") + 1, len(text), min(share, len(text)), len(SENTENCE.findall(text))

        def pop() -> None:
            at, name = stack.pop()
            open_tags[name] -= 1
            self.end[at] = len(self.tag)

        while m := TOKEN.search(page, pos):
            if m.start() > pos:
                run.append(page[pos : m.start()])
                linked += in_link and m.start() - pos
            pos = m.end()
            name, attributes, closing = m.groups()
            if closing:
                name = closing.lower()
                if name in INLINE:
                    in_link = in_link and name != "a"
                else:
                    flush()
                    if open_tags[name] > 0:
                        while stack[-1][1] != name:
                            pop()
                        pop()
                continue
            if not name:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "a":
                    in_link = True
                elif name == "br":
                    run.append(" ")
                continue
            if name in RAW or name in DROPPED:
                over = re.compile(rf"</{name}(?![\w-])[^>]*>", re.IGNORECASE).search(page, pos)
                pos = over.end() if over else len(page) if name in RAW else pos
                continue
            flush()
            if name == "hr":
                continue
            in_link = False
            if stack[-1][1] == "p":
                pop()
            if name in ENDS:
                ended, kept = ENDS[name]
                deep = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][1] in ended or stack[i][1] in kept), 0) if any(open_tags[t] > 0 for t in ended) else 0
                if deep and stack[deep][1] in ended:
                    while len(stack) > deep:
                        pop()
            at, label = stack[-1][0], 0
            if labelled:
                label = int(found[1]) if (found := MAIN.search(attributes)) else self.label[at]
            names = [t.lower() for value in NAMES.findall(attributes) for t in PART.findall(value)] if "=" in attributes else []
            stack.append((self.node(NUMBER.get(name, 1), at, len(stack), names, label), name))
            open_tags[name] += 1
        if pos < len(page):
            run.append(page[pos:])
            linked += in_link and len(page) - pos
        flush()
        while stack:
            pop()


# ---------------------------------------------------------------- potentials and messages

LENGTHS, LINKS, SHARES, STOPS = 11, 5, 7, 4
BLOCKS = np.cumsum([0, 2 * len(TAGS), 2 * LENGTHS * LINKS, 2 * SHARES * LENGTHS, 2 * STOPS * LENGTHS, len(TAGS) ** 2])


def dense(page: Page) -> np.ndarray:
    """The features that every node has one of each: a row of numbers for each node."""
    tag, parent, end = (np.array(x, np.int64) for x in (page.tag, page.parent, page.end))
    at = np.arange(len(tag))
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (page.words, page.chars, page.linked, page.stops)]
    words, chars, linked, stops = (s[end] - s[at] for s in sums)
    whole = np.repeat(words[page.roots], np.diff(np.append(page.roots, len(tag))))
    over = np.where(parent < 0, 1, tag[np.maximum(parent, 0)])
    leaf = tag == 0
    length = np.minimum(np.ceil(np.log2(words + 1)).astype(np.int64), LENGTHS - 1)
    link = np.searchsorted([0.05, 0.3, 0.6, 0.95], linked / np.maximum(chars, 1), side="right")
    share = np.searchsorted([0.005, 0.02, 0.08, 0.25, 0.5, 0.8], words / np.maximum(whole, 1), side="right")
    stop = np.searchsorted([0.001, 0.05, 0.15], stops / np.maximum(words, 1), side="right")
    return np.stack([BLOCKS[0] + np.where(leaf, over, len(TAGS) + tag), BLOCKS[1] + (leaf * LENGTHS + length) * LINKS + link, BLOCKS[2] + (leaf * SHARES + share) * LENGTHS + length, BLOCKS[3] + (leaf * STOPS + stop) * LENGTHS + length, BLOCKS[4] + over * len(TAGS) + tag], axis=1)


def levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []


def marginals(unary: np.ndarray, edge: np.ndarray, parent: np.ndarray, by_level: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By sum-product: the probability that each node is content, that of each (parent, child) pair of labels, and the logarithm of the sum over each tree.

    unary: log potential of content, node by node. edge: log potentials [node, parent's label, own label].
    """
    up = np.stack([np.zeros(len(unary)), unary], axis=1)  # of each subtree, by its root's label
    sent = np.zeros((len(unary), 2))
    for nodes in by_level[:0:-1]:
        both = edge[nodes] + up[nodes][:, None, :]
        sent[nodes] = np.logaddexp(both[..., 0], both[..., 1])
        np.add.at(up, parent[nodes], sent[nodes])
    down, pair = np.zeros((len(unary), 2)), np.zeros((len(unary), 2, 2))
    for nodes in by_level[1:]:
        above = down[parent[nodes]] + up[parent[nodes]] - sent[nodes]
        both = edge[nodes] + above[:, :, None]
        down[nodes] = np.logaddexp(both[:, 0], both[:, 1])
        both += up[nodes][:, None, :]
        both -= both.max(axis=(1, 2), keepdims=True)
        pair[nodes] = np.exp(both) / np.exp(both).sum(axis=(1, 2), keepdims=True)
    belief = down + up
    whole = np.logaddexp(belief[:, 0], belief[:, 1])
    return np.exp(belief[:, 1] - whole), pair, whole


@dataclass
class Model:
    """Weights of the dense features and of names, and the potentials of edges by the child's tag."""

    weights: np.ndarray
    names: dict[str, int]
    edges: np.ndarray

    def named(self, page: Page) -> tuple[np.ndarray, np.ndarray]:
        known = [(i, self.names[t]) for i, names in enumerate(page.names) if names for t in set(names) if t in self.names]
        return (np.array(known, np.int64) if known else np.zeros((0, 2), np.int64)).T

    def contents(self, page: Page) -> np.ndarray:
        """The marginal of each node."""
        row, name = self.named(page)
        unary = self.weights[dense(page)].sum(axis=1) + np.bincount(row, self.weights[name], len(page.tag))
        parent, tag = np.array(page.parent, np.int64), np.array(page.tag, np.int64)
        return marginals(unary, self.edges[tag], parent, levels(np.array(page.depth)))[0]


def train(pages: list[str], steps: int = 80, rate: float = 0.12, penalty: float = 2e-4) -> Model:
    """The weights of greatest penalised likelihood, by Adam's steps on all pages."""
    page = Page()
    for p in pages:
        page.read(p, labelled=True)
    often = Counter(t for names in page.names for t in set(names))
    names = {t: int(BLOCKS[-1]) + i for i, t in enumerate(sorted(t for t, n in often.items() if n >= 3))}
    model = Model(np.zeros(int(BLOCKS[-1]) + len(names)), names, np.zeros((len(TAGS), 2, 2)))
    fixed, (row, name) = dense(page), model.named(page)
    parent, tag, label, by_level = np.array(page.parent), np.array(page.tag), np.array(page.label), levels(np.array(page.depth))
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((len(tag), 2, 2))
    seen[child, label[parent[child]], label[child]] = 1
    slots = [np.zeros_like(x) for x in (model.weights, model.weights, model.edges, model.edges)]
    for step in range(1, steps + 1):
        unary = model.weights[fixed].sum(axis=1) + np.bincount(row, model.weights[name], len(tag))
        inside, pair, _ = marginals(unary, model.edges[tag], parent, by_level)
        off = (label - inside) / len(pages)
        slope = np.bincount(fixed.ravel(), np.repeat(off, fixed.shape[1]), len(model.weights)) + np.bincount(name, off[row], len(model.weights)) - penalty * model.weights
        edge = np.zeros_like(model.edges)
        np.add.at(edge, tag[child], (seen - pair)[child] / len(pages))
        for x, g, m, v in ((model.weights, slope, slots[0], slots[1]), (model.edges, edge - penalty * model.edges, slots[2], slots[3])):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return model


# ---------------------------------------------------------------- labelled pages

#: Words of classes and ids by which site templates commonly name their parts.
COMMON = {
    "main": "content article post entry story main text body blog page single news".split(),
    "menu": "nav menu navbar navigation topnav links breadcrumb breadcrumbs tabs pagination pager toc".split(),
    "header": "header masthead top banner branding logo topbar site title".split(),
    "footer": "footer bottom copyright legal colophon foot credits".split(),
    "sidebar": "sidebar side aside rail widget widgets column secondary".split(),
    "notice": "cookie cookies notice consent gdpr alert message warning privacy popup modal overlay disclaimer paywall".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion adsense banner commercial".split(),
    "comments": "comments comment responses discussion disqus replies reply respond feedback reviews".split(),
    "form": "form search login signup subscribe newsletter register contact".split(),
    "share": "share sharing social related recommended more trending popular tags author follow".split(),
    "any": "row col grid inner box block wrap wrapper container left right clearfix item list group section module area wide primary".split(),
}
SEMANTIC = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}


def labelled_pages(n: int = 700, seed: int = 1) -> list[str]:
    """Pages of many layouts with their labels, the same for the same seed."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _page(rng: random.Random) -> str:
    pick, chance = rng.choice, lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick("bdfglmnprstvz") + pick("aeiouäé") for _ in range(rng.randint(1, 4)))

    def phrase(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def sentence() -> str:
        return phrase(1, 18).replace(" ", ", ", chance(0.3)) + pick("...?!" + " ")

    def prose(low: int, high: int) -> str:
        text = " ".join(sentence() for _ in range(rng.randint(low, high)))
        return pick(("{}", "{}", "{}", "<b>{}</b>", "{} <a href='/x'>" + word() + "</a> &amp; " + word(), "<em>" + word() + "</em> {}", "{}<br>" + sentence())).format(text)

    def named(kind: str) -> str:
        names = [pick(COMMON[kind])] + ([pick(COMMON["any"])] if chance(0.3) else [])
        if chance(0.25):
            names.append(pick(COMMON[kind]))
        return f" {pick(('class', 'class', 'class', 'id'))}={pick('"' + "'")}" + pick((" ", "-", "_")).join(names) + "\""

    def plain() -> str:
        return f' class="{pick(COMMON["any"])}"' if chance(0.4) else ""

    def fixed(kind: str, inside: str, label: int = 0) -> str:
        tag = SEMANTIC.get(kind, "div")
        tag, names = (tag, named(kind) if chance(0.3) or tag in ("div", "section") else "") if chance(0.6) else (pick(("div", "div", "section", "ul" if inside.startswith("<li") else "div")), named(kind))
        names = names.replace("='", '="')
        return f'<{tag}{names} data-main="{label}">{inside}</{tag}>'

    def links(low: int = 2, high: int = 12) -> str:
        some = [f"<a href='/{word()}'>{phrase(1, 4)}</a>" for _ in range(rng.randint(low, high))]
        way = rng.randrange(4)
        return " | ".join(some) if way == 0 else "<ul>" + "".join(f"<li>{x}</li>" for x in some) + "</ul>" if way < 3 else "".join(f"<div{plain()}>{x}</div>" for x in some)

    def short() -> str:
        return pick((sentence(), phrase(1, 5), prose(1, 3), prose(2, 6), f"<p>{prose(1, 4)}</p>", f"<h3>{phrase(1, 4)}</h3><p>{prose(1, 3)}</p>"))

    def menu() -> str:
        return fixed("menu", links())

    def advert() -> str:
        return fixed("advert", short())

    def notice() -> str:
        return fixed("notice", short() + pick(("", "<button>OK</button>", " <a href='#'>OK</a>")))

    def form() -> str:
        return fixed("form", pick(("", f"<label>{phrase(1, 3)}</label>", f"<p>{sentence()}</p>", sentence(), f"<h4>{phrase(1, 3)}</h4>")) + "<input name='q'>" + pick(("", "<button>Go</button>", "<select><option>a<option>b</select>")))

    def share() -> str:
        return fixed("share", pick((links(2, 6), f"<h3>{phrase(1, 3)}</h3>" + links(2, 6))))

    def comments() -> str:
        each = [f"<{t}{named('comments') if chance(0.5) else plain()}>".replace("='", '="') + pick(("", f"<b>{word()}</b> ", f"<div>{phrase(1, 2)}</div>")) + pick(("{}", "<p>{}</p>")).format(prose(1, 6)) + f"</{t}>" for t in ["li" if chance(0.3) else "div"] for _ in range(rng.randint(1, 6))]
        return fixed("comments", pick(("", f"<h3>{phrase(1, 3)}</h3>", f"<h2>{phrase(1, 2)}</h2>")) + "".join(each) + (form() if chance(0.3) else ""))

    def sidebar() -> str:
        return fixed("sidebar", "".join(pick((lambda: f"<h3>{phrase(1, 3)}</h3>" + links(), short, advert, share, form))() for _ in range(rng.randint(1, 4))))

    def header() -> str:
        return fixed("header", pick((f"<h1>{phrase(1, 3)}</h1>", f"<a href='/'>{phrase(1, 3)}</a>", phrase(1, 4), f"<p>{sentence()}</p>", f"<div>{phrase(1, 3)}</div><p>{prose(1, 2)}</p>")) + (menu() if chance(0.4) else "") + (form() if chance(0.2) else ""))

    def footer() -> str:
        return fixed("footer", pick(("", links(2, 8), f"<p>{prose(1, 4)}</p>")) + pick(("", "&copy; ", "&copy; 2020 ")) + pick((sentence(), word() + " &middot; " + sentence(), phrase(1, 5), f"<p>{prose(1, 3)}</p>")))

    def block() -> str:
        way = rng.random()
        if way < 0.62:
            return f"<p{plain() if chance(0.1) else ''}>{prose(1, pick((1, 3, 9)))}" + ("</p>" if chance(0.8) else "")
        if way < 0.7:
            return f"<p><b>{prose(1, 3)}<br><p>{prose(1, 6)}</p>"
        if way < 0.8:
            return f"<{(t := pick(('h2', 'h3', 'h4')))}>{phrase(1, 8)}</{t}>"
        if way < 0.87:
            return "<ul>" + "".join(f"<li>{pick((sentence(), phrase(1, 3), prose(1, 3)))}" for _ in range(rng.randint(1, 6))) + "</ul>"
        if way < 0.91:
            return f"<blockquote>{pick(('{}', '<p>{}</p>')).format(prose(1, 4))}</blockquote>"
        if way < 0.94:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{phrase(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if way < 0.97:
            return f"<figure><img src='a'><figcaption>{sentence()}</figcaption></figure>"
        return pick((f"<pre>{phrase(2, 20)}</pre>", f"<div>{prose(1, 5)}</div>", f"<section><h2>{phrase(1, 5)}</h2><p>{prose(1, 5)}</p></section>"))

    def article() -> str:
        parts = [block() for _ in range(pick((1, 2, 4, 8, 14)))]
        if chance(0.35):
            parts.insert(rng.randint(0, len(parts)), pick((advert, share, form, menu, notice))())
        head = pick(("", "<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>")).format(phrase(1, 12))
        if chance(0.08):
            parts = [f"<div>{prose(3, 9)}<br><br>{prose(2, 6)}</div>"]
        inside = head + "".join(parts) + (share() if chance(0.2) else "") + (comments() if chance(0.25) else "")
        tag = pick(("article", "article", "main", "div", "div", "div", "section", "td"))
        names = named("main").replace("='", '="') if chance(0.65) else plain()
        whole = f'<{tag}{names} data-main="1">{inside}</{tag}>'
        if tag == "td":
            side = f'<td data-main="0">{links()}</td>'
            return "<table><tr>" + pick((side + whole, whole + side, whole)) + "</tr></table>"
        if chance(0.25):
            outer = pick(("main", "div", "section"))
            return f"<{outer}{plain()}>{whole}{sidebar() if chance(0.3) else ''}</{outer}>"
        return whole

    before = [f() for f, p in ((notice, 0.25), (header, 0.5), (menu, 0.6), (advert, 0.35), (form, 0.1), (sidebar, 0.2)) if chance(p)]
    after = [f() for f, p in ((sidebar, 0.25), (advert, 0.2), (share, 0.2), (comments, 0.25), (form, 0.1), (menu, 0.15), (notice, 0.1)) if chance(p)]
    rng.shuffle(before)
    rng.shuffle(after)
    body = "".join(before) + article() + "".join(after) + (footer() if chance(0.75) else "")
    if chance(0.4):
        body = f"<div{plain()}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>{body}" + ("</body></html>" if chance(0.8) else "")


@cache
def default_model() -> Model:
    return train(labelled_pages())


# ---------------------------------------------------------------- the operator


def main_text(page: Page, model: Model) -> list[str]:
    """The main text of each page read."""
    inside = model.contents(page)
    out: list[list[str]] = [[] for _ in page.roots]
    leaves = list(page.texts)
    of = np.searchsorted(page.roots, leaves, side="right") - 1
    for leaf, i in zip(leaves, of.tolist()):
        if inside[leaf] >= 0.5:
            out[i].append(page.texts[leaf])
    return ["\n\n".join(x) for x in out]


def extract(pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or default_model()
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 2, 1 << 20):
                page = Page()
                for text in part.column(2).to_pylist():
                    page.read(text or "")
                texts = main_text(page, model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"id {types[id_column]}, url {types[url]}, text string, n_chars long").withColumnRenamed("id", id_column)
