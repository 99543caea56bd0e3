"""Main-text extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Each block has features of its ancestors (tags
and words of class, id and role) and of its text. A two-label chain is trained by stochastic gradient ascent on the
log-likelihood of labelled pages, and the best labelling of a page is found by Viterbi. The labelled pages are
generated from a fixed seed: many layouts of menus, notices, adverts, articles, comments and footers.

A page is read in one pass, in time in proportion to its length, whatever its nesting and quotes. Names of elements are
taken whole, so that ``<object-view>`` is no ``<object>``.

Defined cases: a null or empty page, and one without text, gives an empty text; a page of plain text without markup is
its own main text; unclosed tags, comments, scripts and styles end with the page, other unclosed elements that hold no
text of the page are ignored; a quote that is never closed is a character like others; what ``hidden``, ``aria-hidden``
or ``display: none`` hides is no main text, and a hidden inline element that is not closed ends
with its block; repeated rows give the same text; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
SELF_CLOSING = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}

#: What these elements hold is no text of the page; of the first group, to the page's end where they are not closed.
RAW = frozenset("script style textarea title".split())
APART = RAW | frozenset("noscript template svg iframe object select button".split())
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in APART}
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>]+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MAY_HIDE = re.compile(r"hidden|display|visibility", re.I)
PARTS = re.compile(r"[a-z]+")


#: The mark of a hidden part among the words of its element.
HIDDEN = "hiddenpart"


@dataclass(slots=True)
class Node:
    """An open element: its features that no element around it has, and where it stands."""

    tag: str
    parent: Node | None
    features: tuple[str, ...]
    score: float | None = None


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    linked: float  # share of the characters inside links


def tag_end(page: str, at: int, never: dict[str, bool]) -> int:
    """Where the tag's ``>`` stands, -1 if nowhere; ``never`` keeps which quotes do not occur any more."""
    while True:
        stop = page.find(">", at)
        if stop < 0:
            return -1
        equals = page.find("=", at, stop)
        if equals < 0:
            return stop
        at = equals + 1
        while at < stop and page[at].isspace():
            at += 1
        quote = page[at]
        if quote in "\"'" and not never.get(quote):
            close = page.find(quote, at + 1)
            if close < 0:
                never[quote] = True
            else:
                at = close + 1


def attribute_words(attributes: str) -> list[str]:
    """The distinct words of class, id and role, and a mark for a part that is hidden."""
    words, unseen = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words += PARTS.findall(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and UNSEEN.search(value)):
            unseen = True
    return [*dict.fromkeys(words), *[HIDDEN] * unseen]


class Reader:
    """Cuts a page into its leaf blocks in order, white space folded and references decoded."""

    def __init__(self, page: str):
        self.page = page
        self.blocks: list[Block] = []
        self.stack: list[tuple[Node, list[str]]] = []  # open elements with all their features
        self.places: dict[str, list[int]] = {}  # where the elements of a name stand in the stack
        self.held: dict[str, int] = {}  # features of open elements
        self.text: list[str] = []
        self.size = self.linked = 0
        self.in_link = False
        self.unseen, self.depth = "", 0  # the hidden inline element that is open, and how many of its name

    def add(self, piece: str) -> None:
        if self.unseen:
            return
        self.text.append(piece)
        self.size += len(piece)
        if self.in_link:
            self.linked += len(piece)

    def flush(self) -> None:
        if self.text:
            folded = " ".join(html_lib.unescape("".join(self.text)).split())
            if folded:
                node = self.stack[-1][0] if self.stack else None
                self.blocks.append(Block(folded, node, min(1.0, self.linked / max(1, self.size))))
            self.text = []
        self.size = self.linked = 0

    def open(self, tag: str, attributes: str) -> None:
        mine = ["t:" + tag]
        if attributes:
            for w in attribute_words(attributes):
                mine.append("w:" + w)
                if len(w) > 6:
                    mine.append("w:" + w[:6] + "*")
            mine = list(dict.fromkeys(mine))
        new = tuple(f for f in mine if not self.held.get(f))
        for f in mine:
            self.held[f] = self.held.get(f, 0) + 1
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((Node(tag, self.stack[-1][0] if self.stack else None, new), mine))

    def close(self, tag: str) -> None:
        """Close the innermost element of the name, and all inside it."""
        if spots := self.places.get(tag):
            for node, mine in reversed(self.stack[spots[-1] :]):
                self.places[node.tag].pop()
                for f in mine:
                    self.held[f] -= 1
                self.stack.pop()

    def innermost(self, *tags: str) -> int:
        return max((spots[-1] for t in tags if (spots := self.places.get(t))), default=-1)

    def read(self) -> list[Block]:
        page, at, size = self.page, 0, len(self.page)
        never: dict[str, bool] = {}
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self.add(page[at:])
                break
            if start > at:
                self.add(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
                continue
            m = TAG.match(page, start + 1)
            if m is None:
                self.add("<")
                at = start + 1
                continue
            end = tag_end(page, m.end(), never)
            if end < 0:
                break
            at = end + 1
            tag = m[2].lower()
            if tag in APART and not m[1] and not never.get(tag):
                closing = CLOSING[tag].search(page, at)
                if tag != "button":
                    self.flush()
                if closing or tag in RAW:
                    at = closing.end() if closing else size
                    continue
                never[tag] = True
            self.element(tag, bool(m[1]), page[m.end() : end])
        self.flush()
        return self.blocks

    def element(self, tag: str, closes: bool, attributes: str) -> None:
        if tag in INLINE:
            if self.unseen:
                if tag == self.unseen:
                    self.depth += -1 if closes else 1
                    if not self.depth:
                        self.unseen = ""
            elif not closes and tag not in VOID and MAY_HIDE.search(attributes) and HIDDEN in attribute_words(attributes):
                self.unseen, self.depth = tag, 1
            if tag == "a":
                self.in_link = not closes
            elif tag == "br":
                self.text.append(" ")
            return
        self.unseen = ""  # a block ends what an inline element left open
        self.flush()
        if closes:
            self.close(tag)
            return
        if tag in CLOSES_P:
            self.close("p")
        elif tag in SELF_CLOSING and self.innermost(tag) > self.innermost(*SELF_CLOSING[tag]):
            self.close(tag)
        if tag not in VOID:
            self.open(tag, attributes)


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    return Reader(page).read()


def own_features(node: Node | None) -> list[str]:
    """What the innermost element adds by its place: its name, alone and behind its parent's."""
    tag = node.tag if node else ""
    return ["leaf:" + tag, "two:" + (f"{node.parent.tag}>{tag}" if node and node.parent else tag)]


def path_features(node: Node | None) -> list[str]:
    """Ancestor tags and name words; the innermost tag and its parent also by place."""
    out = own_features(node)
    while node is not None:
        out += node.features
        node = node.parent
    return sorted(out)


def text_features(b: Block, first: bool, last: bool) -> list[str]:
    n = b.text.count(" ") + 1
    end = b.text[-1]
    out = [f"n:{min(6, n.bit_length())}", f"link:{int(b.linked * 4 + 0.5)}", "stop" if end in ".!?…\"”»" else "open"]
    if "©" in b.text or b.text[:9].lower() == "copyright":
        out.append("copyright")
    if first:
        out.append("first")
    if last:
        out.append("last")
    return out


@dataclass
class Chain:
    """Weights: one per feature (for label 1 against 0), and ``moves[from][to]`` with start as row 2."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0] for _ in range(3)])

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels; ``scores`` are the blocks' weights for label 1."""
        (m00, m01), (m10, m11), (s0, s1) = self.moves
        if not scores:
            return []
        a, b = s0, s1 + scores[0]
        back = []
        for s in scores[1:]:
            to0, to1 = (0, 1)[b + m10 > a + m00], (0, 1)[b + m11 > a + m01]
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00), (b + m11 if to1 else a + m01) + s
        labels = [1 if b > a else 0]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def likelihood(feats: list[np.ndarray], labels: list[int], w: np.ndarray, moves: np.ndarray) -> tuple[float, list[float], np.ndarray]:
    """A page's conditional log-likelihood with its slopes: by block score, and by move. Forward-backward over two labels."""
    lse = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    n = len(feats)
    emit = [float(w[f].sum()) for f in feats]
    fwd = [(moves[2, 0], moves[2, 1] + emit[0])]
    for i in range(1, n):
        a, b = fwd[-1]
        fwd.append((lse(a + moves[0, 0], b + moves[1, 0]), lse(a + moves[0, 1], b + moves[1, 1]) + emit[i]))
    bwd = [(0.0, 0.0)] * n
    for i in range(n - 2, -1, -1):
        c, d = bwd[i + 1]
        d += emit[i + 1]
        bwd[i] = (lse(moves[0, 0] + c, moves[0, 1] + d), lse(moves[1, 0] + c, moves[1, 1] + d))
    total = lse(*fwd[-1])
    value = moves[2, labels[0]] + sum(e for e, y in zip(emit, labels) if y) - total
    by_block, slope = [], np.zeros((3, 2))
    for i in range(n):
        p = math.exp(min(0.0, fwd[i][1] + bwd[i][1] - total))
        by_block.append(labels[i] - p)
        if i:
            value += moves[labels[i - 1], labels[i]]
            for x in (0, 1):
                for y in (0, 1):
                    q = fwd[i - 1][x] + moves[x, y] + (emit[i] if y else 0.0) + bwd[i][y] - total
                    slope[x, y] -= math.exp(min(0.0, q))
            slope[labels[i - 1], labels[i]] += 1
        else:
            slope[2, 0] -= 1 - p
            slope[2, 1] -= p
            slope[2, labels[0]] += 1
    return float(value), by_block, slope


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 12, rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Stochastic gradient ascent on the conditional log-likelihood."""
    index: dict[str, int] = {}
    data = []
    for feats, labels in pages:
        if feats:
            data.append(([np.array([index.setdefault(f, len(index)) for f in fs]) for fs in feats], labels))
    w, moves = np.zeros(len(index)), np.zeros((3, 2))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for k in rng.permutation(len(data)):
            feats, labels = data[k]
            _, by_block, slope = likelihood(feats, labels, w, moves)
            w *= 1 - step * decay
            for f, x in zip(feats, by_block):
                w[f] += step * x
            moves += step * 0.3 * slope
    return Chain({f: float(w[i]) for f, i in index.items()}, moves.tolist())


class Pages:
    """Generates labelled pages: ``page()`` is HTML in which every block of the article holds the mark ``MARK``."""

    MARK = ""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        parts = "an er th ou en re la de que der ung los ion ti st ea in on é ü ci".split()
        common = "the of and to de la und die que en el a".split()
        style = r.random()
        out = [r.choice(common) if r.random() < 0.3 else "".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]
        if style < 0.08:
            out = [w + r.choice(["###", "***", "%%%", "$$$"]) for w in out]
        elif style < 0.12:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            out = " | ".join(out).split(" ")[:n] or out
        text = " ".join(out)
        return text[:1].upper() + text[1:] + (r.choice([".", ".", ".", "", "?"]))

    def pick(self, *xs):
        return self.r.choice(xs)

    def box(self, names: str, inner: str) -> str:
        r = self.r
        tag, _, rest = names.partition(" ")
        word = r.choice(rest.split()) if rest else ""
        if word and r.random() < 0.15:
            word = f"{word}-{self.pick('slot', 'area', 'wrap', 'inner', 'block')} {r.choice(rest.split())}"
        mark = "" if not word else f' class="{word}"' if r.random() < 0.6 else f' id="{word}"' if r.random() < 0.6 else f' class="box {word} x{r.randint(1, 9)}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    def links(self, lo=3, hi=9) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.words(r.randint(1, 3))}</a>' for i in range(r.randint(lo, hi))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " ".join(items)

    def paragraphs(self, n: int, mark: str) -> str:
        r, out = self.r, []
        for _ in range(n):
            k, body = r.random(), mark + self.words(r.choice([1, 2, 4, 9, 15, 30, 60, 110]))
            if k < 0.72:
                out.append(f"<p>{body}" + ("</p>" if r.random() < 0.9 else ""))
            elif k < 0.78:
                out.append(f"<p><b>{body}<br>")
            elif k < 0.84:
                out.append(f"<h{r.randint(2, 4)}>{mark}{self.words(r.randint(1, 8))}</h2>".replace("</h2>", f"</h{2}>") )
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{mark}{self.words(r.randint(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.91:
                out.append(f"<blockquote>{body}</blockquote>")
            elif k < 0.93:
                out.append(f"<pre>{body}</pre>")
            elif k < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{mark}{self.words(2)}</td><td>{mark}{self.words(3)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.97:
                out.append(f"<div>{body}</div>")
            else:
                out.append(f'<p>{body} <a href="#">{self.words(2)}</a> {self.words(5)}</p>')
        return "".join(out)

    def comments(self) -> str:
        r = self.r
        one = lambda: self.box(self.pick("div comment", "li comment reply", "article comment", "div response", "div reaction user-reaction", "li remark feedback", "div"), f"<p>{self.words(r.randint(3, 40))}</p>")
        return self.box(self.pick("section comments", "div comments discussion responses disqus", "ol commentlist comments", "div replies reader-comments", "section reactions user-reactions talkback", "div feedback remarks user-comments"),
                        f"<h3>{self.words(2)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def clutter(self) -> str:
        r = self.r
        s = lambda lo, hi: self.words(r.randint(lo, hi))
        return self.pick(
            self.box(self.pick("div ad ads advert banner-ad advertisement", "aside ad promo", "div sponsored promo sponsor"), self.pick(s(4, 18), f"<p>{s(4, 30)}</p>")),
            self.box(self.pick("div cookie notice consent cookie-banner gdpr alert", "section notice", "div cookies privacy-notice"), f"<p>{s(6, 30)}</p>"),
            self.box(self.pick("div share social share-buttons", "div related more recommended", "aside related"), self.links()),
            self.box(self.pick("aside", "aside sidebar", "div sidebar widget side", "div widget"), f"<h4>{s(1, 3)}</h4><p>{s(4, 40)}</p>" + (self.links() if r.random() < 0.5 else "")),
            self.box(self.pick("form", "form search newsletter", "div newsletter subscribe signup"), f"<label>{s(1, 4)}</label><input name=q><p>{s(3, 14)}</p><button>{s(1, 1)}</button>"),
            self.box(self.pick("div breadcrumbs breadcrumb", "nav breadcrumb pagination", "div pager"), self.links(2, 4)),
        )

    def hidden(self) -> str:
        r, inner = self.r, self.words(self.r.randint(2, 30))
        mark = self.pick('style="display:none"', "style='margin:0; display: none;'", "hidden", 'aria-hidden="true"', 'class="x" hidden')
        tag = self.pick("div", "p", "section", "li")
        return f"<{tag} {mark}>{inner if r.random() < 0.6 else f'<p>{inner}</p>'}</{tag}>"

    def bare(self) -> str:
        """A page that is all article: plain text, or paragraphs with nothing around them."""
        r, m = self.r, self.MARK
        body = self.pick(m + self.words(r.randint(1, 60)), self.paragraphs(r.randint(1, 4), m))
        if r.random() < 0.4:
            return body
        body = (f"<h1>{m}{self.words(r.randint(1, 6))}</h1>" if r.random() < 0.4 else "") + body
        return f"<html><body>{body}</body></html>" if r.random() < 0.6 else f"<html><head><title>{self.words(3)}</title></head><body><div>{body}</div></body></html>"

    def table(self) -> str:
        """A page laid out by a table, with few names or none: what stands beside the article is told by its text and place."""
        r, m = self.r, self.MARK
        cell = lambda names, inner: self.box("td " + names if r.random() < 0.3 else "td", inner)
        body = (f"<h{self.pick(1, 2)}>{m}{self.words(r.randint(2, 8))}</h2>" if r.random() < 0.7 else "") + self.paragraphs(self.pick(2, 3, 5, 8), m)
        left = cell("menu navigation", self.links(3, 8))
        right = cell("ads sponsors sidebar", f"<b>{self.words(1)}</b><br>{self.links(2, 5)}" if r.random() < 0.6 else f"<p>{self.words(r.randint(2, 6))}</p>{self.links(1, 4)}")
        row = self.pick(left, left, "") + cell("content article", body) + self.pick(right, "")
        top = f"<tr>{cell('header banner', self.pick(self.words(2), self.links(2, 6)))}</tr>" if r.random() < 0.6 else ""
        foot = f"<tr>{cell('footer copyright', self.pick('&copy; ', 'Copyright 2020 ', '') + self.words(r.randint(2, 8)))}</tr>" if r.random() < 0.7 else ""
        return f"<html><head><title>{self.words(3)}</title></head><body><table width=100%>{top}<tr>{row}</tr>{foot}</table></body></html>"

    def page(self) -> str:
        r, m = self.r, self.MARK
        kind = r.random()
        if kind < 0.16:
            return self.bare() if kind < 0.08 else self.table()
        title = self.words(r.randint(2, 12))
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t='<p>x</p>';</script></head><body>"
        top = [self.box(self.pick("nav", "nav menu navbar", "ul menu nav", "div nav navigation menu topnav"), self.links())]
        if r.random() < 0.5:
            top.append(self.box(self.pick("header", "header masthead site-header", "div header masthead banner"), f"<h{self.pick(1, 2, 3)}>{self.words(2)}</h1><p>{self.words(5)}</p>"))
        top += [self.clutter() for _ in range(r.randint(0, 3))]
        if r.random() < 0.15:
            top.append(self.hidden())
        if r.random() < 0.3:
            top.append(f"<!-- ad {r.randint(0, 99)} -->")
        inner = ""
        if r.random() < 0.85:
            inner += f"<h1>{m}{title}</h1>" if r.random() < 0.8 else f"<header><h1>{m}{title}</h1></header>"
        inner += self.paragraphs(self.pick(1, 1, 2, 3, 5, 8, 12, 20), m)
        while r.random() < 0.4:
            inner += self.clutter() + self.paragraphs(self.pick(1, 2, 4), m)
        if r.random() < 0.2:
            inner += self.hidden() + self.paragraphs(self.pick(1, 2), m)
        if r.random() < 0.2:
            inner += self.comments()
        kind = r.random()
        if kind < 0.45:
            body = self.box(self.pick("article", "article", "article post entry hentry"), inner)
        elif kind < 0.6:
            body = self.box("main", self.box(self.pick("article", "div content", "section"), inner))
        elif kind < 0.9:
            body = self.box(self.pick("div content post entry article story", "div main article-body post-content entry-content", "section content article", "main content"), inner)
        else:
            body = inner
        bottom = [self.comments()] if r.random() < 0.35 else []
        bottom += [self.clutter() for _ in range(r.randint(0, 2))]
        foot = self.box(self.pick("footer", "footer footer site-footer", "div footer bottom copyright colophon", "div site-info legal imprint siteinfo"), self.pick("&copy; ", "", "") + self.words(r.randint(2, 14)) + (self.links() if r.random() < 0.4 else ""))
        wrap = self.pick("", "", "page wrapper container site")
        middle = "".join(top) + body + "".join(bottom) + (foot if r.random() < 0.9 else "")
        return head + (self.box("div " + wrap, middle) if wrap else middle) + ("</body></html>" if r.random() < 0.8 else "")


def labelled(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    make, out = Pages(seed), []
    for _ in range(n):
        blocks = blocks_of(make.page())
        labels = [int(Pages.MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(Pages.MARK, "") or "."
        out.append((blocks, labels))
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    last = len(blocks) - 1
    return [path_features(b.node) + text_features(b, i == 0, i == last) for i, b in enumerate(blocks)]


@lru_cache(maxsize=4)
def trained(pages: int = 1200, seed: int = 11) -> Chain:
    """The chain fitted to ``pages`` generated pages; takes some seconds on the driver."""
    return train([(block_features(b), y) for b, y in labelled(pages, seed)])


def extractor(chain: Chain):
    """A function from a page to its main text. A node's score is its own features' and its parent's."""
    weight = chain.weights.get

    def reach(node: Node | None) -> float:
        chain_up = []
        while node is not None and node.score is None:
            chain_up.append(node)
            node = node.parent
        total = node.score if node is not None else 0.0
        for n in reversed(chain_up):
            total += sum(weight(f, 0.0) for f in n.features)
            n.score = total
        return total

    def score(b: Block, first: bool, last: bool) -> float:
        return reach(b.node) + sum(weight(f, 0.0) for f in own_features(b.node) + text_features(b, first, last))

    def extract(page: str | None) -> str:
        blocks = blocks_of(page) if page else []
        last = len(blocks) - 1
        labels = chain.viterbi([score(b, i == 0, i == last) for i, b in enumerate(blocks)])
        return " ".join(b.text for b, y in zip(blocks, labels) if y)

    return extract


def extract_pages(
    pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or trained())

    def run(batches):
        extract = extractor(shared.value)
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kept = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    return kept.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
