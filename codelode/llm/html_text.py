"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its leaf blocks, runs of text between block-level tags, each with its open ancestors and their
class, id and role words. The CRF has two labels, main text and other. Its features are the ancestors' tags and words, the
block's own tag, length, links and punctuation; its transitions link neighbours. Weights are fitted by stochastic gradient of
the conditional likelihood (forward-backward) on labelled pages, and pages are labelled by Viterbi. `sample_pages` writes a
bounded set of varied labelled pages for that; other labelled pages can be given to `train`.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm._common import slabs
from codelode.operators.layout import spread

#: Tags that end a block of text, tags whose content is no text, tags without content, elements that end others.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe object svg math title head noframes noembed audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot body article section div main aside nav form".split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|\Z)(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)\b(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
_QUOTED = re.compile(r""""[^"]*"|'[^']*'""", re.S)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_OTHER = frozenset("has with no without".split())  # words of a name that say what is beside or inside, or is not
_STATES = frozenset("enabled disabled".split())  # last words of names that say how something is, not what
_NOTES = re.compile(r"<annotation(?:-xml)?\b.*?(?:</annotation(?:-xml)?\s*>|\Z)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[^>]*>", re.I | re.S)
_HEAD_END = re.compile(r"</head(?=[\s/>])[^>]*>|<body\b", re.I)
#: Raw elements that hold other elements: without an end tag they end with their parent. Foreign ones also end at tags that break out.
NESTS, FOREIGN = frozenset("object svg math audio video canvas".split()), frozenset("svg math".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
POINTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())  # where HTML is allowed in foreign content


def _names(words: str) -> list[str]:
    """The words of class names and the like, in lower case, but for those that a name has after a word of _OTHER, and names of states."""
    out = []
    for name in words.split():
        found = _WORD.findall(name)
        if found and found[-1].lower() in _STATES:
            continue
        for w in found:
            if w.lower() in _OTHER:
                break
            out.append(w.lower())
    return out


class Node:
    """An open element: its tag, words and parent, and the features that it adds to those of its ancestors.

    Features of a block's place are those that its node and ancestors add, and the local ones of the node: its tag, the words of the
    nearest element with any, and whether no article or main is around. Nodes share their ancestors, so depth costs nothing.
    """

    __slots__ = ("tag", "words", "parent", "added", "local", "inside", "near", "_score")

    def __init__(self, tag: str, words: str, parent: Node | None, open_features: dict[str, int]):
        self.tag, self.words, self.parent = tag, words, parent
        whole = tag in ("html", "body")
        names = [] if whole else _names(words)
        was_inside = parent is not None and parent.inside
        own = [] if whole else ["tag=inner-header" if tag == "header" and was_inside else f"tag={tag}"]
        self.added = []
        for f in dict.fromkeys([*own, *(f"word={w}" for w in names)]):
            n = open_features[f] = open_features.get(f, 0) + 1
            if n == 1:
                self.added.append(f)
        self.inside = was_inside or tag in ("article", "main")
        self.near = names or (parent.near if parent is not None else [])
        self.local = [f"own={tag}", *dict.fromkeys(f"near={w}" for w in self.near)] + ([] if self.inside else ["outside"])
        self._score = None

    def features(self) -> list[str]:
        """Those that the element itself counts in the features of its descendants."""
        return [] if self.tag in ("html", "body") else list(dict.fromkeys(["tag=inner-header" if self.tag == "header" and self.parent is not None and self.parent.inside else f"tag={self.tag}", *(f"word={w}" for w in _names(self.words))]))

    def place(self) -> list[str]:
        """All features of a block's place."""
        out, node = ["bias", *self.local], self
        while node is not None:
            out += node.added
            node = node.parent
        return out


ROOT_FEATURES = ["bias", "own=-", "outside"]


class Block:
    """A leaf block: its text, the innermost open element and the characters of it that are links."""

    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def stack(self) -> list[tuple[str, str]]:
        """The open elements as (tag, words), from the outermost."""
        out, node = [], self.node
        while node is not None:
            out.append((node.tag, node.words))
            node = node.parent
        return out[::-1]


def _tag(m: re.Match) -> tuple[bool, str, str]:
    """Whether a token is an end tag, its name (empty if it is no tag) and its attributes."""
    return (m[1] == "/", m[2].lower(), m[3]) if m[2] else (m[4] == "/", m[5].lower(), m[6]) if m[5] else (False, "", "")


def _raw_end(page: str, name: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return len(page) if m is None else m.end()


def _head_end(page: str, at: int) -> int:
    """Where a head ends: at its end tag or the body's start, or without both before the first text or tag that cannot stand in it."""
    if m := _HEAD_END.search(page, at):
        return m.start() if m[0][1] != "/" else m.end()
    while (m := _TOKEN.search(page, at)) and not page[at : m.start()].strip():
        closing, name, attrs = _tag(m)
        if name in ("body", "html", "br") if closing else name and name not in IN_HEAD:
            return m.start()
        at = m.end()
        if name in RAW and name != "head" and not closing and not attrs.endswith("/"):
            at = _raw_end(page, name, at)
    return at


def _nest_end(page: str, name: str, at: int, outer: frozenset) -> int:
    """Where an element of NESTS ends: after its end tag, or before that of an element of outer, or before a tag that breaks out."""
    inner, held, size = [], Counter(), len(page)  # open elements with the innermost one of POINTS or NESTS around what is in each

    def push(tag: str) -> None:
        inner.append((tag, tag if tag in POINTS or tag in NESTS else inner[-1][1] if inner else ""))
        held[tag] += 1

    def pop() -> str:
        tag = inner.pop()[0]
        held[tag] -= 1
        return tag

    push(name)
    while at < size and (m := _TOKEN.search(page, at)):
        closing, tag, attrs = _tag(m)
        if closing:
            if held[tag]:
                while pop() != tag:
                    pass
                if not inner:
                    return m.end()
            elif tag in outer:
                return m.start()
        elif tag in BREAKS and inner[-1][1] in FOREIGN:
            while inner and inner[-1][0] not in FOREIGN:
                pop()
            pop()
            if not inner:
                return m.start()
            continue
        elif tag and not attrs.endswith("/") and tag not in VOID:
            if tag in RAW and tag not in NESTS and tag not in POINTS and tag != "head":
                at = _raw_end(page, tag, m.end())
                continue
            push(tag)
        at = m.end()
    return size


class _Open:
    """The stack of open elements, with the places of each tag in it, and all that were opened. Those in quiet have no words."""

    def __init__(self, quiet: frozenset[int] = frozenset()):
        self.nodes: list[Node] = []
        self.made: list[Node] = []
        self.quiet = quiet
        self.at: dict[str, list[int]] = {}
        self.features: dict[str, int] = {}

    def push(self, tag: str, words: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(Node(tag, "" if len(self.made) in self.quiet else words, self.nodes[-1] if self.nodes else None, self.features))
        self.made.append(self.nodes[-1])

    def close(self, to: int) -> None:
        while len(self.nodes) > to:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for f in node.features():
                self.features[f] -= 1

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element with one of the tags, -1 if there is none."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order; white space inside is one space, character references are decoded.

    The names of elements around an article that has most of the page's text say nothing: they are of the page, not of a part of it.
    """
    out, made = _blocks(page)
    around = _around_article(out, made)
    return _blocks(page, around)[0] if around else out


def _around_article(out: list[Block], made: list[Node]) -> frozenset[int]:
    """The places in made of elements with names around the largest article (or main, without any), if it has over half of the text."""
    place = {id(node): i for i, node in enumerate(made)}
    size = [0] * len(made)
    for b in out:
        if b.node is not None:
            size[place[id(b.node)]] += len(b.text)
    for i in range(len(made) - 1, -1, -1):
        if made[i].parent is not None:
            size[place[id(made[i].parent)]] += size[i]
    best = max((i for i, node in enumerate(made) if node.tag in ("article", "main")), key=lambda i: (made[i].tag == "article", size[i]), default=None)
    if best is None or 2 * size[best] <= sum(len(b.text) for b in out):
        return frozenset()
    around, node = [], made[best].parent
    while node is not None:
        if node.words:
            around.append(place[id(node)])
        node = node.parent
    return frozenset(around)


def _blocks(page: str, quiet: frozenset[int] = frozenset()) -> tuple[list[Block], list[Node]]:
    """The blocks of a page, and all its block elements in order; of those whose places are in quiet, without their names."""
    out: list[Block] = []
    opened, headed = _Open(quiet), False
    parts: list[str] = []
    link, at, size = False, 0, len(page)
    linked = 0

    def flush() -> None:
        nonlocal linked, link
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, opened.nodes[-1] if opened.nodes else None, linked))
            parts.clear()
        linked, link = 0, False

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        if m[2]:
            closing, name, attrs = m[1], m[2].lower(), m[3]
        elif m[5]:
            closing, name, attrs = m[4], m[5].lower(), m[6]
        else:  # a comment, a declaration, or a tag that is cut off
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name == "head" and not closing and headed:  # a second one is no element
            continue
        if name in RAW:
            if not closing and not attrs.endswith("/"):
                begin, headed = at, headed or name == "head"
                at = _head_end(page, at) if name == "head" else _nest_end(page, name, at, frozenset(t for t, own in opened.at.items() if own)) if name in NESTS else _raw_end(page, name, at)
                if name == "math" and page[begin:at].endswith(">") and page.rfind("</", begin, at) >= 0 and page[page.rfind("</", begin, at) + 2 : at].lower().startswith("math"):
                    parts.append(_NOTES.sub("", page[begin:at]))  # a formula is part of its block
            continue
        if name not in BLOCK:
            if name == "a":
                link = not closing
            elif name in ("br", "img", "input"):
                parts.append(" ")
            continue
        flush()
        if closing:
            if (i := opened.last((name,))) >= 0:
                opened.close(i)
            continue
        if opened.nodes and opened.nodes[-1].tag == "p":
            opened.close(len(opened.nodes) - 1)
        if name in CLOSES and (i := opened.last(CLOSES[name])) > opened.last(SCOPE - set(CLOSES[name])):
            opened.close(i)
        if name not in VOID and not attrs.endswith("/"):
            words = ""
            if attrs:
                words = " ".join(v for n in _NAMED.findall(attrs) for v in n[1:] if v)
                if _HIDDEN.search(attrs) and (_HIDDEN.search(_QUOTED.sub('""', attrs)) or "aria-hidden" in attrs.lower() or "style" in attrs.lower()):
                    words = f"{words} hidden" if words else "hidden"
            opened.push(name, words)
    flush()
    return out, opened.made


def text_features(b: Block) -> list[str]:
    """Features of a block's text."""
    n_words = b.text.count(" ") + 1
    out = [f"len={min(6, int(math.log2(n_words)))}", "link=" + ("all" if b.linked > 0.8 * len(b.text) else "some" if b.linked else "none"), "end=" + ("dot" if b.text[-1] in ".!?…\"'”»" else "other")]
    if "©" in b.text:
        out.append("copyright")
    return out


class CRF:
    """Weights: emission[feature] is (other, main), move[a, b] that of label b after a, begin[a] that of the first label."""

    def __init__(self):
        self.emission: dict[str, list[float]] = {}
        self.move, self.begin = np.zeros((2, 2)), np.zeros(2)

    def place_score(self, node: Node | None) -> tuple[float, float]:
        """The emission scores of a block's place, by way of those of its ancestors."""
        w, chain = self.emission, []
        total = lambda own, a=0.0, b=0.0: (a + sum(w[f][0] for f in own if f in w), b + sum(w[f][1] for f in own if f in w))
        if node is None:
            return total(ROOT_FEATURES)
        at = node
        while at is not None and (at._score is None or at._score[0] is not self):
            chain.append(at)
            at = at.parent
        a, b = at._score[1:] if at is not None else total(["bias"])
        for at in reversed(chain):
            if at.added:
                a, b = total(at.added, a, b)
            at._score = (self, a, b)
        return total(node.local, a, b)

    def scores(self, page: list[Block]) -> list[tuple[float, float]]:
        out, w = [], self.emission
        last, place = self, (0.0, 0.0)
        for b in page:
            if b.node is not last:
                last, place = b.node, self.place_score(b.node)
            s0, s1 = place
            for f in text_features(b):
                if (x := w.get(f)) is not None:
                    s0 += x[0]
                    s1 += x[1]
            out.append((s0, s1))
        return out

    def viterbi(self, page: list[Block]) -> list[int]:
        """The likeliest labels; ties go to main text."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back, e = [], self.scores(page)
        a, b = e[0][0] + float(self.begin[0]), e[0][1] + float(self.begin[1])
        for x, y in e[1:]:
            p0, p1 = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
            a, b = x + (b + m10 if p0 else a + m00), y + (b + m11 if p1 else a + m01)
            back.append((p0, p1))
        label = int(b >= a)
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1]

    def step(self, page: list[Block], gold: list[int], rate: float, decay: float) -> None:
        """A gradient step on the page's conditional log likelihood."""
        n = len(page)
        feats = [[*(ROOT_FEATURES if b.node is None else b.node.place()), *text_features(b)] for b in page]
        e = np.array([np.sum([self.emission.setdefault(f, [0.0, 0.0]) for f in own], axis=0) for own in feats])
        la, lb = np.zeros((n, 2)), np.zeros((n, 2))
        la[0] = e[0] + self.begin
        for i in range(1, n):
            la[i] = e[i] + np.logaddexp(la[i - 1, 0] + self.move[0], la[i - 1, 1] + self.move[1])
        for i in range(n - 2, -1, -1):
            lb[i] = np.logaddexp(self.move[:, 0] + e[i + 1, 0] + lb[i + 1, 0], self.move[:, 1] + e[i + 1, 1] + lb[i + 1, 1])
        z = np.logaddexp(*la[-1])
        node = np.exp(la + lb - z)
        move = np.zeros((2, 2))
        for i in range(n - 1):
            move -= np.exp(la[i][:, None] + self.move + e[i + 1] + lb[i + 1] - z)
            move[gold[i], gold[i + 1]] += 1
        for own, p, y in zip(feats, node, gold):
            for f in own:
                w = self.emission[f]
                w[0] += rate * ((y == 0) - p[0] - decay * w[0])
                w[1] += rate * ((y == 1) - p[1] - decay * w[1])
        self.move += rate * (move - decay * self.move)
        self.begin += rate * (np.eye(2)[gold[0]] - node[0] - decay * self.begin)


def train(pages: Iterable[tuple[str, list[int]]], epochs: int = 8, rate: float = 0.1, decay: float = 0.0005) -> CRF:
    """A CRF from labelled pages, (html, label of each leaf block: 1 for main text)."""
    model, ready = CRF(), [(blocks(p), y) for p, y in pages]
    for t in range(epochs):
        for page, gold in ready:
            if page and len(page) == len(gold):
                model.step(page, gold, rate / (1 + t), decay)
    return model


def sample_pages(n: int = 800, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Varied labelled pages of invented words."""
    r = random.Random(seed)
    made = ["".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(600)]

    def say(low: int, high: int, dot: bool = True) -> str:
        return " ".join(r.choices(made, k=r.randint(low, high))).capitalize() + ("." if dot else "")

    for _ in range(n):
        gold: list[int] = []

        def put(label: int, text: str) -> str:
            gold.append(label)
            return text

        def box(kind: list[str], inner: str) -> str:
            tag, _, attrs = r.choice(kind).partition(" ")
            return f"<{tag}{' ' if attrs else ''}{attrs}>{inner}</{tag}>"

        def menu() -> str:
            if r.random() < 0.7:
                items = "".join(f"<li><a href=#>{put(0, say(1, 2, False))}</a></li>" for _ in range(r.randint(2, 8)))
                return box(["nav", "nav id=nav", 'div class="menu"', 'div class="navbar main-nav"', 'ul class="navigation"', 'div class="breadcrumb"', "menu"], f"<ul>{items}</ul>")
            return box(["nav", 'div class="menu"', 'td class="menu"', "div role=navigation", 'div id="topnav"', 'div class="breadcrumbs"'], put(0, " | ".join(f"<a href=#>{say(1, 2, False)}</a>" for _ in range(4))))

        def notice() -> str:
            return box(['div class="notice"', 'div class="cookie-notice"', 'div id="cookie-banner"', 'div role="alert"', 'div class="alert"', 'div class="consent popup"', 'section class="newsletter"', "dialog", 'div class="warning"', 'div class="disclaimer"'], f"<p>{put(0, say(4, 30))}</p>") if r.random() < 0.5 else box(['p class="notice"', 'p class="alert"', 'div class="notice"', 'div class="cookies"', 'div id="cookie-consent"'], put(0, say(4, 30)))

        def hidden() -> str:
            return box(["div hidden", "p hidden", 'div style="display:none"', "section hidden", 'div aria-hidden="true"', "div style='visibility: hidden'"], put(0, say(2, 40)))

        def advert() -> str:
            return box(['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'div id="ad-top"', 'section class="banner ad-slot"', 'div class="ad banner"'], f"<p>{put(0, say(3, 40))}</p>" if r.random() < 0.4 else put(0, say(3, 40)))

        def side() -> str:
            inner = ""
            for _ in range(r.randint(1, 3)):
                inner += f"<h3>{put(0, say(1, 4, False))}</h3>" + (f"<p>{put(0, say(5, 40))}</p>" if r.random() < 0.5 else "<ul>" + "".join(f"<li><a href=#>{put(0, say(2, 8, False))}</a></li>" for _ in range(3)) + "</ul>")
            return box(["aside", f'aside class="{r.choice(made)}"', "div role=complementary", 'td class="side"', 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'section class="related-posts"', 'div class="widget"', 'div class="share social"'], inner)

        def form() -> str:
            return f"<form action=#><label>{put(0, say(1, 3, False))}</label><input name=q>" + (f"<p>{put(0, say(3, 15))}</p>" if r.random() < 0.4 else "") + f"<select><option>{put(0, say(1, 2, False))}<option>{put(0, say(1, 2, False))}</select><button>{put(0, say(1, 2, False))}</button></form>"

        def comments() -> str:
            inner = f"<h2>{put(0, say(1, 3, False))}</h2>" if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 4)):
                inner += box(['div class="comment"', 'li class="comment"', 'article class="comment"', 'div class="reply"', "div"], f"<p>{put(0, say(3, 50))}</p>" if r.random() < 0.7 else put(0, say(3, 50)))
            return box(['section id="comments"', 'div class="comments"', 'div id="comments"', 'ol class="comment-list"', 'section class="comments responses"', 'div id="disqus" class="comments"'], inner)

        def head() -> str:
            return box(["header", "div role=banner", 'div id="header"', 'div class="header"', 'header class="site-header"', 'div class="masthead"'], (f"<h1>{put(0, say(1, 4, False))}</h1>" if r.random() < 0.3 else put(0, say(1, 5, False))) + (f"<p>{put(0, say(2, 8))}</p>" if r.random() < 0.4 else "") + (menu() if r.random() < 0.4 else ""))

        def foot() -> str:
            return box(["footer", "div role=contentinfo", 'div id="footer"', 'div class="footer"', 'footer class="site-footer"'], put(0, "&copy; " + say(1, 12)) if r.random() < 0.6 else f"<p>{put(0, say(2, 12))}</p>")

        def article(bare: float = 0.12) -> str:
            out = (f"<header><h1>{put(1, say(2, 12, False))}</h1></header>" if r.random() < 0.15 else f"<h1>{put(1, say(2, 12, False))}</h1>") if r.random() < 0.85 else ""
            for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
                kind = r.random()
                if kind < 0.57:
                    out += f"<p>{put(1, say(*r.choice([(1, 4), (8, 40), (40, 120), (60, 300)]), r.random() < 0.85))}</p>"
                elif kind < 0.69:
                    out += f"<p><b>{put(1, say(3, 60))}<br>"
                elif kind < 0.74:
                    out += f"<h2>{put(1, say(1, 8, False))}</h2>"
                elif kind < 0.8:
                    out += "<ul>" + "".join(f"<li>{put(1, say(1, 14, r.random() < 0.5))}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
                elif kind < 0.83:
                    out += f"<blockquote><p>{put(1, say(5, 40))}</p></blockquote>"
                elif kind < 0.85:
                    out += f"<pre>{put(1, say(3, 20, False))}</pre>"
                elif kind < 0.87:
                    out += "<table>" + "".join(f"<tr><td>{put(1, say(1, 4, False))}</td><td>{put(1, say(1, 4, False))}</td></tr>" for _ in range(2)) + "</table>"
                elif kind < 0.9:
                    out += f"<p>{put(1, say(3, 20))} <a href=#>{say(1, 4, False)}</a> {say(1, 9)}</p>"
                else:
                    out += r.choice([advert, form, side, notice, hidden])()
            if r.random() < 0.1:
                out += comments()
            if r.random() < bare:  # right in the body
                return out
            return box(["article", "article", "article", "main", 'div class="post"', 'div class="entry"', 'div id="main"', 'td class="body"', 'div class="content"', 'div id="content"', 'div class="post entry-content"', 'section class="story"', 'div class="article-body"', 'div class="page"', 'article class="post"', 'div role="main"'], out)

        if r.random() < 0.06:  # one short block, or little more
            few = "".join(r.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<h1>{}</h1>", "<p>{}<br>"]).format(put(1, say(1, r.choice([3, 8, 20]), r.random() < 0.7))) for _ in range(r.choice([1, 1, 2, 3])))
            yield r.choice(["{}", "<body>{}</body>", "<html><body>{}</body></html>", "<div>{}</div>"]).format(few), gold
            continue
        if r.random() < 0.15:  # nothing around the article
            yield r.choice(["{}", "<body>{}</body>", "<div>{}</div>"]).format(article(0.6)), gold
            continue
        body = ""
        for make, p in ((head, 0.4), (menu, 0.75), (notice, 0.25), (advert, 0.5), (side, 0.15), (form, 0.15), (hidden, 0.05)):
            body += make() if r.random() < p else ""
        if r.random() < 0.04:
            body += put(1, say(10, 90))
        else:
            inner = article()
            body += f"<main>{inner}</main>" if r.random() < 0.2 else f"<div>{inner}</div>" if r.random() < 0.15 else inner
        for make, p in ((comments, 0.35), (advert, 0.2), (side, 0.3), (form, 0.2), (notice, 0.1), (menu, 0.1), (hidden, 0.05), (foot, 0.8)):
            body += make() if r.random() < p else ""
        if r.random() < 0.2:
            body = box(['div class="wrapper"', 'div id="wrapper"', 'div class="container"', 'div id="page"', 'div class="site"', "div"], body)
        yield f"<!DOCTYPE html><html><head><title>{say(2, 5)}</title></head><body>{body}</body></html>", gold


@lru_cache(maxsize=1)
def default_model() -> CRF:
    return train(sample_pages())


def main_text(page: str | None, model: CRF) -> str:
    """The blocks of a page labelled as main text, joined by an empty line."""
    own = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(own, model.viterbi(own)) if y)


def extract(pages: DataFrame, model: CRF | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Defined cases: null or empty html gives an empty text; a page cut off inside a tag loses that tag; unclosed elements end
    where HTML ends them; rows that repeat a page_id are separate pages; an empty table gives an empty result; extra columns
    are ignored.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    base = spread(base)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for slab in slabs(batches, "html", 4 << 20):
            texts = [main_text(x, own) for x in slab.column("html").to_pylist()]
            yield pa.record_batch([slab.column("page_id"), slab.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(f, "page_id long, url string, text string, n_chars long")
