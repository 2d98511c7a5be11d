"""HTML extraction (operator 3): a tree-structured graphical model over the DOM.

Each node (element or text) has one of three states: MIXED (an element around both kinds), CONTENT, or OTHER, whose
descendants are all OTHER, so no text is content inside a comment section or a menu. A node's own potential comes from
its tag, its parent's tag, the words of its class, id and role, the tags and words of all elements around it (summed
down the tree), and the length, links and sentence marks of its text; each parent-child pair has a potential by the
child's kind. Sum-product messages go up from the leaves and down from the root, level by level for all pages of a
batch at once, and give each node's exact marginals; a text is kept if it is likelier content than not.

Weights are trained by penalised maximum likelihood (the same messages give the gradient) on labelled pages: pages of
a bounded sample (about SAMPLE_PAGES of at most SAMPLE_BYTES, by a hash of the row) that mark their article, labelled
by what they mark, and made-up variants of them with other tags and names and with added sidebars, notices, forms and
comments. The sample is drawn from pages with such marks alone. The penalty's mean is a set of fixed potentials
(``prior``), to which the weights stay the nearer the fewer pages there are; without any they are the model.

Defined results: null or empty html, and html without content, gives the empty text; repeated rows get equal texts;
broken markup is read as a browser would, roughly (elements nested deeper than DEPTH hang on the element at DEPTH);
an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, table

#: Elements of HTML by their role.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
INLINE = ("a", "abbr", "b", "cite", "code", "em", "font", "i", "img", "label", "mark", "q", "s", "small", "span", "strong",
          "sub", "sup", "time", "u")
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
UNSEEN = ("title", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio",
          "video", "select", "textarea", "button", "datalist")
#: What an element's start closes: open elements of these names, up to a border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
BORDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
           "th": ("table", "tr"), "option": (), "tbody": ("table",)}
NOT_IN_P = frozenset(BLOCKS) - {"br", "body", "html"}
#: Starts that end an unseen element which is never closed.
SHOWN = NOT_IN_P - {"option", "hr"} | {"body"}

#: Names that pages give to what is not the article, for labels and variants.
OTHER_NAMES = ("ad", "ads", "advert", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "consent",
               "cookie", "cookies", "copyright", "disclaimer", "footer", "form", "gdpr", "header", "legal", "login", "menu",
               "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "popup", "privacy",
               "promo", "promotion", "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "social",
               "sponsor", "sponsored", "subscribe", "tags", "toolbar", "trending", "widget")
COMMENT_NAMES = ("comment", "comments", "commentlist", "discussion", "disqus", "feedback", "replies", "reply", "respond",
                 "response", "responses", "review", "reviews", "thread")
OTHER_TAGS = ("nav", "aside", "footer", "form", "menu", "dialog", "fieldset")
MAIN_TAGS = ("article", "main")
MAIN_NAMES = ("article", "body", "content", "entry", "main", "post", "story", "text")

TAGS = ("#text", "#other", *BLOCKS, *INLINE)
TAG_NO = {t: k for k, t in enumerate(TAGS)}
WORDS = 4096
LENGTHS = np.array([1, 10, 25, 50, 100, 200, 500, 1000, 3000])
LINKS = np.array([1e-9, 0.2, 0.5, 0.9])
MARKS = np.array([1e-9, 0.005, 0.02])
SLOTS = (len(TAGS), len(TAGS), 20, 10, 8, 6)
#: The last three: words of a node's own names, words of names around it, tags around it.
STARTS = np.concatenate([[0], np.cumsum([*SLOTS, WORDS, WORDS, len(TAGS)])])

MIXED, CONTENT, OTHER = range(3)
#: Nothing but OTHER lies in OTHER, and a text is one or the other.
NEVER = -1e9
FORBIDDEN = np.zeros((2, 3, 3))
FORBIDDEN[:, OTHER, :OTHER] = NEVER
FORBIDDEN[1, :, MIXED] = NEVER
#: Elements nested deeper hang on the one at this depth, as in browsers.
DEPTH = 512

SAMPLE_PAGES = 200
SAMPLE_BYTES = 1 << 16
VARIANTS = 3
ROUNDS = 120
RATE = 0.3
#: Of the squared distance from the prior's weights, over all pages.
PENALTY = 0.05
#: Pages that may mark their article, as a Java pattern.
MARKED = r"(?i)<(article|main)[\s>/]"
#: Fixed potentials of the prior, in log units: by tag (content above 0, other below), by lower ends of LENGTHS, LINKS
#: and MARKS for texts, by a name's word, by parent and child state for elements and texts.
PRIOR_TAGS = {"article": 3, "main": 3, "p": 1, "blockquote": 0.5, "pre": 1, "h1": 1, "h2": 0.5, "h3": 0.5, "figure": 0.5,
              "header": -2, "footer": -4, "nav": -5, "aside": -4, "form": -3, "menu": -4, "dialog": -4, "fieldset": -3,
              "search": -4, "label": -1, "address": -1, "a": -0.5}
PRIOR_INLINE = 1
PRIOR_LENGTHS = (0, 0.25, 0.5, 0.5, 0.75, 1, 1.5, 2, 2, 2)
PRIOR_LINKS = (0, 0, -0.5, -1.5, -2.5)
PRIOR_MARKS = (0, 0, 0.5, 1)
PRIOR_OTHER, PRIOR_AROUND, PRIOR_MAIN = 4, 3, 1.5
PRIOR_PAIRS = ((0, 0, 0), (-1, 2, 0), (0, 0, 0)), ((0, 0.5, 0), (0, 2, 0), (0, 0, 0))
#: Nodes whose messages run together.
BATCH_NODES = 200_000

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
SPACE = re.compile(WHITE)
SENTENCE = re.compile(r"[.!?,;:](?=\s|$)")


class Page:
    """A page's nodes in page order: parent, tag, name words, text (elements: None), whether a block begins before."""

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.words: list[tuple[str, ...]] = []
        self.text: list[str | None] = []
        self.gap: list[bool] = []

    def add(self, parent: int, tag: str, words: tuple[str, ...] = (), text: str | None = None, gap: bool = True) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.gap.append(gap)
        return len(self.tag) - 1


class _Reader(HTMLParser):
    """Holds all tags and texts first, as only the rest of a page tells whether an unseen element is ever closed.

    Start and end of a head are left out: what may stand in one is unseen by itself, anything else begins the body.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = [self.page.add(-1, "html")]
        self.at: dict[str, list[int]] = {}  # places in ``open`` by tag, the root left out
        self.blocks: list[int] = []  # of these, the block elements'
        self.data: list[str] = []
        self.gap = True
        self.events: list[tuple[str, str, list[tuple[str, str | None]]]] = []  # kind, tag or text, attributes
        self.nested: list[int] = []  # places of the blocks and unseen elements that are open
        self.count: Counter[str] = Counter()  # of these by tag
        self.closed: dict[int, int] = {}  # where an unseen element begins and ends

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN or tag in NOT_IN_P and tag not in EMPTY:
            self.nested.append(len(self.events))
            self.count[tag] += 1
        self.events.append(("start", tag, attrs))

    def handle_endtag(self, tag: str) -> None:
        if self.count[tag]:
            name, at = "", 0
            while name != tag:
                at = self.nested.pop()
                name = self.events[at][1]
                self.count[name] -= 1
            if tag in UNSEEN:
                self.closed[at] = len(self.events)
        self.events.append(("end", tag, []))

    def handle_data(self, data: str) -> None:
        self.events.append(("text", data, []))

    def read(self) -> Page:
        """The nodes of the page that was fed."""
        k = 0
        while k < len(self.events):
            kind, x, attrs = self.events[k]
            if kind == "start" and x in UNSEEN:
                self._flush()
                k = self.closed[k] + 1 if k in self.closed else self._shown(k)
                continue
            if kind == "start":
                self._start(x, attrs)
            elif kind == "end":
                self._end(x)
            else:
                self.data.append(x)
            k += 1
        self._flush()
        return self.page

    def _shown(self, k: int) -> int:
        """Where the unseen element at place k, which is never closed, ends: at a block's start, or its like's, or the
        end of a block around it."""
        own, j = self.events[k][1], k + 1
        while j < len(self.events):
            kind, x, _ = self.events[j]
            if kind == "start" and (x in SHOWN or x == own):
                break
            if kind == "end" and (x in ("head", "body", "html") or x in NOT_IN_P and self._last(x)):
                break
            j = self.closed.get(j, j) + 1
        return j

    def _flush(self) -> None:
        text = "".join(self.data)
        self.data = []
        if text.strip(" \t\n\r\x0b\f"):
            self.page.add(self.open[min(len(self.open), DEPTH) - 1], "#text", (), text, self.gap)
            self.gap = False
        elif text:  # white space between words of one block
            if self.page.text and self.page.text[-1] is not None and not self.gap:
                self.page.text[-1] += " "
            elif not self.gap:
                self.data = [" "]

    def _last(self, *tags: str) -> int:
        """The place in ``open`` of the last of these elements; 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _pop_to(self, k: int) -> None:
        """Closes the open elements from place k on."""
        for at in self.open[k:]:
            self.at[self.page.tag[at]].pop()
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()
        del self.open[k:]

    def _start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in TAG_NO and tag in NOT_IN_P or tag == "br":
            self._flush()
            self.gap = True
        if tag in EMPTY or tag in ("html", "head", "body"):
            return
        self._flush()
        if tag in NOT_IN_P:
            p = self._last("p")
            if p > self._last("table", "td", "th", "button"):
                self._pop_to(p)
        if tag in CLOSES:
            border = self._last(*BORDERS[tag])
            while (k := self._last(*CLOSES[tag])) > border:
                self._pop_to(k)
        named = " ".join(v for a, v in attrs if v and a in ("class", "id", "role", "itemprop", "aria-label"))
        words = tuple(w.lower() for w in WORD.findall(named)[:20]) if named else ()
        name = tag if tag in TAG_NO else "#other"
        self.at.setdefault(name, []).append(len(self.open))
        if name in NOT_IN_P:
            self.blocks.append(len(self.open))
        self.open.append(self.page.add(self.open[min(len(self.open), DEPTH) - 1], name, words))

    def _end(self, tag: str) -> None:
        self._flush()
        block = tag in NOT_IN_P
        if block:
            self.gap = True
        k = self._last(tag if tag in TAG_NO else "#other")
        if k and (block or not self.blocks or k >= self.blocks[-1]):
            self._pop_to(k)


def parse(html: str) -> Page:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.read()


class Trees:
    """The nodes of many pages as arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        own_parent = np.array([k for p in pages for k in p.parent], np.int64)
        self.parent = np.where(own_parent >= 0, own_parent + np.repeat(self.first, sizes), -1)
        tag = np.array([TAG_NO[t] for p in pages for t in p.tag], np.int64)
        text = [t for p in pages for t in p.text]
        self.is_text = np.array([t is not None for t in text], bool)
        chars = np.array([0 if t is None else len(t) for t in text], np.int64)
        marks = np.array([0 if t is None else len(SENTENCE.findall(t)) for t in text], np.int64)
        depth = np.zeros(n, np.int64)
        for k, p in enumerate(self.parent.tolist()):  # parents come first
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2 if n else 1))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        in_link = tag == TAG_NO["a"]
        for level in self.levels[1:]:
            in_link[level] |= in_link[self.parent[level]]
        linked = chars * in_link
        for level in self.levels[:0:-1]:
            for sums in (chars, linked, marks):
                np.add.at(sums, self.parent[level], sums[level])
        size = np.maximum(chars, 1)
        is_text = self.is_text.astype(np.int64)
        parent_tag = np.where(self.parent >= 0, tag[self.parent], TAG_NO["html"])
        self.values = STARTS[:6] + np.stack([
            tag, parent_tag, 2 * np.digitize(chars, LENGTHS) + is_text, 2 * np.digitize(linked / size, LINKS) + is_text,
            2 * np.digitize(marks / size, MARKS) + is_text, np.minimum(depth, 5)], 1)
        own = [(k, w) for k, ws in enumerate(x for p in pages for x in p.words) for w in ws]
        node = np.array([k for k, _ in own], np.int64)
        self.word_node, self.word_value = node, STARTS[6] + np.array([crc32(w.encode()) % WORDS for _, w in own], np.int64)
        element = np.flatnonzero(~self.is_text)
        self.around_node = np.concatenate([node, element])
        self.around_value = np.concatenate([self.word_value - STARTS[6] + STARTS[7], tag[element] + STARTS[8]])

    def potentials(self, weights: np.ndarray) -> np.ndarray:
        """Each node's own potential by state."""
        out = np.stack([w[self.values].sum(1) for w in weights], 1)
        np.add.at(out, self.word_node, weights.T[self.word_value])
        around = np.zeros_like(out)
        np.add.at(around, self.around_node, weights.T[self.around_value])
        below = np.zeros_like(out)
        for level in self.levels[1:]:
            at = self.parent[level]
            below[level] = below[at] + around[at]
        return out + below

    def gradient(self, diff: np.ndarray, size: int) -> np.ndarray:
        """The sums of ``diff`` (node x state) by weight."""
        inside = diff.copy()  # of a node and all below it
        for level in self.levels[:0:-1]:
            np.add.at(inside, self.parent[level], inside[level])
        inside -= diff
        flat = self.values.ravel()
        out = np.zeros((3, size))
        for s in (CONTENT, OTHER):
            out[s] = np.bincount(flat, np.repeat(diff[:, s], self.values.shape[1]), size)
            out[s] += np.bincount(self.word_value, diff[self.word_node, s], size)
            out[s] += np.bincount(self.around_value, inside[self.around_node, s], size)
        return out

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of each node, and the joint probabilities (parent x child) summed by the child's kind.

        ``pairs``: kind (element, text) x parent state x child state, in log units.
        """
        up = self.potentials(weights)
        kind = self.is_text.astype(np.int64)
        pairs = pairs + FORBIDDEN
        sent = np.zeros_like(up)  # to the parent
        for level in self.levels[:0:-1]:
            sent[level] = _log_sum(up[level, None, :] + pairs[kind[level]], 2)
            np.add.at(up, self.parent[level], sent[level])
        whole = up.copy()
        joint = np.zeros((2, 3, 3))
        for level in self.levels[1:]:
            rest = whole[self.parent[level]] - sent[level]
            both = rest[:, :, None] + pairs[kind[level]] + up[level, None, :]
            whole[level] = _log_sum(both, 1)
            p = np.exp(both - both.max((1, 2), keepdims=True))
            p /= p.sum((1, 2), keepdims=True)
            for k in (0, 1):
                joint[k] += p[kind[level] == k].sum(0)
        p = np.exp(whole - whole.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), joint


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


class Model:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs


def prior() -> Model:
    """Fixed potentials: the mean of the penalty, and the model where no page can be labelled."""
    weights = np.zeros((3, STARTS[-1]))
    for tag, v in (dict.fromkeys(INLINE, PRIOR_INLINE) | PRIOR_TAGS).items():
        state = CONTENT if v > 0 else OTHER
        weights[state, STARTS[0] + TAG_NO[tag]] = abs(v)
        weights[state, STARTS[1] + TAG_NO[tag]] = abs(v) / 2
    for slot, values in ((2, PRIOR_LENGTHS), (3, PRIOR_LINKS), (4, PRIOR_MARKS)):
        weights[CONTENT, STARTS[slot] + 1:STARTS[slot] + 1 + 2 * len(values):2] = values  # of texts
    for state, words, v in ((CONTENT, MAIN_NAMES, PRIOR_MAIN), (OTHER, OTHER_NAMES + COMMENT_NAMES, PRIOR_OTHER)):
        for w in words:
            weights[state, STARTS[6] + crc32(w.encode()) % WORDS] = v
    for w in COMMENT_NAMES + OTHER_NAMES:
        weights[OTHER, STARTS[7] + crc32(w.encode()) % WORDS] = PRIOR_AROUND
    return Model(weights, np.array(PRIOR_PAIRS, float))


def labels(page: Page) -> np.ndarray | None:
    """The states of a page's nodes, by what it marks; None if it marks no article."""
    n = len(page.tag)
    inside, other = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(n):
        p = page.parent[k]
        if p >= 0:
            inside[k], other[k] = inside[p], other[p]
        if page.tag[k] in MAIN_TAGS:
            inside[k] = True
        if page.tag[k] in OTHER_TAGS or any(w in OTHER_NAMES or w in COMMENT_NAMES for w in page.words[k]):
            other[k] = True
    content = inside & ~other
    return _elements(page, content) if content.any() else None


def _elements(page: Page, content: np.ndarray) -> np.ndarray:
    """States: an element is CONTENT if nine tenths of its text are, OTHER if none is, else MIXED."""
    n = len(page.tag)
    chars, good = np.zeros(n), np.zeros(n)
    for k in range(n - 1, -1, -1):
        if page.text[k] is not None:
            chars[k], good[k] = len(page.text[k]), len(page.text[k]) * bool(content[k])
        if page.parent[k] >= 0:
            chars[page.parent[k]] += chars[k]
            good[page.parent[k]] += good[k]
    some = np.where(chars > 0, good > 0, content)
    most = np.where(chars > 0, good >= 0.9 * chars, content)
    return np.where(most, CONTENT, np.where(some, MIXED, OTHER))


def variant(page: Page, content: np.ndarray, rng: np.random.Generator, pool: list[str]) -> tuple[Page, np.ndarray]:
    """The page with its containers named otherwise and with added blocks that are not content; and which of its
    nodes are content."""
    content = content == CONTENT
    out, label = Page(), []
    place: dict[int, int] = {}

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def extra(parent: int) -> None:
        tag = pick(("div", "div", "section", "aside", "form", "ul", "header" if parent == 0 else "div"))
        name = pick(OTHER_NAMES)
        words = () if tag in ("aside", "form", "header") and rng.random() < 0.5 else (name, pick(("", "box", "block", "list", "area")))
        at = out.add(parent, tag, tuple(w for w in words if w))
        label.append(0)
        if rng.random() < 0.4:
            out.add(out.add(at, pick(("h1", "h2", "h3", "h4", "strong"))), "#text", (), " ".join(pick(pool).split(" ")[:4]))
            label.extend((0, 0))
        for _ in range(int(rng.integers(1, 4))):
            inner = at
            for _ in range(int(rng.integers(1, 3))):
                inner = out.add(inner, pick(("p", "p", "div", "li", "span", "a", "label", "blockquote")))
                label.append(0)
            out.add(inner, "#text", (), pick(pool)[:int(pick((15, 40, 150, 400, 1000)))])
            label.append(0)

    def element(parent: int, tag: str, *words: str) -> int:
        label.append(0)
        return out.add(parent, tag, words)

    def said(parent: int, text: str) -> None:
        label.append(0)
        out.add(parent, "#text", (), text)

    def comments(parent: int) -> None:
        """What readers wrote: as long and as well formed as the article."""
        name = pick(("comment", "comments", *COMMENT_NAMES))
        at = element(parent, pick(("div", "div", "div", "section", "section", "aside")), name, *pick(((), ("list",), ("area",), ("thread",), ("section",))))
        if rng.random() < 0.6:
            said(element(at, pick(("h2", "h3", "h4", "div"))), " ".join(pick(pool).split(" ")[:3]))
        held = element(at, pick(("ol", "ul", "div"))) if rng.random() < 0.5 else at
        for _ in range(int(rng.integers(1, 5))):
            named = (pick(COMMENT_NAMES),) if rng.random() < 0.4 else ()
            one = element(held, "li" if out.tag[held] in ("ol", "ul") else pick(("div", "article", "p")), *named)
            if out.tag[one] != "p" and rng.random() < 0.5:
                said(element(one, pick(("b", "span", "cite", "a", "strong"))), " ".join(pick(pool).split(" ")[:2]))
            for _ in range(int(rng.integers(1, 5))):
                inner = one if out.tag[one] == "p" or rng.random() < 0.2 else element(one, "p")
                said(element(inner, pick(("b", "em", "a"))) if rng.random() < 0.15 else inner, pick(pool))

    def rows(parent: int) -> None:
        """A table in the text."""
        at = out.add(parent, "table")
        label.append(1)
        head = int(rng.integers(0, 3))
        for r in range(int(rng.integers(2, 5))):
            line = out.add(out.add(at, "thead" if r == 0 and head == 2 else "tbody") if head == 2 else at, "tr")
            label.extend([1] * (1 + (head == 2)))
            for _ in range(int(rng.integers(1, 4))):
                out.add(out.add(line, "th" if r == 0 and head else "td"), "#text", (), " ".join(pick(pool).split(" ")[:int(rng.integers(1, 6))]))
                label.extend((1, 1))

    def children_border(k: int) -> bool:
        return page.text[k] is None and k > 0 and page.tag[page.parent[k]] in ("html", *MAIN_TAGS)

    rename = rng.random() < 0.7
    for k in range(len(page.tag)):
        if children_border(k) and rng.random() < 0.15:
            extra(place[page.parent[k]])
        tag, words = page.tag[k], page.words[k]
        if rename and tag in MAIN_TAGS:
            tag = pick(("div", "section", "main", "article", "div"))
            words = (pick(MAIN_NAMES),) if rng.random() < 0.8 else ()
            words += (pick(("wrapper", "area", "inner", "page")),) if rng.random() < 0.3 else ()
        elif rename and tag in ("nav", "footer", "aside", "header"):
            tag, words = pick((tag, "div", "div")), (page.tag[k] if rng.random() < 0.6 else pick(OTHER_NAMES),)
        parent = place[page.parent[k]] if page.parent[k] >= 0 else -1
        if content[k] and tag == "p" and rng.random() < 0.25:
            tag = pick(("ul", "ul", "ol", "div", "blockquote", "h2", "h3", "td", "pre"))
            if tag in ("ul", "ol"):  # a list in the text
                parent = out.add(parent, tag)
                label.append(1)
                for _ in range(int(rng.integers(1, 4))):
                    out.add(out.add(parent, "li"), "#text", (), " ".join(pick(pool).split(" ")[:int(rng.integers(1, 20))]))
                    label.extend((1, 1))
                tag = "li"
            elif rng.random() < 0.2:
                parent = out.add(parent, pick(("header", "section", "div", "figure")))
                label.append(1)
        text, words_of = page.text[k], (page.text[k] or "").split(" ")
        if content[k] and text and len(words_of) > 8 and rng.random() < 0.4:  # a link or an accent inside the text
            i = int(rng.integers(1, len(words_of) - 5))
            j = i + int(rng.integers(1, 5))
            out.add(parent, "#text", (), " ".join(words_of[:i]) + " ", page.gap[k])
            inner = out.add(parent, pick(("a", "a", "a", "em", "strong", "span", "code")))
            out.add(inner, "#text", (), " ".join(words_of[i:j]), False)
            label.extend((1, 1, 1))
            text = " " + " ".join(words_of[j:])
        if content[k] and text and rng.random() < 0.15:  # short blocks are content as well
            text = text[:int(rng.integers(5, 40))]
        place[k] = out.add(parent, tag, words, text, page.gap[k])
        label.append(int(content[k]))
        if content[k] and tag == "p" and rng.random() < 0.05 and text is None:
            rows(out.parent[place[k]])
        if page.tag[k] in MAIN_TAGS and rng.random() < 0.3:
            extra(place[k])
    main = next((k for k in range(len(page.tag)) if page.tag[k] in MAIN_TAGS), 0)
    if rng.random() < 0.8:
        extra(0)
    if rng.random() < 0.8:
        comments(pick((0, place[main], place[main], place[page.parent[main]] if main else 0)))
    return out, np.array(label)


def fit(htmls: list[str]) -> Model:
    """Penalised maximum likelihood over the labelled pages and their variants, by Adam on the exact gradient."""
    start = prior()
    known = [(p, c) for p in map(parse, htmls) if (c := labels(p)) is not None]
    if not known:
        return start
    rng = np.random.Generator(np.random.Philox(3))
    pool = [t for p, _ in known for t in p.text if t]
    pages, states = [], []
    for page, content in known:
        pages.append(page)
        states.append(content)
        for _ in range(VARIANTS):
            made, label = variant(page, content, rng, pool)
            pages.append(made)
            states.append(_elements(made, label.astype(bool)))
    trees, y = Trees(pages), np.concatenate(states)
    weights, pairs = start.weights.copy(), start.pairs.copy()
    seen = np.zeros((2, 3, 3))
    child = np.flatnonzero(trees.parent >= 0)
    np.add.at(seen, (trees.is_text[child].astype(int), y[trees.parent[child]], y[child]), 1)
    truth = np.eye(3)[y]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, pairs)]
    scale = 1 / len(pages)
    for step in range(1, ROUNDS + 1):
        p, joint = trees.marginals(weights, pairs)
        g = trees.gradient(truth - p, weights.shape[1])
        for x, grad, (m, v) in zip((weights, pairs), (
                (g - PENALTY * (weights - start.weights)) * scale, (seen - joint - PENALTY * (pairs - start.pairs)) * scale),
                moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(weights, pairs)


def train(pages: DataFrame) -> Model:
    """Trains on the driver, over the bounded sample of pages with marks."""
    size = F.octet_length("html")
    able = pages.filter((size <= SAMPLE_BYTES) & F.col("html").cast("string").rlike(MARKED))
    share = int(min(1.0, SAMPLE_PAGES / max(able.count(), 1)) * (1 << 20)) + 1
    some = able.filter(F.pmod(F.xxhash64("page_id", size), F.lit(1 << 20)) < share)
    return fit(sorted(r.html for r in some.select(F.col("html").cast("string").alias("html")).limit(2 * SAMPLE_PAGES).collect()))


def main_texts(pages: list[Page], model: Model) -> list[str]:
    """The text of the content nodes of each page."""
    trees = Trees(pages)
    p, _ = trees.marginals(model.weights, model.pairs)
    keep = np.split((p[:, CONTENT] > 0.5) & trees.is_text, trees.first[1:])
    out = []
    for page, kept in zip(pages, keep, strict=True):
        parts, gap = [], False
        for k, text in enumerate(page.text):
            if text is None:
                continue
            gap |= page.gap[k]
            if kept[k]:
                parts.append(" " + text if gap else text)
                gap = False
            else:
                gap = True
        out.append(SPACE.sub(" ", "".join(parts)).strip(" "))
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            done, held, nodes = 0, [], 0
            for k, html in enumerate(batch.column("html")):
                held.append(parse(html.as_py() or ""))
                nodes += len(held[-1].tag)
                if nodes > BATCH_NODES or k + 1 == batch.num_rows:
                    part = batch.slice(done, len(held))
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(
                        main_texts(held, model), pa.string())], ["page_id", "url", "text"])
                    done, held, nodes = k + 1, [], 0

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        read, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every page's main text."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
