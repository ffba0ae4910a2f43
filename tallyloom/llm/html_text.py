"""Main text of web pages: which blocks of a page are its article, by a graphical model over the page's element tree.

Each block element and each run of text is a node that is content or not. A node's own features (tag, words of its class, id and
role, length, links, sentences, place) give its potential; a table for each kind of child couples it with its parent. Messages
of sums of products go up from the leaves and down again, which gives each run of text its exact marginal; runs above one half
are the text. Weights and couplings maximise the likelihood of the labels of labelled pages, with the same messages, on a bounded sample.

A labelled page is HTML in which data-content="1" or "0" on an element tells whether its inside is content, until one inside it tells
otherwise. labelled() makes such pages of those of a table that mark their article with an article or main element: as they are,
and laid out anew, the same words in other elements, with menus, notices, forms, comments and side columns around and between.

Defined results: null or empty pages and pages without content give an empty text; markup may be cut off or wrong anywhere; a page
whose table has no labelled page at all is kept whole but for scripts, styles, form fields and the head; equal rows give equal
rows; other columns stay as they are.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is fitted on at most, each as it is and laid out anew so often; longer ones are left out of the fit, not of the result.
FIT_PAGES, LAYOUTS, FIT_CHARS = 300, 3, 200_000
#: Characters of pages whose trees are held at once (one page at least).
SLICE_CHARS = 2_000_000

# Elements of the HTML standard that don't begin a block, that end an open paragraph, whose inside is raw text, that are empty.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
EMPTY = frozenset("area base basefont bgsound br col command embed frame hr img input keygen link meta param source track wbr".split())
#: Elements that end an open one of the second, unless one of the third is between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ()),
}
#: Elements whose text is never shown as text of the page.
UNSEEN = frozenset("head template svg math select option button datalist object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?=[^"'\s])))*+)(>?)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?…。](?:[\"'»”)]|\s|$)")

#: Hashed features, and kinds of children whose coupling with their parent is learned apart.
FEATURES = 1 << 13
KINDS = ("text", "heading", "paragraph", "item", "list", "table", "plain", "aside", "article", "other")
KIND_OF = {t: k for k, ts in {
    "heading": HEADINGS, "paragraph": ("p", "blockquote", "pre", "figcaption", "dd", "dt"), "item": ("li",), "list": ("ul", "ol", "dl", "menu"), "table": ("table", "tbody", "thead", "tfoot", "tr", "td", "th"),
    "plain": ("div", "section", "center", "figure", "details"), "aside": ("nav", "aside", "header", "footer", "form", "fieldset", "noscript", "dialog"), "article": ("article", "main"),
}.items() for t in ts}


@lru_cache(1 << 16)
def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(1 << 14)
def named(attributes: str) -> tuple[tuple[int, ...], str | None]:
    """Features of an element's class, id, role and visibility, and its label, if any."""
    out, label = set(), None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words = [w.lower() for w in WORD.findall(value)]
            out |= {feature(f"word:{w.removesuffix('s') if len(w) > 3 else w}") for w in words}
        elif name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add(feature("hidden"))
        elif name == "data-content":
            label = value
    return tuple(sorted(out)), label


@dataclass
class Page:
    """The nodes of a page; a parent comes before its children, and runs of text in the order of the page."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["body"])
    names: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    label: list[str | None] = field(default_factory=lambda: [None])
    text: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, names: tuple[int, ...], label: str | None, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(names)
        self.label.append(label or self.label[parent])
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): open, close or text, which isn't decoded yet. Comments, declarations and raw insides are left out."""
    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", source[at:], ""
            return
        m = TOKEN.match(source, lt)
        if not m:  # a bare <
            nxt = source.find("<", lt + 1)
            nxt = end if nxt < 0 else nxt
            yield "text", source[at:nxt], ""
            at = nxt
            continue
        if lt > at:
            yield "text", source[at:lt], ""
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # cut off within a tag
            return
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3]
        if name in RAW:
            close = raw_end(name).search(source, at)
            at = close.start() if close else end
        elif name == "plaintext":
            yield "text", source[at:], ""
            return


@lru_cache(None)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)


def parsed(source: str | None) -> Page:
    """The tree of a page; what the standard implies (ends of paragraphs, items, cells) is implied, what is never closed ends with its parent."""
    page = Page()
    stack: list[tuple[str, int]] = [("body", 0)]  # a node of -1: nothing in it is seen
    open_tags = {"body": 1}
    run: list[tuple[str, bool]] = []
    within: set[int] = set()
    link = 0  # depth of the stack at which a link is open

    def flush() -> None:
        nonlocal run, within
        if run:
            text = " ".join(html.unescape("".join(t for t, _ in run)).split())
            if text and stack[-1][1] >= 0:
                linked = sum(len(t) for t, a in run if a)
                page.add(stack[-1][1], "#text", tuple(within), None, text, min(linked, len(text)))
            run, within = [], set()

    def pop(n: int) -> None:
        nonlocal link
        flush()
        for name, _ in stack[n:]:
            open_tags[name] -= 1
        del stack[n:]
        if link > n:
            link = 0

    def close(names: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        if not any(open_tags.get(x) for x in names):
            return
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in barriers:
                break
            if stack[i][0] in names:
                lowest = i
        if lowest is not None:
            pop(lowest)

    for kind, name, attributes in tokens(source or ""):
        if kind == "text":
            run.append((name, bool(link)))
        elif name in ("html", "body") and kind == "open":
            close(("head",), ())
            page.names[0] = tuple(sorted({*page.names[0], *named(attributes)[0]}))
            page.label[0] = named(attributes)[1] or page.label[0]
        elif name == "br":
            run.append((" ", False))
        elif name in INLINE:
            if name == "a":
                link = len(stack) if kind == "open" else 0
            if kind == "open" and attributes:
                within |= set(named(attributes)[0])
        elif kind == "open":
            if name in ENDS_PARAGRAPH:
                close(("p",), ("table", "td", "th", "button", "object"))
            if name in HEADINGS and stack[-1][0] in HEADINGS:
                pop(len(stack) - 1)
            if name in IMPLIED:
                close(*IMPLIED[name])
            flush()
            if name in EMPTY or name in RAW:
                if name not in RAW:
                    continue
                node = -1
            else:
                up = stack[-1][1]
                node = -1 if up < 0 or name in UNSEEN else page.add(up, name, *named(attributes))
            stack.append((name, node))
            open_tags[name] = open_tags.get(name, 0) + 1
        elif name in HEADINGS:
            close(tuple(HEADINGS), ())
        elif open_tags.get(name) and name != "body":
            close_to = max(i for i in range(len(stack)) if stack[i][0] == name)
            pop(close_to)
    flush()
    return page


def bucket(n: int) -> int:
    return n.bit_length()


def described(page: Page) -> list[tuple[int, ...]]:
    """The features of each node: its own and those of what is in it."""
    n = len(page.parent)
    chars, linked, runs, sentences = [len(t) for t in page.text], list(page.linked), [int(t == "#text") for t in page.tag], [0] * n
    for i in range(n - 1, -1, -1):
        if page.tag[i] == "#text":
            sentences[i] = sum(1 for _ in SENTENCE.finditer(page.text[i]))
        p = page.parent[i]
        if p >= 0:
            chars[p] += chars[i]
            linked[p] += linked[i]
            runs[p] += runs[i]
            sentences[p] += sentences[i]
    out, seen, total = [], 0, max(chars[0], 1)
    for i in range(n):
        tag, kind = page.tag[i], "t" if page.tag[i] == "#text" else "e"
        own = [feature(f"{kind}:any"), feature(f"tag:{tag}"), *page.names[i]]
        own.append(feature(f"{kind}:links:{8 * linked[i] // max(chars[i], 1)}"))
        own.append(feature(f"{kind}:chars:{bucket(chars[i])}"))
        own.append(feature(f"{kind}:sentences:{min(bucket(sentences[i]), 5)}"))
        own.append(feature(f"{kind}:share:{8 * chars[i] // total}"))
        if kind == "t":
            up = page.tag[page.parent[i]]
            own.append(feature(f"in:{up}"))
            own.append(feature(f"in:{up}:sentences:{min(sentences[i], 3)}"))
            own.append(feature(f"place:{4 * seen // total}"))
            seen += chars[i]
            if "©" in page.text[i]:
                own.append(feature("copyright"))
        else:
            own.append(feature(f"e:runs:{min(bucket(runs[i]), 6)}"))
            own.append(feature(f"e:mean:{bucket(chars[i] // max(runs[i], 1))}"))
        out.append(tuple(set(own)))
    return out


class Forest:
    """Trees of several pages side by side, ordered by depth, so that messages of one depth are a few array operations."""

    def __init__(self, pages: list[Page]):
        features, parents, depths, kinds, base = [], [], [], [], 0
        for page in pages:
            features += described(page)
            parents += [p + base if p >= 0 else -1 for p in page.parent]
            depths += page.depth
            kinds += [KINDS.index("text" if t == "#text" else KIND_OF.get(t, "other")) for t in page.tag]
            base += len(page.parent)
        self.parent, self.kind = np.array(parents, np.int64), np.array(kinds, np.int64)
        sizes = np.array([len(f) for f in features], np.int64)
        self.ids = np.fromiter((i for f in features for i in f), np.int64, int(sizes.sum()))
        self.node = np.repeat(np.arange(len(sizes)), sizes)
        depth = np.array(depths, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def marginals(self, weights: np.ndarray, coupling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of content of each node, and of each pair of values of its parent and itself (nodes x 2 x 2; roots: 0)."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(self.node, weights=weights[self.ids], minlength=n)
        table = coupling[self.kind]  # parent's value, own value
        message = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(up[level][:, None, :] + table[level], axis=2)
            np.add.at(up, self.parent[level], message[level])
        belief = up.copy()
        pair = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - message[level]  # what the parent knows from elsewhere
            joint = above[:, :, None] + table[level] + up[level][:, None, :]
            belief[level] = np.logaddexp.reduce(joint, axis=1)
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


@dataclass
class Model:
    weights: np.ndarray
    coupling: np.ndarray

    def shown(self, pages: list[Page]) -> list[str]:
        """The text of each page: runs whose marginal is one half or more."""
        content = Forest(pages).marginals(self.weights, self.coupling)[0] >= 0.5
        out, base = [], 0
        for page in pages:
            out.append(" ".join(t for i, t in enumerate(page.text) if t and content[base + i]))
            base += len(page.parent)
        return out


def fitted(pages: list[Page], rounds: int = 200, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Weights and couplings of greatest penalised likelihood of the pages' labels, by gradient steps of adapted length."""
    model = Model(np.zeros(FEATURES), np.zeros((len(KINDS), 2, 2)))
    if not pages:
        return model
    f = Forest(pages)
    y = np.array([int(x == "1") for p in pages for x in p.label])
    n, inner = len(y), np.flatnonzero(f.parent >= 0)
    seen_pairs = np.zeros((n, 2, 2))
    seen_pairs[inner, y[f.parent[inner]], y[inner]] = 1
    values = [model.weights, model.coupling]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        p, pairs = f.marginals(*values)
        by_kind = np.zeros_like(model.coupling)
        np.add.at(by_kind, f.kind, seen_pairs - pairs)
        slopes = [np.bincount(f.ids, weights=(y - p)[f.node], minlength=FEATURES), by_kind]
        for v, g, a, b in zip(values, slopes, first, second, strict=True):
            g = g / len(pages) - decay * v
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def blocks(page: Page) -> tuple[list[tuple[str, str]], list[str]]:
    """(tag, text) of the runs of a page within its article, and the texts outside it."""
    inside: list[bool] = []
    own, other = [], []
    for i, (p, tag) in enumerate(zip(page.parent, page.tag, strict=True)):
        inside.append(tag in ("article", "main") or p >= 0 and inside[p] and KIND_OF.get(tag) != "aside")
        if tag == "#text":
            (own.append((page.tag[p], page.text[i])) if inside[i] else other.append(page.text[i]))
    return own, other


# Words that sites commonly use for the parts of a page.
CONTENT_NAMES = ("content", "post", "entry-content", "article-body", "story", "main-content", "post-content", "page-content", "text", "body-copy", "entry", "hentry", "article", "single", "")
ASIDE_NAMES = {
    "menu": ("nav", "menu", "navbar", "main-navigation", "breadcrumbs", "topbar", "pagination", "toc", "tabs"), "header": ("header", "masthead", "site-header", "branding", "banner", "top"), "footer": ("footer", "site-footer", "colophon", "copyright", "legal", "bottom"),
    "side": ("sidebar", "widget", "aside", "rail", "secondary", "related", "recommended", "popular", "trending", "tags", "author-box"), "notice": ("cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "disclaimer"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "adsbygoogle", "banner-ad"), "form": ("newsletter", "subscribe", "signup", "search", "login", "contact-form"), "share": ("share", "social", "sharing", "follow"),
    "comments": ("comments", "comment-list", "discussion", "respond", "replies", "disqus", "reader-comments", "reviews"),
}


def laid_out(own: list[tuple[str, str]], other: list[str], seed: int) -> str:
    """A labelled page of the same words in another layout."""
    r = random.Random(seed)
    words = " ".join(other).split() or ["more"]
    long = [t for _, t in own if len(t) > 20] or ["All rights reserved."]
    esc = lambda t: html.escape(t, quote=False)
    some = lambda lo, hi: " ".join(r.choice(words) for _ in range(r.randint(lo, hi)))
    sentence = lambda: r.choice(long)[: r.randint(20, 300)]

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{esc(some(1, 4))}</a></li>' for i in range(n)) + "</ul>"

    def part(kind: str) -> str:
        name, tag = r.choice(ASIDE_NAMES[kind]), "div"
        inside = {
            "menu": lambda: links(r.randint(2, 9)), "header": lambda: f"<h1>{esc(some(1, 3))}</h1><p>{esc(some(2, 6))}</p>", "footer": lambda: f"<p>&copy; {r.randint(1999, 2030)} {esc(some(1, 4))} &middot; {esc(sentence())}</p>" + links(r.randint(0, 3)) * r.randint(0, 1),
            "side": lambda: f"<h3>{esc(some(1, 3))}</h3>" + r.choice((links(r.randint(2, 6)), f"<p>{esc(sentence())}</p>")), "notice": lambda: f"<p>{esc(sentence())}</p><a href='#'>{esc(some(1, 2))}</a>", "ad": lambda: r.choice((esc(sentence()), f"<p>{esc(sentence())}</p>", f"<a href='#'>{esc(some(3, 9))}</a>")),
            "form": lambda: f"<form><label>{esc(some(1, 3))}</label><input type=text><p>{esc(some(3, 12))}</p></form>", "share": lambda: links(r.randint(2, 5)),
            "comments": lambda: f"<h3>{esc(some(1, 2))}</h3>" + "".join(r.choice(('<div class="comment"><b>{a}</b><p>{t}</p></div>', '<li class="comment"><p>{t}</p><a href="#">{a}</a></li>', "<p>{t}</p>")).format(a=esc(some(1, 2)), t=esc(sentence())) for _ in range(r.randint(1, 6))),
        }[kind]()
        tag = {"menu": r.choice(("nav", "div")), "header": r.choice(("header", "div")), "footer": r.choice(("footer", "div")), "side": r.choice(("aside", "div", "section")), "comments": r.choice(("section", "div"))}.get(kind, tag)
        known = "" if tag != "div" and r.random() < 0.3 else f' {r.choice(("class", "id"))}="{name}"'
        return f'<{tag}{known} data-content="0">{inside}</{tag}>'

    pieces = []
    for tag, text in own:
        t = tag if tag in HEADINGS or tag in ("li", "blockquote", "p") else "p"
        t = "div" if t == "p" and r.random() < 0.1 else t
        pieces.append(f"<ul><li>{esc(text)}</li></ul>" if t == "li" else f"<{t}>{esc(text)}</{t}>")
        if r.random() < 0.12:
            pieces.append(part(r.choice(("ad", "side", "share", "form", "notice"))))
        elif r.random() < 0.08:  # short blocks and links belong to the text as well
            pieces.append(r.choice((f"<h2>{esc(some(1, 4))}</h2>", f"<ul><li>{esc(sentence())}</li><li>{esc(some(2, 8))}</li></ul>", f"<p>{esc(sentence())} <a href='#'>{esc(some(1, 4))}</a> {esc(sentence())}</p>", f"<blockquote><p>{esc(sentence())}</p></blockquote>", f"<table><tr><td>{esc(some(1, 3))}</td><td>{esc(some(1, 3))}</td></tr></table>")))
    tag, name = r.choice(("article", "main", "div", "div", "div", "section")), r.choice(CONTENT_NAMES)
    known = f' {r.choice(("class", "id"))}="{name}"' if name else ""
    content = f'<{tag}{known} data-content="1">{"".join(pieces)}{part("comments") if r.random() < 0.3 else ""}</{tag}>'
    before = [part(k) for k in ("notice", "header", "menu", "ad", "side") if r.random() < 0.5]
    after = [part(k) for k in ("share", "comments", "side", "form", "ad", "footer") if r.random() < 0.5]
    if r.random() < 0.5:
        content = f'<div class="{r.choice(("wrapper", "container", "row", "site", "page"))}" data-content="0">{content}{after.pop(0) if after else ""}</div>'
    return f'<html><head><title>{esc(some(1, 5))}</title></head><body data-content="0">{"".join(before)}{content}{"".join(after)}</body></html>'


def marked(source: str) -> str | None:
    """A page that marks its article, labelled by that; none if it has no article."""
    if not re.search(r"<(?:article|main)\b", source, re.IGNORECASE):
        return None
    out = re.sub(r"<(article|main)\b", r'<\1 data-content="1"', source, flags=re.IGNORECASE)
    out = re.sub(r"<(nav|aside|header|footer|form)\b", r'<\1 data-content="0"', out, flags=re.IGNORECASE)
    return re.sub(r"<body\b", '<body data-content="0"', out, count=1, flags=re.IGNORECASE)


def labelled(pages: DataFrame, most: int = FIT_PAGES, layouts: int = LAYOUTS) -> DataFrame:
    """html of labelled pages: those of most pages at most that mark their article, the ones with the smallest hashes of their text, and the same laid out anew."""

    def make(batches):
        for b in batches:
            out = []
            for source in b.column("html").to_pylist():
                if as_is := marked(source):
                    own, other = blocks(parsed(source))
                    out += [as_is, *(laid_out(own, other, zlib.crc32(source.encode()) + i) for i in range(layouts))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["html"])

    eligible = pages.select("html").where((F.length("html") <= FIT_CHARS) & F.lower("html").rlike("<(article|main)\\b"))
    hashed = eligible.select("html", F.xxhash64("html").alias("_h"))
    first = hashed.select("_h").distinct().orderBy("_h").limit(most)  # pages stay where they are
    return hashed.join(F.broadcast(first), "_h", "left_semi").groupBy("_h").agg(F.min("html").alias("html")).select("html").mapInArrow(make, "html string")


def fit(pages: DataFrame) -> Model:
    """The model of labelled pages (html), which the driver gets: pass a bounded number, as labelled() gives."""
    return fitted([parsed(r.html) for r in pages.select("html").collect()])


def with_text(pages: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """pages with the main text of html in a column of that name, which must be new."""
    if column.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"there is a column {column} already")
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model)  # FEATURES and KINDS bound its size

    def extract(sources: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sources:
            out: list[str] = []
            held: list[Page] = []
            size = 0
            for value in batch:  # one text at a time
                source = value.as_py() or ""
                if held and size + len(source) > SLICE_CHARS:
                    out += shared.value.shown(held)
                    held, size = [], 0
                held.append(parsed(source))
                size += len(source)
            yield pa.array(out + shared.value.shown(held), pa.string())

    return pages.withColumn(column, F.arrow_udf(extract, "string", F.ArrowUDFType.SCALAR_ITER)("html"))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page, with a model of its own table's labelled pages."""
    model = fit(labelled(pages))
    return with_text(pages.select("page_id", "url", "html"), model).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
