"""Main text of web pages: flat text blocks judged by a small decision tree over neighbouring blocks.

Only what nobody sees is cut beforehand: scripts, styles, form controls, comments and hidden parts. A page is otherwise
a flat list of text blocks (block-level tags cut), those of menus and adverts among them. Each has its word count and
link density, those of the block before and after it, and what the markup says of its place: whether it is a heading or
a list item, stands in a list right under a heading or after the first heading, whether an article element holds it (alone,
even) or another block of the page, whether an element of a menu's, header's, footer's, form's or aside's kind does, and
whether the class, id or role of an element around it is a name of boilerplate: one that says so anywhere (an advert, a
sidebar, comments), or one that parts of an article have as well (social, legal, notice). What names the article itself is
no such name. A tree grown on a small labelled table (EXAMPLES, page outlines filled with words of various lengths, with
boilerplate that nothing names and content under odd names) tells content from boilerplate by these.

An element of a sink's kind that is never closed ends at the next article, main element or heading.

Parsing and judging need one page only, so pages never meet and nothing is shuffled. The tree is grown once on the
driver from the fixed table and goes out with the tasks; it has some dozens of nodes.

Cases. A null or empty html has the empty text, as has a page without content. Tags may be unclosed or
wrongly nested, entities unfinished, a page of any length. Repeated rows and null ids are kept. White
space inside a block becomes one space; blocks are joined by one space. An empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

#: Tags that end a text block; all others are inside one.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
) - {"br"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select button title audio video noembed noframes xmp".split())
#: Of them, those whose text goes on to the page's end where they are not closed.
UNENDING = frozenset("script style textarea title iframe noembed noframes xmp".split())
SINKS = frozenset("nav header footer aside form menu dialog search".split())
SOURCES = frozenset(("article", "main"))
#: Parts of class, id and role names that tell boilerplate wherever they stand.
STRONG = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|advertise?ments?|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|side-?bar|footer|masthead|cookies?|"
    r"consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|breadcrumbs?|comments?|"
    r"comment-?list|replies|respond|disqus|reactions|pagination|pager|toolbar|widget|skip|contentinfo|complementary)"
    r"(?:$|[\s_-]|\d)",
    re.I,
)
#: Parts that an article's own sections have as well.
WEAK = re.compile(
    r"(?:^|[\s_-])(?:foot|header|notices?|alert|share|sharing|social|related|recommend\w*|reply|tags|copyright|legal|disclaimer|search)(?:$|[\s_-]|\d)", re.I
)
#: Parts of an article itself, whatever other names say.
_OWN = re.compile(r"(?:article|post|entry|story|content)[_-]*(?:header|head|heading|title|text|body)", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|page)(?:$|[\s_-]|\d)", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    heading: bool
    listed: bool
    sink: bool
    strong: bool
    weak: bool


@dataclass
class _Element:
    tag: str
    hidden: bool = False
    inside: bool = False
    sink: bool = False
    strong: bool = False
    weak: bool = False
    #: a sink that nothing closes
    loose: bool = False


_MARKS = ("hidden", "inside", "sink", "strong", "weak")


@dataclass
class _State:
    stack: list[_Element] = field(default_factory=list)
    #: how many open elements have each mark
    held: dict[str, int] = field(default_factory=lambda: dict.fromkeys(_MARKS, 0))
    loose: int = 0
    links: int = 0
    #: the inline element that is hidden, and how many of its name are open in it
    mute: str = ""
    depth: int = 0


def _element(tag: str, attributes: str) -> _Element:
    """What an element's kind, names and attributes tell of it."""
    names, hidden = [], False
    for a in _ATTR.finditer(attributes) if "=" in attributes or "hidden" in attributes else ():
        value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4]
        key = a[1].lower()
        if key in ("class", "id", "role") and value:
            names.append(value)
        hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(value) and "display:none" in value.replace(" ", "").lower()
    if tag in ("body", "html"):
        return _Element(tag)
    joined = " ".join(names)
    source, other = tag in SOURCES, _OWN.sub("content", joined)
    good = source or bool(GOOD_NAMES.search(joined))
    return _Element(tag, hidden, good, tag in SINKS, not source and bool(STRONG.search(other)), not source and bool(WEAK.search(other)))


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    s = _State()
    text: list[str] = []
    linked: list[str] = []
    kind = ""
    unclosed: set[str] = set()

    def flush() -> None:
        s.mute = ""  # an inline element ends with its block at the latest
        if text:
            whole = _SPACE.sub(" ", "".join(text)).strip()
            if whole:
                n = whole.count(" ") + 1
                in_links = len("".join(linked).split())
                heading = len(kind) == 2 and kind[0] == "h" and kind[1].isdigit()
                h = s.held
                if not h["hidden"]:
                    out.append(Block(whole, n, min(n, in_links), h["inside"] > 0, heading, kind in ("li", "td", "th", "dt", "dd"), h["sink"] > 0, h["strong"] > 0, h["weak"] > 0))
            text.clear()
            linked.clear()

    def pop() -> None:
        e = s.stack.pop()
        for mark in _MARKS:
            s.held[mark] -= getattr(e, mark)
        s.loose -= e.loose

    def add(piece: str) -> None:
        if piece and not s.mute:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if s.links:
                linked.append(" " + piece)

    last_end: dict[str, int] = {}  # where the last end tag of a kind of sink stands

    def closed(tag: str, at: int) -> bool:
        if tag not in last_end:
            last_end[tag] = lower.rfind(f"</{tag}")
        return last_end[tag] >= at

    lower = page.lower() if "<" in page else ""
    at, n = 0, len(page)
    for_tag = _TOKEN.search
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        m = for_tag(page, lt)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == s.mute:
                s.depth -= 1
                s.mute = s.mute if s.depth else ""
            if tag == "a":
                s.links = 0
            elif tag in BLOCK:
                flush()
                for k in range(len(s.stack) - 1, -1, -1):
                    if s.stack[k].tag == tag:
                        while len(s.stack) > k:
                            pop()
                        break
                kind = s.stack[-1].tag if s.stack else ""
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") and tag not in unclosed:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if closing:
                    at = closing.end()
                elif tag in UNENDING:
                    at = n
                else:
                    unclosed.add(tag)  # nor is a later one closed
            continue
        if tag == "a":
            s.links = 1
        elif tag == "br":
            text.append(" ")
        if tag not in BLOCK:
            if s.mute:
                s.depth += tag == s.mute
            elif tag not in VOID and m[3] and ("=" in m[3] or "hidden" in m[3]):
                e = _element(tag, m[3])
                if e.hidden or e.strong:  # inside a block there is no tree to ask
                    s.mute, s.depth = tag, 1
            continue
        flush()
        if tag == "p" or tag in ("li", "td", "th", "tr", "dt", "dd", "option") or tag[0] == "h" and len(tag) == 2:
            if s.stack and s.stack[-1].tag in (("p",) if tag != "li" else ("p", "li")):  # an unclosed one before it
                pop()
        kind = tag
        if tag in VOID:
            continue
        while s.loose and (tag in SOURCES or kind[0] == "h" and len(kind) == 2 and kind[1].isdigit()):
            pop()
        e = _element(tag, m[3] or "")
        e.loose = e.sink and not closed(tag, at)
        if tag == "header":
            e.inside = False  # whatever its names
        s.stack.append(e)
        for mark in _MARKS:
            s.held[mark] += getattr(e, mark)
        s.loose += e.loose
    flush()
    return out


#: The columns of the tree's input.
FEATURES = [
    "words", "links", "words_before", "links_before", "words_after", "links_after", "headed", "heading", "listed", "under", "inside", "beside", "alone", "sink", "strong", "weak",
]


def features(found: list[Block]) -> np.ndarray:
    """A row for each block. `headed`: a heading stands before it; `under`: it belongs to a list right below a heading; `beside`:
    an article stands elsewhere; `alone`: it is all that the article holds. For these, blocks in sinks or under strong names
    are no part of the article."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    column = lambda name: np.array([getattr(b, name) for b in found])
    words = column("words").astype(float)
    density = column("linked") / words
    plain = ~(column("sink") | column("strong"))
    heading, listed, inside = column("heading"), column("listed"), column("inside")
    own = inside & plain
    under = np.zeros(n, dtype=bool)
    for k in range(1, n):
        under[k] = listed[k] and (heading[k - 1] or under[k - 1])
    values = {
        "words": words, "links": density, "words_before": np.r_[0.0, words[:-1]], "links_before": np.r_[0.0, density[:-1]], "words_after": np.r_[words[1:], 0.0],
        "links_after": np.r_[density[1:], 0.0], "headed": np.cumsum(heading & plain) > 0, "heading": heading, "listed": listed, "under": under, "inside": inside,
        "beside": own.any() & ~inside, "alone": own & (own.sum() == 1), "sink": column("sink"), "strong": column("strong"), "weak": column("weak"),
    }
    for k, name in enumerate(FEATURES):
        out[:, k] = values[name]
    return out


#: Labelled page outlines: [name] stands for words, + before it for content. wN-M: N to M words.
EXAMPLES = [
    # parts have names
    "<nav><ul><li><a href=#>[w1-2]</a></li><li><a href=#>[w1-2]</a></li></ul></nav><div class='ad'>[w3-40]</div><article><h1>+[w3-15]</h1><p>+[w1-200]</p><p>+[w1-8]</p><p>+[w1-150]</p></article><footer>[w3-30]</footer>",
    "<header><a href=#>[w1-3]</a> [w2-6]</header><main><h1>+[w2-9]</h1><p>+[w1-90]</p><ul><li>+[w1-20]</li><li>+[w1-20]</li></ul><p>+[w1-40]</p></main><aside>[w5-60]</aside><p>[w2-20]</p><footer>[w2-20]</footer>",
    "<div id='header'><h1>[w1-5]</h1></div><div id='menu'><a href=#>[w1-2]</a> <a href=#>[w1-2]</a></div><div id='content'><h2>+[w2-9]</h2><p>+[w1-120]</p><p>+[w1-60]</p></div><p>[w3-50]</p><div id='footer'>[w2-30]</div>",
    "<div class='cookie-notice'>[w5-40] <a href=#>[w1-2]</a></div><article><p>+[w1-80]</p><aside>[w4-50]</aside><blockquote>+[w1-60]</blockquote><p>+[w1-90]</p></article><p>[w2-12]</p><section class='comments'><h2>[w1-3]</h2><p>[w2-80]</p></section>",
    "<article><h1>+[w2-10]</h1><p>+[w8-60] <a href=#>+[w1-3]</a></p><table><tr><td>+[w1-6]</td><td>+[w1-6]</td></tr></table><form>[w1-6]</form><p class='advert'>[w3-40]</p><h2>+[w1-6]</h2><p>+[w1-80]</p></article>",
    "<main><article><h1>+[w1-9]</h1><p>+[w1-8]</p><p>+[w1-200]</p></article><article><h2>+[w1-9]</h2><p>+[w1-90]</p></article></main><div><p>[w3-30]</p></div>",
    # parts of an article in sinks of their own, under names of boilerplate, and links that are its text
    "<article><header><h1>+[w2-12]</h1><p>[w2-9]</p></header><p>+[w5-90]</p><p>+[w1-30]</p><footer>[w2-20]</footer></article>",
    "<main><header><h2>+[w2-12]</h2></header><p>+[w5-90]</p></main><aside><p>[w5-90]</p></aside>",
    "<article><h1>+[w2-9]</h1><p>+[w1-90]</p><section id='social'><p>+[w9-200]</p><p>+[w9-90]</p></section><p>+[w1-60]</p></article>",
    "<article><p>+[w1-90]</p><div class='legal'><h2>+[w1-6]</h2><p>+[w9-90]</p></div><div class='share'><a href=#>[w1-2]</a> <a href=#>[w1-2]</a></div></article>",
    "<article id='search-results-story' class='legal'><h1>+[w2-9]</h1><p>+[w1-90]</p><p>+[w1-9]</p></article><div class='related'><p>[w3-60]</p></div>",
    "<div class='notice'><p>[w3-60]</p></div><div class='share'><p>[w1-30]</p></div><article><h1>+[w2-9]</h1><p>+[w1-90]</p><p>+[w1-9]</p></article><div class='copyright'>[w3-60]</div>",
    "<article><p>+[w1-90]</p><div class='sponsored'><p>[w9-200]</p></div><div class='ads'><h3>[w1-9]</h3><p>[w9-90]</p></div><p>+[w1-60]</p></article><div class='comments'><p>[w3-200]</p><p>[w3-200]</p></div>",
    "<article><nav><a href=#>[w1-4]</a></nav><h1>+[w2-9]</h1><p>+[w1-90]</p><aside><p>[w9-200]</p></aside><p>+[w1-90]</p><form><p>[w9-90]</p></form></article>",
    "<nav><p>[w3-90]</p><h2>[w1-5]</h2></nav><div><p>+[w9-90]</p><p>+[w9-90]</p></div><footer><h3>[w1-4]</h3><p>[w3-150]</p></footer>",
    "<div><a href=#>[w1-2]</a></div><article><p><a href=#>+[w1-9]</a></p></article><footer>[w3-30]</footer>",
    "<article><h1>+[w2-9]</h1><p>+[w1-90]</p><h2>+[w1-3]</h2><ul><li><a href=#>+[w1-9]</a></li><li><a href=#>+[w1-9]</a></li><li><a href=#>+[w1-9]</a></li></ul></article>",
    "<article><p>+[w1-90]</p><h2>+[w1-3]</h2><ol><li><a href=#>+[w1-9]</a></li><li><a href=#>+[w1-9]</a></li></ol><p>+[w1-90]</p></article><ul><li><a href=#>[w1-3]</a></li></ul>",
    # an article holds boilerplate that has no name: rows of links
    "<article><h1>+[w2-9]</h1><p>+[w1-90]</p><ul><li><a href=#>[w1-9]</a></li><li><a href=#>[w1-9]</a></li><li><a href=#>[w1-9]</a></li></ul><p>+[w1-90]</p><p><a href=#>[w1-4]</a> <a href=#>[w1-4]</a></p></article>",
    "<article><p><a href=#>[w1-3]</a> <a href=#>[w1-3]</a></p><h1>+[w2-9]</h1><p>+[w1-60]</p><p>+[w3-40] <a href=#>+[w1-3]</a> +[w1-40]</p><p>+[w1-9]</p><div><a href=#>[w2-9]</a></div></article>",
    # nothing has a name
    "<div><a href=#>[w1-3]</a> <a href=#>[w1-3]</a> <a href=#>[w1-3]</a></div><h1>+[w2-10]</h1><p>+[w15-120]</p><p>+[w5-120]</p><p>+[w10-120]</p><div><a href=#>[w1-5]</a></div><div>[w1-5]</div>",
    "<p><a href=#>[w1-2]</a> <a href=#>[w1-2]</a></p><p>+[w20-120]</p><p>+[w12-120]</p><p><a href=#>[w1-4]</a></p><p>[w1-3]</p>",
    "<div>[w1-4]</div><div><a href=#>[w1-2]</a></div><div><a href=#>[w1-2]</a></div><div><a href=#>[w1-2]</a></div><h1>+[w2-10]</h1><div>+[w15-150]</div><div>+[w3-30]</div><div>+[w15-150]</div><div><a href=#>[w2-8]</a></div><div><a href=#>[w2-8]</a></div><div>[w2-9]</div>",
    "<h3>[w1-3]</h3><ul><li><a href=#>[w1-4]</a></li><li><a href=#>[w1-4]</a></li></ul><h1>+[w3-10]</h1><p>+[w12-150]</p><h2>+[w1-6]</h2><p>+[w8-150]</p><ul><li>+[w3-25]</li><li>+[w3-25]</li></ul><p>+[w12-90]</p><h3>[w1-3]</h3><ul><li><a href=#>[w1-8]</a></li><li><a href=#>[w1-8]</a></li></ul>",
    "<p>[w2-8] <a href=#>[w1-4]</a></p><p>+[w25-200]</p><p>+[w8-200]</p><p>+[w25-200]</p><p>[w2-5] <a href=#>[w1-3]</a> <a href=#>[w1-3]</a></p><p>[w2-10]</p>",
    "<div><a href=#>[w1-3]</a></div><p>+[w20-150]</p><p><a href=#>[w2-8]</a></p><p>+[w20-150]</p>",
    "<div>[w1-6]</div><div><a href=#>[w1-3]</a></div><p>+[w20-150]</p><p>+[w1-150]</p><p>+[w20-150]</p><div><a href=#>[w1-3]</a></div><div>[w1-9]</div><div><a href=#>[w1-3]</a></div><div>[w3-12]</div>",
    "<p>+[w20-150]</p><p><a href=#>[w2-8]</a></p><div>+[w20-150]</div><p><a href=#>[w2-8]</a></p><div>[w1-9]</div><div>[w1-9]</div>",
    "<p>+[w1-80]</p>",
    "<div>+[w1-9]</div>",
    "<p>+[w12-150]</p><p>+[w12-150]</p><p>+[w12-150]</p>",
    "<article><p>+[w1-40]</p><p>+[w1-40]</p></article>",
    "<div><a href=#>[w1-3]</a></div><article><p>+[w1-40]</p><p>+[w1-20]</p><p>+[w1-9]</p></article><div><a href=#>[w1-3]</a></div><div>[w1-30]</div>",
    "<h1>+[w2-9]</h1><p>+[w1-60]</p>",
    "<div><a href=#>[w1-3]</a></div><h1>+[w2-9]</h1><p>+[w15-90]</p><p>+[w1-12]</p>",
]


def labelled(seed: int = 7, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: each outline filled `rounds` times; a block is content if its words carry the mark."""
    rng = random.Random(seed)
    rows, labels = [], []

    def words(m: re.Match) -> str:
        lo, hi = (int(x) for x in (m[2] + "-" + m[2] if "-" not in m[2] else m[2]).split("-"))
        n = max(lo, min(hi, round(lo * (hi / lo) ** rng.random())))
        return " ".join(("yes" if m[1] else "no") for _ in range(n))

    for _ in range(rounds):
        for outline in EXAMPLES:
            found = blocks("<html><body>" + re.sub(r"(\+?)\[w([\d-]+)\]", words, outline) + "</body></html>")
            rows.append(features(found))
            labels += [b.text.startswith("yes") for b in found]
    return np.concatenate(rows), np.array(labels)


@dataclass
class Tree:
    """A node: split on column `at` by value <= cut, or a leaf with `share` of content."""

    share: float
    at: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 6) -> Tree:
    """A classification tree by Gini impurity; ties go to the earlier column and the lower cut."""
    share = float(y.mean())
    node = Tree(share)
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return node
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for at in range(x.shape[1]):
        order = np.argsort(x[:, at], kind="stable")
        v, ones = x[order, at], np.cumsum(y[order])
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (len(y) - k >= least)]
        if len(k):
            a, b = ones[k - 1], ones[-1] - ones[k - 1]
            impurity = 2 * (a * (k - a) / k + b * (len(y) - k - b) / (len(y) - k))
            i = int(np.argmin(impurity))
            if impurity[i] < best[0] - 1e-9:
                best = (float(impurity[i]), at, float((v[k[i] - 1] + v[k[i]]) / 2))
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        node.at, node.cut = best[1], best[2]
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def judge(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.at < 0 or not len(rows):
            out[rows] = node.share
            continue
        low = x[rows, node.at] <= node.cut
        todo += [(node.low, rows[low]), (node.high, rows[~low])]
    return out


def extract(pages: DataFrame, column: str = "html", threshold: float = 0.5) -> DataFrame:
    """pages with `text`, the main text of the column, and `n_blocks` of it."""
    tree = grow(*labelled())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(h) if isinstance(h, str) else [] for h in batch[column]]
            left = [[b.text for b in f] for f in found]
            at = np.cumsum([0] + [len(f) for f in left])
            keep = judge(tree, np.concatenate([features(f) for f in found if f] or [np.zeros((0, len(FEATURES)))])) >= threshold
            kept = [[t for t, k in zip(f, keep[lo:]) if k] for f, lo in zip(left, at)]
            yield batch.drop(columns=[column]).assign(text=[" ".join(k) for k in kept], n_blocks=[len(k) for k in kept])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    rest = [f for f in pages.schema.fields if f.name not in (column, "text", "n_blocks")]
    schema = StructType([*rest, StructField("text", StringType()), StructField("n_blocks", LongType())])
    return pages.select(*[f.name for f in rest], column).mapInPandas(read, schema)


#: The pages of the test tables hold their content in one article element without boilerplate inside.
ORACLE = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '</?(b|a|i|em|strong)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""


def op2_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
