"""Main text of web pages: flat text blocks with the word count and link density of themselves and their neighbours, judged by a decision tree.

A page is cut at block tags into blocks of text (shallow text features, after Kohlschuetter, Fankhauser and Nejdl). Each has these features: words and
link density of the block before, itself and the block after; whether it stands in an article (and if not, whether the page has one); how many open elements
are by their tag something else (menu, aside, footer, form, header of the page); how many have a name (a class, id or role) that says so, plain ones and ambiguous ones apart; whether
it is in a heading or a list. A name counts if the whole of it says so: each of its parts is such a word or a neutral one ("cookie-notice", "site-footer"; not "related-work").
Names are counts among the features, no verdicts: a CART tree, grown on the labelled pages in ``labelled_pages``, keeps or drops every block.

Defined results: a null or empty page, or one without main text, gives an empty text. Broken markup is read as it comes: end tags without a
start are ignored, an end tag closes what is open inside it. A head without its end tag ends before the first text or tag that can't stand in one;
svg and math that are closed in themselves hold nothing. Repeated rows and null page_ids give a row each. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, pieces
from .labelled_pages import labelled

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[a-zA-Z/!?][^>]*+>?", re.S | re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Tags that bound blocks, tags whose text is never read, tags that a head may hold, tags that are something else than an article, and words of names:
#: of what isn't the article, plain and ambiguous ones, of the article, and neutral ones.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
UNREAD = frozenset("audio button canvas datalist embed head iframe map math noscript object select svg template video".split())
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLAIN = frozenset("ad ads adsbygoogle advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notification pager pagination paywall popup privacy promo promotion replies reply respond sidebar signup sponsor sponsored subscribe subscription".split())
AMBIGUOUS = frozenset("dropdown header latest meta popular recommendations recommended related search share sharing skip social tags teaser toolbar tooltip topbar trending widget widgets".split())
MAIN = frozenset("article articlebody entry main post story".split())
NEUTRAL = frozenset("area bar block blog body bottom box button buttons container content form group holder inner item items left link links list message news outer page panel right row section site text top view wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    tags: int
    plain: int
    ambiguous: int
    heading: bool
    listed: bool


@lru_cache(maxsize=4096)
def named(tag: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """(hidden, names the article, has a plain name of something else, has an ambiguous one) by the attributes."""
    given = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    hidden = bool(re.search(r"(^|\s)hidden(\s|=|$)", attributes)) or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")) is not None
    role = given.get("role", "").lower()
    main, plain, ambiguous = role == "main", role in ROLES, False
    for token in (t for k in ("class", "id", "itemprop") for t in given.get(k, "").split()) if tag not in ("html", "body") else ():
        whole = {token.lower()}
        parts = whole if whole & (PLAIN | AMBIGUOUS | MAIN) else {p.lower() for p in NAME_PART.findall(token)}
        if not all(p in PLAIN or p in AMBIGUOUS or p in MAIN or p in NEUTRAL or p.isdigit() for p in parts):
            continue
        plain |= bool(parts & PLAIN)
        ambiguous |= bool(parts & AMBIGUOUS) and not parts & PLAIN
        main |= bool(parts & MAIN) and not parts & (PLAIN | AMBIGUOUS)
    return hidden, main, plain, ambiguous


class Open(NamedTuple):
    """An open element: whether it is read, in an article, and how many tags (that never or may hold an article) and names around it say that it is something else."""

    tag: str = ""
    unread: bool = False
    inside: bool = False
    aside: int = 0
    frame: int = 0
    plain: int = 0
    ambiguous: int = 0

    def child(self, tag: str, attributes: str) -> Open:
        hidden, main, plain, ambiguous = named(tag, attributes)
        main = (main or tag in ("article", "main")) and not plain and not ambiguous
        first = main and not self.inside  # what frames a whole page says nothing of its article
        frame = 0 if first else self.frame + (tag == "form" or (tag == "header" and not self.inside))
        return Open(tag, self.unread or hidden or tag in UNREAD, self.inside or main, self.aside + (tag in ("nav", "aside", "footer")), frame, self.plain + plain, 0 if first else self.ambiguous + ambiguous)


def blocks(page: str) -> list[Block]:
    """The page's blocks that hold text, in order."""
    found: list[Block] = []
    stack = [Open()]
    parts: list[str] = []
    linked, in_link, at, heading, listed = 0, 0, 0, False, False

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                top = stack[-1]
                found.append(Block(" ".join(words), len(words), min(linked, len(words)), top.inside, top.aside + top.frame, top.plain, top.ambiguous, heading, listed))
            parts.clear()
        linked = 0

    def end_head() -> None:
        del stack[next(i for i, s in enumerate(stack) if s.tag == "head") :]

    def read(text: str) -> None:
        nonlocal linked
        if stack[-1].tag == "head" and text.strip():
            end_head()
        if text and not stack[-1].unread:
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.split())

    for m in TOKEN.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if not m[2] and (tag not in HEAD and stack[-1].tag == "head" or tag == "body" and any(s.tag == "head" for s in stack)):
            end_head()
        if tag == "a":
            in_link = 0 if m[2] else 1
        elif tag == "br":
            parts.append(" ")
        if tag == "span":  # only hidden ones, and those inside them, go on the stack
            if m[2]:
                if stack[-1].tag == "span":
                    stack.pop()
            elif stack[-1].tag == "span" or (m[4] and named(tag, m[4])[0]):
                stack.append(stack[-1]._replace(tag="span", unread=True))
            continue
        if tag not in BLOCK and tag not in UNREAD:
            continue
        if tag in BLOCK:
            flush()
            in_link = in_link if tag not in ("article", "main", "body") else 0
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        else:
            if tag in VOID or (tag in ("svg", "math") and m[4].endswith("/")):
                continue
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and stack[-1].tag == tag:
                stack.pop()
            stack.append(stack[-1].child(tag, m[4]))
        if tag in BLOCK:
            open_tags = [s.tag for s in stack[-3:]]
            heading = any(len(t) == 2 and t[0] == "h" and t[1].isdigit() for t in open_tags)
            listed = any(t in ("li", "dt", "dd") for t in open_tags)
    read(page[at:])
    flush()
    return found


#: The features by number.
FEATURES = ("words before", "links before", "words", "links", "words after", "links after", "in article", "other tags", "plain names", "ambiguous names", "heading", "listed")


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words) for b in found]).reshape(-1, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    outside = -1 if any(b.inside for b in found) else 0
    marks = np.array([(1 if b.inside else outside, b.tags, b.plain, b.ambiguous, b.heading, b.listed) for b in found], float).reshape(-1, 6)
    return np.column_stack([before, own, after, marks])


# --- the tree ------------------------------------------------------------------------------------------------------------


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4) -> Node:
    """CART with Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        cost = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < best:
            best, node.feature, node.cut = cost[i], f, (v[i] + v[i + 1]) / 2
    if node.feature >= 0:
        side = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[side], y[side], depth - 1, least), grow(x[~side], y[~side], depth - 1, least)
    return node


def shares(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None or node.high is None:
        return np.full(len(x), node.share)
    out, side = np.empty(len(x)), x[:, node.feature] <= node.cut
    out[side], out[~side] = shares(node.low, x[side]), shares(node.high, x[~side])
    return out


def training_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages."""
    xs, ys = [], []
    for page, wanted in labelled():
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([bool(wanted & set(b.text.replace(".", "").split())) for b in found], float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def trained() -> Node:
    return grow(*training_table())


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, s in zip(found, shares(trained(), features(found))) if s >= 0.5)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces(b, 500)):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return columns_of(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(make, "page_id long, url string, text string, n_chars long")
