"""Main text of web pages by minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import page_samples

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mstyle mover munder munderover mpadded mphantom mfenced semantics".split()
)
UNSEEN = frozenset("head title script style noscript template iframe object svg canvas audio video select option textarea button form input datalist annotation annotation-xml".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)

# Words of class and id names that speak against or for content.
AGAINST = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "rail aside footer header masthead comment comments commentlist reply replies respond discussion disqus cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager toolbar skip "
    "hidden copyright legal disclaimer".split()
)
FOR = frozenset("article content main post entry story body text articlebody prose".split())

SAMPLE_PAGES, SAMPLE_SEED, DECAY = 600, 7, 2.0  # what the block classifier is fitted on, and how strongly its weights are held back
SMOOTH, SIBLING, BORDER = 4.0, 0.5, 0.15  # strength of the smoothness edges; at the border of a box named as boilerplate they count less
UNIT = 1000  # capacities are integers


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    depth: int
    unseen: bool
    content: bool
    barred: bool
    named_for: bool
    named_against: bool = False
    wraps: bool = False
    chars: int = 0

    def above(self) -> Iterator[Element]:
        e = self.parent
        while e is not None:
            yield e
            e = e.parent

    @property
    def against(self) -> bool:
        """Hidden, boilerplate or named so, itself or by what encloses it; names of what wraps the main text don't count."""
        return self.barred or any(e.named_against and not e.wraps for e in (self, *self.above()))


@dataclass
class Block:
    element: Element
    text: str
    link_chars: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_content_element: bool = False


def name_words(attrs: list[tuple[str, str | None]]) -> list[set[str]]:
    """Words of the class, id and role, a set for each name."""
    found = []
    for key, value in attrs:
        if key in ("class", "id", "role", "itemprop") and value:
            found += [set(re.sub(r"([a-z])([A-Z])", r"\1 \2", n).lower().replace("-", " ").replace("_", " ").split()) for n in value.split()]
    return found


class Reader(HTMLParser):
    """Cuts a page into blocks of text; elements left open close as HTML closes them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        root = Element("", None, 0, False, False, False, False)
        self.open = [root]
        self.mains: list[Element] = []
        self.parts: list[str] = []
        self.link_chars = 0
        self.in_link = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            owner = next(e for e in reversed(self.open) if e.tag not in INLINE)
            self.page.blocks.append(Block(owner, text, min(self.link_chars, len(text))))
        self.parts, self.link_chars = [], 0

    def leave(self, depth: int) -> None:
        while len(self.open) > depth:
            gone = self.open.pop()
            self.in_link -= gone.tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "p"), 0)
                if at and all(e.tag in INLINE or e.tag == "p" for e in self.open[at:]):
                    self.leave(at)
            elif tag in ("li", "dt", "dd", "tr", "td", "th"):
                at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in (tag, "ul", "ol", "dl", "table")), 0)
                if at and self.open[at].tag == tag:
                    self.leave(at)
        if tag in VOID:
            return
        up = self.open[-1]
        names = name_words(attrs)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)) for k, v in attrs)
        content = up.content or tag in CONTENT
        bad = [n & AGAINST for n in names]
        named = any(b if not n & FOR else b - {"header", "footer", "body"} for n, b in zip(names, bad, strict=True))
        self.page.has_content_element |= tag in CONTENT
        boiler = tag in BOILERPLATE or (tag == "header" and not up.content)
        new = Element(tag, up, up.depth + 1, up.unseen or tag in UNSEEN, content, up.barred or hidden or boiler, up.named_for or any(n & FOR for n in names))
        new.named_against, new.wraps = named, tag in ("html", "body", "main")
        self.open.append(new)
        if tag in CONTENT and not new.barred:
            self.mains.append(new)
        self.in_link += tag == "a"

    def handle_endtag(self, tag):
        if tag == "br":
            self.parts.append(" ")
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if not at:
            return
        if tag in INLINE and any(e.tag not in INLINE for e in self.open[at:]):
            return  # an inline end tag doesn't close blocks
        if tag not in INLINE:
            self.flush()
        self.leave(at)

    def handle_data(self, data):
        if not self.open[-1].unseen:
            self.parts.append(data)
            if self.in_link > 0:
                self.link_chars += len(data.strip())


def mark_wrappers(page: Page, mains: list[Element]) -> None:
    """Marks what encloses a main element or the longest article: names there tell the layout, not what the text is."""
    for b in page.blocks:
        for e in (b.element, *b.element.above()):
            e.chars += len(b.text)
    articles = [e for e in mains if e.tag == "article" and not e.named_against]
    for e in [e for e in mains if e.tag == "main"] + sorted(articles, key=lambda e: -e.chars)[:1]:
        for up in e.above():
            up.wraps = True


def read_page(html: str) -> Page:
    reader = Reader()
    reader.feed(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", html))
    reader.close()
    reader.flush()
    mark_wrappers(reader.page, reader.mains)
    return reader.page


FEATURES = ("one", "length", "short", "links", "content", "outside", "against", "named_for", "paragraph", "heading", "item", "sentence")


def features(block: Block, page: Page) -> list[float]:
    """What the classifier knows of a block: its text, its links, what encloses it and how that is named."""
    e, n = block.element, len(block.text)
    against = e.against
    return [
        1.0,
        min(np.log2(1 + n), 8.0) / 8,
        float(n < 25),
        block.link_chars / n,
        float(e.content and not against),
        float(page.has_content_element and not e.content),
        float(against),
        float(e.named_for and not against),
        float(e.tag in ("p", "blockquote", "pre")),
        float(re.fullmatch("h[1-6]", e.tag) is not None),
        float(e.tag in ("li", "dd", "dt", "td", "th")),
        float(block.text[-1] in ".!?:;\u3002\u2026\"\u201d\u201c\u00bb"),
    ]


def fit_classifier(pages: list[str], decay: float = DECAY, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression on the blocks of labelled pages (see `page_samples`), by Newton's method."""
    rows, labels = [], []
    for html in pages:
        page = read_page(html)
        for b in page.blocks:
            labels.append(b.text.startswith(page_samples.MAIN))
            b.text = b.text[1:].strip() or "."
            b.link_chars = min(b.link_chars, len(b.text))
            rows.append(features(b, page))
    x, y = np.array(rows), np.array(labels, dtype=float)
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ weights)))
        slope = x.T @ (y - p) - decay * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + decay * np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, slope)
    return weights


@cache
def fitted() -> np.ndarray:
    """The classifier's weights; fitting takes about a second and always gives the same."""
    return fit_classifier(page_samples.labelled_pages(SAMPLE_PAGES, SAMPLE_SEED))


def log_odds(page: Page, weights: np.ndarray) -> list[float]:
    """The classifier's log-odds of each block being main text."""
    return (np.array([features(b, page) for b in page.blocks]) @ weights).tolist()


def tree_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Flow:
    """Maximum flow by shortest augmenting levels."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def link(self, a: int, b: int, capacity: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.left.append(capacity)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.left.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        waiting = deque([source])
        while waiting:
            a = waiting.popleft()
            for e in self.edges[a]:
                if self.left[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    waiting.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> int:
        total = 0
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.edges)
            path: list[int] = []
            node = source
            while True:
                if node == sink:
                    pushed = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= pushed
                        self.left[e ^ 1] += pushed
                    total += pushed
                    cut = next(i for i, e in enumerate(path) if not self.left[e])
                    node = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while turn[node] < len(self.edges[node]):
                    e = self.edges[node][turn[node]]
                    if self.left[e] and level[self.to[e]] == level[node] + 1:
                        break
                    turn[node] += 1
                if turn[node] < len(self.edges[node]):
                    path.append(self.edges[node][turn[node]])
                    node = self.to[path[-1]]
                elif path:
                    node = self.to[path.pop() ^ 1]
                    turn[node] += 1
                else:
                    break
        return total


def content_blocks(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise classifier cost plus the weight of links cut: True for content."""
    n = len(odds)
    flow = Flow(n + 2)
    for i, x in enumerate(odds):
        if x > 0:
            flow.link(n, i, round(x * UNIT))
        else:
            flow.link(i, n + 1, round(-x * UNIT))
    for a, b, weight in links:
        flow.link(a, b, round(weight * UNIT), round(weight * UNIT))
    flow.run(n, n + 1)
    reached = flow.levels(n)
    return [reached[i] >= 0 for i in range(n)]


def block_links(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, the closer in the tree the stronger, and blocks of one parent that others part.

    Where one of two blocks lies in a box that is named or meant for boilerplate and the
    other doesn't, the edge counts BORDER times as much.
    """
    against = [b.element.against for b in blocks]
    weigh = lambda i, j, w: (i, j, w if against[i] == against[j] else w * BORDER)
    links = [weigh(i, i + 1, SMOOTH / (1 + tree_distance(blocks[i].element, blocks[i + 1].element))) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = id(b.element.parent)
        if parent in last and last[parent] != i - 1:
            links.append(weigh(last[parent], i, SIBLING))
        last[parent] = i
    return links


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    page = read_page(html or "")
    if not page.blocks:
        return ""
    labels = content_blocks(log_odds(page, fitted() if weights is None else weights), block_links(page.blocks))
    return " ".join(b.text for b, keep in zip(page.blocks, labels, strict=True) if keep)


def text_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "_text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: `id_col, url_col, text, n_chars`.

    Pages become blocks of text between block-level tags, with character references decoded
    and white space turned to single spaces.  A logistic regression over text length, link
    share, enclosing elements and their names, fitted on SAMPLE_PAGES made-up labelled pages,
    gives each block's log-odds of content, which
    become capacities from the source or to the sink; neighbouring blocks are tied the more
    closely the nearer they are in the tree, and blocks of one parent are tied too.  The
    minimum cut labels the blocks; content blocks are joined in page order by one space.

    Null and empty pages give an empty text; pages of any length are read whole; a block
    whose two labels cost the same is left out; broken markup is read as browsers do, a tag cut
    off at the end is left out; repeated rows get equal results; ids and urls may be null;
    an empty table gives an empty result; other columns don't take part, whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("_id", "_url")]
    weights = fitted()
    done = rows.mapInArrow(lambda it: text_batches(it, weights), f"_id {kinds[0]}, _url {kinds[1]}, _text string")
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
