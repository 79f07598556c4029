"""Main text of HTML pages: blocks labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names of HTML, and words that authors use for parts of a page.
UNREAD = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video select option "
    "button textarea datalist".split()
)
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
ENDS_ITSELF = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
LIST_LIKE = frozenset("ul ol dl table body article section div main".split())
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol "
    "pre section table ul".split()
)
BOILERPLATE_TAGS = frozenset("nav aside footer form dialog menu fieldset".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = frozenset("article content entry post story text body main".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus feedback footer form gdpr header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination paywall popup promo promoted recommended "
    "related replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored "
    "subscribe subscription tags toolbar widget widgets".split()
)
ALWAYS_WORDS = frozenset("comment comments disqus replies respond".split())
ALWAYS_STEMS = ("comment", "komment", "coment")  # readers' comments in the languages of the pages
NAMED_BY_ID = frozenset("h1 h2 h3 h4 h5 h6 section".split())  # their ids name a topic, not a part of the page
ITEMS = frozenset("li dt dd td th figcaption caption".split())
CALLS = re.compile(
    r"\b(?:subscribe|sign up|newsletter|buy now|order now|free trial|special offer|advertisement|sponsored|% off)\b", re.I
)
CALL_LENGTH = 200  # characters up to which a block can be a call to readers

# The classifier's log-odds for content.
WEIGHTS = {
    "base": -0.5, "in_content": 2.0, "content_word": 1.0, "paragraph": 0.8, "heading": 0.3, "length": 0.7,
    "sentence": 0.4, "item": 0.4, "links": -3.0, "call": -4.0, "boilerplate": -6.0,
}
NEXT = 1.2  # smoothness between neighbours, less with their distance in the tree
SIBLING = 0.5  # smoothness between consecutive blocks under one parent

_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    unread: bool
    content: bool
    content_word: bool
    boilerplate: bool


@dataclass
class Block:
    """A run of text without a block boundary inside, and the element that holds it."""

    text: str
    element: Element
    linked: int  # characters inside links


def _names(value: str | None) -> list[str]:
    """The words of a class or id."""
    return [w.lower() for w in _WORDS.findall(value)] if value else []


def _element(tag: str, attrs: dict[str, str | None], parent: Element | None) -> Element:
    role = (attrs.get("role") or "").lower()
    style = (attrs.get("style") or "").replace(" ", "").lower()
    words = _names(attrs.get("class"))
    ids = _names(attrs.get("id"))
    always = {w for w in words + ids if w in ALWAYS_WORDS or w.startswith(ALWAYS_STEMS)}
    words += [] if tag in NAMED_BY_ID else ids
    bad = always.union(BOILERPLATE_WORDS.intersection(words))
    good = bool(CONTENT_WORDS.intersection(words)) or attrs.get("itemprop") == "articleBody"
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style
    content = tag in CONTENT_TAGS or role in ("main", "article") or bool(parent and parent.content)
    whole = tag in ("html", "body", "main", "article")  # names of whole pages tell nothing of a part
    named_bad = bool(always) or bool(bad) and not good and not {"with", "has", "no"} & set(words)
    boilerplate = (
        tag in BOILERPLATE_TAGS
        or tag == "header" and not content
        or role in BOILERPLATE_ROLES
        or hidden
        or named_bad and not whole
    )
    return Element(
        tag, parent, parent.depth + 1 if parent else 0,
        tag in UNREAD or bool(parent and parent.unread), content,
        good or bool(parent and parent.content_word),
        boilerplate or bool(parent and parent.boilerplate),
    )


class Blocks(HTMLParser):
    """The text blocks of a page in its order; markup that is never closed is allowed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack = [_element("html", {}, None)]
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            holder = next((e for e in reversed(self.stack) if e.tag not in INLINE), self.stack[0])
            self.blocks.append(Block(text, holder, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _end_head(self) -> None:
        """Ends an open head: </head> may be left out before anything that can't stand in a head."""
        if self.stack[-1].tag == "head":
            self.stack.pop()

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self._close({"p"}, LIST_LIKE)
            if tag in ENDS_ITSELF:
                self._close(ENDS_ITSELF[tag], LIST_LIKE)
        elif tag == "br":
            self.parts.append(" ")
        if tag == "html":
            return
        if tag not in VOID:
            self.stack.append(_element(tag, dict(attrs), self.stack[-1]))
            self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in ("body", "html", "br"):
            self._end_head()
        if tag not in INLINE:
            self.flush()
        self._close({tag}, ())

    def _close(self, tags, fence) -> None:
        """Ends the innermost open element of ``tags`` and all inside it, unless ``fence`` comes first."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.links -= sum(e.tag == "a" for e in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in fence:
                return

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.stack[-1].unread:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self.flush()


def log_odds(block: Block) -> float:
    """The classifier's log-odds that a block is content."""
    e = block.element
    n = len(block.text)
    return (
        WEIGHTS["base"]
        + WEIGHTS["in_content"] * e.content
        + WEIGHTS["content_word"] * e.content_word
        + WEIGHTS["paragraph"] * (e.tag in ("p", "pre", "blockquote"))
        + WEIGHTS["heading"] * (len(e.tag) == 2 and e.tag[0] == "h")
        + WEIGHTS["length"] * min(n / 80, 2.0)
        + WEIGHTS["sentence"] * (block.text[-1] in ".!?…:;\"'”»")
        + WEIGHTS["item"] * (e.tag in ITEMS)
        + WEIGHTS["links"] * block.linked / n
        + WEIGHTS["call"] * (n <= CALL_LENGTH and bool(CALLS.search(block.text)))
        + WEIGHTS["boilerplate"] * e.boilerplate
    )


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Cut:
    """Maximum flow by level graphs; the nodes that the source still reaches are its side of a minimum cut."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [there, back]

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        while True:
            level = self._levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            nxt = [0] * len(self.out)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    keep = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    at = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                while nxt[at] < len(self.out[at]):
                    e = self.out[at][nxt[at]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[at] + 1:
                        break
                    nxt[at] += 1
                else:
                    if at == source:
                        break
                    at = self.to[path.pop() ^ 1]
                    nxt[at] += 1
                    continue
                path.append(e)
                at = self.to[e]


def labels(blocks: list[Block]) -> list[bool]:
    """Whether each block is content: the labelling with the least total cost.

    A block's log-odds are the cost of the other label, as capacity from the
    source (content) or to the sink (boilerplate). Neighbours in the page and
    consecutive blocks of one parent pay a smoothness cost when their labels
    differ.
    """
    n = len(blocks)
    cut = Cut(n + 2)
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        odds = log_odds(block)
        cut.edge(n, i, max(odds, 0.0))
        cut.edge(i, n + 1, max(-odds, 0.0))
        if i:
            near = NEXT / (1 + _distance(blocks[i - 1].element, block.element) / 2)
            cut.edge(i - 1, i, near, near)
        parent = id(block.element.parent)
        if parent in last:
            cut.edge(last[parent], i, SIBLING, SIBLING)
        last[parent] = i
    return cut.source_side(n, n + 1)[:n]


def main_text(html: str | None) -> str:
    """The content blocks of one page, joined by line ends; empty if there are none."""
    page = Blocks()
    page.feed(html or "")
    page.close()
    return "\n".join(b.text for b, content in zip(page.blocks, labels(page.blocks)) if content)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array(list(map(main_text, batch.column(2).to_pylist())), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page.

    Each page is a small graph of its own, so pages are labelled where they lie,
    without a shuffle. Null or empty html, and pages without content, give an
    empty text; null ids and addresses stay; repeated rows each return a row;
    other columns are ignored; an empty table gives no rows.
    """
    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return source.mapInArrow(_texts, "page_id long, url string, text string")
