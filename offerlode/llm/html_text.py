"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of tags from the root. For each
path, text length, punctuation and link text are added up over its blocks; length and
punctuation per block, smoothed over neighbouring blocks and fused into one ratio, tell prose
from furniture. Blocks whose ratio reaches a share of the mean are chosen. Article and main
elements with chosen blocks are taken whole, if they hold most of the chosen text; else the
subtree that holds most of it, the chosen blocks outside, and short blocks between chosen ones.
Parts that are marked as furniture by tag, role or style, or by class where the ratios agree, and lists of nothing but
links outside the article, are left out.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.llm.common import free_name, small

# Names in HTML and words that mark furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend optgroup option tbody td tfoot th thead tr".split())
ENDS_SELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th", "tbody", "thead"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
SCOPE = frozenset("ul ol dl table html body td th article section div main aside blockquote".split())
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript template button select input textarea iframe svg object canvas "
    "dialog menu audio video map applet title".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split()
)
DROP_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar aside widget widgets ad ads advert "
    "adverts advertisement adsense adbox adslot sponsor sponsored promo promos promotion banner cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments commentlist respond disqus replies pagination pager "
    "toolbar skip search masthead copyright disclaimer paywall".split()
)
#: Of these, words that tell of content and not of layout: no article inside makes it the page's own.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense adbox adslot sponsor sponsored promo promos promotion related "
    "recommended recommendations comment comments commentlist respond disqus replies".split()
)
HEADER_WORDS = frozenset("header head topbar".split())
ARTICLE_WORDS = frozenset("article post entry story content main page body".split())

TOKEN = re.compile(
    r"<!--(?:.*?-->|>|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SMOOTH = 1
#: Share of the mean ratio, weighted by text, that a prose path reaches.
PROSE = 0.25
#: Share of the prose that the article's subtree holds.
HELD = 0.8
#: Share of the prose that article and main elements hold where they are the content.
NAMED = 0.5
#: Share of the prose that keeps an element with a furniture word.
MOST = 0.5
#: What an element's tag, role, style, class and id say of it.
CONTENT, LAYOUT, OTHER, FURNITURE = range(4)


@dataclass
class Block:
    path: tuple[int, ...]
    tags: tuple[str, ...]
    text: str
    linked: int
    furniture: bool
    marked: tuple[tuple[int, int], ...]


@dataclass
class Node:
    tag: str
    number: int
    drop: bool
    link: bool
    article: bool
    marked: tuple[tuple[int, int], ...] = ()


@dataclass
class Reader:
    """Elements that are open while a page is read, and the blocks found so far."""

    stack: list[Node] = field(default_factory=lambda: [Node("", 0, False, False, False)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    elements: int = 0

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.stack[-1].link:
                self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(
                    tuple(node.number for node in self.stack), tuple(node.tag for node in self.stack),
                    text, self.linked, self.stack[-1].drop, self.stack[-1].marked,
                ))
            self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in CLOSES_P:
            self.close_nearest(("p",))
        if tag in ENDS_SELF:
            self.close_nearest(ENDS_SELF[tag])
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "body" and any(node.tag == "body" for node in self.stack):
            return
        self.elements += 1
        above = self.stack[-1]
        article = above.article or tag in ("article", "main")
        kind = furniture(tag, attributes, above.article)
        marked = above.marked + ((self.elements, kind),) if kind in (LAYOUT, OTHER) else above.marked
        self.stack.append(Node(
            tag, self.elements, above.drop or kind == FURNITURE, above.link or tag == "a", article, marked
        ))

    def close_nearest(self, tags: tuple[str, ...]) -> None:
        """End open elements of these tags, up to the nearest that holds blocks of its own."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                self.flush()
                del self.stack[at:]
                if len(tags) > 1:
                    self.close_nearest(tags)
                return
            if tag in SCOPE and tag not in tags:
                return

    def close(self, tag: str) -> None:
        if tag in BLOCK or tag == "br":
            self.flush() if tag != "br" else self.parts.append(" ")
        inline = tag not in BLOCK
        for at in range(len(self.stack) - 1, 0, -1):
            held = self.stack[at].tag
            if held == tag:
                del self.stack[at:]
                return
            if inline and held in BLOCK:
                return


def furniture(tag: str, attributes: str, in_article: bool) -> int:
    """FURNITURE by tag, role or style, LAYOUT or OTHER by the words of class and id, else CONTENT."""
    if tag in DROP_TAGS:
        return FURNITURE
    if tag == "header" and not in_article:
        return FURNITURE
    if not attributes:
        return CONTENT
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" and value.lower() != "until-found":
            return FURNITURE
        if name == "aria-hidden" and value.lower() == "true":
            return FURNITURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return FURNITURE
        if name == "role" and value.lower() in DROP_ROLES and not (in_article and value.lower() == "banner"):
            return FURNITURE
        if name in ("class", "id"):
            words |= {word.lower() for word in WORDS.findall(value)}
    if tag in ("html", "body", "main", "article") and not words & {"comment", "ad", "advert", "related", "promo"}:
        return CONTENT
    if words & DROP_WORDS:
        return OTHER if words & OTHER_WORDS else LAYOUT
    return LAYOUT if words & HEADER_WORDS and not in_article and not words & ARTICLE_WORDS else CONTENT


def blocks_of(page: str) -> list[Block]:
    reader = Reader()
    at, size = 0, len(page)
    while at < size:
        match = TOKEN.search(page, at)
        if match is None:
            reader.add(html.unescape(page[at:]))
            break
        if match.start() > at:
            reader.add(html.unescape(page[at:match.start()]))
        at = match.end()
        if match.group().startswith("<![CDATA["):
            continue
        ending, tag, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if ending:
            reader.close(tag)
            continue
        reader.open(tag, attributes)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
    reader.flush()
    return reader.blocks


def path_ratios(blocks: list[Block]) -> tuple[list[float], list[float]]:
    """The fused ratio of each block's tag path, and the same smoothed over neighbours in page order."""
    chars, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for block in blocks:
        chars[block.tags] += max(len(block.text) - block.linked, 0)
        marks[block.tags] += len(PUNCTUATION.findall(block.text))
        count[block.tags] += 1
    raw = [chars[b.tags] / count[b.tags] * (1 + marks[b.tags] / count[b.tags]) for b in blocks]
    return raw, [
        sum(raw[max(0, at - SMOOTH):at + SMOOTH + 1]) / len(raw[max(0, at - SMOOTH):at + SMOOTH + 1])
        for at in range(len(raw))
    ]


def _prose(blocks: list[Block]) -> tuple[list[float], list[int], float]:
    """Each block's own ratio, its characters if the smoothed ratio chooses it, and the least ratio."""
    raw, ratios = path_ratios(blocks)
    chars = [max(len(block.text) - block.linked, 0) for block in blocks]
    least = PROSE * sum(r * n for r, n in zip(ratios, chars)) / max(sum(chars), 1)
    return raw, [n if ratio >= least else 0 for ratio, n in zip(ratios, chars)], least


def _unmarked(blocks: list[Block]) -> list[Block]:
    """Blocks in no element whose furniture word the path ratios bear out.

    An element that holds most of the prose is no furniture, nor is one with an article or main
    element inside if its word tells of layout. Comments, advertising and the like are furniture
    beside an article or main element, whatever they hold.
    """
    if not any(block.marked for block in blocks):
        return blocks
    _, prose, _ = _prose(blocks)
    held: dict[int, int] = defaultdict(int)
    articles: set[int] = set()
    apart = False
    for block, n in zip(blocks, prose):
        inside = "article" in block.tags or "main" in block.tags
        apart |= bool(n) and inside and all(kind != OTHER for _, kind in block.marked)
        for number, _ in block.marked:
            held[number] += n
            if n and inside and any(
                tag in ("article", "main") for tag in block.tags[block.path.index(number):]
            ):
                articles.add(number)

    def content(number: int, kind: int) -> bool:
        if kind == LAYOUT and number in articles:
            return True
        return held[number] > 0 and held[number] >= MOST * sum(prose) and not (kind == OTHER and apart)

    return [block for block in blocks if all(content(*mark) for mark in block.marked)]


def article_blocks(blocks: list[Block]) -> list[str]:
    """Texts of the blocks that the path ratios choose, and of what stands with them."""
    blocks = _unmarked([block for block in blocks if not block.furniture])
    if not blocks:
        return []
    raw, prose, least = _prose(blocks)
    named = {
        next(number for number, tag in zip(block.path, block.tags) if tag in ("article", "main"))
        for block, n in zip(blocks, prose) if n and ("article" in block.tags or "main" in block.tags)
    }
    in_named = [not named.isdisjoint(block.path) for block in blocks]
    if named and sum(n for n, held in zip(prose, in_named) if held) >= NAMED * sum(prose):
        return [block.text for block, held in zip(blocks, in_named) if held]
    weight: dict[int, int] = defaultdict(int)
    tag_of, depth_of = {}, {}
    for block, n in zip(blocks, prose):
        for depth, (number, tag) in enumerate(zip(block.path, block.tags)):
            weight[number] += n
            tag_of[number], depth_of[number] = tag, depth
    most = max(weight.values())
    # Below the article there are only its own blocks; the container above them is meant.
    enough = [n for n in weight if weight[n] >= HELD * most and tag_of[n] not in ("p", "li", "td", "pre", "blockquote")]
    root = max((n for n in enough if tag_of[n] in BLOCK or not n), key=lambda n: (depth_of[n], -n))
    # Outside the subtree a block is chosen by its own path, not by its neighbours' as well.
    chosen = [n > 0 and (root in b.path or own >= least) for b, n, own in zip(blocks, prose, raw)]
    first, last = (order.index(True) if any(chosen) else 0 for order in (chosen, chosen[::-1]))
    last = len(blocks) - 1 - last
    whole = tag_of[root] not in ("", "html", "body")
    parents = {block.path[-2:-1] for block, held in zip(blocks, chosen) if held}
    return [
        block.text for at, block in enumerate(blocks)
        if (not _link_list(block) or whole and root in block.path or first < at < last) and (
            chosen[at] or in_named[at] or root in block.path or first < at < last and block.path[-2:-1] in parents
        )
    ]


def _link_list(block: Block) -> bool:
    return "li" in block.tags and block.linked > 0 and block.linked >= 0.9 * len(block.text)


def main_text(page: str | None) -> str:
    return "\n".join(article_blocks(blocks_of(page or "")))


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages but html, with text and n_chars (code points).

    The whole html is read; null, empty and broken pages give what text they hold, at worst an
    empty string. New columns whose names are taken get leading underscores.
    """
    kept = pages.drop("html")
    names = [free_name(kept, "text"), free_name(kept, "n_chars")]
    schema = T.StructType([
        *kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.LongType())
    ])

    columns_out = [*kept.columns, *names]

    def run(batches):
        for batch in small(batches):
            texts = [main_text(page) for page in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                columns_out,
            )

    source = free_name(kept, "page_html")
    return pages.select(F.col("html").cast("string").alias(source), *kept.columns).mapInArrow(run, schema)
