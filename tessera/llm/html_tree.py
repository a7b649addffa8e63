"""Main text of web pages by tree scoring.

The page is read into a light element tree with the end tags that HTML leaves
out put in.  Each paragraph earns points for its length and its commas; its
parent gets them whole, the grandparent half, the next three ancestors a third
by level.  A container's points are discounted by the share of its text that
stands in links.  The best container is kept with those siblings that read like
the article, and its blocks are returned in page order.

Scripts and the like are never text.  Elements whose tag, role, class or id says
navigation, form, advert, notice or comment are judged by what they hold: one
with more than half of the page's points is a wrapper and stays, whatever its
name (comments: more than four fifths); one with an ambiguous name goes only if
it holds links or next to no text; the others go.

All work is in proportion to the page: tags are read once, open elements are
counted by tag and scope, and sums are taken over the nodes once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|select|object|canvas|title|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[!?/][^>]*>|<[a-zA-Z][^>]*>",
    re.S | re.I,
)
_CLOSED = re.compile(r"(?:</\w+\s*|--)>\Z")
_ATTR = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([\w:-]+)""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Open elements that a start tag ends, if no element of the second set stands between.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What bounds the search of an end tag that may be a stray.
_SCOPE = frozenset("article section div main body".split())
_DROP = frozenset("nav aside footer form button menu dialog head fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words that name what is no article, whole; with words of place or form beside them, as in ad-box, but not as in ad-hoc.
_BAD = re.compile(
    r"nav|navbar|navigation|menus?|sidebar|ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|popups?|modal|overlay|newsletter|subscri\w*|signup|shar(?:e|ing)"
    r"|social|breadcrumbs?|pagination|pager|footer|masthead|toolbar|hidden|login|skip|copyright|outbrain|taboola"
)
_WEAK = re.compile(r"side|rail|notices?|notifications?|alerts?|related|recommend\w*|discussions?|reply|replies|widgets?|search|legal|disclaimers?|teasers?")
_COMMENTS = re.compile(r"comments?|commentlist|disqus|respond")
_HEADER = re.compile(r"header")
_BESIDE = re.compile(
    r"\d+|[a-z]|box|boxes|block|blocks|container|wrap|wrapper|area|unit|units|slot|bar|strip|list|items?|links?|buttons?|icons?|panel|section|content|inner|outer|body|row|col|column|group|zone|holder|frame|layer"
    r"|top|bottom|left|right|main|site|page|global|primary|secondary|mobile|desktop|small|large|sticky|fixed|form|text|title|label|media|post|posts|story|stories|article|articles|us|js|id"
)
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDED = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")
_GOOD = re.compile(r"article|content|post|entry|story|body|text|main", re.I)


#: How far points reach, and what each ancestor gets of them.
_SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: What marks an element as one that may go: an ambiguous name, a clear name or tag, reader comments.
WEAK, CLEAR, COMMENTS = 1, 2, 3


_STRAYS = frozenset("p li td tr dd dt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NO_POINTS = _HEADINGS | {"li", "dt", "th"}
_PARAGRAPHS = frozenset("p pre blockquote td dd".split())
_TEXT = frozenset("p ul ol dl pre blockquote table figure".split())
_LISTS = frozenset("ul ol div table section dl".split())


class Node:
    """own: points of the blocks in it and below; points: what it has as an ancestor."""

    __slots__ = ("tag", "up", "name", "mark", "drop", "take", "own", "points", "chars", "linked", "links", "paragraph", "ended")

    def __init__(self, tag: str, up: Node | None):
        self.tag, self.up, self.name, self.mark, self.drop, self.take = tag, up, "", 0, False, False
        self.own, self.points, self.chars, self.linked, self.links, self.paragraph, self.ended = 0.0, 0.0, 0, 0, 0, False, False


class Block:
    __slots__ = ("node", "text", "linked", "links")

    def __init__(self, node: Node, text: str, linked: int, links: int):
        self.node, self.text, self.linked, self.links = node, text, linked, links


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else m[5].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source)}


@lru_cache(4096)
def _named(name: str) -> tuple[bool, bool, bool, bool]:
    """Whether a class or id says comments, what is clearly no article, what may be none, or a header."""
    out = [False] * 4
    for token in name.split():
        parts = [x.lower() for x in _PARTS.split(token) if x]
        for i, kind in enumerate((_COMMENTS, _BAD, _WEAK, _HEADER)):
            own = [bool(kind.fullmatch(x)) for x in parts]
            other = (_BAD, _WEAK, _COMMENTS) if i < 3 else ()
            out[i] = out[i] or (any(own) and all(k or _BESIDE.fullmatch(x) or any(o.fullmatch(x) for o in other) for k, x in zip(own, parts, strict=True)))
    return tuple(out)


def _mark(tag: str, name: str, attrs: dict[str, str], inside: bool) -> int:
    """Whether an element may go; ``inside`` an article, a header has its title."""
    if tag in ("html", "body", "article", "main"):
        return 0
    if tag in _DROP or attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return CLEAR
    comments, clear, weak, header = _named(name)
    if tag == "header" or header:
        return 0 if inside else CLEAR
    return COMMENTS if comments else CLEAR if clear else WEAK if weak else 0


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """The elements in page order, the root first, and the blocks of text."""
    at = Node("#root", None)
    nodes, blocks, run = [at], [], []
    linked = links = anchors = last = 0
    # Open elements by tag: in all, and within the innermost element that bounds the search of stray end tags.
    opened: Counter[str] = Counter()
    scopes: list[Counter[str]] = [Counter()]

    def add(source: str) -> None:
        nonlocal linked
        text = unescape(source) if "&" in source else source
        run.append(text)
        if anchors:
            linked += len("".join(text.split()))

    def flush() -> None:
        nonlocal linked, links
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append(Block(at, text, linked, links))
            run.clear()
        linked = links = 0

    def enter(tag: str, attrs: dict[str, str]) -> None:
        nonlocal at
        node = Node(tag, at)
        node.name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip()
        node.mark = _mark(tag, node.name, attrs, opened["article"] + opened["main"] > 0)
        nodes.append(node)
        at = node
        opened[tag] += 1
        if tag in _SCOPE:
            scopes.append(Counter())
        scopes[-1][tag] += 1

    def leave(node: Node) -> None:
        """Close all up to and with ``node``."""
        nonlocal at
        while True:
            done, at = at, at.up
            opened[done.tag] -= 1
            scopes[-1][done.tag] -= 1
            if done.tag in _SCOPE:
                scopes.pop()
            if done is node:
                return

    end, whole = html.rfind(">") + 1, True
    for m in _TOKEN.finditer(html, 0, end):
        if m.start() > last:
            add(html[last : m.start()])
        last = m.end()
        tag = m["tag"]
        if tag is None:
            # A script or comment that nothing closes goes on to the end of the page.
            whole = last < end or not (m["raw"] or m[0].startswith("<!--")) or _CLOSED.search(m[0]) is not None
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                anchors = 0 if m["end"] else 1
                links += not m["end"]
            elif tag == "br":
                run.append("\n")
            elif m["end"]:
                if at.tag == tag:
                    flush()
                    leave(at)
            elif tag not in _VOID and m["attrs"]:
                attrs = _attributes(m["attrs"])
                if _mark(tag, f"{attrs.get('class', '')} {attrs.get('id', '')}".strip(), attrs, True):
                    flush()
                    enter(tag, attrs)
            continue
        if m["end"]:
            flush()
            # A paragraph's or list item's stray end does not close what holds it.
            if (scopes[-1] if tag in _STRAYS else opened)[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.up
                leave(node)
                anchors = 0
            continue
        flush()
        if tag in _VOID or (tag in ("html", "body") and opened[tag]):
            continue
        anchors = 0
        if tag in _ENDS_P and at.tag == "p":
            leave(at)
        ends, stops = _IMPLIED.get(tag, ((), ()))
        if any(opened[e] for e in ends):
            node = at
            while node is not None and node.tag not in stops and node.tag not in ends:
                node = node.up
            if node is not None and node.tag in ends:
                row = node.up if tag == "tr" and node.tag != "tr" else None
                leave(node)
                if row is not None and row.tag == "tr":
                    leave(row)
        enter(tag, _attributes(m["attrs"]) if m["attrs"] else {})
    rest = html[last:]
    if rest and whole:
        # A tag that the end of the page cuts off is no text.
        cut = re.search(r"<[a-zA-Z/!?]", html[end:])
        add(rest[: end - last + cut.start()] if cut else rest)
    flush()
    return nodes, blocks


def earned(block: Block) -> float:
    """Points of a block of text: for length and commas, less what stands in links."""
    n = len(block.text)
    points = min(n / 100, 3) + block.text.count(",") + block.text.count("、") + block.text.count("，") + (n >= 25)
    return points * (1 - min(1, block.linked / n))


def _judge(nodes: list[Node], blocks: list[Block]) -> None:
    """Marks what goes."""
    for b in blocks:
        b.node.own += earned(b)
        b.node.chars += len(b.text)
        b.node.linked += b.linked
        b.node.links += b.links
    for node in reversed(nodes[1:]):
        up = node.up
        up.own, up.chars, up.linked, up.links = up.own + node.own, up.chars + node.chars, up.linked + node.linked, up.links + node.links
    total = nodes[0].own
    for node in nodes[1:]:
        if node.up.drop:
            node.drop = True
        elif node.mark:
            share = node.own / total if total else 0.0
            node.drop = share <= (0.8 if node.mark == COMMENTS else 0.5) and (node.mark != WEAK or node.own < 3 or _density(node) > 1 / 3)


def _weigh(nodes: list[Node], blocks: list[Block]) -> None:
    """Points, text and links of the nodes above the blocks that stay."""
    for node in nodes:
        node.chars = node.linked = node.links = 0
    for b in blocks:
        node = b.node
        node.chars += len(b.text)
        node.linked += b.linked
        node.links += b.links
        node.ended = node.ended or bool(_ENDED.search(b.text))
        if node.tag in _NO_POINTS:
            continue
        node.paragraph = node.tag in _PARAGRAPHS
        points, up = earned(b), node.up if node.paragraph else node
        for share in _SHARES:
            if up is None:
                break
            up.points += points * share
            up = up.up
    for node in reversed(nodes[1:]):
        up = node.up
        up.chars, up.linked, up.links, up.ended = up.chars + node.chars, up.linked + node.linked, up.links + node.links, up.ended or node.ended


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def _value(node: Node) -> float:
    points = node.points
    if node.tag in ("article", "main"):
        points += 25
    elif node.name and _GOOD.search(node.name):
        points += 5
    return points * (1 - _density(node))


def _like_text(node: Node) -> bool:
    """Whether a sibling of the best container reads like the article: few links, and an element of text or a whole sentence, however short."""
    if node.tag in _HEADINGS:
        return _density(node) < 0.5
    return _density(node) < 0.25 and (node.tag in _TEXT or node.ended or node.chars >= 80)


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text in page order; none where the page has no text."""
    nodes, blocks = parse(html)
    _judge(nodes, blocks)
    blocks = [b for b in blocks if not b.node.drop]
    _weigh(nodes, blocks)
    able = [n for n in nodes if n.chars and n.tag not in ("#root", "html") and not n.paragraph]
    if not able:
        return [b.text for b in blocks]
    best = max(able, key=_value)
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.up
    best.take = True
    if best.up is not None and best.tag not in ("article", "main", "body", "html"):
        for node in nodes:
            if node.up is best.up and node is not best and node.chars and not node.drop:
                node.take = _like_text(node)
    for node in nodes[1:]:
        # A list of links within the article is left out.
        if not node.take and node.up.take:
            node.take = not (node.tag in _LISTS and node.links >= 2 and _density(node) > 0.5)
    return [b.text for b in blocks if b.node.take]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html)) if html else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars (code points).

    Null and empty pages, and pages without text, have the empty text.  Pages of
    any length are read whole, in time in proportion to it.  Of containers with
    equal scores the first on the page is taken.  Rows are read alone: repeated
    rows agree, null keys and urls stay null, other columns are not read, an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, pages in slices(b.column(2)):
                texts = list(map(main_text, pages))
                yield pa.record_batch([b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)
