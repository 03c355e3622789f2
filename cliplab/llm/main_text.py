"""Main text of web pages by scoring the tree of their elements.

A small reader turns markup into a tree (void, optional-end and raw-text elements as browsers treat
them, cut pages included).  Every paragraph passes points to the elements above it: one, one per
comma and one per hundred characters up to three, in full to its parent, half to its grandparent, a
third of that further up.  An element's score is discounted by its link density; the article or main
element around the best container, else that container, and those siblings that score alike, or read
like prose, make the main text.

Elements that are not the article are set aside first: navigation, headers and footers outside the
article, sidebars, notices, adverts, forms, scripts, styles and reader comments, by element, role or
whole names of class and id; comments also by their form, repeated items with an author and a date.
Names and forms don't count against an element that holds the article, or most of the page's text.

Rows are independent: Spark deals them out, one page at a time is in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the markup language
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: beside the best container these are judged by their own text
PROSE = frozenset("p blockquote pre ul ol dl table".split())
#: inside an article these are left out if they are mostly links
LINK_CONTAINERS = frozenset("div section ul ol dl table".split())
#: an opening tag of the second kind ends an open element of the first, up to the nearest of the third
ENDED_BY = {
    "p": (BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}, frozenset()),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "tbody", "tfoot", "thead"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "tr", "tbody", "tfoot"}), frozenset({"table"})),
    "th": (frozenset({"td", "th", "tr", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "head": (frozenset({"body"}), frozenset()),
}
# What is set aside
ASIDE_ELEMENTS = frozenset(
    "head nav aside footer button select input textarea script style noscript iframe template svg math object embed canvas "
    "audio video dialog menu title".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar side widget widgets footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login share sharing social comment comments commentlist commentlists disqus respond replies related "
    "recommended toolbar pagination pager skip copyright legal".split()
)
#: words that may stand beside them in a name which still means the same, as in sidebar-right or comment-list
PLACE_WORDS = frozenset(
    "left right top bottom upper lower main wrapper wrap container box section block list area inner outer primary secondary fixed "
    "sticky header bar button buttons icon icons link links item items site page post posts article articles entry global body "
    "content region module row column col title heading text group unit slot zone form thread".split()
)
#: readers and advertisers may write more than the article has
NEVER_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsored comment comments commentlist commentlists disqus respond replies "
    "cookie cookies consent gdpr".split()
)
#: inside the article these may be what a section is about
TOPICS = frozenset("share sharing social legal copyright related recommended side promotion sponsor banner".split())
AUTHOR_WORDS = frozenset("author commenter user username avatar vcard byline nickname".split())
DATE_WORDS = frozenset("date time timestamp datetime ago posted".split())
ARTICLE_WORDS = frozenset("article post entry content story body text main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",  # a quote that is never closed
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDING = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "parts", "score", "scored")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list[Node | str] = []
        self.score = 0.0
        self.scored = False


def parse(html: str) -> Node:
    """The tree of a page; never fails, whatever is cut or left open."""
    root = here = Node("#root", "", None)
    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        if token is None:
            if at < end:
                here.parts.append(unescape(html[at:]))
            break
        if token.start() > at:
            here.parts.append(unescape(html[at : token.start()]))
        at = token.end()
        closing, opening, attributes = token.group(1), token.group(2) or token.group(4), token.group(3) or token.group(5) or ""
        if not token.group().endswith(">"):
            break  # a tag or comment that the page's end cuts
        if closing:
            here = _close(here, closing.lower())
        elif opening:
            tag = opening.lower()
            here = _end_open(here, tag)
            node = Node(tag, attributes, here)
            here.parts.append(node)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
            elif tag not in VOID:  # a slash at the end of other tags closes nothing
                here = node
    return root


def _close(here: Node, tag: str) -> Node:
    node = here
    while node.parent is not None and node.tag != tag:
        if node.tag in ("table", "td", "th", "article", "body") and tag not in BLOCKS:
            return here  # a stray end of an inline element doesn't leave its cell or article
        node = node.parent
    return node.parent if node.parent is not None else here


def _end_open(here: Node, tag: str) -> Node:
    node = here
    while node.parent is not None:
        ends, within = ENDED_BY.get(node.tag, (frozenset(), frozenset()))
        if tag in ends:
            here = node = node.parent
        elif node.tag in BLOCKS or node.tag in within:
            break
        else:
            node = node.parent
    return here


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)} if node.attributes else {}


def _parts(name: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower())) - {""}


def _words(attributes: dict[str, str]) -> set[str]:
    return _parts(f"{attributes.get('class', '')} {attributes.get('id', '')}")


def _aside_words(attributes: dict[str, str]) -> set[str]:
    """What is set aside by whole names: `sidebar`, `comment-list`, but neither `share-price` nor `no-comments`."""
    found: set[str] = set()
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        parts = _parts(name)
        if parts <= ASIDE_WORDS | PLACE_WORDS:
            found |= parts & ASIDE_WORDS
    return found


def _hidden(node: Node, attributes: dict[str, str]) -> bool:
    """A hidden attribute, with or without a value, or a style that hides."""
    if "hidden" in attributes or _HIDING.search(attributes.get("style", "")):
        return True
    return "hidden" in node.attributes.lower() and "hidden" in re.split(r"[\s/]+", _ATTRIBUTE.sub(" ", node.attributes).lower())


class _Page:
    """What the elements of a page hold: text outside links, the article, the headline, comments."""

    def __init__(self, root: Node):
        self.text: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.signed: dict[int, tuple[bool, bool]] = {}  # names an author, names a date
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(reversed([p for p in node.parts if isinstance(p, Node)]))
        for node in reversed(order):
            self._measure(node)
        main = next((n for n in order if n.tag in ("article", "main") and not _aside_words(_attributes(n))), None)
        self.article = main
        self.above_article = self._above(main)
        self.above_headline = self._above(next((n for n in order if n.tag == "h1"), None))
        self.whole = max(self.text[id(root)], 1)

    def _measure(self, node: Node) -> None:
        own = _attributes(node)
        words = _words(own) if own else set()
        text = links = 0
        author = bool(words & AUTHOR_WORDS) or own.get("rel", "").lower() == "author"
        date = bool(words & DATE_WORDS) or node.tag == "time"
        for part in node.parts:
            if isinstance(part, str):
                text += len(_SPACE.sub(" ", part).strip())
            else:
                text += self.text[id(part)]
                links += self.links[id(part)]
                author, date = author or self.signed[id(part)][0], date or self.signed[id(part)][1]
        if node.tag == "a":
            text, links = 0, links + text
        if node.tag in ASIDE_ELEMENTS:
            text = links = 0
        self.text[id(node)], self.links[id(node)], self.signed[id(node)] = text, links, (author, date)

    @staticmethod
    def _above(node: Node | None) -> frozenset[int]:
        found = set()
        while node is not None:
            found.add(id(node))
            node = node.parent
        return frozenset(found)

    def is_main(self, node: Node, words: set[str], inside: bool) -> bool:
        """Whether a node holds the article, or most of what the page says."""
        if id(node) in self.above_article:
            return True
        share = self.text[id(node)] / self.whole
        if id(node) in self.above_headline and share >= 0.5:
            return True
        return share >= 0.8 and not words & NEVER_MAIN and (inside or self.article is None)

    def is_section(self, node: Node) -> bool:
        return self.text[id(node)] >= 80 and 4 * self.links[id(node)] < self.text[id(node)]

    def is_comments(self, node: Node) -> bool:
        """Repeated items, each with an author and a date, beside a text that is not among them."""
        items = [p for p in node.parts if isinstance(p, Node) and p.tag in ("li", "div", "article", "section", "dd")]
        if len(items) < 2 or id(node) in self.above_article or id(node) in self.above_headline or self.text[id(node)] >= 0.95 * self.whole:
            return False
        return len({p.tag for p in items}) == 1 and all(self.signed[id(p)] == (True, True) for p in items)


def _set_aside(node: Node, inside: bool, page: _Page) -> bool:
    if node.tag in ASIDE_ELEMENTS or node.tag == "header" and not inside:
        return True
    if node.tag in ("html", "body", "main", "article") and not (inside and node.tag == "article"):
        return False
    own = _attributes(node)
    role = own.get("role", "").lower()
    if own.get("aria-hidden", "").lower() == "true" or _hidden(node, own):
        return True
    words = _aside_words(own)
    if node.tag == "form" or role in ASIDE_ROLES or words:
        topic = node.tag != "form" and role not in ASIDE_ROLES and inside and words <= TOPICS
        return not (page.is_main(node, words, inside) or topic and page.is_section(node))
    return page.is_comments(node)


def prune(root: Node) -> None:
    """Take out what is not the article, in place."""
    page = _Page(root)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main") or bool(_entry_names(node))
        node.parts = [p for p in node.parts if isinstance(p, str) or not _set_aside(p, inside, page)]
        todo.extend((p, inside) for p in node.parts if isinstance(p, Node))


def _entry_names(node: Node) -> set[str]:
    """Whole names that an article goes by; a layout around it has longer ones."""
    if not node.attributes or node.tag in ("html", "body"):
        return set()
    own = _attributes(node)
    return {*own.get("class", "").lower().split(), own.get("id", "").lower()} & {"article", "post", "entry", "story"}


def blocks(node: Node, without: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks under a node, in page order; white space inside a block is one space."""
    found: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            found.append(text)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            line.append(part)
        elif id(part) in without:
            end()
        elif part.tag == "br":
            line.append(" ")
        elif part.tag in BLOCKS:
            end()
            todo.append(None)
            todo.extend(reversed(part.parts))
        else:
            todo.extend(reversed(part.parts))
    end()
    return found


def _sizes(root: Node) -> dict[int, tuple[int, int]]:
    """Characters, and characters inside links, under every node."""
    sizes: dict[int, tuple[int, int]] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        children = [p for p in node.parts if isinstance(p, Node)]
        if not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in children)
            continue
        size = sum(len(_SPACE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str)) + sum(sizes[id(c)][0] for c in children)
        links = size if node.tag == "a" else sum(sizes[id(c)][1] for c in children)
        sizes[id(node)] = (size, links)
    return sizes


def _own_text(node: Node) -> str:
    """Text of a node outside the blocks under it."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif part.tag not in BLOCKS:
            todo.extend(reversed(part.parts))
    return _SPACE.sub(" ", "".join(out)).strip()


def _score(root: Node) -> list[Node]:
    scored: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        todo.extend(p for p in node.parts if isinstance(p, Node))
        text = _own_text(node) if node.tag in BLOCKS or node is root else ""
        if not text:
            continue
        points = 1.0 + len(re.findall(r"[,،、，]", text)) + min(len(text) // 100, 3)
        if node.tag in HEADINGS:
            points = min(points, 1.0)
        # a container holding bare text is a paragraph and a container at once
        above = node if node.tag not in ("p", "pre", "blockquote", "li", "dd", "dt", "td", "th") and node.tag not in HEADINGS else node.parent
        depth = 0
        while above is not None:
            if not above.scored:
                above.scored = True
                scored.append(above)
                own = _attributes(above)
                above.score += 25 if above.tag in ("article", "main") else 5 if _words(own) & ARTICLE_WORDS else 0
            above.score += points / (1, 2)[depth] if depth < 2 else points / (3 * depth)
            above, depth = above.parent, depth + 1
    return scored


def _article_of(node: Node) -> Node:
    """The nearest article above a node or itself, else the nearest main element, else the node."""
    for tag in ("article", "main"):
        above: Node | None = node
        while above is not None:
            if above.tag == tag:
                return above
            above = above.parent
    return node


def _link_lists(root: Node, best: Node, sizes: dict[int, tuple[int, int]]) -> frozenset[int]:
    """Containers under a node of which links are at least half the text, except those around the best one."""
    around, found, todo = set(), set(), [root]
    node: Node | None = best
    while node is not None:
        around.add(id(node))
        node = node.parent
    while todo:
        part = todo.pop()
        size, links = sizes[id(part)]
        if part.tag in LINK_CONTAINERS and links and 2 * links >= size and id(part) not in around:
            found.add(id(part))
        elif part is not best:
            todo.extend(p for p in part.parts if isinstance(p, Node))
    return frozenset(found)


def main_blocks(html: str) -> list[str]:
    """Blocks of a page's main text, in page order; none if it has no text."""
    root = parse(html)
    prune(root)
    scored = _score(root)
    if not scored:
        return []
    sizes = _sizes(root)
    density = lambda n: sizes[id(n)][1] / max(sizes[id(n)][0], 1)
    final = {id(n): n.score * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: (final[id(n)], -sizes[id(n)][0]))
    if best.parent is None:
        return blocks(best)
    least = max(10.0, 0.2 * final[id(best)])
    found: list[str] = []
    whole = _article_of(best)
    for part in whole.parent.parts:
        if part is whole:
            found += blocks(part, _link_lists(part, best, sizes))
        elif isinstance(part, Node):
            size, links = sizes[id(part)]
            alike = part.scored and final[id(part)] >= least
            plain = part.tag in PROSE and density(part) < 0.25
            prose = plain and (size > 80 or size > 0 and links == 0 and (part.tag == "pre" or re.search(r"[.!?](\s|$)", " ".join(blocks(part)))))
            headline = part.tag in HEADINGS and density(part) < 0.25
            if alike or prose or headline:
                found += blocks(part)
    return found


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html or ""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) per row of `pages`.

    Blocks are joined by an empty line, character references decoded.  Null or empty html, and pages
    without text, give an empty text; ids and urls may be null or repeat; other columns are dropped.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
