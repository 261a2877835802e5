"""A tolerant reader of HTML: a page as a tree of block elements and texts."""

from __future__ import annotations

import html
import re
from collections import defaultdict

#: Elements that end a line of text (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody tfoot thead tr ul caption".split())
#: Elements whose text is never prose.
SILENT = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map form button "
    "select textarea input datalist dialog nav header footer aside menu search".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
SPACES = frozenset("br td th".split())

#: Words in class, id or role that mark what is not the article (fixed values).
MARKS = re.compile(
    r"(?:^|[\s_-])(?:(ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner)|"
    r"(menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|toc|tabs|share|sharing|social)|"
    r"(header|masthead|footer|contentinfo|copyright|colophon)|"
    r"(sidebar\w*|aside|complementary|widgets?|related\w*|recommended)|"
    r"(notices?|cookies?|consent|gdpr|alerts?|popup\w*|modal|overlay|newsletter|subscribe\w*|signup|login|search)|"
    r"(comments?|commentlist|disqus|respond|replies|discussion))(?=$|[\s_-])", re.I)
_MARK_NAMES = ("ad", "menu", "edge", "side", "notice", "comments")

#: A class with one of these words before others, or one of the next at its end, says how
#: the page is laid out or set (fixed values): no-sidebar, content-with-nav, comments-open.
_LAYOUT = frozenset("no has have with without not".split())
_STATES = frozenset("open closed enabled disabled on off".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRS = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]+))?")
_ENDED = re.compile(r"(?:^|[\s\"'])/\s*$")
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements that a new block of the same kind, or any block for p, closes by itself.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"},
           "body": {"head"}}
_WALLS = frozenset("ul ol dl table div section article main body aside nav form blockquote".split())


class Node:
    """An element: its label, its children (nodes and texts), and its link characters."""

    __slots__ = ("label", "items")

    def __init__(self, label: str) -> None:
        self.label = label
        self.items: list = []


def _layout(word: str) -> bool:
    parts = [p for p in re.split("[_-]+", word.lower()) if p]
    return len(parts) > 1 and (not _LAYOUT.isdisjoint(parts[:-1]) or parts[-1] in _STATES)


def label_of(tag: str, attrs: str) -> str:
    """The tag, and what its class, id or role say it is: ``div.ad``, ``div.comments``."""
    if attrs:
        for m in _ATTR.finditer(attrs):
            value = m.group(2) or m.group(3) or m.group(4) or ""
            found = MARKS.search(value)
            if found:
                found = MARKS.search(" ".join(w for w in value.split() if not _layout(w)))
            if found:
                return f"{tag}.{_MARK_NAMES[found.lastindex - 1]}"
            if m.group(1).lower() == "role" and value.lower() == "main":
                return "main"
    return tag


def is_link(attrs: str) -> bool:
    """Whether an opened ``a`` is a link: not if it ends itself, or is a named place."""
    if _ENDED.search(attrs):
        return False
    names = {m.group(1).lower() for m in _ATTRS.finditer(attrs)}
    return "href" in names or names.isdisjoint(("name", "id"))


def tokens(page: str):
    """('text', text), ('open', tag, attributes) and ('close', tag) in page order."""
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            yield "close", tag, ""
            continue
        yield "open", tag, m.group(3)
        if tag in RAW:  # up to its end tag, whatever stands between
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if stop is None:
                return
            yield "raw", page[at:stop.start()], ""
            yield "close", tag, ""
            at = stop.end()


def tree(page: str | None) -> Node:
    """The page's block elements as a tree; a text item is (text, whether in a link).

    Inline elements leave only their text; silent elements and marked inline ones keep
    a node of their own, so that their text stays apart. Missing end tags are closed where
    a block of the same kind, any block after p, or the parent's end closes them. A link
    ends at its end tag, at the next ``a``, or with the element that it was opened in.
    """
    root = Node("#page")
    stack: list[tuple[str, Node]] = [("#page", root)]
    at: dict[str, list[int]] = defaultdict(list)  # where the open elements of each tag stand
    walls: list[int] = [0]
    link = 0  # the stack's height where the open link began

    def cut(height: int) -> None:
        nonlocal link
        while len(stack) > height:
            tag, _ = stack.pop()
            at[tag].pop()
            if tag in _WALLS:
                walls.pop()
        if height < link:
            link = 0

    for kind, value, attrs in tokens(page or ""):
        if kind == "raw":
            continue
        if kind == "text":
            text = html.unescape(value)
            if text:
                stack[-1][1].items.append((text, link > 0))
        elif kind == "open":
            if value in SPACES:
                stack[-1][1].items.append((" ", False))
            if value == "a":
                link = len(stack) if is_link(attrs) else 0
            if value in VOID:
                if value == "hr":
                    stack[-1][1].items.append(Node("hr"))
                continue
            if value in BLOCKS:
                # p ends at any block, list items and cells at the next of their kind
                last = max((at[t][-1] for t in _CLOSES.get(value, set()) | {"p"} if at[t]), default=0)
                if last > walls[-1]:
                    cut(last)
            label = label_of(value, attrs)
            if value in BLOCKS or value in SILENT or "." in label:
                node = Node(label)
                stack[-1][1].items.append(node)
                at[value].append(len(stack))
                if value in _WALLS:
                    walls.append(len(stack))
                stack.append((value, node))
        elif value == "a":
            link = 0
        elif at[value]:
            if value in BLOCKS or at[value][-1] >= walls[-1]:
                cut(at[value][-1])
        elif value == "p":
            stack[-1][1].items.append(Node("hr"))
    return root
