"""HTML main-text extraction by inferred wrappers (union-free regular expressions).

1. Every page is read into a tree of block elements. An element's children are a token
   stream; equal neighbours, and equal groups of neighbours, are folded into repeats.
2. Pages of a host are aligned one after the other with the host's wrapper so far: the
   streams of matching elements are aligned by longest common subsequence, what matches is
   merged, what is missing on either side becomes optional, what occurs more than once in
   a row becomes a repeat, and texts become slots. The result is a union-free regular
   expression per host, such as ``<body><nav>..</nav>(<div.ad>#</div>)?<article><h1>#</h1>
   (<p>#</p>)+</article></body>``. A slot keeps how much text it held, how much of it in
   links, and the texts that all pages have in it.
3. Wrappers are built over all pages: partial ones in each task, merged by host in two
   steps, so a host with a third of the pages is folded before it is shuffled. Element
   labels come from a fixed set, which bounds a wrapper's size by the pages' depth; the
   common texts only get fewer with more pages.
4. The wrapper decides what is read: the region of the article is the host's article or
   main element if texts vary there, else its body. All text in an article or main element
   is read. In a body, texts that all pages of the host repeat in a slot are its template
   and not read. Tags and marks (menus, adverts, notices, comments, ..) and slots that hold
   mostly links are left out as a further hint, unless they hold the article themselves.
5. Each page's streams are matched to its host's wrapper, and the page's texts are read by
   the verdicts of the slots that they fall in.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Generator, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import persisted, small
from ledgerlens.llm.html_tree import BLOCKS, SILENT, Node, tree
from ledgerlens.llm.url_filter import url_parts

#: A slot outside an article whose text is in links to this share is a menu.
LINK_SHARE = 0.6
#: Longest group of neighbours that is folded into a repeat.
GROUP = 4
SALTS = 32
#: Hosts whose wrappers are sent to every task; more are joined by host.
HOSTS = 2_000
#: Wrappers that a task holds ready to read with.
READ = 256
#: Pages with more than this share of their text in common may be copies of one page: what
#: they share is no template then.
COPIES = 0.75
#: Rows of an alignment that are kept at a time.
KEPT_ROWS = 512
#: Marks with which an article element is not the article but an advert, a card, a comment.
ASIDE = ("ad", "side", "comments")

# A wrapper element is [label, items]; an item is [element, least, most]. A text slot is
# the element ["#", [characters, characters in links, texts, pages]]: ``texts`` are the digests
# and lengths of the texts that all of its pages have in it, ``pages`` is their number. A
# group is ["()", items]. The root has a third member, [pages, characters]. Trees are walked
# without recursion: ``_run`` keeps the generators that wait for a part on a list, so any
# depth will do.


def _run(call: Generator):
    waiting, value = [call], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


def _plain(texts: list[str]) -> str:
    return " ".join("".join(texts).split())


def _digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _page(root: Node) -> list:
    """[1, characters] of the page's texts outside links, adverts, comments and the like:
    pages that differ only there are copies. A page of nothing else counts whole."""
    for hidden in (_passing, _silent, None):
        texts, todo = [], [root]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                if not (hidden and x[1]):
                    texts.append(x[0])
            elif not (hidden and hidden(x.label)):
                todo += reversed(x.items)
        text = _plain(texts)
        if text:
            return [1, len(text) - text.count(" ")]
    return [1, 0]


def _signature(element: list) -> str:
    label, items = element[:2]
    return "(" + " ".join(_signature(i[0]) for i in items) + ")" if label == "()" else label


def skeleton(node: Node) -> list:
    """The wrapper of one page."""
    return [*_run(_skeleton(node)), _page(node)]


def _skeleton(node: Node) -> Generator:
    items: list = []
    texts: list[str] = []
    chars = linked = 0
    for x in [*node.items, None]:
        if isinstance(x, tuple):
            n = len(x[0]) - x[0].count(" ")
            chars, linked = chars + n, linked + n * x[1]
            texts.append(x[0])
            continue
        text = _plain(texts) if chars else ""
        if text:
            items.append([["#", [chars, linked, {_digest(text): len(text) - text.count(" ")}, 1]], 1, 1])
        texts, chars, linked = [], 0, 0
        if x is not None:
            items.append([(yield _skeleton(x)), 1, 1])
    return [node.label, fold(items)]


def fold(items: list) -> list:
    """Equal neighbours, and equal groups of up to ``GROUP`` neighbours, as repeats."""
    out: list = []
    for item in items:
        out.append(item)
        if len(out) > 1 and _signature(out[-2][0]) == _signature(item[0]):
            out[-2:] = [_join_repeat(out[-2], item)]
    for size in range(2, GROUP + 1):
        out = _fold_groups(out, size)
    return out


def _join_repeat(a: list, b: list) -> list:
    return [_run(_merge(a[0], b[0], True)), a[1] + b[1], a[2] + b[2]]


def _fold_groups(items: list, size: int) -> list:
    out, i = [], 0
    while i < len(items):
        names = [_signature(x[0]) for x in items[i:i + size]]
        times = 1
        while len(names) == size and names == [
                _signature(x[0]) for x in items[i + times * size:i + (times + 1) * size]]:
            times += 1
        if times == 1 or len(set(names)) == 1:
            out.append(items[i])
            i += 1
            continue
        body = items[i:i + size]
        for t in range(1, times):
            other = items[i + t * size:i + (t + 1) * size]
            body = [[_run(_merge(a[0], b[0], True)), min(a[1], b[1]), max(a[2], b[2])]
                    for a, b in zip(body, other)]
        out.append([["()", body], times, times])
        i += times * size
    return out


def merge(a: list, b: list) -> list:
    """The wrapper that covers two elements of one label."""
    return _run(_merge(a, b))


def _merge_slots(a: list, b: list, same: bool) -> list:
    """What both have stays common; within the same page the texts of a repeat add up."""
    texts = {**a[2], **b[2]} if same else {t: n for t, n in a[2].items() if t in b[2]}
    return [a[0] + b[0], a[1] + b[1], texts, a[3] if same else a[3] + b[3]]


def _merge(a: list, b: list, same: bool = False) -> Generator:
    if a[0] == "#":
        return ["#", _merge_slots(a[1], b[1], same)]
    out = [a[0], (yield _align(a[1], b[1], same))]
    if len(a) > 2 and len(b) > 2:
        out.append([a[2][0] + b[2][0], a[2][1] + b[2][1]])
    return out


def alignment(x: list[str], y: list[str]) -> Iterator[int]:
    """Steps of a longest common subsequence from the front: 0 takes an item of both, -1 one
    of ``x``, 1 one of ``y``.

    Row i of the usual table, the lengths for ``x[i:]`` against every end of ``y``, is kept
    as one number: bit k is clear where the length grows by the k-th item from y's end. A
    row comes from the next one in a few operations on whole numbers (Hyyrö's recurrence).
    Only every ``KEPT_ROWS``-th row is kept, those between are computed again on the way.
    """
    n, m = len(x), len(y)
    full, where = (1 << m) - 1, {}
    for k, label in enumerate(reversed(y)):
        where[label] = where.get(label, 0) | 1 << k

    def above(row: int, label: str) -> int:
        hit = row & where.get(label, 0)
        return (row + hit | row - hit) & full

    kept, row = {n: full}, full
    for i in range(n - 1, 0, -1):
        row = above(row, x[i])
        if i % KEPT_ROWS == 0:
            kept[i] = row
    block: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        """Of the longest common subsequence of x[i:] and y[j:]."""
        return m - j - (block[i] & (1 << m - j) - 1).bit_count()

    i = j = 0
    while i < n and j < m:
        if x[i] == y[j]:
            yield 0
            i, j = i + 1, j + 1
            continue
        if i not in block or i + 1 not in block:
            first = i // KEPT_ROWS * KEPT_ROWS
            last = min(n, first + KEPT_ROWS)
            block = {last: kept[last]}
            for k in range(last - 1, first - 1, -1):
                block[k] = above(block[k + 1], x[k])
        if length(i + 1, j) >= length(i, j + 1):
            yield -1
            i += 1
        else:
            yield 1
            j += 1
    yield from [-1] * (n - i) + [1] * (m - j)


def _align(a: list, b: list, same: bool) -> Generator:
    """Two item streams as one: matches merged, the rest optional."""
    x, y = [_signature(i[0]) for i in a], [_signature(i[0]) for i in b]
    if x == y:
        out = []
        for p, q in zip(a, b):
            out.append([(yield _merge(p[0], q[0], same)), min(p[1], q[1]), max(p[2], q[2])])
        return out
    out, i, j = [], 0, 0
    for step in alignment(x, y):
        if step == 0:
            out.append([(yield _merge(a[i][0], b[j][0], same)), min(a[i][1], b[j][1]), max(a[i][2], b[j][2])])
            i, j = i + 1, j + 1
        elif step < 0:
            out.append([a[i][0], 0, a[i][2]])
            i += 1
        else:
            out.append([b[j][0], 0, b[j][2]])
            j += 1
    # neighbours that became equal fold into one repeat, which keeps wrappers small
    settled: list = []
    for item in out:
        if settled and _signature(settled[-1][0]) == _signature(item[0]):
            last = settled[-1]
            settled[-1] = [(yield _merge(last[0], item[0], same)), min(last[1], item[1]), max(last[2], item[2])]
        else:
            settled.append(item)
    return settled


def expression(element: list) -> str:
    """The wrapper as a regular expression over tags and text slots (``#``)."""
    return _run(_expression(element))


def _expression(element: list) -> Generator:
    label, items = element[:2]
    if label == "#":
        return "#"
    body = ""
    for inner, least, most in items:
        one = yield _expression(inner)
        sign = {(1, 1): "", (0, 1): "?"}.get((min(least, 1), min(most, 2)), "*" if least == 0 else "+")
        if sign:
            one = f"{one}{sign}" if inner[0] == "()" else f"({one}){sign}"
        body += one
    return f"({body})" if label == "()" else f"<{label}>{body}</{label.partition('.')[0]}>"


def dumps(element: list) -> str:
    """JSON of an element of any depth: its parts one after the other, not inside each other."""
    out: list = []
    todo = [[element, 1, 1]]
    while todo:
        (label, items, *rest), least, most = todo.pop()
        out += [label, least, most, rest, items if label == "#" else len(items)]
        if label != "#":
            todo += reversed(items)
    return json.dumps(out, separators=(",", ":"))


def loads(text: str) -> list:
    parts = json.loads(text)
    top: list = []
    todo = [(top, 1)]
    for at in range(0, len(parts), 5):
        label, least, most, rest, items = parts[at:at + 5]
        while len(todo[-1][0]) == todo[-1][1]:
            todo.pop()
        inner = items if label == "#" else []
        todo[-1][0].append([[label, inner, *rest], least, most])
        if label != "#":
            todo.append((inner, items))
    return top[0][0]


def _silent(label: str) -> bool:
    return label.partition(".")[0] in SILENT


def _dropped(label: str) -> bool:
    """Whether the hints say that an element is not the article."""
    tag, _, mark = label.partition(".")
    if tag == "article":
        return mark in ASIDE
    return tag in SILENT or bool(mark) and tag not in ("body", "html", "main")


def _passing(label: str) -> bool:
    """Silent elements, and marked ones that may differ between copies of a page."""
    tag, _, mark = label.partition(".")
    return tag in SILENT or mark in (*ASIDE, "notice") and tag not in ("body", "html", "main")


def _told(wrapper: list) -> bool:
    """Whether texts that all pages share are the host's template. Of pages that have nearly
    all their text in common it cannot be told: they may be copies of one."""
    times, chars = wrapper[2]
    for hidden in (_passing, _silent):
        shared, todo, any_text = 0, [wrapper], False
        while todo:
            label, items = todo.pop()[:2]
            if label == "#":
                any_text = True
                shared += sum(items[2].values()) if items[3] == times else 0
            elif not hidden(label):
                todo += [i[0] for i in items]
        if any_text:
            break
    return shared * times <= COPIES * chars


class Place(NamedTuple):
    """Where a slot stands: inside an article or main element or not, and between which of
    them a marked element stands. ``aside`` is an article that is an advert, a card or a
    comment by its own mark, or one of several in a marked element."""

    marked: bool = False
    many: bool = False
    main: bool = False
    main_in_marked: bool = False
    marked_in_main: bool = False
    article: bool = False
    article_in_marked: bool = False
    marked_in_article: bool = False
    aside: bool = False

    def inside(self, label: str, most: int) -> Place:
        tag, _, mark = label.partition(".")
        here = self
        if self.marked and most > 1:
            here = here._replace(many=True)
        if tag == "main" and not self.main:
            return here._replace(main=True, main_in_marked=self.marked, marked_in_main=False)
        if tag == "article" and not self.article:
            here = here._replace(article=True, article_in_marked=self.marked, marked_in_article=False,
                                 aside=mark in ASIDE or here.many)
            return here._replace(marked=True, marked_in_main=True) if mark in ASIDE else here
        if _dropped(label):
            return here._replace(marked=True, marked_in_main=True, marked_in_article=True,
                                 many=here.many or most > 1)
        return here

    def regions(self) -> set[str]:
        out = set()
        if self.article and not self.marked_in_article:
            out.add("aside" if self.aside else "marked" if self.article_in_marked else "article")
        if self.main and not self.marked_in_main:
            out.add("marked" if self.main_in_marked else "main")
        if not self.marked:
            out.add("page")
        return out


def article_slots(wrapper: list) -> list:
    """The wrapper with a verdict in each slot, [level, texts]: texts of level 0 are the
    article; pages without any are read from level 1 (articles in marked elements) or
    level 2 (the rest of the page), whichever holds more; level 3 is never read. ``texts``
    are the template's, none in article or main elements. An element's third member is its
    least level.

    The article is where text varies: in the host's article elements, else in its main
    elements or the page less what is marked, else in marked elements. A marked element
    that holds a host's only article or main element is read if more varies in it than in
    the rest.
    """
    pages, told = wrapper[2][0], _told(wrapper)
    found: list = []

    def walk(element: list, most: int, place: Place) -> Generator:
        label, items = element[:2]
        if label == "#":
            chars, linked, texts, times = items
            if not told or times < pages:
                texts = {}
            menu = chars > 0 and linked / chars >= LINK_SHARE
            slot = ["#", [3, sorted(texts)]]
            found.append((slot, place.regions(), max(0, chars - times * sum(texts.values())), menu))
            return slot
        if _silent(label):
            return [label, [], 3]
        if label != "()":
            place, most = place.inside(label, most), 1
        out = []
        for inner, least, n in items:
            out.append([(yield walk(inner, max(most, n), place)), least, n])
        return [label, out, 3]

    out = _run(walk(wrapper, 1, Place()))
    size = Counter()
    for _, regions, varying, menu in found:
        for r in regions:
            size[r] += varying if r in ("article", "main") or not menu else 0
    if size["article"]:
        chosen = "article"
    else:
        rest = "main" if size["main"] else "page"
        chosen = "marked" if size["marked"] > size[rest] else rest
        if not size[chosen]:
            chosen = "aside" if size["aside"] else ""
    for slot, regions, _, menu in found:
        if chosen in regions or not chosen:
            slot[1][0] = 3 if menu and chosen in ("page", "") else 0
            if chosen not in ("page", ""):
                slot[1][1] = []
        elif not menu and regions & {"marked", "page"}:
            slot[1][0] = 1 if "marked" in regions else 2
    _run(_levels(out))
    return out


def _levels(element: list) -> Generator:
    if element[0] == "#":
        return element[1][0]
    for inner, _, _ in element[1]:
        element[2] = min(element[2], (yield _levels(inner)))
    return element[2]


def _places(items: list, group: tuple[int, int] | None = None, at: int = 0) -> Iterator[tuple]:
    """(element, span of the outermost group around it) of each place in a stream."""
    for inner, _, _ in items:
        if inner[0] == "()":
            n = _width(inner)
            yield from _places(inner[1], group or (at, at + n), at)
            at += n
        else:
            yield inner, group
            at += 1


def _width(element: list) -> int:
    return sum(_width(i[0]) for i in element[1]) if element[0] == "()" else 1


class Stream:
    """Matches a page's stream, item by item, to a wrapper's: each item goes to the first
    place of its label that is not before the last one's, or again in the group there."""

    __slots__ = ("places", "by_label", "at")

    def __init__(self, element: list) -> None:
        if len(element) == 3:
            places = list(_places(element[1]))
            by_label: dict[str, list[int]] = {}
            for i, (inner, _) in enumerate(places):
                by_label.setdefault(inner[0], []).append(i)
            element.append((places, by_label))
        self.places, self.by_label = element[3]
        self.at = 0

    def next(self, label: str) -> list | None:
        ways = self.by_label.get(label)
        if not ways:
            return None
        i = bisect_left(ways, self.at)
        start, end = self.places[self.at][1] or (0, 0)
        if start < end and (i == len(ways) or ways[i] >= end):
            again = bisect_left(ways, start)
            if ways[again] < self.at:
                i = again
        self.at = ways[min(i, len(ways) - 1)]
        return self.places[self.at][0]


def _read(root: Node, wrapper: list) -> Iterator[tuple[int, str] | None]:
    """(level, text) of the page's texts by the slots they fall in; None ends a block, and
    level -1 are spaces."""
    todo: list = [(root, wrapper, 3)]
    while todo:
        x = todo.pop()
        if not isinstance(x, tuple):
            yield None
            continue
        node, element, level = x
        if isinstance(node, str):
            yield level, node
            continue
        # what the wrapper does not know is read like the element around it, by the hints
        if _silent(node.label) or (element[2] == 3 if element else _dropped(node.label)):
            continue
        level = element[2] if element else level
        stream = Stream(element) if element else None
        inner: list = []
        texts: list[str] = []
        for y in [*node.items, None]:
            if isinstance(y, tuple):
                texts.append(y[0])
                continue
            text = "".join(texts)
            if text and not text.strip():
                inner.append((text, None, -1))
            elif text:
                slot = stream.next("#") if stream else None
                if not (slot and slot[1][1] and _digest(_plain(texts)) in slot[1][1]):
                    inner.append((text, None, slot[1][0] if slot else level))
            texts = []
            if y is not None:
                inner.append((y, stream.next(y.label) if stream else None, level))
        tag, _, mark = node.label.partition(".")
        todo += reversed(inner if mark and tag not in BLOCKS else [None, *inner, None])


def _blocks(parts: list, level: int) -> str:
    blocks: list[str] = []
    line: list[str] = []
    for part in parts:
        if part is not None:
            if part[0] in (level, -1):
                line.append(part[1])
            continue
        text = _plain(line)
        if text:
            blocks.append(text)
        line = []
    return "\n".join(blocks)


def extract(page: str | None, slots: list) -> str:
    """The article of a page: its blocks' texts joined by line breaks. A page without the
    host's article is read from an article in a marked element or from the rest of the
    page, less menus and marked elements."""
    parts = [*_read(tree(page), slots), None]
    return _blocks(parts, 0) or max(_blocks(parts, 2), _blocks(parts, 1), key=len)


# --- operator ---------------------------------------------------------------------------

def _fold_wrappers(rows: Iterator[tuple[str, list]], limit: int = 2000) -> Iterator[dict[str, list]]:
    """Wrappers by host, given out whenever ``limit`` hosts are held."""
    held: dict[str, list] = {}
    for host, wrapper in rows:
        held[host] = merge(held[host], wrapper) if host in held else wrapper
        if len(held) >= limit:
            yield held
            held = {}
    yield held


def _batch(held: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array([dumps(w) for w in held.values()], pa.string())],
        ["host", "wrapper"])


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper) over all pages; the wrapper is JSON (see ``expression``)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, skeleton(tree(p))) for b in batches
                for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for held in _fold_wrappers(rows):
            yield _batch(held)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, loads(w)) for b in batches
                for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        last, now = None, None
        for host, wrapper in rows:  # sorted by host
            if host == last:
                now = merge(now, wrapper)
                continue
            if now is not None:
                yield _batch({last: now})
            last, now = host, wrapper
        if now is not None:
            yield _batch({last: now})

    schema = "host string, wrapper string"
    host, _ = url_parts(F.col(url))
    parts = pages.select(host.alias("host"), html).mapInArrow(partial, schema)
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.repartition("host", "_salt").sortWithinPartitions("host", "_salt", "wrapper").select(
        "host", "wrapper").mapInArrow(combine, schema)
    return once.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(combine, schema)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Edge cases: null and empty pages have the empty text; a null URL has the empty host,
    whose pages share a wrapper; repeated rows come back one by one; pages that end
    within a tag, script or comment are read up to there; elements may be nested to any
    depth; an empty table gives an empty result; other columns play no part.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [dumps(article_slots(loads(w))) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.string())], ["_host", "_slots"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            texts = []
            for p, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if s not in held:
                    if len(held) >= READ:
                        held.clear()
                    held[s] = loads(s)
                texts.append(extract(p, held[s]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slots = small(persisted(wrappers(pages, url, html).mapInArrow(judge, "_host string, _slots string")), HOSTS,
                  F.length("_slots"))
    host, _ = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        host.alias("_host")).join(slots, "_host")
    id_type = pages.schema[page_id].dataType.simpleString()
    return rows.select("page_id", "url", "html", "_slots").mapInArrow(
        read, f"page_id {id_type}, url string, text string, n_chars long")
