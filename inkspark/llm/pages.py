"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. A linear classifier over a block's tags, class names, links and words gives the cost of
calling it boilerplate or content; these are the capacities from the source and to the sink. Blocks next to each other,
and blocks that follow each other under one parent, are joined by smoothness edges that weaken with their distance in the
DOM. The minimum cut is the labelling of least total cost; the source's side is the main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import bounded, chunks

_LEAD = r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|head|title|textarea|select)\b.*?(?:</(?P=raw)\s*+>|\Z)|<[!?/](?![a-zA-Z])[^>]*+(?:>|\Z)"""
_TAG = r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)"
TOKEN = re.compile(rf"""{_LEAD}|{_TAG}(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<torn></?[a-zA-Z])""", re.S | re.I)
#: Behind a quote that is never closed, quotes count no more: a tag ends at the next bracket or with the page.
LOOSE = re.compile(rf"{_LEAD}|{_TAG}(?P<attrs>[^>]*+)(?:>|\Z)", re.S | re.I)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)

# Elements by what they do to blocks, and names that tell boilerplate from content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
PROSE_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 figcaption dd".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr header "
    "login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion reactions recommended related replies reply search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("article main content post entry story".split())

#: Weights of the classifier, in nats for content. Names and elements that say what they hold weigh most; what words,
#: sentences and links say of a block is weak, and can be overruled by its neighbours.
BIAS, IN_MAIN, IN_BOILER, PROSE, LINKED, SENTENCE, WORDS, MOST_WORDS = -0.8, 3.0, -8.0, 0.5, -2.0, 0.7, 1 / 15, 2.0
#: Smoothness of neighbours at distance 0, of blocks that follow each other under one parent, and the distance in the DOM
#: beyond which it falls no further.
SMOOTH, SIBLINGS, FARTHEST = 3.0, 0.6, 8
#: Elements are nested so deep at most; deeper ones are siblings, as in browsers.
DEEPEST = 256


class Block:
    __slots__ = ("linked", "node", "parts", "prose")

    def __init__(self, node: Node, prose: bool):
        self.node, self.prose, self.parts, self.linked = node, prose, [], 0


class Node:
    __slots__ = ("boiler", "depth", "main", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, main: bool, boiler: bool):
        self.tag, self.parent, self.main, self.boiler = tag, parent, main, boiler
        self.depth = parent.depth + 1 if parent else 0


def _child(tag: str, attrs: str, parent: Node) -> Node:
    main = parent.main or tag in MAIN_TAGS
    boiler = parent.boiler or tag in BOILER_TAGS or (tag == "header" and not parent.main)
    if attrs and tag not in ("html", "body"):
        names = set()
        for m in ATTR.finditer(attrs):
            names.update(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
        if not names.isdisjoint(MAIN_NAMES):
            main = main or not boiler
        if not names.isdisjoint(BOILER_NAMES) and (names.isdisjoint(MAIN_NAMES) or not names.isdisjoint(("comment", "comments"))):
            boiler = True
    return Node(tag, parent, main, boiler)


def tokens(html: str) -> Iterator[re.Match[str]]:
    """Tags, comments and raw elements, each byte read a few times at most, whatever the quotes."""
    pattern, at = TOKEN, 0
    while m := pattern.search(html, at):
        if pattern is TOKEN and m["torn"]:
            pattern = LOOSE
            m = pattern.match(html, m.start())
        yield m
        at = m.end()


def blocks_of(html: str) -> list[Block]:
    """Stretches of text between block-level tags, in page order; empty ones are left out."""
    root = node = Node("", None, False, False)
    out: list[Block] = []
    now, links, at = None, 0, 0

    def text(piece: str) -> None:
        nonlocal now
        if piece:
            if now is None:
                now = Block(node, False)
                out.append(now)
            now.parts.append(piece)
            if links:
                now.linked += len(piece)

    opened: Counter[str] = Counter()
    for m in tokens(html):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() in ("textarea", "select"):
                now = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            now, links = None, 0
        elif tag == "a":
            links = 0 if m["close"] else 1
        if tag in VOID:
            continue
        if m["close"]:
            if not opened[tag]:
                continue
            up = node
            while up is not root and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                while node is not up.parent:
                    opened[node.tag] -= 1
                    node = node.parent
        elif not m["attrs"].endswith("/"):
            if tag not in INLINE:  # a new block ends an open paragraph; a list item ends the one before
                up = node
                while up is not root and (up.tag in INLINE or up.tag == "p" or (up.tag == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"))):
                    if up.tag not in INLINE:
                        while node is not up.parent:
                            opened[node.tag] -= 1
                            node = node.parent
                    up = up.parent
            if node.depth >= DEEPEST:
                opened[node.tag] -= 1
                node = node.parent
            node = _child(tag, m["attrs"], node)
            opened[tag] += 1
    text(html[at:])
    return [b for b in out if any(p.strip() for p in b.parts)]


def _inner(node: Node) -> Node:
    while node.parent and node.tag in INLINE:
        node = node.parent
    return node


def score(block: Block, text: str) -> float:
    node = _inner(block.node)
    words = text.count(" ") + 1
    out = BIAS + min(MOST_WORDS, WORDS * words) + LINKED * min(1.0, block.linked / max(1, sum(map(len, block.parts))))
    out += IN_MAIN * block.node.main + IN_BOILER * block.node.boiler + PROSE * (node.tag in PROSE_TAGS)
    return out + SENTENCE * (text[-1:] in ".!?…:;\"”»")


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM, FARTHEST at most."""
    steps = 0
    while a is not b and steps < FARTHEST:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        else:
            b = b.parent or b
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    homes = [_inner(b.node) for b in blocks]
    out = [(k, k + 1, SMOOTH / (1 + distance(homes[k], homes[k + 1]))) for k in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for k, home in enumerate(homes):
        key = id(home.parent)
        if (j := last.get(key)) is not None and j < k - 1:
            out.append((j, k, SIBLINGS))
        last[key] = k
    return out


class Network:
    """Arcs of a flow network; arc 2 i runs back along arc 2 i + 1."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.head: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, room in ((a, b, there), (b, a, back)):
            self.out[x].append(len(self.head))
            self.head.append(y)
            self.room.append(room)

    def levels(self, source: int) -> list[int]:
        """Steps from the source over arcs with room; -1 where none leads."""
        level, line = [-1] * len(self.out), [source]
        level[source] = 0
        for a in line:
            for arc in self.out[a]:
                b = self.head[arc]
                if level[b] < 0 and self.room[arc] > EPSILON:
                    level[b] = level[a] + 1
                    line.append(b)
        return level

    def maximum_flow(self, source: int, sink: int) -> list[int]:
        """Saturates by blocking flows over shortest paths; the levels of the last, cut network."""
        while (level := self.levels(source))[sink] >= 0:
            nth, path = [0] * len(self.out), []
            while True:
                a = self.head[path[-1]] if path else source
                if a == sink:
                    push = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= push
                        self.room[arc ^ 1] += push
                    full = next(k for k, arc in enumerate(path) if self.room[arc] <= EPSILON)
                    del path[full:]
                    continue
                while nth[a] < len(self.out[a]):
                    arc = self.out[a][nth[a]]
                    if self.room[arc] > EPSILON and level[self.head[arc]] == level[a] + 1:
                        path.append(arc)
                        break
                    nth[a] += 1
                else:
                    if not path:
                        break
                    nth[self.head[path.pop() ^ 1]] += 1
        return level


EPSILON = 1e-9


def minimum_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: node k costs |terminal[k]| when it is not on the side of its sign, a cut edge its weight.

    Maximum flow from the content terminal to the boilerplate terminal; the blocks that the first still reaches are
    content. Ties go to boilerplate.
    """
    n = len(terminal)
    source, sink, net = n, n + 1, Network(n + 2)
    for k, value in enumerate(terminal):
        if value > 0:
            net.join(source, k, value)
        elif value < 0:
            net.join(k, sink, -value)
    for a, b, weight in edges:
        net.join(a, b, weight, weight)
    return [level >= 0 for level in net.maximum_flow(source, sink)[:n]]


def graph(html: str) -> tuple[list[tuple[Block, str]], list[float], list[tuple[int, int, float]]]:
    """Blocks with their text, their terminals and their edges."""
    found = [(b, " ".join(unescape("".join(b.parts)).split())) for b in blocks_of(html)]
    found = [(b, t) for b, t in found if t]
    return found, [score(b, t) for b, t in found], edges_of([b for b, _ in found])


def main_text(html: str) -> tuple[str, int, int]:
    """The main text, the number of blocks, and how many of them it is made of."""
    found, terminal, edges = graph(html)
    label = minimum_cut(terminal, edges)
    blocks = found
    kept = [t for (_, t), ok in zip(found, label, strict=True) if ok]
    return "\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """The ``keep`` columns of pages (default: all but the html) with text, n_blocks and n_content.

    Null and empty pages give an empty text. Columns named like the new ones are replaced. Pages are read whole.
    """
    added = T.StructType.fromDDL("text string, n_blocks long, n_content long")
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, *added.names)]
    schema = T.StructType([*(pages.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "__html"):
            rows = [main_text(x or "") for x in part.column(len(keep)).to_pylist()]
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *new], names=schema.names)

    return pages.select(*keep, pages[html_col].cast("string").alias("__html")).transform(bounded).mapInArrow(run, schema)
