"""Main text of web pages, by wrappers inferred from the pages of a host.

A wrapper is a union-free regular expression over the markup: a tree of containers and text slots, in which a node can
be repeated (+) or optional (?). Every page is folded into such a tree first: adjacent copies become one repeated
node. Trees of a host are then aligned one after the other; what only one of them has becomes optional, what is there
once or many times becomes repeated, and slots that meet join what they have seen. A slot then tells how much text it
has held, how much of it in links, and whether it was the same on all pages: that decides what is the template, which
container holds the article, and whether a container that is called noise is noise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small, written
from tessera.llm.lines import url_host

#: A slot with one and the same text on so many different pages is template.
CONSTANT_PAGES = 4
#: Containers in each other that are told apart; what lies deeper belongs to the last of them.
DEPTH = 60
#: Longest group of different siblings that is folded as a repetition.
PERIOD = 4
#: Trees that one task aligns with each other before their wrapper goes to the next round.
FAN = 64
#: Forms of pages that a task holds before it passes them on.
HELD_FORMS = 2_000
#: Nodes of a wrapper up to which each task of a host has as many pages as it is asked for, and characters of a node. A larger
#: wrapper goes whole to tasks of more pages in proportion, so that its copies don't outgrow the pages.
MOST_NODES, NODE_CHARS = 4_000, 80
#: Sibling lists whose lengths have a greater product are aligned by their longest common sequence of labels, by bits; and that product from which a sequence is found by halves.
LONG, HALVED = 1_000_000, 1 << 28
#: Up to this product of their numbers siblings without one and the same text are aligned by likeness; and the share of signs that unlabelled containers must have in common.
CLOSE, ALIKE = 4096, 0.34
#: Share of the running text from which a container is the article's, with a mark and without; and from which one that is called noise isn't.
MARKED, UNMARKED, CLAIMED, NOT_NOISE = 0.5, 0.7, 0.25, 0.5

# Elements of HTML by how they are treated.
RAW = "script|style|noscript|template|svg|math|textarea|iframe|object|select|button|title|canvas|video|audio"
CONTAINERS = frozenset("body main article section div aside nav header footer form table tbody thead tr td th ul ol dl li dd dt figure blockquote fieldset details dialog menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address figcaption summary caption legend center html head".split())
NOISE_TAGS = frozenset("nav footer aside menu dialog head".split())
#: Containers that say nothing of what they hold unless they have a label: copies beside each other aren't a repetition.
LAYOUT = frozenset("body main section div aside nav header footer form table tbody".split())
# Words in a class or id that hint at what is no article, those of reader comments apart, and at what is one.
COMMENT_WORDS = frozenset("comment comments respond disqus replies".split())
NOISE_WORDS = frozenset("nav navbar navigation menu footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs login search pagination pager widget toolbar skip copyright hidden".split())
MAIN_WORDS = frozenset("article content main post entry story".split())

TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-z][^>]*>|(?P<text>[^<]+|<)""", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: What a container's own markup says: nothing, surely noise, maybe noise, an article's element, an article's name; and a header, which is noise outside an article.
PLAIN, NOISE, MAYBE, MAIN, NAMED_MAIN, HEADER = range(6)


@dataclass(frozen=True)
class Box:
    sign: str
    kind: int


_boxes: dict[tuple[str, str], Box] = {}


def box(tag: str, rest: str) -> Box:
    """Description of an opening tag; the same markup is described once. An article's element is never noise by its
    label, and a label with words of both kinds says nothing for sure."""
    found = _boxes.get((tag, rest))
    if found is None:
        named = {k.lower(): v.strip("\"'").lower() for k, v in NAMED.findall(rest)} if rest.strip() else {}
        label = f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}"
        words = set(re.findall(r"[a-z]+", label))
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")) is not None
        if tag == "body":
            kind = PLAIN
        elif hidden or tag in NOISE_TAGS:
            kind = NOISE
        elif tag in ("article", "main") or named.get("role") == "main":
            kind = MAIN
        elif words & COMMENT_WORDS:
            kind = NOISE
        elif tag in ("form", "fieldset") or words & NOISE_WORDS:
            kind = MAYBE
        elif tag in ("div", "section") and words & MAIN_WORDS:
            kind = NAMED_MAIN
        else:
            kind = HEADER if tag == "header" else PLAIN
        found = Box(f"{tag} {re.sub(r'\d+', '0', label).strip()}".strip(), kind)
        if len(_boxes) < 20_000:
            _boxes[tag, rest] = found
    return found


@dataclass
class Block:
    text: str
    path: tuple[Box, ...]
    links: int


@dataclass
class Seen:
    """What a slot has held: pages, some of their hashes, whether its text was one and the same, characters, those in links."""

    pages: int = 0
    some: list[int] = field(default_factory=list)
    least: int = 0
    most: int = 0
    chars: int = 0
    links: int = 0

    def join(self, other: Seen) -> None:
        if self.pages and other.pages:
            self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        elif other.pages:
            self.least, self.most = other.least, other.most
        self.some = sorted({*self.some, *other.some})[:CONSTANT_PAGES]
        self.pages, self.chars, self.links = self.pages + other.pages, self.chars + other.chars, self.links + other.links

    @property
    def constant(self) -> bool:
        return self.least == self.most


@dataclass
class Node:
    """A container with children, a slot of text, or a group of siblings (no sign); `blocks`: of a slot, on one page."""

    sign: str
    kind: int = PLAIN
    children: list[Node] = field(default_factory=list)
    many: bool = False
    optional: bool = False
    seen: Seen | None = None
    blocks: list[int] = field(default_factory=list)

    @property
    def key(self) -> tuple:
        return (self.sign, self.kind, self.seen is None) if self.sign else ("", *(c.key for c in self.children))

    @property
    def shape(self) -> str:
        inner = "" if self.seen is not None else "(" + " ".join(c.shape for c in self.children) + ")"
        return f"{self.sign}{inner}{'+' if self.many else ''}{'?' if self.optional else ''}"

    @property
    def value(self) -> int | None:
        """A number for the text below, if it is the same on all pages."""
        if self.seen is not None:
            return self.seen.least if self.seen.constant else None
        inner = [c.value for c in self.children]
        return None if None in inner else hash(tuple(inner))

    def signs(self) -> set[str]:
        """Signs of what is below."""
        return {self.sign} if self.seen is not None else {"/" + c.sign for c in self.children}.union(*(c.signs() for c in self.children))

    def slots(self) -> Iterator[Node]:
        if self.seen is not None:
            yield self
        for c in self.children:
            yield from c.slots()

    def packed(self) -> list:
        return [self.sign, self.kind, int(self.many), int(self.optional), [self.seen.pages, self.seen.some, self.seen.least, self.seen.most, self.seen.chars, self.seen.links] if self.seen else [c.packed() for c in self.children], int(self.seen is not None)]


def unpacked(x: list) -> Node:
    sign, kind, many, optional, inner, slot = x
    return Node(sign, kind, [] if slot else [unpacked(c) for c in inner], bool(many), bool(optional), Seen(*inner) if slot else None)


def parse(html: str) -> tuple[list[Block], Node]:
    """Text blocks of a page in order, and its markup as a folded tree. Adjacent blocks of one tag share a slot."""
    blocks: list[Block] = []
    root = Node("page")
    path: list[Box] = []
    tags: list[str] = []
    open_nodes = [root]
    text: list[str] = []
    tag_now, anchor, links = "#", False, 0

    def end_block() -> None:
        nonlocal links
        if text:
            own = " ".join(unescape("".join(text)).split())
            if own:
                siblings = open_nodes[-1].children
                if siblings and siblings[-1].seen is not None and siblings[-1].sign == tag_now:
                    siblings[-1].blocks.append(len(blocks))
                    siblings[-1].many = True
                else:
                    siblings.append(Node(tag_now, seen=Seen(), blocks=[len(blocks)]))
                blocks.append(Block(own, tuple(path), links))
            text.clear()
        links = 0

    for m in TOKEN.finditer(html):
        if (plain := m["text"]) is not None:
            text.append(plain)
            links += len(plain) * anchor
            continue
        if m["tag"] is None:
            continue
        tag, closing = m["tag"].lower(), m["end"] == "/"
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            anchor = not closing
        elif tag in BLOCKS:
            end_block()
            tag_now = "#" if closing or tag in CONTAINERS else tag
            if tag in CONTAINERS:
                if not closing:
                    tags.append(tag)
                    if len(path) < DEPTH:
                        path.append(box(tag, m["rest"]))
                        node = Node(path[-1].sign, path[-1].kind)
                        open_nodes[-1].children.append(node)
                        open_nodes.append(node)
                elif tag in tags:
                    at = len(tags) - 1 - tags[::-1].index(tag)
                    for node in open_nodes[at + 1 :]:
                        node.children = fold(node.children)
                    del path[at:], tags[at:], open_nodes[at + 1 :]
    end_block()
    for node in open_nodes:
        node.children = fold(node.children)
    return blocks, root


# Wrappers: folding, alignment


def repeats(node: Node) -> bool:
    """Whether copies of a node beside each other are a repetition whatever they hold."""
    return node.seen is not None or not node.sign or " " in node.sign or node.sign not in LAYOUT


def fold(nodes: list[Node]) -> list[Node]:
    """Siblings with runs of copies as one repeated node each, and then runs of groups; empty containers go."""
    nodes = [x for x in nodes if x.seen is not None or x.children]
    if len(nodes) < 2:
        return nodes
    for period in range(1, PERIOD + 1):
        nodes = fold_period(nodes, period)
    return nodes


def fold_period(nodes: list[Node], period: int) -> list[Node]:
    keys = [x.key for x in nodes]
    out, i, n = [], 0, len(nodes)
    while i < n:
        end = i + period
        if all(map(repeats, nodes[i:end])):
            while end + period <= n and keys[end : end + period] == keys[i : i + period]:
                end += period
        if end == i + period:
            out.append(nodes[i])
            i += 1
            continue
        first = nodes[i] if period == 1 else Node("", children=nodes[i : i + period])
        for k in range(i + period, end, period):
            widen(first, nodes[k] if period == 1 else Node("", children=nodes[k : k + period]))
        first.many = True
        out.append(first)
        i = end
    return out


def grouped(nodes: list[Node], groups: list[Node]) -> list[Node]:
    """Siblings of which those that are one copy of one of the groups are a group too."""
    for g in groups:
        keys, out, i = [c.key for c in g.children], [], 0
        while i < len(nodes):
            if [x.key for x in nodes[i : i + len(keys)]] == keys:
                out.append(Node("", children=nodes[i : i + len(keys)]))
                i += len(keys)
            else:
                out.append(nodes[i])
                i += 1
        nodes = fold_period(out, 1)
    return nodes


def label(node: Node, how: int, mark: tuple):
    """What must be equal for two siblings to meet: constant text first, then, if they are too many to be aligned by
    likeness, the shape and at last the tag alone."""
    if how == 0:
        value = node.value
        return mark if value is None else (node.key, value)
    return (node.key, node.shape) if how == 1 else node.key


def likeness(a: Node, b: Node) -> float:
    """How much alike two siblings of equal key are; 0 for containers without a label that have little in common."""
    if a.key != b.key:
        return 0.0
    x, y = a.signs(), b.signs()
    common = len(x & y) / max(1, len(x | y))
    return 0.0 if a.sign in ("div", "section") and common < ALIKE else 0.01 + common


def alike(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Places that meet in the alignment of the greatest likeness in all."""
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    like = [[likeness(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like[i][j])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if like[i][j] and best[i][j] == best[i + 1][j + 1] + like[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def pairs(a: list[Node], b: list[Node], how: int = 0, at: int = 0, to: int = 0) -> Iterator[tuple[int, int]]:
    """Places of siblings that meet, in order on both sides."""
    if not a or not b:
        return
    if how and len(a) * len(b) <= CLOSE:
        yield from ((at + p, to + q) for p, q in alike(a, b))
        return
    one = [label(x, how, ("a", k)) for k, x in enumerate(a)]
    two = [label(x, how, ("b", k)) for k, x in enumerate(b)]
    if one == two:
        blocks = [(0, 0, len(a)), (len(a), len(b), 0)]
    elif len(a) * len(b) > LONG:
        blocks = [*((p, q, 1) for p, q in in_order(one, two)), (len(a), len(b), 0)]
    else:
        blocks = SequenceMatcher(None, one, two, autojunk=False).get_matching_blocks()
    i = j = 0
    for p, q, n in blocks:
        if how < 2:
            yield from pairs(a[i:p], b[j:q], how + 1, at + i, to + j)
        yield from ((at + p + k, to + q + k) for k in range(n))
        i, j = p + n, q + n


def in_order(one: list, two: list) -> list[tuple[int, int]]:
    """Places of a longest common sequence of two lists."""
    both = set(one) & set(two)
    p, q = ([k for k, x in enumerate(side) if x in both] for side in (one, two))
    return [(p[i], q[j]) for i, j in common([one[k] for k in p], [two[k] for k in q])]


def sums(one: list, two: list) -> Iterator[int]:
    """After each label of the first list, a number whose bit j is zero where the common sequence with the first j + 1 labels of
    the second one is longer than with j."""
    at: dict = {}
    for j, x in enumerate(two):
        at[x] = at.get(x, 0) | 1 << j
    bits = whole = (1 << len(two)) - 1
    for x in one:
        met = bits & at.get(x, 0)
        bits = ((bits + met) | (bits - met)) & whole
        yield bits


def common(one: list, two: list) -> list[tuple[int, int]]:
    n, m = len(one), len(two)
    if n > 1 and n * m > HALVED:
        cut = n // 2

        def best(a: list, b: list) -> list[int]:
            for bits in sums(a, b):
                pass
            return [0, *accumulate(int(x == "0") for x in f"{bits:0{m}b}"[::-1])]

        head, tail = best(one[:cut], two), best(one[cut:][::-1], two[::-1])
        to = max(range(m + 1), key=lambda j: head[j] + tail[m - j])
        return common(one[:cut], two[:to]) + [(cut + i, to + j) for i, j in common(one[cut:], two[to:])]
    rows, out, i, j = list(sums(one, two)), [], n, m
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append((i, j))
    return out[::-1]


def sides(a: Node, b: Node) -> None:
    """Makes a sequence that is a group on one side a group on the other, so that they can meet."""
    for x, y in ((a, b), (b, a)):
        if groups := [c for c in x.children if not c.sign]:
            y.children = grouped(y.children, groups)


def widen(wrapper: Node, other: Node) -> None:
    """Aligns another tree with a wrapper, which then matches what either has matched."""
    wrapper.many |= other.many
    wrapper.optional |= other.optional
    if wrapper.seen is not None and other.seen is not None:
        wrapper.blocks += other.blocks
        wrapper.seen.join(other.seen)
        return
    sides(wrapper, other)
    a, b = wrapper.children, other.children
    out, i, j = [], 0, 0
    for p, q in [*pairs(a, b), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x.optional = True
            out.append(x)
        if p < len(a):
            widen(a[p], b[q])
            out.append(a[p])
        i, j = p + 1, q + 1
    wrapper.children = out


def meet(wrapper: Node, page: Node) -> Iterator[tuple[list[int], Node]]:
    """Blocks of a page (a form) with the wrapper's slots that hold them; blocks at places that it doesn't have are left out."""
    if wrapper.seen is not None:
        if page.seen is not None:
            yield page.blocks, wrapper
        return
    own = grouped(page.children, [c for c in wrapper.children if not c.sign])
    for p, q in pairs(wrapper.children, own):
        yield from meet(wrapper.children[p], own[q])


def expression(node: Node) -> str:
    """The wrapper in words: containers and groups in brackets, # and the tags of blocks are slots, + and ? as usual."""
    return " ".join(c.shape for c in node.children)


def form(blocks: list[Block], root: Node) -> Node:
    """A page's tree with what its slots hold."""
    whole = xxhash.xxh64_intdigest("\n".join(b.text for b in blocks)) >> 1
    for s in root.slots():
        own = [blocks[k] for k in s.blocks]
        value = xxhash.xxh64_intdigest("\n".join(b.text for b in own)) >> 1
        s.seen = Seen(1, [whole], value, value, sum(len(b.text) for b in own), sum(min(b.links, len(b.text)) for b in own))
    return root


def infer(trees: Iterable[Node]) -> Node:
    """One wrapper for all the trees."""
    wrapper = None
    for tree in trees:
        if wrapper is None:
            wrapper = tree
        else:
            widen(wrapper, tree)
    return wrapper if wrapper is not None else Node("page")


# From wrappers to text


def template(seen: Seen, varied: bool) -> bool:
    return varied and seen.constant and len(seen.some) >= CONSTANT_PAGES


def removed(path: tuple[Box, ...], trusted: frozenset[tuple[str, ...]]) -> bool:
    """Whether a block is in noise: surely, or maybe and its container isn't known to hold the most of the text, or in
    a header outside an article."""
    inside = False
    for k, x in enumerate(path, 1):
        inside = inside or x.kind in (MAIN, NAMED_MAIN)
        if x.kind == NOISE or (x.kind == HEADER and not inside) or (x.kind == MAYBE and tuple(y.sign for y in path[:k]) not in trusted):
            return True
    return False


def weights(found: list[tuple[tuple[Box, ...], int]], kinds: tuple[int, ...] | None = None) -> dict[tuple[str, ...], int]:
    """Running text of each container, or of those of some kinds."""
    out: dict[tuple[str, ...], int] = {}
    for path, size in found:
        signs = tuple(x.sign for x in path)
        for k, x in enumerate(path, 1):
            if kinds is None or x.kind in kinds:
                out[signs[:k]] = out.get(signs[:k], 0) + size
    return out


def trusted_noise(found: list[tuple[tuple[Box, ...], int]]) -> frozenset[tuple[str, ...]]:
    """Containers that are called noise but hold most of the running text."""
    outside = [(path, size) for path, size in found if not any(x.kind == NOISE for x in path)]
    total = sum(size for _, size in outside)
    return frozenset(p for p, n in weights(outside, (MAYBE,)).items() if total and n > NOT_NOISE * total)


def region(found: list[tuple[tuple[Box, ...], int]], trusted: frozenset[tuple[str, ...]]) -> tuple[str, ...] | None:
    """Signs of the container that holds the article, from paths and their running text outside the template.

    Of those that are marked as an article, if they hold a fair share of the text, the one with most, innermost if
    that holds nearly all of it; else the innermost of all with most of the text.
    """
    good = [(path, size) for path, size in found if not removed(path, trusted)]
    whole = weights(good)
    marked = weights(good, (MAIN, NAMED_MAIN))
    if not whole or not max(whole.values()):
        return None
    claimed = marked and max(marked.values()) >= CLAIMED * max(whole.values())
    pool = marked if claimed else whole
    enough = (MARKED if claimed else UNMARKED) * max(pool.values())
    return max((p for p, n in pool.items() if n >= enough), key=lambda p: (len(p) if not claimed else (p[-1].startswith("article"), len(p)), pool[p]))


class Reader:
    """Texts of pages by the wrapper of their host."""

    def __init__(self, wrapper: Node):
        self.wrapper = wrapper
        self.varied = any(not s.seen.constant for s in wrapper.slots())
        found = [(path, self.weight(s.seen)) for path, s in self.paths(wrapper, ())]
        self.trusted = trusted_noise(found)
        self.region = region(found, self.trusted)

    def weight(self, seen: Seen) -> int:
        return 0 if template(seen, self.varied) else max(0, seen.chars - 2 * seen.links)

    def paths(self, node: Node, path: tuple[Box, ...]) -> Iterator[tuple[tuple[Box, ...], Node]]:
        for c in node.children:
            if c.seen is not None:
                yield path, c
            else:
                yield from self.paths(c, (*path, Box(c.sign, c.kind)) if c.sign else path)

    def text(self, blocks: list[Block], root: Node) -> str:
        """Blocks in the host's region, or in one of the page's own if it has nothing there, but those of the template."""
        fixed = {k for own, slot in meet(self.wrapper, form(blocks, root)) if template(slot.seen, self.varied) for k in own}
        own = [(b.path, 0 if k in fixed else max(0, len(b.text) - 2 * b.links)) for k, b in enumerate(blocks)]
        trusted, where = self.trusted, self.region
        if where is None or not any(inside(p, where) and n and not removed(p, trusted) for p, n in own):
            trusted = trusted | trusted_noise(own)
            where = region(own, trusted)
        if where is None:
            return ""
        return "\n\n".join(b.text for k, b in enumerate(blocks) if k not in fixed and inside(b.path, where) and not removed(b.path, trusted))


def inside(path: tuple[Box, ...], where: tuple[str, ...]) -> bool:
    return tuple(x.sign for x in path[: len(where)]) == where


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of a few pages of one host, as extract_pages() gives them."""
    read = [parse(html or "") for html in pages]
    forms: dict[str, Node] = {}
    for html in pages:
        add_form(forms, form(*parse(html or "")))
    reader = Reader(infer(ordered(forms)))
    return [reader.text(*x) for x in read]


def add_form(forms: dict[str, Node], tree: Node) -> None:
    shape = tree.shape
    if shape in forms:
        for mine, other in zip(forms[shape].slots(), tree.slots(), strict=True):
            mine.seen.join(other.seen)
    else:
        forms[shape] = tree


def ordered(forms: dict[str, Node]) -> list[Node]:
    """The most frequent forms first."""
    return [tree for _, tree in sorted(forms.items(), key=lambda x: (-max((s.seen.pages for s in x[1].slots()), default=0), x[0]))]


# Spark


ROWS = "host string, place bigint, tree string"


def row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "place", "tree"])


def page_forms(rows: DataFrame) -> DataFrame:
    """(host, place, tree): the different trees of the pages of `rows` (host, html) in each task, by a hash of their shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, Node]] = {}
        count = 0

        def done() -> pa.RecordBatch:
            return row_batch([(h, xxhash.xxh64_intdigest(s) >> 1, json.dumps(t.packed())) for h, forms in held.items() for s, t in forms.items()])

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                forms = held.setdefault(host, {})
                before = len(forms)
                add_form(forms, form(*parse(html.as_py() or "")))
                count += len(forms) - before
                if count >= HELD_FORMS:
                    yield done()
                    held, count = {}, 0
        if held:
            yield done()

    return rows.select("host", "html").mapInArrow(run, ROWS)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows, those with the same first columns together."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, place, tree): the wrapper of each host of `rows` (host, html), place 0.

    Forms are found where pages lie, so that what is shuffled is a row for each form of a task. A host's forms are
    aligned some FAN at a time and the wrappers again, in as many rounds as the host with most forms takes: no task
    has a host.
    """
    found = written(page_forms(rows), "wrapper-forms")
    forms = found.groupBy("host").agg(F.count_distinct("place").alias("n")).where(F.col("n") > FAN).select("host", F.ceil(F.col("n") / FAN).alias("groups"))
    forms = written(forms, "wrapper-sizes")
    most = forms.agg(F.max("groups")).first()[0] or 1

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (host, group), held in runs(batches, 2):
            together: dict[str, Node] = {}
            for _, tree in held:
                add_form(together, unpacked(json.loads(tree)))
            yield row_batch([(host, group, json.dumps(infer(ordered(together)).packed()))])

    group = F.pmod("place", F.coalesce("groups", F.lit(1)))
    now = found.join(small(forms), "host", "left").select("host", group.alias("group"), "place", "tree")
    while True:
        now = now.repartition("host", "group").sortWithinPartitions("host", "group", "place").mapInArrow(align, ROWS)
        if most <= 1:
            return now
        now = written(now, "wrapper-round").select("host", F.floor(F.col("place") / FAN).alias("group"), "place", "tree")
        most = -(-most // FAN)


def extract_pages(pages: DataFrame, host_pages: int = 256) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Pages of a host share one wrapper, however many they are. It meets them in tasks of about `host_pages` pages, by a
    salt, and comes first there, and of more pages where it has over MOST_NODES nodes; so the html is shuffled once and
    no task has a host. Null and empty html give an
    empty text; null urls are a host of their own; rows that repeat are pages each but count once where a slot's
    different pages are counted. Other columns aren't read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), url_host(F.col("url")).alias("host"))
    known = written(wrappers(rows), "wrappers")
    many = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * host_pages)
    larger = F.greatest(F.lit(1.0), F.length("tree") / (NODE_CHARS * MOST_NODES))
    many = many.join(known.select("host", larger.alias("larger")), "host")
    many = written(many.select("host", F.ceil(F.col("n") / (host_pages * F.col("larger"))).alias("groups")), "wrapper-hosts")
    groups = F.coalesce("groups", F.lit(1))
    none = F.lit(None).cast("string")
    first = known.join(small(many), "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)).alias("salt"), F.lit(0).alias("page"), F.lit(None).cast("bigint").alias("page_id"), none.alias("url"), F.col("tree").alias("html"))
    dealt = rows.join(small(many), "host", "left").select("host", F.pmod(F.xxhash64("page_id", "url"), groups).alias("salt"), F.lit(1).alias("page"), "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Node("page"))
        for batch in batches:
            page, ids, urls, html = (batch.column(k) for k in range(2, 6))
            texts: list[tuple] = []
            for k, is_page in enumerate(page.to_pylist()):
                if is_page:
                    texts.append((ids[k].as_py(), urls[k].as_py(), reader.text(*parse(html[k].as_py() or ""))))
                else:
                    reader = Reader(unpacked(json.loads(html[k].as_py())))
            cols = ([t[0] for t in texts], [t[1] for t in texts], [t[2] for t in texts], [len(t[2]) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

    both = first.unionByName(dealt).repartition("host", "salt").sortWithinPartitions("host", "salt", "page")
    return both.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
