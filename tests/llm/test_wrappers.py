"""Wrappers: what they match, what they decide, and that neither partitions nor the size of a host change a text."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import product

import pytest

from tessera.llm import wrappers

VOCABULARY = "river stone market window garden letter winter silver morning forest bridge harbour castle meadow".split()


def prose(k: int, n: int = 12) -> str:
    return " ".join(VOCABULARY[(k * 7 + j * (3 + k % 5)) % len(VOCABULARY)] + str((k * 31 + j) % 97) for j in range(n)).capitalize() + "."


def unmarked(k: int) -> tuple[str, str]:
    """A template without any mark, with optional blocks, repeated groups and a notice inside the article; and its text."""
    sections = [(f"Part {k}.{j}", [prose(100 * k + 10 * j + i) for i in range(1 + (k + j) % 3)]) for j in range(1 + k % 3)]
    body = "".join(f"<h2>{h}</h2>" + "".join(f"<p>{p}</p>" for p in ps) for h, ps in sections)
    optional = "<div><p>Join us on Sunday in the old town hall for a talk</p></div>" if k % 2 else ""
    menu = "".join(f"<li><a href=/{m}>{m}</a></li>" for m in ("One", "Two", "Three"))
    html = f"<body><div><ul>{menu}</ul></div>{optional}<div><h1>Story {k}</h1><p>{prose(k + 5000, 20)}</p><div><p>Write to the editors if you like what you read here today</p></div>{body}</div><div><p>Printed in the town by the river, since the year of the flood</p></div></body>"
    text = [f"Story {k}", prose(k + 5000, 20), *(x for h, ps in sections for x in (h, *ps))]
    return html, "\n\n".join(text)


def test_wrapper_decides_in_an_unmarked_template(monkeypatch):
    pages = [unmarked(k) for k in range(14)]
    assert wrappers.extract([h for h, _ in pages]) == [t for _, t in pages]
    monkeypatch.setattr(wrappers, "widen", lambda wrapper, other: None)  # no alignment
    assert wrappers.extract([h for h, _ in pages]) != [t for _, t in pages]


def test_each_page_alone_differs():
    html, text = unmarked(3)
    assert wrappers.extract([html]) != [text]


ARTICLE = "".join(f"<p>{prose(k, 30)}</p>" for k in range(4))
PROBES = [f"<main class='with-sidebar'>{ARTICLE}</main>", f"<article class='post comments-open'>{ARTICLE}</article>", f"<form action=/x><div id=top><p>hello</p></div><div>{ARTICLE}</div></form>", f"<div class='content with-sidebar'>{ARTICLE}</div>", f"<article><form><input><p>Search</p></form>{ARTICLE}</article>"]


@pytest.mark.parametrize("body", PROBES)
def test_labels_never_remove_a_whole_article(body):
    html = f"<html><body><nav><a href=/>Home</a></nav>{body}<div class=comments><p>A reader says so</p></div><footer>Imprint</footer></body></html>"
    want = "\n\n".join(prose(k, 30) for k in range(4))
    assert wrappers.extract([html]) == [want]
    assert wrappers.extract([html.replace("reader", f"reader{k}").replace("river", f"river{k}") for k in range(9)]) == [want.replace("river", f"river{k}") for k in range(9)]


def test_copies_of_a_page_make_no_template():
    odd = "<body><article><h1>Same</h1><h3>only here</h3><p>same text on every copy of it</p></article></body>"
    others = [f"<body><article><h1>T{k}</h1><p>{prose(k)}</p></article></body>" for k in range(6)]
    assert wrappers.extract([*others, *[odd] * 20])[-1] == "Same\n\nonly here\n\nsame text on every copy of it"


class Stream(HTMLParser):
    """Containers and blocks of text as a string of tokens, read by another parser."""

    def __init__(self):
        super().__init__()
        self.out, self.last = [], "#"

    def handle_starttag(self, tag, attrs):
        if tag in wrappers.CONTAINERS:
            self.out.append(f"<{tag}")
        self.last = "#" if tag in wrappers.CONTAINERS else tag

    def handle_endtag(self, tag):
        if tag in wrappers.CONTAINERS:
            self.out.append(">")
        self.last = "#"

    def handle_data(self, data):
        if data.strip():
            self.out.append(self.last)


def stream(html: str) -> str:
    s = Stream()
    s.feed(html)
    return "".join(f"{x};" for x in s.out)


def regular(node) -> str:
    inner = "".join(map(regular, node.children))
    own = f"{node.sign};" if node.seen is not None else f"<{node.sign};{inner}>;" if node.sign else inner
    return f"(?:{own}){'*' if node.many and node.optional else '+' if node.many else '?' if node.optional else ''}"


def tree(html: str):
    return wrappers.form(*wrappers.parse(html))


def test_expression_matches_every_page_it_was_inferred_from():
    """All small hosts of three pages out of these bodies: the wrapper as a regular expression accepts each page."""
    bodies = ["<p>a</p>", "<h2>a</h2><p>b</p><h2>c</h2><p>d</p>", "<h2>a</h2><p>b</p>", "<ul><li>a</li><li>b<p>x</p></li></ul><p>c</p>", "<ul><li>a</li></ul>", "<div><p>a</p></div><div><h2>b</h2></div>", "<div><h2>b</h2></div><p>z</p>", "text<p>a</p><p>b</p>tail"]
    for three in product(bodies, repeat=3):
        wrapper = wrappers.infer([tree(f"<body>{b}</body>") for b in three])
        expression = "".join(map(regular, wrapper.children))
        for b in three:
            assert re.fullmatch(expression, stream(f"<body>{b}</body>")), (three, expression, stream(b))


def test_expression_has_groups():
    w = wrappers.infer([tree("<ul><li>a</li><li>b</li><li>c</li></ul><p>x</p><dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"), tree("<ul><li>a</li></ul><div>opt</div><p>y</p>")])
    assert wrappers.expression(w) == "ul(li(#)+) div(#)? p dl((dt(#) dd(#))+)?"


def test_host_size_and_partitions_change_no_text(spark, monkeypatch):
    pages = [(k, f"http://www.h{k % 3 and 1}.example/{k}", unmarked(k)[0]) for k in range(60)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    whole = {r["page_id"]: r["text"] for r in wrappers.extract_pages(frame).collect()}
    assert whole == {k: unmarked(k)[1] for k in range(60)}
    monkeypatch.setattr(wrappers, "FAN", 2)
    cut = wrappers.extract_pages(frame.repartition(7), host_pages=10)
    assert {r["page_id"]: r["text"] for r in cut.collect()} == whole


def test_wrappers_round_trip_and_bounds(monkeypatch):
    w = wrappers.infer([tree(unmarked(k)[0]) for k in range(9)])
    assert wrappers.unpacked(w.packed()).packed() == w.packed()
    deep = "<div>" * 5_000 + "<p>deep down</p>" + "</div>" * 5_000 + "<p>after</p>"
    assert wrappers.extract([deep]) == ["deep down"]
    wide = "".join(f"<div><p>{prose(k)}</p></div><hr>" for k in range(1_500))
    assert len(wrappers.extract([wide, wide + "<div><h2>more</h2></div>"])[0]) == len(wrappers.extract([wide])[0])
    monkeypatch.setattr(wrappers, "MOST_NODES", 10)
    assert all(wrappers.extract([unmarked(k)[0] for k in range(9)]))


def test_no_place_of_a_large_wrapper_is_forgotten(spark, monkeypatch):
    """Wrappers of more nodes than MOST_NODES decide as any other, in extract() and in tasks."""
    pages = [unmarked(k) for k in range(14)]
    monkeypatch.setattr(wrappers, "MOST_NODES", 10)
    assert wrappers.extract([h for h, _ in pages]) == [t for _, t in pages]
    frame = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, (h, _) in enumerate(pages)], "page_id bigint, url string, html string")
    assert [r["text"] for r in wrappers.extract_pages(frame, host_pages=2).orderBy("page_id").collect()] == [t for _, t in pages]


@pytest.mark.parametrize("halved", [1 << 28, 6])
def test_long_sibling_lists_are_aligned_throughout(monkeypatch, halved):
    """A template in the middle of long lists of siblings is found, with different siblings before it and behind."""
    monkeypatch.setattr(wrappers, "LONG", 4)
    monkeypatch.setattr(wrappers, "HALVED", halved, raising=False)
    pages = [unmarked(k) for k in range(14)]
    assert wrappers.extract([h for h, _ in pages]) == [t for _, t in pages]


def test_common_sequences_are_longest(monkeypatch):
    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for halved in (1 << 28, 4):
        monkeypatch.setattr(wrappers, "HALVED", halved)
        for k in range(200):
            one, two = ([(x * x + 7 * k * x + s * k) % (3 + k % 9) for x in range(k % 17)] for s in (1, 5))
            two = two[k % 3 :] + one[: k % 5]
            found = wrappers.in_order(one, two)
            assert all(one[i] == two[j] for i, j in found) and len(found) == longest(one, two)
            assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))
