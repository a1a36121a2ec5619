"""Layout rules of rendered pages, and hostile markup in bounded time."""

import time

import pytest
from tapeloom.llm.html_text import build, extract


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a  b  c\nd     e\nf     g"),
    ("<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d</table>", "ab  c\n    d"),
    ("a<br><br>b", "a\n\nb"), ("<br>a<br>", "a"), ("a<br>b", "a\nb"), ("<p>a</p><br><br><p>b", "a\n\n\nb"), ("a<br></div>b", "a\nb"),
    ("<details><summary>s</summary>body<p>more</details>after", "s\nafter"), ("<details open><summary>s</summary>body</details>", "s\nbody"), ("<details>body</details>x", "x"),
    ("<dialog>x</dialog>y", "y"), ("<dialog open>x</dialog>y", "xy"), ("<video>no film</video><audio>no sound</audio><canvas>no picture</canvas>z", "z"),
    ("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcdef<td>y</table>", "\u65e5\u672c    x\nabcdef  y"), ("<table><tr><td>e\u0301<td>x<tr><td>ab<td>y</table>", "e\u0301   x\nab  y"),
    ("<i><table><td><b>x</i>y</table>z", "xy\n\nz"), ("<div><span>a</div>b", "a\nb"), ("<table><td>" * 12 + "deep" + "</table>" * 12, "deep"),
])
def test_layout(page, text):
    assert extract(page) == text


def shape(node):
    return node if isinstance(node, str) else (node.tag, [shape(c) for c in node.children])


def test_end_tags_stop_at_the_nearest_scope():
    assert shape(build("<i>a<table><tr><td><b>x</i>y</b>z</table>w</i>v")) == (
        "html", [("i", ["a", ("table", [("tr", [("td", [("b", ["x", "y"]), "z"])])]), "w"]), "v"])


SIZE = 1_000_000
HOSTILE = {
    "ends behind a barrier": "<i><table><td>" + "<b>" * (SIZE // 7) + "</i>" * (SIZE // 7), "nested lists": "<ul><li>x" * (SIZE // 9),
    "nested tables": "<table><tr><td>x" * (SIZE // 16), "long text in nested tables": "<table><tr><td>" * 30_000 + "word " * 100_000,
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=9>x" * (SIZE // 33), "one row": "<table><tr>" + "<td colspan=1000 rowspan=9>x" * (SIZE // 29),
    "cells over all rows": "<table><tr>" + "<td rowspan=65000>xxxxxxxxxx" * 1000 + "<tr><td>y" * (SIZE // 9), "paragraphs": "<p>" * (SIZE // 3), "breaks": "a" + "<br>" * (SIZE // 4) + "b",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    started = time.process_time()
    out = extract(HOSTILE[name])
    assert time.process_time() - started < 20 and len(out) < 60 * SIZE  # about 1 to 4 seconds each
