"""Layout by examples."""

import re
import time

import pytest

from gatelake.llm.html_text import extract_text, render

CASES = [
    ("<p>one<p>two <b>bold</b>\n text<br>next", "one\n\ntwo bold\ntext\nnext".replace("bold\ntext", "bold text")),
    ("<h1>T</h1>intro &amp; more<div>a</div><div>b</div>", "T\n\nintro & more\na\nb"),
    ("<ul><li>a<li>b<ul><li>b1<li>b2</ul><li>c</ul>", "- a\n- b\n  - b1\n  - b2\n- c"),
    ("<ol start=9><li>x<li>y<br>z</ol>", "9. x\n10. y\n    z"),
    ("<table><tr><th>Name<th>Val<tr><td>long name<td>1<tr><td>q<td>m<br>n</table>", "Name       Val\nlong name  1\nq          m\n           n"),
    ("<table><caption>C</caption><tr><td colspan=2>both<td>z<tr><td>a<td>b<td>c</table>", "C\nboth  z\na  b  c"),
    ("a<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>b", "a\n\nin  ner  out\n\nb"),
    ("<pre>\n a  b\n   c</pre>d", " a  b\n   c\n\nd"),
    ("<div style='display: none'>no</div><p hidden>no</p>yes<script>var a='</p>'</script><!-- no <p> -->", "yes"),
    ("<span style='visibility:hidden'>no <i style='visibility:visible'>yes</i></span>", "yes"),
    ("<head><title>t</title><style>p{}</style></head><body>b", "b"),
    ("<title>t</title>body without tags", "body without tags"),
    ("<details><summary>S</summary>no<p>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("3 < 4 and <b>5 > 2", "3 < 4 and 5 > 2"),
    ("<dl><dt>T<dd>D1<dd>D2</dl>", "T\n    D1\n    D2"),
    ("<p>a</p>tail</p>stray</div></b>", "a\n\ntail\n\nstray"),
    ("<select><option>a<option>b</select><textarea>\n x &lt; y</textarea>", "a\nb\n x < y"),
    ("<td>loose<li>item", "loose\n- item"), ("", ""), (" \n ", ""), ("<p", ""), ("<a href='>' title=\"<b>\">x</a>", "x"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_layout(source, text):
    assert render(source) == text


def test_visible_words_are_kept_in_order():
    words = [f"w{i}" for i in range(300)]
    tags = ["<p>", "<div>", "</div>", "<ul><li>", "<li>", "</ul>", "<table><tr><td>", "<td>", "<tr><td>", "</table>", "<b>", "</b>", "</p>"]
    source = "".join(f"{tags[i * 7 % len(tags)]} {w} " for i, w in enumerate(words))
    assert sorted(re.findall(r"w\d+", render(source))) == sorted(words)


def test_hostile_pages_end():
    for source in ("<div>" * 50_000 + "x", "<ul><li>" * 1000 + "x", "<table><tr><td>" * 500 + "x", "<b" * 20_000, "<" * 50_000,
                   "<p " + "a" * 50_000, "<x '" * 5000, "<!--" * 20_000):
        render(source)


def test_odd_rows(spark):
    rows = [(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None), (2, "", "x"), (3, "<i>" + "long " * 100_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = sorted(((r.page_id or 0), len(r.text)) for r in extract_text(pages).collect())
    assert found == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 499_999)]
    assert extract_text(pages.limit(0)).count() == 0


def test_numbers_that_are_none_do_not_fail():
    for value in ("--1", "²", "-", "", "9" * 5000, "1e3", "٣"):
        assert render(f"<ol start='{value}'><li value='{value}'>a</ol><table><tr><td colspan='{value}' rowspan='{value}'>b</table>"
                      ).split() == ["1.", "a", "b"]
    assert render("<ol start=-3><li>a<li value=7>b</ol>").split() == ["-3.", "a", "7.", "b"]


def test_open_quotes_take_linear_time():
    started = time.perf_counter()
    render("<a " * 350_000 + "'")
    render("<a ' > x" * 100_000 + '"')
    assert time.perf_counter() - started < 5
    assert render("<p title=don't>seen</p>") == "seen"


def test_cells_that_span_rows_and_columns_keep_the_others_in_place():
    page = ("<table><tr><td rowspan=2>aa</td><td>b</td><td>c</td></tr><tr><td>dddd</td><td>e</td></tr>"
            "<tr><td colspan=2>wider than both columns</td><td>f</td></tr></table>")
    lines = [line for line in render(page).split("\n") if line]
    assert lines[0].index("b") == lines[1].index("dddd") and lines[1].startswith("    ")
    assert lines[0].index("c") == lines[1].index("e") == lines[2].index("f")


def test_long_cells_go_on_below_and_words_keep_their_order():
    words = [f"w{i}" for i in range(60)]
    lines = render(f"<table><tr><td>{' '.join(words)}</td><td>end</td></tr></table>").split("\n")
    assert max(map(len, lines)) <= 60 + 2 + 3 and [w for line in lines for w in line.split() if w != "end"] == words
    assert lines[0].endswith("end")
