import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import html_text, queries
from leadflow.llm.html_text import extract

SF = "/root/testdata/sf0.001"

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<ul><li>x<li>y<ul><li>z</ul></ul>w": "- x\n- y\n\n  - z\n\nw",
    "<ol start=3><li>x</li><li>y</li></ol>": "3. x\n4. y",
    "<script>a<b</script>t<style>p{}</style><!-- c -->u": "tu",
    "<p hidden>a</p><p style='display : none'>b</p><p style='color:red'>c</p>": "c",
    "<input type=hidden value=x><span style=\"visibility:hidden\">v</span>ok": "ok",
    "<pre>a\n  b</pre>": "a\n  b",
    "a  <b> b </b>\n c": "a b c",
    "<table><tr><th>name<th>n<tr><td>long name<td>1</table>": "name      | n\nlong name | 1",
    "<table><tr><td colspan=2>t<td>u<tr><td>a<td>b<td>c</table>": "t |   | u\na | b | c",
    "<table><td><p>one<p>two</table>": "one\n\ntwo",
    "<table><caption>cap</caption><tbody><tr><td>a</td><td>b</td></tr></tbody></table>z": "cap\na | b\n\nz",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "x < y and <3 > z": "x < y and <3 > z",
    "<p>open <b>bold": "open bold",
    "</p></div>stray": "stray",
    "<img alt='a picture'> <title>no</title>": "a picture",
    "<a title='x > y'>t</a>": "t",
    "<textarea>in &lt;b></textarea>out": "in <b> out",
    "a<input type=submit value='Send it'>b<input type=text value=no>": "a Send it b",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d": "b\nd",
    "<style>.x{display:none} p.y, #z { color:red; visibility : hidden }</style><p class='w x'>a<p class=y>b<div id=z>c</div><p class=x style='display:block'>d": "d",
    "<style>@media print{.x{display:none}} /* .x{display:none} */ div .x{display:none}</style><p class=x>a": "a",
    "<style>.x{display:none}.x{display:block}</style><p class=x>a": "a",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a | b\n  | c\n  | d | e",
    "<ol><li value=5>a<li>b</ol><ol reversed><li>c<li>d</ol>": "5. a\n6. b\n\n2. c\n1. d",
    "<a href=\"x>text</a> more": "text more",
    "t<a href=x": "t",
    "<b>un</b>broken": "unbroken",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert extract(source) == CASES[source]


def test_deep_and_long_pages():
    assert extract("<div>" * 20_000 + "x") == "x" == extract("<p><table><td>" + "<div><b>" * 9_000 + "x")
    assert "x" in extract("<table><tr><td>a<td>" * 400 + "x")
    assert extract("<p>" + "word " * 100_000).count("word") == 100_000
    assert extract("<a \"" * 2_000) is not None


@pytest.mark.parametrize("part", ["<a ", "<a \"", "<a '>", "<!--", "<", "</", "<p", "<li><ol>", "<td rowspan=9 colspan=99>"])
def test_long_pages_take_time_in_proportion(part):
    extract(part)
    began = time.process_time()
    extract(part * ((100_000 if "ol" in part else 1_000_000) // len(part)))
    assert time.process_time() - began < 6


def test_a_table_grows_with_its_content_only():
    rows = "".join(f"<tr><td colspan=1000>{i}" for i in range(4_000))
    assert len(extract(f"<table>{rows}</table>")) < 30_000
    steps = "".join(f"<tr><td colspan={i}>a<td>b" for i in range(1, 1_000))
    assert len(extract(f"<table>{steps}</table>")) < 60_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<br/>", "<div>", "</div>",
                                 "<b>", "</b>", "<pre>", "<!--", "-->", "<script>", "</script>", "&lt;", "<", ">", "\""]), max_size=30))
def test_any_markup_is_read(parts):
    out = extract("".join(parts))
    assert not out.startswith("\n") and not out.endswith("\n")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc&<é ", max_size=8), max_size=12))
def test_all_visible_words_are_there_in_order(texts):
    tags = ["p", "div", "li", "td", "span", "h2"]
    source = "".join(f"<{tags[i % 6]}>{html.escape(t)}</{tags[i % 6]}> " for i, t in enumerate(texts))
    assert re.findall(r"[^\s|-]+", re.sub(r"(?m)^\s*- ", "", extract(source))) == " ".join(texts).split()


def test_query_keeps_all_words(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op10_html_text(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, source in pages.items():
        seen = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", " ", source)
        want = html.unescape(re.sub(r"<[^>]*>", " ", seen)).split()
        have = [w for w in got[i].split() if w not in ("-", "|")]
        assert "".join(w for w in want if w not in ("-", "|")) == "".join(have)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "<p>a", "x"), (2, "", None)], "page_id long, html string, text string")
    got = sorted(map(tuple, html_text.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, None), (1, None), (None, "a"), (2, "")], key=str)
    assert html_text.extract_pages(df.where("page_id > 9")).collect() == []


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><body><p>text", "text"),
    ("<head><meta charset=x><p>text</p>", "text"),
    ("<head><title>t</title>text", "text"),
    ("<head><template><p>no</p></template></head>yes", "yes"),
    ("<table><colgroup><col><col><tr><td>a<td>b</table>", "a | b"),
    ("<table><tbody><form><tr><td>a</td><td>b</td></tr></form></tbody></table>", "a | b"),
    ("<table><tr><form><td>a</td></form><td>b</td></tr></table>", "a | b"),
    ("<table><tbody><div>x</div><tr><td>a<td>b</table>", "x\na | b"),
    ("<table><tr><b>x</b><td>a</td><td>b</td></tr></table>", "x\na | b"),
    ("<p>y <select><option>a<option>b</select></p>", "y\na\nb"),
    ("<svg><title>no</title><defs/><path d='m'/><text>in</text></svg>", "in"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
])
def test_no_visible_text_is_lost(source, want):
    assert extract(source) == want
