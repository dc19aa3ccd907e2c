"""Passages in HTML: where they are, where several or none are, and how a page shows them."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import passages as P

PAGES = [
    ("one", '<h2>x</h2><p>Two  <b>moons</b>\n orbit&nbsp;it.<sup id="a>b">[1]</sup></p>', "Two moons orbit it.", "located"),
    ("with its marks", "<p>Two moons<sup>[1]</sup></p>", "Two moons[1]", "located"),
    ("marks within marks", "<p>Two<sup>a<sup>b</sup>c</sup> moons</p>", "Two moons", "located"),
    ("entities", "<p>a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39; &eacute;</p>", "a & b <c> \"d\" 'e' &eacute;", "located"),
    ("entities once", "<p>&amp;lt;</p>", "&lt;", "located"),
    ("characters of several bytes", "<p>é重</p><p class='q'>𝄞 moons</p>", "𝄞 moons", "located"),
    ("twice", "<p>Two moons</p><p>Two <i>moons</i></p>", "Two moons", "ambiguous"),
    ("part of a paragraph", "<p>Two moons orbit it.</p>", "Two moons", "absent"),
    ("no paragraph", "<li>Two moons</li>", "Two moons", "absent"),
    ("another paragraph begins", "<p>Two moons<p>Two</p>", "Two moons", "absent"),
    ("paragraph left open", "<p>Two moons", "Two moons", "absent"),
    ("tag without end", '<p>Two moons</p><a href="', "Two moons", "absent"),
    ("upper case elsewhere", "<pre>Two moons</pre><p>two moons</p>", "Two moons", "absent"),
    ("no words", "<p> </p>", " ", "wordless"),
    ("no page", None, "Two moons", "absent"),
]


@pytest.fixture(scope="module")
def places(spark):
    pages = spark.createDataFrame([(k, h) for k, (_, h, _, _) in enumerate(PAGES) if h is not None], "page_id long, html string")
    asked = spark.createDataFrame([(k, "b", "paragraph", t) for k, (_, _, t, _) in enumerate(PAGES)], "page_id long, block_id string, kind string, text string")
    return {r.page_id: r for r in P.locate(asked, pages).collect()}


@pytest.mark.parametrize("k", range(len(PAGES)), ids=[p[0] for p in PAGES])
def test_places(places, k):
    r, html = places[k], PAGES[k][1]
    assert r.status == PAGES[k][3] and (r.start is None) == (r.status != "located")
    if r.start is not None:
        part = html.encode()[r.start : r.end].decode()
        assert part.startswith("<p") and part.endswith("</p>") and part.count("<p") == 1


def test_kinds(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    asked = spark.createDataFrame([(1, k, k, "a") for k in ("paragraph", "quote", "list", "table")] + [(1, "null", "quote", None)], "page_id long, block_id string, kind string, text string")
    assert {r.block_id: r.status for r in P.locate(asked, pages).collect()} == {"paragraph": "located", "quote": "located", "list": "wordless", "table": "wordless", "null": "wordless"}


def test_marked_pages(spark):
    rows = [("<h1>é</h1><p>b</p><p>c</p>", "located", 11, 19, [], "b"), ("<p>x</p>", "absent", None, None, ["A & B", "C"], "<b>"), ("<p>x</p>", "ambiguous", None, None, [], "x")]
    df = spark.createDataFrame(rows, "html string, status string, start long, end long, headings array<string>, excerpt string")
    got = [r.m for r in df.select(P.marked(*(F.col(c) for c in df.columns)).alias("m")).collect()]
    assert got[0] == '<h1>é</h1><div id="cited" class="cited"><p>b</p></div><p>c</p>'
    assert "(A &amp; B › C)" in got[1] and "<p>&lt;b&gt;</p></div><p>x</p>" in got[1] and "(Introduction)" in got[2]
