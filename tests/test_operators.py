"""The reference cases of FIXTURES.md: small inputs, expected results and typed errors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError
from lorekeep.functions import html
from lorekeep.functions import text as T
from lorekeep.operators import audit, evaluate, graph, joins, search, state
from lorekeep.plans import search_queries
from lorekeep.sources import dumps, sinks
from lorekeep.streaming import stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_tokens(spark):
    assert value(spark, T.index_tokens(F.lit("Gravité is FRENCH, no_2"))) == ["gravité", "is", "french", "no", "2"]
    assert value(spark, T.index_tokens(F.lit("重力波 a"))) == ["重", "力", "波", "重力", "力波", "a"]
    assert value(spark, T.query_tokens(F.lit("重力波 力"))) == ["重力", "力波", "力"]
    assert len(value(spark, T.query_tokens(F.lit("w " * 40)))) == 32
    assert value(spark, T.word_cost(F.lit("重力 two words"))) == 4


def test_keys(spark):
    assert value(spark, T.title_key(F.lit("élan_vital x"))) == "Élan vital x"
    assert value(spark, T.title_key(F.lit("ßeta"))) == "ßeta"
    assert value(spark, T.trimmed_title_key(F.lit(" ßeta "))) == "SSeta"
    assert value(spark, T.decode_title(F.lit("C%2B%2B_and+more"))) == "C++ and+more"
    assert value(spark, T.strip_markers(F.lit("  bends\n spacetime[1]"))) == "bends spacetime"
    assert value(spark, T.draft_text(F.lit("done [[cite:a]] so [[ci"))) == "done  so "
    assert value(spark, T.citation_markers(F.lit("Two [[cite:lead_0]]. x [[cite:sec_1]]."))) == ["lead_0", "sec_1"]
    path = F.array(F.lit(3), F.lit(1))
    assert value(spark, T.block_id(F.lit("enwiki"), F.lit(17), F.lit(88), path, F.lit(0))) == "wkb:enwiki:17:88:3:1:b0"
    url = "https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/My_File.png/120px-My_File.png"
    assert value(spark, T.media_file_name(F.lit(url))) == "My File.png"
    assert value(spark, T.image_kind(F.unhex(F.lit("89504E470D0A1A0A0000")))) == "image/png"


BLOCKS = [
    ("wkb:enwiki:17:88:b0", None, "Kinematics describes motion."),
    ("wkb:enwiki:17:88:1:b0", "Gravity", "Gravity curves spacetime."),
    ("wkb:enwiki:17:88:1:b1", "Gravity", "Gravity acceleration near Earth is about 9.8."),
    ("wkb:enwiki:17:88:2:b0", "Heat", "Heat transfers thermal energy between bodies."),
    ("wkb:enwiki:17:88:3:b0", "Optics", "Light refraction bends at an interface."),
    ("wkb:enwiki:17:88:3:1:b0", "Optics Reflection", "Reflection occurs when light returns from a surface."),
    ("wkb:enwiki:17:88:4:b0", "Multilingual concepts", "Gravité is a French word for gravity."),
]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("gravity curves spacetime", "1:b0"), ("gravity acceleration Earth", "1:b1"), ("heat thermal energy", "2:b0"),
        ("light refraction interface", "3:b0"), ("reflection light surface", "3:1:b0"), ("Gravité French word", "4:b0"),
    ],
)
def test_labelled_retrieval(spark, query, expected):
    rows = [("enwiki", 17, b, h, t) for b, h, t in BLOCKS]
    blocks = spark.createDataFrame(rows, "project string, page_id long, block_id string, heading string, text string")
    assert f"wkb:enwiki:17:88:{expected}" in [r["block_id"] for r in search.set_overlap(blocks, query, 3).collect()]
    assert search.set_overlap(blocks, "dragonfire", 3).count() == 0
    assert search.bm25_blocks(blocks, query, 1).head()["block_id"] == f"wkb:enwiki:17:88:{expected}"


def test_budget_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (1, 3, "c"), (1, 9, "d")], "g int, c int, id string")
    taken = search.pack_budget(hits, F.col("c"), 8, ["g"], ["id"]).select("id").collect()
    assert sorted(r["id"] for r in taken) == ["a", "c"]


def test_topic_selection(spark):
    cats = spark.createDataFrame([("Science", False), ("Math", False)], "name string, administrative boolean")
    children = spark.createDataFrame([("Science", "Math"), ("Math", "Science")], "name string, child string")
    members = spark.createDataFrame([("Science", 9), ("Science", 2), ("Math", 3), ("Math", 2)], "name string, page_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "page_id long")
    visited, pages = graph.select_topic(cats, children, members, ["Science", "Math"], 2, exclude=ids(9), include=ids(4, 5))
    assert sorted(r[0] for r in pages.collect()) == [2, 3, 4, 5]
    with pytest.raises(LorekeepError, match="TooManyPages"):
        graph.select_topic(cats, children, members, ["Science"], 2, page_limit=1)
    with pytest.raises(LorekeepError, match="MissingCategory"):
        graph.select_topic(cats, children, members, ["Nothing"], 2)


def test_related(spark):
    edges = [(1, 3), (1, 2), (1, 2), (2, 4), (2, 1), (3, 5), (3, 4), (4, 6), (5, 7)]
    links = spark.createDataFrame(edges, "from_id long, to_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "page_id long")
    got = lambda hops: sorted(r["page_id"] for r in graph.related(links, ids(8, 1, 1), hops, ids(5, 8)).collect())
    assert got(2) == [1, 2, 3, 4]
    assert got(1) == [1, 2, 3]
    with pytest.raises(LorekeepError, match="TooManyEdges"):
        graph.related(links, ids(1), 2, max_edges=2)


def test_redirects(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "from_id long, to_id long")
    assert {r["to_id"] for r in graph.resolve_redirects(chain).collect()} == {40}
    with pytest.raises(LorekeepError, match="Cycle"):
        graph.resolve_redirects(spark.createDataFrame([(1, 2), (2, 1)], "from_id long, to_id long"), most=8)


def component(spark, rows):
    return spark.createDataFrame(rows, "project string, page_id long, revision_id long, generation_id string, payload string")


def test_component_join(spark):
    s = component(spark, [("enwiki", 2, 20, "g", "s2"), ("enwiki", 1, 10, "g", "s1")])
    r = component(spark, [("enwiki", 1, 10, "g", "r1"), ("enwiki", 2, 20, "g", "r2")])
    c = component(spark, [("enwiki", 2, 20, "g", ""), ("enwiki", 1, 10, "g", "c1")])
    assert [x["page_id"] for x in joins.join_components(s, r, c).orderBy("page_id").collect()] == [1, 2]
    bad = {
        "MissingComponent": (s, r.where("page_id = 1"), c), "DuplicatePage": (s, r.unionByName(r), c),
        "RevisionMismatch": (s, r.withColumn("revision_id", F.lit(7).cast("long")), c),
        "EmptyPayload": (s, r.withColumn("payload", F.lit("")), c), "InvalidIdentity": (s.withColumn("project", F.lit("En")), r, c),
    }
    for code, sides in bad.items():
        with pytest.raises(LorekeepError, match=code):
            joins.join_components(*sides)
    dead = spark.createDataFrame([("enwiki", 2, "g")], "project string, page_id long, generation_id string")
    with pytest.raises(LorekeepError, match="LiveTombstone"):
        joins.join_components(s, r, c, dead)


def test_census(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    d = audit.census_diff(ids(*range(100, 105)), ids(100, 102, 104), "id").head()
    assert (d["missing"], d["missing_ids"], d["unexpected"], d["unexpected_ids"]) == (2, [101, 103], 0, [])
    d = audit.census_diff(ids(1, 3, 5, 7), ids(1, 2, 7, 8), "id").head()
    assert (d["missing_ids"], d["unexpected_ids"]) == ([3, 5], [2, 8])


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line int, value string")


def test_checksums(spark):
    digest = "a" * 64
    ok = lines(spark, f"{digest}  b/enwiki-p1p9.xml", f"{digest.upper()} *a-p10p20.xml")
    assert [r["start"] for r in dumps.check_export(dumps.parse_checksums(ok)).orderBy("start").collect()] == [1, 10]
    for code, bad in {"UnsafePath": "../x", "DuplicatePath": "B/enwiki-p1p9.xml"}.items():
        with pytest.raises(LorekeepError, match=code):
            dumps.parse_checksums(ok.unionByName(lines(spark, f"{digest}  {bad}")))
    with pytest.raises(LorekeepError, match="Malformed"):
        dumps.parse_checksums(lines(spark, "zz  x"))
    with pytest.raises(LorekeepError, match="Overlapping"):
        dumps.check_export(dumps.parse_checksums(lines(spark, f"{digest}  a-p1p9.xml", f"{digest}  b-p9p12.xml")))


def test_dump(spark, tmp_path):
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id>{1}<revision><id>{0}5</id><timestamp>2026-10-01T00:00:00Z</timestamp><contributor><id>9</id></contributor><text>x</text></revision></page>"
    xml = "<mediawiki>" + page.format(1, "") + page.format(2, '<redirect title="T1" />') + "</mediawiki>"
    (tmp_path / "d.xml").write_text(xml)
    rows = dumps.read_dump(spark, str(tmp_path / "d.xml")).orderBy("page_id").collect()
    assert [(r["page_id"], r["revision_id"], r["redirect_target"]) for r in rows] == [(1, 15, None), (2, 25, "T1")]


def test_feeds(spark):
    text = "wiki"
    good = '{{"schema_version":1,"project":"enwiki","generation_id":"2026-10-01","page_id":{},"namespace":0,"title":"M","revision_id":7,"timestamp":"2026-09-30T01:00:00Z","wikitext":"{}","wikitext_sha256":"{}"}}'
    row = lambda i, sha=hashlib.sha256(text.encode()).hexdigest(): good.format(i, text, sha)
    assert dumps.read_revisions(lines(spark, row(1), row(3))).count() == 2
    for code, feed in {
        "UnsortedPages": [row(3), row(1)], "DigestMismatch": [row(1, "0" * 64)], "BlankLine": [row(1), ""],
        "MalformedRecord": ["{"], "DuplicateRecord": [row(1), row(1)],
    }.items():
        with pytest.raises(LorekeepError, match=code):
            dumps.read_revisions(lines(spark, *feed))
    assert [r["id"] for r in dumps.read_census(lines(spark, "1", "30")).collect()] == [1, 30]
    with pytest.raises(LorekeepError, match="InvalidId"):
        dumps.read_census(lines(spark, "01"))


def test_replies(spark):
    body = '{"query":{"normalized":[{"from":"a b","to":"A b"}],"redirects":[{"from":"A b","to":"C"}],"pages":[{"pageid":4,"ns":0,"title":"C"}]}}'
    got = dumps.resolved_titles(spark.createDataFrame([("a b", body)], "requested string, body string")).head()
    assert (got["title"], got["page_id"]) == ("C", 4)
    images = '{"query":{"pages":[{"title":"File:B","imageinfo":[{"url":"u","mime":"m","sha1":"s"}]},{"title":"File:A","imageinfo":[{"url":"v","mime":"m","sha1":"t"}]}]}}'
    files = spark.createDataFrame([(0, "File:A"), (1, "File:B")], "place int, title string")
    replies = spark.createDataFrame([(images,)], "body string")
    assert [r["url"] for r in dumps.image_metadata(replies, files).collect()] == ["v", "u"]
    with pytest.raises(LorekeepError, match="MissingImage"):
        dumps.image_metadata(replies, spark.createDataFrame([(0, "File:Z")], "place int, title string"))


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([(3,), (1,), (20,), (3,)], "id long")
    sinks.write_census(ids, str(tmp_path / "census"))
    assert sorted(int(r["value"]) for r in spark.read.text(str(tmp_path / "census")).collect()) == [1, 3, 20]
    sinks.write_objects(spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary"), str(tmp_path / "objects"))
    assert spark.read.parquet(str(tmp_path / "objects")).count() == 2
    sinks.write_report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).head()["value"] == '{"a":1,"b":null}'


def test_html(spark):
    page = '<h1>A</h1><p>one <b>two</b><img src="/i.png"></p><nav><p>no</p></nav><h2>B</h2><li>x</li><div style="background:url(c.png)"><img srcset="s.png 1x, t.png 2x">'
    pages = spark.createDataFrame([(1, "http://h/d/", page), (2, None, None)], "page_id long, url string, html string")
    assert {(r["kind"], r["url"]) for r in html.visual_inventory(pages).collect()} == {
        ("image", "http://h/i.png"), ("css", "http://h/d/c.png"), ("srcset", "http://h/d/s.png"), ("srcset", "http://h/d/t.png"),
    }
    blocks = [(r["kind"], r["heading_path"], r["text"]) for r in html.extract_blocks(pages).orderBy("ordinal").collect()]
    assert blocks == [("h1", "A", "A"), ("p", "A", "one two"), ("h2", "A > B", "B"), ("li", "A > B", "x")]


def test_sanitize():
    page = '<p onclick="x">a <b>b<script>x()</script></p><a href="javascript:x">c</a><img src="/i.png" alt="&lt;"><custom>d</custom> & e'
    assert html.sanitize(page) == '<p>a <b>b</b></p><a>c</a><img src="/i.png" alt="&lt;">d &amp; e'
    assert html.sanitize(None) == ""


def test_greedy_cover(spark):
    rows = [("p", 1, 1, ["a"]), ("p", 2, 1, ["a", "b"]), ("p", 3, 1, ["c"]), ("q", 4, 1, ["a"])]
    c = spark.createDataFrame(rows, "project string, page_id long, revision_id long, strata array<string>")
    assert sorted((r["project"], r["page_id"], r["round"]) for r in graph.greedy_cover(c, "project", 1).collect()) == [
        ("p", 2, 1), ("p", 3, 2), ("q", 4, 1),
    ]


def test_greedy_cover_of_many_strata(spark):
    c = spark.createDataFrame([("p", k, 1, [f"s{k}"]) for k in range(66)], "project string, page_id long, revision_id long, strata array<string>")
    assert graph.greedy_cover(c, "project", 1).select("page_id").distinct().count() == 66
    with pytest.raises(LorekeepError):
        graph.greedy_cover(c, "project", 1, most_rounds=2)


def test_gold_of_a_long_suite(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.where("doc_id < 20").withColumn("text", F.concat(F.lit("case "), F.col("doc_id"), F.lit(" end"))).write.parquet(f"{tmp_path}/documents.parquet")
    cases = spark.range(1, 1201).selectExpr("id as item_id", "if(id > 1000, concat('case ', id - 1000, ' end'), 'nowhere') as text")
    cases.write.parquet(f"{tmp_path}/benchmark.parquet")
    gold = {(r["case_id"], r["page_id"]) for r in search_queries._gold(spark, str(tmp_path)).collect()}
    assert gold == {(1000 + r["doc_id"], r["doc_id"] + 1) for r in docs.where("doc_id between 1 and 19").collect()}


def test_state(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(tuple(r) for r in state.upsert(old, new, ["k"], "v").collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]
    settings = spark.createDataFrame([("gen", "1")], "key string, value string")
    assert state.compare_and_swap(settings, "gen", "1", "2").head()["value"] == "2"
    assert state.conditional(old, settings, "gen", "9").count() == 0
    assert state.bounded(old, ["k"], 2).count() == 2
    with pytest.raises(LorekeepError, match="TooMany"):
        state.bounded(old, ["k"], 1)
    assert state.due(None, 5, 60) and not state.due(0, 59, 60)
    with pytest.raises(LorekeepError):
        state.due(0, 1, 5)


def test_report_gate(spark):
    scores = spark.createDataFrame([(1, 2, 1, 3, 0), (2, 0, 0, 1, 1)], "case_id int, relevant long, found long, retrieved long, false_positive long")
    assert evaluate.suite_report(scores, 500, 1).head()["passed"]
    assert not evaluate.suite_report(scores, 501, 1).head()["passed"]
    assert not evaluate.suite_report(scores, 500, 0).head()["passed"]


def test_streams(spark, tmp_path):
    chunks = [("a", 1, "data: he"), ("a", 2, "llo\r"), ("a", 3, "\n\r\ndata: x\ndata: y\n\n"), ("b", 1, "data: open")]
    spark.createDataFrame(chunks, "stream string, seq long, chunk string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream string, seq long, chunk string").parquet(str(tmp_path / "in"))
    stream.run_available(stream.decode_events(source), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["frame"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["hello", "x\ny"]
    ids = [("m", 1, 3), ("m", 2, 5), ("m", 3, 4), ("n", 1, 1)]
    spark.createDataFrame(ids, "member string, seq long, id long").coalesce(1).write.parquet(str(tmp_path / "ids"))
    source = spark.readStream.schema("member string, seq long, id long").parquet(str(tmp_path / "ids"))
    stream.run_available(stream.audit_shards(source), str(tmp_path / "audit"), str(tmp_path / "state2"), "update")
    rows = {r["member"]: (r["seen"], r["poisoned"]) for r in spark.read.parquet(str(tmp_path / "audit")).collect()}
    assert rows == {"m": (2, True), "n": (1, False)}
