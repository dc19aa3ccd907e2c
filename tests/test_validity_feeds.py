"""Validators, hashes, feeds, published versions, the index on disk and grounding, case by case."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError
from lorekeep.functions import html
from lorekeep.functions import validity as V
from lorekeep.operators import audit, graph, grounding, joins, search
from lorekeep.sources import dumps, feeds, published, search_index


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expression(F.col("v"))).collect()]


GOOD_URLS = [
    "http://a.example", "https://a-b.example:65535/p?q#f", "http://[::1]/", "http://[2001:db8::8:800:200c:417a]:80", "https://[::ffff:1.2.3.4]/",
    "http://[1:2:3:4:5:6:7:8]", "http://1.2.3.4/ä", "http://[::]",
]
BAD_URLS = [
    "ftp://a", "http://", "http:///x", "http://a b", "http://u@a/", "http://a..b", "http://-a", "http://a-", "http://a:0", "http://a:65536", "http://a:",
    "http://[1:2:3:4:5:6:7]", "http://[1::2::3]", "http://[::1", "http://[::1]x", "http://a\\b", "http://a%20", "http://ä.example", "http://[12345::]",
    "http://" + "a" * 64, None,
]


def test_external_urls(spark):
    assert column(spark, GOOD_URLS, V.valid_external_url) == [True] * len(GOOD_URLS)
    assert column(spark, BAD_URLS, V.valid_external_url) == [False] * len(BAD_URLS)


def test_dates_labels_and_characters(spark):
    assert column(spark, ["2024-02-29", "2023-02-29", "0000-01-01", "2024-1-01", "2024-13-01", "0001-01-01"], V.valid_dump_date) == [True, False, False, False, False, True]
    assert column(spark, ["a", " a", "a ", "a‍b", "a​b", ""], V.valid_label) == [True, False, False, True, False, False]
    assert column(spark, ["Category:a_b", "a#b", "_a", "Category:"], V.category_title) == ["Category:a b", None, None, None]
    assert column(spark, ["a\tb\n", "a\x0b", "a￾", "\U0001f600"], V.valid_xml_text) == [True, False, False, True]
    assert column(spark, ["https://upload.wikimedia.org/wikipedia/a.png", "https://upload.wikimedia.org/wikipedia/%2e%2e/a", "https://x.org/wikipedia/a"], V.media_url_allowed) == [True, False, False]


def base36(n):
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out.zfill(31)


def test_revision_hashes(spark):
    def own(t):
        return base36(int(hashlib.sha1(t.encode()).hexdigest(), 16))

    assert column(spark, ["", "a", "ü"], V.sha1_base36) == [own(""), own("a"), own("ü")]
    slots = "slots array<struct<role:string,text:string>>"
    rows = [([("main", "m"), ("extra", "e")],), ([("main", "m")],), ([("main", "m"), ("main", "n")],), ([],), ([("1x", "m")],)]
    got = [r[0] for r in spark.createDataFrame(rows, slots).select(V.slots_sha1("slots")).collect()]
    assert got == [own(own("e") + own("m")), own("m"), None, None, None]


def test_maps_and_words(spark):
    group = "_" + "a" * 40
    page = (
        f'<a class="x mw-kartographer-map" data-lat="1.5" data-lon="200" data-zoom="3" data-width="100" data-height="9" data-overlays="[&quot;{group}&quot;,&quot;b&quot;]">'
        '</a><a class="mw-kartographer-maplink">t</a>'
    )
    (maps,) = column(spark, [page], V.interactive_maps)
    assert [tuple(m) for m in maps] == [(1.5, None, 3, 100, 300, [group])]
    frame = spark.createDataFrame([("the cat.", "cat"), ("cats", "cat"), ("a.b", "a.b"), ("axb", "a.b"), ("x (y)", "(y)")], "t string, c string")
    assert [r[0] for r in frame.select(V.occurs_as_words("t", "c")).collect()] == [True, False, True, False, True]


def test_feeds_fail_closed(spark):
    def lines(*values):
        return spark.createDataFrame(list(enumerate(values, 1)), "line long, value string")

    good = '{"schema_version":1,"project":"enwiki","generation_id":"g","page_id":%d}'
    assert feeds.deletions(lines(good % 1, good % 2), "enwiki", "g").count() == 2
    for bad, code in ((good % 0, "InvalidRecord"), (good % 1, "DuplicateRecord"), (good % 3 + "\r", "InvalidTerminator"), ("{", "InvalidRecord")):
        with pytest.raises(LorekeepError, match=code):
            feeds.deletions(lines(good % 1, bad), "enwiki", "g")
    with pytest.raises(LorekeepError, match="MissingField"):
        feeds.regular_records(lines('{"name":"a","identifier":1,"version":{"identifier":2}}'), "g")


def test_census_order_over_tasks(spark, tmp_path):
    path = str(tmp_path / "census.txt")
    with open(path, "w") as out:
        out.write("\n".join(str(i) for i in range(1, 5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = dumps.line_numbers(spark, path)
        assert numbered.where("line <> cast(value as long)").count() == 0 and numbered.count() == 4999
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.range(1, 1001).select(F.col("id").alias("line"), F.when(F.col("id") == 500, 3).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in audit.not_increasing_overall(rows.repartition(7), "line", "k").collect()] == [(500, 3, 499)]


def test_component_join_rules(spark):
    schema = "project string, page_id long, revision_id long, generation_id string, payload string"

    def side(*rows):
        return spark.createDataFrame(list(rows), schema)

    good = [("enwiki", i, i + 10, "g", "x") for i in (1, 2)]
    assert joins.join_components(side(*good), side(*good), side(*good)).count() == 2
    wrong = {
        "InvalidIdentity": side(*good, ("EN", 3, 13, "g", "x")), "EmptyPayload": side(good[0], ("enwiki", 2, 12, "g", "")),
        "DuplicatePage": side(*good, good[0]), "MixedProject": side(*good, ("frwiki", 3, 13, "g", "x")),
        "GenerationMismatch": side(good[0], ("enwiki", 2, 12, "h", "x")), "DuplicateRevision": side(good[0], ("enwiki", 2, 11, "g", "x")),
        "MissingComponent": side(good[0]), "RevisionMismatch": side(good[0], ("enwiki", 2, 99, "g", "x")),
    }
    for code, structured in wrong.items():
        with pytest.raises(LorekeepError, match=code):
            joins.join_components(structured, side(*good), side(*good))
    with pytest.raises(LorekeepError, match="LiveTombstone"):
        joins.join_components(side(*good), side(*good), side(*good), spark.createDataFrame([("enwiki", 2, "g")], "project string, page_id long, generation_id string"))


def test_published_versions_and_index(spark, tmp_path):
    root = str(tmp_path / "index")
    articles = spark.createDataFrame([("enwiki", 1, "Red apple", "an apple a day"), ("enwiki", 2, "Pear", "no such fruit"), ("frwiki", 3, "Pomme", "apple")], "project string, page_id long, title string, text string")
    with pytest.raises(LorekeepError, match="NothingPublished"):
        published.current(spark, root)
    first = search_index.rebuild(articles, root)
    for project in (None, "enwiki"):
        got = [tuple(r) for r in search_index.top(spark, first, "apple pear", 5, project).collect()]
        assert got == [tuple(r) for r in search.full_text(articles, "apple pear", 5, project).collect()] and got
    with pytest.raises(LorekeepError, match="ForeignInIndex"):
        search_index.verify(spark, first, articles.where("page_id <> 3"))
    second = search_index.rebuild(articles.where("page_id = 2"), root)
    assert published.current(spark, root) == second
    version = second.rsplit("/", 1)[1]
    with pytest.raises(LorekeepError, match="VersionInUse"):
        published.remove(spark, root, version)
    digests = spark.createDataFrame([("d",)], "digest string")
    with pytest.raises(LorekeepError, match="MissingObject"):
        published.switch(spark, root, first.rsplit("/", 1)[1], digests, digests.where("false"))
    published.switch(spark, root, first.rsplit("/", 1)[1], digests, digests)
    assert published.current(spark, root) == first
    published.remove(spark, root, version)
    assert published.listed(spark, root).count() == 1

    def broken(folder):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        published.publish(spark, root, broken)
    assert published.current(spark, root) == first


def test_evidence_abstains_without_telling_words(spark):
    blocks = spark.createDataFrame(
        [("enwiki", 1, f"b{i}", "", t) for i, t in enumerate(["the gravity of it", "gravity is the law", "who is the gravity"])] + [("enwiki", 2, "c0", "", "the end")],
        "project string, page_id long, block_id string, heading string, text string",
    )
    assert grounding.retrieve(blocks, "who is the", 5, 100).count() == 0
    # a word of all blocks counts if the question has no other
    assert grounding.retrieve(blocks, "what is gravity", 5, 100).count() == 3
    assert [r["block_id"] for r in grounding.retrieve(blocks, "gravity law", 5, 100).collect()] == ["b1"]
    few = grounding.retrieve(blocks, "gravity", 5, 6).collect()
    assert len(few) == 1 and few[0]["budget_limited"]
    chosen = grounding.retrieve(blocks, "law", 5, 100, selection="the end").where("selected").collect()
    assert [r["block_id"] for r in chosen] == ["c0"]


def test_stale_links(spark):
    pages = spark.createDataFrame([(1, 11), (2, 12)], "page_id long, revision_id long")
    links = spark.createDataFrame([(1, 11, 2)], "from_id long, from_revision_id long, to_id long")
    base = pages.where("page_id = 1")
    assert sorted(tuple(r) for r in graph.expand_verified(base, pages, links, 1).collect()) == [(1, 11, 0), (2, 12, 1)]
    with pytest.raises(LorekeepError, match="StaleLinkRevision"):
        graph.expand_verified(base, pages, links.withColumn("from_revision_id", F.lit(9).cast("long")), 1)
    with pytest.raises(LorekeepError, match="NotMainspace"):
        graph.expand_verified(base, base, links, 1)
    with pytest.raises(LorekeepError, match="InconsistentBase"):
        graph.expand_verified(base.withColumn("revision_id", F.lit(5).cast("long")), pages, links, 1)


def test_protocol_relative_addresses_go():
    assert "evil" not in html.sanitize('<a href="//evil.example">x</a>')
    assert html.sanitize('<a href="/a">y</a>') == '<a href="/a">y</a>'
