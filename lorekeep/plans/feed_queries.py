"""Feeds, replies, sinks read again, the index on disk, keys, markers and state tables, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.lineage import scratch_dir
from lorekeep.operators import graph, media, state
from lorekeep.plans import adapters as A
from lorekeep.plans.search_queries import QUESTION, _fts_sql
from lorekeep.sources import dumps, feeds, published, search_index, sinks
from lorekeep.streaming import stream

_INDEXES: dict[tuple[str, str], str] = {}


def _new(spark, label):
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _index(spark, sf_dir):
    """The folder of the index over the article view, built, verified and published once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        root = _new(spark, "search-index")
        search_index.rebuild(A.articles(spark, sf_dir), root)
        _INDEXES[key] = published.current(spark, root)
    return _INDEXES[key]


def indexed_topk(spark, sf_dir):
    return search_index.top(spark, _index(spark, sf_dir), QUESTION, 20)


def indexed_project_topk(spark, sf_dir):
    return search_index.top(spark, _index(spark, sf_dir), QUESTION, 20, "frwiki")


def verified_search(spark, sf_dir):
    """Hits of the index that resolve to an article of the catalog, with its title and revision."""
    return search_index.verified_top(spark, _index(spark, sf_dir), A.articles(spark, sf_dir), QUESTION, 20)


def published_versions(spark, sf_dir):
    """Three versions of the parts are published, the first is made current again, the second removed; what a reader sees."""
    root = _new(spark, "published")
    parts = A.read(spark, sf_dir, "part").select("p_partkey", "p_size")
    for k in range(1, 4):
        published.publish(spark, root, lambda folder, k=k: parts.where(f"p_size % 3 = {k % 3}").write.parquet(folder))
    last, second, first = [r["version"] for r in published.listed(spark, root).collect()]
    published.switch(spark, root, first)
    published.remove(spark, root, second)
    here = published.listed(spark, root).agg(F.count(F.lit(1)).alias("versions"))
    return spark.read.parquet(published.current(spark, root)).crossJoin(F.broadcast(here))


def catalog_scan(spark, sf_dir):
    """A catalog written and read in the order of its keys: the first page of each project, and how many there are."""
    path = _new(spark, "catalog")
    sinks.write_catalog(A.articles(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("project").agg(
        F.count(F.lit(1)).alias("pages"), F.min(F.struct("page_id", "title")).alias("f"), F.max("page_id").alias("last")
    ).select("project", "pages", F.col("f.page_id").alias("first"), F.col("f.title").alias("title"), "last")


def census_round_trip(spark, sf_dir):
    """Order ids, moved by one, as a census text, and the text read and checked again."""
    path = _new(spark, "census")
    sinks.write_census(A.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select((F.col("l_orderkey") + 1).alias("id")), path)
    return dumps.read_census(dumps.line_numbers(spark, path)).select((F.col("id") - 1).alias("id"))


def object_store(spark, sf_dir):
    """Documents in a content-addressed store, read again: objects and bytes of each first digit."""
    path = _new(spark, "objects")
    sinks.write_objects(A.read(spark, sf_dir, "documents").select(F.encode("text", "UTF-8").alias("content")), path)
    stored = spark.read.schema("sha256 string, content binary, prefix string").parquet(path)
    return stored.groupBy(F.substring("sha256", 1, 1).alias("digit")).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.octet_length("content")).alias("bytes"))


def report_lines(spark, sf_dir):
    path = _new(spark, "report")
    sinks.write_report(A.read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "even").alias("note")), path)
    return spark.read.text(path)


def revision_scan(spark, sf_dir):
    """Revision records of documents as JSON lines, parsed and checked: schema, digest, time and order."""
    d = A.read(spark, sf_dir, "documents")
    record = F.struct(
        F.lit(1).alias("schema_version"), F.lit("enwiki").alias("project"), F.lit("2026-11-01").alias("generation_id"), (F.col("doc_id") + 1).alias("page_id"),
        F.lit(0).alias("namespace"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), (F.col("doc_id") + 5).alias("revision_id"),
        F.lit("2026-10-31T00:00:00Z").alias("timestamp"), F.col("text").alias("wikitext"), F.sha2("text", 256).alias("wikitext_sha256"),
    )
    lines = d.select((F.col("doc_id") + 1).alias("line"), F.to_json(record).alias("value"))
    return dumps.read_revisions(lines).select("page_id", "revision_id", F.octet_length("wikitext").alias("bytes"))


REVISION_BODY = """CASE p_partkey % 6
    WHEN 0 THEN concat('{"query":{"pages":[{"pageid":', cast(p_partkey as string), ',"ns":0,"title":"', p_name, '","revisions":[{"revid":', cast(p_partkey + 7 as string), ',"timestamp":"2026-10-01T02:03:04Z"}]}]}}')
    WHEN 1 THEN concat('{"query":{"redirects":["x"],"pages":[{"pageid":', cast(p_partkey as string), '}]}}')
    WHEN 2 THEN concat('{"query":{"pages":[{"pageid":', cast(p_partkey + 1 as string), ',"ns":0,"title":"x"}]}}')
    WHEN 3 THEN '{"query":{"pages":[{"missing":true}]}}' WHEN 4 THEN '{"query":'
    ELSE concat('{"query":{"pages":[{"pageid":', cast(p_partkey as string), ',"ns":0,"title":"x","revisions":[]}]}}') END"""


def revision_replies(spark, sf_dir):
    return feeds.revision_replies(A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.expr(REVISION_BODY).alias("body")))


RENDERED_BODY = """concat('{"parse":{"pageid":', cast(p_partkey as string), ',"revid":', cast(CASE WHEN p_size % 4 = 0 THEN p_size + 1 ELSE p_size END as string),
    ',"title":"', CASE WHEN p_size % 5 = 0 THEN 'other' ELSE p_name END, '","text":"', CASE WHEN p_size % 7 = 0 THEN ' ' ELSE '<p>x</p>' END, '"}}')"""


def rendered_replies(spark, sf_dir):
    parts = A.read(spark, sf_dir, "part")
    return feeds.rendered_replies(parts.select(F.col("p_partkey").alias("page_id"), F.col("p_size").cast("long").alias("revision_id"), F.col("p_name").alias("title"), F.expr(RENDERED_BODY).alias("body")))


MAP_BODY = """concat('{"query":{"pages":[{"pageid":', cast(CASE WHEN s_suppkey % 5 = 1 THEN s_suppkey + 1 ELSE s_suppkey END as string), ',"mapdata":["{\\\\"a\\\\":[{\\\\"k\\\\":1},{\\\\"k\\\\":',
    cast(s_suppkey as string), '}]}","{\\\\"', CASE WHEN s_suppkey % 5 = 2 THEN 'c' ELSE 'b' END, '\\\\":{\\\\"k\\\\":3}}"]}]}}')"""


def map_groups(spark, sf_dir):
    """Map groups of replies, of the page and exactly those asked for."""
    asked = F.when(F.col("s_suppkey") % 5 == 3, F.array(*map(F.lit, "abd"))).otherwise(F.array(*map(F.lit, "ab")))
    out = feeds.map_groups(A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), asked.alias("groups"), F.expr(MAP_BODY).alias("body")))
    return out.select("page_id", "group", F.array_join("features", ";").alias("features"), "fault")


def title_resolution(spark, sf_dir):
    """Pages that requested titles end at, through a normalisation and a redirect."""
    body = """concat('{"query":{"normalized":[{"from":"', lower(c_name), '","to":"', c_name, '"}],"redirects":[{"from":"', c_name, '","to":"', c_mktsegment, '"}],"pages":[{"pageid":',
        cast(c_custkey as string), ',"ns":0,"title":"', c_mktsegment, '"}]}}')"""
    return dumps.resolved_titles(A.read(spark, sf_dir, "customer").select(F.lower("c_name").alias("requested"), F.expr(body).alias("body")))


def image_information(spark, sf_dir):
    """Image information in the order of the request: one reply for each brand."""
    p = A.read(spark, sf_dir, "part")
    title = F.concat(F.lit("File:"), F.col("p_partkey").cast("string"))
    info = F.struct(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"), F.lit("image/png").alias("mime"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(title.alias("title"), F.array(info).alias("imageinfo"))).alias("pages")).alias("query")))
    return dumps.image_metadata(p.select(body.alias("body")), p.select(F.col("p_partkey").alias("place"), title.alias("title")))


def deletion_feed(spark, sf_dir):
    line = """concat('{"schema_version":1,"project":"enwiki","generation_id":"2026-11-01","page_id":', cast(s_suppkey + 1 as string), '}')"""
    return feeds.deletions(A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), F.expr(line).alias("value")), "enwiki", "2026-11-01", most=None)


def _regular(spark, sf_dir):
    body = """concat('{"name":"', c_name, '","identifier":', cast(c_custkey + 1 as string), ',"version":{"identifier":', cast(c_custkey + 9 as string),
        '},"date_modified":"2026-10-01T00:00:00Z","is_part_of":{"identifier":"enwiki"},"in_language":{"identifier":"en"},"namespace":{"identifier":0},"article_body":{"html":"<p>',
        c_mktsegment, '</p>"},"categories":[', CASE WHEN c_nationkey % 2 = 0 THEN concat('{"name":"Category:', c_mktsegment, '"}') ELSE '' END, '],"redirects":[]}')"""
    return feeds.regular_records(A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.expr(body).alias("value")), "2026-11-01")


def regular_companions(spark, sf_dir):
    return _regular(spark, sf_dir).select(
        "project", "page_id", "revision_id", "generation_id", "language", "namespace", "name", "html", F.array_join("categories", ";").alias("categories")
    )


def scoped_join(spark, sf_dir):
    """Structured and regular records of one project and generation, none of them deleted."""
    r = _regular(spark, sf_dir).select("project", "page_id", "revision_id", "generation_id", F.col("html").alias("payload"))
    gone = A.read(spark, sf_dir, "supplier").select(F.lit("enwiki").alias("project"), (-F.col("s_suppkey") - 1).alias("page_id"), F.lit("2026-11-01").alias("generation_id"))
    return feeds.join_scoped(r.withColumn("payload", F.upper("payload")), r, "enwiki", "2026-11-01", gone)


def title_keys(spark, sf_dir):
    """The keys that titles are compared by."""
    t = A.read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(' ', replace(p_name, ' ', '_')) WHEN 2 THEN concat(p_name, ' [1] [citation needed]  x') ELSE concat('ß', p_name) END").alias("t"))
    return t.select(
        "p_partkey", T.title_key("t").alias("key"), T.trimmed_title_key("t").alias("trimmed"), T.collision_key("t").alias("collision"), T.strip_markers("t").alias("bare")
    )


def cjk_tokens(spark, sf_dir):
    """Tokens of texts with runs of characters that are words of their own, as documents and as queries have them, and their cost."""
    t = A.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("重要性 "), "p_name", F.lit(" 日x")).alias("t"))
    return t.select(
        "p_partkey", F.array_join(T.index_tokens("t"), "|").alias("of_document"), F.array_join(T.query_tokens("t"), "|").alias("of_query"), T.word_cost("t").alias("cost")
    )


def draft_answers(spark, sf_dir):
    """Citation markers of answers, the answers without them, and what a reader sees of an unfinished one."""
    c = A.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("[[cite:a1]] so[[cite:b:2]] [[ci")).alias("t"))
    return c.select("conv_id", "turn", F.array_join(T.citation_markers("t"), ",").alias("cited"), F.octet_length(T.without_citations("t")).alias("bare"), F.octet_length(T.draft_text("t")).alias("draft"))


def image_kinds(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, ("89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "52494646AAAAAAAA57454250", "52494646AAAAAAAA41564920", "00"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return A.read(spark, sf_dir, "part").select("p_partkey", T.image_kind(F.concat(F.unhex(head), F.col("p_name").cast("binary"))).alias("kind"))


def hard_ids(spark, sf_dir):
    k = F.col("p_partkey")
    return A.read(spark, sf_dir, "part").select(
        "p_partkey", T.hex_id("wkf", F.lit("enwiki"), k, k + 1, F.col("p_name")).alias("footnote"), T.media_file_name(F.concat(F.lit("https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit(".png/120px-x.png"))).alias("file"),
        F.sha2(F.concat(T.framed_text(F.col("p_name")), T.big_endian(k)), 256).alias("transcript"),
    )


def guarded_visits(spark, sf_dir):
    """Visits that are kept: the setting has the expected value, after a swap that took place and one that did not."""
    settings = spark.createDataFrame([("consent", "no"), ("generation", "4")], "key string, value string")
    settings = state.compare_and_swap(settings, "consent", "no", "yes")
    settings = state.compare_and_swap(settings, "generation", "3", "5")
    visits = A.visits(spark, sf_dir).where("event_type = 'view'")
    kept = state.conditional(visits, settings, "consent", "yes").select("id", F.lit("consent").alias("rule"))
    return kept.unionByName(state.conditional(visits, settings, "generation", "5").select("id", F.lit("generation").alias("rule"))).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def registered_media(spark, sf_dir):
    """Owners after a batch that repeats some of them was registered, and one owner removed."""
    _, owners = A.registry(spark, sf_dir)
    after = media.register(owners.where("owner_id % 2 = 0"), owners.where("owner_id % 3 = 0"))
    return media.remove_owner(after, "pin", 6).groupBy("kind").agg(F.count(F.lit(1)).alias("owners"), F.countDistinct("digest").alias("digests"))


def clean_up_candidates(spark, sf_dir):
    """Unowned objects in order; more than the bound would be an error."""
    objects, owners = A.registry(spark, sf_dir)
    return state.bounded(media.unowned(objects, owners.where("kind = 'pin'")).select("digest", "bytes"), ["digest"], 1_000_000)


def _settings(spark):
    return spark.createDataFrame([("generation", "7"), ("keep_history", "true")], "key string, value string")


def cited_exchanges(spark, sf_dir):
    """Messages after the exchanges of some conversations were saved with their citations, all at one generation."""
    c = A.read(spark, sf_dir, "conversations").where("turn = 0 AND conv_id < 500")
    batch = c.select(
        F.col("conv_id").alias("exchange"), (F.col("conv_id") % 2 + 7).alias("generation"), F.lit("enwiki").alias("project"), (F.col("conv_id") + 1).alias("page_id"),
        F.lit(5).cast("long").alias("revision_id"), F.col("text").alias("question"), F.lit("yes").alias("answer"), F.array(F.lit("b0"), F.concat(F.lit("b"), F.col("conv_id").cast("string"))).alias("cited"),
    )
    threads = spark.createDataFrame([(3, "enwiki", 1, 1, "old")], "thread_id long, project string, page_id long, revision_id long, title string")
    messages = spark.createDataFrame([(8, 3, "user", "old")], "message_id long, thread_id long, role string, text string")
    cited = spark.createDataFrame([], "message_id long, place int, block_id string")
    t, m, k = state.save_exchanges(threads, messages, cited, batch, _settings(spark))
    per = k.groupBy("message_id").agg(F.count(F.lit(1)).alias("citations"))
    return m.join(t.select("thread_id", "page_id"), "thread_id").join(per, "message_id", "left").select("message_id", "thread_id", "role", "page_id", F.coalesce("citations", F.lit(0)).alias("citations"))


def saved_panel(spark, sf_dir):
    """Bookmarks and recent history in one consistent view."""
    v = A.visits(spark, sf_dir)
    marks = v.where("event_type = 'signup'").groupBy("page_id").agg(F.max("visited_at").alias("at"))
    seen = v.where("event_type = 'view'").groupBy("page_id").agg(F.max("visited_at").alias("at"))
    return state.saved_panel(marks, seen, _settings(spark), 7).withColumn("place", F.col("place").cast("long"))


def verified_related(spark, sf_dir):
    """Pages within two links of three suppliers, over links of the revisions at hand."""
    links = A.links(spark, sf_dir).withColumn("from_revision_id", F.col("from_id") + 1000)
    ids = links.select(F.col("from_id").alias("page_id")).unionByName(links.select(F.col("to_id").alias("page_id"))).distinct()
    mainspace = ids.withColumn("revision_id", F.col("page_id") + 1000)
    base = mainspace.where("page_id IN (3, 5, 7)")
    return graph.expand_verified(base, mainspace, links, 2, spark.createDataFrame([(9,)], "page_id long"), most_links=None).withColumn("hop", F.col("hop").cast("long"))


def selection_receipt(spark, sf_dir):
    """Pages of a topic with their revisions, and whether the digest of them depends on their order: it does not."""
    _, _, members = A.category_graph(spark, sf_dir)
    pages = members.select("page_id", (F.col("page_id") + 1000).alias("revision_id"))
    a, b = graph.receipt(pages, "x"), graph.receipt(pages.repartition(3, "revision_id").orderBy(F.desc("page_id")), "x")
    other = graph.receipt(pages.where("page_id <> 1"), "x").select(F.col("digest").alias("other"))
    return a.join(b.select(F.col("digest").alias("again")), F.col("digest") == F.col("again"), "left").crossJoin(other).select("pages", F.col("again").isNotNull().alias("same"), (F.col("other") != F.col("digest")).alias("told_apart"))


def streamed_firsts(spark, sf_dir):
    """Events without repeats of a key, as a stream sees them."""
    base = _new(spark, "stream")
    events = stream.read_table_stream(spark, sf_dir, "events").withColumn("pair", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    stream.run_available(stream.first_of_each(events, "pair", "3650 days").select("pair"), f"{base}/out", f"{base}/state")
    return spark.read.schema("pair string, batch long").parquet(f"{base}/out").select("pair")


def streamed_shard_audit(spark, sf_dir):
    """Shards whose ids stop increasing somewhere, as a stream of rows finds them: order lines by supplier."""
    base = _new(spark, "stream")
    rows = stream.read_table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("member"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("id")
    )
    stream.run_available(stream.audit_shards(rows), f"{base}/out", f"{base}/state", "update")
    out = spark.read.schema("member string, seen long, last_id long, poisoned boolean, batch long").parquet(f"{base}/out")
    return out.groupBy("member").agg(F.max_by(F.struct("seen", "last_id", "poisoned"), "batch").alias("s")).select("member", "s.*")


def streamed_frames(spark, sf_dir):
    """Event-stream frames of texts that were cut into chunks anywhere."""
    base = _new(spark, "stream")
    made = "CASE WHEN turn % 2 = 0 THEN 'data: ' ELSE 'event: x\r\ndata:' END || replace(text, chr(10), ' ') || chr(10) || chr(10)"
    chunk = A.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("stream"), "turn", F.expr(made).alias("t"))
    cut = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.expr("left(t, 7)").alias("c")), F.struct(F.lit(1).alias("k"), F.expr("substr(t, 8)").alias("c"))))
    path = f"{base}/in"
    chunk.select("stream", "turn", cut.alias("x")).select("stream", (F.col("turn") * 2 + F.col("x.k")).alias("seq"), F.col("x.c").alias("chunk")).write.parquet(path)
    frames = stream.decode_events(spark.readStream.schema("stream string, seq long, chunk string").parquet(path))
    stream.run_available(frames, f"{base}/out", f"{base}/state")
    return spark.read.schema("stream string, frame string, batch long").parquet(f"{base}/out").groupBy("stream").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("frame")).alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        indexed_topk, indexed_project_topk, verified_search, published_versions, catalog_scan, census_round_trip, object_store, report_lines,
        revision_scan, revision_replies, rendered_replies, map_groups, title_resolution, image_information, deletion_feed, regular_companions,
        scoped_join, title_keys, cjk_tokens, draft_answers, image_kinds, hard_ids, guarded_visits, registered_media, clean_up_candidates,
        cited_exchanges, saved_panel, verified_related, selection_receipt, streamed_firsts, streamed_shard_audit, streamed_frames,
    )
}

_T = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(' ', replace(p_name, ' ', '_')) WHEN 2 THEN concat(p_name, ' [1] [citation needed]  x') ELSE concat('ß', p_name) END"
_FIRST = "CASE WHEN {0}[1] = 'ß' THEN '{1}' ELSE upper({0}[1]) END || {0}[2:]"
_WORDS = A.tokens_sql("p_name")

ORACLE_SQL = {
    "indexed_topk": _fts_sql(""),
    "indexed_project_topk": _fts_sql("WHERE project = 'frwiki'"),
    "verified_search": f"SELECT project, page_id, score, title, page_id - 1 + 1000000 AS revision_id FROM ({_fts_sql('')}) JOIN (WITH {A.ARTICLES} SELECT project, page_id, title FROM articles) USING (project, page_id)",
    "published_versions": "SELECT p_partkey, p_size, 2 AS versions FROM part WHERE p_size % 3 = 1",
    "catalog_scan": f"WITH {A.ARTICLES} SELECT project, count(*) AS pages, min(page_id) AS first, arg_min(title, page_id) AS title, max(page_id) AS last FROM articles GROUP BY 1",
    "census_round_trip": "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45",
    "object_store": "SELECT sha256(text)[1:1] AS digit, count(*) AS objects, sum(strlen(text)) AS bytes FROM (SELECT DISTINCT text FROM documents) GROUP BY 1",
    "report_lines": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","note":' || CASE WHEN n_nationkey % 2 = 0 THEN '"even"' ELSE 'null' END || '}' AS value FROM nation""",
    "revision_scan": "SELECT doc_id + 1 AS page_id, doc_id + 5 AS revision_id, strlen(text) AS bytes FROM documents",
    "revision_replies": """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 = 0 AND p_partkey > 0 THEN p_name END AS title, CASE WHEN p_partkey % 6 = 0 AND p_partkey > 0 THEN p_partkey + 7 END AS revision_id,
        CASE WHEN p_partkey % 6 = 0 AND p_partkey > 0 THEN '2026-10-01T02:03:04Z' END AS timestamp,
        CASE WHEN p_partkey <= 0 THEN 'InvalidIdentity' ELSE [NULL, 'RedirectNeedsResolution', 'InvalidIdentity', 'MissingPage', 'InvalidResponse', 'InvalidResponse'][p_partkey % 6 + 1] END AS fault FROM part""",
    "rendered_replies": """WITH r AS (SELECT p_partkey AS page_id, CASE WHEN p_size % 5 = 0 THEN 'InvalidIdentity' WHEN p_size % 4 = 0 THEN 'RevisionChanged' WHEN p_size % 7 = 0 THEN 'InvalidResponse' END AS fault FROM part)
        SELECT page_id, CASE WHEN fault IS NULL THEN '<p>x</p>' END AS html, fault FROM r""",
    "map_groups": """SELECT s_suppkey AS page_id, g AS "group", CASE g WHEN 'a' THEN '{"k":1};{"k":' || s_suppkey || '}' ELSE '{"k":3}' END AS features, NULL AS fault
        FROM supplier, (VALUES ('a'), ('b')) v(g) WHERE s_suppkey % 5 IN (0, 4)
        UNION ALL SELECT s_suppkey, NULL, NULL, [NULL, 'WrongPage', 'GroupMismatch: c', 'GroupMismatch: d'][s_suppkey % 5 + 1] FROM supplier WHERE s_suppkey % 5 BETWEEN 1 AND 3""",
    "title_resolution": "SELECT lower(c_name) AS requested, c_mktsegment AS title, c_custkey AS page_id FROM customer",
    "image_information": "SELECT p_partkey AS place, 'File:' || p_partkey AS title, 'u' || p_partkey AS url, 'image/png' AS mime, sha1(p_name) AS sha1 FROM part",
    "deletion_feed": "SELECT 'enwiki' AS project, s_suppkey + 1 AS page_id, '2026-11-01' AS generation_id FROM supplier",
    "regular_companions": """SELECT 'enwiki' AS project, c_custkey + 1 AS page_id, c_custkey + 9 AS revision_id, '2026-11-01' AS generation_id, 'en' AS language, 0 AS namespace,
        c_name AS name, '<p>' || c_mktsegment || '</p>' AS html, CASE WHEN c_nationkey % 2 = 0 THEN 'Category:' || c_mktsegment ELSE '' END AS categories FROM customer""",
    "scoped_join": """SELECT 'enwiki' AS project, c_custkey + 1 AS page_id, c_custkey + 9 AS revision_id, '<P>' || upper(c_mktsegment) || '</P>' AS structured,
        '<p>' || c_mktsegment || '</p>' AS rendered, '<p>' || c_mktsegment || '</p>' AS categories FROM customer""",
    "title_keys": rf"""SELECT p_partkey, {_FIRST.format("s", chr(0xDF))} AS key, {_FIRST.format("trim(s)", "SS")} AS trimmed, s AS collision,
        trim(regexp_replace(regexp_replace(t, '\[[^\[\]]{{0,24}}\]', '', 'g'), '\s+', ' ', 'g')) AS bare FROM (SELECT *, replace(t, '_', ' ') AS s FROM (SELECT p_partkey, {_T} AS t FROM part))""",
    "cjk_tokens": f"""SELECT p_partkey, array_to_string(list_concat(list_concat(['重', '要', '性', '重要', '要性'], {_WORDS}), ['日', 'x']), '|') AS of_document,
        array_to_string(list_concat(list_concat(['重要', '要性'], {_WORDS}), ['日', 'x']), '|') AS of_query, len({_WORDS}) + 5 AS cost FROM part""",
    "draft_answers": "SELECT conv_id, turn, 'a1,b:2' AS cited, strlen(text) + 8 AS bare, strlen(text) + 4 AS draft FROM conversations",
    "image_kinds": "SELECT p_partkey, ['image/png', 'image/jpeg', 'image/gif', 'image/webp', NULL, NULL][p_partkey % 6 + 1] AS kind FROM part",
    "hard_ids": """SELECT p_partkey, 'wkf:enwiki:' || p_partkey || ':' || (p_partkey + 1) || ':' || lower(hex(encode(p_name))) AS footnote, p_name || '.png' AS file,
        sha256(unhex(lpad(to_hex(strlen(p_name)), 16, '0')) || encode(p_name) || unhex(lpad(to_hex(p_partkey), 16, '0'))) AS transcript FROM part""",
    "guarded_visits": "SELECT 'consent' AS rule, count(*) AS n FROM events WHERE event_type = 'view'",
    "registered_media": f"""WITH {A.REGISTRY} SELECT kind, count(*) AS owners, count(DISTINCT digest) AS digests FROM owners
        WHERE (owner_id % 2 = 0 OR owner_id % 3 = 0) AND NOT (kind = 'pin' AND owner_id = 6) GROUP BY 1""",
    "clean_up_candidates": f"WITH {A.REGISTRY} SELECT digest, bytes FROM objects WHERE digest NOT IN (SELECT digest FROM owners WHERE kind = 'pin')",
    "cited_exchanges": """WITH b AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS n FROM conversations WHERE turn = 0 AND conv_id < 500 AND conv_id % 2 = 0)
        SELECT 8 + 2 * n - 1 + k AS message_id, 3 + n AS thread_id, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END AS role, conv_id + 1 AS page_id, 2 * k AS citations
        FROM b, (VALUES (0), (1)) v(k) UNION ALL SELECT 8, 3, 'user', 1, 0""",
    "saved_panel": """WITH v AS (SELECT user_id AS page_id, event_type, max(ts) AS "at" FROM events GROUP BY 1, 2)
        SELECT CASE event_type WHEN 'signup' THEN 'bookmark' ELSE 'visit' END AS kind, row_number() OVER (PARTITION BY event_type ORDER BY "at" DESC, page_id) AS place, page_id, "at"
        FROM v WHERE event_type IN ('signup', 'view') QUALIFY place <= 100""",
    "verified_related": f"""WITH {A.LINKS}, b AS (SELECT unnest([3, 5, 7]) AS page_id),
        one AS (SELECT DISTINCT to_id AS page_id FROM links WHERE from_id IN (SELECT page_id FROM b) AND to_id NOT IN (3, 5, 7, 9)),
        two AS (SELECT DISTINCT to_id AS page_id FROM links WHERE from_id IN (SELECT page_id FROM one) AND to_id NOT IN (3, 5, 7, 9) AND to_id NOT IN (SELECT page_id FROM one))
        SELECT page_id, page_id + 1000 AS revision_id, 0 AS hop FROM b WHERE page_id IN (SELECT from_id FROM links UNION SELECT to_id FROM links)
        UNION ALL SELECT page_id, page_id + 1000, 1 FROM one UNION ALL SELECT page_id, page_id + 1000, 2 FROM two""",
    "selection_receipt": "SELECT count(DISTINCT c_custkey) AS pages, true AS same, true AS told_apart FROM customer",
    "streamed_firsts": "SELECT DISTINCT user_id || '-' || event_type AS pair FROM events",
    "streamed_shard_audit": """WITH r AS (
            SELECT l_suppkey::varchar AS member, l_orderkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n,
                   lag(l_orderkey, 1, 0) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS before FROM lineitem),
        bad AS (SELECT member, min(n) FILTER (id <= before) AS n FROM r GROUP BY 1)
        SELECT member, count(*) FILTER (bad.n IS NULL OR r.n < bad.n) AS seen, coalesce(max(id) FILTER (bad.n IS NULL OR r.n < bad.n), 0) AS last_id, any_value(bad.n) IS NOT NULL AS poisoned
        FROM r JOIN bad USING (member) GROUP BY 1""",
    "streamed_frames": "SELECT conv_id::varchar AS stream, count(*) AS frames, sum(length(text)) AS length FROM conversations GROUP BY 1",
}
