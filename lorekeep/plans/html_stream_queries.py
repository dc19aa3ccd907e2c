"""Rendered pages, feeds and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep.functions import html
from lorekeep.functions import text as T
from lorekeep.lineage import scratch_dir
from lorekeep.operators import evaluate, graph
from lorekeep.plans import adapters as A
from lorekeep.sources import dumps
from lorekeep.streaming import stream


SEEN = """<img src="/i/{0}.png" srcset="https://cdn.example/a.png 1x, https://cdn.example/b.png 2x"><video poster="/p.jpg"></video><p style="background: url('/bg.png')"><img src="data:x"><a href="/no.png">"""


def visual_inventory(spark, sf_dir):
    """Visual references of pages that each got an image, a set of images, a poster and a background."""
    first, last = SEEN.split("{0}")
    seen = F.concat("html", F.lit(first), F.col("page_id").cast("string"), F.lit(last))
    return html.visual_inventory(A.read(spark, sf_dir, "pages").select("page_id", "url", seen.alias("html")))


def extracted_blocks(spark, sf_dir):
    return html.extract_blocks(A.read(spark, sf_dir, "pages"))


def page_structure(spark, sf_dir):
    return html.summarize(A.read(spark, sf_dir, "pages"))


def page_hosts(spark, sf_dir):
    """Pages by host and first path segment."""
    path = F.split(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "/")
    return A.read(spark, sf_dir, "pages").groupBy(
        F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"), F.coalesce(F.get(path, F.lit(1)), F.lit("")).alias("segment")
    ).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first"))


def render_fidelity(spark, sf_dir):
    """Totals of the comparison of two renderings: here, order lines of two return flags for each part."""
    l = A.read(spark, sf_dir, "lineitem")
    n = l.groupBy("l_partkey").agg(
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("r"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("n"),
        F.countDistinct("l_suppkey").alias("s"), F.count(F.lit(1)).alias("c"),
    )
    return evaluate.fidelity(
        n.select(
            (F.col("s") / F.col("c")).alias("heading_ratio"), (F.least("r", "n") / F.greatest(F.lit(1), F.greatest("r", "n"))).alias("link_jaccard"),
            (F.col("r") - F.col("n")).alias("image_delta"), (F.col("c") - 30).alias("table_delta"),
        )
    )


def checksum_inventory(spark, sf_dir):
    """An inventory of shard files, written as checksum lines and parsed again, with declared ranges."""
    first = F.col("p_partkey") * 100 + 1
    name = F.concat(F.lit("enwiki-20261101-p"), first.cast("string"), F.lit("p"), (first + 99).cast("string"), F.lit(".xml.bz2"))
    lines = A.read(spark, sf_dir, "part").select(F.concat(F.sha2("p_name", 256), F.lit("  "), name).alias("value"))
    return dumps.check_export(dumps.parse_checksums(lines))


def search_reply_hits(spark, sf_dir):
    """Hits of search replies as the service sends them, one reply a nation."""
    s = A.read(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.lit(0).alias("ns"), F.col("s_name").alias("title"), (F.col("s_suppkey") + 1).alias("pageid")).alias("h"))
    body = F.to_json(F.struct(F.struct(F.array_sort(F.collect_list("h")).alias("search")).alias("query")))
    return dumps.search_hits(s.groupBy(F.col("s_nationkey").alias("request")).agg(body.alias("body")), 3).select("request", F.col("place").cast("long").alias("place"), "title", "page_id")


def streamed_windows(spark, sf_dir):
    """Hourly counts by type from the event stream, as the stream's final update leaves them."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = stream.windowed_counts(stream.read_table_stream(spark, sf_dir, "events"), delay="3650 days")
    stream.run_available(counts, f"{base}/out", f"{base}/state", "update")
    rows = spark.read.schema("start timestamp, event_type string, n long, batch long").parquet(f"{base}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sanitized_pages(spark, sf_dir):
    return html.sanitize_pages(A.read(spark, sf_dir, "pages"))


def strata_cover(spark, sf_dir):
    """Per project, labelled pages chosen greedily until all strata (source and quality) are covered."""
    labels = A.read(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("page_id"), "quality", "toxic")
    source = A.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("page_id"), "source")
    strata = F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")), F.col("source"))
    rows = A.articles(spark, sf_dir).drop("text", "title").join(labels, "page_id").join(source, "page_id")
    return graph.greedy_cover(rows.withColumn("strata", strata), "project", 17).select("project", "page_id", "round")


def topic_digest(spark, sf_dir):
    """One digest of each nation's members, whatever their order."""
    _, _, members = A.category_graph(spark, sf_dir)
    return members.groupBy("name").agg(T.id_list_digest(F.collect_set("page_id"), "topic/v1").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        visual_inventory, extracted_blocks, page_structure, page_hosts, render_fidelity, checksum_inventory, search_reply_hits, streamed_windows,
        sanitized_pages, strata_cover, topic_digest,
    )
}

ORACLE_SQL = {
    "visual_inventory": """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host FROM pages)
        SELECT page_id, 'image' AS kind, host || '/i/' || page_id || '.png' AS url FROM p
        UNION ALL SELECT page_id, k, host || u FROM p, (VALUES ('poster', '/p.jpg'), ('css', '/bg.png')) v(k, u)
        UNION ALL SELECT page_id, 'srcset', 'https://cdn.example/' || u FROM p, (VALUES ('a.png'), ('b.png')) v(u)""",
    "topic_digest": f"""WITH {A.GRAPH} SELECT name, sha256(encode('topic/v1') || unhex(lpad(to_hex(count(DISTINCT page_id)), 16, '0'))
        || unhex(string_agg(DISTINCT lpad(to_hex(page_id), 16, '0'), '' ORDER BY lpad(to_hex(page_id), 16, '0')))) AS digest FROM members GROUP BY 1""",
    "page_hosts": r"""SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host,
        coalesce(string_split(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/')[2], '') AS segment, count(*) AS pages, min(page_id) AS first FROM pages GROUP BY 1, 2""",
    "render_fidelity": """WITH n AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS n,
            count(DISTINCT l_suppkey) AS s, count(*) AS c FROM lineitem GROUP BY 1)
        SELECT count(*) AS pages, round(avg(s / c), 9) AS heading_ratio, round(avg(least(r, n) / greatest(1, r, n)), 9) AS link_jaccard,
               count(*) FILTER (r <> n) AS pages_with_image_delta, count(*) FILTER (c <> 30) AS pages_with_table_delta,
               sum(greatest(0, n - r)) AS missing_images FROM n""",
    "checksum_inventory": """SELECT 'enwiki-20261101-p' || (p_partkey * 100 + 1) || 'p' || (p_partkey * 100 + 100) || '.xml.bz2' AS relative_path,
        sha256(p_name) AS sha256, p_partkey * 100 + 1 AS start, p_partkey * 100 + 100 AS "end" FROM part""",
    "search_reply_hits": """SELECT s_nationkey AS request, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1 AS place, s_name AS title,
        s_suppkey + 1 AS page_id FROM supplier QUALIFY place < 3""",
    "streamed_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
