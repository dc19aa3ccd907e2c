"""Joins, audits, set operations and window equivalents over the driver's tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import audit, joins
from lorekeep.plans import adapters as A

GENERATION = "2026-11-01"


def _expected(spark, sf_dir):
    return A.read(spark, sf_dir, "orders").select("o_orderkey")


def census_diff(spark, sf_dir):
    """Orders against those of late order lines: what is missing or unexpected, with examples."""
    observed = A.read(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1995-06-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.census_diff(_expected(spark, sf_dir).where("o_orderkey % 5 <> 0"), observed, "o_orderkey").select(
        "missing", "unexpected", F.concat_ws(",", "missing_ids").alias("missing_ids"), F.concat_ws(",", "unexpected_ids").alias("unexpected_ids")
    )


def census_counts_by_shard(spark, sf_dir):
    """Observed ids per shard: count, first and last, and gaps in between."""
    ids = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    return ids.groupBy(F.floor(F.col("id") / 1000).alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"),
        (F.max("id") - F.min("id") + 1 - F.count(F.lit(1))).alias("gaps"),
    )


def order_violations(spark, sf_dir):
    """Order lines whose part doesn't exceed the one before in its order."""
    lines = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return audit.not_increasing(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


def shard_overlaps(spark, sf_dir):
    """Page ranges that overlap an earlier one: the parts that each supplier's order lines span."""
    ranges = A.read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("start"), F.max("l_partkey").alias("end"))
    nation = A.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return audit.overlaps(ranges.join(nation, "l_suppkey"), "start", "end", "s_nationkey", "l_suppkey").select("l_suppkey", "s_nationkey", "start", "end", "furthest")


def shard_membership(spark, sf_dir):
    """Order lines outside the range that their shard declares."""
    lines = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.floor(F.col("l_orderkey") / 1000).alias("shard"))
    ranges = lines.select("shard").distinct().select("shard", (F.col("shard") * 1000 + 10).alias("start"), (F.col("shard") * 1000 + 900).alias("end"))
    return audit.outside_range(lines, ranges, "shard", "id", "start", "end").groupBy("shard").agg(F.count(F.lit(1)).alias("outside"))


def frame_offsets(spark, sf_dir):
    """Byte offset of each document's frame in its source's shard."""
    frames = A.read(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return audit.running_offsets(frames, "source", "doc_id", "size")


def index_membership_audit(spark, sf_dir):
    """Index rows against the catalog: labels without document and documents without label, by side."""
    docs = A.read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    labels = A.read(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    side = F.when(F.col("l").isNull(), "unlabelled").when(F.col("d").isNull(), "dangling").otherwise("both")
    return docs.join(labels, "doc_id", "full_outer").groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )


def _components(spark, sf_dir):
    revision, generation = (F.col("page_id") + 1_000_000).alias("revision_id"), F.lit(GENERATION).alias("generation_id")
    labels = A.read(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("page_id"), F.concat_ws("/", "quality", "toxic").alias("payload"))
    ids = labels.select("page_id")
    structured = A.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("page_id"), F.concat("source", F.lit("#"), F.col("n_chars").cast("string")).alias("payload"))
    rendered = A.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("page_id"), F.md5(F.encode("text", "UTF-8")).alias("payload"))

    def shaped(df):
        return df.select(F.lit("enwiki").alias("project"), "page_id", revision, generation, "payload")

    return shaped(structured.join(ids, "page_id", "left_semi")), shaped(rendered.join(ids, "page_id", "left_semi")), shaped(labels)


def component_join(spark, sf_dir):
    """Three-way exact join of documents, their digests and labels; any gap is an error."""
    return joins.join_components(*_components(spark, sf_dir))


def component_join_tombstones(spark, sf_dir):
    """The same, checked against tombstones of another generation, which don't count."""
    s, r, c = _components(spark, sf_dir)
    dead = s.limit(5).select("project", "page_id", F.lit("2026-10-01").alias("generation_id"))
    return joins.join_components(s, r, c, dead).select("page_id", "revision_id")


def pair_mismatches(spark, sf_dir):
    """Orders and the orders of their last lines as record pairs: the first field that differs."""
    orders = A.read(spark, sf_dir, "orders")
    base = (F.lit("enwiki").alias("project"), F.lit("g").alias("generation_id"), F.lit(0).alias("namespace"), F.lit("en").alias("language"))
    s = orders.select(F.col("o_orderkey").alias("page_id"), F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("revision_id"), F.col("o_orderstatus").alias("date_modified"), *base)
    r = orders.where("o_orderkey % 10 <> 1").select(
        F.col("o_orderkey").alias("page_id"),
        F.when(F.col("o_orderkey") % 10 == 2, "other").otherwise(F.col("o_orderpriority")).alias("name"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0)).alias("revision_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("date_modified"), *base,
    )
    return joins.pair_mismatches(s, r).select("page_id", "mismatch")


def link_targets(spark, sf_dir):
    """Links to nations by percent-encoded names, resolved to pages by title key."""
    nation = A.read(spark, sf_dir, "nation")
    titles = nation.select(F.lit("enwiki").alias("project"), F.col("n_name").alias("title"), (F.col("n_nationkey") + 1).alias("page_id"))
    links = A.read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.lit("enwiki").alias("project"), F.col("s_suppkey").alias("from_id"), F.replace("n_name", F.lit(" "), F.lit("%20")).alias("target")
    )
    return joins.resolve_links(links, titles).select("from_id", "to_id")


def _title_tables(spark, sf_dir):
    titles = A.read(spark, sf_dir, "part").select(F.lit("enwiki").alias("project"), F.col("p_name").alias("title"), F.col("p_partkey").alias("page_id"))
    aliases = A.read(spark, sf_dir, "part").select(F.lit("enwiki").alias("project"), F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string")).alias("alias"), F.col("p_partkey").alias("page_id"))
    return titles, aliases


def title_index(spark, sf_dir):
    return joins.title_index(*_title_tables(spark, sf_dir)).select("key", "page_id", "is_alias")


def title_conflicts(spark, sf_dir):
    return joins.title_conflicts(joins.title_index(*_title_tables(spark, sf_dir))).select("key", "pages", "first_page")


def titles_to_pages(spark, sf_dir):
    """Requested titles, in request order, with their page over one redirect at most; missing ones stay, marked."""
    part = A.read(spark, sf_dir, "part")
    wanted = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("asked")).agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("at"))
    hop = A.redirects(spark, sf_dir).select(F.col("from_id").alias("asked"), "to_id")
    target = F.coalesce("to_id", "asked")
    pages = part.where("p_size > 10").select(F.col("p_partkey").alias("page_id"), "p_name")
    return wanted.join(hop, "asked", "left").withColumn("page_id", target).join(pages, "page_id", "left").select(
        "asked", "page_id", "p_name", F.col("p_name").isNull().alias("missing"), F.col("at.l_orderkey").alias("first_order")
    )


def redirect_alias_bodies(spark, sf_dir):
    """Names of the pages that lead to each page directly, appended in order."""
    names = A.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("from_id"), "p_name")
    return A.redirects(spark, sf_dir).join(names, "from_id").groupBy(F.col("to_id").alias("page_id")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("from_id", "p_name"))), lambda s: s["p_name"])).alias("aliases")
    )


def title_orphans(spark, sf_dir):
    """Title rows whose page is not in the catalog: parts that no order line has."""
    part = A.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return audit.orphans(part, A.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), ["p_partkey"])


def include_exclude(spark, sf_dir):
    """(included pages or members) without excluded ones; exclusion wins."""
    member = A.read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("page_id"))
    include = A.read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("page_id"))
    exclude = A.read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("page_id"))
    return member.unionByName(include).distinct().join(exclude, "page_id", "left_anti")


def link_set_drift(spark, sf_dir):
    """Suppliers of each part by return flag: Jaccard of the two sets, missing and unexpected ones. Empty sets are equal."""
    def suppliers(flag):
        return F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))

    sets = A.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(suppliers("R").alias("a"), suppliers("N").alias("b"))
    union = F.size(F.array_union("a", "b"))
    return sets.select(
        "l_partkey",
        F.round(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union), 9).alias("jaccard"),
        F.size(F.array_except("a", "b")).cast("long").alias("missing"), F.size(F.array_except("b", "a")).cast("long").alias("unexpected"),
    )


def shard_names(spark, sf_dir):
    """Supplied against expected shard names, both ways."""
    expected = A.read(spark, sf_dir, "documents").select("source").distinct()
    supplied = A.read(spark, sf_dir, "documents").where("lang = 'es' AND length(source) % 2 = 0").select("source").distinct().unionByName(
        A.read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.lower("n_name").alias("source"))
    )
    left = expected.join(supplied, "source", "left_anti").withColumn("side", F.lit("missing"))
    return left.unionByName(supplied.join(expected, "source", "left_anti").withColumn("side", F.lit("unexpected")))


def exact_bijection(spark, sf_dir):
    """Bindings of image to object that are not one to one: order lines of quantity 50 as (part, supplier)."""
    pairs = A.read(spark, sf_dir, "lineitem").where("l_quantity = 50").select("l_partkey", "l_suppkey").distinct()
    many = pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("objects"))
    return many.where("objects > 1")


def positional_shards(spark, sf_dir):
    """Inventory against observed shards by position: the names at each place, and whether they agree."""
    def placed(df, name):
        w = Window.partitionBy("lang").orderBy("source")
        return df.select("lang", "source", F.row_number().over(w).alias("place")).withColumnRenamed("source", name)

    d = A.read(spark, sf_dir, "documents")
    a = placed(d.select("lang", "source").distinct(), "expected")
    b = placed(d.where("n_chars > 3000").select("lang", "source").distinct(), "observed")
    return a.join(b, ["lang", "place"], "full_outer").select("lang", "place", "expected", "observed", F.col("expected").eqNullSafe(F.col("observed")).alias("agree"))


def citation_membership(spark, sf_dir):
    """Cited benchmark texts that no document holds word for word."""
    from lorekeep.plans.search_queries import _gold

    items = A.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    return audit.orphans(items, _gold(spark, sf_dir).select("case_id"), ["case_id"])


def article_validation(spark, sf_dir):
    """Documents by the first rule they break: key, title, length; ``valid`` if none."""
    a = A.articles(spark, sf_dir)
    broken = (
        F.when(~T.valid_article_key("project", "page_id"), "InvalidKey").when(~T.valid_title("title"), "InvalidTitle")
        .when(F.octet_length("text") > 32_000, "TooLong").otherwise("valid")
    )
    return a.groupBy(broken.alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


def content_digests(spark, sf_dir):
    """SHA-256 and framed transcript digest of every document."""
    framed = F.concat(T.big_endian(F.col("doc_id")), T.framed_text(F.col("text")))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha2(framed, 256).alias("transcript"))


def seeded_order(spark, sf_dir):
    """The first three documents of each stratum (language and label) in the order of a seed's SHA-256."""
    from lorekeep.operators.graph import ranked_sample

    rows = A.articles(spark, sf_dir).join(A.read(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("page_id"), "quality"), "page_id")
    return ranked_sample(rows, 17, ["project", "quality"], 3).select("project", "quality", "page_id", "rank", F.col("place").cast("long").alias("place"))


QUERIES = {
    f.__name__: f
    for f in (
        census_diff, census_counts_by_shard, order_violations, shard_overlaps, shard_membership, frame_offsets,
        index_membership_audit, component_join, component_join_tombstones, pair_mismatches, link_targets, title_index,
        title_conflicts, titles_to_pages, redirect_alias_bodies, title_orphans, include_exclude, link_set_drift,
        shard_names, exact_bijection, positional_shards, citation_membership, article_validation, content_digests, seeded_order,
    )
}

_TITLES = """keys AS (
    SELECT upper(replace(p_name, '_', ' ')[1]) || replace(p_name, '_', ' ')[2:] AS key, p_partkey AS page_id, false AS is_alias FROM part
    UNION ALL SELECT replace(p_brand || '_' || p_size, '_', ' '), p_partkey, true FROM part),
idx AS (SELECT key, page_id, bool_and(is_alias) AS is_alias FROM keys GROUP BY 1, 2)"""

ORACLE_SQL = {
    "census_diff": """WITH e AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0),
        o AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'),
        m AS (SELECT id FROM e EXCEPT SELECT id FROM o), u AS (SELECT id FROM o EXCEPT SELECT id FROM e)
        SELECT (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM u) AS unexpected,
               coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM m ORDER BY id LIMIT 12)), '') AS missing_ids,
               coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM u ORDER BY id LIMIT 12)), '') AS unexpected_ids""",
    "census_counts_by_shard": """SELECT id // 1000 AS shard, count(*) AS n, min(id) AS first, max(id) AS last, max(id) - min(id) + 1 - count(*) AS gaps
        FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) GROUP BY 1""",
    "order_violations": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous
        FROM lineitem QUALIFY l_partkey <= previous""",
    "shard_overlaps": """WITH r AS (SELECT l_suppkey, min(l_partkey) AS start, max(l_partkey) AS "end" FROM lineitem GROUP BY 1)
        SELECT l_suppkey, s_nationkey, start, "end", max("end") OVER (PARTITION BY s_nationkey ORDER BY start, "end", l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest
        FROM r JOIN supplier ON s_suppkey = l_suppkey QUALIFY start <= furthest""",
    "shard_membership": """SELECT l_orderkey // 1000 AS shard, count(*) AS outside FROM lineitem
        WHERE l_orderkey % 1000 < 10 OR l_orderkey % 1000 > 900 GROUP BY 1""",
    "frame_offsets": """SELECT source, doc_id, strlen(text) AS size,
        coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM documents""",
    "index_membership_audit": """SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN d.doc_id IS NULL THEN 'dangling' ELSE 'both' END AS side,
        count(*) AS n, min(coalesce(d.doc_id, l.doc_id)) AS first, max(coalesce(d.doc_id, l.doc_id)) AS last
        FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    "component_join": """SELECT 'enwiki' AS project, doc_id + 1 AS page_id, doc_id + 1000001 AS revision_id, source || '#' || n_chars AS structured,
        md5(text) AS rendered, quality || '/' || toxic AS categories FROM documents JOIN labels USING (doc_id)""",
    "component_join_tombstones": "SELECT doc_id + 1 AS page_id, doc_id + 1000001 AS revision_id FROM documents JOIN labels USING (doc_id)",
    "pair_mismatches": """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 10 = 1 THEN 'Missing' WHEN o_orderkey % 10 = 2 THEN 'name'
        WHEN o_orderkey % 10 = 3 THEN 'revision_id' WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'X' THEN 'date_modified' END AS mismatch
        FROM orders WHERE o_orderkey % 10 IN (1, 2, 3) OR o_orderkey % 4 = 0""",
    "link_targets": "SELECT s_suppkey AS from_id, s_nationkey + 1 AS to_id FROM supplier",
    "title_index": f"WITH {_TITLES} SELECT * FROM idx",
    "title_conflicts": f"WITH {_TITLES} SELECT key, count(*) AS pages, min(page_id) AS first_page FROM idx GROUP BY 1 HAVING count(*) > 1",
    "titles_to_pages": f"""WITH {A.REDIRECTS}, w AS (SELECT l_partkey AS asked, min(l_orderkey) AS first_order FROM lineitem GROUP BY 1)
        SELECT asked, coalesce(to_id, asked) AS page_id, p_name, p_name IS NULL AS missing, first_order FROM w
        LEFT JOIN redirects ON from_id = asked LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = coalesce(to_id, asked)""",
    "redirect_alias_bodies": f"WITH {A.REDIRECTS} SELECT to_id AS page_id, string_agg(p_name, ' ' ORDER BY from_id) AS aliases FROM redirects JOIN part ON p_partkey = from_id GROUP BY 1",
    "title_orphans": "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "include_exclude": """(SELECT c_custkey AS page_id FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 200000)
        EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
    "link_set_drift": """WITH s AS (SELECT l_partkey, coalesce(list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R')), []) AS a,
            coalesce(list_distinct(list(l_suppkey) FILTER (l_returnflag = 'N')), []) AS b FROM lineitem GROUP BY 1),
        c AS (SELECT l_partkey, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM s)
        SELECT l_partkey, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE i::double / (na + nb - i) END, 9) AS jaccard, na - i AS missing, nb - i AS unexpected FROM c""",
    "shard_names": """WITH e AS (SELECT DISTINCT source FROM documents), s AS (SELECT source FROM documents WHERE lang = 'es' AND length(source) % 2 = 0 UNION SELECT lower(n_name) FROM nation WHERE n_nationkey < 3)
        SELECT source, 'missing' AS side FROM (SELECT source FROM e EXCEPT SELECT source FROM s)
        UNION ALL SELECT source, 'unexpected' FROM (SELECT source FROM s EXCEPT SELECT source FROM e)""",
    "exact_bijection": "SELECT l_partkey, count(DISTINCT l_suppkey) AS objects FROM lineitem WHERE l_quantity = 50 GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
    "positional_shards": """WITH a AS (SELECT lang, source AS expected, row_number() OVER (PARTITION BY lang ORDER BY source) AS place FROM (SELECT DISTINCT lang, source FROM documents)),
        b AS (SELECT lang, source AS observed, row_number() OVER (PARTITION BY lang ORDER BY source) AS place FROM (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 3000))
        SELECT lang, place, expected, observed, expected IS NOT DISTINCT FROM observed AS agree FROM a FULL JOIN b USING (lang, place)""",
    "citation_membership": "SELECT item_id AS case_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))",
    "article_validation": f"""WITH {A.ARTICLES} SELECT CASE WHEN NOT regexp_full_match(project, '[a-z]([a-z0-9_]*[a-z0-9])?') OR page_id <= 0 THEN 'InvalidKey'
        WHEN title = '' OR strlen(title) > 4096 OR trim(title) <> title OR regexp_matches(title, '[[:cntrl:]]') THEN 'InvalidTitle'
        WHEN strlen(text) > 32000 THEN 'TooLong' ELSE 'valid' END AS rule, count(*) AS n, min(page_id) AS first FROM articles GROUP BY 1""",
    "content_digests": """SELECT doc_id, sha256(text) AS sha256,
        sha256(unhex(lpad(to_hex(doc_id), 16, '0')) || unhex(lpad(to_hex(strlen(text)), 16, '0')) || encode(text)) AS transcript FROM documents""",
    "seeded_order": f"""WITH {A.ARTICLES}, r AS (SELECT project, quality, page_id, sha256('17:' || project || ':' || page_id || ':' || revision_id) AS rank
            FROM articles JOIN labels ON doc_id + 1 = page_id)
        SELECT project, quality, page_id, rank, row_number() OVER (PARTITION BY project, quality ORDER BY rank, page_id) AS place FROM r QUALIFY place <= 3""",
}
