"""Selections with redirect identities, previews, back edges and reviewer lists over the driver's tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.lineage import save
from lorekeep.operators import graph, previews, worklist
from lorekeep.plans import adapters as A

#: Redirects have ids of their own, above those of pages.
BASE = 1_000_000_000_000
REVIEWERS = ["rev_a", "rev_b", "rev_c", "rev_d", "rev_e"]
ROOTS, DEPTH, LIMIT = ["Category:World"], 3, 1_000_000_000


def _topic(spark, sf_dir):
    """Customers as pages, suppliers in another namespace, parts as redirects in chains of up to six that end at orders' customers.

    Some categories name redirects too; some redirects are put in, others left out.
    """
    categories, children, members = A.category_graph(spark, sf_dir)
    here = F.lit("enwiki").alias("project"), F.lit("20261101").alias("generation")
    part, nation = A.read(spark, sf_dir, "part"), A.read(spark, sf_dir, "nation")
    pages = (
        A.read(spark, sf_dir, "customer").select(*here, F.col("c_custkey").alias("page_id"), (F.col("c_custkey") + 1000).alias("revision_id"), F.lit(0).alias("namespace"))
        .unionByName(A.read(spark, sf_dir, "supplier").select(*here, (F.col("s_suppkey") + 2 * BASE).alias("page_id"), F.col("s_suppkey").alias("revision_id"), F.lit(14).alias("namespace")))
    )
    key, last = F.col("p_partkey"), F.broadcast(part.agg(F.max("p_partkey").alias("last")))  # one row
    ends = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p_partkey"), "o_custkey")
    identities = part.crossJoin(last).join(ends, "p_partkey", "left").select(
        *here, (key + BASE).alias("from_id"),
        F.when((key % 7 != 0) & (key < F.col("last")), key + 1 + BASE).otherwise(F.coalesce("o_custkey", F.lit(1).cast("long"))).alias("to_id"),
    )
    named = part.where("p_size = 7").join(nation, key % 25 == F.col("n_nationkey"))
    members = members.unionByName(named.select(F.concat(F.lit("Category:"), "n_name").alias("name"), (key + BASE).alias("page_id")))
    asked = lambda size: part.where(F.col("p_size") == size).select((key + BASE).alias("page_id"))
    return pages, categories, children, members, previews.Rules(ROOTS, DEPTH, LIMIT, asked(3), asked(50), None, None), identities


def pinned_selection(spark, sf_dir):
    """Pages of a topic with their revisions, members, additions and exclusions followed through redirects."""
    return previews.select_pinned(*_topic(spark, sf_dir))[1]


def redirect_identities(spark, sf_dir):
    """Where all redirects of the generation end."""
    pages, *_, identities = _topic(spark, sf_dir)
    return previews.resolve_identities(identities, pages, None)


def related_preview(spark, sf_dir):
    """The selection of one page and of redirects, and customers within two links, over links of the revisions at hand."""
    pages, categories, children, members, rules, identities = _topic(spark, sf_dir)
    few = previews.Rules(ROOTS, 1, LIMIT, rules.include, rules.exclude, None, None)
    orders = A.read(spark, sf_dir, "orders")
    n = F.broadcast(A.read(spark, sf_dir, "customer").agg(F.max("c_custkey").alias("n")))  # one row
    links = orders.crossJoin(n).select(
        F.col("o_custkey").alias("from_id"), (F.col("o_custkey") + 1000).alias("from_revision_id"), (F.col("o_orderkey") % F.col("n") + 1).alias("to_id")
    )
    return previews.select_related(pages, categories, children, members, few, identities, links, 2).withColumn("hop", F.col("hop").cast("long"))


def selection_preview(spark, sf_dir):
    """Counts of the topic before anything is fetched."""
    return previews.preview(*_topic(spark, sf_dir))[0]


def preview_warnings(spark, sf_dir):
    """Additions whose ends are left out, and broad categories, of a topic whose nations lead back to regions."""
    pages, categories, children, members, rules, identities = _topic(spark, sf_dir)
    nation, region = A.read(spark, sf_dir, "nation"), A.read(spark, sf_dir, "region")
    back = nation.join(region, F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(
        F.concat(F.lit("Category:"), "n_name").alias("name"), F.concat(F.lit("Category:"), "r_name").alias("child")
    )
    return previews.preview(pages, categories, children.unionByName(back), members, rules, identities)[1].where("kind <> 'cycle' and kind <> 'more_cycles'")


def back_edges(spark, sf_dir):
    """The first eight back edges among brands, types and sizes of parts, in depth-first order."""
    part = A.read(spark, sf_dir, "part").withColumn("size", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    edges = part.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).unionByName(
        part.select(F.col("p_type").alias("src"), F.col("size").alias("dst"))
    ).unionByName(part.where("p_size > 40").select(F.col("size").alias("src"), F.col("p_brand").alias("dst")))
    return previews.back_edges(edges)[0].withColumn("place", F.col("place").cast("long"))


def reviewer_worklist(spark, sf_dir):
    """Two reviewers for each of three documents of every source and language, sampled in a seeded order."""
    docs = A.read(spark, sf_dir, "documents").where("lang is not null").select(
        F.col("lang").alias("project"), "source", (F.col("doc_id") + 1).alias("page_id"), F.coalesce("n_chars", F.lit(0).cast("long")).alias("revision_id")
    )
    sources = graph.ranked_sample(docs, 17, ["project", "source"], 3).select("project", "page_id", "revision_id").distinct()
    sources = save(sources, "roster")  # it is read for its size, its digest, its faults and the list
    return worklist.assign_reviewers(sources, REVIEWERS, worklist.roster_digest(sources))


QUERIES = {
    f.__name__: f
    for f in (pinned_selection, redirect_identities, related_preview, selection_preview, preview_warnings, back_edges, reviewer_worklist)
}

_MOVED = f"""identities AS (
    SELECT p_partkey + {BASE} AS from_id,
           CASE WHEN p_partkey % 7 <> 0 AND p_partkey < (SELECT max(p_partkey) FROM part) THEN p_partkey + 1 + {BASE} ELSE coalesce(o_custkey, 1) END AS to_id
    FROM part LEFT JOIN orders ON o_orderkey = p_partkey),
walk AS (
    SELECT from_id, to_id, 1 AS hops FROM identities
    UNION ALL SELECT w.from_id, i.to_id, w.hops + 1 FROM walk w JOIN identities i ON i.from_id = w.to_id),
moved AS (SELECT from_id, arg_max(to_id, hops) AS to_id, max(hops) AS hops FROM walk GROUP BY 1)"""
_MEMBERS = f"""named AS (
    SELECT * FROM members UNION ALL
    SELECT 'Category:' || n_name, p_partkey + {BASE} FROM part JOIN nation ON p_partkey % 25 = n_nationkey WHERE p_size = 7),
topic AS (  -- three levels reach all but what is under AFRICA, which is not entered
    SELECT 'Category:World' AS name, false AS administrative, 0 AS depth
    UNION ALL SELECT 'Category:' || r_name, r_name = 'AFRICA', 1 FROM region
    UNION ALL SELECT 'Category:' || n_name, false, 2 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'),
out_ids AS (SELECT to_id AS page_id FROM moved JOIN part ON from_id = p_partkey + {BASE} WHERE p_size = 50),
in_ids AS (SELECT from_id, to_id AS page_id FROM moved JOIN part ON from_id = p_partkey + {BASE} WHERE p_size = 3),
pinned AS (
    (SELECT coalesce(to_id, page_id) AS page_id FROM named JOIN topic USING (name) LEFT JOIN moved ON from_id = page_id WHERE NOT administrative
     UNION SELECT page_id FROM in_ids)
    EXCEPT SELECT page_id FROM out_ids)"""

ORACLE_SQL = {
    "redirect_identities": f"WITH RECURSIVE {_MOVED} SELECT * FROM moved",
    "pinned_selection": f"WITH RECURSIVE {A.GRAPH}, {_MOVED}, {_MEMBERS} SELECT page_id, page_id + 1000 AS revision_id FROM pinned",
    "related_preview": f"""WITH RECURSIVE {_MOVED},
        out_ids AS (SELECT to_id AS page_id FROM moved JOIN part ON from_id = p_partkey + {BASE} WHERE p_size = 50),
        links AS (SELECT DISTINCT o_custkey AS from_id, o_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS to_id FROM orders),
        zero AS (SELECT to_id AS page_id FROM moved JOIN part ON from_id = p_partkey + {BASE} WHERE p_size = 3 EXCEPT SELECT page_id FROM out_ids),
        one AS (SELECT to_id AS page_id FROM links JOIN zero ON from_id = page_id EXCEPT (SELECT page_id FROM zero UNION SELECT page_id FROM out_ids)),
        two AS (SELECT to_id AS page_id FROM links JOIN one ON from_id = page_id
                EXCEPT (SELECT page_id FROM zero UNION SELECT page_id FROM one UNION SELECT page_id FROM out_ids))
        SELECT page_id, page_id + 1000 AS revision_id, hop FROM (
            SELECT *, 0 AS hop FROM zero UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two)""",
    "selection_preview": f"""WITH RECURSIVE {A.GRAPH}, {_MOVED}, {_MEMBERS},
        fan AS (SELECT name, count(page_id) AS n FROM topic LEFT JOIN named USING (name) WHERE NOT administrative GROUP BY 1)
        SELECT (SELECT count(*) FROM pinned) AS selected, (SELECT count(*) FROM topic) AS visited,
               (SELECT count(*) FROM topic WHERE administrative) AS administrative, (SELECT sum(n)::bigint FROM fan) AS article_mentions,
               (SELECT count(*) FROM children JOIN topic USING (name) WHERE NOT administrative) AS child_mentions,
               (SELECT count(*) FROM part WHERE p_size = 3) AS included, (SELECT count(*) FROM part WHERE p_size = 50) AS excluded,
               (SELECT name FROM fan ORDER BY n DESC, name LIMIT 1) AS largest, (SELECT max(n) FROM fan) AS largest_articles""",
    "preview_warnings": f"""WITH RECURSIVE {_MOVED}
        SELECT 'suppressed' AS kind, from_id::varchar AS subject, to_id::varchar AS object, NULL::bigint AS n FROM moved JOIN part ON from_id = p_partkey + {BASE}
        WHERE p_size = 3 AND to_id IN (SELECT to_id FROM moved JOIN part ON from_id = p_partkey + {BASE} WHERE p_size = 50)""",
    # One row for each move of a depth-first walk; it ends after the eighth edge.
    "back_edges": """WITH RECURSIVE e AS (
            SELECT p_brand AS src, p_type AS dst FROM part UNION SELECT p_type, 'size ' || p_size FROM part
            UNION SELECT 'size ' || p_size, p_brand FROM part WHERE p_size > 40),
        kids AS (SELECT src, list(dst ORDER BY dst) AS below FROM e WHERE dst IN (SELECT src FROM e) GROUP BY 1),
        known AS (SELECT map(list(src), list(below)) AS m, list(src ORDER BY src) AS names FROM kids),
        walk AS (
            SELECT 0 AS step, []::varchar[] AS open, []::varchar[] AS tried, []::varchar[] AS done, []::varchar[] AS src, []::varchar[] AS dst, false AS finished
            UNION ALL
            SELECT step + 1,
                CASE WHEN len(open) = 0 THEN CASE WHEN root IS NULL THEN open ELSE [root] END
                     WHEN child IS NULL THEN open[:-2] WHEN list_contains(open, child) OR list_contains(done, child) THEN open ELSE list_append(open, child) END,
                CASE WHEN len(open) = 0 THEN CASE WHEN root IS NULL THEN tried ELSE [''] END
                     WHEN child IS NULL THEN tried[:-2] WHEN list_contains(open, child) OR list_contains(done, child) THEN list_append(tried[:-2], child)
                     ELSE list_append(list_append(tried[:-2], child), '') END,
                CASE WHEN len(open) > 0 AND child IS NULL THEN list_append(done, open[-1]) ELSE done END,
                CASE WHEN list_contains(open, child) THEN list_append(src, open[-1]) ELSE src END,
                CASE WHEN list_contains(open, child) THEN list_append(dst, child) ELSE dst END,
                len(open) = 0 AND root IS NULL
            FROM (SELECT w.*, list_filter(names, lambda x: NOT list_contains(done, x))[1] AS root,
                         list_filter(m[open[-1]], lambda x: x > tried[-1])[1] AS child FROM walk w, known)
            WHERE NOT finished AND len(src) < 8)
        SELECT unnest(range(1, len(src) + 1)) AS place, unnest(src) AS src, unnest(dst) AS dst FROM (SELECT * FROM walk ORDER BY step DESC LIMIT 1)""",
    "reviewer_worklist": f"""WITH RECURSIVE d AS (
            SELECT lang AS project, source, doc_id + 1 AS page_id, coalesce(n_chars, 0) AS revision_id FROM documents WHERE lang IS NOT NULL),
        s AS (SELECT DISTINCT project, page_id, revision_id FROM (
            SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY project, source
                ORDER BY sha256('17:' || project || ':' || page_id || ':' || revision_id), page_id, revision_id) <= 3)),
        r AS (SELECT sha256(string_agg(i, chr(10) ORDER BY i)) AS receipt FROM (SELECT project || ':' || page_id || ':' || revision_id AS i FROM s)),
        o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY page_id, revision_id) AS n FROM s),
        ids AS (SELECT {REVIEWERS!r} AS names),
        walk AS (
            SELECT DISTINCT project, 0::bigint AS n, NULL::bigint AS page_id, NULL::bigint AS revision_id, list_transform(names, lambda x: 0::bigint) AS loads,
                   NULL::bigint AS a, NULL::bigint AS b FROM s, ids
            UNION ALL
            SELECT project, n, page_id, revision_id, list_transform(range(1, len(loads) + 1), lambda i: loads[i] + CASE WHEN i IN (pair[1].i, pair[2].i) THEN 1 ELSE 0 END),
                   pair[1].i, pair[2].i
            FROM (SELECT w.project, o.n, o.page_id, o.revision_id, w.loads,
                         list_sort(list_transform(range(1, len(names) + 1), lambda i: {{'load': w.loads[i],
                             'd': sha256(receipt || ':' || o.project || ':' || o.page_id || ':' || o.revision_id || ':' || names[i]), 'i': i}}))[1:2] AS pair
                  FROM walk w JOIN o ON o.project = w.project AND o.n = w.n + 1, r, ids))
        SELECT project, page_id, revision_id, names[a] AS first, names[b] AS second, loads[a] AS first_load, loads[b] AS second_load FROM walk, ids WHERE n > 0""",
}
