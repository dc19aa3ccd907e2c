"""Graphs, media registry, conversations and user state over the driver's tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import audit, evaluate, graph, media, state
from lorekeep.plans import adapters as A


def topic_selection(spark, sf_dir):
    """Pages of the world's categories within three levels, canonical, without excluded ones."""
    cats, children, members = A.category_graph(spark, sf_dir)
    exclude = A.read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("page_id"))
    include = A.read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("page_id"))
    return graph.select_topic(cats, children, members, ["Category:World"], 3, exclude=exclude, include=include)[1]


def topic_categories(spark, sf_dir):
    """Categories that the selection visits, with their depth."""
    cats, children, members = A.category_graph(spark, sf_dir)
    return graph.select_topic(cats, children, members, ["Category:World", "Category:ASIA"], 2)[0]


def topic_fan_out(spark, sf_dir):
    """The category of most articles, by name on ties, with the totals."""
    cats, children, members = A.category_graph(spark, sf_dir)
    return graph.fan_out(members, children)


def seed_coverage(spark, sf_dir):
    seeds = A.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("seed"), F.col("o_custkey").alias("page_id"))
    return graph.seed_coverage(seeds)


def redirect_targets(spark, sf_dir):
    """Where each redirect ends, by pointer jumping, and after how many steps."""
    return graph.resolve_redirects(A.redirects(spark, sf_dir))


def related_pages(spark, sf_dir):
    """Pages within three links of the seeds, not over excluded ones."""
    seeds = spark.range(1, 6).select((F.col("id") * 2).alias("page_id"))
    exclude = A.read(spark, sf_dir, "supplier").where("s_acctbal < 0").select((F.col("s_suppkey") * 2 + 1).alias("page_id"))
    return graph.related(A.links(spark, sf_dir), seeds, 3, exclude)


def import_closure(spark, sf_dir):
    """Everything reachable from one nation's suppliers over shared parts of small quantity."""
    edges = A.read(spark, sf_dir, "lineitem").where("l_quantity = 1").select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    roots = A.read(spark, sf_dir, "supplier").where("s_nationkey = 3").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return graph.closure(edges, roots)


def unowned_media(spark, sf_dir):
    return media.unowned(*A.registry(spark, sf_dir))


def clean_up_plan(spark, sf_dir):
    return media.clean_up_plan(*A.registry(spark, sf_dir))


def owner_media(spark, sf_dir):
    """Objects of each owner, with their bytes, in digest order."""
    objects, owners = A.registry(spark, sf_dir)
    return owners.where("kind = 'pin'").join(objects, "digest").select("owner_id", "digest", "bytes")


def required_bytes(spark, sf_dir):
    objects, owners = A.registry(spark, sf_dir)
    return media.required_bytes(owners, objects)


def owner_counts(spark, sf_dir):
    return media.owner_counts(A.registry(spark, sf_dir)[1])


def dangling_owners(spark, sf_dir):
    """Owners of objects that a registry without small ones doesn't have."""
    objects, owners = A.registry(spark, sf_dir)
    return media.dangling(owners, objects.where("bytes > 5"))


def mime_conflicts(spark, sf_dir):
    uses = A.read(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("digest"), F.col("p_brand").alias("mime"))
    return media.mime_conflicts(uses)


def owners_after_removal(spark, sf_dir):
    """Owners after a batch was added and one owner removed."""
    _, owners = A.registry(spark, sf_dir)
    batch = owners.where("owner_id = 7").select("digest", F.lit("pack").alias("kind"), "owner_id")
    return media.remove_owner(media.register(owners, batch), "cache", 7).groupBy("kind", "owner_id").agg(F.count(F.lit(1)).alias("objects"))


def preview_pairs(spark, sf_dir):
    """Each supplier with its preview, the next one of its nation, if any: a self join."""
    s = A.read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nxt = s.withColumn("preview_id", F.lead("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    return nxt.join(s.select(F.col("s_suppkey").alias("preview_id"), F.lit(True).alias("found")), "preview_id", "left").select("s_suppkey", "preview_id", F.coalesce("found", F.lit(False)).alias("found"))


def chat_exchanges(spark, sf_dir):
    ex = state.exchanges(A.read(spark, sf_dir, "conversations"))
    return ex.select("conv_id", "turn", F.octet_length("question").cast("long").alias("question_bytes"), F.octet_length("answer").cast("long").alias("answer_bytes"))


def chat_recent(spark, sf_dir):
    """The newest turns of each conversation that fit 600 bytes, eight at most."""
    return state.recent_within(A.read(spark, sf_dir, "conversations"), 600, 8)


def chat_audit(spark, sf_dir):
    """Threads with their messages by role, and whether turns are gapless from 0."""
    m = A.read(spark, sf_dir, "conversations")
    return m.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum((F.col("role") == "user").cast("long")).alias("user"),
        F.sum((F.col("role") == "assistant").cast("long")).alias("assistant"),
        ((F.min("turn") == 0) & (F.max("turn") + 1 == F.countDistinct("turn"))).alias("gapless"),
    )


def chat_after_cascade(spark, sf_dir):
    """What is left after threads with a system turn, and their messages, were deleted."""
    m = A.read(spark, sf_dir, "conversations")
    threads, messages = state.cascade_delete(m.select("conv_id").distinct(), m, m.where("role = 'system'"))
    return messages.join(threads, "conv_id").groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("conv_id").alias("threads"))


def history_recent(spark, sf_dir):
    """The 50 latest visits, newest first: a top k."""
    return A.visits(spark, sf_dir).where("event_type = 'view'").select("id", "page_id", "visited_at").orderBy(F.col("visited_at").desc(), F.col("id").desc()).limit(50)


def history_latest(spark, sf_dir):
    """The last visit of each page, as upserts leave it."""
    v = A.visits(spark, sf_dir).where("event_type = 'view'")
    return state.latest(v, ["page_id"], [F.col("visited_at"), F.col("id")], "id")


def positions_without_bookmark(spark, sf_dir):
    v = A.visits(spark, sf_dir)
    marks = v.where("event_type = 'signup' AND value > 150").select("page_id")
    return audit.orphans(v.where("event_type = 'view'").select("page_id").distinct(), marks, ["page_id"])


def bookmarks_upsert(spark, sf_dir):
    """Bookmarks after purchases were merged over signups: the latest row of each page."""
    v = A.visits(spark, sf_dir).select("page_id", "id", "value", "event_type")
    return state.upsert(v.where("event_type = 'signup'"), v.where("event_type = 'purchase'"), ["page_id"], "id")


def cache_after_eviction(spark, sf_dir):
    """Per user, the newest purchases within five rows and 400 bytes of payload."""
    e = A.read(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "event_id", "ts", F.octet_length("props").cast("long").alias("bytes"))
    return state.evict(e, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], "bytes", 5, 40).select("user_id", "event_id", F.col("kept_rows").cast("long").alias("kept_rows"), "kept_bytes")


def cache_budget(spark, sf_dir):
    return A.read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("props")), F.lit(0)).alias("bytes"))


def windowed_visits(spark, sf_dir):
    """Views per hour and page group, as the streaming twin counts them."""
    v = A.visits(spark, sf_dir).where("event_type = 'view'")
    return v.groupBy(F.date_trunc("hour", "visited_at").cast("timestamp_ntz").alias("hour"), (F.col("page_id") % 10).alias("pages")).agg(F.count(F.lit(1)).alias("views"))


def answer_support(spark, sf_dir):
    """Counts over assistant turns as claims: supported if the reply is longer than its question."""
    ex = state.exchanges(A.read(spark, sf_dir, "conversations"))
    cited = F.size(F.regexp_extract_all("answer", F.lit("the|and"), F.lit(0))).cast("long")
    claims = ex.select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("claim_id"),
        F.when(F.length("answer") > F.length("question"), "supported").otherwise("unsupported").alias("verdict"),
        cited.alias("citations"), F.floor(cited / 2).alias("supported_citations"),
    )
    return evaluate.support_counts(claims)


def claim_spans(spark, sf_dir):
    """Claims that overlap the next or lack a marker before it: order lines as spans, suppliers as markers."""
    lines = A.read(spark, sf_dir, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("start"), F.max("l_suppkey").alias("size"))
    claims = lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("claim_id"), "start", (F.col("start") + F.col("size")).alias("end"))
    markers = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") + 50).alias("at"))
    return evaluate.misplaced_citations(claims, markers).select("case_id", F.count(F.lit(1)).over(Window.partitionBy("case_id")).alias("n"), F.col("claim_id")).groupBy("case_id").agg(F.max("n").alias("bad"))


QUERIES = {
    f.__name__: f
    for f in (
        topic_selection, topic_categories, topic_fan_out, seed_coverage, redirect_targets, related_pages, import_closure,
        unowned_media, clean_up_plan, owner_media, required_bytes, owner_counts, dangling_owners, mime_conflicts,
        owners_after_removal, preview_pairs, chat_exchanges, chat_recent, chat_audit, chat_after_cascade, history_recent,
        history_latest, positions_without_bookmark, bookmarks_upsert, cache_after_eviction, cache_budget, windowed_visits,
        answer_support, claim_spans,
    )
}

_EX = """ex AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
    QUALIFY role = 'user' AND next_role = 'assistant')"""

ORACLE_SQL = {
    "topic_selection": f"""WITH RECURSIVE {A.GRAPH}, walk AS (
            SELECT 'Category:World' AS name, 0 AS depth
            UNION SELECT c.child, w.depth + 1 FROM walk w JOIN categories k ON k.name = w.name AND NOT k.administrative
                JOIN children c ON c.name = w.name WHERE w.depth < 3)
        (SELECT page_id FROM members JOIN (SELECT DISTINCT name FROM walk) USING (name) JOIN categories USING (name) WHERE NOT administrative
         UNION SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0)
        EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
    "topic_categories": f"""WITH RECURSIVE {A.GRAPH}, walk AS (
            SELECT unnest(['Category:World', 'Category:ASIA']) AS name, 0 AS depth
            UNION SELECT c.child, w.depth + 1 FROM walk w JOIN categories k ON k.name = w.name AND NOT k.administrative
                JOIN children c ON c.name = w.name WHERE w.depth < 2)
        SELECT name, min(depth) AS depth, administrative FROM walk JOIN categories USING (name) GROUP BY name, administrative""",
    "topic_fan_out": f"""WITH {A.GRAPH}, m AS (SELECT name, count(DISTINCT page_id) AS articles FROM members GROUP BY 1),
        c AS (SELECT name, count(DISTINCT child) AS children FROM children GROUP BY 1)
        SELECT name, coalesce(articles, 0) AS articles, coalesce(children, 0) AS children FROM m FULL JOIN c USING (name)""",
    "seed_coverage": """WITH s AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
        SELECT count(*) AS selected, count(DISTINCT o_custkey) AS covered, count(*) - count(DISTINCT o_custkey) AS overlap FROM s""",
    "redirect_targets": f"""WITH RECURSIVE {A.REDIRECTS}, walk AS (
            SELECT from_id, to_id, 1 AS hops FROM redirects
            UNION ALL SELECT w.from_id, r.to_id, w.hops + 1 FROM walk w JOIN redirects r ON r.from_id = w.to_id)
        SELECT from_id, max_by(to_id, hops) AS to_id, max(hops) AS hops FROM walk GROUP BY 1""",
    "related_pages": f"""WITH RECURSIVE {A.LINKS}, x AS (SELECT s_suppkey * 2 + 1 AS page_id FROM supplier WHERE s_acctbal < 0),
        walk AS (
            SELECT unnest([2, 4, 6, 8, 10]) AS page_id, 0 AS hop
            UNION SELECT to_id, hop + 1 FROM walk JOIN links ON from_id = page_id WHERE hop < 3 AND to_id NOT IN (SELECT page_id FROM x))
        SELECT page_id, min(hop) AS hop FROM walk GROUP BY 1""",
    "import_closure": """WITH RECURSIVE e AS (
            SELECT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst FROM lineitem WHERE l_quantity = 1
            UNION SELECT l_partkey * 2, l_suppkey * 2 + 1 FROM lineitem WHERE l_quantity = 1),
        walk AS (SELECT s_suppkey * 2 + 1 AS node FROM supplier WHERE s_nationkey = 3 UNION SELECT dst FROM walk JOIN e ON src = node)
        SELECT node FROM walk""",
    "unowned_media": f"WITH {A.REGISTRY} SELECT * FROM objects WHERE digest NOT IN (SELECT digest FROM owners)",
    "clean_up_plan": f"WITH {A.REGISTRY} SELECT count(*) AS objects, coalesce(sum(bytes), 0) AS bytes FROM objects WHERE digest NOT IN (SELECT digest FROM owners)",
    "owner_media": f"WITH {A.REGISTRY} SELECT owner_id, digest, bytes FROM owners JOIN objects USING (digest) WHERE kind = 'pin'",
    "required_bytes": f"WITH {A.REGISTRY} SELECT owner_id, count(*) AS objects, sum(bytes) AS bytes FROM (SELECT DISTINCT owner_id, digest FROM owners) JOIN objects USING (digest) GROUP BY 1",
    "owner_counts": f"WITH {A.REGISTRY} SELECT digest, count(*) AS owners, count(DISTINCT kind) AS kinds FROM owners GROUP BY 1",
    "dangling_owners": f"WITH {A.REGISTRY} SELECT * FROM owners WHERE digest NOT IN (SELECT digest FROM objects WHERE bytes > 5)",
    "mime_conflicts": "SELECT sha256(p_name) AS digest, count(DISTINCT p_brand) AS types, min(p_brand) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "owners_after_removal": f"""WITH {A.REGISTRY}, added AS (SELECT * FROM owners UNION SELECT digest, 'pack', owner_id FROM owners WHERE owner_id = 7)
        SELECT kind, owner_id, count(*) AS objects FROM added WHERE NOT (kind = 'cache' AND owner_id = 7) GROUP BY 1, 2""",
    "preview_pairs": """SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS preview_id,
        lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) IS NOT NULL AS found FROM supplier""",
    "chat_exchanges": f"WITH {_EX} SELECT conv_id, turn, strlen(question) AS question_bytes, strlen(answer) AS answer_bytes FROM ex",
    "chat_recent": """SELECT conv_id, turn, role, sum(strlen(text)) OVER w AS used FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) QUALIFY used <= 600 AND row_number() OVER w <= 8""",
    "chat_audit": """SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS "user", count(*) FILTER (role = 'assistant') AS assistant,
        min(turn) = 0 AND max(turn) + 1 = count(DISTINCT turn) AS gapless FROM conversations GROUP BY 1""",
    "chat_after_cascade": """SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS threads FROM conversations
        WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY 1""",
    "history_recent": "SELECT event_id AS id, user_id AS page_id, ts AS visited_at FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "history_latest": "SELECT user_id AS page_id, event_id AS id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "positions_without_bookmark": "SELECT DISTINCT user_id AS page_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150)",
    "bookmarks_upsert": """SELECT user_id AS page_id, event_id AS id, value, event_type FROM events WHERE event_type IN ('signup', 'purchase')
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "cache_after_eviction": """SELECT user_id, event_id, row_number() OVER w AS kept_rows, sum(strlen(props)) OVER w AS kept_bytes FROM events WHERE event_type = 'purchase'
        WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) QUALIFY kept_rows <= 5 AND kept_bytes <= 40""",
    "cache_budget": "SELECT count(*) AS entries, coalesce(sum(strlen(props)), 0) AS bytes FROM events",
    "windowed_visits": "SELECT date_trunc('hour', ts) AS hour, user_id % 10 AS pages, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1, 2",
    "answer_support": f"""WITH {_EX}, c AS (SELECT conv_id, length(answer) > length(question) AS good, len(regexp_extract_all(answer, 'the|and')) AS n FROM ex)
        SELECT count(DISTINCT conv_id) AS cases, count(*) AS claims, count(*) FILTER (good) AS supported, count(*) FILTER (NOT good) AS unsupported,
               sum(n) AS citations, sum(n // 2) AS supported_citations, count(*) FILTER (good AND n // 2 = 0) AS supported_without_citation FROM c""",
    "claim_spans": """WITH l AS (SELECT l_orderkey AS case_id, l_linenumber AS claim_id, min(l_partkey) AS s, min(l_partkey) + max(l_suppkey) AS e FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
        n AS (SELECT *, lead(s) OVER (PARTITION BY case_id ORDER BY s, e) AS nx FROM l),
        k AS (SELECT n.*, (SELECT count(*) FROM lineitem m WHERE m.l_orderkey = case_id AND m.l_partkey + 50 >= e AND (nx IS NULL OR m.l_partkey + 50 < nx)) AS c FROM n)
        SELECT case_id, count(*) AS bad FROM k WHERE c = 0 OR nx < e GROUP BY 1""",
}
