"""Saved citations, anchors, checked answers and evidence for questions over the block view, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import grounding
from lorekeep.plans import adapters as A
from lorekeep.plans.search_queries import QUESTION, WH, WT

# Every fifth page is at another revision now; every third block is saved with a changed text, some under a page that has gone.
SAVED = """CASE WHEN page_id % 5 = 0 THEN revision_id - 1 ELSE revision_id END"""
EXCERPT = """CASE WHEN line % 3 = 2 THEN concat(text, '!') ELSE text END"""
PAGE = """CASE WHEN page_id % 11 = 0 THEN page_id + 100000000 ELSE page_id END"""


def _saved(spark, sf_dir):
    b = A.blocks(spark, sf_dir)
    return b.select(
        F.col("block_id").alias("citation_id"), "project", F.expr(PAGE).alias("page_id"), F.expr(SAVED).alias("revision_id"),
        "block_id", "heading", F.expr(EXCERPT).alias("excerpt"),
    )


def saved_citation_status(spark, sf_dir):
    return grounding.resolve_saved_citations(_saved(spark, sf_dir), A.blocks(spark, sf_dir))


def saved_citation_faults(spark, sf_dir):
    """What is wrong with saved citations: schema, sizes, snapshot, identity or digest."""
    s = _saved(spark, sf_dir)
    k = F.length("excerpt") % 7
    fault = grounding.saved_citation_fault(
        F.when(k == 0, 2).otherwise(1), F.col("project"), F.col("page_id"), F.col("revision_id"),
        F.when(k == 1, F.lit("Bad id")).when(k == 2, F.lit("snap-1")), F.col("block_id"),
        F.array(F.when(k == 3, F.repeat(F.lit("h"), 5000)).otherwise("h")), F.col("excerpt"),
        F.when(k == 4, F.sha2("block_id", 256)).otherwise(F.sha2("excerpt", 256)),
    )
    return s.select("citation_id", fault.alias("fault"))


def anchor_relocation(spark, sf_dir):
    """Anchors of blocks whose ordinal has moved, or whose white space or text has changed."""
    b = A.blocks(spark, sf_dir).withColumn("ordinal", F.when(F.col("line") == 0, 0).otherwise((F.col("line") - 1) % 4))
    moved = F.when(F.col("line") % 4 == 1, F.concat(F.col("block_id"), F.lit("x"))).otherwise(F.col("block_id"))
    text = F.when(F.col("line") % 5 == 3, F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(" "), F.lit("  ")))).when(
        F.col("line") % 5 == 4, F.concat(F.col("text"), F.lit("?"))
    ).otherwise(F.col("text"))
    anchors = b.select(F.col("block_id").alias("anchor_id"), "project", "page_id", moved.alias("block_id"), "heading", "ordinal", text.alias("text"))
    return grounding.relocate_anchors(anchors, b)


def checked_answers(spark, sf_dir):
    """Answers to each page, kept to their scope and evidence or not; eleven kinds of faults by page."""
    b = A.blocks(spark, sf_dir).withColumn("k", F.col("page_id") % 13)
    pages = b.groupBy("page_id").agg(F.first("project").alias("project"), F.first("k").alias("k"))
    answers = pages.select(
        F.col("page_id").alias("answer_id"), F.when(F.col("k").isin(1, 12), F.lit(" ")).otherwise(F.lit("so it is")).alias("text"), F.col("k").isin(2, 12).alias("abstained")
    )
    allowed = pages.where("k <> 3").select(F.col("page_id").alias("answer_id"), "project", F.when(F.col("k") == 4, -F.col("page_id")).otherwise(F.col("page_id")).alias("page_id"))
    given = b.where("line < 5")
    first = ["page_id", "project", "block_id", "k"]
    retrieved = given.select(
        F.col("page_id").alias("answer_id"), "project", F.when((F.col("k") == 5) & (F.col("line") == 1), F.col("page_id") + 1).otherwise(F.col("page_id")).alias("page_id"),
        "block_id", F.when((F.col("k") == 6) & (F.col("line") == 0), F.lit("made up")).otherwise(F.col("text")).alias("excerpt"),
    )
    again = given.where("k = 7 AND line = 0").select(F.col("page_id").alias("answer_id"), "project", "page_id", "block_id", F.col("text").alias("excerpt"))
    cited = b.where("(line = 0 OR (k = 9 AND line = 6)) AND k NOT IN (10, 12)")
    claimed = cited.select(F.col("page_id").alias("answer_id"), *first[1:2], "page_id", "block_id")
    twice = b.where("line = 0 AND k = 8").select(F.col("page_id").alias("answer_id"), *first[1:2], "page_id", "block_id")
    return grounding.check_answers(answers, allowed, retrieved.unionByName(again), claimed.unionByName(twice), b)


def answer_parts(spark, sf_dir):
    """Answers as texts and citations in turn: each turn of an assistant with two markers put in."""
    c = A.read(spark, sf_dir, "conversations").where("role = 'assistant'")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit("[[cite:"), key, F.lit("]]"), F.substring("text", half + 1, F.length("text")), F.lit("[[cite:end]]"))
    return grounding.answer_parts(c.select(key.alias("answer_id"), text.alias("text")))


SELECTION = "all rights reserved"


def article_evidence(spark, sf_dir):
    """The passages of each article that speak to one question, with a selection and a current section, within 200 tokens."""
    return grounding.retrieve(A.blocks(spark, sf_dir), QUESTION, 3, 200, SELECTION, F.coalesce(F.col("section") == 1, F.lit(False)))


QUERIES = {
    f.__name__: f for f in (saved_citation_status, saved_citation_faults, anchor_relocation, checked_answers, answer_parts, article_evidence)
}


def _evidence_sql() -> str:
    terms = ["licensed", "under", "the", "general", "public", "license", "all", "rights", "reserved"]
    weights, telling = [1.0] * 6 + [0.5] * 3, [t != "the" for t in terms]
    n = range(len(terms))
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS f{i}, list_contains(h, '{t}') AS h{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (f{i} > 0) OVER page AS d{i}" for i in n)
    own = [
        f"""(CASE WHEN f{i} > 0 THEN ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END
             + CASE WHEN h{i} THEN 1.5 * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 0 END)"""
        for i in n
    ]
    score = " + ".join(f"{weights[i]} * {own[i]}" for i in n)
    everywhere = [f"(n >= 3 AND d{i} >= n)" for i in n]
    specific = " OR ".join(f"NOT {everywhere[i]}" for i in n if telling[i])
    informed = " OR ".join(f"({own[i]} > 0 AND (NOT {everywhere[i]} OR NOT ({specific})))" for i in n if telling[i])
    return f"""WITH RECURSIVE {A.BLOCKS},
    tokens AS (SELECT *, {WT} AS w, {WH} AS h, coalesce(heading, '') || chr(10) || text AS whole FROM blocks),
    counted AS (
        SELECT project, page_id, block_id, coalesce(section = 1, false) AS current, len(w) AS length, {counts},
               contains(array_to_string(w, ' '), '{SELECTION}') AS selected,
               greatest(ceil(len({A.tokens_sql("whole")}) * 4 / 3), ceil(strlen(whole) / 4), 1)::bigint AS tokens FROM tokens),
    stats AS (SELECT *, count(*) OVER page AS n, greatest(avg(length) OVER page, 1) AS mean, {stats} FROM counted WINDOW page AS (PARTITION BY page_id)),
    scored AS (SELECT *, {score} AS score, ({informed}) AS informed, {" OR ".join(f"h{i}" for i in n)} AS heading_hit FROM stats),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY selected DESC, milli DESC, block_id) AS rank FROM (
            SELECT project, page_id, block_id, tokens, selected, current, heading_hit,
                   round(1000 * score * CASE WHEN current THEN 1.25 ELSE 1 END)::bigint AS milli
            FROM scored WHERE (score > 0 AND informed) OR selected)),
    walk AS (
        SELECT page_id, 0::bigint AS rank, 0::bigint AS used, 0 AS place, false AS took, false AS over FROM (SELECT DISTINCT page_id FROM ranked)
        UNION ALL
        SELECT w.page_id, r.rank, w.used + CASE WHEN w.place < 3 AND w.used + r.tokens <= 200 THEN r.tokens ELSE 0 END,
               w.place + (w.place < 3 AND w.used + r.tokens <= 200)::int, w.place < 3 AND w.used + r.tokens <= 200,
               w.over OR (w.place < 3 AND w.used + r.tokens > 200)
        FROM walk w JOIN ranked r ON r.page_id = w.page_id AND r.rank = w.rank + 1)
    SELECT project, page_id, block_id, place, milli, tokens, selected, heading_hit, current, bool_or(over) OVER (PARTITION BY page_id) AS budget_limited
    FROM ranked RIGHT JOIN walk USING (page_id, rank) QUALIFY took"""


ORACLE_SQL = {
    "saved_citation_status": f"""WITH {A.BLOCKS},
        saved AS (SELECT block_id AS citation_id, project, {PAGE} AS page_id, {SAVED} AS revision_id, block_id, coalesce(heading, '') AS heading, {EXCERPT} AS excerpt FROM blocks),
        now AS (SELECT page_id, max(revision_id) AS now FROM blocks GROUP BY 1),
        met AS (
            SELECT s.citation_id, s.block_id, s.revision_id, now.now, count(b.block_id) AS n, min(b.block_id) AS there, coalesce(bool_or(b.block_id = s.block_id), false) AS own
            FROM saved s LEFT JOIN now USING (page_id)
            LEFT JOIN blocks b ON b.project = s.project AND b.page_id = s.page_id AND b.text = s.excerpt AND coalesce(b.heading, '') = s.heading GROUP BY 1, 2, 3, 4),
        told AS (SELECT *, CASE WHEN now IS NULL THEN 'missing' WHEN now <> revision_id THEN 'stale' WHEN own THEN 'current' ELSE 'unavailable' END AS status FROM met)
        SELECT citation_id, status, CASE WHEN status = 'current' THEN block_id WHEN status = 'stale' AND n = 1 THEN there END AS block_id FROM told""",
    "saved_citation_faults": f"""WITH {A.BLOCKS}, saved AS (
            SELECT block_id AS citation_id, page_id, length({EXCERPT}) % 7 AS k FROM blocks)
        SELECT citation_id, CASE WHEN k = 0 THEN 'unsupported schema' WHEN k = 3 THEN 'too large' WHEN k = 1 THEN 'invalid snapshot id'
            WHEN page_id % 11 = 0 OR page_id % 5 = 0 THEN 'inconsistent identity' WHEN k = 4 THEN 'excerpt digest mismatch' END AS fault FROM saved""",
    "anchor_relocation": rf"""WITH {A.BLOCKS},
        b AS (SELECT *, CASE WHEN line = 0 THEN 0 ELSE (line - 1) % 4 END AS ordinal, trim(regexp_replace(text, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')) AS norm FROM blocks),
        met AS (
            SELECT a.block_id AS anchor_id, CASE WHEN a.line % 4 = 1 THEN a.block_id || 'x' ELSE a.block_id END AS own, count(c.block_id) AS n, min(c.block_id) AS one,
                   count(c.block_id) FILTER (c.heading IS NOT DISTINCT FROM a.heading AND c.ordinal = a.ordinal) AS m,
                   min(c.block_id) FILTER (c.heading IS NOT DISTINCT FROM a.heading AND c.ordinal = a.ordinal) AS alike
            FROM b a LEFT JOIN b c ON c.page_id = a.page_id AND c.norm = CASE WHEN a.line % 5 = 4 THEN a.norm || '?' ELSE a.norm END GROUP BY 1, 2),
        hits AS (SELECT *, CASE WHEN n = 1 THEN one WHEN m = 1 THEN alike END AS hit FROM met)
        SELECT anchor_id, CASE WHEN hit = own THEN 'located' WHEN hit IS NOT NULL THEN 'relocated' WHEN n = 0 THEN 'missing' ELSE 'ambiguous' END AS status, hit AS block_id FROM hits""",
    "checked_answers": f"""WITH {A.BLOCKS}, pages AS (
            SELECT page_id, page_id % 13 AS k, bool_or(line = 0) AS lead, bool_or(line = 1) AS second, bool_or(line = 6) AS seventh FROM blocks GROUP BY 1)
        SELECT page_id AS answer_id,
            CASE WHEN k = 3 THEN 'empty scope' WHEN k = 4 THEN 'unknown article' WHEN k = 5 AND second THEN 'out of scope'
                 WHEN k = 2 THEN 'unsupported' WHEN k = 12 THEN 'insufficient evidence' WHEN k = 1 THEN 'empty'
                 WHEN k = 10 OR NOT (lead OR (k = 9 AND seventh)) THEN 'unsupported'
                 WHEN k = 6 AND lead THEN 'invalid evidence' WHEN k = 7 AND lead THEN 'duplicate evidence' WHEN k = 8 AND lead THEN 'duplicate citation'
                 WHEN k = 9 AND seventh THEN 'unretrieved citation' ELSE 'supported' END AS status,
            CASE WHEN k IN (10, 12) THEN 0 ELSE lead::int + (k = 9 AND seventh)::int + (k = 8 AND lead)::int END AS citations FROM pages""",
    "answer_parts": """WITH c AS (SELECT conv_id || '-' || turn AS answer_id, text, length(text) // 2 AS half FROM conversations WHERE role = 'assistant'),
        parts AS (
            SELECT answer_id, unnest([text[1:half], answer_id, text[half + 1:], 'end']) AS part, unnest(['text', 'citation', 'text', 'citation']) AS kind, unnest([0, 1, 2, 3]) AS k FROM c)
        SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY k) - 1 AS place, kind, part FROM parts WHERE part <> ''""",
    "article_evidence": _evidence_sql(),
}
