"""Documents as reviewed answers, a claim and a citation for each line, in three versions of annotation, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import answer_review
from lorekeep.plans import adapters as A


def _suites(spark, sf_dir):
    """One suite for each document. In every fifth, the last line has no claim; every fourth names another revision."""
    docs = A.read(spark, sf_dir, "documents").select("doc_id", "lang", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\r]")).alias("lines"))
    page, version = F.col("doc_id") + 1, (F.col("doc_id") % 3 + 1).cast("int")
    revision = F.col("doc_id") + 1_000_000 + (F.col("doc_id") % 4 == 1).cast("int")
    project = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("wiki"))
    block = lambda i: F.concat_ws(":", F.lit("wkb"), project, page.cast("string"), revision.cast("string"), F.concat(F.lit("b"), i.cast("string")))
    marker = lambda i: F.concat(F.lit(" [[cite:"), block(i), F.lit("]]"))
    answer = F.array_join(F.transform("lines", lambda x, i: F.concat(x, marker(i))), "\n")
    before = lambda i: F.aggregate(F.transform(F.slice("lines", 1, i), lambda x, k: F.octet_length(x) + F.octet_length(marker(k)) + 1), F.lit(0), lambda s, n: s + n)
    verdict = lambda i: F.when(i % 7 == 5, "unreviewed").when(i % 3 == 1, "unsupported").otherwise("supported")

    def claim(x, i):
        start = F.when(version >= 2, before(i).cast("long"))
        cites = F.array(F.struct(block(i).alias("block_id"), verdict(i).alias("verdict")))
        return F.struct(F.concat(F.lit("c"), i.cast("string")).alias("id"), x.alias("text"), verdict(i).alias("verdict"), cites.alias("citations"), start.alias("start_byte"), (start + F.octet_length(x)).alias("end_byte"))

    kept = F.size("lines") - (F.col("doc_id") % 5 == 2).cast("int")
    claims = F.slice(F.transform("lines", claim), 1, F.greatest(kept, F.lit(0)))
    case = F.struct(F.lit("one").alias("id"), project.alias("project"), page.alias("page_id"), revision.alias("revision_id"), F.lit("What is there?").alias("question"), answer.alias("answer"), claims.alias("claims"))
    suite = F.struct(version.alias("schema_version"), F.concat(F.lit("s"), page.cast("string")).alias("suite_id"), F.array(case).alias("cases"))
    return docs.select(F.col("doc_id").alias("suite"), F.to_json(suite).alias("body"))


def review_scores(spark, sf_dir):
    scores, _ = answer_review.review(_suites(spark, sf_dir))
    return answer_review.report(scores)


def review_faults(spark, sf_dir):
    return answer_review.review(_suites(spark, sf_dir))[1]


def strict_review_faults(spark, sf_dir):
    """Suites that are right by themselves, and what the corpus has against them."""
    scores, _ = answer_review.review(_suites(spark, sf_dir))
    return answer_review.strict_faults(scores, A.articles(spark, sf_dir), A.blocks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (review_scores, review_faults, strict_review_faults)}

_LINES = r"""kept AS (SELECT doc_id, coalesce(lang, 'xx') || 'wiki' AS project, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) AS lines FROM documents),
    sized AS (SELECT *, doc_id % 3 + 1 AS version, greatest(len(lines) - (doc_id % 5 = 2)::int, 0) AS m FROM kept),
    placed AS (SELECT doc_id, version, m, unnest(lines) AS line, unnest(range(len(lines))) AS i, 'wkb:' || project || ':' || (doc_id + 1) || ':' || (doc_id + 1000000 + (doc_id % 4 = 1)::int) || ':b' AS stem FROM sized),
    lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS turn, regexp_matches(line, '[\p{L}\p{N}_]') AS worded FROM placed),
    per AS (
        SELECT doc_id, sum(strlen(line) + strlen(stem || i) + 11) - 1 AS bytes, bool_or(i >= m AND worded) AS unseen, bool_or(i >= m) AS unlabelled,
               arg_min(CASE WHEN NOT worded OR strlen(line) > 8192 THEN 'InvalidClaim' ELSE 'DuplicateClaim' END, i) FILTER (i < m AND (NOT worded OR strlen(line) > 8192 OR (version = 1 AND turn > 1))) AS claim
        FROM lines GROUP BY 1),
    told AS (
        SELECT s.doc_id AS suite, version, m, CASE WHEN m = 0 OR m > 128 OR bytes > 65536 THEN 'InvalidCase' WHEN version = 3 AND unseen THEN 'UnreviewedProse'
            WHEN claim IS NOT NULL THEN claim WHEN unlabelled THEN 'UnlabeledCitationMarker' END AS code FROM sized s LEFT JOIN per USING (doc_id))"""
_COUNT = "count(*) FILTER (i % 7 <> 5 {0}) AS reviewed_{1}, count(*) FILTER (i % 7 <> 5 AND i % 3 <> 1) AS supported_{1}, count(*) FILTER (i % 7 <> 5 AND i % 3 = 1) AS unsupported_{1}, count(*) FILTER (i % 7 = 5) AS unreviewed_{1}"

ORACLE_SQL = {
    "review_faults": f"WITH {_LINES} SELECT suite, 'one' AS case_id, code FROM told WHERE code IS NOT NULL",
    "review_scores": f"""WITH {_LINES}
        SELECT suite, t.version AS annotation_version, 1 AS cases, count(*) AS claims, count(*) AS citations, 0 AS uncited_claims, {_COUNT.format('', 'claims')}, {_COUNT.format('', 'citations')},
               count(*) FILTER (i % 7 = 5) = 0 AS all_claims_reviewed, count(*) FILTER (i % 7 = 5) = 0 AS all_citations_reviewed
        FROM told t JOIN lines l ON l.doc_id = suite AND i < t.m WHERE code IS NULL GROUP BY 1, 2""",
    "strict_review_faults": f"""WITH {_LINES}
        SELECT suite, 'one' AS case_id, CASE WHEN suite % 4 = 1 THEN 'UnknownOrStaleArticle' ELSE 'UnknownEvidence' END AS code
        FROM told WHERE code IS NULL AND (suite % 4 = 1 OR m > 1 OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = suite AND regexp_matches(string_split(d.text, chr(10))[1], '[^ \\t\\n\\r]')))""",
}
