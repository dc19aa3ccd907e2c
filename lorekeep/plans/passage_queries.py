"""Documents rendered as HTML, and their lines sought in it as cited passages, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import passages
from lorekeep.plans import adapters as A

HEAD = '<div title="a > b">'


def passage_places(spark, sf_dir):
    """Where each line of each document stands; every other has a reference mark, every fifth is no paragraph's block."""
    docs = A.read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))

    def shown(x, i):
        mark = F.when(i % 2 == 0, F.concat(F.lit('<sup class="r">['), i.cast("string"), F.lit("]</sup>"))).otherwise("")
        return F.concat(F.lit("<p>"), F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), mark, F.lit("</p>"))

    pages = docs.select((F.col("doc_id") + 1).alias("page_id"), F.concat(F.lit(HEAD), F.array_join(F.transform("lines", shown), ""), F.lit("</div>")).alias("html"))
    asked = docs.select((F.col("doc_id") + 1).alias("page_id"), F.posexplode("lines").alias("line", "text")).select(
        "page_id", F.col("line").cast("long").alias("block_id"), F.when(F.col("line") % 5 == 4, "list").otherwise("paragraph").alias("kind"), "text"
    )
    return passages.locate(asked, pages)


QUERIES = {"passage_places": passage_places}

ORACLE_SQL = {
    "passage_places": rf"""WITH lines AS (
            SELECT doc_id + 1 AS page_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        shown AS (
            SELECT *, trim(regexp_replace(line, '[\s\p{{Z}}]+', ' ', 'g')) AS words,
                   strlen('<p></p>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN i % 2 = 0 THEN '<sup class="r">[' || i || ']</sup>' ELSE '' END) AS n FROM lines),
        placed AS (SELECT *, {len(HEAD)} + coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
                          count(*) OVER (PARTITION BY page_id, words) AS same FROM shown)
        SELECT page_id, i AS block_id, CASE WHEN i % 5 = 4 OR words = '' THEN 'wordless' WHEN same > 1 THEN 'ambiguous' ELSE 'located' END AS status,
               CASE WHEN i % 5 <> 4 AND words <> '' AND same = 1 THEN a::bigint END AS start, CASE WHEN i % 5 <> 4 AND words <> '' AND same = 1 THEN (a + n)::bigint END AS end
        FROM placed""",
}
