"""Structured bodies made of documents, up to 64 sections deep, and what they become, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import canonical, part_trees
from lorekeep.plans import adapters as A

REFERENCES = ",".join(
    f'{{"identifier":"r{k}"' + (f',"title":"Title {k}"' if k % 2 else "") + (f',"url":"https://example.org/{k}"' if k != 2 else ',"url":null') + "}" for k in range(5)
)


def _bodies(spark, sf_dir):
    """Each line with text opens a section within that of the line before, 64 at most, then the next ones stand beside the last.

    Sections hold the line as a paragraph with a citation; every third has a list before it, every fourth an infobox after
    it, every sixth a table of its own. A seventh of the documents break a rule at their second line.
    """
    docs = A.read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\r]")).alias("lines"))

    def opened(x, i):
        words = F.slice(F.split(F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")), " "), 1, 3)
        cite = F.array(F.struct(F.concat(F.lit("r"), (i % 5).cast("string")).alias("identifier"), F.lit("see").alias("text")))
        paragraph = F.to_json(F.struct(F.lit("paragraph").alias("type"), x.alias("value"), cite.alias("citations")))
        listed = F.when(i % 3 == 0, F.concat(F.to_json(F.struct(F.lit("list").alias("type"), words.alias("values"))), F.lit(","))).otherwise("")
        field = F.struct(F.lit("field").alias("type"), F.lit("length").alias("name"), F.length(x).cast("string").alias("value"), cite.alias("citations"))
        box = F.when(i % 4 == 0, F.concat(F.lit(","), F.to_json(F.struct(F.lit("infobox").alias("type"), F.array(field).alias("has_parts"))))).otherwise("")
        wrong = F.when((i == 1) & (F.col("doc_id") % 7 == 3), F.lit(',{"type":"paragraph","value":" "}')).otherwise("")
        tables = F.when(i % 6 == 0, F.lit('"table_references":[{"identifier":"t1"}],')).otherwise("")
        name = F.concat(F.lit('{"type":"section","name":"S'), i.cast("string"), F.lit('",'), tables, F.lit('"has_parts":['))
        return F.concat(name, listed, paragraph, box, wrong)

    each = F.transform("lines", opened)
    deep = F.least(F.size("lines"), F.lit(part_trees.MOST_DEPTH))
    nested = F.concat(F.array_join(F.slice(each, 1, deep), ","), F.repeat(F.lit("]}"), deep))
    beside = F.array_join(F.transform(F.filter(F.slice(each, part_trees.MOST_DEPTH + 1, 1_000_000), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(","), x, F.lit("]}"))), "")
    body = F.concat(F.lit('{"parts":['), nested, beside, F.lit(f'],"tables":[{{"identifier":"t1","headers":[["a","b"]],"rows":[["1","2"]]}}],"references":[{REFERENCES}]}}'))
    return docs.select(F.col("doc_id").cast("string").alias("body"), body.alias("value"))


def part_blocks(spark, sf_dir):
    b = part_trees.articles(_bodies(spark, sf_dir)).blocks
    content = F.coalesce(
        "text", F.array_join("items", "|"), F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";"), F.concat(F.col("note.source_id"), F.lit(":"), F.col("note.label"), F.lit(":"), F.col("note.text")),
    )
    return b.select(F.col("body").cast("long").alias("doc_id"), F.size("section").cast("long").alias("depth"), F.element_at("section", 1).cast("long").alias("top"), "ordinal", "kind", content.alias("content"))


def part_sections(spark, sf_dir):
    s = part_trees.articles(_bodies(spark, sf_dir)).sections
    return s.select(F.col("body").cast("long").alias("doc_id"), F.array_join("section", ".").alias("section"), "heading")


def part_faults(spark, sf_dir):
    return part_trees.articles(_bodies(spark, sf_dir)).faults.select(F.col("body").cast("long").alias("doc_id"), "code", "what")


def _digests(spark, sf_dir):
    """The canonical digest of each document as an article; every third has an alias, every fifth a link."""
    page = F.col("doc_id") + 1
    none = F.array().cast("array<string>")
    links = F.array(F.struct(F.lit('to "it"').alias("label"), F.lit("enwiki").alias("project"), (page + 1).alias("page_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("top")).alias("fragment")))
    said = lambda **x: F.struct(*(F.lit(v).alias(k) for k, v in x.items()))
    media = said(source_url="https://example.org/x.png", mime_type="image/png", sha256=None, license="CC0", creator="é", attribution="a", is_av_preview=False)
    media = media.withField("sha256", F.lit(None).cast("string")).withField("derivation", F.when(F.col("doc_id") % 4 == 0, F.lit("lossless_webp")))
    heads = A.read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("body"), F.concat(F.coalesce("lang", F.lit("xx")), F.lit("wiki")).alias("project"), page.alias("page_id"), (page + 7).alias("revision_id"),
        F.lit("2026-10-31T00:00:00Z").alias("timestamp"), F.concat(F.lit("T "), page.cast("string")).alias("title"), F.concat(F.lit("<i>T</i> "), page.cast("string")).alias("display_title"),
        F.coalesce("lang", F.lit("xx")).alias("language"), F.lit(0).alias("namespace"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a\\b"))).otherwise(none).alias("aliases"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Q"), page.cast("string"))).alias("wikidata_id"),
        F.when(F.col("doc_id") % 5 == 0, links).otherwise(F.slice(links, 1, 0)).alias("links"), F.lit("<p>x</p>\n").alias("rendered_html"),
        F.when(F.col("doc_id") % 6 == 0, F.array(media)).otherwise(F.slice(F.array(media), 1, 0)).alias("media"), (F.col("doc_id") % 11 == 0).alias("is_disambiguation"),
    )
    return canonical.with_digest(canonical.canonical_articles(heads, part_trees.articles(_bodies(spark, sf_dir))))


def article_digests(spark, sf_dir):
    return _digests(spark, sf_dir).select("project", "page_id", "revision_id", F.octet_length("record").cast("long").alias("bytes"), "content_sha256")


def corpus_digest(spark, sf_dir):
    return canonical.corpus_digest(_digests(spark, sf_dir))


QUERIES = {f.__name__: f for f in (part_blocks, part_sections, part_faults, article_digests, corpus_digest)}

_LINES = r"""kept AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r]')) AS lines FROM documents),
    placed AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM kept),
    good AS (SELECT *, CASE WHEN i < 64 THEN i + 1 ELSE 1 END AS depth, CASE WHEN i < 64 THEN 1 ELSE i - 62 END AS top FROM placed WHERE NOT (n > 1 AND doc_id % 7 = 3))"""

_RECORDS = rf"""{_LINES},
    events AS (
        SELECT doc_id, i, 0 AS k, json_object('List', (string_split(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), ' '))[1:3]) AS j FROM good WHERE i % 3 = 0
        UNION ALL SELECT doc_id, i, 1, json_object('Paragraph', line) FROM good
        UNION ALL SELECT doc_id, i, 2, json_object('Footnote', json_object('source_id', 'r' || (i % 5), 'label', 'see', 'text', CASE WHEN i % 2 = 1 THEN 'Title ' || i ELSE 'r' || i END, 'reference_ids', ['r' || i])) FROM good WHERE i < 5
        UNION ALL SELECT doc_id, i, 3, json_object('Infobox', [['length', length(line)::varchar]]) FROM good WHERE i % 4 = 0
        UNION ALL SELECT doc_id, i, 4, json_object('Table', [['a', 'b'], ['1', '2']]) FROM good WHERE i % 6 = 0),
    blocked AS (
        SELECT doc_id, i, string_agg('{{"ordinal":' || o || ',"content":' || j || '}}', ',' ORDER BY o) AS blocks
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS o FROM events) GROUP BY 1, 2),
    sections AS (
        SELECT doc_id, string_agg(
            CASE WHEN i = 64 THEN repeat(']}}', 64) ELSE '' END || CASE WHEN i >= 64 THEN ',' ELSE '' END || '{{"ordinal":' || CASE WHEN i < 64 THEN 1 ELSE top END
            || ',"heading":"S' || i || '","blocks":[' || blocks || '],"subsections":[' || CASE WHEN i >= 64 THEN ']}}' ELSE '' END, '' ORDER BY i)
            || CASE WHEN any_value(n) <= 64 THEN repeat(']}}', any_value(n)::int) ELSE '' END AS sections
        FROM good JOIN blocked USING (doc_id, i) GROUP BY 1),
    records AS (
        SELECT coalesce(lang, 'xx') || 'wiki' AS project, d.doc_id + 1 AS page_id, d.doc_id + 8 AS revision_id,
            '{{"schema_version":1,"key":{{"project":"' || coalesce(lang, 'xx') || 'wiki","page_id":' || (d.doc_id + 1) || '}},"revision":{{"revision_id":' || (d.doc_id + 8)
            || ',"timestamp":"2026-10-31T00:00:00Z","content_sha256":"' || repeat('0', 64) || '"}},"title":"T ' || (d.doc_id + 1) || '","display_title":"<i>T</i> ' || (d.doc_id + 1)
            || '","language":"' || coalesce(lang, 'xx') || '","namespace":0,"aliases":[' || CASE WHEN d.doc_id % 3 = 0 THEN '"a\\b"' ELSE '' END || '],"wikidata_id":'
            || CASE WHEN d.doc_id % 4 = 0 THEN '"Q' || (d.doc_id + 1) || '"' ELSE 'null' END || ',"lead":[],"sections":[' || coalesce(sections, '') || '],"references":['
            || '{{"id":"r0","label":"r0","source_url":"https://example.org/0"}},{{"id":"r1","label":"Title 1","source_url":"https://example.org/1"}},{{"id":"r2","label":"r2","source_url":null}},'
            || '{{"id":"r3","label":"Title 3","source_url":"https://example.org/3"}},{{"id":"r4","label":"r4","source_url":"https://example.org/4"}}],"links":['
            || CASE WHEN d.doc_id % 5 = 0 THEN '{{"label":"to \"it\"","target":{{"project":"enwiki","page_id":' || (d.doc_id + 2) || '}},"fragment":' || CASE WHEN d.doc_id % 2 = 0 THEN '"top"' ELSE 'null' END || '}}' ELSE '' END
            || '],"media":[' || CASE WHEN d.doc_id % 6 = 0 THEN '{{"source_url":"https://example.org/x.png","mime_type":"image/png","sha256":null,"license":"CC0","creator":"é","attribution":"a","is_av_preview":false'
                || CASE WHEN d.doc_id % 4 = 0 THEN ',"derivation":"lossless_webp"' ELSE '' END || '}}' ELSE '' END
            || '],"rendered_html":"<p>x</p>\n","is_disambiguation":' || (d.doc_id % 11 = 0) || '}}' AS record
        FROM documents d LEFT JOIN sections USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM placed WHERE n > 1 AND doc_id % 7 = 3)),
    digests AS (SELECT project, page_id, revision_id, strlen(record) AS bytes, sha256(record) AS content_sha256 FROM records)"""

ORACLE_SQL = {
    "part_blocks": rf"""WITH {_LINES},
        events AS (
            SELECT doc_id, i, depth, top, 0 AS k, 'list' AS kind, array_to_string((string_split(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g')), ' '))[1:3], '|') AS content FROM good WHERE i % 3 = 0
            UNION ALL SELECT doc_id, i, depth, top, 1, 'paragraph', line FROM good
            UNION ALL SELECT doc_id, i, depth, top, 2, 'footnote', 'r' || (i % 5) || ':see:' || CASE WHEN i % 2 = 1 AND i < 5 THEN 'Title ' || i ELSE 'r' || (i % 5) END FROM good WHERE i < 5
            UNION ALL SELECT doc_id, i, depth, top, 3, 'infobox', 'length=' || length(line) FROM good WHERE i % 4 = 0
            UNION ALL SELECT doc_id, i, depth, top, 4, 'table', 'a,b;1,2' FROM good WHERE i % 6 = 0)
        SELECT doc_id, depth, top, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS ordinal, kind, content FROM events""",
    "part_sections": f"""WITH {_LINES}
        SELECT doc_id, CASE WHEN i < 64 THEN array_to_string(list_transform(range(depth), lambda x: '1'), '.') ELSE top::varchar END AS section, 'S' || i AS heading FROM good""",
    "part_faults": f"WITH {_LINES} SELECT DISTINCT doc_id, 'Missing' AS code, 'part.value' AS what FROM placed WHERE n > 1 AND doc_id % 7 = 3",
    "article_digests": f"WITH {_RECORDS} SELECT * FROM digests",
    "corpus_digest": f"""WITH {_RECORDS},
        one AS (SELECT project, page_id // 4096 AS a, sha256(string_agg(page_id || ' ' || revision_id || ' ' || content_sha256 || chr(10), '' ORDER BY page_id)) AS d, count(*) AS n FROM digests GROUP BY ALL),
        two AS (SELECT project, a // 4096 AS b, sha256(string_agg(a || ' ' || d || chr(10), '' ORDER BY a)) AS d, sum(n) AS n FROM one GROUP BY ALL),
        three AS (SELECT project, sha256(string_agg(b || ' ' || d || chr(10), '' ORDER BY b)) AS d, sum(n) AS n FROM two GROUP BY ALL)
        SELECT sum(n)::bigint AS articles, sha256(string_agg(project || ' ' || d || chr(10), '' ORDER BY project)) AS digest FROM three""",
}
