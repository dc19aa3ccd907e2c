"""Validators, choices and small aggregates over variants of the driver's rows, with oracle SQL.

The variants are written in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions import validity as V
from lorekeep.operators import grounding, media
from lorekeep.plans import adapters as A

URL = """CASE page_id % 14 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http', 'ftp') WHEN 2 THEN replace(url, '://', '://user@')
    WHEN 3 THEN concat('https://[2001:db8::', cast(page_id % 9 as string), ']:443/x') WHEN 4 THEN concat(url, ' x')
    WHEN 5 THEN 'https://a..b/' WHEN 6 THEN concat('http://h:', cast(page_id * 997 as string), '/p')
    WHEN 7 THEN 'http://[1:2:3:4:5:6:7:8]' WHEN 8 THEN 'http://[1:2:3:4:5:6:7]/' WHEN 9 THEN 'https://-a.example/'
    WHEN 10 THEN concat('https://b.example:0', cast(page_id % 3 as string)) WHEN 11 THEN 'https://x%20.example/'
    WHEN 12 THEN 'http://[::ffff:1.2.3.4]:8080/' ELSE replace(url, 'example', 'exam_ple') END"""
MEDIA = """CASE page_id % 6 WHEN 0 THEN concat('https://upload.wikimedia.org/wikipedia/commons/a/ab/F', cast(page_id as string), '.png')
    WHEN 1 THEN 'https://upload.wikimedia.org/wikipedia/../x.png' WHEN 2 THEN 'http://upload.wikimedia.org/wikipedia/x.png'
    WHEN 3 THEN 'https://thumb.wikimedia.org/wikipedia/commons/x.svg' WHEN 4 THEN 'https://upload.wikimedia.org/wikipedia/a//b.png' ELSE url END"""
_DNS = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_VALID_URL = rf"""(regexp_full_match(u, 'https?://{_DNS}(\.{_DNS})*(:0*[1-9][0-9]{{0,4}})?([/?#][^\s\\]*)?')
        AND coalesce(try_cast(regexp_extract(u, '^https?://[^/?#:]*:([0-9]+)', 1) AS bigint), 1) BETWEEN 1 AND 65535
     OR regexp_full_match(u, 'https?://\[([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}}){{7}}|([0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}}){{0,5}})?::([0-9a-f]{{1,4}}|ffff:1\.2\.3\.4))\](:[0-9]+)?([/?#][^\s\\]*)?'))"""


def url_validity(spark, sf_dir):
    """External URLs, media URLs and media file names, valid and not."""
    pages = A.read(spark, sf_dir, "pages").select("page_id", F.expr(URL).alias("u"), F.expr(MEDIA).alias("m"))
    return pages.select(
        "page_id", V.valid_external_url("u").alias("external"), V.media_url_allowed("m").alias("media"), T.media_file_name("m").isNotNull().alias("named")
    )


NAME = """CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN concat(' ', p_name) WHEN 2 THEN concat('Category:', replace(p_name, ' ', '_'))
    WHEN 3 THEN concat(p_name, '#x') WHEN 4 THEN concat(p_name, chr(9), 'x') WHEN 5 THEN '' WHEN 6 THEN concat('Category:_', p_name)
    WHEN 7 THEN concat('File:', p_name, '.svg') ELSE concat(p_name, '\u200e') END"""
MIME = """CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml; q=1' WHEN 2 THEN concat('text/x-', lower(p_type)) WHEN 3 THEN 'image' ELSE 'a/b/c' END"""


def label_validity(spark, sf_dir):
    """Category labels and titles, file keys, MIME tokens and XML characters."""
    parts = A.read(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"), F.expr(MIME).alias("mime"))
    return parts.select(
        "p_partkey", V.valid_label("name").alias("label"), V.category_title("name").alias("category"), V.file_title_key("name").alias("file_key"),
        V.valid_mime("mime").alias("mime"), V.valid_xml_text(F.concat("name", F.expr("CASE WHEN p_partkey % 4 = 0 THEN chr(1) ELSE '' END"))).alias("xml"),
    )


DATE = """CASE o_orderkey % 6 WHEN 0 THEN day WHEN 1 THEN concat(substr(day, 1, 8), '31') WHEN 2 THEN concat(substr(day, 1, 5), '02-29')
    WHEN 3 THEN replace(day, '-', '/') WHEN 4 THEN concat('0000', substr(day, 5)) ELSE concat(day, ' ') END"""


def date_validity(spark, sf_dir):
    orders = A.read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return orders.select("o_orderkey", V.valid_dump_date(F.expr(DATE)).alias("valid"))


def claims_in_pages(spark, sf_dir):
    """Whether each document has its nation's word as whole words, and as any part of a word."""
    a = A.read(spark, sf_dir, "documents").select("doc_id", "text", F.expr("CASE doc_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'an' WHEN 2 THEN 'die' ELSE 'public license' END").alias("claim"))
    return a.select("doc_id", V.occurs_as_words("text", "claim").alias("as_words"), F.contains("text", "claim").alias("at_all"))


def unresolved_visuals(spark, sf_dir):
    """Pages with backgrounds that a sanitiser would drop; one in three gets one."""
    extra = "CASE page_id % 6 WHEN 0 THEN '<td background = \"x.png\">' WHEN 3 THEN '<p style=\"color: red; background: URL (x)\">' WHEN 4 THEN '<!-- background=x -->' ELSE '' END"
    pages = A.read(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr(extra)).alias("html"))
    return pages.select("page_id", V.has_unresolved_visual("html").alias("unresolved"))


INFO = """named_struct('mime', CASE p_partkey % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'image/jpeg' ELSE 'image/webp' END,
    'width', cast(p_size * 40 as bigint), 'url', concat('https://upload.wikimedia.org/wikipedia/commons/', cast(p_partkey as string), '.svg?utm=1'),
    'thumburl', CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('https://upload.wikimedia.org/wikipedia/commons/thumb/', cast(p_partkey as string), '.png') END,
    'sha1', CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE repeat('aB', 20) END, 'size', cast(p_retailprice * 9000 as bigint))"""


def download_choices(spark, sf_dir):
    """What to download of each image: the original, a drawing with a fallback, or a rendering."""
    parts = A.read(spark, sf_dir, "part").select("p_partkey", V.download_choice(F.expr(INFO)).alias("c"))
    return parts.select("p_partkey", "c.url", "c.mime", "c.sha1", "c.size", "c.fallback", "c.fault")


def article_availability(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", V.availability(k % 5 - 3, k % 3 == 0, k % 7 == 0, k % 2 == 0).alias("availability"))


def version_choice(spark, sf_dir):
    """Which copy of each part's article to show: packs, saves, caches and online revisions are order lines."""
    requests = A.read(spark, sf_dir, "part").select(F.lit("enwiki").alias("project"), F.col("p_partkey").alias("page_id"), (F.col("p_size") % 2 == 0).alias("online"))
    place = F.element_at(F.array(*map(F.lit, ("pack", "saved", "cache", "online"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = A.read(spark, sf_dir, "lineitem").select(
        F.lit("enwiki").alias("project"), F.col("l_partkey").alias("page_id"), place.alias("location"),
        F.col("l_orderkey").alias("revision_id"), (F.col("l_returnflag") != "R").alias("complete"),
    )
    one = lines.groupBy("project", "page_id", "location").agg(F.min("revision_id").alias("revision_id"), F.min("complete").alias("complete"))
    return grounding.choose_versions(requests, one)


def required_media_totals(spark, sf_dir):
    """Distinct required objects, their bytes, and digests that are stated with two sizes or types."""
    objects, owners = A.registry(spark, sf_dir)
    return media.inventory_totals(owners.select("digest").join(objects, "digest"))


def pages_per_namespace(spark, sf_dir):
    """Pages that a filter keeps and drops, by namespace."""
    ns = "CASE WHEN page_id % 10 = 0 THEN 14 WHEN page_id % 10 = 1 THEN 10 WHEN page_id % 10 = 2 THEN 828 WHEN page_id % 10 = 3 THEN 1 ELSE 0 END"
    pages = A.read(spark, sf_dir, "pages").select(F.expr(ns).alias("ns"), F.octet_length("html").alias("bytes"))
    return pages.groupBy("ns").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("bytes").cast("long").alias("bytes"), F.first(F.col("ns").isin(0, 10, 14, 828)).alias("kept")
    )


def bounded_warnings(spark, sf_dir):
    """The 256 least warnings of all order lines, and a notice if there are more."""
    lines = A.read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" is short")).alias("warning"))
    return media.least_warnings(lines)


QUERIES = {
    f.__name__: f
    for f in (
        url_validity, label_validity, date_validity, claims_in_pages, unresolved_visuals, download_choices, article_availability,
        version_choice, required_media_totals, pages_per_namespace, bounded_warnings,
    )
}

_LABEL = r"(length(name) > 0 AND strlen(name) <= 4096 AND NOT regexp_matches(name, '^\s|\s$|[\x00-\x1f\x7f\x{200e}]'))"
_DUCK_INFO = INFO.replace("named_struct(", "struct_pack(").replace("'mime',", "mime :=").replace("'width',", "width :=").replace("'url',", "url :=")
_DUCK_INFO = _DUCK_INFO.replace("'thumburl',", "thumburl :=").replace("'sha1',", "sha1 :=").replace("'size',", "size :=")

ORACLE_SQL = {
    "url_validity": rf"""SELECT page_id, {_VALID_URL} AS external,
            regexp_full_match(m, 'https://(upload|thumb)\.wikimedia\.org/wikipedia/[A-Za-z0-9/%_.,()!~''-]*') AND NOT regexp_matches(m, '[^:]//|/\.\./') AS media,
            starts_with(m, 'https://upload.wikimedia.org/') OR starts_with(m, 'http://upload.wikimedia.org/') AS named
        FROM (SELECT page_id, {URL} AS u, {MEDIA} AS m FROM pages)""",
    "label_validity": rf"""SELECT p_partkey, {_LABEL} AS label,
            CASE WHEN {_LABEL} AND NOT contains(name, '#') AND NOT regexp_matches(canon, '^\s|\s$') AND canon <> '' THEN 'Category:' || canon END AS category,
            replace(trim(regexp_replace(name, '^(File:)+', '')), ' ', '_') AS file_key,
            regexp_full_match(mime, '[A-Za-z0-9-]+/[A-Za-z0-9._+-]+') AS mime, p_partkey % 4 <> 0 AS xml
        FROM (SELECT *, replace(regexp_replace(name, '^Category:', ''), '_', ' ') AS canon FROM (SELECT p_partkey, {NAME} AS name, {MIME} AS mime FROM part))""",
    "date_validity": f"""SELECT o_orderkey, regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT starts_with(d, '0000') AND try_cast(d AS date) IS NOT NULL AS valid
        FROM (SELECT o_orderkey, {DATE} AS d FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders))""",
    "claims_in_pages": r"""SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])' || claim || '([^\p{L}\p{N}_]|$)') AS as_words, contains(text, claim) AS at_all
        FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'an' WHEN 2 THEN 'die' ELSE 'public license' END AS claim FROM documents)""",
    "unresolved_visuals": r"SELECT page_id, page_id % 3 = 0 OR regexp_matches(lower(html), '<[a-z][^<>]*(background\s*=|style\s*=[^<>]*url\s*\()') AS unresolved FROM pages",
    "download_choices": rf"""WITH infos AS (SELECT p_partkey, {_DUCK_INFO} AS i FROM part),
        plain AS (SELECT p_partkey, i.mime AS mime, i.width AS width, regexp_replace(i.url, '\?.*', '') AS own, i.thumburl AS thumb, i.size AS size,
                  CASE WHEN length(i.sha1) = 40 THEN lower(i.sha1) END AS sha1 FROM infos),
        cases AS (SELECT *, CASE WHEN mime IN ('image/png', 'image/jpeg', 'image/webp') AND width BETWEEN 1 AND 1280
                    THEN CASE WHEN sha1 IS NULL THEN 'bad' WHEN size NOT BETWEEN 1 AND 8388608 THEN 'large' ELSE 'own' END
                    WHEN thumb IS NULL THEN 'bad'
                    WHEN mime = 'image/svg+xml' AND size BETWEEN 1 AND 4194304 AND sha1 IS NOT NULL THEN 'drawing' ELSE 'rendering' END AS c FROM plain)
        SELECT p_partkey, CASE WHEN c IN ('own', 'drawing') THEN own WHEN c = 'rendering' THEN thumb END AS url,
            CASE WHEN c IN ('own', 'drawing') THEN mime END AS mime, CASE WHEN c IN ('own', 'drawing') THEN sha1 END AS sha1,
            CASE WHEN c IN ('own', 'drawing') THEN size END AS size, CASE WHEN c = 'drawing' THEN thumb END AS fallback,
            CASE c WHEN 'bad' THEN 'no usable url' WHEN 'large' THEN 'too large' END AS fault FROM cases""",
    "article_availability": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 3 THEN 'pack' WHEN c_custkey % 3 = 0 THEN 'saved' WHEN c_custkey % 7 = 0 THEN 'cached'
            WHEN c_custkey % 2 = 0 THEN 'online' ELSE 'missing' END AS availability FROM customer""",
    "version_choice": """WITH one AS (
            SELECT l_partkey AS page_id, l_linenumber % 4 AS place, min(l_orderkey) AS revision, bool_and(l_returnflag <> 'R') AS complete FROM lineitem GROUP BY 1, 2),
        best AS (
            SELECT page_id, min(place) FILTER (complete AND place < 3) AS place, arg_min(revision, place) FILTER (complete AND place < 3) AS revision,
                   min(revision) FILTER (place = 3) AS current FROM one GROUP BY 1)
        SELECT 'enwiki' AS project, p_partkey AS page_id,
            CASE WHEN p_size % 2 = 0 THEN CASE WHEN current IS NOT NULL THEN 'current' ELSE 'fetch' END
                 WHEN place IS NULL THEN 'missing' ELSE ['pack', 'saved', 'cache'][place + 1] END AS choice,
            CASE WHEN p_size % 2 = 0 AND current IS NOT NULL THEN current ELSE revision END AS revision_id
        FROM part LEFT JOIN best ON p_partkey = page_id""",
    "required_media_totals": f"""WITH {A.REGISTRY}, needed AS (SELECT DISTINCT digest, bytes, mime FROM owners JOIN objects USING (digest))
        SELECT count(DISTINCT digest) AS objects, sum(bytes) AS bytes, count(*) - count(DISTINCT digest) AS conflicts FROM needed""",
    "pages_per_namespace": """SELECT CASE page_id % 10 WHEN 0 THEN 14 WHEN 1 THEN 10 WHEN 2 THEN 828 WHEN 3 THEN 1 ELSE 0 END AS ns,
            count(*) AS pages, sum(strlen(html)) AS bytes, bool_and(page_id % 10 <> 3) AS kept FROM pages GROUP BY 1""",
    "bounded_warnings": """WITH w AS (SELECT DISTINCT 'part ' || l_partkey || ' is short' AS warning FROM lineitem WHERE l_quantity > 30),
        least AS (SELECT warning FROM w ORDER BY warning LIMIT 256)
        SELECT row_number() OVER (ORDER BY warning) AS place, warning FROM least
        UNION ALL SELECT 257, 'more warnings left out' WHERE (SELECT count(*) FROM w) > 256""",
}
