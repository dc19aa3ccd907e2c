"""Dump members: documents written as an export of bz2 members and read again through the guard, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lorekeep.lineage import scratch_dir
from lorekeep.plans import adapters as A
from lorekeep.sources import dump_members

MEMBER_PAGES = 2000
STAMP = "2026-10-31T12:30:00Z"


def _members(spark, sf_dir):
    """An export of all documents and what a guarded reader makes of it."""
    root = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    page = F.col("doc_id") + 1
    pages = A.read(spark, sf_dir, "documents").select(
        page.alias("page_id"),
        F.concat(F.lit("Q&A <"), page.cast("string"), F.lit('> "é" '), F.coalesce("lang", F.lit("-"))).alias("title"),
        (F.col("doc_id") % 3).cast("int").alias("namespace"),
        (F.col("doc_id") + 1_000_000).alias("revision_id"),
        F.lit(STAMP).alias("timestamp"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('To "'), F.coalesce("source", F.lit("-")), F.lit("\" & 'on'"))).alias("redirect_target"),
        "text",
    )
    dump_members.write_members(pages, root, "enwiki", MEMBER_PAGES)
    return dump_members.read_members(spark, root, dump_members.inventory(spark, root), "enwiki")


def dump_member_pages(spark, sf_dir):
    return _members(spark, sf_dir)[0].drop("relative_path")


def dump_member_receipts(spark, sf_dir):
    """Pages, first and last id of each member and the digest of its ids as lines."""
    _, receipts = _members(spark, sf_dir)
    return receipts.select(F.regexp_extract("relative_path", "-p([0-9]+)p", 1).cast("long").alias("start"), "pages", "first", "last", "ids_sha256")


QUERIES = {f.__name__: f for f in (dump_member_pages, dump_member_receipts)}

ORACLE_SQL = {
    "dump_member_pages": f"""SELECT doc_id + 1 AS page_id, 'Q&A <' || (doc_id + 1) || '> "é" ' || coalesce(lang, '-') AS title, (doc_id % 3)::int AS namespace,
            doc_id + 1000000 AS revision_id, '{STAMP}' AS timestamp,
            CASE WHEN doc_id % 5 = 0 THEN 'To "' || coalesce(source, '-') || '" & ''on''' END AS redirect_target FROM documents""",
    "dump_member_receipts": f"""SELECT doc_id // {MEMBER_PAGES} * {MEMBER_PAGES} + 1 AS start, count(*) AS pages, min(doc_id + 1) AS first, max(doc_id + 1) AS last,
            sha256(string_agg((doc_id + 1) || chr(10), '' ORDER BY doc_id)) AS ids_sha256 FROM documents GROUP BY 1""",
}
