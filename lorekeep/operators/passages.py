"""Where a cited passage stands in a page's HTML.

Evidence comes from structured text, a page shows rendered HTML: a passage is found by
its exact words, and only where one paragraph alone has them. Paragraphs are listed with
their byte ranges in one pass over each page; finding passages is a join on page and words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A tag with quoted attributes, entities of serialised text, kinds of blocks with words of their own.
TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z0-9]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>")
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&#39;": "'"}
WORDED = ("paragraph", "quote")
CITED_ID = "cited"
BLANK = r"[\s\x{85}\p{Z}]+"

_ENTITY = re.compile("|".join(map(re.escape, ENTITIES)))
_SCHEMA = pa.schema([("page_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("forms", pa.list_(pa.string()))])


def _words(pieces: list[str]) -> str:
    return " ".join(_ENTITY.sub(lambda m: ENTITIES[m[0]], "".join(pieces)).split())


def page_paragraphs(html: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, forms) of each paragraph of sanitised HTML, in bytes; its words with and without superscripts.

    A page with a tag that never ends has none.
    """
    found, texts, start, raised = [], None, 0, 0
    at = bytes_at = 0
    while (lt := html.find("<", at)) >= 0:
        tag = TAG.match(html, lt)
        if not tag:
            return []
        if texts is not None:
            texts.append((html[at:lt], raised > 0))
        opened = bytes_at + len(html[at:lt].encode())
        bytes_at = opened + len(tag[0].encode())
        closing, name = bool(tag["close"]), tag["name"]
        if name == "p" and not closing:
            texts, start, raised = [], opened, 0
        elif name == "p" and texts is not None:
            full, bare = _words([t for t, _ in texts]), _words([t for t, up in texts if not up])
            found.append((start, bytes_at, [full] if full == bare else [full, bare]))
            texts = None
        elif name == "sup" and texts is not None:
            raised = max(0, raised + (-1 if closing else 1))
        at = tag.end()
    return found


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, start, end, forms) of all paragraphs of ``pages`` (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = page_paragraphs(html or "")
                if rows:
                    yield pa.RecordBatch.from_pylist([{"page_id": page, "start": s, "end": e, "forms": f} for s, e, f in rows], _SCHEMA)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, start long, end long, forms array<string>")


def locate(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, block_id, status, start, end) of ``passages`` (page_id, block_id, kind, text) in ``pages`` (page_id, html).

    Status is ``located`` where exactly one paragraph has a passage's words, with its bytes; ``ambiguous`` where several
    have, ``absent`` where none has, and ``wordless`` for passages of other kinds or without words. White space counts alike.
    """
    words = F.trim(F.regexp_replace("text", BLANK, " "))
    asked = passages.select(F.col("page_id").cast("long").alias("page_id"), "block_id", F.when(F.col("kind").isin(*WORDED) & (words != ""), words).alias("words"))
    forms = paragraphs(pages).select("page_id", "start", "end", F.explode("forms").alias("words"))
    hits = asked.where("words is not null").join(forms, ["page_id", "words"]).groupBy("page_id", "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.min("end").alias("end")
    )
    status = F.when(F.col("words").isNull(), "wordless").when(F.col("n").isNull(), "absent").when(F.col("n") > 1, "ambiguous").otherwise("located")
    told = asked.join(hits, ["page_id", "block_id"], "left").withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "located", F.col(c)).alias(c)
    return told.select("page_id", "block_id", "status", only("start"), only("end"))


def _escaped(v: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(raw), F.lit(entity))
    return v


def marked(html: Column, status: Column, start: Column, end: Column, headings: Column, excerpt: Column) -> Column:
    """The page's HTML with the passage's paragraph in a marked element, or the passage itself above the page where it wasn't located."""
    raw = F.encode(html, "UTF-8")
    part = lambda a, n: F.substring(raw, (a + 1).cast("int"), n.cast("int")).cast("string")
    opening = f'<div id="{CITED_ID}" class="{CITED_ID}">'
    inside = F.concat(part(F.lit(0), start), F.lit(opening), part(start, end - start), F.lit("</div>"), part(end, F.octet_length(raw) - end))
    where = F.when(F.size(headings) == 0, F.lit("Introduction")).otherwise(F.array_join(headings, " › "))
    above = F.concat(
        F.lit(f'{opening}<p class="{CITED_ID}-note">Cited passage ('), _escaped(where), F.lit("). Its place in this page could not be found.</p><p>"), _escaped(excerpt), F.lit("</p></div>"), html
    )
    return F.when(status == "located", inside).otherwise(above)
