"""Canonical bytes of articles and corpora, and their digests.

An article's bytes are compact JSON of fixed fields in a fixed order, its own digest as
zeros. Sections within sections are written in one pass: each gives what opens and what
closes it, and the fragments of an article are joined in the order of their places. A
corpus is digested as a tree over its keys, so that the digest depends on the articles
alone, never on partitions, and no task sees more than a part of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import assert_none
from lorekeep.lineage import save
from lorekeep.operators.part_trees import Articles

# The record's version, the digest before there is one, JSON's short escapes.
SCHEMA_VERSION = 1
ZERO_DIGEST = "0" * 64
SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}

#: Keys under one node of a corpus' tree, and levels of it: page ids below 4096^3.
FAN_OUT = 4096
LEVELS = 3


def json_string(v: Column | str) -> Column:
    """A string as JSON: quote, backslash and control characters escaped, everything else as it is."""
    plain = F.replace(F.replace(F.col(v) if isinstance(v, str) else v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for code in range(32):
        full = F.replace(full, F.lit(chr(code)), F.lit(SHORT_ESCAPES.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def json_array(items: Column, each=json_string) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, each), ","), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """An object of fields that are JSON already, in the order given."""
    return F.concat(F.lit("{"), *(x for k, (name, v) in enumerate(fields.items()) for x in (F.lit(("," if k else "") + f'"{name}":'), v)), F.lit("}"))


def _number(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("string")


def _or_null(v: Column, as_json: Column) -> Column:
    return F.when(v.isNotNull(), as_json).otherwise(F.lit("null"))


def block_json() -> Column:
    """A row of ``Articles.blocks``; what it holds stands under the name of its kind."""
    pair = lambda f: F.concat(F.lit("["), json_string(f["name"]), F.lit(","), json_string(f["value"]), F.lit("]"))
    note = F.col("note")
    held = (
        F.when(F.col("kind") == "paragraph", json_object(Paragraph=json_string("text")))
        .when(F.col("kind") == "list", json_object(List=json_array(F.col("items"))))
        .when(F.col("kind") == "table", json_object(Table=json_array(F.col("rows"), lambda r: json_array(r))))
        .when(F.col("kind") == "infobox", json_object(Infobox=json_array(F.col("fields"), pair)))
        .when(
            F.col("kind") == "footnote",
            json_object(Footnote=json_object(source_id=json_string(note["source_id"]), label=json_string(note["label"]), text=json_string(note["text"]), reference_ids=json_array(note["reference_ids"]))),
        )
    )
    return json_object(ordinal=_number("ordinal"), content=held)


def canonical_articles(heads: DataFrame, made: Articles) -> DataFrame:
    """(body, project, page_id, revision_id, record): the canonical JSON of each article of ``heads``.

    ``heads`` has body, project, page_id, revision_id, timestamp, title, display_title, language, namespace, aliases,
    wikidata_id, links (label, project, page_id, fragment), media (source_url, mime_type, sha256, license, creator,
    attribution, is_av_preview, derivation), rendered_html, is_disambiguation; ``made`` has what their bodies hold. Heads
    whose bodies have a fault give no row. A medium without derivation has no such field.
    """
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), ",")
    blocks = made.blocks.select("body", "section", F.col("ordinal").alias("k"), block_json().alias("j")).groupBy("body", "section").agg(joined("j").alias("blocks"))
    opened = made.sections.join(blocks, ["body", "section"], "left").select(
        "body", "section", F.element_at("section", -1).alias("n"), "heading", F.coalesce("blocks", F.lit("")).alias("blocks")
    )
    head = F.concat(
        F.when(F.col("n") > 1, ",").otherwise(""), F.lit('{"ordinal":'), _number("n"), F.lit(',"heading":'), json_string("heading"), F.lit(',"blocks":['), F.col("blocks"), F.lit('],"subsections":['),
    )
    end = F.concat("section", F.array(F.lit(2**31 - 1)))
    pieces = opened.select("body", F.explode(F.array(F.struct(F.col("section").alias("at"), head.alias("j")), F.struct(end.alias("at"), F.lit("]}").alias("j")))).alias("p"))
    sections = pieces.groupBy("body").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["j"]), "").alias("sections"))
    lead = blocks.where(F.size("section") == 0).select("body", F.col("blocks").alias("lead"))
    reference = json_object(id=json_string("id"), label=json_string("label"), source_url=_or_null(F.col("source_url"), json_string("source_url")))
    references = made.references.select("body", F.col("number").alias("k"), reference.alias("j")).groupBy("body").agg(joined("j").alias("references"))
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.col(c), F.lit("")), F.lit("]"))
    key = lambda project, page: json_object(project=json_string(project), page_id=_number(page))
    link = lambda x: json_object(label=json_string(x["label"]), target=key(x["project"], x["page_id"]), fragment=_or_null(x["fragment"], json_string(x["fragment"])))
    flag = lambda v: v.cast("string")

    def medium(x: Column) -> Column:
        texts = {n: json_string(x[n]) for n in ("source_url", "mime_type")} | {"sha256": _or_null(x["sha256"], json_string(x["sha256"]))}
        texts |= {n: json_string(x[n]) for n in ("license", "creator", "attribution")} | {"is_av_preview": flag(x["is_av_preview"])}
        whole = json_object(**texts)
        derived = F.concat(F.lit(',"derivation":'), json_string(x["derivation"]), F.lit("}"))
        return F.when(x["derivation"].isNull(), whole).otherwise(F.concat(F.regexp_replace(whole, r"\}$", ""), derived))

    record = json_object(
        schema_version=F.lit(str(SCHEMA_VERSION)),
        key=key(F.col("project"), F.col("page_id")),
        revision=json_object(revision_id=_number("revision_id"), timestamp=json_string("timestamp"), content_sha256=F.lit(f'"{ZERO_DIGEST}"')),
        title=json_string("title"), display_title=json_string("display_title"), language=json_string("language"), namespace=_number("namespace"),
        aliases=json_array(F.col("aliases")), wikidata_id=_or_null(F.col("wikidata_id"), json_string("wikidata_id")),
        lead=listed("lead"), sections=listed("sections"), references=listed("references"),
        links=json_array(F.col("links"), link), media=json_array(F.col("media"), medium), rendered_html=json_string("rendered_html"), is_disambiguation=flag(F.col("is_disambiguation")),
    )
    whole = heads.join(made.faults.select("body"), "body", "left_anti")
    for part in (lead, sections, references):
        whole = whole.join(part, "body", "left")
    return whole.select("body", "project", "page_id", "revision_id", record.alias("record"))


def with_digest(records: DataFrame) -> DataFrame:
    """``records`` with ``content_sha256``, the digest of ``record``."""
    return records.withColumn("content_sha256", F.sha2("record", 256))


def corpus_digest(articles: DataFrame) -> DataFrame:
    """One row (articles, digest) for a corpus of (project, page_id, revision_id, content_sha256).

    The lines ``page revision digest`` of up to ``FAN_OUT`` neighbouring page ids are digested in order, then the lines
    ``number digest`` of as many of those, ``LEVELS`` times; last the lines ``project digest`` of all projects. An article
    that comes twice, or a page id beyond the tree, is an error.
    """
    articles = save(articles.select("project", "page_id", "revision_id", "content_sha256"), "article-digests")  # checked and digested: made once
    assert_none(articles.groupBy("project", "page_id", "revision_id").count().where("count > 1"), "DuplicateArticle", "project", "page_id", "revision_id")
    assert_none(articles.where((F.col("page_id") < 0) | (F.col("page_id") >= FAN_OUT**LEVELS)), "PageIdOutOfRange", "project", "page_id")
    text = F.concat_ws(" ", _number("page_id"), _number("revision_id"), "content_sha256")
    level = articles.select("project", F.floor(F.col("page_id") / FAN_OUT).alias("up"), F.struct(F.col("page_id").alias("a"), F.col("revision_id").alias("b"), text.alias("line")).alias("x"), F.lit(1).cast("long").alias("n"))
    for _ in range(LEVELS):
        lines = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n"), F.lit("\n"))
        named = level.groupBy("project", "up").agg(F.sha2(lines, 256).alias("d"), F.sum("n").alias("n"))
        text = F.concat_ws(" ", _number("up"), "d")
        level = named.select("project", F.floor(F.col("up") / FAN_OUT).alias("next"), F.struct(F.col("up").alias("a"), F.lit(0).cast("long").alias("b"), text.alias("line")).alias("x"), "n", "d").withColumnRenamed("next", "up")
    lines = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("project", "d"))), lambda x: F.concat_ws(" ", x["project"], x["d"])), "\n"), F.lit("\n"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("articles"), F.sha2(lines, 256).alias("digest"))
