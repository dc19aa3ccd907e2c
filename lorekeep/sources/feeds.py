"""Replies and feeds in JSON: each row gets its values or the first thing wrong with it, and batch readers raise that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none, assert_rules
from lorekeep.functions import text as T
from lorekeep.operators import joins
from lorekeep.operators.audit import duplicates
from lorekeep.sources import dumps

MOST_TOMBSTONES = 10_000
MOST_LINE_BYTES = 64 << 10
UTC_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"

REVISION_REPLY = (
    "query STRUCT<redirects: ARRAY<STRING>, normalized: ARRAY<STRING>, interwiki: ARRAY<STRING>, pages: ARRAY<STRUCT<pageid: BIGINT, ns: INT, "
    "title: STRING, missing: BOOLEAN, invalid: BOOLEAN, redirect: BOOLEAN, revisions: ARRAY<STRUCT<revid: BIGINT, timestamp: STRING>>>>>"
)


def revision_replies(replies: DataFrame) -> DataFrame:
    """(page_id, title, revision_id, timestamp, fault) of current-revision replies (page_id, body).

    A reply that went through a redirect or another alias, that is of another page, or that has
    not exactly one article and revision has a fault and no values.
    """
    q = F.from_json("body", REVISION_REPLY)["query"]
    page = F.get(q["pages"], F.lit(0))
    one = F.get(page["revisions"], F.lit(0))
    alias = q["redirects"].isNotNull() | q["normalized"].isNotNull() | q["interwiki"].isNotNull()
    fault = (
        F.when(F.col("page_id") <= 0, "InvalidIdentity")
        .when(q.isNull(), "InvalidResponse")
        .when(alias, "RedirectNeedsResolution")
        .when(F.coalesce(F.size(q["pages"]), F.lit(-1)) != 1, "InvalidResponse")
        .when(page["missing"].isNotNull() | page["invalid"].isNotNull(), "MissingPage")
        .when(page["redirect"].isNotNull(), "RedirectNeedsResolution")
        .when(~page["pageid"].eqNullSafe(F.col("page_id")) | ~F.coalesce(T.valid_title(page["title"]), F.lit(False)) | ~page["ns"].eqNullSafe(F.lit(0)), "InvalidIdentity")
        .when(F.coalesce(F.size(page["revisions"]), F.lit(-1)) != 1, "InvalidResponse")
        .when(~F.coalesce((one["revid"] > 0) & one["timestamp"].rlike(UTC_TIME), F.lit(False)), "InvalidIdentity")
    )
    good = fault.isNull()
    return replies.select(
        "page_id", F.when(good, page["title"]).alias("title"), F.when(good, one["revid"]).alias("revision_id"),
        F.when(good, one["timestamp"]).alias("timestamp"), fault.alias("fault"),
    )


RENDERED_REPLY = "parse STRUCT<pageid: BIGINT, revid: BIGINT, title: STRING, text: STRING>"


def rendered_replies(replies: DataFrame) -> DataFrame:
    """(page_id, html, fault) of renderings (page_id, revision_id, title, body) pinned to a revision that was asked for."""
    p = F.from_json("body", RENDERED_REPLY)["parse"]
    fault = (
        F.when(p.isNull() | p["text"].isNull(), "InvalidResponse")
        .when(~p["pageid"].eqNullSafe(F.col("page_id")) | ~p["title"].eqNullSafe(F.col("title")), "InvalidIdentity")
        .when(~p["revid"].eqNullSafe(F.col("revision_id")), "RevisionChanged")
        .when(F.trim(p["text"]) == "", "InvalidResponse")
    )
    return replies.select("page_id", F.when(fault.isNull(), p["text"]).alias("html"), fault.alias("fault"))


MAP_REPLY = "query STRUCT<pages: ARRAY<STRUCT<pageid: BIGINT, mapdata: ARRAY<STRING>>>>"


def map_groups(replies: DataFrame) -> DataFrame:
    """(page_id, group, features, fault): the groups of map replies (page_id, groups, body), exactly those that were asked for.

    Features are JSON texts; a single feature is a list of one. A reply with a fault is one row.
    """
    pages = F.from_json("body", MAP_REPLY)["query"]["pages"]
    chunks = F.transform(F.get(pages, F.lit(0))["mapdata"], lambda c: F.from_json(c, "map<string,string>"))
    names = F.flatten(F.transform(chunks, F.map_keys))
    foreign = F.array_min(F.array_except("names", "groups"))
    lacking = F.array_min(F.array_except("groups", "names"))
    rows = replies.select("page_id", "groups", pages.alias("pages"), chunks.alias("chunks"), names.alias("names"))
    fault = (
        F.when(F.coalesce(F.size("pages"), F.lit(-1)) != 1, "InvalidResponse")
        .when(~F.col("pages")[0]["pageid"].eqNullSafe(F.col("page_id")), "WrongPage")
        .when(F.col("names").isNull() | F.exists("chunks", lambda c: c.isNull()), "InvalidResponse")
        .when(foreign.isNotNull(), F.concat(F.lit("GroupMismatch: "), foreign))
        .when(F.size("names") != F.size(F.array_distinct("names")), "GroupMismatch: twice")
        .when(lacking.isNotNull(), F.concat(F.lit("GroupMismatch: "), lacking))
    )
    told = rows.withColumn("fault", fault)
    good = told.where("fault is null").select("page_id", F.explode("chunks").alias("c")).select("page_id", F.explode("c").alias("group", "v"))
    texts = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    none = F.lit(None).cast("string")
    return good.select("page_id", "group", texts.alias("features"), none.alias("fault")).unionByName(
        told.where("fault is not null").select("page_id", none.alias("group"), F.lit(None).cast("array<string>").alias("features"), "fault")
    )


DELETION = "schema_version INT, project STRING, generation_id STRING, page_id BIGINT"


def deletions(lines: DataFrame, project: str, generation: str, most: int | None = MOST_TOMBSTONES) -> DataFrame:
    """(project, page_id, generation_id) of a deletion feed's lines (line, value): one project and generation, no page twice.

    Lines end in a line feed alone; a feed of more than ``most`` is an error. Pin the file's digest with ``dumps.pinned``.
    """
    assert_rules(
        lines,
        {"OversizedRecord": F.octet_length("value") < MOST_LINE_BYTES, "InvalidTerminator": ~F.col("value").endswith("\r")},
        "line",
    )
    rows = lines.select("line", F.from_json("value", DELETION).alias("r")).select("line", "r.*")
    own = (F.col("schema_version") == 1) & (F.col("project") == project) & (F.col("generation_id") == generation) & (F.col("page_id") > 0)
    assert_rules(rows, {"InvalidRecord": own}, "line")
    assert_none(duplicates(rows, ["page_id"]), "DuplicateRecord", "page_id")
    if most is not None and rows.limit(most + 1).count() > most:
        raise LorekeepError("TooManyRecords")
    return rows.select("project", "page_id", "generation_id")


REGULAR = (
    "name STRING, identifier BIGINT, version STRUCT<identifier: BIGINT>, date_modified STRING, is_part_of STRUCT<identifier: STRING>, "
    "in_language STRUCT<identifier: STRING>, namespace STRUCT<identifier: INT>, article_body STRUCT<html: STRING>, "
    "categories ARRAY<STRUCT<name: STRING>>, redirects ARRAY<STRUCT<name: STRING>>"
)


def regular_records(lines: DataFrame, generation: str, complete: bool = True) -> DataFrame:
    """Companions of structured records (line, value): project, page_id, revision_id, generation_id, date_modified, language,
    namespace, name, html, categories, redirects.

    Missing fields are errors; so are, in a ``complete`` snapshot, lists of memberships that are left out.
    """
    rows = dumps.read_records(lines, REGULAR)

    def given(c: Column) -> Column:
        return F.coalesce(F.trim(c) != "", F.lit(False))

    rules = {
        "MissingField name": given(F.col("name")), "MissingField version": F.col("version.identifier") > 0,
        "MissingField is_part_of": given(F.col("is_part_of.identifier")), "MissingField article_body": given(F.col("article_body.html")),
        "MissingField date_modified": given(F.col("date_modified")), "MissingField in_language": given(F.col("in_language.identifier")),
    }
    if complete:
        rules |= {f"MissingField {c}": F.col(c).isNotNull() for c in ("categories", "redirects")}
    assert_rules(rows, rules, "line")
    empty = F.array().cast("array<string>")
    return rows.select(
        F.col("is_part_of.identifier").alias("project"), F.col("identifier").alias("page_id"), F.col("version.identifier").alias("revision_id"),
        F.lit(generation).alias("generation_id"), "date_modified", F.col("in_language.identifier").alias("language"),
        F.coalesce("namespace.identifier", F.lit(0)).alias("namespace"), "name", F.col("article_body.html").alias("html"),
        F.coalesce(F.col("categories")["name"], empty).alias("categories"), F.coalesce(F.col("redirects")["name"], empty).alias("redirects"),
    )


def join_scoped(structured: DataFrame, regular: DataFrame, project: str, generation: str, deleted: DataFrame) -> DataFrame:
    """``joins.join_components`` of one project and generation: records and tombstones of others are errors."""
    for side in (structured, regular, deleted):
        assert_none(side.where(~(F.col("project").eqNullSafe(F.lit(project)) & F.col("generation_id").eqNullSafe(F.lit(generation)))), "OutOfScope", "project", "page_id")
    return joins.join_components(structured, regular, regular, deleted)
