"""Sources: checksum inventories, XML dumps, NDJSON feeds, census texts. All fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none, assert_rules
from lorekeep.lineage import save
from lorekeep.operators.audit import duplicates, not_increasing_overall, overlaps

CHECKSUM_LINE = r"^([0-9a-fA-F]{64}) [ *](.+)$"
RANGE_IN_NAME = r"-p(\d+)p(\d+)\."
ORDINAL_IN_NAME = r"(\d+)\.xml"


def parse_checksums(lines: DataFrame) -> DataFrame:
    """(relative_path, sha256) of SHA256SUMS lines (value), sorted by path.

    Malformed lines, unsafe paths and paths that differ by case only are errors.
    """
    parsed = lines.where("value <> ''").select(
        "value",
        F.lower(F.regexp_extract("value", CHECKSUM_LINE, 1)).alias("sha256"),
        F.regexp_extract("value", CHECKSUM_LINE, 2).alias("relative_path"),
    )
    parts = F.split("relative_path", "/")
    assert_rules(
        parsed,
        {
            "MalformedLine": F.col("sha256") != "",
            "UnsafePath": ~F.col("relative_path").startswith("/") & ~F.col("relative_path").contains("\\")
            & ~F.exists(parts, lambda p: p.isin("", ".", "..")),
        },
        "value",
    )
    assert_none(duplicates(parsed, [F.lower("relative_path").alias("path")]), "DuplicatePath", "path")
    return parsed.select("relative_path", "sha256").orderBy("relative_path")


def page_range(path: Column | str) -> tuple[Column, Column]:
    """The ids a shard's name declares, null without."""
    def part(k: int) -> Column:
        return F.try_to_number(F.nullif(F.regexp_extract(path, RANGE_IN_NAME, k), F.lit("")), F.lit("9" * 18)).cast("long")

    return part(1), part(2)


def check_export(members: DataFrame) -> DataFrame:
    """Shards with their ranges; missing or overlapping ranges are errors."""
    start, end = page_range("relative_path")
    ranged = members.select("*", start.alias("start"), end.alias("end"), F.lit(0).alias("export"))
    assert_none(ranged.where("start is null or end is null or start > end or start < 1"), "InvalidRange", "relative_path")
    assert_none(overlaps(ranged, "start", "end", "export", "relative_path"), "OverlappingRanges", "relative_path")
    return ranged.drop("export")


def verify_files(files: DataFrame, members: DataFrame) -> DataFrame:
    """Files (relative_path, content) whose digest is the declared one; missing, surplus or changed ones are errors."""
    hashed = files.select("relative_path", "content", F.sha2("content", 256).alias("actual"))
    both = hashed.join(members, "relative_path", "full_outer")
    assert_none(both.where("sha256 is null"), "UndeclaredFile", "relative_path")
    assert_none(both.where("actual is null"), "MissingFile", "relative_path")
    assert_none(both.where("actual <> sha256").drop("content"), "DigestMismatch", "relative_path")
    return hashed.select("relative_path", "content")


DUMP_SCHEMA = (
    "title STRING, ns INT, id BIGINT, redirect STRUCT<_title: STRING>, "
    "revision ARRAY<STRUCT<id: BIGINT, timestamp: STRING, text: STRING>>"
)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump, plain or bz2: page_id, title, namespace, revision_id, timestamp, redirect_target."""
    pages = spark.read.format("xml").option("rowTag", "page").option("mode", "FAILFAST").schema(DUMP_SCHEMA).load(path)
    assert_rules(
        pages,
        {
            "InvalidPageId": F.col("id") > 0,
            "NotOneRevision": F.size("revision") == 1,
            "InvalidTimestamp": F.try_to_timestamp(F.col("revision")[0]["timestamp"]).isNotNull(),
        },
        "id",
    )
    one = F.col("revision")[0]
    return pages.select(
        F.col("id").alias("page_id"), "title", F.col("ns").alias("namespace"), one["id"].alias("revision_id"),
        one["timestamp"].alias("timestamp"), F.col("redirect._title").alias("redirect_target"),
    )


STRUCTURED = (
    "name STRING, identifier BIGINT, version STRUCT<identifier: BIGINT>, date_modified STRING, "
    "is_part_of STRUCT<identifier: STRING>, in_language STRUCT<identifier: STRING>, namespace STRUCT<identifier: INT>"
)


def read_records(lines: DataFrame, schema: str, id_field: str = "identifier") -> DataFrame:
    """JSON records of text lines (line, value); blank, malformed and repeated ones are errors."""
    parsed = lines.select("line", "value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    assert_rules(
        parsed, {"BlankLine": F.trim("value") != "", "MalformedRecord": F.col(f"r.{id_field}").isNotNull()}, "line"
    )
    assert_none(duplicates(parsed, [F.col(f"r.{id_field}").alias("id")]), "DuplicateRecord", "id")
    return parsed.select("line", "r.*")


REVISION = (
    "schema_version INT, project STRING, generation_id STRING, page_id BIGINT, namespace INT, title STRING, revision_id BIGINT, "
    "timestamp STRING, redirect_target STRING, wikitext STRING, wikitext_sha256 STRING"
)


def read_revisions(lines: DataFrame) -> DataFrame:
    """Revision records (line, value): schema version, digest of the text, time and order of ids are checked."""
    rows = read_records(lines, REVISION, "page_id")
    assert_rules(
        rows,
        {
            "UnsupportedSchema": F.col("schema_version") == 1,
            "DigestMismatch": F.sha2("wikitext", 256) == F.col("wikitext_sha256"),
            "InvalidTimestamp": F.try_to_timestamp("timestamp").isNotNull(),
            "LaterThanGeneration": F.substring("timestamp", 1, 10) <= F.col("generation_id"),
        },
        "line",
    )
    assert_none(not_increasing_overall(rows, "line", "page_id"), "UnsortedPages", "line")
    return rows


def read_census(lines: DataFrame) -> DataFrame:
    """(id) of a census text (line, value): canonical decimals, strictly increasing."""
    assert_rules(lines, {"InvalidId": F.col("value").rlike("^[1-9][0-9]{0,17}$")}, "line")
    ids = lines.select("line", F.col("value").cast("long").alias("id"))
    assert_none(not_increasing_overall(ids, "line", "id"), "UnsortedIds", "line")
    return ids.select("id")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Lines of a text file, of less than 2 GB, whose whole content has the given digest."""
    whole = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    assert_none(whole.where(F.col("sha256") != sha256), "PinMismatch", "path")
    return spark.read.text(path)


SEARCH_REPLY = "query STRUCT<search: ARRAY<STRUCT<ns: INT, title: STRING, pageid: BIGINT>>>"


def search_hits(replies: DataFrame, limit: int) -> DataFrame:
    """Hits of search replies (request, body) in order: articles only, no page twice, at most ``limit``."""
    hits = replies.select("request", F.posexplode(F.from_json("body", SEARCH_REPLY)["query"]["search"]).alias("place", "h")).select(
        "request", "place", F.col("h.title").alias("title"), F.col("h.pageid").alias("page_id"), F.col("h.ns").alias("ns")
    )
    assert_none(hits.where("ns <> 0 or page_id is null or page_id <= 0"), "InvalidHit", "request", "place")
    assert_none(duplicates(hits, ["request", "page_id"]), "DuplicateHit", "request", "page_id")
    return hits.where(F.col("place") < limit).drop("ns")


TITLE_REPLY = (
    "query STRUCT<normalized: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, redirects: ARRAY<STRUCT<`from`: STRING, `to`: STRING>>, "
    "pages: ARRAY<STRUCT<pageid: BIGINT, ns: INT, title: STRING>>>"
)


def resolved_titles(replies: DataFrame) -> DataFrame:
    """Title replies (requested, body): the page that the chain of normalisations and redirects ends at."""
    q = F.from_json("body", TITLE_REPLY)["query"]
    empty = F.array().cast("array<struct<from:string,to:string>>")
    rows = replies.select("requested", F.concat(F.coalesce(q["normalized"], empty), F.coalesce(q["redirects"], empty)).alias("edges"), q["pages"].alias("pages"))
    end = F.aggregate("edges", F.col("requested"), lambda at, e: F.when(e["from"] == at, e["to"]).otherwise(at))
    page = F.get(F.filter("pages", lambda p: p["title"] == F.col("title")), F.lit(0))
    found = rows.withColumn("title", end).withColumn("page", page)
    assert_none(found.where("page is null or page.pageid is null"), "Unresolved", "requested")
    return found.select("requested", "title", F.col("page.pageid").alias("page_id"))


IMAGE_REPLY = "query STRUCT<pages: ARRAY<STRUCT<title: STRING, imageinfo: ARRAY<STRUCT<url: STRING, mime: STRING, sha1: STRING>>>>>"


def image_metadata(replies: DataFrame, files: DataFrame) -> DataFrame:
    """Image information in the order of the request (place, title); a file without any is an error."""
    pages = replies.select(F.explode(F.from_json("body", IMAGE_REPLY)["query"]["pages"]).alias("p")).select(
        F.col("p.title").alias("title"), F.get("p.imageinfo", F.lit(0)).alias("i")
    )
    found = files.join(pages, "title", "left")
    assert_none(found.where("i is null"), "MissingImage", "place")
    return found.select("place", "title", "i.url", "i.mime", "i.sha1").orderBy("place")


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of text files in the order of their names: numbers count from 1.

    Files are read in splits; a line's number is its place in its split and the lines of the
    splits before, of which one row each is sorted.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"),
    )
    read = save(lines, "lines")
    splits = read.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # over a row of each split
    bases = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read.join(bases, ["file", "start"]).select((F.col("base") + F.col("row") - F.col("first") + 1).alias("line"), "value")


def contiguous(frames: DataFrame) -> DataFrame:
    """Frames (shard, offset, bytes) checked to follow each other without gap or overlap from 0."""
    w = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    at = frames.withColumn("expected", F.coalesce(F.sum("bytes").over(w), F.lit(0)))
    assert_none(at.where("offset <> expected"), "Gap", "shard", "offset")
    return frames


def require(ok: bool, code: str) -> None:
    if not ok:
        raise LorekeepError(code)
