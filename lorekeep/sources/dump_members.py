"""Members of an XML dump: written by page range, and read again through a guard that fails closed.

A member is one file, plain or bz2, named in a checksum inventory. Each is decoded in
bounded pieces inside a task and fed to an incremental parser that keeps a path of open
elements and the fields of one page, no text. Faults end a member for good; the first
one over all members, in the order of their paths, is raised, so that no page of a bad
export gets out.
"""

from __future__ import annotations

import bz2
import hashlib
import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import assert_none, assert_rules
from lorekeep.functions import validity as V
from lorekeep.lineage import save
from lorekeep.sources.dumps import check_export

# Limits of the envelope and of fields, and the name of the export's namespace.
MOST_DEPTH = 64
MOST_TAG_BYTES = 64 * 1024
MOST_FIELD_BYTES = 16 * 1024
MOST_ID = 2**63 - 1
MOST_NAMESPACE = 2**31 - 1
EXPORT_NAMESPACE = re.compile(r"http://www\.mediawiki\.org/xml/export-0\.[0-9]{1,3}/")
ELEMENT_NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_:.-]*")
PROJECT = re.compile(r"[a-z]([a-z0-9_]{0,253}[a-z0-9])?")
UTC_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"

#: Bytes decoded at once.
PIECE = 1 << 18
#: Bytes of a member, as stored and decoded, unless the caller sets others; a file comes to its task whole.
MOST_COMPRESSED = 1 << 30
MOST_DECODED = 1 << 36

#: Elements whose text is a field, by the path they stand at.
FIELDS = {
    ("mediawiki", "siteinfo", "dbname"): "database",
    ("mediawiki", "page", "title"): "title",
    ("mediawiki", "page", "ns"): "namespace",
    ("mediawiki", "page", "id"): "page_id",
    ("mediawiki", "page", "revision", "id"): "revision_id",
    ("mediawiki", "page", "revision", "timestamp"): "timestamp",
}
#: Elements that may stand at one path only.
PLACES = {"mediawiki": (), "siteinfo": ("mediawiki",), "page": ("mediawiki",), "revision": ("mediawiki", "page")}
NUMBERS = {"namespace": (0, MOST_NAMESPACE), "page_id": (1, MOST_ID), "revision_id": (1, MOST_ID)}

PAGE = "title: string, namespace: int, page_id: long, redirect_target: string, revision_id: long, timestamp: string"
RECEIPT = "sha256: string, compressed: long, decoded: long, pages: long, first: long, last: long, ids_sha256: string"
PARSED = f"path string, page struct<{PAGE}>, receipt struct<{RECEIPT}>, fault string"


class MemberFault(Exception):
    """A rule that a member breaks; its argument is the rule's code."""


class PageEvents:
    """The pages of one export document, given in pieces of any size."""

    def __init__(self, project: str | None) -> None:
        self.project, self.path, self.default = project, [], None
        self.field: str | None = None
        self.text: list[str] = []
        self.page: dict | None = None
        self.revised = self.site = self.named = False
        self.pages: list[dict] = []
        self.count, self.failed = 0, False
        p = self.parser = expat.ParserCreate("UTF-8", "\n")
        p.buffer_text = True
        p.XmlDeclHandler, p.StartDoctypeDeclHandler, p.StartNamespaceDeclHandler = self._declaration, self._doctype, self._scope
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self._characters
        p.CommentHandler = p.ProcessingInstructionHandler = p.StartCdataSectionHandler = self._plain_only

    def feed(self, piece: bytes, last: bool = False) -> list[dict]:
        """The pages that end within this piece. After a fault every call is one."""
        if self.failed:
            raise MemberFault("Poisoned")
        try:
            self.parser.Parse(piece, last)
            if last and not self.count:
                raise MemberFault("NoPages")
        except expat.ExpatError as bad:
            self.failed = True
            raise MemberFault("InvalidXmlText" if bad.code in (expat.errors.codes[expat.errors.XML_ERROR_INVALID_TOKEN], expat.errors.codes[expat.errors.XML_ERROR_PARTIAL_CHAR]) else "InvalidXmlDocument") from None
        except MemberFault:
            self.failed = True
            raise
        done, self.pages = self.pages, []
        return done

    def _declaration(self, version: str, encoding: str | None, standalone: int) -> None:
        if version != "1.0" or (encoding or "utf-8").lower() != "utf-8":
            raise MemberFault("InvalidDeclaration")

    def _doctype(self, *_) -> None:
        raise MemberFault("DoctypeRefused")

    def _scope(self, prefix: str | None, uri: str | None) -> None:
        """The default namespace is the export's, declared by the root; below it may be declared again, not changed."""
        if prefix is None:
            if not self.path and EXPORT_NAMESPACE.fullmatch(uri or ""):
                self.default = uri
            elif not self.path or uri != self.default:
                raise MemberFault("ForeignNamespace")

    def _local(self, name: str) -> str:
        uri, _, local = name.rpartition("\n")
        return local if uri == (self.default or "") else name

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        local, at = self._local(name), tuple(self.path)
        if not ELEMENT_NAME.fullmatch(name.rpartition("\n")[2]):
            raise MemberFault("InvalidName")
        if len(at) >= MOST_DEPTH:
            raise MemberFault("TooDeep")
        if len(name) + sum(len(k) + len(v.encode()) for k, v in attributes.items()) > MOST_TAG_BYTES:
            raise MemberFault("TagTooLong")
        if self.field:
            raise MemberFault("MarkupInField")
        if PLACES.get(local, at) != at or (not at and local != "mediawiki") or (at == ("mediawiki",) and local not in PLACES):
            raise MemberFault("MisplacedElement")
        self.path.append(local)
        if local == "siteinfo":
            if self.site or self.count or self.page is not None:
                raise MemberFault("MisplacedElement")
            self.site = True
        elif local == "page":
            self.page, self.revised = {"redirect_target": None}, False
        elif local == "revision":
            if self.revised:
                raise MemberFault("NotOneRevision")
            if any(f not in self.page for f in ("title", "namespace", "page_id")):
                raise MemberFault("MissingField")
            self.revised = True
        elif local == "redirect" and at == ("mediawiki", "page"):
            if self.page["redirect_target"] is not None:
                raise MemberFault("DuplicateField")
            if self.revised or list(attributes) != ["title"]:
                raise MemberFault("InvalidField")
            self.page["redirect_target"] = attributes["title"]
        self.field, self.text = FIELDS.get((*at, local)), []

    def _characters(self, text: str) -> None:
        if self.field:
            self.text.append(text)
            if sum(len(t.encode()) for t in self.text) > MOST_FIELD_BYTES:
                raise MemberFault("FieldTooLong")
        elif self.path in (["mediawiki"], ["mediawiki", "page", "redirect"]) and text.strip():
            raise MemberFault("MisplacedText")

    def _plain_only(self, *_) -> None:
        if self.field:
            raise MemberFault("MarkupInField")

    def _end(self, name: str) -> None:
        at = tuple(self.path)
        if self.field:
            self._field("".join(self.text))
            self.field = None
        elif at == ("mediawiki", "page", "revision"):
            if any(f not in self.page for f in ("revision_id", "timestamp")):
                raise MemberFault("MissingField")
        elif at == ("mediawiki", "page"):
            if not self.revised:
                raise MemberFault("NotOneRevision")
            self.pages.append(self.page)
            self.page, self.count = None, self.count + 1
        self.path.pop()

    def _field(self, value: str) -> None:
        if self.field == "database":
            if self.named:
                raise MemberFault("DuplicateField")
            if not PROJECT.fullmatch(value) or self.project not in (None, value):
                raise MemberFault("OtherProject")
            self.named = True
            return
        if self.field in self.page:
            raise MemberFault("DuplicateField")
        if self.revised and self.path[-2] == "page":
            raise MemberFault("InvalidState")
        if self.field in NUMBERS:
            least, most = NUMBERS[self.field]
            if not re.fullmatch("[0-9]{1,20}", value) or not least <= int(value) <= most:
                raise MemberFault("InvalidField")
            value = int(value)
        self.page[self.field] = value


def decoded(content: pa.Buffer, compressed: bool, most: int) -> Iterator[bytes]:
    """The member's bytes in pieces, at most ``most`` of them; bz2 streams may follow each other."""
    total, o, unpack = 0, 0, bz2.BZ2Decompressor()
    rest = b""
    while o < content.size or rest or (compressed and not unpack.needs_input and not unpack.eof):
        if not rest and o < content.size and (not compressed or unpack.needs_input or unpack.eof):
            rest, o = content.slice(o, min(PIECE, content.size - o)).to_pybytes(), o + PIECE
        if compressed:
            if unpack.eof:
                unpack = bz2.BZ2Decompressor()
            try:
                piece = unpack.decompress(rest, PIECE)
            except OSError:
                raise MemberFault("InvalidCompression") from None
            rest = unpack.unused_data if unpack.eof else b""
        else:
            piece, rest = rest, b""
        total += len(piece)
        if total > most:
            raise MemberFault("DecodedLimitExceeded")
        yield piece
    if compressed and not unpack.eof:
        raise MemberFault("TruncatedMember")


def _parse(project: str | None, most_decoded: int):
    schema = pa.schema(
        [
            ("path", pa.string()),
            ("page", pa.struct([("title", pa.string()), ("namespace", pa.int32()), ("page_id", pa.int64()), ("redirect_target", pa.string()), ("revision_id", pa.int64()), ("timestamp", pa.string())])),
            ("receipt", pa.struct([("sha256", pa.string()), ("compressed", pa.int64()), ("decoded", pa.int64()), ("pages", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("ids_sha256", pa.string())])),
            ("fault", pa.string()),
        ]
    )

    def rows(path: str, pages=(), receipt=None, fault=None) -> pa.RecordBatch:
        all_ = [{"path": path, "page": p} for p in pages]
        if receipt or fault:
            all_.append({"path": path, "receipt": receipt, "fault": fault})
        return pa.RecordBatch.from_pylist(all_, schema)

    def member(path: str, content: pa.Buffer) -> Iterator[pa.RecordBatch]:
        events, total, first, last, ids = PageEvents(project), 0, None, 0, hashlib.sha256()
        try:
            for piece in decoded(content, path.endswith(".bz2"), most_decoded):
                total += len(piece)
                pages = events.feed(piece)
                for p in pages:
                    if last is not None and p["page_id"] <= last:
                        raise MemberFault("UnsortedPages")
                    first, last = first or p["page_id"], p["page_id"]
                    ids.update(b"%d\n" % last)
                if pages:
                    yield rows(path, pages)
            events.feed(b"", True)
            receipt = {
                "sha256": hashlib.sha256(content).hexdigest(), "compressed": content.size, "decoded": total, "pages": events.count,
                "first": first, "last": last, "ids_sha256": ids.hexdigest(),
            }
            yield rows(path, receipt=receipt)
        except MemberFault as bad:
            yield rows(path, fault=bad.args[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                yield from member(path.as_py(), content.as_buffer())

    return run


def _relative(root: str) -> Column:
    """A file's path below ``root``, which is given without its scheme or with it."""
    tail = re.sub(r"^[a-z0-9]+:/*", "/", root.rstrip("/"))
    return F.element_at(F.split("path", re.escape(tail) + "/", 2), -1)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").load(root).withColumn("relative_path", _relative(root))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, sha256) of the files below ``root``: what a checksum file would say of them."""
    return _files(spark, root).select("relative_path", F.sha2("content", 256).alias("sha256"))


def read_members(
    spark: SparkSession, root: str, members: DataFrame, project: str | None = None, most_compressed: int = MOST_COMPRESSED, most_decoded: int = MOST_DECODED
) -> tuple[DataFrame, DataFrame]:
    """(pages, receipts) of the ``members`` (relative_path, sha256) below ``root``.

    Pages: relative_path, page_id, title, namespace, revision_id, timestamp, redirect_target. Receipts, one row a
    member: relative_path, sha256, compressed, decoded, pages, first, last and ids_sha256, the SHA-256 of its page ids as
    lines, in order.

    Names must declare disjoint ranges of page ids, and each member's pages must increase within its range. Files and
    inventory must name the same members, of the declared digests. ``project`` is held against the database name that
    a member may give. Spark lists no empty files, so an empty member is a missing one. All of this is checked before a page is returned; a fault raises a LorekeepError with its code.
    """
    ranged = check_export(members)
    both = _files(spark, root).select("relative_path", "length").join(ranged, "relative_path", "full_outer")
    assert_rules(
        both,
        {
            "UndeclaredFile": F.col("sha256").isNotNull(), "MissingFile": F.col("length").isNotNull(),
            "CompressedLimitExceeded": F.col("length") <= most_compressed,
        },
        "relative_path",
    )
    parsed = save(_files(spark, root).select("relative_path", "content").mapInArrow(_parse(project, most_decoded), PARSED), "dump-members")
    faults = parsed.where("fault is not null").groupBy("fault").agg(F.min("path").alias("path")).orderBy("path").head(1)
    if faults:
        assert_none(parsed.where(F.col("fault").isNotNull()).select("path"), faults[0]["fault"], "path")
    receipts = parsed.where("receipt is not null").select(F.col("path").alias("relative_path"), "receipt.*")
    held = receipts.join(ranged.withColumnRenamed("sha256", "declared"), "relative_path")
    assert_rules(
        held,
        {"DigestMismatch": F.col("sha256") == F.col("declared"), "PageOutOfRange": (F.col("first") >= F.col("start")) & (F.col("last") <= F.col("end"))},
        "relative_path",
    )
    pages = parsed.where("page is not null").select(F.col("path").alias("relative_path"), "page.*")
    assert_rules(
        pages,
        {
            "InvalidTitle": V.valid_label("title"),
            "InvalidRedirect": F.col("redirect_target").isNull() | V.valid_label("redirect_target"),
            "InvalidTimestamp": F.col("timestamp").rlike(UTC_TIMESTAMP) & F.try_to_timestamp("timestamp").isNotNull(),
        },
        "relative_path", "page_id",
    )
    return pages, receipts


def xml_text(text: Column | str) -> Column:
    """Text as XML: characters that XML doesn't know become U+FFFD, markup becomes entities."""
    v = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[^\t\n\r\x{20}-\x{d7ff}\x{e000}-\x{fffd}\x{10000}-\x{10ffff}]", "�")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(raw), F.lit(entity))
    return v


def write_members(pages: DataFrame, root: str, project: str, most_pages: int) -> None:
    """Pages (page_id, title, namespace, revision_id, timestamp, redirect_target, text) as bz2 members of ``most_pages`` ids each.

    A member is one file in a folder named by its range of ids; tasks sort the pages of their members and write them as they go.
    """
    spark = pages.sparkSession
    part = F.floor((F.col("page_id") - 1) / most_pages)
    name = F.concat(F.lit(f"{project}-p"), (part * most_pages + 1).cast("string"), F.lit("p"), ((part + 1) * most_pages).cast("string"), F.lit(".xml"))
    element = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    redirect = F.when(F.col("redirect_target").isNotNull(), F.concat(F.lit('<redirect title="'), xml_text("redirect_target"), F.lit('"/>'))).otherwise("")
    revision = F.concat(element("id", F.col("revision_id").cast("string")), element("timestamp", F.col("timestamp")), element("text", xml_text(F.coalesce("text", F.lit("")))))
    page = element("page", F.concat(element("title", xml_text("title")), element("ns", F.col("namespace").cast("string")), element("id", F.col("page_id").cast("string")), redirect, element("revision", revision)))
    body = pages.select(name.alias("member"), F.col("page_id").alias("place"), page.alias("value"))
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">\n<siteinfo><dbname>{project}</dbname></siteinfo>'
    ends = body.select("member").distinct().select(
        "member", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(head).alias("value")), F.struct(F.lit(MOST_ID).alias("place"), F.lit("</mediawiki>").alias("value")))).alias("e")
    ).select("member", "e.*")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = body.unionByName(ends).repartition(n, "member").sortWithinPartitions("member", "place").select("member", "value")
    whole.write.partitionBy("member").option("compression", "bzip2").text(root)
