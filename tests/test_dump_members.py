"""Dump members: what a good one gives, in pieces of any size, and the code of each rule that a bad one breaks."""

import bz2
import hashlib

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError
from lorekeep.operators import records
from lorekeep.sources import dump_members as M

NS = "http://www.mediawiki.org/xml/export-0.11/"


def page(i, title="T", ns="0", rev="7", time="2026-10-01T12:00:00Z", extra="", inside="", end=""):
    return (
        f"<page><title>{title}</title><ns>{ns}</ns><id>{i}</id>{extra}<revision><id>{rev}</id><timestamp>{time}</timestamp>"
        f"<contributor><id>9999</id></contributor>{inside}<text xml:space=\"preserve\"><![CDATA[{{{{x}}}} <b>]]></text></revision>{end}</page>"
    )


def document(*pages, site="<siteinfo><sitename>W</sitename><dbname>enwiki</dbname></siteinfo>", head='<?xml version="1.0"?>', root=f'<mediawiki xmlns="{NS}">'):
    return f"{head}{root}{site}{''.join(pages)}</mediawiki>"


GOOD = document(page(42, "Physics &amp; 日本語", extra='<redirect title="Science &amp; &quot;Math&quot;"/>'), page(43), "<!-- end -->")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8192])
def test_pieces_of_any_size(size):
    events, raw, found = M.PageEvents("enwiki"), GOOD.encode(), []
    for o in range(0, len(raw), size):
        found += events.feed(raw[o : o + size])
    events.feed(b"", True)
    assert [p["page_id"] for p in found] == [42, 43]
    assert found[0] == {"page_id": 42, "title": "Physics & 日本語", "namespace": 0, "revision_id": 7, "timestamp": "2026-10-01T12:00:00Z", "redirect_target": 'Science & "Math"'}


BAD = {
    "doctype": (document(page(1), head='<?xml version="1.0"?><!DOCTYPE mediawiki>'), "DoctypeRefused"),
    "external entity": (document(page(1), head='<!DOCTYPE m [<!ENTITY x SYSTEM "file:///etc/passwd">]>'), "DoctypeRefused"),
    "encoding": (document(page(1), head='<?xml version="1.0" encoding="latin-1"?>'), "InvalidDeclaration"),
    "version": (document(page(1), head='<?xml version="1.1"?>'), "InvalidDeclaration"),
    "foreign namespace": (document(page(1), root='<mediawiki xmlns="http://example.org/">'), "ForeignNamespace"),
    "rebinding": (document(page(1, inside='<x xmlns="http://example.org/"/>')), "ForeignNamespace"),
    "unbound prefix": (document(page(1, inside="<x:y/>")), "InvalidXmlDocument"),
    "other root": ("<wiki/>", "MisplacedElement"),
    "two roots": (document(page(1)) + document(page(2)), "InvalidXmlDocument"),
    "open root": (document(page(1)).removesuffix("</mediawiki>"), "InvalidXmlDocument"),
    "crossed tags": (document(page(1, inside="<a><b></a></b>")), "InvalidXmlDocument"),
    "unquoted attribute": (document(page(1, inside="<a b=c/>")), "InvalidXml"),
    "repeated attribute": (document(page(1, inside='<a b="" b=""/>')), "InvalidXmlDocument"),
    "unknown entity": (document(page(1, "&nbsp;")), "InvalidXmlDocument"),
    "control character": (document(page(1, "a\x01")), "InvalidXmlText"),
    "end of CDATA": (document(page(1, inside="]]>")), "InvalidXml"),
    "non-ASCII name": (document(page(1, inside="<é/>")), "InvalidName"),
    "depth": (document(page(1, inside="<a>" * 62 + "</a>" * 62)), "TooDeep"),
    "tag": (document(page(1, inside=f'<a b="{"x" * 70000}"/>')), "TagTooLong"),
    "field": (document(page(1, "x" * 17000)), "FieldTooLong"),
    "comment in field": (document(page(1, "a<!-- x -->b")), "MarkupInField"),
    "CDATA in field": (document(page(1, "<![CDATA[a]]>")), "MarkupInField"),
    "element in field": (document(page(1, "<i>a</i>")), "MarkupInField"),
    "text between pages": (document(page(1), "x"), "MisplacedText"),
    "page in page": (document(page(1, end="<page></page>")), "MisplacedElement"),
    "site after pages": (document(page(1), "<siteinfo></siteinfo>"), "MisplacedElement"),
    "two sites": (document(page(1), site="<siteinfo></siteinfo><siteinfo></siteinfo>"), "MisplacedElement"),
    "unknown top element": (document(page(1), "<other/>"), "MisplacedElement"),
    "no pages": (document(), "NoPages"),
    "no revision": (document("<page><title>T</title><ns>0</ns><id>1</id></page>"), "NotOneRevision"),
    "two revisions": (document(page(1, end="<revision></revision>")), "NotOneRevision"),
    "no title": (document(page(1).replace("<title>T</title>", "")), "MissingField"),
    "no time": (document(page(1).replace("<timestamp>2026-10-01T12:00:00Z</timestamp>", "")), "MissingField"),
    "two ids": (document(page(1, extra="<id>2</id>")), "DuplicateField"),
    "two redirects": (document(page(1, extra='<redirect title="a"/><redirect title="b"/>')), "DuplicateField"),
    "redirect of another attribute": (document(page(1, extra='<redirect title="a" x="y"/>')), "InvalidField"),
    "title after revision": (document(page(1, end="<title>U</title>").replace("<title>T</title>", "", 0)), "DuplicateField"),
    "id zero": (document(page(0)), "InvalidField"),
    "id too large": (document(page(2**63)), "InvalidField"),
    "negative namespace": (document(page(1, ns="-1")), "InvalidField"),
    "space in number": (document(page(" 1")), "InvalidField"),
    "other project": (document(page(1), site="<siteinfo><dbname>dewiki</dbname></siteinfo>"), "OtherProject"),
    "two projects": (document(page(1), site="<siteinfo><dbname>enwiki</dbname><dbname>enwiki</dbname></siteinfo>"), "DuplicateField"),
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_rules(name):
    text, code = BAD[name]
    for size in (5, 1 << 20):
        events, raw = M.PageEvents("enwiki"), text.encode()
        with pytest.raises(M.MemberFault) as bad:
            for o in range(0, len(raw), size):
                events.feed(raw[o : o + size])
            events.feed(b"", True)
        assert bad.value.args[0].startswith(code)
        with pytest.raises(M.MemberFault, match="Poisoned"):
            events.feed(b" ")


def export(tmp_path, files):
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def declared(spark, files, **other):
    return spark.createDataFrame([(n, other.get(n, hashlib.sha256(r).hexdigest())) for n, r in files.items()], "relative_path string, sha256 string")


def read(spark, tmp_path, files, **settings):
    return M.read_members(spark, export(tmp_path, files), declared(spark, files), "enwiki", **settings)


def test_members_plain_and_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 50)
    first, second = document(page(1, "A"), page(5, "B", ns="14")), document(page(6), page(90))
    halves = [bz2.compress(second[:300].encode()), bz2.compress(second[300:].encode())]
    pages, receipts = read(spark, tmp_path, {"d/x-p1p5.xml": first.encode(), "x-p6p90.xml.bz2": b"".join(halves)})
    assert [(r.relative_path, r.page_id, r.title, r.namespace) for r in pages.orderBy("page_id").collect()] == [
        ("d/x-p1p5.xml", 1, "A", 0), ("d/x-p1p5.xml", 5, "B", 14), ("x-p6p90.xml.bz2", 6, "T", 0), ("x-p6p90.xml.bz2", 90, "T", 0),
    ]
    r = {r.relative_path: r for r in receipts.collect()}["x-p6p90.xml.bz2"]
    assert (r.pages, r.first, r.last, r.decoded) == (2, 6, 90, len(second.encode()))
    assert r.ids_sha256 == hashlib.sha256(b"6\n90\n").hexdigest()


GOOD_FILE = bz2.compress(document(page(1), page(2)).encode())
FILES = {
    "TruncatedMember": {"x-p1p9.xml.bz2": GOOD_FILE[:-5]},
    "InvalidCompression": {"x-p1p9.xml.bz2": GOOD_FILE + b"garbage"},
    "MissingFile": {"x-p1p9.xml.bz2": b""},
    "UnsortedPages": {"x-p1p9.xml": document(page(2), page(2)).encode()},
    "PageOutOfRange": {"x-p2p9.xml.bz2": GOOD_FILE},
    "InvalidRange": {"x.xml.bz2": GOOD_FILE},
    "OverlappingRanges": {"x-p1p9.xml.bz2": GOOD_FILE, "y-p9p12.xml.bz2": GOOD_FILE},
    "InvalidTitle": {"x-p1p9.xml": document(page(1, " T")).encode()},
    "InvalidRedirect": {"x-p1p9.xml": document(page(1, extra='<redirect title="a&#x202e;"/>')).encode()},
    "InvalidTimestamp": {"x-p1p9.xml": document(page(1, time="2026-02-30T00:00:00Z")).encode()},
    "InvalidXmlText": {"x-p1p9.xml": document(page(1)).encode().replace(b"W<", b"\xff<")},
}


@pytest.mark.parametrize("code", sorted(FILES))
def test_bad_members(spark, tmp_path, code):
    with pytest.raises(LorekeepError) as bad:
        read(spark, tmp_path, FILES[code])
    assert bad.value.code == code


def test_inventory_and_budgets(spark, tmp_path):
    files = {"x-p1p9.xml.bz2": GOOD_FILE, "y-p10p20.xml.bz2": bz2.compress(document(page(12)).encode())}
    root = export(tmp_path, files)

    def code(members, **settings):
        with pytest.raises(LorekeepError) as bad:
            M.read_members(spark, root, members, **settings)
        return bad.value.code

    whole = declared(spark, files)
    assert code(whole.where("relative_path like 'x%'")) == "UndeclaredFile"
    assert code(whole.unionByName(spark.createDataFrame([("z-p30p40.xml", "0" * 64)], whole.schema))) == "MissingFile"
    assert code(whole.withColumn("sha256", F.reverse("sha256"))) == "DigestMismatch"
    assert code(whole, most_compressed=10) == "CompressedLimitExceeded"
    assert code(whole, most_decoded=100) == "DecodedLimitExceeded"
    assert code(whole, project="dewiki") == "OtherProject"
    assert M.read_members(spark, root, M.inventory(spark, root))[0].count() == 3


def test_written_members_come_back(spark, tmp_path):
    rows = [(1, "a & <b>", 0, 5, "2026-01-01T00:00:00Z", None, "x\x00\x0by ]]> &"), (3, 'q"q', 14, 6, "2026-01-01T00:00:00Z", 'to "it" & \'so\'', None), (11, "é", 0, 7, "2026-01-01T00:00:00Z", None, "")]
    pages = spark.createDataFrame(rows, "page_id long, title string, namespace int, revision_id long, timestamp string, redirect_target string, text string")
    M.write_members(pages, str(tmp_path / "e"), "enwiki", 4)
    back, receipts = M.read_members(spark, str(tmp_path / "e"), M.inventory(spark, str(tmp_path / "e")), "enwiki")
    cols = ["page_id", "title", "namespace", "revision_id", "timestamp", "redirect_target"]
    assert sorted(map(tuple, back.select(cols).collect())) == [r[:6] for r in rows]
    assert sorted(r.pages for r in receipts.collect()) == [1, 2]


def test_receipts_see_the_ids(spark):
    rows = [("a", 1, 1), ("a", 2, 4), ("b", 1, 2), ("b", 2, 3), ("c", 2, 1), ("c", 1, 4), ("c", 3, None)]
    got = {r.member: r for r in records.member_receipts(spark.createDataFrame(rows, "member string, seq long, id long")).collect()}
    assert got["a"].digest == hashlib.sha256(b"1\n4\n").hexdigest() != got["b"].digest
    assert (got["c"].first, got["c"].last, got["c"].increasing, got["c"].digest) == (1, 4, False, hashlib.sha256(b"4\n1\n").hexdigest())
