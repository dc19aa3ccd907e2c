"""Structured article bodies: a tree of parts as sections, blocks, footnotes and references.

A body is JSON: ``parts`` (nested by ``has_parts``), ``tables`` and ``references``. One pass
over it in its task lists the parts with their places, without judging them; everything
else are rules over rows. Places are arrays of numbers, so that the order of arrays is
the order of the document, and what a section says of itself comes after its parts.

A body breaks at most one rule: the first, in the order of the document, references
before parts. Bodies that break one give no rows but that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import validity as V
from lorekeep.lineage import save

#: Sections within sections, and bytes of a reference's URL.
MOST_DEPTH = 64
MOST_URL_BYTES = 4096

#: Parts of bodies that leave a task together.
BATCH_ROWS = 2000

_NOTE = "struct<identifier:string,text:string>"
_CHILD = f"struct<kind:string,name:string,value:string,parts:int,images:int,tables:int,citations:array<{_NOTE}>>"
NODE = (
    f"body string, place array<int>, section array<int>, kind string, name string, value string, items array<string>, images int, parts int, "
    f"children array<{_CHILD}>, tables array<string>, citations array<{_NOTE}>, number int, title string, url string, grid array<array<string>>, odd boolean"
)

_note = pa.struct([("identifier", pa.string()), ("text", pa.string())])
_child = pa.struct(
    [("kind", pa.string()), ("name", pa.string()), ("value", pa.string()), ("parts", pa.int32()), ("images", pa.int32()), ("tables", pa.int32()), ("citations", pa.list_(_note))]
)
_SCHEMA = pa.schema(
    [
        ("body", pa.string()), ("place", pa.list_(pa.int32())), ("section", pa.list_(pa.int32())), ("kind", pa.string()), ("name", pa.string()),
        ("value", pa.string()), ("items", pa.list_(pa.string())), ("images", pa.int32()), ("parts", pa.int32()), ("children", pa.list_(_child)),
        ("tables", pa.list_(pa.string())), ("citations", pa.list_(_note)), ("number", pa.int32()), ("title", pa.string()), ("url", pa.string()),
        ("grid", pa.list_(pa.list_(pa.string()))), ("odd", pa.bool_()),
    ]
)


def _notes(part: dict) -> list[dict]:
    return [{"identifier": c["identifier"], "text": c["text"]} for c in part.get("citations") or []]


def _nodes(key: str, body: str) -> Iterator[dict]:
    """One row for each part outside infoboxes and lists, which hold theirs, for each table and each reference."""
    try:
        whole = json.loads(body)
        for i, r in enumerate(whole.get("references") or []):
            title, url = r.get("title"), r.get("url")
            odd = not isinstance(title, str | None) or not isinstance(url, str | None)
            yield {"body": key, "kind": "reference", "number": i, "name": r["identifier"], "title": None if odd else title, "url": None if odd else url, "odd": odd}
        for i, t in enumerate(whole.get("tables") or []):
            yield {"body": key, "kind": "known_table", "number": i, "name": t["identifier"], "grid": [*(t.get("headers") or []), *(t.get("rows") or [])]}
        open_ = [((i,), (), p) for i, p in reversed(list(enumerate(whole.get("parts") or [])))]
        sections: dict[tuple, int] = {}
        while open_:
            place, section, part = open_.pop()
            inner = part.get("has_parts") or []
            kind = part["type"]
            if kind == "section":
                sections[section] = sections.get(section, 0) + 1
                section = (*section, sections[section])
                if len(section) > MOST_DEPTH:
                    raise ValueError("depth")
                open_ += [((*place, i), section, p) for i, p in reversed(list(enumerate(inner)))]
            held = [] if kind == "section" else [
                {"kind": c["type"], "name": c.get("name"), "value": c.get("value"), "parts": len(c.get("has_parts") or []), "images": len(c.get("images") or []), "tables": len(c.get("table_references") or []), "citations": _notes(c)}
                for c in inner
            ]
            yield {
                "body": key, "place": place, "section": section, "kind": kind, "name": part.get("name"), "value": part.get("value"), "items": part.get("values") or [],
                "images": len(part.get("images") or []), "parts": len(inner), "children": held,
                "tables": [t["identifier"] for t in part.get("table_references") or []], "citations": _notes(part),
            }
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        yield {"body": key, "kind": "malformed"}


def _told(held: list[list[dict]]) -> Iterator[pa.RecordBatch]:
    """The rows of bodies as one batch, or, where one has a field of another type, a batch for each."""
    try:
        yield pa.RecordBatch.from_pylist([r for rows in held for r in rows], _SCHEMA)
    except (pa.ArrowInvalid, pa.ArrowTypeError):
        if len(held) > 1:
            for rows in held:
                yield from _told([rows])
        else:
            yield pa.RecordBatch.from_pylist([{"body": held[0][0]["body"], "kind": "malformed"}], _SCHEMA)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = list(_nodes(key, body or ""))
            if rows:
                held.append(rows)
                n += len(rows)
            if n >= BATCH_ROWS:
                yield from _told(held)
                held, n = [], 0
    if held:
        yield from _told(held)


def _blank(v: Column) -> Column:
    return F.coalesce(F.trim(v) == "", F.lit(True))


def _first(*rules: tuple[Column, str, Column]) -> Column:
    """The first rule that is broken, as (code, what), or null."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(code).alias("code"), what.cast("string").alias("what"))) for broken, code, what in rules))


def _part_fault() -> Column:
    """What is wrong with a part itself, apart from tables and citations."""
    c = F.col
    kind, none, valued = c("kind"), F.lit(None).cast("string"), c("value").isNotNull()
    items, parts, inside = F.size("items") > 0, c("parts") > 0, c("children")
    def child(own: str, needs_name: bool, missing: str) -> tuple:
        """The first child that is wrong, and how."""
        told = F.transform(
            inside,
            lambda x: F.when((x["kind"] != own) | (x["parts"] > 0) | (x["images"] > 0) | (x["tables"] > 0), F.struct(F.lit("Unsupported").alias("code"), x["kind"].alias("what")))
            .when(_blank(x["name"]) if needs_name else F.lit(False), F.struct(F.lit("Missing").alias("code"), F.lit("field.name").alias("what")))
            .when(_blank(x["value"]), F.struct(F.lit("Missing").alias("code"), F.lit(missing).alias("what"))),
        )
        return F.get(F.filter(told, lambda x: x.isNotNull()), F.lit(0))

    unsupported = lambda broken: (broken, "Unsupported", kind)
    return F.coalesce(
        _first(((c("images") > 0) | (kind == "image"), "UnresolvedVisual", none)),
        F.when(kind == "section", _first((_blank(c("name")), "Missing", F.lit("section.name")), unsupported(valued | items))),
        F.when(kind == "paragraph", _first(unsupported(items | parts), (_blank(c("value")), "Missing", F.lit("part.value")))),
        F.when(
            kind == "infobox",
            F.coalesce(_first(unsupported(valued | items)), child("field", True, "field.value"), _first((~parts, "Missing", F.lit("infobox.fields")))),
        ),
        F.when(
            kind == "list",
            F.coalesce(_first(unsupported(valued | (F.size("tables") > 0))), child("list_item", False, "list_item.value"), _first((~parts & ~items, "Missing", F.lit("list.items")))),
        ),
        F.when(kind == "table", _first(unsupported(valued | items | parts | (F.size("tables") == 0)))),
        _first(unsupported(~kind.isin("section", "paragraph", "infobox", "list", "table"))),
    )


@dataclass
class Articles:
    """What bodies become; each table has ``body``, the body's key."""

    #: section (numbers from 1, outermost first), heading
    sections: DataFrame
    #: section (empty: the lead), ordinal from 0, kind, text, items, fields, rows, note
    blocks: DataFrame
    #: number from 0, id, label, source_url
    references: DataFrame
    #: code, what: the rule that a body breaks
    faults: DataFrame


def articles(bodies: DataFrame) -> Articles:
    """Sections, blocks and references of ``bodies`` (body, value), ``value`` being JSON and ``body`` a key of its own.

    * A paragraph, an infobox, a list or a table becomes a block; its tables follow it, then a footnote for each
      citation that the body has not had before, a list's or infobox's own before those of its items. A section's tables
      and citations follow its blocks.
    * A footnote is the citation's text with the label of its reference, which has to exist; a citation that comes again
      must say the same. A reference's label is its title, or its id where that is blank or absent.
    * A null or malformed body, and sections deeper than 64, are the fault ``InvalidBody``.
    """
    nodes = save(bodies.select("body", "value").mapInArrow(_listed, NODE), "part-nodes")
    known = nodes.where("kind = 'known_table'").groupBy("body", "name").agg(F.max_by("grid", "number").alias("grid"))
    cited = nodes.where("kind = 'reference'").select(
        "body", "number", F.col("name").alias("id"), F.when(_blank(F.col("title")), F.col("name")).otherwise(F.col("title")).alias("label"),
        F.col("url").alias("source_url"), "odd",
    )
    labels = cited.groupBy("body", "id").agg(F.max_by("label", "number").alias("label"))
    parts = nodes.where("place is not null")
    is_section = F.col("kind") == "section"
    own = parts.select("*", F.when(is_section, F.concat("place", F.array(F.lit(2**31 - 1)))).otherwise(F.col("place")).alias("at"))

    block = own.where(~is_section & (F.col("kind") != "table")).select(
        "body", "section", "at", F.lit(0).alias("stage"), F.lit(0).alias("outer"), F.lit(0).alias("inner"), "kind", F.col("value").alias("text"),
        F.when(F.col("kind") == "list", F.concat("items", F.transform("children", lambda c: c["value"]))).alias("items"),
        F.when(F.col("kind") == "infobox", F.transform("children", lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value")))).alias("fields"),
    )
    asked = own.where(F.col("kind") != "list").select("body", "section", "at", F.posexplode("tables").alias("inner", "name"))
    table = asked.join(known, ["body", "name"], "left").select(
        "body", "section", "at", F.lit(1).alias("stage"), F.lit(0).alias("outer"), "inner", F.lit("table").alias("kind"), "name", F.col("grid").alias("rows"),
        (F.col("grid").isNull() | (F.size("grid") == 0) | F.exists("grid", lambda r: F.size(r) == 0)).alias("bad"),
    )
    notes = F.concat(F.array("citations"), F.when(F.col("kind").isin("infobox", "list"), F.transform("children", lambda c: c["citations"])).otherwise(F.array()))
    said = own.select("body", "section", "at", F.posexplode(notes).alias("outer", "own")).select("body", "section", "at", "outer", F.posexplode("own").alias("inner", "c"))
    order = ["at", "stage", "outer", "inner"]
    again = Window.partitionBy("body", "identifier").orderBy(*order)
    cite = (
        said.select("body", "section", "at", F.lit(2).alias("stage"), "outer", "inner", F.col("c.identifier").alias("identifier"), F.col("c.text").alias("said"))
        .join(labels.withColumnRenamed("id", "identifier"), ["body", "identifier"], "left")
        .withColumn("turn", F.row_number().over(again))
        .withColumn("before", F.first("said").over(again))
        .withColumn("bad", F.col("label").isNull() | ~F.col("said").eqNullSafe(F.col("before")))
    )

    fault = lambda df, what, code: df.select("body", F.struct(F.lit(1).alias("phase"), *order).alias("when"), F.struct(F.lit(code).alias("code"), what.cast("string").alias("what")).alias("f"))
    zero = F.lit(0)
    at_part = F.struct(F.lit(1).alias("phase"), F.col("place").alias("at"), F.lit(-1).alias("stage"), zero.alias("outer"), zero.alias("inner"))
    at_reference = F.struct(zero.alias("phase"), F.array(F.coalesce("number", zero)).alias("at"), zero.alias("stage"), zero.alias("outer"), zero.alias("inner"))
    unsafe = F.col("source_url").isNotNull() & ~(
        (F.octet_length("source_url") <= MOST_URL_BYTES) & V.valid_external_url("source_url") & ~F.col("source_url").rlike(r"[\s\p{Cntrl}\\]")
    )
    pair = lambda code, what: F.struct(F.lit(code).alias("code"), what.cast("string").alias("what")).alias("f")
    faults = (
        nodes.where("kind = 'malformed'").select("body", at_reference.alias("when"), pair("InvalidBody", F.lit(None)))
        .unionByName(cited.where(F.col("odd") | unsafe).select("body", at_reference.alias("when"), pair("InvalidReference", F.col("id"))))
        .unionByName(parts.select("body", at_part.alias("when"), _part_fault().alias("f")).where("f is not null"))
        .unionByName(fault(table.where("bad"), F.col("name"), "InvalidTable"))
        .unionByName(fault(cite.where("bad"), F.col("identifier"), "InvalidReference"))
        .groupBy("body").agg(F.min_by("f", "when").alias("f"))
    )
    faults = save(faults.select("body", "f.code", "f.what"), "part-faults")
    good = lambda df: df.join(faults.select("body"), "body", "left_anti")

    none = lambda kind: F.lit(None).cast(kind)
    note_type = "struct<source_id:string,label:string,text:string,reference_ids:array<string>>"
    place = ["body", "section", *order, "kind"]
    note = F.struct(F.col("identifier").alias("source_id"), F.col("said").alias("label"), F.col("label").alias("text"), F.array("identifier").alias("reference_ids"))
    every = (
        block.select(*place, "text", "items", "fields", none("array<array<string>>").alias("rows"), none(note_type).alias("note"))
        .unionByName(table.select(*place, none("string").alias("text"), none("array<string>").alias("items"), none("array<struct<name:string,value:string>>").alias("fields"), "rows", none(note_type).alias("note")))
        .unionByName(
            cite.where("turn = 1").withColumn("kind", F.lit("footnote")).select(
                *place, none("string").alias("text"), none("array<string>").alias("items"), none("array<struct<name:string,value:string>>").alias("fields"),
                none("array<array<string>>").alias("rows"), note.alias("note"),
            )
        )
    )
    within = Window.partitionBy("body", "section").orderBy(*order)
    blocks = good(every).withColumn("ordinal", (F.row_number().over(within) - 1).cast("long")).select("body", "section", "ordinal", "kind", "text", "items", "fields", "rows", "note")
    sections = good(parts.where(is_section)).select("body", "section", F.col("name").alias("heading"))
    return Articles(sections, blocks, good(cited).select("body", "number", "id", "label", "source_url"), faults)
