"""Canonical bytes against Python's own JSON, and digests of corpora that don't depend on partitions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError
from lorekeep.operators import canonical, part_trees

ODD = 'q"\\/\b\t\n\f\r\x00\x0b\x1f\x7f é 重 𝄞 </script>'


def test_strings(spark):
    rows = [ODD, "", "plain", None]
    got = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v string").orderBy("k").select(canonical.json_string("v").alias("j")).collect()
    assert [r.j for r in got] == [*(json.dumps(v, ensure_ascii=False) for v in rows[:3]), None]


def test_articles(spark):
    body = {
        "parts": [
            {"type": "paragraph", "value": ODD, "citations": [{"identifier": "r", "text": "1"}]},
            {"type": "section", "name": "A", "has_parts": [{"type": "list", "values": ["x", "y"]}, {"type": "section", "name": "B"}, {"type": "section", "name": "C", "has_parts": [{"type": "table", "table_references": [{"identifier": "t"}]}]}]},
            {"type": "section", "name": "D", "has_parts": [{"type": "infobox", "has_parts": [{"type": "field", "name": "k", "value": "v"}]}]},
        ],
        "tables": [{"identifier": "t", "headers": [["h"]], "rows": [["1"]]}], "references": [{"identifier": "r", "title": "R"}],
    }
    block = lambda o, **c: {"ordinal": o, "content": c}
    section = lambda o, h, blocks=(), sub=(): {"ordinal": o, "heading": h, "blocks": list(blocks), "subsections": list(sub)}
    medium = {"source_url": "u", "mime_type": "image/png", "sha256": None, "license": "l", "creator": "c", "attribution": "a", "is_av_preview": True, "derivation": "lossless_webp"}
    want = {
        "schema_version": 1, "key": {"project": "enwiki", "page_id": 3}, "revision": {"revision_id": 4, "timestamp": "2026-01-01T00:00:00Z", "content_sha256": "0" * 64},
        "title": "T", "display_title": "<b>T</b>", "language": "en", "namespace": 0, "aliases": ["U"], "wikidata_id": None,
        "lead": [block(0, Paragraph=ODD), block(1, Footnote={"source_id": "r", "label": "1", "text": "R", "reference_ids": ["r"]})],
        "sections": [section(1, "A", [block(0, List=["x", "y"])], [section(1, "B"), section(2, "C", [block(0, Table=[["h"], ["1"]])])]), section(2, "D", [block(0, Infobox=[["k", "v"]])])],
        "references": [{"id": "r", "label": "R", "source_url": None}], "links": [{"label": "l", "target": {"project": "dewiki", "page_id": 9}, "fragment": None}],
        "media": [medium], "rendered_html": "<p>", "is_disambiguation": False,
    }
    head = ("a", "enwiki", 3, 4, "2026-01-01T00:00:00Z", "T", "<b>T</b>", "en", 0, ["U"], None, [("l", "dewiki", 9, None)], [tuple(medium.values())], "<p>", False)
    schema = "body string, project string, page_id long, revision_id long, timestamp string, title string, display_title string, language string, namespace int, aliases array<string>, wikidata_id string, links array<struct<label:string,project:string,page_id:long,fragment:string>>, media array<struct<source_url:string,mime_type:string,sha256:string,license:string,creator:string,attribution:string,is_av_preview:boolean,derivation:string>>, rendered_html string, is_disambiguation boolean"
    heads = spark.createDataFrame([head, ("bad", *head[1:])], schema)
    bodies = spark.createDataFrame([("a", json.dumps(body)), ("bad", "{")], "body string, value string")
    got = canonical.with_digest(canonical.canonical_articles(heads, part_trees.articles(bodies))).collect()
    assert [r.record for r in got] == [json.dumps(want, ensure_ascii=False, separators=(",", ":"))]
    assert got[0].content_sha256 == hashlib.sha256(got[0].record.encode()).hexdigest()


def corpus(spark, rows):
    return spark.createDataFrame(rows, "project string, page_id long, revision_id long, content_sha256 string")


def test_corpus_digest_depends_on_articles_alone(spark):
    rows = [(p, i * 1500, r, hashlib.sha256(f"{p}{i}{r}".encode()).hexdigest()) for p in ("a", "b") for i in range(40) for r in (1, 2)]
    digest = lambda df: tuple(canonical.corpus_digest(df).head())
    whole = corpus(spark, rows)
    assert digest(whole) == digest(whole.repartition(7, "content_sha256").orderBy(F.desc("content_sha256")))
    assert digest(whole)[0] == 160 and len({digest(corpus(spark, rows[:-1]))[1], digest(whole)[1], digest(corpus(spark, [*rows[:-1], (*rows[-1][:3], "0" * 64)]))[1]}) == 3
    assert digest(whole.limit(0))[0] == 0
    for bad, code in (([rows[0], rows[0]], "DuplicateArticle"), ([("a", 4096**3, 1, "0")], "PageIdOutOfRange")):
        with pytest.raises(LorekeepError) as error:
            canonical.corpus_digest(corpus(spark, bad))
        assert error.value.code == code
