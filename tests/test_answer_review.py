"""Reviewed answers: counts of good suites, and the first rule that a bad one breaks."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import answer_review as R


def claim(i, text, verdict="supported", cites=(), **other):
    return {"id": i, "text": text, "verdict": verdict, "citations": [{"block_id": b, "verdict": v} for b, v in cites], **other}


def suite(version=1, answer="Two moons [[cite:lead_0]]. An aside [[cite:sec_1]].", claims=None, **other):
    claims = claims or [claim("c1", "Two moons", cites=[("lead_0", "supported")]), claim("c2", "An aside", "unsupported", [("sec_1", "unsupported")])]
    claims = copy.deepcopy(claims)
    if version >= 2:
        for c in claims:
            if "start_byte" not in c:
                at = answer.encode().find(c["text"].encode())
                c |= {"start_byte": at, "end_byte": at + len(c["text"].encode())}
    case = {"id": "one", "project": "enwiki", "page_id": 42, "revision_id": 100, "question": "How many moons?", "answer": answer, "claims": claims}
    return {"schema_version": version, "suite_id": "s", "cases": [case | other]}


def two(**change):
    made = suite()
    return made | {"cases": [made["cases"][0], made["cases"][0] | {"id": "two"} | change]}


def run(spark, suites):
    rows = [(k, s if isinstance(s, str) or s is None else json.dumps(s, ensure_ascii=False)) for k, s in enumerate(suites)]
    return R.review(spark.createDataFrame(rows, "suite int, body string"))


@pytest.fixture(scope="module")
def outcomes(spark):
    _, faults = run(spark, [s for _, s, _ in CASES])
    return {r.suite: r.code for r in faults.collect()}


L, E = [("lead_0", "supported")], "é moons [[cite:a]] x"
CASES = [
    ("version 1", suite(), None), ("version 2", suite(2), None), ("version 3", suite(3), None),
    ("canonical ids", suite(answer="Two moons [[cite:wkb:enwiki:42:100:b0]] [[cite:wkb:enwiki:42:100:3:1:b12]]", claims=[claim("c", "Two moons", cites=[("wkb:enwiki:42:100:b0", "supported"), ("wkb:enwiki:42:100:3:1:b12", "unreviewed")])]), None),
    ("bytes, not characters", suite(2, E, [claim("c", "é moons", cites=[("a", "supported")])]), None),
    ("repeated text at other spans", suite(2, "a b a [[cite:x]]", [claim("c", "a", "unreviewed", start_byte=0, end_byte=1), claim("d", "a", "unreviewed", [("x", "unreviewed")], start_byte=4, end_byte=5)]), None),
    ("punctuation outside claims", suite(3, "(Two moons [[cite:lead_0]])!", [claim("c", "Two moons", cites=L)]), None),
    ("another question", two(question="Which?"), None),
    ("no JSON", "{", "InvalidJson"), ("null", None, "InvalidJson"), ("no cases", suite() | {"cases": []}, "InvalidCase"), ("version 4", suite() | {"schema_version": 4}, "UnsupportedSchema"),
    ("suite id", suite() | {"suite_id": "-s"}, "InvalidSuiteId"), ("verdict", suite(claims=[claim("c", "Two moons", "true")]), "InvalidJson"), ("size", suite(question="x" * 2_200_000), "TooLarge"),
    ("case id", suite(id=""), "InvalidCase"), ("project", suite(project="En"), "InvalidCase"), ("page", suite(page_id=0), "InvalidCase"), ("revision", suite(revision_id=0), "InvalidCase"),
    ("question", suite(question=" "), "InvalidCase"), ("answer", suite(answer=""), "InvalidCase"), ("long answer", suite(answer="x" * 65537), "InvalidCase"), ("NUL", suite(answer="Two moons\0"), "InvalidCase"),
    ("no claims", suite() | {"cases": [suite()["cases"][0] | {"claims": []}]}, "InvalidCase"), ("claims over the limit", suite(claims=[claim(f"c{k}", "Two moons") for k in range(129)]), "InvalidCase"),
    ("same id", two(id="one", question="Which?"), "DuplicateCase"), ("same question and answer", two(), "DuplicateCase"), ("white space only", two(question="How  many\nmoons?"), "DuplicateCase"),
    ("other citation ids only", two(answer=suite()["cases"][0]["answer"].replace("lead_0", "lead_9")), "DuplicateCase"),
    ("open marker", suite(answer="Two moons [[cite:lead_0"), "InvalidCitation"), ("marker of a bad id", suite(answer="Two moons [[cite:a b]]"), "InvalidCitation"),
    ("claim not there", suite(claims=[claim("c", "Three moons")]), "InvalidClaim"), ("part of a word", suite(claims=[claim("c", "Two moon")]), "InvalidClaim"), ("in a marker", suite(claims=[claim("c", "lead_0")]), "InvalidClaim"),
    ("no word", suite(answer="Two moons ! [[cite:lead_0]]", claims=[claim("c", "!", cites=L)]), "InvalidClaim"), ("offsets in version 1", suite(claims=[claim("c", "Two moons", cites=L, start_byte=0, end_byte=9)]), "InvalidClaim"),
    ("no offsets in version 2", suite(2) | {"cases": suite()["cases"]}, "InvalidClaim"), ("within a character", suite(2, E, [claim("c", "é moons", cites=[("a", "supported")], start_byte=1, end_byte=8)]), "InvalidClaim"),
    ("span of other text", suite(2, claims=[claim("c", "Two moons", cites=L, start_byte=1, end_byte=10)]), "InvalidClaim"), ("span that cuts a word", suite(2, claims=[claim("c", "wo moons", cites=L, start_byte=1, end_byte=9)]), "InvalidClaim"),
    ("span over a marker", suite(2, "a [[cite:x]]", [claim("c", "a [[cite:x]]", start_byte=0, end_byte=12)]), "InvalidClaim"),
    ("spans that overlap", suite(2, "a b c [[cite:x]]", [claim("c", "a b", "unreviewed"), claim("d", "b c", "unreviewed", [("x", "unreviewed")])]), "InvalidClaim"),
    ("prose before", suite(3, "Indeed two moons [[cite:lead_0]]", [claim("c", "two moons", cites=L)]), "UnreviewedProse"), ("prose after", suite(3, "Two moons [[cite:lead_0]] and more", [claim("c", "Two moons", cites=L)]), "UnreviewedProse"),
    ("one letter", suite(3, "Two moons, é [[cite:lead_0]]", [claim("c", "Two moons", cites=L)]), "UnreviewedProse"), ("prose in version 2", suite(2, "Indeed two moons [[cite:lead_0]]", [claim("c", "two moons", cites=L)]), None),
    ("same claim id", suite(claims=[claim("c", "Two moons", cites=L), claim("c", "An aside")]), "DuplicateClaim"), ("same claim text", suite(claims=[claim("c", "Two moons", cites=L), claim("d", "Two moons", cites=L)]), "DuplicateClaim"),
    ("bad citation id", suite(claims=[claim("c", "Two moons", cites=[("a b", "supported")])]), "InvalidCitation"), ("other page's block", suite(claims=[claim("c", "Two moons", cites=[("wkb:enwiki:43:100:b0", "supported")])]), "InvalidCitation"),
    ("ordinal with a zero before", suite(claims=[claim("c", "Two moons", cites=[("wkb:enwiki:42:100:b00", "supported")])]), "InvalidCitation"), ("ordinal beyond 32 bits", suite(claims=[claim("c", "Two moons", cites=[("wkb:enwiki:42:100:b4294967296", "supported")])]), "InvalidCitation"),
    ("same citation", suite(claims=[claim("c", "Two moons", cites=L * 2)]), "DuplicateCitation"), ("no marker", suite(claims=[claim("c", "Two moons", cites=[("lead_7", "supported")])]), "MissingCitationMarker"),
    ("marker after the next claim", suite(2, "Two moons. An aside [[cite:lead_0]]", [claim("c", "Two moons", cites=L), claim("d", "An aside", "unreviewed")]), "MisplacedCitationMarker"),
    ("marker before its claim", suite(2, "[[cite:lead_0]] Two moons", [claim("c", "Two moons", cites=L)]), "MisplacedCitationMarker"),
    ("nothing supports it", suite(claims=[claim("c", "Two moons", cites=[("lead_0", "unreviewed")])]), "InconsistentSupport"), ("unsupported, yet supported", suite(claims=[claim("c", "Two moons", "unsupported", L)]), "InconsistentSupport"),
    ("marker without label", suite(claims=[claim("c", "Two moons", cites=L)]), "UnlabeledCitationMarker"),
    ("second marker without claim", suite(2, "Two moons [[cite:lead_0]] x y [[cite:lead_0]]", [claim("c", "Two moons", cites=L), claim("d", "x", "unreviewed"), claim("e", "y", "unreviewed")]), "UnlabeledCitationMarker"),
]


@pytest.mark.parametrize("k", range(len(CASES)), ids=[c[0] for c in CASES])
def test_rules(outcomes, k):
    assert outcomes.get(k) == CASES[k][2]


def test_counts(spark):
    given = [claim("c1", "Two moons", cites=[("a", "supported"), ("b", "unreviewed")]), claim("c2", "An aside", "unreviewed"), claim("c3", "no", "unsupported", [("c", "unsupported")])]
    scores, faults = run(spark, [suite(answer="Two moons [[cite:a]][[cite:b]]. An aside, no [[cite:c]].", claims=given), suite(3)])
    assert faults.count() == 0
    first, second = R.report(scores).orderBy("suite").collect()
    assert [first[n] for n in R.COUNTS] == [3, 2, 1, 1, 1, 1, 3, 2, 1, 1, 1] and not first.all_claims_reviewed and not first.all_citations_reviewed
    assert [second[n] for n in R.COUNTS] == [2, 2, 1, 1, 0, 0, 2, 2, 1, 1, 0] and second.all_claims_reviewed and second.all_citations_reviewed and second.annotation_version == 3


def test_uncovered_text(spark):
    spans = F.expr("array(named_struct('start', 2L, 'end', 4L), named_struct('start', 4L, 'end', 5L))")
    assert spark.range(1).select(R.uncovered(spans, F.encode(F.lit("é-bcdé"), "UTF-8")).alias("u")).head().u == ["é", "", "dé"]


def test_strict_corpus(spark):
    ids = lambda b: suite(answer=f"Two moons [[cite:{b}]]", claims=[claim("c", "Two moons", cites=[(b, "supported")])])
    scores, _ = run(spark, [ids("wkb:enwiki:42:100:b0"), ids("wkb:enwiki:42:100:b9"), ids("lead_0"), suite(revision_id=101), suite(page_id=7)])
    articles = spark.createDataFrame([("enwiki", 42, 100)], "project string, page_id long, revision_id long")
    blocks = articles.withColumn("block_id", F.lit("wkb:enwiki:42:100:b0"))
    assert {r.suite: r.code for r in R.strict_faults(scores, articles, blocks).collect()} == {1: "UnknownEvidence", 2: "UnknownEvidence", 3: "UnknownOrStaleArticle", 4: "UnknownOrStaleArticle"}
