"""Reviewed answers: claims and citations that people have judged, checked and counted.

A suite is JSON with cases; a case has an answer with citation markers, and claims with
verdicts. Version 1 names claims by their text, version 2 by byte spans of the answer,
and version 3 wants every visible word inside a claim. A case is small by contract, so
its rules are conditions over its own arrays; only what one case says of another, and
what the corpus says of citations, takes a shuffle. A suite breaks at most one rule:
the first of its first bad case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions import validity as V
from lorekeep.lineage import save

# Limits, verdicts, ids and markers.
MOST_SUITE_BYTES = 2 * 1024 * 1024
MOST_CASES = 1000
MOST_CLAIMS = 128
MOST_CITATIONS = 32
MOST_QUESTION_BYTES = MOST_CLAIM_BYTES = 8192
MOST_ANSWER_BYTES = 65536
VERDICTS = ("supported", "unsupported", "unreviewed")
NAME = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,%d}$"
CITATION = "^[A-Za-z0-9_.:-]{1,256}$"
NUMBER = "(0|[1-9][0-9]{0,8}|[1-3][0-9]{9}|4[01][0-9]{8}|42[0-8][0-9]{7}|429[0-3][0-9]{6}|4294[0-8][0-9]{5}|42949[0-5][0-9]{4}|429496[0-6][0-9]{3}|4294967[01][0-9]{2}|42949672[0-8][0-9]|429496729[0-5])"
MARKER = r"(?s)\[\[cite:(.*?)\]\]"
#: Bytes of the longest character.
CHARACTER = 4
WORD = r"[\p{IsAlphabetic}\p{N}_]"

_CITED = "ARRAY<STRUCT<block_id: STRING, verdict: STRING>>"
_CLAIMS = f"ARRAY<STRUCT<id: STRING, text: STRING, verdict: STRING, citations: {_CITED}, start_byte: BIGINT, end_byte: BIGINT>>"
SUITE = f"schema_version INT, suite_id STRING, cases ARRAY<STRUCT<id: STRING, project: STRING, page_id: BIGINT, revision_id: BIGINT, question: STRING, answer: STRING, claims: {_CLAIMS}>>"

COUNTS = (
    "claims", "reviewed_claims", "supported_claims", "unsupported_claims", "unreviewed_claims", "uncited_claims",
    "citations", "reviewed_citations", "supported_citations", "unsupported_citations", "unreviewed_citations",
)


def _code(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(code)) for broken, code in rules))


def _first(codes: Column) -> Column:
    return F.get(F.filter(codes, lambda c: c.isNotNull()), F.lit(0))


def _upto(n: Column) -> Column:
    """0 to n - 1; nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def _bytes(raw: Column, start: Column, end: Column) -> Column:
    return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int"))


def _made(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that others read for each of their elements: made once a row, behind a generator that projections are not merged over."""
    one = F.explode_outer(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("made")
    return rows.select(*(c for c in rows.columns if c not in columns), one).select("*", "made.*").drop("made")


def _with_markers(cases: DataFrame) -> DataFrame:
    """``cases`` with raw (bytes), pieces between markers, ids of markers, marks (id, start, end in bytes), spans of claims by start.

    Claims get ``next``, the byte where the claim after them starts, or the answer's end. Cases beyond the limits get no marks and no claims.
    """
    small = (F.octet_length("answer") <= MOST_ANSWER_BYTES) & (F.size("claims") <= MOST_CLAIMS)
    split = _made(
        cases, claims=F.when(small, F.col("claims")), raw=F.encode("answer", "UTF-8"), pieces=F.split("answer", MARKER, -1),
        ids=F.when(small, F.regexp_extract_all("answer", F.lit(MARKER), F.lit(1))),
    )
    frame = len("[[cite:]]")

    def mark(k: Column) -> Column:
        start = _total(F.transform(F.slice("pieces", 1, k + 1), lambda p: F.octet_length(p).cast("long"))) + _total(F.transform(F.slice("ids", 1, k), lambda i: F.octet_length(i).cast("long") + frame))
        own = F.get("ids", k)
        return F.struct(own.alias("id"), start.alias("start"), (start + F.octet_length(own) + frame).alias("end"))

    spans = F.array_sort(F.transform("claims", lambda c: F.struct(c["start_byte"].alias("start"), c["end_byte"].alias("end"))))
    following = lambda c: F.array_min(F.filter(F.transform("claims", lambda o: o["start_byte"]), lambda s: s > c["start_byte"]))
    ends = F.transform("claims", lambda c: F.coalesce(following(c), F.octet_length("raw").cast("long")))
    return _made(
        split, marks=F.transform(_upto(F.size("ids")), mark), spans=spans, claims=F.zip_with("claims", ends, lambda c, e: c.withField("next", e))
    )


def uncovered(spans: Column, raw: Column) -> Column:
    """The texts of ``raw`` between ``spans``, structs of start and end that are disjoint and in order."""
    n = F.size(spans)
    start = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get(spans, k - 1)["end"])
    end = lambda k: F.when(k == n, F.octet_length(raw).cast("long")).otherwise(F.get(spans, k)["start"])
    return F.transform(F.sequence(F.lit(0), n), lambda k: _bytes(raw, start(k), end(k)).cast("string"))


def _case_fault() -> Column:
    """The first rule that a case breaks by itself or against the cases before it."""
    c, version = F.col, F.col("schema_version")
    claims, marks, ids = c("claims"), c("marks"), c("ids")
    anchored = version >= 2
    invalid = ~(
        c("id").rlike(NAME % 254) & T.valid_article_key("project", "page_id") & (c("revision_id") > 0) & (F.trim("question") != "")
        & (F.octet_length("question") <= MOST_QUESTION_BYTES) & F.octet_length("answer").between(1, MOST_ANSWER_BYTES) & ~c("answer").contains("\0")
        & F.size("claims").between(1, MOST_CLAIMS)
    )
    malformed = F.exists(ids, lambda i: ~i.rlike(CITATION)) | F.element_at("pieces", -1).contains("[[cite:")

    def loose(x: Column) -> Column:
        """A claim that isn't the text at its span, lies over a marker or cuts a word."""
        s, e, raw = x["start_byte"], x["end_byte"], c("raw")
        here = (s >= 0) & (s < e) & (e <= F.octet_length(raw)) & (_bytes(raw, s, e) == F.encode(x["text"], "UTF-8")) & ~F.exists(marks, lambda m: (s < m["end"]) & (m["start"] < e))
        left = x["text"].rlike(f"^{WORD}") & _bytes(raw, F.greatest(s - CHARACTER, F.lit(0)), s).cast("string").rlike(f"{WORD}$")
        right = x["text"].rlike(f"{WORD}$") & _bytes(raw, e, e + CHARACTER).cast("string").rlike(f"^{WORD}")
        return ~F.coalesce(here & ~left & ~right, F.lit(False))

    spans = c("spans")
    overlapping = F.exists(_upto(F.size(spans)), lambda k: (k > 0) & (F.get(spans, k - 1)["end"] > F.get(spans, k)["start"]))
    reviewed = F.array_sort(F.concat(spans, F.transform(marks, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))))
    unseen = F.exists(uncovered(reviewed, c("raw")), lambda g: g.rlike(WORD))
    visible = F.array_join("pieces", " ")
    prefix = F.concat_ws(":", F.lit("wkb"), "project", c("page_id").cast("string"), c("revision_id").cast("string"), F.lit(""))

    def within(m: Column, x: Column) -> Column:
        return (m["start"] >= x["end_byte"]) & (m["end"] <= x["next"])

    def cited(x: Column) -> Column:
        def one(y: Column, j: Column) -> Column:
            b = y["block_id"]
            tail = F.substring(b, F.length(prefix) + 1, F.length(b))
            own = ~b.contains(":") | (b.startswith(prefix) & tail.rlike(f"^({NUMBER}:)*b{NUMBER}$"))
            return _code(
                (~(b.rlike(CITATION) & own), "InvalidCitation"), (F.exists(F.slice(x["citations"], 1, j), lambda z: z["block_id"] == b), "DuplicateCitation"),
                (~F.array_contains(ids, b), "MissingCitationMarker"), (anchored & ~F.exists(marks, lambda m: (m["id"] == b) & within(m, x)), "MisplacedCitationMarker"),
            )

        return _first(F.transform(x["citations"], one))

    def claim(x: Column, k: Column) -> Column:
        before = F.slice(claims, 1, k)
        backed = F.exists(x["citations"], lambda y: y["verdict"] == "supported")
        return F.coalesce(
            _code(
                (
                    ~(x["id"].rlike(NAME % 254) & (F.trim(x["text"]) != "") & x["text"].rlike(WORD) & (F.octet_length(x["text"]) <= MOST_CLAIM_BYTES) & (F.size(x["citations"]) <= MOST_CITATIONS))
                    | ((version == 1) & ~V.occurs_as_words(visible, x["text"])), "InvalidClaim",
                ),
                (F.exists(before, lambda o: (o["id"] == x["id"]) | ((version == 1) & (o["text"] == x["text"]))), "DuplicateClaim"),
            ),
            cited(x),
            _code((((x["verdict"] == "supported") & ~backed) | ((x["verdict"] == "unsupported") & backed), "InconsistentSupport")),
        )

    labelled = F.array_distinct(F.flatten(F.transform(claims, lambda x: F.transform(x["citations"], lambda y: y["block_id"]))))
    taken = lambda m: F.exists(claims, lambda x: F.exists(x["citations"], lambda y: y["block_id"] == m["id"]) & within(m, x))
    return F.coalesce(
        _code((invalid, "InvalidCase"), (c("id_again"), "DuplicateCase"), (malformed, "InvalidCitation"), (c("same_again"), "DuplicateCase")),
        F.when(anchored, _code((F.exists(claims, loose), "InvalidClaim"), (overlapping, "InvalidClaim"))).otherwise(
            _code((F.exists(claims, lambda x: x["start_byte"].isNotNull() | x["end_byte"].isNotNull()), "InvalidClaim"))
        ),
        F.when(version == 3, _code((unseen, "UnreviewedProse"))),
        _first(F.transform(claims, claim)),
        _code(((F.size(F.array_except(ids, labelled)) > 0) | (anchored & F.exists(marks, lambda m: ~taken(m))), "UnlabeledCitationMarker")),
    )


def review(suites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores, faults) of ``suites`` (suite, body).

    Scores: suite, annotation_version, position, id, project, page_id, revision_id, answer_sha256, claims as given, and a
    count for each of ``COUNTS``, a row for each case of the suites that break no rule. Faults: suite, case_id, code, a row
    for each of the others. White space doesn't make another case of the same question and answer, nor do citation ids.
    """
    s = F.from_json("body", SUITE)
    parsed = _made(suites.select("suite", "body"), s=s)
    bad_verdict = F.exists("s.cases", lambda c: F.exists(c["claims"], lambda x: ~x["verdict"].isin(*VERDICTS) | F.exists(x["citations"], lambda y: ~y["verdict"].isin(*VERDICTS))))
    suite_fault = _code(
        (F.coalesce(F.octet_length("body"), F.lit(0)) > MOST_SUITE_BYTES, "TooLarge"), (F.col("s.cases").isNull() | F.col("s.schema_version").isNull() | F.coalesce(bad_verdict, F.lit(False)), "InvalidJson"),
        (~F.col("s.schema_version").isin(1, 2, 3), "UnsupportedSchema"), (~F.col("s.suite_id").rlike(NAME % 127), "InvalidSuiteId"), (~F.size("s.cases").between(1, MOST_CASES), "InvalidCase"),
    )
    told = _made(parsed, suite_fault=suite_fault)
    plain = lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))
    same = lambda c: F.sha2(F.to_json(F.struct(c["project"], c["page_id"], c["revision_id"], plain(c["question"]), plain(F.array_join(F.split(c["answer"], MARKER, -1), " ")))), 256)
    several = F.col("suite_fault").isNull() & (F.size("s.cases") > 1)
    named = _made(told, own_ids=F.when(several, F.transform("s.cases", lambda c: c["id"])), own_texts=F.when(several, F.transform("s.cases", same)))
    again = lambda names, i: F.coalesce(F.array_position(names, F.get(names, i)) <= i, F.lit(False))
    # a suite with a fault has one row here, without a case
    placed = F.transform(F.when(F.col("suite_fault").isNull(), F.col("s.cases")), lambda c, i: F.struct(c.alias("case"), again(F.col("own_ids"), i).alias("id_again"), again(F.col("own_texts"), i).alias("same_again")))
    cases = named.select("suite", "suite_fault", F.col("s.schema_version").alias("schema_version"), F.posexplode_outer(placed).alias("position", "p")).select(
        "suite", "suite_fault", "schema_version", "position", "p.case.*", "p.id_again", "p.same_again"
    )
    marked = _with_markers(cases)
    judged = marked.withColumn("fault", F.when(F.col("suite_fault").isNull(), _case_fault()))
    given = F.flatten(F.transform("claims", lambda x: x["citations"]))
    count = lambda rows, verdicts: F.size(F.filter(rows, lambda x: x["verdict"].isin(*verdicts))).cast("long")
    counts = {"claims": F.size("claims").cast("long"), "citations": F.size(given).cast("long"), "uncited_claims": F.size(F.filter("claims", lambda x: F.size(x["citations"]) == 0)).cast("long")}
    for rows, name in ((F.col("claims"), "claims"), (given, "citations")):
        counts[f"reviewed_{name}"] = count(rows, VERDICTS[:2])
        counts |= {f"{v}_{name}": count(rows, (v,)) for v in VERDICTS}
    reviewed = judged.select(
        "suite", "suite_fault", "fault", F.col("schema_version").alias("annotation_version"), "position", "id", "project", "page_id", "revision_id",
        F.sha2("answer", 256).alias("answer_sha256"), F.when(F.col("fault").isNull(), F.col("claims")).alias("labels"), *(counts[n].alias(n) for n in COUNTS),
    )
    reviewed = save(reviewed, "reviewed-cases")  # the one table that is written: without answers, and without the claims of bad cases
    worst = reviewed.where("fault is not null").groupBy("suite").agg(F.min_by(F.struct(F.col("id").alias("case_id"), F.col("fault").alias("code")), "position").alias("f"))
    faults = reviewed.where("suite_fault is not null").select("suite", F.lit(None).cast("string").alias("case_id"), F.col("suite_fault").alias("code")).unionByName(worst.select("suite", "f.case_id", "f.code"))
    scores = reviewed.where("suite_fault is null and fault is null").drop("suite_fault", "fault").join(worst.select("suite"), "suite", "left_anti")
    return scores, faults


def strict_faults(scores: DataFrame, articles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(suite, case_id, code): what the corpus says against suites that break no rule of their own.

    ``articles`` (project, page_id, revision_id) has one row a page, ``blocks`` (project, page_id, revision_id, block_id).
    A case's article has to be there at its revision, and each block that it cites within it.
    """
    key = ["project", "page_id", "revision_id"]
    order = F.struct("position", "n")
    stale = scores.join(articles.select(key), key, "left_anti").select("suite", "id", "position", F.lit(0).alias("n"), F.lit("UnknownOrStaleArticle").alias("code"))
    cited = scores.select("suite", "id", "position", *key, F.explode(F.array_distinct(F.flatten(F.transform("labels", lambda x: F.transform(x["citations"], lambda y: y["block_id"]))))).alias("block_id"))
    unknown = cited.join(blocks.select(*key, "block_id"), [*key, "block_id"], "left_anti").select("suite", "id", "position", F.lit(1).alias("n"), F.lit("UnknownEvidence").alias("code"))
    return stale.unionByName(unknown).groupBy("suite").agg(F.min_by(F.struct(F.col("id").alias("case_id"), "code"), order).alias("f")).select("suite", "f.case_id", "f.code")


def report(scores: DataFrame) -> DataFrame:
    """Totals of each suite, and whether all its claims and citations were reviewed."""
    totals = scores.groupBy("suite", "annotation_version").agg(F.count(F.lit(1)).alias("cases"), *(F.sum(n).alias(n) for n in COUNTS))
    every = lambda what: (F.col(f"unreviewed_{what}") == 0) & (F.col(f"reviewed_{what}") > 0)
    return totals.withColumns({"all_claims_reviewed": every("claims"), "all_citations_reviewed": every("citations")})
