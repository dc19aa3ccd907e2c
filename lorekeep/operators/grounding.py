"""Answers that keep to their evidence: saved citations, soft anchors, checked answers, retrieval for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import search

SAVED_SCHEMA = 1
MOST_EXCERPT_BYTES = 65536
MOST_FIELD_BYTES = 4096
MOST_HEADINGS = 64
#: What a term of the selected text weighs beside one of the question, and a block of the current section beside others.
SELECTION_WEIGHT = 0.5
SECTION_BOOST = 1.25
HEADING_BONUS = 1.5
#: Blocks from which on a word of every block says nothing.
LEAST_UBIQUITOUS = 3
MOST_SELECTION_TERMS = 64
# Words of questions that make no passage evidence.
QUESTION_WORDS = frozenset(
    """the and for are was were what which who whom whose when where why how does did doe with from that this these
    those has have had not but its into about than then there their they them can could would should will you your
    any""".split()
)


def saved_citation_fault(schema: Column, project: Column, page_id: Column, revision_id: Column, snapshot: Column, block_id: Column,
                         headings: Column, excerpt: Column, digest: Column) -> Column:
    """The first thing wrong with a saved citation, null if nothing is."""
    too_large = (
        (F.octet_length(excerpt) > MOST_EXCERPT_BYTES) | (F.size(headings) > MOST_HEADINGS)
        | F.exists(headings, lambda h: F.octet_length(h) > MOST_FIELD_BYTES)
        | (F.octet_length(block_id) > MOST_FIELD_BYTES) | (F.octet_length(project) > MOST_FIELD_BYTES)
    )
    prefix = F.concat(F.lit("wkb:"), project, F.lit(":"), page_id.cast("string"), F.lit(":"), revision_id.cast("string"), F.lit(":"))
    inconsistent = (project == "") | (page_id <= 0) | (revision_id <= 0) | ~F.startswith(block_id, prefix)
    return (
        F.when(~schema.eqNullSafe(F.lit(SAVED_SCHEMA)), "unsupported schema")
        .when(too_large, "too large")
        .when(snapshot.isNotNull() & ~snapshot.rlike("^[a-z0-9_-]{1,128}$"), "invalid snapshot id")
        .when(F.coalesce(inconsistent, F.lit(True)), "inconsistent identity")
        .when(~F.sha2(excerpt, 256).eqNullSafe(digest), "excerpt digest mismatch")
    )


def resolve_saved_citations(saved: DataFrame, blocks: DataFrame) -> DataFrame:
    """(citation_id, status, block_id): saved citations against the articles as they are.

    ``saved`` has citation_id, project, page_id, revision_id, block_id, heading, excerpt;
    ``blocks`` the current project, page_id, revision_id, block_id, heading, text. ``current``
    if the block is the same, ``unavailable`` if that revision has no such block, ``stale`` at
    another revision, with the block where exactly one has the same text and headings, and
    ``missing`` without such an article. Two equi-joins; articles are not gathered.
    """
    pages = blocks.groupBy("project", "page_id").agg(F.max("revision_id").alias("now"))
    known = saved.join(pages, ["project", "page_id"], "left")
    same = blocks.select("project", "page_id", "block_id", F.col("text").alias("excerpt"), F.coalesce("heading", F.lit("")).alias("own_heading"))
    found = known.withColumn("own_heading", F.coalesce("heading", F.lit(""))).join(
        same.withColumnRenamed("block_id", "there"), ["project", "page_id", "own_heading", "excerpt"], "left"
    )
    counted = found.groupBy("citation_id", "revision_id", "now", "block_id").agg(
        F.count("there").alias("n"), F.min("there").alias("there"), F.max((F.col("there") == F.col("block_id")).cast("int")).alias("own")
    )
    status = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("now") != F.col("revision_id"), "stale")
        .when(F.col("own") == 1, "current")
        .otherwise("unavailable")
    )
    return counted.select(
        "citation_id", status.alias("status"),
        F.when(status == "current", F.col("block_id")).when((status == "stale") & (F.col("n") == 1), F.col("there")).alias("block_id"),
    )


def normal_text(text: Column | str) -> Column:
    """White space collapsed; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[\s\x{85}\p{Z}]+", " "))
    return F.when(t != "", t)


def relocate_anchors(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(anchor_id, status, block_id): where the paragraph of an anchor stands now.

    ``anchors`` has anchor_id, project, page_id, block_id, heading, ordinal, text; ``blocks`` the
    same of the current articles. The only block with the text is it; of several the only one
    with the anchor's heading and ordinal; else the anchor is ``ambiguous``, or ``missing``.
    """
    here = blocks.select("project", "page_id", F.col("block_id").alias("there"), F.col("heading").alias("h"), F.col("ordinal").alias("o"), normal_text("text").alias("norm"))
    met = anchors.withColumn("norm", normal_text("text")).join(here, ["project", "page_id", "norm"], "left")
    alike = F.col("h").eqNullSafe(F.col("heading")) & (F.col("o") == F.col("ordinal")) & F.col("there").isNotNull()
    n = met.groupBy("anchor_id", "block_id").agg(
        F.count("there").alias("n"), F.min("there").alias("only"),
        F.sum(alike.cast("long")).alias("n_alike"), F.min(F.when(alike, F.col("there"))).alias("only_alike"),
    )
    hit = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_alike") == 1, F.col("only_alike"))
    status = F.when(hit == F.col("block_id"), "located").when(hit.isNotNull(), "relocated").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    return n.select("anchor_id", status.alias("status"), hit.alias("block_id"))


def check_answers(answers: DataFrame, allowed: DataFrame, retrieved: DataFrame, claimed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(answer_id, status, citations): whether each answer keeps to its scope and its evidence.

    ``answers`` (answer_id, text, abstained); ``allowed`` (answer_id, project, page_id);
    ``retrieved`` (answer_id, project, page_id, block_id, excerpt) and ``claimed`` (answer_id,
    project, page_id, block_id) are what the model was given and what it cites; ``blocks`` is the
    corpus. The status is the first of these that holds: ``empty scope``, ``unknown article``,
    ``out of scope``, ``unsupported``, ``empty``, ``invalid evidence``, ``duplicate evidence``,
    ``duplicate citation``, ``unretrieved citation``; else ``insufficient evidence`` for an
    abstention and ``supported``. All are counted by equi-joins.
    """
    key = ["project", "page_id"]
    pages = blocks.select(*key).distinct().withColumn("known", F.lit(True))
    scope = allowed.distinct().join(pages, key, "left")
    in_scope = scope.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_allowed"), F.sum(F.col("known").isNull().cast("long")).alias("unknown"))
    ok = allowed.select("answer_id", *key).distinct().withColumn("allowed", F.lit(True))
    corpus = blocks.select(*key, "block_id", F.col("text").alias("excerpt")).distinct().withColumn("valid", F.lit(True))
    given = retrieved.join(ok, ["answer_id", *key], "left").join(corpus, [*key, "block_id", "excerpt"], "left")
    per_block = given.groupBy("answer_id", *key, "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("allowed").isNull().cast("long")).alias("outside"), F.sum(F.col("valid").isNull().cast("long")).alias("invalid")
    )
    evidence = per_block.groupBy("answer_id").agg(
        F.sum("outside").alias("r_outside"), F.sum("invalid").alias("invalid"), F.sum((F.col("n") > 1).cast("long")).alias("repeated")
    )
    cited = claimed.join(ok, ["answer_id", *key], "left").groupBy("answer_id", *key, "block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("allowed").isNull().cast("long")).alias("outside")
    )
    supplied = per_block.select("answer_id", *key, "block_id").withColumn("supplied", F.lit(True))
    claims = cited.join(supplied, ["answer_id", *key, "block_id"], "left").groupBy("answer_id").agg(
        F.sum("n").alias("n_claimed"), F.sum("outside").alias("c_outside"), F.sum((F.col("n") > 1).cast("long")).alias("c_repeated"),
        F.sum(F.col("supplied").isNull().cast("long")).alias("unretrieved"),
    )
    every = answers.join(in_scope, "answer_id", "left").join(evidence, "answer_id", "left").join(claims, "answer_id", "left")

    def some(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) > 0

    blank = F.trim("text") == ""
    status = (
        F.when(~some("n_allowed"), "empty scope")
        .when(some("unknown"), "unknown article")
        .when(some("r_outside") | some("c_outside"), "out of scope")
        .when(F.col("abstained") & (~blank | some("n_claimed")), "unsupported")
        .when(~F.col("abstained") & blank, "empty")
        .when(~F.col("abstained") & ~some("n_claimed"), "unsupported")
        .when(some("invalid"), "invalid evidence")
        .when(some("repeated"), "duplicate evidence")
        .when(some("c_repeated"), "duplicate citation")
        .when(some("unretrieved"), "unretrieved citation")
        .when(F.col("abstained"), "insufficient evidence")
        .otherwise("supported")
    )
    return every.select("answer_id", status.alias("status"), F.coalesce("n_claimed", F.lit(0)).alias("citations"))


def answer_parts(answers: DataFrame) -> DataFrame:
    """(answer_id, place, kind, part): an answer's text and citation markers in turn, without empty texts."""
    marked = F.regexp_replace("text", r"\[\[cite:([A-Za-z0-9_:.\-]+)\]\]", "\u0000$1\u0000")
    parts = F.transform(F.split(marked, "\u0000"), lambda p, i: F.struct(F.when(i % 2 == 1, "citation").otherwise("text").alias("kind"), p.alias("part")))
    return answers.select("answer_id", F.posexplode(F.filter(parts, lambda p: p["part"] != "")).alias("place", "p")).select("answer_id", "place", "p.kind", "p.part")


def choose_versions(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """(project, page_id, choice, revision_id): which copy of each requested article to show.

    ``requests`` has project, page_id, online; ``versions`` project, page_id, location (pack, saved,
    cache, online), revision_id, complete. Online, the current revision if it is there, else
    ``fetch`` with the best complete copy to fall back on; offline, that copy or ``missing``.
    """
    order = F.when(F.col("location") == "pack", 1).when(F.col("location") == "saved", 2).otherwise(3)
    local = F.min(F.when(F.col("complete") & (F.col("location") != "online"), F.struct(order.alias("order"), "location", "revision_id")))
    current = F.min(F.when(F.col("location") == "online", F.col("revision_id")))
    best = versions.groupBy("project", "page_id").agg(local.alias("local"), current.alias("current"))
    met = requests.join(best, ["project", "page_id"], "left")
    choice = (
        F.when(F.col("online") & F.col("current").isNotNull(), "current")
        .when(F.col("online"), "fetch")
        .when(F.col("local").isNotNull(), F.col("local.location"))
        .otherwise("missing")
    )
    revision = F.when(choice == "current", F.col("current")).otherwise(F.col("local.revision_id"))
    return met.select("project", "page_id", choice.alias("choice"), revision.alias("revision_id"))


def retrieve(blocks: DataFrame, question: str, limit: int, most_tokens: int, selection: str = "", in_section: Column | None = None) -> DataFrame:
    """Evidence for one question from each article: project, page_id, block_id, place, milli, tokens, selected, heading_hit, current, budget_limited.

    ``blocks`` has project, page_id, block_id, heading, text. Blocks are ranked within their
    article by BM25 with a bonus for terms in the heading; terms of the selected text weigh
    half. A block counts only if a telling term matches, or if it holds the selection: not a
    short word, nor a word of questions, nor, unless the question has no others, one that all
    of the article's blocks have. Blocks of the current section weigh a quarter more, those with
    the selection come first. Taken are, in that order, up to ``limit`` blocks whose token
    estimates fit ``most_tokens`` together; what doesn't fit is passed over.
    """
    spark = blocks.sparkSession
    first = search.query_terms(spark, question)
    more = spark.range(1).select(F.array_distinct(F.slice(T.query_tokens_all(F.lit(selection)), 1, MOST_SELECTION_TERMS))).head()[0] if selection else []
    weights = {t: SELECTION_WEIGHT for t in more} | {t: 1.0 for t in first}
    terms = list(weights)
    telling = [(len(t) >= 3 or T.is_cjk(t)) and t not in QUESTION_WORDS for t in terms]
    wanted = spark.range(1).select(F.array_join(T.index_tokens(F.lit(selection)), " ")).head()[0] if selection else ""
    article = Window.partitionBy("project", "page_id")
    words = blocks.select(
        "project", "page_id", "block_id", T.index_tokens("text").alias("w"), T.index_tokens(F.coalesce("heading", F.lit(""))).alias("h"),
        T.token_estimate(F.concat(F.coalesce("heading", F.lit("")), F.lit("\n"), "text")).alias("tokens"),
        (in_section if in_section is not None else F.lit(False)).alias("current"),
    )
    counted = words.select(
        "project", "page_id", "block_id", "tokens", "current", F.size("w").alias("length"),
        (F.array_join("w", " ").contains(wanted) if wanted else F.lit(False)).alias("selected"),
        F.array(*(search.count_in("w", t) for t in terms)).cast("array<int>").alias("f"),
        F.array(*(F.array_contains("h", t) for t in terms)).cast("array<boolean>").alias("g"),
    )
    stats = counted.withColumn("n", F.count(F.lit(1)).over(article)).withColumn("mean", F.greatest(F.avg("length").over(article), F.lit(1.0)))
    score, informed, heading = F.lit(0.0), F.lit(False), F.lit(False)
    for i in range(len(terms)):
        stats = stats.withColumn(f"d{i}", F.sum((F.get("f", F.lit(i)) > 0).cast("long")).over(article))
    everywhere = [(F.col("n") >= LEAST_UBIQUITOUS) & (F.col(f"d{i}") >= F.col("n")) for i in range(len(terms))]
    specific = F.lit(False)
    for i, t in enumerate(telling):
        if t:
            specific = specific | ~everywhere[i]
    for i, t in enumerate(terms):
        d, f, g = F.col(f"d{i}"), F.get("f", F.lit(i)), F.get("g", F.lit(i))
        idf = F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5))
        own = F.when(f > 0, idf * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * F.col("length") / F.col("mean")))).otherwise(0.0)
        own = own + F.when(g, HEADING_BONUS * idf).otherwise(0.0)
        score = score + weights[t] * own
        heading = heading | g
        if telling[i]:
            informed = informed | ((own > 0) & (~everywhere[i] | ~specific))
    kept = stats.select(
        "project", "page_id", "block_id", "tokens", "current", "selected", heading.alias("heading_hit"), score.alias("score"), informed.alias("informed")
    ).where(((F.col("score") > 0) & F.col("informed")) | F.col("selected"))
    milli = F.round(F.when(F.col("current"), F.col("score") * SECTION_BOOST).otherwise(F.col("score")) * 1000).cast("long")
    place = Window.partitionBy("project", "page_id").orderBy(F.col("selected").desc(), F.col("milli").desc(), "block_id")
    ranked = kept.withColumn("milli", milli).withColumn("rank", F.row_number().over(place))
    limit = min(limit, 100)
    # an article's blocks are one bounded array, folded in order
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct("rank", "tokens"))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ranks"), F.lit(False).alias("limited")),
        lambda a, h: F.when(F.size(a["ranks"]) >= limit, a)
        .when(a["used"] + h["tokens"] > most_tokens, F.struct(a["used"].alias("used"), a["ranks"].alias("ranks"), F.lit(True).alias("limited")))
        .otherwise(F.struct((a["used"] + h["tokens"]).alias("used"), F.concat(a["ranks"], F.array(h["rank"])).alias("ranks"), a["limited"].alias("limited"))),
    )
    packed = ranked.groupBy("project", "page_id").agg(taken.alias("t")).select("project", "page_id", F.posexplode("t.ranks").alias("place", "rank"), F.col("t.limited").alias("budget_limited"))
    return ranked.join(packed, ["project", "page_id", "rank"]).select(
        "project", "page_id", "block_id", (F.col("place") + 1).alias("place"), "milli", "tokens", "selected", "heading_hit", "current", "budget_limited"
    )
