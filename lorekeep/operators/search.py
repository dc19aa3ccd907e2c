"""Ranked search over titles, bodies and passages, with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.lineage import save

K1, B = 1.2, 0.75
TITLE_WEIGHT = 8
HEADING_WEIGHT = 4


def _distinct_query(query: str) -> Column:
    return F.array_distinct(T.query_tokens(F.lit(query)))


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """The distinct terms of a query, 32 at most."""
    return spark.range(1).select(_distinct_query(query).alias("q")).head()["q"]


def count_in(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == term))


def set_overlap(blocks: DataFrame, query: str, k: int, project: str | None = None) -> DataFrame:
    """Passages by the query's distinct terms in the text, four times those in the headings.

    ``blocks`` has project, page_id, block_id, text, heading. Order: score
    descending, then project, page and block. At most 100 are returned.
    """
    if project is not None:
        blocks = blocks.where(F.col("project") == project)
    terms = _distinct_query(query)
    score = F.size(F.array_intersect(terms, T.index_tokens("text"))) + HEADING_WEIGHT * F.size(
        F.array_intersect(terms, T.index_tokens(F.coalesce("heading", F.lit(""))))
    )
    return (
        blocks.select("project", "page_id", "block_id", score.cast("long").alias("score"))
        .where("score > 0")
        .orderBy(F.col("score").desc(), "project", "page_id", "block_id")
        .limit(min(k, 100))
    )


def title_scores(titles: DataFrame, query: str, k: int) -> DataFrame:
    """Titles in which each query term begins some word: 10 a term, 20 for the title, more for exact and prefix."""
    words, own, terms = T.index_tokens("title"), T.query_tokens("title"), T.query_tokens(F.lit(query))
    every = F.forall(terms, lambda t: F.exists(words, lambda w: w.startswith(t)))
    begins = F.slice(own, 1, F.size(terms)) == terms
    score = 10 * F.size(terms) + F.when(own == terms, 100).otherwise(0) + F.when(begins, 20).otherwise(0) + 20
    return (
        titles.where(every & (F.size(terms) > 0))
        .select("project", "page_id", "title", score.cast("long").alias("score"))
        .orderBy(F.col("score").desc(), "project", "page_id")
        .limit(k)
    )


def full_text(articles: DataFrame, query: str, k: int, project: str | None = None) -> DataFrame:
    """Articles by weighted BM25 over title (8) and body (1); any query term is enough.

    One pass over the texts keeps each article's length and its places of query
    terms; of that narrow table one row of statistics reaches the driver, and the
    top k are scored.
    """
    if project is not None:
        articles = articles.where(F.col("project") == project)
    terms = query_terms(articles.sparkSession, query)
    width = len(terms)
    tokens = articles.select("project", "page_id", T.index_tokens("title").alias("tt"), T.index_tokens("text").alias("bt"))
    found = save(
        tokens.select(
            "project", "page_id", (F.size("tt") + F.size("bt")).alias("length"),
            *(F.filter(c, lambda w: w.isin(terms)).alias(c) for c in ("tt", "bt")),
        ),
        "term-places",
    )
    counted = found.select(
        "project", "page_id", "length",
        F.array(*(TITLE_WEIGHT * count_in("tt", t) + count_in("bt", t) for t in terms)).cast("array<int>").alias("tf"),
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"),
        *(F.sum((F.get("tf", F.lit(i)) > 0).cast("long")).alias(f"d{i}") for i in range(width)),
    ).head()
    n, mean = stats["n"], stats["mean"] or 1.0
    score: Column = F.lit(0.0)
    for i in range(width):
        d = stats[f"d{i}"] or 0
        idf = F.greatest(F.log(F.lit((n - d + 0.5) / (d + 0.5))), F.lit(1e-6))
        tf = F.get("tf", F.lit(i))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    return (
        counted.where(F.exists("tf", lambda f: f > 0))
        .select("project", "page_id", F.round(score, 6).alias("score"))
        .orderBy(F.col("score").desc(), "project", "page_id")
        .limit(k)
    )


def prefix_titles(titles: DataFrame, prefix: str, k: int) -> DataFrame:
    """Pages with a title or alias whose key starts with the query's, by key; a title before an alias.

    ``titles`` has project, page_id, title, name, is_alias: ``name`` is what is matched.
    """
    key, wanted = T.title_key("name"), T.title_key(F.lit(prefix))
    first = Window.partitionBy("project", "page_id").orderBy("key", "is_alias")
    return (
        titles.withColumn("key", key)
        .where(F.col("key").startswith(wanted))
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("project", "page_id", "title", "key", "is_alias")
        .orderBy("key", "is_alias", "project", "page_id")
        .limit(k)
    )


def bm25_blocks(blocks: DataFrame, query: str, k: int) -> DataFrame:
    """Passages by BM25 with a bonus of 1.5 idf for a term in the headings; milli-scores, score 0 left out.

    ``blocks`` has block_id, text, heading. Document frequencies and the mean
    length come from one pass over all blocks.
    """
    terms = query_terms(blocks.sparkSession, query)
    width = len(terms)
    tokens = blocks.select(
        "block_id", T.index_tokens("text").alias("w"), T.index_tokens(F.coalesce("heading", F.lit(""))).alias("h")
    )
    found = save(
        tokens.select(
            "block_id", F.size("w").alias("length"),
            *(F.filter(c, lambda x: x.isin(terms)).alias(c) for c in ("w", "h")),
        ),
        "term-places",
    )
    rows = found.select(
        "block_id", "length",
        F.array(*(count_in("w", t) for t in terms)).cast("array<int>").alias("f"),
        F.array(*(F.array_contains("h", t) for t in terms)).cast("array<boolean>").alias("in_head"),
    )
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"),
        *(F.sum((F.get("f", F.lit(i)) > 0).cast("long")).alias(f"d{i}") for i in range(width)),
    ).head()
    n, mean = stats["n"], max(stats["mean"] or 1.0, 1.0)
    score: Column = F.lit(0.0)
    for i in range(width):
        d = stats[f"d{i}"] or 0
        idf = F.log(F.lit(1 + (n - d + 0.5) / (d + 0.5)))
        f = F.get("f", F.lit(i))
        score = score + idf * f * 2.2 / (f + K1 * (0.25 + 0.75 * F.col("length") / mean))
        score = score + F.when(F.get("in_head", F.lit(i)), 1.5 * idf).otherwise(0.0)
    return (
        rows.where(F.exists("f", lambda f: f > 0) | F.exists("in_head", lambda h: h))
        .select("block_id", F.round(score * 1000).cast("long").alias("milli"))
        .where("milli > 0")
        .orderBy(F.col("milli").desc(), "block_id")
        .limit(min(k, 100))
    )


def pack_budget(hits: DataFrame, cost: Column, budget: int, by: list[str], order: list[Column | str], most: int = 100) -> DataFrame:
    """Greedy packing: ranked hits are taken if their cost still fits, else skipped. At most ``most`` hits a group.

    ``by`` are the group's columns; hits beyond rank ``most`` are no candidates by
    contract, so that a group is a bounded array folded in order.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = hits.withColumn("cost", cost.cast("long")).withColumn("rank", rank).where(F.col("rank") <= most)
    names = [c for c in ranked.columns if c not in by]
    packed = F.aggregate(
        F.array_sort(F.collect_list(F.struct("rank", *(c for c in names if c != "rank")))),
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken")),
        lambda a, h: F.when(
            h["cost"] <= budget - a["used"],
            F.struct((a["used"] + h["cost"]).alias("used"), F.concat(a["taken"], F.array(h["rank"])).alias("taken")),
        ).otherwise(a),
    )
    taken = ranked.groupBy(*by).agg(packed.alias("p")).select(*by, F.explode("p.taken").alias("rank"))
    return ranked.join(taken, [*by, "rank"])


def term_statistics(blocks: DataFrame, query: str) -> DataFrame:
    """For each distinct query term: blocks that have it and places in all."""
    terms = _distinct_query(query)
    found = blocks.select("block_id", F.explode(F.filter(T.index_tokens("text"), lambda w: F.array_contains(terms, w))).alias("term"))
    per_block = found.groupBy("block_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_block.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
