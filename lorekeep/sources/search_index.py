"""A full-text index on disk: postings by bucket of terms, written once and read by the query's terms only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError
from lorekeep.functions import text as T
from lorekeep.lineage import save
from lorekeep.operators import search
from lorekeep.sources import published

BUCKETS = 64
#: Files that a bucket is dealt into, so that a term of nearly all articles is no single task's.
SPREAD = 4


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(articles: DataFrame, folder: str) -> None:
    """Write the index of ``articles`` (project, page_id, title, text) to an empty folder.

    ``postings`` has a row for each term of each article, its places weighted by field, with the
    article's length; ``terms`` how many articles have each; ``sizes`` articles and tokens of
    each project.
    """
    words = articles.select(
        "project", "page_id", T.index_tokens(F.coalesce("title", F.lit(""))).alias("tt"), T.index_tokens(F.coalesce("text", F.lit(""))).alias("bt")
    )
    length = (F.size("tt") + F.size("bt")).alias("length")
    weighted = F.concat(F.flatten(F.array_repeat("tt", search.TITLE_WEIGHT)), F.col("bt"))
    # all of an article's tokens are in its row, so they are counted there and only postings are shuffled
    counted = save(words.select("project", "page_id", length, T.counts(weighted).alias("counts")), "term-counts")
    postings = counted.select("project", "page_id", "length", F.explode("counts").alias("t")).select("project", "page_id", "length", "t.term", F.col("t.n").cast("long").alias("tf"))
    dealt = postings.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)))
    dealt.sortWithinPartitions("bucket", "term", "project", "page_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
    sizes = counted.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens"))
    sizes.write.parquet(f"{folder}/sizes")
    read = articles.sparkSession.read.parquet(f"{folder}/postings")
    terms = read.groupBy("bucket", "project", "term").agg(F.count(F.lit(1)).alias("n"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/terms")


def verify(spark: SparkSession, folder: str, articles: DataFrame) -> None:
    """Raise if the index has other articles than ``articles`` (project, page_id): a missing or a foreign one."""
    there = spark.read.parquet(f"{folder}/postings").select("project", "page_id").distinct().withColumn("i", F.lit(True))
    due = articles.select("project", "page_id").distinct().withColumn("c", F.lit(True))
    off = there.join(due, ["project", "page_id"], "full").where("i is null or c is null")
    first = off.agg(F.min(F.struct("project", "page_id", F.col("i").isNull().alias("missing")))).head()[0]
    if first is not None:
        raise LorekeepError("MissingInIndex" if first["missing"] else "ForeignInIndex", first.asDict())


def rebuild(articles: DataFrame, root: str, checked: bool = True) -> str:
    """Build, verify and publish an index of ``articles``: all of it or nothing. Its folder."""
    spark = articles.sparkSession
    worded = articles.where(T.has_tokens(F.concat_ws(" ", "title", "text")))
    return published.publish(
        spark, root, lambda folder: build(articles, folder), (lambda folder: verify(spark, folder, worded)) if checked else None
    )


def top(spark: SparkSession, folder: str, query: str, k: int, project: str | None = None) -> DataFrame:
    """The ``k`` best articles as ``search.full_text`` ranks them, from the buckets of the query's terms alone.

    Of the statistics a row for each term and one of sizes reach the driver.
    """
    terms = search.query_terms(spark, query)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]

    def of_query(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}")
        rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows if project is None else rows.where(F.col("project") == project)

    sizes = spark.read.parquet(f"{folder}/sizes")
    sizes = sizes if project is None else sizes.where(F.col("project") == project)
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).head()
    n, mean = whole["n"] or 0, (whole["tokens"] or 0) / (whole["n"] or 1) or 1.0
    seen = dict(of_query("terms").groupBy("term").agg(F.sum("n")).collect())
    idf = F.lit(None).cast("double")
    for t in terms:
        d = seen.get(t, 0)
        idf = F.when(F.col("term") == t, F.greatest(F.log(F.lit((n - d + 0.5) / (d + 0.5))), F.lit(1e-6))).otherwise(idf)
    tf = F.col("tf")
    part = idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("length") / mean))
    return (
        of_query("postings").groupBy("project", "page_id").agg(F.round(F.sum(part), 6).alias("score"))
        .orderBy(F.col("score").desc(), "project", "page_id")
        .limit(k)
    )


def verified_top(spark: SparkSession, folder: str, articles: DataFrame, query: str, k: int) -> DataFrame:
    """``top`` with each hit's title and revision; raises if a hit is no article of the catalog."""
    hits = top(spark, folder, query, k)
    rows = hits.join(articles.select("project", "page_id", "title", "revision_id"), ["project", "page_id"], "left")
    lost = rows.where("revision_id is null").head()
    if lost is not None:
        raise LorekeepError("ForeignInIndex", lost.asDict())
    return rows
