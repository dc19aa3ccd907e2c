"""Views of the driver's tables as an encyclopedia: articles, blocks, graphs, state.

Ids start at 1, so document and page ids are moved by one. The SQL of each view,
for the oracle, stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import text as T

WORD = r"[^ \t\n\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_words(text, n: int):
    """Of a long text, no more is split than has them."""
    text = F.regexp_extract(text, rf"^[ \t\n\r]*+(?:{WORD}+(?:[ \t\n\r]++|$)){{0,{n}}}", 0)
    return F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, n))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit("wiki")).alias("project"),
        (F.col("doc_id") + 1).alias("page_id"),
        (F.col("doc_id") + 1_000_000).alias("revision_id"),
        _first_words(F.col("text"), 4).alias("title"),
        "text",
    )


ARTICLES = r"""articles AS (
    SELECT lang || 'wiki' AS project, doc_id + 1 AS page_id, doc_id + 1000000 AS revision_id,
           array_to_string((regexp_extract_all(text, '[^ \t\n\r]+'))[1:4], ' ') AS title, text
    FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines: the first is the lead, then four to a section, whose heading is its first three words."""
    lines = articles(spark, sf_dir).withColumn("lines", F.split("text", "\n"))
    place = lines.select("project", "page_id", "revision_id", "title", "lines", F.posexplode("lines").alias("line", "text"))
    section = F.floor((F.col("line") - 1) / 4).cast("int") + 1
    cut = place.where(F.col("text").rlike(r"[^ \t\n\r]")).select(
        "project", "page_id", "revision_id", "title", "line", "text",
        F.when(F.col("line") > 0, section).alias("section"),
        F.when(F.col("line") > 0, _first_words(F.get("lines", (section - 1) * 4 + 1), 3)).alias("heading"),
    )
    path = F.when(F.col("section").isNull(), F.array().cast("array<int>")).otherwise(F.array("section"))
    ordinal = F.when(F.col("line") == 0, 0).otherwise((F.col("line") - 1) % 4)
    return cut.withColumn(
        "block_id", T.block_id(F.col("project"), F.col("page_id"), F.col("revision_id"), path, ordinal)
    )


BLOCKS = (
    ARTICLES
    + r""",
lines AS (
    SELECT project, page_id, revision_id, title, string_split(text, chr(10)) AS ls,
           unnest(range(len(string_split(text, chr(10))))) AS line
    FROM articles),
blocks AS (
    SELECT project, page_id, revision_id, title, line, ls[line + 1] AS text,
           CASE WHEN line > 0 THEN (line - 1) // 4 + 1 END AS section,
           CASE WHEN line > 0 THEN array_to_string((regexp_extract_all(ls[((line - 1) // 4) * 4 + 2], '[^ \t\n\r]+'))[1:3], ' ') END AS heading,
           'wkb:' || project || ':' || page_id || ':' || revision_id
             || CASE WHEN line > 0 THEN ':' || ((line - 1) // 4 + 1) ELSE '' END
             || ':b' || CASE WHEN line = 0 THEN 0 ELSE (line - 1) % 4 END AS block_id
    FROM lines WHERE regexp_matches(ls[line + 1], '[^ \t\n\r]'))"""
)


def tokens_sql(expression: str) -> str:
    return rf"regexp_extract_all(lower({expression}), '[\p{{L}}\p{{N}}]+')"


def category_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, children, members): world, regions, nations; members are customers. AFRICA is administrative."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    name = F.concat(F.lit("Category:"), F.col("r_name"))
    nname = F.concat(F.lit("Category:"), F.col("n_name"))
    categories = (
        spark.createDataFrame([("Category:World", False)], "name string, administrative boolean")
        .unionByName(region.select(name.alias("name"), (F.col("r_name") == "AFRICA").alias("administrative")))
        .unionByName(nation.select(nname.alias("name"), F.lit(False).alias("administrative")))
    )
    children = region.select(F.lit("Category:World").alias("name"), name.alias("child")).unionByName(
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(name.alias("name"), nname.alias("child"))
    )
    members = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        nname.alias("name"), F.col("c_custkey").alias("page_id")
    )
    return categories, children, members


GRAPH = """categories AS (
    SELECT 'Category:World' AS name, false AS administrative
    UNION ALL SELECT 'Category:' || r_name, r_name = 'AFRICA' FROM region
    UNION ALL SELECT 'Category:' || n_name, false FROM nation),
children AS (
    SELECT 'Category:World' AS name, 'Category:' || r_name AS child FROM region
    UNION ALL SELECT 'Category:' || r_name, 'Category:' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
members AS (
    SELECT 'Category:' || n_name AS name, c_custkey AS page_id FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to six: each part leads to the next but for every seventh, which is an article."""
    key = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    last = part.agg(F.max("p_partkey").alias("last"))
    return part.crossJoin(F.broadcast(last)).where((key % 7 != 0) & (key < F.col("last"))).select(
        key.alias("from_id"), (key + 1).alias("to_id")
    )


REDIRECTS = """redirects AS (
    SELECT p_partkey AS from_id, p_partkey + 1 AS to_id FROM part
    WHERE p_partkey % 7 <> 0 AND p_partkey < (SELECT max(p_partkey) FROM part))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links: part to supplier (ids moved to negative keys of their own) and back to the supplier's next part."""
    lineitem = read(spark, sf_dir, "lineitem")
    out = lineitem.select((F.col("l_partkey") * 2).alias("from_id"), (F.col("l_suppkey") * 2 + 1).alias("to_id"))
    back = lineitem.where("l_linenumber = 1").select(
        (F.col("l_suppkey") * 2 + 1).alias("from_id"), (F.col("l_partkey") * 2).alias("to_id")
    )
    return out.unionByName(back).distinct()


LINKS = """links AS (
    SELECT l_partkey * 2 AS from_id, l_suppkey * 2 + 1 AS to_id FROM lineitem
    UNION SELECT l_suppkey * 2 + 1, l_partkey * 2 FROM lineitem WHERE l_linenumber = 1)"""


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(objects, owners) of media: parts as objects, order lines of some quantity as owners."""
    objects = read(spark, sf_dir, "part").select(
        F.sha2(F.col("p_partkey").cast("string"), 256).alias("digest"), F.col("p_size").cast("long").alias("bytes"), F.col("p_brand").alias("mime")
    )
    owners = read(spark, sf_dir, "lineitem").where("l_quantity >= 40").select(
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"),
        F.when(F.col("l_returnflag") == "R", "cache").when(F.col("l_returnflag") == "A", "pin").otherwise("pack").alias("kind"),
        F.col("l_suppkey").alias("owner_id"),
    ).distinct()
    return objects, owners


REGISTRY = """objects AS (
    SELECT sha256(p_partkey::varchar) AS digest, p_size::bigint AS bytes, p_brand AS mime FROM part),
owners AS (
    SELECT DISTINCT sha256(l_partkey::varchar) AS digest,
           CASE l_returnflag WHEN 'R' THEN 'cache' WHEN 'A' THEN 'pin' ELSE 'pack' END AS kind, l_suppkey AS owner_id
    FROM lineitem WHERE l_quantity >= 40)"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("user_id").alias("page_id"), F.col("ts").alias("visited_at"), "event_type", "value"
    )
