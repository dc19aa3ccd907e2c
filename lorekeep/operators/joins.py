"""Exact-identity joins that fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none
from lorekeep.functions import text as T
from lorekeep.lineage import save
from lorekeep.operators.audit import duplicates

IDENTITY = ["project", "page_id"]


def join_components(structured: DataFrame, rendered: DataFrame, categories: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Three components of each page, of one revision and generation; any gap or conflict is an error.

    Each input has project, page_id, revision_id, generation_id, payload; a payload
    is empty only for categories. ``tombstones`` (project, page_id, generation_id)
    are pages that must not be live. The first broken rule, at its first page, is raised.

    The sides meet in one aggregation by page, which is saved with the number of the
    first rule that each page breaks; only pages' names and numbers are read for the check.
    """
    sides = {"s": structured, "r": rendered, "c": categories}
    every = None
    for k, side in sides.items():
        rows = side.select(*IDENTITY, "revision_id", "generation_id", "payload", F.lit(k).alias("side"))
        every = rows if every is None else every.unionByName(rows)

    def of(k: str, c: str) -> Column:
        return F.first(F.when(F.col("side") == k, F.col(c)), ignorenulls=True).alias(f"{k}_{c}")

    valid = F.coalesce(T.valid_article_key("project", "page_id"), F.lit(False))
    pages = every.groupBy(*IDENTITY).agg(
        *(of(k, c) for k in sides for c in ("revision_id", "generation_id", "payload")),
        *(F.sum((F.col("side") == k).cast("long")).alias(f"n_{k}") for k in sides),
        *(F.max(((F.col("side") == k) & F.coalesce(F.col("payload") == "", F.lit(True))).cast("int")).alias(f"empty_{k}") for k in ("s", "r")),
        F.min(valid).alias("valid"),
    )
    one = structured.agg(F.min("project").alias("p"), F.min("generation_id").alias("g")).head()
    if tombstones is not None:
        dead = tombstones.select(*IDENTITY, F.col("generation_id").alias("s_generation_id"), F.lit(True).alias("dead")).distinct()
        pages = pages.join(dead, [*IDENTITY, "s_generation_id"], "left")
    else:
        pages = pages.withColumn("dead", F.lit(None).cast("boolean"))
    there = {k: F.col(f"n_{k}") > 0 for k in sides}
    rules = []
    for k in sides:
        rules.append((there[k] & ~F.col("valid"), "InvalidIdentity"))
        if k != "c":
            rules.append((F.col(f"empty_{k}") == 1, "EmptyPayload"))
        rules.append((F.col(f"n_{k}") > 1, "DuplicatePage"))
    rules += [
        (there["s"] & (F.col("project") != F.lit(one["p"])), "MixedProject"),
        (F.col("s_generation_id") != F.lit(one["g"]), "GenerationMismatch"),
        (F.lit(False), "DuplicateRevision"),
        (~(there["s"] & there["r"] & there["c"]), "MissingComponent"),
        ((F.col("s_revision_id") != F.col("r_revision_id")) | (F.col("s_revision_id") != F.col("c_revision_id")), "RevisionMismatch"),
        ((F.col("s_generation_id") != F.col("r_generation_id")) | (F.col("s_generation_id") != F.col("c_generation_id")), "GenerationMismatch"),
        (F.col("dead"), "LiveTombstone"),
    ]
    broken = F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(n)) for n, (rule, _) in enumerate(rules)))
    checked = save(pages.withColumn("broken", broken), "components")
    found = checked.agg(F.min(F.when(F.col("broken").isNotNull(), F.struct("broken", *IDENTITY)))).head()[0]
    revision_rule = next(n for n, (_, code) in enumerate(rules) if code == "DuplicateRevision")
    if found is None or found["broken"] > revision_rule:
        twice = checked.where("n_s > 0").select("project", F.col("s_revision_id").alias("revision_id"))
        assert_none(duplicates(twice, ["project", "revision_id"]), "DuplicateRevision", "project", "revision_id")
    if found is not None:
        raise LorekeepError(rules[found["broken"]][1], found.asDict())
    return checked.select(
        *IDENTITY, F.col("s_revision_id").alias("revision_id"), F.col("s_payload").alias("structured"),
        F.col("r_payload").alias("rendered"), F.col("c_payload").alias("categories"),
    )


PAIR_FIELDS = ("name", "revision_id", "date_modified", "generation_id", "namespace", "language")


def pair_mismatches(structured: DataFrame, regular: DataFrame) -> DataFrame:
    """The first field, in order of precedence, in which a page's two records differ; ``Missing`` without one of them."""
    s = structured.select(*IDENTITY, *(F.col(c).alias(f"s_{c}") for c in PAIR_FIELDS), F.lit(True).alias("in_s"))
    r = regular.select(*IDENTITY, *(F.col(c).alias(f"r_{c}") for c in PAIR_FIELDS), F.lit(True).alias("in_r"))
    case = F.when(F.col("in_s").isNull() | F.col("in_r").isNull(), "Missing")
    for c in PAIR_FIELDS:
        case = case.when(~F.col(f"s_{c}").eqNullSafe(F.col(f"r_{c}")), c)
    return s.join(r, IDENTITY, "full_outer").select(*IDENTITY, case.alias("mismatch")).where("mismatch is not null")


def resolve_links(links: DataFrame, titles: DataFrame) -> DataFrame:
    """Links with the page their decoded title key names; an unresolved link is an error."""
    keyed = links.withColumn("key", T.title_key(T.decode_title("target")))
    index = titles.select("project", T.title_key("title").alias("key"), F.col("page_id").alias("to_id")).distinct()
    found = keyed.join(index, ["project", "key"], "left")
    assert_none(found.where("to_id is null"), "UnresolvedLink", "project", "target")
    return found.drop("key")


def title_index(titles: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row a lookup key: (project, key, page_id, is_alias); titles win over aliases of the same page.

    Keys that name several pages are conflicts and are returned by ``title_conflicts``.
    """
    every = titles.select("project", T.title_key("title").alias("key"), "page_id", F.lit(False).alias("is_alias")).unionByName(
        aliases.select("project", T.title_key("alias").alias("key"), "page_id", F.lit(True).alias("is_alias"))
    )
    return every.groupBy("project", "key", "page_id").agg(F.min("is_alias").alias("is_alias"))


def title_conflicts(index: DataFrame) -> DataFrame:
    return index.groupBy("project", "key").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")
