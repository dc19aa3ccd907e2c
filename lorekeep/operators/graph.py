"""Graph operators: redirects, topic selection, related pages. Frontier loops over DataFrames."""

from __future__ import annotations

from itertools import count

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none
from lorekeep.lineage import save

MOST_HOPS = 4096


def resolve_redirects(redirects: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(from_id, to_id, hops): where each redirect ends, by pointer jumping.

    Each round doubles the distance covered, so chains of ``most`` need its
    logarithm of rounds. What still moves then is a cycle or too deep.
    """
    at = save(redirects.select("from_id", "to_id", F.lit(1).cast("long").alias("hops")), "redirects")
    for _ in range(math.ceil(math.log2(most)) + 1):
        step = at.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"), F.col("hops").alias("more"))
        at = save(
            at.join(step, "to_id", "left").select(
                "from_id", F.coalesce("next", "to_id").alias("to_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.col("next").isNotNull().alias("moving"),
            ),
            "redirects",
        )
        if not at.where("moving").head(1):
            return at.select("from_id", "to_id", "hops")
        at = at.select("from_id", "to_id", "hops")
    raise LorekeepError("RedirectCycleOrTooDeep", redirects.join(at, "from_id").orderBy("from_id").head().asDict())


def select_topic(
    categories: DataFrame, children: DataFrame, members: DataFrame, roots: list[str],
    depth_limit: int, page_limit: int | None = None, exclude: DataFrame | None = None,
    include: DataFrame | None = None, canonical: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first topic selection: (visited categories with depth, selected pages).

    Administrative categories are not entered. Pages are canonicalised through
    ``canonical`` (from_id, to_id); exclusion wins over inclusion.
    """
    spark = categories.sparkSession
    start = spark.createDataFrame([(r,) for r in roots], "name string").distinct()
    assert_none(start.join(categories, "name", "left_anti"), "MissingCategory", "name")
    frontier = start.withColumn("depth", F.lit(0))
    visited = save(frontier.join(categories, "name"), "topic")
    frontier = visited.where("not administrative")
    for depth in range(1, min(depth_limit, 100) + 1):
        found = (
            children.join(frontier.select("name"), "name").select(F.col("child").alias("name")).distinct()
            .join(visited.select("name"), "name", "left_anti")
            .join(categories, "name")
            .select("name", F.lit(depth).alias("depth"), "administrative")
        )
        found = save(found, "topic")
        if not found.head(1):
            break
        visited = save(visited.unionByName(found), "topic")
        frontier = found.where("not administrative")
    pages = members.join(visited.where("not administrative").select("name"), "name").select("page_id")
    if include is not None:
        pages = pages.unionByName(include.select("page_id"))
    if canonical is not None:
        moved = canonical.select(F.col("from_id").alias("page_id"), F.col("to_id").alias("at"))
        pages = pages.join(moved, "page_id", "left").select(F.coalesce("at", "page_id").alias("page_id"))
    pages = pages.distinct()
    if exclude is not None:
        pages = pages.join(exclude.select("page_id").distinct(), "page_id", "left_anti")
    if page_limit is not None and pages.limit(page_limit + 1).count() > page_limit:
        raise LorekeepError("TooManyPages")
    return visited, pages


def fan_out(members: DataFrame, children: DataFrame) -> DataFrame:
    """Articles and children of each category, and its place by their number: most first, then by name."""
    own = members.groupBy("name").agg(F.countDistinct("page_id").alias("articles"))
    below = children.groupBy("name").agg(F.countDistinct("child").alias("children"))
    return own.join(below, "name", "full_outer").select(
        "name", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("children", F.lit(0)).alias("children")
    )


def seed_coverage(seeds: DataFrame) -> DataFrame:
    """One row: selections of all seeds (seed, page_id), their union, and what they share."""
    return seeds.distinct().agg(F.count(F.lit(1)).alias("selected"), F.countDistinct("page_id").alias("covered")).select(
        "selected", "covered", (F.col("selected") - F.col("covered")).alias("overlap")
    )


def related(
    links: DataFrame, seeds: DataFrame, hops: int, exclude: DataFrame | None = None,
    max_new_pages: int | None = None, max_edges: int | None = None,
) -> DataFrame:
    """(page_id, hop) within ``hops`` links of the seeds; excluded pages are neither selected nor passed."""
    if not 0 <= hops <= 8:
        raise LorekeepError("InvalidHops")

    def allowed(pages: DataFrame) -> DataFrame:
        return pages if exclude is None else pages.join(exclude.select("page_id").distinct(), "page_id", "left_anti")

    selected = save(allowed(seeds.select("page_id").distinct()).withColumn("hop", F.lit(0)), "related")
    n_seeds, edges, frontier = selected.count(), 0, selected
    for hop in range(1, hops + 1):
        out = links.join(frontier.select(F.col("page_id").alias("from_id")), "from_id")
        if max_edges is not None:
            edges += out.count()
            if edges > max_edges:
                raise LorekeepError("TooManyEdges")
        reached = allowed(out.select(F.col("to_id").alias("page_id")).distinct())
        frontier = save(reached.join(selected.select("page_id"), "page_id", "left_anti").withColumn("hop", F.lit(hop)), "related")
        if not frontier.head(1):
            break
        selected = save(selected.unionByName(frontier), "related")
        if max_new_pages is not None and selected.count() - n_seeds > max_new_pages:
            raise LorekeepError("TooManyPages")
    return selected


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Everything reachable over (src, dst) from ``roots`` (node), cycles allowed: (node)."""
    seen = save(roots.select("node").distinct(), "closure")
    frontier = seen
    while True:
        new = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = save(new.join(seen, "node", "left_anti"), "closure")
        if not frontier.head(1):
            return seen
        seen = save(seen.unionByName(frontier), "closure")


def ranked_sample(rows: DataFrame, seed: int, by: list[str], floor: int) -> DataFrame:
    """The first ``floor`` of each group in an order by SHA-256 of seed and identity, and the order."""
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), "project", "page_id", "revision_id"), 256)
    w = Window.partitionBy(*by).orderBy("rank", "page_id", "revision_id")
    return rows.withColumn("rank", rank).withColumn("place", F.row_number().over(w)).where(F.col("place") <= floor)


def greedy_cover(candidates: DataFrame, by: str, seed: int, most_rounds: int | None = None) -> DataFrame:
    """Pages chosen until each group's strata are covered: (by, page_id, revision_id, round).

    ``candidates`` has ``by``, project, page_id, revision_id, strata. Each round takes
    from each group the page that adds most missing strata, ties by the seed's
    SHA-256, page and revision: a pre-aggregated minimum, never a group in one task.
    The number of rounds is at most that of strata; more than ``most_rounds`` are an error.
    """
    rank = F.sha2(F.concat_ws(":", F.lit(str(seed)), "project", "page_id", "revision_id"), 256)
    ranked = save(candidates.select(by, "page_id", "revision_id", "strata", rank.alias("rank")), "cover")
    missing = save(ranked.select(by, F.explode("strata").alias("s")).groupBy(by).agg(F.collect_set("s").alias("missing")), "cover")
    chosen = None
    for n in count(1):
        gain = F.size(F.array_intersect("strata", "missing"))
        best = (
            ranked.join(missing, by).where(gain > 0).groupBy(by)
            .agg(F.min(F.struct((-gain).alias("loss"), "rank", "page_id", "revision_id", "strata")).alias("b"))
            .select(by, "b.page_id", "b.revision_id", "b.strata", F.lit(n).alias("round"))
        )
        best = save(best, "cover")
        if not best.head(1):
            break
        if most_rounds is not None and n > most_rounds:
            raise LorekeepError("TooManyRounds")
        picked = best.drop("strata")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        if n % 32 == 0:
            chosen = save(chosen, "cover")
        left = missing.join(best.select(by, "strata"), by, "left")
        left = left.select(by, F.array_except("missing", F.coalesce("strata", F.array().cast("array<string>"))).alias("missing"))
        missing = save(left.where(F.size("missing") > 0), "cover")
    return chosen if chosen is not None else ranked.select(by, "page_id", "revision_id", F.lit(0).alias("round")).limit(0)


MOST_LINKS = 1_000_000


def expand_verified(
    base: DataFrame, mainspace: DataFrame, links: DataFrame, hops: int,
    exclude: DataFrame | None = None, max_new_pages: int | None = None, max_edges: int | None = None,
    most_links: int | None = MOST_LINKS,
) -> DataFrame:
    """(page_id, revision_id, hop): ``related`` over links that belong to the revisions at hand.

    ``base`` and ``mainspace`` have page_id and revision_id, ``links`` from_id, from_revision_id and
    to_id. A base page at another revision, a link from or to no mainspace page, or from an old
    revision, reached or not, is an error.
    """
    here = mainspace.select("page_id", F.col("revision_id").alias("now"))
    off = base.join(here, "page_id", "left").where("now is null or now <> revision_id")
    assert_none(off, "InconsistentBase", "page_id")
    if most_links is not None and links.limit(most_links + 1).count() > most_links:
        raise LorekeepError("TooManyCandidates")
    ends = links.select(F.col("from_id").alias("page_id")).unionByName(links.select(F.col("to_id").alias("page_id"))).distinct()
    assert_none(ends.join(here, "page_id", "left_anti"), "NotMainspace", "page_id")
    stale = links.join(here, links["from_id"] == here["page_id"]).where("now <> from_revision_id").select("from_id")
    assert_none(stale, "StaleLinkRevision", "from_id")
    reached = related(links.select("from_id", "to_id"), base, hops, exclude, max_new_pages, max_edges)
    return reached.join(mainspace.select("page_id", "revision_id"), "page_id").select("page_id", "revision_id", "hop")


def receipt(pages: DataFrame, label: str, buckets: int = 4096) -> DataFrame:
    """One row: pages, and a digest of (page_id, revision_id) whatever their order.

    Pages are digested in buckets by id, and the buckets' digests in order, so that no task holds all.
    """
    eight = F.lpad(F.hex("page_id"), 16, "0"), F.lpad(F.hex("revision_id"), 16, "0")
    rows = pages.distinct().select(F.pmod(F.xxhash64("page_id"), F.lit(buckets)).alias("bucket"), F.concat(*eight).alias("row"))
    parts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("row")), ""), 256).alias("d"))
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda p: p["d"]), "")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.sha2(F.concat(F.lit(label), every), 256).alias("digest"))
