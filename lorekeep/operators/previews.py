"""Topic selections over pages of one generation, with redirect identities, and what a preview tells of them.

Pages are (project, generation, page_id, revision_id, namespace); redirect identities are
(project, generation, from_id, to_id). Both fail closed: the first record that breaks a
rule, in a total order, is raised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none
from lorekeep.lineage import save
from lorekeep.operators import graph

MOST_IDENTITIES = 1_000_000
MOST_HOPS = 4096
#: Back edges that are reported.
BACK_EDGES = 8
#: Edges among categories that reach a cycle; a depth-first order over more is refused.
MOST_CYCLIC_EDGES = 1_000_000
#: Mentions from which a category counts as broad, of children and of articles.
BROAD_CHILDREN, BROAD_ARTICLES = 128, 512


@dataclass(frozen=True)
class Rules:
    """What a topic takes: categories from ``roots`` down to ``depth_limit``, pages (page_id) put in or left out."""

    roots: list[str]
    depth_limit: int
    page_limit: int
    include: DataFrame
    exclude: DataFrame
    #: Redirects and links that are accepted at all; None for any number.
    most_identities: int | None = MOST_IDENTITIES
    most_links: int | None = graph.MOST_LINKS


def _source(pages: DataFrame) -> tuple[str, str]:
    sources = pages.select("project", "generation").distinct().limit(2).collect()
    if len(sources) != 1:
        raise LorekeepError("MixedSource" if sources else "NoPages")
    return sources[0]["project"], sources[0]["generation"]


def _mainspace(pages: DataFrame) -> DataFrame:
    return pages.where("namespace = 0").select("page_id", "revision_id")


def resolve_identities(identities: DataFrame, pages: DataFrame, most: int | None = MOST_IDENTITIES) -> DataFrame:
    """(from_id, to_id, hops): the mainspace page at which each redirect ends, of all redirects, used or not.

    Codes, in the order they are looked for: TooMany (over ``most``), MixedSource, InvalidId,
    ConflictsWithJoinedPage (a page of the generation redirects), DuplicateSource, Cycle (the
    smallest id that never ends), TooDeep (over 4096 hops), MissingMainspaceTarget. Each round
    of pointer jumping doubles the distance, so as many rounds as the number of redirects has
    binary digits end all chains; what moves on then is a cycle.
    """
    n = identities.count()
    if most is not None and n > most:
        raise LorekeepError("TooMany")
    project, generation = _source(pages)
    here = F.col("project").eqNullSafe(F.lit(project)) & F.col("generation").eqNullSafe(F.lit(generation))
    assert_none(identities.where(~here), "MixedSource", "from_id", "to_id")
    assert_none(identities.where("not coalesce(from_id > 0 and to_id > 0, false)"), "InvalidId", "from_id", "to_id")
    joined = pages.select(F.col("page_id").alias("from_id"))
    assert_none(identities.join(joined, "from_id", "left_semi"), "ConflictsWithJoinedPage", "from_id")
    assert_none(identities.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DuplicateSource", "from_id")

    at = save(identities.select("from_id", "to_id", F.lit(1).cast("long").alias("hops"), F.lit(True).alias("moving")), "identities")
    for _ in range(math.ceil(math.log2(max(n, 1))) + 1):
        step = at.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"), F.col("hops").alias("more"))
        at = save(
            at.join(step, "to_id", "left").select(
                "from_id", F.coalesce("next", "to_id").alias("to_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.col("next").isNotNull().alias("moving"),
            ),
            "identities",
        )
        if not at.where("moving").head(1):
            break
    assert_none(at.where("moving").select("from_id"), "Cycle", "from_id")
    assert_none(at.where(F.col("hops") > MOST_HOPS).select("from_id", "hops"), "TooDeep", "from_id")
    ends = at.join(_mainspace(pages), F.col("to_id") == F.col("page_id"), "left_anti")
    assert_none(ends.select("from_id", "to_id"), "MissingMainspaceTarget", "from_id")
    return at.select("from_id", "to_id", "hops")


def _canonical(ids: DataFrame, resolved: DataFrame) -> DataFrame:
    """(asked, page_id): distinct ids and where they end."""
    asked = ids.select(F.col("page_id").alias("asked")).distinct()
    return asked.join(resolved, asked["asked"] == resolved["from_id"], "left").select(
        "asked", F.coalesce("to_id", "asked").alias("page_id")
    )


def select_pinned(
    pages: DataFrame, categories: DataFrame, children: DataFrame, members: DataFrame, rules: Rules, identities: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(visited categories, selected pages with their revisions, resolved redirects) of a topic.

    Pages of categories, those put in and those left out are followed through redirects;
    leaving out wins. Codes beside those of ``resolve_identities``: NotMainspace for an id of
    the rules or of a selected category that is no mainspace page and no redirect,
    MissingCategory, TooManyPages.
    """
    mainspace = _mainspace(pages)
    resolved = save(resolve_identities(identities, pages, rules.most_identities), "resolved")
    known = mainspace.select("page_id").unionByName(resolved.select(F.col("from_id").alias("page_id")))
    named = rules.include.select("page_id").unionByName(rules.exclude.select("page_id"))
    assert_none(named.join(known, "page_id", "left_anti"), "NotMainspace", "page_id")
    visited, selected = graph.select_topic(
        categories, children, members, rules.roots, rules.depth_limit, rules.page_limit,
        exclude=_canonical(rules.exclude, resolved), include=rules.include, canonical=resolved,
    )
    pinned = save(selected.join(mainspace, "page_id", "left"), "pinned")
    assert_none(pinned.where("revision_id is null").select("page_id"), "NotMainspace", "page_id")
    return visited, pinned, resolved


def select_related(
    pages: DataFrame, categories: DataFrame, children: DataFrame, members: DataFrame, rules: Rules, identities: DataFrame,
    links: DataFrame, hops: int, max_new_pages: int | None = None, max_edges: int | None = None,
) -> DataFrame:
    """(page_id, revision_id, hop): the selection and what is within ``hops`` links of it.

    Links are (from_id, from_revision_id, to_id). Pages left out, wherever their redirects
    end, are neither reached nor passed; the page limit holds for the whole.
    """
    _, pinned, resolved = select_pinned(pages, categories, children, members, rules, identities)
    out = _canonical(rules.exclude, resolved)
    reached = save(graph.expand_verified(pinned, _mainspace(pages), links, hops, out, max_new_pages, max_edges, rules.most_links), "related-preview")
    if reached.limit(rules.page_limit + 1).count() > rules.page_limit:
        raise LorekeepError("TooManyPages")
    return reached


def back_edges(edges: DataFrame, most: int = BACK_EDGES) -> tuple[DataFrame, bool]:
    """((place, src, dst), whether there are more): edges (src, dst) to a node that is still open in a depth-first walk.

    The walk starts from each node that has edges, by name, and takes children by name; nodes
    without edges of their own are left aside. Nodes that reach no cycle can't hold such an
    edge or change the walk among the others, so they are taken away first, layer by layer,
    in Spark. Only what reaches a cycle goes through one task, as a depth-first order is
    a sequence: at most MOST_CYCLIC_EDGES edges, more are refused with TooManyCyclicEdges.
    """
    left = save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "cyclic")
    n = left.count()
    while n:
        kept = save(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "cyclic")
        n, before, left = kept.count(), n, kept
        if n == before:
            break
    if n > MOST_CYCLIC_EDGES:
        raise LorekeepError("TooManyCyclicEdges")

    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        below = {src: sorted(rows) for src, rows in batch.groupby("src")["dst"]}
        state, found = dict.fromkeys(below, "new"), []
        for root in sorted(below):
            trail: list[tuple[str, Iterator[str]]] = []
            if state[root] == "new":
                state[root] = "open"
                trail.append((root, iter(below[root])))
            while trail and len(found) <= most:
                node, rest = trail[-1]
                child = next(rest, None)
                if child is None:
                    state[node] = "done"
                    trail.pop()
                elif state[child] == "open":
                    found.append((len(found) + 1, node, child))
                elif state[child] == "new":
                    state[child] = "open"
                    trail.append((child, iter(below[child])))
        return pd.DataFrame(found, columns=["place", "src", "dst"])

    found = save(left.groupBy().applyInPandas(walk, "place int, src string, dst string"), "back-edges")
    return found.where(F.col("place") <= most), bool(found.where(F.col("place") > most).head(1))


def preview(
    pages: DataFrame, categories: DataFrame, children: DataFrame, members: DataFrame, rules: Rules, identities: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(one row of counts, warnings): what a topic would select, before anything is fetched.

    Counts are of mentions as the categories have them, repeats included, before redirects and
    leaving out; administrative categories are counted and not entered; children are counted
    where they may still be entered. ``largest`` has most article mentions, ties to the first by name.
    Warnings are (kind, subject, object, n): ``suppressed`` for a page put in whose end is left out, ``broad_children``,
    ``broad_articles``, ``cycle`` for each of the first back edges in their order ``n``, ``more_cycles``, ``near_limit``.
    """
    visited, pinned, resolved = select_pinned(pages, categories, children, members, rules, identities)
    spark, limit = pages.sparkSession, rules.page_limit
    entered = visited.where("not administrative").select("name", "depth")
    inner = entered.where(F.col("depth") < rules.depth_limit).select("name")
    articles = entered.join(members, "name", "left").groupBy("name").agg(F.count("page_id").alias("n"))
    below = children.join(inner, "name")
    fan = save(articles, "fan-out")
    totals = fan.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("article_mentions"),
        F.min(F.struct((-F.col("n")).alias("less"), "name")).alias("first"),
    ).select("article_mentions", F.col("first.name").alias("largest"), (-F.col("first.less")).alias("largest_articles"))
    named = [ids.select(F.countDistinct("page_id").alias(n)) for ids, n in ((rules.include, "included"), (rules.exclude, "excluded"))]
    counts = [
        pinned.agg(F.count(F.lit(1)).alias("selected")),
        visited.agg(
            F.count(F.lit(1)).alias("visited"),
            F.coalesce(F.sum(F.col("administrative").cast("long")), F.lit(0)).alias("administrative"),
        ),
        below.agg(F.count(F.lit(1)).alias("child_mentions")),
        totals,
        *named,
    ]
    found = {k: v for c in counts for k, v in c.head().asDict().items()}  # one row each
    order = ["selected", "visited", "administrative", "article_mentions", "child_mentions", "included", "excluded", "largest", "largest_articles"]
    kinds = ", ".join(f"{k} {'string' if k == 'largest' else 'long'}" for k in order)
    summary = spark.createDataFrame([tuple(found[k] for k in order)], kinds)

    none = F.lit(None).cast("string")
    suppressed = _canonical(rules.include, resolved).join(pinned, "page_id", "left_anti").select(
        F.lit("suppressed").alias("kind"), F.col("asked").cast("string").alias("subject"),
        F.col("page_id").cast("string").alias("object"), F.lit(None).cast("long").alias("n"),
    )
    wide = below.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BROAD_CHILDREN)
    most = fan.where((F.col("n") >= BROAD_ARTICLES) & (F.col("n") >= -(-limit // 2)) & (F.col("name") == F.lit(found["largest"])))
    edges = below.select(F.col("name").alias("src"), F.col("child").alias("dst"))
    back, more = back_edges(edges)
    n = found["selected"]
    flags = [("more_cycles", None, None, None)] * more
    if n == limit or (n >= 10 and n >= max(0, limit - limit // 10)):
        flags.append(("near_limit", None, None, n))
    warnings = suppressed
    for part in (
        wide.select(F.lit("broad_children").alias("kind"), F.col("name").alias("subject"), none.alias("object"), "n"),
        most.select(F.lit("broad_articles").alias("kind"), F.col("name").alias("subject"), none.alias("object"), "n"),
        back.select(F.lit("cycle").alias("kind"), F.col("src").alias("subject"), F.col("dst").alias("object"), F.col("place").cast("long").alias("n")),
        spark.createDataFrame(flags, "kind string, subject string, object string, n long"),
    ):
        warnings = warnings.unionByName(part)
    return summary, warnings
