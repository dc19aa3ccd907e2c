"""Two independent reviewers for each sampled source, by load and a seeded order."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError, assert_none

MOST_SOURCES = 10_000
# How many reviewers a list may have, and how their names look.
FEWEST_REVIEWERS, MOST_REVIEWERS = 2, 32
REVIEWER = re.compile(r"[A-Za-z][A-Za-z0-9_-]{1,63}")


def roster_digest(sources: DataFrame) -> str:
    """SHA-256 of the sources' identities as sorted lines; at most MOST_SOURCES of them, or TooManySources."""
    if sources.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise LorekeepError("TooManySources")
    line = F.concat_ws(":", "project", "page_id", "revision_id")
    return sources.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d")).head()["d"]


def assign_reviewers(sources: DataFrame, reviewers: list[str], receipt: str) -> DataFrame:
    """(project, page_id, revision_id, first, second, first_load, second_load) for each source.

    Sources of a project go in order of page and revision. Each takes the two reviewers of the least
    load in the project so far; equal loads go by SHA-256 of receipt, source and reviewer, then by name.
    A source's loads are those with it. Loads carry over from source to source, so a project is
    a sequence: one group of at most MOST_SOURCES rows over all projects, which is checked.

    Codes: InvalidReviewers, TooManySources, InvalidSource (a null key), DuplicateSource.
    """
    sound = all(isinstance(r, str) and REVIEWER.fullmatch(r) for r in reviewers)
    if not sound or not FEWEST_REVIEWERS <= len(reviewers) <= MOST_REVIEWERS or len(set(reviewers)) < len(reviewers):
        raise LorekeepError("InvalidReviewers")
    key = ["project", "page_id", "revision_id"]
    if sources.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise LorekeepError("TooManySources")
    assert_none(sources.where("project is null or page_id is null or revision_id is null").select(*key), "InvalidSource", *key)
    assert_none(sources.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DuplicateSource", *key)

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        loads, out = dict.fromkeys(reviewers, 0), []
        for project, page, revision in rows.sort_values(["page_id", "revision_id"])[key].itertuples(index=False):
            digest = {r: hashlib.sha256(f"{receipt}:{project}:{page}:{revision}:{r}".encode()).digest() for r in reviewers}
            pair = sorted(reviewers, key=lambda r: (loads[r], digest[r], r))[:2]
            for r in pair:
                loads[r] += 1
            out.append((project, page, revision, *pair, *(loads[r] for r in pair)))
        return pd.DataFrame(out, columns=[*key, "first", "second", "first_load", "second_load"])

    return sources.select("project", F.col("page_id").cast("long"), F.col("revision_id").cast("long")).groupBy("project").applyInPandas(
        assign, "project string, page_id long, revision_id long, first string, second string, first_load long, second_load long"
    )
