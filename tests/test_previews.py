"""Redirect identities, previews, back edges and reviewer lists: rules by code, and walks by hand."""

import hashlib
import random

import pytest

from lorekeep.errors import LorekeepError
from lorekeep.operators import previews, worklist

PAGES = "project string, generation string, page_id long, revision_id long, namespace int"
IDENTITIES = "project string, generation string, from_id long, to_id long"
HERE = ("p", "g")


def pages(spark, ids=(1, 2, 3, 4), other=(50,)):
    return spark.createDataFrame([(*HERE, i, i + 100, 0) for i in ids] + [(*HERE, i, i, 14) for i in other], PAGES)


def identities(spark, pairs):
    return spark.createDataFrame([(*HERE, *p) if len(p) == 2 else p for p in pairs], IDENTITIES)


def ids(spark, found):
    return spark.createDataFrame([(i,) for i in found], "page_id long")


def test_identities_end_at_pages(spark):
    chain = [(10 + i, 11 + i) for i in range(200)] + [(210, 3), (900, 205), (901, 1)]
    got = {r["from_id"]: (r["to_id"], r["hops"]) for r in previews.resolve_identities(identities(spark, chain), pages(spark, other=(5000,))).collect()}
    assert got[10] == (3, 201) and got[210] == (3, 1) and got[900] == (3, 7) and got[901] == (1, 1) and len(got) == 203
    assert previews.resolve_identities(identities(spark, []), pages(spark)).count() == 0


@pytest.mark.parametrize(
    ("pairs", "code", "first"),
    [
        ([(10, 1), ("q", "g", 11, 1)], "MixedSource", 11), ([(10, 1), (None, "g", 11, 1)], "MixedSource", 11), ([(10, 0)], "InvalidId", 10),
        ([(10, None)], "InvalidId", 10), ([(1, 2)], "ConflictsWithJoinedPage", 1), ([(50, 2)], "ConflictsWithJoinedPage", 50),
        ([(10, 1), (10, 2)], "DuplicateSource", 10), ([(10, 11), (11, 10), (9, 1)], "Cycle", 10), ([(12, 12), (9, 12)], "Cycle", 9),
        ([(10, 99)], "MissingMainspaceTarget", 10), ([(10, 50)], "MissingMainspaceTarget", 10),
    ],
)
def test_identity_rules(spark, pairs, code, first):
    with pytest.raises(LorekeepError) as e:
        previews.resolve_identities(identities(spark, pairs), pages(spark))
    assert (e.value.code, e.value.row["from_id"]) == (code, first)


def test_depth_of_identities(spark):
    whole = [(10_000 + i, 10_001 + i) for i in range(previews.MOST_HOPS - 1)] + [(10_000 + previews.MOST_HOPS - 1, 1)]
    assert previews.resolve_identities(identities(spark, whole), pages(spark)).agg({"hops": "max"}).head()[0] == previews.MOST_HOPS
    with pytest.raises(LorekeepError) as e:
        previews.resolve_identities(identities(spark, [*whole, (9_999, 10_000)]), pages(spark))
    assert (e.value.code, e.value.row["from_id"]) == ("TooDeep", 9_999)


def topic(spark, members, include=(), exclude=(), limit=100, depth=2, pairs=(), children=(("Root", "Leaf"), ("Root", "Office"), ("Leaf", "Root"))):
    return (
        pages(spark),
        spark.createDataFrame([("Root", False), ("Leaf", False), ("Office", True)], "name string, administrative boolean"),
        spark.createDataFrame(list(children), "name string, child string"),
        spark.createDataFrame(members, "name string, page_id long"),
        previews.Rules(["Root"], depth, limit, ids(spark, include), ids(spark, exclude)),
        identities(spark, pairs),
    )


MEMBERS = [("Root", 1), ("Root", 1), ("Leaf", 10), ("Office", 4)]
PAIRS = [(10, 11), (11, 2), (12, 3), (13, 2)]


def test_selection_follows_redirects(spark):
    args = topic(spark, MEMBERS, include=[12], pairs=PAIRS)
    assert sorted(tuple(r) for r in previews.select_pinned(*args)[1].collect()) == [(1, 101), (2, 102), (3, 103)]
    left_out = topic(spark, MEMBERS, include=[12, 11], exclude=[13], pairs=PAIRS)  # 13 ends at 2, as do 10 and 11
    assert sorted(r["page_id"] for r in previews.select_pinned(*left_out)[1].collect()) == [1, 3]
    summary, warnings = previews.preview(*left_out)
    assert summary.head().asDict() == {
        "selected": 2, "visited": 3, "administrative": 1, "article_mentions": 3, "child_mentions": 3, "included": 2, "excluded": 1,
        "largest": "Root", "largest_articles": 2,
    }
    assert sorted(tuple(r) for r in warnings.collect()) == [("cycle", "Root", "Leaf", 1), ("suppressed", "11", "2", None)]  # by name, Leaf is first


@pytest.mark.parametrize(
    ("kw", "code"),
    [
        ({"include": [77]}, "NotMainspace"), ({"exclude": [50]}, "NotMainspace"), ({"members": [("Leaf", 77)]}, "NotMainspace"), ({"limit": 1}, "TooManyPages"),
        ({"pairs": [(10, 10)]}, "Cycle"),
    ],
)
def test_selection_rules(spark, kw, code):
    with pytest.raises(LorekeepError) as e:
        previews.select_pinned(*topic(spark, **({"members": MEMBERS, "pairs": PAIRS} | kw)))
    assert e.value.code == code


def test_preview_warnings(spark):
    many = [("Leaf", 2)] * 600
    _, warnings = previews.preview(*topic(spark, many, limit=1, depth=1, children=[("Root", "Leaf")] * 130))
    assert sorted(tuple(r) for r in warnings.collect()) == [
        ("broad_articles", "Leaf", None, 600), ("broad_children", "Root", None, 130), ("near_limit", None, None, 1)
    ]


def test_related_keeps_out_what_is_left_out(spark):
    links = spark.createDataFrame([(1, 101, 2), (2, 102, 3), (1, 101, 4)], "from_id long, from_revision_id long, to_id long")
    args = topic(spark, [("Root", 1)], exclude=[13], pairs=PAIRS)  # 13 ends at 2: no way on to 3
    got = sorted((r["page_id"], r["revision_id"], r["hop"]) for r in previews.select_related(*args, links, 2).collect())
    assert got == [(1, 101, 0), (4, 104, 1)]
    with pytest.raises(LorekeepError, match="TooManyPages"):
        previews.select_related(*topic(spark, [("Root", 1)], pairs=PAIRS, limit=2), links, 2)
    with pytest.raises(LorekeepError, match="StaleLinkRevision"):
        previews.select_related(*args, links.withColumn("from_revision_id", links["from_revision_id"] + 1), 2)


def back_by_hand(edges):
    below = {}
    for a, b in sorted(set(edges)):
        below.setdefault(a, []).append(b)
    found, open_, done = [], [], set()

    def visit(node):
        open_.append(node)
        for child in below[node]:
            if child in open_:
                found.append((node, child))
            elif child in below and child not in done:
                visit(child)
        open_.pop()
        done.add(node)

    for root in sorted(below):
        if root not in done:
            visit(root)
    return found


def test_back_edges(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (12, 20), (30, 60), (8, 8), (5, 0)):
        edges = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
        want = back_by_hand(edges)
        found, more = previews.back_edges(spark.createDataFrame([*edges, ("n00", None)], "src string, dst string"))
        assert [(r["src"], r["dst"]) for r in found.orderBy("place").collect()] == want[:8]
        assert more == (len(want) > 8)


def test_reviewers_by_load(spark):
    rows = [(p, i, 7) for p in ("x", "y") for i in range(1, 12)]
    names = ["rev_b", "rev_a", "rev_c"]
    sources = spark.createDataFrame(rows, "project string, page_id long, revision_id long")
    receipt = worklist.roster_digest(sources.repartition(3))
    assert receipt == hashlib.sha256("\n".join(sorted(f"{p}:{i}:{r}" for p, i, r in rows)).encode()).hexdigest()
    got = {(r["project"], r["page_id"]): r for r in worklist.assign_reviewers(sources, names, receipt).collect()}
    for p in ("x", "y"):
        loads = dict.fromkeys(names, 0)
        for i in range(1, 12):
            order = sorted((loads[n], hashlib.sha256(f"{receipt}:{p}:{i}:7:{n}".encode()).hexdigest(), n) for n in names)
            pair = [n for *_, n in order[:2]]
            for n in pair:
                loads[n] += 1
            r = got[p, i]
            assert [r["first"], r["second"], r["first_load"], r["second_load"]] == [*pair, *(loads[n] for n in pair)]
        assert max(loads.values()) - min(loads.values()) <= 1
    assert worklist.assign_reviewers(sources.limit(0), names, receipt).count() == 0


@pytest.mark.parametrize(
    ("rows", "names", "code"),
    [
        ([("x", 1, 1)], ["a1"], "InvalidReviewers"), ([("x", 1, 1)], ["a1", "a1"], "InvalidReviewers"), ([("x", 1, 1)], ["a1", "1a"], "InvalidReviewers"),
        ([("x", 1, 1)], [f"r{i}" for i in range(33)], "InvalidReviewers"), ([("x", 1, 1), ("x", 1, 1)], ["a1", "a2"], "DuplicateSource"),
        ([(None, 1, 1)], ["a1", "a2"], "InvalidSource"), ([("x", i, 1) for i in range(worklist.MOST_SOURCES + 1)], ["a1", "a2"], "TooManySources"),
    ],
)
def test_reviewer_rules(spark, rows, names, code):
    with pytest.raises(LorekeepError) as e:
        worklist.assign_reviewers(spark.createDataFrame(rows, "project string, page_id long, revision_id long"), names, "d")
    assert e.value.code == code
