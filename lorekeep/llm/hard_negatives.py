"""Hard negatives by one-dimensional distance keys.

A vector gets one coordinate more that brings all to one length; the larger an inner
product with an anchor, the nearer the two then are. Each vector is stored under its
nearest pivot, sorted by its distance from that pivot, in pages of neighbouring
distances. By the triangle inequality a page whose distances lie between ``low`` and
``high`` holds nothing nearer to an anchor than ``low - d`` or ``d - high``, with d
the anchor's distance from the pivot, and nothing farther than ``d + high``.

An anchor scans the pages that its radius reaches, within the annulus that it is
asked for. Radii grow from round to round until no page beyond can hold anything
better than what was found; an anchor that has all it needs sets its last radius by
the distance of the worst of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import save
from lorekeep.llm.vector_codes import usable, whole

POSITIVES = 5
NEGATIVES = 10
#: Negatives score between these percentages of the positive's score.
LOW, HIGH = 30, 90
#: Integer components are held within this: inner products of up to 4096 components stay exact in double precision.
REACH = 1 << 20
#: Pivots, the farthest from each other of a sample of this many vectors, those with the least hash of their id.
PIVOTS = 16
SAMPLE = 2048
#: Distances are cut into so many bins up to the length of the longest vector.
BINS = 32
#: The first radius goes beyond the annulus' inner edge by this share of the longest vector; steps then grow fourfold.
FIRST = 0.25
#: Rows of a page, about, and anchors that meet a page together.
PAGE = 2048
TOGETHER = 256

HITS = "anchor long, need int, vec_id long, score long"
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pivots_of(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows of ``sample``, each the farthest from those before."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).astype(np.float64).reshape(len(col), dim)


def _augmented(v: np.ndarray, length: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(length**2 - (v * v).sum(axis=1), 0.0))])


def _from_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T, 0.0))


class Index:
    """The rows sorted by (pivot, distance) and cut into pages: a bin of distances, or a part of one that holds many rows.

    ``directory`` has one row for each page, with its least and greatest distance.
    """

    def __init__(self, rows: DataFrame, dim: int) -> None:
        """``rows`` has (vec_id, label, v, is_anchor)."""
        self.dim, n = dim, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c)
        self.length = float(rows.agg(F.max(square)).head()[0]) ** 0.5
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").select("v").limit(SAMPLE).collect()
        length, pivots = self.length, pivots_of(_augmented(np.array([r["v"] for r in sample], dtype=np.float64), self.length), PIVOTS)
        self.pivots, self.width = pivots, max(length / BINS, 1.0)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _from_pivots(_augmented(_matrix(b.column("v"), dim), length), pivots)
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(d)), at])], names=[*b.schema.names, "pivot", "distance"]
                    )

        keyed = rows.mapInArrow(key, "vec_id long, label long, v array<int>, is_anchor boolean, pivot int, distance double")
        order = ["pivot", "distance", "vec_id", "label"]
        stored = save(
            keyed.withColumn("bin", F.floor(F.col("distance") / self.width).cast("int")).repartitionByRange(n, *order).sortWithinPartitions(*order),
            "distance-keys",
        )
        cells = stored.groupBy("pivot", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("asking")).orderBy("pivot", "bin").collect()
        told, group, held = [], 0, 0
        for number, c in enumerate(cells):  # PIVOTS times twice BINS rows at most: neighbouring cells with few anchors share a chunk
            if held + c["asking"] > TOGETHER:
                group, held = group + 1, 0
            held += c["asking"]
            told.append((c["pivot"], c["bin"], number << 32, -(-c["n"] // PAGE), group << 32, max(1, -(-c["asking"] // TOGETHER))))
        cells = F.broadcast(rows.sparkSession.createDataFrame(told, "pivot int, bin int, first_page long, pages long, first_chunk long, chunks long"))
        part = F.xxhash64("vec_id")
        self.stored = stored.join(cells, ["pivot", "bin"]).select(
            "vec_id", "label", "v", "is_anchor", "pivot", "bin", "distance",
            (F.col("first_page") + F.pmod(part, F.col("pages"))).alias("page"),
            (F.col("first_chunk") + F.pmod(part, F.col("chunks"))).alias("chunk"),
        )
        self.directory = save(
            self.stored.groupBy("pivot", "bin", "page").agg(F.min("distance").alias("low"), F.max("distance").alias("high")), "distance-directory"
        )

    def anchors(self) -> DataFrame:
        """The rows that are anchors: anchor (a number for each), anchor_id, own (label), v, chunk (those stored close together)."""
        found = self.stored.where("is_anchor").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), "v", "chunk")
        return save(found.withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def search(self, anchors: DataFrame, k: int, alike: bool) -> DataFrame:
        """(anchor, need, vec_id, score, rank): the ``k`` best of each need.

        ``anchors`` has (anchor, anchor_id, own, v, chunk, needs), the last an array of structs (need, low, high): the
        range of scores asked for, null where open. ``alike`` says whether rows of the anchor's own label are meant, or
        all others. Rows of the anchor's own id are never found.
        """
        dim, length, pivots, width = self.dim, self.length, self.pivots, self.width
        slack = 1e-6 * (length + 1.0)
        farthest = 2.0 * length + 2 * slack
        square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c)
        base = F.col("square") + length**2
        to_distance = lambda score: F.when(score.isNotNull(), F.sqrt(F.greatest(base - 2 * score, F.lit(0.0))))
        ends = lambda x: F.coalesce(to_distance(x["low"]) + slack, F.lit(farthest))
        begins = lambda x: F.greatest(to_distance(x["high"]) - slack, F.lit(0.0))
        state = anchors.where(F.size("needs") > 0).withColumn("square", square).select(
            "*",
            F.array_min(F.transform("needs", begins)).alias("inner"),
            F.array_max(F.transform("needs", ends)).alias("outer"),
            F.lit(-1.0).alias("done"),
        )
        state = save(state.withColumn("radius", F.least("outer", F.col("inner") + FIRST * length)), "anchor-rounds")

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each pivot, the bins that an anchor's radius reaches and that it had not passed before."""
            for b in batches:
                if not b.num_rows:
                    continue
                v = _matrix(b.column("v"), dim)
                d = _from_pivots(np.column_stack([v, np.zeros(len(v))]), pivots)
                radius, done = np.asarray(b.column("radius")), np.asarray(b.column("done"))
                bins = np.arange(int(farthest / width) + 2)
                below, above = bins * width, (bins + 1) * width
                near = np.maximum(np.maximum(below[None, None] - d[:, :, None], d[:, :, None] - above[None, None]), 0.0)
                far = np.maximum(above[None, None] - d[:, :, None], d[:, :, None] - below[None, None])
                row, pivot, bin_ = np.nonzero((near <= radius[:, None, None]) & (far >= done[:, None, None]))
                yield pa.RecordBatch.from_arrays(
                    [b.column("anchor").take(pa.array(row)), pa.array(pivot.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(d[row, pivot])],
                    names=["anchor", "pivot", "bin", "d"],
                )

        def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"anchor": [], "need": [], "vec_id": [], "score": []}).astype("int64")
            if not len(asked) or not len(rows):
                return none
            rows = rows.sort_values("row_id", kind="stable")
            x, ids, labels = np.stack(rows["w"].to_numpy()).astype(np.float64), rows["row_id"].to_numpy(), rows["row_label"].to_numpy()
            out = [none]
            for o in range(0, len(asked), 256):
                part = asked.iloc[o : o + 256]
                scores = np.stack(part["v"].to_numpy()).astype(np.float64) @ x.T  # exact: integers below 2^53
                fit = (labels[None] == part["own"].to_numpy()[:, None]) == alike
                fit &= ids[None] != part["anchor_id"].to_numpy()[:, None]
                for i, (anchor, needs) in enumerate(zip(part["anchor"].tolist(), part["needs"], strict=True)):
                    own = np.flatnonzero(fit[i])
                    s = scores[i, own]
                    for need in needs:
                        inside = np.ones(len(s), dtype=bool)
                        if not pd.isna(need["low"]):
                            inside &= s >= need["low"]
                        if not pd.isna(need["high"]):
                            inside &= s <= need["high"]
                        at = np.flatnonzero(inside)
                        if len(at) > k:
                            least = np.partition(s[at], len(at) - k)[len(at) - k]
                            at = at[s[at] >= least]
                        at = at[np.argsort(-s[at], kind="stable")][:k]  # ids rise
                        if len(at):
                            out.append(pd.DataFrame({"anchor": anchor, "need": need["need"], "vec_id": ids[own[at]], "score": s[at].astype(np.int64)}))
            return pd.concat(out)

        pages = self.stored.select(F.col("page").alias("of_page"), F.col("vec_id").alias("row_id"), F.col("label").alias("row_label"), F.col("v").alias("w"))
        best = Window.partitionBy("anchor", "need").orderBy(F.col("score").desc(), "vec_id")
        found = anchors.sparkSession.createDataFrame([], f"{HITS}, rank int")
        step, finished = FIRST * length, False
        while not finished:
            asked = state.where("done < radius")
            near = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))
            reached = (
                asked.select("anchor", "v", "radius", "done")
                .mapInArrow(cells, "anchor long, pivot int, bin int, d double")
                .join(self.directory, ["pivot", "bin"])
                .join(asked, "anchor")
                .where((near <= F.col("radius")) & (near > F.col("done")) & (F.col("d") + F.col("high") >= F.col("inner")))
                .select("chunk", "page", "anchor", "anchor_id", "own", "v", "needs")
            )
            reached = save(reached, "pages-reached")
            sent = reached.select(F.col("chunk").alias("to_chunk"), F.col("page").alias("of_page")).distinct().join(pages, "of_page")
            hits = reached.groupBy("chunk", "page").cogroup(sent.groupBy("to_chunk", "of_page")).applyInPandas(meet, HITS)
            found = save(
                found.drop("rank").unionByName(hits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "negatives-found"
            )
            # What a need's worst find leaves open: nothing beyond that distance can be better.
            worst = found.where(F.col("rank") == k).select(F.col("anchor").alias("of_anchor"), "need", F.col("score").alias("worst"))
            open_ = (
                state.select("anchor", "square", "outer", F.explode("needs").alias("x"))
                .join(worst, (F.col("anchor") == F.col("of_anchor")) & (F.col("x.need") == F.col("need")), "left")
                .select("anchor", F.least(F.coalesce(to_distance(F.col("worst")) + slack, F.lit(farthest)), ends(F.col("x"))).alias("enough"), F.col("worst").isNull().alias("unfilled"))
                .groupBy("anchor")
                .agg(F.max("enough").alias("enough"), F.max("unfilled").alias("unfilled"))
            )
            step *= 4
            wider = F.when(F.col("unfilled"), F.least("enough", F.col("radius") + step)).otherwise(F.col("enough"))
            state = save(
                state.join(open_, "anchor")
                .withColumn("done", F.col("radius"))
                .withColumn("radius", F.greatest("done", wider))
                .drop("enough", "unfilled"),
                "anchor-rounds",
            )
            finished = not state.where("done < radius").head(1)
        return found


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has (vec_id, label, v, is_anchor) with ``v`` an array of integers. A score is the inner product with the
    anchor; higher ones come first, ties by smaller id. Positives are the first rows of the anchor's label, negatives
    the first of other labels with low * positive <= 100 * negative <= high * positive.

    * Rows with a null id, label or vector take no part, nor do vectors of another length than most (ties: the shorter).
    * Fewer positives or negatives than asked for give what there is; where the range is empty, as it is for positives
      of a score below zero, there is no row.
    * Rows that are equal count once. Different rows of one id are rows of their own, and none is a partner of another
      of that id. An anchor id that repeats has the rows of each.
    """
    spark = rows.sparkSession
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<int>").alias("v"), "is_anchor"
    )
    good = save(good.groupBy("vec_id", "label", "v").agg(F.max(F.coalesce("is_anchor", F.lit(False))).alias("is_anchor")), "mined-vectors")
    most = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").head(1)
    if not most or not most[0]["dim"]:
        return spark.createDataFrame([], FOUND)
    index = Index(good.where(F.size("v") == most[0]["dim"]), most[0]["dim"])
    anchors = index.anchors()
    null = F.lit(None).cast("double")
    open_range = F.array(F.struct(F.lit(0).alias("need"), null.alias("low"), null.alias("high")))
    near = index.search(anchors.withColumn("needs", open_range), positives, True).select(
        "anchor", F.col("rank").alias("need"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    least, greatest = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"({high} * positive_score) div 100")
    ranged = near.where("positive_score >= 0").select(
        "anchor", F.struct(F.col("need"), least.cast("double").alias("low"), greatest.cast("double").alias("high")).alias("x")
    )
    needs = ranged.groupBy("anchor").agg(F.sort_array(F.collect_list("x")).alias("needs"))  # as many as positives
    far = index.search(save(anchors.join(needs, "anchor"), "anchor-needs"), negatives, False)
    return (
        far.join(near, ["anchor", "need"])
        .join(anchors.select("anchor", "anchor_id"), "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def embedded(vectors: DataFrame, is_anchor, label) -> DataFrame:
    """(vec_id, label, v, is_anchor) of a table of embeddings: components as integers, unusable vectors left out."""
    return vectors.where(usable()).select("vec_id", label.alias("label"), whole(reach=REACH).alias("v"), is_anchor.alias("is_anchor"))
