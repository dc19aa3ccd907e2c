"""Nearest neighbours by shifted space-filling curves.

Inner-product search becomes a search by distance: a vector gets one coordinate
more that brings all to one length. Several times the vectors are projected to a
few random directions, shifted, and ordered along a Hilbert curve; Spark sorts
them by range. A query meets the vectors of its own bucket of consecutive ranks
and of the two next to it, in every ordering. The best of all orderings, scored
on the original vectors, give each query a bound, and a check of the query set
against all rows, in blocks, adds what is above the bound and was missed. Blocks
whose ball about their centre can't reach the bound are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import save

ORDERINGS = 4
AXES = 8
AXIS_BITS = 7
#: Ranks in a bucket; a query sees three buckets of each ordering.
BUCKET = 512
#: Rows and queries in a block of the check.
BLOCK = 8192
QUERY_BLOCK = 1024
#: Rows whose common ball is compared with a bound.
BALL = 256

HITS = "query_id long, vec_id long, score double"


def hilbert_key(cells: np.ndarray, bits: int = AXIS_BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells, one row of coordinates each.

    The coordinates are turned, from the highest bit down, into the curve's own
    frame, Gray-coded, and their bits interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ t) >> b) & 1)
    return key


def usable(col: str = "embedding") -> Column:
    """Whether a vector takes part: not null or zero, no null or non-finite component."""
    bad = F.exists(col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(col, lambda c: c != 0)


def _ordered(vectors: DataFrame, dim: int, longest: float, orderings: int, seed: int) -> DataFrame:
    """(ordering, key, vec_id, v, is_query): each vector's place on every curve."""
    rng = np.random.default_rng(seed)
    frames = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :AXES] for _ in range(orderings)]
    shifts = rng.uniform(0, 1, size=(orderings, AXES))
    reach = 4.0 * longest / np.sqrt(dim + 1)  # four deviations of a random direction

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(b.num_rows, dim)
            extra = np.sqrt(np.maximum(longest**2 - (v * v).sum(axis=1), 0.0))
            full = np.column_stack([v, extra])
            for k in range(orderings):
                axes = full @ frames[k][:, : min(AXES, dim + 1)]
                at = (axes / reach + 1.0) / 2.0 + shifts[k][: axes.shape[1]]
                cells = np.clip(at * (1 << (AXIS_BITS - 1)), 0, (1 << AXIS_BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b.num_rows, k, dtype=np.int32)), pa.array(hilbert_key(cells)), *b.columns],
                    names=["ordering", "key", "vec_id", "v", "is_query"],
                )

    return vectors.mapInArrow(run, "ordering int, key long, vec_id long, v array<double>, is_query boolean")


def _ranked(ordered: DataFrame) -> DataFrame:
    """``ordered`` with a global ``rank`` over all orderings, one after another.

    Spark sorts by range; a row's rank is its number in its partition and the
    rows of the partitions before, of which the driver gets one count each.
    """
    spark = ordered.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = save(
        ordered.repartitionByRange(n, "ordering", "key", "vec_id")
        .sortWithinPartitions("ordering", "key", "vec_id")
        .drop("key")
        .withColumn("row", F.monotonically_increasing_id()),
        "curve",
    ).withColumn("part", F.shiftright("row", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("ordering").alias("o")).orderBy("part").collect()
    base, bases = 0, []
    for r in counts:
        bases.append((r["part"], base))
        base += r["n"]
    offsets = F.broadcast(spark.createDataFrame(bases or [(0, 0)], "part long, base long"))  # one row a partition
    return placed.join(offsets, "part").select(
        "ordering", "vec_id", "v", "is_query", (F.col("base") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    )


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _best(q_ids, q, v_ids, v, k: int) -> pd.DataFrame:
    """The ``k`` best of ``v`` for each query, ties to the smaller id; scores are summed alike for equal vectors.
    Vectors of one id and score count once."""
    scores = q @ v.T
    scores[q_ids[:, None] == v_ids[None, :]] = -np.inf
    m = min(k * int(np.unique(v_ids, return_counts=True)[1].max()), len(v_ids))  # k ids at least
    least = np.partition(scores, len(v_ids) - m, axis=1)[:, len(v_ids) - m]
    slack = 1e-9 * (1.0 + np.abs(np.where(np.isfinite(least), least, 0.0)))
    i, j = np.nonzero((scores >= (least - slack)[:, None]) & np.isfinite(scores))
    found = pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "score": (q[i] * v[j]).sum(axis=1)})
    found = found.drop_duplicates().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    orderings: int = ORDERINGS,
    bucket: int = BUCKET,
    complete: bool = True,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` largest inner products of each query: query_id, rank, vec_id, score.

    ``vectors`` has (vec_id, embedding); ``is_query`` picks the queries, and every
    other row is a candidate. All rows are indexed.

    * Vectors that are null, zero, of another length than most, or that hold null
      or non-finite components take no part, as queries or candidates; nor do null ids.
    * Fewer candidates than ``k`` give fewer rows. Ties go to the smaller id. Rows
      that repeat an id count once if equal; different vectors under one id are
      candidates of their own.
    * ``complete=False`` leaves out the check of queries against all rows.
    """
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("is_query")
    )
    good = save(good.groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query")), "vectors")  # equal rows count once
    sizes = good.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("square"),
        F.sum(F.col("is_query").cast("long")).alias("queries"),
    )
    most = sizes.orderBy(F.col("n").desc(), "dim").head(1)
    if not most:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest, queries = most[0]["dim"], most[0]["n"], float(most[0]["square"]) ** 0.5, most[0]["queries"]
    ranked = save(_ranked(_ordered(good.where(F.size("v") == dim), dim, longest, orderings, seed)), "curve-ranks")

    def meet(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(pairs["vec_id"].to_numpy(), _matrix(pairs["v"]), rows["row_id"].to_numpy(), _matrix(rows["w"]), k)

    own_rank = F.col("rank") - F.col("ordering") * n  # each ordering has all n rows
    at = F.col("ordering") * (n // bucket + 3) + 1 + F.floor(own_rank / bucket).cast("long")
    asked = ranked.where("is_query").select(
        F.explode(F.array(at - 1, at, at + 1)).alias("bucket"), "vec_id", "v"
    )
    rows = ranked.select(at.alias("row_bucket"), F.col("vec_id").alias("row_id"), F.col("v").alias("w"))
    hits = asked.groupBy("bucket").cogroup(rows.groupBy("row_bucket")).applyInPandas(meet, HITS)
    found = save(_top(hits, k), "curve-hits")
    if not complete:
        return found.select("query_id", "rank", "vec_id", "score")

    bounds = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    one = ranked.where("ordering = 0")
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-queries // QUERY_BLOCK))
    bounded = one.where("is_query").join(bounds, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "v", F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("-inf"))).alias("bound")
    )
    lhs = bounded.select(
        "vec_id", "v", "bound", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    rhs = one.select(
        F.col("vec_id").alias("row_id"), F.col("v").alias("w"), "rank",
        F.floor(F.col("rank") / BLOCK).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("row_chunk"),
    )

    def check(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(asked) and len(rows):
            rows = rows.sort_values("rank")
            q, q_ids, bound = _matrix(asked["v"]), asked["vec_id"].to_numpy(), asked["bound"].to_numpy()
            v, v_ids = _matrix(rows["w"]), rows["row_id"].to_numpy()
            norms = np.linalg.norm(q, axis=1)
            slack = 1e-9 * (1.0 + np.where(np.isfinite(bound), np.abs(bound), 0.0))
            for s in range(0, len(v), BALL):
                ball = v[s : s + BALL]
                centre = ball.mean(axis=0)
                radius = np.sqrt(((ball - centre) ** 2).sum(axis=1).max())
                near = np.flatnonzero(q @ centre + norms * radius >= bound - slack)
                i, j = np.nonzero(q[near] @ ball.T >= (bound - slack)[near][:, None])
                i, j = near[i], j + s
                other = q_ids[i] != v_ids[j]
                i, j = i[other], j[other]
                out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "score": (q[i] * v[j]).sum(axis=1)}))
            every = pd.concat(out[1:]).drop_duplicates().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
            return every.groupby("query_id", sort=False).head(k)
        return out[0]

    missed = lhs.groupBy("block", "chunk").cogroup(rhs.groupBy("row_block", "row_chunk")).applyInPandas(check, HITS)
    return _top(found.select("query_id", "vec_id", "score").unionByName(missed), k).select(
        "query_id", "rank", "vec_id", "score"
    )
