"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to give f times its words asks for f copies of each of its
documents. The whole part of f is taken as it is; what is left is a probability
for one copy more. Pivotal rounding settles these probabilities in pairs: words
move from one document of a pair to the other, in a direction drawn so that both
keep their expectation, until one of the two is taken or left out for certain;
the other goes on. Nothing is lost in a move, so the words that a source gives
end within half a document of its target. The documents of a source meet in small
bundles, what remains of each bundle meets in the next level, and so on, in a
tree with as many levels as the logarithm of the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import save, text_key

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: Times its words that a source gives at most.
MOST = 2
#: Documents, or remains of bundles, that meet in one bundle.
FAN_IN = 32

UNIT = "struct<key:bigint,doc_id:bigint,text_key:bigint,source:string,size:bigint,p:double>"
SETTLED = "struct<doc_id:bigint,text_key:bigint,source:string,size:bigint,extra:int>"


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Words each source is to give: source, source_size, n_docs, target.

    ``sizes`` has (source, size). ``share`` of all words are divided by weight; a
    source over ``most`` times its own words gives just those, and the excess is
    divided among the others by weight until none is above. That fixed point is
    min(cap, level * weight) for one common level, found here from the sources in
    order of cap / weight. One row per source is sorted, not one per document.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    everything = Window.partitionBy(F.lit(0))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.select(
        "*",
        F.element_at(
            F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1
        ).alias("weight"),
        (F.col("source_size") * float(most)).alias("cap"),
    )
    by_fill = Window.partitionBy(F.lit(0)).orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("place", F.row_number().over(by_fill))
        .withColumn("rest", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("rest") / F.col("rest_weight"))
    )
    first_open = F.min(
        F.when(F.col("level") < F.col("fill"), F.struct("place", "level"))
    ).over(everything)
    return filled.withColumn("open", first_open).select(
        "source",
        "source_size",
        "n_docs",
        F.when(F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("open.level") * F.col("weight")))
        .alias("target"),
    )


def _draw(level: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) that two keys and a level always give alike."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), F.lit(level), a, b), 11)
    return bits.cast("double") / float(1 << 53)


def _settle(level: int) -> tuple[Column, object]:
    """Start and step of the fold that settles a bundle: (left, done)."""
    start = F.struct(
        F.lit(None).cast(UNIT).alias("left"), F.array().cast(f"array<{SETTLED}>").alias("done")
    )

    def settled(unit: Column, extra: Column) -> Column:
        return F.struct(
            *(unit[c].alias(c) for c in ("doc_id", "text_key", "source", "size")), extra.alias("extra")
        )

    def with_p(unit: Column, p: Column) -> Column:
        return F.struct(
            *(unit[c].alias(c) for c in ("key", "doc_id", "text_key", "source", "size")),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"),
        )

    def step(acc: Column, unit: Column) -> Column:
        a, b = acc["left"], unit
        have_a, have_b = a["p"] * a["size"], b["p"] * b["size"]  # words still open
        room_a, room_b = a["size"] - have_a, b["size"] - have_b
        to_a, to_b = F.least(room_a, have_b), F.least(have_a, room_b)
        up = _draw(level, a["key"], b["key"]) * (to_a + to_b) < to_b
        a_full, b_empty = room_a <= have_b, have_a <= room_b
        left = (
            F.when(up & a_full, with_p(b, b["p"] - room_a / b["size"]))
            .when(up, with_p(a, a["p"] + have_b / a["size"]))
            .when(b_empty, with_p(b, b["p"] + have_a / b["size"]))
            .otherwise(with_p(a, a["p"] - room_b / a["size"]))
        )
        done = (
            F.when(up & a_full, settled(a, F.lit(1)))
            .when(up, settled(b, F.lit(0)))
            .when(b_empty, settled(a, F.lit(0)))
            .otherwise(settled(b, F.lit(1)))
        )
        return F.when(
            a.isNull(), F.struct(with_p(b, b["p"]).alias("left"), acc["done"].alias("done"))
        ).otherwise(F.struct(left.alias("left"), F.concat(acc["done"], F.array(done)).alias("done")))

    return start, step


def mix(
    docs: DataFrame,
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Copies of each document in the mix: doc_id, source, size, source_size, target, copies, taken, text_key.

    * ``size`` counts words in the whole text (null: 0); documents without words
      take no part: copies 0.
    * A null source is a source of its own, the last. Rows of one id, or of none, are
      documents of their own, told apart by text and, if that is the same too, by a
      number among them, so that no bundle grows with them. The draw depends on ids and
      texts only: reruns agree, however the rows are dealt out.
    * No rows give no rows; other columns are not read.
    """
    sizes = save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            text_key(text_col).alias("text_key"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        .groupBy("doc_id", "source", "text_key", "size")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("doc_id", "source", "text_key", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("number"))
        .withColumn("key", F.xxhash64("doc_id", "text_key", "number"))
        .drop("number"),
        "mix-sizes",
    )
    targets = save(source_targets(sizes, weights, share, most), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    asked = sizes.join(
        targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    ).select(
        "key", "doc_id", "text_key", "source", "size", (copies - F.floor(copies)).alias("p"), "n_docs"
    )
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    bundle = F.pmod(F.xxhash64(F.lit("bundle"), "key"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / fan_in)))
    units = asked.where(open_).select(
        "source", bundle.alias("bundle"), F.struct("key", "doc_id", "text_key", "source", "size", "p").cast(UNIT).alias("unit")
    )
    largest = targets.agg(F.max("n_docs")).head()[0] or 0
    bundles, level, settled = -(-largest // fan_in), 0, []
    while True:
        start, step = _settle(level)
        order = F.struct(F.xxhash64(F.lit(level), F.col("unit.key")).alias("order"), F.col("unit").alias("unit"))
        folded = save(
            units.groupBy("source", "bundle")
            .agg(F.sort_array(F.collect_list(order)).alias("units"))
            .select("source", "bundle", F.aggregate(F.transform("units", lambda u: u["unit"]), start, step).alias("fold")),
            "mix-level",
        )
        settled.append(folded.select(F.explode("fold.done").alias("d")).select("d.*"))
        units = folded.select(
            "source", F.floor(F.col("bundle") / fan_in).cast("long").alias("bundle"), F.col("fold.left").alias("unit")
        )
        if bundles <= 1:
            break
        bundles, level = -(-bundles // fan_in), level + 1
    last = F.when(F.col("unit.p") >= 0.5, 1).otherwise(0)  # one document a source: to the nearer side
    settled.append(units.select("unit.doc_id", "unit.text_key", "unit.source", "unit.size", last.alias("extra")))
    settled.append(asked.where(~open_).select("doc_id", "text_key", "source", "size", F.lit(0).alias("extra")))
    every = settled[0]
    for s in settled[1:]:
        every = every.unionByName(s)
    out = every.join(
        targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))
    )
    taken = F.when(F.col("size") > 0, F.floor(copies).cast("int") + F.col("extra")).otherwise(0)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("copies"), (taken * F.col("size")).alias("taken"), "text_key"
    )
