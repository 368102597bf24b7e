"""Sample to target category counts by systematic unequal-probability sampling.

For each draw and category the first-order inclusion probability of a row is ``min(1, want / pool)``.  Rows lie in random
order inside sorted categories; their probabilities are prefix-summed across partitions (local sums by block, then block
offsets), one random start ``u`` is drawn for each draw, and a row is taken where the cumulative sum crosses an integer plus ``u``.
So every category gets the floor or the ceiling of its expectation, and the total is met at once.  A repair step then lifts
categories left under their floor and trims those one above their quota, by the same random order.

Defined results: null ids never count; rows repeated under one id count once; a category unknown to the vocabulary counts for
none; an alloc entry with a null count is zero; an empty pool or an empty draw gives an empty sample and a report row
``available = 0``; extra columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lettermill.functions.text import label_key

BLOCK = 50_000  # rows of a category, about, whose probabilities one window sums; a category has as many hash blocks as it needs


def categorised(rows: DataFrame, vocabulary: DataFrame, id_col: str, label_col: str, vocab_col: str) -> DataFrame:
    """(id, topic): each id once for each label of the vocabulary that any of its rows carries."""
    vocab = vocabulary.where(F.col(vocab_col).isNotNull()).select(F.col(vocab_col).alias("topic"), label_key(vocab_col).alias("_k")).dropDuplicates(["_k"])
    return (
        rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), label_key(label_col).alias("_k"))
        .join(vocab, "_k")
        .select("id", "topic")
        .distinct()
    )


def requests(manifest: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(draw_id, seed, topic, wanted, floor): one row for each draw and topic of its alloc."""
    return (
        manifest.select("draw_id", "seed", "min_per_topic", F.explode("alloc").alias("topic", "wanted"))
        .groupBy("draw_id", "topic")
        .agg(
            F.max("seed").alias("seed"),
            F.coalesce(F.max("wanted"), F.lit(0)).cast("long").alias("wanted"),
            F.coalesce(F.max("min_per_topic"), F.lit(0)).cast("long").alias("floor"),
        )
        .withColumn("target", F.greatest("wanted", "floor"))
    )


def draw(pool: DataFrame, asked: DataFrame) -> DataFrame:
    """(draw_id, topic, id): the sample of every draw. ``pool`` is (id, topic), ``asked`` comes from :func:`requests`."""
    sizes = pool.groupBy("topic").agg(F.count("*").alias("available"))
    ask = asked.join(sizes, "topic").where(F.col("target") > 0).withColumn("p", F.least(F.lit(1.0), F.col("target") / F.col("available")))
    rows = (
        pool.join(ask.select("draw_id", "topic", "seed", "p", "target", F.ceil(F.col("available") / BLOCK).cast("int").alias("blocks")), "topic")
        .withColumn("h", F.xxhash64("seed", "draw_id", "id"))
        .withColumn("block", F.pmod(F.shiftright("h", 40), F.col("blocks")))
    )
    # prefix sums in two levels: inside a block, and over the small table of block totals
    by_block = rows.groupBy("draw_id", "seed", "topic", "block").agg(F.sum("p").alias("s"))
    order = Window.partitionBy("draw_id").orderBy("topic", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_block.withColumn("before", F.coalesce(F.sum("s").over(order), F.lit(0.0))).select("draw_id", "topic", "block", "before")
    inside = Window.partitionBy("draw_id", "topic", "block").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64("seed", "draw_id", F.lit("start")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = (
        rows.join(offsets, ["draw_id", "topic", "block"])
        .withColumn("upto", F.round(F.col("before") + F.sum("p").over(inside), 9))
        .withColumn("u", start)
        .withColumn("hit", (F.floor(F.col("upto") + F.col("u")) > F.floor(F.round(F.col("upto") - F.col("p"), 9) + F.col("u"))).cast("int"))
    )
    # repair: hits first, then the others, in the same random order, up to the target; ranks come from block counts as well
    counts = rows.groupBy("draw_id", "topic", "block").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("others"))
    prior = Window.partitionBy("draw_id", "topic").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("draw_id", "topic")
    counts = counts.select(
        "draw_id", "topic", "block",
        F.coalesce(F.sum("hits").over(prior), F.lit(0)).alias("hits_before"),
        (F.coalesce(F.sum("others").over(prior), F.lit(0)) + F.sum("hits").over(whole)).alias("others_before"),
    )
    by_hit = Window.partitionBy("draw_id", "topic", "block", "hit").orderBy("h", "id")
    rows = rows.withColumn("r", F.row_number().over(by_hit)).join(counts, ["draw_id", "topic", "block"])
    rank = F.col("r") + F.when(F.col("hit") == 1, F.col("hits_before")).otherwise(F.col("others_before"))
    return rows.where(rank <= F.col("target")).select("draw_id", "topic", "id")


def report(pool: DataFrame, asked: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """One row for each draw and topic: wanted, floor, target, available, drawn and whether the target was met."""
    sizes = pool.groupBy("topic").agg(F.count("*").alias("available"))
    out = asked.join(sizes, "topic", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    got = (drawn.groupBy("draw_id", "topic").agg(F.count("*").alias("drawn")) if drawn is not None else None)
    out = out.join(got, ["draw_id", "topic"], "left") if got is not None else out.withColumn("drawn", F.least("available", "target"))
    return out.select(
        "draw_id", "topic", "wanted", "floor", "target", "available",
        F.coalesce("drawn", F.lit(0)).cast(T.LongType()).alias("drawn"),
        (F.coalesce("drawn", F.lit(0)) >= F.col("target")).alias("met"),
    )
