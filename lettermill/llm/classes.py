"""Classes of equal rows back to pairs of ids, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import merged

BLOCK = 500  # members of a class, about, that meet another block under one key


def expanded(links: DataFrame, members: DataFrame, block: int | None = None) -> DataFrame:
    """Pairs of members of linked classes: the columns of ``members`` (cls, id, others) twice, ending in ``_a`` and ``_b``, without ``cls``.

    ``links`` is (a, b), a class with itself where its own members pair; members of one class then meet once or twice, in either order.  Each pair of blocks is a
    key of its own, so a class that holds a third of all rows is many small joins. Null ids are in no pair; no member is dropped.
    """
    block = block or BLOCK
    rest = [c for c in members.columns if c not in ("cls", "id")]
    asked = merged(links.select(F.col("a").alias("cls")).union(links.select("b")).distinct())
    m = members.where(F.col("id").isNotNull()).join(asked, "cls").distinct()
    sizes = m.groupBy("cls").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    m = merged(m.join(merged(sizes), "cls").select("cls", F.pmod(F.xxhash64("id", *rest), "blocks").cast("int").alias("block"), "id", *rest))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    blocks = links.join(merged(sizes.toDF("a", "na")), "a").join(merged(sizes.toDF("b", "nb")), "b").select("a", "b", "nb", each("na").alias("pa")).select("a", "b", "pa", each("nb").alias("pb")).where("a <> b OR pa <= pb")
    side = lambda s: m.toDF(s, f"p{s}", *(f"{c}_{s}" for c in ("id", *rest)))
    return blocks.join(side("a"), ["a", "pa"]).join(side("b"), ["b", "pb"]).select(*(f"{c}_{s}" for s in "ab" for c in ("id", *rest)))
