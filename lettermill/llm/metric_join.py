"""Exact radius join of strings under the edit distance, partitioned by pivots.

Every string of the right side belongs to the cell of its nearest pivot.  A string of the left side is a member of each cell that can hold a partner:
for a partner ``o`` of cell ``i`` within ``r``, the triangle inequality gives ``d(s, p_i) <= d(o, p_i) + r <= d(o, p_s) + r <= d(s, p_s) + 2 r``, so
boundary strings belong to all cells within ``2 r`` of their nearest, and inside a cell only strings whose distances to the pivot differ by at most ``r`` can be
partners.  Membership travels as one row a string, the cells as bits, not as a copy a cell.

Edit distances of names lie close together, so cells alone prune little.  Inside the cells the join is led by pieces: a right string is cut into ``r + 1``
pieces, of which ``r`` edits leave one untouched, so a partner holds that piece at a place shifted by no more than the edits before and after it allow.
Length, piece number and piece are the join key; cell and ring are tested on each meeting, and the true metric decides.  All tests are necessary
conditions, so the result is exact.

Defined results: null keys meet nothing; equal strings are at distance 0; repeated rows are joined once; an empty side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.session import merged

PIVOTS = 24  # fixed: the pivots are literals of the plan, the only strings the driver ever sees


def _piece(n: Column, j: int, pieces: int) -> tuple[Column, Column]:
    """First place, from one, and length of piece ``j``, from zero, of a string of length ``n``; the last ``n % pieces`` pieces are one longer."""
    base, rest = F.floor(n / pieces), n % pieces
    return (base * j + F.greatest(F.lit(0), F.lit(j - pieces) + rest) + 1).cast("int"), (base + (F.lit(j) >= F.lit(pieces) - rest).cast("int")).cast("int")


def keys_of(text: str, radius: int) -> Column:
    """The pieces of a right string."""
    n, pieces = F.length(text), radius + 1
    return F.array(*[F.struct(n.alias("n"), F.lit(j).alias("j"), F.substring(F.col(text), *_piece(n, j, pieces)).alias("piece")) for j in range(pieces)])


def probes_of(text: str, radius: int) -> Column:
    """The places of a left string where a partner's untouched piece can lie, for every length a partner can have."""
    out, pieces = [], radius + 1
    for more in range(-radius, radius + 1):
        n = F.length(text) + more
        for j in range(pieces):
            at, size = _piece(n, j, pieces)
            for shift in range(max(-j, -more - (radius - j)), min(j, -more + (radius - j)) + 1):
                place = at + shift
                fits = (n >= 0) & (place >= 1) & (place + size - 1 <= F.length(text))
                out.append(F.when(fits, F.struct(n.alias("n"), F.lit(j).alias("j"), F.substring(F.col(text), place, size).alias("piece"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def met(left: DataFrame, right: DataFrame, radius: int, pivots: int = PIVOTS) -> DataFrame:
    """(l, r): pairs that pass the tests of piece, cell and ring, before the true metric."""
    ls = left.where(F.col("key").isNotNull()).select(F.col("key").alias("l")).distinct()
    rs = right.where(F.col("key").isNotNull()).select(F.col("key").alias("r")).distinct()
    chosen = [x["r"] for x in rs.orderBy(F.xxhash64("r"), "r").limit(pivots).collect()]
    if not chosen:
        return ls.join(rs, F.lit(False))
    far = lambda c: F.array(*[F.levenshtein(F.col(c), F.lit(p)) for p in chosen])
    home = rs.withColumn("ds", far("r")).withColumn("d", F.array_min("ds")).select("r", (F.array_position("ds", F.col("d")).cast("int") - 1).alias("cell"), "d", F.explode(keys_of("r", radius)).alias("k")).select("r", "cell", "d", "k.*")
    # -1 where the string is no member of the cell
    visits = ls.withColumn("ds", far("l")).withColumn("near", F.array_min("ds")).select("l", F.transform("ds", lambda d: F.when(d <= F.col("near") + 2 * radius, d).otherwise(F.lit(-1))).alias("dl"), F.explode(probes_of("l", radius)).alias("k")).select("l", "dl", "k.*")
    seen = F.col("dl")[F.col("cell")]
    return visits.join(merged(home), ["n", "j", "piece"]).where((seen >= 0) & (F.abs(seen - F.col("d")) <= radius)).select("l", "r").distinct()


def radius_join(left: DataFrame, right: DataFrame, radius: int, pivots: int = PIVOTS) -> DataFrame:
    """(l, r, dist): strings of column ``key`` of either side within ``radius``."""
    return met(left, right, radius, pivots).withColumn("dist", F.levenshtein("l", "r", radius)).where("dist >= 0").select("l", "r", "dist")
