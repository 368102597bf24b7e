"""Decisions from tables of verdicts: which chains show their secret only when all threads are read, and which smaller sets deliver it.

Verdicts are (chain, n, mask, prober, matched): for each non-empty subset of a chain's ``n`` threads, as a bit mask, and each prober, whether the secret was
matched. Defined results: a missing verdict is no match; a null verdict is no match; verdicts given twice count as matched if one is; an empty table decides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subsets(chains: DataFrame) -> DataFrame:
    """(chain, n, mask): every non-empty subset of the threads of each chain (chain, n)."""
    return chains.select("chain", "n", F.explode(F.expr("sequence(1L, shiftleft(1L, n) - 1L)")).alias("mask"))


def decide(verdicts: DataFrame, need: str = "all") -> DataFrame:
    """(chain, leak, recovered, keep): kept where no proper subset was matched by any prober and the full set by all of them, or by one where ``need`` is "any"."""
    v = verdicts.withColumn("matched", F.coalesce("matched", F.lit(False)))
    whole = F.bit_count("mask") == F.col("n")
    once = v.groupBy("chain", "n", "mask", "prober").agg(F.max("matched").alias("matched"))
    full = F.bool_and if need == "all" else F.bool_or
    g = once.groupBy("chain").agg(F.bool_or(F.col("matched") & ~whole).alias("leak"), F.coalesce(full(F.when(whole, F.col("matched"))), F.lit(False)).alias("recovered"))
    return g.withColumn("keep", ~F.col("leak") & F.col("recovered"))


def leaks(verdicts: DataFrame) -> DataFrame:
    """(chain, mask, prober): proper subsets that gave the secret away."""
    return verdicts.where(F.col("matched") & (F.bit_count("mask") < F.col("n"))).select("chain", "mask", "prober").distinct()


def delivered(verdicts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(chain, mask): the smallest proper subset of two threads or more that holds the last thread, that every prober matched and none of whose own subsets
    was matched by any. Of several of one size those with a fact thread come first (``facts`` is (chain, thread), from zero), then the lowest indices.
    """
    g = verdicts.groupBy("chain", "n", "mask").agg(F.bool_and(F.coalesce("matched", F.lit(False))).alias("every"), F.bool_or(F.coalesce("matched", F.lit(False))).alias("some"))
    a = g.where((F.bit_count("mask") >= 2) & (F.bit_count("mask") < F.col("n")) & F.col("every") & F.expr("mask & shiftleft(1L, n - 1) <> 0"))
    b = g.where("some").select(F.col("chain").alias("bc"), F.col("mask").alias("bm"))
    c = a.join(b, (F.col("chain") == F.col("bc")) & (F.col("bm") != F.col("mask")) & (F.col("bm").bitwiseAND(F.col("mask")) == F.col("bm")), "left_anti")
    if facts is not None:
        f = facts.groupBy("chain").agg(F.bit_or(F.expr("shiftleft(1L, thread)")).alias("fact"))
        c = c.join(f, "chain", "left").withColumn("lacks", (F.coalesce("fact", F.lit(0)).bitwiseAND(F.col("mask")) == 0).cast("int"))
    else:
        c = c.withColumn("lacks", F.lit(0))
    # lowest indices first: of two sets of one size the one whose lowest differing bit is set, so compare the indices as a list
    indices = F.filter(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0, i)), lambda x: x.isNotNull())
    return c.groupBy("chain").agg(F.min(F.struct(F.bit_count("mask").alias("k"), "lacks", indices.alias("at"), "mask")).alias("b")).select("chain", F.col("b.mask").alias("mask"))


def scored(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(sample, found, correct, rank, false_positive) of answers (sample, control, candidates array<string>) and judge verdicts (sample, candidate, matched).

    Found: a candidate was named. Correct: one matched, the first of them gives ``rank`` from one; only true counts. False positive: found in a control, or found without a match.
    """
    c = answers.select("sample", "control", F.posexplode_outer("candidates").alias("at", "candidate"))
    v = verdicts.where("matched").select("sample", "candidate").distinct().withColumn("hit", F.lit(True))
    g = c.join(v, ["sample", "candidate"], "left").groupBy("sample").agg(F.max("control").alias("control"), F.count("candidate").alias("n"), F.min(F.when(F.col("hit"), F.col("at") + 1)).alias("rank"))
    found, correct = F.col("n") > 0, F.col("rank").isNotNull() & ~F.col("control")
    return g.select("sample", found.alias("found"), correct.alias("correct"), F.when(correct, F.col("rank")).alias("rank"), (found & ~correct).alias("false_positive"))
