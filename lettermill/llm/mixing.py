"""Mixing sources to target weights.

Sizes are tokens of a public tokenizer.  For every mix the token masses of its (source, language, topic) cells are raked by iterative
proportional fitting: the source marginal to the wanted tokens (as far as a source reaches with its allowed repeats), the language and
topic marginals to their shares of the corpus.  A cell's raked mass over its own mass is the expected number of uses of each of its documents;
its whole part is taken outright and the fraction is a calibrated probability, drawn systematically along the documents by cell, size and hash.

Defined results: documents with a null source belong to no mix; a null language is a language of its own; a null or empty text has
no tokens and is never drawn; a source without documents gets nothing and falls short of any positive target; rows of the targets repeated
for one mix and source add up their weights; a null or negative ``max_repeats`` is zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.llm.bpe import counted
from lettermill.session import bounded, merged

ROUNDS, TOLERANCE = 200, 1e-9
BLOCK = 50_000  # documents, about, whose probabilities one window sums


def noted_topics(docs: DataFrame, topics: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, topic) of the texts that hold a telling word: the topic of the vocabulary table most of whose words they hold, the first in order on ties.

    Telling are the words of four letters or more in a topic's name and note that no other topic has. The vocabulary is small, and more than 20,000 words raise.
    """
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    words = topics.where(F.col("topic").isNotNull() & (F.col("topic") != "other")).select("topic", F.explode(found(F.concat_ws(" ", "topic", "note"))).alias("w")).distinct()
    words = words.groupBy("w").agg(F.min("topic").alias("topic"), F.max("topic").alias("_t")).where("topic = _t").select("w", "topic")
    hits = docs.where(F.col(key).isNotNull()).select(key, F.explode(found(text)).alias("w")).join(F.broadcast(bounded(words, 20_000)), "w").groupBy(key, "topic").agg(F.count("*").alias("n"))
    return hits.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "topic")).alias("b")).select(key, F.col("b.topic").alias("topic"))


def targets(mix: DataFrame) -> DataFrame:
    """(mix_id, source, want, max_repeats): wanted tokens of each source of each mix."""
    return (
        mix.where(F.col("source").isNotNull())
        .groupBy("mix_id", "source")
        .agg((F.sum(F.coalesce("weight", F.lit(0.0))) * F.max(F.coalesce("total_tokens", F.lit(0)))).alias("want"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    )


def sized(docs: DataFrame, topics: DataFrame | None = None, **tokenizer) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of all documents with a source; ``topics`` is (doc_id, topic)."""
    src = docs.where(F.col("source").isNotNull()).select("doc_id", "source", F.coalesce("lang", F.lit("?")).alias("lang"), "text")
    out = counted(src, ["doc_id", "source", "lang"], **tokenizer)
    out = out.withColumn("topic", F.lit("other")) if topics is None else out.join(merged(topics), "doc_id", "left").withColumn("topic", F.coalesce("topic", F.lit("other")))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens")


def rake(group: pd.DataFrame) -> pd.DataFrame:
    """IPF over the cells of one mix: adds ``uses``, the expected number of uses of a document of the cell."""
    g = group.reset_index(drop=True)
    x = g["mass"].to_numpy(float).copy()
    top = g["mass"].to_numpy(float) * g["max_repeats"].to_numpy(float)
    s, l, t = (g[c].astype("category").cat.codes.to_numpy() for c in ("source", "lang", "topic"))
    cap = np.bincount(s, top)
    want_s = np.minimum(np.bincount(s, g["want"] / np.bincount(s)[s]), cap)
    total = want_s.sum()
    share = lambda k, m: np.bincount(k, m) / max(m.sum(), 1e-12) * total
    mass = g["mass"].to_numpy(float)
    want_l, want_t = share(l, mass), share(t, mass)
    for _ in range(ROUNDS):
        last = x.copy()
        for k, want in ((t, want_t), (l, want_l), (s, want_s)):
            have = np.bincount(k, x, minlength=len(want))
            x *= np.divide(want, have, out=np.zeros_like(want), where=have > 0)[k]
        # no cell beyond its repeats; what is cut off goes to the source's other cells
        for _ in range(50):
            over = x > top
            x = np.minimum(x, top)
            gap = want_s - np.bincount(s, x, minlength=len(want_s))
            if (gap <= 1e-9 * (1 + want_s)).all():
                break
            room = np.where(over, 0.0, x)
            room = np.where(np.bincount(s, room, minlength=len(want_s))[s] > 0, room, top - x)
            base = np.bincount(s, room, minlength=len(want_s))
            x += np.divide(gap, base, out=np.zeros_like(gap), where=base > 0)[s] * room
        if np.abs(x - last).max() <= TOLERANCE * (1 + total):
            break
    g["uses"] = np.divide(x, mass, out=np.zeros_like(x), where=mass > 0)
    return g[["mix_id", "source", "lang", "topic", "uses"]]


def calibrated(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """(mix_id, source, lang, topic, uses). One group is the cells of one mix: sources by languages by topics, never documents."""
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("mass")).where("mass > 0")
    asked = targets(mix).join(cells, "source")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return asked.groupBy("mix_id").applyInPandas(rake, f"mix_id {kinds['mix_id']}, source string, lang string, topic string, uses double")


def drawn(docs: DataFrame, mix: DataFrame, seed: int = 8) -> DataFrame:
    """(mix_id, doc_id, source, n_tokens, copies): the documents of each mix and how often each is used."""
    rows = docs.where("n_tokens > 0").join(calibrated(docs, mix), ["source", "lang", "topic"]).where("uses > 0")
    rows = rows.withColumn("whole", F.floor(F.col("uses") + 1e-9)).withColumn("p", F.greatest(F.col("uses") - F.col("whole"), F.lit(0.0)))
    # one random start a mix and source; documents lie by cell and size, so a source's tokens stray by little; prefix sums in two levels, so no window holds a cell
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "mix_id", "doc_id")).withColumn("size", F.floor(F.log2("n_tokens")).cast("int"))
    cell = ["mix_id", "source", "lang", "topic", "size"]
    counts = docs.where("n_tokens > 0").groupBy("source", "lang", "topic", F.floor(F.log2("n_tokens")).cast("int").alias("size")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(merged(counts), cell[1:]).withColumn("block", F.pmod(F.shiftright("h", 40), F.col("blocks")).cast("int"))
    sums = rows.groupBy(*cell, "block").agg(F.sum("p").alias("s"))
    order = Window.partitionBy("mix_id", "source").orderBy("lang", "topic", "size", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(order), F.lit(0.0))).select(*cell, "block", "before")
    w = Window.partitionBy(*cell, "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    u = F.pmod(F.xxhash64(F.lit(seed), "mix_id", "source"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.join(merged(before), [*cell, "block"]).withColumn("upto", F.col("before") + F.sum("p").over(w)).withColumn("u", u)
    extra = (F.floor(F.col("upto") + F.col("u")) > F.floor(F.col("upto") - F.col("p") + F.col("u"))).cast("long")
    return rows.withColumn("copies", F.col("whole") + extra).where("copies > 0").select("mix_id", "doc_id", "source", "n_tokens", "copies")


def report(docs: DataFrame, mix: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(mix_id, source, want, reach, short[, got, share]): what each source should give, can give with its repeats, and gave."""
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    out = targets(mix).join(have, "source", "left").withColumn("reach", F.coalesce("have", F.lit(0)) * F.col("max_repeats"))
    out = out.withColumn("short", F.col("reach") < F.col("want"))
    cols = ["mix_id", "source", "want", "reach", "short"]
    if taken is not None:
        got = taken.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("got"))
        out = out.join(got, ["mix_id", "source"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
        out = out.withColumn("share", F.col("got") / F.nullif(F.sum("got").over(Window.partitionBy("mix_id")), F.lit(0)))
        cols += ["got", "share"]
    return out.select(*cols)
