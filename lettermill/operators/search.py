"""Ranked text search over an inverted index: document frequencies as joins, the best documents of each query in blocks of documents by queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from lettermill.functions.text import search_tokens
from lettermill.operators.order import numbered
from lettermill.session import cut, merged

K1, B = 1.5, 0.75
#: Postings and queries of a block, which one task holds in memory; fewer postings where that keeps more cores busy, never under LEAST.
POSTINGS, QUERIES, LEAST = 2_000_000, 200_000, 250_000
NEAR = 2e-6  # scores further apart than this differ after rounding to six places


def small_or_merged(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df`` for a join: broadcast where a count of at most ``most`` rows proves it small, sorted and merged otherwise."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else merged(df)


def _kth(x: np.ndarray, k: int) -> float:
    """The ``k``-th largest of ``x``, which no smaller set of documents can push down; without one, nothing is known."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


class _Block:
    """Postings of a block of documents by term: rows of documents in the order of their keys, and what the term adds to the score of each."""

    def __init__(self, docs: pa.Table, idf: np.ndarray, k: int):
        self.n, post = docs.num_rows, docs["toks"].combine_chunks()
        row, t = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (pc.list_parent_indices(post), pc.list_flatten(post)))
        key, tf = np.unique(t * self.n + row, return_counts=True)
        t, self.row = np.divmod(key, self.n)
        self.add = idf[t] * tf * (K1 + 1) / (tf + docs["norm"].to_numpy()[self.row])
        self.at = np.searchsorted(t, np.arange(len(idf) + 1))
        self.shown = ~docs["hidden"].to_numpy(zero_copy_only=False).astype(bool)
        self.acc, self.k = np.zeros(self.n), k
        self.most, self.sure = np.zeros(len(idf)), np.full(len(idf), -np.inf)
        for x in np.flatnonzero(np.diff(self.at)):
            r, a = self.of(x)
            self.most[x], self.sure[x] = a.max(), _kth(a[self.shown[r]], k)

    def of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.at[t], self.at[t + 1])
        return self.row[s], self.add[s]

    def union(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with any of the terms, and the sum of what these add."""
        if len(terms) == 1:
            return self.of(terms[0])
        found = []
        for t in terms:
            r, a = self.of(t)
            found.append(r[self.acc[r] == 0])  # an addition is above zero
            self.acc[r] += a
        rows = np.concatenate(found)
        sums = self.acc[rows]
        self.acc[rows] = 0
        return rows, sums

    def added(self, t: int, rows: np.ndarray) -> np.ndarray:
        """What the term adds to each of ``rows``."""
        r, a = self.of(t)
        if len(rows) * 16 < len(r):
            i = np.minimum(np.searchsorted(r, rows), len(r) - 1)
            return np.where(r[i] == rows, a[i], 0.0)
        self.acc[r] = a
        out = self.acc[rows]
        self.acc[r] = 0
        return out

    def best(self, terms: np.ndarray, k: int, without: np.ndarray, everything: bool) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best by score and key. Documents are left aside only where their largest possible score lies below ``k`` others.

        Terms are taken from the one that can add most; documents that hold none of the first terms are not looked at once the rest cannot reach the score that is sure.
        """
        terms = terms[np.diff(self.at)[terms] > 0] if len(terms) else terms
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0.0)  # rest[i]: most that terms[i:] add
        sure = self.sure[terms].max() - NEAR
        first = max(1, int((rest[:-1] >= sure).sum()))
        rows, sums = self.union(terms[:first])
        keep = np.ones(len(rows), bool) if everything else self.shown[rows]
        if len(without):
            keep &= ~np.isin(rows, without)
        rows, sums = rows[keep], sums[keep]
        for i in range(first, len(terms) + 1):
            sure = max(sure, _kth(sums, k) - NEAR)
            keep = sums + rest[i] >= sure
            rows, sums = rows[keep], sums[keep]
            if i < len(terms):
                sums = sums + self.added(terms[i], rows)
        score = np.floor(sums * 1e6 + 0.5) / 1e6
        top = np.lexsort((rows, -score))[:k]
        return rows[top], score[top]


def _best(docs: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(qid, doc, score): the ``k`` best documents of each query within one block."""
    if not docs.num_rows or not asked.num_rows:
        return pa.table({"qid": asked["qid"].slice(0, 0), "doc": docs["doc"].slice(0, 0), "score": pa.array([], pa.float64())})
    docs = docs.take(pc.sort_indices(docs["doc"]))
    terms, away = asked["terms"].combine_chunks(), asked["away"].combine_chunks()
    t, idf = (pc.list_flatten(terms).field(c).to_numpy(zero_copy_only=False) for c in ("t", "idf"))
    weight = np.zeros(max(int(t.max()), pc.max(pc.list_flatten(docs["toks"])).as_py()) + 1)
    weight[t] = idf
    n_away = pc.list_value_length(away).to_numpy(zero_copy_only=False)
    ends, away_ends = (np.append(0, np.cumsum(n)) for n in (pc.list_value_length(terms).to_numpy(zero_copy_only=False), n_away))
    out = pc.fill_null(pc.index_in(pc.list_flatten(away), value_set=docs["doc"].combine_chunks()), -1).to_numpy(zero_copy_only=False)  # -1: in another block
    block, nameless = _Block(docs, weight, k + int(n_away.max())), asked["qid"].is_null().to_numpy()
    hits = []
    for i in range(asked.num_rows):
        gone = out[away_ends[i] : away_ends[i + 1]]
        hits.append(block.best(t[ends[i] : ends[i + 1]], k, gone[gone >= 0], nameless[i]))
    rows, score = (np.concatenate([h[j] for h in hits]) for j in (0, 1))
    which = np.repeat(np.arange(asked.num_rows), [len(h[0]) for h in hits])
    return pa.table({"qid": asked["qid"].take(pa.array(which)), "doc": docs["doc"].take(pa.array(rows)), "score": pa.array(score)})


def bm25(
    docs: DataFrame, key: str, text: str, queries: DataFrame, k: int, qkey: str = "qid", qtext: str = "query", without: DataFrame | None = None, hidden: DataFrame | None = None
) -> DataFrame:
    """(qid, doc, score, rank): the best ``k`` documents of each query with a score above zero; ties by document key. Queries count each of their terms once.

    ``key`` tells documents apart.  Only tokens that some query asks for leave their document; frequencies, lengths and the corpus mean are exact.  ``without`` is (qid, doc) never to be
    shown, a list short enough for a row of its query; ``hidden`` is (doc) shown to no query that has a ``qid``. Null texts have no token; a null query finds nothing.

    Documents are dealt to blocks and every query meets every block; only the ``k`` best of a block leave it, so what is moved grows with the documents and the queries, not with their pairs.
    """
    spark = docs.sparkSession
    q = cut(queries.select(F.col(qkey).alias("qid"), F.explode(F.array_distinct(search_tokens(qtext))).alias("term")).distinct(), "asked")
    terms = cut(numbered(q.select("term").distinct(), "term", name="t").select("term", F.col("t").cast("int").alias("t")), "terms")
    d = docs.select(F.col(key).alias("doc"), search_tokens(text).alias("toks")).withColumn("len", F.size("toks"))
    if hidden is not None:
        d = d.join(merged(hidden.select("doc").distinct().withColumn("hidden", F.lit(True))), "doc", "left")
    d = d.withColumn("hidden", F.coalesce("hidden", F.lit(False)) if hidden is not None else F.lit(False))
    p = d.select("doc", "len", "hidden", F.posexplode_outer("toks").alias("pos", "term")).join(small_or_merged(terms), "term", "left").where("t IS NOT NULL OR coalesce(pos, 0) = 0")
    p = cut(p.groupBy("doc", "len", "hidden").agg(F.collect_list("t").alias("toks")), "postings")  # a row a document, also where nothing of it is asked
    size, avgdl, postings = p.agg(F.count("*"), F.avg("len"), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    df = p.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(size) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    a = q.join(merged(terms), "term").join(merged(df), "t").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("t", idf.alias("idf")))).alias("terms"))
    none = F.array().cast(f"array<{p.schema['doc'].dataType.simpleString()}>")
    if without is None:
        a = a.withColumn("away", none)
    else:
        a = a.join(merged(without.groupBy("qid").agg(F.collect_set("doc").alias("away"))), "qid", "left").withColumn("away", F.coalesce("away", none))
    a = cut(a, "queries")

    shards = max(-(-postings // POSTINGS), min(spark.sparkContext.defaultParallelism, -(-postings // LEAST)), 1)
    blocks = max(-(-a.count() // QUERIES), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    norm = K1 * (1 - B + B * F.col("len") / F.lit(avgdl or 1.0))
    p = p.where(F.size("toks") > 0).select("doc", "toks", norm.alias("norm"), "hidden", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("s"), every(blocks).alias("b"))
    a = a.select("qid", "terms", "away", every(shards).alias("s"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("b"))
    apart = [x.repartition(2 * shards * blocks, "s", "b").groupBy("s", "b") for x in (p, a)]

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        return _best(docs, asked, k)

    hits = apart[0].cogroup(apart[1]).applyInArrow(run, StructType([a.schema["qid"], p.schema["doc"], StructField("score", DoubleType())])).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
