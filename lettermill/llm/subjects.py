"""Subject areas of every mail.

Averaged word, word-pair and subword embeddings feed one independent logistic output an area.  The model is fitted on a bounded sample of labelled
mails (``TRAIN_MAILS``, a parameter): hand labels count fully for all mails of their thread, the unreliable label column counts as a soft share of its thread
at a low weight.  The sample lies in ``SHARDS`` shards; in each round every shard runs one epoch of AdaGrad from the common parameters and the
changes of the touched rows are averaged over the shards.  Then every mail is scored: the logits of all words of a thread's mails are
averaged, so a thread gets its areas from all its text, and each mail has the areas of its thread.

Defined results: null subject and body are empty; a mail without a thread is a thread of its own; a thread without a telling word is ``other``,
which stands alone; rows repeated under one id count once in the result; rows with a null id are dropped; extra columns are ignored; an empty mailbox
gives no rows, a mailbox without any label gives ``other`` for all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import label_key
from lettermill.session import cut, spread

DIM = 24
BUCKETS = 1 << 17  # rows of the embedding table: words, word pairs and subwords are hashed into it
SHARDS, ROUNDS, RATE = 6, 6, 0.5
TRAIN_MAILS = 24_000  # bound on the fitting sample, hand-labelled threads first
LEAST_WORDS = 12
HAND, SOFT = 3.0, 0.5
FIRST, SECOND, RATIO = 0.1, 0.05, 0.15  # least probability of the best area, of a second one, and of the second against the best
OTHER = "other"
WORD = re.compile(r"[a-z]+")


def _hash(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


class Units:
    """word -> number; each number has an own row and the rows of its subwords."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def __getitem__(self, w: str) -> int:
        i = self.index.get(w)
        if i is None:
            i = self.index[w] = len(self.rows)
            p = f"<{w}>"
            self.rows.append(np.array([_hash(w), *(_hash("#" + p[k : k + 5]) for k in range(max(1, len(p) - 4)))], np.int32))
        return i


def _pairs(words: np.ndarray) -> np.ndarray:
    """Rows of the adjacent pairs, from the words' own rows."""
    a, b = words[:-1].astype(np.uint64), words[1:].astype(np.uint64)
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.int32)


def start(n_topics: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(3)
    return {
        "E": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "W": rng.normal(0, 0.1, (DIM, n_topics)).astype(np.float32), "b": np.full(n_topics, -3, np.float32),
        "gE": np.zeros(BUCKETS, np.float32), "gW": np.zeros((DIM, n_topics), np.float32), "gb": np.zeros(n_topics, np.float32),
    }


def epoch(m: dict[str, np.ndarray], texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """One epoch of AdaGrad over a shard, in place; returns the rows of E it touched."""
    units, docs = Units(), []
    for t in texts:
        w = np.array([units[x] for x in WORD.findall(t)], np.int32)
        docs.append(w)
    own = np.array([r[0] for r in units.rows], np.int32) if units.rows else np.empty(0, np.int32)
    # a word's vector is its own row plus the mean of its subwords
    sub = [r[1:] for r in units.rows]
    touched = set()
    order = np.random.default_rng(seed).permutation(len(docs))
    E, W = m["E"], m["W"]
    for lo in range(0, len(order), 64):
        bt = [i for i in order[lo : lo + 64] if len(docs[i])]
        if not bt:
            continue
        words = np.concatenate([docs[i] for i in bt])
        d = np.repeat(np.arange(len(bt)), [len(docs[i]) for i in bt])
        pairs = [_pairs(own[docs[i]]) for i in bt]
        p = np.concatenate(pairs)
        dp = np.repeat(np.arange(len(bt)), [len(x) for x in pairs])
        size = np.bincount(d, minlength=len(bt)) + np.bincount(dp, minlength=len(bt))
        uw, iw = np.unique(words, return_inverse=True)
        up, ip = np.unique(p, return_inverse=True)
        subs = np.concatenate([sub[i] for i in uw])
        ds = np.repeat(np.arange(len(uw)), [len(sub[i]) for i in uw])
        ns = np.bincount(ds, minlength=len(uw)).astype(np.float32)
        S = np.zeros((len(uw), DIM), np.float32)
        np.add.at(S, ds, E[subs])
        V = np.concatenate([E[own[uw]] + S / ns[:, None], E[up]])
        C = np.zeros((len(bt), len(V)), np.float32)
        np.add.at(C, (d, iw), 1)
        np.add.at(C, (dp, len(uw) + ip), 1)
        C /= size[:, None]
        H = C @ V
        P = 1 / (1 + np.exp(-(H @ W + m["b"])))
        G = ((P - y[bt]) * weight[bt][:, None]).astype(np.float32)
        gW, gb, gV = H.T @ G, G.sum(0), C.T @ (G @ W.T)
        for k, g in (("W", gW), ("b", gb)):
            m["g" + k] += g * g
            m[k] -= RATE * 0.2 * g / (np.sqrt(m["g" + k]) + 1e-6)
        rows = np.concatenate([own[uw], up, subs])
        grad = np.concatenate([gV[: len(uw)], gV[len(uw) :], (gV[: len(uw)] / ns[:, None])[ds]])
        u, inv = np.unique(rows, return_inverse=True)
        acc = np.zeros((len(u), DIM), np.float32)
        np.add.at(acc, inv, grad)
        m["gE"][u] += (acc * acc).mean(1)
        E[u] -= RATE * acc / (np.sqrt(m["gE"][u])[:, None] + 1e-6)
        touched.update(u.tolist())
    return np.array(sorted(touched), np.int64)


def _text() -> F.Column:
    return F.lower(F.concat(F.coalesce("subject", F.lit("")), F.lit(" . "), F.coalesce("body", F.lit(""))))


def _thread() -> F.Column:
    return F.coalesce("thread_id", F.concat(F.lit("\x00"), "email_id"))


def training_rows(mailbox: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(shard, email_id, text, y, w): the bounded fitting sample."""
    vocab = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(re.sub(r"\s+", " ", n.lower().replace("_", " ").replace("&", "and")).strip()), F.lit(i))]) if names else F.create_map(F.lit(""), F.lit(0))
    where = mailbox.select("email_id", _thread().alias("thread")).distinct()
    hand = labels.select("email_id", F.element_at(vocab, label_key("topic")).alias("k")).where("k IS NOT NULL").join(where, "email_id").groupBy("thread").agg(F.collect_set("k").alias("hand"))
    soft = mailbox.select(_thread().alias("thread"), F.element_at(vocab, label_key("topic")).alias("k")).where("k IS NOT NULL").groupBy("thread", "k").agg(F.count("*").alias("n"))
    soft = soft.groupBy("thread").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("soft"), F.sum("n").alias("all"))
    target = hand.join(soft, "thread", "full")
    y = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.when(F.col("hand").isNotNull(), F.array_contains("hand", i).cast("float")).otherwise((F.coalesce(F.element_at("soft", i), F.lit(0)) / F.col("all")).cast("float")))
    target = target.select("thread", y.alias("y"), F.when(F.col("hand").isNotNull(), F.lit(HAND)).otherwise(F.lit(SOFT)).alias("w"))
    ids = mailbox.where(F.size(F.split(F.coalesce("body", F.lit("")), " ")) >= LEAST_WORDS).select("email_id", _thread().alias("thread")).dropDuplicates(["email_id"])
    ids = ids.join(target, "thread").withColumn("h", F.xxhash64("email_id"))
    ids = ids.orderBy(F.desc("w"), "h", "email_id").limit(TRAIN_MAILS).select("email_id", "y", "w", "h")
    texts = mailbox.select("email_id", _text().alias("text"))
    return ids.join(texts, "email_id").groupBy("email_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("w").alias("w"), F.first("h").alias("h")).withColumn("shard", F.pmod("h", F.lit(SHARDS)))


DELTAS = "rows binary, delta binary, squares binary, rest binary"


def merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shards' changes as one: each row's mean over the shards that touched it, the outputs' mean over all. At most BUCKETS rows a shard."""
    n, delta, squares = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS, np.float32)
    for r, d, q in zip(pdf["rows"], pdf["delta"], pdf["squares"]):
        i = np.frombuffer(r, np.int32)
        n[i] += 1
        delta[i] += np.frombuffer(d, np.float16).reshape(len(i), DIM)
        squares[i] += np.frombuffer(q, np.float32)
    i = np.flatnonzero(n)
    rest = np.mean([np.frombuffer(x, np.float32) for x in pdf["rest"]], axis=0)
    return pd.DataFrame({"rows": [i.astype(np.int32).tobytes()], "delta": [(delta[i] / n[i, None]).astype(np.float16).tobytes()], "squares": [(squares[i] / n[i]).astype(np.float32).tobytes()], "rest": [rest.astype(np.float32).tobytes()]})


def fit(rows: DataFrame, n_topics: int) -> dict[str, np.ndarray]:
    """Rounds of one epoch a shard; after each the shards' changes are averaged by one task, and their mean alone reaches the driver. A shard holds at most a share of TRAIN_MAILS."""
    spark = rows.sparkSession
    model = start(n_topics)
    for r in range(ROUNDS):  # one() runs before r and shared change
        shared = spark.sparkContext.broadcast(model)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            m = {k: v.copy() for k, v in shared.value.items()}
            pdf = pdf.sort_values("email_id")
            rows_ = epoch(m, pdf["text"].tolist(), np.stack(pdf["y"].to_numpy()).astype(np.float32), pdf["w"].to_numpy(np.float32), r)
            rest = np.concatenate([(m[k] - shared.value[k]).ravel() for k in ("W", "b", "gW", "gb")]).astype(np.float32)
            delta = (m["E"][rows_] - shared.value["E"][rows_]).astype(np.float16)
            squares = (m["gE"][rows_] - shared.value["gE"][rows_]).astype(np.float32)
            return pd.DataFrame({"rows": [rows_.astype(np.int32).tobytes()], "delta": [delta.tobytes()], "squares": [squares.tobytes()], "rest": [rest.tobytes()]})

        parts = rows.groupBy("shard").applyInPandas(one, DELTAS).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, DELTAS).collect()
        if not parts:
            return model
        p = parts[0]
        i = np.frombuffer(p["rows"], np.int32)
        model["E"][i] += np.frombuffer(p["delta"], np.float16).reshape(len(i), DIM)
        model["gE"][i] += np.frombuffer(p["squares"], np.float32)
        rest = np.frombuffer(p["rest"], np.float32)
        at = 0
        for k in ("W", "b", "gW", "gb"):
            model[k] += rest[at : at + model[k].size].reshape(model[k].shape)
            at += model[k].size
        shared.destroy()
    return model


def scores(texts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The columns of ``texts`` but its last, ``text``, and ``n`` and ``z``: the number of terms and the sum of their logits."""
    spark = texts.sparkSession
    n_topics = model["W"].shape[1]
    # fixed size: BUCKETS rows; summed without the threaded library, whose buffers would stay with the driver
    table = spark.sparkContext.broadcast(np.einsum("ij,jk->ik", model["E"], model["W"]).astype(np.float16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        T = table.value.astype(np.float32)
        units, own, full = Units(), np.empty(0, np.int32), np.empty((0, n_topics), np.float32)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                part = whole.slice(lo, 1024)
                flat: list[int] = []
                size = []
                get = units.__getitem__
                for t in part.column(part.num_columns - 1).to_pylist():
                    w = WORD.findall(t)
                    flat.extend(map(get, w))
                    size.append(len(w))
                if len(units.rows) > len(own):
                    new = units.rows[len(own) :]
                    own = np.concatenate([own, np.array([r[0] for r in new], np.int32)])
                    full = np.concatenate([full, np.stack([T[r[0]] + T[r[1:]].mean(0) for r in new])])
                z = np.zeros((part.num_rows, n_topics), np.float32)
                n = np.maximum(2 * np.array(size, np.int64) - 1, 0)
                if flat:
                    idx = np.array(flat, np.int64)
                    val = full[idx]
                    val[:-1] += T[_pairs(own[idx])]
                    ends = np.cumsum(size)
                    # the pair across two texts is taken off again
                    cross = ends[(ends < len(idx)) & (np.array(size) > 0)] - 1
                    val[cross] -= T[_pairs(own[idx])[cross]]
                    some = np.flatnonzero(size)
                    z[some] = np.add.reduceat(val, (ends - size)[some], axis=0)
                if len(units.rows) > 300_000:
                    units, own, full = Units(), np.empty(0, np.int32), np.empty((0, n_topics), np.float32)
                off = pa.array(np.arange(0, (part.num_rows + 1) * n_topics, n_topics, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n), pa.ListArray.from_arrays(off, pa.array(z.ravel()))], names=[*part.schema.names[:-1], "n", "z"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(run, f"{kinds}, n long, z array<float>")


def trained(mailbox: DataFrame, labels: DataFrame, topics: DataFrame) -> tuple[dict[str, np.ndarray], list[str]]:
    """The fitted model and its areas. ``topics`` is the label vocabulary, a fixed list."""
    names = [r[0] for r in topics.where(F.col("topic").isNotNull()).select("topic").distinct().orderBy("topic").collect()]
    return fit(cut(training_rows(mailbox.where(F.col("email_id").isNotNull()), labels, names), "fit"), len(names)), names


def _probabilities(model: dict[str, np.ndarray], names: list[str], z) -> F.Column:
    """Areas but ``other`` with their probabilities, best first; ``z(i)`` is the summed logit of area ``i`` over ``n`` terms."""
    p = [F.struct((1 / (1 + F.exp(-(z(i) / F.greatest("n", F.lit(1)) + F.lit(float(model["b"][i])))))).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(names) if t != OTHER]
    return F.reverse(F.array_sort(F.array(*p)))


def areas(mailbox: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """(email_id, topic): every area of every mail."""
    mailbox = mailbox.where(F.col("email_id").isNotNull())
    model, names = trained(mailbox, labels, topics)
    scored = scores(spread(mailbox.select("email_id", _thread().alias("thread"), _text().alias("text"))), model)
    scored = cut(scored, "scored")
    sums = scored.groupBy("thread").agg(F.sum("n").alias("n"), *[F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(len(names))])
    ranked = sums.select("thread", _probabilities(model, names, lambda i: F.col(f"z{i}")).alias("r")).select("thread", F.col("r")[0].alias("a"), F.col("r")[1].alias("b"))
    second = (F.col("b.p") >= SECOND) & (F.col("b.p") >= RATIO * F.col("a.p"))
    chosen = ranked.select("thread", F.when(F.col("a.p") < FIRST, F.array(F.lit(OTHER))).when(second, F.array("a.t", "b.t")).otherwise(F.array("a.t")).alias("topics"))
    return scored.select("email_id", "thread").distinct().join(chosen, "thread").select("email_id", F.explode("topics").alias("topic")).distinct()
