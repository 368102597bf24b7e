"""Own words of a mail: drops repeated and passed-on mails, signatures and notices.

One pass over the bodies gives every line a code and every sentence a 64-bit SimHash of its words (read on, marks taken off, so rewrapped quotes give the
same sentences).  Three kinds of evidence then come from all mails:

* a sentence is inherited when an earlier mail of its thread holds a near copy: equal fingerprints meet at once, near ones of five words or more through Hamming
  tables (the fingerprint in eight bytes, a table each, keyed with the thread), and a candidate counts only if the edit distance of the two normalised
  sentences is at most ``EDIT`` of the longer one; shorter sentences (greetings, closings, names) count only in one run with longer ones of the same earlier mail;
* a long sentence is inherited from outside the thread when its first mail by date lies in another thread, has an earlier date and another sender; such sentences
  count only where they run without a break, from the first words of that mail, below words of the sender's own and above no signature;
* a line is boilerplate when the tails of several mails, of the same sender or of others, carry its fingerprint.

The evidence takes lines out by itself; the codes bound the regions (separators, headers, marks, which have no earlier copy) and decide alone only
where a passed-on mail has no earlier copy in the table or a signature stands in a single mail of its sender.

Defined results: a null or empty body gives no lines; rows repeated under one email_id give each line once; a null thread or position gives no
inherited sentences of a thread, a null date or sender none from outside it; rows with a null id are dropped; extra columns are ignored; bodies are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm import mail_lines as ml
from lettermill.session import cut, merged, spread

LEAST_WORDS = 5  # words of a sentence that is evidence by itself
STRONG = 10  # words of a sentence that is evidence without any mark around it
EDIT = 0.15
NEAR = 6  # most differing bits of a candidate; eight tables find all up to seven
WORD = re.compile(r"[a-z0-9]+")
_VOCAB = 300_000
SCHEMA = "email_id string, thread_id string, pos int, day int, who long, code string, first array<int>, last array<int>, size array<int>, sim array<long>, same array<long>, line array<int>, line_sim array<long>"


class _Words(dict):
    """word -> row of the bit table."""

    def __init__(self):
        self.hashes: list[int] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self.hashes)
        self.hashes.append(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little"))
        return i


class Fingerprints:
    """SimHash and an order-keeping hash of word lists, many at a time."""

    def __init__(self):
        self._reset()

    def _reset(self) -> None:
        self.words = _Words()
        self.bits = np.empty((0, 64), np.int8)
        self.hashes = np.empty(0, np.uint64)

    def __call__(self, flat: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if not sizes:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = len(self.hashes)
        if len(self.words.hashes) > known:
            new = np.array(self.words.hashes[known:], np.uint64)
            self.hashes = np.concatenate([self.hashes, new])
            self.bits = np.concatenate([self.bits, (np.unpackbits(new.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1)])
        idx = np.array(flat, np.int64)
        off = np.zeros(len(sizes), np.int64)
        np.cumsum(sizes[:-1], out=off[1:])
        total = np.add.reduceat(self.bits[idx], off, axis=0, dtype=np.int16)
        sim = np.ascontiguousarray(np.packbits(total > 0, axis=1)).view(np.int64).ravel()
        at = np.arange(len(idx), dtype=np.uint64) - np.repeat(off, sizes).astype(np.uint64)
        h = self.hashes[idx] * (at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) | np.uint64(1))
        same = np.add.reduceat(h ^ (h >> np.uint64(29)), off).view(np.int64)
        if len(self.words.hashes) > _VOCAB:
            self._reset()
        return sim, same


def _lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints = Fingerprints()
    for whole in batches:
        for lo in range(0, whole.num_rows, 1024):
            part = whole.slice(lo, 1024)
            get = prints.words.__getitem__
            codes, first, last, n_sent, flat, sizes = [], [], [], [], [], []
            line, n_line, l_flat, l_sizes = [], [], [], []
            for sender, body in zip(part.column("sender").to_pylist(), part.column("body").to_pylist()):
                lines = ml.split_lines(body)
                code = ml.sender_marks(lines, ml.codes(lines), sender or "")
                k = 0
                for a, b, text in ml.sentences(lines, code):
                    w = WORD.findall(text.lower())
                    if w:
                        flat.extend(map(get, w))
                        sizes.append(len(w))
                        first.append(a)
                        last.append(b)
                        k += 1
                n_sent.append(k)
                # lines from the first closing or signature on, ahead of the first quote, may be boilerplate
                k, t = 0, len(lines)
                for i, c in enumerate(code):
                    if c in "sunaq":
                        break
                    if i < t:
                        if c not in "cdxFfrk":
                            continue
                        t = i
                    if c in "bcg":  # greetings and closings are own text, however often they stand
                        continue
                    w = WORD.findall(lines[i].lower()) or [lines[i].strip()[:8]]
                    l_flat.extend(map(get, w))
                    l_sizes.append(len(w))
                    line.append(i)
                    k += 1
                n_line.append(k)
                codes.append(code)
            both = prints(flat + l_flat, sizes + l_sizes)
            sim, same = both[0][: len(sizes)], both[1][: len(sizes)]
            l_sim, l_same = both[0][len(sizes) :], both[1][len(sizes) :]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in ("email_id", "thread_id", "pos", "day", "who")), pa.array(codes, pa.string()), _lists(np.array(first, np.int32), n_sent, pa.int32()), _lists(np.array(last, np.int32), n_sent, pa.int32()), _lists(np.array(sizes, np.int32), n_sent, pa.int32()), _lists(sim, n_sent, pa.int64()), _lists(same, n_sent, pa.int64()),
                 _lists(np.array(line, np.int32), n_line, pa.int32()), _lists(l_sim ^ l_same, n_line, pa.int64())],
                names=["email_id", "thread_id", "pos", "day", "who", "code", "first", "last", "size", "sim", "same", "line", "line_sim"],
            )


def _evidence(code: str, first: list[int], last: list[int], size: list[int], hits: dict[int, int], outside: dict[int, bool]) -> list[int]:
    """For each line 0, 1 or 2: at least half of its words stand in inherited sentences; 2 where one of these has ``STRONG`` words or more.

    ``hits`` gives a sentence the position of the earlier mail, ``outside`` the sentences first seen in another thread, true where that mail begins with it.
    """
    n = len(code)
    hit = [0] * n
    if not hits and not outside:
        return hit
    src = dict(hits)
    for u in _passed_on(code, first, last, size, src, outside):
        src.setdefault(u, 0)
    all_, got, strong, origin, weak = [0.0] * n, [0.0] * n, [False] * n, [0] * n, [0] * n
    for u in range(len(first)):
        share = size[u] / (last[u] - first[u] + 1)
        for x in range(first[u], last[u] + 1):
            all_[x] += share
            if u in src:
                if size[u] >= LEAST_WORDS:
                    got[x] += share
                    strong[x] |= size[u] >= STRONG
                    origin[x] = max(origin[x], src[u])
                else:
                    weak[x] = src[u]
    for x in range(n):
        if got[x] and got[x] >= 0.5 * all_[x]:
            hit[x] = 2 if strong[x] else 1
    # short sentences join a run of the same earlier mail: downwards from a hit, and upwards to its greeting
    above = -1
    for x in range(n):
        if code[x] == "b":
            continue
        if not hit[x] and weak[x] and above >= 0 and hit[above] and weak[x] <= origin[above]:
            hit[x], origin[x] = 1, origin[above]
        above = x
    below = -1
    for x in range(n - 1, -1, -1):
        if code[x] == "b":
            continue
        if not hit[x] and weak[x] and below >= 0 and hit[below] and weak[x] == origin[below]:
            y = x - 1
            while y >= 0 and code[y] == "b":
                y -= 1
            if code[x] != "c" and (y < 0 or code[y] != "c"):  # the sender's own closing and name stand above what is passed on
                hit[x], origin[x] = 1, origin[below]
        below = x
    return hit


def _passed_on(code: str, first: list[int], last: list[int], size: list[int], src: dict[int, int], outside: dict[int, bool]) -> list[int]:
    """Of the sentences seen outside the thread, those that run without a break, from the first words of their mail, below a paragraph of the sender's own to the end of the body."""
    if not outside:
        return []
    own = next((u for u in range(len(first)) if size[u] >= LEAST_WORDS), None)
    if own is None or own in outside or own in src:
        return []
    if any(k in "dxFf" for k in code[first[min(outside)] :]):
        return []  # a signature below them: what stands above it is the sender's own
    run: list[int] = []
    for u in range(own + 1, len(first)):
        if u in outside:
            if not run and not (outside[u] and "b" in code[last[own] : first[u] + 1]):
                return []
            run.append(u)
        elif size[u] >= LEAST_WORDS and u not in src:
            if run:
                return []
            own = u
    return run if len(run) > 1 or any(size[u] >= 2 * STRONG for u in run) else []


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nos = [], []
        cols = [batch.column(c).to_pylist() for c in ("email_id", "code", "first", "last", "size", "hits", "outside", "boiler")]
        for email, code, first, last, size, hits, outside, boiler in zip(*cols):
            hit, boil = _evidence(code, first, last, size, {h >> 32: h & 0xFFFFFFFF for h in hits or ()}, {h >> 1: bool(h & 1) for h in outside or ()}), [False] * len(code)
            for x in boiler or ():
                boil[x] = True
            gone = ml.removed(code, hit, boil)
            ids.extend([email] * len(gone))
            nos.extend(gone)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32())], names=["email_id", "line_no"])


def read_mails(mailbox: DataFrame) -> DataFrame:
    """One row a mail: line codes and the fingerprints of its sentences and of the lines that may be boilerplate."""
    day = F.when(F.col("date").rlike(r"^\d{4}-\d\d-\d\d"), F.regexp_replace(F.substring("date", 1, 10), "-", "")) if "date" in mailbox.columns else F.lit(None)
    src = mailbox.where(F.col("email_id").isNotNull() & F.col("body").isNotNull()).select("email_id", "thread_id", F.col("thread_pos").cast("int").alias("pos"), day.cast("int").alias("day"), F.when(F.col("from").isNotNull(), F.xxhash64(F.lower("from"))).alias("who"), F.col("from").alias("sender"), "body")
    return spread(src).mapInArrow(_read, SCHEMA)


def inherited(mails: DataFrame, bodies: DataFrame) -> DataFrame:
    """(email_id, u, src): sentences, by number, of which an earlier mail of the thread, at position ``src``, holds a copy or near copy."""
    threaded = mails.where(F.col("thread_id").isNotNull() & F.col("pos").isNotNull())
    # a thread that only has first mails holds no later copy: neither side of the tables needs it
    answered = threaded.groupBy("thread_id").agg(F.max("pos").alias("top")).where("top > 1").select("thread_id")
    units = (
        threaded.join(merged(answered), "thread_id")
        .select("thread_id", "pos", "email_id", F.posexplode(F.arrays_zip("sim", "same", "size")).alias("u", "z"))
        .select(F.xxhash64("thread_id").alias("t"), "pos", "email_id", "u", "z.sim", "z.same", "z.size")
    )
    units = cut(units, "units")
    # equal sentences: the earliest place of each in its thread
    known = cut(units.groupBy("t", "same").agg(F.min(F.struct("pos", "email_id", "u", "sim", "size")).alias("e")).select("t", "same", "e.*"), "known")
    # near ones among the first places: one set of rows, keyed with the thread, is both sides of each table
    parts = F.array(*[F.shiftrightunsigned("sim", 8 * i).bitwiseAND(F.lit(255)) + F.lit(256 * i) for i in range(8)])
    keyed = known.where(F.col("size") >= LEAST_WORDS).select("t", "pos", "sim", "same", F.explode(parts.cast("array<int>")).alias("part"))
    a, b = merged(keyed.alias("a")), merged(keyed.alias("b"))
    near = (
        a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.part") == F.col("b.part")))
        .where((F.col("a.pos") < F.col("b.pos")) & (F.bit_count(F.col("a.sim").bitwiseXOR(F.col("b.sim"))) <= NEAR))
        .select(F.col("a.t").alias("t"), F.col("a.same").alias("sa"), F.col("a.pos").alias("src"), F.col("b.same").alias("sb"))
        .distinct()
    )
    place = merged(known.select("t", "same", "email_id", "u"))
    near = cut(near.join(place.toDF("t", "sa", "ea", "ua"), ["t", "sa"]).join(place.toDF("t", "sb", "eb", "ub"), ["t", "sb"]), "near")
    wanted = near.select(F.col("ea").alias("email_id"), F.col("ua").alias("u")).union(near.select("eb", "ub")).distinct()
    texts = merged(_texts(bodies, wanted))
    both = near.join(texts.toDF("ea", "ua", "xa"), ["ea", "ua"]).join(texts.toDF("eb", "ub", "xb"), ["eb", "ub"])
    true = both.where(F.levenshtein("xa", "xb") <= EDIT * F.greatest(F.length("xa"), F.length("xb"))).groupBy("t", F.col("sb").alias("same")).agg(F.min("src").alias("near"))
    prior = known.select("t", "same", F.col("pos").alias("equal")).join(merged(true), ["t", "same"], "left")
    later = units.where("pos > 1").select("t", "same", "pos", "email_id", "u").join(merged(prior), ["t", "same"])
    src = F.least(F.expr("CASE WHEN equal < pos THEN equal END"), F.expr("CASE WHEN near < pos THEN near END"))
    return later.select("email_id", "u", src.alias("src")).where("src IS NOT NULL")


def outside(mails: DataFrame) -> DataFrame:
    """(email_id, u, head): long sentences whose first mail by date lies in another thread, with an earlier date and another sender; does that mail begin with it?"""
    known = mails.where(F.col("day").isNotNull() & F.col("who").isNotNull())
    t = F.xxhash64(F.coalesce("thread_id", F.concat(F.lit("\x00"), "email_id"))).alias("t")
    begins = F.array_position(F.transform("size", lambda n: n >= LEAST_WORDS), True) - 1
    units = known.select("email_id", t, "day", "who", begins.alias("begins"), F.posexplode(F.arrays_zip("same", "size")).alias("u", "z")).where(F.col("z.size") >= STRONG).select("email_id", "t", "day", "who", "u", (F.col("u") == F.col("begins")).alias("head"), "z.same")
    # a mail passed on is repeated from its first words; a mail sent again with edits is the new sender's own
    firsts = units.groupBy("same").agg(F.min(F.struct("day", "t", "who", "head")).alias("e"), F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 <> t1").select("same", "e")
    return units.join(merged(firsts), "same").where("e.day < day AND e.t <> t AND e.who <> who").select("email_id", "u", F.col("e.head").alias("head"))


def _texts(bodies: DataFrame, wanted: DataFrame) -> DataFrame:
    """(email_id, u, text): the normalised text of single sentences; only mails that hold a candidate are read again."""
    per_mail = wanted.groupBy("email_id").agg(F.collect_set("u").alias("us"))
    src = bodies.where(F.col("body").isNotNull()).select("email_id", F.col("from").alias("sender"), "body").join(per_mail, "email_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos, texts = [], [], []
            for e, s, body, us in zip(*(batch.column(c).to_pylist() for c in ("email_id", "sender", "body", "us"))):
                lines = ml.split_lines(body)
                want, k = set(us), 0
                for _, _, text in ml.sentences(lines, ml.sender_marks(lines, ml.codes(lines), s or "")):
                    w = WORD.findall(text.lower())
                    if w:
                        if k in want:
                            ids.append(e)
                            nos.append(k)
                            texts.append(" ".join(w))
                        k += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(texts, pa.string())], names=["email_id", "u", "text"])

    return src.mapInArrow(run, "email_id string, u int, text string").dropDuplicates(["email_id", "u"])


def boilerplate(mails: DataFrame) -> DataFrame:
    """(email_id, x): lines of the tail, by number, that the tails of several mails of the sender carry, or the tails of several senders."""
    lines = mails.select("email_id", F.coalesce("who", F.xxhash64("email_id")).alias("who"), F.explode(F.arrays_zip("line", "line_sim")).alias("z")).select(F.xxhash64("email_id").alias("m"), "email_id", "who", F.col("z.line").alias("x"), F.col("z.line_sim").alias("sim"))
    common = lines.groupBy("sim").agg(F.min("m").alias("m0"), F.max("m").alias("m1")).where("m0 < m1").select("sim")
    return lines.join(merged(common), "sim").select("email_id", "x")


def lines_to_remove(mailbox: DataFrame) -> DataFrame:
    """(email_id, line_no): the lines of each body that its sender did not newly write."""
    mails = cut(read_mails(mailbox), "mails")
    hits = inherited(mails, mailbox).groupBy("email_id").agg(F.collect_list(F.shiftleft(F.col("u").cast("long"), 32).bitwiseOR(F.col("src"))).alias("hits"))
    away = outside(mails).groupBy("email_id").agg(F.collect_list(F.col("u") * 2 + F.col("head").cast("int")).alias("outside"))
    boil = boilerplate(mails).groupBy("email_id").agg(F.collect_set("x").alias("boiler"))
    asked = mails.select("email_id", "code", "first", "last", "size")
    for part in (hits, away, boil):
        asked = asked.join(merged(part), "email_id", "left")
    return asked.mapInArrow(_decide, "email_id string, line_no int").distinct()


def own_bodies(mailbox: DataFrame, gone: DataFrame) -> DataFrame:
    """(email_id, own_body): each body without the lines of ``gone``; blank lines at its ends fall away."""
    nos = gone.groupBy("email_id").agg(F.collect_set("line_no").alias("nos"))
    bodies = mailbox.where(F.col("email_id").isNotNull()).groupBy("email_id").agg(F.max("body").alias("body")).join(nos, "email_id", "left")
    kept = F.filter(F.transform(F.split("body", "\n"), lambda x, i: F.when(F.array_contains(F.coalesce("nos", F.array().cast("array<int>")), i + 1), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return bodies.select("email_id", F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "").alias("own_body"))
