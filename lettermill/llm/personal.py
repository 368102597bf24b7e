"""Personal details in free text, found by a semi-Markov CRF and replaced by typed placeholders.

Three passes.  Word statistics of all mails and the name parts of all sender addresses become four hashed sets of fixed size, bitmaps (given names, surnames,
ordinary words, common capitalised words).  The CRF of :mod:`lettermill.llm.spans` is fitted on a bounded sample (``TRAIN_MAILS``, a parameter) whose
labels come from :mod:`lettermill.llm.distant`: the registry of sender names, the senders of a thread and telling words before a number, none of which is a
feature; a share of the known names (``HIDDEN``) is shown to the fit as unknown words, so that it learns names no sender bears.  Then the best segmentation of
every subject, body and sender of every mail is decoded.

Defined results: null or empty fields hold nothing; a detail that stands in a field several times is listed once for the field; rows repeated under one
email_id give each detail once; rows with a null id are dropped; overlapping readings give one segment; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.nicknames import FORMAL, SHORTS
from lettermill.llm import distant, spans
from lettermill.session import cut, spread

TRAIN_MAILS = 1_500
HIDDEN, HIDINGS = 0.3, 3
# least places of a word, as a share of the mails and at least a floor for small tables, to be ordinary though a name, small, and common in capitals
ORDINARY, SMALL, COMMON = (0.001, 20), (0.00005, 2), (0.002, 10)
ORDINARY_LOW = 0.05  # least share of small letters among the places of a word that is no name by itself
FIELDS = ("body", "subject", "from")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, low, cap): how often each word stands in small letters and capitalised; sums are emitted whenever the table has grown large."""
    low: Counter = Counter()

    def emit() -> pa.RecordBatch:
        w: dict[str, list[int]] = {}
        for t, n in low.items():
            w.setdefault(t.lower(), [0, 0])[0 if t[0].islower() else 1] += n
        low.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(w), pa.string()), pa.array([x[0] for x in w.values()], pa.int64()), pa.array([x[1] for x in w.values()], pa.int64())], names=["w", "low", "cap"])

    for batch in batches:
        for t in batch.column(0).to_pylist():
            low.update(_WORD.findall(t))
        if len(low) > 300_000:
            yield emit()
    yield emit()


def _bitmaps(sets: list[DataFrame]) -> tuple[bytes, ...]:
    """The hashed sets of a column ``w`` of each frame: bitmaps of ``spans.BITS`` bits, built in the aggregation; the driver gets that many bytes, whatever the number of words."""
    every = None
    for i, words in enumerate(sets):
        part = words.select(F.lit(i).alias("s"), (F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(spans.BITS)) + 1).cast("long").alias("b"))
        every = part if every is None else every.unionByName(part)
    out = [bytearray(spans.BITS // 8) for _ in sets]
    for r in every.groupBy("s", F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect():
        at = (r["k"] - 1) * len(r["m"])
        out[r["s"]][at : at + len(r["m"])] = r["m"]
    return tuple(map(bytes, out))


def word_stats(mailbox: DataFrame) -> DataFrame:
    """(w, low, cap): places of every word of subjects and bodies in small letters and capitalised."""
    texts = spread(mailbox.select(F.regexp_replace(F.concat_ws("\n", "subject", "body"), r"\S+@\S+", " ").alias("text")))
    return cut(texts.mapInArrow(_count, "w string, low long, cap long").groupBy("w").agg(F.sum("low").alias("low"), F.sum("cap").alias("cap")), "words")


def registry_pairs(mailbox: DataFrame) -> DataFrame:
    """(g, s): given name and surname of the sender addresses of two words; in each address the word that stands first with more partners is the given name."""
    local = F.regexp_extract(F.lower("from"), r"([a-z'-]{2,}[._](?:[a-z]\.)?[a-z'-]{2,})@", 1)
    parts = mailbox.select(F.split(F.regexp_replace(local, r"[._](?:[a-z]\.)?", "."), r"\.").alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b")).distinct()
    first = parts.groupBy(F.col("a").alias("w")).agg(F.count("*").alias("n1"))
    last = parts.groupBy(F.col("b").alias("w")).agg(F.count("*").alias("n2"))
    seats = first.join(last, "w", "full").select("w", (F.coalesce("n1", F.lit(0)) - F.coalesce("n2", F.lit(0))).alias("lead"))
    pairs = parts.join(seats.toDF("a", "la"), "a").join(seats.toDF("b", "lb"), "b")
    swap = F.col("lb") > F.col("la")
    return cut(pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("g"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("s")).distinct(), "pairs")


def word_classes(stats: DataFrame, pairs: DataFrame, n: int) -> tuple[bytes, ...]:
    """The four hashed word sets of :class:`spans.Words`."""
    seats = pairs.select(F.col("g").alias("w"), F.lit(1).alias("g"), F.lit(0).alias("s")).union(pairs.select("s", F.lit(0), F.lit(1))).groupBy("w").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    most = lambda x: max(x[0] * n, x[1])
    words = stats.join(seats.withColumn("name", F.lit(True)), "w", "full")
    both = F.col("low") + F.col("cap")
    ordinary = (F.col("low") >= most(ORDINARY)) & (F.col("low") >= 0.5 * both)
    small = F.col("name").isNull() & (F.col("low") >= most(SMALL)) & (F.col("low") >= 0.25 * both)
    common = F.col("name").isNull() & (F.col("cap") >= most(COMMON))
    kinds = F.array_compact(F.array(F.when(F.col("g") >= F.col("s"), 0), F.when(F.col("s") >= F.col("g"), 1), F.when(ordinary | small, 2), F.when(common, 3)))
    marked = cut(words.select("w", F.explode(kinds).alias("k")), "classes")
    return _bitmaps([marked.where(F.col("k") == k).select("w") for k in range(4)])


def registry(sample: DataFrame, mailbox: DataFrame, stats: DataFrame, pairs: DataFrame) -> distant.Registry:
    """What the tables say about the words of the sample: never more than the sample's own words and pairs of them."""
    text = F.lower(F.concat_ws(" ", "subject", "body", "sender"))
    words = cut(sample.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?U)(\p{L}[\p{L}'’-]*)"), F.lit(1))).alias("w")).distinct(), "sample-words")
    shorts = F.create_map(*[x for k, v in SHORTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    formal = F.create_map(*[F.lit(x) for k, v in FORMAL.items() for x in (k, v)])
    own = pairs.join(words.toDF("s"), "s").select(F.explode(F.concat(F.array("g", F.coalesce(F.element_at(formal, F.col("g")), F.col("g"))), F.coalesce(F.element_at(shorts, F.col("g")), F.array().cast("array<string>")))).alias("g"), "s").distinct()
    own = cut(own, "registry")
    heard = own.join(words.toDF("g"), "g")
    tokens = F.explode(F.regexp_extract_all(F.lower(F.split("from", "@")[0]), F.lit(r"([a-z'-]{2,})"), F.lit(1)))
    threads = sample.where("thread_id IS NOT NULL").select("thread_id").distinct()
    senders = mailbox.join(threads, "thread_id").select("thread_id", tokens.alias("w")).distinct().withColumn("w", F.coalesce(F.element_at(formal, F.col("w")), F.col("w"))).join(pairs.select(F.col("g").alias("w")).distinct(), "w").distinct()
    out = distant.Registry()
    out.pairs = {(r["g"], r["s"]) for r in heard.collect()}
    out.initials = {(r[0], r[1]) for r in own.select(F.substring("g", 1, 1), "s").union(pairs.join(words.toDF("g"), "g").select(F.substring("s", 1, 1), "g")).distinct().collect()}
    out.given = {r[0] for r in pairs.select(F.col("g").alias("w")).distinct().join(words, "w").collect()} | {*FORMAL, *SHORTS}
    out.surnames = {r["s"] for r in own.select("s").distinct().collect()}
    for r in senders.collect():
        out.thread.setdefault(r["thread_id"], set()).add(r["w"])
    out.ordinary = {r["w"] for r in stats.where((F.col("low") >= 2) & (F.col("low") >= ORDINARY_LOW * (F.col("low") + F.col("cap")))).join(words, "w").collect()}
    return out


def labelled(texts: list[tuple], words: spans.Words, known: distant.Registry, seen: set | None = None) -> tuple[list, set]:
    """Clusters of (thread, text, loose) with a label for every candidate, and the shapes seen after telling words."""
    found = [(thread, t, spans.clusters(t, words, loose)) for thread, t, loose in texts]
    seen = seen if seen is not None else distant.shapes((t, cs) for _, t, cs in found)
    out = []
    for thread, t, cs in found:
        for c in cs:
            y = distant.labels(t, c, thread, known, seen)
            if None not in y:
                out.append((c, y))
    return out, seen


def fitted(mailbox: DataFrame, classes, stats: DataFrame, pairs: DataFrame) -> dict[str, float]:
    """CRF weights from the bounded sample; one task fits them."""
    sample = cut(mailbox.orderBy(F.xxhash64("email_id"), "email_id").limit(TRAIN_MAILS).select("thread_id", "subject", "body", F.col("from").alias("sender")), "sample")
    known = mailbox.sparkSession.sparkContext.broadcast(registry(sample, mailbox, stats, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for b in batches:
            for thread, s, t, f in zip(*(c.to_pylist() for c in b.columns)):
                texts += [(thread, x, loose) for x, loose in ((s, False), (t, False), (f, True)) if x]
        data, seen = labelled(texts, spans.Words(*classes.value), known.value)
        for salt in range(HIDINGS):
            more, _ = labelled(texts, spans.Words(*classes.value, hidden=HIDDEN, salt=salt), known.value, seen)
            data += [x for x in more if any(k == "name" for _, _, k, _ in x[0].cands)]
        w = spans.train(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.string()), pa.array(list(w.values()), pa.float64())], names=["f", "w"])

    return {r["f"]: r["w"] for r in sample.repartition(1).mapInArrow(run, "f string, w double").collect()}


class Finder:
    """Decodes single texts; equal surroundings are decoded once."""

    def __init__(self, classes, weights: dict[str, float]):
        self.words, self.weights = spans.Words(*classes), spans.Scores(weights)
        self.memo: dict[tuple, list[tuple[int, int, str]]] = {}

    def __call__(self, text: str, loose: bool = False) -> list[tuple[int, int, str]]:
        out = []
        for s, e, group in spans.groups(text, self.words, loose):
            a, b = spans.surroundings(text, s, e)
            key = (text[a:b], s - a, e - a, loose, a == 0) if b - a <= 240 else None
            got = self.memo.get(key) if key else None
            if got is None:
                c = spans.build(text, group)
                got = [(x - a, y - a, k) for x, y, k in spans.decode(c, self.weights)] if c.cands else []
                if key:
                    if len(self.memo) >= 60_000:
                        self.memo.clear()
                    self.memo[key] = got
            out += [(x + a, y + a, k) for x, y, k in got]
        return out


def model(mailbox: DataFrame):
    """The fitted parts of the operator, as a broadcast of fixed size."""
    sc = mailbox.sparkSession.sparkContext
    stats, pairs = word_stats(mailbox), registry_pairs(mailbox)
    classes = sc.broadcast(word_classes(stats, pairs, mailbox.count()))
    return sc.broadcast((classes.value, fitted(mailbox, classes, stats, pairs)))


def found(mailbox: DataFrame) -> DataFrame:
    """(email_id, field, kind, value): each distinct personal detail of each field."""
    mailbox = mailbox.where(F.col("email_id").isNotNull())
    shared = model(mailbox)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(*shared.value)
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for field, col in zip(FIELDS, batch.columns[1:]):
                loose = field == "from"
                for e, t in zip(ids, col.to_pylist()):
                    if t:
                        rows += {(e, field, k, t[a:b]) for a, b, k in find(t, loose)}
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["email_id", "field", "kind", "value"])

    src = spread(mailbox.select("email_id", *FIELDS))
    return src.mapInArrow(run, "email_id string, field string, kind string, value string").distinct()


def redacted(mailbox: DataFrame) -> DataFrame:
    """The mails with each personal detail replaced by the placeholder of its type, all else untouched."""
    shared = model(mailbox.where(F.col("email_id").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(*shared.value)

        def clean(t: str | None, loose: bool) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for a, b, k in find(t, loose):
                out += [t[at:a], PLACEHOLDER[k]]
                at = b
            return "".join([*out, t[at:]])

        for batch in batches:
            cols = [pa.array([clean(t, f == "from") for t in c.to_pylist()], pa.string()) for f, c in zip(FIELDS, batch.columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["email_id", *FIELDS])

    src = spread(mailbox.where(F.col("email_id").isNotNull()).select("email_id", *FIELDS))
    return src.mapInArrow(run, "email_id string, body string, subject string, `from` string").distinct()
