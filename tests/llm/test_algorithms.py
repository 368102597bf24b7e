"""Names, near duplicates and quota samples against brute force and small cases with known answers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lettermill.llm import classes, metric_join, name_link, quota_sample, tensor_banding


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- quota samples


def _draw(spark, pool_rows, alloc, floor=1):
    pool = quota_sample.categorised(spark.createDataFrame(pool_rows, "email_id string, topic string"), spark.createDataFrame([("law",), ("food and drink",), ("other",)], "topic string"), "email_id", "topic", "topic")
    m = spark.createDataFrame([(1, alloc, floor, 7)], "draw_id int, alloc map<string,long>, min_per_topic long, seed long")
    asked = quota_sample.requests(m)
    return quota_sample.draw(pool, asked), quota_sample.report(pool, asked, quota_sample.draw(pool, asked))


def test_sample_meets_targets_and_reports(spark):
    pool = [(f"a{i}", " LAW ") for i in range(300)] + [(f"b{i}", "food_&_drink") for i in range(3)] + [("a0", "law"), (None, "law"), ("z", None), ("y", "nonsense")]
    drawn, report = _draw(spark, pool, {"law": 40, "food and drink": 5, "other": 0}, floor=2)
    assert {r.topic: r.n for r in drawn.groupBy("topic").agg(F.count("*").alias("n")).collect()} == {"law": 40, "food and drink": 3}
    assert drawn.select("id").distinct().count() == 43
    assert rows(report, "topic", "target", "available", "drawn", "met") == [("food and drink", 5, 3, 3, False), ("law", 40, 300, 40, True), ("other", 2, 0, 0, False)]


def test_sample_of_an_empty_pool(spark):
    drawn, report = _draw(spark, [], {"law": 2})
    assert drawn.count() == 0 and rows(report, "topic", "met") == [("law", False)]


# ---- near duplicates


def _pairs(mails):
    sets = {}
    for e, t, s, b in mails:
        w = tensor_banding.WORD.findall(((s or "") + " " + (b or "")).lower())
        if e is not None and len(w) >= 40:
            sets[e] = (t, set(zip(w, w[1:], w[2:])))
    return sorted((a, b) for a in sets for b in sets if a < b and sets[a][0] != sets[b][0] and 2 * len(sets[a][1] & sets[b][1]) >= len(sets[a][1] | sets[b][1]))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    mails = []
    for i in range(40):
        base = rng.choices(vocab, k=90)
        mails.append((f"m{i:03}a", f"t{i}", "subject", " ".join(base)))
        for k in range(rng.randint(0, 3)):
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(90)] = rng.choice(vocab)
            mails.append((f"m{i:03}{'bcd'[k]}", f"t{rng.choice([i, i + 100 + k])}", None, "Subject, " + " ".join(words)))
    mails += [("e1", "x1", None, None), ("e2", "x2", "", ""), (None, "x3", "s", "b " * 60), mails[0], ("short1", "y1", "", "a b c"), ("short2", "y2", "", "a b c")]
    df = spark.createDataFrame([(*m, "extra") for m in mails], "email_id string, thread_id string, subject string, body string, id string")
    got = rows(tensor_banding.alike(df, "email_id", "thread_id"), "id_a", "id_b")
    want = _pairs(mails)
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 5


def test_sketches_lose_next_to_no_pair_at_the_threshold():
    """Of pairs of similarity 0.5, whose one-bit sketches differ in a quarter of their bits, less than one in 500 fails either sketch test."""
    over = lambda n, most: sum(math.comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(most + 1, n + 1))
    assert over(64, tensor_banding.NEAR_64) < 0.002 and over(128, tensor_banding.NEAR_128) < 0.002


def test_copies_in_other_threads_pair_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("a", "t1", "s", text), ("b", "t2", "s", text), ("c", "t1", "s", text), ("d", None, "s", text)], "email_id string, thread_id string, subject string, body string")
    assert rows(tensor_banding.alike(df, "email_id", "thread_id"), "id_a", "id_b") == [("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    assert tensor_banding.alike(df.limit(0), "email_id", "thread_id").count() == 0


def test_growing_sides_are_never_broadcast(spark):
    """The optimiser takes a table of keys for small, as it does not count ``explode``; the joins are hinted."""
    df = spark.createDataFrame([("a", "t1", "s", " ".join(f"w{i}" for i in range(50)))], "email_id string, thread_id string, subject string, body string")
    _, cls = tensor_banding._classes(df.select(F.col("email_id").alias("id"), F.col("thread_id").alias("grp"), F.col("body").alias("text")))
    for plan in (tensor_banding.met(cls, 0.5), tensor_banding.alike(df, "email_id", "thread_id")):
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_one_text_in_a_third_of_the_rows(spark):
    """A hot class costs one row in the tables, and its members are listed, not paired."""
    n = 30_000
    text = F.when(F.col("id") % 3 == 0, F.lit(" ".join(f"w{i}" for i in range(60)))).otherwise(F.concat_ws(" ", *[F.concat(F.lit("v"), F.xxhash64("id", F.lit(k)).cast("string")) for k in range(45)]))
    df = spark.range(n).select(F.format_string("e%06d", "id").alias("email_id"), F.format_string("t%06d", "id").alias("thread_id"), F.lit("s").alias("subject"), text.alias("body"))
    df = df.union(spark.createDataFrame([("z", "tz", "s", " ".join(f"w{i}" for i in range(58)) + " x y")], df.schema))
    g = tensor_banding.groups(df, "email_id", "thread_id")
    big = g.where("copies > 1")
    assert g.count() == n + 1 and big.count() == n // 3 and big.select("class_id", "links", "group_id").distinct().collect() == [("e000000", 1, "e000000")]
    assert rows(g.where("id = 'z'"), "class_id", "copies", "links", "group_id") == [("z", 1, 1, "e000000")]


def test_blocks_of_a_class_give_every_pair(spark, monkeypatch):
    monkeypatch.setattr(classes, "BLOCK", 4)
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(f"e{i:02}", f"t{i // 2}", "s", text + (" x" if i % 3 else "")) for i in range(30)] + [("e00", "t0", "s", text)], "email_id string, thread_id string, subject string, body string")
    want = sorted((f"e{a:02}", f"e{b:02}") for a in range(30) for b in range(a + 1, 30) if a // 2 != b // 2)
    assert rows(tensor_banding.alike(df, "email_id", "thread_id"), "id_a", "id_b") == want

def test_a_notice_of_all_mails_brings_no_pairs_and_a_form_keeps_them(spark):
    """Candidates follow the alike pairs, not the square of the mails with one notice; letters alike by a frequent form are all found."""
    rng = random.Random(5)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    notice, form = own(40), own(60)
    mails = [(f"m{i:04}", f"t{i}", "s", " ".join(own(90) + notice)) for i in range(1500)]
    mails += [(f"z{i:04}", f"u{i}", "s", " ".join(b.split()[:70] + own(20) + notice)) for i, (_, _, _, b) in enumerate(mails[:50])]
    mails += [(f"f{i:04}", f"v{i}", "s", " ".join(form + own(15))) for i in range(60)]
    df = spark.createDataFrame(mails, "email_id string, thread_id string, subject string, body string")
    want = {(f"m{i:04}", f"z{i:04}") for i in range(50)} | {(f"f{a:04}", f"f{b:04}") for a in range(60) for b in range(a + 1, 60)}
    got = set(rows(tensor_banding.alike(df, "email_id", "thread_id"), "id_a", "id_b"))
    assert got <= want and len(got) >= 0.97 * len(want)
    _, cls = tensor_banding._classes(df.select(F.col("email_id").alias("id"), F.col("thread_id").alias("grp"), F.col("body").alias("text")))
    assert tensor_banding.met(cls, 0.5).count() < len(want) + 200


def test_left_out_shingles_leave_the_chance_to_meet():
    """The most frequent go first, a third of a text at most, and the right parts make up for them."""
    text = np.arange(1, 91, dtype=np.uint64)
    s, off = np.concatenate([text, text[:30]]), np.array([0, 90, 120])
    frequent = np.array([70, 5, 3, *range(20, 60)], np.uint64)  # the most frequent last
    rank = np.argsort(frequent)
    kept, at = tensor_banding._spared(s, off, frequent[rank], rank)
    assert at.tolist() == [0, 60, 80] and {3, 5, 70, *range(20, 30)} <= set(kept[:60].tolist()) and not set(range(30, 60)) & set(kept[:60].tolist())
    assert kept[60:].tolist() == [*range(1, 21)]
    for x in np.linspace(0, tensor_banding.SPARED, 20):
        alike, n = (1 - 1.5 * x) / (2 - 1.5 * x), tensor_banding._rights(np.array([x]))[0]
        assert n <= tensor_banding.RIGHT and (1 - (1 - alike) ** tensor_banding.LEFT) * (1 - (1 - alike**2) ** n) >= 0.96
    p = 0.5 * (1 - 0.5**tensor_banding.FINE)
    assert sum(math.comb(192, k) * p**k * (1 - p) ** (192 - k) for k in range(tensor_banding.NEAR_FINE + 1, 193)) < 0.002


# ---- names


def test_radius_join_against_brute_force(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcd", k=rng.randint(0, 9))) for _ in range(190)]

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    left, right = words[:110] + [None], words[80:]
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "key string")
    got = rows(metric_join.radius_join(df(left), df(right), 2, pivots=5), "l", "r", "dist")
    want = sorted({(a, b, dist(a, b)) for a in left if a is not None for b in right if dist(a, b) <= 2})
    assert got == want
    assert metric_join.radius_join(df(left), df([]), 2).count() == 0


def test_few_of_many_names_meet(spark):
    """Of 2,000 by 2,000 two-word names less than one pair in a hundred reaches the true metric."""
    rng = random.Random(3)
    part = lambda: "".join(rng.choice(["bra", "lo", "vent", "mi", "kas", "tor", "gu", "nel", "pir", "sho"]) for _ in range(3))
    names = [f"{part()} {part()}" for _ in range(2000)]
    typo = lambda w: w[: (i := rng.randrange(len(w)))] + rng.choice("xyz") + w[i + 1 :]
    df = lambda ws: spark.createDataFrame([(w,) for w in ws], "key string")
    left = df([typo(n) for n in names])
    assert metric_join.met(left, df(names), 2).count() < 0.01 * 2000 * 2000
    assert metric_join.radius_join(left, df(names), 2).select("l").distinct().count() == len({r.key for r in left.collect()})


def test_spellings_of_people_and_firms(spark):
    ann = ["margaret.raldpuwant@calderongas.example", "Margaret Raldpuwant", "Raldpuwant, Peggy", "Margaret L. Raldpuwant", "M. Raldpuwant", "Maragret Raldpuwant", "MARGARET RALDPUWANT/CGS/CALDERONGAS", "mraldpuwant@calderongas.example", "raldpuwant.margaret@calderongas.example", '"Raldpuwant, Margaret" <margaret.raldpuwant@calderongas.example>']
    bob = ["robert.yestdiokafu@ostlerpike.example", "Bob Yestdiokafu", "Yestdiokafu R."]
    org = ["notices@gulvfuoux.example", "Gulvfuoux Regional Hospital, Inc.", "The Gulvfuoux Reg. Hosp. Incorporated", "Gulvfuuox Regional Hospital", "Regional Hospital Co (Gulvfuoux)"]
    others = ["thomas.yestdiokafu@norvane.example", "susan.eltfiokafu@tessel.example", None, "", "?"]
    df = spark.createDataFrame([(x,) for x in ann + bob + org + others + ann[:2]], "spelling string")
    groups = {}
    for r in name_link.entities(df).collect():
        groups.setdefault(r.entity, set()).add(r.spelling)
    by = {frozenset(g) for g in groups.values()}
    assert {frozenset(ann), frozenset(bob), frozenset(org)} <= by
    pairs = name_link.variant_pairs(df)
    assert pairs.count() == 45 + 3 + 10 and pairs.where("a >= b").count() == 0


def test_firms_of_another_trade_stay_apart(spark):
    df = spark.createDataFrame([(x,) for x in ("Nabloland Valley Power Inc", "Nabloland Vly Pwr", "Abnoland Manufacturing Limited", "Manufacturing Ltd (Abnoland)", "Abnolnad Mfg")], "spelling string")
    assert rows(name_link.variant_pairs(df), "a", "b") == [("Abnoland Manufacturing Limited", "Abnolnad Mfg"), ("Abnoland Manufacturing Limited", "Manufacturing Ltd (Abnoland)"), ("Abnolnad Mfg", "Manufacturing Ltd (Abnoland)"), ("Nabloland Valley Power Inc", "Nabloland Vly Pwr")]


def test_no_names_at_all(spark):
    assert name_link.variant_pairs(spark.createDataFrame([], "spelling string")).count() == 0
