"""Sequential draws over one category at a time: whole threads while they fit, quotas with jitter.

A category is one group of the sequential step, which sees queues of senders cut to what a quota can reach (:func:`whole_threads`), so its size is bounded
by the quota, not by the category, and its result is that of the whole category.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.session import merged


def fill_threads(threads: pd.DataFrame) -> pd.DataFrame:
    """Takes whole threads of one topic up to its quota: longer threads first while they fit, then single mails, one sender a round.

    Only the head of a sender's queue is tried, so an oversized head blocks that sender.
    """
    quota = int(threads["quota"].iloc[0])
    took, total = [], 0
    for single in (False, True):
        t = threads[(threads["n"] == 1) == single].sort_values(["h", "thread_id"])
        queues = {s: list(g[["thread_id", "n"]].itertuples(index=False)) for s, g in t.groupby("sender", sort=False)}
        while queues and total < quota:
            progress = False
            for s in list(queues):
                head = queues[s][0]
                if total + head.n > quota:
                    del queues[s]  # the total never shrinks, so this head will never fit
                    continue
                took.append(head.thread_id)
                total += head.n
                progress = True
                queues[s].pop(0)
                if not queues[s]:
                    del queues[s]
                if total >= quota:
                    break
            if not progress:
                break
    return pd.DataFrame({"topic": threads["topic"].iloc[0], "thread_id": took})


def whole_threads(units: DataFrame, quotas: DataFrame, seed: int = 9) -> DataFrame:
    """(topic, thread_id): units are (topic, thread_id, sender, n).

    A sender's queue is cut after ``quota + 1`` threads: each thread taken adds a mail or more, and the one after the last may only block.  A sender whose first head
    has ``v`` mails is passed over once the room is under ``v``, and the room only shrinks; so of the senders with such a head, in order, ``quota / v`` are taken
    at most and all after the next are passed over. Both cuts therefore change nothing.
    """
    u = units.join(quotas, "topic").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "thread_id"))).withColumn("single", F.col("n") == 1)
    own = Window.partitionBy("topic", "single", "sender").orderBy("h", "thread_id")
    u = u.withColumn("r", F.row_number().over(own)).where(F.col("r") <= F.col("quota") + 1)
    heads = u.where("r = 1 AND n <= quota").select("topic", "single", "sender", "n", F.col("h").alias("hh"), F.col("thread_id").alias("ht"), (F.floor(F.col("quota") / F.col("n")) + 1).alias("most"))
    block = F.pmod(F.xxhash64("sender"), F.lit(64))
    for part in (Window.partitionBy("topic", "single", "n", block), Window.partitionBy("topic", "single", "n")):
        heads = heads.withColumn("k", F.row_number().over(part.orderBy("hh", "ht"))).where(F.col("k") <= F.col("most"))
    u = u.join(merged(heads.select("topic", "single", "sender")), ["topic", "single", "sender"], "left_semi")
    return u.select("topic", "thread_id", "sender", "n", "h", "quota").groupBy("topic").applyInPandas(fill_threads, "topic string, thread_id string")


def reserve(quotas: DataFrame, planted: DataFrame) -> DataFrame:
    """(topic, quota, planted, remaining, too_many): quotas (topic, quota) less what is planted (topic, planted) already; a topic without a plant keeps its quota."""
    n = F.coalesce("planted", F.lit(0)).cast("long")
    out = quotas.join(planted, "topic", "left").select("topic", "quota", n.alias("planted"))
    return out.withColumn("remaining", F.col("quota") - F.col("planted")).withColumn("too_many", F.col("remaining") < 0)


def reserved(quotas: DataFrame, planted: DataFrame) -> DataFrame:
    """:func:`reserve`, raising where a topic has more planted than places."""
    out = reserve(quotas, planted)
    bad = [r["topic"] for r in out.where("too_many").orderBy("topic").limit(3).collect()]
    if bad:
        raise ValueError(f"more planted than places: {bad}")
    return out


def jittered(quotas: dict[str, int], jitter: int, seed: int, pools: dict[str, int]) -> dict[str, int]:
    """Each quota moved by up to ``jitter`` either way inside its pool; the total stays. A fixed vocabulary of topics, driver-side."""
    import hashlib

    draw = lambda t: int(hashlib.md5(f"{seed}:{t}".encode()).hexdigest(), 16) % (2 * jitter + 1) - jitter
    out = {t: max(0, min(pools.get(t, 0), q + draw(t))) for t, q in sorted(quotas.items())}
    gap = sum(quotas.values()) - sum(out.values())
    order = sorted(out, key=lambda t: hashlib.md5(f"{seed}:order:{t}".encode()).hexdigest())
    while gap:
        moved = False
        for t in order:
            step = 1 if gap > 0 else -1
            if gap and 0 <= out[t] + step <= pools.get(t, 0) and abs(out[t] + step - quotas[t]) <= max(jitter, 1):
                out[t] += step
                gap -= step
                moved = True
        if not moved:
            raise ValueError(f"the jittered quotas miss their total by {gap}: the pools leave no room inside the jitter")
    return out
