"""Replays of recorded search sessions: budgets, acceptance of investigations, answer gates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions.text import jaccard, search_tokens

COUNTED = ("search", "read", "list")


def clean_log(log: DataFrame) -> DataFrame:
    """Calls in order, those recorded twice once."""
    return log.where("session_id IS NOT NULL AND seq IS NOT NULL").groupBy("session_id", "seq").agg(*[F.min(c).alias(c) for c in ("tool", "arg", "returned", "status")])


def with_budget(log: DataFrame, budget: int) -> DataFrame:
    """Each call with the counted calls so far and whether the budget still allowed it."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.col("tool").isin(*COUNTED).cast("long")).over(w)
    return log.withColumn("used", used).withColumn("allowed", (used <= budget) | ~F.col("tool").isin(*COUNTED))


def credit(log: DataFrame, limit: float = 0.8) -> DataFrame:
    """(session_id, credit): reads, and searches unlike every search accepted before in the session (Jaccard of their terms under ``limit``).

    The fold runs over one session's searches, an array as long as the session.
    """
    s = log.where("tool = 'search'").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.array_distinct(search_tokens("arg")).alias("t")))).alias("q"))
    none = F.expr("CAST(array() AS array<array<string>>)")
    kept = F.aggregate("q", none, lambda acc, x: F.when(F.forall(acc, lambda a: jaccard(a, x["t"]) < limit), F.concat(acc, F.array(x["t"]))).otherwise(acc))
    reads = log.groupBy("session_id").agg(F.sum((F.col("tool") == "read").cast("long")).alias("reads"))
    return reads.join(s.select("session_id", F.size(kept).cast("long").alias("searches")), "session_id", "left").select("session_id", (F.col("reads") + F.coalesce("searches", F.lit(0))).alias("credit"))


def gate(log: DataFrame, need: int = 4) -> DataFrame:
    """(session_id, seq, verdict) of every answer: the first gate that closes, else ``accepted``."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda t: F.coalesce(F.sum((F.col("tool") == t).cast("long")).over(w), F.lit(0))
    a = log.withColumn("s", n("search")).withColumn("r", n("read"))
    verdict = F.when(F.size(F.coalesce("returned", F.array().cast("array<string>"))) == 0, "empty").when(F.col("s") + F.col("r") < need, "too little work").when((F.col("s") > 0) & (F.col("r") == 0), "unread search").otherwise("accepted")
    return a.where("tool = 'answer'").select("session_id", "seq", verdict.alias("verdict"))


def stateful(pdf: pd.DataFrame) -> pd.DataFrame:
    """The same budget count as a fold over one session, for use where calls arrive as a stream."""
    pdf = pdf.sort_values("seq")
    return pdf.assign(used=pdf["tool"].isin(COUNTED).cumsum())


def pages(log: DataFrame, total: int) -> DataFrame:
    """(session_id, seq, page, status) of every listing call: the page asked for, or the next one where none is named.

    ``invalid`` a page that does not exist, ``already`` one seen before in the session, ``complete`` the call that shows the last page still unseen, else ``ok``.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    l = log.where("tool = 'list'").withColumn("page", F.coalesce(F.expr("try_cast(arg AS int)"), F.row_number().over(w)))
    l = l.withColumn("valid", F.col("page").between(1, total))
    l = l.withColumn("first", F.col("valid") & (F.row_number().over(Window.partitionBy("session_id", "page").orderBy("seq")) == 1))
    seen = F.sum(F.col("first").cast("int")).over(w)
    status = F.when(~F.col("valid"), "invalid").when(~F.col("first"), "already").when(seen == total, "complete").otherwise("ok")
    return l.select("session_id", "seq", "page", status.alias("status"))


def gates(log: DataFrame, total_pages: int, budget: int, most: int = 5, need: int = 4) -> DataFrame:
    """(session_id, seq, verdict) of every answer: the first gate that closes, in their order, else ``accepted``.

    ``no list``; ``too many`` evidence ids; ``no secret`` where ids come with a blank one; ``bad evidence`` that is no mail id; ``too little work`` by reads and searches;
    ``unread search`` where nothing was read since the last search; ``scan incomplete`` for an empty answer before every page was seen.  Work, unread results and the scan are not asked for
    once the budget is used up.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda t: F.coalesce(F.sum((F.col("tool") == t).cast("long")).over(w), F.lit(0))
    last = lambda t: F.max(F.when(F.col("tool") == t, F.col("seq"))).over(w)
    shown = pages(log, total_pages).where("status IN ('ok', 'complete')").select("session_id", "seq", F.lit(1).alias("new"))
    a = log.join(shown, ["session_id", "seq"], "left")
    a = a.withColumn("s", n("search")).withColumn("r", n("read")).withColumn("used", F.col("s") + F.col("r") + n("list")).withColumn("seen", F.coalesce(F.sum("new").over(w), F.lit(0))).withColumn("ls", last("search")).withColumn("lr", last("read"))
    k, spent = F.size("returned"), F.col("used") >= budget
    verdict = (
        F.when(F.col("returned").isNull(), "no list")
        .when(k > most, "too many")
        .when((k > 0) & (F.trim("arg") == ""), "no secret")
        .when(F.exists("returned", lambda x: ~F.coalesce(x.rlike("^[ep]_"), F.lit(False))), "bad evidence")
        .when(~spent & (F.col("s") + F.col("r") < need), "too little work")
        .when(~spent & (F.coalesce("ls", F.lit(-1)) > F.coalesce("lr", F.lit(-1))), "unread search")
        .when(~spent & (k == 0) & (F.col("seen") < total_pages), "scan incomplete")
        .otherwise("accepted")
    )
    return a.where("tool = 'answer'").select("session_id", "seq", verdict.alias("verdict"))


def final_state(log: DataFrame, budget: int, total_pages: int, extra: int = 8) -> DataFrame:
    """(session_id, turns, turn_limit, state): ``answered`` inside the limit of turns, ``forced empty`` beyond it, ``open`` where neither came."""
    limit = budget + total_pages + extra
    w = Window.partitionBy("session_id").orderBy("seq")
    t = log.withColumn("turn", F.row_number().over(w))
    g = t.groupBy("session_id").agg(F.max("turn").cast("long").alias("turns"), F.min(F.when(F.col("tool") == "answer", F.col("turn"))).alias("at"))
    state = F.when(F.col("at") <= limit, "answered").when(F.col("turns") > limit, "forced empty").otherwise("open")
    return g.select("session_id", "turns", F.lit(limit).alias("turn_limit"), state.alias("state"))


def shown_threads(log: DataFrame, mails: DataFrame, alone: int = 1500, each: int = 700) -> DataFrame:
    """(session_id, seq, email_id, n_chars, head): what a reading call shows: the whole thread of the mail, ``alone`` characters of a single message, ``each`` of several."""
    m = mails.select("email_id", F.coalesce("thread_id", F.concat(F.lit("\x00"), "email_id")).alias("t"), F.coalesce("body", F.lit("")).alias("body"))
    reads = log.where("tool = 'read'").select("session_id", "seq", F.col("arg").alias("email_id")).join(m.select("email_id", "t"), "email_id").drop("email_id")
    sizes = m.groupBy("t").agg(F.count("*").alias("k"))
    out = reads.join(sizes, "t").join(m, "t")
    head = F.when(F.col("k") == 1, F.substring("body", 1, alone)).otherwise(F.substring("body", 1, each))
    return out.select("session_id", "seq", "email_id", F.length("body").alias("n_chars"), head.alias("head"))
