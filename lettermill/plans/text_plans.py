"""Queries over mail text: gates, own text, pool, labels, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions import text as X
from lettermill.functions.nicknames import FORMAL
from lettermill.operators.order import numbered
from lettermill.session import bounded, merged, table


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a mail; copies delivered again fall away; a null subject is empty, a null body leaves the mail out."""
    m = table(spark, sf_dir, "mailbox").where("body IS NOT NULL AND email_id IS NOT NULL")
    return m.groupBy("email_id").agg(*[F.max(c).alias(c) for c in ("thread_id", "thread_pos", "thread_len", "topic", "from", "date", "subject")], F.max(X.unix("body")).alias("body"))


def eligible_pool(spark, sf_dir):
    """Mails that pass the gates, no copy of an earlier one, inside the token band: the first wins by the mail's id, before the band."""
    m = mails(spark, sf_dir).select("email_id", X.eligible_text(F.col("subject"), F.col("body")).alias("t")).where("t IS NOT NULL")
    m = m.select("email_id", X.prefix_key(F.col("t")).alias("h"), X.words(F.col("t")).cast("long").alias("n_words"), X.tokens_estimate(F.col("t")).alias("n_tokens"))
    first = m.groupBy("h").agg(F.min(F.struct("email_id", "n_words", "n_tokens")).alias("f")).select("h", "f.*")
    return first.where(F.col("n_tokens").between(*X.BAND)).select("email_id", "n_words", "n_tokens", F.col("h").alias("prefix_hash"))


def gate_bulk_auto(spark, sf_dir):
    b = F.col("body")
    return mails(spark, sf_dir).select("email_id", X.is_bulk(b).alias("bulk"), X.is_auto(b).alias("auto"), b.rlike(f"(?iu){X.MASS_MAIL}").alias("mass"), b.rlike(f"(?iu){X.AUTOMATED}").alias("automated"))


def alpha_ratio(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id", F.round(X.letter_share(F.col("body")), 6).alias("share"), (X.letter_share(F.col("body")) < 0.75).alias("dropped"))


def own_body(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id", X.own_body(F.col("body")).alias("own"))


def own_body_parser(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id", F.md5(X.own_body(F.col("body"), "parser")).alias("own_md5"))


def own_body_style(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id", F.md5(X.own_body(F.col("body"), "style")).alias("own_md5"), F.md5(X.own_body(F.col("body"), "footer")).alias("cut_md5"))


def reply_head(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id", X.is_reply(F.col("subject")).alias("reply"), F.when(X.is_reply(F.col("subject")), "").otherwise(X.strip(F.coalesce("subject", F.lit("")))).alias("head"))


def token_band(spark, sf_dir):
    n = X.tokens_estimate(F.col("body"))
    return mails(spark, sf_dir).select("email_id", n.alias("n_tokens"), n.between(*X.BAND).alias("in_band"))


def prose_filter(spark, sf_dir):
    m = mails(spark, sf_dir).select("email_id", X.own_body(F.col("body")).alias("t"))
    t, n = F.col("t"), F.length("t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    labels = F.size(F.filter(lines, lambda x: (x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")) | (x.contains(":") & (F.length(x) < 40))))
    ok = X.words(t).between(25, 200) & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 0.65 * n) & (F.length(F.regexp_replace(t, r"[^0-9]", "")) <= 0.04 * n)
    ok = ok & (F.length(F.regexp_replace(t, "[^;]", "")) <= 3) & (F.regexp_count(t, F.lit("[A-Z][a-z]+ [A-Z][a-z]+")) <= 6) & (labels <= 0.3 * F.size(lines))
    return m.where(ok).select("email_id")


MARKS = r"[<>@*\"!\[\]:$]|\.{3}|\s{3}|[a-z]\d|www"


def subject_bank(spark, sf_dir):
    """Subjects of two to seven words that name a matter, each once by its small letters.

    A matter is a word of five letters or more of the label vocabulary's notes.  Subjects with marks of addresses, lists or shouting, in one letter case throughout,
    of one stop word, or with a word of a registered sender's name are left out.
    """
    t = X.strip(F.regexp_replace("subject", f"(?iu){X.PREFIXES}", ""))
    m = mails(spark, sf_dir).where("subject IS NOT NULL").select("email_id", t.alias("t")).withColumn("k", F.lower("t"))
    m = m.where(X.words(F.col("t")).between(2, 7) & ~F.col("k").rlike(MARKS) & (F.col("t") != F.upper("t")) & (F.col("t") != F.col("k")))
    s = m.groupBy("k").agg(F.min("t").alias("subject"), F.count("*").alias("n"))
    toks = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)))
    notes = table(spark, sf_dir, "topics").select(F.explode(toks("note")).alias("w")).where(F.length("w") >= 5).distinct().withColumn("matter", F.lit(1))
    local = F.regexp_extract(F.lower("from"), r"^([a-z]+[._][a-z]+)@", 1)
    names = mails(spark, sf_dir).select(F.explode(F.split(local, "[._]")).alias("w")).where("w <> ''").distinct().withColumn("name", F.lit(1))
    w = s.select("k", F.explode(toks("k")).alias("w")).join(F.broadcast(bounded(notes, 10_000)), "w", "left").join(merged(names), "w", "left")
    ok = w.groupBy("k").agg(F.count("matter").alias("a"), F.count("name").alias("b")).where("a > 0 AND b = 0").select("k")
    return s.join(merged(ok), "k")


def name_shape(spark, sf_dir):
    return table(spark, sf_dir, "mailbox").select("from").distinct().where(F.col("from").rlike(r"^[A-Z][a-z'-]+ (?:[A-Z]\. )?[A-Z][A-Za-z'-]+$")).select(F.col("from").alias("name"))


def _tokens(spark, sf_dir):
    plain = F.regexp_replace("body", r"\S+@\S+", " ")
    return mails(spark, sf_dir).select("email_id", F.explode(F.regexp_extract_all(plain, F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).where(F.col("w").rlike("^[A-Za-z][a-z]+$"))


def word_case_stats(spark, sf_dir):
    low = (F.col("w") == F.lower("w")).cast("int")
    s = _tokens(spark, sf_dir).groupBy(F.lower("w").alias("word")).agg(F.sum(low).cast("long").alias("lower_n"), F.sum(1 - low).cast("long").alias("upper_n"))
    return s.withColumn("share", F.round(F.col("lower_n") / (F.col("lower_n") + F.col("upper_n")), 6)).withColumn("wordlike", (F.col("lower_n") >= 5) & (F.col("share") >= 0.25))


def canon_label(spark, sf_dir):
    """Vocabulary label inside a free answer: earliest place, longest on a tie, else ``?``."""
    vocab = table(spark, sf_dir, "topics").select(F.col("topic").alias("label"), F.regexp_replace("topic", r"\s*(?:&|and)\s*", " ").alias("norm")).distinct()
    raw = table(spark, sf_dir, "mailbox").select(F.col("topic").alias("raw")).where("raw IS NOT NULL").distinct()
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"\s*(?:&|and)\s*", " "), r"[^a-z ]+", " "), r"\s+", " ")
    hits = raw.withColumn("k", key).join(F.broadcast(bounded(vocab, 2_000)), F.expr("instr(k, norm) > 0"))
    best = hits.groupBy("raw").agg(F.min(F.struct(F.expr("instr(k, norm)").alias("at"), (-F.length("norm")).alias("l"), "label")).alias("b")).select("raw", F.col("b.label").alias("found"))
    return raw.join(best, "raw", "left").select("raw", F.coalesce("found", F.lit("?")).alias("label"))


def thread_id_hash(spark, sf_dir):
    p = table(spark, sf_dir, "parsed_emails")
    return p.select("message_id", X.normal_subject("subject").alias("norm"), X.thread_hash("subject").alias("thread_id")).distinct()


def address_normalise(spark, sf_dir):
    return table(spark, sf_dir, "mailbox").select("from").distinct().select(F.col("from").alias("raw"), X.address("from").alias("addr"), X.name_from_address(X.address("from")).alias("name"))


def person_key(spark, sf_dir):
    """Canonical given name and surname without apostrophe or hyphen."""
    names = table(spark, sf_dir, "mailbox").select("from").distinct().where(F.col("from").rlike(r"^[A-Z][a-z]+ [A-Z][A-Za-z'-]+$"))
    first, last = F.lower(F.split("from", " ")[0]), F.translate(F.lower(F.split("from", " ")[1]), "'-", "")
    formal = F.create_map(*[F.lit(x) for k, v in FORMAL.items() for x in (k, v)])
    return names.select(F.col("from").alias("name"), F.coalesce(F.element_at(formal, first), first).alias("first_key"), last.alias("last_key"))


def case_transfer(spark, sf_dir):
    """Labels as the earlier label of each mail is cased: the vocabulary's spelling, by the key of the label, in the letter case of what was typed."""
    vocab = bounded(table(spark, sf_dir, "topics").where("topic IS NOT NULL").select("topic", X.label_key("topic").alias("k")).distinct(), 10_000)
    m = table(spark, sf_dir, "mailbox").where("topic IS NOT NULL").select(F.col("topic").alias("model")).distinct().withColumn("k", X.label_key("model"))
    return m.join(F.broadcast(vocab), "k").select("topic", "model", X.case_like(F.col("topic"), F.col("model")).alias("out"))


def contact_shapes(spark, sf_dir):
    b = F.col("body")
    kinds = {"phone": X.PHONE, "zip4": X.ZIP4, "po_box": f"(?iu){X.PO_BOX}", "suite": f"(?iu){X.SUITE}", "ssn": X.SSN, "street": X.STREET, "city_zip": X.CITY_ZIP}
    return mails(spark, sf_dir).select("email_id", *[F.regexp_count(b, F.lit(p)).cast("long").alias(k) for k, p in kinds.items()])


def text_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(X.windows(F.col("text"), 800, 760)).alias("win", "t")).select("doc_id", F.col("win").cast("long").alias("win"), F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


def file_bank(spark, sf_dir):
    """Attachment names as mails list them, a line each, with their number and place in the bank: most frequent first."""
    hits = mails(spark, sf_dir).select(F.explode(F.regexp_extract_all("body", F.lit(f"(?i){X.ATTACHMENT}"), F.lit(1))).alias("name")).select(F.trim("name").alias("name"))
    b = hits.groupBy("name").agg(F.count("*").alias("n")).withColumn("m", -F.col("n")).withColumn("low", F.lower("name"))
    return numbered(b, "m", "low", "name", name="place").select("name", "n", "place")


def signed_name(spark, sf_dir):
    """The one capitalised word among the last three lines of the own text that is no closing phrase."""
    lines = F.filter(F.split(X.own_body(F.col("body")), "\n"), lambda x: F.trim(x) != "")
    tail = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3))
    names = F.filter(F.transform(tail, lambda x: F.trim(x)), lambda x: x.rlike(r"^[A-Z][a-z]+$") & ~F.lower(x).isin("thanks", "thx", "regards", "best", "cheers", "sincerely"))
    return mails(spark, sf_dir).select("email_id", F.coalesce(F.try_element_at(names, F.lit(-1)), F.lit("")).alias("signed"))


def greeting_signoff(spark, sf_dir):
    own = X.own_body(F.col("body"))
    first = F.lower(F.trim(F.split(own, "\n")[0]))
    g = F.regexp_extract(first, X.GREETING, 1)
    greet = F.when(g != "", g).when(first.rlike(X.NAME_ONLY) & (F.size(F.split(first, r" +")) <= 4), F.lit("name only")).otherwise(F.lit("none"))
    lines = F.split(own, "\n")
    tail = F.lower(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), " "))
    s = F.regexp_extract(tail, X.SIGN_OFF, 1)
    return mails(spark, sf_dir).select(greet.alias("greeting"), F.when(s != "", s).otherwise("none").alias("sign_off")).groupBy("greeting", "sign_off").agg(F.count("*").alias("n"))


def _has(col: F.Column, pattern: str, flags: str) -> F.Column:
    return col.rlike(f"(?d{flags}){pattern}")


def style_shares(spark, sf_dir):
    """Shares of texts with each habit, planted and background; two spaces count among texts of two sentence ends or more."""
    t = X.own_body(F.col("body"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    m = mails(spark, sf_dir).select(F.when(F.col("email_id").startswith("p_"), "planted").otherwise("background").alias("set"), t.alias("t"), X.words(t).alias("w"))
    c = F.col("t")
    several = F.regexp_count(c, F.lit(r"[a-z0-9)]\.\s+[A-Z]")) >= 2
    habits = [share(F.when(several, _has(c, p, f)) if name == "two_spaces" else _has(c, p, f)).alias(name) for name, p, f in X.HABITS]
    return m.groupBy("set").agg(
        F.count("*").alias("n"), share(F.array_max(F.transform(F.split(c, "\n"), F.length)) > 100).alias("long_line"), *habits,
        share(F.col("w") > 150).alias("over_150"), share(F.col("w") < 20).alias("under_20"), F.percentile("w", F.lit(0.5)).cast("long").alias("median_words"),
    )


def mailbox_profile(spark, sf_dir):
    """Rates of forms over own texts and whole bodies, one row a form."""
    m = mails(spark, sf_dir).select(X.own_body(F.col("body")).alias("own"), "body")
    flags = F.explode(F.array(*[F.struct(F.lit(name).alias("form"), F.when(F.col("own") != "", _has(F.col("own"), p, f)).alias("hit") if over == "own" else _has(F.col("body"), p, f).alias("hit")) for name, over, p, f in X.PROFILE])).alias("x")
    return m.select(flags).select("x.*").where("hit IS NOT NULL").groupBy("form").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("rate"))


def order_stats(spark, sf_dir):
    """Quartiles by index, not interpolated, of the words of own texts."""
    w = mails(spark, sf_dir).select(X.words(X.own_body(F.col("body"))).cast("long").alias("w")).groupBy("w").agg(F.count("*").alias("k"))
    upto = Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)  # over distinct counts of words, a short list
    r = w.withColumn("hi", F.sum("k").over(upto)).crossJoin(w.agg(F.sum("k").alias("n")))
    at = lambda i: F.min(F.when(F.col("hi") > i, F.col("w")))
    return r.groupBy("n").agg(at(F.floor(F.col("n") / 4)).alias("p25"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(3 * F.col("n") / 4)).alias("p75"))


def hallucination_guard(spark, sf_dir):
    """Audited names that really stand in their mail."""
    f = table(spark, sf_dir, "name_audit").select("email_id", F.explode("found").alias("f")).select("email_id", F.col("f.name").alias("name")).distinct()
    m = mails(spark, sf_dir).select("email_id", "body")
    return f.join(m, "email_id").select("email_id", "name", (F.instr(F.lower("body"), F.lower("name")) > 0).alias("kept"))


def role_guard(spark, sf_dir):
    """What the words of a spelling say it is: an organisation, a role, kin, a pronoun, or by none of them a person."""
    toks = F.regexp_extract_all(F.lower("from"), F.lit(r"([a-z]+)"), F.lit(1))
    kind = F
    for k, ws in X.GUARD_WORDS.items():
        words = F.array(*map(F.lit, ws))
        every = F.size(F.array_except(toks, words)) == 0
        kind = kind.when(F.arrays_overlap(toks, words) if k in ("organisation", "role") else (F.size(toks) > 0) & every, F.lit(k))
    return table(spark, sf_dir, "mailbox").select("from").distinct().select(F.col("from").alias("name"), kind.otherwise(F.lit("person")).alias("kind"))


def template_fill(spark, sf_dir):
    t = table(spark, sf_dir, "topics")
    return t.select("topic", F.replace(F.replace(F.lit("Is <<TOPIC>> named by: <<NOTE>>?"), F.lit("<<TOPIC>>"), "topic"), F.lit("<<NOTE>>"), F.coalesce("note", F.lit("-"))).alias("prompt"))


def thread_cards(spark, sf_dir):
    m = mails(spark, sf_dir)
    card = F.format_string("[%s] %s | %s | %s", F.col("date"), F.col("from"), F.coalesce("subject", F.lit("")), F.substring(F.regexp_replace("body", r"\s+", " "), 1, 60))
    return m.select("email_id", card.alias("card"))


def text_overlap(spark, sf_dir):
    """Share of a parsed subject's words that its body holds."""
    p = table(spark, sf_dir, "parsed_emails").where("subject IS NOT NULL AND body IS NOT NULL").groupBy("message_id").agg(F.max("subject").alias("s"), F.max("body").alias("b"))
    a, b = F.array_distinct(X.search_tokens("s")), F.array_distinct(X.search_tokens("b"))
    return p.select("message_id", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)), 6).alias("kept"), (F.instr(F.lower("b"), F.lower(F.substring("s", 1, 25))) > 0).alias("verbatim"))


def leak_words(spark, sf_dir):
    """Planted mails that hold at least half, and three, of the long words of their chain's secret."""
    k = table(spark, sf_dir, "answer_key").select("chain", "secret", F.explode("planted").alias("clue", "ids")).select("chain", "secret", "clue", F.explode("ids").alias("email_id"))
    long_ = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("secret"), F.lit(r"([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 6))
    m = mails(spark, sf_dir).select("email_id", F.lower("body").alias("b"))
    hits = F.size(F.filter("ws", lambda w: F.contains(F.col("b"), w)))
    return k.withColumn("ws", long_).join(m, "email_id").select("chain", "clue", "email_id", hits.cast("long").alias("hits"), (hits >= F.greatest(F.lit(3), F.ceil(F.size("ws") / 2))).alias("leaks"))


def stem_overlap(spark, sf_dir):
    """Common five-letter stems of a chain's secret and its stake."""
    st = lambda c: F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)))
    return table(spark, sf_dir, "answer_key").fillna("", ["secret", "stake"]).select("chain", F.size(F.array_intersect(st("secret"), st("stake"))).cast("long").alias("common"), F.size(st("secret")).cast("long").alias("stems"))


def timeline_check(spark, sf_dir):
    """Mails of a thread dated more than seven days after the one before."""
    m = mails(spark, sf_dir).where(F.col("date").rlike(r"^\d{4}-\d\d-\d\d$")).select("thread_id", "email_id", "thread_pos", F.to_date("date").alias("d"))
    w = Window.partitionBy("thread_id").orderBy("thread_pos", "email_id")
    gap = F.datediff("d", F.lag("d").over(w))
    return m.withColumn("gap", gap).where("gap > 7 OR gap < 0").select("thread_id", "email_id", F.col("gap").cast("long").alias("gap"))


def point_split(spark, sf_dir):
    """Clauses of a secret, split at its conjunctions."""
    return table(spark, sf_dir, "answer_key").select("chain", F.posexplode(F.split(F.regexp_replace("secret", r"\.$", ""), r",? and (?:that )?")).alias("i", "point")).select("chain", F.col("i").cast("long").alias("i"), "point")


def json_candidates(spark, sf_dir):
    """Judge notes as JSON between the outer braces: match, rank and reason."""
    d = table(spark, sf_dir, "documents").where("source = 'judge_notes'").select("doc_id", F.regexp_extract("text", r"(?s)(\{.*\})", 1).alias("j"))
    o = F.from_json("j", "match boolean, rank int, reason string")
    return d.select("doc_id", o["match"].alias("match"), o["rank"].cast("long").alias("rank"), F.length(o["reason"]).cast("long").alias("n")).where("match IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (
        eligible_pool, gate_bulk_auto, alpha_ratio, own_body, own_body_parser, own_body_style, reply_head, token_band, prose_filter, subject_bank, name_shape, word_case_stats, canon_label, thread_id_hash,
        address_normalise, person_key, case_transfer, contact_shapes, text_windows, file_bank, signed_name, greeting_signoff, style_shares, mailbox_profile, order_stats, hallucination_guard, role_guard, template_fill, thread_cards,
        text_overlap, leak_words, stem_overlap, timeline_check, point_split, json_candidates,
    )
}
