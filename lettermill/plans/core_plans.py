"""Queries of joins, aggregates, windows, sampling, search, sessions, verification and reports, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions import text as X
from lettermill.operators import fill, graph, search, session
from lettermill.plans.text_plans import mails
from lettermill.plans.text_sql import MAILS, q, tokens
from lettermill.session import bounded, merged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
M = MAILS.rstrip()
NORM = r"trim(regexp_replace(lower(replace(replace({0}, '_', ' '), '&', 'and')), '\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _md5(*cols) -> F.Column:
    return F.md5(F.concat_ws(":", *cols))


def _labels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "topic_labels").where("topic <> '?'").select("email_id", F.col("topic").alias("label")).distinct()


# ---- joins


@query(f"{M} SELECT m.email_id, l.label FROM mails m JOIN (SELECT DISTINCT email_id, topic AS label FROM topic_labels WHERE topic <> '?') l USING (email_id) WHERE l.label <> 'other'")
def label_join(spark, sf_dir):
    return mails(spark, sf_dir).select("email_id").join(_labels(spark, sf_dir), "email_id").where("label <> 'other'")


@query(f"{M} SELECT email_id, thread_id FROM mails WHERE email_id IN (SELECT email_id FROM topic_labels)")
def labelled_semi(spark, sf_dir):
    return mails(spark, sf_dir).join(table(spark, sf_dir, "topic_labels"), "email_id", "left_semi").select("email_id", "thread_id")


@query(f"{M} SELECT p.message_id, coalesce(t.tid, p.message_id) AS tid FROM (SELECT DISTINCT message_id, normalized_subject FROM parsed_emails) p LEFT JOIN (SELECT lower(subject) AS k, min(thread_id) AS tid FROM mails WHERE subject IS NOT NULL GROUP BY 1) t ON t.k = p.normalized_subject")
def thread_fallback_key(spark, sf_dir):
    t = mails(spark, sf_dir).where("subject IS NOT NULL").groupBy(F.lower("subject").alias("k")).agg(F.min("thread_id").alias("tid"))
    p = table(spark, sf_dir, "parsed_emails").select("message_id", F.col("normalized_subject").alias("k")).distinct()
    return p.join(t, "k", "left").select("message_id", F.coalesce("tid", "message_id").alias("tid"))


@query(f"{M}, v AS (SELECT unnest(returned) AS email_id, session_id FROM tool_log WHERE tool = 'answer'), b AS (SELECT m.thread_id FROM v JOIN mails m USING (email_id) GROUP BY 1 HAVING count(DISTINCT session_id) >= 2) SELECT DISTINCT thread_id FROM mails WHERE thread_id NOT IN (SELECT thread_id FROM b)")
def anti_voted_threads(spark, sf_dir):
    """Threads that fewer than two sessions named in their answers."""
    m = mails(spark, sf_dir).select("email_id", "thread_id")
    v = table(spark, sf_dir, "tool_log").where("tool = 'answer'").select(F.explode("returned").alias("email_id"), "session_id")
    voted = v.join(m, "email_id").groupBy("thread_id").agg(F.count_distinct("session_id").alias("n")).where("n >= 2")
    return m.select("thread_id").distinct().join(voted, "thread_id", "left_anti")


@query(rf"""{M}, n AS (SELECT DISTINCT lower("from") AS name FROM mails WHERE regexp_matches("from", '^[A-Z][a-z]+ [A-Z][a-z]+$')),
w AS (SELECT email_id, regexp_extract_all(lower(body), '[a-z]+') AS w FROM mails), b AS (SELECT DISTINCT email_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM w)
SELECT n.name, count(DISTINCT b.email_id) AS n FROM n JOIN b USING (name) JOIN mails m ON m.email_id = b.email_id AND lower(m."from") <> n.name GROUP BY 1""")
def named_elsewhere(spark, sf_dir):
    """Sender names that stand in full in other senders' mails: a substring test as an equi-join on word pairs."""
    m = mails(spark, sf_dir).select("email_id", F.lower("from").alias("sender"), F.col("from").alias("raw"), F.regexp_extract_all(F.lower("body"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    names = m.where(F.col("raw").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$")).select(F.col("sender").alias("name")).distinct()
    pairs = m.where(F.size("w") > 1).select("email_id", "sender", F.explode(F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))).alias("name"))
    return pairs.join(names, "name").where("sender <> name").groupBy("name").agg(F.count("*").alias("n"))


_SIG = r"md5(trim(regexp_replace(regexp_replace(lower(body), '[0-9]+', ' ', 'g'), '\s+', ' ', 'g'))[1:240])"


@query(f"{M}, s AS (SELECT email_id, thread_id, thread_pos, {_SIG} AS sig FROM mails) SELECT DISTINCT thread_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.sig = s.sig AND o.email_id < s.email_id)")
def signature_anti(spark, sf_dir):
    """Threads with a mail whose digit-free signature no earlier mail id carries."""
    sig = F.md5(F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower("body"), "[0-9]+", " "), r"\s+", " ")), 1, 240))
    s = mails(spark, sf_dir).select("email_id", "thread_id", sig.alias("sig"))
    return s.groupBy("sig").agg(F.min(F.struct("email_id", "thread_id")).alias("f")).select("f.thread_id").distinct()


@query(rf"""{M}, r AS (SELECT DISTINCT regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 1) AS a, regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 2) AS b FROM mails WHERE regexp_matches("from", '^[a-z]+\.[a-z]+@')),
w AS (SELECT email_id, regexp_extract_all(lower(body), '[a-z]+') AS w FROM mails), p AS (SELECT email_id, unnest(range(1, len(w))) AS i, w FROM w)
SELECT email_id, min(w[i] || ' ' || w[i + 1]) AS hit FROM p JOIN r ON r.a = w[i] AND r.b = w[i + 1] GROUP BY 1""")
def bigram_registry_hits(spark, sf_dir):
    """Leak scan: one registered name a mail, found as adjacent words by an equi-join."""
    m = mails(spark, sf_dir)
    r = m.where(F.col("from").rlike(r"^[a-z]+\.[a-z]+@")).select(F.regexp_extract("from", r"^([a-z]+)\.([a-z]+)@", 1).alias("a"), F.regexp_extract("from", r"^([a-z]+)\.([a-z]+)@", 2).alias("b")).distinct()
    w = m.select("email_id", F.regexp_extract_all(F.lower("body"), F.lit("([a-z]+)"), F.lit(1)).alias("w")).where(F.size("w") > 1)
    pairs = w.select("email_id", F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b"))).alias("z")).select("email_id", "z.a", "z.b")
    return pairs.join(r, ["a", "b"]).groupBy("email_id").agg(F.min(F.concat_ws(" ", "a", "b")).alias("hit"))


_LOGIN = r"SELECT DISTINCT regexp_extract(\"from\", '^([a-z]+)@', 1) AS login".replace('\\"', '"')


@query(rf"""WITH l AS ({_LOGIN} FROM mailbox WHERE regexp_matches("from", '^[a-z]+@') ), p AS (SELECT DISTINCT regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 1) AS f, regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 2) AS s FROM mailbox WHERE regexp_matches("from", '^[a-z]+\.[a-z]+@'))
SELECT login, arg_min(f || ' ' || s, (length(s), s, f)) AS person FROM l JOIN p ON login[1:1] = f[1:1] AND starts_with(s, login[2:]) GROUP BY 1""")
def prefix_login(spark, sf_dir):
    """Login of an initial and a surname prefix to a person, the shortest surname first: an equi-join on all the forms a person's login can take."""
    m = table(spark, sf_dir, "mailbox").select("from").distinct()
    logins = m.where(F.col("from").rlike("^[a-z]+@")).select(F.regexp_extract("from", "^([a-z]+)@", 1).alias("login")).distinct()
    people = m.where(F.col("from").rlike(r"^[a-z]+\.[a-z]+@")).select(F.regexp_extract("from", r"^([a-z]+)\.([a-z]+)@", 1).alias("f"), F.regexp_extract("from", r"^([a-z]+)\.([a-z]+)@", 2).alias("s")).distinct()
    forms = F.transform(F.sequence(F.lit(0), F.length("s")), lambda k: F.concat(F.substring("f", 1, 1), F.substring(F.col("s"), F.lit(1), k)))
    hits = merged(people.select("f", "s", F.explode(forms).alias("login"))).join(logins, "login")
    return hits.groupBy("login").agg(F.min(F.struct(F.length("s"), "s", "f")).alias("b")).select("login", F.concat_ws(" ", "b.f", "b.s").alias("person"))


@query("""WITH RECURSIVE u AS (SELECT DISTINCT from_addr AS a, x AS b FROM parsed_emails, unnest(to_addrs) AS t(x) WHERE from_addr IS NOT NULL AND x IS NOT NULL AND split_part(from_addr, '@', 2) = split_part(x, '@', 2)),
s AS (SELECT a, b FROM u UNION SELECT b, a FROM u), r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1""")
def components(spark, sf_dir):
    """Groups of addresses linked by mail inside their firm."""
    p = table(spark, sf_dir, "parsed_emails").where("from_addr IS NOT NULL").select(F.col("from_addr").alias("a"), F.explode("to_addrs").alias("b"))
    return graph.components(p.where(F.substring_index("a", "@", -1) == F.substring_index("b", "@", -1)))


@query(rf"""{M}, p AS (SELECT DISTINCT regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 1) AS f, regexp_extract("from", '^([a-z]+)\.([a-z]+)@', 2) AS s FROM mails WHERE regexp_matches("from", '^[a-z]+\.[a-z]+@')), k AS (SELECT f, s, f || ' ' || s AS person FROM p),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower("from"), '[a-z]+')) AS w FROM mails WHERE "from" NOT LIKE '%@%'), bs AS (SELECT w, min(person) AS person FROM w JOIN k ON k.s = w GROUP BY 1 HAVING count(DISTINCT person) = 1), bf AS (SELECT w, min(person) AS person FROM w JOIN k ON k.f = w GROUP BY 1 HAVING count(DISTINCT person) = 1)
SELECT w.w AS token, coalesce(bs.person, bf.person) AS person FROM w LEFT JOIN bs USING (w) LEFT JOIN bf ON bf.w = w.w WHERE coalesce(bs.person, bf.person) IS NOT NULL""")
def unique_token_join(spark, sf_dir):
    """A lone word joins a person only if it fits exactly one, by surname before given name."""
    m = mails(spark, sf_dir).select("from").distinct()
    rx = r"^([a-z]+)\.([a-z]+)@"
    k = m.where(F.col("from").rlike(rx)).select(F.regexp_extract("from", rx, 1).alias("f"), F.regexp_extract("from", rx, 2).alias("s")).distinct().withColumn("person", F.concat_ws(" ", "f", "s"))
    w = m.where(~F.col("from").contains("@")).select(F.explode(F.regexp_extract_all(F.lower("from"), F.lit("([a-z]+)"), F.lit(1))).alias("token")).distinct()
    one = lambda c, n: k.groupBy(F.col(c).alias("token")).agg(F.count_distinct("person").alias("k"), F.min("person").alias(n)).where("k = 1").select("token", n)
    return w.join(one("s", "ps"), "token", "left").join(one("f", "pf"), "token", "left").select("token", F.coalesce("ps", "pf").alias("person")).where("person IS NOT NULL")


@query("""WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: avg_list[i]) AS v FROM (SELECT label, list(m ORDER BY i) AS avg_list FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1)),
s AS (SELECT e.vec_id, c.label, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * c.v[i])), 5) AS dot FROM embeddings e, c) SELECT vec_id, CASE WHEN max(dot) < 0.05 THEN 'other' ELSE CAST(arg_max(label, (dot, -label)) AS VARCHAR) END AS nearest, max(dot) AS dot FROM s GROUP BY 1""")
def nearest_topic(spark, sf_dir):
    """Nearest label centroid of each vector by dot product, ``other`` where none reaches the floor; the centroids are one row a label."""
    e = table(spark, sf_dir, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("v"))
    dot = F.round(F.aggregate(F.zip_with("embedding", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x), 5)
    s = e.select("vec_id", "embedding").crossJoin(F.broadcast(bounded(c, 2_000))).select("vec_id", "label", dot.alias("dot"))
    return s.groupBy("vec_id").agg(F.max(F.struct("dot", (-F.col("label")).alias("l"))).alias("b")).select("vec_id", F.when(F.col("b.dot") < 0.05, "other").otherwise((-F.col("b.l")).cast("string")).alias("nearest"), F.col("b.dot").alias("dot"))


@query(f"{M} SELECT email_id, count(*) OVER (PARTITION BY thread_id) - 1 AS others FROM mails WHERE thread_id IS NOT NULL")
def thread_others(spark, sf_dir):
    m = mails(spark, sf_dir).where("thread_id IS NOT NULL").select("email_id", "thread_id")
    n = m.groupBy("thread_id").agg(F.count("*").alias("n"))  # an aggregate and a join instead of a window over a thread
    return m.join(n, "thread_id").select("email_id", (F.col("n") - 1).alias("others"))


@query("SELECT c.chain, k.clue, m.email_id, min(m.thread_id) AS thread_id FROM (SELECT chain, unnest(map_keys(planted)) AS clue, unnest(map_values(planted)) AS ids FROM answer_key) k JOIN answer_key c USING (chain), unnest(k.ids) AS t(id) JOIN mailbox m ON m.email_id = t.id GROUP BY ALL")
def planted_threads(spark, sf_dir):
    k = table(spark, sf_dir, "answer_key").select("chain", F.explode("planted").alias("clue", "ids")).select("chain", "clue", F.explode("ids").alias("email_id"))
    return k.join(mails_any(spark, sf_dir), "email_id").select("chain", "clue", "email_id", "thread_id")


def mails_any(spark, sf_dir):
    return table(spark, sf_dir, "mailbox").groupBy("email_id").agg(F.min("thread_id").alias("thread_id"))


# ---- aggregates


@query(f"WITH n AS (SELECT {NORM.format('topic')} AS topic FROM mailbox WHERE topic IS NOT NULL) SELECT topic, count(*) AS n FROM n WHERE topic NOT IN ('other', '?') GROUP BY 1 HAVING count(*) >= 40")
def topic_floor(spark, sf_dir):
    m = table(spark, sf_dir, "mailbox").where("topic IS NOT NULL").select(X.label_key("topic").alias("topic"))
    return m.where(~F.col("topic").isin("other", "?")).groupBy("topic").agg(F.count("*").alias("n")).where("n >= 40")


_QUOTA = f"WITH n AS (SELECT {NORM.format('topic')} AS topic FROM mailbox WHERE topic IS NOT NULL), p AS (SELECT topic, count(*) AS pool FROM n WHERE topic NOT IN ('other', '?') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY pool DESC, topic) AS r, count(*) OVER () AS k FROM p)"


@query(_QUOTA + " SELECT topic, pool, 500 // k + CASE WHEN r <= 500 % k THEN 1 ELSE 0 END AS quota FROM r")
def quota_alloc(spark, sf_dir):
    """500 places over the topics, the rest to the deepest pools; the pools are one row a topic."""
    m = table(spark, sf_dir, "mailbox").where("topic IS NOT NULL").select(X.label_key("topic").alias("topic")).where(~F.col("topic").isin("other", "?"))
    p = m.groupBy("topic").agg(F.count("*").alias("pool"))
    r = p.withColumn("r", F.row_number().over(Window.orderBy(F.desc("pool"), "topic"))).crossJoin(p.agg(F.count("*").alias("k")))
    return r.select("topic", "pool", (F.floor(F.lit(500) / F.col("k")) + (F.col("r") <= F.lit(500) % F.col("k")).cast("long")).alias("quota"))


@query(f"{_QUOTA}, a AS (SELECT topic, count(*) AS planted FROM answer_key GROUP BY 1), q AS (SELECT topic, 500 // k + CASE WHEN r <= 500 % k THEN 1 ELSE 0 END AS quota FROM r) SELECT topic, quota, coalesce(planted, 0) AS planted, quota - coalesce(planted, 0) AS remaining, quota < coalesce(planted, 0) AS too_many FROM q LEFT JOIN a USING (topic)")
def reserve_subtract(spark, sf_dir):
    """Places of each topic once the planted mails are taken out; ``too_many`` marks topics with more of them than places, on which :func:`fill.reserved` raises."""
    a = table(spark, sf_dir, "answer_key").groupBy("topic").agg(F.count("*").alias("planted"))
    return fill.reserve(quota_alloc(spark, sf_dir).select("topic", "quota"), a)


@query(f"""{M}, s AS (SELECT "from", count(*) AS n FROM mails GROUP BY 1), d AS (SELECT "date"[1:7] AS m, count(*) AS n FROM mails GROUP BY 1)
SELECT (SELECT count(*) FROM mails) AS emails, (SELECT count(DISTINCT thread_id) FROM mails) AS threads, (SELECT count(*) FROM s) AS senders, (SELECT count(*) FROM d) AS months, round(100.0 * (SELECT max(n) FROM s) / (SELECT count(*) FROM mails), 4) AS top_sender_pct, round(100.0 * (SELECT max(n) FROM d) / (SELECT count(*) FROM mails), 4) AS top_month_pct""")
def manifest_counts(spark, sf_dir):
    m = mails(spark, sf_dir)
    a = m.agg(F.count("*").alias("emails"), F.count_distinct("thread_id").alias("threads"))
    s = m.groupBy("from").agg(F.count("*").alias("n")).agg(F.count("*").alias("senders"), F.max("n").alias("ms"))
    d = m.groupBy(F.substring("date", 1, 7).alias("m")).agg(F.count("*").alias("n")).agg(F.count("*").alias("months"), F.max("n").alias("md"))
    return a.crossJoin(s).crossJoin(d).select("emails", "threads", "senders", "months", F.round(100.0 * F.col("ms") / F.col("emails"), 4).alias("top_sender_pct"), F.round(100.0 * F.col("md") / F.col("emails"), 4).alias("top_month_pct"))


@query(f"{M} SELECT thread_len, count(DISTINCT thread_id) AS n FROM mails GROUP BY 1")
def thread_histogram(spark, sf_dir):
    return mails(spark, sf_dir).groupBy("thread_len").agg(F.count_distinct("thread_id").alias("n"))


@query("""WITH p AS (SELECT from_addr, split_part(message_id, '@', 2) AS dom, count(*) AS n FROM parsed_emails GROUP BY 1, 2) SELECT from_addr, arg_min(dom, (-n, dom)) AS domain, max(n) AS n FROM p GROUP BY 1""")
def canonical_vote(spark, sf_dir):
    """Most frequent domain of each sender's message ids, alphabetical on ties."""
    p = table(spark, sf_dir, "parsed_emails").groupBy("from_addr", F.substring_index("message_id", "@", -1).alias("dom")).agg(F.count("*").alias("n"))
    return p.groupBy("from_addr").agg(F.min(F.struct((-F.col("n")).alias("m"), "dom")).alias("b")).select("from_addr", F.col("b.dom").alias("domain"), (-F.col("b.m")).alias("n"))


_PAIRS = f"SELECT l.email_id, min(l.topic) AS new, min({NORM.format('m.topic')}) AS old FROM topic_labels l JOIN mailbox m USING (email_id) WHERE l.topic <> '?' AND m.topic IS NOT NULL GROUP BY 1"


def _label_pairs(spark, sf_dir):
    l = table(spark, sf_dir, "topic_labels").where("topic <> '?'").select("email_id", F.col("topic").alias("new"))
    m = table(spark, sf_dir, "mailbox").where("topic IS NOT NULL").select("email_id", X.label_key("topic").alias("old"))
    return l.join(m, "email_id").groupBy("email_id").agg(F.min("new").alias("new"), F.min("old").alias("old"))


@query(f"WITH p AS ({_PAIRS}) SELECT old, new, count(*) AS n FROM p GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return _label_pairs(spark, sf_dir).groupBy("old", "new").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_PAIRS}), n AS (SELECT count(*) AS n, avg((old = new)::INT) AS po FROM p), e AS (SELECT sum(a.c * b.c) AS s FROM (SELECT old AS t, count(*) AS c FROM p GROUP BY 1) a JOIN (SELECT new AS t, count(*) AS c FROM p GROUP BY 1) b USING (t)) SELECT n, round(po, 6) AS agreement, round((po - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e")
def kappa(spark, sf_dir):
    p = _label_pairs(spark, sf_dir)
    n = p.agg(F.count("*").alias("n"), F.avg((F.col("old") == F.col("new")).cast("int")).alias("po"))
    a, b = p.groupBy(F.col("old").alias("t")).agg(F.count("*").alias("a")), p.groupBy(F.col("new").alias("t")).agg(F.count("*").alias("b"))
    e = a.join(b, "t").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    pe = F.col("s") / (F.col("n") * F.col("n"))
    return n.crossJoin(e).select("n", F.round("po", 6).alias("agreement"), F.round((F.col("po") - pe) / (1 - pe), 6).alias("kappa"))


@query("SELECT tool, count(*) AS calls, count(DISTINCT session_id) AS sessions, round(avg(len(returned)), 6) AS mean_returned, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS ok_share FROM tool_log GROUP BY 1")
def outcome_by_tool(spark, sf_dir):
    return table(spark, sf_dir, "tool_log").groupBy("tool").agg(F.count("*").alias("calls"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg(F.size("returned")), 6).alias("mean_returned"), F.round(F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)), 6).alias("ok_share"))


@query("SELECT kind, name, count(DISTINCT email_id) AS docs, count(*) AS n FROM (SELECT email_id, f.kind AS kind, f.name AS name FROM (SELECT email_id, unnest(found) AS f FROM name_audit)) GROUP BY 1, 2")
def audit_counts(spark, sf_dir):
    f = table(spark, sf_dir, "name_audit").select("email_id", F.explode("found").alias("f")).select("email_id", "f.kind", "f.name")
    return f.groupBy("kind", "name").agg(F.count_distinct("email_id").alias("docs"), F.count("*").alias("n"))


_LOG = "l AS (SELECT session_id, seq, min(tool) AS tool, min(arg) AS arg, min(returned) AS returned, min(status) AS status FROM tool_log WHERE session_id IS NOT NULL AND seq IS NOT NULL GROUP BY 1, 2)"


def _log(spark, sf_dir):
    return session.clean_log(table(spark, sf_dir, "tool_log"))


@query(f"""WITH {_LOG}, t AS (SELECT email_id, min(thread_id) AS thread_id FROM mailbox GROUP BY 1), a AS (SELECT DISTINCT session_id, thread_id FROM (SELECT session_id, unnest(returned) AS email_id FROM l WHERE tool = 'answer') JOIN t USING (email_id)),
p AS (SELECT DISTINCT thread_id FROM (SELECT unnest(flatten(map_values(planted))) AS email_id FROM answer_key) JOIN t USING (email_id)) SELECT session_id, count(*) AS cited, count(p.thread_id) AS planted, round(count(p.thread_id) / count(*), 3) AS precision FROM a LEFT JOIN p USING (thread_id) GROUP BY 1""")
def citation_pr(spark, sf_dir):
    t = mails_any(spark, sf_dir)
    a = _log(spark, sf_dir).where("tool = 'answer'").select("session_id", F.explode("returned").alias("email_id")).join(t, "email_id").select("session_id", "thread_id").distinct()
    p = table(spark, sf_dir, "answer_key").select(F.explode(F.flatten(F.map_values("planted"))).alias("email_id")).join(t, "email_id").select("thread_id").distinct().withColumn("p", F.lit(1))
    return a.join(p, "thread_id", "left").groupBy("session_id").agg(F.count("*").alias("cited"), F.count("p").alias("planted"), F.round(F.count("p") / F.count("*"), 3).alias("precision"))


@query(f"{M} SELECT CAST(sum(CAST('0x' || substr(md5(email_id || chr(10) || body), 1, 10) AS BIGINT)) AS BIGINT) AS digest, count(*) AS n FROM mails")
def digest(spark, sf_dir):
    """Content digest of all mails that no order of rows or partitions changes: a sum of row digests."""
    h = F.conv(F.substring(F.md5(F.concat("email_id", F.lit("\n"), "body")), 1, 10), 16, 10).cast("long")
    return mails(spark, sf_dir).agg(F.sum(h).alias("digest"), F.count("*").alias("n"))


# ---- verification of planted chains


_CALLS = f"""{_LOG}, t AS (SELECT email_id, min(thread_id) AS thread_id FROM mailbox GROUP BY 1), p AS (SELECT DISTINCT chain, n, CAST(clue AS INTEGER) AS clue FROM (SELECT chain, n, unnest(map_keys(planted)) AS clue FROM answer_key)),
s AS (SELECT chain, n, m FROM (SELECT DISTINCT chain, n FROM answer_key), range(1, 8) AS r(m) WHERE m < (1 << n))"""


@query(f"WITH {_CALLS} SELECT chain, m AS mask, CAST(bit_count(m) AS BIGINT) AS size FROM s")
def power_set(spark, sf_dir):
    """All non-empty subsets of a chain's threads as bit masks."""
    k = table(spark, sf_dir, "answer_key").select("chain", "n").distinct()
    return k.select("chain", F.explode(F.expr("sequence(1L, shiftleft(1L, n) - 1L)")).alias("mask")).withColumn("size", F.bit_count("mask").cast("long"))


@query("""WITH c AS (SELECT *, cardinality(planted) AS k, list_sum(list_transform(map_values(planted), lambda x: len(x))) AS msgs, list_min(list_transform(map_values(planted), lambda x: len(x))) AS fewest, cardinality(names) AS cast_size FROM answer_key)
SELECT pattern, count(*) AS chains, count(*) FILTER (n = 2) AS of_two, count(*) FILTER (n = 3) AS of_three, count(secret) AS with_secret, count(stake) AS with_stake, count(kind) AS with_kind, count(DISTINCT topic) AS topics, count(*) FILTER (k = n) AS all_clues, count(*) FILTER (fewest = 0) AS empty_clue, CAST(sum(msgs) AS BIGINT) AS messages,
count(*) FILTER (msgs > k) AS with_replies, CAST(sum(cast_size) AS BIGINT) AS cast_members, count(*) FILTER (cast_size < 2) AS cast_short, count(*) FILTER (secret IS NOT NULL AND stake IS NOT NULL AND k = n AND fewest > 0) AS whole FROM c GROUP BY 1""")
def generation_report(spark, sf_dir):
    """Fourteen counts of the chains of each pattern."""
    sizes = F.transform(F.map_values("planted"), lambda x: F.size(x))
    c = table(spark, sf_dir, "answer_key").withColumn("k", F.size("planted")).withColumn("msgs", F.aggregate(sizes, F.lit(0), lambda a, x: a + x)).withColumn("fewest", F.array_min(sizes)).withColumn("cast_size", F.size("names"))
    n = lambda e: F.count(F.when(F.expr(e), 1))
    return c.groupBy("pattern").agg(
        F.count("*").alias("chains"), n("n = 2").alias("of_two"), n("n = 3").alias("of_three"), F.count("secret").alias("with_secret"), F.count("stake").alias("with_stake"), F.count("kind").alias("with_kind"), F.count_distinct("topic").alias("topics"), n("k = n").alias("all_clues"), n("fewest = 0").alias("empty_clue"),
        F.sum("msgs").alias("messages"), n("msgs > k").alias("with_replies"), F.sum("cast_size").alias("cast_members"), n("cast_size < 2").alias("cast_short"), n("secret IS NOT NULL AND stake IS NOT NULL AND k = n AND fewest > 0").alias("whole"),
    )


@query("SELECT slot, value, count(*) AS drawn, count(*) FILTER (n = 3) AS of_three FROM (SELECT n, unnest(map_keys(names)) AS slot, unnest(map_values(names)) AS value FROM answer_key) GROUP BY 1, 2")
def slot_tally(spark, sf_dir):
    k = table(spark, sf_dir, "answer_key").select("n", F.explode("names").alias("slot", "value"))
    return k.groupBy("slot", "value").agg(F.count("*").alias("drawn"), F.count(F.when(F.col("n") == 3, 1)).alias("of_three"))


@query("SELECT chain, pattern, secret IS NOT NULL AND len(map_keys(planted)) = n AND NOT contains(secret, '<<') AS survives FROM answer_key")
def surviving_chain(spark, sf_dir):
    return table(spark, sf_dir, "answer_key").select("chain", "pattern", (F.col("secret").isNotNull() & (F.size(F.map_keys("planted")) == F.col("n")) & ~F.contains("secret", F.lit("<<"))).alias("survives"))


@query("SELECT DISTINCT topic, pattern FROM (SELECT t.topic, p.pattern FROM topics t, (SELECT DISTINCT pattern FROM answer_key) p WHERE t.note IS NOT NULL AND NOT EXISTS (SELECT 1 FROM answer_key k WHERE k.topic = t.topic AND k.pattern = p.pattern))")
def job_expansion(spark, sf_dir):
    """Pairs of topic and pattern still without a chain; both are fixed vocabularies."""
    k = table(spark, sf_dir, "answer_key").select("topic", "pattern").distinct()
    jobs = table(spark, sf_dir, "topics").where("note IS NOT NULL").select("topic").crossJoin(F.broadcast(bounded(k.select("pattern").distinct(), 1_000)))
    return jobs.join(k, ["topic", "pattern"], "left_anti").distinct()


@query("SELECT chain, CASE WHEN len(map_keys(planted)) <> n THEN 'clues missing' WHEN len(list_filter(map_values(planted), lambda x: len(x) = 0)) > 0 THEN 'empty clue' WHEN secret IS NULL OR stake IS NULL THEN 'no text' ELSE 'ok' END AS reason FROM answer_key")
def plan_validation(spark, sf_dir):
    r = F.when(F.size("planted") != F.col("n"), "clues missing").when(F.exists(F.map_values("planted"), lambda x: F.size(x) == 0), "empty clue").when(F.col("secret").isNull() | F.col("stake").isNull(), "no text").otherwise("ok")
    return table(spark, sf_dir, "answer_key").select("chain", r.alias("reason"))


# ---- windows, order, sampling


@query(f"{M} SELECT email_id, row_number() OVER (PARTITION BY thread_id ORDER BY \"date\", email_id) AS pos, count(*) OVER (PARTITION BY thread_id) AS len FROM mails WHERE thread_id IS NOT NULL")
def thread_pos(spark, sf_dir):
    m = mails(spark, sf_dir).where("thread_id IS NOT NULL")
    w = Window.partitionBy("thread_id")
    return m.select("email_id", F.row_number().over(w.orderBy("date", "email_id")).cast("long").alias("pos"), F.count("*").over(w).alias("len"))


_RR = f"""{M}, n AS (SELECT email_id, "from" AS s, {NORM.format('topic')} AS topic FROM mails WHERE topic IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY topic, s ORDER BY md5('7:' || email_id), email_id) AS rn FROM n)"""


@query(f"{_RR}, o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY rn, md5('7:' || s), s) AS k FROM r WHERE rn <= 3) SELECT topic, email_id, k FROM o WHERE k <= 20")
def round_robin(spark, sf_dir):
    """One mail a sender and round, at most three a sender, twenty a topic."""
    m = mails(spark, sf_dir).where("topic IS NOT NULL").select("email_id", F.col("from").alias("s"), X.label_key("topic").alias("topic"))
    rn = F.row_number().over(Window.partitionBy("topic", "s").orderBy(_md5(F.lit("7"), "email_id"), "email_id"))
    r = m.withColumn("rn", rn).where("rn <= 3")
    k = F.row_number().over(Window.partitionBy("topic").orderBy("rn", _md5(F.lit("7"), "s"), "s")).cast("long")
    return r.withColumn("k", k).where("k <= 20").select("topic", "email_id", "k")


@query(f"{M}, n AS (SELECT thread_id, {NORM.format('topic')} AS topic FROM mails WHERE topic IS NOT NULL) SELECT thread_id, count(DISTINCT topic) AS topics, count(*) AS n, count(DISTINCT topic) > 1 AS mixed FROM n GROUP BY 1")
def subthread_split(spark, sf_dir):
    m = mails(spark, sf_dir).where("topic IS NOT NULL").select("thread_id", X.label_key("topic").alias("topic"))
    g = m.groupBy("thread_id").agg(F.count_distinct("topic").alias("topics"), F.count("*").alias("n"))
    return g.withColumn("mixed", F.col("topics") > 1)


_NOISE = f"""{M}, c AS (SELECT "from" AS s, count(*) AS n, max(starts_with(email_id, 'p_')::INT) AS planted FROM mails GROUP BY 1), t AS (SELECT m.email_id, CASE WHEN c.planted = 1 THEN 0 WHEN c.n > 1 THEN 1 ELSE 2 END AS tier FROM mails m JOIN c ON c.s = m."from" WHERE NOT starts_with(m.email_id, 'p_')),
r AS (SELECT email_id, tier, case_id, row_number() OVER (PARTITION BY case_id ORDER BY tier, md5('11:' || case_id || ':' || email_id), email_id) AS k FROM t, (VALUES (1), (2), (3)) x(case_id))"""


@query(f"{_NOISE} SELECT case_id, email_id, tier, k, k <= 100 AS in_100 FROM r WHERE k <= 200")
def nested_noise(spark, sf_dir):
    """Noise mails of three cases, the planted senders' first; smaller levels lie inside larger ones. A candidate survives its hash block before the final order."""
    m = mails(spark, sf_dir).select("email_id", F.col("from").alias("s"))
    c = m.groupBy("s").agg(F.count("*").alias("n"), F.max(F.col("email_id").startswith("p_").cast("int")).alias("planted"))
    tier = F.when(F.col("planted") == 1, 0).when(F.col("n") > 1, 1).otherwise(2)
    t = m.where(~F.col("email_id").startswith("p_")).join(c, "s").select("email_id", tier.alias("tier"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("case_id"))
    t = t.withColumn("h", _md5(F.lit("11"), "case_id", "email_id"))
    block = F.pmod(F.xxhash64("email_id"), F.lit(64))
    t = t.withColumn("b", F.row_number().over(Window.partitionBy("case_id", block).orderBy("tier", "h", "email_id"))).where("b <= 200")
    k = F.row_number().over(Window.partitionBy("case_id").orderBy("tier", "h", "email_id")).cast("long")
    return t.withColumn("k", k).where("k <= 200").select("case_id", "email_id", "tier", "k", (F.col("k") <= 100).alias("in_100"))


@query(f"""{_NOISE} SELECT r.case_id, r.email_id, 'e' || row_number() OVER (PARTITION BY case_id ORDER BY m."date", r.email_id) AS handle FROM r JOIN mails m USING (email_id) WHERE k <= 100""")
def handles(spark, sf_dir):
    n = nested_noise(spark, sf_dir).where("in_100").select("case_id", "email_id").join(mails(spark, sf_dir).select("email_id", "date"), "email_id")
    return n.select("case_id", "email_id", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy("case_id").orderBy("date", "email_id"))).alias("handle"))


@query(f"{M}, t AS (SELECT thread_id, min(\"date\") AS first, min(email_id) AS id FROM mails WHERE thread_id IS NOT NULL GROUP BY 1) SELECT first AS month, count(*) AS threads, min(id) AS first_id FROM (SELECT thread_id, first[1:7] AS first, id FROM t) GROUP BY 1")
def thread_placement(spark, sf_dir):
    t = mails(spark, sf_dir).where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.min("date").alias("first"), F.min("email_id").alias("id"))
    return t.groupBy(F.substring("first", 1, 7).alias("month")).agg(F.count("*").alias("threads"), F.min("id").alias("first_id"))


@query(f"{M}, t AS (SELECT thread_id, row_number() OVER (ORDER BY min(\"date\"), thread_id) - 1 AS i, count(*) OVER () AS n FROM mails WHERE thread_id IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT CAST(floor(j * n / 40) AS BIGINT) AS i FROM range(40) r(j), (SELECT max(n) AS n FROM t)) SELECT thread_id, i FROM t WHERE i IN (SELECT i FROM p)")
def stride_sample(spark, sf_dir):
    """Forty threads at equal strides of the date order; positions come from counts of earlier keys by day and are exact."""
    t = mails(spark, sf_dir).where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.min("date").alias("d"))
    days = t.groupBy("d").agg(F.count("*").alias("k"))
    before = days.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("d").alias("dd"), "before")  # one row a day
    n = t.agg(F.count("*").alias("n"))
    pos = t.join(before, t["d"].eqNullSafe(before["dd"])).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("d").orderBy("thread_id")) - 1)
    picks = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.floor(j * F.col("n") / 40))).alias("i")).distinct()
    return pos.join(picks, "i").select("thread_id", "i")


@query(f"{M}, t AS (SELECT DISTINCT thread_id FROM mails WHERE thread_id IS NOT NULL) SELECT thread_id, CAST((row_number() OVER (ORDER BY md5('5:' || thread_id), thread_id) - 1) // 50 AS BIGINT) AS page FROM t")
def paging(spark, sf_dir):
    """Threads in hash order, fifty a page; ranks come from counts of hash blocks."""
    t = mails(spark, sf_dir).where("thread_id IS NOT NULL").select("thread_id").distinct().withColumn("h", _md5(F.lit("5"), "thread_id")).withColumn("blk", F.substring("h", 1, 2))
    b = t.groupBy("blk").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("blk", "before")  # 256 rows
    r = t.join(b, "blk").withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("blk").orderBy("h", "thread_id")) - 1)
    return r.select("thread_id", F.floor(F.col("r") / 50).cast("long").alias("page"))


@query("SELECT chain FROM (SELECT chain, row_number() OVER (ORDER BY chain) - 1 AS i, count(*) OVER () AS n FROM answer_key) WHERE i % greatest(n // 10, 1) = 0 ORDER BY chain LIMIT 10")
def paired_controls(spark, sf_dir):
    """Every step-th chain, ten at most; chains are few."""
    k = table(spark, sf_dir, "answer_key").select("chain")
    r = k.withColumn("i", F.row_number().over(Window.orderBy("chain")) - 1).crossJoin(k.agg(F.count("*").alias("n")))
    return r.where(F.col("i") % F.greatest(F.floor(F.col("n") / 10), F.lit(1)) == 0).orderBy("chain").limit(10).select("chain")


@query(f"{_RR} SELECT topic, email_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY email_id) AS k FROM n) WHERE k <= 5")
def per_group_first_n(spark, sf_dir):
    m = mails(spark, sf_dir).where("topic IS NOT NULL").select("email_id", X.label_key("topic").alias("topic"))
    return m.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy("email_id"))).where("k <= 5").select("topic", "email_id")


@query("SELECT split_part(addr, '@', 2) AS domain, count(*) AS senders FROM (SELECT DISTINCT from_addr AS addr FROM parsed_emails) GROUP BY 1 ORDER BY senders DESC, domain LIMIT 1")
def modal_domain(spark, sf_dir):
    p = table(spark, sf_dir, "parsed_emails").select("from_addr").distinct().groupBy(F.substring_index("from_addr", "@", -1).alias("domain")).agg(F.count("*").alias("senders"))
    return p.orderBy(F.desc("senders"), "domain").limit(1)


@query("SELECT DISTINCT email_id FROM mailbox EXCEPT SELECT email_id FROM name_audit")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "mailbox").select("email_id").distinct().subtract(table(spark, sf_dir, "name_audit").select("email_id"))


@query("SELECT email_id FROM name_audit INTERSECT SELECT email_id FROM topic_labels")
def set_intersection(spark, sf_dir):
    return table(spark, sf_dir, "name_audit").select("email_id").intersect(table(spark, sf_dir, "topic_labels").select("email_id"))


@query("SELECT email_id, 'mail' AS src FROM mailbox WHERE starts_with(email_id, 'p_') UNION ALL SELECT message_id, 'archive' FROM parsed_emails")
def bag_union(spark, sf_dir):
    a = table(spark, sf_dir, "mailbox").where(F.col("email_id").startswith("p_")).select("email_id", F.lit("mail").alias("src"))
    return a.unionByName(table(spark, sf_dir, "parsed_emails").select(F.col("message_id").alias("email_id"), F.lit("archive").alias("src")))


@query(f"WITH {_LOG}, u AS (SELECT session_id, seq, unnest(returned) AS id, generate_subscripts(returned, 1) AS p FROM l) SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY min((seq, p))) AS k FROM u GROUP BY 1, 2")
def ordered_distinct(spark, sf_dir):
    """Ids in the order a session first saw them."""
    u = _log(spark, sf_dir).select("session_id", "seq", F.posexplode("returned").alias("p", "id")).groupBy("session_id", "id").agg(F.min(F.struct("seq", "p")).alias("at"))
    return u.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).cast("long").alias("k"))


@query("SELECT message_id, min(file_path) AS file_path FROM parsed_emails WHERE message_id IS NOT NULL GROUP BY 1")
def smallest_path(spark, sf_dir):
    return table(spark, sf_dir, "parsed_emails").where("message_id IS NOT NULL").groupBy("message_id").agg(F.min("file_path").alias("file_path"))


# ---- search


def _bm25_sql(docs: str, queries: str, k: int) -> str:
    return f"""d AS ({docs}), dt AS (SELECT doc, {tokens("coalesce(text, '')")} AS t FROM d), n AS (SELECT count(*) AS N, avg(len(t)) AS avgdl FROM dt), p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(t) AS len, unnest(t) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), qs AS ({queries}), qt AS (SELECT DISTINCT qid, unnest(list_distinct({tokens("coalesce(query, '')")})) AS term FROM qs),
s AS (SELECT qid, doc, round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), n GROUP BY 1, 2)
SELECT qid, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


@query("WITH " + MAILS.strip()[5:] + ", " + _bm25_sql("SELECT email_id AS doc, coalesce(subject, '') || ' ' || body AS text FROM mails", "SELECT DISTINCT arg AS qid, arg AS query FROM tool_log WHERE tool = 'search' AND arg IS NOT NULL", 12))
def bm25_topk(spark, sf_dir):
    """The twelve best mails of every recorded search."""
    d = mails(spark, sf_dir).select("email_id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), "body").alias("text"))
    qs = table(spark, sf_dir, "tool_log").where("tool = 'search' AND arg IS NOT NULL").select(F.col("arg").alias("qid"), F.col("arg").alias("query")).distinct()
    return search.bm25(d, "email_id", "text", qs, 12)


@query(f"""WITH {_LOG}, t AS (SELECT session_id, seq, list_distinct({tokens("coalesce(arg, '')")}) AS t FROM l WHERE tool = 'search'), p AS (SELECT session_id, seq, t, lag(t) OVER (PARTITION BY session_id ORDER BY seq) AS o FROM t)
SELECT session_id, seq, round(CASE WHEN len(list_distinct(list_concat(t, o))) = 0 THEN 0 ELSE len(list_intersect(t, o)) / len(list_distinct(list_concat(t, o))) END, 6) AS jaccard FROM p WHERE o IS NOT NULL""")
def jaccard(spark, sf_dir):
    """Likeness of each search to the one before it in the session."""
    t = _log(spark, sf_dir).where("tool = 'search'").select("session_id", "seq", F.array_distinct(X.search_tokens("arg")).alias("t"))
    p = t.withColumn("o", F.lag("t").over(Window.partitionBy("session_id").orderBy("seq"))).where("o IS NOT NULL")
    return p.select("session_id", "seq", F.round(X.jaccard(F.col("t"), F.col("o")), 6).alias("jaccard"))


# ---- sessions


@query(f"WITH {_LOG}, u AS (SELECT session_id, seq, tool, CAST(sum((coalesce(tool, '') IN ('search', 'read', 'list'))::INT) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS used FROM l) SELECT session_id, seq, used, used <= 5 OR tool NOT IN ('search', 'read', 'list') AS allowed FROM u")
def session_budget(spark, sf_dir):
    return session.with_budget(_log(spark, sf_dir), 5).select("session_id", "seq", "used", "allowed")


@query()
def investigation_credit(spark, sf_dir):
    return session.credit(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, a AS (SELECT session_id, max(seq) AS seq FROM l WHERE tool = 'answer' GROUP BY 1), f AS (SELECT l.session_id, list_distinct(l.returned) AS ids FROM l JOIN a ON a.session_id = l.session_id AND a.seq = l.seq),
p AS (SELECT DISTINCT unnest(flatten(map_values(planted))) AS id FROM answer_key), e AS (SELECT session_id, unnest(ids) AS id FROM f) SELECT f.session_id, count(p.id) > 0 AS found, CAST(count(e.id) AS BIGINT) AS cited, CAST(count(p.id) AS BIGINT) AS planted FROM f LEFT JOIN e ON e.session_id = f.session_id LEFT JOIN p ON p.id = e.id GROUP BY 1""")
def session_score(spark, sf_dir):
    """What the last answer of each session cited, and how much of it was planted."""
    l = _log(spark, sf_dir).where("tool = 'answer'")
    f = l.groupBy("session_id").agg(F.max(F.struct("seq", "returned")).alias("b")).select("session_id", F.explode_outer(F.array_distinct("b.returned")).alias("id"))
    p = table(spark, sf_dir, "answer_key").select(F.explode(F.flatten(F.map_values("planted"))).alias("id")).distinct().withColumn("hit", F.lit(1))
    return f.join(p, "id", "left").groupBy("session_id").agg((F.count("hit") > 0).alias("found"), F.count("id").alias("cited"), F.count("hit").alias("planted"))
