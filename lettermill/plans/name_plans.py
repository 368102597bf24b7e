"""Queries of names and releases: registers, guards, reserves, ids in shuffled order, relabelling in batches; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions import text as X
from lettermill.operators.order import numbered
from lettermill.plans import text_plans
from lettermill.plans.text_plans import mails
from lettermill.plans.text_sql import MAILS
from lettermill.plans import text_sql
from lettermill.session import bounded, merged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
M = MAILS.rstrip()
TWO = r"^([a-z]+)[._]([a-z]+)@"
NAME = r"^[A-Z][a-z]+ [A-Z][a-z]+$"
ROLES = ("notices", "info", "office", "contact", "billing", "admin", "news", "support", "sales")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(col: str) -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z]+)"), F.lit(1)))


_REG = rf"""r AS (SELECT DISTINCT regexp_extract(lower("from"), '{TWO}', 1) AS first, regexp_extract(lower("from"), '{TWO}', 2) AS last FROM mails WHERE regexp_matches(lower("from"), '{TWO}'))"""
_TOK = "tk AS (SELECT email_id, w, lower(w) = w AS low FROM (SELECT email_id, unnest(regexp_extract_all(body, '[A-Za-z]+')) AS w FROM mails))"


def _register(m: DataFrame) -> DataFrame:
    a = F.lower("from")
    return m.where(a.rlike(TWO)).select(F.regexp_extract(a, TWO, 1).alias("first"), F.regexp_extract(a, TWO, 2).alias("last")).distinct()


def _tokens(m: DataFrame) -> DataFrame:
    return m.select("email_id", F.explode(F.regexp_extract_all("body", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).withColumn("low", F.lower("w") == F.col("w"))


@query(f"""{M}, {_REG}, {_TOK}, s AS (SELECT DISTINCT last AS w FROM r), c AS (SELECT lower(w) AS w, count(DISTINCT email_id) AS mails, count(*) AS n, count(*) FILTER (low) AS low_n FROM tk WHERE lower(w) IN (SELECT w FROM s) GROUP BY 1)
SELECT s.w AS surname, coalesce(mails, 0) AS mails, coalesce(n, 0) AS occurrences, coalesce(low_n, 0) AS low_n, CASE WHEN n IS NULL THEN 'gone' WHEN low_n = n THEN 'word only' WHEN low_n * 4 >= n THEN 'wordlike' WHEN mails = 1 THEN 'once' ELSE 'genuine' END AS bucket FROM s LEFT JOIN c ON c.w = s.w""")
def surname_release(spark, sf_dir):
    """Every real surname of a sender address with what survives of it in the bodies: gone, an ordinary word, wordlike, once, or genuine."""
    m = mails(spark, sf_dir)
    s = _register(m).select(F.col("last").alias("surname")).distinct()
    t = _tokens(m).withColumn("surname", F.lower("w")).join(merged(s), "surname", "left_semi")
    c = t.groupBy("surname").agg(F.count_distinct("email_id").alias("mails"), F.count("*").alias("occurrences"), F.count(F.when(F.col("low"), 1)).alias("low_n"))
    n, low = F.col("occurrences"), F.col("low_n")
    bucket = F.when(n.isNull(), "gone").when(low == n, "word only").when(low * 4 >= n, "wordlike").when(F.col("mails") == 1, "once").otherwise("genuine")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return s.join(merged(c), "surname", "left").select("surname", bucket.alias("bucket"), zero("mails"), zero("occurrences"), zero("low_n"))


KEEP, GO = ("right after the", "would rather", "my only worry"), ("original message", "forwarded by", "sent from my")


@query(f"""{M} SELECT phrase, kind, count(*) FILTER (contains(lower(body), phrase)) AS mails, CAST(sum((length(lower(body)) - length(replace(lower(body), phrase, ''))) / length(phrase)) AS BIGINT) AS occurrences
FROM mails, (VALUES {", ".join(f"('{p}', '{k}')" for k, ps in (("keep", KEEP), ("go", GO)) for p in ps)}) x(phrase, kind) GROUP BY 1, 2""")
def release_phrases(spark, sf_dir):
    """Mails and places of phrases that must be kept in a release and of those that must go; the phrases are a short list of the caller's."""
    phrases = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(k).alias("kind")) for k, ps in (("keep", KEEP), ("go", GO)) for p in ps])
    m = mails(spark, sf_dir).select(F.lower("body").alias("b"), F.explode(phrases).alias("p")).select("b", "p.*")
    n = (F.length("b") - F.length(F.replace("b", F.col("phrase"), F.lit("")))) / F.length("phrase")
    return m.groupBy("phrase", "kind").agg(F.count(F.when(n > 0, 1)).alias("mails"), F.sum(n).cast("long").alias("occurrences"))


@query(f"""{M}, x AS (SELECT thread_id, email_id, coalesce(thread_pos, 0) AS pos, md5('9:' || thread_id) AS h FROM mails WHERE thread_id IS NOT NULL), t AS (SELECT thread_id, row_number() OVER (ORDER BY md5('9:' || thread_id), thread_id) AS k FROM (SELECT DISTINCT thread_id FROM x))
SELECT x.thread_id, x.email_id, 't_' || lpad(CAST(k AS VARCHAR), 6, '0') AS new_thread, 'e_' || lpad(CAST(row_number() OVER (ORDER BY h, x.thread_id, pos, email_id) AS VARCHAR), 8, '0') AS new_email FROM x JOIN t USING (thread_id)""")
def shuffled_ids(spark, sf_dir):
    """New ids: threads in hash order, mails in the order of their threads."""
    m = mails(spark, sf_dir).where("thread_id IS NOT NULL").select("thread_id", "email_id", F.coalesce("thread_pos", F.lit(0)).alias("pos"), F.md5(F.concat(F.lit("9:"), "thread_id")).alias("h"))
    t = numbered(m.select("h", "thread_id").distinct(), "h", "thread_id", name="t")
    e = numbered(m, "h", "thread_id", "pos", "email_id", name="e")
    pad = lambda p, c, n: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), n, "0"))
    return e.join(merged(t.select("thread_id", "t")), "thread_id").select("thread_id", "email_id", pad("t_", "t", 6).alias("new_thread"), pad("e_", "e", 8).alias("new_email"))


_ELSE = rf"""n AS (SELECT DISTINCT "from" AS raw, lower("from") AS name FROM mails WHERE regexp_matches("from", '{NAME}')), ww AS (SELECT email_id, lower("from") AS sender, regexp_extract_all(lower(body), '[a-z]+') AS w FROM mails),
b AS (SELECT DISTINCT sender, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM ww)"""


def named_by_others(m: DataFrame) -> DataFrame:
    """(name): sender names of two words that stand in full in another sender's mail: a substring test as an equi-join on word pairs."""
    w = m.select(F.lower("from").alias("sender"), F.col("from").alias("raw"), F.regexp_extract_all(F.lower("body"), F.lit("([a-z]+)"), F.lit(1)).alias("w"))
    names = w.where(F.col("raw").rlike(NAME)).select(F.col("sender").alias("name")).distinct()
    pairs = w.where(F.size("w") > 1).select("sender", F.explode(F.array_distinct(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b)))).alias("name"))
    return pairs.join(merged(names), "name").where("sender <> name").select("name").distinct()


@query(f"{M}, {_ELSE} SELECT raw AS name FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.name = n.name AND b.sender <> n.name)")
def not_named_elsewhere(spark, sf_dir):
    """Sender names that no other sender's mail holds in full."""
    m = mails(spark, sf_dir)
    n = m.where(F.col("from").rlike(NAME)).select(F.col("from").alias("raw"), F.lower("from").alias("name")).distinct()
    return n.join(merged(named_by_others(m)), "name", "left_anti").select(F.col("raw").alias("name"))


@query(f"""{M}, {_ELSE}, s AS (SELECT "from" AS s, min(email_id) AS email_id, count(*) AS n, min(thread_id) AS thread_id FROM mails GROUP BY 1), t AS (SELECT thread_id, count(*) AS k FROM mails GROUP BY 1)
SELECT s.s AS sender, s.email_id, k - 1 AS others FROM s JOIN t USING (thread_id) WHERE n = 1 AND k <= 4 AND NOT EXISTS (SELECT 1 FROM n JOIN b USING (name) WHERE n.raw = s.s AND b.sender <> n.name)""")
def quiet_senders(spark, sf_dir):
    """Senders of exactly one mail with at most three others in its thread, whom nobody else names."""
    m = mails(spark, sf_dir)
    s = m.groupBy(F.col("from").alias("sender")).agg(F.min("email_id").alias("email_id"), F.count("*").alias("n"), F.min("thread_id").alias("thread_id")).where("n = 1")
    t = m.groupBy("thread_id").agg(F.count("*").alias("k"))
    one = s.join(merged(t), "thread_id").where("k <= 4").select("sender", "email_id", (F.col("k") - 1).alias("others"), F.when(F.col("sender").rlike(NAME), F.lower("sender")).alias("name"))
    return one.join(merged(named_by_others(m)), "name", "left_anti").select("sender", "email_id", "others")


@query(r"""WITH f AS (SELECT DISTINCT regexp_extract(file_path, '([^/]+)$', 1) AS name, regexp_extract(file_path, '^(.*)/[^/]+$', 1) AS folder FROM parsed_emails WHERE file_path IS NOT NULL), s AS (SELECT folder, name, regexp_replace(lower(regexp_replace(name, '\.[A-Za-z]*$', '')), '[0-9_ -]+$', '') AS stem FROM f),
o AS (SELECT folder, stem, min(name) AS name FROM s GROUP BY 1, 2) SELECT folder, stem, name, k FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY stem) AS k FROM o) WHERE k <= 3""")
def distinct_stems(spark, sf_dir):
    """Of each folder the first three file names of different stems; one name a stem."""
    p = table(spark, sf_dir, "parsed_emails").where("file_path IS NOT NULL").select(F.regexp_extract("file_path", "([^/]+)$", 1).alias("name"), F.regexp_extract("file_path", "^(.*)/[^/]+$", 1).alias("folder")).distinct()
    stem = F.regexp_replace(F.lower(F.regexp_replace("name", r"\.[A-Za-z]*$", "")), "[0-9_ -]+$", "")
    o = p.withColumn("stem", stem).groupBy("folder", "stem").agg(F.min("name").alias("name"))
    return o.withColumn("k", F.row_number().over(Window.partitionBy("folder").orderBy("stem")).cast("long")).where("k <= 3")


@query(f"""WITH sn AS ({text_sql.SQL["signed_name"]}), mm AS (SELECT email_id, max("from") AS f FROM mailbox WHERE body IS NOT NULL GROUP BY 1), x AS (SELECT email_id, signed, regexp_extract(lower(f), '{TWO}', 1) AS given FROM sn JOIN mm USING (email_id))
SELECT email_id, signed, CASE WHEN signed = '' OR given = '' THEN 'cannot compare' WHEN lower(signed) = given THEN 'same' ELSE 'differs' END AS consistent FROM x""")
def name_consistency(spark, sf_dir):
    """Is the signed first name the first part of the sender's address?"""
    m = mails(spark, sf_dir).select("email_id", F.regexp_extract(F.lower("from"), TWO, 1).alias("given"))
    x = text_plans.signed_name(spark, sf_dir).join(m, "email_id")
    c = F.when((F.col("signed") == "") | (F.coalesce("given", F.lit("")) == ""), "cannot compare").when(F.lower("signed") == F.col("given"), "same").otherwise("differs")
    return x.select("email_id", "signed", c.alias("consistent"))


_ROLE_SQL = ", ".join(f"'{r}'" for r in ROLES)


@query(rf"""{M}, d AS (SELECT split_part(from_addr, '@', 2) AS dom, count(DISTINCT from_addr) AS n FROM parsed_emails WHERE from_addr IS NOT NULL GROUP BY 1), firm AS (SELECT dom FROM d ORDER BY n DESC, dom LIMIT 1), a AS (SELECT DISTINCT lower(x) AS addr FROM parsed_emails, unnest(to_addrs) AS t(x) WHERE split_part(lower(x), '@', 2) = (SELECT dom FROM firm)),
k AS (SELECT addr, regexp_extract(addr, '([a-z]+)@', 1) AS surname, split_part(addr, '@', 1) AS local FROM a), w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(body, '[A-Za-z]+'))) AS w FROM mails) SELECT addr, surname FROM k WHERE surname <> '' AND local NOT IN ({_ROLE_SQL}) AND surname IN (SELECT w FROM w)""")
def address_book(spark, sf_dir):
    """Addresses of the main firm whose surname occurs in the mails; accounts of a role are refused."""
    p = table(spark, sf_dir, "parsed_emails")
    firm = p.where("from_addr IS NOT NULL").groupBy(F.substring_index("from_addr", "@", -1).alias("dom")).agg(F.count_distinct("from_addr").alias("n")).orderBy(F.desc("n"), "dom").limit(1).select("dom")
    a = p.select(F.explode("to_addrs").alias("addr")).select(F.lower("addr").alias("addr")).distinct().withColumn("dom", F.substring_index("addr", "@", -1)).join(F.broadcast(firm), "dom")
    k = a.select("addr", F.regexp_extract("addr", "([a-z]+)@", 1).alias("surname")).where((F.col("surname") != "") & ~F.substring_index("addr", "@", 1).isin(*ROLES))
    w = mails(spark, sf_dir).select(F.explode(_words("body")).alias("surname")).distinct()
    return k.join(merged(w), "surname", "left_semi").select("addr", "surname")


@query(f"""{M}, d AS (SELECT DISTINCT regexp_extract(lower("from"), '@(?:[a-z0-9-]+\\.)*?([a-z0-9-]+)\\.[a-z]+', 1) AS w FROM mails), {_TOK}, lw AS (SELECT DISTINCT w FROM tk WHERE low) SELECT w AS word FROM d WHERE length(w) >= 4 AND regexp_matches(w, '^[a-z]+$') AND w NOT IN (SELECT w FROM lw)""")
def organisation_words(spark, sf_dir):
    """Second-level labels of the senders' domains that are no ordinary word of the mails."""
    m = mails(spark, sf_dir)
    d = m.select(F.regexp_extract(F.lower("from"), r"@(?:[a-z0-9-]+\.)*?([a-z0-9-]+)\.[a-z]+", 1).alias("word")).distinct().where((F.length("word") >= 4) & F.col("word").rlike("^[a-z]+$"))
    low = _tokens(m).where("low").select(F.col("w").alias("word")).distinct()
    return d.join(merged(low), "word", "left_anti")


@query(f"""{M}, a AS (SELECT DISTINCT regexp_extract(lower("from"), '([a-z0-9]+)@', 1) AS login, regexp_extract(lower("from"), '([a-z0-9._-]+)@', 1) AS whole FROM mails), {_TOK}, lw AS (SELECT DISTINCT w FROM tk WHERE low) SELECT DISTINCT login FROM a WHERE login = whole AND length(login) >= 4 AND login NOT IN (SELECT w FROM lw)""")
def bare_logins(spark, sf_dir):
    """Local parts of one word that never stand as a word in small letters, so that they can be replaced wherever they stand."""
    m = mails(spark, sf_dir)
    a = m.select(F.regexp_extract(F.lower("from"), "([a-z0-9]+)@", 1).alias("login"), F.regexp_extract(F.lower("from"), "([a-z0-9._-]+)@", 1).alias("whole")).where((F.col("login") == F.col("whole")) & (F.length("login") >= 4)).select("login").distinct()
    low = _tokens(m).where("low").select(F.col("w").alias("login")).distinct()
    return a.join(merged(low), "login", "left_anti")


@query(f"""{M}, {_REG}, f AS (SELECT first AS w, row_number() OVER (ORDER BY md5('2:' || first), first) AS k FROM (SELECT DISTINCT first FROM r)), l AS (SELECT last AS w, row_number() OVER (ORDER BY md5('2:' || last), last) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT last FROM r)),
c AS (SELECT f.w AS first, l.w AS last FROM f JOIN l ON l.k = (f.k * 7) % l.n + 1) SELECT first, last FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.first = c.first AND r.last = c.last)""")
def unused_names(spark, sf_dir):
    """A reserve of names: given names and surnames paired anew in hash order, none the name of a registered person."""
    r = _register(mails(spark, sf_dir))
    side = lambda c: numbered(r.select(F.col(c).alias(c)).distinct().withColumn("h", F.md5(F.concat(F.lit("2:"), c))), "h", c)
    f, l = side("first").drop("h"), side("last").drop("h")
    n = l.agg(F.count("*").alias("n"))
    pairs = f.crossJoin(F.broadcast(n)).withColumn("j", (F.col("k") * 7) % F.col("n") + 1).select("first", "j").join(merged(l.select(F.col("k").alias("j"), "last")), "j").select("first", "last")
    return pairs.join(merged(r), ["first", "last"], "left_anti")


_PICK = f"""{M}, t AS (SELECT thread_id, min(topic) AS topic, count(*) AS n, count(DISTINCT "from") AS writers, min(len(regexp_extract_all(body, '\\S+'))) AS least FROM mails WHERE thread_id IS NOT NULL GROUP BY 1), old AS (SELECT thread_id, topic, n FROM t WHERE writers >= 2 AND topic IS NOT NULL ORDER BY thread_id LIMIT 1),
rel AS (SELECT DISTINCT thread_id FROM mails JOIN topic_labels USING (email_id)), new AS (SELECT t.thread_id FROM t, old WHERE t.topic = old.topic AND t.n = old.n AND writers >= 2 AND least >= 30 AND t.thread_id <> old.thread_id AND t.thread_id NOT IN (SELECT thread_id FROM rel WHERE thread_id IS NOT NULL) ORDER BY md5('3:' || t.thread_id), t.thread_id LIMIT 1)"""


def _picked(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = mails(spark, sf_dir).where("thread_id IS NOT NULL")
    t = m.groupBy("thread_id").agg(F.min("topic").alias("topic"), F.count("*").alias("n"), F.count_distinct("from").alias("writers"), F.min(F.size(F.regexp_extract_all("body", F.lit(r"(\S+)"), F.lit(1)))).alias("least"))
    old = t.where("writers >= 2 AND topic IS NOT NULL").orderBy("thread_id").limit(1).select(F.col("thread_id").alias("old"), "topic", "n")
    rel = m.join(merged(table(spark, sf_dir, "topic_labels").select("email_id").distinct()), "email_id", "left_semi").select("thread_id").distinct()
    c = t.where("writers >= 2 AND least >= 30").join(F.broadcast(old), ["topic", "n"]).where("thread_id <> old").join(merged(rel), "thread_id", "left_anti")
    new = c.withColumn("h", F.md5(F.concat(F.lit("3:"), "thread_id"))).orderBy("h", "thread_id").limit(1).select("thread_id", "old")
    return m, old, new


@query(f"{_PICK} SELECT new.thread_id, old.thread_id AS old FROM new, old")
def seeded_pick(spark, sf_dir):
    """A thread to take another's place: same topic and length, two writers or more, thirty words in each mail, not in the labelled set."""
    return _picked(spark, sf_dir)[2]


@query(f"""{_PICK}, kept AS (SELECT * FROM mails WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT thread_id FROM old)) SELECT count(*) AS emails, count(DISTINCT thread_id) AS threads, count(DISTINCT "from") AS senders, CAST(sum(CAST('0x' || substr(md5(email_id), 1, 8) AS BIGINT)) AS BIGINT) AS digest, (SELECT thread_id FROM new) AS replacement FROM kept""")
def replaced_manifest(spark, sf_dir):
    """Counts and the content digest once a thread is taken out, and the thread that takes its place."""
    m, old, new = _picked(spark, sf_dir)
    kept = m.join(F.broadcast(old.select(F.col("old").alias("thread_id"))), "thread_id", "left_anti")
    a = kept.agg(F.count("*").alias("emails"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("from").alias("senders"), F.sum(F.conv(F.substring(F.md5("email_id"), 1, 8), 16, 10).cast("long")).alias("digest"))
    return a.join(new.select(F.col("thread_id").alias("replacement")), F.lit(True), "left")


@query("SELECT chain, CASE WHEN n > 3 THEN n WHEN (row_number() OVER (ORDER BY chain) - 1 + length(pattern)) % 2 = 0 THEN 3 ELSE 2 END AS threads FROM (SELECT chain, min(n) AS n, min(pattern) AS pattern FROM answer_key GROUP BY 1)")
def thread_count_rule(spark, sf_dir):
    """Three threads and two in turn over the chains and their patterns; more where the chain asks for it."""
    k = numbered(table(spark, sf_dir, "answer_key").groupBy("chain").agg(F.min("n").alias("n"), F.min("pattern").alias("pattern")), "chain")
    return k.select("chain", F.when(F.col("n") > 3, F.col("n")).when((F.col("k") - 1 + F.length("pattern")) % 2 == 0, 3).otherwise(2).alias("threads"))


BATCH_BITS = 6


@query(f"""{M}, v AS (SELECT DISTINCT topic FROM topics WHERE topic IS NOT NULL), x AS (SELECT email_id, topic IN (SELECT topic FROM v) AND topic IS NOT NULL AS ok, row_number() OVER (ORDER BY email_id) - 1 AS k FROM mails), d AS (SELECT email_id, ok, k // 64 AS batch, d, (k % 64) >> ({BATCH_BITS} - d) AS node FROM x, range(0, {BATCH_BITS + 1}) r(d)),
g AS (SELECT batch, d, node FROM d GROUP BY ALL HAVING bool_and(ok)) SELECT email_id, min(CASE WHEN g.d IS NOT NULL THEN d.d END) AS depth, ok AS labelled FROM d LEFT JOIN g ON g.batch = d.batch AND g.d = d.d AND g.node = d.node GROUP BY email_id, ok""")
def batch_relabel(spark, sf_dir):
    """Relabelling in batches of 64 answers: a batch with an answer outside the vocabulary is halved until the bad ones stand alone; the depth at which each answer was accepted."""
    vocab = bounded(table(spark, sf_dir, "topics").where("topic IS NOT NULL").select("topic").distinct(), 10_000).withColumn("ok", F.lit(True))
    x = mails(spark, sf_dir).select("email_id", "topic").join(F.broadcast(vocab), "topic", "left").select("email_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    x = numbered(x, "email_id").withColumn("k", F.col("k") - 1)
    node = lambda d: F.shiftright((F.col("k") % 64).cast("int"), BATCH_BITS - d)
    d = x.select("email_id", "ok", F.floor(F.col("k") / 64).alias("batch"), F.posexplode(F.array(*[node(i) for i in range(BATCH_BITS + 1)])).alias("d", "node"))
    g = d.groupBy("batch", "d", "node").agg(F.bool_and("ok").alias("all_ok"))
    j = d.join(merged(g), ["batch", "d", "node"])
    return j.groupBy("email_id", F.col("ok").alias("labelled")).agg(F.min(F.when(F.col("all_ok"), F.col("d"))).cast("long").alias("depth"))


@query(f"""{M}, {_REG}, w AS (SELECT DISTINCT first AS w FROM r UNION SELECT DISTINCT last FROM r), f AS (SELECT DISTINCT email_id, f.name AS name FROM (SELECT email_id, unnest(found) AS f FROM name_audit) WHERE f.name IS NOT NULL), k AS (SELECT email_id, name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z]{{2,}}'))) AS w FROM f),
s AS (SELECT email_id, name, avg(CASE WHEN w IN (SELECT w FROM w) THEN 1.0 ELSE 0.0 END) AS share FROM k GROUP BY 1, 2) SELECT email_id, name, CASE WHEN share = 1 THEN 'clean' WHEN share > 0 THEN 'partial' ELSE 'leak' END AS class FROM s""")
def audit_classes(spark, sf_dir):
    """Audited names by the share of their words that belong to registered people: all, some or none."""
    r = _register(mails(spark, sf_dir))
    w = r.select(F.col("first").alias("w")).union(r.select("last")).distinct().withColumn("hit", F.lit(1.0))
    f = table(spark, sf_dir, "name_audit").select("email_id", F.explode("found").alias("f")).select("email_id", F.col("f.name").alias("name")).where("name IS NOT NULL").distinct()
    k = f.select("email_id", "name", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]{2,})"), F.lit(1)))).alias("w"))
    s = k.join(merged(w), "w", "left").groupBy("email_id", "name").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return s.select("email_id", "name", F.when(F.col("share") == 1, "clean").when(F.col("share") > 0, "partial").otherwise("leak").alias("class"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\be[0-9]+\b'), ' ') AS handles, len(regexp_extract_all(text, '\be[0-9]+\b')) AS n FROM documents WHERE source = 'search_log' AND text IS NOT NULL")
def handle_lists(spark, sf_dir):
    """Handles of a reranker's answer in the order given."""
    h = F.regexp_extract_all("text", F.lit(r"(\be[0-9]+\b)"), F.lit(1))
    return table(spark, sf_dir, "documents").where("source = 'search_log' AND text IS NOT NULL").select("doc_id", F.array_join(h, " ").alias("handles"), F.size(h).cast("long").alias("n"))


_DISPLAY = r"^\"?([A-Za-z]+)(?: [A-Z]\.?)? ([A-Za-z'-]+)\"? <([^>]+)>$"


@query(rf"""{M}, x AS (SELECT lower(regexp_extract("from", '{_DISPLAY.replace("'", "''")}', 3)) AS addr, lower(regexp_extract("from", '{_DISPLAY.replace("'", "''")}', 1)) AS first, lower(regexp_extract("from", '{_DISPLAY.replace("'", "''")}', 2)) AS last FROM mails WHERE regexp_matches("from", '{_DISPLAY.replace("'", "''")}')), g AS (SELECT addr, first, last, count(*) AS n FROM x GROUP BY ALL)
SELECT addr, arg_min(first, (-n, first, last)) AS first, arg_min(last, (-n, first, last)) AS last, max(n) AS n FROM g GROUP BY 1""")
def canonical_name(spark, sf_dir):
    """The most frequent display name of each address, alphabetical on ties."""
    part = lambda i: F.lower(F.regexp_extract("from", _DISPLAY, i))
    g = mails(spark, sf_dir).where(F.col("from").rlike(_DISPLAY)).groupBy(part(3).alias("addr"), part(1).alias("first"), part(2).alias("last")).agg(F.count("*").alias("n"))
    return g.groupBy("addr").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "last")).alias("b")).select("addr", "b.first", "b.last", (-F.col("b.m")).alias("n"))


@query(rf"""WITH p AS (SELECT message_id, max(subject) AS s, max(body) AS b FROM parsed_emails WHERE subject IS NOT NULL AND body IS NOT NULL GROUP BY 1), l AS (SELECT message_id, unnest(string_split(b, chr(10))) AS line, s FROM p), w AS (SELECT message_id, list_distinct({text_sql.tokens("line")}) AS lw, list_distinct({text_sql.tokens("s")}) AS sw FROM l)
SELECT message_id, round(min(len(list_intersect(lw, sw)) / len(lw)), 6) AS lowest, count(*) AS lines FROM w WHERE len(lw) > 0 GROUP BY 1""")
def line_overlap(spark, sf_dir):
    """The lowest share, over the lines of a body, of content words that the subject holds as well."""
    p = table(spark, sf_dir, "parsed_emails").where("subject IS NOT NULL AND body IS NOT NULL").groupBy("message_id").agg(F.max("subject").alias("s"), F.max("body").alias("b"))
    l = p.select("message_id", F.array_distinct(X.search_tokens("s")).alias("sw"), F.explode(F.split("b", "\n")).alias("line")).select("message_id", "sw", F.array_distinct(X.search_tokens("line")).alias("lw")).where(F.size("lw") > 0)
    return l.groupBy("message_id").agg(F.round(F.min(F.size(F.array_intersect("lw", "sw")) / F.size("lw")), 6).alias("lowest"), F.count("*").alias("lines"))
