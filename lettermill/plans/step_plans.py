"""Queries of the steps that need arbitrary code, and of the model seam; several have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions import text as X
from lettermill.operators import engines, fill, layout, pseudonyms
from lettermill.plans.text_plans import mails
from lettermill.plans.text_sql import MAILS
from lettermill.session import table
from lettermill.sources import archive

QUERIES: dict = {}
SQL: dict[str, str] = {}
M = MAILS.rstrip()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def parse_mail(spark, sf_dir):
    """Archived messages written as message text and parsed again."""
    p = table(spark, sf_dir, "parsed_emails").where("message_id IS NOT NULL")
    head = F.concat(F.lit("Message-ID: <"), "message_id", F.lit(">\nFrom: "), F.coalesce("from_addr", F.lit("")), F.lit("\nTo: "), F.array_join("to_addrs", ", "), F.lit("\nSubject: "), F.coalesce("subject", F.lit("")))
    date = F.when(F.col("date").isNotNull(), F.concat(F.lit("\nDate: "), F.date_format("date", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise("")
    raw = F.concat(head, date, F.lit('\nContent-Type: text/plain; charset="utf-8"\n\n'), F.coalesce("body", F.lit("")))
    parsed = archive.first_path(archive.parse_files(p.select(F.col("file_path").alias("path"), F.encode(raw, "UTF-8").alias("content"))))
    return parsed.select("message_id", "from_addr", F.size("to_addrs").alias("n_to"), "normalized_subject", "date", "word_count")


def _units(spark, sf_dir):
    m = mails(spark, sf_dir).where("topic IS NOT NULL").select("thread_id", "email_id", F.col("from").alias("sender"), X.label_key("topic").alias("topic"))
    return m.groupBy("topic", "thread_id").agg(F.min_by("sender", "email_id").alias("sender"), F.count("*").cast("int").alias("n"))


@query()
def whole_thread_fill(spark, sf_dir):
    """Thirty mails a topic in whole threads."""
    u = _units(spark, sf_dir)
    return fill.whole_threads(u, u.select("topic").distinct().withColumn("quota", F.lit(30)))


@query(f"{M}, s AS (SELECT \"from\" AS sender, count(*) AS used, min(email_id) AS email_id FROM mails GROUP BY 1) SELECT sender, used, k FROM (SELECT *, row_number() OVER (ORDER BY used, md5('4:' || sender), sender) AS k FROM s) WHERE k <= 12")
def least_used_draw(spark, sf_dir):
    s = mails(spark, sf_dir).groupBy(F.col("from").alias("sender")).agg(F.count("*").alias("used"))
    top = s.withColumn("h", F.md5(F.concat(F.lit("4:"), "sender"))).orderBy("used", "h", "sender").limit(12)
    return top.select("sender", "used", F.row_number().over(Window.orderBy("used", "h", "sender")).cast("long").alias("k"))  # twelve rows


@query(f"{M}, n AS (SELECT email_id, \"from\" AS s, topic FROM mails WHERE topic IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY topic, s ORDER BY email_id) AS a FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('6:' || email_id), email_id) AS k FROM r WHERE a = 1) SELECT topic, email_id FROM k WHERE k <= 2")
def two_per_topic(spark, sf_dir):
    m = mails(spark, sf_dir).where("topic IS NOT NULL").select("email_id", F.col("from").alias("s"), "topic")
    one = m.groupBy("topic", "s").agg(F.min("email_id").alias("email_id"))
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.md5(F.concat(F.lit("6:"), "email_id")), "email_id"))
    return one.withColumn("k", k).where("k <= 2").select("topic", "email_id")


@query()
def rewrite_spans(spark, sf_dir):
    """Bodies with every registered person and contact detail replaced, scanned for leaks."""
    return pseudonyms.pseudonymised(table(spark, sf_dir, "mailbox"))


@query()
def stand_ins(spark, sf_dir):
    """The stand-in of each registered person."""
    people = pseudonyms.registry(table(spark, sf_dir, "mailbox")).select("first", "last").distinct()
    words = people.select(F.explode(F.array("first", "last")).alias("w"))
    return pseudonyms.assign(people, pseudonyms.stand_in_pool(people.count(), words))


@query()
def reformat_bodies(spark, sf_dir):
    """Own texts laid out by the writer's habit: wrapped and spaced as most of their mails are."""
    m = mails(spark, sf_dir).select("email_id", F.col("from").alias("s"), X.own_body(F.col("body")).alias("t"))
    longest = F.array_max(F.transform(F.split("t", "\n"), F.length))
    h = m.groupBy("s").agg((F.avg((longest <= 78).cast("int")) > 0.5).alias("wraps"), (F.avg(F.col("t").rlike(r"[a-z0-9)]\.  [A-Z]").cast("int")) > 0.5).alias("double"))
    return m.join(h, "s").select("email_id", layout.reformatted("t", "wraps", "double").alias("text"))


@query()
def first_balanced_json(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source = 'judge_notes'")
    return d.select("doc_id", engines.first_json("text").alias("obj")).where("obj IS NOT NULL")


_PROMPT = "Topic of this mail?\nSubject: <<SUBJECT>>\n<<OWN>>"


@query(f"{M} SELECT email_id, sha256('Topic of this mail?' || chr(10) || 'Subject: ' || coalesce(subject, '') || chr(10) || body) AS prompt_sha FROM mails")
def label_prompts(spark, sf_dir):
    return engines.prompted(mails(spark, sf_dir), _PROMPT, subject=F.col("subject"), own=F.col("body")).select("email_id", "prompt_sha")


@query()
def stub_labels(spark, sf_dir):
    """Prompts answered by the deterministic stub over the label vocabulary."""
    names = [r[0] for r in table(spark, sf_dir, "topics").select("topic").orderBy("topic").collect()]  # a fixed list
    return engines.stub(engines.prompted(mails(spark, sf_dir), _PROMPT, subject=F.col("subject"), own=F.col("body")), names).select("email_id", "answer")


@query("""SELECT email_id, topic, CASE WHEN topic = '?' THEN lower(coalesce(raw, '')) ELSE topic END AS answer FROM (SELECT DISTINCT email_id, topic, raw FROM topic_labels)""")
def answer_fallback(spark, sf_dir):
    l = table(spark, sf_dir, "topic_labels").select("email_id", "topic", "raw").distinct()
    return l.select("email_id", "topic", F.when(F.col("topic") == "?", F.lower(F.coalesce("raw", F.lit("")))).otherwise(F.col("topic")).alias("answer"))


@query("""WITH n AS (SELECT email_id, count(DISTINCT f.name) AS names, string_agg(DISTINCT f.name, ' | ' ORDER BY f.name) AS forms FROM (SELECT email_id, unnest(found) AS f FROM name_audit) GROUP BY 1) SELECT email_id, names, forms FROM n""")
def mention_forms(spark, sf_dir):
    f = table(spark, sf_dir, "name_audit").select("email_id", F.explode("found").alias("f"))
    return f.groupBy("email_id").agg(F.count_distinct("f.name").alias("names"), F.array_join(F.array_sort(F.collect_set("f.name")), " | ").alias("forms"))


@query(r"""WITH a AS (SELECT DISTINCT regexp_extract(lower("from"), '([\w.+-]+)@[\w.-]+\w', 1) AS local FROM mailbox) SELECT local, CASE WHEN contains(local, '.') THEN 'belmor.corwen' WHEN contains(local, '_') THEN 'belmor_corwen' ELSE 'bcorwen' END AS shaped FROM a WHERE local <> ''""")
def address_reshape(spark, sf_dir):
    """A stand-in's local part in the shape of each real one."""
    a = table(spark, sf_dir, "mailbox").select(F.regexp_extract(F.lower("from"), r"([\w.+-]+)@[\w.-]+\w", 1).alias("local")).distinct().where("local <> ''")
    return a.select("local", pseudonyms.reshape_address(F.col("local"), F.lit("Belmor"), F.lit("Corwen")).alias("shaped"))


@query()
def quota_jitter(spark, sf_dir):
    """Quotas moved by up to five either way with the total kept; one row a topic."""
    from lettermill.plans.core_plans import quota_alloc
    from lettermill.session import bounded

    rows = bounded(quota_alloc(spark, sf_dir), 2_000).collect()
    got = fill.jittered({r["topic"]: r["quota"] for r in rows}, 5, 20, {r["topic"]: r["pool"] for r in rows})
    return spark.createDataFrame(sorted(got.items()), "topic string, quota long")


@query("""SELECT email_id FROM (SELECT DISTINCT email_id FROM mailbox WHERE email_id NOT IN (SELECT email_id FROM topic_labels WHERE email_id IS NOT NULL)) ORDER BY email_id LIMIT 100""")
def exclude_and_limit(spark, sf_dir):
    """The first hundred ids that are not on an exclusion list."""
    m = table(spark, sf_dir, "mailbox").select("email_id").distinct()
    return m.join(table(spark, sf_dir, "topic_labels"), "email_id", "left_anti").orderBy("email_id").limit(100)


@query("""SELECT chain, clue, len(ids) AS n, ids[1] AS first FROM (SELECT chain, unnest(map_keys(planted)) AS clue, unnest(map_values(planted)) AS ids FROM answer_key) WHERE len(ids) > 0""")
def clue_messages(spark, sf_dir):
    """Messages of each clue and the first of them."""
    k = table(spark, sf_dir, "answer_key").select("chain", F.explode("planted").alias("clue", "ids")).where(F.size("ids") > 0)
    return k.select("chain", "clue", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("first"))
