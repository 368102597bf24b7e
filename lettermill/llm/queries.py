"""Queries of the operators for training data and their SQL twins, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, mixing, name_link, personal, quota_sample, quoted, same_look, subjects, tensor_banding
from lettermill.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a body that its sender did not newly write."""
    return quoted.lines_to_remove(table(spark, sf_dir, "mailbox"))


def p1_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mail reduced to its sender's own words."""
    mails = table(spark, sf_dir, "mailbox")
    return quoted.own_bodies(mails, quoted.lines_to_remove(mails))


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = table(spark, sf_dir, "name_audit").select(F.explode("found").alias("f")).select(F.col("f.name").alias("spelling"))
    return table(spark, sf_dir, "mailbox").select(F.col("from").alias("spelling")).union(audit).distinct()


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person or organisation each spelling stands for."""
    return name_link.entities(_spellings(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different spellings of one person or organisation."""
    return name_link.variant_pairs(_spellings(spark, sf_dir)).toDF("name_a", "name_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of every mail."""
    return subjects.areas(*(table(spark, sf_dir, t) for t in ("mailbox", "topic_labels", "topics")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal details of every mail."""
    return personal.found(table(spark, sf_dir, "mailbox"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail with typed placeholders for its personal details."""
    return personal.redacted(table(spark, sf_dir, "mailbox"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of different threads whose three-word shingle sets are at least half the same."""
    return tensor_banding.alike(table(spark, sf_dir, "mailbox"), "email_id", "thread_id").toDF("email_id_a", "email_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class, the copies, the links and the group of near duplicates of every mail that is long enough."""
    return tensor_banding.groups(table(spark, sf_dir, "mailbox"), "email_id", "thread_id").withColumnRenamed("id", "email_id")


def _quota(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool = quota_sample.categorised(table(spark, sf_dir, "mailbox"), table(spark, sf_dir, "topics"), "email_id", "topic", "topic")
    return pool, quota_sample.requests(table(spark, sf_dir, "sample_manifest"))


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails drawn for each planned draw."""
    return quota_sample.draw(*_quota(spark, sf_dir)).withColumnRenamed("id", "email_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, floor, available and drawn mails of each draw and topic."""
    pool, asked = _quota(spark, sf_dir)
    return quota_sample.report(pool, asked, quota_sample.draw(pool, asked))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a draw whose sample stayed under its target."""
    return p6_report(spark, sf_dir).where(~F.col("met")).select("draw_id", "topic")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(table(spark, sf_dir, "documents"), ["doc_id"])


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.sized(docs, mixing.noted_topics(docs, table(spark, sf_dir, "topics")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their wanted tokens with all their documents used as often as allowed."""
    docs, mix = cut(_sized(spark, sf_dir), "sized"), table(spark, sf_dir, "mix_targets")
    # the raked and drawn mix stays under the target of every source that cannot reach it; the exact reach sets these apart from sources the draw misses by a document
    return mixing.report(docs, mix, cut(mixing.drawn(docs, mix), "drawn")).where("got < want AND short").select("mix_id", "source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix and how often each is used."""
    return mixing.drawn(cut(_sized(spark, sf_dir), "sized"), table(spark, sf_dir, "mix_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, reachable and drawn tokens of each source, and the share it really got."""
    docs, mix = cut(_sized(spark, sf_dir), "sized"), table(spark, sf_dir, "mix_targets")
    return mixing.report(docs, mix, cut(mixing.drawn(docs, mix), "drawn"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    return same_look.with_form(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "form")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look the same and differ in a character."""
    return same_look.same_look_pairs(table(spark, sf_dir, "documents"), "doc_id").toDF("doc_id_a", "doc_id_b")


QUERIES = {"p2_entities": p2_entities, "p2_found": p2_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_report": p6_report, "p6_sample": p6_sample, "p1_found": p1_found, "p1_own": p1_own, "p3_found": p3_found, "p4_found": p4_found, "p4_redacted": p4_redacted, "p7_ids": p7_ids, "p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_forms": p9_forms}
_POOL = r"""
WITH vocab AS (
  SELECT topic, trim(regexp_replace(lower(replace(replace(topic, '_', ' '), '&', 'and')), '\s+', ' ', 'g')) AS k
  FROM topics WHERE topic IS NOT NULL
), pool AS (
  SELECT DISTINCT email_id, v.topic
  FROM mailbox m JOIN vocab v ON v.k = trim(regexp_replace(lower(replace(replace(m.topic, '_', ' '), '&', 'and')), '\s+', ' ', 'g'))
  WHERE email_id IS NOT NULL
), sizes AS (SELECT topic, count(*) AS available FROM pool GROUP BY topic),
asked AS (
  SELECT draw_id, min_per_topic, unnest(map_keys(alloc)) AS topic, unnest(map_values(alloc)) AS wanted FROM sample_manifest
), rep AS (
  SELECT draw_id, a.topic, CAST(coalesce(wanted, 0) AS BIGINT) AS wanted, CAST(coalesce(min_per_topic, 0) AS BIGINT) AS floor,
         CAST(greatest(coalesce(wanted, 0), coalesce(min_per_topic, 0)) AS BIGINT) AS target, CAST(coalesce(s.available, 0) AS BIGINT) AS available
  FROM asked a LEFT JOIN sizes s ON s.topic = a.topic
)
"""


_FORMS = same_look.form_sql("(SELECT doc_id AS r, text AS t FROM documents)", "r AS doc_id, ")
SQL: dict[str, str] = {
    "p5_found": r"""
WITH t AS (
  SELECT email_id, min(thread_id) AS thread_id, min(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[a-z0-9]+')) AS w
  FROM mailbox WHERE email_id IS NOT NULL GROUP BY email_id
), s AS (
  SELECT DISTINCT email_id, thread_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM t WHERE len(w) >= 40
), n AS (SELECT email_id, count(*) AS n FROM s GROUP BY email_id),
c AS (
  SELECT a.email_id AS a, b.email_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.email_id < b.email_id AND a.thread_id IS DISTINCT FROM b.thread_id GROUP BY 1, 2
)
SELECT a AS email_id_a, b AS email_id_b FROM c JOIN n x ON x.email_id = a JOIN n y ON y.email_id = b WHERE 2 * k >= x.n + y.n - k
""",
    "p5_groups": r"""
WITH RECURSIVE t AS (
  SELECT email_id, min(thread_id) AS thread_id, min(regexp_extract_all(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[a-z0-9]+')) AS w
  FROM mailbox WHERE email_id IS NOT NULL GROUP BY email_id
), s AS (
  SELECT DISTINCT email_id, coalesce(thread_id, email_id) AS g, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM t WHERE len(w) >= 40
), k AS (SELECT email_id, min(g) AS g, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS cls FROM s GROUP BY email_id),
c AS (SELECT cls, min(email_id) AS class_id, count(*) AS copies, min(n) AS n, CASE WHEN min(g) = max(g) THEN min(g) END AS g FROM k GROUP BY cls),
r AS (SELECT c.*, x FROM c JOIN s ON s.email_id = c.class_id),
l AS (
  SELECT a.class_id AS a, b.class_id AS b FROM r a JOIN r b ON a.x = b.x AND a.class_id <> b.class_id AND (a.g IS NULL OR b.g IS NULL OR a.g <> b.g)
  GROUP BY 1, 2, a.n, b.n HAVING 2 * count(*) >= a.n + b.n - count(*)
), reach AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
root AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a)
SELECT email_id, class_id, copies, coalesce(d.links, 0) AS links, group_id
FROM k JOIN c USING (cls) JOIN root ON root.a = class_id LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) d ON d.a = class_id
""",
    "p6_found": _POOL + "SELECT draw_id, topic FROM rep WHERE available < target",
    "p6_report": _POOL + "SELECT draw_id, topic, wanted, floor, target, available, least(available, target) AS drawn, available >= target AS met FROM rep",
    "p9_forms": f"SELECT doc_id, form FROM ({_FORMS})",
    "p9_found": rf"""WITH f AS (SELECT doc_id, form, text FROM ({_FORMS}) JOIN documents USING (doc_id) WHERE regexp_matches(form, '\S'))
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
