"""Queries of recorded runs: tools of a session, gates, scores, outcome tables, verdicts of a judge, token use; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions import text as X
from lettermill.operators import engines, search, session, verify
from lettermill.plans.core_plans import _LOG, _bm25_sql, _log
from lettermill.plans.text_plans import mails
from lettermill.plans.text_sql import MAILS, tokens
from lettermill.session import bounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
M = MAILS.rstrip()
PAGES, BUDGET = 3, 8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- the judge's verdicts

_JUDGE = r"""o AS (SELECT doc_id, regexp_extract(text, '(?s)(\{.*\})', 1) AS x FROM documents WHERE source = 'judge_notes' AND text IS NOT NULL),
j AS (SELECT doc_id, CASE WHEN json_type(x, '$.match') = 'BOOLEAN' THEN CAST(json_extract(x, '$.match') AS BOOLEAN) ELSE false END AS matched FROM o WHERE x <> '' AND json_valid(x))"""


def judged(spark, sf_dir) -> DataFrame:
    """(doc_id, matched) of the judge notes that parse as an object; only a literal true counts."""
    d = table(spark, sf_dir, "documents").where("source = 'judge_notes' AND text IS NOT NULL").select("doc_id", engines.outer_json(F.col("text")).alias("x"))
    d = d.select("doc_id", F.expr("try_parse_json(x)").alias("v")).where("v IS NOT NULL").withColumn("m", F.expr("try_variant_get(v, '$.match', 'variant')"))
    return d.select("doc_id", F.coalesce(F.expr("schema_of_variant(m) = 'BOOLEAN' AND try_variant_get(m, '$', 'boolean')"), F.lit(False)).alias("matched"))


@query(f"WITH {_JUDGE} SELECT doc_id, matched FROM j")
def judge_verdicts(spark, sf_dir):
    return judged(spark, sf_dir)


_CELLS = f"""{_JUDGE}, jn AS (SELECT matched, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS k FROM j),
s AS (SELECT chain, n, m AS mask FROM (SELECT DISTINCT chain, n FROM answer_key), range(1, 8) AS r(m) WHERE m < (1 << n)),
c AS (SELECT *, row_number() OVER (ORDER BY chain, mask, prober) - 1 AS i FROM s, (VALUES ('a'), ('b')) x(prober)),
v AS (SELECT chain, n, mask, prober, matched FROM c JOIN jn ON jn.i = c.i % jn.k)"""


def verdict_table(spark, sf_dir) -> DataFrame:
    """Verdicts of all subsets by two probers: the judge's notes, in order, dealt to the cells in turn, as no table links them. Chains and notes of a run are a short list."""
    one = Window.orderBy("doc_id")
    notes = bounded(judged(spark, sf_dir), 1_000_000)
    notes = notes.withColumn("i", F.row_number().over(one) - 1).crossJoin(notes.agg(F.count("*").alias("k")))
    cells = bounded(verify.subsets(table(spark, sf_dir, "answer_key").select("chain", "n").distinct()).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("prober")), 1_000_000)
    cells = cells.withColumn("c", F.row_number().over(Window.orderBy("chain", "mask", "prober")) - 1)
    return cells.crossJoin(notes.agg(F.max("k").alias("k"))).withColumn("i", F.col("c") % F.col("k")).drop("k").join(notes.select("i", "matched"), "i").select("chain", "n", "mask", "prober", "matched")


@query(f"WITH {_CELLS} SELECT chain, bool_or(matched AND bit_count(mask) < n) AS leak, bool_and(matched) FILTER (bit_count(mask) = n) AS recovered, NOT bool_or(matched AND bit_count(mask) < n) AND bool_and(matched) FILTER (bit_count(mask) = n) AS keep FROM v GROUP BY 1")
def and_check_decide(spark, sf_dir):
    """Kept where no proper subset gives the secret away to any prober and the full set gives it to all."""
    return verify.decide(verdict_table(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT chain, bool_or(matched AND bit_count(mask) < n) AS leak, bool_or(matched) FILTER (bit_count(mask) = n) AS recovered, NOT bool_or(matched AND bit_count(mask) < n) AND bool_or(matched) FILTER (bit_count(mask) = n) AS keep FROM v GROUP BY 1")
def and_check_any(spark, sf_dir):
    return verify.decide(verdict_table(spark, sf_dir), "any")


@query(f"WITH {_CELLS} SELECT DISTINCT chain, mask, prober FROM v WHERE matched AND bit_count(mask) < n")
def leaking_subsets(spark, sf_dir):
    return verify.leaks(verdict_table(spark, sf_dir))


@query(f"""WITH {_CELLS}, g AS (SELECT chain, n, mask, bool_and(matched) AS every, bool_or(matched) AS some FROM v GROUP BY ALL),
f AS (SELECT chain, min(CAST(clue AS INT)) AS fact FROM (SELECT chain, unnest(map_keys(planted)) AS clue FROM answer_key) GROUP BY 1),
d AS (SELECT a.chain, a.mask, fact FROM g a JOIN f USING (chain) WHERE bit_count(a.mask) >= 2 AND bit_count(a.mask) < a.n AND a.mask & (1 << (a.n - 1)) <> 0 AND a.every AND NOT EXISTS (SELECT 1 FROM g b WHERE b.chain = a.chain AND b.mask <> a.mask AND b.mask & a.mask = b.mask AND b.some))
SELECT chain, arg_min(mask, (bit_count(mask), CASE WHEN mask & (1 << fact) = 0 THEN 1 ELSE 0 END, list_filter([0, 1, 2], lambda i: mask & (1 << i) <> 0))) AS mask FROM d GROUP BY 1""")
def pair_reduce(spark, sf_dir):
    """The smallest delivered set of threads of each chain; the first clue is its fact."""
    facts = table(spark, sf_dir, "answer_key").select("chain", F.array_min(F.transform(F.map_keys("planted"), lambda k: k.cast("int"))).alias("thread"))
    return verify.delivered(verdict_table(spark, sf_dir), facts)


@query(f"""WITH {_CELLS}, d AS (SELECT chain, any_value(n) AS n, NOT bool_or(matched AND bit_count(mask) < n) AND bool_and(matched) FILTER (bit_count(mask) = n) AS keep, count(*) FILTER (matched AND bit_count(mask) < n) AS redo FROM v GROUP BY 1)
SELECT n, pattern, count(*) AS chains, count(*) FILTER (keep) AS kept, CAST(sum(redo) AS BIGINT) AS redo_steps, count(*) FILTER (redo = 0) AS without_redo, count(*) FILTER (redo > 2) AS many_redos FROM d JOIN (SELECT DISTINCT chain, pattern FROM answer_key) USING (chain) GROUP BY 1, 2""")
def check_report(spark, sf_dir):
    """Chains kept by number of threads and pattern, with the steps their leaks make necessary."""
    v = verdict_table(spark, sf_dir)
    leak = F.col("matched") & (F.bit_count("mask") < F.col("n"))
    redo = v.groupBy("chain").agg(F.max("n").alias("n"), F.count(F.when(leak, 1)).alias("redo"))
    p = table(spark, sf_dir, "answer_key").select("chain", "pattern").distinct()
    d = verify.decide(v).join(redo, "chain").join(p, "chain")
    n = lambda c: F.count(F.when(c, 1))
    return d.groupBy("n", "pattern").agg(F.count("*").alias("chains"), n(F.col("keep")).alias("kept"), F.sum("redo").alias("redo_steps"), n(F.col("redo") == 0).alias("without_redo"), n(F.col("redo") > 2).alias("many_redos"))


# ---- tools of a session

_SEARCHES = "SELECT DISTINCT arg AS qid, arg AS query FROM tool_log WHERE tool = 'search' AND arg IS NOT NULL"


def _asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "tool_log").where("tool = 'search' AND arg IS NOT NULL").select(F.col("arg").alias("qid"), F.col("arg").alias("query")).distinct()


@query(f"""WITH {MAILS.strip()[5:]}, pool AS (WITH {_bm25_sql("SELECT email_id AS doc, coalesce(subject, '') || ' ' || body AS text FROM mails", _SEARCHES, 40)}),
r AS (SELECT qid, doc, rank, len(list_intersect(list_distinct({tokens("coalesce(qid, '')")}), list_distinct({tokens("coalesce(subject, '')")}))) AS hits FROM pool JOIN mails ON email_id = doc)
SELECT qid, doc, rank, hits, shown FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, rank) AS shown FROM r) WHERE shown <= 8""")
def search_shown(spark, sf_dir):
    """A search's pool of forty mails, reranked by the asked terms in the subject, eight shown; without hits in any subject the first eight stand."""
    m = mails(spark, sf_dir)
    d = m.select("email_id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), "body").alias("text"))
    pool = search.bm25(d, "email_id", "text", _asked(spark, sf_dir), 40)
    both = pool.join(m.select(F.col("email_id").alias("doc"), "subject"), "doc")
    hits = F.size(F.array_intersect(F.array_distinct(X.search_tokens("qid")), F.array_distinct(X.search_tokens("subject")))).cast("long")
    r = both.select("qid", "doc", "rank", hits.alias("hits"))
    return r.withColumn("shown", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hits"), "rank")).cast("long")).where("shown <= 8")


@query(f"""WITH {MAILS.strip()[5:]}, x AS (SELECT DISTINCT k.chain AS qid, l.id AS doc FROM answer_key k, (SELECT DISTINCT arg AS id FROM tool_log WHERE tool = 'read' AND arg IS NOT NULL) l UNION SELECT chain, unnest(flatten(map_values(planted))) FROM answer_key),
pool AS (WITH {_bm25_sql("SELECT email_id AS doc, coalesce(subject, '') || ' ' || body AS text FROM mails", "SELECT chain AS qid, secret AS query FROM answer_key", 1000000000)})
SELECT qid, doc, score, rank FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM pool WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.qid = pool.qid AND x.doc = pool.doc)) WHERE rank <= 8""")
def bm25_related(spark, sf_dir):
    """The eight mails nearest to each secret, its own and those opened in a session left out."""
    m = mails(spark, sf_dir).select("email_id", F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), "body").alias("text"))
    k = table(spark, sf_dir, "answer_key")
    own = k.select(F.col("chain").alias("qid"), F.explode(F.flatten(F.map_values("planted"))).alias("doc"))
    opened = table(spark, sf_dir, "tool_log").where("tool = 'read' AND arg IS NOT NULL").select(F.col("arg").alias("doc")).distinct()
    return search.bm25(m, "email_id", "text", k.select(F.col("chain").alias("qid"), F.col("secret").alias("query")), 8, without=own, hidden=opened)


@query(f"""WITH {MAILS.strip()[5:]}, {_LOG}, mm AS (SELECT email_id, coalesce(thread_id, email_id) AS t, body FROM mails), k AS (SELECT t, count(*) AS k FROM mm GROUP BY 1)
SELECT session_id, seq, o.email_id, length(o.body) AS n_chars, CASE WHEN k = 1 THEN o.body[1:1500] ELSE o.body[1:700] END AS head FROM l JOIN mm r ON r.email_id = l.arg JOIN k USING (t) JOIN mm o ON o.t = r.t WHERE tool = 'read'""")
def read_shown(spark, sf_dir):
    """What each reading call of a session showed."""
    return session.shown_threads(_log(spark, sf_dir), mails(spark, sf_dir))


_PAGED = f"""{_LOG}, pg AS (SELECT session_id, seq, coalesce(try_cast(arg AS INTEGER), CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER)) AS page FROM l WHERE tool = 'list'),
p1 AS (SELECT *, page BETWEEN 1 AND {PAGES} AS valid, page BETWEEN 1 AND {PAGES} AND row_number() OVER (PARTITION BY session_id, page ORDER BY seq) = 1 AS first FROM pg),
p2 AS (SELECT *, sum(first::INT) OVER (PARTITION BY session_id ORDER BY seq) AS seen FROM p1),
ps AS (SELECT session_id, seq, page, CASE WHEN NOT valid THEN 'invalid' WHEN NOT first THEN 'already' WHEN seen = {PAGES} THEN 'complete' ELSE 'ok' END AS status FROM p2)"""


@query(f"WITH {_PAGED} SELECT * FROM ps")
def segment_pages(spark, sf_dir):
    """Pages of the mailbox a session listed, with the status of each call."""
    return session.pages(_log(spark, sf_dir), PAGES)


@query(f"""WITH {_PAGED}, a AS (SELECT l.*, coalesce(sum((tool = 'search')::INT) OVER w, 0) AS s, coalesce(sum((tool = 'read')::INT) OVER w, 0) AS r, coalesce(sum((tool = 'list')::INT) OVER w, 0) AS li, coalesce(sum((ps.status IN ('ok', 'complete'))::INT) OVER w, 0) AS seen,
coalesce(max(CASE WHEN tool = 'search' THEN l.seq END) OVER w, -1) AS ls, coalesce(max(CASE WHEN tool = 'read' THEN l.seq END) OVER w, -1) AS lr FROM l LEFT JOIN ps ON ps.session_id = l.session_id AND ps.seq = l.seq WINDOW w AS (PARTITION BY l.session_id ORDER BY l.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT session_id, seq, CASE WHEN returned IS NULL THEN 'no list' WHEN len(returned) > 5 THEN 'too many' WHEN len(returned) > 0 AND trim(arg) = '' THEN 'no secret' WHEN len(list_filter(returned, lambda x: x IS NULL OR NOT regexp_matches(x, '^[ep]_'))) > 0 THEN 'bad evidence'
WHEN s + r + li < {BUDGET} AND s + r < 4 THEN 'too little work' WHEN s + r + li < {BUDGET} AND ls > lr THEN 'unread search' WHEN s + r + li < {BUDGET} AND len(returned) = 0 AND seen < {PAGES} THEN 'scan incomplete' ELSE 'accepted' END AS verdict FROM a WHERE tool = 'answer'""")
def answer_gates(spark, sf_dir):
    """Every answer with the first gate that closes on it."""
    return session.gates(_log(spark, sf_dir), PAGES, BUDGET)


@query(f"""WITH {_LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM l), g AS (SELECT session_id, max(turn) AS turns, min(turn) FILTER (tool = 'answer') AS ans FROM t GROUP BY 1)
SELECT session_id, turns, {BUDGET + PAGES + 8} AS turn_limit, CASE WHEN ans <= {BUDGET + PAGES + 8} THEN 'answered' WHEN turns > {BUDGET + PAGES + 8} THEN 'forced empty' ELSE 'open' END AS state FROM g""")
def session_final(spark, sf_dir):
    """How each session ended under its limit of turns."""
    return session.final_state(_log(spark, sf_dir), BUDGET, PAGES)


# ---- scores and outcome tables

# one row a session: its last answer, the chains whose planted mails it cites, controls without any planted mail seen, its size in calls
_ROWS = f"""{_LOG}, p AS (SELECT DISTINCT chain, pattern, n, id FROM (SELECT chain, pattern, n, unnest(flatten(map_values(planted))) AS id FROM answer_key)),
la AS (SELECT session_id, max(seq) AS seq FROM l WHERE tool = 'answer' GROUP BY 1), an AS (SELECT l.session_id, l.returned AS ids FROM l JOIN la ON la.session_id = l.session_id AND la.seq = l.seq),
u AS (SELECT session_id, unnest(returned) AS id FROM l WHERE tool <> 'answer'), seen AS (SELECT session_id, count(DISTINCT id) AS mails, count(DISTINCT CASE WHEN id IN (SELECT id FROM p) THEN id END) AS planted_seen FROM u GROUP BY 1),
cited AS (SELECT session_id, count(*) AS n_cited, count(*) FILTER (pos IN (SELECT 1) OR true) AS x, count(*) FILTER (id IN (SELECT id FROM p)) AS n_planted, min(pos) FILTER (id IN (SELECT id FROM p)) AS rank FROM (SELECT session_id, id, min(pos) AS pos FROM (SELECT session_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM an) GROUP BY 1, 2) GROUP BY 1),
calls AS (SELECT session_id, count(*) AS calls, CAST(coalesce(sum(length(arg)), 0) + 12 * coalesce(sum(len(returned)), 0) AS BIGINT) AS chars FROM l GROUP BY 1),
rs AS (SELECT c.session_id, calls, chars, coalesce(mails, 0) AS mails, coalesce(planted_seen, 0) = 0 AS control, coalesce(n_cited, 0) > 0 AS found, coalesce(n_cited, 0) > 0 AND coalesce(n_planted, 0) > 0 AND coalesce(planted_seen, 0) > 0 AS correct, coalesce(n_planted, 0) > 0 AS evidence_hit, n_cited IS NOT NULL AND n_cited = n_planted AS planted_only, an.session_id IS NULL AS unparsed, rank
FROM calls c LEFT JOIN seen s ON s.session_id = c.session_id LEFT JOIN cited d ON d.session_id = c.session_id LEFT JOIN an ON an.session_id = c.session_id)"""
_ROWS = _ROWS.replace("count(*) FILTER (pos IN (SELECT 1) OR true) AS x, ", "")


def session_rows(spark, sf_dir) -> DataFrame:
    """One row a session, as a scorer writes it: calls, characters, mails seen, control (no planted mail seen), found, correct, evidence, rank."""
    l = _log(spark, sf_dir)
    p = table(spark, sf_dir, "answer_key").select(F.explode(F.flatten(F.map_values("planted"))).alias("id")).distinct().withColumn("hit", F.lit(True))
    ans = l.where("tool = 'answer'").groupBy("session_id").agg(F.max_by("returned", "seq").alias("ids"))
    seen = l.where("tool <> 'answer'").select("session_id", F.explode("returned").alias("id")).distinct().join(p, "id", "left").groupBy("session_id").agg(F.count("id").alias("mails"), F.count("hit").alias("planted_seen"))
    cited = ans.select("session_id", F.posexplode("ids").alias("pos", "id")).groupBy("session_id", "id").agg((F.min("pos") + 1).alias("pos")).join(p, "id", "left")
    cited = cited.groupBy("session_id").agg(F.count("*").alias("n_cited"), F.count("hit").alias("n_planted"), F.min(F.when(F.col("hit"), F.col("pos"))).cast("long").alias("rank"))
    calls = l.groupBy("session_id").agg(F.count("*").alias("calls"), (F.coalesce(F.sum(F.length("arg")), F.lit(0)) + 12 * F.coalesce(F.sum(F.size("returned")), F.lit(0))).alias("chars"))
    r = calls.join(seen, "session_id", "left").join(cited, "session_id", "left").join(ans.select("session_id", F.lit(True).alias("answered")), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    control, found = zero("planted_seen") == 0, zero("n_cited") > 0
    hit = zero("n_planted") > 0
    return r.select("session_id", "calls", "chars", zero("mails").alias("mails"), control.alias("control"), found.alias("found"), (found & hit & ~control).alias("correct"), hit.alias("evidence_hit"), F.coalesce(F.col("n_cited") == F.col("n_planted"), F.lit(False)).alias("planted_only"), F.col("answered").isNull().alias("unparsed"), "rank")


@query(f"WITH {_ROWS} SELECT session_id, found, correct, CASE WHEN correct THEN rank END AS candidate_rank, found AND NOT correct AS false_positive FROM rs")
def session_scored(spark, sf_dir):
    """Found, correct with the rank of the first matching candidate, false positive, of every session's last answer."""
    return session_rows(spark, sf_dir).select("session_id", "found", "correct", F.when(F.col("correct"), F.col("rank")).alias("candidate_rank"), (F.col("found") & ~F.col("correct")).alias("false_positive"))


@query(f"""WITH {_ROWS}, {_JUDGE}, jn AS (SELECT matched, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS k FROM j), ro AS (SELECT *, row_number() OVER (ORDER BY session_id) - 1 AS o FROM rs)
SELECT session_id, found, found AND jn.matched AND NOT control AS correct, found AND NOT (jn.matched AND NOT control) AS false_positive FROM ro JOIN jn ON jn.i = ro.o % jn.k""")
def rejudged(spark, sf_dir):
    """The stored answers with new verdicts, in the same row format; the judge's notes are dealt to the sessions in order, as no table links them."""
    r = bounded(session_rows(spark, sf_dir), 1_000_000).withColumn("o", F.row_number().over(Window.orderBy("session_id")) - 1)
    notes = bounded(judged(spark, sf_dir), 1_000_000)
    k = notes.agg(F.count("*").alias("k"))
    notes = notes.withColumn("i", F.row_number().over(Window.orderBy("doc_id")) - 1)
    right = F.col("matched") & ~F.col("control")
    return r.crossJoin(k).withColumn("i", F.col("o") % F.col("k")).join(notes, "i").select("session_id", "found", (F.col("found") & right).alias("correct"), (F.col("found") & ~right).alias("false_positive"))


_OUTCOME = """count(*) AS sessions, count(*) FILTER (NOT control) AS chains, count(*) FILTER (found AND NOT control) AS said_yes, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / nullif(count(*) FILTER (NOT control), 0), 6) AS recall,
round(count(*) FILTER (correct) / nullif(count(*) FILTER (found), 0), 6) AS precision, count(*) FILTER (evidence_hit) AS evidence_hit, count(*) FILTER (planted_only) AS planted_only, count(*) FILTER (control) AS controls, round(count(*) FILTER (control AND found) / nullif(count(*) FILTER (control), 0), 6) AS false_alarm, count(*) FILTER (unparsed) AS unparsed, round(avg(chars / 4), 4) AS mean_tokens, round(avg(calls), 4) AS mean_calls"""


def _outcome():
    n = lambda c: F.count(F.when(c, 1))
    ok, control, found = F.col("correct"), F.col("control"), F.col("found")
    share = lambda a, b: F.round(n(a) / F.nullif(n(b), F.lit(0)), 6)
    return [
        F.count("*").alias("sessions"), n(~control).alias("chains"), n(found & ~control).alias("said_yes"), n(ok).alias("correct"), share(ok, ~control).alias("recall"), share(ok, found).alias("precision"), n(F.col("evidence_hit")).alias("evidence_hit"),
        n(F.col("planted_only")).alias("planted_only"), n(control).alias("controls"), share(control & found, control).alias("false_alarm"), n(F.col("unparsed")).alias("unparsed"), F.round(F.avg(F.col("chars") / 4), 4).alias("mean_tokens"), F.round(F.avg("calls"), 4).alias("mean_calls"),
    ]


def _level() -> F.Column:
    return F.when(F.col("mails") == 0, 0).when(F.col("mails") <= 20, 20).when(F.col("mails") <= 60, 60).otherwise(100)


_LEVEL = "CASE WHEN mails = 0 THEN 0 WHEN mails <= 20 THEN 20 WHEN mails <= 60 THEN 60 ELSE 100 END"


@query(f"WITH {_ROWS} SELECT {_LEVEL} AS level, {_OUTCOME} FROM rs GROUP BY 1")
def outcome_by_level(spark, sf_dir):
    """Outcomes by the number of mails a session was shown."""
    return session_rows(spark, sf_dir).groupBy(_level().alias("level")).agg(*_outcome())


@query(f"WITH {_ROWS} SELECT coalesce(CAST(level AS VARCHAR), 'all') AS level, {_OUTCOME} FROM (SELECT *, {_LEVEL} AS level FROM rs) GROUP BY ROLLUP (level)")
def outcome_rollup(spark, sf_dir):
    """The same with the overall row."""
    r = session_rows(spark, sf_dir).withColumn("level", _level()).rollup("level").agg(*_outcome())
    return r.withColumn("level", F.coalesce(F.col("level").cast("string"), F.lit("all")))


@query(f"""WITH {_ROWS}, cc AS (SELECT DISTINCT an.session_id, p.chain, p.pattern, p.n FROM (SELECT session_id, unnest(ids) AS id FROM an) an JOIN p USING (id)), per AS (SELECT k.pattern, k.n, count(DISTINCT k.chain) AS chains, count(DISTINCT cc.chain) AS hit, count(DISTINCT cc.session_id) AS sessions FROM (SELECT DISTINCT chain, pattern, n FROM answer_key) k LEFT JOIN cc USING (chain) GROUP BY 1, 2)
SELECT pattern, CAST(sum(chains) AS BIGINT) AS chains, CAST(sum(hit) AS BIGINT) AS hit, round(sum(hit) / sum(chains), 6) AS recall, string_agg(n || ': ' || hit || '/' || chains, ', ' ORDER BY n) AS by_threads FROM per GROUP BY 1""")
def outcome_by_pattern(spark, sf_dir):
    """Chains that some session's last answer cites, by pattern and number of threads."""
    k = table(spark, sf_dir, "answer_key")
    p = k.select("chain", F.explode(F.flatten(F.map_values("planted"))).alias("id")).distinct()
    ans = _log(spark, sf_dir).where("tool = 'answer'").groupBy("session_id").agg(F.max_by("returned", "seq").alias("ids")).select(F.explode("ids").alias("id")).distinct()
    hit = p.join(ans, "id").select("chain").distinct().withColumn("hit", F.lit(1))
    per = k.select("chain", "pattern", "n").distinct().join(hit, "chain", "left").groupBy("pattern", "n").agg(F.count("*").alias("chains"), F.count("hit").alias("hit"))
    part = F.struct("n", F.concat(F.col("n").cast("string"), F.lit(": "), F.col("hit").cast("string"), F.lit("/"), F.col("chains").cast("string")).alias("t"))
    return per.groupBy("pattern").agg(F.sum("chains").alias("chains"), F.sum("hit").alias("hit"), F.round(F.sum("hit") / F.sum("chains"), 6).alias("recall"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), ", ").alias("by_threads"))


RATES = [("search", 0.15), ("read", 0.6), ("list", 0.3), ("answer", 2.5)]
_RATES = ", ".join(f"('{t}', CAST({r} AS DOUBLE))" for t, r in RATES)


@query(f"WITH {_LOG} SELECT tool, count(*) AS calls, CAST(sum(coalesce(length(arg), 0) + 12 * coalesce(len(returned), 0)) AS BIGINT) AS chars, round(sum(coalesce(length(arg), 0) + 12 * coalesce(len(returned), 0)) / 4 * any_value(rate) / 1000, 6) AS cost FROM l JOIN (VALUES {_RATES}) r(t, rate) ON t = tool GROUP BY 1")
def token_cost(spark, sf_dir):
    """Estimated tokens of each tool's calls at a rate a thousand; the rates are a small table."""
    rates = spark.createDataFrame(RATES, "tool string, rate double")
    chars = F.sum(F.coalesce(F.length("arg"), F.lit(0)) + 12 * F.greatest(F.coalesce(F.size("returned"), F.lit(0)), F.lit(0)))
    g = _log(spark, sf_dir).groupBy("tool").agg(F.count("*").alias("calls"), chars.alias("chars"))
    return g.join(F.broadcast(rates), "tool").select("tool", "calls", "chars", F.round(F.col("chars") / 4 * F.col("rate") / 1000, 6).alias("cost"))


@query(f"""WITH {_LOG}, t AS (SELECT session_id, tool, CAST(sum(coalesce(length(arg), 0) + 12 * coalesce(len(returned), 0)) AS BIGINT) AS chars FROM l WHERE tool IS NOT NULL GROUP BY 1, 2)
SELECT session_id, coalesce(max(chars) FILTER (tool = 'read'), max(chars)) AS main, CAST(sum(chars) AS BIGINT) - coalesce(max(chars) FILTER (tool = 'read'), max(chars)) AS rest, CASE WHEN bool_or(tool = 'read') THEN 'read' ELSE arg_min(tool, (-chars, tool)) END AS main_tool FROM t GROUP BY 1""")
def token_usage(spark, sf_dir):
    """The size of the main user of each session, by name where it took part, else the largest, and that of the others together."""
    chars = F.sum(F.coalesce(F.length("arg"), F.lit(0)) + 12 * F.greatest(F.coalesce(F.size("returned"), F.lit(0)), F.lit(0)))
    t = _log(spark, sf_dir).where("tool IS NOT NULL").groupBy("session_id", "tool").agg(chars.alias("chars"))
    named = F.max(F.when(F.col("tool") == "read", F.col("chars")))
    main = F.coalesce(named, F.max("chars"))
    g = t.groupBy("session_id").agg(main.alias("main"), (F.sum("chars") - main).alias("rest"), F.bool_or(F.col("tool") == "read").alias("n"), F.min(F.struct((-F.col("chars")).alias("c"), "tool")).alias("b"))
    return g.select("session_id", "main", "rest", F.when(F.col("n"), F.lit("read")).otherwise(F.col("b.tool")).alias("main_tool"))


@query(f"""WITH {_ROWS}, f AS (SELECT l.session_id, id, clue FROM (SELECT session_id, unnest(returned) AS id FROM l WHERE tool <> 'answer') l JOIN (SELECT chain || ':' || c AS clue, unnest(ids) AS id FROM (SELECT chain, unnest(map_keys(planted)) AS c, unnest(map_values(planted)) AS ids FROM answer_key)) USING (id)),
r AS (SELECT session_id, count(*) FILTER (tool = 'search') AS searches, count(*) FILTER (tool = 'read') AS reads, count(DISTINCT arg) FILTER (tool = 'read') AS opened FROM l GROUP BY 1)
SELECT r.*, reads - opened AS redundant, coalesce(c.clues, 0) AS clues_seen, round(coalesce(c.clues, 0) / (SELECT count(*) FROM (SELECT chain, unnest(map_keys(planted)) FROM answer_key)), 6) AS clue_recall FROM r LEFT JOIN (SELECT session_id, count(DISTINCT clue) AS clues FROM f GROUP BY 1) c USING (session_id)""")
def session_metrics(spark, sf_dir):
    """Searches, reads, opened, redundant reads and the share of all clues that a session came to see."""
    n = lambda t: F.count(F.when(F.col("tool") == t, 1))
    l = _log(spark, sf_dir)
    clue = table(spark, sf_dir, "answer_key").select("chain", F.explode("planted").alias("c", "ids"))
    every = clue.agg(F.count("*").alias("every"))  # one row
    ids = clue.select(F.concat_ws(":", "chain", "c").alias("clue"), F.explode("ids").alias("id"))
    seen = l.where("tool <> 'answer'").select("session_id", F.explode("returned").alias("id")).distinct().join(ids, "id").groupBy("session_id").agg(F.count_distinct("clue").alias("clues_seen"))
    r = l.groupBy("session_id").agg(n("search").alias("searches"), n("read").alias("reads"), F.count_distinct(F.when(F.col("tool") == "read", F.col("arg"))).alias("opened"))
    r = r.join(seen, "session_id", "left").withColumn("clues_seen", F.coalesce("clues_seen", F.lit(0))).crossJoin(F.broadcast(every))
    return r.select("session_id", "searches", "reads", "opened", (F.col("reads") - F.col("opened")).alias("redundant"), "clues_seen", F.round(F.col("clues_seen") / F.col("every"), 6).alias("clue_recall"))


@query(f"""WITH {_LOG}, s AS (SELECT DISTINCT session_id, id FROM (SELECT session_id, unnest(returned) AS id FROM l WHERE tool = 'search')) SELECT session_id, id FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE tool = 'read' AND l.session_id = s.session_id AND l.arg = s.id)""")
def two_key_anti(spark, sf_dir):
    """Mails a session found and never opened: an anti join on session and mail."""
    l = _log(spark, sf_dir)
    s = l.where("tool = 'search'").select("session_id", F.explode("returned").alias("id")).distinct()
    return s.join(l.where("tool = 'read'").select("session_id", F.col("arg").alias("id")), ["session_id", "id"], "left_anti")


@query("""WITH c AS (SELECT email_id, count(*) AS copies, count(DISTINCT sha256(coalesce(subject, '') || chr(10) || coalesce(body, ''))) AS texts FROM mailbox WHERE email_id IS NOT NULL GROUP BY 1) SELECT email_id, copies, texts = 1 AS same FROM c WHERE copies > 1""")
def rebuild_equality(spark, sf_dir):
    """Mails delivered more than once: is the digest of the text rebuilt from each copy the same?"""
    sha = F.sha2(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))), 256)
    c = table(spark, sf_dir, "mailbox").where("email_id IS NOT NULL").groupBy("email_id").agg(F.count("*").alias("copies"), F.min(sha).alias("a"), F.max(sha).alias("b"))
    return c.where("copies > 1").select("email_id", "copies", (F.col("a") == F.col("b")).alias("same"))


@query('SELECT session_id, max(seq) AS seq, max("at") AS "at" FROM tool_log WHERE session_id IS NOT NULL AND "at" IS NOT NULL GROUP BY 1')
def last_row_wins(spark, sf_dir):
    """Of rows read from several logs the last one of each session, by its number."""
    from lettermill.sources.files import last_log_rows

    l = table(spark, sf_dir, "tool_log").where("session_id IS NOT NULL AND at IS NOT NULL")
    last = last_log_rows(l.select("session_id", "seq"), ["session_id"], "seq")
    return last.join(l.groupBy("session_id").agg(F.max("at").alias("at")), "session_id")
