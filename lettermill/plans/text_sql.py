"""SQL twins of the text queries, for an independent engine over the same tables."""

from __future__ import annotations

from lettermill.functions import text as X
from lettermill.functions.nicknames import FORMAL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def before(x: str, pattern: str, flags: str) -> str:
    """Text before the first match of a pattern."""
    return rf"regexp_extract({x}, {q(rf'(?s)^(.*?)(?:(?{flags}:{pattern})|\z)')}, 1)"


def without_lines(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, {q('(?i)' + X.QUOTE_LINE)})), chr(10))"


MAILS = """
WITH mails AS (
  SELECT email_id, max(thread_id) AS thread_id, max(thread_pos) AS thread_pos, max(thread_len) AS thread_len, max(topic) AS topic, max("from") AS "from", max("date") AS "date",
         max(subject) AS subject, max(replace(body, chr(13) || chr(10), chr(10))) AS body
  FROM mailbox WHERE body IS NOT NULL AND email_id IS NOT NULL GROUP BY email_id
)
"""
OWN = strip(without_lines(before("body", X.SEPARATOR, "im")))
HEAD = f"CASE WHEN regexp_matches(coalesce(subject, ''), {q('(?i)' + X.REPLY)}) THEN '' ELSE {strip('coalesce(subject, %s)' % q(''))} END"
SHARE = r"length(regexp_replace(body, '[^\p{L}\s]', '', 'g')) / greatest(length(body), 1)"
STYLE = rf"regexp_replace({before('body', X.STYLE_CUT, 'm')}, '\s+$', '')"
M = MAILS.rstrip()
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(raw), '\s*(?:&|and)\s*', ' ', 'g'), '[^a-z ]+', ' ', 'g'), '\s+', ' ', 'g')"
_ADDR = r"CASE WHEN regexp_extract(lower(raw), '([\w.+''-]+@[\w.-]+\w)', 1) <> '' THEN regexp_extract(lower(raw), '([\w.+''-]+@[\w.-]+\w)', 1) ELSE trim(lower(raw)) END"
_STOP = "(" + ", ".join(q(w) for w in sorted(set(X.STOP_WORDS))) + ")"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), lambda t: t NOT IN {_STOP})"


def _stems(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= 5), lambda w: w[1:5]))"


def _count(p: str) -> str:
    return f"CAST(len(regexp_extract_all(body, {q(p)})) AS BIGINT)"


_NORM = r"trim(regexp_replace(lower(replace(replace({0}, '_', ' '), '&', 'and')), '\s+', ' ', 'g'))"


def _has(col: str, p: str, f: str) -> str:
    return f"regexp_matches({col}, {q((f'(?{f})' if f else '') + p)})"


_HABITS = ", ".join(f"round(avg(CASE WHEN several THEN {_has('t', p, f)}::INT END), 6) AS {name}" if name == "two_spaces" else f"round(avg({_has('t', p, f)}::INT), 6) AS {name}" for name, p, f in X.HABITS)
_PROFILE = " UNION ALL ".join(f"SELECT '{name}' AS form, count(*) AS n, round(avg({_has(over, p, f)}::INT), 6) AS rate FROM o{' WHERE own <> %s' % q('') if over == 'own' else ''}" for name, over, p, f in X.PROFILE)
_KIND = "CASE " + " ".join(f"WHEN len(t) > 0 AND len(list_filter(t, lambda x: x {'IN' if k in ('organisation', 'role') else 'NOT IN'} ({', '.join(map(q, ws))}))) {'> 0' if k in ('organisation', 'role') else '= 0'} THEN '{k}'" for k, ws in X.GUARD_WORDS.items()) + " ELSE 'person' END"

SQL = {
    "eligible_pool": f"""{M}, e AS (
  SELECT email_id, CASE WHEN head <> '' THEN {strip("head || chr(10) || own")} ELSE own END AS t
  FROM (SELECT *, {OWN} AS own, {HEAD} AS head, {SHARE} AS share FROM mails)
  WHERE NOT regexp_matches(body, {q('(?i)' + X.BULK)}) AND NOT regexp_matches(body, {q('(?i)' + X.AUTO)}) AND share >= 0.75 AND own <> ''
), k AS (
  SELECT email_id, md5(lower(regexp_replace(t, '\\s+', ' ', 'g'))[1:240]) AS prefix_hash, CAST({words('t')} AS BIGINT) AS n_words FROM e
), f AS (SELECT *, row_number() OVER (PARTITION BY prefix_hash ORDER BY email_id) AS r, CAST(floor(n_words * CAST(1.55 AS DOUBLE)) AS BIGINT) AS n_tokens FROM k)
SELECT email_id, n_words, n_tokens, prefix_hash FROM f WHERE r = 1 AND n_tokens BETWEEN 30 AND 500""",
    "gate_bulk_auto": f"""{M} SELECT email_id, regexp_matches(body, {q('(?i)' + X.BULK)}) AS bulk, regexp_matches(body, {q('(?i)' + X.AUTO)}) AS auto,
  regexp_matches(body, {q('(?i)' + X.MASS_MAIL)}) AS mass, regexp_matches(body, {q('(?i)' + X.AUTOMATED)}) AS automated FROM mails""",
    "alpha_ratio": f"{M} SELECT email_id, round({SHARE}, 6) AS share, {SHARE} < 0.75 AS dropped FROM mails",
    "own_body": f"{M} SELECT email_id, {OWN} AS own FROM mails",
    "own_body_parser": f"{M} SELECT email_id, md5({strip(before('body', X.PARSER_CUT, 'm'))}) AS own_md5 FROM mails",
    "own_body_style": f"{M} SELECT email_id, md5({STYLE}) AS own_md5, md5({strip(before(strip(before('body', X.STYLE_CUT, 'm')), X.FOOTER, 'm'))}) AS cut_md5 FROM mails",
    "reply_head": f"{M} SELECT email_id, regexp_matches(coalesce(subject, ''), {q('(?i)' + X.REPLY)}) AS reply, {HEAD} AS head FROM mails",
    "token_band": f"{M} SELECT email_id, n_tokens, n_tokens BETWEEN 30 AND 500 AS in_band FROM (SELECT email_id, CAST(floor({words('body')} * CAST(1.55 AS DOUBLE)) AS BIGINT) AS n_tokens FROM mails)",
    "prose_filter": f"""{M}, t AS (SELECT email_id, {OWN} AS t FROM mails), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS lines FROM t)
SELECT email_id FROM l WHERE {words('t')} BETWEEN 25 AND 200 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= 0.65 * length(t) AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.04 * length(t)
 AND length(regexp_replace(t, '[^;]', '', 'g')) <= 3 AND len(regexp_extract_all(t, '[A-Z][a-z]+ [A-Z][a-z]+')) <= 6
 AND len(list_filter(lines, lambda x: (regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}')) OR (contains(x, ':') AND length(x) < 40))) <= 0.3 * len(lines)""",
    "subject_bank": rf"""{M}, s AS (SELECT {strip('regexp_replace(subject, %s, %s)' % (q('(?i)' + X.PREFIXES), q('')))} AS t FROM mails WHERE subject IS NOT NULL),
g AS (SELECT lower(t) AS k, min(t) AS subject, count(*) AS n FROM s WHERE {words('t')} BETWEEN 2 AND 7 AND NOT regexp_matches(lower(t), '[<>@*"!\[\]:$]|\.{{3}}|\s{{3}}|[a-z]\d|www') AND t <> upper(t) AND t <> lower(t) GROUP BY 1),
matter AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(note), '[a-z]+')) AS w FROM topics) WHERE length(w) >= 5),
names AS (SELECT DISTINCT unnest(string_split_regex(regexp_extract(lower("from"), '^([a-z]+[._][a-z]+)@', 1), '[._]')) AS w FROM mails)
SELECT k, subject, n FROM g WHERE EXISTS (SELECT 1 FROM matter WHERE list_contains(regexp_extract_all(k, '[a-z]+'), w)) AND NOT EXISTS (SELECT 1 FROM names WHERE w <> '' AND list_contains(regexp_extract_all(k, '[a-z]+'), w))""",
    "name_shape": """SELECT DISTINCT "from" AS name FROM mailbox WHERE regexp_matches("from", '^[A-Z][a-z''-]+ (?:[A-Z]\\. )?[A-Z][A-Za-z''-]+$')""",
    "word_case_stats": rf"""{M}, t AS (SELECT unnest(regexp_extract_all(regexp_replace(body, '\S+@\S+', ' ', 'g'), '\p{{L}}+')) AS w FROM mails), w AS (SELECT w FROM t WHERE regexp_matches(w, '^[A-Za-z][a-z]+$')),
s AS (SELECT lower(w) AS word, CAST(sum((w = lower(w))::INT) AS BIGINT) AS lower_n, CAST(sum((w <> lower(w))::INT) AS BIGINT) AS upper_n FROM w GROUP BY 1)
SELECT word, lower_n, upper_n, round(lower_n / (lower_n + upper_n), 6) AS share, lower_n >= 5 AND round(lower_n / (lower_n + upper_n), 6) >= 0.25 AS wordlike FROM s""",
    "canon_label": rf"""WITH v AS (SELECT DISTINCT topic AS label, regexp_replace(topic, '\s*(?:&|and)\s*', ' ', 'g') AS norm FROM topics), r AS (SELECT DISTINCT topic AS raw FROM mailbox WHERE topic IS NOT NULL),
h AS (SELECT raw, label, instr({_KEY}, norm) AS pos, length(norm) AS l FROM r, v WHERE instr({_KEY}, norm) > 0),
b AS (SELECT raw, label, row_number() OVER (PARTITION BY raw ORDER BY pos, l DESC, label) AS k FROM h)
SELECT r.raw, coalesce(b.label, '?') AS label FROM r LEFT JOIN b ON b.raw = r.raw AND b.k = 1""",
    "address_normalise": rf"""SELECT raw, addr, CASE WHEN len(p) >= 2 THEN array_to_string(list_transform(p, lambda x: upper(x[1:1]) || lower(x[2:200])), ' ') ELSE '' END AS name
FROM (SELECT raw, addr, list_filter(string_split(string_split(addr, '@')[1], '.'), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS p FROM (SELECT raw, {_ADDR} AS addr FROM (SELECT DISTINCT "from" AS raw FROM mailbox)))""",
    "person_key": f"""WITH n AS (SELECT DISTINCT "from" AS name FROM mailbox WHERE regexp_matches("from", '^[A-Z][a-z]+ [A-Z][A-Za-z''-]+$')), f(short, formal) AS (VALUES {', '.join(f'({q(k)}, {q(v)})' for k, v in FORMAL.items())})
SELECT name, coalesce(formal, lower(string_split(name, ' ')[1])) AS first_key, translate(lower(string_split(name, ' ')[2]), '''-', '') AS last_key FROM n LEFT JOIN f ON short = lower(string_split(name, ' ')[1])""",
    "case_transfer": rf"""WITH m AS (SELECT DISTINCT topic AS model FROM mailbox WHERE topic IS NOT NULL), v AS (SELECT DISTINCT topic FROM topics WHERE topic IS NOT NULL)
SELECT v.topic, m.model, CASE WHEN regexp_matches(m.model, '\p{{L}}') AND m.model = upper(m.model) THEN upper(v.topic) WHEN regexp_matches(m.model, '\p{{L}}') AND m.model = lower(m.model) THEN lower(v.topic) ELSE v.topic END AS out
FROM m JOIN v ON {_NORM.format('m.model')} = {_NORM.format('v.topic')}""",
    "contact_shapes": f"""{M} SELECT email_id, {_count(X.PHONE)} AS phone, {_count(X.ZIP4)} AS zip4, {_count('(?i)' + X.PO_BOX)} AS po_box, {_count('(?i)' + X.SUITE)} AS suite, {_count(X.SSN)} AS ssn, {_count(X.STREET)} AS street, {_count(X.CITY_ZIP)} AS city_zip FROM mails""",
    "text_windows": """WITH d AS (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 800) / 760), 0) AS BIGINT) AS last FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, unnest(range(0, last + 1)) AS win FROM d)
SELECT doc_id, win, CAST(length(text[win * 760 + 1 : win * 760 + 800]) AS BIGINT) AS n, md5(text[win * 760 + 1 : win * 760 + 800]) AS h FROM w""",
    "file_bank": f"""{M}, f AS (SELECT trim(unnest(regexp_extract_all(body, {q('(?i)' + X.ATTACHMENT)}, 1))) AS name FROM mails), g AS (SELECT name, count(*) AS n FROM f GROUP BY 1) SELECT name, n, row_number() OVER (ORDER BY n DESC, lower(name), name) AS place FROM g""",
    "signed_name": rf"""{M}, l AS (SELECT email_id, list_filter(string_split({OWN}, chr(10)), lambda x: trim(x) <> '') AS l FROM mails),
s AS (SELECT email_id, list_filter(list_transform(l[greatest(len(l) - 2, 1):len(l)], lambda x: trim(x)), lambda x: regexp_matches(x, '^[A-Z][a-z]+$') AND lower(x) NOT IN ('thanks', 'thx', 'regards', 'best', 'cheers', 'sincerely')) AS n FROM l)
SELECT email_id, coalesce(n[-1], '') AS signed FROM s""",
    "greeting_signoff": rf"""{M}, o AS (SELECT {OWN} AS own FROM mails), f AS (SELECT string_split(own, chr(10)) AS lines, lower(trim(string_split(own, chr(10))[1])) AS first FROM o),
g AS (SELECT first, regexp_extract(first, {q(X.GREETING)}, 1) AS g, regexp_extract(lower(array_to_string(lines[greatest(len(lines) - 2, 1):len(lines)], ' ')), {q(X.SIGN_OFF)}, 1) AS s FROM f)
SELECT CASE WHEN g <> '' THEN g WHEN regexp_matches(first, {q(X.NAME_ONLY)}) AND len(regexp_split_to_array(first, ' +')) <= 4 THEN 'name only' ELSE 'none' END AS greeting, CASE WHEN s <> '' THEN s ELSE 'none' END AS sign_off, count(*) AS n FROM g GROUP BY 1, 2""",
    "style_shares": rf"""{M}, t AS (SELECT CASE WHEN starts_with(email_id, 'p_') THEN 'planted' ELSE 'background' END AS "set", {OWN} AS t FROM mails), w AS (SELECT *, {words('t')} AS w FROM t)
SELECT "set", count(*) AS n, round(avg((list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) > 100)::INT), 6) AS long_line, {_HABITS}, round(avg((w > 150)::INT), 6) AS over_150, round(avg((w < 20)::INT), 6) AS under_20, CAST(trunc(quantile_cont(w, 0.5)) AS BIGINT) AS median_words
FROM (SELECT *, len(regexp_extract_all(t, '[a-z0-9)]\.\s+[A-Z]')) >= 2 AS several FROM w) GROUP BY 1""",
    "mailbox_profile": f"{M}, o AS (SELECT {OWN} AS own, body FROM mails) {_PROFILE}",
    "order_stats": f"""{M}, w AS (SELECT {words(OWN)} AS w FROM mails), r AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM w)
SELECT n, CAST(max(w) FILTER (i = n // 4) AS BIGINT) AS p25, CAST(max(w) FILTER (i = n // 2) AS BIGINT) AS median, CAST(max(w) FILTER (i = 3 * n // 4) AS BIGINT) AS p75 FROM r GROUP BY n""",
    "hallucination_guard": f"""{M}, f AS (SELECT DISTINCT email_id, f.name AS name FROM (SELECT email_id, unnest(found) AS f FROM name_audit)) SELECT email_id, name, instr(lower(body), lower(name)) > 0 AS kept FROM f JOIN mails USING (email_id)""",
    "role_guard": f"""SELECT name, {_KIND} AS kind FROM (SELECT DISTINCT "from" AS name, regexp_extract_all(lower("from"), '[a-z]+') AS t FROM mailbox)""",
    "template_fill": "SELECT topic, 'Is ' || topic || ' named by: ' || coalesce(note, '-') || '?' AS prompt FROM topics",
    "thread_cards": rf"""{M} SELECT email_id, '[' || "date" || '] ' || "from" || ' | ' || coalesce(subject, '') || ' | ' || regexp_replace(body, '\s+', ' ', 'g')[1:60] AS card FROM mails""",
    "text_overlap": f"""WITH p AS (SELECT message_id, max(subject) AS s, max(body) AS b FROM parsed_emails WHERE subject IS NOT NULL AND body IS NOT NULL GROUP BY 1),
t AS (SELECT *, list_distinct({tokens('s')}) AS x, list_distinct({tokens('b')}) AS y FROM p) SELECT message_id, round(len(list_intersect(x, y)) / greatest(len(x), 1), 6) AS kept, instr(lower(b), lower(s[1:25])) > 0 AS verbatim FROM t""",
    "leak_words": f"""{M}, k AS (SELECT chain, secret, unnest(map_keys(planted)) AS clue, unnest(map_values(planted)) AS ids FROM answer_key), e AS (SELECT chain, secret, clue, unnest(ids) AS email_id FROM k),
w AS (SELECT chain, clue, e.email_id, list_distinct(list_filter(regexp_extract_all(lower(secret), '[a-z]+'), lambda x: length(x) >= 6)) AS ws, lower(body) AS b FROM e JOIN mails m ON m.email_id = e.email_id),
h AS (SELECT *, len(list_filter(ws, lambda x: contains(b, x))) AS hits FROM w) SELECT chain, clue, email_id, hits, hits >= greatest(3, ceil(len(ws) / 2)) AS leaks FROM h""",
    "stem_overlap": f"SELECT chain, CAST(len(list_intersect({_stems('secret')}, {_stems("coalesce(stake, '')")})) AS BIGINT) AS common, CAST(len({_stems('secret')}) AS BIGINT) AS stems FROM answer_key",
    "timeline_check": rf"""{M}, d AS (SELECT thread_id, email_id, thread_pos, CAST("date" AS DATE) AS d FROM mails WHERE regexp_matches("date", '^\d{{4}}-\d\d-\d\d$')), g AS (SELECT thread_id, email_id, date_diff('day', lag(d) OVER (PARTITION BY thread_id ORDER BY thread_pos, email_id), d) AS gap FROM d)
SELECT thread_id, email_id, gap FROM g WHERE gap > 7 OR gap < 0""",
    "point_split": r"""WITH p AS (SELECT chain, regexp_split_to_array(regexp_replace(secret, '\.$', ''), ',? and (?:that )?') AS p FROM answer_key) SELECT chain, unnest(range(len(p))) AS i, unnest(p) AS point FROM p""",
    "json_candidates": r"""SELECT doc_id, CAST(j->>'match' AS BOOLEAN) AS match, CAST(j->>'rank' AS BIGINT) AS rank, CAST(length(j->>'reason') AS BIGINT) AS n FROM (SELECT doc_id, TRY_CAST(regexp_extract(text, '(?s)(\{.*\})', 1) AS JSON) AS j FROM documents WHERE source = 'judge_notes') WHERE j IS NOT NULL AND j->>'match' IS NOT NULL""",
}
SQL["thread_id_hash"] = (
    "SELECT DISTINCT message_id, norm, 't_' || sha1(norm)[1:16] AS thread_id FROM (SELECT message_id, lower("
    + strip("regexp_replace(coalesce(subject, ''), " + q("(?i)" + X.PREFIXES) + ", '')")
    + ") AS norm FROM parsed_emails)"
)
