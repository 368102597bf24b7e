"""Pseudonymising a mailbox: registry of people, unused stand-ins, span rewriting, and a leak scan that fails closed.

Defined results: null texts stay null; an identity keeps one stand-in; a stand-in shares no word with any real identity and is given once; contact
details get stand-ins of their own shape; the scan raises if a registered name, login or real contact detail stands in the result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions.text import PHONE, PO_BOX, SSN, STREET
from lettermill.session import cut

SYLLABLES = ("bel", "cor", "dan", "fen", "gar", "hol", "jun", "kes", "lim", "mor", "nev", "pol", "rin", "sab", "tov", "wen")
LOGIN = r"(?<![a-z0-9])[a-z]{6,}(?=[0-9]*(?![a-z0-9]))"
ADDRESS = r"([\w.+-]+)@[\w.-]*\w"
SLOTS = 1 << 22
#: Contact details and the flags of their patterns.
SHAPES = ((PHONE, 0), (SSN, 0), (STREET, 0), (PO_BOX, re.I))
#: Names that are common words: alone they are names only with a capital.
COMMON = frozenset("april art august autumn brook chase cliff daisy dawn drew faith frank gay grace grant guy hope hunter ivy jade joy june may mark miles olive penny ray rich robin rose ruby rusty sage skip stone storm summer wade ward warren will young".split())
REAL = r"^([a-z]+)[._]([a-z]+)@([\w.-]+)$"


def registry(mailbox: DataFrame) -> DataFrame:
    """(first, last, addr) of the sender addresses that show a name."""
    a = mailbox.select(F.lower(F.regexp_extract("from", r"([\w.+-]+@[\w.-]+\w)", 1)).alias("addr")).where(F.col("addr").rlike(REAL)).distinct()
    return a.select(F.regexp_extract("addr", REAL, 1).alias("first"), F.regexp_extract("addr", REAL, 2).alias("last"), "addr")


def stand_in_pool(n: int, real: DataFrame) -> DataFrame:
    """(slot, fake_first, fake_last): generated names, none of whose words is a word of a real identity. ``real`` has a column ``w``."""
    spark = real.sparkSession
    syl = F.array(*map(F.lit, SYLLABLES))
    part = lambda seed: F.element_at(syl, F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(SYLLABLES))).cast("int") + 1)
    word = lambda s: F.initcap(F.concat(*(part(f"{s}{k}") for k in range(4))))
    pool = spark.range(4 * n + 64).select("id", word("f").alias("fake_first"), word("l").alias("fake_last")).dropDuplicates(["fake_first", "fake_last"]).where("fake_first <> fake_last")
    w = real.select(F.lower("w").alias("w")).distinct()
    return pool.join(w, F.lower("fake_first") == F.col("w"), "left_anti").join(w, F.lower("fake_last") == F.col("w"), "left_anti").select("id", "fake_first", "fake_last")


def assign(people: DataFrame, pool: DataFrame, seed: int = 5) -> DataFrame:
    """Each person (first, last) one stand-in: both sides are ranked by hash and joined on the rank; ranks come from counts of hash blocks."""

    def ranked(df: DataFrame, key: Column) -> DataFrame:
        d = df.withColumn("_h", F.md5(key)).withColumn("_b", F.substring("_h", 1, 2))
        counts = d.groupBy("_b").agg(F.count("*").alias("_k"))

        before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")  # 256 rows
        return d.join(before, "_b").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h"))).drop("_h", "_b", "_before")

    p = ranked(people.select("first", "last").distinct(), F.concat_ws(":", F.lit(str(seed)), "first", "last"))
    q = ranked(pool.select("fake_first", "fake_last"), F.concat_ws(":", F.lit(str(seed)), "fake_first", "fake_last"))
    return p.join(q, "rank").select("first", "last", "fake_first", "fake_last")


def reshape_address(local: Column, first: Column, last: Column) -> Column:
    """The stand-in's local part in the shape of the real one: first.last, first_last, last.first is kept in that order, or initial and surname."""
    f, l = F.lower(first), F.lower(last)
    return F.when(local.contains("."), F.concat(f, F.lit("."), l)).when(local.contains("_"), F.concat(f, F.lit("_"), l)).otherwise(F.concat(F.substring(f, 1, 1), l))


STREET_NAME = re.compile(r"(\d[\dA-Za-z]*\s+(?:[NSEW]\.?\s+)?)(.*?)(\s+\S+)$", re.S)


def fake_digits(text: str, seed: int, real: frozenset[str] = frozenset()) -> str:
    """A stand-in for a contact detail: other digits in the same shape, a phone in the 555 exchange, a street with an invented name, drawn again while it is
    ``text`` or one of ``real``. A detail of any length gets digits enough.
    """
    phone = re.fullmatch(PHONE, text)
    street = None if phone else re.fullmatch(STREET, text) and STREET_NAME.match(text)
    size = sum(map(str.isdigit, text))
    for k in range(64):
        h = hashlib.shake_128(f"{seed}:{text}:{k}".encode()).digest(size + 8)
        digits = [str(x % 10) for x in h[:size]]
        if phone:
            digits[-7:-4] = "555"
        new = iter(digits)
        out = re.sub(r"\d", lambda _: next(new), text)
        if street:
            at = STREET_NAME.match(out)
            name = _cased("".join(SYLLABLES[x % len(SYLLABLES)] for x in h[-3:]).title(), street[2])
            out = at[1] + name + at[3]
        if out != text and out not in real:
            return out
    raise ValueError("no free stand-in for a contact detail")


def fake_local(address: str, seed: int) -> str:
    """The stand-in of a local part that no registered person has: letters from a hash of the whole address."""
    h = hashlib.md5(f"{seed}:{address.lower()}".encode()).digest()
    return "".join(SYLLABLES[x % len(SYLLABLES)] for x in h[:3])


def _cased(new: str, like: str) -> str:
    return new.upper() if like.isupper() and len(like) > 1 else new.lower() if like.islower() else new


def render(form: str, first: str, last: str, fake_first: str, fake_last: str) -> str:
    """A written form of (first, last) with the stand-in's words and initials; its order, shape and letter case stay."""
    given = first in re.findall("[a-z]+", form.lower())

    def word(x: re.Match) -> str:
        w = x[0].lower()
        if w in (first, last):
            return _cased(fake_first if w == first else fake_last, x[0])
        if len(w) > 1 or form[: x.start()].endswith("'"):
            return x[0]
        # the letter of a given name not written out, else a middle initial
        new = fake_last[1] if given and last in form.lower() else fake_last[0] if given else fake_first[0]
        return new.upper() if x[0].isupper() else new.lower()

    return re.sub("[A-Za-z]+", word, form)


def logins(first: str, last: str) -> set[str]:
    """Login forms of a person: both names, or an initial and the other name, whole or cut to eight letters."""
    short = {x[0] + y for x, y in ((first, last), (last, first)) if y not in COMMON}
    return {z for z in {first + last, last + first} | short | {z[:8] for z in short} if len(z) > 5}


def _keys(text: str) -> set[str]:
    """Keys under which a person may be named: ``a b`` two names in either order, with any initials between; ``x. b`` an initial and a name;
    ``@login``; ``=b`` a capitalised word."""
    low = text.lower()
    words = re.findall("[a-z]+", low)
    full = [w for w in words if len(w) > 1]
    out = {k for ws in (words, full) for a, b in zip(ws, ws[1:]) for k in (f"{a} {b}", f"{b} {a}")}
    before = after = ""
    for w in words:
        before = w if len(w) > 1 else before
        if len(w) == 1 and before:
            out.add(f"{w}. {before}")
    for k in range(len(words) - 1, -1, -1):
        w = words[k]
        after = w if len(w) > 1 else after
        if len(w) == 1 and after:
            out.add(f"{w}. {after}")
    out |= {"@" + x for x in re.findall(LOGIN, low)}
    return out | {"=" + w.lower() for w in re.findall("(?<![A-Za-z])[A-Z][A-Za-z]+", text)}


def _sieve(keys: DataFrame) -> bytes:
    """A bit for each CRC of the keys, in half a megabyte whatever their number: what it lets pass may be a key, what it stops is none."""
    slots = keys.select(F.pmod(F.crc32("key"), F.lit(SLOTS)).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _mail_keys(sieve: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def may_be(key: str) -> bool:
        k = zlib.crc32(key.encode()) % SLOTS
        return bool(sieve[k >> 3] >> (k & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(filter(may_be, _keys(f"{f or ''}\n{t}"))) for f, t in zip(b.column("from").to_pylist(), b.column("body").to_pylist())]
            ids = [i for i, ks in zip(b.column("email_id").to_pylist(), got) for _ in ks]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([k for ks in got for k in ks], pa.string())], names=["email_id", "key"])

    return run


def _people_keys(people: DataFrame) -> DataFrame:
    """(key, who): the keys of ``_keys`` by which a person is found; a word alone stands for the first person that has it."""
    who = F.struct("first", "last", "fake_first", "fake_last")
    i = lambda x: F.substring(x, 1, 1)
    named = people.select(F.explode(F.array(F.concat_ws(" ", "first", "last"), F.concat(i("first"), F.lit(". "), "last"), F.concat(i("last"), F.lit(". "), "first"))).alias("key"), who.alias("who"))
    login = people.select(F.explode(F.udf(lambda f, l: sorted("@" + x for x in logins(f, l)), "array<string>")("first", "last")).alias("key"), who.alias("who"))
    lone = people.select(F.explode(F.array("first", "last")).alias("w"), who.alias("who")).where((F.length("w") > 3) & ~F.col("w").isin(*COMMON))
    lone = lone.groupBy("w").agg(F.min("who").alias("who")).select(F.concat(F.lit("="), "w").alias("key"), "who")
    return named.unionByName(login).unionByName(lone)


@lru_cache(4096)
def _full(first: str, last: str) -> list[re.Pattern]:
    """Both names in either order, with any initials between."""
    gap = "[^A-Za-z]+"
    return [re.compile(rf"(?<![A-Za-z]){a}(?:{gap}[a-z])*{gap}{z}(?![A-Za-z])", re.I | re.A) for a, z in ((first, last), (last, first))]


@lru_cache(4096)
def _initial(first: str, last: str) -> list[re.Pattern]:
    """An initial, perhaps more, and a name, or the name and an initial; ``a`` and ``I`` without a full stop are words."""
    out = []
    for a, z in ((first, last), (last, first)):
        letter, name = (a[0].upper(), rf"(?:{z.capitalize()}|{z.upper()})") if z in COMMON else (f"(?i:{a[0]})", f"(?i:{z})")
        stop = r"\." if a[0] in "ai" else r"\.?"
        out += [rf"(?<![A-Za-z']){letter}{stop}(?:[\s_.]*(?<![A-Za-z])[A-Za-z]\.)*[\s_.]*(?<![A-Za-z]){name}(?![A-Za-z])", rf"(?<![A-Za-z]){name},?[ \t]+{letter}{stop}(?![A-Za-z'])"]
    return [re.compile(x, re.A) for x in out]


def rewrite(mailbox: DataFrame, people: DataFrame, seed: int = 5) -> DataFrame:
    """(email_id, body): contact details first, then addresses, full names with or without initials, initial and surname, logins, then lone names.
    Each is left as a private-use mark until the end, so that no later pass changes an earlier one.

    A lone name is replaced in any letter case where the mail or its sender names its bearer, else only with a capital; a name that is a common word
    (``COMMON``) only with a capital and a bearer so named. People join their mails by equality of keys (no dictionary of all people goes to
    the workers): each mail carries only the people it names.
    A sieve of fixed size keeps the keys that are nobody's out of the shuffle.
    """
    m = mailbox.where("email_id IS NOT NULL AND body IS NOT NULL").groupBy("email_id").agg(F.max("body").alias("body"), F.max("from").alias("from"))
    keys = cut(_people_keys(people), "people-keys")
    found = m.mapInArrow(_mail_keys(_sieve(keys)), "email_id string, key string").join(keys, "key")
    # an initial and a name may fit several people; a lone word stands for one
    kind = F.when(F.col("key").startswith("="), "word").when(F.col("key").startswith("@"), "login").when(F.col("key").rlike(r"^.\. "), "initial").otherwise("full")
    named = found.groupBy("email_id").agg(F.collect_set(F.struct(kind.alias("kind"), "who", F.when(kind == "word", F.substring("key", 2, 1000)).alias("word"))).alias("who"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [re.compile(rx, flags | re.A) for rx, flags in SHAPES]
        mark = re.compile(f"{chr(0xE000)}(.)", re.S)
        login = re.compile(f"(?i:{LOGIN})", re.A)
        for b in batches:
            out = []
            for text, who in zip(b.column("body").to_pylist(), b.column("who").to_pylist()):
                kept: list[str] = []

                def back(t: str, kept=kept) -> str:
                    return mark.sub(lambda x: kept[ord(x[1]) - 0xE100], t)

                def hold(new: str, kept=kept, back=back) -> str:
                    kept.append(back(new))
                    return chr(0xE000) + chr(0xE100 + len(kept) - 1)

                text = text.replace(chr(0xE000), chr(0xE000) + chr(0xE100))
                kept.append(chr(0xE000))
                real = frozenset(x[0] for rx in shapes for x in rx.finditer(text))
                for rx in shapes:
                    text = rx.sub(lambda x, real=real: hold(fake_digits(back(x[0]), seed, real)), text)
                by = {k: sorted({w["who"]["first"] + " " + w["who"]["last"]: w["who"] for w in who or () if w["kind"] == k}.values(), key=lambda p: (-len(p["first"] + p["last"]), p["first"], p["last"])) for k in ("full", "login", "initial")}
                everyone = by["full"] + by["login"] + by["initial"]
                by_login = {z: p for p in reversed(everyone) for z in logins(p["first"], p["last"])}
                written = lambda x, p: hold(render(x[0], p["first"], p["last"], p["fake_first"], p["fake_last"]))
                short = lambda p: p["fake_first"][0].lower() + p["fake_last"].lower()

                def address(x: re.Match, everyone=everyone, by_login=by_login, short=short) -> str:
                    parts = re.findall("[a-z]+", x[1].lower())
                    p = next((p for p in everyone if p["first"] in parts and p["last"] in parts), None)
                    q = by_login.get("".join(parts))
                    new = render(x[1], p["first"], p["last"], p["fake_first"].lower(), p["fake_last"].lower()) if p else short(q) if q else fake_local(x[0], seed)
                    return hold(new + x[0][len(x[1]) :])

                text = re.sub(ADDRESS, address, text, flags=re.A)
                for k, find in (("full", _full), ("initial", _initial)):
                    for p in by[k]:
                        for rx in find(p["first"], p["last"]):
                            text = rx.sub(lambda x, p=p, written=written: written(x, p), text)
                if by_login:
                    text = login.sub(lambda x, q=by_login, short=short: hold(_cased(short(q[x[0].lower()]), x[0])) if x[0].lower() in q else x[0], text)
                lone: dict[str, tuple[str, bool]] = {}
                for p in everyone:
                    for w, new in ((p["first"], p["fake_first"]), (p["last"], p["fake_last"])):
                        lone.setdefault(w, (new, len(w) > 1 and w not in COMMON))
                for w in sorted((w for w in who or () if w["kind"] == "word"), key=lambda w: w["word"]):
                    lone.setdefault(w["word"], (w["who"]["fake_first" if w["word"] == w["who"]["first"] else "fake_last"], False))
                if lone:
                    known = lambda w, q=lone: len(w) > 1 and w.lower() in q and (w[0].isupper() or q[w.lower()][1])
                    text = re.sub("[A-Za-z]+", lambda x, q=lone, known=known: hold(_cased(q[x[0].lower()][0], x[0])) if known(x[0]) else x[0], text)
                out.append(back(text))
            yield pa.RecordBatch.from_arrays([b.column("email_id"), pa.array(out, pa.string())], names=["email_id", "body"])

    return m.select("email_id", "body").join(named, "email_id", "left").mapInArrow(run, "email_id string, body string")


def leaks(texts: DataFrame, people: DataFrame, mailbox: DataFrame | None = None) -> DataFrame:
    """(email_id, hit): one identity a mail that still stands in it. Looked for in the finished text by expressions of its own, not by the keys of the
    rewrite: a registered full name in either order, adjacent or with initials between; an initial and a name; a login; and, where the
    ``mailbox`` is given, a mail address or contact detail of the same mail's body.
    """
    reg = people.select("first", "last").distinct()
    t = texts.select("email_id", F.regexp_extract_all("body", F.lit("([A-Za-z]+)"), F.lit(1)).alias("w"), F.regexp_extract_all(F.lower("body"), F.lit(f"({LOGIN})"), F.lit(1)).alias("t"))

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, 2, F.size(w)).alias("b")))

    long = F.filter("w", lambda x: F.length(x) > 1)
    ab = t.select("email_id", F.explode(F.concat(F.coalesce(pairs(F.col("w")), F.array()), F.coalesce(pairs(long), F.array()))).alias("z")).select("email_id", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
    both = ab.select("email_id", F.lower("a").alias("first"), F.lower("b").alias("last")).unionByName(ab.select("email_id", F.lower("b").alias("first"), F.lower("a").alias("last")))
    hits = both.join(reg, ["first", "last"]).select("email_id", F.concat_ws(" ", "first", "last").alias("hit"))

    # a common word counts as a name only with a capital, after a capital letter
    name = F.lower("b")
    letter = ab.where((F.length("a") == 1) & (F.length("b") > 1) & (~name.isin(*COMMON) | (F.col("a").rlike("[A-Z]") & F.col("b").rlike("^[A-Z]")))).select("email_id", F.lower("a").alias("i"), name.alias("n"))
    parts = reg.select(F.substring("first", 1, 1).alias("i"), F.col("last").alias("n")).union(reg.select(F.substring("last", 1, 1), F.col("first"))).where("length(n) > 1").distinct()
    hits = hits.unionByName(letter.join(parts, ["i", "n"]).select("email_id", F.concat_ws(". ", "i", "n").alias("hit")))

    known = reg.select(F.explode(F.udf(lambda f, l: sorted(logins(f, l)), "array<string>")("first", "last")).alias("login")).distinct()
    hits = hits.unionByName(t.select("email_id", F.explode("t").alias("login")).join(known, "login").select("email_id", F.col("login").alias("hit")))
    if mailbox is not None:
        contacts = lambda c: F.concat(F.regexp_extract_all(F.lower(c), F.lit(f"({ADDRESS})"), F.lit(1)), *(F.regexp_extract_all(c, F.lit(f"({'(?i)' * bool(flags)}{rx})"), F.lit(1)) for rx, flags in SHAPES))
        was = mailbox.where("email_id IS NOT NULL AND body IS NOT NULL").groupBy("email_id").agg(F.max("body").alias("body")).select("email_id", contacts("body").alias("was"))
        left = F.array_intersect("was", contacts("body"))
        hits = hits.unionByName(texts.join(was, "email_id").select("email_id", F.explode(left).alias("hit")))
    return hits.groupBy("email_id").agg(F.min("hit").alias("hit"))


def verified(texts: DataFrame, people: DataFrame, mailbox: DataFrame | None = None) -> DataFrame:
    """``texts``, once no registered name and, where the ``mailbox`` is given, none of its contact details stands in them; raises otherwise."""
    t = cut(texts, "rewritten")
    bad = leaks(t, people, mailbox).limit(5).collect()
    if bad:
        raise ValueError(f"names left in {[(r['email_id'], r['hit']) for r in bad]}")
    return t


def pseudonymised(mailbox: DataFrame, seed: int = 5) -> DataFrame:
    """(email_id, body) with every registered person and contact detail replaced and the result scanned."""
    people = cut(registry(mailbox).select("first", "last").distinct(), "registry")
    n = people.count()
    words = people.select(F.explode(F.array("first", "last")).alias("w"))
    mapping = cut(assign(people, stand_in_pool(n, words), seed), "stand-ins")
    if mapping.count() < n:
        raise ValueError("too few stand-ins")
    return verified(rewrite(mailbox, mapping, seed), people, mailbox)
