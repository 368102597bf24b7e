"""One form for texts that look the same on the screen.

Inside Arrow partitions an embedded DuckDB runs one SQL expression over the batch: joined letters are opened, compatibility forms (full and
half width) and look-alike letters and hyphens are translated to one letter, blanks of any kind become a blank, invisible characters go,
and the result is composed by ``nfc_normalize``.  Letter case, accents, digits, words and line breaks stay.

Defined results: null gives null; an empty text, or one without a visible character, has no visible form and is in no pair; texts that are
equal character by character are no pair; extra columns are carried only where asked for.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.classes import expanded
from lettermill.session import cut, merged, spread

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԁ": "D", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ё": "Ë", "Ӏ": "I", "Һ": "H",
    # Cyrillic small letters
    "а": "a", "е": "e", "ё": "ë", "ѕ": "s", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "ρ": "p",
    # others
    "ɑ": "a", "ɡ": "g", "ѡ": "w", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Տ": "S", "Օ": "O",
    # hyphens
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "⁃": "-", "﹣": "-", "－": "-", "˗": "-", "۔": "-",
}


# Format characters that are drawn.
SEEN = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1345F)]


def _tables() -> tuple[str, str, list[tuple[str, str]], str]:
    """What ``translate`` turns into what, the joined letters, and the class of invisible characters; derived from the character database."""
    single: dict[str, str] = {}
    joined: list[tuple[str, str]] = []
    invisible: list[int] = []
    for i in range(sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        cat = unicodedata.category(c)
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if cat == "Zs" or c == "\t":
            single[c] = " "
        elif (cat == "Cf" and not any(a <= i <= b for a, b in SEEN)) or 0xFE00 <= i <= 0xFE0F or 0xE0100 <= i <= 0xE01EF or i in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            invisible.append(i)
        elif kind in ("<wide>", "<narrow>", "<small>") and len(rest.split()) == 1:
            single[c] = chr(int(rest, 16))
        elif kind == "<compat>" and i < 0xFB50 and ("LIGATURE" in (name := unicodedata.name(c, "")) or "DIGRAPH" in name or "LETTER DZ" in name or "LETTER LJ" in name or "LETTER NJ" in name):
            joined.append((c, "".join(chr(int(x, 16)) for x in rest.split())))
    single.pop(" ", None)
    single |= LOOK_ALIKES
    for i in range(0x370, 0x530):  # accented look-alikes go to the accented letter they look like
        base, _, mark = unicodedata.decomposition(chr(i)).partition(" ")
        if mark and not base.startswith("<") and (to := LOOK_ALIKES.get(chr(int(base, 16)))):
            to = unicodedata.normalize("NFC", to + "".join(chr(int(x, 16)) for x in mark.split()))
            if len(to) == 1:
                single.setdefault(chr(i), to)
            else:
                joined.append((chr(i), to))
    for c, to in list(single.items()):  # a width form of a look-alike goes to its letter at once
        single[c] = single.get(to, to)
    spans, run = [], None
    for i in invisible:
        if run and run[1] == i - 1:
            run[1] = i
        else:
            spans.append(run := [i, i])
    cls = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" if a != b else f"\\x{{{a:X}}}" for a, b in spans)
    return "".join(single), "".join(single.values()), joined, f"[{cls}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(batch: str = "batch", columns: str = "") -> str:
    """SQL of the one form, ``form``, of the texts ``t`` of a table with row keys ``r``."""
    src, to, joined, invisible = _tables()
    some = "[" + "".join(a for a, _ in joined) + "]"
    chain = "x"
    for a, b in joined:
        chain = f"replace({chain}, {_quoted(a)}, {_quoted(b)})"
    return f"""
        WITH plain AS (SELECT r, nfc_normalize(regexp_replace(t, {_quoted(invisible)}, '', 'g')) AS x FROM {batch}),
        opened AS (SELECT r, x FROM plain WHERE NOT regexp_matches(coalesce(x, ''), {_quoted(some)})
                   UNION ALL SELECT r, {chain} FROM plain WHERE regexp_matches(coalesce(x, ''), {_quoted(some)}))
        SELECT {columns}nfc_normalize(translate(x, {_quoted(src)}, {_quoted(to)})) AS form FROM opened ORDER BY r
    """


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    sql = form_sql()
    for whole in batches:
        for lo in range(0, whole.num_rows, 2048):
            part = whole.slice(lo, 2048)
            batch = pa.table({"r": pa.array(range(part.num_rows)), "t": part.column(part.num_columns - 1)})
            con.register("batch", batch)
            form = con.sql(sql).to_arrow_table().column("form").cast(pa.string()).combine_chunks()
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*part.columns, form], names=[*part.schema.names, "form"])
    con.close()


def with_form(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, the text as ``text`` and its one form as ``form``."""
    src = spread(docs.select(*keep, F.col(text).alias("text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(_forms, f"{kinds}, form string")


def same_look_pairs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(a, b): keys of two rows whose texts share one form and differ in a character; the smaller key first.

    Rows meet by 128-bit digests.  Exact copies share the digest of the raw text and are members of one spelling; spellings that share a form are joined, never
    members, and linked spellings go back to keys in blocks. The forms are made once and written.
    """
    formed = with_form(docs.where(F.col(key).isNotNull()), [key], text)
    digest = lambda c: F.unhex(F.md5(c))
    rows = cut(formed.where(F.col("form").rlike(r"(?U)\S")).select(F.col(key).alias("id"), digest("form").alias("f"), digest("text").alias("cls")), "forms")
    spellings = rows.select("f", "cls").distinct()
    several = merged(spellings.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    varied = merged(spellings.join(several, "f"))
    links = cut(varied.toDF("f", "a").join(varied.toDF("f", "b"), "f").where("a < b").select("a", "b"), "spellings")
    return expanded(links, rows.select("cls", "id")).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a < b").distinct()
