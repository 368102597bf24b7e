"""Which spellings of names stand for the same person or organisation.

A spelling is read into its parts (display names with or without a comma, titles, initials, suffixes, directory paths, mail addresses,
logins; organisations by their head word).  Mail addresses give the entities their anchors.  A full name is looked up among the anchors' names,
in all short forms of the given name, first by equality and then within an edit distance of ``RADIUS`` by the pivot-partitioned radius join
of :mod:`metric_join`; initials and logins are looked up by surname.  Names without an anchor are grouped among themselves by the same join.

Defined results: null and blank spellings stand for nobody; a spelling that fits two entities equally well is linked to none; equal spellings
are one; an empty table gives no pairs; extra columns are ignored.  Pairs are symmetric and listed once, the smaller spelling first.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lettermill.functions.nicknames import FORMAL, SHORTS
from lettermill.llm.classes import expanded
from lettermill.llm.metric_join import radius_join
from lettermill.session import cut, merged, spread

RADIUS = 2
# Words around names.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "hon", "rev"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "md", "esq", "cpa"}
CORPORATE = {"inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "plc", "gmbh", "the"}
ORG_WORDS = {
    "bank", "university", "univ", "press", "hospital", "hosp", "department", "dept", "power", "valley", "pipeline", "services", "svcs", "engineering", "engrg", "associates", "assoc",
    "insurance", "brothers", "bros", "group", "grp", "technology", "tech", "manufacturing", "mfg", "international", "intl", "regional", "reg", "transport", "trust", "partners", "holdings",
    "vly", "pwr", "pipe", "svc", "ins", "trans", "engr", "engg", "mfrs", "natl", "energy", "gas", "freight", "mutual", "works", "college", "school", "society", "council", "agency", "office", "systems", "industries", "consulting",
}
ROLE = {"notices", "info", "office", "contact", "billing", "admin", "news", "support", "sales", "noreply", "service", "mail"}
PARSED = "spelling string, kind string, a string, b string, mid string, dom string, sure boolean"
_ADDRESS = re.compile(r"([\w.+'-]+)@([\w-]+(?:\.[\w-]+)*)")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def read_spelling(s: str) -> list[tuple]:
    """(kind, a, b, mid, dom, sure) readings of one spelling. Kinds: full (first, last), init (initial, last), login (text), org (head word)."""
    text = unicodedata.normalize("NFC", s).strip()
    out: list[tuple] = []
    m = _ADDRESS.search(text)
    show = text
    if m and "/" not in text:
        local, dom = m[1].lower(), m[2].lower().split(".")[0]
        show = text[: m.start()].strip(" <\"'")
        parts = [p for p in re.split(r"[._]", local) if p]
        if local in ROLE or (len(parts) == 1 and parts[0] in ROLE):
            out.append(("org", dom, "", "", dom, True))
        elif len(parts) >= 2 and len(parts[0]) > 1 and len(parts[-1]) > 1:
            out.append(("addr", parts[0], parts[-1], parts[1] if len(parts) == 3 and len(parts[1]) == 1 else "", dom, False))
        elif len(parts) == 2:
            out.append(("init", parts[0][:1], parts[-1], "", dom, True))
        elif len(local) > 2:
            out.append(("login", local, "", "", dom, True))
        if not show:
            return out
    show = show.split("/")[0].strip().strip("\"'")
    inside = re.search(r"\(([^)]+)\)", show)
    low = [w.lower() for w in _WORD.findall(show)]
    if inside or any(w in ORG_WORDS or w in CORPORATE for w in low):
        heads = [w.lower() for w in _WORD.findall(inside[1])] if inside else [w for w in low if w not in CORPORATE]
        if heads:
            # initials of the words that say what it does; the same for their abbreviations
            what = [w[0] for w in low if w not in CORPORATE and w not in ("of", "and", heads[0])]
            out.append(("org", heads[0], "".join(what), "", "", True))
        return out
    comma = "," in show
    left, _, right = show.partition(",")
    lw = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", left)]
    rw = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", right)]
    clean = lambda ws: [w for w in ws if w not in TITLES and w not in SUFFIXES]
    lw, rw = clean(lw), clean(rw)
    if comma and lw and rw:
        words = [*rw, lw[-1]] if len(lw) == 1 or len(rw) else lw
        sure = True
    else:
        words, sure = lw or rw, False
    if len(words) < 2:
        return out
    short = [len(w) == 1 for w in words]
    if short[0] and not short[-1]:
        out.append(("init", words[0], words[-1], words[1] if len(words) > 2 and short[1] else "", "", True))
    elif short[-1] and not short[0]:
        out.append(("init", words[-1], words[0], "", "", True))
    elif not short[0] and not short[-1]:
        mid = words[1] if len(words) > 2 and short[1] else ""
        out.append(("full", words[0], words[-1], mid, "", sure or bool(mid)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(s, *r) for s in batch.column(0).to_pylist() if s and s.strip() for r in read_spelling(s)]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:6]), pa.array(cols[6], pa.bool_())], names=["spelling", "kind", "a", "b", "mid", "dom", "sure"])


def _best(df: DataFrame, key: str, entity: str, *cost: str) -> DataFrame:
    """The one entity of least cost for each key; none where two entities tie."""
    w = Window.partitionBy(key)
    least = df.groupBy(key, entity).agg(F.min(F.struct(*cost)).alias("_c"))
    least = least.withColumn("_m", F.min("_c").over(w)).where(F.col("_c") == F.col("_m"))
    return least.withColumn("_n", F.count("*").over(w)).where("_n = 1").select(key, entity)


def entities(spellings: DataFrame) -> DataFrame:
    """(spelling, entity) of a column ``spelling``: the entity each spelling stands for."""
    spark = spellings.sparkSession
    parts = cut(spread(spellings.where(F.col("spelling").isNotNull()).select("spelling").distinct()).mapInArrow(_read, PARSED), "names")

    # which words are given names: where they stand in readings of known order, and more weakly in addresses
    people = parts.where(F.col("kind").isin("full", "addr"))
    weight = F.when(F.col("sure"), F.lit(3)).otherwise(F.lit(1))
    seats = people.select(F.col("a").alias("w"), weight.alias("n")).union(people.select("b", -weight)).groupBy("w").agg(F.sum("n").alias("n"))
    given = seats.where("n > 0").select("w").union(spark.createDataFrame([(w,) for g in SHORTS for w in (g, *SHORTS[g])], "w string")).distinct()
    g1, g2 = given.select(F.col("w").alias("a"), F.lit(True).alias("ga")), given.select(F.col("w").alias("b"), F.lit(True).alias("gb"))
    people = people.join(merged(g1), "a", "left").join(merged(g2), "b", "left")
    swap = ~F.col("sure") & F.col("gb").isNotNull() & F.col("ga").isNull()
    people = people.select("spelling", "kind", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("last"), "mid", "dom", (F.col("sure") | F.col("ga").isNotNull() | F.col("gb").isNotNull()).alias("known"))
    people = cut(people, "people")

    # anchors from addresses; an entity is named by its formal given name and surname
    formal = F.create_map(*[F.lit(x) for k, v in FORMAL.items() for x in (k, v)])
    shorts = F.create_map(*[x for k, v in SHORTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    as_formal = lambda c: F.coalesce(F.element_at(formal, F.col(c)), F.col(c))
    anchors = people.where("kind = 'addr'").select(as_formal("first").alias("f"), "last", "dom", "mid").withColumn("entity", F.concat_ws(" ", "f", "last"))
    who = anchors.select("entity", "f", "last").distinct()
    keys = who.select("entity", F.explode(F.concat(F.array("f"), F.coalesce(F.element_at(shorts, F.col("f")), F.array().cast("array<string>")))).alias("g"), "last").select("entity", F.concat_ws(" ", "g", "last").alias("key"))
    keys = cut(_best(keys.withColumn("_z", F.lit(0)), "key", "entity", "_z"), "keys")

    # full names: equal, else within the radius in either order
    full = people.where("kind = 'full'").select("spelling", F.concat_ws(" ", "first", "last").alias("key"), F.concat_ws(" ", "last", "first").alias("other"), "known")
    equal = full.join(merged(keys), "key").select("spelling", "entity")
    rest = full.join(merged(equal), "spelling", "left_anti")
    asked = rest.select("spelling", "key").union(rest.where("not known").select("spelling", F.col("other")))
    asked = cut(asked, "asked")
    near = cut(radius_join(asked.select("key"), keys.select("key"), RADIUS), "near")
    near = asked.join(merged(near), asked["key"] == near["l"]).join(merged(keys.withColumnRenamed("key", "r")), "r").select("spelling", "entity", "dist")
    near = _best(near, "spelling", "entity", "dist")
    linked = cut(equal.union(near), "linked")

    # no anchor: group among themselves, each to the best supported name within the radius
    alone = full.join(merged(linked.select("spelling")), "spelling", "left_anti").join(merged(people.select("spelling", as_formal("first").alias("f"), "last")), "spelling").withColumn("name", F.concat_ws(" ", "f", "last"))
    alone = cut(alone, "alone")
    support = alone.groupBy("name").agg(F.count("*").alias("n"))
    pairs = radius_join(support.select(F.col("name").alias("key")), support.select(F.col("name").alias("key")), RADIUS)
    to = pairs.join(merged(support.toDF("r", "n")), "r").groupBy("l").agg(F.max(F.struct("n", "r")).alias("m")).select(F.col("l").alias("name"), F.col("m.r").alias("entity"))
    lone = cut(alone.join(merged(to), "name").select("spelling", "entity"), "lone")

    # initials and logins by surname
    named = who.select(F.substring("f", 1, 1).alias("i"), "last", "entity").union(lone.select("entity").distinct().select(F.substring("entity", 1, 1), F.element_at(F.split("entity", " "), -1), "entity")).distinct()
    named = cut(named, "named")
    mids = linked.union(lone).join(merged(people.where("mid <> ''").select("spelling", "mid")), "spelling").select("entity", F.col("mid").alias("known_mid")).distinct()
    init = parts.where("kind = 'init'").select("spelling", F.col("a").alias("i"), F.col("b").alias("last"), "mid")
    hit = init.join(merged(named), ["i", "last"])
    far = init.join(merged(hit.select("spelling")), "spelling", "left_anti")
    near_last = radius_join(far.select(F.col("last").alias("key")), named.select(F.col("last").alias("key")), RADIUS)
    fuzzy = far.join(merged(near_last), far["last"] == near_last["l"]).select("spelling", "i", F.col("r").alias("last"), "mid", "dist").join(merged(named), ["i", "last"])
    cands = hit.select("spelling", "entity", "mid", F.lit(0).alias("dist")).union(fuzzy.select("spelling", "entity", "mid", "dist"))
    cands = cands.join(merged(mids), (cands["entity"] == mids["entity"]) & (cands["mid"] == mids["known_mid"]), "left").select("spelling", cands["entity"], "dist", F.when(F.col("known_mid").isNotNull(), 0).otherwise(1).alias("off"))
    initials = cut(_best(cands, "spelling", "entity", "dist", "off"), "initials")
    logins = parts.where("kind = 'login'").select("spelling", F.col("a").alias("login"), "dom")
    own = anchors.select("entity", "dom", F.explode(F.array(F.concat(F.substring("f", 1, 1), "last"), F.concat("f", "last"), F.concat("last", F.substring("f", 1, 1)))).alias("login")).distinct()
    logins = _best(logins.join(merged(own), ["login", "dom"]).withColumn("_z", F.lit(0)), "spelling", "entity", "_z")
    # a login whose person writes under no full address
    lost = parts.where("kind = 'login'").select("spelling", F.col("a").alias("login")).join(merged(logins), "spelling", "left_anti")
    logins = logins.union(_best(lost.join(merged(named.withColumn("login", F.concat("i", "last"))), "login").withColumn("_z", F.lit(0)), "spelling", "entity", "_z"))
    addresses = people.where("kind = 'addr'").select("spelling", F.concat_ws(" ", as_formal("first"), F.col("last")).alias("entity"))

    # organisations by head word
    org = parts.where("kind = 'org'").select("spelling", F.col("a").alias("head"), F.col("b").alias("what"), (F.col("dom") != "").alias("sure"))
    heads = org.groupBy("head").agg(F.max("sure").alias("sure"), F.count("*").alias("n"), F.mode(F.expr("nullif(what, '')"), True).alias("what"))
    heads = cut(heads, "heads")
    op = radius_join(heads.where("not sure").select(F.col("head").alias("key")), heads.select(F.col("head").alias("key")), RADIUS)
    own = heads.select(F.col("head").alias("l"), F.col("what").alias("own_what"))
    op = op.join(merged(heads.withColumnRenamed("head", "r")), "r").join(merged(own), "l").where("l = r OR what = own_what OR what IS NULL OR own_what IS NULL")  # another trade is another firm
    to = op.groupBy("l").agg(F.max(F.struct("sure", F.when(F.col("sure"), -F.col("dist")).otherwise(0).alias("d"), "n", "r")).alias("m")).select(F.col("l").alias("head"), F.col("m.r").alias("to"))
    orgs = cut(org.join(merged(to), "head", "left").select("spelling", F.concat(F.lit("org:"), F.coalesce("to", "head")).alias("entity")), "orgs")

    every = addresses.union(linked).union(lone).union(initials).union(logins).union(orgs).distinct()
    # a display name with an address is the address's owner; of several readings the first kind named wins
    rank = F.when(F.col("spelling").contains("@"), F.lit(0)).otherwise(F.lit(1))
    first = addresses.union(logins).union(orgs.where(F.col("spelling").contains("@"))).distinct().select("spelling", F.col("entity").alias("sure_entity"))
    return every.join(merged(first), "spelling", "left").select("spelling", F.coalesce("sure_entity", "entity").alias("entity"), rank.alias("rank")).groupBy("spelling").agg(F.min(F.struct("rank", "entity")).alias("m")).select("spelling", "m.entity")


def variant_pairs(spellings: DataFrame) -> DataFrame:
    """(a, b): different spellings of one entity, the smaller first."""
    e = cut(entities(spellings).select(F.col("entity").alias("cls"), F.col("spelling").alias("id")), "entities")
    several = e.groupBy("cls").agg(F.min("id").alias("i"), F.max("id").alias("j")).where("i < j").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return expanded(several, e).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).where("a < b").distinct()
