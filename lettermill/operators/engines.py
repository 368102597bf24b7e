"""The seam to a language model: prompts out, answers in as a table keyed by the prompt's digest, and parsers of the answers.

No model is called here.  ``replay`` joins stored answers; ``stub`` gives deterministic ones for dry runs; the parsers turn text into rows.
Defined results: a prompt without a stored answer keeps a null answer and is listed by ``pending``; an answer that does not parse gives null or an empty list.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill import schema


def prompted(df: DataFrame, template: str, **fields: Column) -> DataFrame:
    """``df`` with ``prompt``, the template with its ``<<NAME>>`` slots filled, and ``prompt_sha``."""
    p = F.lit(template)
    for name, col in fields.items():
        p = F.replace(p, F.lit(f"<<{name.upper()}>>"), F.coalesce(col.cast("string"), F.lit("")))
    return df.withColumn("prompt", p).withColumn("prompt_sha", F.sha2("prompt", 256))


def replay(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Stored answers by digest; of several the first in text order."""
    one = answers.groupBy("prompt_sha").agg(F.min("answer").alias("answer"))
    return prompts.join(one, "prompt_sha", "left")


def pending(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts still to be asked."""
    return prompts.join(answers.select("prompt_sha"), "prompt_sha", "left_anti")


def stub(prompts: DataFrame, choices: list[str]) -> DataFrame:
    """An answer picked by the prompt's digest."""
    pick = F.pmod(F.conv(F.substring("prompt_sha", 1, 7), 16, 10).cast("int"), F.lit(len(choices))) + 1
    return prompts.withColumn("answer", F.element_at(F.array(*map(F.lit, choices)), pick))


_DECODER = json.JSONDecoder()


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text; braces inside strings do not count. Each brace is tried once, by the library's own scanner."""
    if not text:
        return None
    start = text.find("{")
    while start >= 0:
        try:
            got, end = _DECODER.raw_decode(text, start)
            if isinstance(got, dict):
                return text[start:end]
        except (ValueError, RecursionError):
            pass
        start = text.find("{", start + 1)
    return None


def _objects(text: pd.Series) -> pd.Series:
    return text.map(first_object, na_action="ignore")


def first_json(text: Column | str) -> Column:
    return F.pandas_udf(_objects, "string")(text)


def outer_json(text: Column) -> Column:
    """From the first brace to the last, a code fence put aside."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def candidates(text: Column, limit: int) -> Column:
    """struct(parsed, returned, kept): candidates of an answer, those without a secret dropped, cut to ``limit``."""
    o = F.from_json(first_json(text), schema.CANDIDATES)
    every = F.coalesce(F.filter(o["candidates"], lambda c: c.isNotNull()), F.array().cast("array<struct<secret:string,evidence:array<string>>>"))
    good = F.filter(every, lambda c: F.trim(F.coalesce(c["secret"], F.lit(""))) != "")
    return F.struct(o["candidates"].isNotNull().alias("parsed"), F.size(good).alias("returned"), F.slice(good, 1, limit).alias("kept"))


def people_lines(answer: Column) -> Column:
    """array<struct<forms, addr>> of ``form, form | address`` lines; list furniture is taken off, the longest form comes first."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda l: F.trim(F.regexp_replace(l, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda l: l != "")
    part = lambda l, i: F.trim(F.coalesce(F.get(F.split(l, r"\|"), F.lit(i)), F.lit("")))
    forms = lambda l: F.array_sort(F.filter(F.transform(F.split(part(l, 0), r"\s*[,;/]\s*"), F.trim), lambda f: f != ""), lambda a, b: F.length(b) - F.length(a))
    return F.transform(lines, lambda l: F.struct(forms(l).alias("forms"), F.nullif(F.lower(part(l, 1)), F.lit("")).alias("addr")))


def grounded(rows: DataFrame, text: str, span: str) -> DataFrame:
    """Rows whose span stands in their own text, letter case aside."""
    return rows.where(F.instr(F.lower(F.col(text)), F.lower(F.col(span))) > 0)
