"""Layout of mail text: wrapping by a writer's habit, quote-aware; names set in for labels."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|St|No|Inc|Co|Corp|Ltd|vs|etc|e\.g|i\.e|U\.S|[A-Z])\.$")


def reformat(text: str, wrap: int | None = 76, double: bool = True) -> str:
    """Own lines wrapped at ``wrap`` and two spaces after a full stop, if the writer types so; quoted lines stay as they are."""
    out = []
    for line in text.split("\n"):
        if line.lstrip().startswith((">", "|")):
            out.append(line)
            continue
        if double:
            parts = re.split(r"(?<=[.?!]) +(?=[A-Z\"'(])", line)
            line = parts[0] if parts else ""
            for p in parts[1:]:
                line += (" " if _ABBREVIATION.search(line) else "  ") + p
        if wrap and len(line) > wrap:
            marked = line.replace("  ", " \x00")
            out += [x.replace(" \x00", "  ").replace("\x00", " ").rstrip() for x in textwrap.wrap(marked, wrap, break_long_words=False, break_on_hyphens=False)]
        else:
            out.append(line)
    return "\n".join(out)


def _columns(text: pd.Series, wraps: pd.Series, double: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else reformat(t, 76 if w else None, bool(d)) for t, w, d in zip(text, wraps, double)], dtype=object)


def reformatted(text: str, wraps: str, double: str) -> Column:
    """``reformat`` over columns: the text, whether its writer wraps lines, whether they type two spaces."""
    return F.pandas_udf(_columns, "string")(text, wraps, double)


def set_names(text: str, names: dict[str, str]) -> str:
    """Labels in braces replaced by names: the full name in header lines, the given name in a greeting or below a closing phrase, else the full name."""
    out = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        short = bool(re.match(r"\s*(?:hi|hello|hey|dear)\b", line, re.I)) or re.fullmatch(r"\s*\{\w+\}\s*[,:-]?\s*", line) is not None
        out.append(re.sub(r"\{(\w+)\}", lambda m: (names.get(m[1], m[0]).split(" ")[0] if short else names.get(m[1], m[0])), line))
    return "\n".join(out)
