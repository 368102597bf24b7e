"""Labels for fitting the CRF, from evidence that its features do not hold.

No shape, line or word-class pattern labels a name.  A full name is labelled where the registry of sender addresses holds its pair of words (in either order, short
forms of the given name included), an initial with a surname where the registry holds such a pair, a given name alone where a sender of the same thread bears it; a
word alone that is ordinary in small letters, or only ever a surname, is none.  Numbers are labelled by the words before them only; a number without such
a word is none where its shape never follows one in the sample, and unlabelled where it does.  Everything else is unlabelled, and its cluster stays out of the fit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lettermill.llm import spans

PHONE_BEFORE = re.compile(r"\b(?:tel|ph|phone|call|cell|fax|mobile|direct)\b(?:\W+\w+)??\W*$", re.I)
ID_BEFORE = re.compile(r"\b(?:ssn|social|passport|licen[sc]e|insurance|tax id)\b(?:\W+\w+){0,2}?\W*$", re.I)
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*\.?")


@dataclass
class Registry:
    """What the tables say about the words of the sample, all in small letters."""

    pairs: set = field(default_factory=set)  # (given name or a short form, surname)
    initials: set = field(default_factory=set)  # (first letter, surname)
    given: set = field(default_factory=set)
    surnames: set = field(default_factory=set)
    thread: dict = field(default_factory=dict)  # thread -> formal given names of its senders
    ordinary: set = field(default_factory=set)

    def full(self, a: str, b: str) -> bool:
        return (a, b) in self.pairs or (b, a) in self.pairs

    def name(self, words: list[str], dotted: bool, thread) -> bool | None:
        """Is a segment of these words a name? None: not known."""
        core = [w for w in words if len(w) > 1 and w not in spans.TITLES and w not in spans.SUFFIXES]
        initials = [w for w in words if len(w) == 1]
        if len(core) == 2:
            if self.full(*core):
                return True
            return False if all(w in self.given and w not in self.surnames for w in core) else None  # two given names are no full name
        if len(core) != 1:
            return False
        w = core[0]
        if initials:
            if any((i, w) in self.initials for i in initials):
                return True
            return False if w in self.given and w not in self.surnames else None  # a given name and a letter are none
        if spans.FORMAL.get(w, w) in self.thread.get(thread, ()):
            return None if dotted else True
        return False if w in self.ordinary or w in self.surnames and w not in self.given else None


def shapes(texts) -> set[tuple[str, str]]:
    """(kind, shape) of numbers that follow a telling word somewhere; ``texts`` yields (text, clusters)."""
    out = set()
    for text, clusters in texts:
        for c in clusters:
            for s, e, k, _ in c.cands:
                before = PHONE_BEFORE if k == "phone" else ID_BEFORE if k == "id_number" else None
                if before and before.search(text, max(0, s - 40), s):
                    out.add((k, spans.digits_shape(text[s:e])))
    return out


def labels(text: str, c: spans.Cluster, thread, registry: Registry, seen: set[tuple[str, str]]) -> list[bool | None]:
    """One label a candidate. Of overlapping positives the longest stays, kinds other than names first; what overlaps it is none."""
    out: list[bool | None] = []
    for i, (s, e, k, _) in enumerate(c.cands):
        if k == "email":
            out.append(True)
        elif k == "address":
            out.append(c.whole[i])
        elif k == "name":
            words = [w.rstrip(".").lower() for w in _WORD.findall(text[s:e])]
            out.append(registry.name(words, "." in text[s:e], thread))
        else:
            p, d = (bool(x.search(text, max(0, s - 40), s)) for x in (PHONE_BEFORE, ID_BEFORE))
            if p or d:
                out.append(p != d and (k == "phone") == p)
            else:
                out.append(None if (k, spans.digits_shape(text[s:e])) in seen else False)
    keep: list[tuple[int, int]] = []
    for i in sorted((i for i, v in enumerate(out) if v), key=lambda i: (c.cands[i][2] == "name", c.cands[i][0] - c.cands[i][1])):
        a, b = c.cands[i][:2]
        if all(b <= x or a >= y for x, y in keep):
            keep.append((a, b))
        else:
            out[i] = False
    for i, (v, (s, e, _, _)) in enumerate(zip(out, c.cands)):
        over = [y - x for x, y in keep if e > x and s < y]
        if over and not v and (v is False or e - s <= max(over)):  # an unknown segment that reaches beyond a known one stays unknown
            out[i] = False
    return out
