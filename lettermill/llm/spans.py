"""Candidate segments of personal details in one text, their features, and a semi-Markov CRF over them.

A text is cut into clusters of overlapping candidate segments; outside a cluster the one label is "nothing" and scores zero.  Inside, a labelling
chooses segments that do not overlap; its score is the sum of the segments' scores, each a sum of weights of whole-span features (shape, word
classes, length, what stands before and after, what line it is in).  The best labelling, the partition sum and the marginals come from dynamic
programming over the segment borders.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left

from lettermill.functions.nicknames import FORMAL, SHORTS

BITS = 1 << 24  # size of a hashed word set: 2 MB
GAP = r"(?:,? ?\n[>|\t ]{0,12}|,? {1,2})"
EMAIL = re.compile(
    r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+(?<![_-])"
    r"|(?<![\w.])[\w-]+(?:(?: dot |\.)[\w-]+){0,3}(?: at | ?[\[(]at[\])] ?)[\w-]+(?:(?: dot | ?[\[(]dot[\])] ?|\.)[A-Za-z][\w-]*){1,3}",
    re.I,
)
SPELT = re.compile(r" dot |[\[(](?:at|dot)[\])]", re.I)
AT_HOST = re.compile(r" at [\w-]+\.[a-z]", re.I)
NUMBER = re.compile(
    r"(?<![\w.,@/#-])(?:\+?\(?\d[\d()./+-]*(?:[ \n>]{1,4}\(?\d[\d()./+-]*){0,5}(?:[ \n>]{1,4}(?:ext|x|extension)\.?[ \n>]{0,4}\d{1,6})?"
    r"|[A-Z]{1,3}[ -]?\d{6,10}|[A-Z]{2}(?: ?\d\d){3} ?[A-D])(?![\w@])"
)
STREET = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Ter|Loop|Circle|Cir|Square|Sq|Parkway|Pkwy|Highway|Hwy|Trail|Trl|Alley|Row|Crescent|Cres|Close|Walk|Path|Pike|Plaza)"
_S = r"(?:[ ]{1,2}|[ ]?\n[>|\t ]{0,12})"
ADDRESS = re.compile(
    rf"(?<![\w.,#-])(?:(?P<street>\d{{1,5}}[A-Za-z]?{_S}(?:[NSEW]\.?{_S})?(?:[A-Z][\w'-]*{_S}){{1,4}}?{STREET}\b)|(?P<box>(?:P\.?[ ]?O\.?{_S})Box{_S}\d+))"
    rf"(?P<unit>,?{_S}(?:(?:Apt|Apartment|Unit|Suite|Ste|Floor|Fl|Room|Rm)\.?{_S}\d+[A-Za-z]?|#[ ]?\d+[A-Za-z]?))?"
    rf"(?P<city>,{_S}[A-Z][\w'-]*(?:{_S}[A-Z][\w'-]*){{0,2}}?,?{_S}(?:[A-Z]{{2}}|[A-Z][a-z]+(?:{_S}[A-Z][a-z]+)?){_S}\d{{5}}(?:-\d{{4}})?)?",
    re.I,
)
_W = r"(?:[A-Za-zÀ-ÖØ-öø-ɏ]++|[^\W\d_]|['’-](?=[^\W\d_]))*"
RUN = re.compile(rf"[A-Z]{_W}(?:\.(?:[A-Z]\.)*)?(?:{GAP}(?![A-Z]{{2,3}}>)[A-Z]{_W}(?:\.(?:[A-Z]\.)*)?)*")
LOOSE = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*\.?(?:,? [^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*(?:\.(?:[A-Za-z]\.)*)?)*")
LOW = re.compile(r"(?<![\w@.-])(?=([a-z]{2,}(?:-[a-z]+)?)(,? )([a-z]{2,})(?![\w@-]))")
LOW_WORD = re.compile(r"[a-z]{2,}(?:-[a-z]+)?")  # every word that LOW can take, from its start
TOKEN = re.compile(rf"[^\W\d_]{_W}(?:\.(?:[A-Za-z]\.)*)?")
DIGITS = re.compile(r"\d+")
LED = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{1,3}[ -]?$")
BOX = re.compile(r"[Pp]\.?[ ]?[Oo]\b")
MARKS = re.compile(r"(?:\s{0,2}>|[A-Z]{2,3}> ?|\|(?= |$)|\t)*\s?")
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof"}
SUFFIXES = {"jr", "sr", "ii", "iii", "iv", "phd", "esq"}
CLOSING = re.compile(r"(?:thanks|thx|thank you|many thanks|best|kind|warm|regards|cheers|take care|sincerely|yours|all the best)\b", re.I)
GREET = re.compile(r"(?:hi|hey|hello|dear|good morning|good afternoon)\s+$", re.I)
SOME_NAME = frozenset("GSBU")
KINDS = ("email", "phone", "id_number", "address", "name")


def bit(word: str) -> int:
    return zlib.crc32(word.encode()) % BITS


class Words:
    """Word classes from hashed sets, bitmaps of ``BITS`` bits: given name, surname, ordinary word, common capitalised word.

    Of the known names that ``hidden`` takes, the class is "unknown", as of a name no sender bears; the fit sees texts both ways.
    """

    def __init__(self, given: bytes, surname: bytes, lower: bytes, common: bytes, hidden: float = 0.0, salt: int = 0):
        self.sets = (given, surname, lower, common)
        self.hidden, self.salt = int(hidden * 1000), str(salt).encode()
        self.short = {*FORMAL, *SHORTS}
        self.memo: dict[str, str] = {}
        self.runs: dict[str, tuple | None] = {}
        self.dull: set[str] = set()

    def __call__(self, token: str) -> str:
        c = self.memo.get(token)
        if c is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            c = self.memo[token] = self._of(token)
        return c

    def run(self, text: str) -> tuple[list[tuple[int, int]], list[str]] | None:
        """Token borders and classes of a run of words; None where no token may be of a name."""
        try:
            return self.runs[text]
        except KeyError:
            pass
        if len(self.runs) > 200_000:
            self.runs.clear()
        toks = [t.span() for t in TOKEN.finditer(text)]
        cls = [self(text[a:b]) for a, b in toks]
        got = self.runs[text] = None if SOME_NAME.isdisjoint(cls) else (toks, cls)
        return got

    def holds_surname(self, tokens: set[str]) -> bool:
        """May one of the words be a surname?"""
        for w in tokens - self.dull:
            if self(w) in "SB":
                return True
            if len(self.dull) > 300_000:
                self.dull.clear()
            self.dull.add(w)
        return False

    def _of(self, token: str) -> str:
        t = token.rstrip(".").lower()
        if len(t) == 1 and token[0].isalpha() or "." in t:
            return "I"
        if t in TITLES:
            return "T"
        if t in SUFFIXES:
            return "X"
        given, surname, lower, common = self.sets
        byte, mask = bit(t) >> 3, 1 << (bit(t) & 7)
        g, s, low = given[byte] & mask or t in self.short, surname[byte] & mask, lower[byte] & mask
        if s and low and not g:
            return "L"
        if g or s:
            if self.hidden and t not in self.short and zlib.crc32(self.salt + t.encode()) % 1000 < self.hidden:
                return "U"
            return "B" if g and s else "G" if g else "S"
        return "L" if low else "C" if common[byte] & mask else "U"


def digits_shape(x: str) -> str:
    x = re.sub(r"[ \n>]*(?:ext|x|extension)\.?[ \n>]*\d+$", "~", x)
    out = []
    for part in re.findall(r"\d+|[A-Z]+|[^\dA-Z]", re.sub(r"[ \n>]+", " ", x)):
        out.append(str(len(part)) if part[0].isdigit() else "A" * len(part) if part.isalpha() else part)
    return "".join(out)


ID_WORDS = {"number", "ssn", "passport", "no", "id", "licence", "license", "social", "insurance"}


class Cluster:
    """Overlapping candidates: (start, end, kind, features); ``whole``: addresses read to their last part and typed like one."""

    __slots__ = ("cands", "whole")

    def __init__(self):
        self.cands: list[tuple[int, int, str, tuple[str, ...]]] = []
        self.whole: dict[int, bool] = {}


def _before(text: str, s: int) -> str:
    m = re.search(r"([^\W\d_]+|[^\w\s])[\s>|]*$", text[max(0, s - 24) : s])
    return m[1].lower() if m else "^"


def _line(text: str, s: int, e: int, start_line: int) -> str:
    """What line a segment stands in: w whole line, g after a greeting, c after a closing phrase, h header, o other; k where the line before is a closing."""
    hi = text.find("\n", e)
    head = text[start_line:s]
    m = MARKS.match(head)
    head = head[m.end() :] if m else head
    tail = text[e : len(text) if hi < 0 else hi].strip()
    if not head.strip():
        if tail in ("", ",", ":", "-", "!", " -"):
            prev_hi = start_line - 1
            prev_lo = text.rfind("\n", 0, max(prev_hi, 0)) + 1
            prev = text[prev_lo : max(prev_hi, 0)]
            m = MARKS.match(prev)
            prev = prev[m.end() :] if m else prev
            return "k" if CLOSING.match(prev) and len(prev) < 40 else "w"
        return "s"
    if GREET.fullmatch(head) and tail in ("", ",", ":", "-", "!"):
        return "g"
    if CLOSING.match(head) and len(head) < 30 and not tail:
        return "c"
    if re.match(r"(?:From|To|cc|Cc|Sent|Subject|Von|An|De|Para): ", head):
        return "h"
    return "o"


def clusters(text: str, words: Words, loose: bool = False) -> list[Cluster]:
    """All clusters of a text in order. ``loose`` also reads names in small letters (for the sender field)."""
    return [c for _, _, g in groups(text, words, loose) if (c := build(text, g)).cands]


def groups(text: str, words: Words, loose: bool = False) -> list[tuple[int, int, list]]:
    """(start, end, overlapping regions) in order."""
    regions: list[tuple[int, int, str, object]] = []
    if SPELT.search(text) or "@" in text and AT_HOST.search(text):
        regions += [(m.start(), m.end(), "e", m) for m in EMAIL.finditer(text)]
    else:
        end, at = 0, text.find("@")
        while at >= 0:
            s = at
            while s > end and (text[s - 1] in "+.-_" or text[s - 1].isalnum()):
                s -= 1
            if m := EMAIL.match(text, s):
                end = m.end()
                regions.append((s, end, "e", m))
            at = text.find("@", max(at + 1, end))
    digits = [m.start() for m in DIGITS.finditer(text)]
    if digits:
        end = 0
        for p in digits:
            if p < end:
                continue
            m = None
            if led := LED.search(text, max(0, p - 4), p):
                m = NUMBER.match(text, led.start())
            if m is None:
                q = p - (text[p - 1 : p] == "(")
                m = NUMBER.match(text, q - (text[q - 1 : q] == "+"))
            if m:
                end = m.end()
                if sum(map(str.isdigit, m[0])) >= (6 if m[0][0].isalpha() else 7):
                    regions.append((m.start(), end, "n", m))
        end = 0
        for p in sorted([*digits, *(b.start() for b in BOX.finditer(text))]):
            if p >= end and (m := ADDRESS.match(text, p)):
                end = m.end()
                regions.append((m.start(), end, "a", m))
    for m in (LOOSE if loose else RUN).finditer(text):
        s, e = m.span()
        if not loose and s and (text[s - 1] in "@._" or text[s - 1].isalnum()):
            # a run that goes on from a word or an address: what is left of it after its first word
            m = RUN.search(text, TOKEN.match(text, s).end(), e)
            if not m or text[m.start() - 1] in "@._" or text[m.start() - 1].isalnum():
                continue
        if read := words.run(m[0]):
            s = m.start()
            regions.append((s, m.end(), "r", ([(a + s, b + s) for a, b in read[0]], read[1])))
    # names typed in small letters: looked for only where a surname stands so
    if not loose and words.holds_surname(set(LOW_WORD.findall(text))):
        for m in LOW.finditer(text):
            a, b = words(m[1]), words(m[3])
            if (a in "GB" and b in "SB") or (a in "SB" and b in "GB"):
                s = m.start()
                regions.append((s, m.end(3), "r", ([(s, m.end(1)), (m.start(3), m.end(3))], [a, b])))
    if not regions:
        return []
    regions.sort(key=lambda r: r[:2])
    out: list[tuple[int, int, list]] = []
    group: list = []
    end = -1
    for r in regions:
        if r[0] >= end and group:
            out.append((group[0][0], end, group))
            group = []
        group.append(r)
        end = max(end, r[1])
    out.append((group[0][0], end, group))
    return out


def surroundings(text: str, s: int, e: int) -> tuple[int, int]:
    """The stretch that the features of a cluster can see: from the line before (24 characters at least) to the end of the last line."""
    a = text.rfind("\n", 0, s)
    a = text.rfind("\n", 0, a) + 1 if a > 0 else 0
    b = text.find("\n", e)
    return min(a, max(0, s - 24)), (len(text) if b < 0 else b)


def build(text: str, group: list) -> Cluster:
    """The candidates of one group of regions and their features."""
    c = Cluster()
    for s, e, kind, m in group:
        prev = _before(text, s)
        if kind == "e":
            while e > s and text[e - 1] in ".-":
                e -= 1
            c.cands.append((s, e, "email", ("e:shape=" + ("@" if "@" in m[0] else "spelt"), "e:prev=" + prev, "e:bias")))
        elif kind == "n":
            value = m[0]
            while value and value[-1] in "./-+( \n>":
                value = value[:-1]
            e = s + len(value)
            shape = digits_shape(value)
            n = sum(map(str.isdigit, value))
            mixed = re.search(r"\S*$", text[max(0, s - 12) : s].rstrip())[0]
            mixed = any(ch.isdigit() for ch in mixed) and any(ch.isalpha() for ch in mixed)  # a code goes on before it
            if prev == "." and re.search(r"\bno\.\s*$", text[max(0, s - 6) : s]):
                prev = "no."
            for k in ("phone", "id_number"):
                c.cands.append((s, e, k, (f"{k}:shape={shape}", f"{k}:prev={prev}", f"{k}:n={n}", f"{k}:mixed={mixed}", f"{k}:bias", f"{k}:{shape}|{prev in ID_WORDS or prev == 'no.'}")))
        elif kind == "a":
            ends = [(m.end(part), part) for part in ("street", "box", "unit", "city") if m[part]]
            low = m[0].split(" ", 1)[-1][:1].islower()
            for x, part in ends:
                last = x == ends[-1][0]
                c.whole[len(c.cands)] = last and (not low or bool(m["box"]))
                c.cands.append((s, x, "address", (f"a:upto={part}", f"a:open={'box' if m['box'] else 'street'}", f"a:more={not last}", "a:bias", f"a:caps={text[s:x].upper() == text[s:x]}", f"a:low={low}")))
        else:
            _names(text, m[0], m[1], c)
    return c


def _names(text: str, toks: list[tuple[int, int]], cls: list[str], c: Cluster) -> None:
    n = len(toks)
    for i in range(n):
        if cls[i] in "LCX" or cls[i] == "T" and i + 1 >= n:
            continue
        sig = ""
        start_line = text.rfind("\n", 0, toks[i][0]) + 1
        for j in range(i, min(n, i + 5)):
            k = cls[j]
            if j > i:
                gap = text[toks[j - 1][1] : toks[j][0]]
                before = text[toks[j - 1][0] : toks[j - 1][1]]
                if before.endswith(".") and cls[j - 1] not in "ITX":
                    break  # a full stop ends a name
                sig += ", " if gap.startswith(",") else " "
            if k in "LC" and j > i:
                break
            sig += k
            if k in "LC":
                break
            if not any(x in "GSB" for x in cls[i : j + 1]) or k == "T" and j + 1 > i + 1 and j + 1 >= n:
                continue
            s, e = toks[i][0], toks[j][1]
            if text[e - 1] == "." and k not in "IX":
                e -= 1
            line = _line(text, s, e, start_line)
            across = "\n" in text[s:e]
            long_line = across and text.index("\n", s) - start_line > 38
            prev = _before(text, s)
            nxt = text[e : e + 1] or "$"
            # the next word would belong to the name
            grows = j + 1 < n and cls[j + 1] in "SBGUX" and text[toks[j][1] : toks[j + 1][0]] in (" ", "  ")
            c.cands.append((s, e, "name", (f"n:sig={sig}", f"n:sig={sig}|{line}", f"n:line={line}", f"n:prev={prev}", f"n:next={nxt if not nxt.isalnum() else 'w'}", f"n:across={across}|{long_line}", f"n:grows={grows}", f"n:len={j - i + 1}", "n:bias")))


def score(feats: tuple[str, ...], weights: dict[str, float]) -> float:
    get = weights.get
    return sum(get(f, 0.0) for f in feats)


class Scores(dict):
    """features -> score; equal feature lists are summed once."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, feats: tuple[str, ...]) -> float:
        if len(self) > 200_000:
            self.clear()
        v = self[feats] = score(feats, self.weights)
        return v


def decode(c: Cluster, weights: dict[str, float] | Scores) -> list[tuple[int, int, str]]:
    """The best set of segments that do not overlap: Viterbi over the segment borders."""
    of = weights if isinstance(weights, Scores) else Scores(weights)
    if len(c.cands) == 1:
        s, e, k, f = c.cands[0]
        return [(s, e, k)] if of[f] > 0 else []
    borders = sorted({x for s, e, _, _ in c.cands for x in (s, e)})
    at = {b: i for i, b in enumerate(borders)}
    by_end: dict[int, list] = {}
    for s, e, k, f in c.cands:
        w = of[f]
        if w > 0:
            by_end.setdefault(e, []).append((w, s, k))
    best, back = [0.0] * len(borders), [None] * len(borders)
    for i in range(1, len(borders)):
        best[i] = best[i - 1]
        for w, s, k in by_end.get(borders[i], ()):
            v = best[at[s]] + w
            if v > best[i] + 1e-9:
                best[i], back[i] = v, (s, k)
    out, i = [], len(borders) - 1
    while i > 0:
        if back[i] is None:
            i -= 1
        else:
            s, k = back[i]
            out.append((s, borders[i], k))
            i = at[s]
    return out[::-1]


def _lse(a: float, b: float) -> float:
    m = a if a > b else b
    return m if m == -math.inf else m + math.log(math.exp(a - m) + math.exp(b - m))


def marginals(c: Cluster, weights: dict[str, float]) -> list[float]:
    """Probability of each candidate under the model: forward and backward sums over the borders."""
    borders = sorted({x for s, e, _, _ in c.cands for x in (s, e)})
    ws = [max(-30.0, min(30.0, score(f, weights))) for _, _, _, f in c.cands]
    st = [bisect_left(borders, s) for s, _, _, _ in c.cands]
    en = [bisect_left(borders, e) for _, e, _, _ in c.cands]
    n = len(borders)
    ends: list[list[int]] = [[] for _ in range(n)]
    starts: list[list[int]] = [[] for _ in range(n)]
    for i in range(len(ws)):
        ends[en[i]].append(i)
        starts[st[i]].append(i)
    a, b = [0.0] * n, [0.0] * n
    for j in range(1, n):
        v = a[j - 1]
        for i in ends[j]:
            v = _lse(v, a[st[i]] + ws[i])
        a[j] = v
    for j in range(n - 2, -1, -1):
        v = b[j + 1]
        for i in starts[j]:
            v = _lse(v, b[en[i]] + ws[i])
        b[j] = v
    z = a[-1]
    return [math.exp(min(0.0, a[st[i]] + ws[i] + b[en[i]] - z)) for i in range(len(ws))]


def train(data: list[tuple[Cluster, list[bool]]], epochs: int = 5, rate: float = 0.5) -> dict[str, float]:
    """Weights by AdaGrad on the log-likelihood of labelled clusters."""
    w: dict[str, float] = {}
    g2: dict[str, float] = {}
    for _ in range(epochs):
        for c, gold in data:
            p = marginals(c, w)
            for (_, _, _, f), y, q in zip(c.cands, gold, p):
                d = (1.0 if y else 0.0) - q
                if abs(d) < 1e-3:
                    continue
                for x in f:
                    h = g2[x] = g2.get(x, 1e-3) + d * d
                    w[x] = w.get(x, 0.0) * 0.9999 + rate * d / math.sqrt(h)
    return w
