"""Reading the lines of one mail body: what each line looks like, its sentences, and which lines go once the evidence is in.

Pure functions over one body; :mod:`lettermill.llm.quoted` gathers the evidence across mails.  A line gets a one-letter code:

``b`` blank, ``s`` separator of a passed-on mail, ``u`` attribution whose quote has no marks, ``a`` other attribution, ``m`` first half of one, ``h`` header line,
``n`` header block that opens with a name and a node, ``q`` marked with ``>`` or initials, ``p`` marked with a bar, ``t`` indented by a tab,
``r`` rule line, ``d`` signature delimiter, ``x`` box edge, ``f`` full name alone (``F``: the sender's own), ``k`` notice, device or
print line, ``w`` line with one word of notices, ``l`` short line that ends in a colon, ``g`` greeting, ``c`` closing phrase, ``i`` given name alone or a contact line, ``o`` anything else.
"""

from __future__ import annotations

import re

DATE = r"(?:\w{2,4}\.?,? )?\d{1,2}(?:[./-]\d{1,2}[./-]| [A-Za-z]{3,9}\.? )\d{2,4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4}|\d{4}-\d\d-\d\d"
VERB = r"(?:wrote|writes|schrieb|escribió|a écrit|ha scritto|skrev|said)"
ADDRESS = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
SEPARATOR = re.compile(r"\s*-{2,} ?(?:Original (?:Message|Appointment|Mail)|Forwarded (?:message|by\b.*?)|Weitergeleitete Nachricht|Ursprüngliche Nachricht|Message d'origine|Mensaje original)\s*-{2,}\s*$|Begin forwarded message:\s*$", re.I)
INTRO = r"(?:Your|My|His|Her|Their|The|Earlier|Previous|Original|Last|Older|Quoted) (?:earlier |last |previous |original )?(?:message|note|mail|e-?mail|letter|text)s?(?: said| says| read| was)?:?|[A-Z][\w'-]+(?: [A-Z][\w.'-]*){1,3} said:"
UNMARKED = re.compile(rf"-{{2,}} ?\S.{{0,80}}<{ADDRESS}>\s+{VERB} ?:\s*$|You wrote:\s*$|(?:{INTRO})\s*$")
ATTRIBUTION = re.compile(
    rf"(?:(?:On|Am|Le|El|Il|Den)\s.{{0,12}}(?:{DATE}).{{0,140}}{VERB}.{{0,60}}:|.{{2,80}}<{ADDRESS}>\s+{VERB} ?:|[^.;:]{{2,60}}\s{VERB} on\s.{{0,8}}(?:{DATE}).{{0,12}}:|[A-Z][\w'-]+(?: [A-Z][\w.'-]*){{1,3}} on \w{{3}}, (?:{DATE}) \d\d:\d\d)\s*$"
)
HALF = re.compile(rf"(?:On|Am|Le|El|Il)\s.{{0,12}}(?:{DATE}),? \d\d?:\d\d(?:,? [A-Z][^.;:?!]{{2,50}})?\s*$")
REST = re.compile(rf"<{ADDRESS}>\s+{VERB} ?:\s*$")
HEADER = re.compile(r"\t?(?:From|Sent|To|cc|Cc|CC|Bcc|bcc|Subject|Date|Von|Gesendet|An|Betreff|De|Para|Asunto):(?:\s|$)")
FROM_VALUE = re.compile(rf"\t?(?:From|Von|De):\s+(?:\"?[A-Z][\w.'-]*,? (?:[\w.'-]+,? ?){{0,3}}\"?(?:<{ADDRESS}>)?|{ADDRESS}|\S+/\S+/\S+)\s*$")
NODE = re.compile(r"[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3}@[A-Z]{2,}\s*$")
CLOCK = re.compile(r"\s*\d\d?/\d\d?/\d{2,4}\s+\d\d?:\d\d(?: ?[AP]M)?\s*$")
MARKED = re.compile(r"\s{0,2}>|[A-Z]{2,3}> ?")
RULE = re.compile(r"\s*(?:\*{6,}|_{6,}|={6,}|-{6,}|~{6,}|#{6,})\s*$")
DELIMITER = re.compile(r"-{2,3} ?$")
EDGE = re.compile(r"\s*\+-{5,}\+?\s*$")
FULL_NAME = re.compile(r"(?:\| )?(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? )?[A-Z][a-zà-ÿ'-]+(?: [A-Z]\.?)? [A-Z][\w'-]{2,}(?:,? (?:Jr|Sr|II|III|PhD|Esq)\.?)?(?:\s*\|.*)?\s*$")
NOTICE = re.compile(
    r"confidential|vertraulich|confidentiel|privileged|addressee|intended recipient|lawful purposes|named in it|accepts no liability|for viruses|tell the sender|"
    r"reached you (?:by mistake|in error)|no contract is formed|opinions are those|empfänger|before printing|consider the environment|unsubscribe|"
    r"delete (?:it|this)\b|disclaimer|löschen sie|destinataire|monitors mail|notify the sender|is prohibited|attachments"
)
#: a plain part of each alternative of NOTICE, to look for first
NOTICE_PARTS = (
    "confiden", "vertraulich", "privileged", "addressee", "intended recip", "lawful", "named in it", "accepts no", "for viruses", "the sender", "reached you", "no contract", "opinions are",
    "empfänger", "before printing", "the environment", "unsubscribe", "delete ", "disclaimer", "löschen sie", "destinataire", "monitors mail", "is prohibited", "attachments",
)
DEVICE = re.compile(r"(?:Sent (?:from|via|by) (?:my|a|an|the) .{2,60}|Get the .{2,40}(?:app|mail) for .{2,40}|Envoyé de mon .{2,40}|Gesendet von meinem .{2,40}|Enviado desde mi .{2,40}|Please think of the trees.*|Please consider the environment.*)$", re.I)
CLOSING = re.compile(r"(?:thanks|thx|thank you|many thanks|best|kind|warm|regards|cheers|take care|sincerely|yours|all the best|with|talk soon|viele|mit|cordialement|saludos)\b.{0,40}$", re.I)
GREETING = re.compile(r"(?:(?i:hi|hey|hello|dear|good morning|good afternoon)\b.{0,40}|[A-Z][a-zà-ÿ'-]+)\s*[,:!-]?\s*$")
GIVEN = re.compile(r"[A-Z][a-zà-ÿ'-]+\.?\s*$")
CONTACT = re.compile(rf"\s*(?:\| ?)?(?:(?:tel|phone|ph|fax|cell|mobile|office)\b[.:]? ?)?\+?[\d(][\d ()/.+-]{{6,}}(?: ?(?:ext|x)\.? ?\d+)?\s*$|\s*{ADDRESS}\s*$", re.I)
END = re.compile(r"[.?!][\"')]*(?:\s+|$)")
NEEDS_MORE = re.compile(r"(?:On|Am|Le|El) .{0,12}\d|-{2,} ?\S")


def split_lines(body: str) -> list[str]:
    return [x.rstrip("\r") for x in body.split("\n")]


def _plain(line: str, i: int, lines: list[str]) -> str:
    c = line[0]
    if c == "\t":
        return "t"
    if c == "|" and (len(line) == 1 or line[1] in " |"):
        return "p"
    if (c in "> " or (c.isupper() and ">" in line[1:4])) and MARKED.match(line):
        return "q"
    if c in "-+*_=~# ":
        if SEPARATOR.match(line):
            return "s"
        if DELIMITER.match(line):
            return "d"
        if EDGE.match(line):
            return "x"
        if RULE.match(line):
            return "r"
    last = line.rstrip()[-1]
    if c == "B" and SEPARATOR.match(line):
        return "s"
    if last == ":":
        if UNMARKED.match(line):
            return "u"
        if ATTRIBUTION.match(line) or c == "<" and REST.match(line):
            return "a"
    elif last.isdigit() and ATTRIBUTION.match(line):
        return "a"
    if HEADER.match(line):
        return "h"
    if c in "OALEI" and last not in ":.?!" and HALF.match(line):
        return "m"
    if last.isupper() and "@" in line and NODE.match(line) and i + 1 < len(lines) and CLOCK.match(lines[i + 1]):
        return "n"
    if c.isupper() and UNMARKED.match(line):
        return "u"
    if last not in ".?!;":
        if CONTACT.match(line):
            return "i"
        if FULL_NAME.match(line):
            return "g" if GREETING.match(line) and line.split(" ", 1)[0].lower() in ("hi", "hey", "hello", "dear") else "c" if CLOSING.match(line) else "f"
        if CLOSING.match(line):
            return "c"
        if GREETING.match(line):
            return "g"
    low = line.lower()
    words = set(NOTICE.findall(low)) if any(map(low.__contains__, NOTICE_PARTS)) else ()
    if len(words) > 1 or DEVICE.match(line):
        return "k"
    if words:
        return "w"
    return "l" if last == ":" and " " in line else "o"


def codes(lines: list[str]) -> str:
    """One letter for each line."""
    out = []
    n = len(lines)
    i = 0
    while i < n:
        line = lines[i]
        if not line or line.isspace():
            out.append("b")
            i += 1
            continue
        k = _plain(line, i, lines)
        if k in "oghflm" and i + 1 < n and line[0] in "OALE-" and NEEDS_MORE.match(line) and lines[i + 1]:
            # an attribution may be wrapped onto a second line
            both = line.rstrip() + " " + lines[i + 1].strip()
            two = "u" if UNMARKED.match(both) else "a" if ATTRIBUTION.match(both) else ""
            if two:
                out += [two, two]
                i += 2
                continue
        out.append(k)
        i += 1
    return "".join(out)


QUOTE_PREFIX = re.compile(r"(?:\s{0,2}>|[A-Z]{2,3}> ?|\|(?= |\||$)|\t)+\s?")


def sentences(lines: list[str], code: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each sentence, quote marks taken off. Headers, separators and rules end a sentence and are none."""
    out: list[tuple[int, int, str]] = []
    text: list[str] = []
    first = last = -1
    for i, k in enumerate(code):
        if k in "bsuamhnrdx":
            if text:
                out.append((first, last, " ".join(text)))
                text = []
            continue
        line = lines[i]
        if k in "qpt":
            line = QUOTE_PREFIX.sub("", line, count=1)
            if not line or HEADER.match(line) or SEPARATOR.match(line):
                if text:
                    out.append((first, last, " ".join(text)))
                    text = []
                continue
        short = k in "fgckil" or len(line) < 25 and not text
        at = 0
        for m in END.finditer(line):
            piece = line[at : m.end()].strip()
            if not text:
                first = i
            if piece:
                text.append(piece)
                out.append((first, i, " ".join(text)))
                text = []
            at = m.end()
        rest = line[at:].strip()
        if rest:
            if not text:
                first = i
            text.append(rest)
            last = i
        if short and text:
            out.append((first, i, " ".join(text)))
            text = []
        last = i
    if text:
        out.append((first, last, " ".join(text)))
    return out


def own_name(line: str, sender: str) -> bool:
    """Does a name line share a name of some length with the sender as typed?"""
    s = sender.lower()
    return any(len(w) >= 4 and w in s for w in re.findall(r"[a-z]+", line.lower()))


def sender_marks(lines: list[str], code: str, sender: str) -> str:
    """``code`` with ``f`` turned to ``F`` where the full name is the sender's own."""
    if "f" not in code or not sender:
        return code
    return "".join("F" if k == "f" and own_name(lines[i], sender) else k for i, k in enumerate(code))


def _quoted(code: str, hit: list[int], boiler: list[bool]) -> tuple[list[bool], int]:
    """Lines of repeated and passed-on mails by marks and evidence; where an unmarked quote begins that runs to the end."""
    n = len(code)
    gone = [False] * n
    lead = [k == "l" for k in code]
    code = code.replace("l", "o")
    end = n
    i = 0
    seen_a = False
    while i < n:
        k = code[i]
        if k in "sun":
            end = i
            break
        if k == "h":
            j = i
            while j < n and code[j] == "h":
                j += 1
            if j - i >= 3 or (j - i == 2 and any(hit[j:])):
                end = i
                break
            i = j
            continue
        if k == "a":
            j = i
            while j < n and code[j] == "a":
                j += 1
            m = j
            while m < n and code[m] == "b":
                m += 1
            for x in range(i, j):
                gone[x] = True
            seen_a = True
            if m < n and code[m] not in "qpt":
                end = i
                break
            i = j
            continue
        if k == "m":
            gone[i] = True
        if k in "qpt":
            j, marked = i, 0
            while j < n and code[j] in "qptb":
                marked += code[j] != "b"
                j += 1
            box = i > 0 and code[i - 1] == "x" and k == "p"
            if seen_a or box or marked >= 2 or any(hit[i:j]):
                for x in range(i, j):
                    gone[x] = True
            i = j
            continue
        i += 1
    # a line that many mails use to lead over to the rest, at the head of a paragraph, introduces a quote
    for x in range(1, end - 1):
        if boiler[x] and code[x] == "o" and code[x - 1] == "b" and code[x + 1] not in "birdxfFkwc" and not gone[x]:
            end = x
            break
    # evidence in unmarked lines: a run of inherited lines that holds a long sentence; a short line that leads over to it opens a quote to the end
    x = 0
    while x < end:
        if not hit[x] or gone[x] or code[x] == "b":
            x += 1
            continue
        y, top, stop = x, hit[x], x + 1
        while y < end and not gone[y] and (hit[y] or code[y] == "b"):
            if hit[y]:
                top, stop = max(top, hit[y]), y + 1
            y += 1
        if top > 1:
            z = x - 1
            while z >= 0 and code[z] == "b":
                z -= 1
            if z >= 0 and lead[z] and not gone[z] and (z == 0 or code[z - 1] == "b"):
                end = z
                break
            for w in range(x, stop):
                gone[w] = code[w] != "b"
        x = max(stop, x + 1)
    for x in range(end, n):
        gone[x] = True
    return gone, end


def _tail(code: str, boiler: list[bool], gone: list[bool], lo: int, hi: int) -> None:
    """Marks the signature and the notices at the end of the unmarked region ``lo..hi``."""
    paras: list[tuple[int, int]] = []
    i = lo
    while i < hi:
        if code[i] == "b":
            i += 1
            continue
        j = i
        while j < hi and code[j] != "b":
            j += 1
        paras.append((i, j))
        i = j
    for a, b in reversed(paras):
        body = range(a, b)
        text = [x for x in body if code[x] not in "rdx"]
        if not text:
            for x in body:
                gone[x] = True
            continue
        strong = any(code[x] == "k" for x in text)
        rules = any(code[x] == "r" for x in body)
        if strong or any(code[x] == "w" and (rules or boiler[x]) for x in text):
            start = next(x for x in body if code[x] in "rkw")
            for x in range(start, b):
                gone[x] = True
            if start == a:
                continue
            break
        if all(boiler[x] for x in text) and not any(code[x] in "gc" for x in text):
            for x in body:
                gone[x] = True
            continue
        # a signature: from a delimiter, a box edge or a full name to the end of the paragraph
        start = -1
        for x in body:
            if code[x] in "dx" or (code[x] == "F" and b - x <= 9) or (code[x] == "f" and b - x <= 9 and (b - x >= 3 or boiler[x])):
                start = x
                break
        if start >= 0:
            for x in range(start, b):
                gone[x] = True
            if start == a:
                continue
        break


def removed(code: str, hit: list[int], boiler: list[bool]) -> list[int]:
    """Numbers, from one, of the lines to remove; blank lines are never listed."""
    gone, end = _quoted(code, hit, boiler)
    code = code.replace("l", "o")
    n = len(code)
    i = 0
    while i < end:
        if gone[i]:
            i += 1
            continue
        j = i
        while j < end and not gone[j]:
            j += 1
        _tail(code, boiler, gone, i, j)
        i = j
    return [x + 1 for x in range(n) if gone[x] and code[x] != "b"]
