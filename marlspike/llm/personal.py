"""Personal data in free text, found by a semi-Markov conditional random field and replaced by typed placeholders.

The field scores whole spans: a candidate span has features of all of it (shape,
pattern of word classes, length, parts) and of the words beside it; dynamic
programming over the candidates' boundaries, whose lengths are bounded per type,
chooses boundaries and types of all spans of a text at once. The weights are
fitted here, by the gradient of the conditional likelihood, on ``SENTENCES``
generated sentences (a documented bound) of invented people, numbers, places and
look-alikes. Given names and surnames are told by a lexicon, which the caller
takes from the user table: up to ``LEXICON`` words a list go to the workers, beyond
that every text gets the words of its own by a join, with the same result. Names
that no lexicon knows are candidates behind a title or a word that introduces a
name, by their capitals and initials; their context decides.

Defined cases: null and blank texts come out as they are; texts of any length are
read whole; texts without personal data come out unchanged with no types; repeated
rows count once; a missing lexicon leaves shape and context.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
SENTENCES = 4800
LEXICON = 100_000
#: code points that a span of a type may have
LONGEST = {"email": 120, "phone": 90, "id_number": 40, "address": 140, "name": 60}

TITLES = frozenset("mr ms mrs miss dr prof professor engr atty sir maam ma'am fr rev hon gng bb g dean doc".split())
PARTICLES = frozenset("de del dela delos delas la los san santa sta sto van von di".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
THINGS = frozenset(
    "hall building bldg library gymnasium gym pavilion annex wing auditorium center centre laboratory lab room chapel court field theater theatre dormitory dorm house medal award prize "
    "grant scholarship fund cup trophy scholars fellowship chair lecture memorial street st avenue ave road rd drive extension ext subdivision subd village apartments apartment compound "
    "park plaza bridge side gate tower office clinic college school university foundation studio hub stadium museum gallery garden bazaar exhibit lot grove".split()
)
STREET = r"(?:street|st\b\.?|avenue|ave\b\.?|road|rd\b\.?|drive|dr\b\.?|lane|extension|ext\b\.?|boulevard|blvd\b\.?|subdivision|subd\b\.?|village|vill\b\.?|compound|apartments?|apts?\b\.?|homes|heights|highway|hwy\b\.?|alley|kalye|daan|residences?|towers?|condominium)"
DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|sero|isa|dalawa|tatlo|apat|lima|anim|pito|walo|siyam)"

EMAIL = re.compile(
    r"[\w.+%-]+(?:\s?@\s?|\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\s(?:at|AT)\s)[\w-]+(?:(?:\s?\.\s?(?=[a-z]{2})|\.|\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)[\w-]+)+", re.I
)
SPELLED = re.compile(rf"\b{DIGIT}(?:[\s,-]+{DIGIT}){{5,}}\b", re.I)
NUMBER = re.compile(
    r"(?<![\w.@/-])(?:(?:P|PHP|Php)\s?|₱\s?)?(?:\b(?:PSN|TIN|SSS|GSIS|UMID|LRN|CRN|PRC|passport|PhilHealth|Pag-?IBIG|PhilSys|licen[cs]e|voter[’']?s? ID)\b[\s:#]*(?:no\.?\s*)?)?"
    r"(?:[A-Z]{1,3}-?)?[+(]{0,2}\d(?:[\d()]|[ .-](?=[\d(]))*\d\)?(?:-?[A-Z]{1,2}\b)?(?:,?\s?(?:loc(?:al)?|ext)\b\.?\s?\d{1,5})?(?![\w])", re.I
)
ADDRESS = re.compile(
    r"(?<![\w/:.,-])(?:(?:#|no\.?\s?|house\s(?:no\.?\s?|number\s|#\s?)?|unit\s(?:no\.?\s?)?|blk\.?\s?|block\s|lot\s|purok\s|phase\s|room\s|window\s|sitio\s)#?\s?)*#?\d{1,4}(?:-?[A-Za-z])?\b"
    r"(?:,?\s+(?:lot|blk\.?|block|phase|unit|purok)\s?\d{1,4}[A-Za-z]?\b)*", re.I
)
POSSESSIVE = re.compile(r"['’]s$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*\.?|\d+|[^\w\s]")


class Span:
    __slots__ = ("start", "end", "label", "features")

    def __init__(self, start: int, end: int, label: str, features: list[str]):
        self.start, self.end, self.label, self.features = start, end, label, features


def _beside(text: str, start: int, end: int) -> list[str]:
    left = re.findall(r"[^\W_]+|[^\w\s]", text[max(0, start - 48) : start].lower())[-3:]
    right = re.findall(r"[^\W_]+|[^\w\s]", text[end : end + 24].lower())[:1]
    left = [re.sub(r"\d+", "9", x) for x in left]
    return [f"l1={left[-1] if left else '^'}", *(f"l={x}" for x in set(left)), f"r1={re.sub(r'[0-9]+', '9', right[0]) if right else '$'}"]


def _number_features(s: str) -> list[str]:
    digits = re.sub(r"\D", "", s)
    shape = re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", re.sub(r"(?i),?\s?(?:loc(?:al)?|ext)\b.*$", " loc", s)))
    prefix = re.match(r"[A-Za-z-]+", s)
    out = [f"shape={shape}", f"n={len(digits)}"]
    if prefix:
        out.append(f"pre={prefix.group().lower()}")
    if re.match(r"\+?63[ -]?9|\(?09|\(?0\d\d\)?[ .-]", s) and 10 <= len(re.sub(r"\D", "", shape.split(" loc")[0].replace("9", "9"))) or re.match(r"\(?\+?63\b|\(?0\d{2,3}\)?", s):
        out.append(f"dial{min(len(digits), 13)}")
    if " loc" in shape:
        out.append("loc")
    if re.match(r"\(?(?:\+?63|0)", s) and 9 <= len(digits) <= 15:
        out.append("begins as a phone")
    if re.search(r"₱|PHP|Php", s):
        out.append("money")
    if re.fullmatch(r"(?:19|20)\d\d-(?:19|20)\d\d", s):
        out.append("years")
    if re.fullmatch(r"\d{1,2}([-./])\d{1,2}\1(?:19|20)\d\d|(?:19|20)\d\d([-./])\d{1,2}\2\d{1,2}", s):
        out.append("date")
    if re.match(r"97[89]-", s):
        out.append("book")
    if re.fullmatch(r"\d+", s):
        out.append("bare")
    return out


def _classes(words: list[str], given: frozenset, surname: frozenset, at: int) -> str:
    out = []
    for i, w in enumerate(words):
        base = POSSESSIVE.sub("", w.rstrip(".")).lower()
        if base in TITLES and (w[0].isupper() or base != "g"):
            c = "I" if len(base) == 1 and w.endswith(".") else "T"
        elif base in SUFFIXES and i == len(words) - 1 and i:
            c = "J"
        elif len(base) == 1 and w[0].isupper():
            c = "I"
        elif base == "ma" and w.endswith("."):
            c = "M"
        elif w == ",":
            c = ","
        elif base in given and base in surname:
            c = "S" if i else "G"
        elif base in given:
            c = "G"
        elif base in surname:
            c = "S"
        elif base in PARTICLES:
            c = "P"
        elif w[0].isupper() and w[0].isalpha() and (not w.isupper() or "T" in out):
            c = "C"
        else:
            c = "x"
        out.append(c)
    return re.sub(r"P+(?=[SC])", "", "".join(out))


def candidates(text: str, given: frozenset, surname: frozenset) -> list[Span]:
    """All spans that may be an entity, with each label that they may have."""
    out: list[Span] = []
    emails = []
    if "@" in text or re.search(r"\bat\b|\(at|\[at|\{at", text, re.I):
        for m in EMAIL.finditer(text):
            s = m.group()
            if not re.search(r"@|[(\[{<]\s?at|\sat\s.*\sdot\s|\sat\s.*\.[a-z]{2,}", s, re.I):
                continue
            dots = len(re.findall(r"\.\w|\bdot\b", s.split("@")[-1] if "@" in s else s, re.I))
            f = ["email", f"dots={min(dots, 4)}", "sign" if "@" in s else "words", *_beside(text, m.start(), m.end())]
            if re.search(r"@\s?\d", s):
                f.append("at a time")
            out.append(Span(m.start(), m.end(), "email", f))
            emails.append((m.start(), m.end()))
    for m in SPELLED.finditer(text):
        n = len(re.findall(DIGIT, m.group(), re.I))
        out.append(Span(m.start(), m.end(), "phone", ["spelled", f"spelled{min(n, 12)}", *_beside(text, m.start(), m.end())]))
    numbers = any(c.isdigit() for c in text)
    if numbers:
        for m in NUMBER.finditer(text):
            s = m.group().strip()
            digits = sum(c.isdigit() for c in s)
            if digits < 5 or any(a <= m.start() < b for a, b in emails):
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            if re.fullmatch(r"\([^()]*\)", s):
                s, start = s[1:-1], start + 1
            elif s[0] == "(" and s.count("(") > s.count(")"):
                s, start = s[1:], start + 1
            elif s[-1] == ")" and s.count(")") > s.count("("):
                s = s[:-1]
            f = _number_features(s) + _beside(text, start, start + len(s))
            for label in ("phone", "id_number"):
                out.append(Span(start, start + len(s), label, [f"{label}:{x}" for x in f]))
        for m in ADDRESS.finditer(text):
            rest = text[m.end() : m.end() + 110]
            for end in _address_ends(rest):
                s = text[m.start() : m.end() + end]
                out.append(Span(m.start(), m.end() + end, "address", _address_features(s, m.group()) + [f"address:{x}" for x in _beside(text, m.start(), m.end() + end)[:1]]))
    out += _names(text, given, surname, emails)
    out += _open_names(text, given, surname, emails)
    return [s for s in out if s.end - s.start <= LONGEST[s.label]]


def _address_ends(rest: str) -> list[int]:
    """Where an address that began may end: after each of its parts."""
    ends = [0]
    part = re.compile(r",?\s+(?:(?:brgy|barangay|bgy)\b\.?\s+)?(?:[^\W\d_][\w'’-]*\.?(?:\s+|(?=,|$))?){1,4}(?:\s?\d{4}\b)?", re.I)
    at = 0
    for _ in range(5):
        m = part.match(rest, at)
        if not m or re.search(r"[.!?]\s+[A-Z]", rest[at : m.end()].rstrip()) and not re.search(STREET + r"\s|brgy\.", rest[at : m.end()], re.I):
            if not m:
                break
        at = m.end()
        stop = len(rest[:at].rstrip(" .,"))
        if stop > ends[-1]:
            ends.append(stop)
        if re.search(r"[.!?\n]\s*$", rest[:at]) and not re.search(r"(?:st|ave|rd|dr|subd|brgy|ext|apt|blvd|vill)\.\s*$", rest[:at], re.I):
            break
    return ends


def _address_features(s: str, head: str) -> list[str]:
    low = s.lower()
    trigger = re.match(r"[#a-z]+", head.lower().strip())
    f = ["address", f"trigger={trigger.group() if trigger else 'number'}", f"parts={min(low.count(','), 4)}"]
    if re.search(rf"\b{STREET}", low):
        f.append("street")
        if not trigger and re.match(rf"\d{{1,4}}(?:-?[a-z])?\s+(?:[^\W\d_]+[- ]){{0,3}}?[^\W\d_]+\s+{STREET}", low):
            f.append("number and street")
    if re.search(r"\b(?:brgy|barangay|bgy|purok|subd)", low):
        f.append("district")
    if re.match(r"(?:19|20)\d\d\b", low):
        f.append("year")
    if re.search(r"\bpurok\s\d", low):
        f.append("purok")
    if re.search(r"\b(?:blk|block)\.?\s?\d+.*\blot\s?\d", low):
        f.append("block and lot")
    if re.search(r"\b(?:room|window|section|form|memo)\b", low):
        f.append("indoors")
    if re.search(r"\b(?:hall|library|gymnasium|pavilion|annex|floor)\b", low):
        f.append("building")
    if re.search(r"\b(?:copies|pages|students|members|applicants|of|the|and|for|were|was|is|in|to|on|from)\b", low):
        f.append("running text")
    if re.search(r"\d{4}$", s) and len(s) > 12:
        f.append("code")
    if len(s) > len(head):
        last = re.findall(r"[^\W\d_]+", s[len(head) :])[-1:]
        f.append("mixed end" if last and last[0].islower() and re.search(r"[A-Z]", s[len(head) :]) else "even end")
    if re.search(r"(?<!\bst)(?<!\bave)(?<!brgy)(?<!subd)(?<!\bext)(?<!\bapt)(?<!\brd)(?<!\bdr)(?<!blvd)[.!?]\s+[A-Z]|\n", s) and not re.search(r"(?:St|Ave|Brgy|Subd|Ext|Apt|Rd|Dr|Blvd|Vill|Bgy)\.\s+[A-Z][^.!?]*$", s):
        f.append("over a sentence end")
    return f


def _names(text: str, given: frozenset, surname: frozenset, emails: list[tuple[int, int]]) -> Iterator[Span]:
    found = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    low = [POSSESSIVE.sub("", w.rstrip(".")).lower() for *_, w in found]
    # a name has a surname of the lexicon, or a title, or an initial or given name before a capital
    seeds = [i for i, b in enumerate(low) if b in surname or b in given or (b in TITLES and found[i][2][0].isupper() and len(b) > 1)]
    seen = set()
    for i in seeds:
        for a in range(max(0, i - 4), i + 1):
            for b in range(max(i + 1, a + 2), min(len(found), a + 6) + 1):
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                words = [w for *_, w in found[a:b]]
                if any(w.endswith(".") and len(w) > 3 and w[:-1].lower() not in TITLES | SUFFIXES for w in words[:-1]):
                    continue  # over the end of a sentence
                if "." in words or words[0] == "," or words[-1] == "," or any(not (w[0].isalpha() or w == ",") for w in words):
                    continue
                start, end = found[a][0], found[b - 1][1]
                if "\n" in text[start:end] or any(x < end and start < y for x, y in emails):
                    continue
                if words[-1].endswith(".") and low[b - 1] not in SUFFIXES and len(low[b - 1]) > 1:
                    end -= 1
                pattern = _classes(words, given, surname, a)
                if "x" in pattern or not re.search(r"[SCG]", pattern) or pattern.count(",") > 1:
                    continue
                tail = re.findall(r"[^\W\d_]+", text[end : end + 24].lower())[:1]
                near = text[end : end + 1] == " " and tail and tail[0] in THINGS
                f = ["name", f"pattern={pattern}", f"len={b - a}"]
                if near:
                    f.append("thing follows")
                if any(x in THINGS for x in low[a:b]):
                    f.append("thing inside")
                f.append(f"case={'u' if all(w.isupper() for w in words if w != ',') else 'l' if all(w.islower() for w in words if w != ',') else 'm'}")
                if a and (found[a - 1][2][0].isupper() or low[a - 1] in given) and text[found[a - 1][1] : start] == " " and low[a - 1] in (given | TITLES):
                    f.append("name goes on before")
                if b < len(found) and low[b] in surname | SUFFIXES and text[end : end + 1] == " ":
                    f.append("name goes on behind")
                yield Span(start, end, "name", f)


#: words that introduce a name; fixed values
CUES = frozenset("is am im si ni kay sina nina named name ako ay po : called".split())
OPEN = re.compile(r"[A-ZÀ-ÖØ-Þ](?:[^\W\d_A-Z]+(?:[’'-][A-ZÀ-Þ]?[^\W\d_A-Z]+)*|\.)")


def _open_names(text: str, given: frozenset, surname: frozenset, emails: list[tuple[int, int]]) -> Iterator[Span]:
    """Capitalised words and initials behind a word that introduces a name, none of them in the lexicon."""
    for cue in re.finditer(r"(?:(?<![^\W\d_])(?:I['’]m|[^\W\d_]+)|:)\s+(?=[A-ZÀ-ÖØ-Þ])", text):
        first = cue.group().strip().lower().replace("'", "").replace("’", "")
        if first not in CUES:
            continue
        at, words = cue.end(), []
        while len(words) < 4 and (m := OPEN.match(text, at)):
            words.append(m)
            if text[m.end() : m.end() + 1] != " ":
                break
            at = m.end() + 1
        before = re.findall(r"[^\W_]+|[^\w\s]", text[max(0, cue.start() - 32) : cue.start()].lower())[-1:] or ["^"]
        for n in range(2, len(words) + 1):
            own = [m.group() for m in words[:n]]
            low = [w.rstrip(".").lower() for w in own]
            if own[-1].endswith(".") or any(w in given or w in surname for w in low) or any(x < words[n - 1].end() and words[0].start() < y for x, y in emails):
                continue
            pattern = "".join("I" if w.endswith(".") else "C" for w in own)
            f = ["open", f"open {pattern}", f"open l1={first}", f"open l2={before[0]} {first}"]
            if any(w in THINGS or w in TITLES for w in low) or (n < len(words) and words[n].group().lower() in THINGS):
                f.append("open thing")
            if n < len(words):
                f.append("open goes on")
            tail = re.findall(r"[^\W\d_]+|[^\w\s]", text[words[n - 1].end() : words[n - 1].end() + 24].lower())[:1]
            f.append(f"open r1={tail[0] if tail else '$'}")
            yield Span(words[0].start(), words[n - 1].end(), "name", f)


def _boundaries(spans: list[Span]) -> tuple[list[int], dict[int, int]]:
    points = sorted({p for s in spans for p in (s.start, s.end)})
    return points, {p: i for i, p in enumerate(points)}


def score(span: Span, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in span.features)


def decode(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The best set of spans that don't overlap."""
    points, at = _boundaries(spans)
    by_end: dict[int, list[tuple[Span, float]]] = {}
    for s in spans:
        v = score(s, weights)
        if v > 0:
            by_end.setdefault(at[s.end], []).append((s, v))
    best: list[tuple[float, Span | None]] = [(0.0, None)] * len(points)
    for k in range(len(points)):
        top: tuple[float, Span | None] = (best[k - 1][0], None) if k else (0.0, None)
        for s, v in by_end.get(k, ()):
            if best[at[s.start]][0] + v > top[0]:
                top = (best[at[s.start]][0] + v, s)
        best[k] = top
    out, k = [], len(points) - 1
    while k >= 0:
        s = best[k][1]
        if s is None:
            k -= 1
        else:
            out.append(s)
            k = at[s.start]
    return out[::-1]


def _expected(spans: list[Span], weights: dict[str, float]) -> tuple[float, list[float]]:
    """log Z and the probability of each span, by forward and backward sums over the boundaries."""
    points, at = _boundaries(spans)
    n = len(points)
    v = [score(s, weights) for s in spans]
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for i, s in enumerate(spans):
        ends.setdefault(at[s.end], []).append(i)
        starts.setdefault(at[s.start], []).append(i)
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    alpha, beta = [0.0] * n, [0.0] * n
    for k in range(n):
        x = alpha[k - 1] if k else 0.0
        for i in ends.get(k, ()):
            x = add(x, alpha[at[spans[i].start]] + v[i])
        alpha[k] = x
    for k in range(n - 1, -1, -1):
        x = beta[k + 1] if k < n - 1 else 0.0
        for i in starts.get(k, ()):
            x = add(x, beta[at[spans[i].end]] + v[i])
        beta[k] = x
    z = alpha[-1]
    return z, [math.exp(min(0.0, alpha[at[s.start]] + x + beta[at[s.end]] - z)) for s, x in zip(spans, v)]


#: ---- training sentences, all of them invented
_GIVEN = "Alina Bruno Carla Dario Elsa Felix Gemma Hugo Irma Joel Karla Leo Marta Nilo Olga Pablo Rosa Simon Tala Vito".split()
_SURNAME = "Almazor Bantigue Cordovan Dimasupil Esguer Fajarito Galvezon Hinagpis Ilustrado Javelosa Kalinaw Ladronio Manlapig Nazareth Obligar Pagsanjo Quejado Resurrec Sumalpong Villasin".split()
_PLACES = ("San Rafael Sur", "Lungsod Bago", "Port Aurora", "Villa Celeste", "Mabini Bay", "Bagong Nayon", "Santa Lucia")
_STREETS = "Rizaleda Acacia Mangga Camia Anahaw Lapulapo Del-Mar".split()
_HOSTS = ("mail.example", "post.test", "alumni.invalid", "students.college.example", "college.example")
_FIRST = "Applied Rural Technical World Student Physical Honor Graduate Speech Basic Human Marine Civic Modern Public Business".split()
_SECOND = "Sociology Drawing Religions Affairs Education Roll Program Communication Science Research Ethics Statistics Records Services Law Literature".split()
_BUILDINGS = ("Hall", "Library", "Gymnasium", "Pavilion", "Annex", "Medal", "Prize", "Scholarship", "Grant", "Chapel", "Auditorium", "Award")


def _person(r: random.Random) -> str:
    g, s, i = r.choice(_GIVEN), r.choice(_SURNAME), r.choice("ABCDEFGHJKLMNRSTVWXYZ")
    if r.random() < 0.1:
        s = "dela " + s
    form = r.choice(["{g} {s}"] * 4 + ["{g} {i}. {s}", "{s}, {g}", "{s}, {g} {i}.", "{s} {g}", "{i}. {s}", "Ms. {g} {s}", "Prof. {s}", "Dr. {s}", "Ma. {g} {s}", "{g} {s} Jr.", "Mr. {s}", "Engr. {g} {i}. {s}"])
    out = form.format(g=g, s=s, i=i)
    x = r.random()
    if x < 0.15 and "." not in out:
        return out.lower()
    if x < 0.28:
        return f"{s.upper()}, {g}" if "," in out else f"{g} {s}".upper()
    return out


def _d(r: random.Random, shape: str) -> str:
    return re.sub("9", lambda m: str(r.randint(0, 9)), shape)


def _phone(r: random.Random) -> str:
    if r.random() < 0.1:
        names = "zero one two three four five six seven eight nine".split()
        return "zero nine " + " ".join(r.choice(names) for _ in range(9))
    shape = r.choice(["+63 9{} 999 9999", "+639{}9999999", "63-9{}-9999999", "(09{}) 999-9999", "09{}-999-9999", "09{}.999.9999", "09{}9999999", "09{} 999 9999", "(0{}) 999-9999", "0{} 999 9999 loc. 99", "0{} 999 9999"])
    shape = re.sub(r"\{\}", lambda m: f"{r.randint(10, 99)}", shape)
    # the fixed digits of the shape stay: only 9s after the dialling code are drawn
    head = re.match(r"[^ .-]*?(?:\d{2}|\d)(?=[ .\-)]|\d{7}$)", shape)
    k = head.end() if head else 4
    return shape[:k] + _d(r, shape[k:])


def _id(r: random.Random) -> str:
    return _d(r, r.choice(["PSN 9999-9999-9999-9999", "TIN 999-999-999-000", "SSS 99-9999999-9", "PhilHealth 99-999999999-9", f"passport P9999999{r.choice('ABC')}", "N99-99-999999", "license N99-99-999999", "PRC 9999999", "2{}-99999", "2{}-99999-HC", "HC-202{}-99999", "202{}-99999", "S9999999", "1{}-99999-HC", "201{}-99999"]).replace("{}", str(r.randint(0, 8))))


def _email(r: random.Random) -> str:
    user = r.choice(["{g}.{s}", "{g}_{s}", "{i}{s}", "{g}{s}{n}", "{g}-{s}{n}", "{g}.{s}+form"]).format(g=r.choice(_GIVEN), s=r.choice(_SURNAME), i=r.choice("abcdef"), n=r.randint(1, 999)).lower()
    host = r.choice(_HOSTS)
    form = r.choice(["{u}@{h}"] * 4 + ["{u} @ {h}", "{u} (at) {d}", "{u} at {w}", "{u} [at] {d}"])
    out = form.format(u=user, h=host, d=host.replace(".", " (dot) "), w=host.replace(".", " dot "))
    return out.upper() if r.random() < 0.08 else out


def _address(r: random.Random) -> str:
    n, s, p, q = r.randint(1, 199), r.choice(_STREETS), r.choice(_PLACES), r.choice(_PLACES)
    out = r.choice([
        f"#{n} {s} Street, {p}, {q}", f"{n}-{r.choice('ABCD')} {s} Extension, {q} {r.randint(1000, 9999)}", f"house no. {n} {s.lower()} road brgy {p.lower()}",
        f"Purok {r.randint(1, 9)}, Barangay {p}, {q}", f"{n} {s} St., Brgy. {p}, {q}", f"Unit {n}-{r.choice('ABCD')}, {s} Apartments, {r.choice(_STREETS)} Avenue, {q} {r.randint(1000, 9999)}",
        f"Blk {r.randint(1, 40)} Lot {r.randint(1, 40)}, {s} Subd., {q}", f"{n} {s} Road, {q}",
    ])
    return out


_MAKE = {"email": _email, "phone": _phone, "id_number": _id, "address": _address, "name": _person}
_FRAMES = (
    "My name is {name}.", "I am {name}, student number {id_number}.", "my driver's license {id_number} was lost", "driver's license no. {id_number}", "I'm {name} from the second section.", "The student is named {name}.", "Name: {name}", "Full name: {name}, {phone}", "Ang pangalan ko ay {name}.", "this is {name}, number ko {phone}", "Reply to {email} or call {phone}.", "I live at {address}.", "Regards,\n{name}\n{phone}",
    "Name: {name}\nStudent no.: {id_number}\nAddress: {address}", "Ako po si {name}.", "Si {name} po ang aking tagapayo.", "Please send the copy to {email}.", "You may call the desk at {phone}.",
    "The certificate will be mailed to {address}.", "Your record lists {name} with number {id_number}.", "My ID is {id_number} and I stay at {address}.", "It gave out the ID {id_number} of {name}!",
    "contact my guardian {name} at {phone}.", "Kindly look for {name} ({id_number}), {address}, {phone}.", "Still shows {phone}, my new one is {phone}.", "My adviser {name} asked me to check.", "I already gave {id_number} to the cashier.",
    "hello po, {name} here, pls use {email}", "({email}) Where can I ask?", "My landlord at {address} needs a letter.", "My surname is wrong, it should be {name}.", "Wrong email, use {email}.", "Call me, {name}, {phone}, about this.",
    "The portal shows {id_number} instead of {id_number}.", "since i moved to {address} last month", "kindly correct: {address}", "The adviser assigned is {name}.", "A confirmation will go to {email}.", "{email} is my new one, the old one is {email}.",
)
_TRAPS = (
    "I was told to go to Room {n3}, {thing}.", "The office is in {thing}, Room A-{n3}.", "My section meets in {thing} @ {n1}pm.", "I followed @{handle} for this.", "My receipt is OR No. {n7} for PHP {n2},{n3}.00.",
    "The payment reference is 2{n10}.", "Memo No. 202{n1}-{n3} says otherwise.", "The book number is 978-0-00-{n6}-{n1}.", "The form is dated 0{n1}-1{n1}-202{n1}.", "This is for school year 202{n1}-202{n1}.", "Is it the same as Form 1{n2}?",
    "The schedule code is S-{n5}.", "The gate on {street} side was closed.", "I have the barangay clearance already.", "My average is {n2}.{n2} out of 100.", "Tell me about the {thing} and the permit.", "The council counted {n3} copies at the front desk, of which {n3} were dated May 1{n1}, 202{n1}.",
    "{n2} students from Rural Sociology and {n2} from World Religions joined the fair.", "Requests are received at Window {n1} from {n1}:00 PM to {n1}:30 PM.", "Students taking Technical Drawing (BA {n3}) meet in Room N-{n3}.", "The symposium was held in {thing} on July {n1}, 202{n1}.",
    "A fee of PHP {n2},{n3}.25 is charged at the cashier.", "Section {n3} of the manual was read aloud.", "I applied for the {thing}.", "The minutes of May {n1}, 202{n1} show that the Office of Student Affairs met.", "In school year 201{n1}-202{n1}, it cost ₱{n3}.", "Ms. means miss, and Prof. means professor.",
    "Wer das benötigt, meldet sich vor Freitag (A-{n3}/{n3}, {n1}.{n1}.202{n1}).", "Según el decano, se entrega 1{n1}.{n1}.201{n1}.", "avant vendredi (1{n1}.1{n1}.202{n1}, B-{n3}/{n3}) et la caisse", "setelah rapat 2{n1}.{n1}.202{n1} dan dekan",
    "On November 1{n1}, 20{n2}, the extension services unit reconciled the list.", "As of May 20{n2}, the road works and the extension hall are closed.", "Between {n1}:00 PM and {n1}:30 PM the extension services unit must update the list.", "My course is {cap}.", "The form is called {cap}.", "Subject: {cap}", "Office: {cap}, Room {n3}", "The next topic is {cap} and its exam.", "Ang asignatura ay {cap}.", "I am in {cap}.", "I am enrolled, section is {cap}.", "Is {cap} offered?", "The event is named {cap} Day.", "Course: {cap}", "Ang opisina ni {cap}?", "The prize is {cap}.", "This is {cap} Week.",
    "In the rainy months, {n2} members of the college read the road map.", "TELL ME ABOUT THE {THING} AND THE PERMIT.",
)


def training(n: int = SENTENCES, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the (start, end, type) of their entities."""
    r = random.Random(seed)
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.choice((1, 1, 2))):
            if text:
                text += " "
            if r.random() < 0.5:
                for part in re.split(r"(\{\w+\})", r.choice(_FRAMES)):
                    if part.startswith("{"):
                        value = _MAKE[part[1:-1]](r)
                        gold.append((len(text), len(text) + len(value), part[1:-1]))
                        text += value
                    else:
                        text += part
            else:
                filled = re.sub(r"\{n(\d+)\}", lambda m: _d(r, "9" * int(m.group(1))), r.choice(_TRAPS))
                text += filled.format(THING=f"{r.choice(_SURNAME)} {r.choice(_BUILDINGS)}".upper(), cap=f"{r.choice(_FIRST)} {r.choice(_SECOND)}", thing=f"{r.choice(_SURNAME)} {r.choice(_BUILDINGS)}", handle=r.choice(_SURNAME).lower() + "news", street=r.choice(_STREETS))
        yield text, gold


@lru_cache(maxsize=1)
def fit(sentences: int = SENTENCES, passes: int = 3, rate: float = 0.25, decay: float = 2e-4) -> dict[str, float]:
    """The weights, by stochastic gradient of the conditional likelihood of the right spans."""
    given, surname = frozenset(x.lower() for x in _GIVEN), frozenset(x.lower() for x in _SURNAME)
    data = []
    for i, (text, gold) in enumerate(training(sentences)):
        spans = candidates(text, given, surname)
        if i % 2 == 0:
            # every other sentence is read without a lexicon, for the names that it doesn't know
            spans = [s for s in spans if s.label != "name"] + [s for s in candidates(text, frozenset(), frozenset()) if s.features[0] == "open"]
        right = []
        for a, b, label in gold:
            # the candidate of the label that covers the entity best
            best = max((s for s in spans if s.label == label and s.start < b and a < s.end), key=lambda s: (-abs(s.start - a) - abs(s.end - b)), default=None)
            if best is not None:
                right.append(best)
        if spans:
            data.append((spans, {id(s) for s in right}))
    weights: dict[str, float] = {}
    r = random.Random(1)
    for p in range(passes):
        r.shuffle(data)
        step = rate / (1 + p)
        for spans, right in data:
            _, prob = _expected(spans, weights)
            for s, q in zip(spans, prob):
                g = (1.0 if id(s) in right else 0.0) - q
                if abs(g) > 1e-4:
                    for f in s.features:
                        w = weights.get(f, 0.0)
                        weights[f] = w + step * (g - decay * w)
    return weights


PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def find(text: str | None, weights: dict[str, float], given: frozenset, surname: frozenset) -> list[Span]:
    if not text:
        return []
    spans = candidates(text, given, surname)
    return decode(spans, weights) if spans else []


def mask(text: str, found: Iterable[Span]) -> str:
    out, last = [], 0
    for s in found:
        out += (text[last : s.start], PLACEHOLDER[s.label])
        last = s.end
    return "".join(out) + text[last:]


def lexicon(users: DataFrame) -> DataFrame:
    """word, given, surname: the words of the users' ``name`` attribute and whether they stand first or last in one."""
    names = users.select(F.explode("attributes").alias("a")).filter("a.name = 'name' and a.value is not null").select(F.lower(F.trim("a.value")).alias("v")).distinct()
    parts = names.select(F.split("v", r"\s+").alias("p")).filter(F.size("p") >= 2)
    ends = F.explode(F.array(F.struct(F.element_at("p", 1).alias("w"), F.lit(True).alias("g")), F.struct(F.element_at("p", -1).alias("w"), F.lit(False).alias("g")))).alias("e")
    words = parts.select(ends).select(F.regexp_replace("e.w", r"\.+$", "").alias("word"), "e.g").filter((F.length("word") >= 2) & ~F.col("word").rlike(r"\d"))
    out = words.groupBy("word").agg(F.max("g").alias("given"), F.max(~F.col("g")).alias("surname"))
    return out.withColumn("surname", F.col("surname") & ~F.col("word").isin(*THINGS, *SUFFIXES))


def own_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``texts`` with ``given`` and ``surname``: the words of the lexicon that each text holds, by a join."""
    # a text's key is its hash, so equal texts are looked up once
    keyed = texts.withColumn("__text", F.sha2("text", 256))
    spelled = keyed.select("__text", "text").dropDuplicates(["__text"]).select("__text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+(?:[’'-][\p{L}]+)*)"), F.lit(1)))).alias("said"))
    # a possessive is looked up as its owner too
    spelled = spelled.select("__text", F.explode(F.array_distinct(F.array("said", F.regexp_replace("said", "['’]s$", "")))).alias("word"))
    hits = spelled.join(words, "word").groupBy("__text").agg(F.collect_set(F.when(F.col("given"), F.col("word"))).alias("given"), F.collect_set(F.when(F.col("surname"), F.col("word"))).alias("surname"))
    return keyed.join(hits, "__text", "left").drop("__text")


KEY = "tab string, rec_id string, field string, msg_idx int"


def _run(model: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, given, surname = model.value
        for batch in batches:
            texts = batch.column(4).to_pylist()
            own = [batch.column(i).to_pylist() for i in (5, 6)] if batch.num_columns > 5 else None
            known = [(frozenset(g or ()), frozenset(n or ())) for g, n in zip(*own)] if own else [(given, surname)] * len(texts)
            found = [find(t, weights, *k) for t, k in zip(texts, known)]
            masked = [mask(t, f) if f else t for t, f in zip(texts, found)]
            types = [sorted({s.label for s in f}) for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(masked, pa.string()), pa.array(types, pa.list_(pa.string()))], names=["tab", "rec_id", "field", "msg_idx", "masked", "types"])

    return run


def mask_texts(texts: DataFrame, users: DataFrame, limit: int = LEXICON) -> DataFrame:
    """tab, rec_id, field, msg_idx, masked, types of every text once; texts: tab, rec_id, field, msg_idx, text.

    A lexicon of at most ``limit`` words goes to the workers; of a larger one each text gets its own words.
    """
    rows = texts.select("tab", "rec_id", "field", "msg_idx", "text").dropDuplicates()
    words = lexicon(users)
    few = words.limit(limit + 1).collect()
    given, surname = frozenset(), frozenset()
    if len(few) <= limit:
        given, surname = frozenset(r.word for r in few if r.given), frozenset(r.word for r in few if r.surname)
    else:
        rows = own_words(rows, words)
    model = texts.sparkSession.sparkContext.broadcast((fit(), given, surname))
    return rows.mapInArrow(_run(model), f"{KEY}, masked string, types array<string>")
