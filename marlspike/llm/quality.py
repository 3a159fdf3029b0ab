"""Per-document text statistics, and prose told from lists, tables and junk.

A document is cut into chunks of ``chunk`` code points wherever they fall. Each
chunk gives a summary that can be merged: the counts of its whole lines, and the
open line at either end, as text or, where it is long, as sums over its words with
the words that are open themselves. These tell all that is asked of a line, so long
lines are judged as short ones are. Joining two neighbours joins the open lines
between them, which is the correction at the boundary: a word or line cut by a
chunk counts once, and the result is the same at every chunk size. The summaries of
one document are merged as a tree (64 neighbours at a time), so no task holds a huge
text. Ratios and the kind follow from the merged counts.

Defined cases: null texts count as empty; an empty text has zero counts and no
kind; texts under ``min_words`` words have statistics, but no kind; repeated rows
(the same id) count once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: common words of the languages met here; fixed values
COMMON = frozenset(
    "the of and to in is for a that on with as by be at from or an it are was this not have will has which all its may "
    "ang ng sa na mga ay at para po ito hindi kung ni si mula nang "
    "der die das und ist nicht mit auf für dem den ein eine zu von "
    "el la los las de que y en un una se con por del no "
    "le les des et du est pour dans une sur pas que qui au "
    "o os as e do da em um uma não com para".split()
)
#: counts of a run of whole lines
NAMES = (
    "chars", "spaces", "alpha", "digits", "symbols", "words", "word_chars", "common", "lines", "ended", "bulleted",
    "item_words", "table_words", "junk_words", "plain_words", "plain_lines", "plain_len", "plain_len2", "stops", "numeric_lines", "short_lines", "upper",
)
N = len(NAMES)
AT = {n: i for i, n in enumerate(NAMES)}

BULLET = re.compile(r"(?:[-*•▪◦·–—]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)])\s+\S")
LEADER = re.compile(r"(?:\.\s?){4,}\s*\S{1,6}\s*$")
HEX = re.compile(r"[0-9a-fA-F]{4,8}:?(?:\s+[0-9a-fA-F]{2,4}){4,}")
FIELD = re.compile(r"[^\W\d_][\w' ./-]{0,24}:\s+\S")
STOP = re.compile(r"[\w)”\"'][.!?][)\"'”’]*(?=\s|$)")
END = re.compile(r"[.!?:;][)\"'”’*]*$")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
NUMBER = re.compile(r"[\d.,:/%₱$€£+-]*\d[\d.,:/%+-]*$")
CODE = re.compile(r"(?:[A-Z]{1,4}|[A-Z]{1,4}-?\d{1,4}|\d{1,2}:\d\d|[AP]M|Sat|Sun|Mon|Tue|Wed|Thu|Fri|PHP)$")
VOWEL = re.compile(r"[aeiouyAEIOUYÀ-ÿ]")


LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CAPITALS = LETTERS[26:]
DIGITS = b"0123456789"
VOWELS = b"aeiouyAEIOUY"
OTHER_LETTER = re.compile(r"[^\W\d_\x00-\x7f]")
_common = COMMON.__contains__


def line_counts(line: str) -> list[int]:
    """The counts of one whole line."""
    c = [0] * N
    count_line(line, c)
    return c


def count_line(line: str, c: list[int]) -> None:
    """Add the counts of one whole line to ``c``."""
    if len(line) > LONG:
        for i, v in enumerate(Words.of(line).line()):
            c[i] += v
        return
    tokens = line.split()
    c[0] += len(line)
    if not tokens:
        c[1] += len(line)
        return
    text = line.strip()
    solid = sum(map(len, tokens))
    alpha, digits = _letters_digits(line)
    c[1] += len(line) - solid
    c[2] += alpha
    c[3] += digits
    c[4] += solid - alpha - digits
    c[6] += solid
    c[7] += sum(map(_common, line.lower().split()))
    c[9] += END.search(text) is not None
    c[20] += len(tokens) <= 2
    c[21] += text.isupper()
    judge(text, c)


def _letters_digits(text: str) -> tuple[int, int]:
    raw = text.encode("utf-8", "replace")
    letters = len(raw) - len(raw.translate(None, LETTERS))
    return letters if len(raw) == len(text) else letters + len(OTHER_LETTER.findall(text)), len(raw) - len(raw.translate(None, DIGITS))


def running(text: str) -> list[str] | None:
    """The tokens of a line that is running text at first sight: plain words of ordinary length in a row."""
    n = len(text)
    if n < 36 or not text[0].isalpha() or not text[1].isalpha() or "  " in text or "|" in text or "\t" in text or ".." in text or ". ." in text or ": " in text[:28]:
        return None
    raw = text.encode("utf-8", "replace")
    blanks = text.count(" ")
    letters = len(raw) - len(raw.translate(None, LETTERS))
    if letters < 0.7 * (n - blanks) or not 3 * blanks <= n <= 10 * blanks or text.count(",") >= 3:
        return None
    if len(raw) - len(raw.translate(None, VOWELS)) < 0.28 * letters or len(raw) - len(raw.translate(None, CAPITALS)) > 0.2 * letters:
        return None
    tokens = text.split()
    return tokens if len(set(tokens)) > 3 else None


def stops_in(text: str) -> int:
    return len(STOP.findall(text)) if "." in text or "?" in text or "!" in text else 0


def judge(text: str, c: list[int]) -> None:
    """Add to ``c`` what a line, stripped and not empty, counts as: an item, part of a table, junk or running text.

    This alone decides kinds, for ``text_quality`` as for ``kind_only``; ``Words.verdict`` is the same from sums.
    """
    c[8] += 1
    tokens = running(text)
    if tokens:
        c[5] += len(tokens)
        c[14] += len(tokens)
        c[15] += 1
        c[16] += len(text)
        c[17] += len(text) ** 2
        c[18] += stops_in(text)
        return
    tokens = text.split()
    n = len(tokens)
    c[5] += n
    solid = sum(map(len, tokens))
    raw = text.encode("utf-8", "replace")
    letters = len(raw) - len(raw.translate(None, LETTERS))
    alpha = letters if len(raw) == len(text) else letters + len(OTHER_LETTER.findall(text))
    digits = len(raw) - len(raw.translate(None, DIGITS)) if alpha < solid else 0
    leader = ("..." in text or ". ." in text) and LEADER.search(text) is not None
    if not leader and _junk(text, tokens, n, solid, alpha, digits, raw, letters):
        c[13] += n
        return
    if leader and alpha:
        c[10] += 1
        c[11] += n
        return
    stops = stops_in(text)
    if text.count("|") >= 2 or text.count("\t") >= 2 or ("  " in text and stops <= 1 and len(GAPS.findall(text)) >= 2):
        c[12] += n
        return
    bullet = BULLET.match(text) is not None
    if not bullet:
        commas = text.count(",")
        if commas >= 3 and not stops and (digits >= 4 or commas >= 4) and sum(1 for t in text.split(",") if len(t.split()) <= 4) >= commas:
            c[12] += n
            return
        colon = text.find(":", 0, 26)
        if colon > 0 and stops <= 1 and len(text) < 120 and text[0].islower() and text[:colon].count(" ") <= 2 and FIELD.match(text):
            c[12] += n
            return
        if n <= 4 and END.search(text) is None and all(NUMBER.match(t) or CODE.match(t) for t in tokens):
            c[19] += 1
            c[12] += n
            return
        c[14] += n
        c[15] += 1
        c[16] += len(text)
        c[17] += len(text) ** 2
        c[18] += stops
        return
    c[10] += 1
    c[11] += n
    c[18] += max(0, stops - 1)


def _junk(text: str, tokens: list[str], n: int, solid: int, alpha: int, digits: int, raw: bytes, letters: int) -> bool:
    """No readable content: byte dumps, loose characters, signs, one token again and again, encoded bytes, no vowels."""
    symbols = solid - alpha - digits
    if symbols > 0.35 * solid and solid >= 6:
        return True
    if n >= 5:
        if solid <= 1.3 * n and sum(map(_loose, tokens)) > 0.4 * n:
            return True
        if digits > 0.2 * solid and HEX.match(text):
            return True
    if n >= 4 and len(set(tokens)) <= min(3, n // 8 + 1) and not all(map(str.isdigit, tokens)):
        return True
    capitals = letters - (len(raw.translate(None, CAPITALS)) - (len(raw) - letters)) if letters else 0
    if solid >= 12 and (digits or capitals > 0.15 * solid) and sum(len(t) for t in tokens if len(t) >= 6 and _mixed(t)) > 0.5 * solid:
        return True
    if n >= 3 and len(raw) - len(raw.translate(None, VOWELS)) < 0.22 * letters:
        voiceless = sum(map(_voiceless, tokens))
        return voiceless >= 0.5 * n and voiceless + sum(1 for t in tokens if len(t) < 3) > 0.7 * n
    return False


def _loose(t: str) -> bool:
    return t.isalnum() and not t.isdigit()


def _voiceless(t: str) -> bool:
    return len(t) >= 3 and t.isalpha() and not t.isupper() and not VOWEL.search(t)


#: a word in lower case, its first letter perhaps a capital, with at most one sign behind it: too regular to be encoded bytes
REGULAR = re.compile(r"[^\W\d_][a-zß-öø-ÿ]*[^\w-]?")


def _mixed(t: str) -> bool:
    """Letters of both cases, or letters and digits, without order: encoded bytes."""
    if REGULAR.fullmatch(t) or "-" in t or "@" in t or "." in t[1:-1]:
        return False
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in t]
    return _turning(sum(a != b for a, b in zip(kinds, kinds[1:])), len(t), set(kinds))


def _turning(turns: int, n: int, kinds: set[int]) -> bool:
    return turns >= max(3, n // 3) and len(kinds) >= 2 and 2 in kinds or (turns >= max(4, n // 3) and {0, 1} <= kinds)


def kind_only(text: str, min_words: int = 20) -> str | None:
    """The kind of a text without its statistics, by the same judgement of its lines."""
    c = [0] * N
    for line in LINE_ENDS.split(text):
        if len(line) > LONG:
            for i, v in Words.of(line).verdict():
                c[i] += v
            continue
        line = line.strip()
        if line:
            judge(line, c)
    return kind_of(c, min_words)


def add(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


#: lines of more code points are judged from sums, which can be merged wherever a chunk cuts them; the verdict is the same
LONG = 8192
#: of a word with more code points only sums and the ends are kept
GIANT = 512
SUMS = (
    "chars", "alpha", "digits", "letters", "vowels", "capitals", "bars", "upper", "lower", "two_dots", "three_dots", "spaced_dots",
    "gap_len", "blanks", "tabs", "doubles", "gaps", "words", "solid", "common", "stops", "mixed", "loose", "voiceless", "short", "odd", "numeric",
)
SUM = {n: i for i, n in enumerate(SUMS)}
WORD_STOP = re.compile(r"[\w)”\"'][.!?][)\"'”’]*$")
DOTS = ("..", "...", ". .")
#: code points kept of a line's start, and of its start and end with white space shortened; texts up to HELD - 8 are judged as they are
HELD, ENDS = 128, 64
LONG_SPACE = re.compile(r"(\s\s)\s+")
CLOSERS = re.compile(r"[)\"'”’*]{2,}")


def _characters(text: str) -> list[int]:
    """The sums that no boundary disturbs."""
    raw = text.encode("utf-8", "replace")
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    alpha, digits = _letters_digits(text)
    each = set(text)
    cased = [sum(map(str.isupper, each)), sum(map(_small_or_title, each))]
    return [len(text), alpha, digits, less(LETTERS), less(VOWELS), less(CAPITALS), text.count("|"), *cased, *(d in text for d in DOTS)] + [0] * (len(SUMS) - 12)


#: white space between words: its length, spaces, tabs, whether two spaces follow each other, whether it begins and ends with one
NO_GAP = [0, 0, 0, 0, 0, 0]


def _gap(text: str) -> list[int]:
    return [len(text), text.count(" "), text.count("\t"), int("  " in text), int(text[:1] == " "), int(text[-1:] == " ")]


def _wider(a: list[int], b: list[int]) -> list[int]:
    if not a[0] or not b[0]:
        return a if a[0] else b
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] | b[3] | (a[5] & b[4]), a[4], b[5]]


class Words:
    """A piece of one long line as sums over its words and the white space between them.

    ``front`` and ``back`` are the white space at its ends; the words at its ends, which a neighbour may go on
    with, are kept apart: ``head`` the first one, ``tail`` the last one or None where there is one word at most.
    A word is its text, or that of a giant: see ``_giant``. ``fields`` are the words of the first and the last part
    between commas, the number of the parts between these with four words or less, and that of commas. ``ends``
    are the piece's first code points, those without white space before them, and its start and end with white
    space shortened. So everything that ``judge`` asks of a line can be told of a sum of pieces.
    """

    __slots__ = ("sums", "head", "tail", "few", "front", "back", "fields", "ends")

    def __init__(self, sums: list[int], head: object, tail: object, few: list[str], front: list[int], back: list[int], fields: list[int], ends: list[str]):
        self.sums, self.head, self.tail, self.few, self.front, self.back, self.fields, self.ends = sums, head, tail, few, front, back, fields, ends

    @classmethod
    def of(cls, text: str) -> Words:
        parts = [len(x.split()) for x in text.split(",")]
        short = LONG_SPACE.sub(r"\1", text)
        ends = [text[:HELD], text.lstrip()[:HELD], short[:ENDS], short[-ENDS:]]
        out = cls(_characters(text), "", None, [], NO_GAP, NO_GAP, [parts[0], parts[-1], sum(n <= 4 for n in parts[1:-1]), len(parts) - 1], ends)
        core = text.strip()
        if not core:
            out.front = _gap(text)
            return out
        at = text.index(core)
        out.front, out.back = _gap(text[:at]), _gap(text[at + len(core) :])
        parts = re.split(r"(\s+)", core)
        for g in parts[1::2]:
            out._between(_gap(g))
        out.head = _word(parts[0])
        if len(parts) > 1:
            out.tail = _word(parts[-1])
            for t in parts[2:-1:2]:
                out._close(_word(t))
        return out

    def _between(self, gap: list[int]) -> None:
        s = self.sums
        length, blanks, tabs, double = gap[:4]
        for name, v in (("gap_len", length), ("blanks", blanks), ("tabs", tabs), ("doubles", double), ("gaps", blanks == length >= 2 or tabs == length == 1)):
            s[SUM[name]] += v

    def _close(self, word: object) -> None:
        """Add a word that is whole."""
        s = self.sums
        if isinstance(word, str):
            n, t, name = len(word), word, word
            of = (t.lower() in COMMON, n >= 6 and _mixed(t), _loose(t), _voiceless(t), n < 3, not t.isdigit(), NUMBER.match(t) or CODE.match(t))
        else:
            c, first, last, name, t = dict(zip(GIANT_SUMS, word[0])), word[1], word[2], f" {word[0][0]} {word[3]}", word[4]
            n = c["n"]
            regular = LETTER.fullmatch(first) and c["not_lower"] == (not SMALL.fullmatch(first)) + (not SMALL.fullmatch(last)) and (SMALL.fullmatch(last) or SIGN.fullmatch(last))
            inner = c["dots"] - (first == ".") - (last == ".")
            kinds = {i for i, k in enumerate(("kind0", "kind1", "kind2", "kind3")) if c[k]}
            mixed = not (regular or c["signs"] or inner) and _turning(c["turns"], n, kinds)
            voiceless = not c["not_alpha"] and not (c["kind1"] and not c["cased"]) and not c["vowels"]
            number = not c["not_number"] and c["decimals"] and not word[5]
            of = (False, mixed, not c["not_alnum"] and c["not_digit"] > 0, voiceless, False, c["not_digit"] > 0, number)
        common, mixed, loose, voiceless, short, odd, number = map(bool, of)
        for name_, v in (("words", 1), ("solid", n), ("common", common), ("stops", WORD_STOP.search(t) is not None), ("mixed", n * mixed), ("loose", loose), ("voiceless", voiceless), ("short", short), ("odd", odd), ("numeric", number)):
            s[SUM[name_]] += v
        if len(self.few) < 4 and name not in self.few:
            self.few.append(name)

    def __add__(self, other: Words) -> Words:
        out = Words(add(self.sums, other.sums), self.head, self.tail, list(self.few), self.front, other.back, NO_GAP, [])
        for t in other.few:
            if len(out.few) < 4 and t not in out.few:
                out.few.append(t)
        left, right = self.ends[0][-2:] if len(self.ends[0]) < HELD else self.ends[3][-2:], other.ends[0][:2]
        for d in DOTS:
            out.sums[SUM[("two_dots", "three_dots", "spaced_dots")[DOTS.index(d)]]] += d in left + right
        # the parts between commas
        glued = left[-1:] and right[:1] and not (left[-1].isspace() or left[-1] == "," or right[0].isspace() or right[0] == ",")
        a, b = self.fields, other.fields
        middle = a[1] + b[0] - bool(glued)
        out.fields = [a[0] if a[3] else middle, b[1] if b[3] else middle, a[2] + b[2] + (a[3] > 0 < b[3] and middle <= 4), a[3] + b[3]]
        held = self.ends[1] + other.ends[0] if self.ends[1] else other.ends[1]
        short = [LONG_SPACE.sub(r"\1", x + y) for x, y in zip(self.ends[2:], other.ends[2:])]
        out.ends = [(self.ends[0] + other.ends[0])[:HELD], held[:HELD], short[0][:ENDS], short[1][-ENDS:]]
        # the words
        if not self.head:
            out.front, out.head, out.tail = _wider(self.front, other.front), other.head, other.tail
            return out
        if not other.head:
            out.back = _wider(self.back, other.front)
            return out
        gap = _wider(self.back, other.front)
        if gap[0]:
            out._between(gap)
            if self.tail is not None:
                out._close(self.tail)
            if other.tail is None:
                out.tail = other.head
            else:
                out._close(other.head)
                out.tail = other.tail
            return out
        both = _glue(self.head if self.tail is None else self.tail, other.head)
        if self.tail is None:
            out.head, out.tail = both, other.tail
        elif other.tail is None:
            out.tail = both
        else:
            out._close(both)
            out.tail = other.tail
        return out

    def _total(self) -> tuple[dict[str, int], str, int]:
        """The sums of the whole line, its end and its number of different words up to four."""
        whole = Words(list(self.sums), "", None, list(self.few), NO_GAP, NO_GAP, [], [])
        for word in (self.head, self.tail):
            if word:
                whole._close(word)
        last = self.tail or self.head
        return dict(zip(SUMS, whole.sums)), last if isinstance(last, str) else last[4], len(whole.few)

    def verdict(self) -> list[tuple[int, int]]:
        """What ``judge`` adds for the line."""
        g, last, few = self._total()
        n, solid = g["words"], g["solid"]
        if not n:
            return []
        size = solid + g["gap_len"]
        start = self.ends[1]
        if size <= HELD - 8:
            c = [0] * N
            judge(start[:size], c)
            return [(i, v) for i, v in enumerate(c) if v]
        letters, alpha, digits, stops = g["letters"], g["alpha"], g["digits"], g["stops"]
        commas, small = self.fields[3], self.fields[2] + (self.fields[0] <= 4) + (self.fields[1] <= 4)
        out = [(8, 1), (5, n)]
        plain = [(14, n), (15, 1), (16, size), (17, size**2), (18, stops)]
        running_ = (
            start[:2].isalpha() and not (g["doubles"] or g["bars"] or g["tabs"] or g["two_dots"] or g["spaced_dots"]) and ": " not in start[:28]
            and letters >= 0.7 * (size - g["blanks"]) and 3 * g["blanks"] <= size <= 10 * g["blanks"] and commas < 3
            and g["vowels"] >= 0.28 * letters and g["capitals"] <= 0.2 * letters and few > 3
        )
        if running_:
            return out + plain
        begin, end = self.ends[2].lstrip(), self.ends[3].rstrip()
        leader = (g["three_dots"] or g["spaced_dots"]) and LEADER.search(end) is not None
        junk = (
            solid - alpha - digits > 0.35 * solid and solid >= 6
            or n >= 5 and solid <= 1.3 * n and g["loose"] > 0.4 * n
            or n >= 5 and digits > 0.2 * solid and HEX.match(begin)
            or n >= 4 and few <= min(3, n // 8 + 1) and g["odd"]
            or solid >= 12 and (digits or g["capitals"] > 0.15 * solid) and g["mixed"] > 0.5 * solid
            or n >= 3 and g["vowels"] < 0.22 * letters and g["voiceless"] >= 0.5 * n and g["voiceless"] + g["short"] > 0.7 * n
        )
        if junk and not leader:
            return [*out, (13, n)]
        if leader and alpha:
            return [*out, (10, 1), (11, n)]
        if g["bars"] >= 2 or g["tabs"] >= 2 or (g["doubles"] and stops <= 1 and g["gaps"] >= 2):
            return [*out, (12, n)]
        if BULLET.match(begin):
            return [*out, (10, 1), (11, n), (18, max(0, stops - 1))]
        if commas >= 3 and not stops and (digits >= 4 or commas >= 4) and small >= commas:
            return [*out, (12, n)]
        if n <= 4 and END.search(last) is None and g["numeric"] == n:
            return [*out, (19, 1), (12, n)]
        return out + plain

    def line(self) -> list[int]:
        """The counts of the whole line."""
        g, last, _ = self._total()
        c = [0] * N
        c[0], c[1], c[2], c[3], c[4] = g["chars"], g["chars"] - g["solid"], g["alpha"], g["digits"], g["solid"] - g["alpha"] - g["digits"]
        c[6], c[7] = g["solid"], g["common"]
        if g["words"]:
            c[9], c[20], c[21] = int(END.search(last) is not None), int(g["words"] <= 2), int(g["upper"] > 0 and g["lower"] == 0)
        for i, v in self.verdict():
            c[i] += v
        return c


GIANT_SUMS = ("n", "not_alnum", "not_digit", "not_alpha", "cased", "vowels", "not_lower", "dots", "signs", "not_number", "decimals", "kind0", "kind1", "kind2", "kind3", "turns")
LETTER, SMALL, SIGN = re.compile(r"[^\W\d_]"), re.compile(r"[a-zß-öø-ÿ]"), re.compile(r"[^\w-]")
NUMERIC = re.compile(r"[\d.,:/%₱$€£+-]")
CURRENCY = "₱$€£"
#: words are told apart by their number modulo a prime
PRIME = (1 << 127) - 1


def _giant(t: str) -> list:
    """A word, or a part of one: sums, its first and last code point, its number, its end with closing signs
    shortened, and whether a currency sign follows its last digit."""
    kinds = [_kind(c) for c in t]
    c = dict.fromkeys(GIANT_SUMS, 0)
    for x, n in Counter(t).items():
        c[f"kind{_kind(x)}"] += n
        for name, is_ in (
            ("not_alnum", not x.isalnum()), ("not_digit", not x.isdigit()), ("not_alpha", not x.isalpha()), ("cased", _small_or_title(x)), ("vowels", VOWEL.match(x)),
            ("not_lower", not SMALL.match(x)), ("dots", x == "."), ("signs", x in "-@"), ("not_number", not NUMERIC.match(x)), ("decimals", x.isdecimal()),
        ):
            if is_:
                c[name] += n
    c["n"], c["turns"] = len(t), sum(a != b for a, b in zip(kinds, kinds[1:]))
    after = t[max((i for i, x in enumerate(t) if x.isdecimal()), default=-1) + 1 :]
    return [list(c.values()), t[0], t[-1], int.from_bytes(t.encode("utf-32-be", "surrogatepass"), "big") % PRIME, _word_end(t), any(x in CURRENCY for x in after)]


def _small_or_title(c: str) -> bool:
    return c.islower() or c.istitle() and not c.isupper()


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _word_end(t: str) -> str:
    return CLOSERS.sub(lambda m: "*" * ("*" in m[0][:-1]) + m[0][-1], t)[-8:]


def _word(t: str) -> object:
    return t if len(t) <= GIANT else _giant(t)


def _glue(a: object, b: object) -> object:
    if isinstance(a, str) and isinstance(b, str):
        return _word(a + b)
    x, y = (_giant(w) if isinstance(w, str) else w for w in (a, b))
    sums = add(x[0], y[0])
    sums[-1] += _kind(x[2]) != _kind(y[1])
    number = (x[3] * pow(2, 32 * y[0][0], PRIME) + y[3]) % PRIME
    return [sums, x[1], y[2], number, _word_end(x[4] + y[4]), y[5] if y[0][GIANT_SUMS.index("decimals")] else x[5] or y[5]]


class Summary:
    """A chunk: the counts of its whole lines between its open ends.

    An open end is its text up to ``LONG`` code points, and beyond that sums over its words; so neither
    a huge text nor a huge line is ever in one place, and no count depends on where chunks fall.
    """

    __slots__ = ("first", "body", "last")

    def __init__(self, first: object, body: list[int], last: object):
        self.first, self.body, self.last = first, body, last

    @classmethod
    def of(cls, text: str) -> Summary:
        lines = LINE_ENDS.split(text)
        if len(lines) == 1:
            return cls(_open(lines[0]), [0] * N, None)
        body = [0] * N
        for line in lines[1:-1]:
            count_line(line, body)
        body[0] += len(text) - sum(map(len, lines))
        return cls(_open(lines[0]), body, _open(lines[-1]))

    def __add__(self, other: Summary) -> Summary:
        body = add(self.body, other.body)
        if self.last is None:
            return Summary(_join(self.first, other.first), body, other.last)
        if other.last is None:
            return Summary(self.first, body, _join(self.last, other.first))
        return Summary(self.first, add(body, _close(_join(self.last, other.first))), other.last)

    def total(self) -> list[int]:
        out = add(self.body, _close(self.first))
        return add(out, _close(self.last)) if self.last is not None else out

    def pack(self) -> list:
        plain = lambda x: [getattr(x, k) for k in Words.__slots__] if isinstance(x, Words) else x
        return [plain(self.first), self.body, plain(self.last)]

    @classmethod
    def unpack(cls, first: object, body: list[int], last: object) -> Summary:
        rich = lambda x: Words(*x) if isinstance(x, list) else x
        return cls(rich(first), body, rich(last))


def _open(text: str) -> object:
    return text if len(text) <= LONG else Words.of(text)


def _join(a: object, b: object) -> object:
    if isinstance(a, str) and isinstance(b, str):
        return _open(a + b)
    return (Words.of(a) if isinstance(a, str) else a) + (Words.of(b) if isinstance(b, str) else b)


def _close(line: object) -> list[int]:
    return line_counts(line) if isinstance(line, str) else line.line()


LINE_ENDS = re.compile(r"\r\n|\r|\n")


def kind_of(c: list[int] | tuple, min_words: int = 20) -> str | None:
    """prose, list, table or junk by what most words are; None under ``min_words`` words."""
    g = lambda n: c[AT[n]]
    if g("words") < min_words:
        return None
    plain, items, table, junk = g("plain_words"), g("item_words"), g("table_words"), g("junk_words")
    lines = max(1, g("plain_lines"))
    mean = g("plain_len") / lines
    spread = max(0.0, g("plain_len2") / lines - mean * mean) ** 0.5 / max(1.0, mean)
    if g("numeric_lines") >= 4 and g("numeric_lines") >= 0.25 * g("lines") and mean < 40:
        # one cell per line: the cells that are words belong to the table
        table, plain = table + plain, 0
    elif lines >= 4 and mean < 75 and g("stops") * 45 < plain and (spread > 0.22 or mean < 30):
        # lines that aren't wrapped sentences: one item each
        items, plain = items + plain, 0
    elif lines >= 3 and items > 0 and g("stops") * 45 < plain and mean < 40:
        items, plain = items + plain, 0
    if junk >= max(plain, items, table):
        return "junk"
    if plain >= max(items, table):
        return "prose"
    return "table" if table > items else "list"


STATS = "n_chars long, n_words long, n_lines long, mean_word_length double, alpha_ratio double, digit_ratio double, symbol_ratio double, ended_line_share double, bullet_line_share double, common_word_share double"


def statistics(c: list[int]) -> tuple:
    g = lambda n: c[AT[n]]
    solid, words, lines = max(1, g("word_chars")), max(1, g("words")), max(1, g("lines"))
    return (
        g("chars"), g("words"), g("lines"), g("word_chars") / words, g("alpha") / solid, g("digits") / solid, g("symbols") / solid,
        g("ended") / lines, g("bulleted") / lines, g("common") / words,
    )


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The total of a text that is one chunk (``no`` is null), the summary of any other chunk."""
    import json

    for batch in batches:
        totals, packed = [], []
        for no, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            s = Summary.of(t)
            totals.append(s.total() if no is None else None)
            packed.append(None if no is None else json.dumps(s.pack()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.list_(pa.int64())), pa.array(packed, pa.string())], names=["id", "chunk", "total", "packed"])


def _merge(final: bool):
    import json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, packed = [], []
            for parts in batch.column(2).to_pylist():
                s = Summary.unpack(*json.loads(parts[0]["packed"]))
                for p in parts[1:]:
                    s = s + Summary.unpack(*json.loads(p["packed"]))
                totals.append(s.total() if final else None)
                packed.append(None if final else json.dumps(s.pack()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(totals, pa.list_(pa.int64())), pa.array(packed, pa.string())], names=["id", "chunk", "total", "packed"])

    return run


def _level(parts: DataFrame, final: bool) -> DataFrame:
    """The summaries of up to ``FAN`` neighbours, or of all that are left of a document, merged."""
    node = F.lit(0) if final else F.expr(f"chunk div {FAN}")
    lists = parts.groupBy("id", node.cast("int").alias("node")).agg(F.array_sort(F.collect_set(F.struct("chunk", "packed"))).alias("parts"))
    return lists.mapInArrow(_merge(final), SUMMARY)


def _outcomes(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = batch.column(1).to_pylist()
            stats = list(zip(*map(statistics, totals))) or [[]] * 10
            cols = [batch.column(0)] + [pa.array(v, pa.int64() if i < 3 else pa.float64()) for i, v in enumerate(stats)]
            cols.append(pa.array([kind_of(c, min_words) for c in totals], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["id", *[x.split()[0] for x in STATS.split(", ")], "kind"])

    return run


SUMMARY = "id long, chunk int, total array<long>, packed string"
#: summaries merged at a time
FAN = 64


def text_quality(df: DataFrame, id_col: str, text_col: str, chunk: int = 1 << 14, min_words: int = 20) -> DataFrame:
    """id, the statistics, and kind (prose, list, table, junk or null) of every record of ``df``; the same at every ``chunk``."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    small = rows.filter(F.length("text") <= chunk).select("id", F.lit(None).cast("int").alias("no"), "text")
    large = (
        rows.filter(F.length("text") > chunk)
        .select("id", "text", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("text") / chunk) - 1).cast("int"))).alias("no"))
        .select("id", "no", F.expr(f"substring(text, no * {chunk} + 1, {chunk})").alias("text"))
    )
    direct = small.mapInArrow(_summaries, SUMMARY).select("id", "total")
    parts = large.repartition("id", "no").mapInArrow(_summaries, SUMMARY)
    merged = _level(_level(parts, False), True).select("id", "total")
    out = direct.unionByName(merged).mapInArrow(_outcomes(min_words), f"id long, {STATS}, kind string")
    return out.dropDuplicates(["id"])
