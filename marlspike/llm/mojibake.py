"""Text that was decoded with a wrong encoding: found by automaton, restored span by span.

UTF-8 read as any of the single-byte ``CODES``: for each of them the first two
characters of every garbled sequence (of all scripts) are computed beforehand, and one
Aho-Corasick automaton finds all of them in one pass. A run of garbled characters is
decoded as one byte string; only runs that decode are replaced, so correct text beside
them stays as it is, and what was garbled twice is restored by going over it again.
A run counts if its characters can't be writing as they stand, or if several of them
decode into one script.

One single-byte code read as another, for all pairs of ``CODES``: a word is restored
if it can't be writing as it stands (a capital behind a small letter, a sign between
letters, two scripts in one word) and is without fault as the other code reads it. For
cp1252 read as mac_roman, where marks become letters, further places are told by their
neighbours.

Defined cases: null, empty and pure ASCII texts are not affected; U+FFFD, garbled or
not, marks a loss that can't be restored (affected, ``recoverable`` false); repeated
rows are reported once per id; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: single-byte encodings that are taken for one another and in which UTF-8 is read; the earlier wins where two give the same
CODES = ("cp1252", "mac_roman", "cp1251", "cp437", "cp850", "iso8859_15", "cp1250", "koi8_r")
#: pairs of single-byte codes whose garbled marks are letters, told by the rules of ``single_rules``
SINGLE = (("cp1252", "mac_roman"),)
#: signs that may stand behind any letter
AFTER = frozenset("’”“‘„‚…–—™«»‹›\xa0°²³¹ºª·•©®¡¿§†‡")
LOST = "\ufffd"


def decode(data: bytes, encoding: str) -> str:
    """Like a lenient reader: bytes the encoding doesn't define become C1 control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> dict[str, int]:
    """The byte above 0x7F that each character stands for; C1 controls stand for themselves where no other does."""
    out = {decode(bytes([b]), encoding): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All pairs of characters that begin a garbled sequence, with the codes that give them."""
    table: dict[str, list[str]] = {}
    for encoding in CODES:
        chars: dict[int, list[str]] = {}
        for c, b in byte_of(encoding).items():
            chars.setdefault(b, []).append(c)
        for lead in range(0xC2, 0xF5):
            # the second bytes that UTF-8 allows behind this one
            low, high = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
            for x in chars.get(lead, ()):
                for second in range(low, high + 1):
                    for y in chars.get(second, ()):
                        table.setdefault(x + y, []).append(encoding)
    a = ahocorasick.Automaton()
    for s, encodings in table.items():
        a.add_word(s, tuple(encodings))
    a.make_automaton()
    return a


def _one(text: str, at: int, encoding: str) -> tuple[int, str] | None:
    """(end, character) of the garbled sequence that begins at ``at``."""
    of = byte_of(encoding)
    lead = of.get(text[at], 0)
    n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
    seq = text[at : at + n]
    if not n or len(seq) < n or any(c not in of for c in seq):
        return None
    try:
        c = bytes(of[x] for x in seq).decode("utf-8")
    except UnicodeDecodeError:
        return None
    # C1 controls are halves of what was garbled twice
    return (at + n, c) if "\x80" <= c < "\xa0" or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") else None


def script(c: str) -> str:
    """The script of a letter by its code point; other characters have none."""
    if not c.isalpha() or c in "ªºµ":
        return ""
    n = ord(c)
    for end, name in ((0x250, "latin"), (0x370, "other"), (0x400, "greek"), (0x530, "cyrillic"), (0x590, "armenian"), (0x600, "hebrew"), (0x780, "arabic"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "other"), (0xAC00, "east"), (0xD7B0, "east")):
        if n < end:
            return name
    return "other"


def _telling(text: str, start: int, end: int, c: str) -> bool:
    """Whether one garbled sequence can't be writing as it stands."""
    seq, before, after = text[start:end], text[start - 1 : start], text[end : end + 1]
    if len(seq) == 4:
        return True
    if "\x80" <= c < "\xa0":
        return "\x80" <= seq[1] < "\xa0"
    if len(seq) == 3:
        return 0x1E00 <= ord(c) < 0x2C00 or ord(c) >= 0xFB00 or not any(x in AFTER for x in seq[1:])
    if seq.isalpha() and seq.isupper() and (before.isupper() or after.isupper()):
        return False  # two capitals side by side are also how capitals are written
    if seq[1] == "\xa0" and before.isupper():
        return False  # a capital, then a no-break space
    if ord(c) >= 0x180 and seq.isalpha():
        return False
    if ord(c) < 0x180:
        return seq[0] in "ÃÂÄÅ" or not (seq[0].isalpha() and seq[1] in AFTER) and not (seq[0] in AFTER and seq[1].isalpha())
    return seq[1] not in AFTER and not (seq[0] in AFTER or seq[0].islower() and seq[1].isalpha())


def _run(text: str, at: int, encoding: str) -> tuple[int, list[tuple[int, int, str]]]:
    """The garbled sequences from ``at`` on, without a gap."""
    found = []
    while at < len(text) and (one := _one(text, at, encoding)):
        found.append((at, one[0], one[1]))
        at = one[0]
    return at, found


def _accepted(text: str, run: list[tuple[int, int, str]], encoding: str) -> bool:
    start, end = run[0][0], run[-1][1]
    outside = {script(text[start - 1 : start] or " "), script(text[end : end + 1] or " ")}
    own = script(text[start])
    scripts = Counter(script(c) for *_, c in run)
    scripts.pop("", None)
    several = scripts.most_common(1)[0][1] if scripts else 0
    if own == "cyrillic" and "cyrillic" in outside:
        return several >= 3  # inside a Cyrillic word
    if own == "cyrillic" and "latin" in outside:
        return True  # two scripts in one word
    if own == "cyrillic" and several < 2:
        # two letters of their own, or a letter and a mark behind it, are writing
        return any(_telling(text, *x) and not (x[1] - x[0] == 2 and (text[x[0] + 1] in AFTER or script(text[x[0] + 1]) == "cyrillic")) for x in run)
    if len(run) > 1 and any("\x80" <= c < "\xa0" for *_, c in run):
        return True
    return several >= 2 and not (several == 2 and "latin" in scripts and any(x in AFTER for x in text[start:end])) or any(_telling(text, *x) for x in run)


def decode_runs(text: str) -> tuple[str, int]:
    """The text with its garbled UTF-8 decoded, and the number of sequences."""
    out, last, n = [], 0, 0
    for stop, encodings in automaton().iter(text):
        start = stop - 1
        if start < last:
            continue
        # the code that takes the longest run wins, the earlier among equals
        best: tuple[int, list] = (0, [])
        for encoding in encodings:
            end, run = _run(text, start, encoding)
            if run and end > best[0] and _accepted(text, run, encoding):
                best = (end, run)
        if best[1]:
            out += (text[last:start], *(c for *_, c in best[1]))
            last, n = best[0], n + len(best[1])
    return "".join(out) + text[last:], n


#: ---- one single-byte code read as another


@lru_cache(maxsize=1)
def translations() -> list[tuple[str, str, dict[int, str]]]:
    """(written, read, what each character read stands for) of all pairs of codes, by what they were read as."""
    out = []
    for read in CODES:
        for wrote in CODES:
            table = {ord(seen): decode(bytes([b]), wrote) for seen, b in byte_of(read).items()}
            table = {k: v for k, v in table.items() if chr(k) != v}
            if wrote != read and table:
                out.append((wrote, read, table))
    return out


HIGH_WORD = re.compile(r"[^\s\x00-\x7f]*[A-Za-z]*[^\s\x00-\x7f][^\s\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]*")
_MARKS = frozenset("’‘'´`·-‐‑–—…“”„«»‹›.,;:!?()[]{}\"/ªº\xad\u200b\u200c\u200d\u2060\ufeff")


def faults(word: str) -> int:
    """The characters of a word that can't stand where they do: a capital behind a small letter, a sign between letters, a second script."""
    n = 0
    for i, c in enumerate(word):
        if c < "\x80" or c in _MARKS or unicodedata.combining(c):
            continue
        before, after = word[i - 1 : i], word[i + 1 : i + 2]
        if "\x80" <= c < "\xa0":
            n += 1
        elif script(c):
            beside = {script(x) for x in (before, after) if x} - {""}
            n += bool(beside - {script(c)}) or c.isupper() and before.islower() and before.isalpha()
        else:
            n += bool(before and after and script(before) and script(after))
    return n


def _accented(c: str) -> bool:
    return script(c) == "latin"


@lru_cache(maxsize=1 << 15)
def other_codes(word: str) -> tuple[tuple[int, str], ...]:
    """(number of the pair, word as written) of the pairs of codes that read a faulty word without fault."""
    if len(word) < 4 or not faults(word):
        return ()
    high = [c for c in word if c > "\x7f" and c not in "’‘"]
    if sum(map(str.isalpha, word)) < 3 or len(set(high)) < 2 and len(high) > 2:
        return ()
    out = []
    for k, (_, _, table) in enumerate(translations()):
        if all(ord(c) in table for c in high):
            fixed = word.translate(table)
            letters = [c for c in fixed if c > "\x7f"]
            # a Latin word has more plain letters than others
            if 2 * sum(map(_accented, letters)) > sum(map(str.isalpha, fixed)):
                continue
            if letters and all(c.isalpha() and script(c) in ("latin", "greek", "cyrillic") for c in letters) and not faults(fixed) and (fixed.islower() or fixed.istitle() or fixed.isupper() and word.isupper()):
                out.append((k, fixed))
    return tuple(out)


#: marks that don't stand right behind a small letter, or between two
_CYRILLIC = re.compile(r"(?<!\w)[А-я]*[А-Я]{2}[А-я]*(?!\w)")
_ATTACHED = re.compile(r"(?<=[a-z])[†‡ˆ˜‰™](?![A-Z])|(?<=[a-z])–(?=[a-z])")


def other_code(text: str) -> tuple[str, int, bool]:
    """The text with the words restored that one pair of codes explains, that of most words; their number, and whether nothing is left."""
    votes: Counter = Counter()
    found: list[tuple[int, int, tuple]] = []
    for m in HIGH_WORD.finditer(text):
        reads = other_codes(m.group())
        if reads:
            found.append((*m.span(), reads))
            votes.update(k for k, _ in reads)
    if not votes:
        return text, 0, True
    best = max(votes, key=lambda k: (votes[k], -k))
    out, last, n = [], 0, 0
    for a, b, reads in found:
        for k, fixed in reads:
            if k == best:
                out += (text[last:a], fixed)
                last, n = b, n + 1
    fixed = "".join(out) + text[last:]
    wrote, read, table = translations()[best]
    if {wrote, read} == {"cp1251", "koi8_r"}:
        # of two codes of one script, words all in capitals are without fault either way
        fixed = _CYRILLIC.sub(lambda m: t if (t := m.group().translate(table)).islower() or t.istitle() else m.group(), fixed)
    # with a witness, marks attached to words are told too
    fixed = _ATTACHED.sub(lambda m: t if (t := m.group().translate(table)).isalpha() else m.group(), fixed)
    left = any(c > "\x7f" and script(c) != "cyrillic" and ord(c) in table and script(c) != "latin" and table[ord(c)].isalpha() and c not in "“”«»°•·§" for c in fixed)
    return fixed, n, not left


@lru_cache(maxsize=1)
def single_rules() -> tuple[list[tuple[re.Pattern, dict[str, str]]], list[tuple[re.Pattern, dict[str, str]]]]:
    """Where one garbled character can be told from writing, and what it stands for.

    The first list needs no other witness; the second holds only beside a match of the first.
    """
    strong, weak = [], []
    for wrote, read in SINGLE:
        capitals, signs, others = {}, {}, {}
        for b in range(0x80, 0x100):
            original, seen = decode(bytes([b]), wrote), decode(bytes([b]), read)
            if original == seen or seen.isascii() or ord(original) < 0xA0 or original == "ƒ":
                continue
            if original.isalpha() and original.islower() and seen.isalpha() and seen.isupper():
                capitals[seen] = original
            elif original.isalpha() and original.islower() and not seen.isalnum() and seen not in "“”‘’«»–—…•":
                signs[seen] = original
            elif not original.isalnum() and seen.isalpha():
                others[seen] = original
        at = {v: k for k, v in others.items()}
        cls = lambda cs: "[" + "".join(map(re.escape, cs)) + "]"
        of = lambda cs: cls([at[c] for c in cs if c in at])
        low = r"[^\W\d_A-ZÀ-ÖØ-Þ]"
        table = capitals | signs | others
        strong += [
            (re.compile(rf"(?<=[^\W\d_]){cls(capitals)}(?={low}|{cls(signs)})|(?<={low}){cls(capitals)}(?!\w)"), table),
            (re.compile(rf"(?<=[^\W\d_]){cls(signs)}(?=[^\W\d_]|{cls(signs)}|{cls(capitals)})"), table),
            (re.compile(rf"(?<={low}{{3}}){of('…')}(?!\w)"), table),
            (re.compile(rf"(?<!\w){of('“')}(?=\w{{3}}|[A-Z])|(?<=[\w.,!?]{{3}}){of('”')}(?!\w)|(?<!\S){of('•')}(?= )"), table),
            (re.compile(rf"(?<=[A-Za-z]r){of('’')}(?=s\b)(?<!pa.)|(?<=\bIt){of('’')}(?=s\b)|(?<=[A-Za-z]{{4}}s){of('’')}(?!\w)"), table),
        ]
        weak += [
            (re.compile(rf"(?<!\w){of('“‘•–—')}|(?<=[\w.,!?]){of('”')}(?!\w)"), table),
            (re.compile(rf"(?<=[A-Za-z]){of('’')}(?=s\b)|(?<=s){of('’')}(?!\w)|(?<=\w){of('…')}(?!\w)"), table),
            (re.compile(rf"(?<=[^\W\d_])(?:{cls(signs)}|{cls(capitals)})"), table),
        ]
    return strong, weak


def restore(text: str) -> tuple[str, int, bool]:
    """The text with garbled spans replaced, the number of spans, and whether nothing was lost."""
    if text.isascii():
        return text, 0, True
    fixed, n = decode_runs(text)
    again = n
    # garbled twice or more: each round makes the text shorter
    while again:
        fixed, again = decode_runs(fixed)
        n += again
    strong, weak = single_rules()
    hits = sum(len(p.findall(fixed)) for p, _ in strong)
    if hits:
        for pattern, table in strong + weak:
            fixed = pattern.sub(lambda m, t=table: "".join(t.get(c, c) for c in m.group()), fixed)
        n += hits
    fixed, more, whole = other_code(fixed)
    n += more
    lost = fixed.count(LOST)
    return fixed, n + lost, whole and not lost


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans, whole = [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fixed, n, ok = restore(text)
            if n:
                ids.append(i)
                texts.append(fixed)
                spans.append(n)
                whole.append(ok)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, pa.int32()), pa.array(whole, pa.bool_())],
            names=["id", "restored", "n_spans", "recoverable"],
        )


def repair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The affected records: id, restored, n_spans, recoverable. ASCII texts never leave the JVM."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") > F.length("text"))
    return rows.mapInArrow(_repair, "id long, restored string, n_spans int, recoverable boolean")
