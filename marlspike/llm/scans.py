"""Noise of scanned pages found and repaired: cut words, misread characters, running titles, page numbers.

Titles are edge lines that come again on neighbouring pages of the source, compared
by a skeleton in which characters that recognition confuses are one. Page numbers are
edge lines of nothing but a number, decorated, or in sequence with the pages. A word
cut at a line's end is rejoined by the corpus vocabulary: the joined form against the
hyphenated one. A token is misread when undoing a known confusion turns it into a word
that is far more frequent. Lines are then joined to paragraphs.

Everything that grows with the corpus (vocabulary, titles, breaks) is joined, not sent
out; only the ``known_words`` most frequent words go to the workers, as a shortcut that
settles most tokens on the spot; the other tokens are joined with the misread ones.

Defined cases: null, blank and junk pages and pages under ``min_words`` words have no
noise; records without a page number aren't scanned; repeated rows (the same id) count
once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import quality
from .pairs import LANGUAGES, language
from .vocabulary import frequent

#: what recognition writes -> what stood there; fixed values
CONFUSED = (
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("m", "in"), ("n", "ri"), ("c", "e"), ("ä", "a"), ("0", "o"), ("!", "i"), ("†", "t"), ("5", "s"),
    ("I", "l"), ("1", "l"), ("¢", "c"), ("|", "l"), ("b", "h"), ("9", "g"), ("$", "s"), ("1", "i"), ("li", "h"), ("6", "b"), ("8", "B"), ("£", "e"), ("€", "e"), ("@", "a"), ("d", "cl"), ("m", "rn"),
)
#: the languages that a word tells
TELLING = {w: frozenset(k for k, ws in LANGUAGES.items() if w in ws) for ws in LANGUAGES.values() for w in ws}
HYPHENS = "-‐\xad¬‑–"
EDGE = ".,;:()[]{}\"'“”’‘?*–—…`"
PLAIN = re.compile(r"[^\W\d_]+(?:[-'’‑][^\W\d_]+)*")
CUT = re.compile(rf"([^\W_][\w!|†¢$-]*)[{HYPHENS}]\s*$")
LINE_END_CUT = re.compile(rf"[{HYPHENS}][^\S\n]*\n")
#: a run of more code points is no word
LONGEST = 64
NEXT = re.compile(r"\s*([^\W_][\w!|†¢$'’-]*)")
#: a number of any length; the possessive parts keep the time for long lines of marks in proportion to their length
NUMBER_LINE = re.compile(
    r"(?:\W*+(?=\w)|[^\w|!]*+(?=[|!]))(?:(?:page|p|pg|pahina)\b\.?\s*+)?((?:[0-9IlS|!]|o(?!f))++|[ivxlc]++)\W*(?:(?:of|/)\s*+\d++\W*+)?", re.I
)


def tokens(line: str) -> list[str]:
    return [t for t in (w.strip(EDGE) for w in line.split()) if t]


def form(token: str) -> str:
    """Lower case where the case is regular; a capital inside a word is a trace of recognition."""
    return token.lower() if token.islower() or token.isupper() or token[:1].isupper() and token[1:].islower() else token


def undone(token: str) -> list[str]:
    """The words that a token may stand for: one or two confusions undone, of the same or two kinds."""
    # a small l at the beginning may have been read as a capital I, which lower case hides
    once: dict[str, None] = {"l" + token[1:]: None} if token[:1] in ("i", "I") else {}
    for wrong, right in CONFUSED:
        at = token.find(wrong)
        while at >= 0:
            once[token[:at] + right + token[at + len(wrong) :]] = None
            at = token.find(wrong, at + 1)
    out = dict(once)
    if len(token) >= 6:
        for t in once:
            for wrong, right in CONFUSED[:4] + CONFUSED[6:22]:
                at = t.find(wrong)
                while at >= 0:
                    out[t[:at] + right + t[at + len(wrong) :]] = None
                    at = t.find(wrong, at + 1)
    return [t.lower() for t in out if PLAIN.fullmatch(t) and t.lower() != token.lower()]


def _lines(text: str) -> list[str]:
    return text.split("\n")


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, n: the whole tokens of each batch; the pieces of words cut at a line's end are left out."""
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.split())
            if LINE_END_CUT.search(text):
                counts.subtract(_pieces(text))
        if len(counts) > 300_000:
            yield _emit(counts)
            counts = Counter()
    yield _emit(counts)


def _pieces(text: str) -> list[str]:
    """The pieces of the words that are cut at line ends."""
    out: list[str] = []
    before = False
    for line in _lines(text):
        end = line.rstrip()
        if not end:
            continue
        if before:
            words = line.split()
            out.append(words[0])
            if len(words) == 1:
                before = False
                continue
        before = end[-1] in HYPHENS and CUT.search(end) is not None
        if before:
            out.append(end.split()[-1])
    return out


def _emit(counts: Counter) -> pa.RecordBatch:
    out: Counter = Counter()
    for word, n in counts.items():
        t = word.strip(EDGE)
        if n > 0 and 1 < len(t) <= LONGEST and any(map(str.isalpha, t)):
            out[form(t)] += n
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=["token", "n"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, n, b = [], [], []
        for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for c in undone(t):
                a.append(t)
                n.append(k)
                b.append(c)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.string())], names=["token", "n", "word"])


def misread_tokens(vocabulary: DataFrame, rarer: float = 0.05, least: int = 3) -> DataFrame:
    """token, word: the tokens that stand for a word ``1/rarer`` times as frequent."""
    made = vocabulary.mapInArrow(_candidates, "token string, n long, word string")
    found = made.join(vocabulary.select(F.col("token").alias("word"), F.col("n").alias("n_word")), "word")
    ok = (F.col("n_word") >= least) & (F.col("n") <= F.col("n_word") * F.lit(rarer))
    # a sign or digit within letters is no word of its own: it needs no such odds
    odd = F.col("token").rlike(r"\p{L}[0-9!|†¢$@£€]\p{L}|^[0-9!|†¢$£€]\p{L}{2}|\p{L}{2}[0-9|†¢$£€]$|\p{Ll}I") & (F.col("n_word") >= least)
    return found.filter(ok | odd).groupBy("token").agg(F.max_by("word", F.struct("n_word", "word")).alias("word"))


def skeleton(line: str) -> str:
    """A title without number and marks, characters that are confused made one."""
    s = line.strip()
    s = re.sub(r"^\W*(?:(?:page|p|pg)\b\.?\s*)?(?:[0-9OIl|!]*\d[0-9OIl|!]*|[ivxlc]+|[OIl|!]{1,2}(?=\s))\W*\s+(?=\S)", "", s, flags=re.I if re.match(r"\W*(page|p\.)", s, re.I) else 0)
    s = re.sub(r"\s+\W*(?:(?:page|p|pg)\b\.?\s*)?(?:[0-9OIl|!]*\d[0-9OIl|!]*|[ivxlc]+|[OIl|!]{1,2})\W*$", "", s)
    s = s.lower()
    for a, b in (("†", "t"), ("¢", "c"), ("$", "s"), ("0", "o"), ("5", "s"), ("9", "g"), ("ä", "a"), ("é", "e"), ("ö", "o"), ("!", "i"), ("|", "l"), ("1", "l"), ("rn", "m"), ("in", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("i", "l"), ("c", "e"), ("b", "h")):
        s = s.replace(a, b)
    return re.sub(r"[\W\d_]+", " ", s).strip()


def number_of(line: str) -> tuple[int | None, bool]:
    """(value, decorated) of a line that holds nothing but a page number."""
    s = line.strip()
    m = NUMBER_LINE.fullmatch(s)
    if not m:
        return None, False
    raw = m.group(1)
    marks = not raw.strip("|!")
    if marks and (len(s) > 16 or re.search(r"[|!]", s[m.end(1) :])):
        return None, False  # cells and rules of a table, not a misread number
    digits = raw.translate(str.maketrans("OoIlS|!", "0011511"))
    # a mark before it, a word, or a total behind it; a full stop alone also ends a sentence
    decorated = m.start(1) > 0 or re.search(r"[/)\]>~|–—-]|of", s[m.end(1) :]) is not None
    if digits.isdigit() and (any(map(str.isdigit, raw)) or decorated or marks and len(raw) > 1):
        # beyond 18 digits no page is numbered: such a number is in no sequence
        return int(digits) if len(digits) <= 18 else 10**18, decorated
    return roman(raw.lower()), decorated


def roman(s: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    if not s or any(c not in values for c in s):
        return None
    n = [values[c] for c in s]
    total = sum(-a if a < b else a for a, b in zip(n, n[1:] + [0]))
    ones = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
    tens = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
    back = "c" * (total // 100) + tens[total % 100 // 10] + ones[total % 10]
    return total if back == s else None


EDGE_ROW = (("line_no", pa.int32()), ("what", pa.string()), ("skeleton", pa.string()), ("value", pa.int64()), ("decorated", pa.bool_()), ("first", pa.string()), ("cut", pa.string()))
CUT_ROW = (("line_no", pa.int32()), ("a", pa.string()), ("b", pa.string()), ("b_line", pa.int32()))
TOKEN_ROW = (("line_no", pa.int32()), ("token", pa.string()))
PAGE = (
    "raw_id long, source string, seq int, page int, prose boolean, edges array<struct<line_no int, what string, skeleton string, value long, decorated boolean, first string, cut string>>, "
    "cuts array<struct<line_no int, a string, b string, b_line int>>, tokens array<struct<line_no int, token string>>"
)
#: lines taken at either edge of a page: two that may be noise, and the text beside them
DEPTH = 3
NOT_TITLE = re.compile(r"[.;,?!][\"'”’)]*$|\s\|\s|\t|^[a-z ]+: ")
TITLE_START = re.compile(r"\W*(?:page |p\. ?)?[\w|!†$¢]*\W*(?:[0-9|!†$¢]|[^\W\d_a-z])")
#: a title is printed on one line: a line of more code points is none
TITLE_LENGTH = 300


def title_like(line: str) -> bool:
    """A line that begins with a capital or number and doesn't end like a sentence."""
    return len(line) <= TITLE_LENGTH and NOT_TITLE.search(line) is None and TITLE_START.match(line) is not None


def at_home(token: str, line: str) -> bool:
    """Whether a token is a telling word of a language, and the line, read without it, is of that language."""
    langs = TELLING.get(token)
    return langs is not None and language(re.sub(rf"(?<!\w){re.escape(token)}(?!\w)", " ", line, flags=re.I))[0] in langs


def _lists(rows: list[list[tuple]], fields: tuple) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    cols = list(zip(*(x for r in rows for x in r))) or [()] * len(fields)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)


def _pages(known: object, min_words: int):
    """One row a page that isn't junk: its edge lines ("top0" to "top2", "end2" to "end0"), words cut at line ends, unknown tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = known.value
        # spellings with marks that have been looked up before
        settled: set[str] = set()
        for batch in batches:
            heads, edges, cuts, tokens = [], [], [], []
            for raw_id, source, seq, page, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kind = quality.kind_only(text, min_words)
                if kind is None or kind == "junk":
                    continue
                if len(settled) > 200_000:
                    settled.clear()
                heads.append((raw_id, source, seq, page, kind == "prose"))
                unknown = {}
                for w in set(text.split()) - settled:
                    t = w.strip(EDGE)
                    f = form(t) if t else t
                    if t and f not in sure and len(t) <= LONGEST and any(map(str.isalpha, t)):
                        unknown[w] = f
                    else:
                        settled.add(w)
                lines = _lines(text)
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                at_edge = {i: f"top{k}" for k, i in enumerate(full[:DEPTH])} | {i: f"end{k}" for k, i in enumerate(full[: -DEPTH - 1 : -1]) if i not in full[:DEPTH]}
                own_edges, own_cuts, own_tokens = [], [], []
                broken = False
                for at, i in enumerate(full):
                    line = lines[i]
                    m = CUT.search(line) if line.rstrip()[-1] in HYPHENS else None
                    what = at_edge.get(i)
                    if what:
                        trimmed = line.strip()
                        value, decorated = number_of(trimmed)
                        first = NEXT.match(line)
                        title = skeleton(trimmed) if what[-1] < "2" and value is None and title_like(trimmed) else None
                        own_edges.append((i, what, title, value, decorated, first.group(1) if first else "", m.group(1) if m else ""))
                    if m and at + 1 < len(full):
                        n = NEXT.match(lines[full[at + 1]])
                        if n:
                            own_cuts.append((i, m.group(1), n.group(1).strip("'’"), full[at + 1]))
                    if unknown:
                        words = line.split()
                        if not unknown.keys().isdisjoint(words):
                            # the pieces of cut words are no tokens
                            words = words[broken : len(words) - (m is not None)]
                            own_tokens += [(i, f) for f in dict.fromkeys(unknown[w] for w in words if w in unknown) if not at_home(f, line)]
                    broken = m is not None
                edges.append(own_edges)
                cuts.append(own_cuts)
                tokens.append(own_tokens)
            cols = list(zip(*heads)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, t) for c, t in zip(cols, types)), _lists(edges, EDGE_ROW), _lists(cuts, CUT_ROW), _lists(tokens, TOKEN_ROW)],
                names=["raw_id", "source", "seq", "page", "prose", "edges", "cuts", "tokens"],
            )

    return run


def near(line: str, title: str | Column) -> Column:
    """Whether ``line`` is within a quarter of the title's length."""
    t = F.col(title) if isinstance(title, str) else title
    most = F.greatest(F.lit(1), F.floor(F.length(t) / 4)).cast("int")
    return (F.abs(F.length(line) - F.length(t)) <= most) & (F.levenshtein(F.col(line), t) <= most)


#: pages of a block in which a title has to come again, and titles of a source that are compared without a join
BESIDE, LISTED = 16, 16


def titles(edges: DataFrame, salts: int = 16) -> DataFrame:
    """(source, skeleton) of the edge lines that are titles, or near one: source, seq, prose, skeleton of edge lines.

    A title comes again in its source, on neighbouring pages for half of its occurrences (a line of text comes
    again by chance, far away), and stands on pages of prose for a third (the last lines of tables repeat too).
    A title of two sources is one everywhere. Sources of few titles carry them as a list to their lines, those of
    more are joined by pieces; both ways give the same.
    """
    lines = edges.filter(F.length("skeleton") >= 4)
    placed = lines.groupBy("source", "skeleton", F.floor(F.col("seq") / BESIDE).alias("block")).agg(F.count("*").alias("n"), F.sum(F.col("prose").cast("int")).alias("on_prose"))
    # of the first level every block is one row, so a title on all pages of a hot source is no task's alone
    beside = F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0))
    seen = cut(placed.groupBy("source", "skeleton").agg(F.sum("n").alias("n"), F.sum("on_prose").alias("on_prose"), beside.alias("beside")))
    mine = seen.filter((F.length("skeleton") >= 6) & (F.col("n") >= 2) & (F.col("on_prose") * 3 >= F.col("n")) & (F.col("beside") * 2 >= F.col("n"))).select("source", "skeleton")
    many = mine.groupBy("skeleton").agg(F.count("*").alias("n")).filter("n >= 2").select("skeleton")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("skeleton"))).filter(F.col("rank") <= LISTED + 1)
    lists = ranked.groupBy("source").agg(F.collect_list("skeleton").alias("titles"))
    few = lists.filter(F.size("titles") <= LISTED).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    salted = seen.select("source", "skeleton", F.pmod(F.xxhash64("skeleton"), F.lit(salts)).cast("int").alias("salt"))
    listed = salted.join(few, ["source", "salt"]).filter(F.exists("titles", lambda t: near("skeleton", t))).select("source", "skeleton")
    long = lists.filter(F.size("titles") > LISTED).select("source")
    joined = near_titles(seen.join(long, "source", "left_semi").select("source", "skeleton"), mine.join(long, "source", "left_semi"))
    everywhere = seen.join(many, "skeleton", "left_semi").select("source", "skeleton")
    return listed.unionByName(joined).unionByName(everywhere).distinct()


def near_titles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """The (source, skeleton) of ``lines`` that are near one of the source's ``titles``, every one of them.

    Of k + 1 pieces of a title at least one is untouched by k edits, and at most k places from where it was:
    lines and titles meet on the first three characters of the pieces (two, where a piece has no more).
    """
    n = F.length("title")
    parts = titles.select("source", F.col("skeleton").alias("title")).withColumn("k", F.greatest(F.lit(1), F.floor(n / 4)).cast("int"))
    parts = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    parts = parts.withColumn("at", F.expr("cast(i * length(title) div (k + 1) as int) + 1")).withColumn("end", F.expr("cast((i + 1) * length(title) div (k + 1) as int) + 1"))
    parts = parts.withColumn("gram", F.expr("substring(title, at, least(3, end - at))"))
    grams = lines.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("skeleton") - 1)))
    grams = grams.withColumn("gram", F.explode(F.array(F.expr("substring(skeleton, p, 3)"), F.expr("if(length(skeleton) between 4 and 10, substring(skeleton, p, 2), null)")))).filter("gram is not null")
    met = grams.join(parts, ["source", "gram"]).filter((F.abs(F.col("p") - F.col("at")) <= F.col("k")) & near("skeleton", "title"))
    return met.select("source", "skeleton").distinct()


class Scans:
    """What was found: ``noise`` (raw_id, line_no, noise) and ``fixes`` (raw_id, line_no, action, a, b)."""

    def __init__(self, noise: DataFrame, fixes: DataFrame):
        self.noise, self.fixes = noise, fixes


def scan_noise(df: DataFrame, known_words: int = 65_536, min_words: int = 20, salts: int = 16) -> Scans:
    """Noise of the pages of ``df``: raw_id, source, seq, page, page_content (a driver table's column names)."""
    rows = df.select("raw_id", "source", "seq", "page", "page_content").filter("raw_id is not null and page_content is not null")
    vocabulary = cut(rows.select("page_content").mapInArrow(_vocabulary, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    misread = cut(misread_tokens(vocabulary))
    # frequent words that aren't misread: at most known_words of them, whatever the corpus
    known = df.sparkSession.sparkContext.broadcast(frequent(vocabulary.join(misread, "token", "left_anti"), "token", "n", known_words))
    pages = rows.filter("page is not null and source is not null and seq is not null").mapInArrow(_pages(known, min_words), PAGE)
    pages = cut(pages.dropDuplicates(["raw_id"]))

    # the two outer lines of either edge: numbers and titles
    edges = pages.select("raw_id", "source", "seq", "page", "prose", F.explode("edges").alias("e")).filter(F.col("e.what").isin("top0", "top1", "end0", "end1"))
    marked = edges.filter("e.skeleton is not null").select("raw_id", "source", "seq", "prose", "e.what", "e.line_no", "e.skeleton")
    headers = marked.join(titles(marked, salts), ["source", "skeleton"], "left_semi").select("raw_id", "what", "line_no", F.lit("header").alias("noise"))
    numbers = edges.filter("e.value is not null").select("raw_id", "source", (F.col("e.value") - F.col("page")).alias("offset"), "e.decorated", "e.what", "e.line_no")
    # a bare number counts if it is the page's, or runs with the numbers of other pages
    running = numbers.groupBy("source", "offset").agg(F.min("raw_id").alias("x"), F.max("raw_id").alias("y")).filter("x < y").select("source", "offset")
    alone = F.col("decorated") | (F.col("offset") == 0)
    counted = numbers.filter(alone).drop("decorated").unionByName(numbers.filter(~alone).drop("decorated").join(running, ["source", "offset"], "left_semi"))
    noted = headers.unionByName(counted.select("raw_id", "what", "line_no", F.lit("page_number").alias("noise")))
    # at most four a page
    noted = noted.groupBy("raw_id").agg(F.collect_list(F.struct("what", "line_no", "noise")).alias("noted"))

    none = "cast(array() as array<struct<what string, line_no int, noise string>>)"
    x = pages.join(noted, "raw_id", "left").withColumn("noted", F.coalesce("noted", F.expr(none)))
    # the second line of an edge counts if the outer one does
    x = x.withColumn("heads", F.expr("filter(noted, m -> right(m.what, 1) = '0' or exists(noted, o -> o.what = concat(left(m.what, 3), '0')))"))
    x = x.withColumn("gone", F.expr("transform(heads, h -> h.line_no)"))
    x = x.withColumn("body", F.expr("array_sort(filter(edges, e -> not array_contains(gone, e.line_no)))"))
    x = cut(
        x.select(
            "raw_id", "source", "seq", "heads", F.expr("try_element_at(body, 1)").alias("first"), F.expr("try_element_at(body, -1)").alias("last"),
            F.expr("filter(cuts, c -> not array_contains(gone, c.line_no) and not array_contains(gone, c.b_line))").alias("cuts"),
            F.expr("filter(tokens, t -> not array_contains(gone, t.line_no))").alias("tokens"),
        )
    )
    heads = x.select("raw_id", F.explode("heads").alias("h")).select("raw_id", "h.line_no", "h.noise")

    # words cut within a page, and across pages: the last line of text of one page, the first of the next
    within = x.select("raw_id", F.explode("cuts").alias("c")).select("raw_id", "c.line_no", "c.a", "c.b", F.col("raw_id").alias("b_id"), "c.b_line")
    ends = x.filter(F.expr("last.cut <> '' and not exists(cuts, c -> c.line_no = last.line_no)")).select("raw_id", "source", (F.col("seq") + 1).alias("seq"), "last.line_no", F.col("last.cut").alias("a"))
    starts = x.filter("first.first <> ''").select("source", "seq", F.col("raw_id").alias("b_id"), F.col("first.first").alias("b"), F.col("first.line_no").alias("b_line"))
    across = ends.join(starts, ["source", "seq"]).select("raw_id", "line_no", "a", "b", "b_id", "b_line").dropDuplicates(["raw_id"])
    breaks = within.unionByName(across)
    cuts = cut(breaks.join(cut_words(breaks.select("a", "b").distinct(), vocabulary), ["a", "b"]))

    hyphen = cuts.filter("whole").select("raw_id", "line_no", F.lit("hyphen").alias("noise"))
    # where a corrected cut word differs from its pieces: in the first or in the second line
    in_a = ~F.startswith(F.col("word"), F.lower("a"))
    broken = cuts.filter("word is not null").select(F.when(in_a, F.struct("raw_id", "line_no")).otherwise(F.struct(F.col("b_id").alias("raw_id"), F.col("b_line").alias("line_no"))).alias("x")).select("x.*")
    bad = x.select("raw_id", F.explode("tokens").alias("t")).select("raw_id", "t.line_no", "t.token").join(misread, "token")
    lines = bad.select("raw_id", "line_no").unionByName(broken).distinct()
    noise = heads.unionByName(hyphen).unionByName(lines.withColumn("noise", F.lit("misread")))
    none = F.lit(None).cast("string")
    fixes = (
        heads.select("raw_id", "line_no", F.lit("drop").alias("action"), none.alias("a"), none.alias("b"))
        .unionByName(bad.select("raw_id", "line_no", F.lit("word").alias("action"), F.col("token").alias("a"), F.col("word").alias("b")))
        .unionByName(cuts.select("raw_id", "line_no", F.lit("join").alias("action"), "a", F.coalesce("word", F.when(F.col("whole"), F.concat("a", "b")).otherwise(F.concat("a", F.lit("-"), "b"))).alias("b")))
        .unionByName(cuts.select(F.col("b_id").alias("raw_id"), F.col("b_line").alias("line_no"), F.lit("given").alias("action"), F.col("b").alias("a"), none.alias("b")))
    )
    return Scans(noise, fixes)


def cut_words(ab: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """a, b, whole, word: whether the pieces make one word, and its corrected form where a character is misread."""
    forms = {"joined": F.concat("a", "b"), "hyphened": F.concat("a", F.lit("-"), "b"), "la": F.col("a"), "lb": F.col("b")}
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lower(c).alias("token")) for k, c in forms.items()))).alias("k")
    counted = ab.select("a", "b", keys).select("a", "b", "k.kind", "k.token").join(vocabulary, "token")
    count = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"n_{kind}")
    ab = ab.join(counted.groupBy("a", "b").agg(*map(count, forms)), ["a", "b"], "left").fillna(0, [f"n_{k}" for k in forms])
    ab = cut(ab)
    # a joined form with a misread character is looked up corrected
    loose = ab.filter("n_joined = 0 and n_hyphened = 0").select("a", "b").mapInArrow(_corrected, "a string, b string, kind string, word string")
    loose = loose.join(vocabulary.filter("n >= 3").withColumnRenamed("token", "word"), "word")
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("n", "word")))["word"].alias(f"w_{kind}")
    ab = ab.join(loose.groupBy("a", "b").agg(best("joined"), best("hyphened")), ["a", "b"], "left")
    # both pieces words, neither form known: two words of a compound; otherwise a cut word
    compound = (F.col("n_hyphened") >= F.col("n_joined")) & (F.col("n_hyphened") > 0)
    unknown = (F.col("n_hyphened") == 0) & (F.col("n_joined") == 0)
    words = (F.col("n_la") >= 20) & (F.col("n_lb") >= 20)
    whole = ~compound & ~(unknown & F.col("w_joined").isNull() & (F.col("w_hyphened").isNotNull() | words))
    lower = F.col("b").rlike(r"^[\p{Ll}0-9!|†¢$]") | (F.upper("a") == F.col("a"))
    return ab.select("a", "b", (whole & lower).alias("whole"), F.coalesce("w_joined", "w_hyphened").alias("word"))


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that the pieces, joined or hyphenated, may stand for."""
    for batch in batches:
        rows = [
            (a, b, kind, word)
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for kind, token in (("joined", a + b), ("hyphened", f"{a}-{b}"))
            for word in undone(token)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 4], names=["a", "b", "kind", "word"])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for text, fixes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append(repaired(text, fixes or []))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["raw_id", "repaired"])


def repaired(text: str, fixes: list[dict]) -> str:
    """The text with its fixes applied and its lines joined to paragraphs."""
    by: dict[int, list[dict]] = {}
    for f in fixes:
        by.setdefault(f["line_no"], []).append(f)
    lines: list[str | None] = []
    for i, line in enumerate(_lines(text)):
        own = by.get(i, ())
        if any(f["action"] == "drop" for f in own):
            lines.append(None)
            continue
        for f in own:
            if f["action"] == "given":
                line = re.sub(rf"^\s*{re.escape(f['a'])}['’]?", "", line, count=1)
            elif f["action"] == "join":
                line = CUT.sub(lambda m, w=f["b"]: w, line, count=1)
        for f in own:
            if f["action"] == "word":
                line = re.sub(rf"(?<!\w){re.escape(f['a'])}(?!\w)", lambda m, w=f["b"]: w.capitalize() if m.group()[0].isupper() else w, line, flags=re.I)
        lines.append(line.strip("\r "))
    parts: list[list[str]] = [[]]
    for line in lines:
        if line is None:
            continue
        if not line.strip():
            parts.append([])
        elif line.startswith((".", ",", ";", ":", ")", "?", "!")) and parts[-1]:
            parts[-1][-1] += line
        else:
            parts[-1].append(line.strip())
    return "\n\n".join(" ".join(p) for p in parts if p)


def repair(df: DataFrame, scans: Scans) -> DataFrame:
    """raw_id, repaired: the pages of ``df`` with noise, as continuous paragraphs."""
    fixes = scans.fixes.groupBy("raw_id").agg(F.collect_set(F.struct("line_no", "action", "a", "b")).alias("fixes"))
    rows = df.select("raw_id", "page_content").join(fixes, "raw_id").dropDuplicates(["raw_id"])
    return rows.mapInArrow(_repair, "raw_id long, repaired string")

