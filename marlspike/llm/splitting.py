"""Oversized texts cut into pieces under a token limit, at natural boundaries, with an overlap.

The prefix sums of the tokens tell where the limit falls; the boundaries (ends of
paragraphs, lines, sentences, words) are sorted arrays, and the last one under the
limit is found by binary search, the strongest kind first. The next piece begins
the overlap before the cut, at the start of a word. Without a boundary in reach
the text is cut at the limit itself.

Tokens here are a quarter of the code points left after white space is removed at
both ends, rounded down; ``weights`` takes any other additive measure.

Defined cases: null and blank texts and texts within the limit give no piece here
(``split`` is for oversized ones; ``pieces`` returns such a text whole); repeated
rows are cut once per id; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the kinds of boundaries, strongest first: a piece may end where a match ends
BOUNDARIES = tuple(map(re.compile, (r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*", r"(?:\r\n|\r|\n)+|(?<=[.!?…])[\"'”’)\]]*\s+", r"\s+")))
#: a weaker boundary is taken where the stronger kinds would leave a piece less full than this
FILL = 0.5


def prefix_sums(text: str, weights: Callable[[str], np.ndarray] | None = None) -> np.ndarray:
    """Tokens (or quarters of them) before each code point."""
    if weights is None:
        return np.arange(len(text) + 1)
    return np.concatenate(([0], np.cumsum(weights(text))))


def pieces(text: str, limit: int, overlap: int, weights: Callable[[str], np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece; one piece if the text is within the limit, none if it is blank."""
    body = text.strip()
    if not body:
        return []
    lead = len(text) - len(text.lstrip())
    unit = 4 if weights is None else 1
    sums = prefix_sums(body, weights)
    size = lambda a, b: int(sums[b] - sums[a]) // unit
    n = len(body)
    if size(0, n) <= limit:
        return [(lead, lead + n, size(0, n))]
    most, back = limit * unit + unit - 1, overlap * unit
    ends = [np.array([m.end() for m in b.finditer(body)] or [0]) for b in BOUNDARIES]
    stops = [np.array([m.start() for m in b.finditer(body)] or [0]) for b in BOUNDARIES]
    words = ends[-1]
    out, a = [], 0
    while True:
        reach = int(np.searchsorted(sums, sums[a] + most, "right")) - 1
        if reach >= n:
            out.append((lead + a, lead + n, size(a, n)))
            return out
        reach = max(reach, a + 1)
        cut = 0
        least = a + max(1, int((reach - a) * FILL))
        for kind, stop in enumerate(stops):
            # a piece ends before the white space of its boundary
            i = int(np.searchsorted(stop, reach, "right")) - 1
            if i >= 0 and stop[i] > (least if kind < len(stops) - 1 else a):
                cut = int(stop[i])
                break
        after = cut if cut and sums[cut] - sums[a] > back else 0
        cut = after or reach
        out.append((lead + a, lead + cut, size(a, cut)))
        # back by the overlap, to the start of the word there; never to the start of this piece again
        from_ = int(np.searchsorted(sums, sums[cut] - back, "right")) - 1
        i = int(np.searchsorted(words, from_, "right")) - 1
        start = int(words[i]) if i >= 0 and from_ - words[i] <= 64 else from_
        a = max(start, a + 1)
        if back == 0:
            a = cut
            while a < n and body[a].isspace():
                a += 1


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = pieces(text, limit, overlap)
                if len(cut) > 1:
                    out += [(i, k, len(cut), a, b, t, text[a:b]) for k, (a, b, t) in enumerate(cut)]
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "piece", "n_pieces", "start", "stop", "n_tokens", "text"])

    return run


def split(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of the oversized records: id, piece, n_pieces, start, stop, n_tokens, text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    # texts that can't be over the limit stay in the JVM
    rows = rows.filter(F.length("text") >= 4 * limit + 4)
    out = rows.mapInArrow(_split(limit, overlap), "id long, piece int, n_pieces int, start long, stop long, n_tokens int, text string")
    return out.dropDuplicates(["id", "piece"])
