"""Near-duplicate records with small edits: Order MinHash, then banded alignment.

A record is the sequence of its words. For each of ``sketches`` random orders of
the k-mers the ``samples`` least occurrence-labelled k-mers are taken and kept in
the order in which they stand in the text; two records with one such tuple in
common are candidates. Candidates are verified by a banded alignment of their words.
With the edit measure it decides. With the measure of common k-mers it accepts the
pairs whose edits are too few to destroy more k-mers than the threshold allows; the
pairs that it can't accept, reordered ones among them, are decided by the exact
overlap of their distinct k-mers.

Copies (the same words in the same order) are folded into one class before any
pair is made, so a group of copies costs one representative. Tuples are dealt out
packed and meet in Python; a bucket that comes again under another tuple is taken
once, a large one is taken apart into pairs of blocks, and none is capped. Pairs are
made within buckets and leave them only if the sketches of both allow the similarity.
Before texts move, bit tables of their k-mers bound what a pair can have in common;
that bound is exact: no pair that reaches the threshold is lost by it.

Defined cases: null or empty texts, and texts of fewer than ``min_words`` words,
are in no pair and no class of two; repeated rows (the same id) count once;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .leakage import bit_places, bit_table
from .words import code_batch, mix, shingles

#: ids, 8 bytes each, up to which they are broadcast as they are; more of them as a bit table
FEW = 500_000
#: bytes of a key that are kept; the others would only tell chance meetings apart, which the sketches do as well
KEY_BYTES = 5
#: keys that meet in one place at a time, and the records of one block of a large bucket
MEETING, BLOCK = 1 << 19, 512
#: no text has 2 ** 32 words: strings end at 2 GB
POSITION_BITS = np.uint64(32)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"order {i}") | 1 for i in range(n)], np.uint64)


def labelled(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The occurrence-labelled k-mers of each text in text order, the text of each, and which are first occurrences."""
    if len(codes) < k:
        return codes[:0], np.zeros(0, np.int64), np.zeros(0, bool)
    sh = shingles(codes, k)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[: len(sh)] == doc[k - 1 :]
    sh, doc = sh[inside], doc[: len(sh)][inside]
    keyed = mix(sh ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(keyed, kind="stable")
    run = keyed[order]
    first = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    nth = np.empty(len(run), np.int64)
    starts = np.flatnonzero(first)
    nth[order] = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
    out = np.where(nth == 0, sh, mix(sh + nth.astype(np.uint64)))
    return out, doc, nth == 0


#: every so many-th order sees only first occurrences, for texts that differ in how often they repeat themselves
FIRST_ONLY = 4


def sketch(kmers: np.ndarray, sizes: np.ndarray, orders: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """A key and the very least k-mer (8 bits of it) of each order, per text with at least one k-mer."""
    sizes = sizes[sizes > 0]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    at = (np.arange(len(kmers)) - np.repeat(starts, sizes)).astype(np.uint64)
    mask = ~((np.uint64(1) << POSITION_BITS) - np.uint64(1))
    out = np.empty((len(sizes), len(orders)), np.uint64)
    least = np.zeros((len(sizes), len(orders)), np.uint8)
    picked = np.empty((len(sizes), samples), np.int64)
    for i, a in enumerate(orders):
        h = kmers * a
        h &= mask
        h |= at
        for j in range(samples):
            low = np.minimum.reduceat(h, starts)
            # a text with fewer k-mers than samples repeats its last one
            pos = np.where(low == TOP, -1, (low & ~mask).astype(np.int64))
            picked[:, j] = np.where(pos >= 0, pos, picked[:, j - 1] if j else 0)
            h[starts + picked[:, j]] = TOP
        least[:, i] = (kmers[starts + picked[:, 0]] & np.uint64(0xFF)).astype(np.uint8)
        picked.sort(axis=1)
        key = np.full(len(sizes), a, np.uint64)
        for j in range(samples):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + kmers[starts + picked[:, j]])
        out[:, i] = key
    return out, least


def _sketches(k: int, orders_n: int, samples: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = seeds(orders_n)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                codes, counts = code_batch([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum(counts)
                ok = counts >= max(min_words, k)
                sel = np.repeat(ok, counts)
                kept, kc = codes[sel], counts[ok]
                kmers, doc, first = labelled(kept, kc, k)
                sizes = np.bincount(doc, minlength=len(kc))
                n_all = orders_n - orders_n // FIRST_ONLY
                keys, least = np.empty((0, orders_n), np.uint64), np.empty((0, orders_n), np.uint8)
                if len(kmers):
                    halves = sketch(kmers, sizes, orders[:n_all], samples), sketch(kmers[first], np.bincount(doc[first], minlength=len(kc)), orders[n_all:], samples)
                    keys, least = (np.ascontiguousarray(np.concatenate(x, axis=1)) for x in zip(*halves))
                ids = np.asarray(part.column(0).to_pylist(), object)[ok]
                same = [xxhash.xxh3_128_digest(codes[e - c : e].tobytes()) for e, c in zip(ends[ok], kc)]
                packed = keys.view(np.uint8).reshape(-1, orders_n, 8)[:, :, :KEY_BYTES]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(same, pa.binary()),
                        pa.array([x.tobytes() for x in least], pa.binary()),
                        pa.array([x.tobytes() for x in packed], pa.binary()),
                    ],
                    names=["id", "same", "least", "keys"],
                )

    return run


def edit_distance_banded(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Word edit distance of each pair within a diagonal band, all pairs of the batch at once.

    Equal ends are trimmed first. A distance over ``band`` comes out as band + 1.
    """
    ta, tb = [], []
    for x, y in zip(a, b):
        n = min(len(x), len(y))
        d = np.flatnonzero(x[:n] != y[:n])
        p = int(d[0]) if len(d) else n
        x, y = x[p:], y[p:]
        n = min(len(x), len(y))
        d = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
        s = int(d[0]) if len(d) else n
        ta.append(x[: len(x) - s])
        tb.append(y[: len(y) - s])
    la, lb = np.array([len(x) for x in ta]), np.array([len(x) for x in tb])
    out = np.full(len(a), band + 1, np.int64)
    for i in np.flatnonzero(np.abs(la - lb) <= band):
        out[i] = _edits(ta[i].tolist(), tb[i].tolist(), band)
    return out


def _edits(a: list[int], b: list[int], band: int) -> int:
    """The edits between two sequences, or band + 1: differences of neighbouring cells as bits of one number (Hyyro 2003).

    A bit is a row of the table; where the band is narrower than the table, the bits move along with it.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if not m:
        return min(n, band + 1)
    rows: dict[int, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    width = 2 * band + 1
    vn = 0
    if m <= width:
        every = vp = (1 << m) - 1
        last, d = 1 << (m - 1), m
        for left, c in zip(range(n - 1, -1, -1), b):
            x = rows.get(c, 0)
            d0 = ((((x & vp) + vp) ^ vp) | x | vn) & every
            hp, hn = vn | (every ^ (d0 | vp)), d0 & vp
            if hp & last:
                d += 1
                if d - left > band:
                    return band + 1
            elif hn & last:
                d -= 1
            hp = (hp << 1 | 1) & every
            vp, vn = (hn << 1 | (every ^ (d0 | hp))) & every, hp & d0
        return min(d, band + 1)
    every = (1 << width) - 1
    vp = every & (every << band)
    bottom, d, most = 1 << (width - 1), band, 2 * band + n - m
    # along the lowest diagonal of the band to the last row, which may take off what is left of it
    for at in range(m - band):
        x = rows.get(b[at], 0)
        x = (x << (band - at) if at < band else x >> (at - band)) & every
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & every
        hp, hn = vn | (every ^ (d0 | vp)), d0 & vp
        if not d0 & bottom:
            d += 1
            if d > most:
                return band + 1
        half = d0 >> 1
        vp, vn = hn | (every ^ (half | hp)), half & hp
    row = bottom >> 1
    for at in range(m - band, n):
        x = rows.get(b[at], 0)
        x = (x << (band - at) if at < band else x >> (at - band)) & every
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & every
        hp, hn = vn | (every ^ (d0 | vp)), d0 & vp
        d += bool(hp & row) - bool(hn & row)
        row >>= 1
        half = d0 >> 1
        vp, vn = hn | (every ^ (half | hp)), half & hp
    return min(d, band + 1)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays without repeats have in common."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def aligned(x: list[np.ndarray], y: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """The edits of each pair, or -1 where there are more than ``most``; in bands as wide as that, by classes of widths."""
    out = np.full(len(x), -1, np.int64)
    bands = 2 ** np.ceil(np.log2(np.maximum(1, most))).astype(np.int64)
    for band in np.unique(bands[most >= 0]):
        rows = np.flatnonzero((bands == band) & (most >= 0))
        d = edit_distance_banded([x[r] for r in rows], [y[r] for r in rows], int(band))
        out[rows] = np.where(d <= most[rows], d, -1)
    return out


def words_of(texts: list[str], at_once: int = 128) -> tuple[list[np.ndarray], np.ndarray]:
    """The word codes of each text, and their numbers; few texts are taken apart at a time."""
    out: list[np.ndarray] = []
    for lo in range(0, len(texts), at_once):
        codes, counts = code_batch(texts[lo : lo + at_once])
        out += np.split(codes, np.cumsum(counts)[:-1])
    return out, np.array([len(x) for x in out], np.int64)


def _verify(k: int, threshold: float, measure: str):
    """id_a, id_b, edits, jaccard of the pairs that are similar; what wasn't needed to tell is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # many pairs at a time, so that pairs of one width are aligned together
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                ia, ib = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts: dict[str, int] = {}
                at = np.array([[texts.setdefault(t, len(texts)) for t in part.column(c).to_pylist()] for c in (2, 3)]).reshape(2, -1)
                words, counts = words_of(list(texts))
                longer = np.maximum(counts[at[0]], counts[at[1]])
                x, y = [words[i] for i in at[0]], [words[i] for i in at[1]]
                jac = np.full(len(ia), np.nan)
                if measure == "edit":
                    most = np.floor((1 - threshold) * longer + 1e-9).astype(np.int64)
                    # an edit destroys k labelled k-mers at most: with fewer in common no alignment needs to be tried
                    bags = [np.sort(labelled(w, np.array([len(w)]), k)[0]) for w in words]
                    common = np.array([shared(bags[i], bags[j]) for i, j in at.T], np.int64)
                    edits = aligned(x, y, np.where(common >= longer - k + 1 - k * most, most, -1))
                    ok = edits >= 0
                else:
                    sets = [np.unique(shingles(w, k)) for w in words]
                    n = np.array([len(s) for s in sets], np.int64)
                    na, nb = n[at[0]], n[at[1]]
                    needed = threshold / (1 + threshold) * (na + nb)
                    # so many edits leave as many k-mers in common as are needed
                    edits = aligned(x, y, np.floor((np.maximum(na, nb) - needed) / k + 1e-9).astype(np.int64))
                    rest = edits < 0
                    # the others, moved parts among them, by their common k-mers
                    for r in np.flatnonzero(rest):
                        both = shared(sets[at[0][r]], sets[at[1][r]])
                        jac[r] = both / max(1, na[r] + nb[r] - both)
                    ok = ~rest | (jac >= threshold)
                keep = pa.array(ok)
                cols = [pa.array(ia, pa.int64()), pa.array(ib, pa.int64()), pa.array(edits, mask=edits < 0), pa.array(jac, mask=np.isnan(jac))]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["id_a", "id_b", "edits", "jaccard"])

    return run


def _scattered(orders: int, parts: int):
    """The keys of a batch of records, dealt out over so many parts: a row holds those of one part, and their ids byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
            keys = _unpacked(raw)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), orders)
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, raw, ids = part[order], raw[order], ids[order]
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            ends = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts[:-1]], pa.int32()),
                    pa.array([raw[a:b].tobytes() for a, b in ends], pa.binary()),
                    # the upper bytes of ids are alike, so that they take no room
                    pa.array([np.ascontiguousarray(ids[a:b].view(np.uint8).reshape(-1, 8).T).tobytes() for a, b in ends], pa.binary()),
                ],
                names=["part", "keys", "ids"],
            )

    return run


def _unpacked(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :KEY_BYTES] = raw
    return wide.view(np.uint64).ravel()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each key that two or more have, in order; of many the union of every two blocks of them."""
    for batch in batches:
        for met in batch.column(0):
            met = met.as_py()
            keys = _unpacked(np.frombuffer(b"".join(x["keys"] for x in met), np.uint8).reshape(-1, KEY_BYTES))
            ids = np.concatenate([np.ascontiguousarray(np.frombuffer(x["ids"], np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in met])
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            same = keys[1:] == keys[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            keys, ids = keys[keep], ids[keep]
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            # repeated rows meet themselves
            new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])][: len(keys)]
            keys, ids = keys[new], ids[new]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            sizes = np.diff(np.r_[starts, len(keys)])
            few = (sizes > 1) & (sizes <= 2 * BLOCK)
            if few.any():
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes[few])].astype(np.int32), ids[np.repeat(few, sizes)])], names=["reps"])
            for lo, n in zip(starts[sizes > 2 * BLOCK], sizes[sizes > 2 * BLOCK]):
                blocks = [ids[lo + i : min(lo + i + BLOCK, lo + n)] for i in range(0, n, BLOCK)]
                for i, a in enumerate(blocks):
                    unions = [np.concatenate([a, b]) for b in blocks[i + 1 :]]
                    if unions:
                        ends = np.r_[0, np.cumsum([len(x) for x in unions])].astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate(unions))], names=["reps"])


def _agreeing(needed: int, needed_first: int, orders: int):
    """The pairs of each bucket whose least k-mers agree often enough, in the orders of all k-mers or in those of first occurrences."""
    n_all = orders - orders // FIRST_ONLY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                lists = batch.column(0).slice(lo, 4096)
                members = lists.flatten()
                if not len(members):
                    continue
                ids = members.field(0).to_numpy(zero_copy_only=False)
                least = np.frombuffer(b"".join(members.field(1).to_pylist()), np.uint8).reshape(-1, orders)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
                for n in np.unique(sizes[sizes > 1]):
                    i, j = np.triu_indices(n, 1)
                    own = starts[sizes == n]
                    step = max(1, (1 << 17) // len(i))
                    for at in range(0, len(own), step):
                        for cut_ in range(0, len(i), 1 << 17):
                            x = (own[at : at + step, None] + i[cut_ : cut_ + (1 << 17)]).ravel()
                            y = (own[at : at + step, None] + j[cut_ : cut_ + (1 << 17)]).ravel()
                            same = least[x] == least[y]
                            ok = (np.count_nonzero(same[:, :n_all], axis=1) >= needed) | (np.count_nonzero(same[:, n_all:], axis=1) >= needed_first)
                            found.append(np.sort(np.stack([ids[x[ok]], ids[y[ok]]]), axis=0))
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["id_a", "id_b"])

    return run


def bits_of(kmers: np.ndarray) -> bytes:
    """A table of 8 to 16 bits to each k-mer."""
    size = 1 << max(8, (8 * len(kmers) - 1).bit_length())
    flags = np.zeros(size, bool)
    flags[kmers & np.uint64(size - 1)] = True
    return np.packbits(flags).tobytes()


def _bits(k: int):
    """The number of distinct k-mers of each text, and their bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tables = [], []
            for lo in range(0, batch.num_rows, 128):
                for w in words_of(batch.column(1).slice(lo, 128).to_pylist())[0]:
                    kmers = np.unique(shingles(w, k))
                    sizes.append(len(kmers))
                    tables.append(bits_of(kmers))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(tables, pa.binary())], names=["id", "n", "bits"])

    return run


def most_common(n_a: int, a: bytes, n_b: int, b: bytes) -> int:
    """As many k-mers as two texts can have in common at most, by their numbers and bit tables: an upper bound.

    Common k-mers are common bits, but for those that share a bit with another, which are as many as the fuller text's at most.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    count = lambda z: int(np.bitwise_count(z).sum())
    return min(n_a, n_b, count(x & y) + min(n_a - count(x), n_b - count(y)))


def _possible(threshold: float):
    """The pairs that can have as many k-mers in common as ``threshold`` demands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 4))
            needed = threshold / (1 + threshold) * (na + nb) - 1e-6
            ok = np.minimum(na, nb) >= needed
            for i in np.flatnonzero(ok):
                ok[i] = most_common(na[i], batch.column(3)[i].as_py(), nb[i], batch.column(5)[i].as_py()) >= needed[i]
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["id_a", "id_b"])

    return run


def agreement(threshold: float, k: int, sketch_k: int, orders: int, deviations: float = 4.0) -> int:
    """Of so many orders those that agree for a pair at ``threshold``, less so many standard deviations: below four is one pair in 30,000.

    Edits scattered over the text hurt longer k-mers more: a share s of common k-mers becomes s ** (sketch_k / k).
    """
    shared = (2 * threshold / (1 + threshold)) ** max(1.0, sketch_k / k)
    p = shared / (2 - shared)
    return max(0, int(orders * p - deviations * (orders * p * (1 - p)) ** 0.5))


class NearDuplicates:
    """The classes of copies (``members``: id, rep) and the links between them (``links``)."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def per_record(self) -> DataFrame:
        """id, class id, number of the class's links to other classes."""
        both = self.links.select(F.col("rep_a").alias("rep")).unionByName(self.links.select(F.col("rep_b").alias("rep")))
        return self.members.join(both.groupBy("rep").agg(F.count("*").alias("n_links")), "rep", "left").select(
            "id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
        )

    def pairs(self) -> DataFrame:
        """All pairs of different ids, copies expanded: for the callers whose result is defined so."""
        m = self.members
        # only classes of two or more have pairs of their own; the others stay out of the shuffle
        many = m.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
        small = m.join(many, "rep", "left_semi")
        own = small.alias("a").join(small.alias("b"), F.col("a.rep") == F.col("b.rep")).filter("a.id < b.id")
        own = own.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        x = self.links.join(m.withColumnsRenamed({"rep": "rep_a", "id": "x"}), "rep_a").join(m.withColumnsRenamed({"rep": "rep_b", "id": "y"}), "rep_b")
        return own.unionByName(x.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def _sent(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with those ids, and perhaps few others: the ids are sent to the scan, many of them as a bit table, so that no other text moves."""
    if ids.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(ids), "id", "left_semi")
    table = rows.sparkSession.sparkContext.broadcast(bit_table(ids.select(F.xxhash64("id").alias("hash"))))

    def there(hashes: pd.Series) -> pd.Series:
        bits, sieve = table.value
        a, b = (sieve[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) for x in bit_places(hashes.to_numpy().view(np.uint64), bits))
        return pd.Series((a & b & 1).astype(bool))

    return rows.filter(F.pandas_udf(there, "boolean")(F.xxhash64("id")))


def _both(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs with the columns of ``own`` (by id) of either record; its size is that of the corpus, so it is never broadcast."""
    for end in "ab":
        pairs = pairs.join(own.withColumnsRenamed({c: f"{c}_{end}" for c in own.columns}).hint("merge"), f"id_{end}")
    return pairs


def _candidates(sk: DataFrame, members: DataFrame, sketches: int, needed: tuple[int, int]) -> DataFrame:
    """The pairs of representatives with a key in common, of least k-mers that allow the similarity."""
    reps = members.filter("id = rep").select("id")
    copies = members.filter("id <> rep").select("id")
    # keys of copies are left out; a copy that passes the bit table goes at the join with the representatives
    if copies.limit(FEW + 1).count() <= FEW:
        first = sk.join(F.broadcast(copies), "id", "left_anti")
    else:
        first = _sent(sk, reps)
    parts = reps.count() * sketches // MEETING + 1
    dealt = first.select("id", "keys").mapInArrow(_scattered(sketches, parts), "part int, keys binary, ids binary")
    met = dealt.groupBy("part").agg(F.collect_list(F.struct("keys", "ids")).alias("met")).select("met")
    buckets = met.mapInArrow(_met, "reps array<long>").distinct()
    placed = buckets.select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("id"))
    least = sk.groupBy("id").agg(F.first("least").alias("least")).join(reps, "id", "left_semi")
    lists = placed.join(least.hint("merge"), "id").groupBy("bucket").agg(F.collect_list(F.struct("id", "least")).alias("members"))
    return cut(lists.select("members").mapInArrow(_agreeing(*needed, sketches), "id_a long, id_b long").filter("id_a < id_b").distinct())


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 5,
    threshold: float = 0.8,
    measure: str = "edit",
    min_words: int | None = None,
    sketches: int = 32,
    samples: int = 2,
    sketch_k: int | None = None,
) -> NearDuplicates:
    """Group the records of ``df`` whose similarity is at least ``threshold``.

    ``measure`` "edit" links by the banded alignment (1 - edits / longer length);
    "jaccard" links by the shared part of the distinct k-mers, which the alignment
    proves where it can. ``id_col`` is a bigint. Sketches take k-mers of ``sketch_k``
    words (``k`` if not given). With "jaccard" the least k-mers of the sketches, a few
    bytes a record, settle most candidates before any text is moved, and bit tables of
    their k-mers most others.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    by_sets = measure == "jaccard"
    ks = sketch_k or k
    run = _sketches(ks, sketches, samples, max(min_words or k, k))
    sk = cut(rows.mapInArrow(run, "id long, same binary, least binary, keys binary"))
    ids = sk.groupBy("id").agg(F.min("same").alias("same"))
    members = cut(ids.join(ids.groupBy("same").agg(F.min("id").alias("rep")), "same").select("id", "rep"))
    n_first = sketches // FIRST_ONLY
    # the few orders of first occurrences are asked only where a text repeats itself
    needed = (agreement(threshold, k, ks, sketches - n_first), agreement(threshold, k, ks, n_first, 1.5)) if by_sets else (0, 0)
    pairs = _candidates(sk, members, sketches, needed)
    ends = lambda p: p.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    if by_sets:
        tables = _sent(rows, ends(pairs)).mapInArrow(_bits(k), "id long, n int, bits binary").groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
        wide = _both(pairs, tables).select("id_a", "id_b", "n_a", "bits_a", "n_b", "bits_b")
        pairs = cut(wide.mapInArrow(_possible(threshold), "id_a long, id_b long"))
    texts = _sent(rows, ends(pairs)).groupBy("id").agg(F.first("text").alias("text"))
    done = _both(pairs, texts).select("id_a", "id_b", "text_a", "text_b").mapInArrow(_verify(k, threshold, measure), "id_a long, id_b long, edits long, jaccard double")
    return NearDuplicates(members, done.withColumnsRenamed({"id_a": "rep_a", "id_b": "rep_b"}))
