"""Held-out passages in training text, by spaced seeds and substitution-tolerant verification.

Every mask is laid at every word position; the words at its ones are hashed, those
at its zeros are ignored, so a changed word under a zero doesn't break the seed.
The hashes of the corpus are joined with those of the passages, hits are counted by
document and passage, and the pairs that every mask hits as often as the tolerance
demands are verified: around the hits the longest tolerant overlap is found by
chaining the equal runs of passage and text. A bit table of the passages' hashes, of
a fixed largest size, keeps most positions of the corpus out of the join.

Defined cases: null and empty texts and passages take part in nothing; an opening
sentence that many passages share (an instruction, counted over all passages) is cut
off first; repeated rows and repeated passages are reported once; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import MIX, code_batch, mix

#: all of one length, with one word in five ignored
MASKS = ("11011", "10111", "11101")
SPAN = 5
#: bits to a hash in the bit table, and the most bits (as a power of two: 16 MB)
BITS_EACH, MOST_BITS = 64, 27
#: parts that a hash of many documents is dealt out to
SALTS = 8


def least_hits(least: int, per: int) -> int:
    """How often each mask hits an overlap of ``least`` words or more with at most one edit in ``per``.

    n words with e edits leave n - e equal ones in at most e + 1 runs, and so n - e - (e + 1)(span - 1) places
    where a mask lies on equal words alone; places with a changed word under a zero come on top.
    """
    return max(1, min(n - n // per - (n // per + 1) * (SPAN - 1) for n in range(least, 8 * least)))


def seeds(codes: np.ndarray, counts: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of one mask at all positions where it lies within one text, and those positions."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return codes[:0], np.zeros(0, np.int64)
    h = np.full(n, number + 1, np.uint64)
    for j, one in enumerate(mask):
        if one == "1":
            h *= MIX
            h += codes[j : j + n]
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[:n] == doc[len(mask) - 1 :])
    return mix(h[at]), at


def matches(p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions at which two sequences are equal."""
    order = np.argsort(p, kind="stable")
    q = p[order]
    # most of ``d`` is settled by a table of low bits
    low = np.uint64((1 << max(10, len(p).bit_length() + 4)) - 1)
    sieve = np.zeros(int(low) + 1, bool)
    sieve[p & low] = True
    at = np.flatnonzero(sieve[d & low])
    lo, hi = np.searchsorted(q, d[at], "left"), np.searchsorted(q, d[at], "right")
    n = hi - lo
    return order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], np.repeat(at, n)


def runs(p: np.ndarray, d: np.ndarray, bands: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Maximal equal runs (start in p, start in d, length) of two word sequences on the diagonals in ``bands``."""
    i, j = matches(p, d)
    diag = j - i
    if bands is not None:
        inside = np.zeros(len(diag), bool)
        for x, y in bands:
            inside |= (diag >= x) & (diag <= y)
        i, j, diag = i[inside], j[inside], diag[inside]
    o = np.lexsort((i, diag))
    i, j, diag = i[o], j[o], diag[o]
    if not len(i):
        return np.empty((0, 3), np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(diag) != 0) | (np.diff(i) != 1)])
    return np.stack([i[first], j[first], np.diff(np.r_[first, len(i)])], axis=1)


def overlap(p: np.ndarray, d: np.ndarray, least: int, per: int, bands: list[tuple[int, int]] | None = None) -> tuple[int, int] | None:
    """The longest stretch of ``p`` in ``d`` with at most one edit in ``per`` words and ``least`` words or more.

    Stretches begin and end with equal runs; between two runs of a chain the edits are the longer gap. The runs of a
    stretch differ by its edits in their diagonals at most, so ``bands`` tell where to look.
    Returns (words of p, edits), or None.
    """
    all_ = runs(p, d, bands)
    # some ``least`` words of a stretch have at most twice the tolerated edits (it may be nearly twice as long)
    covered = np.zeros(len(p) + 1, np.int64)
    np.add.at(covered, all_[:, 0], 1)
    np.add.at(covered, np.minimum(all_[:, 0] + all_[:, 2], len(p)), -1)
    sums = np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)]
    if len(p) < least or (sums[least:] - sums[:-least]).max() < least - 2 * least // per:
        return None
    most = max(1, len(p) // per)
    segs = sorted(map(tuple, all_[all_[:, 2] >= 2].tolist()))
    ones = all_[all_[:, 2] == 1].tolist() if segs else []
    # a run of one word counts within the edits of a longer one
    near = {a[1] - a[0] + s for a in segs for s in range(-most, most + 1)}
    return _chain(sorted(segs + [tuple(r) for r in ones if r[1] - r[0] in near]), len(p), least, per, most)


def _chain(segs: list[tuple[int, int, int]], n_passage: int, least: int, per: int, most: int) -> tuple[int, int] | None:
    best = None
    # the least number of edits of each chain, by its first and last run
    for s, (pi, di, n) in enumerate(segs):
        if n < 2 or n_passage - pi < least or best and n_passage - pi <= best[0]:
            continue
        edits_to = {s: 0}
        for t in range(s, len(segs)):
            if t not in edits_to:
                continue
            edits = edits_to[t]
            a, b, m = segs[t]
            got = a + m - pi
            if got >= least and edits * per <= got and (best is None or got > best[0]):
                best = (got, edits)
            for u in range(t + 1, len(segs)):
                x, y, k = segs[u]
                if x - (a + m) > most:
                    break
                # overlapping ends are given to the earlier run
                over = max(0, a + m - x, b + m - y)
                x, y, k = x + over, y + over, k - over
                if k <= 0 or y - (b + m) > most:
                    continue
                e = edits + max(x - (a + m), y - (b + m))
                # not even a passage that goes on unchanged would make up for so many edits
                if e * per > n_passage - pi:
                    continue
                if e < edits_to.get(u, e + 1):
                    edits_to[u] = e
    return best


SENTENCE = re.compile(r"^\s*(.{10,200}?[.!?:])\s+(?=\S)", re.S)


def head_of(passage: str) -> str | None:
    m = SENTENCE.match(passage)
    return m.group(1).lower() if m else None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([head_of(p) for p in batch.column(0).to_pylist()], pa.string())], names=["head"])


def instructions(passages: DataFrame, text: str, share: float = 0.02) -> frozenset[str]:
    """The opening sentences that at least ``share`` of all passages (three or more) begin with: 1 / share of them at most."""
    heads = passages.select(text).mapInArrow(_heads, "head string").groupBy("head").agg(F.count("*").alias("n"))
    total = passages.count()
    return frozenset(r.head for r in heads.filter((F.col("n") >= max(3, share * total)) & F.col("head").isNotNull()).collect())


def without_instruction(passage: str, often: frozenset[str]) -> str:
    return SENTENCE.sub("", passage, count=1) if head_of(passage) in often else passage


def _bare(often: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare = [without_instruction(p, often) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bare, pa.string())], names=["item_id", "passage"])

    return run


def _passage_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, mask, hash of each mask at all places of a passage, equal ones once."""
    for batch in batches:
        ids = np.asarray(batch.column(0).to_pylist(), np.int64)
        codes, counts = code_batch(batch.column(1).to_pylist())
        owner = np.repeat(np.arange(len(counts)), counts)
        for i, mask in enumerate(MASKS):
            h, at = seeds(codes, counts, mask, i)
            pairs = np.unique(np.stack([owner[at].astype(np.int64), h.view(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[0]]), pa.array(np.full(pairs.shape[1], i, np.int32)), pa.array(pairs[1])], names=["item_id", "mask", "hash"])


def bit_places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def _fold(bits: int, ready: bool):
    """Partial bit tables of the hashes (or of partial tables) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            if ready:
                for x in batch.column(0).to_pylist():
                    out |= np.frombuffer(x, np.uint8)
            else:
                for places in bit_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits):
                    np.bitwise_or.at(out, places >> np.uint64(3), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    return run


def bit_table(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """The bits of the hashes, as a power of two and a table of bytes; at most 2 ** MOST_BITS bits whatever their number."""
    bits = min(MOST_BITS, max(16, (hashes.count() * BITS_EACH).bit_length()))
    parts = hashes.mapInArrow(_fold(bits, False), "bits binary").coalesce(4).mapInArrow(_fold(bits, True), "bits binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        out |= np.frombuffer(r.bits, np.uint8)
    return bits, out


def _corpus_seeds(table: object, need: int):
    """doc_id, hash, n of the corpus's places that the bit table lets through, of documents that every mask hits often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sieve = table.value
        known = np.unpackbits(sieve, bitorder="little").view(bool) if bits <= 25 else None

        def passes(h: np.ndarray) -> np.ndarray:
            a, b = bit_places(h, bits)
            if known is not None:
                maybe = np.flatnonzero(known[a])
                return maybe[known[b[maybe]]]
            of = lambda x: (sieve[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
            return np.flatnonzero(of(a) & of(b))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = np.asarray(part.column(0).to_pylist(), np.int64)
                codes, n = code_batch(part.column(1).to_pylist())
                doc = np.repeat(np.arange(len(n)), n)
                hits, enough = [], np.ones(len(n), bool)
                for i, mask in enumerate(MASKS):
                    h, at = seeds(codes, n, mask, i)
                    k = passes(h)
                    hits.append((doc[at[k]], h[k]))
                    enough &= np.bincount(hits[-1][0], minlength=len(n)) >= need
                d, h = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
                keep = enough[d]
                pairs, times = np.unique(np.stack([d[keep].astype(np.int64), h[keep].view(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[0]]), pa.array(pairs[1]), pa.array(times.astype(np.int64))], names=["doc_id", "hash", "n"])

    return run


def _bands(passages: list[np.ndarray], texts: list[np.ndarray], need: int, per: int) -> list[list[tuple[int, int]]]:
    """For each pair of word sequences the diagonals near which every mask hits ``need`` times or more.

    All pairs at once: the seeds of a pair are made its own by its number.
    """
    n_p, n_d = np.array([len(x) for x in passages]), np.array([len(x) for x in texts])
    p, d = np.concatenate(passages), np.concatenate(texts)
    of_p, of_d = np.repeat(np.arange(len(n_p)), n_p), np.repeat(np.arange(len(n_d)), n_d)
    from_p, from_d = np.r_[0, np.cumsum(n_p)[:-1]], np.r_[0, np.cumsum(n_d)[:-1]]
    most = np.maximum(1, n_p // per)
    wide = int(n_p.max() + n_d.max() + most.max() + 1)
    out: list[list[list[tuple[int, int]]]] = []
    for k, mask in enumerate(MASKS):
        h, at = seeds(p, n_p, mask, k)
        g, by = seeds(d, n_d, mask, k)
        i, j = matches(h ^ mix(of_p[at].astype(np.uint64)), g ^ mix(of_d[by].astype(np.uint64)))
        i, j = at[i], by[j]
        pair = of_p[i]
        places = np.sort(pair * (2 * wide) + (j - from_d[pair]) - (i - from_p[pair]) + wide)
        pair = places // (2 * wide)
        n = np.searchsorted(places, places + most[pair], "right") - np.arange(len(places))
        good = n >= need
        found: list[list[tuple[int, int]]] = [[] for _ in passages]
        for q, x in zip(pair[good].tolist(), (places - pair * (2 * wide) - wide)[good].tolist()):
            # runs that no mask hits may lie on lower diagonals too
            own, w = found[q], int(most[q])
            if own and x - w <= own[-1][1]:
                own[-1] = (own[-1][0], x + w)
            else:
                own.append((x - w, x + w))
        out.append(found)
    # a stretch lies in a range of every mask's: any one of them will do for the search
    return [min(own, key=lambda b: sum(y - x for x, y in b)) if all(own) else [] for own in zip(*out)]


def _verify(least: int, per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_hits(least, per)
        for batch in batches:
            found = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids, items, texts, passages = (part.column(i).to_pylist() for i in range(4))
                # a document or passage of many pairs is taken apart once
                known = {t: i for i, t in enumerate(dict.fromkeys(texts + passages))}
                codes, counts = code_batch(list(known))
                words = np.split(codes, np.cumsum(counts)[:-1])
                p, d = [words[known[t]] for t in passages], [words[known[t]] for t in texts]
                for k, bands in enumerate(_bands(p, d, need, per)):
                    got = overlap(p[k], d[k], least, per, bands) if bands else None
                    if got:
                        found.append((ids[k], items[k], *got))
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["doc_id", "item_id", "n_words", "n_edits"],
            )

    return run


def leaks(docs: DataFrame, doc_id: str, text: str, held_out: DataFrame, item_id: str, passage: str, least: int = 24, per: int = 7) -> DataFrame:
    """doc_id, item_id, n_words, n_edits of every leak."""
    rows = held_out.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).filter("item_id is not null and passage is not null").dropDuplicates(["item_id"])
    items = cut(rows.mapInArrow(_bare(instructions(rows, "passage")), "item_id long, passage string"))
    known = cut(items.mapInArrow(_passage_seeds, "item_id long, mask int, hash long"))
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    table = docs.sparkSession.sparkContext.broadcast(bit_table(known.select("hash")))
    need = least_hits(least, per)
    places = corpus.mapInArrow(_corpus_seeds(table, need), "doc_id long, hash long, n long").withColumn("salt", F.pmod("doc_id", F.lit(SALTS)).cast("int"))
    met = places.join(known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["hash", "salt"])
    # an item repeats a text where every mask hits often enough; repeated rows of a document count again, which only adds candidates
    counted = met.groupBy("doc_id", "item_id").agg(*(F.sum(F.when(F.col("mask") == i, F.col("n"))).alias(f"n{i}") for i in range(len(MASKS))))
    pairs = cut(counted.filter(" and ".join(f"n{i} >= {need}" for i in range(len(MASKS)))).select("doc_id", "item_id"))
    wide = pairs.join(corpus, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "passage")
    out = wide.mapInArrow(_verify(least, per), "doc_id long, item_id long, n_words int, n_edits int")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("n_edits")).alias("less"))).alias("x")).select("doc_id", "item_id", "x.n_words", (-F.col("x.less")).alias("n_edits"))
