"""Items of varying length in containers of fixed capacity: harmonic packing.

A length in (C/(j+1), C/j] belongs to class j, and every container of class j
takes exactly j items, whichever they are: no item needs to know of another, so
workers fill containers of every class on their own, and only the last container
of a class and worker may stay open. Lengths of at most C/``classes`` form the last
class, whose containers are filled one after the other. Items of class ``top_up`` and
smaller first fill the space that the containers of larger classes leave; each worker
tries several ``top_up`` for a capacity and keeps the one with the fewest containers.

Defined cases: an item over the capacity is cut into full containers and a rest,
which is packed like an item; null and empty texts have no tokens and take part in
nothing; repeated rows (the same id) are packed once; ties don't matter; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

RANKS = "byte_bpe_50k.tiktoken"


def default_ranks() -> str:
    """The place of the public tokenizer's rank file."""
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def encoding(path: str):
    """One tokenizer per worker process."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    return run


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id, n_tokens of every record, once per id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.mapInArrow(_count(path or default_ranks()), "id long, n_tokens int").dropDuplicates(["id"])


def fill(lengths: np.ndarray, capacity: int, classes: int, top_up: int) -> tuple[np.ndarray, int]:
    """The container (from 0) of each length in 1..capacity, and the number of containers.

    ``top_up`` is the first class whose items fill open space before they get containers of their own; 0: none.
    """
    bins = np.full(len(lengths), -1, np.int64)
    cls = np.minimum(capacity // lengths, classes)
    n = 0

    def harmonic(at: np.ndarray, j: int) -> None:
        nonlocal n
        # neighbours in length share a container: what each container leaves is then even within a class
        at = at[np.argsort(-lengths[at], kind="stable")]
        bins[at] = n + np.arange(len(at)) // j
        n += -(-len(at) // j)

    large = top_up or classes
    for j in range(1, large):
        harmonic(np.flatnonzero(cls == j), j)
    rest = np.flatnonzero(cls >= large)
    if top_up and n:
        rest = _top_up(bins, lengths, capacity, n, rest)
    for j in range(large, classes):
        harmonic(rest[cls[rest] == j], j)
    room = 0
    for i in rest[cls[rest] == classes]:
        if lengths[i] > room:
            n, room = n + 1, capacity
        bins[i] = n - 1
        room -= int(lengths[i])
    return bins, n


def _top_up(bins: np.ndarray, lengths: np.ndarray, capacity: int, n: int, small: np.ndarray) -> np.ndarray:
    """Put what fits of ``small`` into the open space of the n containers; returns what is left."""
    small = small[np.argsort(-lengths[small], kind="stable")]
    done = bins >= 0
    free = capacity - np.bincount(bins[done], weights=lengths[done], minlength=n).astype(np.int64)
    low, high = 0, len(small)
    left: list[int] = []
    # containers by falling room: an item too large for a fresh one is too large for all that follow
    for b in np.argsort(-free, kind="stable"):
        room = int(free[b])
        while low < high and lengths[small[low]] > room:
            left.append(int(small[low]))
            low += 1
        if low == high:
            break
        while low < high and lengths[small[low]] <= room:
            bins[small[low]], room, low = b, room - int(lengths[small[low]]), low + 1
        while low < high and lengths[small[high - 1]] <= room:
            high -= 1
            bins[small[high]], room = b, room - int(lengths[small[high]])
    return np.array(left + small[low:high].tolist(), np.int64)


def _pack(capacities: list[tuple[int, int]], classes: int, top_up: tuple[int, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        # the worker's items: two numbers each
        whole = pd.concat(list(batches) or [pd.DataFrame({"id": [], "n_tokens": []})], ignore_index=True)
        # the same containers whatever order the items came in, should the task run again
        whole = whole.sort_values("id", kind="stable")
        n, ids = whole["n_tokens"].to_numpy(np.int64), whole["id"].to_numpy(np.int64)
        for limit, c in capacities if len(n) else ():
            full, rest = n // c, n % c
            piece_of = np.repeat(np.arange(len(n)), full)
            at = np.flatnonzero(rest > 0)
            # each choice of the classes that top up is tried; the fewest containers win
            bins, used = min((fill(rest[at], c, classes, t) for t in top_up), key=lambda x: x[1])
            yield pd.DataFrame(
                {
                    "limit_id": np.int32(limit),
                    "bin": [f"{worker}-{b}" for b in np.r_[bins, used + np.arange(len(piece_of))]],
                    "id": np.r_[ids[at], ids[piece_of]],
                    "piece": np.r_[full[at], np.arange(len(piece_of)) - np.repeat(np.cumsum(full) - full, full)].astype(np.int32),
                    "n_tokens": np.r_[rest[at], np.full(len(piece_of), c)].astype(np.int32),
                    "capacity": np.int32(c),
                }
            )

    return run


#: items of a worker: enough to fill containers well, few enough for its memory
FEWEST, MOST = 2_000, 500_000


def workers_for(items: int, partitions: int) -> int:
    """The number of workers for so many items: a share of the shuffle partitions each, within the bounds."""
    each = min(MOST, max(FEWEST, -(-items // max(1, partitions))))
    return max(1, -(-items // each))


def pack(sizes: DataFrame, capacities: dict[int, int], classes: int = 8, top_up: tuple[int, ...] = (2, 3, 4, 6, 8), workers: int | None = None) -> DataFrame:
    """limit_id, bin, id, piece, n_tokens, capacity: every item's container for every capacity.

    ``sizes``: id, n_tokens; ``capacities``: limit_id -> tokens. Items are dealt out evenly over ``workers``
    tasks, by default as many as ``workers_for`` gives.
    """
    if not capacities:
        return sizes.sparkSession.createDataFrame([], SCHEMA)
    items = cut(sizes.filter("n_tokens > 0").select("id", "n_tokens"))
    n = workers or workers_for(items.count(), int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # by a hash of the id that no earlier shuffle by id can stand in for
    dealt = items.repartition(n, F.xxhash64("id", F.lit(n)))
    return dealt.mapInPandas(_pack(sorted(capacities.items()), classes, top_up), SCHEMA)


SCHEMA = "limit_id int, bin string, id long, piece int, n_tokens int, capacity int"
