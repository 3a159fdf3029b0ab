"""The most frequent words of a counted vocabulary, at most a given number of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: buckets of counts to a doubling
FINE = 16


def frequent(counted: DataFrame, word: str, n: str, limit: int) -> frozenset[str]:
    """The words whose count is above the least count that at most ``limit`` words reach.

    The count is found from a histogram of the counts' logarithms (some hundred rows whatever the
    vocabulary), so no worker and not the driver gets more than ``limit`` words.
    """
    bucket = F.floor(F.log2(F.col(n)) * FINE).cast("int")
    sizes = counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r.b):
        total += r.k
        if total > limit:
            break
        least = r.b
    if least is None:
        return frozenset()
    floor = math.floor(2 ** (least / FINE))
    return frozenset(r[0] for r in counted.filter((F.col(n) >= floor) & (bucket >= least)).select(word).collect())
