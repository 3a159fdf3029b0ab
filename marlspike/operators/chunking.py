"""Corpus preparation: pages stitched, headings carried on, text packed into overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


#: pages of a source that one task orders
BLOCK = 4096


def _blocks(pages: DataFrame, block: int) -> DataFrame:
    return pages.withColumn("block", F.floor(F.coalesce("seq", F.lit(0)) / block).cast("long"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys are equal."""
    b = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, cond, "left").drop(*[f"__{k}" for k in keys])


def stitch(pages: DataFrame, keep: int = 40, block: int = BLOCK) -> DataFrame:
    """Each page with the last ``keep`` words of the page before it in the same source (``stitched``).

    Sources are ordered in blocks of ``block`` sequence numbers, of which only the last id is handed
    on, so a source with a third of all pages is spread over many tasks; texts move by an equi-join on ids.
    """
    order = _blocks(pages.select("source", "seq", "raw_id"), block)
    inside = order.withColumn("in_block", F.lag("raw_id").over(W.partitionBy("source", "block").orderBy("seq", "raw_id")))
    ends = order.groupBy("source", "block").agg(F.max_by("raw_id", F.struct("seq", "raw_id")).alias("end"))
    handed = ends.select("source", "block", F.lag("end").over(W.partitionBy("source").orderBy("block")).alias("before_block"))
    previous = _same(inside, handed, ["source", "block"]).select("raw_id", F.coalesce("in_block", "before_block").alias("previous"))
    body = F.coalesce("page_content", F.lit(""))
    tails = pages.select(F.col("raw_id").alias("previous"), T.tail_words(body, keep).alias("tail"))
    joined = pages.join(previous, "raw_id").join(tails, "previous", "left")
    return joined.withColumn("stitched", F.when(F.coalesce(F.length("tail"), F.lit(0)) > 0, F.concat("tail", F.lit("\n"), body)).otherwise(body)).drop("previous", "tail")


def carry_headings(pages: DataFrame, text: str, default: str = T.DEFAULT_HEADING, block: int = BLOCK) -> DataFrame:
    """The heading in force on each page (``header``): its own, if the cleaned ``text`` is one, or the last one before it in the source.

    Ordered in blocks like ``stitch``; of a block only its last heading is handed on.
    """
    own = _blocks(pages.select("source", "seq", "raw_id", T.heading(F.col(text)).alias("own")), block)
    upto = W.partitionBy("source", "block").orderBy("seq", "raw_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = own.withColumn("in_block", F.last("own", ignorenulls=True).over(upto))
    last = own.filter("own is not null").groupBy("source", "block").agg(F.max_by("own", F.struct("seq", "raw_id")).alias("last"))
    all_blocks = _same(own.select("source", "block").distinct(), last, ["source", "block"])
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    handed = all_blocks.select("source", "block", F.last("last", ignorenulls=True).over(before).alias("before_block"))
    header = _same(inside, handed, ["source", "block"]).select("raw_id", F.coalesce("in_block", "before_block", F.lit(default)).alias("header"))
    return pages.join(header, "raw_id")


def count_tokens(text: str) -> int:
    n = len(text.strip())
    return max(1, n // 4) if n else 0


def pack(parts: list[str], limit: int, overlap: int, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Parts packed into chunks under ``limit``; a chunk begins with the parts that make up the overlap.

    A part over the limit stays in the overlap until newer parts reach it, so it may come again.
    """
    sizes = [count(p) for p in parts]
    out: list[str] = []
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > limit and i > start:
            out.append(" ".join(parts[start:i]))
            j, total = i, 0
            while overlap and j > start and total < overlap:
                j -= 1
                total += sizes[j]
            start = j
        total += n
    if start < len(parts):
        out.append(" ".join(parts[start:]))
    return out


def _pack_rows(limit: int, overlap: int, count: Callable[[str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            # a page without parts is one chunk
            chunks = [[t] if p is None else pack(p, limit, overlap, count) for t, p in zip(batch.column("cleaned").to_pylist(), parts)]
            kept = [batch.column(c) for c in ("raw_id", "source", "page", "header")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(chunks, pa.list_(pa.string()))], names=["raw_id", "source", "page", "header", "chunks"])

    return run


def _count_rows(count: Callable[[str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(t) for t in batch.column("cleaned").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tokens"])

    return run


def chunk(pages: DataFrame, limit: int = 1000, overlap: int = 150, count: Callable[[str], int] | None = None) -> DataFrame:
    """raw_id, source, page, header, chunk_index, text, chunk_id: stitched, cleaned, packed, filtered, each once.

    ``count`` is a token counter of one's own; without it tokens are quarters of code points, counted in the JVM.
    Only pages over the limit are taken apart. Everything behind the cleaned text is evaluated once.
    """
    whole = stitch(pages).select("raw_id", "source", "seq", "page", T.clean(F.col("stitched")).alias("cleaned")).filter("cleaned <> ''")
    # read twice below, for headings and for the text: written once
    ready = cut(whole)
    if count:
        ready = ready.mapInArrow(_count_rows(count), "raw_id long, source string, seq int, page int, cleaned string, tokens long")
    else:
        ready = ready.withColumn("tokens", T.approx_tokens(F.col("cleaned")))
    parts = F.when(F.col("tokens") > limit, T.merged_sentences(F.col("cleaned")))
    headed = carry_headings(ready, "cleaned").select("raw_id", "source", "page", "header", "cleaned", parts.alias("parts"))
    packed = headed.mapInArrow(_pack_rows(limit, overlap, count or count_tokens), "raw_id long, source string, page int, header string, chunks array<string>")
    rows = packed.select("raw_id", "source", "page", "header", F.posexplode("chunks").alias("chunk_index", "body"))
    rows = rows.withColumn("text", F.concat(F.lit("[SECTION: "), "header", F.lit("]\n"), "body")).drop("body")
    rows = rows.filter(~T.low_value(F.col("text"))).withColumn("chunk_id", T.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")))
    # the id tells all columns but the record's number
    same = [F.first(c).alias(c) for c in ("source", "page", "header", "chunk_index", "text")]
    return rows.groupBy("chunk_id").agg(F.min("raw_id").alias("raw_id"), *same)
