"""Hybrid retrieval, for a table of questions at a time: term weights, vectors, rank fusion, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, length of the document in terms."""
    rows = docs.select(F.col(key).alias("key"), T.terms(F.col(text)).alias("terms"))
    long = rows.select("key", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    return long.groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: number of documents and their mean length in terms."""
    return docs.select(F.size(T.terms(F.col(text))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avgdl"))


def sparse_topk(docs: DataFrame, key: str, text: str, questions: DataFrame, qkey: str, qtext: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qkey, key, score, rank: dot product of normalised idf of the question and saturated tf of the document.

    Only the postings of the questions' terms are kept before the join, so its size follows the questions.
    """
    asked = questions.select(F.col(qkey).alias("qkey"), F.explode(F.array_distinct(T.terms(F.col(qtext)))).alias("term"))
    counts = term_counts(docs, key, text).join(asked.select("term").distinct(), "term", "left_semi")
    stats = corpus_statistics(docs, key, text)
    df = document_frequencies(counts)
    idf = asked.join(df, "term", "left").join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(1)) + 0.5)))
    total = idf.groupBy("qkey").agg(F.sum("idf").alias("total"))
    weights = idf.join(total, "qkey").select("qkey", "term", (F.col("idf") / F.col("total")).alias("qw"))
    dw = counts.join(F.broadcast(stats)).select("key", "term", (F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))).alias("dw"))
    scored = weights.join(dw, "term").groupBy("qkey", "key").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score"))
    return top_ranked(scored, k)


def top_ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question; the window's rank limit is pushed below its shuffle."""
    w = W.partitionBy("qkey").orderBy(F.col("score").desc(), F.col("key"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, vectors, ids, asked in zip(*(batch.column(i) for i in range(4))):
                keys, ids = np.asarray(keys.values), np.asarray(ids.values)
                x, q = (np.asarray(v.values.flatten()).reshape(len(n), -1) for v, n in ((vectors, keys), (asked, ids)))
                scores = np.round(q @ x.T, 6)
                n = min(k, len(keys))
                # best score first, the lower key among equals: the same order as the final ranking
                order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), pa.array(keys[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())],
                    names=["qkey", "key", "score"],
                )

    return run


def _blocked(df: DataFrame, key: str, vector: str, names: tuple[str, str], size: int) -> DataFrame:
    """Vectors in blocks of about ``size``: one row a block."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null")
    n = max(1, -(-rows.count() // size))
    blocks = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias(f"{names[0]}_block")).agg(F.collect_list(F.struct("k", "v")).alias("b"))
    return blocks.select(f"{names[0]}_block", F.col("b.k").alias(names[0]), F.col("b.v").alias(names[1]))


def dense_topk(vectors: DataFrame, key: str, vector: str, questions: DataFrame, qkey: str, qvector: str, k: int = 10, block: int = 2000) -> DataFrame:
    """qkey, key, score, rank by dot product: exact. A stated set of questions meets all vectors, block by block.

    Vectors are read once and put in blocks, so are the questions; every block of vectors is sent to each block of
    questions by a join on the questions' block, keeps its k best, and only those are ranked. Neither side is on the driver.
    """
    left, right = _blocked(vectors, key, vector, ("key", "x"), block), _blocked(questions, qkey, qvector, ("q", "y"), block)
    ids = right.select("q_block").distinct().groupBy().agg(F.collect_set("q_block").alias("all"))
    # one row with the numbers of the questions' blocks: a number for every ``block`` questions
    sent = left.join(F.broadcast(ids)).withColumn("q_block", F.explode("all"))
    scored = sent.join(right, "q_block").select("key", "x", "q", "y").mapInArrow(_best(k), "qkey long, key long, score double")
    return top_ranked(scored, k)


#: vectors that the cells of an index are fitted on, at most: those of the least hashes
SAMPLE = 20_000


def fit_cells(vectors: DataFrame, key: str, vector: str, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` cells, unit vectors, fitted on ``SAMPLE`` vectors at most; the same for the same rows."""
    rows = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null")
    x = np.array([r.v for r in rows.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()], np.float64)
    if not len(x):
        return np.zeros((1, 1))
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    x = unit(x)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        # an empty cell keeps its centre
        centres = np.where(np.bincount(of, minlength=len(centres))[:, None] > 0, unit(sums), centres)
    return centres


def _cells_of(centres: np.ndarray, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            best = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
            at = np.repeat(np.arange(batch.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["cell", "k", "v"])

    return run


def cell_topk(vectors: DataFrame, key: str, vector: str, questions: DataFrame, qkey: str, qvector: str, k: int = 10, cells: int = 64, probes: int = 16, block: int = 2000) -> DataFrame:
    """qkey, key, score, rank like ``dense_topk``, looked for in the ``probes`` cells nearest to each question: an index, not exact.

    Every vector is indexed; a cell is dealt out to blocks by its number of vectors, so a full one is no task's alone.
    Scores within the cells are exact. With all cells probed the result is that of ``dense_topk``.
    """
    centres = fit_cells(vectors, key, vector, cells)

    def placed(df: DataFrame, key: str, vector: str, n: int, names: tuple[str, str]) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("k is not null and v is not null")
        at = rows.mapInArrow(_cells_of(centres, n), "cell int, k long, v array<double>")
        sizes = at.groupBy("cell").agg(F.count("*").alias("n"))
        at = at.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / block)))
        return at.groupBy("cell", "part").agg(F.collect_list(F.struct("k", "v")).alias("b")).select("cell", F.col("b.k").alias(names[0]), F.col("b.v").alias(names[1]))

    met = placed(vectors, key, vector, 1, ("key", "x")).join(placed(questions, qkey, qvector, probes, ("q", "y")), "cell")
    return top_ranked(met.select("key", "x", "q", "y").mapInArrow(_best(k), "qkey long, key long, score double"), k)


def fuse(lists: dict[str, tuple[DataFrame, float]], c: int = 60) -> DataFrame:
    """qkey, key, score, rank: weighted reciprocal ranks of several ranked lists, summed up per document."""
    parts = [df.select("qkey", "key", (F.lit(w) / (F.col("rank") + c)).alias("part")) for df, w in lists.values()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return top_ranked(union.groupBy("qkey", "key").agg(F.round(F.sum("part"), 9).alias("score")), 1 << 30)


def rerank(candidates: DataFrame, n: int = 5, scorer: Callable[..., Column] | None = None) -> DataFrame:
    """The n best by ``scorer``; without one, the first n in fused order."""
    if scorer is None:
        return candidates.filter(F.col("rank") <= n)
    return top_ranked(candidates.drop("rank").withColumn("score", scorer(F.col("qkey"), F.col("key"))), n)


NO_CONTEXT = "No relevant context found."


def context(hits: DataFrame, base: str = "", questions: DataFrame | None = None) -> DataFrame:
    """qkey, context: the hits' texts as numbered blocks. hits: qkey, rank, source, page, text; a few per question.

    A question of ``questions`` (qkey) without hits gets a fixed sentence.
    """
    tag = F.when(F.contains(F.lower("source"), F.lit(base)) if base else F.lit(True), F.lit("")).otherwise(F.lit(" [UPDATE]"))
    block = F.concat(F.lit("[DOCUMENT "), F.col("rank").cast("string"), F.lit("]"), tag, F.lit("\nSource: "), F.coalesce("source", F.lit("Unknown")), F.lit(" | Page: "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("\nContent:\n"), F.coalesce("text", F.lit("")))
    rows = hits.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    made = rows.select("qkey", F.array_join(F.col("b.block"), "\n\n---\n\n").alias("context"))
    if questions is None:
        return made
    return questions.select("qkey").distinct().join(made, "qkey", "left").select("qkey", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def rerank_batches(candidates: DataFrame, score: Callable[[str, list[str]], list[tuple[int, float]] | None], n: int = 5) -> DataFrame:
    """qkey, key, rank by a model that is given a question and all its texts: candidates of qkey, key, rank, question, text, a few a question.

    The model returns (position, score) pairs; positions out of range are left out. Where it fails or returns None, the
    first ``n`` in their old order stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, question, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                keys = [c["key"] for c in own]
                try:
                    said = score(question, [c["text"] for c in own])
                except Exception:
                    said = None
                best = range(min(n, len(keys))) if said is None else [i for i, _ in sorted(said, key=lambda x: -x[1]) if 0 <= i < len(keys)][:n]
                out += [(q, keys[i], r + 1) for r, i in enumerate(best)]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["qkey", "key", "rank"])

    grouped = candidates.groupBy("qkey").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", F.col("key").cast("long").alias("key"), "text"))).alias("own"))
    return grouped.select(F.col("qkey").cast("long").alias("qkey"), "question", "own").mapInArrow(run, "qkey long, key long, rank long")


def at_positions(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Results (qkey, position from 0, ...) with the candidate at that place of the question's list; places that it doesn't have are left out."""
    return results.join(candidates.withColumn("position", F.col("rank") - 1), ["qkey", "position"])


# ---- models that are passed in, given a batch of texts at a time


def in_batches(df: DataFrame, text: str, out: str, kind: str, model: Callable[[list[str]], list], fallback: Callable[[str], object] = lambda t: None, attempts: int = 1, wait: Callable[[float], None] | None = None, size: int = 100) -> DataFrame:
    """``df`` with a column ``out`` of type ``kind``: what the model says of each text, ``size`` texts at a time.

    A batch that fails is tried ``attempts`` times with growing pauses (2, 4, at most 8 seconds, by ``wait``); then its
    rows get the fallback. Null texts get it at once.
    """
    import time

    from pyspark.sql.types import DataType, StructType

    pause = wait or time.sleep
    schema = StructType.fromJson(df.schema.jsonValue()).add(out, DataType.fromDDL(kind))

    def ask(texts: list[str]) -> list:
        for k in range(attempts):
            try:
                said = model(texts)
                if len(said) == len(texts):
                    return said
            except Exception:
                if k + 1 < attempts:
                    pause(backoff(k + 1))
        return [fallback(t) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(schema[out].dataType)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            said = [fallback(t) if t is None else None for t in texts]
            at = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(at), size):
                part = at[lo : lo + size]
                for i, x in zip(part, ask([texts[i] for i in part])):
                    said[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, arrow)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def backoff(attempt: int, most: float = 8.0) -> float:
    """Seconds to wait behind a failed attempt, counted from 1."""
    return min(most, 2.0**attempt)


def normalised(vector: Column) -> Column:
    """The vector at length 1; zero vectors stay."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(vector, lambda x: x.cast("double") / size))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """``df`` with a vector of length 1 for each text."""
    return in_batches(df, text, out, "array<double>", model).withColumn(out, normalised(F.col(out)))


def rewritten(df: DataFrame, history: str, question: str, model: Callable[[list[str]], list[str]], out: str = "query") -> DataFrame:
    """``df`` with the question as the model rewrites it in view of the last six messages; blank and failed answers leave it as it is."""
    from .conversation import last_n, role

    said = F.transform(last_n(F.col(history), 6), lambda m: F.concat(F.initcap(role(m["role"])), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    before = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.array_join(said, "\n")).otherwise(F.lit("No previous history."))
    asked = F.concat(F.lit("Chat History:\n"), before, F.lit("\n\nLatest Question: "), F.coalesce(question, F.lit("")))
    made = in_batches(df.withColumn("__prompt", asked), "__prompt", out, "string", model)
    return made.withColumn(out, F.coalesce(F.nullif(T.strip(F.col(out)), F.lit("")), F.col(question))).drop("__prompt")


def extracted(df: DataFrame, text: str, schema: str, model: Callable[[list[str]], list[str]], out: str = "record") -> DataFrame:
    """``df`` with a struct of ``schema`` that is read from the JSON the model answers; what can't be read is null."""
    return in_batches(df, text, "__json", "string", model).withColumn(out, F.from_json("__json", schema)).drop("__json")


# ---- the sparse index's state


def save_state(counts: DataFrame, stats: DataFrame, path: str) -> None:
    """Document frequencies and statistics, written beside each other."""
    document_frequencies(counts).write.mode("overwrite").parquet(f"{path}/df")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_state(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(document frequencies, statistics) as saved; an empty state where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/df"), spark.read.parquet(f"{path}/stats")
    except AnalysisException:
        return spark.createDataFrame([], "term string, df long"), spark.createDataFrame([(0, 0.0)], "n_docs long, avgdl double")
