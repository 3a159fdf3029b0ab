"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, mojibake, order_minhash, packing, pairs, personal, quality, scans, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _p1(spark: SparkSession, sf_dir: str) -> order_minhash.NearDuplicates:
    """Similarity 0.6 on distinct three-word sequences of records of 30 words or more.

    64 tuples of 3 four-word sequences in text order: a pair at 0.6 with scattered edits is a candidate with
    probability above 0.9999, one whose halves have changed places with about 0.89.
    """
    docs = table(spark, sf_dir, "raw_docs")
    return order_minhash.near_duplicates(docs, "raw_id", "page_content", k=3, threshold=0.6, measure="jaccard", min_words=30, sketches=64, samples=3, sketch_k=4)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).pairs().select(F.col("id_a").alias("raw_id_a"), F.col("id_b").alias("raw_id_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of copies and the number of the class's links to others."""
    return _p1(spark, sf_dir).per_record().select(F.col("id").alias("raw_id"), "class_id", "n_links")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of chats and reports once: tab, rec_id, field, msg_idx, text."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.posexplode("messages").alias("i", "m"))
    said = chats.select(F.lit("conversations").alias("tab"), F.col("conv_id").alias("rec_id"), F.lit("content").alias("field"), F.col("i").alias("msg_idx"), F.col("m.content").alias("text"))
    reports = table(spark, sf_dir, "reports")
    fields = [reports.select(F.lit("reports").alias("tab"), F.col("report_id").alias("rec_id"), F.lit(f).alias("field"), F.lit(-1).alias("msg_idx"), F.col(f).alias("text")) for f in ("other_text", "msg_snippet")]
    return said.unionByName(fields[0]).unionByName(fields[1]).filter("rec_id is not null and text is not null")


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders in place of personal data."""
    return personal.mask_texts(_texts(spark, sf_dir), table(spark, sf_dir, "users")).dropDuplicates()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = personal.mask_texts(_texts(spark, sf_dir), table(spark, sf_dir, "users"))
    return masked.select("tab", "rec_id", "field", "msg_idx", F.explode("types").alias("pii_type")).dropDuplicates()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(table(spark, sf_dir, "conversations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_noise(table(spark, sf_dir, "raw_docs")).noise


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with noise as continuous paragraphs."""
    docs = table(spark, sf_dir, "raw_docs")
    return scans.repair(docs, scans.scan_noise(docs))


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_quality(table(spark, sf_dir, "raw_docs"), "raw_id", "page_content").withColumnRenamed("id", "raw_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5(spark, sf_dir).filter("kind <> 'prose'").select("raw_id", "kind")


def p5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and kind of every record."""
    return _p5(spark, sf_dir)


def _p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").filter("purpose = 'split'").orderBy("max_tokens", "limit_id").select("max_tokens", "overlap_tokens").first()
    return splitting.split(table(spark, sf_dir, "raw_docs"), "raw_id", "page_content", limits.max_tokens, limits.overlap_tokens or 0).withColumnRenamed("id", "raw_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir).filter("piece = 0").select("raw_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized record, with its place in the text."""
    return _p6(spark, sf_dir)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, bin, doc_id, piece, n_tokens: the documents' containers for every capacity."""
    limits = table(spark, sf_dir, "size_limits").filter("purpose = 'pack'").select("limit_id", "max_tokens").distinct().collect()
    sizes = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sizes, {r.limit_id: r.max_tokens for r in limits}).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, items, tokens and the share of the space that is used."""
    packed = p7_containers(spark, sf_dir).groupBy("limit_id", "capacity", "bin").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return packed.groupBy("limit_id", "capacity").agg(
        F.count("*").alias("n_bins"), F.sum("n").alias("n_items"), F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"), F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"),
    )


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, and the words and edits of the longest tolerant overlap."""
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected documents with the restored text and whether all of it could be restored."""
    return mojibake.repair(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id").dropDuplicates(["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_restored(spark, sf_dir).select("doc_id")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_classes, p2_found, p2_masked, p3_found, p4_found, p4_repaired, p5_found, p5_stats, p6_found, p6_pieces, p7_containers, p7_fill, p8_found, p8_leaks, p9_found, p9_restored)
}

#: white space as Python strips it, for RE2
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

ORACLES: dict[str, str] = {
    # every pair that shares a sequence is counted: feasible on the 0.01 tables
    "p1_found": """WITH w AS (SELECT raw_id, regexp_extract_all(lower(page_content), '[\\p{L}\\p{N}]+') AS w FROM (SELECT DISTINCT raw_id, page_content FROM raw_docs)),
        s AS MATERIALIZED (SELECT DISTINCT raw_id, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w WHERE len(w) >= 30),
        n AS (SELECT raw_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.raw_id AS x, b.raw_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.raw_id < b.raw_id GROUP BY 1, 2)
        SELECT x AS raw_id_a, y AS raw_id_b FROM p JOIN n m ON m.raw_id = x JOIN n o ON o.raw_id = y WHERE c * 10 >= 6 * (m.n + o.n - c)""",
    "p6_found": f"SELECT DISTINCT raw_id FROM raw_docs WHERE length(regexp_replace(page_content, '^{_SPACE}+|{_SPACE}+$', '', 'g')) // 4 > (SELECT min(max_tokens) FROM size_limits WHERE purpose = 'split')",
}
