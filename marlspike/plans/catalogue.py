"""The registered queries over the driver's tables, each over whole tables; their SQL twins are in ``sql``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, conversation, layout, retrieval, store
from .. import session
from ..session import table
from ..streaming import chat
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = sql.ORACLES
FLAGSHIP = "rrf_fusion"
NOW = "2026-01-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages once each: repeated rows are equal, so any of them will do."""
    return table(spark, d, "raw_docs").dropDuplicates(["raw_id"])


# ---- scans and filters


@query
def projected_scan(spark, d):
    return table(spark, d, "conversations").select("conv_id", "uid", "title").distinct()


@query
def filtered_scan(spark, d):
    return table(spark, d, "documents").filter("lang = 'en' and n_chars >= 1000").select("doc_id", "source", "n_chars")


@query
def count_scan(spark, d):
    one = lambda t, k: table(spark, d, t).agg(F.countDistinct(*k).alias("n")).select(F.lit(t).alias("tab"), "n")
    return one("users", ["username"]).unionByName(one("conversations", ["conv_id", "uid"])).unionByName(one("raw_docs", ["raw_id"]))


@query
def key_lookup(spark, d):
    return store.lookup(table(spark, d, "customer"), {"c_custkey": 7}).select("c_custkey", "c_name", "c_acctbal")


@query
def index_query_desc(spark, d):
    """Chats of the busiest account, newest first, with their position."""
    c = conversation.fullest(table(spark, d, "conversations"))
    top = c.groupBy("uid").count().orderBy(F.col("count").desc(), "uid").limit(1).select("uid")
    mine = c.join(F.broadcast(top), "uid").select("uid", "conv_id", F.unix_micros(store.moment(F.col("created_at"))).alias("created"))
    return mine.orderBy(F.col("created").desc_nulls_last(), "conv_id")


@query
def format_dispatch(spark, d):
    """Sources by the reader that their extension calls for."""
    kind = F.when(T.extension(F.col("source")) == "pdf", "pdf").when(T.extension(F.col("source")) == "docx", "docx").when(T.extension(F.col("source")).isin("txt", "md", "csv"), T.extension(F.col("source"))).otherwise("skip")
    return table(spark, d, "raw_docs").select("source", kind.alias("reader")).distinct()


# ---- text


@query
def clean_text(spark, d):
    return pages(spark, d).select("raw_id", T.clean(F.col("page_content")).alias("cleaned"))


@query
def text_quality(spark, d):
    q = pages(spark, d).select("raw_id", T.quality(F.col("page_content")).alias("q"))
    return q.select("raw_id", "q.chars", "q.words", F.round("q.alpha_ratio", 6).alias("alpha_ratio"), T.needs_recognition(F.col("q")).alias("needs_recognition"))


@query
def low_value_filter(spark, d):
    return pages(spark, d).filter(T.low_value(F.col("page_content"))).select("raw_id")


@query
def approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.merged_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "¶").alias("sentences"))


@query
def page_stitch(spark, d):
    return chunking.stitch(pages(spark, d)).select("raw_id", "stitched")


@query
def header_propagate(spark, d):
    cleaned = chunking.stitch(pages(spark, d)).withColumn("cleaned", T.clean(F.col("stitched")))
    return chunking.carry_headings(cleaned, "cleaned").select("raw_id", "header")


@query
def chunk_pack(spark, d):
    """The whole preparation: stitched, headed, cleaned, packed with overlap, filtered, each chunk once."""
    c = chunking.chunk(pages(spark, d))
    return c.select("chunk_id", "raw_id", "source", F.coalesce("page", F.lit(0)).cast("long").alias("page"), "header", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


@query
def chunk_id_dedup(spark, d):
    p = pages(spark, d).select("raw_id", T.chunk_id(F.col("source"), F.col("page"), F.lit(0), T.clean(F.col("page_content"))).alias("chunk_id"))
    return p.groupBy("chunk_id").agg(F.min("raw_id").alias("raw_id"))


@query
def metadata_sanitise(spark, d):
    entry = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"))
    m = F.map_from_entries(F.array(entry("source", "source"), entry("heading", "section_heading"), entry("body", "page_content"), entry("coordinates", "seq")))
    return pages(spark, d).select("raw_id", F.array_join(F.array_sort(F.map_keys(T.sanitise_map(m))), ",").alias("kept"))


@query
def template_fill(spark, d):
    t = F.lit("{date}: {name} ({id}) has {balance}")
    return table(spark, d, "supplier").select(
        "s_suppkey", T.fill_template(t, {"date": F.lit("January 01, 2026"), "name": F.col("s_name"), "id": F.col("s_suppkey"), "balance": F.lit(None)}).alias("filled")
    )


@query
def padded_report(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat(T.pad(F.col("n_name"), 12), T.pad(F.col("n_regionkey").cast("string"), 6, left=True)).alias("line"))


@query
def display_text(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"])
    return r.select("report_id", T.shorten(F.col("msg_snippet"), 70).alias("snippet"), F.initcap(F.trim("status")).alias("status"), T.escape_html(F.col("other_text")).alias("other"))


@query
def citation_rank(spark, d):
    """Files that a text cites in order of their first appearance; the texts are made of the page table."""
    text = F.concat(F.lit("See [SOURCE: "), "source", F.lit(" | p. "), F.coalesce("page", F.lit(0)).cast("string"), F.lit(".0, 7] and [source: manual.pdf] and [SOURCE: "), "source", F.lit(" | 3]"))
    p = pages(spark, d).select("raw_id", text.alias("t"))
    return conversation.cited(p, "raw_id", "t").withColumnRenamed("key", "raw_id").withColumn("number", F.col("number").cast("long"))


@query
def password_marks(spark, d):
    return table(spark, d, "part").select("p_partkey", T.password_strength(F.concat("p_brand", F.lit("-"), "p_size")).alias("strength"))


# ---- retrieval


@query
def bm25_fit(spark, d):
    return retrieval.document_frequencies(retrieval.term_counts(table(spark, d, "documents"), "doc_id", "text"))


@query
def bm25_stats(spark, d):
    s = retrieval.corpus_statistics(table(spark, d, "documents"), "doc_id", "text")
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def _sparse(spark, d, k=10):
    return retrieval.sparse_topk(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "question", k)


def _dense(spark, d, k=10):
    """The query vector of a question is the stored one at its number modulo the size of the index."""
    v = table(spark, d, "embeddings")
    n = v.count()
    q = table(spark, d, "eval_items").select("item_id", (F.col("item_id") % max(n, 1)).alias("vec_id")).join(v.select("vec_id", "embedding"), "vec_id")
    return retrieval.dense_topk(v, "vec_id", "embedding", q, "item_id", "embedding", k)


@query
def bm25_topk(spark, d):
    return _sparse(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query
def dense_topk(spark, d):
    """Every vector whose id divides by 50, against all vectors."""
    v = table(spark, d, "embeddings")
    return retrieval.dense_topk(v, "vec_id", "embedding", v.filter("vec_id % 50 = 0"), "vec_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


@query
def rrf_fusion(spark, d):
    """Sparse and dense ranks of every question fused 0.4 to 0.6; vec_id stands for doc_id."""
    fused = retrieval.fuse({"sparse": (_sparse(spark, d), 0.4), "dense": (_dense(spark, d), 0.6)})
    return fused.withColumn("rank", F.col("rank").cast("long"))


@query
def rerank_top5(spark, d):
    fused = retrieval.fuse({"sparse": (_sparse(spark, d), 0.4), "dense": (_dense(spark, d), 0.6)})
    return retrieval.rerank(fused, 5).select("qkey", "key", F.col("rank").cast("long").alias("rank"))


@query
def context_blocks(spark, d):
    hits = _sparse(spark, d, 5).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text"), "key")
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("qkey")).unionByName(spark.range(-1, 0).select(F.col("id").alias("qkey")))
    return retrieval.context(hits.withColumn("page", F.lit(None).cast("int")), base="library", questions=asked)


# ---- records


@query
def upsert_latest(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "uid", "title", F.size("messages").cast("long").alias("n_messages"))
    return store.latest(c, ["conv_id", "uid"], [F.col("n_messages")]).select("conv_id", "uid", "n_messages")


@query
def keyed_upsert(spark, d):
    """Suppliers, those of nation 3 replaced by new rows."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = table(spark, d, "supplier").filter("s_nationkey = 3").select("s_suppkey", F.upper("s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return store.upsert(s, new, ["s_suppkey"])


@query
def conditional_update(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"]).select("report_id", "status", "resolved_at")
    open_ = F.lower("status") == "pending"
    return store.update(r, open_, {"status": F.lit("done"), "resolved_at": F.lit("2026-01-01T00:00:00Z")})


@query
def keyed_delete(spark, d):
    f = table(spark, d, "files").select("filename", "uploaded_by")
    return store.delete_keys(f, table(spark, d, "raw_docs").filter("page is null").select(F.col("source").alias("filename")), ["filename"])


@query
def cascade_delete(spark, d):
    gone = store.attributes(table(spark, d, "users").filter("userstatus = 'UNCONFIRMED'")).select(F.col("sub").alias("uid")).filter("uid is not null")
    return store.delete_keys(table(spark, d, "conversations").select("conv_id", "uid").distinct(), gone, ["uid"]).select("conv_id", "uid")


@query
def predicate_delete(spark, d):
    return store.delete_where(pages(spark, d).select("raw_id", "source"), F.lower("source").endswith(".csv"))


@query
def stale_cleanup(spark, d):
    """Rows that share an address with a confirmed user but have another id go."""
    u = store.attributes(table(spark, d, "users").dropDuplicates(["username"])).select("id", "email", "status").withColumn("email", F.nullif("email", F.lit("")))
    return store.delete_stale(u, u.filter("status = 'CONFIRMED'"), "id", "email").select("id", "email")


@query
def status_counts(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"])
    return r.groupBy(F.lower(F.trim(F.coalesce("status", F.lit("none")))).alias("status")).agg(F.count("*").alias("n"))


@query
def status_list(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"]).filter(F.lower("status") == "pending")
    return r.select("report_id", F.unix_micros(store.moment(F.col("created_at"))).alias("created")).orderBy(F.col("created").desc_nulls_last(), "report_id")


@query
def activity_feed(spark, d):
    a = store.activity(table(spark, d, "files"), conversation.fullest(table(spark, d, "conversations")), table(spark, d, "users"), 5)
    return a.select("icon", F.unix_micros("ts").alias("ts"), "description")


@query
def eav_pivot(spark, d):
    u = store.attributes(table(spark, d, "users")).distinct()
    return u.select("id", "status", "sub", "email", "role", "username")


@query
def consent_mask(spark, d):
    """Details only of those who didn't say no; unknown isn't no."""
    u = store.attributes(table(spark, d, "users")).distinct()
    shown = ~F.coalesce(F.col("consent") == "false", F.lit(False))
    return u.select("id", "username", F.when(shown, F.col("email")).otherwise("not shared").alias("email"))


@query
def relative_time(spark, d):
    u = store.attributes(table(spark, d, "users")).distinct()
    return u.select("id", T.relative_time(F.col("joined"), F.lit(NOW).cast("timestamp")).alias("ago"))


@query
def user_lookup_fallback(spark, d):
    """The user of each report by id, else by address."""
    u = store.attributes(table(spark, d, "users")).select("id", "sub", F.nullif("email", F.lit("")).alias("mail"))
    r = table(spark, d, "reports").dropDuplicates(["report_id"]).select("report_id", "reporter_uid", "reporter_email")
    return store.by_first_or_second(r, u, ("reporter_uid", "sub"), ("reporter_email", "mail"), "id").select("report_id", "id")


@query
def report_cutoff(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"])
    out = conversation.reported(r, table(spark, d, "conversations"))
    return out.select("report_id", F.col("n_messages").cast("long").alias("n_messages"), F.col("cut").cast("long").alias("cut"))


@query
def distinct_sources(spark, d):
    return table(spark, d, "raw_docs").groupBy("source").agg(F.min("seq").cast("long").alias("first_seq"), F.countDistinct("raw_id").alias("n"))


@query
def missing_uploads(spark, d):
    """Sources with pages but without an upload that names who made it."""
    s = table(spark, d, "raw_docs").select(F.col("source").alias("filename")).distinct()
    return s.join(table(spark, d, "files").filter("uploaded_by is not null").select("filename").distinct(), "filename", "left_anti")


@query
def existence_flags(spark, d):
    return table(spark, d, "users").select("username", F.exists("attributes", lambda a: a["name"] == "email").alias("has_email"), F.size("attributes").cast("long").alias("n")).distinct()


@query
def code_lookup(spark, d):
    """A small table looked up by code with a default: regions of at most a few rows are sent to the workers."""
    r = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(F.broadcast(r), "n_regionkey", "left").select("n_nationkey", F.coalesce("r_name", F.lit("other")).alias("region"))


@query
def positional_zip(spark, d):
    z = F.arrays_zip(F.array("p_name", "p_brand", "p_type").alias("v"), F.array(F.lit("name"), F.lit("brand"), F.lit("type")).alias("k"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(z).alias("pos", "z")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "z.k", "z.v")


@query
def weighted_mean(spark, d):
    li = table(spark, d, "lineitem")
    return layout.weighted_mean(li, ["l_suppkey"], F.col("l_discount"), F.col("l_quantity"), F.col("l_returnflag") == "N", 2)


@query
def yearly_rollup(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query
def grouped_members(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("m"))
    return n.select("n_regionkey", F.array_join("m", ", ").alias("members"))


# ---- chats


@query
def history_last6(spark, d):
    c = conversation.fullest(table(spark, d, "conversations"))
    last = c.select("conv_id", F.posexplode(conversation.last_n(F.col("messages"), 6)).alias("pos", "m"))
    return last.select("conv_id", F.col("pos").cast("long").alias("pos"), conversation.role(F.col("m.role")).alias("role"), F.col("m.content").alias("content"))


@query
def history_compaction(spark, d):
    c = conversation.fullest(table(spark, d, "conversations")).filter("messages is not null")
    m = c.select("conv_id", conversation.compact(F.col("messages")).alias("m"))
    return m.select("conv_id", F.size("m").cast("long").alias("n"), F.coalesce(F.try_element_at("m", F.lit(1))["content"], F.lit("")).alias("first_content"))


@query
def visible_messages(spark, d):
    c = conversation.fullest(table(spark, d, "conversations"))
    return c.select("conv_id", F.coalesce(F.size(conversation.visible(F.col("messages"))), F.lit(0)).cast("long").alias("n"))


@query
def conv_title(spark, d):
    return conversation.fullest(table(spark, d, "conversations")).select("conv_id", conversation.title(F.col("messages")).alias("derived"))


@query
def transcript(spark, d):
    c = conversation.fullest(table(spark, d, "conversations")).filter("messages is not null")
    return c.select("conv_id", conversation.transcript(F.col("messages")).alias("text"))


# ---- layout


def _marks(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), "l_quantity")


@query
def column_histogram(spark, d):
    h = layout.histogram(_marks(spark, d), "page", F.col("l_quantity"), F.lit(60.0))
    return h.select("page", F.col("bucket").cast("long").alias("bucket"), F.col("n").cast("long").alias("n"))


@query
def gap_islands(spark, d):
    m = _marks(spark, d).filter("not (l_quantity between 12 and 17) and not (l_quantity between 36 and 41)")
    return layout.gaps(layout.histogram(m, "page", F.col("l_quantity"), F.lit(60.0)), "page").select("page", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query
def page_columns(spark, d):
    m = _marks(spark, d).filter("not (l_quantity between 12 and 17) and not (l_quantity between 36 and 41)")
    g = layout.gaps(layout.histogram(m, "page", F.col("l_quantity"), F.lit(60.0)), "page").filter("page % 5 <> 0")
    return layout.columns(g, "page", m).select("page", F.col("column").cast("long").alias("column"), "left", "right")


@query
def heading_sections(spark, d):
    b = pages(spark, d).filter("type = 'docx_section'").select("raw_id", "source", "seq", "section_heading")
    s = layout.sections(b, "source", "seq", "raw_id", F.coalesce(F.trim("section_heading"), F.lit("")) != "")
    return s.select("raw_id", F.col("section").cast("long").alias("section"))


@query
def rolling_context(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return layout.rolling(o, ["o_custkey"], ["o_orderkey"], "o_orderpriority", 5).select("o_orderkey", "context")


@query
def merged_cells(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("region "), "n_regionkey").alias("cell"))
    return layout.first_only(n, ["n_regionkey"], ["n_nationkey"], "cell").select("n_nationkey", "cell")


@query
def table_markdown(spark, d):
    cells = F.when(F.col("n_nationkey") % 3 == 0, F.array("n_name")).otherwise(F.array("n_name", F.col("n_nationkey").cast("string")))
    return layout.markdown(table(spark, d, "nation").select("n_regionkey", "n_nationkey", cells.alias("cells")), "n_regionkey", "n_nationkey", "cells")


@query
def row_text(spark, d):
    cells = F.array("s_name", F.col("s_nationkey").cast("string"), F.when(F.col("s_nationkey") > 9, "x").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", layout.row_text(cells).alias("line"))


# ---- streams, run over their whole input at once


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream; its directory is watched for this file alone."""
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drain(df: DataFrame, mode: str, keys: list[str] = ()) -> DataFrame:
    """Run a stream until its input is used up and return what it wrote, from files in the shared folder.

    In append mode a row is written once. In update mode every batch writes its changed rows under its number,
    and of each key the row of the last batch counts.
    """
    spark = df.sparkSession
    root = f"{session.shared_folder(spark)}/stream-{spark.sql('SELECT uuid()').first()[0]}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{root}/out")
    else:
        q = df.writeStream.foreachBatch(lambda b, n: b.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/batch={n}")).outputMode(mode)
    q.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{root}/out")
    written = spark.read.parquet(f"{root}/out/batch=*")
    return store.latest(written, keys, [F.col("__batch")]).select(*df.columns)


@query
def stream_counts(spark, d):
    """Counts by type kept by a stream over the events, as of its end; only changed counts are written."""
    events = _streamed(spark, d, "events")
    return _drain(events.groupBy("event_type").agg(F.count("*").alias("n")), "update", ["event_type"])


@query
def stream_windows(spark, d):
    """Five-minute windows of the events that are closed at the end: written once, when the watermark has passed them."""
    w = chat.windowed(_streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return _drain(w, "append").select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


# ---- further forms


@query
def known_reporters(spark, d):
    """Reports by somebody in the user table."""
    u = store.attributes(table(spark, d, "users")).select(F.col("sub").alias("reporter_uid")).filter("reporter_uid is not null").distinct()
    return table(spark, d, "reports").select("report_id", "reporter_uid").distinct().join(u, "reporter_uid", "left_semi").select("report_id", "reporter_uid")


@query
def running_total(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@query
def top_per_group(spark, d):
    """The three dearest orders of each customer; the rank's limit is pushed below the shuffle."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    o = table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return o.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query
def longest_recent_word(spark, d):
    """The longest of a text's last eight words, marks taken off, that is no number and longer than three; the first of equals."""
    return table(spark, d, "documents").select("doc_id", T.longest_recent_word(F.col("text")).alias("word"))


@query
def url_encoded(spark, d):
    return table(spark, d, "files").select("filename", F.url_encode("filename").alias("encoded")).distinct()


@query
def date_display(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM dd, yyyy").alias("shown"))


@query
def base64_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.base64(F.encode("n_name", "utf-8")).alias("b"))


@query
def session_events(spark, d):
    """Sessions of users' events: runs without a gap of half an hour."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("s.start").alias("start"), "n")


@query
def history_merge(spark, d):
    """A chat's history with the turn that follows: arrays concatenated, then counted by role."""
    turn = F.array(F.struct(F.lit("user").alias("role"), F.lit("And then?").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("That is all.").alias("content")))
    c = conversation.fullest(table(spark, d, "conversations"))
    m = c.select("conv_id", F.explode(F.concat(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), turn)).alias("m"))
    return m.groupBy("conv_id", conversation.role(F.col("m.role")).alias("role")).agg(F.count("*").alias("n"))


@query
def server_events(spark, d):
    """Regions as the lines that a browser reads."""
    return chat.server_events(table(spark, d, "region").select(F.lit("chunk").alias("type"), F.col("r_name").alias("text")))


@query
def event_lines(spark, d):
    """Lines of all three sorts, read again."""
    r = table(spark, d, "region")
    kind = F.when(F.col("r_regionkey") == 0, "error").when(F.col("r_regionkey") == 1, "done").otherwise("chunk")
    lines = chat.server_events(r.select(kind.alias("type"), F.col("r_name").alias("text"), F.when(kind == "done", F.lit("c1")).alias("conv_id")))
    return chat.read_events(lines, "line")


@query
def relative_time_text(spark, d):
    """Upload times as text: missing ones are just now, malformed ones a while ago."""
    f = table(spark, d, "files").select("filename", "uploaded_at").distinct()
    return f.select("filename", "uploaded_at", T.relative_time(F.col("uploaded_at"), F.lit(NOW).cast("timestamp")).alias("ago"))


@query
def rolling_sections(spark, d):
    """The last five pages up to each, anew at every heading."""
    b = pages(spark, d).filter("type = 'docx_section'").select("raw_id", "source", "seq", "section_heading", F.left(F.coalesce("page_content", F.lit("")), F.lit(20)).alias("head"))
    s = layout.sections(b, "source", "seq", "raw_id", F.coalesce(F.trim("section_heading"), F.lit("")) != "")
    return layout.rolling(s, ["source"], ["seq", "raw_id"], "head", 5, "section").select("raw_id", "context")


@query
def users_by_joined(spark, d):
    u = store.attributes(table(spark, d, "users")).distinct().filter("joined is not null")
    return u.select("id", F.unix_micros("joined").alias("joined")).orderBy(F.col("joined").desc(), "id")


@query
def customers_by_name(spark, d):
    return table(spark, d, "customer").select("c_name", "c_custkey").orderBy("c_name", "c_custkey")


@query
def file_list(spark, d):
    return store.file_list(table(spark, d, "files")).distinct()


@query
def log_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", T.log_snippet(F.col("text")).alias("snippet"))


@query
def kilobytes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.kilobytes(F.col("n_chars")).alias("kb"))


@query
def html_titles(spark, d):
    html = F.concat(F.lit("<html><TITLE>"), "n_name", F.lit("\n</Title><title>x</title>"))
    return table(spark, d, "nation").select("n_nationkey", T.html_title(F.when(F.col("n_nationkey") > 3, html).otherwise(F.lit("none"))).alias("title"))


@query
def paragraph_split(spark, d):
    p = table(spark, d, "documents").select("doc_id", T.paragraphs(F.coalesce("text", F.lit(""))).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", "¶").alias("paragraphs"))


@query
def iso_times(spark, d):
    return table(spark, d, "documents").filter("published_at is not null").select("doc_id", T.iso(F.col("published_at").cast("timestamp")).alias("published"))


@query
def thousands(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.grouped(F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).otherwise((F.col("c_custkey") * 7919).cast("string"))).alias("shown"))


@query
def allowed_states(spark, d):
    r = table(spark, d, "reports").dropDuplicates(["report_id"])
    return r.select("report_id", store.allowed(F.lower(F.trim("status")), ("done", "ignored")).alias("allowed"))


@query
def usable_names(spark, d):
    return table(spark, d, "users").select("username").distinct().select("username", T.usable_name(F.col("username")).alias("usable"), T.usable_name(F.left("username", F.lit(2))).alias("short"))


@query
def delete_everywhere(spark, d):
    """A source deleted from pages and uploads together: what is left, by table."""
    gone = table(spark, d, "raw_docs").groupBy("source").agg(F.countDistinct("raw_id").alias("n")).filter("n > 20").select("source")
    left = store.delete_everywhere({"pages": (pages(spark, d), "source"), "files": (table(spark, d, "files"), "filename")}, gone, "source")
    return left["pages"].agg(F.count("*").alias("n")).select(F.lit("pages").alias("tab"), "n").unionByName(left["files"].agg(F.count("*").alias("n")).select(F.lit("files").alias("tab"), "n"))


@query
def attribute_update(spark, d):
    """Unconfirmed users get a role; others keep theirs."""
    u = store.set_attribute(table(spark, d, "users"), F.col("userstatus") == "UNCONFIRMED", "custom:role", F.lit("guest"))
    return store.attributes(u).select("id", "role").distinct()


@query
def identity_rewrite(spark, d):
    """Reports with the reporter's id taken from the user with the same address."""
    u = store.attributes(table(spark, d, "users")).select(F.nullif("email", F.lit("")).alias("reporter_email"), "sub")
    r = table(spark, d, "reports").dropDuplicates(["report_id"]).select("report_id", "reporter_email", "reporter_uid")
    return store.rewrite_key(r, u, "reporter_email", "reporter_uid", "sub").select("report_id", "reporter_uid")


@query
def first_row_header(spark, d):
    n = F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.when(n == 1, "Nations: ").otherwise("  "), "n_name").alias("line"))


@query
def model_messages(spark, d):
    """The messages for a model with a picture block for some, as their roles and texts, and the marked question."""
    c = conversation.fullest(table(spark, d, "conversations"))
    image = F.when(F.length("conv_id") % 2 == 0, F.base64(F.encode("conv_id", "utf-8")))
    m = conversation.message_list(F.lit("Be brief."), F.col("messages"), F.coalesce("title", F.lit("?")), image)
    said = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), conversation.text_of(x["content"]))), "|")
    marked = conversation.shown(F.coalesce("title", F.lit("?")), image.isNotNull())
    return c.select("conv_id", said.alias("said"), marked.alias("marked"), conversation.without_marker(marked).alias("bare"))


@query
def vector_norms(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", retrieval.normalised(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("size"))


# ---- models passed in, by deterministic stand-ins


@query
def embedded_texts(spark, d):
    """Vectors of three counts, at length 1."""
    q = table(spark, d, "eval_items").select("item_id", "question")
    e = retrieval.embed(q, "question", lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts])
    return e.select("item_id", F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"), F.round(F.col("embedding")[2], 6).alias("z"))


def _by_length(question, texts):
    """Longest modulo 97 first, one place too many; questions of some lengths make it fail."""
    if len(question) % 7 == 0:
        raise TimeoutError
    return [(i, len(t or "") % 97) for i, t in enumerate(texts)] + [(len(texts), 1000)]


@query
def reranked_by_model(spark, d):
    hits = _sparse(spark, d, 10).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), "key").join(table(spark, d, "eval_items").select(F.col("item_id").alias("qkey"), "question"), "qkey")
    return retrieval.rerank_batches(hits, _by_length, 5)


@query
def rewritten_queries(spark, d):
    """The question behind the history in capitals; the model fails on batches that hold a blank one."""
    c = conversation.fullest(table(spark, d, "conversations")).select("conv_id", "messages", F.coalesce("title", F.lit("")).alias("title"))
    out = retrieval.rewritten(c, "messages", "title", lambda ps: [p.rpartition("Latest Question: ")[2].upper() + (" *" if p.startswith("Chat History:\nNo previous") else "") for p in ps])
    return out.select("conv_id", "query")


@query
def extracted_records(spark, d):
    """Records read from a model's JSON; broken answers are null."""
    said = lambda ts: ["{" if len(t) % 5 == 0 else '{"n": %d, "kind": "q"}' % len(t) for t in ts]
    r = retrieval.extracted(table(spark, d, "eval_items").select("item_id", "question"), "question", "n long, kind string", said)
    return r.select("item_id", F.coalesce("record.n", F.lit(-1)).alias("n"), F.coalesce("record.kind", F.lit("none")).alias("kind"))


@query
def recognised(spark, d):
    """A model that fails twice on every batch and then answers, without waiting; a null gives an empty text."""
    tries = {}

    def model(texts):
        tries[texts[0]] = tries.get(texts[0], 0) + 1
        if tries[texts[0]] < 3:
            raise TimeoutError
        return [t[::-1] for t in texts]

    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") != 5, F.col("n_name")).alias("image"))
    return retrieval.in_batches(n, "image", "text", "string", model, lambda t: "", 3, lambda s: None).select("n_nationkey", "text")


@query
def bm25_chunks(spark, d):
    """Document frequencies over the final chunks, saved and loaded."""
    chunks = chunking.chunk(pages(spark, d)).select("chunk_id", "text")
    path = f"{session.shared_folder(spark)}/state-{spark.sql('SELECT uuid()').first()[0]}"
    retrieval.save_state(retrieval.term_counts(chunks, "chunk_id", "text"), retrieval.corpus_statistics(chunks, "chunk_id", "text"), path)
    return retrieval.load_state(spark, path)[0]


@query
def file_kinds(spark, d):
    return table(spark, d, "raw_docs").select("source").distinct().select("source", T.file_kind(F.col("source")).alias("icon"), T.file_kind(F.col("source"), True).alias("mime"))


@query
def stable_choices(spark, d):
    """Choices that look random and are the same in every run: even, weighted, a number, a sample and an order."""
    c = table(spark, d, "customer").select("c_custkey")
    key = F.col("c_custkey")
    return c.select("c_custkey", T.pick(key, ["a", "b", "c"]).alias("even"), T.pick(key, ["often", "rarely"], [9.0, 1.0]).alias("weighted"), T.between(key, 10, 19).alias("number"), (T.fraction(key) < 0.25).alias("sampled"))


@query
def local_times(spark, d):
    return table(spark, d, "documents").filter("published_at is not null").select("doc_id", T.local_time(F.col("published_at").cast("timestamp")).alias("shown"))


@query
def inline_relation(spark, d):
    """A relation written out, joined to the nations it names."""
    fees = spark.createDataFrame([(1, 10), (2, 20), (99, 30)], "n_nationkey long, fee long")
    return table(spark, d, "nation").join(F.broadcast(fees), "n_nationkey").select("n_nationkey", "n_name", "fee")


@query
def status_filter(spark, d):
    """Reports by an optional state: those that are done, and all of them."""
    r = table(spark, d, "reports").dropDuplicates(["report_id"]).select("report_id", "status")
    both = {k: store.with_status(r, k).select("report_id", F.lit(k).alias("asked")) for k in ("done", "all")}
    return both["done"].unionByName(both["all"])


@query
def user_by_address(spark, d):
    """The sub of the first user with the address of any report's reporter."""
    u = store.attributes(table(spark, d, "users")).filter("email <> ''")
    asked = table(spark, d, "reports").select("reporter_email").filter("reporter_email <> ''").groupBy().agg(F.min("reporter_email").alias("email"))
    return u.join(F.broadcast(asked), "email").groupBy("email").agg(F.min("sub").alias("sub"))


@query
def page_extraction(spark, d):
    """Text of the first extractor or the second, by columns where they give more, and what is done with the page: boxes are made of numbers at hand."""
    p = pages(spark, d).withColumn("boxes", F.pmod("raw_id", F.lit(60))).withColumn("first", F.when(F.pmod("raw_id", F.lit(7)) != 0, F.col("page_content")))
    linear = layout.page_text(F.col("first"), F.coalesce("section_heading", F.lit("")))
    p = p.withColumn("linear", linear).withColumn("columns", F.concat("linear", F.lit("\n\nmore")))
    p = p.withColumn("thin", T.needs_recognition(T.quality(F.col("linear"))))
    text = layout.column_aware(F.col("linear"), F.col("columns"), F.col("boxes"), F.col("thin"))
    p = p.withColumn("text", text).withColumn("ocr", T.needs_recognition(T.quality(F.col("text")), boxes=F.col("boxes")))
    return p.select("raw_id", F.length("text").cast("long").alias("n"), "ocr", layout.is_table_page(F.when(F.col("ocr"), "pdf_ocr").otherwise("pdf"), T.strip(F.col("text"))).alias("tables"))


@query
def table_noise(spark, d):
    """Boxes too small to be a table."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", layout.box_area(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.col("l_linenumber") * 5.0).alias("area"))
    return li.filter("area < 500").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query
def thread_state(spark, d):
    """State of threads, the last value written of each key: users as threads, event types as keys."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("thread"), F.struct("ts", "event_id").alias("seq"), F.create_map("event_type", F.col("event_id").cast("string")).alias("values"))
    s = chat.state_of(e).select("thread", F.array_sort(F.map_entries("values")).alias("e"))
    return s.select("thread", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("state"))
