"""Operators on hand-made rows: nulls, blanks, ties, repeats, empty tables, and the traps of each."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from marlspike import session
from marlspike.functions import text as T
from marlspike.operators import chunking, conversation, layout, retrieval, store
from marlspike.sources import readers, sinks
from marlspike.streaming import chat


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("", ""),
        (" \n\t ", ""),
        ("con-\nnection", "connection"),
        ("con-\r\n  nection", "connection"),
        ("12\nbody\n 7 \n", "body"),
        ("a b\x0bc", "a b c"),
        ("a\x00b  c\td", "ab c d"),
        ("\xa0x\xa0", "x"),
        ("12345\nx", "12345 x"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, T.clean, raw) == want


@pytest.mark.parametrize("raw, want", [(None, 0), ("  ", 0), ("abc", 1), ("x" * 4003, 1000), ("x" * 4004, 1001)])
def test_tokens(spark, raw, want):
    assert one(spark, T.approx_tokens, raw) == want


@pytest.mark.parametrize("raw, want", [("CHAPTER ONE", "CHAPTER ONE"), ("# ABCDE -", "ABCDE"), ("ABCD", None), ("Chapter 1 and more", "Chapter 1 and more"), ("Plain text", None), ("X" * 100, None)])
def test_heading(spark, raw, want):
    assert one(spark, T.heading, raw) == want


def test_low_value(spark):
    assert one(spark, T.low_value, None) and one(spark, T.low_value, "short")
    assert one(spark, T.low_value, "1 2 3 4 5 6 7 8 9 0 " * 5)
    assert one(spark, T.low_value, "same words again " * 30)
    assert not one(spark, T.low_value, "A sentence of ordinary words that says something useful.")


def naive_sentences(text):
    """Sentence after sentence, a short one hung on the last."""
    parts, out = re.split(r"(?<=[.!?])\s+", text.strip()), []
    for part in parts:
        if len(part.split()) >= 5 or not out:
            out += [part] if part else []
        else:
            out[-1] += " " + part
    return out


def test_sentences_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    texts = ["", "One.", "Hi. There are five words here. Ok. Fine! Really? Now this is a longer sentence."]
    texts += [" ".join(rng.choice(["a", "word", "end.", "what?", "No!", "long", "x"]) for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.merged_sentences(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == naive_sentences(texts[r.i])


def test_citations(spark):
    got = one(spark, T.citations, "x [SOURCE: a.pdf | p. 3.0, 4] y [source: b.txt] [SOURCE:c | 12.5]")
    assert [(c.file, list(c.pages or [])) for c in got] == [("a.pdf", ["3", "4"]), ("b.txt", []), ("c", ["12.5"])]


@pytest.mark.parametrize("s, want", [(0, "just now"), (59, "just now"), (60, "1 minute ago"), (119, "1 minute ago"), (120, "2 minutes ago"), (3600, "1 hour ago"), (86400, "1 day ago"), (200000, "2 days ago"), (None, "just now")])
def test_relative_time(spark, s, want):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    then = F.lit(None).cast("timestamp") if s is None else F.timestamp_seconds(F.unix_timestamp(now) - s)
    assert spark.range(1).select(T.relative_time(then, now)).first()[0] == want


def test_template_and_padding(spark):
    assert spark.range(1).select(T.fill_template(F.lit("{a}-{b}"), {"a": F.lit(1), "b": F.lit(None)})).first()[0] == "1-"
    assert one(spark, lambda c: T.pad(c, 3), "abcdef") == "abcdef" and one(spark, lambda c: T.pad(c, 4, left=True), "ab") == "  ab"


def naive_pack(parts, limit, overlap):
    """The rule as a loop over the parts, with the carried parts kept in a list."""
    out, cur, n = [], [], 0
    for p in parts:
        k = chunking.count_tokens(p)
        if n + k > limit and cur:
            out.append(" ".join(cur))
            keep, m = [], 0
            for q in reversed(cur if overlap else []):
                keep.insert(0, q)
                m += chunking.count_tokens(q)
                if m >= overlap:
                    break
            cur, n = keep, m
        cur.append(p)
        n += k
    return out + ([" ".join(cur)] if cur else [])


def test_pack_against_the_plain_loop():
    rng = random.Random(5)
    for _ in range(200):
        parts = ["x" * rng.choice([20, 100, 200, 240, 900, 8000]) for _ in range(rng.randint(0, 30))]
        limit, overlap = rng.choice([(1000, 150), (100, 0), (60, 30)])
        assert chunking.pack(parts, limit, overlap) == naive_pack(parts, limit, overlap)
    sizes = [2000, 50, 50, 60, 50]
    parts = [c * 4 * n for c, n in zip("Sabcd", sizes)]
    assert ["".join(sorted(set(x.replace(" ", "")))) for x in chunking.pack(parts, 1000, 150)] == ["S", "Sa", "Sab", "Sabc", "abcd"]


PAGE = "raw_id long, source string, seq int, page int, page_content string"


def test_chunks(spark):
    long = " ".join(f"Sentence number {i} says that the office is open on weekdays." for i in range(200))
    rows = [
        (1, "a", 0, 1, "CHAPTER ONE"),
        (2, "a", 1, 2, "The office of records is open on every weekday from nine to five, and in term time until noon on Saturdays."),
        (3, "a", 2, 3, long),
        (4, "b", 0, None, "The office of records is open on every weekday from nine to five."),
        (5, "b", 1, None, None),
        (6, None, 0, None, "x"),
    ]
    got = chunking.chunk(spark.createDataFrame(rows, PAGE)).collect()
    by = {}
    for r in got:
        by.setdefault(r.raw_id, []).append(r)
    assert by[2][0].text.startswith("[SECTION: CHAPTER ONE]\nCHAPTER ONE The office") and by[4][0].header == T.DEFAULT_HEADING
    assert len(by[3]) > 3 and all(r.header == "CHAPTER ONE" for r in by[3])
    assert len({r.chunk_id for r in got}) == len(got)
    assert chunking.chunk(spark.createDataFrame([], PAGE)).count() == 0


def test_blocks_hand_on_what_the_next_needs(spark):
    rows = [(i, "ab"[i % 2], i, None, "CHAPTER NINE" if i == 4 else None if i == 7 else f"text {i} " * 30) for i in range(40)]
    df = spark.createDataFrame(rows, PAGE)
    for block in (1, 3, 1000):
        st = {r.raw_id: r.stitched for r in chunking.stitch(df, 5, block).collect()}
        assert st[0] == rows[0][4] and st[2].startswith("0 text 0 text 0\n") and st[9] == rows[9][4] and len(st) == 40
        hd = {r.raw_id: r.header for r in chunking.carry_headings(df, "page_content", "none", block).collect()}
        assert hd[2] == "none" and hd[4] == hd[38] == "CHAPTER NINE" and hd[5] == "none"
        sec = {r.raw_id: r.section for r in layout.sections(df, "source", "seq", "raw_id", F.col("raw_id") % 10 == 0, block).collect()}
        assert sec[0] == 1 and sec[8] == 1 and sec[10] == 2 and sec[39] == 0 and sec[38] == 4


def test_retrieval_by_hand(spark):
    docs = spark.createDataFrame([(1, "boat safety drill"), (2, "library fines fines"), (3, None), (4, "")], "doc_id long, text string")
    qs = spark.createDataFrame([(9, "library fines?"), (8, "nothing here matches"), (7, None)], "q long, t string")
    got = retrieval.sparse_topk(docs, "doc_id", "text", qs, "q", "t").collect()
    assert [(r.qkey, r.key, r["rank"]) for r in got] == [(9, 2, 1)]


def test_dense_ties_take_the_lower_key(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)] + [(30, None)], "k long, v array<float>")
    q = spark.createDataFrame([(5, [1.0, 0.0])], "q long, v array<float>")
    assert [r.key for r in retrieval.dense_topk(v, "k", "v", q, "q", "v", 3).orderBy("rank").collect()] == [0, 1, 2]
    assert retrieval.dense_topk(v, "k", "v", q.limit(0), "q", "v", 3).count() == 0


def test_fusion_and_context(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qkey long, key long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "qkey long, key long, rank int")
    f = retrieval.fuse({"a": (a, 0.4), "b": (b, 0.6)}).orderBy("rank").collect()
    assert [r.key for r in f] == [11, 10] and abs(f[0].score - (0.4 / 62 + 0.6 / 61)) < 1e-8
    hits = spark.createDataFrame([(1, 2, None, None, "b"), (1, 1, "Base.pdf", 3, "a")], "qkey long, rank int, source string, page int, text string")
    text = retrieval.context(hits, base="base").first().context
    assert text.startswith("[DOCUMENT 1]\nSource: Base.pdf | Page: 3\nContent:\na\n\n---\n\n[DOCUMENT 2]") and text.endswith("Source: Unknown | Page: ?\nContent:\nb")


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 2), (2, "c", 2)], "k long, v string, n int")
    assert {(r.k, r.v) for r in store.latest(old, ["k"], [F.col("n")]).collect()} == {(1, "a"), (2, "c")}
    new = spark.createDataFrame([(2, "z", 3)], "k long, v string, n int")
    up = store.upsert(store.latest(old, ["k"], [F.col("n")]), new, ["k"])
    assert {(r.k, r.v) for r in up.collect()} == {(1, "a"), (2, "z")}
    assert {(r.k, r.v) for r in store.upsert(up, new, ["k"]).collect()} == {(1, "a"), (2, "z")}
    assert {r.k for r in store.delete_keys(up, new, ["k"]).collect()} == {1}
    assert store.delete_where(up, F.col("v") == F.lit(None)).count() == 2
    assert {r.v for r in store.update(up, F.col("k") == 1, {"v": F.lit("q")}).collect()} == {"q", "z"}
    u = spark.createDataFrame([("1", "m"), ("2", "m"), ("3", None)], "id string, mail string")
    assert {r.id for r in store.delete_stale(u, u.filter("id = '2'"), "id", "mail").collect()} == {"2", "3"}
    assert store.insert(u, "id", {"state": F.lit("pending")}).select("id").distinct().count() == 3


def test_attributes_defaults(spark):
    kind = "username string, userstatus string, usercreatedate timestamp, attributes array<struct<name: string, value: string>>"
    df = spark.createDataFrame([("a", None, None, [("email", "x@y.z"), ("name", "")]), ("b", None, None, None), ("c", None, None, [])], kind)
    got = {r.id: (r.username, r.role, r.email) for r in store.attributes(df).collect()}
    assert got == {"a": ("x", "user", "x@y.z"), "b": ("", "user", ""), "c": ("", "user", "")}


MESSAGES = "conv_id string, uid string, messages array<struct<role: string, content: string>>"


def chats(spark, *histories):
    return spark.createDataFrame([(f"c{i}", "u", h) for i, h in enumerate(histories)], MESSAGES)


@pytest.mark.parametrize("n, want", [(0, 0), (5, 5), (6, 6), (10, 6), (11, 6)])
def test_last_six(spark, n, want):
    df = chats(spark, [("User " if i % 2 else "ai", str(i)) for i in range(n)])
    got = df.select(conversation.last_n(F.col("messages"), 6).alias("m")).first().m
    assert [m.content for m in got] == [str(i) for i in range(n)][-6:] and len(got) == want


def test_titles_and_compaction(spark):
    df = chats(spark, [("system", "s"), ("HUMAN", "q" * 50)], [("assistant", "a")], None, [("user", str(i)) for i in range(11)])
    got = df.select("conv_id", conversation.title(F.col("messages")).alias("t"), F.size(conversation.compact(F.col("messages"))).alias("n")).orderBy("conv_id").collect()
    assert [r.t for r in got] == ["q" * 40, "Untitled Chat", "Untitled Chat", "0"] and got[3].n == 7 and got[0].n == 2


def test_report_cut(spark):
    c = chats(spark, [("user", "q"), ("assistant", "answer one"), ("user", "q"), ("bot", "answer two")])
    r = spark.createDataFrame([("r1", "u", "c0", "answer one"), ("r2", "u", "c0", None), ("r3", "u", "gone", "x"), ("r4", "u", "c0", "answer t")], "report_id string, reporter_uid string, conv_id string, msg_snippet string")
    assert {x.report_id: x.cut for x in conversation.reported(r, c).collect()} == {"r1": 2, "r2": 4, "r3": -1, "r4": 4}


def test_layout(spark):
    w = spark.createDataFrame([(1, x) for x in [5.0, 15.0, 16.0, 25.0, 65.0, 66.0, 75.0, 99.0, 100.0, 101.0, -1.0]], "p int, x double")
    h = layout.histogram(w, "p", F.col("x"), F.lit(100.0))
    assert {r.bucket: r.n for r in h.collect()} == {0: 2, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0, 6: 2, 7: 1, 8: 0, 9: 3}
    gaps = layout.gaps(h, "p")
    assert {(r.start, r.stop) for r in gaps.collect()} == {(3, 6)}
    assert [(r.column, r.left, r.right) for r in layout.columns(gaps, "p", w).orderBy("column").collect()] == [(1, 0.0, 4.5), (2, 4.5, 10.0)]
    rows = spark.createDataFrame([("t", 1, ["h", "i"]), ("t", 2, ["a"]), ("t", 3, [None, "b"])], "t string, r int, c array<string>")
    assert layout.markdown(rows, "t", "r", "c").first().markdown == "| h | i |\n| --- | --- |\n| a |  |\n|  | b |"
    m = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.25, 3.0), (2, 1.0, 0.0)], "g int, v double, w double")
    assert {r.g: r["mean"] for r in layout.weighted_mean(m, ["g"], F.col("v"), F.col("w"), F.lit(True)).collect()} == {1: 2.12, 2: 0.0}


def docx(blocks):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{blocks}</w:body></w:document>")
    return out.getvalue()


def para(t, style=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"


def test_readers(spark, tmp_path):
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = para("before") + para("Part", "Heading2") + para("inside") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}</w:tr></w:tbl>" + para(" ")
    (tmp_path / "d.DOCX").write_bytes(docx(body))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    (tmp_path / "n.txt").write_text("plain\ntext")
    (tmp_path / "t.csv").write_text("x,y\n1,2\n3,\n")
    (tmp_path / "p.pdf").write_bytes(b"one\x0c \x0cthree")
    (tmp_path / "skip.bin").write_bytes(b"0")
    got = {(r.source, r.seq): r for r in readers.corpus(spark, str(tmp_path), lambda b: b.decode().split("\x0c")).collect()}
    assert got["d.DOCX", 0].page_content == "before" and got["d.DOCX", 1].section_heading == "Part"
    assert got["d.DOCX", 1].page_content == "## Part\ninside\n| a | b |\n| --- | --- |\n| c |  |"
    assert got["bad.docx", 0].type == "unreadable" and got["n.txt", 0].page_content == "plain\ntext"
    assert sorted(r.page_content for k, r in got.items() if k[0] == "t.csv") == ["x: 1\ny: 2", "x: 3\ny: "]
    assert {r.page: r.page_content for k, r in got.items() if k[0] == "p.pdf"} == {1: "one", 3: "three"}
    assert "skip.bin" not in {k[0] for k in got}


def test_sinks(spark, tmp_path):
    assert list(sinks.batched(range(5), 2)) == [[0, 1], [2, 3], [4]]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    sinks.create(spark, path, df.schema)
    sinks.create(spark, path, df.schema)
    merged = sinks.upsert_into(spark, path, df, ["k"])
    assert merged.count() == 2 and spark.read.schema(df.schema).parquet(path).count() == 0
    assert {r.json for r in sinks.json_rows(df).collect()} == {'{"k":1,"v":"a"}', '{"k":2,"v":"b"}'}
    bad = spark.createDataFrame([([1.0],)], "v array<double>")
    assert sinks.check_dimension(bad, "v", 1).count() == 1
    with pytest.raises(Exception, match="length"):
        sinks.check_dimension(bad, "v", 2).collect()


def test_token_stream(spark, tmp_path):
    rows = [("a", 2, "chunk", "lo"), ("a", 1, "chunk", "hel"), ("a", 3, "done", None), ("b", 1, "chunk", "x"), ("b", 2, "abort", None), ("c", 1, "chunk", "open")]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame(rows, "conv_id string, seq int, type string, text string")
    df.coalesce(1).write.parquet(src)
    stream = chat.answers(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    # a timeout by the clock keeps a query of availableNow alive; one batch is enough here
    assert q.awaitTermination(60)
    got = {r.conv_id: (r.answer, r.ended) for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {"a": ("hello", "done"), "b": ("x" + chat.STOPPED, "abort")}


def test_ingest_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "a", 0, 1, "The office of records is open on every weekday from nine to five.")]
    df = spark.createDataFrame(rows, PAGE)
    df.write.parquet(src)
    seen = {}
    q = chat.ingest(spark.readStream.schema(df.schema).parquet(src), chunking.chunk, lambda b, n: seen.update({n: b.count()}), str(tmp_path / "c"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert list(seen.values()) == [1]


def test_unlike_csv_files_keep_their_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\nann,3\n\"b, c\",\"4\n5\"\nshort\n")
    (tmp_path / "b.csv").write_text("\ufeffcity,zip,land\nx,1,y\n")
    (tmp_path / "c.csv").write_text("")
    rows = {(r.source, r.seq): r.page_content for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert rows == {("a.csv", 0): "name: ann\nage: 3", ("a.csv", 1): "name: b, c\nage: 4\n5", ("a.csv", 2): "name: short\nage: ", ("b.csv", 0): "city: x\nzip: 1\nland: y"}


def of(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_forms_of_the_pages(spark):
    strong = lambda x: of(spark, x, T.password_strength)
    assert [strong(x) for x in ("a", "aA", "aA1", "aA1!", "aA1-", "aA1!bbbb")] == ["Weak", "Medium", "Medium", "Strong", "Medium", "Strong"]
    assert of(spark, "see the words, wordy ones 12345678 of it", T.longest_recent_word) == "words" and of(spark, "a b c 99999", T.longest_recent_word) is None
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    ago = lambda x: of(spark, x, lambda c: T.relative_time(c, now))
    assert [ago(x) for x in (None, "", "soon", "2025-12-31T23:00:00Z", "2025-12-30 00:00:00")] == ["just now", "just now", "a while ago", "1 hour ago", "2 days ago"]
    assert of(spark, 256, T.kilobytes, "long") == "0.3" and of(spark, "1234567", T.grouped) == "1,234,567" and of(spark, "x", T.grouped) == "x"
    assert of(spark, "<TITLE>a\nb</title>", T.html_title) == "a\nb" and of(spark, "a\n\n\n b ", T.paragraphs) == ["a", "b"]
    assert [of(spark, x, T.usable_name) for x in ("ab", "abc", "a@c", "a c", None)] == [False, True, False, False, False]


def test_pages_by_columns(spark):
    words = spark.createDataFrame([(1, 1.0, 0.0, "left"), (1, 8.0, 0.0, "right"), (1, 1.5, 1.0, "below"), (2, 3.0, 0.0, "only")], "p int, x double, y double, word string")
    spans = layout.columns(spark.createDataFrame([(1, 4, 6)], "p int, start int, stop int"), "p", words)
    assert {r.p: r.text for r in layout.column_text(words, "p", spans).collect()} == {1: "left below\n\nright", 2: "only"}
    df = spark.createDataFrame([(" ", "second", 30, False), ("first", "longer text", 30, False), ("first", "longer text", 9, False)], "a string, b string, n int, thin boolean")
    got = df.select(layout.page_text(F.col("a"), F.col("b")).alias("t"), layout.column_aware(F.col("a"), F.col("b"), F.col("n"), F.col("thin")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [("second", "second"), ("first", "longer text"), ("first", "first")]


def test_models_that_fail(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string")

    def broken(texts):
        raise TimeoutError

    assert [r.o for r in retrieval.in_batches(df, "t", "o", "string", broken, lambda t: "-", 3, lambda s: None).orderBy("i").collect()] == ["-", "-", "-"]
    assert [r.o for r in retrieval.in_batches(df, "t", "o", "long", lambda ts: [len(t) for t in ts]).orderBy("i").collect()] == [2, None, 0]
    assert [retrieval.backoff(k) for k in (1, 2, 3, 4)] == [2, 4, 8, 8]
    hits = spark.createDataFrame([(1, 10, 1, "q", "a"), (1, 11, 2, "q", "b"), (2, 12, 1, "r", "c")], "qkey long, key long, rank int, question string, text string")
    score = lambda q, ts: [(1, 0.9), (7, 1.0), (0, 0.1)] if q == "q" else None
    assert {(r.qkey, r.key, r["rank"]) for r in retrieval.rerank_batches(hits, score).collect()} == {(1, 11, 1), (1, 10, 2), (2, 12, 1)}
    results = spark.createDataFrame([(1, 1, 0.9), (1, 5, 0.8)], "qkey long, position long, score double")
    assert [(r.key, r.score) for r in retrieval.at_positions(results, hits).collect()] == [(11, 0.9)]


def test_state_of_the_sparse_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red boat"), (2, "red house")], "k long, t string")
    path = str(tmp_path / "state")
    assert retrieval.load_state(spark, path)[1].first().n_docs == 0
    retrieval.save_state(retrieval.term_counts(docs, "k", "t"), retrieval.corpus_statistics(docs, "k", "t"), path)
    df, stats = retrieval.load_state(spark, path)
    assert {r.term: r.df for r in df.collect()} == {"red": 2, "boat": 1, "house": 1} and stats.first().n_docs == 2


def test_token_counters_are_passed_on(spark):
    long = " ".join(f"Sentence number {i} says that the office is open." for i in range(40))
    got = chunking.chunk(spark.createDataFrame([(1, "a", 0, 1, long)], PAGE), 100, 0, count=lambda t: len(t.split())).collect()
    assert len(got) == 4 and all(len(r.text.split("\n", 1)[1].split()) <= 100 for r in got)


def test_sessions_and_state(spark):
    u = spark.createDataFrame([("t", 1, {"a": "1", "b": "1"}), ("t", 2, {"a": "2"})], "thread string, seq int, values map<string,string>")
    assert chat.state_of(u).first()["values"] == {"a": "2", "b": "1"}
    log = spark.createDataFrame([("s", 1, "new", "ann"), ("s", 2, "restore", "ann"), ("r", 1, "new", "bo"), ("r", 2, "clear", None)], "session string, seq int, what string, user string")
    assert {(r.session, r.user, r.state) for r in chat.sessions_of(log).collect()} == {("s", "ann", "open"), ("r", None, "cleared")}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    fake = type("S", (), {"conf": Conf(), "sparkContext": type("C", (), {"master": "spark://x:7077"})})
    with pytest.raises(ValueError):
        session.shared_folder(fake)


def test_pictures_of_a_document():
    out = io.BytesIO()
    w, a, r = ("http://schemas.openxmlformats.org/" + x for x in ("wordprocessingml/2006/main", "drawingml/2006/main", "officeDocument/2006/relationships"))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:a="{a}" xmlns:r="{r}"><w:body><w:p/><w:p><a:blip r:embed="rId7"/><a:blip r:embed="rId8"/></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId7" Target="media/one.png"/><Relationship Id="rId8" Target="media/gone.png"/></Relationships>')
        z.writestr("word/media/one.png", b"png")
    assert readers.docx_images(out.getvalue()) == [(1, "one.png", b"png")]


def test_choices_are_stable_and_even(spark):
    df = spark.range(4000).select(T.pick(F.col("id"), ["a", "b"], [3.0, 1.0]).alias("p"), T.between(F.col("id"), 5, 9).alias("n"))
    counts = {r.p: r["count"] for r in df.groupBy("p").count().collect()}
    assert 2800 < counts["a"] < 3200 and {r.n for r in df.select("n").distinct().collect()} == {5, 6, 7, 8, 9}


def test_index_of_cells_against_all_vectors(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    x = base[r.integers(0, 30, 1500)] + 0.4 * r.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(9999, None)], "k long, v array<double>")
    asked = df.filter("k % 50 = 0")
    pairs = lambda d: {(p.qkey, p.key) for p in d.collect()}
    exact = pairs(retrieval.dense_topk(df, "k", "v", asked, "k", "v", 10, 400))
    assert len(pairs(retrieval.cell_topk(df, "k", "v", asked, "k", "v", 10, 32, 8, 100)) & exact) >= 0.9 * len(exact)
    assert pairs(retrieval.cell_topk(df, "k", "v", asked, "k", "v", 10, 16, 16, 100)) == exact
    assert retrieval.cell_topk(df.limit(0), "k", "v", asked.limit(0), "k", "v").count() == 0
