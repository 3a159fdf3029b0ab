"""Operators for training text against brute force, round trips, held-out cases and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlspike.llm import leakage, mojibake, order_minhash, packing, pairs, personal, quality, scans, splitting, vocabulary, words

NOUNS = "registrar library clinic permit ledger harbor lantern village teacher report boat market river garden".split()
VERBS = "keeps counts repairs visits paints checks carries opens follows records".split()


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} near {r.choice(NOUNS)} {r.randint(1, 999)}."


def prose(r, n):
    return " ".join(sentence(r) for _ in range(n))


# ---- words


def test_words_are_the_runs_of_letters_and_digits():
    texts = ["", "A b_c-d", "Ñandú ₱5 naïve", "x" * 5000, "é" * 3 + "—" + "é", "tab\tnew\nline"]
    codes, counts = words.code_batch(texts)
    want = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(flat)) == len(set(codes.tolist()))
    assert words.code_batch([])[0].size == 0


# ---- 1


def shingle_set(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(*(w[i:] for i in range(k))))


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(11)
    rows = []
    for g in range(25):
        base = [sentence(r) for _ in range(14)]
        for v in range(3):
            text = list(base)
            for _ in range(v * 2):
                text[r.randrange(len(text))] = sentence(r)
            if v == 2 and g % 2:
                text = text[7:] + text[:7]
            rows.append((len(rows), " ".join(text), "extra"))
    rows += [(900, rows[0][1].upper(), "copy"), (901, None, ""), (902, "", ""), (903, "few words", ""), (904, "few words", ""), rows[5]]
    df = spark.createDataFrame(rows, "raw_id long, page_content string, same string")
    got = order_minhash.near_duplicates(df, "raw_id", "page_content", k=3, threshold=0.6, measure="jaccard", min_words=30, sketches=48, samples=3, sketch_k=4)
    sets = {i: shingle_set(t, 3) for i, t, _ in rows if t and len(re.findall(r"[^\W_]+", t)) >= 30}
    ids = sorted(sets)
    want = {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(p.id_a, p.id_b) for p in got.pairs().collect()} == want and len(want) > 30
    per = got.per_record().collect()
    assert len(per) == len(sets) and {p.id: p.class_id for p in per}[900] == 0
    empty = order_minhash.near_duplicates(df.limit(0), "raw_id", "page_content")
    assert empty.pairs().count() == 0 and empty.per_record().count() == 0


def test_banded_distance_against_the_full_table():
    def full(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    r = random.Random(2)
    a, b = [], []
    for _ in range(120):
        x = [r.randrange(6) for _ in range(r.randrange(0, 30))]
        y = list(x)
        for _ in range(r.randrange(0, 9)):
            op, i = r.random(), r.randrange(0, len(y) + 1)
            y[i : i + (op < 0.6)] = [r.randrange(6)] if op < 0.7 else []
        a.append(np.array(x, np.uint64) + np.uint64(5))
        b.append(np.array(y, np.uint64) + np.uint64(5))
    got = order_minhash.edit_distance_banded(a, b, 8)
    assert got.tolist() == [min(9, full(x.tolist(), y.tolist())) for x, y in zip(a, b)]


def test_distance_of_long_texts_takes_no_rows_of_arrays(monkeypatch):
    r = random.Random(21)
    x = [r.randrange(1 << 40) for _ in range(3000)]
    y = list(x)
    for i in r.sample(range(3000), 90):
        y[i] = 7
    y[1500:1500] = [8] * 60
    moved = x[1500:] + x[:1500]
    calls = []
    monkeypatch.setattr(order_minhash.np, "full_like", lambda *a: calls.append(1) or np.zeros_like(a[0]) + a[1])
    got = order_minhash.edit_distance_banded([np.array(x, np.uint64)] * 3, [np.array(z, np.uint64) for z in (y, moved, x)], 256)
    assert got.tolist() == [150, 257, 0] and not calls


def test_edit_measure_needs_order(spark):
    r = random.Random(4)
    base = [sentence(r) for _ in range(20)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:9] + [sentence(r)] + base[10:])), (3, " ".join(base[10:] + base[:10]))]
    df = spark.createDataFrame(rows, "i long, t string")
    links = {(x.rep_a, x.rep_b) for x in order_minhash.near_duplicates(df, "i", "t", k=3, threshold=0.8, measure="edit").links.collect()}
    assert links == {(1, 2)}


def test_texts_that_repeat_themselves_and_wide_edits(spark):
    r = random.Random(14)
    base = prose(r, 12)
    long = [f"w{r.randrange(9000)}" for _ in range(1600)]
    eighth = [w if i % 8 else f"x{i}" for i, w in enumerate(long[:600])]
    inserted = long[:800] + [f"y{i}" for i in range(120)] + long[800:]
    df = spark.createDataFrame([(1, base), (2, " ".join([base] * 6)), (3, " ".join(long[:600])), (4, " ".join(eighth)), (5, " ".join(long)), (6, " ".join(inserted))], "i long, t string")
    sets = order_minhash.near_duplicates(df, "i", "t", k=3, threshold=0.6, measure="jaccard", min_words=30, sketches=64, samples=3, sketch_k=4)
    assert (1, 2) in {(x.id_a, x.id_b) for x in sets.pairs().collect()}
    edit = order_minhash.near_duplicates(df, "i", "t", k=3, threshold=0.8, sketches=64)
    assert {(x.rep_a, x.rep_b, x.edits) for x in edit.links.collect()} >= {(3, 4, 75), (5, 6, 120)}


def test_alignment_proves_what_it_accepts():
    r = random.Random(15)
    for _ in range(60):
        x = [r.randrange(40) for _ in range(90)]
        y = list(x)
        for _ in range(r.randrange(0, 12)):
            i = r.randrange(len(y))
            y[i : i + r.randrange(2)] = [r.randrange(40)] * r.randrange(2)
        a, b = (np.unique(words.shingles(np.array(z, np.uint64) + np.uint64(1), 3)) for z in (x, y))
        most = int((max(len(a), len(b)) - 0.375 * (len(a) + len(b))) / 3)
        d = order_minhash.edit_distance_banded([np.array(x, np.uint64)], [np.array(y, np.uint64)], max(1, most))[0]
        both = order_minhash.shared(a, b)
        assert d > most or both / (len(a) + len(b) - both) >= 0.6


def test_large_buckets_are_taken_apart_whole(monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 4)
    r = random.Random(18)
    width = order_minhash.KEY_BYTES
    ids = [*range(10, 40), 17]
    keys = {i: [b"\1" * width, r.randbytes(width)] for i in ids} | {5: [r.randbytes(width)] * 2, -3: [b"\2" * width, b"\3" * width], 1 << 40: [b"\4" * width, b"\2" * width]}
    rows = [(i, b"".join(keys[i])) for i in [*ids, 5, -3, 1 << 40]]
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([i for i, _ in rows[a:b]], pa.int64()), "keys": [k for _, k in rows[a:b]]}) for a, b in ((0, 9), (9, len(rows)))]
    dealt = [x for b in order_minhash._scattered(2, 3)(iter(batches)) for x in b.to_pylist()]
    met = [[{"keys": x["keys"], "ids": x["ids"]} for x in dealt if x["part"] == p] for p in range(3)]
    one = pa.RecordBatch.from_pydict({"met": pa.array([m for m in met if m])})
    buckets = [x for b in order_minhash._met(iter([one])) for x in b.column(0).to_pylist()]
    found = {(x, y) for b in buckets for x in b for y in b if x < y}
    assert found == {(x, y) for x in range(10, 40) for y in range(x + 1, 40)} | {(-3, 1 << 40)}
    assert max(map(len, buckets)) <= 8


def test_bit_tables_bound_what_is_common():
    r = random.Random(19)
    settled = 0
    for _ in range(300):
        base = [r.randrange(1 << 30) for _ in range(r.randint(30, 900))]
        other = base[: r.randint(0, len(base))] + [r.randrange(1 << 30) for _ in range(r.randint(30, 400))]
        (n_a, a), (n_b, b) = ((len(k), t) for k, t in (_table(x) for x in (base, other)))
        x, y = (set(words.shingles(np.array(z, np.uint64), 3).tolist()) for z in (base, other))
        bound = order_minhash.most_common(n_a, a, n_b, b)
        assert bound >= len(x & y)
        settled += bound < 0.375 * (n_a + n_b) and len(x & y) < 0.3 * (n_a + n_b)
    assert settled > 100


def _table(codes):
    kmers = np.unique(words.shingles(np.array(codes, np.uint64), 3))
    return kmers, order_minhash.bits_of(kmers)


def test_a_common_passage_moves_no_pairs(spark):
    r = random.Random(20)
    passage = " ".join(prose(r, 1).split()[:9])
    rows = [(i, " ".join([passage, *(f"w{r.randrange(10**6)}" for _ in range(40))])) for i in range(400)]
    rows += [(1000, rows[0][1] + " more of it")]
    df = spark.createDataFrame(rows, "i long, t string")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {x.stageId() for x in _stages(store)}
    got = order_minhash.near_duplicates(df, "i", "t", k=3, threshold=0.6, measure="jaccard", min_words=30, sketches=64, samples=3, sketch_k=4)
    assert {(x.rep_a, x.rep_b) for x in got.links.collect()} == {(0, 1000)}
    written = [x.shuffleWriteRecords() for x in _stages(store) if x.stageId() not in before]
    # the tuples of the passage are in hundreds of records each, and so in tens of thousands of pairs
    assert max(written) < 5_000


def _stages(store):
    found = store.stageList(None, False, False, *(getattr(store, f"stageList$default${i}")() for i in (4, 5)))
    return [found.apply(i) for i in range(found.size())]


# ---- 2


@pytest.fixture(scope="module")
def model():
    return personal.fit(), frozenset(x.lower() for x in personal._GIVEN), frozenset(x.lower() for x in personal._SURNAME)


def test_held_out_sentences(model):
    right = wrong = missed = 0
    for text, gold in personal.training(300, seed=1234):
        found, want = {s.label for s in personal.find(text, *model)}, {g[2] for g in gold}
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert right > 200 and wrong <= 0.02 * right and missed <= 0.02 * right


@pytest.mark.parametrize(
    "text, want",
    [
        ("Reply to ana.lim at post dot example dot net please", {"email"}),
        ("call (0917) 555-0199 now", {"phone"}),
        ("The payment reference is 20391048821.", set()),
        ("I was told to go to Room 204, Almazor Hall.", set()),
        ("My name is Carla Bantigue.", {"name"}),
        ("Bantigue Carla asked for Mr. Esguer's permit.", {"name"}),
        ("I live at Purok 4, Barangay San Rafael, Port Aurora.", {"address"}),
        ("My ID is PSN 1234-5678-9012-3456", {"id_number"}),
        ("", set()),
        (None, set()),
    ],
)
def test_single_cases(model, text, want):
    assert {s.label for s in personal.find(text, *model)} == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("My name is Maria Santos.", {"name"}), ("I am Juan P. Reyes, student.", {"name"}), ("Ako po si Liza Manalo.", {"name"}), ("Name: Pedro Cruz", {"name"}), ("I'm Lito Ramos from Naga.", {"name"}),
        ("My course is Rural Sociology.", set()), ("Subject: Technical Drawing", set()), ("The office is Student Affairs.", set()), ("I am in Statistics Research.", set()), ("The prize is Honor Roll.", set()),
        ("my driver's license N01-12-345678", {"id_number"}), ("license no. N01-12-345678 was lost", {"id_number"}),
    ],
)
def test_names_without_a_lexicon(model, text, want):
    assert {s.label for s in personal.find(text, model[0], frozenset(), frozenset())} == want


def test_held_out_templates(model):
    r = random.Random(77)
    frames = ["Kindly route the papers of {name} to me.", "{name} still waits at {address} for it.", "Text {phone} when done.", "Forward everything to {email}, thanks.", "The clerk typed {id_number} by mistake.", "pakisabi kay {name} na tumawag sa {phone}", "Deliver to {address} only.", "Both {email} and {phone} bounced."]
    traps = ["Room {n3} opens at 8:00 AM.", "We paid PHP {n2},{n3}.00 in May 2023.", "Section {n2} of the handbook applies.", "The Drawing Hall holds {n3} seats.", "It took {n2} days and {n2} nights."]
    right = wrong = missed = 0
    for _ in range(300):
        gold, parts = set(), []
        for part in re.split(r"(\{\w+\})", r.choice(frames + traps)):
            key = part[1:-1]
            if key in personal._MAKE:
                gold.add(key)
            parts.append(personal._MAKE[key](r) if key in personal._MAKE else personal._d(r, "9" * int(key[1:])) if part.startswith("{n") else part)
        found = {s.label for s in personal.find("".join(parts), *model)}
        right, wrong, missed = right + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert right > 200 and wrong <= 0.03 * right and missed <= 0.03 * right, (right, wrong, missed)


def test_a_lexicon_of_any_size_gives_the_same(spark):
    people = ["Bruno Esguer", "Carla Bantigue", "Dario de la Hinagpis", "Elsa Villasin Jr."]
    users = spark.createDataFrame([([("name", p)],) for p in people], "attributes array<struct<name: string, value: string>>")
    said = ["bantigue carla was here", "Mr. Hinagpis' form", "ELSA VILLASIN JR. and Esguer's card", "Bruno Esguer", "nobody", None, "Bruno Esguer"]
    texts = spark.createDataFrame([("t", str(i), "f", 0, x) for i, x in enumerate(said)], "tab string, rec_id string, field string, msg_idx int, text string")
    sent, joined = ({(r.rec_id, r.masked, tuple(r.types)) for r in personal.mask_texts(texts, users, n).collect()} for n in (100, 2))
    assert sent == joined and sum(bool(x[2]) for x in sent) >= 4


def test_masking(spark, model):
    text = "I am Bruno Esguer, reach me at bruno@mail.example."
    assert personal.mask(text, personal.find(text, *model)) == "I am [NAME], reach me at [EMAIL]."
    users = spark.createDataFrame([([("name", "Bruno Esguer")],), (None,)], "attributes array<struct<name: string, value: string>>")
    texts = spark.createDataFrame([("t", "1", "f", 0, text), ("t", "2", "f", 0, None), ("t", "3", "f", 0, "plain " * 20000)], "tab string, rec_id string, field string, msg_idx int, text string")
    got = {r.rec_id: r for r in personal.mask_texts(texts, users).collect()}
    assert got["1"].types == ["email", "name"] and got["2"].masked is None and got["3"].types == []


# ---- 3


@pytest.mark.parametrize("text, want", [(None, True), (" \n", True), ("N/A", True), ("...", True), ("<br>", True), ("​", True), ("Yes.", False), ("No, it is free.", False), ("(no response)", True)])
def test_filler(text, want):
    assert pairs.is_filler(text) is want


def test_copies():
    q = "Is there a fee for the dormitory contract this term?"
    for a in (q, q.upper(), "You asked: " + q, f"“{q}”", q.replace("a fee ", "fee "), f"{q} {q}"):
        assert pairs.is_copy(q, a), a
    for a in (f"You asked: {q} Yes, both are open.", "The fee for the dormitory contract is paid at the cashier.", "Yes."):
        assert not pairs.is_copy(q, a), a


@pytest.mark.parametrize(
    "text, want",
    [
        ("I'm sorry, but I can't help with that. Please try a different question.", True),
        ("Paumanhin po, hindi ko masasagot ang tanong na iyan.", True),
        ("I'm sorry to hear that; here is how to fix it. Go to the registrar.", False),
        ("The office will not refuse a complete request.", False),
        ("I could not find a date for that in the manual, so please ask at Window 3.", False),
        ("I can't help with that. The fee is PHP 100.", False),
    ],
)
def test_refusals(text, want):
    assert pairs.is_refusal(text) is want


def test_copies_of_any_number():
    q = "When is the deadline for the library fines?"
    for n in (1, 2, 3, 5, 8):
        assert pairs.is_copy(q, " ".join([q] * n))
    assert not pairs.is_copy(q, " ".join([q] * 3) + " It is on Friday, at the window of the cashier, before five o'clock.")


@pytest.mark.parametrize("answer", ["窓口で金曜日までに申請してください。", "Обратитесь в библиотеку до пятницы.", "请在星期五之前到窗口。", "Bạn phải nộp đơn tại quầy trước thứ sáu và không được trễ.", "Kinahanglan nimo nga moadto sa opisina ug dili ka malangan.", "Opo, libre po ito."])
def test_answers_in_other_languages(answer):
    assert pairs.speaks_otherwise("Where do I pay the fee for the library card?", answer)
    assert not pairs.speaks_otherwise(answer, answer)


def test_short_answers_in_the_same_language():
    for answer in ("Yes, it is.", "On Friday.", "Room 3", "OK", "PHP 300.00"):
        assert not pairs.speaks_otherwise("Where do I pay the fee for the library card?", answer)


@pytest.mark.parametrize("text", ["This request violates our usage policy.", "No comment.", "We are unable to discuss this matter.", "Your request has been declined.", "That is not something I can talk about.", "As an AI model, I can't answer that."])
def test_further_refusals(text):
    assert pairs.is_refusal(text)


def test_pairs(spark):
    done = "The office keeps the records of the permit on the second floor of the annex."
    chats = [
        ("a", "u", [("User", "What is the rule on the permit?"), ("ai", None)]),
        ("b", "u", [("human", "What is the rule on the permit?")]),
        ("c", "u", [("user", "What is the rule on the permit?"), ("assistant", "What is the rule on the permit?")]),
        ("d", "u", [("user", "What is the rule on the permit?"), ("assistant", "Selon le doyen, le dossier est pour la caisse et les notes du service.")]),
        ("e", "u", [("user", "What is the rule on the permit?"), ("assistant", "The rule says that every student of the")]),
        ("f", "u", [("user", "What is the rule on the permit?"), ("ASSISTANT ", done), ("user", "thanks")]),
        ("f", "u", [("user", "What is the rule on the permit?")]),
        ("g", "u", None),
        ("h", "u", [(None, "x"), ("system", None)]),
    ]
    df = spark.createDataFrame(chats + chats[:1], "conv_id string, uid string, messages array<struct<role: string, content: string>>")
    got = {(r.conv_id, r.q_idx): r.defect for r in pairs.defects(df).collect()}
    assert got == {("a", 0): "empty", ("b", 0): "empty", ("c", 0): "copied_question", ("d", 0): "other_language", ("e", 0): "truncated", ("f", 2): "empty"}
    assert pairs.defects(df.limit(0)).count() == 0


# ---- 4


def test_numbers_and_skeletons():
    assert scans.number_of("- 57l -") == (571, True) and scans.number_of("xxix") == (29, False) and scans.number_of("Page 3 of 9")[0] == 3
    assert scans.number_of("2021.") == (2021, False) and scans.number_of("iiii")[0] is None and scans.number_of("Report 3")[0] is None
    same = {scans.skeleton(x) for x in ("Bound Reports of the College", "Bouncl Reports of the College 12", "- 4 - Bound Rep0rts of the C0llege")}
    assert len(same) == 1
    assert "office" in scans.undone("officc") and "department" in scans.undone("clepartment") and "month" in scans.undone("montb") and "list" in scans.undone("iist") and "circle" in scans.undone("cirde")


def test_a_word_of_another_language_is_at_home_there():
    assert scans.at_home("dass", "Für die Gebühr gilt, dass die Kasse zuständig ist") and not scans.at_home("dass", "inspect the dass schedule of the year")
    assert not scans.at_home("derk", "der derk ist da")


def test_numbers_of_any_length():
    for line, value in (("- 10001 -", 10001), ("- l0001 -", 10001), ("Page 14999 of 15000", 14999), ("[ 123456 / 1500000 ]", 123456), ("12of30", 12), ("~~~~~~~ 1234567 ~~~~~~~", 1234567)):
        assert scans.number_of(line) == (value, True)
    assert scans.number_of("10001") == (10001, False) and scans.number_of("lxxxviii") == (88, False)
    assert scans.number_of("- " + "9" * 5000 + " -") == (10**18, True)
    assert scans.number_of("- | -") == (1, True) and scans.number_of("- || -") == (11, True) and scans.number_of("||") == (11, False)
    for line in ("|---|---|---|---|---|", "|   |   |   |   |   |", "|" * 50_000 + "z", "1" + "|/" * 50_000 + "z", "Total 10001"):
        assert scans.number_of(line)[0] is None


def test_pages_beyond_9999(spark):
    r = random.Random(4)
    rows = []
    for i in range(8):
        n = f"- {10001 + i} -" if i != 3 else "- l0004 -"
        title = "Harbor Gazette of the College" if i else "Quarterly Accounts Overview"
        rows.append((i, "m.pdf", i, 10001 + i, "\n".join([n, title, *(sentence(r) for _ in range(6))])))
    noise = {(x.raw_id, x.line_no, x.noise) for x in scans.scan_noise(spark.createDataFrame(rows, "raw_id long, source string, seq int, page int, page_content string")).noise.collect()}
    assert noise == {(i, 0, "page_number") for i in range(8)} | {(i, 1, "header") for i in range(1, 8)}


def test_any_number_of_titles(spark):
    r = random.Random(8)
    names = [" ".join(r.choice(NOUNS).capitalize() + r.choice("aeou") * 2 for _ in range(3)) for _ in range(22)]
    rows = [(i, "merged.pdf", i, i + 1, "\n".join([names[i // 4], *(sentence(r) for _ in range(6))])) for i in range(88)]
    # the last page of every title has one letter more
    rows = [(*x[:4], x[4].replace(" ", "q ", 1)) if x[0] % 4 == 3 else x for x in rows]
    # lines that come again far from each other are text: two of them, every 40 pages
    rows += [(100 + i, "merged.pdf", 100 + 20 * i, 101 + i, "\n".join([f"Students of {NOUNS[i % 2].upper() * 3} meet", *(sentence(r) for _ in range(6))])) for i in range(20)]
    noise = {(x.raw_id, x.line_no, x.noise) for x in scans.scan_noise(spark.createDataFrame(rows, "raw_id long, source string, seq int, page int, page_content string")).noise.collect()}
    assert {x for x in noise if x[2] == "header"} == {(i, 0, "header") for i in range(88)}


def test_near_titles_against_all_pairs(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcde ") for _ in range(n)).strip() or "a"
    known = list({("s", text(n)) for n in range(6, 90) for _ in range(2)} - {("s", "a")})
    known = [x for x in known if len(x[1]) >= 6]
    lines = set()
    for _, t in known:
        for edits in (1, len(t) // 4, len(t) // 4 + 1):
            x = list(t)
            for _ in range(edits):
                k = r.randrange(len(x))
                x[k : k + 1] = r.choice(([], ["z"], [x[k], "z"]))
                x = x or ["a"]
            lines.add(("s", "".join(x)))
    lines = [x for x in lines if len(x[1]) >= 4]
    a, b = spark.createDataFrame(lines, "source string, skeleton string"), spark.createDataFrame(known, "source string, skeleton string")
    want = a.join(b.withColumnRenamed("skeleton", "title"), "source").filter(scans.near("skeleton", "title")).select("skeleton").distinct().collect()
    assert len(want) > 100 and {x.skeleton for x in want} == {x.skeleton for x in scans.near_titles(a, b).collect()}


def test_scanned_pages(spark):
    r = random.Random(9)
    rows, clean = [], {}
    for i in range(12):
        body = prose(r, 14)
        clean[i] = body
        lines, line = [], ""
        for w in body.split():
            if len(line) + len(w) > 52:
                lines.append(line.strip())
                line = ""
            line += w + " "
        lines.append(line.strip())
        rows.append([i, "s.pdf", i, i + 1, "\n".join(["College Bound Reports", *lines, f"- {i + 1} -"])])
    rows += [[100 + i, "n.txt", i, None, prose(r, 30)] for i in range(20)]
    rows[3][4] = rows[3][4].replace("registrar", "reg-\nistrar", 1).replace("library", "1ibrary", 1)
    rows[4][4] = rows[4][4].replace("College Bound", "Col1ege Bouncl")
    rows += [[200, "s.pdf", 50, 51, None], [201, "s.pdf", 51, 52, "x y"], [202, None, None, 3, prose(r, 9)], rows[3]]
    df = spark.createDataFrame([tuple(x) for x in rows], "raw_id long, source string, seq int, page int, page_content string")
    found = scans.scan_noise(df)
    got = {(x.raw_id, x.line_no, x.noise) for x in found.noise.collect()}
    heads = {(i, 0, "header") for i in range(12)}
    numbers = {(i, rows[i][4].count("\n"), "page_number") for i in range(12)}
    cut = {(3, k, "hyphen") for k, x in enumerate(rows[3][4].split("\n")) if x.endswith("reg-")}
    bad = {(3, k, "misread") for k, x in enumerate(rows[3][4].split("\n")) if "1ibrary" in x}
    assert got == heads | numbers | cut | bad
    text = {x.raw_id: x.repaired for x in scans.repair(df, found).collect()}
    assert text[0] == clean[0] and text[3] == clean[3]


# ---- 5


@pytest.mark.parametrize(
    "text, want",
    [
        ("one two three", None),
        ("", None),
        (" ".join(["The registrar keeps the ledger of the college, and the clinic keeps the permit."] * 4), "prose"),
        ("\n".join(f"{i}. item of the list number {i}" for i in range(9)), "list"),
        ("\n".join(f"GE {i} | Rural Sociology | {i} | MWF | 3:45 PM" for i in range(101, 109)), "table"),
        ("\n".join("q 7 x B 2 n K p 9 Z w 3" for _ in range(6)), "junk"),
        ("\n".join("000010  c0 94 80 d6 3d 0b d4 dd" for _ in range(6)), "junk"),
    ],
)
def test_kinds(text, want):
    assert quality.kind_of(quality.Summary.of(text).total()) == want
    assert quality.kind_only(text) == want


def test_chunks_merge_to_the_whole():
    r = random.Random(6)
    text = "\n".join(prose(r, r.randint(1, 4)) if r.random() < 0.6 else f"- item {r.randint(1, 9)} of it" for _ in range(60))
    whole = quality.Summary.of(text).total()
    for size in (7, 40, 333, 5000):
        parts = [quality.Summary.of(text[i : i + size]) for i in range(0, len(text), size)]
        while len(parts) > 1:
            parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        assert parts[0].total() == whole


def test_counts_are_the_same_at_every_chunk_size():
    r = random.Random(16)
    words_ = lambda n: " ".join(r.choice(NOUNS) for _ in range(n))
    texts = ["x" * 30_000, words_(4000), "ab " + "Q9" * 9000 + " cd\r\n" + words_(30), " " * 9000 + "word", "| a | b " * 2000, ". ".join(words_(6) for _ in range(900)) + "."]
    texts += ["\n".join([words_(2500), *(sentence(r) for _ in range(9)), "é" * 700 + "!", words_(1700)])]
    for text in texts:
        whole = quality.Summary.of(text).total()
        assert quality.kind_only(text) == quality.kind_of(whole)
        for size in (777, 3000, 10_000):
            parts = [quality.Summary.of(text[i : i + size]) for i in range(0, len(text), size)]
            parts = [quality.Summary.unpack(*x.pack()) for x in parts]
            while len(parts) > 1:
                parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            assert parts[0].total() == whole
    assert quality.Summary.of(texts[0]).total()[quality.AT["words"]] == 1


def test_long_lines_are_judged_as_short_ones(monkeypatch):
    r = random.Random(22)
    many = lambda n, *bits: "".join(r.choice(bits) for _ in range(n))
    lines = [
        "- " + " ".join(r.choice(NOUNS) for _ in range(2000)), "Fees 2024, room 12, " * 900, "4f20 " * 3000, "pen  cup  " * 1500, "contents " * 1100 + ". . . . . 12",
        " " * 9000 + "total: 12", "1 " + " " * 9000 + "2", "Q9x" * 6000, "12,500." * 2000, "krtz vbn " * 1200, "a) " + "word. " * 2000, "Yes" + ")" * 9000 + ". no", "UPPER CASE " * 1000,
    ]
    bits = [*NOUNS, "GE 101", "|", "12.50", "- item", "q", "7f 3a", "Name:", "a, b,", "....", "Xq9Zt7Bw", "end.)", "krtz", "é", " ", "  ", "\t", ", ", "\xa0", ". ."]
    lines += [" " * r.randrange(9) + many(9000, *r.sample(bits, r.randint(2, 6)), " ", " ") for _ in range(60)]
    got = [[quality.line_counts(x)] for x in lines]
    for x, found in zip(lines, got):
        assert len(x) > quality.LONG
        for size in (777, 5000):
            parts = [quality.Words.of(x[i : i + size]) for i in range(0, len(x), size)]
            while len(parts) > 1:
                parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            found.append(parts[0].line())
    monkeypatch.setattr(quality, "LONG", 1 << 30)
    for x, found in zip(lines, got):
        assert found == [quality.line_counts(x)] * 3, x[:40]


def test_both_ways_to_a_kind_agree():
    r = random.Random(17)
    bits = ["The clinic keeps", "GE 101", "|", "12.50", "- item", "q", "7f 3a", "Name:", "a, b, c, d", "MWF", "......... 7", "Xq9Zt7Bw", "pending.", "krtz"]
    for _ in range(400):
        text = "\n".join(" ".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 9)))
        assert quality.kind_only(text) == quality.kind_of(quality.Summary.of(text).total())


def test_quality_of_odd_rows(spark):
    huge = "The registrar keeps the ledger. " * 9000
    rows = [(1, None), (2, ""), (3, huge), (4, "word " * 30), (4, "word " * 30), (None, "x")]
    got = {r.id: r for r in quality.text_quality(spark.createDataFrame(rows, "i long, t string"), "i", "t", chunk=10_000).collect()}
    assert set(got) == {1, 2, 3, 4} and got[3].n_words == 45000 and got[3].kind == "prose" and got[1].kind is None


# ---- 6


def test_pieces_cover_and_overlap():
    r = random.Random(8)
    for text in (prose(r, 300), "x" * 9000, "  " + "ab " * 3000 + " \n", "\n\n".join(prose(r, 5) for _ in range(40))):
        for limit, overlap in ((100, 15), (250, 0)):
            cut = splitting.pieces(text, limit, overlap)
            assert all(len(text[a:b].strip()) // 4 <= limit for a, b, _ in cut)
            assert text[cut[0][0] :] == text.lstrip() and text[: cut[-1][1]] == text.rstrip()
            for (a, b, _), (c, d, _) in zip(cut, cut[1:]):
                assert a < c <= d and b < d and (b - c) // 4 >= overlap if overlap else not text[b:c].strip()
    assert splitting.pieces("", 10, 1) == [] and splitting.pieces(" \n", 10, 1) == [] and len(splitting.pieces("short", 10, 1)) == 1


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "word " * 2000), (1, "word " * 2000), (2, "x" * 4003), (3, "x" * 4004), (4, None)], "i long, t string")
    got = splitting.split(df, "i", "t", 1000, 150).collect()
    assert {r.id for r in got} == {1, 3} and len(got) == len({(r.id, r.piece) for r in got})


# ---- 7


def test_packing(spark):
    r = random.Random(12)
    sizes = [(i, r.choice([0, 1, 5, 60, 256, 512, 513, 1300])) for i in range(400)]
    df = spark.createDataFrame(sizes + sizes[:3], "id long, n_tokens int").dropDuplicates(["id"])
    got = packing.pack(df, {2: 512, 5: 1024}, workers=3).collect()
    for limit, cap in ((2, 512), (5, 1024)):
        mine = [x for x in got if x.limit_id == limit]
        used = {}
        for x in mine:
            used[x.bin] = used.get(x.bin, 0) + x.n_tokens
        assert max(used.values()) <= cap and sum(used.values()) == sum(n for _, n in sizes)
        whole = {}
        for x in mine:
            whole.setdefault(x.id, []).append(x.n_tokens)
        assert all((len(v) == 1) == (dict(sizes)[k] <= cap) for k, v in whole.items())
    bins, n = packing.fill(np.array([300] * 4 + [170] * 6), 512, 8, 0)
    assert n == 6 and np.bincount(bins).tolist() == [1, 1, 1, 1, 3, 3]
    assert packing.pack(df.limit(0), {2: 512}).count() == 0 and packing.pack(df, {}).count() == 0


# ---- 8


def test_leaks(spark):
    r = random.Random(5)
    vocabulary_ = [f"w{i}" for i in range(4000)]
    text = lambda n: [r.choice(vocabulary_) for _ in range(n)]
    items = {i: text(90) for i in range(6)}
    rows, want = [], set()

    def add(item, stretch, leak):
        i = len(rows)
        rows.append((i, " ".join(text(40)) + ". " + " ".join(stretch).upper() + "! " + " ".join(text(40))))
        if leak:
            want.add((i, item))

    add(0, items[0][10:34], True)
    add(0, items[0][10:33], False)
    s = items[1][:42]
    for k in (6, 13, 20, 27, 34, 41):
        s[k] = "changed"
    add(1, s, True)
    add(2, [w for k, w in enumerate(items[2][5:60]) if k % 8 != 3], True)
    add(3, [x for k, w in enumerate(items[3][5:60]) for x in ([w, "added"] if k % 9 == 4 else [w])], True)
    add(4, items[4][:12] + text(3) + items[4][30:42], False)
    rows += [(50, None), (51, ""), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame([(i, "Read the passage. " + " ".join(w)) for i, w in items.items()] + [(9, None)], "item_id long, passage string")
    got = leakage.leaks(docs, "doc_id", "text", held, "item_id", "passage").collect()
    assert {(g.doc_id, g.item_id) for g in got} == want and len(got) == len(want)
    # the hits of the masks alone decide what is verified, and other masks would do
    assert leakage.leaks(docs, "doc_id", "text", held.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaks(docs.limit(0), "doc_id", "text", held, "item_id", "passage").count() == 0


def test_every_run_of_five_broken(spark):
    r = random.Random(25)
    passage = [f"w{r.randrange(4000)}" for _ in range(80)]
    copy = [w if k % 5 != 4 else "changed" for k, w in enumerate(passage[10:60])]
    docs = spark.createDataFrame([(1, " ".join(["before"] * 20 + copy + ["after"] * 20))], "doc_id long, text string")
    held = spark.createDataFrame([(7, " ".join(passage))], "item_id long, passage string")
    got = leakage.leaks(docs, "doc_id", "text", held, "item_id", "passage", per=4).collect()
    assert [(x.doc_id, x.item_id, x.n_words, x.n_edits) for x in got] == [(1, 7, 49, 9)]
    assert leakage.leaks(docs, "doc_id", "text", held, "item_id", "passage").count() == 0


def test_overlap_over_wide_gaps():
    p = np.arange(1, 200, dtype=np.uint64)
    d = np.concatenate([p[:100], np.arange(1000, 1014, dtype=np.uint64), p[100:]])
    assert leakage.overlap(p, d, 24, 7) == (199, 14)
    pieces = [p[0:2], p[3:5], p[6:8], p[9:11], p[12:28]]
    broken = np.concatenate([x for k, q in enumerate(pieces) for x in (q, np.array([5000 + k], np.uint64))])
    assert leakage.overlap(p[:28], broken, 24, 7) == (28, 4)


def test_instructions_are_counted_over_all_passages(spark):
    rows = [(i, f"Read the passage and answer. Item {i} says this.") for i in range(30)] + [(100 + i, f"Opening {i} of its own. And more text.") for i in range(30)]
    assert leakage.instructions(spark.createDataFrame(rows, "i long, passage string").repartition(6), "passage") == {"read the passage and answer."}


# ---- 9


@pytest.mark.parametrize("original", ["Café Peñafrágil — “quoted” • ₱95…", "São Ildefonsa’s Château Güell", "¿Por qué? matrícula"])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp1251", "cp437"])
def test_round_trip(original, read):
    broken = mojibake.decode(original.encode(), read)
    fixed, n, whole = mojibake.restore("Plain text. " + broken + " Más texto correcto.")
    assert n > 0 and whole and fixed == "Plain text. " + original + " Más texto correcto."


def test_twice_garbled_single_byte_and_lost():
    once = mojibake.decode("Niño – São".encode(), "cp1252")
    assert mojibake.restore(mojibake.decode(once.encode(), "cp1252"))[0] == "Niño – São"
    assert mojibake.restore("the NiÒo Jes˙s Chapel")[0] == "the Niño Jesús Chapel"
    text, n, whole = mojibake.restore("the S�o exhibit")
    assert n == 1 and not whole and text == "the S�o exhibit"


@pytest.mark.parametrize("text", ["", "plain", "AVISO À MÃE E À IRMÃ: vai", "Гімн України та Госдума", "naïve café — “ok” • ₱95…", "país, así, él; ß Ö", "caf&eacute; l&#39;école", "√2 and ±3"])
def test_correct_text_stays(text):
    assert mojibake.restore(text) == (text, 0, True)


@pytest.mark.parametrize("original", ["Große Straße", "È vero", "Être", "Česko", "dağ", "maşa", "plzeň"])
def test_garbled_pairs_of_capitals(original):
    assert mojibake.restore(mojibake.decode(original.encode(), "cp1252"))[0] == original
    assert mojibake.restore("DER ÃŸE UND ЕЇ") == ("DER ÃŸE UND ЕЇ", 0, True)


@pytest.mark.parametrize(
    "original, wrote, read",
    [
        ("Привет, как дела", "utf-8", "latin-1"), ("Привет мир", "utf-8", "cp1252"), ("Привет", "utf-8", "cp1251"), ("Καλημέρα κόσμε", "utf-8", "cp1252"), ("Ελλάδα και", "utf-8", "mac_roman"),
        ("Xin chào các bạn, tiếng Việt", "utf-8", "cp1252"), ("great 😀 news", "utf-8", "latin-1"), ("你好世界 ok", "utf-8", "latin-1"), ("日本語テキスト", "utf-8", "cp1252"), ("שלום עולם", "utf-8", "cp1252"),
        ("naïve café", "utf-8", "koi8_r"), ("Le café est fermé au señor", "cp1252", "cp437"), ("Le café est fermé", "cp1252", "cp1251"), ("Привет как дела", "koi8_r", "cp1251"), ("może słowo", "cp1250", "cp1252"),
    ],
)
def test_all_pairs_and_scripts(original, wrote, read):
    fixed, n, whole = mojibake.restore("Plain text: " + mojibake.decode(original.encode(wrote), read) + ".")
    assert n > 0 and whole and fixed == f"Plain text: {original}."


def test_half_restored_text_says_so():
    fixed, n, whole = mojibake.restore(mojibake.decode("El café está allí mañana".encode("mac_roman"), "cp1252"))
    assert n > 0 and not whole and fixed == "El café está all’ mañana"


@pytest.mark.parametrize(
    "text",
    ["CAFÉ” and CAFÉ…", "«café…” dit", "группа «В» и НАТО", "В этом году ё-моё", "Él dijo: —Ámalo…", "m³/s CO₂ 5µm kΩ", "ÀÉ", "naïve Œuvre", "“École’s”", "l’École d’Été", "½ cup – 10°C", "αβγ-globulin", "Привет, мир", "iPhoneÉ", "日本語 你好 😀", "שלום"],
)
def test_writing_of_all_scripts_stays(text):
    assert mojibake.restore(text) == (text, 0, True)


def test_repair_rows(spark):
    df = spark.createDataFrame([(1, "cafÃ©"), (2, None), (3, ""), (4, "café")], "i long, t string")
    assert [(r.id, r.restored) for r in mojibake.repair(df, "i", "t").collect()] == [(1, "café")]


def test_frequent_words_keep_their_bound(spark):
    df = spark.createDataFrame([(f"w{i}", i + 1) for i in range(200)], "w string, n long")
    got = vocabulary.frequent(df, "w", "n", 50)
    assert 0 < len(got) <= 50 and "w199" in got and "w0" not in got
    assert vocabulary.frequent(df.filter(F.lit(False)), "w", "n", 5) == frozenset()
