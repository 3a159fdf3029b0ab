"""Broken question-answer pairs of a chat: empty, truncated, refused, copied, in another language.

The answer of a user message is the assistant message right after it. One row per
defective question; the checks in this order, the first that holds names it:

* empty: no assistant message follows, or it is null, blank or filler;
* copied_question: the answer, compressed with its question as a zstandard
  dictionary, has nothing left that the dictionary doesn't give;
* refusal: every sentence of the answer is a refusal or a courtesy;
* other_language: the answer's language isn't the main one of the question;
* truncated: the end of the answer is no end in a terminal-context model, which
  is counted over all answers: how often a line's last words end a line, and how
  often they go on.

Defined cases: null message lists and null roles ask nothing; a null or blank
question can be answered, but not copied or in another language than its own;
repeated rows count once; of several states of a chat the longest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: spellings of the two roles, lower-cased and trimmed
ASKING = ("user", "human", "student", "customer", "client")
ANSWERING = ("assistant", "ai", "bot", "model", "chatbot", "agent")

INVISIBLE = re.compile(r"[\s​-‏⁠﻿­]+")
FILLER = re.compile(
    r"(?:[^\w]*|(?:<\s*/?\s*\w+\s*/?\s*>[^\w]*)+|[^\w]*(?:n ?/ ?a|null|none|nil|nan|undefined|tbd|todo|blank|empty|"
    r"no (?:response|answer|reply|content|output)|empty response|not available|walang sagot)[^\w]*)",
    re.I,
)

#: words that tell a language; fixed values
LANGUAGES = {
    "en": "the of and to in is for that on with as by be at from or an it are was were this not have will has had can what where when who which how "
    "do does did i my me you your we if there about after before all any no please should must may is been than then its their they he she but so "
    "would could here only during each every out also more other into up long still open need many yes".split(),
    "fil": "ang ng sa na mga ay at po ba ito hindi kung ni si mula nang opo ko para po bang may kailangan kailangang saan kailan sino paano bakit ano pwede "
    "maaari maaaring dapat muna ayon walang wala ika-1 nasa naman lang din rin kayo ninyo namin natin iyan iyon niyan niya nila siya sila ako akin aking "
    "bago matapos mahalaga nagkaroon bayad".split(),
    "es": "el la los las de que y en se con por del al un una lo su para como más pero sin sobre este entre cuando muy es no debe deben según antes después".split(),
    "fr": "le la les des et du est pour dans une un sur pas que qui au aux ce il elle avec par plus doit être même selon dès n'y".split(),
    "de": "der die das und ist nicht mit auf für dem den ein eine einer zu von wird wer sich im am auch vor nach bei aus gilt dass ohne während".split(),
    "pt": "o os as e do da em um uma não com para que no na dos das ao se por mais como é foi já durante antes após".split(),
    "it": "il lo gli di che e è per con una un non sono della del nel alla come più anche si dopo prima".split(),
    "id": "yang dan di untuk dengan dari pada tidak ini itu akan ke oleh jika harus wajib setelah sebelum selama tanpa adalah ada silakan kepada menurut".split(),
    "ceb": "ang sa mga nga ug dili unsa unsaon naa wala'y kini kana adto asa kanus-a kinsa imong akong among atong ikaw mao usa kinahanglan pinaagi gikan alang nimo nako namo human sulod gawas karon ugma".split(),
    "ilo": "ti iti ken dagiti kadagiti nga saan ania sadino kaano siasino ngem wenno tapno kas daytoy dayta dita idiay manipud para".split(),
    "vi": "và của là có cho không được các những này đó với trong khi từ tại phải sẽ đã một người bạn tôi ở để".split(),
    "pl": "i w z na do nie jest się że są oraz przez dla które jak po przed lub tylko może będzie".split(),
    "tr": "ve bir bu için ile değil olarak daha olan gibi sonra önce kadar veya ancak çok her mi".split(),
    "sv": "och att det som är på av för med inte till den om har eller ska efter före".split(),
    "sw": "na ya wa kwa ni katika kuwa hii hiyo lakini au baada kabla kila si".split(),
    "nl": "de het een en van is niet met op voor dat zijn te aan er maar ook bij uit wordt naar".split(),
}
_TELLS: dict[str, list[tuple[str, float]]] = {}
_seen = Counter(w for ws in LANGUAGES.values() for w in set(ws))
for _lang, _ws in LANGUAGES.items():
    for _w in set(_ws):
        _TELLS.setdefault(_w, []).append((_lang, 1.0 / _seen[_w]))
LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")

#: what a sentence that only declines says
REFUSAL = re.compile(
    r"\bi (?:really |simply |just )?(?:can ?not|can[’']?t|could not|won[’']?t|will not|may not|must not|do not|don[’']?t)(?: be able to| feel (?:comfortable|able)| wish to| want to)? ?"
    r"(?:answer|help|assist|respond|reply|discuss|comment|provide|share|talk|say|give|offer|support|do that|comply|continue|fulfil|engage|speak)|"
    r"\bi(?: am|[’']m)(?: not| un)(?: ?able| allowed| permitted| in a position| authori[sz]ed| comfortable| going| willing)|\bi(?: am|[’']m) unable|"
    r"\bi (?:have to|must|need to|will|would) (?:refuse|decline)|\bi (?:refuse|decline)\b|\bi(?: would|[’']d) (?:rather|prefer) not|"
    r"\bnot (?:something|a (?:topic|matter|subject)) (?:that )?i (?:am|can|may)|\b(?:falls|is|lies) outside (?:of )?what i|\bbeyond what i (?:can|may|am)|"
    r"\bnot be appropriate for me|\bmy (?:guidelines|instructions|rules|policy|policies|programming) (?:do|does|will|would|forbid|prevent|prohibit)|\bagainst my (?:guidelines|rules|policy)|"
    r"\b(?:we|this assistant|the assistant|this bot) (?:can ?not|can[’']?t|won[’']?t|will not|are (?:not able|unable)|is (?:not able|unable)|must decline|decline)(?: to)? ?(?:answer|help|assist|respond|reply|discuss|comment|provide|share|give|offer|comply|support)|"
    r"\b(?:violates?|goes against|against|not (?:allowed|permitted) (?:by|under)|breach\w*) (?:our|my|the|its|these) (?:\w+ ){0,2}(?:polic(?:y|ies)|guidelines|rules|terms)|^no comment$|\brequest (?:is |has been |was )?(?:denied|declined|refused|rejected)|"
    r"\b(?:this|that|it|such a \w+) (?:can ?not|can[’']?t|will not|won[’']?t|may not) be (?:answered|discussed|disclosed|commented on|shared) (?:by me|here)|^(?:that|this|it)[’']?s? (?:is )?(?:not something (?:i|we) (?:can|will|may)|off[- ]limits)|"
    r"\bas an ai\b[^.!?]{0,40}\b(?:can ?not|can[’']?t|not able|unable)|\blet[’']?s (?:talk about|discuss) something else|\bi[’']?m afraid (?:i|that i) (?:can ?not|can[’']?t|must)|"
    r"\bhindi ko (?:po )?(?:ma|pwede|puwede|kaya|maaari|sasagutin)|\bhindi (?:po )?ako (?:po )?(?:pwede|puwede|pinahihintulutan|pinapayagan|maaari|makaka|makasasagot|makatutulong|awtorisado)|"
    r"\bbawal (?:po )?sa akin|\bwala (?:po )?ako sa posisyon|\btumatanggi (?:po )?ako|\bhindi (?:po )?saklaw|\bhindi ko (?:po )?matutulungan",
    re.I,
)
COURTESY = re.compile(
    r"(?:i[’']?m sorry|sorry|apolog\w+|unfortunately|regrettably|thank you|thanks|i understand|paumanhin|pasensya|ikinalulungkot|salamat|ipagpaumanhin|sa kasamaang)[^.!?]{0,60}$|"
    r"(?:please|kindly|you may|feel free|pakisubukan|subukan|mangyaring)\b[^.!?]{0,20}\b(?:try|ask|different|another|rephrase|ibang|magtanong)|"
    r"(?:is there anything else|anything else|can i help|may i help|how else|let me know|may iba pa|mayroon pa)",
    re.I,
)
SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)*]*\s+|\n+")
INTRO = re.compile(r"^\W*(?:you(?:r)? (?:asked|question(?: is| was)?|said|wrote|want to know|are asking)|question|the question(?: is| was)?|q|tanong|ang (?:iyong )?tanong(?: mo)?(?: ay)?|itinanong (?:mo|ninyo))\b\W*", re.I)
#: any short introduction that ends with a colon
LEAD = re.compile(r"^\W*(?:[\w'’]+\s+){0,5}[\w'’]+\s*:\s*")


def is_filler(text: str | None) -> bool:
    return text is None or FILLER.fullmatch(INVISIBLE.sub(" ", text).strip()) is not None


#: writing systems by the ranges of their letters; a text mostly in one of them is of its language, or of a language of it
WRITINGS = (
    ("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("armenian", 0x530, 0x590), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x780), ("indic", 0x900, 0xE00), ("thai", 0xE00, 0xE80),
    ("georgian", 0x10A0, 0x1100), ("ethiopic", 0x1200, 0x1380), ("khmer", 0x1780, 0x1800), ("kana", 0x3040, 0x3100), ("han", 0x3400, 0xA000), ("hangul", 0xAC00, 0xD7B0),
)


def writing(text: str) -> str | None:
    """The writing system of most letters, None for Latin; kana among Chinese characters tell Japanese."""
    if text.isascii():
        return None
    letters = [ord(c) for c in text if c.isalpha()]
    seen = Counter(name for n in letters if n >= 0x370 for name, a, b in WRITINGS if a <= n < b)
    if not seen or 2 * sum(seen.values()) <= len(letters):
        return None
    return "kana" if seen["kana"] else seen.most_common(1)[0][0]


def language(text: str) -> tuple[str | None, float]:
    """The language whose telling words outweigh the others', and their number; texts in another writing are of that writing's."""
    other = writing(text)
    if other:
        return other, float(sum(map(str.isalpha, text)))
    score: Counter = Counter()
    for w in LETTERS.findall(text.lower()):
        for lang, weight in _TELLS.get(w, ()):
            score[lang] += weight
    if not score:
        return None, 0.0
    (lang, top), *rest = score.most_common(2)
    return (lang, top) if not rest or top > rest[0][1] else (None, top)


def speaks_otherwise(question: str, answer: str) -> bool:
    """Whether the answer's language isn't the main one of the question.

    Few words tell if most of them are telling ones of the answer's language and none of the question's.
    """
    lq, nq = language(question)
    la, na = language(answer)
    if not lq or not la or lq == la or nq < 1:
        return False
    words = LETTERS.findall(answer.lower())
    if len(answer.split()) >= 6 or writing(answer):
        return na >= 2
    told = [{x for x, _ in _TELLS.get(w, ())} for w in words]
    return len(words) >= 2 and 2 * sum(la in x for x in told) > len(words) and not any(lq in x for x in told)


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer says nothing but the question (or a sentence of it) again, introduced or slightly altered, once or several times."""
    whole, plain = _plain(question), _plain(answer)
    repeated = bool(whole) and plain.count(whole) > 1
    if len(answer) > 3.2 * len(question) + 80 and not repeated:
        return False
    parts = [p for p in map(_plain, SENTENCE.split(question)) if p.count(" ") >= 3 and p != whole]
    said = {plain, _plain(INTRO.sub("", answer)), _plain(LEAD.sub("", answer, count=1))}
    return any(_copies(q, a) for q in [whole, *parts] for a in said if q and a)


def _copies(q: str, a: str) -> bool:
    if len(a) < 0.6 * len(q) or len(a) > 2.6 * len(q) + 10 and a.count(q) < 2:
        return False
    words, known = Counter(a.split()), Counter(q.split())
    if sum((words & known).values()) < 0.5 * sum(known.values()):
        return False  # too few words in common for the dictionary to give the rest
    # what the dictionary leaves: literal bytes of the frame, less its fixed part
    body = a.encode()
    if len(_compressor(q).compress(body)) - _EMPTY_FRAME > 14 + 0.24 * len(body):
        return False
    if q in a:
        # repeated whole: beside it stands nothing, or the question again
        rest = a.replace(q, " ").split()
        return not rest or (len(rest) >= 0.6 * q.count(" ") and set(rest) <= set(q.split()))
    n = sum(words.values())
    return sum((words - known).values()) <= max(1, 0.12 * n) and sum((words & known).values()) >= 0.75 * sum(known.values())


def without_echo(question: str | None, answer: str) -> str:
    """The answer without the question that it repeats at its beginning, if something follows."""
    if not question or not question.strip():
        return answer
    at = answer.lower().find(question.strip().lower())
    rest = answer[at + len(question.strip()) :] if 0 <= at < 40 else ""
    return rest.lstrip(" ?.!\"'”’") if re.search(r"\w", rest) else answer


@lru_cache(maxsize=64)
def _compressor(question: str) -> zstandard.ZstdCompressor:
    """One with the question as its dictionary; made once for all forms of an answer."""
    prompt = zstandard.ZstdCompressionDict(f"{question} ".encode() * 4, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=prompt, write_content_size=False, write_checksum=False, write_dict_id=False)


_EMPTY_FRAME = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(b""))


def is_refusal(answer: str) -> bool:
    said = [s for s in (x.strip(" *_\"'“”.!?") for x in SENTENCE.split(answer)) if re.search(r"\w", s)]
    refused = 0
    for s in said:
        if REFUSAL.search(s):
            refused += 1
        elif not COURTESY.match(s):
            return False
    return refused > 0


#: ---- terminal contexts
ITEM = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+")
MARKS = re.compile(r"[*_`\s]+$")
STOPPED = re.compile(r"[.!?。][\"'”’)\]*_»]*$|[)\]”»]$")
ABBREVIATED = re.compile(r"\b(?:mr|ms|mrs|dr|prof|engr|st|brgy|no|nos|pp?|vol|ed|e\.g|i\.e|etc|sec|art|ma)\.$", re.I)
_SHAPE = re.compile(r"\d+")


def contexts(line: str) -> tuple[list[str], list[str]]:
    """For each number n of words of a line (or its last sentence): the key of the last three of them,
    and the key of the two before the last, both with the kind of line and n up to five."""
    item = ITEM.match(line)
    words = _SHAPE.sub("9", (line[item.end() :] if item else SENTENCE.split(line)[-1]).lower()).split()
    kind = "i" if item else "p"
    last = [f"{kind}{min(n, 5)} {' '.join(words[max(0, n - 3) : n])}" for n in range(1, len(words) + 1)]
    return last, [f"<{kind}{min(n, 5)} {' '.join(words[max(0, n - 3) : n - 1])}" for n in range(1, len(words) + 1)]


#: words that never end a phrase; fixed values
OPEN_WORDS = frozenset(
    "the a an of to for and or at in on with by from that which who if as is are was were be been has have had will may must should can into under per via "
    "ng sa ang mga na ay si ni kay kung para dahil upang der die das und mit von zu el la los de y en que le les des du et pour dan yang di untuk dengan o e do da".split()
)


def last_line(answer: str) -> str:
    return MARKS.sub("", answer.rstrip()).rsplit("\n", 1)[-1]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends, goes_on: of the lines of all answers, summed up per batch."""
    for batch in batches:
        ends: Counter = Counter()
        on: Counter = Counter()
        for answer in batch.column(0).to_pylist():
            body = MARKS.sub("", (answer or "").rstrip())
            lines = body.split("\n")
            for i, line in enumerate(lines):
                line = MARKS.sub("", line)
                if not line.strip():
                    continue
                keys, before = contexts(line)
                on.update(keys[:-1])
                on.update(before)
                if keys and not STOPPED.search(line):
                    ends[keys[-1]] += 1
        keys = list(ends | on)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([on[k] for k in keys], pa.int64())], names=["key", "ends", "goes_on"]
        )


def _open_end(answer: str) -> tuple[str, str | None]:
    """("whole" | "cut" | "ask", key to look up)."""
    raw = answer.rstrip()
    body = MARKS.sub("", raw)
    line = last_line(answer)
    if not line.strip() or body.endswith(("…", "...")):
        return "cut", None
    if re.search(r"(?:[-–—‐,;:/(\[“‘&+]|\bPHP|[₱$€])$", body) and not body.endswith("]"):
        return "cut", None
    if re.fullmatch(r"\s*(?:[-*•–]|\(?\d{1,3}[.)]?|\(?[a-z][.)])\s*", line):
        return "cut", None
    if ABBREVIATED.search(body):
        return "cut", None
    if STOPPED.search(body):
        # an open parenthesis or quotation mark before the stop isn't closed any more: still a stop
        return "whole", None
    tail = SENTENCE.split(line)[-1]
    if tail.count("(") > tail.count(")") or body.rsplit(None, 1)[-1].lower() in OPEN_WORDS and not body.endswith(("Do", "Da")):
        return "cut", None
    keys, before = contexts(line)
    return "ask", f"{keys[-1]}\t{before[-1]}" if keys else None


def _first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pos, qs, roles, answers = (batch.column(i).to_pylist() for i in range(5))
        out = []
        for i, p, q, answered, a in zip(ids, pos, qs, roles, answers):
            defect, key = None, None
            if not answered or is_filler(a):
                defect = "empty"
            elif q and is_copy(q, a):
                defect = "copied_question"
            elif is_refusal(a):
                defect = "refusal"
            else:
                a = without_echo(q, a)
                if speaks_otherwise(q or "", a):
                    defect = "other_language"
                else:
                    state, key = _open_end(a)
                    if state == "cut":
                        defect = "truncated"
            if defect or key:
                out.append((i, p, defect, key))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["conv_id", "q_idx", "defect", "key"])


def role_in(role: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.trim(F.coalesce(role, F.lit("")))).isin(*names)


def fullest(chats: DataFrame, key: list[str], messages: str) -> DataFrame:
    """The state with most messages of each chat."""
    return chats.groupBy(*key).agg(F.max_by(messages, F.struct(F.coalesce(F.size(messages), F.lit(-1)), F.xxhash64(messages))).alias(messages))


def questions(chats: DataFrame) -> DataFrame:
    """conv_id, q_idx, question, answered, answer: one row per user message; chats hold messages."""
    nxt = F.get("messages", F.col("q_idx") + 1)
    rows = chats.select("conv_id", "messages", F.posexplode("messages").alias("q_idx", "m"))
    return rows.filter(role_in(F.col("m.role"), ASKING)).select(
        "conv_id", "q_idx", F.col("m.content").alias("question"), F.coalesce(role_in(nxt["role"], ANSWERING), F.lit(False)).alias("answered"), nxt["content"].alias("answer")
    )


def defects(chats: DataFrame, conv_id: str = "conv_id", uid: str = "uid", messages: str = "messages", prior: float = 0.2, strength: float = 2.0, least_share: float = 0.05) -> DataFrame:
    """conv_id, q_idx, defect of every defective question in the fullest state of each chat."""
    whole = chats.select(F.col(conv_id).alias("conv_id"), F.col(uid).alias("uid"), F.col(messages).alias("messages")).filter("conv_id is not null")
    qs = cut(questions(fullest(whole, ["conv_id", "uid"], "messages")))
    looked = cut(qs.mapInArrow(_first_look, "conv_id string, q_idx int, defect string, key string"))
    asked = looked.filter("key is not null").select("conv_id", "q_idx", F.split("key", "\t")[0].alias("key"), F.split("key", "\t")[1].alias("before"))
    # only the contexts that are asked for are counted, over all answers
    wanted = asked.select(F.explode(F.array("key", "before")).alias("key")).distinct()
    counted = qs.filter("answered").select("answer").mapInArrow(_ends, "key string, ends long, goes_on long")
    model = cut(counted.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).join(wanted, "key", "left_semi"))
    # that the line ends with these words rather than goes on, and that these words rather than others follow their context
    p = (F.col("ends") - 1 + F.lit(prior * strength)) / (F.col("ends") - 1 + F.col("goes_on") + F.lit(strength))
    share = (F.col("ends") + F.col("goes_on")) / F.greatest(F.col("followed"), F.lit(1))
    scored = asked.join(model, "key", "left").join(model.select(F.col("key").alias("before"), F.col("goes_on").alias("followed")), "before", "left")
    ended = (p >= 0.5) & (share >= least_share)
    cut_off = scored.filter(~F.coalesce(ended, F.lit(False))).select("conv_id", "q_idx", F.lit("truncated").alias("defect"))
    return looked.filter("defect is not null").select("conv_id", "q_idx", "defect").unionByName(cut_off).dropDuplicates()
