"""Chats as arrays of messages: windows, titles, compaction, citations, what a report refers to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ASSISTANT = ("assistant", "ai", "bot")
USER = ("user", "human")
#: how a summary opens; fixed value
SUMMARY = "Previous conversation summary: "
UPLOADED = " [Image Uploaded]"


def role(c: Column) -> Column:
    """user, assistant or the role as it is, however spelt."""
    r = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(r.isin(*USER), F.lit("user")).when(r.isin(*ASSISTANT), F.lit("assistant")).otherwise(r)


def fullest(chats: DataFrame) -> DataFrame:
    """The state with most messages of each (conv_id, uid), other columns from the same row."""
    rest = [c for c in chats.columns if c not in ("conv_id", "uid")]
    order = F.struct(F.coalesce(F.size("messages"), F.lit(-1)), F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]))
    return chats.groupBy("conv_id", "uid").agg(F.max_by(F.struct(*rest), order).alias("r")).select("conv_id", "uid", *[F.col("r")[c].alias(c) for c in rest])


def last_n(messages: Column, n: int) -> Column:
    """The last n messages, all of them if there are fewer."""
    return F.slice(messages, F.greatest(F.lit(1), F.size(messages) - n + 1), n)


def all_but_last(messages: Column, n: int) -> Column:
    return F.slice(messages, 1, F.greatest(F.lit(0), F.size(messages) - n))


def visible(messages: Column) -> Column:
    """Without system messages."""
    return F.filter(messages, lambda m: role(m["role"]) != "system")


def title(messages: Column, n: int = 40) -> Column:
    """The first code points of the first user message."""
    first = F.try_element_at(F.filter(messages, lambda m: role(m["role"]) == "user"), F.lit(1))
    return F.coalesce(F.left(first["content"], F.lit(n)), F.lit("Untitled Chat"))


def transcript(messages: Column) -> Column:
    """role: content, one line a message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(role(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def compact(messages: Column, summarise: Callable[[Column], Column] | None = None, over: int = 10, keep: int = 6) -> Column:
    """Histories over ``over`` messages: a summary of all but the last ``keep``, then these.

    The summary message opens with fixed words. Without a summariser the summary is the transcript of what it stands for.
    """
    head = transcript(all_but_last(messages, keep))
    note = F.struct(F.lit("system").alias("role"), F.concat(F.lit(SUMMARY), summarise(head) if summarise else head).alias("content"))
    plain = lambda ms: F.transform(ms, lambda m: F.struct(role(m["role"]).alias("role"), m["content"].alias("content")))
    return F.when(F.size(messages) > over, F.concat(F.array(note), plain(last_n(messages, keep)))).otherwise(plain(messages))


def cited(chats: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, file, pages: the files an answer cites, numbered by first appearance."""
    marks = chats.select(F.col(key).alias("key"), F.posexplode(T.citations(F.col(text))).alias("pos", "c"))
    files = marks.groupBy("key", F.col("c.file").alias("file")).agg(F.min("pos").alias("first"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("c.pages")))).alias("pages"))
    ordered = files.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "file", "pages"))).alias("f"))
    return ordered.select("key", F.posexplode("f").alias("i", "f")).select("key", (F.col("i") + 1).alias("number"), "f.file", F.array_join("f.pages", ",").alias("pages"))


def reported(reports: DataFrame, chats: DataFrame, prefix: int = 50) -> DataFrame:
    """report_id, n_messages, cut: how much of the chat a moderator sees, up to the reported answer.

    ``cut`` is the position behind the last assistant message that holds the beginning of the snippet,
    or the number of messages; -1 where the chat is gone.
    """
    c = fullest(chats).select("conv_id", F.col("uid").alias("reporter_uid"), "messages")
    j = reports.select("report_id", "reporter_uid", "conv_id", "msg_snippet").join(c, ["conv_id", "reporter_uid"], "left")
    head = F.left(T.strip(F.coalesce("msg_snippet", F.lit(""))), F.lit(prefix))
    at = F.array_max(
        F.transform("messages", lambda m, i: F.when((role(m["role"]) == "assistant") & (head != "") & F.contains(F.coalesce(m["content"], F.lit("")), head), i + 1))
    )
    return j.select("report_id", F.coalesce(F.size("messages"), F.lit(-1)).alias("n_messages"), F.when(F.col("messages").isNull(), F.lit(-1)).otherwise(F.coalesce(at, F.size("messages"))).alias("cut"))


def shown(text: Column, has_image: Column) -> Column:
    """What is kept of a question: its text, marked where a picture came with it."""
    return F.concat(F.coalesce(text, F.lit("")), F.when(F.coalesce(has_image, F.lit(False)), F.lit(UPLOADED)).otherwise(F.lit("")))


def without_marker(text: Column) -> Column:
    return F.replace(text, F.lit(UPLOADED), F.lit(""))


def message_list(system: Column, history: Column, text: Column, image: Column) -> Column:
    """The messages for a model: system text, history, and the question with its picture as a block of its own.

    Every content is an array of blocks struct(type, text, url).
    """
    part = lambda kind, t, u: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"), u.cast("string").alias("url"))
    none = F.lit(None)
    plain = lambda who, t: F.struct(who.alias("role"), F.array(part("text", t, none)).alias("content"))
    asked = F.when(image.isNull(), F.array(part("text", text, none))).otherwise(F.array(part("text", text, none), part("image_url", none, F.concat(F.lit("data:image/jpeg;base64,"), image))))
    said = F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda m: plain(role(m["role"]), m["content"]))
    return F.concat(F.array(plain(F.lit("system"), system)), said, F.array(F.struct(F.lit("user").alias("role"), asked.alias("content"))))


def text_of(blocks: Column) -> Column:
    """The text blocks of a message, joined; pictures and blocks of other types are left out."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
