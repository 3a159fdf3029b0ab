"""Streams: answers assembled from tokens, pages prepared as they land, counts that stay current."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import store

ANSWER = "conv_id string, answer string, n_events int, ended string"
STOPPED = " [stopped]"


def _assemble(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parts, n = state.get if state.exists else ("", 0)
    ended = None
    if state.hasTimedOut:
        ended = "timeout"
    else:
        # one micro-batch may hold events out of order
        for e in pd.concat(list(frames)).sort_values("seq").itertuples():
            if ended:
                break
            n += 1
            if e.type == "chunk":
                parts += e.text or ""
            else:
                ended = e.type
    if ended:
        state.remove() if state.exists else None
        yield pd.DataFrame({"conv_id": [key[0]], "answer": [parts if ended == "done" else parts + STOPPED], "n_events": [n], "ended": [ended]})
    else:
        state.update((parts, n))
        state.setTimeoutDuration(60_000)


def answers(events: DataFrame) -> DataFrame:
    """One row per finished answer of a stream of conv_id, seq, type (chunk, done, error, abort), text.

    What came before an error, an abort or a minute's silence is kept with a notice.
    """
    return events.groupBy("conv_id").applyInPandasWithState(_assemble, ANSWER, "text string, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def server_events(df: DataFrame) -> DataFrame:
    """Rows of a chunk, done or error as the lines that a browser reads."""
    fields = [c for c in ("type", "text", "conv_id", "new_conversation_created", "new_conv_title") if c in df.columns]
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct(*fields)), F.lit("\n\n")).alias("line"))


def read_events(lines: DataFrame, line: str) -> DataFrame:
    """The fields of such lines again; what isn't JSON is null."""
    return lines.select(F.from_json(F.regexp_extract(line, r"(?s)^data: (.*?)\n*$", 1), "type string, text string, conv_id string").alias("e")).select("e.*")


def state_of(updates: DataFrame) -> DataFrame:
    """thread, values of a stream of updates (thread, seq, values map): the last value written of each key."""
    each = updates.select("thread", "seq", F.explode("values").alias("k", "v"))
    last = each.groupBy("thread", "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("thread").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("values"))


def sessions_of(logins: DataFrame) -> DataFrame:
    """session, user, state of a log (session, seq, what: new, restore or clear; user): the last event of a session tells."""
    last = logins.groupBy("session").agg(F.max_by(F.struct("what", "user"), "seq").alias("l"))
    return last.select("session", F.when(F.col("l.what") != "clear", F.col("l.user")).alias("user"), F.when(F.col("l.what") == "clear", "cleared").otherwise("open").alias("state"))


def ingest(pages: DataFrame, prepare: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream of pages, prepared and written batch by batch; the batch number makes the writing repeatable."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            write(prepare(batch), number)

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def refreshed(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60):
    """A stream whose changed rows are written every ``seconds``."""
    return df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def status_counts(reports: DataFrame) -> DataFrame:
    """Counts by state for a dashboard; only changed ones are written in update mode."""
    return reports.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Events and their value per window and type; what is later than ``late`` is left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: runs of events without a gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def apply_updates(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A table with a batch of changed rows merged in."""
    return store.upsert(current, changes, keys)
