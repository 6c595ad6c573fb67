"""Structured Streaming forms: change-only progress, redaction across chunks, usage by event time, event frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_by_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, event_type, n, total; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    before = rows["event_type"].shift(fill_value=last)
    state.update((rows["event_type"].iloc[-1],))
    kept = rows[rows["event_type"] != before]
    yield pd.DataFrame({"user_id": key[0], "event_id": kept["event_id"], "event_type": kept["event_type"]})


def progress_changes(events: DataFrame) -> DataFrame:
    """user_id, event_id, event_type where the state of a key changes; the state is the last one seen."""
    rows = events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id")
    return rows.applyInPandasWithState(_changes, "user_id long, event_id long, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)


MASK = "[REDACTED]"


def passed_on(tail: str, chunk: str, secrets: list[str]) -> tuple[str, str]:
    """What of tail and chunk can be shown, with secrets masked, and the new tail: the end that a secret may begin with."""
    text = tail + chunk
    for s in secrets:
        text = MASK.join(text.split(s))
    longest = max(map(len, secrets), default=1) - 1
    for at in range(max(0, len(text) - longest), len(text)):
        if any(s.startswith(text[at:]) for s in secrets):
            return text[:at], text[at:]
    return text, ""


def redacted_stream(chunks: DataFrame, secrets: list[str]) -> DataFrame:
    """stream, seq, text: chunks (stream, seq, text) with secrets masked, also those cut by a chunk's end. State: the tail held back.

    A chunk whose text is null ends its stream: what was held back comes out with it.
    """
    hidden = [s for s in secrets if s]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for text in rows["text"]:
            if text is None:
                out.append(tail)
                tail = ""
            else:
                shown, tail = passed_on(tail, text, hidden)
                out.append(shown)
        state.update((tail,))
        yield pd.DataFrame({"stream": key[0], "seq": rows["seq"].to_numpy(), "text": out})

    return chunks.select("stream", "seq", "text").groupBy("stream").applyInPandasWithState(run, "stream long, seq long, text string", "tail string", "append", GroupStateTimeout.NoTimeout)


def event_frames(data: DataFrame) -> DataFrame:
    """stream, at, data: the data of each server-sent event in text (stream, text): lines of one event joined, comments left out."""
    text = F.regexp_replace("text", "\r\n?", "\n")
    frames = data.select("stream", F.posexplode(F.split(text, "\n\n+")).alias("at", "frame"))
    lines = F.filter(F.split("frame", "\n"), lambda x: x.startswith("data:"))
    joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return frames.select("stream", "at", F.size(lines).alias("n"), joined.alias("data")).filter("n > 0").drop("n")
