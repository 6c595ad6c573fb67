"""Streams against their batch forms."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from folium.plans.catalog import QUERIES
from folium.streaming import progress

from .conftest import DATA


def drained(spark, stream, mode="append"):
    name = f"t{abs(hash(tempfile.mktemp()))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-stream-")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_progress_changes_match_the_batch(spark):
    at = tempfile.mkdtemp(prefix="spark-stream-")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.mode("overwrite").parquet(at)
    stream = spark.readStream.schema(events.schema).parquet(at)
    got = sorted(tuple(r) for r in drained(spark, progress.progress_changes(stream)).collect())
    assert got == sorted(tuple(r) for r in QUERIES["progress_changes"](spark, DATA).collect())


def test_usage_by_hour_matches_the_batch(spark):
    at = tempfile.mkdtemp(prefix="spark-stream-")
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.mode("overwrite").parquet(at)
    stream = spark.readStream.schema(events.schema).parquet(at)
    got = {(r["hour"], r["event_type"]): r["n"] for r in drained(spark, progress.usage_by_hour(stream), "complete").collect()}
    assert got == {(r["hour"], r["event_type"]): r["n"] for r in QUERIES["tumbling_usage"](spark, DATA).collect()} and got


def test_secrets_cut_anywhere_are_replaced(spark):
    for cut in range(7):
        a, tail = progress.passed_on("", "my secret"[: 3 + cut], ["secret"])
        b, tail = progress.passed_on(tail, "my secret"[3 + cut :] + " is", ["secret"])
        assert a + b + tail == "my [REDACTED] is"
    at = tempfile.mkdtemp(prefix="spark-stream-")
    rows = spark.createDataFrame([(1, 0, "a sec"), (1, 1, "ret b"), (2, 0, "secretsecret"), (3, 0, "ends in sec"), (3, 1, None)], "stream long, seq long, text string")
    rows.coalesce(1).write.mode("overwrite").parquet(at)
    got = drained(spark, progress.redacted_stream(spark.readStream.schema(rows.schema).parquet(at), ["secret"])).orderBy("stream", "seq").collect()
    assert [r["text"] for r in got] == ["a ", "[REDACTED] b", "[REDACTED][REDACTED]", "ends in ", "sec"]


def test_event_frames(spark):
    rows = spark.createDataFrame([(1, ": beat\r\n\r\ndata: a\r\ndata: b\r\n\r\nevent: x\n\ndata:c")], "stream long, text string")
    assert [r["data"] for r in progress.event_frames(rows).orderBy("at").collect()] == ["a\nb", "c"]
    assert progress.event_frames(rows.select("stream", F.lit(None).cast("string").alias("text"))).count() == 0
