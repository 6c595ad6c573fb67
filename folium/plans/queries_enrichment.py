"""Staged enrichment: batches that fail are halved, answers that lose something are asked again alone. SQL gives what each row must end as."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import content as C
from folium.operators.enrich import enrich, request_key, with_memo
from folium.sources.tables import table

from .registry import registry

QUERIES, SQL, query = registry()


def _stub(asked: list[tuple[str, str]]) -> dict[str, str]:
    """A provider in place of a model: fails on every batch with a row of a conversation that 53 divides, loses figures, leaves rows out, names rows that nobody asked for."""
    ids = {i: [int(x) for x in i.split("-")] for i, _ in asked}
    if any(conv % 53 == 0 for conv, _ in ids.values()):
        raise ValueError("the provider refuses this batch")
    out = {"0-0-unknown": "?"}
    for i, text in asked:
        conv, turn = ids[i]
        if (conv + turn) % 5 == 0:
            out[i] = "T"
        elif conv % 7 or len(asked) == 1:
            out[i] = f"T {text}"
    return out


_ROWS = "m AS (SELECT conv_id, turn, conv_id || '-' || turn AS id, text || ' 12% of ' || conv_id AS text FROM conversations WHERE text IS NOT NULL)"


def _rows(spark, sf_dir):
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    told = F.concat("text", F.lit(" 12% of "), conv)
    return table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", F.concat_ws("-", conv, turn).alias("id"), told.alias("text"), F.floor(F.col("conv_id") / 8).alias("batch"))


def _keeps(text, answer):
    lost = C.lost(text, answer)
    return (lost["numbers"] == 0) & (lost["percentages"] == 0)


@query("enriched_rows", f"WITH {_ROWS} SELECT id, CASE WHEN conv_id % 53 <> 0 AND (conv_id + turn) % 5 <> 0 THEN sha256('T ' || text) END AS sha, CASE WHEN conv_id % 53 = 0 THEN 'failed' WHEN (conv_id + turn) % 5 = 0 THEN 'rejected' ELSE 'done' END AS status FROM m")
def enriched_rows(spark, sf_dir):
    """Messages answered in batches by conversation: done, rejected as figures were lost twice, or failed alone."""
    return enrich(_rows(spark, sf_dir), _stub, _keeps).select("id", F.sha2("answer", 256).alias("sha"), "status")


@query("memo_answers", f"WITH {_ROWS} SELECT key, CASE WHEN min(conv_id % 3) = 0 THEN 'kept' ELSE 'asked' END AS answer FROM (SELECT *, sha256('{{\"stage\":\"translate\",\"model\":\"m1\",\"payload\":' || to_json(text) || '}}') AS key FROM (SELECT conv_id, left(text, 40) AS text FROM m)) GROUP BY key HAVING count(DISTINCT conv_id % 3 = 0) = 1")
def memo_answers(spark, sf_dir):
    """Requests by key: those of every third conversation have been answered before and are not asked again."""
    rows = _rows(spark, sf_dir).withColumn("key", request_key("translate", "m1", F.substring("text", 1, 40)))
    once = rows.groupBy("key").agg(F.min((F.col("conv_id") % 3 == 0).cast("int")).alias("low"), F.max((F.col("conv_id") % 3 == 0).cast("int")).alias("high")).filter("low = high")
    memo = once.filter("low = 1").select("key", F.lit("kept").alias("answer"))
    return with_memo(once.select("key"), memo, lambda todo: todo.withColumn("answer", F.lit("asked"))).select("key", "answer")
