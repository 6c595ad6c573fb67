"""Staged enrichment: a function of payloads is asked once for each key, answers are checked, and what fails is asked again in halves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folium.sources.tables import settled

from .folds import over_keys

Answer = Callable[[list[tuple[str, str]]], dict[str, str]]


def request_key(stage: str, model: str, payload: Column) -> Column:
    """The same for equal requests; what answers are kept under."""
    return F.sha2(F.to_json(F.struct(F.lit(stage).alias("stage"), F.lit(model).alias("model"), payload.alias("payload"))), 256)


def _asked(answer: Answer) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        """id, text, tries, answer, failed, size (of the batch), place for the rows (id, text, tries) of one batch."""
        batch = list(rows)
        try:
            got, failed = answer([(i, text) for i, text, _ in batch]), False
        except Exception:  # a provider may fail in any way; the batch is then asked again in halves
            got, failed = {}, True
        for place, (i, text, tries) in enumerate(batch):
            yield i, text, tries, got.get(i), failed, len(batch), place

    return each


def enrich(rows: DataFrame, answer: Answer, accept: Callable[[Column, Column], Column], batch: str = "batch", save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, answer, status (done, rejected or failed) for rows (id, text, batch).

    A batch that raises is halved for the next round, down to single rows, of which one that raises has failed. Answers that are missing or not accepted are asked again once, alone;
    unknown ids in an answer are ignored. save: writes a round's answers and reads them back, so that none is asked twice.
    Rows are shuffled by their batch, and tasks read them as a stream, a batch at a time; what is asked again is read from the answers of the round.
    """
    keep = save or settled
    todo = rows.select("id", "text", F.col(batch).cast("string").alias("b"), F.lit(0).alias("tries"))
    fields = [rows.schema["id"], rows.schema["text"], *StructType.fromDDL("tries int, answer string, failed boolean, size int, place int").fields]
    fields = [StructField(f.name, f.dataType) for f in fields]
    failed = F.col("failed")
    done = None
    while True:
        asked = over_keys(todo, "b", ["id"], [F.col(c) for c in ("id", "text", "tries")], fields, _asked(answer))
        ok = ~failed & F.col("answer").isNotNull() & F.coalesce(accept(F.col("text"), F.col("answer")), F.lit(False))
        status = F.when(ok, "done").when(failed & (F.col("size") == 1), "failed").when(~failed & (F.col("tries") >= 1), "rejected")
        # what accepts may be costly, and several steps ask for it
        told = keep(asked.withColumn("status", status))
        over = told.filter("status IS NOT NULL").select("id", F.when(F.col("status") == "done", F.col("answer")).alias("answer"), "status")
        done = over if done is None else done.unionByName(over)
        half = F.concat_ws("/", "b", (F.col("place") % 2).cast("string"))
        again = told.filter("status IS NULL")
        todo = again.select("id", "text", F.when(failed, half).otherwise(F.concat_ws("/", "b", "id")).alias("b"), F.when(failed, F.col("tries")).otherwise(F.col("tries") + 1).alias("tries"))
        if todo.isEmpty():
            return done


def with_memo(rows: DataFrame, memo: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, answer: kept answers where there are some; only the others are asked. rows: key and what `ask` needs; memo: key, answer."""
    hit = rows.select("key").join(memo, "key").select("key", "answer")
    return hit.unionByName(ask(rows.join(memo.select("key"), "key", "left_anti")).select("key", "answer"))
