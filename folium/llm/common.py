"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACE = " \\t-\\r"

#: Rows up to which a table that does not hold one row per document is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master has one of its own; a cluster cannot."""
    sc = spark.sparkContext
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        at = sc.getCheckpointDir()
    return at


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of small columns in one file, where the number of rows is known.
FILE_ROWS = 500_000


def staged(df: DataFrame, tag: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read back: lineage is cut, and lost executors cost nothing.

    rows: about how many there are; with it, they are dealt to as few files as these fill.
    """
    at = new_path(df.sparkSession, tag)
    if rows is not None:
        df = df.repartition(rows // FILE_ROWS + 1)
    df.write.option("compression", codec).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table with a broadcast hint if it has at most `rows` rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def words(text: Column) -> Column:
    """Maximal runs without white space; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def streamed(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, list[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn(key, batches) for each group, over a sorted stream of many groups a task; cheaper than a Python call from the JVM for each."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(lambda it: _groups(it, keys, fn), schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], fn) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        while at < len(rows):
            key, end = rows[at], at + 1
            while end < len(rows) and rows[end] == key:
                end += 1
            if held and key != now:
                yield from fn(now, held)
                held = []
            now = key
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield from fn(now, held)
