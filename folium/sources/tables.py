"""Tables and the blocks that documents consist of."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions.text import block_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows, kept as Parquet in the checkpoint folder: what several later steps read is computed once, and survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        at = sc.getCheckpointDir()
    path = f"{at}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks(documents: DataFrame) -> DataFrame:
    """doc_id, ord (from 0), id, type, text: a block for each line of a document."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.format_string("b%04d", "ord").alias("id"), block_type(F.col("text")).alias("type"), "text")


def ingest(spark: SparkSession, path: str, known: DataFrame | None = None, most: int = 150 << 20) -> DataFrame:
    """Files as documents: id from the content's hash; larger ones, other kinds and known hashes are left out, one row for each content."""
    files = spark.read.format("binaryFile").load(path).filter((F.col("length") <= most) & (F.substring("content", 1, 5) == F.lit(b"%PDF-")))
    named = files.select(F.concat(F.lit("pdf-"), F.substring(F.sha2("content", 256), 1, 24)).alias("id"), F.sha2("content", 256).alias("hash"), "path", "length")
    first = named.groupBy("id", "hash").agg(F.min("path").alias("path"), F.first("length").alias("length"))
    return first if known is None else first.join(known.select("hash"), "hash", "left_anti")
