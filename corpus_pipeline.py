"""The pipeline over the documents: quality, near duplicates, decontamination, personal data, mixture.

Rows are dropped one by one, by a number that each stage gives them: rows of one doc_id, or without one, do not share a fate.
Each stage keeps all columns; the last adds copies, taken and target, in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import mixing, ngram_join, phrase_index, pii, quality
from folium.llm.common import small, staged, table

#: Words of a shingle, and percent of shingles that near duplicates share.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Documents whose removal is sent to every task; more are shuffled.
REMOVED = 1_000_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a rule of the cascade rejects go."""
    return quality.judge(docs.select(F.struct("*").alias("_row"), "text")).filter("kept").select("_row.*")


def _numbered(docs: DataFrame, tag: str) -> DataFrame:
    """_number (of its own for each row), _row."""
    return staged(docs.select(F.monotonically_increasing_id().alias("_number"), F.struct("*").alias("_row")), tag)


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_number").alias("doc_id"), F.col("_row.text").alias("text"))


def _without(rows: DataFrame, numbers: DataFrame, tag: str) -> DataFrame:
    return rows.join(small(staged(numbers, tag), REMOVED), "_number", "left_anti").select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows, the one with the smallest doc_id stays, one without doc_id only if all are. Rows without words stay."""
    rows = _numbered(docs, "pipeline-numbered")
    found = ngram_join.jaccard_join(_texts(rows), SHINGLE_WORDS, SIMILARITY).select(F.col("doc_id").alias("_number"), F.col("component_id").alias("class"))
    order = F.struct(F.col("_row.doc_id").isNull().alias("none"), F.col("_row.doc_id").alias("id"), F.xxhash64("_row.text").alias("key"), "_number")
    classes = staged(found.join(rows.select("_number", order.alias("order")), "_number"), "pipeline-classes")
    first = classes.groupBy("class").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = classes.join(first, "class").filter("_number <> first._number").select("_number")
    return _without(rows, gone, "pipeline-gone")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a window of a benchmark item occurs go."""
    rows = _numbered(docs, "pipeline-numbered")
    found = phrase_index.contamination(_texts(rows), table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select(F.col("doc_id").alias("_number"))
    return _without(rows, found, "pipeline-hits")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates take the place of personal data; n_chars follows the new text."""
    out = pii.replace_entities(docs.select(F.struct("*").alias("_row"), "text"))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("_row")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how often (copies) and how many words these are (taken)."""
    mixed = mixing.mix(docs).filter("copies > 0")
    taken = mixed.groupBy("row").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.max("target").alias("target"))
    again = small(staged(mixed.groupBy("row").count().filter("count > 1").select("row"), "pipeline-again"), REMOVED)
    added = ("copies", "taken", "target")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in added]).alias("_doc"), mixing.row_key().alias("row"))
    #: Equal rows become one, with the copies of all.
    alone = rows.join(again, "row", "left_anti").unionByName(rows.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return alone.join(taken, "row").select("_doc.*", *added)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("mixture", mix_sources),
]

#: Hashes of Spark, a learned order and random ranks have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
