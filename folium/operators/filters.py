"""Which rows a stage, an export or a reader takes. Blocks: doc_id, ord, id, type, text, section, superseded, sourced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Section names of references, types that are translated, kinds of notes, pieces of an answer's identity.
REFERENCES = ("references", "bibliography")
TRANSLATED = ("sec", "sub", "ssub", "p", "li")
NOTE = "card"


def in_references(section: Column) -> Column:
    return F.coalesce(F.lower(F.trim(section)).isin(*REFERENCES), F.lit(False))


def live(rows: DataFrame) -> DataFrame:
    """Neither notes nor rows that another has superseded."""
    return rows.filter((F.col("type") != NOTE) & ~F.col("superseded"))


def translation_targets(rows: DataFrame) -> DataFrame:
    """Live rows outside of references that have something to translate: prose, headings, or a caption (tables and figures)."""
    return live(rows).filter(~in_references(F.col("section")) & F.col("type").isin(*TRANSLATED, "tab", "fig"))


def evidence(rows: DataFrame) -> DataFrame:
    return live(rows).filter(F.col("sourced") & ~in_references(F.col("section")))


def annotatable(rows: DataFrame) -> DataFrame:
    """A row without source counts as one of the references."""
    return live(rows).filter(~F.when(F.col("sourced"), in_references(F.col("section"))).otherwise(True))


def active(rows: DataFrame, asked: Column) -> DataFrame:
    """Current versions, and the superseded row that is asked about."""
    return rows.filter(~F.col("superseded") | F.coalesce(asked, F.lit(False)))


def visible_notes(notes: DataFrame, kinds: list[str], density: str) -> DataFrame:
    """Notes (kind) of the chosen kinds: all at high density, all but terms at normal, key points at low."""
    fits = {"high": F.lit(True), "normal": F.col("kind") != "trm", "low": F.col("kind") == "key"}[density]
    return notes.filter(F.col("kind").isin(*kinds) & fits)


def restore_candidates(rows: DataFrame, trusted: Column, pictured: Column) -> DataFrame:
    """Tables and equations that have an image, but not tables whose grid is trusted."""
    return live(rows).filter(F.col("type").isin("tab", "eq") & pictured & ~in_references(F.col("section")) & ~((F.col("type") == "tab") & trusted))


def is_prose(text: Column) -> Column:
    """A line that reads on: it ends in a colon after a word, or has four words of three letters, or starts a sentence of three words."""
    return text.rlike(r"\p{L}{2,}\s*:\s*$") | (F.regexp_count(text, F.lit(r"\p{L}{3,}")) >= 4) | (text.rlike(r"^\p{Lu}\p{Ll}") & (F.regexp_count(text, F.lit(r"\S+")) >= 3))


def sure_passage(kind: Column, text: Column) -> Column:
    """Long enough to be looked for: prose of 40 characters and 6 words, captions of 24 and 4."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(kind.isin("fig", "tab"), (F.length(text) >= 24) & (words >= 4)).otherwise((F.length(text) >= 40) & (words >= 6))


def contained_path(path: Column, owner: Column) -> Column:
    """A relative path without steps upwards, in the folder of its document."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & path.startswith(F.concat(F.lit("documents/"), owner.cast("string"), F.lit("/")))


def ocr_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """Of the pages asked for (doc_id, page, has_text), those without text of their own, if 1 to `most` different ones are asked for."""
    asked = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("n")).filter(F.col("n").between(1, most))
    return pages.join(asked.select("doc_id"), "doc_id", "left_semi").filter(~F.col("has_text")).dropDuplicates(["doc_id", "page"])


def recoverable(jobs: DataFrame, revision: int, *used: DataFrame) -> DataFrame:
    """Jobs (doc_id, kind, revision, approved) of an old revision, not approved, of documents that no table of `used` (doc_id) holds."""
    out = jobs.filter((F.col("kind") == "pdf") & (F.col("revision") < revision) & ~F.col("approved"))
    for u in used:
        out = out.join(u.select("doc_id"), "doc_id", "left_anti")
    return out


def ended_jobs(before: DataFrame, now: DataFrame, library: DataFrame) -> DataFrame:
    """Keys (doc_id) that were busy and are no more, and still exist."""
    return before.select("doc_id").join(now.select("doc_id"), "doc_id", "left_anti").join(library.select("doc_id"), "doc_id", "left_semi")


def section_window(rows: DataFrame, key: list[str], order: str, before: int = 12, size: int = 24) -> DataFrame:
    """rows with `place` and `start` of the window of each: `size` rows of its section, from `before` rows before it, inside the section."""
    w = Window.partitionBy(*key)
    placed = rows.withColumn("place", (F.row_number().over(w.orderBy(order)) - 1).cast("bigint")).withColumn("_n", F.count("*").over(w))
    start = F.greatest(F.lit(0), F.least(F.col("place") - before, F.col("_n") - size)).cast("bigint")
    return placed.withColumn("start", start).withColumn("rows", F.least(F.col("_n"), F.lit(size)).cast("bigint")).drop("_n")
