"""What a reader should look at: a frame for each rule, united. Severity falls to info while a document is busy, and before its approval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import TRANSLATED, in_references, live


def block_issues(rows: DataFrame) -> DataFrame:
    """doc_id, id, rule, severity for blocks with the state of their document (busy, approved).

    rows: blocks with fallback, image_broken, restore_error, restored, rejected, translated (all boolean), busy and approved.
    """
    now = live(rows)
    visual, unrestored = F.col("type").isin("fig", "tab"), F.col("type").isin("tab", "eq") & ~F.col("restored")
    target = ~in_references(F.col("section")) & F.col("type").isin(*TRANSLATED, "tab", "fig")
    quiet = F.col("busy") | ~F.col("approved")
    graded = lambda low: F.when(low, "info").otherwise("attention")
    rules = [
        ("visual_pdf_fallback", visual & F.col("fallback"), F.lit("info")),
        ("missing_image", F.col("image_broken"), graded(F.col("busy"))),
        ("restore_failed", F.col("restore_error"), F.lit("attention")),
        ("restore_pending", ~F.col("restore_error") & ~F.col("image_broken") & unrestored, F.lit("info")),
        ("translation_rejected", target & F.col("rejected"), graded(F.col("translated") | F.col("busy"))),
        ("untranslated", target & ~F.col("rejected") & ~F.col("translated"), graded(quiet)),
    ]
    found = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("rule"), severity.alias("severity"))) for name, when, severity in rules)))
    return now.select("doc_id", "id", F.explode(found).alias("i")).select("doc_id", "id", "i.rule", "i.severity")


def page_issues(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, page, rule, severity (all info) of pages (doc_id, page, has_text, recognised) by the blocks (doc_id, page) on them: one rule each."""
    met = blocks.select("doc_id", "page").distinct().withColumn("met", F.lit(True))
    rule = F.when(F.col("recognised"), "ocr_recognized").when(~F.col("has_text"), "page_without_text").when(F.col("met").isNull(), "unmatched_source")
    return pages.join(met, ["doc_id", "page"], "left").select("doc_id", "page", rule.alias("rule"), F.lit("info").alias("severity")).filter("rule is not null")


def by_kind(*frames: DataFrame) -> DataFrame:
    """rule, severity, n over all frames."""
    return reduce(DataFrame.unionByName, [f.select("rule", "severity") for f in frames]).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float) -> Column:
    """A rectangle inside the page, or null if it is not finite, not ordered or outside."""
    ok = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (x0, y0, x1, y1)]) & (x0 < x1) & (y0 < y1)
    inside = F.struct(F.greatest(x0, F.lit(0.0)).alias("x0"), F.greatest(y0, F.lit(0.0)).alias("y0"), F.least(x1, F.lit(width)).alias("x1"), F.least(y1, F.lit(height)).alias("y1"))
    return F.when(ok & (x0 < width) & (y0 < height) & (x1 > 0) & (y1 > 0), inside)


def glossary(answer: Column, most: int = 80) -> Column:
    """Entries (term, target) of an answer in JSON, a list or an object with one: those with both, each term once whatever its case, `most` at most."""
    kind = "array<struct<term:string,target:string>>"
    listed = F.when(answer.rlike(r"^\s*\["), F.from_json(answer, kind)).otherwise(F.from_json(answer, f"struct<terms:{kind}>")["terms"])
    whole = F.filter(listed, lambda e: (F.trim(e["term"]) != "") & (F.trim(e["target"]) != ""))
    names = F.transform(whole, lambda e: F.lower(F.trim(e["term"])))
    return F.slice(F.filter(whole, lambda e, i: F.array_position(names, F.lower(F.trim(e["term"]))) == i + 1), 1, most)
