"""What goes with a block: cross references, labels, enclosing headings, notes, evidence; and the order notes and threads are shown in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a visual is named in running text, by its kind.
MENTION = r"\b(Table|Fig|Eq)[a-z]*\.?\s*(\d+)"
KIND = {"Table": "tab", "Fig": "fig", "Eq": "eq"}


def mentions(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, kind, num of the visuals that blocks (doc_id, ord, text) name."""
    found = lambda k: F.regexp_extract_all("text", F.lit(MENTION), F.lit(k))
    kind = F.create_map(*(F.lit(x) for kv in KIND.items() for x in kv))
    pairs = blocks.select("doc_id", "ord", F.explode(F.arrays_zip(found(1).alias("k"), found(2).alias("num"))).alias("m"))
    return pairs.select("doc_id", "ord", F.element_at(kind, F.col("m.k")).alias("kind"), F.col("m.num").cast("bigint").alias("num"))


def cross_references(blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """doc_id, ord, target: for each mention, the first visual (doc_id, ord, id, kind, n) of the kind whose label ends in the number."""
    num = F.regexp_extract("n", r"(\d+)\)?$", 1)
    named = visuals.filter(num != "").groupBy("doc_id", "kind", num.cast("bigint").alias("num")).agg(F.min_by("id", "ord").alias("target"))
    return mentions(blocks).join(named, ["doc_id", "kind", "num"]).select("doc_id", "ord", "target").distinct()


def label_evidence(batches: DataFrame, visuals: DataFrame, most: int = 8) -> DataFrame:
    """doc_id, batch, id: visuals (doc_id, ord, id, n) whose label stands as a word in the batch's text (doc_id, batch, text), the first `most`."""
    words = batches.select("doc_id", "batch", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))).alias("n"))
    met = words.join(visuals.select("doc_id", "ord", "id", "n"), ["doc_id", "n"])
    place = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("ord"))
    return met.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "batch", "id")


def enclosing_headings(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """doc_id, id, heading: headings (doc_id, id, path) whose path is a beginning of the row's (doc_id, id, path). An equi join on the beginnings."""
    starts = rows.select("doc_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda k: F.slice("path", 1, k))).alias("path"))
    return starts.distinct().join(heads.select("doc_id", "path", F.col("id").alias("heading")), ["doc_id", "path"]).filter("heading <> id").select("doc_id", "id", "heading")


def multiword_hits(blocks: DataFrame, terms: DataFrame, longest: int = 3) -> DataFrame:
    """doc_id, term, first, n: blocks (doc_id, ord, text) that hold a term (term: lower case, words with single spaces) as whole words."""
    w = F.col("w")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    grams = F.concat(*(runs(n) for n in range(1, longest + 1)))
    words = blocks.select("doc_id", "ord", F.array(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("ws")).select("doc_id", "ord", F.explode("ws").alias("w"))
    held = words.select("doc_id", "ord", F.explode_outer(F.array_distinct(grams)).alias("term"))
    return held.join(terms, "term").groupBy("doc_id", "term").agg(F.min("ord").alias("first"), F.count("*").alias("n"))


def inserted_by_page(rows: DataFrame, added: DataFrame) -> DataFrame:
    """doc_id, id, position: added rows (doc_id, id, page) before the first row (doc_id, ord, id, page) of a later page, else at the end."""
    ahead = F.max("page").over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    old = rows.select("doc_id", ahead.alias("page"), F.lit(0).alias("late"), F.col("ord").alias("o"), "id")
    new = added.select("doc_id", F.col("page").cast("bigint").alias("page"), F.lit(1).alias("late"), F.lit(0).cast("bigint").alias("o"), "id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "late", "o", "id")) - 1
    return old.unionByName(new).select("doc_id", "id", place.cast("bigint").alias("position"))


def barriers(rows: DataFrame, is_heading: Column, is_body: Column) -> DataFrame:
    """rows (page, y0, y1) with `above`, the lowest end of a heading above each, and `below`, the first start of a body line below it."""
    w = Window.partitionBy("page").orderBy("y0", "k")
    above = F.max(F.when(is_heading, F.col("y1"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    below = F.min(F.when(is_body, F.col("y0"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"above": above, "below": below})


def captioned(items: DataFrame, page: list[str], caption: Column, artwork: Column, barrier: Column) -> DataFrame:
    """page, id, art, gap: captions (fig or tab, else null) with their artwork, of items (page, id, y0, y1) in one column each.

    A figure's artwork is the nearest above its caption, a table's the nearest below; a barrier in between parts them. Of several captions of one artwork the nearest has it.
    """
    w = Window.partitionBy(*page).orderBy("y0", "id")
    mark = F.when(artwork | barrier, F.struct(artwork.alias("art"), "id", "y0", "y1"))
    above = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    below = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = items.withColumns({"_kind": caption, "_above": above, "_below": below}).withColumn("_near", F.when(F.col("_kind") == "fig", F.col("_above")).when(F.col("_kind") == "tab", F.col("_below"))).filter("_near.art")
    pairs = near.select(*page, "id", F.col("_near.id").alias("art"), F.greatest(F.col("y0") - F.col("_near.y1"), F.col("_near.y0") - F.col("y1"), F.lit(0)).alias("gap"))
    place = F.row_number().over(Window.partitionBy(*page, "art").orderBy("gap", "id"))
    return pairs.withColumn("_place", place).filter("_place = 1").drop("_place")


def kept_refs(refs: Column, known: Column, most: int) -> Column:
    """References in order, each once, that are among the known, `most` at most."""
    return F.slice(F.filter(F.array_distinct(refs), lambda r: F.array_contains(known, r)), 1, most)


def saved_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (anchor, id, origin, text) after a section is annotated again: those of users stay, others are replaced; a note that comes again keeps its id."""
    mine = old.filter("origin = 'user'")
    again = new.join(mine.select("anchor", "id"), ["anchor", "id"], "left_anti")
    return mine.unionByName(again.select(mine.columns))


def natural_key(title: Column) -> Column:
    """Sorts titles with their numbers by value: digits are padded to 12."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(title), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")
