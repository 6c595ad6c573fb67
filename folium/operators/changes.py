"""Applying changes to snapshots, and merging answers into requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supersede(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows after the changes (doc_id, id, text): doc_id, position, id, text, superseded_by.

    rows: doc_id, ord, id, text. A change to the same text leaves its row as it is. Any other makes a new row right after the
    old one, which names it; applied again, it gives the same ids.
    """
    new = changes.select("doc_id", "id", F.col("text").alias("to"))
    both = rows.join(new, ["doc_id", "id"], "left").withColumn("by", F.when(F.col("to") != F.col("text"), F.concat(F.lit("r-"), "id")))
    old = both.select("doc_id", "ord", F.lit(0).alias("late"), "id", "text", F.col("by").alias("superseded_by"))
    made = both.filter("by is not null").select("doc_id", "ord", F.lit(1).alias("late"), F.col("by").alias("id"), F.col("to").alias("text"), F.lit(None).cast("string").alias("superseded_by"))
    place = (F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "late")) - 1).cast("bigint")
    return old.unionByName(made).select("doc_id", place.alias("position"), "id", "text", "superseded_by")


def unchanged_since(state: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Keys whose fingerprint (key, state) is still that of the baseline: those that a prepared change may be applied to."""
    return state.join(baseline, [key, "state"], "left_semi")


def with_answers(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """requests with answer and status: answered, failed (with an error), or retry if there is no result. results: keys, answer, error."""
    j = requests.join(results, keys, "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("answer").isNotNull(), "answered").otherwise("retry")
    return j.withColumn("status", status)


def allowed(old: Column, new: Column, gates: dict[str, list[str]]) -> Column:
    """Whether a status may follow another."""
    out = F.lit(False)
    for before, after in gates.items():
        out = out | ((old == before) & new.isin(after))
    return out


def table_html(cells: DataFrame, key: str, row: str, column: str, text: Column, header: Column) -> DataFrame:
    """key, html: cells as one table, rows and cells in order, with texts escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = F.when(header, "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy(key, row).agg(F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), cell.alias("h")))).alias("cs"))
    told = rows.select(key, row, F.concat(F.lit("<tr>"), F.array_join(F.transform("cs", lambda c: c["h"]), ""), F.lit("</tr>")).alias("h"))
    whole = told.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), "h"))).alias("rs"))
    return whole.select(key, F.concat(F.lit("<table>"), F.array_join(F.transform("rs", lambda r: r["h"]), ""), F.lit("</table>")).alias("html"))


def replaced(old: DataFrame, again: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The snapshot after the keys of `again` are extracted anew: their old rows go, whether or not `new` has any for them."""
    return old.join(again.select(key), key, "left_anti").unionByName(new.select(old.columns))
