"""Operators on the order of rows: packing, neighbours, headings, clusters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from .folds import over_keys, scanned


def pack(rows: DataFrame, key: str, order: str, size: Column, budget: int, most: int, group: Column | None = None) -> DataFrame:
    """key, batch (from 0), first, last, n, size: greedy batches in order.

    A batch is closed before a row that would pass the budget, exceed the count, or change the group; a row
    over the budget is a batch of its own; a null size counts 0.
    """

    def each(told: Iterator[tuple]) -> Iterator[tuple]:
        batch, first, last, n, total, held = -1, None, None, 0, 0, None
        for o, s, g in told:
            if n == 0 or total + s > budget or n >= most or g != held:
                if n:
                    yield batch, first, last, n, total
                batch, first, n, total, held = batch + 1, o, 0, 0, g
            last, n, total = o, n + 1, total + s
        if n:
            yield batch, first, last, n, total

    take = [F.col(order), F.coalesce(size.cast("bigint"), F.lit(0)), (F.lit(0) if group is None else group).cast("string")]
    place, long = rows.schema[order].dataType, LongType()
    fields = [StructField("batch", long), StructField("first", place), StructField("last", place), StructField("n", long), StructField("size", long)]
    return over_keys(rows, key, [order], take, fields, each)


def neighbours(rows: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """rows with `around`: the values up to k rows before and after, without the row's own."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.concat(F.collect_list(value).over(w.rowsBetween(-k, -1)), F.collect_list(value).over(w.rowsBetween(1, k)))
    return rows.withColumn("around", near)


def as_of_heading(rows: DataFrame, key: str, order: str, is_heading: Column, label: Column, name: str = "heading") -> DataFrame:
    """rows with the label of the last heading up to the row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(F.when(is_heading, label), ignorenulls=True).over(w))


def on_change(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with `value` where it differs from the row before, else null."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn(name, F.when(F.col(value).eqNullSafe(before), None).otherwise(F.col(value)))


def gap_clusters(rows: DataFrame, key: str, by: str, tolerance: float, tie: str) -> DataFrame:
    """rows with `cluster` (from 0): a new one where `by` is over the tolerance above the row before."""
    w = Window.partitionBy(key).orderBy(by, tie)
    new = F.coalesce((F.col(by) - F.lag(by).over(w) > tolerance).cast("bigint"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def anchored_clusters(rows: DataFrame, key: str, by: str, tolerance: float) -> DataFrame:
    """key, anchor, n: a new cluster where `by` is over the tolerance from the first of the cluster."""

    def each(told: Iterator[tuple]) -> Iterator[tuple]:
        anchor, n = None, 0
        for (x,) in told:
            if n and x - anchor > tolerance:
                yield anchor, n
                n = 0
            anchor, n = (anchor if n else x), n + 1
        if n:
            yield anchor, n

    fields = [StructField("anchor", DoubleType()), StructField("n", LongType())]
    return over_keys(rows.filter(F.col(by).isNotNull()), key, [by], [F.col(by).cast("double")], fields, each)


def reordered(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """pairs with `moved`: rows whose old rank is below one before it or above one after it, in new order."""
    w = Window.partitionBy(key).orderBy(new)
    top = F.max(old).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    low = F.min(old).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return pairs.withColumn("moved", (F.col(old) < top) | (F.col(old) > low))


def compacted(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `position`, from 0 without gaps."""
    return rows.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint"))


def section_paths(rows: DataFrame, key: str, order: str, depth: Column, label: Column) -> DataFrame:
    """rows with `path`: at a heading of depth d, the first d entries of the path before it and its label; other rows carry it on."""
    return scanned(rows, key, [order], [depth.cast("int"), F.coalesce(label, F.lit(""))], "path", "array<string>", [], lambda path, h: path if h[0] is None else [*path[: h[0]], h[1]])
