"""Operators on table grids, as cells (table, r, c, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .folds import BATCH


def place_cells(cells: DataFrame, key: str, more: tuple[str, ...] = ("text",)) -> DataFrame:
    """key, r, c and the columns `more` for every grid square that a cell covers.

    cells: key, r, k (its place in the row), more, colspan, rowspan (1 at least). Cells of a row stand side by side; those that
    reach down from rows above shift it. Spark sorts the cells of a key; tasks place them by their numbers alone, with the state of one
    key, and Arrow copies the other columns.
    """
    schema, ordered, run = _placing(cells, key, more)
    return ordered.mapInArrow(run, schema)


def check_grids(cells: DataFrame, key: str, dealt: bool = False) -> DataFrame:
    """key, squares (how many a key's cells cover, those that cells share once for each) and fault as of grid_faults, of cells as place_cells takes them.

    Squares are counted where they are placed, with those of one key in memory. dealt: the cells of a key are in one task already.
    """
    _, ordered, run = _placing(cells, key, (), dealt)
    schema = StructType([cells.schema[key], StructField("squares", LongType()), StructField("fault", StringType())])
    return ordered.mapInArrow(lambda batches: _checked(run(batches), schema.names), schema)


def _checked(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """key, squares, fault of key, r, c, in which each key's rows follow one another."""

    def faults(squares: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(squares).combine_chunks()
        r, c = (t.column(i).to_numpy() for i in (1, 2))
        new = _new_keys(t.column(0))
        g = np.cumsum(new) - 1
        o = np.lexsort((c, r, g))
        g, r, c = g[o], r[o], c[o]
        row = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))
        once = row | np.append(True, c[1:] != c[:-1])
        at = np.flatnonzero(row)
        wide, last = np.add.reduceat(once.astype(np.int64), at), np.maximum.reduceat(c, at)
        keys = np.flatnonzero(np.append(True, g[at][1:] != g[at][:-1]))
        low, high, gap = np.minimum.reduceat(wide, keys), np.maximum.reduceat(wide, keys), np.maximum.reduceat(last + 1 - wide, keys)
        n, single = np.bincount(g), np.bincount(g, weights=once)
        fault = np.select([n > single, gap > 0, low != high], ["overlap", "gap", "ragged"], "")
        told = pa.array([x or None for x in fault.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([t.column(0).take(pa.array(np.flatnonzero(new))).combine_chunks(), pa.array(n, pa.int64()), told], names)

    held: list[pa.RecordBatch] = []
    for b in batches:
        # the last key may go on in the next batch
        cut = int(np.flatnonzero(_new_keys(b.column(0)))[-1])
        if held and (cut or b.column(0)[0].as_py() != held[-1].column(0)[0].as_py()):
            yield faults([*held, b.slice(0, cut)] if cut else held)
            held = []
        elif cut:
            yield faults([b.slice(0, cut)])
        held.append(b.slice(cut))
    if held:
        yield faults(held)


def _new_keys(keys: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where a key begins."""
    whole = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    codes = whole.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return np.append(True, codes[1:] != codes[:-1])


def _placing(cells: DataFrame, key: str, more: tuple[str, ...], dealt: bool = False):
    """Schema of the squares, the sorted cells, and what places a task's share of them."""
    span = lambda name: F.greatest(F.col(name).cast("int"), F.lit(1)).alias(f"_{name}")
    schema = StructType([cells.schema[key], StructField("r", IntegerType()), StructField("c", IntegerType()), *(cells.schema[m] for m in more)])
    arrow = to_arrow_schema(schema)
    told = cells.select(F.col(key), F.col("r").cast("int").alias("r"), "k", span("colspan"), span("rowspan"), *more)
    ordered = (told if dealt else told.repartition(key)).sortWithinPartitions(key, "r", "k").drop("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: The last row that each column is taken in, by the cells of the key that reach down.
        until: dict[int, int] = {}
        last, row, c, begun = None, None, 0, False

        def made(b: pa.RecordBatch, at: list[int], rs: list[int], cs: list[int]) -> pa.RecordBatch:
            taken = b.take(pa.array(at, pa.int64()))
            columns = [taken.column(0), pa.array(rs, pa.int32()), pa.array(cs, pa.int32()), *taken.columns[4:]]
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        for b in batches:
            at, rs, cs = [], [], []
            for i, (k, r, wide, high) in enumerate(zip(*(x.to_pylist() for x in b.columns[:4]), strict=True)):
                if k != last or not begun:
                    last, row, begun = k, None, True
                    until = {}
                if r != row:
                    row, c = r, 0
                if until:
                    while until.get(c, r - 1) >= r:
                        c += 1
                if wide == high == 1:
                    at.append(i)
                    rs.append(r)
                    cs.append(c)
                    c += 1
                else:
                    for j in range(c, c + wide):
                        if high > 1:
                            until[j] = max(until.get(j, r), r + high - 1)
                        for y in range(r, r + high):
                            at.append(i)
                            rs.append(y)
                            cs.append(j)
                            if len(at) >= BATCH:
                                yield made(b, at, rs, cs)
                                at, rs, cs = [], [], []
                    # what this cell covers needs no search
                    c += wide
                if len(at) >= BATCH:
                    yield made(b, at, rs, cs)
                    at, rs, cs = [], [], []
            if at:
                yield made(b, at, rs, cs)

    return schema, ordered, run


def grid_faults(squares: DataFrame, key: str) -> DataFrame:
    """key, fault: overlap, ragged or gap, or null for a grid that can be trusted."""
    per_square = squares.groupBy(key, "r", "c").agg(F.count("*").alias("n"))
    per_row = per_square.groupBy(key, "r").agg(F.max("n").alias("n"), F.count("*").alias("wide"), F.max("c").alias("last"))
    g = per_row.groupBy(key).agg(F.max("n").alias("n"), F.min("wide").alias("low"), F.max("wide").alias("high"), F.max(F.col("last") + 1 - F.col("wide")).alias("gap"))
    return g.select(key, F.when(F.col("n") > 1, "overlap").when(F.col("gap") > 0, "gap").when(F.col("low") != F.col("high"), "ragged").alias("fault"))


def best_cells(cells: DataFrame, key: str, column: str, value: Column, least: int = 2) -> DataFrame:
    """cells with the largest value of their column, ties included, of columns with at least `least` numbers."""
    w = Window.partitionBy(key, column)
    marked = cells.withColumn("_v", value).withColumn("_top", F.max("_v").over(w)).withColumn("_n", F.count("_v").over(w))
    return marked.filter((F.col("_v") == F.col("_top")) & (F.col("_n") >= least)).drop("_v", "_top", "_n")


def conflicts(before: DataFrame, after: DataFrame, key: str, tokens) -> DataFrame:
    """key, n: squares (key, r, c, text) whose number tokens differ, among tables of the same shape."""
    both = before.select(key, "r", "c", F.col("text").alias("a")).join(after.select(key, "r", "c", F.col("text").alias("b")), [key, "r", "c"], "full_outer")
    per = both.groupBy(key).agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("odd"), F.count_if((F.size(tokens(F.col("a"))) > 0) & (tokens(F.col("a")) != tokens(F.col("b")))).alias("n"))
    return per.select(key, F.when(F.col("odd") > 0, 0).otherwise(F.col("n")).cast("bigint").alias("n"))
