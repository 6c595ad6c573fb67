"""Connected components by joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each end of the links (a, b), a staged table.

    Alternates two steps until neither changes anything: each node hands its smallest
    neighbour to its larger ones, then to all smaller ones. Rows of a node are read in order
    of the neighbour, so that none is gathered in memory.
    """
    n = links.count()
    now = staged(_oriented(links).distinct(), "graph", rows=n)
    state = None
    while True:
        after = staged(_small_star(_large_star(now)), "graph", rows=n)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state, now = tuple(seen), after
    heads = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return staged(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads), "graph-components", rows=n)


def _oriented(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _least() -> Window:
    return Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = F.least(F.first("v").over(_least()), F.col("u"))
    return both.withColumn("m", m).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = edges.withColumn("m", F.first("v").over(_least()))
    handed = found.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.select("u", F.col("m").alias("v")).unionByName(handed).distinct()
