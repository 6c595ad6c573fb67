"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the words by its weight, at most `most` times what it has; what is
cut off goes to the others by weight. A document's expected number of copies is the target of
its source over the size of its source, scaled by its propensity if there is one. The whole part
of that is certain. The fractional part p is its inclusion probability in a Pareto sample: with
U uniform from a keyed hash, documents are ranked by (U / (1 - U)) / (p / (1 - p)), and those
first in rank are taken until the source has the words of its target.

The cut in the ranking is found from sums over ever finer slices of the rank, never by sorting a
whole source in one task. A few documents that fit in what is left of the target are then added.

Cases: a null source is a source of its own, last in order; null text has size 0; rows of the
same id and text are ranked alike and counted each; an empty table gives an empty result; documents of size
0 take 0 words. Reruns agree, as nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged, words

SLICES = 4096
LEVELS = 2
FILLS = 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """sk, source_size, pull, weight, target; sizes: sk, source, size, propensity. Weights go round the sources by code point, null last.

    One row for each source, far fewer than documents: their order and running sums are taken in one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    sources = sizes.groupBy("sk", "source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("propensity")).alias("pull"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    full = F.col("source_size") * float(most)
    by_fill = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * factor - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = sources.withColumn("level", level).withColumn("full", full)
    #: The lowest level at which a source stays under its bound holds for all after it.
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct((F.col("full") / F.col("weight")).alias("x"), "level"))).over(Window.partitionBy())
    return leveled.withColumn("level", first["level"]).select("sk", "source_size", "pull", "weight", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))).alias("target"))


def _uniform(seed: int, *by: str) -> Column:
    """In (0, 1), from the row's key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 12).cast("double") + 0.5) / float(1 << 52)


def row_key(key: Column | None = None) -> Column:
    """What tells rows of documents apart: id and text; never null."""
    return F.struct(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.col("doc_id").isNull().alias("none"), (F.xxhash64("text") if key is None else key).alias("key"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), factor: float = 1.5, most: float = 2.0, seed: int = 17, propensity: Column | None = None) -> DataFrame:
    """A row for each of docs (doc_id, source, text): row (see row_key), doc_id, size, source, source_size, target, copies, taken.

    propensity: relative, positive; a document's expected copies follow it, up to `most`.
    """
    n = docs.count()
    sizes = staged(
        docs.select("doc_id", "source", _source_key(), F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("key"), (F.lit(1.0) if propensity is None else propensity).cast("double").alias("propensity")),
        "mix-sizes",
        rows=n,
    )
    targets = small(staged(source_targets(sizes, weights, factor, most), "mix-targets", rows=0))
    rows = sizes.join(targets.drop("weight"), "sk")
    expected = F.least(F.when(F.col("pull") > 0, F.col("target") * F.col("propensity") / F.col("pull")).otherwise(0.0), F.lit(float(most)))
    u = _uniform(seed, "doc_id", "key")
    ranked = staged(
        rows.withColumn("expected", expected)
        .withColumn("sure", F.floor("expected"))
        .withColumn("p", F.col("expected") - F.col("sure"))
        #: The ratio x of the odds as x / (1 + x), in (0, 1) and in the same order.
        .withColumn("z", u * (1 - F.col("p")) / (u * (1 - F.col("p")) + (1 - u) * F.col("p")))
        .drop("propensity", "expected", "pull"),
        "mix-ranks",
        rows=n,
    )
    need = F.max("target") - F.sum(F.col("size") * F.col("sure"))
    state = small(staged(ranked.groupBy("sk").agg(need.alias("left")).withColumn("low", F.lit(0.0)), "mix-left", rows=0))
    width = 1.0
    for _ in range(LEVELS):
        state = small(staged(_narrow(ranked, state, width), "mix-left", rows=0))
        width /= SLICES
    return _cut(ranked, state, width, n).select(row_key(F.col("key")).alias("row"), "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("sk")


def _inside(width: float) -> Column:
    return (F.col("p") > 0) & (F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width)


def _narrow(ranked: DataFrame, state: DataFrame, width: float) -> DataFrame:
    """From (sk, left, low): the slice of [low, low + width) in which the words run out, and what is left before it."""
    step = width / SLICES
    slices = F.least(F.floor((F.col("z") - F.col("low")) / step), F.lit(SLICES - 1))
    sums = ranked.join(state, "sk").filter(_inside(width)).groupBy("sk", "left", slices.alias("slice")).agg(F.sum("size").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("sk").orderBy("slice"))
    met = sums.withColumn("before", so_far - F.col("n")).filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
    found = met.groupBy("sk").agg(F.min(F.struct("slice", "before")).alias("m"))
    #: Without such a slice, all of the rest fits: the cut lies above.
    low = F.when(F.col("m").isNotNull(), F.col("low") + F.col("m.slice") * step).otherwise(F.lit(2.0))
    return state.join(found, "sk", "left").select("sk", (F.col("left") - F.coalesce("m.before", F.lit(0))).alias("left"), low.alias("low"))


def _cut(ranked: DataFrame, state: DataFrame, width: float, n: int) -> DataFrame:
    rows = ranked.join(state, "sk")
    #: Few rows: what one of SLICES ** LEVELS slices of a source holds.
    so_far = F.sum("size").over(Window.partitionBy("sk").orderBy("z", "doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = rows.filter(_inside(width)).withColumn("copies", F.col("sure") + (so_far <= F.col("left")).cast("bigint"))
    rest = rows.filter(~_inside(width)).withColumn("copies", F.col("sure") + ((F.col("p") > 0) & (F.col("z") < F.col("low"))).cast("bigint"))
    return _fill(staged(rest.unionByName(edge).drop("left", "low"), "mix-cut", rows=n))


def _fill(rows: DataFrame) -> DataFrame:
    """Add to each source, FILLS times, the largest untaken document that fits in what is left of its target."""
    free = rows.filter((F.col("copies") == F.col("sure")) & (F.col("p") > 0) & (F.col("size") > 0)).select("sk", "doc_id", "key", "size", "z")
    left = small(staged(rows.groupBy("sk").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("left")), "mix-gap", rows=0))
    picked: list[DataFrame] = []
    for _ in range(FILLS):
        near = free.join(left, "sk").filter(F.col("size") <= F.col("left"))
        for one in picked:
            near = near.join(one, _same(near, one), "left_anti")
        best = near.groupBy("sk").agg(F.max(F.struct("size", (-F.col("z")).alias("z"), "doc_id", "key")).alias("b"))
        best = staged(best.select("sk", "b.size", "b.doc_id", "b.key"), "mix-fill", rows=0)
        picked.append(small(best))
        gap = F.col("left") - F.coalesce("size", F.lit(0))
        left = small(staged(left.join(best.select("sk", "size"), "sk", "left").select("sk", gap.alias("left")), "mix-gap", rows=0))
    picks = picked[0]
    for one in picked[1:]:
        picks = picks.unionByName(one)
    picks = small(staged(picks.drop("size").withColumn("hit", F.lit(True)), "mix-picks", rows=0))
    hit = rows.alias("d").join(picks.alias("c"), _same(rows.alias("d"), picks.alias("c"), "d.", "c."), "left").select("d.*", "hit")
    #: Of rows of one id and text, only one is added.
    twin = F.row_number().over(Window.partitionBy("sk", "doc_id", "key").orderBy("copies"))
    added = hit.filter("hit").withColumn("copies", F.col("copies") + ((twin == 1) & (F.col("copies") == F.col("sure"))).cast("bigint"))
    return hit.filter("hit is null").unionByName(added)


def _same(a: DataFrame, b: DataFrame, x: str = "", y: str = "") -> Column:
    left, right = (lambda c: F.col(x + c) if x else a[c]), (lambda c: F.col(y + c) if y else b[c])
    return (left("sk") == right("sk")) & left("doc_id").eqNullSafe(right("doc_id")) & left("key").eqNullSafe(right("key"))
