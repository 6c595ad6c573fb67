"""Jaccard join of documents on word n-grams, with count vectors in an R-tree.

1. Hash the shingles of a set into groups. Linked sets of a and b shingles differ in at most
   15 (a + b) / 185 of them, so of one group more than that, at least one has the same content
   in both. There are more groups than that, so linked sets share as many more. Each set is filed
   under the content of its groups, but for the ones that most sets have, as many as may be passed
   over with one shared group left; sets that are filed under one content form a family. Families
   thus hold every link, and few sets that merely share passages.
2. In a family, the number of shingles in each group is a point. The points are packed into an
   R-tree; the sum of coordinate minima bounds the overlap, of a point with a node's upper
   corner or with another point, and whatever cannot reach the overlap needed is left.
3. Surviving pairs are verified on the whole sets, unless both are known to be connected.

Large families are cut by size into leaves of bounded size; pairs of leaves whose sizes
permit links go to tasks of their own. Equal sets are one node from the start.

Cases: null and empty texts have an empty set and no links; repeated rows and rows of one
doc_id are one node; a null doc_id takes no part and is its own class (null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, staged, streamed
from .graph import components
from .textblock import Words, mix, pieces, windows

#: Sets of a family that one task holds, and shingles of these.
LEAF_SETS = 4096
LEAF_SHINGLES = 4_000_000
#: Rows of ids up to which a table is sent to every task.
SENT = 2_000_000
#: Entries of an R-tree node.
FAN = 32


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted hashes."""
    w = Words(texts)
    h = w.hashes()
    all_windows = windows(h, words)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= words:
            yield np.unique(all_windows[a : b - words + 1])
        else:
            yield windows(h[a:b], b - a) if b > a else h[:0]


class Threshold:
    """Sets link if 100 * overlap >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, total: np.ndarray | int):
        """The least overlap of linked sets that have `total` elements together."""
        return -(-self.percent * total // (100 + self.percent))

    def largest(self, n: int) -> int:
        """The largest set that one of n elements can link with."""
        return 100 * n // self.percent

    def classes(self, top: int) -> np.ndarray:
        """Bounds of size classes; a set links only within its class and the next to it."""
        out = [1]
        while out[-1] <= top:
            out.append(max(out[-1] + 1, self.largest(out[-1] - 1) + 1))
        out.append(max(out[-1] + 1, self.largest(out[-1] - 1) + 1))
        return np.array(out)

    def differing(self, bounds: np.ndarray, j: int) -> int:
        """The most elements in which linked sets differ, the smaller of them in class j."""
        a = int(bounds[j + 1]) - 1
        return (100 - self.percent) * (a + self.largest(a)) // (100 + self.percent)


def _filings(u: np.ndarray, bounds: np.ndarray, limit: Threshold) -> list[tuple[np.ndarray, int]]:
    """What the set u can be filed under as the smaller and as the larger of two linked sets (the last bits differ), and how many of each may be passed over."""
    own = int(np.searchsorted(bounds, len(u), side="right")) - 1
    out = []
    m = mix(u ^ np.uint64(0x5851F42D4C957F2D))
    for j in (own, own - 1):
        if j < 0:
            continue
        #: Groups in which linked sets may differ. They share one more than are spare; some of these stay empty, some hold what many sets have.
        k = limit.differing(bounds, j)
        spare = k // 12 + (k > 0) + (k + 1) // 2
        groups = k + 1 + spare
        g = (u >> np.uint64(20)) % np.uint64(groups)
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_g[1:] != sorted_g[:-1]]))
        total = np.add.reduceat(m[order], edge)
        size = np.diff(np.append(edge, len(u))).astype(np.uint64)
        tag = np.uint64(j) << np.uint64(32)
        sigs = mix(total + mix((sorted_g[edge] | tag) + (size << np.uint64(48))))
        #: Empty groups count as those that most sets have.
        if len(edge) <= k:
            sigs = np.concatenate([sigs, mix(mix(np.setdiff1d(np.arange(groups, dtype=np.uint64), sorted_g[edge]) | tag) + np.uint64(1))])
        out.append(((sigs & ~np.uint64(1)) | np.uint64(j & 1), max(len(edge) - k - 1, 0)))
    return out


def links_within(ids: list[int], sets: list[np.ndarray], limit: Threshold, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets: a spanning forest. side: only sets of different sides are compared."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sets, ids = [sets[i] for i in order], [ids[i] for i in order]
    size = np.array([len(s) for s in sets])
    if side is not None:
        side = side[order]
    wide = int(min(256, max(16, 1 << int(np.ceil(np.log2(max(size.mean() / 2, 1)))))))
    points = np.zeros((len(sets), wide), np.uint32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s & np.uint64(wide - 1)).astype(np.int64), minlength=wide)
    tree = Tree(points, size)
    label = np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        near = tree.search(i, limit)
        if side is not None:
            near = near[side[near] != side[i]]
        while len(near := near[label[near] != label[i]]):
            j, near = near[0], near[1:]
            if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= limit.overlap(size[i] + size[j]):
                out.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return out


class Tree:
    """An R-tree over points that are sorted by size; packed bottom up, so that a node holds points of about one size."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        self.points, self.size = points, size
        self.levels = []
        top, low = points, size
        while len(top) > FAN:
            cut = np.arange(0, len(top), FAN)
            top, low = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut)
            self.levels.append((top, low))

    def _pass(self, i: int, corners: np.ndarray, low: np.ndarray, limit: Threshold) -> np.ndarray:
        bound = np.minimum(corners, self.points[i]).sum(1, dtype=np.int64)
        return (bound >= limit.overlap(self.size[i] + np.maximum(low, self.size[i]))) & (low <= limit.largest(int(self.size[i])))

    def search(self, i: int, limit: Threshold) -> np.ndarray:
        """Points after i that may link with it."""
        alive = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            alive = alive[(alive + 1) * FAN ** (depth + 1) > i + 1]
            alive = alive[self._pass(i, top[alive], low[alive], limit)]
            below = self.levels[depth - 1][0] if depth else self.points
            alive = (alive[:, None] * FAN + np.arange(FAN)).ravel()
            alive = alive[alive < len(below)]
        alive = alive[alive > i]
        return alive[self._pass(i, self.points[alive], self.size[alive], limit)]


def _heads(words: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                n, d1, d2 = [], [], []
                for u in shingle_sets(b.column(1), words):
                    n.append(len(u))
                    d1.append(np.bitwise_xor.reduce(mix(u)) if len(u) else 0)
                    d2.append(np.add.reduce(mix(u ^ np.uint64(0xD6E8FEB86659FD93))) if len(u) else 0)
                as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), as_long(d1), as_long(d2)], ["doc_id", "n", "d1", "d2"])

    return run


def _file(words: int, limit: Threshold):
    def run(batches):
        bounds = limit.classes(1 << 10)
        for whole in batches:
            for b in pieces(whole, "text"):
                ids, sigs = [], []
                for doc, u in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), words), strict=True):
                    if len(u) and doc is not None:
                        if len(u) >= bounds[-3]:
                            bounds = limit.classes(2 * len(u))
                        for own, over in _filings(u, bounds, limit):
                            sigs.append(own)
                            ids.append((doc, over, len(own)))
                if ids:
                    docs, over, times = (np.array(x) for x in zip(*ids, strict=True))
                    columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(docs, times), pa.int64()), pa.array(np.repeat(over, times), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["sig", "doc_id", "over"])

    return run


def _verify(words: int, limit: Threshold):
    def run(key, batches):
        block = pa.Table.from_batches(batches).combine_chunks()
        ids, leaf = block["doc_id"].to_pylist(), block["leaf"].to_numpy()
        sets: list[np.ndarray] = []
        for part in block.to_batches():
            for piece in pieces(part, "text"):
                sets += list(shingle_sets(piece.column(piece.schema.get_field_index("text")), words))
        found = links_within(ids, sets, limit, leaf if key[1] != key[2] else None)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def jaccard_join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text): links at percent or more, classes by reach."""
    limit = Threshold(percent)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    heads = staged(texts.mapInArrow(_heads(words), "doc_id bigint, n bigint, d1 bigint, d2 bigint"), "join-heads")
    nodes = heads.filter("n > 0 and doc_id is not null")
    n = heads.count()
    #: Sets that are equal: the smallest doc_id stands for them.
    rep = staged(nodes.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "join-reps", rows=n)
    twins = nodes.join(rep.filter("rep <> last"), ["n", "d1", "d2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    twins = staged(twins, "join-twins", rows=n)
    #: Copies are not filed where the list of sets can be sent to every task.
    firsts = rep.select(F.col("rep").alias("doc_id"))
    sets = texts.join(F.broadcast(firsts), "doc_id", "left_semi") if firsts.count() <= SENT else texts
    filed = sets.mapInArrow(_file(words, limit), "sig bigint, doc_id bigint, over int")
    one = Window.partitionBy("sig")
    shared = filed.withColumn("m", F.count("*").over(one)).filter("m > 1")
    #: Of what is shared, what most sets have is passed over. Rows of one doc_id are ranked together, which passes over fewer.
    common = Window.partitionBy("doc_id", F.col("sig").bitwiseAND(F.lit(1).cast("bigint"))).orderBy(F.desc("m"), F.desc("sig"))
    kept = shared.withColumn("rank", F.row_number().over(common)).filter("rank > over").select("sig", "doc_id")
    pivot = F.first("doc_id").over(one.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = kept.withColumn("pivot", pivot).filter("pivot <> doc_id").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
    near = staged(near, "join-near", rows=n)
    family = components(near.unionByName(twins)).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    members = family.join(rep.select(F.col("rep").alias("doc_id"), "n"), "doc_id")
    by_size = Window.partitionBy("family").orderBy("n", "doc_id")
    so_far = by_size.rowsBetween(Window.unboundedPreceding, -1)
    leaf = F.floor(F.greatest((F.row_number().over(by_size) - 1) / LEAF_SETS, F.coalesce(F.sum("n").over(so_far), F.lit(0)) / LEAF_SHINGLES))
    placed = staged(members.withColumn("leaf", leaf), "join-leaves", rows=n)
    leaves = placed.groupBy("family", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("k"))
    x, y = leaves.alias("x"), leaves.alias("y")
    meet = (F.col("x.family") == F.col("y.family")) & (F.col("x.leaf") <= F.col("y.leaf")) & (percent * F.col("y.low") <= 100 * F.col("x.high")) & ((F.col("x.leaf") < F.col("y.leaf")) | (F.col("x.k") > 1))
    blocks = x.join(y, meet).select("x.family", F.col("x.leaf").alias("i"), F.col("y.leaf").alias("j"))
    sides = blocks.withColumn("leaf", F.explode(F.array_distinct(F.array("i", "j"))))
    jobs = small(staged(placed.join(sides, ["family", "leaf"]).select("doc_id", "family", "i", "j", "leaf"), "join-jobs", rows=n), SENT)
    #: Of rows with one doc_id, the sets of all are compared, each as this doc_id.
    work = texts.join(jobs, "doc_id").select("family", "i", "j", "leaf", "doc_id", "text")
    links = streamed(work, ["family", "i", "j"], [], _verify(words, limit), "a bigint, b bigint")
    links = staged(links, "join-links", rows=n).unionByName(twins)
    found = components(links)
    out = heads.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
