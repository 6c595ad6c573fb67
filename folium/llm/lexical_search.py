"""Ranked search for the terms of items in all documents, by a hybrid of term-at-a-time and document-at-a-time.

`build` splits the documents into shards of bounded size and writes a row for each: its documents' ids and lengths, its terms, and for
each term the documents (by number within the shard) with the term's occurrences. The corpus's counts of documents,
terms and documents of a term are sums over those rows. `search` reads each row once for a block of items; for each item
the lists of its rarer terms, as long as together they have no more entries than a part of the shard's documents
(SHORT), are summed term by term into accumulators. The accumulators are then one more sorted iterator with a bound,
their highest sum, beside the long lists with theirs. Documents are looked at in order: those of
the iterators without which the score to beat can't be reached, in runs of RANGE documents; the other iterators are only looked up
by skipping to the candidates left, from the highest bound on, until bounds rule the candidates out.

The score to beat starts at what an item's k-th document has in one of SEED parts of the shards, searched first: few
rows then leave the other shards, however many there are. Scores are integers, so sums don't depend on their order.

Terms are told apart by 64-bit hashes. Items go to the tasks in blocks of BLOCK_TERMS terms; the index holds the terms
of the items only if these are at most VOCABULARY, else all.

Cases: null and empty texts have no terms, are in no result and not counted in N; repeated rows of documents are ranked each;
a null doc_id comes last among equal scores; equal rows of items are searched for once, rows with one item_id and other texts
each; an item without terms, or whose terms nobody has, has no rows; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .textblock import Words, pieces

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 12 << 20
#: Terms up to which the vocabulary of the items is sent to the tasks that index.
VOCABULARY = 2_000_000
#: Terms of items, repeats included, that are sent to the tasks at once.
BLOCK_TERMS = 500_000
#: Short lists have together at most the shard's documents divided by this many entries.
SHORT = 4
#: Documents that are looked at together.
RANGE = 2048
#: One of so many parts of the shards is searched first, where there are at least as many shards.
SEED = 32

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_INDEX = "shard bigint, n_docs bigint, n_terms bigint, ids array<bigint>, sizes array<int>, terms array<bigint>, dfs array<int>, docs binary, tfs binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers in the narrowest width, which comes first."""
    kind = np.min_scalar_type(int(numbers.max(initial=0)))
    return bytes([kind.itemsize]) + numbers.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _index(vocabulary: np.ndarray | None):
    def run(batches):
        sieve = None
        if vocabulary is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        shard = TaskContext.get().partitionId() << 24
        for whole in batches:
            for b in pieces(whole, "text", SHARD_BYTES):
                yield _shard(b, shard, vocabulary, sieve)
                shard += 1

    return run


def _shard(b: pa.RecordBatch, shard: int, vocabulary: np.ndarray | None, sieve: np.ndarray | None) -> pa.RecordBatch:
    w = Words(b.column(1), _WORD)
    h = w.hashes()
    sizes = np.diff(w.first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if sieve is not None:
        at = np.flatnonzero(sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = at[np.isin(h[at], vocabulary)]
        h, doc = h[at], doc[at]
    h = h.view(np.int64)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(h)))
    h, doc = h[first], doc[first]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    one = [
        [shard], [int((sizes > 0).sum())], [int(sizes.sum())], [b.column(0).to_pylist()], [sizes],
        [h[edge]], [np.diff(np.append(edge, len(h)))], [_packed(doc)], [_packed(tf)],
    ]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(one, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def build(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The index of docs (doc_id, text), a row for each shard; of the terms in vocabulary (term) only, if these are few enough."""
    known = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY:
        known = np.sort(np.array([x[0] for x in vocabulary.collect()], np.int64).view(np.uint64))
    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_index(known), _INDEX), "lexical-index", "zstd")


def _terms(batches):
    for whole in batches:
        for b in pieces(whole, "text"):
            w = Words(b.column(2), _WORD)
            sizes = np.diff(w.first)
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(w.hashes().view(np.int64))], ["item", "item_id", "term"])


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for its row), item_id, term, n: each distinct term of a row of items (item_id, text), with its repeats."""
    own = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return own.mapInArrow(_terms, "item bigint, item_id bigint, term bigint").groupBy("item", "item_id", "term").agg(F.count("*").alias("n"))


class _Lists:
    """The lists of one shard, with what each entry adds to a score for one unit of a term's weight."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["ids"]
        self.size = len(self.ids)
        self.terms = {t: k for k, t in enumerate(row["terms"])}
        self.edges = np.concatenate([[0], np.cumsum(np.array(row["dfs"], np.int64))])
        self.docs, tf = _unpacked(row["docs"]), _unpacked(row["tfs"])
        length = 100 - 25 + (25 * np.array(row["sizes"], np.int64) * n) // max(total, 1)
        self.adds = (1_000_000_000 * tf) // (1000 * tf + 12 * length[self.docs])
        # among equal scores: the smaller id first, then those without
        ranks = np.empty(self.size, np.int64)
        ranks[sorted(range(self.size), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))] = np.arange(self.size)
        self.ranks = ranks

    def of(self, terms: list[int], weights: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [(self.terms[t], w) for t, w in zip(terms, weights, strict=True) if t in self.terms and w > 0]
        return [(self.docs[self.edges[k] : self.edges[k + 1]], w * self.adds[self.edges[k] : self.edges[k + 1]]) for k, w in found]


def accumulated(short: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: the documents of all lists, ascending, with their sums."""
    docs, place = np.unique(np.concatenate([d for d, _ in short]), return_inverse=True)
    sums = np.zeros(len(docs), np.int64)
    np.add.at(sums, place, np.concatenate([s for _, s in short]))
    return docs, sums


def best(lists: list[tuple[np.ndarray, np.ndarray]], size: int, ranks: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest sums of at least `least` over lists of (documents ascending, scores above 0), equal ones by rank: documents and sums."""
    short, rest, entries = [], [], 0
    for docs, scores in sorted(lists, key=lambda x: len(x[0])):
        entries += len(docs)
        (short if entries <= size // SHORT else rest).append((docs, scores))
    if short:
        rest.append(accumulated(short))
    iterators = sorted(((int(s.max()), d, s) for d, s in rest), key=lambda x: x[0])
    bounds = np.cumsum([0, *(x[0] for x in iterators)])
    top, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, size, RANGE):
        needed = int(np.searchsorted(bounds[1:], least))  # the iterators below this one can't reach `least` together
        if needed == len(iterators):
            break
        run = np.zeros(min(RANGE, size - start), np.int64)
        for _, docs, scores in iterators[needed:]:
            x, y = np.searchsorted(docs, [start, start + RANGE])
            run[docs[x:y] - start] += scores[x:y]
        at = np.flatnonzero((run > 0) & (run + bounds[needed] >= least))
        got, at = run[at], at + start
        for j in range(needed - 1, -1, -1):
            if not len(at):
                break
            _, docs, scores = iterators[j]
            there = np.searchsorted(docs, at)
            hit = docs[np.minimum(there, len(docs) - 1)] == at
            got[hit] += scores[there[hit]]
            on = got + bounds[j] >= least
            at, got = at[on], got[on]
        if len(at):
            top, sums = np.concatenate([top, at]), np.concatenate([sums, got])
            first = np.lexsort((ranks[top], -sums))[:k]
            top, sums = top[first], sums[first]
            if len(top) == k:
                least = max(least, int(sums[-1]))
    return top, sums


_FOUND = "item bigint, doc_id bigint, score bigint"


def _look_up(asked, n: int, total: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Lists(batch.slice(i, 1).to_pylist()[0], n, total)
                items, ids, scores = [], [], []
                for item, terms, weights, least in asked.value:
                    top, sums = best(shard.of(terms, weights), shard.size, shard.ranks, k, max(least, 1))
                    items += [item] * len(top)
                    ids += [shard.ids[d] for d in top]
                    scores += sums.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 20, seed: int = SEED) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of the index for each row of items (item_id, text).

    items may also be the staged result of item_terms.
    """
    spark = index.sparkSession
    asked = items if "term" in items.columns else staged(item_terms(items), "lexical-items")
    n, total, shards = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not total:
        return empty
    known = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighed = asked.join(known, "term").withColumn("weight", F.col("n") * weight)
    blocks = asked.count() // BLOCK_TERMS + 1
    by_item = staged(weighed.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")).withColumn("block", F.pmod("item", F.lit(blocks))), "lexical-asked")
    parts = []
    for block in range(blocks):
        own = [(x["item"], x["terms"], x["weights"]) for x in by_item.filter(F.col("block") == block).collect()]
        least: dict[int, int] = {}
        if shards >= seed > 1:
            part = index.filter(F.pmod(F.xxhash64("shard"), F.lit(seed)) == 0)
            sent = spark.sparkContext.broadcast([(*x, 0) for x in own])
            least = {x["item"]: x["score"] for x in _ranked(part.mapInArrow(_look_up(sent, n, total, k), _FOUND), k).filter(F.col("rank") == k).collect()}
        sent = spark.sparkContext.broadcast([(*x, least.get(x[0], 0)) for x in own])
        parts.append(index.mapInArrow(_look_up(sent, n, total, k), _FOUND))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    names = asked.select("item", "item_id").distinct()
    return _ranked(found, k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """search() over an index made of docs for the terms of these items."""
    asked = staged(item_terms(items), "lexical-items")
    return search(build(docs, asked.select("term").distinct()), asked, k)
