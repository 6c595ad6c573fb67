"""Benchmark decontamination over a distributed positional inverted index.

`build` splits the documents into shards of bounded size and stores for each shard and term
the positions of the term (as numbers of words within the shard), together with the shard's
documents. `search` orders the terms of each window by their frequency in all shards, sends the
window only to shards that hold its rarest term, and there intersects the lists, each shifted
by the term's offset, from the rarest on. What is left are exact phrases. For proximity, the
terms need only occur in one document within `slack` words more than the window has.

Terms are told apart by 64-bit hashes. The vocabulary to index can be that of the benchmark,
if it has at most VOCABULARY terms; the other terms of the documents are then not stored.

Cases: null and empty texts have no words and no hits; repeated rows are looked up each;
a null doc_id stays null; repeated items are searched for once; items without words match nothing, items with a null item_id mark
words but are not listed; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, streamed
from .textblock import Words, pieces

#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 12 << 20
#: Terms up to which the vocabulary of the searches is sent to the tasks that index.
VOCABULARY = 2_000_000

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_INDEX = "shard string, term bigint, n bigint, list binary, ids binary, nulls binary, sizes binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences of the narrowest width."""
    steps = np.diff(numbers, prepend=0)
    top = int(steps.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + steps.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[0]}", offset=1), dtype=np.int64)


def _index(vocabulary: np.ndarray | None):
    def run(batches):
        sieve = None
        if vocabulary is not None:
            sieve = np.zeros(1 << 22, bool)
            sieve[(vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for whole in batches:
            for b in pieces(whole, "text", SHARD_BYTES):
                yield _shard(b, vocabulary, sieve)

    return run


def _shard(b: pa.RecordBatch, vocabulary: np.ndarray | None, sieve: np.ndarray | None) -> pa.RecordBatch:
    w = Words(b.column(1), _WORD)
    h = w.hashes()
    at = np.arange(len(h))
    if sieve is not None:
        at = np.flatnonzero(sieve[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = at[np.isin(h[at], vocabulary)]
    kept = h[at]
    order = np.argsort(kept, kind="stable")
    kept, at = kept[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]])) if len(kept) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(kept))[: len(edge)]
    ids = b.column(0)
    none = np.asarray(ids.is_null())
    head = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), none.astype(np.uint8).tobytes(), np.diff(w.first).astype("<i4").tobytes()]
    rest = [None] * len(edge)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([uuid.uuid4().hex] * (len(edge) + 1), pa.string()),
            pa.array([None, *kept[edge].view(np.int64).tolist()], pa.int64()),
            pa.array([0, *(ends - edge).tolist()], pa.int64()),
            pa.array([None, *(_packed(at[x:y]) for x, y in zip(edge, ends, strict=True))], pa.binary()),
            *(pa.array([x, *rest], pa.binary()) for x in head),
        ],
        ["shard", "term", "n", "list", "ids", "nulls", "sizes"],
    )


def build(docs: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """The index of docs (doc_id, text): for each shard a row of its documents (null term) and one for each term."""
    known = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY:
        known = np.sort(np.array([x[0] for x in vocabulary.collect()], np.int64).view(np.uint64))
    return staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_index(known), _INDEX), "phrase-index")


def _windows(size: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                w = Words(b.column(1), _WORD)
                h = w.hashes().view(np.int64)
                items, no, terms = [], [], []
                for item, x, y in zip(b.column(0).to_pylist(), w.first[:-1], w.first[1:], strict=True):
                    for k in range(max(y - x - size + 1, min(y - x, 1))):
                        items.append(item)
                        no.append(k)
                        terms.append(h[x + k : min(x + k + size, y)].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(no, pa.int32()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "window", "terms"])

    return run


def windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, window, terms: each `size` words in a row of items (item_id, text), or all words of a shorter one."""
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_windows(size), "item_id bigint, window int, terms array<bigint>")


def search(index: DataFrame, wanted: DataFrame, slack: int | None = None, documents: bool = False) -> DataFrame:
    """Matches of the windows: doc_id, item_id, window, start, kind ('phrase', or 'proximity' if slack is given).

    documents: instead, a row for each document of the index: doc_id, n_words, n_hit, items.
    """
    spelled = wanted.select(F.struct("item_id", "window", "terms").alias("id"), "terms").distinct().select("id", F.posexplode("terms").alias("at", "term"))
    known = index.filter("term is not null").groupBy("term").agg(F.sum("n").alias("f"))
    steps = spelled.join(known, "term", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "at", "term"))).alias("steps"))
    asked = steps.filter(F.col("steps")[0]["f"] > 0).select("id.item_id", "id.window", F.transform("steps", lambda s: s["term"]).alias("terms"), F.transform("steps", lambda s: s["at"]).alias("offsets"))
    asked = staged(asked, "phrase-windows")
    places = index.filter("term is not null").select("shard", "term")
    sent = asked.withColumn("term", F.col("terms")[0]).join(places, "term").select("shard", F.lit(1).alias("kind"), "item_id", "window", "terms", "offsets")
    held = index.select("shard", F.lit(0).alias("kind"), "term", "list", "ids", "nulls", "sizes")
    both = held.unionByName(sent, allowMissingColumns=True)
    schema = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>" if documents else "doc_id bigint, item_id bigint, window int, start bigint, kind string"
    return streamed(both, ["shard"], ["kind"], _look_up(slack, documents), schema)


class _Shard:
    def __init__(self, rows: pa.Table):
        head = rows.filter(pa.compute.and_(pa.compute.equal(rows["kind"], 0), pa.compute.is_valid(rows["ids"])))
        self.none = np.frombuffer(head["nulls"][0].as_py(), np.uint8).astype(bool)
        self.ids = pa.array(np.frombuffer(head["ids"][0].as_py(), "<i8"), pa.int64(), mask=self.none)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(head["sizes"][0].as_py(), "<i4"), dtype=np.int64)])
        lists = rows.filter(pa.compute.is_valid(rows["term"]))
        self.packed = dict(zip(lists["term"].to_pylist(), lists["list"].to_pylist(), strict=True))
        self.open: dict[int, np.ndarray] = {}
        self.asked = rows.filter(pa.compute.equal(rows["kind"], 1)).select(["item_id", "window", "terms", "offsets"]).to_pylist()

    def places(self, term: int) -> np.ndarray:
        if term not in self.open:
            self.open[term] = _unpacked(self.packed[term]) if term in self.packed else np.zeros(0, np.int64)
        return self.open[term]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def phrases(self, terms: list[int], offsets: list[int]) -> np.ndarray:
        """Where the phrase starts, within one document."""
        starts = self.places(terms[0]) - offsets[0]
        for term, k in zip(terms[1:], offsets[1:], strict=True):
            if not len(starts):
                break
            there = self.places(term)
            at = np.searchsorted(there, starts + k)
            starts = starts[(at < len(there)) & (there[np.minimum(at, len(there) - 1)] == starts + k)] if len(there) else starts[:0]
        starts = starts[starts >= 0]
        return starts[self.document(starts) == self.document(starts + len(terms) - 1)]

    def near(self, terms: list[int], reach: int) -> np.ndarray:
        """Places of the rarest term that have every other term within reach, in one document."""
        at = self.places(terms[0])
        doc = self.document(at)
        low, high = np.maximum(at - reach, self.first[doc]), np.minimum(at + reach, self.first[doc + 1] - 1)
        for term in set(terms[1:]):
            there = self.places(term)
            ok = np.searchsorted(there, high, side="right") > np.searchsorted(there, low)
            at, low, high = at[ok], low[ok], high[ok]
        return at


def _look_up(slack: int | None, documents: bool):
    def run(key, batches):
        s = _Shard(pa.Table.from_batches(batches))
        found = [(q, s.phrases(q["terms"], q["offsets"])) for q in s.asked]
        return [_by_document(s, found) if documents else _matches(s, found, slack)]

    return run


def _by_document(s: _Shard, found) -> pa.RecordBatch:
    n = int(s.first[-1])
    edges = np.zeros(n + 1, np.int64)
    items: list[set] = [set() for _ in range(len(s.ids))]
    for q, starts in found:
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + len(q["terms"]), -1)
        if q["item_id"] is not None:
            for d in np.unique(s.document(starts)):
                items[d].add(q["item_id"])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    return pa.RecordBatch.from_arrays([s.ids, pa.array(np.diff(s.first)), pa.array(hit[s.first[1:]] - hit[s.first[:-1]], pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items"])


def _matches(s: _Shard, found, slack: int | None) -> pa.RecordBatch:
    rows = []
    for q, starts in found:
        kinds = [("phrase", starts)]
        if slack is not None:
            near = s.near(q["terms"], len(q["terms"]) + slack)
            kinds.append(("proximity", np.setdiff1d(near, starts + q["offsets"][0])))
        for kind, at in kinds:
            for p, d in zip(at, s.document(at), strict=True):
                rows.append((s.ids[d].as_py(), q["item_id"], q["window"], int(p - s.first[d]), kind))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "window", "start", "kind"])


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows of items), items (whose windows occur), for each row of docs."""
    wanted = staged(windows(items, size), "phrase-wanted")
    index = build(docs, wanted.select(F.explode("terms").alias("term")).distinct())
    return search(index, wanted, documents=True)
