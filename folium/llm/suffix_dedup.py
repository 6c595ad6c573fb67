"""Removal of byte strings that occur twice, with suffix arrays sorted in two stages.

1. Of each window of `length` bytes, the least hash of its `GRAM`-byte grams is a property of its
   content. Neighbouring windows with one least hash are a run, so equal windows lie in runs of
   one hash, and a run whose hash no other place has needs no further look.
2. The bytes of the runs of each hash are brought together, and their suffixes sorted: those smaller than their
   successors directly, the others by scanning the sorted buckets. Neighbours in the suffix
   array with `length` bytes in common are repeats. Of runs that are equal as a whole, two are sorted, which
   stand for all: what one of them repeats, each does.
3. Repeats go back to each place of the run, and to the document, whose covered bytes are dropped.

Cases: null and empty texts have no bytes; texts shorter than `length` are kept whole; equal
rows are copies of each other and lose what they share; rows of one doc_id are told apart by
their text, a null doc_id likewise; an empty table gives an empty result.

The distinct strings around one hash are sorted in one task if they have at most SORT_BYTES bytes; a sort takes memory in
proportion to these. Edits around one passage make more of them, and so does a long periodic text; then
their windows are counted by a digest of their whole content instead,
dealt by that digest, so that no task holds the strings of a hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, staged
from .textblock import flat, mix, pieces

GRAM = 32
#: Bytes of strings that are sorted at once; of a hash with more, windows are counted by digest.
SORT_BYTES = 2 << 20
#: Suffixes whose bytes are copied to be sorted; more are first dealt by eight bytes.
COPIED = 1 << 16
#: Rows of a batch of window digests, and starts of windows gathered in one row.
DIGESTS, STARTS = 20_000, 4096
KEYS = 1_000_000

_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _unaligned(data: np.ndarray) -> np.ndarray:
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def _sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    out, wide = h, 1
    while 2 * wide <= size:
        out = np.minimum(out[:-wide], out[wide:])
        wide *= 2
    return np.minimum(out[: len(h) - size + 1], out[size - wide : size - wide + len(h) - size + 1])


def _runs(length: int):
    grams = length - GRAM + 1

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                data, off = flat(b.column(2))
                if (np.diff(off) >= length).any():
                    yield found(b, data, off)

    def found(b, data, off):
        n = len(data)
        v = _unaligned(np.concatenate([data, np.zeros(8, np.uint8)]))
        h = v[: n - GRAM + 1] * np.uint64(0xFF51AFD7ED558CCD)
        for k, by in ((8, 0xC4CEB9FE1A85EC53), (16, 0x2545F4914F6CDD1D), (24, 0xDA942042E4DD58B5)):
            h = h * np.uint64(_R1) + v[k : k + len(h)] * np.uint64(by)
        h = mix(h)
        least = _sliding_min(h, grams)
        valid = np.zeros(n + 1, np.int8)
        long = np.flatnonzero(np.diff(off) >= length)
        np.add.at(valid, off[long], 1)
        np.add.at(valid, off[long + 1] - length + 1, -1)
        valid = np.cumsum(valid[: len(least)], dtype=np.int8).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | new[1:]
        s, e = np.flatnonzero(new), np.flatnonzero(last)
        value = least[s]
        #: A gram twice in a run: the run may repeat within itself.
        view = np.lib.stride_tricks.sliding_window_view(h, grams)
        one = np.empty(len(s), bool)
        for a in range(0, len(s), 2048):
            z = slice(a, a + 2048)
            left = s[z] + (view[s[z]] == value[z, None]).argmax(1)
            right = e[z] + grams - 1 - (view[e[z]][:, ::-1] == value[z, None]).argmax(1)
            one[z] = left == right
        digests = []
        for r in (_R1, _R2):
            power, back = _powers(r, n + 1), _powers(pow(r, -1, 1 << 64), n + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[: len(h)], dtype=np.uint64)])
            digests.append(mix((sums[e + grams] - sums[s]) * back[s] + np.uint64(1) * (e - s).astype(np.uint64)).view(np.int64))
        doc = np.searchsorted(off, s, side="right") - 1
        take = lambda c: b.column(c).take(pa.array(doc))
        return pa.RecordBatch.from_arrays(
            [take(0), take(1), pa.array(value.view(np.int64)), pa.array(digests[0]), pa.array(digests[1]), pa.array((s - off[doc]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(~one)],
            ["doc", "key", "hash", "d1", "d2", "start", "more", "self"],
        )

    return run


def _cut(length: int):
    """The bytes of the runs listed beside each text."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text", 2 << 20):
                rows = {c: [] for c in ("hash", "d1", "d2", "windows", "many", "bytes")}
                for text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    for r in runs:
                        for c in ("hash", "d1", "d2"):
                            rows[c].append(r[c])
                        rows["many"].append(r["many"])
                        rows["windows"].append(r["more"] + 1)
                        rows["bytes"].append(raw[r["start"] : r["start"] + r["more"] + length])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    return run


def _by_bytes(raw: bytes, eights: np.ndarray, group: np.ndarray, ends: np.ndarray, depth: int, k: int = 0) -> np.ndarray:
    """The positions of the group, which have k bytes in common, by their next bytes up to `depth` or their string's end."""
    if len(group) <= COPIED or k >= depth:
        where, stops = (group + k).tolist(), np.maximum(np.minimum(group + depth, ends[group]), group + k).tolist()
        keys = [raw[i:j] for i, j in zip(where, stops, strict=True)]
        return group[sorted(range(len(where)), key=keys.__getitem__)]
    rest = np.minimum(ends[group] - group - k, 8)
    over = (8 * (8 - rest)).astype(np.uint64)
    word = eights[group + k].astype(np.uint64) >> np.minimum(over, np.uint64(63))
    word = np.where(rest > 0, word << np.minimum(over, np.uint64(63)), np.uint64(0))
    order = np.lexsort((rest, word))
    group, word, rest = group[order], word[order], rest[order]
    cuts = np.flatnonzero((word[1:] != word[:-1]) | (rest[1:] != rest[:-1])) + 1
    parts = np.split(group, cuts)
    done = rest[np.concatenate([[0], cuts])] < 8
    return np.concatenate([p if d or len(p) == 1 else _by_bytes(raw, eights, p, ends, depth, k + 8) for p, d in zip(parts, done, strict=True)])


def suffix_order(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions in order of their suffixes (up to their string's end, at least to `depth` bytes).

    text: the strings, one after another; ends: for each position, where its string ends. Only suffixes
    smaller than the one after them are sorted; the others are placed by scans over the sorted buckets.
    """
    n = len(text)
    at = np.arange(n)
    final = at + 1 == ends
    differs = np.ones(n, bool)
    differs[:-1] = (text[:-1] != text[1:]) | final[:-1]
    stop = np.where(differs, at, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    after = np.append(text[1:], 0)
    #: At a string's end comes less than any byte.
    smaller = ~final[stop] & (text[stop] < after[stop])
    #: The larger suffixes need those after them, up to a smaller one or the end.
    need = wanted.copy()
    bound = np.where(smaller | final, at, n)
    bound = np.minimum.accumulate(bound[::-1])[::-1]
    open_ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~smaller)
    for i in open_ends:
        need[i : bound[i] + 1] = True
    direct = np.flatnonzero(need & smaller)
    lead = text[direct].astype(np.int32) * 256 + after[direct]
    direct = direct[np.argsort(lead, kind="stable")]
    cuts = np.flatnonzero(np.diff(np.sort(lead))) + 1
    raw = text.tobytes()
    eights = np.ndarray(shape=(n,), dtype=">u8", buffer=raw + bytes(8), strides=(1,))
    by_first: dict[int, list[np.ndarray]] = {}
    for group in np.split(direct, cuts):
        if len(group):
            by_first.setdefault(raw[group[0]], []).append(_by_bytes(raw, eights, group, ends, depth))
    larger = need & ~smaller
    front: dict[int, list[np.ndarray]] = {}

    def induce(order: np.ndarray, above: int) -> None:
        before = order[order > 0] - 1
        before = before[larger[before] & ~final[before] & (text[before] > above)]
        before = before[np.argsort(text[before], kind="stable")]
        for part in np.split(before, np.flatnonzero(np.diff(text[before])) + 1):
            if len(part):
                front.setdefault(int(text[part[0]]), []).append(part)

    lasts = np.flatnonzero(larger & final)
    lasts = lasts[np.argsort(text[lasts], kind="stable")]
    for part in np.split(lasts, np.flatnonzero(np.diff(text[lasts])) + 1):
        if len(part):
            front.setdefault(int(text[part[0]]), []).append(part)
    out = []
    for c in range(256):
        parts = list(front.pop(c, []))
        new = np.concatenate(parts) if parts else at[:0]
        while len(new):
            before = new[new > 0] - 1
            new = before[larger[before] & ~final[before] & (text[before] == c)]
            parts.append(new)
        parts += by_first.get(c, [])
        if parts:
            bucket = np.concatenate(parts)
            out.append(bucket)
            induce(bucket, c)
    order = np.concatenate(out) if out else at[:0]
    return order[wanted[order]]


def repeated(strings: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each string, which of its first counts[i] windows of `length` bytes also start at another place in the strings."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    ends = np.repeat(first[1:], np.diff(first))
    wanted = np.zeros(len(text), bool)
    for a, k in zip(first[:-1], counts, strict=True):
        wanted[a : a + k] = True
    order = suffix_order(text, ends, wanted, length)
    x, y = order[:-1], order[1:]
    v = _unaligned(np.concatenate([text, np.zeros(8, np.uint8)]))
    pair = np.arange(len(x))
    #: Neighbours' common prefix reaches `length` if no eight bytes of it differ.
    for k in [length - 8, *range(0, length - 8, 8)]:
        pair = pair[v[x[pair] + k] == v[y[pair] + k]]
    hit = np.zeros(len(text), bool)
    hit[x[pair]] = True
    hit[y[pair]] = True
    return [hit[a : a + k] for a, k in zip(first[:-1], counts, strict=True)]


def _digests(length: int):
    """A row for each window of the strings: hash, d1, d2, at, and 128 bits of its content."""

    def out(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["hash", "d1", "d2", "at", "digest"])

    def run(batches):
        rows = []
        for b in batches:
            for r in b.to_pylist():
                raw = r["bytes"]
                for k in range(r["windows"]):
                    rows.append((r["hash"], r["d1"], r["d2"], k, hashlib.blake2b(raw[k : k + length], digest_size=16).digest()))
                    if len(rows) == DIGESTS:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return run


def _counted(cut: DataFrame, length: int) -> DataFrame:
    """hash, d1, d2, spans as of _sorted_strings (a string may have several rows), for strings of any number around one hash."""
    windows = cut.select("hash", "d1", "d2", "windows", "bytes").mapInArrow(_digests(length), "hash bigint, d1 bigint, d2 bigint, at int, digest binary")
    twice = staged(windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "dedup-digests")
    starts = windows.join(small(twice, KEYS), "digest", "left_semi").groupBy("hash", "d1", "d2", F.floor(F.col("at") / STARTS)).agg(F.sort_array(F.collect_list("at")).alias("p"))
    edge = lambda step: F.filter("p", lambda x, i: F.coalesce(F.get("p", i + step) != x + step, F.lit(True)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = cut.filter("many").select("hash", "d1", "d2", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))).alias("spans"))
    return starts.select("hash", "d1", "d2", spans.alias("spans")).unionByName(whole)


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_strings(length: int):
    """Over a stream sorted by hash: the repeated windows of each string."""

    def out(rows):
        twice = [r for r in rows for _ in range(1 + r["many"])]
        hits = repeated([r["bytes"] for r in twice], [r["windows"] for r in twice], length)
        first = np.concatenate([[0], np.cumsum([1 + r["many"] for r in rows])])
        spans = [_spans(hits[i]) for i in first[:-1]]
        keep = [i for i, s in enumerate(spans) if s]
        longs = [pa.array([rows[i][c] for i in keep], pa.int64()) for c in ("hash", "d1", "d2")]
        return pa.RecordBatch.from_arrays([*longs, pa.array([spans[i] for i in keep], _SPANS)], ["hash", "d1", "d2", "spans"])

    def run(batches):
        #: group: the strings of the hash at hand; rows: those of hashes before it.
        rows, size, group, more = [], 0, [], 0
        for b in batches:
            for r in b.to_pylist():
                if group and r["hash"] != group[0]["hash"]:
                    rows, size, group, more = rows + group, size + more, [], 0
                group.append(r)
                more += len(r["bytes"])
                if rows and size + more > SORT_BYTES:
                    yield out(rows)
                    rows, size = [], 0
        if rows + group:
            yield out(rows + group)

    return run


def _drop(length: int):
    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text", 4 << 20):
                n, removed, spans, digest = [], [], [], []
                for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = text.encode()
                    kept, at, gone, runs = hashlib.sha256(), 0, 0, 0
                    for s in sorted(found, key=lambda s: s["a"]):
                        a, z = s["a"], s["b"] + length
                        runs += a > at or not runs
                        kept.update(raw[at:a])
                        gone += max(0, z - max(a, at))
                        at = max(at, z)
                    kept.update(raw[at:])
                    n.append(len(raw))
                    removed.append(gone)
                    spans.append(runs)
                    digest.append(kept.hexdigest())
                longs = [pa.array(x, pa.int64()) for x in (n, removed, spans)]
                yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(digest)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _keys() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key")]


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc, key, spans (a, b: first and last start of repeated windows) of the documents that have some."""
    keyed = docs.select(*_keys(), "text").filter(F.octet_length("text") >= length)
    runs = staged(keyed.mapInArrow(_runs(length), "doc bigint, key bigint, hash bigint, d1 bigint, d2 bigint, start int, more int, self boolean"), "dedup-runs")
    strings = runs.groupBy("hash", "d1", "d2").agg(F.count("*").alias("k"), F.max("self").alias("self"), F.min(F.struct("doc", "key", "start", "more")).alias("at"))
    strings = staged(strings, "dedup-strings")
    size = F.sum(F.col("at.more").cast("bigint") + length)
    doubtful = strings.groupBy("hash").agg(F.sum("k").alias("m"), F.max("self").alias("s"), (size > SORT_BYTES).alias("large")).filter("m > 1 or s").select("hash", "large")
    compared = strings.join(doubtful, "hash").select("at.doc", "at.key", "large", F.struct("hash", "d1", "d2", "at.start", "at.more", (F.col("k") > 1).alias("many")).alias("r"))
    listed = staged(compared.groupBy("large", "doc", "key").agg(F.collect_list("r").alias("runs")), "dedup-listed")

    def cut(runs: DataFrame) -> DataFrame:
        texts = keyed.join(small(runs.select("doc", "key"), KEYS), ["doc", "key"], "left_semi").dropDuplicates(["doc", "key"])
        return texts.join(runs, ["doc", "key"]).select("text", "runs").mapInArrow(_cut(length), "hash bigint, d1 bigint, d2 bigint, windows int, many boolean, bytes binary")

    found = cut(listed.filter("not large")).repartition("hash").sortWithinPartitions("hash").mapInArrow(_sorted_strings(length), "hash bigint, d1 bigint, d2 bigint, spans array<struct<a:int,b:int>>")
    large = listed.filter("large")
    if not large.isEmpty():
        found = found.unionByName(_counted(staged(cut(large), "dedup-large"), length))
    hits = staged(found, "dedup-hits")
    placed = runs.join(hits, ["hash", "d1", "d2"]).select("doc", "key", "start", F.explode("spans").alias("s"))
    spans = placed.select("doc", "key", F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b")).alias("s"))
    return staged(spans.groupBy("doc", "key").agg(F.collect_set("s").alias("spans")), "dedup-spans")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(texts, length)
    keyed = texts.select("doc_id", *_keys(), "text")
    keys = small(spans.select("doc", "key"), KEYS)
    whole = keyed.join(keys, ["doc", "key"], "left_anti").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    part = keyed.join(keys, ["doc", "key"], "left_semi").join(spans, ["doc", "key"]).select("doc_id", "text", "spans")
    return whole.unionByName(part.mapInArrow(_drop(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
