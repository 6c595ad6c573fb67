"""Alignment of the tokens that two tokenizers make of the same texts.

Tokenizer A is a byte-level BPE (a file of the `tokenizers` library), B a sentencepiece model that adds a space in
front. For each text the cumulative byte ends of both sequences become dictionaries from end to index (tables addressed by the end, as
ends are small numbers); the intersection of their keys, in order, slices both lists of ids into groups, and the links of
a slice (pairs of tokens whose byte ranges overlap) are expanded within it.

Neither tokenizer has a token that goes on over a space which follows a character that is not white space, so both end a token
there, and what lies between two such places is aligned once per shard (`Tokenizers.cut`; where the files don't have that property,
whole texts take the place of these chunks). Links are counted over the corpus as pairs of ids: a task counts the
pairs of its shard, Spark sums the shards' counts, finds the highest of each B id, and hands each shard the
counts of its own pairs. Nothing is broadcast but the two vocabulary files and the highest count of each B id, which
the size of the vocabulary bounds. A shard is 12 MB of text, or one longer text.

Cases: texts that are null, empty, or that a tokenizer does not give back byte for byte have no tokens: zeros, and an
empty `groups_sha256`; repeated rows are aligned and counted each; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, streamed
from .textblock import pieces

FILES = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD_BYTES = 12 << 20

#: A chunk ends where a space follows a character that is not white space; white space at the end of a text stays with the last one.
_CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+")
#: White space but a space, with a space behind it; spaces at the ends; two in a row: such texts are cut by _CHUNK, others at each space.
_ODD = "^ | $|  |[\\t-\\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "
#: Characters whose classes no two Unicode versions tell apart: chunks of these, with no white space at the end, are encoded by the faster library.
_PLAIN = re.compile("(?:[\\t\\n\\r\x20-\x7e\u00a1-\u024f\u0400-\u04ff]*[\x21-\x7e\u00a1-\u024f\u0400-\u04ff])")
#: Fixed value: the published pattern that byte-level vocabularies split words by.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"
_B_BITS = 32


def dictionary(ends: np.ndarray, size: int) -> np.ndarray:
    """From each byte end to one more than the index of its token, 0 where none ends."""
    at = np.zeros(size + 1, np.int64)
    at[ends] = np.arange(1, len(ends) + 1)
    return at


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end in the one list of ids and in the other; both lists cover the same bytes without gaps."""
    size = int(ends_a[-1]) if len(ends_a) else 0
    at_a, at_b = dictionary(ends_a, size), dictionary(ends_b, size)
    common = np.flatnonzero((at_a > 0) & (at_b > 0))
    return at_a[common], at_b[common]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A and B whose byte ranges overlap, in order: one pair for each end of either list."""
    size = int(ends_a[-1]) if len(ends_a) else 0
    before_a, before_b = (np.cumsum(dictionary(e, size) > 0) for e in (ends_a, ends_b))
    ends = np.flatnonzero(np.diff(before_a + before_b, prepend=0))
    return before_a[ends - 1], before_b[ends - 1]


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        byte = _byte_of()
        self.bytes_a = {i: bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode() for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.sizes_a[i] = len(x)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ids = range(max(len(self.sizes_a), len(self.sizes_b)))
        #: Ids in decimal with what follows: a comma within a group's ids, a bar after those of A, a semicolon after those of B.
        self.told = [f"{i}{end}" for end in ",|;" for i in ids]
        self.told_sizes = np.array([len(x) for x in self.told], np.int64)
        spec, model = json.loads(byte_bpe), sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(piece_bpe)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not model.normalizer_spec.precompiled_charsmap and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.add_dummy_prefix
            and not any(_SPACE in p.piece.lstrip(_SPACE) for p in model.pieces)
        )
        self.fast = self._merges_by_id(spec["model"]) if self.chunked else None

    def _merges_by_id(self, model: dict):
        """The same vocabulary in the faster tiktoken, if merges come in the order of the ids that they make; else none."""
        if any(model.get(k) for k in ("dropout", "ignore_merges", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        if made != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks={self.bytes_a[i]: i for i in model["vocab"].values() if i < 256 + len(made)}, special_tokens={})

    @staticmethod
    def _piece(piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace(_SPACE, " ").encode()

    def cut(self, text: str) -> list[str]:
        """Chunks of the text at whose ends both tokenizers end a token; a space stands before each, the first one's is added."""
        if not self.chunked:
            return [text]
        return [c[1:] for c in _CHUNK.findall(f" {text}")]

    def cut_all(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of all texts, the code of each chunk in order, and where each text's begin (and the last ends); null and empty texts have none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD) if self.chunked else pa.array([True] * len(texts), pa.bool_())
        odd = pc.or_(odd, pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        rest = pa.array([self.cut(x) if x else [] for x in texts.filter(pa.array(odd)).to_pylist()], plain.type)
        coded = pa.concat_arrays([plain.flatten(), rest.flatten()]).dictionary_encode()
        # from the order of both kinds back to that of the texts
        sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (plain, rest)]).astype(np.int64)
        own = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable")
        begins, sizes = (np.cumsum(sizes) - sizes)[own], sizes[own]
        first = np.concatenate([[0], np.cumsum(sizes)])
        codes = coded.indices.to_numpy(zero_copy_only=False)[np.arange(first[-1]) + np.repeat(begins - first[:-1], sizes)]
        return coded.dictionary.to_pylist(), codes.astype(np.uint32), first

    @staticmethod
    def _come_back(bytes_of, ids: list[list[int]], wanted: list[bytes]) -> bool:
        """Whether all chunks have the bytes of their tokens; they do if all of them in a row do, and each its number."""
        parts = list(map(bytes_of.__getitem__, chain.from_iterable(ids)))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        tokens = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        return b"".join(parts) == b"".join(wanted) and np.array_equal(ends[tokens], np.cumsum(np.fromiter(map(len, wanted), np.int64, len(wanted))))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each chunk with its space; both empty where bytes don't come back."""
        a: list[list[int]] = [[]] * len(chunks)
        plain = [k for k, c in enumerate(chunks) if _PLAIN.fullmatch(c)] if self.fast else []
        if plain:
            ids = self.fast.encode_ordinary("".join(f" {chunks[k]}" for k in plain))
            ends = np.cumsum(self.sizes_a[np.array(ids, np.int64)])
            edges = np.searchsorted(ends, np.cumsum([len(chunks[k].encode()) + 1 for k in plain])) + 1
            for k, (x, y) in zip(plain, pairwise([0, *edges.tolist()]), strict=True):
                a[k] = ids[x:y]
        done = set(plain)
        rest = [k for k in range(len(chunks)) if k not in done]
        for k, e in zip(rest, self.a.encode_batch_fast([f" {chunks[k]}" for k in rest], add_special_tokens=False), strict=True):
            a[k] = e.ids
        b = self.b.encode(chunks, num_threads=1)
        wanted = [f" {c}".encode() for c in chunks]
        if not (self._come_back(self.bytes_a, a, wanted) and self._come_back(self.bytes_b, b, wanted)):
            for k, want in enumerate(wanted):
                if b"".join(map(self.bytes_a.__getitem__, a[k])) != want or b"".join(map(self.bytes_b.__getitem__, b[k])) != want:
                    a[k], b[k] = [], []
        return a, b


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def _loaded(byte_bpe: bytes, piece_bpe: bytes) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


_ALIGNED = "shard bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, pairs array<bigint>, counts array<bigint>, parts binary, sizes binary"


def _align(files):
    def run(batches):
        t = _loaded(*files.value)
        shard = TaskContext.get().partitionId() << 24
        for whole in batches:
            for b in pieces(whole, "text", SHARD_BYTES):
                yield _shard(t, b, shard)
                shard += 1

    return run


class Aligned:
    """The chunks of a shard, one after another: counts of each, its links as pairs, its groups as a string."""

    def __init__(self, t: Tokenizers, chunks: list[str]):
        a, b = t.encode(chunks)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        to_a, to_b = slices(ends_a, ends_b)
        # both end a token at the end of each chunk, so groups and links lie within one
        edge_a, edge_b = np.cumsum(n_a), np.cumsum(n_b)
        n_groups = np.diff(np.searchsorted(to_a, edge_a, side="right"), prepend=0)
        at_a, at_b = links(ends_a, ends_b)
        n_links = np.diff(np.searchsorted(at_a, edge_a), prepend=0)
        self.counts = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        self.pairs = a[at_a] << _B_BITS | b[at_b]
        # a group's ids of A, then its ids of B
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(to_a)), size_a), np.repeat(np.arange(len(to_b)), size_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[to_a - 1], last_b[to_b - 1] = 1, 2
        told = np.empty(len(a) + len(b), np.int64)
        width = len(t.told) // 3
        told[np.arange(len(a)) + (to_b - size_b)[group_a]] = last_a * width + a
        told[np.arange(len(b)) + to_a[group_b]] = last_b * width + b
        whole = "".join(map(t.told.__getitem__, told.tolist()))
        edges = np.concatenate([[0], np.cumsum(t.told_sizes[told])])[np.concatenate([[0], edge_a + edge_b])]
        self.told = [whole[x:y] for x, y in pairwise(edges.tolist())]


def _shard(t: Tokenizers, b: pa.RecordBatch, shard: int) -> pa.RecordBatch:
    """A row for each document with the codes of its chunks, then one with the shard's pairs, their counts, and the pairs of each chunk."""
    chunks, codes, first = t.cut_all(b.column(1))
    made = Aligned(t, chunks)
    n, told = made.counts, made.told
    part, pairs = pd.factorize(made.pairs)
    bad = np.concatenate([[0], np.cumsum(n[codes, 0] == 0)])
    good = (np.diff(bad[first]) == 0) & (np.diff(first) > 0)  # a chunk without tokens: bytes differ
    sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(n[codes, k])])[first]) for k in range(4)]) * good
    uses = np.bincount(codes[np.repeat(good, np.diff(first))], minlength=len(chunks))
    own = [codes[x:y] if ok else codes[:0] for ok, (x, y) in zip(good.tolist(), pairwise(first.tolist()), strict=True)]
    digests = [hashlib.sha256("".join(map(told.__getitem__, c.tolist()))[:-1].encode()).hexdigest() if len(c) else "" for c in own]
    kept = [c.astype("<u4").tobytes() for c in own]
    counts = np.bincount(part, np.repeat(uses, n[:, 3]), len(pairs)).astype(np.int64)
    none = [None] * len(b)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shard] * (len(b) + 1), pa.int64()),
            pa.concat_arrays([b.column(0), pa.array([None], pa.int64())]),
            *(pa.array([*c.tolist(), None], pa.int64()) for c in sums),
            pa.array([*digests, None], pa.string()),
            pa.array([*kept, None], pa.binary()),
            pa.array([*none, pairs], pa.list_(pa.int64())),
            pa.array([*none, counts], pa.list_(pa.int64())),
            pa.array([*none, part.astype("<u4").tobytes()], pa.binary()),
            pa.array([*none, n[:, 3].astype("<u4").tobytes()], pa.binary()),
        ],
        ["shard", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "pairs", "counts", "parts", "sizes"],
    )


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _rate(key, batches):
    """n_best and count_sum of a shard's documents: from its pairs to chunks, from chunks to documents."""
    rows = pa.Table.from_batches(batches)
    pairs = rows.filter(pc.equal(rows["kind"], 0))
    total, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = pairs["pos"].to_numpy()
    total[at], best[at] = pairs["total"].to_numpy(), pairs["best"].to_numpy()
    head = rows.filter(pc.equal(rows["kind"], 1))
    part = np.frombuffer(head["parts"][0].as_py(), "<u4")
    edges = np.concatenate([[0], np.cumsum(np.frombuffer(head["sizes"][0].as_py(), "<u4"), dtype=np.int64)])
    by_chunk = [(s := np.concatenate([[0], np.cumsum(v[part])]))[edges[1:]] - s[edges[:-1]] for v in (best, total)]
    docs = rows.filter(pc.equal(rows["kind"], 2))
    codes = [np.frombuffer(x, "<u4") for x in docs["codes"].to_pylist()]
    rated = [pa.array([int(v[c].sum()) for c in codes], pa.int64()) for v in by_chunk]
    column = lambda name: docs[name].combine_chunks()
    yield pa.RecordBatch.from_arrays([column("doc_id"), column("n_a"), column("n_b"), column("n_groups"), column("n_links"), *rated, column("groups_sha256")], [x.split()[0] for x in _RESULT.split(", ")])


def align(docs: DataFrame, byte_bpe: str = f"{FILES}/{BYTE_BPE}", piece_bpe: str = f"{FILES}/{PIECE_BPE}") -> tuple[DataFrame, DataFrame]:
    """For each row of docs (doc_id, text) its counts of tokens, groups and links, with n_best and count_sum; and the corpus's pairs: id_a, id_b, count, best."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((Path(byte_bpe).read_bytes(), Path(piece_bpe).read_bytes()))
    rows = staged(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_align(files), _ALIGNED), "token-alignment", "zstd")
    is_head = F.col("parts").isNotNull()
    own = rows.filter(is_head).select("shard", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "p")).select("shard", "pos", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    id_b = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    totals = staged(own.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("id_b", id_b), "token-pairs", "zstd")
    most = totals.groupBy("id_b").agg(F.max("total").alias("most"))
    totals = totals.join(F.broadcast(most), "id_b").select("pair", "total", (F.col("total") == F.col("most")).cast("bigint").alias("best"))
    told = own.join(totals, "pair").select("shard", F.lit(0).alias("kind"), "pos", "total", "best")
    heads = rows.filter(is_head).select("shard", F.lit(1).alias("kind"), "parts", "sizes")
    texts = rows.filter(~is_head).select("shard", F.lit(2).alias("kind"), "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes")
    both = told.unionByName(heads, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    pairs = totals.filter("total > 0").select(F.shiftright("pair", _B_BITS).cast("int").alias("id_a"), id_b.cast("int").alias("id_b"), F.col("total").alias("count"), (F.col("best") == 1).alias("best"))
    return streamed(both, ["shard"], ["kind"], _rate, _RESULT), pairs


def align_documents(docs: DataFrame, byte_bpe: str = f"{FILES}/{BYTE_BPE}", piece_bpe: str = f"{FILES}/{PIECE_BPE}") -> DataFrame:
    return align(docs, byte_bpe, piece_bpe)[0]


def _sliced(t: Tokenizers, a: list[int], b: list[int]) -> list[dict]:
    to_a, to_b = slices(np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b]))
    edges = zip(pairwise([0, *to_a.tolist()]), pairwise([0, *to_b.tolist()]), strict=True)
    return [{"a": a[x:y], "b": b[u:v]} for (x, y), (u, v) in edges]


def _groups(files):
    def run(batches):
        t = _loaded(*files.value)
        for whole in batches:
            for b in pieces(whole, "text"):
                out = []
                for text in b.column(1).to_pylist():
                    encoded = list(zip(*t.encode(t.cut(text)), strict=True)) if text else []
                    whole_text = all(a for a, _ in encoded)
                    out.append([g for a, c in encoded for g in _sliced(t, a, c)] if whole_text else [])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], ["doc_id", "groups"])

    return run


def token_groups(docs: DataFrame, byte_bpe: str = f"{FILES}/{BYTE_BPE}", piece_bpe: str = f"{FILES}/{PIECE_BPE}") -> DataFrame:
    """doc_id and its groups in order, each with the ids of A and of B."""
    files = docs.sparkSession.sparkContext.broadcast((Path(byte_bpe).read_bytes(), Path(piece_bpe).read_bytes()))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_groups(files), "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>")
