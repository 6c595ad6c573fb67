"""Words of many texts at once in numpy: what the tasks of several operators do with an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_ENDS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K2
    x = (x ^ (x >> _U(27))) * _K3
    return x ^ (x >> _U(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts (and the last ends); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], dtype=kind, count=len(texts) + 1, offset=texts.offset * np.dtype(kind).itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if len(sizes) > at:
        yield batch.slice(at)


class Words:
    """Words of lower-cased texts: starts, lens, and first[i]:first[i + 1], those of text i."""

    def __init__(self, texts: pa.Array, is_word: np.ndarray = _WORD):
        raw, off = flat(texts)
        self.data = np.concatenate([_LOW[raw], np.zeros(8, np.uint8)])
        self.off = off
        inside = is_word[self.data[: len(raw)]]
        before = np.empty(len(raw), bool)
        if len(raw):
            before[0] = False
            before[1:] = inside[:-1]
            before[off[:-1][off[:-1] < len(raw)]] = False
            after = np.empty(len(raw), bool)
            after[-1] = False
            after[:-1] = inside[1:] & before[1:]
        else:
            after = before
        self.starts = np.flatnonzero(inside & ~before)
        self.lens = np.flatnonzero(inside & ~after) + 1 - self.starts
        self.first = np.searchsorted(self.starts, off)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from its bytes and length."""
        h = mix(self.lens.astype(np.uint64) * _K1)
        view = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        todo, at = np.arange(len(h)), 0
        while len(todo):
            n = np.minimum(self.lens[todo] - at, 8)
            h[todo] = mix((h[todo] ^ (view[self.starts[todo] + at] & _ENDS[n])) * _K1)
            at += 8
            todo = todo[self.lens[todo] > at]
        return h


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each `size` words in a row."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = mix((out ^ h[k : k + len(out)]) * _K1 + _U(k + 1))
    return out
