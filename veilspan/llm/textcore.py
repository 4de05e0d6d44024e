"""Vectorised tokenising and hashing of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word or an
n-gram is represented by a 64-bit hash that depends on nothing but its bytes,
so every executor, attempt and run computes the same value.  Work proceeds in
slices of about two megabytes, so memory does not follow the partition size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words up to this length are hashed by eight bytes at a time, all together; longer ones one by one.
_CHUNKED = 64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit values."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs data[start:end].

    Eight bytes at a time are mixed into the state by steps that are one to one in
    the state and in the bytes, so words of one length up to eight bytes never
    collide, and others as chance has it; long words have XXH3.
    """
    sizes = ends - starts
    h = sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    whole = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=whole, strides=(1,))
    left, at = np.flatnonzero((sizes > 0) & (sizes <= _CHUNKED)), 0
    while len(left):
        rest = sizes[left] - at
        chunk = eight[starts[left] + at]
        part = rest < 8
        chunk[part] &= (np.uint64(1) << (8 * rest[part]).astype(np.uint64)) - np.uint64(1)
        h[left] = mix((h[left] ^ chunk) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(sizes > _CHUNKED).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


@dataclass
class Slice:
    """Some rows of a batch: `ids` may hold None; `docs[i]:docs[i+1]` are the words of row i."""

    ids: list
    rows: pa.RecordBatch
    data: np.ndarray
    text_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray

    def word_hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for every start; rows of different documents are not told apart here."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = (h + words[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return mix(h)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offset of each row."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", key: str = "doc_id", lower: bool = True) -> Iterator[Slice]:
    for batch in batches:
        names = batch.schema.names
        column, ids = batch.column(names.index(text)), batch.column(names.index(key))
        data, at = raw_text(column)
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, side="right")) - 1)
            part, part_at = data[at[first] : at[last]], at[first : last + 1] - at[first]
            if lower:
                part = _LOWER[part]
            starts, ends = word_bounds(part, part_at)
            yield Slice(ids[first:last].to_pylist(), batch.slice(first, last - first), part, part_at, starts, ends, np.searchsorted(starts, part_at))
            first = last


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    inside = ~_WS[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[at] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before |= cut[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    after |= cut[1:]
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def int_list(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from one array a row."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    if arrays:
        np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int64), pa.int64()))


def xxhash64_of_longs(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64() gives for a bigint column, as signed 64-bit values."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    v = values.astype(np.int64).view(np.uint64)
    h = np.full(len(v), np.uint64(42) + p5 + np.uint64(8), dtype=np.uint64)
    h ^= turn(v * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
