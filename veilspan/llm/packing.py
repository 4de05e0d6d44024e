"""Compact blobs of sorted integers, and sizes of tasks derived from the input."""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one group of a regrouped table should hold; with very many groups, more, up to the second figure:
#: what a task sends to each group would else become too little for a blob.
GROUP_BYTES = 24 << 20, 128 << 20
#: Groups from which on they grow before there are more.
MANY_GROUPS = 1 << 14


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values, as differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def groups_for(spark: SparkSession, total: int, sizes: tuple[int, int] = GROUP_BYTES) -> int:
    """Into how many groups `total` bytes of texts are dealt: at least as many as shuffle partitions, without an upper limit."""
    few = math.ceil(total / sizes[0])
    groups = few if few <= MANY_GROUPS else max(MANY_GROUPS, math.ceil(total / sizes[1]))
    return max(groups, int(spark.conf.get("spark.sql.shuffle.partitions")))


def group_of(key: str, text: str, groups: int) -> Column:
    """The group of a row, by its key; rows without a key are dealt by their text, not all into one group."""
    return F.pmod(F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))), F.xxhash64(F.col(text))), F.lit(groups)).cast("int")
