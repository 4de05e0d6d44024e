"""Operator 6: quality classifier by importance resampling.

Words and word pairs are hashed into a fixed number of buckets.  Two
generative models (bucket probabilities with add-one smoothing) are counted
over all texts: one of the target rows (good documents), one of the raw rows.
A document's log weight is the sum over its n-grams of log target - log raw.
Adding standard Gumbel noise, keyed by seed and id, and keeping the k largest
draws k documents without replacement in proportion to their weights.

The k-th largest key is found exactly by counting over nested ranges of the
sort key, 2**12 ranges a round, so nothing is sorted or gathered.

Defined results: a null or empty text has log weight 0.  Rows whose key equals
the k-th largest are all kept.  An empty table yields an empty result.  Rows
with a null id share one draw of noise.  Repeated rows get equal keys, so they are
kept or left together (ties: more than k rows may be kept).  A text of any length is
weighed whole.  Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, if_small
from .textcore import ngrams, slices

BUCKETS = 1 << 14


def hashed(part, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words of a slice."""
    words = part.word_hashes()
    row = np.repeat(np.arange(len(part.ids)), np.diff(part.docs))
    pairs = ngrams(words, 2)
    inner = row[:-1] == row[1:] if len(row) > 1 else np.empty(0, dtype=bool)
    h = np.concatenate([words, pairs[inner]])
    return (h % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[:-1][inner] if len(row) else row])


def count_models(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Log target probability - log raw probability of each bucket; target: the keys of the target rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), dtype=np.int64)
        for part in slices(batches, text, key):
            bucket, row = hashed(part, buckets)
            good = np.array(part.rows.column(2).to_pylist(), dtype=bool)
            sums[0] += np.bincount(bucket[good[row]], minlength=buckets)
            sums[1] += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "target", "raw"])

    marked = target.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_good", F.lit(True))
    rows = docs.select(key, F.col(text).cast("string").alias(text)).join(if_small(marked), key, "left").select(key, text, F.coalesce("_good", F.lit(False)).alias("_good"))
    totals = rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    counts = np.zeros((2, buckets))
    for b, t, r in totals.collect():  # `buckets` rows, whatever the input
        counts[:, b] = t, r
    p = (counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets)
    return np.log(p[0]) - np.log(p[1])


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_grams, log_weight, sort_key); sort_key = log_weight plus Gumbel noise."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_ratio = held.value
        for part in slices(batches, text, key):
            bucket, row = hashed(part, len(log_ratio))
            n = len(part.ids)
            yield pa.RecordBatch.from_arrays([part.rows.column(0), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(np.bincount(row, weights=log_ratio[bucket], minlength=n))], ["key", "n_grams", "log_weight"])

    out = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"key {kind}, n_grams long, log_weight double")
    # 52 bits of the hash, moved off 0 and 1, make a uniform number.
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return out.withColumn("sort_key", F.col("log_weight") - F.log(-F.log(uniform))).withColumnRenamed("key", key)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (k from 1) of a double column without nulls; None if there are fewer."""
    low, high, over = -math.inf, math.inf, 0
    ends = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if ends[2] < k or k < 1:
        return None
    low, high = ends[0], ends[1]
    parts = 1 << 12
    while low < high:
        width = (high - low) / parts
        if width == 0 or low + width == low:
            # So narrow that the distinct values can be counted one by one.
            for v, n in values.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).collect():
                over += n
                if over >= k:
                    return v
        part = F.least(F.floor((F.col(column) - low) / width), F.lit(parts - 1))
        counts = values.where(F.col(column).between(low, high)).groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("p")).collect()
        for r in counts:  # at most `parts` rows
            if over + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            over += r["n"]
    return low


def resample(docs: DataFrame, target: DataFrame, share: float = 0.5, seed: int = 7, key: str = "doc_id", text: str = "text", eligible: Column | None = None) -> DataFrame:
    """(key, n_grams, log_weight, sort_key, selected): `share` of the rows, drawn by Gumbel top-k."""
    scored = cut(weigh(docs, count_models(docs, target, key, text), seed, key, text))
    k = round(share * scored.count())
    bound = kth_largest(scored, "sort_key", k) if k else None
    return scored.withColumn("selected", F.col("sort_key") >= bound if bound is not None else F.lit(False))
