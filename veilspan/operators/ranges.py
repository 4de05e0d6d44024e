"""Joins of spans by place, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(anchors: DataFrame, candidates: DataFrame, key: str, window: int) -> DataFrame:
    """(key, a_start, a_end, c_start, c_end, and further columns of candidates) of pairs no farther apart than `window` places.

    A candidate stands in the bucket of its start; an anchor meets the buckets that
    its window, drawn out by the longest candidate, touches.  So the join is one of
    equal keys and buckets, and no pair of far spans is formed.  Spans are
    (key, start, end); rows with a null key or place meet nothing.
    """
    longest = candidates.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    width = window + longest + 1
    bucket = lambda place: F.floor(place / F.lit(width)).cast("long")
    spread = anchors.select(key, F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.explode(F.sequence(bucket(F.col("start") - window - longest), bucket(F.col("end") + window))).alias("_b"))
    placed = candidates.withColumnsRenamed({"start": "c_start", "end": "c_end"}).withColumn("_b", bucket(F.col("c_start")))
    return spread.join(placed, [key, "_b"]).where((F.col("c_start") - F.col("a_end") <= window) & (F.col("a_start") - F.col("c_end") <= window)).drop("_b")
