"""Shared plumbing: cut lineage in the cluster's shared folder, checked broadcasts, components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
_written: list[tuple[object, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, if all of Spark is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="veilspan-")
        shared_folder.own = folder
    return folder.rstrip("/")


@atexit.register
def _remove_written() -> None:
    """Deletes what was written, also after the session has been stopped; it is left behind only where the JVM has ended before us."""
    for system, at in _written:
        try:
            system.delete(at, True)
        except Exception:  # the JVM is gone
            return


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when Python ends."""
    path = f"{shared_folder(spark)}/veilspan-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at))
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when a count shows at most `rows` narrow rows, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph `links` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is a partial aggregation
    and a join, so no component is ever gathered in one task, and the number of
    rounds grows with the logarithm of the longest path.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) u", "least(a, b) v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        edges = both.where("v > u").join(low, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").selectExpr("explode(array(struct(v u, m v), struct(u, m v))) e").select("e.*").where("u <> v").distinct()
        edges = cut(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.selectExpr("u node", "v component")
