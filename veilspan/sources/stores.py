"""Stores on shared folders: the vault of tokens, and audit events by date."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms as T

VAULT = "token string, entity string, sealed string, digest string, created_at timestamp, metadata map<string,string>"


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _system(spark, path)
    return system.exists(at)


def vault(spark: SparkSession, path: str) -> DataFrame:
    """The records of a vault; none where it has not been written yet.  A folder of other columns is refused.

    Two writers at once may both append a token; its first record counts, of equal times
    the one with the least sealed value, so every reader sees the same one.  `backup` writes just these.
    """
    held = appended(spark, path)
    first = F.min_by(F.struct(*[c for c in held.columns if c != "token"]), F.struct("created_at", "sealed"))
    return held.groupBy("token").agg(first.alias("r")).select("token", "r.*")


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All records as they were appended."""
    if not exists(spark, path):
        return spark.createDataFrame([], VAULT)
    held = spark.read.parquet(path)
    wanted = spark.createDataFrame([], VAULT).dtypes
    if held.dtypes != wanted:
        raise ValueError(f"{path} is no vault: {held.dtypes}")
    return held


def insert(found: DataFrame, path: str, hmac_key: bytes, seal_key: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Tokens (entity, value, token) of `found` (entity, value), after new ones have been appended.

    A token depends on entity and value alone, so inserting again adds nothing; one
    record a token is written however many rows hold its value.
    """
    spark = found.sparkSession
    tokens = found.where("entity is not null and value is not null").select("entity", "value").distinct().withColumn("token", T.vault_token(hmac_key, F.col("entity"), F.col("value")))
    notes = F.create_map(*[F.lit(x) for pair in (metadata or {}).items() for x in pair]).cast("map<string,string>") if metadata else F.create_map().cast("map<string,string>")
    rows = tokens.select("token", "entity", T.sealed(F.col("value"), seal_key, int(time.time())).alias("sealed"), F.sha2(F.col("value"), 256).alias("digest"), F.current_timestamp().alias("created_at"), notes.alias("metadata"))
    rows.join(appended(spark, path).select("token"), "token", "left_anti").write.mode("append").parquet(path)
    return tokens


def resolve(tokens: DataFrame, path: str, seal_key: str) -> DataFrame:
    """(token, entity, value) of known tokens; the value is null where the key is not theirs."""
    held = vault(tokens.sparkSession, path).select("token", "entity", "sealed")
    return tokens.select("token").distinct().join(held, "token").select("token", "entity", T.unsealed(F.col("sealed"), seal_key).alias("value"))


def status(spark: SparkSession, path: str) -> DataFrame:
    """(entity, n): tokens by entity."""
    return vault(spark, path).groupBy("entity").agg(F.count("*").alias("n"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records without what they seal; values of metadata are told by their length."""
    return vault(spark, path).select("token", "entity", "created_at", F.transform_values("metadata", lambda _, v: F.concat(F.lit("[REDACTED len="), F.length(v), F.lit("]"))).alias("metadata"))


def backup(spark: SparkSession, path: str, to: str) -> None:
    """A copy in a new folder; one that is there already is refused."""
    vault(spark, path).write.mode("errorifexists").parquet(to)


def rotate(spark: SparkSession, path: str, to: str, old_key: str, new_key: str) -> None:
    """The vault under a new key, in a new folder; tokens stay.  Nothing is written if a record does not open with the old key."""
    opened = vault(spark, path).withColumn("value", T.unsealed(F.col("sealed"), old_key))
    if opened.where("value is null").limit(1).count():
        raise ValueError("a record does not open with the old key")
    opened.withColumn("sealed", T.sealed(F.col("value"), new_key, int(time.time()))).drop("value").write.mode("errorifexists").parquet(to)


def append_audits(events: DataFrame, path: str, stage: str, rows_a_file: int = 1_000_000) -> None:
    """Audit events (any columns) as JSON lines in folders by date; files take at most `rows_a_file` events."""
    stamped = events.withColumn("stage", F.lit(stage)).withColumn("at", F.current_timestamp()).withColumn("date", F.current_date())
    stamped.write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy("date").json(path)


def batch_sinks(path: str, outputs: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes several outputs of a batch, each to `path`/name/batch=id.

    A batch that runs again after a failure, also one between two outputs, overwrites
    its own folders and no others, so each output holds every batch once.  The batch
    is kept while it is written, so that it is computed once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, rows in outputs(batch).items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return write


def purge_audits(spark: SparkSession, path: str, before: dt.date, dry_run: bool = True) -> DataFrame:
    """(folder, date, removed): days before a date; they are deleted unless it is a dry run.  The day itself and later ones stay, and so do folders of other names."""
    system, at = _system(spark, path)
    out = []
    for s in system.listStatus(at) if system.exists(at) else []:
        name = s.getPath().getName()
        try:
            day = dt.date.fromisoformat(name.removeprefix("date=")) if s.isDirectory() and name.startswith("date=") else None
        except ValueError:
            day = None
        if day is not None and day < before:
            out.append((s.getPath().toString(), day, not dry_run and system.delete(s.getPath(), True)))
    return spark.createDataFrame(out, "folder string, date date, removed boolean")
