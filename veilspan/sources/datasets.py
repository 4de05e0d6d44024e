"""Evaluation datasets and detector fixtures from JSON files, read by glob: a row a case, with its file and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import CASE

_CASE = "id string, payload variant, " + ", ".join(f"{name} {kind}" for name, kind in CASE.items())
_FIXTURE = "detector string, entity string, description string, cases array<struct<role:string,text:string,surface:string>>"


def _files(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    """(path, file struct) of whole JSON files; one that lacks a needed field is an error that names it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("file"))
    lacks = F.concat_ws(", ", *[F.when(F.col(f"file.{c}").isNull(), F.lit(c)) for c in needed])
    return files.select("path", F.when(lacks == "", F.col("file")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" lacks "), lacks)).cast(f"struct<{','.join(f'{n}:{k}' for n, k in _fields(schema))}>")).alias("file"))


def _fields(schema: str) -> list[tuple[str, str]]:
    from pyspark.sql.types import StructType

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of files {name, cases: [...]}: path, dataset, place and the columns of a case; payloads as JSON text."""
    rows = _files(spark, path, f"name string, cases array<struct<{','.join(f'{n}:{k}' for n, k in _fields(_CASE))}>>", ["cases"])
    rows = rows.select("path", F.coalesce("file.name", F.element_at(F.split("path", "/"), -1)).alias("dataset"), F.posexplode("file.cases").alias("place", "c"))
    return rows.select("path", "dataset", "place", "c.*").withColumn("payload", F.to_json("payload"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Cases of detector fixtures {detector, entity, description, cases: [{role, text, surface}]}: path, place, detector, entity, role, text, surface."""
    rows = _files(spark, path, _FIXTURE, ["detector", "entity", "description", "cases"]).select("path", "file.detector", "file.entity", F.posexplode("file.cases").alias("place", "c"))
    return rows.select("path", "place", "detector", "entity", "c.role", "c.text", F.coalesce("c.surface", F.lit("output.content")).alias("surface"))
