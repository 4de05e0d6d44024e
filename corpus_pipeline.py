"""A corpus pipeline: quality rules, near-duplicate join, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are
written as Parquet and read again before the next.

Defined results of all stages: rows with a null id are kept unless their own text
rejects them (rules, benchmark); a null or empty text has no words, so the quality
rules reject it.  Of repeated rows one is left after stage 2; of a group the
smallest id.  Texts of any length are handled whole.  An empty table gives no
rows at any stage.  Columns beside those of `documents` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import encoding, jaccard, quality_rules, substrings, tiling
from veilspan.llm.queries import model_path
from veilspan.llm.tables import cut, if_small, new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs.select(*COLUMNS))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 5-word shingles at a similarity of 0.8, the one with the smallest id; of rows with one id, that with the smallest text."""
    groups = jaccard.join(docs, n=5, num=80, den=100).select("doc_id", "component_id").where("doc_id <> component_id").select("doc_id").distinct()
    docs = docs.join(if_small(groups), "doc_id", "left_anti").select(*COLUMNS)
    repeated = if_small(cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")))
    first = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return docs.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(first)


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of passages that occur earlier; untouched texts stay as they are."""
    out = substrings.dedup(docs, carry=("text", "lang", "source"))
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=COLUMNS)
    return found.where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text, by seeded merge-dropout."""
    return encoding.encode(docs, model_path())


STAGES = [
    ("quality rules", keep_by_rules),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", strike_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: stages 2, 3 and 5 are not expressible; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
