"""The training-data pipeline: from raw documents to sampled pieces.

Every stage takes what its predecessor wrote and returns the columns of its input, but for the last one,
which returns pieces. Nothing is kept by path or sampled; a stage that removes documents removes only those that its
operator rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.language_id import prediction
from pairloom.llm.pieces import encode
from pairloom.llm.secrets import redact_secrets
from pairloom.llm.selection import mixed, one_of_each_group
from pairloom.workspace import new_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return docs.filter(prediction(docs)["lang_pred"] != "und")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row stays."""
    return one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is repeated, or left out, as its rate says: none of the clean domain is left out, and none of
    another is repeated."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: Graph search over shingle sets, a trained language model and sampling have no SQL form; the stages
#: are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_dir(spark, f"pipeline-{i}-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
