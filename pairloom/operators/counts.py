"""Counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.select import reaches


def pair_counts(df: DataFrame, key: str = "lang_pair") -> DataFrame:
    """Rows per pair plus a grand total in the row with a null key.

    The rollup runs over the per-pair counts: over the rows it would double each of them.
    """
    per_pair = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_pair.rollup(key).agg(F.sum("n").alias("n"))


def score_counts(df: DataFrame, threshold: float = 0.95, key: str = "lang_pair") -> DataFrame:
    """Rows and rows reaching the threshold, per pair and in total."""
    per_pair = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(reaches(F.col("score"), threshold)).alias("n_kept"),
    )
    return per_pair.rollup(key).agg(F.sum("n").alias("n"), F.sum("n_kept").alias("n_kept"))


def catalog_counts(catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: pairs, pairs skipped because they exist, pairs left."""
    names = catalog.select("lang_pair").distinct()
    marked = names.join(
        existing.select("lang_pair").distinct().withColumn("_seen", F.lit(True)),
        "lang_pair",
        "left",
    )
    return marked.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("_seen").isNotNull()).alias("n_skipped"),
        F.count_if(F.col("_seen").isNull()).alias("n_left"),
    )


def split_report(df: DataFrame) -> DataFrame:
    """Per pair: its splits, sorted, and its rows."""
    per_split = df.groupBy("lang_pair", "split").agg(F.count(F.lit(1)).alias("n"))
    return per_split.groupBy("lang_pair").agg(
        F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"),
        F.sum("n").alias("n"),
    )


def langs_used(df: DataFrame) -> DataFrame:
    """The distinct target languages."""
    return df.select(F.col("target_lang").alias("lang")).distinct()
