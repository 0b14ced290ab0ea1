"""The translation cache: Parquet as the store, tab-separated text as an import.

The store of a model is a log of runs. A run has the rows of one append, or of several that were merged, in folders by
bucket of their keys; runs of a level are merged into one of the next when there are ``FAN`` of them (``sinks.compact_cache``), so a
row is written again once a level and an append reads nothing that is there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.commits import read_state
from pairloom.functions.text import model_key
from pairloom.operators.cache import with_keys
from pairloom.operators.ordinal import with_ordinal
from pairloom.schema import CACHE, STORED_CACHE
from pairloom.sources.files import block_bound, file_sizes, raw_lines


def scan_cache_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``ord, source_text, translation, is_bad`` of a header-less file of
    ``source <tab> translation`` lines.

    Texts are taken as they are: no quoting, and ``NA`` is a text. Blank lines are
    skipped; a line without exactly two fields is bad.
    """
    fields = F.split("text", "\t")
    bound = block_bound(spark, file_sizes(spark, [path]))

    def named(blocks: DataFrame) -> DataFrame:
        return blocks.withColumn("shard", F.regexp_extract("file", r"([^/]+)$", 1))

    return (
        with_ordinal(raw_lines(spark, [path]), [], named, bound)
        .filter(F.col("text") != "")
        .select(
            "ord",
            fields[0].alias("source_text"),
            F.get(fields, F.lit(1)).alias("translation"),
            (F.size(fields) != 2).alias("is_bad"),
        )
    )


def read_cache_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The good lines of a cache file; see :func:`count_bad_lines` for the others."""
    return scan_cache_tsv(spark, path).filter(~F.col("is_bad")).drop("is_bad")


def count_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    return scan_cache_tsv(spark, path).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("is_bad").alias("n_bad")
    )


def cache_path(root: str, model: str) -> str:
    return f"{root.rstrip('/')}/model={model_key(model)}"


def run_path(root: str, model: str, level: str, run: str) -> str:
    """Folder of one run of a model's cache, with a folder for each bucket of keys."""
    return f"{cache_path(root, model)}/level={level}/run={run}"


def cache_runs(spark: SparkSession, root: str, model: str) -> list[tuple[str, str, int]] | None:
    """``(level, run, rows)`` of the runs that count; None for a cache that has no log. In the log (see ``commits``) a
    run stands as the folder of a model and a level."""
    state = read_state(spark, cache_path(root, model))
    return None if state is None else [(f.split, f.ingest, f.rows) for f in state.folders]


def read_runs(spark: SparkSession, root: str, model: str, runs: list[tuple[str, str]]) -> DataFrame:
    """``bucket, k1, k2, ord, source_text, translation`` of some runs."""
    if not runs:
        return spark.createDataFrame([], STORED_CACHE)
    paths = [run_path(root, model, *run) for run in runs]
    return spark.read.schema(STORED_CACHE).option("basePath", cache_path(root, model)).parquet(*paths).select(
        *STORED_CACHE.names
    )


def read_cache(spark: SparkSession, root: str, model: str, keys: bool = False) -> DataFrame:
    """A model's stored cache, as of its last commit; one that does not exist yet is empty. ``keys`` adds the texts' keys
    ``k1, k2``, so that a lookup need not read the texts."""
    wanted = CACHE.names + ["k1", "k2"] * keys
    runs = cache_runs(spark, root, model)
    if runs is not None:
        return read_runs(spark, root, model, [r[:2] for r in runs]).select(*wanted)
    try:  # written without a log
        old = spark.read.schema(CACHE).parquet(cache_path(root, model))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = spark.createDataFrame([], CACHE)
    return with_keys(old).select(*wanted)
