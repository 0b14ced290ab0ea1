"""Stored pair tables, flat corpora and wide evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.commits import read_state
from pairloom.operators.sizing import local_table, small_side
from pairloom.schema import FLAT, STORED_PAIR

def folder_names(spark: SparkSession, root: str) -> list[tuple[str, str, str]]:
    """``(lang_pair, split, ingest)`` of the folders under ``root``, from a listing of folders: its calls grow with the
    pairs, not with the files. Only for stores without a log."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path(f"{root.rstrip('/')}/lang_pair=*/split=*/ingest=*")) or []
    places = [s.getPath().toString().split("/")[-3:] for s in found]
    return [tuple(unquote(x.partition("=")[2]) for x in place) for place in places]


def has_rows(spark: SparkSession, root: str) -> bool:
    return bool(folder_names(spark, root))


def _folders(spark: SparkSession, root: str) -> list[tuple[str, str, str, str]]:
    """``(lang_pair, split, ingest, writer)`` of what counts in a store."""
    state = read_state(spark, root)
    if state is None:
        return [(*f, f[2]) for f in folder_names(spark, root)]
    return [(f.lang_pair, f.split, f.ingest, f.writer) for f in state.folders]


def stored_splits(spark: SparkSession, root: str, besides: str | None = None) -> DataFrame:
    """``lang_pair, split`` of what a store holds, from its log: no data file is listed or opened.
    A store that does not exist is empty. ``besides`` leaves out what one writer wrote."""
    names = sorted({(p, s) for p, s, _, w in _folders(spark, root) if w != besides})
    schema = StructType([StructField(n, StringType()) for n in ("lang_pair", "split")])
    return local_table(spark, names, schema)


def stored_pairs(spark: SparkSession, root: str, besides: str | None = None) -> DataFrame:
    """The distinct ``lang_pair`` names of a store."""
    return stored_splits(spark, root, besides).select("lang_pair").distinct()


def complete_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Names of the pairs all of whose splits were published whole. A pair of which a stream has brought a part is
    not among them until the stream has ended."""
    state = read_state(spark, root)
    names = {f[0] for f in folder_names(spark, root)} if state is None else state.complete_pairs()
    return local_table(spark, [(p,) for p in sorted(names)], StructType([StructField("lang_pair", StringType())]))


def read_pairs(
    spark: SparkSession,
    root: str,
    pairs: Sequence[str] | None = None,
    split: str | None = "train",
) -> DataFrame:
    """Pairs of a store written by ``sinks.write_pairs``, as of its last commit. Only the folders that count, of the
    pairs and the split asked for, are listed; a pair without the split gives no rows."""
    wanted = [
        f"{root.rstrip('/')}/lang_pair={p}/split={s}/ingest={i}"
        for p, s, i, _ in _folders(spark, root)
        if (pairs is None or p in pairs) and split in (None, s)
    ]
    if not wanted:
        return spark.createDataFrame([], STORED_PAIR)
    df = spark.read.schema(STORED_PAIR).option("basePath", root).parquet(*wanted).select(*STORED_PAIR.names)
    if pairs is not None:
        df = df.filter(F.col("lang_pair").isin(list(pairs)))
    return df if split is None else df.filter(F.col("split") == split)


def pairs_without_split(catalog: DataFrame, split: str = "train") -> DataFrame:
    """Names in ``catalog`` (``lang_pair, split``) that lack ``split``: they are skipped."""
    has = F.bool_or(F.col("split") == split)
    return catalog.groupBy("lang_pair").agg(has.alias("_has")).filter("not _has").select("lang_pair")


def read_flat(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A flat corpus (Parquet or JSON lines) with the fixed schema :data:`schema.FLAT`."""
    return spark.read.schema(FLAT).format(fmt).load(path)


def read_parquet_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Any Parquet table with its row positions as ``ord``, for tables stored without one.

    Files count in name order. The row's index in its file comes from the reader, so
    only the number of rows per file is computed; nothing is sorted or shuffled.
    """
    rows = spark.read.parquet(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.row_index").alias("_index"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.length("_file"), "_file").rowsBetween(
        Window.unboundedPreceding, -1
    )
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        rows.join(small_side(files), "_file")
        .withColumn("ord", F.col("_offset") + F.col("_index"))
        .drop("_file", "_index", "_offset")
    )
