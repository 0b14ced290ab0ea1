"""Aligned line files: ``<root>/<aaa-bbb>/<split>.src`` and ``.trg``, plain or gz.

A side can also be a folder of part files, ``<split>.src/part-00000...``, as Spark
writes it; their lines are taken in file-name order, shorter names first (``part-9`` before ``part-10``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.text import canonical_split, is_pair_name, left_code, right_code, strip_text
from pairloom.operators.align import unmatched_counts, zip_sides
from pairloom.operators.ordinal import block_offsets, with_ordinal
from pairloom.operators.sizing import settle
from pairloom.schema import CATALOG, STORED_PAIR

_SIDE_PATH = r"/([^/]+)/(train|val|dev|test)\.(src|trg)(\.gz)?(?:/([^/]+?)(\.gz)?)?$"


def list_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of a corpus folder: one row per file, no file is opened.

    Empty files are not listed. ``split`` is as in the file name.
    """
    try:
        found = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], CATALOG)
        raise

    def part(i: int):
        return F.regexp_extract("path", _SIDE_PATH, i)

    return (
        found.filter(F.col("path").rlike(_SIDE_PATH))
        .select(
            part(1).alias("lang_pair"),
            part(2).alias("split"),
            part(3).alias("side"),
            ((part(4) != "") | (part(6) != "")).cast("int").alias("is_gz"),
            "path",
            part(5).alias("shard"),
            F.col("length").alias("bytes"),
        )
        .filter(is_pair_name("lang_pair"))
    )


def choose_files(
    catalog: DataFrame, dev: str = "fallback", one_sided: bool = False
) -> DataFrame:
    """The files to read per pair and split.

    A plain side wins over its gz variant, and a split needs both sides, unless ``one_sided``
    keeps those of which only one side is there (or has lines: empty files are not listed).
    ``dev`` files are stored as ``val`` where there are no ``val`` files; ``dev="ignore"``
    never reads them.
    """
    if dev == "ignore":
        catalog = catalog.filter(F.col("split") != "dev")
    elif dev != "fallback":
        raise ValueError(f"unknown dev handling: {dev}")
    group = ["lang_pair", "_stored"]
    in_split = Window.partitionBy(*group, "split")
    in_side = Window.partitionBy(*group, "split", "side")
    return (
        catalog.withColumn("_stored", canonical_split("split"))
        # one shuffle serves all three windows
        .repartition(*group)
        .withColumn("_sides", F.size(F.collect_set("side").over(in_split)))
        .withColumn("_form", F.min("is_gz").over(in_side))
        .filter((F.lit(one_sided) | (F.col("_sides") == 2)) & (F.col("is_gz") == F.col("_form")))
        # two sides before one, val before dev
        .withColumn("_best", F.max(F.struct("_sides", "split")).over(Window.partitionBy(*group)))
        .filter(F.col("split") == F.col("_best.split"))
        .withColumn("split", F.col("_stored"))
        .select(*catalog.columns)
    )


def skipped_splits(catalog: DataFrame, dev: str = "fallback") -> DataFrame:
    """``lang_pair, split, side``: splits that are skipped because just this side of them is there or
    has lines."""
    return (
        choose_files(catalog, dev, one_sided=True)
        .groupBy("lang_pair", canonical_split("split").alias("split"))
        .agg(F.collect_set("side").alias("sides"))
        .filter(F.size("sides") == 1)
        .select("lang_pair", "split", F.col("sides")[0].alias("side"))
    )


#: What decides into which blocks files are cut.
_MIN_PARTITIONS = "spark.sql.files.minPartitionNum"
_CUTS = {
    "spark.sql.files.maxPartitionBytes": "134217728b",
    "spark.sql.files.openCostInBytes": "4194304b",
}


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their place: ``file, block, seq, text``.

    The files are opened by a session of their own whose settings are those of this moment, the number of cores included.
    So every pass over the result cuts them at the same bytes, also after cores have come or gone, or ``spark`` was
    set otherwise.
    """
    own = spark.newSession()
    cores = spark.conf.get(_MIN_PARTITIONS, None) or str(spark.sparkContext.defaultParallelism)
    own.conf.set(_MIN_PARTITIONS, cores)
    for key, default in _CUTS.items():
        own.conf.set(key, spark.conf.get(key, default))
    lines = own.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("text"),
    )
    # a union belongs to the session of its first side; the empty side is optimized away
    return spark.createDataFrame([], lines.schema).limit(0).union(lines)


def numbered_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, ord, text`` of files that one task reads whole, such as gz files: a line's number is how many
    came before it from the same file, so nothing is counted first and each file is unpacked once."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            runs = pc.run_end_encode(batch.column("file"))
            start, ords = 0, []
            for end, file in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if file != last:
                    last, seen = file, 0
                ords.append(np.arange(seen, seen + end - start))
                seen += end - start
                start = end
            places = pa.array(np.concatenate(ords) if ords else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), places, batch.column("text")], names=["file", "ord", "text"]
            )

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return lines.mapInArrow(number, "file string, ord long, text string")


def file_name(file: str = "file") -> Column:
    """A path as metadata has it, URL-encoded, with "+" standing for itself, made plain."""
    return F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B")))


def with_side(df: DataFrame) -> DataFrame:
    """``df`` with the ``lang_pair, split, side, shard`` that its ``file`` tells."""

    def part(i: int):
        return F.regexp_extract(file_name(), _SIDE_PATH, i)

    return df.withColumns(
        {
            "lang_pair": part(1),
            "split": canonical_split(part(2)),
            "side": part(3),
            "shard": part(5),
        }
    )


def file_sizes(spark: SparkSession, paths: list[str]) -> list[int]:
    """Bytes of the files under ``paths``, from the file index; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return [r.length for r in found.select("length").collect()]


def block_bound(spark: SparkSession, sizes: list[int]) -> int:
    """An upper bound of the blocks Spark cuts files of these sizes into."""
    conf = spark.conf
    most = _bytes(conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    open_cost = _bytes(conf.get("spark.sql.files.openCostInBytes", "4194304b"))
    cores = int(conf.get("spark.sql.files.minPartitionNum", None) or 0)
    cores = cores or spark.sparkContext.defaultParallelism
    # the cluster may grow until the job runs
    share = sum(s + open_cost for s in sizes) / (4 * cores)
    block = min(most, max(open_cost, share))
    return sum(math.ceil(s / block) for s in sizes)


def numbered_lines(
    spark: SparkSession, catalog: DataFrame, dev: str = "fallback", one_sided: bool = False
) -> DataFrame | None:
    """Stripped lines of the chosen files with their ``ord``; None without any file.

    A side that is one gz file is numbered as it is unpacked. Other files are cut into blocks, which are counted in a pass
    before.
    """
    numbered = _numbered(spark, catalog, dev, one_sided)
    return None if numbered is None else numbered.lines


class _Numbered(NamedTuple):
    lines: DataFrame
    cuts: DataFrame | None  #: positions at which blocks begin: lang_pair, split, at
    max_cuts: int


def _numbered(spark: SparkSession, catalog: DataFrame, dev: str, one_sided: bool) -> _Numbered | None:
    # file names are driver metadata: Spark's own file index holds them there too
    files = choose_files(catalog, dev, one_sided).select("lang_pair", "split", "side", "path", "bytes", "is_gz").collect()
    if not files:
        return None
    keys = ["lang_pair", "split", "side"]
    shards = Counter(f[:3] for f in files)
    whole = [f for f in files if f.is_gz and shards[f[:3]] == 1]
    rest = [f for f in files if not (f.is_gz and shards[f[:3]] == 1)]
    parts, cuts, bound = [], None, 0
    if rest:
        bound = block_bound(spark, [f.bytes for f in rest])
        lines = raw_lines(spark, [f.path for f in rest])
        # counted once, for the numbers and for the cuts
        blocks = settle(block_offsets(lines, keys, with_side)).df
        parts.append(with_ordinal(lines, keys, with_side, bound, blocks))
        cuts = blocks.select("lang_pair", "split", F.col("_offset").alias("at"))
    if whole:
        named = with_side(numbered_files(spark, [f.path for f in whole]))
        parts.append(named.select(*keys, "text", "ord"))
    numbered = reduce(DataFrame.unionByName, parts)
    return _Numbered(numbered.withColumn("text", strip_text("text")), cuts, bound)


def read_aligned(
    spark: SparkSession, catalog: DataFrame, mode: str = "inner", dev: str = "fallback"
) -> DataFrame:
    """All pairs of the catalog as one table of :data:`schema.STORED_PAIR`, one job
    whatever the number of pairs.

    ``mode``: ``inner`` cuts to the shorter side and skips splits without one (see
    :func:`skipped_splits`), ``strict`` fails on uneven sides, a missing or empty one included,
    ``report`` returns line counts per pair and split instead.
    """
    numbered = _numbered(spark, catalog, dev, one_sided=mode != "inner")
    if mode == "report":
        empty = "lang_pair string, split string, side string"
        return unmatched_counts(spark.createDataFrame([], empty) if numbered is None else numbered.lines)
    if numbered is None:
        return spark.createDataFrame([], STORED_PAIR)
    return zip_sides(numbered.lines, mode, cuts=numbered.cuts, max_cuts=numbered.max_cuts).select(
        "lang_pair",
        "split",
        "ord",
        "source_text",
        "target_text",
        left_code("lang_pair").alias("source_lang"),
        right_code("lang_pair").alias("target_lang"),
    )


def _bytes(size: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    digits = size.lower().removesuffix("b")
    if digits[-1] in units:
        return int(digits[:-1]) * units[digits[-1]]
    return int(digits)
