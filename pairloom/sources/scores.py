"""Quality scores: one float per line, aligned by position to one pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.functions.text import strip_text
from pairloom.operators.ordinal import with_ordinal
from pairloom.operators.sizing import local_table
from pairloom.sources.files import block_bound, file_name, file_sizes, raw_lines


def read_scores(
    spark: SparkSession,
    paths: Mapping[str, str] | Sequence[str],
    pairs: Sequence[str] | None = None,
) -> DataFrame:
    """``lang_pair, ord, score`` from ``{lang_pair: path}``; a path is a file or a folder
    of part files. A list of paths is matched to ``pairs`` by place, and both must be
    equally long. A line that is no number is an error."""
    if not isinstance(paths, Mapping):
        if pairs is None or len(paths) != len(pairs):
            raise ValueError("a list of score files needs an equally long list of pairs")
        paths = dict(zip(pairs, paths))
    if not paths:
        return spark.createDataFrame([], "lang_pair string, ord bigint, score double")
    roots = {p: path.rstrip("/") for p, path in paths.items()}
    files = list(roots.values())
    schema = StructType([StructField(n, StringType()) for n in ("_root", "lang_pair")])
    names = local_table(spark, [(_uri_path(r), p) for p, r in roots.items()], schema)

    def named(blocks: DataFrame) -> DataFrame:
        # a file is its own root; a part file's root is its folder
        plain = F.regexp_replace(file_name(), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
        folder = F.regexp_replace(plain, r"/[^/]+$", "")
        in_folder = folder.isin([_uri_path(r) for r in files])
        shard = F.when(in_folder, F.regexp_extract(plain, r"([^/]+)$", 1)).otherwise("")
        placed = blocks.withColumns(
            {"_root": F.when(in_folder, folder).otherwise(plain), "shard": shard}
        )
        return placed.join(names, "_root").drop("_root")

    bound = block_bound(spark, file_sizes(spark, files))
    return with_ordinal(raw_lines(spark, files), ["lang_pair"], named, bound).select(
        "lang_pair", "ord", strip_text("text").cast("double").alias("score")
    )


def _uri_path(path: str) -> str:
    head, sep, tail = path.partition(":")
    if sep and "/" not in head:
        return "/" + tail[2:].partition("/")[2] if tail.startswith("//") else tail
    return path
