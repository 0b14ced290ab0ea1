"""Positional joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordinal import broadcast_blocks, div

#: Most lines of one pair that stay together when its sides are zipped.
ZIP_CHUNK = 250_000


def zip_sides(
    lines: DataFrame,
    mode: str = "inner",
    chunk: int = ZIP_CHUNK,
    cuts: DataFrame | None = None,
    max_cuts: int | None = None,
) -> DataFrame:
    """Put line ``i`` of ``src`` next to line ``i`` of ``trg``.

    ``lines``: lang_pair, split, side, ord, text. ``inner`` stops at the shorter side,
    ``strict`` makes uneven sides an error. ``cuts`` and ``max_cuts`` as in :func:`zip_runs`.

    Both sides travel in one shuffle on (pair, split, run) and
    meet in an aggregation there. The result is sorted by position inside each run,
    which is the layout ``sinks.write_pairs`` wants: zipping and writing share the
    shuffle, and a pair of any size is spread over its runs.
    """
    run = ["_chunk"] if cuts is None else ["_chunk", "_part"]
    keys = ["lang_pair", "split", *run, "ord"]
    side = F.col("side")
    zipped = (
        zip_runs(lines, chunk, cuts, max_cuts)
        .repartition("lang_pair", "split", *run)
        .groupBy(*keys)
        .agg(
            F.max(F.when(side == "src", F.col("text"))).alias("source_text"),
            F.max(F.when(side == "trg", F.col("text"))).alias("target_text"),
        )
    )
    both = F.col("source_text").isNotNull() & F.col("target_text").isNotNull()
    return _keep(zipped, both, mode).drop(*run)


def zip_runs(
    lines: DataFrame, chunk: int = ZIP_CHUNK, cuts: DataFrame | None = None, max_cuts: int | None = None
) -> DataFrame:
    """Add the run a position belongs to: ``_chunk`` for ``chunk`` positions and, with ``cuts``, ``_part`` of it.

    ``cuts`` (``lang_pair, split, at``, of either side) are positions at which a read block begins. As a run goes
    on behind none, it has at most one block's bytes of each side, however long the lines are. A row looks
    at the cuts of its own chunk only, of which ordinary text has one or none. ``max_cuts`` bounds their number, which
    decides whether they are broadcast.
    """
    placed = lines.withColumn("_chunk", div("ord", chunk))
    if cuts is None:
        return placed
    keys = ["lang_pair", "split", "_chunk"]
    by_chunk = cuts.withColumn("_chunk", div("at", chunk)).groupBy(*keys).agg(F.collect_set("at").alias("_cuts"))
    passed = F.size(F.filter("_cuts", lambda at: at <= F.col("ord")))
    joined = placed.join(broadcast_blocks(by_chunk, max_cuts), keys, "left")
    return joined.withColumn("_part", F.coalesce(passed, F.lit(0))).drop("_cuts")


def zip_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], mode: str = "inner"
) -> DataFrame:
    """Join two positional tables on ``keys``, the last of which is the position.

    Positions are unique within a pair, so the join keys are too and no task gets more
    than its share however large one pair is.
    """
    keys = list(keys)
    if mode == "inner":
        return left.join(right, keys)
    marked = left.withColumn("_l", F.lit(True)).join(
        right.withColumn("_r", F.lit(True)), keys, "full_outer"
    )
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return _keep(marked, both, mode).drop("_l", "_r")


def unmatched_counts(lines: DataFrame) -> DataFrame:
    """Per pair and split: lines of each side, zipped pairs and left-over lines.

    Positions are dense, so the counts say all; no join is needed.
    """
    sizes = lines.groupBy("lang_pair", "split").agg(
        F.count_if(F.col("side") == "src").alias("n_src"),
        F.count_if(F.col("side") == "trg").alias("n_trg"),
    )
    return sizes.select(
        "*",
        F.least("n_src", "n_trg").alias("n_pairs"),
        F.abs(F.col("n_src") - F.col("n_trg")).alias("n_unmatched"),
    )


def attach_scores(pairs: DataFrame, scores: DataFrame, strict: bool = True) -> DataFrame:
    """Add the ``score`` at the same position; with ``strict`` every row needs a score
    and every score a row."""
    narrow = scores.select("lang_pair", "ord", "score")
    return zip_rows(pairs, narrow, ["lang_pair", "ord"], "strict" if strict else "inner")


def check_lengths(pairs: DataFrame, scores: DataFrame) -> None:
    """Fail unless every pair has as many scores as rows. Positions of both are dense, so equal counts mean
    equal positions; only the names of pairs are read."""
    sizes = [
        df.groupBy("lang_pair").agg(F.count(F.lit(1)).alias(name))
        for df, name in ((pairs, "_rows"), (scores, "_scores"))
    ]
    uneven = sizes[0].join(sizes[1], "lang_pair", "full_outer").filter(
        ~F.col("_rows").eqNullSafe(F.col("_scores"))
    )
    if not uneven.isEmpty():
        raise ValueError("pairs and scores have different lengths")


def _keep(df: DataFrame, matched, mode: str) -> DataFrame:
    if mode == "inner":
        return df.filter(matched)
    if mode == "strict":
        # a filter, because an unused column would be pruned and never raise
        return df.filter(F.assert_true(matched, F.lit("sides have different lengths")).isNull())
    raise ValueError(f"unknown mode: {mode}")
