"""Combining ordered tables: union, round-robin interleave, seeded block shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.ordinal import BLOCK_WIDTH, div, rank_in_slots, running_offsets, slot_counts
from pairloom.operators.sizing import Summary, settle
from pairloom.workspace import cut_lineage


def union_pairs(dfs: Iterable[DataFrame]) -> DataFrame:
    """Plain concatenation by column name. For pairs of one store, read them in one scan
    instead."""
    return reduce(DataFrame.unionByName, dfs)


def key_sizes(df: DataFrame, key: str = "lang_pair") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def with_keys(sizes: DataFrame, keys: Sequence[str] | None, key: str = "lang_pair") -> DataFrame:
    """``key, n`` of ``sizes`` for every one of ``keys``, 0 where there is no row."""
    sizes = sizes.select(key, "n")
    if keys is None:
        return sizes
    named = sizes.sparkSession.createDataFrame([(k,) for k in keys], f"{key} string")
    return named.join(sizes, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def interleave(
    df: DataFrame,
    key: str = "lang_pair",
    order: str = "ord",
    sizes: DataFrame | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Take one row of every key in turn, keys in alphabetical order, until the first key
    runs out. Adds ``pos``; ``order`` must be dense from 0 within the key.

    A row's place follows from its own position, the number of keys and the smallest
    key, so nothing is sorted and, with a small number of keys, nothing shuffled. The
    smallest key is known before the rows are read: of a store, which is sorted by
    position, the row groups behind it are skipped.

    ``sizes`` (``key, n``) can come from a cheaper place than ``df``, such as the counts
    of the table before it was renumbered.

    ``keys`` names all that take part. One that has no row left then counts as 0 rows, and as the
    shortest key ends the rounds, no row is given; without ``keys`` only those with rows are known.
    """
    sizes = settle(with_keys(key_sizes(df, key) if sizes is None else sizes, keys, key))
    total = sizes.df.agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("rounds")).first()
    turns = key_turns(sizes, key)
    return (
        df.filter(F.col(order) < F.lit(total.rounds or 0))
        .join(F.broadcast(turns) if sizes.small else turns, key)
        .withColumn("pos", (F.col(order) * total.keys + F.col("_turn")).cast("long"))
        .drop("_turn")
    )


def key_turns(sizes: Summary, key: str) -> DataFrame:
    """``key, _turn``: the place of each key in alphabetical order. A short list is numbered by one window; a long one
    is sorted by range, and each range's keys are counted from the ranges before."""
    if sizes.small:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key)) - 1
        return sizes.df.select(key, place.alias("_turn"))
    ranged = sizes.df.select(key).repartitionByRange(key).sortWithinPartitions(key)
    ranged = cut_lineage(
        ranged.withColumns({"_slot": F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()})
    )
    before = running_offsets(settle(ranged.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"))), [])
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(before, "_slot").select(key, (F.col("offset") + inside).alias("_turn"))


def block_shuffle(
    df: DataFrame,
    seed: int = 42,
    block: int | None = None,
    ratio: int = 4,
    n: int | None = None,
    pos: str = "pos",
    old: str = "old_pos",
    rows: int | None = None,
) -> DataFrame:
    """Permute rows within consecutive blocks of ``block`` positions.

    ``pos`` must be dense from 0; it is replaced by the new position and kept as
    ``old_pos``. Without ``block`` it is ``n // ratio``, where ``n`` is the number of
    rows (counted if not given). Inside a block, rows are ordered by the MD5 of
    ``seed-pos``: the same on every run and for every partitioning.

    A block can be a quarter of the table, so it is cut by the leading MD5 digits into
    slots of about a hundred thousand rows, and only those are sorted. A row's slot depends on
    nothing but its position, so with ``rows``, the number of rows (known if they were counted for
    ``n``), the slots are counted without reading ``df``.
    """
    if block is None:
        if n is None:
            n = rows = df.count()
        block = max(1, n // ratio)
    digits = 0
    while digits < 12 and block > BLOCK_WIDTH * 16**digits:
        digits += 1
    md5 = F.md5(F.concat(F.lit(f"{seed}-"), F.col(old).cast("string")))
    hashed = df.withColumnRenamed(pos, old).withColumn("_md5", md5)
    slot = div(old, block) * 16**digits
    if digits:
        slot = slot + F.conv(F.substring("_md5", 1, digits), 16, 10).cast("long")
    counts = None
    if rows is not None:
        positions = df.sparkSession.range(rows).select(F.col("id").alias(old)).withColumn("_md5", md5)
        counts = slot_counts(positions, [], slot)
    return rank_in_slots(hashed, [], slot, ["_md5", old], pos, counts).drop("_md5")


def batch_id(size: int, pos: str = "pos"):
    return div(pos, size)


def batches(df: DataFrame, size: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """One row per ``size`` consecutive positions: ``batch_id, n, first_pos, last_pos`` and
    ``rows``, the records in order. The last batch may be short, unless dropped."""
    rest = [c for c in df.columns if c != pos]
    grouped = (
        df.groupBy(batch_id(size, pos).alias("batch_id"))
        .agg(F.sort_array(F.collect_list(F.struct(pos, *rest))).alias("rows"))
        .select(
            "batch_id",
            F.size("rows").alias("n"),
            F.col("rows")[0][pos].alias("first_pos"),
            F.element_at("rows", -1)[pos].alias("last_pos"),
            "rows",
        )
    )
    return grouped.filter(F.col("n") == size) if drop_last else grouped


def full_batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Rows that belong to a complete batch: the trailing partial one is cut."""
    n = df.agg((F.max(pos) + 1).alias("n")).scalar()
    return df.filter(F.col(pos) < div(n, size) * size)
