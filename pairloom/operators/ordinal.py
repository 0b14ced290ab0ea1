"""Positions: line numbers, dense renumbering, first-N.

None of these windows spans a whole file, pair or table. Rows are numbered inside
blocks of bounded size and the block's start is added from a small table of running
counts, so that one pair holding a third of all rows still spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.sizing import Summary, settle

#: Order values per numbering block: the most rows one sort group can hold.
BLOCK_WIDTH = 100_000

#: Slots of a run when a large table of counts is summed in two levels.
_FAN = 4096

#: File blocks up to which their offsets are broadcast: some 100 MB of short rows, and with
#: blocks of 128 MB the offsets of 128 TB of text, which is then not shuffled for it.
BROADCAST_BLOCKS = 1_000_000


def div(value: Column | str, by: int) -> Column:
    """Whole-number division; ``/`` would go through doubles."""
    return F.call_function("div", value if isinstance(value, Column) else F.col(value), F.lit(by))


def running_offsets(summary: Summary, keys: Sequence[str], slot: str = "_slot") -> DataFrame:
    """``keys, slot, offset``: the sum of ``n`` over all lower slots of the same keys.

    A small table of counts is summed by one window and broadcast. A large one is summed
    in two levels, inside runs of 4096 slots and then over the runs, so that it is not
    sorted in one task either.
    """
    keys = list(keys)
    counts = summary.df
    by_key = keys or [F.lit(0)]
    if summary.small:
        offsets = counts.select(*keys, slot, _sum_before("n", by_key, slot).alias("offset"))
        return F.broadcast(offsets)
    runs = counts.select(*keys, slot, "n", div(slot, _FAN).alias("_run"))
    inner = runs.withColumn("_in", _sum_before("n", [*keys, "_run"], slot))
    tops = (
        runs.groupBy(*keys, "_run")
        .agg(F.sum("n").alias("_n"))
        .select(*keys, "_run", _sum_before("_n", by_key, "_run").alias("_top"))
    )
    return inner.join(tops, [*keys, "_run"]).select(
        *keys, slot, (F.col("_in") + F.col("_top")).alias("offset")
    )


def _sum_before(value: str, keys: Sequence[Column | str], *order: Column | str) -> Column:
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def slot_counts(df: DataFrame, keys: Sequence[str], slot: Column) -> Summary:
    """``keys, _slot, n``: rows per slot, counted once.

    A row without a key or a position has no place. The count sees every row, so it is
    here that one is an error.
    """
    placed = reduce(and_, (c.isNotNull() for c in (slot, *map(F.col, keys))))
    checked = df.filter(F.assert_true(placed, F.lit("a row lacks its key or position")).isNull())
    by = [*keys, slot.cast("long").alias("_slot")]
    return settle(checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))


def rank_in_slots(
    df: DataFrame,
    keys: Sequence[str],
    slot: Column,
    order: Sequence[Column | str],
    out: str,
    counts: Summary | None = None,
) -> DataFrame:
    """Number the rows of each key 0, 1, ... by (slot, order).

    ``slot`` must be a whole number that rises with the wanted order and holds a bounded
    number of rows. One shuffle of the rows, on (keys, slot); ``counts`` are the
    :func:`slot_counts` of the same rows, taken in a pass of their own that reads
    nothing but the keys and the slot.
    """
    keys = list(keys)
    if counts is None:
        counts = slot_counts(df, keys, slot)
    offsets = running_offsets(counts, keys)
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    numbered = df.withColumn("_slot", slot.cast("long")).withColumn(
        "_rank", F.row_number().over(inside) - 1
    )
    placed = numbered.join(offsets, [*keys, "_slot"])
    kept = [c for c in df.columns if c != out]
    return placed.select(*kept, (F.col("offset") + F.col("_rank")).cast("long").alias(out))


def ordinal_counts(
    df: DataFrame, keys: Sequence[str], order: str = "ord", width: int = BLOCK_WIDTH
) -> Summary:
    """The counts :func:`dense_ordinal` works with, for callers that use them twice."""
    return slot_counts(df, keys, div(order, width))


def dense_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "ord",
    out: str = "ord",
    width: int = BLOCK_WIDTH,
    counts: Summary | None = None,
) -> DataFrame:
    """Renumber each key 0..n-1 by the integer column ``order``, which must be unique
    within the key. A null key or position is an error."""
    return rank_in_slots(df, keys, div(order, width), [order], out, counts)


def block_offsets(lines: DataFrame, keys: Sequence[str], named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``file, block, keys, _n, _first, _offset`` of each read block: the number of its first line within ``keys``."""
    blocks = named(
        lines.groupBy("file", "block").agg(
            F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first")
        )
    )
    # a longer shard name means later: numbers have at least five digits
    earlier = _sum_before("_n", keys or [F.lit(0)], F.length("shard"), "shard", "block")
    return blocks.select("file", "block", *keys, "_n", "_first", earlier.alias("_offset"))


def broadcast_blocks(df: DataFrame, max_blocks: int | None) -> DataFrame:
    """``df``, which has a row for each block at most, broadcast if the bound of their number allows it."""
    return F.broadcast(df) if max_blocks is not None and max_blocks <= BROADCAST_BLOCKS else df


def with_ordinal(
    lines: DataFrame,
    keys: Sequence[str],
    named: Callable[[DataFrame], DataFrame],
    max_blocks: int | None = None,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Line numbers within ``keys`` for lines as ``sources.files.raw_lines`` gives them.

    ``lines`` has ``file`` (its path as the reader tells it), ``block`` (start byte of the read
    block) and ``seq`` (increasing within a block). A first pass counts lines per block;
    ``named`` adds the ``keys`` and the ``shard`` to that small table, so paths are taken apart once
    for each block and not for each line. A line's number is then its block's offset plus its distance from the
    block's first line, which needs no sort and, as long as the table of blocks is small,
    no shuffle.

    ``max_blocks`` is a proven upper bound of the number of blocks, known from the file
    sizes. Up to a limit the table of blocks is broadcast; above it, or without a
    bound, the join is left to the optimizer. ``offsets`` are the :func:`block_offsets` of the same lines, for callers that
    use them twice.

    Both passes must cut files at the same bytes, which ``raw_lines`` sees to; every line is checked against its
    block and a mismatch is an error.
    """
    keys = list(keys)
    if offsets is None:
        offsets = block_offsets(lines, keys, named)
    offsets = broadcast_blocks(offsets, max_blocks)
    step = F.col("seq") - F.col("_first")
    joined = lines.join(offsets, ["file", "block"], "left")
    same_cut = F.col("_n").isNotNull() & step.between(0, F.col("_n") - 1)
    checked = joined.filter(
        F.assert_true(same_cut, F.lit("files were split differently in the two passes")).isNull()
    )
    kept = [c for c in lines.columns if c not in ("file", "block", "seq")]
    return checked.select(*keys, *kept, (F.col("_offset") + step).alias("ord"))


def head_per_pair(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first ``n`` rows of every pair; ``order`` must be dense, from 0."""
    return df.filter(F.col(order) < n)
