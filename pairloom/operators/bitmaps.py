"""Sets of positions as bitmaps, so that rows are chosen where they are read.

A table that says which positions to keep is narrow, the rows it speaks of are not. Positions are
gathered into bitmaps of ``WIDTH`` bits for each key and slot; with a bounded number of them the bitmaps are broadcast and a row
tests its own bit, so no row travels to meet one number. Beyond the bound rows meet their bitmap by shuffle on the slot, which is
even however large one key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordinal import div
from pairloom.operators.sizing import settle

#: Bits of a bitmap, which Spark's aggregate fixes at 4,096 bytes.
WIDTH = 32_768

#: Bitmaps that are broadcast: 32 MB, for a quarter of a billion positions.
BROADCAST_SLOTS = 8_192


def bitmaps(positions: DataFrame, keys: Sequence[str], pos: str = "ord") -> DataFrame:
    """``keys, _slot, _bits`` of a table of keys and positions from 0; repeats do no harm."""
    return positions.groupBy(*keys, div(pos, WIDTH).alias("_slot")).agg(
        F.bitmap_construct_agg(F.pmod(F.col(pos), F.lit(WIDTH))).alias("_bits")
    )


def has_bit(bits: str, pos: str) -> Column:
    """Whether the bitmap of a position's slot has its bit."""
    bit = F.pmod(F.col(pos), F.lit(WIDTH)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), div(bit, 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(bit, F.lit(8)).cast("int"))) != 0


def keep_marked(
    df: DataFrame, marked: DataFrame, keys: Sequence[str], pos: str = "ord", max_slots: int | None = None
) -> DataFrame:
    """Rows of ``df`` whose keys and position are in ``marked`` (any number of times)."""
    keys = list(keys)
    sets = settle(bitmaps(marked, keys, pos), BROADCAST_SLOTS if max_slots is None else max_slots)
    sets_df = F.broadcast(sets.df) if sets.small else sets.df
    slotted = df.withColumn("_slot", div(pos, WIDTH))
    return slotted.join(sets_df, [*keys, "_slot"]).filter(has_bit("_bits", pos)).select(*df.columns)
