"""Token-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_ids(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def pad_right(ids: Column, length: Column, fill: int) -> Column:
    """``ids`` followed by ``fill`` up to ``length`` elements."""
    missing = (length - F.size(ids)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("int"), missing))


def attention_mask(ids: Column, length: Column) -> Column:
    return pad_right(F.array_repeat(F.lit(1), F.size(ids)), length, 0)


def mask_after_eos(ids: Column, eos_id: int, ignore_id: int) -> Column:
    """Replace everything behind the last ``eos_id``; without one, nothing changes."""
    size = F.size(ids)
    # array_position finds the first match, so look from the end
    from_end = F.array_position(F.reverse(ids), F.lit(eos_id).cast("int"))
    kept = F.when(from_end > 0, size - from_end + 1).otherwise(size).cast("int")
    return pad_right(F.slice(ids, F.lit(1), kept), size, ignore_id)


def gram_key(tokens: list[Column]) -> Column:
    """An n-gram as ``struct<n, a, b>``; ``n`` is null when one of its tokens is.

    ``a`` and ``b`` are two differently seeded 64-bit hashes. Equal keys mean equal grams
    (128 bits are compared, and only within one text pair), and keys of three numbers
    are grouped several times faster than texts.
    """
    n = len(tokens)
    return F.struct(
        F.when(tokens[-1].isNotNull(), n).alias("n"),
        F.xxhash64(*tokens).alias("a"),
        F.xxhash64(F.lit("b"), *tokens).alias("b"),
    )
