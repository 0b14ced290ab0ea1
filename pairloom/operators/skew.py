"""Joins on texts, where one text may be a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that can be treated as hot; with so many, each of the others is a thousandth at most.
HOT_KEYS = 1000

#: Rows of one text that a task takes without splitting them, however many rows there are.
HOT_ROWS = 1_000_000

#: Ways a hot text is split.
SALTS = 64


def text_keys(text: str = "source_text") -> dict[str, Column]:
    """A text's name in lookups: 128 bits, in two halves."""
    return {"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second half"), F.col(text))}


def with_keys(df: DataFrame, text: str = "source_text") -> DataFrame:
    """``df`` with ``k1, k2``, which a stored cache has already."""
    return df if {"k1", "k2"} <= set(df.columns) else df.withColumns(text_keys(text))


def hot_hashes(df: DataFrame, text: str, share: float = 1 / 256) -> list[int]:
    """Hashes of the texts that make up more than ``share`` of the rows, or more than ``HOT_ROWS``: at
    most ``HOT_KEYS`` numbers, from one mergeable sketch, so no text is shuffled for it.

    The sketch may overrate a text; that only salts a text that did not need it.
    """
    found = df.agg(
        F.expr(f"approx_top_k(xxhash64({text}), {HOT_KEYS}, 65536)").alias("top"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    most = min(share * found.n, HOT_ROWS)
    return [t["item"] for t in found.top or [] if t["count"] > most]


def text_join(
    left: DataFrame,
    right: DataFrame,
    text: str,
    how: str = "left",
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Join ``left`` with ``right``, which has every ``text`` at most once.

    Rows with a hot text are dealt over ``SALTS`` partitions, and the one matching row
    of ``right`` is repeated for each of them; all other rows join as they are. Texts meet by
    their keys, so neither side's text travels unless the result is asked for it, and a ``right`` that is
    grouped by its ``k1, k2`` already is not shuffled again. Null texts meet nothing.
    """
    hot = hot_hashes(left, text) if hot is None else list(hot)
    keys = ["_k1", "_k2"]
    names = text_keys(text)
    second = F.when(F.col(text).isNotNull(), names["k2"])
    left = left.withColumns({"_k1": names["k1"], "_k2": second})
    named = with_keys(right, text)
    right = named.select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *[c for c in named.columns if c not in (text, "k1", "k2")]
    )
    if hot:
        is_hot = F.col("_k1").isin(hot)
        # from the row's own columns, so that a task run again deals the same way
        rest = [c for c in left.columns if c not in (*keys, text)]
        deal = F.pmod(F.xxhash64(*rest), F.lit(SALTS)) if rest else F.lit(0)
        left = left.withColumn("_salt", F.when(is_hot, deal).otherwise(0).cast("int"))
        salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        right = right.withColumn("_salt", F.explode(salts))
        keys.append("_salt")
    return left.join(right, keys, how).drop("_k1", "_k2", "_salt")
