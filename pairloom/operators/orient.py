"""Direction and codes of sentence pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import backward_tag, forward_tag
from pairloom.operators.codes import unambiguous

#: Column pairs that change places with the direction.
SIDES = [("source_text", "target_text"), ("source_lang", "target_lang")]


def orient(
    df: DataFrame,
    anchor: str,
    sides: Sequence[tuple[str, str]] | None = None,
    literal: bool = False,
) -> DataFrame:
    """Turn every row so that ``anchor`` is its source language.

    A row with the anchor on neither side is dropped; ``literal`` turns and keeps it.
    """
    if not literal:
        df = df.filter((F.col("source_lang") == anchor) | (F.col("target_lang") == anchor))
    as_is = F.col("source_lang") == anchor
    turned = {}
    for a, b in _present(df, sides):
        turned[a] = F.when(as_is, F.col(a)).otherwise(F.col(b))
        turned[b] = F.when(as_is, F.col(b)).otherwise(F.col(a))
    return df.withColumns(turned)


def recode(df: DataFrame, anchor_code: str, dim: DataFrame) -> DataFrame:
    """Replace the base codes of oriented pairs by script codes: the source becomes
    ``anchor_code``, the target its only match. Rows whose target has no match or
    several are dropped."""
    known = unambiguous(dim).select(F.col("code").alias("target_lang"), "script_code")
    return (
        df.join(known, "target_lang")
        .withColumns({"source_lang": F.lit(anchor_code), "target_lang": F.col("script_code")})
        .select(*df.columns)
    )


def reverse(df: DataFrame, sides: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Swap source and target; column order stays."""
    swap = {}
    for a, b in _present(df, sides):
        swap[a], swap[b] = b, a
    return df.select(*(F.col(swap.get(c, c)).alias(c) for c in df.columns))


def directions(
    df: DataFrame, anchor: str, sides: Sequence[tuple[str, str]] | None = None
) -> DataFrame:
    """Forward and backward rows, told apart by ``objective_id``; the input is evaluated once."""
    swap = {}
    for a, b in _present(df, sides):
        swap[a], swap[b] = b, a
    forward = F.struct(*df.columns, forward_tag(anchor).alias("objective_id"))
    backward = F.struct(
        *(F.col(swap.get(c, c)).alias(c) for c in df.columns),
        backward_tag(anchor).alias("objective_id"),
    )
    return df.select(F.inline(F.array(forward, backward)))


def wide_to_pairs(df: DataFrame, src: str, tgts: Sequence[str]) -> DataFrame:
    """Rows of a wide table (``ord`` and ``sentence_<code>`` per language) as pairs from
    ``src`` to every other code of ``tgts``; reads only the columns it names."""
    wanted = [t for t in tgts if t != src]
    names = {t: f"sentence_{t}" for t in wanted}
    long = df.select("ord", F.col(f"sentence_{src}").alias("source_text"), *names.values()).unpivot(
        ["ord", "source_text"], list(names.values()), "_column", "target_text"
    )
    return long.select(
        "ord",
        "source_text",
        "target_text",
        F.lit(src).alias("source_lang"),
        F.replace("_column", F.lit("sentence_"), F.lit("")).alias("target_lang"),
    )


def _present(df: DataFrame, sides: Sequence[tuple[str, str]] | None) -> list[tuple[str, str]]:
    return [(a, b) for a, b in (SIDES if sides is None else sides) if a in df.columns]
