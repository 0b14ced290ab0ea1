"""Selecting language pairs and rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import is_pair_name, left_code, right_code, substrings
from pairloom.operators.sizing import small_side


def names_code(pair: str, codes: Iterable[str], match: str = "code") -> Column:
    """Whether a pair name has one of ``codes``: as a whole code, or, with
    ``match="substring"``, anywhere in its text (so ``en`` finds ``eng-fra``)."""
    codes = list(codes)
    if match == "code":
        return left_code(pair).isin(codes) | right_code(pair).isin(codes)
    if match == "substring":
        hits = (F.col(pair).contains(c) for c in codes)
        return reduce(Column.__or__, hits, F.lit(False))
    raise ValueError(f"unknown match: {match}")


def pair_keys(pair: str, match: str = "code") -> Column:
    """The join keys that :func:`names_code` compares, as an array."""
    if match == "code":
        return F.array_distinct(F.array(left_code(pair), right_code(pair)))
    if match == "substring":
        return substrings(pair)
    raise ValueError(f"unknown match: {match}")


def select_pairs(
    catalog: DataFrame,
    existing: DataFrame | None = None,
    target: str | None = None,
    sources: Sequence[str] | None = None,
    match: str = "code",
) -> DataFrame:
    """Well-formed pairs that are not in ``existing`` and have ``target`` and one of
    ``sources``."""
    kept = catalog.filter(is_pair_name("lang_pair"))
    if existing is not None:
        # rows, too, may be selected with this, and must not be dealt out by their pair
        known = small_side(existing.select("lang_pair").distinct())
        kept = kept.join(known, "lang_pair", "left_anti")
    if target is not None:
        kept = kept.filter(names_code("lang_pair", [target], match))
    if sources:
        kept = kept.filter(names_code("lang_pair", sources, match))
    return kept


def pairs_with(catalog: DataFrame, codes: DataFrame, match: str = "code") -> DataFrame:
    """Catalog rows whose pair name has a code of the table ``codes``."""
    keyed = catalog.select("lang_pair").distinct().select(
        "lang_pair", F.explode(pair_keys("lang_pair", match)).alias("code")
    )
    found = keyed.join(codes.select("code"), "code", "left_semi").select("lang_pair")
    return catalog.join(found, "lang_pair", "left_semi")


def uncovered(requested: DataFrame, catalog: DataFrame, match: str = "code") -> DataFrame:
    """Requested codes that no pair name has."""
    keyed = catalog.select(F.explode(pair_keys("lang_pair", match)).alias("code"))
    return requested.join(keyed, "code", "left_anti")


def exclude_langs(df: DataFrame, langs: DataFrame) -> DataFrame:
    """Drop rows with a language of ``langs`` (column ``lang``) on either side. The list is broadcast
    when it is short, so that rows are not dealt out by their language."""
    banned = small_side(langs.select("lang").distinct())
    for side in ("source_lang", "target_lang"):
        df = df.join(banned, df[side] == banned["lang"], "left_anti")
    return df


def different_langs(df: DataFrame) -> DataFrame:
    return df.filter(F.col("source_lang") != F.col("target_lang"))


def filter_scores(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Rows whose score reaches the threshold."""
    return df.filter(reaches(F.col("score"), threshold))


def reaches(score: Column, threshold: float) -> Column:
    """Whether a score is a number at or above the threshold; NaN is not, though Spark sorts it last."""
    return (score >= F.lit(float(threshold))) & ~F.isnan(score)


def flat_to_pairs(
    df: DataFrame, src: str, tgts: Sequence[str] | str | None = None, literal: bool = False
) -> DataFrame:
    """Sentence pairs of a flat corpus from language ``src`` to the requested targets.

    ``literal`` keeps a target whose code occurs anywhere in the request text, instead
    of being one of its entries.
    """
    kept = df.filter(F.col("src_lang") == src)
    if tgts:
        if literal:
            text = tgts if isinstance(tgts, str) else ",".join(tgts)
            kept = kept.filter(F.contains(F.lit(text), F.col("tgt_lang")))
        else:
            wanted = tgts.split(",") if isinstance(tgts, str) else list(tgts)
            kept = kept.filter(F.col("tgt_lang").isin(wanted))
    return kept.withColumnsRenamed(
        {
            "src_text": "source_text",
            "tgt_text": "target_text",
            "src_lang": "source_lang",
            "tgt_lang": "target_lang",
        }
    )
