"""Language-code resolution.

A code dimension is a table of script-qualified codes (``script_code``, ``ord``), see
``sources.codes``. Dimensions come from driver-side lists or small files, so their size
is known to the optimizer and the joins need no hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import base_code, prefixes


def code_counts(dim: DataFrame) -> DataFrame:
    """Per base code: how many script codes it has, and the first of them in list order."""
    return dim.groupBy(base_code("script_code").alias("code")).agg(
        F.count(F.lit(1)).alias("n_match"),
        F.min_by("script_code", "ord").alias("script_code"),
    )


def unambiguous(dim: DataFrame) -> DataFrame:
    """``code, script_code`` of the base codes with exactly one script code."""
    return code_counts(dim).filter("n_match = 1").select("code", "script_code")


def match_codes(codes: DataFrame, dim: DataFrame, by: str = "base") -> DataFrame:
    """All script codes for every row of ``codes`` (column ``code``).

    One row per match, or one with a null ``script_code`` where there is none; ``n_match``
    says how many there are. ``by="prefix"`` accepts any leading part of a script code;
    the prefixes are expanded on the dimension's side, which keeps it an equi-join.
    """
    if by == "base":
        expanded = dim.select(base_code("script_code").alias("code"), "script_code")
    elif by == "prefix":
        expanded = dim.select(F.explode(prefixes("script_code")).alias("code"), "script_code")
    else:
        raise ValueError(f"unknown match: {by}")
    sizes = expanded.groupBy("code").agg(F.count(F.lit(1)).alias("n_match"))
    return (
        codes.join(expanded.join(sizes, "code"), "code", "left")
        .withColumn("n_match", F.coalesce("n_match", F.lit(0)))
    )


def match_status(codes: DataFrame, dim: DataFrame) -> DataFrame:
    """``code, n_match, script_code, status`` with one row per row of ``codes``; status is
    ``none``, ``one`` or ``ambiguous``."""
    n = F.coalesce("n_match", F.lit(0))
    return codes.join(code_counts(dim), "code", "left").select(
        *codes.columns,
        n.alias("n_match"),
        "script_code",
        F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous").alias("status"),
    )


def intersecting(codes: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(covered, matching)``.

    ``matching`` are the requested codes whose base occurs in the dimension, ambiguous
    ones included; ``covered`` are the script codes of the unambiguous ones, so it can
    be shorter.
    """
    bases = dim.select(base_code("script_code").alias("code"))
    matching = codes.select("code").join(bases, "code", "left_semi")
    covered = unambiguous(dim).join(matching, "code", "left_semi").select("script_code")
    return covered, matching


def resolve_anchor(dim: DataFrame, prefix: str) -> str:
    """The one script code that starts with ``prefix``."""
    found = dim.filter(F.col("script_code").startswith(prefix)).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{prefix!r} matches {'no' if not found else 'several'} script codes")
    return found[0].script_code


def missing_langs(langs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Distinct ``lang`` values that ``vocab`` (column ``lang``) does not have."""
    return langs.select("lang").distinct().join(vocab, "lang", "left_anti")


def require_vocabulary(langs: DataFrame, vocab: DataFrame) -> None:
    """Fail when a used language is not in the model's vocabulary."""
    missing = sorted(r.lang for r in missing_langs(langs, vocab).collect())
    if missing:
        raise ValueError(f"languages missing from the vocabulary: {missing}")


def to_iso639_1(df: DataFrame, code: str, iso: DataFrame) -> DataFrame:
    """Add ``iso639_1``: the two-letter code of the three-letter ``code``, or a text that
    says why there is none."""
    base = base_code(code)
    dim = iso.select(F.col("alpha_3").alias("_a3"), F.col("alpha_2").alias("_a2"))
    # The two messages
    answer = (
        F.when(F.col("_a3").isNull(), F.concat(F.lit("Invalid ISO 639-3 code: "), base))
        .when(F.col("_a2").isNull(), F.concat(F.lit("No ISO 639-1 code for "), base))
        .otherwise(F.col("_a2"))
    )
    joined = df.join(dim, base == F.col("_a3"), "left")
    return joined.select(*df.columns, answer.alias("iso639_1"))
