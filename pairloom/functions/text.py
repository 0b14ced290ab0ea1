"""Texts, pair names and language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes. F.trim without a list of
# characters removes only the plain space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

LINE_BREAKS = r"[\r\n]+"


def strip_text(text: Column | str) -> Column:
    """Remove Unicode whitespace at both ends. No regex: only the ends are looked at."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


def left_code(pair: Column | str) -> Column:
    return F.split(_col(pair), "-")[0]


def right_code(pair: Column | str) -> Column:
    return F.split(_col(pair), "-")[1]


def is_pair_name(name: Column | str) -> Column:
    """``a-b`` with exactly two parts of at most three characters each."""
    parts = F.split(_col(name), "-")
    return (F.size(parts) == 2) & (F.length(parts[0]) <= 3) & (F.length(parts[1]) <= 3)


def other_side(pair: Column | str, anchor: str, literal: bool = False) -> Column:
    """The code of ``pair`` that is not ``anchor``.

    ``literal`` deletes every occurrence of the anchor text and of ``-`` instead of
    comparing whole codes, so ``aaa-aaa`` gives an empty text there.
    """
    if literal:
        cut = F.replace(_col(pair), F.lit(anchor), F.lit(""))
        return F.replace(cut, F.lit("-"), F.lit(""))
    return F.when(left_code(pair) == anchor, right_code(pair)).otherwise(left_code(pair))


def base_code(code: Column | str) -> Column:
    """``ces_Latn`` -> ``ces``; a code without script is its own base."""
    return F.split_part(_col(code), F.lit("_"), F.lit(1))


def drop_script(code: Column | str) -> Column:
    """Like :func:`base_code`, but a code without script suffix is an error."""
    c = _col(code)
    return F.when(c.contains("_"), base_code(c)).otherwise(
        F.raise_error(F.concat(F.lit("code has no script suffix: "), c))
    )


def script_free(code: str) -> str:
    """:func:`drop_script` for one name."""
    base, suffix, _ = code.partition("_")
    if not suffix:
        raise ValueError(f"code has no script suffix: {code}")
    return base


def canonical_split(split: Column | str) -> Column:
    """``dev`` is stored as ``val``."""
    s = _col(split)
    return F.when(s == "dev", "val").otherwise(s)


def prefixes(text: Column | str) -> Column:
    """All non-empty prefixes; turns a starts-with join into an equi-join."""
    c = _col(text)
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n))


def substrings(text: Column | str) -> Column:
    """All distinct non-empty substrings of a short name; turns a containment join
    into an equi-join."""
    c = _col(text)
    size = F.length(c)
    by_start = F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(c, i, n)),
    )
    return F.array_distinct(F.flatten(by_start))


def forward_tag(anchor: str) -> Column:
    return F.lit(f"{anchor}->X")


def backward_tag(anchor: str) -> Column:
    return F.lit(f"X->{anchor}")


def model_key(name: str) -> str:
    """A model name as one path segment."""
    return name.replace("/", "-")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
