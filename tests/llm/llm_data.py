"""Fixtures: documents with what can go wrong in them."""

import pytest

#: Nulls, empty and very long texts, ties, repeated rows.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % 16] + str((seed * i) % 11) for i in range(n))


AWKWARD = [
    (1, prose(1, 60), "en", "a", 1),
    (1, prose(1, 60), "en", "a", 1),  # a repeated row
    (2, prose(1, 60).upper(), "en", "a", 1),
    (3, prose(1, 57) + " changed words here", "de", "a", 1),
    (4, None, "en", "a", None),
    (5, "", None, "b", 0),
    (6, "   \n\t ", "en", None, 6),
    (7, "one two three", "fr", "b", 13),
    (8, "one two three", "fr", "b", 13),
    (None, prose(2, 40), "en", "b", 1),
    (9, prose(3, 30000), "de", "c", 1),
    (10, "12 34 5!", "en", "c", 1),
    (11, "ünï ▁ cödé 漢字\r\nsecond  line\x0bend", "fr", "c", 1),
    (12, "x" * 5000, "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or give out.
CLASHING = ["score", "shard", "key", "word", "rate", "rank", "component_id", "letters", "held_out", "n"]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.selectExpr("*", *(f"'own' as {c}" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(spark, awkward):
    return awkward.limit(0)
