import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import rows

from pairloom.operators.bleu import bleu_counts, corpus_bleu


def segments(spark, *data):
    rows_ = [(i, *d) for i, d in enumerate(data)]
    return spark.createDataFrame(rows_, "segment_id long, grp string, hypothesis string, reference string")


def score(spark, *data):
    return dict(rows(corpus_bleu(segments(spark, *data), "grp")))


def test_ends_of_the_scale(spark):
    got = score(
        spark,
        ("same", "a b c d e", "a b c d e"),
        ("none", "a b c d e", "v w x y z"),
        ("short", "a b c", "a b c"),
        ("empty", "", "a b"),
        ("both empty", "", " \n"),
    )
    assert got.pop("same") == pytest.approx(100)
    assert got == {"none": 0, "short": 0, "empty": 0, "both empty": 0}


def test_clipping_and_brevity(spark):
    df = segments(
        spark,
        ("g", "the the the cat sat on mat", "the cat sat on the mat today ok"),
        ("g", "a b\nc  d", "a b c d"),
    )
    # clipped: "the" 2 of 3, then cat sat on mat; 2-grams "the cat", "cat sat", "sat on"
    assert rows(bleu_counts(df, "grp")) == [
        ("g", 1, 6 + 4, 11, 11, 12), ("g", 2, 3 + 3, 9, 11, 12), ("g", 3, 2 + 2, 7, 11, 12), ("g", 4, 1 + 1, 5, 11, 12),
    ]
    logs = sum(math.log(p) for p in (10 / 11, 6 / 9, 4 / 7, 2 / 5)) / 4
    expected = 100 * math.exp(logs + 1 - 12 / 11)
    assert dict(rows(corpus_bleu(df, "grp")))["g"] == pytest.approx(expected)


def test_counts_of_random_segments(spark):
    """Repeated words, texts alike, null texts and rows that share a segment, against plain counting; most grams are no rows."""
    rng = random.Random(5)

    def text():
        return rng.choice([None, "", " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))] + ["a b a b a b c"])

    data = [(rng.randint(0, 40), rng.choice("gh"), text(), text()) for _ in range(80)]
    df = spark.createDataFrame(data, "segment_id long, grp string, hypothesis string, reference string")

    def grams(words, n):
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    expected = []
    for g in "gh":
        ref_len = sum(len((r or "").split()) for _, grp, _, r in data if grp == g)
        for n in range(1, 5):
            sides = [defaultdict(Counter), defaultdict(Counter)]
            for key, grp, *texts in data:
                for side, t in zip(sides, texts):
                    if grp == g:
                        side[key].update(grams((t or "").split(), n))
            total = sum(sum(c.values()) for c in sides[0].values())
            matches = sum(sum((c & sides[1][k]).values()) for k, c in sides[0].items())
            expected.append([g, n, matches, total, None, ref_len])
    for row in expected:
        row[4] = expected["gh".index(row[0]) * 4][3]
    counted = bleu_counts(df, "grp")
    assert rows(counted) == [tuple(r) for r in expected]
    assert "array_intersect" in counted._jdf.queryExecution().executedPlan().toString()
