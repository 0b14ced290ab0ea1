import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.functions import text as fx
from pairloom.functions import tokens as ft


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(expr.alias("r")).first().r


SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]


def test_strip_removes_what_python_strips(spark):
    texts = [f"{c}a {c}b{c}" for c in SPACES] + ["", "  ", "".join(SPACES), "​x﻿", "é ñ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(fx.strip_text("t").alias("s")).collect()]
    assert len(SPACES) == 29
    assert got == [t.strip() for t in texts]


@pytest.mark.parametrize(
    "name,ok",
    [("aaa-bbb", True), ("aa-bb", True), ("a-", True), ("aaaa-bbb", False), ("aaa", False), ("a-b-c", False)],
)
def test_pair_names(spark, name, ok):
    assert one(spark, fx.is_pair_name("n"), n=("string", name)) is ok


@pytest.mark.parametrize(
    "pair,exact,literal",
    [("ces-eng", "eng", "eng"), ("bre-ces", "bre", "bre"), ("ces-ces", "ces", "")],
)
def test_other_side(spark, pair, exact, literal):
    assert one(spark, fx.other_side("p", "ces"), p=("string", pair)) == exact
    assert one(spark, fx.other_side("p", "ces", literal=True), p=("string", pair)) == literal


def test_script_suffix(spark):
    assert one(spark, fx.drop_script("c"), c=("string", "ces_Latn")) == "ces"
    assert one(spark, fx.base_code("c"), c=("string", "ces")) == "ces"
    with pytest.raises(Exception, match="no script suffix"):
        one(spark, fx.drop_script("c"), c=("string", "ces"))


def test_splits_and_keys(spark):
    assert one(spark, fx.canonical_split("s"), s=("string", "dev")) == "val"
    assert one(spark, fx.canonical_split("s"), s=("string", "train")) == "train"
    assert fx.model_key("org/model") == "org-model"
    assert one(spark, fx.prefixes("s"), s=("string", "abc")) == ["a", "ab", "abc"]
    assert sorted(one(spark, fx.substrings("s"), s=("string", "a-a"))) == ["-", "-a", "a", "a-", "a-a"]


@pytest.mark.parametrize(
    "ids,masked",
    [
        ([5, 2, 7, 2, 9, 9], [5, 2, 7, 2, -100, -100]),
        ([1, 3], [1, 3]),
        ([2], [2]),
        ([2, 4], [2, -100]),
        ([], []),
    ],
)
def test_mask_after_last_eos(spark, ids, masked):
    assert one(spark, ft.mask_after_eos(F.col("i"), 2, -100), i=("array<int>", ids)) == masked


def test_truncate(spark):
    assert one(spark, ft.truncate_ids(F.col("i"), 2), i=("array<int>", [1, 2, 3])) == [1, 2]
    assert one(spark, ft.truncate_ids(F.col("i"), 9), i=("array<int>", [1, 2, 3])) == [1, 2, 3]


def test_pad_batch(spark):
    from pairloom.operators.arrays import pad_batch

    df = spark.createDataFrame(
        [(0, [1], [4, 5, 6]), (1, [1, 2], [4]), (2, [], [])],
        "pos long, input_ids array<int>, labels array<int>",
    )
    got = rows(pad_batch(df, 0, -100, size=2), "pos", "batch_id", "input_ids", "attention_mask", "labels")
    assert got == [
        (0, 0, [1, 0], [1, 0], [4, 5, 6]),
        (1, 0, [1, 2], [1, 1], [4, -100, -100]),
        (2, 1, [], [], []),
    ]
