"""Positions: numbering, interleave, shuffle, batches."""

import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

import pairloom.operators.order as order
import pairloom.operators.ordinal as ordinal
import pairloom.operators.sizing as sizing


@pytest.fixture(params=["broadcast", "distributed"])
def either_way(request, monkeypatch):
    """Run a test with small summaries on the driver, and with none of them small."""
    if request.param == "distributed":
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    return request.param


def table(spark, **sizes):
    data = [(k, i) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(data, "lang_pair string, ord long")


def test_interleave_stops_with_the_shortest(spark, either_way):
    got = rows(order.interleave(table(spark, a=3, b=2, c=4)), "pos", "lang_pair", "ord")
    assert got == [(0, "a", 0), (1, "b", 0), (2, "c", 0), (3, "a", 1), (4, "b", 1), (5, "c", 1)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_dense_ordinal(spark, either_way, width):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"),
        (F.col("id") * F.col("id") % 10007 * 3 + 2**53).alias("ord"),
    ).dropDuplicates(["k", "ord"]).repartition(5)
    got = ordinal.dense_ordinal(df, ["k"], out="new", width=width).collect()
    expected = {}
    for r in sorted(df.collect(), key=lambda r: r.ord):
        expected.setdefault(r.k, []).append(r.ord)
    assert len(got) == df.count()
    assert all(expected[r.k][r.new] == r.ord for r in got)


def test_a_row_without_a_place_is_an_error(spark):
    for data in ([("a", None)], [(None, 1)]):
        df = spark.createDataFrame(data, "k string, ord long")
        with pytest.raises(Exception, match="lacks its key or position"):
            ordinal.dense_ordinal(df, ["k"])


def test_offsets_over_many_slots(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordinal, "_FAN", 8)
    df = spark.range(300).withColumn("ord", F.col("id") * 3)
    got = rows(ordinal.dense_ordinal(df, [], out="new", width=2), "id", "new")
    assert got == sorted(((i, i) for i in range(300)), key=repr)


def by_hand(n, block, seed):
    new = {}
    for start in range(0, n, block):
        part = range(start, min(n, start + block))
        ranked = sorted(part, key=lambda p: (hashlib.md5(f"{seed}-{p}".encode()).hexdigest(), p))
        new |= {p: start + i for i, p in enumerate(ranked)}
    return new


@pytest.mark.parametrize("width", [100_000, 4])
def test_block_shuffle(spark, either_way, monkeypatch, width):
    monkeypatch.setattr(order, "BLOCK_WIDTH", width)  # 4: blocks are cut by MD5 digits
    n = 210
    df = spark.range(n).withColumnRenamed("id", "pos")
    expected = by_hand(n, n // 4, 42)
    for parts in (1, 9):
        got = {r.old_pos: r.pos for r in order.block_shuffle(df.repartition(parts)).collect()}
        assert got == expected
    assert {r.old_pos: r.pos for r in order.block_shuffle(df, seed=1, block=100).collect()} == by_hand(n, 100, 1)


def test_batches(spark):
    df = spark.range(5).select(F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("t")).repartition(3)
    got = rows(order.batches(df, 2).select("batch_id", "n", "first_pos", "last_pos", F.col("rows.t").alias("t")))
    assert got == [
        (0, 2, 0, 1, ["t0", "t1"]), (1, 2, 2, 3, ["t2", "t3"]), (2, 1, 4, 4, ["t4"]),
    ]
    assert order.batches(df, 2, drop_last=True).count() == 2
    assert rows(order.full_batches(df, 2), "pos") == [(0,), (1,), (2,), (3,)]


def test_training_is_the_same_for_any_partitioning(spark):
    from pairloom.plans.training import Languages, training_rows
    from pairloom.sources.codes import code_dimension

    dim = code_dimension(spark, ["ces_Latn", "eng_Latn", "fra_Latn"])
    langs = Languages("ces", "ces_Latn", [], ["ces-eng", "ces-fra"], [])
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "ces-fra").otherwise("ces-eng").alias("lang_pair"),
        F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 3))
        .otherwise(F.col("id") - F.floor(F.col("id") / 3) - 1).alias("ord"),
        F.concat(F.lit("s"), "id").alias("source_text"),
        F.concat(F.lit("t"), "id").alias("target_text"),
        F.lit("ces").alias("source_lang"),
        F.when(F.col("id") % 3 == 0, "fra").otherwise("eng").alias("target_lang"),
    )
    scores = df.select("lang_pair", "ord", (F.col("ord") % 4 / 4).alias("score"))
    seen = []
    for parts in (1, 13):
        made = training_rows(df.repartition(parts), langs, dim, scores, 0.5)
        seen.append(rows(made, "pos", "lang_pair", "ord", "source_text"))
    assert seen[0] == seen[1]
    assert sorted(r[0] for r in seen[0]) == list(range(len(seen[0])))
    assert len(seen[0]) == 2 * 50  # 100 French rows, half of them good, and as many English
