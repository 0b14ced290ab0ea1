"""Stages that decide which rows stay: columns of any name, one row of each group, rates by id and text."""

import pytest
from conftest import rows

from llm_data import prose
from pairloom.llm import jaccard_join, mixing, selection

#: Names the stages use, or once used, inside.
INSIDE = "row id name grp n times head first all stays first_id first_n rated_id rated_key text_key".split()
INSIDE += ["_id", "_text", "_n", "_stays", "_key", "_times", "_one", "a b", "x.y", "tick`ed", "col"]


def wide(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    for i, name in enumerate(INSIDE):
        df = df.withColumn(name, df.doc_id * 100 + i)
    return df.repartition(3)


def test_rows_keep_columns_of_any_name(spark):
    data = [(1, prose(1, 40)), (2, prose(1, 40)), (3, prose(5, 40)), (4, None), (5, "")]
    df = wide(spark, data)
    kept = selection.one_of_each_group(df)
    assert kept.schema == df.schema or kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    for r in kept.collect():
        assert [r[name] for name in INSIDE] == [r.doc_id * 100 + i for i in range(len(INSIDE))]
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    mixed = selection.mixed(df, labels)
    assert mixed.columns == df.columns
    assert {r.doc_id for r in mixed.collect()} >= {1, 2, 3}
    assert all(r["x.y"] == r.doc_id * 100 + INSIDE.index("x.y") for r in mixed.collect())


def test_one_row_of_each_group_stays(spark):
    a, b = prose(1, 50), prose(2, 50)
    data = [(5, a), (1, a), (1, a), (5, b), (7, b), (None, b), (None, prose(3, 50)), (9, a + " more"), (9, "  "), (9, "  ")]
    kept = rows(selection.one_of_each_group(spark.createDataFrame(data, "doc_id long, text string")))
    assert kept == sorted([(1, a), (5, b), (None, prose(3, 50)), (9, "  ")], key=repr)
    assert selection.one_of_each_group(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rates_follow_id_and_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")], "doc_id long, text string")

    def rated(df, labels, targets):
        return df.filter("doc_id is not null").select(
            "doc_id", mixing.text_key(df.text).alias("key"), (df.text == "a").cast("double").alias("rate")
        )

    monkeypatch.setattr(selection, "rated", rated)
    monkeypatch.setattr(selection, "sparing", lambda rates, clean, others: rates)
    assert rows(selection.mixed(docs, None), "doc_id", "text") == [(1, "a"), (1, "a"), (None, "d")]


@pytest.mark.parametrize("share", [7, 100, 10**9])
def test_portions_of_a_range_share_alike(spark, monkeypatch, share):
    texts = [prose(i % 7, 40 + i % 5) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = rows(jaccard_join.jaccard_components(df))
    import numpy as np

    sent = []
    rng = np.random.default_rng(1)
    for _ in range(5):
        sizes = rng.integers(1, 9, 6).astype(np.uint32)
        keys = rng.integers(0, 40, int(sizes.sum())).astype(np.uint64)
        sets = rng.integers(1, 9, 6).astype(np.uint64)
        sent.append((sets.tobytes(), sizes.tobytes(), jaccard_join._pack48(keys)))

    def flat(found):
        return sorted(
            (p, s, c, w)
            for p, _, sids, counts, keys in found
            for s, c, w in zip(np.frombuffer(sids, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(keys, np.uint64))
        )

    portions = max(1, 200 // share)
    cut = [r for i in range(portions) for r in jaccard_join._shared_of(sent, 3, 8, i, portions)]
    assert flat(cut) == flat(jaccard_join._shared_of(sent, 3, 8, 0, 1))
    assert rows(jaccard_join.jaccard_components(df)) == whole
