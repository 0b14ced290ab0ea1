import gzip
import os

import pytest
from conftest import rows

from pairloom.plans.corpus import ingest
from pairloom.sources.files import choose_files, list_pairs, read_aligned, skipped_splits
from pairloom.sources.scores import read_scores
from pairloom.sources.tables import (
    pairs_without_split,
    read_pairs,
    read_parquet_ordered,
    stored_pairs,
    stored_splits,
)


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if name.endswith(".gz"):
        with gzip.open(path, "wb") as f:
            f.write(text.encode())
    else:
        with open(path, "wb") as f:
            f.write(text.encode())


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "corpus")


def read(spark, root, **options):
    return read_aligned(spark, list_pairs(spark, root), **options)


def test_pairs_become_rows(spark, root):
    put(root, "ces-eng/train.src", " a \r\nb\rc\n")
    put(root, "ces-eng/train.trg", "x\ny\nz")
    put(root, "toolong-eng/train.src", "q\n")
    put(root, "toolong-eng/train.trg", "q\n")
    got = rows(read(spark, root))
    assert got == [
        ("ces-eng", "train", 0, "a", "x", "ces", "eng"),
        ("ces-eng", "train", 1, "b", "y", "ces", "eng"),
        ("ces-eng", "train", 2, "c", "z", "ces", "eng"),
    ]


def test_plain_wins_over_gz_and_gz_fills_in(spark, root):
    for side in ("src", "trg"):
        put(root, f"ces-eng/train.{side}", "plain\n")
        put(root, f"ces-eng/train.{side}.gz", "packed\n")
        put(root, f"ces-fra/test.{side}.gz", "packed\n\nlast\n")
    got = rows(read(spark, root), "lang_pair", "split", "ord", "source_text")
    assert got == [
        ("ces-eng", "train", 0, "plain"),
        ("ces-fra", "test", 0, "packed"),
        ("ces-fra", "test", 1, ""),
        ("ces-fra", "test", 2, "last"),
    ]


def test_dev_is_stored_as_val(spark, root):
    for side in ("src", "trg"):
        put(root, f"ces-eng/dev.{side}", "dev\n")
        put(root, f"ces-fra/dev.{side}", "dev\n")
        put(root, f"ces-fra/val.{side}", "val\n")
    columns = ("lang_pair", "split", "source_text")
    assert rows(read(spark, root), *columns) == [
        ("ces-eng", "val", "dev"),
        ("ces-fra", "val", "val"),
    ]
    assert rows(read(spark, root, dev="ignore"), *columns) == [("ces-fra", "val", "val")]


def test_missing_and_empty_sides_are_skipped(spark, root):
    put(root, "ces-eng/train.src", "a\n")
    put(root, "ces-fra/train.src", "")
    put(root, "ces-fra/train.trg", "")
    catalog = list_pairs(spark, root)
    assert catalog.count() == 1
    assert choose_files(catalog).count() == 0
    assert read_aligned(spark, catalog).count() == 0
    # what is skipped is told: a side without lines counts as 0 lines
    assert rows(read_aligned(spark, catalog, mode="report")) == [("ces-eng", "train", 1, 0, 0, 1)]
    assert rows(skipped_splits(catalog)) == [("ces-eng", "train", "src")]
    with pytest.raises(Exception, match="different lengths"):
        read_aligned(spark, catalog, mode="strict").count()
    assert list_pairs(spark, root + "-none").count() == 0


def test_uneven_sides(spark, root):
    put(root, "ces-eng/train.src", "a\nb\nc\n")
    put(root, "ces-eng/train.trg", "x\ny\n")
    assert [r[0] for r in rows(read(spark, root), "source_text")] == ["a", "b"]
    assert rows(read(spark, root, mode="report")) == [("ces-eng", "train", 3, 2, 2, 1)]
    with pytest.raises(Exception, match="different lengths"):
        # no column is needed for a count, and the check still runs
        read(spark, root, mode="strict").count()


@pytest.mark.parametrize("bound", [200_000, 0])
def test_lines_keep_their_number_over_many_blocks(spark, root, conf, monkeypatch, bound):
    import pairloom.operators.ordinal as ordinal

    monkeypatch.setattr(ordinal, "BROADCAST_BLOCKS", bound)  # 0: not broadcast by hint
    conf("spark.sql.files.maxPartitionBytes", "4096")
    conf("spark.sql.files.openCostInBytes", "64")
    n = 5000
    put(root, "ces-eng/train.src", "".join(f"s{i}\n" for i in range(n)))
    put(root, "ces-eng/train.trg", "".join(f"t{i} {'x' * (i % 50)}\r\n" for i in range(n)))
    got = {r.ord: (r.source_text, r.target_text.split()[0]) for r in read(spark, root, mode="strict").collect()}
    assert got == {i: (f"s{i}", f"t{i}") for i in range(n)}


def test_a_side_can_be_part_files(spark, root):
    for side in ("src", "trg"):
        put(root, f"ces-eng/train.{side}/part-00000-x", f"{side}0\n{side}1\n")
        put(root, f"ces-eng/train.{side}/part-00001-x", f"{side}2\n")
        put(root, f"ces-eng/train.{side}/part-100000-x", f"{side}3\n")
        put(root, f"ces-eng/train.{side}/_SUCCESS", "")
    got = rows(read(spark, root), "ord", "source_text", "target_text")
    assert got == [(i, f"src{i}", f"trg{i}") for i in range(4)]


def test_ingest_resumes_and_overrides(spark, root, tmp_path):
    out = str(tmp_path / "store")
    for pair in ("ces-eng", "ces-fra", "deu-fra"):
        for side in ("src", "trg"):
            put(root, f"{pair}/train.{side}", f"{pair} old\n")
    assert rows(ingest(spark, root, out, sources=["eng"])) == [(3, 0, 3)]
    put(root, "ces-eng/train.src", "new\n")
    assert rows(ingest(spark, root, out, target="ces")) == [(3, 1, 2)]
    stored = rows(read_pairs(spark, out), "lang_pair", "source_text")
    assert stored == [("ces-eng", "ces-eng old"), ("ces-fra", "ces-fra old")]
    ingest(spark, root, out, sources=["eng"], override=True)
    stored = rows(read_pairs(spark, out), "lang_pair", "source_text")
    assert stored == [("ces-eng", "new"), ("ces-fra", "ces-fra old")]
    assert rows(stored_pairs(spark, out)) == [("ces-eng",), ("ces-fra",)]
    assert read_pairs(spark, out, split="test").count() == 0
    assert stored_pairs(spark, out + "-none").count() == 0


def test_pairs_without_a_split_are_named(spark, tmp_path):
    from pairloom.sinks import write_pairs

    out = str(tmp_path / "store")
    df = spark.createDataFrame(
        [("a-b", "test", 0, "s", "t", "a", "b"), ("a-c", "train", 0, "s", "t", "a", "c")],
        "lang_pair string, split string, ord long, source_text string, target_text string,"
        "source_lang string, target_lang string",
    )
    write_pairs(df, out)
    assert rows(stored_splits(spark, out)) == [("a-b", "test"), ("a-c", "train")]
    assert rows(pairs_without_split(stored_splits(spark, out))) == [("a-b",)]


def test_pair_of_any_size_is_written_by_several_tasks(spark, tmp_path, conf):
    from pyspark.sql import functions as F

    from pairloom.sinks import write_pairs

    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are tiny
    out = str(tmp_path / "store")
    df = spark.range(1000).select(
        F.lit("a-b").alias("lang_pair"), F.lit("train").alias("split"), F.col("id").alias("ord"),
        *(F.lit("x").alias(c) for c in ("source_text", "target_text", "source_lang", "target_lang")),
    )
    write_pairs(df, out, chunk=100)
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert 1 < len(files) <= 10
    assert read_pairs(spark, out).count() == 1000


def test_ordered_write_and_row_positions(spark, tmp_path):
    from pairloom.sinks import write_ordered

    out = str(tmp_path / "ordered")
    df = spark.range(1000).repartition(7).withColumnRenamed("id", "pos")
    write_ordered(df, out, 1000, rows_per_file=150)
    back = read_parquet_ordered(spark, out)
    assert back.filter("pos != ord").count() == 0
    assert back.count() == 1000
    sizes = sorted(r.n for r in back.groupBy((back.pos / 150).cast("int")).count().toDF("f", "n").collect())
    assert sizes == [100] + [150] * 6


def test_scores(spark, root, tmp_path):
    put(root, "one.txt", "0.95\n 0.2 \n0.99\n")
    put(root, "two/part-00000", "1\n")
    put(root, "two/part-00001", "0.5\n")
    paths = {"a-b": f"{root}/one.txt", "a-c": f"file:{root}/two/"}
    expected = [("a-b", 0, 0.95), ("a-b", 1, 0.2), ("a-b", 2, 0.99), ("a-c", 0, 1.0), ("a-c", 1, 0.5)]
    assert rows(read_scores(spark, paths)) == expected
    assert rows(read_scores(spark, list(paths.values()), ["a-b", "a-c"])) == expected
    with pytest.raises(ValueError):
        read_scores(spark, list(paths.values()), ["a-b"])
    put(root, "bad.txt", "0.5\nx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_scores(spark, {"a-b": f"{root}/bad.txt"}).collect()


def test_dev_files_are_written_from_pairs_made_once(spark, monkeypatch):
    from checks import queries

    plans, write = [], queries.sinks.write_ordered

    def recorded(df, *a, **b):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        write(df, *a, **b)

    monkeypatch.setattr(queries.sinks, "write_ordered", recorded)
    assert queries.dev_files(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 12 and not any("Join" in p or "Window" in p for p in plans)
