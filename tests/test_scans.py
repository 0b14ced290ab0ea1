"""Scans of line files: cuts that stay the same between passes, gz files that are unpacked once, many keys."""

import gzip
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import align, order, sizing
from pairloom.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def put(path, lines, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = "".join(f"{x}\n" for x in lines).encode()
    path.write_bytes(gzip.compress(data) if packed else data)


def test_files_are_cut_alike_in_every_pass(spark, tmp_path, conf):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20_000)]
    for side in ("src", "trg"):
        put(tmp_path / "a-b" / f"train.{side}", [f"{side} {x}" for x in lines])
    conf("spark.sql.files.openCostInBytes", "1000")
    conf("spark.sql.files.minPartitionNum", "3")
    read = files.read_aligned(spark, files.list_pairs(spark, str(tmp_path)), mode="strict")
    few = spark.read.text(str(tmp_path / "a-b")).rdd.getNumPartitions()
    # between the passes, and between two runs of the second, the session is set otherwise
    for cores in ("7", "40"):
        conf("spark.sql.files.minPartitionNum", cores)
        assert spark.read.text(str(tmp_path / "a-b")).rdd.getNumPartitions() > few
        got = read.orderBy("ord").select("ord", "source_text", "target_text").collect()
        assert [tuple(r) for r in got] == [(i, f"src {x}".strip(), f"trg {x}".strip()) for i, x in enumerate(lines)]
    assert read.sparkSession is spark
    assert "Union" not in plan(files.raw_lines(spark, [str(tmp_path / "a-b")]))


def test_a_packed_file_is_unpacked_once(spark, tmp_path, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(3)
    made = {}
    for pair, n in (("a-b", 100), ("a-c", 5), ("b-c", 0), ("c-d", 33)):
        for side in ("src", "trg"):
            made[pair, side] = [f"{pair} {side} {i} {rng.random()}" for i in range(n)]
            put(tmp_path / pair / f"train.{side}.gz", made[pair, side], packed=True)
    # one side in several packed parts, which must be counted
    for part in range(3):
        put(tmp_path / "e-f" / "train.src" / f"part-0000{part}.gz", [f"{part} {i}" for i in range(4)], packed=True)
    put(tmp_path / "e-f" / "train.trg.gz", [f"t{i}" for i in range(12)], packed=True)
    read = files.read_aligned(spark, files.list_pairs(spark, str(tmp_path)), mode="strict")
    got = rows(read, "lang_pair", "ord", "source_text", "target_text")
    want = [
        (pair, i, s, t)
        for pair in ("a-b", "a-c", "c-d")
        for i, (s, t) in enumerate(zip(made[pair, "src"], made[pair, "trg"]))
    ] + [("e-f", i, f"{i // 4} {i % 4}", f"t{i}") for i in range(12)]
    assert got == sorted(want, key=repr)

    alone = files.list_pairs(spark, str(tmp_path)).filter("lang_pair = 'a-b'")
    numbered = files.numbered_lines(spark, alone)
    assert plan(numbered).count("FileScan text") == 1 and "HashAggregate" not in plan(numbered)


def test_runs_are_cut_by_bytes(spark, tmp_path, conf):
    conf("spark.sql.files.maxPartitionBytes", "65536b")
    conf("spark.sql.files.openCostInBytes", "1000")
    # lines of a thousand times the usual length in the middle, at other places on each side
    def line(side, i, lo, hi):
        return f"{side} {i} " + "x" * (8000 if lo <= i < hi else 8)

    made = {"src": [line("s", i, 1000, 1200) for i in range(3000)], "trg": [line("t", i, 1100, 1400) for i in range(3000)]}
    for side, of in made.items():
        put(tmp_path / "a-b" / f"train.{side}", of)
    catalog = files.list_pairs(spark, str(tmp_path))
    read = files.read_aligned(spark, catalog, mode="strict")
    got = read.orderBy("ord").select("ord", "source_text", "target_text").collect()
    assert [tuple(r) for r in got] == [(i, s, t) for i, (s, t) in enumerate(zip(made["src"], made["trg"]))]
    numbered = files._numbered(spark, catalog, "fallback", False)
    runs = align.zip_runs(numbered.lines, 500, numbered.cuts, numbered.max_cuts).groupBy("_chunk", "_part")
    sizes = runs.agg(F.sum(F.octet_length("text") + 1).alias("size"), F.min("ord"), F.max("ord"), F.count("*")).collect()
    assert sum(r["count(1)"] for r in sizes) == 6000
    assert all(r["max(ord)"] - r["min(ord)"] < 500 and r["count(1)"] <= 1000 for r in sizes)
    # a block of each side, and the line that each block's last one may run over by
    assert max(r["size"] for r in sizes) <= 2 * (65536 + 8010)
    # by rows alone a run would have been far over it
    assert sum(len(x) for of in made.values() for x in of[1000:1500]) > 20 * 65536
    # the shuffle is still one, and the cuts are broadcast
    p = plan(read)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert len([e for e in exchanges if "_part" in e]) == 1 and len(exchanges) == 2
    assert "SortMergeJoin" not in p


def test_plain_and_packed_sides_meet(spark, tmp_path):
    put(tmp_path / "a-b" / "train.src", ["one", "two"])
    put(tmp_path / "a-b" / "train.trg.gz", ["eins", "zwei"], packed=True)
    read = files.read_aligned(spark, files.list_pairs(spark, str(tmp_path)))
    assert rows(read, "ord", "source_text", "target_text") == [(0, "one", "eins"), (1, "two", "zwei")]


@pytest.mark.parametrize("small", [True, False])
def test_many_keys_take_turns(spark, monkeypatch, small):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 1000 if small else 2)
    df = spark.range(300).select(
        F.concat(F.lit("k"), F.lpad((F.col("id") % 100).cast("string"), 3, "0")).alias("lang_pair"),
        (F.col("id") / 100).cast("long").alias("ord"),
    )
    got = rows(order.interleave(df.repartition(5)), "pos", "lang_pair", "ord")
    assert got == sorted(((o * 100 + k, f"k{k:03d}", o) for k in range(100) for o in range(3)), key=repr)
