"""What the optimizer makes of the operators."""

import re

import pytest
from pyspark.sql import functions as F

from pairloom.operators import order, select
from pairloom.operators.align import zip_sides
from pairloom.operators.orient import orient, recode
from pairloom.operators.bleu import bleu_counts
from pairloom.operators.ordinal import head_per_pair
from pairloom.schema import STORED_PAIR
from pairloom.sinks import write_pairs
from pairloom.sources.codes import code_dimension
from pairloom.sources.tables import read_pairs


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    df = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "ces-eng").otherwise("eng-fra").alias("lang_pair"),
        F.lit("train").alias("split"),
        F.floor(F.col("id") / 2).alias("ord"),
        F.lit("s").alias("source_text"), F.lit("t").alias("target_text"),
        F.lit("eng").alias("source_lang"),
        F.when(F.col("id") % 2 == 0, "ces").otherwise("fra").alias("target_lang"),
    )
    write_pairs(df.select(*STORED_PAIR.names), out)
    return out


def test_store_reads_prune_folders_and_columns(spark, store):
    p = plan(read_pairs(spark, store, ["ces-eng"]).select("source_text"))
    assert "PartitionFilters: [isnotnull(" in p or "PartitionFilters: [lang_pair" in p
    assert re.search(r"ReadSchema: struct<source_text:string>", p)


def test_first_rows_skip_row_groups(spark, store):
    assert "LessThan(ord,40)" in plan(head_per_pair(read_pairs(spark, store), 40))


def test_flat_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.createDataFrame([("a", "b", "x", "y")], "src_text string, tgt_text string, src_lang string, tgt_lang string").write.parquet(path)
    p = plan(select.flat_to_pairs(spark.read.parquet(path), "x", "y,z"))
    assert "EqualTo(src_lang,x)" in p and "In(tgt_lang, [y,z])" in p


def test_normalising_does_not_shuffle(spark, store):
    dim = code_dimension(spark, ["ces_Latn", "eng_Latn", "fra_Latn"])
    p = plan(recode(orient(read_pairs(spark, store), "eng"), "eng_Latn", dim))
    scan_side = p[: p.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in scan_side


def test_interleave_does_not_shuffle(spark, store):
    p = plan(order.interleave(read_pairs(spark, store)))
    assert "LessThan(ord,1000)" in p
    scan_side = p[: p.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in scan_side


def test_shuffle_moves_rows_once(spark, store):
    mixed = order.interleave(read_pairs(spark, store))
    p = plan(order.block_shuffle(mixed, n=2000))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", p)
    assert len([e for e in exchanges if e.startswith("_slot")]) == 1
    # only the summary on the driver is put in one partition
    singles = re.findall(r"Exchange SinglePartition.*\n(.*)", p)
    assert all("LocalTableScan" in below for below in singles)


def test_zip_moves_both_sides_in_one_shuffle(spark):
    lines = spark.range(10).select(
        F.concat(F.lit("a-"), F.col("id") % 3).alias("lang_pair"),
        F.concat(F.lit("s"), F.col("id") % 2).alias("split"),
        F.when(F.col("id") % 2 == 0, "src").otherwise("trg").alias("side"),
        F.floor(F.col("id") / 2).alias("ord"), F.lit("t").alias("text"),
    )
    p = plan(zip_sides(lines))
    assert p.count("Exchange ") == 1 and "_chunk" in p


def test_bleu_shuffles_texts_not_grams(spark):
    df = spark.createDataFrame([(1, "g", "a b", "a b")], "segment_id long, grp string, hypothesis string, reference string")
    p = plan(bleu_counts(df, "grp"))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^,]*),", p)
    assert len(exchanges) == 2
    assert exchanges[-1].startswith("segment_id") and exchanges[0].startswith("grp")


@pytest.mark.parametrize("name", ["training_rows", "bleu_counts", "pad_batch", "cache_misses"])
def test_no_python_in_the_way(spark, name):
    import __spark_entry__ as entry

    p = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "Python" not in p and "Pandas" not in p
