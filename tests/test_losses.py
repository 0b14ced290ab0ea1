"""Nothing is lost, overwritten or kept by mistake without a word."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import align, cache, counts, order, select
from pairloom.operators.orient import directions
from pairloom.plans.corpus import ingest
from pairloom.schema import STORED_PAIR
from pairloom.sinks import write_ordered, write_pairs
from pairloom.sources.tables import read_pairs
from pairloom.streaming import pairs as streams
from pairloom.workspace import new_dir, remove_dir, scratch_dir


def table(spark, *pairs, n=3, mark="s"):
    data = [
        (p, "train", i, f"{p} {mark}{i}", f"{p} t{i}", p.split("-")[0], p.split("-")[1])
        for p in pairs
        for i in range(n)
    ]
    return spark.createDataFrame(data, STORED_PAIR)


def land(spark, path, *pairs, **more):
    table(spark, *pairs, **more).write.mode("append").parquet(path)


def names(spark, out):
    return sorted(r.lang_pair for r in read_pairs(spark, out).collect())


def run(spark, src, out, checkpoint):
    streams.start_ingest(streams.read_stream(spark, src, max_files=1), out, checkpoint).awaitTermination()


def test_two_streams_share_a_store(spark, tmp_path):
    a, b, out = (str(tmp_path / x) for x in ("a", "b", "out"))
    land(spark, a, "ces-eng")
    land(spark, b, "deu-fra")
    run(spark, a, out, str(tmp_path / "cp-a"))
    run(spark, b, out, str(tmp_path / "cp-b"))
    assert names(spark, out) == ["ces-eng"] * 3 + ["deu-fra"] * 3


def test_a_lost_checkpoint_neither_loses_nor_doubles(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, "ces-eng")
    run(spark, src, out, str(tmp_path / "cp-1"))
    land(spark, src, "ces-fra")
    run(spark, src, out, str(tmp_path / "cp-2"))
    assert names(spark, out) == ["ces-eng"] * 3 + ["ces-fra"] * 3


def test_override_replaces_what_a_stream_wrote(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, "ces-eng", "ces-fra")
    run(spark, src, out, str(tmp_path / "cp"))
    write_pairs(table(spark, "ces-eng", n=2, mark="new"), out)
    write_pairs(table(spark, "ces-eng", n=1, mark="only"), out, "override")
    got = rows(read_pairs(spark, out), "source_text")
    assert got == [("ces-eng only0",)] + [(f"ces-fra s{i}",) for i in range(3)]


def test_skipped_splits_are_told(spark, tmp_path):
    for name, text in (("ces-eng/train.src", "a\n"), ("ces-eng/train.trg", ""), ("ces-fra/val.src", "b\n")):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    with pytest.warns(UserWarning, match=r"ces-eng/train \(only src\), ces-fra/val \(only src\)"):
        ingest(spark, str(tmp_path / "root"), str(tmp_path / "out"))


def test_nan_reaches_no_threshold(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", None)], "lang_pair string, score double")
    assert rows(select.filter_scores(df, 0.5)) == [("a", 1.0)]
    assert counts.score_counts(df, 0.5).filter("lang_pair = 'a'").first().n_kept == 1


def test_a_key_without_rows_ends_the_rounds(spark):
    df = table(spark, "a-b", "c-d").select("lang_pair", "ord")
    assert order.interleave(df, keys=["a-b", "c-d", "e-f"]).count() == 0
    assert order.interleave(df, keys=["a-b", "c-d"]).count() == 6


def test_shuffle_slots_follow_from_positions(spark):
    df = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("v"))
    assert rows(order.block_shuffle(df, block=7, rows=50)) == rows(order.block_shuffle(df, block=7))


def test_positions_beyond_the_announced_rows_are_an_error(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("pos"), F.lit("x").alias("v"))
    with pytest.raises(Exception, match="beyond the 9 rows"):
        write_ordered(df, str(tmp_path / "out"), 9, rows_per_file=3)


def test_lengths_of_scores_are_checked(spark):
    pairs = table(spark, "a-b", "c-d").select("lang_pair", "ord")
    align.check_lengths(pairs, pairs)
    with pytest.raises(ValueError, match="different lengths"):
        align.check_lengths(pairs, pairs.filter("lang_pair = 'a-b' or ord < 2"))
    with pytest.raises(ValueError, match="different lengths"):
        align.check_lengths(pairs, pairs.filter("lang_pair = 'a-b'"))


def test_null_texts_do_not_reach_the_translator(spark):
    req = spark.createDataFrame([(0, None), (1, "a")], "pos long, source_text string")
    known = spark.createDataFrame([], "source_text string, translation string")
    result, new = cache.translate(req, known, lambda texts: [t.upper() for t in texts])
    assert rows(result, "pos", "target_text") == [(0, None), (1, "A")]
    assert rows(new) == [("a", "A")]


def test_lists_are_full_across_frames(spark, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    texts = spark.createDataFrame([(f"t{i}",) for i in range(20)], "source_text string").coalesce(1)
    out = cache.apply_translator(texts, lambda chunk: [str(len(chunk))] * len(chunk), 8)
    assert sorted(r.translation for r in out.collect()) == ["4"] * 4 + ["8"] * 16
    assert cache.apply_translator(texts, lambda c: c, 8, tasks=5).rdd.getNumPartitions() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_not_dealt_by_language(spark, tmp_path):
    out = str(tmp_path / "store")
    write_pairs(table(spark, "ces-eng", "eng-fra"), out)
    langs = spark.createDataFrame([("fra",)], "lang string").repartition(2)
    known = spark.createDataFrame([("eng-fra",)], "lang_pair string").repartition(2)
    for df in (
        select.exclude_langs(read_pairs(spark, out), langs),
        select.select_pairs(read_pairs(spark, out), existing=known),
    ):
        assert "Exchange hashpartitioning" not in plan(df)
        assert rows(df, "lang_pair") == [("ces-eng",)] * 3


def test_both_directions_in_one_pass(spark, tmp_path):
    out = str(tmp_path / "store")
    write_pairs(table(spark, "ces-eng"), out)
    both = directions(read_pairs(spark, out), "ces")
    assert plan(both).count("FileScan") == 1 and both.count() == 6


def test_scratch_folders_are_removed(spark):
    with scratch_dir(spark, "try") as path:
        spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    kept = new_dir(spark, "try")
    spark.range(3).write.parquet(kept)
    remove_dir(spark, kept)


def test_paths_are_taken_apart_on_blocks_only(spark, tmp_path):
    from pairloom.sources.files import list_pairs, read_aligned

    for side in ("src", "trg"):
        path = tmp_path / "ces-eng" / f"train.{side}"
        path.parent.mkdir(exist_ok=True)
        path.write_text("a\nb\n")
    lines = read_aligned(spark, list_pairs(spark, str(tmp_path)))
    text_side = plan(lines).split("BroadcastExchange")[0]
    assert "url_decode" not in text_side and "regexp_extract" not in text_side
    assert lines.count() == 2


def test_languages_of_a_flat_corpus(spark):
    from pairloom.plans.training import resolve_flat_languages
    from pairloom.sources.codes import code_dimension

    dim = code_dimension(spark, ["ces_Latn", "eng_Latn", "zho_Hans", "zho_Hant", "fra_Latn"])
    asked = spark.createDataFrame([("eng",), ("zho",), ("tah",)], "code string")
    found = resolve_flat_languages(dim, "ces", asked)
    assert (found.anchor_code, found.covered, found.ambiguous) == ("ces_Latn", ["eng_Latn"], ["zho_Hans", "zho_Hant"])
    assert resolve_flat_languages(dim, "ces").covered == ["eng_Latn", "fra_Latn"]
