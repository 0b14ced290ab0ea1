"""The stored cache: runs, levels, narrow lookups, and a translator that can be restarted."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom import sinks
from pairloom.operators import bitmaps, cache
from pairloom.operators.align import attach_scores
from pairloom.operators.select import filter_scores
from pairloom.plans import training
from pairloom.schema import STORED_PAIR
from pairloom.sinks import write_pairs
from pairloom.sources.cache import cache_path, cache_runs, read_cache
from pairloom.sources.tables import read_pairs


def translations(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_text string, translation string")


def requests(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, source_text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Bitmaps -------------------------------------------------------------------------------


@pytest.mark.parametrize("max_slots", [None, 0])
def test_marked_rows_are_kept(spark, max_slots):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), (F.col("id") / 2).cast("long").alias("ord"), "id"
    )
    marked = df.filter("id % 7 = 0 or id > 99000").select("k", "ord")
    kept = bitmaps.keep_marked(df, marked.union(marked), ["k"], max_slots=max_slots)
    assert kept.columns == df.columns
    assert [r.id for r in kept.orderBy("id").collect()] == [i for i in range(100_000) if i % 7 == 0 or i > 99_000]
    assert bitmaps.keep_marked(df, marked.limit(0), ["k"]).count() == 0


def test_scores_reach_rows_as_bits(spark, tmp_path):
    data = [(p, "train", i, f"s{i}", f"t{i}", *p.split("-")) for p in ("a-b", "a-c") for i in range(50)]
    write_pairs(spark.createDataFrame(data, STORED_PAIR), str(tmp_path / "store"))
    pairs = read_pairs(spark, str(tmp_path / "store"))
    scores = spark.range(100).select(
        F.when(F.col("id") < 50, "a-b").otherwise("a-c").alias("lang_pair"), (F.col("id") % 50).alias("ord"),
        F.when(F.col("id") % 9 == 0, float("nan")).otherwise(F.col("id") / 100).alias("score"),
    )
    passing = filter_scores(scores, 0.3)
    kept = bitmaps.keep_marked(pairs, passing, ["lang_pair"])
    joined = attach_scores(pairs, passing, strict=False).drop("score")
    assert rows(kept, *STORED_PAIR.names) == rows(joined, *STORED_PAIR.names) and kept.count() > 50
    # no row of the store is moved
    assert "Exchange hashpartitioning" not in plan(kept).split("BroadcastExchange")[0]
    assert "SortMergeJoin" not in plan(kept)


# Lookups -------------------------------------------------------------------------------


@pytest.mark.parametrize("mode, batch", [("row", 2), ("batch", 2), ("batch", 3)])
def test_missing_texts_are_those_of_misses(spark, mode, batch):
    asked = requests(spark, "a", "b", None, "a", "c", "c", "d", "b", "e", "a")
    known = spark.createDataFrame([("a", "A", 0), ("c", "C", 1)], "source_text string, translation string, ord long")
    got = rows(cache.missing_texts(asked, known, mode, batch), "source_text")
    want = cache.misses(asked, known, mode, batch).filter("source_text is not null").select("source_text").distinct()
    assert got == rows(want)
    with pytest.raises(ValueError, match="unknown mode"):
        cache.missing_texts(asked, known, "other")


def test_texts_do_not_travel_to_a_lookup(spark, tmp_path, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    root, path = str(tmp_path / "cache"), str(tmp_path / "texts")
    sinks.append_cache(translations(spark, ("a", "A"), ("b", "B")), root, "m")
    requests(spark, "a", "b", "c", "c").write.parquet(path)
    asked = spark.read.parquet(path)
    plans = []
    settle = bitmaps.settle

    def seen(df, rows):
        plans.append(plan(df))
        return settle(df, rows)

    bitmaps.settle = seen
    try:
        missing = cache.missing_texts(asked, read_cache(spark, root, "m", keys=True))
    finally:
        bitmaps.settle = settle
    assert rows(missing, "source_text") == [("c",)]
    (lookup,) = plans
    assert "Exchange" in lookup
    # what an exchange deals is made of the columns of the operators right below it
    moved = re.findall(r"Exchange [^\n]*\n(?:[ +:-]*\*?(?:\(\d+\) )?(?:InputAdapter|WholeStageCodegen)[^\n]*\n)*([^\n]*)", lookup)
    assert moved and all("source_text" not in m and "translation" not in m for m in moved)
    # the cache's texts are not even read
    scans = re.findall(r"ReadSchema: (\S+)", lookup)
    assert any("k1" in s and "source_text" not in s and "translation" not in s for s in scans)
    assert "Exchange hashpartitioning" not in plan(missing).split("BroadcastExchange")[0]


# Runs and levels -----------------------------------------------------------------------


def test_levels_keep_the_last_translation(spark, tmp_path):
    root, want = str(tmp_path), {}
    for run in range(10):
        new = {f"t{i}": f"{run}:{i}" for i in range(30) if i % 10 == run or i % 7 == run}
        want |= new
        sinks.append_cache(translations(spark, *new.items()), root, "org/m", fan=3)
    runs = cache_runs(spark, root, "org/m")
    # ten appends of which nine were merged by threes, and those merged again
    assert sorted(lv for lv, _, _ in runs) == ["0", "2"]
    kept = cache.dedup_cache(read_cache(spark, root, "org/m"))
    assert dict(rows(kept, "source_text", "translation")) == want
    assert read_cache(spark, root, "other").count() == 0


def test_an_append_reads_nothing_that_is_there(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path), []
    for run in range(2):
        sinks.append_cache(translations(spark, (f"t{run}", "x")), root, "m", fan=3)
    runs = sinks.read_runs
    monkeypatch.setattr(sinks, "read_runs", lambda s, r, m, some: read.append(list(some)) or runs(s, r, m, some))
    before = {r[:2] for r in cache_runs(spark, root, "m")}
    sinks.append_cache(translations(spark, ("t3", "x")), root, "m", fan=10)
    assert all(not before & set(some) for some in read)
    # a merge reads the runs of its level, and buckets that they have
    read.clear()
    sinks.append_cache(translations(spark, ("t4", "x")), root, "m", fan=4)
    assert max(map(len, read)) == 4
    assert len(cache_runs(spark, root, "m")) == 1 and read_cache(spark, root, "m").count() == 4


def test_a_merge_that_was_overtaken_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for run in range(2):
        sinks.append_cache(translations(spark, (f"t{run}", "x")), root, "m", fan=9)
    add = sinks._add_run

    def late(rows_, root_, model, level, merged=()):
        if merged:
            monkeypatch.setattr(sinks, "_add_run", add)
            sinks.append_cache(translations(spark, ("late", "x")), root, "m", fan=9)
        add(rows_, root_, model, level, merged)

    monkeypatch.setattr(sinks, "_add_run", late)
    assert sinks.compact_cache(spark, root, "m", 2) == 0
    assert rows(read_cache(spark, root, "m"), "source_text") == [("late",), ("t0",), ("t1",)]
    assert sinks.compact_cache(spark, root, "m", 3) == 1
    assert rows(read_cache(spark, root, "m"), "source_text") == [("late",), ("t0",), ("t1",)]


def test_a_cache_without_a_log_is_read(spark, tmp_path):
    old = spark.createDataFrame([(0, "a", "A")], "ord long, source_text string, translation string")
    old.write.parquet(cache_path(str(tmp_path), "m"))
    assert rows(read_cache(spark, str(tmp_path), "m")) == [(0, "a", "A")]
    assert rows(cache.missing_texts(requests(spark, "a", "b"), read_cache(spark, str(tmp_path), "m", keys=True)), "pos") == [(1,)]


# Restarts ------------------------------------------------------------------------------


def test_a_translator_that_failed_is_asked_for_the_rest_only(spark, tmp_path):
    root = str(tmp_path)
    asked = requests(spark, *(f"t{i % 40}" for i in range(100)), None)
    keyed = cache.with_keys(asked.select("source_text").distinct().dropna())
    by_part = {r.source_text: r.p for r in keyed.select("source_text", F.pmod("k1", F.lit(4)).alias("p")).collect()}

    def fails(texts):
        if any(by_part[t] == 2 for t in texts):
            raise RuntimeError("gone")
        return [f"first {t}" for t in texts]

    with pytest.raises(Exception, match="gone"):
        training.teacher_stored(asked, root, "m", fails, batch=4, drop_last=False, portion=10)
    stored = dict(rows(read_cache(spark, root, "m"), "source_text", "translation"))
    assert stored == {t: f"first {t}" for t, p in by_part.items() if p < 2}

    calls = spark.sparkContext.accumulator(0)

    def works(texts):
        calls.add(len(texts))
        return [f"second {t}" for t in texts]

    made = training.teacher_stored(asked, root, "m", works, batch=4, drop_last=False, portion=10)
    assert calls.value == sum(p >= 2 for p in by_part.values())
    want = [(i, f"{'first' if by_part[f't{i % 40}'] < 2 else 'second'} t{i % 40}") for i in range(100)]
    assert rows(made, "pos", "target_text") == sorted([*want, (100, None)], key=repr)
    # nothing is missing any more
    again = training.teacher_stored(asked, root, "m", fails, batch=4, portion=10)
    assert again.count() == 100 and read_cache(spark, root, "m").count() == 40


def test_whole_batches_are_translated_again(spark, tmp_path):
    root = str(tmp_path)
    sinks.append_cache(translations(spark, ("a", "old"), ("c", "old")), root, "m")
    asked = requests(spark, "a", "b", "c", "c", "a", "a")
    made = training.teacher_stored(asked, root, "m", lambda t: ["new"] * len(t), batch=2, mode="batch", portion=1)
    assert rows(made, "pos", "target_text") == [(0, "new"), (1, "new"), (2, "old"), (3, "old"), (4, "new"), (5, "new")]


def test_merging_runs_shuffles_nothing(spark, tmp_path, monkeypatch):
    root, model, plans = str(tmp_path), "m", []
    add = sinks._add_run
    monkeypatch.setattr(sinks, "_add_run", lambda rows_, *a: (plans.append(plan(rows_)), add(rows_, *a)))
    for run in range(4):
        part = [(f"s{i}", f"{run}:{i}") for i in range(100) if i % 10 == run or i % 7 == run]
        sinks.append_cache(translations(spark, *part), root, model, run, fan=4)
    assert len(plans) == 5 and "Exchange hashpartitioning" not in plans[-1]
    assert [r[0] for r in cache_runs(spark, root, model)] == ["1"]
    expected = [(f"s{i}", f"{max(run for run in range(4) if i % 10 == run or i % 7 == run)}:{i}")
                for i in range(100) if i % 10 < 4 or i % 7 < 4]
    assert rows(read_cache(spark, root, model), "source_text", "translation") == sorted(expected)


@pytest.mark.parametrize("more", [[], [(5, "d"), (None, "e"), (9, None)], [(0, "b"), (7, "a"), (7, "a")], [(-3, "c")]])
def test_first_rows_of_texts(spark, more):
    from checks.queries import _first_rows

    data = [(7 - i if i < 3 else 40_000 + i, t) for i, t in enumerate("abcabx")] + more
    df = spark.createDataFrame(data, "ord long, source_text string")
    expected = {t: min((o for o, u in data if u == t and o is not None), default=None) for _, t in data}
    assert dict((r.source_text, r.ord) for r in _first_rows(df).filter("ord is not null").collect()) == {
        t: o for t, o in expected.items() if o is not None
    }
    assert _first_rows(df).filter("ord is not null").count() == sum(o is not None for o in expected.values())
