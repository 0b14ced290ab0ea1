import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom import sinks
from pairloom.operators import cache, skew
from pairloom.sources import cache as source

CACHE = "source_text string, translation string, ord long"


def entries(spark, *pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], CACHE)


def requests(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, source_text string")


def test_dedup(spark):
    df = entries(spark, ("x", "1"), ("y", "1"), ("x", "2"))
    assert rows(cache.dedup_cache(df), "source_text", "translation") == [("x", "2"), ("y", "1")]
    assert rows(cache.dedup_cache(df, literal=True), "source_text", "translation") == [("x", "2")]


def test_misses(spark):
    known = entries(spark, *((f"t{i}", f"T{i}") for i in range(3)))
    asked = requests(spark, "t0", "t1", "t2", "t3")
    assert rows(cache.misses(asked, known), "source_text") == [("t3",)]
    assert rows(cache.misses(asked, known, "batch", 2), "source_text") == [("t2",), ("t3",)]
    assert rows(cache.lookup(asked, known)) == [
        (0, "t0", "T0", True), (1, "t1", "T1", True), (2, "t2", "T2", True), (3, "t3", None, False),
    ]


def upper(calls):
    def fn(texts):
        for _ in texts:
            calls.add(1)
        return [t.upper() for t in texts]

    return fn


def test_translate_calls_once_per_missing_text(spark):
    calls = spark.sparkContext.accumulator(0)
    asked = requests(spark, "a", "b", "b", "c", "b")
    known = entries(spark, ("a", "known"))
    result, new = cache.translate(asked, known, upper(calls), batch=2)
    expected = [(0, "a", "known"), (1, "b", "B"), (2, "b", "B"), (3, "c", "C"), (4, "b", "B")]
    for _ in range(2):
        assert rows(result, "pos", "source_text", "target_text") == expected
        assert rows(new) == [("b", "B"), ("c", "C")]
    assert calls.value == 2


def test_translate_whole_batches(spark):
    asked = requests(spark, "a", "b", "a", "a", "c")
    known = entries(spark, ("a", "known"))
    result, new = cache.translate(
        asked, known, lambda ts: [t.upper() for t in ts], batch=2, mode="batch", drop_last=True
    )
    assert rows(new) == [("a", "A"), ("b", "B")]
    assert rows(result, "pos", "target_text") == [(0, "A"), (1, "B"), (2, "A"), (3, "A")]


def test_wrong_number_of_translations(spark):
    with pytest.raises(Exception, match="gave 0 translations"):
        cache.translate(requests(spark, "a"), entries(spark, ("x", "y")), lambda ts: [])


def test_hot_text(spark):
    n = 2000
    df = spark.range(n).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("source_text"),
    )
    hot = skew.hot_hashes(df, "source_text")
    assert hot == [df.filter("pos = 0").select(F.xxhash64("source_text")).first()[0]]
    known = df.filter("pos % 2 = 0").select("source_text").distinct().withColumn(
        "translation", F.upper("source_text")
    )
    plain = rows(cache.lookup(df, known, hot=()))
    assert rows(cache.lookup(df, known)) == plain and len(plain) == n
    spread = skew.text_join(df, known, "source_text", "left", hot)
    # the hot rows carry many salts, so they do not meet in one task
    salts = df.filter("pos % 3 = 0").select(F.pmod(F.xxhash64("pos"), F.lit(skew.SALTS))).distinct().count()
    assert salts > skew.SALTS / 2 and spread.count() == n


def test_store(spark, tmp_path):
    root = str(tmp_path)
    assert source.read_cache(spark, root, "org/m").count() == 0
    first = spark.createDataFrame([("a", "1"), ("b", "NA")], "source_text string, translation string")
    sinks.append_cache(first, root, "org/m", 0)
    sinks.append_cache(first.limit(1).withColumn("translation", F.lit("2")), root, "org/m", 1)
    kept = cache.dedup_cache(source.read_cache(spark, root, "org/m"))
    assert rows(kept, "source_text", "translation") == [("a", "2"), ("b", "NA")]
    assert source.read_cache(spark, root, "other").count() == 0


def test_tsv(spark, tmp_path):
    path = tmp_path / "cache.tsv"
    path.write_text('x\t1\n\n"q\tNA\nonly\na\tb\tc\nx\t2\n')
    assert rows(source.read_cache_tsv(spark, str(path))) == [(0, "x", "1"), (2, '"q', "NA"), (5, "x", "2")]
    assert rows(source.count_bad_lines(spark, str(path))) == [(5, 2)]


def test_requests_are_computed_once(spark):
    """Requests are read for missing texts, hot texts and answers, but made once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"t{i % 3}"

    asked = spark.range(20).select(F.col("id").alias("pos"), text.asNondeterministic()("id").alias("source_text"))
    result, _ = cache.translate(asked, entries(spark, ("t0", "T0")), lambda texts: [t.upper() for t in texts], batch=4)
    assert [r.target_text for r in result.orderBy("pos").collect()] == [f"T{i % 3}" for i in range(20)]
    assert made.value == 20


def test_texts_travel_only_if_asked_for(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    asked = spark.createDataFrame([(0, "x"), (1, None), (2, "y"), (3, "z")], "pos long, source_text string")
    known = cache.dedup_cache(cache.with_keys(entries(spark, ("x", "1"), ("x", "2"), (None, "n"), ("z", None))))
    found = cache.lookup(asked, known, ())
    assert rows(found) == [(0, "x", "2", True), (1, None, None, False), (2, "y", None, False), (3, "z", None, True)]
    plan = found.select("pos", "translation")._jdf.queryExecution().executedPlan().toString()
    # the cache is shuffled once, to be grouped and joined by its keys
    assert plan.count("Exchange hashpartitioning") == 2
