"""Codes, selection, orientation and positional joins."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom.operators import align, codes, counts, orient, select
from pairloom.operators.order import union_pairs
from pairloom.plans import training
from pairloom.sources import codes as source

DIM = ["ces_Latn", "zho_Hans", "zho_Hant", "eng_Latn"]
PAIR = "source_text string, target_text string, source_lang string, target_lang string"


@pytest.fixture
def dim(spark):
    return source.code_dimension(spark, DIM)


def names(spark, *pairs):
    return spark.createDataFrame([(p,) for p in pairs], "lang_pair string")


def test_code_matches(spark, dim):
    asked = source.code_requests(spark, ["ces", "zho", "tah"])
    assert rows(codes.match_status(asked, dim), "code", "n_match", "script_code", "status") == [
        ("ces", 1, "ces_Latn", "one"),
        ("tah", 0, None, "none"),
        ("zho", 2, "zho_Hans", "ambiguous"),
    ]
    assert rows(codes.match_codes(asked, dim), "code", "script_code", "n_match") == [
        ("ces", "ces_Latn", 1), ("tah", None, 0), ("zho", "zho_Hans", 2), ("zho", "zho_Hant", 2),
    ]
    covered, matching = codes.intersecting(asked, dim)
    assert rows(covered) == [("ces_Latn",)]
    assert rows(matching) == [("ces",), ("zho",)]


def test_prefix_matches(spark, dim):
    asked = source.code_requests(spark, ["ce", "zho_Hant", ""]).select(F.col("code"))
    raw = spark.createDataFrame([("ce",), ("zho_Hant",), ("",), ("x",)], "code string")
    assert rows(codes.match_codes(raw, dim, by="prefix"), "code", "script_code", "n_match") == [
        ("", None, 0), ("ce", "ces_Latn", 1), ("x", None, 0), ("zho_Hant", "zho_Hant", 1),
    ]
    assert rows(asked) == [("",), ("ce",), ("zho",)]


def test_anchor(spark, dim):
    assert codes.resolve_anchor(dim, "ces") == "ces_Latn"
    for bad in ("zho", "tah"):
        with pytest.raises(ValueError):
            codes.resolve_anchor(dim, bad)


def test_iso(spark):
    iso = source.iso_dimension(spark, [("ces", "cs"), ("eng", "en"), ("zho", "zh"), ("ace", None)])
    df = spark.createDataFrame([("ces_Latn",), ("zho_Hans",), ("ace",), ("xxx",)], "code string")
    assert rows(codes.to_iso639_1(df, "code", iso)) == [
        ("ace", "No ISO 639-1 code for ace"),
        ("ces_Latn", "cs"),
        ("xxx", "Invalid ISO 639-3 code: xxx"),
        ("zho_Hans", "zh"),
    ]


def test_vocabulary(spark):
    langs = spark.createDataFrame([("ces_Latn",), ("ces_Latn",), ("fra_Latn",)], "lang string")
    vocab = source.vocabulary(spark, ["ces_Latn"])
    assert rows(codes.missing_langs(langs, vocab)) == [("fra_Latn",)]
    with pytest.raises(ValueError, match="fra_Latn"):
        codes.require_vocabulary(langs, vocab)
    codes.require_vocabulary(langs, source.vocabulary(spark, ["ces_Latn", "fra_Latn"]))


def test_code_lists(spark, tmp_path):
    (tmp_path / "codes.txt").write_text("ces_Latn\n\n eng_Latn \r\nzho_Hans")
    assert source.read_codes(spark, str(tmp_path / "codes.txt")) == ["ces_Latn", "eng_Latn", "zho_Hans"]
    wide = spark.createDataFrame([(0, "a", "b")], "ord long, sentence_ces_Latn string, sentence_eng_Latn string")
    assert source.codes_of_wide_table(wide) == ["ces_Latn", "eng_Latn"]
    assert rows(source.codes_of_catalog(names(spark, "a-b", "b-c"))) == [("a",), ("b",), ("c",)]
    assert rows(source.code_requests(spark, "ces_Latn,eng")) == [("ces",), ("eng",)]


def test_select_pairs(spark):
    catalog = names(spark, "ces-eng", "eng-fra", "een-fra", "aaaa-eng", "eng", "eng-deu")
    existing = names(spark, "eng-deu", "x-y")
    assert rows(select.select_pairs(catalog, existing)) == [("ces-eng",), ("een-fra",), ("eng-fra",)]
    assert rows(select.select_pairs(catalog, target="eng", sources=["fra", "ces"])) == [("ces-eng",), ("eng-fra",)]
    assert rows(select.select_pairs(catalog, target="en", sources=["fra"])) == []
    assert rows(select.select_pairs(catalog, target="en", sources=["fra"], match="substring")) == [
        ("een-fra",), ("eng-fra",),
    ]
    assert rows(counts.catalog_counts(catalog, existing)) == [(6, 1, 5)]


def test_pairs_with_and_uncovered(spark):
    catalog = names(spark, "ces-eng", "eng-fra", "ces-ces")
    asked = spark.createDataFrame([("ces",), ("en",)], "code string")
    assert rows(select.pairs_with(catalog, asked)) == [("ces-ces",), ("ces-eng",)]
    assert len(rows(select.pairs_with(catalog, asked, "substring"))) == 3
    assert rows(select.uncovered(asked, catalog)) == [("en",)]
    assert rows(select.uncovered(asked, catalog, "substring")) == []


def test_orient(spark):
    df = spark.createDataFrame(
        [("A", "B", "eng", "ces"), ("A", "B", "ces", "eng"), ("A", "B", "deu", "fra")], PAIR
    )
    assert rows(orient.orient(df, "ces")) == [("A", "B", "ces", "eng"), ("B", "A", "ces", "eng")]
    assert ("B", "A", "fra", "deu") in rows(orient.orient(df, "ces", literal=True))
    back = orient.reverse(orient.reverse(df))
    assert rows(back) == rows(df) and back.columns == df.columns


def test_recode_drops_unclear_targets(spark, dim):
    df = spark.createDataFrame([("a", "b", "ces", t) for t in ("eng", "zho", "tah")], PAIR)
    assert rows(orient.recode(df, "ces_Latn", dim)) == [("a", "b", "ces_Latn", "eng_Latn")]


def test_directions(spark):
    df = spark.createDataFrame([("a", "b", "ces", "eng")], PAIR)
    assert rows(orient.directions(df, "ces")) == [
        ("a", "b", "ces", "eng", "ces->X"), ("b", "a", "eng", "ces", "X->ces"),
    ]
    assert rows(union_pairs([df, df])) == rows(df) * 2


def test_filters(spark):
    df = spark.createDataFrame([("a", "b", "ces", "eng"), ("a", "b", "ces", "ces"), ("a", "b", "fra", "ces")], PAIR)
    assert select.different_langs(df).count() == 2
    banned = spark.createDataFrame([("eng",), ("fra",)], "lang string")
    assert rows(select.exclude_langs(df, banned)) == [("a", "b", "ces", "ces")]


def test_flat(spark):
    df = spark.createDataFrame(
        [("a", "b", "ces_Latn", t) for t in ("eng_Latn", "fra_Latn", "Latn")] + [("a", "b", "x", "eng_Latn")],
        "src_text string, tgt_text string, src_lang string, tgt_lang string",
    )
    assert select.flat_to_pairs(df, "ces_Latn").count() == 3
    exact = select.flat_to_pairs(df, "ces_Latn", "eng_Latn,deu_Latn")
    assert rows(exact) == [("a", "b", "ces_Latn", "eng_Latn")] and exact.columns[0] == "source_text"
    literal = select.flat_to_pairs(df, "ces_Latn", "eng_Latn,deu_Latn", literal=True)
    assert rows(literal, "target_lang") == [("Latn",), ("eng_Latn",)]


def test_scores(spark):
    df = spark.createDataFrame([("a-b", i) for i in range(3)], "lang_pair string, ord long")
    scores = spark.createDataFrame(
        [("a-b", 0, 0.95), ("a-b", 1, 0.2), ("a-b", 2, 0.99)], "lang_pair string, ord long, score double"
    )
    kept = select.filter_scores(align.attach_scores(df, scores), 0.95)
    assert rows(kept) == [("a-b", 0, 0.95), ("a-b", 2, 0.99)]
    assert rows(counts.score_counts(scores, 0.95)) == [("a-b", 3, 2), (None, 3, 2)]
    assert rows(counts.pair_counts(df)) == [("a-b", 3), (None, 3)]
    for short in (scores.filter("ord < 2"), scores.unionByName(scores.withColumn("ord", F.col("ord") + 3))):
        with pytest.raises(Exception, match="different lengths"):
            align.attach_scores(df, short).count()
    assert align.attach_scores(df, scores.filter("ord < 2"), strict=False).count() == 2


def test_languages_of_a_request(spark, dim):
    catalog = names(spark, "ces-eng", "ces-zho", "ces-tah", "eng-fra", "ces-ces")
    found = training.resolve_languages(dim, catalog, "ces")
    assert found == training.Languages(
        "ces", "ces_Latn", ["eng_Latn"], ["ces-eng"], ["zho_Hans", "zho_Hant"]
    )
    asked = source.code_requests(spark, "eng")
    assert training.resolve_languages(dim, catalog, "ces", asked).ambiguous == []
    with pytest.raises(ValueError, match="deu"):
        training.resolve_languages(dim, catalog, "ces", source.code_requests(spark, "eng,deu"))


def test_eval_rows(spark):
    wide = spark.createDataFrame(
        [(i, f"c{i}", f"e{i}", f"f{i}") for i in range(5)],
        "ord long, sentence_ces_Latn string, sentence_eng_Latn string, sentence_fra_Latn string",
    )
    langs = training.Languages("ces", "ces_Latn", ["ces_Latn", "eng_Latn", "fra_Latn"], [], [])
    got = training.eval_rows(wide, langs, eval_batches=1, batch_size=2)
    assert rows(got, "pos", "source_text", "target_text", "target_lang") == [
        (0, "c0", "e0", "eng_Latn"), (1, "c0", "f0", "fra_Latn"),
        (2, "c1", "e1", "eng_Latn"), (3, "c1", "f1", "fra_Latn"),
    ]


def test_training_sizes(spark):
    stored = spark.range(10)
    assert rows(training.training_sizes(stored, stored.filter("id < 4"))) == [(10, 4)]
