"""One query per operator, over the whole of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    ANCHOR,
    CODES,
    DIMENSION,
    PAIRS,
    SIDES,
    UNEVEN_DIMENSION,
    documents,
    hashed,
    ids,
    one_line,
    pairs,
    table,
)
from pairloom import sinks
from pairloom.functions import text as fx
from pairloom.functions import tokens as ft
from pairloom.operators import align, arrays, bleu, cache, codes, counts, order, orient, select
from pairloom.operators.bitmaps import keep_marked
from pairloom.operators.ordinal import dense_ordinal, div, head_per_pair
from pairloom.plans import corpus, training
from pairloom.schema import STORED_PAIR
from pairloom.sources import cache as cache_source
from pairloom.sources import codes as code_source
from pairloom.sources import files, scores, tables
from pairloom.streaming import pairs as streams
from pairloom.workspace import cut_lineage, new_dir, set_down

THRESHOLD = 0.95
LOOSE_THRESHOLD = 0.5
EOS, IGNORE, PAD = 7, -100, 0


def joined(ids_column: str):
    return F.array_join(F.col(ids_column).cast("array<string>"), ",")


# Files and stores ---------------------------------------------------------------------


def write_line_files(spark: SparkSession, sf_dir: str) -> str:
    """The pairs as aligned line files, each side a folder of part files."""
    root = new_dir(spark, "lines")
    # written once, read for every side
    turned = cut_lineage(orient.orient(pairs(spark, sf_dir), ANCHOR, SIDES))
    sizes = {r.lang_pair: r.n for r in order.key_sizes(turned).collect()}
    for pair in PAIRS:
        first, _ = pair.split("-")
        rows = turned.filter(F.col("lang_pair") == pair)
        for side in ("src", "trg"):
            from_source = (first == ANCHOR) == (side == "src")
            column = "source_text" if from_source else "target_text"
            sinks.write_ordered(
                rows.select("ord", one_line(column).alias("value")),
                f"{root}/{pair}/train.{side}",
                sizes[pair],
                pos="ord",
                rows_per_file=100_000,
                fmt="text",
            )
    return root


def aligned_files(spark, sf_dir):
    catalog = files.list_pairs(spark, write_line_files(spark, sf_dir))
    lines = files.read_aligned(spark, catalog, mode="strict")
    return hashed(lines, "lang_pair", "split", "ord", "source_lang", "target_lang")


def aligned_report(spark, sf_dir):
    """Sides of different lengths: each language's documents against the English ones."""
    docs = documents(spark, sf_dir)
    names = {p.replace(ANCHOR, "").replace("-", ""): p for p in PAIRS}
    others = docs.filter(F.col("code") != ANCHOR)
    pair = F.when(F.lit(False), F.lit(None))
    for code, name in names.items():
        pair = pair.when(F.col("code") == code, name)
    trg = others.select(pair.alias("lang_pair"), F.lit("trg").alias("side"), "ord")
    src = docs.filter(F.col("code") == ANCHOR).select(
        F.explode(F.array(*map(F.lit, PAIRS))).alias("lang_pair"), F.lit("src").alias("side"), "ord"
    )
    return align.unmatched_counts(src.unionByName(trg).withColumn("split", F.lit("train")))


def aligned_gz(spark, sf_dir):
    """The line files packed with gzip, one file a side."""
    plain, root = write_line_files(spark, sf_dir), new_dir(spark, "gz")
    paths = [f"{plain}/{p}/train.{s}" for p in PAIRS for s in ("src", "trg")]
    lines = files.with_side(files.raw_lines(spark, paths))
    kept = cut_lineage(lines.select("lang_pair", "side", "shard", "seq", "text"))
    for pair in PAIRS:
        for side in ("src", "trg"):
            own = kept.filter((F.col("lang_pair") == pair) & (F.col("side") == side))
            packed = own.orderBy(F.length("shard"), "shard", "seq").select("text")
            packed.write.option("compression", "gzip").text(f"{root}/{pair}/train.{side}")
    lines = files.read_aligned(spark, files.list_pairs(spark, root), mode="strict")
    return hashed(lines, "lang_pair", "split", "ord", "source_lang", "target_lang")


def uneven_report(spark, sf_dir):
    """Files: German lacks its target side, French lacks the odd target lines."""
    root = write_line_files(spark, sf_dir)
    catalog = files.list_pairs(spark, root)
    gone = (F.col("lang_pair") == "deu-eng") & (F.col("side") == "trg")
    return files.read_aligned(spark, catalog.filter(~gone), mode="report")


def ingest_resume(spark, sf_dir):
    """Store one pair, then resume: the other pairs are added, the first stays as it is."""
    root, out = write_line_files(spark, sf_dir), new_dir(spark, "store")
    corpus.ingest(spark, root, out, sources=["deu"])
    corpus.ingest(spark, root, out, target=ANCHOR)
    return hashed(tables.read_pairs(spark, out, split="train"), "lang_pair", "split", "ord")


def ingest_override(spark, sf_dir):
    """A store with older rows of two pairs: German ones are replaced by what the files have, French ones stay."""
    root, out = write_line_files(spark, sf_dir), new_dir(spark, "store")
    arriving = files.read_aligned(spark, files.list_pairs(spark, root))
    older = arriving.filter(F.col("lang_pair") != "eng-spa").withColumn("target_text", F.lit("older"))
    sinks.write_pairs(older, out, chunk=None)
    corpus.ingest(spark, root, out, sources=["deu"], override=True)
    return hashed(tables.read_pairs(spark, out), "lang_pair", "split", "ord")


def dev_files(spark, sf_dir):
    """Line files of three splits: German has ``val`` and ``dev``, French only ``dev``, Spanish ``val`` and an empty ``dev``; what
    is stored as ``val`` comes from ``val`` where it has lines, else from ``dev``."""
    root = new_dir(spark, "splits")
    # written once, read for every file
    rows = set_down(pairs(spark, sf_dir).select("lang_pair", "ord", "source_text", "target_text"), "pairs")
    sizes = {r.lang_pair: r.n for r in order.key_sizes(rows).collect()}
    made = {"deu-eng": {"val": 0, "dev": 1}, "eng-fra": {"dev": 1, "train": 0}, "eng-spa": {"val": 2, "train": 0}}
    for pair, splits in made.items():
        for split, third in splits.items():
            # every third of dense positions is dense again
            own = rows.filter((F.col("lang_pair") == pair) & (F.col("ord") % 3 == third)).withColumn("ord", div("ord", 3))
            n = (sizes.get(pair, 0) + 2 - third) // 3
            for side, column in (("src", "source_text"), ("trg", "target_text")):
                value = one_line(column).alias("value")
                out = f"{root}/{pair}/{split}.{side}"
                sinks.write_ordered(own.select("ord", value), out, n, pos="ord", rows_per_file=100_000, fmt="text")
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{root}/eng-spa/dev.src")
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{root}/eng-spa/dev.trg")
    lines = files.read_aligned(spark, files.list_pairs(spark, root), mode="strict")
    return hashed(lines, "lang_pair", "split", "ord")


def _store(spark, sf_dir) -> str:
    """The pairs stored in three splits, German without a training split."""
    out = new_dir(spark, "store")
    rows = pairs(spark, sf_dir)
    split = F.when(F.col("lang_pair") == "deu-eng", "test").otherwise(
        F.when(F.col("ord") % 10 == 0, "val").otherwise("train")
    )
    sinks.write_pairs(rows.withColumn("split", split).select(*STORED_PAIR.names), out)
    return out


def stored_catalog(spark, sf_dir):
    return tables.stored_splits(spark, _store(spark, sf_dir))


def read_stored_split(spark, sf_dir):
    out = _store(spark, sf_dir)
    return hashed(tables.read_pairs(spark, out, ["deu-eng", "eng-fra"], "train"), "lang_pair", "ord")


def skipped_pairs(spark, sf_dir):
    return tables.pairs_without_split(tables.stored_splits(spark, _store(spark, sf_dir)))


def split_report(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    tenth = F.col("ord") % 10
    split = F.when(tenth == 0, "dev").when(tenth == 1, "test").otherwise("train")
    return counts.split_report(rows.withColumn("split", fx.canonical_split(split)))


def write_ordered(spark, sf_dir):
    """Interleaved rows written in order; the position comes back from the files."""
    rows = _interleaved(spark, sf_dir).select("pos", "lang_pair", "source_text", "target_text")
    out = new_dir(spark, "ordered")
    sinks.write_ordered(rows, out, rows.count(), rows_per_file=100)
    found = tables.read_parquet_ordered(spark, out).withColumnRenamed("ord", "file_pos")
    return hashed(found, "pos", "file_pos", "lang_pair")


def score_files(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("lang_pair", "ord", "score")
    sizes = {r.lang_pair: r.n for r in order.key_sizes(rows).collect()}
    root = new_dir(spark, "scores")
    for pair in PAIRS:
        sinks.write_ordered(
            rows.filter(F.col("lang_pair") == pair).select(
                "ord", F.col("score").cast("string").alias("value")
            ),
            f"{root}/{pair}.scores",
            sizes[pair],
            pos="ord",
            rows_per_file=100_000,
            fmt="text",
        )
    return scores.read_scores(spark, {p: f"{root}/{p}.scores" for p in PAIRS})


# Catalog ------------------------------------------------------------------------------


def _catalog(spark, sf_dir) -> DataFrame:
    """Made names: some well formed, some with a part that is too long."""
    number = F.regexp_replace("source", "src", "")
    return (
        table(spark, sf_dir, "documents")
        .select(F.explode(F.array(
            F.concat_ws("-", "lang", number), F.concat_ws("-", "lang", "source"), "source"
        )).alias("lang_pair"))
        .distinct()
    )


def _existing(spark, sf_dir) -> DataFrame:
    """Pairs of the documents labelled both toxic and bad."""
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1 AND quality = 0")
    return (
        table(spark, sf_dir, "documents")
        .join(toxic, "doc_id", "left_semi")
        .select(F.concat_ws("-", "lang", F.regexp_replace("source", "src", "")).alias("lang_pair"))
        .distinct()
    )


def catalog_filter(spark, sf_dir):
    return select.select_pairs(
        _catalog(spark, sf_dir), _existing(spark, sf_dir), "en", ["1", "12", "3"]
    )


def catalog_filter_substring(spark, sf_dir):
    return select.select_pairs(
        _catalog(spark, sf_dir), _existing(spark, sf_dir), "e", ["1", "3"], match="substring"
    )


def catalog_counts(spark, sf_dir):
    named = select.select_pairs(_catalog(spark, sf_dir))
    return counts.catalog_counts(named, _existing(spark, sf_dir))


def _numbers(spark, sf_dir) -> DataFrame:
    """Codes: the source numbers of the documents labelled bad."""
    bad = table(spark, sf_dir, "labels").filter("quality = 0")
    return (
        table(spark, sf_dir, "documents")
        .join(bad, "doc_id", "left_semi")
        .select(F.regexp_replace("source", "src", "").alias("code"))
        .distinct()
    )


def catalog_semi(spark, sf_dir):
    return select.pairs_with(
        select.select_pairs(_catalog(spark, sf_dir)), _numbers(spark, sf_dir)
    )


def catalog_semi_substring(spark, sf_dir):
    return select.pairs_with(
        select.select_pairs(_catalog(spark, sf_dir)), _numbers(spark, sf_dir), "substring"
    )


def uncovered_codes(spark, sf_dir):
    """Sources of the documents that no pair with a toxic document has."""
    requested = table(spark, sf_dir, "documents").select(
        F.regexp_replace("source", "src", "").alias("code")
    ).distinct()
    return select.uncovered(requested, _existing(spark, sf_dir))


def other_side(spark, sf_dir):
    named = select.select_pairs(_catalog(spark, sf_dir))
    return named.select(
        "lang_pair",
        fx.other_side("lang_pair", "en").alias("other"),
        fx.other_side("lang_pair", "e", literal=True).alias("rest"),
    )


# Codes --------------------------------------------------------------------------------


def _requests(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "code")


def code_match(spark, sf_dir):
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    found = codes.match_status(_requests(spark, sf_dir), dim)
    return found.groupBy("code", "n_match", "status").agg(F.count(F.lit(1)).alias("n_docs"))


def prefix_match(spark, sf_dir):
    """Two-letter codes against script codes."""
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    short = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("code"))
    return codes.match_codes(short, dim, by="prefix").groupBy("code", "n_match", "script_code").agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def _requested(spark, sf_dir) -> DataFrame:
    return _requests(spark, sf_dir).select("code").distinct()


def covered_codes(spark, sf_dir):
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    return codes.intersecting(_requested(spark, sf_dir), dim)[0]


def matching_codes(spark, sf_dir):
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    return codes.intersecting(_requested(spark, sf_dir), dim)[1]


def iso_lookup(spark, sf_dir):
    iso = code_source.iso_dimension(spark, [("deu", "de"), ("eng", "en"), ("spa", None)])
    rows = codes.to_iso639_1(_requests(spark, sf_dir), "code", iso)
    return rows.groupBy("code", "iso639_1").agg(F.count(F.lit(1)).alias("n_docs"))


def drop_script(spark, sf_dir):
    """Script codes of the recoded pairs without their script."""
    rows = _recoded(spark, sf_dir)
    return rows.select("lang_pair", "ord", fx.drop_script("target_lang").alias("base"))


def code_requests(spark, sf_dir):
    """Languages for requested targets only: the pairs that a run would read."""
    rows = pairs(spark, sf_dir)
    dim = code_source.code_dimension(spark, DIMENSION)
    targets = rows.filter("lang_pair <> 'eng-spa'").select(fx.other_side("lang_pair", ANCHOR).alias("code"))
    found = training.resolve_languages(dim, rows.select("lang_pair").distinct(), ANCHOR, targets.distinct())
    return rows.filter(F.col("lang_pair").isin(found.pairs)).groupBy("lang_pair").agg(F.count(F.lit(1)).alias("n"))


def requested_codes(spark, sf_dir):
    """Requested targets as one text, made of the script codes of recoded pairs."""
    codes = counts.langs_used(_recoded(spark, sf_dir)).collect()
    return code_source.code_requests(spark, ", ".join(sorted(r.lang for r in codes)))


def missing_langs(spark, sf_dir):
    vocab = code_source.vocabulary(spark, ["eng_Latn", "fra_Latn"])
    used = counts.langs_used(_recoded(spark, sf_dir))
    return codes.missing_langs(used, vocab)


def langs_used(spark, sf_dir):
    return counts.langs_used(_recoded(spark, sf_dir))


# Pairs --------------------------------------------------------------------------------


def zip_pairs(spark, sf_dir):
    return ids(pairs(spark, sf_dir))


def strip_text(spark, sf_dir):
    """Documents wrapped in characters that a plain trim leaves."""
    space = "\u3000\u2003\x1c\t\u00a0 "
    wrapped = F.concat(F.lit(space), F.col("text"), F.lit(space))
    stripped = fx.strip_text(wrapped)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(stripped).alias("md5"), F.length(stripped).alias("n")
    )


def _oriented(spark, sf_dir) -> DataFrame:
    return orient.orient(pairs(spark, sf_dir), ANCHOR, SIDES)


def _recoded(spark, sf_dir) -> DataFrame:
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    return orient.recode(_oriented(spark, sf_dir), "eng_Latn", dim)


def orient_pairs(spark, sf_dir):
    return ids(_oriented(spark, sf_dir))


def orient_literal(spark, sf_dir):
    """Every row whose source is not German is turned round, also those without German on either side."""
    turned = orient.orient(pairs(spark, sf_dir), "deu", SIDES, literal=True)
    return ids(turned)


def recode_pairs(spark, sf_dir):
    return ids(_recoded(spark, sf_dir))


def directions(spark, sf_dir):
    return ids(orient.directions(_oriented(spark, sf_dir), ANCHOR, SIDES), "objective_id")


def _scored(spark, sf_dir) -> DataFrame:
    """Every eleventh score is not a number."""
    score = F.when(F.col("ord") % 11 == 3, F.lit(float("nan"))).otherwise(F.col("score"))
    return pairs(spark, sf_dir).withColumn("score", score)


def attach_scores(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    with_score = align.attach_scores(rows.drop("score"), rows.select("lang_pair", "ord", "score"))
    return hashed(with_score, "lang_pair", "ord", "source_id", "score")


def score_filter(spark, sf_dir):
    kept = select.filter_scores(_scored(spark, sf_dir), THRESHOLD)
    return hashed(kept, "lang_pair", "ord", "source_id", "score")


def score_counts(spark, sf_dir):
    return counts.score_counts(_scored(spark, sf_dir), THRESHOLD)


def pair_counts(spark, sf_dir):
    return counts.pair_counts(pairs(spark, sf_dir))


def eval_exclude(spark, sf_dir):
    langs = spark.createDataFrame([("fra",), ("zho",)], "lang string")
    return ids(select.exclude_langs(pairs(spark, sf_dir), langs))


def _flat(spark, sf_dir) -> DataFrame:
    rows = pairs(spark, sf_dir)

    def script(c: str):
        return F.concat(F.col(c), F.lit("_Latn"))

    return rows.select(
        F.col("source_text").alias("src_text"),
        F.col("target_text").alias("tgt_text"),
        script("source_lang").alias("src_lang"),
        script("target_lang").alias("tgt_lang"),
        "source_id",
        "target_id",
    )


FLAT_TARGETS = "fra_Latn,spa_Latn"


def _flat_ids(df: DataFrame) -> DataFrame:
    return hashed(df, "source_id", "target_id", "source_lang", "target_lang")


def flat_filter(spark, sf_dir):
    return _flat_ids(select.flat_to_pairs(_flat(spark, sf_dir), "eng_Latn", FLAT_TARGETS))


def read_flat(spark, sf_dir):
    """A flat corpus through files, as Parquet and as JSON lines."""
    flat, out = _flat(spark, sf_dir), new_dir(spark, "flat")
    flat.drop("source_id", "target_id").write.parquet(f"{out}/parquet")
    flat.drop("source_id", "target_id").write.json(f"{out}/json")
    found = [
        select.flat_to_pairs(tables.read_flat(spark, f"{out}/{fmt}", fmt), "eng_Latn").withColumn("fmt", F.lit(fmt))
        for fmt in ("parquet", "json")
    ]
    return hashed(found[0].unionByName(found[1]), "fmt", "source_lang", "target_lang")


def flat_filter_literal(spark, sf_dir):
    """A request text that contains a code without naming it."""
    return _flat_ids(
        select.flat_to_pairs(_flat(spark, sf_dir), "eng_Latn", "xdeu_Latn,fra_Latn", literal=True)
    )


def _wide(spark, sf_dir) -> DataFrame:
    """One row per position; a language that has fewer documents lacks a cell there."""
    docs = documents(spark, sf_dir)
    cells = [
        F.max(F.when(F.col("code") == c, F.col("text"))).alias(f"sentence_{c}_Latn")
        for c in CODES.values()
    ]
    return docs.groupBy("ord").agg(*cells)


def wide_eval(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    found = orient.wide_to_pairs(wide, "eng_Latn", code_source.codes_of_wide_table(wide))
    return hashed(found, "ord", "source_lang", "target_lang")


# Order --------------------------------------------------------------------------------


def head_per_pair_query(spark, sf_dir):
    return ids(head_per_pair(pairs(spark, sf_dir), 40))


def dense_renumber(spark, sf_dir):
    kept = select.filter_scores(pairs(spark, sf_dir), LOOSE_THRESHOLD)
    numbered = dense_ordinal(kept.withColumn("old_ord", F.col("ord")), ["lang_pair"])
    return hashed(numbered, "lang_pair", "old_ord", "ord")


def _interleaved(spark, sf_dir) -> DataFrame:
    return order.interleave(pairs(spark, sf_dir))


def interleave(spark, sf_dir):
    return hashed(_interleaved(spark, sf_dir), "pos", "lang_pair", "ord")


def interleave_empty_key(spark, sf_dir):
    """Without Spanish rows there is no round if Spanish is to take part, and else two pairs alternate."""
    rows = pairs(spark, sf_dir).filter("lang_pair <> 'eng-spa'")
    none = order.interleave(rows, keys=PAIRS)
    two = order.interleave(rows, keys=[p for p in PAIRS if p != "eng-spa"])
    return hashed(none.unionByName(two), "pos", "lang_pair", "ord")


def union_languages(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return ids(order.union_pairs(rows.filter(F.col("lang_pair") == p) for p in PAIRS))


def block_shuffle(spark, sf_dir):
    shuffled = order.block_shuffle(_interleaved(spark, sf_dir))
    return hashed(shuffled, "pos", "old_pos", "lang_pair", "ord")


def _positions(spark, sf_dir) -> DataFrame:
    return dense_ordinal(table(spark, sf_dir, "documents"), [], "doc_id", out="pos")


def batches(spark, sf_dir):
    made = order.batches(_positions(spark, sf_dir).select("pos", "doc_id", "text"), 32)
    return made.select(
        "batch_id",
        "n",
        "first_pos",
        "last_pos",
        F.md5(F.array_join(F.transform("rows", lambda r: r["text"]), "|")).alias("md5"),
    )


def teacher_batches(spark, sf_dir):
    kept = order.full_batches(_positions(spark, sf_dir).select("pos", "doc_id", "text"), 32)
    return kept.select(order.batch_id(32).alias("batch_id"), "pos", "doc_id", F.md5("text").alias("md5"))


# Cache --------------------------------------------------------------------------------


def _cache_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.col("text").alias("source_text"),
        F.concat_ws(" ", "lang", "source").alias("translation"),
    )


def cache_dedup(spark, sf_dir):
    kept = cache.dedup_cache(_cache_rows(spark, sf_dir))
    return kept.select(F.md5("source_text").alias("source_md5"), "translation", "ord")


def cache_dedup_literal(spark, sf_dir):
    kept = cache.dedup_cache(_cache_rows(spark, sf_dir), literal=True)
    return kept.select(F.md5("source_text").alias("source_md5"), "translation")


def _known(spark, sf_dir) -> DataFrame:
    """A cache of the labelled documents."""
    labels = table(spark, sf_dir, "labels")
    return cache.dedup_cache(
        _cache_rows(spark, sf_dir).join(labels, F.col("ord") == labels["doc_id"], "left_semi")
    )


def _texts(spark, sf_dir) -> DataFrame:
    return _positions(spark, sf_dir).select("pos", "doc_id", F.col("text").alias("source_text"))


def cache_lookup(spark, sf_dir):
    found = cache.lookup(_texts(spark, sf_dir), _known(spark, sf_dir))
    return found.select("pos", "doc_id", "translation", "hit")


def cache_misses(spark, sf_dir):
    found = cache.misses(_texts(spark, sf_dir), _known(spark, sf_dir))
    return found.select("pos", "doc_id")


def cache_misses_batch(spark, sf_dir):
    found = cache.misses(_texts(spark, sf_dir), _known(spark, sf_dir), mode="batch", batch=2)
    return found.select("pos", "doc_id")


def _translator():
    # nested, so that Python workers need not import this module
    return lambda texts: ["t:" + t for t in texts]


def _answers(df: DataFrame) -> DataFrame:
    return df.select("pos", "doc_id", F.md5("target_text").alias("target_md5"))


def teacher_apply(spark, sf_dir):
    result, _ = cache.translate(_texts(spark, sf_dir), _known(spark, sf_dir), _translator())
    return _answers(result)


def teacher_apply_batch(spark, sf_dir):
    """Whole batches are computed again, and the partial last one is cut."""
    result, _ = cache.translate(
        _texts(spark, sf_dir), _known(spark, sf_dir), _translator(), 32, "batch", drop_last=True
    )
    return _answers(result)


def cache_store(spark, sf_dir):
    """Two runs with a stored cache: what the first adds, the second finds."""
    root, model = new_dir(spark, "cache"), "some/model"
    texts = _texts(spark, sf_dir)
    for run in range(2):
        known = cache.dedup_cache(cache_source.read_cache(spark, root, model))
        part = texts.filter(F.col("pos") % 3 <= 2 * run)
        _, new_rows = cache.translate(part, known, _translator())
        sinks.append_cache(new_rows, root, model, start=run)
    stored = cache_source.read_cache(spark, root, model)
    return stored.select("ord", F.md5("source_text").alias("source_md5"), "translation").select(
        "ord", "source_md5", F.md5("translation").alias("target_md5")
    )


def teacher_restart(spark, sf_dir):
    """A translator that is gone when it meets a certain text; the next one, which marks its work, gets what is left."""
    root, model = new_dir(spark, "cache"), "some/model"
    texts = set_down(_texts(spark, sf_dir), "texts")
    keyed = cache.with_keys(texts)
    # a text of the third of four portions
    last = keyed.filter(F.pmod("k1", F.lit(4)) == 2).agg(F.min("source_text")).first()[0]
    portion = -(-keyed.select("k1", "k2").distinct().count() // 4)

    def fails(chunk: list[str]) -> list[str]:
        if last in chunk:
            raise RuntimeError("the translator is gone")
        return ["t:" + t for t in chunk]

    try:
        training.teacher_stored(texts, root, model, fails, drop_last=False, portion=portion)
    except Exception as e:
        if "the translator is gone" not in str(e):
            raise
    made = training.teacher_stored(
        texts, root, model, lambda chunk: ["again:" + t for t in chunk], drop_last=False, portion=portion
    )
    return _answers(made.withColumn("target_text", F.regexp_replace("target_text", "^(t|again):", ""))).withColumn(
        "kept", F.lit(cache_source.read_cache(spark, root, model).filter("translation like 't:%'").count() > 0)
    )


def _first_rows(rows: DataFrame) -> DataFrame:
    """``source_text, ord``: every text once, with its smallest position. Where positions tell rows apart they are found by
    the texts' keys and marked, and texts stay where they are read; else the texts meet, once."""
    if not rows.groupBy("ord").count().filter("count > 1 or ord < 0").isEmpty():
        return set_down(rows.groupBy("source_text").agg(F.min("ord").alias("ord")), "first")
    firsts = cache.with_keys(rows).groupBy("k1", "k2").agg(F.min("ord").alias("ord")).filter("ord is not null")
    return keep_marked(rows.select("source_text", "ord"), firsts, [])


def cache_levels(spark, sf_dir):
    """Ten appends, each with some texts of the ones before: runs are merged on the way, and the last translation counts."""
    root, model, rows = new_dir(spark, "cache"), "some/model", _cache_rows(spark, sf_dir)
    first = _first_rows(rows)
    for run in range(10):
        part = first.filter((F.col("ord") % 10 == run) | (F.col("ord") % 7 == run))
        marked = F.concat(F.lit(f"{run}:"), "source_text")
        sinks.append_cache(part.select("source_text", marked.alias("translation")), root, model, run, fan=4)
    # rows meet by the texts' stored keys; of the texts only what is shown goes along
    stored = cache_source.read_cache(spark, root, model, keys=True).withColumns(
        {c: F.md5(c) for c in ("source_text", "translation")}
    )
    kept = cache.dedup_cache(stored)
    return kept.select(F.col("source_text").alias("source_md5"), F.col("translation").alias("target_md5"), "ord")


def _write_tsv(spark, sf_dir) -> str:
    out = new_dir(spark, "tsv")
    field = F.regexp_replace("text", r"[\t\r\n]+", " ")
    line = F.concat_ws(
        "\t",
        field,
        F.concat_ws(" ", "lang", "source"),
        F.when(F.col("doc_id") % 7 == 0, "extra"),
    )
    rows = _positions(spark, sf_dir).select("pos", line.alias("value"))
    sinks.write_ordered(rows, out, rows.count(), rows_per_file=100_000, fmt="text")
    return out


def cache_tsv(spark, sf_dir):
    good = cache_source.read_cache_tsv(spark, _write_tsv(spark, sf_dir))
    return good.select("ord", F.md5("source_text").alias("source_md5"), "translation")


def cache_bad_lines(spark, sf_dir):
    return cache_source.count_bad_lines(spark, _write_tsv(spark, sf_dir))


# Arrays -------------------------------------------------------------------------------


def _token_rows(spark, sf_dir) -> DataFrame:
    """Lengths as token ids: of the words of a text, and of its lines as labels."""

    def lengths(text):
        return F.transform(F.split(text, " "), lambda w: F.length(w).cast("int"))

    return _positions(spark, sf_dir).select(
        "pos",
        lengths(F.col("text")).alias("input_ids"),
        F.transform(F.split("text", "\n"), lambda w: F.length(w).cast("int")).alias("labels"),
    )


def truncate_ids(spark, sf_dir):
    short = ft.truncate_ids(F.col("input_ids"), 128)
    return _token_rows(spark, sf_dir).withColumn("input_ids", short).select(
        "pos", F.size("input_ids").alias("n"), joined("input_ids").alias("ids")
    )


def pad_batch(spark, sf_dir):
    padded = arrays.pad_batch(_token_rows(spark, sf_dir), PAD, IGNORE, size=8)
    return padded.select(
        "pos",
        "batch_id",
        F.size("input_ids").alias("n"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        F.md5(joined("attention_mask")).alias("mask_md5"),
        F.md5(joined("labels")).alias("labels_md5"),
    )


def mask_after_eos(spark, sf_dir):
    masked = ft.mask_after_eos(F.col("input_ids"), EOS, IGNORE)
    return _token_rows(spark, sf_dir).withColumn("input_ids", masked).select(
        "pos", F.size("input_ids").alias("n"), F.md5(joined("input_ids")).alias("ids_md5")
    )


# BLEU ---------------------------------------------------------------------------------


def _segments(spark, sf_dir) -> DataFrame:
    """Each document as the reference of the one after it in its language."""
    docs = documents(spark, sf_dir)
    reference = docs.select("lang", "ord", F.col("text").alias("reference"))
    hypothesis = docs.select(
        "lang", (F.col("ord") - 1).alias("ord"), F.col("text").alias("hypothesis"),
        F.col("doc_id").alias("segment_id"),
    )
    return align.zip_rows(hypothesis, reference, ["lang", "ord"])


def bleu_counts(spark, sf_dir):
    return bleu.bleu_counts(_segments(spark, sf_dir), "lang")


def corpus_bleu(spark, sf_dir):
    found = bleu.corpus_bleu(_segments(spark, sf_dir), "lang")
    return found.select("lang", F.round("score", 6).alias("score"))


# Streams ------------------------------------------------------------------------------


def stream_normalize(spark, sf_dir):
    store, out = _store(spark, sf_dir), new_dir(spark, "stream")
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    stream = streams.read_stream(spark, store, max_files=2)
    normal = streams.stream_normalize(stream, ANCHOR, "eng_Latn", dim)
    streams.start_append(normal, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return hashed(
        spark.read.schema(STORED_PAIR).parquet(f"{out}/rows"),
        "lang_pair", "split", "ord", "source_lang", "target_lang",
    )


def stream_flat(spark, sf_dir):
    flat, out = new_dir(spark, "flat"), new_dir(spark, "stream")
    _flat(spark, sf_dir).drop("source_id", "target_id").write.parquet(flat)
    stream = streams.stream_flat(streams.read_flat_stream(spark, flat), "eng_Latn", FLAT_TARGETS)
    streams.start_append(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return hashed(spark.read.parquet(f"{out}/rows"), "source_lang", "target_lang")


def stream_ingest(spark, sf_dir):
    """Arriving pairs, one file per micro-batch; French ones are there already."""
    arriving, out = _store(spark, sf_dir), new_dir(spark, "stream")
    existing = spark.createDataFrame([("eng-fra",)], "lang_pair string")
    stream = streams.read_stream(spark, arriving, max_files=1)
    streams.start_ingest(stream, f"{out}/rows", f"{out}/checkpoint", existing).awaitTermination()
    return hashed(
        tables.read_pairs(spark, f"{out}/rows", split=None),
        "lang_pair", "split", "ord", "source_lang", "target_lang",
    )


def stream_then_ingest(spark, sf_dir):
    """One store: a stream brings French, a second one (with a checkpoint of its own) German, and batch
    jobs resume with what is left."""
    root, out = write_line_files(spark, sf_dir), new_dir(spark, "shared")
    arriving = corpus.read_aligned(spark, files.list_pairs(spark, root))
    for pair in ("eng-fra", "deu-eng"):
        landed = new_dir(spark, "landed")
        arriving.filter(F.col("lang_pair") == pair).write.parquet(landed)
        stream = streams.read_stream(spark, landed, max_files=1)
        streams.start_ingest(stream, out, new_dir(spark, "checkpoint")).awaitTermination()
    corpus.ingest(spark, root, out)
    return hashed(tables.read_pairs(spark, out), "lang_pair", "split", "ord")


def stream_two_sources(spark, sf_dir):
    """A second stream, and one that lost its checkpoint, leave what is stored."""
    arriving, out = _store(spark, sf_dir), new_dir(spark, "two")
    stored = tables.read_pairs(spark, arriving, split=None)
    for pair in ("deu-eng", "eng-fra", "deu-eng"):
        landed = new_dir(spark, "landed")
        stored.filter(F.col("lang_pair") == pair).write.parquet(landed)
        stream = streams.read_stream(spark, landed)
        streams.start_ingest(stream, out, new_dir(spark, "checkpoint")).awaitTermination()
    return hashed(tables.read_pairs(spark, out, split=None), "lang_pair", "split", "ord")


def stream_lost_checkpoint(spark, sf_dir):
    """A stream stores what has arrived, loses its checkpoint, and reads the same folder again when more has come."""
    arriving, out, landed = _store(spark, sf_dir), new_dir(spark, "lost"), new_dir(spark, "landed")
    stored = tables.read_pairs(spark, arriving, split=None)
    for rest in range(3):
        stored.filter(F.col("ord") % 3 == rest).write.mode("append").parquet(landed)
        stream = streams.read_stream(spark, landed, max_files=2)
        query = streams.start_ingest(stream, out, new_dir(spark, "checkpoint"))
        streams.finish_ingest(spark, out, query)
    return hashed(tables.read_pairs(spark, out, split=None), "lang_pair", "split", "ord")


# Plans --------------------------------------------------------------------------------


def _training(spark, sf_dir, dimension: list[str]) -> DataFrame:
    rows = pairs(spark, sf_dir)
    dim = code_source.code_dimension(spark, dimension)
    catalog = rows.select("lang_pair").distinct()
    languages = training.resolve_languages(dim, catalog, ANCHOR)
    made = training.training_rows(
        rows.drop("score"),
        languages,
        dim,
        rows.select("lang_pair", "ord", "score"),
        LOOSE_THRESHOLD,
        sides=SIDES,
    )
    return hashed(made, "pos", "lang_pair", "source_id", "target_id", "source_lang", "target_lang")


def training_rows(spark, sf_dir):
    return _training(spark, sf_dir, DIMENSION)


def training_teacher(spark, sf_dir):
    """Training rows with the teacher's targets, full batches only."""
    rows = set_down(pairs(spark, sf_dir), "pairs")
    dim = code_source.code_dimension(spark, DIMENSION)
    languages = training.resolve_languages(dim, rows.select("lang_pair").distinct(), ANCHOR)
    made = training.training_rows(rows, languages, dim, sides=SIDES)
    found, _ = training.teacher_rows(made, _known(spark, sf_dir), _translator(), 8)
    return hashed(found, "pos", "lang_pair", "source_id", "target_id")


def training_first(spark, sf_dir):
    """The first rows of each pair only."""
    rows = pairs(spark, sf_dir)
    dim = code_source.code_dimension(spark, DIMENSION)
    languages = training.resolve_languages(dim, rows.select("lang_pair").distinct(), ANCHOR)
    made = training.training_rows(rows, languages, dim, sides=SIDES, first=20)
    return hashed(made, "pos", "lang_pair", "source_id", "target_id")


def training_rows_uneven(spark, sf_dir):
    """Spanish is ambiguous and French unknown: only German is left."""
    return _training(spark, sf_dir, UNEVEN_DIMENSION)


def flat_languages(spark, sf_dir):
    """What the languages of a flat corpus resolve to, with one that is ambiguous and one that is unknown."""
    flat = _flat(spark, sf_dir)
    asked = flat.select(fx.base_code("tgt_lang").alias("code")).distinct()
    dim = code_source.code_dimension(spark, UNEVEN_DIMENSION)
    found = training.resolve_flat_languages(dim, ANCHOR, asked)
    made = [(found.anchor_code, "anchor"), *((c, "covered") for c in found.covered)]
    return spark.createDataFrame([*made, *((c, "ambiguous") for c in found.ambiguous)], "script_code string, role string")


def training_sizes(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return training.training_sizes(rows, select.filter_scores(rows, LOOSE_THRESHOLD))


def eval_rows(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    dim = code_source.code_dimension(spark, DIMENSION)
    languages = training.resolve_languages(dim, rows.select("lang_pair").distinct(), ANCHOR)
    return hashed(
        training.eval_rows(_wide(spark, sf_dir), languages), "pos", "source_lang", "target_lang"
    )


def flat_training_rows(spark, sf_dir):
    flat = _flat(spark, sf_dir).withColumn(
        "ord", F.when(F.col("src_lang") == "eng_Latn", F.col("target_id")).otherwise(F.col("source_id"))
    )
    made = training.flat_training_rows(flat, "eng_Latn", FLAT_TARGETS)
    return hashed(made, "pos", "source_id", "target_id", "source_lang", "target_lang")


QUERIES = {
    f.__name__.removesuffix("_query"): f
    for f in (
        aligned_files, aligned_report, ingest_resume, stored_catalog, read_stored_split,
        skipped_pairs, split_report, write_ordered, score_files,
        catalog_filter, catalog_filter_substring, catalog_counts, catalog_semi,
        catalog_semi_substring, uncovered_codes, other_side,
        code_match, prefix_match, covered_codes, matching_codes, iso_lookup, missing_langs,
        langs_used,
        zip_pairs, strip_text, orient_pairs, recode_pairs, directions, attach_scores,
        score_filter, score_counts, pair_counts, eval_exclude, flat_filter, flat_filter_literal,
        wide_eval,
        head_per_pair_query, dense_renumber, interleave, interleave_empty_key, union_languages, block_shuffle, batches,
        teacher_batches,
        cache_dedup, cache_dedup_literal, cache_lookup, cache_misses, cache_misses_batch,
        teacher_apply, teacher_apply_batch, cache_store, cache_tsv, cache_bad_lines,
        truncate_ids, pad_batch, mask_after_eos,
        bleu_counts, corpus_bleu,
        stream_normalize, stream_flat, stream_ingest, stream_then_ingest, stream_two_sources,
        stream_lost_checkpoint, ingest_override, dev_files, requested_codes, orient_literal, teacher_restart,
        cache_levels, flat_languages,
        aligned_gz, uneven_report, read_flat, drop_script, code_requests, training_sizes,
        training_rows, training_teacher, training_first, training_rows_uneven, eval_rows, flat_training_rows,
    )
}
