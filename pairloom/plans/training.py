"""Ordered training and evaluation tables out of stored pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import base_code, other_side, script_free
from pairloom.operators.align import check_lengths
from pairloom.operators.bitmaps import keep_marked
from pairloom.operators.cache import (
    Translate,
    answered,
    apply_translator,
    dedup_cache,
    missing_texts,
    translate,
    with_keys,
)
from pairloom.operators.codes import (
    intersecting,
    match_status,
    resolve_anchor,
)
from pairloom.operators.order import block_shuffle, full_batches, interleave, with_keys as with_sizes
from pairloom.operators.ordinal import dense_ordinal, head_per_pair, ordinal_counts
from pairloom.operators.orient import orient, recode, wide_to_pairs
from pairloom.operators.sizing import settle
from pairloom.operators.select import (
    different_langs,
    exclude_langs,
    filter_scores,
    flat_to_pairs,
    names_code,
    uncovered,
)
from pairloom.sinks import append_cache
from pairloom.sources.cache import read_cache
from pairloom.workspace import new_dir, set_down

#: Texts that are translated before they are stored.
PORTION = 1_000_000


@dataclass(frozen=True)
class Languages:
    """What a request resolves to. All of it is a few hundred short names at most."""

    anchor: str  #: base code of the source language
    anchor_code: str  #: its script code
    covered: list[str]  #: script codes to evaluate on
    pairs: list[str]  #: names of the pairs to train on
    ambiguous: list[str]  #: script codes to drop from evaluation


def resolve_languages(
    dim: DataFrame,
    catalog: DataFrame,
    anchor: str,
    targets: DataFrame | None = None,
    match: str = "code",
) -> Languages:
    """Resolve the anchor and the requested target codes (column ``code``; without them,
    every language paired with the anchor) against the names in ``catalog``.

    Fails if a requested code is in no pair name.
    """
    anchor_code = resolve_anchor(dim, anchor)
    base = script_free(anchor_code)
    literal = match == "substring"
    sided = (
        catalog.select("lang_pair")
        .distinct()
        .filter(names_code("lang_pair", [base], match))
        .select("lang_pair", other_side("lang_pair", base, literal).alias("code"))
        # a pair of the anchor with itself has no other side
        .filter((F.col("code") != "") & (F.col("code") != base))
    )
    # names of pairs are file-system metadata; a reader needs them here to prune folders
    sided = settle(sided).df
    if targets is None:
        requested = sided.select("code").distinct()
    else:
        requested = targets.select("code").distinct()
        unknown = uncovered(requested, catalog, match).collect()
        if unknown:
            raise ValueError(f"no data for languages: {sorted(r.code for r in unknown)}")
    covered, matching = intersecting(requested, dim)
    wanted = match_status(sided.join(matching, "code", "left_semi"), dim).collect()
    unclear = {r.code for r in wanted if r.status == "ambiguous"}
    return Languages(
        anchor=base,
        anchor_code=anchor_code,
        covered=sorted(r.script_code for r in covered.collect()),
        pairs=sorted(r.lang_pair for r in wanted if r.status == "one"),
        ambiguous=sorted(
            r.script_code for r in dim.collect() if script_free(r.script_code) in unclear
        ),
    )


def resolve_flat_languages(
    dim: DataFrame, anchor: str, targets: DataFrame | None = None
) -> Languages:
    """Languages of a flat corpus, which has no pair names: the requested targets (column ``code``; without
    them all languages of the dimension but the anchor) are looked up in the dimension only."""
    anchor_code = resolve_anchor(dim, anchor)
    base = script_free(anchor_code)
    if targets is None:
        targets = dim.select(base_code("script_code").alias("code"))
    requested = targets.select("code").distinct().filter(F.col("code") != base)
    covered, _ = intersecting(requested, dim)
    unclear = match_status(requested, dim).filter("status = 'ambiguous'").select("code").distinct()
    several = dim.join(unclear, base_code("script_code") == F.col("code"), "left_semi")
    return Languages(
        anchor=base,
        anchor_code=anchor_code,
        covered=sorted(r.script_code for r in covered.collect()),
        pairs=[],
        ambiguous=sorted(r.script_code for r in several.collect()),
    )


def teacher_rows(
    rows: DataFrame,
    known: DataFrame,
    fn: Translate,
    batch: int = 32,
    drop_last: bool = True,
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, new_rows)``: training rows whose targets are the teacher's translations of their sources, from the
    cache ``known`` or from ``fn``, and what to add to the cache. The trailing partial batch is cut."""
    return translate(rows, known, fn, batch, drop_last=drop_last, tasks=tasks)


def teacher_stored(
    rows: DataFrame,
    root: str,
    model: str,
    fn: Translate,
    batch: int = 32,
    mode: str = "row",
    drop_last: bool = True,
    tasks: int | None = None,
    portion: int = PORTION,
) -> DataFrame:
    """Like :func:`teacher_rows` with the stored cache of ``model`` under ``root``, in committed portions.

    Missing texts are set down once and dealt by key to portions of about ``portion`` texts. Each portion is translated and appended to
    the cache before the next begins, so a run that dies, in the translator or elsewhere, loses one portion at most: started again it
    asks for what is still missing. In ``batch`` mode a text that was computed again is appended again, and the last one counts.
    """
    spark = rows.sparkSession
    if drop_last:
        rows = full_batches(rows, batch)
    todo = with_keys(missing_texts(rows, read_cache(spark, root, model, keys=True), mode, batch))
    # which positions lack an answer is settled, so they are counted without their texts, which are written once, as dealt
    portions = -(-todo.count() // portion)
    if portions > 1:
        dealt = new_dir(spark, "portions")
        part = F.pmod("k1", F.lit(portions)).cast("int")
        split = todo.select("k1", "source_text", part.alias("part")).repartition("part", F.pmod(F.hash("k1"), F.lit(8)))
        split.write.partitionBy("part").option("compression", "zstd").parquet(dealt)
        parts = [spark.read.parquet(f"{dealt}/part={i}") for i in _numbers(spark, dealt)]
    else:
        parts = [set_down(todo.select("k1", "source_text"), "missing")] * portions
    for texts in parts:
        append_cache(apply_translator(texts, fn, batch, tasks), root, model)
    return answered(rows, dedup_cache(read_cache(spark, root, model, keys=True)))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The portions that have texts, from their folders."""
    found = spark.read.parquet(path).select("part").distinct().collect()
    return sorted(r.part for r in found)


def training_rows(
    pairs: DataFrame,
    languages: Languages,
    dim: DataFrame,
    scores: DataFrame | None = None,
    threshold: float = 0.95,
    seed: int = 42,
    ratio: int = 4,
    sides: Sequence[tuple[str, str]] | None = None,
    strict: bool = True,
    first: int | None = None,
) -> DataFrame:
    """Oriented, recoded, filtered, interleaved and shuffled pairs with their ``pos``.

    ``pairs`` has a dense ``ord`` per ``lang_pair``. With ``scores`` only rows reaching
    the threshold stay, and with ``first`` only that many of each pair. The shuffle block is a
    ``ratio``-th of the *stored* rows, before any filter. A pair of ``languages`` that is left without rows
    ends the interleaving at once, so nothing is given.
    """
    kept = pairs.filter(F.col("lang_pair").isin(languages.pairs))
    n_stored = kept.count()
    # the scores line up with the stored rows, so they come before anything is dropped
    if scores is not None:
        wanted = scores.filter(F.col("lang_pair").isin(languages.pairs))
        if strict:
            check_lengths(kept, wanted)
        # scores travel as bits of the positions that pass; rows stay where they are read
        kept = keep_marked(kept, filter_scores(wanted, threshold), ["lang_pair"])
    rows = recode(orient(kept, languages.anchor, sides), languages.anchor_code, dim)
    # one pass gives both the new positions and the rows per pair
    counts = ordinal_counts(rows, ["lang_pair"])
    sizes = counts.df.groupBy("lang_pair").agg(F.sum("n").alias("n"))
    numbered = dense_ordinal(rows, ["lang_pair"], counts=counts)
    if first is not None:
        numbered = head_per_pair(numbered, first)
        sizes = sizes.withColumn("n", F.least("n", F.lit(first)))
    sizes = settle(with_sizes(sizes, languages.pairs)).df
    mixed = interleave(numbered, sizes=sizes)
    rounds = sizes.agg(F.min("n")).first()[0] or 0
    return block_shuffle(
        mixed, seed, n=n_stored, ratio=ratio, rows=rounds * len(languages.pairs)
    )


def training_sizes(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: ``n_stored`` rows the store has, ``n_effective`` rows a run will see."""
    stored = pairs.agg(F.count(F.lit(1)).alias("n_stored"))
    return stored.withColumn(
        "n_effective", rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    )


def eval_rows(
    wide: DataFrame, languages: Languages, eval_batches: int = 20, batch_size: int = 2
) -> DataFrame:
    """The first rows of the wide table for every covered language, one language after
    the other in turn, without the languages that are ambiguous in training."""
    pairs = different_langs(
        head_per_pair(
            wide_to_pairs(wide, languages.anchor_code, languages.covered),
            eval_batches * batch_size,
        )
    )
    mixed = interleave(pairs, key="target_lang")
    if not languages.ambiguous:
        return mixed
    # the positions were given with these languages in place; they leave gaps
    unclear = wide.sparkSession.createDataFrame([(c,) for c in languages.ambiguous], "lang string")
    return exclude_langs(mixed, unclear)


def flat_training_rows(
    flat: DataFrame,
    src: str,
    tgts: Sequence[str] | str | None = None,
    order: str = "ord",
    seed: int = 42,
    ratio: int = 4,
    n: int | None = None,
) -> DataFrame:
    """Rows of a flat corpus, renumbered after the language filters and shuffled.

    ``n`` sizes the shuffle block; by default it is the number of rows left.
    """
    rows = flat_to_pairs(flat, src, tgts)
    counts = ordinal_counts(rows, [], order)
    numbered = dense_ordinal(rows, [], order, out="pos", counts=counts)
    if n is None:
        n = counts.df.agg(F.sum("n")).first()[0] or 0
    return block_shuffle(numbered, seed, n=n, ratio=ratio)
