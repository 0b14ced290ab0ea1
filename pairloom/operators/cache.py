"""Translation cache: ``source_text -> translation``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.bitmaps import keep_marked
from pairloom.operators.order import batch_id, full_batches
from pairloom.operators.skew import hot_hashes, text_join, text_keys, with_keys
from pairloom.workspace import cut_lineage, set_down

Translate = Callable[[list[str]], list[str]]


def dedup_cache(cache: DataFrame, literal: bool = False) -> DataFrame:
    """One translation per source text, the last by ``ord``.

    ``literal`` first keeps only the first row of every *translation*, which loses
    sources that share one. Both steps are aggregations with map-side partial results,
    so a text repeated in a third of the rows is folded before the shuffle. Of a cache that has its texts' keys ``k1, k2``
    these are grouped and kept, so a text that is not asked for does not travel.
    """
    if literal:
        cache = cache.groupBy("translation").agg(
            F.min_by("source_text", "ord").alias("source_text"), F.min("ord").alias("ord")
        )
    if {"k1", "k2"} <= set(cache.columns):
        return cache.groupBy("k1", "k2").agg(
            F.any_value("source_text").alias("source_text"),
            F.max_by("translation", "ord").alias("translation"),
            F.max("ord").alias("ord"),
        )
    # a hash leads the key, so that sorts compare numbers before texts
    return (
        cache.groupBy(F.xxhash64("source_text").alias("_hash"), "source_text")
        .agg(F.max_by("translation", "ord").alias("translation"), F.max("ord").alias("ord"))
        .drop("_hash")
    )


def lookup(
    req: DataFrame, cache: DataFrame, hot: Sequence[int] | None = None
) -> DataFrame:
    """Add ``translation`` and ``hit`` to every request row; ``cache`` has each source
    once (see :func:`dedup_cache`)."""
    keys = [c for c in ("k1", "k2") if c in cache.columns]
    answers = cache.select("source_text", *keys, "translation", F.lit(True).alias("hit"))
    found = text_join(req, answers, "source_text", "left", hot)
    return found.withColumn("hit", F.coalesce("hit", F.lit(False))).select(
        *req.columns, "translation", "hit"
    )


def misses(
    req: DataFrame,
    cache: DataFrame,
    mode: str = "row",
    batch: int = 32,
    hot: Sequence[int] | None = None,
) -> DataFrame:
    """Request rows to compute.

    ``row``: those without a translation. ``batch``: all rows of every batch of
    consecutive positions that has one, hits included.
    """
    found = lookup(req, cache, hot)
    if mode == "row":
        return found.filter(~F.col("hit")).select(*req.columns)
    if mode == "batch":
        together = Window.partitionBy("_batch")
        return (
            found.withColumn("_batch", batch_id(batch))
            .withColumn("_all_hit", F.min("hit").over(together))
            .filter(~F.col("_all_hit"))
            .select(*req.columns)
        )
    raise ValueError(f"unknown mode: {mode}")


def apply_translator(
    texts: DataFrame, fn: Translate, batch: int = 32, tasks: int | None = None
) -> DataFrame:
    """``source_text, translation`` by calling ``fn`` on lists of ``batch`` texts; only the last list of
    a task can be shorter. Null texts are left out.

    ``tasks`` is the number of tasks to share the work. Without it texts stay where they are, which for a slow
    ``fn`` may mean few tasks: sentences are small in bytes.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def translated(chunk: list[str]) -> pd.DataFrame:
            answers = list(fn(chunk))
            if len(answers) != len(chunk):
                raise ValueError(f"{len(chunk)} texts gave {len(answers)} translations")
            return pd.DataFrame({"source_text": chunk, "translation": answers})

        waiting: list[str] = []
        for frame in frames:
            waiting += frame["source_text"].tolist()
            while len(waiting) >= batch:
                yield translated(waiting[:batch])
                waiting = waiting[batch:]
        if waiting:
            yield translated(waiting)

    texts = texts.select("source_text").filter("source_text is not null")
    if tasks is not None:
        texts = texts.repartition(tasks, F.xxhash64("source_text"))
    return texts.mapInPandas(
        run, "source_text string, translation string"
    )


def missing_texts(
    req: DataFrame, cache: DataFrame, mode: str = "row", batch: int = 32, pos: str = "pos"
) -> DataFrame:
    """``pos, source_text``: each distinct text that has to be computed once, at the first of its positions.

    Requests and cache meet by their keys, and positions without a match come back as bitmaps; texts are read, by
    those who hold them, for misses only. ``pos`` must be unique. Modes as in :func:`misses`. Null texts are left out.
    """
    asked = with_keys(req.filter(F.col("source_text").isNotNull()).select(pos, "source_text")).select(pos, "k1", "k2")
    first = F.min(pos).alias(pos)
    known = with_keys(cache).select("k1", "k2").withColumn("_known", F.lit(True))
    if mode == "row":
        missing = asked.groupBy("k1", "k2").agg(first).join(known, ["k1", "k2"], "left_anti")
    elif mode == "batch":
        lacks = asked.groupBy("k1", "k2").agg(first).join(known, ["k1", "k2"], "left_anti")
        placed = asked.withColumn("_batch", batch_id(batch, pos))
        # three numbers a row; where one text has very many rows, adaptive execution splits them
        lacking = placed.join(lacks, ["k1", "k2"], "left_semi").select("_batch").distinct()
        again = placed.join(lacking, "_batch", "left_semi")
        missing = again.groupBy("k1", "k2").agg(first)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return keep_marked(req.select(pos, "source_text"), missing.select(pos), [], pos)


def translate(
    req: DataFrame,
    cache: DataFrame,
    fn: Translate,
    batch: int = 32,
    mode: str = "row",
    drop_last: bool = False,
    materialize: bool = True,
    tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(result, new_rows)``: requests (with a unique ``pos``) with ``target_text``, and what to add to the cache.

    Every distinct missing text is sent to ``fn`` once. ``new_rows`` is checkpointed, so
    that using both results, or losing an executor, does not call ``fn`` again for texts
    already done; requests are set down with it, as they are read several times. ``drop_last`` cuts the trailing partial batch of requests, ``tasks`` is the number of
    tasks that call ``fn``. A null text has a null translation. A job that dies loses what it had computed; see
    ``plans.training.teacher_stored`` for one that does not.

    In ``batch`` mode a text that was computed again has its fresh translation everywhere, also in
    batches that were all hits.
    """
    if materialize:
        req = set_down(req.drop("target_text"), "requests")
    if drop_last:
        req = full_batches(req, batch)
    new_rows = apply_translator(missing_texts(req, cache, mode, batch), fn, batch, tasks)
    if materialize:
        new_rows = cut_lineage(new_rows)
    known = cache.select("source_text", "translation")
    if mode == "batch":
        # a recomputed hit replaces its cached translation
        known = text_join(known, new_rows.select("source_text"), "source_text", "left_anti", ())
    return answered(req, known.unionByName(new_rows)), new_rows


def answered(req: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their translations as ``target_text``."""
    return lookup(req, cache).select(
        *[c for c in req.columns if c != "target_text"], F.col("translation").alias("target_text")
    )
