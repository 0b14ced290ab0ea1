"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.commits import Conflict, Folder, State, commit, read_state
from pairloom.functions.text import model_key
from pairloom.operators.align import ZIP_CHUNK
from pairloom.operators.cache import with_keys
from pairloom.operators.ordinal import div
from pairloom.sources.cache import cache_path, cache_runs, read_runs, run_path
from pairloom.sources.tables import folder_names, has_rows

#: How names of batch jobs' commits begin.
BATCH = "batch"

#: Rows per file of an ordered table, and of a bucket of a cache.
ROWS_PER_FILE = 500_000

#: Buckets of keys of a cache, the same for all its runs, and runs of a level that are merged.
BUCKETS = 32
FAN = 8


def write_pairs(
    df: DataFrame,
    out: str,
    mode: str = "append",
    chunk: int | None = ZIP_CHUNK,
    ingest: str | None = None,
    writer: str | None = None,
    complete: bool = True,
    sources: Mapping[tuple[str, str], Sequence[str]] | None = None,
    files: Sequence[str] = (),
    replaces: Collection[str] = (),
    unless: Callable[[State], str | None] | None = None,
) -> None:
    """Write pairs under ``lang_pair=/split=/ingest=`` and publish them with one commit (see ``commits``).

    Rows are clustered by runs of ``chunk`` positions, so a pair makes about
    ``rows / chunk`` files however many tasks write, a large pair is written by many
    tasks, and each file holds a narrow range of ``ord``, which lets first-N reads skip
    row groups. ``chunk=None`` is for input that is clustered already, such as what
    ``read_aligned`` gives.

    ``mode``: ``append``; ``overwrite`` replaces the whole of ``out``, ``override`` just the splits that ``df`` has, whoever
    wrote them. Readers see the rows from before until the commit, and all of the new ones from then on; a job that
    dies before it leaves the store as it was. ``replaces`` names pairs of which no earlier row counts any more.

    ``ingest`` names the commit, such as a stream's micro-batch; one that is published already is not written again, and one that died before
    is written anew. ``complete`` says that the splits are whole, ``sources`` and ``files`` where a stream's rows came from, and
    ``unless`` can stop the commit (see ``commits.commit``).
    """
    if mode not in ("append", "overwrite", "override"):
        raise ValueError(f"unknown mode: {mode}")
    spark = df.sparkSession
    before = read_state(spark, out)
    if ingest is not None and before is not None and ingest in before.done:
        return
    if before is None and has_rows(spark, out):
        raise ValueError(f"{out} holds pairs without a commit log; call adopt first")
    name = ingest or f"{BATCH}-{uuid.uuid4().hex}"
    if chunk is not None:
        df = df.repartition("lang_pair", "split", div("ord", chunk))
    df = df.sortWithinPartitions("lang_pair", "split", "ord").withColumn("ingest", F.lit(name))
    # what an attempt that died has left under this name is replaced
    parts = df.write.partitionBy("lang_pair", "split", "ingest").mode("overwrite")
    parts.option("partitionOverwriteMode", "dynamic").parquet(out)
    folders = [
        Folder(r.lang_pair, r.split, name, writer or name, r.n, complete, tuple((sources or {}).get((r.lang_pair, r.split), ())))
        for r in _written(spark, out, name)
    ]
    gone = {f.key for f in folders} if mode == "override" else set()

    def dropped(state: State) -> str | None:
        gone.update(f.key for f in state.folders if f.lang_pair in replaces)
        return unless(state) if unless else None

    commit(spark, out, name, folders, writer, gone, mode == "overwrite", files=files, unless=dropped)


def _written(spark: SparkSession, out: str, name: str) -> list:
    """Rows by pair and split under one commit's name: counted from the footers of its files."""
    try:
        rows = spark.read.option("basePath", out).parquet(f"{out}/lang_pair=*/split=*/ingest={name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return []
        raise
    keys = [F.col(c).cast("string").alias(c) for c in ("lang_pair", "split")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()


def adopt(spark: SparkSession, out: str) -> None:
    """Start the commit log of a store that was written without one: all its folders count, as whole splits."""
    folders = [Folder(*key, name, name, -1, True) for *key, name in folder_names(spark, out)]
    commit(spark, out, "adopted", folders, unless=lambda state: "the store has a log" if state.version else None)


def append_cache(
    new_rows: DataFrame, root: str, model: str, start: int | None = None, fan: int = FAN
) -> None:
    """Append translations to a model's cache with one commit, then merge runs where there are ``fan`` of a level.

    ``start`` orders appends: rows written with a larger one win over earlier rows of
    the same source; by default it is the commit's number. Sources are unique within ``new_rows``, so they may share it.
    """
    spark = new_rows.sparkSession
    state = read_state(spark, cache_path(root, model)) or State()
    if start is None:
        start = state.version
    rows = new_rows.select(F.lit(start).cast("long").alias("ord"), "source_text", "translation")
    rows = with_keys(rows).withColumn("bucket", F.pmod("k1", F.lit(BUCKETS)).cast("int"))
    _add_run(rows.repartition("bucket"), root, model, "0")
    compact_cache(spark, root, model, fan)


def _add_run(
    rows: DataFrame, root: str, model: str, level: str, merged: Sequence[tuple[str, str]] = ()
) -> None:
    """Write ``rows``, dealt by bucket, as a run and publish it, in the place of ``merged``, which must be all runs of
    their level."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    path = run_path(root, model, level, run)
    # a bucket's rows in one file, or in several if they are many
    dealt = rows.sortWithinPartitions("bucket", "k1", "k2").write.partitionBy("bucket")
    dealt.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)
    n = read_runs(spark, root, model, [(level, run)]).count()
    key = model_key(model)

    def changed(state: State) -> str | None:
        levels = {lv for lv, _ in merged}
        there = {(f.split, f.ingest) for f in state.folders if f.split in levels}
        return None if there == set(merged) else "runs of the level have changed"

    commit(
        spark,
        cache_path(root, model),
        run,
        [Folder(key, level, run, run, n, True)] if n else [],
        replaces={(key, lv) for lv, _ in merged},
        unless=changed if merged else None,
    )


def compact_cache(spark: SparkSession, root: str, model: str, fan: int = FAN) -> int:
    """Merge the runs of every level that has ``fan`` of them into one run of the next, with the last translation of each
    source; returns how many levels were merged. A merge that another writer has overtaken is left for the next append."""
    merged = 0
    for level in range(64):
        runs = [r[:2] for r in cache_runs(spark, root, model) or [] if r[0] == str(level)]
        if len(runs) < fan:
            continue
        rows = read_runs(spark, root, model, runs)
        # what meets in a group lies in one bucket's folders, and so does what is written: a task takes a bucket as it lies,
        # and nothing is shuffled
        buckets = (rows.filter(F.col("bucket") == b).coalesce(1) for b in range(BUCKETS))
        last = reduce(DataFrame.union, (_last_rows(own) for own in buckets))
        try:
            _add_run(last, root, model, str(level + 1), runs)
            merged += 1
        except Conflict:
            break
    return merged


def _last_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket", "k1", "k2", "source_text").agg(
        F.max_by("translation", "ord").alias("translation"), F.max("ord").alias("ord")
    )


def write_ordered(
    df: DataFrame,
    out: str,
    n: int,
    pos: str = "pos",
    rows_per_file: int = ROWS_PER_FILE,
    fmt: str = "parquet",
) -> None:
    """Write ``n`` rows in the order of the dense ``pos``: file by file, and within each.

    A row's file follows from its position, so no sampling pass is needed to find
    ranges and all files but the last are equally long. ``fmt="text"`` writes the one
    other column as lines.
    """
    files = max(1, -(-n // rows_per_file))
    file_no = (
        F.when(F.col(pos) < n, div(pos, rows_per_file))
        .otherwise(F.raise_error(F.lit(f"a position is beyond the {n} rows that were announced")))
        .cast("int")
    )
    placed = df.repartitionById(files, file_no).sortWithinPartitions(pos)
    (placed.drop(pos) if fmt == "text" else placed).write.format(fmt).save(out)
