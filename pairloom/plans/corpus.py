"""From a folder of aligned files to a stored pair table."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pairloom.commits import State
from pairloom.operators.counts import catalog_counts
from pairloom.operators.select import select_pairs
from pairloom.sinks import write_pairs
from pairloom.sources.files import list_pairs, read_aligned, skipped_splits
from pairloom.sources.tables import complete_pairs, stored_pairs


def ingest(
    spark: SparkSession,
    root: str,
    out: str,
    target: str | None = None,
    sources: Sequence[str] | None = None,
    match: str = "code",
    mode: str = "inner",
    override: bool = False,
) -> DataFrame:
    """Read every wanted pair under ``root`` that ``out`` lacks and append it there.

    All pairs go through one job and are published by one commit, so a run that dies has added nothing. A pair
    that the store has only in part (a stream brought some of it and never ended) is read anew, and its
    rows replace that part. ``override`` reads pairs that exist too and replaces
    their splits. Splits without one of their sides are skipped with a warning. Returns the counts of pairs: all,
    skipped, left. Two runs that add the same pair at once do not both: the later commit fails.
    """
    catalog = list_pairs(spark, root)
    existing = complete_pairs(spark, out)
    partial = {r.lang_pair for r in stored_pairs(spark, out).join(existing, "lang_pair", "left_anti").collect()}
    # counted before the write changes what exists
    counts = catalog_counts(catalog, existing.limit(0) if override else existing)
    counts = spark.createDataFrame(counts.toArrow())
    wanted = select_pairs(catalog, None if override else existing, target, sources, match)
    if mode == "inner":
        skipped = skipped_splits(wanted).collect()
        if skipped:
            names = ", ".join(sorted(f"{r.lang_pair}/{r.split} (only {r.side})" for r in skipped))
            warnings.warn(f"splits without one of their sides are skipped: {names}", stacklevel=2)
    pairs = read_aligned(spark, wanted, mode)
    if override:
        write_pairs(pairs, out, "override", chunk=None)
        return counts
    added = {r.lang_pair for r in wanted.select("lang_pair").distinct().collect()}

    def taken(state: State) -> str | None:
        late = sorted(added & state.complete_pairs())
        return f"stored by another writer meanwhile: {', '.join(late)}" if late else None

    write_pairs(pairs, out, chunk=None, replaces=partial & added, unless=taken)
    return counts
