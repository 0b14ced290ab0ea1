"""Size checks in front of broadcasts."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pairloom.workspace import cut_lineage

#: Rows a side may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave it to a
    shuffle join. Use it on narrow rows only."""
    summary = settle(df, max_rows)
    return F.broadcast(summary.df) if summary.small else summary.df


class Summary(NamedTuple):
    """A table computed once, and whether it is small enough to broadcast."""

    df: DataFrame
    small: bool


def settle(df: DataFrame, max_rows: int | None = None) -> Summary:
    """Compute a summary (counts per key or per block) once, for plans that use it more
    than once or need to know its size.

    Up to ``max_rows`` (``BROADCAST_ROWS``) it becomes a local table, which the optimizer knows the size of;
    a larger one is checkpointed to shared storage and stays distributed.
    """
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    # kept until it is stored, so that a large summary is not computed a second time
    kept = df.persist(StorageLevel.DISK_ONLY)
    try:
        head = kept.limit(max_rows + 1).toArrow()
        if head.num_rows <= max_rows:
            return Summary(local_table(df.sparkSession, head, df.schema), True)
        return Summary(cut_lineage(kept), False)
    finally:
        kept.unpersist()


def local_table(spark: SparkSession, rows: pa.Table | list[tuple], schema: StructType) -> DataFrame:
    """A driver-side table whose exact size the optimizer knows, so that joins with it
    are broadcast, or not, by ``spark.sql.autoBroadcastJoinThreshold``."""
    if not isinstance(rows, pa.Table):
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        target = to_arrow_schema(schema)
        rows = pa.table(
            [pa.array(list(c), type=f.type) for c, f in zip(columns, target)], schema=target
        )
    return spark.createDataFrame(rows, schema=schema)
