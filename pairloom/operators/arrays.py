"""Batches of token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.tokens import attention_mask, pad_right
from pairloom.operators.order import batch_id


def pad_batch(
    df: DataFrame, pad_id: int, ignore_id: int, size: int | None = None, pos: str = "pos"
) -> DataFrame:
    """Pad ``input_ids`` with ``pad_id`` and ``labels`` with ``ignore_id`` to the longest
    of the batch, and add ``attention_mask``.

    Batches are given by ``batch_id``, or made of ``size`` consecutive positions. Inputs
    and labels have their own lengths.
    """
    if size is not None:
        df = df.withColumn("batch_id", batch_id(size, pos))
    batch = Window.partitionBy("batch_id")
    ids, labels = F.col("input_ids"), F.col("labels")
    return (
        df.withColumns(
            {
                "_in": F.max(F.size(ids)).over(batch),
                "_out": F.max(F.size(labels)).over(batch),
            }
        )
        .withColumns(
            {
                "attention_mask": attention_mask(ids, F.col("_in")),
                "input_ids": pad_right(ids, F.col("_in"), pad_id),
                "labels": pad_right(labels, F.col("_out"), ignore_id),
            }
        )
        .drop("_in", "_out")
    )
