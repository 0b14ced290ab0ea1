"""Corpus BLEU (Papineni et al. 2002), without smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each token makes this many gram rows, over all orders and both sides.
_GROWTH = 8

TOKEN_SEPARATOR = r"[ \t\r\n]+"


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), TOKEN_SEPARATOR), "")


def bleu_counts(df: DataFrame, group: str, max_n: int = 4) -> DataFrame:
    """``group, n, matches, total, hyp_len, ref_len`` for n = 1..max_n.

    ``df``: segment_id (unique), group, hypothesis, reference. Each segment's texts are
    shuffled once; its n-grams are made and counted behind that shuffle. A large group is no hot key, as segments
    are what is spread.

    A gram that both sides have matches at least once: the intersection of the two sets, taken inside the row, counts that.
    Only what a side has of a gram beyond its first occurrence becomes rows, which are counted by gram; so
    it is a part of the grams that is grouped. Where no gram of an order matches, no longer one can, and none is made.
    Rows of one group that share a segment_id are one segment: theirs
    are all grouped.
    """
    # A fixed number of partitions: adaptive execution would merge them by the size of
    # the texts, not knowing how many n-grams follow.
    parts = _GROWTH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders_n = range(1, max_n + 1)
    segments = (
        df.select("segment_id", group, "hypothesis", "reference")
        .repartition(parts, "segment_id")
        .withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy("segment_id", group)) == 1)
        .select("segment_id", group, "_alone", token_keys("hypothesis").alias("h1"), token_keys("reference").alias("r1"))
    )
    none = F.array().cast("array<bigint>")
    for n in orders_n:
        if n > 1:
            can = ~F.col("_alone") | (F.col(f"m{n - 1}") > 0)
            longer = {f"{s}{n}": F.when(can, _longer(f"{s}{n - 1}", f"{s}1", n)).otherwise(none) for s in "hr"}
            segments = segments.withColumns(longer)
        both = F.size(F.array_intersect(f"h{n}", f"r{n}"))
        segments = segments.withColumn(f"m{n}", F.when(F.col("_alone"), both).otherwise(0))
    # keys stand next to their like
    ordered = {f"_{s}{n}": F.when(F.col(f"m{n}") > 0, F.sort_array(f"{s}{n}")).otherwise(none) for s in "hr" for n in orders_n}
    segments = segments.withColumns(ordered)

    def rest(side: str, n: int) -> Column:
        keys = F.col(f"_{side}{n}")
        again = F.filter(keys, lambda key, i: key == F.get(keys, i + 1))
        return F.when(F.col("_alone"), again).otherwise(F.col(f"{side}{n}"))

    def sided(n: int, h: int) -> Column:
        """Of an order and a side (``h`` 1 or 0) the keys to group, and what the other columns of a segment add."""
        zero = F.lit(0)
        return F.struct(
            F.lit(n).alias("n"),
            F.lit(h).alias("h"),
            rest("h" if h else "r", n).alias("keys"),
            (F.col(f"m{n}") if h else zero).alias("m"),
            (F.greatest(F.size("h1") - (n - 1), zero) if h else zero).alias("t"),
            (zero if h else F.size(f"r{n}")).alias("len"),
        )

    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    per_gram = (
        segments.select("segment_id", group, F.inline(F.array(*(sided(n, h) for n in orders_n for h in (1, 0)))))
        # outer: a segment whose grams are all counted, or that has none, still tells its numbers, once
        .select("segment_id", group, "n", "h", "m", "t", "len", F.posexplode_outer("keys").alias("pos", "key"))
        .groupBy("segment_id", group, "n", "key")
        .agg(
            F.sum(F.when(F.col("key").isNotNull(), F.col("h")).otherwise(0)).alias("h"),
            F.sum(F.when(F.col("key").isNotNull(), 1 - F.col("h")).otherwise(0)).alias("r"),
            *(F.sum(F.when(first, F.col(c)).otherwise(0)).alias(c) for c in ("m", "t", "len")),
        )
    )

    def total(n: int, value: Column) -> Column:
        return F.sum(F.when(F.col("n") == n, value).otherwise(0))

    wide = per_gram.groupBy(group).agg(
        *(total(n, F.least("h", "r") + F.col("m")).alias(f"m{n}") for n in orders_n),
        *(total(n, F.col("t")).alias(f"t{n}") for n in orders_n),
        total(1, F.col("len")).alias("ref_len"),
    )
    orders = F.array(
        *(
            F.struct(
                F.lit(n).alias("n"),
                F.col(f"m{n}").alias("matches"),
                F.col(f"t{n}").alias("total"),
                F.col("t1").alias("hyp_len"),
                "ref_len",
            )
            for n in orders_n
        )
    )
    return wide.select(group, F.inline(orders))


def token_keys(text: str) -> Column:
    """The tokens of a text, each as a 64-bit hash; of a null text none."""
    found = F.transform(tokens(text), lambda token: F.xxhash64(token))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def _longer(shorter: str, tokens_: str, n: int) -> Column:
    """Keys of all runs of ``n`` tokens: those of ``n - 1`` tokens, each with the token behind it."""
    many = F.greatest(F.size(tokens_) - (n - 1), F.lit(0))
    return F.zip_with(
        F.slice(shorter, F.lit(1), many), F.slice(tokens_, F.lit(n), many), lambda run, token: F.xxhash64(run, token)
    )


def corpus_bleu(df: DataFrame, group: str, max_n: int = 4) -> DataFrame:
    """``group, score`` in 0..100. An order without a match, or an empty hypothesis,
    makes the score 0."""
    summed = bleu_counts(df, group, max_n).groupBy(group).agg(
        F.min("matches").alias("_least"),
        F.avg(F.when(F.col("matches") > 0, F.ln(F.col("matches") / F.col("total")))).alias("_log"),
        F.max("hyp_len").alias("_h"),
        F.max("ref_len").alias("_r"),
    )
    penalty = F.when(F.col("_h") >= F.col("_r"), F.lit(0.0)).otherwise(1 - F.col("_r") / F.col("_h"))
    return summed.select(
        group,
        F.when(F.col("_least") == 0, 0.0)
        .otherwise(100 * F.exp(F.col("_log") + penalty))
        .alias("score"),
    )
