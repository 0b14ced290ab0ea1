"""Importance resampling towards a target distribution, on hashed n-grams.

Texts are cut into words by an untrained pre-tokenizer of the tokenizers library, a split by regular
expression over the text with A-Z lower-cased. It gives each word with its offsets; a window of
consecutive offset pairs is a feature, the words joined by one space. A feature's bucket is its CRC-32
modulo the number of buckets. The histograms of all documents and of all target texts give each
bucket a gain, 1000 times the logarithm of how much more frequent it is in the target, smoothed by
one in each bucket and rounded down. A document's weight is the mean gain of its features; Gumbel
noise from a hash of its id makes the highest scores a draw without replacement by weight.

Texts are read once: the buckets of each document are written to the shared folder, and histograms, weights
and ranks are made from them. Gains are the one thing broadcast, a number for each bucket. Ranks come from a
sort by range of the rows at or above the score of the last one drawn.

Defined results: a null text has no words. A document without features has weight 0. A row without ``doc_id`` is hashed
as an id without digits and comes after all others of its score. Repeated rows are documents of their own, with
consecutive ranks. With no documents the result is empty; with no target texts every gain compares with a
target that holds nothing. Columns beyond ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordinal import running_offsets
from pairloom.operators.sizing import settle
from pairloom.workspace import cut_lineage, new_dir

#: What a word is, in texts with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BUCKETS = 10_000
#: Longest feature in words.
NGRAM = 1
#: Words a document needs to be drawn, and the percentage of such documents that are.
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"

#: Characters given to the pre-tokenizer at once; a longer word is not cut.
PIECE = 4_000
#: Features a task remembers with their buckets.
KNOWN = 300_000
#: Bucket numbers gathered before they are added up.
GATHER = 2_000_000

_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


# Features ------------------------------------------------------------------------------


def pre_tokenizer():
    """The split: matches are kept, what lies between them is removed."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """``text`` with A-Z, and no other letter, in lower case."""
    return text.encode().lower().decode()


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """``text`` in runs of about ``size`` characters that end between words, with the place of each."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        to = gap.end() if gap else len(text)
        yield at, text[at:to]
        at = to
    yield at, text[at:]


def words_with_offsets(text: str, splitter=None, size: int = PIECE) -> Iterator[tuple[str, tuple[int, int]]]:
    """The words of a text with where they begin and end in it, in code points."""
    splitter = splitter or pre_tokenizer()
    for at, piece in pieces(lowered(text), size):
        for word, (begin, end) in splitter.pre_tokenize_str(piece):
            yield word, (at + begin, at + end)


def windows(words: list[tuple[str, tuple[int, int]]], n: int) -> Iterator[tuple[str, tuple[int, int]]]:
    """Runs of ``n`` consecutive words as features, with the offset pair of each run."""
    for i in range(len(words) - n + 1):
        run = words[i : i + n]
        yield " ".join(w for w, _ in run), (run[0][1][0], run[-1][1][1])


class _Buckets(dict):
    """Buckets by feature, worked out when first met."""

    def __init__(self, buckets: int):
        self._buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature.encode()) % self._buckets
        return bucket


def _features(text: str, splitter, known: _Buckets, ngram: int, size: int = PIECE) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its features."""
    n_words, found, tail = 0, [], []
    for _, piece in pieces(lowered(text), size):
        words = splitter.pre_tokenize_str(piece)
        n_words += len(words)
        found.append(np.array([known[w] for w, _ in words], np.uint32))
        for n in range(2, ngram + 1):
            run = tail[-(n - 1) :] + words
            found.append(np.array([known[f] for f, _ in windows(run, n)], np.uint32))
        tail = (tail + words)[-(ngram - 1) :] if ngram > 1 else []
    return n_words, np.concatenate(found)


_HASHED = "doc_id long, n_words long, buckets binary"
_HASHED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])


def _hash_texts(batches: Iterable[pa.RecordBatch], buckets: int, ngram: int) -> Iterator[pa.RecordBatch]:
    splitter, known = pre_tokenizer(), _Buckets(buckets)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _HASHED_ARROW)], schema=_HASHED_ARROW
        )

    for batch in batches:
        rows, weight = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            n_words, found = _features(text.as_py() or "", splitter, known, ngram)
            found.sort()  # an order that compresses
            rows.append((doc_id, n_words, found.astype("<u4").tobytes()))
            weight += len(found)
            if weight >= GATHER:
                yield out(rows)
                rows, weight = [], 0
        if rows:
            yield out(rows)


def hash_features(docs: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, n_words, buckets`` of every row: the buckets of all features, repeats included, as unsigned
    32-bit numbers."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(partial(_hash_texts, buckets=buckets, ngram=ngram), _HASHED)


# Gains ---------------------------------------------------------------------------------


def _add_up(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for value in batch.column("buckets"):
            total += np.bincount(np.frombuffer(value.as_buffer(), "<u4"), minlength=buckets)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])


def histogram(hashed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: added up in tasks, then by bucket, at most ``buckets`` rows."""
    partial_counts = hashed.select("buckets").mapInArrow(partial(_add_up, buckets=buckets), "bucket long, n long")
    rows = partial_counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket from the histograms of source and target."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


_WEIGHED = "doc_id long, n_words long, n_features long, weight long"
_WEIGHED_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _WEIGHED.split(", ")])


def _weigh(batches: Iterable[pa.RecordBatch], gain) -> Iterator[pa.RecordBatch]:
    by_bucket = gain.value
    for batch in batches:
        n, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, value in enumerate(batch.column("buckets")):
            found = np.frombuffer(value.as_buffer(), "<u4")
            n[i], sums[i] = len(found), by_bucket[found].sum()
        weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], schema=_WEIGHED_ARROW
        )


# The draw ------------------------------------------------------------------------------


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their ``rank`` (1, 2, ...) by ``order``: sorted by range, and numbered by the rows of the
    ranges before."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged = cut_lineage(
        ranged.withColumns({"_slot": F.spark_partition_id().cast("long"), "_at": F.monotonically_increasing_id()})
    )
    offsets = running_offsets(settle(ranged.groupBy("_slot").agg(F.count(F.lit(1)).alias("n"))), [])
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(offsets, "_slot").select(*rows.columns, (F.col("offset") + inside + 1).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    ngram: int = NGRAM,
    seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where it was not drawn.

    ``target`` has ``text``; of the documents with ``least_words`` words the ``percent`` with the highest scores are
    drawn, equal scores by rising id.
    """
    spark = docs.sparkSession
    path = new_dir(spark, "features")
    hash_features(docs, buckets, ngram).write.parquet(path)
    hashed = spark.read.parquet(path)
    wanted = hash_features(target.select(F.lit(None).alias("doc_id"), "text"), buckets, ngram)
    gain = spark.sparkContext.broadcast(gains(histogram(hashed, buckets), histogram(wanted, buckets)))
    weighed = hashed.mapInArrow(partial(_weigh, gain=gain), _WEIGHED)
    scored = cut_lineage(
        weighed.select(
            "doc_id",
            "n_features",
            "weight",
            (F.col("weight") + noise("doc_id", seed)).alias("score"),
            (F.col("n_words") >= least_words).alias("_able"),
        )
    )
    # scores are thousandths of logarithms of counts: some ten thousand values, whatever the rows
    by_score = scored.filter("_able").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()
    score, n = (by_score.column(c).to_numpy() for c in ("score", "n"))
    falling = np.argsort(-score)
    reached = np.cumsum(n[falling])
    draw = int(n.sum()) * percent // 100
    last = int(score[falling][np.searchsorted(reached, draw)]) if draw else None
    result = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*result, none)
    near = F.col("_able") & (F.col("score") >= last)
    rows = scored.filter(near).withColumn("_place", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_place")]
    drawn = _ranked(rows, order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return scored.filter(~near).select(*result, none).unionByName(drawn.select(*result, "rank"))
