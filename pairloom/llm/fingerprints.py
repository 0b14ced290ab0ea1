"""Document fingerprints: one-permutation MinHash, densified, packed to a few bits a bin.

The distinct five-word shingles of a text are hashed once. The leading bits of a hash name its
bin and the smallest hash of a bin stands for it; an empty bin takes the value of another one,
found by a fixed random walk over the bins (optimal densification). Of each value the low bits
are stored. Two unlike bins agree in ``BITS`` bits by chance once in ``2**BITS``; the likeness
takes that out.

Defined results: null counts as an empty text; a text without words has the empty fingerprint,
whose likeness is 1 to another empty one and 0 to any other. Rows without ``doc_id`` come first
in the order of documents; equal ids are ordered by text; every row gives one row. Columns beyond
``doc_id`` and ``text`` are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.bytesets import Shingles, chunks, mix, shingles

#: Bins of a fingerprint, and bits kept of each; bins must be a power of two.
BINS = 256
BITS = 4

#: Text bytes of one range of documents, as the count of ranges is chosen.
RANGE_BYTES = 48_000_000

_U = np.uint64


def minhash(sets: Shingles, bins: int = BINS, bits: int = BITS) -> list[bytes | None]:
    """The packed fingerprint of each set; None for an empty set."""
    count = len(sets.ptr) - 1
    n = np.diff(sets.ptr)
    doc = np.repeat(np.arange(count), n)
    shift = _U(64 - bins.bit_length() + 1)
    place = doc * bins + (sets.hashes >> shift).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # hashes rise within a document, and so do bins
    value = np.zeros(count * bins, np.uint8)
    full = np.zeros(count * bins, bool)
    low = (mix(sets.hashes[first]) & _U((1 << bits) - 1)).astype(np.uint8)
    value[place[first]] = low
    full[place[first]] = True
    _densify(value.reshape(count, bins), full.reshape(count, bins))
    packed = np.packbits(
        np.unpackbits(value.reshape(count, bins, 1), axis=2)[:, :, 8 - bits :].reshape(count, -1),
        axis=1,
    )
    return [packed[i].tobytes() if n[i] else None for i in range(count)]


def _densify(value: np.ndarray, full: np.ndarray) -> None:
    """Give each empty bin the value of the first full bin on its walk. The walk depends on the
    bin and the step only, so sets that share their full bins fill alike."""
    bins = value.shape[1]
    filled = full.sum(axis=1)
    for i in np.flatnonzero(filled == 1):  # every walk ends in the same bin
        value[i] = value[i][full[i]][0]
    doc, empty = np.nonzero(~full & (filled > 1)[:, None])
    step = 0
    while len(doc):
        seeds = empty.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(step * 0x632BE5AB + 1)
        to = (mix(seeds) % _U(bins)).astype(np.int64)
        hit = full[doc, to]
        value[doc[hit], empty[hit]] = value[doc[hit], to[hit]]
        doc, empty = doc[~hit], empty[~hit]
        step += 1


def likeness(a: bytes | None, b: bytes | None, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of the two sets, 0 to 1."""
    if a is None or b is None:
        return float(a is b)
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = bins - np.unpackbits(differ).reshape(bins, bits).any(axis=1).sum()
    chance = 2.0**-bits
    return float(max(0.0, (same / bins - chance) / (1 - chance)))


def fingerprint_texts(texts: Iterable[str], bins: int = BINS, bits: int = BITS) -> list:
    """Packed fingerprints of texts; the local counterpart of the DataFrame operator."""
    out: list[bytes | None] = []
    for chunk in chunks(pa.array(list(texts), pa.large_string())):
        out += minhash(shingles(chunk), bins, bits)
    return out


def _hex(packed: bytes | None) -> str:
    return packed.hex() if packed else ""


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the head of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
#: Rows and text bytes of one step of the stream over a partition.
_STEP_ROWS, _STEP_CHARS = 2000, 4_000_000


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of (range, id, text, is_end) of one range, each run ending with the row that
    follows it, which also begins the next."""
    run: list[tuple] = []
    chars = 0
    for batch in batches:
        columns = [batch.column(c) for c in ("_range", "doc_id", "text", "_end")]
        for at in range(batch.num_rows):
            row = tuple(c[at].as_py() for c in columns)
            row = (row[0], row[1], row[2] or "", row[3])
            if run and run[-1][0] != row[0]:
                run, chars = [], 0
            run.append(row)
            chars += len(row[2])
            if len(run) > 1 and (row[3] or len(run) > _STEP_ROWS or chars > _STEP_CHARS):
                yield run
                run, chars = [row], len(row[2])
    # a range always ends with its end row, so nothing is left over


def _fingerprint_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _steps(batches):
        texts = [r[2] for r in run]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = fingerprint_texts(texts), fingerprint_texts(changed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in run[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([_hex(p) for p in own[:-1]], pa.string()),
                pa.array([_hex(p) for p in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            schema=_ARROW,
        )


def id_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[int]:
    """Ids that cut the documents into ranges of about ``range_bytes``: one aggregate whose
    result has an entry for each range."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // range_bytes)
    cuts = [i / parts for i in range(1, parts)]
    if not cuts:
        return []
    found = docs.agg(F.percentile_approx("doc_id", cuts, 100 * parts)).first()[0]
    return sorted(set(found or []))


def _range_number(cuts: list[int]) -> Column:
    """How many of the rising ``cuts`` are at or below ``doc_id``: first among every n-th of
    them, then among the n that follow, so a row looks at about two square roots of them."""
    if not cuts:
        return F.lit(0)
    run = max(1, math.isqrt(len(cuts)))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("doc_id")))

    def fixed(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")

    coarse = F.greatest(below(fixed(cuts[::run])) - 1, F.lit(0)) * run
    return coarse + below(F.slice(fixed(cuts), coarse + 1, F.lit(run)))


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited form (see :data:`SCHEMA`).

    Documents go to ranges of ids, each sorted in its task and streamed once. A range is
    followed by a copy of the first row of the next (the last by the first of all), so a row
    meets its successor without a global sort: one shuffle of the texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = id_ranges(docs, range_bytes)
    which = _range_number(cuts)
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), 0).otherwise(which))
    firsts = (
        ranged.groupBy("_range")
        .agg(F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
        .orderBy("_range")
        .collect()  # a row for each range
    )
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    ends = [
        (firsts[i - 1]._range, None if r._null else r._first) for i, r in enumerate(firsts)
    ]
    ends = docs.sparkSession.createDataFrame(ends, "_range int, _id long")
    heads = (
        docs.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")))
        .groupBy("_range", "doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        .select("_range", "doc_id", "text", F.lit(True).alias("_end"))
    )
    rows = ranged.select("_range", "doc_id", "text", F.lit(False).alias("_end")).union(heads)
    return (
        rows.repartitionById(firsts[-1]._range + 1, F.col("_range"))
        .sortWithinPartitions("_range", "_end", "doc_id", "text")
        .mapInArrow(_fingerprint_ranges, SCHEMA)
    )
