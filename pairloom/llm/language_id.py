"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long, learned from a bounded sample of
labelled rows and then frozen. A byte seen in a context costs its share there; an unseen one pays the
escape and is looked for in the next shorter context, down to all bytes alike. The language with the
shortest code of the whole text is the prediction.

As the statistics are frozen, the cost of a byte depends only on the longest context in the tree and
the byte, so both become tables: one finds the context of any three bytes, the other has the cost of
each byte in it for every language. A text is then two look-ups a byte and a sum.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled
row to learn from every text is. Equal codes go to the alphabetically first language. A row without
``doc_id`` is not learned from and counts as not held out. Repeated rows each give a row. Columns beyond
``doc_id``, ``text`` and (for learning) ``lang`` are ignored. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.bytesets import chunks

#: Bytes of text looked at together; a byte needs an entry for each language and some numbers.
TEXT_BYTES = 500_000

#: Rows of each language that the statistics are taken from: those with the smallest hashes.
SAMPLE_ROWS = 300

#: A context enters the tree when it was seen so often.
LEAST_SEEN = 8

#: The score counts a text as at most so many bytes, lest every long text have 1.
SCORE_BYTES = 64

#: What stands before a text.
_BEFORE = 0x0A


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray  #: byte -> symbol; unseen bytes share the last one
    context: np.ndarray  #: three symbols -> row of the cost table
    cost: np.ndarray  #: (context, symbol) x language: bits


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept apart for testing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# Learning ------------------------------------------------------------------------------


def _codes(symbols: np.ndarray, starts: np.ndarray, before: int, base: int) -> np.ndarray:
    """For each byte, the number made of the three symbols before it within its text."""
    first = np.zeros(len(symbols), np.int32)
    first[starts[:-1][starts[:-1] < len(symbols)]] = starts[:-1][starts[:-1] < len(symbols)]
    np.maximum.accumulate(first, out=first)
    place = np.arange(len(symbols), dtype=np.int32) - first
    out = np.zeros(len(symbols), np.int32)
    for back in (3, 2, 1):
        earlier = np.full(len(symbols), before, np.int32)
        earlier[back:] = symbols[:-back]
        out = out * base + np.where(place >= back, earlier, before)
    return out


_COUNTS = "lang string, code long, n long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often four bytes follow each other, by language, in the rows of a task."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            mine = batch.column("text").filter(pa.array(langs == lang))
            for texts in chunks(mine):
                before = _codes(texts.data.astype(np.int32), texts.starts, _BEFORE, 256)
                code = before.view(np.uint32).astype(np.int64) * 256 + texts.data
                code, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n, pa.int64())],
                    schema=_COUNTS_ARROW,
                )


def _levels(code: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of (context, byte) for contexts of 0, 1, 2 and 3 bytes."""
    out = []
    for order in range(4):
        c, back = np.unique(code % 256 ** (order + 1), return_inverse=True)
        out.append((c, np.bincount(back, weights=n).astype(np.int64)))
    return out


def build_model(rows: Iterable[tuple[str, int, int]]) -> Model:
    """The tables from (language, four bytes as a number, count)."""
    by_lang: dict[str, list[tuple[int, int]]] = {}
    for lang, code, n in rows:
        by_lang.setdefault(lang, []).append((code, n))
    languages = sorted(by_lang)
    levels = {
        x: _levels(*(np.array(c, np.int64) for c in zip(*by_lang[x]))) for x in languages
    }
    known = {_BEFORE}
    for x in languages:
        for place in range(4):
            known.update((levels[x][3][0] >> (8 * place) & 255).tolist())
    alphabet = np.array(sorted(known), np.int64)
    base = len(alphabet) + 1
    symbol = np.full(256, base - 1, np.int32)
    symbol[alphabet] = np.arange(base - 1)

    # contexts in the tree of any language, shortest first
    nodes: list[list[int]] = [[0], [], [], []]
    for order in (1, 2, 3):
        seen: set[int] = set()
        for x in languages:
            code, n = levels[x][order]
            context, back = np.unique(code >> 8, return_inverse=True)
            seen.update(context[np.bincount(back, weights=n) >= LEAST_SEEN].tolist())
        nodes[order] = sorted(seen)
    first = np.cumsum([0, *(len(x) for x in nodes)])

    cost = np.zeros((first[-1], base, len(languages)), np.float32)
    for k, x in enumerate(languages):
        shorter = None  # cost by context of the level below
        for order in range(4):
            code, n = levels[x][order]
            owner = {c: i for i, c in enumerate(nodes[order])}
            if order == 0:
                level = np.full((1, base), 8.0)
            else:
                parent = {c: i for i, c in enumerate(nodes[order - 1])}
                mask = 256 ** (order - 1) - 1
                up = [parent.get(c & mask, 0) for c in nodes[order]]
                level = shorter[up].copy() if up else np.zeros((0, base))
            context = np.array([owner.get(c, -1) for c in (code >> 8).tolist()], np.int64)
            mine = context >= 0
            context, sym, n = context[mine], symbol[code[mine] & 255], n[mine]
            total = np.bincount(context, weights=n, minlength=len(level))
            kinds = np.bincount(context, minlength=len(level))
            used = total > 0
            level[used] += np.log2((total + kinds)[used] / kinds[used])[:, None]
            level[context, sym] = np.log2((total + kinds)[context] / n)
            cost[first[order] : first[order + 1], :, k] = level
            shorter = level
    context = np.zeros(base**3, np.int32)
    for order in (1, 2, 3):
        for i, c in enumerate(nodes[order]):
            spot = [int(symbol[c >> (8 * p) & 255]) for p in reversed(range(order))]
            at = 0
            for s in spot:
                at = at * base + s
            # the context is what comes last; the symbols before it may be any
            context[at :: base**order] = first[order] + i
    return Model(languages, symbol, context, cost.reshape(-1, len(languages)))


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the languages in ``lang``; None without labelled text.

    The sample is bounded by ``sample_rows`` for each language, and so is what reaches the driver:
    counts of four-byte sequences of that sample.
    """
    labelled = docs.filter("doc_id is not null and lang is not null and text is not null")
    labelled = labelled.filter(~held_out())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labelled.select("doc_id", "lang")
        .withColumn("_rank", F.row_number().over(by_hash))
        .filter(F.col("_rank") <= sample_rows)
        .select("doc_id", "lang")
        .distinct()
    )
    counts = (
        labelled.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .select("lang", "text")
        .mapInArrow(_count, _COUNTS)
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    if not counts.num_rows:
        return None
    return build_model(zip(*(counts.column(c).to_pylist() for c in ("lang", "code", "n"))))


# Prediction ----------------------------------------------------------------------------


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each whole text under each language."""
    base = round(len(model.context) ** (1 / 3))
    before = int(model.symbol[_BEFORE])
    out = np.zeros((len(column), len(model.languages)))
    for texts in chunks(column, TEXT_BYTES):
        if not len(texts.data):
            continue
        symbols = model.symbol[texts.data]
        context = model.context[_codes(symbols, texts.starts, before, base)]
        bits = model.cost[context.astype(np.int64) * base + symbols]
        full = np.flatnonzero(np.diff(texts.starts) > 0)
        out[texts.first + full] = np.add.reduceat(bits, texts.starts[full], axis=0, dtype=np.float64)
    return out


def language_of(model: Model | None, shared=None):
    """A function of the columns ``text`` and ``letters`` (has it one?) that gives the struct
    ``lang_pred, score``. ``shared`` is the broadcast of ``model``."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series, letters: pd.Series) -> pd.DataFrame:
        frozen = shared.value
        names = np.array([*frozen.languages, "und"], dtype=object)
        column = pa.array(text, pa.large_string(), from_pandas=True)
        bits = code_lengths(frozen, column)
        letters = letters.to_numpy(bool)
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        scale = np.minimum(1.0, SCORE_BYTES / np.maximum(size, 1))
        beyond = (bits - bits.min(axis=1, keepdims=True)) * scale[:, None]
        score = 1 / np.exp2(-beyond).sum(axis=1)
        best = np.where(letters, bits.argmin(axis=1), len(names) - 1)
        return pd.DataFrame({"lang_pred": names[best], "score": np.where(letters, score, 0.0)})

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return predicted(text, letters)


def prediction(docs: DataFrame, labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> Column:
    """The struct ``lang_pred, score`` as a column of ``docs``, for filters and projections."""
    model = learn(docs if labelled is None else labelled, sample_rows)
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    return language_of(model, shared)


def identify(docs: DataFrame, labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row. Learns from ``labelled``
    (``doc_id, text, lang``), by default from ``docs``; predictions see the text only and shuffle
    nothing."""
    found = prediction(docs, labelled, sample_rows)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), found.alias("_found")
    ).select("doc_id", "held_out", "_found.lang_pred", "_found.score")
