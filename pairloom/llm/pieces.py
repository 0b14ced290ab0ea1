"""SentencePiece encoding by sampling, and decoding.

A text is cut into units (spaces and the word that follows, or one control character). No piece of
the vocabulary crosses a unit's edge, so the piece lattice of a text is the chain of its units'
lattices. Forward filtering sums, for every place of a unit, the weight of all segmentations up to it;
backward sampling then draws a segmentation from its end, each piece by its share. Lattices are
filtered once for each distinct unit of a chunk, all units together; draws are made for every
occurrence, also together.

Randomness is a hash of the row's key, the unit's place and the step, so a row is always segmented
alike, whatever its partition, batch or attempt. Piece weights fall with the rank of the piece
(Zipf's law) to the power ``theta``; a large ``theta`` approaches the most likely segmentation.

Decoding is lossless: a space is the piece mark, there is no normalisation, and a character without
a piece (such as a line break or the mark itself) is written as byte pieces.

Defined results: a null text has null pieces and decodes to null; an empty one has none and decodes to
an empty text; rows without a key are drawn as key 0; repeated rows are segmented alike. Columns
beyond key and text are ignored (encode) or kept (decode). Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bytesets import Texts, chunks, mix, span_hashes, word_hashes

#: The vocabulary; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Bytes of text whose lattices are held at once; more would cost memory and save no time.
CHUNK_BYTES = 400_000

#: Weight of a byte piece, in nats; it is only in lattices of characters without a piece.
_BYTE_WEIGHT = -12.0

_U = np.uint64
_SPACE = 0x20
_CONTROL = np.zeros(256, bool)
_CONTROL[0x09:0x0E] = True


class Vocabulary:
    """Pieces as bytes (the mark as a space) with their weights. Travels to the tasks by
    broadcast; the look-up tables are made there."""

    def __init__(self, pieces: list[bytes], byte_ids: dict[int, int], ranks: list[float], theta: float):
        self.pieces = pieces  #: bytes by id; empty for pieces that stand for no text
        self.byte_ids = byte_ids  #: byte -> id of its byte piece
        self.ranks = ranks
        self.theta = theta

    @classmethod
    def load(cls, path: str = MODEL, theta: float = 1.0) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, ranks = [], {}, []
        for i in range(model.get_piece_size()):
            raw = b""
            if model.is_byte(i):
                byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace("▁", " ")
                if " " in piece.lstrip(" "):
                    raise ValueError(f"piece {i} crosses a word's edge")
                raw = piece.encode()
            pieces.append(raw)
            ranks.append(min(-model.get_score(i), model.get_piece_size()) + 1.0)
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        return cls(pieces, byte_ids, ranks, theta)

    def __getstate__(self):
        return (self.pieces, self.byte_ids, self.ranks, self.theta)

    def __setstate__(self, state):
        self.pieces, self.byte_ids, self.ranks, self.theta = state

    @cached_property
    def decode_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes one after the other, and where each begins."""
        raw = list(self.pieces)
        for byte, i in self.byte_ids.items():
            raw[i] = bytes([byte])
        starts = np.concatenate([[0], np.cumsum([len(p) for p in raw])])
        return np.frombuffer(b"".join(raw), np.uint8), starts

    @cached_property
    def weights(self) -> np.ndarray:
        out = -self.theta * np.log(np.array(self.ranks))
        out[list(self.byte_ids.values())] = _BYTE_WEIGHT * self.theta
        return out

    @cached_property
    def byte_piece(self) -> np.ndarray:
        return np.array([self.byte_ids[b] for b in range(256)], np.int32)

    @cached_property
    def lookup(self) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
        """A hash table (hashes, ids; free slots have id -1) and the lengths that occur."""
        texts = Texts(0, *_joined([p for p in self.pieces if p]))
        ids = np.array([i for i, p in enumerate(self.pieces) if p], np.int32)
        hashes = word_hashes(texts, texts.starts[:-1], texts.starts[1:], fold=False)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        bits = 17
        while 1 << bits < 4 * len(ids):
            bits += 1
        table, owner = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for h, i in zip(hashes.tolist(), ids.tolist()):
            at = h >> (64 - bits)
            while owner[at] >= 0:
                at = (at + 1) & ((1 << bits) - 1)
            table[at], owner[at] = h, i
        return table, owner, bits, sorted({len(p) for p in self.pieces if p})

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, or -1."""
        table, owner, bits, _ = self.lookup
        at = (hashes >> _U(64 - bits)).astype(np.int64)
        out = np.where(table[at] == hashes, owner[at], -1)
        todo = np.flatnonzero((table[at] != hashes) & (owner[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << bits) - 1)
            hit = table[at[todo]] == hashes[todo]
            out[todo[hit]] = owner[at[todo[hit]]]
            todo = todo[~hit & (owner[at[todo]] >= 0)]
        return out


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), starts


def units(texts: Texts) -> np.ndarray:
    """Byte offsets where units begin, and the end of the chunk."""
    data = texts.data
    n = len(data)
    begin = np.zeros(n, bool)
    control = _CONTROL[data]
    space = data == _SPACE
    begin[control] = True
    begin[1:] |= control[:-1] | (space[1:] & ~space[:-1])
    begin[texts.starts[texts.starts < n]] = True
    return np.append(np.flatnonzero(begin), n)


class _Lattice:
    """Filtered lattices of distinct units: the edges that end at each place, with the running
    share of the weight that comes through them."""

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray):
        n = len(data)
        self.starts = starts
        size = np.diff(starts)
        end_of = np.repeat(starts[1:], size)
        place = np.arange(n)
        offset = place - np.repeat(starts[:-1], size)
        texts = Texts(0, data, starts)
        sums = span_hashes(texts, fold=False)
        ends, befores, ids = [], [], []
        single = np.zeros(n, bool)  # bytes of characters that have a piece of their own
        lead = (data & 0xC0) != 0x80
        width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        begins = np.flatnonzero(lead)
        for length in vocabulary.lookup[3]:  # rising, so fewer and fewer places have room
            begins = begins[begins + length <= end_of[begins]]
            if not len(begins):
                break
            found = vocabulary.find(sums(begins, begins + length))
            hit = found >= 0
            at, found = begins[hit], found[hit]
            ends.append(at + length)
            befores.append(at)
            ids.append(found)
            own = at[width[at] == length]
            for k in range(length if len(own) else 0):
                single[own + k] = True
        bare = np.flatnonzero(~single)
        ends.append(bare + 1)
        befores.append(bare)
        ids.append(vocabulary.byte_piece[data[bare]])
        end, before, piece = (np.concatenate(x) for x in (ends, befores, ids))
        # a place is named by the byte that ends there, so units do not share places
        order = np.lexsort((before, end))
        self.before, self.piece = before[order].astype(np.int64), piece[order]
        end = end[order] - 1
        weight = vocabulary.weights[self.piece]
        self.first = np.searchsorted(end, np.arange(n + 1))
        alpha = np.full(n, -np.inf)
        share = np.empty(len(end))
        far = offset[end]
        by_offset = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 65536 else far, kind="stable")
        cuts = np.searchsorted(far[by_offset], np.arange((size.max() if len(size) else 0) + 1))
        for lo, hi in zip(cuts, cuts[1:]):
            edges = by_offset[lo:hi]
            if not len(edges):
                continue
            from_ = self.before[edges]
            total = weight[edges] + np.where(offset[from_] == 0, 0.0, alpha[from_ - 1])
            to = end[edges]
            heads = np.flatnonzero(np.diff(to, prepend=-1))
            counts = np.diff(heads, append=len(to))
            top = np.repeat(np.maximum.reduceat(total, heads), counts)
            top = np.where(np.isfinite(top), top, 0.0)
            part = np.exp(total - top)
            running = np.cumsum(part)
            base = np.repeat(running[heads] - part[heads], counts)
            whole = np.repeat(np.add.reduceat(part, heads), counts)
            with np.errstate(divide="ignore", invalid="ignore"):
                share[edges] = np.where(whole > 0, (running - base) / whole, 1.0)
                alpha[to] = top + np.log(whole)
        # one rising array over all places, searched for place + draw
        self.cumulative = end + np.minimum(share, 1.0)

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """For each place, the edge ending there that the draw falls on."""
        edge = np.searchsorted(self.cumulative, place + u, "right")
        return np.minimum(edge, self.first[place + 1] - 1)


def encode_chunk(vocabulary: Vocabulary, texts: Texts, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled piece ids of all texts one after the other, and where each text begins.

    ``keys`` has a 64-bit key for each text.
    """
    if not len(texts.data):
        return np.zeros(0, np.int32), np.zeros(texts.count + 1, np.int64)
    cuts = units(texts)
    begin, end = cuts[:-1], cuts[1:]
    hashes = word_hashes(texts, begin, end, fold=False)
    _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = (end - begin)[once]
    starts = np.concatenate([[0], np.cumsum(size)])
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    lattice = _Lattice(vocabulary, texts.data[np.repeat(begin[once], size) + within], starts)

    unit_ptr = np.searchsorted(begin, texts.starts)
    doc = np.repeat(np.arange(texts.count), np.diff(unit_ptr))
    number = np.arange(len(begin)) - unit_ptr[doc]
    seeds = mix(keys[doc] + mix(number.astype(np.uint64) + _U(0x9E3779B97F4A7C15)))
    # occurrences of one unit together, so that draws search one part of the lattices after the other
    active = np.argsort(which, kind="stable")
    first, place = starts[which[active]], starts[which[active] + 1] - 1
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(active):
        u = (mix(seeds[active] + _U(step)) >> _U(11)).astype(np.float64) * 2.0**-53
        edge = lattice.draw(place, u)
        taken.append((active, lattice.piece[edge]))
        place = lattice.before[edge] - 1
        going = place >= first
        active, place, first = active[going], place[going], first[going]
        step += 1
    count = np.zeros(len(begin), np.int64)
    for rows, _ in taken:
        count[rows] += 1
    ptr = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(ptr[-1], np.int32)
    for k, (rows, piece) in enumerate(taken):  # drawn from the end
        out[ptr[rows + 1] - 1 - k] = piece
    return out, ptr[unit_ptr]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the pieces stand for, one text after the other, and where each begins."""
    data, starts = vocabulary.decode_table
    size = np.diff(starts)[ids]
    to = np.concatenate([[0], np.cumsum(size)])
    shift = starts[ids] - to[:-1]
    return data[np.arange(to[-1]) + np.repeat(shift, size)], to[ptr]


# Over DataFrames -----------------------------------------------------------------------

_ENCODED = "doc_id long, n_pieces int, pieces array<int>, lossless boolean"
_ENCODED_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_pieces", pa.int32()), ("pieces", pa.list_(pa.int32())), ("lossless", pa.bool_())]
)


def row_keys(doc_ids: pa.Array, seed: int) -> np.ndarray:
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return mix(ids + mix(np.array([seed], np.uint64))[0])


def _encode(batches: Iterable[pa.RecordBatch], shared, seed: int) -> Iterator[pa.RecordBatch]:
    vocabulary = shared.value
    for batch in batches:
        column = batch.column("text")
        keys = row_keys(batch.column("doc_id"), seed)
        for texts in chunks(column, CHUNK_BYTES):
            rows = slice(texts.first, texts.first + texts.count)
            ids, ptr = encode_chunk(vocabulary, texts, keys[rows])
            back, back_ptr = decode_ids(vocabulary, ids, ptr)
            wrong = np.zeros(texts.count, bool)
            if len(back) == len(texts.data):
                at = np.flatnonzero(back != texts.data)
                wrong[np.searchsorted(texts.starts, at, "right") - 1] = True
            wrong |= back_ptr[1:] != texts.starts[1:]
            null = column.slice(texts.first, texts.count).is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(ptr[:-1], ptr[-1]), pa.int32(), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(texts.first, texts.count),
                    pa.array(np.diff(ptr), pa.int32(), mask=null),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.array(~wrong, pa.bool_(), mask=null),
                ],
                schema=_ENCODED_ARROW,
            )


def encode(docs: DataFrame, model: str = MODEL, seed: int = 0, theta: float = 1.0) -> DataFrame:
    """``doc_id, n_pieces, pieces`` of every whole text, and ``lossless``: whether decoding those
    pieces gave the text's bytes again."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, theta))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda batches: _encode(batches, shared, seed), _ENCODED)


def decode(encoded: DataFrame, pieces: str = "pieces", out: str = "text", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its pieces as column ``out``."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        known = [np.zeros(0, np.int32) if x is None else np.asarray(x, np.int32) for x in column]
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in known])]).astype(np.int64)
        ids = np.concatenate([*known, np.zeros(0, np.int32)])
        data, at = decode_ids(shared.value, ids, ptr)
        raw = data.tobytes()
        return pd.Series(
            [None if x is None else raw[a:b].decode() for x, a, b in zip(column, at, at[1:])], dtype=object
        )

    return encoded.withColumn(out, text_of(pieces))
