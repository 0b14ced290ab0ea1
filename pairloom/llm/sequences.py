"""Token ids as equal-length sequences in Arrow stream files.

Documents are sorted by id, encoded, closed by an end id and written back to back: the ids of all
documents are one long run, cut into sequences of ``LENGTH``. A file holds the documents of one range
of ids in the Arrow stream format: record batches of two fixed-size lists, ``input_ids`` (unsigned, 16 bits
if the vocabulary fits, else 32) and ``attention_mask`` (one byte: 1 for an id, 0 for what fills the file's last sequence). Every
sequence has the same bytes, so :class:`SequenceFile` maps a file and gives the i-th sequence and mask
as views of it, without a copy. Beside each file lies a second Arrow stream with ``doc_id``, ``start``
(place of its first id in the file) and ``n_tokens`` of its documents. The manifest, a Parquet
table with a row for each file, is written last and by Spark's own commit: files of lost or repeated
attempts are in no manifest, and a folder without one holds nothing.

The vocabulary drops case and white space and encodes letters, digits and other characters apart. A text is therefore
cut into units at ASCII characters, each distinct unit is encoded once by the library, and ids are laid out by index.

Defined results: a null text counts as empty; an empty text, or one of white space only, has just the end id.
Rows without ``doc_id`` come first; equal ids are ordered by a hash of their texts; every row is a document,
repeated ones too. Strings of special tokens in a text are encoded as the library does by default. Columns beyond
``doc_id`` and ``text`` are ignored, whatever their names. An empty table gives an empty manifest and no documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.bytesets import Texts, chunks, word_spans
from pairloom.operators.ordinal import running_offsets
from pairloom.operators.sizing import settle
from pairloom.workspace import new_dir

#: The vocabulary; a parameter of the operators.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"

#: Id that closes a document.
END = 1

#: Ids of a sequence, and sequences of a record batch.
LENGTH = 1024
BATCH = 256

#: Text bytes of one file, as the number of files is chosen.
FILE_BYTES = 48_000_000

#: Units a worker remembers twice over with their ids (200 bytes each), the longest of them, and units
#: given to the library at once.
KNOWN_UNITS = 500_000
KNOWN_BYTES = 64
ENCODE_UNITS = 5_000

#: ASCII white space.
_WHITE = "\t\n\x0b\f\r "


# Encoding ------------------------------------------------------------------------------

_LETTER, _DIGIT, _OTHER, _APOSTROPHE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)  # 0: white space, control characters and all bytes that are not ASCII
_CLASS[33:127] = _OTHER
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _APOSTROPHE
#: Whether a text may be cut between a byte of one class and one of another: between letters, digits and
#: others, between two digits, but not behind an apostrophe that a letter follows.
_CUT = np.zeros((5, 5), bool)
_CUT[_LETTER, [_DIGIT, _OTHER, _APOSTROPHE]] = True
_CUT[_DIGIT, 1:] = True
_CUT[_OTHER, [_LETTER, _DIGIT]] = True
_CUT[_APOSTROPHE, _DIGIT] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class _Known:
    """Ids of the units met lately: two generations, the older of which is forgotten when the newer is full."""

    def __init__(self, size: int):
        self._size, self._new, self._old = size, {}, {}

    def get(self, unit: str) -> bytes | None:
        ids = self._new.get(unit)
        if ids is None:
            ids = self._old.get(unit)
            if ids is not None:
                self.put(unit, ids)
        return ids

    def put(self, unit: str, ids: bytes) -> None:
        if len(unit) <= KNOWN_BYTES:
            if len(self._new) >= self._size:
                self._old, self._new = self._new, {}
            self._new[unit] = ids


class UnitEncoder:
    """The library's encoder, called once for each distinct unit of text.

    For vocabularies like the given one: lower case, white space dropped, words, single digits and runs of other
    characters encoded apart. A unit is a word with what stands at its sides cut off, where that is ASCII.
    """

    def __init__(self, path: str = TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Known(KNOWN_UNITS)
        added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        #: Their strings are looked for in the raw text, so they must not be cut or folded.
        self._added = [t.lower().encode() for t in added]
        whole = self._tokenizer.encode("Ab, c12\td", add_special_tokens=False).ids
        parts = self._tokenizer.encode_batch(["ab", ", ", "c", "1", "2\t", "d"], add_special_tokens=False)
        if whole != [i for p in parts for i in p.ids] or any(c.isspace() for t in added for c in t):
            raise ValueError(f"{path} does not encode units of a text apart")

    def id_type(self, *others: int) -> np.dtype:
        """The smaller of two unsigned types that holds every id, and ``others``."""
        largest = max(self._tokenizer.get_vocab_size(with_added_tokens=True) - 1, *others)
        return np.dtype(np.uint16 if largest < 1 << 16 else np.uint32)

    def _encode(self, units: list[str]) -> list[bytes]:
        found = [self._known.get(u) for u in units]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for lo in range(0, len(missing), ENCODE_UNITS):
            some = missing[lo : lo + ENCODE_UNITS]
            encoded = self._tokenizer.encode_batch([units[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, encoded):
                found[i] = np.array(e.ids, np.uint32).tobytes()
                self._known.put(units[i], found[i])
        return found

    def _units(self, run: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of a run of texts begin, and its bytes as they are to be encoded. A unit has
        the white space behind it, so units lie end to end."""
        begin, _ = word_spans(run)
        folded = _FOLD[run.data]
        raw = folded.tobytes()
        if any(a in raw for a in self._added):
            return begin, run.data
        kind = _CLASS[folded]
        starts = np.zeros(len(kind), bool)
        starts[1:] = _CUT[kind[:-1], kind[1:]]
        starts[begin] = True
        return np.flatnonzero(starts), folded

    def texts(self, column: pa.Array, end: int = END) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of a column's texts: the first of them, all their ids with ``end`` behind each
        text, and how many each text has."""
        for run in chunks(column):
            begin, data = self._units(run)
            edges = np.append(begin, len(data)) if len(begin) else np.zeros(1, np.int64)
            units = pa.LargeStringArray.from_buffers(
                len(begin), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
            ).dictionary_encode()
            ids = self._encode([u.rstrip(_WHITE) for u in units.dictionary.to_pylist()])
            size = np.array([len(x) // 4 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), np.uint32)
            at = np.cumsum(size) - size
            which = units.indices.to_numpy(zero_copy_only=False)
            n = size[which]
            first = np.concatenate([[0], np.cumsum(n)])
            n_tokens = np.diff(first[np.searchsorted(begin, run.starts)]) + 1
            out = np.full(int(first[-1]) + run.count, end, np.uint32)
            is_unit = np.ones(len(out), bool)
            is_unit[np.cumsum(n_tokens) - 1] = False
            out[is_unit] = flat[np.repeat(at[which] - first[:-1], n) + np.arange(first[-1])]
            yield run.first, out, n_tokens


@cache
def _encoder(path: str) -> UnitEncoder:
    """One for a worker, which keeps what it knows from task to task."""
    return UnitEncoder(path)


# Files ---------------------------------------------------------------------------------


def _sequences(length: int, ids: np.dtype) -> pa.Schema:
    return pa.schema(
        [
            pa.field("input_ids", pa.list_(pa.field("item", pa.from_numpy_dtype(ids), nullable=False), length), nullable=False),
            pa.field("attention_mask", pa.list_(pa.field("item", pa.uint8(), nullable=False), length), nullable=False),
        ]
    )


_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or the local one, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _Writer:
    """One Arrow stream file of sequences and its file of documents."""

    def __init__(self, path: str, length: int, batch: int, ids: np.dtype):
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self._schema, self._length, self._batch, self._type = _sequences(length, ids), length, batch, ids
        self._sinks = [system.open_output_stream(place), system.open_output_stream(f"{place}.docs")]
        self._ids = pa.ipc.new_stream(self._sinks[0], self._schema)
        self._docs = pa.ipc.new_stream(self._sinks[1], _DOCUMENTS)
        self._waiting: list[np.ndarray] = []
        self._held = 0
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, n_tokens: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(n_tokens) - n_tokens
        self._docs.write_batch(
            pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(n_tokens)], schema=_DOCUMENTS)
        )
        self.n_docs += len(n_tokens)
        self.n_tokens += len(ids)
        self._waiting.append(ids.astype(self._type))
        self._held += len(ids)
        if self._held >= self._length * self._batch:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.zeros(0, self._type)
        per = self._length * self._batch
        whole = len(ids) if last else len(ids) // per * per
        for lo in range(0, whole, per):
            part = ids[lo : min(lo + per, whole)]
            rows = -(-len(part) // self._length)
            mask = np.ones(rows * self._length, np.uint8)
            mask[len(part) :] = 0
            if len(part) < len(mask):
                part = np.concatenate([part, np.zeros(len(mask) - len(part), self._type)])
            columns = [
                pa.FixedSizeListArray.from_arrays(pa.array(v), type=self._schema.field(i).type)
                for i, v in enumerate((part, mask))
            ]
            self._ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))
        self._waiting = [ids[whole:]]
        self._held = len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        for x in (self._ids, self._docs, *self._sinks):
            x.close()


class SequenceFile:
    """Random access to the sequences of one file. Where the file system can be mapped nothing is
    copied; elsewhere the file is read whole."""

    def __init__(self, path: str):
        system, place = _open(path)
        local = isinstance(system, fs.LocalFileSystem)
        self._source = pa.memory_map(place) if local else system.open_input_file(place)
        self._batches = pa.ipc.open_stream(self._source).read_all().to_batches()
        self._first = np.concatenate([[0], np.cumsum([b.num_rows for b in self._batches])])

    def __len__(self) -> int:
        return int(self._first[-1])

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self._first, i, "right")) - 1
        row = i - int(self._first[b])
        columns = self._batches[b].columns
        return tuple(
            c.values.to_numpy()[(c.offset + row) * c.type.list_size : (c.offset + row + 1) * c.type.list_size]
            for c in columns
        )


_MANIFEST = "part long, path string, n_docs long, n_tokens long, n_sequences long"
_MANIFEST_ARROW = pa.schema(
    [("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]
)


def _write_part(
    batches: Iterable[pa.RecordBatch], folder: str, tokenizer: str, length: int, batch: int, end: int
) -> Iterator[pa.RecordBatch]:
    writer = None
    part = TaskContext.get().partitionId()
    path = f"{folder}/part-{part:08d}-{uuid.uuid4().hex}.arrow"
    for rows in batches:
        doc_ids = rows.column("doc_id")
        for first, ids, n_tokens in _encoder(tokenizer).texts(rows.column("text"), end):
            writer = writer or _Writer(path, length, batch, _encoder(tokenizer).id_type(end))
            writer.add(doc_ids.slice(first, len(n_tokens)), ids, n_tokens)
    if writer is not None:
        writer.close()
        row = [part, path, writer.n_docs, writer.n_tokens, -(-writer.n_tokens // length)]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MANIFEST_ARROW)], schema=_MANIFEST_ARROW)


def write_sequences(
    docs: DataFrame,
    out: str,
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    batch: int = BATCH,
    end: int = END,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode ``docs`` (``doc_id, text``) into the new folder ``out``: one shuffle of the texts to ranges of ids,
    in which each file is written as its range streams by.

    Rows that are equal are told apart by their place in the input, so no range must take all copies of one row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // file_bytes + 1)
    order = ["doc_id", "_hash", "_place"]
    placed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    write = partial(
        _write_part, folder=f"{out.rstrip('/')}/files", tokenizer=tokenizer, length=length, batch=batch, end=end
    )
    ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(f"{out.rstrip('/')}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, with ``offset``, the ids of all files before it. One row for some megabytes of text."""
    files = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    counts = files.select(F.col("part").alias("_slot"), F.col("n_tokens").alias("n"))
    offsets = running_offsets(settle(counts), [])
    return files.join(offsets, files.part == offsets._slot).drop("_slot")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _READ.split(", ")])


def _views(path: str) -> Iterator[np.ndarray]:
    """The ids of a file, batch by batch, without what fills its end."""
    system, place = _open(path)
    source = pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
    with source, pa.ipc.open_stream(source) as stream:
        for batch in stream:
            ids, mask = (batch.column(c).flatten().to_numpy() for c in ("input_ids", "attention_mask"))
            yield ids if mask[-1] else ids[: np.count_nonzero(mask)]


def _documents(path: str) -> Iterator[pa.RecordBatch]:
    system, place = _open(f"{path}.docs")
    with system.open_input_file(place) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


def _read_files(batches: Iterable[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents of the files a task was given, put together from the views of their sequences."""
    for path, offset in ((p, o) for b in batches for p, o in zip(b.column("path").to_pylist(), b.column("offset").to_pylist())):
        views = _views(path)
        view, used = np.zeros(0, np.uint16), 0
        for docs in _documents(path):
            sums, held = [], []
            for n in docs.column("n_tokens").to_pylist():
                crc, own = 0, []
                while n:
                    if used == len(view):
                        view, used = next(views), 0
                    piece = view[used : used + n]
                    crc = zlib.crc32(piece.astype("<u4"), crc)
                    if ids:
                        own.append(piece)
                    used += len(piece)
                    n -= len(piece)
                sums.append(crc)
                held.append(own)
            start = docs.column("start").to_numpy() + offset
            columns = [docs.column("doc_id"), pa.array(start), docs.column("n_tokens"), pa.array(sums, pa.int64())]
            schema = _READ_ARROW
            if ids:
                columns.append(pa.array([np.concatenate(x).astype(np.int32) for x in held], pa.list_(pa.int32())))
                schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a folder of :func:`write_sequences`, read from its
    files, a task for some of them; ``ids`` adds the ids as an array."""
    files = read_manifest(spark, path).select("part", "path", "offset")
    tasks = max(1, files.count())
    dealt = files.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).select("path", "offset")
    return dealt.mapInArrow(partial(_read_files, ids=ids), _READ + ", ids array<int>" * ids)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``sequence, input_ids, attention_mask`` of every sequence, in the order of ``sequence`` within a file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, place in zip(b.column("part").to_pylist(), b.column("path").to_pylist()):
                at = 0
                system, name = _open(place)
                with system.open_input_file(name) as source, pa.ipc.open_stream(source) as stream:
                    for batch in stream:
                        n = batch.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, part)),
                                pa.array(np.arange(at, at + n)),
                                batch.column("input_ids").cast(pa.list_(pa.int32())),
                                batch.column("attention_mask").cast(pa.list_(pa.int8())),
                            ],
                            names=["part", "sequence", "input_ids", "attention_mask"],
                        )
                        at += n

    files = spark.read.schema(_MANIFEST).parquet(f"{path.rstrip('/')}/manifest").select("part", "path")
    tasks = max(1, files.count())
    return files.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).mapInArrow(
        run, "part long, sequence long, input_ids array<int>, attention_mask array<tinyint>"
    )


def token_digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all documents to a new folder of the shared storage and return what its files hold of each."""
    spark = docs.sparkSession
    out = new_dir(spark, "sequences")
    write_sequences(docs, out, tokenizer)
    return read_documents(spark, out)
