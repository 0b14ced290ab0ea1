"""N-gram Jaccard join of all documents, and its connected components.

Two documents link when the Jaccard similarity of their sets of distinct five-word shingles is at
least ``PERCENT`` / 100. A pair that links shares at least T shingles, T being that part of the
larger set: finding such pairs is T-occurrence search over inverted lists.

1. Every text becomes a set of 64-bit shingle hashes; equal sets are one from here on. Shingles
   in a large part of all sets are the *long lists*. There are few of them, a multiple of the
   mean set size whatever the input, and they are broadcast.
2. The other shingles travel, packed, to the task of their hash range, which keeps those that
   two sets or more have. A set that shares fewer than T shingles, counting its long lists as
   shared, has no partner and is done. Nearly all sets are.
3. The rest keep the n - T + 1 rarest of their shingles, of which two linked sets always share
   one: sets that meet there form candidate clusters (connected components of stars, so no list
   is ever turned into pairs).
4. Each cluster is searched exactly with DivideSkip: per query the short inverted lists are
   heap-merged, candidates are then looked up in the long lists by binary search, and those that
   reach the required overlap link. Sets already known to be connected are not compared again.
   A cluster larger than a task's share is searched block against block.

Exactness: 64-bit hashes stand for shingles, and of a travelling hash at least 48 bits beside its
range are kept; sets are told apart by 64 bits. No candidate, list or cluster is capped.

Defined results: null or wordless texts have no shingles, link with nothing and are their own
component; a text of fewer words than a shingle is one shingle as a whole; repeated rows each give
a row; a row without ``doc_id`` counts in its set but never names a component, and gets null if no
other row does. Columns beyond ``doc_id`` and ``text`` are ignored. Empty in, empty out.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bytesets import Shingles, chunks, mix, shingles
from pairloom.llm.components import connected_components
from pairloom.workspace import cut_lineage

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75

#: A shingle counted in at least one of so many sets has a long list.
LONG_LIST_SHARE = 400
LONG_LIST_LEAST = 64

#: Bytes of text described at once, and shingles a task handles at once: gathered before they are sent, compared in a
#: hash range, in a block. A task's arrays are some 100 bytes for each.
TEXT_BYTES = 1_000_000
SEND = 500_000
SHARE = 700_000
BLOCK = 1_000_000
#: Shingles of a hash range, which stay packed until they are compared; with smaller ranges a set's shingles would
#: be torn apart, and each piece names its set.
RANGE = 2_000_000
#: Sets a block of a cluster holds.
BLOCK_SETS = 1024

_U = np.uint64


def required(n: np.ndarray | int, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with one that is no larger."""
    return (percent * n + 99) // 100


def set_ids(sets: Shingles) -> np.ndarray:
    """A 64-bit name of each set, 0 for the empty one."""
    n = np.diff(sets.ptr)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        sums = np.add.reduceat(mix(sets.hashes ^ _U(0x5851F42D4C957F2D)), sets.ptr[:-1][full])
        out[full] = mix(sums + n[full].astype(np.uint64)) | _U(1)
    return out


# 1. Sets and long lists ----------------------------------------------------------------

_SETS = "doc_id long, n_shingles long, set_id long, shingle long, seen long"
_SETS_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _SETS.split(", ")])
#: Frequent shingles a task remembers while it reads.
_REMEMBER = 200_000


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then a row for each shingle seen in several sets of a chunk."""
    seen: dict[int, int] = {}
    for batch in batches:
        doc_ids = batch.column("doc_id")
        for texts in chunks(batch.column("text"), TEXT_BYTES):
            sets = shingles(texts)
            ids = set_ids(sets)
            n = np.diff(sets.ptr)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.slice(texts.first, texts.count),
                    pa.array(n, pa.int64()),
                    pa.array(ids.view(np.int64)),
                    pa.nulls(texts.count, pa.int64()),
                    pa.nulls(texts.count, pa.int64()),
                ],
                schema=_SETS_ARROW,
            )
            _, once = np.unique(ids, return_index=True)
            own = np.zeros(texts.count, bool)
            own[once] = True
            pool = np.sort(sets.hashes[np.repeat(own, n)])
            repeated = np.unique(pool[1:][pool[1:] == pool[:-1]])
            times = np.searchsorted(pool, repeated, "right") - np.searchsorted(pool, repeated)
            for h, t in zip(repeated.view(np.int64).tolist(), times.tolist()):
                seen[h] = seen.get(h, 0) + t
            if len(seen) > _REMEMBER:  # the rarer half cannot be long
                middle = sorted(seen.values())[len(seen) // 2]
                seen = {h: t for h, t in seen.items() if t > middle}
    if seen:
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())],
            schema=_SETS_ARROW,
        )


# 2. Shared shingles --------------------------------------------------------------------

_SENT = "part long, kind int, sets binary, sizes binary, keys binary"
_SENT_ARROW = pa.schema(
    [("part", pa.int64()), ("kind", pa.int32()), ("sets", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary())]
)
#: Kinds of row: shingles of sets; sets with their size and long lists.
_KEYS, _INFO = 0, 1


def _pack48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _key(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A hash as it is known after travelling: its range and 48 bits beside it."""
    return hashes % _U(parts) + _U(parts) * ((hashes // _U(parts)) & _U((1 << 48) - 1))


def _send(batches: Iterable[pa.RecordBatch], parts: int, long_lists) -> Iterator[pa.RecordBatch]:
    """Shingles by hash range and sets by name, packed, for :func:`_share`."""
    by_hash, rank = long_lists.value  # sorted hashes; the place of each by rising count
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    weight = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids, n, hashes = (np.concatenate([h[i] for h in held]) for i in range(3))
        ptr = np.concatenate([[0], np.cumsum(n)])
        _, once = np.unique(ids, return_index=True)
        own = np.zeros(len(ids), bool)
        own[once] = True
        doc = np.repeat(np.arange(len(ids)), n)
        at = np.minimum(np.searchsorted(by_hash, hashes), max(len(by_hash) - 1, 0))
        is_long = by_hash[at] == hashes if len(by_hash) else np.zeros(len(hashes), bool)
        h = np.bincount(doc[is_long], minlength=len(ids))
        travels = ~is_long
        for i in np.flatnonzero(own & (h >= required(n)) & (n > 0)):
            # mostly long lists: the rarest of them belong to what partners must share
            mine = np.flatnonzero(is_long[ptr[i] : ptr[i + 1]]) + ptr[i]
            order = np.argsort(rank[at[mine]])[: h[i] - required(n[i]) + 1]
            travels[mine[order]] = True
        travels &= own[doc]
        part = (hashes[travels] % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, keys, doc_of = part[order], hashes[travels][order] // _U(parts), doc[travels][order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        rows: list[tuple] = []
        for p in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[p], edges[p + 1]
            run = np.flatnonzero(np.diff(doc_of[lo:hi], prepend=-1))
            sizes = np.diff(run, append=hi - lo).astype(np.uint32)
            rows.append((p, _KEYS, ids[doc_of[lo:hi][run]].tobytes(), sizes.tobytes(), _pack48(keys[lo:hi])))
        named = np.flatnonzero(own & (n > 0))
        home = (ids[named] % _U(parts)).astype(np.int64)
        for p in np.unique(home):
            mine = named[home == p]
            longs = [by_hash[at[ptr[i] : ptr[i + 1]][is_long[ptr[i] : ptr[i + 1]]]] for i in mine]
            sizes = np.stack([n[mine], h[mine]], axis=1).astype(np.uint32)
            rows.append((p, _INFO, ids[mine].tobytes(), sizes.tobytes(), np.concatenate(longs).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT_ARROW)] if rows else [pa.array([], f.type) for f in _SENT_ARROW],
            schema=_SENT_ARROW,
        )

    for batch in batches:
        for texts in chunks(batch.column("text"), TEXT_BYTES):
            sets = shingles(texts)
            held.append((set_ids(sets), np.diff(sets.ptr), sets.hashes))
            weight += len(sets.hashes)
            if weight >= SEND:
                yield from flush()
                held, weight = [], 0
    if held:
        yield from flush()


def _each_range(batches: Iterable[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """``of`` for the rows of each hash range a task was given."""
    table = pa.Table.from_batches(batches, _SENT_ARROW)
    for part in pc.unique(table.column("part")).to_pylist():
        yield from of(table.filter(pc.equal(table.column("part"), part))).to_batches()


def _rows(table: pa.Table, kind: int) -> Iterator[tuple[bytes, bytes, bytes]]:
    for k, *row in zip(*(table.column(c).to_pylist() for c in ("kind", "sets", "sizes", "keys"))):
        if k == kind:
            yield tuple(row)


def _share(table: pa.Table, parts: int) -> pa.Table:
    """Of one hash range, the shingles that two sets or more have, sent to the sets' names with
    the number of sets; rows about sets pass through. The range is unpacked in portions by hash."""
    part = table.column("part")[0].as_py()
    rows = [(part, _INFO, *r) for r in _rows(table, _INFO)]
    sent = list(_rows(table, _KEYS))
    portions = -(-sum(len(k) // 6 for _, _, k in sent) // SHARE)
    for portion in range(portions):
        rows += _shared_of(sent, part, parts, portion, portions)
    columns = zip(*rows) if rows else [[] for _ in _SENT_ARROW]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT_ARROW)], schema=_SENT_ARROW)


def _shared_of(sent: list[tuple], part: int, parts: int, portion: int, portions: int) -> list[tuple]:
    unpacked = []
    for s, z, k in sent:
        keys, sids = _unpack48(k), np.repeat(np.frombuffer(s, np.uint64), np.frombuffer(z, np.uint32))
        own = keys % _U(portions) == _U(portion)
        unpacked.append((keys[own], sids[own]))
    keys, sids = (np.concatenate(x) for x in zip(*unpacked))
    order = np.argsort(keys)
    ranked = keys[order]
    again = np.zeros(len(ranked), bool)
    again[1:] = ranked[1:] == ranked[:-1]
    again[:-1] |= again[1:]
    order = order[again]
    keys, sids = keys[order], sids[order]
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[fresh], sids[fresh]
    _, back, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    keys, sids, count = keys[shared], sids[shared], count[back][shared]
    whole = keys * _U(parts) + _U(part)
    home = (sids % _U(parts)).astype(np.int64)
    order = np.lexsort((sids, home))
    whole, sids, home, count = whole[order], sids[order], home[order], count[order]
    rows = []
    for p in np.unique(home):
        lo, hi = np.searchsorted(home, [p, p + 1])
        rows.append((p, _KEYS, sids[lo:hi].tobytes(), count[lo:hi].astype(np.uint32).tobytes(), whole[lo:hi].tobytes()))
    return rows


_OPEN = "set_id long, n long, content array<long>, prefix array<long>"
_OPEN_ARROW = pa.schema(
    [("set_id", pa.int64()), ("n", pa.int64()), ("content", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))]
)


def _open_sets(table: pa.Table, parts: int) -> pa.Table:
    """The sets that share enough to have partners: what they share, and the rarest part of it
    that a partner must have in common with them."""
    info: dict[int, tuple[int, np.ndarray]] = {}
    for s, z, k in _rows(table, _INFO):
        sizes = np.frombuffer(z, np.uint32).reshape(-1, 2).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(sizes[:, 1])])
        longs = np.frombuffer(k, np.uint64)
        for i, sid in enumerate(np.frombuffer(s, np.uint64).tolist()):
            info[sid] = (int(sizes[i, 0]), longs[cut[i] : cut[i + 1]])
    sent = list(_rows(table, _KEYS))
    out: list[tuple] = []
    if sent:
        sids = np.concatenate([np.frombuffer(s, np.uint64) for s, _, _ in sent])
        count = np.concatenate([np.frombuffer(z, np.uint32) for _, z, _ in sent])
        keys = np.concatenate([np.frombuffer(k, np.uint64) for _, _, k in sent])
        order = np.lexsort((keys, count, sids))
        sids, keys = sids[order], keys[order]
        starts = np.flatnonzero(np.diff(sids, prepend=~sids[:1]))
        for lo, hi in zip(starts, np.append(starts[1:], len(sids))):
            n, longs = info[int(sids[lo])]
            mine = keys[lo:hi]  # by rising count
            t, h = required(n), len(longs)
            if h < t:
                left = (n - t + 1) - (n - h - len(mine))
                if left <= 0:
                    continue
                prefix = mine[:left]
            else:
                prefix = mine
            content = np.union1d(mine, _key(longs, parts))
            out.append((np.int64(sids[lo : lo + 1].view(np.int64)[0]), n, content.view(np.int64), prefix.view(np.int64)))
    columns = zip(*out) if out else [[] for _ in _OPEN_ARROW]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _OPEN_ARROW)], schema=_OPEN_ARROW)


# 4. DivideSkip -------------------------------------------------------------------------


#: Entries up to which lists are merged by a heap; longer ones are sorted together, which gives
#: the same ids and counts.
HEAP_ENTRIES = 2000


def _merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in at least ``least`` of the sorted lists, and in how many: heap merge that, when the
    smallest id is too rare, skips all lists to the next one that could do."""
    if sum(map(len, lists)) > HEAP_ENTRIES:
        ids, count = np.unique(np.concatenate(lists), return_counts=True)
        return ids[count >= least], count[count >= least]
    runs = [x.tolist() for x in lists]
    heap = [(x[0], i, 0) for i, x in enumerate(runs) if x]
    heapq.heapify(heap)
    ids, count = [], []
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        to = top + 1
        if len(popped) >= least:
            ids.append(top)
            count.append(len(popped))
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            to = max(to, heap[0][0])
        for _, i, at in popped:
            at = bisect_left(runs[i], to, at)
            if at < len(runs[i]):
                heapq.heappush(heap, (runs[i][at], i, at))
    return np.array(ids, np.int64), np.array(count, np.int64)


def spanning_links(
    sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links (positions in ``sets``) that connect whatever the full set of links connects.

    ``sizes`` are the full set sizes; ``sets`` may leave out elements no other set has. With
    ``side`` (0 or 1 for each set) only pairs of different sides are searched.
    """
    order = np.argsort(sizes, kind="stable")
    n = np.asarray(sizes, np.int64)[order]
    lengths = np.array([len(sets[i]) for i in order], np.int64)
    ptr = np.concatenate([[0], np.cumsum(lengths)])
    elements = np.concatenate([sets[i] for i in order])
    _, term = np.unique(elements, return_inverse=True)
    posting = np.argsort(term, kind="stable")
    members = np.repeat(np.arange(len(n)), lengths)[posting]  # ids in each list rise
    list_ptr = np.concatenate([[0], np.cumsum(np.bincount(term))])
    sides = None if side is None else np.asarray(side)[order]
    root = np.arange(len(n))
    links: list[tuple[int, int]] = []
    for q in range(1, len(n)):
        t = int(required(int(n[q]), percent))
        lo = int(np.searchsorted(n, -(-percent * int(n[q]) // 100)))
        if lo >= q or lengths[q] < t:
            continue
        terms = term[ptr[q] : ptr[q + 1]]
        terms = terms[np.argsort(list_ptr[terms + 1] - list_ptr[terms], kind="stable")]
        # as many long lists as leave one that a partner must be in: each partner is in t lists
        n_long = t - 1
        short = [members[list_ptr[w] : list_ptr[w + 1]] for w in terms[: len(terms) - n_long]]
        short = [x[np.searchsorted(x, lo) : np.searchsorted(x, q)] for x in short]
        found, count = _merge([x[root[x] != root[q]] for x in short], t - n_long)
        if sides is not None:
            found, count = found[sides[found] != sides[q]], count[sides[found] != sides[q]]
        need = -(-percent * (n[q] + n[found]) // (100 + percent))
        left = n_long
        for w in terms[len(terms) - n_long :]:
            if not len(found):
                break
            able = count + left >= need
            if not able.all():
                found, count, need = found[able], count[able], need[able]
            x = members[list_ptr[w] : list_ptr[w + 1]]
            at = np.minimum(np.searchsorted(x, found), len(x) - 1)
            count = count + (x[at] == found)
            left -= 1
        for r in found[count >= need].tolist():
            if root[r] != root[q]:
                links.append((int(order[r]), int(order[q])))
                root[root == root[r]] = root[q]
    return links


_LINKS = "a long, b long"
_LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search_unit(table: pa.Table) -> pa.Table:
    """Spanning links of the clusters, or of the pair of blocks, that one task holds."""
    table = table.sort_by("cluster")
    cluster = table.column("cluster").to_numpy()
    ids, n = table.column("set_id").to_numpy(), table.column("n").to_numpy()
    block = table.column("block").to_numpy()
    content = table.column("content").combine_chunks()
    if isinstance(content, pa.ChunkedArray):
        content = content.chunk(0)
    cut = content.offsets.to_numpy()
    values = content.values.to_numpy().view(np.uint64)
    pair = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    starts = np.flatnonzero(np.diff(cluster, prepend=~cluster[:1]))
    a, b = [], []
    for lo, hi in zip(starts, np.append(starts[1:], len(cluster))):
        side = None if pair[0] == pair[1] else block[lo:hi] == pair[0]
        sets = [values[cut[i] : cut[i + 1]] for i in range(lo, hi)]
        for x, y in spanning_links(sets, n[lo:hi], side):
            a.append(ids[lo + x])
            b.append(ids[lo + y])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS_ARROW)


def _units(open_sets: DataFrame, clusters: DataFrame, tasks: int) -> DataFrame:
    """A row of each set for every unit of work it takes part in: the bucket of its cluster or,
    of a cluster cut into blocks, the pairs of its block with all blocks."""
    weight = F.size("content")
    members = open_sets.join(clusters, open_sets.set_id == clusters.node).select(
        F.col("component").alias("cluster"), "set_id", "n", "content"
    )
    blocks = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum(weight) / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_SETS))
        .cast("int")
        .alias("blocks")
    )
    placed = members.join(blocks, "cluster").withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (
        placed.select("*", other.alias("_other"))
        .withColumn("i", F.least("block", "_other"))
        .withColumn("j", F.greatest("block", "_other"))
        .withColumn(
            "unit",
            F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(
                F.pmod(F.xxhash64("cluster"), F.lit(tasks))
            ),
        )
        .select("unit", "i", "j", "cluster", "block", "set_id", "n", "content")
    )


# The whole -----------------------------------------------------------------------------


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = cut_lineage(docs.mapInArrow(_describe, _SETS))
    described_docs = described.filter("shingle is null")
    size = described_docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles")).first()
    least = max(LONG_LIST_LEAST, size.docs // LONG_LIST_SHARE)
    # at most LONG_LIST_SHARE times the mean set size: each stands for so many shingles read
    frequent = (
        described.filter("shingle is not null")
        .groupBy("shingle")
        .agg(F.sum("seen").alias("seen"))
        .filter(F.col("seen") >= least)
        .toArrow()
    )
    hashes = frequent.column("shingle").to_numpy().view(np.uint64)
    order = np.lexsort((hashes, frequent.column("seen").to_numpy()))
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.arange(len(hashes))
    by_hash = np.argsort(hashes)
    long_lists = spark.sparkContext.broadcast((hashes[by_hash], rank[by_hash]))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.shingles or 0) // RANGE + 1)

    sent = docs.mapInArrow(partial(_send, parts=parts, long_lists=long_lists), _SENT)

    def by_range(rows: DataFrame, of, schema: str) -> DataFrame:
        # a task for each range: hashing dense numbers would give some tasks several and others none
        dealt = rows.repartitionById(parts, F.col("part").cast("int"))
        return dealt.mapInArrow(partial(_each_range, of=partial(of, parts=parts)), schema)

    shared = by_range(sent, _share, _SENT)
    open_sets = cut_lineage(by_range(shared, _open_sets, _OPEN))

    met = open_sets.select(F.explode("prefix").alias("key"), "set_id")
    stars = met.groupBy("key").agg(F.min("set_id").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    edges = met.join(stars, "key").select(F.col("set_id").alias("a"), "b")
    clusters = connected_components(edges)
    links = (
        _units(open_sets, clusters, parts)
        .groupBy("unit", "i", "j")
        .applyInArrow(lambda t: _search_unit(t), _LINKS)
    )
    found = connected_components(links)

    by_set = (
        described_docs.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("_first"))
    ).join(found.select(F.col("node").alias("set_id"), F.col("component").alias("_found")), "set_id", "left")
    by_set = by_set.withColumn("_root", F.coalesce("_found", "set_id"))
    # only sets with links have a component of several sets
    heads = by_set.filter("_found is not null").groupBy("_root").agg(F.min("_first").alias("_least"))
    named = by_set.join(heads, "_root", "left").select(
        "set_id", F.coalesce("_least", "_first").alias("component_id")
    )
    return described_docs.join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
