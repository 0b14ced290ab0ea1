"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors go to shards of bounded size: those of one length (number of components) and of norms within a factor of two,
by a hash of id and vector. Each shard builds its own graph: every
vector is in the bottom layer, and a sixteenth of each layer in the next. A graph is stored as flat
arrays: for each layer its members and a table of neighbours. A search walks greedily down the
layers and then keeps the ``EF`` nearest of the bottom layer; the shards' results are merged per
query. All queries of a block walk together, a step at a time, and so do the vectors of a batch that
are inserted, so the work is done on whole arrays.

Nearness is the largest inner product. Vectors are given one more component, which makes all of a shard
equally long: then the nearest is the one with the largest product, also for vectors of unequal norm. As norms of a
shard differ by less than a factor of two, that component never drowns the others, whatever the norms of the whole table. Scores
are products of the original vectors in double precision, taken after scaling by powers of two: one too large for a
double is infinite, and never undefined.

Equal vectors of a shard are one node with many ids, so copies, however many, do not crowd a graph.

Defined results: vectors that are null, all zero, or hold a null or non-finite component take no part, nor do rows
without ``vec_id``. A product needs two vectors of one length, so each query meets the vectors of its own length. Ties go to the
smaller ``vec_id``. With fewer candidates than ``k`` all are returned. Of rows that repeat an id the
one with the larger product counts, and an id never finds itself. Further columns are ignored.
Empty in, empty out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.bytesets import mix
from pairloom.operators.sizing import settle
from pairloom.workspace import cut_lineage

#: Vectors of a shard, queries of a block.
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096

#: Neighbours of a node (twice as many at the bottom) and breadth of searches.
M = 16
EF_BUILD = 64
EF = 128

_U = np.uint64


class Graph(NamedTuple):
    """Layers from the bottom up; ``members[l]`` are node numbers, and row i of ``links[l]`` has
    the neighbours of ``members[l][i]`` as positions in ``members[l]``, -1 where there is none."""

    members: list[np.ndarray]
    links: list[np.ndarray]


def _products(vectors: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of each query with its own row of vectors; -inf where the number is -1."""
    out = np.einsum("qd,qmd->qm", queries, vectors[rows], optimize=False)
    out[rows < 0] = -np.inf
    return out


def _walk(
    vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of one layer for all queries at once: the ``ef`` nearest nodes found for
    each, nearest first, and their products. ``entry`` has the nodes each search starts from."""
    count = len(queries)
    beam = np.full((count, ef), -1, np.int64)
    near = np.full((count, ef), -np.inf, np.float32)
    open_ = np.zeros((count, ef), bool)
    width = min(entry.shape[1], ef)
    beam[:, :width] = entry[:, :width]
    near[:, :width] = _products(vectors, queries, beam[:, :width])
    open_[:, :width] = beam[:, :width] >= 0
    seen = np.zeros((count, len(links)), bool)
    rows = np.arange(count)
    seen[rows[:, None], np.maximum(beam[:, :width], 0)] |= beam[:, :width] >= 0
    while len(rows):
        best = np.where(open_[rows], near[rows], -np.inf).argmax(axis=1)
        rows_open = open_[rows, best]
        rows, best = rows[rows_open], best[rows_open]
        if not len(rows):
            break
        open_[rows, best] = False
        found = links[beam[rows, best]]
        fresh = (found >= 0) & ~seen[rows[:, None], np.maximum(found, 0)]
        found = np.where(fresh, found, -1)
        r, c = np.nonzero(fresh)
        seen[rows[r], found[r, c]] = True
        score = np.full(found.shape, -np.inf, np.float32)
        score[r, c] = np.einsum("nd,nd->n", vectors[found[r, c]], queries[rows[r]])
        ids = np.concatenate([beam[rows], found], axis=1)
        scores = np.concatenate([near[rows], score], axis=1)
        opened = np.concatenate([open_[rows], fresh], axis=1)
        keep = np.argpartition(-scores, ef - 1, axis=1)[:, :ef]
        line = np.arange(len(rows))[:, None]
        beam[rows], near[rows], open_[rows] = ids[line, keep], scores[line, keep], opened[line, keep]
    order = np.argsort(-near, axis=1, kind="stable")
    line = np.arange(count)[:, None]
    return beam[line, order], near[line, order]


def _diverse(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those that are nearer to the node than to any
    chosen before, at most ``m``; room that is left goes to the nearest of the others."""
    count, width = found.shape
    chosen = np.zeros((count, width), bool)
    between = np.einsum("nad,nbd->nab", vectors[found], vectors[found])
    taken = np.zeros(count, np.int64)
    for j in range(width):
        closest = np.where(chosen, between[:, j], -np.inf).max(axis=1)
        good = (found[:, j] >= 0) & (closest < near[:, j]) & (taken < m)
        chosen[:, j] = good
        taken += good
    rank = np.where(chosen, 0, np.where(found >= 0, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :m]
    return found[np.arange(count)[:, None], order]


def _connect(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Set the neighbours of new nodes and add them to those neighbours; a full list is thinned."""
    width = links.shape[1]
    links[new, : chosen.shape[1]] = chosen
    source = np.repeat(new, chosen.shape[1])
    target = chosen.reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    sizes = np.diff(heads, append=len(target))
    room = np.full((len(heads), width + int(sizes.max() if len(sizes) else 0)), -1, np.int64)
    nodes = target[heads]
    room[:, :width] = links[nodes]
    slot = np.arange(len(target)) - np.repeat(heads, sizes)
    room[np.repeat(np.arange(len(heads)), sizes), width + slot] = source
    for lo in range(0, len(nodes), 512):
        part = slice(lo, lo + 512)
        near = _products(vectors, vectors[nodes[part]], room[part])
        order = np.argsort(-near, axis=1, kind="stable")[:, : 2 * width]
        line = np.arange(len(near))[:, None]
        best = room[part][line, order]
        full = (best >= 0).sum(axis=1) > width
        links[nodes[part]] = best[:, :width]
        if full.any():
            links[nodes[part][full]] = _diverse(vectors, best[full], near[line, order][full], width)


def build(vectors: np.ndarray, keys: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
    """The graph of a shard. ``keys`` decide, by hash, how high each node reaches and in which
    order nodes are inserted; the batches inserted together double in size."""
    hashed = mix(keys.astype(np.int64).view(np.uint64) + _U(0xA0761D6478BD642F))
    uniform = ((hashed >> _U(11)).astype(np.float64) + 1) * 2.0**-53
    height = np.floor(-np.log(uniform) / np.log(m)).astype(np.int64)
    members, links = [], []
    order = np.argsort(hashed ^ _U(0x5555555555555555))
    for level in range(int(height.max(initial=0)) + 1):
        own = order[height[order] >= level]
        members.append(own)
        links.append(_layer(vectors[own], 2 * m if level == 0 else m, m, ef))
    return Graph(members, links)


def _layer(vectors: np.ndarray, width: int, m: int, ef: int) -> np.ndarray:
    n = len(vectors)
    links = np.full((n, width), -1, np.int64)
    done = min(n, 2 * m)
    # the first few see each other
    near = vectors[:done] @ vectors[:done].T
    np.fill_diagonal(near, -np.inf)
    found = np.argsort(-near, axis=1, kind="stable")[:, : max(done - 1, 0)]
    if done > 1:
        links[:done, : min(width, done - 1)] = found[:, :width]
    while done < n:
        new = np.arange(done, min(n, done + max(m, min(done // 2, 1024))))
        entry = np.tile(np.arange(0, done, max(1, done // 8))[:8], (len(new), 1))
        found, near = _walk(vectors, links[:done], vectors[new], entry, min(ef, done))
        for lo in range(0, len(new), 256):
            part = slice(lo, lo + 256)
            chosen = _diverse(vectors, found[part], near[part], m)
            if lo == 0:
                picks = np.full((len(new), chosen.shape[1]), -1, np.int64)
            picks[part] = chosen
        _connect(vectors, links, new, picks)
        done = int(new[-1]) + 1
    return links


def search(
    graph: Graph, vectors: np.ndarray, queries: np.ndarray, ef: int = EF
) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers of the ``ef`` nearest for each query, nearest first (-1: no more)."""
    entry = np.zeros((len(queries), 1), np.int64)
    for level in range(len(graph.members) - 1, 0, -1):
        own = graph.members[level]
        found, _ = _walk(vectors[own], graph.links[level], queries, entry, min(4, len(own)))
        below = graph.members[level - 1]
        place = np.full(len(vectors), -1, np.int64)
        place[below] = np.arange(len(below))
        entry = np.where(found >= 0, place[own[found]], -1)
    own = graph.members[0]
    found, near = _walk(vectors[own], graph.links[0], queries, entry, min(ef, len(own)))
    return np.where(found >= 0, own[found], -1), near


# Over DataFrames -----------------------------------------------------------------------


def clean_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector, d, band`` of the rows that take part, repeated ones once: ``d`` is the number of components, ``band``
    the norm's binary logarithm, rounded, so that vectors of norm 1 share one."""
    values = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    out = (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("vector"))
        .filter("vec_id is not null and vector is not null")
        .filter(~F.exists("vector", bad))
    )
    # scaled first: squares of very large or small components have no double
    most = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("_most")) * (x / F.col("_most")))
    return (
        out.withColumn("_most", most)
        .filter("_most > 0")
        .select(
            "vec_id",
            "vector",
            F.size("vector").alias("d"),
            F.round(F.log2("_most") + F.log2(squares) / 2).cast("int").alias("band"),
        )
        .distinct()
    )


_NODES = "shard long, node int, vec_ids array<long>, vector array<double>, links array<array<int>>"
_NODES_ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("node", pa.int32()),
        ("vec_ids", pa.list_(pa.int64())),
        ("vector", pa.list_(pa.float64())),
        ("links", pa.list_(pa.list_(pa.int32()))),
    ]
)


def _matrix(column: pa.ChunkedArray, count: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else flat.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(count, -1)


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector divided, without rounding, by a power of two that leaves its largest component between 1/2 and 1, and
    the exponents."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None]), power


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors with the component that makes all equally long, scaled to length one."""
    scaled, power = _scaled(vectors)
    # norms of a shard lie within a factor of two, and a component is at least the norm by the root of their number
    scaled = np.ldexp(scaled, (power - power.max())[:, None])
    squares = (scaled**2).sum(axis=1)
    rest = np.sqrt(np.maximum(0.0, squares.max() - squares))
    return (np.concatenate([scaled, rest[:, None]], axis=1) / np.sqrt(squares.max())).astype(np.float32)


def _build_shard(table: pa.Table) -> pa.Table:
    """The graph of one shard, a row for each distinct vector."""
    shard = table.column("shard")[0].as_py()
    table = table.sort_by("vec_id")
    vectors = _matrix(table.column("vector"), table.num_rows)
    ids = table.column("vec_id").to_numpy()
    raw = np.ascontiguousarray(vectors + 0.0)
    _, once, which = np.unique(
        raw.view(np.dtype((np.void, raw.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True
    )
    graph = build(_unit(vectors[once]), ids[once])
    by_node = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[by_node], np.arange(len(once) + 1))
    links: list[list] = [[] for _ in once]
    for own, table_ in zip(graph.members, graph.links):  # bottom first
        for i, node in enumerate(own.tolist()):
            row = table_[i]
            links[node].append(own[row[row >= 0]].astype(np.int32))
    return pa.table(
        [
            pa.array([shard] * len(once), pa.int64()),
            pa.array(np.arange(len(once)), pa.int32()),
            pa.array([ids[by_node[a:b]] for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
            pa.array(list(vectors[once]), pa.list_(pa.float64())),
            pa.array(links, pa.list_(pa.list_(pa.int32()))),
        ],
        schema=_NODES_ARROW,
    )


def _load(table: pa.Table) -> tuple[Graph, np.ndarray, list[list[int]]]:
    """Flat neighbour arrays of a stored shard."""
    table = table.sort_by("node")
    vectors = _matrix(table.column("vector"), table.num_rows)
    links = table.column("links").to_pylist()
    members, arrays = [], []
    for level in range(max(len(x) for x in links)):
        own = np.array([i for i, x in enumerate(links) if len(x) > level])
        place = np.full(len(links), -1, np.int64)
        place[own] = np.arange(len(own))
        flat = np.full((len(own), max(1, max(len(links[i][level]) for i in own))), -1, np.int64)
        for row, i in enumerate(own):
            flat[row, : len(links[i][level])] = place[links[i][level]]
        members.append(own)
        arrays.append(flat)
    return Graph(members, arrays), vectors, table.column("vec_ids").to_pylist()


_FOUND = "query_id long, vec_id long, score double"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_shard(queries: pa.Table, nodes: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of one shard for each query of a block."""
    if not queries.num_rows or not nodes.num_rows:
        return _FOUND_ARROW.empty_table()
    graph, vectors, ids = _load(nodes)
    wanted = _matrix(queries.column("vector"), queries.num_rows)
    unit = _unit(vectors)
    vectors, power = _scaled(vectors)
    wanted, aim_power = _scaled(wanted)
    # a query has no added component: only its direction counts
    aims = np.concatenate(
        [wanted / np.linalg.norm(wanted, axis=1, keepdims=True), np.zeros((len(wanted), 1))], axis=1
    ).astype(np.float32)
    out: list[tuple] = []
    names = queries.column("query_id").to_pylist()
    for lo in range(0, len(wanted), 512):
        found, _ = search(graph, unit, aims[lo : lo + 512], max(EF, k + 1))
        for i, row in enumerate(found, lo):
            row = row[row >= 0]
            # summed alike for each row, so that equal vectors have equal products
            with np.errstate(over="ignore", under="ignore"):
                score = np.ldexp((vectors[row] * wanted[i]).sum(axis=1), power[row] + aim_power[i])
            best: list[tuple[float, int]] = []
            order = np.argsort(-score, kind="stable")
            for j in order.tolist():
                if len(best) >= k and score[j] < best[-1][0]:
                    break
                mine = [x for x in dict.fromkeys(ids[row[j]]) if x != names[i]][:k]
                best += [(score[j], x) for x in mine]
            best.sort(key=lambda x: (-x[0], x[1]))
            out += [(names[i], x, s) for s, x in best[:k]]
    columns = zip(*out) if out else [[], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def nearest(
    df: DataFrame,
    queries: DataFrame | None = None,
    k: int = 20,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of each query.

    ``queries`` has the columns of ``df``; by default they are its rows whose id is divisible by
    ``every``. Each block of queries meets each shard once; a task holds one graph and one block.
    """
    points = clean_vectors(df, vec_id, vector)
    # a row for each length and each of at most 2,100 bands
    counts = settle(points.groupBy("d", "band").agg(F.count(F.lit(1)).alias("n")))
    parts = F.ceil(F.col("n") / shard_rows).cast("long")
    before = Window.partitionBy(F.lit(0)).orderBy("d", "band").rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.df.select(
        "d", "band", parts.alias("parts"), F.coalesce(F.sum(parts).over(before), F.lit(0)).alias("first")
    )
    shards = counts.df.agg(F.sum(parts).alias("shards")).first().shards or 1
    bands = F.broadcast(bands) if counts.small else cut_lineage(bands)
    asked = points.filter(F.col("vec_id") % every == 0) if queries is None else clean_vectors(queries, vec_id, vector)
    blocks = -(-asked.count() // BLOCK_QUERIES) or 1

    part = F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts"))
    sharded = points.join(bands, ["d", "band"]).select((F.col("first") + part).alias("shard"), "vec_id", "vector")
    graphs = cut_lineage(
        sharded.repartitionById(int(shards), F.col("shard").cast("int"))
        .groupBy("shard")
        .applyInArrow(_build_shard, _NODES)
    )
    each_shard = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    block = F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.lit(blocks))
    left = asked.join(bands.drop("band"), "d").select(
        F.col("vec_id").alias("query_id"), "vector", block.alias("block"), each_shard.alias("shard")
    )
    right = graphs.select("*", each_block.alias("block"))
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(lambda a, b: _search_shard(a, b, k), _FOUND)
    )
    # an id may stand on several vectors, here and among the queries
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        distinct.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
