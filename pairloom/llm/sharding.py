"""Resharding by minimum-cost flow.

Old shards hold so many bytes, new shards shall hold given amounts. Bytes that stay cost nothing,
bytes that move cost their distance; the flow of least cost says how many bytes go from which old
shard to which new one. Rows move in blocks: an old shard is cut by a hash into ``BLOCKS`` parts,
whose sizes are all the driver sees. Blocks are dealt to the flows out of their shard, so a new shard
is off its amount by less than a block for each flow into it.

Shards are folders ``shard=N``. Rewriting touches those that lose or gain blocks: their files are read once and every task
writes its rows to the few new shards that the flow names, so texts are not shuffled. A layout, published by one
rename when all is written, says in which folder each shard lies now; whoever reads by it sees the old shards or the new
ones, never both.

Defined results: a null text has no bytes and its checksum is that of the empty text; every row is
placed, repeated ones too; rows without ``doc_id`` or source are hashed as such. Slots follow block,
id, checksum and size, so equal rows are interchangeable. The query's shards hold rows as one struct, so other columns travel
with them whatever their names; they decide nothing. Empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pairloom.operators.ordinal import rank_in_slots
from pairloom.workspace import new_dir

#: Parts an old shard is cut into.
BLOCKS = 4096

#: Shards that the query deals documents into.
SHARDS = 16


def min_cost_flow(
    supply: Sequence[int], demand: Sequence[int], cost: Callable[[int, int], int]
) -> dict[tuple[int, int], int]:
    """Amounts by (source, target) that serve all demand at least cost; totals must agree.

    Successive shortest paths with the residual graph as dictionaries: meant for shards, not rows.
    """
    if sum(supply) != sum(demand):
        raise ValueError("capacities must add up to the bytes there are")
    n, m = len(supply), len(demand)
    left, need = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        # nodes 0..n-1 sources, n..n+m-1 targets
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        back: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    c = cost(i, j)
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + c < dist[n + j]):
                        dist[n + j], back[n + j], changed = dist[i] + c, i, True
                    if flow.get((i, j)) and dist[n + j] is not None:
                        if dist[i] is None or dist[n + j] - c < dist[i]:
                            dist[i], back[i], changed = dist[n + j] - c, n + j, True
        node = min((n + j for j in range(m) if need[j]), key=lambda v: (dist[v], v))
        path = [node]
        while path[-1] in back:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], need[node - n])
        for a, b in zip(path, path[1:]):
            if a >= n:
                amount = min(amount, flow[b, a - n])
        for a, b in zip(path, path[1:]):
            key, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[key] = flow.get(key, 0) + sign * amount
        left[path[0]] -= amount
        need[node - n] -= amount
    return {k: v for k, v in flow.items() if v}


class Move(NamedTuple):
    old: int
    block: int
    shard: int
    bytes: int


def plan_moves(
    blocks: Sequence[tuple[int, int, int]],
    capacities: Sequence[int] | int,
    cost: Callable[[int, int], int] = lambda i, j: int(i != j),
) -> list[Move]:
    """Where each block (old shard, block, bytes) goes. ``capacities`` are shares of the new
    shards (any scale), or their number for equal ones."""
    shares = [1] * capacities if isinstance(capacities, int) else list(capacities)
    olds = sorted({o for o, _, _ in blocks})
    size = {o: sum(b for x, _, b in blocks if x == o) for o in olds}
    total = sum(size.values())
    bounds = [total * sum(shares[:k]) // sum(shares) for k in range(len(shares) + 1)]
    demand = [b - a for a, b in zip(bounds, bounds[1:])]
    flow = min_cost_flow([size[o] for o in olds], demand, lambda i, j: cost(olds[i], j))
    out = []
    for i, old in enumerate(olds):
        rest = {j: v for (a, j), v in flow.items() if a == i}
        own = sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[2], b[1]))
        for _, block, weight in own:
            # the target with most room left, the block's own shard if it ties
            j = max(rest or {0: 0}, key=lambda j: (rest.get(j, 0), j == old, -j))
            rest[j] = rest.get(j, 0) - weight
            out.append(Move(old, block, j, weight))
    return out


def block_of(blocks: int = BLOCKS, row: str = "") -> Column:
    """The block of a row; ``row`` names the struct it is in, with its dot."""
    crc = F.crc32(F.col(f"{row}text").cast("string").cast("binary"))
    return F.pmod(F.xxhash64(F.col(f"{row}doc_id"), crc), F.lit(blocks)).cast("int")


def _sized(docs: DataFrame, old: Column, blocks: int, row: str = "", *others: Column) -> DataFrame:
    raw = F.coalesce(F.col(f"{row}text").cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"{row}doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        old.cast("int").alias("_old"),
        block_of(blocks, row).alias("_block"),
        *others,
    )


def _slotted(placed: DataFrame, blocks: int) -> DataFrame:
    """Rows of :func:`_sized` that know their ``shard``, with gapless slots in it."""
    order = F.col("_old").cast("long") * blocks + F.col("_block")
    ranked = rank_in_slots(placed, ["shard"], order, ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.col("_old").alias("old_shard"), "shard", "slot")


def _moves(sized: DataFrame, capacities, blocks: int) -> DataFrame:
    """The plan as a table of at most ``blocks`` rows for each old shard."""
    weights = sized.groupBy("_old", "_block").agg(F.sum("size").alias("bytes")).collect()
    moves = plan_moves([tuple(r) for r in weights], capacities)
    schema = "_old int, _block int, shard int, bytes long"
    return sized.sparkSession.createDataFrame(moves, schema)


def reshard(
    docs: DataFrame, old: Column, capacities: Sequence[int] | int = SHARDS, blocks: int = BLOCKS
) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` of every row: one narrow shuffle,
    texts stay where they are."""
    sized = _sized(docs, old, blocks)
    moves = _moves(sized, capacities, blocks).drop("bytes")
    return _slotted(sized.join(F.broadcast(moves), ["_old", "_block"]), blocks)


def rewrite_shards(
    spark: SparkSession, path: str, out: str, capacities: Sequence[int] | int, blocks: int = BLOCKS, row: str = ""
) -> list[int]:
    """Move rows between the Parquet folders ``path/shard=N``: the shards that lose or gain blocks are written anew under
    ``out/shard=N``, then the layout is published there. Returns the shards that stay as they are, whose files are neither
    written nor moved. ``row`` names the struct that ``doc_id`` and ``text`` are in, with its dot."""
    docs = spark.read.parquet(path)
    kept = [F.col(_quoted(c)) for c in docs.columns if c != "shard"]
    keyed = docs.select(F.struct(*kept).alias("own"), F.col("shard").alias("_old"), block_of(blocks, row).alias("_block"))
    size = F.coalesce(F.octet_length(F.col(f"{row}text").cast("string")), F.lit(0)) + 1
    sizes = docs.select(F.col("shard").alias("_old"), block_of(blocks, row).alias("_block"), size.alias("size"))
    moves = _moves(sizes, capacities, blocks)
    changed = {x for r in moves.filter("_old <> shard").collect() for x in (r._old, r.shard)}
    olds = {r._old for r in moves.select("_old").distinct().collect()}
    if changed:
        todo = F.broadcast(moves.filter(F.col("_old").isin(*changed)).drop("bytes"))
        rows = keyed.filter(F.col("_old").isin(*changed)).join(todo, ["_old", "_block"])
        rows.select("own.*", "shard").write.partitionBy("shard").parquet(out)
    same = sorted(olds - changed)
    news = [r.shard for r in moves.select("shard").distinct().collect() if r.shard in changed]
    publish_layout(spark, out, {s: path for s in same} | {s: out for s in news})
    return same


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: File of a layout below the folder it is published in.
_LAYOUT = "_layout"


def publish_layout(spark: SparkSession, out: str, roots: dict[int, str]) -> None:
    """Say in one row for each shard below which folder it lies: one file, put into place by one rename."""
    rows = [(shard, roots[shard]) for shard in sorted(roots)]
    spark.createDataFrame(rows, "shard int, root string").coalesce(1).write.parquet(f"{out}/{_LAYOUT}")


def read_shards(spark: SparkSession, out: str, schema: str | StructType) -> DataFrame:
    """The rows of all shards of a published layout, with their ``shard``; ``schema`` is that of the rows."""
    roots: dict[str, list[int]] = {}
    for r in spark.read.parquet(f"{out}/{_LAYOUT}").collect():
        roots.setdefault(r.root, []).append(r.shard)
    given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType([*given.fields, StructField("shard", IntegerType())])
    parts = [spark.read.schema(whole).parquet(root).filter(F.col("shard").isin(*own)) for root, own in sorted(roots.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], whole)


def source_shard(source: Column, shards: int = SHARDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents, sharded by source till now, dealt to ``shards`` shards of nearly equal size.

    The old shards are written, those that change are rewritten, and the result tells of the rows as they are read back from
    the shards of the published layout.
    """
    spark = docs.sparkSession
    old, new = new_dir(spark, "shards-old"), new_dir(spark, "shards-new")
    rows = docs.select(F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"))
    rows.withColumn("shard", source_shard(F.col("row.source"), shards)).write.partitionBy("shard").parquet(old)
    whole = StructType([*rows.schema.fields, StructField("shard", IntegerType())])
    if spark.read.schema(whole).parquet(old).isEmpty():
        publish_layout(spark, new, {})
    else:
        rewrite_shards(spark, old, new, shards, row="row.")
    stored = read_shards(spark, new, rows.schema)
    sized = _sized(stored, source_shard(F.col("row.source"), shards), BLOCKS, "row.", F.col("shard"))
    return _slotted(sized, BLOCKS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
