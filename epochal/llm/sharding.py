"""Sharding by a hierarchical weighted hash tree (native expressions only).

A tree is a list of regions, each a list of racks, each a list of ``(shard, weight)``.
A row descends it level by level.  At every level each child draws
``-ln(u) / weight`` with u a hash of the row's key and the child's name; the least
draw wins, so a child is chosen in proportion to its weight.  A child whose weight
grows can only win rows, one whose weight shrinks can only lose them: rows move
only into or out of subtrees whose weights change.

Keys may be null or repeat (equal keys share a shard); an empty table gives an
empty result; columns of the input named like outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tree = list[list[list[tuple[int, float]]]]


def layout(shards: int, base: int = 24, per_rack: int = 4, per_region: int = 3) -> Tree:
    """Tree of ``shards`` equal leaves: ``base`` of them in racks and regions, and each
    later one in a region of its own, so that adding one takes rows only into itself."""
    ids = list(range(min(base, shards)))
    racks = [[(s, 1.0) for s in ids[i : i + per_rack]] for i in range(0, len(ids), per_rack)]
    regions = [racks[i : i + per_region] for i in range(0, len(racks), per_region)]
    return regions + [[[(s, 1.0)]] for s in range(base, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11) + F.lit(1)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[int, str, float]]) -> Column:
    """The id of the child with the least draw; the smaller id on a tie."""
    children = [c for c in children if c[2] > 0]
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_draw(key, n, w).alias("d"), F.lit(i).alias("i")) for i, n, w in children]))["i"]


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard (int) of ``key``.  Names are paths, so a change in one subtree leaves others' draws alone."""

    def weight(node) -> float:
        return node[1] if isinstance(node, tuple) else sum(map(weight, node))

    def descend(node: list, path: str) -> Column:
        if isinstance(node[0], tuple):
            return _pick(key, [(s, f"{path}/{s}", w) for s, w in node])
        if len(node) == 1:
            return descend(node[0], f"{path}/0")
        won = _pick(key, [(i, f"{path}/{i}", weight(c)) for i, c in enumerate(node)])
        out = None
        for i, child in enumerate(node):
            below = descend(child, f"{path}/{i}")
            out = F.when(won == i, below) if out is None else out.when(won == i, below)
        return out

    return descend(tree, "").cast("int")


def assign(docs: DataFrame, shards: int, key: str = "doc_id", base: int = 24) -> DataFrame:
    """``docs`` with ``shard`` for ``shards`` and ``grown_shard`` for one more.  No shuffle."""
    k = F.col(key)
    return docs.withColumns({"shard": shard_of(k, layout(shards, base)), "grown_shard": shard_of(k, layout(shards + 1, base))})


def slots(rows: DataFrame, order: list[str], parts: int = 1024) -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... without gaps within each ``shard``.

    A shard is cut into ``parts`` hash ranges; their counts (at most shards x parts
    rows, hence broadcast) give each range its first slot, and ranks are taken within
    a range, so no task holds a whole shard.  Rows that tie in ``order`` are alike.
    """
    cut = F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(parts)).cast("int")
    rows = rows.withColumn("_part", cut)
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)) - 1
    out = rows.withColumn("_rank", rank).join(F.broadcast(first), ["shard", "_part"])
    return out.withColumn("slot", (F.col("_first") + F.col("_rank")).cast("long")).drop("_part", "_rank", "_first")


def op9_sharding(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Digest of the contract: law ``key``; size, crc and slots of every document.

    Null text counts as empty.  A null doc_id is a key like any other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(rows.withColumn("law", F.lit("key")), shards)
    return slots(rows, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def shard_stage(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Pipeline stage: every row with its shard (a column of that name is replaced, all others stay); a projection, no shuffle."""
    return docs.withColumn("shard", shard_of(F.col("doc_id"), layout(shards)))
