"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

At each level a row draws ``-ln(u) / weight`` for every child of the node it has reached, ``u`` being a hash of child and
key, and goes to the child with the smallest draw. The share of a child is its weight; a draw depends on one child
and one key only. When a weight changes, rows move into or out of the subtrees on its path and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from sigframe.llm.common import unit, whole

#: Parts of a shard within which rows are numbered; slots start where the parts before it end.
SLOT_PARTS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2, settled: int | None = None) -> list[Leaf]:
    """Shards of equal weight, filled rack by rack and region by region.

    Shards from ``settled`` on are added later: each opens a region of its own, so that no older subtree changes its weight
    and a new shard takes rows only into itself.
    """
    old = shards if settled is None else min(settled, shards)
    size = racks * per_rack
    leaves = [Leaf(f"r{s // size}", f"r{s // size}.k{s % size // per_rack}", s) for s in range(old)]
    return leaves + [Leaf(f"new{s}", f"new{s}.k0", s) for s in range(old, shards)]


def place(leaves: list[Leaf], *key: Column) -> Column:
    """The shard that ``key`` descends to; leaves without weight get nothing.

    A key of NULLs is one key like any other. Ties of draws go to the child named first in order.
    """
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("a tree needs a leaf with a weight above 0")
    if len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("a shard may stand in the tree once")

    def level(kind: str, items: list[Leaf], below) -> Column:
        groups: dict[str, list[Leaf]] = {}
        for x in sorted(items, key=lambda x: (x.region, x.rack, x.shard)):
            groups.setdefault(str(getattr(x, kind)), []).append(x)
        if len(groups) == 1:
            return below(items)
        drawn = [F.struct((-F.log(unit(F.lit(f"{kind}:{name}"), *key)) / F.lit(float(sum(x.weight for x in own)))).alias("draw"),
                          F.lit(i).alias("child")) for i, (name, own) in enumerate(groups.items())]
        child = F.least(*drawn)["child"]
        out = F.when(child == 0, below(next(iter(groups.values()))))
        for i, own in enumerate(list(groups.values())[1:], 1):
            out = out.when(child == i, below(own))
        return out

    return level("region", leaves, lambda a: level("rack", a, lambda b: level("shard", b, lambda c: F.lit(c[0].shard))))


def shard_rows(docs: DataFrame, shards: int = 8, leaves: list[Leaf] | None = None, grown: list[Leaf] | None = None,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard, its place there and its shard in the grown tree.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law (``key``: id and tree decide), shard, slot
    (0, 1, ... within a shard, without gaps) and grown_shard. Rows with a NULL id share one shard, NULL text counts as
    empty, repeated rows go to the same shard and take a slot each, an empty table gives an empty result.

    Slots need no sort of a whole shard: parts of a shard, dealt by hash of the id and size, are counted first and then
    numbered one by one, each from where the parts before it end.
    """
    leaves = leaves or tree(shards)
    grown = grown or tree(shards + 1, settled=shards)
    key = F.col("doc_id")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    part = F.pmod(F.xxhash64(key, F.octet_length("text")), F.lit(SLOT_PARTS)).cast("int")
    rows = rows.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"),
                       part.alias("part"), place(leaves, key).alias("shard"), place(grown, key).alias("grown_shard"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    # at most shards * SLOT_PARTS rows of three numbers, whatever the size of the corpus
    out = numbered.join(F.broadcast(starts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                      (F.col("start") + F.col("at")).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))
