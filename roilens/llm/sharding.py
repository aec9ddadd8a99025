"""Sharding by a hierarchical weighted hash tree (built-in functions only).

A topology is a list of (region, rack, shard, weight). A row descends it level
by level: among the children of a node it takes the one with the smallest
``-ln(u) / weight``, where ``u`` in (0, 1) is hashed from the row's key and the
child's name. A child's chance is its share of the weight, and its draw depends
on nothing but its own name and weight, so when weights change a row moves only
into a child that gained or out of one that lost: a change of one rack moves
rows within the subtrees whose weights changed. ``topology(shards)`` lays the
planned shards out as racks of four and regions of two racks; each shard beyond
the plan opens a region of its own, so it takes rows only into itself and no
other row moves (the law ``key``).

Inside a shard every row gets a gapless slot. Slots are numbered without
sorting a shard in one task: rows fall into ``16 ** digits`` sub-buckets by a
hash of their id, counts for each (shard, sub-bucket) give offsets, and only a
sub-bucket is ordered. Rows that share an id would all meet in one sub-bucket,
so the size and checksum of the text take part in that hash.

Defined results: a null id is placed as the empty key; a null text has size 8
and a null checksum; rows with equal ids share a shard and get different slots;
an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Leaf = tuple[str, str, int, float]
RACK_SHARDS, REGION_RACKS = 4, 2
BUCKET_DIGITS = 3
DRAW_BITS = 52


def topology(shards: int, planned: int = 24) -> list[Leaf]:
    """``planned`` shards in regions and racks; those beyond have a region each."""
    out: list[Leaf] = []
    for s in range(shards):
        if s < planned:
            rack = s // RACK_SHARDS
            out.append((f"g{rack // REGION_RACKS}", f"r{rack % REGION_RACKS}", s, 1.0))
        else:
            out.append((f"x{s}", "r0", s, 1.0))
    return out


def _cost(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u from the first 52 bits of md5(key : name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, DRAW_BITS // 4), 16, 10).cast("long")
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << DRAW_BITS))
    return -F.log(u) / F.lit(float(weight))


def _draw(key: Column, children: Sequence[tuple[str, float]]) -> Column:
    """The name of the child with the smallest cost (ties: the first name)."""
    if len(children) == 1:
        return F.lit(children[0][0])
    return F.array_min(F.array(*[F.struct(_cost(key, n, w).alias("cost"), F.lit(n).alias("name"))
                                 for n, w in sorted(children)]))["name"]


def _by_node(node: Column, values: dict[str, Column]) -> Column:
    """The value of the node that was reached; only its branch is evaluated."""
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(node == name, value).otherwise(out)
    return out


def _sums(leaves: Sequence[Leaf], depth: int) -> dict[str, dict[str, float]]:
    """parent path -> {child path: weight of its subtree} at one level of the tree."""
    out: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in leaves:
        path = [region, f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        level = out.setdefault(path[depth - 1] if depth else "", {})
        level[path[depth]] = level.get(path[depth], 0.0) + weight
    return out


def place(df: DataFrame, key: Column, leaves: Sequence[Leaf], name: str = "shard") -> DataFrame:
    """``df`` with the shard that ``key`` reaches; leaves of weight 0 take no rows."""
    live = [x for x in leaves if x[3] > 0]
    if len({x[2] for x in live}) != len(live) or not live:
        raise ValueError("shards must be distinct and at least one weight positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    cols = [f"_{name}_region", f"_{name}_rack", f"_{name}_leaf"]
    top = _sums(live, 0)[""]
    df = df.withColumn(cols[0], _draw(text, list(top.items())))
    for depth in (1, 2):
        below = {parent: _draw(text, list(kids.items())) for parent, kids in _sums(live, depth).items()}
        df = df.withColumn(cols[depth], _by_node(F.col(cols[depth - 1]), below))
    return df.withColumn(name, F.substring_index(cols[2], "/", -1).cast("int")).drop(*cols)


def shard(docs: DataFrame, shards: int = 24, grown: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", leaves: Sequence[Leaf] | None = None, digits: int = BUCKET_DIGITS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    ``leaves`` replaces the default topology; ``grown`` is the number of shards for
    ``grown_shard`` (one more by default)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    planned = topology(shards, shards) if leaves is None else list(leaves)
    wider = topology(grown or shards + 1, shards)
    if leaves is not None:
        wider = [*planned, ("x", "r0", 1 + max(x[2] for x in planned), 1.0)]
    rows = place(place(rows, F.col("id"), planned, "shard"), F.col("id"), wider, "grown_shard")
    whole = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "size", "text_crc32")])
    rows = rows.withColumn("bucket", F.substring(F.md5(whole), 1, digits))
    # at most shards * 16 ** digits rows
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bucket").orderBy("id", "size", "text_crc32")
    slots = rows.withColumn("at", F.row_number().over(own) - 1).join(starts, ["shard", "bucket"])
    return slots.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
