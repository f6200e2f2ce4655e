"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child draws
-ln(u) / weight, with u from a hash of the row's key and the child's name, and the least draw
wins; a child is so chosen in proportion to its weight. A child whose weight grows can only
win rows, one that shrinks can only lose them, and draws below other children do not change,
so rows move only into, out of or within subtrees whose weights change. A shard added as a
subtree of its own takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

Tree = list[tuple[str, str, int, float]]


def tree(shards: int, base: int = 8, per_rack: int = 2, racks: int = 2) -> Tree:
    """(region, rack, shard, weight) leaves: the first ``base`` shards in full regions, each later one a region of its own."""
    out: Tree = []
    for s in range(shards):
        if s < base:
            out.append((f"r{s // (per_rack * racks)}", f"r{s // (per_rack * racks)}/k{s // per_rack}", s, 1.0))
        else:
            out.append((f"r+{s}", f"r+{s}/k", s, 1.0))
    return out


def choose(leaves: Tree, key: Column) -> Column:
    """The shard of a key, as one native expression; the cost of a row is the children on its way."""
    if len({leaf[2] for leaf in leaves}) != len(leaves) or not leaves or min(leaf[3] for leaf in leaves) <= 0:
        raise ValueError("shards must be distinct, at least one, with positive weights")
    children: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in leaves:
        for parent, child in (("", region), (region, rack), (rack, str(shard))):
            own = children.setdefault(parent, {})
            own[child] = own.get(child, 0.0) + weight
    level = F.lit("")
    table = F.create_map(*[
        x for parent, own in children.items()
        for x in (F.lit(parent), F.array(*[F.struct(F.lit(c).alias("name"), F.lit(w).alias("w")) for c, w in own.items()]))
    ])
    for _ in range(3):
        u = lambda c: (F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11).cast("double") + 0.5) / float(1 << 53)
        draws = F.transform(F.element_at(table, level), lambda c: F.struct((-F.log(u(c)) / c["w"]).alias("draw"), c["name"].alias("name")))
        level = F.array_min(draws)["name"]
    return level.cast("int")


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, buckets: int = 4096) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row, law `key`.

    size is the text's UTF-8 bytes (null: none) plus 1. shard depends on key and shard count
    alone; grown_shard is the shard with one more, which takes rows only into itself. Slots
    run from 0 in each shard without gaps. Null keys are one key; equal keys share a shard and
    get different slots; an empty table gives an empty result; other columns are ignored.
    Slots come from sums over buckets of a hash (at most ``shards`` x ``buckets`` rows are
    broadcast), so neither a shard nor a repeated row is one task; they follow the order in
    which the rows were read.
    """
    # the texts are read once; written row numbers spread rows that repeat a key and text
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.save(
        docs.select(
            F.col(key).alias("key"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.monotonically_increasing_id().alias("u"),
        ),
        "rows",
    )
    rows = rows.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(key, text_crc32, u), {buckets}) as int)")).withColumn("shard", choose(tree(shards), F.col("key")))
    sums = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sums.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = W.partitionBy("shard", "bucket").orderBy("u")
    return rows.join(F.broadcast(before), ["shard", "bucket"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("before") + F.row_number().over(own) - 1).alias("slot"),
        choose(tree(shards + 1), F.col("key")).alias("grown_shard"),
    )
