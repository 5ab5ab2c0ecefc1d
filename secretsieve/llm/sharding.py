"""Shards from a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard.  On each level
every child draws ``-ln(u) / weight`` from a hash of the row's key and the
child's name, and the least draw wins, so a child is chosen in proportion to its
weight (the number of shards below it).  When the weight of a child grows, its own
draw shrinks and all others stay: rows only move into subtrees whose weight grew.
A further shard is added as a region of its own, so it takes rows only into itself.

The draws are column arithmetic inside one projection; nothing is shuffled for them.
Slots number the rows of a shard without gaps: rows are counted per
shard and bucket of a hash, offsets are running sums over the few buckets, and rows
are numbered within their bucket, so no task holds a whole shard.

Defined results: a null key is a key like any other; a null text has no bytes;
equal rows share a shard and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unused


@dataclass(frozen=True)
class HashTree:
    """``regions`` x ``racks`` x ``shards`` leaves, then ``extra`` regions of one shard each."""

    regions: int = 2
    racks: int = 4
    shards: int = 5
    extra: int = 0

    def grown(self, n: int = 1) -> HashTree:
        return HashTree(self.regions, self.racks, self.shards, self.extra + n)

    @property
    def size(self) -> int:
        return self.regions * self.racks * self.shards + self.extra


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with the given rate; the key and the name decide."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.ln(unit) / F.lit(float(weight))


def winner(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """The number of the child with the least draw.  Children: (name, number, weight)."""
    if len(children) == 1:
        return F.lit(children[0][1])
    return F.array_min(F.array(*[F.struct(draw(key, n, w).alias("d"), F.lit(i).alias("i")) for n, i, w in children]))["i"]


def levels(tree: HashTree) -> tuple[list, list, list]:
    """The children of the root, of a region and of a rack."""
    regions = [(f"region{r}", r, float(tree.racks * tree.shards)) for r in range(tree.regions)]
    regions += [(f"extra{x}", tree.regions + x, 1.0) for x in range(tree.extra)]
    racks = [(f"rack{k}", k, float(tree.shards)) for k in range(tree.racks)]
    return regions, racks, [(f"shard{s}", s, 1.0) for s in range(tree.shards)]


def with_shard(df: DataFrame, tree: HashTree, key: Column, name: str = "shard") -> DataFrame:
    """Add the shard.  Below the root the path so far is part of the key, so the levels draw independently."""
    at_root, at_region, at_rack = levels(tree)
    region, rack = (unused(df, c) for c in ("_region", "_rack"))
    df = df.withColumn(region, winner(key, at_root))
    path = F.concat_ws("/", key.cast("string"), F.col(region).cast("string"))
    df = df.withColumn(rack, winner(path, at_region))
    leaf = winner(F.concat_ws("/", path, F.col(rack).cast("string")), at_rack)
    whole = tree.racks * tree.shards
    shard = F.when(
        F.col(region) < tree.regions, F.col(region) * whole + F.col(rack) * tree.shards + leaf
    ).otherwise(F.lit(tree.regions * (whole - 1)) + F.col(region))
    return df.withColumn(name, shard.cast("int")).drop(region, rack)


def with_slots(df: DataFrame, group: str, order: list[Column], buckets: int, name: str = "slot") -> DataFrame:
    """Number the rows of every group from 0, bucket by bucket."""
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = W.partitionBy(group, "_bucket").orderBy(*order)
    numbered = keyed.withColumn("_i", F.row_number().over(within) - 1)
    joined = numbered.join(offsets, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(name, (F.col("_offset") + F.col("_i")).cast("long")).drop("_bucket", "_i", "_g", "_b", "_offset")


def assign(
    df: DataFrame, tree: HashTree = HashTree(), *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256
) -> DataFrame:
    """doc_id, size (bytes of text plus 16), text_crc32, shard, slot and grown_shard (with one shard more)."""
    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(
        df[id_col].alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    rows = with_shard(rows, tree, F.col("doc_id"))
    rows = with_shard(rows, tree.grown(), F.col("doc_id"), "grown_shard")
    return with_slots(rows, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], buckets)
