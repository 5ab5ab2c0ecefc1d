import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from secretsieve.llm import sharding
from secretsieve.llm.sharding import HashTree


def test_columns_and_slots(table, corpus):
    rows = sharding.assign(table(corpus), buckets=4).collect()
    assert len(rows) == len(corpus)
    facts = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert facts == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in corpus)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["shard"] for r in rows} <= set(range(40))


def test_key_decides(table):
    a = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(table([(i, "a") for i in range(50)])).collect()}
    b = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(table([(i, f"b{i}") for i in range(25, 90)])).collect()}
    assert all(a[i] == b[i] for i in range(25, 50))


def test_growth_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "k")
    trees = [HashTree(), HashTree().grown(), HashTree().grown(2), HashTree().grown(5)]
    for i, t in enumerate(trees):
        ids = sharding.with_shard(ids, t, F.col("k"), f"s{i}")
    rows = ids.collect()
    for i in range(3):
        moved = [r for r in rows if r[f"s{i}"] != r[f"s{i + 1}"]]
        assert moved and all(r[f"s{i + 1}"] >= trees[i].size for r in moved)
    counts = Counter(r["s3"] for r in rows)
    assert set(counts) == set(range(45)) and max(counts.values()) < 1.25 * 20_000 / 45 and min(counts.values()) > 0.75 * 20_000 / 45


def test_a_heavier_child_only_gains(spark):
    ids = spark.range(5000).select(
        F.col("id"),
        sharding.winner(F.col("id"), [("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, 1.0)]).alias("old"),
        sharding.winner(F.col("id"), [("a", 0, 1.0), ("b", 1, 4.0), ("c", 2, 1.0)]).alias("new"),
    ).collect()
    assert all(r["new"] == 1 for r in ids if r["old"] != r["new"])
    assert abs(sum(r["new"] == 1 for r in ids) / 5000 - 2 / 3) < 0.03


def plain_shard(key, tree):
    """The descent in plain Python: the least of -ln(u) / weight on each level."""

    def winner(key, children):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key) if isinstance(key, int) else key.encode(), seed=42).intdigest()
        unit = lambda name: ((xxhash.xxh64(name.encode(), seed=seed).intdigest() >> 11) + 0.5) / (1 << 53)
        return min((-math.log(unit(name)) / weight, number) for name, number, weight in children)[1]

    regions = [(f"region{r}", r, tree.racks * tree.shards) for r in range(tree.regions)]
    region = winner(key, regions + [(f"extra{x}", tree.regions + x, 1) for x in range(tree.extra)])
    whole = tree.racks * tree.shards
    if region >= tree.regions:
        return tree.regions * whole + region - tree.regions
    path = "/".join(str(x) for x in (key, region) if x is not None)
    rack = winner(path, [(f"rack{k}", k, tree.shards) for k in range(tree.racks)])
    return region * whole + rack * tree.shards + winner(f"{path}/{rack}", [(f"shard{s}", s, 1) for s in range(tree.shards)])


def test_descent_matches_plain_python(table):
    ids = [None, *range(600), -5, 1 << 62, -(1 << 63)]
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(table([(i, "x") for i in ids])).collect()}
    assert got == {i: (plain_shard(i, HashTree()), plain_shard(i, HashTree().grown())) for i in ids}


def test_empty_table(table):
    assert sharding.assign(table([])).count() == 0
