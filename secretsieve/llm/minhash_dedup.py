"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification on full sets.

A document's set is that of its distinct 3-word shingles.  Equal sets are one node, named by a 64-bit hash of the set.  A node has
``BANDS`` keys of ``ROWS`` least hashes each and ``CHECKS`` further least hashes, of which four bits are kept.

Candidates.  Nodes that share a key meet in a bucket.  There their checks are compared in batches of 16: with a uniform prior of the likeness a pair
is dropped as soon as the posterior probability that it reaches the threshold is below ``miss``.  A bucket sends on a forest over its
survivors, never pairs.  A bucket of more than ``split_above`` nodes is split by every second key of its nodes (a pair at the threshold
shares two keys or more with 0.99998); one that is still larger is taken as one group unseen.

Verification.  The survivors' components are groups that hold every linked pair.  One text of each member (a Bloom sketch of
text hashes picks them) is shipped to its group, where the full sets are computed once more.  A group of more than ``group_shingles``
is cut into cells by size class (linked sets differ by at most one class) and hash, and pairs of
neighbouring cells meet in tiles; so a group of any size is compared whole, in parts of bounded size.  In a tile a pair already connected is
skipped, the others pass the checks and then 100 * intersection >= percent * union on full sets.  Links make the components.

A pair at the threshold shares none of its 24 keys with probability 7.7e-7, and is dropped by its checks with less than 1e-5.
The work inside one group of different texts grows with the square of their number, spread over tiles.

Defined results: texts without words have an empty set and are components of their own; of a group the
least id names the component, a null id only if the group has no other; a row is kept if its id is that of its
component (null like null), so rows that share that id are all kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting_bloom
from .common import CAPITALS, SMALL, byte_texts, landed, map_batches, mixed
from .components import components
from .simhash import forest

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
SHINGLE, PERCENT, MISS = 3, 85, 1e-6
BANDS, ROWS, CHECKS, CHECK_BITS, BATCH = 24, 5, 64, 4, 16
SHORT_RUN, SPLIT_ABOVE, GROUP_SHINGLES, BROADCAST_KEYS = 32, 2000, 500_000, 1 << 19
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_random = np.random.default_rng(13)
FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS + CHECKS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TERMS = _random.integers(0, 1 << 32, BANDS * ROWS + CHECKS, dtype=np.uint32)


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Ascending hashes of the distinct k-word shingles; fewer words are one shingle, no words none."""
    words = text.translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - k + 1
    if n < 1:
        return mixed((h * STEPS[: len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    return np.unique(mixed(sum(h[i : i + n] * STEPS[i] for i in range(k))))


def node_of(shingles: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of the bands, and the packed checks."""
    h, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(FACTORS), (1 << 32) - 1, dtype=np.uint32)
    for lo in range(0, len(h), 1024):
        np.minimum(least, (h[lo : lo + 1024, None] * FACTORS + TERMS).min(axis=0), out=least)
    keys = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    keys = mixed((keys * STEPS[:ROWS]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    low = (least[BANDS * ROWS :] & np.uint32((1 << CHECK_BITS) - 1)).astype(np.uint8)
    return keys.view(np.int64), (low[::2] | low[1::2] << 4).tobytes()


def checks_of(column: pa.Array) -> np.ndarray:
    """A row of check values for every row."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), CHECKS // 2)
    return np.stack((flat & 15, flat >> 4), axis=2).reshape(len(column), CHECKS)


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """For every batch the least number of agreeing checks so far that keeps a pair."""
    chance = 1 / (1 << CHECK_BITS)
    at_threshold = chance + (1 - chance) * percent / 100

    def at_most(m: int, n: int, p: float) -> float:
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m + 1))

    # A uniform prior on [chance, 1] makes the posterior a cut Beta(m + 1, n - m + 1), whose tails are binomial sums.
    return tuple(
        next(m for m in range(n + 1) if at_most(m, n + 1, at_threshold) >= miss * at_most(m, n + 1, chance))
        for n in range(BATCH, CHECKS + 1, BATCH)
    )


def survivors(checks: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Positions of the pairs a[i], b[i] that no batch drops."""
    at, met = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for turn, needed in enumerate(least):
        lo = turn * BATCH
        met = met + (checks[a[at], lo : lo + BATCH] == checks[b[at], lo : lo + BATCH]).sum(axis=1)
        good = met >= needed
        at, met = at[good], met[good]
    return at


def alike_in_size(n: np.ndarray, m, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def joined(label: np.ndarray, x: int, others: np.ndarray) -> None:
    """Connect x with the others: their labels become one."""
    old = np.unique(label[others])
    label[np.isin(label, old)] = label[x]


def bucket_links(keys: np.ndarray, checks: np.ndarray, n: np.ndarray, percent: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links between survivors of runs of equal keys, enough to connect all that are connected: short runs
    are compared by offset, in long ones a pair already connected is skipped."""
    start, size = runs(keys)
    run = np.repeat(np.arange(len(start)), size)
    short = size[run] <= SHORT_RUN
    left, right = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    for d in range(1, min(SHORT_RUN, int(size.max()))):
        i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
        i = i[alike_in_size(n[i], n[i + d], percent)]
        i = i[survivors(checks, i, i + d, least)]
        left.append(i)
        right.append(i + d)
    for r in np.flatnonzero(size > SHORT_RUN).tolist():
        lo, length = int(start[r]), int(size[r])
        label, inside, sizes = np.arange(length), checks[lo : lo + length], n[lo : lo + length]
        for x in range(length - 1):
            may = (label != label[x]) & alike_in_size(sizes, sizes[x], percent)
            may[: x + 1] = False
            y = np.flatnonzero(may)
            y = y[survivors(inside, np.full(len(y), x), y, least)]
            if len(y):
                y = y[np.unique(label[y], return_index=True)[1]]
                left.append(np.full(len(y), lo + x))
                right.append(lo + y)
                joined(label, x, y)
    return np.concatenate(left), np.concatenate(right)


def tile_links(side: np.ndarray, checks: np.ndarray, sets: list[np.ndarray], percent: int, least: tuple[int, ...]) -> Iterator[tuple[int, int]]:
    """A forest over the exactly verified pairs of a tile: of one cell (side 0), or across two (sides 1 and 2)."""
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
    mark, label = np.zeros(len(words), dtype=bool), np.arange(len(sets))
    for x in range(len(sets) - 1):
        may = (label != label[x]) & alike_in_size(n, n[x], percent)
        if side[x]:
            may &= side != side[x]
        may[: x + 1] = False
        y = np.flatnonzero(may)
        y = y[survivors(checks, np.full(len(y), x), y, least)]
        if not len(y):
            continue
        mark[parts[x]] = True
        common = np.add.reduceat(mark[np.concatenate([parts[i] for i in y.tolist()])], np.cumsum(n[y]) - n[y], dtype=np.int64)
        mark[parts[x]] = False
        y = y[100 * common >= percent * (n[x] + n[y] - common)]
        if len(y):
            y = y[np.unique(label[y], return_index=True)[1]]
            yield from ((x, i) for i in y.tolist())
            joined(label, x, y)


def by_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of sorted batches, in tables that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        elif held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return start, np.diff(np.concatenate((start, [len(keys)])))


def links_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def sized(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A landed table of a few numbers a row, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def signed(df: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """A row a document: doc_id, n_shingles, node (null: no words), text_hash; the first row of a node in a task also has its signature."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "n_shingles", "node", "text_hash", "keys", "checks"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for text in byte_texts(b.column(2)):
                shingles = shingle_set(text, k)
                node = node_of(shingles) if len(shingles) else None
                if node is None or node in seen:
                    rows.append((len(shingles), node, None, None))
                    continue
                seen.add(node)
                keys, checks = signature(shingles)
                rows.append((len(shingles), node, keys, checks))
            if rows:
                n, node, keys, checks = zip(*rows)
                columns = [b.column(0), n, node, b.column(1), keys, checks]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types)], names=names)

    text_hash = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), text_hash.alias("text_hash"), df[text_col])
    return map_batches(rows, run, "doc_id long, n_shingles long, node long, text_hash long, keys array<long>, checks binary")


def groups(nodes: DataFrame, percent: int, miss: float, split_above: int) -> DataFrame:
    """(u, v): forests whose components hold all pairs that share a bucket and survive its checks."""
    rows = nodes.select("node", "n_shingles", "checks", F.explode("keys").alias("key"))
    hot = sized(landed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_above).select("key"), "hot-keys"))
    # All pairs of keys of the nodes of a hot bucket that have the hot key in them.
    second = rows.select("node", "key").join(hot, "key", "left_semi").join(nodes, "node").select(
        "node", "n_shingles", "checks", F.explode(F.expr("transform(filter(keys, k -> k <> key), k -> xxhash64(least(k, key), greatest(k, key)))")).alias("key")
    )
    sizes = second.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter(F.col("n") > split_above)
    huge = sized(landed(sizes.select("key", "lead"), "huge-keys"))
    buckets = rows.join(hot, "key", "left_anti").unionByName(second.join(huge, "key", "left_anti"))
    least = least_matches(percent, miss)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(batches, "key"):
            node = t.column("node").to_numpy()
            a, b = bucket_links(t.column("key").to_numpy(), checks_of(t.column("checks")), t.column("n_shingles").to_numpy(), percent, least)
            yield links_batch(*forest(node[a], node[b]))

    dealt = buckets.repartition("key").sortWithinPartitions("key").select("key", "node", "n_shingles", "checks")
    whole = second.select("node", "key").join(huge, "key").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    return map_batches(dealt, run, "u long, v long").unionByName(whole)


def tiled(members: DataFrame, percent: int, group_shingles: int) -> DataFrame:
    """Members (node, root, n_shingles, ...) with the tiles in which they meet: tile and side are added."""
    width = math.log(100 / percent) * (1 + 1e-9)
    members = members.withColumn("class", F.floor(F.log("n_shingles") / width).cast("int"))
    cells = members.groupBy("root", "class").agg(F.sum("n_shingles").alias("n"))
    shape = cells.groupBy("root").agg(  # a class for each factor of 100 / percent in the size: some dozens a group
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("n") / group_shingles).cast("int").alias("c")))).alias("parts")
    )
    placed = members.join(shape, "root").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts[class]) as int)"))
    cell = "struct(class as c, part as p)"
    meets = (
        "flatten(transform(filter(array(class - 1, class, class + 1), c -> map_contains_key(parts, c)),"
        " c -> transform(sequence(0, parts[c] - 1), p -> struct(c as c, p as p))))"
    )
    tiles = f"""CASE WHEN total <= {group_shingles} THEN array(struct(xxhash64(root) AS tile, 0 AS side)) ELSE transform({meets}, other -> struct(
        xxhash64(root, least({cell}, other), greatest({cell}, other)) AS tile,
        CASE WHEN {cell} = other THEN 0 WHEN {cell} < other THEN 1 ELSE 2 END AS side)) END"""
    return placed.withColumn("t", F.explode(F.expr(tiles))).select(*[c for c in members.columns if c != "class"], "t.tile", "t.side")


def verified(df: DataFrame, docs: DataFrame, nodes: DataFrame, grouped: DataFrame, k: int, percent: int, miss: float, group_shingles: int, text_col: str) -> DataFrame:
    """(u, v): forests over the pairs of each group that reach the threshold on their full sets."""
    members = landed(grouped.join(nodes.select("node", "n_shingles", "checks", "text_hash"), "node"), "members")
    # One text for each member: hashes that the sketch lets through by chance go with the join.
    segments = counting_bloom.segments_for(members.count())
    wanted = counting_bloom.finder(members, "text_hash", counting_bloom.merged(members, "text_hash", segments, least=1), segments)
    texts = wanted(df.select(df[text_col].alias("text"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("text_hash")), "text_hash")

    one_each = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    rows = tiled(members, percent, group_shingles).join(one_each, "text_hash")
    least = least_matches(percent, miss)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(batches, "tile"):
            u, v = [], []
            node, side, checks = t.column("node").to_numpy(), t.column("side").to_numpy(), checks_of(t.column("checks"))
            found = [shingle_set(x, k) for x in byte_texts(t.column("text"))]
            for lo, n in zip(*(x.tolist() for x in runs(t.column("tile").to_numpy()))):
                for a, b in tile_links(side[lo : lo + n], checks[lo : lo + n], found[lo : lo + n], percent, least):
                    u.append(node[lo + a])
                    v.append(node[lo + b])
            yield links_batch(np.array(u, dtype=np.int64), np.array(v, dtype=np.int64))

    dealt = rows.repartition("tile").sortWithinPartitions("tile").select("tile", "side", "node", "checks", "text")
    return map_batches(dealt, run, "u long, v long")


def near_duplicates(
    df: DataFrame, *, shingle_words: int = SHINGLE, percent: int = PERCENT, miss: float = MISS, split_above: int = SPLIT_ABOVE,
    group_shingles: int = GROUP_SHINGLES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links) and kept (whether the row has that id).

    ``percent``: from 80, for which the bands are chosen, to 99."""
    if not 80 <= percent < 100:
        raise ValueError("percent must be from 80 to 99")
    docs = landed(signed(df, shingle_words, id_col, text_col), "minhash")
    with_words = docs.filter("node IS NOT NULL")
    nodes = landed(
        with_words.groupBy("node").agg(
            F.min("doc_id").alias("first"), F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n_shingles"),
            F.first("keys", ignorenulls=True).alias("keys"), F.first("checks", ignorenulls=True).alias("checks"),
        ), "minhash-nodes",
    )
    candidates = components(groups(nodes, percent, miss, split_above))
    links = verified(df, docs, nodes, candidates, shingle_words, percent, miss, group_shingles, text_col)
    roots = landed(components(links), "roots")
    firsts = nodes.select("node", "first")
    linked = firsts.join(roots, "node")
    names = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = firsts.join(roots.join(names, "root").select("node", "least", "root"), "node", "left").select(
        "node", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")
    )
    found = with_words.select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = docs.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
