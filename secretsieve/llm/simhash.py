"""SimHash near-duplicates with pigeonring candidates.

A fingerprint is cut into ``max_bits + 1`` segments in a ring.  Two fingerprints
within ``max_bits`` bits have a segment from which every chain of l consecutive segments
differs in at most ``l * max_bits / segments`` bits: the first segment agrees and
the first two differ in at most one bit.  So one half of the second segment agrees
too, and (place, first segment, that half) is the key under which candidates meet: two keys per
place.  Candidates pass all chains before the full distance is taken.

Equal fingerprints are one node.  Keys held by more than ``split_above`` fingerprints
are split once more by thirds (``max_bits + 1`` parts) of the remaining bits, one of which agrees
as well.  Within a key, rows stream in order: short runs are compared by offset, long ones look
their neighbours up in the sorted run, so the work is linear in the run.  A batch sends on a forest over its
links, never all pairs; components come from stars over these forests.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link like
any other; repeated rows get a row each; a null id is never a component's name unless the
component has no other; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, byte_texts, landed, map_batches, unused
from .components import components

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
SPLIT_ABOVE = 2000
SHORT_RUN = 256


def fingerprint(text: bytes, k: int, seed: int = 42) -> int:
    """Bits that are set in more than half of the hashes of the k-word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - k + 1)
    starts = [0, *ends[: n - 1]]
    take = xxhash.xxh64_intdigest
    h = np.fromiter((take(joined[a : b - 1], seed) for a, b in zip(starts, ends[-n:])), dtype="<u8", count=n)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 14):
        counts += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", content: Column | None = None) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed 64-bit number, and ``content``, if given."""
    more = [] if content is None else ["content"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, k) for x in byte_texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *more]
            )

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col], *[content.alias(c) for c in more])
    return map_batches(rows, run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of the ring."""
    n = max_bits + 1
    bounds = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def keys(max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number, fixed bit ranges) of the keys under which candidates meet."""
    ring, out = segments(max_bits), []
    for i, first in enumerate(ring):
        low, width = ring[(i + 1) % len(ring)]
        half = width // 2
        for part in ((low, half), (low + half, width - half)):
            out.append((len(out), [first, part]))
    return out


def ranges_left(fixed: list[tuple[int, int]], parts: int) -> list[int]:
    """The bits outside the fixed ranges, as masks of near equal size."""
    taken = {b for low, width in fixed for b in range(low, low + width)}
    left = [b for b in range(64) if b not in taken]
    return [sum(1 << b for b in left[len(left) * i // parts : len(left) * (i + 1) // parts]) for i in range(parts)]


def mask(fixed: list[tuple[int, int]]) -> int:
    return sum(1 << b for low, width in fixed for b in range(low, low + width))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masked(fp: Column, m: int) -> Column:
    return fp.bitwiseAND(F.lit(signed(m)))


def pigeonring(xor: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether some chain of segments keeps within its proportional budget at every length."""
    ring = segments(max_bits)
    m = len(ring)
    differ = np.stack([np.bitwise_count((xor >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in ring]).astype(np.int64)
    passed = np.zeros(xor.shape, dtype=bool)
    for i in range(m):
        good, sums = np.ones(xor.shape, dtype=bool), np.zeros(xor.shape, dtype=np.int64)
        for n in range(1, m + 1):
            sums = sums + differ[(i + n - 1) % m]
            good &= sums * m <= n * max_bits
        passed |= good
    return passed


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Positions of the pairs within ``max_bits``: chains first, then the full distance."""
    xor = a ^ b
    at = np.flatnonzero(pigeonring(xor, max_bits))
    return at[np.bitwise_count(xor[at]) <= max_bits]


def flips(bits: list[int], max_bits: int) -> np.ndarray:
    """All masks of one to ``max_bits`` of the given bits."""
    return np.array([sum(1 << b for b in c) for n in range(1, max_bits + 1) for c in itertools.combinations(bits, n)], dtype=np.uint64)


def run_links(key: np.ndarray, kind: np.ndarray, fp: np.ndarray, free: dict[int, np.ndarray], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked rows of a batch of whole runs of equal keys, as two arrays of positions."""
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    left, right = [], []
    run = np.repeat(np.arange(len(starts)), sizes)
    short = sizes[run] <= SHORT_RUN
    for d in range(1, min(SHORT_RUN, int(sizes.max(initial=0)))):
        i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:])) if d < len(run) else np.array([], dtype=int)
        if not len(i):
            break
        hit = i[near(fp[i], fp[i + d], max_bits)]
        left.append(hit)
        right.append(hit + d)
    for r in np.flatnonzero(sizes > SHORT_RUN).tolist():
        rows = np.arange(starts[r], starts[r] + sizes[r])
        order = rows[np.argsort(fp[rows])]
        values, masks = fp[order], free[int(kind[starts[r]])]
        for lo in range(0, len(order), 256):
            sought = (values[lo : lo + 256, None] ^ masks[None, :]).ravel()
            at = np.minimum(np.searchsorted(values, sought), len(values) - 1)
            hit = np.flatnonzero(values[at] == sought)
            left.append(order[lo + hit // len(masks)])
            right.append(order[at[hit]])
    join = lambda x: np.concatenate(x) if x else np.array([], dtype=int)
    return join(left), join(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links a[i] - b[i]: (member, its least member), without loops."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def links(nodes: DataFrame, max_bits: int, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(u, v): forests whose components are those of all pairs of the distinct fingerprints
    ``nodes.fp`` within ``max_bits``."""
    if max_bits < 1:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    kinds = keys(max_bits)
    fp = F.col("fp")
    key = lambda kind, m: F.xxhash64(F.lit(kind), masked(fp, m))
    rows = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).alias("kind"), key(n, mask(fixed)).alias("key")) for n, fixed in kinds
    ])).alias("k")).select("fp", "k.kind", "k.key")
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_above).select("key", F.lit(True).alias("hot"))
    finer = F.array()
    for n, fixed in kinds:
        parts = F.array(*[key(len(kinds) * (p + 1) + n, mask(fixed) | m) for p, m in enumerate(ranges_left(fixed, max_bits + 1))])
        finer = parts if n == 0 else F.when(F.col("kind") == n, parts).otherwise(finer)
    rows = rows.join(hot, "key", "left").select(
        "fp", "kind", F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key")
    )
    # Long runs look neighbours up; bits of the key agree anyway, so only the others are flipped.
    free = {n: [b for b in range(64) if not mask(fixed) >> b & 1] for n, fixed in kinds}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {n: flips(bits, max_bits) for n, bits in free.items()}
        held: list[tuple[np.ndarray, ...]] = []

        def emit(parts) -> pa.RecordBatch:
            k, kind, f = (np.concatenate(x) for x in zip(*parts))
            a, b = run_links(k, kind, f.view(np.uint64), masks, max_bits)
            u, v = forest(f[a], f[b])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            now = tuple(b.column(c).to_numpy() for c in ("key", "kind", "fp"))
            if not len(now[0]):
                continue
            # The last run of a batch may go on in the next one.
            cut = int(np.searchsorted(now[0] == now[0][-1], True))
            if cut:
                yield emit([*held, tuple(x[:cut] for x in now)])
                held = [tuple(x[cut:] for x in now)]
            elif held and held[0][0][0] != now[0][0]:
                yield emit(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield emit(held)

    parts = rows.repartition("key").sortWithinPartitions("key")
    return map_batches(parts.select("key", "kind", "fp"), run, "u long, v long")


def grouped(docs: DataFrame, max_bits: int, split_above: int) -> DataFrame:
    """The columns of ``docs`` (doc_id, fp and others), component_id and root, the least fingerprint of the component."""
    nodes = landed(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes, max_bits, split_above))
    linked = nodes.join(roots, nodes["fp"] == roots["node"])
    names = linked.groupBy("root").agg(F.min("first").alias("least"))
    renamed = linked.join(names, "root").select(F.col("node").alias("fp"), "least", "root")
    nodes = nodes.join(renamed, "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return docs.join(nodes, "fp")


def near_duplicates(
    df: DataFrame, *, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """doc_id, fp (signed), fingerprint (hex) and component_id, the least id that is reachable over links."""
    docs = landed(fingerprints(df, shingle_words, id_col, text_col), "simhash")
    return grouped(docs, max_bits, split_above).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    df: DataFrame, *, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text",
    split_above: int = SPLIT_ABOVE,
) -> DataFrame:
    """The rows of the input that stand for their component, one each: the one with the least id, null ids last,
    and of rows that share that id the first in text order.  Rows are told apart by id and a hash of their text, so an id that
    is null or leads several components costs none of them its row."""
    key, mark, group, n, nth = (unused(df, c) for c in ("_kept", "_content", "_root", "_rows", "_nth"))
    content = F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit("")))
    docs = landed(fingerprints(df, shingle_words, id_col, text_col, content), "simhash")
    least = grouped(docs, max_bits, split_above).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counts = least.groupBy("root").agg(F.count(F.lit(1)).alias(n))
    kept = least.select("doc_id", "content", "root").distinct().join(counts, "root").select(
        F.col("doc_id").alias(key), F.col("content").alias(mark), F.col("root").alias(group), n
    )
    rows = df.join(kept, df[id_col].cast("long").eqNullSafe(F.col(key)) & (content == F.col(mark)))
    first = W.partitionBy(group).orderBy(text_col)
    repeated = rows.filter(F.col(n) > 1).withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1)
    return rows.filter(F.col(n) == 1).select(*df.columns).unionByName(repeated.select(*df.columns))
