"""One-permutation MinHash fingerprints, densified and cut to low-order bits.

Every shingle is hashed once; the top bits choose one of ``bins`` bins, which keeps
its least hash.  An empty bin borrows from a bin that its own fixed random order of bins
names first (optimal densification), the same order for all documents.  Of each
bin ``bits`` low-order bits are stored.  Two unrelated values agree in them by chance, so
the likeness is ``(agreeing - chance) / (1 - chance)``, not below 0.

Defined results: shingles are five words, A-Z in small letters; a shorter text is one
shingle of all its words; a text without words (null, empty, blank) has the empty fingerprint, whose
likeness is 1 to another empty one and 0 to all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, landed, map_batches, mixed

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
BINS, BITS, SHINGLE = 256, 4, 5
STEPS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1 | 1 for i in range(64)], dtype=np.uint64)
BLOCK_BYTES, BLOCKS_PER_TASK = 4 << 20, 4
CELLS, HOT, RUN, MAX_BROADCAST_BLOCKS = 1 << 12, 4, 1 << 10, 1 << 18


@lru_cache(maxsize=4)
def lenders(bins: int) -> np.ndarray:
    """For every bin the order in which it asks the others."""
    random = np.random.default_rng(7)
    return np.stack([random.permutation(bins) for _ in range(bins)])


def shingle_hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    parts = text.translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = len(h) - words + 1
    if n < 1:
        return mixed((h * STEPS[: len(h)]).sum(keepdims=True) + np.uint64(len(h))) if len(h) else h
    return mixed(sum(h[i : i + n] * STEPS[i] for i in range(words)) + np.uint64(words))


def sketch(text: bytes, bins: int = BINS, bits: int = BITS, words: int = SHINGLE) -> np.ndarray | None:
    """The low-order bits of every bin; None for a text without words."""
    h = np.sort(shingle_hashes(text, words))
    if not len(h):
        return None
    shift = 64 - (bins - 1).bit_length()
    edges = np.searchsorted(h, np.arange(bins, dtype=np.uint64) << np.uint64(shift))
    full = edges < np.concatenate((edges[1:], [len(h)]))
    values = h[np.minimum(edges, len(h) - 1)]
    empty, ask = np.flatnonzero(~full), lenders(bins)
    for turn in range(bins):
        if not len(empty):
            break
        lender = ask[empty, turn]
        good = full[lender]
        values[empty[good]] = values[lender[good]]
        empty = empty[~good]
    return (values & np.uint64((1 << bits) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None, bits: int = BITS) -> str:
    """Hex text of a sketch, ``bits`` a bin."""
    if values is None:
        return ""
    spread = np.unpackbits(values[:, None], axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.ravel(), bitorder="little").tobytes().hex()


def unpacked(text: str, bits: int = BITS) -> np.ndarray | None:
    if not text:
        return None
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(text), dtype=np.uint8), bitorder="little")
    return np.packbits(flat.reshape(-1, bits), axis=1, bitorder="little")[:, 0]


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """Estimated share of common shingles."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 1.0 / (1 << bits)
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1.0 - chance)))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hex) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [packed(sketch(x or b"")) for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return map_batches(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col]), run, "doc_id long, fingerprint string")


class Cut:
    """How the descending order of (id, text hash), null ids last, is cut into blocks of some ``block_bytes``.

    Two levels: ``CELLS`` ranges of ids of equal width, and one of its own for every id in ``hot``; each cut into as many equal
    ranges as its bytes need, of ids between its own extremes, or of text hashes if it has one id only.
    """

    def __init__(self, low: int, high: int, hot: list[int]):
        width = (high - low) // CELLS + 1
        starts = {low + i * width for i in range(1, CELLS)} | {h + i for h in hot for i in (0, 1)}
        self.starts = np.array(sorted(x for x in starts if low < x <= high), dtype=np.int64)

    def cell(self, ids: np.ndarray, missing: np.ndarray) -> np.ndarray:
        n = len(self.starts)
        return np.where(missing, n + 1, n - np.searchsorted(self.starts, ids, side="right"))

    def fill(self, cells: list[tuple], block_bytes: int) -> int:
        """``cells``: (cell, bytes, least id, largest id).  Neighbours share a block as far as they fit.  The number of blocks."""
        self.parts, self.first, self.top, self.span = (np.zeros(len(self.starts) + 2, dtype=t) for t in (np.int64, np.int64, np.int64, np.float64))
        block = held = 0
        for cell, size, least, largest in sorted(cells):
            self.parts[cell] = max(1, -(-size // block_bytes))
            if held and held + size > block_bytes:
                block, held = block + 1, 0
            self.first[cell], held = block, held + size
            if self.parts[cell] > 1:
                block, held = block + int(self.parts[cell]), 0
                if least is not None and least < largest:
                    self.top[cell], self.span[cell] = largest, float(largest - least + 1)
        return block + (held > 0 or block == 0)

    def block(self, ids: np.ndarray, missing: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        cell = self.cell(ids, missing)
        by_id = (self.top[cell].view(np.uint64) - ids.view(np.uint64)).astype(np.float64) / np.maximum(self.span[cell], 1.0)
        by_rank = (ranks.astype(np.float64) + 2.0**63) / 2.0**64
        share = np.where(self.span[cell] > 0, by_id, by_rank)
        return self.first[cell] + np.minimum((share * self.parts[cell]).astype(np.int64), self.parts[cell] - 1)


def guests(tops: DataFrame) -> DataFrame:
    """(block, ..., home): the non-empty block ahead of each one, of the first one the last.  Blocks are looked at in runs of ``RUN``; a number
    a run reaches the driver."""
    runs = tops.withColumn("_run", F.expr(f"block div {RUN}"))
    ends = sorted(tuple(r) for r in runs.groupBy("_run").agg(F.max("block")).collect())
    before = [(run, ends[i - 1][1]) for i, (run, _) in enumerate(ends)]
    ahead = F.broadcast(tops.sparkSession.createDataFrame(before, "_run long, _ahead long"))
    home = F.coalesce(F.lag("block").over(W.partitionBy("_run").orderBy("block")), F.col("_ahead"))
    return runs.join(ahead, "_run").withColumn("home", home).drop("_run", "_ahead")


def neighbours(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Documents dealt to blocks of falling ids, each block followed by the first document of the next.

    That document also goes to the block before it as a guest, so
    texts are shuffled once and no task needs the whole order.  A task gets several small blocks, which evens out their hashing.  After the last block comes the first.
    The list of first documents is broadcast if it has at most ``MAX_BROADCAST_BLOCKS`` rows, and joined as any table beyond.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_rank"))
    missing, known = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long"))
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    size = F.sum(F.octet_length("text"))
    # Ids with several blocks of text: one in HOT * block_bytes of the input at most.
    hot = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(size.alias("n")).filter(F.col("n") > HOT * block_bytes).collect()
    cut = Cut(ends[0] or 0, ends[1] or 0, [r["doc_id"] for r in hot])

    @F.pandas_udf("long")
    def cell_of(ids: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(cut.cell(ids.to_numpy(np.int64), missing.to_numpy(bool)))

    sizes = docs.select("doc_id", cell_of(known, missing).alias("cell"), F.octet_length("text").alias("n"))
    cells = sizes.groupBy("cell").agg(F.sum("n"), F.min("doc_id"), F.max("doc_id")).collect()
    n_blocks = cut.fill([tuple(r) for r in cells], block_bytes)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series, missing: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series(cut.block(ids.to_numpy(np.int64), missing.to_numpy(bool), ranks.to_numpy(np.int64)))

    order = F.struct(missing.alias("none"), F.bitwise_not("doc_id").alias("falling"), F.col("_rank").alias("rank"))
    placed = docs.withColumn("block", block_of(known, missing, F.col("_rank")))
    tops = landed(placed.groupBy("block").agg(F.min(order).alias("_top")), "block-tops")
    homes = landed(guests(tops), "block-homes")
    homes = homes.select(F.col("block").alias("_block"), "_top", "home")
    small = homes.count() <= MAX_BROADCAST_BLOCKS
    rows = placed.join(F.broadcast(homes) if small else homes, (F.col("block") == F.col("_block")) & order.eqNullSafe(F.col("_top")), "left")
    both = F.when(F.col("home").isNull(), F.array("block")).otherwise(F.array("block", "home"))
    rows = rows.select("doc_id", "_rank", "text", F.posexplode(both).alias("guest", "block"))
    dealt = rows.repartition(max(1, n_blocks // BLOCKS_PER_TASK), "block")
    return dealt.sortWithinPartitions("block", "guest", F.desc_nulls_last("doc_id"), "_rank", "text"), n_blocks


def compare_with_next(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses.

    The edited text has its last third of code points replaced by the first as many of
    the next document in order of falling ids (rows with the same id by a hash of their text, null ids last).
    """
    rows, _ = neighbours(df, id_col, text_col, block_bytes)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def judged(doc: tuple, after: tuple) -> tuple:
        i, text, own = doc
        third = len(text) // 3
        edited = (text[: len(text) - third] + after[1][:third]).encode()
        changed = sketch(edited)
        return i, len(text), hashlib.sha256(edited).hexdigest(), packed(own), packed(changed), likeness(own, changed), likeness(own, after[2])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, closed = None, None, False
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b, out = whole.slice(lo, 256), []
                for home, guest, i, text in zip(*[b.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text")]):
                    if home != block:
                        block, last, closed = home, None, False
                    if closed:
                        continue  # the block has met the document after its last
                    now = (i, text, sketch(text.encode()))
                    if last is not None:
                        out.append(judged(last, now))
                    last, closed = now, guest == 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return map_batches(
        rows.select("block", "guest", "doc_id", "text"), run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
