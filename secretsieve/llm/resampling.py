"""Importance resampling towards a target table: scored by bucketed n-grams, ranked by a distributed radix sort.

Features are all runs of one to two words, hashed into buckets.  A bucket's gain is the scaled logarithm of the
ratio of its smoothed shares in the target and in the corpus; the gains are one array of fixed length, which every task holds.  A document's
weight is the floored mean of its features' gains.  Seeded Gumbel noise turns the highest
scores into a draw without replacement.

The rank is found by least-significant-digit radix sort over the digits of (score descending, id, features).  In a pass a block of
rows counts its digits, prefix sums over (digit, block) give every block the places of its digits, and a stable counting sort within the block
gives every row its own place; the place names the row's next block.  Rows below the last drawn score (known from a
histogram of the scores, whose range is bounded) don't enter the sort.  Every pass is written to the
shared folder, so a lost executor repeats a part of one pass.  A block has ``block_rows`` rows, whatever their keys.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a null id is hashed as the empty
text and ranks behind all others of its score; rows that share id and score rank by their number of features; repeated rows
are drawn one by one; an empty target gives gains against nothing; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_texts, discard, landed, map_batches

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 25, 7
SLICE_BYTES, CACHED_WORDS = 1 << 20, 1 << 17
BLOCK_ROWS, DIGIT_BITS = 4096, 10
# Lower-cased letters, digits and whatever is not ASCII make words; all other bytes part them.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@lru_cache(maxsize=1)
def shift_tables(longest: int = 64) -> np.ndarray:
    """[length][byte place][byte]: what a checksum becomes when ``length`` further bytes follow, as far as it does not depend on them."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    tables = np.empty((longest + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
    for n in range(1, longest + 1):
        tables[n] = (tables[n - 1] >> np.uint32(8)) ^ step[tables[n - 1] & np.uint32(255)]
    return tables


class Features:
    """Buckets of the features of texts.  Checksums of words are cached; that of a word pair follows from those of its words."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.alone = np.empty(1024, dtype=np.uint32)
        self.behind = np.empty(1024, dtype=np.uint32)  # of the blank and the word
        self.length = np.empty(1024, dtype=np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.number)
        if new:
            start = len(self.number)
            while start + len(new) > len(self.alone):
                self.alone, self.behind, self.length = (np.concatenate((x, np.empty_like(x))) for x in (self.alone, self.behind, self.length))
            for i, word in enumerate(new, start):
                self.number[word] = i
                self.alone[i], self.behind[i], self.length[i] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def pairs(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """Checksums of the pairs of neighbours."""
        tables = shift_tables()
        first, n = self.alone[ids[:-1]], self.length[ids[1:]]
        base = np.minimum(n, len(tables) - 1) * 1024
        flat, out = tables.ravel(), self.behind[ids[1:]].copy()
        for place in range(4):
            out ^= flat[base + 256 * place + ((first >> np.uint32(8 * place)) & np.uint32(255))]
        for i in np.flatnonzero(n >= len(tables)).tolist():  # words of 64 bytes or more
            out[i] = zlib.crc32(b" " + words[i + 1], int(first[i]))
        return out

    def __call__(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(words, buckets of features) of every slice of a text."""
        text, start, last = text.translate(WORD_BYTES), 0, []
        while start < len(text):
            end = len(text) if start + SLICE_BYTES >= len(text) else text.find(b" ", start + SLICE_BYTES)
            end = len(text) if end < 0 else end
            words = text[start:end].split()
            start = end
            if not words:
                continue
            if len(self.number) > CACHED_WORDS:
                self.clear()
            chain = last + words
            ids = self.numbers(chain)
            sums = np.concatenate((self.alone[ids[len(last) :]], self.pairs(chain, ids)))
            last = words[-1:]
            yield len(words), (sums % np.uint32(self.buckets)).astype(np.int64)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table fall into each bucket: at most ``buckets`` numbers from a task and to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = Features(buckets), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in byte_texts(b.column(0)):
                for _, found in find(text):
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    rows = map_batches(df.select(df[text_col]), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold logarithm of the ratio of the smoothed shares, per bucket."""
    n, total, wanted = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array(
        [math.floor(1000 * math.log((float(target[i]) + 1) * total / ((float(corpus[i]) + 1) * wanted))) for i in range(n)], dtype=np.int64
    )


def noise(doc: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, *, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight and score of every document."""
    names = ["doc_id", "n_features", "n_words", "weight", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Features(len(gain))
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1))):
                n_words = n = summed = 0
                for words, found in find(text):
                    n_words, n, summed = n_words + words, n + len(found), summed + int(gain[found].sum())
                weight = summed // n if n else 0
                out.append((doc, n, n_words, weight, weight + noise(doc, seed)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col])
    return map_batches(rows, run, ", ".join(f"{n} long" for n in names))


class Key:
    """The composite key of the sort, least significant column first, and its digits."""

    def __init__(self, least_id: int, bits: tuple[int, int, int], digit_bits: int):
        self.least_id, self.bits, self.digit_bits = least_id, bits, digit_bits
        self.passes = max(1, -(-sum(bits) // digit_bits))

    def columns(self, b: pa.RecordBatch, top: int) -> list[np.ndarray]:
        ids = b.column("doc_id")
        missing = np.asarray(ids.is_null())
        plain = np.where(missing, self.least_id, ids.fill_null(self.least_id).to_numpy(zero_copy_only=False)).astype(np.int64)
        return [
            b.column("n_features").to_numpy().astype(np.uint64),
            plain.view(np.uint64) - np.int64(self.least_id).astype(np.uint64),  # wraps, so that any two ids have a distance
            2 * (top - b.column("score").to_numpy()).astype(np.uint64) + missing.astype(np.uint64),
        ]

    def digit(self, columns: list[np.ndarray], turn: int) -> np.ndarray:
        low, out, at = turn * self.digit_bits, np.zeros(len(columns[0]), dtype=np.uint64), 0
        for column, bits in zip(columns, self.bits):
            a, b = max(low, at), min(low + self.digit_bits, at + bits)
            if a < b:
                out |= ((column >> np.uint64(a - at)) & np.uint64((1 << (b - a)) - 1)) << np.uint64(a - low)
            at += bits
        return out.astype(np.int64)


PAYLOAD = ["doc_id", "n_features", "weight", "score"]
ROWS = "pos long, block long, digit long, " + ", ".join(f"{c} long" for c in PAYLOAD)


def with_places(b: pa.RecordBatch | pa.Table, pos: np.ndarray, block: np.ndarray, digit: np.ndarray) -> list[pa.Array]:
    return [pa.array(x, pa.int64()) for x in (pos, block, digit)] + [b.column(c) for c in PAYLOAD]


def counting_sort(key: Key, turn: int, ahead: np.ndarray, top: int, block_rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One pass over a block: its rows and the places that its digits have in it and in the blocks before, to rows at new places."""

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        # Positions of a block's rows differ within its length: that puts them in order.
        at = left.column("pos").to_numpy()
        slots = np.full(block_rows, -1, dtype=np.int64)
        slots[at % block_rows] = np.arange(len(at))
        b = left.take(slots[slots >= 0]).combine_chunks().to_batches()[0]
        digit = b.column("digit").to_numpy()
        order = np.argsort(digit, kind="stable")
        n = np.bincount(digit)
        rank = np.empty(len(digit), dtype=np.int64)
        rank[order] = np.arange(len(digit)) - np.repeat(np.cumsum(n) - n, n)
        mine = np.zeros(1 << key.digit_bits, dtype=np.int64)
        mine[right.column("digit").to_numpy()] = right.column("before").to_numpy()
        pos = ahead[digit] + mine[digit] + rank
        follows = key.digit(key.columns(b, top), turn + 1)
        return pa.Table.from_arrays(with_places(b, pos, pos // block_rows, follows), names=["pos", "block", "digit", *PAYLOAD])

    return place


def radix_ranked(df: DataFrame, *, block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """The columns of PAYLOAD and ``pos``, from 0: the place by score descending, doc_id (nulls last) and n_features."""
    seen = df.agg(
        F.max("score").alias("top"), F.min("score").alias("low"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.max("n_features").alias("features"), F.count(F.lit(1)).alias("n"),
    ).first()
    if not seen["n"]:
        return df.select(*PAYLOAD, F.lit(0).cast("long").alias("pos"))
    first, last, top = seen["first"] or 0, seen["last"] or 0, seen["top"]
    key = Key(first, (seen["features"].bit_length(), (last - first).bit_length(), (2 * (top - seen["low"]) + 1).bit_length()), digit_bits)
    names = ["pos", "block", "digit", *PAYLOAD]

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos = b.column("pos").to_numpy()
            yield pa.RecordBatch.from_arrays(with_places(b, pos, pos // block_rows, key.digit(key.columns(b, top), 0)), names=names)

    # The order in which equal keys come does not matter: their rows are equal.
    rows = landed(map_batches(df.select(F.monotonically_increasing_id().alias("pos"), *PAYLOAD), start, ROWS), "radix")
    for turn in range(key.passes):
        counts = landed(rows.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")), "radix-counts")
        ahead = np.zeros((1 << digit_bits) + 1, dtype=np.int64)
        for digit, n in counts.groupBy("digit").agg(F.sum("n")).collect():  # at most one number a digit
            ahead[digit + 1] = n
        ahead = np.cumsum(ahead)
        before = W.partitionBy("digit").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        offsets = counts.select("block", "digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        moved = rows.groupBy("block").cogroup(offsets.groupBy("block")).applyInArrow(counting_sort(key, turn, ahead, top, block_rows), ROWS)
        rows = landed(moved, "radix", instead_of=rows)
        discard(counts)
    return rows.select(*PAYLOAD, "pos")


def resample(
    df: DataFrame, target: DataFrame, *, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", block_rows: int = BLOCK_ROWS, digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; of those with ``least_words`` words or more ``share``
    percent are drawn and have a rank from 1."""
    gain = gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_text, buckets))
    rows = landed(scored(df, gain, seed=seed, id_col=id_col, text_col=text_col), "scored")
    # Scores are sums of bounded logarithms: some 100,000 different ones at most.
    histogram = rows.filter(F.col("n_words") >= least_words).groupBy("score").count().collect()
    drawn = sum(n for _, n in histogram) * share // 100
    sums = itertools.accumulate(n for _, n in sorted(histogram, reverse=True))
    least = next((s for (s, _), n in zip(sorted(histogram, reverse=True), sums) if n >= drawn), None) if drawn else None
    rank = F.lit(None).cast("long").alias("rank")
    if least is None:
        return rows.select(*PAYLOAD, rank)
    may = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    ranked = radix_ranked(rows.filter(may), block_rows=block_rows, digit_bits=digit_bits)
    return rows.filter(~may).select(*PAYLOAD, rank).unionByName(
        ranked.select(*PAYLOAD, F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
    )
