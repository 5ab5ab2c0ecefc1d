"""A bigram language model with deleted interpolation, and scores of whole texts under it.

The probability of a token w after v mixes maximum-likelihood estimates of three orders,

    P(w | v) = a2(b) c(v w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1),

with weights that depend on the frequency bucket b of the context, ``floor(log2 c(v))``.  The
weights are learned by expectation-maximisation on held-out counts: a tenth of the learning
documents (the fold) is deleted from the counts, and its tokens are explained by the others.
Then the counts of all learning documents are used.

How it runs: a task turns its split into blocks.  A block numbers its distinct words and keeps its texts as a stream of
numbers, written once, so texts are read and split once.  Each block asks for the counts of its distinct
words and word pairs: sorted 64-bit hashes, each once per block whatever its frequency, cut
into shards by their leading bits.  A shard adds up the blocks' own counts and answers each block in
its order; block and answers meet again by block.  So a frequent word or pair costs one entry per block
and nothing is joined token by token.  The fold's documents are also kept as blocks of their own, over which
the weights are learned from a histogram of bounded size (ratios of the three estimates in steps of an eighth of an octave).

With larger executors ``block_bytes`` and ``shard_items`` may grow; the number of messages is blocks times shards.

Defined results: a null or empty text is one end token; a null id counts as the text ``''`` in the choice of
the fold; repeated rows are documents of their own; without learning documents only the uniform
part is left; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, landed, map_batches, mixed, total

END = b"\n"  # no word holds white space
BLOCK_BYTES, SHARD_ITEMS = 8 << 20, 2_000_000
BUCKETS, STEP, NONE = 64, 8, -(1 << 20)
STREAMS = "block long, fold boolean, n_tokens long, n_items long, docs binary, hashes binary, tokens binary"
STREAM_TYPES = [("block", pa.int64()), ("fold", pa.bool_()), ("n_tokens", pa.int64()), ("n_items", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary()), ("tokens", pa.binary())]
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("learn", "u1"), ("fold", "u1"), ("n", "<i4")])


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, plane by plane, so that leading zeros vanish."""
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers; the first one as it is."""
    return np.diff(x, prepend=np.uint64(0)) if len(x) else x


class Block:
    """Documents of a split until they make a block."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.number[END]
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc, crc: int, text: bytes) -> None:
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        words.append(END)
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words)))
        learn = crc % 10 != 0
        self.docs.append((doc or 0, doc is not None, learn, learn and crc // 10 % 10 == 0, len(words)))
        self.size += len(text) + 8

    def rows(self, block: int) -> Iterator[tuple]:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.number), dtype=np.uint64, count=len(self.number))
        docs, tokens = np.array(self.docs, dtype=DOC), np.concatenate(self.tokens)
        yield self.row(block, False, docs, hashes, tokens)
        fold = docs["fold"] == 1
        if fold.any():
            yield self.row(block, True, docs[fold], hashes, tokens[np.repeat(fold, docs["n"])])

    @staticmethod
    def row(block: int, fold: bool, docs: np.ndarray, hashes: np.ndarray, tokens: np.ndarray) -> tuple:
        used, tokens = np.unique(tokens, return_inverse=True)
        hashes, place = np.unique(hashes[used], return_inverse=True)
        tokens = place[tokens].astype("<u4")
        return block, fold, int(docs["n"][docs["learn"] == 1].sum()), len(tokens), docs.tobytes(), squeeze(steps(hashes)), squeeze(tokens)


def streams(df: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()

        def done() -> Iterator[pa.RecordBatch]:
            for row in block.rows(number):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, STREAM_TYPES)], names=[n for n, _ in STREAM_TYPES])

        for b in batches:
            for doc, crc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))):
                block.add(doc, crc, text)
                if block.size >= block_bytes:
                    yield from done()
                    number, block = number + 1, Block()
        if block.docs:
            yield from done()

    crc = F.crc32(F.coalesce(df[id_col].cast("string"), F.lit("")).cast("binary"))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), crc.alias("crc"), df[text_col].alias("text"))
    return landed(map_batches(rows, run, STREAMS), "lm-streams")


def parsed(docs: bytes, hashes: bytes, tokens: bytes):
    """Documents, ascending word hashes, tokens; distinct pairs in the order of their hashes, those hashes, and the pair of every token."""
    table = np.frombuffer(docs, dtype=DOC)
    words = np.cumsum(expand(hashes, "<u8"), dtype=np.uint64)
    now = expand(tokens, "<u4").astype(np.int64)
    end = int(now[-1])  # every document closes with the end token, which is also what comes ahead of the first word
    before = np.concatenate(([end], now[:-1]))
    codes, pair = np.unique(before * len(words) + now, return_inverse=True)
    left, right = codes // len(words), codes % len(words)
    h = mixed(words[left] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[right]))
    order = np.argsort(h)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return table, words, before, now, h[order], place[pair]


def asked(rows: DataFrame, n_shards: int) -> DataFrame:
    """Per shard and block the hashes of words (kind 1) and pairs (kind 2) with the block's own learning counts."""
    edges = np.array([(i << 64) // n_shards for i in range(n_shards)], dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                docs, words, _, now, pairs, pair = parsed(row["docs"], row["hashes"], row["tokens"])
                learn = np.repeat(docs["learn"] == 1, docs["n"])
                out = []
                for kind, hashes, which in ((1, words, now), (2, pairs, pair)):
                    own = np.bincount(which[learn], minlength=len(hashes)).astype("<u4")
                    cut = [*np.searchsorted(hashes, edges).tolist(), len(hashes)]
                    out += [
                        (s, kind, row["block"], row["fold"], squeeze(steps(hashes[a:z])), squeeze(own[a:z]))
                        for s, (a, z) in enumerate(zip(cut, cut[1:])) if z > a
                    ]
                types = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), types)], names=["shard", "kind", "block", "fold", "hashes", "own"]
                )

    return map_batches(rows, run, "shard int, kind int, block long, fold boolean, hashes binary, own binary")


ANSWERS = "block long, fold boolean, kind int, shard int, counts binary, n_seen long, n_seen_rest long"


def answered(table: pa.Table) -> pa.Table:
    """Counts for every block that asked one shard for one kind.  A fold gets the counts without the folds' own."""
    asks = table.to_pylist()
    hashes = [np.cumsum(expand(x["hashes"], "<u8"), dtype=np.uint64) for x in asks]
    own = [expand(x["own"], "<u4").astype(np.int64) for x in asks]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    places = np.split(at, cuts)
    counts, folds = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
    for x, place, n in zip(asks, places, own):  # a block's hashes are distinct
        (folds if x["fold"] else counts)[place] += n
    rest = counts - folds
    kind, shard = asks[0]["kind"], asks[0]["shard"]
    out = [(x["block"], x["fold"], kind, shard, squeeze((rest if x["fold"] else counts)[place].astype("<i8")), None, None) for x, place in zip(asks, places)]
    out.append((None, None, kind, shard, None, int((counts > 0).sum()), int((rest > 0).sum())))
    types = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    names = [c.split()[0] for c in ANSWERS.split(", ")]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)


class Counted:
    """A block with the counts that it asked for."""

    def __init__(self, stream: pa.Table, answers: pa.Table):
        row = stream.to_pylist()[0]
        self.docs, words, before, now, pairs, pair = parsed(row["docs"], row["hashes"], row["tokens"])
        parts = sorted(answers.select(["kind", "shard", "counts"]).to_pylist(), key=lambda x: (x["kind"], x["shard"]))
        word, couple = (np.concatenate([expand(x["counts"], "<i8") for x in parts if x["kind"] == k]) for k in (1, 2))
        self.context, self.word, self.pair = word[before], word[now], couple[pair]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def histogram(stream: pa.Table, answers: pa.Table, n: int, v: int) -> pa.Table:
    """Of a fold: tokens by bucket and by how far the estimates of order 2 and 1 lie above the uniform one."""
    c = Counted(stream, answers)
    scale = np.float64(v + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(c.pair > 0, np.round(STEP * np.log2(c.pair / np.maximum(c.context, 1) * scale)), NONE).astype(np.int64)
        one = np.where(c.word > 0, np.round(STEP * np.log2(c.word / max(n, 1) * scale)), NONE).astype(np.int64)
    rows, times = np.unique(np.column_stack([bucket(c.context), two, one]), axis=0, return_counts=True)
    return pa.table({"bucket": rows[:, 0], "two": rows[:, 1], "one": rows[:, 2], "n": times.astype(np.int64)})


def learn_weights(rows: np.ndarray, rounds: int = 60, prior: float = 0.5) -> np.ndarray:
    """Mixture weights (uniform, order 1, order 2) per bucket by expectation-maximisation.

    ``rows``: bucket, order 2 and order 1 above the uniform estimate in steps, tokens.  The prior keeps
    every order possible; buckets without tokens keep its even weights."""
    weights = np.full((BUCKETS, 3), 1.0 / 3)
    weights[0] = [0.5, 0.5, 0.0]  # an unknown context says nothing
    if not len(rows):
        return weights
    at, times = rows[:, 0], rows[:, 3].astype(np.float64)
    ratio = lambda x: np.where(x == NONE, 0.0, np.exp2(x / STEP))
    parts = np.column_stack([np.ones(len(rows)), ratio(rows[:, 2]), ratio(rows[:, 1])])
    floor = np.full((BUCKETS, 3), prior)
    floor[0, 2] = 0.0
    for _ in range(rounds):
        share = parts * weights[at]
        share *= (times / share.sum(axis=1))[:, None]
        sums = floor.copy()
        np.add.at(sums, at, share)
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(stream: pa.Table, answers: pa.Table, n: int, v: int, weights: np.ndarray) -> pa.Table:
    c = Counted(stream, answers)
    a = weights[bucket(c.context)]
    p = a[:, 0] / (v + 1) + a[:, 1] * c.word / max(n, 1) + a[:, 2] * c.pair / np.maximum(c.context, 1)
    base = np.log10((c.word + 0.1) / (n + 0.1 * (v + 1)))
    starts = np.concatenate(([0], np.cumsum(c.docs["n"], dtype=np.int64)[:-1]))
    sums = lambda x: np.add.reduceat(x, starts)
    return pa.table({
        "doc_id": pa.array(c.docs["id"], pa.int64(), mask=c.docs["known"] == 0), "held_out": c.docs["learn"] == 0,
        "n_tokens": c.docs["n"].astype(np.int64), "n_known": sums((c.word > 0).astype(np.int64)),
        "train_tokens": np.full(len(starts), n, dtype=np.int64), "base_score": sums(base), "score": sums(np.log10(p)),
    })


def score(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, add 0.1) and score of every text, as log10.

    The model learns from documents whose crc32 of the id, as text, is not divisible by 10.  Tokens are words
    with A-Z in small letters and one end per text.
    """
    rows = streams(df, id_col, text_col, block_bytes)
    n_shards = max(1, -(-total(rows, F.col("n_items")) // shard_items))
    found = landed(asked(rows, n_shards).groupBy("shard", "kind").applyInArrow(answered, ANSWERS), "lm-counts")
    seen = found.filter("block IS NULL AND kind = 1").agg(F.sum("n_seen"), F.sum("n_seen_rest")).first()
    sizes = rows.groupBy().agg(F.sum(F.when(~F.col("fold"), F.col("n_tokens"))), F.sum(F.when(F.col("fold"), F.col("n_tokens")))).first()
    n, v, v_rest = int(sizes[0] or 0), int(seen[0] or 0), int(seen[1] or 0)
    n_rest = n - int(sizes[1] or 0)

    def met(fold: bool, function, schema: str) -> DataFrame:
        pick = F.col("fold") == F.lit(fold)
        left, right = rows.filter(pick).groupBy("block"), found.filter(pick & F.col("block").isNotNull()).groupBy("block")
        return left.cogroup(right).applyInArrow(function, schema)

    counts = met(True, lambda s, a: histogram(s, a, n_rest, v_rest), "bucket long, two long, one long, n long")
    table = counts.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas().to_numpy(np.int64)
    weights = learn_weights(table)
    return met(False, lambda s, a: scored(s, a, n, v, weights), SCORES)
