"""Line deduplication by probing a sharded minimal perfect hash.

1. Every document gives its distinct long line keys as 128-bit hashes; a grouped
   count, combined on the map side, finds the keys of ``min_docs`` documents or more and
   the largest document that holds each.
2. These hashes are dealt to shards.  A shard becomes a minimal perfect hash: on each
   level the keys that meet no other key in a bit array get its bit, the rest go
   on to the next level, and the rank of a key's bit is its slot.  Slots index compact
   arrays of fingerprints (the second half of the hash), counts and keepers.
3. Documents probe the arrays.  Shards of at most ``broadcast_bytes`` together go to
   the tasks as they are, so texts are read once and never shuffled.  A larger index stays
   dealt out: hashes of lines go to the shards, packed per block of documents with each
   hash once, and only the hits come back.  Both ways give the same rows.

A frequent line costs one row per map task in step 1 and one per block in step 3.

Defined results: a null or empty text is one empty line; each row is a
document of its own, rows with the largest id all keep the line; a null id is below all
others; an empty table gives no rows; further columns pass through, and the operator's own
win over columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, SPACES, byte_texts, landed, map_batches, mixed, total, unused

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
STRIP = SPACES.encode()
KEYS_PER_SHARD = 1 << 20
BROADCAST_BYTES = 48 << 20
ASKED_BYTES = 64 << 20


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None for those that are too short to count."""
    out: list[bytes | None] = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(STRIP)
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key if long else None)
    return out


def hashes(keys: Iterable[bytes]) -> np.ndarray:
    """128-bit hashes as rows of two unsigned numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype="<u8").reshape(-1, 2)


@dataclass
class Shard:
    """Minimal perfect hash over the keys of one shard and the arrays that it indexes."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]  # size, bits, set bits ahead of each byte
    prints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @staticmethod
    def place(first: np.ndarray, level: int, size: int) -> np.ndarray:
        return mixed(first + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        """Equal first halves cannot be told apart by a level, so they are parted by the second half beforehand."""
        seeds, left = first ^ mixed(second), np.arange(len(first))
        levels, slots, taken = [], np.zeros(len(first), dtype=np.int64), 0
        while len(left):
            size = 2 * len(left) + 64
            at = cls.place(seeds[left], len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))[:-1] + taken
            levels.append((size, bits, ahead))
            placed = alone[at]
            slots[left[placed]] = cls.rank(levels[-1], at[placed])
            taken += int(alone.sum())
            left = left[~placed]
        order = np.argsort(slots)
        return cls(levels, second[order], counts[order], keepers[order])

    @staticmethod
    def rank(level, at: np.ndarray) -> np.ndarray:
        _, bits, ahead = level
        below = bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
        return ahead[at >> 3] + np.bitwise_count(below)

    def probe(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of every hash, -1 for those that are not in the shard."""
        seeds, slots, left = first ^ mixed(second), np.full(len(first), -1, dtype=np.int64), np.arange(len(first))
        for n, level in enumerate(self.levels):
            if not len(left):
                break
            at = self.place(seeds[left], n, level[0]).astype(np.int64)
            hit = (level[1][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            slots[left[hit]] = self.rank(level, at[hit])
            left = left[~hit]
        found = slots >= 0
        found[found] = self.prints[slots[found]] == second[found]
        return np.where(found, slots, -1)

    def pack(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), *[x[0] for x in self.levels]], dtype="<i8")
        return b"".join([head.tobytes(), *[x[1].tobytes() for x in self.levels], self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        n_levels, n = np.frombuffer(data, dtype="<i8", count=2).tolist()
        sizes = np.frombuffer(data, dtype="<i8", count=n_levels, offset=16).tolist()
        at, taken, levels = 16 + 8 * n_levels, 0, []
        for size in sizes:
            bits = np.frombuffer(data, dtype=np.uint8, count=(size + 7) // 8, offset=at)
            ahead = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))
            levels.append((size, bits, ahead[:-1] + taken))
            taken, at = taken + int(ahead[-1]), at + len(bits)
        columns = []
        for kind in ("<u8", "<i4", "<i8"):
            columns.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
            at += columns[-1].nbytes
        return cls(levels, *columns)


def line_hashes(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id) for the distinct long keys of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = [set(keys_of(x or b"", min_chars)) - {None} for x in part.column(1).cast(pa.binary()).to_pylist()]
                h = hashes(k for keys in found for k in keys)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].view(np.int64)), pa.array(h[:, 1].view(np.int64)), ids], names=["h1", "h2", "doc_id"]
                )

    return map_batches(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col]), run, "h1 long, h2 long, doc_id long")


def build_index(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per shard: shard, n_shards and data (a packed :class:`Shard`)."""
    repeated = line_hashes(df, id_col, text_col, min_chars).groupBy("h1", "h2").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("doc_id").alias("keeper")
    ).filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    repeated = landed(repeated, "line-counts")
    n_shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        shard = Shard.build(column("h1").view(np.uint64), column("h2").view(np.uint64), column("n"), column("keeper"))
        return pa.table({"shard": pa.array([column("shard")[0]], pa.int32()), "n_shards": pa.array([n_shards], pa.int32()), "data": pa.array([shard.pack()], pa.binary())})

    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int"))
    return landed(dealt.groupBy("shard").applyInArrow(run, "shard int, n_shards int, data binary"), "line-index")


def keep_lines(text: bytes, drop: np.ndarray) -> bytes:
    lines = text.split(b"\n")
    return b"\n".join([line for line, gone in zip(lines, drop.tolist()) if not gone])


def probe_all(shards: dict[int, Shard], n_shards: int, h: np.ndarray) -> np.ndarray:
    """The keeper of every hash that is in the index; rows of (found, keeper)."""
    out = np.zeros((len(h), 2), dtype=np.int64)
    home = h[:, 0].view(np.int64) % n_shards
    for s, shard in shards.items():
        at = np.flatnonzero(home == s)
        slots = shard.probe(h[at, 0], h[at, 1])
        hit = slots >= 0
        out[at[hit], 0] = 1
        out[at[hit], 1] = shard.keepers[slots[hit]]
    return out


def replaced(b: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added or replaced, in the order of the dict behind the kept ones."""
    kept = [n for n in b.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([b.column(n) for n in kept] + list(columns.values()), names=kept + list(columns))


def cleaned(b: pa.RecordBatch, id_at: str, text_at: str, min_chars: int, probe) -> pa.RecordBatch:
    """Drop the lines of a batch whose keys ``probe`` finds with another keeper."""
    ids, texts = b.column(id_at).cast(pa.int64()).to_pylist(), byte_texts(b.column(text_at))
    keys = [keys_of(x, min_chars) for x in texts]
    h = hashes(k for ks in keys for k in ks if k is not None)
    found, out, at = probe(h), {"text": [], "lines": [], "dropped": []}, 0
    for doc, text, ks in zip(ids, texts, keys):
        drop = np.zeros(len(ks), dtype=bool)
        long = [i for i, k in enumerate(ks) if k is not None]
        hits = found[at : at + len(long)]
        drop[long] = (hits[:, 0] == 1) & ((hits[:, 1] != doc) if doc is not None else True)
        at += len(long)
        out["text"].append(keep_lines(text, drop) if drop.any() else text)
        out["lines"].append(len(ks))
        out["dropped"].append(int(drop.sum()))
    return replaced(b, {
        text_at: pa.array(out["text"], pa.binary()).cast(pa.string()),
        "n_lines": pa.array(out["lines"], pa.int64()), "n_dropped": pa.array(out["dropped"], pa.int64()),
    })


def dedup_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5,
    broadcast_bytes: int = BROADCAST_BYTES, asked_bytes: int = ASKED_BYTES,
) -> DataFrame:
    """The input with repeated lines taken out of ``text_col``, n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends and with A-Z in small
    letters.  Keys of at least ``min_chars`` code points in at least ``min_docs``
    documents lose their lines everywhere but in the largest id.
    """
    own = {text_col, "n_lines", "n_dropped"}
    df = df.drop(*[c for c in ("n_lines", "n_dropped") if c in df.columns])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in own] + [f"`{text_col}` string, n_lines long, n_dropped long"])
    index = build_index(df, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    size = total(index, F.octet_length("data"))
    if size > broadcast_bytes:
        return probe_shards(df, index, schema, id_col, text_col, min_chars, asked_bytes)
    rows = index.collect()
    data = df.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["data"])) for r in rows])
    n_shards = rows[0]["n_shards"] if rows else 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {s: Shard.unpack(x) for s, x in data.value}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                yield cleaned(b.slice(lo, 512), id_col, text_col, min_chars, lambda h: probe_all(shards, n_shards, h))

    return map_batches(df, run, schema)


def probe_shards(df: DataFrame, index: DataFrame, schema: str, id_col: str, text_col: str, min_chars: int, asked_bytes: int = ASKED_BYTES) -> DataFrame:
    """The way for an index that is too large to send to every task.

    Documents are dealt to blocks.  A block sends each of its distinct hashes once to
    the hash's shard, the shard answers with the keepers of its hits, and
    the block takes its lines out.  All blocks ask every shard, so a shard's index goes to as many
    tasks as its questions need: some ``asked_bytes`` each.
    """
    n_shards = (index.first() or {"n_shards": 1})["n_shards"]
    n_blocks = max(1, -(-total(df, F.octet_length(text_col)) // (16 << 20)))
    mark = unused(df, "_block")
    blocked = df.withColumn(mark, F.pmod(F.xxhash64(id_col, text_col), F.lit(n_blocks)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        found = {k for x in byte_texts(table.column(text_col).combine_chunks()) for k in keys_of(x, min_chars)} - {None}
        h = np.unique(hashes(found), axis=0)
        home = h[:, 0].view(np.int64) % n_shards
        block = table.column(mark)[0].as_py()
        parts = [(s, block, np.ascontiguousarray(h[home == s]).tobytes()) for s in np.unique(home).tolist()]
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*parts)) or [[], [], []], (pa.int32(), pa.int32(), pa.binary()))], names=["shard", "block", "asked"])

    def answer(asked: pa.Table, data: pa.Table) -> pa.Table:
        shard = Shard.unpack(data.column("data")[0].as_py())
        out = []
        for block, x in zip(asked.column("block").to_pylist(), asked.column("asked").to_pylist()):
            h = np.frombuffer(x, dtype="<u8").reshape(-1, 2)
            slots = shard.probe(h[:, 0], h[:, 1])
            hit = slots >= 0
            rows = np.column_stack([h[hit].view(np.int64), shard.keepers[slots[hit]]])
            out.append((block, np.ascontiguousarray(rows).tobytes()))
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[], []], (pa.int32(), pa.binary()))], names=["block", "hits"])

    def take_out(docs: pa.Table, hits: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(hits.column("hits").to_pylist()), dtype="<i8").reshape(-1, 3)
        keeper = {(a, b): k for a, b, k in rows.tolist()}

        def probe(h: np.ndarray) -> np.ndarray:
            got = [keeper.get(tuple(x)) for x in h.view(np.int64).tolist()]
            return np.array([(x is not None, x or 0) for x in got], dtype=np.int64).reshape(-1, 2)

        batches = docs.drop_columns([mark]).to_batches(max_chunksize=512)
        done = [cleaned(b, id_col, text_col, min_chars, probe) for b in batches]
        return pa.Table.from_batches(done)

    asked = landed(blocked.select(mark, text_col).groupBy(mark).applyInArrow(ask, "shard int, block int, asked binary"), "asked")
    n_parts = max(1, -(-total(asked, F.octet_length("asked")) // (n_shards * asked_bytes)))
    questions = asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_parts)).cast("int"))
    indexes = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    hits = questions.groupBy("shard", "part").cogroup(indexes.groupBy("shard", "part")).applyInArrow(
        lambda a, d: answer(a, d) if a.num_rows and d.num_rows else pa.table({"block": pa.array([], pa.int32()), "hits": pa.array([], pa.binary())}),
        "block int, hits binary",
    )
    return blocked.groupBy(mark).cogroup(hits.groupBy("block")).applyInArrow(take_out, schema)


