"""A counting Bloom sketch of 64-bit hashes, merged from all tasks: which hashes may occur more than once.

The sketch is cut into segments; a hash chooses one segment and up to three cells in it.  A task counts its hashes and sends
each segment that it met the cells met once and those met more often; a segment adds its messages up, counts stop at two, and keeps one
bit a cell: met at least ``least`` times.  A hash all of whose cells are set may repeat; any other is certainly met
less often.  A message holds at least one hash, so messages never outnumber hashes.

Merged segments are broadcast as long as they take at most ``MAX_BROADCAST`` bytes.  A larger sketch stays dealt: the distinct hashes
go to their segments, and those that may repeat come back as a table.  Both ways read the same bits and give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed, map_batches, mixed

CELLS, CELLS_PER_HASH, PROBES = 1 << 16, 16, 3
MAX_BROADCAST = 64 << 20


def segments_for(hashes: int) -> int:
    """A power of two with some 16 cells for every hash."""
    return 1 << max(0, (max(1, hashes) * CELLS_PER_HASH - 1) // CELLS).bit_length()


def places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and cells (a row each) of hashes."""
    x = mixed(hashes.view(np.uint64))
    segment = (mixed(x ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(segments - 1)).astype(np.int64)
    cells = np.stack([(x >> np.uint64(16 * i)) & np.uint64(CELLS - 1) for i in range(PROBES)], axis=1).astype(np.int64)
    return segment, cells


def distinct_cells(segment: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """One number for every different cell of every hash."""
    cells = np.sort(cells, axis=1)
    fresh = np.concatenate((np.ones((len(cells), 1), dtype=bool), cells[:, 1:] != cells[:, :-1]), axis=1)
    return (segment[:, None] * CELLS + cells)[fresh]


def merged(df: DataFrame, column: str, segments: int, least: int = 2) -> DataFrame:
    """(segment, bits) of the segments with a cell that ``least`` (1 or 2) hashes of the column met, repeats counted."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[np.ndarray] = [np.empty(0, dtype=np.int64)]
        for b in batches:
            met.append(distinct_cells(*places(b.column(0).to_numpy(), segments)))
            if sum(map(len, met)) > 1 << 23:  # bounds the list; a cell counts up to two
                met = [np.repeat(*capped(met))]
        cell, n = capped(met)
        segment = cell // CELLS
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            inside, many = (cell[lo:hi] % CELLS).astype("<u2"), n[lo:hi] > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(segment[lo])], pa.int64()), pa.array([inside[~many].tobytes()]), pa.array([inside[many].tobytes()])],
                names=["segment", "once", "more"],
            )

    def add(messages: pa.Table) -> pa.Table:
        counts = np.zeros(CELLS, dtype=np.uint8)
        for once, more in zip(messages.column("once").to_pylist(), messages.column("more").to_pylist()):
            a, b = np.frombuffer(once, "<u2"), np.frombuffer(more, "<u2")
            counts[a] = np.minimum(counts[a] + 1, 2)
            counts[b] = 2
        bits = np.packbits(counts >= least, bitorder="little").tobytes()
        return pa.table({"segment": messages.column("segment")[:1], "bits": pa.array([bits])})

    sent = map_batches(df.filter(F.col(column).isNotNull()).select(column), count, "segment long, once binary, more binary")
    return sent.groupBy("segment").applyInArrow(add, "segment long, bits binary")


def capped(met: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    cell, n = np.unique(np.concatenate(met), return_counts=True)
    return cell, np.minimum(n, 2)


def set_in(bits: np.ndarray, at: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether all cells are set; ``bits``: bytes of segments, a row each; ``at``: the hash's row."""
    return ((bits[at[:, None], cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=1)


def finder(hashes: DataFrame, column: str, sketched: DataFrame, segments: int, max_broadcast: int = MAX_BROADCAST) -> Callable[[DataFrame, str], DataFrame]:
    """A function of a table and its hash column that keeps the rows whose hash has all its cells set (nulls go).
    ``hashes.column`` has all hashes that will be asked for."""
    sketched = landed(sketched, "sketch")
    if sketched.count() * CELLS // 8 <= max_broadcast:
        rows = sketched.collect()  # at most max_broadcast bytes
        bits = np.zeros((len(rows) + 1, CELLS // 8), dtype=np.uint8)  # the first one is empty
        row_of = np.zeros(segments, dtype=np.int32)
        for i, (segment, data) in enumerate(rows, 1):
            bits[i], row_of[segment] = np.frombuffer(data, np.uint8), i
        shared = hashes.sparkSession.sparkContext.broadcast((bits, row_of))

        @F.pandas_udf("boolean")
        def probe(asked: pd.Series) -> pd.Series:
            bits, row_of = shared.value
            segment, cells = places(asked.to_numpy(dtype=np.int64), segments)
            return pd.Series(set_in(bits, row_of[segment], cells))

        return lambda df, name: df.filter(F.col(name).isNotNull()).filter(probe(name))

    def segment_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places(b.column(0).to_numpy(), segments)[0])], names=["hash", "segment"])

    def ask(hashes: pa.Table, segment: pa.Table) -> pa.Table:
        asked = hashes.column("hash").to_numpy()
        if not segment.num_rows:
            return pa.table({"hash": pa.array([], pa.int64())})
        bits = np.frombuffer(segment.column("bits")[0].as_py(), np.uint8)[None, :]
        return pa.table({"hash": asked[set_in(bits, np.zeros(len(asked), dtype=np.int64), places(asked, segments)[1])]})

    distinct = hashes.select(F.col(column).alias("hash")).filter("hash IS NOT NULL").distinct()
    dealt = map_batches(distinct, segment_of, "hash long, segment long").groupBy("segment")
    found = landed(dealt.cogroup(sketched.groupBy("segment")).applyInArrow(ask, "hash long"), "repeats")
    return lambda df, name: df.join(found.withColumnRenamed("hash", name), name, "left_semi")
