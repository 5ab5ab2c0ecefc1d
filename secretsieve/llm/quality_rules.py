"""Quality rules: plain text statistics and lines that a host repeats.

1. One pass over the texts gives each document's statistics and the hashes and word counts of
   its distinct normalised lines (A-Z in small letters, white space runs as one blank).
   This narrow table is written; texts are not read again for the verdict.
2. Per host and line, documents of distinct content are counted (exact copies count once).
   A line in more than ``min_docs`` of them is over the limit, however large the host is; ``max_share`` can lower the
   limit of small hosts to a share of their distinct documents.  Such a line stays in the host's least document that holds it and is removed from the others.
3. A document that loses so many words that less than ``min_left_share`` of them, or less than ``min_words``, are left is
   depleted and rejected.

All grouping is per line and host with map-side combining; the join of lines with those over
the limit may be skewed by a hot line of a hot host and is split by adaptive execution.

Defined results: null and empty texts have no words and fail the base rules; blank lines
are no lines; a null host is a host; repeated rows get a row each and count as one content; a null id is never the
one that keeps a line unless all are null (then all of them keep it); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, SPACES, byte_texts, landed, map_batches, unused

LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
SYMBOLS = b"#*$%&|<>"  # fixed value of the contract
NOT_WORD_CHARS = SPACES.encode() + bytes(range(0x80, 0xC0))  # white space and bytes inside a code point
WINDOW = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    # Exact codes: pairs of codes are renumbered until one code stands for a whole window.
    codes = ids
    for i in range(1, WINDOW):
        joined = codes[:-1] * len(number) + ids[i:]
        codes = np.unique(joined, return_inverse=True)[1]
    again = np.bincount(codes)[codes] > 1
    if not again.any():
        return 0
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def statistics(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words per line hash."""
    words = text.split()
    seen: set[bytes] = set()
    doubles, per_line = 0, {}
    small = text.translate(LOWER)
    for raw, line in zip(text.split(b"\n"), small.split(b"\n")):
        parts = line.split()
        if not parts:
            continue
        doubles += raw in seen
        seen.add(raw)
        key = xxhash.xxh3_64_intdigest(b" ".join(parts)) - (1 << 63)
        per_line[key] = per_line.get(key, 0) + len(parts)
    return (
        len(words), len(text.translate(None, NOT_WORD_CHARS)), len(text) - len(text.translate(None, SYMBOLS)),
        doubles, repeated_words(words), list(per_line), list(per_line.values()),
    )


FIELDS = [
    ("row", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("host", "string", pa.string()), ("content", "long", pa.int64()),
    ("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()), ("n_repeat_words", "long", pa.int64()),
    ("lines", "array<bigint>", pa.list_(pa.int64())), ("line_words", "array<int>", pa.list_(pa.int32())),
]


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The narrow table of step 1, written to the shared folder.  ``content`` is a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                found = [statistics(x) for x in byte_texts(b.column(2))]
                columns = [range(row, row + len(found)), b.column(0), b.column(1), b.column(3), *zip(*found)]
                row += len(found)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(columns, FIELDS)], names=[f[0] for f in FIELDS]
                )

    text = F.coalesce(df[text_col], F.lit(""))
    rows = df.select(df[id_col].cast("long").alias("doc_id"), df[host_col].cast("string").alias("host"), text.alias("text"), F.xxhash64(text).alias("content"))
    return landed(map_batches(rows, run, ", ".join(f"{n} {t}" for n, t, _ in FIELDS)), "quality")


def frequent_lines(docs: DataFrame, min_docs: int, max_share: float | None) -> DataFrame:
    """(host, line, keeper) for the lines over the limit."""
    contents = docs.groupBy("host", "content").agg(F.min("doc_id").alias("doc_id"), F.first("lines").alias("lines"))
    counts = contents.select("host", "doc_id", F.explode("lines").alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("keeper")
    )
    if max_share is None:
        return counts.filter(F.col("_n") > min_docs).select("host", "line", "keeper")
    limits = contents.groupBy("host").agg(F.count(F.lit(1)).alias("_docs")).select(
        F.col("host").alias("_h"), F.least(F.lit(float(min_docs)), F.col("_docs") * max_share).alias("_limit")
    )
    return counts.join(limits, F.col("host").eqNullSafe(F.col("_h"))).filter(F.col("_n") > F.col("_limit")).select("host", "line", "keeper")


def judge(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 20,
    max_share: float | None = None, min_words: int = 10, min_left_share: float = 0.3, max_repeat_percent: int = 20,
) -> DataFrame:
    """doc_id, content (hash of the text), the statistics, base_failed, removed (hashes of the lines to remove),
    n_left (words left), depleted and kept."""
    docs = measured(df, id_col, text_col, host_col)
    frequent = frequent_lines(docs, min_docs, max_share)
    lines = docs.select("row", "host", "doc_id", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", F.col("host").alias("_host"), "doc_id", F.col("l.lines").alias("_line"), F.col("l.line_words").alias("words")
    )
    lost = lines.join(frequent, F.col("_host").eqNullSafe(F.col("host")) & (F.col("_line") == F.col("line"))).filter(
        ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    ).groupBy("row").agg(F.sum("words").alias("_lost"), F.collect_set("line").alias("removed"))
    judged = docs.drop("lines", "line_words", "host").join(lost, "row", "left")
    n, left = F.col("n_words"), F.col("n_words") - F.coalesce("_lost", F.lit(0))
    return judged.select(
        "doc_id", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)).alias("base_failed"),
        "removed", left.alias("n_left"),
        (F.col("_lost").isNotNull() & ((left < min_words) | (left < min_left_share * n))).alias("depleted"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_lines(text: bytes, gone: set[int]) -> bytes:
    keep = []
    for raw, line in zip(text.split(b"\n"), text.translate(LOWER).split(b"\n")):
        if xxhash.xxh3_64_intdigest(b" ".join(line.split())) - (1 << 63) not in gone:
            keep.append(raw)
    return b"\n".join(keep)


def clean(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that are kept, with all columns, without their lines over the limit."""
    key, mark, gone = (unused(df, c) for c in ("_id", "_content", "_removed"))
    verdicts = judge(df, id_col=id_col, text_col=text_col, **settings).filter("kept").groupBy("doc_id", "content").agg(
        F.first("removed").alias(gone)
    ).withColumnRenamed("doc_id", key).withColumnRenamed("content", mark)
    content = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    rows = df.join(verdicts, df[id_col].cast("long").eqNullSafe(F.col(key)) & (content == F.col(mark))).drop(key, mark)
    columns, schema = df.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).cast(pa.binary()).to_pylist()
            new = [without_lines(x, set(g)) if g and x is not None else x for x, g in zip(texts, b.column(gone).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, pa.binary()).cast(pa.string()) if c == text_col else b.column(c) for c in columns], names=columns
            )

    return map_batches(rows, run, schema)
