"""How five document filters interact, in every order in which they can run.

Filters: A too few words, B too few distinct words, C too many capitals, D forbidden characters, E a copy of
a document with a smaller id.  A document's failures are a mask of five bits; everything that the audit reports for all 120 orders is a sum
over the 32 masks of a part, so documents only have to be counted by (part, mask).

Copies: a counting Bloom sketch over text hashes, merged from all tasks, clears the texts that are certainly unique.  Only possible
repeats are shuffled, grouped by their full text with the least id, combined on the map side.  What goes back to the
documents is a digest (SHA-256) and that id.  The counts are additive: every document counts with its mask, and a
copy takes one from it and adds one to the mask with E.

Defined results: a null text is empty (and equal to the empty one); an empty text fails A and not B or C; a null id is larger than all others, so
null ids don't make each other copies; rows of one id don't either; of repeated labels an id is good or toxic if one of them says so, a null id has none; a null
part is the empty string; repeated rows count each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting_bloom
from .common import CAPITALS, byte_texts, landed, map_batches

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
FORBIDDEN = b"#$%&*|"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes that don't begin a character
COPY = 1 << FILTERS.index("E")


def failures(text: bytes) -> int:
    """The mask of A to D."""
    words = text.split()
    chars = len(text.translate(None, CONTINUATION))
    capitals = len(text) - len(text.translate(None, CAPITALS.encode()))
    return (
        (len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * chars) << 2 | (len(text.translate(None, FORBIDDEN)) < len(text)) << 3
    )


def flagged(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, mask of A to D, text hash and digest of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_texts(b.column(3))
            masks = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], masks, digests], names=["doc_id", "part", "hash", "mask", "digest"])

    rows = df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[part_col].cast("string"), F.lit("")).alias("part"),
        F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("hash"), df[text_col],
    )
    return map_batches(rows, run, "doc_id long, part string, hash long, mask int, digest binary")


def copies(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_broadcast: int) -> DataFrame:
    """The rows of ``docs`` (from :func:`flagged`) whose text a row with a smaller id has."""
    segments = counting_bloom.segments_for(docs.count())
    may_repeat = counting_bloom.finder(docs, "hash", counting_bloom.merged(docs, "hash", segments), segments, max_broadcast)
    text = F.coalesce(df[text_col], F.lit(""))
    texts = df.select(text.alias("text"), df[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))
    repeats = may_repeat(texts, "hash")
    exact = repeats.groupBy("text").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = landed(exact.select(F.unhex(F.sha2("text", 256)).alias("digest"), "first"), "firsts")
    return may_repeat(docs, "hash").join(firsts, "digest").filter("doc_id IS NULL OR doc_id > first").select("doc_id", "part", "mask")


def mask_counts(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    max_broadcast: int = counting_bloom.MAX_BROADCAST,
) -> DataFrame:
    """part, mask, n, good and toxic: documents by the set of filters that they fail."""
    docs = landed(flagged(df, id_col, text_col, part_col), "flags")
    again = landed(copies(df, docs, id_col, text_col, max_broadcast), "copies")
    signed = docs.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(
        again.select("doc_id", "part", F.explode(F.array(
            F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.lit(1).alias("n"))
        )).alias("x")).select("doc_id", "part", "x.mask", "x.n")
    )
    judged = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # One row for each id, part and mask of a task reaches the join.
    known = signed.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(judged, "doc_id", "left")
    return known.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, mask of the filters before it)."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, bit, before))
            before |= bit
    return out


def report(counts: DataFrame) -> DataFrame:
    """All orders and steps of every part, from counts by mask."""
    masks = range(1 << len(FILTERS))
    parts = counts.groupBy("part").agg(*[
        F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in masks]).alias(c) for c in ("n", "good", "toxic")
    ])
    # What is first among k failures in 120 orders: 120 / k of them.
    whole = 120
    by_filter = parts.select("*", *[
        F.array(*[
            sum((F.col("n")[m] * (whole // m.bit_count()) for m in masks if m >> f & 1), F.lit(0)) for f in range(len(FILTERS))
        ]).alias("shapleys")
    ])
    steps = ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'bit', {b}, 'before', {p}, 'place', {b.bit_length() - 1})" for o, s, b, p in orders())
    rows = by_filter.withColumn("x", F.explode(F.expr(f"array({steps})"))).select("*", "x.filter_order", "x.step", "x.bit", "x.before", "x.place")
    rows = rows.withColumn("masks", F.expr(f"sequence(0, {len(masks) - 1})"))
    total = lambda column, where: F.expr(f"aggregate(filter(masks, m -> {where}), 0L, (a, m) -> a + {column}[m])")
    here = "(m & bit) <> 0 AND (m & before) = 0"
    return rows.select(
        "part", "filter_order", "step", total("n", "(m & (before | bit)) = 0").alias("kept"), total("n", here).alias("removed"),
        total("n", "(m & bit) <> 0 AND (m & before) <> 0").alias("redundant"), total("n", "m = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.col("shapleys")[F.col("place")].alias("shapley"),
    )


def audit(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each part, order of the filters and step; ``options`` as for :func:`mask_counts`."""
    return report(landed(mask_counts(df, labels, **options), "masks"))
