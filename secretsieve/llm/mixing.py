"""Mixing sources to target weights by capped water-filling.

The mix shares a budget of words among sources in proportion to their weights.  A
source whose share would exceed ``epochs`` times its size is clamped there, and
what it leaves is shared again among the others, until no share is above.
A source takes every document as often as its target holds it wholly; the rest of
the target goes to documents in the order of a seeded hash, and the document in which
the rest runs out gives its first words only.  So the words taken equal the target,
rounded, whatever the sizes of the documents.

Work: up to ``MAX_BROADCAST_SOURCES`` sources reach the driver, a row each, and go back to the documents as a broadcast; more
stay a table, whose level comes from running sums over ranges of the sources in the order in which they reach their caps.
The place where the rest runs out comes from word counts per source and bucket
of the hash, summed on the map side, so no task sorts a whole source;
only the rows of the bucket in question are shuffled and ordered, one of ``BUCKETS`` parts of the source.

Defined results: null texts have no words; a null source is the last one; repeated
rows are documents of their own, and rows with the same id and size are interchangeable; sources without words get target 0; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import landed

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1 << 14
MAX_BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    """Words of a text.  Runs are replaced before counting, so no list of words is built."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    parts = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.when(n <= 0, "").otherwise(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""))


def water_fill(sizes: Sequence[int], weights: Sequence[float], budget: float, epochs: float) -> list[float]:
    """Shares of the budget: proportional to the weights, none above epochs x size.

    Sources reach their caps in the order of cap by weight; the first one that does not gives the level for all behind it."""
    order = sorted(range(len(sizes)), key=lambda i: epochs * sizes[i] / weights[i])
    capped, free, unit = 0, math.fsum(weights), 0.0
    target = [float(epochs * n) for n in sizes]
    for k, i in enumerate(order):
        unit = max(0.0, budget - epochs * capped) / free
        if weights[i] * unit < epochs * sizes[i]:
            for j in order[k:]:
                target[j] = weights[j] * unit
            break
        capped, free = capped + sizes[i], free - weights[i]
    return target


def drawn(df: DataFrame, text_col: str, id_col: str, seed: int) -> DataFrame:
    """Add the size, the seeded draw and its bucket."""
    df = df.withColumn("_size", n_words(F.col(text_col))) if text_col else df
    key = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("_size").cast("string"))
    df = df.withColumn("_draw", F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"))
    return df.withColumn("_bucket", F.pmod("_draw", F.lit(BUCKETS)))


def targets(rows: DataFrame, weights: Sequence[float], share: float, epochs: int, max_sources: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """One row per source: size, target, whole repetitions, and where the rest of the target runs out.

    ``rows`` has source, _size and _bucket.  Documents of buckets below ``_edge`` give one repetition more; those of the edge
    bucket share ``_left`` words.
    """
    sums = landed(rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_words")), "source-buckets")
    sizes = sums.groupBy("source").agg(F.sum("_words").alias("n"))
    found = sizes.limit(max_sources + 1).collect()
    few = len(found) <= max_sources
    if few:
        found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        n = [int(r["n"]) for r in found]
        shares = water_fill(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), epochs)
        table = rows.sparkSession.createDataFrame([(r["source"], k, t) for r, k, t in zip(found, n, shares)], "_source string, source_size long, target double")
    else:
        table = level_in_tables(sizes, weights, share, epochs)
    n, target = F.col("source_size"), F.col("target")
    whole = F.when(n > 0, F.least(F.lit(epochs), F.floor(target / n))).otherwise(0).cast("int")
    table = table.withColumn("whole", whole).withColumn("_rest", half_even(target - F.col("whole") * n))
    table = F.broadcast(table) if few else landed(table, "targets")
    upto = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    edges = (
        sums.withColumn("_upto", F.sum("_words").over(upto)).join(table, F.col("source").eqNullSafe(F.col("_source")))
        .filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_words") < F.col("_rest")))
        .select(F.col("source").alias("_s"), F.col("_bucket").alias("_edge"), (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("_left"))
    )
    out = landed(
        table.join(edges, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
            "_source", "source_size", "target", "whole", F.coalesce("_edge", F.lit(-1)).alias("_edge"), F.coalesce("_left", F.lit(0)).alias("_left")
        ), "targets",
    )
    return F.broadcast(out) if few else out


def half_even(x: Column) -> Column:
    """Rounded to a whole number, a half to the even one."""
    return F.bround(x).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add ``_place`` (from 0) in the order, and the sums over all rows ahead.

    Ranges of the order are summed apart; a number a range and sum reaches the driver."""
    spread = landed(df.orderBy(*order).withColumns({f"_v{i}": x for i, x in enumerate(sums.values())}).withColumn("_range", F.spark_partition_id()), "ranges")
    names = [*sums, "_place"]
    values = [*[F.col(f"_v{i}") for i in range(len(sums))], F.lit(1)]
    heads = spread.groupBy("_range").agg(*[F.sum(v).alias(n) for n, v in zip(names, values)]).orderBy("_range").collect()
    ahead, total = [], [0] * len(names)
    for r in heads:
        ahead.append((r["_range"], *total))
        total = [a + b for a, b in zip(total, r[1:])]
    # As the sums, which may be whole or not.
    ahead = [(r, *[type(x)(a) for a, x in zip(values, total)]) for r, *values in ahead]
    starts = df.sparkSession.createDataFrame(ahead, "_range int, " + ", ".join(f"_a{i} {'double' if isinstance(x, float) else 'long'}" for i, x in enumerate(total)))
    before = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = spread.join(F.broadcast(starts), "_range")
    added = {n: F.col(f"_a{i}") + F.coalesce(F.sum(v).over(before), F.lit(0)) for i, (n, v) in enumerate(zip(names, values))}
    return rows.withColumns(added).select(*df.columns, *names)


def level_in_tables(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """:func:`water_fill` without the driver."""
    named = running(sizes, [F.asc_nulls_last("source")], {})
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("_place") % len(weights)).cast("int")]
    weighed = landed(named.select("source", "n", weight.alias("w")), "weights")
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    order = [epochs * F.col("n") / F.col("w"), F.asc_nulls_last("source")]
    filled = running(weighed, order, {"_capped": F.col("n"), "_used": F.col("w")})
    unit = F.greatest(F.lit(0.0), F.lit(share * total["n"]) - epochs * F.col("_capped")) / (F.lit(total["w"]) - F.col("_used"))
    level = filled.withColumn("unit", unit).filter(F.col("w") * F.col("unit") < epochs * F.col("n")).agg(
        F.min("_place").alias("at"), F.min_by("unit", "_place").alias("unit")
    ).first()
    cap = (epochs * F.col("n")).cast("double")
    target = cap if level["at"] is None else F.when(F.col("_place") < level["at"], cap).otherwise(F.col("w") * level["unit"])
    return filled.select(F.col("source").alias("_source"), F.col("n").alias("source_size"), target.alias("target"))


def with_part(rows: DataFrame, table: DataFrame, source_col: str, id_col: str) -> DataFrame:
    """Add the source's target, whole repetitions, and ``part``, the words of one more.

    Only rows of the edge buckets are shuffled and ordered."""
    rows = rows.join(table, F.col(source_col).eqNullSafe(F.col("_source")))
    inside = F.col("_bucket") == F.col("_edge")
    others = rows.filter(~inside).withColumn("part", F.when(F.col("_bucket") < F.col("_edge"), F.col("_size")).otherwise(F.lit(0)).cast("long"))
    before = W.partitionBy("_source").orderBy("_draw", id_col, "_size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_left") - F.coalesce(F.sum("_size").over(before), F.lit(0))
    edge = rows.filter(inside).withColumn("part", F.greatest(F.lit(0), F.least(F.col("_size"), left)).cast("long"))
    return others.unionByName(edge)


def plan(
    df: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, epochs: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, max_sources: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), whole (repetitions),
    part (words of one more, partial or whole) and taken (words in all).

    ``weights`` go to the sources in code-point order, null last, and repeat.
    """
    # Texts are read once; everything below works on narrow rows.
    rows = landed(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), n_words(df[text_col]).alias("_size")), "word-counts")
    rows = drawn(rows, "", "doc_id", seed)
    table = targets(rows, weights, share, epochs, max_sources)
    return with_part(rows, table, "source", "doc_id").select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "whole", "part",
        (F.col("whole") * F.col("_size") + F.col("part")).cast("long").alias("taken"),
    )


def mix(
    df: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, epochs: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, max_sources: int = MAX_BROADCAST_SOURCES,
) -> DataFrame:
    """The documents that the mix is made of, with all columns of the input: every document
    as often as :func:`plan` takes it, a partial repetition with its first words only."""
    # Columns of the input may bear the names that are added here.
    own = [f.alias(f"_in{i}") for i, f in enumerate(df[c] for c in df.columns)]
    name = {c: f"_in{i}" for i, c in enumerate(df.columns)}
    # Words are counted once, and the texts written with their counts.
    inner = landed(drawn(df.select(*own), name[text_col], name[id_col], seed), "counted")
    table = targets(inner.select(F.col(name[source_col]).alias("source"), "_size", "_bucket"), weights, share, epochs, max_sources)
    rows = with_part(inner, table, name[source_col], name[id_col])
    copies = F.concat(
        F.array_repeat(F.col("_size"), F.col("whole")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")),
    )
    out = rows.withColumn("_take", F.explode(copies))
    text = F.col(name[text_col])
    cut = F.when(F.col("_take") < F.col("_size"), first_words(text, F.col("_take"))).otherwise(text)
    return out.withColumn(name[text_col], cut).select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)])
