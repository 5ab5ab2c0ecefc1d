"""Nearest neighbours on candidate features, by a sweep over ranges of (signature, entropy)."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.features import FLAG_COLUMNS
from ..session import land
from .selection import top_k_per_group

MICRO = 1_000_000
# Entropy is at most 21 bits a character (and 8 for single bytes), so a signature has some 640 ranges at most.
RANGE = 1 << 15
POINT = "struct<_key:string,label:int,_micro:bigint>"


def feature_vector(df: DataFrame) -> DataFrame:
    """A feature vector as the bits of its flags and the entropy in millionths."""
    bits = reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.shiftleft(F.col(name).cast("long"), i) for i, name in enumerate(FLAG_COLUMNS)],
    )
    return df.withColumn("_bits", bits).withColumn("_micro", F.round(F.col("entropy_value") * MICRO).cast("long"))


def _square(x: str) -> str:
    return f"({x}) * ({x})"


def asked_signatures(k: int) -> str:
    """The signatures of ``_all`` (bits, n, lo, hi) that can hold one of the ``k`` nearest points of (_own, _micro).

    A point of a signature lies between the bit distance with the nearer end of its entropies (or
    none, inside) and that with the farther end.  The signatures whose far ends come first and that
    hold ``k`` points together bound the distance of the k-th; whatever begins beyond it is out.
    """
    away = f"bit_count(_own ^ s.bits) * {MICRO * MICRO}L"
    far = f"{away} + {_square('greatest(abs(_micro - s.lo), abs(_micro - s.hi))')}"
    near = f"{away} + {_square('greatest(s.lo - _micro, _micro - s.hi, 0L)')}"
    by_far_end = f"array_sort(transform(_all, s -> struct({far} AS d, s.n AS n)))"
    bound = (
        f"aggregate({by_far_end}, struct(0L AS n, CAST(NULL AS BIGINT) AS d),"
        f" (a, s) -> IF(a.n >= {k}, a, struct(a.n + s.n AS n, s.d AS d)), a -> a.d)"
    )
    return f"transform(filter(transform(_all, s -> struct(s.bits AS bits, {near} AS d)), s -> s.d <= {bound}), s -> s.bits)"


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str = "id", k: int = 5) -> DataFrame:
    """Majority label of the ``k`` nearest training rows (squared distance, then key); null without training rows.

    The flags of a vector form a signature, and its entropy is the one real number.  Within a signature
    the nearest rows are the closest entropies, which running windows find without any pairs:

    * training: at most ``k`` rows per distinct vector can matter (lowest keys);
    * test: distinct vectors only, in the signatures that can hold a neighbour;
    * signature and entropy are cut into ranges of ``RANGE`` millionths.  A range gets the last ``k`` points below
      it and the first ``k`` above it as guests, so a window holds one range, whatever the size of its signature;
    * per range the ``k`` closest entropies from below and from above, then the best ``k`` over all signatures.

    What is kept per signature are its extent and ``2 * k`` points a range, a short list; a table of the
    signatures (at most 2 to the number of flags) is one value of the plan.
    """
    points = top_k_per_group(
        feature_vector(train).select(F.col(key).cast("string").alias("_key"), F.col("label").cast("int"), "_bits", "_micro"),
        ["_bits", "_micro"], [F.col("_key")], k,
    ).select("_bits", "_micro", F.expr(f"_micro div {RANGE}").alias("_range"), "_key", "label")
    vectors = feature_vector(test)
    # Neither needs the other, and features are computed once for each.
    with ThreadPool(2) as pool:
        points, asking = pool.starmap(inheritable_thread_target(train.sparkSession)(land), [
            (points, "points"), (vectors.select(F.col("_bits").alias("_own"), "_micro").distinct(), "probes"),
        ])
    extent = points.groupBy("_bits").agg(F.count(F.lit(1)).alias("n"), F.min("_micro").alias("lo"), F.max("_micro").alias("hi"))
    table = extent.agg(F.collect_list(F.struct(F.col("_bits").alias("bits"), "n", "lo", "hi")).alias("_all"))
    probes = (
        asking.withColumn("_all", table.scalar()).select("_own", "_micro", F.explode(F.expr(asked_signatures(k))).alias("_bits"))
        .withColumn("_range", F.expr(f"_micro div {RANGE}"))
    )
    asked = probes.select("_bits", "_range").distinct()
    own = F.struct("_key", "label", "_micro").alias("_point")
    # The k points at either end of every range; equal entropies by key.
    ends = top_k_per_group(points, ["_bits", "_range"], [F.col("_micro").desc(), F.col("_key")], k, rank="_from_top").select(
        "_bits", "_range", own, F.lit(True).alias("_top")
    ).unionByName(top_k_per_group(points, ["_bits", "_range"], [F.col("_micro"), F.col("_key")], k, rank="_from_low").select(
        "_bits", "_range", own, F.lit(False).alias("_top")
    ))
    lists = ends.groupBy("_bits").agg(F.collect_list(F.struct("_range", "_top", "_point")).alias("_ends"))
    point = "e._point"
    guests = f"""flatten(array(
        slice(array_sort(transform(filter(_ends, e -> e._range < _range AND e._top), e -> struct(-{point}._micro AS m, {point}._key AS k, {point} AS p))), 1, {k}),
        slice(array_sort(transform(filter(_ends, e -> e._range > _range AND NOT e._top), e -> struct({point}._micro AS m, {point}._key AS k, {point} AS p))), 1, {k})))"""
    carried = asked.join(lists, "_bits").select("_bits", "_range", F.explode(F.expr(guests)).alias("g")).select(
        "_bits", "_range", F.col("g.p").alias("_point")
    )
    held = points.join(asked, ["_bits", "_range"], "left_semi").select("_bits", "_range", own).unionByName(carried)
    held = held.select("_bits", "_range", "_point", F.col("_point._micro").alias("_micro"), F.col("_point._key").alias("_key"))

    # In both directions the rows a probe may use come before it, the closest last.
    by_range, is_probe = W.partitionBy("_bits", "_range"), F.col("_own").isNotNull().cast("int")
    ways = {"_below": F.col("_micro"), "_above": F.col("_micro").desc()}
    none, many = F.lit(None), f"array<{POINT}>"
    chains = held.withColumns({
        name: F.collect_list("_point").over(by_range.orderBy(way, F.col("_key").desc()).rowsBetween(1 - k, 0)) for name, way in ways.items()
    }).drop("_point").withColumn("_own", none.cast("long"))
    rows = chains.unionByName(probes.select(
        "_bits", "_range", "_micro", none.cast("string").alias("_key"), none.cast(many).alias("_below"), none.cast(many).alias("_above"), "_own",
    ))
    found = rows.withColumns({
        name: F.last(name, ignorenulls=True).over(by_range.orderBy(way, is_probe, F.col("_key").desc()).rowsBetween(W.unboundedPreceding, 0))
        for name, way in ways.items()
    }).filter(F.col("_own").isNotNull())
    gap = F.col("_n._micro") - F.col("_micro")
    distance = F.bit_count(F.col("_own").bitwiseXOR(F.col("_bits"))).cast("long") * (MICRO * MICRO) + gap * gap
    empty: Column = F.array().cast(many)
    options = (
        found.withColumn("_n", F.explode(F.array_union(F.coalesce("_below", empty), F.coalesce("_above", empty))))
        .select("_own", "_micro", distance.alias("_distance"), F.col("_n._key").alias("_key"), F.col("_n.label").alias("_label"))
    )
    best = top_k_per_group(options, ["_own", "_micro"], [F.col("_distance"), F.col("_key")], k)
    votes = best.groupBy(F.col("_own").alias("_bits"), "_micro").agg(
        (2 * F.sum("_label") > F.count(F.lit(1))).cast("int").alias("prediction")
    )
    return vectors.join(votes, ["_bits", "_micro"], "left").drop("_bits", "_micro")
