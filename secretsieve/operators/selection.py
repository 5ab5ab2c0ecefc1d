"""Top rows per group and exact order statistics that survive hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 10_000
# A day count, then seconds within the day, then microseconds within the second.
TIME_STEPS = (86_400_000_000, 1_000_000, 1)


def top_k_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 1
) -> DataFrame:
    """The first ``k`` rows of every group, with their rank.

    ``order`` must be total within a group.  Spark keeps ``k`` rows per group
    on the map side (WindowGroupLimit).  For a large ``k`` and many map tasks,
    ``salts`` above 1 first cuts a group to ``k`` rows in each of ``salts`` sets of map tasks,
    so that the last task of a hot group gets ``salts * k`` rows; that is one more shuffle.
    """
    ranked = lambda rows, by: rows.withColumn(
        rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))
    ).filter(F.col(rank) <= k)
    if salts > 1:
        spread = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        df = ranked(spread, [*keys, "_salt"]).drop("_salt", rank)
    return ranked(df, keys)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per group: the first in ``order``.  The map side already reduces
    each group to one row, so a hot key costs one row per map task."""
    return top_k_per_group(df, keys, order, 1, rank="_rank", salts=1).drop("_rank")


def value_at_rank(
    df: DataFrame, value: str, ranks: DataFrame, group: str, steps: tuple[int, ...] = TIME_STEPS
) -> DataFrame:
    """The exact value at a 1-based rank, ascending, for every group.

    ``value`` is a non-negative long; ``ranks`` has one row (group, rank) per
    group.  The value is found digit by digit: each round
    counts the rows per digit (combined on the map side), finds the digit that
    holds the rank by a running sum over the short list of digits, and keeps
    only its rows.  No task ever sees the values of a whole group.  Every round reads ``df``:
    land its narrow columns first.  The list of groups is broadcast if it has at most
    ``MAX_BROADCAST_GROUPS`` rows, and joined as any table otherwise.
    """
    target = ranks.select(F.col(group).alias("_g"), F.col("rank").alias("_left"))
    few = target.limit(MAX_BROADCAST_GROUPS + 1).collect()
    small = len(few) <= MAX_BROADCAST_GROUPS
    if small:
        target = df.sparkSession.createDataFrame(few, target.schema)
    side = F.broadcast if small else lambda x: x
    parent = None
    for step in steps:
        digit = F.expr(f"`{value}` div {step}L").alias("_digit")
        if parent is None:
            rows = df.select(F.col(group).alias("_g"), digit).join(side(target), "_g")
        else:
            rows = df.select(F.col(group).alias("_g"), parent, digit).join(side(target), ["_g", "_base"])
        counts = rows.groupBy("_g", "_left", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        target = (
            counts.withColumn("_upto", F.sum("_n").over(W.partitionBy("_g").orderBy("_digit")))
            .filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
            .select("_g", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), F.col("_digit").alias("_base"))
        )
        parent = F.expr(f"`{value}` div {step}L").alias("_base")
    return target.select(F.col("_g").alias(group), (F.col("_base") * steps[-1]).alias(value))
