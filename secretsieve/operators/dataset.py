"""Labelled data sets: splits, counts, weights, stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import land
from .selection import value_at_rank

SEED = 42
# 15 % test, then 11.8 % of the rest for validation.
TEST_SHARE, VALIDATION_SHARE = 0.15, 0.118
# 60 hash bits, 20 at a time.
HASH_STEPS = (1 << 40, 1 << 20, 1)


def seeded_hash(key: Column, seed: int = SEED, digits: int = 8) -> Column:
    """The first hex digits of ``md5(seed:key)`` as a number; equal on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, digits), 16, 10).cast("long")


def label_counts(df: DataFrame) -> DataFrame:
    """Rows with label 0 and 1, zero if there are none."""
    return df.agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))


def split_name(key: Column, seed: int = SEED) -> Column:
    """``test``, ``validation`` or ``train``, by the hash of the key."""
    share = seeded_hash(key, seed) / F.lit(float(1 << 32))
    return (
        F.when(share < TEST_SHARE, "test")
        .when(share < TEST_SHARE + (1 - TEST_SHARE) * VALIDATION_SHARE, "validation")
        .otherwise("train")
    )


def add_split(df: DataFrame, key: str = "issue_id", seed: int = SEED) -> DataFrame:
    """Split by the hash of a key.  Every class gets about the same shares, with
    no sort or shuffle, and a row keeps its part when others come or go.  With
    the real issue id as the key no issue is in two parts."""
    return df.withColumn("split", split_name(F.col(key), seed))


def add_exact_split(df: DataFrame, key: str = "issue_id", seed: int = SEED) -> DataFrame:
    """Split every class in exact sizes: the rows with the smallest hashes make
    the test part, the next the validation part.  ``key`` must be unique.

    The two bounds per class come from :func:`value_at_rank` over the landed hashes, so
    no class is ever sorted or held in one task and ``df`` is read twice.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(key), seed, 15))
    hashes = land(hashed.select("label", "_hash"), "hashes")
    sizes = (
        hashes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_test", F.ceil(F.col("n") * TEST_SHARE))
        .withColumn("n_validation", F.ceil((F.col("n") - F.col("n_test")) * VALIDATION_SHARE))
    )
    ranks = sizes.select(
        "label",
        F.explode(
            F.array(
                F.struct(F.lit("_t").alias("part"), F.col("n_test").alias("rank")),
                F.struct(F.lit("_v").alias("part"), (F.col("n_test") + F.col("n_validation")).alias("rank")),
            )
        ).alias("_x"),
    ).select(F.concat_ws("", "label", "_x.part").alias("_key"), F.col("_x.rank").alias("rank"))
    doubled = hashes.select(
        F.explode(F.array(F.concat_ws("", "label", F.lit("_t")), F.concat_ws("", "label", F.lit("_v")))).alias("_key"),
        "_hash",
    )
    bounds = (
        value_at_rank(doubled, "_hash", ranks, "_key", HASH_STEPS)
        .withColumn("_label", F.regexp_extract("_key", "^(.*)_[tv]$", 1))
        .groupBy("_label")
        .agg(
            F.max(F.when(F.col("_key").endswith("_t"), F.col("_hash"))).alias("_test"),
            F.max(F.when(F.col("_key").endswith("_v"), F.col("_hash"))).alias("_validation"),
        )
    )
    joined = hashed.join(bounds, F.col("label").cast("string") == F.col("_label"), "left")
    return joined.withColumn(
        "split",
        F.when(F.col("_hash") <= F.col("_test"), "test")
        .when(F.col("_hash") <= F.col("_validation"), "validation")
        .otherwise("train"),
    ).drop("_hash", "_label", "_test", "_validation")


def seeded_shuffle(df: DataFrame, key: str = "issue_id", seed: int = SEED) -> DataFrame:
    """All rows in an order that looks random and is equal on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key))


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in a stable order, for a trial run."""
    return df.orderBy(*order).limit(n)


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights ``n / (classes * n_class)``."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # One row per class.
    classes = W.partitionBy(F.lit(0))
    total, number = F.sum("n").over(classes), F.count(F.lit(1)).over(classes)
    return counts.select("label", "n", (total / (number * F.col("n"))).alias("weight"))


def label_distribution(df: DataFrame, group: str = "split") -> DataFrame:
    return df.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
