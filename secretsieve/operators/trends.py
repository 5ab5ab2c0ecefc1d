"""Leak trends over repository and issue metadata.

``repos``: full_name, size_kb, stars, forks, language, is_fork, is_archived.
``issues``: repo_full_name, title, labels, created_at, updated_at, closed_at.
Every issue is a leak.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .evaluate import ratio
from ..session import land
from .selection import value_at_rank

MICROS_PER_HOUR = 3_600_000_000


# ------------------------------------------------------------------ issue types
def issue_type(title: Column, labels: Column) -> Column:
    """The first type whose words occur in the title or among the labels."""
    title = F.lower(F.coalesce(title, F.lit("")))
    labels = F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    in_title = lambda words: reduce(lambda a, b: a | b, [title.contains(w) for w in words])
    is_label = lambda words: F.arrays_overlap(labels, F.array(*[F.lit(w) for w in words]))
    joined = F.array_join(labels, " ")
    in_labels = lambda words: reduce(lambda a, b: a | b, [joined.contains(w) for w in words])
    return (
        F.when(in_labels(fv.SECURITY_WORDS) | in_title(fv.SECURITY_WORDS), "security")
        .when(is_label(["bug"]) | in_title(fv.BUG_WORDS), "bug")
        .when(is_label(fv.FEATURE_LABELS) | in_title(fv.FEATURE_WORDS), "feature")
        .when(is_label(fv.DOC_WORDS) | in_title(fv.DOC_WORDS), "documentation")
        .when(is_label(fv.QUESTION_LABELS) | title.contains("?"), "question")
        .otherwise("other")
    )


def add_issue_type(issues: DataFrame) -> DataFrame:
    return issues.withColumn("issue_type", issue_type(F.col("title"), F.col("labels")))


def issue_type_counts(typed: DataFrame) -> DataFrame:
    """Issues per type and their percentage, most frequent first."""
    counts = typed.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n_issues"))
    # Six rows at most.
    share = 100 * ratio(F.col("n_issues"), F.sum("n_issues").over(W.partitionBy(F.lit(0))))
    return counts.withColumn("percentage", share).orderBy(F.col("n_issues").desc(), "issue_type")


# ------------------------------------------------------------- leaks per bucket
def leaks_per_repo(issues: DataFrame) -> DataFrame:
    """One row per repository with issues.  Combined on the map side, so a hot
    repository is a few rows in the shuffle; every section below starts here."""
    return (
        issues.filter(F.coalesce(F.col("repo_full_name"), F.lit("")) != "")
        .groupBy(F.col("repo_full_name").alias("full_name"))
        .agg(F.count(F.lit(1)).alias("leaks"))
    )


def repos_with_leak_counts(repos: DataFrame, leaks: DataFrame) -> DataFrame:
    """Every repository with its number of leaks, 0 if it has none."""
    return repos.join(leaks, "full_name", "left").withColumn("leaks", F.coalesce("leaks", F.lit(0)))


def bucket_index(value: Column, bounds: list[tuple[int, str]]) -> Column:
    """Index of the last bucket whose lower bound is not above the value; NULL below all."""
    index = F.lit(None).cast("int")
    for i, (low, _) in enumerate(bounds):
        index = F.when(value >= low, i).otherwise(index)
    return index


def leaks_by_bucket(counted: DataFrame, value: str, bounds: list[tuple[int, str]]) -> DataFrame:
    """Per bucket: repositories, those with leaks, leaks in total, on average
    (over repositories with leaks) and at most.  Empty buckets show zeros."""
    n = F.col("leaks")
    found = (
        counted.withColumn("bucket_no", bucket_index(F.coalesce(F.col(value), F.lit(0)), bounds))
        .filter(F.col("bucket_no").isNotNull())
        .groupBy("bucket_no")
        .agg(
            F.count(F.lit(1)).alias("repo_count"), F.count_if(n > 0).alias("repos_with_leaks"),
            F.sum(n).alias("total_leaks"), F.max(n).alias("max_leaks"),
        )
    )
    names = counted.sparkSession.createDataFrame(
        [(i, name) for i, (_, name) in enumerate(bounds)], "bucket_no int, bucket string"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    # Both sides have a row per bucket.
    return (
        names.join(F.broadcast(found), "bucket_no", "left")
        .select("bucket_no", "bucket", *[zero(c) for c in ("repo_count", "repos_with_leaks", "total_leaks", "max_leaks")])
        .withColumn("avg_leaks_per_repo", ratio(F.col("total_leaks"), F.col("repos_with_leaks")))
    )


def leaks_by_size(counted: DataFrame) -> DataFrame:
    return leaks_by_bucket(counted, "size_kb", fv.SIZE_BUCKETS)


def leaks_by_stars(counted: DataFrame) -> DataFrame:
    return leaks_by_bucket(counted, "stars", fv.STAR_BUCKETS)


def leak_share(buckets: DataFrame) -> DataFrame:
    """Percentage of repositories with leaks per bucket."""
    return buckets.withColumn("leak_percentage", 100 * ratio(F.col("repos_with_leaks"), F.col("repo_count")))


# ------------------------------------------------------------------------- time
def _leaks_per(issues: DataFrame, name: str, period: Column) -> DataFrame:
    dated = issues.filter(F.col("created_at").isNotNull())
    return dated.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias("n_leaks"))


def leaks_by_year(issues: DataFrame) -> DataFrame:
    return _leaks_per(issues, "year", F.year("created_at"))


def leaks_by_month(issues: DataFrame) -> DataFrame:
    return _leaks_per(issues, "month", F.date_format("created_at", "yyyy-MM"))


def quarter_label(time: Column) -> Column:
    return F.concat(F.year(time).cast("string"), F.lit("-Q"), F.quarter(time).cast("string"))


def leaks_by_quarter(issues: DataFrame) -> DataFrame:
    return _leaks_per(issues, "quarter", quarter_label(F.col("created_at")))


def last_quarters(by_quarter: DataFrame, n: int = 8) -> DataFrame:
    return by_quarter.orderBy(F.col("quarter").desc()).limit(n)


def years_from(by_year: DataFrame, first: int = 2016) -> DataFrame:
    return by_year.filter(F.col("year") >= first)


# -------------------------------------------------------------------- languages
def language_totals(counted: DataFrame) -> DataFrame:
    """Leaks and repositories per language; a missing one is ``Unknown``."""
    language = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("Unknown"))
    return counted.groupBy(language.alias("language")).agg(
        F.sum("leaks").alias("leaks"), F.count(F.lit(1)).alias("repos")
    )


def top_languages(totals: DataFrame, by: str = "leaks", n: int = 15) -> DataFrame:
    return totals.orderBy(F.col(by).desc(), "language").limit(n)


def language_leak_rate(totals: DataFrame, n: int = 10) -> DataFrame:
    """Leaks per repository for the languages with most leaks."""
    return top_languages(totals, "leaks", n).withColumn("leak_rate", ratio(F.col("leaks"), F.col("repos")))


# --------------------------------------------------------------------- profiles
def repo_profile(counted: DataFrame) -> DataFrame:
    """Repositories with against without leaks."""
    share = lambda c: (100 * F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")))
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)))
    return counted.groupBy((F.col("leaks") > 0).alias("has_leaks")).agg(
        F.count(F.lit(1)).alias("n_repos"), mean("stars").alias("avg_stars"), mean("size_kb").alias("avg_size_kb"),
        mean("forks").alias("avg_forks"), share("is_fork").alias("fork_pct"), share("is_archived").alias("archived_pct"),
    )


# -------------------------------------------------------------------- durations
def durations(issues: DataFrame) -> DataFrame:
    """Microseconds from creation to last update (``response``) and to closing
    (``close``), one row each per issue; NULL unless positive."""
    span = lambda until: F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col(until))
    pairs = F.array(
        F.struct(F.lit("response").alias("kind"), span("updated_at").alias("micros")),
        F.struct(F.lit("close").alias("kind"), span("closed_at").alias("micros")),
    )
    spans = issues.select(F.explode(pairs).alias("_d")).select("_d.kind", "_d.micros")
    return spans.withColumn("micros", F.when(F.col("micros") > 0, F.col("micros")))


def duration_stats(issues: DataFrame, kind: str | None = None) -> DataFrame:
    """Average, upper median, least and most hours per kind (or of one kind), the count and its
    percentage of all issues.  The issues are read once; the rest reads landed spans."""
    spans = durations(issues)
    spans = land(spans if kind is None else spans.filter(F.col("kind") == kind), "spans")
    stats = spans.groupBy("kind").agg(
        F.avg("micros").alias("_avg"), F.min("micros").alias("_min"), F.max("micros").alias("_max"),
        F.count("micros").alias("n_spans"), F.count(F.lit(1)).alias("_issues"),
    ).filter("n_spans > 0")
    middle = stats.select("kind", (F.expr("n_spans div 2") + 1).alias("rank"))
    medians = value_at_rank(spans.filter("micros is not null"), "micros", middle, "kind")
    hours = lambda c: F.col(c) / MICROS_PER_HOUR
    return stats.join(medians, "kind").select(
        "kind", hours("_avg").alias("avg_hours"), hours("micros").alias("median_hours"),
        hours("_min").alias("min_hours"), hours("_max").alias("max_hours"), "n_spans",
        (100 * ratio(F.col("n_spans"), F.col("_issues"))).alias("pct_of_issues"),
    )


def response_time(issues: DataFrame) -> DataFrame:
    return duration_stats(issues, "response").drop("kind", "pct_of_issues")


def close_time(issues: DataFrame) -> DataFrame:
    return duration_stats(issues, "close").drop("kind").withColumnsRenamed(
        {"n_spans": "closed_count", "pct_of_issues": "closed_pct"}
    )


def in_days(stats: DataFrame) -> DataFrame:
    """The hour columns in days."""
    names = [c for c in stats.columns if c.endswith("_hours")]
    return stats.select(
        *[c for c in stats.columns if c not in names], *[(F.col(c) / 24).alias(c[:-5] + "days") for c in names]
    )


def summary(repos: DataFrame, issues: DataFrame) -> DataFrame:
    """Number of repositories and issues."""
    kinds = repos.select(F.lit("repo").alias("kind")).unionByName(issues.select(F.lit("issue").alias("kind")))
    return kinds.agg(
        F.count_if(F.col("kind") == "repo").alias("total_repos"), F.count_if(F.col("kind") == "issue").alias("total_issues")
    )
