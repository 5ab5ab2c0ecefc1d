"""The whole trend report."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import trends
from ..operators.evaluate import ratio
from ..session import land


def narrow_issues(issues: DataFrame) -> DataFrame:
    """What the report needs of an issue, without its texts, landed: the only time that the issues are read."""
    typed = trends.add_issue_type(issues)
    return land(typed.select("repo_full_name", "issue_type", "created_at", "updated_at", "closed_at"), "report-issues")


def period_cube(narrow: DataFrame) -> DataFrame:
    """One aggregate for the counts by type, year, month and quarter and the total: a row per group, with the name of its
    ``section`` (NULL keys but that of the section)."""
    keys = {
        "issue_types": F.col("issue_type"), "by_year": F.year("created_at"), "by_month": F.date_format("created_at", "yyyy-MM"),
        "by_quarter": trends.quarter_label(F.col("created_at")),
    }
    rows = narrow.select(*[k.alias(name) for name, k in keys.items()])
    sets = [[F.col(name)] for name in keys] + [[]]
    section = F.coalesce(*[F.when(F.grouping(name) == 0, F.lit(name)) for name in keys], F.lit("total"))
    cube = rows.groupingSets(sets, *[F.col(name) for name in keys]).agg(F.count(F.lit(1)).alias("n"), section.alias("section"))
    return land(cube, "report-periods")


@contextmanager
def report_sections(repos: DataFrame, issues: DataFrame):
    """All sections by name, while the leaks per repository stay persisted.

    The persisted table is one narrow row per repository; a lost block is
    computed again from the sources.
    """
    narrow = narrow_issues(issues)
    counted = trends.repos_with_leak_counts(repos, trends.leaks_per_repo(narrow)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield sections(counted, narrow)
    finally:
        counted.unpersist()


def sections(counted: DataFrame, narrow: DataFrame) -> dict[str, DataFrame]:
    totals, cube = trends.language_totals(counted), period_cube(narrow)
    part = lambda name: cube.filter((F.col("section") == name) & F.col(name).isNotNull())
    period = lambda name, key: part(name).select(F.col(name).alias(key), F.col("n").alias("n_leaks"))
    whole = cube.filter("section = 'total'").select(F.col("n").alias("_all"))
    types = part("issue_types").select(F.col("issue_types").alias("issue_type"), F.col("n").alias("n_issues"))
    return {
        # Aggregates without groups have one row each.
        "summary": counted.agg(F.count(F.lit(1)).alias("total_repos")).withColumn(
            "total_issues", F.coalesce(whole.agg(F.sum("_all")).scalar(), F.lit(0))),
        "issue_types": types.withColumn("percentage", 100 * ratio(F.col("n_issues"), whole.scalar())).orderBy(F.col("n_issues").desc(), "issue_type"),
        "leak_by_size": trends.leak_share(trends.leaks_by_size(counted)),
        "leak_by_stars": trends.leak_share(trends.leaks_by_stars(counted)),
        "by_year": period("by_year", "year"),
        "by_month": period("by_month", "month"),
        "by_quarter": period("by_quarter", "quarter"),
        "languages_by_leaks": trends.top_languages(totals, "leaks"),
        "languages_by_repos": trends.top_languages(totals, "repos"),
        "repo_profile": trends.repo_profile(counted),
        "durations": trends.duration_stats(narrow),
    }


def write_report(repos: DataFrame, issues: DataFrame, path: str) -> list[str]:
    """Every section as JSON lines in a folder of its own."""
    with report_sections(repos, issues) as parts:
        for name, part in parts.items():
            part.write.mode("overwrite").json(f"{path}/{name}")
        return list(parts)
