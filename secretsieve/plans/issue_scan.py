"""Scan jobs: landed issues in, hits out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, relational
from ..operators.extract import Rule


def scan_issues(
    issues: DataFrame, skip: DataFrame | None = None, rules: list[Rule] | None = None,
    terms: list[str] | None = None, strict: bool = False,
) -> DataFrame:
    """First hit of every issue: keyword prefilter, scan, skip list, one row per URL; without bodies.

    ``issues`` needs url and body; the scan is a projection and only hits, which leave their bodies
    behind, reach a shuffle.
    """
    if terms:
        issues = relational.keyword_filter(issues, terms)
    hits = (extract.strict_scan if strict else extract.first_match_scan)(issues, rules).drop("body")
    if skip is not None:
        hits = relational.exclude_known(hits, skip, ["url"])
    return relational.first_per_url(hits, [F.col("issue_id")])


def keyword_yield(issues: DataFrame, terms: list[str], rules: list[Rule] | None = None, body: str = "body") -> DataFrame:
    """Which terms find issues, and hits, in one pass over the texts."""
    found = relational.add_terms(issues, terms, body).filter(F.size("terms") > 0)
    return relational.keyword_yield(extract.mark_hits(found, rules, body))


def scan_recent(
    issues: DataFrame, skip: DataFrame, rules: list[Rule] | None = None, per_repo: int = 20, per_issue: int = 10
) -> DataFrame:
    """All rules on the newest issues of every repository, at most ``per_issue`` hits each.

    The newest issues are chosen on narrow rows; bodies are joined once, with the chosen ids.
    """
    narrow = relational.only_issues(issues).select("repo", "created_at", "issue_id", "url")
    newest = relational.recent_issues(relational.exclude_known(narrow, skip, ["url"]), per_repo)
    chosen = issues.join(newest.select("issue_id"), "issue_id", "left_semi")
    return extract.pattern_flags(chosen, rules, per_issue=per_issue)
