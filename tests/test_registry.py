import os
import re

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries
from secretsieve.plans import trend_report
from secretsieve.registry import views

FOLDER = "/root/testdata/sf0.001"
# The text operators have tests of their own.
OWN = {n for n in queries() if re.match(r"op\d+_|pipeline$", n)}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(queries()) - set(oracle_sql()) <= OWN
    assert set(oracle_sql()) <= set(queries())


def test_every_group_is_covered():
    sizes = {"A": 9, "B": 13, "C": 5, "D": 9, "E": 16, "F": 14, "G": 7, "H": 16, "I": 17, "J": 5}
    names = " ".join(queries())
    for group, n in sizes.items():
        assert {int(x) for x in re.findall(rf"\b{group}(\d+)_", names)} == set(range(1, n + 1))


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"stage", "label", "n_rows"}


@pytest.mark.parametrize("name", sorted(set(queries()) - OWN))
def test_query_matches_its_check(spark, con, name):
    outcome, n, _, _ = compare.compare(spark, con, FOLDER, name)
    assert outcome == "ok", outcome


def test_report_sections_share_the_counts(spark):
    with trend_report.report_sections(views.repos(spark, FOLDER), views.issues_meta(spark, FOLDER)) as parts:
        total = parts["summary"].first()["total_repos"]
        assert sum(r["repo_count"] for r in parts["leak_by_stars"].collect()) == total
        assert sum(r["n_repos"] for r in parts["repo_profile"].collect()) == total


def test_report_reads_the_issues_once(spark):
    """All sections but those of repositories come from one aggregate over a narrow copy."""
    issues = views.issues_meta(spark, FOLDER)
    with trend_report.report_sections(views.repos(spark, FOLDER), issues) as parts:
        for part in parts.values():
            plan = part._jdf.queryExecution().optimizedPlan().toString()
            assert "orders" not in plan and "o_orderdate" not in plan
        months = parts["by_month"].agg({"n_leaks": "sum"}).first()[0]
        assert months == parts["by_year"].agg({"n_leaks": "sum"}).first()[0] == parts["summary"].first()["total_issues"]
