"""Leak trends (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trends as tr
from ..plans import trend_report
from ..session import shared_folder
from . import sql as q
from . import views
from .base import query

_has = lambda text, words: "(" + " OR ".join(f"contains({text}, {q.quote(w)})" for w in words) + ")"
_is = lambda words: "(" + " OR ".join(f"list_contains(labels, {q.quote(w)})" for w in words) + ")"
_fv = tr.fv
_TYPED = f"""SELECT *, CASE WHEN {_has("array_to_string(labels, ' ')", _fv.SECURITY_WORDS)} OR {_has('lower(title)', _fv.SECURITY_WORDS)} THEN 'security'
    WHEN {_is(['bug'])} OR {_has('lower(title)', _fv.BUG_WORDS)} THEN 'bug'
    WHEN {_is(_fv.FEATURE_LABELS)} OR {_has('lower(title)', _fv.FEATURE_WORDS)} THEN 'feature'
    WHEN {_is(_fv.DOC_WORDS)} OR {_has('lower(title)', _fv.DOC_WORDS)} THEN 'documentation'
    WHEN {_is(_fv.QUESTION_LABELS)} OR contains(title, '?') THEN 'question' ELSE 'other' END AS issue_type FROM issues_meta"""


def _counted(spark, folder):
    leaks = tr.leaks_per_repo(views.issues_meta(spark, folder))
    return tr.repos_with_leak_counts(views.repos(spark, folder), leaks)


@query("I1_issue_type", q.with_views("issues_meta", "SELECT issue_id, issue_type FROM typed", typed=_TYPED))
def issue_type(spark, folder):
    return tr.add_issue_type(views.issues_meta(spark, folder)).select("issue_id", "issue_type")


@query("I2_issue_type_counts", q.with_views("issues_meta", """SELECT issue_type, count(*) AS n_issues,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM typed GROUP BY 1 ORDER BY 2 DESC, 1""", typed=_TYPED))
def issue_type_counts(spark, folder):
    counts = tr.issue_type_counts(tr.add_issue_type(views.issues_meta(spark, folder)))
    return counts.withColumn("percentage", F.round("percentage", 6))


def _buckets(column: str, bounds) -> str:
    names = ", ".join(f"({i}, {q.quote(n)}, {low}, {bounds[i + 1][0] if i + 1 < len(bounds) else '1e18'})" for i, (low, n) in enumerate(bounds))
    return f"""SELECT bucket_no, bucket, count(full_name) AS repo_count, count(*) FILTER (leaks > 0) AS repos_with_leaks,
        coalesce(sum(leaks), 0)::BIGINT AS total_leaks, coalesce(max(leaks), 0) AS max_leaks,
        round(coalesce(avg(leaks) FILTER (leaks > 0), 0), 6) AS avg_leaks_per_repo
        FROM (VALUES {names}) b(bucket_no, bucket, low, high) LEFT JOIN counted ON {column} >= low AND {column} < high GROUP BY 1, 2"""


def _round_avg(df):
    return df.withColumn("avg_leaks_per_repo", F.round("avg_leaks_per_repo", 6))


@query("I3_leaks_by_size", q.with_views("counted", _buckets("size_kb", _fv.SIZE_BUCKETS)))
def leaks_by_size(spark, folder):
    return _round_avg(tr.leaks_by_size(_counted(spark, folder)))


@query("I4_leaks_by_stars", q.with_views("counted", _buckets("stars", _fv.STAR_BUCKETS)))
def leaks_by_stars(spark, folder):
    return _round_avg(tr.leaks_by_stars(_counted(spark, folder)))


_SHARE = "SELECT bucket, CASE WHEN repo_count = 0 THEN 0 ELSE round(100.0 * repos_with_leaks / repo_count, 6) END AS leak_percentage FROM {}"


@query("I5_leak_share", q.with_views("counted", _SHARE.format("sizes") + " UNION ALL " + _SHARE.format("stars"),
                                     sizes=_buckets("size_kb", _fv.SIZE_BUCKETS), stars=_buckets("stars", _fv.STAR_BUCKETS)))
def leak_share(spark, folder):
    counted = _counted(spark, folder)
    both = tr.leaks_by_size(counted).unionByName(tr.leaks_by_stars(counted))
    return tr.leak_share(both).select("bucket", F.round("leak_percentage", 6).alias("leak_percentage"))


_YEAR = "SELECT year(created_at)::INT AS year, count(*) AS n_leaks FROM issues_meta GROUP BY 1"
_MONTH = "SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS n_leaks FROM issues_meta GROUP BY 1"
_QUARTER = "SELECT year(created_at) || '-Q' || quarter(created_at) AS quarter, count(*) AS n_leaks FROM issues_meta GROUP BY 1"


@query("I6_leaks_by_year", q.with_views("issues_meta", _YEAR))
def by_year(spark, folder):
    return tr.leaks_by_year(views.issues_meta(spark, folder))


@query("I7_leaks_by_month", q.with_views("issues_meta", _MONTH))
def by_month(spark, folder):
    return tr.leaks_by_month(views.issues_meta(spark, folder))


@query("I8_leaks_by_quarter", q.with_views("issues_meta", _QUARTER))
def by_quarter(spark, folder):
    return tr.leaks_by_quarter(views.issues_meta(spark, folder))


@query("I9_last_quarters", q.with_views("issues_meta", f"SELECT * FROM ({_QUARTER}) ORDER BY quarter DESC LIMIT 8"))
def last_quarters(spark, folder):
    return tr.last_quarters(tr.leaks_by_quarter(views.issues_meta(spark, folder)), 8)


@query("I9_years_from", q.with_views("issues_meta", f"SELECT * FROM ({_YEAR}) WHERE year >= 1996"))
def years_from(spark, folder):
    return tr.years_from(tr.leaks_by_year(views.issues_meta(spark, folder)), 1996)


_LANGUAGES = "SELECT coalesce(nullif(language, ''), 'Unknown') AS language, sum(leaks)::BIGINT AS leaks, count(*) AS repos FROM counted GROUP BY 1"


@query("I10_top_languages", q.with_views("counted", f"""SELECT 'leaks' AS ranked_by, * FROM (FROM ({_LANGUAGES}) ORDER BY leaks DESC, language LIMIT 15)
    UNION ALL SELECT 'repos', * FROM (FROM ({_LANGUAGES}) ORDER BY repos DESC, language LIMIT 15)"""))
def top_languages(spark, folder):
    totals = tr.language_totals(_counted(spark, folder))
    ranked = [tr.top_languages(totals, by).withColumn("ranked_by", F.lit(by)) for by in ("leaks", "repos")]
    return ranked[0].unionByName(ranked[1])


@query("I11_language_leak_rate", q.with_views("counted", f"SELECT *, round(leaks / repos, 6) AS leak_rate FROM ({_LANGUAGES}) ORDER BY leaks DESC, language LIMIT 10"))
def language_leak_rate(spark, folder):
    rates = tr.language_leak_rate(tr.language_totals(_counted(spark, folder)))
    return rates.withColumn("leak_rate", F.round("leak_rate", 6))


@query("I12_repo_profile", q.with_views("counted", """SELECT leaks > 0 AS has_leaks, count(*) AS n_repos, round(avg(stars), 6) AS avg_stars,
    round(avg(size_kb), 6) AS avg_size_kb, round(avg(forks), 6) AS avg_forks, round(100 * avg(is_fork::INT), 6) AS fork_pct,
    round(100 * avg(is_archived::INT), 6) AS archived_pct FROM counted GROUP BY 1"""))
def repo_profile(spark, folder):
    profile = tr.repo_profile(_counted(spark, folder))
    return profile.withColumns({c: F.round(c, 6) for c in profile.columns if c not in ("has_leaks", "n_repos")})


_SPANS = """SELECT *, epoch_us({until}) - epoch_us(created_at) AS us FROM issues_meta WHERE epoch_us({until}) > epoch_us(created_at)"""
_HOURS = lambda scale: ", ".join(
    f"round({e} / 3600e6 / {scale}, 6) AS {n}_{'hours' if scale == 1 else 'days'}"
    for n, e in (("avg", "avg(us)"), ("median", "percentile_disc(0.5) WITHIN GROUP (ORDER BY us DESC)"), ("min", "min(us)"), ("max", "max(us)")))


def _round_times(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith(("_hours", "_days", "_pct"))})


@query("I13_response_time", q.with_views("issues_meta", f"SELECT {_HOURS(1)}, count(*) AS n_spans FROM spans", spans=_SPANS.format(until="updated_at")))
def response_time(spark, folder):
    return _round_times(tr.response_time(views.issues_meta(spark, folder)))


@query("I14_close_time", q.with_views("issues_meta", f"""SELECT {_HOURS(1)}, count(*) AS closed_count,
    round(100.0 * count(*) / (SELECT count(*) FROM issues_meta), 6) AS closed_pct FROM spans""", spans=_SPANS.format(until="closed_at")))
def close_time(spark, folder):
    return _round_times(tr.close_time(views.issues_meta(spark, folder)))


@query("I15_times_in_days", q.with_views("issues_meta", f"SELECT {_HOURS(24)}, count(*) AS n_spans FROM spans", spans=_SPANS.format(until="updated_at")))
def times_in_days(spark, folder):
    return _round_times(tr.in_days(tr.response_time(views.issues_meta(spark, folder))))


@query("I16_summary", q.with_views("repos issues_meta", "SELECT (SELECT count(*) FROM repos) AS total_repos, (SELECT count(*) FROM issues_meta) AS total_issues"))
def summary(spark, folder):
    return tr.summary(views.repos(spark, folder), views.issues_meta(spark, folder))


_NUMBERS = {
    "summary": ("''", "SELECT (SELECT count(*) FROM repos) AS total_repos, (SELECT count(*) FROM issues_meta) AS total_issues"),
    "issue_types": ("issue_type", "SELECT issue_type, count(*) AS n_issues, 100.0 * count(*) / sum(count(*)) OVER () AS percentage FROM typed GROUP BY 1"),
    **{
        f"leak_by_{name}": ("bucket", f"SELECT *, CASE WHEN repo_count = 0 THEN 0 ELSE 100.0 * repos_with_leaks / repo_count END AS leak_percentage FROM ({_buckets(column, bounds)})")
        for name, column, bounds in (("size", "size_kb", _fv.SIZE_BUCKETS), ("stars", "stars", _fv.STAR_BUCKETS))
    },
    "by_year": ("year", _YEAR), "by_month": ("month", _MONTH), "by_quarter": ("quarter", _QUARTER),
    "languages_by_leaks": ("language", f"FROM ({_LANGUAGES}) ORDER BY leaks DESC, language LIMIT 15"),
    "languages_by_repos": ("language", f"FROM ({_LANGUAGES}) ORDER BY repos DESC, language LIMIT 15"),
    "repo_profile": ("has_leaks", """SELECT leaks > 0 AS has_leaks, count(*) AS n_repos, avg(stars) AS avg_stars, avg(size_kb) AS avg_size_kb,
        avg(forks) AS avg_forks, 100 * avg(is_fork::INT) AS fork_pct, 100 * avg(is_archived::INT) AS archived_pct FROM counted GROUP BY 1"""),
    "durations": ("kind", " UNION ALL ".join(f"""SELECT '{kind}' AS kind, {_HOURS(1)}, count(*) AS n_spans,
        100.0 * count(*) / (SELECT count(*) FROM issues_meta) AS pct_of_issues FROM ({_SPANS.format(until=until)})"""
        for kind, until in (("response", "updated_at"), ("close", "closed_at")))),
}
_COLUMNS = {
    "summary": ["total_repos", "total_issues"], "issue_types": ["n_issues", "percentage"],
    **dict.fromkeys(("leak_by_size", "leak_by_stars"), ["repo_count", "repos_with_leaks", "total_leaks", "max_leaks", "avg_leaks_per_repo", "leak_percentage"]),
    **dict.fromkeys(("by_year", "by_month", "by_quarter"), ["n_leaks"]),
    **dict.fromkeys(("languages_by_leaks", "languages_by_repos"), ["leaks", "repos"]),
    "repo_profile": ["n_repos", "avg_stars", "avg_size_kb", "avg_forks", "fork_pct", "archived_pct"],
    "durations": ["avg_hours", "median_hours", "min_hours", "max_hours", "n_spans", "pct_of_issues"],
}


def _unpivoted(name: str) -> str:
    """Every number of a section, a row each."""
    key, part = _NUMBERS[name]
    return " UNION ALL ".join(
        f"SELECT {q.quote(name)} AS section, ({key})::VARCHAR AS key, {q.quote(c)} AS name, round(({c})::DOUBLE, 6) AS value FROM ({part})" for c in _COLUMNS[name]
    )


@query("I17_full_report", q.with_views("issues_meta counted", " UNION ALL ".join(map(_unpivoted, _NUMBERS)), typed=_TYPED))
def full_report(spark, folder):
    """Writes every section and returns every number that was written."""
    path = shared_folder(spark, "report")
    names = trend_report.write_report(views.repos(spark, folder), views.issues_meta(spark, folder), path)
    result = None
    for name in names:
        written, key = spark.read.json(f"{path}/{name}"), _NUMBERS[name][0]
        numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in _COLUMNS[name]]))
        rows = written.select((F.lit("") if key == "''" else F.col(key).cast("string")).alias("key"), numbers.alias("n")).select(
            F.lit(name).alias("section"), "key", "n.name", F.round("n.value", 6).alias("value"))
        result = rows if result is None else result.unionByName(rows)
    return result
