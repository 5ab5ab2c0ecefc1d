"""Joins, filters and de-duplication around an issue scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import once, text_array
from ..functions.terms import any_term, by_part
from .selection import keep_first, top_k_per_group


# ------------------------------------------------------------- shaping issues
def flatten_issues(issues: DataFrame) -> DataFrame:
    """Body never NULL, label names joined, owner and name from the repository URL."""
    parts = F.split(F.rtrim(F.col("repository_url"), F.lit("/")), "/")
    return (
        issues.withColumn("body", F.coalesce("body", F.lit("")))
        .withColumn("labels", F.array_join(F.transform("labels", lambda x: x.getField("name")), ", "))
        .withColumn("owner", F.try_element_at(parts, F.lit(-2)))
        .withColumn("name", F.try_element_at(parts, F.lit(-1)))
    )


def only_issues(issues: DataFrame, pull_request: str = "pull_request") -> DataFrame:
    """Without pull requests."""
    return issues.filter(F.col(pull_request).isNull())


def exclude_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``known`` (a skip list, or the output so far).

    The known keys are reduced to distinct ones first.  Which side moves is
    left to the planner: it broadcasts a list only if its size allows, and
    otherwise splits hot keys of the sort-merge join.
    """
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def clean_labelled(df: DataFrame) -> DataFrame:
    """Check the columns, drop rows without text, candidate or label, make the label an int.

    A label that is no finite number counts as missing.
    """
    needed = {"issue_id", "text", "candidate_string", "label"}
    missing = needed - set(df.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    number = F.expr("try_cast(label AS double)")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return (
        df.withColumn("label", finite.cast("int"))
        .dropna(subset=["text", "candidate_string", "label"])
    )


def as_text_table(df: DataFrame) -> DataFrame:
    """Candidate and body, the body named ``text``."""
    return df.select("candidate_string", F.col("body").alias("text"))


def union_parts(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def with_label_and_id(df: DataFrame, label: int, key: list[str]) -> DataFrame:
    """A constant label and an id made of the row's content, equal on every run."""
    content = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return df.withColumn("label", F.lit(label)).withColumn("issue_id", F.md5(content))


# ------------------------------------------------------------- de-duplication
def first_per_url(hits: DataFrame, order: list[Column], url: str = "url") -> DataFrame:
    return keep_first(hits, [url], order)


def first_pattern_per_candidate(candidates: DataFrame) -> DataFrame:
    """One row per issue and candidate, that of the first rule in the catalog."""
    return keep_first(candidates, ["issue_id", "candidate_string"], [F.col("pattern_rank")])


def recent_issues(
    issues: DataFrame, per_repo: int = fv.ISSUES_PER_REPO, repo: str = "repo", created: str = "created_at", tie: str = "issue_id"
) -> DataFrame:
    """The newest issues of each repository.  Filter pull requests and skipped
    issues first: they must not count."""
    return top_k_per_group(issues, [repo], [F.col(created).desc(), F.col(tie)], per_repo, rank="recency")


def cap_hits(flags: DataFrame, per_issue: int = fv.HITS_PER_ISSUE) -> DataFrame:
    """At most ``per_issue`` hits of an issue, in catalog order."""
    return top_k_per_group(flags, ["issue_id"], [F.col("pattern_rank")], per_issue, rank="hit_no", salts=1)


def join_issues(candidates: DataFrame, issues: DataFrame, key: str = "issue_id") -> DataFrame:
    """Candidates with the columns of their issue.  Pass the columns that are needed: what
    ``issues`` holds goes through the join."""
    return candidates.join(issues, key)


def flagged(predictions: DataFrame) -> DataFrame:
    """Rows predicted as secrets, for review."""
    return predictions.filter(F.col("prediction") == 1).select("issue_id", "text", "candidate_string")


# ------------------------------------------------------------ keyword prefilter
def _mentions(lowered: Column, terms: list[str]) -> Column:
    """Whether any term occurs.  A term that contains another one cannot change the outcome."""
    return lowered.rlike(any_term(terms))


def keyword_filter(issues: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """Issues whose body contains any term, ignoring case."""
    lowered = once(issues, "_low", F.lower(F.col(body)))
    return lowered.filter(_mentions(F.col("_low"), terms)).drop("_low")


def _contained(lowered: Column, terms: list[str]) -> Column:
    """The terms that occur.  Many terms share a part, and most parts are in no text: a term is looked for
    where a part of it of three letters and one of six are."""
    has = lambda part: F.contains(lowered, part)
    row = lambda part, **inner: F.struct(F.lit(part).alias("part"), *[c.alias(n) for n, c in inner.items()])
    groups = F.array(*[
        row(short, longer=F.array(*[row(part, terms=text_array(held)) for part, held in by_part(some, 6).items()]))
        for short, some in by_part(terms, 3).items()
    ])
    present = lambda parts, use: F.flatten(F.transform(F.filter(parts, lambda p: has(p["part"])), use))
    found = present(groups, lambda g: present(g["longer"], lambda p: F.filter(p["terms"], has)))
    return F.array_intersect(text_array(terms), found)  # in the order of the terms


def add_terms(issues: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """Add ``terms``: all terms that the body contains, ignoring case."""
    unique = list(dict.fromkeys(t.lower() for t in terms)) or [""]
    lowered = once(issues, "_low", F.lower(F.col(body)))
    return once(lowered, "terms", _contained(F.col("_low"), unique)).drop("_low")


def matched_terms(issues: DataFrame, terms: list[str], body: str = "body") -> DataFrame:
    """One row per issue and term that its body contains."""
    return add_terms(issues, terms, body).withColumn("term", F.explode("terms")).drop("terms")


def keyword_yield(marked: DataFrame) -> DataFrame:
    """Per term: issues that mention it and how many of them are hits.

    ``marked`` has ``terms`` and ``is_hit`` per issue; only counts are shuffled.
    """
    return marked.select(F.explode("terms").alias("term"), "is_hit").groupBy("term").agg(
        F.count(F.lit(1)).alias("n_issues"), F.count_if("is_hit").alias("n_hits")
    )
