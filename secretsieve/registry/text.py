"""Cleaning (C) and extraction (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract, relational
from ..plans import inference
from . import sql as q
from . import views
from .base import query



def _cleaning(name: str, column, check: str):
    @query(name, q.with_views("texts", f"SELECT issue_id, {check} AS clean_text FROM texts"))
    def run(spark, folder):
        return views.texts(spark, folder).select("issue_id", column(F.col("text")).alias("clean_text"))


_cleaning("C1_normalize_text", t.normalize_text, q.normalized("text"))
_cleaning("C2_strip_noise", t.strip_noise, q.stripped("text", urls=False))
_cleaning("C3_strip_noise_and_urls", t.strip_noise_and_urls, q.stripped("text", urls=True))
_cleaning("C4_clean_for_inference", t.clean_for_inference, q.stripped(q.normalized("text"), urls=True))


@query("C5_clean_if_missing", q.with_views(
    "labelled", f"""SELECT issue_id, CASE WHEN contains(text, upper(candidate_string)) THEN text
    ELSE {q.stripped('text', urls=False)} END AS text FROM labelled"""))
def clean_if_missing(spark, folder):
    rows = views.labelled(spark, folder)
    return rows.select("issue_id", t.clean_if_missing(F.col("text"), F.upper("candidate_string")).alias("text"))


_HIT = "SELECT issue_id, {rank} AS pattern_rank, {type} AS secret_type, {match} AS candidate_string FROM {source}"


def _hits_sql(source: str, accept: str = "") -> str:
    return _HIT.format(source=source, **{f: q.first_match("text", f, accept) for f in ("rank", "type", "match")})


HIT = ["issue_id", "pattern_rank", "secret_type", "candidate_string"]


@query("D1_first_match", q.with_views("texts", "SELECT * FROM hits WHERE pattern_rank IS NOT NULL", hits=_hits_sql("texts")))
def first_match(spark, folder):
    return extract.first_match_scan(views.texts(spark, folder), body="text").select(*HIT)


_PLACEHOLDER = lambda text, phrases: "(" + " OR ".join(f"contains(upper({text}), {q.quote(p)})" for p in phrases) + ")"


@query("D2_strict_first_match", q.with_views(
    "texts", "SELECT * FROM hits WHERE pattern_rank IS NOT NULL",
    real=f"SELECT * FROM texts WHERE NOT {_PLACEHOLDER('text', extract.fv.PLACEHOLDER_BODY)}",
    hits=_hits_sql("real", f"NOT {_PLACEHOLDER('{match}', extract.fv.PLACEHOLDER_CANDIDATE)}")))
def strict_first_match(spark, folder):
    return extract.strict_scan(views.texts(spark, folder), body="text").select(*HIT)


@query("D3_pattern_flags", q.with_views("texts", f"SELECT {', '.join(HIT)} FROM flags", flags=q.FLAGS))
def pattern_flags(spark, folder):
    return extract.pattern_flags(views.texts(spark, folder), body="text").select(*HIT)


@query("D4_all_matches", q.with_views("texts", f"SELECT {', '.join(HIT)} FROM matches", matches=q.ALL_MATCHES))
def all_matches(spark, folder):
    return extract.all_matches(views.texts(spark, folder), body="text").select(*HIT)


@query("D5_context_window", q.with_views(
    "texts", f"""SELECT m.issue_id, pattern_rank, candidate_string, {q.window('x.text', 'candidate_string')} AS context_window
    FROM matches m JOIN texts x USING (issue_id)""", matches=q.ALL_MATCHES))
def context_window(spark, folder):
    matches = extract.all_matches(views.texts(spark, folder), body="text", context=True)
    return matches.select("issue_id", "pattern_rank", "candidate_string", "context_window")


# Half the candidates are upper-cased, so that some are not in their text.
_MIXED = "SELECT issue_id, text, CASE WHEN issue_id % 2 = 0 THEN upper(candidate_string) ELSE candidate_string END AS candidate_string FROM labelled"


def _mixed(spark, folder):
    candidate = F.when(F.col("issue_id") % 2 == 0, F.upper("candidate_string")).otherwise(F.col("candidate_string"))
    return views.labelled(spark, folder).select("issue_id", "text", candidate.alias("candidate_string"))


@query("D6_containment", q.with_views(
    "labelled", """SELECT count(*) FILTER (contains(text, candidate_string)) AS ok,
    count(*) FILTER (NOT contains(text, candidate_string)) AS mismatch FROM mixed""", mixed=_MIXED))
def containment(spark, folder):
    return extract.containment(_mixed(spark, folder))


@query("D7_keep_contained", q.with_views(
    "labelled", "SELECT issue_id, candidate_string FROM mixed WHERE strpos(text, candidate_string) > 0", mixed=_MIXED))
def keep_contained(spark, folder):
    return extract.keep_contained(_mixed(spark, folder)).select("issue_id", "candidate_string")


@query("D8_drop_without_context", q.with_views(
    "labelled", f"""SELECT * FROM (SELECT issue_id, candidate_string, {q.window('text', 'candidate_string')} AS context_window
    FROM mixed) WHERE context_window IS NOT NULL""", mixed=_MIXED))
def drop_without_context(spark, folder):
    windowed = extract.add_context(_mixed(spark, folder))
    return extract.drop_without_context(windowed).select("issue_id", "candidate_string", "context_window")


@query("D9_hits_per_type", q.with_views(
    "texts", "SELECT secret_type, count(*) AS n_candidates, count(DISTINCT issue_id) AS n_issues FROM matches GROUP BY 1",
    matches=q.ALL_MATCHES))
def hits_per_type(spark, folder):
    return extract.hits_per_type(extract.all_matches(views.texts(spark, folder), body="text"))


@query("D9_hits_on_derived", q.with_views(
    "derived_texts", "SELECT secret_type, count(*) AS n_candidates, count(DISTINCT issue_id) AS n_issues FROM matches GROUP BY 1",
    matches=q.ALL_MATCHES.replace("FROM texts", "FROM derived_texts")))
def hits_on_derived(spark, folder):
    """Most rules of the catalog find something in these texts."""
    return extract.hits_per_type(extract.all_matches(views.derived_texts(spark, folder), body="text"))


@query("D_scored_candidates", q.with_views(
    "texts", "SELECT issue_id, candidate_string, secret_type, context_window, label AS prediction, stage FROM verdicts",
    cleaned=f"SELECT issue_id, {q.stripped(q.normalized('text'), urls=True)} AS text FROM texts",
    matches=q.ALL_MATCHES.replace("FROM texts", "FROM cleaned"),
    firsts=f"""SELECT m.*, {q.window('x.text', 'candidate_string')} AS context_window
        FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY issue_id, candidate_string ORDER BY pattern_rank) = 1) m
        JOIN cleaned x USING (issue_id)""", **q.verdicts("firsts")))
def scored_candidates(spark, folder):
    return inference.score_candidates(views.texts(spark, folder)).select(
        "issue_id", "candidate_string", "secret_type", "context_window", "prediction", "stage")
