"""Candidate rules (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features, rules
from ..functions.entropy import shannon_entropy
from . import sql as q
from . import views
from .base import query

def C():
    return F.col("candidate_string")


KEYS = ["issue_id", "candidate_string"]
ROW = "issue_id, candidate_string"


def _check(value: str, source: str = "token_candidates") -> str:
    """One computed column for every candidate; ``c`` and ``low`` are its trimmed forms."""
    shaped = f"SELECT *, {q.TRIMMED} AS c, lower({q.TRIMMED}) AS low FROM {source}"
    return q.with_views(source, f"SELECT {ROW}, {value} FROM shaped", shaped=shaped)


def _token_query(name: str, value: str, column):
    """Register a column over all token candidates."""

    @query(name, _check(value))
    def run(spark, folder):
        return views.token_candidates(spark, folder).select(*KEYS, column())

    return run


_token_query("E1_entropy", f"round({q.entropy('c')}, 6) AS entropy", lambda: F.round(shannon_entropy(C()), 6).alias("entropy"))
_token_query(
    "E2_entropy_baseline", f"({q.level(q.entropy('c'))} > 3.5 AND length(c) > 20)::INT AS prediction",
    lambda: rules.entropy_baseline(C()).cast("int").alias("prediction"),
)
_token_query("E3_harmless_shape", f"{q.HARMLESS} AS shape", lambda: rules.harmless_shape(F.lower(C())).alias("shape"))
_token_query("E4_dummy_mark", f"{q.DUMMY} AS mark", lambda: rules.dummy_mark(F.lower(C())).alias("mark"))
_token_query("E5_service_format", f"{q.SERVICE} AS service", lambda: rules.service_format(C()).alias("service"))
_token_query(
    "E6_plain_gate", f"(length(c) < 20 OR {q.level(q.entropy('c'))} < 3.5)::INT AS too_plain",
    lambda: rules.is_too_plain(C(), shannon_entropy(C())).cast("int").alias("too_plain"),
)


@query("E7_context_word", _check(f"{q.CONTEXT}::INT AS has_word"))
def context_words(spark, folder):
    lowered = views.token_candidates(spark, folder).withColumn("low", F.lower(C()))
    return lowered.select(*KEYS, rules.has_context_word(F.col("low")).cast("int").alias("has_word"))


_token_query(
    "E8_complexity", f"{q.COMPLEXITY} AS score, ({q.COMPLEXITY} >= 3 AND length(c) >= 16)::INT AS is_complex",
    lambda: F.inline(F.array(F.struct(rules.complexity(C()).alias("score"), rules.is_complex(C()).cast("int").alias("is_complex")))),
)
_token_query(
    "E9_very_random", f"({q.level(q.entropy('c'))} > 4.5 AND length(c) >= 24)::INT AS very_random",
    lambda: rules.is_very_random(C(), shannon_entropy(C())).cast("int").alias("very_random"),
)
_token_query(
    "E10_unknown_format", f"CASE WHEN {q.level(q.entropy('c'))} > 4.0 THEN {q.UNKNOWN} END AS format",
    lambda: rules.unknown_format(C(), shannon_entropy(C())).alias("format"),
)

# Whole matches such as `token = "..."` have the key=value form.
_MATCHES = {"matches": q.ALL_MATCHES}


@query("E11_key_value", q.with_views(
    "texts", f"SELECT issue_id, pattern_rank, candidate_string, {q.KEY_VALUE}::INT AS is_pair FROM (SELECT *, candidate_string AS c FROM matches)",
    **_MATCHES))
def key_value(spark, folder):
    from ..operators.extract import all_matches

    matches = all_matches(views.texts(spark, folder), body="text")
    return matches.select("issue_id", "pattern_rank", "candidate_string", rules.is_key_value(C()).cast("int").alias("is_pair"))


@query("E12_verdict", q.with_views(
    "token_candidates", f"SELECT {ROW}, label, stage, rule FROM verdicts", **q.verdicts("token_candidates")))
def verdict(spark, folder):
    return rules.add_verdict(views.token_candidates(spark, folder)).select(*KEYS, "label", "stage", "rule")


@query("E12_verdict_on_matches", q.with_views(
    "texts", "SELECT issue_id, pattern_rank, candidate_string, label, stage, rule FROM verdicts",
    **_MATCHES, **q.verdicts("matches")))
def verdict_on_matches(spark, folder):
    from ..operators.extract import all_matches

    return rules.add_verdict(all_matches(views.texts(spark, folder), body="text")).select(
        "issue_id", "pattern_rank", "candidate_string", "label", "stage", "rule")


@query("E12_label_only", q.with_views(
    "token_candidates", f"SELECT {ROW}, label FROM verdicts", **q.verdicts("token_candidates")))
def label_only(spark, folder):
    return views.token_candidates(spark, folder).select(*KEYS, rules.heuristic_label(C()).alias("label"))


@query("E13_verdict_funnel", q.with_views(
    "token_candidates", "SELECT stage, label, count(*) AS n_rows FROM verdicts GROUP BY ALL", **q.verdicts("token_candidates")))
def funnel(spark, folder):
    return rules.verdict_funnel(rules.add_verdict(views.token_candidates(spark, folder)))


# The given texts reach few rules; strings in the forms of keys reach the others.
@query("E_rules_on_derived", q.with_views("derived_candidates", f"""SELECT {ROW}, {q.HARMLESS} AS shape, {q.DUMMY} AS mark, {q.SERVICE} AS service,
    {q.CONTEXT}::INT AS has_word, {q.COMPLEXITY} AS score, ({q.level(q.entropy('c'))} > 4.5 AND length(c) >= 24)::INT AS very_random,
    CASE WHEN {q.level(q.entropy('c'))} > 4.0 THEN {q.UNKNOWN} END AS format, {q.KEY_VALUE}::INT AS is_pair, label, stage, rule FROM shaped_again""",
    **q.verdicts("derived_candidates"), shaped_again=f"SELECT *, {q.TRIMMED} AS c, lower({q.TRIMMED}) AS low FROM verdicts"))
def rules_on_derived(spark, folder):
    rows = rules.add_verdict(rules.add_values(views.derived_candidates(spark, folder)), valued=True)
    rows = rows.withColumns({name: F.col(name).cast("int") for name in ("has_word", "very_random", "is_pair")})
    return rows.select(*KEYS, "shape", "mark", "service", "has_word", "score", "very_random", "format", "is_pair", "label", "stage", "rule")


# ------------------------------------------------------------------- features
_E, _L = q.entropy("c0"), q.level(q.entropy("c0"))
_TRIM = f"trim(c0, {q.SPACES})"
_has = lambda text, *parts: "(" + " OR ".join(f"contains({text}, {q.quote(p)})" for p in parts) + ")"
FEATURE_SQL = {
    "has_parentheses": _has("c0", "(", ")"), "has_brackets": _has("c0", "[", "]", "{", "}"), "has_periods": _has("c0", "."),
    "starts_with_dollar": f"starts_with({_TRIM}, '$')", "has_password_word": _has("lower(c0)", "password"),
    "has_spaces": _has("c0", " "), "has_html_tags": "regexp_matches(coalesce(context_window, ''), '<[^>]+>')",
    "starts_with_comment": f"regexp_matches({_TRIM}, '\\A(#|\\*|/\\*|//)')", "has_arrow": _has("c0", "->", "=>"),
    "has_prog_keywords": _has("lower(c0)", "null", "nil", "undefined", "none", "true", "false"),
    "is_numerical": q.search(_TRIM, features.NUMBER),
    "entropy_0_1": f"{_L} < 1", "entropy_1_2": f"{_L} >= 1 AND {_L} < 2", "entropy_2_3": f"{_L} >= 2 AND {_L} < 3",
    "entropy_3_4": f"{_L} >= 3 AND {_L} < 4", "entropy_4_plus": f"{_L} >= 4",
    "has_private_key_tag": _has("c0", "BEGIN PRIVATE KEY", "BEGIN RSA PRIVATE KEY"),
}


def features_sql(source: str) -> dict[str, str]:
    """Views that end in ``features``."""
    flags = ", ".join(f"({test})::INT AS {name}" for name, test in FEATURE_SQL.items())
    return {
        "raw_candidates": f"SELECT *, coalesce(candidate_string, '') AS c0 FROM {source}",
        "features": f"SELECT * EXCLUDE (c0), {flags}, round({_E}, 6) AS entropy_value FROM raw_candidates",
    }


@query("E14_features", q.with_views(
    "token_contexts", f"SELECT {ROW}, {', '.join(features.FEATURE_COLUMNS)} FROM features", **features_sql("token_contexts")))
def candidate_features(spark, folder):
    return features.add_features(views.token_contexts(spark, folder)).select(*KEYS, *features.FEATURE_COLUMNS)


def _codes_sql(text: str, n: int) -> str:
    codes = f"list_transform(string_split(substr({text}, 1, {n}), ''), lambda x: CASE WHEN unicode(x) BETWEEN 0 AND 255 THEN unicode(x) ELSE 0 END)"
    return f"array_to_string(list_resize({codes}, {n}, 0), ' ')"


@query("E15_char_codes", q.with_views(
    "token_contexts", f"SELECT {ROW}, {_codes_sql('candidate_string', 256)} AS candidate_codes, md5({_codes_sql('context_window', 512)}) AS context_codes_md5 FROM token_contexts"))
def char_codes(spark, folder):
    joined = lambda text, n: F.array_join(features.char_codes(F.col(text), n), " ")
    return views.token_contexts(spark, folder).select(
        *KEYS, joined("candidate_string", 256).alias("candidate_codes"),
        F.md5(joined("context_window", 512)).alias("context_codes_md5"))


@query("E16_label_names", q.with_views(
    "labelled", "SELECT issue_id, CASE label WHEN 1 THEN 'Secret' ELSE 'Non-sensitive' END AS label_name, label AS label_value FROM labelled"))
def label_names(spark, folder):
    named = views.labelled(spark, folder).withColumn("label_name", features.label_name(F.col("label")))
    return named.select("issue_id", "label_name", features.label_value(F.col("label_name")).alias("label_value"))
