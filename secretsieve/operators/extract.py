"""Finding secret candidates in texts with a pattern catalog.

Every rule is a literal pattern inside one projection, so Spark compiles it
once per task; nothing is joined with the catalog.  A rule with a needle tests
for that literal first, which skips most regex work.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.columns import bind, once
from ..functions.text import context_window


@dataclass(frozen=True)
class Rule:
    """A named pattern.  ``needle`` is a literal and ``sign`` a cheap pattern that
    the lower-cased form of every match contains; they only save work."""

    name: str
    pattern: str
    needle: str = ""
    sign: str = ""


# Our own catalog, most telling rules first.  A length is bounded above only where the key's format
# is.  Loops are possessive and runs are entered at their start, so long texts are read once.
CATALOG = [
    Rule("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "private key-----"),
    Rule("cloud_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "ia"),
    Rule("code_host_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", "gh"),
    Rule("code_host_pat", r"\bgithub_pat_[A-Za-z0-9_]{22,}+", "github_pat_"),
    Rule("pipeline_token", r"\bglpat-[A-Za-z0-9_-]{20,}+", "glpat-"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", "xox"),
    Rule("chat_webhook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}+", "hooks.slack.com"),
    Rule("maps_key", r"\bAIza[0-9A-Za-z_-]{35,}+", "aiza"),
    Rule("oauth_access", r"\bya29\.[0-9A-Za-z_-]{20,}+", "ya29."),
    Rule("payment_key", r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+", "k_"),
    Rule("mail_key", r"\bSG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+", "sg."),
    Rule("model_key", r"\bsk-[A-Za-z0-9_-]{20,}+", "sk-"),
    Rule("package_token", r"\bnpm_[A-Za-z0-9]{36,}+", "npm_"),
    Rule("signed_token", r"\beyJ[A-Za-z0-9_-]{5,}+\.eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]*+", ".eyj"),
    Rule("url_with_password", r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]++@[^\s/]++", "://"),
    Rule("bearer_header", r"\bBearer [A-Za-z0-9._~+/-]{16,}+={0,2}", "bearer "),
    Rule("basic_header", r"\bBasic [A-Za-z0-9+/]{16,}+={0,2}", "basic "),
    Rule("password_assignment", r"""\b(?:password|passwd|pwd)["']? ?[:=] ?["']?[^\s"']{6,}+["']?""", sign="p(?:assw|wd)"),
    Rule("secret_assignment", r"""\b(?:client_)?secret["']? ?[:=] ?["']?[A-Za-z0-9_/+-]{12,}+["']?""", "secret"),
    Rule("token_assignment", r"""\b[a-z_]*token["']? ?[:=] ?["']?[A-Za-z0-9_./+-]{16,}+["']?""", "token"),
    Rule("key_assignment", r"""\b[a-z_]*key["']? ?[:=] ?["']?[A-Za-z0-9_/+-]{16,}+["']?""", "key"),
    Rule("hex_key", r"\b[0-9a-f]{32,}+\b", sign="[0-9a-f]{32}"),
    Rule("mail_login", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("card_number", r"\b[0-9]{16}\b", sign="[0-9]{16}"),
]


def _present(rule: Rule, lowered: Column) -> Column:
    hints = [lowered.contains(rule.needle)] if rule.needle else []
    hints += [lowered.rlike(rule.sign)] if rule.sign else []
    return reduce(lambda a, b: a & b, hints) if hints else F.lit(True)


def _lowered(df: DataFrame, body: str) -> DataFrame:
    """Lower case once per row, for the needles of all rules."""
    return df.withColumn("_low", F.lower(F.col(body)))


def _hit(rank: int, rule: Rule, flags: str, body: Column, low: Column, accept=None) -> Column:
    """(rank, type, text) of the rule's first match if that is accepted, else NULL.

    The pattern of a rule with a needle or sign runs once, as no match of it is empty."""
    pattern = flags + rule.pattern
    hit = F.struct(F.lit(rank).alias("pattern_rank"), F.lit(rule.name).alias("secret_type"), F.regexp_extract(body, pattern, 0).alias("candidate_string"))
    text = lambda h: h.getField("candidate_string")
    real = lambda h: F.lit(True) if accept is None else accept(text(h))
    if rule.needle or rule.sign:
        return F.when(_present(rule, low), bind(hit, lambda h: F.when((text(h) != "") & real(h), h)))
    return F.when(_present(rule, low) & body.rlike(pattern), bind(hit, lambda h: F.when(real(h), h)))


def _first_match(rules: list[Rule], body: Column, low: Column, accept=None) -> Column:
    """(rank, type, text) of the first rule in order whose first match is accepted."""
    return F.coalesce(*[_hit(rank, rule, "(?i)", body, low, accept) for rank, rule in enumerate(rules, 1)])


def _emit(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("_hit").isNotNull())
        .withColumns({c: F.col("_hit").getField(c) for c in ("pattern_rank", "secret_type", "candidate_string")})
        .drop("_hit", "_low")
    )


def first_match_scan(issues: DataFrame, rules: list[Rule] | None = None, body: str = "body") -> DataFrame:
    """Per issue the first rule that matches, ignoring case, with its first match."""
    hit = _first_match(rules or CATALOG, F.col(body), F.col("_low"))
    return _emit(once(_lowered(issues, body), "_hit", hit))


def mark_hits(issues: DataFrame, rules: list[Rule] | None = None, body: str = "body") -> DataFrame:
    """Add ``is_hit``: whether any rule matches, ignoring case."""
    text, low = F.col(body), F.col("_low")
    tests = [_present(r, low) & text.rlike("(?i)" + r.pattern) for r in rules or CATALOG]
    found = reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])
    return once(_lowered(issues, body), "is_hit", found).drop("_low")


def strict_scan(issues: DataFrame, rules: list[Rule] | None = None, body: str = "body") -> DataFrame:
    """:func:`first_match_scan` without placeholders: bodies that mention one are
    dropped, and a rule whose match is one gives way to the next rule."""
    # Only a body with a match is raised.  The phrases hold no metacharacters; one pattern names the match once.
    text = F.col(body)
    fake = "|".join(fv.PLACEHOLDER_CANDIDATE)
    told = lambda: bind(F.upper(text), lambda up: reduce(lambda a, b: a | b, [F.contains(up, F.lit(p)) for p in fv.PLACEHOLDER_BODY]))
    real = lambda match: ~F.upper(match).rlike(fake) & ~told()
    hit = _first_match(rules or CATALOG, text, F.col("_low"), accept=real)
    return _emit(once(_lowered(issues, body), "_hit", hit))


def pattern_flags(
    issues: DataFrame, rules: list[Rule] | None = None, body: str = "body", per_issue: int | None = None
) -> DataFrame:
    """Every rule that matches an issue, with its first match; with ``per_issue``
    only the first ones in catalog order.  Case is ignored and ``^ $`` match at lines."""
    tests = [_hit(rank, rule, "(?im)", F.col(body), F.col("_low")) for rank, rule in enumerate(rules or CATALOG, 1)]
    hits = F.array_compact(F.array(*tests))
    if per_issue is not None:
        hits = F.slice(hits, 1, per_issue)
    rows = once(_lowered(issues, body), "_hits", hits)
    return _emit(rows.withColumn("_hit", F.explode("_hits")).drop("_hits"))


def all_matches(
    issues: DataFrame, rules: list[Rule] | None = None, body: str = "body", keep: list[str] | None = None, context: bool = False
) -> DataFrame:
    """Every distinct match of every rule, case-sensitive: one row per issue,
    rule and match.  ``keep`` names the issue columns to carry (default: the id).

    With ``context`` every match has its ``context_window``, cut before the
    matches become rows, so no row carries the whole text.
    """
    text, low = F.col(body), F.col("_low")
    per_rule = []
    for rank, rule in enumerate(rules or CATALOG, 1):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)))
        kind = "array<struct<candidate_string:string" + (",context_window:string>>" if context else ">>")
        found = F.transform(found, lambda c: F.struct(
            c.alias("candidate_string"), *([context_window(text, c).alias("context_window")] if context else [])))
        none = F.array().cast(kind)
        per_rule.append(
            F.struct(
                F.lit(rank).alias("pattern_rank"), F.lit(rule.name).alias("secret_type"),
                F.when(_present(rule, low), found).otherwise(none).alias("matches"),
            )
        )
    found = F.filter(F.array(*per_rule), lambda x: F.size(x.getField("matches")) > 0)
    rows = once(_lowered(issues, body), "_found", found).select(*(keep or ["issue_id"]), F.explode("_found").alias("_rule"))
    return rows.select(
        *(keep or ["issue_id"]), F.col("_rule.pattern_rank"), F.col("_rule.secret_type"),
        F.inline("_rule.matches"),
    )


def hits_per_type(candidates: DataFrame) -> DataFrame:
    """How many candidates, and issues, each rule found."""
    # One row per type and issue first: the distinct count then has no hot group.
    per_issue = candidates.groupBy("secret_type", "issue_id").agg(F.count(F.lit(1)).alias("n"))
    return per_issue.groupBy("secret_type").agg(
        F.sum("n").alias("n_candidates"), F.count(F.lit(1)).alias("n_issues")
    )


# ---------------------------------------------------------- candidate and text
def add_context(df: DataFrame, text: str = "text", candidate: str = "candidate_string") -> DataFrame:
    return df.withColumn("context_window", context_window(F.col(text), F.col(candidate)))


def drop_without_context(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["context_window"])


def containment(df: DataFrame, text: str = "text", candidate: str = "candidate_string") -> DataFrame:
    """How many candidates occur in their text."""
    inside = F.contains(F.col(text), F.col(candidate))
    return df.agg(F.count_if(inside).alias("ok"), F.count_if(~inside).alias("mismatch"))


def keep_contained(df: DataFrame, text: str = "text", candidate: str = "candidate_string") -> DataFrame:
    return df.filter(F.contains(F.col(text), F.col(candidate)))
