"""SQL text of the same inputs and rules for DuckDB."""

from __future__ import annotations

import re

from ..functions import fixed_values as fv
from ..functions.regex import SPACE_CHARACTERS, any_of, spark_regex, whole
from ..functions.text import _NOT_AFTER_WORD, _NOT_BEFORE_WORD, NOISE_RULES, URL_RULES
from ..operators.extract import CATALOG
from . import views


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def plain(pattern: str) -> str:
    """A Java pattern for RE2: greedy loops, and a word boundary or nothing for a look-around.

    A look-behind on the class of the loop behind it only says that a run is entered at its start,
    which the leftmost match is anyway."""
    return (
        re.sub(r"^\(\?<!(\[[^\]]+\])\)(?=\1)", "", pattern).replace("}+", "}").replace(_NOT_AFTER_WORD, r"\b").replace(_NOT_BEFORE_WORD, r"\b")
        .replace("(?<![0-9a-fA-F-])", "").replace("++", "+").replace("*+", "*")
    )


SPACES = quote(SPACE_CHARACTERS)
TRIMMED = f"trim(coalesce(candidate_string, ''), {SPACES})"

HASH = "('0x' || substr(md5('42:' || {key}), 1, {digits}))::BIGINT"
SPLIT = (
    "CASE WHEN " + HASH.replace("{digits}", "8") + " / 4294967296.0 < 0.15 THEN 'test' WHEN "
    + HASH.replace("{digits}", "8") + " / 4294967296.0 < 0.15 + 0.85 * 0.118 THEN 'validation' ELSE 'train' END"
)

VIEWS = {
    "issues_text": "SELECT doc_id AS issue_id, 'doc/' || doc_id AS url, source AS repo, text FROM documents",
    "skip_urls": "SELECT 'doc/' || doc_id AS url FROM labels WHERE toxic = 1",
    "texts": "SELECT 'doc/' || doc_id AS issue_id, text FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages",
    "token_candidates": r"""SELECT DISTINCT doc_id AS issue_id, tok AS candidate_string
        FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \t\n\r\f]+')) AS tok FROM documents) WHERE length(tok) >= 12""",
    "token_contexts": """SELECT t.issue_id, t.candidate_string,
        substr(d.text, greatest(strpos(d.text, t.candidate_string) - 200, 1)::BIGINT,
               (strpos(d.text, t.candidate_string) + length(t.candidate_string) + 200
                - greatest(strpos(d.text, t.candidate_string) - 200, 1))::BIGINT) AS context_window
        FROM token_candidates t JOIN documents d ON d.doc_id = t.issue_id""",
    "labelled": r"""SELECT d.doc_id AS issue_id, d.text, regexp_extract(d.text, '[^ \t\n\r\f]+', 0) AS candidate_string,
        1 - l.quality AS label, d.n_chars, d.lang FROM documents d JOIN labels l USING (doc_id)""",
    "labelled_tokens": f"""SELECT c.*, 1 - l.quality AS label, md5(c.issue_id || '|' || c.candidate_string) AS id,
        {SPLIT.format(key='c.issue_id')} AS split FROM token_contexts c JOIN labels l ON l.doc_id = c.issue_id""",
    "model_predictions": """SELECT issue_id, text, candidate_string, label, model, prediction FROM (
        SELECT *, 'short' AS model, (n_chars < 300)::INT AS prediction FROM labelled
        UNION ALL SELECT *, 'long', (n_chars > 5000)::INT FROM labelled
        UNION ALL SELECT *, 'marked', contains(text, '###')::INT FROM labelled)""",
    "responses": f"SELECT conv_id, turn, {listed(views.ANSWERS)}[turn % 4 + 1] AS response FROM conversations",
    "repos": """SELECT c_name AS full_name, floor(c_acctbal * c_acctbal / 100)::BIGINT AS size_kb,
        floor(abs(c_acctbal))::BIGINT * (c_custkey % 3) AS stars, c_nationkey::BIGINT AS forks,
        CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS language,
        c_custkey % 5 = 0 AS is_fork, c_custkey % 7 = 0 AS is_archived FROM customer""",
    "issues_meta": f"""SELECT o_orderkey AS issue_id, c_name AS repo_full_name,
        {listed(views.TITLES)}[o_orderkey % 6 + 1] AS title, [lower(o_orderpriority)] AS labels, o_orderdate AS created_at,
        o_orderdate + to_hours((o_orderkey % 200)::INT) AS updated_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours((o_orderkey * 7919 % 5000)::INT) END AS closed_at
        FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 <> 0""",
    "leaks": "SELECT repo_full_name AS full_name, count(*) AS leaks FROM issues_meta GROUP BY ALL",
    "counted": "SELECT r.*, coalesce(l.leaks, 0) AS leaks FROM repos r LEFT JOIN leaks l USING (full_name)",
    "derived_candidates": f"""SELECT c_custkey AS issue_id, unnest([{', '.join(views.DERIVED)}]) AS candidate_string
        FROM (SELECT *, md5(c_name) AS h, to_base64(unhex(md5(c_name) || md5('r' || c_name))) AS r FROM customer)""",
    "derived_texts": f"""SELECT c_custkey AS issue_id, concat_ws(chr(10), {', '.join(views.DERIVED)}) AS text
        FROM (SELECT *, md5(c_name) AS h, to_base64(unhex(md5(c_name) || md5('r' || c_name))) AS r FROM customer)""",
    "stream_hits": """SELECT event_id, 'user/' || user_id AS url, ts AS created_at, event_type AS secret_type FROM events""",
}
_NEEDS = {
    "token_contexts": ["token_candidates"], "labelled_tokens": ["token_candidates", "token_contexts"],
    "model_predictions": ["labelled"], "leaks": ["issues_meta"], "counted": ["repos", "issues_meta", "leaks"],
}


def with_views(names: str, body: str, **extra: str) -> str:
    """``body`` with the named views (and ``extra`` ones) in front."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


# ----------------------------------------------------------------------- rules
def entropy(text: str) -> str:
    return f"(CASE WHEN {text} IS NULL THEN NULL WHEN {text} = '' THEN 0.0 ELSE list_aggregate(string_split({text}, ''), 'entropy') END)"


def level(value: str) -> str:
    return f"round({value}, 9)"


def first_name(tests: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {quote(name)}" for name, test in tests) + " END"


def search(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quote(pattern)})"


def fully(text: str, pattern: str) -> str:
    return f"regexp_full_match({text}, {quote(pattern)})"


HARMLESS = first_name([(n, fully("low", spark_regex(p))) for n, p in fv.HARMLESS_SHAPES])
DUMMY = first_name([(n, search("low", spark_regex(p))) for n, p in fv.DUMMY_MARKS])
SERVICE = first_name([(n, search("c", spark_regex(p))) for n, p, _, _ in fv.SERVICE_FORMATS])
UNKNOWN = first_name([(n, fully("c", p)) for n, p in fv.UNKNOWN_FORMATS])
CONTEXT = "(" + " OR ".join(f"contains(low, {quote(w)})" for w in fv.CONTEXT_WORDS) + ")"
COMPLEXITY = (
    r"(regexp_matches(c, '\p{Lu}')::INT + regexp_matches(c, '\p{Ll}')::INT + regexp_matches(c, '\p{Nd}')::INT"
    rf" + regexp_matches(c, {quote(chr(91) + ''.join(chr(92) + x for x in fv.SPECIAL_CHARACTERS) + chr(93))})::INT)"
)
_KV = quote(spark_regex(r"\A([a-zA-Z_][a-zA-Z0-9_]*)\s*[=:]\s*(.+)"))
KV_NAME, KV_VALUE = f"lower(regexp_extract(c, {_KV}, 1))", f"regexp_extract(c, {_KV}, 2)"
KEY_VALUE = (
    "((" + " OR ".join(f"contains({KV_NAME}, {quote(w)})" for w in fv.KEY_WORDS)
    + f") AND length({KV_VALUE}) >= 16 AND {level(entropy(KV_VALUE))} > 3.0)"
)


def verdicts(source: str) -> dict[str, str]:
    """Views that end in ``verdicts``: the rows of ``source`` with label, stage and rule."""
    return {
        "shaped": f"SELECT *, {TRIMMED} AS c, lower({TRIMMED}) AS low FROM {source}",
        "measured": f"SELECT *, {HARMLESS} AS harmless, {DUMMY} AS dummy, {SERVICE} AS service, {entropy('c')} AS e FROM shaped",
        "staged": f"""SELECT *, CASE WHEN harmless IS NOT NULL THEN 'harmless_shape' WHEN dummy IS NOT NULL THEN 'dummy'
            WHEN service IS NOT NULL THEN 'service' WHEN length(c) < 20 OR {level('e')} < 3.5 THEN 'too_plain'
            WHEN {CONTEXT} THEN 'context_word' WHEN {COMPLEXITY} >= 3 AND length(c) >= 16 THEN 'complexity'
            WHEN {level('e')} > 4.5 AND length(c) >= 24 THEN 'very_random'
            WHEN {level('e')} > 4.0 AND ({UNKNOWN}) IS NOT NULL THEN 'unknown_format'
            WHEN {KEY_VALUE} THEN 'key_value' ELSE 'fallback' END AS stage FROM measured""",
        "verdicts": f"""SELECT * EXCLUDE (c, low, harmless, dummy, service, e),
            CASE WHEN stage IN ('harmless_shape', 'dummy', 'too_plain') THEN 0 ELSE 1 END AS label,
            CASE stage WHEN 'harmless_shape' THEN harmless WHEN 'dummy' THEN dummy WHEN 'service' THEN service
            WHEN 'unknown_format' THEN {UNKNOWN} ELSE stage END AS rule FROM staged""",
    }


# -------------------------------------------------------------------- cleaning
def normalized(text: str) -> str:
    space = spark_regex(r"\s+")
    steps = [(r"[\r\n\t]+", " "), (space, " "), ("</s>|<eos>", ""), (r"[^\x20-\x7E\t\n\r\x0B\x0C]", "")]
    sql = f"trim(coalesce({text}, ''), {SPACES})"
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, {quote(pattern)}, {quote(by)}, 'g')"
    return sql


def stripped(text: str, urls: bool) -> str:
    for name, pattern, _, _ in NOISE_RULES:
        if urls or name not in URL_RULES:
            pattern = pattern.replace(_NOT_AFTER_WORD, "", 1) if name == "dotted_name" else pattern
            text = f"regexp_replace({text}, {quote(plain(pattern))}, '', 'g')"
    return text


def window(text: str, candidate: str, radius: int = 200) -> str:
    at = f"strpos({text}, {candidate})"
    start = f"greatest({at} - {radius}, 1)"
    return f"CASE WHEN {at} > 0 THEN substr({text}, {start}::BIGINT, ({at} + length({candidate}) + {radius} - {start})::BIGINT) END"


# ------------------------------------------------------------------- extraction
def first_match(text: str, field: str, accept: str = "") -> str:
    """The rank, type or text of the first rule in catalog order."""
    cases = []
    for rank, rule in enumerate(CATALOG, 1):
        pattern = quote("(?i)" + plain(rule.pattern))
        match = f"regexp_extract({text}, {pattern}, 0)"
        value = {"rank": str(rank), "type": quote(rule.name), "match": match}[field]
        test = f"regexp_matches({text}, {pattern})" + (f" AND {accept.format(match=match)}" if accept else "")
        cases.append(f"WHEN {test} THEN {value}")
    return "CASE " + " ".join(cases) + " END"


def every_rule(template: str) -> str:
    """UNION ALL over the catalog; ``{rank} {type} {pattern}`` are filled in."""
    return " UNION ALL ".join(
        template.format(rank=i, type=quote(r.name), pattern=quote(plain(r.pattern)), pattern_i=quote("(?im)" + plain(r.pattern)))
        for i, r in enumerate(CATALOG, 1)
    )


ALL_MATCHES = every_rule(
    "SELECT issue_id, {rank} AS pattern_rank, {type} AS secret_type, "
    "unnest(list_distinct(regexp_extract_all(text, {pattern}, 0))) AS candidate_string FROM texts"
)
FLAGS = every_rule(
    "SELECT issue_id, {rank} AS pattern_rank, {type} AS secret_type, regexp_extract(text, {pattern_i}, 0) AS candidate_string "
    "FROM texts WHERE regexp_matches(text, {pattern_i})"
)
