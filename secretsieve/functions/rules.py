"""Rule verdicts on candidate strings.

All rules are Column expressions.  :func:`add_verdict` first projects the
values that several rules share (trimmed candidate, lower case, entropy), so
each is computed once per row, then picks the first rule that decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .columns import text_array
from .entropy import entropy_level, shannon_entropy
from .regex import any_of, spark_regex, strip, whole
from .terms import shortest_terms

_KEY_VALUE = spark_regex(r"\A([a-zA-Z_][a-zA-Z0-9_]*)\s*[=:]\s*(.+)")
_SPECIAL = r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?/\\~`]"

_HARMLESS = whole(any_of([spark_regex(p) for _, p in fv.HARMLESS_SHAPES]))


def _first(tests: list[tuple[str, Column]]) -> Column:
    """Name of the first test that holds, NULL if none does."""
    return F.coalesce(*[F.when(test, name) for name, test in tests])


def _any(tests: list[Column]) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


# ---------------------------------------------------------------- single rules
def entropy_baseline(candidate: Column) -> Column:
    """Longer than 20 and above 3.5 bits, both strictly."""
    return (F.length(candidate) > fv.MIN_LENGTH) & (
        entropy_level(shannon_entropy(candidate)) > fv.ENTROPY_THRESHOLD
    )


def is_harmless(lowered: Column) -> Column:
    return lowered.rlike(_HARMLESS)


def harmless_shape(lowered: Column) -> Column:
    # Few candidates have one; one search for all shapes tells which.
    return F.when(is_harmless(lowered), _first([(n, lowered.rlike(whole(spark_regex(p)))) for n, p in fv.HARMLESS_SHAPES]))


def _mark_test(lowered: Column, name: str, pattern: str) -> Column:
    needles, found = fv.DUMMY_NEEDLES.get(name, []), lowered.rlike(spark_regex(pattern))
    return _any([F.contains(lowered, F.lit(x)) for x in needles]) & found if needles else found


def is_dummy(lowered: Column) -> Column:
    return _any([_mark_test(lowered, n, p) for n, p in fv.DUMMY_MARKS])


def dummy_mark(lowered: Column) -> Column:
    return _first([(n, _mark_test(lowered, n, p)) for n, p in fv.DUMMY_MARKS])


def _service_test(candidate: Column, pattern: str, shortest: int, literal: str) -> Column:
    test = F.length(candidate) >= shortest
    if literal:
        test = test & candidate.contains(literal)
    return test & candidate.rlike(spark_regex(pattern))


def service_format(candidate: Column) -> Column:
    """Name of the first service whose key format occurs in the candidate."""
    return _first([(n, _service_test(candidate, p, m, lit)) for n, p, m, lit in fv.SERVICE_FORMATS])


def is_too_plain(candidate: Column, entropy: Column) -> Column:
    """Shorter than 20, or below 3.5 bits."""
    return (F.length(candidate) < fv.MIN_LENGTH) | (entropy_level(entropy) < fv.ENTROPY_THRESHOLD)


def has_context_word(lowered: Column, words: list[str] | None = None) -> Column:
    """Whether any word occurs in the lower-cased candidate.  A word that
    contains another one cannot change the outcome and is not searched."""
    return F.exists(text_array(shortest_terms(words or fv.CONTEXT_WORDS)), lambda w: F.contains(lowered, w))


def complexity(candidate: Column) -> Column:
    """How many of upper, lower, digit and special characters occur (0 to 4)."""
    parts = [r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", _SPECIAL]
    return sum((candidate.rlike(p).cast("int") for p in parts), F.lit(0))


def is_complex(candidate: Column) -> Column:
    return (F.length(candidate) >= 16) & (complexity(candidate) >= 3)


def is_very_random(candidate: Column, entropy: Column) -> Column:
    return (F.length(candidate) >= 24) & (entropy_level(entropy) > 4.5)


def unknown_format(candidate: Column, entropy: Column) -> Column:
    """Name of the unknown-service format of a candidate above 4 bits."""
    shape = _first([(n, candidate.rlike(whole(p))) for n, p in fv.UNKNOWN_FORMATS])
    return F.when(entropy_level(entropy) > 4.0, shape)


def is_key_value(candidate: Column) -> Column:
    """``name = value`` with a telling name and a long, random value."""
    name = F.lower(F.regexp_extract(candidate, _KEY_VALUE, 1))
    value = F.regexp_extract(candidate, _KEY_VALUE, 2)
    return (
        name.rlike("|".join(fv.KEY_WORDS))
        & (F.length(value) >= 16)
        & (entropy_level(shannon_entropy(value)) > 3.0)
    )


# ------------------------------------------------------------------- verdicts
def heuristic_label(candidate: Column) -> Column:
    """Secret (1) or not (0).

    The five late stages only explain a positive verdict, so the label needs
    just the two vetoes, the service formats and the length / entropy gate.
    NULL counts as empty, hence 0.
    """
    c = strip(F.coalesce(candidate, F.lit("")))
    lowered = F.lower(c)
    return (
        F.when(is_harmless(lowered), 0)
        .when(is_dummy(lowered), 0)
        .when(service_format(c).isNotNull(), 1)
        .when(is_too_plain(c, shannon_entropy(c)), 0)
        .otherwise(1)
    )


VALUES = ("shape", "mark", "service", "score", "entropy", "has_word", "very_random", "format", "is_pair")


def add_values(df: DataFrame, candidate: str = "candidate_string", words: list[str] | None = None) -> DataFrame:
    """Add what every single rule says of the trimmed candidate, each computed once per row (:data:`VALUES`)."""
    c, low, e = F.col("_c"), F.col("_low"), F.col("entropy")
    stripped = strip(F.col(candidate))
    return (
        df.withColumns({"_c": stripped, "_low": F.lower(stripped)})
        .withColumns({
            "shape": harmless_shape(low), "mark": dummy_mark(low), "service": service_format(c), "score": complexity(c),
            "entropy": shannon_entropy(c), "has_word": has_context_word(low, words), "is_pair": is_key_value(c),
        })
        .withColumns({"very_random": is_very_random(c, e), "format": unknown_format(c, e)})
        .drop("_c", "_low")
    )


def _outcome(label: int, stage: str, rule: Column | None = None) -> Column:
    return F.struct(
        F.lit(label).alias("label"),
        F.lit(stage).alias("stage"),
        (F.lit(stage) if rule is None else rule).alias("rule"),
    )


def _early(shaped: Column, shape: Column, marked: Column, mark: Column) -> Column:
    return F.when(shaped, _outcome(0, "harmless_shape", shape)).when(marked, _outcome(0, "dummy", mark))


def add_verdict(
    df: DataFrame, candidate: str = "candidate_string", words: list[str] | None = None, valued: bool = False
) -> DataFrame:
    """Add ``label``, ``stage`` and ``rule``: who decided, and how.

    ``valued`` rows have the values of :func:`add_values`, which are then taken; other rows get no
    further than the stage that decides."""
    c, low = F.col("_c"), F.col("_low")
    stripped = strip(F.coalesce(F.col(candidate), F.lit("")))
    gated = df.withColumns({"_c": stripped, "_low": F.lower(stripped)})
    if valued:
        v = {name: F.col(name) for name in VALUES}
        tests = (v["has_word"], (F.length(c) >= 16) & (v["score"] >= 3), v["very_random"], v["format"], v["is_pair"])
        gated = gated.withColumns({
            "_early": _early(v["shape"].isNotNull(), v["shape"], v["mark"].isNotNull(), v["mark"]), "_service": v["service"], "_entropy": v["entropy"]})
    else:
        e = F.col("_entropy")
        tests = (has_context_word(low, words), is_complex(c), is_very_random(c, e), unknown_format(c, e), is_key_value(c))
        gated = (
            gated.withColumn("_early", _early(is_harmless(low), harmless_shape(low), is_dummy(low), dummy_mark(low)))
            .withColumn("_service", F.when(F.col("_early").isNull(), service_format(c)))
            # Entropy is the dearest value: only rows still open and long enough need it.
            .withColumn(
                "_entropy",
                F.when(
                    F.col("_early").isNull() & F.col("_service").isNull() & (F.length(c) >= fv.MIN_LENGTH),
                    shannon_entropy(c),
                ),
            )
        )
    has_word, complex_, random, shape, pair = tests
    e = F.col("_entropy")
    late = (
        F.when(has_word, _outcome(1, "context_word"))
        .when(complex_, _outcome(1, "complexity"))
        .when(random, _outcome(1, "very_random"))
        .when(shape.isNotNull(), _outcome(1, "unknown_format", shape))
        .when(pair, _outcome(1, "key_value"))
        .otherwise(_outcome(1, "fallback"))
    )
    verdict = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_service").isNotNull(), _outcome(1, "service", F.col("_service")))
        .when(e.isNull() | is_too_plain(c, e), _outcome(0, "too_plain"))
        .otherwise(late)
    )
    kept = [F.col(f"`{name}`") for name in df.columns if name not in ("label", "stage", "rule")]
    return gated.select(*kept, verdict.alias("_verdict")).select(*kept, "_verdict.*")


def verdict_funnel(verdicts: DataFrame) -> DataFrame:
    """How many rows each stage decided."""
    return verdicts.groupBy("stage", "label").agg(F.count(F.lit(1)).alias("n_rows"))
