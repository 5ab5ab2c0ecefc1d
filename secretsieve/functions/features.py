"""Candidate features, character codes and label names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .entropy import entropy_level, shannon_entropy
from .regex import strip

ENTROPY_BINS = ["entropy_0_1", "entropy_1_2", "entropy_2_3", "entropy_3_4", "entropy_4_plus"]
FLAG_COLUMNS = [
    "has_parentheses", "has_brackets", "has_periods", "starts_with_dollar", "has_password_word", "has_spaces",
    "has_html_tags", "starts_with_comment", "has_arrow", "has_prog_keywords", "is_numerical",
    *ENTROPY_BINS, "has_private_key_tag",
]
FEATURE_COLUMNS = [*FLAG_COLUMNS[:-1], "entropy_value", "has_private_key_tag"]

# What counts as a number: signs, digits with single underscores, exponent,
# infinity and not-a-number.
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = (
    rf"(?i)\A[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)\z"
)


def _has(text: Column, *parts: str) -> Column:
    found = text.contains(parts[0])
    for part in parts[1:]:
        found = found | text.contains(part)
    return found


def add_features(df: DataFrame, candidate: str = "candidate_string", context: str = "context_window") -> DataFrame:
    """Add the 18 feature columns; NULL texts count as empty."""
    c = F.coalesce(F.col(candidate), F.lit(""))
    shared = (
        df.withColumn("_c", c)
        .withColumn("_trim", strip(F.col("_c")))
        .withColumn("_low", F.lower(F.col("_c")))
        .withColumn("_entropy", shannon_entropy(F.col("_c")))
    )
    c, trim, low = F.col("_c"), F.col("_trim"), F.col("_low")
    ctx, entropy, level = F.coalesce(F.col(context), F.lit("")), F.col("_entropy"), entropy_level(F.col("_entropy"))
    comment = trim.startswith("#") | trim.startswith("*") | trim.startswith("/*") | trim.startswith("//")
    flags = {
        "has_parentheses": _has(c, "(", ")"),
        "has_brackets": _has(c, "[", "]", "{", "}"),
        "has_periods": _has(c, "."),
        "starts_with_dollar": trim.startswith("$"),
        "has_password_word": _has(low, "password"),
        "has_spaces": _has(c, " "),
        "has_html_tags": ctx.contains("<") & ctx.rlike("<[^>]+>"),
        "starts_with_comment": comment,
        "has_arrow": _has(c, "->", "=>"),
        "has_prog_keywords": _has(low, *fv.PROGRAM_WORDS),
        "is_numerical": trim.rlike(NUMBER),
        "entropy_0_1": level < 1,
        "entropy_1_2": (level >= 1) & (level < 2),
        "entropy_2_3": (level >= 2) & (level < 3),
        "entropy_3_4": (level >= 3) & (level < 4),
        "entropy_4_plus": level >= 4,
        "has_private_key_tag": _has(c, *fv.PRIVATE_KEY_TAGS),
    }
    added = {name: flag.cast("int") for name, flag in flags.items()}
    added["entropy_value"] = F.round(entropy, 6)
    return shared.withColumns(added).drop("_c", "_trim", "_low", "_entropy")


def char_codes(text: Column, length: int) -> Column:
    """The first ``length`` characters as codes below 256 (0 for others), padded with 0."""
    head = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, length), r"[^\x00-\xFF]", "\x00")
    codes = F.transform(F.split(head, ""), F.ascii)
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), length)), 1, length)


SECRET, NOT_SECRET = "Secret", "Non-sensitive"


def label_name(label: Column) -> Column:
    return F.when(label == 1, SECRET).when(label == 0, NOT_SECRET)


def label_value(name: Column) -> Column:
    """1 for ``Secret``, 0 for anything else."""
    return F.when(name == SECRET, 1).otherwise(0)
