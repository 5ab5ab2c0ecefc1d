"""From raw issues to scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.rules import add_verdict
from ..functions.text import clean_for_inference
from ..operators import extract, relational
from ..operators.extract import Rule


def extract_candidates(issues: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """Clean every text, find all candidates, keep the first rule per issue and
    candidate, and cut the window.

    Windows are cut before the candidates become rows, so neither those rows nor the
    only shuffle (the de-duplication) carry texts.
    """
    cleaned = once(issues, "clean_text", clean_for_inference(F.col(text)))
    matches = extract.all_matches(cleaned, rules, body="clean_text", context=True)
    return relational.first_pattern_per_candidate(matches)


def score_candidates(issues: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """:func:`extract_candidates` with the rule verdict as ``prediction``."""
    return add_verdict(extract_candidates(issues, rules, text)).withColumnRenamed("label", "prediction")
