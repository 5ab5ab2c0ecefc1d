"""Shannon entropy of a string, in bits per character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(text: Column) -> Column:
    """``log2(n) - sum(k * log2(k)) / n`` over the counts ``k`` of each character.

    0 for empty, NULL for NULL.  The characters are sorted, so each count is the length of
    a run; a single character adds 0.  Nothing is exploded or shuffled, and a long text is read once.
    """
    n = F.length(text)
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1++"), F.lit(0))
    counts = F.transform(runs, lambda run: F.length(run).cast("double"))
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc + k * F.log2(k))
    return F.when(text.isNull(), F.lit(None).cast("double")).when(n < 2, F.lit(0.0)).otherwise(
        F.log2(n.cast("double")) - weighted / n
    )


def entropy_level(entropy: Column) -> Column:
    """The value thresholds compare with: float noise must not decide a tie."""
    return F.round(entropy, 9)
