"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def append_hits(hits: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append scan hits as Parquet; a task commits all its rows or none.

    With a ``run_id`` the rows go to a partition of that name, which a repeated run replaces, so it leaves
    one copy; other runs stay as they are.  (A repeated run without rows replaces nothing.)"""
    if run_id is None:
        hits.write.mode("append").parquet(path)
        return
    hits.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_with_progress(scored: DataFrame, path: str, guess: str = "predicted_label") -> dict[str, int]:
    """Write scored rows and return how many there are in total, done and still open, counted by the write itself."""
    seen = Observation("progress")
    counts = F.count(F.lit(1)).alias("total"), F.count(guess).alias("done"), F.count_if(F.col(guess).isNull()).alias("remaining")
    scored.observe(seen, *counts).write.mode("overwrite").parquet(path)
    return seen.get


def append_csv(df: DataFrame, path: str) -> None:
    """Append as CSV with quotes doubled, the way :func:`read_csv_dataset` reads it.

    CSV knows no difference between an empty text and a missing one: both read as NULL.
    """
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": True,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("append").options(**options).csv(path)


def write_by_error(tagged: DataFrame, path: str) -> None:
    """Predictions in one folder per kind of error."""
    tagged.write.mode("overwrite").partitionBy("error_type").parquet(path)


def write_by_split(dataset: DataFrame, path: str) -> None:
    dataset.write.mode("overwrite").partitionBy("split").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A small report as JSON lines."""
    summary.coalesce(1).write.mode("overwrite").json(path)
