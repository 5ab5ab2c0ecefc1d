"""Builds the labelled data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.text import clean_if_missing
from ..operators import dataset, extract, relational


def build_dataset(positive: list[DataFrame], negative: list[DataFrame], seed: int = dataset.SEED) -> DataFrame:
    """Parts with candidate_string and body become labelled rows with a split.

    Union, label, cleaning of texts without their candidate, containment
    filter and hash split are all projections: no shuffle before the write.
    """
    labelled = [
        relational.with_label_and_id(
            relational.as_text_table(relational.union_parts(*parts)), label, ["candidate_string", "text"]
        )
        for label, parts in ((1, positive), (0, negative))
    ]
    rows = relational.clean_labelled(relational.union_parts(*labelled))
    cleaned = once(rows, "_clean", clean_if_missing(F.col("text"), F.col("candidate_string")))
    cleaned = cleaned.withColumn("text", F.col("_clean")).drop("_clean")
    return dataset.add_split(extract.keep_contained(cleaned), "issue_id", seed)
