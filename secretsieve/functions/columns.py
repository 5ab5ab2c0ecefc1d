"""Plan-shaping helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a dear column that is computed exactly once per row.

    A filter on a plain projected column moves below the projection and brings
    a copy of the whole expression along, one for each mention.  A filter on a
    generated column stays above its generator, so the value comes out of a
    one-element array.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def text_array(items: list[str]) -> Column:
    """A constant array of texts, folded when the query is planned.  One call
    instead of one per item keeps long lists cheap to build."""
    return F.split(F.lit("\n".join(items)), "\n")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
