"""Declared schemas of the input files."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


LABELLED = _schema(issue_id=StringType(), text=StringType(), candidate_string=StringType(), label=IntegerType())

RAW_ISSUE = _schema(
    html_url=StringType(), title=StringType(), body=StringType(), created_at=TimestampType(),
    repository_url=StringType(), labels=ArrayType(_schema(name=StringType())), score=DoubleType(),
    number=LongType(), pull_request=_schema(url=StringType()),
)

REPO = _schema(
    full_name=StringType(), size_kb=LongType(), stars=LongType(), forks=LongType(), language=StringType(),
    is_fork=BooleanType(), is_archived=BooleanType(),
)

# Time stamps stay text until they are parsed leniently.
ISSUE_META = _schema(
    repo_full_name=StringType(), title=StringType(), labels=ArrayType(StringType()), created_at=StringType(),
    updated_at=StringType(), closed_at=StringType(),
)
