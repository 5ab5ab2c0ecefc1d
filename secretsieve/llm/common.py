"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secretsieve.session import shared_folder

# Fixed values of the contracts: white space that parts words, and ASCII capitals.
SPACES = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ROWS_PER_BATCH = 1000


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def landed(df: DataFrame, purpose: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back: lineage
    ends there, and a lost executor costs no recomputation.  ``instead_of`` is a landed table that
    nothing reads any more: its files go once the new one is written."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.folder = path
    if instead_of is not None:
        discard(instead_of)
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a landed table; any other table stays as it is."""
    folder, spark = table.__dict__.pop("folder", None), table.sparkSession
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(df: DataFrame) -> None:
    """Texts are long: cap the rows of the session's Arrow batches, which executors hold outside their heap."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS_PER_BATCH:
        conf.set(name, str(ROWS_PER_BATCH))


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    small_batches(df)
    return df.mapInArrow(lambda batches: iter(function(batches)), schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def total(df: DataFrame, value) -> int:
    """One number over a whole table."""
    return int(df.select(F.sum(value)).first()[0] or 0)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
