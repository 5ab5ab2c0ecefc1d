"""Reading data sets, pattern catalogs, URL lists and metadata."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex import spark_regex, strip
from ..operators.extract import Rule
from ..schemas import ISSUE_META, LABELLED, REPO


def read_csv_dataset(spark: SparkSession, path: str, schema: T.StructType = LABELLED) -> DataFrame:
    """CSV with a header whose texts may hold line breaks and doubled quotes.

    Columns are found by their header, ignoring case, whatever their order; others (such as a
    leading index) are not read.  A value that does not fit its type is NULL.  Such a file cannot be split, so
    land it as Parquet once (see ``sinks``) and give large sets as many files.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    rows = spark.read.options(**options).csv(path)
    places = {name.lower(): i for i, name in reversed(list(enumerate(rows.columns)))}
    missing = [f.name for f in schema if f.name.lower() not in places]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    rows = rows.toDF(*[f"_c{i}" for i in range(len(rows.columns))])
    return rows.select(*[F.col(f"_c{places[f.name.lower()]}").try_cast(f.dataType).alias(f.name) for f in schema])


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by file extension; anything but CSV, JSON (lines or arrays) and Parquet is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv_dataset(spark, path, schema or LABELLED)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, schema)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def clean_catalog(catalog: DataFrame, order: str = "pattern_id") -> DataFrame:
    """Rules without a pattern go, names and patterns are trimmed, a rule without
    a name is called after its place in the file.  Ranks follow ``order``.

    A catalog is short, so one task may number it.
    """
    place = F.row_number().over(W.orderBy(order))
    name = F.nullif(strip(F.col("secret_type")), F.lit(""))
    return (
        catalog.withColumn("_place", place)
        .withColumn("secret_type", F.coalesce(name, F.concat(F.lit("Pattern_"), F.col("_place").cast("string"))))
        .withColumn("pattern", strip(F.col("pattern")))
        .filter(F.col("pattern").isNotNull() & (F.col("pattern") != ""))
        .withColumn("pattern_rank", F.row_number().over(W.orderBy("_place")))
        .select("pattern_rank", "secret_type", "pattern")
    )


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's own regex engine accepts the pattern."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def java_pattern(pattern: str) -> str:
    """A catalog's pattern in the dialect of Spark's matcher: named groups, the end of the
    text and the Unicode classes are spelled differently."""
    names = lambda m: f"{m[1]}{m[2].replace('_', '')}{m[3]}"  # names have no underscores there
    pattern = re.sub(r"\(\?P(<)(\w+)(>)", lambda m: "(?" + names(m), pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)
    return spark_regex(re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", pattern))


def load_rules(catalog: DataFrame, order: str = "pattern_id") -> list[Rule]:
    """The usable rules of a catalog, in order, translated; patterns that do not compile are skipped.

    A catalog is a configuration: its patterns become literals of a projection.
    """
    rows = clean_catalog(catalog, order).orderBy("pattern_rank").collect()
    rules = [Rule(r["secret_type"], java_pattern(r["pattern"])) for r in rows]
    return [r for r in rules if compiles(catalog.sparkSession, r.pattern)]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file (CSV): Pattern_ID, Secret Type, Regular Expression."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("Pattern_ID", "Secret Type", "Regular Expression")])
    return read_csv_dataset(spark, path, schema).toDF("pattern_id", "secret_type", "pattern")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines and repeats go."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).filter("url <> ''").distinct()


def json_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files that hold one array each, and the others, by the first character that is not blank.

    A file's first character comes from its least block and line; a row per file reaches the driver, as in any listing."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.substring(strip(F.col("value")), 1, 1).alias("first"),
    )
    kinds = lines.filter("first <> ''").groupBy("file").agg((F.min_by("first", "at") == "[").alias("array")).collect()
    found = {array: sorted(unquote(r["file"]) for r in kinds if r["array"] == array) for array in (True, False)}
    return found[True], found[False]


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or files that hold one array each (which cannot be split); a folder may have both."""
    reader = lambda: spark.read.schema(schema) if schema else spark.read
    arrays, lines = json_files(spark, path)
    if arrays and lines:
        both = reader().option("multiLine", True).json(arrays), reader().json(lines)
        return both[0].unionByName(both[1], allowMissingColumns=True)
    return reader().option("multiLine", bool(arrays)).json(path)


def _read_json_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return read_json(spark, path, schema).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """Repository metadata; no rows if there is no file.  The size in KB may be called ``size``."""
    rows = _read_json_or_empty(spark, path, T.StructType([*REPO.fields, T.StructField("size", T.LongType())]))
    return rows.withColumn("size_kb", F.coalesce("size_kb", "size")).select(*REPO.names)


def read_issue_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Issue metadata; a time stamp that does not parse becomes NULL."""
    issues = _read_json_or_empty(spark, path, ISSUE_META)
    return issues.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ("created_at", "updated_at", "closed_at")})
