"""Spark session and shared folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


_FOLDERS: list[str] = []


def build_session(app: str = "secretsieve", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution.  Pass further settings with
    ``__`` for dots, e.g. ``spark__driver__memory="8g"``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session may go without that setting; it then gets a
    temporary folder of its own, which goes when the process ends.  Folders under a
    given path go with :func:`remove_folders`.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="secretsieve-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def remove_folders(spark: SparkSession) -> None:
    """Delete the shared folders of this process, once their tables are no longer read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _FOLDERS:
        path = hadoop.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def land(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table that is read several times to the shared folder and read it back."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
