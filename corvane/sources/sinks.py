"""Sinks: versioned snapshots behind a pointer, appended logs, and evaluation runs of which the last whole one is `latest`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: No name that begins with _ or a dot, which Spark's readers pass over.
POINTER = "current"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, root: str, version: str) -> None:
    """The pointer is written beside and renamed over the old one, so a reader sees either the old version or the new."""
    fresh, fs = _path(spark, f"{root}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(fresh, _path(spark, f"{root}/{POINTER}")[0], options)


def pointed(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names, if there is one and its folder is whole."""
    p, fs = _path(spark, f"{root}/{POINTER}")
    if not fs.exists(p):
        return None
    version = spark.read.text(f"{root}/{POINTER}", wholetext=True).first()
    done = _path(spark, f"{root}/{version[0]}/_SUCCESS")[0] if version and version[0] else None
    return version[0] if done is not None and fs.exists(done) else None


def write_snapshot(df: DataFrame, root: str, *, keep: int = 2) -> str:
    """Writes df as a new version of root and then moves the pointer; a job that fails leaves the old version in place.

    Versions before the last `keep` are deleted: a reader of the one just replaced can end."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    _point(spark, root, version)
    p, fs = _path(spark, root)
    old = sorted((s for s in fs.listStatus(p) if s.getPath().getName().startswith("v-") and s.getPath().getName() != version), key=lambda s: -s.getModificationTime())
    for status in old[keep - 1 :]:
        fs.delete(status.getPath(), True)
    return version


def read_snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The version in force; without one, or if it isn't whole, an empty table of that schema."""
    version = pointed(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{version}") if version else spark.createDataFrame([], schema)


def append_log(df: DataFrame, path: str, stamp: str = "ts") -> None:
    """Adds rows (feedback, requests) to a log of JSON lines in folders by day; what is there stays."""
    df.withColumn("day", F.to_date(stamp)).write.mode("append").partitionBy("day").json(path)


def save_run(metrics: DataFrame, root: str, run: str, *, partial: bool) -> None:
    """Keeps the metrics of an evaluation run; only a whole one becomes the latest."""
    told = metrics.withColumns({"run": F.lit(run), "partial": F.lit(partial)})
    version = f"run-{run}"
    told.write.parquet(f"{root}/{version}")
    if not partial:
        _point(metrics.sparkSession, root, version)
