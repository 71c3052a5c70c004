"""Helpers of the training-data operators: scratch tables, text keys, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words everywhere in this package: runs of anything but ASCII white space.
#: Whether the shuffle files of a query go as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local[")
        root = tempfile.mkdtemp(prefix="corvane-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", root if ":" in root else f"file://{root}")
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


#: While a stage of a pipeline runs, the paths that it makes.
_stage: list[str] | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    if _stage is not None:
        _stage.append(path)
    return path


def staged(stage: Callable, made: list[str]) -> Callable:
    """A pipeline's stage that first deletes what the stage before it made: its rows are written by then, and in docs.

    made: a list that the stages of one pipeline share."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _stage
        for path in made:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        made.clear()
        before, _stage = _stage, made
        try:
            return stage(spark, docs, sf_dir)
        finally:
            _stage = before

    return run


def put(df: DataFrame, name: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and returns the table read from there, which cuts the lineage. by: the last columns, for each of whose
    values there is a folder.

    The shuffle files of the write go as it ends: else they stay until the driver happens to collect its garbage, and add up on disk."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by put() that nothing will read again."""
    spark = df.sparkSession
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does just that where every character is ASCII, and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


#: Large things that a Python worker keeps from task to task, by module.
kept: list[dict] = []


def let_go() -> None:
    """Drops what this worker keeps for other operators, and gives unused memory back: stages of a pipeline share an executor's."""
    import ctypes
    import gc

    import pyarrow as pa

    for held in kept:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def file_bytes(df: DataFrame) -> int:
    """The size of the files of df, a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, megabytes: float = 8) -> bool:
    """Whether the files of df, a written table, are no larger than that."""
    return file_bytes(df) <= megabytes * 1e6


def small(df: DataFrame, megabytes: float = 8) -> DataFrame:
    """df, a written table, with a broadcast hint if it is small; else unchanged, and the join shuffles."""
    return F.broadcast(df) if is_small(df, megabytes) else df


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
