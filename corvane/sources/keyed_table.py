"""A stored table with one row for each key, upserted copy-on-write by hash buckets under a snapshot pointer.

A bucket is a folder of its own and the snapshot in force says which folders are the buckets now. An upsert finds the rows that
win over the stored ones, rewrites the buckets that hold at least one of them and leaves the others' files alone, so that a load
that is repeated rewrites nothing. Readers see the old snapshot or the new one; a job that fails leaves the old one in force.

The last writer wins: the row with the greatest (seq, other columns in order), whether it is stored or new, so that the order of
loads doesn't matter. Defined cases: rows with a null key are kept out; a null seq is the least; an upsert of no rows writes no
snapshot; a table that was never written reads as empty; the columns are those of the first load, and another load needs them all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.sources.sinks import _path, read_snapshot, write_snapshot

#: Buckets of a new table. A stored table keeps its own number; large buckets are of several files.
BUCKETS = 64
MANIFEST = StructType().add("bucket", "integer").add("path", "string").add("buckets", "integer")


def _manifest(spark: SparkSession, root: str) -> tuple[dict[int, str], int | None]:
    rows = read_snapshot(spark, root, MANIFEST).collect()  # as many as there are buckets
    return {r.bucket: r.path for r in rows}, rows[0].buckets if rows else None


def _stored(spark: SparkSession, paths: dict[int, str], schema: StructType) -> DataFrame:
    """The rows of these folders, in one scan."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[paths[b] for b in sorted(paths)])


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _sweep(spark: SparkSession, root: str, named: set[str]) -> None:
    """Deletes folders that neither the snapshot in force nor the one before names."""
    p, fs = _path(spark, root)
    for load in fs.listStatus(p):
        if load.getPath().getName().startswith("data-"):
            left = [b.getPath() for b in fs.listStatus(load.getPath()) if b.isDirectory()]
            gone = [b for b in left if f"{root}/{load.getPath().getName()}/{b.getName()}" not in named]
            for b in gone:
                fs.delete(b, True)
            if len(gone) == len(left):
                fs.delete(load.getPath(), True)


def upsert(rows: DataFrame, root: str, keys: list[str], seq: str, *, buckets: int = BUCKETS) -> list[int]:
    """Merges rows into the table at root and returns the buckets that were rewritten, none where nothing won."""
    spark = rows.sparkSession
    now, stored_buckets = _manifest(spark, root)
    n = stored_buckets or buckets
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    if stored_buckets:
        held = spark.read.parquet(next(iter(now.values())))  # the columns' order is the stored one
        rest = [c for c in held.columns if c not in (*keys, seq)]
    version = F.struct(seq, *rest)
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    last = rows.filter(known).groupBy(*keys).agg(F.max(version).alias("_v"))
    load = f"{root}/data-{uuid.uuid4().hex}"
    # Written once: the loads' plan isn't run again for the comparison and for the rewrite.
    last.withColumn("bucket", _bucket(keys, n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{load}/staged")
    shape = last.schema
    staged, fs = _path(spark, f"{load}/staged")
    touched = [int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(staged) if "=" in p.getPath().getName()]
    if touched:
        fresh = spark.read.schema(StructType([*shape.fields, MANIFEST["bucket"]])).parquet(f"{load}/staged")
        table = StructType([*[shape[k] for k in keys], *shape["_v"].dataType.fields])
        held = _stored(spark, {b: now[b] for b in touched if b in now}, table)
        old = held.select(*keys, F.struct(seq, *rest).alias("_old"))
        wins = fresh.join(old, keys, "left").filter(F.col("_old").isNull() | (F.col("_v") > F.col("_old")))
        changed = sorted(r[0] for r in wins.select("bucket").distinct().collect())  # as many as there are buckets
    else:
        changed = []
    if changed:
        merged = fresh.filter(F.col("bucket").isin(changed)).select(*keys, "_v")
        before = _stored(spark, {b: now[b] for b in changed if b in now}, table).select(*keys, F.struct(seq, *rest).alias("_v"))
        best = merged.unionByName(before).groupBy(*keys).agg(F.max("_v").alias("_v"))
        best = best.select(*keys, "_v.*").withColumn("bucket", _bucket(keys, n))
        best.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{load}/rows")
        for b in changed:  # a bucket's folder lies beside the others, by a name that holds for all loads
            fs.rename(_path(spark, f"{load}/rows/bucket={b}")[0], _path(spark, f"{load}/b{b}")[0])
        after = now | {b: f"{load}/b{b}" for b in changed}
        write_snapshot(spark.createDataFrame([(b, p, n) for b, p in sorted(after.items())], MANIFEST).coalesce(1), root)
        named = set(now.values()) | set(after.values())
    else:
        named = set(now.values())
    _sweep(spark, root, named)
    return changed


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rows in force."""
    return _stored(spark, _manifest(spark, root)[0], schema)


def look_up(spark: SparkSession, root: str, schema: StructType, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose keys are among wanted's: only their buckets' folders are opened."""
    now, n = _manifest(spark, root)
    if n is None:
        return spark.createDataFrame([], schema)
    asked = {r[0] for r in wanted.select(_bucket(keys, n)).distinct().collect()}  # as many as there are buckets
    return _stored(spark, {b: p for b, p in now.items() if b in asked}, schema).join(wanted.select(*keys), keys, "left_semi")
