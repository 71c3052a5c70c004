"""A stored vector index by lists of near vectors: centroids fitted on a bounded sample, files by list, upserts by id.

The centroids are fitted by spherical k-means on SAMPLE rows, those with the least key hashes; every row is assigned to its
nearest one in the row, by a product with the matrix of centroids, which a parameter bounds. A list is a folder of its own;
the snapshot in force says which folders are the lists now. An upsert rewrites the lists that get rows or lose rows with
the same ids and leaves the others' files alone; searches open the folders of the probed lists only.

Defined cases: rows with a null key or a null vector are kept out; rows that repeat a key within an upsert count once, the one
with the greatest vector; a zero vector has score 0 with all; an empty index gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.operators import retrieval as R
from corvane.sources.sinks import read_snapshot, write_snapshot

LISTS, PROBES, SAMPLE, ROUNDS = 16, 13, 20_000, 12
MANIFEST = StructType().add("ivf_list", "integer").add("path", "string")


def fit(rows: DataFrame, key: str, vector: str = "embedding", lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """ivf_list and centroid (of unit length): no more than lists, fitted by one task on sample rows."""

    def kmeans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        held = [np.array(b["v"].tolist(), np.float32) for b in batches if len(b)]
        if not held:
            return
        points = unit(np.concatenate(held))
        # Begins with points far from one another.
        chosen = [0]
        nearest = points @ points[0]
        while len(chosen) < min(lists, len(points)):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, points @ points[chosen[-1]])
        centres = points[chosen]
        for _ in range(rounds):
            own = (points @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            filled = np.bincount(own, minlength=len(centres)) > 0
            centres = np.where(filled[:, None], unit(sums), centres)
        yield pd.DataFrame({"ivf_list": range(len(centres)), "centroid": centres.tolist()})

    drawn = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(F.col(vector).alias("v"))
    return drawn.coalesce(1).mapInPandas(kmeans, "ivf_list int, centroid array<float>")


def nearest_lists(rows: DataFrame, centroids: list, vector: str, n: int = 1) -> DataFrame:
    """rows with ivf_lists, the n nearest of centroids (rows of fit(), bounded by its lists), nearest first."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    matrix, names = [list(c.centroid) for c in centroids], [c.ivf_list for c in centroids]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        centres, ids = np.array(matrix, np.float32), np.array(names)
        for batch in batches:
            if len(batch):
                near = np.argsort(-(np.array(batch[vector].tolist(), np.float32) @ centres.T), axis=1, kind="stable")[:, :n]
                yield batch.assign(ivf_lists=ids[near].tolist())

    return rows.mapInPandas(assign, f"{fields}, ivf_lists array<int>")


def centroids(spark: SparkSession, root: str) -> list:
    return spark.read.parquet(f"{root}/centroids").orderBy("ivf_list").collect()  # as many as there are lists


def create(rows: DataFrame, root: str, key: str, vector: str = "embedding", **fitting: int) -> None:
    """A new index of rows (key, vector)."""
    fit(rows, key, vector, **fitting).write.parquet(f"{root}/centroids")
    upsert(rows, root, key, vector)


def upsert(rows: DataFrame, root: str, key: str, vector: str = "embedding") -> list[int]:
    """Adds rows, in place of those with the same keys, and returns the lists that were rewritten."""
    spark = rows.sparkSession
    manifest = {r.ivf_list: r.path for r in read_snapshot(spark, root, MANIFEST).collect()}  # as many as there are lists
    once = rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(key).agg(F.max(vector).alias(vector))
    path = f"{root}/data-{uuid.uuid4().hex}"
    nearest_lists(once, centroids(spark, root), vector).select(key, vector, F.col("ivf_lists")[0].alias("ivf_list")).write.parquet(f"{path}/new")
    fresh = spark.read.parquet(f"{path}/new")
    changed = {r[0] for r in fresh.select("ivf_list").distinct().collect()}
    merged = fresh
    if manifest:
        held = stored(spark, manifest, sorted(manifest))
        changed |= {r[0] for r in held.join(fresh.select(key), key, "left_semi").select("ivf_list").distinct().collect()}
        if touched := sorted(changed & set(manifest)):
            merged = fresh.unionByName(stored(spark, manifest, touched).join(fresh.select(key), key, "left_anti"))
    merged.repartition("ivf_list").write.partitionBy("ivf_list").parquet(f"{path}/lists")
    left = {r[0] for r in spark.read.parquet(f"{path}/lists").select("ivf_list").distinct().collect()} if changed else set()
    now = {k: p for k, p in manifest.items() if k not in changed} | {k: f"{path}/lists/ivf_list={k}" for k in left}
    write_snapshot(spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1), root)
    return sorted(changed)


def stored(spark: SparkSession, manifest: dict[int, str], lists: list[int]) -> DataFrame:
    """The rows of these lists, from their folders alone."""
    frames = [spark.read.parquet(manifest[k]).withColumn("ivf_list", F.lit(k)) for k in lists]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def search(queries: DataFrame, root: str, qkey: str, key: str, k: int = 15, probes: int = PROBES, vector: str = "embedding") -> DataFrame:
    """qkey, key, score (cosine) and rank of each query's k nearest rows in the lists of its nearest centroids."""
    spark = queries.sparkSession
    manifest = {r.ivf_list: r.path for r in read_snapshot(spark, root, MANIFEST).collect()}
    near = nearest_lists(queries.select(qkey, F.col(vector).alias("_q")).filter("_q IS NOT NULL"), centroids(spark, root), "_q", probes)
    asked = near.select(qkey, "_q", F.explode("ivf_lists").alias("ivf_list"))
    lists = sorted({r[0] for r in asked.select("ivf_list").distinct().collect()} & set(manifest))
    if not lists:
        return spark.createDataFrame([], StructType([queries.schema[qkey]])).selectExpr(qkey, f"CAST(NULL AS bigint) AS {key}", "0.0D AS score", "0L AS rank")
    rows, order = stored(spark, manifest, lists).select(key, "ivf_list", F.col(vector).alias("_v")), [F.desc(F.round("score", 9)), F.asc(key)]
    held = near.limit(R.STATED + 1).toArrow()
    if held.num_rows > R.STATED or held.nbytes > R.STATED_BYTES:  # not a stated set: joined
        return R.top_k(rows.join(asked, "ivf_list").select(qkey, key, R.cosine(F.col("_q"), F.col("_v")).alias("score")), [qkey], order, k)
    probed: dict[int, list[int]] = {}
    for q, own in enumerate(held.column("ivf_lists").to_pylist()):
        for n in own:
            probed.setdefault(n, []).append(q)
    found = R._nearest(rows, np.array(held.column("_q").to_pylist(), float), held.column(qkey).to_pandas(), dict(near.dtypes)[qkey], qkey, key, k, {n: np.array(own) for n, own in probed.items()})
    return R.top_k(found, [qkey], order, k)
