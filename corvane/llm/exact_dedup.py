"""Exact dedup as a stateful stream.

A structured stream reads the files once. Its keyed state (RocksDB, no watermark, so nothing expires) holds for
each digest of the normalised text the stable identifier and the content locator (file, row) of the row to keep,
and the group's size. Partial aggregation collapses copies before the shuffle, so a digest that holds a third of
all rows costs each task one row. Digests that were hit more than once are then checked byte by byte: the texts
behind them are grouped by (digest, text); a digest with two texts is a collision and is split by text.

Defined cases: a null text counts as empty; a null doc_id is below every other; of rows with equal text and equal
doc_id the one with the greatest (file, row) stays, so each class keeps one row; an empty table gives no rows;
other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, put, scratch, small

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state reserves some MB of disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
STATE_SCHEMA = "digest binary, keep struct<id:bigint,file:string,row:bigint>, n bigint, batch bigint"


def _keyed(df: DataFrame, digest_bytes: int) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    sha = F.sha2(norm, 256)
    return df.select(
        F.col("doc_id"), norm.alias("norm"), sha.alias("sha"), F.unhex(F.substring(sha, 1, 2 * digest_bytes)).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def dedup_state(spark: SparkSession, path: str, digest_bytes: int = 32, batch_bytes: int = 64 << 30) -> DataFrame:
    """Runs the stream over the files now in path and returns its final state: digest, keep (id, file, row), n.

    digest_bytes: bytes of SHA-256 that key the state. batch_bytes: input of one micro-batch."""
    out, state = scratch(spark, "dedup-updates"), scratch(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        # As a glob, since a stream takes a single file in no other way.
        stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(f"{path[:-1]}[{path[-1]}]")
        rows = _keyed(stream, digest_bytes)
        seen = rows.groupBy("digest").agg(F.max(F.struct(F.col("doc_id").alias("id"), "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        run = (
            seen.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
            .foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k).cast("bigint")).write.mode("overwrite").parquet(f"{out}/updates-{k}"))
            .start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    batches = 1 + max([-1, *(p["batchId"] for p in run.recentProgress if p["numInputRows"])])
    if not batches:
        return spark.createDataFrame([], STATE_SCHEMA).drop("batch")
    updates = spark.read.schema(STATE_SCHEMA).parquet(*[f"{out}/updates-{k}" for k in range(batches)])
    if batches == 1:
        return updates.drop("batch")
    return updates.groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("last")).select("digest", "last.keep", "last.n")


def classes(spark: SparkSession, path: str, digest_bytes: int = 32, batch_bytes: int = 64 << 30) -> DataFrame:
    """One row for each row of the Parquet files in path: file, row, doc_id, keep_id, group_size, kept, text_sha256."""
    hits = put(dedup_state(spark, path, digest_bytes, batch_bytes).filter("n > 1"), "dedup-hits")
    rows = _keyed(spark.read.parquet(path), digest_bytes)
    # Full bytes of every hit; copies collapse before the shuffle, and a class comes out as one row for each text.
    texts = rows.join(small(hits.select("digest")), "digest", "left_semi").groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    split = put(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-collisions")
    narrow = rows.drop("norm")
    if not split.isEmpty():
        odd = rows.join(split, "digest", "left_semi")
        keep = odd.groupBy("digest", "norm").agg(F.max(F.struct(F.col("doc_id").alias("id"), "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
        odd = odd.join(keep, ["digest", "norm"]).drop("norm")
        hits, narrow = hits.join(split, "digest", "left_anti"), narrow.join(split, "digest", "left_anti")
    joined = narrow.join(hits, "digest", "left")
    if not split.isEmpty():
        joined = joined.unionByName(odd)
    return joined.select(
        "file", "row", "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("n").isNull() | ((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. docs is written once, as the locators need files."""
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "dedup-input")
    names = [f"c{i}" for i in range(len(docs.columns))]  # names may clash in case or with ours
    key = {n: names[i] for i, n in enumerate(docs.columns)}
    docs.toDF(*names).withColumns({"doc_id": F.col(key["doc_id"]), "text": F.col(key["text"])}).drop(key["doc_id"], key["text"]).write.option("compression", "zstd").parquet(path)
    gone = classes(spark, path).filter("not kept").select("file", "row")
    staged = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
    kept = staged.join(gone, ["file", "row"], "left_anti")
    return kept.select(*[F.col({"doc_id": "doc_id", "text": "text"}.get(n, key[n])).alias(n) for n in docs.columns])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


ORACLE = {
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
}
QUERIES = {"op8_exact_dedup": op8_exact_dedup}
