"""A stored BM25 index: segments of posting blocks in buckets of term hashes, under a snapshot of the segments in force.

A segment is what one add() brings: posting blocks (bucket, term, parts, block, n, max_tf, min_dl, entries of key, tf and dl), terms
(term, df) and documents (key, dl). Files of a segment are in folders by bucket and sorted by term, so a search opens the
buckets of its terms only and skips row groups by their terms. A term's blocks are dealt by key hash, about BLOCK entries
each, which keeps a term that every document has from being one task's or one row's. Adding documents writes a segment
and moves the pointer; nothing is rebuilt. A document whose key is in the index isn't added again.

Blocks that can't matter to a query's k-th score are left out: max_tf and min_dl bound a block's scores whatever the mean
length is, and terms that together stay below that score are looked up only in the blocks of the other terms' documents.
That holds where no idf is negative and some document has none of the query's terms (its score 0 is then the least);
other queries read all their blocks.

Defined cases: null keys and texts without words have no postings but count as documents; null keys are kept out; rows that
repeat a key within one add() are an error of the caller and are counted as one document each; an empty index gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corvane.functions.text import words
from corvane.operators import retrieval as R
from corvane.sources.sinks import read_snapshot, write_snapshot

BUCKETS, BLOCK = 64, 4096
MANIFEST = StructType().add("segment", "string").add("n", "long").add("dl", "long").add("buckets", "integer")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def add(docs: DataFrame, root: str, key: str, text: str = "text", tokenizer: Callable[[Column], Column] = words, buckets: int = BUCKETS, block: int = BLOCK) -> int:
    """Adds the rows of docs whose key the index doesn't have, and returns how many these are. The tokenizer is the index's own from its first add() on."""
    spark = docs.sparkSession
    manifest = read_snapshot(spark, root, MANIFEST)
    held = [r.segment for r in manifest.collect()]  # a row for each add()
    fresh = docs.filter(F.col(key).isNotNull()).select(key, text)
    if held:
        fresh = fresh.join(documents(spark, root).select(key), key, "left_anti")
    path = f"{root}/segment-{uuid.uuid4().hex}"
    tokens = fresh.select(key, tokenizer(F.col(text)).alias("_w")).withColumn("dl", F.greatest(F.coalesce(F.size("_w"), F.lit(0)), F.lit(0)).cast("bigint"))
    tokens.select(key, "dl", "_w").write.parquet(f"{path}/documents")  # with their words, which are read again for the postings
    tokens = spark.read.parquet(f"{path}/documents")
    n, dl = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    if not n:
        return 0
    posted = tokens.select(key, "dl", F.explode("_w").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))
    posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
    parts = spark.read.parquet(f"{path}/terms").filter(F.col("df") > block).select("term", F.expr(f"1 + df div {block}").alias("_parts"))
    dealt = posted.join(F.broadcast(parts) if parts.count() <= 20_000 else parts, "term", "left")
    dealt = dealt.withColumn("parts", F.coalesce("_parts", F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).withColumn("bucket", _bucket(F.col("term"), buckets))
    packed = dealt.groupBy("bucket", "term", "parts", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(F.struct(F.col(key), "tf", "dl")).alias("entries")
    )
    packed.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    row = spark.createDataFrame([(path, n, dl, buckets)], MANIFEST)
    write_snapshot(manifest.unionByName(row).coalesce(1), root)
    return n


def segments(spark: SparkSession, root: str) -> list:
    """The segments in force: one short row for each add()."""
    return read_snapshot(spark, root, MANIFEST).collect()


def _read(spark: SparkSession, found: list, part: str) -> DataFrame:
    frames = [spark.read.parquet(f"{s.segment}/{part}") for s in found]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def documents(spark: SparkSession, root: str) -> DataFrame:
    """key and dl of the indexed documents."""
    return _read(spark, segments(spark, root), "documents").drop("_w")


def postings(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """Posting blocks of the terms (one column, term): only their buckets' folders are read."""
    found = segments(spark, root)
    buckets = sorted(r[0] for r in terms.select(_bucket(F.col("term"), found[0].buckets)).distinct().collect())  # as many as there are buckets, at most
    blocks = _read(spark, found, "postings").filter(F.col("bucket").isin(buckets))
    return blocks.join(F.broadcast(terms) if R._stated(terms) else terms, "term", "left_semi")


def idf(spark: SparkSession, root: str) -> DataFrame:
    """term, df, n, avgdl and idf of every term of the index."""
    found = segments(spark, root)
    terms = _read(spark, found, "terms")
    terms = terms if len(found) == 1 else terms.groupBy("term").agg(F.sum("df").alias("df"))
    n, dl = sum(s.n for s in found), sum(s.dl for s in found)
    return R._idf(terms, spark.createDataFrame([(n, dl / n)], "n bigint, avgdl double"))


def _kept(blocks: DataFrame, wanted: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """blocks (with idf, n, avgdl) for each query, without those that can't reach its k-th score; _times is the term's in the query."""
    asked = blocks.join(wanted, "term")
    part = lambda tf, dl: F.col("times") * F.col("idf") * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * dl / F.col("avgdl")))
    bounded = asked.withColumn("_most", part(F.col("max_tf"), F.col("min_dl")))
    by_term = bounded.groupBy(qkey, "term").agg(F.max("_most").alias("_t"), F.min("idf").alias("_idf"), F.sum("n_block").alias("_df"), F.max("n").alias("_n"))
    by_query = by_term.groupBy(qkey).agg(F.sum("_t").alias("_all"), F.min("_idf").alias("_least"), F.sum("_df").alias("_matched"), F.max("_n").alias("_n"))
    # What the rarest term alone gives to its documents: the k-th of these is a score that k documents reach.
    safe = by_query.filter("_least >= 0 AND _matched < _n").select(qkey, "_all")
    rare = bounded.join(safe, qkey).withColumn("_r", F.dense_rank().over(Window.partitionBy(qkey).orderBy(F.desc("idf"), "term"))).filter("_r = 1")
    scored = rare.select(qkey, "times", "idf", "avgdl", F.explode("entries").alias("e")).withColumn("_s", part(F.col("e.tf"), F.col("e.dl")))
    floor = R.top_k(scored, [qkey], [F.desc("_s"), F.col(f"e.{key}")], k, "_r").filter(F.col("_r") == k).select(qkey, F.col("_s").alias("_floor"))
    limits = safe.join(floor, qkey)
    limits = safe.join(floor, qkey)
    # Terms whose greatest parts together stay below that score bring no document in by themselves.
    weak = F.coalesce(F.sum("_t").over(Window.partitionBy(qkey).orderBy("_t", "term")) < F.col("_floor") - 1e-9, F.lit(False))
    ranked = by_term.select(qkey, "term", "_t").join(limits, qkey, "left").withColumn("_weak", weak)
    told = bounded.join(ranked, [qkey, "term"])
    hopeless = F.coalesce(F.col("_all") - F.col("_t") + F.col("_most") < F.col("_floor") - 1e-9, F.lit(False))
    strong = told.filter(~F.col("_weak") & ~hopeless)
    # Of the others' blocks those that a document of the strong terms falls into.
    asking = told.filter("_weak").select(qkey, "term", "parts").distinct()
    near = strong.join(asking.select(qkey).distinct(), qkey, "left_semi").select(qkey, F.explode(F.col(f"entries.{key}")).alias("_key")).distinct()
    needed = near.join(asking, qkey).select(qkey, "term", "parts", F.pmod(F.xxhash64("_key"), F.col("parts")).cast("int").alias("block")).distinct()
    rest = told.filter("_weak").join(needed, [qkey, "term", "parts", "block"], "left_semi")
    return strong.unionByName(rest.select(strong.columns)).drop("_most", "_t", "_all", "_floor", "_weak")


def search(queries: DataFrame, root: str, qkey: str, key: str, k: int = 15, text: str = "text", tokenizer: Callable[[Column], Column] = words, skip: bool = True) -> DataFrame:
    """qkey, key, score and rank of each query's k best documents of the index, as bm25() over its documents gives them.

    skip: whether blocks that can't reach the k-th score are left out."""
    spark = queries.sparkSession
    if not segments(spark, root):
        return spark.createDataFrame([], StructType([queries.schema[qkey]])).selectExpr(qkey, f"CAST(NULL AS bigint) AS {key}", "0.0D AS score", "0L AS rank")
    wanted = queries.select(qkey, F.explode(tokenizer(F.col(text))).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("times"))
    terms = wanted.select("term").distinct()
    blocks = postings(spark, root, terms).withColumnRenamed("n", "n_block").join(idf(spark, root), "term")
    asked = _kept(blocks, wanted, qkey, key, k) if skip else blocks.join(wanted, "term")
    hits = asked.select(qkey, "times", "idf", "n", "avgdl", F.explode("entries").alias("e")).select(qkey, "times", "idf", "n", "avgdl", "e.*")
    return R.rank_bm25(hits, queries, documents(spark, root).select(key), qkey, key, k)
