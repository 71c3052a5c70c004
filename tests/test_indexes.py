"""Stored indexes against searches over the whole tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ingest, text_index as T, vector_index as V
from corvane.operators import retrieval as R
from corvane.plans import retrieval_queries as Q

SF = "/root/testdata/sf0.001"


def same(got, want):
    got, want = ({(r.item_id, r.doc_id, r["rank"]): r.score for r in f.collect()} for f in (got, want))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("skip", [True, False])
def test_text_index_agrees_with_bm25(spark, tmp_path, skip):
    docs, queries = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    root = f"file://{tmp_path}/index"
    assert T.search(queries, root, "item_id", "doc_id").count() == 0
    assert T.add(docs.filter("doc_id < 120"), root, "doc_id", block=16) == docs.filter("doc_id < 120").count()
    assert T.add(docs.filter("doc_id >= 100"), root, "doc_id", block=16) == docs.filter("doc_id >= 120").count()
    assert T.add(docs, root, "doc_id") == 0 and len(T.segments(spark, root)) == 2
    same(T.search(queries, root, "item_id", "doc_id", 15, skip=skip), R.bm25(queries, docs, "item_id", "doc_id", 15))


def test_text_index_of_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "a"), (5, ""), (None, "a")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "item_id int, text string")
    root = f"file://{tmp_path}/index"
    assert T.add(docs, root, "doc_id") == 5
    same(T.search(queries, root, "item_id", "doc_id", 3), R.bm25(queries, docs.filter("doc_id IS NOT NULL"), "item_id", "doc_id", 3))


def test_blocks_that_cannot_reach_the_best_are_skipped(spark, tmp_path):
    rows = [(n, "rare common " if n % 50 == 0 else "common " * (1 + n % 3) + "filler " * (n % 40) if n % 3 else "other words") for n in range(2000)]
    docs, root = spark.createDataFrame(rows, "doc_id bigint, text string"), f"file://{tmp_path}/index"
    queries = spark.createDataFrame([(1, "rare common"), (2, "rare")], "item_id int, text string")
    T.add(docs, root, "doc_id", block=20)
    wanted = queries.select("item_id", F.explode(F.split("text", " ")).alias("term")).withColumn("times", F.lit(1))
    blocks = T.postings(spark, root, wanted.select("term").distinct()).withColumnRenamed("n", "n_block").join(T.idf(spark, root), "term")
    kept, every = T._kept(blocks, wanted, "item_id", "doc_id", 10).count(), blocks.join(wanted, "term").count()
    assert kept < every
    same(T.search(queries, root, "item_id", "doc_id", 10), R.bm25(queries, docs, "item_id", "doc_id", 10))


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    T.add(spark.read.parquet(f"{SF}/documents.parquet"), root, "doc_id")
    found = T.postings(spark, root, spark.createDataFrame([("the",)], "term string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    whole = spark.read.parquet(f"{T.segments(spark, root)[0].segment}/postings")
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.select("entries").inputFiles()}) <= len({f.split("bucket=")[1].split("/")[0] for f in whole.inputFiles()})


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_vector_index(spark, sf):
    exact = {(r.q, r.vec_id) for r in Q.vector_topk(spark, sf).collect()}
    found = {(r.q, r.vec_id) for r in Q.vector_topk_ivf(spark, sf).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert {q for q, _ in exact} == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}


def test_upserts_replace_rows_and_leave_other_lists_alone(spark, tmp_path):
    root, rng = f"file://{tmp_path}/vectors", np.random.default_rng(3)
    points = [(n, [float(x) for x in np.eye(6)[n % 6] * 5 + rng.normal(size=6)]) for n in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").drop("label")
    V.create(frame([(*p, "x") for p in points] + [(None, [1.0] * 6, "x"), (999, None, "x")]), root, "vec_id", lists=6)
    before = {r.ivf_list: r.path for r in V.read_snapshot(spark, root, V.MANIFEST).collect()}
    moved = [(0, points[1][1]), (1000, points[1][1])]
    changed = V.upsert(frame([(*p, "x") for p in moved]), root, "vec_id")
    after = {r.ivf_list: r.path for r in V.read_snapshot(spark, root, V.MANIFEST).collect()}
    assert len(changed) == 2 and {k for k in after if after[k] != before[k]} == set(changed)
    rows = V.stored(spark, after, sorted(after)).collect()
    assert sorted(r.vec_id for r in rows) == [*range(300), 1000]
    now = dict(points) | dict(moved)
    queries = frame([(n, now[n], "x") for n in (0, 7, 150)]).withColumnRenamed("vec_id", "q")
    got, want = V.search(queries, root, "q", "vec_id", 5, probes=6), R.dense(queries, frame([(k, v, "x") for k, v in now.items()]), "q", "vec_id", 5)
    key = lambda f: sorted((r.q, r.vec_id, r["rank"], round(r.score, 9)) for r in f.collect())
    assert key(got) == key(want)
    assert all(os.path.exists(p.removeprefix("file://")) for p in after.values())


def test_dimensions_of_the_hashing_embedder():
    with pytest.raises(ValueError):
        ingest.hash_embed(None, 300)
