"""Listwise reranking by a text generator, which is a plug-in, and the whole chain from three paths to the rows an answer rests on.

Defined cases: a query without hits has no rows; no more candidates than are wanted stay as they are; an answer that fails, is blank or names no
candidate leaves the order of fusion; what an answer doesn't name follows in that order; a null text is an empty one."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import retrieval as R
from corvane.operators.variants import Generator, generate

#: Candidates that are shown, characters of each.
POOL, DOC_CHARS = 15, 400
#: Hits of each path, as a multiple of the rows wanted.
FACTORS = {"vector": 5, "bm25": 5, "graph": 3}


def prompts(hits: DataFrame, questions: DataFrame, qkey: str, question: str, template: str, pool: int = POOL, chars: int = DOC_CHARS) -> DataFrame:
    """qkey, n and prompt: the first candidates (hits: qkey, rank, text) as numbered lines, from 0. template has {query} and {docs}.

    A query's list is its pool, a bounded one. The template is parted at its places, so that a text that has a place's name in it stays as it is."""
    snippet = F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, chars)
    listed = hits.filter(F.col("rank") <= pool).groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", snippet.alias("snippet")))).alias("_l"))
    lines = F.array_join(F.transform("_l", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x["snippet"])), "\n")
    before, after = template.split("{query}")
    middle, end = after.split("{docs}")
    told = F.concat(F.lit(before), F.coalesce(question, F.lit("")), F.lit(middle), lines, F.lit(end))
    return listed.join(questions.select(qkey, question), qkey).select(qkey, F.size("_l").alias("n"), told.alias("prompt"))


def rerank(hits: DataFrame, questions: DataFrame, qkey: str, key: str, question: str, template: str, generator: Generator, k: int = 3, pool: int = POOL, chars: int = DOC_CHARS) -> DataFrame:
    """hits (qkey, key, score, rank, text), numbered anew in order of rank, with their new rank, the k best of each query, and outcome: short where no more than k
    were there, else what became of the answer (ok, kept, error)."""
    hits = R.top_k(hits.withColumnRenamed("rank", "_before"), [qkey], [F.asc("_before"), F.asc(key)], pool).drop("_before")
    sized = hits.filter(F.col("rank") <= pool).groupBy(qkey).agg(F.count(F.lit(1)).alias("_n"))
    long = sized.filter(F.col("_n") > k).select(qkey)
    asked = prompts(hits.join(long, qkey, "left_semi"), questions, qkey, question, template, pool, chars)
    told = generate(asked.withColumn("_none", F.lit("")), "prompt", "_none", generator)
    order = R.parse_ranking(F.col("text"), F.col("n"), 0)
    places = told.select(qkey, "outcome", F.posexplode(order).alias("_new", "_at")).select(qkey, "outcome", (F.col("_new") + 1).cast("bigint").alias("_new"), (F.col("_at") + 1).alias("rank"))
    placed = hits.join(places, [qkey, "rank"], "left").withColumn("rank", F.coalesce("_new", "rank")).withColumn("outcome", F.coalesce("outcome", F.lit("short"))).drop("_new")
    return placed.filter(F.col("rank") <= k)


def retrieve(
    paths: DataFrame, weights: DataFrame | None, queries: DataFrame, rows: DataFrame, parents: DataFrame, qkey: str, key: str, k: int = 3, *,
    template: str | None = None, generator: Generator | None = None, vectors: DataFrame | None = None, similar: float = 0.85, factors: dict[str, int] = FACTORS, pool: int = POOL,
) -> DataFrame:
    """qkey, key, parent, score, rank and outcome: paths (qkey, key, path, score, rank), each cut to its multiple of k, are fused by weights (by reciprocal
    ranks where there are none), freed of hits that mean the same (vectors: key, embedding; a hit without one stays), boosted by labels, reranked by the generator
    where one is given and more than k are left, gathered by parent, and cut to k.

    queries: qkey, question, query_labels. rows: key, labels, parent, text. parents: parent, text. As long as a query's lists are cut, they're at most the
    sum of its paths' multiples."""
    most = sum(factors.values()) * k
    within = F.coalesce(*[F.when(F.col("path") == p, F.col("rank") <= f * k) for p, f in factors.items()])
    cut = paths.filter(within).select(qkey, key, "path", "score")
    fused = R.rrf(cut, qkey, key, most) if weights is None else R.weighted_fusion(cut, weights, qkey, key, most)
    if vectors is not None:
        placed = fused.join(vectors.select(key, "embedding"), key)
        kept = R.semantic_dedup(placed, qkey, key, limit=similar).select(qkey, key)
        fused = fused.join(placed.select(qkey, key).join(kept, [qkey, key], "left_anti"), [qkey, key], "left_anti")
    labelled = rows.join(R.few(fused.drop("rank").join(queries.select(qkey, "query_labels"), qkey), queries), key)
    boosted = R.entity_boost(labelled, "query_labels", "labels").select(qkey, key, "score", "parent", "text")
    order = [F.desc(F.round("score", 9)), F.asc(key)]
    ranked = R.top_k(boosted, [qkey], order, most).persist(StorageLevel.MEMORY_AND_DISK)  # read for prompts, places and parents; a query's share is bounded
    if generator is not None and template is not None:
        ranked = rerank(ranked, queries, qkey, key, "question", template, generator, k, pool)
    else:
        ranked = ranked.withColumn("outcome", F.lit("fusion"))
    asked = ranked.select("parent").distinct()
    parents = parents.join(R.few(asked, queries), "parent", "left_semi")
    grown = R.expand_parents(ranked, parents, qkey, key, "parent")
    out = R.top_k(grown.withColumnRenamed("rank", "_before"), [qkey], [F.asc("_before")], k)
    return out.select(qkey, key, "parent", "score", "rank", "outcome", "text")
