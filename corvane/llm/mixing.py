"""Mixing sources to target weights.

Sources share a budget by weight; a target stops at a multiple of its source's size and the excess is shared anew.
A source gives complete epochs first. What is left of its target goes to the documents with the smallest
Efraimidis-Spirakis keys, -ln(u) / quality, in order, as far as the sum of their sizes goes.

The order is never sorted as a whole. Keys fall into buckets of equal probability; sums by (source, bucket) tell in
which bucket a source's budget ends. Buckets below it are taken, those above aren't, both without a shuffle, and only
the rows of that one bucket are sorted. A source with a third of all rows is thus no larger a task than any other.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a null source is a source, the last; a
null doc_id draws like an empty id; rows that repeat a doc_id draw the same key and are taken one after another;
null or non-positive qualities count as 1; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD, put, small, table

BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def keyed(docs: DataFrame, quality: Column, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """docs with the columns _id, _source, _size, _key and _bucket."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))
    weight = F.coalesce(F.when(quality > 0, quality), F.lit(1.0)).cast("double")
    return (
        docs.withColumns({"_id": F.col("doc_id"), "_source": F.col("source"), "_size": word_count(F.col("text")), "_key": -F.log(u) / weight})
        .withColumn("_bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("_key"))) * buckets)).cast("int"))
    )


def plan(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row for each source: _source, source_size, target, _epochs, _rest (words beyond the epochs), and the bucket _edge
    in which _rest ends, with the words _before it."""
    filled = put(sized.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words")), "mix-buckets")
    by_source = filled.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    # A window over all sources: one short row for each of them.
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    # Water level: with the sources in order of cap / weight, the level if those before are full and the others share the rest is greatest at the true one.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    remaining = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / remaining
    targets = (
        ranked.withColumn("_level", level).withColumn("target", F.least(F.col("_cap"), F.max("_level").over(everything) * F.col("_w")))
        .withColumn("_whole", F.floor("target").cast("bigint"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_whole") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("_rest", F.col("_whole") - F.col("_epochs") * F.col("source_size"))
    )
    running = filled.withColumn("_upto", F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    edges = (
        running.join(targets.select(F.col("_source").alias("_s"), "_rest"), F.col("_source").eqNullSafe(F.col("_s"))).filter("_upto > _rest")
        .groupBy("_s").agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_words")).alias("_b"))).alias("_e"))
    )
    return targets.join(edges, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_source").alias("_of"), "source_size", "target", "_epochs", "_rest", F.col("_e._bucket").alias("_edge"), F.col("_e._b").alias("_before")
    )


def decide(rows: DataFrame, plan_: DataFrame, boundary: str = "cut") -> DataFrame:
    """rows (from keyed()) with source_size, target, _epochs and _part, the words taken beyond the complete epochs.

    boundary: "cut" takes as many words of the document in which a budget ends as fit; "whole" takes it whole if at least half fits."""
    joined = rows.join(small(plan_), F.col("_source").eqNullSafe(F.col("_of")))
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    clear = joined.filter(~at_edge).withColumn("_part", F.when(F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)), F.col("_size")).otherwise(F.lit(0)).cast("bigint"))
    order = Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("_size").over(order), F.lit(0))
    fits = F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_left")))
    if boundary == "whole":
        fits = F.when((F.col("_left") > 0) & (2 * F.col("_left") >= F.col("_size")), F.col("_size")).otherwise(F.lit(0))
    edge = joined.filter(at_edge).withColumn("_left", left).withColumn("_part", fits.cast("bigint")).drop("_left")
    return clear.unionByName(edge)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with _quality: 2 for documents labelled good, 0.5 for those labelled bad, else null."""
    best = put(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_lid")).agg(F.max("quality").alias("_q")), "mix-labels")
    joined = docs.join(small(best), F.col("doc_id") == F.col("_lid"), "left")
    return joined.withColumn("_quality", F.when(F.col("_q") >= 1, 2.0).when(F.col("_q") < 1, 0.5)).drop("_lid", "_q")


def mix(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, boundary: str = "cut") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, text, source)."""
    narrow = docs.select("doc_id", "text", "source")
    sized = put(keyed(with_quality(narrow, labels), F.col("_quality"), seed).select("_id", "_source", "_size", "_key", "_bucket"), "mix-sized")
    chosen = decide(sized, put(plan(sized, weights, share, cap), "mix-plan"), boundary)
    return chosen.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_epochs") * F.col("_size") + F.col("_part")).alias("taken"),
    )


def mixed_rows(docs: DataFrame, labels: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix takes them (whole documents only), with docs' own columns."""
    own = docs.columns
    names = [f"c{i}" for i in range(len(own))]
    inner = docs.toDF(*names)
    pick = {n: F.col(names[own.index(n)]) for n in ("doc_id", "text", "source")}
    rows = keyed(with_quality(inner.withColumns(pick), labels), F.col("_quality"), seed)
    sized = put(rows.select("_id", "_source", "_size", "_key", "_bucket"), "mix-sized")
    chosen = decide(rows, put(plan(sized, weights, share, cap), "mix-plan"), "whole")
    times = F.when(F.col("_size") > 0, F.col("_epochs") + (F.col("_part") > 0).cast("int")).otherwise(F.lit(0))
    return chosen.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*[F.col(c).alias(n) for c, n in zip(names, own, strict=True)])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {
    "op1_mix_sources": r"""
        WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                     -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
                       / CASE WHEN q >= 1 THEN 2.0::DOUBLE WHEN q < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
              FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST((rn - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
        t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
        r AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, e.epochs, CAST(floor(e.target) AS BIGINT) - e.epochs * e.source_size
                       - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
              FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, source, size::BIGINT AS size, source_size, target::DOUBLE AS target,
               (epochs * size + greatest(0, least(size, rest)))::BIGINT AS taken FROM r"""
}
QUERIES = {"op1_mix_sources": op1_mix_sources}
