"""Evaluation and log analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.session import shared_folder

#: Fixed value: the cosine above which a found text hits.
HIT_COSINE = 0.60
#: Documents that a judge sees, characters of a mistake that are shown.
JUDGED, MISTAKE_CHARS = 3, 40
#: Distinct values that are sorted as one slice, and parts of a larger one.
WITHIN, PARTS = 1_000_000, 32


def hit_metrics(ranked: DataFrame, qkey: str, hit: Column, by: str | None = None) -> DataFrame:
    """n, Hit@1/3/5 and MRR over queries; ranked has a row for each query and rank, queries without hits count as misses.

    by: a column of the queries; then a row for each of its values and one, with null, for all."""
    keys = [qkey] + ([by] if by else [])
    first = ranked.groupBy(*keys).agg(F.min(F.when(hit, F.col("rank"))).alias("_r"))
    share = lambda k: F.avg((F.coalesce(F.col("_r"), F.lit(1 << 30)) <= k).cast("double")).alias(f"hit{k}")
    told = [F.count(F.lit(1)).alias("n"), share(1), share(3), share(5), F.avg(F.coalesce(F.lit(1.0) / F.col("_r"), F.lit(0.0))).alias("mrr")]
    return first.rollup(by).agg(*told) if by else first.agg(*told)


def percentiles(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99), within: int = WITHIN) -> DataFrame:
    """n, mean and nearest-rank percentiles of each group, at index min(n - 1, floor(n * p)) of the ascending values; rows with a null value are left out.

    Exact at any size by distributed selection: equal values are counted as one, and as long as a wanted rank lies among more than `within` distinct
    values, cuts at their approximate quantiles part them, a cut's own value being a part by itself, the parts are counted, and the one that holds the
    rank goes on. Only what is within the bound is sorted."""
    spark, root = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/corvane/percentiles-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{root}/{name}")

    told = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    values = written(told, "values")
    groups = values.groupBy(F.col("_g").alias("_by")).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_d"))
    ranks = F.array(*[F.struct(F.lit(k).alias("_p"), F.least("n", F.floor(F.col("n") * F.lit(p)) + 1).alias("_rank")) for k, p in enumerate(points)])
    slices = written(groups.select("_by", "n", "mean", "_low", "_high", "_d", F.inline(ranks)), "slices-0")
    names, turn = slices.columns, 0
    same = F.col("_by").eqNullSafe(F.col("_g")) & F.col("_v").between(F.col("_low"), F.col("_high"))
    while (slices.agg(F.max("_d")).first()[0] or 0) > within:
        turn += 1
        wide = slices.filter(F.col("_d") > within)
        cuts = wide.join(values, same).groupBy("_by", "_p").agg(F.array_distinct(F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], 1000)).alias("_cuts"))
        cuts = cuts.select(F.col("_by").alias("_b"), F.col("_p").alias("_q"), "_cuts")
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) * 2 + F.array_contains("_cuts", F.col("_v")).cast("int")
        parted = wide.join(cuts, F.col("_by").eqNullSafe(F.col("_b")) & (F.col("_p") == F.col("_q"))).join(values, same).groupBy("_by", "n", "mean", "_p", "_rank", part.alias("_part"))
        counted = parted.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_by", "_p").orderBy("_part"))  # twice PARTS rows at most
        held = counted.withColumn("_u", upto).filter((F.col("_rank") <= F.col("_u")) & (F.col("_rank") > F.col("_u") - F.col("_c")))
        held = held.withColumn("_rank", F.col("_rank") - F.col("_u") + F.col("_c")).select(names)
        slices = written(slices.filter(F.col("_d") <= within).unionByName(held), f"slices-{turn}")
    upto = F.sum("_c").over(Window.partitionBy("_by", "_p").orderBy("_v"))  # no more than `within` rows
    best = slices.join(values, same).withColumn("_u", upto).filter((F.col("_rank") <= F.col("_u")) & (F.col("_rank") > F.col("_u") - F.col("_c")))
    at = [F.max(F.when(F.col("_p") == k, F.col("_v"))).alias(f"p{round(p * 100)}") for k, p in enumerate(points)]
    return best.groupBy(F.col("_by").alias(by)).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *at)


def confusion(rows: DataFrame, predicted: str, expected: str, values: list) -> DataFrame:
    return rows.groupBy(predicted).pivot(expected, values).agg(F.count(F.lit(1))).fillna(0)


def accuracy(rows: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    """One row: n, correct and accuracy of predictions; a null is a value like any other, and equals a null."""
    right = predicted.eqNullSafe(expected)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(right.cast("bigint")), F.lit(0)).alias("correct"))
    return told.withColumn("accuracy", F.when(F.col("n") > 0, F.col("correct") / F.col("n")))


def mistakes(rows: DataFrame, key: str, predicted: Column, expected: Column, text: Column, chars: int = MISTAKE_CHARS) -> DataFrame:
    """key, predicted, expected and the beginning of the text of every wrong prediction."""
    told = rows.select(key, predicted.alias("predicted"), expected.alias("expected"), F.substring(text, 1, chars).alias("text"))
    return told.filter(~F.col("predicted").eqNullSafe(F.col("expected")))


def matching_first(hits: DataFrame, qkey: str, query_labels: str, doc_labels: str, k: int = JUDGED) -> DataFrame:
    """hits with a new rank: those whose labels meet the query's before the others, both in their old order, and the k first. A null array has no labels."""
    none = F.array().cast("array<string>")
    match = F.arrays_overlap(F.coalesce(F.col(query_labels), none), F.coalesce(F.col(doc_labels), none))
    order = Window.partitionBy(qkey).orderBy(F.desc("_match"), F.asc("_old"))
    return hits.withColumn("_match", F.coalesce(match, F.lit(False))).withColumnRenamed("rank", "_old").withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k).drop("_match", "_old")


def judge_means(judged: DataFrame, measures: tuple[str, ...], by: str | None = None) -> DataFrame:
    """n and the mean of each measure, of 0 to 1, over the rows that have it; by: for each of its values, and one row, with null, for all."""
    told = [F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col(m).between(0.0, 1.0), F.col(m))).alias(m) for m in measures]]
    return judged.rollup(by).agg(*told) if by else judged.agg(*told)


def feedback_report(rows: DataFrame, vote: str, question: str, order: str) -> DataFrame:
    """Distinct questions voted down, where each came first."""
    return rows.filter(F.col(vote) == "down").groupBy(question).agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n"))


def score_of_answer(answer: Column) -> Column:
    """A judge's answer: its first character if that is a digit, else 0."""
    return F.coalesce(F.try_to_number(F.substring(F.trim(answer), 1, 1), F.lit("9")).cast("int"), F.lit(0))


def verdicts(rows: DataFrame, key: str, text: str, categories: dict[str, str]) -> DataFrame:
    """key, failed (categories of FAIL lines) and passed, of "category:verdict:reason" lines; a line's category is the first that it names. Full-width colons count, and what follows a verdict doesn't."""
    line = rows.select(key, F.explode(F.split(text, "\n")).alias("_l")).withColumn("_p", F.split("_l", "[:：]", 3))
    kind = F.coalesce(*[F.when(F.contains(F.col("_p")[0], F.lit(word)), F.lit(name)) for word, name in categories.items()], F.lit("other"))
    fail = F.coalesce(F.upper(F.trim(F.get("_p", F.lit(1)))).startswith("FAIL"), F.lit(False))
    return line.groupBy(key).agg(F.array_sort(F.collect_set(F.when(fail, kind))).alias("failed"), (~F.bool_or(fail)).alias("passed"))
