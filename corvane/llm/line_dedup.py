"""Line dedup by overlapping windows of consecutive lines.

Every run of three lines is hashed (64 and 32 bits together). Windows that occur more than once, anywhere, are found by an
aggregation that collapses copies before the shuffle. All occurrences but the first lose their lines: a line goes if
any removed window covers it. The first occurrence is the least by doc_id, then text hash, then position.

Defined cases: a null text has 0 lines and stays null; a text of fewer than three lines stays as it is; windows of three
empty lines don't count; null ids come last; of rows that repeat both id and text one is first, and the others lose all
their windows; a very long text is one row throughout; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import put, small, table

SPAN = 3


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, _text (hash of the text), _pos, _h, _g of every window."""
    lines = F.split(F.col("text"), "\n", -1)
    spans = F.transform(
        F.sequence(F.lit(0), F.size("_lines") - span),
        lambda i: F.struct(
            i.alias("_pos"), F.xxhash64(*[F.get("_lines", i + k) for k in range(span)]).alias("_h"), F.hash(*[F.get("_lines", i + k) for k in range(span)]).alias("_g"),
            F.concat(*[F.get("_lines", i + k) for k in range(span)]).eqNullSafe("").alias("_blank"),
        ),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), lines.alias("_lines")).filter(F.size("_lines") >= span)
    return rows.select("doc_id", "_text", F.inline(spans)).filter("NOT _blank").drop("_blank")


def dedup_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_lines, n_removed and text without the removed lines, for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_text"))
    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of"))
    twice = docs.filter("text IS NOT NULL").groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    twice = put(twice, "line-twice")
    again = None
    if not twice.isEmpty():
        rows = put(docs.join(small(twice), same_row, "left_semi").withColumn("_n", F.monotonically_increasing_id()), "line-rows")
        first = put(rows.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).agg(F.min("_n").alias("_first")), "line-first")
        rows = rows.join(small(first), same_row)
        again = rows.filter("_n != _first").select("doc_id", "text", "_text")
        docs = docs.join(small(twice), same_row, "left_anti").unionByName(rows.filter("_n = _first").select("doc_id", "text", "_text"))
    found = put(windows(docs, span), "line-windows")
    # min() skips nulls: any document with an id is before those without.
    repeated = put(found.groupBy("_h", "_g").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "line-repeated")
    hits = put(found.join(small(repeated), ["_h", "_g"]), "line-hits")
    same = F.col("doc_id").eqNullSafe(F.col("_first"))
    origin = put(hits.filter(same).groupBy("_h", "_g").agg(F.min(F.struct("_text", "_pos")).alias("_origin")), "line-origins")
    within = hits.filter(same).join(small(origin), ["_h", "_g"]).filter((F.col("_origin._text") != F.col("_text")) | (F.col("_origin._pos") != F.col("_pos")))
    later = hits.filter(~same).select("doc_id", "_text", "_pos").unionByName(within.select("doc_id", "_text", "_pos"))
    gone = put(later.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_of")).agg(F.collect_set("_pos").alias("_at")), "line-gone")
    joined = docs.join(small(gone), same_row, "left").select("doc_id", "text", "_at")
    lines = F.split(F.col("text"), "\n", -1)
    if again is not None:
        full = lambda i: ~F.concat(*[F.get(lines, i + k) for k in range(span)]).eqNullSafe("")
        every = F.when(F.size(lines) >= span, F.filter(F.sequence(F.lit(0), F.size(lines) - span), full))
        joined = joined.unionByName(again.select("doc_id", "text", every.alias("_at")))
    cover = F.flatten(F.transform(F.col("_at"), lambda p: F.sequence(p, p + (span - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), cover)
    return joined.withColumn("_lines", lines).withColumn("_stay", F.when(F.col("_at").isNotNull(), stay)).select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_stay")).cast("bigint").alias("n_removed"),
        F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")).alias("text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, p.i AS i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS g
              FROM d, LATERAL (SELECT unnest(generate_series(0, len(l) - 3)) AS i) p WHERE len(l) >= 3),
        c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS k FROM w WHERE g <> chr(10) || chr(10)),
        r AS (SELECT doc_id, list(i) AS pos FROM c WHERE k > 1 GROUP BY doc_id),
        v AS (SELECT DISTINCT doc_id, unnest(pos) + j.j AS i FROM r, (SELECT unnest([0, 1, 2]) AS j) j),
        cv AS (SELECT doc_id, list(i) AS cover FROM v GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(cover), 0)::BIGINT AS n_removed,
               CASE WHEN cover IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, n: NOT list_contains(cover, n - 1)), chr(10)) END AS text
        FROM d LEFT JOIN cv ON d.doc_id = cv.doc_id"""
}
QUERIES = {"op5_line_dedup": op5_line_dedup}
