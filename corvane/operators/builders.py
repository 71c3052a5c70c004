"""Builders of the property graph from tables of exercises and injuries, look-ups of actions, and citations of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import clean_snippet

#: What separates names in a cell, the label that forbids, the bounds of citations.
SEPARATORS = "[/、，,]"
FORBIDDEN = "forbidden"
WEB_CITED, DOCS_CITED, SOURCE_CHARS, SNIPPET_CHARS = 3, 5, 80, 120


def _names(cell: Column, separators: str) -> Column:
    """Names of two characters or more in a cell, each once; none in a null cell."""
    parts = F.array_distinct(F.transform(F.split(F.coalesce(cell, F.lit("")), separators), lambda p: F.trim(p)))
    return F.filter(parts, lambda p: F.char_length(p) >= 2)


def listed_edges(rows: DataFrame, name: str, cell: str, rel_type: str, separators: str = SEPARATORS) -> DataFrame:
    """src, dst, rel_type: an edge from a row's name to each name in its cell (an exercise's muscles). Rows without a name have none."""
    return rows.filter(F.char_length(F.trim(name)) > 0).select(F.trim(name).alias("src"), F.explode(_names(F.col(cell), separators)).alias("dst"), F.lit(rel_type).alias("rel_type")).distinct()


def single_edges(rows: DataFrame, name: str, cell: str, rel_type: str) -> DataFrame:
    """src, dst, rel_type: an edge to the whole cell (an exercise's equipment) where it has two characters or more."""
    kept = rows.filter((F.char_length(F.trim(name)) > 0) & (F.char_length(F.trim(cell)) >= 2))
    return kept.select(F.trim(name).alias("src"), F.trim(cell).alias("dst"), F.lit(rel_type).alias("rel_type")).distinct()


def derived_edges(rows: DataFrame, single: str, listed: str, rel_type: str, separators: str = SEPARATORS) -> DataFrame:
    """Edges between two cells of the same row (equipment to muscles), each once."""
    return listed_edges(rows.filter(F.char_length(F.trim(single)) >= 2), single, listed, rel_type, separators)


def relation_edges(table: DataFrame, rel_type: str = "RELATION") -> DataFrame:
    """Edges of a table (injury, action, relation, reason): the label and its reason go along."""
    return table.select(F.col("injury").alias("src"), F.col("action").alias("dst"), F.lit(rel_type).alias("rel_type"), "relation", F.col("reason").alias("description")).distinct()


def forbidden_actions(injuries: DataFrame, edges: DataFrame, qkey: str, label: str = FORBIDDEN) -> DataFrame:
    """qkey, injury, actions: the ends of an injury's edges whose label is or contains the one that forbids."""
    hit = injuries.join(edges.filter(F.contains(F.col("relation"), F.lit(label))), F.col("injury") == F.col("src"))
    return hit.groupBy(qkey, "injury").agg(F.array_sort(F.collect_set("dst")).alias("actions"))


def _matched(asked: DataFrame, table: DataFrame, qkey: str) -> DataFrame:
    """asked (qkey, injury, action) with the rows of the first injury of the table, by pos, that contains or is in theirs.

    The table (pos, injury, action, relation, reason) is a short dictionary; so is the join's other side."""
    t = table.select(F.col("pos"), F.col("injury").alias("_key"), F.col("action").alias("_a"), "relation", "reason")
    hit = asked.join(F.broadcast(t), F.contains("injury", "_key") | F.contains("_key", "injury"))
    first = F.first("_key").over(Window.partitionBy(qkey).orderBy("pos"))
    return hit.withColumn("_first", first).filter(F.col("_key") == F.col("_first")).drop("_first")


def reasons(asked: DataFrame, table: DataFrame, qkey: str, label: str = FORBIDDEN) -> DataFrame:
    """qkey and the reason by which its injury forbids exactly its action; queries without one are left out."""
    hit = _matched(asked, table, qkey).filter((F.col("action") == F.col("_a")) & (F.col("relation") == label))
    return hit.groupBy(qkey).agg(F.min_by("reason", "pos").alias("reason"))


def check_action(asked: DataFrame, table: DataFrame, qkey: str) -> DataFrame:
    """qkey, verdict and found, for every query: exact (its action's rows), similar (actions that contain it or are in it), other (what is known of the injury) or unknown."""
    a, b = F.col("action"), F.col("_a")
    how = F.when(a == b, 0).when(F.contains(a, b) | F.contains(b, a), 1).otherwise(2)
    hit = _matched(asked, table, qkey).withColumn("_how", how)
    best = hit.withColumn("_best", F.min("_how").over(Window.partitionBy(qkey))).filter(F.col("_how") == F.col("_best"))
    told = best.groupBy(qkey, "_best").agg(F.array_sort(F.collect_set(F.concat_ws(":", "_a", F.when(F.col("_best") < 2, F.col("relation"))))).alias("found"))
    verdict = F.when(F.col("_best") == 0, "exact").when(F.col("_best") == 1, "similar").when(F.col("_best") == 2, "other").otherwise("unknown")
    return asked.select(qkey).join(told, qkey, "left").select(qkey, verdict.alias("verdict"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))


def citations(docs: DataFrame, qkey: str, has_entities: str, tools: DataFrame | None = None, web: DataFrame | None = None, graph: str = "neo4j") -> DataFrame:
    """qkey, pos (from 1), kind, source, page and snippet of what an answer rests on: tools, then 3 results from outside, then, for queries with entities, 5 documents.

    docs: qkey, rank, has_entities, name, source, page, hops, text. A name stands for the document; then a page, a text's source, hops, and the graph. A document
    of none of these isn't cited. tools: qkey, rank, source, text. web: the same, its source cut to 80 characters."""
    null = F.lit(None).cast("bigint")
    named, paged = F.char_length("name") > 0, F.col("page") > 0
    sourced, hopped = (F.char_length("source") > 0) & (F.col("source") != graph), F.col("hops") > 0
    kind = F.when(named | paged | sourced, "kb").when(hopped | (F.col("source") == graph), "graph")
    source = F.when(named, F.col("name")).when(paged | sourced, F.col("source")).when(hopped, F.concat(F.lit("图谱·"), F.col("hops").cast("string"), F.lit("跳"))).otherwise("图谱")
    page = F.when(~F.coalesce(named, F.lit(False)) & paged, F.col("page").cast("bigint"))
    cited = docs.filter(F.col(has_entities) & (F.col("rank") <= DOCS_CITED)).select(qkey, F.lit(2).alias("_p"), "rank", kind.alias("kind"), source.alias("source"), page.alias("page"), clean_snippet(F.col("text"), SNIPPET_CHARS).alias("snippet")).filter("kind IS NOT NULL")
    if web is not None:
        cited = cited.unionByName(web.filter(F.col("rank") <= WEB_CITED).select(qkey, F.lit(1).alias("_p"), "rank", F.lit("web").alias("kind"), F.substring("source", 1, SOURCE_CHARS).alias("source"), null.alias("page"), clean_snippet(F.col("text"), SNIPPET_CHARS).alias("snippet")))
    if tools is not None:
        cited = cited.unionByName(tools.select(qkey, F.lit(0).alias("_p"), "rank", F.lit("tool").alias("kind"), "source", null.alias("page"), F.col("text").alias("snippet")))
    pos = F.row_number().over(Window.partitionBy(qkey).orderBy("_p", "rank")).cast("bigint")
    return cited.select(qkey, pos.alias("pos"), "kind", "source", "page", "snippet")
