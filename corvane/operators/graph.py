"""Bounded traversal of a property graph: nodes (name, type) and edges (edge_id, src, dst, rel_type, relation, description)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.retrieval import top_k
from corvane.sources import keyed_table

#: Scores of relation labels.
LABEL_SCORES = {"forbidden": 1.0, "rehab": 0.9, "caution": 0.7}
OTHER_SCORE, FORBIDDEN_BOOST = 0.5, 1.5
#: Trails that are listed, and the most that may be asked for.
LISTED, LISTED_MOST = 30, 50


def merge_nodes(writes: DataFrame) -> DataFrame:
    """One row for each name; of several writes (name, type, seq) the last one's type."""
    return writes.groupBy("name").agg(F.max_by("type", "seq").alias("type"))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "rel_type", "relation", "description"])


def store_nodes(writes: DataFrame, root: str, buckets: int = keyed_table.BUCKETS) -> list[int]:
    """Merges writes (name, type, seq) into the stored nodes: the last write of a name holds, whichever load brought it. The buckets that were rewritten."""
    return keyed_table.upsert(writes, f"{root}/nodes", ["name"], "seq", buckets=buckets)


def store_edges(writes: DataFrame, root: str, buckets: int = keyed_table.BUCKETS) -> list[int]:
    """Merges writes (src, dst, rel_type, seq and properties) into the stored edges: one of a kind between two nodes, with the last write's properties."""
    return keyed_table.upsert(writes, f"{root}/edges", ["src", "dst", "rel_type"], "seq", buckets=buckets)


def label_score(label: Column, scores: Mapping[str, float] = LABEL_SCORES) -> Column:
    out = F.lit(OTHER_SCORE)
    for name, score in scores.items():
        out = F.when(label == name, score).otherwise(out)
    return out


def relation_label(prop: Column, rel_type: Column, description: Column, labels: Sequence[str] = tuple(LABEL_SCORES)) -> Column:
    """The first of the labels, in their order, that an edge's property, type or description has in it; without one the description, or else the type."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    found = [F.when(F.contains(empty(prop), F.lit(n)) | F.contains(empty(rel_type), F.lit(n)) | F.contains(empty(description), F.lit(n)), F.lit(n)) for n in labels]
    return F.coalesce(*found, F.when(F.char_length(description) > 0, description), rel_type)


def labelled(edges: DataFrame, labels: Sequence[str] = tuple(LABEL_SCORES)) -> DataFrame:
    """edges (relation, rel_type, description) whose relation is the label that relation_label() finds."""
    return edges.withColumn("relation", relation_label(F.col("relation"), F.col("rel_type"), F.col("description"), labels))


def list_paths(starts: DataFrame, edges: DataFrame, aliases: DataFrame, qkey: str, depth: int = 2, limit: int = LISTED) -> DataFrame:
    """qkey, pos, start, nodes, labels and hops of the first trails from each query's start (name), which goes by its canonical name where it has an alias.

    Shorter trails first, then by edge ids; depth is held to 1 to 3, limit to 1 to 50. aliases (alias, canonical) is a short dictionary of distinct aliases.
    Only the edges of the trails that are listed are looked up for their nodes."""
    limit = max(1, min(LISTED_MOST, limit))
    named = starts.join(F.broadcast(aliases.select("alias", "canonical")), F.col("name") == F.col("alias"), "left")
    seeds = named.select(qkey, F.coalesce("canonical", "name").alias("src"))
    order = Window.partitionBy(qkey).orderBy("hops", _path_order())
    first = trails(seeds, edges, qkey, depth, limit).withColumn("pos", F.row_number().over(order).cast("bigint")).filter(F.col("pos") <= limit)
    ends = first.select(qkey, "pos", F.posexplode("edge_ids").alias("_k", "edge_id")).join(edges.select("edge_id", F.col("dst").alias("_node")), "edge_id")
    nodes = ends.groupBy(qkey, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_node"))), lambda x: x["_node"]).alias("_nodes"))
    return first.join(nodes, [qkey, "pos"]).select(qkey, "pos", "start", F.concat(F.array("start"), F.col("_nodes")).alias("nodes"), "labels", "hops")


def one_hop(seeds: DataFrame, edges: DataFrame, qkey: str, k: int = 15, scores: Mapping[str, float] = LABEL_SCORES) -> DataFrame:
    """Out-edges of each query's seeds (qkey, src), best label first. Of a node's edges the k best are found before they meet the queries."""
    order, once = [F.desc("score"), F.asc("edge_id")], seeds.distinct()
    scored = edges.withColumn("score", label_score(F.coalesce("relation", "rel_type"), scores))
    return top_k(once.join(top_k(scored, ["src"], order, k, "_first").drop("_first"), "src"), [qkey], order, k)


def _path_order() -> Column:
    return F.array_join(F.transform("edge_ids", lambda x: F.lpad(x.cast("string"), 20, "0")), "/")


def trails(seeds: DataFrame, edges: DataFrame, qkey: str, depth: int, most: int | None = None) -> DataFrame:
    """All directed trails of 1 to depth (3 at most) edges from the seeds: no edge twice, nodes as often as they come.

    qkey, start, dst, hops, edge_ids and labels. Each hop is an equi-join on the node reached.
    most: of each query no more trails of one length than that are kept and gone on from, the first by edge ids; where there are more, no longer trail is among its first."""
    first = Window.partitionBy(qkey).orderBy(_path_order())
    cut = lambda found: found if most is None else found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most).drop("_n")
    depth = max(1, min(3, depth))
    e = edges.select(F.col("edge_id").alias("_e"), F.col("src").alias("_s"), F.col("dst").alias("_d"), F.coalesce("relation", "rel_type").alias("_l"))
    now = seeds.distinct().join(e, F.col("src") == F.col("_s")).select(qkey, F.col("src").alias("start"), F.col("_d").alias("dst"), F.array("_e").alias("edge_ids"), F.array("_l").alias("labels"))
    now = cut(now)
    out = now
    for _ in range(depth - 1):
        step = now.join(e, F.col("dst") == F.col("_s")).filter(~F.array_contains("edge_ids", F.col("_e")))
        now = cut(step.select(qkey, "start", F.col("_d").alias("dst"), F.concat("edge_ids", F.array("_e")).alias("edge_ids"), F.concat("labels", F.array("_l")).alias("labels")))
        out = out.unionByName(now)
    return out.withColumn("hops", F.size("edge_ids").cast("bigint"))


def multi_hop(seeds: DataFrame, edges: DataFrame, qkey: str, depth: int, k: int = 15, scores: Mapping[str, float] = LABEL_SCORES, forbidden: str = "forbidden") -> DataFrame:
    """The k best trails: the last label's score over the hops; a trail through a forbidden edge scores half as much again, 1 at most. Shorter trails are looked at first, 3 * k of them."""
    found = trails(seeds, edges, qkey, depth, 3 * k)
    near = Window.partitionBy(qkey).orderBy("hops", _path_order())
    near_by = found.withColumn("seq", F.row_number().over(near).cast("bigint")).filter(F.col("seq") <= 3 * k)
    base = label_score(F.element_at("labels", -1), scores) / F.col("hops")
    score = F.when(F.array_contains("labels", forbidden), F.least(F.lit(1.0), base * FORBIDDEN_BOOST)).otherwise(base)
    best = Window.partitionBy(qkey).orderBy(F.desc(F.round("score", 9)), F.asc("seq"))
    return near_by.withColumn("score", score).withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)


def simple_paths(seeds: DataFrame, edges: DataFrame, qkey: str, depth: int, limit: int = 15) -> DataFrame:
    """Directed paths of 1 to depth (3 at most) edges that come to no node twice; columns as of trails(), and nodes.

    Each seed has a quota, limit over the query's number of seeds, 1 at least, so that the first seed doesn't take it all; shorter paths
    first, then by edge ids. As a path is only gone on from where it is within the quota, each hop is cut to it."""
    depth, once = max(1, min(3, depth)), seeds.distinct()
    quota = once.groupBy(qkey).agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count(F.lit(1)))).alias("_quota"))
    by_seed, own = Window.partitionBy(qkey, "start"), F.lpad(F.col("edge_id").cast("string"), 20, "0")
    # A path that has come to depth nodes at most goes on by no more than limit edges: of each node those that are first even without any depth of its neighbours.
    near = top_k(edges.select("edge_id", "src", "dst", F.coalesce("relation", "rel_type").alias("label"), own.alias("_o")), ["src", "dst"], [F.asc("_o")], limit, "_n")
    near = top_k(near, ["src"], [F.asc("_o")], limit * (depth + 1), "_n")
    out_of = near.groupBy(F.col("src").alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_o", "edge_id", "dst", "label"))).alias("_e"))
    none = F.array().cast("array<string>")
    now = once.join(quota, qkey).select(qkey, "_quota", F.col("src").alias("start"), F.col("src").alias("dst"), F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("edge_ids"), none.alias("labels"), F.array("src").alias("nodes"))
    out = None
    for _ in range(depth):
        fresh = F.filter("_e", lambda x: ~F.array_contains("nodes", x["dst"]))
        step = now.join(out_of, F.col("dst") == F.col("_s")).withColumn("_x", F.explode(F.slice(fresh, F.lit(1), F.col("_quota").cast("int"))))
        step = step.select(qkey, "_quota", "start", F.col("_x.dst").alias("dst"), F.concat("edge_ids", F.array("_x.edge_id")).alias("edge_ids"), F.concat("labels", F.array("_x.label")).alias("labels"), F.concat("nodes", F.array("_x.dst")).alias("nodes"))
        now = step.withColumn("_n", F.row_number().over(by_seed.orderBy(_path_order()))).filter(F.col("_n") <= F.col("_quota")).drop("_n")
        out = now if out is None else out.unionByName(now)
    out = out.withColumn("hops", F.size("edge_ids").cast("bigint"))
    return out.withColumn("_n", F.row_number().over(by_seed.orderBy("hops", _path_order()))).filter(F.col("_n") <= F.col("_quota")).drop("_n", "_quota")


def rank_paths(found: DataFrame, qkey: str, k: int = 5, scores: Mapping[str, float] = LABEL_SCORES, forbidden: str = "forbidden") -> DataFrame:
    """The k best paths of each query: the last label's score over the hops, half as much again through a forbidden edge, 1 at most."""
    base = label_score(F.element_at("labels", -1), scores) / F.col("hops")
    score = F.when(F.array_contains("labels", forbidden), F.least(F.lit(1.0), base * FORBIDDEN_BOOST)).otherwise(base)
    best = Window.partitionBy(qkey).orderBy(F.desc(F.round("score", 9)), F.asc("hops"), _path_order())
    return found.withColumn("score", score).withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)


def path_metrics(ranked: DataFrame, seeds: DataFrame, qkey: str, forbidden: str = "forbidden", first: int = 3) -> DataFrame:
    """One row over all queries that have seeds: n; recall, the share with a forbidden label among their paths; top1, the share that begin with one;
    coverage, the share whose first paths go through all their seeds; and the mean hops of all paths."""
    wanted = seeds.distinct().groupBy(qkey).agg(F.count(F.lit(1)).alias("_seeds"))
    near = F.col("rank") <= first
    through = seeds.distinct().join(ranked.filter(near).select(qkey, F.explode("nodes").alias("src")).distinct(), [qkey, "src"]).groupBy(qkey).agg(F.count(F.lit(1)).alias("_through"))
    last = F.element_at("labels", -1) == forbidden
    told = ranked.groupBy(qkey).agg(F.max(last.cast("int")).alias("_any"), F.max((last & (F.col("rank") == 1)).cast("int")).alias("_top"), F.sum("hops").alias("_hops"), F.count(F.lit(1)).alias("_paths"))
    rows = wanted.join(told, qkey, "left").join(through, qkey, "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)).cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("n"), share(F.col("_any")).alias("recall"), share(F.col("_top")).alias("top1"), share((F.col("_through") == F.col("_seeds")).cast("int")).alias("coverage"), (F.sum("_hops") / F.sum("_paths")).alias("mean_hops"))


def mark_conflicts(rows: DataFrame, qkey: str, target: str, label: str, seq: str) -> DataFrame:
    """conflict: whether the row before, of the same target, has another label."""
    before = F.lag(label).over(Window.partitionBy(qkey, target).orderBy(seq))
    return rows.withColumn("conflict", F.coalesce(before != F.col(label), F.lit(False)))


def contraindications(injuries: DataFrame, table: DataFrame, aliases: DataFrame, qkey: str, relation: str = "forbidden") -> DataFrame:
    """qkey, injury and its actions: names (after aliases) that contain, or are in, a name of the table. The table is a short dictionary."""
    named = injuries.join(F.broadcast(aliases), F.col("injury") == F.col("alias"), "left").withColumn("_n", F.coalesce("canonical", "injury"))
    t = table.filter(F.col("relation") == relation).select(F.col("injury").alias("_i"), "action")
    hit = named.join(F.broadcast(t), F.contains("_n", "_i") | F.contains("_i", "_n"))
    return hit.groupBy(qkey, "injury").agg(F.array_sort(F.collect_set("action")).alias("actions"))


def resolve_contraindications(from_graph: DataFrame, local: DataFrame, qkey: str) -> DataFrame:
    """Per injury the graph's actions, else the local table's."""
    g = from_graph.select(qkey, "injury", F.col("actions").alias("_g"))
    return g.join(local, [qkey, "injury"], "full_outer").select(qkey, "injury", F.coalesce("_g", "actions").alias("actions"))


def subgraph(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """Out-edges of the focus names; without any name the whole graph."""
    if focus.isEmpty():
        return edges
    return edges.join(focus.select(F.col("name").alias("src")), "src", "left_semi")


def chart(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """src (after aliases), dst and relation, each once."""
    renamed = edges.join(F.broadcast(aliases), F.col("src") == F.col("alias"), "left")
    return renamed.select(F.coalesce("canonical", "src").alias("src"), "dst", "relation").distinct()


def match_focus(text: Column, names: list[str]) -> Column:
    """Names in the text, longest first."""
    ordered = F.array(*[F.lit(n) for n in sorted(dict.fromkeys(names), key=lambda n: (-len(n), n))])
    return F.filter(ordered, lambda n: F.contains(text, n))
