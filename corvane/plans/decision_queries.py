"""Queries of decisions, graph builders, citations, keyed state and sinks, with their SQL."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import decide as D
from corvane.functions.text import entities, tier
from corvane.operators import builders as B
from corvane.operators import graph as G
from corvane.plans.text_queries import DICTIONARY, FORBIDDEN, PLAN_WORDS, _entity_sql
from corvane.session import load, shared_folder
from corvane.sources import keyed_table, sinks
from corvane.streaming import gateway as W
from corvane.streaming import keyed as K

HINTS, NEWS, DELAYS = ("sen", "lle"), ("ine",), (1.0, 2.0, 4.0)
#: A short dictionary: pos, injury, action, relation, reason.
ACTIONS = (
    (0, "Brand#1", "ring", "forbidden", "it bends"), (1, "Brand#1", "small ring", "rehab", "it helps"), (2, "Brand#2", "small ring", "forbidden", "it breaks"),
    (3, "Brand#2", "bolt", "caution", "it turns"), (4, "Brand#3", "nothing", "forbidden", "no reason"),
)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").withColumn("e", entities(F.col("text"), DICTIONARY))


def question_rules(spark: SparkSession, sf: str) -> DataFrame:
    q, n = _asked(spark, sf), F.col("item_id")
    return q.select(
        "item_id", D.needs_rewrite(F.col("text"), n % 3, F.col("e"), PLAN_WORDS, HINTS).alias("rewrite"), D.needs_fact_check(F.col("e")).alias("fact_check"),
        D.needs_external(F.col("e"), F.col("text"), n % 2, F.char_length("text"), NEWS).alias("external"),
        D.forbidden_request(F.col("text"), F.array(*[F.lit(a) for a in FORBIDDEN])).alias("forbidden"),
        F.char_length(D.mode_hint(tier(F.col("e"), F.col("text"), PLAN_WORDS), n % 2 == 0)).alias("hint_chars"),
    )


def refusal_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", F.md5(D.refusal(F.col("text")).cast("binary")).alias("refusal_md5"))


def answer_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("item_id")
    profile = F.when(n % 5 == 0, F.concat(F.lit("p"), n.cast("string")))
    return _asked(spark, sf).select("item_id", D.cache_key(F.col("text"), F.col("e"), n % 2 == 0, "1", F.lit("f0"), profile).alias("key"))


def retry_backoff(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    header = F.when(n % 4 == 0, (n % 90).cast("string")).when(n % 4 == 1, "soon").when(n % 4 == 3, "-1")
    return load(spark, sf, "events").select("event_id", D.backoff(n % 5, header, DELAYS).alias("seconds"))


def request_check(spark: SparkSession, sf: str) -> DataFrame:
    vote = F.when(F.col("turn") % 3 == 1, "up").when(F.col("turn") % 3 == 2, "sideways")
    profile = F.when(F.col("turn") % 2 == 1, F.repeat("text", F.lit(5)))
    faults = D.request_faults(F.repeat("text", F.col("turn").cast("int")), F.repeat(F.col("conv_id").cast("string"), F.lit(30)), profile, vote)
    return load(spark, sf, "conversations").select("conv_id", "turn", F.array_join(faults, ",").alias("faults"))


def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as exercises: the words of their names as muscles, their brands as equipment."""
    p = load(spark, sf, "part")
    return B.listed_edges(p, "p_type", "p_name", "TRAINS", " ").unionByName(B.single_edges(p, "p_type", "p_brand", "NEEDS")).unionByName(B.derived_edges(p, "p_brand", "p_name", "USED_FOR", " "))


def forbidden_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    label = F.when(F.col("p_size") % 3 == 0, "forbidden").when(F.col("p_size") % 3 == 1, "strictly forbidden").otherwise("rehab")
    edges = B.relation_edges(p.select(F.col("p_brand").alias("injury"), F.col("p_name").alias("action"), label.alias("relation"), F.col("p_type").alias("reason")))
    injuries = p.select("p_type", F.col("p_brand").alias("injury")).distinct()
    return B.forbidden_actions(injuries, edges, "p_type").select("p_type", "injury", F.array_join("actions", ",").alias("actions"))


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    asked = load(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit(" acute")).alias("injury"), F.col("p_name").alias("action"))
    return asked, spark.createDataFrame(ACTIONS, "pos int, injury string, action string, relation string, reason string")


def action_check(spark: SparkSession, sf: str) -> DataFrame:
    return B.check_action(*_pairs(spark, sf), "p_partkey").select("p_partkey", "verdict", F.array_join("found", ",").alias("found"))


def action_reason(spark: SparkSession, sf: str) -> DataFrame:
    return B.reasons(*_pairs(spark, sf), "p_partkey")


def answer_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in order of id as the hits of their source; items of the benchmark as results from outside, regions as tools."""
    n = F.col("doc_id")
    d = load(spark, sf, "documents").select(F.col("source").alias("q"), "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank")).filter("rank <= 7")
    docs = d.select(
        "q", "rank", (F.col("q") != "src1").alias("asked"), F.when(n % 5 == 0, F.concat(F.lit("n"), n.cast("string"))).alias("name"), F.when(n % 5 == 1, n).alias("page"),
        F.when(n % 5 == 2, "kb.txt").when(n % 5 == 3, "neo4j").alias("source"), F.when((n % 5 == 3) & (n % 2 == 0), 2).alias("hops"), F.concat(F.lit("d"), n.cast("string"), F.lit("x")).alias("text"),
    )
    i = F.col("item_id")
    web = load(spark, sf, "benchmark").select(F.concat(F.lit("src"), (i % 4).cast("string")).alias("q"), (F.floor(i / 4) + 1).cast("int").alias("rank"), F.concat(F.lit("w"), i.cast("string")).alias("source"), F.concat(F.lit("x"), i.cast("string"), F.lit("y")).alias("text"))
    r = F.col("r_regionkey").cast("string")
    tools = load(spark, sf, "region").select(F.concat(F.lit("src"), r).alias("q"), F.lit(1).alias("rank"), F.concat(F.lit("t"), r).alias("source"), r.alias("text"))
    return B.citations(docs, "q", "asked", tools, web).fillna({"page": 0, "source": ""})


def _fifo(spark: SparkSession, sf: str, most: int = 20, evicted: int = 4) -> DataFrame:
    e = load(spark, sf, "events").select("event_type", "event_id", "user_id")
    return K.replay(e, "event_type", ["event_id"], ["user_id"], partial(K.cache_step, most=most, evicted=evicted), "hit boolean, held int, gone int")


def answer_cache_fifo(spark: SparkSession, sf: str) -> DataFrame:
    """A cache for each type of event: users are what is asked."""
    return _fifo(spark, sf)


def breaker_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A breaker for each user: errors are failures. Hours count as seconds."""
    e = load(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("s"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return K.replay(e, "user_id", ["s", "event_id"], ["s", "ok"], K.breaker_step, "passed boolean, state string").select("user_id", "event_id", "passed", "state")


def cost_windows_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's windows of a day, that start at the first use and again at the first use after their end: requests in each."""
    e = load(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    started = K.replay(e, "user_id", ["at", "event_id"], ["at"], K.window_step, "start bigint")
    return started.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("requests"))


def near_duplicates_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return K.replay(c, "conv_id", ["turn"], ["role", "text"], K.noise_by_tag, "duplicate boolean")


def stream_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a stream with state for each conversation."""
    path = f"{sf}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return W.run_once(K.stream(turns, "conv_id", ["turn"], ["role", "text"], K.noise_by_tag, "duplicate boolean"), "stream-noise")


def snapshot_in_force(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a snapshot, of which the second holds."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')}/corvane/snapshot-{spark.sparkContext.applicationId}"
    nations = load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    sinks.write_snapshot(nations.filter("n_regionkey = 0"), root)
    sinks.write_snapshot(nations, root)
    return sinks.read_snapshot(spark, root, nations.schema)


def graph_store_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' orders as edges to priorities, in two loads of which the second brings the first one's rows again: the last order's status and date hold."""
    root = f"{shared_folder(spark)}/corvane/graph-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    day = F.to_date("o_orderdate").cast("string")
    edges = load(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"), F.lit("PLACED").alias("rel_type"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("relation"), day.alias("description"))
    G.store_edges(edges.filter("relation = 'F'"), root, 16)
    G.store_edges(edges, root, 16)
    return keyed_table.read(spark, f"{root}/edges", edges.schema)


QUERIES = {
    f.__name__: f
    for f in (
        question_rules, refusal_text, answer_cache_key, retry_backoff, request_check, graph_build, forbidden_lookup, action_check, action_reason, answer_citations, answer_cache_fifo, breaker_replay, cost_windows_reset,
        near_duplicates_by_tag, stream_near_duplicates, snapshot_in_force, graph_store_merge,
    )
}


def _has(words, text: str = "text") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_BEFORE, _AFTER = (part.replace("'", "''") for part in D.REFUSAL.split("{}"))
_ACTIONS = "t(pos, key, a, relation, reason) AS (VALUES " + ", ".join(str(r) for r in ACTIONS) + ")"
_MATCHED = f"""{_ACTIONS}, h AS (SELECT p_partkey, p_name AS action, t.* FROM part JOIN t ON contains(p_brand || ' acute', key) OR contains(key, p_brand || ' acute')),
        m AS (SELECT * FROM h QUALIFY key = first_value(key) OVER (PARTITION BY p_partkey ORDER BY pos))"""
ORACLE = {
    "question_rules": f"""WITH e AS ({_entity_sql()}) SELECT item_id, item_id % 3 > 0 AND ({_has(HINTS)} OR (injury = '' AND body_part = '' AND exercise = '' AND NOT {_has(PLAN_WORDS)})) AS rewrite,
        injury <> '' OR body_part <> '' AS fact_check, injury <> '' AND (item_id % 2 = 0 OR length(text) < 200 OR {_has(NEWS)}) AS external,
        list_filter({sorted(FORBIDDEN, key=lambda a: (-len(a), a))}, lambda a: contains(text, a))[1] AS forbidden,
        CASE WHEN (injury <> '' OR body_part <> '' OR {_has(PLAN_WORDS)}) AND item_id % 2 = 1 THEN {len(D.MODE_HINT)} ELSE 0 END::INT AS hint_chars FROM e""",
    "refusal_text": f"SELECT item_id, md5('{_BEFORE}' || text || '{_AFTER}') AS refusal_md5 FROM benchmark",
    "answer_cache_key": f"""WITH e AS ({_entity_sql()}), n AS (SELECT item_id, text, list_filter(string_split(injury || ',' || body_part || ',' || exercise, ','), lambda x: x <> '')
            || [CASE WHEN item_id % 2 = 0 THEN 'mode:deep' ELSE 'mode:fast' END, 'pv:1', 'cd:f0'] || CASE WHEN item_id % 5 = 0 THEN ['profile:' || substr(md5('p' || item_id), 1, 8)] ELSE [] END AS names FROM e)
        SELECT item_id, md5(trim(text) || '|' || array_to_string(list_sort(names), ',')) AS key FROM n""",
    "retry_backoff": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 90)::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE [1.0, 2.0, 4.0][least(event_id % 5, 2) + 1]::DOUBLE END AS seconds FROM events""",
    "request_check": """SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) * turn NOT BETWEEN 1 AND 1200 THEN 'question' END, CASE WHEN length(conv_id::VARCHAR) * 30 > 64 THEN 'session' END,
        CASE WHEN turn % 2 = 1 AND length(text) * 5 > 500 THEN 'profile' END, CASE WHEN turn % 3 = 2 THEN 'vote' END) AS faults FROM conversations""",
    "graph_build": """WITH w AS (SELECT p_type, p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)
        SELECT DISTINCT p_type AS src, w AS dst, 'TRAINS' AS rel_type FROM w WHERE length(w) >= 2 UNION ALL SELECT DISTINCT p_type, p_brand, 'NEEDS' FROM part WHERE length(p_brand) >= 2
        UNION ALL SELECT DISTINCT p_brand, w, 'USED_FOR' FROM w WHERE length(w) >= 2""",
    "forbidden_lookup": """WITH i AS (SELECT DISTINCT p_type, p_brand FROM part), f AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size % 3 < 2)
        SELECT p_type, p_brand AS injury, string_agg(p_name, ',' ORDER BY p_name) AS actions FROM i JOIN f USING (p_brand) GROUP BY ALL""",
    "action_check": f"""WITH {_MATCHED}, s AS (SELECT *, CASE WHEN action = a THEN 0 WHEN contains(action, a) OR contains(a, action) THEN 1 ELSE 2 END AS how FROM m),
        b AS (SELECT * FROM s QUALIFY how = min(how) OVER (PARTITION BY p_partkey)),
        g AS (SELECT p_partkey, min(how) AS how, string_agg(DISTINCT CASE WHEN how < 2 THEN a || ':' || relation ELSE a END, ',' ORDER BY CASE WHEN how < 2 THEN a || ':' || relation ELSE a END) AS found FROM b GROUP BY p_partkey)
        SELECT p_partkey, CASE how WHEN 0 THEN 'exact' WHEN 1 THEN 'similar' WHEN 2 THEN 'other' ELSE 'unknown' END AS verdict, coalesce(found, '') AS found FROM part LEFT JOIN g USING (p_partkey)""",
    "action_reason": f"WITH {_MATCHED} SELECT p_partkey, arg_min(reason, pos) AS reason FROM m WHERE action = a AND relation = 'forbidden' GROUP BY p_partkey",
    "answer_citations": """WITH d AS (SELECT source AS q, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
        c AS (SELECT 'src' || r_regionkey AS q, 0 AS p, 1 AS rank, 'tool' AS kind, 't' || r_regionkey AS source, NULL::BIGINT AS page, r_regionkey::VARCHAR AS snippet FROM region
            UNION ALL SELECT 'src' || (item_id % 4), 1, item_id // 4 + 1, 'web', 'w' || item_id, NULL, 'x' || item_id || 'y' FROM benchmark WHERE item_id // 4 < 3
            UNION ALL SELECT q, 2, rank, CASE doc_id % 5 WHEN 3 THEN 'graph' ELSE 'kb' END, CASE doc_id % 5 WHEN 0 THEN 'n' || doc_id WHEN 2 THEN 'kb.txt' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '图谱·2跳' ELSE '图谱' END END,
                CASE WHEN doc_id % 5 = 1 THEN doc_id END, 'd' || doc_id || 'x' FROM d WHERE rank <= 5 AND q <> 'src1' AND doc_id % 5 <> 4)
        SELECT q, row_number() OVER (PARTITION BY q ORDER BY p, rank) AS pos, kind, coalesce(source, '') AS source, coalesce(page, 0) AS page, snippet FROM c""",
    "cost_windows_reset": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), w AS (SELECT user_id, min(t) AS start FROM e GROUP BY user_id
          UNION ALL SELECT w.user_id, min(e.t) FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.start + 86400000000 GROUP BY w.user_id),
        s AS (SELECT e.user_id, e.t, max(w.start) AS start FROM e JOIN w ON w.user_id = e.user_id AND w.start <= e.t GROUP BY e.user_id, e.t)
        SELECT e.user_id, s.start, count(*) AS requests FROM e JOIN s ON s.user_id = e.user_id AND s.t = e.t GROUP BY ALL""",
    "graph_store_merge": """SELECT 'c' || o_custkey AS src, o_orderpriority AS dst, 'PLACED' AS rel_type, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS relation, arg_max(o_orderdate::DATE::VARCHAR, o_orderkey) AS description
        FROM orders GROUP BY ALL""",
    "snapshot_in_force": "SELECT n_nationkey, n_regionkey FROM nation",
}
