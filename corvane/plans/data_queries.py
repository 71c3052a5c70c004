"""Queries of ingestion, gateway state, streams and evaluation, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import token_estimate
from corvane.operators import evaluate as E
from corvane.operators import ingest as I
from corvane.operators import retrieval as R
from corvane.sources.readers import html_text
from corvane.session import load
from corvane.streaming import gateway as W
from corvane.streaming import keyed as K
from corvane.streaming import timers as T


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", F.lit(False).alias("is_row"))
    parts = I.blocks(docs, "doc_id").select(F.concat_ws("/", "doc_id", "n").alias("unit"), "text")
    return I.parent_child_chunks(parts, "unit")[1].select("unit", "chunk_id", "parent_id", F.char_length("text").alias("n_chars"))


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    """All but the English documents before; all but the Spanish ones, those of src1 changed, after."""
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"), "lang", "source")
    new = d.filter("lang != 'es'").withColumn("sha", F.when(F.col("source") == "src1", F.reverse("sha")).otherwise(F.col("sha")))
    return I.manifest_diff(d.filter("lang != 'en'"), new)


def embed_cache_miss(spark: SparkSession, sf: str) -> DataFrame:
    """The first half by language is cached; how many texts hit, and how many distinct ones are embedded."""
    d = load(spark, sf, "documents").withColumn("sha", F.sha2("text", 256))
    cache = d.filter("lang IN ('en', 'de')").select("sha").distinct()
    told = d.join(cache.withColumn("hit", F.lit(True)), "sha", "left")
    return told.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("bigint")).alias("hits"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("sha"))).alias("to_embed"))


def html_to_units(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", html_text(F.col("html")).alias("text"))


def table_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Region names as cells of tables that go on over pages."""
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    row = F.array(F.array(F.lit("k"), F.lit("v")), F.array(F.col("r_regionkey").cast("string"), F.col("r_name")))
    t = r.select(F.lit("d").alias("doc"), (F.col("r_regionkey") + 1).alias("page"), F.lit(0).alias("tbl_no"), row.alias("rows"), F.lit(50.0).alias("top"), F.when(F.col("r_regionkey") == 2, 400.0).otherwise(790.0).alias("bottom"), F.lit(800.0).alias("height"))
    out = I.merge_page_tables(t)
    return out.select("page", F.size("rows").cast("bigint").alias("n_rows"), F.array_join(F.transform("rows", lambda x: x[1]), ",").alias("cells"))


def rate_limit_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events an hour apart on average: hours count as seconds."""
    e = load(spark, sf, "events").withColumn("t", F.timestamp_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9))
    return W.rate_limit(e, "user_id", "t", "event_id")


def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the user in the day up to each."""
    day = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return load(spark, sf, "events").select("event_id", F.count(F.lit(1)).over(day).alias("in_window"))


def near_duplicate_replay(spark: SparkSession, sf: str) -> DataFrame:
    return W.near_duplicates(load(spark, sf, "conversations").filter("role = 'user'"), "conv_id", "turn", "text")


def cost_ledger_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", "ts", F.floor("value").cast("bigint").alias("p"), (F.col("event_id") % 50).alias("c"), (F.floor("value").cast("bigint") * 2).alias("t"))
    return W.cost_windows(e, "user_id", "ts", "p", "c", "t", 150, 300)


def session_lru(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return W.lru(c, "last", "conv_id")


def recent_buffer(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id")


def history_trim(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations").withColumn("tokens", token_estimate(F.col("text")))
    return W.history_trim(c, "conv_id", "turn", "tokens", 200).select("conv_id", "turn", "tokens")


def history_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.max_by("role", "turn").alias("last_role"))


def usage_by_request(spark: SparkSession, sf: str) -> DataFrame:
    """Events by user and day as requests: sums by kind, and the rest."""
    e = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    sums = e.groupBy("user_id", "day").agg(F.round(F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)), 4).alias("click"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select("user_id", F.col("day").cast("string").alias("day"), "click", "total", F.round(F.greatest(F.lit(0.0), F.col("total") - F.col("click")), 4).alias("other"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return E.percentiles(load(spark, sf, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("wanted"), "embedding")
    others = R.dense(q, e, "q", "vec_id", 11).filter("vec_id != q")
    hits = R.top_k(others.drop("rank"), ["q"], [F.desc(F.round("score", 9)), F.asc("vec_id")], 10)
    return hits.join(e.select("vec_id", "label"), "vec_id").join(q.select("q", "wanted"), "q")


def eval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    out = E.hit_metrics(_ranked(spark, sf), "q", F.col("label") == F.col("wanted"))
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("hit1", "hit3", "hit5", "mrr")])


def eval_by_type(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf).withColumn("kind", F.when(F.col("wanted") % 2 == 0, "even").otherwise("odd"))
    out = E.hit_metrics(r, "q", F.col("label") == F.col("wanted"), "kind")
    return out.select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", F.round("hit3", 3).alias("hit3"), F.round("mrr", 3).alias("mrr"))


def eval_cosine_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits by meaning: a found vector hits where its cosine with the reference's, which is the next one, is above 0.60."""
    e = load(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding")
    reference = e.select((F.col("vec_id") - 1).alias("q"), F.col("embedding").alias("wanted"))
    found = R.dense(q, e, "q", "vec_id", 5).join(e, "vec_id").join(reference, "q")
    out = E.hit_metrics(found, "q", R.cosine(F.col("wanted"), F.col("embedding")) > E.HIT_COSINE)
    return out.select("n", *[F.round(c, 4).alias(c) for c in ("hit1", "hit3", "hit5", "mrr")])


def _sessions(turns: DataFrame) -> tuple:
    """Conversations as sessions in eight buckets of no more than two, each of three messages at most; turns come in order, and conversations by number."""
    rows = turns.select(F.pmod(F.xxhash64("conv_id"), F.lit(8)).alias("bucket"), "turn", "conv_id", F.col("conv_id").alias("session"), "text")
    return rows, "bucket", ["turn", "conv_id"], ["session", "text"], partial(K.session_step, most=2, messages=3), "held int, gone array<string>"


def session_store_replay(spark: SparkSession, sf: str) -> DataFrame:
    return K.replay(*_sessions(load(spark, sf, "conversations")))


def stream_session_store(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return W.run_once(K.stream(*_sessions(turns)), "stream-store")


def classifier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    out = E.confusion(load(spark, sf, "labels"), "quality", "toxic", [0, 1])
    return out.select("quality", F.col("0").alias("toxic0"), F.col("1").alias("toxic1"))


def feedback_distinct(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("event_id", "props", F.when(F.col("event_type") == "error", "down").otherwise("up").alias("vote"))
    return E.feedback_report(e, "vote", "props", "event_id")


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select(E.score_of_answer(F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a ")).otherwise(F.lit(" ")), (F.col("c_custkey") % 5).cast("string"), F.lit(" points"))).alias("score"))
    return c.groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, by stream; the watermark lets the last ones out when an event far later ends the stream, so the batch gives them."""
    e = load(spark, sf, "events").select("user_id", "ts")
    return W.sessions(e, "user_id", "ts", "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's and type's events once, by a stream with state for all keys."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return W.run_once(events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "stream-dedup")


def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    events = events.withColumn("t", F.timestamp_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9))
    return W.run_once(W.rate_limit_stream(events, "user_id", "t", "event_id"), "stream-limit")


def stream_state_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """When each user's state ends, two hours after the last event, by a stream with timers whose watermark is ten minutes late."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    out = W.run_once(T.limits_stream(events, "user_id", "ts", "event_id", limit=1 << 30, window=7200.0), "stream-sweep", conf=T.CONF)
    return out.filter("swept_ms IS NOT NULL").select("user_id", "swept_ms")


def stream_closed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's sessions by a stream: those that the watermark, ten minutes after which an event is too late, has closed."""
    path = f"{sf}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]").select("user_id", "ts")
    out = W.run_once(W.sessions(events, "user_id", "ts", "2 hours", "10 minutes"), "stream-sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_documents, manifest_diff, embed_cache_miss, html_to_units, table_merge, rate_limit_replay, rate_window, near_duplicate_replay, cost_ledger_windows, session_lru, recent_buffer,
        history_trim, history_tokens, usage_by_request, latency_percentiles, eval_hit_mrr, eval_by_type, classifier_confusion, feedback_distinct, judge_scores, stream_sessions, stream_dedup, stream_rate_limit,
        stream_state_sweep, stream_closed_sessions, eval_cosine_hits, session_store_replay, stream_session_store,
    )
}

_EST = "CAST(floor(len(regexp_extract_all({0}, '[一-鿿]')) * 1.5::DOUBLE + (length({0}) - len(regexp_extract_all({0}, '[一-鿿]'))) * 0.3::DOUBLE) AS BIGINT)"
_COS = "list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e)) + 1e-9)"
_RANKED = """lq AS (SELECT vec_id AS q, label AS wanted, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q, wanted, vec_id, label, list_dot_product(v, e) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(e, e)) + 1e-9) AS score FROM lq, (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)),
    k AS (SELECT q, wanted, label, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s WHERE vec_id <> q),
    f AS (SELECT q, wanted, min(rank) FILTER (label = wanted) AS r FROM k WHERE rank <= 10 GROUP BY q, wanted)"""
ORACLE = {
    "manifest_diff": """WITH d AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS sha, lang, source FROM documents),
        n AS (SELECT path, CASE WHEN source = 'src1' THEN reverse(sha) ELSE sha END AS sha FROM d WHERE lang <> 'es'), o AS (SELECT path, sha FROM d WHERE lang <> 'en')
        SELECT path, CASE WHEN o.sha IS NULL THEN 'new' WHEN n.sha IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (path)""",
    "embed_cache_miss": """WITH c AS (SELECT DISTINCT text FROM documents WHERE lang IN ('en', 'de'))
        SELECT lang, count(*) AS texts, count(c.text) AS hits, count(DISTINCT d.text) FILTER (c.text IS NULL) AS to_embed FROM documents d LEFT JOIN c ON d.text = c.text GROUP BY lang""",
    "html_to_units": r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
        b AS (SELECT page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') AS t FROM a),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
        SELECT page_id, trim(regexp_replace(t, '[\t\n\x0B\f\r ]+', ' ', 'g')) AS text FROM c""",
    "table_merge": """WITH t AS (SELECT r_regionkey + 1 AS page, r_regionkey::VARCHAR AS k, r_name, CASE WHEN r_regionkey <= 2 THEN 1 ELSE 2 END AS g FROM region)
        SELECT min(page) AS page, count(*) + 1 AS n_rows, 'v,' || string_agg(r_name, ',' ORDER BY page) AS cells FROM t GROUP BY g""",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "cost_ledger_windows": """WITH e AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 86400000000 AS window_no, CAST(floor(value) AS BIGINT) AS p, event_id % 50 AS c FROM events),
        s AS (SELECT user_id, window_no, count(*) AS requests, sum(greatest(p * 2, p + c))::BIGINT AS tokens FROM e GROUP BY ALL)
        SELECT *, CASE WHEN tokens >= 300 THEN 'exhausted' WHEN tokens >= 150 THEN 'degraded' ELSE 'ok' END AS state FROM s""",
    "session_lru": "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id ORDER BY last DESC, conv_id LIMIT 64",
    "recent_buffer": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "history_trim": f"""WITH t AS (SELECT conv_id, turn, {_EST.format('text')} AS tokens FROM conversations)
        SELECT conv_id, turn, tokens FROM t QUALIFY sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 200 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2""",
    "history_tokens": f"SELECT conv_id, sum({_EST.format('text')})::BIGINT AS tokens, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id",
    "usage_by_request": """WITH s AS (SELECT user_id, ts::DATE::VARCHAR AS day, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS click, round(sum(value), 4) AS total FROM events GROUP BY ALL)
        SELECT user_id, day, click, total, round(greatest(0, total - click), 4) AS other FROM s""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) FILTER (k = least(n, floor(n * 0.5::DOUBLE) + 1)) AS p50, max(value) FILTER (k = least(n, floor(n * 0.95::DOUBLE) + 1)) AS p95, max(value) FILTER (k = least(n, floor(n * 0.99::DOUBLE) + 1)) AS p99 FROM r GROUP BY event_type""",
    "eval_hit_mrr": f"WITH {_RANKED} SELECT count(*) AS n, round(avg((coalesce(r, 99) <= 1)::INT), 4) AS hit1, round(avg((coalesce(r, 99) <= 3)::INT), 4) AS hit3, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS hit5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM f",
    "eval_by_type": f"WITH {_RANKED}, g AS (SELECT CASE WHEN wanted % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, r FROM f) SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(avg((coalesce(r, 99) <= 3)::INT), 3) AS hit3, round(avg(coalesce(1.0::DOUBLE / r, 0)), 3) AS mrr FROM g GROUP BY ROLLUP (kind)",
    "eval_cosine_hits": f"""WITH lq AS (SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), w AS (SELECT vec_id - 1 AS q, embedding::DOUBLE[] AS v FROM embeddings),
        s AS (SELECT q, vec_id, e, {_COS} AS score FROM lq, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s),
        f AS (SELECT q, min(rank) FILTER ({_COS} > 0.6::DOUBLE) AS r FROM k JOIN w USING (q) WHERE rank <= 5 GROUP BY q)
        SELECT count(*) AS n, round(avg((coalesce(r, 99) <= 1)::INT), 4) AS hit1, round(avg((coalesce(r, 99) <= 3)::INT), 4) AS hit3, round(avg((coalesce(r, 99) <= 5)::INT), 4) AS hit5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM f""",
    "classifier_confusion": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic0, count(*) FILTER (toxic = 1) AS toxic1 FROM labels GROUP BY quality",
    "feedback_distinct": "SELECT props, min(event_id) AS first_seen, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY props",
    "judge_scores": "WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE CAST(c_custkey % 5 AS INT) END AS score FROM customer) SELECT score, count(*) AS n FROM c GROUP BY score",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k""",
    "stream_closed_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, k HAVING max(epoch_us(ts)) + 7200000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000""",
    "stream_state_sweep": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events), m AS (SELECT max(t) // 1000 - 600000 AS mark FROM e)
        SELECT user_id, (t + 7200000000 + 999) // 1000 AS swept_ms FROM e, m WHERE next > (t + 7200000000 + 999) // 1000 * 1000 OR (next IS NULL AND (t + 7200000000 + 999) // 1000 <= mark)""",
    "stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
}
