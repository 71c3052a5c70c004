"""Queries of the way from hits to an answer: reranking, the whole chain, budgets, guards, tools, logs, and what evaluates them; with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import decide as D
from corvane.functions import tools as L
from corvane.functions.text import VALID_CHARS, is_garbled
from corvane.operators import budget as U
from corvane.operators import evaluate as E
from corvane.operators import graph as G
from corvane.operators import ingest as I
from corvane.operators import requests as Q
from corvane.operators import rerank as K
from corvane.operators import retrieval as R
from corvane.plans import retrieval_queries as P
from corvane.plans.text_queries import _EST, FORBIDDEN, RULES, _rule_sql
from corvane.session import load
from corvane.streaming import gateway as W
from corvane.streaming import keyed

TEMPLATE = "Q {query}\nDOCS\n{docs}"
SHOWN = 60


def stand_in_ranker(prompts: list[str]) -> list[str]:
    """A ranking model without a model: it names the three candidates with the most letters e; some questions it fails on, and to some it answers nothing."""
    out = []
    for p in prompts:
        question, docs = p[2:].split("\nDOCS\n", 1)
        if len(question) % 7 == 0:
            raise ValueError("no answer")
        order = sorted(enumerate(docs.split("\n")), key=lambda x: (-x[1].split("] ", 1)[1].count("e"), x[0]))
        out.append(" " if len(question) % 5 == 0 else ",".join(str(i) for i, _ in order[:3]) + " of 99")
    return out


def _near(spark: SparkSession, sf: str, k: int) -> DataFrame:
    """Each item's documents by the vector of its number."""
    e = load(spark, sf, "embeddings")
    asked = load(spark, sf, "benchmark").select("item_id").join(e.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return P._hit_documents(spark, sf, R.dense(asked, e, "item_id", "vec_id", k).withColumnRenamed("vec_id", "doc_id"))


def _labels() -> Column:
    n = F.col("item_id")
    return F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en"), F.concat(F.lit("src"), (n % 20).cast("string"))))


def rerank_listwise(spark: SparkSession, sf: str) -> DataFrame:
    hits = _near(spark, sf, 12).select("item_id", "doc_id", "score", "rank", "text")
    out = K.rerank(hits, load(spark, sf, "benchmark").withColumnRenamed("text", "question"), "item_id", "doc_id", "question", TEMPLATE, stand_in_ranker, 5, 10, SHOWN)
    return out.select("item_id", "doc_id", "rank", "outcome")


def retrieve_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: three paths, fusion, boost, reranking, parents (a document stands for the next three), three rows for each item."""
    queries = load(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), _labels().alias("query_labels"))
    docs, n = load(spark, sf, "documents"), F.col("doc_id")
    rows = docs.select("doc_id", F.array("lang", "source").alias("labels"), F.when(n % 4 > 0, n - n % 4).alias("parent"), "text")
    parents = docs.select(n.alias("parent"), "text")
    out = K.retrieve(P._paths(spark, sf, 15, 15, 9), P._weights(spark, sf), queries, rows, parents, "item_id", "doc_id", 3, template=TEMPLATE, generator=stand_in_ranker)
    return out.select("item_id", "doc_id", F.coalesce("parent", F.lit(-1)).alias("parent"), F.round("score", 6).alias("score"), "rank", "outcome", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def request_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """A user's day as a request, ten days as a run; views and sign-ups are a model's time, of which sign-ups are no request's, and clicks are waits."""
    e = load(spark, sf, "events").withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")), "day": F.dayofmonth("ts")})
    name = F.concat_ws("-", "user_id", "day")
    requests = e.groupBy(name.alias("request_id"), (F.col("user_id") % 4).alias("level"), F.floor((F.col("day") - 1) / 10).alias("run")).agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("tokens"), F.bool_or((F.col("user_id") % 4 == 1) & (F.col("day") == 11)).alias("error")
    )
    event = F.when(F.col("event_type").isin("view", "signup"), Q.USAGE).when(F.col("event_type") == "click", Q.WAIT).otherwise("other")
    logs = e.select(event.alias("event"), F.when(F.col("event_type") == "signup", "background").otherwise(name).alias("request_id"), F.col("value").alias("ms"), "at")
    out = Q.summary(requests, logs)
    return out.select("level", "runs", "failed", *[F.round(c, 3).alias(c) for c in out.columns if c not in ("level", "runs", "failed")])


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as histories, the document of the same number as the context, small windows."""
    turns, docs = load(spark, sf, "conversations"), load(spark, sf, "documents")
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
    requests = last.join(docs.select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context")), "conv_id", "left")
    requests = requests.select("conv_id", F.lit("be brief").alias("system"), "question", "context", (200 + F.col("conv_id") % 5 * 400).alias("window"))
    out = U.guard(requests, turns, "conv_id", "turn", history=120, least=50)
    return out.withColumn("context", F.md5(F.col("context").cast("binary")))


def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels in a property, a type or a description; where two have one, the label that forbids goes first."""
    n = F.col("edge_id")
    e = P._edges(spark, sf).withColumns({"relation": F.when(n % 3 == 0, F.concat("relation", F.lit(" edge"))), "rel_type": F.when(n % 3 == 1, "rehab").otherwise(F.col("rel_type")), "description": F.when(n % 2 == 0, F.element_at(F.array(F.lit("is forbidden"), F.lit("with caution"), F.lit("as it is")), (n % 3 + 1).cast("int")))})
    return G.labelled(e).select("edge_id", "relation")


def path_listing(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("q"))
    starts = n.select("q", F.concat(F.when(F.col("q") % 2 == 0, "nation ").otherwise("n"), F.col("q").cast("string")).alias("name"))
    aliases = n.select(F.concat(F.lit("nation "), F.col("q").cast("string")).alias("alias"), F.concat(F.lit("n"), F.col("q").cast("string")).alias("canonical"))
    out = G.list_paths(starts, P._edges(spark, sf), aliases, "q")
    return out.select("q", "pos", F.array_join("nodes", ">").alias("nodes"), F.array_join("labels", "/").alias("labels"), "hops")


def input_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as questions, every second one as the profile too; every seventh is flagged by moderation."""
    profile = F.when(F.col("turn") % 2 == 1, F.col("text"))
    g = D.input_guard({"question": F.col("text"), "profile": profile}, F.when(F.col("turn") % 2 == 0, F.col("turn") % 7 == 2), RULES)
    out = load(spark, sf, "conversations").select("conv_id", "turn", g.alias("g"))
    return out.select("conv_id", "turn", F.col("g.blocked").alias("blocked"), F.coalesce("g.kind", F.lit("")).alias("kind"), F.col("g.score").cast("bigint").alias("score"), F.array_join("g.fields", ",").alias("fields"))


def answer_precheck(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    return d.select("doc_id", F.array_join(D.forbidden_precheck(F.col("text"), F.array(*[F.lit(a) for a in FORBIDDEN])), ",").alias("hits"))


def chunk_summaries(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id")
    meta = F.create_map(F.lit("exercise"), F.when(n % 3 == 0, F.col("source")), F.lit("muscle"), F.when(n % 2 == 0, F.col("lang")), F.lit("equipment"), F.lit(""), F.lit("difficulty"), F.when(n % 5 == 0, "hard"))
    return load(spark, sf, "documents").select("doc_id", D.chunk_summary(meta, F.col("text")).alias("summary"))


def retrieval_log(spark: SparkSession, sf: str) -> DataFrame:
    entry = D.log_entry(F.when(F.col("doc_id") % 4 > 0, F.col("source")), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), F.col("score"), F.col("text"))
    out = _near(spark, sf, 5).select("item_id", "rank", entry.alias("e")).select("item_id", "rank", "e.*")
    return out.fillna({"page": -1})


def message_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Assistants' turns as ai's, users' as human's; conversations without a system message keep their last question only."""
    c = load(spark, sf, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "ai").when(F.col("role") == "user", "human").otherwise(F.col("role")))
    return W.truncate_messages(c, "conv_id", "turn", "role").select("conv_id", "turn", "role")


def classifier_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = E.accuracy(load(spark, sf, "labels"), F.col("quality"), 1 - F.col("toxic"))
    return out.withColumn("accuracy", F.round("accuracy", 6))


def classifier_mistakes(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents"), "doc_id")
    return E.mistakes(rows, "doc_id", F.col("quality").cast("bigint"), (1 - F.col("toxic")).cast("bigint"), F.col("text"))


def judged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The three documents of each item that a judge sees: those of its language or source first."""
    hits = _near(spark, sf, 10).select("item_id", "doc_id", "rank", _labels().alias("ql"), F.array("lang", "source").alias("dl"))
    return E.matching_first(hits, "item_id", "ql", "dl").select("item_id", "doc_id", "rank")


def judge_means(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as judgements; some are missing and some out of range."""
    n = F.col("doc_id")
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.when(n % 3 > 0, F.col("quality").cast("double")).alias("faithfulness"), (F.col("toxic") * (1 + n % 2)).cast("double").alias("recall"))
    out = E.judge_means(rows, ("faithfulness", "recall"), "lang")
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", F.round("faithfulness", 6).alias("faithfulness"), F.round("recall", 6).alias("recall"))


def expectation_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as demonstrated cases: their roles as the names of citations, the beginnings of their turns as snippets."""
    n = F.col("conv_id")
    seen = load(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("role")).alias("roles"), F.collect_list(F.substring("text", 1, 20)).alias("snippets"))
    expected = {"blocked": n % 5 == 0, "refusal": n % 3 == 0, "answered": n % 3 == 1, "no_docs": n % 11 == 0, "min_docs": F.when(n % 2 == 0, 6), "cites_kind": F.when(n % 4 == 0, "system").otherwise(""), "contains": F.array(F.lit("the"), F.lit("user")), "excludes": F.when(n % 7 == 0, F.array(F.lit("assist")))}
    told = {"blocked": n % 10 == 0, "refusal": n % 2 == 0, "n_docs": F.col("n"), "kinds": F.col("roles"), "sources": F.col("roles"), "snippets": F.col("snippets")}
    return seen.select("conv_id", F.array_join(D.expectation_faults(expected, told), ",").alias("faults"))


def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages: of every fourth the first reading is a run of one letter, of every eighth the second too."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    pages = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.repeat(F.lit("a"), F.lit(40))).otherwise(F.col("text")))

    def again(poor: DataFrame) -> DataFrame:
        return poor.select("doc_id").join(docs, "doc_id").filter("doc_id % 8 > 0")

    kept, dropped = I.quality_loop(pages, "doc_id", again, is_garbled)
    return kept.select("doc_id", "tries", F.md5(F.col("text").cast("binary")).alias("text_md5")).unionByName(dropped.select("doc_id", F.lit(0).alias("tries"), F.lit("").alias("text_md5")))


def memory_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as measures of memory."""
    e = load(spark, sf, "events").select("user_id", "event_id", "value")
    return keyed.replay(e, "user_id", ["event_id"], ["value"], partial(keyed.memory_step, down=20.0, up=60.0), "degraded boolean, changed boolean")


def stand_in_chooser(prompts: list[str]) -> list[str]:
    """A chooser of tools without a model: by the length of the question two tools, one that there isn't, or a failure."""
    out = []
    for p in prompts:
        if len(p) % 5 == 0:
            raise ValueError("no tools")
        out.append(("heart_rate_zone, calculate_bmi", "no_such_tool", "", "estimate_water_intake")[len(p) % 4])
    return out


def health_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' numbers as questions and profiles."""
    n = F.col("c_custkey")
    profile = F.when(n % 3 > 0, F.concat(F.lit("身高 "), (150 + n % 50).cast("string"), F.lit("cm，体重"), (40 + n % 60).cast("string"), F.lit("kg")))
    question = F.concat(F.repeat(F.lit("a"), (n % 9).cast("int")), F.when(n % 4 == 0, "我该多喝水吗").when(n % 4 == 1, "BMI 和心率").otherwise("你好"), F.when(n % 2 == 1, F.concat(F.lit("，"), (n % 80).cast("string"), F.lit("岁"))).otherwise(""))
    rows = load(spark, sf, "customer").select("c_custkey", question.alias("question"), profile.alias("profile"))
    out = L.resolve(rows, "c_custkey", "question", "profile", "{question}", stand_in_chooser)
    return out.select("c_custkey", "decided_by", F.array_join(F.transform("results", lambda r: F.concat(r["name"], F.lit(":"), r["content"])), "|").alias("results"))


QUERIES = {
    f.__name__: f
    for f in (
        rerank_listwise, retrieve_chain, request_attribution, token_budget, edge_labels, path_listing, input_guard, answer_precheck, chunk_summaries, retrieval_log, message_truncate,
        classifier_accuracy, classifier_mistakes, judged_documents, judge_means, expectation_audit, page_quality, memory_hysteresis, health_tools,
    )
}

_NEAR = f"""lv AS (SELECT item_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
        vs AS (SELECT item_id, vec_id AS doc_id, {P._COS} AS score FROM lv, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
        nr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vs),
        near AS (SELECT nr.*, text, lang, source FROM nr JOIN documents USING (doc_id) WHERE rank <= {{k}})"""


def _rerank_sql(hits: str, k: int, pool: int, shown: int) -> str:
    """CTEs up to rr: hits (item_id, doc_id, rank, text and more) with new and outcome, by the stand-in's rule."""
    return f"""pl AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n, substr(replace(text, chr(10), ' '), 1, {shown}) AS s FROM {hits} WHERE rank <= {pool}),
        nm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(s) - length(replace(s, 'e', '')) DESC, rank) AS o FROM pl),
        oc AS (SELECT nm.*, CASE WHEN n <= {k} THEN 'short' WHEN length(b.text) % 7 = 0 THEN 'error' WHEN length(b.text) % 5 = 0 THEN 'kept' ELSE 'ok' END AS outcome FROM nm JOIN benchmark b USING (item_id)),
        rr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN outcome = 'ok' AND o <= 3 THEN o ELSE 100 END, rank) AS new FROM oc QUALIFY new <= {k})"""


_TOOL_SQL = {
    "calculate_bmi": "CASE WHEN h > 0 AND w > 0 THEN printf('身高%dcm、体重%dkg → BMI=%.1f，属%s。BMI 仅作参考，肌肉量大者可能被高估，需结合体脂率判断。', h, w, round_even(bmi, 1), CASE WHEN bmi < 18.5 THEN '偏瘦（<18.5）' WHEN bmi < 24 THEN '正常（18.5-23.9）' WHEN bmi < 28 THEN '超重（24-27.9）' ELSE '肥胖（≥28）' END) END",
    "estimate_water_intake": "CASE WHEN w > 0 THEN printf('体重%dkg → 基础饮水量约 %dml（约 %.1f 瓶 500ml），运动日建议额外补充 500-1000ml。', w, w * 30, round_even(w * 30 / 500::DOUBLE, 1)) END",
    "heart_rate_zone": "CASE WHEN a > 0 THEN printf('年龄%d岁 → 最大心率≈%d 次/分；燃脂区（60-70%%）=%d-%d，有氧耐力区（70-80%%）=%d-%d。', a, 220 - a, round_even((220 - a) * 0.6::DOUBLE, 0)::INT, round_even((220 - a) * 0.7::DOUBLE, 0)::INT, round_even((220 - a) * 0.7::DOUBLE, 0)::INT, round_even((220 - a) * 0.8::DOUBLE, 0)::INT) END",
}
ORACLE = {
    "rerank_listwise": f"WITH {_NEAR.replace('{k}', '12')}, dn AS (SELECT * REPLACE (row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank) FROM near), {_rerank_sql('dn', 5, 10, SHOWN)} SELECT item_id, doc_id, new AS rank, outcome FROM rr",
    "retrieve_chain": f"""WITH {P._BM25.replace("{k}", "15")}, {P._PATHS.replace("<= 15)", "<= 9)").replace("{v}", "15")}, {P._weights_sql()},
        f AS (SELECT p.item_id, doc_id, sum(CASE path WHEN 'vector' THEN wv WHEN 'graph' THEN wg ELSE wb END * score) AS score, max(score) FILTER (path = 'vector') AS raw FROM paths p JOIN wt USING (item_id) GROUP BY ALL),
        k AS (SELECT item_id, doc_id, score FROM f WHERE round(score, 9) >= 0.2 OR round(raw, 9) >= 0.4 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) <= 39),
        b AS (SELECT item_id, doc_id, text, CASE WHEN doc_id % 4 > 0 THEN doc_id - doc_id % 4 END AS parent, score * CASE WHEN item_id % 3 = 0 THEN 1.0 WHEN lang = 'en' OR source = 'src' || (item_id % 20) THEN 1.5 ELSE 0.85 END::DOUBLE AS score FROM k JOIN documents USING (doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b), {_rerank_sql('r', 3, 15, 400).replace("nm AS", "nm_ AS").replace("FROM nm JOIN", "FROM nm_ JOIN").replace("nm.*", "nm_.*")},
        g AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY item_id, coalesce(parent::VARCHAR, '#' || doc_id) ORDER BY new) = 1)
        SELECT item_id, g.doc_id, coalesce(parent, -1) AS parent, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY new) AS rank, outcome, md5(coalesce(substr(d.text, 1, 5000), g.text)) AS text_md5
        FROM g LEFT JOIN documents d ON d.doc_id = parent""",
    "request_attribution": """WITH e AS (SELECT *, epoch_us(ts) AS tm, user_id || '-' || day(ts) AS id, user_id % 4 AS level, (day(ts) - 1) // 10 AS run FROM events),
        r AS (SELECT id, level, run, min(tm) AS s, max(tm) AS e, count(*) AS tokens, bool_or(user_id % 4 = 1 AND day(ts) = 11) AS bad,
            coalesce(sum(value) FILTER (event_type = 'view'), 0) AS llm, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS wait FROM e GROUP BY id, level, run),
        m AS (SELECT *, (e - s) / 1000::DOUBLE AS total, greatest(0, (e - s) / 1000::DOUBLE - llm) AS other FROM r),
        u AS (SELECT level, run, min(s) AS s, max(e) AS e, count(*) AS n, sum(tokens) AS tokens, count(*) FILTER (bad) AS bad, list_sort(list(total)) AS total, list_sort(list(llm)) AS llm, list_sort(list(wait)) AS wait, list_sort(list(other)) AS other FROM m GROUP BY ALL),
        x AS (SELECT level, run, (e - s) / 1e6::DOUBLE AS wall_s, tokens / nullif((e - s) / 1e6::DOUBLE, 0) AS tokens_s, (SELECT coalesce(sum(value), 0) FROM e b WHERE b.event_type = 'signup' AND b.tm BETWEEN u.s AND u.e) AS background_ms,
            least(n, floor(n * 0.5::DOUBLE) + 1)::BIGINT AS h, least(n, floor(n * 0.95::DOUBLE) + 1)::BIGINT AS t, total, llm, wait, other FROM u WHERE bad = 0),
        c AS (SELECT level, count(*) AS runs, count(*) FILTER (bad > 0) AS failed FROM u GROUP BY level),
        d AS (SELECT level, round(median(wall_s), 3) AS wall_s, round(median(tokens_s), 3) AS tokens_s, round(median(background_ms), 3) AS background_ms, round(median(total[h]), 3) AS total_ms_p50, round(median(total[t]), 3) AS total_ms_p95,
            round(median(llm[h]), 3) AS llm_ms_p50, round(median(llm[t]), 3) AS llm_ms_p95, round(median(wait[h]), 3) AS wait_ms_p50, round(median(wait[t]), 3) AS wait_ms_p95, round(median(other[h]), 3) AS other_ms_p50, round(median(other[t]), 3) AS other_ms_p95 FROM x GROUP BY level)
        SELECT * FROM c LEFT JOIN d USING (level)""",
    "token_budget": rf"""WITH t AS (SELECT conv_id, turn, {_EST.format('text')} AS t FROM conversations),
        h AS (SELECT conv_id, sum(t) AS hist FROM t GROUP BY conv_id),
        kt AS (SELECT conv_id, t FROM t QUALIFY sum(t) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 120 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2),
        k AS (SELECT conv_id, sum(t) AS held FROM kt GROUP BY conv_id), l AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations GROUP BY conv_id),
        a AS (SELECT conv_id, coalesce(d.text, '') AS ctx, {_EST.format("'be brief'")} + {_EST.format('q')} AS fixed, hist, held, floor((200 + conv_id % 5 * 400) * 0.55::DOUBLE)::BIGINT AS budget FROM l JOIN h USING (conv_id) JOIN k USING (conv_id) LEFT JOIN documents d ON d.doc_id = conv_id),
        b AS (SELECT *, {_EST.format('ctx')} AS c, fixed + hist + {_EST.format('ctx')} AS before FROM a),
        e AS (SELECT *, before > budget AND hist > 120 AS trimmed, CASE WHEN before > budget AND hist > 120 THEN held ELSE hist END AS now FROM b),
        f AS (SELECT *, greatest(50, budget - fixed - now) AS room, before > budget AND c > greatest(50, budget - fixed - now) AS cut FROM e),
        p AS (SELECT conv_id, room, unnest(regexp_extract_all(ctx, '([^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$)', 1)) AS part, generate_subscripts(regexp_extract_all(ctx, '([^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$)', 1), 1) AS i FROM f WHERE cut),
        u AS (SELECT *, sum({_EST.format('part')}) OVER (PARTITION BY conv_id ORDER BY i) AS used FROM p), s AS (SELECT conv_id, string_agg(part, '' ORDER BY i) AS kept FROM u WHERE used <= room GROUP BY conv_id),
        g AS (SELECT f.*, CASE WHEN NOT cut THEN ctx WHEN coalesce(kept, '') = '' THEN substr(ctx, 1, greatest(50, floor(length(ctx) * (room::DOUBLE / greatest(c, 1)))::INT)) || '…' ELSE kept || '{U.MARKER}' END AS context FROM f LEFT JOIN s USING (conv_id)),
        o AS (SELECT *, fixed + now + {_EST.format('context')} AS after FROM g)
        SELECT conv_id, md5(context) AS context, budget, before::BIGINT AS total_before, after::BIGINT AS total_after, now::BIGINT AS history_tokens, CASE WHEN trimmed AND cut THEN 'trim_both' WHEN cut THEN 'trim_context' WHEN trimmed THEN 'trim_history' ELSE 'none' END AS action,
            before > budget AND 1 - after::DOUBLE / greatest(before, 1) >= 0.3::DOUBLE AS warning FROM o""",
    "edge_labels": f"""WITH {P._EDGES}, x AS (SELECT edge_id, CASE WHEN edge_id % 3 = 0 THEN relation || ' edge' END AS p, CASE WHEN edge_id % 3 = 1 THEN 'rehab' ELSE rel_type END AS t, CASE WHEN edge_id % 2 = 0 THEN ['is forbidden', 'with caution', 'as it is'][CAST(edge_id % 3 + 1 AS INT)] END AS d FROM e),
        y AS (SELECT *, concat_ws('|', p, t, d) AS w FROM x) SELECT edge_id, CASE WHEN contains(w, 'forbidden') THEN 'forbidden' WHEN contains(w, 'rehab') THEN 'rehab' WHEN contains(w, 'caution') THEN 'caution' ELSE coalesce(d, t) END AS relation FROM y""",
    "path_listing": f"""WITH {P._EDGES}, s AS (SELECT n_nationkey AS q, 'n' || n_nationkey AS start FROM nation),
        a AS (SELECT q, 1 AS hops, edge_id AS e1, 0 AS e2, start || '>' || dst AS nodes, relation AS labels, dst FROM s JOIN e ON src = start),
        b AS (SELECT q, 2, e1, e.edge_id, nodes || '>' || e.dst, labels || '/' || relation, e.dst FROM a JOIN e ON e.src = a.dst AND e.edge_id <> e1),
        o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hops, e1, e2) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY pos <= 30) SELECT q, pos, nodes, labels, hops::BIGINT AS hops FROM o""",
    "input_guard": f"""WITH s AS (SELECT conv_id, turn, {_rule_sql()} AS one, coalesce(turn % 2 = 0 AND turn % 7 = 2, false) AS flag FROM conversations), t AS (SELECT *, CASE WHEN turn % 2 = 1 THEN one * 2 ELSE one END AS score FROM s)
        SELECT conv_id, turn, score >= 4 OR flag AS blocked, CASE WHEN score >= 4 THEN 'injection' WHEN flag THEN 'moderation' ELSE '' END AS kind, score::BIGINT AS score, CASE WHEN score < 4 THEN '' WHEN turn % 2 = 1 THEN 'profile,question' ELSE 'question' END AS fields FROM t""",
    "answer_precheck": f"SELECT doc_id, array_to_string(list_filter({list(FORBIDDEN)}, lambda a: contains(text, a)), ',') AS hits FROM documents",
    "chunk_summaries": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[' || source || ']' || CASE WHEN doc_id % 2 = 0 THEN ' 肌群:' || lang ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' 难度:hard' ELSE '' END
        ELSE substr(replace(text, chr(10), ' '), 1, 150) || CASE WHEN length(text) > 150 THEN '...' ELSE '' END END AS summary FROM documents""",
    "retrieval_log": f"""WITH {_NEAR.replace('{k}', '5')} SELECT item_id, rank, CASE WHEN doc_id % 4 > 0 THEN source ELSE '未知' END AS source, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE -1 END AS page, round(score, 4) AS score, substr(replace(text, chr(10), ' '), 1, 120) AS snippet FROM near""",
    "message_truncate": """SELECT conv_id, turn, role FROM conversations WHERE true QUALIFY role = 'system' OR (role = 'user' AND turn = max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id)) OR NOT bool_or(role IN ('system', 'user')) OVER (PARTITION BY conv_id)""",
    "classifier_accuracy": "SELECT count(*) AS n, sum((quality = 1 - toxic)::INT)::BIGINT AS correct, round(avg((quality = 1 - toxic)::INT), 6) AS accuracy FROM labels",
    "classifier_mistakes": "SELECT doc_id, quality::BIGINT AS predicted, (1 - toxic)::BIGINT AS expected, substr(text, 1, 40) AS text FROM labels JOIN documents USING (doc_id) WHERE quality <> 1 - toxic",
    "judged_documents": f"""WITH {_NEAR.replace('{k}', '10')}, m AS (SELECT item_id, doc_id, rank AS old, item_id % 3 > 0 AND (lang = 'en' OR source = 'src' || (item_id % 20)) AS hit FROM near)
        SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY hit DESC, old) AS rank FROM m QUALIFY rank <= 3""",
    "judge_means": """WITH j AS (SELECT lang, CASE WHEN doc_id % 3 > 0 THEN quality END AS f, toxic * (1 + doc_id % 2) AS r FROM labels JOIN documents USING (doc_id))
        SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(f), 6) AS faithfulness, round(avg(r) FILTER (r <= 1), 6) AS recall FROM j GROUP BY ROLLUP (lang)""",
    "expectation_audit": """WITH s AS (SELECT conv_id, count(*) AS n, string_agg(DISTINCT role, ' ' ORDER BY role) AS names, string_agg(substr(text, 1, 20), ' ') AS snip FROM conversations GROUP BY conv_id)
        SELECT conv_id, concat_ws(',', CASE WHEN conv_id % 5 = 0 AND conv_id % 10 <> 0 THEN 'blocked' END, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 <> 0 THEN 'refusal' END, CASE WHEN conv_id % 3 = 1 AND conv_id % 2 = 0 THEN 'answered' END,
            CASE WHEN conv_id % 11 = 0 THEN 'no_docs' END, CASE WHEN conv_id % 2 = 0 AND n < 6 THEN 'min_docs' END, CASE WHEN conv_id % 4 = 0 AND NOT contains(names, 'system') THEN 'cites_kind' END,
            CASE WHEN NOT contains(names || ' ' || snip, 'the') THEN 'contains:the' END, CASE WHEN NOT contains(names || ' ' || snip, 'user') THEN 'contains:user' END, CASE WHEN conv_id % 7 = 0 AND contains(names, 'assist') THEN 'excludes:assist' END) AS faults FROM s""",
    "page_quality": r"""WITH g AS (SELECT doc_id, text, regexp_replace(text, '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g') AS t FROM documents),
        m AS (SELECT doc_id, text, length(t) < 10 OR len(regexp_extract_all(t, '{V}'))::DOUBLE / length(t) < 0.6 OR list_max(list_transform(list_distinct(string_split(t, '')), lambda c: length(t) - length(replace(t, c, ''))))::DOUBLE / length(t) > 0.3 AS bad FROM g),
        x AS (SELECT doc_id, text, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN bad THEN 0 ELSE 1 END WHEN doc_id % 8 = 0 OR bad THEN 0 ELSE 2 END AS tries FROM m)
        SELECT doc_id, tries::INT AS tries, CASE WHEN tries = 0 THEN '' ELSE md5(text) END AS text_md5 FROM x""",
    "memory_hysteresis": """WITH l AS (SELECT user_id, event_id, coalesce(last_value(CASE WHEN value < 20 THEN 1 WHEN value >= 60 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 1 AS degraded FROM events)
        SELECT *, degraded <> coalesce(lag(degraded) OVER (PARTITION BY user_id ORDER BY event_id), false) AS changed FROM l""",
    "health_tools": f"""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN 150 + c_custkey % 50 END AS h, CASE WHEN c_custkey % 3 > 0 THEN 40 + c_custkey % 60 END AS w, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 80 END AS a,
            c_custkey % 9 + CASE c_custkey % 4 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 2 END + CASE WHEN c_custkey % 2 = 1 THEN 2 + length((c_custkey % 80)::VARCHAR) ELSE 0 END AS n FROM customer),
        b AS (SELECT *, w / ((h / 100::DOUBLE) * (h / 100::DOUBLE)) AS bmi, h IS NOT NULL OR a IS NOT NULL AS told FROM c),
        t AS (SELECT *, {", ".join(f"'{name}:' || {sql} AS {name}" for name, sql in _TOOL_SQL.items())} FROM b),
        r AS (SELECT k, CASE WHEN NOT told OR n % 5 = 0 THEN '' WHEN n % 4 = 0 THEN concat_ws('|', calculate_bmi, heart_rate_zone) WHEN n % 4 = 3 THEN coalesce(estimate_water_intake, '') ELSE '' END AS m,
            CASE WHEN NOT told THEN '' WHEN k % 4 = 0 THEN coalesce(estimate_water_intake, '') WHEN k % 4 = 1 THEN concat_ws('|', calculate_bmi, heart_rate_zone) ELSE '' END AS w FROM t)
        SELECT k AS c_custkey, CASE WHEN m <> '' THEN 'model' WHEN w <> '' THEN 'keyword' ELSE 'none' END AS decided_by, CASE WHEN m <> '' THEN m ELSE w END AS results FROM r""",
}
ORACLE["page_quality"] = ORACLE["page_quality"].replace("{V}", VALID_CHARS.replace("\\s", r" \t\n\r\f\x0B"))
