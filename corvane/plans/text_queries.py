"""Queries over single texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as T
from corvane.session import load

#: Dictionaries of the sample queries; the functions take any.
DICTIONARY = {"injury": ("thenth", "onan", "inen", "hean"), "body_part": ("an", "there", "the"), "exercise": ("tion", "ingan", "ing")}
MARKERS = ("and", "or", "+")
PLAN_WORDS = ("ention", "reand")
FORBIDDEN, SAMPLE_NEGATIONS = ("shea", "leau", "the"), ("that", "with")
RULES = T.INJECTION_RULES + ((r"\bthe\s+th\w+", 2), (r"(on|in)\s+an\w*", 3))


def doc_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def doc_garble_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = T.stripped(F.col("text"))
    told = load(spark, sf, "documents").select("doc_id", F.char_length(t).alias("n"), T.valid_ratio(t).alias("v"), T.repetition_ratio(t).alias("r"))
    garbled = (F.col("n") < T.GARBLE_MIN_CHARS) | (F.col("v") < T.GARBLE_VALID) | (F.col("r") > T.GARBLE_REPEAT)
    return told.select("doc_id", F.round("v", 6).alias("valid_ratio"), F.round("r", 6).alias("top_share"), garbled.alias("garbled"))


def doc_snippet_clean(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.clean_snippet(F.col("text")).alias("snippet"))


def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations").select("conv_id", T.injection_score([F.col("text")], RULES).alias("score"))
    return turns.groupBy("conv_id").agg(F.sum("score").cast("bigint").alias("score")).withColumn("blocked", F.col("score") >= T.INJECTION_BLOCK)


def redact_profile(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.md5(T.redact_line(F.col("text"), "The ").cast("binary")).alias("redacted_md5"))


def hard_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = load(spark, sf, "documents").select("doc_id", T.hard_filter(F.col("text"), FORBIDDEN, SAMPLE_NEGATIONS).alias("f"))
    return out.select("doc_id", F.col("f.text").alias("text"), F.array_join("f.removed", ",").alias("removed"))


def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, sf, "benchmark").select("item_id", T.entities(F.col("text"), DICTIONARY).alias("e"))
    return found.select("item_id", *[F.coalesce(F.array_join(F.col("e")[k], ","), F.lit("")).alias(k) for k in DICTIONARY])


def query_class_routing(spark: SparkSession, sf: str) -> DataFrame:
    found = load(spark, sf, "benchmark").withColumn("e", T.entities(F.col("text"), DICTIONARY))
    routed = found.withColumn("w", T.route_weights(F.col("e")))
    return routed.select("item_id", T.query_class(F.col("e"), F.col("text"), MARKERS).alias("class"), F.col("w.vector").alias("w_vector"), F.col("w.bm25").alias("w_bm25"), F.col("w.graph").alias("w_graph"), T.tier(F.col("e"), F.col("text"), PLAN_WORDS).alias("tier"))


def context_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", T.truncate_sentences(F.col("text"), 150).alias("context"))


def grounding_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as contexts; labels as their scores."""
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    score, relevance = F.coalesce(F.col("quality") * 0.5, F.lit(0.1)), F.when(F.col("toxic").isNotNull(), 1.0 - F.col("toxic") * 0.7)
    reason = T.grounding(F.col("n_chars"), F.when(F.col("lang") == "es", 0).otherwise(3), score, relevance, F.contains("text", F.lit("the")), F.col("source") == "src3")
    return joined.select("doc_id", reason.alias("reason"), reason.isin("ok", "external_only").alias("grounded"))


def health_numbers(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", (150 + F.col("c_custkey") % 50).cast("double").alias("h"), (40 + F.col("c_custkey") % 60).cast("double").alias("w"), (F.col("c_custkey") % 80).cast("double").alias("a"))
    m = c.select("c_custkey", T.health_metrics(F.col("h"), F.col("w"), F.col("a")).alias("m"))
    return m.select("c_custkey", F.round("m.bmi", 6).alias("bmi"), F.col("m.band").alias("band"), F.col("m.water_ml").alias("water_ml"), F.col("m.max_hr").alias("max_hr"), F.round("m.fat_low", 6).alias("fat_low"), F.round("m.fat_high", 6).alias("fat_high"))


def near_duplicate_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn against the five user turns before it in its conversation."""
    users = load(spark, sf, "conversations").filter("role = 'user'").withColumn("grams", T.bigrams(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    best = F.greatest(*[F.coalesce(T.jaccard(F.col("grams"), F.lag("grams", k).over(order)), F.lit(0.0)) for k in range(1, 6)])
    return users.select("conv_id", "turn", F.round(best, 6).alias("best"), (best >= 0.85).alias("duplicate"))


def error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Events as failures: the type as the name, the id as the status."""
    e = load(spark, sf, "events")
    kind = T.error_kind(F.col("event_type"), (F.col("event_id") % 600).cast("int"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")))
    return e.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("retryable", F.col("kind").isin(*T.RETRYABLE))


def _entity_sql() -> str:
    """One nested query for each keyword, longest first, over one column of text left for each type."""
    sql = "SELECT item_id, text, " + ", ".join(f"text AS l_{k}, ''::VARCHAR AS {k}" for k in DICTIONARY) + " FROM benchmark"
    for kind, names in DICTIONARY.items():
        for name in sorted(names, key=len, reverse=True):
            at = f"instr(l_{kind}, '{name}')"
            sql = f"""SELECT * REPLACE (CASE WHEN {at} > 0 THEN substr(l_{kind}, 1, {at} - 1) || substr(l_{kind}, {at} + {len(name)}) ELSE l_{kind} END AS l_{kind},
                      CASE WHEN {at} > 0 THEN {kind} || CASE WHEN {kind} = '' THEN '' ELSE ',' END || '{name}' ELSE {kind} END AS {kind}) FROM ({sql})"""
    return sql


def _rule_sql() -> str:
    return " + ".join("CASE WHEN regexp_matches(text, '" + p.replace("'", "''") + f"', 'i') THEN {w} ELSE 0 END" for p, w in RULES)


_EST = "CAST(floor(len(regexp_extract_all({0}, '[一-鿿]')) * 1.5::DOUBLE + (length({0}) - len(regexp_extract_all({0}, '[一-鿿]'))) * 0.3::DOUBLE) AS BIGINT)"
_WS = r"[\t\n\x0B\f\r ]"

QUERIES = {
    "doc_token_estimate": doc_token_estimate, "doc_garble_filter": doc_garble_filter, "doc_snippet_clean": doc_snippet_clean, "injection_scan": injection_scan,
    "redact_profile": redact_profile, "hard_line_filter": hard_line_filter, "entity_extract": entity_extract, "query_class_routing": query_class_routing,
    "context_truncate": context_truncate, "grounding_gate": grounding_gate, "health_metrics": health_numbers, "near_duplicate_turns": near_duplicate_turns, "error_kinds": error_kinds,
}
ORACLE = {
    "doc_token_estimate": f"SELECT doc_id, coalesce({_EST.format('text')}, 0) AS tokens FROM documents",
    "doc_garble_filter": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM documents),
        m AS (SELECT doc_id, t, len(regexp_extract_all(t, '{T.VALID_CHARS.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r' + chr(92) + 'f' + chr(92) + 'x0B')}'))::DOUBLE / length(t) AS v,
                     list_max(list_transform(list_distinct(string_split(t, '')), lambda c: length(t) - length(replace(t, c, ''))))::DOUBLE / length(t) AS r FROM t)
        SELECT doc_id, round(v, 6) AS valid_ratio, round(r, 6) AS top_share, (length(t) < 10 OR v < 0.6 OR r > 0.3) AS garbled FROM m""",
    "doc_snippet_clean": rf"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '{_WS}+', ' ', 'g')), '{T.SNIPPET_TAIL}', '')) AS t FROM documents),
        c AS (SELECT doc_id, t, substr(t, 1, 120) AS cut FROM t), e AS (SELECT *, regexp_extract(cut, '^(.*{T.SENTENCE_ENDS})', 1) AS w FROM c)
        SELECT doc_id, CASE WHEN length(t) <= 120 THEN t WHEN length(w) >= 60 THEN w ELSE cut || '…' END AS snippet FROM e""",
    "injection_scan": f"SELECT conv_id, sum({_rule_sql()})::BIGINT AS score, sum({_rule_sql()}) >= 4 AS blocked FROM conversations GROUP BY conv_id",
    "redact_profile": r"SELECT doc_id, md5(regexp_replace(text, '(The )[^\n]*', '\1[redacted]', 'g')) AS redacted_md5 FROM documents",
    "hard_line_filter": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        h AS (SELECT *, CASE WHEN contains(line, 'that') OR contains(line, 'with') THEN NULL WHEN contains(line, 'shea') THEN 'shea' WHEN contains(line, 'leau') THEN 'leau' WHEN contains(line, 'the') THEN 'the' END AS hit FROM l),
        f AS (SELECT doc_id, hit, min(i) AS i FROM h WHERE hit IS NOT NULL GROUP BY ALL), r AS (SELECT doc_id, string_agg(hit, ',' ORDER BY i) AS removed FROM f GROUP BY doc_id)
        SELECT h.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE hit IS NULL), '') AS text, coalesce(any_value(r.removed), '') AS removed FROM h LEFT JOIN r USING (doc_id) GROUP BY h.doc_id""",
    "entity_extract": f"SELECT item_id, {', '.join(DICTIONARY)} FROM ({_entity_sql()})",
    "query_class_routing": f"""
        WITH e AS ({_entity_sql()}), s AS (SELECT *, CASE WHEN injury = '' THEN 0 ELSE len(string_split(injury, ',')) END AS ni, CASE WHEN body_part = '' THEN 0 ELSE len(string_split(body_part, ',')) END AS np,
            CASE WHEN body_part = '' THEN 0 ELSE len(list_filter(string_split(body_part, ','), lambda p: NOT contains(injury, p))) END AS extra FROM e)
        SELECT item_id, CASE WHEN ni = 0 THEN 'simple' WHEN ni >= 2 OR extra > 0 OR contains(text, 'and') OR contains(text, 'or') OR contains(text, '+') THEN 'compound_injury' ELSE 'single_injury' END AS class,
            CASE WHEN ni = 0 AND np = 0 THEN 0.40 WHEN ni >= 2 OR (ni >= 1 AND np >= 1) THEN 0.20 ELSE 0.30 END::DOUBLE AS w_vector,
            CASE WHEN ni = 0 AND np = 0 THEN 0.35 ELSE 0.25 END::DOUBLE AS w_bm25,
            CASE WHEN ni = 0 AND np = 0 THEN 0.25 WHEN ni >= 2 OR (ni >= 1 AND np >= 1) THEN 0.55 ELSE 0.45 END::DOUBLE AS w_graph,
            CASE WHEN ni > 0 OR np > 0 THEN 'injury' WHEN contains(text, 'ention') OR contains(text, 'reand') THEN 'plan' ELSE 'simple' END AS tier FROM s""",
    "context_truncate": rf"""
        WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '([^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$)', 1) AS p FROM documents),
        u AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM p),
        c AS (SELECT doc_id, part, i, sum({_EST.format('part')}) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM u),
        k AS (SELECT doc_id, string_agg(part, '' ORDER BY i) AS kept FROM c WHERE used <= 150 GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN coalesce(text, '') = '' THEN '' WHEN {_EST.format('text')} <= 150 THEN text
               WHEN coalesce(kept, '') = '' THEN substr(text, 1, greatest(50, CAST(floor(length(text) * (150::DOUBLE / greatest({_EST.format('text')}, 1))) AS INT))) || '…'
               ELSE kept || '[truncated]' END AS context FROM documents d LEFT JOIN k USING (doc_id)""",
    "grounding_gate": """
        WITH j AS (SELECT d.*, coalesce(quality * 0.5::DOUBLE, 0.1) AS s, CASE WHEN toxic IS NOT NULL THEN 1.0::DOUBLE - toxic * 0.7::DOUBLE END AS r, CASE WHEN lang = 'es' THEN 0 ELSE 3 END AS n FROM documents d LEFT JOIN labels USING (doc_id)),
        g AS (SELECT doc_id, CASE WHEN source = 'src3' AND n_chars > 0 THEN 'external_only' WHEN n = 0 THEN 'no_docs' WHEN r IS NOT NULL AND NOT contains(text, 'the') AND r < 0.4 THEN 'low_relevance'
              WHEN s < 0.2 THEN 'low_score' WHEN n_chars < 80 THEN 'ctx_too_short' ELSE 'ok' END AS reason FROM j)
        SELECT doc_id, reason, reason IN ('ok', 'external_only') AS grounded FROM g""",
    "health_metrics": """
        WITH c AS (SELECT c_custkey, (150 + c_custkey % 50)::DOUBLE AS h, (40 + c_custkey % 60)::DOUBLE AS w, nullif((c_custkey % 80)::DOUBLE, 0) AS a FROM customer),
        b AS (SELECT *, w / ((h / 100::DOUBLE) * (h / 100::DOUBLE)) AS bmi FROM c)
        SELECT c_custkey, round(bmi, 6) AS bmi, CASE WHEN bmi < 18.5 THEN 'under' WHEN bmi < 24 THEN 'normal' WHEN bmi < 28 THEN 'over' ELSE 'obese' END AS band, w * 30::DOUBLE AS water_ml, 220::DOUBLE - a AS max_hr,
               round((220 - a) * 0.6::DOUBLE, 6) AS fat_low, round((220 - a) * 0.7::DOUBLE, 6) AS fat_high FROM b""",
    "near_duplicate_turns": """
        WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN length(text) >= 2 THEN list_distinct(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) ELSE [] END AS g FROM conversations WHERE role = 'user'),
        p AS (SELECT a.conv_id, a.turn, CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) ELSE 0 END AS j FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.k BETWEEN a.k - 5 AND a.k - 1)
        SELECT conv_id, turn, round(coalesce(max(j), 0)::DOUBLE, 6) AS best, coalesce(max(j), 0) >= 0.85 AS duplicate FROM p GROUP BY ALL""",
    "error_kinds": """
        WITH k AS (SELECT CASE WHEN event_id % 600 = 429 THEN 'rate_limited' WHEN event_id % 600 = 401 THEN 'auth' WHEN event_id % 600 = 403 THEN 'quota' WHEN event_id % 600 >= 500 THEN 'server' ELSE 'unknown' END AS kind FROM events)
        SELECT kind, count(*) AS n, kind IN ('timeout', 'rate_limited', 'server', 'network') AS retryable FROM k GROUP BY kind""",
}
