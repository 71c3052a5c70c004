import collections
from datetime import datetime

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from corvane.functions import decide as D
from corvane.operators import builders as B
from corvane.operators import retrieval as R
from corvane.plans import decision_queries as Q
from corvane.sources import sinks
from corvane.streaming import gateway as K_gateway
from corvane.streaming import keyed as K

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", Q.ORACLE)
def test_query_agrees_with_sql(spark, name):
    assert_same(spark, Q.QUERIES[name], Q.ORACLE[name], SF)


def test_cache_goes_first_in_first_out(spark):
    caches, want = collections.defaultdict(dict), set()
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id").collect()
    for e in events:
        cache = caches[e.event_type]
        hit = e.user_id in cache
        cache[e.user_id] = True
        gone = list(cache)[:2] if len(cache) > 5 else []
        for name in gone:
            del cache[name]
        want.add((e.event_type, e.event_id, hit, len(cache), len(gone)))
    assert {tuple(r) for r in Q._fifo(spark, SF, 5, 2).collect()} == want
    assert any(r[4] for r in want) and any(r[2] for r in want)


def test_stream_and_batch_near_duplicates_agree(spark):
    batch = {tuple(r) for r in Q.near_duplicates_by_tag(spark, SF).collect()}
    assert batch == {tuple(r) for r in Q.stream_near_duplicates(spark, SF).collect()} and batch


def test_near_duplicates_look_at_their_own_tag():
    state, told = None, []
    for row in [("a", "hello there"), ("b", "hello there"), ("a", "hello there"), ("a", "x")]:
        out, state = K.noise_by_tag(state, row)
        told.append(out[0])
    assert told == [False, False, True, False]


def test_breaker_opens_probes_and_closes():
    state, told = None, []
    for row in [(0, False), (1, False), (2, False), (3, True), (32, False), (33, True), (62, True), (63, False)]:
        out, state = K.breaker_step(state, row)
        told.append(out)
    assert told == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_window_starts_again_at_the_first_use_after_its_end():
    day, state, told = 86_400_000_000, None, []
    for at in (5, day + 4, day + 5, 2 * day, 5 * day):
        out, state = K.window_step(state, (at,))
        told.append(out[0])
    assert told == [5, 5, day + 5, day + 5, 5 * day]


def test_snapshot_pointer(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sinks.read_snapshot(spark, root, frame.schema).count() == 0
    for n in (1, 2, 3):
        version = sinks.write_snapshot(frame.filter(F.col("k") < n), root)
        assert sinks.read_snapshot(spark, root, frame.schema).count() == min(n - 1, 2) and sinks.pointed(spark, root) == version
    assert len(list((tmp_path / "snap").glob("v-*"))) == 2
    (tmp_path / "snap" / version / "_SUCCESS").unlink()
    assert sinks.read_snapshot(spark, root, frame.schema).count() == 0


def test_only_a_whole_run_becomes_the_latest(spark, tmp_path):
    root, metrics = f"file://{tmp_path}/runs", spark.createDataFrame([(0.5,)], "mrr double")
    sinks.save_run(metrics, root, "a", partial=False)
    sinks.save_run(metrics, root, "b", partial=True)
    assert sinks.pointed(spark, root) == "run-a"
    assert spark.read.parquet(f"{root}/run-b").first().partial


def test_feedback_is_added(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 5), "up")], "ts timestamp, vote string")
    for _ in range(2):
        sinks.append_log(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2


def test_empty_and_null_inputs(spark):
    q = spark.createDataFrame([(1, None), (2, "")], "q int, t string")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    told = q.select(
        D.forbidden_request(F.col("t"), F.array(F.lit("run"))).alias("f"), D.request_faults(F.col("t"), F.lit("s"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("r"),
        D.needs_rewrite(F.col("t"), F.lit(0), none, ("plan",)).alias("w"), D.retry_after(F.col("t")).alias("s"),
    ).collect()
    assert all(r.f is None and r.r == ["question"] and not r.w and r.s is None for r in told)
    table = spark.createDataFrame([(0, "knee", "run", "forbidden", "it hurts")], "pos int, injury string, action string, relation string, reason string")
    asked = spark.createDataFrame([(1, "knee", "run"), (2, None, "run"), (3, "knee", None)], "q int, injury string, action string")
    assert {(r.q, r.verdict) for r in B.check_action(asked, table, "q").collect()} == {(1, "exact"), (2, "unknown"), (3, "other")}
    assert B.check_action(asked, table.limit(0), "q").filter("verdict = 'unknown'").count() == 3


def test_bm25_pads_with_the_least_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "a"), (5, "")], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "item_id int, text string")
    got = {}
    for r in R.bm25(queries, docs, "item_id", "doc_id", 3).orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append(r.doc_id)
    assert got == {1: [4, 1, 2], 2: [1, 2, 3], 3: [1, 2, 3]}


def test_null_keys_and_inputs_in_replays(spark):
    rows = spark.createDataFrame([("k", n, v) for n, v in enumerate([None, 5, None, 2**60 + 1, 5, 2**60 + 1])] + [(None, 9, 5)], "key string, n int, v bigint")
    out = K.replay(rows, "key", ["n"], ["v"], K.cache_step, "hit boolean, size int, gone int").orderBy("n").collect()
    assert [r.hit for r in out] == [False, False, True, False, True, True] and out[-1]["size"] == 3
    windows = K.replay(rows, "key", ["n"], ["v"], K.window_step, "start bigint").orderBy("n").collect()
    assert [r.start for r in windows][:3] == [None, 5, None] and windows[3].start == 2**60 + 1
    assert [K.noise_by_tag(None, row)[1] for row in ((None, "ab"), ("None", "ab"))] == [{"": ["ab"]}, {"=None": ["ab"]}]
    calls = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, n), n) for k in (1, None) for n in range(12)], "k bigint, t timestamp, id int")
    limited = K_gateway.rate_limit(calls, "k", "t", "id").collect()
    assert len(limited) == 12 and sum(r.allowed for r in limited) == 10


def test_ranking_of_no_candidates(spark):
    rows = spark.createDataFrame([("3, 1", 0), ("3, 1", 3), (None, 2)], "a string, n int")
    assert [r[0] for r in rows.select(R.parse_ranking(F.col("a"), F.col("n"))).collect()][:2] == [[], [3, 1, 2]]
