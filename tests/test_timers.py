import numpy as np
from oracle import connect

from corvane.operators import evaluate as E
from corvane.streaming import gateway as W
from corvane.streaming import timers as T

SF = "/root/testdata/sf0.001"
SHAPE = "who string, at double, id long"


def run(spark, tmp_path, loads, **bounds):
    """One file a micro-batch."""
    for n, load in enumerate(loads):
        spark.createDataFrame(load, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").selectExpr("who", "timestamp_seconds(at) AS at", "id")
    out = W.run_once(T.limits_stream(stream, "who", "at", "id", "10 seconds", **bounds), "t", conf=T.CONF)
    batch = spark.createDataFrame([r for load in loads for r in load], SHAPE).selectExpr("who", "timestamp_seconds(at) AS at", "id")
    told = {tuple(r) for r in out.collect()}
    assert told == {tuple(r) for r in T.limits_replay(batch, "who", "at", "id", 10.0, **bounds).collect()}
    return told


def test_idle_keys_go_and_cooldowns_stay(spark, tmp_path):
    # b is blocked at 1002 until 1302, long after its window ends; a is idle from 1000 on and comes back; late comes only once.
    loads = [
        [("a", 1000.0, 1), ("b", 1000.0, 2), ("b", 1001.0, 3), ("b", 1002.0, 4), ("late", 1002.5, 9), (None, 1002.0, 5)],
        [("c", 1200.0, 6), ("b", 1201.0, 7)],
        [("a", 1290.0, 8), ("c", 1291.0, 10)],
    ]
    told = run(spark, tmp_path, loads, limit=2, window=60.0, cooldown=300.0)
    assert {("b", 4, False, None), ("b", 7, False, None), ("a", 8, True, None)} <= told
    assert {r[:1] + r[3:] for r in told if r[3]} == {("a", 1_060_000), ("late", 1_062_500), ("c", 1_260_000)}


def test_stream_of_events_agrees_with_the_replay(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("CAST(user_id AS string) AS who", "unix_micros(CAST(ts AS timestamp)) / 3.6e9 AS at", "event_id AS id").collect()
    loads = [[tuple(r) for r in e[k : k + 400]] for k in range(0, len(e), 400)]
    told = run(spark, tmp_path, loads, limit=3, window=60.0, cooldown=30.0)
    assert sum(r[3] is None for r in told) == len(e) and any(r[3] for r in told)


def test_percentiles_agree_at_every_bound(spark):
    rng = np.random.default_rng(3)
    rows = [("ties", float(v)) for v in rng.choice([1.0, 1.0, 1.0, 2.0, 5.5], 900)] + [("wide", float(v)) for v in np.exp(rng.normal(0, 9, 1500))]
    rows += [("one", 4.0), (None, 1.0), (None, 3.0), ("none", None), ("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in ("ties", "wide", "one", None):
        held = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = (len(held), *(held[min(len(held) - 1, int(len(held) * p))] for p in (0.5, 0.95, 0.99)))
    for within in (1, 7, 10_000):
        got = {r.g: (r.n, r.p50, r.p95, r.p99) for r in E.percentiles(df, "g", "v", within=within).collect()}
        assert got == want
    assert E.percentiles(df.limit(0), "g", "v").count() == 0
