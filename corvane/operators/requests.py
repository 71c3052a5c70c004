"""Where the time of requests goes: logs joined with requests by id, or by time where they have none, and medians over repeated runs.

A request belongs to a run of a level (of concurrency, say); a level is run several times, a stated, small number. Defined cases: times that are null or
no request's count for nothing; a request without logs has sums of 0; a run in which any request failed is counted, but isn't in the medians; empty
tables give no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.evaluate import percentiles

#: Kinds of log rows, and ids under which work for no request is logged.
USAGE, WAIT = "llm_usage", "lock_phase"
NO_REQUEST = ("background", "<unknown>")
#: Seconds of a slice by which runs and logs meet.
SLICE_S = 3600


def attribute(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """requests (request_id, level, run, started and ended in microseconds, tokens, error) with total_ms, llm_ms, wait_ms and other_ms, what of the total no
    model took.

    logs: event, request_id, ms, at in microseconds. Only rows between a request's start and end are its own, so that an id that comes again in another run
    is told apart. Logs are summed by id and request after the join on the id, so that a busy id is split by the engine like any skewed key."""
    r = requests.select("request_id", "level", "run", "started", "ended")
    own = logs.filter(F.col("event").isin(USAGE, WAIT) & F.col("ms").isNotNull()).select("request_id", "event", "ms", "at")
    hit = own.join(r, "request_id").filter(F.col("at").between(F.col("started"), F.col("ended")))
    of = lambda kind: F.sum(F.when(F.col("event") == kind, F.col("ms")).otherwise(0.0))
    keys = ["request_id", "level", "run"]
    sums = hit.groupBy(*keys).agg(of(USAGE).alias("llm_ms"), of(WAIT).alias("wait_ms"))
    out = requests.join(sums, keys, "left").fillna(0.0, ["llm_ms", "wait_ms"]).withColumn("total_ms", (F.col("ended") - F.col("started")) / 1000)
    return out.withColumn("other_ms", F.greatest(F.lit(0.0), F.col("total_ms") - F.col("llm_ms")))


def runs(requests: DataFrame) -> DataFrame:
    """level, run, first and last (microseconds), wall_s, requests, errors and tokens of each run."""
    told = requests.groupBy("level", "run").agg(
        F.min("started").alias("first"), F.max("ended").alias("last"), F.count(F.lit(1)).alias("requests"),
        F.sum(F.coalesce(F.col("error"), F.lit(False)).cast("bigint")).alias("errors"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"),
    )
    return told.withColumn("wall_s", (F.col("last") - F.col("first")) / 1e6)


def background(logs: DataFrame, of_runs: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """level, run and background_ms: the model's time under no request's id while a run went on; one that falls into several runs counts in each.

    Runs are laid out over slices of time and meet the logs of the same slice: an equi-join, whose pairs are those of a slice alone."""
    width = seconds * 1_000_000
    slot = lambda c: F.floor(F.col(c) / width).cast("bigint")
    laid = of_runs.filter("first IS NOT NULL AND last IS NOT NULL").select("level", "run", "first", "last", F.explode(F.sequence(slot("first"), slot("last"))).alias("_slot"))
    loose = logs.filter((F.col("event") == USAGE) & (F.col("request_id").isNull() | F.col("request_id").isin(*NO_REQUEST)))
    # Pre-summed by moment, so that a burst at one moment is one row.
    loose = loose.groupBy("at").agg(F.sum("ms").alias("ms")).withColumn("_slot", slot("at"))
    return loose.join(laid, "_slot").filter(F.col("at").between(F.col("first"), F.col("last"))).groupBy("level", "run").agg(F.sum("ms").alias("background_ms"))


def summary(requests: DataFrame, logs: DataFrame, seconds: int = SLICE_S) -> DataFrame:
    """A row for each level: runs, failed (runs with errors), and medians over its other runs of wall_s, tokens_s, background_ms and the nearest-rank p50
    and p95 within the run of total_ms, llm_ms, wait_ms and other_ms."""
    attributed, of_runs = attribute(requests, logs), runs(requests)
    fine = of_runs.filter("errors = 0")
    measures = ("total_ms", "llm_ms", "wait_ms", "other_ms")
    tall = attributed.join(fine.select("level", "run"), ["level", "run"], "left_semi").select(
        F.explode(F.array(*[F.struct(F.to_json(F.struct("level", "run", F.lit(m).alias("measure"))).alias("g"), F.col(m).alias("v")) for m in measures])).alias("x")
    )
    types = dict(requests.dtypes)
    told = percentiles(tall.select("x.g", "x.v"), "g", "v", (0.5, 0.95)).withColumn("_k", F.from_json("g", f"level {types['level']}, run {types['run']}, measure string"))
    wide = told.groupBy(F.col("_k.level").alias("level"), F.col("_k.run").alias("run")).agg(
        *[F.max(F.when(F.col("_k.measure") == m, F.col(p))).alias(f"{m}_{p}") for m in measures for p in ("p50", "p95")]
    )
    each = fine.join(wide, ["level", "run"]).join(background(logs, fine, seconds), ["level", "run"], "left").fillna(0.0, ["background_ms"])
    each = each.withColumn("tokens_s", F.col("tokens") / F.when(F.col("wall_s") > 0, F.col("wall_s")))
    names = ["wall_s", "tokens_s", "background_ms", *[f"{m}_{p}" for m in measures for p in ("p50", "p95")]]
    medians = each.groupBy("level").agg(*[F.median(n).alias(n) for n in names])
    counted = of_runs.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum((F.col("errors") > 0).cast("bigint")).alias("failed"))
    return counted.join(medians, "level", "left")
