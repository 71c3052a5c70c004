"""State of a gateway, as batch replays in event order: rate limits (also as a stateful stream), near-duplicates, cost windows; and sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from corvane.functions.decide import message_role
from corvane.session import shared_folder

#: Requests a window, its seconds, the cooldown's; near-duplicates' history and similarity.
LIMIT, WINDOW_S, COOLDOWN_S = 10, 60.0, 30.0
HISTORY, SIMILAR = 5, 0.85


def limit_step(stamps: list[float], blocked: float, now: float, limit: int = LIMIT, window: float = WINDOW_S, cooldown: float = COOLDOWN_S) -> tuple[bool, list[float], float]:
    """Whether a request at now passes, and the state after it: refused while blocked; refused, and blocked for the cooldown, as the window is full; refusals aren't counted."""
    if now < blocked:
        return False, stamps, blocked
    stamps = [s for s in stamps if s > now - window]
    if len(stamps) >= limit:
        return False, stamps, now + cooldown
    return True, [*stamps, now], blocked


def rate_limit(requests: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """requests (key, ts, tie) with allowed, replayed in order; rows without key or ts are left out. Rows stream through sorted partitions; the state of one key is ten stamps."""
    types = dict(requests.dtypes)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, ([], 0.0)
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch["_s"], strict=True):
                if k != now:
                    now, state = k, ([], 0.0)
                ok, *state = limit_step(*state, t)
                out.append(ok)
            yield batch[[key, tie]].assign(allowed=out)

    rows = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, tie, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    return rows.repartition(key).sortWithinPartitions(key, "_s", tie).mapInPandas(replay, f"{key} {types[key]}, {tie} {types[tie]}, allowed boolean")


def rate_limit_stream(requests: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The same over a stream: state by key, rows of a batch in order of ts."""
    types = dict(requests.dtypes)

    def step(name: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stamps, blocked = state.get if state.exists else ([], 0.0)
        stamps = list(stamps)
        rows = pd.concat(list(batches)).sort_values(["_s", tie])
        out = []
        for t in rows["_s"]:
            ok, stamps, blocked = limit_step(stamps, blocked, t)
            out.append(ok)
        state.update((stamps, blocked))
        yield pd.DataFrame({key: name[0], tie: rows[tie].to_numpy(), "allowed": out})

    rows = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, tie, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, {tie} {types[tie]}, allowed boolean", "stamps array<double>, blocked double", "append", GroupStateTimeout.NoTimeout)


def noise_step(history: list[str], text: str, history_size: int = HISTORY, similar: float = SIMILAR) -> tuple[bool, list[str]]:
    """Whether text repeats one of the last accepted, and the history after it. A text without bigrams passes and, if there is a history, isn't kept."""
    grams = {text[k : k + 2] for k in range(len(text) - 1)}
    if not grams and history:
        return False, history
    for old in history:
        other = {old[k : k + 2] for k in range(len(old) - 1)}
        if grams and other and len(grams & other) / len(grams | other) >= similar:
            return True, history
    return False, [*history, text][-history_size:]


def near_duplicates(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """turns (key, order, text) with duplicate, each against the last accepted ones of its key; rows without one are left out."""
    types = dict(turns.dtypes)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, history = None, []
        for batch in batches:
            out = []
            for k, t in zip(batch[key], batch[text], strict=True):
                if k != now:
                    now, history = k, []
                repeated, history = noise_step(history, t or "")
                out.append(repeated)
            yield batch[[key, order]].assign(duplicate=out)

    return turns.filter(F.col(key).isNotNull()).select(key, order, text).repartition(key).sortWithinPartitions(key, order).mapInPandas(replay, f"{key} {types[key]}, {order} {types[order]}, duplicate boolean")


def cost_windows(usage: DataFrame, key: str, ts: str, prompt: str, completion: str, total: str, soft: float, hard: float, seconds: int = 86_400) -> DataFrame:
    """Ledger by fixed windows from a key's first use: requests, tokens (the larger of the total and its parts) and state; a limit of 0 doesn't hold."""
    s = F.unix_micros(F.col(ts).cast("timestamp"))
    first = usage.groupBy(key).agg(F.min(s).alias("_first"))
    n = F.floor((s - F.col("_first")) / F.lit(seconds * 1_000_000)).cast("bigint")
    sums = usage.join(first, key).withColumn("window_no", n).groupBy(key, "window_no").agg(F.count(F.lit(1)).alias("requests"), F.sum(F.greatest(F.col(total), F.col(prompt) + F.col(completion))).alias("tokens"))
    state = F.when(F.lit(hard > 0) & (F.col("tokens") >= hard), "exhausted").when(F.lit(soft > 0) & (F.col("tokens") >= soft), "degraded").otherwise("ok")
    return sums.withColumn("state", state)


def hysteresis_step(low: bool, value: float, down: float = 3.0, up: float = 4.0) -> bool:
    """Low from below down on until up is reached."""
    return value < down or (low and value < up)


def history_trim(turns: DataFrame, key: str, order: str, tokens: str, budget: int = 2048, least: int = 2) -> DataFrame:
    """The newest turns whose tokens fit the budget, but least of them at any rate."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    used = F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumns({"_u": used, "_k": F.row_number().over(newest)}).filter((F.col("_u") <= budget) | (F.col("_k") <= least)).drop("_u", "_k")


def truncate_messages(messages: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """What of an over-long conversation is sent at all: its system messages and the last one of a user; where it has neither, all of it."""
    who = message_role(F.col(role))
    whole = Window.partitionBy(key)
    told = messages.withColumns({role: who, "_last": F.max(F.when(who == "user", F.col(order))).over(whole)})
    told = told.withColumn("_in", F.coalesce((F.col(role) == "system") | ((F.col(role) == "user") & (F.col(order) == F.col("_last"))), F.lit(False)))
    return told.withColumn("_any", F.bool_or("_in").over(whole)).filter(F.col("_in") | ~F.col("_any")).drop("_last", "_in", "_any")


def lru(sessions: DataFrame, last: str, tie: str, keep: int = 64) -> DataFrame:
    """Sessions that stay: the last touched; untouched ones go first."""
    return sessions.orderBy(F.col(last).desc_nulls_last(), F.col(tie)).limit(keep)


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Event-time sessions of a batch or, with a bound on lateness, a stream: start, end and n."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if late else e
    out = e.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def run_once(frame: DataFrame, name: str, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a streaming frame over what is there now and returns its rows as a written table in the shared folder. conf holds for this query alone."""
    spark = frame.sparkSession
    import uuid

    path = f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"
    for folder in (path, f"{path}-state"):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).format("parquet").start(path)
    finally:  # a query that has started keeps its own copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)
