"""State that ends by itself: rate limits whose keys are swept by event-time timers as they fall idle.

A key's state is kept until its last counted request leaves the window and its cooldown is over, whichever is later; then a timer
ends it, also if the key never comes again. Ended state has no effect on a decision, so that the stream's decisions are those of a
replay, and what it holds is bounded by the keys of the last window instead of all keys ever seen. A sweep is a row of its own.

Defined cases: rows without key or time are left out; rows that come later than the watermark are dropped by the stream; rows of one
time go by `tie`; a key that comes back after its end is swept first and begins anew."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corvane.streaming.gateway import COOLDOWN_S, LIMIT, WINDOW_S, limit_step

#: Timers and several states for a key need this store.
CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def ends(stamps: list[float], blocked: float, window: float) -> int:
    """The millisecond at which a state may go."""
    return math.ceil(max(max(stamps, default=0.0) + window, blocked) * 1000)


class _Limits(StatefulProcessor):
    def __init__(self, key: str, tie: str, limit: int, window: float, cooldown: float):
        self.names, self.bounds, self.window = (key, tie), (limit, window, cooldown), window

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("limits", "stamps array<double>, blocked double")

    def _rows(self, key, told: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(told, columns=[self.names[1], "allowed", "swept_ms"], dtype=object)
        rows.insert(0, self.names[0], key[0])
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        stamps, blocked = (list(held[0]), held[1]) if held else ([], 0.0)
        before = ends(stamps, blocked, self.window) if held else None
        known, told = bool(held), []
        part = pd.concat(list(rows)).sort_values(["event_s", "event_tie"])
        for tie, s in zip(part["event_tie"], part["event_s"], strict=True):
            if known and s * 1000 > (end := ends(stamps, blocked, self.window)):
                told.append((None, None, end))
                stamps, blocked = [], 0.0
            allowed, stamps, blocked = limit_step(stamps, blocked, s, *self.bounds)
            told.append((tie, allowed, None))
            known = True
        self.state.update((stamps, blocked))
        end = ends(stamps, blocked, self.window)
        if end != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(end)
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stamps, blocked = self.state.get()
        end = ends(list(stamps), blocked, self.window)
        self.state.clear()
        yield self._rows(key, [(None, None, end)])

    def close(self) -> None:
        pass


def _shape(requests: DataFrame, key: str, tie: str) -> str:
    types = dict(requests.dtypes)
    return f"`{key}` {types[key]}, `{tie}` {types[tie]}, allowed boolean, swept_ms bigint"


def limits_stream(requests: DataFrame, key: str, ts: str, tie: str, late: str = "10 minutes", limit: int = LIMIT, window: float = WINDOW_S, cooldown: float = COOLDOWN_S) -> DataFrame:
    """key, tie and allowed for each request; and key with swept_ms, alone, where a state ends. Runs with CONF."""
    rows = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("event_key"), F.col(tie).alias("event_tie"), F.col(ts).cast("timestamp").alias("event_t"))
    # Frames of this operator lose names that begin with an underscore.
    rows = rows.withColumn("event_s", F.col("event_t").cast("double")).withWatermark("event_t", late)
    return rows.groupBy("event_key").transformWithStateInPandas(_Limits(key, tie, limit, window, cooldown), _shape(requests, key, tie), "Append", "EventTime")


def limits_replay(requests: DataFrame, key: str, ts: str, tie: str, late: float = 600.0, limit: int = LIMIT, window: float = WINDOW_S, cooldown: float = COOLDOWN_S) -> DataFrame:
    """The same of a batch, whose watermark at the end is its greatest time less `late` seconds."""
    rows = requests.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, tie, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    mark = rows.agg(F.max(F.floor(F.col("_s") * 1000)).alias("_mark"))  # one row

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, mark = None, None, 0

        def last() -> list[tuple]:
            return [(now, None, None, end)] if state is not None and (end := ends(*state, window)) <= mark else []

        for batch in batches:
            told = []
            for k, tie_, s, top in zip(batch[key], batch[tie], batch["_s"], batch["_mark"], strict=True):
                if state is None or k != now:
                    told += last()
                    now, state, mark = k, None, top - round(late * 1000)
                if state is not None and s * 1000 > (end := ends(*state, window)):
                    told.append((k, None, None, end))
                    state = None
                allowed, *state = limit_step(*(state or ([], 0.0)), s, limit, window, cooldown)
                told.append((k, tie_, allowed, None))
            yield pd.DataFrame(told, columns=[key, tie, "allowed", "swept_ms"], dtype=object)
        if state is not None:
            yield pd.DataFrame(last(), columns=[key, tie, "allowed", "swept_ms"], dtype=object)

    # Sorted last: a sort below a join is left out by the optimizer.
    return rows.crossJoin(F.broadcast(mark)).repartition(key).sortWithinPartitions(key, "_s", tie).mapInPandas(replay, _shape(requests, key, tie))
