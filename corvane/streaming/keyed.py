"""Keyed state machines: one step function replays a batch in order or runs as a stateful stream, with the same results.

A step takes (state, row) and returns (outputs, state). States are small and JSON, rows are tuples of the named columns, in which a
null is None and a number keeps its digits whatever else the batch holds. Rows without a key are left out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.streaming.gateway import hysteresis_step, noise_step

Step = Callable[[Any, tuple], tuple[tuple, Any]]

#: A cost window's seconds, a cache's entries and how many go at once, a breaker's failures and seconds.
WINDOW_S = 86_400
CACHE_MOST, CACHE_EVICTED = 200, 40
#: Sessions a bucket keeps, and messages a session keeps. All sessions together are bounded by buckets times the first.
SESSIONS, MESSAGES = 64, 40
FAILURES, OPEN_S = 3, 30.0


def _schema(rows: DataFrame, keep: list[str], outputs: str) -> str:
    types = dict(rows.dtypes)
    return ", ".join([*(f"`{c}` {types[c]}" for c in keep), outputs])


def _told(rows: DataFrame, key: str, keep: list[str], inputs: list[str]) -> DataFrame:
    """The columns of rows that a step needs. Inputs of whole numbers travel as text beside themselves, as pandas makes floats of them where one is null."""
    whole = [c for c in inputs if dict(rows.dtypes)[c] in ("bigint", "int", "smallint", "tinyint")]
    return rows.filter(F.col(key).isNotNull()).select(*keep, *[F.col(c).cast("string").alias(f"_whole_{c}") for c in whole], *[F.col(c).alias(f"_input_{c}") for c in inputs if c not in whole])


def _inputs(batch: pd.DataFrame, c: str) -> list:
    """An input's values as the step gets them."""
    if (name := f"_whole_{c}") in batch.columns:
        return [None if pd.isna(v) else int(v) for v in batch[name]]
    return [None if pd.api.types.is_scalar(v) and pd.isna(v) else v for v in batch[f"_input_{c}"]]


def replay(rows: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, outputs: str) -> DataFrame:
    """key, order and the step's outputs for each row, each key's rows in order. A key streams through one sorted partition: only its state is held."""
    names = [o.split()[0] for o in outputs.split(",")]
    keep = [key, *order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, None, True
        for batch in batches:
            told = []
            for k, *row in zip(batch[key], *(_inputs(batch, c) for c in inputs), strict=True):
                if first or k != now:
                    now, state, first = k, None, False
                out, state = step(state, tuple(row))
                told.append(out)
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(told, columns=names, dtype=object)], axis=1)

    return _told(rows, key, keep, inputs).repartition(key).sortWithinPartitions(*keep).mapInPandas(run, _schema(rows, keep, outputs))


def stream(rows: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, outputs: str) -> DataFrame:
    """replay() over a stream: the state of a key outlives batches, rows of a batch go in order."""
    names = [o.split()[0] for o in outputs.split(",")]
    keep = [key, *order]

    def run(name: tuple, batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else None
        part = pd.concat(list(batches)).sort_values(order).reset_index(drop=True)
        told = []
        for row in zip(*(_inputs(part, c) for c in inputs), strict=True):
            out, state = step(state, tuple(row))
            told.append(out)
        held.update((json.dumps(state),))
        yield pd.concat([part[keep], pd.DataFrame(told, columns=names, dtype=object)], axis=1)

    return _told(rows, key, keep, inputs).groupBy(key).applyInPandasWithState(run, _schema(rows, keep, outputs), "state string", "append", GroupStateTimeout.NoTimeout)


def window_step(state: list | None, row: tuple, seconds: int = WINDOW_S) -> tuple[tuple, list]:
    """row: (micros,). The window's start: the first use, and again the first use after it has run out; no start, and no use, without a time."""
    if row[0] is None:
        return (None,), state
    at = int(row[0])
    start = at if state is None or at - state[0] >= seconds * 1_000_000 else state[0]
    return (start,), [start]


def cache_step(state: list | None, row: tuple, most: int = CACHE_MOST, evicted: int = CACHE_EVICTED) -> tuple[tuple, list]:
    """row: (name,). Whether the name was cached, how many are after it is set, and how many went: over most, the oldest go; setting again keeps the place."""
    held, name = list(state or []), row[0]
    hit = name in held
    if not hit:
        held.append(name)
    gone = min(evicted, len(held)) if len(held) > most else 0
    return (hit, len(held) - gone, gone), held[gone:]


def breaker_step(state: list | None, row: tuple, failures: int = FAILURES, seconds: float = OPEN_S) -> tuple[tuple, list]:
    """row: (seconds, ok). Whether the call is let through and the state after it: closed, open after failures in a row, half_open once as the wait is over."""
    name, failed, since = state or ["closed", 0, 0.0]
    at, ok = float(row[0]), bool(row[1])
    if name == "open" and at - since < seconds:
        return (False, "open"), [name, failed, since]
    probe = name == "open"
    if ok:
        return (True, "closed"), ["closed", 0, 0.0]
    failed += 1
    if probe or failed >= failures:
        return (True, "open"), ["open", failed, at]
    return (True, "closed"), ["closed", failed, since]


def noise_by_tag(state: dict | None, row: tuple) -> tuple[tuple, dict]:
    """row: (tag, text). Near-duplicates among the last accepted texts of the same tag."""
    held, tag = dict(state or {}), "" if row[0] is None else f"={row[0]}"  # a null tag is one of its own
    repeated, kept = noise_step(held.get(tag, []), row[1] or "")
    held[tag] = kept
    return (repeated,), held


def session_step(state: list | None, row: tuple, most: int = SESSIONS, messages: int = MESSAGES) -> tuple[tuple, list]:
    """row: (session, text or null), of a bucket of sessions. A text is appended, without one the session is only read; both touch it.
    Outputs: the messages it holds and the sessions that went, those touched longest ago first. A session that is only read and isn't there stays away; a null session is no session."""
    held, (name, text) = [list(s) for s in state or []], row
    if name is None:
        return (None, []), held
    at = next((k for k, s in enumerate(held) if s[0] == name), None)
    kept = held.pop(at)[1] if at is not None else []
    if at is None and text is None:
        return (0, []), held
    held.append([name, [*kept, *([text] if text is not None else [])][-messages:]])
    gone = [str(s[0]) for s in held[: max(0, len(held) - most)]]
    return (len(held[-1][1]), gone), held[len(gone) :]


def memory_step(state: dict | None, row: tuple, down: float = 3.0, up: float = 4.0) -> tuple[tuple, dict]:
    """Degraded from a value below down on until one of up or more; changed tells both moments. A null value changes nothing."""
    low = bool(state and state["low"])
    value = row[0]
    now = low if value is None else hysteresis_step(low, value, down, up)
    return (now, now != low), {"low": now}
