"""Live runs on Structured Streaming.

Stateless operators, tumbling windows and sinks map to streaming DataFrames.
Operators with a state for each key run their steps through
``applyInPandasWithState``; late rows are rejected or dropped, as asked.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.errors import StreamError
from tidewheel.functions.times import duration


Emitted = list[tuple[int, int, Any]]


def stateful_many(frame: DataFrame, keys: list[str], start: Callable[[], Any], step: Callable[[Any, int, int, Any], tuple[Any, Emitted]], kind: str, late: str = "fail", flush: Callable[[Any], tuple[Any, Emitted]] | None = None, idle_ms: int | None = None) -> DataFrame:
    """An operator over a streaming frame (keys..., t, sub, v) whose steps emit any number of (t, sub, value); the state is kept between batches.

    A row behind the last one of its key fails the query, or is dropped with
    ``late="drop"``; with ``late="inputs"`` several inputs share the rows, sub
    tells them apart by its remainder, and each is in order for itself, which
    the step sees to. Where ``idle_ms`` is given, a key without rows for that
    long has ``flush`` called; rows from before what that emits are late then.
    """
    schema = T.StructType([*[frame.schema[k] for k in keys], T.StructField("t", T.LongType()), T.StructField("sub", T.IntegerType()), T.StructField("v", T._parse_datatype_string(kind))])
    kept = T.StructType([T.StructField("at", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("state", T.BinaryType())])
    timed = flush is not None and idle_ms is not None

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last, held = state.get if state.exists else (None, None, None)
        value = start() if held is None else pickle.loads(held)
        out = []
        if state.hasTimedOut:
            value, emitted = flush(value)
            out += [(*key, *e) for e in emitted]
            if emitted:
                gone = (emitted[-1][0], -1)
                at, last = gone if at is None else max((at, last), gone)
        else:
            rows = pd.concat(batches).sort_values(["t", "sub"])
            for t, sub, v in rows[["t", "sub", "v"]].itertuples(index=False, name=None):
                if late != "inputs" and at is not None and (t, sub) <= (at, last):
                    if late == "fail":
                        raise StreamError("live", f"a row at {t} is behind the stream at {at}")
                    continue
                at, last = t, sub
                value, emitted = step(value, t, sub, v)
                out += [(*key, *e) for e in emitted]
            if timed:
                state.setTimeoutDuration(idle_ms)
        state.update((at, last, pickle.dumps(value)))
        yield pd.DataFrame(out, columns=schema.names)

    return frame.groupBy(*keys).applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout)


def stateful(frame: DataFrame, keys: list[str], start: Callable[[], Any], step: Callable[[Any, int, int, Any], tuple[Any, bool, Any]], kind: str, late: str = "fail") -> DataFrame:
    """A custom operator that emits at most one value at each step, at the step's time."""

    def many(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        state, emit, result = step(state, t, sub, v)
        return state, [(t, sub, result)] if emit else []

    return stateful_many(frame, keys, start, many, kind, late)


def throttle(frame: DataFrame, keys: list[str], interval: int, late: str = "fail") -> DataFrame:
    kind = frame.schema["v"].dataType.simpleString()
    return stateful(frame, keys, lambda: None, lambda s, t, sub, v: (t, True, v) if s is None or t >= s + interval else (s, False, None), kind, late)


def count(frame: DataFrame, keys: list[str], late: str = "fail") -> DataFrame:
    return stateful(frame, keys, lambda: 0, lambda s, t, sub, v: (s + 1, True, s + 1), "bigint", late)


def debounce(frame: DataFrame, keys: list[str], quiet: int, late: str = "fail", idle_ms: int | None = None) -> DataFrame:
    """A value goes out once a newer row shows that it was quiet after it, or after ``idle_ms`` without rows."""
    q = duration(quiet)

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        return (t, v), [(state[0] + q, 0, state[1])] if state is not None and t - state[0] > q else []

    def flush(state: Any) -> tuple[Any, Emitted]:
        return None, [] if state is None else [(state[0] + q, 0, state[1])]

    return stateful_many(frame, keys, lambda: None, step, frame.schema["v"].dataType.simpleString(), late, flush, idle_ms)


def window_tumbling(frame: DataFrame, keys: list[str], size: int, start: int = 0, late: str = "fail", idle_ms: int | None = None) -> DataFrame:
    """Values of [start + k size, start + (k + 1) size) at the window's end; a window goes out with the key's first row past it."""
    d = duration(size)

    def flush(state: Any) -> tuple[Any, Emitted]:
        return None, [] if state is None else [(state[0], 0, state[1])]

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        out: Emitted = []
        if state is not None and t >= state[0]:
            state, out = flush(state)
        end = start + ((t - start) // d + 1) * d
        return (end, [v] if state is None else [*state[1], v]), out

    return stateful_many(frame, keys, lambda: None, step, f"array<{frame.schema['v'].dataType.simpleString()}>", late, flush, idle_ms)


def window_sliding(frame: DataFrame, keys: list[str], size: int, slide: int, start: int = 0, late: str = "fail", idle_ms: int | None = None) -> DataFrame:
    """At each boundary B = start + k slide the values after B - size up to B, of those at B the first.

    A boundary passes with the key's first row at or past it. The state holds
    the values of one window. With ``idle_ms`` all boundaries that still hold
    a value pass.
    """
    d, s = duration(size), duration(slide)

    def fire(held: list, due: int, out: Emitted) -> tuple[list, int | None]:
        inside = [v for t, v in held if t > due - d]
        if inside:
            out.append((due, 0, inside))
        held = [(t, v) for t, v in held if t > due + s - d]
        return held, due + s if held and s < d else None

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        held, due = state
        out: Emitted = []
        while due is not None and (due < t or (due == t and sub > 0)):
            held, due = fire(held, due, out)
        held = [*held, (t, v)]
        if due == t:
            held, due = fire(held, due, out)
        elif due is None:
            due = start + ((t - start) // s + 1) * s
        return (held, due), out

    def flush(state: Any) -> tuple[Any, Emitted]:
        held, due = state
        out: Emitted = []
        while due is not None:
            held, due = fire(held, due, out)
        return ([], None), out

    return stateful_many(frame, keys, lambda: ([], None), step, f"array<{frame.schema['v'].dataType.simpleString()}>", late, flush, idle_ms)


def sink(frame: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls f with each batch of rows; errors of f end the query."""
    writer = frame.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
