"""The operators of a graph on streaming frames: for each batch function the one that a live run uses instead.

Operators with one input keep a state for each key and answer at once, but
for those whose value needs a newer row (delay, debounce, buffers' remainders,
time windows). Operators with several inputs hold rows back until every input
has a row past them, so their answers do not depend on how rows fall into
micro-batches; after ``idle_ms`` without rows all that is held goes out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.times import duration
from tidewheel.operators import combine, folds, timed, windows
from tidewheel.streaming import live

Emitted = list[tuple[int, int, Any]]


def _kind(frame: DataFrame) -> str:
    return frame.schema["v"].dataType.simpleString()


def _stated(frame: DataFrame, keys: Sequence[str], start: Callable[[], Any], step: Callable, kind: str, flush: Callable | None = None, idle_ms: int | None = None) -> DataFrame:
    """``live.stateful_many``; a graph without keys is one key."""
    if keys:
        return live.stateful_many(frame, list(keys), start, step, kind, "fail", flush, idle_ms)
    return live.stateful_many(frame.withColumn("__one", F.lit(0)), ["__one"], start, step, kind, "fail", flush, idle_ms).drop("__one")


def _fold(frame: DataFrame, keys: Sequence[str], after: Callable[[Any, int, Any], tuple[Any, bool, Any]], kind: str) -> DataFrame:
    """after(state, t, v), the state None before the first value, gives (state, emit, value)."""

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        state, emit, value = after(state, t, v)
        return state, [(t, sub, value)] if emit else []

    return _stated(frame, keys, lambda: None, step, kind)


def _running(frame: DataFrame, keys: Sequence[str], two: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    def after(s: Any, t: int, v: Any) -> tuple[Any, bool, Any]:
        x = v if s is None else two(s[0], v)
        return (x,), True, x

    return _fold(frame, keys, after, kind)


def count(frame: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return _fold(frame, keys, lambda s, t, v: ((s or 0) + 1, True, (s or 0) + 1), "bigint")


def sum_(frame: DataFrame, keys: Sequence[str], on_overflow: str, idle_ms: int | None) -> DataFrame:
    kind = _kind(frame)
    wide = kind in ("tinyint", "smallint", "int", "bigint")

    def two(a: Any, b: Any) -> Any:
        x = a + b
        if wide and on_overflow == "wrap":
            return (int(x) + 2**63) % 2**64 - 2**63
        return x

    return _running(frame, keys, two, "bigint" if wide else "double" if kind == "float" else kind)


def mean(frame: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    def after(s: Any, t: int, v: Any) -> tuple[Any, bool, Any]:
        total, n = s or (0.0, 0)
        return (total + float(v), n + 1), True, (total + float(v)) / (n + 1)

    return _fold(frame, keys, after, "double")


def extreme(frame: DataFrame, keys: Sequence[str], which: str, idle_ms: int | None) -> DataFrame:
    return _running(frame, keys, max if which == "max" else min, _kind(frame))


def delta(frame: DataFrame, keys: Sequence[str], on_overflow: str, idle_ms: int | None) -> DataFrame:
    def after(s: Any, t: int, v: Any) -> tuple[Any, bool, Any]:
        x = None if s is None else v - s[0]
        return (v,), s is not None, (int(x) + 2**63) % 2**64 - 2**63 if x is not None and on_overflow == "wrap" else x

    return _fold(frame, keys, after, _kind(frame))


def distinct(frame: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return _fold(frame, keys, lambda s, t, v: ((v,), s is None or s[0] != v, v), _kind(frame))


def take(frame: DataFrame, keys: Sequence[str], n: int, idle_ms: int | None) -> DataFrame:
    return _fold(frame, keys, lambda s, t, v: ((s or 0) + 1, (s or 0) < n, v), _kind(frame))


def accumulate(frame: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return _fold(frame, keys, lambda s, t, v: ([*(s or []), v], True, [*(s or []), v]), f"array<{_kind(frame)}>")


def scan(frame: DataFrame, keys: Sequence[str], init: Any, f: Callable[[Any, Any], Any], kind: str, idle_ms: int | None) -> DataFrame:
    def after(s: Any, t: int, v: Any) -> tuple[Any, bool, Any]:
        x = f(init if s is None else s[0], v)
        return (x,), True, x

    return _fold(frame, keys, after, kind)


def reduce(frame: DataFrame, keys: Sequence[str], f: Callable[[Any, Any], Any], kind: str | None, idle_ms: int | None) -> DataFrame:
    return _running(frame, keys, f, kind or _kind(frame))


def stepped(frame: DataFrame, keys: Sequence[str], start: Callable[[], Any], step: Callable, kind: str, idle_ms: int | None) -> DataFrame:
    def one(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        state, emit, value = step(state, t, sub, v)
        return state, [(t, sub, value)] if emit else []

    return _stated(frame, keys, start, one, kind)


def delay(frame: DataFrame, keys: Sequence[str], by: int, idle_ms: int | None) -> DataFrame:
    """The last value of an instant goes out once a newer instant shows that it was the last."""
    d = duration(by, 0)
    if d == 0:
        return frame

    def flush(state: Any) -> tuple[Any, Emitted]:
        return None, [] if state is None else [(state[0] + d, 0, state[1])]

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        return (t, v), flush(state)[1] if state is not None and t > state[0] else []

    return _stated(frame, keys, lambda: None, step, _kind(frame), flush, idle_ms)


def throttle(frame: DataFrame, keys: Sequence[str], interval: int, idle_ms: int | None) -> DataFrame:
    return _fold(frame, keys, lambda s, t, v: (t, True, v) if s is None or t >= s + interval else (s, False, None), _kind(frame))


def _by_key(f: Callable) -> Callable:
    """Live operators that take key columns, for graphs without keys too."""

    def form(frame: DataFrame, keys: Sequence[str], *args: Any, idle_ms: int | None) -> DataFrame:
        if keys:
            return f(frame, list(keys), *args, idle_ms=idle_ms)
        return f(frame.withColumn("__one", F.lit(0)), ["__one"], *args, idle_ms=idle_ms).drop("__one")

    return form


def buffer(frame: DataFrame, keys: Sequence[str], n: int, ended: Any, idle_ms: int | None) -> DataFrame:
    """Every n-th value emits the last n; a remainder goes out when nothing comes for idle_ms, at its last value's step."""

    def flush(state: Any) -> tuple[Any, Emitted]:
        held, at = state
        return ([], None), [(*at, held)] if held else []

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        held = [*state[0], v]
        return (([], None), [(t, sub, held)]) if len(held) == n else ((held, (t, sub)), [])

    return _stated(frame, keys, lambda: ([], None), step, f"array<{_kind(frame)}>", flush, idle_ms)


def align(frames: Sequence[DataFrame], keys: Sequence[str], choose: Callable[[list[bool], list], Any], kind: str, idle_ms: int | None) -> DataFrame:
    """choose(fired, latest) gives a value in a list of one, or None, for each step; latest holds each input's value in a list of one, or None.

    A step is settled when every input has a row at a later time.
    """
    n = len(frames)
    tagged = None
    for i, f in enumerate(frames):
        cells = [F.struct(F.col("v").alias("x")).alias(f"p{k}") if k == i else F.lit(None).cast(f"struct<x:{_kind(other)}>").alias(f"p{k}") for k, other in enumerate(frames)]
        part = f.select(*keys, "t", (F.col("sub") * n + i).cast("int").alias("sub"), F.struct(*cells).alias("v"))
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = tagged if keys else tagged.withColumn("__one", F.lit(0))

    def settle(state: Any, before: int | None) -> Emitted:
        held, latest, _ = state
        out: Emitted = []
        ready = sorted(k for k in held if before is None or k[0] < before)
        for at in ready:
            values = held.pop(at)
            for i, x in values.items():
                latest[i] = [x]
            got = choose([i in values for i in range(n)], latest)
            if got is not None:
                out.append((*at, got[0]))
        return out

    def step(state: Any, t: int, sub: int, v: Any) -> tuple[Any, Emitted]:
        held, _, clocks = state
        i = sub % n
        held.setdefault((t, sub // n), {})[i] = v[f"p{i}"]["x"]
        clocks[i] = t
        return state, settle(state, min(clocks)) if None not in clocks else []

    def flush(state: Any) -> tuple[Any, Emitted]:
        return state, settle(state, None)

    own = list(keys) or ["__one"]
    out = live.stateful_many(tagged, own, lambda: ({}, [None] * n, [None] * n), step, kind, "inputs", flush, idle_ms)
    return out if keys else out.drop("__one")


def _both(when: Callable[[list[bool], list], bool]) -> Callable:
    """with_ and with_latest: both latest values go on as a struct, to which the graph's expression is applied."""

    def form(a: DataFrame, b: DataFrame, keys: Sequence[str], f: combine.Two, idle_ms: int | None) -> DataFrame:
        pair = align([a, b], keys, lambda fired, now: [{"a": now[0][0], "b": now[1][0]}] if when(fired, now) else None, f"struct<a:{_kind(a)},b:{_kind(b)}>", idle_ms)
        return pair.withColumn("v", f(F.col("v.a"), F.col("v.b")))

    return form


def gate(a: DataFrame, open_: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    if _kind(open_) != "boolean":
        raise TypeError("gate must be bool")
    return align([a, open_], keys, lambda fired, now: now[0] if fired[0] and now[1] and now[1][0] else None, _kind(a), idle_ms)


def sample(a: DataFrame, trigger: DataFrame, keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return align([a, trigger], keys, lambda fired, now: now[0] if fired[1] else None, _kind(a), idle_ms)


def merge(frames: Sequence[DataFrame], keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return align(frames, keys, lambda fired, now: now[fired.index(True)], _kind(frames[0]), idle_ms)


def gather(frames: Sequence[DataFrame], keys: Sequence[str], idle_ms: int | None) -> DataFrame:
    return align(frames, keys, lambda fired, now: [[x[0] for x in now]] if None not in now else None, f"array<{_kind(frames[0])}>", idle_ms)


#: What a live run uses in place of a batch function. Stateless functions serve both.
FORMS: dict[Callable, Callable] = {
    folds.count: count, folds.sum_: sum_, folds.mean: mean, folds.extreme: extreme, folds.delta: delta, folds.distinct: distinct, folds.take: take, folds.accumulate: accumulate,
    folds.scan: scan, folds.reduce: reduce, folds.stepped: stepped, timed.delay: delay, timed.throttle: throttle, timed.debounce: _by_key(live.debounce),
    windows.tumbling: _by_key(live.window_tumbling), windows.sliding: _by_key(live.window_sliding), windows.buffer: buffer,
    combine.with_: _both(lambda fired, now: None not in now), combine.with_latest: _both(lambda fired, now: fired[0] and now[1] is not None),
    combine.gate: gate, combine.sample: sample, combine.merge: merge, combine.gather: gather,
}

