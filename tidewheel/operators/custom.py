"""Operators of one's own: several inputs, timers, a final step, stop and fail.

``make()`` gives, for each key, an object with any of the hooks ``on_start(ctx)``,
``step(ctx)`` and ``on_stop(ctx)``. ``step`` is called at every step at which an
input fires that is wired with ``on``, or a timer is due; inputs wired with
``watch`` only keep their latest value. A key's steps are read in order from a
sorted partition, so memory holds one object and its timers for each task.

Timers must lie after the current step; in ``on_start`` the start itself is
allowed. A step's timers and the inputs of the same instant's first step come
together.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.errors import StreamError
from tidewheel.functions.times import duration
from tidewheel.plans.frames import STEP, align

VALUE, TIMER, STOPPED, FAILED = 0, 1, 2, 3


class Context:
    """What a hook sees of the run."""

    is_live = False

    def __init__(self, inputs: int, start: int) -> None:
        self.started_at = self.now = start
        self.sub, self.is_final = 0, False
        self._begun = False
        self._fired: list[bool] = [False] * inputs
        self._latest: list[tuple | None] = [None] * inputs
        self._timers: list[tuple[int, int, int | None]] = []
        self._set, self._out, self._end = 0, [], None

    @property
    def elapsed(self) -> int:
        return self.now - self.started_at

    def fired(self, i: int) -> bool:
        return self._fired[i]

    def has(self, i: int) -> bool:
        return self._latest[i] is not None

    def value(self, i: int) -> Any:
        """The input's latest value; None where there was none yet."""
        return self._latest[i][0] if self._latest[i] is not None else None

    def emit(self, value: Any) -> None:
        """The step's value; of several the last stays."""
        self._out = [value]

    def at(self, t: int, _repeat: int | None = None) -> None:
        if t < self.now or (t == self.now and self._begun):
            raise ValueError(f"a timer at {t} is not after {self.now}")
        self._set += 1
        heapq.heappush(self._timers, (t, self._set, _repeat))

    def after(self, d: int) -> None:
        self.at(self.now + duration(d))

    def every(self, period: int) -> None:
        p = duration(period)
        self.at(self.now + p, p)

    def stop(self) -> None:
        """Ends the key's run after this step; final steps still come."""
        self._end = self._end or (STOPPED, None)

    def fail(self, message: str) -> None:
        """Fails the key's run at this step; the first failure stays, and it overrides a stop."""
        if self._end is None or self._end[0] != FAILED:
            self._end = (FAILED, str(message))


class _Pass:
    """One key's operator, fed with rows in order."""

    def __init__(self, make: Callable[[], Any], inputs: int, start: int, end: int | None, raises: str | None) -> None:
        self.op, self.ctx = make(), Context(inputs, start)
        self.end, self.raises, self.done = end, raises, False
        self.rows: list[tuple] = []
        self._call("on_start")
        self.ctx._begun = True
        self._settle(start, 0)

    def _call(self, hook: str) -> None:
        if hasattr(self.op, hook):
            getattr(self.op, hook)(self.ctx)

    def _settle(self, t: int, sub: int) -> None:
        ctx = self.ctx
        if ctx._out:
            self.rows.append((t, sub, VALUE, ctx._out[0], None))
            ctx._out = []
        if ctx._end is not None and not self.done:
            self.done = True
            kind, message = ctx._end
            if kind == FAILED and self.raises is not None:
                raise StreamError(self.raises, message)
            self.rows.append((t, sub, kind, None, message))

    def _step(self, t: int, sub: int, fired: list[bool], timed: bool) -> None:
        self.ctx.now, self.ctx.sub, self.ctx._fired = t, sub, fired
        if timed:
            self.rows.append((t, sub, TIMER, None, None))
        self._call("step")
        self._settle(t, sub)

    def _pop(self, t: int) -> bool:
        """Takes the timers of an instant; those that repeat are set anew."""
        timers, due = self.ctx._timers, False
        while timers and timers[0][0] == t:
            _, _, period = heapq.heappop(timers)
            due = True
            if period is not None:
                self.ctx._set += 1
                heapq.heappush(timers, (t + period, self.ctx._set, period))
        return due

    def timers_before(self, t: int, sub: int) -> None:
        ctx = self.ctx
        while not self.done and ctx._timers and (ctx._timers[0][0] < t or (ctx._timers[0][0] == t and sub > 0)):
            at = ctx._timers[0][0]
            self._pop(at)
            self._step(at, 0, [False] * len(ctx._fired), True)

    def row(self, t: int, sub: int, fired: list[bool], latest: list[tuple | None], on: Sequence[bool]) -> None:
        self.timers_before(t, sub)
        if self.done:
            return
        self.ctx._latest = latest
        timed = sub == 0 and self._pop(t)
        if timed or any(f and o for f, o in zip(fired, on, strict=True)):
            self._step(t, sub, fired, timed)

    def finish(self, ended: int | None, final: bool) -> None:
        ctx = self.ctx
        limit = ended if ended is not None else self.end
        while not self.done and ctx._timers and (limit is None or ctx._timers[0][0] <= limit):
            at = ctx._timers[0][0]
            if limit is None and any(p is not None for _, _, p in ctx._timers):
                raise ValueError("a repeating timer needs a run that ends at a time")
            self._pop(at)
            self._step(at, 0, [False] * len(ctx._fired), True)
        failed = ctx._end is not None and ctx._end[0] == FAILED
        if final and not failed:
            t = ctx.now if ended is None else max(ended, ctx.now)
            sub = ctx.sub + 1 if t == ctx.now else 0
            ctx.is_final, ctx.now, ctx.sub, ctx._fired = True, t, sub, [False] * len(ctx._fired)
            self._call("step")
            if ctx._out:
                self.rows.append((t, sub, VALUE, ctx._out[0], None))
                ctx._out = []
        self._call("on_stop")

    def take(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def operate(frames: Sequence[DataFrame], on: Sequence[bool], keys: Sequence[str], make: Callable[[], Any], kind: str, start: int, end: int | None, ended: DataFrame | None, raises: str | None, final: bool = False) -> DataFrame:
    """(keys..., t, sub, kind, v, note): values, timer steps, and where the operator stopped or failed its run.

    ended: (keys..., ended, failed), how far each run goes, where that is
    known. final: a last call is due there. raises: the node's name where a
    failure is to end the job.
    """
    keys, spark = list(keys), frames[0].sparkSession
    n = len(frames)
    rows = align(frames, keys)
    known, final = ended is not None, final and ended is not None
    if not keys:  # the one run takes place even without a row
        empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
        rows = rows.unionByName(spark.range(1).select(*empty))
    if known and keys:
        rows = rows.join(ended, keys, "left")
    elif known:
        rows = rows.withColumn("ended", ended.select("ended").scalar()).withColumn("failed", ended.select("failed").scalar())
    else:
        rows = rows.withColumn("ended", F.lit(None).cast("bigint")).withColumn("failed", F.lit(False))
    spread = rows.repartition(*keys) if keys else rows.coalesce(1)
    spread = spread.sortWithinPartitions(*keys, *STEP)
    value = T._parse_datatype_string(kind)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("t", T.LongType()), T.StructField("sub", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("v", value), T.StructField("note", T.StringType())])
    names, on = schema.names, list(on)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        at: _Pass | None = None
        last: tuple = (None, False)
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                k = row[: len(keys)]
                if at is None or k != key:
                    if at is not None:
                        at.finish(last[0], final and not last[1])
                        out += [(*key, *r) for r in at.take()]
                    key, at = k, _Pass(make, n, start, end, raises)
                ended_at, failed = row[-2:]
                last = (None if pd.isna(ended_at) else int(ended_at), bool(failed))
                t, sub = row[len(keys) : len(keys) + 2]
                if not pd.isna(t):
                    flags = [bool(x) for x in row[len(keys) + 2 : len(keys) + 2 + n]]
                    held = [None if x is None else (x["v"],) for x in row[len(keys) + 2 + n : len(keys) + 2 + 2 * n]]
                    at.row(int(t), int(sub), flags, held, on)
                out += [(*key, *r) for r in at.take()]
            yield _frame(out, names)
        if at is not None:
            at.finish(last[0], final and not last[1])
            yield _frame([(*key, *r) for r in at.take()], names)

    return spread.mapInPandas(run, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)
