"""Graphs of streams: deferred nodes that compile to DataFrames once a run's start and stop are known.

A graph may be keyed: every source has the key columns and each key value
behaves as a run of its own. ``Graph.run`` returns a ``Run`` that gives frames,
latest values and a summary. Runs are independent of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewheel.errors import ChannelError, GraphMismatch, LiveOnly, StreamError
from tidewheel.functions.times import duration, floored
from tidewheel.operators import combine, custom, folds, stateless, timed, windows
from tidewheel.plans.frames import STEP, align, numbered, ordered, unique_steps
from tidewheel.sources import files


@dataclass(frozen=True)
class Stop:
    """idle, at (inclusive), after a duration, or after a number of steps."""

    kind: str
    value: int | None = None

    @classmethod
    def at(cls, t: int) -> Stop:
        return cls("at", t)

    @classmethod
    def after(cls, d: int) -> Stop:
        return cls("after", duration(d))

    @classmethod
    def steps(cls, n: int) -> Stop:
        if n < 1:
            raise ValueError("the number of steps must be positive")
        return cls("steps", n)


IDLE = Stop("idle")
NEVER = Stop("never")


@dataclass(frozen=True)
class Replay:
    start: int = 0
    stop: Stop = IDLE

    @classmethod
    def from_(cls, start: int, stop: Stop = IDLE) -> Replay:
        return cls(start, stop)


@dataclass(frozen=True)
class Live:
    """A live run. start aligns time windows; idle_ms: after so long without rows a key lets go of what it holds."""

    start: int = 0
    idle_ms: int | None = None


@dataclass(frozen=True)
class Summary:
    steps: int
    started_at: int
    ended_at: int


class Run:
    """A bounded run. Frames are lazy; the last step of the run is found only where something asks for it."""

    def __init__(self, graph: Graph, spec: Replay, last: DataFrame | None = None, on_error: str = "fail", raw: bool = False) -> None:
        self.graph, self.spec, self.start, self.last, self.on_error, self.raw = graph, spec, spec.start, last, on_error, raw
        self._halted: DataFrame | None = None
        self.end = spec.stop.value if spec.stop.kind == "at" else spec.start + spec.stop.value if spec.stop.kind == "after" else None
        self.built: dict[int, DataFrame] = {}
        self._ended: DataFrame | None = None

    def cut(self, frame: DataFrame) -> DataFrame:
        if self.end is not None:
            frame = frame.where(F.col("t") <= self.end)
        if self.last is not None:
            frame = self._until(frame, self.last)
        halted = self.halted()
        return frame if halted is None else self._until(frame, halted)

    def _until(self, frame: DataFrame, ends: DataFrame) -> DataFrame:
        """Rows up to the end of their key's run, where ends (keys..., t, sub) has one; a null key is a key."""
        keys = self.graph.keys
        until = F.struct(*STEP) <= F.struct(F.col("__h.t"), F.col("__h.sub"))
        if keys:
            there = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*STEP).alias("__h"))
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
            both = frame.join(there, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        else:
            both = frame.withColumn("__h", ends.select(F.struct(*STEP)).scalar())
        return both.where(F.col("__h").isNull() | until).drop("__h")

    def halted(self) -> DataFrame | None:
        """(keys..., t, sub, node, note): where an operator ended the run, for each key; note is the message of a failure.

        Operators are causal, so the first such step of a run in which failing
        values are left out is the run's own. None where no operator can end it.
        """
        nodes = [s for s in self.graph.nodes if s.halts is not None and (self.on_error == "prefix" or s.may_stop)]
        if self.raw or not nodes:
            return None
        if self._halted is None:
            raw, out = Run(self.graph, self.spec, self.last, self.on_error, raw=True), None
            for s in nodes:
                part = raw.cut(s.halts(raw)).select(*self.graph.keys, *STEP, F.lit(s.id).alias("node"), "note")
                out = part if out is None else out.unionByName(part)
            first = F.min_by(F.struct(*STEP, "node", "note"), F.struct(*STEP, F.col("note").isNull(), "node")).alias("h")
            firsts = out.groupBy(*self.graph.keys).agg(first) if self.graph.keys else out.agg(first).where("h is not null")
            self._halted = firsts.select(*self.graph.keys, "h.*")
            if not self.graph.keys:  # one row: found once, not in every frame
                self._halted = self.graph.spark.createDataFrame(self._halted.collect(), self._halted.schema)
        return self._halted

    def failures(self) -> DataFrame:
        """(keys..., t, sub, node, note) of the runs that failed."""
        halted = self.halted()
        return self.graph.spark.createDataFrame([], "t bigint, sub int, node int, note string") if halted is None else halted.where("note is not null")

    def form(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """The function that this kind of run uses for an operator."""
        return f

    def frame(self, stream: Stream) -> DataFrame:
        if stream.graph is not self.graph:
            raise GraphMismatch("the stream belongs to another graph")
        if stream.id not in self.built:
            self.built[stream.id] = self.cut(stream.build(self))
        return self.built[stream.id]

    def peek(self, stream: Stream) -> DataFrame:
        """The latest value, for each key."""
        latest = F.max_by("v", F.struct(*STEP)).alias("v")
        frame = self.frame(stream)
        return frame.groupBy(*self.graph.keys).agg(latest) if self.graph.keys else frame.agg(latest)

    def steps(self) -> DataFrame:
        """(keys..., t, sub) of all steps at which any node ran, without a final one."""
        parts = [self.cut(s.timers(self)) for s in self.graph.nodes if s.timers is not None]
        out = None
        for p in parts:
            p = p.select(*self.graph.keys, *STEP)
            out = p if out is None else out.unionByName(p)
        if out is None:
            raise ValueError("the graph has no source")
        return out.distinct()

    def ended(self) -> DataFrame:
        if self._ended is None:
            steps = self.steps()
            ended = F.max("t").alias("ended")
            rows = steps.groupBy(*self.graph.keys).agg(ended) if self.graph.keys else steps.agg(ended)
            failed = F.lit(False)
            if self.halted() is not None and self.graph.keys:
                rows = rows.join(self.failures().select(*self.graph.keys, F.lit(True).alias("__failed")), self.graph.keys, "left")
                failed = F.coalesce("__failed", failed)
            elif self.halted() is not None:
                failed = F.lit(not self.failures().isEmpty())
            self._ended = rows.select(*self.graph.keys, "ended", failed.alias("failed"))
        return self._ended

    def summary(self) -> Summary:
        """Of a run that did not fail. In a keyed graph each key is a run, with a final step of its own."""
        self.check()
        keys = self.graph.keys
        runs = F.count_distinct(F.struct(*keys)) if keys else F.lit(1)
        got = self.steps().agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), runs.alias("runs")).first()
        return Summary(got.n + self.graph.has_final * got.runs, self.start, self.start if got.t is None else got.t)

    def check(self) -> None:
        """Raises the failure that ended a run with ``on_error="prefix"``; with keys the first one of any key."""
        if self.halted() is not None and (bad := self.failures().orderBy(*STEP, "node").first()):
            raise StreamError(str(bad.node), bad.note)

    def drive(self) -> Summary:
        """Calls every sink's function with (value, t), in the order of steps and, within a step, of the sinks.

        With ``on_error="prefix"`` the sinks get all that comes before a
        failure, which is raised then. A sink that fails lets the others of
        its step still run.
        """
        if self.graph.keys:
            raise ValueError("sinks take the steps of a graph without keys; write the frames of a keyed one")
        sinks = self.graph.sinks
        if sinks:
            rows = align([self.frame(source) for _, source, _ in sinks], []).orderBy(*STEP)
            for row in rows.toLocalIterator(prefetchPartitions=True):
                failure = None
                for i, (node, _, f) in enumerate(sinks):
                    if row[f"f{i}"]:
                        try:
                            f(row[f"l{i}"].v, row.t)
                        except Exception as cause:
                            failure = failure or (node, cause)
                if failure is not None:
                    raise StreamError(str(failure[0].id), failure[1]) from failure[1]
        return self.summary()

    def walk(self, *streams: Stream) -> Steps:
        """Manual stepping; the given streams' values can be looked at on the way."""
        return Steps(self, streams)

    def summary_frame(self) -> DataFrame:
        """(keys..., steps, ended_at)."""
        got = [(F.count(F.lit(1)) + int(self.graph.has_final)).alias("steps"), F.max("t").alias("ended_at")]
        return self.steps().groupBy(*self.graph.keys).agg(*got) if self.graph.keys else self.steps().agg(*got)


class LiveRun(Run):
    """A run over streams as they come. Frames are streaming; what a stream emits goes where ``start`` is told.

    Spark allows one operator with a state in a streaming query, with any
    stateless ones around it. For a chain of several, write the first one's
    stream to a folder and take that as the source of the next graph.
    """

    def __init__(self, graph: Graph, spec: Live) -> None:
        super().__init__(graph, Replay(spec.start))
        self.live = spec

    def form(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        from tidewheel.streaming.live_ops import FORMS

        return partial(FORMS[f], idle_ms=self.live.idle_ms) if f in FORMS else f

    def cut(self, frame: DataFrame) -> DataFrame:
        if not frame.isStreaming:
            raise LiveOnly("a replay source can't be part of a live run")
        return frame

    def halted(self) -> DataFrame | None:
        return None

    def ended(self) -> DataFrame | None:
        return None

    def start(self, stream: Stream, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
        """Calls sink(rows, number) with each micro-batch of the stream; once: ends when what is there has been read."""
        from tidewheel.streaming import live

        return live.sink(self.frame(stream), sink, checkpoint, once)


class Steps:
    """A run taken step by step: ``step`` moves to the next one and says whether there was one."""

    def __init__(self, run: Run, streams: Sequence[Stream]) -> None:
        if run.graph.keys:
            raise ValueError("only a graph without keys is one sequence of steps")
        if run.graph.running:
            raise RuntimeError("the graph is running")
        self.run, self.now = run, run.start
        self._at = {s.id: i + 1 for i, s in enumerate(streams)}
        frames = [run.steps().withColumn("v", F.lit(True)), *[run.frame(s) for s in streams]]
        self._rows = align(frames, []).orderBy(*STEP).toLocalIterator(prefetchPartitions=True)
        self._row: Any = None
        run.graph.running = True

    def step(self) -> bool:
        if not self.run.graph.running:
            raise RuntimeError("the run has ended")
        row = next(self._rows, None)
        if row is None:
            return False
        self._row, self.now = row, row.t
        return True

    def fired(self, stream: Stream) -> bool:
        return self._row is not None and bool(self._row[f"f{self._at[stream.id]}"])

    def peek(self, stream: Stream) -> Any:
        """The latest value, None before the first."""
        held = None if self._row is None else self._row[f"l{self._at[stream.id]}"]
        return None if held is None else held.v

    def end(self) -> Summary:
        """The summary of the whole run; a failure is raised."""
        self.run.graph.running = False
        return self.run.summary()


class Graph:
    def __init__(self, spark: SparkSession, keys: Sequence[str] = ()) -> None:
        self.spark, self.keys, self.nodes, self.has_final, self.running = spark, list(keys), [], False, False
        self.sinks: list[tuple[Stream, Stream, Callable[[Any, int], Any]]] = []

    def _add(self, build: Callable[[Run], DataFrame], timers: Callable[[Run], DataFrame] | None = None, halts: Callable[[Run], DataFrame] | None = None, may_stop: bool = False) -> Stream:
        """halts: (keys..., t, sub, note) where the node would end the run, note null for a clean stop."""
        if self.running:
            raise RuntimeError("nodes can't be added while the graph runs")
        stream = Stream(self, len(self.nodes), build, timers, halts, may_stop)
        self.nodes.append(stream)
        return stream

    # Sources -----------------------------------------------------------------------------------------------------

    def just(self, value: Any) -> Stream:
        def build(run: Run) -> DataFrame:
            v = value if isinstance(value, Column) else F.lit(value)
            return self.spark.range(1).select(F.lit(run.start).cast("bigint").alias("t"), F.lit(0).alias("sub"), v.alias("v"))

        return self._add(build, build)

    def ticker(self, period: int) -> Stream:
        """Start, start + period and so on, without drift; needs a run with an end."""
        p = duration(period)

        def build(run: Run) -> DataFrame:
            if run.end is None:
                raise ValueError("a ticker needs a run that ends at a time")
            return self.spark.range(run.start, run.end + 1, p).select(F.col("id").alias("t"), F.lit(0).alias("sub"), F.lit(True).alias("v"))

        return self._add(build, build)

    def replay(self, df: DataFrame, t: Column | str, v: Column | str, order: Sequence[Column | str] = (), unique: bool = False) -> Stream:
        """A table's rows as steps, in the order of t and then of ``order``; rows before the start fail the run.

        unique: the caller's word that no two rows of a key have one t; the source then needs no shuffle.
        """
        column = lambda c: F.col(c) if isinstance(c, str) else c

        def build(run: Run) -> DataFrame:
            rows = unique_steps(df, self.keys, column(t), column(v)) if unique else numbered(df, self.keys, column(t), column(v), order)
            sure = F.when(F.col("t") < run.start, F.raise_error(F.format_string("time %d is behind the run's start", "t")).cast("bigint")).otherwise(F.col("t"))
            return rows.withColumn("t", sure)

        return self._add(build, build)

    def live(self, df: DataFrame, t: Column | str = "t", v: Column | str = "v", sub: Column | str | None = None) -> Stream:
        """A streaming frame's rows as steps, for live runs; rows of a key must come in the order of their steps."""
        if not df.isStreaming:
            raise LiveOnly("a live source needs a streaming frame")
        column = lambda c: F.col(c) if isinstance(c, str) else c

        def build(run: Run) -> DataFrame:
            if not isinstance(run, LiveRun):
                raise LiveOnly("a live source can't be part of a replay")
            return df.select(*self.keys, column(t).cast("bigint").alias("t"), (F.lit(0) if sub is None else column(sub).cast("int")).alias("sub"), column(v).alias("v"))

        return self._add(build, build)

    def replay_from_iter(self, items: Iterable[tuple[int, Any]], kind: str, on_error: str = "fail") -> Stream:
        """(time, value) pairs in order; an item behind its predecessor fails the run.

        With ``on_error="prefix"`` it does so at the predecessor's step, which
        still counts, in runs that keep what comes before a failure.
        """
        rows, before, note = [], None, None
        for i, (t, v) in enumerate(items):
            if before is not None and t < before:
                note = f"item {i} at {t} is behind the run at {before}"
                if on_error != "prefix":
                    raise ValueError(note)
                break
            rows.append((i, t, v))
            before = t
        source = self.replay(self.spark.createDataFrame(rows, f"i bigint, t bigint, v {kind}"), "t", "v", ["i"])
        if note is not None:
            return self._failing(source, lambda: note)
        return source

    def replay_from_csv(self, path: str, schema: str, t: Column | str, v: Column | str) -> Stream:
        """A CSV file with a header, in file order. A malformed row fails the run; with ``on_error="prefix"`` the rows before it stay."""
        rows = files.read_csv(self.spark, path, schema, "keep")
        bad = rows.where("error is not null").agg(F.min("line").alias("line"), F.min_by("error", "line").alias("error"))
        first = bad.select("line").scalar()
        good = rows.where(F.coalesce(F.col("line") < first, F.lit(True)))
        source = self.replay(good, t, v, ["line"])
        return self._failing(source, lambda: bad.first().error)

    def _failing(self, source: Stream, note: Callable[[], str | None]) -> Stream:
        """A source whose next item can't be read: the run fails at the last step that it has."""

        def build(run: Run) -> DataFrame:
            message = None if run.on_error == "prefix" else note()
            if message is not None:
                raise StreamError(str(source.id), message)
            return run.frame(source)

        def halts(run: Run) -> DataFrame:
            message = note()
            last = run.frame(source).agg(F.max(F.struct(*STEP)).alias("s"))
            step = F.coalesce(F.col("s"), F.struct(F.lit(run.start).cast("bigint").alias("t"), F.lit(-1).alias("sub")))
            rows = last.select(step.alias("s"), F.lit(message).cast("string").alias("note")).where("note is not null")
            return rows.select("s.t", "s.sub", "note")

        return self._add(build, None, halts)

    def replay_from_log(self, recorded: DataFrame) -> Stream:
        """Recorded rows with the steps they had."""
        return self._add(lambda run: recorded.select(*self.keys, *STEP, "v"), lambda run: recorded.select(*self.keys, *STEP))

    def operator(self, inputs: Sequence[tuple[Stream, str]], make: Callable[[], Any], kind: str, finalize: bool = False, may_stop: bool = False) -> Stream:
        """An operator of one's own, see ``operators.custom``. inputs: streams, each with "on" or "watch".

        finalize: a last call at the end of a run that did not fail.
        may_stop: it may call ``ctx.stop``, which ends the run for all nodes.
        """
        if not inputs or any(how not in ("on", "watch") for _, how in inputs):
            raise ValueError("inputs must be streams with on or watch")
        if any(s.graph is not self for s, _ in inputs):
            raise GraphMismatch("streams of different graphs")
        on = [how == "on" for _, how in inputs]
        number = len(self.nodes)

        def rows(run: Run, final: bool) -> DataFrame:
            frames = [run.frame(s) for s, _ in inputs]
            bounded = final and (finalize or run.halted() is not None)
            ended = run.ended() if bounded else None
            raises = str(number) if run.on_error == "fail" else None
            return custom.operate(frames, on, self.keys, make, kind, run.start, run.end, ended, raises, finalize)

        def kept(run: Run, final: bool, *kinds: int) -> DataFrame:
            return rows(run, final).where(F.col("kind").isin(*kinds))

        stream = self._add(
            lambda run: kept(run, not run.raw, custom.VALUE).select(*self.keys, *STEP, "v"),
            lambda run: kept(run, False, custom.TIMER).select(*self.keys, *STEP),
            lambda run: kept(run, False, custom.STOPPED, custom.FAILED).select(*self.keys, *STEP, "note"),
            may_stop,
        )
        self.has_final = self.has_final or finalize
        return stream

    def source_worker(self, build: Callable[[Graph], Stream]) -> Stream:
        """A source built in a child graph, inlined: its values come in bursts; the run must end at a time."""
        out = build(self)

        def sure(run: Run) -> DataFrame:
            if run.end is None:
                raise ChannelError("a source worker needs a run that ends at a time")
            return run.frame(out)

        return self._add(sure).bursts()

    def run(self, spec: Replay | Live | None = None, on_error: str = "fail") -> Run:
        """on_error: ``fail`` ends the job; ``prefix`` keeps what comes before the first failing step, see ``Run.failures``."""
        if on_error not in ("fail", "prefix"):
            raise ValueError("on_error must be fail or prefix")
        if self.running:
            raise RuntimeError("the graph is running")
        spec = spec or Replay()
        if isinstance(spec, Live):
            return LiveRun(self, spec)
        if spec.stop.kind == "steps":
            steps = Run(self, Replay(spec.start), on_error=on_error).steps()
            last = F.max(F.struct(*STEP)).alias("s")
            if self.keys:  # each key's run ends at its own n-th step
                nth = steps.withColumn("__n", F.row_number().over(ordered(self.keys))).where(F.col("__n") <= spec.stop.value).groupBy(*self.keys).agg(last)
            else:
                nth = steps.orderBy(*STEP).limit(spec.stop.value).agg(last)
            return Run(self, Replay(spec.start), nth.select(*self.keys, "s.*"), on_error)
        return Run(self, spec, on_error=on_error)

    # Several streams -----------------------------------------------------------------------------------------------

    def merge(self, streams: Sequence[Stream]) -> Stream:
        return self._many(streams, combine.merge)

    def gather(self, streams: Sequence[Stream]) -> Stream:
        return self._many(streams, combine.gather)

    def _many(self, streams: Sequence[Stream], f: Callable) -> Stream:
        if not streams:
            raise ValueError("at least one stream is needed")
        if any(s.graph is not self for s in streams):
            raise GraphMismatch("streams of different graphs")
        return self._add(lambda run: run.form(f)([run.frame(s) for s in streams], self.keys))


class Stream:
    """A node's values. Every method adds a node to the graph."""

    def __init__(self, graph: Graph, number: int, build: Callable[[Run], DataFrame], timers: Callable[[Run], DataFrame] | None, halts: Callable[[Run], DataFrame] | None = None, may_stop: bool = False) -> None:
        self.graph, self.id, self.build, self.timers, self.halts, self.may_stop = graph, number, build, timers, halts, may_stop

    def _then(self, f: Callable[..., DataFrame], *args: Any, timers: Callable[[Run], DataFrame] | None = None) -> Stream:
        return self.graph._add(lambda run: run.form(f)(run.frame(self), *args), timers)

    def _keyed(self, f: Callable[..., DataFrame], *args: Any) -> Stream:
        return self._then(f, self.graph.keys, *args)

    def _with(self, other: Stream, f: Callable[..., DataFrame], *args: Any) -> Stream:
        if other.graph is not self.graph:
            raise GraphMismatch("streams of different graphs")
        return self.graph._add(lambda run: run.form(f)(run.frame(self), run.frame(other), self.graph.keys, *args))

    def map(self, f: stateless.Expr) -> Stream:
        return self._then(stateless.map_, f)

    def filter(self, keep: stateless.Expr) -> Stream:
        return self._then(stateless.filter_, keep)

    def filter_map(self, f: stateless.Expr) -> Stream:
        return self._then(stateless.filter_map, f)

    def try_map(self, f: stateless.Expr, error: stateless.Expr | None = None) -> Stream:
        """error: a message for a value that fails, else null; only such failures leave a prefix."""
        halts = None if error is None else lambda run: stateless.failed(run.frame(self), error)
        return self.graph._add(lambda run: stateless.try_map(run.frame(self), f, error, run.on_error == "prefix"), None, halts)

    def sink(self, f: Callable[[Any, int], Any]) -> Stream:
        """Has f called with every (value, t) by ``Run.drive``; its own values are True at each fire."""
        out = self._then(lambda frame: frame.withColumn("v", F.lit(True)))
        self.graph.sinks.append((out, self, f))
        return out

    #: A sink whose function may fail: ``Run.drive`` raises its error with the node.
    try_sink = sink

    def inspect(self, name: str, *metrics: Column) -> Stream:
        return self._then(stateless.inspect, name, *metrics)

    def timestamp(self) -> Stream:
        return self._then(stateless.timestamp)

    def unzip(self) -> tuple[Stream, Stream]:
        return self._then(lambda f: stateless.unzip(f)[0]), self._then(lambda f: stateless.unzip(f)[1])

    def collapse(self) -> Stream:
        return self._then(stateless.collapse)

    def map_batch(self, f: stateless.Expr) -> Stream:
        return self._then(stateless.map_batch, f)

    def count(self) -> Stream:
        return self._keyed(folds.count)

    def sum(self, on_overflow: str = "fail") -> Stream:
        return self._keyed(folds.sum_, on_overflow)

    def mean(self) -> Stream:
        return self._keyed(folds.mean)

    def max(self) -> Stream:
        return self._keyed(folds.extreme, "max")

    def min(self) -> Stream:
        return self._keyed(folds.extreme, "min")

    def delta(self, on_overflow: str = "fail") -> Stream:
        return self._keyed(folds.delta, on_overflow)

    def distinct(self) -> Stream:
        return self._keyed(folds.distinct)

    def take(self, n: int) -> Stream:
        if n < 0:
            raise ValueError("n must not be negative")
        return self._keyed(folds.take, n)

    def accumulate(self) -> Stream:
        return self._keyed(folds.accumulate)

    def history(self) -> Stream:
        return self._keyed(folds.history)

    def scan(self, init: Any, f: Callable[[Any, Any], Any], kind: str) -> Stream:
        return self._keyed(folds.scan, init, f, kind)

    def reduce(self, f: Callable[[Any, Any], Any], kind: str | None = None) -> Stream:
        return self._keyed(folds.reduce, f, kind)

    def custom(self, start: Callable[[], Any], step: Callable[[Any, int, int, Any], tuple[Any, bool, Any]], kind: str) -> Stream:
        """An operator of one's own: a state for each key, called with every step in order."""
        return self._keyed(folds.stepped, start, step, kind)

    def delay(self, by: int) -> Stream:
        d = duration(by, 0)
        return self._then(timed.delay, self.graph.keys, d, timers=(lambda run: self._shifted(run, d)) if d else None)

    def debounce(self, quiet: int) -> Stream:
        q = duration(quiet)
        return self._then(timed.debounce, self.graph.keys, q, timers=lambda run: self._shifted(run, q))

    def throttle(self, interval: int) -> Stream:
        return self._keyed(timed.throttle, duration(interval, 0))

    def _shifted(self, run: Run, by: int) -> DataFrame:
        return run.frame(self).select(*self.graph.keys, (F.col("t") + by).alias("t"), F.lit(0).alias("sub"))

    def buffer(self, n: int) -> Stream:
        """The remainder is stamped with the clock of the last step of the whole graph."""
        self.graph.has_final = True
        return self.graph._add(lambda run: run.form(windows.buffer)(run.frame(self), self.graph.keys, n, run.ended()))

    def window_tumbling(self, size: int) -> Stream:
        d = duration(size)
        due = lambda run: run.frame(self).select(*self.graph.keys, (floored(F.col("t"), d, run.start) + d).alias("t"), F.lit(0).alias("sub"))
        return self.graph._add(lambda run: run.form(windows.tumbling)(run.frame(self), self.graph.keys, d, run.start), due)

    def window_sliding(self, size: int, slide: int) -> Stream:
        d, s = duration(size), duration(slide)
        # Armed from a value on until the boundary at which nothing is left of it.
        due = lambda run: run.frame(self).select(*self.graph.keys, F.explode(F.sequence(floored(F.col("t"), s, run.start) + s, floored(F.col("t") + (d - 1), s, run.start) + s, F.lit(s).cast("bigint"))).alias("t"), F.lit(0).alias("sub"))
        return self.graph._add(lambda run: run.form(windows.sliding)(run.frame(self), self.graph.keys, d, s, run.start), due)

    def with_(self, other: Stream, f: combine.Two) -> Stream:
        return self._with(other, combine.with_, f)

    def with_latest(self, other: Stream, f: combine.Two) -> Stream:
        return self._with(other, combine.with_latest, f)

    def gate(self, open_: Stream) -> Stream:
        return self._with(open_, combine.gate)

    def sample(self, trigger: Stream) -> Stream:
        return self._with(trigger, combine.sample)

    def bursts(self) -> Stream:
        """As a channel to another graph delivers them: all values of one instant together."""
        listed = F.transform(F.array_sort(F.collect_list(F.struct("sub", "v"))), lambda x: x["v"]).alias("v")
        return self._then(lambda f: f.groupBy(*self.graph.keys, "t").agg(listed).select(*self.graph.keys, "t", F.lit(0).alias("sub"), "v"))

    def paced(self, pace: Stream) -> Stream:
        """Bursts taken at the instants of ``pace``; one that comes at another instant breaks the protocol."""

        def f(bursts: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
            first = at.select(*keys, "t", F.lit(0).alias("sub"), F.lit(True).alias("v")).distinct()
            rows = align([bursts, first], keys).where("f0")
            return rows.select(*keys, *STEP, F.when(F.col("f1"), F.col("l0.v")).otherwise(_broken("a packet at %d is not at an instant of the pace", bursts)).alias("v"))

        return self.bursts()._with(pace, f)

    def worker(self, build: Callable[[Stream], Stream]) -> Stream:
        """A child graph inlined: its values come as batches of one, at instants of the parent and at most once at each step of it."""
        out = build(self)

        def f(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
            rows = align([child, parent], keys).where("f0")
            sure = F.when(F.col("f1"), F.col("l0.v")).otherwise(_broken("the worker's value at %d is at no step of its parent", child))
            return rows.select(*keys, *STEP, F.array(sure).alias("v"))

        return out._with(self, f)


def _broken(message: str, frame: DataFrame) -> Column:
    return F.raise_error(F.format_string(message, "t")).cast(frame.schema["v"].dataType)
