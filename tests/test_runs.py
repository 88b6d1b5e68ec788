"""Failing runs, sinks, manual steps, operators of one's own and channels."""

import pytest
from pyspark.sql import functions as F

from tidewheel.errors import StreamError
from tidewheel.graph import Graph, Replay, Stop


def trace(run, stream):
    return [(r.t, r.v) for r in run.frame(stream).orderBy("t", "sub").collect()]


def parse(s):
    return s.try_map(lambda v: F.expr("try_cast(v as bigint)"), lambda v: F.when(F.expr("try_cast(v as bigint)").isNull(), F.concat(F.lit("bad "), v)))


def test_prefix_before_a_failure(spark):
    g = Graph(spark)
    s = g.replay_from_iter([(0, "1"), (10, "2"), (20, "x"), (30, "4")], "string")
    n, pairs = parse(s), parse(s).buffer(3)
    run = g.run(on_error="prefix")
    assert trace(run, n) == [(0, 1), (10, 2)]
    assert trace(run, s) == [(0, "1"), (10, "2"), (20, "x")]  # the failing step itself is completed
    assert trace(run, pairs) == []  # no remainder after a failure
    assert [(r.t, r.node, r.note) for r in run.failures().collect()] == [(20, 1, "bad x")]
    with pytest.raises(StreamError, match="bad x"):
        run.summary()
    with pytest.raises(Exception, match="bad x"):
        trace(g.run(), n)


def test_prefix_of_each_key(spark):
    g = Graph(spark, ["k"])
    rows = spark.createDataFrame([("a", 0, "1"), ("a", 5, "x"), ("a", 9, "2"), ("b", 0, "1"), ("b", 9, "2")], "k string, t bigint, v string")
    s = g.replay(rows, "t", "v")
    n, left = parse(s), parse(s).buffer(4)
    run = g.run(on_error="prefix")
    assert sorted((r.k, r.t, r.v) for r in run.frame(n).collect()) == [("a", 0, 1), ("b", 0, 1), ("b", 9, 2)]
    assert [(r.k, r.t, r.v) for r in run.frame(left).collect()] == [("b", 9, [1, 2])]
    assert [(r.k, r.t) for r in run.failures().collect()] == [("a", 5)]


def test_sources_that_fail(spark, tmp_path):
    g = Graph(spark)
    s = g.replay_from_iter([(20, 1), (10, 2)], "bigint", on_error="prefix")
    run = g.run(on_error="prefix")
    assert trace(run, s) == [(20, 1)]
    with pytest.raises(StreamError, match="behind the run"):
        run.check()
    (tmp_path / "bad.csv").write_text("time,value\n10,1\nx,2\n30,3\n")
    h = Graph(spark)
    c = h.replay_from_csv(str(tmp_path / "bad.csv"), "time bigint, value bigint", "time", "value")
    run = h.run(on_error="prefix")
    assert trace(run, c) == [(10, 1)]
    with pytest.raises(StreamError, match="line 3"):
        run.check()
    with pytest.raises(StreamError, match="line 3"):
        h.run().frame(c)
    (tmp_path / "happy.csv").write_text("time,value\n10,1\n20,2\n20,3\n")
    e = Graph(spark)
    c = e.replay_from_csv(str(tmp_path / "happy.csv"), "time bigint, value bigint", "time", "value")
    assert trace(e.run(), c) == trace(e.run(on_error="prefix"), c) == [(10, 1), (20, 2), (20, 3)]


def test_sinks(spark):
    g = Graph(spark)
    s = g.replay_from_iter([(0, 1), (10, 2), (10, 3)], "bigint")
    seen = []
    s.sink(lambda v, t: seen.append((t, "a", v)))
    fires = s.map(lambda v: v * 10).try_sink(lambda v, t: seen.append((t, "b", v)))
    assert g.run().drive().steps == 3
    assert seen == [(0, "a", 1), (0, "b", 10), (10, "a", 2), (10, "b", 20), (10, "a", 3), (10, "b", 30)]
    assert trace(g.run(), fires) == [(0, True), (10, True), (10, True)]
    h = Graph(spark)
    bad = h.replay_from_iter([(0, 1), (10, 0), (20, 1)], "bigint")
    got = []
    bad.try_sink(lambda v, t: 1 // v)
    bad.sink(lambda v, t: got.append(t))
    with pytest.raises(StreamError, match="division"):
        h.run().drive()
    assert got == [0, 10]


def test_manual_steps(spark):
    g = Graph(spark)
    s = g.replay_from_iter([(0, 1), (10, 2)], "bigint")
    late = s.delay(5)
    steps = g.run().walk(s, late)
    seen = []
    while steps.step():
        seen.append((steps.now, steps.peek(s), steps.fired(late), steps.peek(late)))
    with pytest.raises(RuntimeError):
        s.count()
    with pytest.raises(RuntimeError):
        g.run()
    assert steps.end().ended_at == 15
    assert seen == [(0, 1, False, None), (5, 1, True, 1), (10, 2, False, 1), (15, 2, True, 2)]


class Alarm:
    """Emits the watched value 3 after the last trigger, and how many triggers there were at the end."""

    def __init__(self):
        self.n, self.due = 0, None

    def step(self, ctx):
        if ctx.is_final:
            ctx.emit(-self.n)
        elif ctx.fired(0):
            self.n += 1
            self.due = ctx.now + 3
            ctx.after(3)
        elif ctx.now == self.due:
            ctx.emit(ctx.value(1))


def test_operator_with_timers(spark):
    g = Graph(spark)
    a = g.replay_from_iter([(0, 1), (2, 1), (10, 1)], "bigint")
    b = g.replay_from_iter([(4, 7), (11, 8)], "bigint")
    out = g.operator([(a, "on"), (b, "watch")], Alarm, "bigint", finalize=True)
    run = g.run()
    assert trace(run, out) == [(5, 7), (13, 8), (13, -3)]
    assert run.summary() == (s := run.summary()) and (s.steps, s.ended_at) == (9, 13)  # 0 2 3 4 5 10 11 13 and the final one


class Clock:
    def on_start(self, ctx):
        ctx.every(10)

    def step(self, ctx):
        ctx.emit(ctx.elapsed)


class Until:
    def __init__(self, how="stop"):
        self.how = how

    def step(self, ctx):
        ctx.emit(ctx.value(0))
        if ctx.value(0) == 2:
            ctx.stop() if self.how == "stop" else ctx.fail("two")


def test_operators_that_end_their_run(spark):
    g = Graph(spark)
    none = g.replay_from_iter([], "bigint")
    assert trace(g.run(Replay.from_(5, Stop.at(30))), g.operator([(none, "on")], Clock, "bigint")) == [(15, 10), (25, 20)]
    with pytest.raises(Exception, match="repeating timer"):
        trace(g.run(), g.operator([(none, "on")], Clock, "bigint"))
    h = Graph(spark)
    s = h.replay_from_iter([(0, 1), (10, 2), (20, 3)], "bigint")
    stops, rest = h.operator([(s, "on")], Until, "bigint", may_stop=True), s.buffer(5)
    assert trace(h.run(), stops) == trace(h.run(), s) == [(0, 1), (10, 2)]
    assert trace(h.run(), rest) == [(10, [1, 2])]
    assert h.run().summary().ended_at == 10
    f = Graph(spark)
    s = f.replay_from_iter([(0, 1), (10, 2), (20, 3)], "bigint")
    fails = f.operator([(s, "on")], lambda: Until("fail"), "bigint")
    run = f.run(on_error="prefix")
    assert trace(run, fails) == [(0, 1), (10, 2)]
    with pytest.raises(StreamError, match="two"):
        run.drive()
    with pytest.raises(Exception, match="two"):
        trace(f.run(), fails)


def test_operator_of_each_key(spark):
    g = Graph(spark, ["k"])
    rows = spark.createDataFrame([(k, t, t) for k in ("a", "b") for t in (0, 2, 10)] + [("c", 1, 1)], "k string, t bigint, v bigint")
    s = g.replay(rows, "t", "v")
    got = g.run().frame(g.operator([(s, "on"), (s, "watch")], Alarm, "bigint", finalize=True)).orderBy("k", "t", "sub").collect()
    assert [(r.k, r.t, r.v) for r in got] == [(k, *x) for k in ("a", "b") for x in [(5, 2), (13, 10), (13, -3)]] + [("c", 4, 1), ("c", 4, -1)]


def test_channels(spark):
    g = Graph(spark)
    s = g.replay_from_iter([(10, 1), (10, 2), (20, 3)], "bigint")
    pace = g.replay_from_iter([(10, 0), (15, 0), (20, 0)], "bigint")
    slow = g.replay_from_iter([(20, 0)], "bigint")
    run = g.run()
    assert trace(run, s.paced(pace)) == [(10, [1, 2]), (20, [3])]
    with pytest.raises(Exception, match="not at an instant"):
        trace(run, s.paced(slow))
    assert trace(run, s.worker(lambda c: c.filter(lambda v: v > 1))) == [(10, [2]), (20, [3])]
    with pytest.raises(Exception, match="no step of its parent"):
        trace(run, s.worker(lambda c: c.delay(3)))
    ticks = g.source_worker(lambda child: child.ticker(10).count())
    assert trace(g.run(Replay.from_(0, Stop.at(20))), ticks) == [(0, [1]), (10, [2]), (20, [3])]
