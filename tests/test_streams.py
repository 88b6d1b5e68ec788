"""Small streams against sequential models written here, and a DuckDB comparison over the given tables."""

import glob
import operator
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel import queries
from tidewheel.errors import GraphMismatch
from tidewheel.functions.times import DAY, display
from tidewheel.graph import Graph, Replay, Stop
from tidewheel.sources import files

SF = "/root/testdata/sf0.001"


def trace(run, stream):
    return [(r.t, r.v) for r in run.frame(stream).orderBy("t", "sub").collect()]


def numbers(g, items=((3, 5), (4, -2), (4, -2), (9, 7), (15, 6))):
    return g.replay_from_iter(items, "bigint")


def drawn(seed, n, top=400, least=0):
    """A seeded stream: times in order, some of them equal, and small values."""
    rng = random.Random(seed)
    return [(t, rng.randint(-9, 9)) for t in sorted(rng.randint(least, top) for _ in range(n))]


def steps_of(items):
    """(t, sub, v) as a source numbers them."""
    out = []
    for t, v in items:
        out.append((t, out[-1][1] + 1 if out and out[-1][0] == t else 0, v))
    return out


def test_folds_equal_a_loop(spark):
    items = drawn(1, 40)
    g = Graph(spark)
    s = g.replay_from_iter(items, "bigint")
    run, seen, last, product = g.run(), [], None, None
    want = {k: [] for k in ("sum", "count", "mean", "max", "min", "delta", "distinct", "history", "take", "scan", "reduce", "even", "third")}
    for t, v in items:
        seen.append((t, v))
        values = [x for _, x in seen]
        product = v if product is None else (product * 3 + v) % 101
        for name, x in {"sum": sum(values), "count": len(values), "mean": sum(values) / len(values), "max": max(values), "min": min(values), "history": list(seen), "scan": 50 - sum(values), "reduce": product}.items():
            want[name].append((t, x))
        if last is not None:
            want["delta"].append((t, v - last))
        if last is None or v != last:
            want["distinct"].append((t, v))
        if len(values) <= 6:
            want["take"].append((t, v))
        if v % 2 == 0:
            want["even"].append((t, v))
        if v % 3 == 0:
            want["third"].append((t, v // 3))
        last = v
    got = {
        "sum": s.sum(), "count": s.count(), "mean": s.mean(), "max": s.max(), "min": s.min(), "delta": s.delta(), "distinct": s.distinct(), "take": s.take(6), "even": s.filter(lambda v: v % 2 == 0),
        "scan": s.scan(50, lambda a, v: a - v, "bigint"), "reduce": s.reduce(lambda a, v: (a * 3 + v) % 101), "third": s.filter_map(lambda v: F.when(v % 3 == 0, (v / 3).cast("bigint"))),
    }
    for name, stream in got.items():
        found = trace(run, stream)
        assert [t for t, _ in found] == [t for t, _ in want[name]] and [v for _, v in found] == pytest.approx([v for _, v in want[name]]), name
    assert [(t, [(x.time, x.value) for x in v]) for t, v in trace(run, s.history())] == want["history"]
    assert trace(run, s.accumulate())[-1][1] == [v for _, v in items]
    assert trace(run, s.take(0)) == [] and trace(run, s.scan(0, operator.add, "bigint")) == want["sum"]
    with pytest.raises(TypeError):
        run.frame(s.filter(lambda v: v + 1))
    with pytest.raises(Exception, match="must return bool"):
        run.frame(s.map(lambda v: F.when(v > 0, v)).filter(lambda v: v > 1)).collect()


def test_overflow(spark):
    top, low = 2**63 - 1, -(2**63)
    g = Graph(spark)
    s = numbers(g, [(0, top), (10, 1), (20, low), (30, low), (40, -5)])
    run = g.run()
    assert trace(run, s.sum("wrap")) == [(0, top), (10, low), (20, 0), (30, low), (40, top - 4)]
    assert trace(run, s.delta("wrap")) == [(10, 2 - 2**63), (20, top), (30, 0), (40, top - 4)]
    with pytest.raises(Exception, match="OVERFLOW"):
        trace(run, s.sum())
    with pytest.raises(ValueError):
        trace(run, s.sum("ignore"))


@pytest.mark.parametrize("seed,size,slide,start", [(1, 60, 25, 0), (2, 31, 7, 0), (3, 40, 40, -20), (4, 10, 45, 5)])
def test_windows_equal_a_loop(spark, seed, size, slide, start):
    items = drawn(seed, 30, least=max(start, 0))
    steps, until = steps_of(items), max(t for t, _ in items) + 2 * size + slide
    g = Graph(spark)
    s = g.replay_from_iter(items, "bigint")
    run = g.run(Replay.from_(start, Stop.at(until)))
    whole = {}
    for t, v in items:
        whole.setdefault(start + ((t - start) // size + 1) * size, []).append(v)
    assert trace(run, s.window_tumbling(size)) == sorted(whole.items())
    if slide < size:
        out = []
        for b in range(start + slide, until + 1, slide):
            inside = [(t, v) for t, sub, v in steps if b - size < t < b or (t == b and sub == 0)]
            if any(t < b for t, _ in inside):
                out.append((b, [v for _, v in inside]))
        assert trace(run, s.window_sliding(size, slide)) == out
    delayed = {t: v for t, v in items}
    assert trace(run, s.delay(13)) == [(t + 13, v) for t, v in sorted(delayed.items())]
    passed, quiet = [], [(t + size, v) for (t, v), (after, _) in zip(items, [*items[1:], (10**9, 0)], strict=True) if after - t > size]
    for t, v in items:
        if not passed or t >= passed[-1][0] + size:
            passed.append((t, v))
    assert trace(run, s.throttle(size)) == passed
    assert trace(run, s.debounce(size)) == quiet


def test_windows_at_single_nanoseconds(spark):
    """Times near 2024 do not fit a double; boundaries are kept to the nanosecond, also before the epoch."""
    day, at = DAY, 19700 * DAY
    for base in (at, -at, 0):
        items = [(base + k * day + d, i) for i, (k, d) in enumerate([(0, 0), (0, 1), (1, -1), (1, 0), (1, 1), (2, -1), (2, 0)])]
        g = Graph(spark)
        s = g.replay_from_iter(items, "bigint")
        run = g.run(Replay.from_(base, Stop.at(base + 5 * day)))
        assert trace(run, s.window_tumbling(day)) == [(base + day, [0, 1, 2]), (base + 2 * day, [3, 4, 5]), (base + 3 * day, [6])]
        assert trace(run, s.window_sliding(day, day // 2))[0] == (base + day // 2, [0, 1])
    shown = spark.sql("select explode(array(1700000000999999999, -1, 0)) as t").select(display(F.col("t")).alias("s")).collect()
    assert [r.s for r in shown] == ["1700000000.999999999", "-1.999999999", "0.000000000"]


def test_sparse_windows_lose_what_comes_at_an_idle_boundary(spark):
    g = Graph(spark)
    s = g.replay_from_iter([(1, "a"), (5, "b"), (10, "c")], "string")
    assert trace(g.run(), s.window_sliding(3, 5)) == [(5, ["b"])]


def test_ties_are_steps_of_their_own(spark):
    g = Graph(spark)
    s = numbers(g, [(10, 1), (10, 2), (10, 3), (20, 4)])
    run = g.run()
    assert trace(run, s.sum()) == [(10, 1), (10, 3), (10, 6), (20, 10)]
    assert run.summary().steps == 4 and run.summary().ended_at == 20
    assert trace(run, s.delay(5)) == [(15, 3), (25, 4)]
    assert trace(run, s.bursts()) == [(10, [1, 2, 3]), (20, [4])]


def test_combination_equals_a_loop(spark):
    streams = {"a": drawn(7, 25), "b": drawn(8, 20), "open": [(t, v > 0) for t, v in drawn(9, 15)]}
    by = {k: {(t, sub): v for t, sub, v in steps_of(items)} for k, items in streams.items()}
    want = {k: [] for k in ("with", "latest", "gate", "sample", "merge", "gather")}
    now = {}
    for step in sorted({x for v in by.values() for x in v}):
        fired = {k: step in by[k] for k in by}
        now |= {k: by[k][step] for k in by if fired[k]}
        a, b, t = now.get("a"), now.get("b"), step[0]
        both = a is not None and b is not None
        if both and (fired["a"] or fired["b"]):
            want["with"].append((t, 100 * a + b))
            want["gather"].append((t, [b, a]))
        if both and fired["a"]:
            want["latest"].append((t, a - b))
        if fired["a"] and now.get("open"):
            want["gate"].append((t, a))
        if fired["open"] and a is not None:
            want["sample"].append((t, a))
        if fired["b"] or fired["a"]:
            want["merge"].append((t, b if fired["b"] else a))
    g = Graph(spark)
    a, b, opened = (g.replay_from_iter(streams[k], kind) for k, kind in (("a", "bigint"), ("b", "bigint"), ("open", "boolean")))
    run = g.run()
    got = {"merge": g.merge([b, a]), "gather": g.gather([b, a]), "sample": a.sample(opened), "gate": a.gate(opened), "latest": a.with_latest(b, lambda x, y: x - y), "with": a.with_(b, lambda x, y: 100 * x + y)}
    assert {k: trace(run, v) for k, v in got.items()} == want
    with pytest.raises(GraphMismatch):
        b.gate(Graph(spark).just(True))
    with pytest.raises(ValueError):
        g.gather([])


def test_run_control(spark):
    g = Graph(spark)
    s = numbers(g)
    assert trace(g.run(Replay.from_(0, Stop.at(9))), s) == [(3, 5), (4, -2), (4, -2), (9, 7)]
    assert trace(g.run(Replay.from_(0, Stop.steps(2))), s) == [(3, 5), (4, -2)]
    assert trace(g.run(Replay.from_(0, Stop.after(10))), g.ticker(5).count()) == [(0, 1), (5, 2), (10, 3)]
    assert g.run().peek(s).first().v == 6
    with pytest.raises(ValueError, match="behind the run"):
        numbers(g, [(31, 4), (30, 6)])
    with pytest.raises(ValueError):
        s.throttle(-1)
    with pytest.raises(Exception, match="behind the run"):
        g.run(Replay.from_(5)).frame(numbers(g)).collect()


def test_keyed_runs_end_each_on_their_own(spark):
    rows = [("x", t, t) for t in (1, 2, 2, 5)] + [("y", t, t) for t in (4, 8)] + [(None, 3, 3), (None, 9, 9)]
    g = Graph(spark, ["k"])
    s = g.replay(spark.createDataFrame(rows, "k string, t bigint, v bigint"), "t", "v", ["v"])
    got = g.run(Replay.from_(0, Stop.steps(2))).frame(s).collect()
    assert sorted((str(r.k), r.t, r["sub"]) for r in got) == [("None", 3, 0), ("None", 9, 0), ("x", 1, 0), ("x", 2, 0), ("y", 4, 0), ("y", 8, 0)]
    s.buffer(3)  # a final step in each of the three runs
    assert g.run().summary().steps == len(rows) + 3


def test_recordings_and_csv(spark, tmp_path):
    g = Graph(spark)
    s = numbers(g, [(10, 1), (10, 2), (40, 3)])
    files.save_json(g.run().frame(s), str(tmp_path / "log"))
    lines = [line for p in sorted(glob.glob(str(tmp_path / "log/part-*"))) for line in open(p).read().split()]
    assert lines == ["[10,1]", "[10,2]", "[40,3]"]
    back = files.load_json(spark, str(tmp_path / "log"), "bigint")
    h = Graph(spark)
    assert trace(h.run(), h.replay(back, "t", "v", ["line"])) == [(10, 1), (10, 2), (40, 3)]
    (tmp_path / "d.csv").write_text("time_nanos,device,value\n0,pump,10\n10,fan,7\n20,pump,15\n")
    rows = files.read_csv(spark, str(tmp_path / "d.csv"), "time_nanos bigint, device string, value bigint")
    c = Graph(spark)
    assert trace(c.run(), c.replay(rows, "time_nanos", "value", ["line"]).sum()) == [(0, 10), (10, 17), (20, 32)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    text = [c for c in columns if ours[c].dtype == object or str(ours[c].dtype) in ("str", "string")]
    assert ours[text].astype(str).equals(theirs[text].astype(str))
    assert ours.drop(columns=text).astype(float).equals(theirs.drop(columns=text).astype(float))


@pytest.mark.parametrize("name", ["csv_replay", "running_sum_unkeyed"])
def test_unkeyed_queries_equal_their_sql_where_times_are_equal(spark, tmp_path, name):
    """Events of three users at each of 200 instants, with larger ids and other values in no order of time."""
    con = duckdb.connect()
    con.execute(f"copy (select (event_id * 7919 + k * 331) % 1000003 as event_id, ts, user_id + k * 1500 as user_id, event_type, value * (k + 1) - 90 as value, props from '{SF}/events.parquet', range(3) r(k) where event_id < 200) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    ours, theirs = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()], con.execute(queries.ORACLES[name]).fetchall()
    assert len(ours) == 600 and sorted(ours) == sorted(theirs)
