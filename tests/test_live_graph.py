"""Live runs of graphs against replays of the same rows: equal up to the point that newer rows have settled."""

import operator

import pytest
from pyspark.sql import functions as F

from tidewheel.errors import LiveOnly
from tidewheel.graph import Graph, Live, Replay

ROWS = [(k, t, (t * 7 + len(k)) % 11 - 4) for k in ("a", "bb", "ccc") for t in range(0, 60, 3 + len(k))]

FORMS = {
    "count": lambda g, s, o: s.count(), "sum": lambda g, s, o: s.sum(), "mean": lambda g, s, o: s.mean(), "max": lambda g, s, o: s.max(), "delta": lambda g, s, o: s.delta(),
    "distinct": lambda g, s, o: s.map(lambda v: v % 3).distinct(), "take": lambda g, s, o: s.take(4), "accumulate": lambda g, s, o: s.accumulate(), "scan": lambda g, s, o: s.scan(5, operator.sub, "bigint"),
    "reduce": lambda g, s, o: s.reduce(lambda a, b: a * 2 - b), "throttle": lambda g, s, o: s.filter(lambda v: v > -3).throttle(9), "chain": lambda g, s, o: s.map(lambda v: v + 1).filter(lambda v: v > -2).sum().map(lambda v: v * 2),
    "delay": lambda g, s, o: s.delay(5), "debounce": lambda g, s, o: s.debounce(6), "tumbling": lambda g, s, o: s.window_tumbling(20), "sliding": lambda g, s, o: s.window_sliding(20, 10), "buffer": lambda g, s, o: s.buffer(4),
    "with": lambda g, s, o: s.with_(o, lambda a, b: a * 100 + b), "latest": lambda g, s, o: s.with_latest(o, lambda a, b: a - b), "gate": lambda g, s, o: s.gate(o.map(lambda v: v > 0)), "sample": lambda g, s, o: o.sample(s), "merge": lambda g, s, o: g.merge([o, s]), "gather": lambda g, s, o: g.gather([s, o]),
}


def collect(frame):
    return sorted((r.k, r.t, r["sub"], str(r.v)) for r in frame.collect())


@pytest.mark.parametrize("name", sorted(FORMS))
def test_live_equals_replay(spark, tmp_path, name):
    batch = spark.createDataFrame(ROWS, "k string, t bigint, v bigint")
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k string, t bigint, v bigint"
    batch.where("t < 31").coalesce(1).write.mode("append").parquet(folder)

    g = Graph(spark, ["k"])
    rows = spark.readStream.schema(schema).parquet(folder)
    s = g.live(rows.where("v % 2 = 0"))
    live = g.run(Live(0)).frame(FORMS[name](g, s, g.live(rows.where("t % 3 != 1"))))
    for part in (None, batch.where("t >= 31")):  # two micro-batches
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(folder)
        live.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    got = collect(spark.read.schema(live.schema).parquet(out))

    h = Graph(spark, ["k"])
    r = h.replay(batch.where("v % 2 = 0"), "t", "v", unique=True)
    want = collect(h.run(Replay.from_(0)).frame(FORMS[name](h, r, h.replay(batch.where("t % 3 != 1"), "t", "v", unique=True))))
    assert set(got) <= set(want) and len(set(got)) == len(got)
    settled = {k: min(max(t for x, t, v in ROWS if x == k and v % 2 == 0), max(t for x, t, v in ROWS if x == k and t % 3 != 1)) for k in ("a", "bb", "ccc")}
    held = 6 if name in ("delay", "debounce") else 0
    assert {x for x in want if x[1] < settled[x[0]] - held} <= set(got), set(want) - set(got)
    assert got


def test_live_and_replay_sources_do_not_mix(spark, tmp_path):
    spark.createDataFrame(ROWS, "k string, t bigint, v bigint").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("k string, t bigint, v bigint").parquet(str(tmp_path / "in"))
    g = Graph(spark, ["k"])
    s = g.live(rows)
    with pytest.raises(LiveOnly):
        g.run().frame(s.count())
    with pytest.raises(LiveOnly):
        g.live(spark.range(1))
    h = Graph(spark)
    with pytest.raises(LiveOnly):
        h.run(Live()).frame(h.replay_from_iter([(1, 2)], "bigint").map(lambda v: F.abs(v)))
