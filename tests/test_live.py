"""Live operators, fed one file a batch, against the same operators over the whole table."""

import asyncio
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewheel.errors import AsyncIoError, ChannelError
from tidewheel.operators import folds, timed, windows
from tidewheel.streaming import async_io, live

STEPS = "k string, t bigint, sub int, v bigint"


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(8)
    rows = []
    for k in "ab":
        t = sub = 0
        for v in range(60):
            gap = rng.choice([0, 1, 2, 5, 9, 30])
            t, sub = t + gap, 0 if gap else sub + 1
            rows.append((k, t, sub, v))
        rows.append((k, 100_001, 0, 60))  # past every boundary that holds an earlier value
    return rows


def write(spark, rows, path):
    """Files in the order of time, so that no row is late."""
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    for start in range(0, len(ordered), 25):
        spark.createDataFrame(ordered[start : start + 25], STEPS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def ran(spark, frame, tmp_path):
    out = []
    live.sink(frame, lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "at"), once=True).awaitTermination()
    return sorted(out)


CASES = {
    "count": (lambda f: live.count(f, ["k"]), lambda f: folds.count(f, ["k"])),
    "throttle": (lambda f: live.throttle(f, ["k"], 12), lambda f: timed.throttle(f, ["k"], 12)),
    "debounce": (lambda f: live.debounce(f, ["k"], 5), lambda f: timed.debounce(f, ["k"], 5)),
    "tumbling": (lambda f: live.window_tumbling(f, ["k"], 10), lambda f: windows.tumbling(f, ["k"], 10)),
    "sliding": (lambda f: live.window_sliding(f, ["k"], 20, 6), lambda f: windows.sliding(f, ["k"], 20, 6)),
    "sparse": (lambda f: live.window_sliding(f, ["k"], 6, 10), lambda f: windows.sliding(f, ["k"], 6, 10)),
}


@pytest.mark.parametrize("name", CASES)
def test_live_equals_batch(spark, steps, tmp_path, name):
    write(spark, steps, str(tmp_path / "in"))
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    of_stream, of_table = CASES[name]
    want = of_table(spark.createDataFrame(steps, STEPS)).where(F.col("t") <= 100_001).select("k", "t", "sub", "v")
    got = ran(spark, of_stream(stream), tmp_path)
    assert got and got == sorted(map(tuple, want.collect()))


def test_late_rows(spark, tmp_path):
    for i, row in enumerate([("a", 10, 0, 1), ("a", 5, 0, 2), ("a", 12, 0, 3)]):
        spark.createDataFrame([row], STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i < 2 else 0)
    stream = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert ran(spark, live.count(stream, ["k"], late="drop"), tmp_path) == [("a", 10, 0, 1), ("a", 12, 0, 2)]
    with pytest.raises(Exception, match="behind the stream"):
        live.sink(live.count(stream, ["k"]), lambda df, _: df.collect(), str(tmp_path / "other"), once=True).awaitTermination()


def test_idle_keys_are_flushed(spark, tmp_path):
    spark.createDataFrame([("a", 1, 0, 7), ("a", 3, 0, 8)], STEPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(STEPS).parquet(str(tmp_path / "in"))
    out = []
    query = live.sink(live.debounce(stream, ["k"], 5, idle_ms=200), lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "at"))
    until = time.time() + 40
    while not out and query.isActive and time.time() < until:
        time.sleep(0.2)
    query.stop()
    assert out == [("a", 8, 0, 8)]


def test_producers(spark, tmp_path):
    def f(sender):
        for i in range(5):
            sender.send(i)
            if i == 2:
                sender.flush()

    sender, stream = async_io.producer(spark, str(tmp_path / "bursts"), "bigint", f)
    got = []
    query = stream.writeStream.foreachBatch(lambda rows, _: got.extend((r.t, r.sub, r.v) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    sender.finish(query, 60)
    assert not query.isActive and [v for *_, v in sorted(got)] == [[0, 1, 2], [3, 4]]
    with pytest.raises(ChannelError):
        sender.send(9)

    async def items():
        yield 1
        raise ValueError("no more")

    sender, stream = async_io.produce_async(spark, str(tmp_path / "async"), "bigint", items)
    with pytest.raises(AsyncIoError, match="no more"):
        sender.join(60)
    assert [r.v for r in spark.read.parquet(str(tmp_path / "async")).collect()] == [[1]]


def test_consumers(spark):
    frame = spark.createDataFrame([(20, 0, "c"), (10, 1, "b"), (10, 0, "a")], "t bigint, sub int, v string")
    got = []

    async def take(rows):
        async for t, v in rows:
            got.append((t, v))
            await asyncio.sleep(0)

    async_io.consume_async(frame, take, config=async_io.Config(capacity=1))
    assert got == [(10, "a"), (10, "b"), (20, "c")]

    async def fails(rows):
        async for _, v in rows:
            if v == "b":
                raise KeyError(v)

    async def leaves(rows):
        await anext(rows)

    async def hangs(rows):
        async for _ in rows:
            pass
        await asyncio.sleep(30)

    for consumer, kind in ((fails, "task"), (leaves, "task dropped"), (hangs, "shutdown timeout")):
        with pytest.raises(AsyncIoError) as e:
            async_io.consume_async(frame, consumer, config=async_io.Config(capacity=1, timeout=0.5))
        assert e.value.kind == kind
    with pytest.raises(ValueError):
        async_io.Config(capacity=0)
