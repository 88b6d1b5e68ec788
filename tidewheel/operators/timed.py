"""Timers as arithmetic on step times: delay, throttle, debounce."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.times import duration
from tidewheel.operators.folds import in_order, key_runs
from tidewheel.plans.frames import ordered


def delay(frame: DataFrame, keys: Sequence[str], by: int) -> DataFrame:
    """Of values due at one instant the last survives; no delay passes all through."""
    d = duration(by, 0)
    if d == 0:
        return frame
    last = frame.groupBy(*keys, "t").agg(F.max_by("v", "sub").alias("v"))
    return last.select(*keys, (F.col("t") + d).alias("t"), F.lit(0).alias("sub"), "v")


def debounce(frame: DataFrame, keys: Sequence[str], quiet: int) -> DataFrame:
    """A value comes after a quiet time with no newer one; a value at its very end counts as newer."""
    q = duration(quiet)
    after = F.lead("t").over(ordered(keys))
    rows = frame.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") - F.col("t") > q))
    return rows.select(*keys, (F.col("t") + q).alias("t"), F.lit(0).alias("sub"), "v")


def throttle(frame: DataFrame, keys: Sequence[str], interval: int) -> DataFrame:
    """The first value, then the first at least an interval after the last one let through.

    Whether a value passes depends on which one passed before it, so this is a
    pass in order over Arrow batches. It jumps from one value let through to
    the next by binary search in the times; values are filtered, never looked at.
    """
    i = duration(interval, 0)
    if i == 0:
        return frame
    n = len(keys)
    rows = in_order(frame, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = None
        for batch in batches:
            t, keep = np.asarray(batch.column(n)), np.zeros(batch.num_rows, dtype=bool)
            for a, b, new in key_runs(np.asarray(batch.column(n + 3))):
                at = a if new or due is None else a + int(np.searchsorted(t[a:b], due))
                while at < b:
                    keep[at] = True
                    due = int(t[at]) + i
                    at += int(np.searchsorted(t[at:b], due))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns[:-1], names=batch.schema.names[:-1])

    return rows.mapInArrow(run, rows.drop("first").schema)
