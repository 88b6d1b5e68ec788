"""Running aggregates of an unkeyed stream without sorting it in one task.

The time from the first to the last step is cut into ``BUCKETS`` equal parts.
Each bucket is aggregated, the bucket rows, ``BUCKETS`` at most, are
accumulated in order, and every bucket then runs on its own from its carry.
Whole numbers come out exactly; floating-point sums are added up by bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.times import floored

BUCKETS = 4096

#: By name: the partial aggregates of a bucket, each as (aggregate, how two of its values combine), and the result of them.
AGGREGATES: dict[str, tuple[list[tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]], Callable[..., Column]]] = {
    "sum": ([(F.sum, lambda a, b: a + b)], lambda s: s),
    "count": ([(lambda v: F.count(F.lit(1)), lambda a, b: a + b)], lambda n: n),
    "max": ([(F.max, F.greatest)], lambda m: m),
    "min": ([(F.min, F.least)], lambda m: m),
    "mean": ([(lambda v: F.sum(v.cast("double")), lambda a, b: a + b), (F.count, lambda a, b: a + b)], lambda s, n: s / F.when(n > 0, n)),
}


def running_unkeyed(frame: DataFrame, kind: str, bucket_nanos: int | None = None, by_instant: bool = False) -> DataFrame:
    """(t, sub, v) with v the running aggregate of all rows up to this step. Buckets are sized by the data unless their length is given.

    by_instant: the steps of one instant count as one, as for SQL's default
    frame; each of its rows has the value after the last of them, and sub 0.
    """
    parts, result = AGGREGATES[kind]
    if bucket_nanos is None:
        span = frame.agg(F.min("t").alias("low"), F.max("t").alias("high")).select(F.struct("low", (F.call_function("div", F.col("high") - F.col("low"), F.lit(BUCKETS).cast("bigint")) + 1).alias("size")))
        rows = frame.withColumn("__span", span.scalar())
        rows = rows.withColumn("__b", F.call_function("div", F.col("t") - F.col("__span.low"), F.col("__span.size"))).drop("__span")
    else:
        rows = frame.withColumn("__b", floored(F.col("t"), bucket_nanos))
    names = [f"__p{i}" for i in range(len(parts))]
    totals = rows.groupBy("__b").agg(*[agg(F.col("v")).alias(p) for p, (agg, _) in zip(names, parts, strict=True)])
    # One row for each bucket of time: few, whatever the number of events.
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"max": F.max, "min": F.min}.get(kind, F.sum)
    carries = totals.select("__b", *[fold(p).over(before).alias(p) for p in names])
    carried = rows.join(F.broadcast(carries) if bucket_nanos is None else carries, "__b")
    bucket = Window.partitionBy("__b")
    inside = bucket.orderBy("t").rangeBetween(Window.unboundedPreceding, 0) if by_instant else bucket.orderBy("t", "sub").rowsBetween(Window.unboundedPreceding, 0)

    def until(p: str, agg: Callable, two: Callable) -> Column:
        own = agg(F.col("v")).over(inside)
        return F.when(F.col(p).isNull(), own).when(own.isNull(), F.col(p)).otherwise(two(F.col(p), own))

    sub = F.lit(0).alias("sub") if by_instant else F.col("sub")
    return carried.select("t", sub, result(*[until(p, agg, two) for p, (agg, two) in zip(names, parts, strict=True)]).alias("v"))
