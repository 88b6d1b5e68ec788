"""The step contract: rows (keys..., t, sub, v), unique and totally ordered by (t, sub) within a key.

``sub`` tells apart steps of one instant. It names a step of the graph, so
operators keep it; only sources number it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STEP = ["t", "sub"]


def ordered(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*STEP)


def running(keys: Sequence[str]) -> WindowSpec:
    return ordered(keys).rowsBetween(Window.unboundedPreceding, 0)


def numbered(df: DataFrame, keys: Sequence[str], t: Column, v: Column, order: Sequence[Column | str]) -> DataFrame:
    """Step rows of a table; rows of one key and instant are numbered in the given order."""
    rows = df.select(*keys, t.cast("bigint").alias("t"), v.alias("v"), *[F.col(c).alias(f"__o{i}") if isinstance(c, str) else c.alias(f"__o{i}") for i, c in enumerate(order)])
    own = [f"__o{i}" for i in range(len(order))] or [F.lit(0)]
    if not keys:  # spread by instant
        nth = F.row_number().over(Window.partitionBy("t").orderBy(*own)) - 1
    else:  # by key alone, so that operators over the same keys need no further shuffle
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("t", *own)) - F.rank().over(Window.partitionBy(*keys).orderBy("t"))
    return rows.withColumn("sub", nth.cast("int")).select(*keys, *STEP, "v")


def unique_steps(df: DataFrame, keys: Sequence[str], t: Column, v: Column) -> DataFrame:
    """Step rows of a table whose (keys, t) are declared unique: nothing is numbered, so nothing is shuffled and filters reach the scan."""
    return df.select(*keys, t.cast("bigint").alias("t"), F.lit(0).alias("sub"), v.alias("v"))


def align(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each step at which any input fired: f0, f1 ... tell which, l0, l1 ... hold the latest values.

    Inputs are tagged and united, so there is one shuffle however many they
    are; each latest value is wrapped in a struct, as null is a value too.
    """
    tagged = None
    for i, frame in enumerate(frames):
        cells = [F.when(F.lit(k == i), F.struct(F.col("v"))).alias(f"p{k}") if k == i else F.lit(None).cast(f"struct<v:{other.schema['v'].dataType.simpleString()}>").alias(f"p{k}") for k, other in enumerate(frames)]
        part = frame.select(*keys, *STEP, *cells)
        tagged = part if tagged is None else tagged.unionByName(part)
    steps = tagged.groupBy(*keys, *STEP).agg(*[F.max(f"p{k}").alias(f"p{k}") if _sortable(frames[k]) else F.first(f"p{k}", ignorenulls=True).alias(f"p{k}") for k in range(len(frames))])
    w = running(keys)
    return steps.select(*keys, *STEP, *[F.col(f"p{k}").isNotNull().alias(f"f{k}") for k in range(len(frames))], *[F.last(f"p{k}", ignorenulls=True).over(w).alias(f"l{k}") for k in range(len(frames))])


def _sortable(frame: DataFrame) -> bool:
    return "map<" not in frame.schema["v"].dataType.simpleString() and "variant" not in frame.schema["v"].dataType.simpleString()
