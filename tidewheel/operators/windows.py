"""Batches by count and by time. Time windows are aligned to the run's start."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.times import duration, floored
from tidewheel.operators.folds import sequential
from tidewheel.plans.frames import ordered


def _listed() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("t", "sub", F.col("v").alias("v")))), lambda x: x["v"])


def buffer(frame: DataFrame, keys: Sequence[str], n: int, ended_at: DataFrame | None = None) -> DataFrame:
    """Every n-th value emits the last n; the remainder comes at the end of the run.

    ended_at: (keys..., ended, failed) with the clock of each key's last step;
    a failed run has no remainder.
    """
    if n < 1:
        raise ValueError("n must be positive")
    nth = F.row_number().over(ordered(keys)) - 1
    grouped = frame.withColumn("__g", nth - nth % n)
    out = grouped.groupBy(*keys, "__g").agg(F.max(F.struct("t", "sub")).alias("__at"), F.count(F.lit(1)).alias("__n"), _listed().alias("v"))
    if ended_at is None:
        ended = F.col("__at.t")
    else:
        out = out.join(ended_at, list(keys), "left") if keys else out.withColumn("ended", ended_at.select("ended").scalar()).withColumn("failed", ended_at.select("failed").scalar())
        out = out.where((F.col("__n") == n) | ~F.coalesce("failed", F.lit(False)))
        ended = F.coalesce("ended", "__at.t")
    t = F.when(F.col("__n") == n, F.col("__at.t")).otherwise(ended)
    return out.select(*keys, t.alias("t"), F.col("__at.sub").alias("sub"), "v")


def tumbling(frame: DataFrame, keys: Sequence[str], size: int, start: int = 0) -> DataFrame:
    """Values of [S + k size, S + (k + 1) size) at the window's end; empty windows are silent."""
    d = duration(size)
    rows = frame.withColumn("__e", floored(F.col("t"), d, start) + d)
    return rows.groupBy(*keys, "__e").agg(_listed().alias("v")).select(*keys, F.col("__e").alias("t"), F.lit(0).alias("sub"), "v")


def sliding(frame: DataFrame, keys: Sequence[str], size: int, slide: int, start: int = 0) -> DataFrame:
    """At each boundary B = S + k slide the values after B - size up to B, of those at B the first.

    A window is emitted if it holds a value from before B. With slide >= size an
    operator may be idle at a boundary, which needs the values in order.
    """
    d, s = duration(size), duration(slide)
    if s >= d:
        return _sparse(frame, keys, d, s, start)
    rows = frame.withColumn("__b", F.explode(F.sequence(floored(F.col("t"), s, start), floored(F.col("t") + (d - 1), s, start), F.lit(s).cast("bigint"))))
    rows = rows.where((F.col("__b") > start) & (F.col("__b") < F.col("t") + d))
    rows = rows.where((F.col("__b") > F.col("t")) | ((F.col("__b") == F.col("t")) & (F.col("sub") == 0)))
    out = rows.groupBy(*keys, "__b").agg(_listed().alias("v"), F.min("t").alias("__first")).where("__first < __b")
    return out.select(*keys, F.col("__b").alias("t"), F.lit(0).alias("sub"), "v")


def _sparse(frame: DataFrame, keys: Sequence[str], size: int, slide: int, start: int) -> DataFrame:
    """A boundary is armed by the first value that comes while none is; what is held goes when it passes.

    A streaming pass over sorted partitions: memory holds the values of one window.
    """
    value = frame.schema["v"].dataType.simpleString()

    def begin() -> tuple[list, int | None]:
        return [], None

    def fire(held: list, at: int) -> list[tuple[int, int, Any]]:
        kept = [v for t, v in held if t > at - size]
        return [(at, 0, kept)] if kept else []

    def step(state: tuple, t: int, sub: int, v: Any) -> tuple[tuple, list[tuple[int, int, Any]]]:
        (held, armed), out = state, []
        if armed is not None and (armed < t or (armed == t and sub > 0)):
            out, held, armed = fire(held, armed), [], None  # with slide >= size no value is in two windows
        held = [*held, (t, v)]
        if armed == t:
            return ([], None), out + fire(held, t)
        return (held, start + ((t - start) // slide + 1) * slide if armed is None else armed), out

    return sequential(frame, keys, begin, step, f"array<{value}>", lambda state: fire(*state) if state[1] is not None else [])
