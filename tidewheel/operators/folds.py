"""Ordered folds: window functions where the fold is algebraic, a streaming pass over sorted partitions otherwise."""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewheel.plans.frames import STEP, ordered, running
from tidewheel.plans.prefix import running_unkeyed


def count(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return running_unkeyed(frame, "count")
    return frame.withColumn("v", F.count(F.lit(1)).over(running(keys)))


def _wrapped(exact: Column) -> Column:
    """A whole number of any size as 64-bit arithmetic holds it, modulo 2^64 and signed."""
    span = F.lit(Decimal(2**64))
    rest = F.pmod(exact.cast("decimal(38,0)"), span)
    return F.when(rest >= F.lit(Decimal(2**63)), rest - span).otherwise(rest).cast("bigint")


def _checked(on_overflow: str, kind: T.DataType) -> bool:
    """Whether overflow wraps, which only 64-bit integers can do."""
    if on_overflow not in ("fail", "wrap"):
        raise ValueError("on_overflow must be fail or wrap")
    return on_overflow == "wrap" and isinstance(kind, T.LongType)


def sum_(frame: DataFrame, keys: Sequence[str], on_overflow: str = "fail") -> DataFrame:
    """Numbers add up, strings and arrays are joined."""
    kind, w = frame.schema["v"].dataType, running(keys)
    if isinstance(kind, T.StringType):
        return frame.withColumn("v", F.array_join(F.collect_list("v").over(w), ""))
    if isinstance(kind, T.ArrayType):
        return frame.withColumn("v", F.flatten(F.collect_list("v").over(w)))
    if _checked(on_overflow, kind):
        exact = frame.withColumn("v", F.col("v").cast("decimal(28,0)"))
        exact = exact.withColumn("v", F.sum("v").over(w)) if keys else running_unkeyed(exact, "sum")
        return exact.withColumn("v", _wrapped(F.col("v")))
    if not keys and isinstance(kind, T.NumericType):
        return running_unkeyed(frame, "sum")
    return frame.withColumn("v", F.sum("v").over(w))


def mean(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return running_unkeyed(frame, "mean")
    return frame.withColumn("v", F.avg(F.col("v").cast("double")).over(running(keys)))


def extreme(frame: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """reduce by max or min."""
    if not keys:
        return running_unkeyed(frame, kind)
    return frame.withColumn("v", {"max": F.max, "min": F.min}[kind]("v").over(running(keys)))


def delta(frame: DataFrame, keys: Sequence[str], on_overflow: str = "fail") -> DataFrame:
    w = ordered(keys)
    wide = _checked(on_overflow, frame.schema["v"].dataType)
    rows = frame.withColumn("__before", F.lag("v").over(w)).withColumn("__r", F.row_number().over(w)).where("__r > 1")
    change = _wrapped(F.col("v").cast("decimal(28,0)") - F.col("__before").cast("decimal(28,0)")) if wide else F.col("v") - F.col("__before")
    return rows.withColumn("v", change).drop("__before", "__r")


def distinct(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops values equal to the one right before; NaN equals nothing."""
    w = ordered(keys)
    new = (F.col("__r") == 1) | ~F.col("v").eqNullSafe(F.col("__before"))
    if isinstance(frame.schema["v"].dataType, (T.DoubleType, T.FloatType)):
        new = new | F.isnan("v")
    return frame.withColumn("__before", F.lag("v").over(w)).withColumn("__r", F.row_number().over(w)).where(new).drop("__before", "__r")


def take(frame: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n must not be negative")
    if not keys:
        return frame.orderBy(*STEP).limit(n)
    return frame.withColumn("__r", F.row_number().over(ordered(keys))).where(F.col("__r") <= n).drop("__r")


def accumulate(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.withColumn("v", F.collect_list(F.struct("v")).over(running(keys))).withColumn("v", F.transform("v", lambda x: x["v"]))


def history(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.withColumn("v", F.collect_list(F.struct(F.col("t").alias("time"), F.col("v").alias("value"))).over(running(keys)))


def in_order(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., t, sub, v, first): each partition holds whole keys, sorted by key and step; first marks where a key begins."""
    return frame.select(*keys, *STEP, "v", (F.row_number().over(ordered(keys)) == 1).alias("first"))


def key_runs(first: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether a key begins there) of the runs of one key within a batch."""
    edges = np.flatnonzero(first)
    bounds = [0, *edges[edges > 0].tolist(), len(first)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            yield a, b, bool(first[a])


def sequential(frame: DataFrame, keys: Sequence[str], start: Callable[[], Any], step: Callable[[Any, int, int, Any], tuple[Any, list[tuple[int, int, Any]]]], kind: str, finish: Callable[[Any], list[tuple[int, int, Any]]] | None = None) -> DataFrame:
    """For each key in order: ``step(state, t, sub, v)`` gives the state and the (t, sub, value) that go out, ``finish`` what goes out last.

    Sorted partitions are read in Arrow batches, the state is carried from
    batch to batch, so a key of any length takes one state's memory.
    """
    keys = list(keys)
    rows = in_order(frame, keys)
    value = T._parse_datatype_string(kind)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("t", T.LongType()), T.StructField("sub", T.IntegerType()), T.StructField("v", value)])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, begun = None, None, False
        for batch in batches:
            n = len(keys)
            at, subs, values = (batch.column(n + i).to_pylist() for i in range(3))
            out, of = [], []
            for a, b, new in key_runs(np.asarray(batch.column(n + 3))):
                if new:
                    if begun and finish is not None:
                        last = finish(state)
                        out += last
                        of += [key] * len(last)
                    state, begun = start(), True
                    key = tuple(batch.column(i)[a].as_py() for i in range(n))
                for t, sub, v in zip(at[a:b], subs[a:b], values[a:b], strict=True):
                    state, emitted = step(state, t, sub, v)
                    out += emitted
                    of += [key] * len(emitted)
            yield _rows(out, of, types)
        if begun and finish is not None:
            last = finish(state)
            yield _rows(last, [key] * len(last), types)

    return rows.mapInArrow(run, schema)


def _rows(out: list[tuple[int, int, Any]], of: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    n = len(types) - 3
    columns = [pa.array([k[i] for k in of], types.field(i).type) for i in range(n)] + [pa.array([r[i] for r in out], types.field(n + i).type) for i in range(3)]
    return pa.RecordBatch.from_arrays(columns, schema=types)


#: Folds that need no pass in order, as running aggregates: by function, the fold of many values and of two.
ALGEBRAIC: dict[Callable, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    operator.add: (F.sum, lambda a, b: a + b), max: (F.max, F.greatest), min: (F.min, F.least),
}


def _accumulated(frame: DataFrame, keys: Sequence[str], init: Any, f: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """The state after each value, for each key; without an initial state the first value is the first state."""
    keys = list(keys)
    rows = in_order(frame, keys)
    schema = T.StructType([*rows.schema.fields[: len(keys) + 2], T.StructField("v", T._parse_datatype_string(kind))])
    types = to_arrow_schema(schema)
    n = len(keys) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        for batch in batches:
            values, out = batch.column(n).to_pylist(), []
            for a, b, new in key_runs(np.asarray(batch.column(n + 1))):
                state = ([] if init is NOTHING else [init]) if new else state
                after = list(itertools.accumulate(itertools.chain(state, values[a:b]), f))
                out += after[len(state) :]
                state = after[-1:]
            columns = [batch.column(i).cast(types.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, types.field(n).type)], schema=types)

    return rows.mapInArrow(run, schema)


NOTHING = object()


def scan(frame: DataFrame, keys: Sequence[str], init: Any, f: Callable[[Any, Any], Any], kind: str) -> DataFrame:
    """The state after each value; f gives a new state. ``operator.add``, ``max`` and ``min`` over numbers of that kind are window functions."""
    if f in ALGEBRAIC and frame.schema["v"].dataType == T._parse_datatype_string(kind) and isinstance(frame.schema["v"].dataType, T.IntegralType):
        many, two = ALGEBRAIC[f]
        return frame.withColumn("v", two(many("v").over(running(keys)), F.lit(init)).cast(kind))
    return _accumulated(frame, keys, init, f, kind)


def reduce(frame: DataFrame, keys: Sequence[str], f: Callable[[Any, Any], Any], kind: str | None = None) -> DataFrame:
    """Seeded by the first value."""
    own = frame.schema["v"].dataType
    if f in ALGEBRAIC and kind in (None, own.simpleString()) and isinstance(own, T.IntegralType):
        return frame.withColumn("v", ALGEBRAIC[f][0]("v").over(running(keys)).cast(own))
    return _accumulated(frame, keys, NOTHING, f, kind or own.simpleString())


def stepped(frame: DataFrame, keys: Sequence[str], start: Callable[[], Any], step: Callable[[Any, int, int, Any], tuple[Any, bool, Any]], kind: str) -> DataFrame:
    """As ``sequential`` for a step that gives (state, emit, value), at most one value at the step's own time."""

    def one(state: Any, t: int, sub: int, v: Any) -> tuple[Any, list[tuple[int, int, Any]]]:
        state, emit, value = step(state, t, sub, v)
        return state, [(t, sub, value)] if emit else []

    return sequential(frame, keys, start, one, kind)
