"""Operators that look at one value at a time. Frames are (keys..., t, sub, v); v may be any type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Callable[[Column], Column]


def map_(frame: DataFrame, f: Expr) -> DataFrame:
    return frame.withColumn("v", f(F.col("v")))


def filter_(frame: DataFrame, keep: Expr) -> DataFrame:
    """Rows whose predicate holds. It must be boolean and never null."""
    tested = frame.withColumn("__keep", keep(F.col("v")))
    if tested.schema["__keep"].dataType.simpleString() != "boolean":
        raise TypeError("filter predicate must return bool")
    sure = F.when(F.col("__keep").isNull(), F.raise_error(F.lit("filter predicate must return bool")).cast("boolean")).otherwise(F.col("__keep"))
    # The first condition, which the scan can use, keeps the rows of the second.
    return tested.where(F.col("__keep").isNull() | F.col("__keep")).where(sure).drop("__keep")


def filter_map(frame: DataFrame, f: Expr) -> DataFrame:
    """Values that f makes non-null."""
    return map_(frame, f).where("v is not null")


def try_map(frame: DataFrame, f: Expr, error: Expr | None = None, drop: bool = False) -> DataFrame:
    """As map_, with an f that may fail; the failure ends the run.

    ``error`` gives a message for a value that fails and null for others; with
    ``drop`` such values are left out instead, for a run that keeps what came
    before the failure.
    """
    if error is None:
        return map_(frame, f)
    rows = frame.withColumn("__error", error(F.col("v")).cast("string"))
    kind = frame.select(f(F.col("v")).alias("v")).schema["v"].dataType
    if drop:
        return rows.where("__error is null").withColumn("v", f(F.col("v"))).drop("__error")
    return rows.withColumn("v", F.when(F.col("__error").isNotNull(), F.raise_error(F.col("__error")).cast(kind)).otherwise(f(F.col("v")))).drop("__error")


def failed(frame: DataFrame, error: Expr) -> DataFrame:
    """(keys..., t, sub, note) of the values that fail."""
    return frame.withColumn("note", error(F.col("v")).cast("string")).where("note is not null").drop("v")


def timestamp(frame: DataFrame) -> DataFrame:
    return frame.withColumn("v", F.struct(F.col("t").alias("time"), F.col("v").alias("value")))


def inspect(frame: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """Rows unchanged; metrics are observed on the way."""
    return frame.observe(name, *(metrics or (F.count(F.lit(1)).alias("n"),)))


def unzip(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    first, second = frame.schema["v"].dataType.fieldNames()
    return frame.withColumn("v", F.col("v")[first]), frame.withColumn("v", F.col("v")[second])


def collapse(frame: DataFrame) -> DataFrame:
    """The last element of each non-empty batch."""
    return frame.where(F.size("v") > 0).withColumn("v", F.element_at("v", -1))


def map_batch(frame: DataFrame, f: Expr) -> DataFrame:
    return map_(frame, f)
