"""Combination of streams by step: every operator is a filter over the aligned inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.frames import STEP, align

Two = Callable[[Column, Column], Column]


def with_(a: DataFrame, b: DataFrame, keys: Sequence[str], f: Two) -> DataFrame:
    """When either fires and both have values."""
    both = align([a, b], keys).where("l0 is not null and l1 is not null")
    return both.select(*keys, *STEP, f(F.col("l0.v"), F.col("l1.v")).alias("v"))


def with_latest(a: DataFrame, b: DataFrame, keys: Sequence[str], f: Two) -> DataFrame:
    """When a fires and b has a value: an as-of join that includes b's value of the same step."""
    both = align([a, b], keys).where("f0 and l1 is not null")
    return both.select(*keys, *STEP, f(F.col("l0.v"), F.col("l1.v")).alias("v"))


def gate(a: DataFrame, open_: DataFrame, keys: Sequence[str]) -> DataFrame:
    if open_.schema["v"].dataType.simpleString() != "boolean":
        raise TypeError("gate must be bool")
    return align([a, open_], keys).where("f0 and l1.v").select(*keys, *STEP, F.col("l0.v").alias("v"))


def sample(a: DataFrame, trigger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return align([a, trigger], keys).where("f1 and l0 is not null").select(*keys, *STEP, F.col("l0.v").alias("v"))


def merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of the values of one step the first stream's in the list; the others are dropped."""
    if not frames:
        raise ValueError("merge needs at least one stream")
    tagged = None
    for i, f in enumerate(frames):
        part = f.select(*keys, *STEP, "v", F.lit(i).alias("__i"))
        tagged = part if tagged is None else tagged.unionByName(part)
    w = Window.partitionBy(*keys, *STEP).orderBy("__i")
    return tagged.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*keys, *STEP, "v")


def gather(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The latest values of all, in order, whenever any fires and all have one."""
    if not frames:
        raise ValueError("gather needs at least one stream")
    all_ = align(frames, keys).where(" and ".join(f"l{i} is not null" for i in range(len(frames))))
    return all_.select(*keys, *STEP, F.array(*[F.col(f"l{i}.v") for i in range(len(frames))]).alias("v"))
