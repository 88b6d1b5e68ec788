"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of the mix are dealt in equal blocks: sources get blocks by the
highest quotients ``target / (2 k + 1)``, and each source's blocks are dealt
to its shards in the same way by the shards' words. A shard's documents stand
in a seeded order and its blocks are laid over their words one after another,
around and around; the first blocks of that order, as many as the quota says,
are taken. So a document is taken as often as the blocks go over it, partly at
the end, and at most ``max_repeat`` times.

A shard has about ``SHARD_WORDS`` words, a source at most ``MAX_SHARDS`` of
them, so no source, however large, is sorted in one task. Only one sum for
each source comes to the driver; each source's blocks are dealt to its shards
in a task that holds one number for each of them.

Defined cases: a null source is a source of its own and stands last; null or
empty text has size 0 and nothing taken; an empty table gives an empty result;
repeated rows are dealt each; null ids take part as any other; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm import common

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
MAX_SHARDS = 4096
SEED = 17
#: Shards whose quotas may be sent to all tasks; more than these are joined by a shuffle.
BROADCAST_ROWS = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float = 3.0) -> list[float]:
    """Shares of the total by weight; what a source can't take goes to the others by weight until none is above."""
    total, full = float(sum(sizes)), set()
    while True:
        rest = total - sum(max_repeat * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        out = [max_repeat * s if i in full else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        above = {i for i in range(len(out)) if i not in full and out[i] > max_repeat * sizes[i]}
        if not above:
            return [float(t) for t in out]
        full |= above


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients w / 1, w / 3, w / 5 ...; of equal ones the earlier party's comes first."""
    w = np.asarray(weights, dtype=float)
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return [0] * len(w)
    # A divisor under which all get a little less than is due, then the rest by quotient.
    low, high = w.sum() / (seats + len(w)) / 2, 2 * w.max() + w.sum()
    for _ in range(200):
        middle = (low + high) / 2
        if np.floor(w / middle + 0.5).sum() > seats:
            low = middle
        else:
            high = middle
    got = np.floor(w / (high * (1 + 1e-9)) + 0.5).astype(int)
    heap = [(-x / (2 * g + 1), i) for i, (x, g) in enumerate(zip(w, got, strict=True)) if x > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-w[i] / (2 * got[i] + 1), i))
    return got.tolist()


def word_count(text_col: str) -> Column:
    trimmed = F.btrim(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, common.BLANKS))).cast("bigint")


def _quotas(block_words: int, max_repeat: int):
    def quotas(rows: pa.Table) -> pa.Table:
        """How often the shards of one source are gone over whole, and the words of the last, partial round."""
        rows = rows.sort_by("__shard")
        words = rows.column("words").to_numpy()
        blocks = np.array(sainte_lague(words.tolist(), rows.column("__blocks")[0].as_py()), dtype=np.int64)
        take = np.minimum(blocks * block_words, max_repeat * words)
        return pa.table({"__place": rows.column("__place"), "__shard": rows.column("__shard"), "__passes": take // words, "__rest": take % words})

    return quotas


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = 3, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, keep: Sequence[str] = ()) -> DataFrame:
    """(id, the kept columns, size, source_size, target, taken) of every row. Weights repeat over the sources in code point order, null last.

    keep: further columns of docs that are carried along; they may not be named like the columns of the result.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    own = [F.col(id_col).alias("__id"), source.isNull().alias("__none"), F.coalesce(source, F.lit("")).alias("__source"), word_count(text_col).alias("__size"), F.xxhash64(F.col(text_col).cast("string")).alias("__hash")]
    rows = docs.select(*own, *keep)
    with common.storage(spark, "mix-quotas"):
        sized = common.materialize(docs.select(*own), "mix-sizes")
        sources = sorted((r["__none"], r["__source"], int(r.words)) for r in sized.groupBy("__none", "__source").agg(F.sum("__size").alias("words")).collect())
        sizes = [s[2] for s in sources]
        aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], max_repeat) if sources else []
        blocks = sainte_lague(aims, round(sum(aims) / block_words))
        shards = [max(1, min(MAX_SHARDS, -(-n // shard_words))) for n in sizes]
        table = common.local_table(
            spark, __none=("boolean", [s[0] for s in sources]), __source=("string", [s[1] for s in sources]), __place=("int", list(range(len(sources)))),
            source_size=("bigint", sizes), target=("double", aims), __shards=("int", shards), __blocks=("bigint", blocks),
        )
        spread = F.broadcast if len(sources) <= BROADCAST_ROWS else lambda df: df

        def placed(df: DataFrame) -> DataFrame:
            return df.join(spread(table), ["__none", "__source"]).withColumn("__shard", F.pmod(F.xxhash64(F.lit(seed), "__id", "__size", "__hash"), F.col("__shards")).cast("int"))

        held = placed(sized).groupBy("__place", "__shard", "__blocks").agg(F.sum("__size").alias("words")).where("words > 0")
        dealt = held.groupBy("__place").applyInArrow(_quotas(block_words, max_repeat), common.schema(__place="int", __shard="int", __passes="bigint", __rest="bigint"))
        dealt = common.few(common.materialize(dealt, "mix-quotas"), BROADCAST_ROWS)

    # The order is total but for rows that are alike in every column.
    hashable = [c for c in keep if "map<" not in rows.schema[c].dataType.simpleString() and "variant" not in rows.schema[c].dataType.simpleString()]
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("__id").cast("string"), F.lit("null")))), F.col("__id"), F.col("__size"), F.col("__hash"), F.xxhash64(*hashable) if hashable else F.lit(0)]
    w = Window.partitionBy("__place", "__shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed(rows).withColumn("__end", F.sum("__size").over(w)).join(dealt, ["__place", "__shard"], "left")
    part = F.greatest(F.lit(0), F.least("__end", "__rest") - (F.col("__end") - F.col("__size")))
    taken = F.coalesce(F.col("__passes") * F.col("__size") + part, F.lit(0)).cast("bigint")
    return out.select(F.col("__id").alias(id_col), *keep, F.col("__size").alias("size"), "source_size", "target", taken.alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
