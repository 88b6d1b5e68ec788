"""Quality rules: a learned decision list over interpretable statistics of whole texts.

Sequential covering: each rule is a conjunction of thresholds, grown by
information gain on one half of the labelled rows and pruned on the other;
it joins the list if it is precise enough there, and the rows it covers are
set aside. The list becomes one ordered Spark ``when`` expression.

The statistics cover every word of every text. Labels are taken from a bounded
sample (``max_labelled`` rows in the order of a hash of the id), as the rules
are found on the driver from one row of numbers for each labelled document.

Defined cases: null or empty text has all counts 0 and fails the base rule;
rows are judged each, repeated or not; without labels of both kinds the list
is empty and only the base rule rejects; an empty table gives an empty result;
further columns are ignored or, in ``with_stats``, kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common
from tidewheel.llm.textstats import BASE, RATIOS, features

MAX_LABELLED = 20_000
STAT = "__stats"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_KIND = ", ".join([f"{n}: bigint" for n in BASE] + [f"{n}: double" for n in RATIOS])


def _stats(text: pa.Array) -> pa.Array:
    rows = [features(x.as_py())[:2] for x in text.cast(pa.binary())]
    columns = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(BASE))]
    columns += [pa.array([r[1][i] for r in rows], pa.float64()) for i in range(len(RATIOS))]
    return pa.StructArray.from_arrays(columns, [*BASE, *RATIOS])


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with a struct column ``__stats``; texts go to Python once, other columns not at all."""
    return docs.withColumn(STAT, F.arrow_udf(_stats, f"struct<{_KIND}>").asNondeterministic()(F.col(text_col).cast("string")))


def labelled_sample(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids, the first in the order of a hash; small enough to broadcast."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    return F.broadcast(chosen.groupBy("__id").agg(F.min("__label").alias("__label")))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def fits(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.name)]
        return v > self.at if self.above else v <= self.at

    def column(self, of: str) -> Column:
        c = F.col(f"{of}.{self.name}")
        return c > self.at if self.above else c <= self.at

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.at:.6g}"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Condition, ...], ...]

    def column(self, of: str = STAT) -> Column:
        """Text of the first rule that rejects, or null."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            fits = rule[0].column(of)
            for c in rule[1:]:
                fits = fits & c.column(of)
            out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out

    def rejects(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.fits(x, names) for c in rule])
        return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], max_conditions: int, without: set[str]) -> list[Condition]:
    inside, rule = np.ones(len(x), dtype=bool), []
    while len(rule) < max_conditions and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            if name in without:
                continue
            v = x[inside, j]
            order = np.argsort(v, kind="stable")
            s, below = v[order], np.cumsum(bad[inside][order])
            cut = np.flatnonzero(s[1:] > s[:-1])  # between different values
            if not len(cut):
                continue
            at = (s[cut] + s[cut + 1]) / 2
            for above in (False, True):
                p = (p0 - below[cut]) if above else below[cut]
                n = (len(s) - 1 - cut if above else cut + 1) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(name, above, float(at[k])), g[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.fits(x, names)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[list[Condition], float, int]:
    """The shortest beginning of the rule of the best worth on rows it was not grown from; its precision and cover there."""
    best, worth, precision, covered = rule, -2.0, 0.0, 0
    inside = np.ones(len(x), dtype=bool)
    for k, c in enumerate(rule):
        inside &= c.fits(x, names)
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p + n and (p - n) / (p + n) > worth + 1e-12:
            best, worth, precision, covered = rule[: k + 1], (p - n) / (p + n), (p + 1) / (p + n + 2), p
    return best, precision, covered


def learn(x: np.ndarray, label: np.ndarray, names: list[str], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 3) -> DecisionList:
    """Rules that reject label 0. min_precision holds on the pruning half, with one row more of either kind counted in.

    A rule that is not precise enough there is grown again without the statistic it began with.
    """
    bad = label == 0
    grow = np.arange(len(x)) % 2 == 0
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(x), dtype=bool)
    without: set[str] = set()
    while len(rules) < max_rules and bad[left & grow].any():
        rule = _grow(x[left & grow], bad[left & grow], names, max_conditions, without)
        if not rule:
            break
        kept, precision, covered = _prune(rule, x[left & ~grow], bad[left & ~grow], names)
        if precision < min_precision or covered < min_cover:
            without.add(rule[0].name)
            continue
        without = set()
        rules.append(tuple(kept))
        left &= ~np.logical_and.reduce([c.fits(x, names) for c in kept])
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    sample = labelled_sample(labels, label_col, max_labelled, id_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(sample, "__id")
    # A table may repeat an id; the learner still gets a bounded number of rows.
    rows = with_stats(rows, "__text").select("__id", "__label", f"{STAT}.*").orderBy(F.xxhash64("__id"), "__id", *BASE, *RATIOS).limit(max_labelled)
    got = rows.toArrow()
    names = [*BASE, *RATIOS]
    x = np.stack([got.column(n).to_numpy().astype(float) for n in names], axis=1) if got.num_rows else np.zeros((0, len(names)))
    return learn(x, got.column("__label").to_numpy(), names)


def base_failed(of: str = STAT) -> Column:
    n = F.col(f"{of}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{of}.n_repeat_words") > MAX_REPEAT_PERCENT * n)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The rows with ``__stats``, ``base_failed``, ``rule`` (the first that rejects, else null) and ``kept``."""
    kept = docs if keep is None else docs.select(*keep)
    out = with_stats(kept, text_col).withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, common.table(spark, sf_dir, "labels"))
    judged = judge(docs, rules)
    return judged.select("doc_id", *[F.col(f"{STAT}.{n}").alias(n) for n in BASE], "base_failed", "kept", "rule")
