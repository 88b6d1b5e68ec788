"""Quality classifier: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1, the unlabelled set is web text as
it comes: all documents whose labels training may use, labelled or not. With
class prior ``pi`` the risk of a scorer ``g`` is
``pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])`` under the logistic loss.
The scorer is linear in statistics of the whole text and in the frequencies of
byte-class transitions, so the risk is convex as long as the second term is
not below zero: it is minimised by Newton's method, and a step that would
bring the second term below zero is shortened until it does not.

The prior is estimated from the positives and the unlabelled text alone. A
classifier of the one against the other is learned on one half of both; on the
other half the share of unlabelled text above a cut of its score, divided by
the share of positives above it, bounds the prior from above for every cut.
The least such bound counts, where each share is moved by its deviation
(sqrt(log(4 / delta) / 2n)), so thin tails don't decide.

Nothing is sampled. Vectors of numbers, not texts, are stored once, and each
step sums loss, gradient and curvature over all of them in Spark; what comes
to the driver has a fixed size.

Defined cases: null or empty text is scored like a text without any feature;
texts of any length are read whole; a null id is never held out and never
trains; rows are scored each, repeated or not, and each repeated row trains;
an id that has label 1 in any of its label rows is a positive; with no
positives all scores are the prior of 0.5; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common
from tidewheel.llm.textstats import RATIOS, TRANSITIONS, features

N_FEATURES = 1 + len(RATIOS) + TRANSITIONS
FOLDS, HELD_OUT = 4, 2
#: Values are cut to so many deviations from the mean.
CUT = 8.0
#: The ridge is this over the square root of the number of unlabelled rows.
L2 = 1.0
MAX_STEPS = 12
TOLERANCE = 1e-4
LENGTHS = 0.5 ** np.arange(8)
BINS = 1000
POSITIVE, SECOND_HALF = 1, 2


def vector(raw: bytes | None) -> np.ndarray:
    base, ratios, transitions = features(raw)
    return np.concatenate([[np.log1p(base[0])], np.log1p(ratios), np.sqrt(transitions)]).astype(np.float32)


def _vectors(text: pa.Array) -> pa.Array:
    rows = [vector(x.as_py()).astype("<f4").tobytes() for x in text.cast(pa.binary())]
    return pa.array(rows, pa.binary())


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -CUT, CUT) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _sums(rows: DataFrame, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums of f(x, kind) over all rows (kind, x): each task adds up its own, and a tree of tasks the tasks' sums.

    f gives arrays whose shapes don't depend on how many rows it gets.
    """
    shapes = [a.shape for a in f(np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.int64))]
    size = sum(int(np.prod(s)) for s in shapes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f4").reshape(-1, N_FEATURES).astype(float)
                total += np.concatenate([a.ravel() for a in f(x, batch.column(0).to_numpy())])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = rows.mapInArrow(add, "s binary")
    fan_in, n = 64, max(1, rows.rdd.getNumPartitions())
    while n > fan_in:
        n = -(-n // fan_in)
        parts = parts.coalesce(n).mapInArrow(merge, "s binary")
    total = np.zeros(size)
    for r in parts.collect():
        total += np.frombuffer(r.s)
    cut = np.split(total, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    return [c.reshape(s) for c, s in zip(cut, shapes, strict=True)]


def _curve(model: Model, x: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of l(g) and l(-g) over weighted rows: sums of both, the gradient of the latter and its curvature; and of g's inputs."""
    x, weight = x[weight > 0], weight[weight > 0]
    z = np.append(np.clip((x - model.centre) / model.scale, -CUT, CUT), np.ones((len(x), 1)), axis=1)
    g = z @ np.append(model.weights, model.bias)
    s = 1 / (1 + np.exp(-g))
    up, down = np.logaddexp(0, -g) @ weight, np.logaddexp(0, g) @ weight
    return [np.array([weight.sum(), up, down]), z.T @ (weight * s), (z * (weight * s * (1 - s))[:, None]).T @ z, z.T @ weight]


def _newton(rows: DataFrame, model: Model, kinds: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], prior: float | None) -> Model:
    """The least risk. kinds gives the weights of rows as positives and as unlabelled ones.

    With a prior it is the non-negative risk, without one the logistic loss of positives against unlabelled rows.
    """

    def at(m: Model) -> tuple[float, float, np.ndarray, np.ndarray]:
        def both(x: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
            p, u = kinds(kind)
            return _curve(m, x, p) + _curve(m, x, u)

        (np_, p_up, p_down), p_grad, p_hess, p_in, (nu, _, u_down), u_grad, u_hess, _ = _sums(rows, both)
        w, l2 = np.append(m.weights, 0.0), L2 / np.sqrt(nu)
        ridge = np.diag(np.append(np.full(N_FEATURES, l2), 1e-9))
        if prior is None:
            risk = p_up / np_ / 2 + u_down / nu / 2
            grad, hess = (p_grad - p_in) / np_ / 2 + u_grad / nu / 2, p_hess / np_ / 2 + u_hess / nu / 2
            rest = 1.0
        else:
            rest = u_down / nu - prior * p_down / np_  # the term that must not be negative
            risk = prior * p_up / np_ + rest
            grad, hess = -prior * p_in / np_ + u_grad / nu, u_hess / nu
        return risk + l2 / 2 * float(w @ w), rest, grad + l2 * w, hess + ridge

    def along(m: Model, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Risk and the term that must not be negative, after steps of all lengths, in one pass."""
        w = np.append(m.weights, m.bias)[:, None] - step[:, None] * LENGTHS

        def losses(x: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
            g = np.append(np.clip((x - m.centre) / m.scale, -CUT, CUT), np.ones((len(x), 1)), axis=1) @ w
            p, u = kinds(kind)
            return [p.sum(keepdims=True), u.sum(keepdims=True), p @ np.logaddexp(0, -g), p @ np.logaddexp(0, g), u @ np.logaddexp(0, g)]

        n_p, n_u, p_up, p_down, u_down = _sums(rows, losses)
        ridge = L2 / np.sqrt(n_u) / 2 * (w[:-1] ** 2).sum(axis=0)
        if prior is None:
            return p_up / n_p / 2 + u_down / n_u / 2 + ridge, np.ones(len(LENGTHS))
        rest = u_down / n_u - prior * p_down / n_p
        return prior * p_up / n_p + rest + ridge, rest

    risk, _, grad, hess = at(model)
    for _ in range(MAX_STEPS):
        step = np.linalg.solve(hess, grad)
        risks, rests = along(model, step)
        best = int(np.argmin(np.where(rests >= 0, risks, np.inf)))
        if rests[best] < 0 or risk - risks[best] < TOLERANCE * max(1.0, abs(risk)):
            return model
        w = LENGTHS[best] * step
        model = Model(model.weights - w[:-1], float(model.bias - w[-1]), model.centre, model.scale)
        risk, _, grad, hess = at(model)
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """From histograms of a score, the highest last: the least ratio of the shares above a cut, both moved by their deviation."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    slack = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    with np.errstate(divide="ignore", invalid="ignore"):
        best = int(np.argmin(np.where(p > 0, (u + slack) / p, np.inf)))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """may_train: a condition on the id that holds for the rows whose labels, and texts, training may use."""
    spark = docs.sparkSession
    trusted = labels.where(may_train & F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(F.col(id_col).alias("__id")).distinct()
    own = docs.where(may_train & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    start = Model(np.zeros(N_FEATURES), 0.0, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    with common.storage(spark):
        # Vectors first: only they, not the texts, meet the labels.
        x = F.arrow_udf(_vectors, "binary").asNondeterministic()("__text").alias("x")
        raw = common.materialize(own.select("__id", x), "pu-raw")
        half = F.when(F.pmod(F.xxhash64("__id"), F.lit(2)) == 1, SECOND_HALF).otherwise(0)
        marked = raw.join(trusted.withColumn("__p", F.lit(POSITIVE)), "__id", "left")
        rows = common.materialize(marked.select((F.coalesce("__p", F.lit(0)) + half).cast("int").alias("kind"), "x"), "pu-rows")
        common.release(raw)

        n, total, squares = _sums(rows, lambda x, kind: [np.array([len(x), (kind & POSITIVE).sum()], dtype=float), x.sum(axis=0), (x * x).sum(axis=0)])
        if not n[1]:
            return start
        centre = total / n[0]
        start = Model(start.weights, 0.0, centre, np.sqrt(np.maximum(0, squares / n[0] - centre**2)) + 1e-3)

        def first_half(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            here = (kind & SECOND_HALF) == 0
            return (here & ((kind & POSITIVE) > 0)).astype(float), here.astype(float)

        prior = 0.5
        halves = _sums(rows, lambda x, kind: [np.array([w.sum() for w in first_half(kind)])])[0]
        if halves.min() > 0:
            split = _newton(rows, start, first_half, None)

            def histograms(x: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
                at = np.minimum((split.scores(x) * BINS).astype(int), BINS - 1)
                second, p = (kind & SECOND_HALF) > 0, (kind & POSITIVE) > 0
                return [np.bincount(at[second & p], minlength=BINS).astype(float), np.bincount(at[second], minlength=BINS).astype(float)]

            prior = class_prior(*_sums(rows, histograms))
        start = Model(start.weights, float(np.log(prior / (1 - prior))), start.centre, start.scale)
        return _newton(rows, start, lambda kind: (((kind & POSITIVE) > 0).astype(float), np.ones(len(kind))), prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    @F.arrow_udf("double")
    def scores(text: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(text), 512):
            x = np.stack([vector(t.as_py()) for t in text[start : start + 512].cast(pa.binary())])
            out.append(model.scores(x))
        return pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return docs.withColumn(out_col, scores.asNondeterministic()(F.col(text_col).cast("string")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
