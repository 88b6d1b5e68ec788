"""Near-duplicate documents: SetSketch registers, banded, estimated jointly by likelihood, then verified.

A document is the set of its distinct five-word shingles. Its sketch has
``REGISTERS`` registers; register i is ``floor(1 - log_b(min of e_i))``, cut to
the register range, where ``e_i`` are exponential variables hashed from the
shingles. Registers of a union are the larger ones of its parts, so sketches
merge; two registers agree with a probability that depends on the Jaccard
similarity alone for sets of given sizes.

1. Texts with one set are one class from here on, so copies cost nothing more.
2. Bands of ``ROWS`` registers put classes into buckets. With b = 1.02 two sets
   of similarity 0.75 agree in a register with probability 0.752, so all
   ``BANDS`` bands miss such a pair with probability 2e-7.
3. Each bucket's members are paired with its first member, a star.
4. A pair's similarity is estimated by maximum likelihood from the counts of
   larger, smaller and equal registers and the two set sizes. It is dropped if
   the likelihood-ratio test rejects a similarity of ``threshold`` or more by a
   wide margin (``LIKELIHOOD_MARGIN``, about 1e-9), otherwise it is verified on
   the full sets.
5. Components of the verified links. Where a bucket holds members of different
   components, their sketches are compared in blocks of bounded size, each pair
   in the first band that it shares; pairs that pass the likelihood test tie
   their classes into groups. Only within such a group are full sets compared,
   in blocks and through inverted indexes, so no link between components is
   lost, no pair becomes a row, and passages that many documents share do not
   draw them into one group. A bucket of copies is one component after step 4
   and costs nothing here.
6. A class with very many rows meets its label in slices of bounded size.

Sets hold 64-bit fingerprints of shingles; a set's identity is 128 bits.

Defined cases: null or empty text has no shingles, is linked with nothing and
is its own component; rows with one id are judged each by its own text; rows
that repeat id and text are each reported; a null id takes part, and is null
as a component only where no other id is in it; a similarity of exactly the
threshold links; texts of any length count with all their shingles; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common
from tidewheel.llm.common import mix, shingle_set, word_hashes

K = 5
BASE = 1.02
RATE = 20.0
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
PERCENT = 75
LIKELIHOOD_MARGIN = 18.0
#: Shingles of a block, of which a task that looks for links between components holds two.
BLOCK_SHINGLES = 400_000
#: Sketches of a block, of which a task that ties classes into groups holds two.
BLOCK_SKETCHES = 2048
#: Pairs of sketches that such a task looks at at once, and 64 times fewer whose registers it compares at once.
PAIRS = 1 << 18
#: Rows of a class that go to one task when labels are joined; more in a table so large that HOT_CLASSES would have more.
SLICE_ROWS = 1000
HOT_CLASSES = 10_000
#: Shingles whose register values are taken at once, for bounded memory on long texts.
BLOCK = 2048

_rng = np.random.default_rng(5)
_MULTIPLY = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
#: Largest register value, for a hash of 0.
TOP = int(np.floor(1 - np.log(-np.log1p(-0.5 / 2**32) / RATE) / np.log(BASE)))


def shingles(raw: bytes | None) -> np.ndarray:
    return shingle_set(word_hashes((raw or b"").lower())[0], K)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set; 32-bit hashes, a permutation for each register, made exponential after the minimum is known."""
    low = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    h = (mix(elements) >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(h), BLOCK):
        part = h[start : start + BLOCK][None, :] * _MULTIPLY
        part += _ADD
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=1), out=low)
    e = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, n1: np.ndarray, n2: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of a similarity, by the counts of registers in which the first set's value is larger, smaller or equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-300
    return larger * np.log(np.maximum(up, tiny)) + smaller * np.log(np.maximum(down, tiny)) + equal * np.log(np.maximum(1 - up - down, tiny))


def estimate(n1: np.ndarray, n2: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The similarity of the largest likelihood, which is concave in it: golden-section search, all pairs at once."""
    low, high = np.zeros(len(n1)), np.minimum(n1 / n2, n2 / n1)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(32):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        worse = log_likelihood(a, n1, n2, larger, smaller, equal) < log_likelihood(b, n1, n2, larger, smaller, equal)
        low, high = np.where(worse, a, low), np.where(worse, high, b)
    return (low + high) / 2


def may_reach(threshold: float, n1: np.ndarray, n2: np.ndarray, r1: np.ndarray, r2: np.ndarray, margin: float = LIKELIHOOD_MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Whether the registers are compatible with a similarity of the threshold, and the estimate. r1, r2: a row for each pair."""
    larger, smaller = (r1 > r2).sum(axis=1), (r1 < r2).sum(axis=1)
    counts = (larger, smaller, r1.shape[1] - larger - smaller)
    n1, n2 = n1.astype(float), n2.astype(float)
    best = estimate(n1, n2, *counts)
    fits = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9  # sizes alone bound the similarity
    at = np.minimum(threshold, np.minimum(n1 / n2, n2 / n1))
    near = log_likelihood(at, n1, n2, *counts) >= log_likelihood(best, n1, n2, *counts) - margin
    return fits & ((best >= threshold) | near), best


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0  # numbers the task's rows, by which a large class is cut into slices
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            sizes, keys, sketches = [], [], []
            for text in part.column(1).cast(pa.binary()):
                s = shingles(text.as_py())
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(sketch(s).tobytes() if len(s) else None)
            rows = pa.array(range(done, done + part.num_rows), pa.int64())
            done += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], ["id", "hash", "row", "n", "key", "sketch"])


def _compatible(percent: int):
    def test(n1: pa.Array, n2: pa.Array, s1: pa.Array, s2: pa.Array) -> pa.Array:
        r1, r2 = (np.frombuffer(b"".join(s.to_pylist()), dtype="<u2").reshape(len(s), -1) for s in (s1, s2))
        return pa.array(may_reach(percent / 100, n1.to_numpy(zero_copy_only=False), n2.to_numpy(zero_copy_only=False), r1, r2)[0])

    return test


def _linked(percent: int):
    def test(t1: pa.Array, t2: pa.Array) -> pa.Array:
        out, last, held = [], None, None
        for a, b in zip(t1.cast(pa.binary()), t2.cast(pa.binary()), strict=True):
            a = a.as_py()
            if a != last:  # pairs come sorted by their first side
                last, held = a, shingles(a)
            other = shingles(b.as_py())
            both = len(np.intersect1d(held, other, assume_unique=True))
            out.append(100 * both >= percent * (len(held) + len(other) - both))
        return pa.array(out, pa.bool_())

    return test


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key reachable over links (a, b), for all keys in a link.

    Each round every key points to its smallest neighbour, pointers jump to
    their ends, and links are contracted to the ends; those inside one
    component vanish, so the links left fall fast and the rounds are
    logarithmic in number. Minima go through partial aggregation, so a key
    with very many neighbours is no bottleneck.
    """
    edges = common.materialize(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dup-edges")
    names = common.materialize(edges.select(F.col("a").alias("key")).union(edges.select(F.col("b").alias("key"))).distinct().withColumn("root", F.col("key")), "dup-names")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("key"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("key"), F.col("a").alias("other")))
        low = common.materialize(both.groupBy("key").agg(F.min("other").alias("low")).select("key", F.least("key", "low").alias("low")), "dup-low")
        while True:
            end = low.select(F.col("key").alias("low"), F.col("low").alias("end"))
            jumped = common.materialize(low.join(end, "low").select("key", F.col("end").alias("low"), (F.col("end") != F.col("low")).alias("moved")), "dup-low")
            common.release(low)
            low, moved = jumped, jumped.where("moved").limit(1).count()
            if not moved:
                break
        ends = lambda s, x: low.select(F.col("key").alias(s), F.col("low").alias(x))  # noqa: B023, E731
        left = edges.join(ends("a", "x"), "a").join(ends("b", "y"), "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        renamed = names.join(ends("root", "x"), "root", "left").select("key", F.coalesce("x", "root").alias("root"))
        old = edges, names, low
        edges, names = common.materialize(left, "dup-edges"), common.materialize(renamed, "dup-names")
        for df in old:
            common.release(df)
    return names


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b of keys) whose full sets reach the similarity."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = likely.where(F.arrow_udf(_compatible(percent), "boolean")("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b")
    likely = common.materialize(likely, "dup-likely")
    text = lambda s: texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}"))
    # The side with many partners comes last: its text is read once, not copied for each pair on the way.
    full = likely.join(text("b").hint("merge"), "b").join(text("a").hint("merge"), "a")
    with common.arrow_rows(pairs.sparkSession, 128):
        out = common.materialize(full.where(F.arrow_udf(_linked(percent), "boolean").asNondeterministic()("text_a", "text_b")).select("a", "b"), "dup-verified")
    common.release(likely)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) of every row; the hash tells rows of one id apart."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    with common.storage(docs.sparkSession, "dup-sketches", "dup-labels"):
        sketched = common.materialize(narrow.withColumn("hash", F.xxhash64("text")).mapInArrow(_sketched, common.schema(id=kind, hash="bigint", row="bigint", n="bigint", key="binary", sketch="binary")), "dup-sketches")
        # A class has the smallest of its ids as its name and speaks through the text of its first row by id and hash.
        classes = sketched.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.min(F.struct("id", "hash")).alias("speaker"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows"))
        classes = common.materialize(classes, "dup-classes")

        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sketch", i * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("bucket")))
        member = classes.select("key", "n", F.explode(bands).alias("b")).select("key", "n", "b.*")
        shared = member.groupBy("bucket").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket", "first")
        member = common.materialize(member.join(shared, "bucket"), "dup-buckets")  # only buckets that two classes or more share

        star = member.where(F.col("key") != F.col("first")).select(F.col("first").alias("a"), F.col("key").alias("b")).distinct()
        star = common.materialize(star, "dup-pairs")
        paired = star.select(F.col("a").alias("key")).union(star.select(F.col("b").alias("key"))).union(member.select("key")).distinct()
        texts = _texts(narrow, classes.join(paired, "key", "left_semi").select("key", "speaker.id", "speaker.hash"))

        links = _verified(star, classes, texts, percent)
        joined = components(links)
        more = _between_components(member, joined, classes, texts, percent)
        joined = components(links.unionByName(more))
        # The component's name is the smallest id in it; null only where there is no other.
        least = joined.join(classes.select("key", "id"), "key").groupBy("root").agg(F.min("id").alias("least"))
        label = classes.select("key", F.col("id").alias("own"), "rows").join(joined.join(least, "root").select("key", "least"), "key", "left")
        label = common.materialize(label.select("key", F.coalesce("least", "own").alias("label"), "rows"), "dup-labels")
        total = sketched.count()

    slice_rows = max(SLICE_ROWS, -(-total // HOT_CLASSES))
    slices = F.ceil(F.col("rows") / slice_rows).cast("bigint")
    hot = F.broadcast(label.where(F.col("rows") > slice_rows).select("key", slices.alias("slices")))  # HOT_CLASSES rows at most
    named = label.select("key", "label", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"))
    # Rows without a set have no label to meet; they are spread like the others.
    of = F.when(F.col("key").isNull(), F.col("row")).otherwise(F.coalesce(F.pmod("row", "slices"), F.lit(0)))
    out = sketched.select("id", "hash", "row", "n", "key").join(hot, "key", "left").withColumn("slice", of).join(named, ["key", "slice"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("label"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("hash").alias("text_hash"))


def _upto(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _between_components(member: DataFrame, joined: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components which share a bucket; of many that join the same two, one from a task.

    Groups, tied by pairs of sketches that may reach the similarity, are cut
    into size classes by the factor 4 / 3 (linked sets are in one class or in
    neighbours) and these into blocks of about ``BLOCK_SHINGLES``. A task holds
    two blocks and counts the shingles that their texts share through an
    inverted index; pairs are never rows.
    """
    # The first member's pairs were verified as the star's; what is left are pairs of the others.
    of = member.where(F.col("key") != F.col("first")).select("bucket", "band", "key", "n").join(joined.withColumnRenamed("root", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    of = common.materialize(of, "dup-open")
    mixed = of.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high").select("bucket", F.ceil(F.col("members") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    still = of.join(mixed, "bucket").withColumn("i", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
    deal = F.transform(_upto(F.col("blocks")), lambda j: F.struct(F.least("i", j).alias("i1"), F.greatest("i", j).alias("i2"), F.when(F.col("i") == j, 3).when(F.col("i") < j, 1).otherwise(2).alias("side")))
    dealt = still.select("bucket", "band", "key", "n", "c", F.explode(deal).alias("task")).select("bucket", "band", "key", "n", "c", "task.*").join(classes.select("key", "sketch"), "key")
    ties = common.materialize(dealt.groupBy("bucket", "i1", "i2").applyInArrow(_ties(percent), common.schema(a="binary", b="binary")), "dup-ties")
    common.release(of)

    tied = ties.select(F.col("a").alias("key")).union(ties.select(F.col("b").alias("key"))).distinct()
    rest = tied.join(classes.select("key", "n"), "key").join(joined.withColumnRenamed("root", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    group = components(ties).withColumnRenamed("root", "g")
    size_class = F.floor(F.log(F.col("n") * 1.0) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    rest = common.materialize(rest.join(group, "key").withColumn("s", size_class), "dup-rest")
    blocks = rest.groupBy("g", "s").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = rest.join(blocks, ["g", "s"]).withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    own = own.join(blocks.select("g", (F.col("s") - 1).alias("s"), F.col("blocks").alias("above")), ["g", "s"], "left")
    own = own.join(blocks.select("g", (F.col("s") + 1).alias("s"), F.col("blocks").alias("below")), ["g", "s"], "left")

    def task(s1, i1, s2, i2, side):
        return F.struct(s1.alias("s1"), i1.alias("i1"), s2.alias("s2"), i2.alias("i2"), side.alias("side"))

    s, i = F.col("s"), F.col("i")
    tasks = F.concat(
        F.transform(_upto(F.col("blocks")), lambda j: task(s, F.least(i, j), s, F.greatest(i, j), F.when(i == j, 3).when(i < j, 1).otherwise(2))),
        F.transform(_upto(F.col("above")), lambda j: task(s, i, s + 1, j, F.lit(1))),
        F.transform(_upto(F.col("below")), lambda j: task(s - 1, j, s, i, F.lit(2))),
    )
    dealt = own.select("key", "c", "g", F.explode(tasks).alias("task")).select("key", "c", "g", "task.*").join(texts, "key")
    out = dealt.groupBy("g", "s1", "i1", "s2", "i2").applyInArrow(_block_links(percent), common.schema(a="binary", b="binary"))
    return common.materialize(out, "dup-verified")


class _Forest:
    """Union of names; ``join`` says whether two were apart."""

    def __init__(self) -> None:
        self.parent: dict[bytes, bytes] = {}

    def root(self, c: bytes) -> bytes:
        parent = self.parent
        parent.setdefault(c, c)
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    def join(self, a: bytes, b: bytes) -> bool:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[x] = y
        return x != y


def _ties(percent: int):
    def ties(rows: pa.Table) -> pa.Table:
        """Of the pairs of two blocks of one bucket that are in different components, first share this band and may reach the similarity, as many as tie their classes together."""
        keys, comps, sides = rows.column("key").to_pylist(), rows.column("c").to_pylist(), np.array(rows.column("side").to_pylist())
        n = rows.column("n").to_numpy()
        band = rows.column("band")[0].as_py()
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype="<u2").reshape(len(keys), REGISTERS)
        of = np.unique(np.array([c.hex() for c in comps]), return_inverse=True)[1]
        packed = np.ascontiguousarray(sketches).view("<u8")  # a band of four registers is one number
        left, right = np.flatnonzero(sides & 1), np.flatnonzero(sides & 2)
        forest, found = _Forest(), []
        rows_at_once = max(1, PAIRS // max(1, len(right)))
        for start in range(0, len(left), rows_at_once):
            i = left[start : start + rows_at_once, None]
            apart = (of[i] != of[right]) & (np.minimum(n[i], n[right]) * 100 >= percent * np.maximum(n[i], n[right]))
            if sides[0] == 3:  # one block against itself
                apart &= i < right
            a, b = np.nonzero(apart)
            a, b = i[a, 0], right[b]
            for earlier in range(band):
                new = packed[a, earlier] != packed[b, earlier]
                a, b = a[new], b[new]
            for part in range(0, len(a), PAIRS // 64):
                x, y = a[part : part + PAIRS // 64], b[part : part + PAIRS // 64]
                fits, _ = may_reach(percent / 100, n[x], n[y], sketches[x], sketches[y])
                found += [(keys[k], keys[j]) for k, j in zip(x[fits], y[fits], strict=True) if forest.join(keys[k], keys[j])]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return ties


def _block_links(percent: int):
    def links(rows: pa.Table) -> pa.Table:
        keys, comps, sides = rows.column("key").to_pylist(), rows.column("c").to_pylist(), rows.column("side").to_pylist()
        left, right = [k for k, x in enumerate(sides) if x & 1], [k for k, x in enumerate(sides) if x & 2]
        sets = [shingles(t.as_py()) for t in rows.column("text").cast(pa.binary())]
        found: list[tuple[bytes, bytes]] = []
        if left and right:
            forest = _Forest()
            # The right side's inverted index: for each shingle where its documents begin and how many there are.
            size = np.array([len(sets[k]) for k in right])
            every, owner = np.concatenate([sets[k] for k in right]), np.repeat(np.arange(len(right)), size)
            order = np.argsort(every, kind="stable")
            owner = owner[order]
            distinct, start, count = np.unique(every[order], return_index=True, return_counts=True)
            for k in left:
                at = np.searchsorted(distinct, sets[k])
                at[at == len(distinct)] = 0
                at = at[distinct[at] == sets[k]]
                n = count[at]
                into = np.repeat(start[at] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, dtype=np.int64)
                both = np.bincount(owner[into], minlength=len(right))
                for j in np.flatnonzero(100 * both >= percent * (len(sets[k]) + size - both)):
                    other = right[j]
                    if forest.join(comps[k], comps[other]):
                        found.append((keys[k], keys[other]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return links


def _texts(narrow: DataFrame, spoken: DataFrame) -> DataFrame:
    """(key, text) of the classes; spoken: key, and id and hash of a row. Rows alike in id and hash are told apart by their sets."""
    spoken = spoken.select("key", F.col("id").alias("__id"), F.col("hash").alias("__hash"))
    hashed = narrow.withColumn("hash", F.xxhash64("text"))
    got = hashed.join(spoken, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).select("key", "text")

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashlib.blake2b(shingles(t.as_py()).tobytes(), digest_size=16).digest() == k.as_py() for k, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True)]
            yield batch.filter(pa.array(own))

    one = got.mapInArrow(right, got.schema).dropDuplicates(["key"])
    with common.arrow_rows(narrow.sparkSession, 512):
        return common.materialize(one, "dup-texts")


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("text_hash")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, w.doc_id = c.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM reach GROUP BY d) c ON c.d = w.doc_id
"""
