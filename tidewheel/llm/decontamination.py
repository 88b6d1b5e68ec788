"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are short and documents long, so similarity of whole sets says nothing;
what counts is the share of an item's shingles that a document contains. Items
are partitioned by the size of their shingle set (powers of two), which sets
the length of their signatures: with at most ``n`` shingles in the partition an
item keeps its ``n // 4 + EXTRA`` smallest MinHash values, or all it has. A
document with three quarters of an item's shingles lacks at most a quarter of
them, so at least ``kept - size // 4`` of the kept values are among its own;
documents that share fewer with the signature are no candidates.

A document's signature are those of its shingles' hashes that a Bloom filter
over the items' shingles lets through; the others, nearly all, never leave the
row. The filter has ``FILTER_BITS`` bits at most, so what a task holds of it
does not grow; with more items it lets more through and the join decides.
Candidates are verified by counting the shingles, as text, that document and
item share.

Words are lower-cased in A-Z. An item of fewer than five words is one shingle,
its whole sequence, looked for among the windows of that many words.

Defined cases: null text has no words; an item without words is contained in
nothing; rows with one id, null included, count as one document (or item) with
the shingles of all of them, so a repeated row changes nothing (an id may be a
struct, by which rows of one id can be told apart); of equal MinHash values
the first by text is kept; texts of any length are searched whole; empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common

K = 5
#: Values that an item keeps beyond those that a document with three quarters of it may lack.
EXTRA = 4
#: Most bits of the Bloom filter, and bits for each value below that.
FILTER_BITS = 1 << 20
BITS_EACH = 16
#: Rows of index or candidates that may be sent to all tasks; larger tables are joined by a shuffle.
BROADCAST_ROWS = 300_000


def windows(words: Column, k: int) -> Column:
    """All windows of k words as text, repeats included; empty with fewer words."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))


def hashed_windows(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, k), " ")))).otherwise(F.array().cast("array<bigint>"))


class Bloom:
    """Two bits for each 64-bit value, held as a literal array of 64-bit words."""

    def __init__(self, values: DataFrame, n: int) -> None:
        """values: one column ``value``; n: how many there are."""
        bits = min(FILTER_BITS, max(1 << 12, 1 << (BITS_EACH * max(1, n) - 1).bit_length()))
        self.mask = bits - 1
        at = values.select(F.explode(F.array(*self._places(F.col("value")))).alias("at"))
        words = at.groupBy(F.call_function("shiftright", "at", F.lit(6)).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int"))).alias("word"))
        every = values.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("id", "word"))), lambda x: x["word"].cast("string"))
        self.words = F.split(F.lit(every.agg(F.array_join(listed, " ")).first()[0]), " ").cast("array<bigint>")

    def _places(self, value: Column) -> list[Column]:
        return [value.bitwiseAND(self.mask), F.call_function("shiftrightunsigned", value, F.lit(32)).bitwiseAND(self.mask)]

    def may_hold(self, value: Column) -> Column:
        def bit(at: Column) -> Column:
            word = F.get(self.words, F.call_function("shiftright", at, F.lit(6)).cast("int"))
            return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        first, second = self._places(value)
        return bit(first) & bit(second)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, shingle, width), distinct."""
    listed = items.select(F.col(id_col).alias("item"), common.words(common.ascii_lower(F.col(text_col).cast("string"))).alias("w"))
    own = F.when(F.size("w") >= K, windows(F.col("w"), K)).when(F.size("w") > 0, F.array(F.array_join("w", " ")))
    return listed.select("item", F.explode(own).alias("shingle"), F.least(F.size("w"), F.lit(K)).alias("width")).distinct()


def signatures(shingles: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item, value, need): the values that an item keeps and how many of them a document must share."""
    part = F.length(F.bin("item_shingles")) - 1  # sizes from 2 ** part on
    kept = F.floor((F.pow(F.lit(2), part + 1) - 1) / 4).cast("bigint") + EXTRA
    ranked = shingles.join(sizes.withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i"))).withColumn("value", F.xxhash64("shingle"))
    rank = F.row_number().over(common.by("item", order=["value", "shingle"]))
    need = F.least(kept, "item_shingles") - F.floor(F.col("item_shingles") / 4)
    return ranked.withColumn("rank", rank).where(F.col("rank") <= kept).select("item", "value", need.alias("need"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) for all pairs with a containment of 0.75 or more."""
    with common.storage(docs.sparkSession, "leak-pairs"):
        shingles = common.materialize(item_shingles(items, item_id_col, item_text_col), "leak-shingles")
        sizes = common.materialize(shingles.groupBy("item").agg(F.count(F.lit(1)).alias("item_shingles")), "leak-sizes")
        widths = sorted(r.width for r in shingles.select("width").distinct().collect())  # K at most
        bloom = Bloom(shingles.select(F.xxhash64("shingle").alias("value")), shingles.count())

        index = common.few(common.materialize(signatures(shingles, sizes), "leak-index"), BROADCAST_ROWS)
        listed = docs.select(F.col(id_col).alias("doc"), common.words(common.ascii_lower(F.col(text_col).cast("string"))).alias("w"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        offered = F.concat(*[F.filter(hashed_windows(F.col("w"), k), bloom.may_hold) for k in widths]) if widths else none("bigint")
        met = listed.select("doc", F.explode(offered).alias("value")).join(index, "value").select("doc", "item", "need", "value").distinct()
        found = met.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("met"), F.first("need").alias("need")).where("met >= need").select("doc", "item")
        found = common.materialize(found, "leak-candidates")

        # Exact containment, for candidates alone.
        spread = F.broadcast if common.is_small(found, BROADCAST_ROWS) else lambda df: df.hint("merge")
        texts = listed.join(spread(found.select(F.col("doc").alias("d")).distinct()), F.col("doc").eqNullSafe(F.col("d")), "left_semi")
        spelled = F.concat(*[F.filter(windows(F.col("w"), k), lambda s: bloom.may_hold(F.xxhash64(s))) for k in widths]) if widths else none("string")
        held = texts.select("doc", F.explode(F.array_distinct(spelled)).alias("shingle"))
        shared = held.join(common.few(shingles, BROADCAST_ROWS).select("item", "shingle"), "shingle").distinct().groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared_shingles"))
        pairs = shared.join(spread(found.select(F.col("doc").alias("d"), F.col("item").alias("i"))), F.col("doc").eqNullSafe(F.col("d")) & F.col("item").eqNullSafe(F.col("i")), "left_semi")
        out = pairs.join(common.few(sizes, BROADCAST_ROWS).withColumnRenamed("item", "i"), F.col("item").eqNullSafe(F.col("i"))).where(4 * F.col("shared_shingles") >= 3 * F.col("item_shingles"))
        out = out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), "item_shingles", "shared_shingles", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6).alias("containment"))
        return common.materialize(out, "leak-pairs")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_OP5 = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
isets AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k,
         unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM iw WHERE len(w) > 0
),
n AS (SELECT item_id, count(*) AS item_shingles FROM isets GROUP BY 1),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, (SELECT DISTINCT k FROM isets) WHERE len(w) >= k
),
hit AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM ds JOIN isets USING (s) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, round(shared_shingles / item_shingles, 6) AS containment
FROM hit JOIN n USING (item_id) WHERE 4 * shared_shingles >= 3 * item_shingles
"""
