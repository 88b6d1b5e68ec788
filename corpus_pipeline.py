"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what stays of docs. The
runner writes a stage's rows as Parquet and reads them back for the next.

Defined cases, for every stage: nulls may be in any column; a null id is an id
like any other; rows that repeat an id are each judged by their own text, and
of rows that repeat id and text the second stage keeps the first by a hash of
all columns; of equal similarities all count, as groups are connected
components; texts of any length are read whole; extra columns are carried
along (in the last stage those named like a column of the mix give way); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common, decontamination, mixing, near_dups, quality_rules, secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list accept. Null and empty texts go."""
    rules = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    accepted = ~quality_rules.base_failed() & rules.column().isNull()
    return quality_rules.with_stats(docs).where(accepted).select(*docs.columns)


def _like(docs: DataFrame) -> Column:
    """Tells rows apart by all columns that can be hashed."""
    can = [f.name for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(c) for c in can])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; of rows with the same id and text the first by a hash of all columns."""
    found = near_dups.near_duplicates(docs)
    stay = common.materialize(found.where("kept").select(F.col("doc_id").alias("__stay"), F.col("text_hash").alias("__stay_hash")).distinct(), "pipeline-stay")
    hashed = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    left = hashed.join(stay, F.col("doc_id").eqNullSafe(F.col("__stay")) & (F.col("__hash") == F.col("__stay_hash")), "left_semi")
    one = F.row_number().over(common.by("doc_id", "__hash", order=[_like(docs)]))
    return left.withColumn("__row", one).where("__row = 1").select(*docs.columns)


def decontamination_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row judged by its own text, also where ids are null or repeat."""
    row = F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("hash"))
    rows = docs.select(row.alias("__row"), F.col("text").alias("__text"))
    pairs = decontamination.contained_items(rows, common.table(spark, sf_dir, "benchmark"), "__row", "__text")
    gone = common.few(common.materialize(pairs.select(F.col("__row").alias("__gone")).distinct(), "pipeline-leaks"), decontamination.BROADCAST_ROWS)
    return docs.join(gone, row.eqNullSafe(F.col("__gone")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, source_size, target and taken; those of which nothing is taken go."""
    new = ["size", "source_size", "target", "taken"]
    keep = [c for c in docs.columns if c not in (*new, "doc_id")]
    return mixing.mix(docs, keep=keep).where("taken > 0")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination_), ("secret scans", secret_scan), ("source mix", mix)]

#: The learned rules of the first stage and the sketches' seeded choice in the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes on its way goes once its rows are written, and its input with it."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = "stage-" + name.replace(" ", "-")
        with common.storage(spark, kept):
            docs = common.materialize(stage(spark, docs, sf_dir), kept)
        if before is not None:
            common.release(before)
        before = docs
    return docs
