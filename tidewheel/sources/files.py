"""Files: CSV replay, and recordings as JSON lines ``[nanos, value]`` or Parquet."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach, below ``spark.checkpoint.dir``; without one only in local runs."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(own or '/tmp/checkpoints').rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, on_error: str = "fail") -> DataFrame:
    """Rows of a CSV file with a header, and ``line``, their order in the file; a malformed row fails the run.

    With ``on_error="keep"`` such rows stay, with nulls, and ``error`` names
    the file and, in a file that is read in one piece, the line; the path must
    be of one file then, without line breaks inside fields.
    """
    if on_error == "fail":
        return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=True).withColumn("line", F.monotonically_increasing_id())
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("line > 0 and value != ''")
    parsed = F.from_csv("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = text.select("line", parsed.alias("row")).select("line", "row.*")
    message = F.format_string(f"{path.replace('%', '%%')}: line %d: %s", F.col("line") + 1, "__bad")
    return rows.withColumn("error", F.when(F.col("__bad").isNotNull(), message)).drop("__bad")


def save_json(frame: DataFrame, path: str) -> None:
    """One ``[nanos, value]`` a line, ordered by step within and over the files."""
    line = F.concat(F.lit("["), F.col("t").cast("string"), F.lit(","), F.coalesce(F.regexp_extract(F.to_json(F.struct("v"), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null")), F.lit("]"))
    frame.repartitionByRange("t").sortWithinPartitions("t", "sub").select(line.alias("value")).write.text(path)


def load_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(t, v, line) of a recording; lines that are not ``[nanos, value]`` fail the run."""
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = text.withColumn("x", F.parse_json("value"))
    return parsed.select(F.variant_get("x", "$[0]", "bigint").alias("t"), F.variant_get("x", "$[1]", kind).alias("v"), "line")


def save_parquet(frame: DataFrame, path: str) -> None:
    frame.write.parquet(path)
