"""Helpers shared by the text operators: shared storage, words and shingle hashes."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word is a run of characters other than these six ASCII blanks; it is
#: also what ``bytes.split()`` splits at, which the Python paths rely on.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Stored (compressed) bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20

#: Paths written within each open ``storage``, the innermost last.
_scopes: list[list[str]] = []


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of words; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: ``spark.checkpoint.dir``; where it is unset, one of our own in local runs and an error on a cluster."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (own or "/tmp/checkpoints").rstrip("/") + "/tidewheel"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, so a lost executor never forces recomputation of what came before."""
    path = new_path(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def storage(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes at its end whatever ``materialize`` wrote within it, but for tables whose names begin with one of ``keep``.

    What is kept belongs to the storage around this one, if there is any.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            if keep and path.rsplit("/", 1)[-1].startswith(keep):
                if _scopes:
                    _scopes[-1].append(path)
            else:
                remove_path(spark, path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, actions send at most n rows at once to Python: for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path:
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(df: DataFrame) -> int:
    """Size of what ``materialize`` wrote."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def is_small(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table has at most that many rows and bytes; only file sizes and row counts are read."""
    return stored_bytes(df) <= most_bytes and df.limit(most_rows + 1).count() <= most_rows


def few(df: DataFrame, most_rows: int) -> DataFrame:
    """A stored table with a broadcast hint if it is small, with a shuffle hint otherwise."""
    return F.broadcast(df) if is_small(df, most_rows) else df.hint("merge")


def local_table(spark: SparkSession, **columns: tuple[str, list]) -> DataFrame:
    """A small table of the driver's, by name: (type, values). It goes to Spark as one Arrow table, without Python workers."""
    fields = {n: to_arrow_type(T._parse_datatype_string(k)) for n, (k, _) in columns.items()}
    rows = pa.table({n: pa.array(v, fields[n]) for n, (_, v) in columns.items()})
    return spark.createDataFrame(rows, schema(**{n: k for n, (k, _) in columns.items()}))


_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_INVERSE = np.uint64(pow(int(_P1), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _powers_of(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = _powers[name] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and byte lengths of the words of a UTF-8 text, without a Python loop.

    A word's hash is a polynomial in random values of its bytes, taken as the
    difference of two prefix sums modulo 2**64 and brought back to its start.
    """
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_BLANK[b]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * _powers_of(_P1, "up", n), out=total[1:])
    length = ends - starts
    h = (total[ends] - total[starts]) * _powers_of(_INVERSE, "down", n)[starts]
    return mix(h + length.astype(np.uint64) * _P2), length


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    b = b * _P2
    return (a ^ (b << np.uint64(31) | b >> np.uint64(33))) * _P1


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of all windows of k words; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out, width, block, size = None, 0, h, 1
    while True:  # windows of 1, 2, 4 ... words, joined as the binary digits of k ask
        if k & size:
            part = block[width : width + n]
            out, width = (part if out is None else _join(out, part)), width + size
        if 2 * size > k:
            return mix(out + np.uint64(k))
        block, size = _join(block[:-size], block[size:]), 2 * size


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles of a word sequence; a shorter sequence is one shingle, an empty one none."""
    if len(h) == 0:
        return h
    return np.unique(window_hashes(h, min(k, len(h))))


def schema(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()])


def by(*keys: str, order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)
