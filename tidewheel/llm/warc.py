"""WARC archives: write records with Spark's text writer, read them back by boundary-chain verification.

Writing: one record for each row. Of rows with equal payloads of at least
``min_revisit`` bytes the one with the largest id is a response and the others
revisit it. Records end with a blank line, which is the writer's line
separator, so files go to whatever storage Spark writes to; a file holds at
most ``RECORDS_PER_FILE`` records.

Reading: files of any size are read in splits, and the version line's mark
cuts them into pieces, so no task needs a whole file; a file compressed with
gzip, in one member or a member for each record, is one split and read as a
stream. A payload may hold text that looks like a record. Tasks emit every
candidate, a piece whose header parses, with its offset and that of its
successor; its block must lead to a blank line, in the same piece or where a
later one ends. Pointer jumping from each file's start then marks what can be
reached, doubling the jumps each round; everything else is text inside a
payload and is dropped. Records whose blocks hold marks are put together from
their pieces afterwards.

Defined cases: a null payload is empty; a null URL gives a record without
target; a null id is never the largest unless all ids of the payload are null,
and reads back as null; rows that repeat both the largest id and the payload
are all responses; an empty table gives no archives and an empty result;
further columns are ignored. A piece, and a record put together, must be below
2 GB. Offsets in compressed files count what they hold. What follows a record
that is cut off or damaged in a file is unreachable and left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewheel.llm import common

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000
RECORDS_PER_FILE = 1024
#: Digests of repeated payloads that may be sent to all tasks; more than these are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Every record but a file's first follows a line break; no beginning of this mark recurs within it, so readers of lines find it across their buffers.
_MARK = b"\nWARC/1."
#: Pieces that a Python worker gets at once, as they may be long.
PIECES_AT_ONCE = 256
#: Bytes of a stretch by which pieces meet the record that spans them.
SPAN_BIN = 16 << 20

def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    first = rows.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("digest").alias("d"), "first")
    first = common.materialize(first, "warc-repeats")
    if is_few := common.is_small(first, BROADCAST_ROWS):
        first = F.broadcast(first)
    rows = rows.join(first if is_few else first.hint("merge"), F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))

    def named(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit(f"{VERSION}\r\n"),
        named("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        named("WARC-Record-ID", urn(F.col("id"))),
        named("WARC-Date", F.lit(date)),
        F.coalesce(named("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")), F.lit("")),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        named("X-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(named("WARC-Refers-To", urn(F.col("first"))), named("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        named("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    rows = rows.withColumn("block", block)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    common.release(first)


def parse_head(piece: bytes) -> dict | None:
    """The header at the beginning of a piece, with the offset and length of its block; None if it does not parse."""
    end = piece.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"WARC/1\.[01]\r\n", piece):
        return None
    head: dict[str, str] = {}
    for line in piece[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[A-Za-z][A-Za-z0-9-]*", name):
            return None
        head[name.decode().lower()] = value.strip(b" \t").decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or not {"warc-type", "warc-record-id"} <= head.keys():
        return None
    return head | {"start": end + 4, "length": int(length)}


def _payload(block: bytes, content_type: str | None) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if (content_type or "").startswith("application/http") else block


_HEADER = {"record_type": "string", "record_id": "string", "refers_to": "string", "target_uri": "string", "payload_digest": "string", "payload_bytes": "bigint", "content_type": "string"}
_PIECE = {"file": "string", "split": "bigint", "start": "bigint", "size": "bigint", "ends": "bigint", "body": "bigint", "next": "bigint", "inside": "boolean", **_HEADER, "payload": "binary", "raw": "binary"}


def _pieces(spark: SparkSession, path: str, with_payload: bool = False, with_raw: bool = False) -> DataFrame:
    """The pieces between marks, one row each, from splits of files; a compressed file is one split.

    start: bytes of the split before the piece. ends: bytes of the piece up to a blank line that ends it, else null.
    Of a piece that begins with a header: body and next, where its block begins and the next record is due, counted
    from the piece, and inside, whether all of it lies in the piece.
    """
    out = common.schema(**_PIECE)
    columns = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            rows = []
            for file, block, content in zip(*batch.columns, strict=True):
                file, block, content = file.as_py(), block.as_py(), content.as_py()
                if (file, block) != split:  # a split's pieces come one after another
                    split, at = (file, block), 0
                raw = content if at == 0 and block == 0 else _MARK[1:] + content
                ends = len(raw) + 1 if raw.endswith(b"\r\n\r") else len(raw) if raw.endswith(b"\r\n\r\n") else None
                whole = raw + b"\n"  # the mark's line break belongs to the piece before it
                head = parse_head(whole)
                row = [file, block, at, len(content), ends]
                if head:
                    stop = head["start"] + head["length"]
                    inside = whole[stop : stop + 4] == b"\r\n\r\n"
                    kind, payload, digest, n = head.get("content-type"), None, None, None
                    if head["warc-type"] == "revisit":  # the payload is elsewhere; the header says what it was
                        n = head.get("x-payload-length", "0")
                        digest, n = head.get("warc-payload-digest", "").removeprefix("sha1:"), int(n) if n.isascii() and n.isdigit() else 0
                    if inside:
                        payload = _payload(whole[head["start"] : stop], kind)
                        if digest is None:
                            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    row += [head["start"], stop + 4, inside, head["warc-type"], head["warc-record-id"].strip("<>"), head.get("warc-refers-to", "").strip("<>") or None, head.get("warc-target-uri"), digest, n, kind, payload if with_payload else None]
                else:
                    row += [None] * 11
                rows.append([*row, whole if with_raw else None])
                at += len(content) + len(_MARK)
            if rows:
                yield pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(_PIECE)}, schema=columns)

    lines = spark.read.schema("value string").option("lineSep", _MARK.decode()).text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary")).mapInArrow(read, out)


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at) of what can be reached from each file's start; chain has file, at, next.

    Each round a row's jump is followed by the jump of the row where it ends,
    so after k rounds it spans 2**k records, and what marked rows jump to
    gets marked. A jump that ends at no candidate stays where it is.
    """
    state = common.materialize(chain.select("file", "at", "next", (F.col("at") == 0).alias("marked")), "warc-chain")
    marked = state.where("marked").count()
    while True:
        on = state.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        hit = state.where("marked").select("file", F.col("next").alias("at")).distinct().withColumn("hit", F.lit(True))
        step = state.join(on, ["file", "next"], "left").join(hit, ["file", "at"], "left")
        step = step.select("file", "at", F.coalesce("further", "next").alias("next"), (F.col("marked") | F.col("hit").isNotNull()).alias("marked"))
        after = common.materialize(step, "warc-chain")
        common.release(state)
        state, before = after, marked
        marked = state.where("marked").count()
        if marked == before:
            return state.where("marked").select("file", "at")


def _based(pieces: DataFrame, base: DataFrame) -> DataFrame:
    """at: a piece's offset in its file; but for the first it begins within the mark, behind the line break."""
    placed = pieces.join(F.broadcast(base) if common.is_small(base, BROADCAST_ROWS) else base, ["file", "split"])
    place = F.col("base") + F.col("start")
    return placed.withColumn("at", F.when(place == 0, place).otherwise(place - (len(_MARK) - 1))).drop("base", "start")


_JOINED = {"file": "string", "at": "bigint", "payload_digest": "string", "payload_bytes": "bigint", "payload": "binary"}


def _joined(rows: pa.Table) -> pa.Table:
    """A record that spans pieces: its payload, digest and bytes from all of them, in order."""
    rows = rows.sort_by("at")
    whole = b"".join(rows.column("raw").to_pylist())
    first = {name: rows.column(name)[0].as_py() for name in ("file", "record", "body", "next", "record_type", "content_type", "payload_digest", "payload_bytes")}
    payload = _payload(whole[first["body"] : first["next"] - 4], first["content_type"])
    digest, n = first["payload_digest"], first["payload_bytes"]
    if first["record_type"] != "revisit":
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return pa.table({"file": [first["file"]], "at": [first["record"]], "payload_digest": [digest], "payload_bytes": [n], "payload": pa.array([payload], pa.binary())})


def _spanning(spark: SparkSession, path: str, base: DataFrame, wide: DataFrame, with_payload: bool) -> DataFrame:
    """What ``_joined`` finds for records (wide) that hold marks in their blocks. Pieces and records meet by stretches of the file."""
    bins = F.explode(F.sequence(F.floor(F.col("at") / SPAN_BIN), F.floor((F.col("at") + F.col("next") - 1) / SPAN_BIN)))
    wide = wide.select("file", F.col("at").alias("record"), (F.col("at") + F.col("next")).alias("until"), "body", "next", "record_type", "content_type", "payload_digest", "payload_bytes", bins.alias("bin"))
    with_raw = _based(_pieces(spark, path, with_raw=True).select("file", "split", "start", "raw"), base).withColumn("bin", F.floor(F.col("at") / SPAN_BIN))
    parts = with_raw.join(wide, ["file", "bin"]).where((F.col("at") >= F.col("record")) & (F.col("at") < F.col("until")))
    out = parts.groupBy("file", "record").applyInArrow(_joined, common.schema(**_JOINED))
    return out if with_payload else out.drop("payload")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record: file, at, record_type, record_id, refers_to, target_uri, payload_digest, payload_bytes, payload.

    Digest and bytes of a response are those of the payload read, of a revisit those in its header.
    """
    columns = ["file", "at", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes"]
    with common.storage(spark, "warc-candidates", "warc-base", "warc-kept", "warc-spans"):
        with common.arrow_rows(spark, PIECES_AT_ONCE):
            pieces = common.materialize(_pieces(spark, path).drop("payload", "raw"), "warc-pieces")
        total = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + len(_MARK)).alias("bytes"))
        before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
        base = common.materialize(total.select("file", "split", F.coalesce(before, F.lit(0)).alias("base")), "warc-base")
        placed = _based(pieces, base)
        found = placed.where("record_type is not null")
        # A block that reaches beyond its piece must end where a piece ends with a blank line.
        ends = placed.where("ends is not null").select("file", (F.col("at") + F.col("ends")).alias("end"))
        wide = found.where("not inside").withColumn("end", F.col("at") + F.col("next")).join(ends, ["file", "end"], "left_semi").select(*found.columns)
        found = common.materialize(found.where("inside").unionByName(wide), "warc-candidates")
        kept = common.materialize(reachable(found.select("file", "at", (F.col("at") + F.col("next")).alias("next"))), "warc-kept")
        found = found.join(kept, ["file", "at"], "left_semi")
        wide = found.where("not inside")
        if wide.isEmpty():
            spans = None
        else:
            with common.arrow_rows(spark, PIECES_AT_ONCE):
                spans = common.materialize(_spanning(spark, path, base, wide, with_payload), "warc-spans")
    out = found.where("inside").select(*columns)
    if with_payload:
        texts = _based(_pieces(spark, path, with_payload=True).where("inside").select("file", "split", "start", "payload"), base)
        out = out.join(texts.select("file", "at", "payload"), ["file", "at"])
    if spans is not None:
        own = [c for c in columns if c not in spans.columns or c in ("file", "at")]
        out = out.unionByName(wide.select(*own).join(spans, ["file", "at"]))
    return out


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    write_archives(common.table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path, with_payload=False)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_OP7 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), l AS (
  SELECT payload_digest, max(page_id) AS leader FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN leader END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""
