"""Archives read in splits, against a sequential reader."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from tidewheel.llm import warc


def record(i: int, block: bytes, kind: str = "resource", more: str = "") -> bytes:
    return f"WARC/1.{i % 2}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:r:{i}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def sequential(raw: bytes) -> list[tuple]:
    out, at = [], 0
    while at < len(raw):
        start = raw.index(b"\r\n\r\n", at) + 4
        head = dict(line.split(b": ", 1) for line in raw[at : start - 4].split(b"\r\n")[1:])
        stop = start + int(head[b"Content-Length"])
        assert raw[stop : stop + 4] == b"\r\n\r\n"
        out.append((at, head[b"WARC-Record-ID"].decode().strip("<>"), hashlib.sha1(raw[start:stop]).hexdigest(), stop - start, raw[start:stop]))
        at = stop + 4
    return out


def archive(seed: int, n: int) -> bytes:
    """Records whose blocks hold whole records, marks, blank lines, bytes that are no text, or nothing."""
    rng = random.Random(seed)
    inner = record(900, b"hi")
    odd = [b"", b"\r\n", b"\r\n\r\n", b"WARC/1.1", b"WARC/1.1\r\n", b"\nWARC/1.", b"\n\nWARC/1.0\r\n", inner, b"\r\n\r\n" + inner, inner + inner, b"\xff\xfe\x00", b"prose ", record(901, inner + b"\n" + inner), b"\r\n\r"]
    return b"".join(record(i, b"".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))) for i in range(n))


def rows(spark, path) -> list[tuple]:
    got = warc.read_archives(spark, str(path)).collect()
    assert all(r.record_type == "resource" for r in got)
    return sorted((r.file.rsplit("/", 1)[-1], r.at, r.record_id, r.payload_digest, r.payload_bytes, bytes(r.payload)) for r in got)


@pytest.mark.parametrize("split", [None, 199, 600])
def test_splits(spark, tmp_path, split, monkeypatch):
    if split:
        monkeypatch.setattr(warc, "SPAN_BIN", 300)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        files = {f"f{i}.warc": archive(i, 25 if split is None else split // 40) for i in range(2)}
        for name, raw in files.items():
            (tmp_path / name).write_bytes(raw)
        want = sorted((name, *r) for name, raw in files.items() for r in sequential(raw))
        assert rows(spark, tmp_path) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gzip(spark, tmp_path):
    raw = archive(5, 30)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(raw[at : at + 400]) for at in range(0, len(raw), 400)))
    assert rows(spark, tmp_path) == sorted((name, *r) for name in ("one.warc.gz", "each.warc.gz") for r in sequential(raw))


def test_damage(spark, tmp_path):
    """A record that is cut off goes with what follows it; those before stay."""
    good = record(0, b"a") + record(2, record(7, b"b"))
    (tmp_path / "cut.warc").write_bytes(good + record(4, b"c" * 50)[:-20])
    (tmp_path / "bad.warc").write_bytes(good + b"WARC/1.1\r\nno header\r\n\r\nx\r\n\r\n" + record(6, b"d"))
    (tmp_path / "other.warc").write_bytes(b"no archive\n" + good)
    (tmp_path / "empty.warc").write_bytes(b"")
    got = [(f, i) for f, _, i, *_ in rows(spark, tmp_path)]
    assert sorted(got) == sorted((f, i) for f in ("cut.warc", "bad.warc") for i in ("urn:r:0", "urn:r:2"))


def test_large_payload(spark, tmp_path):
    block = b"".join(b"line %d\nWARC/1.1\r\n" % i for i in range(30_000)) + b"x" * 3_000_000
    raw = record(0, block) + record(2, b"")
    (tmp_path / "large.warc").write_bytes(raw)
    assert rows(spark, tmp_path) == [("large.warc", *r) for r in sequential(raw)]
