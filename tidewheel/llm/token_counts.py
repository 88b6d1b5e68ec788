"""Token counts: Arrow batches go to the tokenizer's batch encoder and only lengths come back.

A text is cut at safe boundaries, places at which the tokenizer never joins
the two sides. For a tokenizer that drops white space before it merges, every
run of ASCII blanks is one, so the pieces are words; each distinct word is
encoded once per worker and remembered, and unknown words go to the encoder
in batches balanced by bytes. For byte-level tokenizers that keep spaces, the
boundary is before a single space between two ASCII letters; for sentencepiece
models none is known, so whole texts are encoded. No text is shortened.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted each; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common

#: Bytes of text that go to the encoder at once, and bytes of a piece of a long text.
BATCH_BYTES = 1 << 20
PIECE_BYTES = 1 << 16
CACHE_PIECES = 400_000
TOKEN_LIMIT = 2048

_SPACED = re.compile(rb"(?<=[A-Za-z])(?= [A-Za-z])")


def blanks_are_safe(spec: dict) -> bool:
    """Whether this tokenizer file cuts at every ASCII blank and lets no rule cross one."""

    def flat(part: dict | None, key: str) -> list[dict]:
        return [] if part is None else part[key] if part["type"] == "Sequence" else [part]

    first = (flat(spec["pre_tokenizer"], "pretokenizers") or [{"type": ""}])[0]
    normal = all(n["type"] in ("NFC", "NFD", "Lowercase", "Replace") for n in flat(spec["normalizer"], "normalizers"))
    split = first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or (
        first["type"] == "Split" and first.get("invert") and first["behavior"] == "Removed" and first["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    )
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return bool(split and normal and plain and spec["post_processor"] is None)


@functools.lru_cache(maxsize=4)
def _json_tokenizer(content: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content.decode())
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def _piece_model(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def by_bytes(pieces: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive batches of about equal bytes."""
    batch, n = [], 0
    for p in pieces:
        if batch and n + len(p) > most:
            yield batch
            batch, n = [], 0
        batch.append(p)
        n += len(p)
    if batch:
        yield batch


class Counter:
    """Counts tokens of UTF-8 texts with one tokenizer."""

    def __init__(self, name: str, content: bytes, batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> None:
        self.batch_bytes, self.piece_bytes = batch_bytes, piece_bytes
        self.known: dict[bytes, int] = {}
        self.kind = "piece" if name.endswith(".model") else "words" if blanks_are_safe(json.loads(content)) else "spaced"
        self.model = _piece_model(content) if self.kind == "piece" else _json_tokenizer(content)

    def lengths(self, pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        for batch in by_bytes(pieces, self.batch_bytes):
            texts = [p.decode() for p in batch]
            if self.kind == "piece":
                out += [len(x) for x in self.model.encode(texts, num_threads=1)]
            else:
                out += [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        return out

    def cut(self, text: bytes) -> list[bytes]:
        """Pieces of one text whose token counts add up to the text's."""
        if self.kind == "words":
            return text.split()
        if self.kind == "piece" or len(text) <= self.piece_bytes:
            return [text]
        pieces, start = [], 0
        for m in _SPACED.finditer(text):
            if m.start() - start >= self.piece_bytes:
                pieces.append(text[start : m.start()])
                start = m.start()
        return [*pieces, text[start:]]

    def counts(self, texts: list[bytes]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        if self.kind != "words":
            all_lengths = iter(self.lengths([p for pieces in cut for p in pieces]))
            return [sum(next(all_lengths) for _ in pieces) for pieces in cut]
        known = self.known
        new = list({w for pieces in cut for w in pieces if w not in known})
        if new:
            if len(known) > CACHE_PIECES:
                known.clear()
                new = list({w for pieces in cut for w in pieces})
            known.update(zip(new, self.lengths(new), strict=True))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


_counters: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, for the tokenizer file at the path ``tokenizer``.

    The file's content goes to the executors, which need not see its path;
    it is as large as the vocabulary, a few MB.
    """
    with open(tokenizer, "rb") as f:
        raw = f.read()
    content = docs.sparkSession.sparkContext.broadcast(raw)
    key = (os.path.basename(tokenizer), hashlib.sha256(raw).hexdigest(), batch_bytes, piece_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(key)
        if counter is None:
            counter = _counters[key] = Counter(key[0], content.value, batch_bytes, piece_bytes)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n_bytes, n_tokens, group, held = [], [], [], 0
            for x in texts:
                text = x.as_py() or b""
                n_bytes.append(len(text))
                group.append(text)
                held += len(text)
                if held >= batch_bytes:
                    n_tokens += counter.counts(group)
                    group, held = [], 0
            n_tokens += counter.counts(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = common.schema(id=narrow.schema["id"].dataType.simpleString(), n_bytes="bigint", n_tokens="bigint")
    return narrow.mapInArrow(count, out).withColumnRenamed("id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
