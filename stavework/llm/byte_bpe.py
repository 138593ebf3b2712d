"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the tokenizer's pattern; each match is a piece that the library encodes alone. A worker
remembers the ids of the pieces it has met (at most ``cache_size``, then it starts anew), since words repeat.
Decoding looks every id up in the reversed byte table and joins the bytes, so a character whose bytes are
spread over several ids comes back whole; a cut inside a character is kept as bytes and replaced in ``text`` only.

Cases: a null text counts as empty and has no ids; repeated rows are encoded each on its own; an empty table
gives an empty table; further columns of the input are ignored, whatever their names; invalid ids raise.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table

CACHE_SIZE, ROWS = 500_000, 64


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed: printable Latin-1
    bytes stand for themselves, the others take the code points from 256 on in ascending order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes whole texts in one worker."""

    def __init__(self, ranks_path: str, pattern: str, cache_size: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives every task one core
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        to_char = {b: c for c, b in byte_characters().items()}
        shown = {token: "".join(map(to_char.__getitem__, token)) for token in ranks}
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        # Both halves of a token are the two parts that lower ranks alone make of it.
        merges = [tuple("".join(map(to_char.__getitem__, part)) for part in halves(token, rank, ranks)) for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1]
        self.tokenizer = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.n_bytes = np.array([len(x) for x in self.table], np.int64)
        self.cache: dict[str, tuple[list[int], str]] = {}
        self.cache_size = cache_size

    def pieces(self, text: str) -> list[tuple[list[int], str]]:
        """(ids, their decimal text) of every piece."""
        found, cache = self.split(text), self.cache
        fresh = [p for p in set(found) if p not in cache]
        if fresh:
            if len(cache) + len(fresh) > self.cache_size:
                cache.clear()
                fresh = list(set(found))
            for piece, encoding in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
                ids = encoding.ids
                cache[piece] = ids, " ".join(map(str, ids))
        return [cache[p] for p in found]

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.pieces(text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def offsets(self, ids: list[int], raw: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of every id: a byte belongs to the character whose first byte is the last at or before it.
        raw: the bytes of the ids, if they are known."""
        begins = np.frombuffer(self.decode(ids) if raw is None else raw, np.uint8) & 0xC0 != 0x80
        first = np.concatenate([[0], np.cumsum(begins)])
        sizes = self.n_bytes[np.array(ids, np.int64)]
        ends = np.cumsum(sizes)
        return first[np.minimum(ends - sizes + 1, len(begins))] - 1, first[ends]


@contextmanager
def without_gc() -> Iterator[None]:
    """A worker's caches make many objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of a token after all merges of a lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, and the first and end character of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        with without_gc():
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS):  # a few texts at a time, as ids and offsets take more room than they
                    rows = batch.slice(first, ROWS)
                    ids = [c.encode(text or "") for text in strings(rows.column(1))]
                    places = [c.offsets(x) for x in ids]
                    lists = [pa.array(ids, pa.list_(pa.int32())), *(pa.array([x[k] for x in places], pa.list_(pa.int64())) for k in (0, 1))]
                    yield pa.record_batch([rows.column(0), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes, text (bytes that are no UTF-8 are replaced in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            raw = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass, and offsets_crc32: that of the first
    and then the end characters of all ids, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        with without_gc():
            for batch in batches:
                out = [], [], [], []
                for text in strings(batch.column(1)):
                    pieces = c.pieces(text or "")
                    ids = [i for x, _ in pieces for i in x]
                    raw = c.decode(ids)
                    row = len(ids), hashlib.sha256(" ".join([x for _, x in pieces]).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), zlib.crc32(np.concatenate(c.offsets(ids, raw)).astype("<i8").tobytes())
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.record_batch([batch.column(0), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op4_byte_level_bpe": op4_byte_level_bpe}
ORACLES: dict[str, str] = {}
