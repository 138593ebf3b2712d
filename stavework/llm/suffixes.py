"""Removal of long byte strings that occur twice or more, by prefix doubling that Spark sorts.

A position is ranked by the ``LENGTH`` bytes that start there, and is repeated if its rank is not its own alone. Ranks come from
doubling: at first by the fingerprint of ``first`` bytes (half of ``LENGTH``), then by pairs of the rank at a position and the rank at an offset
that grows with what is covered, until ``LENGTH`` is passed. Spark counts the pairs, sorts those that occur again and numbers
them; positions whose pair is unique drop out at every round.

Most positions drop out before the first pair is made. The least fingerprint among all strings of ``anchor`` bytes (five eighths) within a
position's ``LENGTH`` bytes is its anchor. Equal strings have equal anchors, so a position whose anchor occurs once is unique.
Neighbouring positions with one anchor are a stretch; where all stretches of an anchor are equal they are repeated as a whole, and of
equal stretches one alone is doubled. What is left is in proportion to the number of ends of repeats, not to the text.

Fingerprints have 64 bits; strings are taken as equal if two fingerprints agree, those of an anchor and its stretch or of
both halves of a string. All joins and counts are on such keys, so that Spark spreads them; a passage that a third of all texts share is
counted before it is shuffled, and its join may be split.

Cases: a null or empty text has no bytes; a text shorter than ``LENGTH`` keeps all; of equal texts of that length none keeps
a byte; rows without an id and rows of one id are judged by their own text; an empty table gives an empty table; further columns of any
name are ignored. Texts are cut into pieces of ``PIECE`` positions for the search of anchors only; no match ends there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, row_key, shuffles_removed, spread_join, strings, table

LENGTH, PIECE, PLACE_BITS = 200, 1 << 20, 24
#: A place in a text, the positions of its stretch before it, and all positions of it are one number; LENGTH is below PACK.
PACK = 1 << 12
_RANDOM = np.random.default_rng(12)
BYTES, BASE = _RANDOM.integers(0, 1 << 64, 256, np.uint64), int(_RANDOM.integers(0, 1 << 62)) * 4 + 3
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0 to n and to the power 0 to -n, modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
    return _POWERS[size]


class Fingerprints:
    """Fingerprints of any part of some bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * self.up[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def of_length(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def stretches(data: np.ndarray, starts: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of ascending starts of strings of that length in data: anchors' fingerprints, stretches' fingerprints, anchors' places, stretches' first starts and numbers of starts."""
    prints, bits = Fingerprints(data), np.uint64(PLACE_BITS)  # the same for all pieces, or equal strings could have unequal anchors
    h = prints.of_length(anchor)
    place = least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)[starts] & ((np.uint64(1) << bits) - np.uint64(1))
    place = place.astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    n = np.diff(first, append=len(place))
    a, at = starts[first], place[first]
    return h[at], prints.of(a, a + n + length - 1), at, a, n


def pieces(rows: Iterable[tuple[int, bytes]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts or parts of texts: bytes, starts in them, and for each part its end, its text's number and its place in the text."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        starts = np.ones(len(data), bool)
        for e in ends:
            starts[e - length + 1 : e] = False
        return data, np.flatnonzero(starts), ends, np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])

    for i, text in rows:
        for o in range(0, len(text) - length + 1, PIECE):
            held.append((i, o, text[o : o + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def anchored(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """(k, u, h1, h2, at): the fingerprints of anchor and stretch, the text's key, and the packed place."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for data, starts, ends, text, place in pieces(((i, t.encode()) for i, t in enumerate(strings(b.column(2)))), length):
                k, u, at, a, n = stretches(data, starts, length, anchor)
                part = np.searchsorted(ends, a, "right")
                begin = np.concatenate([[0], ends[:-1]])[part]
                packed = ((at - begin + place[part]) * PACK + (at - a)) * PACK + n
                yield pa.record_batch([k.view(np.int64), u.view(np.int64), h1[text[part]], h2[text[part]], packed], ["k", "u", "h1", "h2", "at"])

    return texts.mapInArrow(rows, "k long, u long, h1 long, h2 long, at long")


def first_pairs(chosen: DataFrame, length: int, first: int, step: int) -> DataFrame:
    """(id, x, r1, r2): of the stretches (ids, ats) of a text, the fingerprints at every position x of a stretch and a step after it."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, ids, ats in zip(strings(b.column(0)), b.column(1), b.column(2), strict=True):
                data = text.encode()
                for lo in range(0, len(ids), 4096):
                    at = ats.values[lo : lo + 4096].to_numpy()
                    n, a = at % PACK, at // PACK // PACK - at // PACK % PACK
                    prints = Fingerprints(np.frombuffer(b"".join(data[i : i + m + length - 1] for i, m in zip(a.tolist(), n.tolist(), strict=True)), np.uint8)).of_length(first)
                    sizes, many = n + length - 1, n + length - first - step
                    x = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    here = x + np.repeat(np.cumsum(sizes) - sizes, many)
                    yield pa.record_batch([np.repeat(ids.values[lo : lo + 4096].to_numpy(), many), x, prints[here].view(np.int64), prints[here + step].view(np.int64)], ["id", "x", "r1", "r2"])

    return chosen.mapInArrow(rows, "id long, x long, r1 long, r2 long")


def doubled(pairs: DataFrame, covered: int, length: int, scratch: Scratch) -> DataFrame:
    """(id, x) of the positions whose string of that length occurs again; pairs (id, x, r1, r2) tell strings of the covered length apart."""
    while True:
        again = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1")
        if covered >= length:
            return pairs.join(scratch.write(again), ["r1", "r2"]).select("id", "x")
        ranks = scratch.write(again.orderBy("r1", "r2").select("r1", "r2", F.monotonically_increasing_id().alias("rank")))
        kept = scratch.write(pairs.join(ranks, ["r1", "r2"]).select("id", "x", "rank"))
        step = min(covered, length - covered)
        pairs = scratch.write(kept.withColumnRenamed("rank", "r1").join(kept.select("id", (F.col("x") - step).alias("x"), F.col("rank").alias("r2")), ["id", "x"]))
        covered += step


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, first: int | None = None) -> DataFrame:
    """(h1, h2, spans): of each text that holds repeated strings, what they cover, as overlapping spans (start, end)."""
    anchor, first = anchor or length * 5 // 8, first or -(-length // 2)
    step = min(first, length - first)
    with shuffles_removed(docs.sparkSession), Scratch(docs.sparkSession) as scratch:
        texts = docs.select(*[c.alias(n) for c, n in zip(row_key(F.col("text")), ("h1", "h2"))], "text").filter(F.octet_length("text") >= length)
        places = anchored(texts, length, anchor)
        again = scratch.write(places.groupBy("k").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).filter("n > 1"))
        found = scratch.write(places.join(again, "k").select("k", "u", "h1", "h2", "at", F.expr("low = high").alias("alike")))
        classes = scratch.write(found.filter("not alike").groupBy("k", "u").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("h1", "h2", "at")]).withColumn("id", F.monotonically_increasing_id()))
        chosen = classes.groupBy("h1", "h2").agg(F.collect_list(F.struct("id", "at")).alias("s")).select("h1", "h2", F.col("s.id").alias("ids"), F.col("s.at").alias("ats"))
        pairs = scratch.write(first_pairs(texts.dropDuplicates(["h1", "h2"]).join(chosen, ["h1", "h2"]).select("text", "ids", "ats"), length, first, step))
        runs = doubled(pairs, first + step, length, scratch).groupBy("id").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        ends = F.expr(f"at div {PACK * PACK} - at div {PACK} % {PACK} as start"), F.expr(f"at div {PACK * PACK} - at div {PACK} % {PACK} + at % {PACK} + {length - 1} as end")
        whole = found.filter("alike").select("h1", "h2", *ends).union(spread_join(found.filter("not alike"), classes.filter("n > 1").select("k", "u"), ["k", "u"], F.col("h1")).select("h1", "h2", *ends))
        part = classes.filter("n = 1").select("id", "h1", "h2", ends[0]).join(runs, "id").select("h1", "h2", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high") + length).alias("end"))
        return checkpointed(whole.union(part).groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "end")).alias("spans")))


def maximal(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in order, with those that meet made one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], np.concatenate([reach[new[1:] - 1], reach[-1:]])], 1)


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int | None = None, first: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept): the removed spans of bytes of every text, and the bytes that stay."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, spans in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2), strict=True):
                data, runs = text.encode(), np.empty((0, 2), np.int64)
                if spans.is_valid:
                    runs = maximal(np.stack([spans.values.field(k).to_numpy() for k in (0, 1)], 1))
                ends = [0, *runs.ravel().tolist(), len(data)]
                out.append((doc_id, len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), runs.tolist(), b"".join(data[x:y] for x, y in zip(ends[::2], ends[1::2], strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], names)

    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()]
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [c.alias(n) for c, n in zip(row_key(F.col("text")), ("h1", "h2"))]
    marked = docs.select("doc_id", "text", *keys).join(repeated(docs, length, anchor, first), ["h1", "h2"], "left")
    return marked.select("doc_id", "text", "spans").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<array<long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_array_dedup": query}
ORACLES: dict[str, str] = {}
