"""Benchmark decontamination by spaced-seed hashing.

Words are compared lower-cased and without the characters of ``PUNCTUATION``. A mask says which positions of a window
of words are hashed and which are ignored, so a substituted word at an ignored position leaves the hash alone. Hashes
of all windows of the benchmark items and of the texts are joined; around every hit the item is laid over the text, and it
is a leak if ``MIN_OVERLAP`` consecutive words of the item (all, if it has fewer) agree with the text in a share of at
least ``SIMILARITY``. Every placement of up to two substitutions in that many words leaves a seed of some mask whole.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_WORDS`` words (one item may exceed it), each
block is broadcast and meets all texts. If there are several blocks, what one finds is written to the shared folder before the next one is
broadcast, so memory is bounded at any size of either table. A seed that occurs very often in a text and in an item gives
every distinct shift of the two once, not every pair of its places.

Cases: null and empty texts and items have no seeds and never match; an item of one to four words matches only as a whole; repeated items are
found under each of their ids, repeated text rows give repeated results; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table, unused_name, words

MASKS = ("111101", "110111", "11000111")
#: Masks of items of fewer than SHORT words. Those of five to seven words may have one substitution, shorter ones none.
SHORT_MASKS, SHORT = ("1", "11"), 8
MIN_OVERLAP, SIMILARITY, BLOCK_WORDS, CHUNK_WORDS = 10, 0.8, 400_000, 1 << 20
PUNCTUATION = ".,;:!?\"()"
TABLE_BITS = 22
#: Pairs of equal seeds that are listed at once, and pairs of one seed in one text from which they are shifted as bits.
MOST_PAIRS, MANY_PAIRS = 1 << 20, 1 << 12
ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(16)], np.uint64)


def word_hashes(text: Column) -> Column:
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.transform(words(plain), lambda w: F.xxhash64(w))


def seeds(flat: np.ndarray, number: int) -> np.ndarray:
    """The hash of the masked window that begins at each word; the last windows are left out."""
    mask = (MASKS + SHORT_MASKS)[number]
    n = max(0, len(flat) - len(mask) + 1)
    out = np.full(n, number, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out += flat[i : i + n] * ODD[i]
    return (out ^ (out >> np.uint64(29))) * ODD[3]


def masks_of(words: int) -> list[int]:
    """The masks of an item of so many words. Whichever of five to seven words is substituted, two neighbours stay; fewer words must all agree."""
    if words >= SHORT:
        return list(range(len(MASKS)))
    return [len(MASKS) + (0 if words == 1 else 1)]


class Block:
    """The seeds of some benchmark items: hash, item and position, in order of hash."""

    def __init__(self, items: list[tuple[list[int], np.ndarray]]):
        self.ids, self.items = [x[0] for x in items], [x[1] for x in items]
        parts = [(seeds(w, m), i, m) for i, w in enumerate(self.items) for m in masks_of(len(w))]
        self.masks = sorted({m for *_, m in parts})
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, *_ in parts)])
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(x), i) for x, i, _ in parts)])[order].astype(np.int64)
        self.at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x, *_ in parts)])[order].astype(np.int64)
        self.known = np.zeros(1 << TABLE_BITS, bool)  # of fixed size: most windows need no search
        self.known[self.hash >> np.uint64(64 - TABLE_BITS)] = True

    def candidates(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, the places in the text where the item may begin, ascending and once each); ends: those of the texts in flat."""
        begins, listed, shifted = np.concatenate([[0], ends[:-1]]), [np.zeros((3, 0), np.int64)], {}
        for m in self.masks:
            width = len((MASKS + SHORT_MASKS)[m])
            h = seeds(flat, m)
            at = np.flatnonzero(self.known[h >> np.uint64(64 - TABLE_BITS)])
            low, high = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            text = np.searchsorted(ends, at, "right")
            hit = (high > low) & (at + width <= ends[np.minimum(text, len(ends) - 1)])  # not over the seam of two texts
            order = np.flatnonzero(hit)[np.lexsort((low[hit], text[hit]))]
            text, at, low, n = text[order], at[order], low[order], (high - low)[order]
            first = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(low, prepend=-1))  # of each seed of each text
            times = np.diff(np.append(first, len(text)))
            many = times * n[first] > MANY_PAIRS
            for i, k in zip(first[many], times[many]):
                places = at[i : i + k] - begins[text[i]]
                entries = np.arange(low[i], low[i] + n[i])
                entries = entries[np.argsort(self.item[entries], kind="stable")]
                for own in np.split(entries, np.flatnonzero(np.diff(self.item[entries])) + 1):
                    shifted.setdefault((int(text[i]), int(self.item[own[0]])), []).append((places, self.at[own]))
            few = ~np.repeat(many, times)
            text, at, low, n = text[few], at[few], low[few], n[few]
            stops = np.searchsorted(np.cumsum(n), np.arange(MOST_PAIRS, n.sum() + MOST_PAIRS, MOST_PAIRS))
            for a, b in zip(np.append(0, stops[:-1] + 1), np.minimum(stops + 1, len(n))):
                which = np.repeat(low[a:b] - np.cumsum(n[a:b]) + n[a:b], n[a:b]) + np.arange(n[a:b].sum())
                of = np.repeat(text[a:b], n[a:b])
                listed.append(distinct_columns(np.stack([of, self.item[which], np.repeat(at[a:b], n[a:b]) - self.at[which] - begins[of]])))
        text, item, start = distinct_columns(np.concatenate(listed, 1))
        first = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(item, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(text))):
            more = shifted.pop((int(text[a]), int(item[a])), [])
            yield int(text[a]), int(item[a]), np.unique(np.concatenate([start[a:b], *(shifts(*x) for x in more)])) if more else start[a:b]
        for (i, k), more in shifted.items():
            yield i, k, np.unique(np.concatenate([shifts(*x) for x in more]))

    def overlap(self, text: np.ndarray, start: int, item: int) -> tuple[int, int, int] | None:
        """First word, end and agreeing words of the overlap of the text with the item laid at start, if it is a leak."""
        w = self.items[item]
        low, high = max(0, start), min(len(text), start + len(w))
        span = min(MIN_OVERLAP, len(w))
        if high - low < span:
            return None
        same = text[low:high] == w[low - start : high - start]
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[span:] - sums[:-span] >= SIMILARITY * span)
        if not len(good):
            return None
        hits = np.flatnonzero(same[good[0] : good[-1] + span]) + good[0]
        return low + int(hits[0]), low + int(hits[-1]) + 1, len(hits)

    def leaks(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, agreeing words): per text and item the overlap with the most agreeing words, the first of such."""
        if not texts:
            return
        for i, item, starts in self.candidates(np.concatenate(texts), np.cumsum([len(t) for t in texts])):
            best = None
            for start in starts.tolist():
                o = self.overlap(texts[i], start, item)
                if o and (best is None or o[2] > best[2]):
                    best = o
                    if o[2] == len(self.items[item]):
                        break
            if best:
                yield i, item, *best


def distinct_columns(x: np.ndarray) -> np.ndarray:
    """The columns, each once, in order."""
    x = x[:, np.lexsort(x[::-1])]
    return x[:, np.append(True, np.diff(x, axis=1).any(0))[: x.shape[1]]]


def shifts(places: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The distinct differences of two sets of places: the first as the bits of a number, which is shifted by each of the second."""
    bits, most = np.zeros(int(places.max()) + 1, bool), int(own.max())
    bits[places] = True
    number, out = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"), 0
    for x in own.tolist():
        out |= number << (most - x)
    return np.flatnonzero(np.unpackbits(np.frombuffer(out.to_bytes(-(-out.bit_length() // 8), "little"), np.uint8), bitorder="little")) - most


def leaks_of(block: Block, lists: pa.ListArray) -> Iterator[tuple[int, int, int, int, int]]:
    """Block.leaks() of an array of lists of hashes, some at a time."""
    flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    first = 0
    while first < len(lists):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_WORDS, "right")) - 1)
        for i, *found in block.leaks([flat[ends[k] : ends[k + 1]] for k in range(first, last)]):
            yield first + i, *found
        first = last


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items are read a partition at a time; one block is in memory at once."""
    rows, n = {}, 0
    for item_id, h in benchmark.select("item_id", word_hashes(F.col("text"))).toLocalIterator():
        w = np.array(h, np.int64).view(np.uint64)
        if not len(w):
            continue
        rows.setdefault(w.tobytes(), ([], w))[0].append(item_id)
        n += len(w)
        if n >= block_words:
            yield Block(list(rows.values()))
            rows, n = {}, 0
    if rows:
        yield Block(list(rows.values()))


def in_turn(rows: DataFrame, benchmark: DataFrame, block_words: int, scan: Callable[[DataFrame, Broadcast], DataFrame], chained: bool) -> list[DataFrame]:
    """scan(rows, block) for every block; chained: of what the scan before it left. A second block is broadcast only when the first
    one's result is written."""
    context, found = rows.sparkSession.sparkContext, blocks(benchmark, block_words)
    first, second = next(found, None), next(found, None)
    if second is None:
        return [scan(rows, context.broadcast(first))] if first else []
    out, folder = [], f"{shared_folder(rows.sparkSession)}/blocks-{uuid.uuid4().hex}"
    for i, block in enumerate(chain([first, second], found)):
        shared = context.broadcast(block)
        scan(out[-1] if chained and out else rows, shared).write.parquet(f"{folder}/{i}")
        shared.destroy()
        out.append(rows.sparkSession.read.parquet(f"{folder}/{i}"))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start, end (words of the text, end exclusive), n_match and similarity of every leak."""
    schema = "doc_id long, item_id long, start long, `end` long, n_match long"

    def scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[i], item_id, *where) for i, item, *where in leaks_of(block, batch.column(1)) for item_id in block.ids[item]]
                yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], ["doc_id", "item_id", "start", "end", "n_match"])

        return rows.mapInArrow(run, schema)

    found = in_turn(docs.select(F.col("doc_id").cast("long"), word_hashes(F.col("text")).alias("h")), benchmark, block_words, scan, False)
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("similarity", F.col("n_match") / (F.col("end") - F.col("start")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without a leak, in the columns of docs; a row is judged by its text alone, as it passes, whatever its id."""
    schema, hashes = docs.schema, unused_name(docs, "words")

    def scan(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, *_ in leaks_of(block, batch.columns[-1])]] = False
                yield batch.select(range(batch.num_columns - 1)).filter(pa.array(clean))

        return rows.select("*", word_hashes(F.col("text")).alias(hashes)).mapInArrow(run, schema)

    return (in_turn(docs, benchmark, block_words, scan, True) or [docs])[-1]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_benchmark_decontamination": op1_benchmark_decontamination}
ORACLES: dict[str, str] = {}
