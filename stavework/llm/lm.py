"""LM scoring with a log-frequency Bloom filter.

Tokens are a text's lower-cased words (A-Z) and one end. All training tokens and all pairs of neighbouring ones (an end stands
before a text) are counted. An n-gram of count c is kept as its level ``1 + floor(log(c) / log(BASE))``: it is put into a
Bloom filter once for every level up to its own, so asking level by level until the first miss gives the level back, and
with it the count to within a factor; false positives can only raise it. The filter is blocked: an n-gram's bits lie in
one segment, whose size is ``BITS_PER_ENTRY`` for each entry that it has, so all are filled alike. Spark tasks count and fill them a group at a
time; the number of groups grows with the corpus. At most ``SHARD_BYTES`` of the pairs' segments are broadcast at once, with those of single
tokens; what is more makes further shards, by the pair's key: each scores its own tokens in a pass over the texts, whose result is
written to the shared folder before the next one is broadcast.

A token's probability is its smoothed unigram share, interpolated by ``BIGRAM_WEIGHT`` with its share among what followed the token
before it, where that one is known.

Exact counts, for the base score: those of the head, the words of at least ``N / HEAD`` occurrences (at most ``HEAD`` of them), are
broadcast; tokens of other words meet the table of counts in a join, whose keys have fewer than ``N / HEAD`` rows each, so that none is hot.

Cases: a null or empty text is one end; every row is a text of its own, also where ids are null or repeated; without any
training text every count is 0 and N is 0; an empty table gives an empty table; further columns are ignored, whatever
their names. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, row_key, shared_folder, table, words

HEAD = 1_000_000
BASE, HASHES, BITS_PER_ENTRY, BIGRAM_WEIGHT = 1.6, 4, 10, 0.3
#: Text of a group of segments, segments of a group, and pairs that a task keeps until its end.
GROUP_BYTES, SEGMENTS, KEPT = 8 << 20, 16, 1 << 20
SHARD_BYTES, CHUNK = 128 << 20, 1 << 19
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
LOW32 = np.uint64(0xFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens; the end is hashed as a line feed, which no word holds."""
    return F.concat(F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit("\n"))))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def gram(word: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The key of a unigram or bigram."""
    return mix(word + MIX[0]) if before is None else mix(mix(before) * MIX[0] + word)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def middle_counts(levels: np.ndarray) -> np.ndarray:
    """About the mean of the counts of each level; nothing for level 0."""
    low, high = np.ceil(BASE ** (levels - 1.0) - 1e-9), np.ceil(BASE ** (levels * 1.0) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def halves(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a key at a level, from which all its places come."""
    a = mix(key + np.full(1, level, np.uint64) * MIX[0])
    return a, a >> np.uint64(32)


def place(a: np.ndarray, step: np.ndarray, number: int, bits: np.ndarray) -> np.ndarray:
    """The place by hash number so among so many bits of a segment (fewer than 2 ** 32)."""
    return (((a + np.uint64(number) * step) & LOW32) * bits >> np.uint64(32)).astype(np.int64)


def group_of(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def segment_of(key: np.ndarray, groups: int) -> np.ndarray:
    """The number of a key's segment among all; its group is that divided by SEGMENTS."""
    return group_of(key, groups) * SEGMENTS + ((key & LOW32) * np.uint64(SEGMENTS) >> np.uint64(32)).astype(np.int64)


def filled(key: np.ndarray, level: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a group's segments, and how many bits each has."""
    segment = segment_of(key, groups) % SEGMENTS
    bits = np.bincount(segment, level, SEGMENTS).astype(np.int64) * BITS_PER_ENTRY // 8 * 8 + 8
    begin, on = (np.cumsum(bits) - bits)[segment], np.zeros(bits.sum(), bool)
    for x in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level >= x)
        own, first, of = halves(key[at], x), begin[at], bits[segment[at]].astype(np.uint64)
        for i in range(HASHES):
            on[first + place(*own, i, of)] = True
    return np.packbits(on, bitorder="little"), bits


class Filter:
    """Some groups of segments; keys of other groups have level 0."""

    def __init__(self, groups: int, numbers: list[int], data: list[np.ndarray], bits: list[np.ndarray]):
        self.groups, self.data = groups, np.concatenate([*data, np.zeros(1, np.uint8)])  # the last byte is for groups that are not here
        self.bits, self.begin = np.ones(groups * SEGMENTS, np.uint64), np.full(groups * SEGMENTS, 8 * (len(self.data) - 1), np.int64)
        at = 0
        for number, own in zip(numbers, bits):
            where = slice(number * SEGMENTS, (number + 1) * SEGMENTS)
            self.bits[where], self.begin[where] = own, at + np.cumsum(own) - own
            at += int(own.sum())

    def level(self, key: np.ndarray) -> np.ndarray:
        out, live, segment = np.zeros(len(key), np.int64), np.arange(len(key)), segment_of(key, self.groups)
        begin, bits = self.begin[segment], self.bits[segment]
        for level in range(1, 128):
            a, step = halves(key, level)
            yes = np.arange(len(key))
            for i in range(HASHES):  # most of the missing ones are told by the first place
                at = begin[yes] + place(a[yes], step[yes], i, bits[yes]) if i else begin + place(a, step, 0, bits)
                yes = yes[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            key, live, begin, bits = key[yes], live[yes], begin[yes], bits[yes]
            if not len(live):
                break
            out[live] = level
        return out


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the tokens of some rows, each row's end in them), of about CHUNK tokens."""
    lists = batch.column(column)
    flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        yield first, flat[ends[first] : ends[last]], ends[first + 1 : last + 1] - ends[first]
        first = last


def before(flat: np.ndarray, ends: np.ndarray, end_hash: np.uint64) -> np.ndarray:
    """The token before each token; an end before the first of a text."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[np.concatenate([[0], ends[:-1]])] = end_hash
    return out


def contains(head: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each is in the sorted head, and whether it is."""
    if not len(head):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    return at, head[at] == h


class Model:
    """A trained model: the head with its counts, N, V, and the segments in the shared folder."""

    def __init__(self, head: np.ndarray, head_counts: np.ndarray, total: int, distinct: int, groups: int, shards: int, end_hash: int, counts: DataFrame, segments: DataFrame):
        self.head, self.head_counts, self.total, self.distinct, self.end_hash = head, head_counts, total, distinct, np.uint64(end_hash)
        self.groups, self.shards, self.counts, self.segments = groups, shards, counts, segments

    def filters(self, condition: Column) -> Filter:
        rows = self.segments.filter(condition).select("number", "bits", "sizes").toArrow()
        return Filter(self.groups, rows.column(0).to_pylist(), *([np.frombuffer(x.as_buffer(), kind) for x in rows.column(i)] for i, kind in ((1, np.uint8), (2, np.int64))))

    def shard(self, number: int) -> Filter:
        """The filter of the pairs of a shard, at most about SHARD_BYTES."""
        return self.filters(~F.col("alone") & (F.floor(F.col("number") * self.shards / self.groups) == number))

    def unigrams(self) -> Filter:
        return self.filters(F.col("alone"))


def train(docs: DataFrame, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES) -> Model:
    """Learns from docs (doc_id, text); all of them are training texts."""
    spark = docs.sparkSession
    n_bytes, end_hash = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], spark.range(1).select(F.xxhash64(F.lit("\n"))).first()[0] % (1 << 64)
    groups = -(-(n_bytes + 1) // group_bytes)

    def entries(key: np.ndarray, n: np.ndarray, alone: bool) -> pa.RecordBatch:
        """One row a group, with the keys and counts that go there: less to shuffle than a row a key. Single tokens are told by
        their own hashes."""
        group = group_of(gram(key) if alone else key, groups)
        order = np.argsort(group, kind="stable")
        group, key, n = group[order], key[order], n[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        stops = np.append(cuts[1:], len(group))
        small = np.uint8 if not len(n) or n.max() < 256 else np.int64
        n = n.astype(small)
        return pa.record_batch([pa.array(np.full(len(cuts), alone)), pa.array(group[cuts], pa.int64()), pa.array([key[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, stops)], pa.binary())], ["alone", "number", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens and pairs of some texts at a time; those that were met often are kept, as they come again."""
        kept = [[], []], [[], []]  # of pairs, of tokens: keys and counts
        for batch in batches:
            for _, flat, ends in chunks(batch, 0):
                for alone, keys in ((0, gram(flat, before(flat, ends, np.uint64(end_hash)))), (1, flat)):
                    key, n = np.unique(keys, return_counts=True)
                    often = n >= (1 if alone else 4)
                    kept[alone][0].append(key[often])
                    kept[alone][1].append(n[often])
                    if not alone:
                        yield entries(key[~often], n[~often], False)
                    if sum(map(len, kept[alone][0])) > KEPT:
                        merged = summed(*map(np.concatenate, kept[alone]))
                        kept[alone][0][:], kept[alone][1][:] = ([x] for x in merged)
                        if len(merged[0]) > KEPT // 2:
                            yield entries(*merged, bool(alone))
                            kept[alone][0].clear()
                            kept[alone][1].clear()
        for alone in (0, 1):
            if kept[alone][0]:
                yield entries(*summed(*map(np.concatenate, kept[alone])), bool(alone))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        """The segments of a group; of single tokens also their exact counts."""
        alone, counts = bool(pdf["alone"].iloc[0]), [np.frombuffer(c, np.uint8 if len(c) * 8 == len(k) else np.int64).astype(np.int64) for k, c in zip(pdf["keys"], pdf["counts"])]
        key, n = summed(np.frombuffer(b"".join(pdf["keys"]), np.uint64), np.concatenate(counts))
        bits, sizes = filled(gram(key) if alone else key, levels(n), groups)
        own = [key.tobytes(), n.tobytes(), int(n.sum()), len(n)] if alone else [b"", b"", 0, 0]
        return pd.DataFrame([[alone, int(pdf["number"].iloc[0]), bits.tobytes(), sizes.tobytes(), len(bits), float(np.bitwise_count(bits).sum()), *own]], columns=["alone", "number", "bits", "sizes", "n_bytes", "n_set", "words", "counts", "total", "distinct"])

    def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, n in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (key, n)], ["h", "c"])

    grams = docs.select(token_hashes(F.col("text")).alias("h")).mapInArrow(count, "alone boolean, number long, keys binary, counts binary")
    schema = "alone boolean, number long, bits binary, sizes binary, n_bytes long, n_set double, words binary, counts binary, total long, distinct long"
    segments = checkpointed(grams.groupBy("alone", "number").applyInPandas(fill, schema))
    total, distinct, n_bytes = segments.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("alone"), F.col("n_bytes"))), F.lit(0))).first()
    counts = segments.filter("alone").select("words", "counts").mapInArrow(each_word, "h long, c long")
    top = counts.filter(F.col("c") >= max(2, -(-total // HEAD))).toArrow()  # at most HEAD words occur so often
    head, head_counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(head)
    return Model(head[order], head_counts[order], total, distinct, groups, min(groups, max(1, -(-n_bytes // shard_bytes))), end_hash, counts, segments)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[first], np.add.reduceat(n[order], first) if len(first) else n


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every text."""
    spark = docs.sparkSession
    context = spark.sparkContext
    # A row is told by its id and its text; rows equal in both are summed, and divided by their number at the end.
    tokens = docs.select(F.col("doc_id").cast("long"), row_key(F.col("text"))[0].alias("t"), token_hashes(F.col("text")).alias("h"))
    n, v, end_hash, groups, shards = model.total, model.distinct, model.end_hash, model.groups, model.shards
    floor = n + 0.1 * (v + 1)
    shared, alone = context.broadcast((model.head, model.head_counts)), context.broadcast(model.unigrams())
    schema = "doc_id long, t long, h long, n long, known long, base double, score double"

    def scan(number: int, of_shard) -> DataFrame:
        """Pass 0 also gives the base score of the head's tokens, and a row for every other word of a text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (head, head_counts), unigrams, pairs = shared.value, alone.value, of_shard.value
            end_count = middle_counts(unigrams.level(gram(np.array([end_hash]))))
            for batch in batches:
                for first, flat, ends in chunks(batch, 2):
                    rows, begins = len(ends), np.concatenate([[0], ends[:-1]])
                    text = np.repeat(np.arange(rows), np.diff(ends, prepend=0))
                    coded = pa.array(flat).dictionary_encode()
                    u, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                    about = np.minimum(middle_counts(unigrams.level(gram(u))), n)
                    key = gram(flat, before(flat, ends, end_hash))
                    count_before = np.empty(len(flat))
                    count_before[1:] = about[inverse[:-1]]
                    count_before[begins] = end_count
                    mine = np.arange(len(flat)) if shards == 1 else np.flatnonzero(group_of(key, groups) * shards // groups == number)
                    p, count_before = ((about + 0.1) / floor)[inverse[mine]], count_before[mine]
                    share = np.minimum(middle_counts(pairs.level(key[mine])) / np.maximum(count_before, 1), 1.0)
                    p = np.log10(np.where(count_before > 0, BIGRAM_WEIGHT * share + (1 - BIGRAM_WEIGHT) * p, p))
                    total = np.bincount(text[mine], p, rows)
                    here = np.arange(first, first + rows)
                    if number:
                        nothing = np.zeros(rows, np.int64)
                        yield batch_of(batch, here, None, nothing, nothing, nothing * 0.0, total)
                        continue
                    at, known = contains(head, u)
                    of_word = known[inverse]
                    exact = np.log10((head_counts[at] + 0.1) / floor) if len(head) else np.zeros(len(u))
                    base = np.bincount(text, np.where(known, exact, 0.0)[inverse], rows)
                    yield batch_of(batch, here, None, np.diff(ends, prepend=0), np.bincount(text, of_word, rows), base, total)
                    rare = np.flatnonzero(~of_word)
                    if len(rare):
                        order = rare[np.lexsort((inverse[rare], text[rare]))]
                        t, w = text[order], inverse[order]
                        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (w[1:] != w[:-1])]))
                        times = np.diff(np.append(new, len(t)))
                        yield batch_of(batch, here[t[new]], u[w[new]].view(np.int64), times, times * 0, times * 0.0, times * 0.0)

        return tokens.mapInArrow(run, schema)

    def batch_of(batch, at, h, n, known, base, total) -> pa.RecordBatch:
        """Values of the rows of a batch at these places."""
        at = pa.array(at, pa.int64())
        return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.nulls(len(at), pa.int64()) if h is None else pa.array(h), pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(known, np.int64)), pa.array(np.asarray(base, np.float64)), pa.array(np.asarray(total, np.float64))], ["doc_id", "t", "h", "n", "known", "base", "score"])

    if shards == 1:
        found = scan(0, context.broadcast(model.shard(0)))
    else:
        parts, folder = [], f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
        for i in range(shards):
            of_shard = context.broadcast(model.shard(i))
            scan(i, of_shard).write.parquet(f"{folder}/{i}")
            of_shard.destroy()
            parts.append(spark.read.parquet(f"{folder}/{i}"))
        found = reduce(DataFrame.unionByName, parts)
    # Rows of whole texts have no h; they get a key of their own that spreads them and that the condition keeps apart.
    own = F.coalesce("h", F.xxhash64("doc_id", "t", F.lit(1)))
    keyed = found.select("doc_id", "t", F.col("h").isNotNull().alias("rare"), own.alias("k"), "n", "known", "base", "score")
    counts = model.counts.select(F.col("h").alias("k2"), "c")
    joined = keyed.join(counts, (keyed.k == counts.k2) & keyed.rare, "left")
    c = F.coalesce("c", F.lit(0))
    per_token = F.log10((c + 0.1) / F.lit(float(floor)))
    rare = F.col("rare")
    whole = ~rare & (F.col("n") > 0)  # one of each row, from pass 0: a text has its end at least
    copies = F.col("copies")
    summed = joined.groupBy("doc_id", "t").agg(
        F.count(F.when(whole, 1)).alias("copies"),
        F.sum(F.when(rare, 0).otherwise(F.col("n"))).alias("n_tokens"),
        F.sum(F.when(rare, F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("n") * per_token).otherwise(F.col("base"))).alias("base_score"),
        F.sum("score").alias("score"))
    each = [(F.col(c) / copies).cast("long").alias(c) for c in ("n_tokens", "n_known")] + [(F.col(c) / copies).alias(c) for c in ("base_score", "score")]
    return summed.select("doc_id", *each, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")).drop("copy")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}
