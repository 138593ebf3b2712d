"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has a bit for each of the 64 bits of the shingles' hashes, set where over half the hashes have it.
Fingerprints link at ``DISTANCE`` or fewer differing bits; what links reach is a component.

Search is exact, on distinct fingerprints. The bits are grouped into m parts, correlated bits together; a threshold of
its own goes to each part, -1 (not searched) or more, with a sum of ``DISTANCE - m + 1``: two linked fingerprints then
agree within the threshold in at least one part. Dynamic programming picks the thresholds, and the best m, by the
estimated number of candidates, from the counts of the parts' values over all fingerprints. To probe, a fingerprint is
written under its part's value with every choice of threshold-many bits blanked; those that share a key are compared.
Of the links under one key only a spanning forest is written, so a large group of near copies makes no pairs of all. A key that more
than ``HOT_KEY`` fingerprints share is split: of any four parts of the bits, two of them that are linked agree in one.

Cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; of one or two words
the whole sequence is the only shingle; repeated rows are in one component; an empty table gives an empty table;
a null doc_id is never a component's id unless it has no other; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, row_key, shuffles_removed, table, words
from .components import components

C = F.col
DISTANCE, SHINGLE, BITS = 3, 3, 64
MOST_DIRECT, HOT_KEY, SPLITS = 4096, 50_000, 3
#: What writing a key and comparing a candidate cost, relative to each other.
KEY_COST, CANDIDATE_COST = 1.0, 0.02
#: Min-hashes of ROWS permutations are a band. Two sets of similarity s share none of BANDS bands with a chance of (1 - s ** ROWS) ** BANDS:
#: 3e-6 at 0.8, the least similarity for which keep_one() is meant.
BANDS, ROWS = 32, 5
#: Buckets in which shingles are counted, to put rare ones first.
BUCKETS = 1 << 20
#: Where more than CROWD nodes of a key are connected, the others are compared with HUBS of them before all.
CROWD, HUBS = 32, 8
#: Columns that tell texts apart, added to documents for a while.
ROW = ("__text_hash", "__text_hash_2")


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 with seed 42 of every shingle of k words, repeats included; xxhash64() is that function."""
    w = words(ascii_lower(text))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("w", i + j) for j in range(k)])))
    whole = F.when(F.size("w") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array().cast("array<long>"))
    return w, F.when(F.size("w") >= k, windows).otherwise(whole)


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint of an array of hashes, as a signed number."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp and more columns of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            fp = pa.array([majority_bits(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())
            yield pa.record_batch([batch.column(0), fp, *batch.columns[2:]], ["doc_id", "fp", *more])

    w, hashes = shingle_hashes(F.col("text"), k)
    rows = docs.select(F.col("doc_id").cast("long"), w.alias("w"), *more).select("doc_id", hashes.alias("h"), *more)
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """How many fingerprints there are, how often each bit is set, and each two bits together; 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            sums, n = sums + bits.T @ bits, n + len(bits)
        i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.append(sums.ravel(), n), pa.float64())], ["i", "j", "v"])

    found = fps.select("fp").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # 4,097 rows at most
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, v in found:
        if i == BITS:
            n = int(v)
        else:
            both[i, j] = v
    return n, np.diag(both).copy(), both


def correlated_parts(n: int, ones: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width; each starts with the bit of the strongest ties that is left and takes in the bit of the
    strongest ties to the part."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    ties = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(ties, 0)
    left, parts = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (ties[b, rest].sum(), -b))]
        while len(part) < width:
            part.append(max(sorted(left - set(part)), key=lambda b: (ties[b, part].sum(), -b)))
        left -= set(part)
        parts.append(sorted(part))
    return parts


def part_value(fp: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(part):
        out |= ((fp >> np.int64(b)) & np.int64(1)) << np.int64(i)
    return out


def value_column(part: list[int]) -> Column:
    bits = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), i) for i, b in enumerate(part)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def same_pairs(fps: DataFrame, layouts: list[list[list[int]]]) -> list[list[float]]:
    """Pairs of equal value in each part of each layout, over all fingerprints."""
    flat = [part for parts in layouts for part in parts]
    keyed = fps.select(F.posexplode(F.array(*[value_column(p).cast("long") for p in flat])))
    counts = keyed.groupBy("pos", "col").agg(F.count("*").cast("double").alias("c")).groupBy("pos").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"))
    pairs = {r["pos"]: r["pairs"] for r in counts.collect()}  # a row a part
    out, at = [], 0
    for parts in layouts:
        out.append([pairs.get(at + i, 0.0) for i in range(len(parts))])
        at += len(parts)
    return out


def costs(n: int, part: list[int], equal: float, ones: np.ndarray) -> list[float]:
    """Estimated cost of a part by threshold + 1: keys to write, and candidates if the bits were independent."""
    p = ones[part] / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    symmetric = np.array([1.0] + [0.0] * DISTANCE)  # how much likelier j differing bits are than none
    for r in odds:
        symmetric[1:] += symmetric[:-1] * r
    return [0.0] + [n * comb(len(part), t) * KEY_COST + CANDIDATE_COST * equal * sum(symmetric[j] * comb(len(part) - j, t - j) for j in range(t + 1)) for t in range(DISTANCE + 1)]


def allocate(by_part: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The thresholds (-1 or more) of that sum and the least cost, by dynamic programming over the parts."""
    best = {0: (0.0, [])}
    for cost in by_part:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, DISTANCE + 1):
                option = (c + cost[t + 1], [*chosen, t])
                if used + t not in step or option < step[used + t]:
                    step[used + t] = option
        best = step
    return best[total]


def plan(fps: DataFrame) -> list[tuple[list[int], int]]:
    """The parts that are searched, with their thresholds."""
    n, ones, both = bit_statistics(fps)
    layouts = [correlated_parts(n, ones, both, m) for m in (2, 3, 4)]
    options = []
    for parts, equal in zip(layouts, same_pairs(fps, layouts)):
        cost, thresholds = allocate([costs(n, p, e, ones) for p, e in zip(parts, equal)], DISTANCE - len(parts) + 1)
        options.append((cost, [(p, t) for p, t in zip(parts, thresholds) if t >= 0]))
    return min(options)[1]


def keyed(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): the number of the part and its blanked bits, and the value of the other bits, in one number."""
    probes = [(part, [sum(1 << b for b in blank) for blank in combinations(range(len(part)), t)]) for part, t in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for i in range(0, len(every), 1024):
                fp, number = every[i : i + 1024], 0
                keys = []
                for part, blanks in probes:
                    value = part_value(fp, part)
                    for blank in blanks:
                        keys.append((value & ~np.int64(blank)) | np.int64(number << 33))
                        number += 1
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(fp, len(keys)))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is linked among the fingerprints: each one met takes in all that are left near it."""
    if len(fps) > MOST_DIRECT:  # of four parts of 16 bits at least one is equal
        out = []
        for shift in range(0, BITS, 16):
            value = (fps >> np.int64(shift)) & np.int64(0xFFFF)
            order = np.argsort(value, kind="stable")
            for run in np.split(fps[order], np.flatnonzero(np.diff(value[order])) + 1):
                out += near(run) if len(run) > 1 else []
        return out
    return near(fps)


def near(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    left, todo, out = fps, [], []
    while len(left):
        if todo:
            x = todo.pop()
        else:
            x, left = left[0], left[1:]
        close = np.bitwise_count((left ^ x).view(np.uint64)) <= DISTANCE
        if close.any():
            found, left = left[close], left[~close]
            out.append((np.full(len(found), x), found))
            todo += list(found)
    return out


def links(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(a, b): links whose components are those of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            twos = starts[sizes == 2]
            twos = twos[np.bitwise_count((fps[twos] ^ fps[twos + 1]).view(np.uint64)) <= DISTANCE]
            found = [(fps[twos], fps[twos + 1])]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                found += forest(fps[s : s + n])
            yield pa.record_batch([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], ["a", "b"])

        for batch in batches:  # sorted by key; a key's rows may go on in the next batch
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            if len(pending) and k[-1] == pending[-1][0][-1]:
                pending.append((k, f))
                continue
            cut = np.searchsorted(k, k[-1])
            pending.append((k[:cut], f[:cut]))
            yield from done(np.concatenate([x[0] for x in pending]), np.concatenate([x[1] for x in pending]))
            pending = [(k[cut:], f[cut:])]
        if pending:
            yield from done(np.concatenate([x[0] for x in pending]), np.concatenate([x[1] for x in pending]))

    rows = split_hot(checkpointed(keyed(fps, chosen)))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def split_hot(rows: DataFrame, most: int = HOT_KEY) -> DataFrame:
    """(key, fp), where the rows of a key with more than that many are dealt to four keys each, by 16 bits of theirs."""
    for i in range(SPLITS):
        hot = checkpointed(rows.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > most).select(F.col("key").alias("hot")))
        if hot.isEmpty():
            break
        turned = F.shiftleft("fp", 5 * i).bitwiseOR(F.shiftrightunsigned("fp", BITS - 5 * i)) if i else F.col("fp")
        parts = [F.xxhash64(F.lit(i), F.lit(j), "key", F.shiftrightunsigned(turned, 16 * j).bitwiseAND(F.lit(0xFFFF))) for j in range(4)]
        marked = rows.join(hot, rows.key == hot.hot, "left")  # hot has a row for each HOT_KEY rows at most
        rows = checkpointed(marked.select(F.explode(F.when(F.col("hot").isNull(), F.array("key")).otherwise(F.array(*parts))).alias("key"), "fp"))
    return rows


def rooted(fps: DataFrame) -> DataFrame:
    """fps (fp, each once) with the root of its component."""
    fps = checkpointed(fps)
    roots = components(links(fps, plan(fps)))
    return fps.join(roots, fps.fp == roots.node, "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id."""
    each = checkpointed(fingerprints(docs, k))
    roots = rooted(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, fp and ROW, with set_id, which is the same for the same set of shingles, and the bands of its min-hashes."""
    rng = np.random.default_rng(8)
    odd, add = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1) for _ in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            fp = [majority_bits(flat[a:b]) for a, b in zip(ends, ends[1:])]
            full = np.flatnonzero(np.diff(ends))
            bands = np.zeros((BANDS, batch.num_rows), np.uint64)
            if len(full):
                x, at = flat[ends[0] : ends[-1]].view(np.uint64), ends[full] - ends[0]
                x = x ^ (x >> np.uint64(29))
                for i in range(BANDS * ROWS):
                    y = x * odd[i] + add[i]
                    y ^= y >> np.uint64(32)
                    y *= odd[i - 1]
                    bands[i // ROWS, full] = bands[i // ROWS, full] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(y, at) + np.uint64(i)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * BANDS, pa.int32()), pa.array(bands.T.ravel().view(np.int64)))
            yield pa.record_batch([batch.column(0), pa.array(fp, pa.int64()), *batch.columns[2:], rows], ["doc_id", "fp", *ROW, "set_id", "bands"])

    w, hashes = shingle_hashes(F.col("text"), k)
    rows = docs.select(F.col("doc_id").cast("long"), w.alias("w"), *ROW).select("doc_id", hashes.alias("h"), *ROW)
    rows = rows.withColumn("set_id", F.xxhash64(F.array_sort(F.array_distinct("h"))))
    return rows.mapInArrow(run, f"doc_id long, fp long, {ROW[0]} long, {ROW[1]} long, set_id long, bands array<long>")


def star_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): the least node of each key with every other one; a join, so that rows of a hot key may go to many tasks."""
    least = keys.groupBy("key").agg(F.min("node").alias("a"))
    return keys.join(least, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def hub_pairs(keys: DataFrame) -> DataFrame:
    """(a, b): the nodes of a crowded key (key, node, root) that are not of its largest root, with HUBS nodes of that root, drawn by hash.

    A set that is near some sets of a large group, but not near the one that its bands were compared with, is thus mostly connected by pairs in
    proportion to the keys, before it would meet the whole group."""
    drawn = [F.min(F.struct(F.xxhash64(F.lit(i), "key", "node"), C("node").alias("hub"))) for i in range(HUBS)]
    groups = keys.groupBy("key", C("root").alias("of")).agg(F.count("*").alias("c"), F.array(*drawn).alias("hubs")).filter(C("c") > CROWD)
    crowded = groups.groupBy("key").agg(F.max(F.struct("c", "of", "hubs")).alias("x")).select("key", "x.of", "x.hubs")
    met = keys.join(crowded, "key").filter(C("root") != C("of")).select("node", F.explode("hubs.hub").alias("hub"))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def shingle_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """wanted (set_id and ROW of one text of each) with h, the set of shingles."""
    texts = rows.select(*ROW, "text").join(wanted, list(ROW)).dropDuplicates(["set_id"])
    w, hashes = shingle_hashes(F.col("text"), k)
    rest = [c for c in wanted.columns if c not in ROW]
    return texts.select(*rest, w.alias("w")).select(*rest, F.array_distinct(hashes).alias("h"))


def rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """(token, node, root, n, i): so many shingles of each set (set_id, root, h) that two sets of that similarity share one of them; n: the
    set's size, i: the shingle's place in an order that puts shingles of rare buckets first and is the same for all sets."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["bucket", "c"])

    found = sets.select("h").mapInArrow(tally, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            lists, out = batch.column(2), []
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for a, b in zip(ends, ends[1:]):
                h = flat[a:b]
                first = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                out.append(h[np.lexsort((h, counts[h & (BUCKETS - 1)]))[:first]])
            n = np.array([len(x) for x in out], np.int64)
            which = np.repeat(np.arange(len(out)), n)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(which)
            yield pa.record_batch([pa.array(np.concatenate([flat[:0], *out])), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.diff(ends).astype(np.int64)[which]), pa.array(place)], ["token", "node", "root", "n", "i"])

    return sets.select("set_id", "root", "h").mapInArrow(run, "token long, node long, root long, n long, i long")


def unconnected_pairs(tokens: DataFrame, similarity: float) -> DataFrame:
    """(a, b): sets of different roots that may have that similarity by their sizes and the places of a token that they share.

    Of two such sets the smaller one has a common token even among fewer of its first ones, so the larger sets' tokens meet only these.
    Where a token's sets mostly have one root, these are not compared with each other: of two roots at least one is another."""
    per_root = tokens.groupBy("token", "root").agg(F.count("*").alias("c"))
    mixed = per_root.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main")).filter("roots > 1").select("token", "main")
    tokens = checkpointed(tokens.join(mixed, "token").withColumn("other", C("root") != C("main")).drop("main"))
    overlap = 2 * similarity / (1 + similarity)
    small = tokens.filter(C("i") <= C("n") - F.ceil(F.lit(overlap) * C("n") - 1e-9)).select("token", *[C(c).alias(f"{c}_a") for c in ("node", "root", "n", "i", "other")])
    large = tokens.select("token", *[C(c).alias(f"{c}_b") for c in ("node", "root", "n", "i", "other")])
    n, m = C("n_a"), C("n_b")
    ordered = (n < m) | (n == m) & (C("node_a") < C("node_b"))
    may = (n >= F.lit(similarity - 1e-9) * m) & (F.least(n - C("i_a"), m - C("i_b")) >= F.lit(overlap / 2 - 1e-9) * (n + m))
    found = small.filter("other_a").join(large, "token").unionByName(small.filter("not other_a").join(large.filter("other_b"), "token"))
    return found.filter((C("root_a") != C("root_b")) & ordered & may).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_roots(rows: DataFrame, each: DataFrame, k: int, similarity: float) -> DataFrame:
    """(set_id, root): sets of shingles are linked where the share of common ones among those of both is at least similarity.

    First, sets that share a band, or whose fingerprints are within DISTANCE bits, are compared with one of theirs only, and those of crowded bands
    that this leaves unconnected with some more. Then, among the sets of bands that are still unconnected, those of different roots are compared that share one of their rarest shingles: which ones two
    sets of that similarity can't all differ in. All links are verified on the whole sets."""
    sets = each.groupBy("set_id").agg(F.min(F.struct(*ROW, "fp", "bands")).alias("x")).select("set_id", "x.*")
    sets = checkpointed(sets)
    keys = sets.select("set_id", F.posexplode("bands")).select(F.xxhash64("pos", "col").alias("key"), F.col("set_id").alias("node"))
    alone = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    keys = checkpointed(keys.join(alone, "key", "left_semi"))

    by_fp = checkpointed(sets.groupBy("fp").agg(F.min("set_id").alias("node")))
    a, b = (by_fp.select(F.col("fp").alias(x), F.col("node").alias(f"n{x}")) for x in "ab")
    near_bits = links(by_fp, plan(by_fp)).join(a, "a").join(b, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

    def verified(pairs: DataFrame, h: DataFrame) -> DataFrame:
        left, right = (h.select(F.col("set_id").alias(x), F.col("h").alias(f"h{x}")) for x in "ab")
        common, sizes = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
        return checkpointed(pairs.join(left, "a").join(right, "b").filter(common >= F.lit(similarity) * (sizes - common)).select("a", "b"))

    stars = checkpointed(star_pairs(keys).union(near_bits).filter("a <> b").distinct())
    nodes = stars.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    h = checkpointed(shingle_sets(rows, sets.select("set_id", *ROW).join(nodes, "set_id"), k))  # all sets with a band in common are in a star
    def unconnected(found: DataFrame) -> DataFrame:
        """key, node and root of the keys whose nodes have several roots."""
        roots = components(found).withColumnRenamed("node", "of")
        known = keys.join(roots, keys.node == roots.of, "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        return checkpointed(known.join(known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"), "key", "left_semi"))

    found = verified(stars, h)
    mixed = unconnected(found)
    more = checkpointed(hub_pairs(mixed).join(stars, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        found, stars = checkpointed(found.union(verified(more, h))), stars.union(more)
        mixed = unconnected(found)
    loose = checkpointed(mixed.select(F.col("node").alias("set_id"), "root").distinct())
    pairs = unconnected_pairs(rare_first(h.join(loose, "set_id"), similarity), similarity).join(stars, ["a", "b"], "left_anti")
    roots = components(found.union(verified(checkpointed(pairs), h)))
    return sets.join(roots, sets.set_id == roots.node, "left").select("set_id", F.coalesce("root", "set_id").alias("root"))


def keep_one(docs: DataFrame, k: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One document of each component, in the columns of docs: that of the least id, one without an id only where the component has no
    other. A row is told by its id and its text, so rows that share an id (or have none) but not a text are judged each; of repeated rows one stays.
    Fingerprints are linked within DISTANCE bits or, if a similarity is given, texts whose sets of shingles have that Jaccard similarity."""
    names = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)])  # further columns may have any name
    rows = docs.withColumns(dict(zip(ROW, row_key(F.col("text")))))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)).alias("first")  # copies are gathered before the join, so a hot set is one row there
    with shuffles_removed(docs.sparkSession):  # many small jobs, whose shuffles have a file for each task
        if similarity is None:
            each = checkpointed(fingerprints(rows, k, ROW))
            named = each.groupBy("fp").agg(first).join(rooted(each.select("fp").distinct()), "fp")
        else:
            each = checkpointed(sketches(rows, k))
            named = each.groupBy("set_id").agg(first).join(similar_roots(rows, each, k, similarity), "set_id")
    # The join and the choice among repeated rows have the same keys, so the texts are shuffled once.
    own = {"id_or_0": lambda c: F.coalesce(c.cast("long"), F.lit(0)), "has_id": lambda c: c.isNotNull()}
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(*[f(F.col("first.doc_id")).alias(x) for x, f in own.items()], *[F.col(f"first.{c}").alias(c) for c in ROW])
    keys = [*own, *ROW]
    return rows.withColumns({x: f(F.col("doc_id")) for x, f in own.items()}).join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns).toDF(*names)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_near_dedup": op7_simhash_near_dedup}
ORACLES: dict[str, str] = {}
