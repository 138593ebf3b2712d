"""Differences between scores: summaries, alignment of note streams, multiset differences, checks against expected ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavework.functions.pitch import chroma, diatonic_index, pitch_text
from stavework.sources.adapters import once

from .cursor import time_cursor
from .windows import MEASURE, before, over

C = F.col
#: The side of a tile of the table of scores: 2^24 cells are some tenths of a second.
TILE = 4096
#: Tiles of so many cells keep all their scores on the way back.
SMALL = 1 << 18


def note_stream(elements: DataFrame, by: tuple = ("score_id", "measure_idx"), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Pitched notes in canonical order: measure, onset (in diff mode), pitch. They are numbered within their measure; only measures, with how
    many notes they have, are counted through a score, of whose notes there are size. by tells measures apart, one column or several; elements that are dealt out by it
    aren't again. keep writes the notes of measures, which are read twice."""
    notes = time_cursor(elements, "diff", MEASURE if by == ("score_id", "measure_idx") else by).filter("tag = 'note' and not is_rest")
    notes = notes.withColumn("chroma", chroma(C("step"), C("alter"), C("octave"))).withColumn("pitch", pitch_text(C("step"), C("alter"), C("octave")))
    inner = keep(notes.withColumn("idx", F.row_number().over(over(by, ["onset", "chroma", "part_idx", "elem_idx"])) - 1))
    sizes = inner.groupBy("score_id", "measure_idx").agg(F.count("*").alias("n"))
    w = over("score_id", ["measure_idx"])
    begins = sizes.select("score_id", "measure_idx", F.coalesce(F.sum("n").over(before(w)), F.lit(0)).alias("begin"), F.sum("n").over(W.partitionBy("score_id")).alias("size"))
    return inner.join(begins, ["score_id", "measure_idx"]).withColumn("idx", (C("idx") + C("begin")).cast("int")).drop("begin")


def summary(measures: DataFrame, clefs: DataFrame) -> DataFrame:
    """Per score: how many measures, the first key (0 without one) and meter (none, or senza-misura if a measure says so in its column of
    that name), the clefs in order of staves."""
    first = lambda c, known: F.min_by(c, F.when(known, C("measure_idx")))
    free = F.max("senza_misura") if "senza_misura" in measures.columns else F.lit(False)
    m = measures.withColumn("time", F.concat_ws("/", C("beats").cast("string"), C("beat_type").cast("string")))
    time = F.coalesce(first("time", C("beats").isNotNull() & C("beat_type").isNotNull()), F.when(free, "senza-misura"), F.lit("none"))
    out = m.groupBy("score_id").agg(F.count("*").alias("n_measures"), F.coalesce(first("fifths", C("fifths").isNotNull()), F.lit(0)).alias("fifths"), time.alias("time"))
    staves = clefs.groupBy("score_id", "staff").agg(F.min_by(F.concat("sign", C("line").cast("string")), "measure_idx").alias("clef"))
    lists = staves.groupBy("score_id").agg(F.array_sort(F.collect_list(F.struct("staff", "clef"))).alias("clefs"))
    return out.join(lists, "score_id", "left").withColumn("clefs", F.coalesce(F.transform("clefs", lambda c: c["clef"]), F.array().cast("array<string>")))


def attribute_differences(source: DataFrame, recovered: DataFrame) -> DataFrame:
    """(score_id, kind, source, recovered); clefs are compared one by one only if they are as many."""
    pair = source.select("score_id", F.struct(*[c for c in source.columns if c != "score_id"]).alias("s")).join(recovered.select("score_id", F.struct(*[c for c in recovered.columns if c != "score_id"]).alias("r")), "score_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    sizes = F.size("s.clefs"), F.size("r.clefs")
    one = lambda kind, a, b: F.when(~text(a).eqNullSafe(text(b)), F.struct(F.lit(kind).alias("kind"), text(a).alias("source"), text(b).alias("recovered")))
    plain = [one("measureCount", C("s.n_measures"), C("r.n_measures")), one("keySignature", C("s.fifths"), C("r.fifths")), one("timeSignature", C("s.time"), C("r.time")), one("clefCount", *sizes)]
    clef = F.when(sizes[0] == sizes[1], F.filter(F.zip_with("s.clefs", "r.clefs", lambda a, b: one("clef", a, b)), lambda x: x.isNotNull()))
    every = F.concat(F.filter(F.array(*plain), lambda x: x.isNotNull()), F.coalesce(clef, F.array().cast("array<struct<kind:string,source:string,recovered:string>>")))
    return pair.select("score_id", F.explode(every).alias("d")).select("score_id", "d.*")


def next_scores(row: np.ndarray, left: int, x: int, y: np.ndarray) -> np.ndarray:
    """The next row of scores, which begins with left: equal items 1, other pairs and gaps -1."""
    out = np.empty_like(row)
    out[0] = left
    out[1:] = np.maximum(row[:-1] + np.where(y == x, 1, -1), row[1:] - 1)
    steps = np.arange(len(row), dtype=row.dtype)
    return np.maximum.accumulate(out + steps) - steps  # the best way along the row, a gap a step


def edges(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last row and the last column of a tile of scores, from its first ones; both hold both their corners."""
    row, right = top, [top[-1]]
    for i in range(len(x)):
        row = next_scores(row, left[i + 1], x[i], y)
        right.append(row[-1])
    return row, np.array(right, top.dtype)


def way_back(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """The way from the last cell of a tile back to its first row or column, and where it arrives; -1 stands for a gap. A pair is preferred to a
    gap in y, and that to a gap in x. Only every k-th row of the scores is kept, k rows at a time are filled in again, with k the root of the rows' number; of a small tile all are kept."""
    if len(x) * len(y) <= SMALL:
        return _small_way(x, y, top, left)
    i, j, every = len(x), len(y), max(1, int(len(x) ** 0.5))
    row, kept = top, [top]
    for k in range(1, i + 1):
        row = next_scores(row, left[k], x[k - 1], y)
        if k % every == 0:
            kept.append(row)
    out = []
    while i and j:
        low = (i - 1) // every * every
        score = [kept[low // every]]
        while low + len(score) <= i:
            score.append(next_scores(score[-1], left[low + len(score)], x[low + len(score) - 1], y))
        while i > low and j:
            here, above = score[i - low][j], score[i - 1 - low]
            if here == above[j - 1] + (1 if x[i - 1] == y[j - 1] else -1):
                i, j = i - 1, j - 1
                out.append((i, j))
            elif here == above[j] - 1:
                i -= 1
                out.append((i, -1))
            else:
                j -= 1
                out.append((-1, j))
    return out[::-1], i, j


def _small_way(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    score, row = [top.tolist()], top
    for k in range(len(x)):
        row = next_scores(row, left[k + 1], x[k], y)
        score.append(row.tolist())
    i, j, xs, ys, out = len(x), len(y), x.tolist(), y.tolist(), []
    while i and j:
        here, above = score[i][j], score[i - 1]
        if here == above[j - 1] + (1 if xs[i - 1] == ys[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif here == above[j] - 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1], i, j


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Global alignment of two sequences as one tile: equal items score 1, other pairs and gaps -1."""
    codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[v] for v in a], np.int64), np.array([codes[v] for v in b], np.int64)
    out, i, j = way_back(x, y, -np.arange(len(b) + 1, dtype=np.int32), -np.arange(len(a) + 1, dtype=np.int32))
    return [*((k, -1) for k in range(i)), *((-1, k) for k in range(j)), *out]


def common_ends(source: DataFrame, recovered: DataFrame) -> DataFrame:
    """(score_id, n_s, n_r, same): the lengths of both streams (score_id, idx, k; size, if they know it), and how many of their last notes are equal."""
    sizes = source.groupBy("score_id").agg(F.count("*").alias("n_s")).join(recovered.groupBy("score_id").agg(F.count("*").alias("n_r")), "score_id", "full").na.fill(0, ["n_s", "n_r"])
    sized = lambda df, n: df if "size" in df.columns else df.join(sizes.select("score_id", C(n).alias("size")), "score_id")
    back = lambda df, n, k: sized(df, n).select("score_id", (C("size") - C("idx")).cast("int").alias("back"), C("k").alias(k))
    other = back(source, "n_s", "k_s").join(back(recovered, "n_r", "k_r"), ["score_id", "back"]).filter("k_s <> k_r").groupBy("score_id").agg(F.min("back").alias("differs"))
    return sizes.join(other, "score_id", "left").select("score_id", "n_s", "n_r", F.coalesce(C("differs") - 1, F.least("n_s", "n_r")).alias("same"))


def _tile_edges(tiles: DataFrame) -> DataFrame:
    """(score_id, ti, tj, bottom, right) of tiles (score_id, ti, tj, x, y, top, left_)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                bottom, right = edges(*[b.column(c)[k].values.to_numpy() for c in range(3, 7)])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(k, 1) for c in range(3)], pa.array([bottom]), pa.array([right])], ["score_id", "ti", "tj", "bottom", "right"])

    return tiles.select("score_id", "ti", "tj", "x", "y", "top", "left_").mapInArrow(rows, "score_id long, ti long, tj long, bottom array<int>, right array<int>")


def _tile_ways(tiles: DataFrame) -> DataFrame:
    """(score_id, s_idx, r_idx, i, j): the way back through each tile as lists with -1 for gaps, and the cell of the whole table where it arrives."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, firsts, seconds = (b.column(c).to_pylist() for c in range(3))
            found = []
            for k in range(b.num_rows):
                way, i, j = way_back(*[b.column(c)[k].values.to_numpy() for c in range(3, 7)])
                i0, j0 = firsts[k], seconds[k]
                found.append((ids[k], [s if s < 0 else s + i0 for s, _ in way], [r if r < 0 else r + j0 for _, r in way], i0 + i, j0 + j))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()))], ["score_id", "s_idx", "r_idx", "i", "j"])

    return tiles.select("score_id", "i0", "j0", "x", "y", "top", "left_").mapInArrow(rows, "score_id long, s_idx array<long>, r_idx array<long>, i long, j long")


def tiled(source: DataFrame, recovered: DataFrame, sizes: DataFrame, keep: Callable[[DataFrame], DataFrame], side: int = TILE) -> DataFrame:
    """(score_id, s_idx, r_idx) of streams (score_id, idx, code) whose lengths are n and m in sizes; null for a gap.

    The table of scores is cut into tiles of a side. Those on one diagonal are computed at once, each from the last row of the
    tile above and the last column of the one before: a job a diagonal, a tile a row, so that a long pair is many tasks. Then the way back goes
    through one tile a job for all pairs. Pairs of one tile need one job in all. keep writes a table where all executors can read it."""
    block = lambda df, name, t: df.groupBy("score_id", F.expr(f"idx div {side}").alias(t)).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda v: v["code"]).alias(name))
    xs, ys = keep(block(source, "x", "ti")), keep(block(recovered, "y", "tj"))
    sizes = keep(sizes.select("score_id", C("n").cast("long"), C("m").cast("long"), F.expr(f"(n + {side - 1}) div {side}").alias("rows"), F.expr(f"(m + {side - 1}) div {side}").alias("columns")))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # tiles are small rows and much work: they aren't put together by size
    last = sizes.agg(F.max(F.when(C("n") * C("m") > 0, C("rows") + C("columns") - 2))).first()[0] or 0
    border = lambda at, count: F.transform(F.sequence(at, at + count), lambda v: (-v).cast("int"))

    def with_borders(tiles: DataFrame, done: DataFrame) -> DataFrame:
        """Tiles (score_id, ti, tj, x, y) with their first row and column."""
        above = done.select("score_id", (C("ti") + 1).alias("ti"), "tj", C("bottom").alias("above"))
        before_ = done.select("score_id", "ti", (C("tj") + 1).alias("tj"), C("right").alias("before"))
        both = tiles.join(above, ["score_id", "ti", "tj"], "left").join(before_, ["score_id", "ti", "tj"], "left")
        return both.withColumn("top", F.coalesce("above", border(C("tj") * side, F.size("y")))).withColumn("left_", F.coalesce("before", border(C("ti") * side, F.size("x"))))

    done = wave = source.sparkSession.createDataFrame([], "score_id long, ti long, tj long, bottom array<int>, right array<int>")
    for d in range(last):
        here = sizes.filter(f"n > 0 and m > 0 and rows + columns - 2 > {d}").select("score_id", F.explode(F.expr(f"sequence(greatest(0, {d} - columns + 1), least({d}, rows - 1))")).alias("ti"), F.lit(d).cast("long").alias("d"))
        here = here.select("score_id", "ti", (C("d") - C("ti")).alias("tj")).join(xs, ["score_id", "ti"]).join(ys, ["score_id", "tj"])
        wave = keep(_tile_edges(with_borders(here, wave).repartition(max(parts, d + 1), "ti", "score_id")))
        done = done.union(wave)
    done = keep(done) if last > 1 else done
    at, ways = sizes.select("score_id", C("n").alias("i"), C("m").alias("j")), []
    for _ in range(last + 1):
        open_ = at.filter("i > 0 and j > 0").select("score_id", "i", "j", F.expr(f"(i - 1) div {side}").alias("ti"), F.expr(f"(j - 1) div {side}").alias("tj"))
        here = open_.join(xs, ["score_id", "ti"]).join(ys, ["score_id", "tj"]).withColumn("i0", C("ti") * side).withColumn("j0", C("tj") * side)
        here = here.withColumn("x", F.slice("x", F.lit(1), (C("i") - C("i0")).cast("int"))).withColumn("y", F.slice("y", F.lit(1), (C("j") - C("j0")).cast("int")))
        # a border is needed as far as the way begins
        here = with_borders(here, done).withColumn("top", F.slice("top", F.lit(1), F.size("y") + 1)).withColumn("left_", F.slice("left_", F.lit(1), F.size("x") + 1))
        found = keep(_tile_ways(here.repartition(parts, "score_id")))
        ways.append(found.select("score_id", F.explode(F.arrays_zip("s_idx", "r_idx")).alias("w")).select("score_id", "w.s_idx", "w.r_idx"))
        at = found.select("score_id", "i", "j").union(at.filter("i = 0 or j = 0"))
        if last and not found.filter("i > 0 and j > 0").limit(1).count():
            break
    gap = F.lit(-1)
    ways.append(at.filter("i > 0").select("score_id", F.explode(F.sequence(F.lit(0), C("i") - 1)), gap))
    ways.append(at.filter("j > 0").select("score_id", gap, F.explode(F.sequence(F.lit(0), C("j") - 1))))
    every = reduce(DataFrame.union, ways).toDF("score_id", "s_idx", "r_idx")
    return every.select("score_id", *[F.when(C(c) >= 0, C(c).cast("long")).alias(c) for c in ("s_idx", "r_idx")])


def aligned(source: DataFrame, recovered: DataFrame, keep: Callable[[DataFrame], DataFrame] = once, side: int = TILE) -> DataFrame:
    """(score_id, s_idx, r_idx) of two note streams, aligned by step and octave; null for a gap. Equal ends of both streams are paired by
    position, which the preference for pairs on the way back does as well; what stands before them is aligned in tiles."""
    key = diatonic_index(C("step"), C("octave")).cast("int").alias("k")
    s, r = (keep(df.select("score_id", "idx", key, *[c for c in df.columns if c == "size"])) for df in (source, recovered))
    ends = keep(common_ends(s, r))
    paired = s.join(ends.filter("same > 0"), "score_id").filter(C("idx") >= C("n_s") - C("same")).select("score_id", C("idx").cast("long").alias("s_idx"), (C("idx") - C("n_s") + C("n_r")).cast("long").alias("r_idx"))
    rest = lambda df, n: df.join(ends.filter(C(n) > C("same")), "score_id").filter(C("idx") < C(n) - C("same")).select("score_id", C("idx").cast("int"), C("k").alias("code"))
    sizes = ends.select("score_id", (C("n_s") - C("same")).alias("n"), (C("n_r") - C("same")).alias("m")).filter("n > 0 or m > 0")
    return paired.unionByName(tiled(rest(s, "n_s"), rest(r, "n_r"), sizes, keep, side))


def note_differences(source: DataFrame, recovered: DataFrame) -> DataFrame:
    """Missed, spurious and wrong notes, and those of the right step with a wrong accidental."""
    s = source.select("score_id", C("idx").alias("s_idx"), C("measure_idx").alias("s_measure"), C("pitch").alias("s_pitch"), F.concat("step", C("octave").cast("string")).alias("s_key"))
    r = recovered.select("score_id", C("idx").alias("r_idx"), C("measure_idx").alias("r_measure"), C("pitch").alias("r_pitch"), F.concat("step", C("octave").cast("string")).alias("r_key"))
    rows = aligned(source, recovered).join(s, ["score_id", "s_idx"], "left").join(r, ["score_id", "r_idx"], "left")
    kind = F.when(C("r_idx").isNull(), "missed").when(C("s_idx").isNull(), "spurious").when(C("s_key") != C("r_key"), "wrong").when(C("s_pitch") != C("r_pitch"), "wrongAccidental")
    return rows.withColumn("kind", kind).filter("kind is not null").select("score_id", "kind", F.coalesce("s_measure", "r_measure").alias("measure_idx"), C("s_pitch").alias("source"), C("r_pitch").alias("recovered"))


def multiset_differences(source: DataFrame, recovered: DataFrame) -> DataFrame:
    """Notes of a measure that only one side has, counted as multisets; needs no alignment."""
    by = ["score_id", "measure_idx", "pitch"]
    n = source.groupBy(*by).agg(F.count("*").alias("n_source")).join(recovered.groupBy(*by).agg(F.count("*").alias("n_recovered")), by, "full").na.fill(0, ["n_source", "n_recovered"])
    return n.withColumn("extra", C("n_source") - C("n_recovered")).filter("extra <> 0").select(*by, F.when(C("extra") > 0, "missed").otherwise("spurious").alias("kind"), F.abs("extra").alias("times"))


def checked(expected: DataFrame, actual: DataFrame, by: list[str], attribute_kinds: tuple = ("measureCount", "keySignature", "timeSignature", "clefCount", "clef")) -> DataFrame:
    """Expected and actual differences (by, kind, value) as multisets: ok, stale (an attribute with another value), obsolete,
    uncodified."""
    number = lambda df, *keys: df.withColumn("nr", F.row_number().over(over((*by, "kind", *keys), ["value"])))
    attribute = C("kind").isin(*attribute_kinds)
    e, a = expected.select(*by, "kind", "value"), actual.select(*by, "kind", "value")
    notes = number(e.filter(~attribute), "value").withColumn("e", F.lit(True)).join(number(a.filter(~attribute), "value").withColumn("a", F.lit(True)), [*by, "kind", "value", "nr"], "full")
    status = F.when(C("e") & C("a"), "ok").when(C("e"), "obsolete").otherwise("uncodified")
    notes = notes.select(*by, "kind", "value", status.alias("status"))
    attrs = number(e.filter(attribute)).withColumnRenamed("value", "ve").join(number(a.filter(attribute)).withColumnRenamed("value", "va"), [*by, "kind", "nr"], "full")
    status = F.when(C("ve").isNull(), "uncodified").when(C("va").isNull(), "obsolete").when(C("ve") == C("va"), "ok").otherwise("stale")
    return notes.unionByName(attrs.select(*by, "kind", F.coalesce("ve", "va").alias("value"), status.alias("status")))


def described(found: DataFrame) -> DataFrame:
    """Differences (kind, measure_idx, source, recovered) with a text each; measures are counted from 1."""
    # The wording of each kind of difference.
    kind, m = C("kind"), (C("measure_idx") + 1).cast("string")
    both = lambda name: F.concat(F.lit(f"{name}: source "), "source", F.lit(", recovered "), "recovered")
    where = lambda name: F.concat(F.lit(f"{name}: recovered "), "recovered", F.lit(" where source has "), "source", F.lit(" (m"), m, F.lit(")"))
    named = {"measureCount": both("measure count"), "keySignature": F.concat(F.lit("key: source fifths "), "source", F.lit(", recovered "), "recovered"), "timeSignature": both("time signature"), "clefCount": both("clef count"), "clef": both("clefs"),
             "missed": F.concat(F.lit("missed "), "source", F.lit(" (source m"), m, F.lit(")")), "spurious": F.concat(F.lit("spurious "), "recovered", F.lit(" (m"), m, F.lit(")")), "wrong": where("wrong note"), "wrongAccidental": where("wrong accidental")}
    text = F.lit(None).cast("string")
    for name, t in named.items():
        text = F.when(kind == name, t).otherwise(text)
    return found.withColumn("text", text)


def report(attributes: DataFrame, notes: DataFrame, most: int = 15) -> DataFrame:
    """The lines of a report on each score: all differences of attributes, then the first notes' so many, then how many more there are."""
    a = described(attributes.withColumn("measure_idx", F.lit(None).cast("int"))).select("score_id", F.lit(0).alias("part"), F.row_number().over(over("score_id", ["kind", "source", "recovered"])).alias("nr"), "text")
    order = over("score_id", ["measure_idx", "kind", "source", "recovered"])
    n = described(notes).select("score_id", F.lit(1).alias("part"), F.row_number().over(order).alias("nr"), "text")
    more = notes.groupBy("score_id").agg(F.count("*").alias("n")).filter(C("n") > most).select("score_id", F.lit(2).alias("part"), F.lit(1).alias("nr"), F.format_string("and %d more note differences", C("n") - most).alias("text"))
    return a.unionByName(n.filter(C("nr") <= most)).unionByName(more)


def comparison(first: DataFrame, second: DataFrame, every: DataFrame) -> DataFrame:
    """Per score how many differences two systems have, and which is better."""
    n = lambda df, name: df.groupBy("score_id").agg(F.sum("times").alias(name))
    both = every.join(n(first, "n_first"), "score_id", "left").join(n(second, "n_second"), "score_id", "left").na.fill(0, ["n_first", "n_second"])
    return both.withColumn("verdict", F.when(C("n_first") < C("n_second"), "first").when(C("n_first") > C("n_second"), "second").otherwise("tie"))


def top_differences(found: DataFrame, most: int = 15) -> DataFrame:
    """A score's first differences, in order of measure, pitch and kind: a report shows so many."""
    return found.withColumn("nr", F.row_number().over(over("score_id", ["measure_idx", "pitch", "kind"]))).filter(C("nr") <= most)


def changed(texts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Documents whose text is not that of their baseline."""
    digest = lambda df, name: df.select("score_id", F.sha2("text", 256).alias(name))
    return digest(texts, "now").join(digest(baseline, "was"), "score_id").withColumn("unsaved", C("now") != C("was"))
