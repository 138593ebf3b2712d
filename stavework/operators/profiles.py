"""Page profiles and histograms: peaks, staves, thresholds, tiles, overlaps of masks. Everything is by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import before, island, over, upto

C = F.col


def row_profile(runs: DataFrame) -> DataFrame:
    return runs.groupBy("page_id", "y").agg(F.sum(C("x1") - C("x0")).alias("ink"))


def peak_rows(profile: DataFrame, share: float = 0.25) -> DataFrame:
    """Runs of neighbouring rows of at least a share of the page's peak: weighted centre and thickness."""
    peak = profile.groupBy("page_id").agg(F.max("ink").alias("peak"))
    rows = profile.join(peak, "page_id").filter(C("ink") >= F.lit(share) * C("peak"))
    w = over("page_id", ["y"])
    runs = rows.withColumn("run", C("y") - F.row_number().over(w))
    return runs.groupBy("page_id", "run").agg((F.sum(C("ink") * C("y")) / F.sum("ink")).alias("center"), F.count("*").alias("thickness"), F.min("y").alias("top")).drop("run")


def unit_sizes(lines: DataFrame) -> DataFrame:
    """Per page the median gap between neighbouring lines."""
    gaps = lines.withColumn("gap", C("center") - F.lag("center").over(over("page_id", ["center"]))).filter("gap is not null")
    return gaps.groupBy("page_id").agg(F.percentile("gap", 0.5).alias("unit"))


def staves(lines: DataFrame, units: DataFrame, wide: float = 1.7) -> DataFrame:
    """Lines in groups of five: a group ends at a gap of more than so many units, or when it is full; others go."""
    w = over("page_id", ["center"])
    rows = lines.join(units, "page_id").withColumn("gap", C("center") - F.lag("center").over(w))
    rows = rows.withColumn("part", island(F.coalesce(C("gap") > F.lit(wide) * C("unit"), F.lit(True)), w))
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(over(("page_id", "part"), ["center"])) - 1) / 5))
    found = rows.groupBy("page_id", "part", "chunk").agg(F.count("*").alias("n"), F.min("center").alias("first"), F.max("center").alias("last")).filter("n = 5")
    return found.withColumn("staff_no", F.row_number().over(over("page_id", ["first"])) - 1)


def extents(found: DataFrame, runs: DataFrame, lines_needed: int) -> DataFrame:
    """First and last column that at least so many rows of a staff's band have ink in. Begins and ends of runs are swept in
    order, so nothing is made per column."""
    bands = found.select("page_id", "staff_no", F.floor("first").cast("long").alias("top"), F.ceil("last").cast("long").alias("bottom")).withColumn("y", F.explode(F.sequence("top", "bottom")))
    inside = runs.join(bands, ["page_id", "y"]).select("page_id", "staff_no", "x0", "x1")
    marks = inside.select("page_id", "staff_no", C("x0").alias("x"), F.lit(1).alias("d")).unionAll(inside.select("page_id", "staff_no", C("x1").alias("x"), F.lit(-1).alias("d")))
    steps = marks.groupBy("page_id", "staff_no", "x").agg(F.sum("d").alias("d"))
    w = over(("page_id", "staff_no"), ["x"])
    levels = steps.withColumn("level", F.sum("d").over(upto(w))).withColumn("to", F.lead("x").over(w))
    return levels.filter(C("level") >= lines_needed).groupBy("page_id", "staff_no").agg(F.min("x").alias("left"), (F.max("to") - 1).alias("right"))


def reliable(found: DataFrame, lines: DataFrame, share: float = 0.7) -> DataFrame:
    """Whether a page's staves explain enough of its lines."""
    n_lines, n_staves = lines.groupBy("page_id").agg(F.count("*").alias("lines")), found.groupBy("page_id").agg(F.count("*").alias("staves"))
    both = n_lines.join(n_staves, "page_id", "left").na.fill(0, ["staves"])
    return both.withColumn("reliable", (C("staves") > 0) & (5 * C("staves") >= F.lit(share) * C("lines")))


def otsu(histogram: DataFrame, default: int = 127) -> DataFrame:
    """Per page the level that parts its histogram with the largest variance between the two sides; the first of equals."""
    w = over("page_id", ["level"])
    every = histogram.groupBy("page_id").agg(F.sum("cnt").alias("n"), F.sum(C("cnt") * C("level")).alias("all"))
    rows = histogram.withColumn("low", F.sum("cnt").over(upto(w))).withColumn("low_sum", F.sum(C("cnt") * C("level")).over(upto(w))).join(every, "page_id")
    high = C("n") - C("low")
    apart = C("low_sum") / C("low") - (C("all") - C("low_sum")) / high
    variance = F.when(high > 0, C("low").cast("double") * high * apart * apart)
    best = rows.withColumn("v", variance).groupBy("page_id").agg(F.max_by(F.struct("level", "v"), F.struct("v", -C("level"))).alias("b"))
    return best.select("page_id", F.when(C("b.v") > 0, C("b.level")).otherwise(default).alias("threshold"))


def staff_space(runs: DataFrame, cap: Column) -> DataFrame:
    """Per page the most common gap between ink above and below in one column, up to a cap; of two as common the smaller.
    runs are vertical: column, y0, y1."""
    gap = C("y0") - F.lag("y1").over(over(("page_id", "column"), ["y0", "y1"]))
    gaps = runs.withColumn("gap", gap).filter((C("gap") > 0) & (C("gap") <= cap))
    counts = gaps.groupBy("page_id", "gap").agg(F.count("*").alias("n"))
    return counts.groupBy("page_id").agg(F.max_by("gap", F.struct("n", -C("gap"))).alias("space"))


def long_runs(runs: DataFrame, spaces: DataFrame, times: float = 1.5) -> DataFrame:
    """Horizontal runs of at least three columns and so many staff spaces."""
    return runs.join(spaces, "page_id").filter(C("x1") - C("x0") >= F.greatest(F.lit(3), F.floor(F.lit(times) * C("space") + 0.5)))


def origins(length: Column, window: int, step: int) -> Column:
    """Where overlapping windows begin on an axis; the last is moved back to end with it."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(length.cast("long") - 1, F.lit(0).cast("long")), F.lit(step).cast("long"))
    return F.array_distinct(F.transform(starts, lambda s: F.greatest(F.lit(0).cast("long"), F.least(s, length.cast("long") - window))))


def tiles(pages: DataFrame, window: int, step: int) -> DataFrame:
    """Pages (width, height) cut into overlapping tiles."""
    return pages.select("page_id", F.explode(origins(C("height"), window, step)).alias("y"), origins(C("width"), window, step).alias("xs")).select("page_id", "y", F.explode("xs").alias("x"))


def inked_tiles(pages: DataFrame, runs: DataFrame, window: int, step: int) -> DataFrame:
    """The tiles of pages (width, height) that hold any ink. Which tiles a run touches is a range of their numbers on either axis; in each row of tiles
    these ranges are joined, so that no tile meets a run and rows are in proportion to runs and inked tiles."""

    def upto_place(length: Column, at: Column) -> Column:
        """How many origins of an axis are at or before a place."""
        last = F.greatest(length - window, F.lit(0))
        moved = (last % step > 0) & (F.floor((length - 1) / step) * step > last)
        return F.least(F.greatest(F.floor(at / step) + 1, F.lit(0)), F.floor(last / step) + 1) + F.when(moved & (last <= at), 1).otherwise(0)

    origin = lambda length, i: F.least(i * step, F.greatest(length - window, F.lit(0)))
    r = runs.filter("x1 > x0").join(pages, "page_id")
    first, end = upto_place(C("height"), C("y") - window), upto_place(C("height"), C("y"))
    r = r.filter((C("y") >= 0) & (C("y") < C("height")) & (first < end)).select("page_id", "width", "height", F.explode(F.sequence(first, end - 1)).alias("row"), upto_place(C("width"), C("x0") - window).alias("low"), (upto_place(C("width"), C("x1") - 1) - 1).alias("high"))
    r = r.filter("low <= high").groupBy("page_id", "width", "height", "row", "low").agg(F.max("high").alias("high"))
    w = over(("page_id", "row"), ["low"])
    joined = r.withColumn("part", island(F.coalesce(C("low") > F.max("high").over(before(w)) + 1, F.lit(True)), w)).groupBy("page_id", "width", "height", "row", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return joined.select("page_id", origin(C("height"), C("row")).alias("y"), "width", F.explode(F.sequence("low", "high")).alias("i")).select("page_id", "y", origin(C("width"), C("i")).alias("x"))


def averaged(predictions: DataFrame) -> DataFrame:
    """Overlapping predictions of a cell, an array each, averaged by channel."""
    each = predictions.select("page_id", "cell", F.posexplode("v").alias("channel", "p"))
    return each.groupBy("page_id", "cell", "channel").agg(F.avg(C("p").cast("double")).alias("p"))


def best_class(v: Column) -> Column:
    """The first channel of the largest value."""
    return F.array_position(v, F.array_max(v)) - 1


def coverage(flags: DataFrame, flag: Column) -> DataFrame:
    return flags.groupBy("page_id").agg(F.avg(flag.cast("double")).alias("coverage"))


def dilated(runs: DataFrame, radius: int) -> DataFrame:
    """Runs wider and higher by a radius, overlapping ones joined."""
    grown = runs.select("page_id", F.explode(F.sequence(C("y") - radius, C("y") + radius)).alias("y"), (C("x0") - radius).alias("x0"), (C("x1") + radius).alias("x1"))
    w = over(("page_id", "y"), ["x0", "x1"])
    apart = F.coalesce(C("x0") > F.max("x1").over(before(w)), F.lit(True))
    joined = grown.withColumn("run", island(apart, w))
    return joined.groupBy("page_id", "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def resampled(cells: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Cells (x, y) of a mask at another size; every target cell takes the nearest source cell."""
    return cells.select("page_id", F.floor(C("x") * numerator / denominator).alias("x"), F.floor(C("y") * numerator / denominator).alias("y")).distinct()


def mask_iou(a: DataFrame, b: DataFrame, pages: DataFrame) -> DataFrame:
    """Intersection over union of two masks of cells; two empty ones agree."""
    both = a.select("page_id", "x", "y", F.lit(1).alias("in_a")).join(b.select("page_id", "x", "y", F.lit(1).alias("in_b")), ["page_id", "x", "y"], "full")
    counts = both.groupBy("page_id").agg(F.count_if(C("in_a").isNotNull() & C("in_b").isNotNull()).alias("both"), F.count("*").alias("any"))
    return pages.join(counts, "page_id", "left").select("page_id", F.coalesce(C("both") / C("any"), F.lit(1.0)).alias("iou"))


def resampled_runs(runs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Runs of a mask at a smaller size, in the cells that `resampled` gives."""
    at = lambda c: F.floor(c * numerator / denominator)
    return runs.filter("x1 > x0").select("page_id", at(C("y")).alias("y"), at(C("x0")).alias("x0"), (at(C("x1") - 1) + 1).alias("x1"))


def run_iou(a: DataFrame, b: DataFrame, pages: DataFrame) -> DataFrame:
    """Intersection over union of two masks of runs, which may overlap: both masks' ends of a row are passed over at once, so that rows are in proportion to runs
    and no cell is written out. Two empty ones agree."""
    end = lambda df, x, d_a, d_b: df.select("page_id", "y", C(x).alias("x"), F.lit(d_a).alias("d_a"), F.lit(d_b).alias("d_b"))
    steps = end(a, "x0", 1, 0).unionByName(end(a, "x1", -1, 0)).unionByName(end(b, "x0", 0, 1)).unionByName(end(b, "x1", 0, -1)).groupBy("page_id", "y", "x").agg(F.sum("d_a").alias("d_a"), F.sum("d_b").alias("d_b"))
    w = over(("page_id", "y"), ["x"])
    parts = steps.select("page_id", (F.lead("x").over(w) - C("x")).alias("n"), (F.sum("d_a").over(upto(w)) > 0).alias("in_a"), (F.sum("d_b").over(upto(w)) > 0).alias("in_b"))
    counts = parts.groupBy("page_id").agg(F.sum(F.when(C("in_a") & C("in_b"), C("n")).otherwise(0)).alias("both"), F.sum(F.when(C("in_a") | C("in_b"), C("n"))).alias("any"))
    return pages.join(counts, "page_id", "left").select("page_id", F.coalesce(C("both") / C("any"), F.lit(1.0)).alias("iou"))


def compared_structures(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines (page_id, line_no, center) of two results: whether they are as many, and the largest distance."""
    both = a.select("page_id", "line_no", C("center").alias("ca")).join(b.select("page_id", "line_no", C("center").alias("cb")), ["page_id", "line_no"], "full")
    return both.groupBy("page_id").agg((F.count("ca") == F.count("cb")).alias("same_count"), F.max(F.abs(C("ca") - C("cb"))).alias("deviation"))
