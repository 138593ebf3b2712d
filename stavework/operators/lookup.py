"""Lookups by position: as-of, nearest, covering, partners. Positions are integers; ties go to the first in order.

As-of lookups put probes and points into one table and look back through a window of each block of a score, so no pair of a
probe and a point is made and a long score is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.sources.adapters import once

from .windows import MEASURE, after, before, filled, over, upto

C = F.col
#: Places that are looked through together: about fifty whole notes of the grid.
BLOCK = 1 << 20


def around(points: DataFrame, probes: DataFrame, by: list[str], at: str, value: Column, key: str, ahead: bool = True, block: int = BLOCK) -> DataFrame:
    """Probes with the value of the last point at or before them (back) and, if ahead, that of the first point after them; null if there is none. Of points at one
    place the one with the greatest value counts, ahead the least.

    A key's places are cut into blocks: a window looks within a block, and a window over the blocks, of which each has but its last and first point, carries
    values on to those without. So a key with most of the rows is many tasks."""
    p = points.select(*by, C(at).alias("_at"), value.alias("_point"), F.lit(0).alias("_probe"), F.lit(None).cast(probes.schema[key].dataType).alias(key))
    q = probes.select(*by, C(at).alias("_at"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), F.lit(1).alias("_probe"), key)
    rows = p.unionByName(q).withColumn("_block", F.floor(C("_at") / block)).repartition(*by, "_block")  # dealt out once for the window and the ends
    w, order = over((*by, "_block"), ["_at", "_probe", "_point"]), F.when(C("_point").isNotNull(), F.struct("_at", "_point"))
    ends = rows.groupBy(*by, "_block").agg(F.max_by("_point", order).alias("_last"), F.min_by("_point", order).alias("_first"))
    across = over(tuple(by), ["_block"])
    ends = ends.select(*by, "_block", F.last("_last", ignorenulls=True).over(before(across)).alias("_last"), F.first("_first", ignorenulls=True).over(after(across)).alias("_first"))
    near = {"back": filled(C("_point"), w)} | ({"ahead": F.first("_point", ignorenulls=True).over(after(w))} if ahead else {})
    got = rows.withColumns(near).filter("_probe = 1").join(ends, [*by, "_block"])
    return got.select(*by, C("_at").alias(at), key, *[F.coalesce(side, carried).alias(side) for side, carried in (("back", "_last"), ("ahead", "_first")) if side in near])


def as_of(points: DataFrame, probes: DataFrame, by: list[str], at: str, value: Column, key: str, block: int = BLOCK) -> DataFrame:
    """Probes with found: the value of the last point at or before them, else null."""
    return around(points, probes, by, at, value, key, False, block).withColumnRenamed("back", "found")


def locate(starts: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """The measure that a position falls into, and the position within it; before the first measure it is the first."""
    found = as_of(starts, probes, ["score_id"], "at", F.struct("measure_idx", "at"), key)
    first = starts.groupBy("score_id").agg(F.min(F.struct("at", "measure_idx")).alias("f"))
    return found.join(first, "score_id").select("score_id", key, "at", F.coalesce("found.measure_idx", "f.measure_idx").alias("measure_idx"), (C("at") - F.coalesce("found.at", "f.at")).alias("inside"))


def nearest_note(notes: DataFrame, probes: DataFrame, key: str, tolerance: int, beat: int, steps: int = 3) -> DataFrame:
    """The note nearest to a position and pitch: four times the distance in beats and the distance in steps, both within
    their tolerance; of equally near ones the first in order. notes: score_id, at, diatonic, ord; distances are compared in beat units.

    A probe looks into a lane for every step within the tolerance, in each at the notes next to it on either side, so that no pair of a probe and a note is made."""
    lanes = notes.groupBy("score_id", C("diatonic").alias("lane"), "at").agg(F.min("ord").alias("ord"))
    wanted = probes.select("score_id", "at", F.struct(C(key).alias("key"), C("diatonic").alias("wanted")).alias("probe"), F.explode(F.sequence(C("diatonic") - steps, C("diatonic") + steps)).alias("lane")).withColumn("lane", C("lane").cast(lanes.schema["lane"].dataType))
    found = around(lanes, wanted, ["score_id", "lane"], "at", F.struct("at", "ord"), "probe")
    hits = found.select("score_id", C("probe.key").alias(key), C("probe.wanted").alias("wanted"), "lane", C("at").alias("p_at"), F.explode(F.array("back", "ahead")).alias("hit")).filter("hit is not null")
    apart, off = F.abs(C("hit.at") - C("p_at")), F.abs(C("lane") - C("wanted"))
    return hits.filter(apart <= tolerance).groupBy("score_id", key).agg(F.min(F.struct((4 * apart + beat * off).alias("cost"), "hit.ord", "hit.at", C("lane").alias("diatonic"))).alias("m")).select("score_id", key, "m.ord", "m.at", "m.diatonic", "m.cost")


def nearest_within(points: DataFrame, probes: DataFrame, by: list[str], key: str, tolerance: int, value: Column) -> DataFrame:
    """The nearest point on either side, of two as near the earlier, within the tolerance. value begins with the position."""
    both = around(points, probes, by, "at", value, key)
    d1, d2 = C("at") - C("back.at"), C("ahead.at") - C("at")
    pick = F.when(C("back").isNull() | (d2 < d1), C("ahead")).otherwise(C("back"))
    out = both.withColumn("hit", pick).withColumn("distance", F.abs(C("hit.at") - C("at")))
    return out.filter(C("distance") <= tolerance)


def exact_slots(slots: DataFrame, probes: DataFrame, by: list[str]) -> DataFrame:
    return probes.join(slots, by)


def slots(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Every chord and rest (its onset on the grid) with its absolute position. starts: score_id, measure_idx, start."""
    keys = ["score_id", "measure_idx"]
    return events.join(starts.select(*keys, "start"), keys).withColumn("at", C("start") + C("onset"))


def nearest_axis_point(axis: DataFrame, offsets: DataFrame, starts: DataFrame, probes: DataFrame, key: str, per_unit: Column, margin: int) -> DataFrame:
    """The musical position of a place along a score: the measure by where it begins, then the axis point nearest to it,
    not later than a margin before the measure's end."""
    in_measure = as_of(offsets.select("score_id", C("left").alias("x"), "measure_idx"), probes, ["score_id"], "x", F.struct("measure_idx", C("x").alias("left")), key)
    first = offsets.groupBy("score_id").agg(F.min_by(F.struct("measure_idx", "left"), "measure_idx").alias("f"))
    placed = in_measure.join(first, "score_id").withColumn("m", F.coalesce("found", "f")).select("score_id", key, C("m.measure_idx").alias("measure_idx"), (C("x") - C("m.left")).alias("at"))
    near = nearest_within(axis.select("score_id", "measure_idx", C("x").alias("at"), "div"), placed, ["score_id", "measure_idx"], key, 1 << 40, F.struct("at", "div"))
    out = near.join(starts, ["score_id", "measure_idx"])
    beat = C("start") + per_unit
    return out.withColumn("beat", F.greatest(C("start"), F.least(beat, C("start") + C("length") - margin)))


def interpolated(axis: DataFrame, probes: DataFrame, by: list[str], key: str) -> DataFrame:
    """x at a position between two axis points, in proportion; outside them the nearest end."""
    w = over(tuple(by), ["at"])
    points = axis.withColumn("n_at", F.lead("at").over(w)).withColumn("n_x", F.lead("x").over(w))
    found = as_of(points, probes, by, "at", F.struct("at", "x", "n_at", "n_x"), key)
    ends = axis.groupBy(*by).agg(F.min_by("x", "at").alias("first_x"))
    f = C("found")
    inside = f["x"] + (f["n_x"] - f["x"]) * ((C("at") - f["at"]) / (f["n_at"] - f["at"]))
    return found.join(ends, by).withColumn("x", F.when(f.isNull(), C("first_x")).when(f["n_at"].isNull(), f["x"]).otherwise(inside).cast("double"))


def top_first(notes: DataFrame) -> DataFrame:
    """A chord's notes from high to low."""
    return notes.withColumn("top", F.row_number().over(over((*MEASURE, "island"), [C("diatonic").desc(), "elem_idx"])) - 1)


def tie_partners(notes: DataFrame, keep: Callable[[DataFrame], DataFrame] = once) -> DataFrame:
    """For each note the first of equal pitch at the next distinct onset of its staff, and the last at the one before. Onsets are ranked within
    their measure; only measures, with how many onsets they have, are counted through a staff. keep writes the ranked notes, which are read twice; after
    that they are dealt out for their measures and for their pitches, and no pair of notes is made."""
    staff = ("score_id", "part_idx", "staff")
    inner = keep(notes.withColumn("rank", F.dense_rank().over(over((*MEASURE, "staff"), ["onset"]))))
    sizes = inner.groupBy(*staff, "measure_idx").agg(F.max("rank").alias("n"))
    begins = sizes.select(*staff, "measure_idx", F.coalesce(F.sum("n").over(before(over(staff, ["measure_idx"]))), F.lit(0)).alias("begin"))
    ranked = inner.join(begins, [*staff, "measure_idx"]).withColumn("rank", C("rank") + C("begin")).drop("begin")
    w, place = over((*staff, "step", "alter", "octave"), ["rank"]), F.struct("measure_idx", "elem_idx")
    return ranked.withColumns({"ahead": F.min(place).over(w.rangeBetween(1, 1)), "behind": F.max(place).over(w.rangeBetween(-1, -1))})


def grace_runs(elements: DataFrame) -> DataFrame:
    """Grace notes with the note that follows their run: its host."""
    w = over(MEASURE, ["elem_idx"])
    notes = elements.filter("tag = 'note'")
    host = F.first(F.when(~C("is_grace"), F.struct("elem_idx", "is_rest")), ignorenulls=True).over(after(w))
    group = F.sum((~C("is_chord")).cast("int")).over(upto(w))
    return notes.withColumn("host", host).withColumn("grace_group", group).filter("is_grace").withColumn("host_elem", F.when(~C("host.is_rest"), C("host.elem_idx")))


def chord_leads(elements: DataFrame) -> DataFrame:
    """For each note the element that leads its chord: the last one before it that is neither a chord member nor a grace."""
    w = over(MEASURE, ["elem_idx"])
    notes = elements.filter("tag = 'note' and not is_grace")
    return notes.withColumn("lead", F.coalesce(filled(F.when(~C("is_chord"), C("elem_idx")), w), C("elem_idx")))


def linked_by_ink(staves: DataFrame, runs: DataFrame, least: float, left: int, right: int) -> DataFrame:
    """Neighbouring staves (page_id, staff_no, top, bottom) with the share of the rows between them that have ink in a band of
    columns, and whether it is enough."""
    pairs = staves.withColumn("to", F.lead("top").over(over("page_id", ["staff_no"]))).filter("to is not null and to > bottom + 1")
    rows = pairs.select("page_id", "staff_no", F.explode(F.sequence(C("bottom") + 1, C("to") - 1)).alias("y"))
    inked = runs.filter((C("x0") < right) & (C("x1") > left)).select("page_id", "y").distinct().withColumn("ink", F.lit(1))
    share = rows.join(inked, ["page_id", "y"], "left").groupBy("page_id", "staff_no").agg((F.count("ink") / F.count("*")).alias("share"))
    return share.withColumn("linked", C("share") >= least)
