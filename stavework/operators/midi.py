"""MIDI event logs: pairing, keys, graces, bar splitting, chord slots and rests. Positions are ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavework.functions.rhythm import decomposed, half_up, largest_fit, snapped

from .windows import after, before, over, upto

C = F.col
TRACK = ("file_id", "track")
#: A note shorter than this share of a beat may be a grace, and has a slash below the second; a note of at
#: most the third's share of its displayed length is staccato.
GRACE, SLASH, STACCATO = 1 / 8, 1 / 16, 0.5


def tracks(events: DataFrame) -> DataFrame:
    """Tracks with notes: how many, and the last name (an empty one keeps the one before), by default its number."""
    named = F.max_by("text", F.when(C("text") != "", C("seq")))
    found = events.groupBy(*TRACK).agg(F.count_if((C("type") == "noteOn") & (C("velocity") > 0)).alias("notes"), named.alias("name"))
    return found.filter("notes > 0").withColumn("name", F.coalesce("name", F.concat(F.lit("Track "), (C("track") + 1).cast("string"))))


def tempo(events: DataFrame) -> DataFrame:
    """Per file the first tempo in order of tracks, in beats a minute, else 120."""
    us = F.min_by("us_per_beat", F.when(C("us_per_beat").isNotNull(), F.struct("track", "seq")))
    return events.groupBy("file_id").agg(us.alias("us")).select("file_id", F.coalesce(half_up(F.lit(60_000_000) / C("us")), F.lit(120)).alias("bpm"))


def meter(events: DataFrame) -> DataFrame:
    """Per file the last time signature in order of tracks, else 4/4."""
    last = F.max_by(F.struct("num", "den"), F.when(C("num").isNotNull(), F.struct("track", "seq")))
    return events.groupBy("file_id").agg(last.alias("m")).select("file_id", F.coalesce("m.num", F.lit(4)).alias("num"), F.coalesce("m.den", F.lit(4)).alias("den"))


def absolute_ticks(events: DataFrame) -> DataFrame:
    """Adds tick from delta."""
    return events.withColumn("tick", F.sum("delta").over(upto(over(TRACK, ["seq"]))))


def paired_notes(events: DataFrame) -> DataFrame:
    """Notes from the events that begin and end them: the last beginning before an end counts; what has no partner goes."""
    w = over((*TRACK, "note"), ["seq"])
    on = (C("type") == "noteOn") & (C("velocity") > 0)
    rows = events.filter(C("type").isin("noteOn", "noteOff")).select(*TRACK, "note", "seq", "tick", "velocity", on.alias("on"))
    rows = rows.select("*", *[F.lag(c).over(w).alias(f"last_{c}") for c in ("on", "tick", "velocity")])
    return rows.filter(~C("on") & C("last_on")).select(*TRACK, "note", C("last_tick").alias("start"), C("tick").alias("end"), C("last_velocity").alias("velocity"), C("seq").alias("end_seq"))


def keys_by_measure(events: DataFrame, per_measure: int) -> DataFrame:
    """Per file and measure the last key change in it; measure 0 has C major if none."""
    at = F.greatest(F.floor(C("tick") / per_measure), F.lit(0)).cast("long")
    found = events.filter("fifths is not null").groupBy("file_id", at.alias("measure_idx")).agg(F.max_by(F.struct("fifths", "scale"), F.struct("tick", "track", "seq")).alias("k"))
    zero = events.select("file_id").distinct().select("file_id", F.lit(0).cast("long").alias("measure_idx"))
    return found.join(zero, ["file_id", "measure_idx"], "full").select("file_id", "measure_idx", F.coalesce("k.fifths", F.lit(0)).alias("fifths"), F.coalesce("k.scale", F.lit(0)).alias("minor"))


def clefs(notes: DataFrame) -> DataFrame:
    """Bass clef for a track whose upper median note is below middle C."""
    w = over(TRACK, ["note", "start", "end_seq"])
    ranked = notes.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy(*TRACK)))
    return ranked.filter(C("r") == F.floor(C("n") / 2) + 1).select(*TRACK, C("note").alias("median"), F.when(C("note") < 60, "F4").otherwise("G2").alias("clef"))


def graces(notes: DataFrame, per_beat: int, per_measure: int) -> DataFrame:
    """Adds is_grace, slash and main_start. A short note is a grace if what comes before it is a note of normal length or a
    grace itself, and a longer note follows within a measure. Of the short notes of one tick only the lowest can look back
    at another tick, except at the first tick of a track."""
    length = C("end") - C("start")
    order = ["start", "note", "end_seq"]
    w = over(TRACK, order)
    rows = notes.withColumn("short", length < per_beat * GRACE).withColumn("normal", length > per_beat * GRACE)
    main = F.first(F.when(~C("short"), C("start")), ignorenulls=True).over(after(w))
    rows = rows.withColumn("main_start", main).withColumn("tick_no", F.dense_rank().over(over(TRACK, ["start"])))
    rows = rows.withColumn("place", F.row_number().over(over((*TRACK, "start"), ["note", "end_seq"])))
    able = C("short") & (C("main_start") <= C("start") + per_measure) & ((C("place") == 1) | (C("tick_no") == 1))
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    # A tick may hold a chain if the tick before it has a normal note or a grace; any able note of a tick can be that grace.
    ticks = rows.groupBy(*TRACK, "start", "tick_no").agg(F.bool_or("normal").alias("any_normal"), F.bool_or("able").alias("any_able"))
    t = over(TRACK, ["tick_no"])
    seed = F.when((C("tick_no") == 1) | F.coalesce(F.lag("any_normal").over(t), F.lit(False)), C("tick_no"))
    ticks = ticks.withColumn("seed", seed).withColumn("gap", F.when(~C("any_able"), C("tick_no")))
    last_seed, last_gap = F.max("seed").over(upto(t)), F.max("gap").over(before(t))
    ticks = ticks.withColumn("open", last_seed > F.coalesce(last_gap, F.lit(0))).select(*TRACK, "start", "open")
    out = rows.join(ticks, [*TRACK, "start"])
    is_grace = C("able") & C("open")
    return out.withColumn("is_grace", is_grace).withColumn("slash", is_grace & (length < per_beat * SLASH)).withColumn("main_start", F.when(is_grace, C("main_start")))


def quantized(notes: DataFrame, grid: int) -> DataFrame:
    start, end = snapped(C("start"), C("end"), grid)
    return notes.withColumn("q_start", start.cast("long")).withColumn("q_end", end.cast("long"))


def split_at_bars(notes: DataFrame, per_measure: int, start: str = "start", end: str = "end") -> DataFrame:
    """A row for every measure that a note touches, tied to its neighbours; notes without length have none."""
    first, last = F.floor(C(start) / per_measure), F.floor((C(end) - 1) / per_measure)
    rows = notes.filter(C(end) > C(start)).withColumn("measure_idx", F.explode(F.sequence(first, last)))
    bar = C("measure_idx") * per_measure
    return rows.select("*", F.greatest(C(start), bar).alias("part_start"), F.least(C(end), bar + per_measure).alias("part_end"), (C("measure_idx") > first).alias("tie_stop"), (C("measure_idx") < last).alias("tie_start"))


def measure_grid(notes: DataFrame, per_measure: int) -> DataFrame:
    """Every measure of a file, up to its last end, with how many notes begin in it."""
    n = F.ceil(F.max("end") / per_measure)
    every = notes.groupBy("file_id").agg(n.alias("n")).filter("n > 0").select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), C("n") - 1)).alias("measure_idx"))
    begun = notes.groupBy("file_id", F.floor(C("start") / per_measure).alias("measure_idx")).agg(F.count("*").alias("begun"))
    return every.join(begun, ["file_id", "measure_idx"], "left").na.fill(0, ["begun"])


def chord_slots(parts: DataFrame, per_measure: int, grid: int) -> DataFrame:
    """The chords of a track and measure, from parts of quantized notes: displayed length (the largest standard one up to the
    next chord or the bar's end), played length of the lowest note if shorter; in grid units, four to a quarter."""
    by = (*TRACK, "measure_idx")
    low = F.min_by("part_end", F.struct("note", "end_seq"))
    slots = parts.groupBy(*by, C("part_start").alias("start")).agg(low.alias("low_end"), F.count("*").alias("n_notes"))
    space = half_up((F.coalesce(F.lead("start").over(over(by, ["start"])), (C("measure_idx") + 1) * per_measure) - C("start")) / grid)
    slots = slots.withColumn("space", space).withColumn("actual", half_up((C("low_end") - C("start")) / grid))
    four = F.lit(4.0)
    slots = slots.withColumn("display", largest_fit(C("space"), four)).withColumn("rhythmic", largest_fit(F.least("actual", "space"), four))
    return slots.withColumn("play", F.when(C("rhythmic") < C("display"), C("rhythmic")))


def staccato_flags(parts: DataFrame, slots: DataFrame, grid: int) -> DataFrame:
    by = [*TRACK, "measure_idx"]
    joined = parts.join(slots.select(*by, C("start").alias("part_start"), "display"), [*by, "part_start"])
    short = C("part_end") - C("part_start") <= C("display") * grid * STACCATO
    return joined.withColumn("staccato", ~C("tie_start") & ~C("tie_stop") & short)


def slot_rests(slots: DataFrame, per_measure: int, grid: int) -> DataFrame:
    """The rests before, between and after the chords of a measure, as standard lengths."""
    by = (*TRACK, "measure_idx")
    w = over(by, ["start"])
    ended = C("start") + C("display") * grid
    between = slots.select(*by, F.coalesce(F.lag(ended).over(w), C("measure_idx") * per_measure).alias("from"), C("start").alias("to"))
    last = slots.groupBy(*by).agg(F.max_by(ended, "start").alias("from")).select(*by, "from", ((C("measure_idx") + 1) * per_measure).alias("to"))
    gaps = between.unionByName(last).filter(C("to") > C("from"))
    units = half_up((C("to") - C("from")) / grid)
    return gaps.select(*by, "from", F.posexplode(decomposed(units, F.lit(4.0), False)).alias("nr", "units"))


def attached_graces(notes: DataFrame, grid: int) -> DataFrame:
    """Graces by the quantized tick of their main note: in chord groups of one raw start, low to high."""
    found = notes.filter("is_grace").withColumn("main_tick", (half_up(C("main_start") / grid) * grid).cast("long"))
    by = (*TRACK, "main_tick")
    group = F.dense_rank().over(over(by, ["start"])) - 1
    place = F.row_number().over(over((*by, "start"), ["note", "end_seq"])) - 1
    return found.withColumn("group_no", group).withColumn("place", place)
