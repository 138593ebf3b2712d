"""Ordered cursors, carried attributes, and the building of events and playback order from elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavework.functions.pitch import diatonic_index, key_alter, pitch_text
from stavework.functions.rhythm import GRID

from .windows import MEASURE, PART, after, before, filled, island, over, upto

C = F.col


def time_cursor(elements: DataFrame, mode: str = "parser", by: tuple = MEASURE) -> DataFrame:
    """Adds cursor (the position before each element) and onset, in divisions. A chord member takes the onset of the last
    note that is no chord member; in parser mode graces do not count as such a note, in diff mode they do. by: what tells measures apart."""
    w = before(over(by, ["elem_idx"]))
    plain = (C("tag") == "note") & ~C("is_chord")
    moves = plain & ~C("is_grace")
    delta = F.when(moves | (C("tag") == "forward"), C("duration")).when(C("tag") == "backup", -C("duration")).otherwise(0)
    out = elements.withColumn("cursor", F.coalesce(F.sum(delta).over(w), F.lit(0)))
    anchor = F.when(moves if mode == "parser" else plain, C("cursor"))
    return out.withColumn("onset", F.when(C("is_chord"), F.coalesce(F.last(anchor, ignorenulls=True).over(w), F.lit(0))).otherwise(C("cursor")))


def content_length(elements: DataFrame) -> DataFrame:
    """The furthest position that a measure reaches, graces left out, forward moves counted."""
    timed = time_cursor(elements.filter(~C("is_grace")))
    reach = F.when(C("tag") == "note", C("onset") + C("duration")).when(C("tag") == "forward", C("cursor") + C("duration"))
    return timed.groupBy(*MEASURE).agg(F.greatest(F.coalesce(F.max(reach), F.lit(0)), F.lit(0)).alias("length"))


def carried_attributes(measures: DataFrame) -> DataFrame:
    """Adds the divisions, fifths, beats and beat type in force; divisions fill backwards to the first declared."""
    w = over(PART, ["measure_idx"])
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = F.first(F.when(C("divisions") > 0, C("divisions")), ignorenulls=True).over(whole)
    values = {"divisions": F.coalesce(filled(C("divisions"), w), first, F.lit(4)), "fifths": F.coalesce(filled(C("fifths"), w), F.lit(0)), "beats": F.coalesce(filled(C("beats"), w), F.lit(4)), "beat_type": F.coalesce(filled(C("beat_type"), w), F.lit(4))}
    return measures.select("*", *[v.alias(f"active_{k}") for k, v in values.items()])


def key_changes(measures: DataFrame) -> DataFrame:
    """Measures, not the first, that declare another key than the one in force before."""
    running = carried_attributes(measures).withColumn("previous", F.lag("active_fifths").over(over(PART, ["measure_idx"])))
    return running.filter((C("measure_idx") > 0) & (C("fifths") != C("previous")))


def chord_islands(elements: DataFrame) -> DataFrame:
    """The notes of single-staff measures with their island: a note and the chord members that follow it."""
    w = over(MEASURE, ["elem_idx"])
    notes = elements.filter("tag = 'note'").withColumn("diatonic", diatonic_index(C("step"), C("octave")))
    starts = ~C("is_chord") | C("is_rest") | F.coalesce(F.lag("is_rest").over(w), F.lit(True))
    return notes.withColumn("island", island(starts, w))


def chords(elements: DataFrame) -> DataFrame:
    """One row an island: rest, grace group or chord, with its notes from low to high; the lowest gives duration, type and
    grace. host is the island that a grace group belongs to: the next that is none, if that is no rest."""
    note = F.struct("diatonic", "elem_idx", "duration", "type", "dot", "is_grace", "slash", pitch_text(C("step"), C("alter"), C("octave")).alias("pitch"))
    groups = chord_islands(elements).groupBy(*MEASURE, "island").agg(F.array_sort(F.collect_list(note)).alias("notes"), F.bool_or("is_rest").alias("is_rest"), F.min("elem_idx").alias("first_elem"))
    low = F.get("notes", F.lit(0))
    out = groups.select("*", F.size("notes").alias("n_notes"), low["duration"].alias("duration"), low["type"].alias("type"), low["dot"].alias("dot"), (~C("is_rest") & low["is_grace"]).alias("is_grace"))
    following = F.first(F.when(~C("is_grace"), F.struct("is_rest", "island")), ignorenulls=True).over(after(over(MEASURE, ["island"])))
    return out.withColumn("next", following).withColumn("host", F.when(C("is_grace") & ~C("next.is_rest"), C("next.island"))).drop("next")


def on_grid(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """The notes with onset, reach (their end) and lasts in units of the grid, whatever divisions are in force; graces last nothing."""
    active = carried_attributes(measures).select(*MEASURE, "active_divisions")
    scaled = lambda c: F.floor(c * GRID / F.coalesce("active_divisions", F.lit(4))).cast("long")
    lasting = F.when(C("is_grace"), 0).otherwise(C("duration"))
    notes = time_cursor(elements).filter("tag = 'note'").join(active, list(MEASURE), "left")
    return notes.withColumns({"reach": scaled(C("onset") + lasting), "lasts": scaled(lasting), "onset": scaled(C("onset"))})


def staff_events(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """One row an event of each staff, over all its voices, on the grid: notes of one onset together, lasting to the next onset and at
    the end to the staff's own end; rests fill a late start, an early end and an empty staff. All that a measure needs is
    windowed by measure, after one exchange."""
    timed, sounds = ~C("is_grace"), ~C("is_grace") & ~C("is_rest")
    groups = on_grid(elements, measures).groupBy(*MEASURE, "staff", "onset").agg(
        F.count_if(timed).alias("n_timed"), F.count_if(sounds).alias("n_notes"), F.max("reach").alias("reach"),
        F.max_by("type", F.when(sounds, F.struct(C("duration"), -C("elem_idx")))).alias("note_type"), F.min_by("type", F.when(timed, C("elem_idx"))).alias("first_type"))
    staff = W.partitionBy(*MEASURE, "staff")
    w = staff.orderBy("onset")
    begins = C("n_timed") > 0
    rows = groups.select(
        *MEASURE, "staff", "onset", "n_notes", F.when(C("n_notes") > 0, C("note_type")).otherwise(C("first_type")).alias("type"), begins.alias("begins"),
        F.max("reach").over(staff).alias("staff_end"), F.greatest(F.max("reach").over(W.partitionBy(*MEASURE)), F.lit(0)).alias("global_end"), (F.sum("n_timed").over(staff) == 0).alias("empty"),
        F.first(F.when(begins, C("onset")), ignorenulls=True).over(after(w)).alias("next"), F.sum(begins.cast("int")).over(upto(w)).alias("nr"), F.row_number().over(w).alias("place"))

    def event(onset: Column, duration: Column, kind: str, n: Column = F.lit(0), type_: Column = F.lit(None)) -> Column:
        return F.struct(onset.cast("long").alias("onset"), duration.cast("long").alias("duration"), n.cast("long").alias("n_notes"), type_.cast("string").alias("type"), F.lit(kind).alias("kind"))

    none, first = F.lit(0), C("place") == 1
    found = F.array(
        F.when(C("begins"), event(C("onset"), F.greatest(F.coalesce("next", "staff_end") - C("onset"), none), "event", C("n_notes"), C("type"))),
        F.when(C("begins") & (C("nr") == 1) & (C("onset") > 0), event(none, C("onset"), "lead")),
        F.when(first & ~C("empty") & (C("staff_end") < C("global_end")), event(C("staff_end"), C("global_end") - C("staff_end"), "tail")),
        F.when(first & C("empty") & (C("global_end") > 0), event(none, C("global_end"), "empty")))
    present = rows.select(*MEASURE, "staff", F.explode(F.array_compact(found)).alias("e")).select(*MEASURE, "staff", "e.*")
    staves = elements.groupBy(*PART).agg(F.max("staff").alias("staves"))
    heard = rows.groupBy(*MEASURE).agg(F.first("global_end").alias("global_end"), F.collect_set("staff").alias("heard")).filter("global_end > 0").join(staves, list(PART))
    silent = heard.select(*MEASURE, "global_end", F.explode(F.array_except(F.sequence(F.lit(1), "staves"), "heard")).alias("staff"))
    return present.unionByName(silent.select(*MEASURE, "staff", event(none, C("global_end"), "empty").alias("e")).select(*MEASURE, "staff", "e.*"))


def multi_staff_parts(elements: DataFrame) -> DataFrame:
    return elements.groupBy(*PART).agg(((F.max("staff") > 1) | (F.count_if(C("tag") == "backup") > 0)).alias("multi_staff"), F.max("staff").alias("staves"))


def first_clefs(clefs: DataFrame, elements: DataFrame) -> DataFrame:
    """The first clef of each staff; by default G2, of the second staff F4."""
    found = clefs.groupBy(*PART, "staff").agg(F.min_by(F.struct("sign", "line"), "measure_idx").alias("c"))
    every = elements.groupBy(*PART).agg(F.max("staff").alias("n")).select(*PART, F.explode(F.sequence(F.lit(1), C("n"))).alias("staff"))
    second = C("staff") == 2
    return every.join(found, [*PART, "staff"], "left").select(*PART, "staff", F.coalesce("c.sign", F.when(second, "F").otherwise("G")).alias("sign"), F.coalesce("c.line", F.when(second, 4).otherwise(2)).alias("line"))


def printed_accidentals(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """The accidental that each note prints: none if its alteration is that of the note before it on the same line or
    space of the measure, or else of the key."""
    keys = carried_attributes(measures).select(*MEASURE, "active_fifths")
    notes = time_cursor(elements).filter("tag = 'note' and not is_rest").join(keys, list(MEASURE))
    w = over((*MEASURE, "step", "octave"), ["onset", F.col("is_grace").desc(), "elem_idx"])
    state = F.coalesce(F.lag("alter").over(w), key_alter(C("step"), C("active_fifths")))
    return notes.withColumn("accidental", F.when(C("alter") == state, "none").when(C("alter") > 0, "sharp").when(C("alter") < 0, "flat").otherwise("natural"))


def note_ids(elements: DataFrame) -> DataFrame:
    """Every note's group number in its measure (graces count, rests do not), its place in the group, and its id."""
    notes = chord_islands(elements).filter(~C("is_rest"))
    index = F.dense_rank().over(over(MEASURE, ["island"])) - 1
    voice = F.row_number().over(over((*MEASURE, "island"), ["diatonic", "elem_idx"])) - 1
    out = notes.withColumn("note_index", index).withColumn("place", voice)
    return out.withColumn("id", F.format_string("p%d-m%d-n%d-v%d", "part_idx", "measure_idx", "note_index", "place"))


def measure_starts(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """Length and start of every measure on the grid, from what it holds."""
    lengths = time_cursor(elements).filter("tag = 'note'").groupBy(*MEASURE).agg(F.max(C("onset") + F.when(C("is_grace"), 0).otherwise(C("duration"))).alias("end"))
    active = carried_attributes(measures).join(lengths, list(MEASURE), "left")
    length = F.floor(F.greatest(F.coalesce("end", F.lit(0)), F.lit(0)) * GRID / C("active_divisions")).cast("long")
    sized = active.withColumn("length", length)
    return sized.withColumn("start", F.coalesce(F.sum("length").over(before(over(PART, ["measure_idx"]))), F.lit(0)))


def playback_order(measures: DataFrame) -> DataFrame:
    """The measures in playing order: each once, and for every end of a repeat that is played t times the measures from the
    latest start before it t - 1 times more."""
    m = measures.select(*MEASURE, "repeat_start", "repeat_times")
    start = F.coalesce(filled(F.when(C("repeat_start"), C("measure_idx")), over(PART, ["measure_idx"])), F.lit(0))
    once = m.select(*MEASURE, C("measure_idx").alias("k1"), F.lit(0).alias("k2"))
    ends = m.withColumn("from", start).filter("repeat_times >= 2")
    passes = ends.select(*PART, C("measure_idx").alias("k1"), "from", F.explode(F.sequence(F.lit(1), C("repeat_times") - 1)).alias("k2"))
    again = passes.select(*PART, "k1", "k2", F.explode(F.sequence("from", "k1")).alias("measure_idx"))
    rows = once.unionByName(again)
    return rows.withColumn("position", F.row_number().over(over(PART, ["k1", "k2", "measure_idx"])) - 1)


def playback_starts(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """Playing start and display start of every position of the playing order, on the grid."""
    sized = measure_starts(elements, measures).select(*MEASURE, "length", C("start").alias("display_start"), "active_divisions")
    order = playback_order(measures).join(sized, list(MEASURE))
    return order.withColumn("playback_start", F.coalesce(F.sum("length").over(before(over(PART, ["position"]))), F.lit(0)))


def playback_timeline(elements: DataFrame, measures: DataFrame) -> DataFrame:
    """Per score and playing onset: the pitches that sound, where they are shown, and the time to the next onset (a quarter
    after the last)."""
    notes = time_cursor(elements).filter("tag = 'note' and not is_rest and not is_grace").select(*MEASURE, "onset", "elem_idx", pitch_text(C("step"), C("alter"), C("octave")).alias("pitch"))
    at = playback_starts(elements, measures).select(*MEASURE, "playback_start", "display_start", "active_divisions")
    shift = F.floor(C("onset") * GRID / C("active_divisions")).cast("long")
    played = notes.join(at, list(MEASURE)).select("score_id", (C("playback_start") + shift).alias("playback"), (C("display_start") + shift).alias("display"), "part_idx", "measure_idx", "elem_idx", "pitch")
    steps = played.groupBy("score_id", "playback").agg(F.min("display").alias("display"), F.count("*").alias("n_pitches"), F.array_join(F.array_sort(F.collect_list("pitch")), " ").alias("pitches"))
    return steps.withColumn("lasts", F.coalesce(F.lead("playback").over(over("score_id", ["playback"])), C("playback") + GRID) - C("playback"))


def spine(elements: DataFrame, measures: DataFrame, least: int = 12, per_division: int = 6, grace_width: int = 8) -> DataFrame:
    """The shared axis of a measure: its distinct onsets on the grid over all parts, each with the widest advance that a note there asks
    for (so much a quarter of a quarter) and the room of its graces, and positions as running sums."""
    by = ("score_id", "measure_idx")
    onsets = on_grid(elements, measures).groupBy(*by, C("onset").alias("div")).agg(F.max("lasts").alias("longest"), F.count_if("is_grace").alias("graces"))
    advance = F.greatest(F.lit(least), F.floor(C("longest") * per_division * 4 / GRID)).cast("long")
    w = over(by, ["div"])
    return onsets.withColumn("x", F.coalesce(F.sum(advance).over(before(w)), F.lit(0)) + F.sum(C("graces") * grace_width).over(upto(w))).withColumn("advance", advance)


def measure_offsets(axis: DataFrame) -> DataFrame:
    """Where each measure's axis begins along its score."""
    widths = axis.groupBy("score_id", "measure_idx").agg(F.max(C("x") + C("advance")).alias("width"))
    return widths.withColumn("left", F.coalesce(F.sum("width").over(before(over("score_id", ["measure_idx"]))), F.lit(0)))


def events_on_spine(events: DataFrame, axis: DataFrame) -> DataFrame:
    """Every staff event with its position on the axis; one that has no onset there takes the last position."""
    at = F.first(F.when(C("is_point"), C("x"))).over(W.partitionBy("score_id", "measure_idx", "onset").orderBy(C("is_point").desc()))
    last = F.max_by(F.when(C("is_point"), C("x")), F.when(C("is_point"), C("onset"))).over(W.partitionBy("score_id", "measure_idx"))
    points = axis.select("score_id", "measure_idx", C("div").alias("onset"), "x", F.lit(True).alias("is_point"))
    rows = points.unionByName(events.withColumn("is_point", F.lit(False)), allowMissingColumns=True)
    return rows.withColumn("x", F.coalesce(at, last)).filter("not is_point").select(*events.columns, "x")


def beam_islands(events: DataFrame, beat: int = GRID) -> DataFrame:
    """Runs of two or more eighths and sixteenths of one staff with no rest between, within a beat of the grid, a quarter."""
    by = (*MEASURE, "staff")
    w = over(by, ["onset", "kind"])
    can = (C("n_notes") > 0) & C("type").isin("eighth", "16th")
    beat_of = F.floor(C("onset") / beat)
    rows = events.withColumn("can", F.coalesce(can, F.lit(False))).withColumn("beat", beat_of)
    rows = rows.withColumn("run", island(~C("can") | ~F.coalesce(F.lag("can").over(w), F.lit(False)) | (C("beat") != F.coalesce(F.lag("beat").over(w), C("beat") - 1)), w))
    runs = rows.filter("can").groupBy(*by, "run").agg(F.count("*").alias("n"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"))
    return runs.filter("n >= 2")


def beams(notes: DataFrame, by: tuple, order: list, beats: Column, beat_type: Column, n_beams: Column, length: Column) -> DataFrame:
    """Beam elements of recognised notes (no chord tails, no graces): begin, continue, end and hooks by level. Compound
    meters beam in threes of eighths. n_beams is 0 for rests; lengths are in quarters of a quarter."""
    w = over(by, order)
    rows = notes.withColumn("n_beams", n_beams).withColumn("start", F.coalesce(F.sum(length).over(before(w)), F.lit(0)))
    size = F.when((beat_type == 8) & (beats % 3 == 0), 6).otherwise(16 / beat_type)
    rows = rows.withColumn("beat", F.floor(C("start") / size))
    opens = (C("n_beams") < 1) | (F.coalesce(F.lag("n_beams").over(w), F.lit(0)) < 1) | (C("beat") != F.lag("beat").over(w))
    rows = rows.withColumn("run", island(F.coalesce(opens, F.lit(True)), w)).filter("n_beams >= 1")
    inside = over((*by, "run"), order)
    rows = rows.withColumn("left", F.lag("n_beams").over(inside)).withColumn("right", F.lead("n_beams").over(inside)).filter("left is not null or right is not null")
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), "n_beams")))
    on_left, on_right = F.coalesce(C("left") >= C("level"), F.lit(False)), F.coalesce(C("right") >= C("level"), F.lit(False))
    return rows.withColumn("beam", F.when(on_left & on_right, "continue").when(on_left, "end").when(on_right, "begin").when(C("left").isNotNull(), "backward hook").otherwise("forward hook"))


def stem_directions(elements: DataFrame, middle: int = 34) -> DataFrame:
    """Up or down by the note of a chord that is farthest from the middle line, of two as far the lower."""
    notes = chord_islands(elements).filter("not is_rest")
    steps = C("diatonic") - middle
    far = F.max_by(steps, F.struct(F.abs(steps), -C("diatonic")))
    return notes.groupBy(*MEASURE, "island").agg(F.when(far <= 0, "up").otherwise("down").alias("stem"), far.alias("steps"))


def barline_styles(measures: DataFrame) -> DataFrame:
    """The barline after every measure, and the one before the first (boundary -1)."""
    m = measures.select(*MEASURE, "repeat_start", C("repeat_times").isNotNull().alias("ends"))
    opening = m.filter("measure_idx = 0").select(*PART, F.lit(-1).alias("measure_idx"), F.lit(False).alias("repeat_start"), F.lit(False).alias("ends"))
    w = over(PART, ["measure_idx"])
    starts = F.coalesce(F.lead("repeat_start").over(w), F.lit(False))
    return m.unionByName(opening).withColumn("style", F.when(C("ends") & starts, "repeatBoth").when(C("ends"), "repeatEnd").when(starts, "repeatStart").otherwise("plain"))
