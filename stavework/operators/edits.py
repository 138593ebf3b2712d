"""Batch edits of note tables. A batch applies one edit to a measure; further ones for it are reported as conflicts and wait
for the next batch. What an edit removes or adds, `rewritten` fills up with rests again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavework.functions.pitch import diatonic_index, pitch_from_diatonic
from stavework.functions.rhythm import decomposed, largest_fit

from .cursor import time_cursor
from .windows import MEASURE, PART, before, over, upto

C = F.col
HANDLE = (*MEASURE, "elem_idx")


def one_per_measure(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first edit of every measure, and the others."""
    ranked = edits.withColumn("nr", F.row_number().over(over(MEASURE, ["seq"])))
    return ranked.filter("nr = 1").drop("nr"), ranked.filter("nr > 1").drop("nr")


def removed(elements: DataFrame, handles: DataFrame) -> DataFrame:
    """The elements without the notes of the handles."""
    return elements.join(handles.select(*HANDLE).withColumn("tag", F.lit("note")), [*HANDLE, "tag"], "left_anti")


def timed_notes(elements: DataFrame) -> DataFrame:
    """Sounding notes with their onsets: what a rewrite keeps."""
    return time_cursor(elements).filter("tag = 'note' and not is_rest and not is_grace").drop("cursor")


def rewritten(notes: DataFrame, lengths: DataFrame, divisions: int = 4, graces: DataFrame | None = None) -> DataFrame:
    """Measures written anew from their notes (onset, duration, staff, voice, ord, label): per staff and voice the notes of an
    onset as a chord, the longest first, rests of standard lengths in every gap and up to the measure's length, and a
    step back between voices. lengths: the measures' lengths. graces (elem_idx, host_elem, label) go before the chord of their host, whose ord
    is host_elem; those without a host among the notes go with it."""
    by = (*MEASURE, "staff", "voice")
    place = F.row_number().over(over((*by, "onset"), [C("duration").desc(), "ord"]))
    placed = notes.select(*by, "onset", "duration", "ord", "label").withColumn("place", place)
    groups = placed.groupBy(*by, "onset").agg(F.max(C("onset") + C("duration")).alias("end"))
    reached = F.greatest(F.coalesce(F.max("end").over(before(over(by, ["onset"]))), F.lit(0)), F.lit(0))
    gaps = groups.withColumn("from", reached).filter(C("onset") > C("from")).select(*by, C("from"), C("onset").alias("to"))
    last = groups.groupBy(*by).agg(F.greatest(F.max("end"), F.lit(0)).alias("from")).join(lengths, list(MEASURE)).filter(C("length") > C("from")).select(*by, "from", C("length").alias("to"))
    filler = gaps.unionByName(last).select(*by, C("from").alias("onset"), F.posexplode(decomposed(C("to") - C("from"), F.lit(float(divisions)), True)).alias("place", "duration"))
    rests = filler.select(*by, C("onset").cast("long"), C("duration").cast("long"), C("place").cast("int"), F.lit("rest").alias("label"), F.lit(False).alias("is_chord"), F.lit("note").alias("tag"))
    sounding = placed.select(*by, C("onset").cast("long"), C("duration").cast("long"), C("place").cast("int"), "label", (C("place") > 1).alias("is_chord"), F.lit("note").alias("tag"))
    voices = groups.select(*by).distinct().withColumn("first", F.row_number().over(over(MEASURE, ["staff", "voice"])) == 1).filter("not first").join(lengths, list(MEASURE))
    back = voices.select(*by, F.lit(-1).cast("long").alias("onset"), C("length").cast("long").alias("duration"), F.lit(0).alias("place"), F.lit("backup").alias("label"), F.lit(False).alias("is_chord"), F.lit("backup").alias("tag"))
    rows = rests.unionByName(sounding).unionByName(back).withColumn("is_grace", F.lit(False))
    if graces is not None:
        hosts = placed.select(*by, "onset", C("ord").alias("host_elem"), C("place").alias("host_place"))
        led = graces.select(*MEASURE, "elem_idx", "host_elem", C("label").alias("label")).join(hosts, [*MEASURE, "host_elem"])
        # They have places before 1, in order of their hosts' places and then as they stood.
        place = F.row_number().over(over((*by, "onset"), ["host_place", "elem_idx"])) - F.count("*").over(W.partitionBy(*by, "onset"))
        led = led.select(*by, C("onset").cast("long").alias("onset"), F.lit(0).cast("long").alias("duration"), place.cast("int").alias("place"), "label", F.lit(False).alias("is_chord"), F.lit("note").alias("tag"), F.lit(True).alias("is_grace"))
        rows = rows.unionByName(led)
    return rows.withColumn("elem_idx", F.row_number().over(over(MEASURE, ["staff", "voice", "onset", C("label") == "rest", "place"])) - 1)


def added(notes: DataFrame, requests: DataFrame, lengths: DataFrame, divisions: int = 4) -> DataFrame:
    """New notes (at, staff, wanted): the onset is moved into the measure, the duration is the largest standard one that is
    wanted and ends by the next onset of the staff."""
    inside = requests.join(lengths, list(MEASURE)).withColumn("onset", F.greatest(F.least(C("at"), C("length") - 1), F.lit(0)))
    onsets = notes.select(*MEASURE, "staff", C("onset").alias("other")).distinct()
    near = inside.join(onsets, [*MEASURE, "staff"], "left").groupBy(*MEASURE, "seq", "staff", "onset", "wanted", "length").agg(F.min(F.when(C("other") > C("onset"), C("other"))).alias("next"))
    room = F.coalesce("next", "length") - C("onset")
    return near.withColumn("duration", largest_fit(F.least(C("wanted"), room), F.lit(float(divisions))))


def moved(notes: DataFrame, requests: DataFrame, lengths: DataFrame, divisions: int = 4, graces: DataFrame | None = None) -> DataFrame:
    """Notes of the handles at another measure (to_measure) and onset (at), in their own staff and voice: removed where they
    were, added where they go. With graces (elem_idx, host_elem) also those that go along: an array of their elements, in order."""
    found = requests.join(notes.select(*HANDLE, "staff", "voice", C("duration").alias("wanted"), "label"), list(HANDLE))
    target = found.select(*PART, C("to_measure").alias("measure_idx"), C("measure_idx").alias("from_measure"), "elem_idx", "seq", "at", "staff", "voice", "wanted", "label")
    kept = notes.join(requests.select(*HANDLE), list(HANDLE), "left_anti")
    placed = added(kept, target.select(*MEASURE, "seq", "at", "staff", "wanted"), lengths, divisions).select(*MEASURE, "seq", "onset", "duration")
    out = target.join(placed, [*MEASURE, "seq"]).select(*MEASURE, "seq", "from_measure", "elem_idx", "staff", "voice", "onset", "duration", "label")
    if graces is None:
        return out
    led = graces.groupBy(*PART, C("measure_idx").alias("from_measure"), C("host_elem").alias("elem_idx")).agg(F.array_sort(F.collect_list("elem_idx")).alias("graces"))
    return out.join(led, [*PART, "from_measure", "elem_idx"], "left").withColumn("graces", F.coalesce("graces", F.array().cast("array<int>")))


def set_durations(notes: DataFrame, requests: DataFrame, lengths: DataFrame) -> DataFrame:
    """The chord of a handle, in its voice, gets a wanted duration, not beyond the next onset of that voice and staff."""
    by = [*MEASURE, "staff", "voice"]
    ahead = notes.select(*by, "onset").distinct().withColumn("next", F.lead("onset").over(over(tuple(by), ["onset"])))
    chord = requests.join(notes.select(*HANDLE, "staff", "voice", "onset"), list(HANDLE)).select(*by, "onset", "wanted", "seq")
    room = chord.join(ahead, [*by, "onset"]).join(lengths, list(MEASURE))
    sized = room.withColumn("new_duration", F.greatest(F.least(C("wanted"), F.coalesce("next", F.greatest("length", C("onset") + 1)) - C("onset")), F.lit(1))).select(*by, "onset", "new_duration")
    return notes.join(sized, [*by, "onset"]).select(*HANDLE, "new_duration")


def set_pitches(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Elements with the steps, alterations and octaves that the requests name; null keeps the old value."""
    r = requests.select(*HANDLE, C("step").alias("r_step"), C("alter").alias("r_alter"), C("octave").alias("r_octave"))
    out = elements.join(r, list(HANDLE), "left")
    return out.withColumn("step", F.coalesce("r_step", "step")).withColumn("alter", F.coalesce("r_alter", "alter")).withColumn("octave", F.coalesce("r_octave", "octave"))


def toggled_ties(partners: DataFrame, requests: DataFrame) -> DataFrame:
    """Ties from the handles to the notes after them: removed if there is one in either direction, else added. partners:
    the output of the tie-partner lookup with tie_start and tie_stop."""
    rows = requests.select(*HANDLE).join(partners, list(HANDLE)).filter("ahead is not null")
    other = partners.select(*PART, F.struct("measure_idx", "elem_idx").alias("ahead"), C("tie_stop").alias("other_stop"))
    both = rows.join(other, [*PART, "ahead"])
    tied = C("tie_start") & C("other_stop")
    return both.select(*HANDLE, C("ahead.measure_idx").alias("to_measure"), C("ahead.elem_idx").alias("to_elem"), tied.alias("was_tied"), (~tied).alias("tied"))


def stacked_pitch(notes: DataFrame, requests: DataFrame, above: int) -> DataFrame:
    """Default pitch of a new chord member (above 2) or grace (above 1): so many steps over the top note of the handle's onset,
    of all staves; C5 if there is none."""
    top = notes.withColumn("d", diatonic_index(C("step"), C("octave"))).groupBy(*MEASURE, "onset").agg(F.max("d").alias("top"))
    rows = requests.join(top, [*MEASURE, "onset"], "left").withColumn("new", F.coalesce(C("top") + above, F.lit(35)))
    step, octave = pitch_from_diatonic(C("new"))
    return rows.withColumn("new_step", step).withColumn("new_octave", octave)


def reordered_graces(graces: DataFrame, requests: DataFrame) -> DataFrame:
    """Grace notes (handle, host_elem) whose place among their host's is swapped with the one before."""
    w = over((*MEASURE, "host_elem"), ["elem_idx"])
    ranked = graces.withColumn("place", F.row_number().over(w))
    wanted = ranked.join(requests.select(*HANDLE), list(HANDLE)).filter("place > 1").groupBy(*MEASURE, "host_elem").agg(F.min("place").alias("swap"))
    out = ranked.join(wanted, [*MEASURE, "host_elem"], "left")
    return out.withColumn("new_place", F.when(C("place") == C("swap"), C("place") - 1).when(C("place") == C("swap") - 1, C("place") + 1).otherwise(C("place")))


def set_slashes(graces: DataFrame, requests: DataFrame) -> DataFrame:
    """Grace notes with the slash of the handles' turned over."""
    hit = requests.select(*HANDLE).distinct().withColumn("hit", F.lit(True))
    return graces.join(hit, list(HANDLE), "left").withColumn("slash", F.when(C("hit"), ~C("slash")).otherwise(C("slash")))


def inserted_measures(measures: DataFrame, requests: DataFrame) -> DataFrame:
    """Measures with empty ones put in after those of the requests, and all of them numbered anew from 1."""
    old = measures.select(*PART, "measure_idx", F.lit(0).alias("nth"), F.lit(False).alias("is_new"))
    known = requests.join(measures.select(*MEASURE), list(MEASURE), "left_semi")
    new = known.select(*PART, "measure_idx", F.row_number().over(over(MEASURE, ["seq"])).alias("nth"), F.lit(True).alias("is_new"))
    return old.unionByName(new).withColumn("number", F.row_number().over(over(PART, ["measure_idx", "nth"])))


def undo_runs(log: DataFrame, gap: int) -> DataFrame:
    """Edits (doc_id, seq) with the number of their undo step and its first seq: an edit joins the step of the one before if both have the same key, not
    null, and less than gap lies between. In a log with a column op, edits are its rows of null or ``commit``; an ``undo`` or a ``reset`` between two edits
    parts them, while a ``redo`` after an edit has nothing to do."""
    w = over("doc_id", ["seq"])
    rows = log
    if "op" in log.columns:
        rows = log.withColumn("breaks", F.count_if(C("op").isin("undo", "reset")).over(upto(w))).filter("op is null or op = 'commit'")
    same = F.lag("breaks").over(w) == C("breaks") if "op" in log.columns else F.lit(True)
    joins = (C("coalesce_key") == F.lag("coalesce_key").over(w)) & (C("seq") - F.lag("seq").over(w) < gap) & same
    rows = rows.withColumn("opens", ~F.coalesce(joins, F.lit(False)))
    return rows.withColumn("step", F.count_if("opens").over(upto(w))).withColumn("first_seq", F.last(F.when(C("opens"), C("seq")), ignorenulls=True).over(upto(w))).drop("opens", "breaks")


def undo_steps(log: DataFrame, gap: int) -> DataFrame:
    """The undo steps of `undo_runs`, one row each."""
    return undo_runs(log, gap).groupBy("doc_id", "step").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("edits"), F.first("coalesce_key").alias("coalesce_key"))
