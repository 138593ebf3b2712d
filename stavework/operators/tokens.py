"""Recognised token streams: decoding into notes, attributes, repeats, ties, meters, and the assembly of pages and systems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stavework.functions import tokens as T
from stavework.functions.rhythm import note_divisions

from .windows import before, over, upto

C = F.col
STAFF = ("page_id", "staff_idx")


def until_stop(tokens: DataFrame) -> DataFrame:
    """The tokens before a staff's first end or padding, without begin marks."""
    stop = F.sum(C("rhythm").isin("EOS", "PAD").cast("int")).over(upto(over(STAFF, ["pos"])))
    return tokens.withColumn("stop", stop).filter("stop = 0 and rhythm <> 'BOS'").drop("stop")


def measured(tokens: DataFrame) -> DataFrame:
    """Adds class and measure_idx: how many barlines stand before."""
    rows = tokens.withColumn("class", T.token_class(C("rhythm")))
    return rows.withColumn("measure_idx", F.coalesce(F.sum((C("class") == "bar").cast("int")).over(before(over(STAFF, ["pos"]))), F.lit(0)))


def decoded(tokens: DataFrame) -> DataFrame:
    """Adds to every token its parsed parts, and whether it is an emitted note (emitted) with a chord mark before it (chord).
    Barlines, notes and unusable notes end a chord mark, other tokens leave it."""
    rows = measured(tokens)
    note = T.note_token(C("rhythm"))
    is_note = C("class") == "note"
    usable = is_note & note["duration"].isNotNull() & (note["is_rest"] | ~C("pitch").isin(".", "_"))
    rows = rows.select("*", usable.alias("emitted"), *[F.when(is_note, v).alias(k) for k, v in note.items()])
    group = F.when(C("class") == "other", 1).otherwise(0)
    marked = F.lag("class").over(over((*STAFF, "plain"), ["pos"])) == "chord"
    rows = rows.withColumn("plain", group).withColumn("chord", F.coalesce(marked, F.lit(False)) & C("emitted")).drop("plain")
    return rows.withColumn("note_idx", F.coalesce(F.sum(C("emitted").cast("int")).over(before(over(STAFF, ["pos"]))), F.lit(0)))


def notes(tokens: DataFrame) -> DataFrame:
    """The emitted notes, numbered in their staff."""
    pitched = ~C("is_rest")
    return decoded(tokens).filter("emitted").select(
        *STAFF, "note_idx", "pos", F.when(pitched, C("pitch")).otherwise("rest").alias("pitch"), T.accidental(C("lift")).alias("accidental"), "duration", "dotted", "measure_idx", "chord", "grace",
        (pitched & C("slur").isin("slurStart", "slurStart_slurStop")).alias("slur_start"), (pitched & C("slur").isin("slurStop", "slurStart_slurStop")).alias("slur_stop"))


def _first_attributes(rows: DataFrame, *by: str) -> DataFrame:
    """First clef, first key, and the meter if there are exactly two numbers."""
    sign, line = T.clef_token(C("rhythm"))
    rows = rows.select(*by, "pos", F.when(sign.isNotNull(), F.concat(sign, line.cast("string"))).alias("clef"), T.key_token(C("rhythm")).alias("fifths"), T.time_token(C("rhythm")).alias("number"))
    first = lambda c: F.min_by(c, F.when(C(c).isNotNull(), C("pos")))
    numbers = F.array_sort(F.collect_list(F.when(C("number").isNotNull(), F.struct("pos", "number"))))
    out = rows.groupBy(*by).agg(first("clef").alias("clef"), first("fifths").alias("fifths"), numbers.alias("numbers"))
    pair = F.size("numbers") == 2
    return out.select(*by, "clef", "fifths", F.when(pair, F.get("numbers", F.lit(0))["number"]).alias("beats"), F.when(pair, F.get("numbers", F.lit(1))["number"]).alias("beat_type"))


def attribute_changes(tokens: DataFrame) -> DataFrame:
    """What changes before a note that is not a staff's first, gathered since the note before it."""
    rows = decoded(tokens)
    found = _first_attributes(rows.filter("class = 'other'"), *STAFF, "note_idx")
    emitted = rows.filter("emitted and note_idx > 0").select(*STAFF, "note_idx", "measure_idx")
    return found.filter("clef is not null or fifths is not null or beats is not null").join(emitted, [*STAFF, "note_idx"])


def opening_attributes(tokens: DataFrame) -> DataFrame:
    """What stands before a staff's first note or rest, usable or not; barlines do not end it."""
    rows = measured(tokens)
    heard = F.coalesce(F.sum((C("class") == "note").cast("int")).over(upto(over(STAFF, ["pos"]))), F.lit(0))
    found = _first_attributes(rows.withColumn("heard", heard).filter("heard = 0"), *STAFF)
    return tokens.select(*STAFF).distinct().join(found, list(STAFF), "left")


def repeats(tokens: DataFrame) -> DataFrame:
    """Repeat ends mark the measure that they close, starts the one that they open; ends are played twice."""
    rows = measured(tokens)
    ends = rows.filter(C("rhythm").isin("repeatEnd", "repeatEndStart")).select(*STAFF, "measure_idx", F.lit(False).alias("s"))
    starts = rows.filter(C("rhythm").isin("repeatStart", "repeatEndStart")).select(*STAFF, (C("measure_idx") + 1).alias("measure_idx"), F.lit(True).alias("s"))
    return ends.unionByName(starts).groupBy(*STAFF, "measure_idx").agg(F.bool_or("s").alias("repeat_start"), F.when(F.bool_or(~C("s")), 2).alias("repeat_times"))


def paired_ties(rows: DataFrame, by: tuple, order: list, start: str, stop: str) -> DataFrame:
    """Adds tie_start and tie_stop: a stop closes the last start of the same key that is still open."""
    marked = rows.filter(C(start) | C(stop))
    w = over(by, order)
    closes = C(stop) & F.coalesce(F.lag(start).over(w), F.lit(False))
    opens = C(start) & F.coalesce(F.lead(stop).over(w), F.lit(False))
    return marked.withColumn("tie_start", opens).withColumn("tie_stop", closes)


def tie_arcs(rows: DataFrame, by: tuple, order: list, start: str, stop: str, handle: str) -> DataFrame:
    """(first, second) handles of the notes that an arc joins."""
    paired = rows.filter(C(start) | C(stop)).withColumn("first", F.lag(F.when(C(start), C(handle))).over(over(by, order)))
    return paired.filter(C(stop) & C("first").isNotNull()).select(*by, "first", C(handle).alias("second"))


def measure_lengths(found: DataFrame) -> DataFrame:
    """Written length of every measure of a staff, in quarters of a quarter; chord tails and graces do not count."""
    return found.filter("not chord and not grace").groupBy(*STAFF, "measure_idx").agg(F.sum(note_divisions(C("duration"), C("dotted"))).alias("length"))


def inferred_meters(found: DataFrame) -> DataFrame:
    """Per page the most common length over all staves (of two as common the longer), if two measures or more have it and it is
    1 to 12 whole quarters."""
    tally = measure_lengths(found).filter("length > 0").groupBy("page_id", "length").agg(F.count("*").alias("n"))
    best = tally.groupBy("page_id").agg(F.max_by(F.struct("length", "n"), F.struct("n", "length")).alias("m"))
    return best.filter("m.n >= 2 and m.length % 4 = 0 and m.length between 4 and 48").select("page_id", F.floor(C("m.length") / 4).alias("beats"), F.lit(4).alias("beat_type"))


def measure_spans(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg((F.max("measure_idx") + 1).alias("span"))


def page_offsets(found: DataFrame, document) -> DataFrame:
    """Where each page's measures begin in its document: after the spans of all pages before it."""
    spans = measure_spans(found, "page_id").withColumn("doc_id", document)
    return spans.withColumn("offset", F.coalesce(F.sum("span").over(before(over("doc_id", ["page_id"]))), F.lit(0)))


def combined_pages(found: DataFrame, document) -> DataFrame:
    """The rows of all pages with their measures counted through their document."""
    return found.join(page_offsets(found, document).select("page_id", "doc_id", "offset"), "page_id").withColumn("measure_idx", C("measure_idx") + C("offset"))


def staff_attributes(opening: DataFrame, document) -> DataFrame:
    """Per document and place of a staff within its page: its first attributes that are not null, in order of pages."""
    placed = opening.withColumn("doc_id", document).withColumn("place", F.row_number().over(over("page_id", ["staff_idx"])) - 1)
    first = lambda c: F.min_by(c, F.when(C(c).isNotNull(), C("page_id"))).alias(c)
    return placed.groupBy("doc_id", "place").agg(*[first(c) for c in ("clef", "fifths", "beats", "beat_type")])


def top_staff(rows: DataFrame) -> DataFrame:
    """The rows of every page's first staff."""
    first = rows.groupBy("page_id").agg(F.min("staff_idx").alias("staff_idx"))
    return rows.join(first, list(STAFF), "left_semi")


def meters_in_force(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Meter of every measure of a staff: a change holds from the next measure on, and the last one of a measure counts."""
    spans = measure_spans(found, *STAFF).select(*STAFF, F.explode(F.sequence(F.lit(0), (C("span") - 1).cast("int"))).alias("measure_idx"))
    last = changes.filter("beats is not null").groupBy(*STAFF, "measure_idx").agg(F.max_by(F.struct("beats", "beat_type"), "note_idx").alias("m"))
    rows = spans.join(last, [*STAFF, "measure_idx"], "left")
    w = over(STAFF, ["measure_idx"])
    force = F.last("m", ignorenulls=True).over(before(w))
    return rows.withColumn("f", force).select(*STAFF, "measure_idx", C("f.beats").alias("beats"), C("f.beat_type").alias("beat_type"))


def systems(staves: DataFrame) -> DataFrame:
    """Staves (page_id, staff_idx, sign, braced to the next) as systems: a run of braced staves, or treble over bass, or
    one staff. A pair may take the first staff of a run, so staves are folded in order; but where nothing before reaches over a staff, a
    new piece begins, and only a piece is folded in one row."""
    w = over("page_id", ["staff_idx"])
    rows = staves.withColumn("i", F.row_number().over(w) - 1)
    run_end = F.first(F.when(~C("braced"), C("i")), ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    pair = F.coalesce((C("sign") == "G") & (F.lead("sign").over(w) == "F"), F.lit(False))
    rows = rows.withColumn("next", F.when(C("braced"), F.coalesce(run_end, C("i")) + 1).when(pair, C("i") + 2).otherwise(C("i") + 1))
    rows = rows.withColumn("reached", F.coalesce(F.max("next").over(before(w)), F.lit(0)))
    rows = rows.withColumn("piece", F.sum((C("reached") <= C("i")).cast("int")).over(upto(w)))
    pieces = rows.groupBy("page_id", "piece").agg(F.array_sort(F.collect_list(F.struct("i", "next", "staff_idx"))).alias("staves"))
    start = F.struct(F.get("staves", F.lit(0))["i"].cast("int").alias("at"), F.lit(-1).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        begins = x["i"] == s["at"]
        no = F.when(begins, s["no"] + 1).otherwise(s["no"])
        return F.struct(F.when(begins, x["next"]).otherwise(s["at"]).cast("int").alias("at"), no.alias("no"), F.concat(s["out"], F.array(no)).alias("out"))

    numbered = pieces.withColumn("no", F.aggregate("staves", start, step, lambda s: s["out"]))
    earlier = F.coalesce(F.sum(F.array_max("no") + 1).over(before(over("page_id", ["piece"]))), F.lit(0))
    return numbered.withColumn("earlier", earlier).select("page_id", "earlier", F.explode(F.arrays_zip("staves", "no")).alias("z")).select("page_id", C("z.staves.staff_idx").alias("staff_idx"), (C("earlier") + C("z.no")).alias("system_no"))


def rejected_staves(opening: DataFrame) -> DataFrame:
    """Staves without a clef, with the reason; a clef is never guessed."""
    return opening.filter("clef is null").select(*STAFF, F.lit("no clef recognised").alias("reason"))


def full_rests(found: DataFrame, meters: DataFrame | None = None, length: int = 16) -> DataFrame:
    """Measures up to a page's span in which a staff has nothing, with a rest of the measure's length in quarters of a quarter: that of the
    meter in force (meters: staff, measure_idx, beats, beat_type), or else the given one."""
    staves = found.select(*STAFF).distinct()
    every = staves.join(measure_spans(found, "page_id"), "page_id").select(*STAFF, F.explode(F.sequence(F.lit(0), (C("span") - 1).cast("int"))).alias("measure_idx"))
    empty = every.join(found, [*STAFF, "measure_idx"], "left_anti")
    if meters is None:
        return empty.withColumn("duration", F.lit(length))
    # A staff's meter is known up to its own last measure; what follows keeps the last one.
    known = empty.join(meters, [*STAFF, "measure_idx"], "left")
    last = meters.filter("beats is not null").groupBy(*STAFF).agg(F.max_by(F.struct("beats", "beat_type"), "measure_idx").alias("m"), F.max("measure_idx").alias("until"))
    rows = known.join(last, list(STAFF), "left")
    beats = F.coalesce("beats", F.when(C("measure_idx") > C("until"), C("m.beats")))
    beat_type = F.coalesce("beat_type", F.when(C("measure_idx") > C("until"), C("m.beat_type")))
    return rows.select(*STAFF, "measure_idx", F.coalesce(F.floor(16 * beats / beat_type), F.lit(length)).alias("duration"))
