"""Small cases written by hand: the quirks that the operators must keep, and plain loops against the plans."""

import random

import pytest
from pyspark.sql import functions as F

from stavework.functions import rhythm as R
from stavework.operators import cursor as O
from stavework.operators import diff as D
from stavework.operators import midi as M
from stavework.operators import profiles as P
from stavework.operators import tokens as T

ELEMENT = "score_id long, part_idx int, measure_idx int, elem_idx int, tag string, is_chord boolean, is_grace boolean, is_rest boolean, duration int, staff int, voice int, step string, alter int, octave int, type string, dot boolean, slash boolean, tie_start boolean, tie_stop boolean"
MEASURE = "score_id long, part_idx int, measure_idx int, divisions int, fifths int, beats int, beat_type int, repeat_start boolean, repeat_times int"


def elements(spark, items, measure=0):
    """Elements from tuples of (tag, flags, duration, step); flags: c chord, g grace, r rest."""
    rows = [(1, 0, measure, i, tag, "c" in f, "g" in f, "r" in f, d, 1, 1, s, a, 4, "quarter", False, False, False, False) for i, (tag, f, d, s, a) in enumerate(items)]
    return spark.createDataFrame(rows, ELEMENT)


def measures(spark, repeats):
    return spark.createDataFrame([(1, 0, i, None, None, None, None, s, t) for i, (s, t) in enumerate(repeats)], MEASURE)


def note(flags="", duration=4, step="C", alter=0):
    return ("note", flags, duration, step, alter)


def test_chord_member_after_a_grace(spark):
    e = elements(spark, [note(), note("g"), note("c"), ("backup", "", 4, "C", 0), note("c")])
    onsets = {m: [r.onset for r in O.time_cursor(e, m).orderBy("elem_idx").collect()] for m in ("parser", "diff")}
    assert onsets["parser"][2] == 0 and onsets["diff"][2] == 4
    assert onsets["parser"][4] == 0  # keeps the anchor from before the backup


def test_printed_accidentals(spark):
    e = elements(spark, [note(step="F", alter=1), note(step="F", alter=1), note(step="F", alter=0)])
    got = [r.accidental for r in O.printed_accidentals(e, measures(spark, [(False, None)])).orderBy("elem_idx").collect()]
    assert got == ["sharp", "none", "natural"]


@pytest.mark.parametrize("repeats,order", [
    ([(False, None), (True, None), (False, 2), (False, None)], [0, 1, 2, 1, 2, 3]),
    ([(False, None), (False, 2), (False, None), (False, 2)], [0, 1, 0, 1, 2, 3, 0, 1, 2, 3]),
    ([(False, None), (False, 1)], [0, 1]),
    ([(False, 0), (False, None)], [0, 1]),
])
def test_repeats(spark, repeats, order):
    assert [r.measure_idx for r in O.playback_order(measures(spark, repeats)).orderBy("position").collect()] == order


def test_repeats_against_a_loop(spark):
    rng = random.Random(3)
    for _ in range(5):
        marks = [(rng.random() < 0.3, rng.choice([None, None, 2, 3])) for _ in range(12)]
        order, start, played, i = [], 0, {}, 0
        while i < len(marks):
            order.append(i)
            start = i if marks[i][0] else start
            if marks[i][1]:
                played[i] = played.get(i, 0) + 1
                if played[i] < marks[i][1]:
                    i = start
                    continue
            i += 1
        assert [r.measure_idx for r in O.playback_order(measures(spark, marks)).orderBy("position").collect()] == order


def midi(spark, rows):
    return spark.createDataFrame([(1, 1, n, s, e, 64, i) for i, (n, s, e) in enumerate(rows)], "file_id long, track long, note int, start long, end long, velocity int, end_seq long")


def test_the_second_beginning_counts(spark):
    e = spark.createDataFrame([(1, 1, 60, 1, 0, 50, "noteOn"), (1, 1, 60, 2, 5, 70, "noteOn"), (1, 1, 60, 3, 9, 0, "noteOff")], "file_id long, track long, note int, seq long, tick long, velocity int, type string")
    assert [(r.start, r.end, r.velocity) for r in M.paired_notes(e).collect()] == [(5, 9, 70)]


def test_upper_median_clef(spark):
    assert M.clefs(midi(spark, [(50, 0, 480), (70, 0, 480)])).first().clef == "G2"


def loop_graces(notes, per_beat, per_measure):
    """The rule as a loop: which notes are graces."""
    ordered = sorted(notes, key=lambda n: (n[1], n[0]))
    limit, found = per_beat / 8, set()
    for i, (_, start, end) in enumerate(ordered):
        if end - start >= limit:
            continue
        earlier = [n[1] for n in ordered[:i] if n[1] < start]
        if earlier:
            j, ok = i - 1, False
            while j >= 0 and ordered[j][1] == earlier[-1] and not ok:
                ok = ordered[j][2] - ordered[j][1] > limit or j in found
                j -= 1
            if not ok:
                continue
        if any(e - s >= limit and s <= start + per_measure for _, s, e in ordered[i + 1 :][:1]) or next((s <= start + per_measure for _, s, e in ordered[i + 1 :] if e - s >= limit), False):
            found.add(i)
    return {ordered[i] for i in found}


def test_graces_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(6):
        notes, t = set(), 0
        for _ in range(40):
            t += rng.choice([0, 0, 30, 60, 480])
            notes.add((rng.randint(50, 80), t, t + rng.choice([20, 40, 60, 100, 480])))
        notes = sorted({(n, s): (n, s, e) for n, s, e in notes}.values())
        got = {(r.note, r.start, r.end) for r in M.graces(midi(spark, notes), 480, 1920).filter("is_grace").collect()}
        assert got == loop_graces(notes, 480, 1920)


def test_split_and_merge(spark):
    parts = M.split_at_bars(midi(spark, [(60, 10, 350)]), 100).orderBy("part_start").collect()
    assert [(p.part_start, p.part_end, p.tie_stop, p.tie_start) for p in parts] == [(10, 100, False, True), (100, 200, True, True), (200, 300, True, True), (300, 350, True, False)]


def tokens(spark, rhythms, pitches=None):
    return spark.createDataFrame([(1, 1, i, r, (pitches or {}).get(i, "C4"), ".", ".") for i, r in enumerate(rhythms)], "page_id long, staff_idx long, pos int, rhythm string, pitch string, lift string, slur string")


def test_chord_mark_ends_at_a_barline(spark):
    got = [r.chord for r in T.notes(tokens(spark, ["note_4", "chord", "clef_G2", "note_4", "chord", "barline", "note_4"])).orderBy("pos").collect()]
    assert got == [False, True, False]


def test_opening_attributes_go_past_barlines(spark):
    row = T.opening_attributes(tokens(spark, ["clef_G2", "barline", "keySignature_-2", "note_4"])).first()
    assert (row.clef, row.fifths) == ("G2", -2)


@pytest.mark.parametrize("lengths,beats", [([12, 12, 16, 16], 4), ([12], None), ([14, 14], None)])
def test_meters(spark, lengths, beats):
    names = {12: ("half", True), 16: ("whole", False), 14: None}
    rows = []
    for m, n in enumerate(lengths):
        parts = [names[n]] if names[n] else [("half", True), ("eighth", False)]
        rows += [(1, 1, m, d, dotted, False, False) for d, dotted in parts]
    found = spark.createDataFrame(rows, "page_id long, staff_idx long, measure_idx int, duration string, dotted boolean, chord boolean, grace boolean")
    assert [r.beats for r in T.inferred_meters(found).collect()] == ([beats] if beats else [])


def test_a_pair_takes_the_first_staff_of_a_run(spark):
    staves = spark.createDataFrame([(1, 0, "G", False), (1, 1, "F", True), (1, 2, "G", False)], "page_id long, staff_idx long, sign string, braced boolean")
    assert [r.system_no for r in T.systems(staves).orderBy("staff_idx").collect()] == [0, 0, 1]


def test_tiles(spark):
    assert spark.range(1).select(P.origins(F.lit(10), 4, 3)).first()[0] == [0, 3, 6]


def test_decomposed_spans(spark):
    rows = spark.createDataFrame([(n, float(q)) for n in range(30) for q in (1, 2, 4, 8)], "n long, q double")
    for r in rows.select("n", "q", R.decomposed(F.col("n"), F.col("q"), True).alias("d")).collect():
        assert sum(r.d) == r.n


def test_self_alignment_has_no_differences(spark):
    e = elements(spark, [note(step=s) for s in "CDEFG"])
    s = D.note_stream(e)
    assert D.note_differences(s, s).count() == 0 and D.multiset_differences(s, s).count() == 0


def test_alignment_prefers_pairs():
    assert D.align(list("abc"), list("axc")) == [(0, 0), (1, 1), (2, 2)]
    assert D.align(list("abc"), list("ac")) == [(0, 0), (1, -1), (2, 1)]
    assert D.align([], list("a")) == [(-1, 0)]


def test_expected_twice_found_once(spark):
    row = "score_id long, kind string, value string"
    got = D.checked(spark.createDataFrame([(1, "missed", "3 C4")] * 2, row), spark.createDataFrame([(1, "missed", "3 C4")], row), ["score_id"])
    assert sorted(r.status for r in got.collect()) == ["obsolete", "ok"]


def test_undo_steps(spark):
    from stavework.operators.edits import undo_steps

    log = spark.createDataFrame([(1, t, k) for t, k in ((0, "a"), (50, "a"), (80, "b"), (100, "a"))], "doc_id long, seq long, coalesce_key string")
    assert undo_steps(log, 500).count() == 3


def test_positions_do_not_depend_on_divisions(spark):
    """The same music in 1, 2, 4, 8 and 3 divisions a quarter has the same events, axis and beams on the grid."""
    found = {}
    for d in (1, 2, 4, 8, 3):
        rows = [(1, 0, 0, i, tag, "c" in f, "g" in f, "r" in f, n * d, s, 1, "C", 0, 4, "eighth", False, False, False, False) for i, (tag, f, n, s) in enumerate([("note", "", 1, 1), ("note", "g", 0, 1), ("note", "", 2, 1), ("note", "r", 1, 1), ("backup", "", 4, 1), ("forward", "", 1, 1), ("note", "", 2, 2)])]
        e, m = spark.createDataFrame(rows, ELEMENT), spark.createDataFrame([(1, 0, 0, d, None, None, None, False, None)], MEASURE)
        events = sorted((r.staff, r.onset, r.duration, r.n_notes, r.kind) for r in O.staff_events(e, m).collect())
        axis = sorted((r.div, r.advance, r.x) for r in O.spine(e, m).collect())
        found[d] = events, axis
    assert len({str(x) for x in found.values()}) == 1
    events, axis = found[4]
    q = R.GRID
    assert events == [(1, 0, q, 1, "event"), (1, q, 2 * q, 1, "event"), (1, 3 * q, q, 0, "event"), (2, 0, q, 0, "lead"), (2, q, 2 * q, 1, "event"), (2, 3 * q, q, 0, "tail")]
    assert axis == [(0, 24, 0), (q, 48, 32), (3 * q, 24, 80)]


def test_a_silent_staff_rests_through(spark):
    rows = [(1, 0, m, 0, "note", False, False, False, 4, s, 1, "C", 0, 4, "quarter", False, False, False, False) for m, s in ((0, 2), (1, 1))]
    m = spark.createDataFrame([(1, 0, i, 4, None, None, None, False, None) for i in range(2)], MEASURE)
    got = sorted((r.measure_idx, r.staff, r.duration, r.kind) for r in O.staff_events(spark.createDataFrame(rows, ELEMENT), m).collect())
    assert got == [(0, 1, R.GRID, "empty"), (0, 2, R.GRID, "event"), (1, 1, R.GRID, "event"), (1, 2, R.GRID, "empty")]


def plain_align(a, b):
    """The whole table, filled cell by cell."""
    t = [[-i - j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = max(t[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), t[i - 1][j] - 1, t[i][j - 1] - 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and t[i][j] == t[i - 1][j] - 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


def test_alignment_against_the_whole_table(spark):
    rng = random.Random(6)
    pairs = [([rng.choice("ABC") for _ in range(rng.randrange(20))], [rng.choice("ABC") for _ in range(rng.randrange(20))]) for _ in range(150)]
    for a, b in pairs:
        assert D.align(a, b) == plain_align(a, b)
    # The same through Spark, where equal ends are paired natively.
    tables = [spark.createDataFrame([(n, i, x, 4) for n, pair in enumerate(pairs) for i, x in enumerate(pair[side])], "score_id long, idx int, step string, octave int") for side in (0, 1)]
    got = {}
    for r in D.aligned(*tables).collect():
        got.setdefault(r.score_id, set()).add((-1 if r.s_idx is None else r.s_idx, -1 if r.r_idx is None else r.r_idx))
    assert got == {n: set(plain_align(a, b)) for n, (a, b) in enumerate(pairs) if a or b}


def test_alignment_of_long_sequences():
    rng = random.Random(7)
    a = [rng.randrange(30) for _ in range(5000)]
    b = [x for x in a if rng.random() > 0.05]
    found = D.align(a, b)
    assert sum(j < 0 for _, j in found) == len(a) - len(b) and all(a[i] == b[j] for i, j in found if j >= 0)


def test_a_missing_key_is_no_sharps(spark):
    m = spark.createDataFrame([(1, 0, 0, 4, None, None, None, False, None), (2, 0, 0, 4, 0, 3, 4, False, None)], MEASURE)
    clefs = spark.createDataFrame([], "score_id long, part_idx int, measure_idx int, staff int, sign string, line int")
    got = {r.score_id: (r.fifths, r.time) for r in D.summary(m.withColumn("senza_misura", F.col("score_id") == 1), clefs).collect()}
    assert got == {1: (0, "senza-misura"), 2: (0, "3/4")}


def test_systems_in_independent_pieces(spark):
    """Pieces of a page folded alone against one fold of all staves."""
    rng = random.Random(11)
    rows = [(p, i, rng.choice("GGFC"), rng.random() < 0.3) for p in range(8) for i in range(rng.randrange(1, 14))]
    got = {(r.page_id, r.staff_idx): r.system_no for r in T.systems(spark.createDataFrame(rows, "page_id long, staff_idx long, sign string, braced boolean")).collect()}
    want = {}
    for p in range(8):
        page, i, no = [r for r in rows if r[0] == p], 0, 0
        while i < len(page):
            j = i
            if page[i][3]:
                while j < len(page) and page[j][3]:
                    j += 1
                j = min(j, len(page) - 1) + 1 if j < len(page) else i + 1
            else:
                j = i + 2 if page[i][2] == "G" and i + 1 < len(page) and page[i + 1][2] == "F" else i + 1
            for k in range(i, min(j, len(page))):
                want[p, k] = no
            i, no = j, no + 1
    assert got == want


XML = """<score-partwise><part id="P1"><measure number="7"><attributes><divisions>2</divisions><key><fifths>-3</fifths><mode>minor</mode></key><time><senza-misura/></time><staves>2</staves><clef number="2"><sign>F</sign><line>4</line></clef></attributes>
<barline location="left"><repeat direction="forward"/></barline><note><pitch><step>D</step><octave>5</octave></pitch><duration>4</duration><staff>2</staff><notations><articulations><staccato/></articulations></notations></note>
<note><rest measure="yes"/><duration>4</duration></note><barline><repeat direction="backward"/></barline></measure><measure><barline location="right"><repeat direction="backward" times="3"/></barline></measure></part></score-partwise>"""


def test_a_document_read_and_written(spark):
    from stavework.sources import scores as S

    rows = S.parsed(spark.createDataFrame([(1, XML), (2, "<broken"), (3, None)], "score_id long, text string")).cache()
    m = [r.asDict() for r in S.parsed_measures(rows).orderBy("measure_idx").collect()]
    first = {"number": 7, "divisions": 2, "staves": 2, "fifths": -3, "mode": "minor", "beats": None, "beat_type": None, "senza_misura": True, "repeat_start": True, "repeat_times": 2}
    assert {k: m[0][k] for k in first} == first and (m[1]["number"], m[1]["repeat_start"], m[1]["repeat_times"]) == (1, False, 3)
    notes = rows.filter("tag = 'note'").orderBy("elem_idx").collect()
    assert [(r.staccato, r.play_duration, r.full_measure, r.staff) for r in notes] == [(True, 2, False, 2), (False, 4, True, 1)]
    assert [(r.type, r.note_duration) for r in notes] == [("quarter", 4), ("whole", 4)]
    assert [(c.staff, c.sign, c.line) for c in S.parsed_clefs(rows).collect()] == [(2, "F", 4)]
    assert sorted(r.score_id for r in rows.filter("error is not null").collect()) == [2, 3]
    clefs = S.parsed_clefs(rows).groupBy("score_id", "part_idx", "measure_idx").agg(F.collect_list(F.struct("staff", "sign", "line")).alias("clefs"))
    again = S.parsed(S.exported(rows.filter("tag is not null"), S.parsed_measures(rows).join(clefs, ["score_id", "part_idx", "measure_idx"], "left")))
    key = ["measure_idx", "elem_idx"]
    assert [tuple(r) for r in again.drop("error").orderBy(*key).collect()] == [tuple(r) for r in rows.filter("error is null").drop("error").orderBy(*key).collect()]


def test_notes_that_do_not_say_how_long_they_are(spark):
    """They last 4, but the cursor stays; a grace lasts nothing, and a length that is no number is null."""
    from stavework.sources import scores as S

    notes = "<note/><note><grace/><duration>3</duration></note><note><duration>x</duration></note><note><duration>4.7</duration></note><backup/>"
    rows = S.parsed(spark.createDataFrame([(1, f"<s><part><measure>{notes}</measure></part></s>")], "score_id long, text string")).filter("tag is not null").orderBy("elem_idx").collect()
    assert [(r.tag, r.duration, r.note_duration) for r in rows] == [("note", 0, 4), ("note", 3, 0), ("note", 0, None), ("note", 4, 4), ("backup", 0, None)]


@pytest.mark.parametrize("before,tempo,after", [(None, 99.5, "100"), ("80", 120.0, "120"), ("80", None, None), ("80", -1.0, None), (None, None, None)])
def test_tempo_marks(spark, before, tempo, after):
    from stavework.sources import scores as S

    mark = f'<direction><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>{before}</per-minute></metronome></direction-type><sound tempo="{before}"/></direction>' if before else ""
    text = f'<score-partwise><part><measure><attributes><divisions>4</divisions></attributes><direction><words>dolce</words></direction>{mark}<note/></measure><measure/></part></score-partwise>'
    got = S.with_tempo(spark.createDataFrame([(1, text, tempo)], "score_id long, text string, tempo double")).first().text
    assert got.count('tempo="') == got.count("<per-minute>") == (after is not None) and "dolce" in got
    assert after is None or f'<sound tempo="{after}"/>' in got and f"<per-minute>{after}</per-minute>" in got


def test_streams_of_several_batches(spark, tmp_path):
    """State from batch to batch: the same rows in one file and in five give the same result."""
    from datetime import datetime, timedelta

    from stavework.streaming import stateful

    rng = random.Random(12)
    begin = datetime(2024, 1, 1)
    rows = [(rng.randrange(3), rng.randrange(4), i, i * 10, 60, rng.random() < 0.5, begin + timedelta(minutes=i)) for i in range(200)]
    schema = "track long, note long, seq long, tick long, velocity long, begins boolean, ts timestamp"
    log = [(rng.randrange(3), i * 40 + rng.randrange(900), rng.choice("ab")) for i in range(200)]
    log = sorted(log, key=lambda r: r[1])
    results = {}
    for n in (1, 5):
        for name, data, kind in (("notes", rows, schema), ("log", log, "doc_id long, seq long, coalesce_key string")):
            for k in range(n):
                part = data[len(data) * k // n : len(data) * (k + 1) // n]
                spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}{n}"))
        read = lambda name, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}{n}"))
        notes = stateful.finished(stateful.paired_notes(read("notes", schema).withWatermark("ts", "1 hour"), 10**12), str(tmp_path / f"out_notes{n}"))
        steps = stateful.finished(stateful.undo_steps(read("log", "doc_id long, seq long, coalesce_key string"), 500), str(tmp_path / f"out_log{n}"))
        results[n] = sorted(map(tuple, notes.collect())), sorted(map(tuple, steps.collect()))
    assert results[1] == results[5] and len(results[1][0]) > 20
