"""Replay of edit logs against a loop over all edits of a score."""

import random

from stavework.operators import replay

NOTES = "score_id long, part_idx int, measure_idx int, elem_idx int, onset long, duration long, staff int, voice int, step string, alter int, octave int"
LOG = "score_id long, part_idx int, measure_idx int, seq long, op string, elem_idx int, at int, wanted int, to_measure int, staff int, voice int, step string, alter int, octave int"
LENGTHS = "score_id long, part_idx int, measure_idx int, length int"
STANDARD = (16, 12, 8, 6, 4, 3, 2, 1)


def loop(notes, log, lengths):
    """One edit after the other on one list; a note is [home measure, elem, measure now, onset, duration, staff, voice, pitch]."""
    length = {(s, m): n for s, _, m, n in lengths}
    all_ = [[s, m, e, m, o, d, st, v, (p, a, oc)] for s, _, m, e, o, d, st, v, p, a, oc in notes]
    number = {}

    def place(n, at):
        size = length[n[0], n[3]]
        n[4] = max(min(at, size - 1), 0)
        later = [x[4] for x in all_ if x is not n and x[0] == n[0] and x[3] == n[3] and x[6] == n[6] and x[4] > n[4]]
        room = min([n[5], min(later, default=size) - n[4]])
        n[5] = next((x for x in STANDARD if x <= room), 1)

    for s, _, m, seq, op, e, at, wanted, to, staff, voice, step, alter, octave in sorted(log, key=lambda r: r[3]):
        if (s, m) not in length:
            continue
        number[s, m] = number.get((s, m), 0) + 1
        own = [x for x in all_ if x[0] == s and x[3] == m]
        note = next((x for x in own if x[1] == m and x[2] == e), None)
        if op == "add":
            all_.append([s, m, -number[s, m], m, 0, wanted, staff, voice, (step, alter, octave)])
            place(all_[-1], at)
        elif note and op == "remove":
            all_.remove(note)
        elif note and op == "move" and (s, to) in length:
            note[3] = to
            place(note, at)
        elif note and op == "pitch":
            note[8] = tuple(old if new is None else new for new, old in zip((step, alter, octave), note[8]))
        elif note and op == "duration":
            ends = min([x[4] for x in own if x[6:8] == note[6:8] and x[4] > note[4]], default=max(length[s, m], note[4] + 1))
            onset = note[4]
            for x in own:
                if x[6:8] == note[6:8] and x[4] == onset:
                    x[5] = max(min(wanted, ends - onset), 1)
    return sorted((s, now, m, e, o, d, st, v, *p) for s, m, e, now, o, d, st, v, p in all_)


def random_log(rng, scores=4, measures=4, edits=60):
    notes = [(s, 0, m, e, rng.randrange(12), rng.choice((1, 2, 4)), 1 + rng.randrange(2), 1 + rng.randrange(2), rng.choice("CDEFGAB"), 0, 4) for s in range(scores) for m in range(measures) for e in range(rng.randrange(6))]
    lengths = [(s, 0, m, rng.choice((0, 12, 16))) for s in range(scores) for m in range(measures)]
    log = [(rng.randrange(scores), 0, rng.randrange(measures + 1), 10 * i, rng.choice(["add", "remove", "move", "move", "pitch", "duration"]), rng.randrange(6), rng.randrange(-2, 20), rng.randrange(1, 18), rng.randrange(measures + 1), 1 + rng.randrange(2), 1, rng.choice([*"CDE", None]), rng.choice([1, None]), rng.choice([5, None])) for i in range(edits)]
    log = [(*r[:11], *(("C", 0, 4) if r[4] == "add" else r[11:])) for r in log]
    return notes, log, lengths


def through_spark(spark, notes, log, lengths):
    got = replay.replayed(spark.createDataFrame(notes, NOTES), spark.createDataFrame(log, LOG), spark.createDataFrame(lengths, LENGTHS))
    return sorted((r.score_id, r.measure_idx, r.from_measure, r.elem_idx, r.onset, r.duration, r.staff, r.voice, r.step, r.alter, r.octave) for r in got.collect())


def test_a_log_of_mixed_edits(spark):
    data = random_log(random.Random(1))
    assert through_spark(spark, *data) == loop(*data)


def test_the_fold_without_moves():
    """Hundreds of edits of one measure."""
    rng = random.Random(2)
    for _ in range(30):
        notes, log, _ = random_log(rng, 1, 1, 200)
        log = [r for r in log if r[2] == 0 and (r[4] != "move" or r[8] == 0)]
        lengths = [(0, 0, 0, 16)]
        own = [{"from_measure": r[2], "elem_idx": r[3], "onset": r[4], "duration": r[5], "staff": r[6], "voice": r[7], "step": r[8], "alter": r[9], "octave": r[10]} for r in notes]
        edits = [dict(zip([c.split()[0] for c in LOG.split(", ")], r), nr=k + 1, length=16) for k, r in enumerate(log)]
        left, taken, done = replay.folded(own, edits, 4)
        assert sorted((0, 0, *n.values()) for n in left) == loop(notes, log, lengths) and not taken and done == log[-1][3]


def test_a_note_handed_on_through_measures(spark):
    """A chain: the note goes from measure to measure and back, and is raised at home again; an unknown measure leaves it."""
    notes, lengths = [(1, 0, 0, 0, 0, 4, 1, 1, "C", 0, 4)], [(1, 0, m, 16) for m in range(3)]
    edit = lambda seq, m, op, to=None, step=None: (1, 0, m, seq, op, 0, 8, 4, to, 1, 1, step, None, None)
    log = [edit(1, 0, "move", 1), edit(2, 0, "pitch", step="D"), edit(3, 1, "add", step="G"), edit(4, 0, "move", 9), edit(5, 1, "remove")]
    log = [(*r[:12], 0, 4) if r[4] == "add" else r for r in log]
    assert through_spark(spark, notes, log, lengths) == loop(notes, log, lengths)


def test_no_edits(spark):
    notes, _, lengths = random_log(random.Random(3), 1, 2, 0)
    assert through_spark(spark, notes, [], lengths) == loop(notes, [], lengths)


def test_measures_are_folded_together(spark):
    """Many small measures are rows of common batches, not a call of pandas each, which took some milliseconds a measure."""
    from stavework.operators.replay import replayed

    n = 300
    notes = spark.createDataFrame([(1, 0, m, 0, 0, 4, 1, 1, "C", 0, 4) for m in range(n)], "score_id long, part_idx int, measure_idx int, elem_idx int, onset long, duration long, staff int, voice int, step string, alter int, octave int")
    log = spark.createDataFrame([(1, 0, m, m, "pitch", 0, None, None, None, None, None, "G", None, None) for m in range(n)], "score_id long, part_idx int, measure_idx int, seq long, op string, elem_idx int, at long, wanted long, to_measure int, staff int, voice int, step string, alter int, octave int")
    lengths = spark.createDataFrame([(1, 0, m, 16) for m in range(n)], "score_id long, part_idx int, measure_idx int, length long")
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().toString())
        return df.localCheckpoint()

    rows = replayed(notes, log, lengths, keep=keep).collect()
    assert len(rows) == n and {(r.step, r.alter, r.octave, r.duration) for r in rows} == {("G", 0, 4, 4)}
    assert any("MapInArrow" in p for p in plans) and not any("CoGroup" in p for p in plans)
