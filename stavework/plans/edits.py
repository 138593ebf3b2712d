"""Queries of batch edits. Edits come from the events; a measure takes its first one."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.functions.pitch import pitch_text
from stavework.operators import cursor as O
from stavework.operators import edits as E
from stavework.operators import lookup as L
from stavework.operators.replay import replayed
from stavework.sources import adapters as A

from .base import Queries
from .ctes import CTES

Q = Queries()
C = F.col
PITCH = "step || repeat('#', greatest(alter_, 0)) || repeat('b', greatest(-alter_, 0)) || octave"
FIT = "coalesce(list_filter([16, 12, 8, 6, 4, 3, 2, 1], lambda x: x <= {})[1], 1)"

CTES |= {
    "edits": "SELECT user_id AS score_id, us AS seq, k % 10 AS measure_idx, (k // 10) % 7 AS elem_idx, k, row_number() OVER (PARTITION BY user_id, k % 10 ORDER BY us) AS nr FROM ev",
    "batch": "SELECT * FROM edits WHERE nr = 1",
    "sounding": f"SELECT score_id, measure_idx, elem_idx, onset, duration, staff, voice, {PITCH} AS label, step, alter_, octave, tie_start, tie_stop FROM timed WHERE tag = 'note' AND NOT is_rest AND NOT is_grace",
    "content": "SELECT score_id, measure_idx, greatest(coalesce(max(CASE tag WHEN 'note' THEN onset + duration WHEN 'forward' THEN cursor_ + duration END), 0), 0) AS length FROM timed WHERE NOT is_grace GROUP BY ALL",
    "left_over": "SELECT s.* FROM sounding s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.score_id = s.score_id AND b.measure_idx = s.measure_idx AND b.elem_idx = s.elem_idx)",
    "voice_groups": "SELECT score_id, measure_idx, staff, voice, onset, max(onset + duration) AS ends FROM left_over GROUP BY ALL",
    "voice_gaps": """SELECT score_id, measure_idx, staff, voice, f, onset AS t FROM (SELECT *, greatest(coalesce(max(ends) OVER (PARTITION BY score_id, measure_idx, staff, voice ORDER BY onset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS f FROM voice_groups) WHERE onset > f
UNION ALL SELECT g.score_id, g.measure_idx, staff, voice, greatest(max(ends), 0), length FROM voice_groups g JOIN content c ON c.score_id = g.score_id AND c.measure_idx = g.measure_idx GROUP BY g.score_id, g.measure_idx, staff, voice, length HAVING length > greatest(max(ends), 0)""",
}


HOSTS = """(SELECT *, first_value(CASE WHEN NOT is_grace THEN elem_idx END IGNORE NULLS) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS h, first_value(CASE WHEN NOT is_grace THEN is_rest END IGNORE NULLS) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hr FROM note_elements WHERE tag = 'note')"""


def led_graces(spark, d):
    """Graces with a host and a label, without those that the batch removes."""
    g = L.grace_runs(A.note_elements(spark, d)).filter("host_elem is not null").withColumn("label", pitch_text(C("step"), C("alter"), C("octave")))
    return g.join(batch(spark, d).select(*E.HANDLE), list(E.HANDLE), "left_anti")


def batch(spark, d):
    e = A.edits(spark, d).withColumn("part_idx", F.lit(0)).withColumn("measure_idx", C("measure_idx").cast("int"))
    return E.one_per_measure(e)[0]


def sounding(spark, d, scores=None):
    return E.timed_notes(A.note_elements(spark, d, scores)).withColumn("ord", C("elem_idx")).withColumn("label", pitch_text(C("step"), C("alter"), C("octave")))


def lengths(spark, d):
    return O.content_length(A.note_elements(spark, d))


def left_over(spark, d):
    return sounding(spark, d).join(batch(spark, d).select(*E.HANDLE), list(E.HANDLE), "left_anti")


def requests(spark, d):
    return batch(spark, d).select(*E.MEASURE, "seq", "elem_idx", (C("k") % 23).alias("at"), (1 + C("k") % 2).alias("staff"), (1 + C("k") % 9).alias("wanted"), ((C("measure_idx") + 1) % 10).alias("to_measure"))


CTES["led"] = f"SELECT g.*, {PITCH} AS label FROM {HOSTS} g WHERE is_grace AND h IS NOT NULL AND NOT hr AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.score_id = g.score_id AND b.measure_idx = g.measure_idx AND b.elem_idx = g.elem_idx)"
H = "score_id:l measure_idx:l elem_idx:l"
Q.add("i0_edit_conflicts", "score_id:l measure_idx:l seq:l", lambda spark, d: E.one_per_measure(A.edits(spark, d).withColumn("part_idx", F.lit(0)))[1], "SELECT score_id, measure_idx, seq FROM edits WHERE nr > 1")
Q.add("i1_removed", f"{H} tag:s", lambda spark, d: E.removed(A.note_elements(spark, d), batch(spark, d)), "SELECT score_id, measure_idx, elem_idx, tag FROM note_elements n WHERE NOT (tag = 'note' AND EXISTS (SELECT 1 FROM batch b WHERE b.score_id = n.score_id AND b.measure_idx = n.measure_idx AND b.elem_idx = n.elem_idx))")
Q.add("i2_added", "score_id:l measure_idx:l onset:l duration:l", lambda spark, d: E.added(sounding(spark, d), requests(spark, d).select(*E.MEASURE, "seq", "at", "staff", "wanted"), lengths(spark, d)),
      f"""SELECT score_id, measure_idx, onset, {FIT.format('least(wanted, coalesce(nxt, length) - onset)')} AS duration FROM (SELECT r.score_id, r.measure_idx, r.seq, r.onset, wanted, length, min(CASE WHEN n.onset > r.onset THEN n.onset END) AS nxt FROM (
      SELECT b.score_id, b.measure_idx, seq, 1 + k % 2 AS staff, 1 + k % 9 AS wanted, length, greatest(least(k % 23, length - 1), 0) AS onset FROM batch b JOIN content c ON c.score_id = b.score_id AND c.measure_idx = b.measure_idx) r
      LEFT JOIN sounding n ON n.score_id = r.score_id AND n.measure_idx = r.measure_idx AND n.staff = r.staff GROUP BY ALL)""")  # fmt: skip
Q.add("i3_moved", "score_id:l measure_idx:l from_measure:l elem_idx:l staff:l voice:l onset:l duration:l label:s graces:s", lambda spark, d: E.moved(sounding(spark, d), requests(spark, d).select(*E.HANDLE, "seq", "at", C("to_measure").cast("int").alias("to_measure")), lengths(spark, d), graces=led_graces(spark, d)).withColumn("graces", F.array_join(C("graces").cast("array<string>"), " ")),
      f"""SELECT score_id, measure_idx, from_measure, elem_idx, staff, voice, onset, {FIT.format('least(wanted, coalesce(nxt, length) - onset)')} AS duration, label, coalesce((SELECT string_agg(g.elem_idx, ' ' ORDER BY g.elem_idx) FROM led g WHERE g.score_id = q.score_id AND g.measure_idx = q.from_measure AND g.h = q.elem_idx), '') AS graces FROM (SELECT r.*, min(CASE WHEN n.onset > r.onset THEN n.onset END) AS nxt FROM (
      SELECT s.score_id, (b.measure_idx + 1) % 10 AS measure_idx, b.measure_idx AS from_measure, b.elem_idx, b.seq, s.staff, s.voice, s.duration AS wanted, s.label, c.length, greatest(least(k % 23, c.length - 1), 0) AS onset
      FROM batch b JOIN sounding s ON s.score_id = b.score_id AND s.measure_idx = b.measure_idx AND s.elem_idx = b.elem_idx JOIN content c ON c.score_id = b.score_id AND c.measure_idx = (b.measure_idx + 1) % 10) r
      LEFT JOIN left_over n ON n.score_id = r.score_id AND n.measure_idx = r.measure_idx AND n.staff = r.staff GROUP BY ALL) q""")  # fmt: skip
Q.add("i4_durations", f"{H} new_duration:l", lambda spark, d: E.set_durations(sounding(spark, d), requests(spark, d).select(*E.HANDLE, "seq", "wanted"), lengths(spark, d)),
      """WITH a AS (SELECT *, lead(onset) OVER (PARTITION BY score_id, measure_idx, staff, voice ORDER BY onset) AS nxt FROM (SELECT DISTINCT score_id, measure_idx, staff, voice, onset FROM sounding)),
      r AS (SELECT s.score_id, s.measure_idx, s.staff, s.voice, s.onset, greatest(least(1 + k % 9, coalesce(nxt, greatest(length, s.onset + 1)) - s.onset), 1) AS nd FROM batch b JOIN sounding s ON s.score_id = b.score_id AND s.measure_idx = b.measure_idx AND s.elem_idx = b.elem_idx
      JOIN a ON a.score_id = s.score_id AND a.measure_idx = s.measure_idx AND a.staff = s.staff AND a.voice = s.voice AND a.onset = s.onset JOIN content c ON c.score_id = s.score_id AND c.measure_idx = s.measure_idx)
      SELECT s.score_id, s.measure_idx, elem_idx, nd AS new_duration FROM sounding s JOIN r ON r.score_id = s.score_id AND r.measure_idx = s.measure_idx AND r.staff = s.staff AND r.voice = s.voice AND r.onset = s.onset""")  # fmt: skip
Q.add("i5_pitches", f"{H} step:s alter_:l octave:l", lambda spark, d: E.set_pitches(A.note_elements(spark, d), batch(spark, d).select(*E.HANDLE, F.when(C("k") % 3 == 0, "G").alias("step"), F.when(C("k") % 3 == 1, (C("k") % 5 - 2).cast("int")).alias("alter"), F.when(C("k") % 3 == 2, 4).alias("octave"))).withColumnRenamed("alter", "alter_"),
      "SELECT n.score_id, n.measure_idx, n.elem_idx, CASE WHEN k % 3 = 0 THEN 'G' ELSE step END AS step, CASE WHEN k % 3 = 1 THEN k % 5 - 2 ELSE alter_ END AS alter_, CASE WHEN k % 3 = 2 THEN 4 ELSE octave END AS octave FROM note_elements n LEFT JOIN batch b ON b.score_id = n.score_id AND b.measure_idx = n.measure_idx AND b.elem_idx = n.elem_idx")


def _ties(spark, d):
    """Only scores with edits are looked through; their partners are made once, for both ends of a tie."""
    notes = sounding(spark, d, A.edits(spark, d).select("score_id").distinct())
    partners = A.once(L.tie_partners(notes.select(*E.HANDLE, "staff", "onset", "step", "alter", "octave", "tie_start", "tie_stop")).select(*E.HANDLE, "ahead", "tie_start", "tie_stop"))
    return E.toggled_ties(partners, batch(spark, d))


Q.add("i6_ties", f"{H} to_measure:l to_elem:l was_tied:b tied:b", _ties,
      """WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY score_id, staff ORDER BY measure_idx, onset) AS rk, measure_idx * 1000 + elem_idx AS h FROM sounding),
      p AS (SELECT a.score_id, a.measure_idx, a.elem_idx, a.tie_start, min(b.h) AS h FROM r a JOIN r b ON b.score_id = a.score_id AND b.staff = a.staff AND b.step = a.step AND b.alter_ = a.alter_ AND b.octave = a.octave AND b.rk = a.rk + 1 GROUP BY ALL)
      SELECT p.score_id, p.measure_idx, p.elem_idx, o.measure_idx AS to_measure, o.elem_idx AS to_elem, p.tie_start AND o.tie_stop AS was_tied, NOT (p.tie_start AND o.tie_stop) AS tied FROM p JOIN batch b ON b.score_id = p.score_id AND b.measure_idx = p.measure_idx AND b.elem_idx = p.elem_idx JOIN r o ON o.score_id = p.score_id AND o.h = p.h""")  # fmt: skip
Q.add("i7_stacked", "score_id:l measure_idx:l onset:l member:s grace:s", lambda spark, d: (lambda n, r: E.stacked_pitch(n, r, 2).select(*E.MEASURE, "onset", F.concat("new_step", C("new_octave").cast("string")).alias("member")).join(E.stacked_pitch(n, r, 1).select(*E.MEASURE, "onset", F.concat("new_step", C("new_octave").cast("string")).alias("grace")), [*E.MEASURE, "onset"]))(sounding(spark, d), batch(spark, d).select(*E.MEASURE, (C("k") % 5).alias("onset"))),
      "SELECT score_id, measure_idx, onset, substr('CDEFGAB', CAST(coalesce(top + 2, 35) % 7 + 1 AS INT), 1) || (coalesce(top + 2, 35) // 7) AS member, substr('CDEFGAB', CAST(coalesce(top + 1, 35) % 7 + 1 AS INT), 1) || (coalesce(top + 1, 35) // 7) AS grace FROM (SELECT b.score_id, b.measure_idx, k % 5 AS onset, (SELECT max(strpos('CDEFGAB', step) - 1 + 7 * octave) FROM sounding s WHERE s.score_id = b.score_id AND s.measure_idx = b.measure_idx AND s.onset = b.k % 5) AS top FROM batch b)")


def _rewritten(spark, d):
    """The elements are made once; the sounding notes, the graces and the lengths read them."""
    e, removed = A.once(A.note_elements(spark, d)), A.once(batch(spark, d).select(*E.HANDLE))
    label = pitch_text(C("step"), C("alter"), C("octave"))
    kept = A.once(E.timed_notes(e).withColumns({"ord": C("elem_idx"), "label": label}).join(removed, list(E.HANDLE), "left_anti"))
    led = L.grace_runs(e).filter("host_elem is not null").withColumn("label", label).join(removed, list(E.HANDLE), "left_anti")
    return E.rewritten(kept, A.once(O.content_length(e)), graces=led)


Q.add("i8_rewritten", "score_id:l measure_idx:l staff:l voice:l onset:l duration:l label:s is_chord:b is_grace:b tag:s", _rewritten,
      """WITH RECURSIVE r AS (SELECT score_id, measure_idx, staff, voice, f, -1 AS nr, CAST(t - f AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS units FROM voice_gaps
      UNION ALL SELECT score_id, measure_idx, staff, voice, f, nr + 1, rest - u, u FROM (SELECT *, CAST(list_filter([16, 12, 8, 6, 4, 3, 2, 1], lambda x: x <= rest)[1] AS BIGINT) AS u FROM r WHERE rest > 0) WHERE u IS NOT NULL)
      SELECT score_id, measure_idx, staff, voice, f AS onset, units AS duration, 'rest' AS label, false AS is_chord, false AS is_grace, 'note' AS tag FROM r WHERE nr >= 0
      UNION ALL SELECT score_id, measure_idx, staff, voice, onset, duration, label, row_number() OVER (PARTITION BY score_id, measure_idx, staff, voice, onset ORDER BY duration DESC, elem_idx) > 1, false, 'note' FROM left_over
      UNION ALL SELECT g.score_id, g.measure_idx, l.staff, l.voice, l.onset, 0, g.label, false, true, 'note' FROM led g JOIN left_over l ON l.score_id = g.score_id AND l.measure_idx = g.measure_idx AND l.elem_idx = g.h
      UNION ALL SELECT v.score_id, v.measure_idx, staff, voice, -1, length, 'backup', false, false, 'backup' FROM (SELECT *, row_number() OVER (PARTITION BY score_id, measure_idx ORDER BY staff, voice) AS nr FROM (SELECT DISTINCT score_id, measure_idx, staff, voice FROM voice_groups)) v JOIN content c ON c.score_id = v.score_id AND c.measure_idx = v.measure_idx WHERE nr > 1""")  # fmt: skip
graces = lambda spark, d: L.grace_runs(A.note_elements(spark, d)).filter("host_elem is not null")
Q.add("i9_grace_order", f"{H} new_place:l", lambda spark, d: E.reordered_graces(graces(spark, d), batch(spark, d)),
      f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY score_id, measure_idx, h ORDER BY elem_idx) AS place FROM {HOSTS} WHERE is_grace AND h IS NOT NULL AND NOT hr),
      s AS (SELECT g.score_id, g.measure_idx, g.h, min(place) AS swap FROM g JOIN batch b ON b.score_id = g.score_id AND b.measure_idx = g.measure_idx AND b.elem_idx = g.elem_idx WHERE place > 1 GROUP BY ALL)
      SELECT g.score_id, g.measure_idx, elem_idx, CASE WHEN place = swap THEN place - 1 WHEN place = swap - 1 THEN place + 1 ELSE place END AS new_place FROM g LEFT JOIN s ON s.score_id = g.score_id AND s.measure_idx = g.measure_idx AND s.h = g.h""")  # fmt: skip
Q.add("i9_grace_slashes", f"{H} slash:b", lambda spark, d: E.set_slashes(graces(spark, d), batch(spark, d)), f"SELECT g.score_id, g.measure_idx, g.elem_idx, CASE WHEN b.k IS NULL THEN slash ELSE NOT slash END AS slash FROM {HOSTS} g LEFT JOIN batch b ON b.score_id = g.score_id AND b.measure_idx = g.measure_idx AND b.elem_idx = g.elem_idx WHERE is_grace AND h IS NOT NULL AND NOT hr")
Q.add("i10_inserted_measures", "score_id:l number:l measure_idx:l is_new:b", lambda spark, d: E.inserted_measures(A.measures(spark, d), batch(spark, d)),
      "SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY measure_idx, nth) AS number FROM (SELECT score_id, measure_idx, 0 AS nth, false AS is_new FROM measures UNION ALL SELECT b.score_id, b.measure_idx, 1, true FROM batch b JOIN measures m ON m.score_id = b.score_id AND m.measure_idx = b.measure_idx)")
Q.add("i11_undo_steps", "doc_id:l first_seq:l last_seq:l edits:l coalesce_key:s", lambda spark, d: E.undo_steps(A.edit_log(spark, d), 6 * 3600 * 1_000_000),
      "SELECT doc_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS edits, min(coalesce_key) AS coalesce_key FROM (SELECT *, sum(CASE WHEN coalesce_key = pk AND seq - ps < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM (SELECT *, lag(coalesce_key) OVER w AS pk, lag(seq) OVER w AS ps FROM edit_log WINDOW w AS (PARTITION BY doc_id ORDER BY seq))) GROUP BY doc_id, step")
CTES["history_log"] = "SELECT doc_id, seq, CASE WHEN k % 19 > 0 THEN coalesce_key END AS coalesce_key, CASE WHEN k % 11 = 3 THEN 'undo' WHEN k % 17 = 5 THEN 'reset' WHEN k % 7 = 2 THEN 'redo' END AS op FROM edit_log"
HISTORY = """SELECT doc_id, seq, step, max(CASE WHEN opens = 1 THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq) AS first_seq FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM (
  SELECT doc_id, seq, CASE WHEN coalesce_key = lag(coalesce_key) OVER w AND seq - lag(seq) OVER w < 21600000000 AND breaks = lag(breaks) OVER w THEN 0 ELSE 1 END AS opens
  FROM (SELECT *, count(*) FILTER (op IN ('undo', 'reset')) OVER (PARTITION BY doc_id ORDER BY seq) AS breaks FROM history_log) WHERE op IS NULL WINDOW w AS (PARTITION BY doc_id ORDER BY seq)))"""
Q.add("i11_history_runs", "doc_id:l seq:l step:l first_seq:l", lambda spark, d: E.undo_runs(A.with_history(A.edit_log(spark, d)), 6 * 3600 * 1_000_000), HISTORY)


def _log(spark, d):
    """All edits, several of most measures: removed, added, moved, raised, resized."""
    k = C("k")
    op = F.element_at(F.array(*map(F.lit, ("remove", "add", "pitch", "duration", "move"))), (k % 5 + 1).cast("int"))
    return A.edits(spark, d).select("score_id", F.lit(0).alias("part_idx"), C("measure_idx").cast("int"), "seq", op.alias("op"), "elem_idx", (k % 23).alias("at"), (1 + k % 9).alias("wanted"), ((C("measure_idx") + 1) % 10).cast("int").alias("to_measure"), (1 + k % 2).alias("staff"), F.lit(1).alias("voice"),
                                    F.substring(F.lit("CDEFGAB"), k % 7 + 1, F.lit(1)).alias("step"), F.when(k % 3 > 0, k % 3 - 1).otherwise(0).alias("alter"), (3 + k % 3).alias("octave"))


def _replayed(spark, d):
    notes = sounding(spark, d).select(*E.MEASURE, "elem_idx", "onset", "duration", "staff", "voice", "step", "alter", "octave")
    return replayed(A.once(notes), A.once(_log(spark, d)), A.once(lengths(spark, d))).withColumn("pitch", pitch_text(C("step"), C("alter"), C("octave")))


N = "struct_pack(m := {m}, f := {f}, e := {e}, o := {o}, d := {d}, s := {s}, v := {v}, p := {p})"
KEEP = lambda **new: N.format(**{c: new.get(c, f"n.{c}") for c in "mfeodsvp"})
ROOM = "coalesce(list_min(list_transform(list_filter(rest, lambda n: n.m = {m} AND n.s = {s} AND n.o > {at}), lambda n: n.o)), {len}) - {at}"
REPLAY = f"""
WITH RECURSIVE log AS (SELECT e.score_id, e.measure_idx, e.elem_idx, k, seq, c.length AS len, t.length AS to_len, (e.measure_idx + 1) % 10 AS tm, row_number() OVER (PARTITION BY e.score_id, e.measure_idx ORDER BY seq) AS nr
  FROM edits e JOIN content c ON c.score_id = e.score_id AND c.measure_idx = e.measure_idx LEFT JOIN content t ON t.score_id = e.score_id AND t.measure_idx = (e.measure_idx + 1) % 10),
turns AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY seq) AS i FROM log WHERE k % 5 < 4 OR to_len IS NOT NULL),
notes AS (SELECT score_id, list({N.format(m="CAST(measure_idx AS BIGINT)", f="CAST(measure_idx AS BIGINT)", e="CAST(elem_idx AS BIGINT)", o="CAST(onset AS BIGINT)", d="CAST(duration AS BIGINT)", s="CAST(staff AS BIGINT)", v="CAST(voice AS BIGINT)", p="label")}) AS x FROM sounding GROUP BY score_id),
state AS (
  SELECT score_id, CAST(0 AS BIGINT) AS i, coalesce(x, []) AS x FROM (SELECT DISTINCT score_id FROM measures) LEFT JOIN notes USING (score_id) UNION ALL
  SELECT score_id, i, CASE WHEN k % 5 = 0 THEN rest WHEN k % 5 = 1 OR k % 5 = 4 AND own IS NOT NULL THEN list_append(rest, {N.format(m="m", f="CASE WHEN k % 5 = 1 THEN m ELSE own.f END", e="CASE WHEN k % 5 = 1 THEN -nr ELSE own.e END", o="at_", d=FIT.format("least(want, room)"), s="st", v="CASE WHEN k % 5 = 1 THEN 1 ELSE own.v END", p="CASE WHEN k % 5 = 1 THEN said ELSE own.p END")})
    WHEN k % 5 = 2 THEN list_transform(x, lambda n: CASE WHEN n.m = measure_idx AND n.f = measure_idx AND n.e = elem_idx THEN {KEEP(p="said")} ELSE n END)
    WHEN k % 5 = 3 AND own IS NOT NULL THEN list_transform(x, lambda n: CASE WHEN n.m = measure_idx AND n.s = own.s AND n.v = own.v AND n.o = own.o THEN {KEEP(d="greatest(least(1 + k % 9, coalesce(list_min(list_transform(list_filter(x, lambda z: z.m = measure_idx AND z.s = own.s AND z.v = own.v AND z.o > own.o), lambda z: z.o)), greatest(len, own.o + 1)) - own.o), 1)")} ELSE n END) ELSE x END AS x
  FROM (SELECT *, {ROOM.format(m="m", s="st", at="at_", len="size")} AS room FROM (SELECT *, CASE WHEN k % 5 = 1 THEN x ELSE list_filter(x, lambda n: NOT (n.m = measure_idx AND n.f = measure_idx AND n.e = elem_idx)) END AS rest,
      CAST(CASE WHEN k % 5 = 4 THEN tm ELSE measure_idx END AS BIGINT) AS m, CAST(CASE WHEN k % 5 = 1 THEN 1 + k % 2 ELSE own.s END AS BIGINT) AS st, CASE WHEN k % 5 = 1 THEN 1 + k % 9 ELSE own.d END AS want,
      CASE WHEN k % 5 = 4 THEN to_len ELSE len END AS size, CAST(greatest(least(k % 23, CASE WHEN k % 5 = 4 THEN to_len ELSE len END - 1), 0) AS BIGINT) AS at_,
      'CDEFGAB'[k % 7 + 1] || CASE WHEN k % 3 = 2 THEN '#' ELSE '' END || (3 + k % 3) AS said
    FROM (SELECT s.score_id, t.* EXCLUDE (score_id), s.x, list_filter(s.x, lambda n: n.m = t.measure_idx AND n.f = t.measure_idx AND n.e = t.elem_idx)[1] AS own FROM state s JOIN turns t ON t.score_id = s.score_id AND t.i = s.i + 1)))),
ended AS (SELECT score_id, arg_max(x, i) AS x FROM state GROUP BY score_id)
SELECT score_id, n.m AS measure_idx, n.f AS from_measure, n.e AS elem_idx, n.o AS onset, n.d AS duration, n.s AS staff, n.v AS voice, n.p AS pitch FROM (SELECT score_id, unnest(x) AS n FROM ended)"""
Q.add("i1_i5_replayed_log", "score_id:l measure_idx:l from_measure:l elem_idx:l onset:l duration:l staff:l voice:l pitch:s", _replayed, REPLAY)

QUERIES, ORACLES = Q.queries, Q.oracles
