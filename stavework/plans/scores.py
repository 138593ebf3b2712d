"""Queries over score elements: cursors, carried attributes, events, playback, beams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.functions import rhythm as R
from stavework.operators import cursor as O
from stavework.sources import adapters as A

from .base import Queries

Q = Queries()
C = F.col
KM, KE = "score_id:l measure_idx:l", "score_id:l measure_idx:l elem_idx:l"


def el(f, *more):
    """A query of an operator on the elements."""
    return lambda spark, d: f(A.note_elements(spark, d), *more)


def el_me(f):
    """A query of an operator on the elements and the measures."""
    return lambda spark, d: f(A.note_elements(spark, d), A.measures(spark, d))


def me(f):
    return lambda spark, d: f(A.measures(spark, d))


Q.add("c1_time_cursor", f"{KE} cursor:l onset:l", el(O.time_cursor, "parser"), "SELECT score_id, measure_idx, elem_idx, cursor_ AS cursor, onset FROM timed")
Q.add("c2_time_cursor_diff", f"{KE} cursor:l onset:l", el(O.time_cursor, "diff"), "SELECT score_id, measure_idx, elem_idx, cursor_ AS cursor, onset FROM timed_diff")
Q.add("c3_content_length", f"{KM} length:l", el(O.content_length), "SELECT score_id, measure_idx, greatest(coalesce(max(CASE tag WHEN 'note' THEN onset + duration WHEN 'forward' THEN cursor_ + duration END), 0), 0) AS length FROM timed WHERE NOT is_grace GROUP BY ALL")
Q.add("c4_carried_attributes", f"{KM} active_divisions:l active_fifths:l active_beats:l active_beat_type:l", me(O.carried_attributes), "SELECT * FROM active")
Q.add("c5_key_changes", f"{KM} fifths:l previous:l", me(O.key_changes), "SELECT * FROM (SELECT *, lag(active_fifths) OVER (PARTITION BY score_id ORDER BY measure_idx) AS previous FROM active) WHERE measure_idx > 0 AND fifths <> previous")
Q.add("c6_chords", f"{KM} island:l first_elem:l n_notes:l is_rest:b is_grace:b duration:l type:s dot:b pitches:s host:l", lambda spark, d: O.chords(A.note_elements(spark, d)).withColumn("pitches", F.array_join(F.transform("notes", lambda n: n["pitch"]), " ")), "SELECT *, rests AS is_rest, grace_group AS is_grace FROM chord_rows")
Q.add("c7_staff_events", f"{KM} staff:l onset:l duration:l n_notes:l type:s kind:s", el_me(O.staff_events), "SELECT * FROM staff_event_rows")
Q.add("c8_multi_staff", "score_id:l multi_staff:b staves:l", el(O.multi_staff_parts), "SELECT score_id, max(staff) > 1 OR count(*) FILTER (tag = 'backup') > 0 AS multi_staff, max(staff) AS staves FROM note_elements GROUP BY score_id")
Q.add("c9_first_clefs", "score_id:l staff:l sign:s line:l", lambda spark, d: O.first_clefs(A.clefs(spark, d), A.note_elements(spark, d)),
      "SELECT s.score_id, s.staff, coalesce(sign, CASE s.staff WHEN 2 THEN 'F' ELSE 'G' END) AS sign, coalesce(line, CASE s.staff WHEN 2 THEN 4 ELSE 2 END) AS line FROM (SELECT score_id, unnest(range(1, max(staff) + 1)) AS staff FROM note_elements GROUP BY score_id) s LEFT JOIN (SELECT score_id, staff, arg_min(sign, measure_idx) AS sign, arg_min(line, measure_idx) AS line FROM clefs GROUP BY ALL) c ON c.score_id = s.score_id AND c.staff = s.staff")
Q.add("c10_printed_accidentals", f"{KE} accidental:s", el_me(O.printed_accidentals), "SELECT * FROM printed")
Q.add("c11_note_ids", f"{KE} id:s", el(O.note_ids),
      "SELECT score_id, measure_idx, elem_idx, 'p' || part_idx || '-m' || measure_idx || '-n' || (dense_rank() OVER (PARTITION BY score_id, measure_idx ORDER BY island) - 1) || '-v' || (row_number() OVER (PARTITION BY score_id, measure_idx, island ORDER BY diatonic, elem_idx) - 1) AS id FROM islands WHERE NOT is_rest")
Q.add("c12_measure_starts", f"{KM} length:l start:l", el_me(O.measure_starts), "SELECT score_id, measure_idx, length_ AS length, start_ AS start FROM starts")
Q.add("c13_repeat_expansion", "score_id:l position:l measure_idx:l", me(O.playback_order), "SELECT score_id, position, measure_idx FROM play")
Q.add("c14_playback_starts", "score_id:l position:l measure_idx:l playback_start:l display_start:l", el_me(O.playback_starts), "SELECT score_id, position, measure_idx, playback_start, start_ AS display_start FROM play_starts")
Q.add("c15_playback_timeline", "score_id:l playback:l display:l n_pitches:l pitches:s lasts:l", el_me(O.playback_timeline),
      """SELECT *, coalesce(lead(playback) OVER (PARTITION BY score_id ORDER BY playback), playback + 5040) - playback AS lasts FROM (
      SELECT t.score_id, playback_start + CAST(floor(onset * 5040.0 / active_divisions) AS BIGINT) AS playback, min(start_ + CAST(floor(onset * 5040.0 / active_divisions) AS BIGINT)) AS display, count(*) AS n_pitches,
        string_agg(step || repeat('#', greatest(alter_, 0)) || repeat('b', greatest(-alter_, 0)) || octave, ' ' ORDER BY step || repeat('#', greatest(alter_, 0)) || repeat('b', greatest(-alter_, 0)) || octave) AS pitches
      FROM timed t JOIN play_starts p ON p.score_id = t.score_id AND p.measure_idx = t.measure_idx WHERE tag = 'note' AND NOT is_rest AND NOT is_grace GROUP BY 1, 2)""")  # fmt: skip
Q.add("c16_measure_spine", f"{KM} div:l advance:l x:l", el_me(O.spine), "SELECT *, div_ AS div FROM spine_rows")
Q.add("c16_measure_offsets", f"{KM} width:l left:l", lambda spark, d: O.measure_offsets(O.spine(A.note_elements(spark, d), A.measures(spark, d))), 'SELECT *, coalesce(sum(width) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left" FROM (SELECT score_id, measure_idx, max(x + advance) AS width FROM spine_rows GROUP BY ALL)')


def _events_on_spine(spark, d):
    e, m = A.once(A.note_elements(spark, d)), A.once(A.measures(spark, d))
    return O.events_on_spine(O.staff_events(e, m), O.spine(e, m))


Q.add("c17_events_on_spine", f"{KM} staff:l onset:l kind:s x:l", _events_on_spine, "SELECT e.*, coalesce(s.x, l.x) AS x FROM staff_event_rows e LEFT JOIN spine_rows s ON s.score_id = e.score_id AND s.measure_idx = e.measure_idx AND s.div_ = e.onset JOIN (SELECT score_id, measure_idx, arg_max(x, div_) AS x FROM spine_rows GROUP BY ALL) l ON l.score_id = e.score_id AND l.measure_idx = e.measure_idx")
Q.add("c18_beam_islands", f"{KM} staff:l first_onset:l last_onset:l n:l", lambda spark, d: O.beam_islands(O.staff_events(A.note_elements(spark, d), A.measures(spark, d))),
      """SELECT score_id, measure_idx, staff, min(onset) AS first_onset, max(onset) AS last_onset, count(*) AS n FROM (
      SELECT *, sum(CASE WHEN can AND coalesce(lag_can, false) AND beat = lag_beat THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, measure_idx, staff ORDER BY onset, kind) AS run FROM (
      SELECT *, lag(can) OVER w AS lag_can, lag(beat) OVER w AS lag_beat FROM (SELECT *, coalesce(n_notes > 0 AND type IN ('eighth', '16th'), false) AS can, floor(onset / 5040.0) AS beat FROM staff_event_rows) WINDOW w AS (PARTITION BY score_id, measure_idx, staff ORDER BY onset, kind)))
      WHERE can GROUP BY score_id, measure_idx, staff, run HAVING count(*) >= 2""")  # fmt: skip


def _beams(spark, d):
    """Notes of a measure as one stream; the meter in force is the measure's."""
    kept = A.note_elements(spark, d).filter("tag = 'note' and not is_chord and not is_grace")
    meter = O.carried_attributes(A.measures(spark, d)).select(*O.MEASURE, "active_beats", "active_beat_type")
    n = F.when(C("is_rest"), 0).otherwise(R.by_name(C("type"), {"whole": 0, "half": 0, "quarter": 0, "eighth": 1, "16th": 2}))
    length = R.by_name(C("type"), {"whole": 16, "half": 8, "quarter": 4, "eighth": 2, "16th": 1})
    return O.beams(kept.join(meter, list(O.MEASURE)), O.MEASURE, ["elem_idx"], C("active_beats"), C("active_beat_type"), n, length)


Q.add("c19_beams", f"{KE} level:l beam:s", _beams,
      """SELECT score_id, measure_idx, elem_idx, level, CASE WHEN l >= level AND r >= level THEN 'continue' WHEN l >= level THEN 'end' WHEN r >= level THEN 'begin' WHEN has_left THEN 'backward hook' ELSE 'forward hook' END AS beam FROM (
      SELECT *, lag(nb) OVER w IS NOT NULL AS has_left, coalesce(lag(nb) OVER w, 0) AS l, coalesce(lead(nb) OVER w, 0) AS r, count(*) OVER (PARTITION BY score_id, measure_idx, run) AS n FROM (
      SELECT *, sum(CASE WHEN nb >= 1 AND pnb >= 1 AND beat = pbeat THEN 0 ELSE 1 END) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS run FROM (
      SELECT *, lag(nb) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS pnb, lag(beat) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS pbeat FROM (
      SELECT *, floor(pos / CASE WHEN active_beat_type = 8 AND active_beats % 3 = 0 THEN 6 ELSE 16.0 / active_beat_type END) AS beat FROM (
      SELECT e.score_id, e.measure_idx, elem_idx, active_beats, active_beat_type, CASE WHEN is_rest THEN 0 WHEN type = 'eighth' THEN 1 WHEN type = '16th' THEN 2 ELSE 0 END AS nb,
        coalesce(sum(CASE type WHEN 'whole' THEN 16 WHEN 'half' THEN 8 WHEN 'quarter' THEN 4 WHEN 'eighth' THEN 2 ELSE 1 END) OVER (PARTITION BY e.score_id, e.measure_idx ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM note_elements e JOIN active a ON a.score_id = e.score_id AND a.measure_idx = e.measure_idx WHERE tag = 'note' AND NOT is_chord AND NOT is_grace)))) WHERE nb >= 1
      WINDOW w AS (PARTITION BY score_id, measure_idx, run ORDER BY elem_idx)) JOIN (VALUES (1), (2)) AS v(level) ON level <= nb WHERE n > 1""")  # fmt: skip
Q.add("c20_stem_directions", f"{KM} island:l stem:s steps:l", el(O.stem_directions), "SELECT score_id, measure_idx, island, CASE WHEN far <= 0 THEN 'up' ELSE 'down' END AS stem, far AS steps FROM (SELECT score_id, measure_idx, island, arg_max(diatonic - 34, abs(diatonic - 34) * 1000 - diatonic) AS far FROM islands WHERE NOT is_rest GROUP BY ALL)")
Q.add("c21_barline_styles", f"{KM} style:s", me(O.barline_styles),
      "SELECT score_id, measure_idx, CASE WHEN ends AND starts THEN 'repeatBoth' WHEN ends THEN 'repeatEnd' WHEN starts THEN 'repeatStart' ELSE 'plain' END AS style FROM (SELECT score_id, measure_idx, ends, coalesce(lead(repeat_start) OVER (PARTITION BY score_id ORDER BY measure_idx), false) AS starts FROM (SELECT score_id, measure_idx, repeat_start, repeat_times IS NOT NULL AS ends FROM measures UNION ALL SELECT score_id, -1, false, false FROM measures WHERE measure_idx = 0))")

QUERIES, ORACLES = Q.queries, Q.oracles
