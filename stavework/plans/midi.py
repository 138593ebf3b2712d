"""Queries over MIDI event logs. A beat has 3840 ticks, a measure 15360, a grid step 960 (a sixteenth)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.operators import midi as M
from stavework.operators.windows import over
from stavework.sources import adapters as A

from .base import Queries

Q = Queries()
C = F.col
BEAT, MEASURE, GRID = 3840, 15360, 960
KN = "track:l note:l start:l end_seq:l"


def ev(f, *more):
    return lambda spark, d: f(A.midi_events(spark, d), *more)


def notes(spark, d):
    return M.paired_notes(A.midi_events(spark, d))


def parts(spark, d):
    """Regular notes, quantized and split at bars."""
    regular = M.graces(notes(spark, d), BEAT, MEASURE).filter("not is_grace").select("file_id", "track", "note", "start", "end", "velocity", "end_seq")
    return M.split_at_bars(M.quantized(regular, GRID), MEASURE, "q_start", "q_end")


Q.add("a9_tracks", "track:l notes:l name:s", ev(M.tracks), "SELECT track, notes, coalesce(name, 'Track ' || (track + 1)) AS name FROM (SELECT track, count(*) FILTER (type = 'noteOn' AND velocity > 0) AS notes, arg_max(text, seq) FILTER (text <> '') AS name FROM midi_events GROUP BY track) WHERE notes > 0")
Q.add("a10_tempo", "file_id:l bpm:l", ev(M.tempo), "SELECT file_id, coalesce(floor(60000000.0 / arg_min(us_per_beat, (track, seq)) FILTER (us_per_beat IS NOT NULL) + 0.5), 120) AS bpm FROM midi_events GROUP BY file_id")
Q.add("a11_meter", "file_id:l num:l den:l", ev(M.meter), "SELECT file_id, coalesce(arg_max(num, (track, seq)) FILTER (num IS NOT NULL), 4) AS num, coalesce(arg_max(den, (track, seq)) FILTER (num IS NOT NULL), 4) AS den FROM midi_events GROUP BY file_id")
Q.add("d1_absolute_ticks", "track:l seq:l tick:l", lambda spark, d: M.absolute_ticks(A.midi_events(spark, d).withColumn("delta", C("tick") - F.coalesce(F.lag("tick").over(over(M.TRACK, ["seq"])), F.lit(0)))), "SELECT track, seq, tick FROM midi_events")
Q.add("d2_note_pairing", f"{KN} end_tick:l velocity:l", lambda spark, d: notes(spark, d).withColumn("end_tick", C("end")), "SELECT *, end_ AS end_tick FROM midi_notes")
Q.add("d3_keys_by_measure", "file_id:l measure_idx:l fifths:l minor:l", ev(M.keys_by_measure, MEASURE),
      f"SELECT file_id, measure_idx, coalesce(fifths, 0) AS fifths, coalesce(scale, 0) AS minor FROM (SELECT file_id, greatest(tick // {MEASURE}, 0) AS measure_idx, arg_max(fifths, (tick, track, seq)) AS fifths, arg_max(scale, (tick, track, seq)) AS scale FROM midi_events WHERE fifths IS NOT NULL GROUP BY ALL) FULL JOIN (SELECT DISTINCT file_id, 0 AS measure_idx FROM midi_events) USING (file_id, measure_idx)")
Q.add("d4_clefs", "track:l median:l clef:s", lambda spark, d: M.clefs(notes(spark, d)), "SELECT track, median, CASE WHEN median < 60 THEN 'F4' ELSE 'G2' END AS clef FROM (SELECT track, list_sort(list(note))[CAST(count(*) // 2 + 1 AS INT)] AS median FROM midi_notes GROUP BY track)")
Q.add("d5_graces", f"{KN} is_grace:b slash:b main_start:l", lambda spark, d: M.graces(notes(spark, d), BEAT, MEASURE), "SELECT track, note, start, end_seq, is_grace, is_grace AND end_ - start < 240 AS slash, CASE WHEN is_grace THEN main_start END AS main_start FROM midi_graces")
Q.add("d6_quantize", f"{KN} q_start:l q_end:l", lambda spark, d: M.quantized(notes(spark, d), GRID), "SELECT *, floor(start / 960.0 + 0.5) * 960 AS q_start, greatest(floor(end_ / 960.0 + 0.5) * 960, floor(start / 960.0 + 0.5) * 960 + 960) AS q_end FROM midi_notes")
Q.add("d7_split_at_bars", f"{KN} measure_idx:l part_start:l part_end:l tie_start:b tie_stop:b", lambda spark, d: M.split_at_bars(notes(spark, d), MEASURE),
      "SELECT *, m AS measure_idx, greatest(start, m * 15360) AS part_start, least(end_, m * 15360 + 15360) AS part_end, m < (end_ - 1) // 15360 AS tie_start, m > start // 15360 AS tie_stop FROM (SELECT *, unnest(range(start // 15360, (end_ - 1) // 15360 + 1)) AS m FROM midi_notes WHERE end_ > start)")
Q.add("d8_measure_grid", "file_id:l measure_idx:l begun:l", lambda spark, d: M.measure_grid(notes(spark, d), MEASURE),
      "SELECT g.file_id, g.m AS measure_idx, count(n.start) AS begun FROM (SELECT file_id, unnest(range(0, CAST(ceil(max(end_) / 15360.0) AS BIGINT))) AS m FROM midi_notes GROUP BY file_id) g LEFT JOIN midi_notes n ON n.file_id = g.file_id AND n.start // 15360 = g.m GROUP BY ALL")
Q.add("d9_chord_slots", "track:l measure_idx:l start:l n_notes:l display:l play:l", lambda spark, d: M.chord_slots(parts(spark, d), MEASURE, GRID), "SELECT *, CASE WHEN rhythmic < display THEN rhythmic END AS play FROM midi_slots")
Q.add("d10_staccato", f"{KN} measure_idx:l staccato:b", lambda spark, d: (lambda p: M.staccato_flags(p, M.chord_slots(p, MEASURE, GRID), GRID))(parts(spark, d)),
      "SELECT p.track, p.note, p.start, p.end_seq, p.measure_idx, NOT tie_start AND NOT tie_stop AND part_end - part_start <= display * 480 AS staccato FROM midi_parts p JOIN midi_slots s ON s.track = p.track AND s.measure_idx = p.measure_idx AND s.start = p.part_start")
Q.add("d11_slot_rests", "track:l measure_idx:l from_tick:l nr:l units:l", lambda spark, d: M.slot_rests(M.chord_slots(parts(spark, d), MEASURE, GRID), MEASURE, GRID).withColumn("from_tick", C("from")),
      """WITH RECURSIVE g AS (SELECT track, measure_idx, coalesce(lag(start + display * 960) OVER (PARTITION BY track, measure_idx ORDER BY start), measure_idx * 15360) AS f, start AS t FROM midi_slots
      UNION ALL SELECT track, measure_idx, arg_max(start + display * 960, start), (measure_idx + 1) * 15360 FROM midi_slots GROUP BY ALL),
      r AS (SELECT track, measure_idx, f, -1 AS nr, CAST(floor((t - f) / 960.0 + 0.5) AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS units FROM g WHERE t > f
      UNION ALL SELECT track, measure_idx, f, nr + 1, rest - u, u FROM (SELECT *, CAST(list_filter([16, 12, 8, 6, 4, 3, 2, 1], lambda x: x <= rest)[1] AS BIGINT) AS u FROM r WHERE rest > 0) WHERE u IS NOT NULL)
      SELECT track, measure_idx, f AS from_tick, nr, units FROM r WHERE nr >= 0""")  # fmt: skip
Q.add("d12_attached_graces", f"{KN} main_tick:l group_no:l place:l", lambda spark, d: M.attached_graces(M.graces(notes(spark, d), BEAT, MEASURE), GRID),
      "SELECT *, dense_rank() OVER (PARTITION BY track, main_tick ORDER BY start) - 1 AS group_no, row_number() OVER (PARTITION BY track, main_tick, start ORDER BY note, end_seq) - 1 AS place FROM (SELECT *, CAST(floor(main_start / 960.0 + 0.5) * 960 AS BIGINT) AS main_tick FROM midi_graces WHERE is_grace)")

QUERIES, ORACLES = Q.queries, Q.oracles
