"""The canonical tables, and results that several queries build on, as DuckDB SQL over the driver's tables."""

CTES = {
    "measures": """
SELECT o_orderkey AS order_key, o_custkey AS score_id, 0 AS part_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS measure_idx,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END END AS divisions,
  CASE WHEN o_orderpriority = '2-HIGH' THEN o_orderkey % 15 - 7 END AS fifths,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 2 + o_orderkey % 5 END AS beats, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 4 + 4 * (o_orderkey % 2) END AS beat_type,
  o_orderkey % 5 = 0 AS repeat_start, CASE WHEN o_orderkey % 7 = 0 THEN 2 + o_orderkey % 2 END AS repeat_times FROM orders""",
    "clefs": """
SELECT score_id, part_idx, measure_idx, 1 + order_key % 2 AS staff, CASE WHEN order_key % 4 = 0 THEN 'F' ELSE 'G' END AS sign, CASE WHEN order_key % 4 = 0 THEN 4 ELSE 2 END AS line FROM measures WHERE order_key % 6 = 0""",
    "note_elements": """
SELECT score_id, part_idx, measure_idx, elem_idx, tag, is_rest, is_grace, tag = 'note' AND NOT is_rest AND elem_idx > 0 AND l_partkey % 4 = 1 AS is_chord,
  CAST(trunc(l_quantity) AS BIGINT) % 8 + 1 AS duration, 1 + l_suppkey % 2 AS staff, 1 + l_linenumber % 2 AS voice, substr('CDEFGAB', CAST(l_partkey % 7 + 1 AS INT), 1) AS step,
  l_linenumber % 3 - 1 AS alter_, 2 + l_suppkey % 5 AS octave, CASE l_partkey % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'half' WHEN 2 THEN 'quarter' WHEN 3 THEN 'eighth' ELSE '16th' END AS type,
  l_partkey % 6 = 0 AS dot, l_partkey % 2 = 0 AS slash, l_returnflag = 'R' AS tie_start, l_returnflag = 'A' AS tie_stop, l_partkey AS mark
FROM (SELECT *, tag = 'note' AND NOT is_rest AND l_partkey % 11 = 2 AS is_grace FROM (SELECT *, tag = 'note' AND l_suppkey % 7 = 0 AS is_rest FROM (
  SELECT *, CASE WHEN elem_idx > 0 AND l_partkey % 9 = 0 THEN 'backup' WHEN l_partkey % 13 = 0 THEN 'forward' ELSE 'note' END AS tag FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS elem_idx FROM lineitem) JOIN measures ON l_orderkey = order_key)))""",
    "recovered_elements": """
SELECT * REPLACE (CASE WHEN mark % 19 = 5 THEN translate(step, 'CDEFGAB', 'DEFGABC') ELSE step END AS step, CASE WHEN mark % 23 = 7 THEN -alter_ ELSE alter_ END AS alter_) FROM note_elements WHERE mark % 17 <> 3""",
    "ev": """
SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) // 60000000 - 28401120 AS minute FROM events""",
    "midi_events": """
SELECT user_id // 10 AS file_id, user_id AS track, us AS seq, minute AS tick, 48 + k % 8 AS note, CASE WHEN event_type IN ('purchase', 'error') THEN 'noteOff' ELSE 'noteOn' END AS type,
  CASE WHEN event_type IN ('click', 'view') THEN 1 + k ELSE 0 END AS velocity, k, CASE WHEN k % 10 = 0 THEN 'name ' || k WHEN k % 10 = 1 THEN '' END AS text,
  CASE WHEN k % 20 = 3 THEN 400000 + 1000 * k END AS us_per_beat, CASE WHEN k % 25 = 4 THEN 2 + k % 3 END AS num, CASE WHEN k % 25 = 4 THEN 4 END AS den,
  CASE WHEN k % 15 = 5 THEN k % 13 - 6 END AS fifths, CASE WHEN k % 15 = 5 THEN k % 2 END AS scale FROM ev""",
    "omr_tokens": """
SELECT user_id // 10 AS page_id, user_id AS staff_idx, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS pos,
  CASE event_type WHEN 'click' THEN 'note_' || CASE k % 3 WHEN 0 THEN '4' WHEN 1 THEN '8' ELSE '16' END || CASE WHEN k % 17 = 0 THEN 'G' ELSE '' END || CASE WHEN k % 4 = 0 THEN '.' ELSE '' END || CASE WHEN k % 16 = 4 THEN '.' ELSE '' END
    WHEN 'view' THEN CASE WHEN k % 9 = 0 THEN 'rest_2m' ELSE 'rest_4' END WHEN 'purchase' THEN CASE k % 5 WHEN 0 THEN 'repeatStart' WHEN 1 THEN 'repeatEnd' ELSE 'barline' END WHEN 'error' THEN 'chord'
    ELSE CASE k % 3 WHEN 0 THEN 'keySignature_' || (k % 15 - 7) WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'clef_G2' ELSE 'clef_F4' END ELSE 'timeSignature/' || (3 + k % 2) END END AS rhythm,
  CASE WHEN k % 29 = 0 THEN '.' ELSE substr('CDEFGAB', k % 7 + 1, 1) || (k % 9 + 1) END AS pitch,
  CASE k % 6 WHEN 0 THEN '.' WHEN 1 THEN '#' WHEN 2 THEN 'b' WHEN 3 THEN 'N' WHEN 4 THEN '##' ELSE 'bb' END AS lift,
  CASE k % 5 WHEN 0 THEN '.' WHEN 1 THEN 'slurStart' WHEN 2 THEN 'slurStop' WHEN 3 THEN 'slurStart_slurStop' ELSE '_' END AS slur, k FROM ev""",
    "probes": "SELECT event_id, user_id AS score_id, CAST(round(value * 100) AS BIGINT) AS centibeat, 14 + k % 28 AS diatonic FROM ev",
    "page_profile": "SELECT user_id // 10 AS page_id, minute // 60 AS y, count(*) AS cnt FROM ev GROUP BY ALL",
    "ink_runs": "SELECT user_id // 10 AS page_id, minute // 60 AS y, CAST(trunc(value) AS BIGINT) AS x0, CAST(trunc(value) AS BIGINT) + k % 20 + 1 AS x1, event_id FROM ev",
    "luma_hist": "SELECT user_id AS page_id, least(255, CAST(trunc(value) AS BIGINT)) AS level, count(*) AS cnt FROM ev GROUP BY ALL",
    "probs": "SELECT label AS page_id, vec_id AS cell, embedding AS v FROM embeddings",
    "edit_log": "SELECT user_id AS doc_id, us AS seq, event_type AS coalesce_key, k FROM ev",
    "timed": """
SELECT *, CASE WHEN is_chord THEN coalesce(last_value(CASE WHEN moves THEN cursor_ END IGNORE NULLS) OVER w, 0) ELSE cursor_ END AS onset FROM (
  SELECT *, coalesce(sum(CASE WHEN moves OR tag = 'forward' THEN duration WHEN tag = 'backup' THEN -duration ELSE 0 END) OVER w, 0) AS cursor_ FROM (
    SELECT *, tag = 'note' AND NOT is_chord AND NOT is_grace AS moves FROM note_elements) WINDOW w AS (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WINDOW w AS (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "timed_diff": """
SELECT *, CASE WHEN is_chord THEN coalesce(last_value(CASE WHEN tag = 'note' AND NOT is_chord THEN cursor_ END IGNORE NULLS) OVER w, 0) ELSE cursor_ END AS onset FROM (
  SELECT *, coalesce(sum(CASE WHEN (tag = 'note' AND NOT is_chord AND NOT is_grace) OR tag = 'forward' THEN duration WHEN tag = 'backup' THEN -duration ELSE 0 END) OVER w, 0) AS cursor_ FROM note_elements
  WINDOW w AS (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WINDOW w AS (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "active": """
SELECT *, coalesce(last_value(divisions IGNORE NULLS) OVER w, first_value(CASE WHEN divisions > 0 THEN divisions END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS active_divisions,
  coalesce(last_value(fifths IGNORE NULLS) OVER w, 0) AS active_fifths, coalesce(last_value(beats IGNORE NULLS) OVER w, 4) AS active_beats, coalesce(last_value(beat_type IGNORE NULLS) OVER w, 4) AS active_beat_type
FROM measures WINDOW w AS (PARTITION BY score_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING)""",
    "islands": """
SELECT *, strpos('CDEFGAB', step) - 1 + 7 * octave AS diatonic, sum(CASE WHEN NOT is_chord OR is_rest OR coalesce(prev_rest, true) THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS island FROM (
  SELECT *, lag(is_rest) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS prev_rest FROM note_elements WHERE tag = 'note')""",
    "chord_rows": """
SELECT *, CASE WHEN grace_group AND NOT next_rest THEN next_island END AS host FROM (
  SELECT *, first_value(CASE WHEN NOT grace_group THEN rests END IGNORE NULLS) OVER f AS next_rest, first_value(CASE WHEN NOT grace_group THEN island END IGNORE NULLS) OVER f AS next_island FROM (
    SELECT score_id, part_idx, measure_idx, island, bool_or(is_rest) AS rests, min(elem_idx) AS first_elem, count(*) AS n_notes, arg_min(duration, diatonic * 1000 + elem_idx) AS duration, arg_min(type, diatonic * 1000 + elem_idx) AS type,
      arg_min(dot, diatonic * 1000 + elem_idx) AS dot, NOT bool_or(is_rest) AND arg_min(is_grace, diatonic * 1000 + elem_idx) AS grace_group,
      string_agg(step || repeat('#', greatest(alter_, 0)) || repeat('b', greatest(-alter_, 0)) || octave, ' ' ORDER BY diatonic, elem_idx) AS pitches FROM islands GROUP BY score_id, part_idx, measure_idx, island)
  WINDOW f AS (PARTITION BY score_id, measure_idx ORDER BY island ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""",
    "grid_items": """
SELECT t.score_id, t.part_idx, t.measure_idx, elem_idx, staff, is_rest, is_grace, type, duration, CAST(floor(onset * 5040.0 / active_divisions) AS BIGINT) AS onset,
  CAST(floor((onset + CASE WHEN is_grace THEN 0 ELSE duration END) * 5040.0 / active_divisions) AS BIGINT) AS reach, CAST(floor(CASE WHEN is_grace THEN 0 ELSE duration END * 5040.0 / active_divisions) AS BIGINT) AS lasts
FROM timed t JOIN active a ON a.score_id = t.score_id AND a.measure_idx = t.measure_idx WHERE tag = 'note'""",
    "staff_spans": """
SELECT m.score_id, m.measure_idx, m.global_end, v.staff, coalesce(e.n, 0) AS n, e.staff_end FROM
  (SELECT score_id, measure_idx, greatest(max(reach), 0) AS global_end FROM grid_items GROUP BY ALL) m
  JOIN (SELECT score_id, unnest(range(1, max(staff) + 1)) AS staff FROM note_elements GROUP BY score_id) v USING (score_id)
  LEFT JOIN (SELECT score_id, measure_idx, staff, max(reach) AS staff_end, count(*) FILTER (NOT is_grace) AS n FROM grid_items GROUP BY ALL) e ON e.score_id = m.score_id AND e.measure_idx = m.measure_idx AND e.staff = v.staff""",
    "onset_groups": """
SELECT g.*, s.staff_end, lead(onset) OVER w AS next_onset, row_number() OVER w AS nr FROM (
  SELECT score_id, measure_idx, staff, onset, count(*) FILTER (NOT is_rest) AS n_notes, arg_max(type, duration * 1000 - elem_idx) FILTER (NOT is_rest) AS note_type, arg_min(type, elem_idx) AS first_type FROM grid_items WHERE NOT is_grace GROUP BY ALL) g
  JOIN staff_spans s USING (score_id, measure_idx, staff) WINDOW w AS (PARTITION BY score_id, measure_idx, staff ORDER BY onset)""",
    "staff_event_rows": """
SELECT score_id, measure_idx, staff, onset, greatest(coalesce(next_onset, staff_end) - onset, 0) AS duration, n_notes, CASE WHEN n_notes > 0 THEN note_type ELSE first_type END AS type, 'event' AS kind FROM onset_groups
UNION ALL SELECT score_id, measure_idx, staff, 0, onset, 0, NULL, 'lead' FROM onset_groups WHERE nr = 1 AND onset > 0
UNION ALL SELECT score_id, measure_idx, staff, CASE WHEN n = 0 THEN 0 ELSE staff_end END, CASE WHEN n = 0 THEN global_end ELSE global_end - staff_end END, 0, NULL, CASE WHEN n = 0 THEN 'empty' ELSE 'tail' END
  FROM staff_spans WHERE (n > 0 AND staff_end < global_end) OR (n = 0 AND global_end > 0)""",
    "starts": """
SELECT *, coalesce(sum(length_) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM (
  SELECT a.*, greatest(coalesce(reach, 0), 0) * 5040 // active_divisions AS length_ FROM active a LEFT JOIN
    (SELECT score_id, measure_idx, max(onset + CASE WHEN is_grace THEN 0 ELSE duration END) AS reach FROM timed WHERE tag = 'note' GROUP BY ALL) USING (score_id, measure_idx))""",
    "play": """
SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY k1, k2, measure_idx) - 1 AS position FROM (
  SELECT score_id, measure_idx, measure_idx AS k1, 0 AS k2 FROM measures UNION ALL
  SELECT e.score_id, m.measure_idx, e.measure_idx, p.pass FROM (SELECT *, coalesce(last_value(CASE WHEN repeat_start THEN measure_idx END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS UNBOUNDED PRECEDING), 0) AS from_ FROM measures) e
    JOIN measures m ON m.score_id = e.score_id AND m.measure_idx BETWEEN e.from_ AND e.measure_idx JOIN (SELECT unnest(range(1, 10)) AS pass) p ON p.pass < e.repeat_times)""",
    "play_starts": """
SELECT p.*, s.length_, s.start_, s.active_divisions, coalesce(sum(s.length_) OVER (PARTITION BY p.score_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS playback_start FROM play p JOIN starts s USING (score_id, measure_idx)""",
    "spine_rows": """
SELECT *, coalesce(sum(advance) OVER (PARTITION BY score_id, measure_idx ORDER BY div_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(8 * graces) OVER (PARTITION BY score_id, measure_idx ORDER BY div_) AS x FROM (
  SELECT score_id, measure_idx, onset AS div_, greatest(12, CAST(floor(max(lasts) * 24 / 5040.0) AS BIGINT)) AS advance, count(*) FILTER (is_grace) AS graces FROM grid_items GROUP BY ALL)""",
    "midi_notes": """
SELECT file_id, track, note, last_tick AS start, tick AS end_, last_velocity AS velocity, seq AS end_seq FROM (
  SELECT *, lag(on_) OVER w AS last_on, lag(tick) OVER w AS last_tick, lag(velocity) OVER w AS last_velocity FROM (SELECT *, type = 'noteOn' AND velocity > 0 AS on_ FROM midi_events) WINDOW w AS (PARTITION BY track, note ORDER BY seq))
WHERE NOT on_ AND last_on""",
    "midi_graces": """
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY start, note, end_seq) AS i, dense_rank() OVER (PARTITION BY track ORDER BY start) AS t FROM midi_notes),
a AS (SELECT s.*, end_ - start < 480 AS short, end_ - start > 480 AS normal, first_value(CASE WHEN end_ - start >= 480 THEN start END IGNORE NULLS) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS main_start FROM s),
b AS (SELECT *, short AND coalesce(main_start <= start + 15360, false) AND (t = 1 OR row_number() OVER (PARTITION BY track, t ORDER BY note, end_seq) = 1) AS able FROM a),
k AS (SELECT track, t, bool_or(normal) AS n, bool_or(able) AS e FROM b GROUP BY ALL),
c AS (SELECT track, t, true AS open, n, e FROM k WHERE t = 1 UNION ALL SELECT k.track, k.t, c.n OR (c.open AND c.e), k.n, k.e FROM c JOIN k ON k.track = c.track AND k.t = c.t + 1)
SELECT b.*, able AND open AS is_grace FROM b JOIN c ON c.track = b.track AND c.t = b.t""",
    "midi_parts": """
SELECT file_id, track, note, start, end_seq, m AS measure_idx, greatest(qs, m * 15360) AS part_start, least(qe, m * 15360 + 15360) AS part_end, m < (qe - 1) // 15360 AS tie_start, m > qs // 15360 AS tie_stop FROM (
  SELECT *, unnest(range(qs // 15360, (qe - 1) // 15360 + 1)) AS m FROM (SELECT *, CAST(floor(start / 960.0 + 0.5) * 960 AS BIGINT) AS qs, CAST(greatest(floor(end_ / 960.0 + 0.5) * 960, floor(start / 960.0 + 0.5) * 960 + 960) AS BIGINT) AS qe FROM midi_graces WHERE NOT is_grace))""",
    "midi_slots": """
SELECT *, coalesce(list_filter([16, 12, 8, 6, 4, 3, 2, 1], lambda x: x <= space)[1], 1) AS display, coalesce(list_filter([16, 12, 8, 6, 4, 3, 2, 1], lambda x: x <= least(actual, space))[1], 1) AS rhythmic FROM (
  SELECT track, measure_idx, start, n_notes, floor((low_end - start) / 960.0 + 0.5) AS actual, floor((coalesce(lead(start) OVER (PARTITION BY track, measure_idx ORDER BY start), (measure_idx + 1) * 15360) - start) / 960.0 + 0.5) AS space FROM (
    SELECT track, measure_idx, part_start AS start, arg_min(part_end, (note, end_seq)) AS low_end, count(*) AS n_notes FROM midi_parts GROUP BY ALL))""",
    "toks": """
SELECT *, coalesce(sum(CASE WHEN emitted THEN 1 ELSE 0 END) OVER w, 0) AS note_idx FROM (
  SELECT *, cls = 'note' AND duration IS NOT NULL AND (starts_with(rhythm, 'rest_') OR pitch NOT IN ('.', '_')) AS emitted FROM (
    SELECT *, coalesce(sum(CASE WHEN cls = 'bar' THEN 1 ELSE 0 END) OVER w, 0) AS measure_idx, CASE WHEN cls = 'note' THEN CASE WHEN rhythm = 'rest_2m' THEN 'whole' WHEN ends_with(rhythm, '..') THEN NULL
      ELSE CASE regexp_extract(rhythm, '_([0-9]+)', 1) WHEN '4' THEN 'quarter' WHEN '8' THEN 'eighth' WHEN '16' THEN 'sixteenth' END END END AS duration, ends_with(rhythm, '.') AS dotted, contains(rhythm, 'G') AND cls = 'note' AS grace FROM (
      SELECT *, CASE WHEN rhythm IN ('barline', 'repeatStart', 'repeatEnd') THEN 'bar' WHEN rhythm = 'chord' THEN 'chord' WHEN starts_with(rhythm, 'note_') OR starts_with(rhythm, 'rest_') THEN 'note' ELSE 'other' END AS cls FROM omr_tokens)
    WINDOW w AS (PARTITION BY staff_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
WINDOW w AS (PARTITION BY staff_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "omr_notes": """
SELECT page_id, staff_idx, note_idx, pos, CASE WHEN starts_with(rhythm, 'rest_') THEN 'rest' ELSE pitch END AS pitch, CASE lift WHEN '#' THEN 'sharp' WHEN '##' THEN 'double_sharp' WHEN 'N' THEN 'natural' WHEN 'b' THEN 'flat' WHEN 'bb' THEN 'double_flat' END AS accidental,
  duration, dotted, measure_idx, prev = 'chord' AS chord, grace, slur IN ('slurStart', 'slurStart_slurStop') AND NOT starts_with(rhythm, 'rest_') AS slur_start, slur IN ('slurStop', 'slurStart_slurStop') AND NOT starts_with(rhythm, 'rest_') AS slur_stop,
  CASE WHEN dotted THEN floor([4, 2, 1, 16][p] * 1.5 + 0.5) ELSE [4, 2, 1, 16][p] END AS divs
FROM (SELECT *, coalesce(lag(cls) OVER (PARTITION BY staff_idx ORDER BY pos), '') AS prev, list_position(['quarter', 'eighth', 'sixteenth', 'whole'], duration) AS p FROM toks WHERE cls <> 'other') WHERE emitted""",
    "attrs": """
SELECT page_id, staff_idx, note_idx, pos, CASE WHEN starts_with(rhythm, 'clef_') THEN substr(rhythm, 6) END AS clef, CASE WHEN starts_with(rhythm, 'keySig') THEN CAST(substr(rhythm, 14) AS INT) END AS fifths,
  CASE WHEN starts_with(rhythm, 'timeSig') THEN CAST(substr(rhythm, 15) AS INT) END AS number, sum(CASE WHEN cls = 'note' THEN 1 ELSE 0 END) OVER (PARTITION BY staff_idx ORDER BY pos) AS heard, cls FROM toks""",
    "changes": """
SELECT a.*, t.measure_idx FROM (SELECT page_id, staff_idx, note_idx, arg_min(clef, pos) FILTER (clef IS NOT NULL) AS clef, arg_min(fifths, pos) FILTER (fifths IS NOT NULL) AS fifths,
  CASE WHEN count(number) = 2 THEN arg_min(number, pos) FILTER (number IS NOT NULL) END AS beats, CASE WHEN count(number) = 2 THEN arg_max(number, pos) FILTER (number IS NOT NULL) END AS beat_type FROM attrs WHERE cls = 'other' GROUP BY ALL) a
JOIN toks t ON t.staff_idx = a.staff_idx AND t.note_idx = a.note_idx AND t.emitted WHERE a.note_idx > 0 AND (clef IS NOT NULL OR fifths IS NOT NULL OR beats IS NOT NULL)""",
    "opening": """
SELECT s.*, clef, fifths, beats, beat_type FROM (SELECT DISTINCT page_id, staff_idx FROM omr_tokens) s LEFT JOIN (SELECT staff_idx, arg_min(clef, pos) FILTER (clef IS NOT NULL) AS clef, arg_min(fifths, pos) FILTER (fifths IS NOT NULL) AS fifths,
  CASE WHEN count(number) = 2 THEN arg_min(number, pos) FILTER (number IS NOT NULL) END AS beats, CASE WHEN count(number) = 2 THEN arg_max(number, pos) FILTER (number IS NOT NULL) END AS beat_type FROM attrs WHERE heard = 0 GROUP BY staff_idx) USING (staff_idx)""",
    "page_starts": """
SELECT *, page_id % 2 AS doc_id, coalesce(sum(span) OVER (PARTITION BY page_id % 2 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ FROM (SELECT page_id, max(measure_idx) + 1 AS span FROM omr_notes GROUP BY page_id)""",
}
CTES["printed"] = """SELECT score_id, measure_idx, elem_idx, CASE WHEN alter_ = state THEN 'none' WHEN alter_ > 0 THEN 'sharp' WHEN alter_ < 0 THEN 'flat' ELSE 'natural' END AS accidental FROM (
      SELECT t.score_id, t.measure_idx, elem_idx, alter_, coalesce(lag(alter_) OVER (PARTITION BY t.score_id, t.measure_idx, step, octave ORDER BY onset, is_grace DESC, elem_idx),
        CASE WHEN active_fifths > 0 AND strpos('FCGDAEB', step) <= active_fifths THEN 1 WHEN active_fifths < 0 AND strpos('BEADGCF', step) <= -active_fifths THEN -1 ELSE 0 END) AS state
      FROM timed t JOIN active a ON a.score_id = t.score_id AND a.measure_idx = t.measure_idx WHERE tag = 'note' AND NOT is_rest)"""
