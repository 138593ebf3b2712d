"""Queries over recognised token streams. A document is every other page."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.operators import tokens as O
from stavework.sources import adapters as A

from .base import Queries
from .ctes import CTES

Q = Queries()
C = F.col
document = lambda: C("page_id") % 2


def tk(f, *more):
    return lambda spark, d: f(A.omr_tokens(spark, d), *more)


def nt(f):
    return lambda spark, d: f(O.notes(A.omr_tokens(spark, d)))


def ended(spark, d):
    """The tokens with some made into ends and begins."""
    t = A.omr_tokens(spark, d)
    return t.withColumn("rhythm", F.when(C("k") == 99, "EOS").when(C("k") == 98, "BOS").otherwise(C("rhythm")))


def staves(spark, d):
    return O.opening_attributes(A.omr_tokens(spark, d)).select("page_id", "staff_idx", F.substring("clef", 1, 1).alias("sign"), (C("staff_idx") % 40 < 10).alias("braced"))


S = "staff_idx:l"
Q.add("e1_until_stop", f"{S} pos:l rhythm:s", lambda spark, d: O.until_stop(ended(spark, d)), "SELECT staff_idx, pos, rhythm FROM (SELECT *, sum(CASE WHEN k = 99 THEN 1 ELSE 0 END) OVER (PARTITION BY staff_idx ORDER BY pos) AS stop FROM omr_tokens) WHERE stop = 0 AND k <> 98")
Q.add("e2_measure_index", f"{S} pos:l measure_idx:l", tk(O.measured), "SELECT staff_idx, pos, measure_idx FROM toks")
Q.add("e3_chord_marks", f"{S} pos:l chord:b", nt(lambda n: n), "SELECT staff_idx, pos, chord FROM omr_notes")
Q.add("e4_notes", f"{S} note_idx:l pitch:s accidental:s duration:s dotted:b measure_idx:l chord:b grace:b slur_start:b slur_stop:b", nt(lambda n: n), "SELECT * FROM omr_notes")
Q.add("e5_attribute_changes", f"{S} note_idx:l measure_idx:l clef:s fifths:l beats:l beat_type:l", tk(O.attribute_changes), "SELECT * FROM changes")
Q.add("e6_opening_attributes", f"{S} clef:s fifths:l beats:l beat_type:l", tk(O.opening_attributes), "SELECT * FROM opening")
Q.add("e7_repeats", f"{S} measure_idx:l repeat_start:b repeat_times:l", tk(O.repeats),
      "SELECT staff_idx, m AS measure_idx, bool_or(s) AS repeat_start, CASE WHEN bool_or(NOT s) THEN 2 END AS repeat_times FROM (SELECT staff_idx, measure_idx AS m, false AS s FROM toks WHERE rhythm = 'repeatEnd' UNION ALL SELECT staff_idx, measure_idx + 1, true FROM toks WHERE rhythm = 'repeatStart') GROUP BY ALL")
Q.add("e8_slur_ties", f"{S} note_idx:l tie_start:b tie_stop:b", nt(lambda n: O.paired_ties(n, (*O.STAFF, "pitch"), ["note_idx"], "slur_start", "slur_stop")),
      "SELECT staff_idx, note_idx, slur_start AND coalesce(lead(slur_stop) OVER w, false) AS tie_start, slur_stop AND coalesce(lag(slur_start) OVER w, false) AS tie_stop FROM omr_notes WHERE slur_start OR slur_stop WINDOW w AS (PARTITION BY staff_idx, pitch ORDER BY note_idx)")


def _arcs(spark, d):
    rows = A.note_elements(spark, d).filter("tag = 'note' and not is_rest").withColumn("at", C("measure_idx") * 1000 + C("elem_idx"))
    return O.tie_arcs(rows, ("score_id", "part_idx", "step", "alter", "octave"), ["at"], "tie_start", "tie_stop", "at")


Q.add("e9_tie_arcs", "score_id:l first_note:l second_note:l", lambda spark, d: _arcs(spark, d).select("score_id", C("first").alias("first_note"), C("second").alias("second_note")),
      "SELECT score_id, first_note, p AS second_note FROM (SELECT score_id, p, tie_stop, lag(CASE WHEN tie_start THEN p END) OVER (PARTITION BY score_id, step, alter_, octave ORDER BY p) AS first_note FROM (SELECT *, measure_idx * 1000 + elem_idx AS p FROM note_elements WHERE tag = 'note' AND NOT is_rest AND (tie_start OR tie_stop))) WHERE tie_stop AND first_note IS NOT NULL")
Q.add("e10_measure_lengths", f"{S} measure_idx:l length:l", nt(O.measure_lengths), "SELECT staff_idx, measure_idx, sum(divs) AS length FROM omr_notes WHERE NOT chord AND NOT grace GROUP BY ALL")
Q.add("e11_inferred_meters", "page_id:l beats:l beat_type:l", nt(O.inferred_meters),
      "SELECT page_id, length // 4 AS beats, 4 AS beat_type FROM (SELECT page_id, arg_max(CAST(length AS BIGINT), (n, length)) AS length, max(n) AS n FROM (SELECT page_id, length, count(*) AS n FROM (SELECT page_id, staff_idx, measure_idx, sum(divs) AS length FROM omr_notes WHERE NOT chord AND NOT grace GROUP BY ALL) WHERE length > 0 GROUP BY ALL) GROUP BY page_id) WHERE n >= 2 AND length % 4 = 0 AND length BETWEEN 4 AND 48")
Q.add("e12_measure_spans", f"{S} span:l", nt(lambda n: O.measure_spans(n, *O.STAFF)), "SELECT staff_idx, max(measure_idx) + 1 AS span FROM omr_notes GROUP BY staff_idx")
Q.add("e13_combined_pages", f"doc_id:l {S} note_idx:l measure_idx:l", nt(lambda n: O.combined_pages(n, document())), "SELECT doc_id, staff_idx, note_idx, measure_idx + offset_ AS measure_idx FROM omr_notes JOIN page_starts USING (page_id)")
Q.add("e14_system_offsets", "doc_id:l page_id:l span:l offset_:l", nt(lambda n: O.page_offsets(n, document()).withColumn("offset_", C("offset"))), "SELECT * FROM page_starts")
Q.add("e14_staff_attributes", "doc_id:l place:l clef:s fifths:l beats:l beat_type:l", lambda spark, d: O.staff_attributes(O.opening_attributes(A.omr_tokens(spark, d)), document()),
      "SELECT page_id % 2 AS doc_id, place, arg_min(clef, page_id) FILTER (clef IS NOT NULL) AS clef, arg_min(fifths, page_id) FILTER (fifths IS NOT NULL) AS fifths, arg_min(beats, page_id) FILTER (beats IS NOT NULL) AS beats, arg_min(beat_type, page_id) FILTER (beat_type IS NOT NULL) AS beat_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY staff_idx) - 1 AS place FROM opening) GROUP BY ALL")
Q.add("e14_top_staff_barlines", f"{S} measure_idx:l", lambda spark, d: O.top_staff(O.repeats(A.omr_tokens(spark, d))).select("staff_idx", "measure_idx"),
      "SELECT DISTINCT staff_idx, m AS measure_idx FROM (SELECT page_id, staff_idx, measure_idx AS m FROM toks WHERE rhythm = 'repeatEnd' UNION SELECT page_id, staff_idx, measure_idx + 1 FROM toks WHERE rhythm = 'repeatStart') WHERE staff_idx IN (SELECT min(staff_idx) FROM toks WHERE rhythm IN ('repeatEnd', 'repeatStart') GROUP BY page_id)")
Q.add("e15_meters_in_force", f"{S} measure_idx:l beats:l beat_type:l", lambda spark, d: (lambda t: O.meters_in_force(O.notes(t), O.attribute_changes(t)))(A.omr_tokens(spark, d)),
      """SELECT staff_idx, measure_idx, last_value(beats IGNORE NULLS) OVER w AS beats, last_value(beat_type IGNORE NULLS) OVER w AS beat_type FROM (
      SELECT s.staff_idx, s.measure_idx, c.beats, c.beat_type FROM (SELECT staff_idx, unnest(range(0, CAST(max(measure_idx) + 1 AS BIGINT))) AS measure_idx FROM omr_notes GROUP BY staff_idx) s LEFT JOIN
      (SELECT staff_idx, measure_idx, arg_max(beats, note_idx) AS beats, arg_max(beat_type, note_idx) AS beat_type FROM changes WHERE beats IS NOT NULL GROUP BY ALL) c ON c.staff_idx = s.staff_idx AND c.measure_idx = s.measure_idx)
      WINDOW w AS (PARTITION BY staff_idx ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
Q.add("e16_systems", f"page_id:l {S} system_no:l", lambda spark, d: O.systems(staves(spark, d)),
      """WITH RECURSIVE s AS (SELECT page_id, staff_idx, clef[1] AS sign, staff_idx % 40 < 10 AS braced, row_number() OVER (PARTITION BY page_id ORDER BY staff_idx) - 1 AS i FROM opening),
      j AS (SELECT *, CASE WHEN braced THEN coalesce((SELECT min(t.i) FROM s t WHERE t.page_id = s.page_id AND t.i >= s.i AND NOT t.braced), i) + 1 WHEN sign = 'G' AND (SELECT t.sign FROM s t WHERE t.page_id = s.page_id AND t.i = s.i + 1) = 'F' THEN i + 2 ELSE i + 1 END AS nxt FROM s),
      r AS (SELECT page_id, i, nxt, 0 AS no FROM j WHERE i = 0 UNION ALL SELECT j.page_id, j.i, j.nxt, r.no + 1 FROM r JOIN j ON j.page_id = r.page_id AND j.i = r.nxt)
      SELECT j.page_id, j.staff_idx, r.no AS system_no FROM j JOIN r ON r.page_id = j.page_id AND j.i >= r.i AND j.i < r.nxt""")  # fmt: skip
Q.add("e17_rejected_staves", f"{S} reason:s", lambda spark, d: O.rejected_staves(O.opening_attributes(A.omr_tokens(spark, d))), "SELECT staff_idx, 'no clef recognised' AS reason FROM opening WHERE clef IS NULL")
Q.add("e18_full_rests", f"{S} measure_idx:l duration:l", nt(O.full_rests),
      "SELECT s.staff_idx, m AS measure_idx, 16 AS duration FROM (SELECT DISTINCT page_id, staff_idx FROM omr_notes) s JOIN (SELECT page_id, unnest(range(0, CAST(max(measure_idx) + 1 AS BIGINT))) AS m FROM omr_notes GROUP BY page_id) p USING (page_id) WHERE NOT EXISTS (SELECT 1 FROM omr_notes n WHERE n.staff_idx = s.staff_idx AND n.measure_idx = m)")

CTES["meters"] = """
SELECT staff_idx, measure_idx, last_value(beats IGNORE NULLS) OVER w AS beats, last_value(beat_type IGNORE NULLS) OVER w AS beat_type FROM (
  SELECT s.staff_idx, s.measure_idx, c.beats, c.beat_type FROM (SELECT staff_idx, unnest(range(0, CAST(max(measure_idx) + 1 AS BIGINT))) AS measure_idx FROM omr_notes GROUP BY staff_idx) s LEFT JOIN
  (SELECT staff_idx, measure_idx, arg_max(beats, note_idx) AS beats, arg_max(beat_type, note_idx) AS beat_type FROM changes WHERE beats IS NOT NULL GROUP BY ALL) c ON c.staff_idx = s.staff_idx AND c.measure_idx = s.measure_idx)
WINDOW w AS (PARTITION BY staff_idx ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
Q.add("e18_metered_rests", f"{S} measure_idx:l duration:l", lambda spark, d: (lambda t: (lambda n: O.full_rests(n, O.meters_in_force(n, O.attribute_changes(t))))(O.notes(t)))(A.omr_tokens(spark, d)),
      """SELECT s.staff_idx, m AS measure_idx, CAST(coalesce(floor(16.0 * beats / beat_type), 16) AS BIGINT) AS duration FROM (SELECT DISTINCT page_id, staff_idx FROM omr_notes) s
      JOIN (SELECT page_id, unnest(range(0, CAST(max(measure_idx) + 1 AS BIGINT))) AS m FROM omr_notes GROUP BY page_id) p USING (page_id)
      LEFT JOIN LATERAL (SELECT arg_max(beats, measure_idx) AS beats, arg_max(beat_type, measure_idx) AS beat_type FROM meters t WHERE t.staff_idx = s.staff_idx AND t.measure_idx <= m AND beats IS NOT NULL) ON true
      WHERE NOT EXISTS (SELECT 1 FROM omr_notes n WHERE n.staff_idx = s.staff_idx AND n.measure_idx = m)""")  # fmt: skip

QUERIES, ORACLES = Q.queries, Q.oracles
