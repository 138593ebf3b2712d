"""Queries of lookups by position. Positions are on the grid of 5040 a quarter."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.functions.rhythm import GRID
from stavework.operators import cursor as O
from stavework.operators import lookup as L
from stavework.operators.windows import MEASURE
from stavework.sources import adapters as A

from .base import Queries

Q = Queries()
C = F.col
BY = ["score_id"]


def probes(spark, d):
    """Probes at positions on the grid."""
    return A.probes(spark, d).select("event_id", "score_id", F.floor(C("centibeat") * GRID / 100).cast("long").alias("at"), "diatonic")


def probed(spark, d):
    """The scores that have probes: others find nothing."""
    return A.probes(spark, d).select("score_id").distinct()


def tables(spark, d, scores=None):
    """Elements and measures, of some scores or of all, each made once however often a plan reads them."""
    return A.once(A.note_elements(spark, d, scores).drop("voice", "dot", "slash", "tie_start", "tie_stop", "mark")), A.once(A.measures(spark, d, scores))


def starts_of(e, m):
    return O.measure_starts(e, m).select("score_id", "measure_idx", "start", "length", "active_divisions")


def starts(spark, d, scores=None):
    return starts_of(A.note_elements(spark, d, scores), A.measures(spark, d, scores))


def on_grid(c="onset"):
    return F.floor(C(c) * GRID / C("active_divisions")).cast("long")


def slot_rows(spark, d, scores=None):
    """Slots of both staves with their absolute positions."""
    e, m = tables(spark, d, scores)
    return L.slots(O.staff_events(e, m), starts_of(e, m)).select("score_id", "measure_idx", "staff", "onset", "kind", "n_notes", "at")


def note_rows(spark, d, scores=None):
    """Pitched notes with their absolute positions, in order of measure and element."""
    e, m = tables(spark, d, scores)
    n = O.time_cursor(e).filter("tag = 'note' and not is_rest").withColumn("diatonic", O.diatonic_index(C("step"), C("octave")))
    s = starts_of(e, m)
    return n.join(s, ["score_id", "measure_idx"]).select("score_id", "measure_idx", "elem_idx", "staff", "onset", (C("start") + on_grid()).alias("at"), "diatonic", (C("measure_idx") * 1000 + C("elem_idx")).alias("ord"))


P = "(SELECT event_id, score_id, centibeat * 5040 // 100 AS p_at, diatonic AS p_dia FROM probes)"
ABS = "start_ + CAST(floor(onset * 5040.0 / active_divisions) AS BIGINT)"
SLOTS = "(SELECT e.score_id, e.measure_idx, e.staff, e.onset, e.kind, e.n_notes, start_ + e.onset AS s_at FROM staff_event_rows e JOIN starts s ON s.score_id = e.score_id AND s.measure_idx = e.measure_idx)"
NOTES = f"(SELECT t.*, {ABS} AS s_at, strpos('CDEFGAB', step) - 1 + 7 * octave AS dia, t.measure_idx * 1000 + elem_idx AS ord FROM timed t JOIN starts s ON s.score_id = t.score_id AND s.measure_idx = t.measure_idx WHERE tag = 'note' AND NOT is_rest)"

Q.add("f1_locate", "event_id:l score_id:l measure_idx:l inside:l", lambda spark, d: L.locate(starts(spark, d, probed(spark, d)).select("score_id", "measure_idx", C("start").alias("at")), probes(spark, d), "event_id"),
      f"""SELECT event_id, p.score_id, coalesce(max(measure_idx) FILTER (start_ <= p_at), min(measure_idx)) AS measure_idx, p_at - coalesce(max(start_) FILTER (start_ <= p_at), min(start_)) AS inside FROM {P} p JOIN starts s ON s.score_id = p.score_id GROUP BY event_id, p.score_id, p_at""")
Q.add("f2_nearest_note", "event_id:l score_id:l ord:l cost:l", lambda spark, d: L.nearest_note(note_rows(spark, d, probed(spark, d)), probes(spark, d), "event_id", GRID * 3 // 4, GRID),
      f"SELECT event_id, score_id, arg_min(ord, (cost, ord)) AS ord, min(cost) AS cost FROM (SELECT event_id, p.score_id, ord, 4 * abs(s_at - p_at) + 5040 * abs(dia - p_dia) AS cost FROM {P} p JOIN {NOTES} n ON n.score_id = p.score_id WHERE abs(s_at - p_at) <= 3780 AND abs(dia - p_dia) <= 3) GROUP BY ALL")


def _near(which):
    def run(spark, d):
        s = slot_rows(spark, d, probed(spark, d)).filter("n_notes > 0" if which == "chord" else "true")
        first = s.groupBy("score_id", "at").agg(F.min(F.struct("measure_idx", "staff", "onset")).alias("s"))
        return L.nearest_within(first, probes(spark, d), BY, "event_id", GRID * 3 // 2, F.struct("at", "s")).select("event_id", "score_id", C("hit.at").alias("hit_at"), C("hit.s.measure_idx").alias("measure_idx"), C("hit.s.staff").alias("staff"), "distance")

    return run


def _near_sql(where):
    return f"""SELECT event_id, score_id, s_at AS hit_at, measure_idx, staff, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, s_at, measure_idx, staff, onset) AS r FROM (
    SELECT p.event_id, p.score_id, s.s_at, s.measure_idx, s.staff, s.onset, abs(s_at - p_at) AS d FROM {P} p JOIN {SLOTS} s ON s.score_id = p.score_id WHERE {where}) WHERE d <= 7560) WHERE r = 1"""


Q.add("f3_nearest_chord", "event_id:l score_id:l hit_at:l measure_idx:l staff:l distance:l", _near("chord"), _near_sql("n_notes > 0"))
Q.add("f4_nearest_slot", "event_id:l score_id:l hit_at:l measure_idx:l staff:l distance:l", _near("slot"), _near_sql("true"))


def _covering(spark, d):
    e, m = tables(spark, d, probed(spark, d))
    at = L.locate(starts_of(e, m).select("score_id", "measure_idx", C("start").alias("at")), probes(spark, d), "event_id").select("event_id", "score_id", "measure_idx", "inside")
    points = A.once(O.staff_events(e, m).groupBy("score_id", "measure_idx", "staff", C("onset").alias("at")).agg(F.max("n_notes").alias("n_notes")))
    staves = points.select("score_id", "measure_idx", "staff").distinct()
    p = at.join(staves, ["score_id", "measure_idx"]).select("score_id", "measure_idx", "staff", C("inside").alias("at"), "event_id")
    return L.as_of(points, p, ["score_id", "measure_idx", "staff"], "at", F.struct("at", "n_notes"), "event_id").filter("found is not null").select("event_id", "score_id", "measure_idx", "staff", C("found.at").alias("slot_at"), C("found.n_notes").alias("n_notes"))


Q.add("f5_covering_slots", "event_id:l score_id:l measure_idx:l staff:l slot_at:l n_notes:l", _covering,
      f"""WITH pr AS (SELECT event_id, p.score_id, coalesce(max(measure_idx) FILTER (start_ <= p_at), min(measure_idx)) AS measure_idx, p_at - coalesce(max(start_) FILTER (start_ <= p_at), min(start_)) AS inside FROM {P} p JOIN starts s ON s.score_id = p.score_id GROUP BY event_id, p.score_id, p_at),
      pt AS (SELECT score_id, measure_idx, staff, onset AS x, max(n_notes) AS n_notes FROM staff_event_rows GROUP BY ALL)
      SELECT event_id, pr.score_id, pr.measure_idx, staff, max(x) AS slot_at, arg_max(n_notes, x) AS n_notes FROM pr JOIN pt ON pt.score_id = pr.score_id AND pt.measure_idx = pr.measure_idx AND x <= inside GROUP BY ALL""")  # fmt: skip
Q.add("f6_exact_slots", "event_id:l score_id:l measure_idx:l staff:l kind:s", lambda spark, d: L.exact_slots(slot_rows(spark, d, probed(spark, d)), A.probes(spark, d).select("event_id", "score_id", (F.floor(C("centibeat") / 100) * GRID).alias("at")), ["score_id", "at"]),
      f"SELECT event_id, p.score_id, measure_idx, staff, kind FROM (SELECT event_id, score_id, centibeat // 100 * 5040 AS p_at FROM probes) p JOIN {SLOTS} s ON s.score_id = p.score_id AND s_at = p_at")
Q.add("f7_slots", "score_id:l measure_idx:l staff:l onset:l kind:s n_notes:l at:l", slot_rows, f'SELECT *, s_at AS "at" FROM {SLOTS}')
Q.add("f8_handles", "score_id:l measure_idx:l elem_idx:l island:l members:l pitches:s", lambda spark, d: (lambda n: n.select("score_id", "measure_idx", "elem_idx", "island").join(n.groupBy("score_id", "measure_idx", "island").agg(F.count("*").alias("members"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("diatonic", "elem_idx"))), lambda x: x["diatonic"].cast("string")), " ").alias("pitches")), ["score_id", "measure_idx", "island"]))(O.chord_islands(A.note_elements(spark, d)).filter("not is_rest")),
      "SELECT score_id, measure_idx, elem_idx, island, count(*) OVER w AS members, string_agg(diatonic, ' ') OVER (PARTITION BY score_id, measure_idx, island ORDER BY diatonic, elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS pitches FROM islands WHERE NOT is_rest WINDOW w AS (PARTITION BY score_id, measure_idx, island)")


def _axis(spark, d):
    e, m = tables(spark, d, probed(spark, d))
    axis = A.once(O.spine(e, m))
    return axis, O.measure_offsets(axis), A.once(starts_of(e, m))


def _from_x(spark, d):
    axis, offsets, s = _axis(spark, d)
    p = A.probes(spark, d).select("event_id", "score_id", F.floor(C("centibeat") / 4).cast("long").alias("x"))
    return L.nearest_axis_point(axis, offsets, s, p, "event_id", C("hit.div"), GRID // 4)


OFFSETS = "(SELECT *, coalesce(sum(width) OVER (PARTITION BY score_id ORDER BY measure_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft FROM (SELECT score_id, measure_idx, max(x + advance) AS width FROM spine_rows GROUP BY ALL))"
Q.add("f9_from_x", "event_id:l score_id:l measure_idx:l beat:l", _from_x,
      f"""WITH o AS {OFFSETS}, m AS (SELECT event_id, p.score_id, coalesce(arg_max(measure_idx, lft) FILTER (lft <= px), arg_min(measure_idx, measure_idx)) AS measure_idx, px - coalesce(max(lft) FILTER (lft <= px), arg_min(lft, measure_idx)) AS inside
      FROM (SELECT event_id, score_id, centibeat // 4 AS px FROM probes) p JOIN o ON o.score_id = p.score_id GROUP BY event_id, p.score_id, px),
      n AS (SELECT m.*, div_, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - inside), x, div_) AS r FROM m JOIN spine_rows s ON s.score_id = m.score_id AND s.measure_idx = m.measure_idx)
      SELECT event_id, n.score_id, n.measure_idx, greatest(start_, least(start_ + div_, start_ + length_ - 1260)) AS beat FROM n JOIN starts s ON s.score_id = n.score_id AND s.measure_idx = n.measure_idx WHERE r = 1""")  # fmt: skip


def _interpolated(spark, d):
    axis, offsets, s = _axis(spark, d)
    points = axis.join(offsets, ["score_id", "measure_idx"]).join(s, ["score_id", "measure_idx"]).select("score_id", (C("start") + C("div")).alias("at"), (C("left") + C("x")).alias("x"))
    return L.interpolated(points.groupBy("score_id", "at").agg(F.min("x").alias("x")), probes(spark, d), BY, "event_id")


Q.add("f10_interpolated_x", "event_id:l score_id:l x:d", _interpolated,
      f"""WITH o AS {OFFSETS}, pt AS (SELECT s.score_id, start_ + div_ AS a, min(lft + x) AS x FROM spine_rows s JOIN o ON o.score_id = s.score_id AND o.measure_idx = s.measure_idx JOIN starts t ON t.score_id = s.score_id AND t.measure_idx = s.measure_idx GROUP BY 1, 2),
      nx AS (SELECT *, lead(a) OVER w AS na, lead(x) OVER w AS nx FROM pt WINDOW w AS (PARTITION BY score_id ORDER BY a)),
      h AS (SELECT event_id, p.score_id, p_at, max(a) FILTER (a <= p_at) AS a, arg_min(x, a) AS first_x FROM {P} p JOIN pt ON pt.score_id = p.score_id GROUP BY ALL)
      SELECT event_id, h.score_id, CASE WHEN h.a IS NULL THEN first_x WHEN na IS NULL THEN x ELSE x + (nx - x) * (CAST(p_at - h.a AS DOUBLE) / (na - h.a)) END AS x FROM h LEFT JOIN nx ON nx.score_id = h.score_id AND nx.a = h.a""")  # fmt: skip
Q.add("f11_top_first", "score_id:l measure_idx:l elem_idx:l top:l", lambda spark, d: L.top_first(O.chord_islands(A.note_elements(spark, d)).filter("not is_rest")), "SELECT *, row_number() OVER (PARTITION BY score_id, measure_idx, island ORDER BY diatonic DESC, elem_idx) - 1 AS top FROM islands WHERE NOT is_rest")
Q.add("f12_tie_partners", "score_id:l measure_idx:l elem_idx:l ahead:l behind:l", lambda spark, d: L.tie_partners(O.time_cursor(A.note_elements(spark, d)).filter("tag = 'note' and not is_rest and not is_grace").select(*MEASURE, "staff", "elem_idx", "onset", "step", "alter", "octave")).select("score_id", "measure_idx", "elem_idx", (C("ahead.measure_idx") * 1000 + C("ahead.elem_idx")).alias("ahead"), (C("behind.measure_idx") * 1000 + C("behind.elem_idx")).alias("behind")),
      """WITH r AS (SELECT *, dense_rank() OVER (PARTITION BY score_id, staff ORDER BY measure_idx, onset) AS rk, measure_idx * 1000 + elem_idx AS h FROM timed WHERE tag = 'note' AND NOT is_rest AND NOT is_grace)
      SELECT a.score_id, a.measure_idx, a.elem_idx, min(b.h) FILTER (b.rk = a.rk + 1) AS ahead, max(b.h) FILTER (b.rk = a.rk - 1) AS behind FROM r a LEFT JOIN r b ON b.score_id = a.score_id AND b.staff = a.staff AND b.step = a.step AND b.alter_ = a.alter_ AND b.octave = a.octave AND b.rk IN (a.rk - 1, a.rk + 1) GROUP BY ALL""")  # fmt: skip
Q.add("f13_grace_hosts", "score_id:l measure_idx:l elem_idx:l grace_group:l host_elem:l", lambda spark, d: L.grace_runs(A.note_elements(spark, d)),
      """SELECT *, CASE WHEN NOT hr THEN h END AS host_elem FROM (SELECT *, sum(CASE WHEN NOT is_chord THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx) AS grace_group, first_value(CASE WHEN NOT is_grace THEN elem_idx END IGNORE NULLS) OVER f AS h, first_value(CASE WHEN NOT is_grace THEN is_rest END IGNORE NULLS) OVER f AS hr
      FROM note_elements WHERE tag = 'note' WINDOW f AS (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE is_grace""")  # fmt: skip
# The driver's pages have few staves: each 40 rows that have any ink hold one here, of at most eight rows, so that links between them can be looked for.
Q.add("f14_ink_links", "page_id:l staff_no:l share:d linked:b", lambda spark, d: L.linked_by_ink(A.page_profile(spark, d).groupBy("page_id", F.floor(C("y") / 40).alias("staff_no")).agg(F.min("y").alias("top"), F.least(F.max("y"), F.min("y") + 7).alias("bottom")), A.ink_runs(spark, d), 0.6, 0, 30),
      """WITH s AS (SELECT page_id, y // 40 AS staff_no, min(y) AS top, least(max(y), min(y) + 7) AS bottom FROM page_profile GROUP BY ALL), p AS (SELECT *, lead(top) OVER (PARTITION BY page_id ORDER BY staff_no) AS nxt FROM s),
      r AS (SELECT page_id, staff_no, unnest(range(bottom + 1, nxt)) AS y FROM p WHERE nxt > bottom + 1)
      SELECT r.page_id, staff_no, CAST(count(i.y) AS DOUBLE) / count(*) AS share, CAST(count(i.y) AS DOUBLE) / count(*) >= 0.6 AS linked FROM r LEFT JOIN (SELECT DISTINCT page_id, y FROM ink_runs WHERE x0 < 30 AND x1 > 0) i ON i.page_id = r.page_id AND i.y = r.y GROUP BY ALL""")  # fmt: skip
Q.add("f15_chord_leads", "score_id:l measure_idx:l elem_idx:l lead:l", lambda spark, d: L.chord_leads(A.note_elements(spark, d)), 'SELECT *, coalesce(last_value(CASE WHEN NOT is_chord THEN elem_idx END IGNORE NULLS) OVER (PARTITION BY score_id, measure_idx ORDER BY elem_idx ROWS UNBOUNDED PRECEDING), elem_idx) AS lead FROM note_elements WHERE tag = \'note\' AND NOT is_grace')

QUERIES, ORACLES = Q.queries, Q.oracles
