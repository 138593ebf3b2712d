"""Queries over page profiles, ink runs, histograms and class scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from stavework.operators import profiles as O
from stavework.operators.windows import over
from stavework.sources import adapters as A

from .base import Queries
from .ctes import CTES

Q = Queries()
C = F.col

CTES |= {
    "profile": "SELECT page_id, y, sum(x1 - x0) AS ink FROM ink_runs GROUP BY ALL",
    "peaks": "SELECT page_id, CAST(sum(ink * y) AS DOUBLE) / sum(ink) AS center, count(*) AS thickness, min(y) AS top FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS run FROM (SELECT *, max(ink) OVER (PARTITION BY page_id) AS peak FROM profile) WHERE ink >= 0.25 * peak) GROUP BY page_id, run",
    "units": "SELECT page_id, quantile_cont(gap, 0.5) AS unit FROM (SELECT page_id, center - lag(center) OVER (PARTITION BY page_id ORDER BY center) AS gap FROM peaks) WHERE gap IS NOT NULL GROUP BY page_id",
    "page_staves": """
SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS staff_no FROM (SELECT page_id, part, chunk, min(center) AS first, max(center) AS last FROM (
  SELECT *, (row_number() OVER (PARTITION BY page_id, part ORDER BY center) - 1) // 5 AS chunk FROM (SELECT *, sum(CASE WHEN gap <= 1.7 * unit THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY center) AS part FROM (
    SELECT p.*, unit, center - lag(center) OVER (PARTITION BY p.page_id ORDER BY center) AS gap FROM peaks p JOIN units u ON u.page_id = p.page_id))) GROUP BY page_id, part, chunk HAVING count(*) = 5)""",
}


def lines(spark, d):
    return O.peak_rows(O.row_profile(A.ink_runs(spark, d)))


def found(spark, d):
    ls = lines(spark, d)
    return O.staves(ls, O.unit_sizes(ls))


Q.add("g1_row_profile", "page_id:l y:l ink:l", lambda spark, d: O.row_profile(A.ink_runs(spark, d)), "SELECT * FROM profile")
Q.add("g2_peak_rows", "page_id:l top:l center:d thickness:l", lines, "SELECT * FROM peaks")
Q.add("g3_unit_size", "page_id:l unit:d", lambda spark, d: O.unit_sizes(lines(spark, d)), "SELECT * FROM units")
Q.add("g4_staves", "page_id:l staff_no:l first:d last:d", found, "SELECT * FROM page_staves")
Q.add("g5_extents", "page_id:l staff_no:l left_x:l right_x:l", lambda spark, d: O.extents(found(spark, d), A.ink_runs(spark, d), 3).withColumnsRenamed({"left": "left_x", "right": "right_x"}),
      """WITH i AS (SELECT s.page_id, staff_no, x0, x1 FROM page_staves s JOIN ink_runs r ON r.page_id = s.page_id AND r.y BETWEEN CAST(floor(first) AS BIGINT) AND CAST(ceil(last) AS BIGINT)),
      c AS (SELECT page_id, staff_no, x, count(*) AS n FROM (SELECT page_id, staff_no, unnest(range(x0, x1)) AS x FROM i) GROUP BY ALL)
      SELECT page_id, staff_no, min(x) AS left_x, max(x) AS right_x FROM c WHERE n >= 3 GROUP BY ALL""")  # fmt: skip
Q.add("g6_reliability", "page_id:l lines:l staves:l reliable:b", lambda spark, d: O.reliable(found(spark, d), lines(spark, d)), "SELECT page_id, lines, coalesce(staves, 0) AS staves, coalesce(staves, 0) > 0 AND 5 * coalesce(staves, 0) >= 0.7 * lines AS reliable FROM (SELECT page_id, count(*) AS lines FROM peaks GROUP BY page_id) LEFT JOIN (SELECT page_id, count(*) AS staves FROM page_staves GROUP BY page_id) USING (page_id)")
Q.add("g7_otsu", "page_id:l threshold:l", lambda spark, d: O.otsu(A.luma_hist(spark, d)),
      """SELECT page_id, CASE WHEN max(v) > 0 THEN arg_max(level, (v, -level)) FILTER (v IS NOT NULL) ELSE 127 END AS threshold FROM (SELECT *, CASE WHEN n - low > 0 THEN CAST(low AS DOUBLE) * CAST(n - low AS DOUBLE) * (CAST(ls AS DOUBLE) / low - CAST(a - ls AS DOUBLE) / (n - low)) * (CAST(ls AS DOUBLE) / low - CAST(a - ls AS DOUBLE) / (n - low)) END AS v FROM (
      SELECT *, sum(cnt) OVER w AS low, sum(cnt * level) OVER w AS ls, sum(cnt) OVER (PARTITION BY page_id) AS n, sum(cnt * level) OVER (PARTITION BY page_id) AS a FROM luma_hist WINDOW w AS (PARTITION BY page_id ORDER BY level))) GROUP BY page_id""")  # fmt: skip
vertical = lambda spark, d: A.ink_runs(spark, d).select("page_id", (C("x0") % 25).alias("column"), C("y").alias("y0"), (C("y") + 1).alias("y1"))
Q.add("g8_staff_space", "page_id:l space:l", lambda spark, d: O.staff_space(vertical(spark, d), F.lit(40)), "SELECT page_id, arg_max(gap, (n, -gap)) AS space FROM (SELECT page_id, gap, count(*) AS n FROM (SELECT page_id, y - lag(y + 1) OVER (PARTITION BY page_id, x0 % 25 ORDER BY y, y + 1) AS gap FROM ink_runs) WHERE gap > 0 AND gap <= 40 GROUP BY ALL) GROUP BY page_id")
Q.add("g9_long_runs", "page_id:l event_id:l", lambda spark, d: O.long_runs(A.ink_runs(spark, d), O.staff_space(vertical(spark, d), F.lit(40))), "SELECT r.page_id, event_id FROM ink_runs r JOIN (SELECT page_id, arg_max(gap, (n, -gap)) AS space FROM (SELECT page_id, gap, count(*) AS n FROM (SELECT page_id, y - lag(y + 1) OVER (PARTITION BY page_id, x0 % 25 ORDER BY y, y + 1) AS gap FROM ink_runs) WHERE gap > 0 AND gap <= 40 GROUP BY ALL) GROUP BY page_id) s ON s.page_id = r.page_id WHERE x1 - x0 >= greatest(3, floor(1.5 * space + 0.5))")
pages = lambda spark, d: A.ink_runs(spark, d).groupBy("page_id").agg(F.max("x1").alias("width"), (F.max("y") + 1).alias("height"))
TILES = """SELECT DISTINCT page_id, greatest(0, least(y0, h - 64)) AS y, greatest(0, least(x0, w - 64)) AS x FROM (SELECT page_id, w, h, y0, unnest(range(0, w, 48)) AS x0 FROM (SELECT page_id, w, h, unnest(range(0, h, 48)) AS y0 FROM (SELECT page_id, max(x1) AS w, max(y) + 1 AS h FROM ink_runs GROUP BY page_id)))"""
Q.add("g10_tiles", "page_id:l y:l x:l", lambda spark, d: O.tiles(pages(spark, d), 64, 48), TILES)
Q.add("g11_inked_tiles", "page_id:l y:l x:l", lambda spark, d: O.inked_tiles(pages(spark, d), A.ink_runs(spark, d), 64, 48),
      f"SELECT * FROM ({TILES}) t WHERE EXISTS (SELECT 1 FROM ink_runs r WHERE r.page_id = t.page_id AND r.y >= t.y AND r.y < t.y + 64 AND r.x0 < t.x + 64 AND r.x1 > t.x)")
Q.add("g12_averaged", "page_id:l cell:l channel:l milli:l", lambda spark, d: O.averaged(A.probs(spark, d).withColumn("cell", C("cell") % 7)).withColumn("milli", F.floor(C("p") * 1000 + 0.5)), "SELECT page_id, cell, channel, floor(avg(CAST(p AS DOUBLE)) * 1000 + 0.5) AS milli FROM (SELECT page_id, cell % 7 AS cell, unnest(v) AS p, unnest(range(0, len(v))) AS channel FROM probs) GROUP BY ALL")
Q.add("g13_best_class", "page_id:l cell:l best:l", lambda spark, d: A.probs(spark, d).select("page_id", "cell", O.best_class(C("v")).alias("best")), "SELECT page_id, cell, list_position(v, list_max(v)) - 1 AS best FROM probs")
Q.add("g14_coverage", "page_id:l coverage:d", lambda spark, d: O.coverage(A.probs(spark, d), O.best_class(C("v")) < 20), "SELECT page_id, avg(CASE WHEN list_position(v, list_max(v)) - 1 < 20 THEN 1.0 ELSE 0.0 END) AS coverage FROM probs GROUP BY page_id")
Q.add("g15_dilated", "page_id:l y:l x0:l x1:l", lambda spark, d: O.dilated(A.ink_runs(spark, d), 2),
      """SELECT page_id, y, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(CASE WHEN x0 <= m THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, y ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, max(x1) OVER (PARTITION BY page_id, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (
      SELECT page_id, unnest(range(y - 2, y + 3)) AS y, x0 - 2 AS x0, x1 + 2 AS x1 FROM ink_runs))) GROUP BY page_id, y, run""")  # fmt: skip


def _iou(spark, d):
    runs = A.ink_runs(spark, d)
    return O.run_iou(O.resampled_runs(runs.filter("event_id % 3 > 0"), 1, 4), O.resampled_runs(runs.filter("event_id % 3 < 2"), 1, 4), runs.select("page_id").distinct())


Q.add("g16_mask_iou", "page_id:l iou:d", _iou,
      """WITH c AS (SELECT page_id, y // 4 AS y, x // 4 AS x, max(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN m < 2 THEN 1 ELSE 0 END) AS b FROM (SELECT page_id, y, unnest(range(x0, x1)) AS x, event_id % 3 AS m FROM ink_runs) GROUP BY ALL)
      SELECT page_id, CAST(count(*) FILTER (a = 1 AND b = 1) AS DOUBLE) / count(*) AS iou FROM c GROUP BY page_id""")  # fmt: skip
numbered = lambda ls: ls.withColumn("line_no", F.row_number().over(over("page_id", ["center"])))
Q.add("g17_structures", "page_id:l same_count:b deviation:d", lambda spark, d: O.compared_structures(numbered(lines(spark, d)), numbered(O.peak_rows(O.row_profile(A.ink_runs(spark, d).filter("event_id % 10 > 0"))))),
      """WITH q AS (SELECT page_id, CAST(sum(ink * y) AS DOUBLE) / sum(ink) AS center FROM (SELECT *, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS run FROM (SELECT *, max(ink) OVER (PARTITION BY page_id) AS peak FROM (SELECT page_id, y, sum(x1 - x0) AS ink FROM ink_runs WHERE event_id % 10 > 0 GROUP BY ALL)) WHERE ink >= 0.25 * peak) GROUP BY page_id, run),
      a AS (SELECT page_id, center, row_number() OVER (PARTITION BY page_id ORDER BY center) AS i FROM peaks), b AS (SELECT page_id, center, row_number() OVER (PARTITION BY page_id ORDER BY center) AS i FROM q)
      SELECT page_id, count(a.center) = count(b.center) AS same_count, max(abs(a.center - b.center)) AS deviation FROM a FULL JOIN b USING (page_id, i) GROUP BY page_id""")  # fmt: skip

QUERIES, ORACLES = Q.queries, Q.oracles
