"""Lookups by position against loops: blocks, ties, probes before and after all points, and a score with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from stavework.operators import lookup as L


def tables(spark, seed, scores=3):
    rng = random.Random(seed)
    points = [(rng.randrange(scores), rng.randrange(-40, 200), rng.randrange(5)) for _ in range(60)]
    probes = [(rng.randrange(scores + 1), rng.randrange(-60, 230), i) for i in range(120)]
    return points, probes, spark.createDataFrame(points, "score_id long, at long, v long"), spark.createDataFrame(probes, "score_id long, at long, event long")


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_points_around(spark, block):
    points, probes, p, q = tables(spark, block)
    got = {r.event: (r.back, r.ahead) for r in L.around(p, q, ["score_id"], "at", F.struct("at", "v"), "event", block=block).collect()}
    for s, at, e in probes:
        mine = [(x, v) for o, x, v in points if o == s]
        back, ahead = max((m for m in mine if m[0] <= at), default=None), min((m for m in mine if m[0] > at), default=None)
        assert tuple(x and tuple(x) for x in got[e]) == (back, ahead)


def test_a_long_score_is_many_groups(spark):
    """A score with nearly all rows: no window holds more than a block of it."""
    points = spark.range(0, 5000).selectExpr("1L as score_id", "id * 10 as at", "id as v").union(spark.sql("select 2L, 5L, 0L"))
    probes = spark.range(0, 5000).selectExpr("1L as score_id", "id * 10 + 3 as at", "id as event")
    got = L.around(points, probes, ["score_id"], "at", F.col("v"), "event", block=1000)
    assert got.filter("back = event and (ahead = event + 1 or event = 4999 and ahead is null)").count() == 5000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_block" in plan.split("Window")[1]


def test_nearest_note_against_all_pairs(spark):
    rng = random.Random(8)
    notes = [(rng.randrange(2), rng.randrange(300), rng.randrange(20, 30), i) for i in range(150)] + [(0, 50, 25, 900), (0, 50, 25, 899)]
    probes = [(rng.randrange(3), rng.randrange(-20, 320), rng.randrange(17, 33), i) for i in range(200)]
    got = L.nearest_note(spark.createDataFrame(notes, "score_id long, at long, diatonic int, ord long"), spark.createDataFrame(probes, "score_id long, at long, diatonic int, event long"), "event", 30, 40)
    want = {}
    for s, at, d, e in probes:
        near = [(4 * abs(a - at) + 40 * abs(nd - d), o, a, nd) for ns, a, nd, o in notes if ns == s and abs(a - at) <= 30 and abs(nd - d) <= 3]
        if near:
            want[e] = min(near)
    assert {r.event: (r.cost, r.ord, r.at, r.diatonic) for r in got.collect()} == want
