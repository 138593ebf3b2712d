"""Tiles and masks of runs against cells."""

import random

import pytest

from stavework.operators import profiles as P

RUN = "page_id long, y long, x0 long, x1 long"


def page_runs(seed, pages=4):
    rng = random.Random(seed)
    size = {p: (rng.choice([1, 5, 16, 17, 40]), rng.choice([1, 6, 16, 33])) for p in range(pages)}
    rows = [(p, rng.randrange(h), x := rng.randrange(w), rng.randrange(x, w) + 1) for p, (w, h) in size.items() for _ in range(rng.randrange(5))]
    return size, rows


@pytest.mark.parametrize("window,step", [(16, 12), (5, 5), (4, 7), (3, 1)])
def test_inked_tiles_against_all_pairs(spark, window, step):
    for seed in range(3):
        size, runs = page_runs(seed * 10 + window)
        pages = spark.createDataFrame([(p, w, h) for p, (w, h) in size.items()], "page_id long, width long, height long")
        tiles = {tuple(r) for r in P.tiles(pages, window, step).select("page_id", "y", "x").collect()}
        want = {(p, y, x) for p, y, x in tiles if any(q == p and y <= ry < y + window and x0 < x + window and x1 > x for q, ry, x0, x1 in runs)}
        got = [tuple(r) for r in P.inked_tiles(pages, spark.createDataFrame(runs, RUN), window, step).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_iou_of_runs_against_cells(spark):
    for seed in range(3):
        (size, a), (_, b) = page_runs(seed, 5), page_runs(seed, 5)
        b = b[::2] + [(p, y, x0, x1 + 2) for p, y, x0, x1 in a[::2]]
        cells = lambda runs: {p: {(x // 4, y // 4) for q, y, x0, x1 in runs if q == p for x in range(x0, x1)} for p in size}
        ca, cb = cells(a), cells(b)
        got = P.run_iou(*[P.resampled_runs(spark.createDataFrame(r, RUN), 1, 4) for r in (a, b)], spark.createDataFrame([(p,) for p in size], "page_id long"))
        assert {r.page_id: r.iou for r in got.collect()} == {p: len(ca[p] & cb[p]) / len(ca[p] | cb[p]) if ca[p] | cb[p] else 1.0 for p in size}
