"""Alignment in tiles against the whole table and against one tile."""

import random

import pytest

from stavework.operators import diff as D
from stavework.sources.adapters import once
from test_golden import plain_align

STREAM = "score_id long, idx int, step string, octave int"


def streams(spark, pairs):
    return [spark.createDataFrame([(n, i, x, 4) for n, pair in pairs.items() for i, x in enumerate(pair[side])], STREAM) for side in (0, 1)]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.score_id, set()).add((-1 if r.s_idx is None else r.s_idx, -1 if r.r_idx is None else r.r_idx))
    return out


@pytest.mark.parametrize("side", [2, 5])
def test_tiles_give_the_same_way(spark, side):
    """Ways of many tiles, streams of unequal lengths and empty ones among them."""
    rng = random.Random(side)
    size = lambda: rng.choice([0, 1, side, 2 * side, 2 * side + 1, rng.randrange(4 * side)])
    pairs = {n: ([rng.choice("ABC") for _ in range(size())], [rng.choice("ABC") for _ in range(size())]) for n in range(60)}
    assert found(D.aligned(*streams(spark, pairs), side=side)) == {n: set(plain_align(a, b)) for n, (a, b) in pairs.items() if a or b}


def test_a_long_pair_is_many_tasks(spark):
    """A pair of 9,000 notes beside short ones, in tiles of 2,000: as many rows as there are tiles on the widest diagonal."""
    rng = random.Random(5)
    a = [rng.choice("CDEFGAB") for _ in range(9000)]
    b = [rng.choice("CDEFGAB") if rng.random() < 0.1 else x for x in a if rng.random() > 0.05]
    tables, sizes = [], []

    def keep(df):
        tables.append(once(df))
        if df.columns == ["score_id", "ti", "tj", "bottom", "right"]:
            sizes.append(tables[-1].count())
        return tables[-1]

    got = found(D.aligned(*streams(spark, {1: (a, b), 2: (["C"], ["D"])}), keep=keep, side=2000))
    assert got == {1: set(D.align(a, b)), 2: {(0, 0)}}
    waves = sizes[:-1]  # the last table is all of them
    assert waves == [1, 2, 3, 4, 5, 4, 3, 2] and sizes[-1] == 24


def test_a_tile_keeps_its_edges():
    """The edges of the last of four tiles are those of the whole table's last row and column."""
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, 11), rng.integers(0, 3, 9)
    top, left = -np.arange(10, dtype=np.int32), -np.arange(12, dtype=np.int32)
    bottom, right = D.edges(x, y, top, left)
    b1, r1 = D.edges(x[:5], y[:4], top[:5], left[:6])
    b2, r2 = D.edges(x[:5], y[4:], top[4:], r1)
    b3, r3 = D.edges(x[5:], y[:4], b1, left[5:])
    b4, r4 = D.edges(x[5:], y[4:], b2, r3)
    assert (b4 == bottom[4:]).all() and (r4 == right[5:]).all()


def test_small_tiles_go_the_same_way(monkeypatch):
    """A small tile keeps all its scores; its way back is that of one that fills them in again."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        x, y = rng.integers(0, 4, rng.integers(1, 30)), rng.integers(0, 4, rng.integers(1, 30))
        top, left = -np.arange(len(y) + 1, dtype=np.int32), -np.arange(len(x) + 1, dtype=np.int32)
        ways = []
        for cells in (0, 1 << 18):
            monkeypatch.setattr(D, "SMALL", cells)
            ways.append(D.way_back(x, y, top, left))
        assert ways[0] == ways[1]
