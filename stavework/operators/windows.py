"""Window helpers that most operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEASURE = ("score_id", "part_idx", "measure_idx")
PART = ("score_id", "part_idx")


def names(x: str | tuple | list) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def over(by: str | tuple, order: list):
    return W.partitionBy(*names(by)).orderBy(*order)


def before(w):
    """All rows before the current one."""
    return w.rowsBetween(W.unboundedPreceding, -1)


def upto(w):
    return w.rowsBetween(W.unboundedPreceding, 0)


def after(w):
    return w.rowsBetween(1, W.unboundedFollowing)


def filled(x: Column, w) -> Column:
    """The last value that is not null, up to the current row."""
    return F.last(x, ignorenulls=True).over(upto(w))


def island(starts: Column, w) -> Column:
    """A number for each run of rows; a row where starts holds opens one."""
    return F.sum(starts.cast("int")).over(upto(w))
