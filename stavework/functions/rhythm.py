"""Duration arithmetic as column expressions; rounding is half up everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type, dot and quarters of the standard durations, largest first.
NOTE_VALUES = (("whole", False, 4.0), ("half", True, 3.0), ("half", False, 2.0), ("quarter", True, 1.5), ("quarter", False, 1.0), ("eighth", True, 0.75), ("eighth", False, 0.5), ("16th", False, 0.25))
#: Length in quarters of a quarter, and beams, by recognised duration name.
DIVISIONS = {"whole": 16, "half": 8, "quarter": 4, "eighth": 2, "sixteenth": 1, "thirty_second": 1}
BEAMS = {"whole": 0, "half": 0, "quarter": 0, "eighth": 1, "sixteenth": 2, "thirty_second": 3}
#: Integer positions: this many to a quarter.
GRID = 5040


def by_name(name: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), name)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def note_divisions(name: Column, dotted: Column) -> Column:
    base = by_name(name, DIVISIONS)
    return F.when(dotted, half_up(base * 1.5)).otherwise(base)


def snapped(start: Column, end: Column, grid: int) -> tuple[Column, Column]:
    """Start and end on the grid, at least one grid step long."""
    s = half_up(start / grid) * grid
    return s, F.greatest(half_up(end / grid) * grid, s + grid)


def standard_durations(divisions: Column) -> Column:
    """The standard durations that are whole numbers of divisions, largest first."""
    spans = F.array(*[F.lit(q) * divisions for _, _, q in NOTE_VALUES])
    return F.transform(F.filter(spans, lambda x: x == F.floor(x)), lambda x: x.cast("long"))


def largest_fit(most: Column, divisions: Column) -> Column:
    return F.coalesce(F.get(F.filter(standard_durations(divisions), lambda d: d <= most), F.lit(0)), F.lit(1).cast("long"))


def decomposed(span: Column, divisions: Column, keep_rest: bool) -> Column:
    """A span as standard durations, greedily; what is left over is last, or dropped."""
    spans = standard_durations(divisions)
    empty = F.array().cast("array<long>")
    state = F.struct(span.cast("long").alias("left"), empty.alias("out"))

    def step(s: Column, d: Column) -> Column:
        n = F.floor(F.greatest(s["left"], F.lit(0)) / d)
        return F.struct((s["left"] - n * d).cast("long").alias("left"), F.concat(s["out"], F.array_repeat(d, n.cast("int"))).alias("out"))

    def finish(s: Column) -> Column:
        return F.when(F.lit(keep_rest) & (s["left"] > 0), F.concat(s["out"], F.array(s["left"]))).otherwise(s["out"])

    return F.aggregate(spans, state, step, finish)


def nearest_standard(units: Column, divisions: Column) -> Column:
    """The nearest standard duration; of two as near, the larger."""
    return -F.array_min(F.transform(standard_durations(divisions), lambda d: F.struct(F.abs(d - units).alias("off"), (-d).alias("d"))))["d"]


def type_and_dot(span: Column, divisions: Column) -> tuple[Column, Column]:
    name, dot = F.lit("quarter"), F.lit(False)
    for n, d, q in reversed(NOTE_VALUES):
        fits = F.lit(q) * divisions == span
        name, dot = F.when(fits, n).otherwise(name), F.when(fits, d).otherwise(dot)
    return name, dot


def measure_length(beats: Column, beat_type: Column, divisions: Column) -> Column:
    return divisions * beats * (F.lit(4.0) / beat_type)


def quarters_of_type(name: Column) -> Column:
    return by_name(name, {"whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25})


def on_grid(position: Column, divisions: Column) -> Column:
    return F.floor(position * GRID / divisions).cast("long")
