"""Replay of an edit log: any number of edits of a measure, in order, each on what the ones before it have left.

Measures are independent but for moves from one to another. A move is taken from its measure and put into the other; a round folds every measure's
edits up to the first note that has still to come from another measure, and what was taken in a round is put in the next. So there are as many
rounds as the longest chain of moves that wait for each other, however many edits there are. The fold of a measure is a small loop over its own
notes and edits; measures without edits are not touched.

A note is known by the measure and element that it had at first; an added one by its measure and minus the number of its edit. An
edit whose note is not in its measure (any more), whose measure is unknown or which moves a note to an unknown measure does nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stavework.sources.adapters import once

from .windows import MEASURE, PART, over

C = F.col
NOTE = "from_measure int, elem_idx int, onset long, duration long, staff int, voice int, step string, alter int, octave int"
FIELDS = [c.split()[0] for c in NOTE.split(", ")]
RESULT = f"score_id long, part_idx int, measure_idx int, kind string, seq long, {NOTE}"
ARGUMENTS = ("at", "wanted")
#: Standard lengths in quarters, the largest first.
QUARTERS = (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.25)


def fits(most: int, divisions: int) -> int:
    """The largest standard length of at most so many divisions, else 1."""
    return next((int(q * divisions) for q in QUARTERS if (q * divisions).is_integer() and q * divisions <= most), 1)


def put(notes: list[dict], note: dict, at: int, length: int, divisions: int) -> None:
    """A note at a place of the measure that holds it, as long as it was or as fits before the next onset of its staff."""
    note["onset"] = max(min(at, length - 1), 0)
    ends = min((n["onset"] for n in notes if n["staff"] == note["staff"] and n["onset"] > note["onset"]), default=length)
    note["duration"] = fits(min(note["duration"], ends - note["onset"]), divisions)
    notes.append(note)


def resized(notes: list[dict], note: dict, wanted: int, length: int) -> None:
    """A new length for the note's chord in its voice, not beyond the voice's next onset."""
    voice = [n for n in notes if (n["staff"], n["voice"]) == (note["staff"], note["voice"])]
    ends = min((n["onset"] for n in voice if n["onset"] > note["onset"]), default=max(length, note["onset"] + 1))
    for n in voice:
        if n["onset"] == note["onset"]:
            n["duration"] = max(min(wanted, ends - note["onset"]), 1)


def folded(notes: list[dict], edits: list[dict], divisions: int) -> tuple[list[dict], list[tuple[int, dict | None]], int | None]:
    """A measure's notes after its edits, what was taken for other measures by seq (None: nothing was there), and the last seq that was done."""
    taken, done = [], None
    for e in edits:
        op, length = e["op"], e["length"]
        note = next((n for n in notes if n["from_measure"] == e["measure_idx"] and n["elem_idx"] == e["elem_idx"]), None)
        if op == "put":
            if e["came"] is None:
                break
            if e["came"]:
                put(notes, {f: e[f"t_{f}"] for f in FIELDS}, e["at"], length, divisions)
        elif op == "add":
            put(notes, {"from_measure": e["measure_idx"], "elem_idx": -e["nr"], "onset": 0, "duration": e["wanted"], **{f: e[f] for f in ("staff", "voice", "step", "alter", "octave")}}, e["at"], length, divisions)
        elif op == "move" and e["to_measure"] != e["measure_idx"]:
            taken.append((e["seq"], note))
            notes = [n for n in notes if n is not note]
        elif note is None:
            pass
        elif op == "remove":
            notes.remove(note)
        elif op == "move":
            notes.remove(note)
            put(notes, note, e["at"], length, divisions)
        elif op == "pitch":
            note |= {f: e[f] for f in ("step", "alter", "octave") if e[f] is not None}
        elif op == "duration":
            resized(notes, note, e["wanted"], length)
        done = e["seq"]
    return notes, taken, done


def replayed(notes: DataFrame, log: DataFrame, lengths: DataFrame, divisions: int = 4, keep: Callable[[DataFrame], DataFrame] = once) -> DataFrame:
    """The notes (score_id, part_idx, measure_idx, from_measure, elem_idx, onset, duration, staff, voice, step, alter, octave) after all edits of the log.

    notes: those columns but from_measure; log: score_id, part_idx, measure_idx, seq, op (add, remove, move, pitch, duration), elem_idx and the arguments at, wanted,
    to_measure, staff, voice, step, alter, octave, of which an op reads its own; lengths: score_id, part_idx, measure_idx, length. keep writes
    a table where all executors can read it."""
    notes = notes.withColumn("from_measure", C("measure_idx")).select(*MEASURE, *[C(c.split()[0]).cast(c.split()[1]) for c in NOTE.split(", ")])
    known = lengths.select(*MEASURE, C("length").cast("long"))
    edits = log.withColumn("nr", F.row_number().over(over(MEASURE, ["seq"]))).join(known, list(MEASURE))
    there = known.select(*PART, C("measure_idx").alias("to_measure"), C("length").alias("to_length"))
    edits = edits.join(there, [*PART, "to_measure"], "left").filter("op <> 'move' or to_length is not null")
    puts = edits.filter("op = 'move' and to_measure <> measure_idx").withColumn("measure_idx", C("to_measure")).withColumn("length", C("to_length")).withColumn("op", F.lit("put"))
    nothing = [F.lit(None).cast("boolean").alias("came"), *[F.lit(None).cast(c.split()[1]).alias(f"t_{c.split()[0]}") for c in NOTE.split(", ")]]  # what a put waits for
    pending = keep(edits.unionByName(puts).select(*MEASURE, "seq", "op", "nr", "length", "to_measure", "elem_idx", *[C(c).cast("long") for c in ARGUMENTS], C("staff").cast("int"), C("voice").cast("int"), "step", C("alter").cast("int"), C("octave").cast("int"), *nothing))
    touched = pending.select(*MEASURE).distinct()
    state, rest = keep(notes.join(touched, list(MEASURE), "left_semi")), notes.join(touched, list(MEASURE), "left_anti")
    schema = to_arrow_schema(notes.sparkSession.createDataFrame([], RESULT).schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Measures (score_id, part_idx, measure_idx, have, todo) folded, the rows of many of them in a batch."""
        for batch in batches:
            rows = []
            for *key, have, todo in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left, taken, done = folded(have or [], sorted(todo, key=lambda e: e["seq"]), divisions)
                rows += [(*key, "note", None, *[n[f] for f in FIELDS]) for n in left]
                rows += [(*key, "taken" if n else "nothing", seq, *[n[f] if n else None for f in FIELDS]) for seq, n in taken]
                rows.append((*key, "done", done, *[None] * len(FIELDS)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    gathered = lambda df, name: df.groupBy(*MEASURE).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in PART])).alias(name))
    came = ["came", *[f"t_{f}" for f in FIELDS]]
    while pending.limit(1).count():
        # only measures whose next edit can be done take part
        active = pending.groupBy(*MEASURE).agg(F.min_by(F.struct("op", "came"), "seq").alias("e")).filter("e.op <> 'put' or e.came is not null").select(*MEASURE)
        todo, have = (gathered(df.join(active, list(MEASURE), "left_semi"), name) for df, name in ((pending, "todo"), (state, "have")))
        found = keep(todo.join(have, list(MEASURE), "left").select(*MEASURE, "have", "todo").mapInArrow(fold, RESULT))
        done = found.filter("kind = 'done'").select(*MEASURE, C("seq").alias("upto"))
        state = keep(state.join(done, list(MEASURE), "left_anti").unionByName(found.filter("kind = 'note'").select(*MEASURE, *FIELDS)))
        new = found.filter("kind in ('taken', 'nothing')").select(*PART, "seq", F.lit("put").alias("op"), (C("kind") == "taken").alias("new_came"), *[C(f).alias(f"new_t_{f}") for f in FIELDS])
        left = pending.join(done, list(MEASURE), "left").filter("upto is null or seq > upto").drop("upto").join(new, [*PART, "seq", "op"], "left")
        pending = keep(left.select(*[F.coalesce(c, f"new_{c}").alias(c) if c in came else c for c in pending.columns]))
    return state.unionByName(rest)
