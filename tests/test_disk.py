"""What queries leave on disk: kept tables, shuffle files, and scores that nothing looks up."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stavework.operators import diff as D
from stavework.operators import lookup as L
from stavework.sources import adapters as A

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def held(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def shuffles(spark) -> set:
    return {f for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}


def kept_by(spark, monkeypatch, name, folder) -> list:
    """The tables that a query keeps."""
    kept, once = [], A.once

    def noted(df):
        kept.append(once(df))
        return kept[-1]

    monkeypatch.setattr(A, "once", noted)
    __spark_entry__.queries()[name](spark, folder).collect()
    return kept


def test_kept_tables_are_small_and_leave_no_shuffle_files(spark):
    folder, old = A.checkpoint_folder(spark), shuffles(spark)
    at = held(folder)
    rows = spark.range(400_000).select((F.col("id") % 1000).alias("score_id"), F.lit("note").alias("tag"), F.lit(1.5).alias("x")).repartition(4, "score_id")
    kept = A.once(rows)
    assert held(folder) - at < 2 * 400_000  # rows of 40 bytes
    assert not shuffles(spark) - old
    assert kept.dtypes == rows.dtypes and kept.count() == 400_000
    assert kept.groupBy("score_id").count().filter("count <> 400").count() == 0


@pytest.mark.parametrize("name", ["f2_nearest_note", "f3_nearest_chord", "f5_covering_slots", "f6_exact_slots", "f9_from_x"])
def test_lookups_keep_probed_scores_only(spark, monkeypatch, name):
    probed = A.probes(spark, MORE).select("score_id").distinct()
    tables = [df for df in kept_by(spark, monkeypatch, name, MORE) if "score_id" in df.columns]
    assert tables and all(df.join(probed, "score_id", "left_anti").isEmpty() for df in tables)


def test_elements_of_some_scores_are_those_of_all(spark):
    some = A.probes(spark, SMALL).select("score_id").distinct().filter("score_id % 3 = 1")
    for every, few in ((A.note_elements(spark, SMALL), A.note_elements(spark, SMALL, some)), (A.measures(spark, SMALL), A.measures(spark, SMALL, some))):
        want = every.join(some, "score_id", "left_semi").select(sorted(every.columns)).collect()
        assert want and sorted(map(str, want)) == sorted(map(str, few.select(sorted(few.columns)).collect()))


def test_tie_partners_by_a_loop(spark):
    notes = [(s, 0, m, 1, e, (e * e + m) % 5, "CDE"[(e + m) % 3], 0, 4) for s in range(3) for m in range(0, 8, 1 + s) for e in range(9)]
    df = spark.createDataFrame(notes, "score_id long, part_idx int, measure_idx int, staff int, elem_idx int, onset long, step string, alter int, octave int")
    want = set()
    for n in notes:
        onsets = sorted({(o[2], o[5]) for o in notes if o[0] == n[0]})
        at = onsets.index((n[2], n[5]))
        same = lambda i: [(o[2], o[4]) for o in notes if o[0] == n[0] and o[6] == n[6] and 0 <= i < len(onsets) and (o[2], o[5]) == onsets[i]]  # noqa: E731, B023
        want.add((n[0], n[2], n[4], min(same(at + 1), default=None), max(same(at - 1), default=None)))
    found = L.tie_partners(df)
    assert {(r["score_id"], r["measure_idx"], r["elem_idx"], r["ahead"] and tuple(r["ahead"]), r["behind"] and tuple(r["behind"])) for r in found.collect()} == want


def test_ties_keep_scores_with_edits_only(spark, monkeypatch):
    edited = A.edits(spark, MORE).select("score_id").distinct()
    tables, once = [], A.once
    monkeypatch.setattr(L.tie_partners, "__defaults__", (lambda df: tables.append(once(df)) or tables[-1],))
    __spark_entry__.queries()["i6_ties"](spark, MORE).collect()
    assert tables and all(df.join(edited, "score_id", "left_anti").isEmpty() for df in tables)


def test_streams_dealt_by_order_are_the_same(spark):
    columns = ["score_id", "measure_idx", "idx", "pitch", "step", "octave", "mark", "size"]
    for make in (A.note_elements, A.recovered_elements):
        want = D.note_stream(make(spark, SMALL)).select(columns).collect()
        got = D.note_stream(make(spark, SMALL, keyed=True), ("order_key",), A.once).select(columns).collect()
        assert want and sorted(got) == sorted(want)
        sizes = {}
        for r in want:
            sizes[r["score_id"]] = sizes.get(r["score_id"], 0) + 1
        assert all(r["size"] == sizes[r["score_id"]] for r in want)


@pytest.mark.parametrize("name", ["h4_alignment", "h5_note_differences", "h8_report", "h8_aligned_comparison", "b23_texts"])
def test_alignments_write_little(spark, name):
    """What they leave in the checkpoint folder, by the notes: 189 to 291 bytes a note when whole streams were kept."""
    folder = A.checkpoint_folder(spark)
    n, at = A.note_elements(spark, MORE).filter("tag = 'note' and not is_rest").count(), held(folder)
    __spark_entry__.queries()[name](spark, MORE).write.format("noop").mode("overwrite").save()
    assert held(folder) - at < 150 * n
