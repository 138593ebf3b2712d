"""Streams of several batches against one batch, late rows, timers, and all kinds of a history log."""

import random
import uuid
from datetime import datetime, timedelta

from stavework.operators import edits as E
from stavework.streaming import stateful

BEGIN = datetime(2024, 1, 1)
EVENT = "track long, note long, seq long, tick long, velocity long, begins boolean, ts timestamp"
LOG = "doc_id long, seq long, coalesce_key string, op string, ts timestamp"


def event(minute, begins, note=60, seq=None):
    return (1, note, minute if seq is None else seq, minute * 10, 64, begins, BEGIN + timedelta(minutes=minute))


def stream(spark, folder, batches, schema, delay):
    """A stream with one micro-batch for each list of rows."""
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)  # files are read in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", delay)


def test_late_rows_are_counted(spark, tmp_path):
    batches = [[event(0, True)], [event(300, True, 61)], [event(301, False, 61)], [event(10, False, seq=302), event(302, True, 62)]]
    got = stateful.finished(stateful.pairing_events(stream(spark, tmp_path / "in", batches, EVENT, "1 minute"), 10**12), str(tmp_path / "run")).collect()
    assert [(r.note, r.start, r.end) for r in got if r.kind == "row"] == [(61, 3000, 3010)]
    assert [(r.note, r.n) for r in got if r.kind == "late"] == [(60, 1)]


def test_a_beginning_expires(spark, tmp_path):
    """An hour's patience: the end after it finds nothing, one within it does."""
    batches = [[event(0, True), event(0, True, 61)], [event(50, False, 61)], [event(90, True, 62)], [event(91, True, 63)], [event(92, False)]]
    got = stateful.finished(stateful.pairing_events(stream(spark, tmp_path / "in", batches, EVENT, "1 minute"), 3_600_000), str(tmp_path / "run")).collect()
    assert [(r.note, r.start, r.end) for r in got if r.kind == "row"] == [(61, 0, 500)]
    assert [(r.note, r.start) for r in got if r.kind == "expired"] == [(60, 0)] and not [r for r in got if r.kind == "late"]


def history(log, gap):
    """The loop: (doc_id, seq, first seq of its step) of every commit."""
    last, out, past, future, first = {}, [], {}, {}, {}
    for doc, seq, key, op, _ in sorted(log, key=lambda r: r[1]):
        p, f = past.get(doc, 0), future.get(doc, 0)
        if op in (None, "commit"):
            if not (key is not None and last.get(doc) and last[doc][0] == key and seq - last[doc][1] < gap):
                p, first[doc] = p + 1, seq
            f, last[doc] = 0, (key, seq) if key is not None else None
            out.append((doc, seq, first[doc]))
        elif op == "undo" and p:
            p, f, last[doc] = p - 1, f + 1, None
        elif op == "redo" and f:
            p, f, last[doc] = p + 1, f - 1, None
        elif op == "reset":
            p, f, last[doc] = 0, 0, None
        past[doc], future[doc] = p, f
    return sorted(out)


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(3), i * 60 + rng.randrange(50), rng.choice(["a", "a", "b", None]), rng.choice(["commit"] * 6 + [None, "undo", "redo", "reset", "save"]), BEGIN + timedelta(seconds=i)) for i in range(n)]


def test_batch_history_against_a_loop(spark):
    for seed in range(3):
        log = random_log(seed)
        got = E.undo_runs(spark.createDataFrame(log, LOG), 300)
        assert sorted((r.doc_id, r.seq, r.first_seq) for r in got.collect()) == history(log, 300)
    steps = E.undo_steps(spark.createDataFrame(log, LOG), 300).collect()
    assert sum(r.edits for r in steps) == len(history(log, 300)) and len(steps) == len({(d, f) for d, _, f in history(log, 300)})


def test_stream_and_batch_agree(spark, tmp_path):
    log = random_log(9)
    cut = [log[k * 80 : k * 80 + 80] for k in range(5)]
    got = stateful.finished(stateful.undo_events(stream(spark, tmp_path / "in", cut, LOG, "1 day"), 300, 1000), str(tmp_path / "run")).collect()
    assert sorted((r.doc_id, r.seq, r.first_seq) for r in got if r.kind == "row") == history(log, 300)
    batch = E.undo_runs(spark.createDataFrame(log, LOG), 300).select("doc_id", "seq", "step").collect()
    assert sorted((r.doc_id, r.seq, r.step) for r in got if r.kind == "row") == sorted(map(tuple, batch))


def test_idle_documents_leave_the_state(spark, tmp_path):
    """After an idle minute a document numbers its steps anew; no edit could have joined the old step."""
    at = lambda s: BEGIN + timedelta(seconds=s)
    batches = [[(1, 0, "a", None, at(0))], [(2, 100_000, "a", None, at(300))], [(2, 100_001, "a", None, at(301))], [(1, 200_000, "a", None, at(400))]]
    got = stateful.finished(stateful.undo_events(stream(spark, tmp_path / "in", batches, LOG, "1 second"), 500, 60_000), str(tmp_path / "run")).collect()
    assert sorted((r.doc_id, r.seq, r.step) for r in got) == [(1, 0, 1), (1, 200_000, 1), (2, 100_000, 1), (2, 100_001, 1)]


def test_pages_wait_for_their_turn(spark, tmp_path):
    pages = [(d, p, 1 + (d + p) % 3) for d in range(2) for p in range(6)]
    random.Random(4).shuffle(pages)
    for k in range(0, 12, 4):
        spark.createDataFrame(pages[k : k + 4], "doc_id long, page_no long, span long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("doc_id long, page_no long, span long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.finished(stateful.page_offsets(rows), str(tmp_path / uuid.uuid4().hex)).collect()
    assert sorted(map(tuple, got)) == sorted((d, p, sum(1 + (d + q) % 3 for q in range(p))) for d in range(2) for p in range(6))


def test_pairing_calls_python_once_a_bucket(spark, tmp_path, monkeypatch):
    """Notes of many keys in few buckets over several batches, a key without a track included, against a loop; a bucket's beginnings expire together."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rng, rows = random.Random(5), []
    for i in range(400):
        rows.append((rng.choice([None, 1, 2, 2**60 + 1]), rng.randrange(9), i, i * 7, rng.randrange(99), rng.random() < 0.6, BEGIN + timedelta(seconds=i)))
    open_, want = {}, []
    for track, note, seq, tick, velocity, begins, _ in rows:
        if begins:
            open_[track, note] = (tick, velocity)
        elif (track, note) in open_:
            want.append((track, note, *[open_[track, note][0], tick, open_.pop((track, note))[1]], seq))
    batches = [rows[k * 100 : k * 100 + 100] for k in range(4)] + [[event(m, False, 99)] for m in (300, 301, 302)]
    got = stateful.finished(stateful.pairing_events(stream(spark, tmp_path / "in", batches, EVENT, "1 minute"), 3_600_000), str(tmp_path / "run")).collect()
    by = lambda r: (str(r[0]), *r[1:])
    assert sorted([(r.track, r.note, r.start, r.end, r.velocity, r.end_seq) for r in got if r.kind == "row"], key=by) == sorted(want, key=by)
    assert sorted([(r.track, r.note, r.start, r.velocity) for r in got if r.kind == "expired"], key=by) == sorted([(*k, *v) for k, v in open_.items()], key=by)
    kept = stateful.pairing_events(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour"), 1)
    assert "bucket" in kept._jdf.queryExecution().analyzed().toString()  # the state's key
