"""Note pairing, undo steps and page offsets over streams. A key's rows of a micro-batch are put in order before they meet the
key's state; state is a few values a key, and old state leaves by event-time timers.

Rows that come later than the watermark allows are not lost silently: pairing and undo steps give a row of kind ``late`` with their number
for each key and micro-batch, beside the results proper. For that the event time is handed on as plain milliseconds, as Spark drops late rows
of a column that it knows to be the event time before they reach a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTES = "track long, note long, start long, end long, velocity long, end_seq long"
STEPS = "doc_id long, seq long, step long, first_seq long"
PAGES = "doc_id long, page_no long, offset long"
#: What is known of an open beginning.
OPEN = ("track", "note", "tick", "velocity", "seq", "until")
#: Buckets of (track, note)s, of which a stream's state has a list each.
BUCKETS = 1024
#: What ends a run of edits that coalesce; a redo after an edit has nothing to do, and after an undo the run has ended already.
BREAKS = ("undo", "reset")


def _rows(frames: Iterator[pd.DataFrame], order: list[str], watermark: int | None = None) -> tuple[pd.DataFrame, int]:
    """The rows in order, without those before the watermark, and how many these are."""
    rows = pd.concat(list(frames))
    late = rows["at"] < watermark if watermark is not None else pd.Series(False, index=rows.index)
    return rows[~late].sort_values(order), int(late.sum())


def _out(names: str, found: list[tuple], key: tuple, late: int, kind: str = "row") -> pd.DataFrame:
    """Results as rows of a kind, and a row that counts late ones."""
    columns = [c.split()[0] for c in names.split(", ")]
    out = pd.DataFrame(found, columns=columns).assign(kind=kind, n=1)
    if late:
        lost = pd.DataFrame([(*key, *[None] * (len(columns) - len(key)), "late", late)], columns=[*columns, "kind", "n"])
        out = pd.concat([out, lost]) if len(out) else lost
    return out[["kind", "n", *columns]].astype({c: "Int64" for c in [*columns, "n"]})


class Pairing(StatefulProcessor):
    """State: the open beginnings of a bucket of (track, note)s, as one list, so that a micro-batch calls Python and the store once a bucket and not once a
    key. A timer of the bucket forgets those whose end has not come for so long."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", ", ".join(f"{c} array<long>" for c in OPEN) + ", timer long")

    def _known(self) -> tuple[pd.DataFrame, int | None]:
        """The open beginnings and when the timer rings."""
        *lists, timer = self.open.get() if self.open.exists() else (*[[]] * len(OPEN), None)
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in zip(OPEN, lists)}), timer

    def _keep(self, left: pd.DataFrame, timer: int | None) -> None:
        """Puts what is open into the state, and the timer to the first of these to be forgotten."""
        first = int(left["until"].min()) if len(left) else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if first is not None:
            self.open.update((*[[None if pd.isna(x) else int(x) for x in left[c]] for c in OPEN], first))
        elif timer is not None:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows, late = pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs()
        rows = rows.astype({c: "Int64" for c in ("track", "note", "seq", "tick", "velocity", "at")})
        behind = rows["at"] < late
        lost = rows[behind].groupby(["track", "note"], dropna=False).size().reset_index(name="n").assign(kind="late")
        rows = rows[~behind].assign(until=lambda r: r["at"] + self.patience, new=1)
        before, timer = self._known()
        both = pd.concat([before.assign(begins=True, new=0), rows[[*OPEN, "begins", "new"]]])
        both["key"] = both.groupby(["track", "note"], dropna=False, sort=False).ngroup()
        both = both.sort_values(["key", "new", "seq"], kind="stable", ignore_index=True)
        both["begins"] = both["begins"].fillna(False).astype(bool)
        last = both.shift(1)
        ends = ~both["begins"] & (last["key"] == both["key"]) & last["begins"].eq(True)  # an end pairs with the beginning just before it
        found = pd.DataFrame({"track": both["track"], "note": both["note"], "start": last["tick"], "end": both["tick"], "velocity": last["velocity"], "end_seq": both["seq"]})[ends]
        self._keep(both[both["begins"] & ~both["key"].duplicated(keep="last")], timer)
        out = pd.concat([found.assign(kind="row", n=1), lost]) if len(lost) else found.assign(kind="row", n=1)
        yield self._named(key, out[["kind", "n", *found.columns]].astype({c: "Int64" for c in ["n", *found.columns]}))

    @staticmethod
    def _named(key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        """Rows of a bucket below nought without the track or the note that its keys lack."""
        for bit, c in ((1, "track"), (2, "note")):
            if key[0] < 0 and -key[0] & bit:
                out[c] = pd.array([None] * len(out), "Int64")
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The beginnings that are forgotten, as rows of kind ``expired`` with their place as end_seq."""
        known, timer = self._known()
        gone = known["until"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        self._keep(known[~gone], None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if gone.all():
            self.open.clear()
        yield self._named(key, _out(NOTES, [(r.track, r.note, r.tick, None, r.velocity, r.seq) for r in known[gone].itertuples(index=False)], (), 0, "expired"))

    def close(self) -> None:
        pass


class Steps(StatefulProcessor):
    """State: the last edit of a document, if an edit may still join it, and the number of its step. With idle_ms a timer drops the state of a
    document without edits for so long: by then none can join, and a later step begins to number from 1 again."""

    def __init__(self, gap: int, idle_ms: int | None = None):
        self.gap, self.idle = gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "coalesce_key string, seq long, step long, first_seq long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows, late = _rows(rows, ["seq"], timerValues.getCurrentWatermarkInMs() if self.idle is not None else None)
        last, seq, step, first, until = self.last.get() if self.last.exists() else (None, None, 0, None, None)
        found, timer = [], until
        for r in rows.itertuples(index=False):
            if r.op in BREAKS:
                last = None
            elif pd.isna(r.op) or r.op == "commit":
                named = None if pd.isna(r.coalesce_key) else r.coalesce_key
                if named is None or named != last or r.seq - seq >= self.gap:
                    step, first = step + 1, int(r.seq)
                last, seq = named, int(r.seq)
                found.append((*key, seq, step, first))
            if self.idle is not None:
                until = max(until or 0, int(r.at) + self.idle)
        self.last.update((last, seq, step, first, until))
        if until != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        yield _out(STEPS, found, key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[4] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield _out(STEPS, [], key, 0)

    def close(self) -> None:
        pass


class Pages(StatefulProcessor):
    """State: the next page of a document and where it begins; a map of the pages that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "page_no long, offset long")
        self.waiting = handle.getMapState("waiting", "page_no long", "span long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        page, offset = self.next.get() if self.next.exists() else (0, 0)
        found = []
        for r in _rows(rows, ["page_no"])[0].itertuples(index=False):
            self.waiting.updateValue((int(r.page_no),), (int(r.span),))
        while self.waiting.containsKey((page,)):
            found.append((*key, page, offset))
            offset += self.waiting.getValue((page,))[0]
            self.waiting.removeKey((page,))
            page += 1
        self.next.update((page, offset))
        yield _out(PAGES, found, key, 0)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, by: list[str], processor: StatefulProcessor, names: str, timers: bool) -> DataFrame:
    return rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"kind string, n long, {names}", outputMode="Append", timeMode="EventTime" if timers else "None")


def _milliseconds(rows: DataFrame) -> DataFrame:
    """The event time as a plain number: Spark keeps the watermark, and late rows come through."""
    return rows.withColumn("at", F.unix_millis("ts")).drop("ts")


def pairing_events(events: DataFrame, patience_ms: int) -> DataFrame:
    """(kind, n, notes' columns) of a stream (track, note, seq, tick, velocity, begins, ts with a watermark): notes as kind ``row``, beginnings that
    no end followed for so long as ``expired``, numbers of late rows as ``late``."""
    # keys with a null have buckets of their own and a nought for it: pandas makes long columns with nulls floating-point
    nulls = F.col("track").isNull().cast("long") + 2 * F.col("note").isNull().cast("long")
    rows = _milliseconds(events).withColumn("bucket", F.when(nulls > 0, -nulls).otherwise(F.pmod(F.xxhash64("track", "note"), F.lit(BUCKETS))))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("track", "note")})
    return _stateful(rows, ["bucket"], Pairing(patience_ms), NOTES, True)


def undo_events(log: DataFrame, gap: int, idle_ms: int | None = None) -> DataFrame:
    """(kind, n, steps' columns) of a stream (doc_id, seq, coalesce_key, perhaps op; with idle_ms also ts with a watermark): edits as kind ``row`` with
    the number of their undo step and its first seq, numbers of late rows as ``late``."""
    log = log if "op" in log.columns else log.withColumn("op", F.lit(None).cast("string"))
    log = _milliseconds(log) if idle_ms is not None else log.withColumn("at", F.lit(0).cast("long"))
    return _stateful(log.select("doc_id", "seq", "coalesce_key", "op", "at"), ["doc_id"], Steps(gap, idle_ms), STEPS, idle_ms is not None)


def paired_notes(events: DataFrame, patience_ms: int) -> DataFrame:
    """The notes of `pairing_events` alone."""
    return pairing_events(events, patience_ms).filter("kind = 'row'").drop("kind", "n")


def undo_steps(log: DataFrame, gap: int, idle_ms: int | None = None) -> DataFrame:
    """Edits of a stream with the number of their undo step: `undo_events` without late rows."""
    return undo_events(log, gap, idle_ms).filter("kind = 'row'").drop("kind", "n", "first_seq")


def page_offsets(pages: DataFrame) -> DataFrame:
    """Where each page's measures begin in its document (doc_id, page_no from 0, span). A page waits for the ones before it."""
    pages = pages.select("doc_id", "page_no", "span", F.lit(0).cast("long").alias("at"))
    return _stateful(pages, ["doc_id"], Pages(), PAGES, False).drop("kind", "n")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, delay: str = "1 hour") -> DataFrame:
    """The events table of a folder as a stream, with a watermark."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now and gives what it has written to the folder. The session's state store is left as it was."""
    spark, (key, store) = stream.sparkSession, STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
