"""The driver's tables as canonical tables of scores, MIDI logs, token streams and page profiles.

Each function reads whole tables of a folder and returns one canonical table; only the columns that it needs are read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all machines share. Only a session in one process may do without and gets a temporary
    folder; on a cluster that would be another one on each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again: for a plan that uses it several times. It is compressed Parquet, of which a plan reads the columns
    that it needs, and the shuffle files of the job that writes it go when it has ended."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, set_before = f"{checkpoint_folder(spark)}/once-{uuid.uuid4().hex}", spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if set_before is None else spark.conf.set(key, set_before)
    return spark.read.schema(df.schema).parquet(path)


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def measures(spark: SparkSession, folder: str, scores: DataFrame | None = None) -> DataFrame:
    """A customer is a score of one part, each of its orders a measure; attributes are declared values, mostly null. With scores (score_id) only theirs."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, folder, "orders")
    if scores is not None:
        orders = orders.join(scores, F.col("o_custkey") == F.col("score_id"), "left_semi")
    return orders.select(
        k.alias("order_key"), F.col("o_custkey").alias("score_id"), F.lit(0).alias("part_idx"), (F.row_number().over(w) - 1).alias("measure_idx"),
        F.when(priority == "1-URGENT", _pick([1, 2, 4, 8], k % 4)).alias("divisions"),
        F.when(priority == "2-HIGH", (k % 15 - 7).cast("int")).alias("fifths"),
        F.when(priority == "3-MEDIUM", (2 + k % 5).cast("int")).alias("beats"),
        F.when(priority == "3-MEDIUM", (4 + 4 * (k % 2)).cast("int")).alias("beat_type"),
        (k % 5 == 0).alias("repeat_start"), F.when(k % 7 == 0, (2 + k % 2).cast("int")).alias("repeat_times"))


def clefs(spark: SparkSession, folder: str) -> DataFrame:
    """Declared clefs: some measures have one for one of their staves."""
    k = F.col("order_key")
    return measures(spark, folder).filter(k % 6 == 0).select("score_id", "part_idx", "measure_idx", (1 + k % 2).cast("int").alias("staff"), F.when(k % 4 == 0, "F").otherwise("G").alias("sign"), F.when(k % 4 == 0, 4).otherwise(2).alias("line"))


def note_elements(spark: SparkSession, folder: str, scores: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """A line item is an element of its order's measure. With scores (score_id) only theirs: what looks up a few scores needn't carry all through its shuffles.
    If keyed also order_key, a key of the measure by which rows are dealt out already."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    p, s, at = F.col("l_partkey"), F.col("l_suppkey"), F.col("elem_idx")
    note = F.col("tag") == "note"
    lines, held = table(spark, folder, "lineitem"), measures(spark, folder, scores).select("order_key", "score_id", "part_idx", "measure_idx")
    if scores is not None:
        lines = lines.join(held, F.col("l_orderkey") == F.col("order_key"), "left_semi")
    lines = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", (F.row_number().over(w) - 1).alias("elem_idx"))
    rows = lines.join(held, F.col("l_orderkey") == F.col("order_key"))
    rows = rows.withColumn("tag", F.when((at > 0) & (p % 9 == 0), "backup").when(p % 13 == 0, "forward").otherwise("note"))
    rows = rows.withColumn("is_rest", note & (s % 7 == 0))
    rows = rows.withColumn("is_grace", note & ~F.col("is_rest") & (p % 11 == 2)).withColumn("is_chord", note & ~F.col("is_rest") & (at > 0) & (p % 4 == 1))
    return rows.select(
        *["order_key"] * keyed, "score_id", "part_idx", "measure_idx", "elem_idx", "tag", "is_chord", "is_grace", "is_rest",
        (F.col("l_quantity").cast("int") % 8 + 1).alias("duration"), (1 + s % 2).cast("int").alias("staff"), (1 + F.col("l_linenumber") % 2).alias("voice"),
        F.substring(F.lit("CDEFGAB"), (p % 7 + 1).cast("int"), F.lit(1)).alias("step"), (F.col("l_linenumber") % 3 - 1).alias("alter"), (2 + s % 5).cast("int").alias("octave"),
        _pick(["whole", "half", "quarter", "eighth", "16th"], p % 5).alias("type"), (p % 6 == 0).alias("dot"), (p % 2 == 0).alias("slash"),
        (F.col("l_returnflag") == "R").alias("tie_start"), (F.col("l_returnflag") == "A").alias("tie_stop"), p.alias("mark"))


def recovered_elements(spark: SparkSession, folder: str, keyed: bool = False) -> DataFrame:
    """The elements as a recogniser might have read them: some lost, some a step off, some with another accidental."""
    m = F.col("mark")
    step = F.when(m % 19 == 5, F.translate("step", "CDEFGAB", "DEFGABC")).otherwise(F.col("step"))
    return note_elements(spark, folder, keyed=keyed).filter(m % 17 != 3).withColumn("step", step).withColumn("alter", F.when(m % 23 == 7, -F.col("alter")).otherwise(F.col("alter")))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", micros.alias("us"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def midi_events(spark: SparkSession, folder: str) -> DataFrame:
    """A user is a track, ten users a file; ticks are minutes."""
    kind, k = F.col("event_type"), F.col("k")
    tick = F.floor(F.col("us") / 60_000_000) - 28_401_120
    on = kind.isin("click", "view")
    return _events(spark, folder).select(
        F.floor(F.col("user_id") / 10).alias("file_id"), F.col("user_id").alias("track"), F.col("us").alias("seq"), tick.cast("long").alias("tick"), (48 + k % 8).alias("note"),
        F.when(kind.isin("purchase", "error"), "noteOff").otherwise("noteOn").alias("type"), F.when(on, 1 + k).otherwise(0).alias("velocity"), k,
        F.when(k % 10 == 0, F.concat(F.lit("name "), k.cast("string"))).when(k % 10 == 1, "").alias("text"), F.when(k % 20 == 3, 400_000 + 1000 * k).alias("us_per_beat"),
        F.when(k % 25 == 4, 2 + k % 3).alias("num"), F.when(k % 25 == 4, 4).alias("den"), F.when(k % 15 == 5, k % 13 - 6).alias("fifths"), F.when(k % 15 == 5, k % 2).alias("scale"))


def omr_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A user is a staff, ten users a page; every event is a rhythm token with its pitch, lift and slur."""
    kind, k = F.col("event_type"), F.col("k")
    mark = F.when(k % 5 == 0, "repeatStart").when(k % 5 == 1, "repeatEnd").otherwise("barline")
    attribute = F.when(k % 3 == 0, F.concat(F.lit("keySignature_"), (k % 15 - 7).cast("string"))).when(k % 3 == 1, F.when(k % 2 == 0, "clef_G2").otherwise("clef_F4")).otherwise(F.concat(F.lit("timeSignature/"), (3 + k % 2).cast("string")))
    note = F.concat(F.lit("note_"), _pick(["4", "8", "16"], k % 3), F.when(k % 17 == 0, "G").otherwise(""), F.when(k % 4 == 0, ".").otherwise(""), F.when(k % 16 == 4, ".").otherwise(""))
    rhythm = F.when(kind == "click", note).when(kind == "view", F.when(k % 9 == 0, "rest_2m").otherwise("rest_4")).when(kind == "purchase", mark).when(kind == "error", "chord").otherwise(attribute)
    pitch = F.when(k % 29 == 0, ".").otherwise(F.concat(F.substring(F.lit("CDEFGAB"), k % 7 + 1, F.lit(1)), (k % 9 + 1).cast("string")))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("us")) - 1
    return _events(spark, folder).select(
        F.floor(F.col("user_id") / 10).alias("page_id"), F.col("user_id").alias("staff_idx"), pos.alias("pos"), rhythm.alias("rhythm"), pitch.alias("pitch"),
        _pick([".", "#", "b", "N", "##", "bb"], k % 6).alias("lift"), _pick([".", "slurStart", "slurStop", "slurStart_slurStop", "_"], k % 5).alias("slur"), k)


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Positions to look up: a score, a beat in hundredths, a pitch."""
    return _events(spark, folder).select("event_id", F.col("user_id").alias("score_id"), F.round(F.col("value") * 100).cast("long").alias("centibeat"), (14 + F.col("k") % 28).alias("diatonic"))


def page_profile(spark: SparkSession, folder: str) -> DataFrame:
    y = F.floor((F.floor(F.col("us") / 60_000_000) - 28_401_120) / 60).cast("long")
    return _events(spark, folder).groupBy(F.floor(F.col("user_id") / 10).alias("page_id"), y.alias("y")).agg(F.count("*").alias("cnt"))


def ink_runs(spark: SparkSession, folder: str) -> DataFrame:
    y = F.floor((F.floor(F.col("us") / 60_000_000) - 28_401_120) / 60).cast("long")
    x0 = F.col("value").cast("int").cast("long")
    return _events(spark, folder).select(F.floor(F.col("user_id") / 10).alias("page_id"), y.alias("y"), x0.alias("x0"), (x0 + F.col("k") % 20 + 1).alias("x1"), "event_id")


def luma_hist(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).groupBy(F.col("user_id").alias("page_id"), F.least(F.lit(255), F.col("value").cast("int")).cast("long").alias("level")).agg(F.count("*").alias("cnt"))


def probs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("label").alias("page_id"), F.col("vec_id").alias("cell"), F.col("embedding").alias("v"))


def edit_log(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select(F.col("user_id").alias("doc_id"), F.col("us").alias("seq"), F.col("event_type").alias("coalesce_key"), "k")


def with_history(log: DataFrame) -> DataFrame:
    """An edit log (with k) in which some rows undo, redo or reset, and some edits have no key."""
    k = F.col("k")
    op = F.when(k % 11 == 3, "undo").when(k % 17 == 5, "reset").when(k % 7 == 2, "redo")
    return log.withColumn("op", op).withColumn("coalesce_key", F.when(k % 19 > 0, F.col("coalesce_key")))


def recovered_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The measures as a recogniser might have read them: some lost, some with another key or meter."""
    k = F.col("order_key")
    kept = measures(spark, folder).filter(k % 37 != 5)
    return kept.withColumn("fifths", F.when(k % 13 == 0, F.col("fifths") + 1).otherwise(F.col("fifths"))).withColumn("beats", F.when(k % 17 == 0, F.col("beats") + 1).otherwise(F.col("beats")))


def edits(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of scores: a measure, an element, and a number to take arguments from."""
    k = F.col("k")
    return _events(spark, folder).select(F.col("user_id").alias("score_id"), F.col("us").alias("seq"), (k % 10).alias("measure_idx"), (F.floor(k / 10) % 7).cast("int").alias("elem_idx"), k)
