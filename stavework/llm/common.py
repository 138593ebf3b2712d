"""Helpers shared by the training-data operators.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r"
#: Rows that are few enough to be broadcast, and places over which a hot key is dealt.
FEW_ROWS, SALTS = 100_000, 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def strings(column: pa.Array) -> list[str | None]:
    """The strings of an array; faster than to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def row_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, the same for null and empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, however it writes its own."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def spread_join(large: DataFrame, small: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The inner join on keys, each of which small has once. Small is broadcast if it has at most FEW_ROWS rows; else every row of it goes to
    SALTS places, and the rows of large that share a key are dealt over these by the hash of ``by``."""
    small = checkpointed(small)
    if small.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return large.join(F.broadcast(small), keys)
    salt = unused_name(large, "salt")
    many = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn(salt, F.pmod(F.hash(by), F.lit(SALTS))).join(many, [*keys, salt]).drop(salt)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a session in one process may do without and
    gets a temporary one; on a cluster it would be another one on each machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex[:8]}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a job go when the job has ended; what it has written is read from the shared folder after that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables in a folder of their own within the shared folder, all of which go at the end of the context."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again."""
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def __exit__(self, *_: object) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(conf).delete(path, True)
