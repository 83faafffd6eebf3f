"""Where iterative plans cut their lineage: a folder that driver and executors share; and the files of folders that keep state."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables that this process has written with ``written``, and not removed.
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and everything runs on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not folder:
        if held.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = held.get() if held.isDefined() else f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
    if held.isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small intermediate (eagerly); it survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate as a compressed table in the shared folder and return a scan of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely_among(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among those of ``wanted``, and few others, for a join behind it to tell. A bitmap of hashes, at most
    2^20 longs, goes to the tasks that read, so that most other rows are not shuffled."""
    place = F.xxhash64(column).bitwiseAND((1 << 26) - 1)
    word, bit, names = F.shiftright(place, 6), place.bitwiseAND(63).cast("int"), rows.columns
    marks = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_mark")).groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    return rows.withColumn("_word", word).join(F.broadcast(marks), "_word").where(F.getbit("_marks", bit) == 1).select(names)


def tables_written() -> int:
    """How many intermediates there are so far; a mark for ``remove_since``."""
    return len(_TABLES)


def remove_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Delete the intermediates written since a mark, but the ``keep`` latest. Only for what no later plan reads."""
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _TABLES[mark : len(_TABLES) - keep]:
        path(name).getFileSystem(conf).delete(path(name), True)
    del _TABLES[mark : len(_TABLES) - keep]


class Folder:
    """The files of a state folder, on whatever store it is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.jvm = spark, folder, spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def create(self, name: str) -> bool:
        """Whether this call made the (empty) file; only one of several at the same time does."""
        return self.fs.createNewFile(self.path(name))

    def age(self, name: str) -> float:
        """Seconds since it was written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000
