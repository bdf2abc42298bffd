"""Session helpers: table reading, checkpoints in the shared folder, global numbering."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only where none is set and all runs in one process, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="corpusloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Written once as Parquet in the shared folder and read back: columns are packed, and readers take only those they need."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_within(df: DataFrame, name: str, key: str, *order: Column) -> DataFrame:
    """Adds the row number (from 1) within each value of ``key`` in a total order, without one task seeing all rows of a key.

    Rows are numbered in the order of (key, order); each key's first number comes from
    the counts of each key before it in each range partition, and in those before that.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    # One row for each key and partition: as many as both together, as ranges hold keys in a row.
    counts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.count("*").alias("_rows"))
    before = counts.select("_key", "_p", (F.sum("_rows").over(W.partitionBy("_key").orderBy("_p")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part", key).orderBy(*order))
    placed = ranged.withColumn("_inside", inside)
    joined = placed.join(before, (placed["_part"] == before["_p"]) & placed[key].eqNullSafe(before["_key"]))
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_key", "_p")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the row number (from 1) in a total order, without one task seeing all rows.

    Range partitions are numbered each for itself; the offsets come from one row
    a partition.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


class Rounds:
    """Tables of a loop's rounds in the shared folder: the last two rounds stay, older ones are deleted.

    A round is whole once its state is written, which comes last; with a folder of its own
    (``folder``), a loop that is started again goes on from the last whole round.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{checkpoint_folder(spark)}/rounds-{uuid.uuid4().hex}"

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def table(self, number: int, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of round ``number`` and reads it back."""
        path = f"{self.folder}/{number:06d}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self, number: int, state: dict) -> None:
        """Round ``number`` is whole; the round before the last goes."""
        fs, part = self._at(f"{self.folder}/{number:06d}/_state")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        fs.rename(part, self._at(f"{self.folder}/{number:06d}/state")[1])
        fs.delete(self._at(f"{self.folder}/{number - 2:06d}")[1], True)

    def last(self) -> tuple[int, dict] | None:
        """(number, state) of the last whole round, if there is one."""
        fs, at = self._at(self.folder)
        numbers = sorted((int(x.getPath().getName()) for x in fs.listStatus(at)), reverse=True) if fs.exists(at) else []
        for number in numbers:
            if fs.exists(self._at(f"{self.folder}/{number:06d}/state")[1]):
                return number, json.loads(self.spark.read.text(f"{self.folder}/{number:06d}/state", wholetext=True).first()["value"])
        return None

    def read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{number:06d}/{name}")

    def drop(self) -> None:
        fs, at = self._at(self.folder)
        fs.delete(at, True)
