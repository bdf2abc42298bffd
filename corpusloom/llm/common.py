"""Shared helpers of the operators: tables, shared storage, keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space in every word and line rule here.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process, as in tests, is a
    local temporary folder set for it; a cluster without a shared folder is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("corpusloom.shared.dir", base)
    return base.rstrip("/")


#: The folders that this process has named, oldest first.
created: list[str] = []


def new_dir(spark: SparkSession, label: str) -> str:
    created.append(f"{shared_dir(spark)}/corpusloom/{label}-{uuid.uuid4().hex}")
    return created[-1]


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame | str | None) -> None:
    """Deletes saved tables (or folders of ``new_dir``) that nothing reads any more."""
    for x in tables:
        path = x if isinstance(x, str) else getattr(x, "_saved_at", None)
        if path:
            spark = SparkSession.getActiveSession()
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    filesystem, path = open_fs(uri)
    filesystem.create_dir(os.path.dirname(path), recursive=True)
    with filesystem.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_file(uri: str) -> bytes:
    filesystem, path = open_fs(uri)
    with filesystem.open_input_stream(path, compression=None) as src:
        return src.read()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut to a few rows each, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches joined or cut so that a column of each has about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in slices(batches):
        held.append(batch)
        held_bytes += batch.column(column).nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)


def blocks_for(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partitions by ``cols`` into as many partitions as shuffles have."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in cols])


#: A key is hot if it holds more than one in so many of the rows; so there are fewer hot keys than this.
HOT_KEYS = 1000


def joined_by_share(rows: DataFrame, keyed: DataFrame, on: str, held: str, total: Column | int) -> DataFrame:
    """``rows`` with the other columns of ``keyed`` (one row a key ``on``, long or binary; null where it has none).

    ``held`` counts the rows of each key at least, ``total`` all of these.  The hot keys, fewer
    than ``HOT_KEYS`` whatever the tables, are broadcast; rows that they serve are dealt
    by their own hash in the second join, so that no key's rows meet in one task.
    """
    others = [c for c in keyed.columns if c != on]
    named = keyed.select(F.col(on).alias("_key"), F.struct(*others).alias("_found"))
    is_hot = F.col(f"_found.{held}") * HOT_KEYS > total
    hot = named.where(is_hot).select(F.col("_key").alias("_hot"), F.col("_found").alias("_at_once"))
    first = rows.join(F.broadcast(hot), rows[on] == F.col("_hot"), "left")
    own = F.xxhash64(*rows.columns, F.spark_partition_id())
    if rows.schema[on].dataType == T.BinaryType():
        own = own.cast("string").cast("binary")
    # What a hot row may find by its own hash is not looked at.
    first = first.withColumn("_own", F.when(F.col("_hot").isNull(), F.col(on)).otherwise(own))
    second = first.join(named.where(~is_hot).hint("merge"), F.col("_own") == F.col("_key"), "left")
    found = F.coalesce("_at_once", "_found")
    return second.select(*rows.columns, *[found[c].alias(c) for c in others])


def placed(df: DataFrame, name: str, label: str, *order: Column) -> tuple[DataFrame, str]:
    """(``df`` with the row's place from 1 in a total order as long ``name``, the saved table it reads); no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), label)
    # One row a range partition.
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(W.orderBy("_part")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_before", "_inside"), ranged._saved_at


def crc32_sql(values: str) -> str:
    """SQL of the unsigned CRC-32 of a list of bytes, half a byte at a time."""
    halves = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        halves.append(c)
    step = "xor(({c} >> 4), [" + ", ".join(map(str, halves)) + "][(xor({c}, {b}) & 15) + 1])"
    both = step.format(c=f"({step.format(c='c', b='b')})", b="(b >> 4)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: {both}), 4294967295::BIGINT)"


def bytes_sql(text: str) -> str:
    """SQL of the bytes of a text in UTF-8, as a list of numbers."""
    return f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)"
