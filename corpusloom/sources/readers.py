"""Sources: dense CSV, sparse triples, positional lists, class maps, SGML, reports.

Wide rows are read as text and split into arrays, never as thousands of columns;
what a file says by line order becomes an explicit column.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import checkpointed, numbered


@dataclass
class Dataset:
    """class_map(y, name) and the tables (features ARRAY<DOUBLE>, y); unlabelled rows have a null y."""

    class_map: DataFrame
    train: DataFrame
    test: DataFrame
    unlabelled: DataFrame | None = None


def dense_csv(spark: SparkSession, path: str) -> DataFrame:
    """features and y (last value of the line); unreadable cells are NaN."""
    cells = F.transform(F.split("value", ","), lambda x: F.coalesce(x.try_cast("double"), F.lit(float("nan"))))
    return spark.read.text(path).where("trim(value) <> ''").select(cells.alias("a")).select(F.slice("a", F.lit(1), F.size("a") - 1).alias("features"), F.element_at("a", -1).cast("int").alias("y"))


def dense_csv_unlabelled(spark: SparkSession, path: str) -> DataFrame:
    """Like dense_csv; the last value is kept as the truth and y is null."""
    return dense_csv(spark, path).select("features", F.lit(None).cast("int").alias("y"), F.col("y").alias("truth"))


def positional(spark: SparkSession, path: str, value: str = "value", first: int = 1) -> DataFrame:
    """(pos, value) of a file, or the part files of a folder, with one value a line; pos counts lines from ``first``.

    Files are split as any text is: no task reads a whole one.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    # Lines keep their order within a block; blocks and files are in order by name and start.
    return numbered(checkpointed(lines), "_pos", F.col("_file"), F.col("_block"), F.col("_at")).select((F.col("_pos") - 1 + first).alias("pos"), F.trim(F.regexp_replace("value", "\\r", "")).alias(value)).where(F.col(value) != "")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(y, name) from one line of comma-separated names; y is the place from 0."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).select(F.col("value").alias("line"))
    return first.select(F.posexplode(F.split("line", ","))).select(F.col("pos").alias("y"), F.trim("col").alias("name"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """tf(doc_id, word_id, n) from lines of three integers; another form stops the job."""
    a = F.split(F.trim("value"), r"\s+")
    ok = (F.size(a) == 3) & F.forall(a, lambda x: x.try_cast("bigint").isNotNull())
    checked = F.when(ok, F.transform(a, lambda x: x.cast("bigint"))).otherwise(F.raise_error(F.concat(F.lit("not three integers: "), "value")).cast("array<bigint>"))
    rows = spark.read.text(path).where("trim(value) <> ''").select(checked.alias("t"))
    return rows.select(F.col("t")[0].alias("doc_id"), F.col("t")[1].cast("int").alias("word_id"), F.col("t")[2].cast("int").alias("n"))


def topic_list(spark: SparkSession, path: str) -> list[str]:
    """The topics of a list, one a line, trimmed: a few hundred that come to the driver."""
    return [r["pos_value"] for r in positional(spark, path, "pos_value").orderBy("pos").collect()]


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) of lines ``name: n``."""
    return spark.read.text(path).where("value like '%:%'").select(F.trim(F.substring_index("value", ":", 1)).alias("name"), F.trim(F.substring_index("value", ":", -1)).cast("long").alias("n"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def load_dataset(spark: SparkSession, map_path: str, train_path: str, test_path: str, unlabelled_path: str | None = None) -> Dataset:
    more = dense_csv_unlabelled(spark, unlabelled_path) if unlabelled_path else None
    return Dataset(class_map(spark, map_path), dense_csv(spark, train_path), dense_csv(spark, test_path), more)


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references replaced."""
    import html

    return text.map(html.unescape, na_action="ignore")


def elements(text: Column, tag: str) -> Column:
    """The contents of every element of this tag."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def element(text: Column, tag: str) -> Column:
    """The content of the first element of this tag; empty if there is none."""
    return F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def sgml_documents(spark: SparkSession, path: str, document: str = "REUTERS", topic: str = "D", body: str = "BODY", encoding: str = "ISO-8859-1") -> DataFrame:
    """(topics ARRAY<STRING>, body) of every document element of the files; white space of bodies is collapsed.

    Files are split where document elements end, so one file is read by many tasks and
    no task holds more than an element; the closing tag is spelt as ``document`` is.
    What stands outside elements is left out; an element within which a file ends is read as far as it goes.
    Topics are the contents of all topic elements, as documents list places and
    people in the same way; choose among them by a list of known topics.
    """
    records = spark.read.option("lineSep", f"</{document}>").text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("t"))
    docs = records.select(F.regexp_extract("t", rf"(?is)<{document}\b.*", 0).alias("d")).where("d <> ''")
    return docs.select(elements(F.col("d"), topic).alias("topics"), F.regexp_replace(unescaped(element(F.col("d"), body)), r"\s+", " ").alias("body"))


def reports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, name, precision, recall, f1, support and the report's accuracy, labelled and unlabelled counts.

    Lines are told by their form, not by their number: a name and four figures,
    or a key and a value.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("t"))
    info = lines.select("file", *[F.regexp_extract("t", rf"(?m)^\s*{k}:\s*([0-9.eE+-]+)", 1).try_cast("double").alias(v) for k, v in (("Acc", "accuracy"), ("#labeled", "labeled"), ("#unlabeled", "unlabeled"))])
    number = r"([0-9]*\.?[0-9]+)"
    row = rf"^\s*(\S.*?)\s+{number}\s+{number}\s+{number}\s+([0-9]+)\s*$"
    split = lines.select("file", F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike(row))
    parts = [F.regexp_extract("line", row, i) for i in range(1, 6)]
    rows = split.select("file", parts[0].alias("name"), *[p.cast("double").alias(x) for p, x in zip(parts[1:], ("precision", "recall", "f1", "support"))])
    return rows.join(info, "file")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path, on any store."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(x.getPath().getName() for x in found if x.isDirectory())
