"""Sinks: dense CSV, ranks, triples, corpus information, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def write_dense_csv(rows: DataFrame, path: str, features: str = "features", label: str = "y", mode: str = "overwrite") -> None:
    """One line a document: features, then the label."""
    line = F.concat_ws(",", F.transform(features, lambda x: x.cast("string")), F.col(label).cast("string"))
    rows.select(line.alias("value")).write.mode(mode).text(path)


def write_class_map(class_map: DataFrame, path: str) -> None:
    names = F.transform(F.array_sort(F.collect_list(F.struct("y", "name"))), lambda s: s["name"])
    class_map.agg(F.concat_ws(",", names).alias("value")).write.mode("overwrite").text(path)


def write_ranks(ranks: DataFrame, path: str, value: str = "word") -> None:
    """Words in rank order, one a line, over part files in order."""
    n = int(ranks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks.repartitionByRange(n, "rank").sortWithinPartitions("rank").select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_triples(tf: DataFrame, path: str) -> None:
    tf.select("doc_id", "word_id", "n").write.mode("overwrite").option("sep", " ").csv(path)


def write_info(info: DataFrame, path: str) -> None:
    """Corpus information, a few lines: kind, name, number, labels by ascending number."""
    info.coalesce(1).sortWithinPartitions("kind", "n", "name").select(F.concat_ws(" ", "kind", "name", F.col("n").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_labels(docs: DataFrame, path: str, label: str = "label", order: str = "new_id") -> None:
    """One label a line in the order of ``order``, over part files in order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.repartitionByRange(n, order).sortWithinPartitions(order).select(F.col(label).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_counters(spark, counters: list[tuple[str, int]], path: str) -> None:
    """A few named numbers, one line each."""
    lines = [(i, f"{name}: {n}") for i, (name, n) in enumerate(counters)]
    spark.createDataFrame(lines, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


@F.pandas_udf(StringType())
def fixed(value: pd.Series, form: pd.Series) -> pd.Series:
    """Numbers as C and Python print them, rounded from their exact binary value; a few rows of a summary."""
    return pd.Series([None if x is None or x != x else format(x, f) for x, f in zip(value, form)])


def write_summary(averages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of averaged class figures, a line a class: figures as %6.2f, the support as %6.0f; then key and value lines.

    averages(name, precision, recall, f1, support, accuracy) has one row a class; mode append adds a further table.
    """
    cells = [fixed(F.col(x), F.lit("6.2f")) for x in ("precision", "recall", "f1")]
    lines = averages.select(F.lit(0).alias("_part"), "name", F.concat_ws(" ", F.rpad("name", 12, " "), *cells, fixed(F.col("support").cast("double"), F.lit("6.0f"))).alias("value"))
    tail = averages.agg(F.max("accuracy").alias("a"), F.count("*").alias("n")).select(F.inline(F.array(
        F.struct(F.lit(1).alias("_part"), F.lit("").alias("name"), F.concat(F.lit("Acc: "), fixed(F.col("a"), F.lit("6.4f"))).alias("value")),
        F.struct(F.lit(2).alias("_part"), F.lit("").alias("name"), F.concat(F.lit("classes: "), F.col("n").cast("string")).alias("value")),
    )))
    lines.unionByName(tail).coalesce(1).sortWithinPartitions("_part", "name").select("value").write.mode(mode).text(path)


def report_text(report: DataFrame, accuracy: float, labelled: int, unlabelled: int | None = None) -> str:
    """The text of one run's report: a line a class, the weighted average, counts and accuracy."""
    rows = report.orderBy(F.col("name") == "avg / total", F.col("name").try_cast("int"), "name").collect()
    width = max([12, *(len(r["name"]) for r in rows)])
    lines = [f"{'':>{width}}  precision    recall  f1-score   support", ""]
    for r in rows:
        if r["name"] == "avg / total":
            lines.append("")
        lines.append(f"{r['name']:>{width}}  {r['precision']:9.2f} {r['recall']:9.2f} {r['f1']:9.2f} {int(r['support']):9d}")
    lines += ["", f"#labeled: {labelled}"] + ([f"#unlabeled: {unlabelled}"] if unlabelled is not None else []) + [f"Acc: {accuracy}"]
    return "\n".join(lines) + "\n"


def write_report(spark, text: str, path: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)
