"""Evaluation of predictions: confusion, accuracy, class figures, reports, averages.

Input: one row per document with run_id, y (truth) and predicted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownMethodError


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "y", "predicted").agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy"))


def class_figures(rows: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """precision, recall, f1 and support of each class that is true or predicted; 0 where undefined."""
    return confusion_figures(confusion(rows, *keys), *keys, digits=digits)


def confusion_figures(table: DataFrame, *keys: str, digits: int = 4) -> DataFrame:
    """``class_figures`` of the rows that a confusion table counts."""
    hits = table.where("y = predicted").select(*keys, "y", F.col("n").alias("hit"))
    truth = table.groupBy(*keys, "y").agg(F.sum("n").alias("support"))
    guess = table.groupBy(*keys, F.col("predicted").alias("y")).agg(F.sum("n").alias("guessed"))
    on = [*keys, "y"]
    joined = truth.join(guess, on, "full").join(hits, on, "left").na.fill(0, ["support", "guessed", "hit"])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = joined.withColumn("precision", zero(F.col("hit"), F.col("guessed"))).withColumn("recall", zero(F.col("hit"), F.col("support")))
    out = out.withColumn("f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select(*on, *[F.round(x, digits).alias(x) for x in ("precision", "recall", "f1")], "support")


def f1_score(rows: DataFrame, average: str, *keys: str) -> DataFrame:
    """f1 of class 1 ('binary') or the plain mean over classes ('macro')."""
    figures = class_figures(rows, *keys, digits=15)
    if average == "binary":
        return figures.where("y = 1").select(*keys, "f1")
    if average == "macro":
        return figures.groupBy(*keys).agg(F.avg("f1").alias("f1"))
    raise UnknownMethodError(f"no average named {average!r}")


def report(rows: DataFrame, *keys: str) -> DataFrame:
    """Class figures and the line 'avg / total', weighted by support; name is the class or that."""
    figures = class_figures(rows, *keys, digits=15)
    weighted = [(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in ("precision", "recall", "f1")]
    total = figures.groupBy(*keys).agg(*weighted, F.sum("support").alias("support")).withColumn("name", F.lit("avg / total"))
    lines = figures.withColumn("name", F.col("y").cast("string")).drop("y").unionByName(total)
    return lines.select(*keys, "name", *[F.round(x, 4).alias(x) for x in ("precision", "recall", "f1")], "support")


def fold_average(figures: DataFrame, *keys: str) -> DataFrame:
    """The means over runs of class figures."""
    return figures.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in ("precision", "recall", "f1", "support")])
