"""Mutual information between a word's number of occurrences and the class.

``labels`` are (doc_id, y) or, for many runs at once, (run_id, doc_id, y): with
``keys=("run_id",)`` one pass ranks the words of every run by its own documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, numbered


def seen_cells(tf: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word, occurrences, y, docs: documents of each class by how often they hold a word, where there are any."""
    rows = tf.where("n >= 1").join(labels.select(*keys, "doc_id", "y"), "doc_id")
    return rows.groupBy(*keys, "word", F.col("n").cast("long").alias("occurrences"), "y").agg(F.count("*").alias("docs"))


def contingency(tf: DataFrame, labels: DataFrame) -> DataFrame:
    """word, occurrences, y, docs; every word meets every class, though no document of it may hold the word.

    The documents without the word are not in the sparse table: their number is the
    class's size less the others.
    """
    seen = seen_cells(tf, labels)
    # One row: the classes of the class map and their sizes.
    sizes = labels.groupBy("y").agg(F.count("*").alias("size")).agg(F.map_from_entries(F.collect_list(F.struct("y", "size"))).alias("_sizes"))
    held = seen.groupBy("word", "y").agg(F.sum("docs").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("_held"))
    absent = held.withColumn("_sizes", sizes.scalar()).select("word", "_held", F.explode("_sizes").alias("y", "_size"))
    absent = absent.select("word", F.lit(0).cast("long").alias("occurrences"), "y", (F.col("_size") - F.coalesce(F.try_element_at("_held", F.col("y")), F.lit(0))).alias("docs"))
    return seen.unionByName(absent.where("docs > 0"))


def marginals(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p of each class, p of each number of occurrences), over all words."""
    total = table.agg(F.sum("docs")).scalar()
    share = lambda key: table.groupBy(key).agg(F.sum("docs").alias("_n")).select(key, (F.col("_n") / total).alias("p"))
    return share("y"), share("occurrences")


def _n_log_n(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 0, n * F.log2(n)).otherwise(0.0)


def mutual_information(tf: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, word, mi: the word's information about the class in bits, over the number of words.

    With f(n) = n log2 n, a word's information times the number D of documents is the sum
    of f over its cells, less those over its numbers of occurrences and over the
    classes, and f(D).  All are sums over groups, so a word with many cells costs
    no more than as many words with one: cells become one row for each number of
    occurrences, and these one row a word, each summed before its shuffle.
    """
    labels = labels.where("y is not null")
    return information(seen_cells(tf, labels, keys), labels, keys)


def information(seen: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``mutual_information`` of cells as of ``seen_cells``."""
    # A few rows: the classes of the class map and their sizes, by run.  Each class is a column of the sums.
    by_class = labels.groupBy(*keys, "y").agg(F.count("*").alias("size")).collect()
    classes = sorted({r["y"] for r in by_class})
    counts = [F.sum(F.when(F.col("y") == c, F.col("docs")).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(classes)]
    held = [f"_c{i}" for i in range(len(classes))]
    rows = seen.groupBy(*keys, "word", "occurrences").agg(F.sum(_n_log_n(F.col("docs"))).alias("_cells"), F.sum("docs").alias("_docs"), *counts)
    # One row a word; also what the words are counted from.
    words = checkpointed(rows.groupBy(*keys, "word").agg(F.sum(F.col("_cells") - _n_log_n(F.col("_docs"))).alias("_inside"), *[F.sum(x).alias(x) for x in held]))
    named = [f"_s{i}" for i in range(len(classes))]
    if keys:
        found: dict = {}
        for r in by_class:
            found.setdefault(tuple(r[k] for k in keys), dict.fromkeys(classes, 0))[r["y"]] = r["size"]
        schema = T.StructType([*[labels.schema[k] for k in keys], *[T.StructField(x, T.LongType()) for x in named]])
        both = words.join(F.broadcast(labels.sparkSession.createDataFrame([(*k, *v.values()) for k, v in found.items()], schema)), list(keys))
    else:
        both = words.withColumns({x: F.lit(next(r["size"] for r in by_class if r["y"] == c)).cast("long") for x, c in zip(named, classes)})
    none, every = F.lit(0), F.lit(0)
    total, absent = F.lit(0.0), F.lit(0.0)
    for i in range(len(classes)):
        rest = F.col(f"_s{i}") - F.col(f"_c{i}")
        none, every = none + rest, every + F.col(f"_s{i}")
        absent, total = absent + _n_log_n(rest), total + _n_log_n(F.col(f"_s{i}"))
    bits = (F.col("_inside") + absent - _n_log_n(none) - total + _n_log_n(every)) / every
    found = both.select(*keys, "word", F.greatest(bits, F.lit(0.0)).alias("_mi"))
    if keys:
        found = found.join(F.broadcast(words.groupBy(*keys).agg(F.count("*").alias("_words"))), list(keys))
    else:
        found = found.withColumn("_words", F.lit(words.count()))
    return found.select(*keys, "word", (F.col("_mi") / F.greatest("_words", F.lit(1))).alias("mi"))


def best(mi: DataFrame, k: int, digits: int = 12, keys: tuple[str, ...] = ()) -> DataFrame:
    """word and rank of the k words of the highest information: k rows (for each run); ties as in ``ranked``."""
    order = [F.desc("_mi"), F.desc("word")]
    rows = mi.select(*keys, "word", F.round("mi", digits).alias("_mi"))
    # Without runs, the limit keeps k rows a task before one task ranks k rows; with runs, the rank's bound does so for each run.
    top = rows if keys else rows.orderBy(*order).limit(k)
    ranks = top.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranks.where(F.col("rank") <= k).select(*keys, "word", "rank")


def ranked(mi: DataFrame, ascending: bool = False, digits: int = 12) -> DataFrame:
    """Adds rank, from 1; equal values (to ``digits``) go by word, downwards in the descending rank."""
    value = F.round("mi", digits)
    order = (F.asc("_mi"), F.asc("word")) if ascending else (F.desc("_mi"), F.desc("word"))
    return numbered(mi.withColumn("_mi", value), "rank", *order).drop("_mi")
