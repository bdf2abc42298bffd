"""Sparse term tables: counting, indexing, filtering, scaling, relabelling.

The canonical tables are tf(doc_id, word, n), labels(doc_id, ...) and
class_map(y, name); vectors stay sparse until a sink asks for dense rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import ParameterError, UnknownMethodError
from ..functions.scalar import tokens
from ..session import numbered, stored

#: A word is common if it holds more than one in so many occurrences: fewer words than that, whatever the corpus.
COMMON = 1 << 20


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """tf(doc_id, word, n) of lower-cased tokens.

    Texts are dealt by document, as they are far smaller than their tokens, and counted where they are.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("doc_id", text).repartition(parts, "doc_id").select("doc_id", F.explode(tokens(F.col(text))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def vocabulary(tf: DataFrame) -> DataFrame:
    """word, total and word_id (from 1, alphabetical)."""
    return numbered(tf.groupBy("word").agg(F.sum("n").alias("total")), "word_id", F.col("word"))


def last_wins(triples: DataFrame, order: str, keys: tuple[str, str] = ("doc_id", "word_id"), value: str = "n") -> DataFrame:
    """One value per (document, word): that of the last line."""
    return triples.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def class_index(labels: DataFrame, class_map: DataFrame, label: str = "label") -> DataFrame:
    """Adds y, the label's place in the class map; a label outside it stops the job."""
    mapped = labels.join(class_map.select(F.col("name").alias(label), "y"), label, "left")
    return mapped.withColumn("y", F.when(F.col("y").isNull(), F.raise_error(F.concat(F.lit("label not in the class map: "), F.coalesce(F.col(label), F.lit("null"))))).otherwise(F.col("y")))


def dense_label_index(labels: DataFrame, label: str = "label") -> DataFrame:
    """Adds y, the label's place among the sorted distinct labels, from 0."""
    distinct = labels.select(label).distinct()
    return labels.join(numbered(distinct, "y", F.col(label)).withColumn("y", (F.col("y") - 1).cast("int")), label)


def binary_label(label: Column, target) -> Column:
    """The target class is 0, every other class is 1."""
    return F.when(label == F.lit(target), 0).otherwise(1)


def without_stop_words(tf: DataFrame, stop_words: DataFrame) -> DataFrame:
    # A list is a few hundred words; without the hint all terms would be shuffled by word.
    return tf.join(F.broadcast(stop_words.select("word").distinct()), "word", "left_anti").select(*tf.columns)


def without_rare_words(tf: DataFrame, training: DataFrame, least: float = 2) -> DataFrame:
    """Keeps the words whose total over the training rows is at least ``least``.

    Common words are broadcast, so only terms of the others are shuffled by word; ``tf`` is read twice.
    """
    kept = stored(training.groupBy("word").agg(F.sum("n").alias("_total")).where(F.col("_total") >= least))
    whole = kept.agg(F.sum("_total")).first()[0] or 0
    common = kept.where(F.col("_total") * COMMON > F.lit(whole)).select("word", F.lit(True).alias("_common"))
    marked = tf.join(F.broadcast(common), "word", "left")
    other = marked.where("_common is null").join(kept.select("word"), "word", "left_semi")
    return marked.where("_common").unionByName(other).select(*tf.columns)


def ranked_features(tf: DataFrame, ranks: DataFrame, k: int = 0) -> DataFrame:
    """tf over the first k words of a rank list (all if k <= 0); word_id is the rank."""
    chosen = ranks.where(F.col("rank") <= k) if k > 0 else ranks
    return tf.join(chosen.select("word", F.col("rank").alias("word_id")), "word").select("doc_id", "word_id", "n")


def bottom_features(tf: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """tf over the last k words of a rank list; word_id is the place among them, from 1.

    k = -1 stands for all words but the first of the list, k = 0 for the whole list.
    """
    total = ranks.agg(F.max("rank")).scalar()
    before = F.lit(1) if k == -1 else F.greatest(total - F.lit(k), F.lit(0)) if k > 0 else F.lit(0)
    chosen = ranks.withColumn("word_id", F.col("rank") - before).where("word_id > 0").drop("rank")
    return tf.join(chosen, "word").select("doc_id", "word_id", "n")


def nonzero_documents(docs: DataFrame, tf: DataFrame) -> DataFrame:
    return docs.join(tf.where("n <> 0").select("doc_id").distinct(), "doc_id", "left_semi").select(*docs.columns)


def scaled(tf: DataFrame, length: float, kind: str = "l1") -> DataFrame:
    """Counts scaled so that each document's L1 or L2 length is ``length`` (none if <= 0)."""
    if kind not in ("l1", "l2"):
        raise UnknownMethodError(f"no scaling named {kind!r}")
    if length <= 0:
        return tf
    own = W.partitionBy("doc_id")
    whole = F.sum("n").over(own) if kind == "l1" else F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")).over(own))
    return tf.withColumn("n", F.col("n") * F.lit(float(length)) / whole)


def dense_rows(docs: DataFrame, tf: DataFrame, width: int, label: str = "y") -> DataFrame:
    """doc_id, features ARRAY<DOUBLE> (place = word_id from 1) and the label; documents without words are zero."""
    if width < 1:
        raise ParameterError("width must be positive")
    entries = tf.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_id").cast("int"), F.col("n").cast("double")))).alias("_m"))
    place = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return docs.join(entries, "doc_id", "left").select("doc_id", place.alias("features"), label)


def corpus_info(docs: DataFrame, tf: DataFrame, label: str) -> DataFrame:
    """kind, name, n: documents, vocabulary, and the documents of each label."""
    whole = docs.agg(F.count("*").alias("n")).select(F.lit("documents").alias("kind"), F.lit("").alias("name"), "n")
    words = tf.agg(F.count_distinct("word").alias("n")).select(F.lit("vocabulary").alias("kind"), F.lit("").alias("name"), "n")
    by_label = docs.groupBy(F.col(label).alias("name")).agg(F.count("*").alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    return whole.unionByName(words).unionByName(by_label)


def class_ranks(docs: DataFrame, label: str) -> DataFrame:
    """label, n, rank: the classes from the smallest to the largest, ties by name; one row a class."""
    counts = docs.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.orderBy("n", label)).cast("long"))


def first_topic(topics: Column, known: list[str]) -> Column:
    """The first of a document's topics that is known, null if none is."""
    return F.get(F.filter(topics, lambda t: t.isin(*known)), F.lit(0))


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")
