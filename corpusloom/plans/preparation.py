"""Preparation drivers: chains of corpus steps, written down as a list, from term counts to exported datasets.

A chain is a list of (step, argument) pairs, applied in order to the term table;
which words stay is decided on the training documents alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnknownMethodError
from ..operators import corpus as C
from ..operators import selection
from ..operators.split import equal_class_split
from ..session import checkpointed, stored
from ..sources import readers, writers


@dataclass
class Prepared:
    """Train and test rows (doc_id, features, y) over ``words`` features, ranked from 1 in ``ranks`` (word, rank)."""

    train: DataFrame
    test: DataFrame
    ranks: DataFrame
    words: int


def _rare(tf: DataFrame, train: DataFrame, least: float) -> DataFrame:
    return C.without_rare_words(tf, tf.join(train.select("doc_id"), "doc_id", "left_semi"), least)


#: Steps that change the term table: (tf, train documents, argument) -> tf.
STEPS = {
    "stop_words": lambda tf, train, words: C.without_stop_words(tf, words),
    "rare_words": _rare,
    "scale_l1": lambda tf, train, length: C.scaled(tf, length, "l1"),
    "scale_l2": lambda tf, train, length: C.scaled(tf, length, "l2"),
}


def prepare(tf: DataFrame, docs: DataFrame, steps: list[tuple[str, object]], features: int) -> Prepared:
    """Runs the chain and keeps the ``features`` words of the highest mutual information with the training classes.

    tf(doc_id, word, n); docs(doc_id, y, part) with part 0 for training, 1 for testing.
    """
    return prepare_sizes(tf, docs, steps, [features])[0]


def prepare_sizes(tf: DataFrame, docs: DataFrame, steps: list[tuple[str, object]], sizes: list[int]) -> list[Prepared]:
    """``prepare`` for several numbers of features: the chain and the information are computed once."""
    train = docs.where("part = 0")
    if unknown := [name for name, _ in steps if name not in STEPS]:
        raise UnknownMethodError(f"no preparation step named {unknown[0]!r}")
    counted, scaling = tf, []
    for name, argument in steps:
        if name.startswith("scale_"):
            scaling.append((name, argument))  # words are chosen by their plain counts
        else:
            counted = STEPS[name](counted, train, argument)
    counted = counted if counted is tf else stored(counted)
    # A rank list of the most words begins with those of fewer; terms of its words alone are read again.
    best = checkpointed(selection.best(selection.mutual_information(counted, train), max(sizes)))
    terms = stored(counted.join(F.broadcast(best.select("word")), "word", "left_semi"))
    return [_prepared(terms, docs, train, scaling, best.where(F.col("rank") <= size)) for size in sizes]


def _prepared(terms: DataFrame, docs: DataFrame, train: DataFrame, scaling: list[tuple[str, object]], ranks: DataFrame) -> Prepared:
    kept = terms.join(F.broadcast(ranks.select("word")), "word", "left_semi")
    for name, argument in scaling:
        kept = STEPS[name](kept, train, argument)
    ranked = checkpointed(C.ranked_features(kept, ranks))
    found = C.nonzero_documents(docs, ranked)
    words = ranks.count()
    rows = C.dense_rows(found.where("part = 0"), ranked, max(1, words)), C.dense_rows(found.where("part = 1"), ranked, max(1, words))
    return Prepared(*rows, ranks, words)


def export(prepared: Prepared, class_map: DataFrame, folder: str) -> None:
    """Writes train, test, class map, rank list and the three counters under ``folder``."""
    writers.write_dense_csv(prepared.train, f"{folder}/train")
    writers.write_dense_csv(prepared.test, f"{folder}/test")
    writers.write_class_map(class_map, f"{folder}/map")
    writers.write_ranks(prepared.ranks, f"{folder}/ranks")
    counts = [("train", prepared.train.count()), ("test", prepared.test.count()), ("words", prepared.words)]
    writers.write_counters(prepared.train.sparkSession, counts, f"{folder}/info")


def load(spark: SparkSession, folder: str) -> readers.Dataset:
    return readers.load_dataset(spark, f"{folder}/map", f"{folder}/train", f"{folder}/test")


def topic_grid(tf: DataFrame, docs: DataFrame, topics: list[str], features: list[int], steps: list[tuple[str, object]], folder: str) -> list[tuple[str, int, Prepared]]:
    """One binary dataset for each topic and number of features, exported under ``folder``; docs(doc_id, label, part)."""
    spark, out = tf.sparkSession, []
    for topic in topics:
        own = checkpointed(docs.select("doc_id", "part", C.binary_label(F.col("label"), topic).cast("int").alias("y")))
        names = spark.createDataFrame([(0, topic), (1, "other")], "y int, name string")
        for number, found in zip(features, prepare_sizes(tf, own, steps, features)):
            export(found, names, f"{folder}/{topic}-{number}")
            out.append((topic, number, found))
    return out


def resplit(docs: DataFrame, tf: DataFrame, per_class: int, folder: str, label: str = "label") -> DataFrame:
    """Splits anew with ``per_class`` test documents a class; writes triples and labels of both parts under their new ids."""
    dealt = checkpointed(equal_class_split(docs, per_class, label))
    for part, name in ((0, "train"), (1, "test")):
        own = dealt.where(F.col("part") == part)
        triples = tf.join(own.select("doc_id", "new_id"), "doc_id").select(F.col("new_id").alias("doc_id"), "word_id", "n")
        writers.write_triples(triples, f"{folder}/{name}.data")
        writers.write_labels(own, f"{folder}/{name}.label", label)
    return dealt
