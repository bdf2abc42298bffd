"""A synthetic corpus: documents drawn from one multinomial a class, the same on every run and engine."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ParameterError
from ..functions.scalar import portable_hash

#: Hash seeds of class draws, word draws and parts.
CLASS_SEED, WORD_SEED = 11, 12


def _drawn(share: Column, weights: list[float]) -> Column:
    """The first place (from 0) whose summed weight exceeds the share."""
    bounds = list(accumulate(weights))
    return F.least(F.aggregate(F.array(*[F.lit(float(x)) for x in bounds]), F.lit(0), lambda s, b: s + (share >= b * bounds[-1] ** -1).cast("int")), F.lit(len(weights) - 1))


def synthetic_corpus(ids: DataFrame, length: int, prior: list[float], words: list[list[float]]) -> tuple[DataFrame, DataFrame]:
    """(docs(doc_id, y), tf(doc_id, word_id, n)) for the ids (doc_id): class by ``prior``, ``length`` words each by the class's row of ``words``."""
    if len(prior) != len(words) or min(map(len, words)) != max(map(len, words)):
        raise ParameterError("one row of word weights, of one width, is needed for each class")
    share = lambda key, seed: portable_hash(key, seed) / F.lit(4294967296.0)
    docs = ids.select("doc_id").withColumn("y", _drawn(share(F.col("doc_id"), CLASS_SEED), prior))
    draws = docs.select("doc_id", "y", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("_i"))
    at = share(F.concat_ws("-", "doc_id", "_i"), WORD_SEED)
    word = F.coalesce(*[F.when(F.col("y") == y, _drawn(at, row)) for y, row in enumerate(words)]) + 1
    return docs, draws.select("doc_id", word.alias("word_id")).groupBy("doc_id", "word_id").agg(F.count("*").alias("n"))
