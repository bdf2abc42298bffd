"""Operator 3: quality scores from a factorisation machine.

Features of a text are hashed words (damped counts), statistics of its structure
and its length as metadata; no label, language, source or id is among them.
All pairs of features interact through low-rank factors, scored in linear time
by the identity 2 * sum_{i<j} <v_i, v_j> x_i x_j = |sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2.
Training runs in rounds over a bounded sample of labelled rows: tasks take
gradient steps on their share, and the round's weights are averaged.

Defined results: null and empty texts have only the structure features and get a
score like any other; rows without a ``doc_id`` are scored and count as held out
if crc32 of the empty text does; with no usable labels of both kinds every score
is the share of good labels (0.5 without any); labels of one document must agree
to be used; of several rows of a labelled id one trains, that of the least
features, and all are scored; texts of any length are read whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table

WORD_BUCKETS = 1 << 14
RANK = 4
#: Labelled rows that training uses at most, those of least hash.
SAMPLE_ROWS = 12_000
SHARES, ROUNDS, EPOCHS, RATE, DECAY = 4, 4, 2, 0.1, 1e-5
SEED = 20240229
N_STATS = 20
DIMENSION = WORD_BUCKETS + N_STATS
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGIT = re.compile("[0-9]")
_UPPER = re.compile("[A-ZÀ-ÖØ-Þ]")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word) % WORD_BUCKETS
        return value


_BUCKETS = _Buckets()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): hashed words at unit length together, then the statistics."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    n, size = len(words), len(text)
    if n:
        index, counts = np.unique(np.fromiter(map(_BUCKETS.__getitem__, words), np.int32, n), return_counts=True)
        value = np.log1p(counts)
        value /= np.sqrt((value * value).sum())
    else:
        index, value = np.zeros(0, np.int32), np.zeros(0)
    lines = text.split("\n")
    per = 1.0 / max(1, size)
    distinct = len(set(words)) / max(1, n)
    lengths = np.fromiter(map(len, words), np.int32, n) if n else np.zeros(1, np.int32)
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, n)
    stats = np.array([
        1.0 if n else 0.0, min(1.0, 10 * len(_SYMBOLS.findall(text)) * per), min(1.0, 3 * len(_UPPER.findall(text)) * per), min(1.0, 10 * text.count("!") * per),
        min(1.0, 10 * text.count("|") * per), min(1.0, 10 * len(_DIGIT.findall(text)) * per), min(1.0, 20 * (text.count(".") + text.count(",")) * per), distinct,
        same, lengths.mean() / 10, lengths.std() / 10, min(2.0, lengths.max() / 50),
        np.log1p(size) / 10, np.log1p(n) / 10, np.log1p(len(lines)) / 5, 1 - len(set(lines)) / len(lines),
        min(1.0, len([x for x in lines if not x.strip()]) / len(lines)), min(2.0, n / max(1, len(lines)) / 50), float(text[-1:] in (".", "!", "?")), 1.0 if n < 20 else 0.0,
    ])
    return np.concatenate((index, np.arange(WORD_BUCKETS, DIMENSION, dtype=np.int32))), np.concatenate((value, stats)).astype(np.float32)


class Machine:
    """Weights: bias, linear w, factors v (one row a feature), and AdaGrad's sums."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.bias, self.w = 0.0, np.zeros(DIMENSION)
        self.v = rng.normal(0, 0.02, (DIMENSION, RANK))
        self.gb, self.gw, self.gv = 1.0, np.ones(DIMENSION), np.ones((DIMENSION, RANK))

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.v[index] * value[:, None]
        return float(self.bias + self.w[index] @ value + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))

    def step(self, index: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        v, x = self.v[index], value[:, None]
        summed = (v * x).sum(0)
        margin = float(self.bias + self.w[index] @ value + 0.5 * ((summed * summed).sum() - ((v * x) ** 2).sum()))
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label)
        gw = g * value + DECAY * self.w[index]
        gv = g * (x * summed[None, :] - v * x * x) + DECAY * v
        self.gb += g * g
        self.gw[index] += gw * gw
        self.gv[index] += gv * gv
        self.bias -= RATE * g / np.sqrt(self.gb)
        self.w[index] -= RATE * gw / np.sqrt(self.gw[index])
        self.v[index] -= RATE * gv / np.sqrt(self.gv[index])

    def packed(self) -> bytes:
        return np.concatenate(([self.bias, self.gb], self.w, self.gw, self.v.ravel(), self.gv.ravel())).astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, flat: np.ndarray) -> Machine:
        out, d = cls.__new__(cls), DIMENSION
        out.bias, out.gb = float(flat[0]), float(flat[1])
        out.w, out.gw = flat[2 : 2 + d].copy(), flat[2 + d : 2 + 2 * d].copy()
        rest = flat[2 + 2 * d :].reshape(2, d, RANK)
        out.v, out.gv = rest[0].copy(), rest[1].copy()
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(order, label, index, value): features of the sampled labelled rows."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_other")).where("label = _other")
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    # sample_rows rows at most, whatever the corpus: small enough to send to every task.
    sample = agreed.select("doc_id", "label", order.alias("order")).orderBy("order", "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"order": batch.column(0), "label": batch.column(1).cast(pa.int32()), "index": pa.array([x.tobytes() for x, _ in found], pa.binary()), "value": pa.array([x.tobytes() for _, x in found], pa.binary())})

    found = rows.mapInArrow(run, "order long, label int, index binary, value binary")
    # One row a labelled document, though its id may stand in many rows.
    least = found.groupBy("order").agg(F.min(F.struct("label", "index", "value")).alias("r"))
    return least.select("order", "r.label", "r.index", "r.value")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine | float:
    """The trained machine, or the share of good labels if only one kind is there."""
    rows = saved(training_rows(docs, labels, sample_rows), "op3-training")
    good, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if good in (0, total):
        return good / total if total else 0.5
    weights = (total / (2 * (total - good)), total / (2 * good))
    machine = Machine()
    shares = rows.withColumn("share", F.pmod(F.col("order"), F.lit(SHARES)).cast("int"))
    context = rows.sparkSession.sparkContext
    for number in range(ROUNDS):
        sent = context.broadcast(machine.packed())

        def train(part: pd.DataFrame) -> pd.DataFrame:
            own = Machine.unpacked(np.frombuffer(sent.value, "<f8"))
            part = part.sort_values(["order", "label", "index", "value"])
            data = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y) for i, x, y in zip(part["index"], part["value"], part["label"])]
            rng = np.random.default_rng(SEED + number)
            for _ in range(EPOCHS):
                for k in rng.permutation(len(data)):
                    index, value, label = data[k]
                    own.step(index, value, label, weights[label])
            return pd.DataFrame({"share": part["share"].iloc[:1], "n": [len(part)], "weights": [own.packed()]})

        # SHARES vectors of fixed length come to the driver.
        done = shares.groupBy("share").applyInPandas(train, "share int, n long, weights binary").orderBy("share").collect()
        flat = sum(r["n"] * np.frombuffer(r["weights"], "<f8") for r in done) / sum(r["n"] for r in done)
        machine = Machine.unpacked(flat)
        sent.unpersist()
    return machine


def score(docs: DataFrame, machine: Machine | float) -> DataFrame:
    """doc_id, score and predicted of every row."""
    if isinstance(machine, float):
        return docs.select("doc_id", F.lit(machine).alias("score"), F.lit(int(machine >= 0.5)).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine.__new__(Machine)
        own.bias, own.w, own.v = sent.value
        for batch in slices(batches):
            margins = np.array([own.margin(*features(x)) for x in batch.column(1).to_pylist()], float)
            scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
