"""Multinomial mixtures: naive Bayes, its EM extension, several components a class.

All four models are one engine over long tables, and many runs (folds, component
counts, models) go through one job, told apart by ``run_id``:

* tf(doc_id, word_id, n), shared by all runs; or n is an array with a count for
  each run, where runs count other words or scale them otherwise (0: not there);
* docs(run_id, doc_id, y): y is the observed class, null if unlabelled;
* parts(run_id, k, y): the components of each class;
* resp(run_id, doc_id, k, w): responsibilities.

Parameters stay sparse and are packed one row a word, with a number for each slot (a
component of a run): add-one smoothing gives a word that a component has not seen
1 / (N_k + V), so only ln(N_kw + 1) of words that some slot has seen is kept, and
score = ln prior_k - L_d ln(N_k + V) + sum n ln(N_kw + 1).  The multinomial
coefficient is the same for all components and is left out.

Terms are packed once (``packed_terms``): the most frequent words get numbers, and a
document becomes one row of word numbers and counts.  Parameters of these words, at
most ``NUMBERS`` for all slots together, are broadcast as one array; a pass over the
documents multiplies by it in numpy, and only sums are shuffled: those of words as
stretches of ``CHUNK`` numbers, a row for each that a task has met.  Terms of all other
words stay rows and meet their parameters on the word.  Where no such words are left, a
loop of EM is one job, a pass over the documents.  Runs know nothing of each other, so
that callers with many take them in groups whose words are all numbered (``run_groups``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParameterError
from ..functions.scalar import simplex
from ..operators import terms as packing
from ..operators.corpus import scaled
from ..session import Rounds, checkpointed, numbered, stored

#: Loops after which a fit that still moves is not converged.
LOOPS = 1000
#: Parameters of numbered words that are broadcast at most, all slots together: 256 MB.
NUMBERS = 1 << 25
#: Numbers whose sums go through a shuffle together.
CHUNK = 1 << 14
#: Documents whose terms are unpacked together: small enough to stay near the processor.
SLICE = 1024
#: Words whose numbers are broadcast when terms are packed; the other words are joined.
HOT = 1 << 17
#: An objective's terms are summed as decimals, so that the sum is exact in any order and at any size.
EXACT = "decimal(28,10)"

Slot = tuple[int, int, int]


class Theta:
    """slots: (run_id, k, y); base(run_id, k, y, log_prior, log_total); packed(word_id, logs): ln(count + 1) by slot.

    Where all words are numbered, ``logs`` holds the same numbers by slot and number of
    ``terms``, and ``packed`` is made from them when it is asked for; so is ``base`` from ``rows``.
    """

    def __init__(self, slots: list[Slot], base: DataFrame | None, packed: DataFrame | None = None, logs: np.ndarray | None = None, terms: Terms | None = None, rows: list[Row] | None = None):
        self.slots, self.logs, self.terms = slots, logs, terms
        self._base, self._packed, self._rows = base, packed, rows

    @property
    def base(self) -> DataFrame:
        if self._base is None:
            self._base = self.terms.docs.sparkSession.createDataFrame(self._rows, _BASE)
        return self._base

    @property
    def rows(self) -> list[Row]:
        """The rows of ``base``: one a run and component."""
        if self._rows is None:
            self._rows = self._base.collect()
        return self._rows

    @property
    def packed(self) -> DataFrame:
        if self._packed is None:
            self._packed = _word_logs(_held(self.terms.docs.sparkSession, self.logs), self.terms, len(self.slots))
        return self._packed

    @property
    def seen(self) -> DataFrame:
        """run_id, k, word_id, log_count of the words that each slot has seen."""
        names = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(k).alias("k")) for r, k, _ in self.slots])
        rows = self.packed.select("word_id", F.posexplode("logs").alias("_i", "log_count")).where("log_count > 0")
        return rows.select(names[F.col("_i")]["run_id"].alias("run_id"), names[F.col("_i")]["k"].alias("k"), "word_id", "log_count")

    def only(self, runs: list[int]) -> Theta:
        at = [i for i, x in enumerate(self.slots) if x[0] in runs]
        slots = [self.slots[i] for i in at]
        if self.logs is not None:
            return Theta(slots, None, None, self.logs[at], self.terms, [r for r in self.rows if r["run_id"] in runs])
        return Theta(slots, self.base.where(F.col("run_id").isin(runs)), self.packed.select("word_id", F.array(*[F.col("logs")[i] for i in at]).alias("logs")))


def joined(thetas: list[Theta]) -> Theta:
    """One Theta of those of different runs."""
    if len(thetas) == 1:
        return thetas[0]
    if all(x.logs is not None and x.terms is thetas[0].terms for x in thetas):
        return Theta([s for x in thetas for s in x.slots], None, None, np.vstack([x.logs for x in thetas]), thetas[0].terms, [r for x in thetas for r in x.rows])
    width, at, rows = sum(len(x.slots) for x in thetas), 0, None
    for x in thetas:
        pad = lambda n: F.array_repeat(F.lit(0.0), n)
        own = x.packed.select("word_id", F.concat(pad(at), "logs", pad(width - at - len(x.slots))).alias("logs"))
        rows, at = own if rows is None else rows.unionByName(own), at + len(x.slots)
    packed = checkpointed(rows.groupBy("word_id").agg(F.array(*[F.sum(F.col("logs")[i]) for i in range(width)]).alias("logs")))
    base = thetas[0].base
    for x in thetas[1:]:
        base = base.unionByName(x.base)
    return Theta([s for x in thetas for s in x.slots], base, packed)


def single_parts(docs: DataFrame, classes: int) -> DataFrame:
    """One component a class, k = y, for every run."""
    return docs.select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("k")).withColumn("y", F.col("k"))


def several_parts(docs: DataFrame, counts: list[int]) -> DataFrame:
    """counts[y] components for class y, numbered through the classes."""
    if not counts or min(counts) < 1:
        raise ParameterError("every class needs a component")
    owners = [y for y, m in enumerate(counts) for _ in range(m)]
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(y).alias("y")) for k, y in enumerate(owners)])
    return docs.select("run_id").distinct().select("run_id", F.inline(parts))


def hard_start(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Labelled documents belong wholly to the one component of their class."""
    return docs.where("y is not null").join(parts, ["run_id", "y"]).select("run_id", "doc_id", "k", F.lit(1.0).alias("w"))


def random_start(docs: DataFrame, counts: list[int], seed: int = 0) -> DataFrame:
    """Labelled documents are shared among their class's components by random simplex shares."""
    before = [sum(counts[:y]) for y in range(len(counts))]
    shares = F.coalesce(*[F.when(F.col("y") == y, simplex(F.col("doc_id"), m, seed)) for y, m in enumerate(counts)])
    first = F.element_at(F.array(*[F.lit(x) for x in before]), F.col("y") + 1)
    return docs.where("y is not null").select("run_id", "doc_id", first.alias("_first"), F.posexplode(shares).alias("_i", "w")).select("run_id", "doc_id", (F.col("_first") + F.col("_i")).alias("k"), "w")


def assigned_start(docs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Labelled documents belong wholly to the component that ``assignment`` (run_id, doc_id, k) names."""
    return docs.where("y is not null").join(assignment, ["run_id", "doc_id"]).select("run_id", "doc_id", "k", F.lit(1.0).alias("w"))


def slots_of(parts: DataFrame | list[Slot]) -> list[Slot]:
    """One a run and component, whatever the corpus."""
    return sorted(parts if isinstance(parts, list) else ((r["run_id"], r["k"], r["y"]) for r in parts.select("run_id", "k", "y").collect()))


def _n(tf: DataFrame, run: int) -> Column:
    """A term's count in a run."""
    n = F.col("n")
    return n[run] if isinstance(tf.schema["n"].dataType, T.ArrayType) else n


@dataclass
class Terms:
    """docs(doc_id, ids, ns): numbers and counts of a document's numbered words, as bytes; words(word_id, _id, _df); rest: terms of the other words, None if there are none.

    ``size`` words are numbered from 0, by documents, most first; a count is one number or, with ``width``, one a run; ``form`` is its type.
    """

    docs: DataFrame
    words: DataFrame
    size: int
    rest: DataFrame | None
    width: int
    form: str


def frequent_words(tf: DataFrame, slots: int = 1) -> list:
    """The words that are numbered: all, if they are few."""
    return [r["word_id"] for r in packed_terms(tf, slots).words.select("word_id").collect()]


def _packer(form: str):
    def pack(batches):
        """Rows of a document follow each other; one row a document comes out."""
        held: list = []

        def row(parts):
            return parts[0][0], b"".join(p[1] for p in parts), b"".join(p[2] for p in parts)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("doc_id").to_pandas().to_numpy()
            ids = batch.column("_id").to_numpy(zero_copy_only=False).astype("<i4")
            ns = batch.column("n")
            ns = ns.flatten() if pa.types.is_list(ns.type) else ns
            ns = ns.to_numpy(zero_copy_only=False).astype(form).reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0][0] != keys[a]:
                    out.append(row(held))
                    held = []
                held.append((keys[a], ids[a:b].tobytes(), ns[a:b].tobytes()))
            if out:
                yield _rows(out)
        if held:
            yield _rows([row(held)])

    def _rows(out):
        return pa.RecordBatch.from_pydict({"doc_id": [x[0] for x in out], "ids": pa.array([x[1] for x in out], pa.binary()), "ns": pa.array([x[2] for x in out], pa.binary())})

    return pack


def _numbered_words(tf: DataFrame) -> tuple[DataFrame, int]:
    known = tf.__dict__.setdefault("_packed", {})
    if "words" not in known:
        counts = tf.groupBy("word_id").agg(F.count("*").alias("_df"))
        words = stored(numbered(counts, "_id", F.desc("_df"), F.asc("word_id")).select("word_id", (F.col("_id") - 1).cast("int").alias("_id"), "_df"))
        known["words"] = words, words.count()
    return known["words"]


def packed_corpus(packed: DataFrame, words: DataFrame, form: str = packing.COUNTS, width: int = 0) -> DataFrame:
    """tf of documents that ``terms.packed_words`` has packed: models read these, and no term is a row unless the table itself is read."""
    tf = packing.term_rows(packed, words, 0, form, width)
    tf.__dict__["_packed"] = {"words": (words, words.count()), "docs": packed, "form": form, "width": width}
    return tf


def packed_docs(tf: DataFrame) -> DataFrame | None:
    """The packed documents that ``tf`` was made of, if there are any and they hold plain counts."""
    known = tf.__dict__.get("_packed", {})
    return known.get("docs") if known.get("form", packing.COUNTS) == packing.COUNTS else None


def scaled_corpus(tf: DataFrame, length: float, kind: str) -> DataFrame:
    """``corpus.scaled``, of packed documents in packed form."""
    docs = packed_docs(tf)
    if docs is None or length <= 0 or kind not in ("l1", "l2"):
        return scaled(tf, length, kind)
    return packed_corpus(stored(packing.scaled(docs, length, kind)), numbered_words(tf), packing.SCALED)


def written(tf: DataFrame) -> DataFrame:
    """``tf`` with its rows written once, for those who read the table itself; it stays packed."""
    rows = stored(tf)
    rows.__dict__["_packed"] = tf.__dict__.get("_packed", {})
    return rows


def numbered_words(tf: DataFrame) -> DataFrame:
    """word_id, _id and _df: the different words, numbered from 0 by documents, most first."""
    return _numbered_words(tf)[0]


def word_count(tf: DataFrame) -> int:
    """The number of different words."""
    return _numbered_words(tf)[1]


def packed_terms(tf: DataFrame, slots: int) -> Terms:
    """The terms packed for so many slots; found once a table and number of words."""
    known = tf.__dict__.setdefault("_packed", {})
    most = max(1, NUMBERS // max(1, slots))
    words, total = _numbered_words(tf)
    size = min(total, most)
    if size in known:
        return known[size]
    if "docs" in known:
        docs, rest, form, width = known["docs"], None, known["form"], known["width"]
        if size < total:
            rest = stored(packing.term_rows(docs, words.where(F.col("_id") >= size), size, form, width))
            docs = stored(packing.below(docs, size, form))
        known[size] = Terms(docs, words.where(F.col("_id") < size), size, rest, width, form)
        return known[size]
    kind = tf.schema["n"].dataType
    many = isinstance(kind, T.ArrayType)
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # Numbers of the first words go to the terms, terms of the others to theirs.
    marked = tf.where("doc_id is not null").join(F.broadcast(words.where(F.col("_id") < min(HOT, size)).select("word_id", "_id")), "word_id", "left")
    numbers = marked.where("_id is not null").select("doc_id", "_id", "n")
    other = marked.where("_id is null").select("doc_id", "word_id", "n")
    if size > HOT:
        numbers = numbers.unionByName(other.join(words.where((F.col("_id") >= HOT) & (F.col("_id") < size)).select("word_id", "_id"), "word_id").select("doc_id", "_id", "n"))
    form = "<i8" if whole else "<f8"
    n = F.col("n").cast("long" if whole else "array<double>" if many else "double")
    parts = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbers.select("doc_id", "_id", n.alias("n")).repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    schema = T.StructType([tf.schema["doc_id"], T.StructField("ids", T.BinaryType()), T.StructField("ns", T.BinaryType())])
    docs = stored(rows.mapInArrow(_packer(form), schema))
    rest = stored(other.join(words.where(F.col("_id") >= size).select("word_id"), "word_id", "left_semi")) if size < total else None
    width = tf.select(F.max(F.size("n"))).first()[0] or 1 if many else 0
    known[size] = Terms(docs, words.where(F.col("_id") < size), size, rest, width, form)
    return known[size]


def run_groups(slots: list[Slot], words: int) -> list[list[int]]:
    """Runs in groups of which all words are numbered; a run whose own are not is a group by itself."""
    groups, room = [], 0
    for r in sorted({x[0] for x in slots}):
        need = sum(x[0] == r for x in slots) * max(1, words)
        if not groups or need > room:
            groups.append([])
            room = NUMBERS
        groups[-1].append(r)
        room -= need
    return groups


def _sliced(batches, rows: int):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _joined_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of a column of bytes one after the other, where each row ends); null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"")
    width = "<i8" if pa.types.is_large_binary(column.type) else "<i4"
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[1:].astype(np.int64) - int(ends[0])


def _unpacked(batch, terms_form: str, width: int):
    """(numbers, place of each term's document in the batch, counts by run) of a batch of documents."""
    ids, ends = _joined_bytes(batch.column("ids"))
    ns, _ = _joined_bytes(batch.column("ns"))
    at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0) // 4)
    n = np.frombuffer(ns.tobytes(), terms_form).reshape(-1, max(1, width)).T.astype(float)
    return np.frombuffer(ids.tobytes(), "<i4"), at, n


def _matrix(theta: Theta, terms: Terms) -> np.ndarray:
    """ln(count + 1) of the numbered words by slot: at most ``NUMBERS`` numbers."""
    if theta.logs is not None and theta.terms is terms:
        return theta.logs
    out = np.zeros((len(theta.slots), terms.size))
    found = theta.packed.join(terms.words.select("word_id", "_id"), "word_id").select("_id", *[F.col("logs")[i].alias(f"c{i}") for i in range(len(theta.slots))]).toArrow()
    at = found.column("_id").to_numpy()
    for i in range(len(out)):
        out[i, at] = found.column(f"c{i}").to_numpy()
    return out


_CHUNKS = "part int, chunk int, ids binary, cells binary"


def _chunk(part: int, chunk: int, cells: np.ndarray, ids: np.ndarray | None = None) -> pa.RecordBatch:
    own = pa.array([None if ids is None else ids.astype("<i4").tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "ids": own, "cells": pa.array([cells.tobytes()], pa.binary())})


def _pieces(part: int, total: np.ndarray, width: int):
    """Sums by slot and number as rows: a stretch of numbers, and which of them (null: all) the sums are of."""
    for c, a in enumerate(range(0, total.shape[1], width)):
        cut = total[:, a : a + width]
        seen = np.flatnonzero(cut.any(0))
        if 2 * len(seen) > cut.shape[1]:
            yield _chunk(part, c, cut)
        elif len(seen):
            yield _chunk(part, c, cut[:, seen], seen)


def _added(pieces: DataFrame, slots: int, size: int) -> DataFrame:
    """One row a stretch: the sums of all tasks, added in their order.  Stretch -1 holds other sums."""

    def add(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        total = None
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        for i in order.tolist():
            cells = np.frombuffer(table.column("cells")[i].as_py(), float).reshape(slots, -1)
            ids = table.column("ids")[i].as_py()
            if total is None:
                total = np.zeros((slots, cells.shape[1] if chunk < 0 else min(CHUNK, size - chunk * CHUNK)))
            if ids is None:
                total += cells
            else:
                total[:, np.frombuffer(ids, "<i4")] += cells
        return pa.Table.from_batches([_chunk(0, chunk, total)])

    return pieces.groupBy("chunk").applyInArrow(add, _CHUNKS)


def _collected(added: DataFrame, slots: int, size: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(sums by slot and number, the other sums by slot)."""
    counts, other = np.zeros((slots, size)), None
    rows = added.select("chunk", "cells").toArrow()
    for chunk, cells in zip(rows.column("chunk").to_pylist(), rows.column("cells")):
        own = np.frombuffer(cells.as_buffer(), float).reshape(slots, -1)
        if chunk < 0:
            other = own.copy()
        else:
            counts[:, chunk * CHUNK : chunk * CHUNK + own.shape[1]] = own
    return counts, other


def _held(spark, values: np.ndarray) -> DataFrame:
    """Rows as of ``_added`` from numbers that the driver holds."""
    batches = list(_pieces(0, values, CHUNK)) or [_chunk(0, 0, values[:, :0], np.empty(0))]
    return spark.createDataFrame(pa.Table.from_batches(batches), _CHUNKS)


def _word_logs(chunks: DataFrame, terms: Terms, slots: int) -> DataFrame:
    """word_id and logs of rows as of ``_held``, for words that some slot has seen."""

    def rows(batches):
        for batch in batches:
            for chunk, ids, cells in zip(*(batch.column(x).to_pylist() for x in ("chunk", "ids", "cells"))):
                own = np.frombuffer(cells, float).reshape(slots, -1)
                numbers = np.arange(own.shape[1]) if ids is None else np.frombuffer(ids, "<i4")
                some = np.flatnonzero(own.any(0))
                logs = pa.FixedSizeListArray.from_arrays(pa.array(own[:, some].T.ravel()), slots).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({"_id": pa.array((numbers[some] + chunk * CHUNK).astype(np.int32)), "logs": logs})

    return chunks.mapInArrow(rows, "_id int, logs array<double>").join(terms.words, "_id").select("word_id", "logs")


_BASE = "run_id int, k int, y int, log_prior double, log_total double"


def maximise(resp: DataFrame, tf: DataFrame, parts: DataFrame | list[Slot], words: int, save=None, sizes: dict | None = None) -> Theta:
    """M-step with add-one smoothing; components without documents keep the smoothing mass.

    ``save(df)`` keeps the word parameters, which scores read more than once; ``sizes`` are the
    summed weights by (run_id, k), where they are known.
    """
    slots = slots_of(parts)
    save = save or checkpointed
    weights = [F.sum(F.when((F.col("run_id") == r) & (F.col("k") == k), F.col("w")).otherwise(0.0)) for r, k, _ in slots]
    packed = resp.groupBy("doc_id").agg(F.array(*weights).alias("ws"))
    terms = packed_terms(tf, len(slots))
    form, width, size, runs = terms.form, terms.width, terms.size, [r for r, _, _ in slots]

    def counted(batches):
        total, part = np.zeros((len(runs), size)), TaskContext.get().partitionId()
        for batch in _sliced(batches, SLICE):
            words, at, n = _unpacked(batch, form, width)
            w = batch.column("ws").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(runs))
            for i, r in enumerate(runs):
                if w[:, i].any():
                    np.add.at(total[i], words, n[r if width else 0] * w[at, i])
        yield from _pieces(part, total, CHUNK)

    if sizes is None:
        sizes = {(x["run_id"], x["k"]): x["size"] for x in resp.groupBy("run_id", "k").agg(F.sum("w").alias("size")).collect()}
    counts, _ = _collected(_added(terms.docs.join(packed, "doc_id").mapInArrow(counted, _CHUNKS), len(slots), size), len(slots), size)
    if terms.rest is None:
        return Theta(slots, None, None, np.log1p(counts), terms, _base(slots, sizes, counts.sum(1).tolist(), words))
    rest = [F.sum(F.col("ws")[i] * _n(tf, r)) for i, (r, _, _) in enumerate(slots)]
    light = packed.join(terms.rest, "doc_id").groupBy("word_id").agg(F.array(*rest).alias("cs"))
    rows = _word_logs(_held(resp.sparkSession, counts), terms, len(slots)).select("word_id", F.col("logs").alias("cs")).unionByName(light)
    logs = save(rows.select("word_id", F.transform("cs", F.log1p).alias("logs"), "cs"))
    total = logs.agg(*[F.coalesce(F.sum(F.col("cs")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(slots))]).first()
    return Theta(slots, resp.sparkSession.createDataFrame(_base(slots, sizes, total, words), _BASE), logs.select("word_id", "logs"))


def _base(slots: list[Slot], sizes: dict, total, words: int) -> list[Row]:
    """log_prior and log_total of each slot from summed weights by (run_id, k) and summed counts by slot."""
    rows = []
    for i, (r, k, y) in enumerate(slots):
        own = [sizes.get((x[0], x[1]), 0.0) for x in slots if x[0] == r]
        prior = math.log((sizes.get((r, k), 0.0) + 1) / (sum(own) + len(own)))
        rows.append(Row(run_id=r, k=k, y=y, log_prior=prior, log_total=math.log(total[i] + words)))
    return rows


def _sums(tf: DataFrame, theta: Theta) -> DataFrame:
    """doc_id, s: sum of n ln(N_kw + 1) by slot, and l: the document's length by run."""
    runs, slots = sorted({r for r, _, _ in theta.slots}), [r for r, _, _ in theta.slots]
    terms = packed_terms(tf, len(slots))
    form, width = terms.form, terms.width
    logs = tf.sparkSession.sparkContext.broadcast(_matrix(theta, terms))

    def summed(batches):
        for batch in _sliced(batches, SLICE):
            words, at, n = _unpacked(batch, form, width)
            own = [np.bincount(at, n[r if width else 0] * logs.value[i][words], batch.num_rows) for i, r in enumerate(slots)]
            length = [np.bincount(at, n[r if width else 0], batch.num_rows) for r in runs]
            lists = {name: pa.FixedSizeListArray.from_arrays(pa.array(np.stack(x, 1).ravel()), len(x)).cast(pa.list_(pa.float64())) for name, x in (("s", own), ("l", length))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **lists})

    schema = T.StructType([terms.docs.schema["doc_id"], *[T.StructField(x, T.ArrayType(T.DoubleType())) for x in "sl"]])
    found = terms.docs.mapInArrow(summed, schema)
    if terms.rest is None:
        return found
    lengths = F.array(*[F.sum(_n(tf, r)).cast("double") for r in runs]).alias("l")
    sums = [F.coalesce(F.sum(_n(tf, r) * F.col("logs")[i]), F.lit(0.0)) for i, r in enumerate(slots)]
    light = terms.rest.join(theta.packed, "word_id", "left").groupBy("doc_id").agg(F.array(*sums).alias("s"), lengths)
    both = [F.array(*[F.sum(F.col(x)[i]) for i in range(m)]).alias(x) for x, m in (("s", len(slots)), ("l", len(runs)))]
    return found.unionByName(light).groupBy("doc_id").agg(*both)


def scores(docs: DataFrame, tf: DataFrame, theta: Theta) -> DataFrame:
    """run_id, doc_id, observed y, k, class of k, score; from the document spine, so empty documents score the prior."""
    runs = sorted({r for r, _, _ in theta.slots})
    places = [(r, k, i, runs.index(r)) for i, (r, k, _) in enumerate(theta.slots)]
    at = docs.sparkSession.createDataFrame(places, "run_id int, k int, _slot int, _run int")
    # One row a run and component, whatever the corpus.
    base = theta.base.withColumnRenamed("y", "owner").join(F.broadcast(at), ["run_id", "k"])
    spine = docs.select("run_id", "doc_id", "y").join(_sums(tf, theta), "doc_id", "left").join(F.broadcast(base), "run_id")
    length, seen = F.coalesce(F.get("l", F.col("_run")), F.lit(0.0)), F.coalesce(F.get("s", F.col("_slot")), F.lit(0.0))
    return spine.select("run_id", "doc_id", "y", "k", "owner", (F.col("log_prior") - length * F.col("log_total") + seen).alias("score"))


def responsibilities(scored: DataFrame) -> DataFrame:
    """E-step: softmax over all components, for labelled documents over those of their class."""
    allowed = scored.where(F.col("y").isNull() | (F.col("y") == F.col("owner")))
    own = W.partitionBy("run_id", "doc_id")
    mass = F.exp(F.col("score") - F.max("score").over(own))
    weighted = allowed.withColumn("_m", mass)
    return weighted.withColumn("w", F.col("_m") / F.sum("_m").over(own)).drop("_m")


def objective(resp: DataFrame) -> DataFrame:
    """run_id, q: expected complete log-likelihood, from the same scores as the responsibilities, an exact decimal sum."""
    return resp.groupBy("run_id").agg(F.sum((F.col("w") * F.col("score")).cast(EXACT)).alias("q"))


def class_scores(scored: DataFrame) -> DataFrame:
    """run_id, doc_id, owner, score: log of the summed mass of a class's components."""
    best = F.max("score").over(W.partitionBy("run_id", "doc_id", "owner"))
    return scored.withColumn("_b", best).groupBy("run_id", "doc_id", "owner").agg((F.max("_b") + F.log(F.sum(F.exp(F.col("score") - F.col("_b"))))).alias("score"))


def predict(docs: DataFrame, tf: DataFrame, theta: Theta) -> DataFrame:
    """run_id, doc_id, predicted: the class of the highest score, the lowest among equals."""
    terms = packed_terms(tf, len(theta.slots))
    if terms.rest is None:
        return _predicted(docs, terms, theta, _matrix(theta, terms))
    found = class_scores(scores(docs.withColumn("y", F.lit(None).cast("int")), tf, theta))
    return found.groupBy("run_id", "doc_id").agg(F.max_by("owner", F.struct("score", -F.col("owner"))).alias("predicted"))


def _predicted(docs: DataFrame, terms: Terms, theta: Theta, logs: np.ndarray) -> DataFrame:
    """``predict`` in one pass over the packed documents: a row a document with its class in each run."""
    base = {(r["run_id"], r["k"]): (r["log_prior"], r["log_total"]) for r in theta.rows}
    slots, form, width = theta.slots, terms.form, terms.width
    runs = sorted({r for r, _, _ in slots})
    own = {r: [(i, owner, *base[r, k]) for i, (run, k, owner) in enumerate(slots) if run == r] for r in runs}
    sent = docs.sparkSession.sparkContext.broadcast(logs)

    def classes(words, at, n, rows):
        out = np.empty((rows, len(runs)), np.int32)
        for j, r in enumerate(runs):
            count = n[r if width else 0]
            length, by_class = np.bincount(at, count, rows), {}
            for i, owner, prior, total in own[r]:
                by_class.setdefault(owner, []).append(prior - length * total + np.bincount(at, count * sent.value[i][words], rows))
            found = []
            for owner in sorted(by_class):
                scores = np.stack(by_class[owner])
                best = scores.max(0)
                found.append(best + np.log(np.exp(scores - best).sum(0)))
            out[:, j] = np.array(sorted(by_class))[np.stack(found).argmax(0)]
        return out

    def predicted(batches):
        for batch in _sliced(batches, SLICE):
            out = classes(*_unpacked(batch, form, width), batch.num_rows)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), len(runs)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_p": lists})

    found = terms.docs.mapInArrow(predicted, T.StructType([terms.docs.schema["doc_id"], T.StructField("_p", T.ArrayType(T.IntegerType()))]))
    # Documents without words score the prior.
    none = _of_nothing(theta)
    at = F.create_map(*[x for j, r in enumerate(runs) for x in (F.lit(r), F.lit(j))])
    bare = F.create_map(*[x for r in runs for x in (F.lit(r), F.lit(none[r]))])
    spine = docs.where(F.col("run_id").isin(runs)).groupBy("run_id", "doc_id").agg(F.lit(0).alias("_")).drop("_")
    return spine.join(found, "doc_id", "left").select("run_id", "doc_id", F.coalesce(F.get("_p", at[F.col("run_id")]), bare[F.col("run_id")]).alias("predicted"))


def _of_nothing(theta: Theta) -> dict[int, int]:
    """The class of a document without words in each run."""
    out: dict = {}
    for r in {x[0] for x in theta.slots}:
        mass: dict = {}
        for x in theta.rows:
            if x["run_id"] == r:
                mass.setdefault(x["y"], []).append(x["log_prior"])
        scores = {y: max(own) + math.log(sum(math.exp(v - max(own)) for v in own)) for y, own in mass.items()}
        out[r] = min(y for y in scores if scores[y] == max(scores.values()))
    return out


@dataclass
class Fit:
    """loops: of the run that took most; of_run: of each run; ``shares`` makes ``resp``, of the last round of each run."""

    theta: Theta
    shares: Callable[[], DataFrame]
    loops: int
    q: dict
    converged: bool
    of_run: dict = field(default_factory=dict)

    @property
    def resp(self) -> DataFrame:
        return self.shares()


#: A run's class of a document that is not in the run, and of one whose class is not known.
ABSENT, UNKNOWN = -2, -1
#: Parts of an objective, beside a step's sums of weights, that add up exactly.
PARTS = 4


def _spread(docs: DataFrame, terms: Terms, runs: list[int]) -> DataFrame | None:
    """doc_id, ys (its class in each run), ids and ns; None if a run holds a document more than once."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col("run_id") == r for r in runs]
    ys = [F.coalesce(F.max(F.when(x, F.coalesce("y", F.lit(UNKNOWN)))), F.lit(ABSENT)).cast("int") for x in own]
    most = F.greatest(*[F.sum(x.cast("int")) for x in own], F.lit(0))
    rows = stored(docs.groupBy("doc_id").agg(F.array(*ys).alias("ys"), most.alias("_most")))
    if not rows.where("_most > 1").isEmpty():
        return None
    rows = rows.select("doc_id", "ys").repartition(parts, "doc_id")
    return stored(rows.join(terms.docs.repartition(parts, "doc_id"), "doc_id", "left"))


def _shared(spread: DataFrame, terms: Terms, theta: Theta, logs: np.ndarray, every: list[int]):
    """A function of a batch of ``spread``: (numbers, places, counts), classes, scores and responsibilities by slot (0 where not allowed)."""
    base = {(r["run_id"], r["k"]): (r["log_prior"], r["log_total"]) for r in theta.rows}
    slots, form, width = theta.slots, terms.form, terms.width
    runs = sorted({r for r, _, _ in slots})
    sent = spread.sparkSession.sparkContext.broadcast(logs)

    def share(batch):
        words, at, n = _unpacked(batch, form, width)
        rows = batch.num_rows
        ys = batch.column("ys").flatten().to_numpy().reshape(rows, len(every))
        length = {r: np.bincount(at, n[r if width else 0], rows) for r in runs}
        score, w = np.empty((rows, len(slots))), np.zeros((rows, len(slots)))
        for i, (r, k, _) in enumerate(slots):
            prior, total = base[r, k]
            score[:, i] = prior - length[r] * total + np.bincount(at, n[r if width else 0] * sent.value[i][words], rows)
        for r in runs:
            own = [i for i, x in enumerate(slots) if x[0] == r]
            y, owner = ys[:, every.index(r)], np.array([slots[i][2] for i in own])
            allowed = (y != ABSENT)[:, None] & ((y == UNKNOWN)[:, None] | (y[:, None] == owner))
            kept = np.where(allowed, score[:, own], -np.inf)
            best = kept.max(1, keepdims=True)
            mass = np.exp(kept - np.where(np.isfinite(best), best, 0.0))
            w[:, own] = mass / np.maximum(mass.sum(1, keepdims=True), np.finfo(float).tiny)
        return words, at, n, ys, score, w

    return share, sent


def _step(spread: DataFrame, terms: Terms, theta: Theta, logs: np.ndarray, every: list[int]):
    """(E- and M-step in one pass: rows as of ``_added`` of the counts, and at -1 of weights and objective; the broadcast parameters)."""
    (share, sent), slots, width, size = _shared(spread, terms, theta, logs, every), theta.slots, terms.width, terms.size

    def step(batches):
        counts, weights, parts = np.zeros((len(slots), size)), np.zeros(len(slots)), np.zeros((PARTS, len(slots)))
        for batch in _sliced(batches, SLICE):
            words, at, n, _, score, w = share(batch)
            for i, (r, _, _) in enumerate(slots):
                if w[:, i].any():
                    np.add.at(counts[i], words, n[r if width else 0] * w[at, i])
            weights += w.sum(0)
            # Whole parts small enough that their sums are exact in any order.
            terms_q = w * score
            whole = np.floor(terms_q)
            rest = np.rint((terms_q - whole) * 1e10)
            for i, part in enumerate((np.floor(whole / 2**20), np.mod(whole, 2**20), np.floor(rest / 1e5), np.mod(rest, 1e5))):
                parts[i] += part.sum(0)
        part = TaskContext.get().partitionId()
        yield _chunk(part, -1, np.vstack([weights, parts]).T.copy())
        yield from _pieces(part, counts, CHUNK)

    return _added(spread.mapInArrow(step, _CHUNKS), len(slots), size), sent


def _shares(docs: DataFrame, spread: DataFrame, terms: Terms, theta: Theta, logs: np.ndarray, every: list[int]) -> DataFrame:
    """run_id, doc_id, y, k, owner, score, w: as ``responsibilities``."""
    (share, _), slots = _shared(spread, terms, theta, logs, every), theta.slots

    def rows(batches):
        for batch in _sliced(batches, SLICE):
            *_, ys, score, w = share(batch)
            for i, (r, k, owner) in enumerate(slots):
                y = ys[:, every.index(r)]
                own = np.flatnonzero((y == UNKNOWN) | (y == owner))
                known = pa.array(y[own], pa.int32(), mask=y[own] == UNKNOWN)
                fixed = {name: pa.array(np.full(len(own), v), pa.int32()) for name, v in (("run_id", r), ("k", k), ("owner", owner))}
                yield pa.RecordBatch.from_pydict({"run_id": fixed["run_id"], "doc_id": batch.column("doc_id").take(pa.array(own)), "y": known, "k": fixed["k"], "owner": fixed["owner"], "score": score[own, i], "w": w[own, i]})

    names = {"run_id": T.IntegerType(), "doc_id": docs.schema["doc_id"].dataType, "y": T.IntegerType(), "k": T.IntegerType(), "owner": T.IntegerType(), "score": T.DoubleType(), "w": T.DoubleType()}
    return spread.mapInArrow(rows, T.StructType([T.StructField(x, t) for x, t in names.items()]))


def expectation_maximisation(docs: DataFrame, tf: DataFrame, parts: DataFrame | list[Slot], start: Theta, words: int, epsilon: float = 1e-4, max_loops: int = LOOPS, folder: str | None = None) -> Fit:
    """Semi-supervised EM of all runs together, each until its own objective moves by at most epsilon.

    A run that rests keeps its parameters and leaves the jobs of the others.  The driver
    holds one number a run and the parameters that are broadcast.  A loop writes nothing
    where all words are numbered; else tables of the last two rounds are in the shared
    folder, and those before are deleted.  With ``folder`` every loop is written so, and a
    fit that broke off goes on from its last whole round.  A negative epsilon asks for all loops.
    """
    rounds, slots = Rounds(docs.sparkSession, folder), slots_of(parts)
    active, theta, before, loops, ended, found = sorted({r for r, _, _ in slots}), start, {}, 0, [], {}
    every, terms = list(active), packed_terms(tf, len(slots))
    spread = _spread(docs, terms, every) if every and terms.rest is None else None
    if folder and (whole := rounds.last()):
        loops, state = whole
        active, before = state["active"], {int(r): _decimal(q) for r, q in state["before"].items()}
        ended = [_kept(rounds, docs.sparkSession, x) for x in state["ended"]]
        found = {int(r): (_decimal(q), n, c) for r, (q, n, c) in state["found"].items()}
        going, base = [tuple(x) for x in state["slots"]], [Row(**dict(zip(("run_id", "k", "y", "log_prior", "log_total"), x))) for x in state["base"]]
        if state["at"] is None:
            theta = Theta(going, docs.sparkSession.createDataFrame(base, _BASE), rounds.read(loops, "packed").select("word_id", "logs"))
        else:
            counts, _ = _collected(rounds.read(loops, "packed"), state["wide"], terms.size)
            theta = Theta(going, None, None, np.log1p(counts[state["at"]]), terms, base)
    while active:
        if spread is None:
            own = docs.where(F.col("run_id").isin(active))
            resp = rounds.table(loops, "resp", responsibilities(scores(own, tf, theta)))
            # One row a run and component.
            sums = resp.groupBy("run_id", "k").agg(F.sum("w").alias("size"), F.sum((F.col("w") * F.col("score")).cast(EXACT)).alias("q")).collect()
            sums = {(r["run_id"], r["k"]): (r["size"], r["q"]) for r in sums}
        else:
            if theta.logs is None or theta.terms is not terms:
                theta = Theta(theta.slots, theta.base, theta.packed, _matrix(theta, terms), terms)
            step, sent = _step(spread, terms, theta, theta.logs, every)
            sums, counts = _summed(rounds.table(loops + 1, "packed", step) if folder else step, theta.slots, terms.size)
            sent.destroy()
        q: dict = {}
        for (r, _), (_, part) in sums.items():
            q[r] = q.get(r, 0) + part
        rest = {r for r in active if r not in q or (r in before and epsilon >= 0 and abs(q[r] - before[r]) <= epsilon)}
        over = loops >= max_loops
        if rest or over:
            leave = active if over else sorted(rest)
            found |= {r: (q.get(r), loops, r in rest) for r in leave}
            name = f"kept-{loops:06d}"
            kept = theta.only(leave)
            last = _lazy_shares(docs, spread, terms, kept, every) if spread is not None else resp.where(F.col("run_id").isin(leave))
            if len(leave) < len(active) and (folder or spread is None):
                # The others' rounds go on and delete this one.
                base, packed = _keep(rounds, f"{name}/base", kept.base), _keep(rounds, f"{name}/packed", kept.packed)
                kept = Theta(kept.slots, base, packed, kept.logs, kept.terms)
                last = _keep(rounds, f"{name}/resp", last() if callable(last) else last)
            ended.append((kept, last, name))
            active = [r for r in active if r not in leave]
        if not active:
            break
        before, loops, sizes = q, loops + 1, {key: size for key, (size, _) in sums.items()}
        going = [x for x in slots if x[0] in active]
        at = None
        if spread is None:
            shares = resp.where(F.col("run_id").isin(active)).select("run_id", "doc_id", "k", "w")
            theta = maximise(shares, tf, going, words, lambda df: rounds.table(loops, "packed", df), sizes)
        else:
            at = [theta.slots.index(x) for x in going]
            counts = counts[at]
            wide = len(theta.slots)
            theta = Theta(going, None, None, np.log1p(counts), terms, _base(going, sizes, counts.sum(1).tolist(), words))
        if folder or spread is None:
            rounds.done(loops, {"active": active, "slots": theta.slots, "base": [tuple(r) for r in theta.rows], "at": at, "wide": wide if at is not None else 0, "before": {r: str(x) for r, x in before.items()}, "found": {r: (str(x[0]), *x[1:]) for r, x in found.items()}, "ended": [(x[2], x[0].slots) for x in ended]})
    whole = joined([x[0] for x in ended])
    if spread is not None and whole.logs is not None and not folder:
        # What is read of the parameters as a table, by any reader.
        whole = Theta(whole.slots, None, _word_logs(rounds.table(loops, "packed", _held(docs.sparkSession, whole.logs)), terms, len(whole.slots)), whole.logs, terms, whole.rows)

    def shares() -> DataFrame:
        parts = [x() if callable(x) else x for _, x, _ in ended]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    return Fit(whole, shares, max(n for _, n, _ in found.values()), {r: float(x[0] or 0) for r, x in found.items()}, all(c for _, _, c in found.values()), {r: n for r, (_, n, _) in found.items()})


def _lazy_shares(docs: DataFrame, spread: DataFrame, terms: Terms, theta: Theta, every: list[int]) -> Callable[[], DataFrame]:
    return lambda: _shares(docs, spread, terms, theta, theta.logs, every)


def _summed(step: DataFrame, slots: list[Slot], size: int) -> tuple[dict, np.ndarray]:
    """({(run_id, k): (weight, objective)} of the runs that hold documents, counts by slot and word)."""
    counts, other = _collected(step, len(slots), size)
    sums = {}
    for i, (r, k, _) in enumerate(slots):
        weight, *parts = other[i].tolist() if other is not None else [0.0] * (PARTS + 1)
        a, b, c, d = (int(x) for x in parts)
        sums[r, k] = weight, Decimal(((a << 20) + b) * 10**10 + c * 10**5 + d).scaleb(-10)
    held = {r for (r, _), (weight, _) in sums.items() if weight}
    return {key: v for key, v in sums.items() if key[0] in held}, counts


def _decimal(text: str) -> Decimal:
    return Decimal(text)


def _keep(rounds: Rounds, name: str, df: DataFrame) -> DataFrame:
    path = f"{rounds.folder}-{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept(rounds: Rounds, spark, x: list) -> tuple[Theta, DataFrame, str]:
    """What ``_keep`` has written of runs that ended before a fit broke off."""
    name, slots = x
    read = lambda part: spark.read.parquet(f"{rounds.folder}-{name}/{part}")
    return Theta([tuple(s) for s in slots], read("base"), read("packed")), read("resp"), name


class MultinomialModel:
    """train() and test() over docs and tf: the four models by ``components`` and ``semi``."""

    def __init__(self, docs: DataFrame, tf: DataFrame, words: int, components: list[int], semi: bool = False, assignment: DataFrame | None = None, theta_zero: Theta | None = None, epsilon: float = 1e-4, max_loops: int = LOOPS, seed: int = 0):
        self.docs = docs if "run_id" in docs.columns else docs.withColumn("run_id", F.lit(0))
        self.tf, self.words, self.components, self.semi = tf, words, components, semi
        self.assignment, self.start, self.epsilon, self.max_loops, self.seed = assignment, theta_zero, epsilon, max_loops, seed
        self.theta: Theta | None = None
        self.loops, self.converged = 0, not semi

    def train(self) -> MultinomialModel:
        parts = several_parts(self.docs, self.components)
        if self.assignment is not None:
            first = assigned_start(self.docs, self.assignment)
        else:
            first = random_start(self.docs, self.components, self.seed) if max(self.components) > 1 else hard_start(self.docs, parts)
        self.theta = self.start or maximise(first, self.tf, parts, self.words)
        if self.semi:
            fit = expectation_maximisation(self.docs, self.tf, parts, self.theta, self.words, self.epsilon, self.max_loops)
            self.theta, self.loops, self.converged = fit.theta, fit.loops, fit.converged
        return self

    def test(self, docs: DataFrame, tf: DataFrame | None = None) -> DataFrame:
        from ..errors import NotTrainedError

        if self.theta is None:
            raise NotTrainedError("train() comes first")
        rows = docs if "run_id" in docs.columns else docs.withColumn("run_id", F.lit(0))
        return predict(rows, tf if tf is not None else self.tf, self.theta)
