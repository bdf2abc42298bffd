"""Terms of whole corpora in packed form: a row a document, of word numbers and counts.

Texts are cut into words in their partitions and counted there, a block of documents at
a time.  Shuffled are each block's different words (to number them all) and its packed
documents (to take the numbers on), but no row for each term.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import tokens
from ..session import numbered, stored

#: Tokens of a block: more share more words, and one task holds a block.
BLOCK = 1 << 22
#: Types of a document's numbers and counts, in bytes.
IDS, COUNTS, SCALED = "<i4", "<i4", "<f8"

_FIELDS = [("block", T.LongType()), ("doc_id", None), ("ids", T.BinaryType()), ("ns", T.BinaryType()), ("word", T.StringType()), ("number", T.IntegerType()), ("total", T.LongType()), ("df", T.LongType())]


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes of ``values``, so many to a row."""
    offsets = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(column, form: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of bytes, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), form), np.array([len(x) for x in rows], np.int64) // np.dtype(form).itemsize


def _counter(most: int):
    def count(batches):
        """Of each block: a row a document (numbers within the block, counts) and a row a word (occurrences, documents)."""
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            found = batch.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # A block ends with the document that fills it.
            last = (np.cumsum(lengths) - 1) // most
            cuts = [0, *(np.flatnonzero(last[1:] != last[:-1]) + 1).tolist(), len(lengths)]
            for a, b in zip(cuts, cuts[1:]):
                coded = _whole(found.slice(a, b - a).flatten().dictionary_encode())
                own, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                if not size:
                    continue
                terms, n = np.unique(np.repeat(np.arange(b - a), lengths[a:b]) * size + own, return_counts=True)
                at, ids = np.divmod(terms, size)
                each = np.bincount(at, minlength=b - a)
                columns = {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": _binary(ids.astype(IDS), each), "ns": _binary(n.astype(COUNTS), each)}
                yield columns, block, b - a
                columns = {"word": coded.dictionary.cast(pa.string()), "number": pa.array(np.arange(size, dtype=np.int32)), "total": pa.array(np.bincount(own, minlength=size)), "df": pa.array(np.bincount(ids, minlength=size))}
                yield columns, block, size
                block += 1

    def rows(batches):
        types = {"block": pa.int64(), "ids": pa.binary(), "ns": pa.binary(), "word": pa.string(), "number": pa.int32(), "total": pa.int64(), "df": pa.int64()}
        for columns, block, n in count(batches):
            types["doc_id"] = columns["doc_id"].type if "doc_id" in columns else types["doc_id"]
            columns["block"] = pa.array(np.full(n, block))
            yield pa.RecordBatch.from_pydict({name: columns[name] if name in columns else pa.nulls(n, types[name]) for name, _ in _FIELDS})

    return rows


def _renumbered(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents by the corpus's numbers; words that have none go, and so do documents without any."""
    ids, lengths = _numbers(left.column("ids"), IDS)
    ns, _ = _numbers(left.column("ns"), COUNTS)
    to = np.full(int(ids.max(initial=-1)) + 1, -1, np.int32)
    number = right.column("number").to_numpy()
    # Numbers of words that only left-out documents hold.
    known = number < len(to)
    to[number[known]] = right.column("_id").to_numpy()[known]
    new = to[ids]
    kept = new >= 0
    each = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
    out = pa.table({"doc_id": left.column("doc_id"), "ids": _binary(new[kept].astype(IDS), each), "ns": _binary(ns[kept], each)})
    return out.filter(pa.array(each > 0))


def packed_words(docs: DataFrame, stop_words: Sequence[str] = (), least: int = 1, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(packed(doc_id, ids, ns), words(word_id, _id, _df)): the words but ``stop_words`` that are found ``least`` times and more.

    ``_id`` numbers the words from 0, those of most documents first.  Texts of one id are one document.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", text).repartition(parts, "doc_id").select("doc_id", tokens(F.col(text)).alias("tokens"))
    key = docs.schema["doc_id"].dataType
    blocks = stored(dealt.mapInArrow(_counter(BLOCK), T.StructType([T.StructField(name, kind or key) for name, kind in _FIELDS])))
    own = blocks.where("word is not null")
    counts = own.groupBy(F.col("word").alias("word_id")).agg(F.sum("total").alias("_total"), F.sum("df").alias("_df")).where(F.col("_total") >= least)
    counts = counts.where(~F.col("word_id").isin(list(stop_words))) if stop_words else counts
    words = stored(numbered(counts.select("word_id", "_df"), "_id", F.desc("_df"), F.asc("word_id")).select("word_id", (F.col("_id") - 1).cast("int").alias("_id"), "_df"))
    to = own.select("block", "number", F.col("word").alias("word_id")).join(words.select("word_id", "_id"), "word_id").select(F.col("block").alias("_block"), "number", "_id")
    rows = blocks.where("ids is not null and doc_id is not null").select("block", "doc_id", "ids", "ns")
    schema = T.StructType([T.StructField("doc_id", key), T.StructField("ids", T.BinaryType()), T.StructField("ns", T.BinaryType())])
    packed = stored(rows.groupBy("block").cogroup(to.groupBy("_block")).applyInArrow(_renumbered, schema))
    if not packed.groupBy("doc_id").count().where("count > 1").isEmpty():
        packed = stored(packed.groupBy("doc_id").agg(F.collect_list(F.struct("ids", "ns")).alias("_all")).select("doc_id", "_all").mapInArrow(_merged, schema))
    return packed, words


def _merged(batches):
    """One row a document of several, with one count a word."""
    for batch in batches:
        ids, ns, each = [], [], []
        for rows in batch.column("_all").to_pylist():
            own, at = np.unique(np.frombuffer(b"".join(x["ids"] for x in rows), IDS), return_inverse=True)
            ids.append(own)
            ns.append(np.bincount(at, np.frombuffer(b"".join(x["ns"] for x in rows), COUNTS)).astype(COUNTS))
            each.append(len(own))
        if each:
            lengths = np.array(each)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": _binary(np.concatenate(ids), lengths), "ns": _binary(np.concatenate(ns), lengths)})


def below(packed: DataFrame, size: int, form: str = COUNTS) -> DataFrame:
    """``packed`` with the words numbered below ``size`` alone."""

    def first(batches):
        for batch in batches:
            ids, lengths = _numbers(batch.column("ids"), IDS)
            ns, _ = _numbers(batch.column("ns"), form)
            kept = ids < size
            each = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
            # Several counts a word, where runs have their own.
            width = max(1, len(ns) // max(1, len(ids)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": _binary(ids[kept], each), "ns": _binary(ns.reshape(-1, width)[kept].ravel(), each * width)})

    return packed.mapInArrow(first, packed.schema)


def term_rows(packed: DataFrame, words: DataFrame, start: int = 0, form: str = COUNTS, width: int = 0) -> DataFrame:
    """tf(doc_id, word_id, n) of the words numbered ``start`` and more; with ``width``, n is an array of so many."""
    whole = form == COUNTS

    def rows(batches):
        for batch in batches:
            ids, lengths = _numbers(batch.column("ids"), IDS)
            ns, _ = _numbers(batch.column("ns"), form)
            kept = ids >= start
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths)[kept])
            if width:
                n = pa.FixedSizeListArray.from_arrays(pa.array(ns.reshape(-1, width)[kept].ravel()), width).cast(pa.list_(pa.float64()))
            else:
                n = pa.array(ns[kept].astype(np.int64 if whole else float))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "_id": pa.array(ids[kept], pa.int32()), "n": n})

    kind = T.ArrayType(T.DoubleType()) if width else T.LongType() if whole else T.DoubleType()
    schema = T.StructType([packed.schema["doc_id"], T.StructField("_id", T.IntegerType()), T.StructField("n", kind)])
    return packed.mapInArrow(rows, schema).join(words.select("_id", "word_id"), "_id").select("doc_id", "word_id", "n")


def scaled(packed: DataFrame, length: float, kind: str) -> DataFrame:
    """``packed`` with counts (now of type ``SCALED``) scaled so that each document's L1 or L2 length is ``length``."""

    def scale(batches):
        for batch in batches:
            ns, lengths = _numbers(batch.column("ns"), COUNTS)
            n, at = ns.astype(float), np.repeat(np.arange(len(lengths)), lengths)
            whole = np.bincount(at, n, len(lengths)) if kind == "l1" else np.sqrt(np.bincount(at, n * n, len(lengths)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": batch.column("ids"), "ns": _binary(n * float(length) / whole[at], lengths)})

    return packed.mapInArrow(scale, packed.schema)


def seen_cells(labelled: DataFrame) -> DataFrame:
    """run_id, word (its number), occurrences, y, docs of packed documents with run_id and y: counted in each batch before the shuffle."""

    def cells(batches):
        for batch in batches:
            ids, lengths = _numbers(batch.column("ids"), IDS)
            ns, _ = _numbers(batch.column("ns"), COUNTS)
            if not len(ids):
                continue
            groups, own = np.unique(np.stack([batch.column(x).to_numpy().astype(np.int64) for x in ("run_id", "y")]), axis=1, return_inverse=True)
            high, most = int(ids.max()) + 1, int(ns.max()) + 1
            keys, docs = np.unique((np.repeat(own.ravel(), lengths) * high + ids) * most + ns, return_counts=True)
            rest, n = np.divmod(keys, most)
            group, word = np.divmod(rest, high)
            yield pa.RecordBatch.from_pydict({"run_id": pa.array(groups[0][group].astype(np.int32)), "word": pa.array(word.astype(np.int32)), "occurrences": pa.array(n), "y": pa.array(groups[1][group].astype(np.int32)), "docs": pa.array(docs.astype(np.int64))})

    found = labelled.select("run_id", "y", "ids", "ns").mapInArrow(cells, "run_id int, word int, occurrences long, y int, docs long")
    return found.groupBy("run_id", "word", "occurrences", "y").agg(F.sum("docs").alias("docs"))


def chosen(packed: DataFrame, numbers: np.ndarray, mask: np.ndarray, length: float | None = None) -> DataFrame:
    """The words ``numbers``, renumbered in this order, with a count (of type ``SCALED``) for each run: 0 where ``mask`` (words by runs) is false, else the count, scaled to ``length`` of the run's words.

    Documents without any of the words are left out.
    """
    to = np.full(int(numbers.max(initial=-1)) + 1, -1, np.int32)
    to[numbers] = np.arange(len(numbers))

    def take(batches):
        for batch in batches:
            ids, lengths = _numbers(batch.column("ids"), IDS)
            ns, _ = _numbers(batch.column("ns"), COUNTS)
            new = np.full(len(ids), -1, np.int32)
            new[ids < len(to)] = to[ids[ids < len(to)]]
            kept = new >= 0
            at = np.repeat(np.arange(len(lengths)), lengths)[kept]
            n = np.where(mask[new[kept]], ns[kept, None], 0).astype(float)
            if length:
                whole = np.stack([np.bincount(at, x, len(lengths)) for x in n.T], 1)[at]
                n = np.divide(n * float(length), whole, out=np.zeros_like(n), where=whole > 0)
            each = np.bincount(at, minlength=len(lengths))
            out = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": _binary(new[kept], each), "ns": _binary(n.ravel(), each * mask.shape[1])})
            yield out.filter(pa.array(each > 0))

    return packed.mapInArrow(take, packed.schema)
