"""Operator 12: cost-balanced packing of token sequences.

A piece of L tokens costs a linear part and the square of its length, as attention
stays within the piece.  In a block of documents, the pieces go by descending cost,
each to the sequence of the lowest cost so far that has room for all of it; if
none has, it is cut: the cheapest sequence with any room is filled, and the rest of
the piece goes on in the same way.

Sequences are padded to their capacity unless they are as long as a power of two,
so a block's sequences are as many full ones as its tokens fill and, for the rest,
one for each power of two that the rest is a sum of.  Their room is exactly the
block's tokens: no sequence is padded, and at most one cut falls to a sequence.
Documents longer than a sequence give whole sequences first; only the remainder
of each document is packed, so what a task holds is bounded by the block.

Defined results: a null text is an empty one (the end id alone); texts of any length
are encoded whole; equal rows are packed one by one, pieces of equal cost in the
order of their columns; a null ``doc_id`` is kept; an empty table gives no rows; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, slices, spread, table
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
END_ID = 1
#: Documents in a block on average; each leaves at most one piece to pack.
BLOCK_DOCUMENTS = 4096
#: Cost of a token beside the squared length of its piece: about six times the width of the model.
LINEAR = 12_288


def rooms(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Rooms of sequences that ``tokens`` fill without padding."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(sizes: list[int], capacity: int = CAPACITY, linear: int = LINEAR) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) of all parts; ``sizes`` are at most ``capacity``."""
    room = np.array(rooms(sum(sizes), capacity), np.int64)
    size, cost = room.copy(), np.zeros(len(room), np.int64)
    # A sequence's cost where the piece fits, a huge number elsewhere.
    never = np.iinfo(np.int64).max
    out = []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        start, left = 0, sizes[piece]
        while left:
            open_ = np.where(room >= left, cost, never)
            to = int(open_.argmin())
            if open_[to] == never:
                to = int(np.where(room > 0, cost, never).argmin())
            part = min(left, int(room[to]))
            out.append((piece, start, part, to, int(size[to] - room[to])))
            room[to] -= part
            cost[to] += linear * part + part * part
            start, left = start + part, left - part
    return out


_PIECES = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]


def _batches(rows: list[tuple], size: int = 2048) -> Iterator[pa.RecordBatch]:
    """The rows as batches; empties the list."""
    for at in range(0, len(rows), size):
        columns = zip(*rows[at : at + size])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == "binary" else pa.int64()) for x, (_, k) in zip(columns, _PIECES)], [n for n, _ in _PIECES])
    rows.clear()


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids (two bytes each where the vocabulary allows), doc_tokens: every document's whole sequences and remainder."""
    vocabulary = tokenizer or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced=True)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist())):
                raw = np.append(ids, encode.kind(end_id))
                rows += [(doc_id, at, len(part := raw[at : at + capacity]), part.tobytes(), len(raw)) for at in range(0, len(raw), capacity)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def balanced_sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, linear: int = LINEAR, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids, two bytes each where the vocabulary allows.  ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    vocabulary = tokenizer or vocabulary_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(vocabulary, spaced=True).kind
        width = np.dtype(kind).itemsize
        block, whole, loose, out = None, 0, [], []

        def add(x: tuple, start: int, length: int, sequence: int, offset: int) -> None:
            doc_id, before, _, ids, doc_tokens, _ = x
            ids = ids[start * width : (start + length) * width]
            crc = zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes())
            out.append((doc_id, before + start, length, ids, crc, doc_tokens, (block << 32) + sequence, offset))

        def flush() -> None:
            loose.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3]))
            for piece, start, length, sequence, offset in balance([x[2] for x in loose], capacity, linear):
                add(loose[piece], start, length, whole + sequence, offset)
            loose.clear()

        for batch in slices(batches):
            for x in zip(*[c.to_pylist() for c in batch.columns]):
                if x[5] != block:
                    flush()
                    block, whole = x[5], 0
                if x[2] == capacity:
                    add(x, 0, capacity, whole, 0)
                    whole += 1
                else:
                    loose.append(x)
            yield from _batches(out)
        flush()
        yield from _batches(out)

    blocks = blocks_for(docs.count(), block_documents)
    # Equal rows stand in many tasks, so the task number spreads them over the blocks.
    block_of = F.pmod(F.xxhash64("doc_id", "start", "length", F.crc32("ids"), F.spark_partition_id()), F.lit(blocks))
    # Whole sequences of a block come before its remainders and pass at once; a task holds one block's remainders.
    dealt = spread(encoded(docs, vocabulary, end_id, capacity).withColumn("block", block_of), "block")
    return dealt.sortWithinPartitions("block", F.col("length") < capacity).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _PIECES))


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_sequences(table(spark, sf_dir, "documents")).drop("ids")
