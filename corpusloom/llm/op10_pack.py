"""Operator 10: best-fit packing of token sequences with swap-based local search.

Documents are encoded and only those longer than a sequence are cut.  Pieces
are dealt into blocks of bounded size by a hash; inside a block, best-fit
decreasing gives a first packing.  Local search then goes through the underfull
bins, the emptiest first, as donors: as long as it helps, a piece of the donor
moves to a fuller bin, is exchanged for a smaller one of it, or two of its pieces
for one, always the step that fills most; each step increases the sum of squared
fills, and donors that become empty go.  Passes over the donors are repeated until
one finds no step; only donors that all fuller bins together have no room for are
left out, as they can't be emptied.  The bins that blocks leave underfull are packed
and searched once more together, block of blocks by block of blocks.

Defined results: a null text is an empty one (one piece, the end id alone);
a text of any length is encoded whole; equal rows are packed one by one, pieces
of equal length in the order of their columns; a null ``doc_id`` is kept; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_for, saved, slices, table
from .tokens import encoder, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Pieces in a block at most, on average.
BLOCK_PIECES = 20_000


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of places in ``sizes``."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, number = capacity, len(bins)
            bins.append([])
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[number].append(i)
        room -= size
        if not by_room[room]:
            insort(rooms, room)
        by_room[room].append(number)
    return bins


class _Search:
    """Local search over the bins of a block; ``bin_of`` and ``fill`` are its state."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.sizes, self.capacity = np.array(sizes, np.int64), capacity
        self.bins = [set(x) for x in bins]
        self.bin_of = np.zeros(len(sizes), np.int64)
        for number, own in enumerate(bins):
            self.bin_of[own] = number
        self.fill = np.bincount(self.bin_of, self.sizes, len(bins)).astype(np.int64)

    def step(self, donor: int) -> bool:
        """The step from the donor to a bin that is at least as full which moves most; False if there is none."""
        size, fill = self.sizes, self.fill
        room = self.capacity - fill
        usable = (fill >= fill[donor]) & (room > 0)
        usable[donor] = False
        bins = np.flatnonzero(usable)
        if not len(bins):
            return False
        # most[x]: room of the emptiest usable bin that holds a piece of size x; x = 0 stands for no piece.
        most = np.zeros(self.capacity + 1, np.int64)
        held = usable[self.bin_of]
        np.maximum.at(most, size[held], room[self.bin_of[held]])
        most[0] = room[bins].max()
        # least[c]: the smallest piece that can go for pieces of sum c, which fit in its place.
        least = np.full(2 * self.capacity + 1, self.capacity + 1, np.int64)
        for x in np.flatnonzero(most)[::-1].tolist():
            least[x + 1 : x + most[x] + 1] = x
        own: dict[int, list[int]] = {}
        for i in sorted(self.bins[donor]):
            own.setdefault(int(size[i]), []).append(i)
        kinds = np.array(sorted(own), np.int64)
        one = kinds - least[kinds]
        low, high = np.triu_indices(len(kinds))
        sums = kinds[low] + kinds[high]
        # Two pieces go for one; two of one size need two such pieces.
        two = np.where((least[sums] > 0) & ((low != high) | np.array([len(own[k]) > 1 for k in kinds.tolist()])[low]), sums - least[sums], 0)
        best_one, best_two = int(one.max(initial=0)), int(two.max(initial=0))
        if max(best_one, best_two) <= 0:
            return False
        if best_one >= best_two:
            total = int(kinds[one.argmax()])
            given = own[total][:1]
        else:
            at = int(two.argmax())
            a, b = int(kinds[low[at]]), int(kinds[high[at]])
            total, given = a + b, own[a][:2] if a == b else [own[a][0], own[b][0]]
        back = int(least[total])
        if back:
            taken = np.flatnonzero(held & (size == back) & (room[self.bin_of] >= total - back))
            taken = [int(taken[np.lexsort((taken, room[self.bin_of[taken]]))[0]])]
            target = int(self.bin_of[taken[0]])
        else:
            fits = bins[room[bins] >= total]
            taken, target = [], int(fits[np.lexsort((fits, room[fits]))[0]])
        for pieces_, source, to in ((given, donor, target), (taken, target, donor)):
            for i in pieces_:
                self.bins[source].remove(i)
                self.bins[to].add(i)
                self.bin_of[i] = to
        fill[target] += total - back
        fill[donor] -= total - back
        return True

    def run(self) -> list[list[int]]:
        helped = True
        while helped:
            helped = False
            under = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            order = under[np.lexsort((under, self.fill[under]))]
            above = np.cumsum((self.capacity - self.fill[order])[::-1])[::-1]
            for donor, with_own in zip(order.tolist(), above.tolist()):
                # Its own room and that of the fuller bins: less than a bin, and it can't be emptied into them.
                if with_own < self.capacity:
                    break
                while self.fill[donor] and self.step(donor):
                    helped = True
        return [sorted(x) for x in self.bins if x]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins (lists of places in ``sizes``) of at most ``capacity``."""
    return _Search(_best_fit(sizes, capacity), sizes, capacity).run()


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""
    vocabulary = tokenizer or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist())):
                raw = np.append(ids, encode.kind(end_id)).astype("<u4").tobytes()
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                ids_, piece_, start_, length_, crc_ = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(piece_, pa.int32()), pa.array(start_, pa.int64()), pa.array(length_, pa.int64()), pa.array(crc_, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_block(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "start", "ids_crc32", "length"], kind="stable", ignore_index=True)
        sizes = part["length"].tolist()
        number, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        for k, own in enumerate(pack(sizes, capacity)):
            at = 0
            for i in own:
                number[i], offset[i] = k, at
                at += sizes[i]
        fill = np.bincount(number, weights=part["length"])[number].astype(np.int64) if len(part) else number
        return part.assign(sequence_id=part["block"] * (1 << 32) + number, offset=offset, fill=fill)

    return run


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (a saved table: it is read more than once)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, sequence_id long, offset long, fill long"
    blocks = blocks_for(found.count(), block_pieces)
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    first = found.select(*columns).withColumn("block", key).groupBy("block").applyInPandas(_pack_block(capacity), schema)
    if blocks == 1:
        return first.select(*columns, "sequence_id", "offset")
    # Bins that their block could not fill are a small share; they meet again in other blocks.
    first = saved(first, "op10-first")
    rest = first.where(F.col("fill") < capacity)
    again = blocks_for(rest.count(), block_pieces)
    key = (F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "sequence_id", "offset"), F.lit(again)) + blocks).cast("long")
    second = rest.select(*columns, key.alias("block")).groupBy("block").applyInPandas(_pack_block(capacity), schema)
    return first.where(F.col("fill") >= capacity).unionByName(second).select(*columns, "sequence_id", "offset")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(saved(pieces(table(spark, sf_dir, "documents")), "op10-pieces"))
