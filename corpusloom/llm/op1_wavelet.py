"""Operator 1: token ids of a corpus in wavelet-matrix shard files.

``write_shards`` encodes texts, cuts the id stream (ascending ``doc_id``) into
shards and writes one file per shard: for every bit of the ids a bit plane in
wavelet order with a rank directory; planes are compressed in blocks, so that a
lookup unpacks a few of them and not whole planes.
``WaveletShard`` answers access, rank, select, count and occurrence lookups
from such a file; ``read_documents`` reads all files back as one row a document,
``token_counts`` and ``token_places`` answer lookups over all files.

Defined results: a text of any length is encoded whole; a null text is an empty one (its ids are the end id alone);
rows without a ``doc_id`` come first, as null; rows that share a ``doc_id`` stay
apart, ordered by text; an empty table writes no file; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_dir, read_file, saved, slices, spread, table, write_file
from .tokens import encoder, vocabulary_path

MAGIC = b"WVLTSHD1"
END_ID = 1
SHARD_TOKENS = 2_000_000
#: Bits between two entries of a plane's rank directory; bytes of a plane that are compressed together.
RANK_STEP = 512
PLANE_BLOCK = 16_384


def _bits(values: np.ndarray, bit: int) -> np.ndarray:
    return (values & values.dtype.type(1 << bit)) != 0


def pack_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """The file of one shard: ids of its documents, in order, as a wavelet matrix."""
    codec = pa.Codec("zstd", compression_level=1)
    n, width = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    sections: list[tuple[str, np.ndarray]] = [
        ("lengths", lengths.astype("<u4")),
        ("doc_ids", np.array([x or 0 for x in doc_ids], "<i8")),
        ("doc_null", np.packbits(np.array([x is None for x in doc_ids], bool))),
    ]
    zeros, current = [], ids
    for bit in range(width - 1, -1, -1):
        ones = _bits(current, bit)
        plane = np.packbits(ones)
        counts = np.bitwise_count(np.pad(plane, (0, -len(plane) % (RANK_STEP // 8)))).reshape(-1, RANK_STEP // 8).sum(1)
        sections += [(f"plane{bit}", plane), (f"rank{bit}", np.concatenate(([0], np.cumsum(counts))).astype("<u4"))]
        current = np.concatenate((current.compress(~ones), current.compress(ones)))
        zeros.append(n - int(np.count_nonzero(ones)))
    index, body, at = {}, [], 0
    for name, data in sections:
        raw, sizes = data.tobytes(), []
        step = PLANE_BLOCK if name.startswith("plane") else max(1, len(raw))
        for start in range(0, len(raw), step):
            packed = codec.compress(raw[start : start + step], asbytes=True)
            sizes.append(len(packed))
            body.append(packed)
        index[name] = [at, sizes, step, len(raw), data.dtype.str]
        at += sum(sizes)
    head = json.dumps({"n": n, "docs": len(doc_ids), "width": width, "zeros": zeros, "id_type": ids.dtype.str, "index": index}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(body)


class WaveletShard:
    """Reads a shard file; blocks of planes are unpacked when first used."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(data[8:12], "little")
        self.head = json.loads(data[12 : 12 + size])
        self.body = memoryview(data)[12 + size :]
        self.n, self.width, self.zeros = self.head["n"], self.head["width"], self.head["zeros"]
        self._open: dict[str | tuple[str, int], np.ndarray] = {}
        self._starts = {name: np.cumsum([at, *sizes]).tolist() for name, (at, sizes, *_) in self.head["index"].items()}

    def _block(self, name: str, number: int) -> np.ndarray:
        """A block of a section."""
        if (name, number) not in self._open:
            _, _, step, raw, kind = self.head["index"][name]
            a, b = self._starts[name][number : number + 2]
            self._open[name, number] = np.frombuffer(pa.Codec("zstd").decompress(self.body[a:b], min(step, raw - number * step), asbytes=True), kind)
        return self._open[name, number]

    def section(self, name: str) -> np.ndarray:
        if name not in self._open:
            _, sizes, _, _, kind = self.head["index"][name]
            self._open[name] = np.concatenate([self._block(name, i) for i in range(len(sizes))]) if sizes else np.zeros(0, kind)
        return self._open[name]

    def _plane(self, bit: int, start: int, end: int) -> np.ndarray:
        """Bytes [start, end) of a plane; they lie in one block, as ranks are counted in parts of one."""
        block = start // PLANE_BLOCK
        if start >= end:
            return np.zeros(0, np.uint8)
        return self._block(f"plane{bit}", block)[start - block * PLANE_BLOCK : end - block * PLANE_BLOCK]

    @property
    def doc_ids(self) -> list[int | None]:
        null = np.unpackbits(self.section("doc_null"), count=self.head["docs"])
        return [None if gone else x for x, gone in zip(self.section("doc_ids").tolist(), null)]

    @property
    def lengths(self) -> np.ndarray:
        return self.section("lengths").astype(np.int64)

    def _rank1(self, bit: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // RANK_STEP
        head, inside = int(self.section(f"rank{bit}")[block]), i - block * RANK_STEP
        if not inside:
            return head
        bits = np.unpackbits(self._plane(bit, block * RANK_STEP // 8, (i + 7) // 8))[:inside]
        return head + int(bits.sum())

    def _select(self, bit: int, value: int, k: int) -> int:
        """Place of the k-th (from 0) bit equal to value in a plane."""
        ranks = self.section(f"rank{bit}").astype(np.int64)
        before = ranks if value else np.arange(len(ranks)) * RANK_STEP - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._plane(bit, block * RANK_STEP // 8, (block + 1) * RANK_STEP // 8))
        return block * RANK_STEP + int(np.flatnonzero(bits == value)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level, bit in enumerate(range(self.width - 1, -1, -1)):
            one = int(self._plane(bit, i // 8, i // 8 + 1)[0]) >> (7 - i % 8) & 1
            ones = self._rank1(bit, i)
            i = self.zeros[level] + ones if one else i - ones
            value |= one << bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        if token < 0 or token >> self.width:
            return 0, 0
        for level, bit in enumerate(range(self.width - 1, -1, -1)):
            a, b = self._rank1(bit, low), self._rank1(bit, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> bit & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often the token occurs before place end."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level, bit in zip(range(self.width - 1, -1, -1), range(self.width)):
            one = token >> bit & 1
            at = self._select(bit, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up: each level's order is undone in turn."""
        current = np.zeros(self.n, self.head["id_type"])
        for level, bit in zip(range(self.width - 1, -1, -1), range(self.width)):
            ones = np.unpackbits(self.section(f"plane{bit}"), count=self.n).view(bool)
            above = np.empty_like(current)
            above[~ones] = current[: self.zeros[level]]
            above[ones] = current[self.zeros[level] :] | current.dtype.type(1 << bit)
            current = above
        return current


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files under ``path``; returns their manifest.

    Manifest: shard path, ``part`` and ``seq`` (order of shards), ``n_docs``,
    ``n_tokens`` and ``start`` (ids in all shards before it).  A task that runs
    twice writes other file names; only files in the manifest count.
    """
    vocabulary = tokenizer or vocabulary_path()
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, doc_ids, held, seq
            name = f"{path}/shard-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.wvm"
            write_file(name, pack_shard(np.concatenate(ids), np.array([len(x) for x in ids]), doc_ids))
            row = pa.RecordBatch.from_pydict({"path": [name], "part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            ids, doc_ids, held, seq = [], [], 0, seq + 1
            return row

        end = np.array([end_id], encode.kind)
        for batch in slices(batches):
            for doc_id, x in zip(batch.column(0).to_pylist(), encode.encode(batch.column(1).to_pylist())):
                ids.append(np.concatenate((x, end)))
                doc_ids.append(doc_id)
                held += len(x) + 1
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    manifest = saved(ordered.mapInArrow(write, "path string, part long, seq long, n_docs long, n_tokens long"), "op1-manifest")
    # As many rows as there are partitions: the only unpartitioned window.
    before = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_in_part"))
    before = before.select("part", (F.sum("_in_part").over(W.orderBy("part")) - F.col("_in_part")).alias("_before"))
    inside = F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("_inside", inside).join(before, "part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row a document from the shard files: doc_id, start, n_tokens, ids_crc32, shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletShard(read_file(path))
                ids, lengths = shard.ids().astype("<u4"), shard.lengths
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": pa.array(crc, pa.int64()), "shard": [path.rpartition("/")[2]] * len(crc)})

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_counts(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """path, token, n: how often each token occurs in each shard file, from its ranks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shard = WaveletShard(read_file(path))
                yield pa.RecordBatch.from_pydict({"path": [path] * len(tokens), "token": pa.array(tokens, pa.int64()), "n": pa.array([shard.count(x) for x in tokens], pa.int64())})

    return spread(manifest.select("path"), "path").mapInArrow(read, "path string, token long, n long")


def token_places(manifest: DataFrame, token: int, block: int = 65_536) -> DataFrame:
    """place: every place of the token among all ids, from the shard files' selects; a batch holds ``block`` of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletShard(read_file(path))
                n = shard.count(token)
                for low in range(0, n, block):
                    yield pa.RecordBatch.from_pydict({"place": pa.array([start + shard.select(token, k) for k in range(low, min(n, low + block))], pa.int64())})

    return spread(manifest.select("path", "start"), "path").mapInArrow(read, "place long")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), new_dir(spark, "op1-shards"))
    return read_documents(manifest).drop("shard")
