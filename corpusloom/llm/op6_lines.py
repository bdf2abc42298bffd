"""Operator 6: line dedup through sharded minimal perfect hashes.

Line keys are hashed to 128 bits and counted by Spark; the keys that at least
two documents hold are dealt by hash into shards of bounded size, and each shard
becomes one index file: a minimal perfect hash over its keys and, in its order,
a fingerprint array, a count array and the array of the smallest documents.
Documents then probe those arrays; their lines are never joined.

A task looks the lines of PROBE_BYTES of text up together, shard by shard.

Defined results: a null or empty text is one empty line and stays; a key is the
line stripped of white space with A-Z lower-cased; lines of rows without a
``doc_id`` are neither counted nor dropped; a line of any length has a key; rows that share a ``doc_id`` are one
document for counting and each is cleaned; an empty table gives no rows; other
columns pass through ``dedup_lines`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, blocks_for, gathered, new_dir, read_file, saved, slices, table, write_file

MIN_POINTS = 10
MIN_DOCS = 2
#: Keys in a shard on average, and bytes of shards that one task keeps.
SHARD_KEYS = 1_000_000
KEPT_BYTES = 128_000_000
#: Bytes of text that are looked up together: within them each shard is read once.
PROBE_BYTES = 32_000_000
#: A level keeps about half of the keys that are left.
MAX_LEVELS = 200
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_key(line: str) -> bytes:
    """The key of a line; b"" if it has too few code points to be judged."""
    line = line.strip(SPACE)
    return line.encode("utf-8").lower() if len(line) >= MIN_POINTS else b""


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each key, as rows."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in keys]), "<u8").reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash: levels of bit arrays; a key's place is the rank of its bit.

    At each level the keys that meet no other key take the bit they hash to, the
    others go on to the next level; places are numbered through all levels.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        ones = [np.bitwise_count(x) for x in levels]
        self.ranks, before = [], 0
        for x in ones:
            self.ranks.append(before + np.concatenate(([0], np.cumsum(x, dtype=np.int64))))
            before += int(x.sum())
        self.n = before

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys * (_MIX + np.uint64(2 * level * 0x51ED270B)) + np.uint64(level)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct unsigned 64-bit integers."""
        levels, sizes = [], []
        while len(keys):
            if len(levels) == MAX_LEVELS:
                raise ValueError(f"{len(keys)} keys still meet after {MAX_LEVELS} levels: they are not distinct")
            size = max(64, int(1.5 * len(keys)) // 8 * 8)
            at = cls._place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(levels, sizes)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key that was built in; any place, or -1, for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes)):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit & 1).astype(bool)
            under = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[hit]] = (self.ranks[level][at >> 3] + under)[hit]
            left = left[~hit]
        return out


class LineShard:
    """One index file: minimal perfect hash, fingerprints, counts, smallest documents.

    Keys whose 64 bits for the perfect hash are those of another key stand in
    a list of their own (``spare``: both hashes, count, first), searched by both hashes.
    """

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, first: np.ndarray, spare: np.ndarray):
        self.mph, self.prints, self.counts, self.first, self.spare = mph, prints, counts, first, spare
        self.size = sum(x.nbytes for x in (*mph.levels, *mph.ranks, prints, counts, first, spare))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, first: np.ndarray) -> LineShard:
        # Keys of a shard that share h1 would need one place: h1 and h2 are mixed.
        key = cls._key(h1, h2)
        _, lead = np.unique(key, return_index=True)
        rest = np.setdiff1d(np.arange(len(key)), lead)
        spare = np.stack([h1[rest], h2[rest], counts[rest].astype("<u8"), first[rest].astype("<i8").view("<u8")], 1).astype("<u8") if len(rest) else np.zeros((0, 4), "<u8")
        mph = PerfectHash.build(key[lead])
        order = np.empty(len(lead), np.int64)
        order[mph.lookup(key[lead])] = lead
        return cls(mph, h2[order], np.minimum(counts, 0xFFFFFFFF).astype("<u4")[order], first.astype("<i8")[order], spare)

    @staticmethod
    def _key(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return h1 ^ (h2 * _MIX)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.mph.levels), self.mph.n, len(self.spare), *self.mph.sizes], "<i8")
        return b"".join([np.array([len(head)], "<i8").tobytes(), head.tobytes(), *[x.tobytes() for x in self.mph.levels], self.prints.tobytes(), self.counts.tobytes(), self.first.tobytes(), self.spare.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> LineShard:
        n_head = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", n_head, 8).tolist()
        at, n, spares, sizes, levels = 8 + 8 * n_head, head[1], head[2], head[3:], []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, -(-size // 8), at))
            at += -(-size // 8)
        prints = np.frombuffer(data, "<u8", n, at)
        counts = np.frombuffer(data, "<u4", n, at + 8 * n)
        spare = np.frombuffer(data, "<u8", 4 * spares, at + 20 * n).reshape(-1, 4)
        return cls(PerfectHash(levels, sizes), prints, counts, np.frombuffer(data, "<i8", n, at + 12 * n), spare)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, number of documents, smallest document) of each key."""
        found, counts, first = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        if self.mph.n:
            at = self.mph.lookup(self._key(h1, h2))
            safe = np.where(at < 0, 0, at)
            found, counts, first = (at >= 0) & (self.prints[safe] == h2), self.counts[safe].astype(np.int64), self.first[safe].astype(np.int64)
        for a, b, count, least in self.spare:
            here = (h1 == a) & (h2 == b)
            found, counts, first = found | here, np.where(here, count, counts), np.where(here, least.astype("<i8"), first)
        return found, counts, first


def line_index(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Builds the index files in the shared folder; returns their manifest (shard, shards, path)."""
    spark = docs.sparkSession
    path = new_dir(spark, "op6-index")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {line_key(x) for x in (text or "").split("\n")} - {b""}
                if doc_id is not None:
                    ids += [doc_id] * len(own)
                    found += own
            h = key_hashes(found).view("<i8")
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1])})

    lines = docs.select("doc_id", "text").mapInArrow(keys, "doc_id long, h1 long, h2 long")
    # Rows that share a doc_id count once: least and greatest document decide for two.
    if min_docs == 2:
        counted = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).where(F.col("first") < F.col("_last"))
    else:
        counted = lines.distinct().groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    counted = saved(counted.select("h1", "h2", "first", "n"), "op6-lines")
    shards = blocks_for(counted.count(), shard_keys)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        shard = int(part["shard"].iloc[0])
        h1, h2 = part["h1"].to_numpy().view("<u8"), part["h2"].to_numpy().view("<u8")
        name = f"{path}/lines-{shard:06d}-{uuid.uuid4().hex}.mph"
        write_file(name, LineShard.build(h1, h2, part["n"].to_numpy(), part["first"].to_numpy()).to_bytes())
        return pd.DataFrame({"shard": [shard], "path": [name]})

    dealt = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return saved(dealt.groupBy("shard").applyInPandas(build, "shard int, path string").withColumn("shards", F.lit(shards)), "op6-manifest")


class _Shards:
    """The index files by shard, as many as fit into KEPT_BYTES."""

    def __init__(self, paths: dict[int, str]):
        self.paths, self.open, self.bytes = paths, OrderedDict(), 0

    def get(self, shard: int) -> LineShard | None:
        if shard not in self.open:
            if shard not in self.paths:
                return None
            self.open[shard] = found = LineShard.from_bytes(read_file(self.paths[shard]))
            self.bytes += found.size
            while self.bytes > KEPT_BYTES and len(self.open) > 1:
                self.bytes -= self.open.popitem(last=False)[1].size
        self.open.move_to_end(shard)
        return self.open[shard]


def _clean(rows: list[tuple[int | None, str | None]], shards: _Shards, count: int) -> Iterator[tuple[int, int, str]]:
    """(lines, dropped lines, kept text) of each document."""
    split = [(text or "").split("\n") for _, text in rows]
    keys = [line_key(x) for own in split for x in own]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in split])
    known = np.array([rows[i][0] is not None for i in range(len(rows))], bool)
    judged = np.flatnonzero(np.array([bool(x) for x in keys], bool) & known[owner])
    h = key_hashes([keys[i] for i in judged])
    ids = np.array([x or 0 for x, _ in rows], np.int64)
    drop = np.zeros(len(keys), bool)
    of = h[:, 0].view("<i8") % count if len(h) else np.zeros(0, np.int64)
    for shard in np.unique(of).tolist():
        if (index := shards.get(shard)) is not None:
            here = np.flatnonzero(of == shard)
            found, _, first = index.probe(h[here, 0], h[here, 1])
            at = judged[here]
            drop[at] = found & (first != ids[owner[at]])
    at = 0
    for own in split:
        gone = drop[at : at + len(own)]
        at += len(own)
        n = int(gone.sum())
        yield len(own), n, "\n".join(x for x, out in zip(own, gone) if not out) if n else "\n".join(own)


def dedup_lines(docs: DataFrame, manifest: DataFrame, digests: bool = False) -> DataFrame:
    """The documents with ``text`` cleaned, or per document the counts and the digest of the kept text.

    The manifest has one short row per shard of SHARD_KEYS keys; it goes to the tasks.
    """
    entries = manifest.collect()
    paths, count = {r["shard"]: r["path"] for r in entries}, entries[0]["shards"] if entries else 1
    if digests:
        docs = docs.select("doc_id", "text")
    names, schema = docs.columns, docs.schema
    id_at, text_at = names.index("doc_id"), names.index("text")
    places = [f"c{i}" for i in range(len(names))]  # columns go by their places, so that no name can clash
    docs = docs.toDF(*places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(paths)
        for batch in gathered(batches, text_at, PROBE_BYTES):
            ids, texts = batch.column(id_at).to_pylist(), batch.column(text_at).to_pylist()
            out = list(_clean(list(zip(ids, texts)), shards, count))
            if digests:
                lines, dropped, kept = zip(*out) if out else ((), (), ())
                sha = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in kept]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})
            else:
                # A null text that lost nothing stays null.
                text = pa.array([None if old is None else new for old, (_, _, new) in zip(texts, out)], pa.string())
                columns = [text if i == text_at else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i).with_nullable(True) if i != text_at else pa.field(places[i], pa.string()) for i in range(len(names))]))

    if digests:
        return docs.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return docs.mapInArrow(run, T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(places, schema.fields)])).toDF(*names)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_lines(docs, line_index(docs), digests=True)


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i, string_split(coalesce(text, ''), chr(10))[u.i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) u
), keyed AS (
  SELECT doc_id, i, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), first AS (
  SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.i, k.line, f.first_id IS NOT NULL AND f.first_id <> k.doc_id AS gone
  FROM keyed k LEFT JOIN first f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
