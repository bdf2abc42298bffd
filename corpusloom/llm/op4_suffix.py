"""Operator 4: exact removal of repeated passages by suffix arrays.

Every window of 100 bytes is dealt by its anchor, the 32-byte string in it of
least hash, so equal windows meet wherever they stand.  Windows in a row with
one anchor form a segment.  Documents are first written as slice files in the
shared folder; each later pass reads the slices again and gets what concerns
them as messages, so texts are never shuffled:

1. the distinct anchor hashes of a slice are compared by hash range; a bit each
   comes back for those that other slices have, and the rest is done;
2. segments of repeated anchors go, as anchor, 128-bit content hash and place,
   to their hash range, each content once a slice.  Of equal segments the
   earliest goes on; the others repeat it;
3. where an anchor has several contents, the bytes of the earliest of each are
   fetched from their slice.  Tasks join the segments of their anchors into one
   text and build its suffix array by two-stage sorting: suffixes smaller than
   their successors are sorted directly, the others are induced by scanning the
   buckets of first bytes in order.  Adjacent suffixes with a common prefix of
   100 bytes are equal windows: all but the earliest are removed;
4. a document loses each byte that a removed window covers.

An anchor with more than one suffix array may cover (a short line that stands in
many surroundings) is dealt again: its segments are cut anew by the least string
under another hash, and at last into single windows by the hash of all 100 bytes.
Each is a function of the window alone, so equal windows still meet.  Equal
segments are recognised by 64 + 128 bits of hashes, not by their bytes.

Defined results: a null text is empty and stays null; texts of any length are
read whole (one text is one slice at least); rows without a ``doc_id`` are
neither compared nor changed; rows equal in ``doc_id`` and text are one place and
do not remove each other; rows that share a ``doc_id`` but not a text are
different places, ordered by a hash of the text, and each loses only its own
repeated bytes; an empty table gives no rows; other columns pass through
``remove_repeats`` untouched, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, is_empty, new_dir, read_file, saved, slices, spread, table, write_file

WINDOW = 100
ANCHOR = 32
#: Bytes of text from which on a slice takes no further document.
SLICE_BYTES = 16_000_000
#: Windows and bytes from which on a suffix array takes no further anchor; an anchor with more is dealt again.
BLOCK_WINDOWS = 100_000
BLOCK_BYTES = 1_500_000
#: Further hashes that such anchors are dealt by, before their windows are dealt one by one.
RECUTS = 2
#: Hash ranges for each shuffle partition.
RANGES = 4
_POS_BITS = 21
_CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A segment on its way: anchor, content, place (document, hash of its text, start), its row in the slice, windows.
_ENTRY = np.dtype([("h", "<u8"), ("c0", "<u8"), ("c1", "<u8"), ("doc", "<i8"), ("tie", "<u8"), ("row", "<u4"), ("s", "<u4"), ("n", "<u4")])
#: A segment asked for, and a span of removed bytes.
_ASKED = np.dtype([("h", "<u8"), ("row", "<u4"), ("s", "<u4"), ("n", "<u4")])
_SPAN = np.dtype([("row", "<u4"), ("a", "<u4"), ("b", "<u4")])
#: What a range of contents holds of an anchor, and what becomes of the anchor's segments: compared, or cut anew.
_SUMS = np.dtype([("h", "<u8"), ("contents", "<u8"), ("windows", "<u8")])
_VERDICT = np.dtype([("h", "<u8"), ("verdict", "u1")])
WANTED, CROWDED = 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + _ODD) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(30))


def _anchor_hashes(data: np.ndarray, level: int = 0) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place; every level has its own."""
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        width = 1
        while width < ANCHOR:
            h = (h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width)) + (h[width:] ^ (h[width:] >> np.uint64(29)))
            width *= 2
        h = (h ^ (h >> np.uint64(32))) * _ODD
        h ^= h >> np.uint64(29)
    for _ in range(level):
        h = _mixed(h)
    return h


def segments(data: np.ndarray, offsets: np.ndarray | None = None, window: int = WINDOW, level: int = 0, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of each run of windows with one anchor.

    ``data`` holds the texts one after the other, text i from offsets[i] to
    offsets[i + 1]; no window reaches over its text's end, and inactive texts have none.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    offsets = np.array([0, len(data)]) if offsets is None else offsets
    ends = offsets[1:]
    shut = np.maximum(offsets[:-1], ends - (window - 1))
    if active is not None:
        shut = np.where(active, shut, offsets[:-1])
    low = np.uint64((1 << _POS_BITS) - 1)
    for base in range(0, max(1, len(data) - window + 1), _CHUNK):
        part = data[base : base + _CHUNK + window - 1]
        if len(part) < window:
            break
        h = _anchor_hashes(part, level)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, width = window - ANCHOR + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        size = len(least)
        first, last = np.searchsorted(ends, base, "right"), np.searchsorted(offsets[:-1], base + size, "left")
        edge = np.zeros(size + 1, np.int32)
        np.add.at(edge, np.clip(shut[first:last] - base, 0, size), 1)
        np.add.at(edge, np.clip(ends[first:last] - base, 0, size), -1)
        out = np.cumsum(edge[:-1]) > 0
        cuts = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (out[1:] != out[:-1]))))
        counts = np.diff(np.append(cuts, size))
        cuts, counts = cuts[~out[cuts]], counts[~out[cuts]]
        found.append((h[(least[cuts] & low).astype(np.int64)], base + cuts, counts))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The wanted suffixes of ``text`` (uint8) in the order of their first ``depth`` bytes.

    Two-stage sorting.  A suffix is of type B if it is smaller than its
    successor.  Type-B suffixes are sorted directly; then the buckets of first
    bytes are scanned in order, and each suffix met puts the one before it, if
    that is of type A, at the next place of its own bucket.  Only wanted
    suffixes and those that induce them are placed.
    """
    n = len(text)
    if not len(wanted):
        return wanted
    step = np.sign(np.diff(text.astype(np.int16), append=-1))  # successor minus self; the end is least
    at = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(at[::-1])[::-1]
    type_b = step[decides] > 0
    # From each wanted suffix the chain of type A runs up to the next type B, or the end.
    next_b = np.minimum.accumulate(np.where(type_b, np.arange(n), n)[::-1])[::-1]
    placed = np.zeros(n + 2, np.int32)
    np.add.at(placed, wanted, 1)
    np.add.at(placed, np.minimum(next_b[wanted], n - 1) + 1, -1)
    placed = np.cumsum(placed[:n]) > 0

    direct = np.flatnonzero(placed & type_b)
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    strings = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(strings).view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    bounds = np.searchsorted(text[direct], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    usable = placed & ~type_b

    def induce(found: np.ndarray) -> np.ndarray:
        """Puts the predecessors of these suffixes into their buckets; returns them."""
        before = found[found > 0] - 1
        before = before[usable[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for group in np.split(before, cuts) if len(before) else []:
            induced[text[group[0]]].append(group)
        return before

    out: list[np.ndarray] = []
    if n and usable[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # the last suffix, before the empty one
    for byte in range(256):
        k = 0
        while k < len(induced[byte]):  # grows while suffixes of this bucket induce others of it
            out.append(induced[byte][k])
            induce(induced[byte][k])
            k += 1
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            out.append(own)
            induce(own)
    order = np.concatenate(out)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix with the one before."""
    out = np.zeros(len(order), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(depth, np.uint8))), depth)
    for at in range(1, len(order), 50_000):
        to = min(len(order), at + 50_000)
        differs = view[order[at:to]] != view[order[at - 1 : to - 1]]
        out[at:to] = np.where(differs.any(1), differs.argmax(1), depth)
    return out


def repeated_windows(docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window in it) of every window that equals an earlier one of these segments."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])[:-1]
    segment = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    places = offsets[segment] + inside
    order = suffix_order(text, places, window)
    same = common_prefixes(text, order, window) >= window
    group = np.cumsum(~same)
    index = np.searchsorted(places, order)  # places ascend
    doc, start = docs[segment[index]], starts[segment[index]] + inside[index]
    sort = np.lexsort((start, doc, group))
    group, doc, start, index = group[sort], doc[sort], start[sort], index[sort]
    lead = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
    # A window at the very place of the earliest is that place, seen in a repeated row.
    gone = index[(doc != doc[first]) | (start != start[first])]
    gone.sort()
    return segment[gone], inside[gone]


def _runs(values: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive values within one part."""
    cut = np.flatnonzero((np.diff(values) != 1) | (np.diff(parts) != 0)) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)])) - 1


def write_slices(docs: DataFrame, id_at: int, text_at: int, path: str) -> DataFrame:
    """Writes the rows as slice files; returns their manifest (slice, path).

    A task that runs twice writes other file names; only files in the manifest count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            name, out = f"{path}/slice-{number}-{uuid.uuid4().hex}.arrow", pa.BufferOutputStream()
            with pa.ipc.new_file(out, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                file.write_table(pa.Table.from_batches(held).combine_chunks())
            write_file(name, out.getvalue())
            row = pa.RecordBatch.from_pydict({"slice": [number], "path": [name]})
            held, size, number = [], 0, number + 1
            return row

        for batch in slices(batches, 64):
            held.append(batch)
            size += batch.column(text_at).nbytes
            if size >= SLICE_BYTES:
                yield flush()
        if held:
            yield flush()

    return saved(docs.mapInArrow(run, "slice long, path string"), "op4-manifest")


class _Slice:
    """The rows of a slice file; those that take part: of equal rows one, none without a document id."""

    def __init__(self, path: str, id_at: int, text_at: int):
        self.table = pa.ipc.open_file(pa.BufferReader(read_file(path))).read_all().combine_chunks()
        text = pc.fill_null(self.table.column(text_at), "").cast(pa.large_binary()).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0) if text.num_chunks else pa.array([], pa.large_binary())
        n = len(text)
        self.offsets = np.frombuffer(text.buffers()[1], "<i8", n + 1, 8 * text.offset) if n else np.zeros(1, np.int64)
        body = text.buffers()[2] if n else None
        self.data = np.frombuffer(body, np.uint8)[: self.offsets[-1]] if body is not None and self.offsets[-1] else np.zeros(0, np.uint8)
        self.view = memoryview(self.data)
        ids = self.table.column(id_at).cast(pa.int64()).to_pylist()
        known: dict[tuple[int, int], int] = {}
        self.doc, self.tie, self.owner = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.full(n, -1)
        for i, doc in enumerate(ids):
            if doc is not None:
                tie = xxhash.xxh3_64_intdigest(self.view[self.offsets[i] : self.offsets[i + 1]])
                self.doc[i], self.tie[i], self.owner[i] = doc, tie, known.setdefault((doc, tie), i)
        self.active = self.owner == np.arange(n)

    def _entries(self, h: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(self.view[a:b]) for a, b in zip(at.tolist(), (at + n + window - 1).tolist())])
        out = np.zeros(len(h), _ENTRY)
        out["h"], out["row"], out["s"], out["n"] = h, row, at - self.offsets[row], n
        out["doc"], out["tie"] = self.doc[row], self.tie[row]
        out["c0"], out["c1"] = np.frombuffer(raw, "<u8").reshape(-1, 2).T
        return out

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return segments(self.data, self.offsets, window, 0, self.active)

    def first_entries(self, cut: tuple[np.ndarray, np.ndarray, np.ndarray], of: np.ndarray, window: int) -> np.ndarray:
        """Entries of the segments that ``of`` marks."""
        h, at, n = (x[of] for x in cut)
        return self._entries(h, np.searchsorted(self.offsets, at, "right") - 1, at, n, window)

    def recut(self, asked: np.ndarray, window: int, level: int) -> np.ndarray:
        """Entries of the asked segments, cut anew by the hash of this level, beyond the last into single windows.

        The old anchor goes into the new hash, so that what it has kept apart does not come together.
        """
        if not len(asked):
            return np.zeros(0, _ENTRY)
        row = asked["row"].astype(np.int64)
        at, n = self.offsets[row] + asked["s"], asked["n"].astype(np.int64)
        if level > RECUTS:
            part = np.repeat(np.arange(len(asked)), n)
            starts = at[part] + np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
            out = self._entries(asked["h"][part], row[part], starts, np.ones(len(part), np.int64), window)
            out["h"] = _mixed(out["h"] ^ _mixed(out["c0"]))
            return out
        size = n + window - 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        joined = np.concatenate([self.data[a:b] for a, b in zip(at.tolist(), (at + size).tolist())])
        h, found, count = segments(joined, offsets, window, level)
        part = np.searchsorted(offsets, found, "right") - 1
        return self._entries(_mixed(asked["h"][part] ^ _mixed(h)), row[part], at[part] + found - offsets[part], count, window)


def _earliest(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries by anchor, content and place; which are the first of their content)."""
    entries = entries[np.lexsort([entries[x] for x in ("s", "tie", "doc", "c1", "c0", "h")])]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["h"][1:] != entries["h"][:-1]) | (entries["c0"][1:] != entries["c0"][:-1]) | (entries["c1"][1:] != entries["c1"][:-1])
    return entries, new


def _spans(entries: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(entries), _SPAN)
    out["row"], out["a"], out["b"] = entries["row"], entries["s"], entries["s"] + entries["n"] + (window - 1)
    return out


def _dealt(slice_: int, values: np.ndarray, keys: np.ndarray, ranges: int) -> pa.Table:
    """(range, slice, data): the values by hash range, those of a range in their order."""
    of = (keys % np.uint64(ranges)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    values, of = values[order], of[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(of)])) if len(of) else np.zeros(1, np.int64)
    raw, width = values.tobytes(), values.dtype.itemsize
    data = [raw[width * a : width * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return pa.table({"range": pa.array(of[cuts[:-1]], pa.int32()), "slice": pa.array([slice_] * len(data), pa.int64()), "data": pa.array(data, pa.binary())})


_DEALT = "range int, slice long, data binary"
#: ``of_anchor``: sums, with the anchors' range and the contents' range as slice; else a slice's spans and firsts.
_MET = "of_anchor boolean, range int, slice long, spans binary, data binary"


def _content_keys(entries: np.ndarray) -> np.ndarray:
    return _mixed(entries["c0"] ^ _mixed(entries["h"]))


class _Passes:
    """The passes over the slices of one table."""

    def __init__(self, manifest: DataFrame, id_at: int, text_at: int, window: int):
        self.manifest, self.window = manifest, window
        self.open = lambda own: _Slice(own.column("path")[0].as_py(), id_at, text_at)
        self.ranges = RANGES * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def over(self, messages: DataFrame, run, schema) -> DataFrame:
        """run(slice table, its messages) for every slice.

        The messages are few bytes, the work is not: the number of partitions is given, so that they are not coalesced.
        """
        own, told = spread(self.manifest, "slice"), spread(messages, "slice")
        return own.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(run, schema)

    def shared_anchors(self) -> DataFrame:
        """(slice, range, data): a bit for each distinct anchor of the slice in that range, in order: whether another slice has it."""
        open_, window, ranges = self.open, self.window, self.ranges

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = pa.Table.from_batches([batch.slice(i, 1)])
                    h = np.unique(open_(part).anchors(window)[0])
                    yield from _dealt(part.column("slice")[0].as_py(), h, h, ranges).to_batches()

        def meet(part: pa.Table) -> pa.Table:
            own = [np.frombuffer(x, "<u8") for x in part.column("data").to_pylist()]
            h = np.concatenate(own)
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            shared = np.zeros(len(h), bool)
            shared[order[1:][same]] = shared[order[:-1][same]] = True
            cuts = np.cumsum([len(x) for x in own])[:-1]
            return pa.table({"range": part.column("range"), "slice": part.column("slice"), "data": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary())})

        return spread(self.manifest.select("slice", "path"), "path").mapInArrow(own, _DEALT).groupBy("range").applyInArrow(meet, _DEALT)

    def first_entries(self, shared: DataFrame) -> DataFrame:
        """Entries of the segments whose anchor occurs again, each content once a slice."""
        open_, window, ranges = self.open, self.window, self.ranges

        def run(own: pa.Table, messages: pa.Table) -> pa.Table:
            found = open_(own)
            cut = found.anchors(window)
            distinct, inverse, counts = np.unique(cut[0], return_inverse=True, return_counts=True)
            of = (distinct % np.uint64(ranges)).astype(np.int32)
            again = counts > 1
            by = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[by], np.arange(ranges + 1))
            for number, bits in zip(messages.column("range").to_pylist(), messages.column("data").to_pylist()):
                here = by[starts[number] : starts[number + 1]]
                again[here] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(here)).astype(bool)
            entries, new = _earliest(found.first_entries(cut, again[inverse], window))
            entries = entries[new]
            return _dealt(own.column("slice")[0].as_py(), entries, _content_keys(entries), ranges)

        return self.over(shared, run, _DEALT)

    def recut_entries(self, marks: DataFrame, level: int) -> DataFrame:
        """Entries of the crowded segments, cut anew, each content once a slice."""
        open_, window, ranges = self.open, self.window, self.ranges

        def run(own: pa.Table, messages: pa.Table) -> pa.Table:
            asked = np.frombuffer(b"".join(messages.column("crowded").to_pylist()), _ASKED)
            entries, new = _earliest(open_(own).recut(asked, window, level) if len(asked) else np.zeros(0, _ENTRY))
            entries = entries[new]
            return _dealt(own.column("slice")[0].as_py(), entries, _content_keys(entries), ranges)

        return self.over(marks.where(F.length("crowded") > 0).select("slice", "crowded"), run, _DEALT)

    def resolved(self, entries: DataFrame, crowd: bool) -> DataFrame:
        """(slice, spans, wanted, crowded): what a slice loses as copies; segments to compare, and to cut anew.

        Entries are dealt by content, so an anchor's stand in all ranges.  Each range finds
        its copies and adds up its contents and windows of each anchor; the sums, one small
        row a range and anchor, meet by anchor, and the ranges learn which anchors have
        several contents and which of these are crowded.
        """
        window = self.window
        met = saved(entries.groupBy("range").applyInArrow(self._contents(), _MET), "op4-contents")

        def judge(part: pa.Table) -> pa.Table:
            own = [np.frombuffer(x, _SUMS) for x in part.column("data").to_pylist()]
            sums = np.concatenate(own)
            h, inverse = np.unique(sums["h"], return_inverse=True)
            contents, windows = np.bincount(inverse, sums["contents"]), np.bincount(inverse, sums["windows"])
            size = windows + contents * (window - 1)
            verdict = np.zeros(len(h), np.uint8)
            verdict[contents > 1] = WANTED
            if crowd:
                verdict[(contents > 1) & ((windows > BLOCK_WINDOWS) | (size > BLOCK_BYTES))] = CROWDED
            out = []
            for x in own:
                told = np.zeros(len(x), _VERDICT)
                told["h"], told["verdict"] = x["h"], verdict[np.searchsorted(h, x["h"])]
                out.append(told[told["verdict"] > 0].tobytes())
            return pa.table({"range": part.column("slice").cast(pa.int32()), "slice": part.column("range").cast(pa.int64()), "data": pa.array(out, pa.binary())})

        def mark(own: pa.Table, messages: pa.Table) -> pa.Table:
            told = np.concatenate([np.frombuffer(x, _VERDICT) for x in messages.column("data").to_pylist()] or [np.zeros(0, _VERDICT)])
            told = told[np.argsort(told["h"])]
            wanted, crowded = [], []
            for raw in own.column("data").to_pylist():
                asked = np.frombuffer(raw, _ASKED)
                at = np.minimum(np.searchsorted(told["h"], asked["h"]), max(0, len(told) - 1))
                verdict = np.where(told["h"][at] == asked["h"], told["verdict"][at], 0) if len(told) else np.zeros(len(asked), np.uint8)
                wanted.append(asked[verdict == WANTED].tobytes())
                crowded.append(asked[verdict == CROWDED].tobytes())
            return pa.table({"slice": own.column("slice"), "spans": own.column("spans"), "wanted": pa.array(wanted, pa.binary()), "crowded": pa.array(crowded, pa.binary())})

        sums, found = met.where("of_anchor").select("range", "slice", "data"), met.where("not of_anchor").select("range", "slice", "spans", "data")
        verdicts = sums.groupBy("range").applyInArrow(judge, _DEALT)
        schema = "slice long, spans binary, wanted binary, crowded binary"
        marks = found.groupBy("range").cogroup(verdicts.groupBy("range")).applyInArrow(mark, schema)
        return marks.where("length(spans) + length(wanted) + length(crowded) > 0")

    def _contents(self):
        """Of one range of contents: by slice, the spans of copies and the first of each content; by range of anchors, their sums."""
        window, ranges = self.window, self.ranges

        def run(part: pa.Table) -> pa.Table:
            own = [np.frombuffer(x, _ENTRY) for x in part.column("data").to_pylist()]
            joined = np.concatenate(own)
            slice_ = np.repeat(np.array(part.column("slice").to_pylist(), np.int64), [len(x) for x in own])
            order = np.lexsort([joined[x] for x in ("s", "tie", "doc", "c1", "c0", "h")])
            e, slice_ = joined[order], slice_[order]
            anchor = np.concatenate(([True], e["h"][1:] != e["h"][:-1]))
            new = anchor.copy()
            new[1:] |= (e["c0"][1:] != e["c0"][:-1]) | (e["c1"][1:] != e["c1"][:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
            # An entry at the very place of the first is that place, seen in an equal row.
            same = (e["doc"] == e["doc"][first]) & (e["tie"] == e["tie"][first]) & (e["s"] == e["s"][first])
            group = np.cumsum(anchor) - 1
            sums = np.zeros(int(anchor.sum()), _SUMS)
            sums["h"], sums["contents"], sums["windows"] = e["h"][anchor], np.bincount(group, new), np.bincount(group, np.where(new, e["n"], 0))
            asked = np.zeros(len(e), _ASKED)
            for name in _ASKED.names:
                asked[name] = e[name]
            ids, columns = np.unique(slice_), []
            for values, mask in ((_spans(e, window), ~same), (asked, same)):
                picked, of = values[mask], slice_[mask]
                by = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[by], ids)
                columns.append([x.tobytes() for x in np.split(picked[by], cuts[1:])])
            number = part.column("range")[0].as_py()
            dealt = _dealt(number, sums, sums["h"], ranges)
            kept = pa.table({"of_anchor": pa.array([False] * len(ids)), "range": pa.array([number] * len(ids), pa.int32()), "slice": ids, "spans": pa.array(columns[0], pa.binary()), "data": pa.array(columns[1], pa.binary())})
            summed = pa.table({"of_anchor": pa.array([True] * dealt.num_rows), "range": dealt.column("range"), "slice": dealt.column("slice"), "spans": pa.nulls(dealt.num_rows, pa.binary()), "data": dealt.column("data")})
            return pa.concat_tables([kept, summed])

        return run

    def compared(self, marks: DataFrame) -> DataFrame:
        """(slice, spans): spans of windows that equal an earlier one, anchor by anchor, through suffix arrays."""
        open_, window = self.open, self.window

        def fetch(own: pa.Table, messages: pa.Table) -> pa.Table:
            wanted = np.frombuffer(b"".join(messages.column("wanted").to_pylist()), _ASKED)
            if not len(wanted):
                return pa.table({n: pa.array([], k) for n, k in zip(("h", "doc", "tie", "slice", "row", "s", "n", "data"), (*[pa.int64()] * 7, pa.binary()))})
            found = open_(own)
            row = wanted["row"].astype(np.int64)
            at = found.offsets[row] + wanted["s"]
            data = [found.view[a:b].tobytes() for a, b in zip(at.tolist(), (at + wanted["n"] + (window - 1)).tolist())]
            return pa.table({
                "h": np.ascontiguousarray(wanted["h"]).view("<i8"), "doc": found.doc[row], "tie": found.tie[row].view("<i8"), "slice": np.full(len(row), own.column("slice")[0].as_py()),
                "row": row, "s": wanted["s"].astype(np.int64), "n": wanted["n"].astype(np.int64), "data": pa.array(data, pa.binary()),
            })

        parts = self.over(marks.where(F.length("wanted") > 0).select("slice", "wanted"), fetch, "h long, doc long, tie long, slice long, row long, s long, n long, data binary")
        partitions = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = parts.repartition(partitions, "h").sortWithinPartitions("h")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            windows = size = 0

            def compare() -> Iterator[pa.RecordBatch]:
                _, doc, tie, slice_, row, start, count = (np.array(x, np.int64) for x in list(zip(*held))[:7])
                # Documents by number in the order of (doc_id, hash of the text).
                order = np.lexsort((tie.view(np.uint64), doc))
                place = np.empty(len(doc), np.int64)
                place[order] = np.cumsum(np.concatenate(([0], (doc[order][1:] != doc[order][:-1]) | (tie[order][1:] != tie[order][:-1]))))
                segment, inside = repeated_windows(place, start, count, [x[7] for x in held], window)
                if not len(segment):
                    return
                first, last = _runs(inside, segment)
                out = np.zeros(len(first), _SPAN)
                own = segment[first]
                out["row"], out["a"], out["b"] = row[own], start[own] + inside[first], start[own] + inside[last] + window
                for number in np.unique(slice_[own]).tolist():
                    yield pa.RecordBatch.from_pydict({"slice": [number], "spans": [out[slice_[own] == number].tobytes()]})

            for batch in slices(batches, 4096):
                for item in zip(*[x.to_pylist() for x in batch.columns]):
                    if held and (windows >= BLOCK_WINDOWS or size >= BLOCK_BYTES) and item[0] != held[-1][0]:
                        yield from compare()
                        held, windows, size = [], 0, 0
                    held.append(item)
                    windows, size = windows + item[6], size + len(item[7])
            if held:
                yield from compare()

        return dealt.mapInArrow(run, "slice long, spans binary")

    def cut_out(self, messages: DataFrame, schema, write) -> DataFrame:
        """write(slice, bytes kept, bytes removed and runs of each row) for every slice, after (level, spans, crowded) messages."""
        open_, window = self.open, self.window

        def run(own: pa.Table, told: pa.Table) -> pa.Table:
            found = open_(own)
            spans = [np.frombuffer(x, _SPAN) for x in told.column("spans").to_pylist() if x]
            # Copies within the slice were not sent: they are found again, level by level.
            cut = found.anchors(window)
            _, inverse, counts = np.unique(cut[0], return_inverse=True, return_counts=True)
            levels = [found.first_entries(cut, (counts > 1)[inverse], window)]
            crowded: dict[int, list[bytes]] = {}
            for level, asked in zip(told.column("level").to_pylist(), told.column("crowded").to_pylist()):
                if asked:
                    crowded.setdefault(level, []).append(asked)
            levels += [found.recut(np.frombuffer(b"".join(x), _ASKED), window, level) for level, x in crowded.items()]
            for entries in levels:
                entries, new = _earliest(entries)
                spans.append(_spans(entries[~new], window))
            spans = np.concatenate(spans)
            spans = spans[np.argsort(spans["row"], kind="stable")]
            bounds = np.searchsorted(spans["row"], np.arange(len(found.owner) + 1))
            out = []
            for i, owner in enumerate(found.owner.tolist()):
                data = found.view[found.offsets[i] : found.offsets[i + 1]]
                mine = spans[bounds[owner] : bounds[owner + 1]] if owner >= 0 else spans[:0]
                out.append(_kept(data, mine["a"], mine["b"]))
            return write(found.table, out)

        return self.over(messages, run, schema)


def _kept(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    if not len(starts):
        return bytes(data), 0, 0
    order = np.argsort(starts, kind="stable")
    a, b = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
    fresh = np.concatenate(([True], a[1:] > b[:-1]))
    a, b = a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]
    kept = [data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)])]
    return b"".join(kept), int((b - a).sum()), len(a)


def remove_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """The documents without repeated passages, or per document the counts and the digest of what is kept.

    Cutting bytes may cut a character; such remains are dropped from cleaned texts.
    """
    if digests:
        docs = docs.select("doc_id", "text")
    names, schema = docs.columns, docs.schema
    id_at, text_at, width = names.index("doc_id"), names.index("text"), len(names)
    places = [f"c{i}" for i in range(width)]  # columns go by their places, so that no name can clash
    manifest = write_slices(docs.toDF(*places), id_at, text_at, new_dir(docs.sparkSession, "op4-slices"))
    passes = _Passes(manifest, id_at, text_at, window)
    shared = saved(passes.shared_anchors(), "op4-anchors")
    entries, told = passes.first_entries(shared), []
    for level in range(1, RECUTS + 3):
        # Single windows that share their hash are a few clashes, never crowded.
        marks = saved(passes.resolved(entries, crowd=level < RECUTS + 2), "op4-marks")
        told += [marks.select("slice", F.lit(level).alias("level"), "spans", "crowded")]
        found = saved(passes.compared(marks), "op4-spans")
        told += [found.select("slice", F.lit(0).alias("level"), "spans", F.lit(None).cast("binary").alias("crowded"))]
        if is_empty(marks.where(F.length("crowded") > 0)):
            break
        entries = passes.recut_entries(marks, level)
    discard(shared)
    messages = functools.reduce(DataFrame.unionByName, told)

    def digest(own: pa.Table, out: list[tuple[bytes, int, int]]) -> pa.Table:
        return pa.table({
            "doc_id": own.column(id_at).cast(pa.int64()), "n_bytes": pa.array([len(k) + r for k, r, _ in out], pa.int64()), "n_removed": pa.array([r for _, r, _ in out], pa.int64()),
            "n_spans": pa.array([s for _, _, s in out], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in out], pa.string()),
        })

    def clean(own: pa.Table, out: list[tuple[bytes, int, int]]) -> pa.Table:
        null = own.column(text_at).is_null().to_pylist()
        cleaned = pa.array([None if gone else k.decode("utf-8", "ignore") for gone, (k, _, _) in zip(null, out)], pa.string())
        return own.set_column(text_at, own.schema.field(text_at).with_type(pa.string()).with_nullable(True), cleaned)

    if digests:
        return passes.cut_out(messages, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
    whole = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(places, schema.fields)])
    return passes.cut_out(messages, whole, clean).toDF(*names)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
