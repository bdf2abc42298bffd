"""Operator 2: near-duplicate groups by fast similarity sketching.

Each document's distinct word shingles fill a sketch in rounds: in round i every
element is thrown into one hashed bin with value i + hash, so early rounds win,
and after t throwing rounds bin i - t takes the least element of round i; every
coordinate is filled and estimates concentrate as for independent coordinates.
Documents with equal shingle sets (128-bit marks of the sets) are one class with
one representative.  Bands of the sketch give buckets of representatives, and
links are confirmed on the full sets, in two passes:

1. each bucket's members are compared with its hub, the member that shares most
   buckets with others; a document takes the greatest hub that it is linked with
   as its label, so documents of one label are connected;
2. in buckets that still hold several labels, the members outside the bucket's
   main label are compared with all its members.  A task takes a block of those
   against a block of members and counts all overlaps by one product of
   incidence matrices; it returns at most the links that join two labels.

No bucket is expanded into pairs, and no pair of a bucket whose members are in
one component or compared is left out, so no link between components is missed.

With 40 bands of 6 a pair of similarity 0.8 shares no bucket with probability
5e-6, one of 0.85 with probability 6e-9; that is the operator's only loss.

Defined results: null and empty texts have empty sets and are linked with nothing;
texts of any length count whole; a similarity of exactly the limit links; rows
without a ``doc_id`` take no part, keep a null component and are kept; rows that
share a ``doc_id`` are one vertex with several sets; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, is_empty, joined_by_share, saved, slices, table
from .components import components

SHINGLE_WORDS = 4
SIMILARITY_PERCENT = 80
BANDS, BAND_ROWS = 40, 6
#: Pairs of a hub that one copy of its set serves.
HUB_PAIRS = 1024
#: Members and shingles of a block that one task compares with another.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 20
#: Cells of an incidence matrix that are held at a time.
_CELLS = 1 << 22
#: Word hashes that a task keeps.
KEPT_WORDS = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    bytes.lower() and bytes.split() know only A-Z and the six ASCII white-space
    characters, as the definition of a word wants.
    """
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, size)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out = _mix(out * _FACTORS[i % 8] + h[i : n - width + 1 + i])
    return np.unique(out)


def sketch(items: np.ndarray, bins: int = BANDS * BAND_ROWS) -> np.ndarray:
    """Fast similarity sketch: round number above 32 hash bits, for every bin."""
    out = np.full(bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    step = max(1, 2048 // max(1, len(items)))
    low = np.uint64(0xFFFFFFFF)
    for start in range(0, bins, step):
        rounds = np.arange(start, min(start + step, bins), dtype=np.uint64)
        z = _mix(items[None, :] + (rounds * _FACTORS[0] + _FACTORS[1])[:, None])
        value = (z & low) | (rounds << np.uint64(32))[:, None]
        np.minimum.at(out, ((z >> np.uint64(32)) % np.uint64(bins)).astype(np.int64).ravel(), value.ravel())
        if out.max() != np.uint64(0xFFFFFFFFFFFFFFFF):
            return out
    for b in np.flatnonzero(out == np.uint64(0xFFFFFFFFFFFFFFFF)).tolist():
        number = np.uint64(bins + b)
        out[b] = (_mix(items + (number * _FACTORS[0] + _FACTORS[1])) & low).min() | (number << np.uint64(32))
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = values.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64) * _FACTORS[2]
    for i in range(rows.shape[1]):
        out = _mix(out * _FACTORS[3] + rows[:, i])
    return out


def sketches(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit mark of the set (s1, s2) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = [shingle_set(x, words) for x in batch.column(1).to_pylist()]
                keys = [band_keys(sketch(x)) if len(x) else np.zeros(0, np.uint64) for x in sets]
                s1 = np.array([_mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
                s2 = np.array([np.bitwise_xor.reduce(_mix(x + _FACTORS[4])) for x in sets], np.uint64)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).cast(pa.int64()), "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                    "s1": pa.array(s1.view(np.int64)), "s2": pa.array(s2.view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(doc, items) of the wanted documents: sorted 64-bit hashes, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = [shingle_set(x, words).tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc": batch.column(0).cast(pa.int64()), "items": pa.array(sets, pa.binary())})

    texts = docs.select("doc_id", "text").join(wanted.select(F.col("doc").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    return texts.mapInArrow(run, "doc long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ra, rb) whose full sets are similar enough, in any of a document's sets.

    b is a hub and rb bounds its pairs: they are salted, about HUB_PAIRS of them meet one copy of the hub's set.
    """
    salts = F.ceil(F.col("rb") / HUB_PAIRS).cast("int")
    hubs = pairs.select("b", "rb").distinct().join(sets.select(F.col("doc").alias("b"), F.col("items").alias("_y")).hint("merge"), "b")
    right = hubs.select("b", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), "_y")
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("_x"))
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                linked.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select(range(len(names))).filter(pa.array(linked, pa.bool_()))

    fields = pairs.schema
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("a"), salts).cast("int"))
    return salted.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "_salt"]).select(*names, "_x", "_y").mapInArrow(run, fields)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as a product of incidence matrices."""
    sizes = [len(x) for x in (*left, *right)]
    _, column, counts = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1  # what only one set holds is in no intersection
    held = (counts > 1)[column]
    row, column = np.repeat(np.arange(len(sizes)), sizes)[held], number[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    width, total = max(64, _CELLS // len(sizes)), int(number[-1]) + 1 if len(number) else 0
    for at in range(0, total, width):
        low, high = np.searchsorted(column, (at, at + width))
        ones = np.zeros((len(sizes), min(width, total - at)), np.float32)
        ones[row[low:high], column[low:high] - at] = 1
        out += ones[: len(left)] @ ones[len(left) :].T
    return out.astype(np.int64)


def _joining_links(asked: list[tuple], members: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between the asked rows and the members, rows (doc, label, set), that join different labels."""
    both = overlaps([x[2] for x in asked], [x[2] for x in members])
    total = np.array([len(x[2]) for x in asked])[:, None] + np.array([len(x[2]) for x in members])[None, :]
    linked = 100 * both >= percent * (total - both)
    names, label = np.unique(np.array([x[1] for x in (*asked, *members)], np.int64), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, row in enumerate(linked):
        near = np.flatnonzero(row)
        _, first = np.unique(label[len(asked) + near], return_index=True)
        for j in near[first].tolist():
            x, y = root(label[i]), root(label[len(asked) + j])
            if x != y:
                parent[x] = y
                yield asked[i][0], members[j][0]


def _open_cells(members: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, doc, label, asked, member): what buckets of several labels still have to compare, in blocks.

    Block i of the members outside the main label meets block j of all members.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("rb").alias("r"), (-F.col("b")).alias("m")), F.struct(F.col("b").alias("doc"), F.col("ra").alias("r"), (-F.col("a")).alias("m")))).alias("e"))
    hubs = ends.groupBy("e.doc").agg(F.max(F.struct("e.r", "e.m")).alias("hub"))
    own = F.struct(F.col("reach").alias("r"), (-F.col("doc")).alias("m"))
    labelled = members.join(hubs, "doc", "left").withColumn("label", -F.greatest(own, "hub")["m"])
    total = members.count()
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("all_c"), F.sum("n").alias("all_n")).where("k > 1").drop("k")
    # A bucket that holds many of the members is broadcast with its figures.
    live = joined_by_share(labelled, mixed, "key", "all_c", total).where("all_c is not null").withColumn("out", F.col("label") != F.col("main"))
    limits = live.where("out").groupBy("key").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("out_c"), F.sum("n").alias("out_n"), F.max("all_c").alias("held"))
    blocks = lambda c, n: F.ceil(F.greatest(F.col(c) / BLOCK_MEMBERS, F.col(n) / BLOCK_SHINGLES)).cast("int")
    # A member of another size than any outside the main label has no partner.
    able = joined_by_share(live, limits, "key", "held", total).where((100 * F.col("n") >= percent * F.col("least")) & (percent * F.col("n") <= 100 * F.col("most")))
    able = able.withColumns({"bi": blocks("out_c", "out_n"), "bj": blocks("all_c", "all_n")})
    able = able.withColumns({"qi": F.pmod(F.xxhash64("doc", F.lit(1)), "bi").cast("int"), "qj": F.pmod(F.xxhash64("doc", F.lit(2)), "bj").cast("int")})
    as_member = F.transform(F.sequence(F.lit(0), F.col("bi") - 1), lambda i: F.struct(i.alias("i"), F.col("qj").alias("j")))
    as_asked = F.transform(F.sequence(F.lit(0), F.col("bj") - 1), lambda j: F.struct(F.col("qi").alias("i"), j.alias("j")))
    cells = F.when(F.col("out"), F.array_union(as_member, as_asked)).otherwise(as_member)
    rows = able.select("key", "doc", "label", "out", "qi", "qj", F.inline(cells))
    return rows.select("key", "i", "j", "doc", "label", (F.col("out") & (F.col("i") == F.col("qi"))).alias("asked"), (F.col("j") == F.col("qj")).alias("member"))


def _compared(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join labels, cell by cell."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.join(sets.hint("merge"), "doc").select("key", "i", "j", "doc", "label", "asked", "member", "items")
    dealt = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def found() -> list[tuple[int, int]]:
            asked, members = [x for x, q, _ in held if q], [x for x, _, m in held if m]
            return list(_joining_links(asked, members, percent)) if asked and members else []

        for batch in slices(batches, 512):
            links: list[tuple[int, int]] = []
            for key, i, j, doc, label, asked, member, items in zip(*[x.to_pylist() for x in batch.columns]):
                if (key, i, j) != now:
                    links += found()
                    held, now = [], (key, i, j)
                held.append(((doc, label, np.frombuffer(items, np.uint64)), asked, member))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
        if links := found():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, reps: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame | None:
    """Confirmed links (a, b) between representatives that join all linked ones, as a saved table.

    ``reps`` has (rep, n_shingles, bands).  None: no bucket has two members.
    """
    buckets = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("doc"), F.col("n_shingles").alias("n"))
    several = buckets.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    # These tables grow with the corpus: merged at every size, never broadcast.
    rest = saved(buckets.join(several.hint("merge"), "key").distinct(), "op2-buckets")
    if is_empty(rest):
        discard(rest)
        return None
    sets = saved(_full_sets(docs, rest.select("doc").distinct(), words), "op2-sets")
    reach = rest.groupBy("doc").agg(F.sum("k").alias("reach"))
    members = saved(rest.join(reach, "doc").drop("k"), "op2-members")
    hubs = members.groupBy("key").agg(F.max(F.struct("reach", (-F.col("doc")).alias("m"), "n")).alias("h"), F.count("*").alias("held"))
    hubs = hubs.select("key", (-F.col("h.m")).alias("hub"), F.col("h.reach").alias("hub_reach"), F.col("h.n").alias("hub_n"), "held")
    met = joined_by_share(members, hubs, "key", "held", members.count()).where((F.col("doc") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
    pairs = met.select(F.col("doc").alias("a"), F.col("hub").alias("b"), F.col("reach").alias("ra"), F.col("hub_reach").alias("rb")).distinct()
    first = saved(_confirmed(pairs, sets, percent), "op2-links")
    second = _compared(_open_cells(members, first, percent), sets, percent)
    links = saved(first.select("a", "b").unionByName(second), "op2-links")
    discard(rest, sets, members, first)
    return links


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    found = saved(sketches(docs, words), "op2-sketches")
    part = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    marks = ["n_shingles", "s1", "s2"]
    reps = saved(part.groupBy(*marks).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "op2-classes")
    mark = F.concat_ws("-", *marks).cast("binary").alias("mark")
    copied = reps.where(F.col("rep") < F.col("last")).select(mark, "rep", "copies")
    links = near_links(docs, reps.select("rep", "n_shingles", "bands"), words, percent)
    total = found.count()
    rows = joined_by_share(found.select("doc_id", "n_shingles", mark), copied, "mark", "copies", total)
    rows = rows.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))).drop("copies")
    labels = None
    if links is not None:
        labels = components(links, "op2-components")
        by_rep = labels.join(reps.select(F.col("rep").alias("vertex"), "copies").hint("merge"), "vertex").groupBy(F.col("vertex").alias("rep")).agg(F.max("component").alias("component"), F.sum("copies").alias("copies"))
        rows = joined_by_share(rows, by_rep, "rep", "copies", total)
    else:
        rows = rows.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep")
    out = saved(rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "op2-result")
    discard(found, reps, links, labels)
    return out


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), meets AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM meets JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN sides l ON l.a = r.b
)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a
"""
