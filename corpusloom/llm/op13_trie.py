"""Operator 13: prefix trie of conversations.

A conversation's prefixes get chained digests: a prefix's SHA-256 is of the digest
before it and the next turn, so equal digests are equal prefixes.  Every prefix is one
row; grouped by (depth, digest) they are the nodes of the trie, and the smallest
conversation of a node names it.  Every conversation so owns a chain of nodes, the
lower end of its own path, and what lies above the chain are parts of other chains.
Subtree sums explode each chain's sums to all chains above it, at the node where its
path leaves them, and run up the nodes of each chain; a path has at most as many
chains as turns, so this is linear in the turns, however long conversations are.

Turns go through one shuffle, and a task keeps one digest of a conversation
at a time.  Nodes that many conversations share are partial counts in the grouping and
are broadcast when prefixes learn their nodes; the conversations that end at one
node are dealt by range, and only their written-out ids, in blocks, meet again.

Defined results: turns without ``conv_id`` belong to no conversation; null turns
come first, equal turns go by role and text; null roles and texts are empty; repeated
rows are turns of their own; a conversation that is left without turns ends at the
root; texts of any length are read whole; an empty table has no nodes, not even the
root; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bytes_sql, crc32_sql, joined_by_share, saved, slices, spread, table

ROOT = hashlib.sha256(b"").digest()
#: Conversations whose numbers start with the same hundreds share their first turns.
GROUP = 100
#: First turns that a rebuilt conversation takes over: fewer than this.
SHARED_TURNS = 6
#: Bytes of written-out ids in a block.
ENDS_BYTES = 1 << 14


def chained(before: bytes, role: str, text: str) -> bytes:
    """Digest of the prefix that one turn makes of the prefix with digest ``before``."""
    role_bytes = role.encode("utf-8")
    return hashlib.sha256(before + len(role_bytes).to_bytes(8, "little") + role_bytes + text.encode("utf-8")).digest()


def _turns(conversations: DataFrame) -> DataFrame:
    empty = F.lit("")
    return conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))


def first_digests(turns: DataFrame, shared: int) -> DataFrame:
    """base, chain: (digest, code points of the text) of the prefixes of its first turns, for each conversation that heads a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for base, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                digest, chain = ROOT, []
                for x in first:
                    digest = chained(digest, x["role"], x["text"])
                    chain.append({"digest": digest, "chars": len(x["text"])})
                rows.append((base, chain))
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], kind)], ["base", "chain"])

    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    first = turns.where(F.col("conv_id") % GROUP == 0).withColumn("_at", F.row_number().over(order)).where(F.col("_at") < shared)
    held = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))).alias("first"))
    return held.mapInArrow(run, "base long, chain array<struct<digest: binary, chars: long>>")


def shared_turns(conv_id: Column, shared: int = SHARED_TURNS) -> Column:
    """How many first turns a conversation takes from the head of its group."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(shared)).cast("int")


def takeovers(conversations: DataFrame, shared: int = SHARED_TURNS) -> DataFrame:
    """conv_id, skip, chain: every conversation that leaves out its first ``skip`` turns, and the prefixes it has instead."""
    turns = _turns(conversations)
    heads = first_digests(turns, shared)
    skip, base = shared_turns(F.col("conv_id"), shared), (F.col("conv_id") - F.col("conv_id") % GROUP)
    every = turns.select("conv_id").distinct().select("conv_id", skip.alias("skip"), base.alias("base")).where("skip > 0")
    return every.join(heads, "base", "left").select("conv_id", "skip", F.slice("chain", F.lit(1), F.col("skip")).alias("chain"))


def prefixes(conversations: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """conv_id, depth, digest, chars (code points of the last text), last: every prefix of every conversation, from the root down.

    ``starts`` (as of ``takeovers``) gives some conversations other first turns.
    """
    chain = "array<struct<digest: binary, chars: long>>"
    turns = _turns(conversations).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("int").alias("skip"), F.lit(None).cast(chain).alias("chain"))
    if starts is not None:
        turns = turns.unionByName(starts.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = spread(turns, "conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the prefixes not yet given; the last one may be its conversation's last
        conv_id, skip, seen = None, 0, 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
            columns = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["conv_id", "depth", "digest", "chars", "last"])

        def begin() -> None:
            if held:
                held[-1] = (*held[-1][:4], True)
            held.append((conv_id, 0, ROOT, 0, False))

        for batch in slices(batches, 1024):
            for own, kind, _, role, text, left_out, chain_ in zip(*[c.to_pylist() for c in batch.columns]):
                if own != conv_id:
                    conv_id, skip, seen = own, 0, 0
                    begin()
                if kind == 0:
                    skip = left_out
                    for x in chain_ or ():
                        held.append((conv_id, held[-1][1] + 1, x["digest"], x["chars"], False))
                    continue
                seen += 1
                if seen > skip:
                    held.append((conv_id, held[-1][1] + 1, chained(held[-1][2], role, text), len(text), False))
            yield batch_of(held[:-1])
            del held[:-1]
        if held:
            yield batch_of([(*held[-1][:4], True)])

    return ordered.mapInArrow(run, "conv_id long, depth long, digest binary, chars long, last boolean")


def _ends(owned: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end; ``owned`` has owner, depth and conv_id of those."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, parts, size, out = None, None, [], 0, []
        for batch in batches:
            for owner, depth, conv_id in zip(*[c.to_pylist() for c in batch.columns]):
                if (owner, depth) != node or size >= ENDS_BYTES:
                    if node is not None:
                        out.append((*node, first, ",".join(parts)))
                    node, first, parts, size = (owner, depth), conv_id, [], 0
                parts.append(str(conv_id))
                size += len(parts[-1]) + 1
            yield rows(out)
            out = []
        if node is not None:
            yield rows([(*node, first, ",".join(parts))])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], ["owner", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for owner, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (owner, depth) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield done(out)
        if node is not None:
            yield done([(*node, sha.hexdigest())])

    def done(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64(), pa.int64(), pa.string()])], ["conv_id", "depth", "ends_sha256"])

    n = int(owned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = owned.select("owner", "depth", "conv_id").repartitionByRange(n, "owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id")
    blocks = ranged.mapInArrow(write, "owner long, depth long, first long, ids string")
    return spread(blocks, "owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """The nodes of ``prefixes`` (a saved table): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = saved(found.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "op13-nodes")
    # Prefixes that no other conversation has are their conversation's own.
    shared = nodes.where("n_convs > 1").select("digest", "owner", "n_convs")
    owned = joined_by_share(found.select("conv_id", "depth", "digest", "last"), shared, "digest", "n_convs", found.count())
    owned = saved(owned.select("conv_id", "depth", F.coalesce("owner", "conv_id").alias("owner"), "last"), "op13-owned")

    path = W.partitionBy("conv_id")
    foreign = F.col("owner") != F.col("conv_id")
    left_at = owned.groupBy("conv_id", "owner").agg(F.max("depth").alias("at"))
    left_at = left_at.withColumn("_owns", F.max(~foreign).over(path)).withColumn("_top", F.max(F.when(foreign, F.col("at"))).over(path))
    # Chains above each chain, and where its path leaves them.
    above = saved(left_at.where(F.col("_owns") & foreign).select("conv_id", F.col("owner").alias("above"), "at", (F.col("at") == F.col("_top")).alias("direct")), "op13-above")

    key, up = ["conv_id", "depth"], W.partitionBy("conv_id").orderBy(F.desc("depth"))
    rows = nodes.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "chars")
    direct = above.where("direct")
    rows = rows.unionByName(direct.select(F.col("above").alias("conv_id"), F.col("at").alias("depth"), F.lit(1).alias("attached")), allowMissingColumns=True)
    rows = rows.unionByName(direct.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("above").alias("parent")), allowMissingColumns=True)
    filled = rows.groupBy(*key).agg(F.max("n_convs").alias("n_convs"), F.max("chars").alias("chars"), F.coalesce(F.sum("attached"), F.lit(0)).alias("attached"), F.max("parent").alias("parent"))
    goes_on = F.lag("depth").over(up).isNotNull().cast("long")
    filled = filled.withColumn("n_children", F.col("attached") + goes_on)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    filled = saved(filled.select(*key, "n_convs", "n_children", parent.alias("parent_conv_id"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "op13-filled")

    totals = filled.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    posted = above.join(totals, "conv_id").select(F.col("above").alias("conv_id"), F.col("at").alias("depth"), "leaves", "saved")
    every = filled.unionByName(posted, allowMissingColumns=True).unionByName(_ends(owned.where("last")), allowMissingColumns=True)
    one = every.groupBy(*key).agg(*[F.max(x).alias(x) for x in ("n_convs", "n_children", "parent_conv_id", "ends_sha256")], *[F.sum(x).alias(x) for x in ("leaves", "saved")])
    running = up.rowsBetween(W.unboundedPreceding, W.currentRow)
    return one.select(
        *key, "parent_conv_id", "n_convs", "n_children", F.sum("leaves").over(running).alias("n_leaves"), F.sum("saved").over(running).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return prefix_trie(saved(prefixes(conversations, takeovers(conversations)), "op13-prefixes"))


SQL = f"""WITH t AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {crc32_sql(bytes_sql("CAST(conv_id AS VARCHAR)"))} % {SHARED_TURNS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, rn, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % {GROUP} AND rn <= h
  UNION ALL SELECT c.conv_id, 1, rn, role, text FROM c JOIN t USING (conv_id) WHERE rn > h),
p AS (SELECT c.conv_id, coalesce(turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, rn) AS turns FROM r GROUP BY conv_id) USING (conv_id)),
x AS MATERIALIZED (SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS last FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS depth FROM p)),
n AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id)), sha256('')) AS ends_sha256 FROM x GROUP BY path, depth),
k AS MATERIALIZED (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, depth)),
u AS (SELECT path[1:up] AS path, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(coalesce((n_convs - 1) * length(path[depth].text), 0)) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u USING (path, depth) LEFT JOIN n o ON m.depth > 0 AND o.depth = m.depth - 1 AND o.path = m.path[1:m.depth - 1]"""
