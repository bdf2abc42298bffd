"""Operator 9: exact top-k inner-product search through ball trees.

Equal vectors are one class, of which only the least ids can be among the best.
Vectors are dealt to shards by the nearest of at most CLUSTERS pivots and, where
a pivot has many, by a hash; each shard becomes one ball tree in a file of the
shared folder.  The search takes two passes over the distinct query vectors:

1. each query is searched in a shard of its own cluster, which gives it a kth score;
2. that score goes along to every other shard whose root's upper bound
   ``q . centre + |q| * radius`` is not below it, and to no other.

Inside a tree, nodes come off a priority queue by their upper bound; the search
ends when the bound is below the kth score so far.  What is shuffled are
vectors once, queries once per shard that may hold an answer, and answers.

Defined results: vectors that are null, empty, of another length than the most
common one (the shortest of those), or that hold a null or non-finite component,
take no part, as do rows without an id; a component of a magnitude at which a
score could leave 63 bits is an error; equal scores go to the smaller id; rows that
share an id are separate candidates, and a query never meets rows of its own id;
repeated query rows are one query, and an id with several query vectors asks with
each and ranks all answers together; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_KEYS, blocks_for, is_empty, new_dir, read_file, saved, slices, spread, table, write_file

TOP_K = 5
SCALE = 256
#: Vectors in a shard at most, on average; vectors in a leaf.
SHARD_VECTORS = 8_000
#: Queries of a shard that one group answers, about.
QUERY_BLOCK = 20_000
#: Shards that a query has asked after each wave but the last.
WAVES = (2, 8)
LEAF_VECTORS = 64
#: Pivots at most, taken from the rows of least hash.
CLUSTERS = 256


class BallTree:
    """A ball tree over integer vectors, sorted by leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, times: np.ndarray, leaf: int = LEAF_VECTORS):
        """vectors: int64, one row each; times: how often each row stands in the table."""
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # from, to, left child, right child (-1: leaf)
        centres, radii = [], []

        def add(low: int, high: int) -> int:
            own = vectors[order[low:high]].astype(np.float64)
            centre = own.mean(0)
            far = np.sqrt(((own - centre) ** 2).sum(1))
            number = len(self.nodes)
            self.nodes.append((low, high, -1, -1))
            centres.append(centre)
            radii.append(float(far.max()))
            return number

        stack = [add(0, len(ids))] if len(ids) else []
        while stack:
            number = stack.pop()
            low, high, _, _ = self.nodes[number]
            if high - low <= leaf or radii[number] == 0.0:
                continue  # equal vectors stay in one leaf, however many
            own = vectors[order[low:high]].astype(np.float64)
            a = own[np.argmax(((own - centres[number]) ** 2).sum(1))]
            b = own[np.argmax(((own - a) ** 2).sum(1))]
            side = own @ (b - a)
            middle = (high - low) // 2
            split = np.argsort(side, kind="stable")
            if side[split[0]] == side[split[-1]]:
                continue
            order[low:high] = order[low:high][split]
            left, right = add(low, low + middle), add(low + middle, high)
            self.nodes[number] = (low, high, left, right)
            stack += [left, right]
        self.ids, self.vectors, self.times = ids[order], vectors[order], times[order]
        self.centres = np.array(centres).reshape(len(centres), vectors.shape[1])
        self.radii = np.array(radii)

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> list[list[tuple[int, int, int]]]:
        """For each query its k best (score, -id, times), or fewer if the others score below the query's floor; never its own id."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in queries]
        if not self.nodes:
            return out
        bounds = root_bounds(queries, self.centres, self.radii)
        for row, (query, own_id, floor, heap) in enumerate(zip(queries, own.tolist(), floors.tolist(), out)):
            bound = bounds[row]
            queue = [(-bound[0], 0)]
            while queue:
                upper, number = heapq.heappop(queue)
                limit = floor if len(heap) < k else max(floor, heap[0][0])
                if -upper < limit:
                    break
                low, high, left, right = self.nodes[number]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= limit:
                            heapq.heappush(queue, (-bound[child], child))
                    continue
                scores, ids = self.vectors[low:high] @ query, self.ids[low:high]
                near = np.flatnonzero((scores >= limit) & (ids != own_id))
                if len(near) > 4 * k:  # only the best k of them can enter
                    near = near[np.lexsort((ids[near], -scores[near]))][:k]
                for i in near.tolist():
                    found = (int(scores[i]), -int(ids[i]), int(self.times[low + i]))
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)
        return out


def root_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of each query's scores in each ball; a slack over rounding errors keeps them upper bounds."""
    q = queries.astype(np.float64)
    norms = np.sqrt((q * q).sum(1))
    bounds = q @ centres.T + norms[:, None] * radii[None, :]
    return bounds + 1e-9 * (np.abs(bounds) + norms[:, None] * (radii + np.sqrt((centres**2).sum(1)))[None, :]) + 1e-6


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _arrays(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dimension)


def _packed(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            packed = [np.array(x, "<i8").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["vec_id", "p", "asks"])

    return vectors.mapInArrow(run, "vec_id long, p binary, asks boolean")


def _clustered(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot of the vector p."""
    dimension, half, names = pivots.shape[1], (pivots**2).sum(1) / 2, rows.columns
    at = names.index("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            near = (_arrays(batch.column(at), dimension) @ pivots.T - half).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*names, "cluster"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType())]))


def build_trees(rows: DataFrame, dimension: int) -> DataFrame:
    """Manifest of the ball trees of (cluster, shard, vec_id, p, m): cluster, shard, path, centre, radius."""
    folder = new_dir(rows.sparkSession, "op9-trees")

    def build(part: pa.Table) -> pa.Table:
        tree = BallTree(part.column("vec_id").to_numpy(), _arrays(part.column("p"), dimension), part.column("m").to_numpy())
        name = f"{folder}/tree-{uuid.uuid4().hex}"
        write_file(name, pickle.dumps(tree, protocol=5))
        return pa.table({"cluster": part.column("cluster")[:1], "shard": part.column("shard")[:1], "path": [name], "centre": [tree.centres[0].tobytes()], "radius": [tree.radii[0]]})

    return saved(rows.groupBy("cluster", "shard").applyInArrow(build, "cluster int, shard int, path string, centre binary, radius double"), "op9-manifest")


def search_trees(asked: DataFrame, manifest: DataFrame, dimension: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, m): the k best of every asked (cluster, shard, query_id, p, floor), a saved table, in that shard, none below the floor.

    A shard's queries are dealt in blocks of about QUERY_BLOCK, each a group with the shard's tree.
    """

    def run(own: pa.Table, tree: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, int, int]] = []
        if own.num_rows and tree.num_rows:
            found = pickle.loads(read_file(tree.column("path")[0].as_py()))
            for part in slices(iter(own.select(["query_id", "p", "floor"]).to_batches()), 512):
                ids = part.column(0).to_numpy()
                heaps = found.search(_arrays(part.column(1), dimension), ids, part.column(2).to_numpy(), k)
                rows += [(q, -other, score, m) for q, heap in zip(ids.tolist(), heaps) for score, other, m in heap]
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score", "m"), columns)})

    # One row a shard; those with more than a thousandth of the questions, fewer than a thousand, have blocks of their own number.
    counts = asked.groupBy("cluster", "shard").agg(F.count("*").alias("_asked"))
    total = F.sum("_asked").over(W.partitionBy(F.lit(0)))
    needed = lambda n: F.greatest(F.lit(1), F.ceil(n / QUERY_BLOCK)).cast("int")
    counts = counts.withColumn("_all", needed(total / HOT_KEYS)).withColumn("_hot", F.col("_asked") * HOT_KEYS > total)
    counts = saved(counts.withColumn("_blocks", F.when(F.col("_hot"), needed(F.col("_asked"))).otherwise(F.col("_all"))), "op9-blocks")
    every = F.coalesce(F.max("_all"), F.lit(1))
    hot = counts.where("_hot").select("cluster", "shard", "_blocks")
    blocks = F.coalesce("_blocks", counts.agg(every).scalar())
    # The number of partitions is given: few bytes are much work here, and are not to be coalesced.
    own = asked.join(F.broadcast(hot), ["cluster", "shard"], "left").withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).drop("_blocks")
    trees = manifest.join(counts.select("cluster", "shard", "_blocks"), ["cluster", "shard"]).select("cluster", "shard", "path", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    key = ("cluster", "shard", "block")
    return spread(own, *key).groupBy(*key).cogroup(spread(trees, *key).groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long, m long")


def open_shards(queries: DataFrame, manifest: DataFrame, dimension: int) -> DataFrame:
    """(cluster, shard, query_id, p, floor, bound): the shards besides its own that a query (cluster, shard, query_id, p, floor) still has to ask.

    A query is first bounded by a ball around each cluster (CLUSTERS at most); the
    clusters that are left are joined to their shards and bounded by those.
    """

    def ball(part: pa.Table) -> pa.Table:
        centres = np.frombuffer(b"".join(part.column("centre").to_pylist()), "<f8").reshape(-1, dimension)
        centre = centres.mean(0)
        radius = (np.sqrt(((centres - centre) ** 2).sum(1)) + part.column("radius").to_numpy()).max()
        return pa.table({"cluster": part.column("cluster")[:1], "centre": [centre.tobytes()], "radius": [radius * (1 + 1e-9)]})

    # One row a cluster comes to the driver.
    balls = manifest.select("cluster", "centre", "radius").groupBy("cluster").applyInArrow(ball, "cluster int, centre binary, radius double").orderBy("cluster").collect()
    numbers, radii = np.array([r["cluster"] for r in balls], np.int32), np.array([r["radius"] for r in balls])
    centres = np.frombuffer(b"".join(r["centre"] for r in balls), "<f8").reshape(-1, dimension)

    def clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            if batch.num_rows:
                at, of = np.nonzero(root_bounds(_arrays(batch.column(1), dimension), centres, radii) >= batch.column(2).to_numpy()[:, None])
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(numbers[of])], ["query_id", "p", "floor", "own", "own_shard", "cluster"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            q = _arrays(batch.column(3), dimension)
            centre, radius = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f8").reshape(-1, dimension), batch.column(6).to_numpy()
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            bound = (q * centre).sum(1) + norm * radius
            bound += 1e-9 * (np.abs(bound) + norm * (radius + np.sqrt((centre**2).sum(1)))) + 1e-6
            rows = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bound)], ["cluster", "shard", "query_id", "p", "floor", "bound"])
            yield rows.filter(pa.array(bound >= batch.column(4).to_numpy()))

    own = queries.select("query_id", "p", "floor", F.col("cluster").alias("own"), F.col("shard").alias("own_shard"))
    near = own.mapInArrow(clusters, "query_id long, p binary, floor long, own int, own_shard int, cluster int")
    pairs = near.join(manifest.select("cluster", "shard", "centre", "radius"), "cluster").where((F.col("cluster") != F.col("own")) | (F.col("shard") != F.col("own_shard")))
    return pairs.select("cluster", "shard", "query_id", "p", "floor", "centre", "radius").mapInArrow(shards, "cluster int, shard int, query_id long, p binary, floor long, bound double")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """query_id, floor: the k-th best score of what is found so far; none where fewer are found."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_at", F.row_number().over(order)).where(F.col("_at") == k).select("query_id", F.col("score").alias("_least"))


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP_K, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``vectors`` has (vec_id, v); ``is_query`` marks the queries among its rows.
    """
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.min(F.array_min("v")).alias("least"))
    sizes = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 1
    if sizes and (sizes[0]["least"] == -(1 << 63) or dimension * sizes[0]["most"] ** 2 >= 1 << 62):
        raise OverflowError(f"scores of components up to {sizes[0]['most']} do not fit into 64 bits")
    rows = saved(_packed(vectors.where(F.size("v") == dimension).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))), "op9-vectors")
    # Of equal vectors only the k + 1 least ids can be among a query's best: one of them may be its own.
    # The limit is applied before the shuffle, too, so that no task gets all rows of one vector.
    times = rows.groupBy("vec_id", "p").agg(F.least(F.count("*"), F.lit(k)).alias("m"))
    least = times.withColumn("_at", F.row_number().over(W.partitionBy("p").orderBy("vec_id"))).where(F.col("_at") <= k + 1).drop("_at")
    distinct = saved(least, "op9-distinct")
    shards = blocks_for(distinct.count(), shard_vectors)
    # A bounded sample: the pivots are the vectors of the rows of least hash.
    sample = distinct.select("p").orderBy(F.xxhash64("vec_id"), "vec_id", "p").limit(min(CLUSTERS, shards)).collect()
    pivots = np.frombuffer(b"".join(sorted({bytes(r["p"]) for r in sample})), "<i8").reshape(-1, dimension).astype(np.float64)
    placed = saved(_clustered(distinct, pivots), "op9-placed")
    # One row a cluster; a cluster of many vectors has many shards.
    counts = F.broadcast(placed.groupBy("cluster").agg(F.ceil(F.count("*") / shard_vectors).cast("int").alias("_n")))
    manifest = build_trees(placed.join(counts, "cluster").withColumn("shard", F.pmod(F.xxhash64("vec_id"), "_n").cast("int")).drop("_n"), dimension)
    asking = _clustered(rows.where("asks").select(F.col("vec_id").alias("query_id"), "p").distinct(), pivots)
    lowest = F.lit(-(1 << 63)).cast("long")
    asking = saved(asking.join(counts, "cluster").select("cluster", F.pmod(F.xxhash64("query_id"), "_n").cast("int").alias("shard"), "query_id", "p", lowest.alias("floor")), "op9-queries")
    first = saved(search_trees(asking, manifest, dimension, k), "op9-first")
    # k candidates give a floor; fewer give none.  A query id with several vectors takes none.
    several = saved(asking.groupBy("query_id").agg(F.count("*").alias("_k")).where("_k > 1").select("query_id"), "op9-several")
    shared = lambda rows, found: rows.join(_floors(found, k).join(several, "query_id", "left_anti"), "query_id", "left").withColumn("floor", F.coalesce("_least", "floor")).drop("_least")
    left = open_shards(shared(asking, first), manifest, dimension)
    # A query asks its other shards in waves, those of the highest bounds first; each wave knows the k-th best score of all before.
    by_bound = W.partitionBy("query_id", "p").orderBy(F.desc("bound"), "cluster", "shard")
    left, found, low = saved(left.withColumn("at", F.row_number().over(by_bound)), "op9-open"), first, 0
    others = manifest.count() - 1
    for high in [*[x for x in WAVES if x < others], others]:
        wave = shared(left.where((F.col("at") > low) & (F.col("at") <= high)), found).where(F.col("bound") >= F.col("floor"))
        wave, low = saved(wave.drop("at", "bound"), "op9-wave"), high
        if is_empty(wave):
            continue
        found = found.unionByName(saved(search_trees(wave, manifest, dimension, k), "op9-found"))
    every = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_copy"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


SQL = r"""
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
