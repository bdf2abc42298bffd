"""Deterministic splits and samples, by a portable hash of the document id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParameterError
from ..functions.scalar import portable_hash, simplex
from ..session import numbered


#: Bits of a hash and of an id that one pass of ``_cuts`` leaves unseen, pass by pass.
_HASH_PASSES, _ID_PASSES = (16, 0), (48, 32, 16, 0)


def _hashed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumn("_h", portable_hash(F.col("doc_id"), seed))


def _placed(docs: DataFrame, name: str, label: str, seed: int) -> DataFrame:
    """Adds each document's place (from 1) in its class by hash; a class may hold most documents.

    The upper 16 bits of the hash deal a class into up to 65536 bins; a place is the
    documents of the bins before and the place in the own bin, so nothing is sorted as a whole.
    """
    rows = _hashed(docs, seed).withColumn("_bin", F.shiftright("_h", 16))
    counts = rows.groupBy(F.col(label).alias("_class"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.select("_class", "_b", (F.sum("_n").over(W.partitionBy("_class").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(label, "_bin").orderBy("_h", "doc_id"))
    own = rows.withColumn("_inside", inside)
    found = own.join(before, own[label].eqNullSafe(before["_class"]) & (own["_bin"] == before["_b"]))
    return found.withColumn(name, F.col("_before") + F.col("_inside")).drop("_h", "_bin", "_class", "_b", "_inside", "_before")


def _cuts(docs: DataFrame, label: str, key: Column, passes: tuple[int, ...], wanted: list[tuple]) -> list[tuple]:
    """(class, j, cut, left) for wanted (class, j, number): the number-th smallest key of the class, and how many rows of that very key belong to them.

    Order statistics without a sort: each pass counts the rows of a class by the next
    bits of the key, inside the prefix that the passes before have found; the
    driver holds one row a class and number.
    """
    spark, kind = docs.sparkSession, docs.schema[label].dataType
    schema = T.StructType([T.StructField("_class", kind), T.StructField("_j", T.IntegerType()), T.StructField("_prefix", T.LongType()), T.StructField("_left", T.LongType())])
    state = [(c, j, 0, n) for c, j, n in wanted]
    rows = docs.select(F.col(label).alias("_of"), key.cast("long").alias("_key"))
    for i, shift in enumerate(passes):
        if not state:
            break
        open_ = rows.join(F.broadcast(spark.createDataFrame(state, schema)), F.col("_of").eqNullSafe(F.col("_class")))
        if i:
            open_ = open_.where(F.shiftright("_key", passes[i - 1]) == F.col("_prefix"))
        counts = open_.groupBy("_class", "_j", "_left", F.shiftright("_key", shift).alias("_bin")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(W.partitionBy("_class", "_j").orderBy("_bin"))
        hit = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        state = [(r["_class"], r["_j"], r["_bin"], r["_left"] - (r["_upto"] - r["_n"])) for r in hit.collect()]
    return state


def _smallest(docs: DataFrame, label: str, wanted: list[tuple], n: int, seed: int) -> DataFrame:
    """Adds chosen ARRAY<BOOLEAN>: for j below n, whether the row is among its class's wanted (class, j, number) of the least hashes.

    Equal hashes go by id; rows of one id stand or fall together.
    """
    spark, kind = docs.sparkSession, docs.schema[label].dataType
    own = _hashed(docs, seed)
    cuts = _cuts(own, label, F.col("_h"), _HASH_PASSES, [x for x in wanted if x[2] > 0])
    fields = [T.StructField("_class", kind), T.StructField("_j", T.IntegerType()), T.StructField("_cut", T.LongType()), T.StructField("_left", T.LongType())]
    # The few rows of the very hash of a cut: a class's share of 2^32 hashes.
    ties = own.select(F.col(label).alias("_of"), "_h", "doc_id").join(F.broadcast(spark.createDataFrame(cuts, T.StructType(fields))), F.col("_of").eqNullSafe(F.col("_class")) & (F.col("_h") == F.col("_cut")))
    ids = ties.groupBy("_class", "_j", "_left", "doc_id").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_class", "_j").orderBy("doc_id")) - F.col("_n")
    last = {(r["_class"], r["_j"]): r["_id"] for r in ids.withColumn("_before", before).where("_before < _left").groupBy("_class", "_j").agg(F.max("doc_id").alias("_id")).collect()}
    by_class: dict = {}
    for c, j, cut, _ in cuts:
        by_class.setdefault(c, [None] * n)[j] = (cut, last.get((c, j)))
    one = T.StructType([T.StructField("cut", T.LongType()), T.StructField("id", docs.schema["doc_id"].dataType)])
    table = spark.createDataFrame(list(by_class.items()), T.StructType([fields[0], T.StructField("_cuts", T.ArrayType(one))]))
    joined = own.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_class")), "left")
    inside = lambda x: (F.col("_h") < x["cut"]) | ((F.col("_h") == x["cut"]) & (F.col("doc_id") <= x["id"]))
    chosen = F.array(*[F.coalesce(inside(F.get("_cuts", F.lit(j))), F.lit(False)) for j in range(n)])
    return joined.withColumn("chosen", chosen).drop("_h", "_class", "_cuts")


def merged(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Both parts by class, the training part first, renumbered from 1 as new_id."""
    both = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)))
    return numbered(both, "new_id", F.col(label), F.col("part"), F.col("doc_id"))


def equal_class_split(docs: DataFrame, per_class: int, label: str = "label") -> DataFrame:
    """The last ``per_class`` documents of each class are the test part; both parts renumbered."""
    sizes = docs.groupBy(label).agg(F.count("doc_id").alias("_n")).collect()  # one row a class
    key = F.bitwise_not(F.col("doc_id").cast("long"))
    cuts = _cuts(docs.where("doc_id is not null"), label, key, _ID_PASSES, [(r[label], 0, min(per_class, r["_n"])) for r in sizes if min(per_class, r["_n"]) > 0])
    table = docs.sparkSession.createDataFrame([(c, cut) for c, _, cut, _ in cuts], T.StructType([T.StructField("_class", docs.schema[label].dataType), T.StructField("_cut", T.LongType())]))
    dealt = docs.join(F.broadcast(table), docs[label].eqNullSafe(table["_class"]), "left")
    dealt = dealt.withColumn("part", F.when(key <= F.col("_cut"), 1).otherwise(0)).drop("_class", "_cut")
    parts = [numbered(dealt.where(F.col("part") == i), "new_id", F.col(label), F.col("doc_id")) for i in (0, 1)]
    return parts[0].unionByName(parts[1])


def _quotas(docs: DataFrame, size: float, label: str) -> list[tuple]:
    """(class, documents to choose): in proportion, rounded by largest remainder, so that they add up; one row a class."""
    counts = docs.groupBy(label).agg(F.count("*").alias("_n"))
    whole = W.partitionBy(F.lit(0))
    wanted = F.ceil(F.lit(float(size)) * F.sum("_n").over(whole)) if size < 1 else F.least(F.lit(int(size)), F.sum("_n").over(whole))
    exact = F.col("_wanted") * F.col("_n") / F.sum("_n").over(whole)
    quotas = counts.withColumn("_wanted", wanted).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rest = F.col("_wanted") - F.sum("_floor").over(whole)
    by_rest = W.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), label)
    quota = F.col("_floor") + F.when(F.row_number().over(by_rest) <= rest, 1).otherwise(0)
    return [(r["_class"], r["_quota"]) for r in quotas.select(F.col(label).alias("_class"), quota.alias("_quota")).collect()]


def stratified_split(docs: DataFrame, size: float, label: str = "label", seed: int = 0) -> DataFrame:
    """Adds ``chosen``: ``size`` documents (a fraction below 1, or a number) of least hash, classes in proportion."""
    if size <= 0:
        raise ParameterError("size must be positive")
    wanted = [(c, 0, q) for c, q in _quotas(docs, size, label)]
    return _smallest(docs, label, wanted, 1, seed).withColumn("chosen", F.col("chosen")[0])


def stratified_shares(docs: DataFrame, shares: list[float], label: str = "label", seed: int = 0) -> DataFrame:
    """Adds ``chosen`` ARRAY<BOOLEAN>: whether the document is in each share (1: all), found in the same passes; larger shares hold the smaller."""
    if min(shares) <= 0:
        raise ParameterError("size must be positive")
    wanted = [(c, j, q) for j, x in enumerate(shares) if x < 1 for c, q in _quotas(docs, x, label)]
    found = _smallest(docs, label, wanted, len(shares), seed)
    return found.withColumn("chosen", F.array(*[F.col("chosen")[j] if x < 1 else F.lit(True) for j, x in enumerate(shares)]))


def stratified_folds(docs: DataFrame, k: int, label: str = "label", seed: int = 0) -> DataFrame:
    """Adds fold, 0 to k - 1."""
    if k < 2:
        raise ParameterError("at least two folds")
    return _placed(docs, "_at", label, seed).withColumn("fold", F.pmod(F.col("_at") - 1, F.lit(k)).cast("int")).drop("_at")


def folds_for_size(total: int, size: int) -> int:
    """Folds whose held-out part has about ``size`` documents."""
    if size < 1:
        raise ParameterError("size must be positive")
    return max(2, round(total / size))


def random_split(docs: DataFrame, fraction: float = 0.3, seed: int = 0) -> DataFrame:
    """Adds is_test: exactly ceil(fraction * rows) documents, those of least hash."""
    total = docs.count()
    rows = _smallest(docs.withColumn("_all", F.lit(0)), "_all", [(0, 0, math.ceil(fraction * total))], 1, seed)
    return rows.withColumn("is_test", F.col("chosen")[0]).drop("chosen", "_all")


def leave_one_out(docs: DataFrame) -> DataFrame:
    """Adds run_id (from 0): the run in which this document alone is held out."""
    return numbered(docs, "run_id", F.col("doc_id")).withColumn("run_id", F.col("run_id") - 1)


def class_offsets(docs: DataFrame, label: str = "label") -> DataFrame:
    """Documents of each class and of all classes before it; one row a class."""
    counts = docs.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.sum("n").over(W.orderBy(label)) - F.col("n"))


def simplex_shares(docs: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """doc_id, part (from 0), share."""
    return docs.select("doc_id", F.posexplode(simplex(F.col("doc_id"), parts, seed)).alias("part", "share"))
