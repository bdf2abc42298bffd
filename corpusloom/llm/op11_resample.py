"""Operator 11: importance resampling of a corpus towards a target distribution.

Texts become bags of hashed word n-grams.  A bucket's gain is the log ratio of its
smoothed shares in the target and in the corpus; a document's weight is the sum of
the gains of its n-grams, its score the weight plus Gumbel noise of its own, and the
highest scores are drawn, which is sampling without replacement.

Equal texts are one row from the start: rows are grouped by their whole text, the
bag of each distinct text is computed once and kept, corpus counts are the bags
times the number of copies, and weights go back to the documents by the text's
SHA-256 before the noise, which depends on the document.  A text with very many
copies is one row a task in the grouping, and its weight is broadcast, not joined.

Defined results: a null text is an empty one, without n-grams (weight 0); texts of
any length are counted whole, in blocks of words; rows without a ``doc_id`` take
the noise of an empty id and are placed first among equal scores; rows that share
a ``doc_id`` are scored and drawn one by one; an empty corpus gives no rows, an empty
target leaves the smoothing; other columns of the input, whatever their names, are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_sql, crc32_sql, discard, joined_by_share, placed, saved, slices, table

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
#: Documents drawn of a hundred that are long enough.
DRAWN = 5
SEED = 42
#: Bytes of a text that are cut into words at a time.
BLOCK_BYTES = 1 << 20

#: Bytes to bytes: capitals to small letters, all else of ASCII but letters and digits to the space.
_WORDS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def _blocks(text: str, size: int) -> Iterator[list[bytes]]:
    data = text.encode("utf-8").translate(_WORDS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def bag(text: str, buckets: int = BUCKETS, longest: int = LONGEST, block: int = BLOCK_BYTES) -> tuple[int, np.ndarray]:
    """(words, sorted buckets of all n-grams, repeats included)."""
    from zlib import crc32

    words, tail, found = 0, [], []
    for own in _blocks(text, block):
        words += len(own)
        joined = tail + own
        spaced = [b" " + w for w in joined]
        # crcs[i]: of the n-gram that ends with word i; each n-gram goes on from the shorter one that starts where it does.
        crcs = list(map(crc32, joined))
        found.append(np.array(crcs[len(tail) :], np.int64))
        for n in range(2, longest + 1):
            crcs = list(map(crc32, spaced[n - 1 :], crcs))
            # N-grams that lie in the tail alone were counted with the block before.
            found.append(np.array(crcs[max(0, len(tail) - n + 1) :], np.int64))
        tail = joined[len(joined) - min(len(joined), longest - 1) :]
    return words, np.sort(np.concatenate(found) % buckets) if found else np.zeros(0, np.int64)


def packed_bag(sorted_buckets: np.ndarray) -> bytes:
    """The gaps between sorted buckets, low bytes first: mostly small numbers and zeros, which compress well."""
    gaps = np.diff(sorted_buckets, prepend=0).astype("<u2")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 2).T).tobytes()


def unpacked_bag(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(2, -1)
    return np.cumsum(planes[0].astype(np.int64) + (planes[1].astype(np.int64) << 8))


def bags(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """One row a distinct text: text_key (its SHA-256), copies, n_words, n_features, bag."""
    if not 0 < buckets <= 65_536:
        raise ValueError("buckets must be from 1 to 65536")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [bag(x, buckets, longest) for x in part.column(2).to_pylist()]
            sizes = [pa.array([f(x) for x in found], pa.int64()) for f in (lambda x: x[0], lambda x: len(x[1]))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sizes, pa.array([packed_bag(x[1]) for x in found], pa.binary())], ["text_key", "copies", "n_words", "n_features", "bag"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(_key(F.col("text")), "copies", "text").mapInArrow(run, "text_key binary, copies long, n_words long, n_features long, bag binary")


def _key(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("text_key")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all copies of the texts; a task gives one row a bucket, and so does the driver get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for copies, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                sums += copies * np.bincount(unpacked_bag(raw), minlength=buckets)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held], pa.int64())], ["bucket", "n"])

    rows = found.select("copies", "bag").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """text_key, copies, n_words, n_features, weight: the sum of gains over each text's bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sums = [int(gain[unpacked_bag(x)].sum()) for x in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sums, pa.int64())], ["text_key", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "text_key binary, copies long, n_words long, n_features long, weight long")


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; a saved table."""
    own, aim = saved(bags(docs, buckets, longest), "op11-bags"), saved(bags(target, buckets, longest), "op11-target")
    gain = gains(bucket_counts(own, buckets), bucket_counts(aim, buckets))
    by_text = saved(weights(own, gain), "op11-weights")
    discard(own, aim)
    total = by_text.agg(F.sum("copies")).first()[0] or 0
    rows = joined_by_share(docs.select("doc_id", _key(F.col("text"))), by_text, "text_key", "copies", total)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    out = saved(rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "op11-scores")
    discard(by_text)
    return out


def importance_resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """The scores with rank: the places from 1 of the drawn, null for all others.

    Of the N documents with at least ``min_words`` words, ``drawn`` * N / 100 are drawn, rounded down.
    """
    scored = importance_scores(docs, target, buckets, longest, seed)
    able = scored.where(F.col("n_words") >= min_words)
    wanted = drawn * able.count() // 100
    ranked, _ = placed(able, "rank", "op11-ranked", F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _features_sql(source: str) -> str:
    grams = ", ".join(f"list_transform(range(1, len(w) + 2 - {n}), lambda i: {' || chr(32) || '.join(f'w[i + {k}]' for k in range(n))})" for n in (2, 3))
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"SELECT *, len(w) AS n_words, unnest(list_concat(w, {grams})) AS f FROM (SELECT *, {words} AS w FROM {source})"


SQL = f"""WITH d AS MATERIALIZED ({_features_sql('documents')}), b AS MATERIALIZED ({_features_sql('benchmark')}),
key AS MATERIALIZED (SELECT f, {crc32_sql(bytes_sql('f'))} % {BUCKETS} AS bucket FROM (SELECT f FROM d UNION SELECT f FROM b)),
s AS (SELECT bucket, count(*) AS n FROM d JOIN key USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM b JOIN key USING (f) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * ((SELECT count(*) FROM d) + {BUCKETS}e0) / ((coalesce(s.n, 0) + 1e0) * ((SELECT count(*) FROM b) + {BUCKETS}e0)))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket)),
own AS (SELECT doc_id, any_value(n_words) AS n_words, count(*) AS n_features, sum(g) AS weight FROM d JOIN key USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
sc AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN own USING (doc_id)),
sco AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM sc),
pl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sco WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM sco LEFT JOIN (SELECT * FROM pl WHERE rank <= {DRAWN} * (SELECT count(*) FROM pl) // 100) USING (doc_id)"""
