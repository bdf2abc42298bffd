"""Operator 5: quality rules and an n-gram log-likelihood ratio, all in DataFrame functions.

Base rules look at a text alone (words, symbols, repeated lines and windows).
The verdict compares two multinomials over hashed word unigrams and bigrams:
one counted over the documents that are labelled good, one over the whole
corpus.  A document's score is the mean log ratio of its n-grams; it is kept if
the base rules pass and the score is at least a fixed threshold, so the same
corpus always gives the same verdicts.

Defined results: null and empty texts have no words and fail; rows without a
``doc_id`` are judged like others and never count as labelled; a document that is
labelled both good and bad is not trusted; equal rows are judged one by one;
texts of any length are read whole; a score of exactly the threshold passes; without labels,
or in a corpus without words, every score is 0; elsewhere a text without words has the score of
the empty word's bucket, which decides nothing, as it fails the base rules; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, saved, table

BUCKETS = 1 << 15
#: The target counts are smoothed towards the raw multinomial, so n-grams too rare to
#: judge have a ratio near 1: by pseudo-counts of an average bucket, which keep a small
#: sample from judging, and by a share of the target's own size, which does not fade as it grows.
SMOOTHING = 8.0
SMOOTHING_SHARE = 0.1
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.08
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
_GAP = "[ \\t\\n\\x0B\\f\\r]+"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds w (words) and the base columns to (doc_id, text, ...)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.withColumn("w", words_of(F.col("text"))).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("w", lambda x: F.xxhash64(x)),
    })
    # Each of the columns below is read more than once above it, so that it is computed once a row.
    last = F.size("_h") - WINDOW
    out = out.withColumn("_g", F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))))
    repeats = F.coalesce(F.size(F.array_distinct("_g")) < F.size("_g"), F.lit(False))
    out = out.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, i: F.coalesce(F.get(F.col("_s"), i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), i + 1)["g"] == x["g"], F.lit(False))
    out = out.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"]))))
    # The union of windows [p, p + 8): each adds what the one before has not covered.
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_lines", "_h", "_g", "_s", "_p")


def _grams(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per unigram and bigram of the words in w: its bucket."""
    pairs = rows.select(*keys, F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    one = F.pmod(F.xxhash64("p.a"), F.lit(BUCKETS)).cast("int")
    two = F.when(F.col("p.b").isNotNull(), F.pmod(F.xxhash64("p.a", "p.b"), F.lit(BUCKETS)).cast("int"))
    return pairs.select(*keys, F.explode(F.array(one, two)).alias("bucket")).where(F.col("bucket").isNotNull())


def fit_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, ratio): the log ratio of each bucket that the corpus has; BUCKETS rows at most."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("trusted"))
    trusted = usable.where("trusted = 1").select("doc_id", F.lit(1).alias("trusted"))
    # The labels grow with the corpus: joined by a merge of both sides at every size, never broadcast.
    rows = docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words_of(F.col("text")).alias("w"))
    counts = saved(_grams(rows, "trusted").groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")), "op5-counts")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("ratio"))
    prior = SMOOTHING * BUCKETS + SMOOTHING_SHARE * target
    return counts.select("bucket", F.log((F.col("target") * (raw / F.col("raw")) + prior) / (target + prior)).alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, the base columns, score and kept of every row."""
    # The table has BUCKETS rows at most, whatever the corpus: small enough to send to every task.
    ratios = F.broadcast(fit_ratios(docs, labels))
    columns = ["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    base = with_base(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))).select(*columns, F.monotonically_increasing_id().alias("_row"), "w")
    # Rows without words have no n-grams: they pass as one empty word.
    blank = F.when(F.size("w") == 0, F.array(F.lit(""))).otherwise(F.col("w"))
    scored = _grams(base.withColumn("w", blank), *columns, "_row").join(ratios, "bucket", "left").groupBy(*columns, "_row").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("score")).drop("_row")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")
