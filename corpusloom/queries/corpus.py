"""Queries of corpus preparation, splitting and feature selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import portable_hash, portable_hash_sql
from ..operators import corpus as C
from ..operators import selection, split
from ..session import checkpointed, stored, table
from ..sources.readers import element, elements

STOP = ["the", "and", "of", "to", "in", "is", "de", "la", "le", "les", "des", "der", "die", "und", "que", "el", "los"]
LANGS = ["de", "en", "es", "fr"]
TF = r"tf AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents) GROUP BY ALL)"
VOCAB = "voc AS (SELECT word, CAST(sum(n) AS BIGINT) AS total FROM tf GROUP BY word)"
#: Most frequent words, ties by word.
TOP = "top AS (SELECT word, CAST(row_number() OVER (ORDER BY total DESC, word) AS BIGINT) AS rank FROM voc QUALIFY rank <= {k})"
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def tf_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.term_counts(table(spark, sf_dir, "documents"))


def top_words(tf: DataFrame, k: int) -> DataFrame:
    """(word, rank) of the k most frequent words: at most k rows."""
    totals = tf.groupBy("word").agg(F.sum("n").alias("total"))
    best = totals.orderBy(F.desc("total"), "word").limit(k)
    return best.select("word", F.row_number().over(W.orderBy(F.desc("total"), "word")).cast("long").alias("rank"))


@query(f"WITH {TF} SELECT * FROM tf")
def tokenize_counts(spark, sf_dir):
    return tf_of(spark, sf_dir)


@query(f"WITH {TF}, {VOCAB} SELECT word, total, row_number() OVER (ORDER BY word) AS word_id FROM voc")
def vocabulary_index(spark, sf_dir):
    return C.vocabulary(tf_of(spark, sf_dir))


@query(f"""WITH {TF} SELECT 'documents' AS kind, '' AS name, count(*) AS n FROM documents
UNION ALL SELECT 'vocabulary', '', count(DISTINCT word) FROM tf
UNION ALL SELECT 'label', source, count(*) FROM documents GROUP BY source""")
def corpus_info(spark, sf_dir):
    return C.corpus_info(docs_of(spark, sf_dir), tf_of(spark, sf_dir), "source")


@query("SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*), source) AS rank FROM documents GROUP BY source")
def class_ranks(spark, sf_dir):
    return C.class_ranks(docs_of(spark, sf_dir), "source")


@query("SELECT lang, doc_id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS y FROM documents")
def class_reindex(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(LANGS)), "y int, name string")
    return C.class_index(docs_of(spark, sf_dir).select("doc_id", "lang"), names, "lang")


@query("SELECT source, doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS y FROM documents")
def label_dense_index(spark, sf_dir):
    return C.dense_label_index(docs_of(spark, sf_dir).select("doc_id", "source"), "source")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 0 ELSE 1 END AS y FROM documents")
def binary_relabel(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", C.binary_label(F.col("source"), "src3").alias("y"))


@query(f"WITH {TF} SELECT * FROM tf WHERE word NOT IN ({STOP_SQL})")
def stopword_filter(spark, sf_dir):
    return C.without_stop_words(tf_of(spark, sf_dir), spark.createDataFrame([(w,) for w in STOP], "word string"))


@query(f"""WITH {TF}, train AS (SELECT * FROM tf WHERE {portable_hash_sql("doc_id", 1)} % 10 < 7),
kept AS (SELECT word FROM train GROUP BY word HAVING sum(n) >= 2) SELECT tf.* FROM tf SEMI JOIN kept USING (word)""")
def rare_word_filter(spark, sf_dir):
    tf = stored(tf_of(spark, sf_dir))
    return C.without_rare_words(tf, tf.where(portable_hash(F.col("doc_id"), 1) % 10 < 7))


@query(f"WITH {TF}, {VOCAB}, {TOP.format(k=30)} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM tf SEMI JOIN top USING (word))")
def zero_vector_filter(spark, sf_dir):
    tf = tf_of(spark, sf_dir)
    return C.nonzero_documents(docs_of(spark, sf_dir).select("doc_id"), tf.join(top_words(tf, 30), "word"))


@query(f"WITH {TF} SELECT doc_id, word, round(n * 10000e0 / sum(n) OVER (PARTITION BY doc_id), 8) AS n FROM tf")
def l1_scale(spark, sf_dir):
    return C.scaled(tf_of(spark, sf_dir), 10000, "l1").withColumn("n", F.round("n", 8))


@query(f"WITH {TF} SELECT doc_id, word, round(n * 10000e0 / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY doc_id)), 8) AS n FROM tf")
def l2_scale(spark, sf_dir):
    return C.scaled(tf_of(spark, sf_dir), 10000, "l2").withColumn("n", F.round("n", 8))


@query("SELECT user_id AS doc_id, event_type AS word_id, arg_max(CAST(floor(value * 100) AS BIGINT), event_id) AS n FROM events GROUP BY ALL")
def triples_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("word_id"), F.floor(F.col("value") * 100).alias("n"), "event_id")
    return C.last_wins(rows, "event_id")


@query(r"""SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g') AS title,
CAST(len(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1)) AS INTEGER) AS n_paragraphs FROM pages""")
def markup_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", C.collapsed(element(html, "title")).alias("title"), F.size(elements(html, "p")).alias("n_paragraphs"))


@query("SELECT doc_id, list_filter([lang, source], lambda t: t IN ('en', 'fr', 'src1', 'src2'))[1] AS topic FROM documents WHERE lang IN ('en', 'fr') OR source IN ('src1', 'src2')")
def topic_first_match(spark, sf_dir):
    topic = C.first_topic(F.array("lang", "source"), ["en", "fr", "src1", "src2"])
    return docs_of(spark, sf_dir).select("doc_id", topic.alias("topic")).where("topic is not null")


@query(f"""WITH {TF}, {VOCAB}, {TOP.format(k=5)}, cell AS (SELECT d.doc_id, t.rank, coalesce(f.n, 0) AS n FROM documents d CROSS JOIN top t LEFT JOIN tf f ON f.doc_id = d.doc_id AND f.word = t.word)
SELECT d.doc_id, (SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY rank) FROM cell c WHERE c.doc_id = d.doc_id) || ',' || d.lang AS line FROM documents d""")
def dense_rows(spark, sf_dir):
    tf = tf_of(spark, sf_dir)
    rows = C.dense_rows(docs_of(spark, sf_dir), C.ranked_features(tf, top_words(tf, 5)), 5, "lang")
    return rows.select("doc_id", F.concat_ws(",", F.transform("features", lambda x: x.cast("bigint").cast("string")), "lang").alias("line"))


_PARTS = f"parts AS (SELECT doc_id, lang AS label, CASE WHEN {portable_hash_sql('doc_id', 2)} % 10 < 7 THEN 0 ELSE 1 END AS part FROM documents)"


@query(f"WITH {_PARTS} SELECT doc_id, label, part, row_number() OVER (ORDER BY label, part, doc_id) AS new_id FROM parts")
def merge_corpora(spark, sf_dir):
    docs = docs_of(spark, sf_dir).select("doc_id", F.col("lang").alias("label"))
    is_train = portable_hash(F.col("doc_id"), 2) % 10 < 7
    return split.merged(docs.where(is_train), docs.where(~is_train))


@query("""WITH d AS (SELECT doc_id, source AS label, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5 THEN 1 ELSE 0 END AS part FROM documents)
SELECT doc_id, label, part, row_number() OVER (PARTITION BY part ORDER BY label, doc_id) AS new_id FROM d""")
def equal_class_test_split(spark, sf_dir):
    return split.equal_class_split(docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("label")), 5)


@query(f"""WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang),
q AS (SELECT *, 100 * n / sum(n) OVER () AS exact, floor(100 * n / sum(n) OVER ()) AS low FROM c),
r AS (SELECT *, low + CASE WHEN row_number() OVER (ORDER BY round(exact - low, 9) DESC, label) <= 100 - sum(low) OVER () THEN 1 ELSE 0 END AS quota FROM q),
p AS (SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY {portable_hash_sql("doc_id")}, doc_id) AS place FROM documents)
SELECT p.label, doc_id, place <= quota AS chosen FROM p JOIN r USING (label)""")
def stratified_shuffle_split(spark, sf_dir):
    return split.stratified_split(docs_of(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), 100)


@query(f"SELECT doc_id, lang AS label, CAST((row_number() OVER (PARTITION BY lang ORDER BY {portable_hash_sql('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def stratified_kfold(spark, sf_dir):
    return split.stratified_folds(docs_of(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), 5)


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {portable_hash_sql('doc_id')}, doc_id) <= ceil(0.3 * (SELECT count(*) FROM documents)) AS is_test FROM documents")
def random_train_test_split(spark, sf_dir):
    return split.random_split(docs_of(spark, sf_dir).select("doc_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS run_id FROM documents")
def leave_one_out(spark, sf_dir):
    return split.leave_one_out(docs_of(spark, sf_dir).select("doc_id"))


@query("""WITH c AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY source)
SELECT label, n, CAST(sum(n) OVER (ORDER BY label) - n AS BIGINT) AS "offset" FROM c""")
def class_offsets(spark, sf_dir):
    return split.class_offsets(docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("label")))


@query(f"""WITH c AS (SELECT doc_id, list_sort([0e0, 1e0, {portable_hash_sql("doc_id", 1)} / 4294967296e0, {portable_hash_sql("doc_id", 2)} / 4294967296e0]) AS q FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS part, round(q[i + 2] - q[i + 1], 12) AS share FROM c, (SELECT unnest(range(3)) AS i)""")
def simplex_sample(spark, sf_dir):
    return split.simplex_shares(docs_of(spark, sf_dir), 3).withColumn("share", F.round("share", 12))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels(doc_id, y) of the documents whose quality is known."""
    return table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"))


_MI = f"""{TF.replace("tf AS (", "tf AS MATERIALIZED (")}, lab AS (SELECT doc_id, quality AS y FROM labels WHERE quality IS NOT NULL), size AS (SELECT y, count(*) AS size FROM lab GROUP BY y),
seen AS (SELECT word, n AS occurrences, y, count(*) AS docs FROM tf JOIN lab USING (doc_id) GROUP BY ALL),
held AS (SELECT word, y, CAST(sum(docs) AS BIGINT) AS held FROM seen GROUP BY ALL),
tab AS MATERIALIZED (SELECT * FROM seen UNION ALL
  SELECT w.word, 0, s.y, s.size - coalesce(h.held, 0) FROM (SELECT DISTINCT word FROM seen) w CROSS JOIN size s LEFT JOIN held h ON h.word = w.word AND h.y = s.y WHERE s.size > coalesce(h.held, 0)),
info AS MATERIALIZED (SELECT word, sum(docs / d * log2(docs * d / (o * c))) / (SELECT count(DISTINCT word) FROM seen) AS mi FROM (
  SELECT word, CAST(docs AS DOUBLE) AS docs, CAST(sum(docs) OVER (PARTITION BY word) AS DOUBLE) AS d, CAST(sum(docs) OVER (PARTITION BY word, occurrences) AS DOUBLE) AS o, CAST(sum(docs) OVER (PARTITION BY word, y) AS DOUBLE) AS c FROM tab) GROUP BY word)"""


def _mi(spark, sf_dir, tf=None):
    return selection.mutual_information(tf_of(spark, sf_dir) if tf is None else tf, labelled(spark, sf_dir))


@query(f"WITH {_MI} SELECT word, occurrences, y, docs FROM tab")
def mi_contingency(spark, sf_dir):
    return selection.contingency(tf_of(spark, sf_dir), labelled(spark, sf_dir))


@query(f"""WITH {_MI}, t AS (SELECT sum(docs) AS t FROM tab)
SELECT 'class' AS kind, CAST(y AS BIGINT) AS value, round(sum(docs) / any_value(t), 12) AS p FROM tab, t GROUP BY y
UNION ALL SELECT 'occurrences', occurrences, round(sum(docs) / any_value(t), 12) FROM tab, t GROUP BY occurrences""")
def mi_marginals(spark, sf_dir):
    by_class, by_count = selection.marginals(selection.contingency(tf_of(spark, sf_dir), labelled(spark, sf_dir)))
    a = by_class.select(F.lit("class").alias("kind"), F.col("y").cast("long").alias("value"), F.round("p", 12).alias("p"))
    return a.unionByName(by_count.select(F.lit("occurrences").alias("kind"), F.col("occurrences").alias("value"), F.round("p", 12).alias("p")))


@query(f"WITH {_MI} SELECT word, round(mi, 11) AS mi, row_number() OVER (ORDER BY round(mi, 11) DESC, word DESC) AS rank FROM info")
def mi_rank(spark, sf_dir):
    return selection.ranked(_mi(spark, sf_dir), digits=11).withColumn("mi", F.round("mi", 11))


@query(f"""WITH {_MI}, r AS (SELECT word, row_number() OVER (ORDER BY round(mi, 11) DESC, word DESC) AS word_id FROM info QUALIFY word_id <= 300)
SELECT tf.doc_id, r.word_id, tf.n FROM tf JOIN r USING (word)""")
def mi_topk_features(spark, sf_dir):
    tf = checkpointed(tf_of(spark, sf_dir))
    return C.ranked_features(tf, selection.best(_mi(spark, sf_dir, tf), 300, digits=11))


@query(f"WITH {_MI} SELECT word, row_number() OVER (ORDER BY round(mi, 11), word) AS rank FROM info")
def mi_rank_ascending(spark, sf_dir):
    return selection.ranked(_mi(spark, sf_dir), ascending=True, digits=11).select("word", "rank")
