"""Queries over file sources and sinks: every one writes files to the shared folder and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import portable_hash, portable_hash_sql
from ..operators import corpus as C
from ..operators import metrics
from ..plans import preparation
from ..session import checkpoint_folder, checkpointed, numbered, stored
from ..sources import generator, readers, writers
from .corpus import _MI, STOP, STOP_SQL, TF, VOCAB, docs_of, labelled, tf_of
from .models import _EVAL, _evaluated

QUERIES: dict = {}
SQL: dict[str, str] = {}
TOPICS, FEATURES = ["en", "fr"], [50, 100]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"


@query(f"WITH {TF}, {VOCAB}, w AS (SELECT word, row_number() OVER (ORDER BY word) AS word_id FROM voc) SELECT doc_id, CAST(word_id AS INTEGER) AS word_id, CAST(n AS INTEGER) AS n FROM tf JOIN w USING (word)")
def triples_round_trip(spark, sf_dir):
    folder, tf = _folder(spark), checkpointed(tf_of(spark, sf_dir))
    writers.write_triples(tf.join(C.vocabulary(tf).select("word", "word_id"), "word"), folder)
    return readers.triples(spark, folder)


@query(f"WITH {TF}, {VOCAB} SELECT row_number() OVER (ORDER BY total DESC, word) AS pos, word FROM voc")
def rank_list_round_trip(spark, sf_dir):
    """The whole vocabulary by descending totals, a word a line."""
    folder = _folder(spark)
    totals = tf_of(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("total"))
    writers.write_ranks(numbered(totals, "rank", F.desc("total"), F.asc("word")).select("word", "rank"), folder)
    return readers.positional(spark, folder, "word")


@query("SELECT row_number() OVER (ORDER BY doc_id) AS pos, lang AS label FROM documents")
def label_file_round_trip(spark, sf_dir):
    folder = _folder(spark)
    writers.write_labels(docs_of(spark, sf_dir), folder, "lang", "doc_id")
    return readers.positional(spark, folder, "label")


@query("SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS y, lang AS name FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def class_map_round_trip(spark, sf_dir):
    """The languages of the documents as classes."""
    folder = _folder(spark)
    langs = C.dense_label_index(docs_of(spark, sf_dir).where("lang is not null").select("doc_id", "lang"), "lang").select("y", F.col("lang").alias("name")).distinct()
    writers.write_class_map(langs, folder)
    return readers.class_map(spark, folder)


@query(f"WITH {TF} SELECT 'documents  ' || count(*) AS line FROM documents UNION ALL SELECT 'vocabulary  ' || count(DISTINCT word) FROM tf UNION ALL SELECT 'label ' || source || ' ' || count(*) FROM documents GROUP BY source")
def corpus_info_round_trip(spark, sf_dir):
    folder = _folder(spark)
    writers.write_info(C.corpus_info(docs_of(spark, sf_dir), tf_of(spark, sf_dir), "source"), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(r"SELECT doc_id, lang || ',' || source AS topics, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def sgml_round_trip(spark, sf_dir):
    """Documents written as markup files, with their language and source as topics, and read back record by record."""
    folder = _folder(spark)
    docs = docs_of(spark, sf_dir).where("lang is not null and source is not null")
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    topics = [F.concat(F.lit("<D>"), x, F.lit("</D>")) for x in (F.col("doc_id").cast("string"), F.col("lang"), F.col("source"))]
    record = F.concat(F.lit("<DOC><TOPICS>"), *topics, F.lit("</TOPICS>\n<BODY>"), escaped, F.lit("</BODY></DOC>"))
    docs.select(record.alias("value")).write.text(folder)
    found = readers.sgml_documents(spark, folder, document="DOC", encoding="UTF-8")
    return found.select(F.col("topics")[0].cast("long").alias("doc_id"), F.concat_ws(",", F.slice("topics", 2, 2)).alias("topics"), F.trim("body").alias("body"))


@query(f"WITH {TF} SELECT * FROM tf WHERE word NOT IN ({STOP_SQL})")
def stop_word_file(spark, sf_dir):
    folder = _folder(spark)
    spark.createDataFrame([(f" {w} ",) for w in STOP], "value string").write.text(folder)
    return C.without_stop_words(tf_of(spark, sf_dir), readers.stop_words(spark, folder))


@query("SELECT doc_id, list_filter([lang, source], lambda t: t IN ('en', 'fr', 'src1', 'src2'))[1] AS topic FROM documents WHERE lang IN ('en', 'fr') OR source IN ('src1', 'src2')")
def topic_list_file(spark, sf_dir):
    folder = _folder(spark)
    spark.createDataFrame([(f"{t}  ",) for t in ("en", "fr", "src1", "src2")], "value string").write.text(folder)
    topic = C.first_topic(F.array("lang", "source"), readers.topic_list(spark, folder))
    return docs_of(spark, sf_dir).select("doc_id", topic.alias("topic")).where("topic is not null")


@query(f"WITH {TF}, {VOCAB}, r AS (SELECT word, row_number() OVER (ORDER BY total, word DESC) AS rank FROM voc), t AS (SELECT max(rank) AS t FROM r) SELECT doc_id, rank - (t - 200) AS word_id, n FROM tf JOIN r USING (word), t WHERE rank > t - 200")
def bottom_features(spark, sf_dir):
    """The last 200 words of the ascending rank of totals."""
    tf = checkpointed(tf_of(spark, sf_dir))
    totals = tf.groupBy("word").agg(F.sum("n").alias("total"))
    return C.bottom_features(tf, numbered(totals, "rank", F.asc("total"), F.desc("word")).select("word", "rank"), 200)


@query(f"WITH {TF}, {VOCAB}, r AS (SELECT word, row_number() OVER (ORDER BY total, word DESC) AS rank FROM voc) SELECT doc_id, rank - 1 AS word_id, n FROM tf JOIN r USING (word) WHERE rank > 1")
def all_features_but_the_lowest(spark, sf_dir):
    tf = checkpointed(tf_of(spark, sf_dir))
    totals = tf.groupBy("word").agg(F.sum("n").alias("total"))
    return C.bottom_features(tf, numbered(totals, "rank", F.asc("total"), F.desc("word")).select("word", "rank"), -1)


# The corpus of the generator: three classes over four words, a drawn document for each of the table.
_PRIOR, _WORDS = [0.2, 0.5, 0.3], [[0.25, 0.25, 0.25, 0.25], [0.5, 0.25, 0.125, 0.125], [0.125, 0.125, 0.25, 0.5]]
_DRAW = lambda share, weights: " + ".join(f"CASE WHEN {share} >= {sum(weights[:i]) / sum(weights)!r} THEN 1 ELSE 0 END" for i in range(1, len(weights)))
_SYNTHETIC = f"""g AS (SELECT i AS doc_id, {_DRAW(portable_hash_sql("i", generator.CLASS_SEED) + " / 4294967296e0", _PRIOR)} AS y FROM (SELECT doc_id AS i FROM documents)),
w AS (SELECT doc_id, y, {portable_hash_sql("doc_id || '-' || k", generator.WORD_SEED)} / 4294967296e0 AS u FROM g, (SELECT unnest(range(1, 41)) AS k)),
gtf AS (SELECT doc_id, 1 + CASE y {" ".join(f"WHEN {y} THEN {_DRAW('u', row)}" for y, row in enumerate(_WORDS))} END AS word_id, count(*) AS n FROM w GROUP BY ALL)"""


@query(f"WITH {_SYNTHETIC}, c AS (SELECT g.doc_id, g.y, i, coalesce(n, 0) AS n FROM g CROSS JOIN (SELECT unnest(range(1, 5)) AS i) p LEFT JOIN gtf ON gtf.doc_id = g.doc_id AND gtf.word_id = i) SELECT y, string_agg(CAST(CAST(n AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS counts, count(*) OVER (PARTITION BY y) AS documents FROM c GROUP BY doc_id, y")
def synthetic_corpus(spark, sf_dir):
    """A drawn document for each id of the table, written as dense CSV in two goes (the second appended) and read back."""
    folder = _folder(spark)
    docs, tf = generator.synthetic_corpus(docs_of(spark, sf_dir).select("doc_id"), 40, _PRIOR, _WORDS)
    rows, first = C.dense_rows(docs, tf, 4), portable_hash(F.col("doc_id"), 4) % 2 == 0
    writers.write_dense_csv(rows.where(first), folder)
    writers.write_dense_csv(rows.where(~first), folder, mode="append")
    found = readers.dense_csv(spark, folder)
    counts = found.select("y", F.concat_ws(",", F.transform("features", lambda x: x.cast("bigint").cast("string"))).alias("counts"))
    return counts.join(found.groupBy("y").agg(F.count("*").alias("documents")), "y")


_SPLIT = f"d AS (SELECT doc_id, lang, CASE WHEN {portable_hash_sql('doc_id', 3)} % 10 < 7 THEN 0 ELSE 1 END AS part FROM documents)"
_STEPS_SQL = f"""{TF}, d AS (SELECT doc_id, quality AS y, CASE WHEN {portable_hash_sql('doc_id', 3)} % 10 < 7 THEN 0 ELSE 1 END AS part FROM labels WHERE quality IS NOT NULL),
kept AS (SELECT word FROM tf JOIN d USING (doc_id) WHERE part = 0 GROUP BY word HAVING sum(n) >= 2),
ctf AS MATERIALIZED (SELECT * FROM tf WHERE word IN (SELECT word FROM kept) AND word NOT IN ({STOP_SQL}))"""
_RANKED = _MI[_MI.index("seen AS") :].replace("FROM tf JOIN", "FROM ctf JOIN")


@query(f"""WITH {_STEPS_SQL}, lab AS (SELECT doc_id, y FROM d WHERE part = 0), size AS (SELECT y, count(*) AS size FROM lab GROUP BY y), {_RANKED},
r AS (SELECT word, row_number() OVER (ORDER BY round(mi, 12) DESC, word DESC) AS rank FROM info QUALIFY rank <= 40),
k AS (SELECT ctf.doc_id, rank, n * 10000e0 / sum(n) OVER (PARTITION BY doc_id) AS n FROM ctf JOIN r USING (word)),
x AS (SELECT d.part, d.y, d.doc_id, p.i, coalesce(k.n, 0e0) AS n FROM (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM k)) d CROSS JOIN (SELECT unnest(range(1, 41)) AS i) p LEFT JOIN k ON k.doc_id = d.doc_id AND k.rank = p.i)
SELECT part, y, CAST(i AS INTEGER) AS i, round(sum(n), 5) AS total, count(*) AS documents FROM x GROUP BY ALL""")
def prepared_dataset(spark, sf_dir):
    """Stop words, rare words, features by information, L1 scaling, exported and loaded again: sums of every feature by part and class."""
    folder = _folder(spark)
    docs = labelled(spark, sf_dir).withColumn("part", F.when(portable_hash(F.col("doc_id"), 3) % 10 < 7, 0).otherwise(1))
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    found = preparation.prepare(stored(tf_of(spark, sf_dir)), docs, [("stop_words", stop), ("rare_words", 2), ("scale_l1", 10000)], 40)
    preparation.export(found, spark.createDataFrame([(0, "bad"), (1, "good")], "y int, name string"), folder)
    data = preparation.load(spark, folder)
    rows = data.train.withColumn("part", F.lit(0)).unionByName(data.test.withColumn("part", F.lit(1)))
    return rows.select("part", "y", F.posexplode("features").alias("i", "n")).groupBy("part", "y", (F.col("i") + 1).alias("i")).agg(F.round(F.sum("n"), 5).alias("total"), F.count("*").alias("documents"))


def _grid_sql(topic: str, number: int) -> str:
    lab = f"SELECT doc_id, CASE WHEN lang = '{topic}' THEN 0 ELSE 1 END AS y FROM d WHERE part = 0"
    return f"""(WITH {TF}, {_SPLIT}, ctf AS (SELECT * FROM tf), lab AS ({lab}), size AS (SELECT y, count(*) AS size FROM lab GROUP BY y), {_RANKED},
r AS (SELECT word, row_number() OVER (ORDER BY round(mi, 12) DESC, word DESC) AS rank FROM info QUALIFY rank <= {number}), used AS (SELECT DISTINCT doc_id FROM tf JOIN r USING (word))
SELECT '{topic}' AS topic, {number} AS features, name, n FROM (SELECT CASE part WHEN 0 THEN 'train' ELSE 'test' END AS name, count(*) AS n FROM d SEMI JOIN used USING (doc_id) GROUP BY part UNION ALL SELECT 'words', count(*) FROM r))"""


@query(" UNION ALL ".join(_grid_sql(t, n) for t in TOPICS for n in FEATURES))
def topic_grid(spark, sf_dir):
    """Binary datasets for each topic and number of features: the counters of each export."""
    folder = _folder(spark)
    docs = docs_of(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), F.when(portable_hash(F.col("doc_id"), 3) % 10 < 7, 0).otherwise(1).alias("part"))
    preparation.topic_grid(stored(tf_of(spark, sf_dir)), docs, TOPICS, FEATURES, [("scale_l1", 10000)], folder)
    out = None
    for topic in TOPICS:
        for number in FEATURES:
            own = readers.counters(spark, f"{folder}/{topic}-{number}/info").select(F.lit(topic).alias("topic"), F.lit(number).alias("features"), "name", "n")
            out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {TF}, {VOCAB}, w AS (SELECT word, row_number() OVER (ORDER BY word) AS word_id FROM voc), d AS (SELECT doc_id, source AS label, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5 THEN 1 ELSE 0 END AS part FROM documents),
m AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY label, doc_id) AS new_id FROM d) SELECT part, label, CAST(count(DISTINCT m.doc_id) AS BIGINT) AS documents, CAST(sum(tf.n * w.word_id % 1000003) AS BIGINT) AS mark FROM m JOIN tf USING (doc_id) JOIN w USING (word) GROUP BY part, label""")
def resplit_round_trip(spark, sf_dir):
    """Five test documents a class; triples and labels of both parts written and read back by their lines."""
    folder, tf = _folder(spark), checkpointed(tf_of(spark, sf_dir))
    ids = tf.join(C.vocabulary(tf).select("word", "word_id"), "word").select("doc_id", "word_id", "n")
    preparation.resplit(docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("label")), ids, 5, folder)
    out = []
    for part, name in ((0, "train"), (1, "test")):
        labels = readers.positional(spark, f"{folder}/{name}.label", "label")
        rows = readers.triples(spark, f"{folder}/{name}.data").join(labels, F.col("doc_id") == F.col("pos"))
        out.append(rows.groupBy(F.lit(part).alias("part"), "label").agg(F.count_distinct("doc_id").alias("documents"), F.sum(F.col("n").cast("long") * F.col("word_id") % 1000003).cast("long").alias("mark")))
    return out[0].unionByName(out[1])


def _summary_sql(*tables: int) -> str:
    """The lines of the averages over the first so many runs, table after table."""
    parts, lines = [_EVAL], []
    for n in tables:
        parts.append(f"a{n} AS (SELECT avg(a) AS a FROM (SELECT avg(CASE WHEN y = predicted THEN 1e0 ELSE 0e0 END) AS a FROM rows WHERE run_id < {n} GROUP BY run_id))")
        parts.append(f"s{n} AS (SELECT y, avg(round(p, 4)) AS p, avg(round(r, 4)) AS r, avg(round(f, 4)) AS f, avg(support) AS support FROM fig WHERE run_id < {n} GROUP BY y)")
        lines.append(f"SELECT rpad(CAST(y AS VARCHAR), 12, ' ') || ' ' || format('{{:6.2f}} {{:6.2f}} {{:6.2f}} {{:6.0f}}', p, r, f, support) AS line FROM s{n}")
        lines += [f"SELECT format('Acc: {{:6.4f}}', a) FROM a{n}", f"SELECT 'classes: ' || count(*) FROM s{n}"]
    return ", ".join(parts) + " " + " UNION ALL ".join(lines)


def _write_average(rows, folder, mode="overwrite"):
    averages = metrics.fold_average(metrics.class_figures(rows, "run_id"), "y").withColumn("name", F.col("y").cast("string"))
    whole = metrics.accuracy(rows, "run_id").agg(F.avg("accuracy").alias("accuracy"))
    writers.write_summary(averages.join(F.broadcast(whole), F.lit(True)), folder, mode)


@query(_summary_sql(5))
def summary_table(spark, sf_dir):
    folder = _folder(spark)
    _write_average(_evaluated(spark, sf_dir), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


@query(_summary_sql(2, 4, 5))
def appended_averages(spark, sf_dir):
    """The averages of the first two, four and five folds, each appended to the same summary."""
    folder, rows = _folder(spark), _evaluated(spark, sf_dir)
    for runs in (2, 4, 5):
        _write_average(rows.where(F.col("run_id") < runs), folder, "append")
    return spark.read.text(folder).select(F.col("value").alias("line"))
