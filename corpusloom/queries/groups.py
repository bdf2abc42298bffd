"""Queries of distances, trees, component searches, Gaussian mixtures and experiments."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import distance, tokens
from ..operators import corpus as C
from ..operators import metrics
from ..operators.split import stratified_folds
from ..plans import experiments, gmm, search, tree
from ..session import checkpoint_folder, checkpointed, stored, table
from ..sources import readers, writers
from .corpus import TF, TOP, VOCAB, labelled, tf_of, top_words
from .models import _EVAL, LOOPS, _evaluated, features

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Most frequent words that vectors count, and that the feature sets of an experiment take.
WIDTH, FEATURES = 100, (100, 300)
#: Loops of the Gaussian grid; cells that still move are marked.
GRID_LOOPS = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# One vector for each source and language: how often its documents use the most frequent words.
_VECTORS = f"""{TF}, {VOCAB}, {TOP.format(k=WIDTH)}, cell AS (SELECT d.lang, d.source, top.rank AS i, sum(tf.n) AS n FROM documents d JOIN tf USING (doc_id) JOIN top USING (word) WHERE d.lang IS NOT NULL AND d.source IS NOT NULL GROUP BY ALL),
grp AS (SELECT lang, source, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS y, dense_rank() OVER (ORDER BY source) - 1 AS doc_id FROM (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)),
v AS (SELECT g.y, g.doc_id, p.i, CAST(coalesce(c.n, 0) AS DOUBLE) AS x FROM grp g CROSS JOIN (SELECT unnest(range(1, {WIDTH} + 1)) AS i) p LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.i = p.i),
pair AS (SELECT a.y, a.doc_id AS i, b.doc_id AS j, a.i AS pos, a.x AS xa, b.x AS xb FROM v a JOIN v b ON a.y = b.y AND a.i = b.i AND a.doc_id < b.doc_id),
bin AS (SELECT y, i, j, sum(coalesce((xa - xb) * (xa - xb) / nullif(2 * (xa + xb), 0), 0)) AS distance FROM pair GROUP BY ALL),
mat AS (SELECT y, i, j, sum(abs(d)) AS distance FROM (SELECT y, i, j, sum(xa - xb) OVER (PARTITION BY y, i, j ORDER BY pos) AS d FROM pair) GROUP BY ALL)"""


def _vectors(spark, sf_dir):
    """run_id, y (language), doc_id (source) and x: as many rows as there are sources and languages, whatever the corpus."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and source is not null").select("doc_id", "lang", "source")
    tf = tf_of(spark, sf_dir)
    cells = C.ranked_features(tf, top_words(tf, WIDTH)).join(docs, "doc_id").groupBy("lang", "source", "word_id").agg(F.sum("n").alias("n"))
    # Numbers the few distinct languages and sources.
    groups = docs.select("lang", "source").distinct()
    langs = groups.select("lang").distinct().select("lang", (F.row_number().over(W.orderBy("lang")) - 1).cast("int").alias("y"))
    sources = groups.select("source").distinct().select("source", (F.row_number().over(W.orderBy("source")) - 1).cast("long").alias("_s"))
    own = cells.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("word_id").cast("int"), F.col("n").cast("double")))).alias("_m"))
    x = F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang").join(sources, "source").select(F.lit(0).alias("run_id"), "y", F.col("_s").alias("doc_id"), x.alias("x"))


def _distances(spark, sf_dir, name):
    rows = _vectors(spark, sf_dir)
    a, b = (rows.select("y", F.col("doc_id").alias(i), F.col("x").alias(f"x{i}")) for i in ("i", "j"))
    return a.join(b, "y").where("i < j").select("y", "i", "j", F.round(distance(name, F.col("xi"), F.col("xj")), 7).alias("distance"))


@query(f"WITH {_VECTORS} SELECT y, i, j, round(distance, 7) AS distance FROM bin")
def bin_bin_distance(spark, sf_dir):
    return _distances(spark, sf_dir, "bin")


@query(f"WITH {_VECTORS} SELECT y, i, j, round(distance, 7) AS distance FROM mat")
def match_distance(spark, sf_dir):
    return _distances(spark, sf_dir, "match")


@query(f"WITH {_VECTORS} SELECT y, i, j, round(distance, 7) AS distance FROM mat QUALIFY row_number() OVER (PARTITION BY y ORDER BY distance, i, j) = 1")
def nearest_pair(spark, sf_dir):
    return tree.nearest_pairs(_vectors(spark, sf_dir), "match").select("y", "i", "j", F.round("distance", 7).alias("distance"))


@query()
def hierarchy_tree(spark, sf_dir):
    return tree.trees(_vectors(spark, sf_dir), "match").withColumn("cut_value", F.round("cut_value", 7)).drop("run_id")


@query()
def tree_slice(spark, sf_dir):
    return tree.cut_by_count(tree.trees(_vectors(spark, sf_dir), "bin"), 2).drop("run_id")


def _searched(spark, sf_dir):
    """(docs with folds, tf, vectors of the first words) of the labelled documents."""
    docs = checkpointed(stratified_folds(labelled(spark, sf_dir), 3, "y"))
    tf, words = features(spark, sf_dir)
    return docs, tf, _counts(spark, sf_dir, docs), words


def _counts(spark, sf_dir, docs):
    """(doc_id, x): counts of the most frequent words; no row for each term is written or shuffled."""
    texts = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("_tokens"))
    totals = texts.select(F.explode("_tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # A few rows: as many as vectors are wide.
    ranks = checkpointed(top_words(totals, WIDTH))
    own = texts.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("_tokens").alias("word"))
    counts = own.join(F.broadcast(ranks), "word").groupBy("doc_id", F.col("rank").alias("word_id")).agg(F.count("*").alias("n"))
    return stored(C.dense_rows(docs, counts, WIDTH).select("doc_id", F.col("features").alias("x")))


@query()
def random_component_search(spark, sf_dir):
    docs, tf, _, words = _searched(spark, sf_dir)
    return search.random_component_count(docs, tf, words, [2, 3, 4], [0, 1, 2])


@query()
def tree_component_count_search(spark, sf_dir):
    docs, tf, vectors, words = _searched(spark, sf_dir)
    return search.tree_component_count(docs, tf, vectors, words, [1, 2], [0, 1, 2])


@query()
def tree_cut_value_search(spark, sf_dir):
    docs, tf, vectors, words = _searched(spark, sf_dir)
    value, cut = search.tree_cut_value(docs, tf, vectors, words, [1, 2], [0, 1, 2])
    return cut.select("doc_id", "part", F.lit(value).alias("cut_value"))


# Points: whole vectors and all classes; even ids are labelled.  SQL states sums, not densities of so many dimensions.
_SUMS = """v AS MATERIALIZED (SELECT vec_id AS doc_id, label AS k, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS a FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id % 2 = 0 AND label IS NOT NULL)),
total AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM embeddings WHERE vec_id % 2 = 0 AND label IS NOT NULL),
par AS MATERIALIZED (SELECT x.k, x.i, y.i AS j, CAST(count(*) AS DOUBLE) AS n, sum(x.a) AS sa, sum(y.a) AS sb, sum(x.a * y.a) AS sab FROM v x JOIN v y USING (doc_id, k) GROUP BY ALL)"""
_CELLS = "SELECT k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(pi, 8) AS pi, round(mu, 8) AS mu, round(cov, 8) AS cov FROM "


def _points(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), x.alias("x"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("y"))


def _rounded(cells):
    return cells.select("k", "i", "j", *[F.round(x, 8).alias(x) for x in ("pi", "mu", "cov")])


@query(f"WITH {_SUMS}, p AS (SELECT k, i, j, n / t AS pi, sa / n AS mu, sab / n - sa / n * sb / n AS cov FROM par, total) {_CELLS} p")
def gmm_params(spark, sf_dir):
    return _rounded(gmm.param_cells(gmm.class_params(_points(spark, sf_dir))))


@query()
def gmm_predict(spark, sf_dir):
    points = _points(spark, sf_dir)
    return gmm.predict(points, gmm.class_params(points))


@query()
def gmm_em_step(spark, sf_dir):
    points = _points(spark, sf_dir)
    step = gmm.em_step(gmm.with_states(points), {0: gmm.fit_labelled(points)}, gmm.centre_of(points))
    return _rounded(gmm.param_cells(gmm.params_of(spark, step[0])))


@query()
def gmm_em_converged(spark, sf_dir):
    points = _points(spark, sf_dir)
    fit = gmm.expectation_maximisation(points, max_loops=LOOPS, must=True)
    return gmm.predict(points.where("y is null"), fit.params).withColumn("loops", F.lit(fit.loops))


@query(f"""WITH {_SUMS}, one AS (SELECT p.*, (p.sa - x.a) / (p.n - 1) AS ma, (p.sb - y.a) / (p.n - 1) AS mb, (p.sab - x.a * y.a) / (p.n - 1) AS mab FROM par p JOIN v x ON x.k = p.k AND x.i = p.i JOIN v y ON y.k = p.k AND y.i = p.j AND y.doc_id = x.doc_id WHERE p.n > 1),
w AS (SELECT k, i, j, any_value(n) AS n, any_value(sa) AS sa, any_value(sb) AS sb, any_value(sab) AS sab, sum(ma) AS mu, sum(mab - ma * mb) AS cov FROM one GROUP BY k, i, j),
m AS (SELECT k, i, j, (n * (n - 1) + (t - n) * n) / (t * (t - 1)) AS pi, (mu + (t - n) * sa / n) / t AS mu, (cov + (t - n) * (sab / n - sa / n * sb / n)) / t AS cov FROM w, total) {_CELLS} m""")
def gmm_loo_average(spark, sf_dir):
    return _rounded(gmm.leave_one_out_params(_points(spark, sf_dir)))


@query()
def gmm_loo_scores(spark, sf_dir):
    """Every labelled vector scored by the fit that leaves it out, and the class that this fit finds."""
    rows = gmm.leave_one_out_scores(_points(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.max_by("k", F.struct("score", -F.col("k"))).alias("predicted"), F.round(F.max(F.when(F.col("y") == F.col("k"), F.col("score"))), 6).alias("score"))


@query()
def gmm_scaling_grid(spark, sf_dir):
    points = _points(spark, sf_dir)
    test = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("y")).join(points.where("y is null").drop("y"), "doc_id")
    return gmm.scaling_grid(points, test.select("doc_id", "x", "y"), max_loops=GRID_LOOPS)


def _experiment(spark, sf_dir):
    docs = labelled(spark, sf_dir)
    return docs, table(spark, sf_dir, "documents").select("doc_id").join(docs, "doc_id", "left_anti")


@query()
def exp_1a(spark, sf_dir):
    """The words of most information in each run's own labelled documents, plain and scaled."""
    (docs, more), (tf, _) = _experiment(spark, sf_dir), features(spark, sf_dir)
    runs = checkpointed(experiments.fold_runs(docs, 5))
    sets = experiments.information_sets(runs, tf, list(FEATURES), 1000)
    return experiments.feature_selection(docs, more, sets, runs=runs)


@query()
def exp_1b(spark, sf_dir):
    (docs, more), (tf, words) = _experiment(spark, sf_dir), features(spark, sf_dir)
    return experiments.labelled_sizes(docs, more, tf, words, [100, 200], tries=5)


@query()
def exp_1c(spark, sf_dir):
    (docs, _), (tf, words) = _experiment(spark, sf_dir), features(spark, sf_dir)
    return experiments.scaling_kinds(docs, tf, words, 10_000, k=5)


@query()
def exp_2a(spark, sf_dir):
    (docs, more), (tf, words) = _experiment(spark, sf_dir), features(spark, sf_dir)
    vectors = _counts(spark, sf_dir, docs)
    return experiments.group_assumption(docs, more, tf, vectors, words, 100, [2, 3], tries=5)


_TWO = "CAST(format('{:.2f}', round(%s, 4)) AS DOUBLE)"


@query(f"""{_EVAL} SELECT CAST(y AS VARCHAR) AS name, round(avg({_TWO % "p"}), 8) AS precision, round(avg({_TWO % "r"}), 8) AS recall, round(avg({_TWO % "f"}), 8) AS f1, CAST(sum(support) AS BIGINT) AS support,
round((SELECT avg(a) FROM (SELECT avg(CASE WHEN y = predicted THEN 1e0 ELSE 0e0 END) AS a FROM rows GROUP BY run_id)), 8) AS accuracy FROM fig GROUP BY y""")
def report_parse_average(spark, sf_dir):
    """Reports of five folds written as text files, read again and averaged."""
    rows = _evaluated(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/reports-{uuid.uuid4().hex}"
    for run in range(5):
        own = rows.where(F.col("run_id") == run)
        figures = metrics.report(own, "run_id").drop("run_id")
        writers.write_report(spark, writers.report_text(figures, metrics.accuracy(own, "run_id").first()["accuracy"], own.count()), f"{folder}/run-{run}")
    runs = [f"{folder}/{name}" for name in readers.folders(spark, folder)]
    found = readers.reports(spark, runs).where("name <> 'avg / total'")
    return found.groupBy("name").agg(*[F.round(F.avg(x), 8).alias(x) for x in ("precision", "recall", "f1")], F.sum("support").cast("long").alias("support"), F.round(F.avg("accuracy"), 8).alias("accuracy"))
