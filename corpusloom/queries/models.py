"""Queries of models and evaluation: naive Bayes, EM, several components, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import NotConvergedError
from ..functions.scalar import log_factorial as ln_factorial
from ..functions.scalar import portable_hash_sql
from ..operators import metrics
from ..operators.split import stratified_folds
from ..operators.terms import packed_words
from ..plans import mixture as M
from ..session import checkpointed, stored, table
from .corpus import STOP, STOP_SQL, TF, VOCAB, labelled, tf_of

QUERIES: dict = {}
SQL: dict[str, str] = {}
ONE, MANY = [1, 1], [2, 3]
#: Loops of a converged fit, beyond which the query fails.
LOOPS = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def features(spark, sf_dir, rows=False):
    """(tf(doc_id, word_id, n), words): the whole vocabulary without stop words and words found once, packed; ``rows``: the terms are written too."""
    tf = M.packed_corpus(*packed_words(table(spark, sf_dir, "documents"), STOP, 2))
    return M.written(tf) if rows else tf, M.word_count(tf)


def _documents(spark, sf_dir):
    """docs(run_id, doc_id, y): all documents, y null where the quality is not known."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labelled(spark, sf_dir), "doc_id", "left")
    return checkpointed(docs.select(F.lit(0).alias("run_id"), "doc_id", "y"))


# SQL of the engine: lists of component owners, then CTEs for theta, scores and responsibilities.
_X = f"{TF}, {VOCAB}, top AS MATERIALIZED (SELECT word FROM voc WHERE total >= 2 AND word NOT IN ({STOP_SQL})), x AS MATERIALIZED (SELECT tf.doc_id, tf.word AS word_id, tf.n FROM tf SEMI JOIN top USING (word))"
_WORDS = "(SELECT CAST(count(*) AS DOUBLE) FROM top)"
_BASE = f"{_X}, len AS (SELECT doc_id, sum(n) AS l FROM x GROUP BY doc_id), docs AS (SELECT d.doc_id, l.quality AS y FROM documents d LEFT JOIN labels l USING (doc_id))"


def _owners(counts: list[int]) -> str:
    rows = [(k, y) for k, y in enumerate(y for y, m in enumerate(counts) for _ in range(m))]
    return "part AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {y})" for k, y in rows) + ") v(k, y))"


def _theta(i: int, resp: str) -> str:
    return f"""cnt{i} AS (SELECT k, word_id, sum(w * n) AS c FROM {resp} JOIN x USING (doc_id) GROUP BY ALL),
base{i} AS (SELECT p.k, p.y AS owner, ln((coalesce(s.s, 0) + 1e0) / (sum(coalesce(s.s, 0)) OVER () + count(*) OVER ())) AS lp, ln(coalesce(t.t, 0) + {_WORDS}) AS lt
  FROM part p LEFT JOIN (SELECT k, sum(w) AS s FROM {resp} GROUP BY k) s USING (k) LEFT JOIN (SELECT k, sum(c) AS t FROM cnt{i} GROUP BY k) t USING (k))"""


def _score(i: int) -> str:
    return f"""sc{i} AS (SELECT d.doc_id, d.y, b.k, b.owner, b.lp - coalesce(len.l, 0) * b.lt + coalesce(s.s, 0e0) AS score FROM docs d CROSS JOIN base{i} b LEFT JOIN len USING (doc_id)
  LEFT JOIN (SELECT x.doc_id, c.k, sum(x.n * ln(c.c + 1e0)) AS s FROM x JOIN cnt{i} c USING (word_id) GROUP BY ALL) s ON s.doc_id = d.doc_id AND s.k = b.k)"""


def _resp(i: int) -> str:
    return f"""re{i} AS (SELECT doc_id, y, k, score, exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY doc_id) AS w FROM
  (SELECT *, max(score) OVER (PARTITION BY doc_id) AS m FROM sc{i} WHERE y IS NULL OR y = owner))"""


def _pred(i: int) -> str:
    return f"""cls AS (SELECT doc_id, owner, max(m) + ln(sum(exp(score - m))) AS score FROM (SELECT *, max(score) OVER (PARTITION BY doc_id, owner) AS m FROM sc{i}) GROUP BY ALL),
pred AS (SELECT doc_id, CAST(arg_max(owner, (score, -owner)) AS INTEGER) AS predicted FROM cls GROUP BY doc_id)"""


_HARD = "start AS (SELECT d.doc_id, p.k, 1e0 AS w FROM docs d JOIN part p ON p.y = d.y)"


def _random(counts: list[int]) -> str:
    out, before = [], 0
    for y, m in enumerate(counts):
        cuts = ", ".join(["0e0", "1e0", *[f"{portable_hash_sql('doc_id', i)} / 4294967296e0" for i in range(1, m)]])
        out.append(f"SELECT doc_id, {before} + i AS k, q[i + 2] - q[i + 1] AS w FROM (SELECT doc_id, list_sort([{cuts}]) AS q FROM docs WHERE y = {y}), (SELECT CAST(unnest(range({m})) AS INTEGER) AS i)" if m > 1 else f"SELECT doc_id, {before}, 1e0 FROM docs WHERE y = {y}")
        before += m
    return "start AS (" + " UNION ALL ".join(out) + ")"


def _em_sql(counts: list[int], start: str, loops: int) -> str:
    parts = [_BASE, _owners(counts), start, _theta(0, "start"), _score(0), _resp(0)]
    for i in range(1, loops + 1):
        parts += [_theta(i, f"re{i - 1}").replace(f"cnt{i} AS (", f"cnt{i} AS MATERIALIZED ("), _score(i), _resp(i).replace(f"re{i} AS (", f"re{i} AS MATERIALIZED (")]
    return "WITH " + ", ".join(parts)


@query("SELECT event_id, round(lgamma(CAST(event_id % 1000 + 1 AS DOUBLE)), 6) AS ln_factorial FROM events")
def log_factorial(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(ln_factorial(F.col("event_id") % 1000), 6).alias("ln_factorial"))


@query(f"""WITH {TF}, v AS (SELECT doc_id, sum(n) AS l, sum(lgamma(n + 1e0)) AS f, sum(n * ln(n)) AS e FROM tf GROUP BY doc_id)
SELECT doc_id, round(lgamma(l + 1e0) - f + e - l * ln(l), 4) AS logpmf FROM v""")
def multinomial_logpmf(spark, sf_dir):
    """The log density of each document's counts under its own frequencies."""
    rows = tf_of(spark, sf_dir).groupBy("doc_id").agg(F.sum("n").alias("l"), F.sum(ln_factorial(F.col("n"))).alias("f"), F.sum(F.col("n") * F.log("n")).alias("e"))
    return rows.select("doc_id", F.round(ln_factorial(F.col("l")) - F.col("f") + F.col("e") - F.col("l") * F.log("l"), 4).alias("logpmf"))


def _bayes(spark, sf_dir, counts=ONE):
    docs, (tf, words) = _documents(spark, sf_dir), features(spark, sf_dir)
    parts = M.several_parts(docs, counts)
    start = M.hard_start(docs, parts) if max(counts) == 1 else M.random_start(docs, counts)
    theta = M.maximise(start, tf, parts, words)
    return docs, tf, parts, theta, words


_NB = f"WITH {_BASE}, {_owners(ONE)}, {_HARD}, {_theta(0, 'start')}"


@query(f"{_NB} SELECT CAST(owner AS INTEGER) AS y, round(lp, 9) AS log_prior FROM base0")
def nb_prior(spark, sf_dir):
    return _bayes(spark, sf_dir)[3].base.select("y", F.round("log_prior", 9).alias("log_prior"))


@query(f"{_NB} SELECT CAST(b.owner AS INTEGER) AS y, top.word, round(ln(coalesce(c.c, 0e0) + 1e0) - b.lt, 9) AS log_p FROM base0 b CROSS JOIN top LEFT JOIN cnt0 c ON c.k = b.k AND c.word_id = top.word")
def nb_word_prob(spark, sf_dir):
    _, tf, _, theta, _ = _bayes(spark, sf_dir)
    every = M.numbered_words(tf).select("word_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    joined = every.join(theta.seen, ["k", "word_id"], "left").join(F.broadcast(theta.base), "k")
    return joined.select("y", F.col("word_id").alias("word"), F.round(F.coalesce("log_count", F.lit(0.0)) - F.col("log_total"), 9).alias("log_p"))


@query(f"{_NB}, {_score(0)} SELECT doc_id, CAST(k AS INTEGER) AS k, round(score, 3) AS score FROM sc0")
def nb_scores(spark, sf_dir):
    docs, tf, _, theta, _ = _bayes(spark, sf_dir)
    return M.scores(docs, tf, theta).select("doc_id", "k", F.round("score", 3).alias("score"))


@query(f"{_NB}, {_score(0)}, {_pred(0)} SELECT p.doc_id, p.predicted FROM pred p JOIN docs d USING (doc_id) WHERE d.y IS NULL")
def nb_predict(spark, sf_dir):
    docs, tf, _, theta, _ = _bayes(spark, sf_dir)
    return M.predict(docs.where("y is null"), tf, theta).select("doc_id", "predicted")


@query(f"{_NB}, {_score(0)}, {_resp(0)} SELECT doc_id, CAST(k AS INTEGER) AS k, round(w, 7) AS w FROM re0")
def em_estep(spark, sf_dir):
    docs, tf, _, theta, _ = _bayes(spark, sf_dir)
    return M.responsibilities(M.scores(docs, tf, theta)).select("doc_id", "k", F.round("w", 7).alias("w"))


def _one_step(spark, sf_dir, loops):
    docs, tf, parts, theta, words = _bayes(spark, sf_dir)
    return docs, tf, M.expectation_maximisation(docs, tf, parts, theta, words, epsilon=-1.0, max_loops=loops)


@query(f"{_em_sql(ONE, _HARD, 1)} SELECT CAST(k AS INTEGER) AS k, round(lp, 7) AS log_prior, round(lt, 7) AS log_total FROM base1")
def em_mstep(spark, sf_dir):
    fit = _one_step(spark, sf_dir, 1)[2]
    return fit.theta.base.select("k", F.round("log_prior", 7).alias("log_prior"), F.round("log_total", 7).alias("log_total"))


@query(f"{_NB}, {_score(0)}, {_resp(0)} SELECT round(sum(w * score), 2) AS q FROM re0")
def em_loglik(spark, sf_dir):
    docs, tf, _, theta, _ = _bayes(spark, sf_dir)
    return M.objective(M.responsibilities(M.scores(docs, tf, theta))).select(F.round(F.col("q").cast("double"), 2).alias("q"))


@query(f"{_em_sql(ONE, _HARD, 2)} SELECT doc_id, CAST(k AS INTEGER) AS k, round(w, 5) AS w FROM re2")
def em_fixed_iterations(spark, sf_dir):
    return _one_step(spark, sf_dir, 2)[2].resp.select("doc_id", "k", F.round("w", 5).alias("w"))


def _require(converged: bool) -> None:
    if not converged:
        raise NotConvergedError(f"not converged after {LOOPS} loops")


@query()
def em_converged(spark, sf_dir):
    docs, tf, parts, theta, words = _bayes(spark, sf_dir)
    fit = M.expectation_maximisation(docs, tf, parts, theta, words, max_loops=LOOPS)
    _require(fit.converged)
    return M.predict(docs.where("y is null"), tf, fit.theta).select("doc_id", "predicted", F.lit(fit.loops).alias("loops"))


_M2O = f"WITH {_BASE}, {_owners(MANY)}, {_random(MANY)}, {_theta(0, 'start')}"


@query(f"{_M2O} SELECT CAST(k AS INTEGER) AS k, CAST(owner AS INTEGER) AS y, round(lp, 8) AS log_prior, round(lt, 8) AS log_total FROM base0")
def m2o_nb_random(spark, sf_dir):
    theta = _bayes(spark, sf_dir, MANY)[3]
    return theta.base.select("k", "y", F.round("log_prior", 8).alias("log_prior"), F.round("log_total", 8).alias("log_total"))


_ASSIGNED = f"start AS (SELECT doc_id, CASE WHEN y = 0 THEN {portable_hash_sql('doc_id', 5)} % 2 ELSE 2 + {portable_hash_sql('doc_id', 5)} % 3 END AS k, 1e0 AS w FROM docs WHERE y IS NOT NULL)"


@query(f"WITH {_BASE}, {_owners(MANY)}, {_ASSIGNED}, {_theta(0, 'start')}, {_score(0)}, {_pred(0)} SELECT doc_id, predicted FROM pred")
def m2o_nb_assigned(spark, sf_dir):
    from ..functions.scalar import portable_hash

    docs, (tf, words) = _documents(spark, sf_dir), features(spark, sf_dir)
    h = portable_hash(F.col("doc_id"), 5)
    assignment = docs.where("y is not null").select("run_id", "doc_id", F.when(F.col("y") == 0, h % 2).otherwise(2 + h % 3).cast("int").alias("k"))
    model = M.MultinomialModel(docs, tf, words, MANY, assignment=assignment).train()
    return model.test(docs).select("doc_id", "predicted")


@query(f"{_em_sql(MANY, _random(MANY), 2)} SELECT doc_id, CAST(k AS INTEGER) AS k, round(w, 4) AS w FROM re2")
def m2o_em_fixed_iterations(spark, sf_dir):
    docs, tf, parts, theta, words = _bayes(spark, sf_dir, MANY)
    fit = M.expectation_maximisation(docs, tf, parts, theta, words, epsilon=-1.0, max_loops=2)
    return fit.resp.select("doc_id", "k", F.round("w", 4).alias("w"))


@query(f"{_M2O}, {_score(0)}, {_pred(0)} SELECT doc_id, predicted FROM pred")
def m2o_predict(spark, sf_dir):
    docs, tf, _, theta, _ = _bayes(spark, sf_dir, MANY)
    return M.predict(docs, tf, theta).select("doc_id", "predicted")


@query()
def m2o_em_converged(spark, sf_dir):
    docs, (tf, words) = _documents(spark, sf_dir), features(spark, sf_dir)
    model = M.MultinomialModel(docs, tf, words, MANY, semi=True, max_loops=LOOPS).train()
    _require(model.converged)
    return model.test(docs.where("y is null")).select("doc_id", "predicted", F.lit(model.loops).alias("loops"))


# Evaluation: five folds of the labelled documents; fold r is tested by a model of the other folds.
_FOLD = f"fd AS (SELECT doc_id, quality AS y, CAST((row_number() OVER (PARTITION BY quality ORDER BY {portable_hash_sql('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels WHERE quality IS NOT NULL)"
_EVAL = f"""WITH {_X}, len AS (SELECT doc_id, sum(n) AS l FROM x GROUP BY doc_id), {_FOLD},
run AS (SELECT DISTINCT fold AS run_id FROM fd), tr AS (SELECT r.run_id, f.doc_id, f.y FROM run r JOIN fd f ON f.fold <> r.run_id),
cnt AS (SELECT run_id, y AS k, word_id, sum(n) AS c FROM tr JOIN x USING (doc_id) GROUP BY ALL),
base AS (SELECT r.run_id, k.k, ln((coalesce(s.s, 0) + 1e0) / (sum(coalesce(s.s, 0)) OVER (PARTITION BY r.run_id) + 2)) AS lp, ln(coalesce(t.t, 0) + {_WORDS}) AS lt
  FROM run r CROSS JOIN (SELECT unnest([0, 1]) AS k) k LEFT JOIN (SELECT run_id, y AS k, count(*) AS s FROM tr GROUP BY ALL) s ON s.run_id = r.run_id AND s.k = k.k LEFT JOIN (SELECT run_id, k, sum(c) AS t FROM cnt GROUP BY ALL) t ON t.run_id = r.run_id AND t.k = k.k),
sc AS (SELECT b.run_id, f.doc_id, f.y, b.k, b.lp - coalesce(len.l, 0) * b.lt + coalesce(s.s, 0e0) AS score FROM fd f JOIN base b ON b.run_id = f.fold LEFT JOIN len USING (doc_id)
  LEFT JOIN (SELECT c.run_id, x.doc_id, c.k, sum(x.n * ln(c.c + 1e0)) AS s FROM x JOIN cnt c USING (word_id) GROUP BY ALL) s ON s.run_id = b.run_id AND s.doc_id = f.doc_id AND s.k = b.k),
rows AS (SELECT run_id, doc_id, any_value(y) AS y, CAST(arg_max(k, (score, -k)) AS INTEGER) AS predicted FROM sc GROUP BY run_id, doc_id),
con AS (SELECT run_id, y, predicted, count(*) AS n FROM rows GROUP BY ALL),
sup AS (SELECT run_id, y, sum(n) AS support FROM con GROUP BY ALL), gu AS (SELECT run_id, predicted AS y, sum(n) AS guessed FROM con GROUP BY ALL), hit AS (SELECT run_id, y, n AS hit FROM con WHERE y = predicted),
pr AS (SELECT run_id, y, coalesce(support, 0) AS support, coalesce(hit / nullif(guessed, 0), 0e0) AS p, coalesce(hit / nullif(support, 0), 0e0) AS r FROM sup FULL JOIN gu USING (run_id, y) LEFT JOIN hit USING (run_id, y)),
fig AS (SELECT run_id, y, CAST(support AS BIGINT) AS support, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0e0) AS f FROM pr)"""


def _evaluated(spark, sf_dir):
    docs = stratified_folds(labelled(spark, sf_dir), 5, "y")
    tf, words = features(spark, sf_dir)
    runs = F.array(*[F.lit(i) for i in range(5)])
    training = docs.select(F.explode(runs).alias("run_id"), "doc_id", "y", "fold").where("run_id <> fold").drop("fold")
    model = M.MultinomialModel(training, tf, words, ONE).train()
    test = docs.select(F.col("fold").alias("run_id"), "doc_id", "y")
    # A row a document, which the figures read several times.
    return stored(model.test(test.select("run_id", "doc_id")).join(test, ["run_id", "doc_id"]))


@query(f"{_EVAL} SELECT run_id, y, predicted, n FROM con")
def confusion(spark, sf_dir):
    return metrics.confusion(_evaluated(spark, sf_dir), "run_id")


@query(f"{_EVAL} SELECT run_id, round(avg(CASE WHEN y = predicted THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM rows GROUP BY run_id")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_evaluated(spark, sf_dir), "run_id").withColumn("accuracy", F.round("accuracy", 9))


@query(f"{_EVAL} SELECT run_id, y, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM fig")
def class_metrics(spark, sf_dir):
    return metrics.class_figures(_evaluated(spark, sf_dir), "run_id")


@query(f"{_EVAL} SELECT run_id, 'binary' AS average, round(f, 9) AS f1 FROM fig WHERE y = 1 UNION ALL SELECT run_id, 'macro', round(avg(f), 9) FROM fig GROUP BY run_id")
def f1_binary_macro(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    both = [metrics.f1_score(rows, x, "run_id").select("run_id", F.lit(x).alias("average"), F.round("f1", 9).alias("f1")) for x in ("binary", "macro")]
    return both[0].unionByName(both[1])


@query(f"""{_EVAL} SELECT run_id, CAST(y AS VARCHAR) AS name, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM fig
UNION ALL SELECT run_id, 'avg / total', round(sum(p * support) / sum(support), 4), round(sum(r * support) / sum(support), 4), round(sum(f * support) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM fig GROUP BY run_id""")
def classification_report(spark, sf_dir):
    return metrics.report(_evaluated(spark, sf_dir), "run_id")


@query(f"{_EVAL} SELECT y, round(avg(round(p, 4)), 8) AS precision, round(avg(round(r, 4)), 8) AS recall, round(avg(round(f, 4)), 8) AS f1, round(avg(support), 8) AS support FROM fig GROUP BY y")
def fold_average(spark, sf_dir):
    out = metrics.fold_average(metrics.class_figures(_evaluated(spark, sf_dir), "run_id"), "y")
    return out.select("y", *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1", "support")])
