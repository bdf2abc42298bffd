"""Fixtures with known results: corpus preparation, selection, trees, models, readers and writers."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from corpusloom import catalog
from corpusloom.errors import CorpusError, NotConvergedError, ParameterError, UnknownMethodError
from corpusloom.functions.scalar import bin_distance, log_factorial, match_distance, simplex
from corpusloom.operators import corpus as C
from corpusloom.operators import selection, split
from corpusloom.plans import gmm
from corpusloom.plans import mixture as M
from corpusloom.plans.tree import cut_by_count, grow, trees
from corpusloom.queries import models
from corpusloom.session import numbered_within
from corpusloom.sources import readers, writers

VOCABULARY = "a name atheism resources last modified december version atheist adaffdaf".split()
TRAIN = "1 1 4; 1 2 2; 1 3 10; 1 4 4; 1 5 2; 1 6 1; 1 7 1; 1 8 1; 1 9 3; 1 10 9; 2 7 1; 2 1 2; 2 2 4; 3 2 3; 3 6 1; 3 3 3; 3 5 1; 3 7 1; 3 9 8; 3 10 5; 4 2 2; 4 9 4; 5 10 1; 5 2 8; 5 7 1; 5 3 8; 5 9 6; 6 10 5; 6 2 2; 6 9 4; 6 3 1"
LABELS = [4, 4, 1, 1, 2, 2]
VECTORS = np.array([(1, 2, 3, 4), (1, 2, 3, 4), (2, 8, 6, 4), (2, 8, 6, 4), (4, 5, 3, 4), (4, 5, 3, 4), (7, 1, 2, 6), (7, 1, 2, 6), (4, 2, 7, 4), (4, 2, 7, 4)], float)


@pytest.fixture(scope="module")
def tf(spark):
    return spark.createDataFrame([tuple(map(int, x.split())) for x in TRAIN.split(";")], "doc_id long, word_id int, n int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i + 1, y) for i, y in enumerate(LABELS)], "doc_id long, y int")


def test_basic_process(spark, tf, labels):
    words = spark.createDataFrame(list(enumerate(VOCABULARY, 1)), "word_id int, word string")
    named = tf.join(words, "word_id").select("doc_id", "word", "n")
    left = C.without_rare_words(C.without_stop_words(named, spark.createDataFrame([("a",)], "word string")), named)
    ranks = spark.createDataFrame([(w, i) for i, w in enumerate((w for w in VOCABULARY if w not in ("a", "version")), 1)], "word string, rank int")
    rows = C.dense_rows(labels, C.ranked_features(left, ranks), 8).orderBy("doc_id").collect()
    want = [[2, 10, 4, 2, 1, 1, 3, 9], [4, 0, 0, 0, 0, 1, 0, 0], [3, 3, 0, 1, 1, 1, 8, 5], [2, 0, 0, 0, 0, 0, 4, 0], [8, 8, 0, 0, 0, 1, 6, 1], [2, 1, 0, 0, 0, 0, 4, 5]]
    assert [r["features"] for r in rows] == want and [r["y"] for r in rows] == LABELS


def test_mutual_information(tf, labels):
    named = tf.select("doc_id", (F.col("word_id") - 1).cast("string").alias("word"), "n")
    found = {r["word"]: r["mi"] for r in selection.mutual_information(named, labels).collect()}
    want = [0.0918295834, 0.0792481250, 0.1251629167, 0.0316689088, 0.0584962501, 0.0251629167, 0.0251629167, 0.0316689088, 0.1251629167, 0.0918295834]
    assert [found[str(i)] for i in range(10)] == pytest.approx(want, abs=1e-9)


def test_scaling_gives_the_length(tf):
    one = C.scaled(tf, 7, "l1").groupBy("doc_id").agg(F.sum("n").alias("s")).collect()
    two = C.scaled(tf, 7, "l2").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("n")).alias("s")).collect()
    assert [r["s"] for r in one] == pytest.approx([7] * 6) and [r["s"] for r in two] == pytest.approx([49] * 6)
    with pytest.raises(UnknownMethodError):
        C.scaled(tf, 7, "l3")


def test_scalars(spark):
    row = spark.range(1).select(*[log_factorial(F.lit(x)).alias(f"f{x}") for x in (0, 23, 99, 100)], simplex(F.lit(5), 100).alias("s")).first()
    assert [row[f"f{x}"] for x in (0, 23, 99, 100)] == pytest.approx([0, 51.60667556776438, 359.1342053695754, 363.73937555556347], abs=1e-9)
    assert sum(row["s"]) == pytest.approx(1) and min(row["s"]) >= 0
    x, y = F.array(*[F.lit(1.0)] * 5), F.array(*[F.lit(float(i)) for i in range(5)])
    assert spark.range(1).select(bin_distance(x, y), match_distance(x, y)).first() == (pytest.approx(1.9 + 1 / 6), 9)


@pytest.mark.parametrize(
    "name, cuts",
    [
        ("bin", [(0, 0, 0), (2, 0, 1), (4, 0, 2), (3, 1.1794871794871795, 5), (6, 0, 4), (5, 1.5343441724515894, 6), (1, 1.5977289377289376, 7), (8, 0, 3), (7, 2.6924196174196178, 8)]),
        ("match", [(0, 0, 0), (2, 0, 1), (4, 0, 2), (6, 0, 4), (5, 5, 5), (8, 0, 3), (7, 6.5, 6), (3, 13.333333333333336, 7), (1, 22.5, 8)]),
    ],
)
def test_trees(spark, name, cuts):
    leaves, found = grow(VECTORS, name)
    assert leaves == [0, 1, 2, 3, 4, 5, 8, 9, 6, 7]
    assert sorted(found) == [pytest.approx(x) for x in sorted(cuts)]
    df = spark.createDataFrame([(0, 1, i, list(v)) for i, v in enumerate(VECTORS.tolist())], "run_id int, y int, doc_id long, x array<double>")
    parts = {r["doc_id"]: r["part"] for r in cut_by_count(trees(df, name), 4).collect()}
    assert [parts[i] for i in range(0, 10, 2)] == [parts[i] for i in range(1, 10, 2)] and len(set(parts.values())) == 5


def test_tree_merges_like_plain_search():
    data = np.random.default_rng(1).integers(0, 9, (40, 5)).astype(float)
    clusters = {i: [i] for i in range(40)}
    order = []
    while len(clusters) > 1:
        ids = sorted(clusters)
        mean = {i: data[clusters[i]].sum(0) / len(clusters[i]) for i in ids}
        d, i, j = min((float(np.abs(np.cumsum(mean[i] - mean[j])).sum()), i, j) for k, i in enumerate(ids) for j in ids[k + 1 :])
        clusters[i] += clusters.pop(j)
        order.append(d)
    assert [v for _, v, _ in sorted(grow(data, "match")[1], key=lambda x: x[2])] == pytest.approx(order)


def test_naive_bayes_recovers_parameters(spark):
    prior, words = [0.2, 0.5, 0.15, 0.15], [(0.25, 0.25, 0.25, 0.25), (0.3, 0.4, 0.2, 0.1), (0.2, 0.2, 0.2, 0.4), (0.1, 0.3, 0.3, 0.3)]
    rng = np.random.default_rng(0)
    y = rng.choice(4, 1000, p=prior)
    x = np.array([rng.multinomial(100, words[k]) for k in y])
    tf = spark.createDataFrame([(i, w + 1, int(n)) for i, row in enumerate(x) for w, n in enumerate(row) if n], "doc_id long, word_id int, n int")
    docs = spark.createDataFrame([(0, i, int(k) if i % 10 < 6 else None) for i, k in enumerate(y)], "run_id int, doc_id long, y int")
    for semi in (False, True):
        model = M.MultinomialModel(docs if semi else docs.where("y is not null"), tf, 4, [1, 1, 1, 1], semi=semi, max_loops=5).train()
        base = {r["k"]: r for r in model.theta.base.collect()}
        seen = {(r["k"], r["word_id"]): r["log_count"] for r in model.theta.seen.collect()}
        for k in range(4):
            assert sum(abs(math.exp(seen[k, w + 1] - base[k]["log_total"]) - words[k][w]) for w in range(4)) < 0.04
            assert abs(math.exp(base[k]["log_prior"]) - (y[np.arange(1000) % 10 < 6] == k).mean()) < 0.05
    found = model.test(docs.where("y is null").select("run_id", "doc_id")).collect()
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in found]) > 0.7


def test_singular_gaussian():
    x = np.array([[0.0, 5.0], [1.0, 5.0]])
    got = gmm.log_density(x, np.array([0.0, 5.0]), np.array([[4.0, 0.0], [0.0, 0.0]]))
    assert got == pytest.approx(-0.5 * np.array([0, 0.25]) - 0.5 * math.log(2 * math.pi * 4))


def _mixture_fixture(spark, folder):
    """Six components and five classes that only the last four components tell apart."""
    rng = np.random.default_rng(7)
    label = np.arange(300) // 2 % 5
    x = rng.normal(0, 1, (300, 6)).astype(np.float32)
    x[:, 2:] += np.random.default_rng(8).normal(0, 3, (5, 4))[label].astype(np.float32)
    rows = [(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x.astype(float), label


def _fit(x, w):
    mu = [(w[:, k : k + 1] * x).sum(0) / w[:, k].sum() for k in range(w.shape[1])]
    return w.sum(0) / w.sum(), mu, [((x - m).T * w[:, k]) @ (x - m) / w[:, k].sum() for k, m in enumerate(mu)]


def _log_scores(x, pi, mu, cov):
    return np.array([[math.log(p) - 0.5 * ((v - m) @ np.linalg.inv(c) @ (v - m) + math.log(np.linalg.det(2 * math.pi * c))) for p, m, c in zip(pi, mu, cov)] for v in x])


def test_mixture_reads_whole_vectors_and_all_classes(spark, tmp_path):
    x, label = _mixture_fixture(spark, tmp_path)
    known = np.arange(300) % 2 == 0
    hard = np.eye(5)[label]
    params, moved, loops = _fit(x[known], hard[known]), math.inf, 0
    while moved > 1e-3:
        s = _log_scores(x, *params)
        w = np.exp(s - s.max(1, keepdims=True))
        w = np.where(known[:, None], hard, w / w.sum(1, keepdims=True))
        new = _fit(x, w)
        moved, params, loops = sum(((a - b) ** 2).sum() for a, b in zip(new[1], params[1])), new, loops + 1
    want = dict(zip(np.flatnonzero(~known).tolist(), _log_scores(x[~known], *params).argmax(1).tolist()))
    found = catalog.QUERIES["gmm_em_converged"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["predicted"] for r in found} == want and {r["loops"] for r in found} == {loops}
    assert len(set(want.values())) == 5 and np.mean([label[i] == k for i, k in want.items()]) > 0.9


def test_mixture_step_and_prediction(spark, tmp_path):
    x, label = _mixture_fixture(spark, tmp_path)
    known, hard = np.arange(300) % 2 == 0, np.eye(5)[label]
    first = _fit(x[known], hard[known])
    s = _log_scores(x, *first)
    found = {r["doc_id"]: r["predicted"] for r in catalog.QUERIES["gmm_predict"](spark, str(tmp_path)).collect()}
    assert [found[i] for i in range(300)] == s.argmax(1).tolist()
    w = np.exp(s - s.max(1, keepdims=True))
    pi, mu, cov = _fit(x, np.where(known[:, None], hard, w / w.sum(1, keepdims=True)))
    cells = catalog.QUERIES["gmm_em_step"](spark, str(tmp_path)).collect()
    assert len(cells) == 5 * 36
    for r in cells:
        assert (r["pi"], r["mu"], r["cov"]) == pytest.approx((pi[r["k"]], mu[r["k"]][r["i"]], cov[r["k"]][r["i"], r["j"]]), abs=1e-7)


def test_converged_queries_converge_or_fail(spark, monkeypatch):
    fits, plain = [], M.expectation_maximisation
    monkeypatch.setattr(M, "expectation_maximisation", lambda *a, **k: fits.append((plain(*a, **k), k.get("epsilon", a[5] if len(a) > 5 else 1e-4))) or fits[-1][0])
    for name in ("em_converged", "m2o_em_converged"):
        assert catalog.QUERIES[name](spark, SF).count() > 0
    assert [e for _, e in fits] == [1e-4] * 2 and all(f.converged for f, _ in fits)
    monkeypatch.setattr(models, "LOOPS", 1)
    with pytest.raises(NotConvergedError):
        models.em_converged(spark, SF)


def test_scaling_grid_has_every_cell(spark, tmp_path):
    _mixture_fixture(spark, tmp_path)
    cells = catalog.QUERIES["gmm_scaling_grid"](spark, str(tmp_path)).collect()
    assert len({(r["label_scale"], r["unlabel_scale"]) for r in cells}) == 4 * 5 and all(0 <= r["accuracy"] <= 1 for r in cells)


def test_equal_class_split(spark):
    rows = [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3), (7, 3), (8, 3), (9, 5), (10, 5)]
    found = split.equal_class_split(spark.createDataFrame(rows, "doc_id long, label int"), 1).collect()
    assert len(found) == 10
    assert split.folds_for_size(1000, 100) == 10


def test_readers(spark, tmp_path):
    (tmp_path / "train.csv").write_text("1,2,0\n3,x,1\n")
    (tmp_path / "map.csv").write_text("a, b\n")
    (tmp_path / "tf.data").write_text("1 2 3\n2 1 4\n")
    (tmp_path / "bad.data").write_text("1 2\n")
    (tmp_path / "doc.sgm").write_bytes(b"<REUTERS><TOPICS><D>earn</D><D>acq</D></TOPICS><BODY>Caf\xe9 &amp;\n tea</BODY></REUTERS><REUTERS><TOPICS></TOPICS><BODY>x</BODY></REUTERS>")
    data = readers.load_dataset(spark, str(tmp_path / "map.csv"), str(tmp_path / "train.csv"), str(tmp_path / "train.csv"), str(tmp_path / "train.csv"))
    assert [(r["y"], r["name"]) for r in data.class_map.collect()] == [(0, "a"), (1, "b")]
    rows = data.train.collect()
    assert rows[0]["features"] == [1, 2] and rows[0]["y"] == 0 and math.isnan(rows[1]["features"][1])
    assert [(r["y"], r["truth"]) for r in data.unlabelled.collect()] == [(None, 0), (None, 1)]
    assert [tuple(r) for r in readers.triples(spark, str(tmp_path / "tf.data")).collect()] == [(1, 2, 3), (2, 1, 4)]
    with pytest.raises(Exception, match="not three integers"):
        readers.triples(spark, str(tmp_path / "bad.data")).collect()
    docs = readers.sgml_documents(spark, str(tmp_path / "doc.sgm")).collect()
    assert docs[0]["topics"] == ["earn", "acq"] and docs[0]["body"] == "Café & tea" and docs[1]["topics"] == []
    assert issubclass(ParameterError, CorpusError)


def test_writers_round_trip(spark, tf, tmp_path):
    writers.write_triples(tf, str(tmp_path / "tf"))
    assert sorted(map(tuple, readers.triples(spark, str(tmp_path / "tf")).collect())) == sorted(map(tuple, tf.select("doc_id", "word_id", "n").collect()))
    writers.write_class_map(spark.createDataFrame([(1, "b"), (0, "a")], "y int, name string"), str(tmp_path / "map"))
    rows = spark.createDataFrame([([1.0, 2.5], 1)], "features array<double>, y int")
    writers.write_dense_csv(rows, str(tmp_path / "dense"))
    assert [tuple(r) for r in readers.dense_csv(spark, str(tmp_path / "dense")).collect()] == [([1.0, 2.5], 1)]
    report = spark.createDataFrame([("0", 0.5, 0.25, 0.33, 4), ("avg / total", 0.5, 0.25, 0.33, 4)], "name string, precision double, recall double, f1 double, support long")
    writers.write_report(spark, writers.report_text(report, 0.75, 12, 3), str(tmp_path / "report"))
    found = {r["name"]: r for r in readers.reports(spark, str(tmp_path / "report")).collect()}
    assert found["0"]["precision"] == 0.5 and found["0"]["support"] == 4 and found["0"]["accuracy"] == 0.75 and found["0"]["unlabeled"] == 3


SF = "/root/testdata/sf0.001"
NAMES = ["tokenize_counts", "corpus_info", "class_reindex", "l1_scale", "topic_first_match", "equal_class_test_split", "stratified_kfold", "mi_topk_features", "nb_predict", "em_estep", "m2o_predict", "class_metrics", "match_distance", "nearest_pair", "gmm_params", "gmm_loo_average"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "embeddings", "events", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, (plain(r) for r in got.select(*names).collect()))) == sorted(map(repr, map(plain, want.fetchall())))


def test_places_within_a_class(spark, monkeypatch):
    """One class of most rows, over several range partitions; nulls are a class."""
    rows = [(i, None if i % 50 == 0 else "big" if i % 7 else f"small{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = {r["doc_id"]: r["at"] for r in numbered_within(df, "at", "label", F.desc("doc_id")).collect()}
    want = {}
    for name in {x for _, x in rows}:
        want |= {d: i for i, d in enumerate(sorted((d for d, x in rows if x == name), reverse=True), 1)}
    assert got == want


def test_entry_module_without_the_training_data_operators(tmp_path):
    """Without the subpackage and its tests, with or without the pipeline module, the other queries are still there."""
    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'nb_predict' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op1_')]; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True)
        (tmp_path / "repo" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
