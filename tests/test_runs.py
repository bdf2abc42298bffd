"""Fits of many runs in one job: stop rules, retention, restarts, left-out points, exact selection."""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.errors import NotConvergedError
from corpusloom.operators import selection, split
from corpusloom.plans import gmm
from corpusloom.plans import mixture as M
from corpusloom.session import Rounds

WORDS = 8
#: Moves of the objective that end a run: few loops.
EPSILON = 0.05


@pytest.fixture(scope="module")
def terms(spark):
    """Counts of eight words of two classes that overlap; runs differ in their labelled documents."""
    rng = np.random.default_rng(3)
    y = np.arange(160) % 2
    shares = np.array([[0.2, 0.2, 0.15, 0.13, 0.1, 0.1, 0.07, 0.05], [0.08, 0.1, 0.1, 0.12, 0.15, 0.15, 0.14, 0.16]])
    x = np.array([rng.multinomial(15, shares[k]) for k in y])
    tf = spark.createDataFrame([(i, f"w{w}", int(n)) for i, row in enumerate(x) for w, n in enumerate(row) if n], "doc_id long, word_id string, n int")
    labelled = {0: range(0, 10), 1: range(0, 60), 2: range(20, 26)}
    docs = [(r, i, int(y[i]) if i in own else None) for r, own in labelled.items() for i in range(160)]
    return x, y, labelled, tf, spark.createDataFrame(docs, "run_id int, doc_id long, y int").cache()


def fit(docs, tf, runs, **options):
    own = docs.where(F.col("run_id").isin(runs))
    parts = M.several_parts(own, [1, 1])
    start = M.maximise(M.hard_start(own, parts), tf, parts, WORDS)
    return M.expectation_maximisation(own, tf, parts, start, WORDS, EPSILON, **options)


def plain(x, y, own):
    """(loops, log priors, log counts) of one run by numpy."""
    known = np.array([i in own for i in range(len(x))])
    hard = np.eye(2)[y]
    step = lambda w: (np.log((w.sum(0) + 1) / (w.sum() + 2)), np.log((w.T @ x + 1) / ((w.T @ x).sum(1, keepdims=True) + WORDS)))
    params, before, loops = step(hard * known[:, None]), None, 0
    while True:
        s = params[0] + x @ params[1].T
        w = np.exp(s - s.max(1, keepdims=True))
        w = np.where(known[:, None], hard, w / w.sum(1, keepdims=True))
        q = (w * s).sum()
        if before is not None and abs(q - before) <= EPSILON:
            return loops, params, w
        params, before, loops = step(w), q, loops + 1


def test_runs_stop_by_themselves(spark, terms):
    """Runs of different loop counts give what single fits and numpy give."""
    x, y, labelled, tf, docs = terms
    whole = fit(docs, tf, [0, 1, 2])
    want = {r: plain(x, y, own) for r, own in labelled.items()}
    assert whole.converged and whole.of_run == {r: v[0] for r, v in want.items()} and len(set(whole.of_run.values())) > 1
    assert whole.loops == max(whole.of_run.values())
    base = {(r["run_id"], r["k"]): r for r in whole.theta.base.collect()}
    seen = {(r["run_id"], r["k"], r["word_id"]): r["log_count"] for r in whole.theta.seen.collect()}
    shares = {(r["run_id"], r["doc_id"], r["k"]): r["w"] for r in whole.resp.collect()}
    for r, (_, (prior, words), w) in want.items():
        for k in range(2):
            assert base[r, k]["log_prior"] == pytest.approx(prior[k], abs=1e-12)
            assert [seen[r, k, f"w{i}"] - base[r, k]["log_total"] for i in range(WORDS)] == pytest.approx(words[k].tolist(), abs=1e-12)
            assert [shares.get((r, i, k), 0.0) for i in range(160)] == pytest.approx(w[:, k].tolist(), abs=1e-12)
    for r in labelled:
        alone = fit(docs, tf, [r])
        assert alone.loops == whole.of_run[r] and alone.q[r] == pytest.approx(whole.q[r], abs=1e-9)
        own = {(v["k"], v["word_id"]): v["log_count"] for v in alone.theta.seen.collect()}
        assert own == {(k, w): pytest.approx(v, abs=1e-12) for (s, k, w), v in seen.items() if s == r}


def test_rounds_are_kept_twice_and_go_on(spark, terms, tmp_path, monkeypatch):
    """The folder holds two rounds however many there were; a fit that breaks off goes on from its last whole round."""
    x, y, labelled, tf, docs = terms
    kept, plain_done = [], Rounds.done

    def done(self, number, state):
        plain_done(self, number, state)
        kept.append(sorted(os.listdir(folder)))

    monkeypatch.setattr(Rounds, "done", done)
    folder = str(tmp_path / "whole")
    whole = fit(docs, tf, [0, 1, 2], folder=folder)
    assert len(kept) == whole.loops and all(len(x) <= 2 for x in kept) and len(kept) > 3

    def breaks(self, number, state):
        done(self, number, state)
        if number == max(2, min(whole.of_run.values()) + 1):
            raise RuntimeError("lost")

    folder = str(tmp_path / "broken")
    monkeypatch.setattr(Rounds, "done", breaks)
    with pytest.raises(RuntimeError):
        fit(docs, tf, [0, 1, 2], folder=folder)
    monkeypatch.setattr(Rounds, "done", done)
    before = len(kept)
    again = fit(docs, tf, [0, 1, 2], folder=folder)
    assert len(kept) - before < whole.loops and again.of_run == whole.of_run and again.converged
    rows = lambda f: sorted((r["run_id"], r["k"], r["word_id"], round(r["log_count"], 10)) for r in f.theta.seen.collect())
    assert rows(again) == rows(whole)


def test_counts_by_run_and_frequent_words(spark, terms):
    """Runs with words and scales of their own, in one table; every word is frequent here, or none is."""
    x, y, labelled, tf, docs = terms
    own = {0: lambda w, n: n, 1: lambda w, n: n * 2.5 if w != "w3" else 0.0, 2: lambda w, n: float(w < "w5") * n}
    rows = [(r["doc_id"], r["word_id"], [float(own[k](r["word_id"], r["n"])) for k in range(3)]) for r in tf.collect()]
    packed = spark.createDataFrame(rows, "doc_id long, word_id string, n array<double>")
    for frequent in (None, []):
        if frequent is not None:
            packed._frequent = frequent
        found = {(r["run_id"], r["doc_id"], r["k"]): r["score"] for r in _scored(docs, packed, [0, 1, 2]).collect()}
        for k in range(3):
            single = spark.createDataFrame([(d, w, n[k]) for d, w, n in rows if n[k]], "doc_id long, word_id string, n double")
            for r in _scored(docs, single, [k]).collect():
                assert found[k, r["doc_id"], r["k"]] == pytest.approx(r["score"], abs=1e-9)
    assert len(M.frequent_words(tf)) == WORDS


def _scored(docs, tf, runs):
    rows = docs.where(F.col("run_id").isin(runs))
    parts = M.several_parts(rows, [1, 1])
    return M.scores(rows, tf, M.maximise(M.hard_start(rows, parts), tf, parts, WORDS))


def test_information_by_run_and_of_wide_words(spark):
    """Each run ranks by its own labels; a word with a different count in every document is no square."""
    rng = np.random.default_rng(8)
    labels = [(r, d, int((d + r) % 3 > 0)) for r in range(3) for d in range(200) if d % 2 == r % 2]
    tf = [(d, f"w{w}", int(n)) for d in range(200) for w in range(6) if (n := rng.poisson(1 + (w == d % 6)))] + [(d, "wide", d + 1) for d in range(200)]
    frame = spark.createDataFrame(tf, "doc_id long, word string, n int")
    by_run = spark.createDataFrame(labels, "run_id int, doc_id long, y int")
    rows = selection.mutual_information(frame, by_run, ("run_id",)).collect()
    found = {(r["run_id"], r["word"]): r["mi"] for r in rows}
    for run in range(3):
        own = {d: y for r, d, y in labels if r == run}
        alone = {r["word"]: r["mi"] for r in selection.mutual_information(frame, by_run.where(F.col("run_id") == run)).collect()}
        for word in alone:
            counts = {d: 0 for d in own} | {d: n for d, w, n in tf if w == word and d in own}
            cells: dict = {}
            for d, n in counts.items():
                cells[n, own[d]] = cells.get((n, own[d]), 0) + 1
            total = len(own)
            side = lambda i, v: sum(c for key, c in cells.items() if key[i] == v)
            want = sum(c / total * math.log2(c * total / (side(0, n) * side(1, y))) for (n, y), c in cells.items()) / len(alone)
            assert alone[word] == pytest.approx(want, abs=1e-12) and found[run, word] == pytest.approx(want, abs=1e-12)
    top = selection.best(selection.mutual_information(frame, by_run, ("run_id",)), 2, keys=("run_id",)).collect()
    assert len(top) == 6 and {r["rank"] for r in top} == {1, 2}
    plan = selection.mutual_information(frame, by_run, ("run_id",))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def _hash(i, seed=0):
    return int(hashlib.md5(f"{i}-{seed}".encode()).hexdigest()[:8], 16)


def test_selection_without_a_sort(spark):
    classes = {i: "abc"[min(2, i % 7)] for i in range(500)}
    docs = spark.createDataFrame([(i, c) for i, c in classes.items()], "doc_id long, label string")
    order = {c: sorted((i for i in classes if classes[i] == c), key=lambda i: (_hash(i), i)) for c in "abc"}
    found = {r["doc_id"]: r["chosen"] for r in split.stratified_shares(docs, [0.1, 0.5, 1.0]).collect()}
    assert len(found) == 500 and all(x[2] for x in found.values()) and all(x[1] or not x[0] for x in found.values())
    for j, share in enumerate((0.1, 0.5)):
        chosen = {i for i, x in found.items() if x[j]}
        assert len(chosen) == math.ceil(share * 500)
        for own in order.values():
            n = sum(i in chosen for i in own)
            assert set(own[:n]) == chosen & set(own)
    found = split.random_split(docs, 0.3).collect()
    assert {r["doc_id"] for r in found if r["is_test"]} == set(sorted(classes, key=lambda i: (_hash(i), i))[:150])
    folds = {r["doc_id"]: r["fold"] for r in split.stratified_folds(docs, 4).collect()}
    assert folds == {i: p % 4 for own in order.values() for p, i in enumerate(own)}
    plan = split.random_split(docs, 0.3)._jdf.queryExecution().toString() + split.stratified_split(docs, 40)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    ids = spark.createDataFrame([(x, 1) for x in (-(2**62), -5, 0, 7, 2**40, 2**62)] + [(3, None), (9, 2)], "doc_id long, label int")
    parts = {r["doc_id"]: r["part"] for r in split.equal_class_split(ids, 2).collect()}
    assert {i for i, p in parts.items() if p} == {2**40, 2**62, 3, 9}


def test_equal_hashes_go_by_id(spark, monkeypatch):
    monkeypatch.setattr(split, "portable_hash", lambda key, seed: (key % 3).cast("long"))
    docs = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    found = {r["doc_id"] for r in split.random_split(docs, 0.5).collect() if r["is_test"]}
    assert found == set(range(0, 60, 3)) | set(range(1, 30, 3))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(11)
    y = np.arange(90) % 3
    x = rng.normal(0, 1, (90, 4)) + 100 + np.array([[0, 0, 0, 0], [2, 0, 0, 1], [0, 3, 0, 0]])[y]
    known = np.arange(90) % 2 == 0
    rows = [(i, x[i].tolist(), int(y[i]) if known[i] else None) for i in range(90)]
    # A class of fewer points than dimensions, and one of a single point.
    few = rng.normal(50, 1, (4, 4))
    rows += [(100 + i, few[i].tolist(), 3 if i < 3 else 4) for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, x array<double>, y int").cache(), {r[0]: (np.array(r[1]), r[2]) for r in rows}


def _refit(rows):
    out, total = {}, len(rows)
    for k in sorted({y for _, y in rows}):
        own = np.array([x for x, y in rows if y == k])
        mean = own.mean(0)
        out[k] = (len(own) / total, mean, (own - mean).T @ (own - mean) / len(own))
    return out


def test_left_out_scores_are_refits(spark, points):
    df, rows = points
    labelled = {i: v for i, v in rows.items() if v[1] is not None}
    found = {(r["doc_id"], r["k"]): r["score"] for r in gmm.leave_one_out_scores(df).collect()}
    assert len(found) == 5 * len(labelled)
    for i, (x, y) in labelled.items():
        fit = _refit([v for j, v in labelled.items() if j != i])
        for k in range(5):
            if k not in fit:
                assert found[i, k] is None and i == 103
            else:
                pi, mu, cov = fit[k]
                want = math.log(pi) + gmm.log_density(x[None], mu, cov)[0]
                assert found[i, k] == pytest.approx(want, rel=1e-7, abs=1e-6), (i, k)


def _em(rows, start, epsilon=1e-3):
    """(loops, fit) by numpy; rows: (x, y or None)."""
    x, y = np.array([v for v, _ in rows]), np.array([-1 if k is None else k for _, k in rows])
    fit, loops = start, 0
    while True:
        s = np.array([math.log(pi) + gmm.log_density(x, mu, cov) for pi, mu, cov in fit.values()]).T
        w = np.exp(s - s.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        w = np.where(y[:, None] >= 0, y[:, None] == np.array(list(fit)), w)
        new = {}
        for i, k in enumerate(fit):
            mean = w[:, i] @ x / w[:, i].sum()
            new[k] = (w[:, i].sum() / len(x), mean, ((x - mean).T * w[:, i]) @ (x - mean) / w[:, i].sum())
        moved, loops = sum(((new[k][1] - fit[k][1]) ** 2).sum() for k in fit), loops + 1
        fit = new
        if moved <= epsilon:
            return loops, fit


def test_left_out_fits_of_the_semi_supervised_model(spark, points):
    df, rows = points
    own = {i: v for i, v in rows.items() if i < 90}
    start = _refit([v for v in own.values() if v[1] is not None])
    found = gmm.leave_one_out_fits(df.where("doc_id < 90"), [0, 4, 32], start)
    for i, fit in found.items():
        loops, want = _em([v for j, v in own.items() if j != i], start)
        assert fit.loops == loops and fit.converged
        for k in want:
            assert fit.gaussians[k][0] == pytest.approx(want[k][0], abs=1e-9)
            assert fit.gaussians[k][1] == pytest.approx(want[k][1], abs=1e-8) and fit.gaussians[k][2] == pytest.approx(want[k][2], abs=1e-8)


def test_scaling_grid_equals_numpy(spark, points):
    df, rows = points
    scales = (0.5, 1.0)
    own = {i: v for i, v in rows.items() if i < 90}
    test = spark.createDataFrame([(i, v[0].tolist(), i % 3) for i, v in own.items() if v[1] is None], "doc_id long, x array<double>, y int")
    found = {(r["label_scale"], r["unlabel_scale"]): r for r in gmm.scaling_grid(df.where("doc_id < 90"), test, scales).collect()}
    assert len(found) == 6
    order = lambda ids: sorted(ids, key=lambda i: (_hash(i), i))
    free = order(i for i in own if own[i][1] is None)
    for a in scales:
        quota = {k: 8 if k == 0 and a < 1 else 15 if a == 1 else 7 for k in range(3)}
        quota = quota if a == 1 else {k: math.floor(0.5 * 45 / 3) for k in range(3)} | {0: 8, 1: 8, 2: 7}
        labelled = [i for k in range(3) for i in order(j for j in own if own[j][1] == k)[: quota[k]]]
        start = _refit([own[i] for i in labelled])
        for b in (None, *scales):
            loops, fit = (0, start) if b is None else _em([own[i] for i in labelled] + [own[i] for i in free[: math.ceil(b * len(free))]], start)
            s = np.array([math.log(pi) + gmm.log_density(np.array([own[i][0] for i in free]), mu, cov) for pi, mu, cov in fit.values()])
            accuracy = np.mean(s.argmax(0) == np.array([i % 3 for i in free]))
            r = found[a, b]
            assert (r["loops"], r["converged"], r["accuracy"]) == (loops, True, pytest.approx(accuracy)), (a, b)


def test_a_fit_that_goes_round_ends(spark, points, monkeypatch):
    df, _ = points
    rows = gmm.with_states(df.where("doc_id < 90"))
    first = gmm.fit_labelled(df.where("doc_id < 90"))
    two, step = [first, {k: (pi, mu + 1, cov) for k, (pi, mu, cov) in first.items()}], iter(range(99))
    monkeypatch.setattr(gmm, "em_step", lambda points, fits, centre: {0: two[(next(step) + 1) % 2]})
    found = gmm.fit_runs(rows, {0: first}, must=False)[0]
    assert not found.converged and found.loops == 3
    next(step)
    with pytest.raises(NotConvergedError):
        gmm.fit_runs(rows, {0: first})


def test_markup_files_are_read_by_record(spark, tmp_path):
    """A file larger than a split is many tasks; entities and bodies over several lines are kept."""
    from corpusloom.sources import readers

    want = []
    with open(tmp_path / "big.sgm", "wb") as out:
        out.write(b'<!DOCTYPE lewis SYSTEM "lewis.dtd">\n')
        for i in range(3000):
            body = f"Number {i} caf\xe9 &amp; tea\n  &lt;{i}&gt; end &#3;"
            out.write(f'<REUTERS ID="{i}">\n<TOPICS><D>t{i % 7}</D><D>all</D></TOPICS><TITLE>x</TITLE><BODY>{body}</BODY>\n</REUTERS>\n'.encode("latin-1"))
            want.append((f"t{i % 7}", f"Number {i} caf\xe9 & tea <{i}> end "))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        docs = readers.sgml_documents(spark, str(tmp_path / "big.sgm"))
        assert docs.rdd.getNumPartitions() > 5
        found = docs.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["topics"][0], r["body"].replace("\x03", "")) for r in found) == sorted(want) and all(r["topics"][1] == "all" for r in found)


def test_information_sets_are_those_of_each_run(spark, terms):
    """Words are chosen by each run's own labels; a model of all runs gives what a model of one run over its words gives."""
    from corpusloom.plans import experiments

    x, y, _, tf, _ = terms
    docs = spark.createDataFrame([(i, int(y[i])) for i in range(120)], "doc_id long, y int")
    runs = experiments.fold_runs(docs, 3).cache()
    words = tf.withColumnRenamed("word_id", "word")
    sets = experiments.information_sets(runs, words, [3, 5], 100)
    assert set(sets) == {"mi3", "mi3_l1", "mi5", "mi5_l1"}
    chosen = {}
    for run in range(3):
        own = runs.where((F.col("run_id") == run) & F.col("y").isNotNull())
        top = selection.best(selection.mutual_information(words, own.select("doc_id", "y")), 3)
        chosen[run] = {r["word"] for r in top.collect()}
        for name in ("mi3", "mi3_l1"):
            packed = {(r["doc_id"], r["word_id"]): r["n"][run] for r in sets[name][0].collect() if r["n"][run]}
            kept = {(r["doc_id"], r["word_id"]): float(r["n"]) for r in tf.collect() if r["word_id"] in chosen[run]}
            if name == "mi3_l1":
                length = {}
                for (d, _), n in kept.items():
                    length[d] = length.get(d, 0) + n
                kept = {k: n * 100 / length[k[0]] for k, n in kept.items()}
            assert packed == {k: pytest.approx(n) for k, n in kept.items()}
    assert len({frozenset(c) for c in chosen.values()}) > 1
    found = experiments.train_and_test(runs, sets["mi3"][0], 3, [1, 1]).collect()
    for run in range(3):
        single = spark.createDataFrame([(r["doc_id"], r["word_id"], r["n"]) for r in tf.collect() if r["word_id"] in chosen[run]], "doc_id long, word_id string, n int")
        alone = experiments.train_and_test(runs.where(F.col("run_id") == run), single, 3, [1, 1]).collect()
        assert {(r["doc_id"], r["predicted"]) for r in alone} == {(r["doc_id"], r["predicted"]) for r in found if r["run_id"] == run}


def test_entry_without_an_importable_llm(tmp_path):
    """The library's queries stay if a module that the training-data operators need is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(x.startswith('op') for x in q), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1:3] == ["False", "False"] and int(out[3]) > 60


def test_words_beyond_the_numbered_ones(spark, terms, monkeypatch):
    """Parameters of few words are broadcast, those of the others joined: same scores, loops and parameters; documents given twice as well."""
    x, y, labelled, tf, docs = terms
    whole = fit(docs, tf, [0, 1, 2])
    want = {(r["run_id"], r["doc_id"], r["k"]): r["score"] for r in _scored(docs, tf, [0, 1, 2]).collect()}
    monkeypatch.setattr(M, "NUMBERS", 18)
    few = tf.select("*")
    assert len(M.frequent_words(few, 6)) == 3 and M.packed_terms(few, 6).rest is not None
    for r in _scored(docs, few, [0, 1, 2]).collect():
        assert r["score"] == pytest.approx(want[r["run_id"], r["doc_id"], r["k"]], abs=1e-9)
    # Hot words are fewer than the numbered ones here.
    monkeypatch.setattr(M, "NUMBERS", 1 << 20)
    monkeypatch.setattr(M, "HOT", 2)
    again = fit(docs, tf.select("*"), [0, 1, 2])
    rows = lambda f: sorted((r["run_id"], r["k"], r["word_id"], round(r["log_count"], 9)) for r in f.theta.seen.collect())
    assert again.of_run == whole.of_run and rows(again) == rows(whole)


def test_an_objective_is_exact_and_a_loop_is_one_pass(spark, terms, monkeypatch):
    """No row a document is written in a loop; both ways of a loop give the same objective."""
    x, y, labelled, tf, docs = terms
    names, table = [], Rounds.table
    monkeypatch.setattr(Rounds, "table", lambda self, number, name, df: names.append(name) or table(self, number, name, df))
    one = fit(docs, tf, [0], max_loops=2)
    assert set(names) == {"packed"}
    monkeypatch.setattr(M, "_spread", lambda docs, terms, runs: None)
    rows = fit(docs, tf, [0], max_loops=2)
    assert one.q[0] == pytest.approx(rows.q[0], abs=1e-8) and "resp" in names
    key = lambda f: sorted((r["doc_id"], r["k"], r["y"], round(r["w"], 9), round(r["score"], 7)) for r in f.resp.where("w > 0").collect() if r["y"] is not None)
    assert key(one) == key(rows)


def test_many_runs_are_fitted_in_groups(spark, terms, monkeypatch):
    """All sizes of an experiment are one fit; where their parameters are too many, groups of runs, each with all its words numbered, and the same figures."""
    from corpusloom.plans import experiments

    x, y, labelled, tf, docs = terms
    own = spark.createDataFrame([(i, int(y[i])) for i in range(80)], "doc_id long, y int")
    more = spark.createDataFrame([(i,) for i in range(80, 160)], "doc_id long")
    fits, plain = [], M.expectation_maximisation

    def counted(*args, **options):
        fits.append(plain(*args, **options))
        return fits[-1]

    monkeypatch.setattr(M, "expectation_maximisation", counted)
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in experiments.labelled_sizes(own, more, tf, WORDS, [10, 20], tries=2, epsilon=EPSILON).collect())
    whole = rows()
    assert len(fits) == 1 and len(fits[0].of_run) == 4 and {r[:2] for r in whole} == {(s, m) for s in (10, 20) for m in ("NB", "EM")}
    monkeypatch.setattr(M, "NUMBERS", 4 * WORDS)
    few = tf.select("*")
    monkeypatch.setattr(M, "packed_terms", lambda table, slots, plain=M.packed_terms: [t for t in [plain(table, slots)] if t.rest is None][0])
    tf = few
    assert rows() == whole and [sorted(f.of_run) for f in fits[1:]] == [[0, 1], [2, 3]]
    for k, name in ((8, 10), (4, 20)):
        runs = experiments.fold_runs(own, k, 2)
        for model, semi in (("NB", None), ("EM", more)):
            alone = experiments.summary(experiments.train_and_test(runs, tf, WORDS, [1, 1], semi, None, EPSILON), labelled=name, model=model)
            assert sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in alone.collect()) == [r for r in whole if r[:2] == (name, model)]


def test_a_loop_is_one_job_and_sums_are_stretches(spark, terms, monkeypatch):
    """A loop writes no table, and gives the same in stretches of a few numbers and slices of a few documents."""
    x, y, labelled, tf, docs = terms
    names, table = [], Rounds.table
    monkeypatch.setattr(Rounds, "table", lambda self, number, name, df: names.append(name) or table(self, number, name, df))
    whole = fit(docs, tf, [0, 1, 2])
    assert whole.loops > 3 and len(names) == 1
    monkeypatch.setattr(M, "CHUNK", 3)
    monkeypatch.setattr(M, "SLICE", 7)
    again = fit(docs, tf, [0, 1, 2])
    rows = lambda f: sorted((r["run_id"], r["k"], r["word_id"], round(r["log_count"], 9)) for r in f.theta.seen.collect())
    assert again.of_run == whole.of_run and rows(again) == rows(whole)
    found = {(r["run_id"], r["doc_id"]): r["predicted"] for r in M.predict(docs, tf, again.theta).collect()}
    plain_way = M.class_scores(M.scores(docs.withColumn("y", F.lit(None).cast("int")), tf, whole.theta)).groupBy("run_id", "doc_id").agg(F.max_by("owner", F.struct("score", -F.col("owner"))).alias("p"))
    assert found == {(r["run_id"], r["doc_id"]): r["p"] for r in plain_way.collect()}


def test_packed_sets_and_scales(spark):
    """Scaled counts and feature sets by information of packed documents are those of their term rows."""
    from corpusloom.operators import corpus, terms
    from corpusloom.plans import experiments

    rng = np.random.default_rng(12)
    texts = spark.createDataFrame([(d, " ".join(f"w{rng.integers(0, 6) + 3 * (d % 2) * (d % 5 > 0)}" for _ in range(d % 9))) for d in range(90)], "doc_id long, text string").cache()
    packed = M.packed_corpus(*terms.packed_words(texts))
    plain = corpus.term_counts(texts)
    rows = lambda df: sorted((r["doc_id"], r["word_id"], *(round(v, 9) for v in (r["n"] if isinstance(r["n"], list) else [r["n"]]))) for r in df.collect())
    for kind in ("l1", "l2"):
        want = corpus.scaled(plain, 50, kind).withColumnRenamed("word", "word_id")
        assert rows(M.scaled_corpus(packed, 50, kind)) == rows(want)
    docs = spark.createDataFrame([(d, d % 2) for d in range(0, 90, 2)] + [(d, d % 2) for d in range(1, 60, 2)], "doc_id long, y int")
    runs = experiments.fold_runs(docs, 3).cache()
    sets, want = experiments.information_sets(runs, packed, [2, 4], 100), experiments.information_sets(runs, plain, [2, 4], 100)
    assert list(sets) == list(want)
    for name in sets:
        kept = [r for r in rows(want[name][0]) if any(r[2:])]
        assert [r for r in rows(sets[name][0]) if any(r[2:])] == kept and len(kept) > 20
    alone = [experiments.compare([experiments.Model(runs, 3, [1, 1])], s["mi4_l1"][0], 4)[0].found["NB"] for s in (sets, want)]
    assert sorted(alone[0]) == sorted(alone[1])
