"""Gaussian mixtures over feature arrays: supervised, semi-supervised, leave-one-out.

Tables: points(doc_id, x ARRAY<DOUBLE>, y) with y null if unlabelled, or with
states ARRAY<INT>, the point's part in each run: 0 none, 1 labelled, 2 unlabelled;
params(k, pi, mu, cov) with one row a class.

Fits of many runs go through one job a loop.  A task turns its points into sufficient
statistics by run and class (weight, weighted sum and products, about a given centre),
which are summed in tasks again; the driver gets one row a run and class, of
dimensions squared numbers whatever the number of points, and sends the new
parameters with the next loop.  A run whose means rest leaves the jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import NotConvergedError
from ..operators.split import stratified_shares
from ..session import checkpointed

#: (pi, mu, cov) by class.
Gaussians = dict[int, tuple[float, np.ndarray, np.ndarray]]
ABSENT, LABELLED, UNLABELLED = 0, 1, 2
_STATISTICS = "run_id int, k int, n double, s binary, p binary"
#: Points whose statistics are computed together.
_ROWS = 4096
#: Tasks whose rows one task may sum.
_DIRECT = 256


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _batch_of(sums: dict) -> pa.RecordBatch:
    keys = list(sums)
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
    columns = [r for r, _ in keys], [k for _, k in keys], [sums[x][0] for x in keys], [sums[x][1].tobytes() for x in keys], [sums[x][2].tobytes() for x in keys]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["run_id", "k", "n", "s", "p"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for batch in batches:
        for r, k, n, s, p in zip(*[c.to_pylist() for c in batch.columns]):
            own = (n, np.frombuffer(s), np.frombuffer(p))
            sums[r, k] = tuple(a + b for a, b in zip(sums[r, k], own)) if (r, k) in sums else own
    yield _batch_of(sums)


def statistics(points: DataFrame, columns: list[str], weigh: Callable, centre: np.ndarray) -> dict:
    """(run, k) -> (n, sum, products) of x - centre, weighted.

    ``weigh(x, *columns)`` gives (run, k, weights) for a batch of points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                x = _vectors(batch.column(0))
                for r, k, w in weigh(x, *batch.columns[1:]):
                    kept = w > 0
                    if kept.any():
                        d, w = x[kept] - centre, w[kept]
                        own = (float(w.sum()), w @ d, (d.T * w) @ d)
                        sums[r, k] = tuple(a + b for a, b in zip(sums[r, k], own)) if (r, k) in sums else own
        yield _batch_of(sums)

    parts = points.select("x", *columns).mapInArrow(run, _STATISTICS)
    # A row a task for each run and class; those of many tasks are summed in two steps, so that no task reads a row of every task.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = points.rdd.getNumPartitions()
    if tasks > _DIRECT:
        parts = parts.repartition(n).mapInArrow(_summed, _STATISTICS)
    rows = parts.repartition(max(1, min(n, tasks // 4)), "run_id", "k").mapInArrow(_summed, _STATISTICS)
    width = len(centre)
    return {(r["run_id"], r["k"]): (r["n"], np.frombuffer(r["s"]), np.frombuffer(r["p"]).reshape(width, width)) for r in rows.toLocalIterator()}


def _gaussians(sums: dict, run: int, centre: np.ndarray) -> Gaussians:
    own = {k: x for (r, k), x in sums.items() if r == run}
    total = sum(n for n, _, _ in own.values())
    out = {}
    for k, (n, s, p) in sorted(own.items()):
        mean = s / n
        out[k] = (n / total, centre + mean, p / n - np.outer(mean, mean))
    return out


def centre_of(points: DataFrame) -> np.ndarray:
    """The mean of all points; statistics about it lose no digits to a far origin."""
    first = points.select("x").first()
    if first is None:
        return np.zeros(0)
    return np.array(points.agg(*[F.avg(F.col("x")[i]) for i in range(len(first["x"]))]).first(), float)


def _labels(column: pa.Array) -> np.ndarray:
    """Classes as numbers; -1 where there is none."""
    return column.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def fit_labelled(points: DataFrame, centre: np.ndarray | None = None) -> Gaussians:
    """The supervised fit."""
    centre = centre_of(points) if centre is None else centre

    def weigh(x, y):
        known = _labels(y)
        for k in np.unique(known[known >= 0]).tolist():
            yield 0, k, (known == k).astype(float)

    return _gaussians(statistics(points.where("y is not null").withColumn("y", F.col("y").cast("int")), ["y"], weigh, centre), 0, centre)


def params_of(spark, fit: Gaussians) -> DataFrame:
    rows = [(k, float(pi), mu.tolist(), cov.tolist()) for k, (pi, mu, cov) in fit.items()]
    return spark.createDataFrame(rows, "k int, pi double, mu array<double>, cov array<array<double>>")


def gaussians_of(params: DataFrame) -> Gaussians:
    """One row a class."""
    return {r["k"]: (r["pi"], np.array(r["mu"]), np.array(r["cov"])) for r in params.orderBy("k").collect()}


def class_params(points: DataFrame) -> DataFrame:
    """k, pi, mu, cov (biased) of the labelled points."""
    return params_of(points.sparkSession, fit_labelled(points))


@dataclass(frozen=True)
class Density:
    """ln pi + ln density of one class, prepared: directions without variance are left out (pseudo-inverse and -determinant)."""

    mu: np.ndarray
    axes: np.ndarray
    constant: float

    @staticmethod
    def of(pi: float, mu: np.ndarray, cov: np.ndarray) -> Density:
        values, vectors = np.linalg.eigh(cov)
        kept = values > 1e-10 * max(1e-300, float(np.abs(values).max(initial=0)))
        constant = (np.log(pi) if pi > 0 else -np.inf) - 0.5 * (np.log(values[kept]).sum() + kept.sum() * np.log(2 * np.pi))
        return Density(mu, vectors[:, kept] / np.sqrt(values[kept]), float(constant))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared Mahalanobis distances."""
        z = (x - self.mu) @ self.axes
        return (z * z).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * self.distances(x)


def log_density(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return Density.of(1.0, mu, cov).scores(x)


def _prepared(fit: Gaussians) -> dict[int, Density]:
    return {k: Density.of(*x) for k, x in sorted(fit.items())}


def scores(points: DataFrame, params: DataFrame) -> DataFrame:
    """doc_id, y, k, score = ln pi + ln density; params is one row a class and goes to the tasks."""
    known = _prepared(gaussians_of(params))

    def run(batches):
        for part in batches:
            x = np.array(part["x"].tolist(), float).reshape(len(part), -1)
            for k, density in known.items():
                if len(part):
                    yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"].astype("Int32"), "k": np.int32(k), "score": density.scores(x)})

    return points.select("doc_id", "x", F.col("y").cast("int").alias("y")).mapInPandas(run, "doc_id long, y int, k int, score double")


def predict(points: DataFrame, params: DataFrame) -> DataFrame:
    return scores(points, params).groupBy("doc_id").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("predicted"))


def responsibilities(scored: DataFrame) -> DataFrame:
    """Labelled points belong to their class, the others by the softmax of their scores."""
    own = W.partitionBy("doc_id")
    mass = scored.withColumn("_m", F.exp(F.col("score") - F.max("score").over(own)))
    soft = F.col("_m") / F.sum("_m").over(own)
    return mass.select("doc_id", "k", F.when(F.col("y").isNull(), soft).otherwise((F.col("y") == F.col("k")).cast("double")).alias("w"))


def _shares(fits: dict[int, Gaussians]) -> Callable:
    """E-step of all runs over a batch: the weights that ``statistics`` takes."""
    known = {run: _prepared(fit) for run, fit in fits.items()}

    def weigh(x, y, states):
        labels = _labels(y)
        parts = states.flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1)
        for run, densities in known.items():
            state = parts[:, run]
            free = state == UNLABELLED
            s = np.array([d.scores(x[free]) for d in densities.values()]) if free.any() else np.zeros((len(densities), 0))
            mass = np.exp(s - s.max(0, initial=-np.inf))
            mass /= mass.sum(0)
            for soft, k in zip(mass, densities):
                w = ((state == LABELLED) & (labels == k)).astype(float)
                w[free] = soft
                yield run, k, w

    return weigh


def with_states(points: DataFrame) -> DataFrame:
    """One run: labelled points by their class, the others free."""
    return points.withColumn("states", F.array(F.when(F.col("y").isNull(), UNLABELLED).otherwise(LABELLED)))


def em_step(points: DataFrame, fits: dict[int, Gaussians], centre: np.ndarray) -> dict[int, Gaussians]:
    """One E- and M-step of the given runs, in one job; a class without mass keeps its shape and loses its share."""
    rows = points.withColumn("y", F.col("y").cast("int"))
    sums = statistics(rows, ["y", "states"], _shares(fits), centre)
    out = {}
    for run, fit in fits.items():
        new = _gaussians(sums, run, centre)
        out[run] = {k: new.get(k, (0.0, mu, cov)) for k, (_, mu, cov) in fit.items()}
    return out


@dataclass
class RunFit:
    gaussians: Gaussians
    loops: int
    moved: float
    converged: bool


def fit_runs(points: DataFrame, starts: dict[int, Gaussians], epsilon: float = 1e-3, max_loops: int = 1000, must: bool = True) -> dict[int, RunFit]:
    """Semi-supervised EM of all runs, each from its own start until its class means move by at most epsilon in squared distance.

    ``points`` (a saved table with states) is read once a loop for all runs that still move.
    Classes with fewer points than dimensions have densities that jump, and such a fit may
    go round for ever: a run whose means come back to where they were (to 9 digits) ends, not
    converged.  ``must``: an error if a run ends so, or still moves after the last loop.
    """
    centre, active, out, loops = centre_of(points), dict(starts), {}, 0
    known: dict[int, set[bytes]] = {run: set() for run in starts}
    while active and loops < max_loops:
        now = em_step(points, active, centre)
        loops += 1
        for run, fit in now.items():
            moved = float(sum(((fit[k][1] - active[run][k][1]) ** 2).sum() for k in fit))
            out[run] = RunFit(fit, loops, moved, moved <= epsilon)
        active = {}
        for run, fit in now.items():
            mark = hashlib.sha256(np.round(np.concatenate([x[1] for x in fit.values()]), 9).tobytes()).digest()
            if not out[run].converged and mark not in known[run]:
                active[run] = fit
            known[run].add(mark)
    if must and (still := [run for run, x in out.items() if not x.converged]):
        raise NotConvergedError(f"not converged after {max(out[run].loops for run in still)} loops")
    return out


@dataclass
class Fit:
    params: DataFrame
    loops: int
    moved: float


def expectation_maximisation(points: DataFrame, start: DataFrame | None = None, epsilon: float = 1e-3, max_loops: int = 1000, must: bool = True) -> Fit:
    """Semi-supervised EM of one run; the start is the supervised fit unless it is given."""
    first = gaussians_of(start) if start is not None else fit_labelled(points)
    if max_loops < 1:
        return Fit(params_of(points.sparkSession, first), 0, float("inf"))
    found = fit_runs(with_states(points), {0: first}, epsilon, max_loops, must)[0]
    return Fit(params_of(points.sparkSession, found.gaussians), found.loops, found.moved)


def param_cells(params: DataFrame) -> DataFrame:
    """k, i, j, pi, mu (of i) and cov of every cell; places from 0."""
    lines = params.select("k", "pi", "mu", F.posexplode("cov").alias("i", "_line"))
    return lines.select("k", "pi", "mu", "i", F.posexplode("_line").alias("j", "cov")).select("k", "i", "j", "pi", F.get("mu", F.col("i")).alias("mu"), "cov")


def leave_one_out_params(points: DataFrame) -> DataFrame:
    """k, i, j, pi, mu, cov averaged over the supervised fits that leave out one labelled point each.

    Each fit is the full sums less one point; summed over the points of a class
    of n, with sums S, the left-out covariances are S_ij - ((n - 2) S_i S_j + S_ij) / (n - 1)^2
    and the left-out means S_i, so the classes' own sums give the averages.
    """
    sizes = points.where("y is not null").groupBy(F.col("y").alias("k")).agg(F.count("*").cast("double").alias("n"))
    params = class_params(points)
    means = params.select("k", F.posexplode("mu").alias("j", "mu_j"))
    # One row a class, and one a class and dimension.
    cells = param_cells(params).join(F.broadcast(sizes), "k").join(F.broadcast(means), ["k", "j"]).where("n > 1")
    n, total = F.col("n"), F.col("n") / F.col("pi")
    both = n * n * F.col("mu") * F.col("mu_j")
    products = n * (F.col("cov") + F.col("mu") * F.col("mu_j"))
    without = products - ((n - 2) * both + products) / ((n - 1) * (n - 1))
    # In the runs that leave out a point of another class, this class is whole.
    pi = n * (total - 1) / (total * F.greatest(F.lit(1.0), total - 1))
    return cells.select("k", "i", "j", pi.alias("pi"), "mu", ((without + (total - n) * F.col("cov")) / total).alias("cov"))


#: Below this share of its variance in a point's direction, a left-out covariance is computed anew.
_THIN = 1e-6


def _left_out(x: np.ndarray, density: Density, cov: np.ndarray, n: int) -> np.ndarray:
    """ln density of each point of a class of n under the class without it.

    Without a point at distance m (squared, in the whole class's covariance C) and offset d from
    the mean, the covariance is n / (n - 1) (C - d d' / (n - 1)): its determinant
    is 1 - m / (n - 1) times that of C, scaled, and its inverse a rank-one update, so the
    distance from the left-out mean is n m / (n - 1 - m).
    """
    if n < 2:
        return np.full(len(x), -np.inf)
    m, rank = density.distances(x), density.axes.shape[1]
    left = 1 - m / (n - 1)
    shape = density.constant - np.log(n / (n - 1)) * rank / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        out = shape - 0.5 * (np.log(left) + n * m / (n - 1) / left)
    for i in np.flatnonzero(left < _THIN):
        # The point holds a direction alone: at most as many points as dimensions do.
        d = x[i] - density.mu
        out[i] = Density.of(1.0, density.mu - d / (n - 1), n / (n - 1) * (cov - np.outer(d, d) / (n - 1))).scores(x[i : i + 1])[0]
    return out


def leave_one_out_scores(points: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """doc_id, y, k, score of every labelled point under the supervised fit that leaves it out.

    The point's own class is the whole class's less a rank-one term, other classes only change
    their share, so all fits come from one: no fit is repeated.  A class of one point is gone without it (score null).
    """
    fit = gaussians_of(params) if params is not None else fit_labelled(points)
    sizes = {r["y"]: r["n"] for r in points.where("y is not null").groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    known = {k: (Density.of(1.0, mu, cov), cov, sizes[k]) for k, (_, mu, cov) in fit.items()}

    def run(batches):
        for part in batches:
            x, y = np.array(part["x"].tolist(), float).reshape(len(part), -1), part["y"].to_numpy()
            for k, (density, cov, n) in known.items():
                own = y == k
                score = np.empty(len(part))
                with np.errstate(divide="ignore"):
                    score[~own] = density.scores(x[~own]) + np.log(n / max(1, total - 1))
                    share = np.log((n - 1) / max(1, total - 1))
                score[own] = _left_out(x[own], density, cov, n) + share
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"].astype("int32"), "k": np.int32(k), "score": np.where(np.isneginf(score), np.nan, score)})

    rows = points.where("y is not null").select("doc_id", "x", F.col("y").cast("int").alias("y"))
    return rows.mapInPandas(run, "doc_id long, y int, k int, score double").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def leave_one_out_fits(points: DataFrame, left_out: list[int], start: Gaussians | None = None, epsilon: float = 1e-3, max_loops: int = 1000) -> dict[int, RunFit]:
    """doc_id -> semi-supervised fit without that labelled point; one run each, all of a list in one job a loop, from one start."""
    states = [F.when(F.col("doc_id") == x, ABSENT).when(F.col("y").isNull(), UNLABELLED).otherwise(LABELLED) for x in left_out]
    rows = checkpointed(points.withColumn("states", F.array(*states)))
    first = start or fit_labelled(points)
    found = fit_runs(rows, {i: first for i in range(len(left_out))}, epsilon, max_loops)
    return {x: found[i] for i, x in enumerate(left_out)}


def accuracy_of_runs(test: DataFrame, fits: dict[int, Gaussians]) -> dict[int, float]:
    """The share of test points (doc_id, x, y) whose class each run's fit finds."""
    known = {run: _prepared(fit) for run, fit in fits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, rows = dict.fromkeys(known, 0), 0
        for batch in batches:
            x, y = _vectors(batch.column(0)), _labels(batch.column(1))
            rows += len(y)
            for r, densities in known.items():
                s = np.array([d.scores(x) for d in densities.values()])
                hits[r] += int((np.array(list(densities))[s.argmax(0)] == y).sum()) if len(y) else 0
        yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.int32()), pa.array(list(hits.values()), pa.int64()), pa.array([rows] * len(hits), pa.int64())], ["run_id", "hits", "n"])

    parts = test.where("y is not null").select("x", F.col("y").cast("int").alias("y")).mapInArrow(run, "run_id int, hits long, n long")
    return {r["run_id"]: r["hits"] / r["n"] if r["n"] else None for r in parts.groupBy("run_id").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()}


def scaling_grid(points: DataFrame, test: DataFrame, scales: tuple[float, ...] = (0.3, 0.5, 0.7, 1.0), epsilon: float = 1e-3, max_loops: int = 1000, seed: int = 0) -> DataFrame:
    """label_scale, unlabel_scale (null: supervised), accuracy, loops, converged: every labelled share alone, then with every unlabelled share, warm-started.

    All cells are runs of one fit; a point's states say in which it takes part.  Cells that
    go round, or still move after the last loop, are marked as not converged.
    """
    n = len(scales)
    shares = lambda rows, label: stratified_shares(rows, list(scales), label, seed)
    labelled = shares(points.where("y is not null"), "y")
    free = shares(points.where("y is null").withColumn("_all", F.lit(0)), "_all").drop("_all")
    chosen = F.col("chosen")
    # Runs 0 to n - 1: the labelled shares alone; then each with each unlabelled share.
    own = [F.when(chosen[i], LABELLED).otherwise(ABSENT) for i in range(n)]
    rows = labelled.withColumn("states", F.array(*own, *[own[i] for i in range(n) for _ in range(n)]))
    some = [F.when(chosen[j], UNLABELLED).otherwise(ABSENT) for j in range(n)]
    rows = checkpointed(rows.unionByName(free.withColumn("states", F.array(*[F.lit(ABSENT)] * n, *[some[j] for _ in range(n) for j in range(n)]))).drop("chosen"))
    centre = centre_of(rows)

    def weigh(x, y, states):
        labels, parts = _labels(y), states.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        for i in range(n):
            for k in np.unique(labels[labels >= 0]).tolist():
                yield i, k, ((parts[:, i] == LABELLED) & (labels == k)).astype(float)

    sums = statistics(rows.withColumn("y", F.col("y").cast("int")), ["y", "states"], weigh, centre)
    fits = {i: _gaussians(sums, i, centre) for i in range(n)}
    found = fit_runs(rows, {n + i * n + j: fits[i] for i in range(n) for j in range(n)}, epsilon, max_loops, must=False)
    fits |= {run: x.gaussians for run, x in found.items()}
    accuracy = accuracy_of_runs(test, fits)
    cells = [(scales[i], None, accuracy.get(i), 0, True) for i in range(n)]
    for run, x in found.items():
        cells.append((scales[(run - n) // n], scales[(run - n) % n], accuracy.get(run), x.loops, x.converged))
    return points.sparkSession.createDataFrame(cells, "label_scale double, unlabel_scale double, accuracy double, loops int, converged boolean")
