"""Group-level intercepts and slopes: linear mixed models from moments by group, many at once.

A model has fixed columns and, for one grouping factor, effects with a covariance that is relative to
the residual variance, given by its lower Cholesky factor L. A group's moments (weighted products of
the columns with each other and with the targets) are all that any model needs of it: with D the
products of the group's own columns, I + L'DL takes the group's effects out of every sum. So one
aggregate by group is kept, and a pass over it adds up, for any number of models, targets and
covariances, what the driver's small systems need. Covariances are found by restricted maximum
likelihood, all of a step's trials in one pass.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.shared import cut

#: Relative standard deviations that a search for a covariance starts from.
STARTS = tuple(float(v) for v in np.geomspace(0.03, 30, 13))
STEPS = 25
#: Dampings tried at once in a step, and the differences that derivatives are taken over.
DAMPING = (0.0, 0.1, 1.0, 10.0, 100.0, 1000.0)
STEP = 1e-3
#: Relative standard deviations are at least this; smaller ones change nothing.
LEAST = 1e-4


@dataclass(frozen=True)
class GroupMoments:
    """A row for each group: ``z``, the upper triangle of its products of the intercept and columns, then products with each target.

    ``whole`` are the sums over all groups, with the products of targets with themselves in ``squares``.
    """

    table: DataFrame
    names: tuple[str, ...]
    n_targets: int
    rows: int
    whole: np.ndarray
    cross: np.ndarray
    squares: np.ndarray

    def at(self, cols: list[str]) -> list[int]:
        return [self.names.index(c) for c in cols]


@dataclass(frozen=True)
class Model:
    """Fixed columns, group-level columns and the target of one fit; ``INTERCEPT`` stands among either if it has one."""

    fixed: tuple[str, ...]
    group: tuple[str, ...]
    target: int = 0


@dataclass(frozen=True)
class GroupFit:
    """Coefficients by fixed column, residual deviation, relative Cholesky factor, deviance, and the score of the fitted values."""

    model: Model
    beta: dict[str, float]
    sigma: float
    factor: np.ndarray
    deviance: float
    score: float


INTERCEPT = "(Intercept)"


def group_moments(df: DataFrame, columns: dict[str, Column], targets: Column, n_targets: int, group: str, weight: Column | None = None) -> GroupMoments:
    """Moments by group of an array of targets, summed within tasks first, so that a group of any size is a few numbers; a null group is one of its own."""
    names, w = (INTERCEPT, *columns), (F.lit(1.0) if weight is None else weight).cast("double")
    values = [F.lit(1.0), *[c.cast("double") for c in columns.values()]]
    rows = df.select(F.col(group).alias("g"), w.alias("w"), targets.alias("t"), *[c.alias(f"x{i}") for i, c in enumerate(values)])
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = [F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]
    products += [F.sum(F.col("w") * F.col(f"x{i}") * F.get("t", F.lit(t))) for i in range(k) for t in range(n_targets)]
    squares = [F.sum(F.col("w") * F.pow(F.get("t", F.lit(t)), 2)) for t in range(n_targets)]
    own = rows.groupBy("g").agg(F.count("*").alias("n"), *[p.alias(f"p{i}") for i, p in enumerate([*products, *squares])])
    table = cut(own.select("g", "n", F.array(*[f"p{i}" for i in range(len(products))]).alias("z"), F.array(*[f"p{len(products) + t}" for t in range(n_targets)]).alias("q")))
    sums = table.agg(F.sum("n").alias("n"), *[F.sum(F.get("z", F.lit(i))).alias(f"p{i}") for i in range(len(products))], *[F.sum(F.get("q", F.lit(t))).alias(f"q{t}") for t in range(n_targets)]).first()
    if not sums.n:
        raise ValueError("no observations")
    whole, cross = _unpacked(np.array([[sums[f"p{i}"] for i in range(len(products))]]), k, n_targets)
    return GroupMoments(table, names, n_targets, sums.n, whole[0], cross[0], np.array([sums[f"q{t}"] for t in range(n_targets)]))


def _unpacked(z: np.ndarray, k: int, n_targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Products of columns (k x k) and with targets (k x targets) of each group."""
    upper = np.triu_indices(k)
    s = np.zeros((len(z), k, k))
    s[:, upper[0], upper[1]] = z[:, : len(upper[0])]
    s[:, upper[1], upper[0]] = z[:, : len(upper[0])]
    return s, z[:, len(upper[0]) :].reshape(len(z), k, n_targets)


def _taken_out(s: np.ndarray, c: np.ndarray, fixed: list[int], group: list[int], target: int, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """I + L'DL of each group, and L' of its products with the fixed columns and the target."""
    inner = np.eye(len(group)) + factor.T @ s[:, group][:, :, group] @ factor
    return inner, factor.T @ s[:, group][:, :, fixed], c[:, group, target] @ factor


def _sums(m: GroupMoments, trials: list[tuple[Model, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
    """For each model and factor: what groups take off X'X, X'm and m'm, and the sum of log determinants, in one pass over the groups."""
    k, n_targets = len(m.names), m.n_targets
    jobs = [(m.at(list(t.fixed)), m.at(list(t.group)), t.target, f) for t, f in trials]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(f) ** 2 + len(f) + 2) for f, *_ in jobs]
        for batch in batches:
            if not batch.num_rows:
                continue
            s, c = _unpacked(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), k, n_targets)
            for i, (fixed, group, target, factor) in enumerate(jobs):
                inner, x, y = _taken_out(s, c, fixed, group, target, factor)
                solved = np.linalg.solve(inner, np.concatenate([x, y[:, :, None]], axis=2))
                xx = np.einsum("nqf,nqh->fh", x, solved[:, :, :-1])
                xy = np.einsum("nqf,nq->f", x, solved[:, :, -1])
                total[i] += np.concatenate([xx.ravel(), xy, [float((y * solved[:, :, -1]).sum()), float(np.linalg.slogdet(inner)[1].sum())]])
        flat = np.concatenate(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

    sizes = [len(f) ** 2 + len(f) + 2 for f, *_ in jobs]
    flat = np.zeros(sum(sizes))
    for r in m.table.select("z").mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        flat[r["at"]] = r.v
    out = []
    for part, (fixed, *_) in zip(np.split(flat, np.cumsum(sizes)[:-1]), jobs, strict=True):
        f = len(fixed)
        out.append((part[: f * f].reshape(f, f), part[f * f : f * f + f], part[-2], part[-1]))
    return out


def _solved(m: GroupMoments, model: Model, sums: tuple) -> tuple[np.ndarray, float, float]:
    """Coefficients, residual variance and restricted deviance."""
    xx, xy, yy, logs = sums
    fixed = m.at(list(model.fixed))
    a, b = m.whole[np.ix_(fixed, fixed)] - xx, m.cross[fixed, model.target] - xy
    beta = np.linalg.solve(a + 1e-12 * np.diag(np.diag(a)), b) if fixed else np.empty(0)
    rest = max(float(m.squares[model.target] - yy - b @ beta), 1e-300)
    left = max(m.rows - len(fixed), 1)
    return beta, rest / left, left * np.log(rest / left) + logs + (np.linalg.slogdet(a)[1] if fixed else 0.0)


def _factor(theta: np.ndarray, q: int) -> np.ndarray:
    """Lower triangle from logarithms of its diagonal and its other entries."""
    out = np.zeros((q, q))
    out[np.diag_indices(q)] = np.maximum(np.exp(np.clip(theta[:q], -30, 15)), LEAST)
    out[np.tril_indices(q, -1)] = theta[q:]
    return out


def fitted(m: GroupMoments, models: list[Model], factors: list[np.ndarray] | None = None) -> list[GroupFit]:
    """Every model's fit: at the given relative Cholesky factors, or those of least restricted deviance.

    All models take their steps together: a pass tries the starts, one takes derivatives by
    differences, one tries the damped Newton steps, until no model moves.
    """
    if factors is None:
        factors = _searched(m, models)
    sums = _sums(m, list(zip(models, factors, strict=True)))
    solved = [_solved(m, model, s) for model, s in zip(models, sums, strict=True)]
    scores = _scores(m, models, factors, [b for b, *_ in solved])
    return [GroupFit(model, dict(zip(model.fixed, beta.tolist(), strict=True)), float(np.sqrt(s2)), f, dev, score) for model, f, (beta, s2, dev), score in zip(models, factors, solved, scores, strict=True)]


def _searched(m: GroupMoments, models: list[Model]) -> list[np.ndarray]:
    def deviances(points: list[tuple[int, np.ndarray]]) -> list[float]:
        trials = [(models[i], _factor(theta, len(models[i].group))) for i, theta in points]
        return [_solved(m, model, s)[2] for (model, _), s in zip(trials, _sums(m, trials), strict=True)]

    # Effects of columns of any scale: a start is relative to each column's own size.
    sizes = np.sqrt(np.maximum(np.diag(m.whole) / m.whole[0, 0], 1e-300))
    starts = []
    for i, model in enumerate(models):
        q = len(model.group)
        base = -np.log(sizes[m.at(list(model.group))])
        starts += [(i, np.concatenate([np.log(v) + base, np.zeros(q * (q - 1) // 2)])) for v in STARTS]
    theta: list[np.ndarray] = [np.empty(0)] * len(models)
    best = [np.inf] * len(models)
    for (i, t), d in zip(starts, deviances(starts), strict=True):
        if d < best[i]:
            theta[i], best[i] = t, d
    moving = list(range(len(models)))
    for _ in range(STEPS):
        probes = []
        for i in moving:
            n = len(theta[i])
            steps = _steps(theta[i], models[i], sizes[m.at(list(models[i].group))])
            probes += [(i, theta[i] + s * steps[a]) for a in range(n) for s in (1, -1)]
            probes += [(i, theta[i] + s * steps[a] + t * steps[b]) for a, b in itertools.combinations(range(n), 2) for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
        found = deviances(probes)
        trials, at = [], 0
        for i in moving:
            n = len(theta[i])
            steps = np.diagonal(_steps(theta[i], models[i], sizes[m.at(list(models[i].group))]))
            single, double = found[at : at + 2 * n], found[at + 2 * n : at + 2 * n + 2 * n * (n - 1)]
            at += 2 * n + 2 * n * (n - 1)
            grad = np.array([(single[2 * a] - single[2 * a + 1]) / 2 for a in range(n)])
            hess = np.diag([single[2 * a] + single[2 * a + 1] - 2 * best[i] for a in range(n)])
            for c, (a, b) in enumerate(itertools.combinations(range(n), 2)):
                pp, pm, mp, mm = double[4 * c : 4 * c + 4]
                hess[a, b] = hess[b, a] = (pp - pm - mp + mm) / 4
            values, vectors = np.linalg.eigh(hess)
            curve = np.maximum(np.abs(values), 1e-9 * max(1.0, np.abs(values).max()))
            for d in DAMPING:
                move = -vectors @ ((vectors.T @ grad) / (curve * (1 + d)))
                length = np.abs(move * steps).max()
                trials.append((i, theta[i] + move * steps * min(1.0, 3.0 / max(length, 1e-300))))
        improved = []
        before = list(best)
        for (i, t), d in zip(trials, deviances(trials), strict=True):
            if d < best[i] - 1e-13 * abs(before[i]):
                theta[i], best[i] = t, d
        improved = [i for i in moving if before[i] - best[i] > 1e-9]
        moving = improved
        if not moving:
            break
    return [_factor(t, len(model.group)) for t, model in zip(theta, models, strict=True)]


def _steps(theta: np.ndarray, model: Model, sizes: np.ndarray) -> np.ndarray:
    """Difference steps, a row for each parameter: of logarithms as they are, of others by the scale of their column."""
    q = len(model.group)
    own = np.concatenate([np.full(q, STEP), [STEP * max(np.exp(theta[a]), 1e-6 / sizes[a]) for a in np.tril_indices(q, -1)[0]]])
    return np.diag(own)


def _effects(s: np.ndarray, c: np.ndarray, fixed: list[int], group: list[int], target: int, factor: np.ndarray, beta: np.ndarray) -> np.ndarray:
    inner, x, y = _taken_out(s, c, fixed, group, target, factor)
    return np.linalg.solve(inner, (y - x @ beta)[:, :, None])[:, :, 0] @ factor.T


def _scores(m: GroupMoments, models: list[Model], factors: list[np.ndarray], betas: list[np.ndarray]) -> list[float]:
    """Weighted means of -2 m q + q squared, q the fitted values with effects."""
    k, n_targets = len(m.names), m.n_targets
    jobs = [(m.at(list(t.fixed)), m.at(list(t.group)), t.target, f, b) for t, f, b in zip(models, factors, betas, strict=True)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(jobs))
        for batch in batches:
            if batch.num_rows:
                s, c = _unpacked(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), k, n_targets)
                for i, (fixed, group, target, factor, beta) in enumerate(jobs):
                    own = np.zeros((len(s), k))
                    own[:, fixed] += beta
                    own[:, group] += _effects(s, c, fixed, group, target, factor, beta)
                    total[i] += float((np.einsum("nk,nkl->nl", own, s) * own).sum() - 2 * (own * c[:, :, target]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    found = np.zeros(len(jobs))
    for r in m.table.select("z").mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        found[r["at"]] = r.v
    return (found / m.whole[0, 0]).tolist()


def effects(m: GroupMoments, fits: list[GroupFit], group: str) -> DataFrame:
    """(group, effects): for each fit an array of the group's effects, in the order of the model's group-level columns."""
    k, n_targets = len(m.names), m.n_targets
    jobs = [(m.at(list(f.model.fixed)), m.at(list(f.model.group)), f.model.target, f.factor, np.array([f.beta[c] for c in f.model.fixed])) for f in fits]
    kind = dict(m.table.dtypes)["g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, c = _unpacked(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), k, n_targets)
            found = [_effects(s, c, *job) for job in jobs]
            rows = [[e[i].tolist() for e in found] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.list_(pa.float64())))], ["g", "effects"])

    return m.table.select("g", "z").mapInArrow(run, f"g {kind}, effects array<array<double>>").withColumnRenamed("g", group)


def with_effects(df: DataFrame, found: DataFrame, group: str, fits: list[GroupFit], columns: dict[str, Column], name: str) -> DataFrame:
    """Adds ``name``: for each fit the group's part of the linear predictor; groups that weren't seen have none."""
    known = found.select(F.col(group).alias("_of"), F.col("effects").alias("_effects"))
    joined = df.join(known, F.col(group).eqNullSafe(F.col("_of")), "left")
    parts = []
    for i, f in enumerate(fits):
        terms = [F.coalesce(F.get(F.get("_effects", F.lit(i)), F.lit(j)), F.lit(0.0)) * (F.lit(1.0) if c == INTERCEPT else columns[c]) for j, c in enumerate(f.model.group)]
        parts.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return joined.withColumn(name, F.array(*parts) if parts else F.array().cast("array<double>")).drop("_of", "_effects")
