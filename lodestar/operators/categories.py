"""Projections of category probabilities: ordered (cumulative links) and unordered (softmax).

The targets are the reference model's probabilities, so the data are one row an observation with an
array of weights over categories, not one row a category. Newton passes sum gradient and curvature in
Arrow batches; the driver solves systems as small as the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.families import EPS, cumulative_probabilities, link_of, softmax_probabilities
from lodestar.operators.irls import moments_of, predictor, summed
from lodestar.operators.solve import REGUL, Fit

STEPS = 80


@dataclass(frozen=True)
class Ordinal:
    """Increasing thresholds and coefficients that are subtracted from them."""

    thresholds: list[float]
    beta: dict[str, float]
    link: str

    def probabilities(self, columns: dict[str, Column]) -> Column:
        return cumulative_probabilities(predictor(Fit(0.0, self.beta), columns), self.thresholds, self.link)


@dataclass(frozen=True)
class Softmax:
    """One fit for each category but the first."""

    fits: list[Fit]

    def probabilities(self, columns: dict[str, Column]) -> Column:
        return softmax_probabilities([predictor(f, columns) for f in self.fits])


def _newton(rows: DataFrame, start: np.ndarray, kernel: Callable, ridge: np.ndarray, valid: Callable[[np.ndarray], bool], tol: float = 1e-14) -> np.ndarray:
    """Minimizes a sum over rows; ``kernel(theta, x, t, w)`` gives value, gradient and curvature of a batch."""
    theta, step, loss, first = start.copy(), np.zeros_like(start), np.inf, None
    for _ in range(STEPS):
        now = theta.copy()

        def partial(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            flat = np.zeros(1 + len(now) + len(now) ** 2)
            for batch in batches:
                if batch.num_rows:
                    w = batch.column(0).to_numpy(zero_copy_only=False)
                    t = np.array(batch.column(1).to_pylist(), dtype=float)
                    x = np.column_stack([np.ones(len(w)), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)]])
                    value, grad, hess = kernel(now, x, t, w)
                    flat += np.concatenate([[value], grad, hess.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

        inside = valid(theta)
        if inside:
            flat = np.zeros(1 + len(theta) + len(theta) ** 2)
            for r in rows.mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
                flat[r["at"]] = r.v
            value = flat[0] + 0.5 * float(ridge @ theta**2)
            first = abs(value) if first is None else first
        if not inside or not np.isfinite(value) or value > loss + 1e-12 * first:
            step = step / 2
            if np.abs(step).max() < 1e-14:
                return theta - step
            theta = theta - step
            continue
        loss = value
        grad = flat[1 : 1 + len(theta)] + ridge * theta
        move = -np.linalg.solve(flat[1 + len(theta) :].reshape(len(theta), -1) + np.diag(ridge + 1e-10), grad)
        if -grad @ move < tol * max(first, 1e-300):
            return theta
        step, theta = move, theta + move
    return theta


def _rows(df: DataFrame, columns: dict[str, Column], target: Column, weight: Column | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.select(w.cast("double").alias("w"), target.alias("t"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())])


def softmax(df: DataFrame, columns: dict[str, Column], target: Column, n_categories: int, weight: Column | None = None, regul: float = REGUL) -> Softmax:
    """Multinomial-logit projection; the first category is the reference."""
    k, p = n_categories - 1, len(columns) + 1

    def kernel(theta, x, t, w):
        eta = np.column_stack([np.zeros(len(x)), x @ theta.reshape(k, p).T])
        top = eta.max(axis=1, keepdims=True)
        log_p = eta - top - np.log(np.exp(eta - top).sum(axis=1, keepdims=True))
        prob, mass = np.exp(log_p), t.sum(axis=1)
        grad = ((w[:, None] * (mass[:, None] * prob - t))[:, 1:].T @ x).ravel()
        hess = np.zeros((k * p, k * p))
        for a in range(k):
            for b in range(k):
                v = w * mass * (prob[:, a + 1] * ((a == b) - prob[:, b + 1]))
                hess[a * p : (a + 1) * p, b * p : (b + 1) * p] = (x * v[:, None]).T @ x
        return -float((w[:, None] * t * log_p).sum()), grad, hess

    theta = _newton(_rows(df, columns, target, weight), np.zeros(k * p), kernel, np.tile([0.0] + [regul] * (p - 1), k), lambda _: True)
    return Softmax([Fit(float(r[0]), dict(zip(columns, r[1:].tolist(), strict=True))) for r in theta.reshape(k, p)])


def ordinal(df: DataFrame, columns: dict[str, Column], target: Column, n_categories: int, weight: Column | None = None, link: str = "logit", regul: float = REGUL) -> Ordinal:
    """Cumulative-link projection: thresholds start at the overall shares, equally spaced where those vanish."""
    lk, k = link_of(link), n_categories - 1
    rows = _rows(df, columns, target, weight)
    shares = rows.agg(*[F.sum(F.col("w") * F.get("t", F.lit(i))).alias(f"c{i}") for i in range(n_categories)]).first()
    share = np.array([shares[f"c{i}"] or 0.0 for i in range(n_categories)])
    upto = np.cumsum(share)[:-1] / max(share.sum(), 1e-300) if share.min() > 0 else np.arange(1, n_categories) / n_categories
    start = np.concatenate([lk.np_link(np.clip(upto, 1e-6, 1 - 1e-6)), np.zeros(len(columns))])

    def kernel(theta, x, t, w):
        cut, beta, z = theta[:k], theta[k:], x[:, 1:]
        eta = cut[None, :] - (z @ beta)[:, None]
        cum = np.column_stack([np.zeros(len(x)), lk.np_inverse(eta), np.ones(len(x))])
        dens = np.column_stack([np.zeros(len(x)), lk.np_slope(eta), np.zeros(len(x))])
        prob = np.maximum(np.diff(cum, axis=1), EPS)
        # Derivative of each category's probability by each parameter: thresholds, then coefficients.
        d = np.zeros((len(x), k + 1, len(theta)))
        for c in range(k + 1):
            if c < k:
                d[:, c, c] += dens[:, c + 1]
            if c > 0:
                d[:, c, c - 1] -= dens[:, c]
            d[:, c, k:] = -(dens[:, c + 1] - dens[:, c])[:, None] * z
        grad = -np.einsum("n,nc,ncp->p", w, t / prob, d)
        mass = t.sum(axis=1)
        hess = np.einsum("n,nc,ncp,ncq->pq", w * mass, 1 / prob, d, d)
        return -float((w[:, None] * t * np.log(prob)).sum()), grad, hess

    ridge = np.array([0.0] * k + [regul] * len(columns))
    theta = _newton(rows, start, kernel, ridge, lambda v: bool(np.all(np.diff(v[:k]) > 0)))
    return Ordinal(theta[:k].tolist(), dict(zip(columns, theta[k:].tolist(), strict=True)), link)


def one_hot(y: Column, levels: list[str]) -> Column:
    """The observed category as probabilities."""
    return F.array(*[F.when(y == v, 1.0).otherwise(0.0) for v in levels])


def latent_from_cumulative(probabilities: Column, n_categories: int, link: str = "logit") -> Column:
    """Link-scale values of the cumulative probabilities."""
    upto, out = F.lit(0.0), []
    for i in range(n_categories - 1):
        upto = upto + F.get(probabilities, F.lit(i))
        out.append(link_of(link).link(F.least(F.greatest(upto, F.lit(EPS)), F.lit(1 - EPS))))
    return F.array(*out)


def latent_from_softmax(probabilities: Column, n_categories: int) -> Column:
    """Log-ratios to the first category."""
    first = F.get(probabilities, F.lit(0))
    return F.array(*[F.log(F.get(probabilities, F.lit(i)) / first) for i in range(1, n_categories)])


def binomial_categories(mu: Column) -> Column:
    """Both categories' probabilities of a Bernoulli mean."""
    return F.array(1 - mu, mu)


@dataclass(frozen=True)
class Job:
    """One fit of many: its columns, and which target of an array of targets it projects."""

    cols: tuple[str, ...]
    target: int = 0


@dataclass(frozen=True)
class CategoryFit:
    """Parameters of a fit, and its mean cross-entropy with the target."""

    theta: np.ndarray
    cols: tuple[str, ...]
    score: float


def softmax_probabilities_of(theta: np.ndarray, x: np.ndarray, n_categories: int) -> np.ndarray:
    """Rows of probabilities; ``theta`` has intercept and slopes of every category but the first."""
    eta = np.column_stack([np.zeros(len(x)), x @ theta.reshape(n_categories - 1, x.shape[1]).T])
    e = np.exp(eta - eta.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ordinal_probabilities_of(theta: np.ndarray, x: np.ndarray, n_categories: int, link: str) -> np.ndarray:
    """Rows of probabilities; ``theta`` has the thresholds, then slopes that are subtracted from them."""
    k = n_categories - 1
    cum = link_of(link).np_inverse(theta[None, :k] - (x[:, 1:] @ theta[k:])[:, None])
    return np.maximum(np.diff(np.column_stack([np.zeros(len(x)), cum, np.ones(len(x))]), axis=1), EPS)


def _softmax_sums(theta, x, t, w, n_categories):
    k, p = n_categories - 1, x.shape[1]
    prob, mass = softmax_probabilities_of(theta, x, n_categories), t.sum(axis=1)
    grad = ((w[:, None] * (mass[:, None] * prob - t))[:, 1:].T @ x).ravel()
    rest, wm = prob[:, 1:], w * mass
    hess = np.zeros((k, p, k, p))
    for a in range(k):
        for b in range(a, k):
            block = (x * (wm * rest[:, a] * ((a == b) - rest[:, b]))[:, None]).T @ x
            hess[a, :, b, :] = block
            hess[b, :, a, :] = block.T
    return -float((w[:, None] * t * np.log(np.maximum(prob, 1e-300))).sum()), grad, hess.reshape(k * p, k * p)


def _ordinal_sums(theta, x, t, w, n_categories, link):
    k, lk, z = n_categories - 1, link_of(link), x[:, 1:]
    eta = theta[None, :k] - (z @ theta[k:])[:, None]
    zero = np.zeros((len(x), 1))
    prob = np.maximum(np.diff(np.column_stack([zero, lk.np_inverse(eta), zero + 1]), axis=1), EPS)
    dens = np.column_stack([zero, lk.np_slope(eta), zero])
    d = np.zeros((len(x), k + 1, len(theta)))
    for c in range(k + 1):
        if c < k:
            d[:, c, c] += dens[:, c + 1]
        if c > 0:
            d[:, c, c - 1] -= dens[:, c]
        d[:, c, k:] = -(dens[:, c + 1] - dens[:, c])[:, None] * z
    grad = -np.einsum("n,nc,ncp->p", w, t / prob, d)
    scaled = d * np.sqrt(w * t.sum(axis=1))[:, None, None] / np.sqrt(prob)[:, :, None]
    flat = scaled.reshape(-1, len(theta))
    return -float((w[:, None] * t * np.log(prob)).sum()), grad, flat.T @ flat


def project_many(df: DataFrame, columns: dict[str, Column], targets: Column, n_categories: int, jobs: list[Job], ordered: bool = False, link: str = "logit", weight: Column | None = None, regul: float = REGUL, tol: float = 1e-12) -> list[CategoryFit]:
    """Projections of many targets on many sets of columns: every Newton step of all of them is one pass over kept rows.

    ``targets`` is an array over targets of arrays over categories. Columns are standardized for the
    penalty; parameters come back on their own scale.
    """
    w = (F.lit(1.0) if weight is None else weight).cast("double")
    mean, sd, _ = moments_of(df, columns, w)
    unit = np.where(sd > 0, sd, 1.0)
    names, k = list(columns), n_categories - 1
    rows = df.select(w.alias("w"), F.flatten(targets).alias("t"), *[((c - float(m)) / float(u)).cast("double").alias(f"x{i}") for i, (c, m, u) in enumerate(zip(columns.values(), mean, unit, strict=True))]).persist()
    n_targets = max(j.target for j in jobs) + 1
    shares = rows.agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.get("t", F.lit(i))).alias(f"c{i}") for i in range(n_targets * n_categories)]).first()
    share = np.array([shares[f"c{i}"] or 0.0 for i in range(n_targets * n_categories)]).reshape(n_targets, n_categories)
    index = [[0, *[1 + names.index(c) for c in j.cols if sd[names.index(c)] > 0]] for j in jobs]
    theta, ridge = [], []
    for j, ix in zip(jobs, index, strict=True):
        own = share[j.target]
        if ordered:
            upto = np.cumsum(own)[:-1] / max(own.sum(), 1e-300) if own.min() > 0 else np.arange(1, n_categories) / n_categories
            theta.append(np.concatenate([link_of(link).np_link(np.clip(upto, 1e-6, 1 - 1e-6)), np.zeros(len(ix) - 1)]))
            ridge.append(np.array([0.0] * k + [regul] * (len(ix) - 1)))
        else:
            theta.append(np.zeros(k * len(ix)))
            ridge.append(np.tile([0.0] + [regul] * (len(ix) - 1), k))
    kernel = (lambda th, x, t, w: _ordinal_sums(th, x, t, w, n_categories, link)) if ordered else (lambda th, x, t, w: _softmax_sums(th, x, t, w, n_categories))
    step = [np.zeros_like(t) for t in theta]
    loss, first, plain, halved = [np.inf] * len(jobs), [None] * len(jobs), [0.0] * len(jobs), [0] * len(jobs)
    open_jobs = list(range(len(jobs)))
    for _ in range(2 * STEPS):
        inside = [i for i in open_jobs if not ordered or bool(np.all(np.diff(theta[i][:k]) > 0))]
        sums = _sums_of(rows, n_categories, kernel, [(i, jobs[i].target, index[i], theta[i]) for i in inside]) if inside else {}
        still = []
        for i in open_jobs:
            value, grad, hess = sums.get(i, (np.inf, None, None))
            whole = value + 0.5 * float(ridge[i] @ theta[i] ** 2)
            first[i] = abs(whole) if first[i] is None and np.isfinite(whole) else first[i]
            if not np.isfinite(whole) or whole > loss[i] + 1e-12 * (first[i] or 1.0):
                step[i] = step[i] / 2
                theta[i] = theta[i] - step[i]
                halved[i] += 1
                if halved[i] <= 40:
                    still.append(i)
                continue
            loss[i], plain[i], halved[i] = whole, value, 0
            grad = grad + ridge[i] * theta[i]
            move = -np.linalg.solve(hess + np.diag(ridge[i] + 1e-10), grad)
            if -grad @ move < tol * max(first[i], 1e-300):
                continue
            step[i], theta[i] = move, theta[i] + move
            still.append(i)
        open_jobs = still
        if not open_jobs:
            break
    rows.unpersist()
    total = float(shares.w or 0.0)
    return [CategoryFit(_unscaled(theta[i], index[i], names, jobs[i], mean, unit, k, ordered), jobs[i].cols, float(plain[i] / total) if total else 0.0) for i in range(len(jobs))]


def _unscaled(theta: np.ndarray, index: list[int], names: list[str], job: Job, mean: np.ndarray, unit: np.ndarray, k: int, ordered: bool) -> np.ndarray:
    """Parameters for columns as they are, with zeros for those that are constant."""
    at = {names[i - 1]: n for n, i in enumerate(index[1:], 1)}
    own = np.array([mean[names.index(c)] for c in job.cols]), np.array([unit[names.index(c)] for c in job.cols])
    pick = lambda row, offset: np.array([row[at[c] - offset] if c in at else 0.0 for c in job.cols]) / own[1] if job.cols else np.empty(0)
    if ordered:
        beta = pick(theta[k:], 1)
        return np.concatenate([theta[:k] + beta @ own[0] if job.cols else theta[:k], beta])
    rows = []
    for row in theta.reshape(k, len(index)):
        beta = pick(row, 0)
        rows.append(np.concatenate([[row[0] - (beta @ own[0] if job.cols else 0.0)], beta]))
    return np.concatenate(rows)


def _sums_of(rows: DataFrame, n_categories: int, kernel: Callable, fits: list[tuple[int, int, list[int], np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Value, gradient and curvature of every open fit, from one pass; one row for each fit and task is summed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).to_numpy(zero_copy_only=False)
            t = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(w), -1, n_categories)
            x = np.column_stack([np.ones(len(w)), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)]])
            for i, target, index, theta in fits:
                value, grad, hess = kernel(theta, x[:, index], t[:, target], w)
                flat = np.concatenate([[value], grad, hess.ravel()])
                sums[i] = flat if i not in sums else sums[i] + flat
        out = [(i, k, float(v)) for i, flat in sums.items() for k, v in enumerate(flat)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fit", "at", "v"])

    flats = summed(rows.mapInArrow(partial, "fit bigint, at bigint, v double"), {i: 1 + len(th) + len(th) ** 2 for i, _, _, th in fits})
    return {i: (flats[i][0], flats[i][1 : 1 + len(th)], flats[i][1 + len(th) :].reshape(len(th), -1)) for i, _, _, th in fits}
