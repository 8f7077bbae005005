"""Non-Gaussian projections: Newton steps on weighted moments summed in Spark.

All fits of a step (candidates times draws) share one pass over the data: every Arrow batch adds its
part of each fit's Hessian, gradient and loss, and one row for each fit and task is summed. The
driver solves the small systems and halves steps that raise the loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.families import Family
from lodestar.operators.gram import INTERCEPT
from lodestar.operators.solve import REGUL, Fit

STEPS = 60
HALVINGS = 30
THRESHOLD = 1e-9


@dataclass(frozen=True)
class Job:
    """One fit: its columns and which target of the target array it projects."""

    cols: tuple[str, ...]
    target: int = 0


def moments_of(df: DataFrame, columns: dict[str, Column], weight: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """Weighted means and standard deviations (n / (n - 1)) of the columns; deviations are from the means, in a second scan."""
    if not columns:
        return np.empty(0), np.empty(0), df.count()
    w = weight.cast("double")
    row = df.agg(F.count("*").alias("n"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"s{i}") for i, c in enumerate(columns.values())]).first()
    mean = np.array([row[f"s{i}"] / row.w for i in range(len(columns))])
    about = df.agg(*[F.sum(w * F.pow(c - float(m), 2)).alias(f"q{i}") for i, (c, m) in enumerate(zip(columns.values(), mean, strict=True))]).first()
    var = np.array([about[f"q{i}"] for i in range(len(columns))]) / row.w
    var = np.where(var > 1e-28 * mean**2, var, 0.0)
    return mean, np.sqrt(var * row.n / max(row.n - 1, 1)), row.n


def project(df: DataFrame, columns: dict[str, Column], targets: Column, family: Family, jobs: list[Job], weight: Column | None = None, offset: Column | None = None, regul: float = REGUL, threshold: float = THRESHOLD) -> list[Fit]:
    """Ridge projections of target means on the response scale, one for each job.

    The rows that every pass reads are kept, in memory or on disk, until the last fit is done.
    """
    weight = F.lit(1.0) if weight is None else weight
    offset = F.lit(0.0) if offset is None else offset
    mean, sd, _ = moments_of(df, columns, weight)
    names = list(columns)
    unit = np.where(sd > 0, sd, 1.0)
    rows = df.select(weight.cast("double").alias("w"), offset.cast("double").alias("o"), targets.alias("t"), *[((c - m) / u).cast("double").alias(f"x{i}") for i, (c, m, u) in enumerate(zip(columns.values(), mean, unit, strict=True))]).persist()
    at = {n: i for i, n in enumerate(names)}
    index = [[0, *[1 + at[c] for c in j.cols if sd[at[c]] > 0]] for j in jobs]
    beta = [np.zeros(len(ix)) for ix in index]
    step: list[np.ndarray | None] = [None] * len(jobs)
    loss, first = [np.inf] * len(jobs), [None] * len(jobs)
    halved, done = [0] * len(jobs), [False] * len(jobs)
    for _ in range(STEPS + HALVINGS):
        open_jobs = [i for i in range(len(jobs)) if not done[i]]
        if not open_jobs:
            break
        sums = _pass(rows, family, [(i, jobs[i].target, index[i], beta[i]) for i in open_jobs])
        for i in open_jobs:
            value, gradient, hessian = sums[i]
            ridge = regul * np.array([0.0] + [1.0] * (len(beta[i]) - 1))
            value += 0.5 * float(ridge @ beta[i] ** 2)
            first[i] = abs(value) if first[i] is None else first[i]
            if not np.isfinite(value) or value > loss[i] + 1e-12 * first[i]:
                halved[i] += 1
                step[i] = step[i] / 2
                beta[i] = beta[i] - step[i]
                done[i] = halved[i] > HALVINGS
                continue
            loss[i], halved[i] = value, 0
            gradient = gradient + ridge * beta[i]
            move = -np.linalg.solve(hessian + np.diag(ridge), gradient)
            if -gradient @ move < threshold * max(first[i], 1e-300):
                done[i] = True
                continue
            step[i] = move
            beta[i] = beta[i] + move
    rows.unpersist()
    return [_original(j, names, index[i], beta[i], mean, unit) for i, j in enumerate(jobs)]


def _original(job: Job, names: list[str], index: list[int], beta: np.ndarray, mean: np.ndarray, unit: np.ndarray) -> Fit:
    out = dict.fromkeys(job.cols, 0.0)
    intercept = float(beta[0])
    for k, i in enumerate(index[1:], 1):
        out[names[i - 1]] = float(beta[k] / unit[i - 1])
        intercept -= float(beta[k] / unit[i - 1] * mean[i - 1])
    return Fit(intercept, out)


def _pass(rows: DataFrame, family: Family, fits: list[tuple[int, int, list[int], np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            w, o = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            t = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, batch.num_columns)]])
            for i, target, index, beta in fits:
                z = x[:, index]
                eta = z @ beta + o
                mu, slope = family.link.np_inverse(eta), family.link.np_slope(eta)
                v = np.maximum(family.np_variance(mu), 1e-12)
                grad = -w * (t[:, target] - mu) * slope / v
                hess = (z * (w * slope * slope / v)[:, None]).T @ z
                value = float((w * family.np_half_deviance(t[:, target], mu)).sum())
                flat = np.concatenate([[value], z.T @ grad, hess.ravel()])
                sums[i] = flat if i not in sums else sums[i] + flat
        out = [(i, k, float(v)) for i, flat in sums.items() for k, v in enumerate(flat)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["fit", "at", "v"])

    flats = summed(rows.mapInArrow(partial, "fit bigint, at bigint, v double"), {i: 1 + len(index) + len(index) ** 2 for i, _, index, _ in fits})
    found = {}
    for i, _, index, _ in fits:
        k, flat = len(index), flats[i]
        found[i] = (flat[0], flat[1 : 1 + k], flat[1 + k :].reshape(k, k))
    return found


def summed(cells: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of (fit, at, v) as an array for each fit; as many numbers come back as the fits have in all."""
    table = cells.groupBy("fit", "at").agg(F.sum("v").alias("v")).toArrow()
    starts = np.zeros(max(sizes, default=0) + 2, np.int64)
    for i, n in sizes.items():
        starts[i + 1] = n
    starts = np.cumsum(starts)
    flat = np.zeros(starts[-1])
    flat[starts[table["fit"].to_numpy()] + table["at"].to_numpy()] = table["v"].to_numpy()
    return {i: flat[starts[i] : starts[i] + n] for i, n in sizes.items()}


def predictor(fit: Fit, columns: dict[str, Column]) -> Column:
    """The linear predictor of a fit as a column."""
    out = F.lit(float(fit.intercept))
    for name, b in fit.beta.items():
        if b != 0:
            out = out + F.lit(float(b)) * columns[name]
    return out


def table(fits: list[Fit]) -> list[tuple[int, str, float]]:
    return [(i, name, value) for i, f in enumerate(fits) for name, value in [(INTERCEPT, f.intercept), *f.beta.items()]]
