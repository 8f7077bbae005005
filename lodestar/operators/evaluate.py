"""From fits to pointwise predictions, their densities, and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lodestar.functions.arrays import doubles, log_weighted_mean_exp, total, weighted_mean
from lodestar.functions import normal
from lodestar.functions.families import Family
from lodestar.operators import multilevel
from lodestar.operators.keyed import uniform
from lodestar.operators.loo import shape_threshold, smoothed
from lodestar.operators.solve import Fit
from lodestar.operators.stats import SUMS, Moments


def predictors(fits: list[Fit], columns: dict[str, Column], offset: Column | None = None) -> Column:
    """An array over fits of linear predictors; one array operation for each column, however many fits."""
    names = [n for n in columns if any(n in f.beta for f in fits)]
    out = doubles([f.intercept for f in fits])
    for name in names:
        beta = [f.beta.get(name, 0.0) for f in fits]
        if any(beta):
            out = F.zip_with(out, doubles(beta), _plus_times(columns[name]))
    return out if offset is None else F.transform(out, lambda v: v + offset)


def _plus_times(x: Column):
    return lambda a, b: a + b * x


def means(eta: Column, family: Family) -> Column:
    return F.transform(eta, family.link.inverse)


def densities(mu: Column, family: Family, dis: list[float] | None = None) -> Column:
    """An array over draws of the observation's log-likelihood; needs columns y and wobs."""
    if family.has_dispersion:
        return F.zip_with(mu, doubles(dis), lambda m, s: family.log_lik(F.col("y"), m, F.col("wobs"), s))
    return F.transform(mu, lambda m: family.log_lik(F.col("y"), m, F.col("wobs")))


def summarize(df: DataFrame, mu: str, family: Family, weights: list[float], dis: list[float] | None = None) -> DataFrame:
    """(obs_id, y, wobs, mu, lppd): draws integrated out by their weights."""
    w = doubles(weights)
    rows = df.select("obs_id", "y", "wobs", F.col(mu).alias("draws"))
    return rows.select("obs_id", "y", "wobs", weighted_mean(F.col("draws"), w).alias("mu"), log_weighted_mean_exp(densities(F.col("draws"), family, dis), w).alias("lppd"))


def pointwise(df: DataFrame, columns: dict[str, Column], by_size: dict[int, tuple[list[Fit], list[float], list[float]]], family: Family, leave_one_out: bool = False, reference: tuple[list[Fit], list[float], list[float]] | None = None, shifts: dict[int, str] | None = None) -> DataFrame:
    """The pointwise table of submodels: for each size, fits by draw, their weights and dispersions.

    With a ``reference`` model, its rows have no size, and every row carries its values too, as
    mu_ref and lppd_ref, so that differences to it need no join.

    ``shifts`` names, by size, array columns over its fits that are added to the linear predictors.

    With ``leave_one_out`` each row's draws are weighted by smoothed importance of leaving it out.

    One scan for all sizes; a batch of rows is multiplied by every size's coefficients at once. Draws
    never leave the kernel: each row gives one mean and one log density for each size.
    """
    evaluated, rows = _evaluator(df, columns, by_size, family, leave_one_out, reference, shifts)
    fields = [("obs_id", pa.int64()), ("y", pa.float64()), ("wobs", pa.float64()), ("size", pa.int32()), ("mu", pa.float64()), ("lppd", pa.float64())]
    schema = pa.schema(fields + ([("mu_ref", pa.float64()), ("lppd_ref", pa.float64())] if reference else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = ()
            for size, y, w, mean, lppd, _ in evaluated(batch):
                if size is None:
                    beside = (mean, lppd)
                cells = (batch.column(0), y, w, pa.nulls(len(y), pa.int32()) if size is None else np.full(len(y), size, np.int32), mean, lppd, *beside)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "obs_id bigint, y double, wobs double, size int, mu double, lppd double" + (", mu_ref double, lppd_ref double" if reference else ""))


#: Rows that are evaluated at once where nothing of them is kept.
BLOCK = 1024


def pointwise_sums(df: DataFrame, columns: dict[str, Column], by_size: dict[int, tuple[list[Fit], list[float], list[float]]], family: Family, leave_one_out: bool, reference: tuple[list[Fit], list[float], list[float]]) -> DataFrame:
    """The ``stats.SUMS`` of each task and size that statistics need of ``pointwise``, whose rows are never made.

    With ``leave_one_out``, ``poor`` counts Pareto shapes over the threshold.
    """
    evaluated, rows = _evaluator(df, columns, by_size, family, leave_one_out, reference)
    limits = {s: shape_threshold(len(w)) for s, (_, w, _) in ({None: reference} | by_size).items()} if leave_one_out else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, Moments] = {}
        shift = None
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                beside = ()
                for size, y, w, mean, lppd, shape in evaluated(batch.slice(first, BLOCK)):
                    if size is None:
                        beside = (mean, lppd)
                    if shift is None:
                        shift = float(y.mean()) if np.isfinite(y.mean()) else 0.0
                    part = Moments.of(shift, y, w, mean, lppd, *beside)
                    part.poor = 0 if shape is None else int((shape > limits[size]).sum())
                    if size in held:
                        held[size].add(part)
                    else:
                        held[size] = part
        if held:
            cells = ([*held], [m.n for m in held.values()], [m.poor for m in held.values()], [m.packed() for m in held.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["size", "n", "poor", "sums"])

    return rows.mapInArrow(run, SUMS)


def _evaluator(df: DataFrame, columns: dict[str, Column], by_size: dict[int, tuple[list[Fit], list[float], list[float]]], family: Family, leave_one_out: bool, reference: tuple[list[Fit], list[float], list[float]] | None, shifts: dict[int, str] | None = None) -> tuple[Callable[[pa.RecordBatch], Iterator[tuple]], DataFrame]:
    """What evaluates a batch, as (size, y, wobs, mu, lppd, Pareto shapes or None), the reference first, and the rows that it takes."""
    models = ({None: reference} if reference else {}) | by_size
    used = [n for n in columns if any(f.beta.get(n) for fits, _, _ in models.values() for f in fits)]
    packed = {}
    for size, (fits, weights, dis) in models.items():
        beta = np.array([[f.intercept, *[f.beta.get(n, 0.0) for n in used]] for f in fits]).T
        packed[size] = (beta, np.asarray(weights, float), np.asarray(dis, float))
    shifted = list(shifts or {})

    def evaluated(batch: pa.RecordBatch) -> Iterator[tuple]:
        if not batch.num_rows:
            return
        y, w, o, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 4 + len(used)))
        more = {s: batch.column(4 + len(used) + i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i, s in enumerate(shifted)}
        z = np.column_stack([np.ones(batch.num_rows), *x])
        for size, (beta, weights, dis) in packed.items():
            mu, shape = family.link.np_inverse(z @ beta + o[:, None] + more.get(size, 0.0)), None
            with np.errstate(divide="ignore", invalid="ignore"):
                ll, lw = family.np_log_lik(y[:, None], mu, w[:, None], dis), np.log(weights)[None, :]
                if leave_one_out:
                    lw, shape = smoothed(lw - ll)
                ll += lw
                top = ll.max(axis=1)
                ll -= top[:, None]
                lppd = top + np.log(np.exp(ll, out=ll).sum(axis=1))
            mean = (mu * np.exp(lw)).sum(axis=1)  # equal rows must give equal means: no matrix product
            yield size, y, w, mean, lppd, shape

    rows = df.select(F.col("obs_id").cast("bigint"), F.col("y").cast("double"), F.col("wobs").cast("double"), F.col("offs").cast("double"), *[columns[n].cast("double").alias(f"x{i}") for i, n in enumerate(used)], *[F.col(c).alias(f"s{i}") for i, c in enumerate((shifts or {}).values())])
    return evaluated, rows


def sampled(df: DataFrame, mu: str, family: Family, draws: int, seed: int, dis: list[float] | None = None, weights: list[float] | None = None, key: str = "obs_id") -> DataFrame:
    """Adds ``predicted``: an array of draws from the predictive distribution, keyed by seed and observation.

    With draw weights, each sample takes its draw with that probability; the result doesn't depend
    on partitioning.
    """
    name, nu = family.name, family.nu

    @pandas_udf("array<double>")
    def sample(keys: pd.Series, mus: pd.Series, trials: pd.Series) -> pd.Series:
        if not len(keys):
            return pd.Series([], dtype=object)
        ids, m = keys.to_numpy().astype(np.int64), np.stack(mus.to_numpy()).astype(float)
        if weights is not None:
            upto = np.cumsum(weights) / np.sum(weights)
            at = np.minimum(np.searchsorted(upto, normal.uniforms(ids, draws, seed), "right"), m.shape[1] - 1)
        else:
            at = np.broadcast_to(np.arange(draws) % m.shape[1], (len(ids), draws))
        m = np.take_along_axis(m, at, axis=1)
        s = np.asarray(dis, float)[at] if dis else None
        u = normal.uniforms(ids, draws, seed, 1)
        if name == "binomial":
            n, p = trials.to_numpy(float)[:, None], np.clip(m, 0, 1)
            flip = p > 0.5  # few failures are counted instead of many successes
            q = np.where(flip, 1 - p, p)
            k = normal.counts(u, np.exp(n * np.log1p(-q)), lambda k: (n - k + 1) / k * q / (1 - q))
            out = np.where(flip, n - k, k)
        elif name == "poisson":
            # Large means are sums of small ones.
            parts = max(1, int(np.ceil(np.max(m, initial=0.0) / 200)))
            out = sum(normal.counts(normal.uniforms(ids, draws, seed, 1 + i), np.exp(-m / parts), lambda k: m / parts / k) for i in range(parts))
        elif name == "Gamma":
            out = normal.gammas(ids, s, seed, 2) * m / s
        elif name == "student_t":
            out = m + s * normal.normals(ids, draws, seed, 2) / np.sqrt(2 * normal.gammas(ids, np.full(m.shape, nu / 2), seed, 4) / nu)
        else:
            out = m + s * normal.normals(ids, draws, seed, 2)
        return pd.Series(list(out))

    return df.withColumn("predicted", sample(F.col(key), F.col(mu), F.col("wobs")))


def sampled_categories(df: DataFrame, probabilities: Column, levels: list[str], draws: int, seed: int = 0, key: str = "obs_id") -> DataFrame:
    """Adds ``predicted``: an array of levels drawn by their probabilities, keyed by seed, observation and draw.

    A draw takes the first level whose cumulative probability passes a uniform number; all in SQL functions.
    """
    names = F.array(*[F.lit(v) for v in levels])
    upto = F.transform(F.sequence(F.lit(1), F.lit(len(levels) - 1)), lambda i: total(F.slice("_p", F.lit(1), i))) if len(levels) > 1 else F.array().cast("array<double>")
    drawn = lambda j: F.get(names, F.size(F.filter("_upto", lambda c: c <= uniform(F.col(key) * draws + j, seed))))
    return df.withColumn("_p", probabilities).withColumn("_upto", upto).withColumn("predicted", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), drawn)).drop("_p", "_upto")


def group_effects(df: DataFrame, effects: DataFrame, group: str, effect: str, sd: float | None = None, all_new: bool = False, seed: int = 1) -> DataFrame:
    """Adds a group's effect to each row.

    Levels that were not seen have effect zero or, given the effects' deviation ``sd``, a normal draw
    keyed by the level; ``all_new`` takes every level as one that was not seen.
    """
    new = F.lit(0.0) if sd is None else multilevel.new_effect(F.col(group), sd, seed)
    if all_new:
        return df.withColumn(effect, new)
    known = effects.select(group, F.col(effect).alias("_effect"))
    return df.join(known, group, "left").withColumn(effect, F.coalesce("_effect", new)).drop("_effect")
