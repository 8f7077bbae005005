"""Leave-one-out by importance weights on arrays of pointwise log-likelihoods."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from lodestar.functions.arrays import doubles, log_normalized, log_sum_exp, total


#: Rows that are smoothed at once; bounds the memory of the tail fits.
ROWS = 1024


def sis_weights(log_lik: Column, draw_weights: list[float] | None = None) -> Column:
    """Normalized log importance weights, raw."""
    raw = F.transform(log_lik, lambda v: -v)
    if draw_weights is not None:
        raw = F.zip_with(raw, doubles([math.log(w) for w in draw_weights]), lambda a, b: a + b)
    return log_normalized(raw)


def tail_length(draws: int) -> int:
    """Largest ratios that are smoothed; fewer than five means no smoothing."""
    return math.ceil(min(0.2 * draws, 3 * math.sqrt(draws)))


def generalized_pareto(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and scales for rows of sorted exceedances by Zhang and Stephens' posterior mean, shapes drawn to one half."""
    n = x.shape[1]
    m = 30 + int(math.sqrt(n))
    quarter = x[:, int(n / 4 + 0.5) - 1]
    grid = 1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    theta = 1 / x[:, -1:] + grid[None, :] / (3 * quarter[:, None])
    k = _mean_log1p(theta, x)
    profile = n * (np.log(-theta / k) - k - 1)
    weights = np.exp(profile - profile.max(axis=1, keepdims=True))
    theta_hat = (theta * weights).sum(axis=1) / weights.sum(axis=1)
    shape = np.log1p(-theta_hat[:, None] * x).mean(axis=1)
    return (shape * n + 5) / (n + 10), -shape / theta_hat


def _mean_log1p(theta: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The mean over x of log(1 - theta x) for each theta of a row: logarithms of products of four factors."""
    out, product = np.zeros(theta.shape), np.ones(theta.shape)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for i in range(x.shape[1]):
            product *= 1 - theta * x[:, i, None]
            if i % 4 == 3 or i == x.shape[1] - 1:
                out += np.log(product, out=product)
                product.fill(1.0)
    small = np.abs(out) < 1e-4  # where the ones would swallow digits, or products left the doubles' range
    rows = (small | ~np.isfinite(out)).any(axis=1)
    out /= x.shape[1]
    if rows.any():
        out[rows] = np.log1p(-theta[rows][:, :, None] * x[rows][:, None, :]).mean(axis=2)
    return out


def smoothed(ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of Pareto-smoothed, normalized log weights and their shapes; infinite where a tail can't be fitted."""
    if len(ratios) > ROWS:
        parts = [smoothed(ratios[i : i + ROWS]) for i in range(0, len(ratios), ROWS)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    lw = ratios - ratios.max(axis=1, keepdims=True)
    size, shapes = tail_length(lw.shape[1]), np.full(len(lw), np.inf)
    if size >= 5:
        order = np.argsort(lw, axis=1, kind="stable")
        tail = order[:, -size:]
        values = np.take_along_axis(lw, tail, axis=1)
        base = np.exp(np.maximum(np.take_along_axis(lw, order[:, -size - 1 : -size], axis=1), -700.0))
        excess = np.exp(values) - base
        ok = (values[:, -1] - values[:, 0] > 1e-12) & (excess[:, 0] > 0)
        if ok.any():
            shape, scale = generalized_pareto(excess[ok])
            upper = np.log1p(-(np.arange(1, size + 1) - 0.5) / size)[None, :]
            flat = np.where(np.abs(shape) > 1e-15, shape, 1e-15)[:, None]
            replaced = np.log(base[ok] + scale[:, None] * np.expm1(-flat * upper) / flat)
            part = lw[ok]
            np.put_along_axis(part, tail[ok], np.minimum(replaced, 0.0), axis=1)
            lw[ok], shapes[ok] = part, shape
    top = lw.max(axis=1, keepdims=True)
    return lw - top - np.log(np.exp(lw - top).sum(axis=1, keepdims=True)), shapes


_WEIGHTS = T.StructType([T.StructField("lw", T.ArrayType(T.DoubleType())), T.StructField("khat", T.DoubleType())])


@pandas_udf(_WEIGHTS)
def _psis(log_lik: pd.Series) -> pd.DataFrame:
    lw, shapes = smoothed(-np.stack(log_lik.to_numpy())) if len(log_lik) else (np.empty((0, 0)), np.empty(0))
    return pd.DataFrame({"lw": list(lw), "khat": shapes})


def psis_weights(log_lik: Column) -> Column:
    """Struct of smoothed log weights ``lw`` and Pareto shape ``khat``."""
    return _psis(log_lik)


def shape_threshold(draws: int) -> float:
    return min(1 - 1 / math.log10(draws), 0.7)


def expectation(values: Column, log_weights: Column) -> Column:
    """The mean of values over draws under normalized log importance weights."""
    return total(F.zip_with(values, log_weights, lambda v, w: v * F.exp(w)))


def poor_shapes(df: DataFrame, khat: str, draws: int, warn: bool = True) -> int:
    """How many observations have a Pareto shape over the threshold for this many draws; warns if any has."""
    limit = shape_threshold(draws)
    row = df.agg(F.count_if(F.col(khat) > limit).alias("poor"), F.count("*").alias("n")).first()
    if warn:
        warn_poor(row.poor, row.n, draws)
    return row.poor


def warn_poor(poor: int, n: int, draws: int) -> None:
    if poor:
        warnings.warn(f"the Pareto shape of {poor} of {n} observations is over {shape_threshold(draws):.2f}: their importance weights are unreliable", stacklevel=3)


def loo_summaries(df: DataFrame, log_lik: str, mu: str, log_weights: str) -> DataFrame:
    """Adds mu and lppd under leave-one-out weights: weighted mean and log weighted mean of likelihoods."""
    lppd = log_sum_exp(F.zip_with(F.col(log_lik), F.col(log_weights), lambda a, b: a + b))
    return df.withColumns({"loo_mu": expectation(F.col(mu), F.col(log_weights)), "loo_lppd": lppd})


def subsample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, by keyed order."""
    from lodestar.operators.keyed import keyed

    return df.orderBy(keyed(F.col(key), seed), key).limit(n)
