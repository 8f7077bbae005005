"""Group-level intercepts: linear and generalized linear mixed models from group sums.

With a random intercept the marginal precision of a group is its working weights minus a rank-one
term of its weighted sums. So one aggregate by group (weight, weighted sums of columns and response)
answers every variance ratio: each is a sum over groups, and a whole grid of ratios is one pass over
the group table. Groups stay in Spark; the driver solves systems as small as the design.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.families import Family
from lodestar.operators.gram import gram
from lodestar.operators.irls import predictor
from lodestar.operators.solve import Fit
from lodestar.shared import cut

GRID = tuple(float(v) for v in np.geomspace(1e-4, 1e3, 57))


@dataclass(frozen=True)
class MixedFit:
    """Fixed effects, residual deviation, ratio of group to residual variance, and effects by group."""

    fixed: Fit
    sigma: float
    ratio: float
    effects: DataFrame


def group_sums(df: DataFrame, columns: dict[str, Column], y: Column, group: str, weight: Column) -> DataFrame:
    """(group, w, s0.. of the intercept and columns, sy): weighted sums; hot groups are summed per task first."""
    values = [F.lit(1.0), *columns.values(), y]
    return df.groupBy(group).agg(F.sum(weight).alias("w"), *[F.sum(weight * v).alias(f"s{i}") for i, v in enumerate(values)])


def _corrections(sums: DataFrame, k: int, ratios: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For every ratio: the sum over groups of r / (1 + r w) s s', and of log(1 + r w)."""
    grid = np.array(ratios)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, logs = np.zeros((len(grid), k * k)), np.zeros(len(grid))
        for batch in batches:
            if batch.num_rows:
                w = batch.column(0).to_numpy(zero_copy_only=False)
                s = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)])
                shrink = grid[:, None] / (1 + grid[:, None] * w)
                total += shrink @ (s[:, :, None] * s[:, None, :]).reshape(len(w), k * k)
                logs += np.log1p(grid[:, None] * w).sum(axis=1)
        flat = np.concatenate([total.ravel(), logs])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

    cells = sums.select("w", *[f"s{i}" for i in range(k)]).mapInArrow(partial, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(grid) * (k * k + 1))
    for r in cells:
        flat[r["at"]] = r.v
    return flat[: len(grid) * k * k].reshape(len(grid), k, k), flat[len(grid) * k * k :]


def random_intercept(df: DataFrame, columns: dict[str, Column], y: Column, group: str, weight: Column | None = None, ratios: tuple[float, ...] = GRID, unit_variance: bool = False) -> MixedFit:
    """Restricted maximum likelihood over a grid of variance ratios, refined once around the best.

    ``unit_variance`` holds the residual variance at one, as working responses of generalized models
    need. Groups are null-safe: a null group is a group of its own.
    """
    weight = F.lit(1.0) if weight is None else weight
    g = gram(df, {**columns, "_y": y}, weight)
    k = len(columns) + 2
    sums = cut(group_sums(df, columns, y, group, weight))
    whole = g.part(list(g.names), list(g.names))
    best = _best(whole, *_corrections(sums, k, ratios), ratios, g.rows, unit_variance)
    if len(ratios) > 1:
        step = (ratios[1] / ratios[0]) ** 0.1
        finer = tuple(best[0] * step**i for i in range(-10, 11))
        best = _best(whole, *_corrections(sums, k, finer), finer, g.rows, unit_variance)
    ratio, beta, sigma2 = best
    fixed = Fit(float(beta[0]), dict(zip(columns, beta[1:].tolist(), strict=True)))
    fitted = sum((F.lit(float(b)) * F.col(f"s{i}") for i, b in enumerate(beta)), F.lit(0.0))
    effects = sums.select(group, (ratio / (1 + ratio * F.col("w")) * (F.col(f"s{k - 1}") - fitted)).alias("effect"))
    return MixedFit(fixed, float(np.sqrt(sigma2)), ratio, effects)


def _best(m: np.ndarray, corrections: np.ndarray, logs: np.ndarray, ratios: tuple[float, ...], n: int, unit: bool) -> tuple[float, np.ndarray, float]:
    found = None
    for c, log_det, ratio in zip(corrections, logs, ratios, strict=True):
        v = m - c
        a, b = v[:-1, :-1], v[:-1, -1]
        beta = np.linalg.solve(a, b)
        rest = max(float(v[-1, -1] - b @ beta), 1e-300)
        df = n - len(b)
        s2 = 1.0 if unit else rest / df
        value = log_det + np.linalg.slogdet(a)[1] + (rest if unit else df * np.log(s2))
        if found is None or value < found[0]:
            found = (value, ratio, beta, s2)
    return found[1:]


def penalized_quasi(df: DataFrame, columns: dict[str, Column], y: Column, group: str, family: Family, weight: Column | None = None, rounds: int = 12, tol: float = 1e-6) -> MixedFit:
    """A generalized model with random intercepts: mixed models on working responses until they settle."""
    weight = F.lit(1.0) if weight is None else weight
    rows = df.select(y.cast("double").alias("_resp"), weight.cast("double").alias("_w"), F.col(group).alias("_g"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns.values())])
    cols = {n: F.col(f"_x{i}") for i, n in enumerate(columns)}
    mean = rows.agg((F.sum(F.col("_w") * F.col("_resp")) / F.sum("_w")).alias("m")).first().m
    fit = MixedFit(Fit(float(family.link.np_link(np.array([min(max(mean, 1e-3), 1 - 1e-3) if family.name == "binomial" else max(mean, 1e-3)]))[0]), dict.fromkeys(columns, 0.0)), 1.0, 0.0, rows.select("_g").distinct().withColumn("effect", F.lit(0.0)))
    for _ in range(rounds):
        known = fit.effects.withColumnRenamed("_g", "_of")
        eta = predictor(fit.fixed, cols)
        work = rows.join(known, F.col("_g").eqNullSafe(F.col("_of")), "left").withColumn("_eta", eta + F.coalesce("effect", F.lit(0.0))).drop("_of", "effect")
        p = family.pseudo_data(F.col("_eta"), F.col("_resp"), F.lit(0.0), F.col("_w"))
        work = work.withColumns({"_z": p["z"], "_ww": p["wobs"]})
        after = random_intercept(work, cols, F.col("_z"), "_g", F.col("_ww"), unit_variance=True)
        # Effects are as many as groups; cutting them keeps the plan from growing with the rounds.
        after = MixedFit(after.fixed, after.sigma, after.ratio, cut(after.effects))
        moved = max(abs(after.fixed.intercept - fit.fixed.intercept), *[abs(after.fixed.beta[c] - fit.fixed.beta[c]) for c in columns], 0.0)
        fit = after
        if moved < tol:
            break
    return MixedFit(fit.fixed, fit.sigma, fit.ratio, fit.effects.withColumnRenamed("_g", group))


def new_effect(level: Column, sd: float, seed: int = 1) -> Column:
    """A normal draw keyed by the level's hash: the same level always has the same effect."""
    u = [(F.pmod(F.xxhash64(level.cast("string"), F.lit(seed + i)), F.lit(1 << 32)) + 0.5) / (1 << 32) for i in (0, 1)]
    return sd * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def new_level_effects(levels: DataFrame, group: str, sd: float, seed: int = 1) -> DataFrame:
    """Effects for levels that were not seen."""
    return levels.withColumn("effect", new_effect(F.col(group), sd, seed))

