"""Reference models: the data itself, built-in Bayesian and Laplace fits, or a user's posterior draws.

A reference model is a table of observations (obs_id, y, wobs, offs, the predictors) with an array
``mu`` over draws, and small arrays of dispersions and draw weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.families import Family, binomial, gaussian, poisson
from lodestar.operators import evaluate, irls
from lodestar.operators.gram import INTERCEPT, Gram, gram
from lodestar.operators.solve import Fit


@dataclass(frozen=True)
class RefModel:
    """Observations with ``mu`` over draws, dispersion and weight of each draw, family and term columns."""

    data: DataFrame
    family: Family
    columns: dict[str, Column]
    terms: dict[str, list[str]]
    dis: list[float]
    weights: list[float]
    is_datafit: bool = False
    fits: tuple[Fit, ...] = ()
    predict: Callable[[DataFrame], DataFrame] | None = None
    known: tuple[DataFrame, Gram] | None = None

    @property
    def moments(self) -> Gram | None:
        """Those of the predictors and ``_y``, the response less offsets, if this model was fitted by them to these rows."""
        return self.known[1] if self.known and self.known[0] is self.data else None

    @property
    def n_draws(self) -> int:
        return len(self.weights)

    def on(self, data: DataFrame) -> RefModel:
        """The same model's predictions for other rows with y, wobs and offs."""
        if self.is_datafit:
            raise ValueError("the data as reference model has no predictions for new data")
        if self.predict:
            return replace(self, data=self.predict(data))
        if not self.fits:
            raise ValueError("draws have no predictions for new rows without a function that gives them")
        mu = evaluate.means(evaluate.predictors(list(self.fits), self.columns, F.col("offs")), self.family)
        return replace(self, data=data.withColumn("mu", mu))


def datafit(data: DataFrame, family: Family, columns: dict[str, Column], terms: dict[str, list[str]]) -> RefModel:
    """The responses themselves as the fit: one draw without dispersion."""
    mu = F.col("y") / F.col("wobs") if family.name == "binomial" else F.col("y")
    return RefModel(data.withColumn("mu", F.array(mu)), family, columns, terms, [0.0], [1.0], is_datafit=True)


def posterior(g: Gram, cols: list[str], target: str, draws: int, seed: int = 1, prior: float = 1e-6) -> tuple[list[Fit], list[float]]:
    """Draws of coefficients and residual deviations of a conjugate Gaussian model, from moments."""
    names = [INTERCEPT, *cols]
    a = g.shifted(names, names) + prior * np.diag([0.0] + [1.0] * len(cols))
    b = g.shifted(names, [target])[:, 0]
    center = np.linalg.solve(a, b)
    rest = max(float(g.shifted([target], [target])[0, 0] - b @ center), 1e-12)
    rng = np.random.default_rng(seed)
    sigma = np.sqrt(rest / 2 / rng.gamma(max(g.rows - len(names), 1) / 2, 1.0, draws))
    spread = np.linalg.cholesky(np.linalg.inv(a))
    betas = center + sigma[:, None] * (rng.standard_normal((draws, len(names))) @ spread.T)
    intercepts = betas[:, 0] + g.offsets([target])[0] - betas[:, 1:] @ g.offsets(cols)
    return [Fit(float(o), dict(zip(cols, v[1:].tolist(), strict=True))) for o, v in zip(intercepts, betas, strict=True)], sigma.tolist()


def gaussian_conjugate(data: DataFrame, columns: dict[str, Column], terms: dict[str, list[str]], draws: int = 400, seed: int = 1) -> RefModel:
    """Posterior draws of a linear model from one scan of second moments."""
    target = F.col("y") - F.col("offs")
    g = gram(data, {**columns, "_y": target}, F.col("wobs"))
    fits, sigma = posterior(g, list(columns), "_y", draws, seed)
    mu = evaluate.predictors(fits, columns, F.col("offs"))
    rows = data.withColumn("mu", mu)
    return RefModel(rows, gaussian(), columns, terms, sigma, [1 / draws] * draws, fits=tuple(fits), known=(rows, g))


def glm_laplace(data: DataFrame, family: Family, columns: dict[str, Column], terms: dict[str, list[str]], draws: int = 200, seed: int = 1) -> RefModel:
    """Normal draws around the mode of a binomial or Poisson model, by its curvature there."""
    if family.name not in ("binomial", "poisson"):
        raise ValueError("binomial or poisson")
    y = F.col("y") / F.col("wobs") if family.name == "binomial" else F.col("y")
    fit = irls.project(data, columns, F.array(y), family, [irls.Job(tuple(columns))], F.col("wobs"), F.col("offs"), regul=1e-3)[0]
    eta = irls.predictor(fit, columns) + F.col("offs")
    mu = family.link.inverse(eta)
    curvature = F.col("wobs") * (mu * (1 - mu) if family.name == "binomial" else mu)
    names = [INTERCEPT, *columns]
    h = gram(data, columns, curvature).part(names, names)
    rng = np.random.default_rng(seed)
    spread = np.linalg.cholesky(np.linalg.inv(h + 1e-9 * np.eye(len(names))))
    center = np.array([fit.intercept, *fit.beta.values()])
    betas = center + rng.standard_normal((draws, len(names))) @ spread.T
    fits = [Fit(float(v[0]), dict(zip(columns, v[1:].tolist(), strict=True))) for v in betas]
    mus = evaluate.means(evaluate.predictors(fits, columns, F.col("offs")), family)
    return RefModel(data.withColumn("mu", mus), family, columns, terms, [1.0] * draws, [1 / draws] * draws, fits=tuple(fits))


def from_draws(data: DataFrame, draws: DataFrame, family: Family, columns: dict[str, Column], terms: dict[str, list[str]], dis: list[float] | None = None, predict: Callable[[DataFrame], DataFrame] | None = None) -> RefModel:
    """A user's table (obs_id, mu array) of posterior expectations, offsets included, on the response scale.

    ``dis`` holds each draw's dispersion where the family has one. ``predict`` adds the column mu to
    new rows with y, wobs, offs and the predictors; without it the model can't be evaluated on rows
    that it wasn't given for.
    """
    n = draws.select(F.size("mu").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if n.a is None or n.a < 1:
        raise ValueError("every observation needs an array of at least one draw")
    if n.a != n.b or (family.has_dispersion and (dis is None or len(dis) != n.a)):
        raise ValueError("every observation needs the same number of draws, and every draw its dispersion")
    return RefModel(data.join(draws.select("obs_id", "mu"), "obs_id"), family, columns, terms, list(dis or [1.0] * n.a), [1 / n.a] * n.a, predict=predict)


FAMILIES = {"gaussian": gaussian, "binomial": binomial, "poisson": poisson}
__all__ = ["FAMILIES", "RefModel", "datafit", "from_draws", "gaussian_conjugate", "glm_laplace", "posterior"]
