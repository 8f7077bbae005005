"""Links and response families, as Spark columns and as numpy kernels of the same formulas."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions import normal

EPS = 2.220446049250313e-16


def lgamma(x: Column) -> Column:
    """Log-gamma for positive x: Stirling's series eight steps up, taken back by the recurrence."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def np_lgamma(x: np.ndarray) -> np.ndarray:
    """``lgamma`` on arrays."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    steps = sum(np.log(x + i) for i in range(8))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


@F.pandas_udf(T.DoubleType())
def _pnorm(x: pd.Series) -> pd.Series:
    return pd.Series(normal.cdf(x.to_numpy(float)), index=x.index)


@F.pandas_udf(T.DoubleType())
def _qnorm(p: pd.Series) -> pd.Series:
    return pd.Series(normal.quantile(np.clip(p.to_numpy(float), 0.0, 1.0)), index=p.index)


@dataclass(frozen=True)
class Link:
    """A link, its inverse and the derivative of the inverse; columns and numpy."""

    name: str
    link: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    np_link: Callable[[np.ndarray], np.ndarray]
    np_inverse: Callable[[np.ndarray], np.ndarray]
    np_slope: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[Column], Column]


def _expit(x):
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _phi(x):
    return np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


LINKS = {
    link.name: link
    for link in (
        Link("identity", lambda m: m, lambda e: e, lambda m: m, lambda e: e, lambda e: np.ones_like(e), lambda e: F.lit(1.0)),
        Link("log", F.log, F.exp, np.log, np.exp, np.exp, F.exp),
        Link("logit", lambda m: F.log(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda m: np.log(m / (1 - m)), _expit, lambda e: _expit(e) * (1 - _expit(e)), lambda e: F.exp(-e) / F.pow(1 + F.exp(-e), 2)),
        Link("probit", lambda m: _qnorm(m), lambda e: _pnorm(e), normal.quantile, normal.cdf, _phi, lambda e: F.exp(-0.5 * e * e) / math.sqrt(2 * math.pi)),
        Link("cauchit", lambda m: F.tan(math.pi * (m - 0.5)), lambda e: 0.5 + F.atan(e) / math.pi, lambda m: np.tan(math.pi * (m - 0.5)), lambda e: 0.5 + np.arctan(e) / math.pi, lambda e: 1 / (math.pi * (1 + e * e)), lambda e: 1 / (math.pi * (1 + e * e))),
        Link("cloglog", lambda m: F.log(-F.log1p(-m)), lambda e: -F.expm1(-F.exp(e)), lambda m: np.log(-np.log1p(-m)), lambda e: -np.expm1(-np.exp(e)), lambda e: np.exp(e - np.exp(e)), lambda e: F.exp(e - F.exp(e))),
        Link("inverse", lambda m: 1 / m, lambda e: 1 / e, lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e), lambda e: -1 / (e * e)),
        Link("sqrt", F.sqrt, lambda e: e * e, np.sqrt, lambda e: e * e, lambda e: 2 * e, lambda e: 2 * e),
    )
}
ALIASES = {"logistic": "logit", "probit_approx": "probit"}


def link_of(name: str) -> Link:
    return LINKS[ALIASES.get(name, name)]


def clamp(p: Column) -> Column:
    """Probabilities away from zero and one, so that their logarithms are finite in any engine."""
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))


@dataclass(frozen=True)
class Family:
    """A response distribution under a link.

    ``cross_entropy`` and ``log_lik`` are columns of one observation; weights multiply where the
    family says so (binomial weights are trial counts inside the likelihood).
    """

    name: str
    link: Link
    has_dispersion: bool = False
    negative_predictor: bool = False
    nu: float = 0.0

    def cross_entropy(self, ref: Column, sub: Column) -> Column:
        """Per-observation cross-entropy, up to terms that no submodel changes; averaged by weight."""
        if self.name == "binomial":
            q = clamp(sub)
            return -(ref * F.log(q) + (1 - ref) * F.log(1 - q))
        if self.name == "poisson":
            return -(ref * F.log(F.greatest(sub, F.lit(EPS))) - sub)
        if self.name != "gaussian":
            raise ValueError(f"no cross-entropy for the family {self.name}")
        return -2 * ref * sub + sub * sub

    def log_lik(self, y: Column, mu: Column, weights: Column, dis: Column | None = None) -> Column:
        if self.name == "binomial":
            p = clamp(mu)
            choose = lgamma(weights + 1) - lgamma(y + 1) - lgamma(weights - y + 1)
            return F.when(weights == 1, F.lit(0.0)).otherwise(choose) + y * F.log(p) + (weights - y) * F.log(1 - p)
        if self.name == "poisson":
            return weights * (y * F.log(F.greatest(mu, F.lit(EPS))) - mu - lgamma(y + 1))
        if self.name == "Gamma":
            return weights * (dis * F.log(dis / mu) - lgamma(dis) + (dis - 1) * F.log(y) - dis * y / mu)
        if self.name == "student_t":
            z, nu = (y - mu) / dis, F.lit(float(self.nu))
            norm = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * F.log(nu * math.pi) - F.log(dis)
            return weights * (norm - (nu + 1) / 2 * F.log1p(z * z / nu))
        return weights * (-0.5 * math.log(2 * math.pi) - F.log(dis) - 0.5 * F.pow((y - mu) / dis, 2))

    def deviance(self, y: Column, mu: Column, weights: Column, dis: Column | float = 1.0) -> Column:
        """Twice the negative log-likelihood, without terms of y alone; only Student-t observations use the dispersion."""
        if self.name == "binomial":
            q = clamp(mu)
            return -2 * weights * (y * F.log(q) + (1 - y) * F.log(1 - q))
        if self.name == "poisson":
            return -2 * weights * (y * F.log(F.greatest(mu, F.lit(EPS))) - mu)
        if self.name == "Gamma":
            return 2 * weights * (F.log(mu) + y / mu)
        if self.name == "student_t":
            return weights * (self.nu + 1) * F.log1p(F.pow((y - mu) / dis, 2) / self.nu)
        return weights * F.pow(y - mu, 2)

    def variance(self, mu: Column) -> Column:
        """The variance function, up to the dispersion."""
        if self.name == "binomial":
            return mu * (1 - mu)
        if self.name == "poisson":
            return mu
        if self.name == "Gamma":
            return mu * mu
        return F.lit(self.nu / (self.nu - 2) if self.name == "student_t" else 1.0)

    def np_variance(self, mu: np.ndarray) -> np.ndarray:
        if self.name == "binomial":
            return mu * (1 - mu)
        if self.name == "poisson":
            return mu
        if self.name == "Gamma":
            return mu * mu
        if self.name == "student_t":
            return np.full_like(mu, self.nu / (self.nu - 2))
        return np.ones_like(mu)

    def np_half_deviance(self, y: np.ndarray, mu: np.ndarray) -> np.ndarray:
        if self.name == "binomial":
            q = np.clip(mu, EPS, 1 - EPS)
            return -(y * np.log(q) + (1 - y) * np.log1p(-q))
        if self.name == "poisson":
            return mu - y * np.log(np.maximum(mu, EPS))
        if self.name == "Gamma":
            return np.log(mu) + y / mu
        if self.name == "student_t":
            return 0.5 * (self.nu + 1) * np.log1p((y - mu) ** 2 / self.nu)
        return 0.5 * (y - mu) ** 2

    def np_log_lik(self, y: np.ndarray, mu: np.ndarray, weights: np.ndarray, dis: np.ndarray) -> np.ndarray:
        """``log_lik`` on arrays that broadcast against each other."""
        if self.name == "binomial":
            p = np.clip(mu, EPS, 1 - EPS)
            choose = np.where(weights == 1, 0.0, np_lgamma(weights + 1) - np_lgamma(y + 1) - np_lgamma(weights - y + 1))
            return choose + y * np.log(p) + (weights - y) * np.log1p(-p)
        if self.name == "poisson":
            return weights * (y * np.log(np.maximum(mu, EPS)) - mu - np_lgamma(y + 1))
        if self.name == "Gamma":
            return weights * (dis * np.log(dis / mu) - np_lgamma(dis) + (dis - 1) * np.log(y) - dis * y / mu)
        if self.name == "student_t":
            nu = np.float64(self.nu)
            norm = np_lgamma((nu + 1) / 2) - np_lgamma(nu / 2) - 0.5 * np.log(nu * math.pi) - np.log(dis)
            return weights * (norm - (nu + 1) / 2 * np.log1p(((y - mu) / dis) ** 2 / nu))
        return weights * (-0.5 * math.log(2 * math.pi) - np.log(dis) - 0.5 * ((y - mu) / dis) ** 2)

    def pseudo_data(self, f: Column, y: Column, offset: Column, weights: Column, dis: Column | float = 1.0) -> dict[str, Column]:
        """Working response z, working weight and gradient of the quadratic approximation at f.

        Student-t observations get the weights of their scale mixture: those far out count less.
        """
        eta = f + offset
        mu, slope = self.link.inverse(eta), self.link.slope(eta)
        if self.name == "student_t":
            w = weights * slope * slope * (self.nu + 1) / (self.nu + F.pow((y - mu) / dis, 2))
        else:
            w = weights * slope * slope / self.variance(mu)
        z = f + (y - mu) / slope
        return {"z": z, "wobs": w, "grad": -w * (z - f), "loss": 0.5 * self.deviance(y, mu, weights, dis)}


def gaussian(link: str = "identity") -> Family:
    return Family("gaussian", link_of(link), has_dispersion=True)


def binomial(link: str = "logit") -> Family:
    return Family("binomial", link_of(link))


def poisson(link: str = "log") -> Family:
    return Family("poisson", link_of(link))


def gamma(link: str = "inverse") -> Family:
    return Family("Gamma", link_of(link), has_dispersion=True)


def student_t(nu: float = 3.0, link: str = "identity") -> Family:
    """Scaled t observations; only identity, log and inverse links exist for it."""
    if link not in ("identity", "log", "inverse"):
        raise ValueError(f"no link {link} for Student-t observations")
    return Family("student_t", link_of(link), has_dispersion=True, nu=nu)


def category_cross_entropy(ref: Column, sub: Column) -> Column:
    """Cross-entropy of arrays of category probabilities; zeros of the submodel become the machine epsilon."""
    return -F.aggregate(F.zip_with(ref, sub, lambda p, q: p * F.log(F.greatest(q, F.lit(EPS)))), F.lit(0.0), lambda a, x: a + x)


def category_log_lik(probabilities: Column, y: Column, levels: list[str], weights: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), y).cast("int")
    return weights * F.log(F.greatest(F.try_element_at(probabilities, at), F.lit(EPS)))


def cumulative_probabilities(eta: Column, thresholds: list[float], link: str = "logit") -> Column:
    """Probabilities of ordered categories: differences of the inverse-linked thresholds minus the predictor."""
    inverse = link_of(link).inverse
    bounds = [F.lit(0.0), *[inverse(F.lit(float(t)) - eta) for t in thresholds], F.lit(1.0)]
    return F.array(*[b - a for a, b in zip(bounds, bounds[1:], strict=False)])


def softmax_probabilities(etas: list[Column]) -> Column:
    """Probabilities of unordered categories; the first has predictor zero."""
    top = F.greatest(F.lit(0.0), *etas) if etas else F.lit(0.0)
    parts = [F.exp(-top), *[F.exp(e - top) for e in etas]]
    norm = sum(parts[1:], parts[0])
    return F.array(*[p / norm for p in parts])
