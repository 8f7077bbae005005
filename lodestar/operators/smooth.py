"""Smooth terms as penalized splines on moments.

A smooth s(x) becomes a straight line and cubic hinges at quantiles of x. One scan sums the moments;
the penalty on the hinges is chosen by generalized cross-validation on the driver, where every
candidate costs one small eigenproblem's algebra and no scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.gram import gram
from lodestar.operators.solve import Fit, scales

KNOTS = 8
PENALTIES = tuple(float(v) for v in np.geomspace(1e-6, 1e6, 49))


@dataclass(frozen=True)
class Smooth:
    """A fit on the spline's columns, its penalty and effective degrees of freedom."""

    fit: Fit
    columns: dict[str, Column]
    penalty: float
    edf: float


def basis(df: DataFrame, name: str, x: Column, knots: int = KNOTS) -> dict[str, Column]:
    """Columns of a spline in x; knots at approximate quantiles, scaled to the range."""
    at = df.select(x.cast("double").alias("x")).approxQuantile("x", [i / (knots + 1) for i in range(knots + 2)], 0.001)
    low, high = at[0], at[-1]
    span = (high - low) or 1.0
    inner = sorted({(v - low) / span for v in at[1:-1]} - {0.0, 1.0})
    u = (x - low) / span
    hinges = {f"s({name}).{i}": F.pow(F.greatest(u - k, F.lit(0.0)), F.lit(3.0)) for i, k in enumerate(inner)}
    return {f"s({name})": u, **hinges}


def fit_smooths(df: DataFrame, linear: dict[str, Column], smooths: dict[str, Column], y: Column, weight: Column | None = None, knots: int = KNOTS) -> Smooth:
    """Least squares with linear columns and smooths; hinges share one penalty, chosen by cross-validation."""
    splines = {n: basis(df, n, x, knots) for n, x in smooths.items()}
    cols = dict(linear) | {c: e for s in splines.values() for c, e in s.items()}
    names = list(cols)
    g = gram(df, {**cols, "_y": y}, weight)
    sd = scales(g, names)
    used = [n for n, s in zip(names, sd, strict=True) if s > 0]
    unit = np.array([s for s in sd if s > 0])
    a, b = g.centered(used, used) / np.outer(unit, unit), g.centered(used, ["_y"])[:, 0] / unit
    yy = float(g.centered(["_y"], ["_y"])[0, 0])
    pen = np.diag([1.0 if "." in n and n.startswith("s(") else 1e-8 for n in used])
    best = None
    for lam in PENALTIES:
        inv = np.linalg.inv(a + lam * pen + 1e-9 * np.eye(len(used)))
        beta = inv @ b
        edf = 1 + float(np.trace(inv @ a))
        rss = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
        gcv = rss / max(g.weight - edf, 1e-9) ** 2
        if best is None or gcv < best[0]:
            best = (gcv, lam, beta / unit, edf)
    _, lam, beta, edf = best
    full = dict.fromkeys(names, 0.0) | dict(zip(used, beta.tolist(), strict=True))
    intercept = float(g.mean(["_y"])[0]) - float(g.mean(names) @ np.array(list(full.values())))
    return Smooth(Fit(intercept, full), cols, lam, edf)
