"""Projections from moments: ridge, the elastic-net path, and their scores. Small dense algebra on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lodestar.operators.gram import INTERCEPT, Gram

#: Default ridge on standardized coefficients; the loss is a sum, not a mean.
REGUL = 1e-4


@dataclass(frozen=True)
class Fit:
    """Coefficients on the original scale, by column name; the intercept apart."""

    intercept: float
    beta: dict[str, float]

    def table(self) -> list[tuple[str, float]]:
        return [(INTERCEPT, self.intercept), *self.beta.items()]


def scales(g: Gram, cols: list[str]) -> np.ndarray:
    """Weighted standard deviations with n / (n - 1); zero where a column is constant."""
    n = g.rows
    var = np.diag(g.centered(cols, cols)) / g.weight * n / max(n - 1, 1)
    # What rounding leaves of a constant column: of its sums, and of the shift it was taken at.
    noise = 1e-12 * np.abs(np.diag(g.shifted(cols, cols))) / g.weight + 1e-28 * g.offsets(cols) ** 2
    return np.where(var > np.maximum(noise, 1e-312), np.sqrt(np.maximum(var, 0)), 0.0)


def ridge(g: Gram, cols: list[str], target: str, regul: float = REGUL, penalty: dict[str, float] | None = None) -> Fit:
    """Ridge projection of the target; the intercept is free, constant columns stay out."""
    sd = scales(g, cols) if cols else np.empty(0)
    used = [c for c, s in zip(cols, sd, strict=True) if s > 0 and np.isfinite((penalty or {}).get(c, 1.0))]
    s = np.array([v for c, v in zip(cols, sd, strict=True) if c in used])
    mean_y = float(g.mean([target])[0])
    if not used:
        return Fit(mean_y, dict.fromkeys(cols, 0.0))
    a = g.centered(used, used) / np.outer(s, s) + regul * np.diag([(penalty or {}).get(c, 1.0) for c in used])
    b = g.centered(used, [target])[:, 0] / s
    beta = np.linalg.solve(a, b) / s
    return Fit(mean_y - float(g.mean(used) @ beta), {c: 0.0 for c in cols} | dict(zip(used, beta.tolist(), strict=True)))


def cross_entropy(g: Gram, fit: Fit, target: str) -> float:
    """The Gaussian score of a fit: weighted mean of -2 m q + q squared."""
    mean_q, mean_m = _means(g, fit, target)
    return _spread(g, fit, target) + mean_q * mean_q - 2 * mean_q * mean_m


def _means(g: Gram, fit: Fit, target: str) -> tuple[float, float]:
    b = np.array(list(fit.beta.values()))
    return fit.intercept + float(g.mean(list(fit.beta)) @ b if len(b) else 0.0), float(g.mean([target])[0])


def _spread(g: Gram, fit: Fit, target: str) -> float:
    """``cross_entropy`` of the deviations from the means."""
    names, b = list(fit.beta), np.array(list(fit.beta.values()))
    return float((b @ g.centered(names, names) @ b - 2 * b @ g.centered(names, [target])[:, 0]) / g.weight) if names else 0.0


def dispersion(g: Gram, fit: Fit, target: str, predictive: float = 0.0) -> float:
    """Projected residual deviation: predictive variance plus what the fit leaves of the target."""
    mean_q, mean_m = _means(g, fit, target)
    left = float(g.centered([target], [target])[0, 0]) / g.weight + _spread(g, fit, target) + (mean_q - mean_m) ** 2
    return float(np.sqrt(max(predictive + left, 0.0)))


def lambda_grid(g: Gram, cols: list[str], target: str, n: int = 150, ratio: float = 1e-5, alpha: float = 1.0, penalty: dict[str, float] | None = None) -> np.ndarray:
    """Penalties from just above the one that keeps every column out, evenly spaced in logarithms."""
    sd = scales(g, cols)
    p = np.array([(penalty or {}).get(c, 1.0) for c in cols])
    free = [c for c, w in zip(cols, p, strict=True) if w == 0]
    start = ridge(g, free, target, 0.0)
    grad = g.centered(cols, [target])[:, 0] - (g.centered(cols, free) @ np.array([start.beta[c] for c in free]) if free else 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.abs(grad / sd) / (p * (alpha or 0.01))
    top = 1.001 * float(np.max(reach[np.isfinite(reach)], initial=0.0))
    return np.exp(np.linspace(np.log(top), np.log(top * ratio), n)) if top > 0 else np.zeros(n)


@dataclass(frozen=True)
class Path:
    """Fits along a penalty grid, largest penalty first."""

    lambdas: np.ndarray
    fits: list[Fit]


def elastic_net(g: Gram, cols: list[str], target: str, lambdas: np.ndarray, alpha: float = 1.0, penalty: dict[str, float] | None = None, most: int | None = None, tol: float = 1e-10) -> Path:
    """The path by coordinate descent on the moments, warm-started, over an active set first.

    Stops after ``most`` columns have entered. Columns of infinite penalty or no variance stay out.
    """
    sd = scales(g, cols)
    p = np.array([(penalty or {}).get(c, 1.0) for c in cols])
    ok = (sd > 0) & np.isfinite(p)
    unit = np.where(ok, sd, 1.0)
    a, b = g.centered(cols, cols) / np.outer(unit, unit), g.centered(cols, [target])[:, 0] / unit
    mean_x, mean_y = g.mean(cols), float(g.mean([target])[0])
    beta, fits, diag = np.zeros(len(cols)), [], np.diag(a)
    residual = b.copy()
    for lam in lambdas:
        soft, shrink = np.where(ok, p, 0.0) * lam * alpha, np.where(ok, p, 0.0) * lam * (1 - alpha)
        scope = np.flatnonzero(ok)
        while True:
            moved = 0.0
            for j in scope:
                old = beta[j]
                h = residual[j] + diag[j] * old
                new = np.sign(h) * max(abs(h) - soft[j], 0.0) / (diag[j] + shrink[j])
                if new != old:
                    residual -= a[:, j] * (new - old)
                    beta[j] = new
                    moved = max(moved, diag[j] * (new - old) ** 2)
            if moved <= tol * max(abs(b @ b), 1e-300) / max(diag.max(initial=1.0), 1e-300):
                if len(scope) == ok.sum():
                    break
                scope = np.flatnonzero(ok)
            else:
                active = np.flatnonzero(ok & (beta != 0))
                scope = active if len(active) and len(scope) == ok.sum() else scope
        original = beta / unit
        fits.append(Fit(mean_y - float(mean_x @ original), dict(zip(cols, original.tolist(), strict=True))))
        if most is not None and np.count_nonzero(beta) >= most:
            break
    return Path(np.asarray(lambdas)[: len(fits)], fits)


def entering_order(path: Path, cols: list[str]) -> list[str]:
    """Columns by the step at which they first enter, ties and those that never enter in column order."""
    first = {c: next((i for i, f in enumerate(path.fits) if f.beta[c] != 0), None) for c in cols}
    entered = sorted((c for c in cols if first[c] is not None), key=lambda c: (first[c], cols.index(c)))
    return entered + [c for c in cols if first[c] is None]


def sized_fits(path: Path, order: list[str], largest: int) -> list[Fit]:
    """For each size, the least penalized fit in which only the first so many columns take part."""
    out = [Fit(path.fits[0].intercept, {})]
    for k in range(1, largest + 1):
        rest = order[k:]
        steps = [f for f in path.fits if all(f.beta[c] == 0 for c in rest)]
        fit = steps[-1] if steps else path.fits[0]
        out.append(Fit(fit.intercept, {c: fit.beta[c] for c in order[:k]}))
    return out
