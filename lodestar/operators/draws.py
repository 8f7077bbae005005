"""Compression of posterior draws: thinning, clustering and aggregation of draw arrays.

A row holds one observation and an array over draws, so compression never shuffles observations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import doubles, let, total
from lodestar.operators.gram import summed_blocks
from lodestar.operators.keyed import INCREMENT, MODULUS, MULTIPLIER

#: Draw weights within a cluster are shrunk by this factor, for numerical stability.
SHRINK = 1 - 1e-10


@dataclass(frozen=True)
class Clusters:
    """Labels from 0, null for dropped draws, and the draws' weights."""

    labels: tuple[int | None, ...]
    weights: tuple[float, ...]

    @property
    def n(self) -> int:
        return max((c for c in self.labels if c is not None), default=-1) + 1

    def shares(self) -> list[float]:
        """Each cluster's share of the kept weight."""
        sums = [sum(w for c, w in zip(self.labels, self.weights, strict=True) if c == k) for k in range(self.n)]
        return [s / sum(sums) for s in sums]

    def within(self, k: int) -> list[float]:
        """Every draw's weight within the cluster, shrunk; zero outside it."""
        own = [w if c == k else 0.0 for c, w in zip(self.labels, self.weights, strict=True)]
        return [w / sum(own) * SHRINK for w in own]

    def reweighted(self, weights) -> Clusters:
        """The same labels under other draw weights, as importance sampling needs."""
        return Clusters(self.labels, tuple(float(w) for w in weights))


def thinned(draws: int, wanted: int) -> list[int]:
    """Evenly spaced draw numbers from 1, halves rounded to even."""
    return [int(np.round(v)) for v in np.linspace(1, draws, min(wanted, draws))]


def subsampled(draws: int, wanted: int, seed: int = 0) -> list[int]:
    """Draw numbers without replacement, in keyed random order."""
    once = [((s % (1 << 32) * MULTIPLIER + INCREMENT + seed * 69069) % MODULUS, s) for s in range(1, draws + 1)]
    return [s for _, s in sorted(((h * MULTIPLIER + INCREMENT) % MODULUS, s) for h, s in once)][: min(wanted, draws)]


def picked(values: Column, numbers: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in numbers]), lambda i: F.element_at(values, i))


def aggregated(values: Column, clusters: Clusters) -> Column:
    """Weighted means over each cluster's draws, as an array over clusters."""
    return F.array(*[total(F.zip_with(values, doubles(clusters.within(k)), lambda v, w: v * w)) for k in range(clusters.n)])


def predictive_variance(mu: Column, dis: list[float], clusters: Clusters) -> Column:
    """Gaussian predictive variance by cluster: mean squared dispersion plus the spread of means."""
    out = []
    for k in range(clusters.n):
        ws = clusters.within(k)
        w = doubles(ws)
        spread = let(total(F.zip_with(mu, w, lambda v, u: v * u)), _spread_about(mu, w))
        out.append(F.lit(float(sum(a * d * d for a, d in zip(ws, dis, strict=True)))) + spread)
    return F.array(*out)


def _spread_about(mu: Column, w: Column):
    return lambda mean: total(F.zip_with(mu, w, lambda v, u: u * (v - mean) * (v - mean)))


def reduction(total: int, n_draws: int | None = None, clusters: int | None = None) -> tuple[str, int]:
    """Whether draws are clustered or thinned, and to how many.

    A number of clusters goes before a number of draws; neither is more than there are; without
    either every draw is kept, and as many clusters as draws are the draws themselves.
    """
    if any(n is not None and n < 1 for n in (n_draws, clusters)):
        raise ValueError("at least one draw or cluster is needed")
    if clusters is not None and clusters < total:
        return "clusters", clusters
    return "draws", total if clusters is not None or n_draws is None else min(n_draws, total)


def mean_by_cluster(draws: DataFrame, cluster: str, value: str, weight: str) -> DataFrame:
    """Weighted means of parameter draws by cluster; draws without label are dropped."""
    return draws.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def draw_gram(df: DataFrame, eta: str, n_draws: int, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """Inner products of all pairs of draws over all observations, from one Arrow pass; ``change`` maps the values first."""

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        x = change(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n_draws))
        yield 0, batch.num_rows, x.T @ x

    found = summed_blocks(df.select(F.lit(0).alias("g"), F.col(eta).cast("array<double>")), blocks, n_draws)
    return found[0][1] if found else np.zeros((n_draws, n_draws))


def kmeans(gram: np.ndarray, k: int, seed: int = 1, rounds: int = 50) -> list[int]:
    """k-means of draws from their inner products alone: distances to centers need nothing else."""
    rng = np.random.default_rng(seed)
    n, norm = len(gram), np.diag(gram)
    k = min(k, n)
    centers = [int(rng.integers(n))]
    near = norm + norm[centers[0]] - 2 * gram[:, centers[0]]
    while len(centers) < k:
        p = np.maximum(near, 0)
        centers.append(int(rng.choice(n, p=p / p.sum())) if p.sum() > 0 else next(i for i in range(n) if i not in centers))
        near = np.minimum(near, norm + norm[centers[-1]] - 2 * gram[:, centers[-1]])
    labels = np.argmin(np.stack([norm + norm[c] - 2 * gram[:, c] for c in centers]), axis=0)
    for _ in range(rounds):
        member = np.stack([labels == c for c in range(k)]).astype(float)
        member /= np.maximum(member.sum(axis=1, keepdims=True), 1)
        cross = member @ gram
        d = norm[None, :] - 2 * cross + (cross * member).sum(axis=1)[:, None]
        after = np.argmin(d, axis=0)
        for c in set(range(k)) - set(after.tolist()):
            after[int(np.argmax(d[after, np.arange(n)]))] = c
        if (after == labels).all():
            break
        labels = after
    return labels.tolist()
