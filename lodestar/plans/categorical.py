"""Variable selection for responses of several categories, ordered or not.

The reference model gives every observation an array over draws of probabilities over categories. The
search projects clusters of draws onto all candidates at once; single draws are projected onto every
size and evaluated in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import doubles, total
from lodestar.functions.families import EPS
from lodestar.operators import categories, draws, post, stats
from lodestar.operators import formula as fm
from lodestar.operators.categories import CategoryFit, Job
from lodestar.operators.draws import Clusters
from lodestar.operators.search import SearchPath
from lodestar.operators.solve import REGUL, Fit
from lodestar.plans import options, selection
from lodestar.sources.refmodel import RefModel

STATS = ["elpd", "mlpd", "gmpd", "acc"]


@dataclass(frozen=True)
class CategoryModel:
    """Observations (obs_id, y, the predictors) with ``mu``, an array over draws of arrays over ``levels``."""

    data: DataFrame
    levels: list[str]
    columns: dict[str, Column]
    terms: dict[str, list[str]]
    weights: list[float]
    ordered: bool = False
    link: str = "logit"


def from_draws(data: DataFrame, levels: list[str], columns: dict[str, Column], terms: dict[str, list[str]], ordered: bool = False, link: str = "logit") -> CategoryModel:
    """A user's draws of category probabilities in the column mu; they are checked for their number and sum."""
    odd = F.exists("mu", lambda p: (F.size(p) != len(levels)) | (F.abs(total(p) - 1) > 1e-6))
    row = data.agg(F.min(F.size("mu")).alias("a"), F.max(F.size("mu")).alias("b"), F.count_if(odd | F.col("mu").isNull()).alias("odd"), F.count_if(~F.coalesce(F.col("y").isin(levels), F.lit(False))).alias("unknown")).first()
    if row.unknown:
        raise ValueError("responses must be among the levels")
    if row.a is None or row.a < 1 or row.a != row.b or row.odd:
        raise ValueError("every observation needs the same number of draws, and every draw probabilities that sum to one")
    return CategoryModel(data, levels, columns, terms, [1 / row.a] * row.a, ordered, link)


def fitted(data: DataFrame, levels: list[str], columns: dict[str, Column], terms: dict[str, list[str]], n_draws: int = 100, ordered: bool = False, link: str = "logit", seed: int = 1) -> CategoryModel:
    """A reference model of its own: bootstrap draws around the full model, by Poisson weights keyed by observation."""
    target = F.array(categories.one_hot(F.col("y"), levels))
    taken = F.transform(F.sequence(F.lit(0), F.lit(n_draws - 1)), lambda j: -F.log((F.pmod(F.xxhash64("obs_id", j, F.lit(seed)), F.lit(1 << 32)) + 0.5) / (1 << 32)))
    # Exponential weights make draws of a Bayesian bootstrap; each is a target whose mass is its weight.
    weighted = F.transform(taken, lambda w: F.transform(F.get(target, F.lit(0)), lambda v: v * w))
    fits = categories.project_many(data, columns, weighted, len(levels), [Job(tuple(columns), j) for j in range(n_draws)], ordered, link, regul=1e-3)
    model = CategoryModel(data, levels, columns, terms, [1 / n_draws] * n_draws, ordered, link)
    return from_draws(_with_probabilities(model, fits, "mu"), levels, columns, terms, ordered, link)


def _matrix(fit: CategoryFit, model: CategoryModel, x: np.ndarray, at: dict[str, int]) -> np.ndarray:
    """Probabilities of a fit; ``x`` has the intercept and all columns."""
    z = x[:, [0, *[1 + at[c] for c in fit.cols]]]
    if model.ordered:
        return categories.ordinal_probabilities_of(fit.theta, z, len(model.levels), model.link)
    return categories.softmax_probabilities_of(fit.theta, z, len(model.levels))


def _plain(model: CategoryModel) -> CategoryModel:
    """What tasks need of the model."""
    return CategoryModel(None, model.levels, {}, {}, model.weights, model.ordered, model.link)


def _with_probabilities(model: CategoryModel, fits: list[CategoryFit], name: str) -> DataFrame:
    """The model's rows with an array over fits of probabilities."""
    plain, at, names = _plain(model), {c: i for i, c in enumerate(model.columns)}, list(model.data.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(len(at))]])
            found = np.stack([_matrix(f, plain, x, at) for f in fits], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found.tolist(), pa.list_(pa.list_(pa.float64())))], [*names, name])

    rows = model.data.select("*", *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(model.columns.values())])
    kinds = ", ".join(f"`{n}` {t}" for n, t in model.data.dtypes)
    return rows.mapInArrow(run, f"{kinds}, `{name}` array<array<double>>")


def clustered(model: CategoryModel, wanted: int) -> Clusters:
    """k-means of draws on their log ratios to the first category."""
    n = len(model.weights)
    if n <= wanted:
        return Clusters(tuple(range(n)), tuple(model.weights))
    floor = lambda p: F.greatest(p, F.lit(EPS))
    ratios = F.array(*[F.transform("mu", _log_ratio(c, floor)) for c in range(1, len(model.levels))])
    return Clusters(tuple(draws.kmeans(draws.draw_gram(model.data.select(F.explode(ratios).alias("eta")), "eta", n), wanted)), tuple(model.weights))


def _log_ratio(c: int, floor):
    return lambda p: F.log(floor(F.get(p, F.lit(c))) / floor(F.get(p, F.lit(0))))


def _centers(model: CategoryModel, own: Clusters) -> Column:
    """An array over clusters of mean probabilities."""
    part = lambda k, c: total(F.zip_with("mu", doubles(own.within(k)), lambda p, w: F.get(p, F.lit(c)) * w))
    return F.array(*[F.array(*[part(k, c) for c in range(len(model.levels))]) for k in range(own.n)])


class CategorySelection(selection.Selection):
    """``pointwise`` has y = 1 and mu = 1 where the likeliest category was observed, else 0, beside lppd."""

    def summary(self, names: list[str] | None = None, baseline: str | int | None = None, alpha: float = stats.ALPHA) -> DataFrame:
        return post.performance_table(self._statistics(names, baseline, alpha), self._statistics(names, "ref", alpha), names or STATS)

    def _statistics(self, names: list[str] | None, baseline: str | int | None = None, alpha: float = stats.ALPHA) -> DataFrame:
        options.check_stats(names or STATS, "categorical", "augmented")
        return stats.statistics(self.pointwise, names or STATS, baseline, alpha)


def varsel(model: CategoryModel, largest: int = selection.LARGEST, clusters: int = 5, prediction_draws: int = 20, regul: float = REGUL, test: CategoryModel | None = None) -> CategorySelection:
    """Forward search by cross-entropy with the clusters' mean probabilities, and the evaluation of every size.

    ``test`` is the same reference model on other rows.
    """
    options.check_search("forward", list(model.terms), True)
    own = clustered(model, clusters)
    path = _search(model, own, largest, regul)
    numbers = draws.thinned(len(model.weights), prediction_draws)
    jobs = [Job(_columns(model, path.ranking[:k]), d) for k in range(len(path.sizes)) for d in range(len(numbers))]
    fits = categories.project_many(model.data, model.columns, draws.picked(F.col("mu"), numbers), len(model.levels), jobs, model.ordered, model.link, regul=regul)
    by_size = {size: (fits[k * len(numbers) : (k + 1) * len(numbers)], [1 / len(numbers)] * len(numbers), [1.0] * len(numbers)) for k, size in enumerate(path.sizes)}
    ref = RefModel(model.data, None, model.columns, model.terms, [1.0] * len(model.weights), model.weights)
    return CategorySelection(ref, path, _pointwise(test or model, by_size).persist(), {0: path.ranking}, by_size)


def _columns(model: CategoryModel, terms: list[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for step in terms for t in fm.split_top(step) for c in model.terms[t]))


def _search(model: CategoryModel, own: Clusters, largest: int, regul: float) -> SearchPath:
    shares, chosen, ranking, sizes, scores, fits = own.shares(), [], [], [], [], []
    targets = _centers(model, own)
    for size in range(1, min(largest, len(model.terms)) + 2):
        new = [[]] if size == 1 else fm.candidates(chosen, list(model.terms), size)
        if not new:
            continue
        jobs = [Job(_columns(model, [*chosen, *n]), k) for n in new for k in range(own.n)]
        found = categories.project_many(model.data, model.columns, targets, len(model.levels), jobs, model.ordered, model.link, regul=regul)
        values = [sum(w * found[i * own.n + k].score for k, w in enumerate(shares)) for i in range(len(new))]
        best = min(range(len(new)), key=lambda i: (values[i], i))
        chosen = [*chosen, *new[best]]
        if size > 1:
            ranking.append(" + ".join(new[best]))
        sizes.append(size - 1)
        scores.append(values[best])
        fits.append(Fit(0.0, {}))
    return SearchPath(ranking, sizes, fits, scores)


def _pointwise(model: CategoryModel, by_size: dict) -> DataFrame:
    """(obs_id, y, wobs, size, mu, lppd, mu_ref, lppd_ref) in one scan: the reference's rows have no size."""
    plain, at, levels = _plain(model), {c: i for i, c in enumerate(model.columns)}, {v: i for i, v in enumerate(model.levels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = np.array([levels[v] for v in batch.column(1).to_pylist()])
            mu = batch.column(2).flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1, len(levels))
            x = np.column_stack([np.ones(n), *[batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(at))]])

            def told(mean: np.ndarray, y: np.ndarray = y, n: int = n) -> tuple[np.ndarray, np.ndarray]:
                return (mean.argmax(axis=1) == y).astype(float), np.log(np.maximum(mean[np.arange(n), y], 1e-300))

            beside = told(np.einsum("nsc,s->nc", mu, np.array(plain.weights)))
            models = {None: beside} | {size: told(sum(w * _matrix(f, plain, x, at) for f, w in zip(fits, weights, strict=True))) for size, (fits, weights, _) in by_size.items()}
            for size, (right, lppd) in models.items():
                cells = [batch.column(0).cast(pa.int64()), np.ones(n), np.ones(n), pa.array([size] * n, pa.int32()), right, lppd, *beside]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], ["obs_id", "y", "wobs", "size", "mu", "lppd", "mu_ref", "lppd_ref"])

    rows = model.data.select(F.col("obs_id").cast("bigint"), F.col("y").cast("string"), F.col("mu").cast("array<array<double>>"), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(model.columns.values())])
    return rows.mapInArrow(run, "obs_id bigint, y double, wobs double, size int, mu double, lppd double, mu_ref double, lppd_ref double")


__all__ = ["CategoryModel", "CategorySelection", "fitted", "from_draws", "varsel"]
