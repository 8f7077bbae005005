"""Variable selection, cross-validation and projection end to end.

Gaussian analyses need one scan for the search: the reference fits are linear in the design, so the
moments of every draw, cluster and fold follow from the moments of the design. A second scan
evaluates all sizes. Other families search with batched Newton passes.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import doubles
from lodestar.functions.families import EPS
from lodestar.operators import crossval, draws, evaluate, irls, loo, post, search, solve, stats
from lodestar.operators import formula as fm
from lodestar.operators.gram import INTERCEPT, Gram, combined, draw_moments, draw_name, gram, grams
from lodestar.operators.search import SearchPath
from lodestar.operators.solve import Fit
from lodestar.plans import options
from lodestar.shared import cut
from lodestar.sources.refmodel import RefModel, glm_laplace, posterior

CLUSTERS = 20
PREDICTION_DRAWS = 400
LARGEST = 19


def with_targets(g: Gram, fits: list[Fit], names: list[str]) -> Gram:
    """Moments with linear targets appended: no further scan is needed for reference fits."""
    lift = np.zeros((len(g.names), len(fits)))
    at = {n: i for i, n in enumerate(g.names)}
    for j, f in enumerate(fits):
        lift[at[INTERCEPT], j] = f.intercept
        for c, b in f.beta.items():
            lift[at[c], j] = b
    lift[at[INTERCEPT]] += g.offsets(list(g.names)) @ lift
    full = np.hstack([np.eye(len(g.names)), lift])
    return Gram((*g.names, *names), full.T @ g.matrix @ full, g.rows, (*g.shift, *[0.0] * len(names)) if g.shift else ())


def averaged(fits: list[Fit], weights: list[float]) -> Fit:
    cols = fits[0].beta
    return Fit(sum(w * f.intercept for w, f in zip(weights, fits, strict=True)), {c: sum(w * f.beta[c] for w, f in zip(weights, fits, strict=True)) for c in cols})


@dataclass(frozen=True)
class Selection:
    """A search path and the pointwise predictions of every size and of the reference model."""

    ref: RefModel
    path: SearchPath
    pointwise: DataFrame
    fold_rankings: dict[int, list[str]]
    by_size: dict[int, tuple[list[Fit], list[float], list[float]]] | None = None
    rankings: DataFrame | None = None
    sums: tuple[DataFrame, DataFrame] | None = None

    def summary(self, names: list[str] | None = None, baseline: str | int | None = None, alpha: float = stats.ALPHA) -> DataFrame:
        """Statistics by size with differences to the reference model."""
        if names:
            options.check_stats(names, self.ref.family.name)
        return post.performance_table(self._statistics(names, baseline, alpha), self._statistics(names, "ref", alpha), names or list(stats.MOMENT_STATS))

    def _statistics(self, names: list[str] | None, baseline: str | int | None = None, alpha: float = stats.ALPHA) -> DataFrame:
        """Moment statistics in their passes, and the AUC in its own."""
        plain = [s for s in names or stats.MOMENT_STATS if s != "auc"]
        parts = [self._plain(plain, baseline, alpha)] if plain else []
        parts += [stats.auc_statistics(self.pointwise, baseline, alpha)] if "auc" in (names or []) else []
        return functools.reduce(DataFrame.unionByName, parts)

    def _plain(self, names: list[str], baseline: str | int | None, alpha: float) -> DataFrame:
        """From sums of one pass where the pointwise table has them, without that table."""
        if self.merged is None or baseline not in (None, "ref"):
            return stats.statistics(self.pointwise, names, baseline, alpha)
        delta = baseline is not None
        rows = self.pointwise.sparkSession.createDataFrame(stats.moment_rows(self.merged, delta), stats.MOMENTS)
        return stats.moment_statistics(rows, names, delta, alpha)

    @functools.cached_property
    def merged(self) -> list | None:
        """A row for each size with what its statistics need; ``sums`` names the pointwise table that its tasks' sums are of."""
        return stats.merged(self.sums[1]).collect() if self.sums and self.sums[0] is self.pointwise else None

    def release(self) -> None:
        """Lets the pointwise table go; it is kept from the first use on."""
        self.pointwise.unpersist()

    def project(self, size: int | None = None, n_draws: int = PREDICTION_DRAWS) -> Projection:
        """The reference model projected onto the ranking's first terms, by default as many as ``suggested`` says."""
        size = self.suggested().first().suggested_size if size is None else size
        if size not in self.path.sizes:
            raise ValueError(f"no submodel of size {size}")
        terms = [t for step in self.path.ranking[: self.path.sizes.index(size)] for t in fm.split_top(step)]
        return project(self.ref, terms, n_draws)

    def reference(self, names: list[str] | None = None) -> DataFrame:
        return post.reference_performance(self._statistics(names))

    def suggested(self, stat: str = "elpd", **rule) -> DataFrame:
        return post.suggest_size(self._statistics([stat], "ref"), stat, max(self.path.sizes), **rule)

    def proportions(self, cumulate: bool = False) -> DataFrame:
        """Shares of folds, or of left-out observations, that rank a term at a position."""
        if self.rankings is not None:
            return post.ranking_proportions(self.rankings, self.path.ranking, cumulate)
        folds = {f: r for f, r in self.fold_rankings.items() if f}
        return post.ranking_proportions(search.rank_table(self.ref.data.sparkSession, folds), self.path.ranking, cumulate)


@dataclass(frozen=True)
class GaussianFits:
    """Reference draws, or the data, as targets of moments."""

    g: Gram
    targets: list[str]
    weights: list[float]
    dis: list[float]


def _moments(ref: RefModel) -> Gram:
    """Moments of predictors and response, and of a user's draws less offsets, which don't follow from coefficients."""
    if ref.moments:
        return ref.moments
    columns = {**ref.columns, "_y": _target()}
    if ref.fits or ref.is_datafit:
        return gram(ref.data, columns, F.col("wobs"))
    found = draw_moments(ref.data, columns, _less_offsets(), ref.n_draws, F.col("wobs"))
    if not found:
        raise ValueError("no observations")
    return found[0]


def _less_offsets() -> Column:
    return F.transform("mu", lambda v: v - F.col("offs"))


def _gaussian(ref: RefModel, g: Gram, fits: list[Fit], dis: list[float], keep: int) -> GaussianFits:
    """At most ``keep`` thinned draws as targets; the data itself is one target without dispersion."""
    if ref.is_datafit:
        return GaussianFits(g, ["_y"], [1.0], [0.0])
    numbers = draws.thinned(len(dis), keep)
    if not fits:
        return GaussianFits(g, [draw_name(i) for i in numbers], [1 / len(numbers)] * len(numbers), [dis[i - 1] for i in numbers])
    chosen = [fits[i - 1] for i in numbers]
    names = [f"_m{i}" for i in numbers]
    return GaussianFits(with_targets(g, chosen, names), names, [1 / len(names)] * len(names), [dis[i - 1] for i in numbers])


def _searched(ref: RefModel, g: Gram, fits: list[Fit], method: str, largest: int, clusters: int, regul: float) -> SearchPath:
    """Clustered draws are searched; the L1 path takes their single mean."""
    if ref.is_datafit:
        found, weights = g, {"_y": 1.0}
    elif not fits:
        # All draws are about one value, so that their distances are those of what they are less it.
        names = [draw_name(i + 1) for i in range(ref.n_draws)]
        labels = draws.kmeans(g.shifted(names, names), 1 if method == "l1" else min(clusters, ref.n_draws))
        own = draws.Clusters(tuple(labels), tuple(ref.weights))
        weights = dict(zip([f"_c{k}" for k in range(own.n)], own.shares(), strict=True))
        found = combined(g, {c: dict(zip(names, own.within(k), strict=True)) for k, c in enumerate(weights)})
    else:
        names = [INTERCEPT, *g.names[1:-1]]
        beta = np.array([[f.intercept, *[f.beta.get(c, 0.0) for c in names[1:]]] for f in fits])
        labels = draws.kmeans(beta @ g.part(names, names) @ beta.T, 1 if method == "l1" else min(clusters, len(fits)))
        own = draws.Clusters(tuple(labels), tuple(ref.weights[: len(fits)] or [1 / len(fits)] * len(fits)))
        centers = [averaged(fits, own.within(k)) for k in range(own.n)]
        weights = dict(zip([f"_c{k}" for k in range(own.n)], own.shares(), strict=True))
        found = with_targets(g, centers, list(weights))
    target = next(iter(weights))
    if method == "l1":
        return search.l1(found, ref.terms, target, largest)
    return search.forward(found, ref.terms, target, largest, regul, weights)


def _projected(ref: RefModel, held: GaussianFits, path: SearchPath, regul: float) -> dict[int, tuple[list[Fit], list[float], list[float]]]:
    """Each draw projected onto every size, with its projected dispersion."""
    out = {}
    for k, size in enumerate(path.sizes):
        terms = [t for step in path.ranking[:k] for t in fm.split_top(step)]
        cols = [c for t in terms for c in ref.terms[t]]
        fits = [solve.ridge(held.g, cols, t, regul) for t in held.targets]
        dis = [solve.dispersion(held.g, f, t, d * d) for f, t, d in zip(fits, held.targets, held.dis, strict=True)]
        out[size] = (fits, held.weights, dis)
    return out


def _reference(ref: RefModel, data: DataFrame, weights: list[float], dis: list[float], fits: list[Fit] | None = None) -> DataFrame:
    """The reference model's own rows: by its coefficients if it has any, else by its draws."""
    fits = list(ref.fits) if fits is None else fits
    if fits:
        return evaluate.pointwise(data, ref.columns, {0: (fits, weights, dis)}, ref.family).withColumn("size", F.lit(None).cast("int"))
    rows = evaluate.summarize(data, "mu", ref.family, weights, dis) if not ref.is_datafit else data.select("obs_id", "y", "wobs", F.lit(None).cast("double").alias("mu"), F.lit(None).cast("double").alias("lppd"))
    return rows.select("obs_id", "y", "wobs", F.lit(None).cast("int").alias("size"), "mu", "lppd")


def _target():
    return F.col("y") - F.col("offs")


def varsel(ref: RefModel, method: str = "forward", largest: int = LARGEST, clusters: int = CLUSTERS, prediction_draws: int = PREDICTION_DRAWS, regul: float = solve.REGUL, test: DataFrame | None = None, path: SearchPath | None = None) -> Selection:
    """Search on all data and evaluate every size on it, or on test rows with y, wobs and offs.

    A ``path`` from an earlier search is evaluated as it is; method, largest and clusters then count
    for nothing.
    """
    options.check_search(method, list(ref.terms))
    if ref.family.name != "gaussian":
        return _varsel_newton(ref, method, largest, clusters, prediction_draws, regul, test, path)
    g = _moments(ref)
    path = path or _searched(ref, g, list(ref.fits), method, largest, clusters, regul)
    by_size = _projected(ref, _gaussian(ref, g, list(ref.fits), ref.dis, prediction_draws), path, regul)
    data = ref.data if test is None else ref.on(test).data
    table, sums = _tables(ref, data, by_size, ref.weights, ref.dis)
    return Selection(ref, path, table, {0: path.ranking}, by_size, sums=sums)


def _pointwise(ref: RefModel, data: DataFrame, by_size: dict, weights: list[float], dis: list[float], fits: list[Fit] | None = None, leave_one_out: bool = False) -> DataFrame:
    """The pointwise table of submodels and reference: in one scan if the reference has coefficients."""
    fits = list(ref.fits) if fits is None else fits
    if fits:
        return evaluate.pointwise(data, ref.columns, by_size, ref.family, leave_one_out, (fits, weights, dis))
    return evaluate.pointwise(data, ref.columns, by_size, ref.family, leave_one_out).unionByName(_reference(ref, data, weights, dis, fits))


def _tables(ref: RefModel, data: DataFrame, by_size: dict, weights: list[float], dis: list[float], leave_one_out: bool = False) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The pointwise table, kept from its first use on, and with it the sums by task if the reference has coefficients."""
    table = _pointwise(ref, data, by_size, weights, dis, leave_one_out=leave_one_out).persist()
    return table, (table, _sums(ref, data, by_size, weights, dis, list(ref.fits), leave_one_out)) if ref.fits else None


def _sums(ref: RefModel, data: DataFrame, by_size: dict, weights: list[float], dis: list[float], fits: list[Fit], leave_one_out: bool = False) -> DataFrame:
    return evaluate.pointwise_sums(data, ref.columns, by_size, ref.family, leave_one_out, (fits, weights, dis))


def _without_dispersion(ref: RefModel) -> None:
    """The families that Newton passes serve; the others have no cross-entropy to project by."""
    if ref.family.name not in ("binomial", "poisson"):
        raise ValueError(f"no projection for the family {ref.family.name}; a latent projection can serve it")


def _clustered(ref: RefModel, wanted: int) -> draws.Clusters:
    """k-means of all draws on the link scale."""
    if ref.n_draws <= wanted:
        return draws.Clusters(tuple(range(ref.n_draws)), tuple(ref.weights))
    link, low, top = ref.family.link, -np.inf if ref.family.name == "gaussian" else EPS, 1 - EPS if ref.family.name == "binomial" else np.inf
    labels = draws.kmeans(draws.draw_gram(ref.data, "mu", ref.n_draws, lambda mu: link.np_link(np.clip(mu, low, top))), wanted)
    return draws.Clusters(tuple(labels), tuple(ref.weights))


def _projected_newton(ref: RefModel, path: SearchPath, prediction_draws: int, regul: float) -> dict[int, tuple[list[Fit], list[float], list[float]]]:
    """Up to ``prediction_draws`` draws projected onto every size, all in the same Newton passes."""
    numbers = draws.thinned(ref.n_draws, prediction_draws)
    n, own = len(numbers), [ref.weights[i - 1] for i in numbers]
    cols = [tuple(c for step in path.ranking[:k] for t in fm.split_top(step) for c in ref.terms[t]) for k in range(len(path.sizes))]
    jobs = [irls.Job(c, k) for c in cols for k in range(n)]
    fits = irls.project(ref.data, ref.columns, draws.picked(F.col("mu"), numbers), ref.family, jobs, F.col("wobs"), F.col("offs"), regul)
    return {size: (fits[i * n : (i + 1) * n], [w / sum(own) for w in own], [1.0] * n) for i, size in enumerate(path.sizes)}


def _varsel_newton(ref: RefModel, method: str, largest: int, clusters: int, prediction_draws: int, regul: float, test: DataFrame | None, path: SearchPath | None = None) -> Selection:
    """Search on clustered draws and projections of single draws for other families."""
    _without_dispersion(ref)
    path = path or _searched_newton(ref, method, largest, clusters, regul)
    return _evaluated_newton(ref, path, prediction_draws, regul, test)


def _evaluated_newton(ref: RefModel, path: SearchPath, prediction_draws: int, regul: float, test: DataFrame | None) -> Selection:
    by_size = _projected_newton(ref, path, prediction_draws, regul)
    data = ref.data if test is None else ref.on(test).data
    table, sums = _tables(ref, data, by_size, ref.weights, ref.dis)
    return Selection(ref, path, table, {0: path.ranking}, by_size, sums=sums)


def _searched_newton(ref: RefModel, method: str, largest: int, clusters: int, regul: float) -> SearchPath:
    """Forward search on the means of clusters: one set of Newton passes for each size scores all candidates; the L1 path takes the mean of all draws."""
    if method == "l1":
        mean = F.get(draws.aggregated(F.col("mu"), draws.Clusters((0,) * ref.n_draws, tuple(ref.weights))), F.lit(0))
        return search.l1_newton(ref.data, ref.columns, ref.terms, mean, ref.family, F.col("wobs"), F.col("offs"), largest)
    own = _clustered(ref, clusters)
    targets, share = draws.aggregated(F.col("mu"), own), own.shares()
    n, chosen, ranking, sizes, scores, firsts = own.n, [], [], [], [], []
    for size in range(1, min(largest, len(ref.terms)) + 2):
        options = [[]] if size == 1 else fm.candidates(chosen, list(ref.terms), size)
        if not options:
            continue
        cols = [tuple(c for t in [*chosen, *new] for c in ref.terms[t]) for new in options]
        jobs = [irls.Job(c, k) for c in cols for k in range(n)]
        fits = irls.project(ref.data, ref.columns, targets, ref.family, jobs, F.col("wobs"), F.col("offs"), regul)
        groups = [fits[i * n : (i + 1) * n] for i in range(len(options))]
        ces = []
        for group in groups:
            mus = evaluate.means(evaluate.predictors(group, ref.columns, F.col("offs")), ref.family)
            ce = F.zip_with(targets, mus, ref.family.cross_entropy)
            ces.append(F.sum(F.col("wobs") * F.aggregate(F.zip_with(ce, doubles(share), lambda a, w: a * w), F.lit(0.0), lambda a, x: a + x)) / F.sum("wobs"))
        row = ref.data.agg(*[c.alias(f"c{i}") for i, c in enumerate(ces)]).first()
        best = min((row[f"c{i}"], i) for i in range(len(options)) if row[f"c{i}"] is not None)[1]
        chosen = [*chosen, *options[best]]
        if size > 1:
            ranking.append(" + ".join(options[best]))
        sizes.append(size - 1)
        scores.append(row[f"c{best}"])
        firsts.append(groups[best][0])
    return SearchPath(ranking, sizes, firsts, scores)


def cv_kfold(ref: RefModel, key: str = "obs_id", k: int = 5, method: str = "forward", largest: int = LARGEST, clusters: int = CLUSTERS, prediction_draws: int = 50, regul: float = solve.REGUL, seed: int = 0, validate_search: bool = True, folded: DataFrame | None = None, refits: DataFrame | None = None, refit_dis: dict[int, list[float]] | None = None) -> Selection:
    """K-fold cross-validation of search and projection: fold moments from one scan, complements by subtraction.

    The reference model is refitted on every complement, and evaluated like the submodels on the rows
    that were left out. A model of a user's draws is refitted by the user: ``refits`` (fold, obs_id,
    mu) has, for every fold, the draws of the model fitted without it, at all observations;
    ``refit_dis`` their dispersions by fold. ``folded`` are the observations with their fold, from 1.
    """
    options.check_search(method, list(ref.terms))
    if refits is None and not ref.fits and not ref.is_datafit:
        raise ValueError("draws can't be refitted without a fold: give refits")
    if refits is not None and folded is None:
        raise ValueError("refits need the folds that they leave out")
    options.check_folds("kfold", k, ref.data.limit(max(k, 1)).count(), ref.is_datafit, validate_search, True)
    data = folded if folded is not None else crossval.balanced_folds(ref.data, key, k, seed)
    if refits is not None:
        return _cv_kfold_refits(ref, data, k, refits, refit_dis or {}, method, largest, clusters, prediction_draws, regul, validate_search)
    if ref.family.name != "gaussian":
        return _cv_kfold_newton(ref, data, k, method, largest, clusters, prediction_draws, regul, seed, validate_search)
    by_fold = grams(data, {**ref.columns, "_y": _target()}, F.col("wobs"), F.col("fold"))
    full = functools.reduce(lambda a, b: a + b, by_fold.values())
    path = _searched(ref, full, list(ref.fits), method, largest, clusters, regul)
    rankings, parts, sums = {0: path.ranking}, [], []
    for fold, g in sorted(crossval.complements(by_fold).items()):
        fits, dis = ([], []) if ref.is_datafit else posterior(g, list(ref.columns), "_y", max(prediction_draws, 1), seed + fold)
        weights = [1 / max(len(fits), 1)] * max(len(fits), 1)
        own = path if not validate_search else _searched(ref, g, fits, method, largest, clusters, regul)
        rankings[fold] = own.ranking
        rows = data.filter(F.col("fold") == fold)
        by_size = _projected(ref, _gaussian(ref, g, fits, dis, prediction_draws), own, regul)
        parts.append(_pointwise(ref, rows, by_size, weights, dis or [0.0], fits))
        if fits:
            sums.append(_sums(ref, rows, by_size, weights, dis, fits))
    table = functools.reduce(DataFrame.unionByName, parts).persist()
    return Selection(ref, path, table, rankings, sums=(table, functools.reduce(DataFrame.union, sums)) if sums else None)


def _cv_kfold_refits(ref: RefModel, data: DataFrame, k: int, refits: DataFrame, refit_dis: dict[int, list[float]], method: str, largest: int, clusters: int, prediction_draws: int, regul: float, validate_search: bool) -> Selection:
    """A user's refits: Gaussian ones from moments of each refit's training rows, all in one pass; others fold by fold."""
    full = varsel(ref, method, largest, clusters, prediction_draws, regul)
    rows = data.drop("mu").join(refits.select(F.col("fold").alias("refit"), "obs_id", "mu"), "obs_id")
    one = rows.select(F.size("mu").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if one.a != one.b or one.a is None or ref.family.has_dispersion and any(len(refit_dis.get(f, [])) != one.a for f in range(1, k + 1)):
        raise ValueError("every refit needs the same number of draws for every observation, and every draw its dispersion")
    weights, rankings, parts = [1 / one.a] * one.a, {0: full.path.ranking}, []
    gaussian = ref.family.name == "gaussian"
    moments = draw_moments(rows.filter(F.col("fold") != F.col("refit")), {**ref.columns, "_y": _target()}, _less_offsets(), one.a, F.col("wobs"), F.col("refit")) if gaussian else {}
    for fold in range(1, k + 1):
        own = replace(ref, data=rows.filter((F.col("refit") == fold) & (F.col("fold") != fold)).drop("refit"), dis=refit_dis.get(fold, [1.0] * one.a), weights=weights, fits=(), predict=None)
        test = rows.filter((F.col("refit") == fold) & (F.col("fold") == fold)).drop("refit")
        if gaussian:
            path = _searched(own, moments[fold], [], method, largest, clusters, regul) if validate_search else full.path
            by_size = _projected(own, _gaussian(own, moments[fold], [], own.dis, prediction_draws), path, regul)
        else:
            path = _searched_newton(own, method, largest, clusters, regul) if validate_search else full.path
            by_size = _projected_newton(own, path, prediction_draws, regul)
        rankings[fold] = path.ranking
        parts.append(_pointwise(own, test, by_size, weights, own.dis))
    return Selection(ref, full.path, functools.reduce(DataFrame.unionByName, parts).persist(), rankings, full.by_size)


def _with_means(ref: RefModel, rows: DataFrame) -> DataFrame:
    """The reference draws' means at rows that carry the predictors, by their coefficients."""
    return rows.withColumn("mu", evaluate.means(evaluate.predictors(list(ref.fits), ref.columns, F.col("offs")), ref.family))


def _cv_kfold_newton(ref: RefModel, data: DataFrame, k: int, method: str, largest: int, clusters: int, prediction_draws: int, regul: float, seed: int, validate_search: bool) -> Selection:
    """Other families: the reference model, search and projections again on each fold's training rows.

    Rows and folds are written once to the shared folder: every fold's many passes read them there, not their sources.
    """
    plain = cut(data.drop("mu"))
    full = varsel(replace(ref, data=_with_means(ref, plain)) if ref.fits else ref, method, largest, clusters, prediction_draws, regul)
    rankings, parts, sums = {0: full.path.ranking}, [], []
    for fold in range(1, k + 1):
        train, test = plain.filter(F.col("fold") != fold), plain.filter(F.col("fold") == fold)
        own = glm_laplace(train, ref.family, ref.columns, ref.terms, ref.n_draws, seed + fold)
        part = varsel(own, method, largest, clusters, prediction_draws, regul, test) if validate_search else _evaluated_newton(own, full.path, prediction_draws, regul, test)
        rankings[fold] = part.path.ranking
        parts.append(part.pointwise)
        sums += [part.sums[1]] if part.sums else []
    table = functools.reduce(DataFrame.unionByName, parts).persist()
    return Selection(ref, full.path, table, rankings, full.by_size, sums=(table, functools.reduce(DataFrame.union, sums)) if len(sums) == k else None)


def cv_loo(ref: RefModel, method: str = "forward", largest: int = LARGEST, clusters: int = CLUSTERS, prediction_draws: int = 100, regul: float = solve.REGUL, validate_search: bool | str = False, seed: int = 0, path: SearchPath | None = None, warn_shape: bool = True) -> Selection:
    """Leave-one-out: smoothed importance weights of reference and projected draws on the full-data path.

    With ``validate_search`` the submodels come from a search repeated without each observation;
    without, the elpd by size ignores that the search has seen the observation. ``"weights"`` repeats
    the search without any refit: the reference draws' clusters are weighted anew for each observation by
    its importance weights, which works for all Gaussian reference models; ``True`` also refits a
    conjugate one. ``path`` is an earlier search on all data, used again. Unreliable importance
    weights are warned of, from the pass that also sums up what statistics need, unless ``warn_shape`` is false.
    """
    options.check_search(method, list(ref.terms))
    options.check_folds("loo", 0, 0, ref.is_datafit, bool(validate_search), True)
    if validate_search not in (True, False, "weights"):
        raise ValueError(f"unknown way to validate the search: {validate_search}")
    if validate_search == "weights":
        return _loo_weights(ref, method, largest, clusters, prediction_draws, regul, path, warn_shape)
    if validate_search:
        _repeatable(ref)
    chosen = varsel(ref, method, largest, clusters, prediction_draws, regul, path=path)
    if ref.fits and not validate_search:
        table, sums = _tables(ref, ref.data, chosen.by_size, ref.weights, ref.dis, leave_one_out=True)
        out = Selection(ref, chosen.path, table, {0: chosen.path.ranking}, chosen.by_size, sums=sums)
        if warn_shape:
            loo.warn_poor(*next(((r["poor"], r["n"]) for r in out.merged if r["size"] is None), (0, 0)), ref.n_draws)
        return out
    if warn_shape:
        loo.poor_shapes(_shapes(ref), "khat", ref.n_draws)
    if validate_search:
        table = _loo_searches(ref, ref.data, method, largest, clusters, prediction_draws, regul, seed)
    else:
        table = evaluate.pointwise(ref.data, ref.columns, chosen.by_size, ref.family, leave_one_out=True)
    if ref.fits:
        own = evaluate.pointwise(ref.data, ref.columns, {0: (list(ref.fits), ref.weights, ref.dis)}, ref.family, leave_one_out=True).withColumn("size", F.lit(None).cast("int"))
    else:
        own = _loo_rows(ref.data.withColumn("draws", F.col("mu")), ref, ref.dis, None)
    return Selection(ref, chosen.path, table.unionByName(own).persist(), {0: chosen.path.ranking}, chosen.by_size)


def _repeatable(ref: RefModel) -> None:
    """Only a conjugate Gaussian model follows from moments without a row."""
    if ref.family.name != "gaussian" or not ref.fits:
        raise ValueError("searches without each observation need a Gaussian reference model with coefficients")


def _loo_searches(ref: RefModel, rows: DataFrame, method: str, largest: int, clusters: int, prediction_draws: int, regul: float, seed: int) -> DataFrame:
    """The pointwise table of reference fit, search and projection repeated without each of ``rows``.

    The moments of all data go to tasks over the rows; each takes its row off them, and all else
    follows from the small matrix that is left.
    """
    g = gram(ref.data, {**ref.columns, "_y": _target()}, F.col("wobs"))
    names, n_draws, plain = list(ref.columns), ref.n_draws, replace(ref, data=None, columns={}, fits=(), known=None)
    at = g.offsets(list(g.names))

    def without(z: np.ndarray, w: float) -> tuple[Gram, list[Fit], list[float]]:
        left = Gram((INTERCEPT, *names, "_y"), g.matrix - w * np.outer(z - at, z - at), g.rows - 1, g.shift)
        return left, *posterior(left, names, "_y", n_draws, seed + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y, w, o, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            design, out = np.column_stack([np.ones(len(y)), *x, y - o]), []
            for i, z in enumerate(design):
                left, fits, dis = without(z, w[i])
                path = _searched(plain, left, fits, method, largest, clusters, regul)
                for size, (sub, weights, sub_dis) in _projected(plain, _gaussian(plain, left, fits, dis, prediction_draws), path, regul).items():
                    x_of = dict(zip(names, z[1:-1], strict=True))
                    mu = plain.family.link.np_inverse(np.array([f.intercept + sum(b * x_of[c] for c, b in f.beta.items()) for f in sub]) + o[i])
                    ll = plain.family.np_log_lik(y[i], mu, w[i], np.array(sub_dis)) + np.log(weights)
                    out.append((ids[i], y[i], w[i], size, float(mu @ np.array(weights)), float(ll.max() + np.log(np.exp(ll - ll.max()).sum()))))
            if out:
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["obs_id", "y", "wobs", "size", "mu", "lppd"])

    cells = rows.select(F.col("obs_id").cast("bigint"), *[F.col(c).cast("double") for c in ("y", "wobs", "offs")], *[c.cast("double").alias(f"_z{i}") for i, c in enumerate(ref.columns.values())])
    return cells.repartition(F.col("obs_id")).mapInArrow(run, "obs_id bigint, y double, wobs double, size int, mu double, lppd double")


def _shapes(ref: RefModel) -> DataFrame:
    """The Pareto shape of each observation's importance weights under the reference model."""
    family, dis, n_draws = ref.family, np.array(ref.dis), ref.n_draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, w = (batch.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (0, 1))
                mu = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(y), n_draws)
                yield pa.RecordBatch.from_arrays([pa.array(loo.smoothed(-family.np_log_lik(y, mu, w, dis))[1])], ["khat"])

    return ref.data.select(F.col("y").cast("double"), F.col("wobs").cast("double"), F.col("mu").cast("array<double>")).mapInArrow(run, "khat double")


def _loo_weights(ref: RefModel, method: str, largest: int, clusters: int, prediction_draws: int, regul: float, path: SearchPath | None, warn_shape: bool) -> Selection:
    """Leave-one-out searches from the moments of all draws: an observation only changes the draws' weights.

    The moments, as large as draws and predictors squared, go to tasks over the rows. There every row
    weighs the draws by its smoothed importance, which moves each cluster's center and share, searches,
    projects single draws onto every size, and is predicted by them under the same weights.
    """
    if ref.family.name != "gaussian":
        raise ValueError("searches from re-weighted moments need a Gaussian reference model")
    g = _moments(ref)
    names = [draw_name(i + 1) for i in range(ref.n_draws)]
    if ref.fits:
        g = with_targets(g, list(ref.fits), names)
    chosen = varsel(ref, method, largest, clusters, prediction_draws, regul, path=path)
    labels = tuple(draws.kmeans(g.centered(names, names), 1 if method == "l1" else min(clusters, ref.n_draws)))
    columns, terms, family, dis = list(ref.columns), ref.terms, ref.family, np.array(ref.dis)
    numbers = draws.thinned(ref.n_draws, prediction_draws)
    picked = [i - 1 for i in numbers]

    def searched(weights: np.ndarray) -> SearchPath:
        own = draws.Clusters(labels, (1.0,) * len(labels)).reweighted(np.maximum(weights, 1e-300))
        shares = dict(zip([f"_c{k}" for k in range(own.n)], own.shares(), strict=True))
        found = combined(g, {c: dict(zip(names, own.within(k), strict=True)) for k, c in enumerate(shares)})
        target = next(iter(shares))
        return search.l1(found, terms, target, largest) if method == "l1" else search.forward(found, terms, target, largest, regul, shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}  # projections of single draws don't depend on the observation
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, y, w, o, *x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1))
            mu = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(dis))
            lw, khat = loo.smoothed(-family.np_log_lik(y[:, None], mu, w[:, None], dis))
            out = []
            for i in range(len(y)):
                weights = np.exp(lw[i])
                found = searched(weights)
                own = np.log(np.maximum(weights[picked], 1e-300) / np.maximum(weights[picked], 1e-300).sum())
                at = dict(zip(columns, (float(c[i]) for c in x), strict=True))
                for k, size in enumerate(found.sizes):
                    cols = tuple(c for step in found.ranking[:k] for t in fm.split_top(step) for c in terms[t])
                    if cols not in known:
                        fits = [solve.ridge(g, list(cols), names[d], regul) for d in picked]
                        known[cols] = np.array([[f.intercept, *[f.beta[c] for c in cols]] for f in fits]), np.array([solve.dispersion(g, f, names[d], dis[d] ** 2) for f, d in zip(fits, picked, strict=True)])
                    beta, sub_dis = known[cols]
                    q = beta @ np.array([1.0, *[at[c] for c in cols]]) + o[i]
                    ll = family.np_log_lik(y[i], q, w[i], sub_dis) + own
                    out.append((ids[i], y[i], w[i], size, float(q @ np.exp(own)), float(ll.max() + np.log(np.exp(ll - ll.max()).sum())), None, None))
                ll = family.np_log_lik(y[i], mu[i], w[i], dis) + lw[i]
                out.append((ids[i], y[i], w[i], None, float(mu[i] @ weights), float(ll.max() + np.log(np.exp(ll - ll.max()).sum())), float(khat[i]), found.ranking))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["obs_id", "y", "wobs", "size", "mu", "lppd", "khat", "ranking"])

    cells = ref.data.select(F.col("obs_id").cast("bigint"), *[F.col(c).cast("double") for c in ("y", "wobs", "offs")], *[c.cast("double").alias(f"_z{i}") for i, c in enumerate(ref.columns.values())], F.col("mu").cast("array<double>").alias("_mu"))
    table = cut(cells.mapInArrow(run, "obs_id bigint, y double, wobs double, size int, mu double, lppd double, khat double, ranking array<string>"))
    if warn_shape:
        loo.poor_shapes(table.filter("size IS NULL"), "khat", ref.n_draws)
    rankings = table.filter("size IS NULL").select(F.col("obs_id").alias("fold"), F.posexplode("ranking").alias("position", "term")).select("fold", (F.col("position") + 1).alias("position"), "term")
    return Selection(ref, chosen.path, table.drop("khat", "ranking").persist(), {0: chosen.path.ranking}, chosen.by_size, rankings)


def _loo_rows(rows: DataFrame, ref: RefModel, dis: list[float], size: int | None) -> DataFrame:
    with_lik = rows.withColumn("ll", evaluate.densities(F.col("draws"), ref.family, dis))
    raw = loo.psis_weights(F.col("ll"))["lw"] if loo.tail_length(len(dis)) >= 5 else loo.sis_weights(F.col("ll"))
    out = loo.loo_summaries(with_lik.withColumn("lw", raw), "ll", "draws", "lw")
    return out.select("obs_id", "y", "wobs", F.lit(size).cast("int").alias("size"), F.col("loo_mu").alias("mu"), F.col("loo_lppd").alias("lppd"))


@dataclass(frozen=True)
class Projection:
    """Projected draws on chosen terms."""

    ref: RefModel
    terms: list[str]
    fits: list[Fit]
    dis: list[float]
    weights: list[float]

    def linpred(self, data: DataFrame, transform: bool = False, integrated: bool = False) -> DataFrame:
        """Adds ``pred``: predictors over draws, or their means; integrated, one number."""
        eta = evaluate.predictors(self.fits, self.ref.columns, F.col("offs"))
        pred = evaluate.means(eta, self.ref.family) if transform else eta
        if integrated:
            pred = F.aggregate(F.zip_with(pred, doubles(self.weights), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
        return data.withColumn("pred", pred)

    def lpd(self, data: DataFrame) -> DataFrame:
        """(obs_id, lpd): the log predictive density of each row's y, draws integrated out by their weights."""
        rows = evaluate.pointwise(data, self.ref.columns, {0: (self.fits, self.weights, self.dis)}, self.ref.family)
        return rows.select("obs_id", F.col("lppd").alias("lpd"))

    def predict(self, data: DataFrame, n: int = 100, seed: int = 1) -> DataFrame:
        """Adds samples from the predictive distribution. Binomial weights are trials; others count for nothing, with a warning."""
        if self.ref.family.name != "binomial" and not data.filter("wobs <> 1").isEmpty():
            warnings.warn("observation weights take no part in predictive samples", stacklevel=2)
        mus = data.withColumn("_mus", evaluate.means(evaluate.predictors(self.fits, self.ref.columns, F.col("offs")), self.ref.family))
        return evaluate.sampled(mus, "_mus", self.ref.family, n, seed, self.dis, self.weights).drop("_mus")

    def coefficients(self) -> DataFrame:
        rows = [(i, n, v, w) for i, (f, w) in enumerate(zip(self.fits, self.weights, strict=True)) for n, v in f.table()]
        return self.ref.data.sparkSession.createDataFrame(rows, "draw int, term string, value double, weight double")


def _center_targets(ref: RefModel, g: Gram, wanted: int) -> tuple[Gram, list[str], list[float], list[float]]:
    """Clusters' mean fits as targets of moments, their shares, and the mean predictive variance within each."""
    names = [draw_name(i + 1) for i in range(ref.n_draws)]
    if ref.fits:
        g = with_targets(g, list(ref.fits), names)
    inner = g.centered(names, names)
    own = draws.Clusters(tuple(draws.kmeans(inner, wanted)), tuple(ref.weights))
    targets = [f"_c{k}" for k in range(own.n)]
    within = np.array([own.within(k) for k in range(own.n)])
    level = g.mean(names)
    spread = within @ (np.diag(inner) / g.weight + level**2) - np.einsum("ks,st,kt->k", within, inner / g.weight + np.outer(level, level), within)
    variances = within @ np.array(ref.dis) ** 2 + np.maximum(spread, 0.0)
    return combined(g, {c: dict(zip(names, w.tolist(), strict=True)) for c, w in zip(targets, within, strict=True)}), targets, own.shares(), variances.tolist()


def project(ref: RefModel, terms: list[str], n_draws: int = PREDICTION_DRAWS, regul: float = solve.REGUL, clusters: int | None = None) -> Projection:
    """Draws of the reference model, or the means of so many clusters of them, projected onto the given terms; unknown terms are an error."""
    if unknown := [t for t in terms if t not in ref.terms]:
        raise ValueError(f"unknown terms {unknown}")
    cols = [c for t in terms for c in ref.terms[t]]
    if ref.family.name == "gaussian":
        g = _moments(ref)
        kind, n = draws.reduction(ref.n_draws, n_draws, clusters)
        if kind == "clusters" and not ref.is_datafit:
            found, targets, shares, variances = _center_targets(ref, g, n)
            fits = [solve.ridge(found, cols, t, regul) for t in targets]
            return Projection(ref, terms, fits, [solve.dispersion(found, f, t, v) for f, t, v in zip(fits, targets, variances, strict=True)], shares)
        held = _gaussian(ref, g, list(ref.fits), ref.dis, n)
        fits = [solve.ridge(held.g, cols, t, regul) for t in held.targets]
        dis = [solve.dispersion(held.g, f, t, d * d) for f, t, d in zip(fits, held.targets, held.dis, strict=True)]
        return Projection(ref, terms, fits, dis, held.weights)
    _without_dispersion(ref)
    kind, n = draws.reduction(ref.n_draws, n_draws, clusters)
    if kind == "clusters":
        own = _clustered(ref, n)
        fits = irls.project(ref.data, ref.columns, draws.aggregated(F.col("mu"), own), ref.family, [irls.Job(tuple(cols), k) for k in range(own.n)], F.col("wobs"), F.col("offs"), regul)
        return Projection(ref, terms, fits, [1.0] * len(fits), own.shares())
    numbers = draws.thinned(ref.n_draws, n)
    fits = irls.project(ref.data, ref.columns, draws.picked(F.col("mu"), numbers), ref.family, [irls.Job(tuple(cols), k) for k in range(len(numbers))], F.col("wobs"), F.col("offs"), regul)
    return Projection(ref, terms, fits, [1.0] * len(fits), [1 / len(fits)] * len(fits))


def predict(ref: RefModel, data: DataFrame, kind: str = "response") -> DataFrame:
    """Predictions of the reference model for rows with y, wobs and offs: ``response`` or ``link`` means, or ``lpd``."""
    if not ref.fits:
        return _predict_draws(ref.on(data), kind)
    rows = evaluate.pointwise(data, ref.columns, {0: (list(ref.fits), ref.weights, ref.dis)}, ref.family)
    if kind == "response":
        return rows.select("obs_id", F.col("mu").alias("pred"))
    if kind == "lpd":
        return rows.select("obs_id", F.col("lppd").alias("pred"))
    if kind == "link":
        return data.select("obs_id", irls.predictor(averaged(list(ref.fits), ref.weights), ref.columns).alias("eta"), "offs").select("obs_id", (F.col("eta") + F.col("offs")).alias("pred"))
    raise ValueError(f"unknown kind of prediction {kind}")


def _predict_draws(ref: RefModel, kind: str) -> DataFrame:
    """``predict`` from the draws of the model's own rows."""
    if kind == "link":
        eta = F.transform("mu", ref.family.link.link)
        return ref.data.select("obs_id", F.aggregate(F.zip_with(eta, doubles(ref.weights), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x).alias("pred"))
    if kind not in ("response", "lpd"):
        raise ValueError(f"unknown kind of prediction {kind}")
    return evaluate.summarize(ref.data, "mu", ref.family, ref.weights, ref.dis).select("obs_id", F.col({"response": "mu", "lpd": "lppd"}[kind]).alias("pred"))


def _loo_subsample(ref: RefModel, n: int, key: str, seed: int, method: str, largest: int, clusters: int, prediction_draws: int, regul: float) -> DataFrame:
    """Fast leave-one-out of all observations (mu_fast, lppd_fast), the repeated search's mu and lppd of the ``sampled`` ones, and the reference's."""
    _repeatable(ref)
    fast = cv_loo(ref, method, largest, clusters, prediction_draws, regul).pointwise
    picked = loo.subsample(ref.data, key, n, seed)
    exact = _loo_searches(ref, picked, method, largest, clusters, prediction_draws, regul, seed).select("obs_id", "size", "mu", "lppd", F.lit(True).alias("sampled"))
    sub = fast.filter(F.col("size").isNotNull()).withColumnsRenamed({"mu": "mu_fast", "lppd": "lppd_fast"})
    if "mu_ref" not in sub.columns:
        own = fast.filter(F.col("size").isNull()).select("obs_id", F.col("mu").alias("mu_ref"), F.col("lppd").alias("lppd_ref"))
        sub = sub.join(own, "obs_id")
    return sub.join(exact, ["obs_id", "size"], "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))


def cv_loo_subsampled(ref: RefModel, n: int, key: str = "obs_id", seed: int = 0, method: str = "forward", largest: int = LARGEST, clusters: int = CLUSTERS, prediction_draws: int = 100, regul: float = solve.REGUL) -> DataFrame:
    """(size, y_hat, v_y_hat, hat_v_y): elpd of searches repeated without each of n sampled observations.

    The fast leave-one-out of the full-data search is the approximation for every observation; for the
    sampled ones, any number up to all, the search itself runs on moments without the observation, in
    tasks, and the difference estimator joins both.
    """
    rows = _loo_subsample(ref, n, key, seed, method, largest, clusters, prediction_draws, regul).select("size", "lppd_fast", "lppd", "sampled")
    return stats.difference_estimate(cut(rows), "lppd_fast", "lppd", "sampled", by=("size",))


def cv_loo_subsampled_summary(ref: RefModel, n: int, names: list[str] | None = None, delta: bool = False, alpha: float = stats.ALPHA, key: str = "obs_id", seed: int = 0, method: str = "forward", largest: int = LARGEST, clusters: int = CLUSTERS, prediction_draws: int = 100, regul: float = solve.REGUL) -> DataFrame:
    """(size, statistic, value, se, lq, uq) of the same subsampled searches; with ``delta``, differences to the reference model."""
    rows = _loo_subsample(ref, n, key, seed, method, largest, clusters, prediction_draws, regul)
    return stats.subsampled_statistics(cut(rows), names, delta, alpha)
