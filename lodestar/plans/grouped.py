"""Variable selection with group-level terms: intercepts and slopes by the levels of one grouping factor.

The reference fits, clustered for the search and single for the evaluation, are targets of one
aggregate by group. Every size then fits all candidates to all clusters at once, as mixed models whose
covariances are found in shared passes over the groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import draws, evaluate, groups
from lodestar.operators import formula as fm
from lodestar.operators.groups import INTERCEPT, GroupFit, GroupMoments, Model
from lodestar.operators.search import SearchPath
from lodestar.operators.solve import Fit
from lodestar.plans import selection
from lodestar.sources.refmodel import RefModel


def grouping_factor(terms: list[str]) -> str:
    """The one grouping factor of the terms; several are an error."""
    found = {fm.group_parts(p)[1] for t in terms for p in fm.split_top(t) if fm.is_group(p)}
    if len(found) != 1:
        raise ValueError(f"group-level terms need one grouping factor, not {sorted(found)}")
    return found.pop()


def model_of(terms: list[str], blocks: dict[str, list[str]], target: int) -> Model:
    """Fixed and group-level columns of some terms; ``blocks`` maps terms to their columns."""
    fixed, own = [INTERCEPT], []
    for t in fm.flatten([p for t in terms for p in fm.split_top(t)]):
        if fm.is_group(t):
            slopes, _, intercept = fm.group_parts(t)
            own += ([INTERCEPT] if intercept else []) + [c for s in slopes for c in blocks[s]]
        else:
            fixed += blocks[t]
    return Model(tuple(dict.fromkeys(fixed)), tuple(dict.fromkeys(own)), target)


def fitted(m: GroupMoments, models: list[Model], factors: dict[tuple[str, ...], np.ndarray] | None = None) -> list[GroupFit]:
    """Fits of models with and without group-level columns; ``factors`` holds known Cholesky factors by those columns."""
    mixed = [i for i, t in enumerate(models) if t.group]
    given = [np.asarray(factors[models[i].group], float) for i in mixed] if factors is not None else None
    out: dict[int, GroupFit] = dict(zip(mixed, groups.fitted(m, [models[i] for i in mixed], given), strict=True)) if mixed else {}
    for i, t in enumerate(models):
        if not t.group:
            at = m.at(list(t.fixed))
            a, b = m.whole[np.ix_(at, at)], m.cross[at, t.target]
            beta = np.linalg.solve(a + 1e-12 * np.diag(np.diag(a)), b)
            rest = max(float(m.squares[t.target] - 2 * beta @ b + beta @ a @ beta), 1e-300)
            left = max(m.rows - len(at), 1)
            out[i] = GroupFit(t, dict(zip(t.fixed, beta.tolist(), strict=True)), float(np.sqrt(rest / left)), np.zeros((0, 0)), float(left * np.log(rest / left) + np.linalg.slogdet(a)[1]), float((beta @ a @ beta - 2 * beta @ b) / m.whole[0, 0]))
    return [out[i] for i in range(len(models))]


def targets_of(ref: RefModel, clusters: int, prediction_draws: int) -> tuple[Column, list[float], list[float], list[float]]:
    """An array of the clusters' mean fits and then of single draws, less offsets; cluster shares, draw weights and dispersions."""
    if ref.is_datafit:
        return F.array(F.col("y") - F.col("offs"), F.col("y") - F.col("offs")), [1.0], [1.0], [0.0]
    own = selection._clustered(ref, clusters)
    numbers = draws.thinned(ref.n_draws, prediction_draws)
    both = F.concat(draws.aggregated(F.col("mu"), own), draws.picked(F.col("mu"), numbers))
    return F.transform(both, lambda v: v - F.col("offs")), own.shares(), [1 / len(numbers)] * len(numbers), [ref.dis[i - 1] for i in numbers]


def varsel(ref: RefModel, blocks: list[str] | None = None, largest: int = selection.LARGEST, clusters: int = 5, prediction_draws: int = 20, test: DataFrame | None = None, factors: dict[tuple[str, ...], np.ndarray] | None = None) -> selection.Selection:
    """Forward search among fixed and group-level terms of a Gaussian model, and the evaluation of every size.

    ``ref.terms`` maps fixed terms to columns; ``blocks`` are what may enter, such as ``x``,
    ``(1 | g)`` or ``x + (x | g)``, by default those of the terms of ``ref``, in which group terms map
    to nothing. ``factors`` gives Cholesky factors of the effects' covariances, relative to the
    residual one, by group-level columns; without it they are estimated.
    """
    if ref.family.name != "gaussian":
        raise ValueError("group-level terms are searched in Gaussian models; a latent projection can serve others")
    fixed = {t: c for t, c in ref.terms.items() if not fm.is_group(t)}
    blocks = blocks or [b for b in fm.split_blocks(fm.Formula((), tuple(fm.flatten(list(ref.terms))))) if b != "1"]
    group = grouping_factor(blocks)
    parts = fm.flatten([p for b in blocks for p in fm.split_top(b)])
    needed = {p for p in parts if not fm.is_group(p)} | {s for p in parts if fm.is_group(p) for s in fm.group_parts(p)[0]}
    if unknown := needed - set(fixed):
        raise ValueError(f"unknown terms {sorted(unknown)}")
    targets, shares, weights, dis = targets_of(ref, clusters, prediction_draws)
    m = groups.group_moments(ref.data, ref.columns, targets, len(shares) + len(weights), group, F.col("wobs"))
    path = _search(m, blocks, fixed, shares, largest, factors)
    by_size, mixed = {}, {}
    for k, size in enumerate(path.sizes):
        terms = path.ranking[:k]
        models = [model_of(terms, fixed, len(shares) + d) for d in range(len(weights))]
        fits = fitted(m, models, factors)
        # The dispersion of a projection: the draw's own, and what its fit leaves of it.
        left = [float(np.sqrt(max(s * s + m.squares[f.model.target] / m.whole[0, 0] + f.score, 0.0))) for f, s in zip(fits, dis, strict=True)]
        by_size[size] = ([Fit(f.beta[INTERCEPT], {c: b for c, b in f.beta.items() if c != INTERCEPT}) for f in fits], weights, left)
        if fits[0].model.group:
            mixed[size] = fits
    data = ref.data if test is None else ref.on(test).data if not ref.is_datafit else test
    rows, shifts = data, {}
    for size, fits in mixed.items():
        shifts[size] = f"_group{size}"
        rows = groups.with_effects(rows, groups.effects(m, fits, group), group, fits, ref.columns, shifts[size])
    table = evaluate.pointwise(rows, ref.columns, by_size, ref.family, shifts=shifts)
    return selection.Selection(ref, path, table.unionByName(selection._reference(ref, data, ref.weights, ref.dis)).persist(), {0: path.ranking}, by_size)


def _search(m: GroupMoments, blocks: list[str], fixed: dict[str, list[str]], shares: list[float], largest: int, factors: dict | None) -> SearchPath:
    chosen, ranking, sizes, fits, scores = [], [], [], [], []
    most = max(fm.size([*blocks]), 1)
    for size in range(1, min(largest + 1, most) + 1):
        options = [[]] if size == 1 else fm.candidates(chosen, blocks, size)
        if not options:
            continue
        found = fitted(m, [model_of([*chosen, *new], fixed, c) for new in options for c in range(len(shares))], factors)
        by_option = [found[i * len(shares) : (i + 1) * len(shares)] for i in range(len(options))]
        values = [sum(w * f.score for w, f in zip(shares, part, strict=True)) for part in by_option]
        best = min(range(len(options)), key=lambda i: (values[i], i))
        chosen = fm.flatten([*chosen, *options[best]])
        if size > 1:
            ranking.append(" + ".join(options[best]))
        sizes.append(size - 1)
        first = by_option[best][0]
        fits.append(Fit(first.beta[INTERCEPT], {c: b for c, b in first.beta.items() if c != INTERCEPT}))
        scores.append(values[best])
    return SearchPath(ranking, sizes, fits, scores)
