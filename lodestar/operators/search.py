"""Searches for predictor rankings: forward by projected cross-entropy, and along the L1 path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.families import Family
from lodestar.operators import formula as fm
from lodestar.operators import irls, solve
from lodestar.operators.gram import Gram, gram
from lodestar.operators.solve import Fit


@dataclass(frozen=True)
class SearchPath:
    """Terms in the order they were chosen, and for each size the chosen terms, fit and score."""

    ranking: list[str]
    sizes: list[int]
    fits: list[Fit]
    scores: list[float]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, t, s) for n, t, s in zip(self.sizes, ["(Intercept)", *self.ranking], self.scores, strict=True)]
        return spark.createDataFrame(rows, "size int, term string, ce double")


def forward(g: Gram, blocks: dict[str, list[str]], target: str, largest: int | None = None, regul: float = solve.REGUL, weights: dict[str, float] | None = None, candidates: list[str] | None = None) -> SearchPath:
    """Forward search on one moment matrix: each size takes the candidate of least cross-entropy, the first of equals.

    ``blocks`` maps terms to their columns; ``candidates`` are blocks of terms that may enter together,
    by default each term for itself. Several targets with weights score by their weighted mean. A
    size without candidates is skipped.
    """
    targets = weights or {target: 1.0}
    chosen: list[str] = []
    candidates = list(blocks) if candidates is None else candidates
    largest = len(blocks) if largest is None else min(largest, len(blocks))
    cols_of = lambda terms: list(dict.fromkeys(c for t in terms for c in blocks[t]))

    def fitted(terms: list[str]) -> tuple[float, Fit]:
        cols, score, first = cols_of(terms), 0.0, None
        for name, w in targets.items():
            fit = solve.ridge(g, cols, name, regul)
            score += w * solve.cross_entropy(g, fit, name)
            first = first or fit
        return score, first

    score, fit = fitted([])
    path = ([], [0], [fit], [score])
    for size in range(2, largest + 2):
        options = fm.candidates(chosen, candidates, size)
        best = None
        for new in options:
            score, fit = fitted([*chosen, *new])
            if score == score and (best is None or score < best[0]):
                best = (score, fit, new)
        if best:
            chosen += best[2]
            path[0].append(" + ".join(best[2]))
            path[1].append(size - 1)
            path[2].append(best[1])
            path[3].append(best[0])
    return SearchPath(*path)


def l1(g: Gram, blocks: dict[str, list[str]], target: str, largest: int | None = None, n_lambda: int = 150, ratio: float = 1e-5, penalty: dict[str, float] | None = None) -> SearchPath:
    """The order in which terms enter the L1 path, lower-order terms before their interactions."""
    cols = [c for group in blocks.values() for c in group]
    term_of = {c: t for t, group in blocks.items() for c in group}
    largest = len(blocks) if largest is None else min(largest, len(blocks))
    lambdas = solve.lambda_grid(g, cols, target, n_lambda, ratio, penalty=penalty)
    path = solve.elastic_net(g, cols, target, lambdas, penalty=penalty, most=len(cols) + 1)
    order = solve.entering_order(path, cols)
    ranking, _ = fm.lower_first(fm.ranked_terms(order, term_of))
    ranking = ranking[:largest]
    ordered = [c for t in ranking for c in blocks[t]] + [c for c in order if term_of[c] not in ranking]
    counts = [sum(len(blocks[t]) for t in ranking[:k]) for k in range(len(ranking) + 1)]
    sized = solve.sized_fits(path, ordered, max(counts))
    fits = [sized[n] for n in counts]
    return SearchPath(ranking, list(range(len(fits))), fits, [solve.cross_entropy(g, f, target) for f in fits])


def l1_newton(df: DataFrame, columns: dict[str, Column], blocks: dict[str, list[str]], target: Column, family: Family, weight: Column, offset: Column, largest: int | None = None, n_lambda: int = 50, ratio: float = 1e-4, tol: float = 1e-5) -> SearchPath:
    """``l1`` for other families than Gaussian: at every penalty, quadratic approximations until the fit settles.

    An approximation is one scan for weighted moments about the last fit; the coordinate descent on
    them needs no data. Penalties act on predictors standardized by the observations' own weights.
    The path ends once as many terms as wanted have entered.
    """
    cols = [c for group in blocks.values() for c in group]
    term_of = {c: t for t, group in blocks.items() for c in group}
    largest = len(blocks) if largest is None else min(largest, len(blocks))
    # The rows that every approximation reads are kept until the path is done.
    kept = df.select(weight.cast("double").alias("w"), offset.cast("double").alias("o"), target.cast("double").alias("t"), *[columns[c].cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).persist()
    df, weight, offset, target = kept, F.col("w"), F.col("o"), F.col("t")
    columns = {c: F.col(f"x{i}") for i, c in enumerate(cols)}
    _, sd, _ = irls.moments_of(df, columns, weight)

    def approximation(fit: Fit) -> tuple[Gram, dict[str, float]]:
        p = family.pseudo_data(irls.predictor(fit, columns), target, offset, weight)
        g = gram(df, {**{c: columns[c] for c in cols}, "_z": p["z"]}, p["wobs"])
        own = solve.scales(g, cols)
        return g, {c: float(s / o) if o > 0 and s > 0 else np.inf for c, s, o in zip(cols, sd, own, strict=True)}

    fit = irls.project(df, columns, F.array(target), family, [irls.Job(())], weight, offset)[0]
    fit = Fit(fit.intercept, dict.fromkeys(cols, 0.0))
    g, penalty = approximation(fit)
    lambdas, fits = solve.lambda_grid(g, cols, "_z", n_lambda, ratio, penalty=penalty), []
    for lam in lambdas:
        for _ in range(irls.STEPS):
            after = solve.elastic_net(g, cols, "_z", np.array([lam]), penalty=penalty).fits[0]
            moved = max([abs(after.intercept - fit.intercept), *[abs(after.beta[c] - fit.beta[c]) * s for c, s in zip(cols, sd, strict=True)]])
            fit = after
            if moved < tol:
                break
            g, penalty = approximation(fit)
        fits.append(fit)
        if len({term_of[c] for c in cols if fit.beta[c] != 0}) > largest:
            break
    path = solve.Path(lambdas[: len(fits)], fits)
    order = solve.entering_order(path, cols)
    ranking = fm.lower_first(fm.ranked_terms(order, term_of))[0][:largest]
    ordered = [c for t in ranking for c in blocks[t]] + [c for c in order if term_of[c] not in ranking]
    counts = [sum(len(blocks[t]) for t in ranking[:k]) for k in range(len(ranking) + 1)]
    sized = solve.sized_fits(path, ordered, max(counts))
    chosen = [sized[n] for n in counts]
    means = [family.link.inverse(irls.predictor(f, columns) + offset) for f in chosen]
    row = kept.agg(*[(F.sum(weight * family.cross_entropy(target, m)) / F.sum(weight)).alias(f"c{i}") for i, m in enumerate(means)]).first()
    kept.unpersist()
    return SearchPath(ranking, list(range(len(chosen))), chosen, [row[f"c{i}"] for i in range(len(chosen))])


def rank_table(spark: SparkSession, rankings: dict[int, list[str]]) -> DataFrame:
    """(fold, position, term) of rankings by fold; fold 0 is the search on all data."""
    rows = [(f, i + 1, t) for f, terms in rankings.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "fold int, position int, term string")
