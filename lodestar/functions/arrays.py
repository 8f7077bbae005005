"""Algebra on array columns whose positions are posterior draws, clusters or categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weighted_mean(values: Column, weights: Column) -> Column:
    """Sum of values times weights; weights sum to one."""
    return total(F.zip_with(values, weights, lambda v, w: v * w))


def log_sum_exp(values: Column) -> Column:
    """Logarithm of the sum of exponentials, shifted by the maximum."""
    shifted = lambda v, top: top + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return let(values, lambda v: let(F.array_max(v), lambda top: shifted(v, top)))


def log_weighted_mean_exp(values: Column, weights: Column) -> Column:
    """Logarithm of the weighted mean of exponentials; draws without weight count as absent."""
    shifted = F.zip_with(values, weights, lambda v, w: F.when(w > 0, v + F.log(w)))
    return log_sum_exp(F.filter(shifted, lambda v: v.isNotNull()))


def log_normalized(values: Column) -> Column:
    """Log weights that sum to one on the natural scale."""
    return let(values, lambda v: let(log_sum_exp(v), lambda norm: F.transform(v, lambda x: x - norm)))


def differences(cumulative: Column) -> Column:
    """Category probabilities from cumulative ones, which end before the last category."""
    lower = F.concat(F.array(F.lit(0.0)), cumulative)
    return F.zip_with(F.concat(cumulative, F.array(F.lit(1.0))), lower, lambda u, v: u - v)


def cumulative(probabilities: Column) -> Column:
    """Cumulative sums of all but the last probability."""
    return F.transform(F.slice(probabilities, 1, F.size(probabilities) - 1), lambda p, i: total(F.slice(probabilities, F.lit(1), i + 1)))


def best_category(probabilities: Column, levels: list[str]) -> Column:
    """The level of the largest probability, the first of equals; null if all are null."""
    at = let(probabilities, lambda p: F.array_position(p, F.array_max(p)))
    return F.element_at(F.array(*[F.lit(v) for v in levels]), at.cast("int"))
