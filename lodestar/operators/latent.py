"""Latent projections: Gaussian projections of the linear predictor, evaluated on the response scale."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.arrays import doubles, log_weighted_mean_exp, weighted_mean
from lodestar.functions.families import Family, gaussian
from lodestar.operators import evaluate, loo
from lodestar.operators.solve import Fit
from lodestar.sources.refmodel import RefModel

#: Latent residual deviations of the probit and logit links.
DEVIATIONS = {"probit": 1.0, "logit": 1.6}


def latent_model(ref: RefModel) -> RefModel:
    """The reference model on its link scale: the response is the mean predictor, the family Gaussian.

    A user's draws are taken to the link scale. Links without a known deviation get none, and densities on the latent scale are then not defined.
    """
    if ref.is_datafit:
        raise ValueError("a latent projection needs a reference model with predictions")
    deviation = DEVIATIONS.get(ref.family.link.name)
    eta = evaluate.predictors(list(ref.fits), ref.columns, F.col("offs")) if ref.fits else F.transform("mu", ref.family.link.link)
    data = ref.data.withColumn("y_response", F.col("y")).withColumn("mu", eta)
    data = data.withColumn("y", weighted_mean(F.col("mu"), doubles(ref.weights)))
    return replace(ref, data=data, family=gaussian(), dis=[deviation or float("nan")] * ref.n_draws)


def on_response_scale(df: DataFrame, fits: list[Fit], weights: list[float], ref: RefModel, family: Family, log_lik: Callable[[Column, Column, Column], Column] | None = None, censored: Column | None = None, log_tail: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """(obs_id, y, wobs, mu, lppd) of latent fits under the response family.

    ``log_lik(y, mu, weights)`` overrides the family's. Rows marked by ``censored`` count by
    ``log_tail(y, mu, weights)``, the logarithm of the probability of a larger response; mu and the
    statistics made of it take no notice of censoring.
    """
    if (censored is None) != (log_tail is None):
        raise ValueError("censored rows need the logarithm of the upper tail, and the other way round")
    mu = evaluate.means(evaluate.predictors(fits, ref.columns, F.col("offs")), family)
    lik = log_lik or (lambda y, m, w: family.log_lik(y, m, w))
    rows = df.withColumn("draws", mu)
    y, w = F.col("y_response"), F.col("wobs")
    ll = F.transform("draws", lambda m: lik(y, m, w))
    if censored is not None:
        ll = F.when(censored, F.transform("draws", lambda m: log_tail(y, m, w))).otherwise(ll)
    keep = [] if censored is None else [censored.alias("censored")]
    return rows.select("obs_id", F.col("y_response").alias("y"), "wobs", *keep, weighted_mean(F.col("draws"), doubles(weights)).alias("mu"), log_weighted_mean_exp(ll, doubles(weights)).alias("lppd"))


def samples_on_response_scale(df: DataFrame, fits: list[Fit], weights: list[float], ref: RefModel, family: Family, draws: int, seed: int = 1) -> DataFrame:
    """Adds ``predicted``: draws of the response from latent fits, a fit taken with its weight for each."""
    rows = df.withColumn("_mus", evaluate.means(evaluate.predictors(fits, ref.columns, F.col("offs")), family))
    return evaluate.sampled(rows, "_mus", family, draws, seed, None, weights).drop("_mus")


def leave_one_out_response(latent: RefModel, family: Family, log_lik: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """The rows of a latent model with, as response, the mean predictor under the weights that leave the observation out.

    The plain mean has seen the response it stands for. Adds ``khat``, the weights' Pareto shapes.
    """
    lik = log_lik or (lambda y, m, w: family.log_lik(y, m, w))
    rows = latent.data.withColumn("_ll", F.transform("mu", lambda e: lik(F.col("y_response"), family.link.inverse(e), F.col("wobs"))))
    rows = rows.withColumn("_psis", loo.psis_weights(F.col("_ll")))
    return rows.withColumns({"y": loo.expectation(F.col("mu"), F.col("_psis.lw")), "khat": F.col("_psis.khat")}).drop("_ll", "_psis")
