"""Variable selection on the latent scale, with statistics there and on the response scale.

The search projects linear predictors as a Gaussian model; its submodels are then evaluated both ways
from one table of rows each, so that sizes compare on the scale that matters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import evaluate
from lodestar.operators.latent import latent_model, leave_one_out_response
from lodestar.plans import selection
from lodestar.plans.selection import Selection
from lodestar.sources.refmodel import RefModel


@dataclass(frozen=True)
class LatentSelection:
    """One search; ``latent`` has its pointwise table of predictors, ``response`` that of responses."""

    latent: Selection
    response: Selection

    @property
    def path(self):
        return self.latent.path

    def summary(self, names: list[str] | None = None, response_scale: bool = True, **rest) -> DataFrame:
        return (self.response if response_scale else self.latent).summary(names, **rest)

    def suggested(self, stat: str = "elpd", response_scale: bool = True, **rule) -> DataFrame:
        return (self.response if response_scale else self.latent).suggested(stat, **rule)


def _on_responses(ref: RefModel, on: RefModel, chosen: Selection, leave_one_out: bool) -> DataFrame:
    """The pointwise table of latent submodels and of the reference model under the response's own family."""
    rows = on.data.withColumn("y", F.col("y_response"))
    if ref.fits:
        return evaluate.pointwise(rows, ref.columns, chosen.by_size, ref.family, leave_one_out, (list(ref.fits), ref.weights, ref.dis))
    table = evaluate.pointwise(rows, ref.columns, chosen.by_size, ref.family, leave_one_out)
    own = selection._loo_rows(ref.data.withColumn("draws", F.col("mu")), ref, ref.dis, None) if leave_one_out else selection._reference(ref, ref.data, ref.weights, ref.dis)
    return table.unionByName(own)


def varsel(ref: RefModel, method: str = "forward", largest: int = selection.LARGEST, clusters: int = selection.CLUSTERS, prediction_draws: int = selection.PREDICTION_DRAWS) -> LatentSelection:
    """Search by Gaussian projections of the linear predictors, evaluated on both scales."""
    on = latent_model(ref)
    chosen = selection.varsel(on, method, largest, clusters, prediction_draws)
    return LatentSelection(chosen, replace(chosen, ref=ref, pointwise=_on_responses(ref, on, chosen, False).persist()))


def cv_loo(ref: RefModel, method: str = "forward", largest: int = selection.LARGEST, clusters: int = selection.CLUSTERS, prediction_draws: int = 100) -> LatentSelection:
    """Leave-one-out of the full-data path on both scales.

    On the latent scale the response to be predicted is the mean predictor under the weights that
    leave the observation out; on the response scale the weights come from the response's likelihood.
    """
    on = latent_model(ref)
    chosen = selection.varsel(on, method, largest, clusters, prediction_draws)
    without = replace(on, data=leave_one_out_response(on, ref.family).drop("khat"))
    table = evaluate.pointwise(without.data, on.columns, chosen.by_size, on.family)
    latent = table.unionByName(selection._reference(replace(without, fits=()), without.data, on.weights, on.dis))
    return LatentSelection(replace(chosen, pointwise=latent.persist()), replace(chosen, ref=ref, pointwise=_on_responses(ref, on, chosen, True).persist()))
