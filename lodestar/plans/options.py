"""Options and checks of arguments, made before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

from lodestar.operators import formula as fm
from lodestar.operators.stats import LOSSES, UTILITIES


@dataclass(frozen=True)
class Options:
    """Sizes and switches of an analysis."""

    largest: int = 19
    clusters: int = 20
    prediction_draws: int = 400
    folds: int = 5
    regul: float = 1e-4
    n_lambda: int = 150
    lambda_ratio: float = 1e-5
    bootstrap: int = 2000
    seed: int = 1
    warn_shape: bool = True


def check_search(method: str, terms: list[str], augmented: bool = False) -> None:
    """L1 searches know neither group-level nor smooth terms nor several categories."""
    if method not in ("forward", "l1"):
        raise ValueError(f"unknown search {method}")
    if method == "l1" and (augmented or any(fm.is_group(p) or fm.is_smooth(p) for t in terms for p in fm.split_top(t))):
        raise ValueError("an L1 search takes main effects and interactions only")


def check_folds(method: str, k: int, n: int, is_datafit: bool, validate_search: bool, refit: bool) -> None:
    if method not in ("loo", "kfold"):
        raise ValueError(f"unknown cross-validation {method}")
    if method == "loo" and is_datafit:
        raise ValueError("the data as reference model needs K-fold cross-validation")
    if method == "kfold" and not 2 <= k <= n:
        raise ValueError("folds must be between two and the number of observations")
    if method == "kfold" and not validate_search and not refit:
        raise ValueError("K-fold cross-validation without either search or refit has nothing to validate")


def check_stats(stats: list[str], family: str, projection: str = "traditional") -> None:
    """Which statistics a family and projection have."""
    for s in stats:
        if s not in UTILITIES + LOSSES:
            raise ValueError(f"unknown statistic {s}")
        if projection == "augmented" and s not in ("elpd", "mlpd", "gmpd", "acc", "pctcorr"):
            raise ValueError(f"{s} is not defined for categories")
        if projection != "augmented" and s in ("acc", "pctcorr", "auc") and family != "binomial":
            raise ValueError(f"{s} needs a binomial response")
