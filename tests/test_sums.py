"""Statistics from the sums of one pass, against those of the pointwise table."""

import functools
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import loo, stats
from lodestar.plans import selection
from lodestar.sources import refmodel

NAMES = ["elpd", "mlpd", "gmpd", "mse", "rmse", "R2"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n, far = 60, 1e4  # y lies far from zero, where sums of powers would cancel
    x = rng.normal(size=(n, 2))
    y = far + 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    return spark.createDataFrame([(i, float(y[i]), float(1 + i % 3), float(i % 5), float(x[i, 0]), float(x[i, 1]), float(i % 4 == 0)) for i in range(n)], "obs_id long, y double, wobs double, offs double, a double, b double, hit double").repartition(3)


def table(df):
    return {(r["size"], r.statistic): list(r[2:]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, cells in want.items():
        assert [v is None for v in got[k]] == [v is None for v in cells], k
        assert [v or 0.0 for v in got[k]] == pytest.approx([v or 0.0 for v in cells], rel=1e-7, abs=1e-9, nan_ok=True), k


def model(rows, family="gaussian"):
    columns, terms = {c: F.col(c) for c in "ab"}, {c: [c] for c in "ab"}
    if family == "gaussian":
        return refmodel.gaussian_conjugate(rows, columns, terms, draws=30)
    return refmodel.glm_laplace(rows.withColumns({"y": F.col("hit"), "wobs": F.lit(1.0), "offs": F.lit(0.0)}), families.binomial(), columns, terms, draws=6)


@pytest.mark.parametrize("how", ["varsel", "cv_loo", "cv_kfold", "binomial"])
def test_statistics_need_no_pointwise_table(rows, monkeypatch, how):
    ref = model(rows, "binomial" if how == "binomial" else "gaussian")
    make = {"varsel": selection.varsel, "cv_loo": functools.partial(selection.cv_loo, warn_shape=False), "cv_kfold": functools.partial(selection.cv_kfold, k=3), "binomial": selection.varsel}[how]
    chosen = make(ref, clusters=3, prediction_draws=12 if how == "varsel" else 6)
    names = [*NAMES, "acc"] if how == "binomial" else NAMES
    want = {b: table(stats.statistics(chosen.pointwise, names, b)) for b in (None, "ref", 1)}
    with monkeypatch.context() as m:
        m.setattr(stats, "statistics", lambda *_: pytest.fail("the pointwise table was read"))
        for b in (None, "ref"):
            same(table(chosen._statistics(names, b)), want[b])
        assert chosen.summary(names).count() == 3 and chosen.suggested().count() == 1
    same(table(chosen._statistics(names, 1)), want[1])
    chosen.release()


def test_no_rows_and_one_row(rows):
    ref = model(rows)
    for n in (0, 1):
        chosen = selection.varsel(ref, clusters=3, prediction_draws=6, test=rows.filter(F.col("obs_id") < n))
        same(table(chosen._statistics(NAMES[:5])), table(stats.statistics(chosen.pointwise, NAMES[:5])))


def test_shapes_come_from_the_same_pass(rows, monkeypatch):
    ref = model(rows)
    poor = loo.poor_shapes(selection._shapes(ref), "khat", 30, warn=False)
    monkeypatch.setattr(selection, "_shapes", lambda *_: pytest.fail("another scan"))
    told = []
    monkeypatch.setattr(loo, "warn_poor", lambda *a: told.append(a))
    selection.cv_loo(ref, clusters=3, prediction_draws=6)
    assert told == [(poor, 60, 30)]


def test_products_of_factors_keep_digits():
    x = np.array([[1e-300, 1.0, 2.0, 3.0, 4.0, 5.0], [1e-9, 2e-9, 3e-9, 4e-9, 5e-9, 6e-9], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]])
    theta = np.array([[-1e200, 0.1], [1e-6, -2.0], [-1e-12, 0.15]])
    assert loo._mean_log1p(theta, x) == pytest.approx(np.log1p(-theta[:, :, None] * x[:, None, :]).mean(axis=2), rel=1e-11)


def test_folds_of_other_families_read_kept_rows(rows, monkeypatch):
    class Stopped(Exception):
        pass

    def stop(train, *_):
        plans.append(train._jdf.queryExecution().optimizedPlan().toString())
        raise Stopped

    plans, ref = [], model(rows, "binomial")
    monkeypatch.setattr(selection, "varsel", lambda *_: SimpleNamespace(path=SimpleNamespace(ranking=[]), by_size={}))
    monkeypatch.setattr(selection, "glm_laplace", stop)
    with pytest.raises(Stopped):
        selection.cv_kfold(ref, k=3)
    assert "Window" not in plans[0] and "Join" not in plans[0]
