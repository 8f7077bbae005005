"""Searches over categories: two are the binomial search, more recover what made the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import categories
from lodestar.operators.categories import Job
from lodestar.plans import categorical, selection
from lodestar.sources import refmodel

LEVELS = ["high", "low", "mid"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(31)
    n = 500
    x, z, noise = rng.normal(size=n), 50 + 10 * rng.normal(size=n), rng.normal(size=n)
    eta = np.column_stack([np.zeros(n), 0.3 + 1.2 * x, -0.2 + 0.8 * x + 0.08 * (z - 50)])
    p = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    y = [LEVELS[int((rng.random() > np.cumsum(row)).sum())] for row in p]
    return spark.createDataFrame([(i, y[i], float(x[i]), float(z[i]), float(noise[i])) for i in range(n)], "obs_id long, y string, x double, z double, noise double").persist()


TERMS = {c: [c] for c in ("x", "z", "noise")}


def columns():
    return {c: F.col(c) for c in TERMS}


def test_many_fits_are_the_single_ones(spark, data):
    target = categories.one_hot(F.col("y"), LEVELS)
    soft = F.transform(target, lambda v: 0.7 * v + 0.1)
    both = F.array(target, soft)
    jobs = [Job(("x", "z"), 0), Job(("x",), 1), Job((), 1)]
    for ordered in (False, True):
        fits = categories.project_many(data, columns(), both, 3, jobs, ordered, regul=0.0)
        for job, f in zip(jobs, fits, strict=True):
            cols = {c: columns()[c] for c in job.cols}
            if ordered:
                one = categories.ordinal(data, cols, (target, soft)[job.target], 3, regul=0.0)
                want = [*one.thresholds, *one.beta.values()]
            else:
                want = [v for g in categories.softmax(data, cols, (target, soft)[job.target], 3, regul=0.0).fits for _, v in g.table()]
            assert f.theta.tolist() == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_two_categories_are_the_binomial_search(spark, data):
    rows = data.withColumn("y", F.when(F.col("y") == "low", 1.0).otherwise(0.0)).withColumns({"wobs": F.lit(1.0), "offs": F.lit(0.0)})
    p = lambda s: 1 / (1 + F.exp(-(F.col("x") * (1 + (s - 3) / 10) - 0.3)))
    drawn = rows.select("obs_id", F.transform(F.sequence(F.lit(1), F.lit(6)), p).alias("mu"))
    two = selection.varsel(refmodel.from_draws(rows, drawn, families.binomial(), columns(), TERMS), clusters=3, prediction_draws=4)
    named = rows.withColumn("y", F.when(F.col("y") == 1, "yes").otherwise("no")).join(drawn, "obs_id").withColumn("mu", F.transform("mu", lambda m: F.array(1 - m, m)))
    for ordered in (False, True):
        one = categorical.varsel(categorical.from_draws(named, ["no", "yes"], columns(), TERMS, ordered), clusters=3, prediction_draws=4)
        assert one.path.ranking == two.path.ranking
        assert one.path.scores == pytest.approx(two.path.scores, rel=1e-3)
        a, b = ({r["size"]: r for r in s.summary(["elpd", "acc"]).collect()} for s in (one, two))
        for size in b:
            assert (a[size].elpd, a[size].acc) == pytest.approx((b[size].elpd, b[size].acc), rel=1e-3)


@pytest.mark.parametrize("ordered", [False, True])
def test_three_categories(spark, data, ordered):
    rows = data if not ordered else data.withColumn("y", F.when(F.col("x") + F.pmod(F.xxhash64("obs_id"), F.lit(100)) / 50 < 0.2, "a").when(F.col("x") < 0.5, "b").otherwise("c"))
    levels = LEVELS if not ordered else ["a", "b", "c"]
    model = categorical.fitted(rows, levels, columns(), TERMS, 8, ordered)
    chosen = categorical.varsel(model, clusters=2, prediction_draws=4)
    assert chosen.path.ranking[0] == "x" and chosen.path.ranking[-1] == ("noise" if not ordered else chosen.path.ranking[-1])
    assert all(a >= b - 1e-9 for a, b in zip(chosen.path.scores, chosen.path.scores[1:], strict=False))
    table = {r["size"]: r for r in chosen.summary().collect()}
    assert table[1].elpd > table[0].elpd and table[1].acc > table[0].acc and table[3].elpd_diff == pytest.approx(0, abs=6)
    assert chosen.suggested("elpd").first().suggested_size in (1, 2, 3)
    again = categorical.varsel(model, clusters=2, prediction_draws=4, test=model, largest=1)
    assert {r["size"]: r.elpd for r in again.summary(["elpd"]).collect()}[1] == pytest.approx(table[1].elpd, rel=1e-9)


def test_arguments(spark, data):
    rows = data.withColumn("mu", F.array(categories.one_hot(F.col("y"), LEVELS)))
    with pytest.raises(ValueError, match="among the levels"):
        categorical.from_draws(rows, ["high", "low", "none"], columns(), TERMS)
    with pytest.raises(ValueError, match="sum to one"):
        categorical.from_draws(rows.withColumn("mu", F.transform("mu", lambda p: F.transform(p, lambda v: v / 2))), LEVELS, columns(), TERMS)
    chosen = categorical.varsel(categorical.from_draws(rows, LEVELS, columns(), TERMS), largest=0)
    for stat in ("mse", "auc"):
        with pytest.raises(ValueError, match="not defined for categories"):
            chosen.summary([stat])
