"""Mixed models from group moments against dense algebra, and searches among group-level terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import groups
from lodestar.operators.groups import INTERCEPT, Model
from lodestar.plans import grouped
from lodestar.sources import refmodel


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n, k = 900, 25
    g = np.where(rng.random(n) < 0.3, 0, rng.integers(0, k, n))  # one group has a third of the rows
    x, z = rng.normal(size=n), 5 + rng.normal(size=n)
    u = rng.multivariate_normal([0, 0], [[1.0, 0.5], [0.5, 0.8]], k)
    y = 1 + 0.6 * x + 0.05 * z + u[g, 0] + u[g, 1] * x + rng.normal(size=n) * 0.7
    w = rng.integers(1, 3, n)
    df = spark.createDataFrame([(i, float(y[i]), float(w[i]), 0.0, float(x[i]), float(z[i]), None if g[i] == 7 else int(g[i])) for i in range(n)], "obs_id long, y double, wobs double, offs double, x double, z double, g int").persist()
    return df, {"y": y, "w": w.astype(float), "x": x, "z": z, "g": g}


def dense(d, factor, fixed, own):
    """Weighted generalized least squares with the covariance written out."""
    cols = {INTERCEPT: np.ones(len(d["y"])), "x": d["x"], "z": d["z"]}
    f, q = (np.column_stack([cols[c] for c in names]) for names in (fixed, own))
    v = np.diag(1 / d["w"]) + (d["g"][:, None] == d["g"][None, :]) * (q @ factor @ factor.T @ q.T)
    vi = np.linalg.inv(v)
    a = f.T @ vi @ f
    beta = np.linalg.solve(a, f.T @ vi @ d["y"])
    rest = d["y"] - f @ beta
    left = len(rest) - len(beta)
    s2 = rest @ vi @ rest / left
    fitted = f @ beta
    part = {}
    for k in np.unique(d["g"]):
        at = d["g"] == k
        part[k] = factor @ factor.T @ q[at].T @ vi[at] @ rest
        fitted[at] += q[at] @ part[k]
    dev = left * np.log(s2) + np.linalg.slogdet(v)[1] + np.log(d["w"]).sum() + np.linalg.slogdet(a)[1]
    score = (d["w"] * (fitted**2 - 2 * d["y"] * fitted)).sum() / d["w"].sum()
    return beta, np.sqrt(s2), dev, score, part


@pytest.mark.parametrize("own", [(INTERCEPT,), (INTERCEPT, "x"), ("x",)])
def test_given_covariance_against_dense_algebra(data, own):
    df, d = data
    factor = np.array([[0.9, 0.0], [0.4, 0.7]])[: len(own), : len(own)]
    m = groups.group_moments(df, {"x": F.col("x"), "z": F.col("z")}, F.array(F.lit(0.0), F.col("y")), 2, "g", F.col("wobs"))
    f = groups.fitted(m, [Model((INTERCEPT, "x", "z"), own, 1)], [factor])[0]
    beta, sigma, dev, score, part = dense(d, factor, (INTERCEPT, "x", "z"), own)
    assert list(f.beta.values()) == pytest.approx(beta.tolist(), rel=1e-7)
    assert (f.sigma, f.deviance, f.score) == pytest.approx((sigma, dev, score), rel=1e-7)
    for r in groups.effects(m, [f], "g").collect():
        assert r.effects[0] == pytest.approx(part[7 if r.g is None else r.g].tolist(), rel=1e-6, abs=1e-9)


def test_restricted_likelihood_is_least(data):
    df, d = data
    m = groups.group_moments(df, {"x": F.col("x"), "z": F.col("z")}, F.array("y"), 1, "g", F.col("wobs"))
    models = [Model((INTERCEPT, "x"), (INTERCEPT, "x")), Model((INTERCEPT, "x"), (INTERCEPT,)), Model((INTERCEPT, "z"), ("z",))]
    both, one, other = groups.fitted(m, models)
    assert both.deviance < one.deviance - 50
    rng = np.random.default_rng(0)
    for f in (both, one, other):
        around = [np.tril(f.factor * (1 + 0.03 * rng.normal(size=f.factor.shape))) for _ in range(25)]
        assert min(g.deviance for g in groups.fitted(m, [f.model] * 25, around)) >= f.deviance - 1e-6
    covariance = both.sigma**2 * both.factor @ both.factor.T
    assert np.diag(covariance) == pytest.approx([1.0, 0.8], rel=0.6) and both.sigma == pytest.approx(0.7 * np.sqrt(1.45), rel=0.15)


def test_no_variance_between_groups_is_found(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v), int(i % 12)) for i, v in enumerate(rng.normal(size=400))], "y double, g int")
    f = groups.fitted(groups.group_moments(df, {}, F.array("y"), 1, "g"), [Model((INTERCEPT,), (INTERCEPT,))])[0]
    assert f.factor[0, 0] < 0.15 and f.sigma == pytest.approx(1, abs=0.08)


def reference(df):
    cols = {c: F.col(c) for c in "xz"}
    return refmodel.datafit(df, families.gaussian(), cols, {"x": ["x"], "z": ["z"], "(x | g)": []})


def test_slopes_are_ranked(data):
    df, _ = data
    chosen = grouped.varsel(reference(df))
    assert chosen.path.sizes == [0, 1, 2, 3, 4] or chosen.path.sizes[0] == 0
    assert "(1 | g)" in chosen.path.ranking[0] and chosen.path.ranking[-1] == "z"
    assert any("(x | g)" in t for t in chosen.path.ranking)
    table = {r["size"]: r for r in chosen.summary(["elpd", "rmse"]).collect()}
    sizes = sorted(table)
    assert all(table[a].rmse >= table[b].rmse - 1e-3 for a, b in zip(sizes, sizes[1:], strict=False))
    assert table[sizes[-1]].rmse < 0.75 < table[0].rmse


def test_draws_and_new_groups(spark, data):
    df, _ = data
    rng = np.random.default_rng(8)
    shift = rng.normal(size=12) * 0.05
    drawn = df.select("obs_id", F.transform(F.array(*[F.lit(float(s)) for s in shift]), lambda s: F.col("y") * 0.8 + 0.2 + s).alias("mu"))
    cols = {c: F.col(c) for c in "xz"}
    fit = lambda rows: rows.withColumn("mu", F.array_repeat(F.col("y"), 12))
    ref = refmodel.from_draws(df, drawn, families.gaussian(), cols, reference(df).terms, [0.5] * 12, predict=fit)
    whole = grouped.varsel(ref, clusters=2, prediction_draws=3)
    assert len(whole.by_size[0][0]) == 3 and "(1 | g)" in whole.path.ranking[0]
    size = max(whole.path.sizes)
    seen = {(r["size"], r.obs_id): r.mu for r in whole.pointwise.collect()}
    new = df.limit(5).withColumns({"g": F.lit(999)})
    other = {(r["size"], r.obs_id): r.mu for r in grouped.varsel(ref, clusters=2, prediction_draws=3, test=new).pointwise.collect()}
    for r in new.collect():  # a group that wasn't seen has no effects
        fixed = np.mean([f.intercept + sum(b * r[c] for c, b in f.beta.items()) for f in whole.by_size[size][0]])
        assert other[size, r.obs_id] == pytest.approx(fixed, rel=1e-6) and other[size, r.obs_id] != pytest.approx(seen[size, r.obs_id], rel=1e-4)


def test_what_cannot_be_searched_is_an_error(data):
    df, _ = data
    cols = {"x": F.col("x")}
    two = refmodel.datafit(df, families.gaussian(), cols, {"x": ["x"], "(1 | g)": [], "(1 | h)": []})
    with pytest.raises(ValueError, match="one grouping factor"):
        grouped.varsel(two)
    with pytest.raises(ValueError, match="Gaussian"):
        grouped.varsel(refmodel.datafit(df, families.poisson(), cols, {"x": ["x"], "(1 | g)": []}))
    with pytest.raises(ValueError, match="unknown terms"):
        grouped.varsel(reference(df), blocks=["nope", "(1 | g)"])
