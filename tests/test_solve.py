import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import draws, irls, loo, search, solve
from lodestar.operators.gram import INTERCEPT, Gram, grams
from lodestar.operators.gram import gram as gram_of


def made(n=200, p=4, seed=0, weights=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 0.1, 2][:p] + 3
    y = x @ np.arange(1, p + 1) + rng.normal(size=n)
    w = np.ones(n) if weights is None else weights
    z = np.column_stack([np.ones(n), x, y])
    names = (INTERCEPT, *[f"x{i}" for i in range(p)], "y")
    return x, y, w, Gram(names, z.T @ (z * w[:, None]), n)


def test_ridge_without_penalty_is_least_squares():
    x, y, w, g = made()
    f = solve.ridge(g, ["x0", "x1", "x2", "x3"], "y", 0.0)
    exact = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert np.allclose([f.intercept, *f.beta.values()], exact)


def test_cross_entropy_and_dispersion_match_rows():
    x, y, w, g = made(weights=np.random.default_rng(1).integers(1, 5, 200).astype(float))
    f = solve.ridge(g, ["x0", "x2"], "y")
    q = f.intercept + x[:, [0, 2]] @ np.array(list(f.beta.values()))
    assert solve.cross_entropy(g, f, "y") == pytest.approx(np.sum(w * (q * q - 2 * y * q)) / w.sum(), rel=1e-8)
    assert solve.dispersion(g, f, "y") == pytest.approx(np.sqrt(np.sum(w * (y - q) ** 2) / w.sum()), rel=1e-6)


def test_weights_equal_repeated_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    w = rng.integers(1, 4, 30)
    names = (INTERCEPT, "a", "b", "y")
    z = np.column_stack([np.ones(30), x, y])
    rep = np.repeat(z, w, axis=0)
    a = solve.ridge(Gram(names, (z * w[:, None]).T @ z, 30), ["a", "b"], "y", 0.0)
    b = solve.ridge(Gram(names, rep.T @ rep, len(rep)), ["a", "b"], "y", 0.0)
    assert np.allclose([a.intercept, *a.beta.values()], [b.intercept, *b.beta.values()])


@settings(deadline=None, max_examples=20)
@given(st.integers(0, 10_000), st.floats(0.1, 1.0))
def test_elastic_net_meets_the_optimality_conditions(seed, alpha):
    x, y, w, g = made(60, 4, seed)
    cols = ["x0", "x1", "x2", "x3"]
    grid = solve.lambda_grid(g, cols, "y", 20, 1e-3, alpha)
    path = solve.elastic_net(g, cols, "y", grid, alpha)
    sd = solve.scales(g, cols)
    for lam, f in zip(path.lambdas, path.fits, strict=True):
        b = np.array([f.beta[c] for c in cols])
        grad = (g.centered(cols, ["y"])[:, 0] - g.centered(cols, cols) @ b) / sd - lam * (1 - alpha) * b * sd
        tol = 1e-3 * abs(lam * alpha) + 1e-6 * np.abs(g.centered(cols, ["y"])).max()
        assert np.all(np.abs(grad) <= lam * alpha + tol)
        assert np.allclose(grad[b != 0], lam * alpha * np.sign(b[b != 0]), atol=tol)
    assert all(v == 0 for v in path.fits[0].beta.values())


def test_penalty_zero_and_infinite():
    _, _, _, g = made()
    cols = ["x0", "x1", "x2", "x3"]
    pen = {"x0": 0.0, "x1": float("inf")}
    grid = solve.lambda_grid(g, cols, "y", penalty=pen)
    path = solve.elastic_net(g, cols, "y", grid, penalty=pen)
    assert all(f.beta["x0"] != 0 and f.beta["x1"] == 0 for f in path.fits)
    assert solve.entering_order(path, cols)[0] == "x0" and solve.entering_order(path, cols)[-1] == "x1"


def test_constant_column_stays_out():
    x, y, w, g = made(p=2)
    z = np.column_stack([np.ones(200), x, np.full(200, 7.0), y])
    g = Gram((INTERCEPT, "x0", "x1", "c", "y"), z.T @ z, 200)
    assert solve.ridge(g, ["x0", "c"], "y").beta["c"] == 0.0


def test_forward_search_lowers_the_score():
    _, _, _, g = made()
    path = search.forward(g, {f"x{i}": [f"x{i}"] for i in range(4)}, "y")
    assert path.scores == sorted(path.scores, reverse=True)
    assert path.ranking[0] == "x1"
    forced = search.forward(g, {f"x{i}": [f"x{i}"] for i in range(4)}, "y", candidates=["x0 + x2", "x0 + x2 + x1"])
    assert forced.ranking == ["x0 + x2", "x1"] and forced.sizes == [0, 2, 3]


@pytest.mark.parametrize("family", [families.binomial(), families.binomial("probit"), families.binomial("cauchit"), families.binomial("cloglog"), families.poisson(), families.poisson("sqrt"), families.gaussian(), families.student_t(4.0)])
def test_gradients_by_finite_differences(family):
    f = np.linspace(-1.5, 1.5, 41) if family.link.name != "sqrt" else np.linspace(0.3, 2.5, 41)
    y = np.where(np.arange(41) % 2, 1.0, 0.0)
    h = 1e-5
    loss = lambda v: family.np_half_deviance(y, family.link.np_inverse(v))
    numeric = (loss(f + h) - loss(f - h)) / (2 * h)
    slope = (family.link.np_inverse(f + h) - family.link.np_inverse(f - h)) / (2 * h)
    assert np.allclose(slope, family.link.np_slope(f), atol=1e-6)
    if family.name in ("binomial", "poisson", "gaussian"):
        mu = family.link.np_inverse(f)
        assert np.allclose(numeric, -(y - mu) / family.np_variance(mu) * family.link.np_slope(f), atol=1e-5)


def test_thinning_rounds_halves_to_even():
    assert draws.thinned(100, 50)[0] == 1 and draws.thinned(100, 50)[-1] == 100
    assert len(set(draws.thinned(100, 50))) == 50
    assert draws.thinned(4, 9) == [1, 2, 3, 4]


def test_kmeans_finds_separate_draws():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (10, 30)), rng.normal(5, 0.1, (7, 30))])
    labels = draws.kmeans(x @ x.T, 2)
    assert len(set(labels[:10])) == 1 and len(set(labels[10:])) == 1 and labels[0] != labels[-1]
    assert draws.kmeans(x @ x.T, 2, seed=5) == draws.kmeans(x @ x.T, 2, seed=5)
    assert sorted(draws.kmeans(x @ x.T, 17)) == list(range(17))


def test_pareto_shape_of_known_tail():
    rng = np.random.default_rng(1)
    for true in (0.2, 0.7):
        x = np.sort((rng.random(4000) ** -true - 1) / true)
        assert loo.generalized_pareto(x[None, :])[0][0] == pytest.approx(true, abs=0.1)


def test_smoothed_weights_are_normalized_and_ordered():
    raw = np.random.default_rng(2).normal(0, 2, 500)
    both, k = loo.smoothed(np.stack([raw, raw[::-1]]))
    lw = both[0]
    assert np.allclose(lw, both[1][::-1])
    assert np.exp(lw).sum() == pytest.approx(1)
    assert np.isfinite(k).all()
    assert np.array_equal(np.argsort(lw[np.argsort(raw)], kind="stable"), np.arange(500))
    assert loo.smoothed(np.zeros((1, 30)))[1][0] == np.inf


def test_smoothing_leaves_light_tails_nearly_alone():
    raw = np.random.default_rng(3).normal(0, 0.1, (4, 400))
    lw, k = loo.smoothed(raw)
    plain = raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))
    assert np.abs(lw - plain).max() < 0.1 and (k < 0.5).all()


def test_newton_equals_ridge_for_gaussian(spark):
    from pyspark.sql import functions as F

    x, y, w, g = made(80, 2)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "x0 double, x1 double, y double")
    cols = {"x0": F.col("x0"), "x1": F.col("x1")}
    f = irls.project(df, cols, F.array("y"), families.gaussian(), [irls.Job(("x0", "x1")), irls.Job(("x1",))])
    for fit, names in zip(f, (["x0", "x1"], ["x1"]), strict=True):
        exact = solve.ridge(g, names, "y")
        assert np.allclose([fit.intercept, *fit.beta.values()], [exact.intercept, *exact.beta.values()], atol=1e-6)


def test_moments_of_columns_far_from_zero(spark):
    """A straight line a billion away from zero keeps its slope, also with folds, targets and Newton passes."""
    x = 1e9 + np.arange(300) / 1000
    df = spark.createDataFrame([(float(v), float(i), i % 3) for i, v in enumerate(x)], "x double, y double, fold int")
    cols = {"x": F.col("x"), "y": F.col("y")}
    g = gram_of(df, cols)
    assert solve.ridge(g, ["x"], "y", 0.0).beta["x"] == pytest.approx(1000, rel=1e-6)
    assert solve.scales(g, ["x"])[0] == pytest.approx(np.std(np.arange(300) / 1000, ddof=1), rel=1e-6)
    by = grams(df, cols, by=F.col("fold"))
    assert solve.ridge(by[0] + by[1], ["x"], "y", 0.0).beta["x"] == pytest.approx(1000, rel=1e-6)
    assert g.part(["x"], ["y"])[0, 0] == pytest.approx(float((x * np.arange(300)).sum()), rel=1e-12)
    f = irls.project(df, {"x": F.col("x")}, F.array((F.col("y") + 1) / 302), families.binomial("logit"), [irls.Job(("x",))], regul=0.0)[0]
    assert f.beta["x"] > 1
    constant = gram_of(df, {"c": F.lit(1e9), "y": F.col("y")})
    assert solve.scales(constant, ["c"])[0] == 0


def test_l1_newton_meets_its_conditions(spark):
    """At the first penalty below the largest, one logistic coefficient solves its subgradient equation."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-x))).astype(float)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    path = search.l1_newton(df, {"x": F.col("x")}, {"x": ["x"]}, F.col("y"), families.binomial(), F.lit(1.0), F.lit(0.0), n_lambda=4, ratio=0.1, tol=1e-9)
    f, sd = path.fits[1], np.std(x, ddof=1)
    p = 1 / (1 + np.exp(-(f.intercept + f.beta["x"] * x)))
    top = 1.001 * abs(((y - y.mean()) * (x - x.mean())).sum() / sd)
    assert (y - p).sum() == pytest.approx(0, abs=1e-4)
    assert ((y - p) * x).sum() / sd == pytest.approx(0.1 * top, rel=1e-4)


def test_normal_distribution_on_arrays():
    import math
    from statistics import NormalDist

    from lodestar.functions import normal

    x = np.concatenate([np.linspace(-37, 37, 2001), [0.0, 3.0, -3.0, np.nan, np.inf, -np.inf]])
    got = normal.cdf(x)
    for a, b in zip(x, got, strict=True):
        if np.isnan(a):
            assert np.isnan(b)
        else:
            assert b == pytest.approx(math.erfc(-a / math.sqrt(2)) / 2, rel=3e-12, abs=1e-300)
    p = np.concatenate([np.geomspace(1e-300, 0.5, 500), 1 - np.geomspace(1e-15, 0.5, 200)])
    assert normal.quantile(p) == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-9, abs=1e-12)
    assert normal.quantile([0, 1]).tolist() == [-np.inf, np.inf] and np.isnan(normal.quantile([np.nan])[0])


def test_keyed_numbers_have_their_moments():
    from lodestar.functions import normal

    keys = np.arange(4000)
    u, z = normal.uniforms(keys, 50, 1), normal.normals(keys, 50, 1)
    assert (u > 0).all() and (u < 1).all() and u.mean() == pytest.approx(0.5, abs=0.003) and u.var() == pytest.approx(1 / 12, abs=0.001)
    assert z.mean() == pytest.approx(0, abs=0.01) and z.std() == pytest.approx(1, abs=0.01)
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.05
    assert (normal.uniforms(keys[::-1], 50, 1)[::-1] == u).all() and (normal.uniforms(keys, 50, 2) != u).all()
    for shape in (0.3, 1.0, 4.5):
        g = normal.gammas(keys, np.full((4000, 50), shape), 3)
        assert g.mean() == pytest.approx(shape, rel=0.02) and g.var() == pytest.approx(shape, rel=0.05)


def test_samplers_have_their_moments(spark):
    from lodestar.functions import families
    from lodestar.functions.arrays import doubles
    from lodestar.operators import evaluate
    from pyspark.sql import functions as F

    rows = spark.range(600).select(F.col("id").alias("obs_id"), F.lit(7.0).alias("wobs"))
    cases = {"binomial": (families.binomial(), [0.2, 0.9], None, 7 * 0.55), "poisson": (families.poisson(), [0.5, 350.0], None, 175.25), "gamma": (families.gamma(), [2.0, 6.0], [3.0, 3.0], 4.0), "t": (families.student_t(6.0), [1.0, -3.0], [0.5, 0.5], -1.0)}
    for family, mu, dis, mean in cases.values():
        out = evaluate.sampled(rows.withColumn("m", doubles(mu)), "m", family, 100, 3, dis).collect()
        values = np.array([r.predicted for r in out])
        assert values.mean() == pytest.approx(mean, rel=0.03)
        if family.name == "poisson":
            assert values[:, 1::2].var() == pytest.approx(350, rel=0.05) and (values == np.round(values)).all()
        if family.name == "binomial":
            assert values.min() >= 0 and values.max() <= 7 and values[:, 0::2].var() == pytest.approx(7 * 0.16, rel=0.05)


def test_responses_are_checked(spark):
    from lodestar.operators import design

    rows = spark.createDataFrame([("no", 1.0, 2), ("yes", 2.0, 3)], "s string, w double, n int")
    assert [(r.y, r.wobs) for r in design.response(rows, "s", "w").collect()] == [(0.0, 1.0), (1.0, 2.0)]
    assert [r.y for r in design.response(rows, "n > 2").collect()] == [0.0, 1.0]
    for call in (lambda: design.response(rows, "n", "w - 2").collect(), lambda: design.response(rows, "n", failures="n - 4").collect()):
        with pytest.raises(Exception, match="not negative"):
            call()
    with pytest.raises(ValueError, match="two levels"):
        design.response(rows.filter("n = 2"), "s")
