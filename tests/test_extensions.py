import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrays, families
from lodestar.operators import categories, design, draws, evaluate, irls, latent, loo, multilevel, smooth, stats
from lodestar.plans import options, selection
from lodestar.sources import refmodel
from lodestar.streaming.moments import running_moments, total_moments


def table(spark, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*cols.values(), strict=True)], ", ".join(f"{n} double" for n in names))


@pytest.fixture(scope="module")
def binary(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(float)
    return table(spark, x=x, y=y)


def test_two_categories_equal_the_binomial_projection(spark, binary):
    cols = {"x": F.col("x")}
    b = irls.project(binary, cols, F.array("y"), families.binomial(), [irls.Job(("x",))], regul=0.0, threshold=1e-14)[0]
    t = F.array(1 - F.col("y"), F.col("y"))
    s = categories.softmax(binary, cols, t, 2, regul=0.0).fits[0]
    o = categories.ordinal(binary, cols, t, 2, regul=0.0)
    assert (s.intercept, s.beta["x"]) == pytest.approx((b.intercept, b.beta["x"]), abs=1e-5)
    assert (-o.thresholds[0], o.beta["x"]) == pytest.approx((b.intercept, b.beta["x"]), abs=1e-5)


def test_ordinal_recovers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    u = 1.2 * x + rng.logistic(size=4000)
    y = (u > -1).astype(int) + (u > 1.5)
    df = table(spark, x=x, y=y).withColumn("t", F.array(*[(F.col("y") == k).cast("double") for k in range(3)]))
    f = categories.ordinal(df, {"x": F.col("x")}, F.col("t"), 3)
    assert f.thresholds == pytest.approx([-1, 1.5], abs=0.15) and f.beta["x"] == pytest.approx(1.2, abs=0.12)
    p = df.select(f.probabilities({"x": F.col("x")}).alias("p")).first().p
    assert sum(p) == pytest.approx(1)


def test_random_intercept_recovers_and_matches_dense_algebra(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 30, 900)
    u = rng.normal(0, 1.5, 30)
    x = rng.normal(size=900)
    y = 2 + 0.7 * x + u[g] + rng.normal(size=900)
    df = table(spark, g=g, x=x, y=y)
    f = multilevel.random_intercept(df, {"x": F.col("x")}, F.col("y"), "g")
    assert f.fixed.beta["x"] == pytest.approx(0.7, abs=0.1) and f.sigma == pytest.approx(1, abs=0.08)
    v = np.eye(900) + f.ratio * (g[:, None] == g[None, :])
    z = np.column_stack([np.ones(900), x])
    vi = np.linalg.inv(v)
    beta = np.linalg.solve(z.T @ vi @ z, z.T @ vi @ y)
    assert [f.fixed.intercept, f.fixed.beta["x"]] == pytest.approx(beta.tolist(), rel=1e-6)
    effects = {r.g: r.effect for r in f.effects.collect()}
    rest = y - z @ beta
    for k in range(30):
        assert effects[k] == pytest.approx(f.ratio / (1 + f.ratio * (g == k).sum()) * rest[g == k].sum(), rel=1e-6)


def test_mixed_logistic_recovers(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 40, 4000)
    u = rng.normal(0, 1, 40)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 - 0.9 * x + u[g])))).astype(float)
    f = multilevel.penalized_quasi(table(spark, g=g, x=x, y=y), {"x": F.col("x")}, F.col("y"), "g", families.binomial())
    assert f.fixed.beta["x"] == pytest.approx(-0.9, abs=0.12)
    effects = {int(r.g): r.effect for r in f.effects.collect()}
    assert np.corrcoef([effects[k] for k in range(40)], u)[0, 1] > 0.9


def test_new_levels_are_keyed(spark):
    levels = spark.range(2000).withColumnRenamed("id", "g")
    a = [r.effect for r in multilevel.new_level_effects(levels, "g", 2.0).orderBy("g").collect()]
    b = [r.effect for r in multilevel.new_level_effects(levels.repartition(5), "g", 2.0).orderBy("g").collect()]
    assert a == b and np.std(a) == pytest.approx(2, abs=0.15)


def test_smooth_recovers_a_curve(spark):
    rng = np.random.default_rng(4)
    x, z = rng.uniform(-3, 3, 1500), rng.normal(size=1500)
    y = 2 * np.sin(x) + 0.5 * z + rng.normal(0, 0.2, 1500)
    df = table(spark, x=x, z=z, y=y)
    s = smooth.fit_smooths(df, {"z": F.col("z")}, {"x": F.col("x")}, F.col("y"))
    err = df.select(F.sqrt(F.avg(F.pow(irls.predictor(s.fit, s.columns) - 2 * F.sin("x") - 0.5 * F.col("z"), 2))).alias("e")).first().e
    assert err < 0.08 and s.edf < 12
    flat = smooth.fit_smooths(table(spark, x=x, y=0.5 * x + rng.normal(0, 1, 1500)), {}, {"x": F.col("x")}, F.col("y"))
    assert flat.edf < 5


def test_batch_densities_equal_column_densities(spark):
    df = table(spark, obs_id=range(5), y=[0, 1, 2, 3, 4], wobs=[1, 1, 2, 1, 3], offs=[0, 0.1, 0, 0, 0], x=[0.1, 0.5, 0.9, 1.1, 1.3])
    from lodestar.operators.solve import Fit

    fits = [Fit(0.1, {"x": 0.4}), Fit(0.2, {"x": 0.3})]
    cols = {"x": F.col("x")}
    for family, dis in ((families.gaussian(), [1.0, 2.0]), (families.poisson(), [1.0, 1.0]), (families.student_t(5.0), [1.0, 0.5])):
        a = {r.obs_id: r for r in evaluate.pointwise(df, cols, {3: (fits, [0.3, 0.7], dis)}, family).collect()}
        mu = evaluate.means(evaluate.predictors(fits, cols, F.col("offs")), family)
        for r in evaluate.summarize(df.withColumn("m", mu), "m", family, [0.3, 0.7], dis).collect():
            assert a[int(r.obs_id)].mu == pytest.approx(r.mu) and a[int(r.obs_id)].lppd == pytest.approx(r.lppd, abs=1e-9)


def test_log_gamma(spark):
    import math

    rows = spark.createDataFrame([(v,) for v in (0.1, 0.5, 1.0, 2.5, 10.0, 1000.0)], "x double")
    for r in rows.select("x", families.lgamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11)


def test_array_algebra(spark):
    row = spark.range(1).select(arrays.log_sum_exp(arrays.doubles([-1000.0, -1000.0])).alias("a"), arrays.differences(arrays.doubles([0.2, 0.7])).alias("b"), arrays.cumulative(arrays.doubles([0.2, 0.5, 0.3])).alias("c"), arrays.best_category(arrays.doubles([0.4, 0.4, 0.2]), ["x", "y", "z"]).alias("d"), arrays.log_weighted_mean_exp(arrays.doubles([0.0, 5.0]), arrays.doubles([1.0, 0.0])).alias("e")).first()
    assert row.a == pytest.approx(-1000 + np.log(2)) and row.b == pytest.approx([0.2, 0.5, 0.3]) and row.c == pytest.approx([0.2, 0.7]) and row.d == "x" and row.e == pytest.approx(0)


def test_formula_arithmetic(spark):
    df = table(spark, x=[1, 4], z=[-2, 3])
    x, names = design.Design().matrix(df, ["I(x^2 + z)", "poly(x, 2)", "sqrt(abs(z)^2)"], [])
    assert [tuple(r) for r in x.collect()] == [(-1.0, 1.0, 1.0, 2.0), (19.0, 4.0, 16.0, 3.0)]
    with pytest.raises(ValueError, match="missing values in x"):
        design.require_complete(spark.createDataFrame([(None, 1.0)], "x double, z double"), ["x", "z"])


def test_predictive_moments_and_seeds(spark):
    df = table(spark, obs_id=range(400), wobs=[1] * 400).withColumn("m", arrays.doubles([1.0, 3.0]))
    one = evaluate.sampled(df, "m", families.gaussian(), 50, 7, [0.1, 0.1], [0.25, 0.75])
    values = np.array([r.predicted for r in one.orderBy("obs_id").collect()])
    again = np.array([r.predicted for r in evaluate.sampled(df.repartition(7), "m", families.gaussian(), 50, 7, [0.1, 0.1], [0.25, 0.75]).orderBy("obs_id").collect()])
    assert np.array_equal(values, again) and values.mean() == pytest.approx(2.5, abs=0.05)


def test_hold_out_and_training_evaluation_agree(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    df = table(spark, obs_id=range(200), y=x @ [1, 0.2] + rng.normal(size=200), wobs=[1] * 200, offs=[0] * 200, a=x[:, 0], b=x[:, 1])
    cols = {c: F.col(c) for c in "ab"}
    ref = refmodel.gaussian_conjugate(df, cols, {c: [c] for c in cols}, draws=30)
    key = lambda s: {(r.size, r.obs_id): r.lppd for r in s.pointwise.collect()}
    one, two = key(selection.varsel(ref, prediction_draws=10)), key(selection.varsel(ref, prediction_draws=10, test=df))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one)
    assert selection.varsel(ref, prediction_draws=10).path.ranking == ["a", "b"]
    with pytest.raises(ValueError):
        selection.project(ref, ["nope"])


def test_leave_one_out_repeats_the_search(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 3))
    df = table(spark, obs_id=range(30), y=x @ [0.6, 0.3, 0.2] + rng.normal(size=30), wobs=[1] * 30, offs=rng.normal(size=30), a=x[:, 0], b=x[:, 1], c=x[:, 2]).withColumn("obs_id", F.col("obs_id").cast("long"))
    cols = {c: F.col(c) for c in "abc"}
    terms = {c: [c] for c in cols}
    ref = refmodel.gaussian_conjugate(df, cols, terms, draws=20)
    whole = selection.cv_loo(ref, clusters=3, prediction_draws=10, validate_search=True)
    got = {(r.obs_id, r.size): (r.mu, r.lppd) for r in whole.pointwise.filter("size IS NOT NULL").collect()}
    assert len(got) == 30 * 4
    for i in (0, 17):
        own = refmodel.gaussian_conjugate(df.filter(F.col("obs_id") != i), cols, terms, draws=20)
        rows = selection.varsel(own, clusters=3, prediction_draws=10, test=df.filter(F.col("obs_id") == i)).pointwise.filter("size IS NOT NULL").collect()
        for r in rows:
            assert got[i, r.size] == pytest.approx((r.mu, r.lppd), rel=1e-6)
    sums = {r["size"]: r for r in selection.cv_loo_subsampled(ref, 30, clusters=3, prediction_draws=10).collect()}
    for size, r in sums.items():
        assert r.y_hat == pytest.approx(sum(v[1] for (_, s), v in got.items() if s == size)) and r.v_y_hat == pytest.approx(0)
    want = {(r["size"], r.statistic): r for r in stats.statistics(whole.pointwise, baseline="ref").filter("size IS NOT NULL").collect()}
    for r in selection.cv_loo_subsampled_summary(ref, 30, delta=True, clusters=3, prediction_draws=10).collect():
        assert tuple(r)[2:] == pytest.approx(tuple(want[r["size"], r.statistic])[2:], rel=1e-6, abs=1e-9)
    part = {r["size"]: r for r in selection.cv_loo_subsampled_summary(ref, 12, ["elpd"], clusters=3, prediction_draws=10).collect()}
    for r in selection.cv_loo_subsampled(ref, 12, clusters=3, prediction_draws=10).collect():
        assert (part[r["size"]].value, part[r["size"]].se) == pytest.approx((r.y_hat, np.sqrt(r.v_y_hat + r.hat_v_y)))
    poisson = refmodel.from_draws(df, spark.createDataFrame([(i, [1.0]) for i in range(30)], "obs_id long, mu array<double>"), families.poisson(), cols, terms)
    for call in (lambda: selection.cv_loo(poisson, validate_search=True), lambda: selection.cv_loo_subsampled(poisson, 3)):
        with pytest.raises(ValueError, match="need a Gaussian reference model"):
            call()


def test_other_families_cluster_draws_and_project_single_ones(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=150)
    low, high = 1 / (1 + np.exp(1 - 0.5 * x)), 1 / (1 + np.exp(-1.5 - x))
    df = table(spark, obs_id=range(150), y=(rng.random(150) < low), wobs=[1] * 150, offs=[0] * 150, x=x, noise=rng.normal(size=150)).withColumn("obs_id", F.col("obs_id").cast("long"))
    shifts = rng.normal(size=10) * 0.01
    mus = np.array([(low if i % 5 else high) + s for i, s in enumerate(shifts)]).clip(0.001, 0.999)
    drawn = spark.createDataFrame([(i, mus[:, i].tolist()) for i in range(150)], "obs_id long, mu array<double>")
    cols = {c: F.col(c) for c in ("x", "noise")}
    ref = refmodel.from_draws(df, drawn, families.binomial(), cols, {c: [c] for c in cols})
    chosen = selection.varsel(ref, largest=1, clusters=2, prediction_draws=7)
    h = lambda p: -(p * np.log(p) + (1 - p) * np.log(1 - p))
    assert chosen.path.scores[0] == pytest.approx(0.2 * h(mus[::5].mean()) + 0.8 * h(np.delete(mus, [0, 5], axis=0).mean()), abs=1e-6)
    fits, weights, _ = chosen.by_size[1]
    single = irls.project(ref.data, cols, F.col("mu"), ref.family, [irls.Job(("x",), k) for k in (0, 9)], F.col("wobs"), F.col("offs"))
    assert len(fits) == 7 and sum(weights) == pytest.approx(1)
    assert [fits[0].beta["x"], fits[-1].beta["x"]] == pytest.approx([f.beta["x"] for f in single], rel=1e-5)
    along = selection.varsel(ref, "l1", prediction_draws=3)
    assert along.path.ranking == ["x", "noise"] and along.path.scores[2] <= along.path.scores[1] <= along.path.scores[0]
    with pytest.raises(ValueError, match="unknown search nonsense"):
        selection.varsel(ref, "nonsense")
    with pytest.raises(ValueError, match="no projection for the family student_t"):
        selection.varsel(refmodel.from_draws(df, drawn, families.student_t(5.0), cols, {c: [c] for c in cols}, [1.0] * 10))


def test_running_moments_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        table(spark, x=range(k * 5, k * 5 + 5)).write.mode("append").parquet(source)
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 2).parquet(source)
    running_moments(stream, {"x": F.col("x")}, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    r = total_moments(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (r.n, r.m1, r.m2) == (15, sum(range(15)), sum(i * i for i in range(15)))


@pytest.mark.parametrize("call", [lambda: options.check_search("l1", ["(1 | g)"]), lambda: options.check_search("best", ["x"]), lambda: options.check_folds("loo", 5, 10, True, True, True), lambda: options.check_folds("kfold", 1, 10, False, True, True), lambda: options.check_folds("kfold", 5, 10, False, False, False), lambda: options.check_stats(["auc"], "gaussian"), lambda: options.check_stats(["mse"], "binomial", "augmented"), lambda: options.check_stats(["foo"], "binomial"), lambda: families.student_t(3, "logit")])
def test_arguments_are_checked(call):
    with pytest.raises(ValueError):
        call()


def test_reduction_of_draws():
    assert [draws.reduction(10, *a) for a in ((None, None), (4, None), (40, None), (4, 3), (None, 10), (4, 99), (None, 1))] == [("draws", 10), ("draws", 4), ("draws", 10), ("clusters", 3), ("draws", 10), ("draws", 10), ("clusters", 1)]
    with pytest.raises(ValueError):
        draws.reduction(10, 0)


def test_new_levels_draw_effects_or_have_none(spark):
    df = table(spark, obs_id=range(3000)).withColumn("g", F.concat(F.lit("g"), F.col("obs_id").cast("int").cast("string")))
    known = spark.createDataFrame([("g1", 7.0)], "g string, effect double")
    plain = {r.g: r.effect for r in evaluate.group_effects(df, known, "g", "effect").collect()}
    assert plain["g1"] == 7.0 and set(plain.values()) == {0.0, 7.0}
    drawn = {r.g: r.effect for r in evaluate.group_effects(df, known, "g", "effect", sd=2.0).collect()}
    fresh = {r.g: r.effect for r in evaluate.group_effects(df.repartition(5), known, "g", "effect", sd=2.0, all_new=True).collect()}
    assert drawn["g1"] == 7.0 != fresh["g1"] and all(fresh[k] == v for k, v in drawn.items() if k != "g1")
    assert np.std(list(fresh.values())) == pytest.approx(2.0, rel=0.1) and abs(np.mean(list(fresh.values()))) < 0.2


def test_latent_responses_leave_the_observation_out(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    df = table(spark, obs_id=range(60), y=rng.random(60) < 1 / (1 + np.exp(-x)), wobs=[1] * 60, offs=[0] * 60, x=x).withColumn("obs_id", F.col("obs_id").cast("long"))
    ref = refmodel.glm_laplace(df, families.binomial(), {"x": F.col("x")}, {"x": ["x"]}, draws=60)
    on = latent.latent_model(ref)
    seen = {r.obs_id: r for r in on.data.collect()}
    for r in latent.leave_one_out_response(on, families.binomial()).collect():
        eta = np.array(seen[r.obs_id].mu)
        p = 1 / (1 + np.exp(-eta))
        lw, khat = loo.smoothed(-np.log(p if r.y_response else 1 - p)[None, :])
        assert r.y == pytest.approx(float((eta * np.exp(lw[0])).sum()), rel=1e-9) and r.khat == pytest.approx(khat[0])
        assert (r.y < seen[r.obs_id].y) == bool(r.y_response)
    out = latent.samples_on_response_scale(df, list(ref.fits), ref.weights, ref, families.binomial(), 200).collect()
    assert all(set(r.predicted) <= {0.0, 1.0} for r in out)
    assert np.mean([np.mean(r.predicted) for r in out]) == pytest.approx(np.mean([1 / (1 + np.exp(-np.array(seen[r.obs_id].mu))) for r in out]), abs=0.03)


def test_censored_rows_count_by_their_tail(spark):
    df = table(spark, obs_id=range(20), y=np.arange(20) % 2, wobs=[1] * 20, offs=[0] * 20, x=np.linspace(-1, 1, 20)).withColumn("obs_id", F.col("obs_id").cast("long"))
    ref = refmodel.glm_laplace(df, families.binomial(), {"x": F.col("x")}, {"x": ["x"]}, draws=10)
    on = latent.latent_model(ref).data
    tail = lambda y, m, w: F.log(m)
    plain = {r.obs_id: r for r in latent.on_response_scale(on, list(ref.fits), ref.weights, ref, families.binomial()).collect()}
    for r in latent.on_response_scale(on, list(ref.fits), ref.weights, ref, families.binomial(), censored=F.col("obs_id") < 5, log_tail=tail).collect():
        assert r.mu == plain[r.obs_id].mu
        assert r.lppd == pytest.approx(np.log(r.mu) if r.obs_id < 5 else plain[r.obs_id].lppd)
    with pytest.raises(ValueError):
        latent.on_response_scale(on, list(ref.fits), ref.weights, ref, families.binomial(), censored=F.col("obs_id") < 5)


def test_poor_shapes_warn(spark):
    df = table(spark, khat=[0.1, 0.9, 0.2])
    with pytest.warns(UserWarning, match="1 of 3"):
        assert loo.poor_shapes(df, "khat", 1000) == 1


def test_a_search_is_used_again_and_projected(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=80), rng.normal(size=80)
    df = table(spark, obs_id=range(80), y=2 * a + 0.2 * b + rng.normal(size=80) * 0.1, wobs=[1] * 80, offs=[0] * 80, a=a, b=b).withColumn("obs_id", F.col("obs_id").cast("long"))
    cols = {c: F.col(c) for c in "ab"}
    ref = refmodel.gaussian_conjugate(df, cols, {c: [c] for c in cols}, draws=20)
    first = selection.varsel(ref, prediction_draws=5)
    again = selection.varsel(ref, prediction_draws=5, path=first.path)
    assert again.path is first.path and sorted(first.pointwise.collect(), key=repr) == sorted(again.pointwise.collect(), key=repr)
    p = first.project(1, n_draws=5)
    assert p.terms == ["a"] and {r.obs_id: r.lpd for r in p.lpd(df).collect()} == pytest.approx({r.obs_id: r.lppd for r in first.pointwise.filter("size = 1").collect()})
    with pytest.raises(ValueError, match="binomial"):
        first.summary(["auc"])
    first.release()
