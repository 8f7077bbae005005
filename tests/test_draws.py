"""Reference models of a user's own posterior draws give what the same draws give by their coefficients."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import crossval, evaluate
from lodestar.operators.draws import draw_gram
from lodestar.operators.gram import INTERCEPT, combined, draw_moments
from lodestar.plans import selection
from lodestar.sources import refmodel
from tests.test_extensions import table


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3)) + [0, 1000, 0]
    y = x @ [0.9, 0.4, 0.1] + rng.normal(size=120)
    df = table(spark, obs_id=range(120), y=y, wobs=rng.integers(1, 4, 120), offs=rng.normal(size=120), a=x[:, 0], b=x[:, 1], c=x[:, 2]).withColumn("obs_id", F.col("obs_id").cast("long")).persist()
    cols = {c: F.col(c) for c in "abc"}
    known = refmodel.gaussian_conjugate(df, cols, {c: [c] for c in cols}, draws=30)
    drawn = refmodel.from_draws(df, known.data.select("obs_id", "mu"), families.gaussian(), cols, known.terms, known.dis, predict=lambda rows: known.on(rows).data)
    return df, cols, known, drawn


def rows_of(chosen):
    return {(r["size"], r.obs_id): (r.mu, r.lppd) for r in chosen.pointwise.collect()}


def agree(one, two, tolerance=1e-6):
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], rel=tolerance, abs=tolerance) for k in one)


def test_moments_are_those_of_dense_algebra(spark, model):
    df, cols, known, _ = model
    rows = known.data.orderBy("obs_id").collect()
    w = np.array([r.wobs for r in rows])
    z = np.column_stack([np.ones(120), *[[r[c] for r in rows] for c in "abc"], np.array([r.mu for r in rows])])
    g = draw_moments(known.data.repartition(4), cols, F.col("mu"), 30, F.col("wobs"))[0]
    assert g.part(list(g.names), list(g.names)) == pytest.approx((z * w[:, None]).T @ z, rel=1e-9)
    parts = draw_moments(known.data.withColumn("fold", F.col("obs_id") % 3), cols, F.col("mu"), 30, F.col("wobs"), F.col("fold"))
    assert sorted(parts) == [0, 1, 2] and sum(p.rows for p in parts.values()) == 120
    assert sum(p.matrix for p in parts.values()) == pytest.approx(g.matrix, rel=1e-9, abs=1e-6)
    means = combined(g, {"m": {"_m1": 0.25, "_m2": 0.75}})
    assert means.part([INTERCEPT, "m"], ["m"]) == pytest.approx(np.array([[w @ (z[:, 4:6] @ [0.25, 0.75])], [w @ (z[:, 4:6] @ [0.25, 0.75]) ** 2]]), rel=1e-9)
    assert draw_gram(known.data, "mu", 30) == pytest.approx(z[:, 4:].T @ z[:, 4:], rel=1e-9)


@pytest.mark.parametrize("method", ["forward", "l1"])
def test_search_and_projections(model, method):
    _, _, known, drawn = model
    one, two = (selection.varsel(m, method, clusters=4, prediction_draws=12) for m in (known, drawn))
    assert one.path.ranking == two.path.ranking and one.path.scores == pytest.approx(two.path.scores, rel=1e-6)
    agree(rows_of(one), rows_of(two))
    for size, (fits, weights, dis) in one.by_size.items():
        other = two.by_size[size]
        assert weights == other[1] and dis == pytest.approx(other[2], rel=1e-6)
        assert [dict(f.table()) for f in fits] == [pytest.approx(dict(f.table()), rel=1e-5, abs=1e-6) for f in other[0]]
    p, q = (selection.project(m, ["a", "c"], 7) for m in (known, drawn))
    assert p.dis == pytest.approx(q.dis, rel=1e-6)
    assert {r["size"]: r.elpd for r in one.summary(["elpd"]).collect()} == pytest.approx({r["size"]: r.elpd for r in two.summary(["elpd"]).collect()}, rel=1e-6)


def test_leave_one_out_and_new_rows(model):
    df, _, known, drawn = model
    one, two = (rows_of(selection.cv_loo(m, clusters=4, prediction_draws=30)) for m in (known, drawn))
    agree(one, two, 1e-5)
    agree(rows_of(selection.varsel(known, prediction_draws=5, test=df)), rows_of(selection.varsel(drawn, prediction_draws=5, test=df)))
    for kind in ("response", "link", "lpd"):
        assert {r.obs_id: r.pred for r in selection.predict(known, df, kind).collect()} == pytest.approx({r.obs_id: r.pred for r in selection.predict(drawn, df, kind).collect()}, rel=1e-9)


def test_refits_by_fold(spark, model):
    df, cols, known, drawn = model
    folded = crossval.balanced_folds(df, "obs_id", 3, 0)
    whole = selection.cv_kfold(known, k=3, clusters=3, prediction_draws=30, folded=folded)
    refits, dis = None, {}
    for fold in (1, 2, 3):
        own = refmodel.gaussian_conjugate(folded.filter(F.col("fold") != fold), cols, known.terms, draws=30, seed=fold)
        mu = evaluate.predictors(list(own.fits), cols, F.col("offs"))
        part = df.select(F.lit(fold).alias("fold"), "obs_id", mu.alias("mu"))
        refits, dis[fold] = part if refits is None else refits.unionByName(part), own.dis
    mine = selection.cv_kfold(drawn, k=3, clusters=3, prediction_draws=30, folded=folded, refits=refits, refit_dis=dis)
    assert mine.fold_rankings == whole.fold_rankings
    agree(rows_of(mine), rows_of(whole), 1e-5)
    with pytest.raises(ValueError, match="give refits"):
        selection.cv_kfold(drawn, k=3)
    with pytest.raises(ValueError, match="its dispersion"):
        selection.cv_kfold(drawn, k=3, folded=folded, refits=refits, refit_dis={1: dis[1]})


def test_refits_of_other_families(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=90)
    df = table(spark, obs_id=range(90), y=rng.random(90) < 1 / (1 + np.exp(-x)), wobs=[1] * 90, offs=[0] * 90, x=x, z=rng.normal(size=90), fold=np.arange(90) % 3 + 1).withColumns({"obs_id": F.col("obs_id").cast("long"), "fold": F.col("fold").cast("int")})
    cols = {c: F.col(c) for c in "xz"}
    mu = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda s: 1 / (1 + F.exp(-(1 + (s - 3.5) / 20) * F.col("x"))))
    drawn = refmodel.from_draws(df, df.select("obs_id", mu.alias("mu")), families.binomial(), cols, {c: [c] for c in cols})
    refits = df.select("obs_id", mu.alias("mu")).crossJoin(spark.createDataFrame([(1,), (2,), (3,)], "fold int"))
    got = selection.cv_kfold(drawn, k=3, clusters=2, folded=df, refits=refits, largest=1)
    assert [r[0] for f, r in got.fold_rankings.items()] == ["x"] * 4
    assert got.pointwise.filter("size IS NULL").count() == 90


def test_what_draws_lack_is_an_error(spark, model):
    df, cols, known, _ = model
    plain = refmodel.from_draws(df, known.data.select("obs_id", "mu"), families.gaussian(), cols, known.terms, known.dis)
    with pytest.raises(ValueError, match="without a function"):
        selection.varsel(plain, prediction_draws=5, test=df)
    with pytest.raises(ValueError, match="its dispersion"):
        refmodel.from_draws(df, known.data.select("obs_id", "mu"), families.gaussian(), cols, known.terms)
    with pytest.raises(ValueError, match="at least one draw"):
        refmodel.from_draws(df, known.data.select("obs_id", "mu").limit(0), families.gaussian(), cols, known.terms, [])


@pytest.mark.parametrize("method", ["forward", "l1"])
def test_searches_without_each_observation_by_weights(spark, model, method):
    """Re-weighted clusters follow the definition, and agree with refitted searches within Monte Carlo error."""
    from lodestar.operators import draws, loo, search, solve

    df, _, known, drawn = model
    got = selection.cv_loo(drawn, method, clusters=3, prediction_draws=30, validate_search="weights", warn_shape=False)
    same = selection.cv_loo(known, method, clusters=3, prediction_draws=30, validate_search="weights", warn_shape=False)
    agree(rows_of(got), rows_of(same), 1e-5)
    assert got.rankings.count() == 120 * 3 and {r["size"] for r in got.proportions().collect()} == {1, 2, 3}
    rows = {r.obs_id: r for r in known.data.collect()}
    g = selection.with_targets(selection._moments(known), list(known.fits), [f"_m{i + 1}" for i in range(30)])
    labels = draws.kmeans(g.centered([f"_m{i + 1}" for i in range(30)], [f"_m{i + 1}" for i in range(30)]), 3 if method == "forward" else 1)
    values = rows_of(got)
    for i in (3, 77):
        r, dis = rows[i], np.array(known.dis)
        lw = loo.smoothed(-families.gaussian().np_log_lik(np.array([[r.y]]), np.array([r.mu]), np.array([[r.wobs]]), dis))[0][0]
        weights = np.exp(lw)
        centers = {}
        for k in range(max(labels) + 1):
            own = np.where(np.array(labels) == k, weights, 0)
            centers[f"_c{k}"] = {f"_m{s + 1}": float(v) for s, v in enumerate(own / own.sum())}, float(own.sum())
        found = combined(g, {c: v for c, (v, _) in centers.items()})
        path = search.l1(found, known.terms, "_c0") if method == "l1" else search.forward(found, known.terms, "_c0", weights={c: s for c, (_, s) in centers.items()})
        fits = [solve.ridge(g, path.ranking[:2], f"_m{s + 1}") for s in range(30)]
        q = np.array([f.intercept + sum(b * r[c] for c, b in f.beta.items()) + r.offs for f in fits])
        assert values[2, i][0] == pytest.approx(float(q @ weights), rel=1e-6)
    if method == "forward":
        big = refmodel.gaussian_conjugate(df, known.columns, known.terms, draws=400)
        one, two = (selection.cv_loo(big, clusters=3, prediction_draws=100, validate_search=v, warn_shape=False).summary(["elpd"]).collect() for v in ("weights", True))
        for a, b in zip(sorted(one, key=lambda r: r["size"]), sorted(two, key=lambda r: r["size"]), strict=True):
            assert a.elpd == pytest.approx(b.elpd, abs=4)


def test_poor_weights_warn_and_paths_are_used_again(spark, model):
    df, cols, known, _ = model
    first = selection.varsel(known, clusters=3, prediction_draws=10)
    again = selection.cv_loo(known, path=first.path, prediction_draws=10, warn_shape=False)
    assert again.path is first.path
    far = df.withColumn("y", F.when(F.col("obs_id") == 5, 1e4).otherwise(F.col("y")))
    spiked = refmodel.from_draws(far, known.data.select("obs_id", "mu"), families.gaussian(), cols, known.terms, known.dis)
    with pytest.warns(UserWarning, match="Pareto shape"):
        selection.cv_loo(spiked, prediction_draws=10)
    with pytest.raises(ValueError, match="unknown way"):
        selection.cv_loo(known, validate_search="maybe")


def test_projections_of_clusters(spark, model):
    df, cols, known, drawn = model
    rows = known.data.orderBy("obs_id").collect()
    w = np.array([r.wobs for r in rows])
    mu = np.array([r.mu for r in rows]) - np.array([[r.offs] for r in rows])
    for ref in (known, drawn):
        p = selection.project(ref, ["a", "b"], clusters=1)
        center = mu.mean(axis=1)
        x = np.column_stack([np.ones(120), *[[r[c] for r in rows] for c in "ab"]])
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ center)
        assert [p.fits[0].intercept, *p.fits[0].beta.values()] == pytest.approx(beta.tolist(), rel=1e-3)
        var = np.mean(np.array(known.dis) ** 2) + mu.var(axis=1)
        assert p.dis[0] == pytest.approx(np.sqrt(np.average(var + (center - x @ beta) ** 2, weights=w)), rel=1e-4)
        assert p.weights == [1.0]
        assert len(selection.project(ref, ["a"], clusters=4).fits) == 4 and len(selection.project(ref, ["a"], clusters=99).fits) == 30
