"""Latent searches on both scales."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import families
from lodestar.operators import latent as latent_operators
from lodestar.operators import loo
from lodestar.plans import latent
from lodestar.sources import refmodel
from tests.test_extensions import table


def test_both_scales(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=80)
    df = table(spark, obs_id=range(80), y=rng.random(80) < 1 / (1 + np.exp(-1.5 * x)), wobs=[1] * 80, offs=[0] * 80, x=x, z=rng.normal(size=80)).withColumn("obs_id", F.col("obs_id").cast("long"))
    cols = {c: F.col(c) for c in "xz"}
    ref = refmodel.glm_laplace(df, families.binomial(), cols, {c: [c] for c in cols}, draws=30)
    drawn = refmodel.from_draws(df, ref.data.select("obs_id", "mu"), families.binomial(), cols, ref.terms)
    one, two = (latent.varsel(r, clusters=3, prediction_draws=30) for r in (ref, drawn))
    assert one.path.ranking == two.path.ranking == ["x", "z"]
    a, b = ({r["size"]: r for r in s.summary(["elpd", "acc", "auc"]).collect()} for s in (one, two))
    for size in a:
        assert (a[size].elpd, a[size].acc, a[size].auc) == pytest.approx((b[size].elpd, b[size].acc, b[size].auc), rel=1e-5)
    on = latent_operators.latent_model(ref)
    fits, weights, _ = one.latent.by_size[1]
    want = {r.obs_id: (r.mu, r.lppd) for r in latent_operators.on_response_scale(on.data, fits, weights, ref, ref.family).collect()}
    got = {r.obs_id: (r.mu, r.lppd) for r in one.response.pointwise.filter("size = 1").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)
    assert "rmse" in one.summary(["rmse"], response_scale=False).columns
    left, right = (latent.cv_loo(r, clusters=3, prediction_draws=30) for r in (ref, drawn))
    values = {(r["size"], r.obs_id): (r.mu, r.lppd) for r in left.response.pointwise.collect()}
    for r in right.response.pointwise.collect():
        assert values[r["size"], r.obs_id] == pytest.approx((r.mu, r.lppd), rel=1e-4)
    row = drawn.data.filter("obs_id = 4").first()
    mu = np.array(row.mu)
    ll = np.log(mu if row.y else 1 - mu)
    lw = loo.smoothed(-ll[None, :])[0][0]
    assert values[None, 4] == pytest.approx((float(mu @ np.exp(lw)), float(np.log(np.exp(ll + lw).sum()))), rel=1e-6)
    seen = {r.obs_id: r.y for r in on.data.collect()}
    out = {r.obs_id: r.y for r in left.latent.pointwise.filter("size = 0").collect()}
    assert out.keys() == seen.keys() and any(abs(out[k] - seen[k]) > 1e-4 for k in out)
