import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import crossval, gram, keyed, post, stats

#: An AUC example with ties, and its weighted variant.
Y = [i % 2 for i in range(19)]
PRED = [0.3, 0.8] * 6 + [0.3] + [0.3, 0.8] * 2 + [0.3, 0.8]
WEIGHTS = [1, 2, 1, 2, 1, 2, 1, 2, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 1]


@pytest.mark.parametrize(("weights", "expected"), [([1] * 19, 0.68333333333333333), (WEIGHTS, 0.717948717948718)])
def test_auc_golden(spark, weights, expected):
    rows = spark.createDataFrame([(float(a), b, float(w)) for a, b, w in zip(Y, PRED, weights, strict=True)], "y double, mu double, wobs double")
    assert stats.auc(rows, []).first().auc == pytest.approx(expected, abs=1e-14)


def test_auc_is_null_with_missing_or_one_class(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.2, 1.0), (1, None, 0.3, 1.0), (2, 1.0, 0.4, 1.0), (2, 1.0, 0.5, 1.0)], "g int, y double, mu double, wobs double")
    assert all(r.auc is None for r in stats.auc(rows, ["g"]).collect())


def test_weighted_sd_missing_and_single(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0), ("b", 1.0, 1.0), ("c", None, 1.0), ("c", 2.0, 1.0)], "g string, x double, w double")
    out = {r.g: r.wsd for r in stats.weighted_sd(rows, ["g"], "x", "w").collect()}
    m = 5 / 3
    assert out["a"] == pytest.approx(math.sqrt(2 * (2 / 3 * (1 - m) ** 2 + 1 / 3 * (3 - m) ** 2)))
    assert out["b"] is None and out["c"] is None


def test_difference_estimator_is_exact_for_a_census(spark):
    rows = spark.range(1, 1001).select((F.col("id") + 0.1 * F.sin("id")).alias("a"), F.col("id").cast("double").alias("y"), F.lit(True).alias("m"))
    r = stats.difference_estimate(rows, "a", "y", "m").first()
    assert r.y_hat == pytest.approx(500500) and r.v_y_hat == pytest.approx(0, abs=1e-6)


def test_difference_estimator_covers(spark):
    rng = np.random.default_rng(0)
    y = np.arange(1, 201.0)
    hits, means = 0, []
    for rep in range(12):
        a, m = y + rng.normal(0, 5, 200), np.zeros(200, bool)
        m[rng.choice(200, 60, replace=False)] = True
        r = stats.difference_estimate(spark.createDataFrame([(float(p), float(q), bool(s)) for p, q, s in zip(a, y, m, strict=True)], "a double, y double, m boolean"), "a", "y", "m").first()
        means.append(r.y_hat)
        hits += abs(r.y_hat - y.sum()) < 2.6 * math.sqrt(r.v_y_hat)
    assert hits >= 11 and np.mean(means) == pytest.approx(y.sum(), rel=0.01)


def test_subsampled_statistics_of_odd_tables(spark):
    """All rows sampled gives the plain statistics; none, one, missing values and empty tables have null or no rows."""
    schema = "size int, obs_id long, y double, wobs double, mu double, lppd double, mu_fast double, lppd_fast double, sampled boolean"
    one = [(1, i, float(i % 2), 1.0 + i % 3, 0.1 * i, -0.2 * i, 0.3, -1.0, True) for i in range(8)]
    none = [(2, *r[1:8], None) for r in one]
    single = [(3, *r[1:8], r[1] == 4) for r in one]
    missing = [(4, *r[1:5], None, *r[6:8], r[1] < 5) for r in one]
    df = spark.createDataFrame(one + none + single + missing, schema)
    got = {(r["size"], r.statistic): r for r in stats.subsampled_statistics(df).collect()}
    for r in stats.statistics(df.filter("size = 1")).collect():
        assert tuple(got[1, r.statistic])[2:] == pytest.approx(tuple(r)[2:])
    for s in stats.MOMENT_STATS:
        assert got[2, s].value is None and got[3, s].value is not None and got[3, s].se is None
        assert (got[4, s].value is None) == (s in ("elpd", "mlpd", "gmpd"))
    assert stats.subsampled_statistics(df.filter("false")).count() == 0
    with pytest.raises(ValueError, match="AUC"):
        stats.subsampled_statistics(df, ["auc"])


def test_missing_density_makes_the_statistic_null(spark):
    rows = spark.createDataFrame([(1, i, 1.0, 1.0, 0.5, None if i == 3 else -1.0) for i in range(5)], "size int, obs_id long, y double, wobs double, mu double, lppd double")
    r = stats.statistics(rows, ["elpd", "mse"]).collect()
    assert {x.statistic: x.value is None for x in r} == {"elpd": True, "mse": False}


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 40
    y, w = rng.normal(size=n), rng.integers(1, 4, n).astype(float)
    mu = {None: y + rng.normal(0, 0.3, n), 1: y + rng.normal(0, 0.5, n)}
    rows = [(s, i, float(y[i]), float(w[i]), float(m[i]), float(-((y[i] - m[i]) ** 2))) for s, m in mu.items() for i in range(n)]
    df = spark.createDataFrame(rows, "size int, obs_id long, y double, wobs double, mu double, lppd double")
    got = {r.statistic: r for r in stats.statistics(df, ["elpd", "mse", "rmse", "R2"], "ref").filter("size = 1").collect()}
    e, b = (mu[1] - y) ** 2, (mu[None] - y) ** 2
    share = w / w.sum()
    em, bm = share @ e, share @ b
    d = -e + b
    assert got["elpd"].value == pytest.approx(d.sum()) and got["elpd"].se == pytest.approx(d.std(ddof=1) * math.sqrt(n))
    var = lambda u, m: n / (n - 1) * (share @ (u - m) ** 2) / n
    cov = share @ ((e - em) * (b - bm)) / (n - 1)
    assert got["mse"].value == pytest.approx(em - bm)
    assert got["mse"].se == pytest.approx(math.sqrt(var(e, em) - 2 * cov + var(b, bm)))
    assert got["rmse"].value == pytest.approx(math.sqrt(em) - math.sqrt(bm))
    assert got["R2"].value == pytest.approx((bm - em) / (share @ (y - share @ y) ** 2))


def test_partitioning_does_not_matter(spark):
    from lodestar.sources import tables

    items = tables.line_items(spark, "/root/testdata/sf0.001")
    cols = {c: F.col(c) for c in ("price", "tax")}
    a, b = gram.gram(items.repartition(1), cols), gram.gram(items.repartition(7), cols)
    assert np.allclose(a.matrix, b.matrix)


def test_wide_moments_equal_sql_moments(spark):
    from lodestar.sources import tables

    items = tables.line_items(spark, "/root/testdata/sf0.001")
    cols = {f"c{i}": F.col("price") * (i + 1) + F.col("tax") for i in range(30)}
    wide = gram.gram(items, cols)
    narrow = gram.gram(items, {c: cols[c] for c in ("c0", "c29")})
    assert np.allclose(wide.part(["c0", "c29"], ["c0", "c29"]), narrow.part(["c0", "c29"], ["c0", "c29"]))


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = {r.k: r.fold for r in crossval.balanced_folds(df, "k", 5, 3).collect()}
    b = {r.k: r.fold for r in crossval.balanced_folds(df.repartition(9), "k", 5, 3).collect()}
    assert a == b
    sizes = [list(a.values()).count(f) for f in range(1, 6)]
    assert max(sizes) - min(sizes) <= 1


def test_global_rank_and_prefix_sums(spark):
    df = spark.range(500).select(F.col("id").alias("k"), keyed.keyed(F.col("id")).alias("h"))
    ranked = keyed.rank_by_hash(df, "r", "h", "k").orderBy("h", "k").collect()
    assert [r.r for r in ranked] == list(range(1, 501))
    sums = keyed.prefix_sums(df.withColumn("one", F.lit(1)), "k", ["one"]).collect()
    assert all(r.before_one == 499 - r.k for r in sums)


def test_suggest_size_rules(spark):
    rows = [(0, "elpd", -50.0, 5.0, -55.0, -45.0), (1, "elpd", -8.0, 3.0, -11.0, -5.0), (2, "elpd", -1.0, 2.0, -3.0, 1.0)]
    df = spark.createDataFrame(rows, "size int, statistic string, value double, se double, lq double, uq double")
    one = lambda **k: post.suggest_size(df, "elpd", 2, **k).first().suggested_size
    assert one() == 2 and one(pct=0.2) == 1 and one(kind="lower") == 2 and one(thres_elpd=-10.0) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "size int, obs_id long, y double, wobs double, mu double, lppd double")
    assert stats.statistics(df).count() == 0
    assert stats.auc(df, ["size"]).count() == 0


def test_bootstrap_draws_without_cross_join(spark):
    rows = spark.range(50).select(F.col("id").alias("slot"), (F.col("id") * 2).alias("v"))
    got = stats.bootstrap_rows(rows, 50, "slot", 6, 3)
    once = lambda k: ((k * 1664525 + 1013904223 + 3 * 69069) % (1 << 32) * 1664525 + 1013904223) % (1 << 32)
    assert sorted((r.replicate, r.slot, r.v) for r in got.collect()) == sorted((k, d, 2 * d) for k in range(6) for d in (once(k * 50 + i) % 50 for i in range(50)))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "broadcast" not in plan


def auc_by_pairs(y, n, mu):
    """Of all pairs of a failure and a success, those in order, ties half."""
    w1, w0 = np.asarray(y, float), np.asarray(n, float) - y
    above = (mu[:, None] < mu[None, :]) + (mu[:, None] == mu[None, :]) / 2
    return float(w0 @ above @ w1 / (w0.sum() * w1.sum()))


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_auc_over_ranges_is_that_of_all_pairs(spark, partitions):
    """Many equal predictions fall into several ranges; trials count as so many rows."""
    rng = np.random.default_rng(4)
    n = rng.integers(1, 5, 600)
    y = rng.binomial(n, 0.4)
    scores = {None: rng.normal(size=600), 0: np.zeros(600), 1: np.round(rng.normal(size=600), 1), 2: np.where(rng.random(600) < 0.7, 0.5, rng.random(600))}
    rows = spark.createDataFrame([(s, i, float(y[i]), float(mu[i]), float(n[i])) for s, mu in scores.items() for i in range(600)], "size int, obs_id long, y double, mu double, wobs double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["size"]: r.auc for r in stats.auc_replicates(rows, 30, 1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found.keys() == scores.keys()
    for s, mu in scores.items():
        assert found[s][0] == pytest.approx(auc_by_pairs(y, n, mu), rel=1e-12) and len(found[s]) == 31
    assert np.std(found[0]) == 0


def test_auc_bootstrap_spread_is_that_of_resampling(spark):
    rng = np.random.default_rng(6)
    y = (rng.random(400) < 0.5).astype(float)
    mu = y + rng.normal(size=400) * 2
    rows = spark.createDataFrame([(1, i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(y, mu, strict=True))], "size int, obs_id long, y double, mu double, wobs double")
    drawn = []
    for _ in range(400):
        at = rng.integers(400, size=400)
        drawn.append(auc_by_pairs(y[at], np.ones(400), mu[at]))
    r = stats.auc_statistics(rows, replicates=400).first()
    assert r.se == pytest.approx(np.std(drawn), rel=0.2)
    assert (r.lq, r.uq) == pytest.approx(np.quantile(drawn, [stats.ALPHA / 2, 1 - stats.ALPHA / 2]), abs=0.01)


def test_auc_without_both_classes_or_with_missing_inputs_is_null(spark):
    schema = "size int, obs_id long, y double, mu double, wobs double"
    one = spark.createDataFrame([(1, 1, 1.0, 0.2, 1.0), (1, 2, 1.0, 0.4, 1.0)], schema)
    gap = spark.createDataFrame([(1, 1, 1.0, None, 1.0), (1, 2, 0.0, 0.4, 1.0)], schema)
    for rows in (one, gap):
        assert [tuple(r) for r in stats.auc_statistics(rows, replicates=5).collect()] == [(1, "auc", None, None, None, None)]
    assert stats.auc_statistics(one.limit(0), replicates=5).count() == 0
    with pytest.raises(Exception, match="trials"):
        stats.auc_statistics(one.withColumn("wobs", one.wobs * 1000), replicates=5).collect()


def test_auc_in_summaries(spark):
    from lodestar.functions import families
    from lodestar.plans import selection
    from lodestar.sources import refmodel
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    x = rng.normal(size=120)
    df = spark.createDataFrame([(i, float(rng.random() < 1 / (1 + np.exp(-1.5 * v))), 1.0, 0.0, float(v), float(rng.normal())) for i, v in enumerate(x)], "obs_id long, y double, wobs double, offs double, x double, z double")
    cols = {c: F.col(c) for c in "xz"}
    chosen = selection.varsel(refmodel.glm_laplace(df, families.binomial(), cols, {c: [c] for c in cols}, draws=10), clusters=2, prediction_draws=5)
    table = {r["size"]: r for r in chosen.summary(["auc", "elpd"]).collect()}
    assert table[0].auc == 0.5 and table[1].auc > 0.7 and table[1].auc_se > 0 and table[1].auc_lower < table[1].auc < table[1].auc_upper
    assert table[0].auc_diff < 0 and table[2].auc_diff == pytest.approx(0, abs=0.02)
    assert chosen.suggested("auc").first().suggested_size in (1, 2)
    assert [r.statistic for r in chosen.reference(["auc"]).collect()] == ["auc"]


@pytest.mark.parametrize("replicates", [1, 7])
def test_bootstrap_auc_is_one_sweep(spark, monkeypatch, replicates):
    """The AUC of each resample, without a row for each replicate; odd rows spoil only the replicates that took them."""
    rng = np.random.default_rng(4)
    n = 60
    y, mu = (rng.random(n) < 0.4).astype(float).tolist(), np.round(rng.random(n), 1).tolist()
    y[7], mu[11], mu[12] = None, None, float("nan")
    rows = spark.createDataFrame([(i, y[i], mu[i], 1.0 + i % 3) for i in range(n)], "slot long, y double, mu double, wobs double")
    slow = stats.auc(stats.bootstrap_rows(rows, n, "slot", replicates, 3), ["replicate"]).agg(F.stddev_samp("auc").alias("se"), F.percentile("auc", F.lit(0.2)).alias("lq"), F.percentile("auc", F.lit(0.8)).alias("uq")).first()

    def refused(*_, **__):
        raise AssertionError("rows were multiplied")

    monkeypatch.setattr(stats, "bootstrap_rows", refused)
    monkeypatch.setattr(stats, "DRAWN_TOGETHER", 4 * replicates)  # several blocks
    got = stats.bootstrap_auc(rows, n, "slot", replicates, 3, 0.4).first()
    assert [v if v is None else round(v, 12) for v in got] == [v if v is None else round(v, 12) for v in slow]
