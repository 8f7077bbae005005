"""Queries on mixed models, categories, smooths and latent projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalog.registry import query, shown
from lodestar.functions import families
from lodestar.operators import categories, latent, multilevel, search, smooth, solve
from lodestar.operators.gram import gram, moments
from lodestar.plans import categorical, selection
from lodestar.plans import latent as latent_plan
from lodestar.sources import refmodel, tables
from lodestar.streaming.moments import total_moments

RATIO = 0.5
CUSTOMERS = "c AS (SELECT c_nationkey AS g, (c_custkey % 17) / 10 AS x, c_acctbal / 1000 + (c_nationkey % 5) AS y FROM customer)"


def _customers(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("g"), ((F.col("c_custkey") % 17) / 10).alias("x"), (F.col("c_acctbal") / 1000 + F.col("c_nationkey") % 5).alias("y"))


@query(f"""WITH {CUSTOMERS}, s AS (SELECT g, count(*) AS w, sum(x) AS sx, sum(y) AS sy FROM c GROUP BY g), k AS (SELECT sum({RATIO} / (1 + {RATIO} * w) * w * w) AS oo, sum({RATIO} / (1 + {RATIO} * w) * w * sx) AS ox, sum({RATIO} / (1 + {RATIO} * w) * sx * sx) AS xx, sum({RATIO} / (1 + {RATIO} * w) * w * sy) AS oy, sum({RATIO} / (1 + {RATIO} * w) * sx * sy) AS xy FROM s),
m AS (SELECT count(*) - any_value(oo) AS a, sum(x) - any_value(ox) AS b, sum(x * x) - any_value(xx) AS d, sum(y) - any_value(oy) AS e, sum(x * y) - any_value(xy) AS f FROM c, k), beta AS (SELECT (e * d - f * b) / (a * d - b * b) AS b0, (f * a - e * b) / (a * d - b * b) AS b1 FROM m)
SELECT g, round({RATIO} / (1 + {RATIO} * w) * (sy - b0 * w - b1 * sx), 6) AS effect, round(b0, 6) AS intercept, round(b1, 6) AS slope FROM s, beta""")
def random_intercept_effects(spark, sf_dir):
    f = multilevel.random_intercept(_customers(spark, sf_dir), {"x": F.col("x")}, F.col("y"), "g", ratios=(RATIO,))
    return f.effects.select("g", shown("effect").alias("effect"), shown(F.lit(f.fixed.intercept)).alias("intercept"), shown(F.lit(f.fixed.beta["x"])).alias("slope"))


def _reml_sql() -> str:
    """Restricted likelihood on a grid of variance ratios, then on a finer one around the best."""
    shrunk = lambda u, v: f"sum(r / (1 + r * w) * {u} * {v})"

    def scored(k: int) -> str:
        return f"""v{k} AS (SELECT r, sum(ln(1 + r * w)) AS logs, any_value(n) AS n, any_value(n) - {shrunk("w", "w")} AS a, any_value(tx) - {shrunk("w", "sx")} AS b, any_value(txx) - {shrunk("sx", "sx")} AS d,
  any_value(ty) - {shrunk("w", "sy")} AS e, any_value(txy) - {shrunk("sx", "sy")} AS f, any_value(tyy) - {shrunk("sy", "sy")} AS q FROM s, t, g{k} GROUP BY r),
o{k} AS (SELECT *, (e * d - f * b) / (a * d - b * b) AS b0, (f * a - e * b) / (a * d - b * b) AS b1 FROM v{k}), p{k} AS (SELECT *, q - e * b0 - f * b1 AS rest FROM o{k}),
best{k} AS (SELECT * FROM p{k} ORDER BY logs + ln(a * d - b * b) + (n - 2) * ln(rest / (n - 2)) LIMIT 1)"""

    return f"""WITH {CUSTOMERS}, s AS (SELECT g, count(*) AS w, sum(x) AS sx, sum(y) AS sy FROM c GROUP BY g), t AS (SELECT count(*) AS n, sum(x) AS tx, sum(x * x) AS txx, sum(y) AS ty, sum(x * y) AS txy, sum(y * y) AS tyy FROM c),
g1 AS (SELECT 1e-4 * power(10, 7 * i / 56) AS r FROM range(57) u(i)), {scored(1)}, g2 AS (SELECT r * power(10, 0.0125 * i) AS r FROM best1, range(-10, 11) u(i)), {scored(2)}
SELECT unnest(['(Intercept)', 'x', 'sigma', 'ratio']) AS term, unnest([round(b0, 5), round(b1, 5), round(sqrt(rest / (n - 2)), 5), round(r, 5)]) AS value FROM best2"""


@query(_reml_sql())
def random_intercept_reml(spark, sf_dir):
    """The variance ratio by restricted likelihood, with fixed effects and deviations."""
    f = multilevel.random_intercept(_customers(spark, sf_dir), {"x": F.col("x")}, F.col("y"), "g")
    return spark.createDataFrame([*f.fixed.table(), ("sigma", f.sigma), ("ratio", f.ratio)], "term string, value double").select("term", shown("value", 5).alias("value"))


@query()
def mixed_logistic(spark, sf_dir):
    """Quality with a random intercept for each language."""
    rows = tables.labelled(spark, sf_dir)
    f = multilevel.penalized_quasi(rows, {"size": F.col("size")}, F.col("y"), "lang", families.binomial())
    return f.effects.withColumn("slope", F.lit(f.fixed.beta["size"]))


def _priorities(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    levels = [r[0] for r in o.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    rows = o.select("o_orderkey", F.col("o_orderpriority").alias("y"), (F.col("o_totalprice") / 100000).alias("price"))
    return rows, levels, categories.one_hot(F.col("y"), levels)


def _category_search_sql(steps: int = 12) -> str:
    """Both sizes of a two-category search: the overall shares, and Newton's method for one predictor."""
    newton = []
    for k in range(steps):
        newton.append(f"g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS ga, sum((y - p) * x) - {solve.REGUL} * any_value(b) AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p) * x * x) + {solve.REGUL} AS hbb FROM (SELECT s.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM s, b{k}))")
        newton.append(f"b{k + 1} AS (SELECT a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM g{k})")
    return f"""WITH l AS ({tables.LABELLED_SQL}), m AS (SELECT avg(y) AS share, avg(size) AS mu, stddev_samp(size) AS sd FROM l), s AS (SELECT y, (size - mu) / sd AS x FROM l, m), b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b), {', '.join(newton)},
e AS (SELECT y, share, 1 / (1 + exp(-(a + b * x))) AS p FROM s, m, b{steps})
SELECT 0 AS size, '(Intercept)' AS term, round(-avg(y * ln(share) + (1 - y) * ln(1 - share)), 6) AS ce, round(sum(y * ln(share) + (1 - y) * ln(1 - share)), 3) AS elpd, round(avg(((share > 0.5)::INT = y)::INT), 6) AS acc FROM e
UNION ALL SELECT 1, 'size', round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6), round(sum(y * ln(p) + (1 - y) * ln(1 - p)), 3), round(avg(((p > 0.5)::INT = y)::INT), 6) FROM e"""


@query(_category_search_sql())
def category_search(spark, sf_dir):
    """A search over categories, which for two of them is the binomial one; the observed categories are the reference."""
    rows = tables.labelled(spark, sf_dir).withColumn("y", F.when(F.col("y") == 1, "good").otherwise("bad"))
    rows = rows.withColumn("mu", F.array(categories.one_hot(F.col("y"), ["bad", "good"])))
    model = categorical.from_draws(rows, ["bad", "good"], {"size": F.col("size")}, {"size": ["size"]})
    chosen = categorical.varsel(model)
    out = chosen.summary(["elpd", "acc"]).join(chosen.path.table(spark), "size")
    return out.select("size", "term", shown("ce").alias("ce"), shown("elpd", 3).alias("elpd"), shown("acc").alias("acc"))


#: Predictors 4 - 6 size - toxic as a reference of one draw; all projections are ridge fits to them.
LATENT = f"""l AS ({tables.LABELLED_SQL}), e AS (SELECT *, 4 - 6 * size - toxic AS eta FROM l),
m AS (SELECT count(*) AS n, avg(size) AS ms, avg(toxic) AS mt, avg(eta) AS me, stddev_samp(size) AS ds, stddev_samp(toxic) AS dt FROM e),
c AS (SELECT any_value(n) AS n, any_value(ms) AS ms, any_value(mt) AS mt, any_value(me) AS me, any_value(ds) AS ds, any_value(dt) AS dt,
  sum(power((size - ms) / ds, 2)) + {solve.REGUL} AS ss, sum(power((toxic - mt) / dt, 2)) + {solve.REGUL} AS tt, sum((size - ms) / ds * (toxic - mt) / dt) AS st, sum((size - ms) / ds * (eta - me)) AS es, sum((toxic - mt) / dt * (eta - me)) AS et FROM e, m),
b AS (SELECT *, (es * tt - et * st) / (ss * tt - st * st) AS b1, (et * ss - es * st) / (ss * tt - st * st) AS b2 FROM c),
f AS (SELECT y, eta, size, toxic, unnest([0, 1, 2]) AS k, [me, me + es / ss * (size - ms) / ds, me + b1 * (size - ms) / ds + b2 * (toxic - mt) / dt] AS fits FROM e, b),
g AS (SELECT k, y, eta, fits[k + 1] AS fit FROM f), p AS (SELECT *, 1 / (1 + exp(-fit)) AS p FROM g)"""


@query(f"WITH {LATENT} SELECT k AS size, ['(Intercept)', 'size', 'toxic'][k + 1] AS term, round(sum(y * ln(p) + (1 - y) * ln(1 - p)), 4) AS elpd, round(avg((round_even(p, 0) = y)::INT), 6) AS acc, round(sqrt(avg(power(eta - fit, 2))), 6) AS latent_rmse FROM p GROUP BY k")
def latent_varsel(spark, sf_dir):
    """A latent search with statistics of every size on the response scale, and errors on the latent one."""
    rows = tables.labelled(spark, sf_dir)
    drawn = rows.select("obs_id", F.array(1 / (1 + F.exp(-(4 - 6 * F.col("size") - F.col("toxic"))))).alias("mu"))
    cols = {c: F.col(c) for c in ("size", "toxic")}
    chosen = latent_plan.varsel(refmodel.from_draws(rows, drawn, families.binomial(), cols, {c: [c] for c in cols}))
    out = chosen.summary(["elpd", "acc"]).join(chosen.summary(["rmse"], response_scale=False).select("size", "rmse"), "size").join(chosen.path.table(spark), "size")
    return out.select("size", "term", shown("elpd", 4).alias("elpd"), shown("acc").alias("acc"), shown("rmse").alias("latent_rmse"))


SHARES = "s AS (SELECT o_orderpriority AS level, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority) AS k FROM orders GROUP BY o_orderpriority)"


@query(f"WITH {SHARES} SELECT k::INTEGER - 1 AS category, round(ln(n / (SELECT n FROM s WHERE k = 1)), 6) AS intercept FROM s WHERE k > 1")
def softmax_intercepts(spark, sf_dir):
    rows, levels, target = _priorities(spark, sf_dir)
    fits = categories.softmax(rows, {}, target, len(levels)).fits
    return spark.createDataFrame([(i + 1, f.intercept) for i, f in enumerate(fits)], "category int, intercept double").select("category", shown("intercept").alias("intercept"))


@query(f"WITH {SHARES}, u AS (SELECT k, sum(n) OVER (ORDER BY k) / (SELECT sum(n) FROM s) AS p FROM s) SELECT k::INTEGER AS threshold, round(ln(p / (1 - p)), 6) AS value FROM u WHERE k < (SELECT max(k) FROM s)")
def ordinal_thresholds(spark, sf_dir):
    rows, levels, target = _priorities(spark, sf_dir)
    cuts = categories.ordinal(rows, {}, target, len(levels)).thresholds
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(cuts)], "threshold int, value double").select("threshold", shown("value").alias("value"))


@query()
def softmax_projection(spark, sf_dir):
    rows, levels, target = _priorities(spark, sf_dir)
    cols = {"price": F.col("price")}
    f = categories.softmax(rows, cols, target, len(levels))
    return rows.select("o_orderkey", F.posexplode(f.probabilities(cols)).alias("category", "probability"))


@query()
def ordinal_projection(spark, sf_dir):
    rows, levels, target = _priorities(spark, sf_dir)
    f = categories.ordinal(rows, {"price": F.col("price")}, target, len(levels))
    return spark.createDataFrame([*[(f"threshold {i + 1}", v) for i, v in enumerate(f.thresholds)], *f.beta.items()], "term string, value double")


@query("""WITH p AS (SELECT 0.02 + (o_orderkey % 90) / 100 AS m FROM orders) SELECT round(sum(ln(m / (1 - m))), 6) AS cumulative, round(sum(ln(m) - ln(1 - m)), 6) AS softmax FROM p""")
def latent_from_categories(spark, sf_dir):
    """Link-scale values of two categories: of the second against the first, and of the first cumulative share."""
    p = tables.read(spark, sf_dir, "orders").select(categories.binomial_categories(0.02 + (F.col("o_orderkey") % 90) / 100).alias("p"))
    first = F.array(F.get("p", F.lit(1)), F.get("p", F.lit(0)))
    return p.agg(shown(F.sum(F.get(categories.latent_from_cumulative(first, 2), F.lit(0)))).alias("cumulative"), shown(F.sum(F.get(categories.latent_from_softmax(F.col("p"), 2), F.lit(0)))).alias("softmax"))


@query()
def smooth_terms(spark, sf_dir):
    """Charge explained by tax and a smooth of price."""
    i = tables.line_items(spark, sf_dir)
    s = smooth.fit_smooths(i, {"tax": F.col("tax")}, {"price": F.col("price")}, F.col("y"))
    return spark.createDataFrame([*s.fit.table(), ("penalty", s.penalty), ("edf", s.edf)], "term string, value double")


@query()
def latent_projection(spark, sf_dir):
    """A latent search for quality, evaluated on the response scale."""
    cols = {c: F.col(c) for c in ("size", "toxic")}
    ref = refmodel.glm_laplace(tables.labelled(spark, sf_dir), families.binomial(), cols, {c: [c] for c in cols}, draws=20)
    on = latent.latent_model(ref)
    g = selection.with_targets(gram(on.data, cols, F.col("wobs")), list(ref.fits), [f"m{i}" for i in range(ref.n_draws)])
    path = search.forward(g, ref.terms, "m0", weights={f"m{i}": 1 / ref.n_draws for i in range(ref.n_draws)})
    chosen = [c for t in path.ranking[:1] for c in ref.terms[t]]
    fits = [solve.ridge(g, chosen, f"m{i}") for i in range(ref.n_draws)]
    return latent.on_response_scale(on.data, fits, ref.weights, ref, families.binomial())


@query("SELECT l_linenumber AS line, count(*)::BIGINT AS n, round(sum(l_quantity), 4) AS quantity, round(sum(l_quantity * l_quantity), 4) AS squares, round(sum(l_quantity * l_discount), 4) AS products FROM lineitem GROUP BY l_linenumber")
def incremental_moments(spark, sf_dir):
    """Moments summed by line number in separate batches and added up."""
    items = tables.read(spark, sf_dir, "lineitem")
    cols = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")}
    parts = [moments(items.filter(F.col("l_suppkey") % 3 == k), cols, by=F.col("l_linenumber")) for k in range(3)]
    total = total_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return total.select(F.col("g").alias("line"), "n", shown("m1", 4).alias("quantity"), shown("m3", 4).alias("squares"), shown("m4", 4).alias("products"))


@query()
def cv_loo_subsampled(spark, sf_dir):
    """Suppliers' balances explained by key arithmetic; elpd by the difference estimator."""
    s = tables.read(spark, sf_dir, "supplier")
    x1, x2 = (F.col("s_suppkey") % 13) / 10, (F.col("s_suppkey") % 7) / 10
    rows = s.select(F.col("s_suppkey").alias("obs_id"), (2 * x1 + F.col("s_acctbal") / 10000).alias("y"), F.lit(1.0).alias("wobs"), F.lit(0.0).alias("offs"), x1.alias("a"), x2.alias("b"))
    cols = {c: F.col(c) for c in "ab"}
    return selection.cv_loo_subsampled(refmodel.gaussian_conjugate(rows, cols, {c: [c] for c in cols}, draws=60), 12, largest=2, prediction_draws=30)


@query()
def reference_predictions(spark, sf_dir):
    """Log predictive densities of a reference model."""
    rows = tables.line_items(spark, sf_dir)
    cols = {c: F.col(c) for c in ("price", "discount")}
    return selection.predict(refmodel.gaussian_conjugate(rows, cols, {c: [c] for c in cols}, draws=20), rows, "lpd")
