"""Queries on designs, moments, projections and searches."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lodestar.catalog.registry import query, shown
from lodestar.functions import families
from lodestar.operators import crossval, design, gram, irls, search, solve
from lodestar.operators import formula as fm
from lodestar.plans import selection
from lodestar.sources import refmodel, tables

TERMS = ("price", "discount", "tax", "quantity")
ITEMS = f"items AS ({tables.LINE_ITEMS_SQL})"


def _columns(names=TERMS):
    return {n: F.col(n) for n in names}


def _blocks(names=TERMS):
    return {n: [n] for n in names}


@query(f"WITH {ITEMS} SELECT count(*)::BIGINT AS n, round(sum(quantity), 4) AS w, round(sum(quantity * price), 2) AS w_price, round(sum(quantity * discount), 4) AS w_discount, round(sum(quantity * price * price), 1) AS w_price_price, round(sum(quantity * price * discount), 3) AS w_price_discount, round(sum(quantity * discount * discount), 5) AS w_discount_discount FROM items")
def gram_weighted(spark, sf_dir):
    m = gram.moments(tables.line_items(spark, sf_dir), _columns(("price", "discount")), F.col("quantity"))
    return m.select("n", shown("m0", 4).alias("w"), shown("m1", 2).alias("w_price"), shown("m2", 4).alias("w_discount"), shown("m3", 1).alias("w_price_price"), shown("m4", 3).alias("w_price_discount"), shown("m5", 5).alias("w_discount_discount"))


@query(f"""WITH {ITEMS}, m AS (SELECT count(*) AS n, sum(quantity) AS w, sum(quantity * price) / sum(quantity) AS mp, sum(quantity * tax) / sum(quantity) AS mt FROM items)
SELECT round(any_value(mp), 6) AS mean_price, round(sqrt(any_value(n) / (any_value(n) - 1) * sum(quantity * power(price - mp, 2)) / any_value(w)), 6) AS sd_price,
  round(any_value(mt), 8) AS mean_tax, round(sqrt(any_value(n) / (any_value(n) - 1) * sum(quantity * power(tax - mt, 2)) / any_value(w)), 8) AS sd_tax FROM items, m""")
def standardize_features(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), _columns(("price", "tax")), F.col("quantity"))
    mean, sd = g.mean(["price", "tax"]), solve.scales(g, ["price", "tax"])
    out = spark.createDataFrame([(float(mean[0]), float(sd[0]), float(mean[1]), float(sd[1]))], "a double, b double, c double, d double")
    return out.select(shown("a").alias("mean_price"), shown("b").alias("sd_price"), shown("c", 8).alias("mean_tax"), shown("d", 8).alias("sd_tax"))


@query(f"""WITH {ITEMS} SELECT returnflag, linestatus, count(*)::BIGINT AS n, sum(CASE WHEN returnflag = 'N' THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_n, sum(CASE WHEN returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS flag_r,
  round(sum(CASE WHEN returnflag = 'R' AND linestatus = 'O' THEN price ELSE 0.0 END), 4) AS r_o_price FROM items GROUP BY returnflag, linestatus""")
def design_matrix_dummies(spark, sf_dir):
    items = tables.line_items(spark, sf_dir)
    d = design.Design(design.levels_of(items, ["returnflag", "linestatus"]))
    x, names = d.matrix(items, ["returnflag", "returnflag:linestatus:price"], ["returnflag", "linestatus"])
    flags, inter = names["returnflag"], names["returnflag:linestatus:price"]
    return x.groupBy("returnflag", "linestatus").agg(F.count("*").alias("n"), F.sum(f"`{flags[0]}`").alias("flag_n"), F.sum(f"`{flags[1]}`").alias("flag_r"), shown(F.sum(f"`{inter[1]}`"), 4).alias("r_o_price"))


_PRODUCTS = {":".join(s): s for k in (1, 2, 3) for s in itertools.combinations(("discount", "price", "tax"), k)}


@query(f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT '{t}' AS term, {len(s)} AS parts, round(sum({' * '.join(s)}), 4) AS total FROM items" for t, s in _PRODUCTS.items()))
def interaction_terms_expand(spark, sf_dir):
    """The terms of a product of three, each with its column's sum over all rows."""
    terms = list(fm.parse("charge ~ price * discount * tax").terms)
    x, names = design.Design().matrix(tables.line_items(spark, sf_dir), terms, [])
    sums = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(len(fm.split_top(t, ":"))).alias("parts"), shown(F.sum(f"`{names[t][0]}`"), 4).alias("total")) for t in terms])
    return x.agg(sums.alias("all")).select(F.inline("all"))


@query(f"""WITH {ITEMS} SELECT round(avg(power(price, 2)), 4) AS price_2, round(avg(power(price, 3)), 2) AS price_3, round(avg(sqrt(quantity)), 8) AS root_quantity, round(avg(ln(price)), 8) AS log_price, round(avg(abs(discount - tax)), 8) AS gap FROM items""")
def transformed_terms(spark, sf_dir):
    x, names = design.Design().matrix(tables.line_items(spark, sf_dir), ["poly(price, 3)", "sqrt(quantity)", "log(price)", "abs(discount - tax)"], [])
    mean = lambda n, d: shown(F.avg(f"`{n}`"), d)
    poly = names["poly(price, 3)"]
    return x.agg(mean(poly[1], 4).alias("price_2"), mean(poly[2], 2).alias("price_3"), mean("sqrt(quantity)", 8).alias("root_quantity"), mean("log(price)", 8).alias("log_price"), mean("abs(discount - tax)", 8).alias("gap"))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS n, o_orderkey % 3 % (o_orderkey % 4 + 1) AS y FROM orders),
r AS (SELECT o_orderkey, y, n, unnest(range(1, n + 1)) AS trial FROM t WHERE n > 0) SELECT trial::INTEGER AS trial, count(*)::BIGINT AS n, sum(CASE WHEN trial > n - y THEN 1 ELSE 0 END)::BIGINT AS successes FROM r GROUP BY trial""")
def deaggregate_trials(spark, sf_dir):
    orders = tables.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("n"))
    rows = design.trials(orders.withColumn("y", F.col("o_orderkey") % 3 % (F.col("n") + 1)), "y", "n")
    return rows.groupBy("trial").agg(F.count("*").alias("n"), F.sum("outcome").alias("successes"))


@query(f"""WITH {ITEMS} SELECT count(*)::BIGINT AS n, count_if(y IS NULL OR isnan(y))::BIGINT AS missing_y, count_if(price IS NULL)::BIGINT AS missing_price FROM items""")
def missing_value_check(spark, sf_dir):
    items = design.require_complete(tables.line_items(spark, sf_dir), ["y", "price", "discount", "tax", "quantity"])
    return items.agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("missing_y"), F.count_if(F.col("price").isNull()).alias("missing_price"))


@query("""SELECT o_orderpriority AS priority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS y, count(*)::DOUBLE AS wobs FROM orders GROUP BY o_orderpriority""")
def two_column_response(spark, sf_dir):
    by = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count_if(F.col("o_orderstatus") != "F").alias("bad"))
    return design.response(by, "good", failures="bad").select("priority", "y", "wobs")


@query("SELECT l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY l_linenumber")
def observation_subset(spark, sf_dir):
    wanted = tables.read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.rows_of(tables.read(spark, sf_dir, "lineitem"), "l_orderkey", wanted).groupBy("l_linenumber").agg(F.count("*").alias("n"))


# Projections of one, two or three terms in closed form: moments centered and scaled, then Cramer's rule.

SCALED = f"""{ITEMS}, mean AS (SELECT count(*) AS n, avg(y) AS my, {", ".join(f"avg({t}) AS m_{t}" for t in TERMS)} FROM items),
mom AS (SELECT any_value(n) AS n, any_value(my) AS my, {", ".join(f"any_value(m_{t}) AS m_{t}" for t in TERMS)}, sum(power(y - my, 2)) AS yy,
  {", ".join(f"sum(({a} - m_{a}) * ({b} - m_{b})) AS s_{a}_{b}" for a, b in itertools.combinations_with_replacement(TERMS, 2))},
  {", ".join(f"sum(({t} - m_{t}) * (y - my)) AS c_{t}" for t in TERMS)} FROM items, mean),
std AS (SELECT *, {", ".join(f"sqrt(s_{t}_{t} / (n - 1)) AS d_{t}" for t in TERMS)} FROM mom)"""


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'} ({m[0][j]}) * ({_det([row[:j] + row[j + 1 :] for row in m[1:]])})" for j in range(len(m))]
    return " ".join(parts)


def _ridge_sql(names: tuple[str, ...]) -> tuple[list[str], str]:
    """SQL of the coefficients on the original scale and of the cross-entropy for a set of terms."""
    key = lambda a, b: f"s_{a}_{b}" if TERMS.index(a) <= TERMS.index(b) else f"s_{b}_{a}"
    a = [[f"({key(p, q)} / (d_{p} * d_{q}){f' + {solve.REGUL}' if p == q else ''})" for q in names] for p in names]
    b = [f"(c_{p} / d_{p})" for p in names]
    full = _det(a)
    beta = [f"(({_det([row[:j] + [b[i]] + row[j + 1 :] for i, row in enumerate(a)])}) / ({full}) / d_{names[j]})" for j in range(len(names))]
    square = " + ".join(f"{beta[i]} * {beta[j]} * {key(p, q)}" for i, p in enumerate(names) for j, q in enumerate(names))
    cross = " + ".join(f"{beta[i]} * c_{p}" for i, p in enumerate(names))
    return beta, f"(({square} - 2 * ({cross})) / n - my * my)"


def _forward_ctes(largest: int) -> str:
    """Every subset of each size scored; a path p0, p1, ... takes the best superset of what it has."""
    sets = [s for k in range(1, largest + 1) for s in itertools.combinations(TERMS, k)]
    scored = " UNION ALL ".join(f"SELECT {len(s)} AS k, [{', '.join(repr(t) for t in s)}] AS names, {_ridge_sql(s)[1]} AS ce FROM std" for s in sets)
    steps = ["p0 AS (SELECT []::VARCHAR[] AS names)"]
    for k in range(1, largest + 1):
        steps.append(f"p{k} AS (SELECT scored.names, scored.ce, list_filter(scored.names, lambda x: NOT list_contains(p{k - 1}.names, x))[1] AS term FROM scored, p{k - 1} WHERE k = {k} AND len(list_filter(p{k - 1}.names, lambda x: NOT list_contains(scored.names, x))) = 0 ORDER BY scored.ce LIMIT 1)")
    return f"WITH {SCALED}, scored AS ({scored}), {', '.join(steps)}"


def _forward_sql(largest: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {k} AS size, term, round(ce, 4) AS ce FROM p{k}" for k in range(1, largest + 1))
    return f"{_forward_ctes(largest)} SELECT 0 AS size, '(Intercept)' AS term, round(-my * my, 4) AS ce FROM std UNION ALL {rows}"


@query(_forward_sql(3))
def forward_search(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    path = search.forward(g, _blocks(), "y", 3)
    return path.table(spark).select("size", "term", shown("ce", 4).alias("ce"))


@query(f"WITH {SCALED} " + " UNION ALL ".join(f"SELECT '{t}' AS term, round({_ridge_sql((t,))[0][0]}, 6) AS beta, round(my - {_ridge_sql((t,))[0][0]} * m_{t}, 6) AS intercept, round(sqrt((yy + n * my * my) / n + {_ridge_sql((t,))[1]}), 6) AS dis FROM std" for t in TERMS))
def project_single_terms(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    rows = []
    for t in TERMS:
        f = solve.ridge(g, [t], "y")
        rows.append((t, f.beta[t], f.intercept, solve.dispersion(g, f, "y")))
    return spark.createDataFrame(rows, "term string, beta double, intercept double, dis double").select("term", *[shown(c).alias(c) for c in ("beta", "intercept", "dis")])


@query(f"WITH {SCALED} SELECT " + ", ".join(f"round({b}, 6) AS b_{t}" for t, b in zip(TERMS[:3], _ridge_sql(TERMS[:3])[0], strict=True)) + " FROM std")
def project_three_terms(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    f = solve.ridge(g, list(TERMS[:3]), "y")
    return spark.createDataFrame([tuple(f.beta[t] for t in TERMS[:3])], "a double, b double, c double").select(*[shown(c).alias(f"b_{t}") for c, t in zip("abc", TERMS, strict=False)])


@query(f"""WITH {SCALED}, top AS (SELECT 1.001 * greatest({", ".join(f"abs(c_{t} / d_{t})" for t in TERMS)}) AS hi FROM std)
SELECT i::INTEGER AS step, round(exp(ln(hi) + i / 149 * ln(1e-5)), 3) AS lambda FROM top, range(0, 150) r(i)""")
def lambda_grid(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    grid = solve.lambda_grid(g, list(TERMS), "y")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(grid)], "step int, lambda double").select("step", shown("lambda", 3).alias("lambda"))


@query(f"""WITH {SCALED} SELECT i::INTEGER AS step, round(sign(c_price) * greatest(abs(c_price / d_price) - 1.001 * abs(c_price / d_price) * exp(i / 29 * ln(1e-5)), 0) / (s_price_price / (d_price * d_price)) / d_price, 6) AS beta FROM std, range(0, 30) r(i)""")
def soft_threshold_path(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(("price",)), "y": F.col("y")})
    path = solve.elastic_net(g, ["price"], "y", solve.lambda_grid(g, ["price"], "y", 30))
    return spark.createDataFrame([(i, f.beta["price"]) for i, f in enumerate(path.fits)], "step int, beta double").select("step", shown("beta").alias("beta"))


@query(f"""WITH {SCALED}, r AS (SELECT unnest([{", ".join(f"{{'t': '{t}', 'v': abs(c_{t} / d_{t})}}" for t in TERMS)}]) AS x FROM std) SELECT 1 AS position, arg_max(x.t, x.v) AS term FROM r""")
def l1_first_term(spark, sf_dir):
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    path = search.l1(g, _blocks(), "y", 1)
    return spark.createDataFrame([(1, path.ranking[0])], "position int, term string")


@query()
def l1_path(spark, sf_dir):
    """The whole L1 ranking with each size's coefficients."""
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    path = search.l1(g, _blocks(), "y")
    rows = [(n, c, v) for n, f in zip(path.sizes, path.fits, strict=True) for c, v in f.table()]
    return spark.createDataFrame(rows, "size int, term string, value double")


@query()
def embedding_l1_search(spark, sf_dir):
    """The first ten embedding dimensions of an L1 path for the label, from a 64-column moment matrix."""
    e = tables.read(spark, sf_dir, "embeddings")
    cols = {f"e{i}": F.get("embedding", F.lit(i)).cast("double") for i in range(64)}
    g = gram.gram(e, {**cols, "y": F.col("label").cast("double")})
    path = search.l1(g, {c: [c] for c in cols}, "y", 10)
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(path.ranking)], "position int, term string")


@query(f"""WITH l AS ({tables.LABELLED_SQL}), p AS (SELECT y, 0.2 - 0.5 * size + 0.3 * toxic AS f FROM l), q AS (SELECT f, y, 1 / (1 + exp(-f)) AS mu FROM p)
SELECT count(*)::BIGINT AS n, round(sum(f + (y - mu) / (mu * (1 - mu))), 6) AS z, round(sum(mu * (1 - mu)), 6) AS w, round(sum(mu - y), 6) AS grad, round(-sum(y * ln(mu) + (1 - y) * ln(1 - mu)), 6) AS loss FROM q""")
def pseudo_data_binomial(spark, sf_dir):
    rows = tables.labelled(spark, sf_dir).withColumn("f", 0.2 - 0.5 * F.col("size") + 0.3 * F.col("toxic"))
    p = families.binomial().pseudo_data(F.col("f"), F.col("y"), F.lit(0.0), F.lit(1.0))
    return rows.agg(F.count("*").alias("n"), shown(F.sum(p["z"])).alias("z"), shown(F.sum(p["wobs"])).alias("w"), shown(F.sum(p["grad"])).alias("grad"), shown(F.sum(p["loss"])).alias("loss"))


@query(f"""WITH u AS ({tables.USER_COUNTS_SQL}), p AS (SELECT y, 1 + 0.02 * x AS f FROM u), q AS (SELECT f, y, exp(f) AS mu FROM p)
SELECT count(*)::BIGINT AS n, round(sum(f + (y - mu) / mu), 5) AS z, round(sum(mu), 5) AS w, round(sum(mu - y), 5) AS grad, round(sum(mu - y * ln(mu)), 5) AS loss FROM q""")
def pseudo_data_poisson(spark, sf_dir):
    rows = tables.user_counts(spark, sf_dir).withColumn("f", 1 + 0.02 * F.col("x"))
    p = families.poisson().pseudo_data(F.col("f"), F.col("y"), F.lit(0.0), F.lit(1.0))
    return rows.agg(F.count("*").alias("n"), shown(F.sum(p["z"]), 5).alias("z"), shown(F.sum(p["wobs"]), 5).alias("w"), shown(F.sum(p["grad"]), 5).alias("grad"), shown(F.sum(p["loss"]), 5).alias("loss"))


def _newton_sql(steps: int) -> str:
    """Newton's method for a logistic model with one predictor and the ridge on its standardized coefficient."""
    parts = [f"l AS ({tables.LABELLED_SQL})", "m AS (SELECT avg(size) AS mu, stddev_samp(size) AS sd FROM l)", "s AS (SELECT y, (size - mu) / sd AS x FROM l, m)", "b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for k in range(steps):
        parts.append(f"g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS ga, sum((y - p) * x) - {solve.REGUL} * any_value(b) AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p) * x * x) + {solve.REGUL} AS hbb FROM (SELECT s.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM s, b{k}))")
        parts.append(f"b{k + 1} AS (SELECT a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM g{k})")
    return f"WITH {', '.join(parts)} SELECT round(a - b / sd * mu, 5) AS intercept, round(b / sd, 5) AS size FROM b{steps}, m"


@query(_newton_sql(12))
def logistic_projection(spark, sf_dir):
    rows = tables.labelled(spark, sf_dir)
    f = irls.project(rows, {"size": F.col("size")}, F.array("y"), families.binomial(), [irls.Job(("size",))], threshold=1e-14)[0]
    return spark.createDataFrame([(f.intercept, f.beta["size"])], "a double, b double").select(shown("a", 5).alias("intercept"), shown("b", 5).alias("size"))


def _poisson_sql(steps: int) -> str:
    """Newton's method for a Poisson model with one predictor, from the mean count."""
    parts = [f"l AS ({tables.USER_COUNTS_SQL})", "m AS (SELECT avg(x) AS mu, stddev_samp(x) AS sd, ln(avg(y)) AS a0 FROM l)", "s AS (SELECT y, (x - mu) / sd AS x FROM l, m)", "b0 AS (SELECT a0 AS a, 0.0::DOUBLE AS b FROM m)"]
    for k in range(steps):
        parts.append(f"g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS ga, sum((y - p) * x) - {solve.REGUL} * any_value(b) AS gb, sum(p) AS haa, sum(p * x) AS hab, sum(p * x * x) + {solve.REGUL} AS hbb FROM (SELECT s.*, a, b, exp(a + b * x) AS p FROM s, b{k}))")
        parts.append(f"b{k + 1} AS (SELECT a + (ga * hbb - gb * hab) / (haa * hbb - hab * hab) AS a, b + (gb * haa - ga * hab) / (haa * hbb - hab * hab) AS b FROM g{k})")
    return f"WITH {', '.join(parts)} SELECT '(Intercept)' AS term, round(a - b / sd * mu, 5) AS value FROM b{steps}, m UNION ALL SELECT 'x', round(b / sd, 5) FROM b{steps}, m"


@query(_poisson_sql(12))
def poisson_projection(spark, sf_dir):
    """A Poisson projection of event counts on mean values."""
    f = irls.project(tables.user_counts(spark, sf_dir), {"x": F.col("x")}, F.array("y"), families.poisson(), [irls.Job(("x",))], threshold=1e-14)[0]
    return spark.createDataFrame(f.table(), "term string, value double").select("term", shown("value", 5).alias("value"))


@query(f"""WITH l AS ({tables.LABELLED_SQL}), m AS (SELECT avg(y) AS y, avg(size) AS s, avg(toxic) AS t, stddev_samp(size) AS ds, stddev_samp(toxic) AS dt FROM l),
g AS (SELECT abs(sum((l.y - m.y) * (size - s) / ds)) AS a, abs(sum((l.y - m.y) * (toxic - t) / dt)) AS b FROM l, m) SELECT 1 AS position, CASE WHEN a >= b THEN 'size' ELSE 'toxic' END AS term FROM g""")
def logistic_l1_first_term(spark, sf_dir):
    """What enters the L1 path of a logistic model first has the largest score at the intercept alone."""
    cols = {c: F.col(c) for c in ("size", "toxic")}
    path = search.l1_newton(tables.labelled(spark, sf_dir), cols, {c: [c] for c in cols}, F.col("y"), families.binomial(), F.col("wobs"), F.col("offs"), 1)
    return spark.createDataFrame([(1, path.ranking[0])], "position int, term string")


@query(f"WITH {SCALED} SELECT round({_ridge_sql(('price',))[0][0]}, 5) AS slope, round(d_price, 5) AS sd, round(sqrt((yy + n * my * my) / n + {_ridge_sql(('price',))[1]}), 5) AS dis FROM std")
def shifted_moments(spark, sf_dir):
    """A projection on columns far from zero, whose raw products would lose their spread."""
    g = gram.gram(tables.line_items(spark, sf_dir), {"x": 1e9 + F.col("price"), "y": F.col("y") - 1e9})
    f = solve.ridge(g, ["x"], "y")
    rows = [(f.beta["x"], float(solve.scales(g, ["x"])[0]), solve.dispersion(g, f, "y"))]
    return spark.createDataFrame(rows, "a double, b double, c double").select(*[shown(c, 5).alias(n) for c, n in zip("abc", ("slope", "sd", "dis"), strict=True)])


KFOLD = """o AS (SELECT o_orderkey, o_totalprice / 1000 AS y, (o_custkey % 97) / 10 AS x, (o_orderkey % 5)::INTEGER AS fold FROM orders),
f AS (SELECT t.fold, avg(o.x) AS mx, avg(o.y) AS my, regr_slope(o.y, o.x) AS b FROM (SELECT DISTINCT fold FROM o) t JOIN o ON o.fold <> t.fold GROUP BY t.fold)"""


def _orders(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), ((F.col("o_custkey") % 97) / 10).alias("x"), (F.col("o_orderkey") % 5).cast("int").alias("fold"))


@query(f"WITH {KFOLD} SELECT fold, round(my - b * mx, 5) AS intercept, round(b, 5) AS slope FROM f")
def kfold_projections(spark, sf_dir):
    by = gram.grams(_orders(spark, sf_dir), {"x": F.col("x"), "y": F.col("y")}, by=F.col("fold"))
    rows = []
    for fold, g in crossval.complements(by).items():
        f = solve.ridge(g, ["x"], "y", 0.0)
        rows.append((fold, f.intercept, f.beta["x"]))
    return spark.createDataFrame(rows, "fold int, a double, b double").select("fold", shown("a", 5).alias("intercept"), shown("b", 5).alias("slope"))


@query(f"WITH {KFOLD} SELECT count(*)::BIGINT AS n, round(sqrt(avg(power(o.y - (my + b * (x - mx)), 2))), 5) AS rmse FROM o JOIN f USING (fold)")
def kfold_out_of_fold(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    by = gram.grams(rows, {"x": F.col("x"), "y": F.col("y")}, by=F.col("fold"))
    mu = F.lit(None).cast("double")
    for fold, g in crossval.complements(by).items():
        mu = F.when(F.col("fold") == fold, irls.predictor(solve.ridge(g, ["x"], "y", 0.0), {"x": F.col("x")})).otherwise(mu)
    return rows.agg(F.count("*").alias("n"), shown(F.sqrt(F.avg(F.pow(F.col("y") - mu, 2))), 5).alias("rmse"))


def _reference(spark, sf_dir, draws=40):
    return refmodel.gaussian_conjugate(tables.line_items(spark, sf_dir), _columns(), _blocks(), draws=draws)


_MSE = "((yy + n * my * my) / n + ce)"


@query(f"{_forward_ctes(3)}, path AS (SELECT 0 AS size, -my * my AS ce FROM std {' '.join(f'UNION ALL SELECT {k}, ce FROM p{k}' for k in (1, 2, 3))}) SELECT size, round(-n / 2 * (ln(2 * pi() * {_MSE}) + 1), 2) AS elpd, round({_MSE}, 5) AS mse, round(sqrt({_MSE}), 6) AS rmse, round(1 - {_MSE} / (yy / n), 7) AS \"R2\" FROM path, std")
def varsel_datafit(spark, sf_dir):
    """Search and evaluation with the data as reference model: every statistic follows from the search's scores."""
    chosen = selection.varsel(refmodel.datafit(tables.line_items(spark, sf_dir), families.gaussian(), _columns(), _blocks()), largest=3)
    out = chosen.summary(["elpd", "mse", "rmse", "R2"])
    return out.select("size", shown("elpd", 2).alias("elpd"), shown("mse", 5).alias("mse"), shown("rmse").alias("rmse"), shown("R2", 7).alias("R2"))


#: Of draws y + 1 with dispersion one half: what is left of y about a fit to them, and the projected variance.
_SHIFTED = f"({_MSE} + 1)", f"({_MSE} + 0.25)"


@query(f"{_forward_ctes(3)}, path AS (SELECT 0 AS size, '(Intercept)' AS term, -my * my AS ce FROM std {' '.join(f'UNION ALL SELECT {k}, term, ce FROM p{k}' for k in (1, 2, 3))}) SELECT size, term, round(ce + my * my - (my + 1) * (my + 1), 4) AS ce, round(-n / 2 * (ln(2 * pi() * {_SHIFTED[1]}) + {_SHIFTED[0]} / {_SHIFTED[1]}), 2) AS elpd, round({_SHIFTED[0]}, 5) AS mse FROM path, std")
def draws_varsel(spark, sf_dir):
    """A user's posterior draws as reference model: one draw, a unit over the response."""
    items = tables.line_items(spark, sf_dir)
    keyed = items.withColumn("obs_id", F.monotonically_increasing_id())  # obs_id repeats in the smallest table
    drawn = keyed.withColumn("mu", F.array(F.col("y") + 1))
    ref = refmodel.RefModel(drawn, families.gaussian(), _columns(), _blocks(), [0.5], [1.0])
    chosen = selection.varsel(ref, largest=3)
    out = chosen.summary(["elpd", "mse"]).join(chosen.path.table(spark), "size")
    return out.select("size", "term", shown("ce", 4).alias("ce"), shown("elpd", 2).alias("elpd"), shown("mse", 5).alias("mse"))


@query(f"""WITH {ITEMS}, o AS (SELECT *, (obs_id % 5 + 1)::INTEGER AS fold FROM items), k AS (SELECT t.fold, o.y, o.price AS x FROM (SELECT DISTINCT fold FROM o) t JOIN o ON o.fold <> t.fold),
m AS (SELECT fold, count(*) AS n, avg(y) AS my, avg(x) AS mx FROM k GROUP BY fold), s AS (SELECT fold, any_value(n) AS n, any_value(my) AS my, any_value(mx) AS mx, sum(power(x - mx, 2)) AS sxx, sum((x - mx) * (y - my)) AS sxy FROM k JOIN m USING (fold) GROUP BY fold),
f AS (SELECT *, sxy / (sxx + {solve.REGUL} * sxx / (n - 1)) AS b FROM s), e AS (SELECT power(o.y - my, 2) AS e0, power(o.y - my - b * (price - mx), 2) AS e1 FROM o JOIN f USING (fold))
SELECT 0 AS size, round(avg(e0), 5) AS mse, round(stddev_samp(e0) / sqrt(count(*)), 5) AS mse_se FROM e UNION ALL SELECT 1, round(avg(e1), 5), round(stddev_samp(e1) / sqrt(count(*)), 5) FROM e""")
def cv_kfold_datafit(spark, sf_dir):
    """K-fold cross-validation with the data as reference model; price leads in every fold."""
    items = tables.line_items(spark, sf_dir).withColumn("fold", (F.col("obs_id") % 5 + 1).cast("int"))
    names = ("price", "discount")
    ref = refmodel.datafit(items, families.gaussian(), _columns(names), _blocks(names))
    out = selection.cv_kfold(ref, k=5, largest=1, folded=ref.data).summary(["mse"])
    return out.select("size", shown("mse", 5).alias("mse"), shown("mse_se", 5).alias("mse_se"))


@query()
def varsel_summary(spark, sf_dir):
    """Forward search under a conjugate reference model, every size evaluated."""
    chosen = selection.varsel(_reference(spark, sf_dir), largest=3, prediction_draws=20)
    return chosen.summary(["elpd", "mlpd", "mse", "rmse", "R2"])


@query()
def varsel_suggested_size(spark, sf_dir):
    return selection.varsel(_reference(spark, sf_dir), largest=3, prediction_draws=20).suggested()


@query()
def cv_kfold_proportions(spark, sf_dir):
    return selection.cv_kfold(_reference(spark, sf_dir), k=5, largest=3, prediction_draws=5).proportions()


@query()
def cv_loo_summary(spark, sf_dir):
    return selection.cv_loo(_reference(spark, sf_dir), largest=2, prediction_draws=25).summary(["elpd", "mlpd"])


@query()
def binomial_varsel(spark, sf_dir):
    """Forward search with Newton passes under a Laplace reference model."""
    cols = {c: F.col(c) for c in ("size", "toxic")}
    ref = refmodel.glm_laplace(tables.labelled(spark, sf_dir), families.binomial(), cols, {c: [c] for c in cols}, draws=20)
    return selection.varsel(ref, clusters=4).summary(["elpd", "acc"])


@query()
def projected_predictions(spark, sf_dir):
    """Predictive samples of a projected model."""
    p = selection.project(_reference(spark, sf_dir), ["price", "discount"], n_draws=8)
    return p.predict(tables.line_items(spark, sf_dir), n=4).select("obs_id", F.posexplode("predicted").alias("draw", "value"))


@query()
def projected_coefficients(spark, sf_dir):
    return selection.project(_reference(spark, sf_dir), ["price", "discount", "tax"], n_draws=8).coefficients()


@query()
def binomial_cv_loo(spark, sf_dir):
    """Leave-one-out of a binomial search under a Laplace reference model."""
    cols = {c: F.col(c) for c in ("size", "toxic")}
    ref = refmodel.glm_laplace(tables.labelled(spark, sf_dir), families.binomial(), cols, {c: [c] for c in cols}, draws=40)
    return selection.cv_loo(ref, clusters=25).summary(["elpd", "acc"])


@query()
def binomial_cv_kfold(spark, sf_dir):
    """K-fold cross-validation of a binomial search; every fold has its own reference model."""
    cols = {c: F.col(c) for c in ("size", "toxic")}
    ref = refmodel.glm_laplace(tables.labelled(spark, sf_dir), families.binomial(), cols, {c: [c] for c in cols}, draws=10)
    return selection.cv_kfold(ref, k=3, clusters=2).summary(["elpd", "acc"])


_FORCED = {t: _ridge_sql(tuple(sorted(("discount", "tax", t), key=TERMS.index)))[1] for t in ("price", "quantity")}


@query(f"WITH {SCALED}, last AS ({' UNION ALL '.join(f'SELECT {t!r} AS term, {ce} AS ce FROM std' for t, ce in _FORCED.items())}) SELECT 0 AS size, '(Intercept)' AS term, round(-my * my, 4) AS ce FROM std UNION ALL SELECT 2, 'discount + tax', round({_ridge_sql(('discount', 'tax'))[1]}, 4) FROM std UNION ALL SELECT 3, arg_min(term, ce), round(min(ce), 4) FROM last")
def forced_search(spark, sf_dir):
    """A search in which discount and tax enter before anything else."""
    g = gram.gram(tables.line_items(spark, sf_dir), {**_columns(), "y": F.col("y")})
    path = search.forward(g, _blocks(), "y", 3, candidates=fm.forced_terms(["discount", "tax"], ["price", "quantity"]))
    return path.table(spark).select("size", "term", shown("ce", 4).alias("ce"))


@query(f"""WITH {ITEMS}, f AS (SELECT count(DISTINCT returnflag) AS flags, count(DISTINCT linestatus) AS levels FROM items), main(t, own, varies) AS (SELECT 'price', 1, true FROM f UNION ALL SELECT 'tax', 1, true FROM f UNION ALL SELECT 'discount', 1, false FROM f UNION ALL SELECT 'returnflag', flags - 1, false FROM f)
SELECT t AS block, own::INTEGER AS columns, 0 AS effects FROM main UNION ALL SELECT '(1 | linestatus)', 0, levels::INTEGER FROM f
UNION ALL SELECT t || ' + (1 | linestatus)', 1, levels::INTEGER FROM main, f WHERE varies UNION ALL SELECT t || ' + (' || t || ' | linestatus)', 1, 2 * levels::INTEGER FROM main, f WHERE varies
UNION ALL SELECT 'returnflag + s(quantity, by = returnflag)', flags::INTEGER - 1, 0 FROM f""")
def candidate_blocks(spark, sf_dir):
    """What may enter a search, with the columns of the design and the group effects that it brings on this table."""
    items = tables.line_items(spark, sf_dir)
    levels = design.levels_of(items, ["returnflag", "linestatus"])
    f = fm.parse("charge ~ price + tax + discount + returnflag + s(quantity, by = returnflag) + (price + tax | linestatus)")
    rows = []
    for b in fm.split_blocks(f, factors=["returnflag"])[1:]:
        parts = fm.flatten(fm.split_top(b))
        columns = sum(len(levels["returnflag"]) - 1 if t == "returnflag" else 1 for t in parts if not (fm.is_group(t) or fm.is_smooth(t)))
        rows.append((b, columns, sum((fm.size([t]) - 1) * len(levels[fm.group_parts(t)[1]]) for t in parts if fm.is_group(t))))
    return spark.createDataFrame(rows, "block string, columns int, effects int")
