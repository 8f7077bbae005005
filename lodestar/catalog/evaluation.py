"""Queries on families, statistics, draws, importance weights, folds and summaries."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from lodestar.catalog.registry import query, shown
from lodestar.functions import arrays, families
from lodestar.operators import crossval, design, draws, evaluate, loo, post, stats
from lodestar.operators.keyed import keyed, keyed_sql, prefix_sums
from lodestar.shared import cut
from lodestar.sources import tables

S = 24
Z = NormalDist().inv_cdf(1 - stats.ALPHA / 2)
LABELS = f"l AS ({tables.LABELLED_SQL})"

# A pointwise table with known structure: the reference predicts charge from price, discount and tax,
# size 0 predicts the mean, 1 the price, 2 price and discount.
POINTWISE = f"""items AS ({tables.LINE_ITEMS_SQL}),
long AS (SELECT obs_id, y, quantity AS wobs, unnest([NULL, 0, 1, 2]::INTEGER[]) AS size, unnest([price * (1 - discount) * (1 + tax) + discount, 40.0, price, price * (1 - discount)]) AS mu FROM items),
pw AS (SELECT obs_id, y, wobs, size, mu, -0.5 * ln(2 * pi()) - ln(2.0) - 0.5 * power((y - mu) / 2, 2) AS lppd FROM long)"""


def _pointwise(spark, sf_dir):
    i = tables.line_items(spark, sf_dir)
    price, discount, tax = F.col("price"), F.col("discount"), F.col("tax")
    fits = [(None, price * (1 - discount) * (1 + tax) + discount), (0, F.lit(40.0)), (1, price), (2, price * (1 - discount))]
    lik = lambda m: families.gaussian().log_lik(F.col("y"), m, F.lit(1.0), F.lit(2.0))
    rows = i.select("obs_id", "y", F.col("quantity").alias("wobs"), fits[0][1].alias("mu_ref"), F.inline(F.array(*[F.struct(F.lit(s).cast("int").alias("size"), m.alias("mu")) for s, m in fits])))
    return rows.withColumns({"lppd": lik(F.col("mu")), "lppd_ref": lik(F.col("mu_ref"))})


def _joined(spark, sf_dir):
    """Without the reference's values, which differences then join by obs_id as their SQL does; it repeats in a few rows."""
    return _pointwise(spark, sf_dir).drop("mu_ref", "lppd_ref")


def _ordered(df, digits):
    return df.select(F.coalesce("size", F.lit(-1)).alias("size"), "statistic", *[shown(c, digits).alias(c) for c in ("value", "se", "lq", "uq")])


#: SQL of the statistics' moments; ``{base}`` is the joined baseline or zeros.
_STATS = """rows AS (SELECT pw.size, pw.wobs AS w, pw.y, pw.lppd - {lppd_b} AS d, power(pw.mu - pw.y, 2) AS e, {e_b} AS b, (round_even(pw.mu, 0) = pw.y)::INT::DOUBLE - {c_b} AS c FROM pw {join}),
m AS (SELECT size, count(*) AS n, sum(w) AS sw, sum(w * y) / sum(w) AS ym, sum(w * e) / sum(w) AS em, sum(w * b) / sum(w) AS bm, avg(d) AS dm, avg(c) AS cm FROM rows GROUP BY size),
m2 AS (SELECT m.size, sum(w * power(ym - y, 2)) / any_value(sw) AS vm FROM rows JOIN m ON rows.size IS NOT DISTINCT FROM m.size GROUP BY m.size),
s AS (SELECT m.size, any_value(n) AS n, any_value(em) AS em, any_value(bm) AS bm, any_value(dm) AS dm, any_value(cm) AS cm, any_value(vm) AS vm,
  sum(power(d - dm, 2)) AS dd, sum(power(c - cm, 2)) AS cc, sum(w / sw * power(e - em, 2)) AS ee, sum(w / sw * power(b - bm, 2)) AS bb, sum(w / sw * (e - em) * (b - bm)) AS eb,
  sum(w / sw * power(power(ym - y, 2) - vm, 2)) AS vv, sum(w / sw * {ev} * (power(ym - y, 2) - vm)) AS ev
  FROM rows JOIN m ON rows.size IS NOT DISTINCT FROM m.size JOIN m2 ON rows.size IS NOT DISTINCT FROM m2.size GROUP BY m.size)"""
ABSOLUTE = _STATS.format(lppd_b="0", e_b="0.0", c_b="0", join="", ev="(e - em)")
RELATIVE = _STATS.format(lppd_b="r.lppd", e_b="power(r.mu - pw.y, 2)", c_b="(round_even(r.mu, 0) = pw.y)::INT", join="JOIN (SELECT obs_id, mu, lppd FROM pw WHERE size IS NULL) r USING (obs_id)", ev="(e - em - (b - bm))")


def _value(parts: dict[str, tuple[str, str, str, str]], with_sql: str, digits: int) -> str:
    """One SELECT for each statistic: value, se, lower and upper."""
    rows = " UNION ALL ".join(f"SELECT coalesce(size, -1) AS size, '{k}' AS statistic, round({v}, {digits}) AS value, round({se}, {digits}) AS se, round({lo}, {digits}) AS lq, round({hi}, {digits}) AS uq FROM s" for k, (v, se, lo, hi) in parts.items())
    return f"WITH {POINTWISE}, {with_sql} {rows}"


def _normal(v: str, se: str) -> tuple[str, str, str, str]:
    return v, se, f"{v} - {Z!r} * {se}", f"{v} + {Z!r} * {se}"


def _lognormal(v: str, se: str) -> tuple[str, str, str, str]:
    mid, sd = f"ln({v} / sqrt(1 + power({se} / {v}, 2)))", f"sqrt(ln(1 + power({se} / {v}, 2)))"
    return v, se, f"exp({mid} - {Z!r} * {sd})", f"exp({mid} + {Z!r} * {sd})"


_SE_D = "(sqrt(dd / (n - 1)) * sqrt(n))"
_ELPD = {"elpd": _normal("(dm * n)", _SE_D), "mlpd": _normal("dm", f"({_SE_D} / n)"), "gmpd": ("exp(dm)", f"({_SE_D} / n * exp(dm))", f"exp(dm - {Z!r} * {_SE_D} / n)", f"exp(dm + {Z!r} * {_SE_D} / n)")}


@query(_value(_ELPD, ABSOLUTE, 4))
def elpd_mlpd_gmpd(spark, sf_dir):
    return _ordered(stats.statistics(_pointwise(spark, sf_dir), ["elpd", "mlpd", "gmpd"]), 4)


@query(_value(_ELPD, RELATIVE, 4))
def elpd_mlpd_gmpd_delta(spark, sf_dir):
    return _ordered(stats.statistics(_joined(spark, sf_dir), ["elpd", "mlpd", "gmpd"], "ref"), 4)


_R2 = "sqrt(greatest((ee / (n - 1) - 2 * em / vm * ev / (n - 1) + power(em / vm, 2) * vv / (n - 1)) / (vm * vm), 0))"


@query(_value({"mse": _lognormal("em", "sqrt(ee / (n - 1))"), "rmse": _lognormal("sqrt(em)", "sqrt(ee / (n - 1) / em / 4)"), "R2": _normal("(1 - em / vm)", _R2)}, ABSOLUTE, 6))
def mse_rmse_r2(spark, sf_dir):
    return _ordered(stats.statistics(_pointwise(spark, sf_dir), ["mse", "rmse", "R2"]), 6)


_VAR = "greatest(ee / (n - 1) - 2 * eb / (n - 1) + bb / (n - 1), 0)"
_RMSE_D = "sqrt(greatest((ee / (n - 1) / em - 2 * eb / (n - 1) / sqrt(em * bm) + bb / (n - 1) / bm) / 4, 0))"
_R2_D = f"sqrt(greatest(({_VAR} - 2 * (em - bm) / vm * ev / (n - 1) + power((em - bm) / vm, 2) * vv / (n - 1)) / (vm * vm), 0))"


@query(_value({"mse": _normal("(em - bm)", f"sqrt({_VAR})"), "rmse": _normal("(sqrt(em) - sqrt(bm))", _RMSE_D), "R2": _normal("((bm - em) / vm)", _R2_D)}, RELATIVE, 6))
def mse_rmse_r2_delta(spark, sf_dir):
    return _ordered(stats.statistics(_joined(spark, sf_dir), ["mse", "rmse", "R2"], "ref"), 6)


LABEL_SCORES = f"{LABELS}, pw AS (SELECT obs_id, y, wobs, unnest([NULL, 1]::INTEGER[]) AS size, unnest([1 / (1 + exp(-(4 - 6 * size - toxic))), round(size, 2)]) AS mu, 0.0::DOUBLE AS lppd FROM l)"


def _label_scores(spark, sf_dir):
    rows = tables.labelled(spark, sf_dir)
    fits = F.array(F.struct(F.lit(None).cast("int").alias("size"), (1 / (1 + F.exp(-(4 - 6 * F.col("size") - F.col("toxic"))))).alias("mu")), F.struct(F.lit(1).alias("size"), F.round("size", 2).alias("mu")))
    return rows.select("obs_id", "y", "wobs", F.inline(fits)).withColumn("lppd", F.lit(0.0))


_ACC = _normal("cm", "(sqrt(cc / (n - 1)) / sqrt(n))")


@query(f"WITH {LABEL_SCORES}, {RELATIVE} SELECT coalesce(size, -1) AS size, 'acc' AS statistic, round({_ACC[0]}, 6) AS value, round({_ACC[1]}, 6) AS se, round({_ACC[2]}, 6) AS lq, round({_ACC[3]}, 6) AS uq FROM s")
def accuracy_delta(spark, sf_dir):
    return _ordered(stats.statistics(_label_scores(spark, sf_dir), ["acc"], "ref"), 6)


AUC = """tied AS (SELECT {by} mu, sum(CASE WHEN y = 0 THEN wobs ELSE 0 END) AS w0, sum(CASE WHEN y = 1 THEN wobs ELSE 0 END) AS w1 FROM pw GROUP BY {by} mu),
ranked AS (SELECT *, coalesce(sum(w1) OVER ({part} ORDER BY mu DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied)"""


@query(f"WITH {LABEL_SCORES}, {AUC.format(by='size,', part='PARTITION BY size')} SELECT coalesce(size, -1) AS size, round(sum(w0 * (before + w1 / 2)) / (sum(w0) * sum(w1)), 8) AS auc FROM ranked GROUP BY size")
def auc_with_ties(spark, sf_dir):
    rows = _label_scores(spark, sf_dir).withColumn("size", F.coalesce("size", F.lit(-1)))
    return stats.auc(rows, ["size"]).select("size", shown("auc", 8).alias("auc"))


@query(f"WITH {LABEL_SCORES.replace('obs_id, y, wobs, unnest', 'obs_id, y, (1 + obs_id % 3)::DOUBLE AS wobs, unnest')}, {AUC.format(by='size,', part='PARTITION BY size')} SELECT coalesce(size, -1) AS size, round(sum(w0 * (before + w1 / 2)) / (sum(w0) * sum(w1)), 8) AS auc FROM ranked GROUP BY size")
def auc_weighted(spark, sf_dir):
    rows = _label_scores(spark, sf_dir).withColumns({"size": F.coalesce("size", F.lit(-1)), "wobs": (1 + F.col("obs_id") % 3).cast("double")})
    return stats.auc(rows, ["size"]).select("size", shown("auc", 8).alias("auc"))


REPLICATES = 40


def _poisson_cdf(n: int) -> list[float]:
    p = upto = math.exp(-1.0)
    out = [upto]
    for k in range(1, n):
        p *= 1.0 / k
        upto += p
        out.append(upto)
    return out


#: Poisson numbers of mean one, keyed by observation, replicate and side; replicate 0 is the data itself.
_TAKEN = "CASE WHEN r = 0 THEN 1 ELSE " + " + ".join(f"(u > {c!r})::INT" for c in _poisson_cdf(14)) + " END"


@query(f"""WITH {LABEL_SCORES},
s AS (SELECT *, ('0x' || substr(md5(obs_id || ':5'), 1, 8))::BIGINT AS s1, ('0x' || substr(md5(obs_id || ':5'), 9, 8))::BIGINT AS s2 FROM pw),
u AS (SELECT coalesce(size, -1) AS size, r, y, mu, ((s1 + (2 * r + y::BIGINT) * s2) % 4294967296 + 0.5) / 4294967296 AS u FROM s, range({REPLICATES + 1}) t(r)),
tied AS (SELECT size, r, mu, sum(CASE WHEN y = 0 THEN {_TAKEN} ELSE 0 END) AS w0, sum(CASE WHEN y = 1 THEN {_TAKEN} ELSE 0 END) AS w1 FROM u GROUP BY size, r, mu),
ranked AS (SELECT *, coalesce(sum(w1) OVER (PARTITION BY size, r ORDER BY mu DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tied),
a AS (SELECT size, r, sum(w0 * (before + w1 / 2)) / (sum(w0) * sum(w1)) AS auc FROM ranked GROUP BY size, r),
d AS (SELECT a.size, a.r, a.auc, a.auc - b.auc AS diff FROM a JOIN a b ON a.r = b.r AND b.size = -1)
SELECT size, round(max(auc) FILTER (r = 0), 7) AS auc, round(stddev_samp(auc) FILTER (r > 0), 7) AS se, round(quantile_cont(auc, {stats.ALPHA / 2!r}) FILTER (r > 0), 7) AS lq, round(quantile_cont(auc, {1 - stats.ALPHA / 2!r}) FILTER (r > 0), 7) AS uq,
  round(max(diff) FILTER (r = 0), 7) AS diff, round(stddev_samp(diff) FILTER (r > 0), 7) AS diff_se FROM d GROUP BY size""")
def auc_summary(spark, sf_dir):
    """The AUC by size with standard errors, bounds and differences, over replicates of one sorted sweep."""
    rows = _label_scores(spark, sf_dir)
    here, less = (stats.auc_statistics(rows, b, replicates=REPLICATES, seed=5) for b in (None, "ref"))
    less = less.select(F.coalesce("size", F.lit(-1)).alias("size"), F.col("value").alias("diff"), F.col("se").alias("diff_se"))
    out = here.withColumn("size", F.coalesce("size", F.lit(-1))).join(less, "size")
    return out.select("size", shown("value", 7).alias("auc"), *[shown(c, 7).alias(c) for c in ("se", "lq", "uq", "diff", "diff_se")])


@query(f"""WITH {LABELS}, b AS (SELECT y, wobs, size AS mu, (row_number() OVER (ORDER BY obs_id) - 1) AS slot, (count(*) OVER ())::BIGINT AS n FROM l),
d AS (SELECT r AS replicate, {keyed_sql("r * n + slot", 3)} % n AS slot FROM b, range({REPLICATES}) t(r)),
pw AS (SELECT replicate, y, wobs, mu FROM d JOIN b USING (slot)),
{AUC.format(by="replicate,", part="PARTITION BY replicate")},
a AS (SELECT replicate, sum(w0 * (before + w1 / 2)) / (sum(w0) * sum(w1)) AS auc FROM ranked GROUP BY replicate)
SELECT round(stddev_samp(auc), 6) AS se, round(quantile_cont(auc, {stats.ALPHA / 2!r}), 6) AS lq, round(quantile_cont(auc, {1 - stats.ALPHA / 2!r}), 6) AS uq FROM a""")
def bootstrap_auc(spark, sf_dir):
    rows = tables.labelled(spark, sf_dir)
    hashed = cut(rows.select("obs_id", "y", "wobs", F.col("size").alias("mu")))
    n = hashed.count()
    slots = prefix_sums(hashed.withColumn("one", F.lit(1)), "obs_id", ["one"]).withColumn("slot", F.lit(n - 1) - F.col("before_one"))
    out = stats.bootstrap_auc(slots.select("slot", "y", "mu", "wobs"), n, "slot", REPLICATES, 3)
    return out.select(*[shown(c).alias(c) for c in ("se", "lq", "uq")])


@query("SELECT l_returnflag, round(sqrt(any_value(n) / (any_value(n) - 1) * sum(l_quantity * power(l_discount - m, 2)) / sum(l_quantity)), 8) AS wsd FROM lineitem JOIN (SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_discount) / sum(l_quantity) AS m FROM lineitem GROUP BY l_returnflag) USING (l_returnflag) GROUP BY l_returnflag")
def weighted_sd_by_group(spark, sf_dir):
    out = stats.weighted_sd(tables.read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return out.select("l_returnflag", shown("wsd", 8).alias("wsd"))


@query("""WITH r AS (SELECT o_totalprice / 1000 AS y, round(o_totalprice / 1000, 0) + 1 AS a, o_orderkey % 7 = 0 AS m FROM orders),
f AS (SELECT count(*)::DOUBLE AS n_all, count_if(m)::DOUBLE AS n_m, sum(a) AS t, sum(a * a) AS t2, sum(CASE WHEN m THEN y - a END) / count_if(m) AS em, sum(CASE WHEN m THEN y * y - a * a END) / count_if(m) AS qm FROM r),
v AS (SELECT sum(CASE WHEN m THEN power(y - a - em, 2) END) / (any_value(n_m) - 1) AS ve FROM r, f),
e AS (SELECT n_all, t, t2, n_all * em AS te, n_all * qm AS tq, n_all * n_all * (1 - n_m / n_all) * ve / n_m AS vy, t + n_all * em AS y_hat FROM f, v)
SELECT round(y_hat, 3) AS y_hat, round(vy, 2) AS v_y_hat, round(t2 + tq - (te * te - vy + 2 * t * y_hat - t * t) / n_all, 0) AS hat_v_y FROM e""")
def srs_difference_estimator(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("y"), (F.round(F.col("o_totalprice") / 1000, 0) + 1).alias("a"), (F.col("o_orderkey") % 7 == 0).alias("m"))
    out = stats.difference_estimate(o, "a", "y", "m")
    return out.select(shown("y_hat", 3).alias("y_hat"), shown("v_y_hat", 2).alias("v_y_hat"), shown("hat_v_y", 0).alias("hat_v_y"))


# Exact values for a third of the observations, rounded means as the approximation of all.

SUBSAMPLED = f"""{POINTWISE},
fast AS (SELECT obs_id, y, quantity AS w, price * (1 - discount) * (1 + tax) + discount AS mu_ref, {keyed_sql("obs_id", 4)} % 3 = 0 AS m, unnest([0, 1, 2]::INTEGER[]) AS size, unnest([40.0, price, price * (1 - discount)]) AS mu FROM items),
errors AS (SELECT *, round_even(mu, 0) + 0.25 AS mu_fast, 0.5 * ln(2 * pi()) + ln(2.0) AS c FROM fast),
dens AS (SELECT *, -c - 0.5 * power((y - mu) / 2, 2) AS lppd, -c - 0.5 * power((y - mu_fast) / 2, 2) AS lppd_fast, -c - 0.5 * power((y - mu_ref) / 2, 2) AS lppd_ref FROM errors),
cells AS (SELECT size, y, w, m, lppd - {{lppd_b}} AS d_y, lppd_fast - {{lppd_b}} AS d_a, power(mu - y, 2) AS e_y, power(mu_fast - y, 2) AS e_a, {{e_b}} AS b FROM dens),
long2 AS (SELECT size, 'd' AS t, 1.0::DOUBLE AS w, m, d_a AS a, d_y AS x FROM cells UNION ALL SELECT size, 'e', w, m, e_a, e_y FROM cells),
tot AS (SELECT size, t, count(*)::DOUBLE AS n, count_if(m)::DOUBLE AS k, sum(CASE WHEN m THEN w END) AS sm, count(*) * sum(w * a) / sum(w) AS ta, count(*) * sum(w * a * a) / sum(w) AS t2,
  count(*) * sum(CASE WHEN m THEN w * (x - a) END) / sum(CASE WHEN m THEN w END) AS te, count(*) * sum(CASE WHEN m THEN w * (x * x - a * a) END) / sum(CASE WHEN m THEN w END) AS tq FROM long2 GROUP BY size, t),
spread AS (SELECT size, t, any_value(n * n * (1 - k / n) / (k - 1)) * sum(CASE WHEN m THEN w / sm * power(x - a - te / n, 2) END) AS vs FROM long2 JOIN tot USING (size, t) GROUP BY size, t),
est AS (SELECT size, t, n, ta + te AS total, ta / n AS fast_mean, vs + t2 + tq - (te * te - vs + 2 * ta * (ta + te) - ta * ta) / n AS var FROM tot JOIN spread USING (size, t)),
mid AS (SELECT size, sum(w) AS sw, sum(CASE WHEN m THEN w END) AS sm, sum(w * y) / sum(w) AS ym, sum(w * b) / sum(w) AS bm FROM cells GROUP BY size),
mid2 AS (SELECT size, sum(w * power(y - ym, 2)) / any_value(sw) AS vm FROM cells JOIN mid USING (size) GROUP BY size),
pairs AS (SELECT size, w, m, sw, sm, n, vm, e_a - fast_mean AS ca, e_y - total / n AS cy, b - bm AS cb, power(y - ym, 2) - vm AS cv FROM cells JOIN mid USING (size) JOIN mid2 USING (size) JOIN est USING (size) WHERE t = 'e'),
co AS (SELECT size, any_value(n) AS n, any_value(vm) AS vm, sum(w / sw * cb * cb) AS bb, sum(w / sw * cv * cv) AS vv, sum(w / sw * ca * cb) + sum(CASE WHEN m THEN w / sm * (cy - ca) * cb END) AS eb,
  sum(w / sw * (ca - {{own}}) * cv) + sum(CASE WHEN m THEN w / sm * (cy - ca) * cv END) AS ev FROM pairs GROUP BY size),
s AS (SELECT size, co.n, d.total / co.n AS dm, sqrt(d.var) AS sed, e.total / co.n AS em, e.var / co.n / co.n AS ve, bm, vm, bb / (co.n - 1) AS vb, eb / (co.n - 1) AS ceb, ev / (co.n - 1) AS cev, vv / (co.n - 1) AS vy
  FROM co JOIN mid USING (size) JOIN (FROM est WHERE t = 'd') d USING (size) JOIN (FROM est WHERE t = 'e') e USING (size))"""


def _subsampled(spark, sf_dir):
    rows = _pointwise(spark, sf_dir).filter(F.col("size").isNotNull()).withColumn("mu_fast", F.bround("mu", 0) + 0.25)
    return rows.withColumns({"lppd_fast": families.gaussian().log_lik(F.col("y"), F.col("mu_fast"), F.lit(1.0), F.lit(2.0)), "sampled": keyed(F.col("obs_id"), 4) % 3 == 0})


def _subsampled_sql(parts: dict[str, tuple[str, str, str, str]], lppd_b: str, e_b: str, own: str) -> str:
    rows = " UNION ALL ".join(f"SELECT size, '{k}' AS statistic, round({v}, 3) AS value, round({se}, 3) AS se, round({lo}, 3) AS lq, round({hi}, 3) AS uq FROM s" for k, (v, se, lo, hi) in parts.items())
    return f"WITH {SUBSAMPLED.format(lppd_b=lppd_b, e_b=e_b, own=own)} {rows}"


@query(_subsampled_sql({
    "elpd": _normal("(dm * n)", "sed"), "mlpd": _normal("dm", "(sed / n)"), "mse": _lognormal("em", "sqrt(ve)"), "rmse": _lognormal("sqrt(em)", "sqrt(ve / em / 4)"),
    "R2": _normal("(1 - em / vm)", "sqrt(greatest((ve - 2 * em / vm * cev + power(em / vm, 2) * vy) / (vm * vm), 0))"),
}, "0", "0.0::DOUBLE", "0"))
def subsampled_statistics(spark, sf_dir):
    return _ordered(stats.subsampled_statistics(_subsampled(spark, sf_dir), ["elpd", "mlpd", "mse", "rmse", "R2"]), 3)


_VAR_S = "greatest(ve - 2 * ceb + vb, 0)"


@query(_subsampled_sql({
    "elpd": _normal("(dm * n)", "sed"), "mse": _normal("(em - bm)", f"sqrt({_VAR_S})"), "rmse": _normal("(sqrt(em) - sqrt(bm))", "sqrt(greatest((ve / em - 2 * ceb / sqrt(em * bm) + vb / bm) / 4, 0))"),
    "R2": _normal("((bm - em) / vm)", f"sqrt(greatest(({_VAR_S} - 2 * (em - bm) / vm * cev + power((em - bm) / vm, 2) * vy) / (vm * vm), 0))"),
}, "lppd_ref", "power(mu_ref - y, 2)", "cb"))
def subsampled_statistics_delta(spark, sf_dir):
    return _ordered(stats.subsampled_statistics(_subsampled(spark, sf_dir), ["elpd", "mse", "rmse", "R2"], True), 3)


# Families on labelled documents and counts.

PROB = f"{LABELS}, p AS (SELECT y, lang, 1 / (1 + exp(-(4 - 6 * size))) AS m, 1 / (1 + exp(-(3.5 - 5 * size - toxic))) AS q FROM l)"


def _probabilities(spark, sf_dir):
    s, t = F.col("size"), F.col("toxic")
    return tables.labelled(spark, sf_dir).select("y", "lang", (1 / (1 + F.exp(-(4 - 6 * s)))).alias("m"), (1 / (1 + F.exp(-(3.5 - 5 * s - t)))).alias("q"))


@query(f"WITH {PROB} SELECT lang, round(avg(-(m * ln(q) + (1 - m) * ln(1 - q))), 8) AS ce FROM p GROUP BY lang")
def ce_binomial(spark, sf_dir):
    return _probabilities(spark, sf_dir).groupBy("lang").agg(shown(F.avg(families.binomial().cross_entropy(F.col("m"), F.col("q"))), 8).alias("ce"))


@query(f"WITH i AS ({tables.LINE_ITEMS_SQL}) SELECT returnflag, round(sum(quantity * (-2 * y * price + price * price)) / sum(quantity), 4) AS ce FROM i GROUP BY returnflag")
def ce_gaussian(spark, sf_dir):
    w = F.col("quantity")
    return tables.line_items(spark, sf_dir).groupBy("returnflag").agg(shown(F.sum(w * families.gaussian().cross_entropy(F.col("y"), F.col("price"))) / F.sum(w), 4).alias("ce"))


@query(f"WITH u AS ({tables.USER_COUNTS_SQL}) SELECT round(-avg(y * ln(1 + abs(x)) - (1 + abs(x))), 6) AS ce FROM u")
def ce_poisson(spark, sf_dir):
    return tables.user_counts(spark, sf_dir).agg(shown(F.avg(families.poisson().cross_entropy(F.col("y"), 1 + F.abs("x")))).alias("ce"))


CATS = """c AS (SELECT o_orderkey, o_orderpriority AS y, list_position((SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders), o_orderpriority) AS pos, ln(o_totalprice / 100000) AS eta FROM orders),
k AS (SELECT o_orderkey, y, pos, [1 / (1 + exp(-(t - eta))) FOR t IN [-1.5, -0.4, 0.4, 1.5]] AS u FROM c),
p AS (SELECT o_orderkey, y, pos, [u[1], u[2] - u[1], u[3] - u[2], u[4] - u[3], 1 - u[4]] AS pr FROM k)"""
THRESHOLDS = [-1.5, -0.4, 0.4, 1.5]


def _categories(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("y"), F.log(F.col("o_totalprice") / 100000).alias("eta"))
    return o.withColumn("pr", families.cumulative_probabilities(F.col("eta"), THRESHOLDS))


def _levels(spark, sf_dir):
    return [r[0] for r in tables.read(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]


@query(f"WITH {CATS} SELECT y, {', '.join(f'round(avg(pr[{i}]), 8) AS p{i}' for i in range(1, 6))} FROM p GROUP BY y")
def cumulative_link_probs(spark, sf_dir):
    return _categories(spark, sf_dir).groupBy("y").agg(*[shown(F.avg(F.get("pr", F.lit(i))), 8).alias(f"p{i + 1}") for i in range(5)])


@query(f"WITH {CATS}, b AS (SELECT y, list_position(pr, list_max(pr)) AS best FROM p) SELECT (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders)[best] AS best, count(*)::BIGINT AS n FROM b GROUP BY 1")
def category_argmax(spark, sf_dir):
    return _categories(spark, sf_dir).groupBy(arrays.best_category(F.col("pr"), _levels(spark, sf_dir)).alias("best")).agg(F.count("*").alias("n"))


@query(f"WITH {CATS} SELECT round(sum(ln(pr[pos])), 6) AS ll, round(avg(-list_sum([0.2 * ln(q) FOR q IN pr])), 8) AS ce FROM p")
def category_scores(spark, sf_dir):
    rows, uniform = _categories(spark, sf_dir), arrays.doubles([0.2] * 5)
    ll = families.category_log_lik(F.col("pr"), F.col("y"), _levels(spark, sf_dir), F.lit(1.0))
    return rows.agg(shown(F.sum(ll)).alias("ll"), shown(F.avg(families.category_cross_entropy(uniform, F.col("pr"))), 8).alias("ce"))


@query(f"WITH {CATS}, x AS (SELECT unnest(range(1, 6)) AS pos, unnest(pr) AS w FROM p) SELECT (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) FROM orders)[pos] AS category, count(*)::BIGINT AS n, round(sum(w), 6) AS weight FROM x GROUP BY 1")
def augmented_expand(spark, sf_dir):
    long = design.over_categories(_categories(spark, sf_dir).select("o_orderkey", "pr"), "pr", _levels(spark, sf_dir))
    return long.groupBy("category").agg(F.count("*").alias("n"), shown(F.sum("prob")).alias("weight"))


@query(f"WITH {PROB} SELECT lang, round(sum(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS ll, round(sum(-2 * (y * ln(q) + (1 - y) * ln(1 - q))), 6) AS deviance FROM p GROUP BY lang")
def loglik_binomial(spark, sf_dir):
    b = families.binomial()
    return _probabilities(spark, sf_dir).groupBy("lang").agg(shown(F.sum(b.log_lik(F.col("y"), F.col("q"), F.lit(1.0)))).alias("ll"), shown(F.sum(b.deviance(F.col("y"), F.col("q"), F.lit(1.0)))).alias("deviance"))


@query(f"WITH u AS ({tables.USER_COUNTS_SQL}) SELECT round(sum(y * ln(1 + abs(x)) - (1 + abs(x)) - lgamma(y + 1)), 5) AS ll FROM u")
def loglik_poisson(spark, sf_dir):
    return tables.user_counts(spark, sf_dir).agg(shown(F.sum(families.poisson().log_lik(F.col("y"), 1 + F.abs("x"), F.lit(1.0))), 5).alias("ll"))


@query("WITH t AS (SELECT (20 + o_orderkey % 10)::DOUBLE AS n, (o_orderkey % 13)::DOUBLE AS y, 0.1 + (o_custkey % 7) / 10 AS p FROM orders) SELECT round(sum(lgamma(n + 1) - lgamma(y + 1) - lgamma(n - y + 1) + y * ln(p) + (n - y) * ln(1 - p)), 4) AS ll FROM t")
def loglik_binomial_trials(spark, sf_dir):
    t = tables.read(spark, sf_dir, "orders").select((20 + F.col("o_orderkey") % 10).cast("double").alias("n"), (F.col("o_orderkey") % 13).cast("double").alias("y"), (0.1 + (F.col("o_custkey") % 7) / 10).alias("p"))
    return t.agg(shown(F.sum(families.binomial().log_lik(F.col("y"), F.col("p"), F.col("n"))), 4).alias("ll"))


@query(f"""WITH i AS ({tables.LINE_ITEMS_SQL}) SELECT round(sum(quantity * (-0.5 * ln(2 * pi()) - ln(3.0) - 0.5 * power((y - price) / 3, 2))), 3) AS gaussian,
  round(sum(lgamma(2.5) - lgamma(2.0) - 0.5 * ln(4 * pi()) - ln(3.0) - 2.5 * ln(1 + power((y - price) / 3, 2) / 4)), 3) AS student, round(sum(2 * ln(2 / price) - lgamma(2.0) + ln(y) - 2 * y / price), 3) AS gamma FROM i""")
def loglik_continuous(spark, sf_dir):
    y, m, w = F.col("y"), F.col("price"), F.col("quantity")
    g, t, a = families.gaussian(), families.student_t(4.0), families.gamma()
    return tables.line_items(spark, sf_dir).agg(shown(F.sum(g.log_lik(y, m, w, F.lit(3.0))), 3).alias("gaussian"), shown(F.sum(t.log_lik(y, m, F.lit(1.0), F.lit(3.0))), 3).alias("student"), shown(F.sum(a.log_lik(y, m, F.lit(1.0), F.lit(2.0))), 3).alias("gamma"))


@query("""WITH p AS (SELECT 0.05 + (o_orderkey % 90) / 100 AS m FROM orders) SELECT round(sum(ln(m / (1 - m))), 6) AS logit, round(sum(ln(-ln(1 - m))), 6) AS cloglog, round(sum(tan(pi() * (m - 0.5))), 6) AS cauchit, round(sum(ln(m)), 6) AS log, round(sum(sqrt(m)), 6) AS sqrt, round(sum(1 / m), 6) AS inverse FROM p""")
def link_functions(spark, sf_dir):
    p = tables.read(spark, sf_dir, "orders").select((0.05 + (F.col("o_orderkey") % 90) / 100).alias("m"))
    return p.agg(*[shown(F.sum(families.link_of(n).link(F.col("m")))).alias(n) for n in ("logit", "cloglog", "cauchit", "log", "sqrt", "inverse")])


#: The normal distribution function by Simpson's rule, as SQL has none.
_PHI = "0.5 + e / 600 * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i % 200 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * power(i * e / 200, 2)))) / sqrt(2 * pi())"


@query(f"""WITH p AS (SELECT o_orderkey % 90 AS k, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT n, k / 30 - 1.51 AS e FROM p)
SELECT sum(n)::BIGINT AS n, round(sum(n / (1 + exp(-e))) / sum(n), 7) AS logit, round(sum(n * ({_PHI})) / sum(n), 7) AS probit, round(sum(n * (0.5 + atan(e) / pi())) / sum(n), 7) AS cauchit, round(sum(n * (1 - exp(-exp(e)))) / sum(n), 7) AS cloglog,
  round(sum(n * exp(e)) / sum(n), 7) AS log, round(sum(n * e * e) / sum(n), 7) AS sqrt, round(sum(n / e) / sum(n), 5) AS inverse FROM q""")
def inverse_links(spark, sf_dir):
    """Every inverse link at predictors around zero."""
    p = tables.read(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 90) / 30 - 1.51).alias("e"))
    names = ("logit", "probit", "cauchit", "cloglog", "log", "sqrt", "inverse")
    return p.agg(F.count("*").alias("n"), *[shown(F.avg(families.link_of(n).inverse(F.col("e"))), 5 if n == "inverse" else 7).alias(n) for n in names])


@query(f"""WITH p AS (SELECT 0.3 + (o_orderkey % 90) / 100 AS e, (o_orderkey % 7) / 2 + 0.5 AS y FROM orders)
SELECT round(avg(2 * (ln(e) + y / e)), 7) AS gamma, round(avg(6 * ln(1 + power((y - e) / 0.8, 2) / 5)), 7) AS student_t, round(avg(6 / (5 + power((y - e) / 0.8, 2))), 7) AS robust,
  round(avg(e + (y - (1 - exp(-exp(e)))) / exp(e - exp(e))), 6) AS cloglog_z, round(avg(power(exp(e - exp(e)), 2) / ((1 - exp(-exp(e))) * exp(-exp(e)))), 7) AS cloglog_w,
  round(avg(e + (y - e * e) / (2 * e)), 7) AS sqrt_z, round(avg(e + (y - 1 / e) * -(e * e)), 7) AS inverse_z, round(avg(power(1 / (e * e), 2) * e * e), 6) AS inverse_w FROM p""")
def working_responses(spark, sf_dir):
    """Deviances, working responses and weights of families and links beside the usual ones."""
    p = tables.read(spark, sf_dir, "orders").select((0.3 + (F.col("o_orderkey") % 90) / 100).alias("e"), ((F.col("o_orderkey") % 7) / 2 + 0.5).alias("y"))
    e, y, one, none = F.col("e"), F.col("y"), F.lit(1.0), F.lit(0.0)
    t = families.student_t(5.0)
    at = lambda family: family.pseudo_data(e, y, none, one)
    cloglog, root, inverse = at(families.binomial("cloglog")), at(families.poisson("sqrt")), at(families.gamma("inverse"))
    return p.agg(
        shown(F.avg(families.gamma().deviance(y, e, one)), 7).alias("gamma"), shown(F.avg(t.deviance(y, e, one, 0.8)), 7).alias("student_t"), shown(F.avg(t.pseudo_data(e, y, none, one, 0.8)["wobs"]), 7).alias("robust"),
        shown(F.avg(cloglog["z"]), 6).alias("cloglog_z"), shown(F.avg(cloglog["wobs"]), 7).alias("cloglog_w"), shown(F.avg(root["z"]), 7).alias("sqrt_z"), shown(F.avg(inverse["z"]), 7).alias("inverse_z"), shown(F.avg(inverse["wobs"]), 6).alias("inverse_w"),
    )


@query(f"WITH {PROB} SELECT lang, round(sum(y * ln(greatest(least(q, 1 - {families.EPS!r}), {families.EPS!r})) + (1 - y) * ln(1 - greatest(least(q, 1 - {families.EPS!r}), {families.EPS!r}))), 6) AS ll, count_if(round_even(q, 0) = y)::BIGINT AS correct FROM p GROUP BY lang")
def latent_binomial_oscale(spark, sf_dir):
    """A latent predictor taken to the response scale: likelihood and classification there."""
    latent = tables.labelled(spark, sf_dir).select("y", "lang", (3.5 - 5 * F.col("size") - F.col("toxic")).alias("eta"))
    q = families.link_of("logit").inverse(F.col("eta"))
    return latent.groupBy("lang").agg(shown(F.sum(families.binomial().log_lik(F.col("y"), q, F.lit(1.0)))).alias("ll"), F.count_if(F.bround(q, 0) == F.col("y")).alias("correct"))


# Posterior draws made from keys: S draws of a mean around the price.

DRAWS = f"""o AS (SELECT o_orderkey AS obs_id, o_totalprice / 100000 AS y, o_custkey AS k FROM orders),
d AS (SELECT obs_id, y, s::INTEGER AS s, y + 0.1 * sin(k + s) + (s % 5 - 2) / 20 AS m FROM o, range(1, {S + 1}) t(s))"""


def _drawn(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), (F.col("o_totalprice") / 100000).alias("y"), F.col("o_custkey").alias("k"))
    mu = F.transform(F.sequence(F.lit(1), F.lit(S)), lambda s: F.col("y") + 0.1 * F.sin(F.col("k") + s) + (s % 5 - 2) / 20)
    return o.select("obs_id", "y", F.lit(1.0).alias("wobs"), mu.alias("mu"))


CLUSTERING = draws.Clusters(tuple((s % 5) % 3 if s % 11 else None for s in range(1, S + 1)), tuple(1.0 + s % 4 for s in range(1, S + 1)))


@query(f"WITH {DRAWS}, i AS (SELECT round_even(1 + j * {S - 1} / 8, 0)::INTEGER AS s FROM range(9) t(j)) SELECT s, round(sum(m), 5) AS total FROM d JOIN i USING (s) GROUP BY s")
def thin_draws(spark, sf_dir):
    numbers = draws.thinned(S, 9)
    rows = _drawn(spark, sf_dir).select(F.posexplode(draws.picked(F.col("mu"), numbers)).alias("at", "m"))
    return rows.groupBy(F.get(F.array(*[F.lit(n) for n in numbers]), F.col("at")).alias("s")).agg(shown(F.sum("m"), 5).alias("total"))


CLUSTERS = "c AS (SELECT s::INTEGER AS s, (s % 5) % 3 AS c, 1 + s % 4 AS w FROM range(1, {n}) t(s) WHERE s % 11 <> 0), n AS (SELECT s, c, w / sum(w) OVER (PARTITION BY c) * (1 - 1e-10) AS ws FROM c)".format(n=S + 1)


@query(f"WITH {DRAWS}, {CLUSTERS}, a AS (SELECT obs_id, c, sum(ws * m) AS m FROM d JOIN n USING (s) GROUP BY obs_id, c) SELECT c::INTEGER AS cluster, round(sum(m), 5) AS total, round(sum(m * m), 5) AS squares FROM a GROUP BY c")
def cluster_means(spark, sf_dir):
    rows = _drawn(spark, sf_dir).select(F.posexplode(draws.aggregated(F.col("mu"), CLUSTERING)).alias("cluster", "m"))
    return rows.groupBy("cluster").agg(shown(F.sum("m"), 5).alias("total"), shown(F.sum(F.col("m") * F.col("m")), 5).alias("squares"))


@query(f"WITH {DRAWS}, {CLUSTERS}, a AS (SELECT obs_id, c, sum(ws * m) AS mm FROM d JOIN n USING (s) GROUP BY obs_id, c), v AS (SELECT obs_id, c, sum(ws * power(m - mm, 2)) + sum(ws * power(0.1 + s / 100, 2)) AS v FROM d JOIN n USING (s) JOIN a USING (obs_id, c) GROUP BY obs_id, c) SELECT c::INTEGER AS cluster, round(sum(v), 6) AS total FROM v GROUP BY c")
def predictive_variance(spark, sf_dir):
    dis = [0.1 + s / 100 for s in range(1, S + 1)]
    rows = _drawn(spark, sf_dir).select(F.posexplode(draws.predictive_variance(F.col("mu"), dis, CLUSTERING)).alias("cluster", "v"))
    return rows.groupBy("cluster").agg(shown(F.sum("v")).alias("total"))


@query(f"WITH {DRAWS}, {CLUSTERS}, v AS (SELECT s, regr_slope(m, y) AS value FROM d GROUP BY s) SELECT c::INTEGER AS cluster, round(sum(w * value) / sum(w), 8) AS value FROM c JOIN v USING (s) GROUP BY c")
def cluster_parameters(spark, sf_dir):
    """A parameter of every draw, its slope over the responses, averaged by cluster."""
    long = _drawn(spark, sf_dir).select("y", F.posexplode("mu").alias("at", "m"))
    slopes = long.groupBy((F.col("at") + 1).alias("s")).agg(F.regr_slope("m", "y").alias("value"))
    known = spark.createDataFrame([(s, c, w) for s, c, w in zip(range(1, S + 1), CLUSTERING.labels, CLUSTERING.weights, strict=True)], "s int, cluster int, weight double")
    return draws.mean_by_cluster(slopes.join(known, "s"), "cluster", "value", "weight").select("cluster", shown("value", 8).alias("value"))


def _sigma(s: int) -> float:
    return 0.2 + s / 200


LIK = f"{DRAWS}, ll AS (SELECT obs_id, s, m, -0.5 * ln(2 * pi()) - ln(0.2 + s / 200) - 0.5 * power((y + 0.05 - m) / (0.2 + s / 200), 2) AS ll FROM d)"


def _likelihoods(spark, sf_dir):
    rows = _drawn(spark, sf_dir).withColumn("y", F.col("y") + 0.05)
    return rows.withColumn("ll", evaluate.densities(F.col("mu"), families.gaussian(), [_sigma(s) for s in range(1, S + 1)]))


@query(f"WITH {LIK}, o2 AS (SELECT obs_id, ln(sum(exp(ll) / {S})) AS lppd, avg(m) AS mu FROM ll GROUP BY obs_id) SELECT count(*)::BIGINT AS n, round(sum(lppd), 5) AS lppd, round(sum(mu), 5) AS mu FROM o2")
def lppd_mixture(spark, sf_dir):
    rows = _drawn(spark, sf_dir).withColumn("y", F.col("y") + 0.05)
    out = evaluate.summarize(rows, "mu", families.gaussian(), [1 / S] * S, [_sigma(s) for s in range(1, S + 1)])
    return out.agg(F.count("*").alias("n"), shown(F.sum("lppd"), 5).alias("lppd"), shown(F.sum("mu"), 5).alias("mu"))


SIS = f"{LIK}, w AS (SELECT obs_id, m, ll, exp(-ll) / sum(exp(-ll)) OVER (PARTITION BY obs_id) AS w FROM ll)"


@query(f"WITH {SIS} SELECT round(max(w), 6) AS largest, round(sum(w * w), 5) AS squares, round(sum(ln(w)), 3) AS logs FROM w")
def sis_loo_weights(spark, sf_dir):
    lw = _likelihoods(spark, sf_dir).select(F.explode(loo.sis_weights(F.col("ll"))).alias("lw"))
    return lw.agg(shown(F.exp(F.max("lw"))).alias("largest"), shown(F.sum(F.exp(2 * F.col("lw"))), 5).alias("squares"), shown(F.sum("lw"), 3).alias("logs"))


@query(f"WITH {SIS}, o2 AS (SELECT obs_id, ln(sum(w * exp(ll))) AS lppd, sum(w * m) AS mu FROM w GROUP BY obs_id) SELECT round(sum(lppd), 5) AS elpd, round(stddev_samp(lppd) * sqrt(count(*)), 5) AS se, round(sum(mu), 5) AS mu FROM o2")
def loo_elpd(spark, sf_dir):
    rows = _likelihoods(spark, sf_dir).withColumn("lw", loo.sis_weights(F.col("ll")))
    out = loo.loo_summaries(rows, "ll", "mu", "lw")
    return out.agg(shown(F.sum("loo_lppd"), 5).alias("elpd"), shown(F.stddev_samp("loo_lppd") * F.sqrt(F.count("*")), 5).alias("se"), shown(F.sum("loo_mu"), 5).alias("mu"))


# The tail of the largest ratios is fitted on 32 points of a grid and replaced by quantiles of the fit.
_TAIL, _POINTS = loo.tail_length(S), 30 + int(loo.tail_length(S) ** 0.5)
_KEPT = S - _TAIL
PSIS = f"""{LIK}, q0 AS (SELECT *, min(ll) OVER (PARTITION BY obs_id) - ll AS lw FROM ll), q AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY lw, s) AS rk FROM q0),
t AS (SELECT obs_id, list(lw ORDER BY rk) AS sl FROM q GROUP BY obs_id), e AS (SELECT obs_id, exp(greatest(sl[{_KEPT}], -700)) AS base, list_transform(sl[{_KEPT + 1}:{S}], lambda v: exp(v) - exp(greatest(sl[{_KEPT}], -700))) AS x FROM t),
g AS (SELECT *, list_transform(range(1, {_POINTS + 1}), lambda j: 1 / x[{_TAIL}] + (1 - sqrt({_POINTS} / (j - 0.5))) / (3 * x[{int(_TAIL / 4 + 0.5)}])) AS th FROM e),
h AS (SELECT *, list_transform(th, lambda u: list_avg(list_transform(x, lambda v: ln(1 - u * v)))) AS kk FROM g),
p AS (SELECT *, list_transform(range(1, {_POINTS + 1}), lambda j: {_TAIL} * (ln(-th[j] / kk[j]) - kk[j] - 1)) AS pr FROM h), ws AS (SELECT *, list_transform(pr, lambda v: exp(v - list_max(pr))) AS ws FROM p),
z AS (SELECT obs_id, base, x, list_sum(list_transform(range(1, {_POINTS + 1}), lambda j: th[j] * ws[j])) / list_sum(ws) AS tz FROM ws), k AS (SELECT obs_id, base, tz, list_avg(list_transform(x, lambda v: ln(1 - tz * v))) AS k0 FROM z),
f AS (SELECT obs_id, base, (k0 * {_TAIL} + 5) / {_TAIL + 10} AS khat, -k0 / tz AS sc FROM k),
nw AS (SELECT q.*, khat, exp(CASE WHEN rk > {_KEPT} THEN least(ln(base + sc * (exp(-khat * ln(1 - (rk - {_KEPT} - 0.5) / {_TAIL})) - 1) / khat), 0) ELSE lw END) AS w FROM q JOIN f USING (obs_id))"""


@query(f"WITH {PSIS} SELECT obs_id, round(sum(m * w) / sum(w), 6) AS loo_mu, round(ln(sum(w * exp(ll)) / sum(w)), 6) AS loo_lppd, round(any_value(khat), 6) AS khat FROM nw GROUP BY obs_id")
def psis_loo(spark, sf_dir):
    """Pareto-smoothed leave-one-out: summaries by observation with the shape estimate."""
    rows = _likelihoods(spark, sf_dir).withColumn("p", loo.psis_weights(F.col("ll"))).withColumn("lw", F.col("p.lw"))
    return loo.loo_summaries(rows, "ll", "mu", "lw").select("obs_id", shown("loo_mu").alias("loo_mu"), shown("loo_lppd").alias("loo_lppd"), shown("p.khat").alias("khat"))


@query(f"WITH {PSIS} SELECT count(*)::BIGINT AS poor FROM f WHERE khat > {loo.shape_threshold(S)!r}")
def psis_poor_shapes(spark, sf_dir):
    """Observations whose importance weights can't be relied on."""
    rows = _likelihoods(spark, sf_dir).select(loo.psis_weights(F.col("ll"))["khat"].alias("khat"))
    return spark.createDataFrame([(loo.poor_shapes(rows, "khat", S, warn=False),)], "poor bigint")


# Folds and rankings.


@query(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {keyed_sql('o_orderkey', 5)}, o_orderkey) - 1) % 5 + 1)::INTEGER AS fold FROM orders")
def cv_folds_balanced(spark, sf_dir):
    return crossval.balanced_folds(tables.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, 5)


@query(f"WITH f AS (SELECT o_orderkey, ((row_number() OVER (ORDER BY {keyed_sql('o_orderkey', 5)}, o_orderkey) - 1) % 3 + 1)::INTEGER AS of FROM orders) SELECT k::INTEGER AS fold, CASE WHEN of = k THEN 'test' ELSE 'train' END AS part, count(*)::BIGINT AS n FROM f, range(1, 4) t(k) GROUP BY ALL")
def cv_train_test(spark, sf_dir):
    folded = crossval.balanced_folds(tables.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 5)
    return crossval.train_test(folded, "o_orderkey").groupBy("fold", "part").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey FROM orders ORDER BY {keyed_sql('o_orderkey', 9)}, o_orderkey LIMIT 25")
def loo_subsample(spark, sf_dir):
    return loo.subsample(tables.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 25, 9)


RANKS = """r AS (SELECT n_nationkey AS fold, p::INTEGER AS position, chr((97 + (p + n_nationkey // 12) % 3)::INTEGER) AS term FROM nation, range(1, 4) t(p))"""
PROPS = f"""{RANKS}, g AS (SELECT p::INTEGER AS size, t.term FROM range(1, 4) x(p), (VALUES ('a'), ('b'), ('c')) t(term)),
q AS (SELECT size, term, (SELECT count(*) FROM r WHERE position = size AND r.term = g.term) / (SELECT count(DISTINCT fold) FROM r WHERE position = size) AS prop FROM g)"""


def _ranks(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fold"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position"))
    return n.select("fold", "position", F.chr((97 + (F.col("position") + F.floor(F.col("fold") / 12)) % 3).cast("int")).alias("term"))


@query(f"WITH {PROPS} SELECT size, term, round(prop, 8) AS prop FROM q")
def cv_ranking_proportions(spark, sf_dir):
    return post.ranking_proportions(_ranks(spark, sf_dir), ["a", "b", "c"]).select("size", "term", shown("prop", 8).alias("prop"))


@query(f"WITH {PROPS} SELECT size, term, round(sum(prop) OVER (PARTITION BY term ORDER BY size), 8) AS prop FROM q")
def cv_ranking_cumulative(spark, sf_dir):
    return post.ranking_proportions(_ranks(spark, sf_dir), ["a", "b", "c"], cumulate=True).select("size", "term", shown("prop", 8).alias("prop"))


@query(f"WITH {POINTWISE}, {RELATIVE} SELECT coalesce(min(size) FILTER (size IS NOT NULL AND dm * n + {Z!r} * {_SE_D} >= 0.3 * (SELECT dm * n FROM s WHERE size = 0)), 2)::INTEGER AS suggested_size FROM s")
def suggest_size_rule(spark, sf_dir):
    return post.suggest_size(stats.statistics(_pointwise(spark, sf_dir), ["elpd"], "ref"), "elpd", 2, pct=0.3)


@query(f"WITH {POINTWISE}, {ABSOLUTE} SELECT size, round(dm, 6) AS mlpd, round({_SE_D} / n, 6) AS mlpd_se, round(em, 5) AS mse, round(sqrt(ee / (n - 1)), 6) AS mse_se FROM s WHERE size IS NOT NULL")
def performance_table(spark, sf_dir):
    out = post.performance_table(stats.statistics(_pointwise(spark, sf_dir), ["mlpd", "mse"]))
    return out.select("size", shown("mlpd").alias("mlpd"), shown("mlpd_se").alias("mlpd_se"), shown("mse", 5).alias("mse"), shown("mse_se").alias("mse_se"))


@query(f"WITH {PROPS} SELECT size, term, round_even(100 * prop, 0)::INTEGER::VARCHAR || ' %' AS percent FROM q")
def proportion_cells(spark, sf_dir):
    """The cells of the heat map of rankings over folds."""
    return post.proportions_data(post.ranking_proportions(_ranks(spark, sf_dir), ["a", "b", "c"])).select("size", "term", "percent")


@query(f"WITH {POINTWISE}, {ABSOLUTE} SELECT arg_min(size, em)::INTEGER AS size FROM s WHERE size IS NOT NULL")
def best_size(spark, sf_dir):
    return stats.best_size(stats.statistics(_pointwise(spark, sf_dir), ["mse"]), "mse")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS c_nationkey, (s_nationkey % 5 - 2) / 10 AS effect FROM supplier) SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(coalesce(effect, 0)), 6) AS effect FROM customer LEFT JOIN e USING (c_nationkey) GROUP BY c_mktsegment""")
def group_level_lookup(spark, sf_dir):
    """Effects of nations that have suppliers, looked up for customers; other nations are levels not seen before."""
    known = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), ((F.col("s_nationkey") % 5 - 2) / 10).alias("effect")).distinct()
    rows = evaluate.group_effects(tables.read(spark, sf_dir, "customer"), known, "c_nationkey", "effect")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), shown(F.sum("effect")).alias("effect"))


@query(f"SELECT o_orderkey % 10 AS bucket, sum({keyed_sql('o_orderkey', 2)})::BIGINT AS total FROM orders GROUP BY 1")
def keyed_numbers(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 10).alias("bucket")).agg(F.sum(keyed(F.col("o_orderkey"), 2)).alias("total"))


_CATEGORIES = ("low", "middle", "high")


@query(f"""WITH p AS (SELECT o_orderkey AS k, 0.2 + (o_orderkey % 7) / 20 AS a, 0.3::DOUBLE AS b FROM orders), d AS (SELECT k, a, b, j, (({keyed_sql("k * 3 + j", 8)}) + 0.5) / 4294967296 AS u FROM p, range(3) t(j))
SELECT CASE WHEN u < a THEN 'low' WHEN u < a + b THEN 'middle' ELSE 'high' END AS level, j::INTEGER AS draw, count(*)::BIGINT AS n FROM d GROUP BY 1, 2""")
def category_samples(spark, sf_dir):
    """Levels drawn by their probabilities, three for each order."""
    a = 0.2 + (F.col("obs_id") % 7) / 20
    o = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"))
    out = evaluate.sampled_categories(o, F.array(a, F.lit(0.3), 0.7 - a), list(_CATEGORIES), 3, 8)
    return out.select(F.posexplode("predicted").alias("draw", "level")).groupBy("level", "draw").agg(F.count("*").alias("n"))


@query(f"WITH {DRAWS}, i AS (SELECT s::INTEGER AS s FROM range(1, {S + 1}) t(s) ORDER BY {keyed_sql('s', 4)} LIMIT 7) SELECT s AS draw, round(sum(m), 5) AS total FROM d JOIN i USING (s) GROUP BY s")
def draw_subsample(spark, sf_dir):
    """Seven draws in keyed random order, with what each adds up to."""
    numbers = draws.subsampled(S, 7, 4)
    rows = _drawn(spark, sf_dir).select(F.posexplode(draws.picked(F.col("mu"), numbers)).alias("at", "m"))
    return rows.groupBy(F.get(F.array(*[F.lit(n) for n in numbers]), F.col("at")).alias("draw")).agg(shown(F.sum("m"), 5).alias("total"))


@query(f"""WITH i AS ({tables.LINE_ITEMS_SQL}), c AS (SELECT *, price * (1 - discount) * (1 + tax) + discount AS mu_ref, unnest([0, 1, 2]::INTEGER[]) AS size, unnest([40.0, price, price * (1 - discount)]) AS mu FROM i),
d AS (SELECT size, -0.5 * ln(2 * pi()) - ln(2.0) - 0.5 * power((y - mu) / 2, 2) AS own, -0.5 * ln(2 * pi()) - ln(2.0) - 0.5 * power((y - mu_ref) / 2, 2) AS ref FROM c),
s AS (SELECT size, count(*) AS n, sum(own) AS elpd, sum(ref) AS reference, avg(own - ref) AS dm, stddev_samp(own - ref) / sqrt(count(*)) AS se FROM d GROUP BY size)
SELECT size, 'elpd' AS statistic, round(elpd, 3) AS value, round(reference + n * (dm - {Z!r} * se), 3) AS lq, round(reference + n * (dm + {Z!r} * se), 3) AS uq, round(reference - 4, 3) AS threshold FROM s
UNION ALL SELECT size, 'gmpd', round(exp(elpd / n), 7), round(exp(reference / n) * exp(dm - {Z!r} * se), 7), round(exp(reference / n) * exp(dm + {Z!r} * se), 7), round(exp(reference / n) * exp(-4.0 / n), 7) FROM s""")
def plot_mixed(spark, sf_dir):
    """Points of every size with intervals of their differences to the reference model, and a line four below it."""
    rows = _pointwise(spark, sf_dir)
    here, less = (stats.statistics(rows, ["elpd", "gmpd"], b) for b in (None, "ref"))
    out = post.plot_data(here, ["price", "discount"], less, -4.0, tables.line_items(spark, sf_dir).count())
    rounded = lambda c: F.when(F.col("statistic") == "elpd", shown(c, 3)).otherwise(shown(c, 7)).alias(c)
    return out.select("size", "statistic", *[rounded(c) for c in ("value", "lq", "uq", "threshold")])


@query(f"WITH {POINTWISE}, {ABSOLUTE} SELECT size, ['(Intercept)', 'price', 'discount'][size + 1] AS term, round(em, 5) AS value, round((SELECT em FROM s WHERE size IS NULL), 5) AS reference FROM s WHERE size IS NOT NULL")
def plot_points(spark, sf_dir):
    out = post.plot_data(stats.statistics(_pointwise(spark, sf_dir), ["mse"]), ["price", "discount"])
    return out.select("size", "term", shown("value", 5).alias("value"), shown("reference", 5).alias("reference"))


@query(f"""WITH {LIK}, c AS (SELECT ll.obs_id AS obs_id, o.y AS y, m, ll.ll AS ll, ll.obs_id % 10 = 0 AS cens FROM ll JOIN o ON ll.obs_id = o.obs_id),
o2 AS (SELECT obs_id, ln(sum(exp(CASE WHEN cens THEN ln(1 / (1 + exp((y - m) / 0.3))) ELSE ll END) / {S})) AS lppd FROM c GROUP BY obs_id) SELECT round(sum(lppd), 4) AS elpd FROM o2""")
def censored_elpd(spark, sf_dir):
    """Right-censored rows count by a user's upper tail instead of a density."""
    rows = _likelihoods(spark, sf_dir)
    tail = F.transform("mu", lambda m: F.log(1 / (1 + F.exp((F.col("y") - 0.05 - m) / 0.3))))
    ll = F.when(F.col("obs_id") % 10 == 0, tail).otherwise(F.col("ll"))
    return rows.agg(shown(F.sum(arrays.log_weighted_mean_exp(ll, arrays.doubles([1 / S] * S))), 4).alias("elpd"))
