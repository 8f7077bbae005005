"""Queries on group-level terms, at covariances that are given, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.catalog.registry import query, shown
from lodestar.functions import families
from lodestar.operators import groups
from lodestar.operators.groups import INTERCEPT, Model
from lodestar.plans import grouped
from lodestar.sources import refmodel, tables

#: Cholesky factors of an intercept's, and of an intercept's and a slope's, covariance relative to the residual one.
A, B, C = 0.5, 0.2, 0.3
FACTORS = {(INTERCEPT,): [[A]], (INTERCEPT, "quantity"): [[A, 0.0], [B, C]]}
BLOCKS = ["quantity", "(1 | discount)", "quantity + (quantity | discount)"]

SUMS = f"""items AS ({tables.LINE_ITEMS_SQL}), own AS (SELECT discount, count(*)::DOUBLE AS n, sum(quantity) AS s, sum(quantity * quantity) AS t, sum(y) AS c, sum(quantity * y) AS e, sum(y * y) AS yy FROM items GROUP BY discount),
part AS (SELECT *, {A} * n + {B} * s AS u11, {C} * s AS u21, {A} * s + {B} * t AS u12, {C} * t AS u22, {A} * c + {B} * e AS v1, {C} * e AS v2,
  1 + {A * A} * n + {2 * A * B} * s + {B * B} * t AS p, {C} * ({A} * s + {B} * t) AS q, 1 + {C * C} * t AS r, 1 + {A * A} * n AS h, {A} * n AS a1, {A} * s AS a2, {A} * c AS av FROM own)"""


def _form(v: tuple[str, str], w: tuple[str, str]) -> str:
    return f"((r * {v[0]} * {w[0]} - q * ({v[0]} * {w[1]} + {v[1]} * {w[0]}) + p * {v[1]} * {w[1]}) / (p * r - q * q))"


def _model(name: str, forms: list[str], effect: tuple[str, str], slope: bool = True) -> str:
    """CTEs of one model: sums without the groups' effects, coefficients, and fitted values' scores."""
    xx11, xx12, xx22, xy1, xy2, yy = forms
    beta = f"(b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS beta0, (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS beta1, sum_n - 2 AS left_n" if slope else "b1 / a11 AS beta0, 0.0::DOUBLE AS beta1, sum_n - 1 AS left_n"
    return f"""{name}_v AS (SELECT sum(n) AS sum_n, sum(n - {xx11}) AS a11, sum(s - {xx12}) AS a12, sum(t - {xx22}) AS a22, sum(c - {xy1}) AS b1, sum(e - {xy2}) AS b2, sum(yy - {yy}) AS yv FROM part),
{name}_b AS (SELECT *, {beta} FROM {name}_v),
{name}_g AS (SELECT sum_n, beta0, beta1, sqrt((yv - beta0 * b1 - beta1 * b2) / left_n) AS sigma, n, s, t, c, e, beta0 + {effect[0]} AS f0, beta1 + {effect[1]} AS f1 FROM part, {name}_b),
{name} AS (SELECT any_value(beta0) AS beta0, any_value(beta1) AS beta1, any_value(sigma) AS sigma, sum(f0 * f0 * n + 2 * f0 * f1 * s + f1 * f1 * t - 2 * (f0 * c + f1 * e)) / any_value(sum_n) AS score FROM {name}_g)"""


_W = ("(v1 - u11 * beta0 - u12 * beta1)", "(v2 - u21 * beta0 - u22 * beta1)")
_T = (f"((r * {_W[0]} - q * {_W[1]}) / (p * r - q * q))", f"((p * {_W[1]} - q * {_W[0]}) / (p * r - q * q))")
_ONE = f"({A} * (av - a1 * beta0 - a2 * beta1) / h)"
MODELS = ", ".join([
    _model("slopes", [_form(("u11", "u21"), ("u11", "u21")), _form(("u11", "u21"), ("u12", "u22")), _form(("u12", "u22"), ("u12", "u22")), _form(("u11", "u21"), ("v1", "v2")), _form(("u12", "u22"), ("v1", "v2")), _form(("v1", "v2"), ("v1", "v2"))], (f"{A} * {_T[0]}", f"({B} * {_T[0]} + {C} * {_T[1]})")),
    _model("mixed", ["a1 * a1 / h", "a1 * a2 / h", "a2 * a2 / h", "a1 * av / h", "a2 * av / h", "av * av / h"], (_ONE, "0")),
    _model("levels", ["a1 * a1 / h", "0", "0", "a1 * av / h", "0", "av * av / h"], (_ONE, "0"), slope=False),
    _model("plain", ["0"] * 6, ("0", "0")),
    _model("empty", ["0"] * 6, ("0", "0"), slope=False),
])


@query(f"WITH {SUMS}, {MODELS} " + " UNION ALL ".join(f"SELECT '{m}' AS model, round(beta0, 6) AS intercept, round(beta1, 6) AS quantity, round(sigma, 6) AS sigma, round(score, 4) AS score FROM {m}" for m in ("slopes", "mixed", "levels")))
def group_level_fits(spark, sf_dir):
    """Mixed models of the charge: slopes and intercepts by discount, at given covariances."""
    items = tables.line_items(spark, sf_dir)
    m = groups.group_moments(items, {"quantity": F.col("quantity")}, F.array("y"), 1, "discount")
    models = {"slopes": Model((INTERCEPT, "quantity"), (INTERCEPT, "quantity")), "mixed": Model((INTERCEPT, "quantity"), (INTERCEPT,)), "levels": Model((INTERCEPT,), (INTERCEPT,))}
    fits = grouped.fitted(m, list(models.values()), FACTORS)
    rows = [(name, f.beta[INTERCEPT], f.beta.get("quantity", 0.0), f.sigma, f.score) for name, f in zip(models, fits, strict=True)]
    out = spark.createDataFrame(rows, "model string, intercept double, quantity double, sigma double, score double")
    return out.select("model", *[shown(c).alias(c) for c in ("intercept", "quantity", "sigma")], shown("score", 4).alias("score"))


@query(f"""WITH {SUMS}, {MODELS}, two AS (SELECT plain.score AS p, levels.score AS l FROM plain, levels)
SELECT 0 AS size, '(Intercept)' AS term, round(score, 4) AS ce FROM empty UNION ALL SELECT 1, CASE WHEN p <= l THEN 'quantity' ELSE '(1 | discount)' END, round(least(p, l), 4) FROM two
UNION ALL SELECT 2, CASE WHEN p <= l THEN '(1 | discount)' ELSE 'quantity' END, round(mixed.score, 4) FROM two, mixed UNION ALL SELECT 3, '(quantity | discount)', round(score, 4) FROM slopes""")
def group_level_search(spark, sf_dir):
    """A forward search in which slopes by discount enter behind what they need."""
    ref = refmodel.datafit(tables.line_items(spark, sf_dir), families.gaussian(), {"quantity": F.col("quantity")}, {"quantity": ["quantity"], "(quantity | discount)": []})
    path = grouped.varsel(ref, BLOCKS, factors=FACTORS).path
    return path.table(spark).select("size", "term", shown("ce", 4).alias("ce"))
