"""Model-matrix columns of terms: numbers, treatment contrasts, interactions and transformations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import formula as fm

_CALL = re.compile(r"^(I|sqrt|log|exp|abs|poly|scale)\((.*)\)$", re.S)


@dataclass(frozen=True)
class Design:
    """Columns for terms. ``levels`` lists the levels of factors, the first being the reference."""

    levels: dict[str, list[str]] = field(default_factory=dict)

    def columns(self, term: str) -> dict[str, Column]:
        """Named columns of a term; a factor has one for each level but the first."""
        parts = fm.split_top(term, ":")
        out: dict[str, Column] = {"": F.lit(1.0)}
        for part in parts:
            single = self._single(part.strip())
            out = {(f"{a}:{b}" if a else b): x * y for a, x in out.items() for b, y in single.items()}
        return out

    def _single(self, term: str) -> dict[str, Column]:
        if term in self.levels:
            return {f"{term}{v}": F.when(F.col(term) == v, 1.0).otherwise(0.0) for v in self.levels[term][1:]}
        if m := _CALL.match(term):
            name, inside = m[1], m[2]
            if name == "poly":
                args = fm.split_top(inside, ",")
                return {f"{term}{k}": F.pow(F.expr(spark_sql(args[0])), F.lit(float(k))) for k in range(1, int(args[1]) + 1)}
            value = F.expr(spark_sql(inside)).cast("double")
            return {term: {"I": value, "sqrt": F.sqrt(value), "log": F.log(value), "exp": F.exp(value), "abs": F.abs(value)}.get(name, value)}
        return {term: F.col(term).cast("double")}

    def matrix(self, df: DataFrame, terms: list[str], keep: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
        """``keep`` and the terms' columns, and each term's column names."""
        named = {t: self.columns(t) for t in terms}
        cols = {n: c for group in named.values() for n, c in group.items()}
        return df.select(*keep, *[c.alias(n) for n, c in cols.items()]), {t: list(g) for t, g in named.items()}


def spark_sql(text: str) -> str:
    """A formula's arithmetic as SQL: powers and negation differ."""
    text = re.sub(r"(\w+|\([^()]*\)|\w+\([^()]*\))\s*\^\s*(\w+)", r"power(\1, \2)", text)
    text = re.sub(r"as\.logical\((.*)\)", r"(\1)", text)
    return text.replace("!", "NOT ")


def levels_of(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Sorted levels of factors, from one aggregate."""
    if not names:
        return {}
    row = df.agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in names]).first()
    return {n: list(row[n]) for n in names}


def require_complete(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the columns with missing values."""
    kinds = dict(df.dtypes)
    missing = df.agg(*[F.count_if(F.col(n).isNull() | (F.isnan(n) if kinds[n] in ("double", "float") else F.lit(False))).alias(n) for n in names]).first()
    if bad := [n for n in names if missing[n]]:
        raise ValueError(f"missing values in {', '.join(bad)}")
    return df


def response(df: DataFrame, y: str, weights: str | None = None, offset: str | None = None, failures: str | None = None) -> DataFrame:
    """Adds y, wobs and offs as doubles; with failures, y counts successes and wobs all trials.

    A response of strings or booleans becomes 0 and 1, 1 for all but the first level. Negative or missing
    weights, and negative counts, are an error where they are read.
    """
    kind = df.select(F.expr(y).alias("y")).dtypes[0][1]
    value = F.expr(y).cast("double")
    if kind in ("string", "boolean"):
        levels = sorted(r[0] for r in df.select(F.expr(y).alias("y")).filter("y IS NOT NULL").distinct().limit(3).collect())
        if len(levels) != 2:
            raise ValueError(f"a response of names needs two levels, not {len(levels)}; more are categories")
        value = F.when(F.expr(y).isNotNull(), (F.expr(y) != levels[0]).cast("double"))
    wobs = (F.expr(y) + F.expr(failures)).cast("double") if failures else F.expr(weights or "1").cast("double")
    bad = wobs.isNull() | F.isnan(wobs) | (wobs < 0)
    if failures:
        bad = bad | (value < 0) | (F.expr(failures) < 0)
    checked = F.when(bad, F.raise_error("weights and counts of trials must be known and not negative")).otherwise(wobs)
    return df.withColumns({"y": value, "wobs": checked.cast("double"), "offs": F.expr(offset or "0").cast("double")})


def over_categories(df: DataFrame, probabilities: str, levels: list[str]) -> DataFrame:
    """One row for each observation and category, weighted by the category's probability."""
    return df.select("*", F.posexplode(probabilities).alias("at", "prob")).withColumn("category", F.element_at(F.array(*[F.lit(v) for v in levels]), F.col("at") + 1)).drop("at")


def trials(df: DataFrame, y: str, n: str) -> DataFrame:
    """One 0/1 row for each trial: the failures of an observation first."""
    return df.withColumn("trial", F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n).cast("int"))))).withColumn("outcome", F.when(F.col("trial") > F.col(n) - F.col(y), 1).otherwise(0))
