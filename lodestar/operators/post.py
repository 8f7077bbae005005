"""What is made of results: summaries, rankings over folds, suggested sizes and plot data."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.stats import is_utility


def performance_table(stats: DataFrame, diffs: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """One row for each submodel size: a column for each statistic, its se, bounds and differences.

    ``names`` are the statistics of the table; without them the table is run once to learn them.
    """
    rows = stats
    if diffs is not None:
        renamed = diffs.select("size", "statistic", F.col("value").alias("diff"), F.col("se").alias("diff_se"), F.col("lq").alias("diff_lower"), F.col("uq").alias("diff_upper"))
        rows = stats.join(renamed, ["size", "statistic"], "left")
    names = sorted(names) if names else [r.statistic for r in stats.select("statistic").distinct().orderBy("statistic").collect()]
    extra = ["diff", "diff_se", "diff_lower", "diff_upper"] if diffs is not None else []
    one = lambda s, c, n: F.max(F.when(F.col("statistic") == s, F.col(c))).alias(n)
    aggs = [a for s in names for a in [one(s, "value", s), one(s, "se", f"{s}_se"), one(s, "lq", f"{s}_lower"), one(s, "uq", f"{s}_upper"), *[one(s, c, f"{s}_{c}") for c in extra]]]
    return rows.filter(F.col("size").isNotNull()).groupBy("size").agg(*aggs)


def reference_performance(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("size").isNull()).select("statistic", "value", "se", "lq", "uq")


def ranking_proportions(ranks: DataFrame, order: list[str], cumulate: bool = False) -> DataFrame:
    """(size, term, prop): the share of folds that rank a term at a position, or up to it.

    ``ranks`` has fold, position and term; positions that a fold doesn't have count for nothing.
    """
    spark = ranks.sparkSession
    terms = spark.createDataFrame([(t,) for t in order], "term string")
    positions = spark.createDataFrame([(i + 1,) for i in range(len(order))], "size int")
    counts = ranks.groupBy(F.col("position").alias("size"), "term").agg(F.count("*").alias("n"))
    folds = ranks.groupBy(F.col("position").alias("size")).agg(F.countDistinct("fold").alias("folds"))
    grid = positions.crossJoin(F.broadcast(terms)).join(counts, ["size", "term"], "left").join(folds, "size", "left")
    out = grid.select("size", "term", (F.coalesce("n", F.lit(0)) / F.col("folds")).alias("prop"))
    if cumulate:
        out = out.withColumn("prop", F.sum("prop").over(Window.partitionBy("term").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))
    return out


def proportions_spec() -> str:
    """A Vega-Lite heat map for ``ranking_proportions``: terms by size, shaded by their share of folds."""
    cell = {"x": {"field": "size", "type": "ordinal", "title": "Submodel size"}, "y": {"field": "term", "type": "nominal", "sort": None, "title": "Predictor"}}
    share = {"field": "prop", "type": "quantitative", "scale": {"domain": [0, 1], "scheme": "blues"}, "title": "Share of folds"}
    layers = [{"mark": "rect", "encoding": {**cell, "color": share}}, {"mark": "text", "encoding": {**cell, "text": {"field": "percent", "type": "nominal"}}}]
    return json.dumps({"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "layer": layers})


def proportions_data(proportions: DataFrame) -> DataFrame:
    """``ranking_proportions`` with the label of each cell, for drawing."""
    return proportions.withColumn("percent", F.concat(F.bround(100 * F.col("prop"), 0).cast("int").cast("string"), F.lit(" %")))


def suggest_size(diffs: DataFrame, stat: str, largest: int, pct: float = 0.0, kind: str = "upper", thres_elpd: float | None = None, n_obs: int | None = None) -> DataFrame:
    """The smallest size whose bound of the difference to the reference reaches the cut-off, else the largest.

    The cut-off is a share of the empty model's difference; losses turn signs and bounds around. A
    size whose elpd difference is above ``thres_elpd`` (scaled for mlpd and gmpd) also counts.
    """
    sign = 1 if is_utility(stat) else -1
    bound = F.col("uq" if (kind == "upper") == (sign == 1) else "lq")
    rows = diffs.filter((F.col("statistic") == stat) & F.col("size").isNotNull())
    null = rows.filter("size = 0").select((sign * F.col("value")).alias("null_value"))
    cutoff = F.pow("null_value", F.lit(float(pct))) if stat == "gmpd" else pct * F.col("null_value")
    enough = sign * bound >= cutoff
    if thres_elpd is not None and stat in ("elpd", "mlpd", "gmpd"):
        scaled = {"elpd": thres_elpd, "mlpd": thres_elpd / (n_obs or 1), "gmpd": math.exp(thres_elpd / (n_obs or 1))}[stat]
        enough = enough | (F.col("value") > scaled)
    return rows.crossJoin(F.broadcast(null)).agg(F.coalesce(F.min(F.when(enough, F.col("size"))), F.lit(largest)).cast("int").alias("suggested_size"))


def plot_data(stats: DataFrame, ranking: list[str], diffs: DataFrame | None = None, thres_elpd: float | None = None, n_obs: int | None = None) -> DataFrame:
    """Points and intervals by size with the reference value and the term that entered, for drawing.

    With ``diffs``, statistics of differences to the reference, points stay as they are and intervals
    show the differences' uncertainty, set about the reference value (for gmpd a ratio, times it).
    ``thres_elpd`` adds the line that a difference in elpd over it would pass, scaled for mlpd and gmpd.
    """
    spark = stats.sparkSession
    names = spark.createDataFrame([(i, t) for i, t in enumerate(["(Intercept)", *ranking])], "size int, term string")
    ref = stats.filter(F.col("size").isNull()).select("statistic", F.col("value").alias("reference"))
    out = stats.filter(F.col("size").isNotNull()).join(ref, "statistic", "left").join(F.broadcast(names), "size", "left")
    about = lambda c: F.when(F.col("statistic") == "gmpd", F.col("reference") * F.col(c)).otherwise(F.col("reference") + F.col(c))
    if diffs is not None:
        own = diffs.select("size", "statistic", F.col("lq").alias("_lq"), F.col("uq").alias("_uq"))
        out = out.drop("lq", "uq").join(own, ["size", "statistic"], "left").withColumns({"lq": about("_lq"), "uq": about("_uq")}).drop("_lq", "_uq")
    if thres_elpd is None:
        return out
    if not n_obs:
        raise ValueError("a threshold needs the number of observations")
    line = F.when(F.col("statistic") == "elpd", thres_elpd).when(F.col("statistic") == "mlpd", thres_elpd / n_obs).when(F.col("statistic") == "gmpd", math.exp(thres_elpd / n_obs))
    return out.withColumn("_line", line).withColumn("threshold", about("_line")).drop("_line")


def plot_spec(statistic: str, threshold: bool = False) -> str:
    """A Vega-Lite specification for ``plot_data`` of one statistic, with its threshold line if it has one."""
    x = {"field": "size", "type": "ordinal", "title": "Submodel size"}
    value = {"field": "value", "type": "quantitative", "title": statistic, "scale": {"zero": False}}
    spec = {
        "$schema": "https://vega.github.io/schema/vega-lite/v5.json",
        "transform": [{"filter": f"datum.statistic == '{statistic}'"}],
        "layer": [
            {"mark": "rule", "encoding": {"x": x, "y": {"field": "lq", "type": "quantitative"}, "y2": {"field": "uq"}}},
            {"mark": {"type": "line", "point": True}, "encoding": {"x": x, "y": value, "tooltip": [{"field": "term"}, {"field": "value"}]}},
            {"mark": {"type": "rule", "strokeDash": [4, 4]}, "encoding": {"y": {"aggregate": "max", "field": "reference", "type": "quantitative"}}},
        ],
    }
    if threshold:
        spec["layer"].append({"mark": {"type": "rule", "strokeDash": [1, 3]}, "encoding": {"y": {"aggregate": "max", "field": "threshold", "type": "quantitative"}}})
    return json.dumps(spec)
