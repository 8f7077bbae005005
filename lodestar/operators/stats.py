"""Predictive performance statistics with standard errors and intervals, as aggregates of a pointwise table.

A pointwise table has one row for each model size and observation: size (null for the reference
model), obs_id, y, wobs, mu, lppd. Statistics of differences join it to a baseline model's rows by
observation. Second moments are taken around means that were aggregated before, in a second pass
over the same partitions; any missing input makes a statistic null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.keyed import INCREMENT, MODULUS, MULTIPLIER, keyed, prefix_sums

UTILITIES = ("elpd", "mlpd", "gmpd", "R2", "acc", "pctcorr", "auc")
LOSSES = ("mse", "rmse")
MOMENT_STATS = ("elpd", "mlpd", "gmpd", "mse", "rmse", "R2", "acc")
RESULT = ["size", "statistic", "value", "se", "lq", "uq"]
#: Coverage of intervals is 1 - alpha; this default covers one standard error either side.
ALPHA = 2 * NormalDist().cdf(-1)


def is_utility(stat: str) -> bool:
    if stat not in UTILITIES + LOSSES:
        raise ValueError(f"unknown statistic {stat}")
    return stat in UTILITIES


def complete(aggregate: Column, value: Column) -> Column:
    """The aggregate, or null if a value is missing."""
    return F.when(F.count("*") == F.count(value), aggregate)


def cut_zero(x: Column) -> Column:
    """Small negative rounding errors cut to zero; null stays null."""
    return F.when(x < 0, 0.0).otherwise(x)


def cut_root(x: Column) -> Column:
    return F.sqrt(cut_zero(x))


def weighted_sd(df: DataFrame, by: list[str], value: str, weight: str, name: str = "wsd") -> DataFrame:
    """Weighted standard deviation with n / (n - 1) by group; null for one row or missing values."""
    x, w = F.col(value), F.col(weight)
    means = df.groupBy(*by).agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), complete(F.sum(w * x), x).alias("_s"))
    joined = df.join(means, by) if by else df.crossJoin(F.broadcast(means))
    centered = F.sum(w * F.pow(x - F.col("_s") / F.col("_w"), 2)) / F.first("_w")
    out = joined.groupBy(*by).agg(centered.alias("_v"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    return out.select(*by, F.when((F.col("_n") > 1) & F.col("_s").isNotNull(), F.sqrt(F.col("_v") * F.col("_n") / (F.col("_n") - 1))).alias(name))


def with_baseline(pointwise: DataFrame, size: int | None) -> DataFrame:
    """Adds mu_b and lppd_b of the baseline model (null size: the reference) by observation.

    Rows that carry the reference's values are taken as they are; a join needs obs_id to be unique.
    """
    if size is None and "mu_ref" in pointwise.columns:
        return pointwise.withColumns({"mu_b": F.col("mu_ref"), "lppd_b": F.col("lppd_ref")})
    base = pointwise.filter(F.col("size").eqNullSafe(F.lit(size))).select("obs_id", F.col("mu").alias("mu_b"), F.col("lppd").alias("lppd_b"))
    return pointwise.join(base, "obs_id")


def statistics(pointwise: DataFrame, stats: list[str] | None = None, baseline: str | int | None = None, alpha: float = ALPHA) -> DataFrame:
    """(size, statistic, value, se, lq, uq) for the moment statistics; AUC has a function of its own.

    ``baseline`` is None for absolute values, "ref", or a size: then values are differences to it,
    gmpd a ratio. Intervals are normal, those of mse and rmse log-normal where there is no baseline.
    """
    stats = list(stats or MOMENT_STATS)
    for s in stats:
        is_utility(s)
    delta = baseline is not None
    rows = with_baseline(pointwise, None if baseline == "ref" else baseline) if delta else pointwise
    zero = F.lit(0.0)
    mu_b, lppd_b = (F.col("mu_b"), F.col("lppd_b")) if delta else (F.lit(None).cast("double"), zero)
    y, mu, w = F.col("y"), F.col("mu"), F.col("wobs")
    right = lambda m: (F.bround(m, 0) == y).cast("double")
    rows = rows.select("size", w.alias("w"), y.alias("y"), (F.col("lppd") - lppd_b).alias("d"), F.pow(mu - y, 2).alias("e"), (F.pow(mu_b - y, 2) if delta else zero).alias("b"), (right(mu) - (right(mu_b) if delta else zero)).alias("c"))
    mean = lambda c: complete(F.sum(F.col("w") * F.col(c)) / F.sum("w"), F.col(c))
    plain = lambda c: complete(F.avg(c), F.col(c))
    first = rows.groupBy("size").agg(F.count("*").alias("n"), F.sum("w").alias("sw"), mean("y").alias("ym"), mean("e").alias("em"), mean("b").alias("bm"), plain("d").alias("dm"), plain("c").alias("cm"))
    first = first.withColumnRenamed("size", "of")
    both = rows.join(F.broadcast(first), F.col("size").eqNullSafe(F.col("of")))
    v = F.pow(F.col("ym") - F.col("y"), 2)
    e, b, share = F.col("e") - F.col("em"), F.col("b") - F.col("bm"), F.col("w") / F.col("sw")
    # e and b are centered, so that v needs its mean taken off only in its own square.
    sums = both.groupBy("size").agg(
        *[F.first(c).alias(c) for c in ("n", "em", "bm", "dm", "cm")], F.sum(share * v).alias("vm"),
        F.sum(F.pow(F.col("d") - F.col("dm"), 2)).alias("dd"), F.sum(F.pow(F.col("c") - F.col("cm"), 2)).alias("cc"),
        F.sum(share * e * e).alias("ee"), F.sum(share * b * b).alias("bb"), F.sum(share * e * b).alias("eb"), F.sum(share * v * v).alias("vsq"), F.sum(share * (e - b if delta else e) * v).alias("ev"),
    )
    sums = sums.withColumn("vv", cut_zero(F.col("vsq") - F.col("vm") * F.col("vm")))
    n, less = F.col("n"), F.when(F.col("n") > 1, F.col("n") - 1)
    sums = sums.withColumns({
        "var_d": F.col("dd") / less * n, "var_c": F.col("cc") / less / n, "var_e": F.col("ee") / less, "var_b": F.col("bb") / less,
        "cov_eb": F.col("eb") / less, "var_y": F.col("vv") / less, "cov_ey": F.col("ev") / less,
    })
    return _results(sums, stats, delta, alpha)


def _results(sums: DataFrame, stats: list[str], delta: bool, alpha: float) -> DataFrame:
    """Values, standard errors and intervals by size.

    ``sums`` has the rows' number n, the means dm, cm, em, bm and vm of differences in log density, correctness,
    squared errors of model and baseline, and squares of y about its mean; var_d, the variance of the sum of d;
    variances of the other means, and the covariances of em with bm and of em (less bm) with vm.
    """
    n, em, bm, vm = (F.col(c) for c in ("n", "em", "bm", "vm"))
    var_e, var_b, cov, var_y, cov_y = (F.col(c) for c in ("var_e", "var_b", "cov_eb", "var_y", "cov_ey"))
    se_d = F.sqrt("var_d")
    var_mse = cut_zero(var_e - 2 * cov + var_b) if delta else var_e
    share_y = (em - bm if delta else em) / vm
    value = {
        "elpd": F.col("dm") * n, "mlpd": F.col("dm"), "gmpd": F.exp("dm"), "acc": F.col("cm"), "pctcorr": F.col("cm"),
        "mse": em - bm if delta else em, "rmse": F.sqrt(em) - F.sqrt(bm) if delta else F.sqrt(em), "R2": (bm - em) / vm if delta else 1 - em / vm,
    }
    acc_se = F.sqrt("var_c")
    rmse_var = (var_e / em - 2 * cov / F.sqrt(em * bm) + var_b / bm) / 4 if delta else var_e / em / 4
    se = {
        "elpd": se_d, "mlpd": se_d / n, "gmpd": se_d / n * F.exp("dm"), "acc": acc_se, "pctcorr": acc_se,
        "mse": F.sqrt(var_mse), "rmse": cut_root(rmse_var), "R2": cut_root((var_mse - 2 * share_y * cov_y + share_y * share_y * var_y) / (vm * vm)),
    }
    z = NormalDist().inv_cdf(1 - alpha / 2)
    out = []
    for s in stats:
        low, high = value[s] - z * se[s], value[s] + z * se[s]
        if s in LOSSES and not delta:
            ratio = F.pow(se[s] / value[s], 2)
            center, spread = F.log(value[s] / F.sqrt(1 + ratio)), F.sqrt(F.log1p(ratio))
            low, high = F.exp(center - z * spread), F.exp(center + z * spread)
        if s == "gmpd":
            low, high = F.exp(F.col("dm") - z * se_d / n), F.exp(F.col("dm") + z * se_d / n)
        out.append(F.struct(F.lit(s).alias("statistic"), value[s].alias("value"), se[s].alias("se"), low.alias("lq"), high.alias("uq")))
    return sums.select("size", F.inline(F.array(*out)))


#: What every size keeps of its rows: weighted moments of y about a shift, its square, and the squared errors of
#: submodel and reference; plain ones of log density and correctness, and of their differences to the reference.
WEIGHTED, PLAIN = 4, 4
SUMS = "size int, n bigint, poor bigint, sums binary"


class Moments:
    """Means and products about them of rows seen so far, for one size; batches and parts are added pairwise."""

    def __init__(self, shift: float) -> None:
        self.n, self.poor, self.shift, self.weight = 0, 0, shift, 0.0
        self.mean, self.products = np.zeros(WEIGHTED), np.zeros((WEIGHTED, WEIGHTED))
        self.plain, self.squares = np.zeros(PLAIN), np.zeros(PLAIN)

    @classmethod
    def of(cls, shift: float, y: np.ndarray, w: np.ndarray, mu: np.ndarray, lppd: np.ndarray, mu_ref: np.ndarray, lppd_ref: np.ndarray) -> Moments:
        right = lambda m: ((r := np.round(m)) == y) | (np.isnan(r) & np.isnan(y))
        out, off = cls(shift), y - shift
        hit, hit_ref = right(mu).astype(float), right(mu_ref).astype(float)
        z = np.stack([off, off * off, (mu - y) ** 2, (mu_ref - y) ** 2])
        d = np.stack([lppd, lppd - lppd_ref, hit, hit - hit_ref])
        out.n, out.weight = len(y), float(w.sum())
        with np.errstate(invalid="ignore"):
            out.mean, out.plain = (z @ w / out.weight if out.weight else np.zeros(WEIGHTED)), d.mean(axis=1)
            z, d = z - out.mean[:, None], d - out.plain[:, None]
            out.products, out.squares = (z * w) @ z.T, (d * d).sum(axis=1)
        return out

    def add(self, other: Moments) -> None:
        """Both must have the same shift."""
        n, weight = self.n + other.n, self.weight + other.weight
        share, wide = other.n / n if n else 0.0, other.weight / weight if weight else 0.0
        with np.errstate(invalid="ignore"):
            far, off = other.mean - self.mean, other.plain - self.plain
            self.products = self.products + other.products + self.weight * wide * np.outer(far, far)
            self.squares = self.squares + other.squares + self.n * share * off * off
            self.mean, self.plain = self.mean + wide * far, self.plain + share * off
        self.n, self.poor, self.weight = n, self.poor + other.poor, weight

    def about(self, shift: float) -> Moments:
        """The same rows with y about another shift: its square is the old one plus multiples of y."""
        move, out = self.shift - shift, Moments(shift)
        lift = np.eye(WEIGHTED)
        lift[1, 0] = 2 * move
        out.n, out.poor, out.weight, out.plain, out.squares = self.n, self.poor, self.weight, self.plain, self.squares
        out.mean = lift @ self.mean + np.array([move, move * move, 0.0, 0.0])
        out.products = lift @ self.products @ lift.T
        return out

    def packed(self) -> bytes:
        return np.concatenate([[self.shift, self.weight], self.mean, self.products.ravel(), self.plain, self.squares]).tobytes()

    @classmethod
    def unpacked(cls, n: int, poor: int, sums: bytes) -> Moments:
        flat = np.frombuffer(sums, float)
        out = cls(float(flat[0]))
        out.n, out.poor, out.weight = n, poor, float(flat[1])
        out.mean, rest = flat[2 : 2 + WEIGHTED], flat[2 + WEIGHTED :]
        out.products, rest = rest[: WEIGHTED**2].reshape(WEIGHTED, WEIGHTED), rest[WEIGHTED**2 :]
        out.plain, out.squares = rest[:PLAIN], rest[PLAIN:]
        return out


def merged(partial: DataFrame) -> DataFrame:
    """One row for each size of the tasks' ``SUMS``, in the same form, y about its weighted mean."""

    def add(table: pa.Table) -> pa.Table:
        parts = [Moments.unpacked(r["n"], r["poor"], r["sums"]) for r in sorted(table.to_pylist(), key=lambda r: r["sums"])]
        weight = sum(m.weight for m in parts)
        center = sum(m.weight * (m.shift + m.mean[0]) for m in parts) / weight if weight else 0.0
        out = Moments(center)
        for m in parts:
            out.add(m.about(center))
        return pa.table({"size": table.column("size").slice(0, 1), "n": pa.array([out.n]), "poor": pa.array([out.poor]), "sums": pa.array([out.packed()], pa.binary())})

    return partial.groupBy("size").applyInArrow(add, SUMS)


MOMENTS = "size int, n bigint, dm double, cm double, em double, bm double, vm double, var_d double, var_c double, var_e double, var_b double, cov_eb double, var_y double, cov_ey double"


def moment_rows(found: list, delta: bool) -> list[tuple]:
    """Rows of ``MOMENTS`` from those of ``merged``: of the values themselves, or of differences to the reference."""
    out = []
    for r in found:
        m = Moments.unpacked(r["n"], r["poor"], bytes(r["sums"]))
        less, c = (m.n - 1 if m.n > 1 else None), m.products / m.weight if m.weight else np.full_like(m.products, np.nan)
        per = lambda v: None if less is None else float(v) / less  # noqa: E731, B023
        d, hit = (1, 3) if delta else (0, 2)
        on = 1.0 if delta else 0.0
        mean = m.mean if m.weight else np.full(WEIGHTED, np.nan)
        cells = [m.plain[d], m.plain[hit], mean[2], mean[3] if delta else 0.0, mean[1]]
        spread = [per(m.squares[d] * m.n), per(m.squares[hit] / m.n), per(c[2, 2]), per(c[3, 3] if delta else 0.0), per(c[2, 3] if delta else 0.0), per(max(c[1, 1], 0.0) if c[1, 1] == c[1, 1] else c[1, 1]), per(c[2, 1] - (on * c[3, 1] if delta else 0.0))]
        out.append((r["size"], m.n, *[float(v) for v in cells], *spread))
    return out


def moment_statistics(rows: DataFrame, stats: list[str], delta: bool, alpha: float = ALPHA) -> DataFrame:
    """``statistics`` from rows of ``MOMENTS``."""
    for s in stats:
        is_utility(s)
    return _results(rows, stats, delta, alpha)


def subsampled_statistics(pointwise: DataFrame, stats: list[str] | None = None, delta: bool = False, alpha: float = ALPHA) -> DataFrame:
    """The moment statistics where exact values are known for a simple random sample of the observations only.

    Rows have mu and lppd, read where ``sampled`` is true (null counts as false), and mu_fast and lppd_fast, the
    approximations known everywhere; with ``delta`` also mu_ref and lppd_ref. Values come from the difference
    estimator; standard errors hold its own variance and the estimated variance between observations. A size
    whose rows are all sampled gets the plain statistics. A missing input makes a statistic null, as does a
    size without, or with a single, sampled row. AUC has no such estimator and is an error.
    """
    stats = list(stats or MOMENT_STATS)
    for s in stats:
        is_utility(s)
        if s == "auc":
            raise ValueError("the AUC can't be estimated from a subsample")
    zero, y, m = F.lit(0.0), F.col("y"), F.coalesce("sampled", F.lit(False))
    ref = F.pow(F.col("mu_ref") - y, 2) if delta else zero
    hit = lambda mu: (F.bround(mu, 0) == y).cast("double")
    less_ref = lambda c, r: F.col(c) - F.col(r) if delta else F.col(c)
    hits = lambda c: hit(F.col(c)) - (hit(F.col("mu_ref")) if delta else zero)
    known = lambda c: F.when(m, c)
    rows = pointwise.select(
        "size", F.col("wobs").alias("w"), m.alias("m"), y.alias("y"), ref.alias("b"),
        less_ref("lppd_fast", "lppd_ref").alias("d_a"), known(less_ref("lppd", "lppd_ref")).alias("d_y"),
        F.pow(F.col("mu_fast") - y, 2).alias("e_a"), known(F.pow(F.col("mu") - y, 2)).alias("e_y"),
        hits("mu_fast").alias("c_a"), known(hits("mu")).alias("c_y"),
    )
    weights = {"d": F.lit(1.0), "e": F.col("w"), "c": F.lit(1.0)}
    everywhere = lambda w, c: complete(F.sum(w * c) / F.sum(w), c)

    def sampled(w: Column, c: Column) -> Column:
        return F.when(F.count_if("m") == F.count(F.when(F.col("m"), c)), F.sum(F.when(F.col("m"), w * c)) / F.sum(F.when(F.col("m"), w)))

    gap = lambda t: F.col(f"{t}_y") - F.col(f"{t}_a")
    first = rows.groupBy("size").agg(
        F.count("*").alias("n"), F.count_if("m").alias("k"), everywhere(F.col("w"), F.col("y")).alias("ym"), everywhere(F.col("w"), F.col("b")).alias("bm"),
        *[everywhere(w, F.col(f"{t}_a")).alias(f"{t}_mean") for t, w in weights.items()], *[sampled(w, gap(t)).alias(f"{t}_gap") for t, w in weights.items()],
    ).withColumnRenamed("size", "of")
    both = rows.join(F.broadcast(first), F.col("size").eqNullSafe(F.col("of")))
    # About the mean of the approximation the difference estimator of a variance needs no products of totals.
    off = lambda t, kind: F.col(f"{t}_{kind}") - F.col(f"{t}_mean")
    v, w = F.pow(F.col("ym") - F.col("y"), 2), F.col("w")
    approx, exact = off("e", "a"), F.col("e_y") - F.col("e_mean") - F.col("e_gap")
    own = F.col("b") - F.col("bm")
    less_own = own if delta else zero

    def products(left_a: Column, left_y: Column, right: Column) -> Column:
        return everywhere(w, left_a * right) + sampled(w, (left_y - left_a) * right)

    sums = both.groupBy("size").agg(
        *[F.first(c).alias(c) for c in ("n", "k", "bm", *[f"{t}_{c}" for t in weights for c in ("mean", "gap")])],
        *[everywhere(u, F.pow(off(t, "a"), 2)).alias(f"{t}_sq") for t, u in weights.items()],
        *[sampled(u, F.pow(off(t, "y"), 2) - F.pow(off(t, "a"), 2)).alias(f"{t}_more") for t, u in weights.items()],
        *[sampled(u, F.pow(gap(t) - F.col(f"{t}_gap"), 2)).alias(f"{t}_spread") for t, u in weights.items()],
        everywhere(w, v).alias("vm"), everywhere(w, v * v).alias("vsq"), everywhere(w, own * own).alias("bb"),
        products(approx, exact, own).alias("eb"), products(approx - less_own, exact - less_own, v).alias("ev"),
    )
    n, k = F.col("n"), F.col("k")
    less, less_k = F.when(n > 1, n - 1), F.when(k > 1, k - 1)

    def variance(t: str) -> Column:
        """Of the estimated sum: by sampling, and between observations."""
        by_sampling = n * n * (1 - k / n) * F.col(f"{t}_spread") / less_k
        between = n * (F.col(f"{t}_sq") + F.col(f"{t}_more")) - n * F.pow(f"{t}_gap", 2) + by_sampling / n
        return F.when(k == n, between * n / less).otherwise(by_sampling + between)

    sums = sums.withColumns({
        **{f"{t}m": F.col(f"{t}_mean") + F.col(f"{t}_gap") for t in weights}, "var_d": variance("d"), "var_e": variance("e") / (n * n), "var_c": variance("c") / (n * n),
        "var_b": F.col("bb") / less, "cov_eb": F.col("eb") / less, "cov_ey": F.col("ev") / less, "var_y": cut_zero(F.col("vsq") - F.col("vm") * F.col("vm")) / less,
    })
    return _results(sums, stats, delta, alpha)


def auc(rows: DataFrame, by: list[str], y: str = "y", score: str = "mu", weight: str = "wobs", name: str = "auc") -> DataFrame:
    """Area under the ROC curve by group, ties counted half; null with missing inputs or one class only.

    Equal predictions collapse first; then each pairs its negatives with the positives above it.
    """
    negative = F.sum(F.when(F.col(y) == 0, F.col(weight)).otherwise(0.0)).alias("w0")
    positive = F.sum(F.when(F.col(y) == 1, F.col(weight)).otherwise(0.0)).alias("w1")
    bad = F.max((F.col(y).isNull() | F.col(score).isNull() | F.col(weight).isNull()).cast("int")).alias("bad")
    tied = rows.groupBy(*by, score).agg(negative, positive, bad)
    ranked = prefix_sums(tied, score, ["w1"], by)
    area = F.sum(F.col("w0") * (F.col("before_w1") + F.col("w1") / 2))
    return ranked.groupBy(*by).agg(F.when((F.max("bad") == 0), F.try_divide(area, F.sum("w0") * F.sum("w1"))).alias(name))


def bootstrap_rows(rows: DataFrame, n: int, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """``replicates`` resamples with replacement of rows keyed 0..n-1, drawn by keyed hashes."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint")) if replicates else F.array().cast("array<bigint>")
    drawn = rows.select(F.col(key).alias("slot"), F.explode(numbers).alias("replicate"))
    drawn = drawn.select("replicate", (keyed(F.col("replicate") * n + F.col("slot"), seed) % n).alias(key))
    return drawn.join(rows, key)


#: Numbers of draws and of their counts that a group of neighbouring rows holds at once, about.
DRAWN_TOGETHER = 1 << 18


def _taken(rows: DataFrame, n: int, key: str, replicates: int, seed: int) -> DataFrame:
    """(mu, y, wobs, s1, taken) of rows keyed 0..n-1: how often each replicate of ``bootstrap_rows`` has the row.

    Draws are made from their numbers alone and shuffled as packed integers, by blocks of keys, which meet
    the blocks of rows; neither rows nor draws become a row for each replicate.
    """
    spark = rows.sparkSession
    block, tasks = max(1, DRAWN_TOGETHER // replicates), max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(replicates)
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                number = batch.column(0).slice(first, block).to_numpy(zero_copy_only=False)
                hashed = (at * n + number[:, None]) % MODULUS
                for shift in (INCREMENT + seed * 69069, INCREMENT):
                    hashed = (hashed * MULTIPLIER + shift) % MODULUS
                cells = np.sort((hashed % n * replicates + at).ravel())
                blocks, starts = np.unique(cells // (block * replicates), return_index=True)
                parts = [(cells[a:b] % (block * replicates)).astype(np.int32).tobytes() for a, b in zip(starts, [*starts[1:], len(cells)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], ["block", "cells"])

    def meet(held: pa.Table, drawn: pa.Table) -> pa.Table:
        counts = np.zeros(block * replicates, np.int32)
        for part in drawn.column("cells"):
            counts += np.bincount(np.frombuffer(part.as_buffer(), np.int32), minlength=len(counts)).astype(np.int32)
        counts = counts.reshape(block, replicates)
        lines = [counts[i].tobytes() for i in held.column("s1").to_numpy() % block]
        return held.drop_columns(["block"]).append_column("taken", pa.array(lines, pa.binary()))

    drawn = spark.range(0, n, 1, tasks).mapInArrow(draw, "block bigint, cells binary")
    blocked = rows.withColumn("block", F.floor(F.col(key) / block)).select("block", "mu", "y", "wobs", F.col(key).cast("bigint").alias("s1"))
    return blocked.groupBy("block").cogroup(drawn.groupBy("block")).applyInArrow(meet, "mu double, y double, wobs double, s1 bigint, taken binary")


def bootstrap_auc(rows: DataFrame, n: int, key: str, replicates: int, seed: int = 0, alpha: float = ALPHA, y: str = "y", score: str = "mu", weight: str = "wobs") -> DataFrame:
    """Standard deviation and quantiles of the AUC over bootstrap replicates of rows keyed 0..n-1.

    Replicates are those of ``bootstrap_rows``; a row has an array of how often each took it, and one sorted
    sweep gives the AUC of all. A replicate that took a missing input, or one class only, has none.
    """
    double = lambda c: F.col(c).cast("double")
    top = F.when(F.isnan(double(score)), float("inf")).otherwise(double(score))
    named = rows.select(key, top.alias("mu"), double(y).alias("y"), double(weight).alias("wobs"))
    if not replicates or not n:
        found = rows.sparkSession.createDataFrame([], "auc double")
    else:
        order = [F.desc("mu"), "s1"]
        taken = _taken(named, n, key, replicates, seed).select(F.lit(0).alias("size"), F.coalesce("mu", F.lit(0.0)).alias("mu"), F.when(F.col("mu").isNotNull(), F.col("y")).alias("y"), "wobs", F.lit(0).alias("bad"), "s1", "taken")
        ranged = taken.repartitionByRange(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order)

        def weigh(own: pa.RecordBatch) -> list[np.ndarray]:
            y, w = (own.column(c).to_numpy(zero_copy_only=False) for c in ("y", "wobs"))
            lines = own.column("taken")
            counts = np.frombuffer(b"".join(lines.to_pylist()), np.int32).reshape(len(lines), replicates)
            missing = np.isnan(w) | own.column("y").is_null().to_numpy(zero_copy_only=False)
            unit = np.where(missing, np.nan, w)[:, None]
            times = np.where(counts > 0, counts * unit, 0.0)
            return [np.where((missing | (y == side))[:, None], times, 0.0) for side in (0, 1)]

        found = _swept(ranged, replicates, weigh, False).select(F.explode("auc").alias("auc"))
    return found.agg(F.stddev_samp("auc").alias("se"), F.percentile("auc", F.lit(alpha / 2)).alias("lq"), F.percentile("auc", F.lit(1 - alpha / 2)).alias("uq"))


#: Rows whose replicate weights are made at once.
SWEEP_ROWS = 512
#: Trials of a row beyond which its resampling weights would lose precision.
MOST_TRIALS = 500


def resampled(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers of the given means from uniform ones: how often a resample with replacement takes something."""
    k, p = np.zeros(u.shape), np.broadcast_to(np.exp(-mean), u.shape).copy()
    upto, step = p.copy(), 0
    while (more := u > upto).any() and step < 20 * MOST_TRIALS:
        k += more
        step += 1
        p *= mean / step
        upto += p
    return k


def _row_seeds(key: Column, seed: int) -> list[Column]:
    """Two integers under 2^32 from a key, as good as independent between keys."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint").alias(name) for at, name in ((1, "s1"), (9, "s2"))]


def auc_replicates(pointwise: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(size, auc): an array of the AUC and its bootstrap replicates for each size; null with missing inputs or one class.

    y counts successes of wobs trials. A replicate weighs every success and failure by a Poisson number
    keyed by observation and replicate, alike for all sizes. Rows are sorted once, over ranges of size
    and prediction; a range keeps an array of sums over replicates, one number each, and no row is
    multiplied. Ranges come together through their own areas and sums, and through the ties at their ends,
    so that many equal predictions can be spread over ranges.
    """
    spark = pointwise.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in ("y", "mu", "wobs")])
    rows = pointwise.select(F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("mu", F.lit(0.0)).alias("mu"), F.coalesce("y", F.lit(0.0)).cast("double").alias("y"), F.coalesce("wobs", F.lit(0.0)).cast("double").alias("wobs"), missing.alias("bad"), *_row_seeds(F.col("obs_id"), seed))
    order = ["size", F.desc("mu"), "s1"]
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    at = np.arange(replicates + 1)

    def weigh(own: pa.RecordBatch) -> list[np.ndarray]:
        y, n, s1, s2 = (own.column(c).to_numpy(zero_copy_only=False) for c in ("y", "wobs", "s1", "s2"))
        if (n > MOST_TRIALS).any():
            raise ValueError(f"rows of more than {MOST_TRIALS} trials can't be resampled: split them")
        sides = []
        for side, count in ((0, n - y), (1, y)):
            u = ((s1[:, None] + (2 * at + side) * s2[:, None]) % MODULUS + 0.5) / MODULUS
            w = resampled(u, np.maximum(count, 0)[:, None])
            w[:, 0] = np.maximum(count, 0)
            sides.append(w)
        return sides

    return _swept(ranged, replicates + 1, weigh).select(F.when(F.col("size") >= 0, F.col("size")).alias("size"), "auc")


def _swept(ranged: DataFrame, width: int, weigh: Callable[[pa.RecordBatch], list[np.ndarray]], first_counts: bool = True) -> DataFrame:
    """(size, auc): arrays of ``width`` areas from rows sorted by size and falling prediction over ranges.

    ``weigh`` gives a batch's weights of failures and successes, a column for each area; a size without the first
    area has none at all, unless ``first_counts`` is false.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: dict | None = None  # sums of the size at hand

        def made(s: dict) -> pa.RecordBatch:
            cells = [s["size"], part, s["bad"], s["head"][0], s["tail"][0], *[v.tobytes() for v in (*s["head"][1:], s["area"], s["in0"], s["in1"], *s["tail"][1:])]]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, SEGMENT_TYPES, strict=True)], SEGMENT)

        def close_tail(s: dict) -> None:
            """The last tie belongs to the inside, unless it is the first as well."""
            if s["tail"][0] != s["head"][0]:
                _, w0, w1 = s["tail"]
                s["area"] += w0 * (s["in1"] + w1 / 2)
                s["in0"] += w0
                s["in1"] += w1

        for batch in batches:
            for first in range(0, batch.num_rows, SWEEP_ROWS):
                own = batch.slice(first, SWEEP_ROWS)
                size, mu, bad = (own.column(c).to_numpy(zero_copy_only=False) for c in ("size", "mu", "bad"))
                sides = weigh(own)
                starts = np.flatnonzero(np.concatenate([[True], (size[1:] != size[:-1]) | (mu[1:] != mu[:-1])]))
                w0, w1 = (np.add.reduceat(w, starts, axis=0) for w in sides)
                bads = np.add.reduceat(bad, starts)
                for k, i in enumerate(starts):
                    if now is None or now["size"] != size[i]:
                        if now:
                            yield made(now)
                        zero = np.zeros(width)
                        now = {"size": int(size[i]), "bad": 0, "head": (float(mu[i]), zero.copy(), zero.copy()), "tail": (float(mu[i]), zero.copy(), zero.copy()), "area": zero.copy(), "in0": zero.copy(), "in1": zero.copy()}
                    now["bad"] += int(bads[k])
                    if mu[i] == now["head"][0]:
                        now["head"] = (now["head"][0], now["head"][1] + w0[k], now["head"][2] + w1[k])
                    elif mu[i] == now["tail"][0]:
                        now["tail"] = (now["tail"][0], now["tail"][1] + w0[k], now["tail"][2] + w1[k])
                    else:
                        close_tail(now)
                        now["tail"] = (float(mu[i]), w0[k], w1[k])
        if now:
            yield made(now)

    def joined(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["part"])
        vector = lambda v: np.frombuffer(v, float)
        parts: list[tuple] = []  # ties (mu, w0, w1) and insides (None, w0, w1, area), from the largest prediction down
        for r in held:
            inside = vector(r["in0"]), vector(r["in1"])
            one = [(r["mu_head"], vector(r["head0"]), vector(r["head1"]))]
            if r["mu_tail"] != r["mu_head"]:
                one += [(None, *inside, vector(r["area"])), (r["mu_tail"], vector(r["tail0"]), vector(r["tail1"]))]
            for p in one:
                if parts and p[0] is not None and p[0] == parts[-1][0]:
                    parts[-1] = (p[0], parts[-1][1] + p[1], parts[-1][2] + p[2])
                else:
                    parts.append(p)
        area, total0, above = np.zeros(width), np.zeros(width), np.zeros(width)
        for p in parts:
            area = area + p[1] * above + (p[3] if p[0] is None else p[1] * p[2] / 2)
            total0, above = total0 + p[1], above + p[2]
        with np.errstate(divide="ignore", invalid="ignore"):
            found = area / (total0 * above)
        sound = not any(r["bad"] for r in held) and (np.isfinite(found[0]) or not first_counts)
        return pa.table({"size": pa.array([held[0]["size"]], pa.int32()), "auc": pa.array([[None if not np.isfinite(v) else float(v) for v in found] if sound else None], pa.list_(pa.float64()))})

    segments = ranged.mapInArrow(sweep, ", ".join(f"{n} {t}" for n, t in zip(SEGMENT, ("int", "int", "bigint", "double", "double", *["binary"] * 7), strict=True)))
    return segments.groupBy("size").applyInArrow(joined, "size int, auc array<double>")


SEGMENT = ["size", "part", "bad", "mu_head", "mu_tail", "head0", "head1", "area", "in0", "in1", "tail0", "tail1"]
SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 7]


def _quantile(values: Column, p: float) -> Column:
    """Of a sorted array, between neighbours in proportion."""
    place = (F.size(values) - 1) * F.lit(p)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def auc_statistics(pointwise: DataFrame, baseline: str | int | None = None, alpha: float = ALPHA, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(size, statistic, value, se, lq, uq) of the AUC, or of its difference to a baseline, with standard error and bounds over bootstrap replicates."""
    found = auc_replicates(pointwise, replicates, seed)
    if baseline is not None:
        base = found.filter(F.col("size").eqNullSafe(F.lit(None if baseline == "ref" else baseline))).select(F.col("auc").alias("base"))
        found = found.crossJoin(F.broadcast(base)).select("size", F.zip_with("auc", "base", lambda a, b: a - b).alias("auc"))  # one row
    drawn = found.select("size", F.get("auc", F.lit(0)).alias("value"), F.array_sort(F.array_compact(F.slice("auc", 2, max(replicates, 1)))).alias("drawn"))
    n = F.size("drawn")
    mean = F.aggregate("drawn", F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate(F.transform("drawn", lambda v: (v - F.col("m")) * (v - F.col("m"))), F.lit(0.0), lambda a, v: a + v)
    drawn = drawn.withColumn("m", F.when(n > 0, mean))
    return drawn.select("size", F.lit("auc").alias("statistic"), "value", F.when(n > 1, F.sqrt(spread / (n - 1))).alias("se"), F.when(n > 0, _quantile(F.col("drawn"), alpha / 2)).alias("lq"), F.when(n > 0, _quantile(F.col("drawn"), 1 - alpha / 2)).alias("uq"))


def difference_estimate(rows: DataFrame, approx: str, exact: str, sampled: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Subsampling difference estimator of a sum: y_hat, its variance, and that of the sum itself, for each group of ``by``.

    ``approx`` is known for every row, ``exact`` where ``sampled`` is true; rows are a simple random
    sample without replacement. With all rows sampled the estimate is exact and its variance zero.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = rows.select(*by, F.col(approx).alias("a"), F.when(F.col(sampled), F.col(exact)).alias("y"), w.alias("w"), F.col(sampled).alias("m"))
    inside = lambda c: F.sum(F.when(F.col("m"), c))
    e = F.col("y") - F.col("a")
    first = rows.groupBy(*by).agg(F.count("*").alias("n_all"), F.count_if("m").alias("n_m"), F.sum("w").alias("sw"), inside(F.col("w")).alias("sm"), F.sum(F.col("w") * F.col("a")).alias("wa"), F.sum(F.col("w") * F.col("a") * F.col("a")).alias("waa"), inside(F.col("w") * e).alias("we"), inside(F.col("w") * (F.col("y") * F.col("y") - F.col("a") * F.col("a"))).alias("wq"))
    means = F.broadcast(first.select(*by, (F.col("we") / F.col("sm")).alias("em"), "sm"))
    second = (rows.join(means, list(by)) if by else rows.crossJoin(means)).groupBy(*by).agg(inside(F.col("w") / F.col("sm") * F.pow(e - F.col("em"), 2)).alias("ve"))
    met = first.join(second, list(by)) if by else first.crossJoin(second)
    n_all, n = F.col("n_all"), F.col("n_m")
    t, t2 = F.col("wa") * n_all / F.col("sw"), F.col("waa") * n_all / F.col("sw")
    te, tq = n_all * F.col("we") / F.col("sm"), n_all * F.col("wq") / F.col("sm")
    var_e = F.col("ve") * n / F.when(n > 1, n - 1)
    v = n_all * n_all * (1 - n / n_all) * var_e / n
    y_hat = t + te
    return met.select(*by, y_hat.alias("y_hat"), v.alias("v_y_hat"), (t2 + tq - (te * te - v + 2 * t * y_hat - t * t) / n_all).alias("hat_v_y"))


def best_size(table: DataFrame, stat: str) -> DataFrame:
    """The submodel size of the best value, the smallest of equals."""
    order = F.col("value") if is_utility(stat) else -F.col("value")
    rows = table.filter(F.col("size").isNotNull() & (F.col("statistic") == stat) & F.col("value").isNotNull())
    return rows.agg(F.max_by("size", F.struct(order, -F.col("size"))).alias("size"))
