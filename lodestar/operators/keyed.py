"""Keyed pseudo-randomness, global ranks and prefix sums that no single task has to hold.

Hashes are linear congruential on integer keys, so that any engine with 64-bit integers repeats them
and results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODULUS = 1 << 32
MULTIPLIER = 1664525
INCREMENT = 1013904223
#: Rows of a range that are numbered together, about; and the least and most ranges.
RANGE_ROWS = 1 << 18
RANGES = (1 << 10, 1 << 20)


def keyed(key: Column, seed: int = 0) -> Column:
    """An integer in [0, 2**32) from an integer key and a seed."""
    once = (F.pmod(key.cast("bigint"), F.lit(MODULUS)) * MULTIPLIER + INCREMENT + seed * 69069) % MODULUS
    return (once * MULTIPLIER + INCREMENT) % MODULUS


def uniform(key: Column, seed: int = 0) -> Column:
    """A number strictly between 0 and 1."""
    return (keyed(key, seed) + 0.5) / MODULUS


def keyed_sql(key: str, seed: int = 0) -> str:
    """SQL of ``keyed`` for keys that aren't negative."""
    once = f"(({key}) % {MODULUS} * {MULTIPLIER} + {INCREMENT + seed * 69069}) % {MODULUS}"
    return f"(({once}) * {MULTIPLIER} + {INCREMENT}) % {MODULUS}"


def rank_by_hash(df: DataFrame, name: str, hash_column: str, *ties: str) -> DataFrame:
    """Adds the 1-based rank by a hash in [0, 2**32) and tie-breaking columns, over the whole table.

    Rows are numbered within ranges of the hash, as many as the table's count asks for; the ranges'
    counts give the offsets. No window spans the table.
    """
    ranges = min(max(1 << (df.count() // RANGE_ROWS).bit_length(), RANGES[0]), RANGES[1])
    bucket = F.floor(F.col(hash_column) / (MODULUS // ranges)).cast("int")
    marked = df.withColumn("_range", bucket)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(hash_column, *ties))
    return marked.withColumn("_within", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_within") + F.col("_offset")).drop("_range", "_within", "_offset")


def prefix_sums(df: DataFrame, order: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds ``before_<value>``: sums over all rows that come earlier in descending order of a column with distinct values.

    The column's range is cut at approximate quantiles; sums within a cut and the cuts' own sums add
    up exactly wherever the cuts fall. ``by`` columns separate independent sums.
    """
    by = by or []
    cuts = sorted(set(df.approxQuantile(order, [i / 64 for i in range(1, 64)], 0.01)), reverse=True)
    at = F.lit(0)
    for c in cuts:
        at = at + F.when(F.col(order) < c, 1).otherwise(0)
    marked = df.withColumn("_cut", at)
    earlier = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy(*by, "_cut").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    offsets = offsets.select(*by, "_cut", *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values])
    inside = Window.partitionBy(*by, "_cut").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(offsets, [*by, "_cut"]) if by else marked.join(F.broadcast(offsets), "_cut")
    for v in values:
        out = out.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_o_{v}"))
    return out.drop("_cut", *[f"_o_{v}" for v in values])
