"""Folds, their moments, and what is computed fold by fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.gram import Gram
from lodestar.operators.keyed import keyed, rank_by_hash


def balanced_folds(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds fold labels 1..k whose counts differ by one at most, in keyed random order."""
    if k < 2:
        raise ValueError("at least two folds")
    hashed = df.withColumn("_hash", keyed(F.col(key), seed))
    ranked = rank_by_hash(hashed, "_rank", "_hash", key)
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k + 1).cast("int")).drop("_hash", "_rank")


def train_test(folded: DataFrame, key: str, fold: str = "fold") -> DataFrame:
    """(key, fold, part): every row is test in its own fold and train in all others."""
    folds = folded.select(F.col(fold).alias("of")).distinct()
    return folded.crossJoin(F.broadcast(folds)).select(key, F.col("of").alias(fold), F.when(F.col("of") == F.col(fold), "test").otherwise("train").alias("part"))


def complements(by_fold: dict[int, Gram]) -> dict[int, Gram]:
    """Moments of each fold's training rows: the total minus the fold."""
    total = None
    for g in by_fold.values():
        total = g if total is None else total + g
    return {f: total - g for f, g in by_fold.items()}
