"""Weighted second moments: the one scan that answers every Gaussian projection.

For columns z, weights w and optional groups (folds), G = sum of w z z'. Narrow designs are a plain
SQL aggregate; wide ones sum in Arrow batches first. Both add partial sums per task, so only one
small row per task and group is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "(Intercept)"
#: Designs with more columns are summed in Arrow batches.
SQL_COLUMNS = 24
#: A column whose spread is less than this share of its mean square is summed again about its mean.
FAR = 1e-7


@dataclass(frozen=True)
class Gram:
    """Names, the moment matrix of the columns less their shifts, the number of rows behind it, and the shifts.

    Shifts are zero but for columns far from zero, whose products would cancel; what only depends on
    deviations from means never adds them again.
    """

    names: tuple[str, ...]
    matrix: np.ndarray
    rows: int
    shift: tuple[float, ...] = ()

    def _at(self, names: list[str]) -> list[int]:
        at = {n: i for i, n in enumerate(self.names)}
        return [at[n] for n in names]

    def offsets(self, names: list[str]) -> np.ndarray:
        return np.array([self.shift[i] for i in self._at(names)]) if self.shift else np.zeros(len(names))

    def shifted(self, rows: list[str], cols: list[str]) -> np.ndarray:
        """Moments of the columns less their shifts."""
        return self.matrix[np.ix_(self._at(rows), self._at(cols))]

    def part(self, rows: list[str], cols: list[str]) -> np.ndarray:
        """Moments of the columns themselves."""
        m = self.shifted(rows, cols)
        if not self.shift:
            return m
        s, t = self.offsets(rows), self.offsets(cols)
        sums = self.shifted([INTERCEPT], cols)[0], self.shifted([INTERCEPT], rows)[0]
        return m + np.outer(s, sums[0]) + np.outer(sums[1], t) + self.weight * np.outer(s, t)

    @property
    def weight(self) -> float:
        return float(self.shifted([INTERCEPT], [INTERCEPT])[0, 0])

    def mean(self, names: list[str]) -> np.ndarray:
        return self.shifted([INTERCEPT], names)[0] / self.weight + self.offsets(names)

    def centered(self, rows: list[str], cols: list[str]) -> np.ndarray:
        near = [self.shifted([INTERCEPT], names)[0] / self.weight for names in (rows, cols)]
        return self.shifted(rows, cols) - self.weight * np.outer(*near)

    def __sub__(self, other: Gram) -> Gram:
        """Moments of the rows that are in this but not in the other: a fold's complement."""
        return Gram(self.names, self.matrix - other.matrix, self.rows - other.rows, self.shift)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.names, self.matrix + other.matrix, self.rows + other.rows, self.shift)


def moments(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, by: Column | None = None) -> DataFrame:
    """One row for each group: g, n and the upper triangle of the moment matrix as columns m0, m1, ..."""
    weight = F.lit(1.0) if weight is None else weight
    values = [F.lit(1.0), *columns.values()]
    z = df.select((F.lit(0) if by is None else by).alias("g"), weight.cast("double").alias("w"), *[c.cast("double").alias(f"z{i}") for i, c in enumerate(values)])
    if len(values) <= SQL_COLUMNS:
        products = [F.sum(F.col("w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"m{k}") for k, (i, j) in enumerate(zip(*np.triu_indices(len(values)), strict=True))]
        return z.groupBy("g").agg(F.count("*").alias("n"), *products)
    return _wide(z, len(values))


def _wide(z: DataFrame, k: int) -> DataFrame:
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist())
            w = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 2 + k)])
            for g in set(groups.tolist()):
                own = groups == g
                part = (x[own] * w[own, None]).T @ x[own]
                old = sums.get(g)
                sums[g] = (int(own.sum()), part) if old is None else (old[0] + int(own.sum()), old[1] + part)
        rows = [(g, n, i, float(v)) for g, (n, m) in sums.items() for i, v in enumerate(m[upper])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["g", "n", "at", "v"])

    kind = dict(z.dtypes)["g"]
    cells = z.mapInArrow(partial, f"g {'bigint' if kind != 'string' else kind}, n bigint, at bigint, v double")
    summed = cells.groupBy("g", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    packed = summed.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("m"))
    return packed.select("g", "n", *[F.get("m", F.lit(i)).alias(f"m{i}") for i in range(len(upper[0]))])


def draw_name(draw: int) -> str:
    """The name of a draw's fits, counted from 1, among the columns of a moment matrix."""
    return f"_m{draw}"


def draw_moments(df: DataFrame, columns: dict[str, Column], draws: Column, n_draws: int, weight: Column | None = None, by: Column | None = None) -> dict:
    """Moments of the columns and of every draw of an array of fits, by group: X'WX, X'WM and M'WM in one Arrow pass.

    All are taken about means, from a scan before: columns about their own, draws about that of all
    draws. Each task and group sends its matrix by rows, which are summed row by row before they
    reach the driver, so what any task or the driver holds is as large as one matrix.
    """
    weight = (F.lit(1.0) if weight is None else weight).cast("double")
    values = list(columns.values())
    level = F.aggregate(draws, F.lit(0.0), lambda a, x: a + x) / n_draws
    mean = df.agg(F.sum(weight).alias("w"), *[F.sum(weight * c).alias(f"s{i}") for i, c in enumerate([*values, level])]).first()
    shift = [float(mean[f"s{i}"] / mean.w) if mean.w else 0.0 for i in range(len(values) + 1)]
    near = [(c - F.lit(s)).cast("double").alias(f"z{i}") for i, (c, s) in enumerate(zip(values, shift, strict=False))]
    z = df.select((F.lit(0) if by is None else by).alias("g"), weight.alias("w"), draws.cast("array<double>").alias("m"), *near)

    last, k = shift[-1], len(values)

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        groups = np.array(batch.column(0).to_pylist())
        w = batch.column(1).to_numpy(zero_copy_only=False)
        m = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(w), n_draws) - last
        x = np.column_stack([np.ones(len(w)), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 3 + k)], m])
        for g in set(groups.tolist()):
            own = groups == g
            yield g, int(own.sum()), (x[own] * w[own, None]).T @ x[own]

    names = (INTERCEPT, *columns, *[draw_name(i + 1) for i in range(n_draws)])
    shifts = (0.0, *shift[:-1], *[shift[-1]] * n_draws)
    return {g: Gram(names, matrix, n, shifts) for g, (n, matrix) in summed_blocks(z, blocks, len(names)).items()}


def summed_blocks(df: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[tuple]], k: int) -> dict:
    """Sums of (group, rows, k x k matrix) over all batches: {group: (rows, matrix)}. The group is ``df``'s column g."""
    kind = dict(df.dtypes)["g"]
    schema = f"g {kind}, at int, n bigint, line binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        g_type = None
        for batch in batches:
            g_type = batch.schema.field(0).type
            if batch.num_rows:
                for g, n, matrix in blocks(batch):
                    old = sums.get(g)
                    sums[g] = (n, matrix) if old is None else (old[0] + n, old[1] + matrix)
        for g, (n, matrix) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * k, g_type), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array([line.tobytes() for line in matrix], pa.binary())], ["g", "at", "n", "line"])

    def add(table: pa.Table) -> pa.Table:
        lines = sum(np.frombuffer(v.as_py(), float) for v in table.column("line"))
        n = sum(table.column("n").to_pylist())
        return pa.table({"g": table.column("g").slice(0, 1), "at": table.column("at").slice(0, 1), "n": pa.array([n], pa.int64()), "line": pa.array([lines.tobytes()], pa.binary())})

    found: dict = {}
    for r in df.mapInArrow(partial, schema).groupBy("g", "at").applyInArrow(add, schema).collect():
        matrix = found.setdefault(r["g"], (r["n"], np.zeros((k, k))))[1]
        matrix[r["at"]] = np.frombuffer(bytes(r["line"]), float)
    return found


def combined(g: Gram, targets: dict[str, dict[str, float]]) -> Gram:
    """Moments with weighted sums of known columns appended: ``targets`` maps new names to weights by column."""
    at = {n: i for i, n in enumerate(g.names)}
    lift = np.zeros((len(at), len(targets)))
    for j, parts in enumerate(targets.values()):
        for name, w in parts.items():
            lift[at[name], j] += w
    full = np.hstack([np.eye(len(at)), lift])
    shift = (*g.shift, *(np.array(g.shift) @ lift).tolist()) if g.shift else ()
    return Gram((*g.names, *targets), full.T @ g.matrix @ full, g.rows, shift)


def gram(df: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> Gram:
    return next(iter(grams(df, columns, weight).values()), Gram((INTERCEPT, *columns), np.zeros((len(columns) + 1,) * 2), 0))


def grams(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, by: Column | None = None) -> dict:
    """Moments by group, on the driver: as many numbers as the design has pairs of columns.

    One scan; a second one, about the means, only if a column lies so far from zero that its products
    would lose its spread.
    """
    found = _collected(df, columns, weight, by)
    if not found or not columns:
        return found
    whole = functools.reduce(lambda a, b: a + b, found.values())
    names = list(columns)
    square, mean = np.diag(whole.part(names, names)), whole.mean(names) if whole.weight else np.zeros(len(names))
    with np.errstate(invalid="ignore"):
        far = (square > 0) & (np.diag(whole.centered(names, names)) < FAR * square) if whole.weight else np.zeros(len(names), bool)
    if not far.any():
        return found
    shift = np.where(far, mean, 0.0).tolist()
    near = {n: c.cast("double") - F.lit(s) if s else c for (n, c), s in zip(columns.items(), shift, strict=True)}
    return {g: Gram(m.names, m.matrix, m.rows, (0.0, *shift)) for g, m in _collected(df, near, weight, by).items()}


def _collected(df: DataFrame, columns: dict[str, Column], weight: Column | None, by: Column | None) -> dict:
    k = len(columns) + 1
    upper = np.triu_indices(k)
    found = {}
    for row in moments(df, columns, weight, by).collect():
        m = np.zeros((k, k))
        m[upper] = [row[f"m{i}"] or 0.0 for i in range(len(upper[0]))]
        found[row["g"]] = Gram((INTERCEPT, *columns), m + m.T - np.diag(np.diag(m)), row["n"])
    return found
